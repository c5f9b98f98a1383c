"""The corpus pipeline on planted cases, and the registered queries on the smallest tables."""

import random

import duckdb
import pytest

import corpus_pipeline
from loquela.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def test_stages_keep_and_drop(spark, tmp_path):
    rng = random.Random(1)
    syllables = {"en": ["the", "ing", "tion", "wh"], "de": ["und", "sch", "keit", "ü"]}
    say = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    item = say("en", 30)
    docs = [(i, say("en de".split()[i % 2], 120), "en de".split()[i % 2], "s0") for i in range(40)]
    near = docs[4][1].split()
    near[60] = "changed"
    docs += [(50, docs[3][1], "de", "s1"), (51, " ".join(near), "en", "s1"), (52, say("en", 50) + " " + item + " " + say("en", 50), "en", "s1"), (53, say("en", 90) + " mail a.b77@mail.org", "en", "s1"), (54, "12 34", "en", "s1"), (55, None, "en", "s1")]
    df = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows, kept = df, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.written(stage(spark, rows, str(tmp_path)))
        assert rows.columns == df.columns, name
        kept.append({r["doc_id"] for r in rows.collect()})
    everyone = {i for i, *_ in docs}
    assert kept[0] == everyone - {54, 55} and kept[1] == kept[0] - {50, 51} and kept[2] == kept[1] - {52} and kept[3] == kept[2]
    assert "a.b77@" not in rows.filter("doc_id = 53").first()["text"]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == kept[3]


def test_keep_one_tells_texts_of_one_id_apart(spark):
    """An id's other text is judged by its own class; repeated rows are one; rows without an id stay."""
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, say(1)), (1, say(2)), (2, say(2) + " more"), (2, say(3)), (3, say(3)), (3, say(3)), (None, say(1)), (None, say(1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS root", "'y' AS one")
    kept = simhash.keep_one(docs, simhash.similar_documents(docs))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(0, say(1)), (0, say(1)), (1, say(1)), (1, say(2)), (2, say(3))])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_registered_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted([str(v) for v in r] for r in got.collect())
    assert rows == sorted([str(r[i]) for i in order] for r in want.fetchall()) and rows


def test_near_duplicates_by_fingerprint_links_and_sets(spark, docs_of, monkeypatch):
    """Classes of op1's index are joined whatever their sets are, and no shingle sets are stored."""
    rng, phrase = random.Random(4), "one two three four five six seven " * 60
    say = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    docs = [phrase + say(40), phrase + say(40), *[say(400) for _ in range(40)]]
    docs += [docs[5].replace(docs[5].split()[200], "changed"), docs[6] + " " + say(30), docs[7]]
    bits = simhash.fingerprint(docs[0]) ^ simhash.fingerprint(docs[1])
    assert bits.bit_count() <= 3 and len(set(simhash.shingle_set(docs[0])) & set(simhash.shingle_set(docs[1]))) < 20
    df, made = docs_of([*enumerate(docs), (50, None), (51, "")]), []
    real = simhash.written
    monkeypatch.setattr(simhash, "written", lambda d, *a: made.append(d.columns) or real(d, *a))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()}
    assert kept == {0, *range(2, 42), 50}
    assert made and not any("grams" in columns for columns in made)


def test_long_lists_compare_groups_of_possible_pairs_once(spark, docs_of, monkeypatch):
    """Of lists of a hundred sets, those that may be similar to another meet, once; same classes as brute force."""
    rng, sent = random.Random(7), []
    say = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    common = say(16)
    texts = [[*common, *say(14)] for _ in range(100)]
    texts += [t[:-k] + say(k) for t in texts[:30] for k in (2, 3)]
    docs = [" ".join(t) for t in texts]
    sets = [set(simhash.shingle_set(d).tolist()) for d in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    monkeypatch.setattr(simhash, "RANKED", 0)
    name = "_in_groups" if hasattr(simhash, "_in_groups") else "_in_lists"
    real = getattr(simhash, name)
    monkeypatch.setattr(simhash, name, lambda rows, *a: sent.append((rows.count(), rows.select("node").distinct().count())) or real(rows, *a))
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs_of([*enumerate(docs)])).collect()}
    assert found == dict(enumerate(root)) and 1 < len(set(root)) < len(docs)
    assert sent and all(rows == nodes < 100 for rows, nodes in sent)
