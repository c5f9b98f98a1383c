"""Top-k search, WARC, suffix arrays, HTML, token files: brute force, round trips, edge cases."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loquela.llm import compiled, htmltext, rangecoder, suffix, tokenfile, topk, warc
from loquela.llm._shared import in_slices, shared_dir
from loquela.llm.queries import _vocabulary


def plain_top(queries, docs, k):
    """Over (id, vector) rows: a query's own row is no candidate, other rows of its id are."""
    out = []
    for q, v in queries:
        rest = list(docs)
        rest.remove((q, v))
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), d) for d, w in rest)
        out += [(q, i, d, -s) for i, (s, d) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_k_brute_force(spark):
    rng = random.Random(1)
    docs = [(i, [rng.randint(-3, 3) for _ in range(4)]) for i in range(230)]  # few values: many ties
    docs += [(300 + i, docs[5][1]) for i in range(6)]
    big = [(i, [rng.randint(-(1 << 30), 1 << 30) for _ in range(4)]) for i in range(40)]
    huge = [(i, [rng.choice((-1, 1)) * ((1 << 31) + rng.randint(0, 99)), rng.randint(-9, 9)]) for i in range(60)]
    groups = [(i, [50 * (i % 7) + rng.randint(0, 2), 300 - 40 * (i % 7) + rng.randint(0, 2)]) for i in range(400)]
    odd = [(7, [1, 2, 3]), (7, [4, 5, 6]), (7, [4, 5, 6]), (9, [9]), (50, [1, 1, 1]), (50, [2, 0, 1]), (100, []), (2, [1, 0, 0, 5])]
    for rows, kw in ((docs, {"block": 8, "range_size": 50}), (docs, {}), (big, {"block": 4}), (huge, {"range_size": 9, "block": 2}), (groups, {"range_size": 60, "block": 8}), (odd, {}), (odd, {"range_size": 2, "block": 1}), ([(1, [1, 2]), (2, [0, 1])], {})):
        df = spark.createDataFrame([*rows, (None, rows[0][1]), (9999, None)], "vec_id long, v array<long>").withColumns({"r": F.lit("x"), "part": F.lit(None), "score": F.lit(1)})
        queries = df.filter("vec_id % 50 = 0 OR vec_id = 2")
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(queries, df, 5, **kw).collect())
        assert got == plain_top([(i, v) for i, v in rows if i % 50 == 0 or i == 2], rows, 5)
    assert topk.top_k(queries.limit(0), df).count() == 0 and topk.top_k(queries, df.limit(0)).count() == 0


def test_blocks_are_pruned(monkeypatch):
    """On clustered vectors, dealt in any order, few of the pairs are scored."""
    rng = np.random.default_rng(2)
    d = rng.permutation(np.repeat(rng.integers(-500, 500, (40, 8)), 16, axis=0) + rng.integers(-2, 3, (640, 8)))
    scored = []
    real = topk._scores
    monkeypatch.setattr(topk, "_scores", lambda q, x: (scored.append(len(q) * len(x)), real(q, x))[1])
    ones = np.ones(640, np.int32)
    tile = topk.Tile(np.arange(640), ones, d, 16)
    row, _, score = tile.search(np.arange(10_000, 10_020), ones[:20], d[:20], np.full(20, topk.NONE), 5)
    share = sum(scored) / (20 * 640)
    print(f"{share:.2f} of all pairs scored")
    assert share < 0.3
    kth = np.array([score[row == i].min() for i in range(20)])
    scored.clear()
    again = tile.search(np.arange(10_000, 10_020), ones[:20], d[:20], kth, 5)  # a known k-th score prunes more
    assert sum(scored) / (20 * 640) <= share and len(again[0]) == 100
    scored.clear()
    assert len(tile.search(np.arange(20), ones[:20], d[:20], kth + 10**9, 5)[0]) == 0 and not scored


def test_usable_and_quantised(spark):
    rows = [(1, [0.5, -0.001]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, e array<float>")
    assert sorted(r["vec_id"] for r in df.filter(topk.usable(F.col("e"))).collect()) == [1, 6]
    assert df.filter("vec_id = 1").select(topk.quantised(F.col("e")).alias("v")).first()["v"] == [128, -1]


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit("x"), "sha1": F.lit("y"), "lines": F.lit("z")})


def test_warc_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}", rng.choice(["<p>same</p>", f"<p>{i} é</p>", "", None])) for i in range(120)]
    rows += [(7, "http://again", rows[7][2]), (None, None, "<p>same</p>"), (500, "http://a b\r\nX: y", "x" * 200_000)]
    found = warc.round_trip(pages_of(spark, rows).repartition(3), shared_dir(spark), with_payload=True).collect()
    assert len(found) == len(rows)
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", -1))
    by_id = {i: h or "" for i, _, h in rows}
    for r in found:
        html = by_id[r["page_id"]]
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == warc.digest32(html.encode())
        revisit = r["page_id"] is not None and r["page_id"] != largest[html]
        assert (r["record_type"], r["refers_to"]) == (("revisit", largest[html]) if revisit else ("response", None))
        assert revisit or bytes(r["payload"]) == html.encode()
    assert warc.round_trip(pages_of(spark, rows).limit(0), shared_dir(spark)).count() == 0


def test_warc_least_size(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    found = {r["page_id"]: r["record_type"] for r in warc.round_trip(pages_of(spark, rows), shared_dir(spark), least=3).collect()}
    assert found == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_warc_faults():
    record = warc._record("response", 1, "u", b"body", warc.digest32(b"body"), None)
    headers, block = warc.parse(record)
    assert headers["warc-type"] == "response" and block.endswith(b"body")
    for bad in (record[:-1], record.replace(b"WARC/1.1", b"WARC/9"), record.replace(b"body", b"bodx"), record.replace(b"WARC-Date: ", b"Other: "), b"junk", record.replace(b"Content-Length: ", b"Content-Length: 1")):
        with pytest.raises(warc.ArchiveError):
            warc.parse(bad)
    import struct

    import zstandard

    frame = zstandard.ZstdCompressor().compress(record)
    assert list(warc._frames(io.BytesIO(frame + frame))) == [record, record]
    words = warc.dictionary([f"sample {i} of a text that repeats itself {i % 7}".encode() * 9 for i in range(300)])
    assert words
    data = zstandard.ZstdCompressionDict(words)
    packed = zstandard.ZstdCompressor(dict_data=data).compress(record)
    for head in (words, zstandard.ZstdCompressor().compress(words)):
        assert list(warc._frames(io.BytesIO(struct.pack("<II", warc.SKIPPABLE, len(head)) + head + packed))) == [record]
    for bad in (frame[:-3], frame + b"junk", struct.pack("<II", warc.SKIPPABLE, 99) + b"x", struct.pack("<II", warc.SKIPPABLE, 4) + b"abcd"):
        with pytest.raises(warc.ArchiveError):
            list(warc._frames(io.BytesIO(bad)))


@given(st.lists(st.integers(0, 3), min_size=1, max_size=80))
@settings(max_examples=300, deadline=None)
def test_suffix_array(letters):
    x = np.array(letters, np.uint8)
    raw = x.tobytes()
    sa = suffix.suffix_array(x)
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    plcp = suffix.common_prefixes(x, sa)
    for i, j in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
        k = 0
        while max(i, j) + k < len(raw) and raw[i + k] == raw[j + k]:
            k += 1
        assert plcp[i] == k


@pytest.mark.parametrize("letters", [700, 9000, 2_000_000])
def test_many_letters_are_written_in_digits(letters):
    x = np.random.default_rng(4).integers(0, letters, 500)
    x[200:300] = x[:100]
    assert suffix.suffix_array(x, letters).tolist() == sorted(range(500), key=lambda i: x[i:].tolist())


@given(st.lists(st.integers(0, 3), min_size=1, max_size=80))
@settings(max_examples=200, deadline=None)
def test_deep_recursion(letters):
    """With tiny alphabets every level has names to write in digits."""
    x, old = np.array(letters, np.uint8), suffix.LETTERS
    try:
        suffix.LETTERS = 4
        assert suffix.suffix_array(x, 4).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tobytes())
    finally:
        suffix.LETTERS = old


def test_suffix_array_of_a_shard():
    """At a shard's size the names of the lower level far outnumber the letters, and sorting recurses."""
    rng = np.random.default_rng(9)
    words = [rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8).tobytes() for _ in range(5000)]
    raw = b" ".join(words[i] for i in rng.integers(0, 5000, 60_000))
    raw = raw[:250_000] + raw[1000:6000] + raw[100_000:]
    sa = suffix.suffix_array(np.frombuffer(raw, np.uint8))
    assert len(set(sa.tolist())) == len(raw)
    assert all(raw[i : i + 50] <= raw[j : j + 50] and (raw[i : i + 50] != raw[j : j + 50] or raw[i:] < raw[j:]) for i, j in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True))


def plain_removed(texts):
    seen, out = set(), []
    for raw in texts:
        mark = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                mark[p : p + 100] = True
            seen.add(w)
        out.append((len(raw), int(mark.sum()), int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~mark].tobytes()).hexdigest()))
    return out


def test_repeated_spans_brute_force(spark, docs_of):
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcde é") for _ in range(rng.randint(90, 400))) for _ in range(8)]
    texts = [None, "", "x" * 99, "y" * 100, "z" * 1000, "é" * 120, "ab" * 300, "y" * 100]
    for _ in range(60):
        texts.append("".join(rng.choice(["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 200))), rng.choice(passages), rng.choice(passages)[: rng.randint(1, 300)]]) for _ in range(4)))
    texts += [texts[20], texts[21] + "tail"]
    want = plain_removed([(t or "").encode() for t in texts])
    for parts in (1, 5):
        found = suffix.repeated_spans(docs_of(texts).repartition(parts)).orderBy("doc_id").collect()
        assert [tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in found] == want
    again = suffix.repeated_spans(docs_of([(5, "q" * 150), (5, "q" * 150), (None, "r" * 100), (1, "r" * 100)])).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in again) == [(-1, 0), (1, 100), (5, 149), (5, 150)]
    assert suffix.repeated_spans(docs_of(texts).limit(0)).count() == 0


def test_repeats_across_batches(spark, docs_of):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60))) + passage[rng.randint(0, 40) : rng.randint(180, 260)] + str(rng.random()) for _ in range(80)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        found = suffix.repeated_spans(docs_of(texts).repartition(9)).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in found] == plain_removed([t.encode() for t in texts])


@pytest.mark.parametrize("core", [24, 60, 93, 99])
def test_hot_grams_are_split(spark, docs_of, monkeypatch, core):
    """One gram in contexts of far more bytes than a shard takes; the same rows are removed."""
    monkeypatch.setattr(suffix, "HOT", 3000)
    rng = random.Random(core)
    say = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    phrase = "".join(rng.choice("ABCDEFGH") for _ in range(core))
    sides = [(say(80), say(80)) for _ in range(12)]
    texts = []
    for _ in range(300):
        (left, _), (_, right) = rng.choice(sides), rng.choice(sides)
        texts.append(rng.choice([say(9), left]) + phrase + rng.choice([right, say(70), right[:40] + say(20)]))
    texts += [texts[7], texts[8] + "x"]
    found = suffix.repeated_spans(docs_of(texts).repartition(7)).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in found] == plain_removed([t.encode() for t in texts])


def test_long_text_runs_cover_every_window():
    raw = np.random.default_rng(6).integers(97, 100, 700_000).astype(np.uint8).tobytes()
    h, start, n = suffix.runs(raw)
    assert int(n.sum()) == len(raw) - 99 and start[0] == 0 and ((start + n)[:-1] == start[1:]).all()


def text_of(html):
    return " ".join(t for t, k in htmltext.page_lines(html) if k == htmltext.ARTICLE)


def test_article_text():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="site">Site</header>
    <nav><a href="/">Menu</a></nav><div class="ad">Buy</div><main><article><header><h1>Head &amp; more</h1><span>by me</span></header><p><b>Bold<br>line<p>a<i>b</i>c&nbsp; d
    <aside>Side</aside><form><p>Form</form><ul><li>One<li>Two</ul><div class="cookie-notice">Notice</div><div id="comments"><article>Comment</article></div><p hidden>no</p>End</article></main>
    <footer>&copy; F</footer></body></html>"""
    assert text_of(html) == "Head & more Bold line abc d One Two End"
    assert htmltext.page_lines(None) == htmltext.page_lines("") == [] and text_of("<article>") == ""


def test_names_are_whole_tokens_and_unclosed_elements_end():
    assert text_of('<div class="layout has-sidebar"><article><p>Kept</article></div>') == "Kept"
    assert text_of('<article class="post share-enabled"><p>Kept</article>') == "Kept"
    assert text_of('<article><p class="notice-board">Board</p>Kept</article>') == "Board Kept"
    assert text_of('<article><p class="share">gone<p>Kept<p>too</article>') == "Kept too"
    assert text_of('<article><p><span class="ad">gone<p>Kept</article>') == "Kept"
    assert text_of('<article>A<ul><li class="share">gone<li>Kept</ul>too</article>') == "A Kept too"
    assert text_of('<div class="sidebar"><article>Kept</article></div>') == "Kept"
    assert text_of('<div class="sidebar"><article>Teaser</article></div><article>Kept</article>') == "Kept"
    assert text_of('<article>Kept</article><div id="comments"><article>Comment</article></div>') == "Kept"
    assert text_of('<article><header class="header"><h1>Head</h1><p>by me</header><div class="ad-container sidebar-left">gone</div>Kept</article>') == "Head Kept"


def test_shared_lines_is_longest():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = sorted(htmltext.shared_lines(a, b))
        it = iter(b)
        assert len(found) == table[-1][-1] and all(a[i] in it for i in found)


def test_page_differencing(spark):
    frame = "<div>Shop name</div><div>{}</div><div>All rights</div>"
    rows = [(i, f"https://www.h.org/en/{10 + i}?q=1", frame.format(f"Story {i}")) for i in range(4)]
    rows += [(10, "http://alone.org/x", frame.format("Only")), (11, None, None), (12, "http://h.org/en/99", "<article>Known <p>text</article><div>Shop name</div>"), (None, "http://h.org/en/3", "<p>No id</p>"), (0, "https://www.h.org/en/10?q=1", frame.format("Story 0"))]
    found = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract(pages_of(spark, rows)).collect()), key=str)
    want = [(0, "Story 0", 7), (0, "Story 0", 7), (1, "Story 1", 7), (10, "Shop name Only All rights", 25), (11, "", 0), (12, "Known text", 10), (2, "Story 2", 7), (3, "Story 3", 7), (None, "No id", 5)]
    assert found == want
    assert htmltext.extract(pages_of(spark, rows).limit(0)).count() == 0


def test_copies_of_a_page_keep_its_text(spark):
    frame = "<div>Shop name</div><div>{}</div><div>All rights</div>"
    story = frame.format("A long story that was captured more than once, word for word the same")
    rows = [(1, "http://www.h.org/a/1", story), (2, "http://m.h.org/a/1?page=2", story), (3, "https://h.org/a/1#top", story), (4, "http://h.org/a/1/print", story)]
    alone = {r["page_id"]: r["text"] for r in htmltext.extract(pages_of(spark, rows)).collect()}
    whole = "Shop name A long story that was captured more than once, word for word the same All rights"
    assert alone == {i: whole for i in (1, 2, 3, 4)}  # no other page tells the frame
    rows += [(5, "http://h.org/z/other", frame.format("Another story")), (6, "http://h.org/z/other?x", frame.format("Another story"))]
    found = {r["page_id"]: r["text"] for r in htmltext.extract(pages_of(spark, rows)).collect()}
    assert found == {i: whole[10:-11] for i in (1, 2, 3, 4)} | {5: "Another story", 6: "Another story"}


@given(st.lists(st.integers(0, 65535), max_size=300), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_coder_round_trip(ids, repeat):
    ids = np.array(ids * repeat, np.uint32)
    data = b"".join(rangecoder.encode_section(ids, [1, None], [len(ids), 0]))
    docs, lengths, chunks = section_of(io.BytesIO(data))
    assert docs == [1, None] and lengths == [len(ids), 0] and np.concatenate([np.zeros(0, "<u4"), *chunks]).tolist() == ids.tolist()


def section_of(f):
    return next(rangecoder.sections(f))


def test_files_of_several_sections():
    parts = [(np.arange(50, dtype=np.uint32), [1, 2], [20, 30]), (np.arange(7, dtype=np.uint32), [None], [7])]
    data = b"".join(b"".join(rangecoder.encode_section(*p)) for p in parts)
    found = [(d, n, np.concatenate(list(c)).tolist()) for d, n, c in rangecoder.sections(io.BytesIO(data))]
    assert found == [(d, n, ids.tolist()) for ids, d, n in parts]
    for bad in (b"", data + b"x", data[:-1], b"LQTOKEN2" + data[8:]):
        with pytest.raises(ValueError):
            [list(c) for _, _, c in rangecoder.sections(io.BytesIO(bad))]
    assert rangecoder.checked(np.array([65_535], np.uint32)).tolist() == [65_535]
    with pytest.raises(ValueError):
        rangecoder.checked(np.array([1, 65_536], np.uint32))


def test_coder_blocks_compress_and_check(monkeypatch):
    monkeypatch.setattr(rangecoder, "BLOCK", 100)
    monkeypatch.setattr(rangecoder, "LANES", 3)
    ids = np.tile(np.arange(40, dtype=np.uint32), 30)
    data = b"".join(rangecoder.encode_section(ids, [1], [1200]))
    assert np.concatenate(list(section_of(io.BytesIO(data))[2])).tolist() == ids.tolist()
    assert len(data) < 2 * len(ids)
    for at in (3, 30, len(data) - 5):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(section_of(io.BytesIO(bytes(broken)))[2])
    with pytest.raises(ValueError):
        list(section_of(io.BytesIO(data[:-1]))[2])
    with pytest.raises(ValueError):
        b"".join(rangecoder.encode_section(np.array([70_000], np.uint32), [1], [1]))


def test_token_files(spark, docs_of):
    from tokenizers import Tokenizer

    path = _vocabulary("word_bpe_49k.json")
    texts = ["Hello there", None, "", "É<|endoftext|> x", "word " * 9000, "Hello there"]
    docs = docs_of([*enumerate(texts), (None, "first")]).repartition(3)
    found = tokenfile.round_trip(docs, shared_dir(spark), path, with_ids=True).collect()
    tokenizer, start = Tokenizer.from_file(path), 0
    for (i, t), r in zip([(None, "first"), *enumerate(texts)], sorted(found, key=lambda r: r["start"]), strict=True):
        ids = [*(tokenizer.encode(t, add_special_tokens=False).ids if t else []), 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], list(r["ids"])) == (i, start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert tokenfile.round_trip(docs.limit(0), shared_dir(spark), path).count() == 0


def test_slices():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 50, 5, 5, 500, 1)] + [None]})
    got = [s.column("text").to_pylist() for s in in_slices(iter([batch]), "text", 60)]
    assert [len(s) for s in got] == [3, 1, 1, 2] and sum(got, []) == batch.column("text").to_pylist()


def test_small_waves_of_induced_sorting_take_no_array_steps(monkeypatch):
    """Most waves hold a few positions; those are placed one by one, and the order is that of the suffixes."""
    rng, steps, count = random.Random(8), [], np.bincount
    text = "".join(rng.choice(["the ", "of ", "a", "b", "passage ", "c d "]) for _ in range(2000)).encode()
    monkeypatch.setattr(np, "bincount", lambda *a, **k: steps.append(1) or count(*a, **k))
    found = suffix.suffix_array(np.frombuffer(text, np.uint8))
    assert found.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    assert len(steps) < 300


def test_tasks_code_in_java_to_the_same_bytes(spark, tmp_path, monkeypatch):
    """Spark's tasks never step through array operations; their files are those of the Python coder, and damage shows."""
    rng = np.random.default_rng(4)
    blocks = [rng.integers(0, 65_536, 4096), rng.zipf(1.3, 4096) % 50_000, np.zeros(4000, int), np.full(300, 65_535), rng.integers(0, 40, 77), np.array([5])]
    blocks = [b.astype("<u2") for b in blocks]
    payloads = rangecoder.encode_blocks(np.concatenate(blocks).astype("<u4"), [len(b) for b in blocks])
    code, back = (compiled.function(spark, "RangeCoder.java", f"RangeCoder${x}", "binary") for x in ("Encode", "Decode"))
    rows = spark.createDataFrame([(i, len(b), bytearray(b.tobytes())) for i, b in enumerate(blocks)], "i int, n int, ids binary").repartition(2)
    found = rows.withColumn("p", F.call_function(code, "ids")).withColumn("back", F.call_function(back, "p", "n")).collect()
    assert {r["i"]: bytes(r["p"]) for r in found} == dict(enumerate(payloads)) and all(r["back"] == r["ids"] for r in found)
    assert spark.createDataFrame([(bytearray(rng.bytes(50)), 4096)], "p binary, n int").select(F.length(F.call_function(back, "p", "n"))).first()[0] == 8192

    folder = f"file://{tmp_path}/files"
    docs = spark.createDataFrame([(i, " ".join(["some words"] * 30 * i)) for i in range(200)], "doc_id long, text string")
    listing = [tuple(r) for r in tokenfile.write_files(docs, folder, _vocabulary("word_bpe_49k.json")).select("part", "path", "n_ids").collect()]
    path = listing[0][1]
    with open(path, "rb") as f:
        data = f.read()
    ids = np.concatenate([x for _, _, c in rangecoder.sections(io.BytesIO(data)) for x in c])
    assert len(ids) == listing[0][2]
    with open(path, "wb") as f:
        f.write(data[:-60] + bytes([data[-60] ^ 1]) + data[-59:])
    with pytest.raises(Exception, match="checksum"):
        tokenfile.read_files(spark, folder, listing).collect()


def test_shards_in_java_find_what_arrays_find(spark, monkeypatch):
    """Runs of the array form and of brute force, for deep recursions too; no task takes array steps for a suffix array."""
    rng, cases = random.Random(9), []
    say = lambda letters, n: bytes(rng.choice(letters) for _ in range(n))
    fib = [b"a", b"ab"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    for letters, most in ((b"a", 40), (b"ab", 60), (b"ab", 400), (bytes(range(256)), 200), (b"abc", 3000)):
        for length in (1, 2, 5, 12):
            passage = say(letters, most)
            segments = [rng.choice([say(letters, rng.randint(0, most)), passage[rng.randint(0, most) :], fib[-1][rng.randint(0, 50) :]]) for _ in range(rng.randint(1, 12))]
            segments = [x + say(letters, length) for x in segments]
            cases.append((length, [max(0, len(x) - length + 1 - rng.randint(0, 2)) for x in segments], segments))
    little = lambda x: bytearray(np.array(x, "<i4").tobytes())
    rows = [(i, little([len(x) for x in s]), little(w), bytearray(b"".join(s)), n) for i, (n, w, s) in enumerate(cases)]
    code = compiled.function(spark, "SuffixRepeats.java", "SuffixRepeats", "binary")
    table = spark.createDataFrame(rows, "i int, sizes binary, windows binary, segments binary, length int")
    found = {r["i"]: np.frombuffer(r["f"], "<i4").reshape(-1, 3).tolist() for r in table.select("i", F.call_function(code, "sizes", "windows", "segments", "length").alias("f")).collect()}
    for i, (length, windows, segments) in enumerate(cases):
        seen, want = set(), []
        for k, (x, n) in enumerate(zip(segments, windows, strict=True)):
            for at in range(n):
                w = x[at : at + length]
                if w in seen and want and want[-1][0] == k and want[-1][2] == at - 1:
                    want[-1][2] = at
                elif w in seen:
                    want.append([k, at, at])
                seen.add(w)
        assert found[i] == want == [list(r) for r in suffix.repeats(segments, windows, length)]

    def fail(*_):
        raise AssertionError

    monkeypatch.setattr(suffix, "suffix_array", fail)
    batch = suffix._batch(suffix._SEGMENT, [[7, 7], [0, 0], [0, 0], [1, 2], [0, 0], [0, 5], [1, 1], [False] * 2, [0, 0], [24, 24], [b"x" * 100] * 2])
    shard = next(suffix._shards(iter([batch])))
    assert shard.column("start").to_pylist() == [[0, 5]] and shard.column("segments").to_pylist() == [b"x" * 200]
