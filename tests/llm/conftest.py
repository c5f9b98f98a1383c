import pytest

#: Columns that clash with names the operators use inside.
CLASHES = {"fp": "x", "key": "y", "rep": "z", "start": "1", "n": "2", "h": "3"}


@pytest.fixture
def docs_of(spark):
    """A documents table from texts (ids in order) or (id, text) rows, with clashing columns."""
    from pyspark.sql import functions as F

    def make(rows, lang="en", source="src0"):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()})

    return make
