import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of texts; ids count from 0 unless (id, text) pairs are given. It has columns whose names clash with operators' own."""

    def make(texts):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", f"s{n % 3}", len(t or "")) for n, (i, t) in enumerate(rows)], DOCS)
        return df.selectExpr("*", "'x' as size", "7 as n_words", "1.5 as score", "'k' as key", "doc_id as id", "0 as cls", "'p' as print", "'q' as _id")

    return make
