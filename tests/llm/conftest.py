import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A table of rows; documents get columns whose names clash with what the operators use inside."""

    def make(rows, schema):
        df = spark.createDataFrame(rows, schema)
        return df.selectExpr("*", "1 AS score", "'x' AS fp", "2 AS row", "3 AS cid", "'y' AS component_id", "4 AS _id", "5 AS hashes", "'z' AS spans")

    return make


@pytest.fixture(scope="session")
def documents(frame):
    return lambda rows: frame(rows, "doc_id long, text string, lang string, source string, n_chars long")


#: Texts that every operator must take: (doc_id, text).
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "word " * 20_000), (5, "x" * 50_000), (6, "a"), (7, "a"), (None, "null id"), (8, "é🙂 漢字 ́"), (9, "1 " * 5000), (9, "1 " * 5000), (10, "()[]{}|\\^$.*+?<|%&")]


@pytest.fixture(scope="session")
def odd():
    return [(i, t, None, None, None) for i, t in ODD]
