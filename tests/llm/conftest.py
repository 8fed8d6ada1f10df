import pytest


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with more columns whose names operators use themselves."""
    def make(rows):
        extra = "id long, key long, node string, score string, spans int, n int, size int, rest int, starts int"
        return spark.createDataFrame([(d, t, None, 7, "x", None, 3, None, 5, 1, 2) for d, t in rows],
                                     f"doc_id long, text string, {extra}")
    return make
