import pytest


@pytest.fixture(scope="module")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) tuples, with columns that clash with internal names."""

    def build(rows):
        rows = [(*r, None)[:3] for r in rows]
        wide = [(i, t, s, "x", 1, 2) for i, t, s in rows]
        schema = "doc_id long, text string, source string, bucket string, digest int, row_number long"
        return spark.createDataFrame(wide, schema).repartition(3)

    return build
