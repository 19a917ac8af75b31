import pytest
from pyspark.sql import functions as F

from usagelens.llm.common import importable


@pytest.fixture(autouse=True)
def small_session(spark):
    """Workers that can import the package, and few partitions for the few rows of these tests."""
    importable(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text, lang, source), with further columns whose names clash with the operators' own."""

    def make(rows):
        rows = [(*row, *(None,) * (4 - len(row))) for row in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        clashes = ["id", "key", "class", "size", "rank", "draw", "n", "a", "b", "score", "start", "length", "kept", "label", "value"]
        return df.withColumns({c: F.lit("clash") for c in clashes})

    return make
