import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("n_words", StringType()), StructField("row", StringType()), StructField("key", LongType())])


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with further columns named like results."""
    return lambda rows: spark.createDataFrame([(i, t, "x", None, 7) for i, t in rows], DOCS).repartition(3)


@pytest.fixture
def odd():
    """Nulls, empty, very long and repeated texts."""
    return [(None, "a text without an id"), (1, None), (2, ""), (3, " \n\t"), (4, "word " * 30_000), (5, "é漢字 ß"), (5, "é漢字 ß"), (6, "x" * 200_000), (7, "one"), (8, "***")]
