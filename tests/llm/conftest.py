import pytest
from pyspark.sql import types as T

from balancebeam.llm.common import workers_import

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("id", T.StringType()), T.StructField("rejected", T.StringType())])


@pytest.fixture(autouse=True)
def importable(spark):
    workers_import(spark)


@pytest.fixture
def docs(spark):
    """Documents with columns whose names clash with those of the operators."""

    def make(rows):
        return spark.createDataFrame([(i, t, l, "s", 0, "x", "y", "z") for i, t, l in rows], DOCS)

    return make


ODD = [(1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "12 34 !!", None), (None, "no id here", "en"), (5, "twice", "en"), (5, "twice", "en"), (6, "a\n\n b,  c.\r\n'll x's", "en"), (7, "wort " * 30000, "de"), (8, "x" * 60000, "de"), (9, "é漢😀\u200b \u00a0end", "fr")]
