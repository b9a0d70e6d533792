import pytest
from pyspark.sql import types as t


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (doc_id, text) rows, with a column that no operator needs."""

    def make(rows):
        schema = t.StructType([t.StructField("doc_id", t.LongType()), t.StructField("text", t.StringType()), t.StructField("score", t.StringType())])
        return spark.createDataFrame([(i, x, "extra") for i, x in rows], schema)

    return make
