import pytest
from pyspark.sql import types as T


@pytest.fixture
def docs(spark):
    """Documents with whatever columns a test adds; an extra column clashes with names that operators use inside."""

    def make(texts, keys=None, **more):
        keys = range(len(texts)) if keys is None else keys
        fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                  T.StructField("ids", T.StringType()), *[T.StructField(c, T.StringType()) for c in more]]
        rows = [(k, t, None, "x", *v) for k, t, *v in zip(keys, texts, *more.values())]
        return spark.createDataFrame(rows, T.StructType(fields))

    return make
