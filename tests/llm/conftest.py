import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, or from (doc_id, text) pairs, with all columns of the table."""

    def make(rows, **more):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in pairs], DOCS)
        from pyspark.sql import functions as F

        for name, value in more.items():
            df = df.withColumn(name, F.lit(value))
        return df

    return make
