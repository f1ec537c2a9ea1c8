import pytest

ODD = [(1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", "en", "s"), (4, "one", "en", None), (4, "one", "en", None), (5, "é😀 ß " * 3000, "de", "s")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, repeated and long texts, with columns named like results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    for c in ("score", "n_tokens", "ids", "kept", "spans", "prefix", "n_words"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
