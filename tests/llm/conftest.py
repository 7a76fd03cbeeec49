import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with columns that clash with names the operators use."""

    def of(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            for name in ("score", "node", "key", "piece", "length", "row", "word", "ref", "part", "label"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return of


ODD = [(None, None), (None, "a b"), (1, None), (2, ""), (3, " \n\t"), (4, "x"), (4, "x"), (5, "é " * 40_000), (6, "the the the the the the the the the")]


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and very long texts, repeated rows."""
    return make(ODD)
