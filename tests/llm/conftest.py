import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_words", T.StringType()),
    T.StructField("place", T.IntegerType()), T.StructField("kept", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names operators use themselves."""
    def make(rows):
        full = [(i, t, lang, source, len(t) if t is not None else None, "extra", 7, "extra") for i, t, lang, source in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, blank and long texts, ties and repeated rows."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    return make_docs([
        (1, words, "en", "a"), (1, words, "en", "a"), (2, words, None, None), (3, None, "en", "a"), (4, "", "en", "b"),
        (None, words + " nu", "de", "b"), (None, None, None, None), (5, " \t\n\x0b\x0c\r ", "en", "a"),
        (6, "x " * 40_000, "fr", "a"), (7, "y" * 60_000, "fr", "b"), (8, "é ü 漢字   \U0001f600 'tis we'll", "de", "b"),
        (9, "\n".join([words] * 30), "en", "c")])
