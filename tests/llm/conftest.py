import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SPACES = " \t\n\x0b\x0c\r"


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text) if text is not None else None)


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        doc(1, None), doc(2, ""), doc(3, " \t\n "), doc(4, "One two"), doc(5, "one TWO"), doc(6, base), doc(7, base), doc(7, base), doc(8, base + " x"), doc(9, "z " * 30000, None, None),
        (10, "the quick brown fox and the lazy dog of the house", None, "b", None), doc(11, "a\n\nshared line\n", "de", "b"), (None, "no id here at all", "fr", "c", 3), doc(12, "É é 12345 | # % <s>␛e [INST]", "es", "c"),
    ] + [doc(20 + i, f"shared line\nown {i}\n  SHARED line \r", "en", "d") for i in range(10)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
