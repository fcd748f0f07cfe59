import pytest
from llm_texts import prose
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows):
        full = [(i, t, *(rest or ("en", "s", None if t is None else len(t)))) for i, t, *rest in rows]
        return spark.createDataFrame(full, DOCS)

    return docs


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and long texts, repeated rows and ids."""
    long_one = prose(9000, 5) + " " + "x" * 30000 + " " + "1" * 20000
    rows = [
        (None, None, None, None, None), (None, "some words here", None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", "a", 4), (3, long_one, "en", "a", None), (4, prose(60, 1), "en", "b", None), (4, prose(60, 1), "en", "b", None),
        (5, prose(60, 1), "de", None, None), (6, "mail me a.b@c.de or +1 (202) 555-0199", "fr", "c", None), (7, " a@b.c 1.2.3.4", "fr", "c", None),
    ]
    return make(rows)
