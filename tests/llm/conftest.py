import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def doc_rows(items):
    """(doc_id, text[, source[, lang]]) -> documents rows."""
    out = []
    for it in items:
        i, t, *rest = it
        source = rest[0] if rest else "s"
        lang = rest[1] if len(rest) > 1 else "en"
        out.append((i, t, lang, source, None if t is None else len(t)))
    return out


@pytest.fixture()
def make_docs(spark):
    def make(items):
        return spark.createDataFrame(doc_rows(items), DOC_SCHEMA)
    return make
