import pytest
from pyspark.sql import types as T


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) as a table with the columns of documents and one that clashes with computed names."""

    def make(rows, **extra):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        for name, value in extra.items():
            schema.add(name, T.StringType())
            full = [(*r, value) for r in full]
        return spark.createDataFrame(full, schema)

    return make


#: Nulls, empty and blank texts, repeated rows, ties, one very long text and odd characters.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one"), (None, "no id"), (None, None), (6, "née  Ünï   漢字 😀 é\x00 end"), (7, "word " * 60_000), (8, "x" * 70_000), (9, "a. b! c?\n\nd\n"),
]
