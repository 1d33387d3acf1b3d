import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"

#: documents plus columns whose names the operators also use inside
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in ("row", "r1", "key", "fp", "hash", "score", "size", "id", "label", "batch", "doc")]])


@pytest.fixture()
def docs(spark):
    """Builds a documents frame with clashing extra columns from (doc_id, text[, source]) rows."""
    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), *["x"] * 11) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return build


@pytest.fixture()
def awkward(docs):
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 97}" for i in range(20000))
    return docs([(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "one two three four"), (5, "one two three four"),
                 (6, "one two three four"), (None, "no id at all"), (None, None), (7, "Line A\nline b\n\nLINE A "), (8, "x", None)])
