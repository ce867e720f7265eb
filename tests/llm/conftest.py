from __future__ import annotations

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def documents(spark):
    """Builds documents with extra columns whose names operators might use themselves."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, mark int, fp string, row int, name string, kept int"

    def build(rows):
        full = [(*row, *[None] * (3 - len(row)))[:3] if len(row) < 4 else row[:4] for row in rows]
        return spark.createDataFrame([(*(r + (None,) * 4)[:4], None, 1, "x", 2, "y", 3) for r in full], schema)

    return build


@pytest.fixture(scope="session")
def vectors(spark):
    kind = T.StructType(
        [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]
    )
    return lambda rows: spark.createDataFrame([(i, v, None) for i, v in rows], kind)
