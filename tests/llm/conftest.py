from __future__ import annotations

import pytest
from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType

DOCUMENTS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
    ]
)

EDGE_TEXTS = [
    None, "", " ", "\n\n", "one", "two words", "The same text stands here, twice.",
    "The same text stands here, twice.", "É ñ İ ß 日本語 🎉 a\tb\x0bc\x1cd", "a  b \n c ",
    "<|endoftext|> is only text", "don't we'll it's 12345 !!!", "ha " * 3000,
    "long " + "x" * 3000 + " end",
]


@pytest.fixture(scope="session")
def edge_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with awkward names."""
    rows = [(i, text, "en", f"s{i % 3}", len(text or "")) for i, text in enumerate(EDGE_TEXTS)]
    rows += [rows[6], rows[6], (None, "no id at all, but a text.", None, None, None), (None,) * 5]
    extra = "row size target fp root tie id part at words lines hits numbers bucket number copies rate".split()
    df = spark.createDataFrame(rows, DOCUMENTS)
    for name in extra:
        df = df.withColumn(name, df["source"])
    return df


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def vectors_schema():
    return StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType()))])
