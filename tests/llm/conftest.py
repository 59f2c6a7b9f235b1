import pytest
from pyspark.sql import types as T

#: Columns whose names an operator might use itself, in every fixture.
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("row", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("shard", T.LongType()),
        T.StructField("words", T.StringType()),
        T.StructField("n_words", T.StringType()),
    ]
)


@pytest.fixture
def docs(spark):
    """Documents of (doc_id, text), in several partitions, with columns of clashing names."""

    def make(*rows, lang=None):
        full = [
            (i, t, lang(i) if lang else "en", "src", None if t is None else len(t), "r", 1, 2, "w", "n") for i, t in rows
        ]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


def odd_texts():
    """Null, empty, white space, long, repeated and unusual texts."""
    prose = "The quick brown fox jumps over the lazy dog and runs away from it. " * 4
    return [
        (0, prose),
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "word"),
        (5, "Äpfel, ÖL und Straße… 漢字 テスト naïve é <|endoftext|> it's 12,5 %"),
        (6, prose),
        (7, "x " * 30_000),
        (8, "A\u0000b\x1cc\r\nd\x85e"),
        (8, "A\u0000b\x1cc\r\nd\x85e"),
        (9, prose[:100] + "other " + prose[100:]),
        (None, "no id"),
    ]
