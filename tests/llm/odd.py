"""Documents with what operators must bear: nulls, empty and long texts, ties, clashes."""

LONG = " ".join(f"word{i % 977} and{i % 7}" for i in range(20_000))
ROWS = [
    (1, "The same line of text\nAnother line that is long\n", "en", "a"),
    (2, "the same line of text  \nshort\nsomething else entirely", "en", "b"),
    (3, None, None, None),
    (4, "", "fr", "a"),
    (None, "The same line of text\nno id here at all", "en", None),
    (None, None, "xx", "b"),
    (5, LONG, "en", "b"),
    (6, "  \n\t\n \r\n", "de", "c"),
    (7, "naïve ÉCOLE ßtraße 日本語テキスト\u2003wide space", "fr", "c"),
    (8, "The same line of text\nAnother line that is long\n", "en", "a"),
    (8, "The same line of text\nAnother line that is long\n", "en", "a"),
    (-9, "one two", "es", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use themselves, or prefix.
CLASHES = (
    "size shard slot fp key row words n_words kept position taken part component_id _id __id "
    "path host rule ids target n drops text_crc32"
).split()


def documents(spark, rows=ROWS):
    """The rows with a column for each clashing name."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
