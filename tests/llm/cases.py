"""Awkward documents that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, `end` string, key string, shard long"


def documents(spark, rows, partitions=3):
    """rows: (doc_id, text, lang, source); further columns have names that operators use inside."""
    full = [(d, t, g, s, None if t is None else len(t), 7, "x", "y", "z", 9) for d, t, g, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def awkward():
    long = " ".join(f"Word{k % 977} runs" for k in range(30_000))
    return [
        (1, "The quick brown fox jumps over the lazy dog and runs.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \n\t ", "de", "b"),
        (5, long, "en", "b"),
        (None, "A text without an id stands here for good.", "en", None),
        (7, "The same row twice, word for word, line for line.", "en", "a"),
        (7, "The same row twice, word for word, line for line.", "en", "a"),
        (8, "日本語のテキスト 😀 ''' -- %%%   \x00 é", None, "c"),
        (9, "12345 67890 !!!", "fr", "c"),
        (10, "one", "fr", ""),
    ]
