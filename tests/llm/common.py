"""Small inputs that every operator must bear."""

LONG = " ".join(f"w{i % 977}" for i in range(30_000)) + " é€😀 \x1c end"
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (3, ""),
    (4, None),
    (None, "a text without an id"),
    (5, LONG),
    (6, "  two  spaces\n\nand\ttabs … “quotes” 12² it's\u00a0here\u3000x "),
    (7, "你好世界 😀😀 ñandú"),
    (8, " "),
    (9, "x"),
]


def documents(spark, rows=TEXTS, extra=True):
    """doc_id and text, and columns whose names operators would like to use themselves."""
    full = [(i, t, "en", "s", len(t or ""), 7, "n", None, 0.5, "p") for i, t in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, ids int, N_TOKENS string, digest binary, score double, medium string")
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def texts_by_row(rows=TEXTS):
    return sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
