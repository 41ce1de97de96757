"""Documents with the awkward cases that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


def awkward(spark, extra=()):
    """Null and empty texts, a null doc_id, repeated rows, equal texts, a very long text, odd white space."""
    texts = [
        (1, "one two three four five six seven eight nine ten\neleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo"),
        (2, "one two three four five six seven eight nine ten\neleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo"),
        (3, None), (4, ""), (5, " \n\t "), (6, "short"), (6, "short"), (7, LONG), (8, LONG), (9, "Ünï cødé  日本語 x 🙂\n\n  it's 's\x00 z "),
        (None, "nobody's text is here"), (10, None), *extra,
    ]
    return spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in texts], SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
