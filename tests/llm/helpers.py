"""Small tables with the awkward rows that every operator has to bear."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label int"


def docs(spark, texts, first_id=0):
    rows = [(first_id + i, t, "en", "s", len(t or ""), 0.5, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Null text, null id, null everything, empty, blank, very long, ties and repeated rows, in a table with clashing columns."""
    long = "Anblewh sttible the of été 2024 " * 6000
    rows = [
        (1, None, "en", "s", 0, 0.1, 0),
        (2, "", None, None, None, None, None),
        (3, " \t\n ", "en", "s", 4, 0.1, 0),
        (4, long, "en", "s", len(long), 0.1, 0),
        (5, "the same text of both", "en", "s", 21, 0.1, 0),
        (6, "the same text of both", "en", "s", 21, 0.1, 0),
        (6, "the same text of both", "en", "s", 21, 0.1, 0),
        (None, "a text without an id", "en", "s", 20, 0.1, 0),
        (None, None, None, None, None, None, None),
        (9, "İstanbul ﬁne ẞ \U0001f600 ź ​ end", "de", "s", 20, 0.1, 0),
    ]
    return spark.createDataFrame(rows, DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)
