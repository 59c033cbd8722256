"""Documents with everything that is awkward, shared by the tests."""

LONG = " ".join(f"term{i % 4999}x{i}" for i in range(40_000))


def odd_documents(spark):
    rows = [
        (1, None, "en", None, None),
        (2, "", None, "a", 0),
        (3, "One two  three", "en", "a", 14),
        (3, "One two  three", "en", "a", 14),
        (10, "one TWO three", "en", "b", 13),
        (11, LONG, "en", "c", len(LONG)),
        (12, LONG, "en", "c", len(LONG)),
        (None, "a text without an id " * 10, "en", None, 0),
        (13, " \t\n", "en", "", 3),
        (14, "naïve ſtraße 東京 " * 30, "de", "b", 0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
