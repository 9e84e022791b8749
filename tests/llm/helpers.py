"""Rows that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    width = len(schema.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = words(1, 6000)
    return [
        (0, long, "en", "a", 1),
        (1, None, "en", "a", 0),
        (2, "", None, None, None),
        (3, " \t\n ", "en", "b", 3),
        (4, "One two Three four five", "en", "b", 9),
        (5, long + " tail", "en", None, 5),
        (5, long + " tail", "en", None, 5),
        (6, words(2, 300), "de", "c", 1),
        (7, words(2, 300), "de", "c", 1),
        (8, "é" * 1200, "fr", "c", 1),
        (None, words(3, 50), "fr", "c", 1),
    ]
