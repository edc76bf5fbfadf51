"""Odd inputs shared by the tests: nulls, empty and long texts, repeats, clashing columns, empty tables."""

import re

LONG = "alpha beta gamma delta " * 20_000
ROWS = [
    (None, "the null id has a text of its own here", "a"), (1, None, None), (2, "", "b"), (3, LONG, "c"),
    (4, "One, two; three four five six seven eight nine ten!", "d"), (4, "One, two; three four five six seven eight nine ten!", "d"),
    (5, "one two three FOUR five six seven eight nine ten", "e"), (6, "...!!!", "f"), (7, "...!!!", "g"), (8, "Ünïcödé wörds — and 漢字", "h"),
]
NAMES = ("key", "n", "score", "size", "row", "c0", "c1", "found", "_found", "bucket", "kept", "range", "ids", "starts", "label")


def odd(spark):
    """The rows above with many columns whose names the operators use themselves."""
    kind = "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([r + NAMES for r in ROWS], kind).repartition(3)


def none(spark):
    return odd(spark).where("1 = 0")


def words(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
