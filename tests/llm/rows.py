"""Small document tables with nulls, ties, repeats, empty and long texts and
extra columns whose names operators use themselves."""

from __future__ import annotations

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
SAID = "the quick brown fox jumps over the lazy dog and runs along the old river bank until night falls on the small town where people sleep"

ODD = [
    (9001, None, "en", "a", 0),
    (9002, "", "en", "a", 0),
    (9003, " \t\n \r\n ", "de", "a", 8),
    (9004, "word", None, None, 4),
    (None, SAID, "en", "b", 10),
    (None, None, None, None, None),
    (9005, SAID, "en", "b", 10),
    (9005, SAID, "en", "b", 10),
    (9006, SAID + " " + SAID, "en", "b", 10),
    (9006, "another text under the same id", "en", "b", 10),
    (9007, LONG, "en", "b", len(LONG)),
    (9008, LONG, "en", None, len(LONG)),
    (9009, "a b   ünï 漢字 \U0001f600 é", "fr", "c", 9),
    (9010, "x" * 300_000, "en", "c", 300_000),
    (9011, "same line here now\n" * 40, "en", "c", 9),
]

CLASHES = ("doc", "sub", "k", "a", "b", "h", "fp", "id", "words", "w", "spans", "size", "slot", "shard", "target", "taken", "root", "node", "_d", "_i", "_times", "_ratios", "yes", "n", "_k", "_n", "_row", "_h", "_tie", "_b1", "_b2")


def documents(spark, rows, schema=COLUMNS):
    return spark.createDataFrame(rows, schema)


def odd_documents(spark):
    from pyspark.sql import functions as F

    return documents(spark, ODD).withColumns({c: F.lit("clash") for c in CLASHES})
