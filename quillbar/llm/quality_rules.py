"""Quality rules: hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and word pairs are hashed into 2 ** ``bits`` buckets. Two multinomials with
add-one smoothing are counted: one over trusted documents (quality 1, not toxic; the
``trusted`` of them with the lowest hashes, a bounded sample of labelled rows, less
every ``HOLD``-th, which is held out) and one over all documents. A document's score
is the mean of log(target / raw) over its words and pairs; it is kept if the score
reaches a threshold below the scores of the held-out documents: their 0.5 %
quantile less half its distance from the median. (Documents that the target was
counted on score higher than new ones as good; so the held-out ones set it. Without
any, the others do.) All are exact, so reruns agree.

Null text: no words, zero counts, fails the base rules. No labels: no target, so
the ratio is constant and only the base rules decide. Repeated rows each have
their own result, the same for equal texts. Other columns are left alone.

The ratios are a fixed number of floats (one per bucket), so a document is scored
where it is read: no row per word is joined or shuffled, and long texts cost no
more memory than their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, trusted_ids


#: One in so many trusted documents is held out of the target counts.
HOLD = 4


def with_words(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, words, w (the 64-bit hashes of the words) and ``more`` columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = documents.select("doc_id", text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"), *more)
    return words.withColumn("w", F.transform("words", lambda x: F.xxhash64(x)))


def base_rules(df: DataFrame, *more: Column) -> DataFrame:
    """doc_id, n_words, the four base counts and ``more`` of with_words() rows."""
    w = F.col("w")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    three = F.transform(F.slice(w, 1, F.greatest(F.lit(0), F.size(w) - 2)), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    df = df.select(
        "doc_id",
        *more,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        three.alias("three"),
    )
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    # windows that occur twice: neighbours in sorted order; then their places, in order
    again = F.size(F.array_distinct("three")) < F.size("three")
    df = df.withColumn("sorted", F.when(again, F.sort_array(F.transform("three", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.expr("cast(array() as array<struct<h: bigint, i: int>>)"))).drop("three")
    s = F.col("sorted")
    equal = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    df = df.withColumn("places", F.sort_array(F.transform(F.filter(s, lambda x, j: equal(x, j + 1) | ((j > 0) & equal(x, F.greatest(j - 1, F.lit(0))))), lambda x: x["i"]))).drop("sorted")
    p = F.col("places")
    covered = F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.get(p, j + 1) - x)), F.lit(0), lambda t, x: t + x)
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("places")


def hashes() -> Column:
    """Of the words and the word pairs."""
    w = F.col("w")
    pairs = F.transform(F.slice(w, 1, F.greatest(F.lit(0), F.size(w) - 1)), lambda x, i: F.xxhash64(x, F.get(w, i + 1)))
    return F.concat(w, pairs)


def bucket(h: Column, bits: int) -> Column:
    """The highest ``bits`` of a hash."""
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def log_ratios(documents: DataFrame, sample: DataFrame, bits: int) -> DataFrame:
    """One row: ``ratios``, the log ratio of every bucket as a float, by number."""
    buckets = 1 << bits
    marked = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left")  # at most ``trusted`` rows
    known = with_words(marked, "yes").select("yes", F.explode(hashes()).alias("h")).select("yes", bucket(F.col("h"), bits).alias("b"))
    counts = cut(known.groupBy("b").agg(F.count("*").alias("raw"), F.sum(F.coalesce("yes", F.lit(0))).alias("target")))
    raw, target = counts.agg(F.sum("raw"), F.sum("target")).first()
    log_ratio = F.log((F.coalesce("target", F.lit(0)) + 1) / F.lit((target or 0) + buckets)) - F.log((F.coalesce("raw", F.lit(0)) + 1) / F.lit((raw or 0) + buckets))
    every = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    gathered = every.agg(F.sort_array(F.collect_list(F.struct("b", log_ratio.cast("float").alias("r")))).alias("x"))  # ``buckets`` numbers
    return cut(gathered.select(F.transform("x", lambda x: x["r"]).alias("ratios")))


def quality_rules(documents: DataFrame, labels: DataFrame, bits: int = 16, trusted: int = 20_000) -> DataFrame:
    """doc_id, n_words, the four base counts, base_failed, llr, kept."""
    fit = F.pmod(F.xxhash64(F.lit(43), "doc_id"), F.lit(HOLD)) != 0
    sample = cut(trusted_ids(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted).withColumn("yes", fit.cast("int")))
    ratios = F.broadcast(log_ratios(documents, sample, bits))  # one row of 2 ** bits floats
    # the ratios, an array of every bucket, only come to a row in its last projection
    features = F.transform(hashes(), lambda h: bucket(h, bits)).alias("features")
    based = base_rules(with_words(documents.select("doc_id", "text")), features).join(ratios, how="cross")
    total = F.aggregate("features", F.lit(0.0), lambda t, b: t + F.get("ratios", b))
    llr = F.round(F.try_divide(total, F.size("features")), 9).alias("llr")
    rows = cut(based.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", llr))
    known = rows.join(F.broadcast(sample), "doc_id").where("llr is not null").groupBy("yes")
    seen = sorted(known.agg(F.percentile("llr", F.lit(0.005)).alias("low"), F.percentile("llr", F.lit(0.5)).alias("mid")).collect())  # two rows at most
    floor = seen[0]["low"] - (seen[0]["mid"] - seen[0]["low"]) / 2 if seen else float("-inf")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "llr", (~failed & F.coalesce(F.col("llr") >= F.lit(floor), F.lit(False))).alias("kept"))
