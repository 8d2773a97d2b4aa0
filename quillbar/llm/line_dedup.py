"""Line dedup: segment-partition edit join, in DataFrame functions only.

Two lines are linked if their edit distance is at most ``edits``, whatever their
length. A line is split into edits + 1 even segments; of two linked lines, one segment
of the shorter (or equal) stands unchanged in the longer, shifted by at most the edits
before it. So each distinct line enters an index by its segments, keyed by length and
number, and probes the index with the few substrings that length-aware,
multi-match-aware bounds allow (12 for two edits). Candidates are verified by
:func:`within`, a banded bit-parallel edit distance on longs.

Two kinds of lines meet by other keys, which lose no link either:

* lines under ``SHORT`` characters have segments of a few characters that all lines
  hold. They meet in deletion neighbourhoods: two lines within ``edits`` edits become
  equal when up to ``edits`` characters are taken out of each;
* lines that share a segment with very many others (a template, edited copies of one
  line) meet by their rarest tokens, of which by counting any two linked lines share
  one.

A group of such a key is not paired up. All its lines are first compared with two of
them, the pivots, and lines linked through a pivot are one class from there on. Only
lines of different classes are then compared with each other, so a group of thousands
of mutually linked lines yields a few links a line, and pairs that are linked already
are never emitted. What stays quadratic is the *comparison* (XORs and bit counts inside
the join) of lines that share a rare token and are not linked.

Equal lines meet before anything else, so copies never form pairs. Linked lines
form classes (connected components); of a class, the line that stands first (by
doc_id, then place) stays and the others are removed.

Lines are separated by \\n; lines without a word are neither counted nor removed.
Null text: no lines. Null doc_id: behind all others. Rows that repeat doc_id and text
share one result. Other columns are left alone. Line ids are 64-bit hashes of the line.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, doc_key, maybe_broadcast, stored

#: Keys with more (entry, probe) combinations meet by rare tokens instead.
PAIRS = 256
#: Shorter lines meet by deletion neighbourhoods (at most 154 keys for two edits).
SHORT = 16
#: Lines that stand more often join as a hot row, told apart by a count.
OFTEN = 10_000


def lines(documents: DataFrame) -> DataFrame:
    """(doc, id, n, line, h): every line with a word."""
    rows = documents.select(doc_key().alias("doc"), F.xxhash64("text").alias("id"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("h", F.xxhash64("line"))


def segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """1-based start and length of segment i of ``parts`` even ones; the last
    (length mod parts) are one longer."""
    base, more = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    late = F.greatest(F.lit(0), i - parts + more)
    return base * i + late + 1, base + F.when(more > parts - 1 - i, 1).otherwise(0)


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift): where a segment of a line shorter by
    that difference may stand in the longer line."""
    out = []
    for delta in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, delta - (edits - i)), min(i, delta + (edits - i)) + 1):
                out.append((delta, i, shift))
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is made once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def within(x: Column, y: Column, edits: int) -> Column:
    """Whether strings x and y are at most ``edits`` edits apart: their common ends are
    found by halving and left out; the rest, where a part of it stands in both, goes
    through :func:`band`."""
    if not 0 <= edits <= 4:
        raise ValueError("a band of at most four edits fits a long")
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    least = F.least(F.length(x), F.length(y))
    ahead = F.aggregate(steps, F.lit(0), lambda p, s: p + F.when((p + s <= least) & (x.substr(p + 1, s) == y.substr(p + 1, s)), s).otherwise(0))

    def behind(p: Column) -> Column:
        last = lambda c, q, s: c.substr(F.length(c) - q - s + 1, s)
        return F.aggregate(steps, F.lit(0), lambda q, s: q + F.when((p + q + s <= least) & (last(x, q, s) == last(y, q, s)), s).otherwise(0))

    def middle(p: Column, q: Column) -> Column:
        return F.struct(*[c.substr(p + 1, F.length(c) - p - q).alias(n) for c, n in ((x, "x"), (y, "y"))])

    def inner(m: Column) -> Column:
        """What is left differs at both ends, so all but one character there has two
        edits less: of edits - 1 parts of it, one stands unchanged in the other."""
        size = F.length(m["x"]) - 2
        hits = [F.lit(False)]
        for i in range(edits - 1):
            start, length = segment(size, F.lit(i), edits - 1)
            hits += [m["x"].substr(start + 1, length) == m["y"].substr(start + 1 + shift, length) for shift in range(1 - edits, edits)]
        return (F.least(F.length(m["x"]), F.length(m["y"])) <= 4 * edits) | reduce(lambda p, q: p | q, hits)

    chars = lambda c: F.array_remove(F.split(c, ""), "")
    rest = lambda m: F.when(inner(m), band(chars(m["x"]), chars(m["y"]), edits)).otherwise(False)
    near = let(ahead, lambda p: let(behind(p), lambda q: let(middle(p, q), rest)))
    return F.when(F.abs(F.length(x) - F.length(y)) <= edits, near).otherwise(False)


def band(xs: Column, ys: Column, edits: int) -> Column:
    """Whether two arrays of characters are at most ``edits`` edits apart, by a banded
    bit-parallel edit distance.

    The band of 2 x edits + 1 diagonals is kept as bits, a field of them for every
    number of edits so far, all in one long. A character of x moves all of them at
    once: matches keep their diagonal; an edit goes up a field, on the same diagonal
    (substitution), one lower (deletion) or one higher (insertion, as often as edits
    are left).
    """
    w = 2 * edits + 1
    every = sum(1 << (w * d) for d in range(edits + 1))
    number = lambda v: F.lit(v).cast("long")
    fields = lambda low, high: number(every * sum(1 << t for t in range(low, high)))
    # the diagonals' characters side by side, made once a row and not in the lambda
    after = [F.slice(ys, t + 1, F.greatest(F.size(ys) - t, F.lit(0))) for t in range(edits + 1)]
    before = [F.concat(F.array_repeat(F.lit(None).cast("string"), t), ys) for t in range(edits, 0, -1)]
    beside = F.arrays_zip(xs.alias("x"), *[c.alias(f"t{t}") for t, c in enumerate(before + after)])

    def matches(z: Column) -> Column:
        bits = [F.when(z["x"] == z[f"t{t}"], number(every << t)).otherwise(number(0)) for t in range(w)]
        return reduce(lambda p, q: p.bitwiseOR(q), bits)

    whole = number((1 << (w * (edits + 1))) - 1)

    def inserted(s: Column) -> Column:
        ways = [s] + [F.shiftleft(s, (w + 1) * t).bitwiseAND(fields(t, w)).bitwiseAND(whole) for t in range(1, edits + 1)]
        return reduce(lambda p, q: p.bitwiseOR(q), ways)

    def step(s: Column, m: Column) -> Column:
        up = F.shiftleft(s, w).bitwiseAND(whole)
        return inserted(s.bitwiseAND(m).bitwiseOR(up).bitwiseOR(F.shiftright(up, 1).bitwiseAND(fields(0, w - 1))))

    begin = 0
    for d in range(edits + 1):
        begin |= sum(1 << (w * d + edits + t) for t in range(d + 1))
    end = F.aggregate(F.transform(F.slice(beside, 1, F.size(xs)), matches), number(begin), step)
    gap = F.size(ys) - F.size(xs)
    return (F.abs(gap) <= edits) & (F.call_function("shiftright", end, gap + edits).bitwiseAND(number(every)) != 0)


def line_links(rows: DataFrame, edits: int = 2) -> DataFrame:
    """(u, v): ids of different lines within ``edits`` edits of each other, enough of
    them to connect all lines that are."""
    distinct = stored(rows.select("h", "line").distinct().withColumn("size", F.length("line")))
    met, hot = by_segments(distinct, edits)
    groups = cut(by_rare_tokens(distinct, hot, edits).unionByName(by_deletions(distinct, edits), allowMissingColumns=True))
    needed = cut(met.select("h").union(groups.select("h")).distinct())
    text = stored(distinct.join(maybe_broadcast(needed), "h", "left_semi"))
    marks = text.select("h", "size", *parities()).select("h", "size", "bits1", "bits2", F.col("long.a").alias("bits3a"), F.col("long.b").alias("bits3b"))
    marks = maybe_broadcast(cut(marks))
    side = lambda n: marks.select(*[F.col(c).alias(f"{n}_{c}") for c in marks.columns])
    close = F.abs(F.col("u_size") - F.col("v_size")) <= edits
    apart = lambda c: F.bit_count(F.col(f"u_{c}").bitwiseXOR(F.col(f"v_{c}")))
    close = close & (apart("bits1") <= 2 * edits) & (apart("bits2") <= 4 * edits) & (apart("bits3a") + apart("bits3b") <= 6 * edits)

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = (text.select(F.col("h").alias(n), F.col("line").alias(x)) for n, x in (("u", "x"), ("v", "y")))
        return cut(pairs.join(one, "u").join(two, "v").where(within(F.col("x"), F.col("y"), edits)).select("u", "v"))

    # a segment's few lines, pair by pair; of the large groups every line with two pivots
    a, b = met.where("own").alias("a"), met.alias("b")
    once = (F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.h") < F.col("b.h")))
    few = a.join(b, (F.col("a.k") == F.col("b.k")) & once).select(F.col("a.h").alias("u"), F.col("b.h").alias("v"))
    pivots = groups.groupBy("k").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    stars = groups.join(pivots, "k").select(F.explode(F.array("low", "high")).alias("u"), F.col("h").alias("v")).where("u <> v")
    pairs = few.union(stars).distinct().join(side("u"), F.col("u") == F.col("u_h")).join(side("v"), F.col("v") == F.col("v_h")).where(close)
    links = verified(pairs.select("u", "v"))

    # lines of a large group that are not in one class yet
    classes = maybe_broadcast(cut(components(links)))
    known = groups.join(classes, groups["h"] == classes["node"], "left").select("k", "h", "rs", F.coalesce("root", "h").alias("root")).join(marks, "h")
    split = known.groupBy("k").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last").select("k")
    known = stored(known.join(split, "k"))
    one, two = (known.select(F.col("k").alias(f"{n}_k"), F.col("h").alias(n), F.col("root").alias(f"{n}_root"), F.col("rs").alias(f"{n}_rs"), *[F.col(c).alias(f"{n}_{c}") for c in ("size", "bits1", "bits2", "bits3a", "bits3b")]) for n in "uv")
    # of several rare tokens that two lines share, the first joins them
    first = F.col("u_rs").isNull() | (F.get(F.array_intersect("u_rs", "v_rs"), F.lit(0)) == F.col("u_k"))
    rest = one.join(two, (F.col("u_k") == F.col("v_k")) & (F.col("u") < F.col("v")) & (F.col("u_root") != F.col("v_root")) & close & first)
    return links.union(verified(rest.select("u", "v").distinct()))


def by_segments(distinct: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """Lines that share a segment's key with others: (k, h, size, own) of keys with few
    of them, and the ids (h) of lines with a key of many."""
    # probes are rows before they are substrings: one short expression, which the JVM
    # compiles, instead of a method too large for it
    ways = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("delta", "i", "shift"), way, strict=True)]) for way in probes(edits)])
    rows = distinct.where(F.col("size") >= SHORT).select("h", "size", "line", F.explode(ways).alias("p")).select("h", "size", "line", "p.*")
    of = F.col("size") - F.col("delta")
    start, length = segment(of, F.col("i"), edits + 1)
    key = F.xxhash64(F.col("line").substr(start + F.col("shift"), length), of, "i")
    # a line's own segments are its entries in the index, and probe it as well
    asked = rows.select("h", "size", key.alias("k"), ((F.col("delta") == 0) & (F.col("shift") == 0)).alias("own"))
    counts = asked.groupBy("k").agg(F.count_if("own").alias("entries"), F.count("*").alias("all")).where("entries > 0 and all > 1")
    shared = cut(counts.select("k", (F.col("entries") * F.col("all") > PAIRS).alias("hot")))
    met = stored(asked.join(maybe_broadcast(shared), "k").select("k", "h", "size", "own", "hot"))
    return met.where("not hot").drop("hot"), cut(met.where("hot").select("h").distinct())


def by_deletions(distinct: DataFrame, edits: int) -> DataFrame:
    """(k, h) of short lines and those up to ``edits`` longer: every string that is
    left when up to ``edits`` characters are taken out, and has several lines."""
    left = [F.array("line")]
    for _ in range(edits):
        left.append(F.array_distinct(F.flatten(F.transform(left[-1], lambda s: F.transform(F.sequence(F.lit(0), F.length(s)), lambda i: F.concat(F.left(s, i), s.substr(i + 2, F.length(s))))))))
    keys = distinct.where(F.col("size") < SHORT + edits).select("h", F.explode(F.array_distinct(F.concat(*left))).alias("t")).select(F.xxhash64(F.lit("d"), "t").alias("k"), "h").distinct()
    several = keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    return keys.join(several, "k")


def neighbours(tokens: Column, n: int) -> Column:
    """Hashes of ``n`` tokens in a row, from every token on; nulls stand behind the
    end. The shifted arrays are made once a row (an expression inside the lambda
    would be made again for every token)."""
    if n == 1:
        return F.transform(tokens, lambda x: F.xxhash64(x))
    shifted = [F.slice(tokens, j + 1, F.greatest(F.size(tokens) - j, F.lit(0))).alias(f"t{j}") for j in range(n)]
    return F.transform(F.arrays_zip(*shifted), lambda x: F.xxhash64(*[x[f"t{j}"] for j in range(n)]))


def parities() -> list[Column]:
    """bits1, bits2, bits3a and bits3b: which hashed q-grams of ``line`` occur an odd
    number of times (64, 64 and 128 bits for q = 1, 2, 3). One edit takes out at most q
    of them and puts in q, so it flips at most 2 q bits."""
    one = F.lit(1).cast("long")
    odd = lambda numbers: F.aggregate(numbers, F.lit(0).cast("long"), lambda t, x: t.bitwiseXOR(F.when(x < 64, F.call_function("shiftleft", one, x)).otherwise(F.lit(0))))
    bit = lambda q, n: F.transform(neighbours(F.split("line", ""), q), lambda h: h.bitwiseAND(F.lit(n - 1)).cast("int"))
    long = let(bit(3, 128), lambda b: F.struct(odd(b).alias("a"), odd(F.transform(b, lambda x: x.bitwiseXOR(F.lit(64)))).alias("b")))
    return [odd(bit(1, 64)).alias("bits1"), odd(bit(2, 64)).alias("bits2"), long.alias("long")]


def by_rare_tokens(distinct: DataFrame, hot: DataFrame, edits: int) -> DataFrame:
    """(k, h, rs): of each line in ``hot`` a few tokens, such that two lines within
    ``edits`` edits have one in common. Tokens are three words in a row, of which an
    edit changes four at most (it may join two words), or three characters in a row, of
    which it changes three. Lines that keep all but m of their tokens share one of
    their m + 1 rarest, in any fixed order of rarity, if one of them has more than m.
    So lines with up to 2 m word tokens also have character tokens, and lines with
    up to m of those a key that all such lines have. Tokens of one line are left out.
    """
    by_word, by_char = 4 * edits, 3 * edits
    words = F.array_distinct(neighbours(F.split("line", " "), 3))
    chars = F.array_distinct(neighbours(F.split("line", ""), 3))
    both = distinct.join(maybe_broadcast(hot), "h", "left_semi").select("h", "line", words.alias("words"))
    both = both.select("h", "words", F.when(F.size("words") <= 2 * by_word, chars).alias("chars"))
    kinds = F.array(F.struct(F.lit(by_word).alias("m"), F.col("words").alias("t")), F.struct(F.lit(by_char).alias("m"), F.col("chars").alias("t")))
    one = both.select("h", F.explode(kinds).alias("s")).select("h", "s.m", "s.t").where("t is not null")
    one = one.where((F.col("m") == by_char) | (F.size("t") > by_word))
    tokens = one.select("h", "m", F.size("t").alias("size"), F.explode("t").alias("t")).select("h", "m", "size", F.xxhash64("m", "t").alias("r"))
    times = tokens.groupBy("r").agg(F.count("*").alias("times"))
    ranked = tokens.join(times, "r").groupBy("h", "m", "size").agg(F.sort_array(F.collect_list(F.struct("times", "r"))).alias("all"))
    picked = ranked.select("h", "m", "size", F.transform(F.filter(F.slice("all", 1, F.col("m") + 1), lambda x: x["times"] > 1), lambda x: x["r"]).alias("r"))
    picked = picked.withColumn("r", F.when(F.col("size") <= F.col("m"), F.array_append("r", F.xxhash64("m"))).otherwise(F.col("r")))
    whole = picked.groupBy("h").agg(F.array_distinct(F.flatten(F.sort_array(F.collect_list("r")))).alias("rs"))  # two rows a line
    return whole.select(F.explode("rs").alias("k"), "h", "rs")


def with_firsts(documents: DataFrame, edits: int) -> DataFrame:
    """(doc, id, n, equal, first) of every line that is not the only one of its class:
    the places of the first equal line and of the first line of the class."""
    roots = cut(components(line_links(lines(documents), edits)))
    at = stored(lines(documents).select("doc", "id", "n", "h"))
    per = stored(at.groupBy("h").agg(F.min(F.struct("doc", "id", "n")).alias("equal"), F.count("*").alias("c")))
    rooted = cut(per.join(maybe_broadcast(roots), per["h"] == roots["node"]).select("h", "root", "equal"))
    first = rooted.groupBy("root").agg(F.min("equal").alias("first"))
    first = cut(rooted.join(first, "root").select(F.col("h").alias("_h"), "first"))
    known = per.join(maybe_broadcast(first), F.col("h") == F.col("_h"), "left").select("h", "c", "equal", F.coalesce("first", "equal").alias("first"))
    known = known.where((F.col("c") > 1) | (F.col("first") < F.col("equal")))
    # a line that very many documents hold joins as one of a few broadcast rows
    often = cut(known.where(F.col("c") > OFTEN).drop("c"))
    seldom = known.where(F.col("c") <= OFTEN).drop("c")
    if often.isEmpty():
        return at.join(seldom, "h").drop("h")
    ids = maybe_broadcast(often.select("h"))
    return at.join(maybe_broadcast(often), "h").unionByName(at.join(ids, "h", "left_anti").join(seldom, "h")).drop("h")


def line_dedup(documents: DataFrame, edits: int = 2) -> DataFrame:
    """One row per document: doc_id, n_lines (with a word), n_removed (lines whose
    class stands earlier), n_edited (those of them that equal no earlier line)."""
    place = F.struct("doc", "id", "n")
    gone = with_firsts(documents, edits).where(place > F.col("first"))
    per = gone.groupBy("doc", "id").agg(F.count("*").alias("gone"), F.count_if(F.col("equal") == place).alias("edited"))
    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    rows = documents.select("doc_id", doc_key().alias("doc"), F.xxhash64("text").alias("id"), size.alias("n_lines"))
    copies = rows.groupBy("doc", "id").agg(F.count("*").alias("copies"))
    counts = copies.join(per, ["doc", "id"], "left").select("doc", "id", *[F.floor(F.coalesce(c, F.lit(0)) / F.col("copies")).cast("long").alias(f"n_{o}") for c, o in (("gone", "removed"), ("edited", "edited"))])
    return rows.join(counts, ["doc", "id"]).select("doc_id", "n_lines", "n_removed", "n_edited")


def removed_lines(documents: DataFrame, edits: int = 2) -> DataFrame:
    """(doc, id, n, first): lines to drop and the place of the line that stays."""
    return with_firsts(documents, edits).where(F.struct("doc", "id", "n") > F.col("first")).select("doc", "id", "n", "first")
