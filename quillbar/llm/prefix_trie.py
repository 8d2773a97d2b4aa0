"""Conversation prefix trie, summed over subtrees by heavy-path decomposition.

A node of depth d is a distinct sequence of the first d turns (role and text) of
conversations. Turns are reduced to a 128-bit hash and a word count where they are
read. A prefix is the exclusive or of the hashes of its turns, each hashed again with
its place; so prefixes are running values, cut into blocks of places, and no
conversation is gathered, however long.

A node's heavy child is the one with most members (of equal ones that with the smallest
conversation), so a path from the root meets at most log2(conversations) other edges. A
heavy path ends in a childless node and is named by that node's smallest conversation,
whose prefixes hold the whole path; its head is the deepest light node among them.
Totals of paths go up to the path that their head hangs on, paths without waiting ones
first, in at most as many rounds as that logarithm. Then subtree sums are running sums
from the end of each path.

The list of conversations that end in a node is hashed as a stream: ids are sorted by
range partitions and joined in pieces of ``PIECE``, which one task per node then
reads in order (a hash of a sequence is made in sequence; memory stays one batch).

Null conv_id: the rows belong to no conversation and are left out. Null turn: before all
others. Ties of turn: by the turn's hash, so that equal tables give equal tries. Null
role or text: empty. Repeated rows: turns of their own. Empty table: no node. Other
columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, cut, maybe_broadcast, stored

#: Places of a conversation or path whose running values one task sorts together.
BLOCK_BITS = 10
#: Conversation ids joined into one string.
PIECE = 4096

KEY = ("d", "k1", "k2")
_NODE = pa.schema([("d", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _along(df: DataFrame, group: str, place: str, how: dict[str, tuple], back: bool = False) -> DataFrame:
    """Running values in the order of ``place`` within ``group``, ends included, from
    the last place on if ``back``. ``how``: column -> (aggregate, combination of two).

    A block's rows are sorted together; a group's blocks are one row each."""
    by = lambda c: F.desc(c) if back else F.asc(c)
    rows = df.withColumn("_block", F.shiftright(place, BLOCK_BITS))
    blocks = rows.groupBy(group, "_block").agg(*[f(c).alias(c) for c, (f, _) in how.items()])
    before = Window.partitionBy(group).orderBy(by("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), *[f(c).over(before).alias(f"_{c}") for c, (f, _) in how.items()])
    carried = cut(carried.where(F.col(f"_{next(iter(how))}").isNotNull()))  # of groups of several blocks
    within = Window.partitionBy(group, "_block").orderBy(by(place)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: f(c).over(within) for c, (f, _) in how.items()})
    if not carried.isEmpty():
        rows = rows.join(maybe_broadcast(carried), (F.col(group) == F.col("_g")) & (F.col("_block") == F.col("_b")), "left")
        rows = rows.withColumns({c: F.when(F.col("_g").isNull(), F.col(c)).otherwise(g(F.col(c), F.col(f"_{c}"))) for c, (_, g) in how.items()})
    return rows.select(df.columns)


XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
SUM = (F.sum, lambda a, b: a + b)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), x1, x2 (a hash of role and text), words and n: how many
    equal turns follow each other from that place on."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.size(F.array_remove(F.split(text, SPACE), "")).cast("long")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("x1"), F.xxhash64(F.lit(2), text, role).alias("x2"), words.alias("words")
    )
    order = ["turn", "x1", "x2"]
    once = rows.groupBy("conv_id", *order).agg(F.count("*").alias("n"), F.min("words").alias("words"))
    dealt = stored(once.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    held = dealt.groupBy("conv_id", "part").agg(F.sum("n").alias("held"))
    before = F.sum("held").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = held.select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("first"))
    upto = F.sum("n").over(Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = dealt.withColumn("upto", F.coalesce(upto, F.lit(0))).join(first, ["conv_id", "part"])
    return placed.select("conv_id", (F.col("first") + F.col("upto")).alias("place"), "x1", "x2", "words", "n")


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(conv_id, size) and (conv_id, place, x1, x2, words) of conversations that take
    their first h turns from another: h = checksum of the decimal id % (most + 1), the
    other is conv_id - conv_id % every (none of its turns where it is absent, all where
    it has fewer). Their own turns follow from the h-th on."""
    own = stored(turns(conversations))
    heads = own.where((F.col("conv_id") % every == 0) & (F.col("place") < most))
    heads = heads.select(F.col("conv_id").alias("source"), F.explode(F.sequence("place", F.least(F.lit(most).cast("long"), F.col("place") + F.col("n")) - 1)).alias("place"), "x1", "x2", "words")
    heads = heads.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("place", "x1", "x2", "words"))).alias("head"))  # ``most`` turns
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    lengths = own.groupBy("conv_id").agg(F.sum("n").alias("own")).select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("source"))
    convs = lengths.join(heads, "source", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")))
    convs = stored(convs.select("conv_id", "h", "head", F.size("head").cast("long").alias("taken"), (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")))
    given = convs.select("conv_id", F.inline("head"))
    cuts = convs.select(F.col("conv_id").alias("_c"), "h", (F.col("taken") - F.col("h")).alias("shift"))
    left = own.join(maybe_broadcast(cuts), F.col("conv_id") == F.col("_c")).where(F.col("place") + F.col("n") > F.col("h"))
    each = F.explode(F.sequence(F.greatest("place", "h"), F.col("place") + F.col("n") - 1)).alias("at")
    kept = left.select("conv_id", each, "shift", "x1", "x2", "words").select("conv_id", (F.col("at") + F.col("shift")).alias("place"), "x1", "x2", "words")
    return convs.select("conv_id", "size"), given.unionByName(kept)


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, the key (depth d, k1, k2) of each of its prefixes but the empty one, that
    of its parent (d - 1, p1, p2), and the last turn's words."""
    hashed = turns.select("conv_id", "place", "words", F.xxhash64(F.lit(1), "place", "x1", "x2").alias("y1"), F.xxhash64(F.lit(2), "place", "x2", "x1").alias("y2"))
    running = _along(hashed.withColumns({"k1": F.col("y1"), "k2": F.col("y2")}), "conv_id", "place", {"k1": XOR, "k2": XOR})
    parent = [F.col(k).bitwiseXOR(F.col(y)).alias(p) for k, y, p in (("k1", "y1", "p1"), ("k2", "y2", "p2"))]
    return running.select("conv_id", (F.col("place") + 1).alias("d"), "k1", "k2", *parent, "words")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) to (key, first conv_id, ids joined by commas)."""
    key, ids = None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"d": [key[0]], "k1": [key[1]], "k2": [key[2]], "first": [ids[0]], "ids": [",".join(map(str, ids))]}, schema=_NODE.append(pa.field("first", pa.int64())).append(pa.field("ids", pa.string())))

    for batch in batches:
        ready = []
        for *now, c in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if now != key or len(ids) == PIECE:
                if ids:
                    ready.append(out())
                key, ids = now, []
            ids.append(c)
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
    if ids:
        yield out()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to (key, the checksum of all of its pieces joined by commas)."""
    schema = _NODE.append(pa.field("ends_sha256", pa.string()))
    key, sha = None, None
    for batch in batches:
        ready = []
        for *now, _, ids in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if now == key:
                sha.update(b",")
            else:
                if sha:
                    ready.append((*key, sha.hexdigest()))
                key, sha = now, hashlib.sha256()
            sha.update(ids.encode())
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*ready, strict=True), schema.types, strict=True)], schema=schema)
    if sha:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, sha.hexdigest()), strict=True))], schema=schema)


def ends(members: DataFrame) -> DataFrame:
    """The key of every node in which conversations end, and ends_sha256, of rows with
    a key and a conv_id."""
    node = "d long, k1 long, k2 long"
    rows = members.select(*KEY, "conv_id")
    pieces = rows.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_pieces, f"{node}, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, f"{node}, ends_sha256 string")


def _on(a: str, b: str, left: tuple = KEY, right: tuple = KEY) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{i}") == F.col(f"{b}.{j}") for i, j in zip(left, right, strict=True)])


def path_totals(tree: DataFrame, rounds: int = 64) -> DataFrame:
    """Rows (path, up, at, leaves, saved) with the sums of all paths below added: those
    without a path that waits for its own first, then what hangs on them is done."""
    live, done = cut(tree), []
    for _ in range(rounds):
        waits = live.where("up is not null").select(F.col("up").alias("path")).distinct()
        ready = cut(live.join(waits, "path", "left_anti"))
        done.append(ready)
        sums = ready.where("up is not null").groupBy(F.col("up").alias("path")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        left = live.join(ready.select("path"), "path", "left_anti").join(sums, "path", "left")
        live = cut(left.select("path", "up", "at", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))
        if live.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError(f"paths did not settle in {rounds} rounds")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per node: conv_id (its smallest member; with depth, its name), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; of
    conversations (conv_id, size) and their turns (conv_id, place, x1, x2, words)."""
    occurs = stored(prefixes(convs, turns))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in KEY], F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), "n_convs", "conv_id", zero.alias("words"))
    nodes = occurs.groupBy(*KEY).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("words").alias("words"))
    nodes = stored(nodes.unionByName(root))
    kids = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    kids = kids.agg(F.count("*").alias("n_children"), F.min(F.struct((-F.col("n_convs")).alias("n"), "conv_id"))["conv_id"].alias("heavy"))
    known = stored(nodes.join(kids, list(KEY), "left"))
    above = known.select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("favoured"))
    light = F.coalesce(F.col("favoured") != F.col("conv_id"), F.lit(True))  # the root's head is light
    known = stored(known.join(above, ["d", "p1", "p2"], "left").withColumn("light", light).drop("heavy", "favoured"))

    # heavy paths, by the smallest conversation of the node they end in
    leaf = known.where("n_children is null").select("conv_id")
    along = occurs.join(maybe_broadcast(leaf), "conv_id", "left_semi").select("conv_id", *KEY)
    deepest = along.join(known.where("light").select(*KEY), list(KEY)).groupBy("conv_id").agg(F.max("d").alias("head"))
    heads = cut(leaf.join(deepest, "conv_id", "left").select(F.col("conv_id").alias("path"), F.coalesce("head", zero).alias("head")))
    held = along.join(maybe_broadcast(heads), F.col("conv_id") == F.col("path")).where("d >= head").select("path", "head", *KEY)
    held = held.unionByName(heads.where("head = 0").select("path", "head", *[zero.alias(c) for c in KEY]))
    own = {"leaves": F.col("n_children").isNull().cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}
    rows = stored(known.join(held, list(KEY)).withColumns(own))

    # of every path: its own sums, and the path and depth that its head hangs on
    sums = rows.groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    hung = rows.where("d = head and d > 0").select(F.col("path").alias("below"), (F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    hung = hung.join(rows.select(*KEY, F.col("path").alias("up")), list(KEY)).select(F.col("below").alias("path"), "up", F.col("d").alias("at"))
    totals = stored(path_totals(sums.join(hung, "path", "left").select("path", "up", "at", "leaves", "saved")))
    added = totals.where("up is not null").groupBy(F.col("up").alias("path"), F.col("at").alias("d")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    each = rows.join(added, ["path", "d"], "left").withColumns({"leaves": F.col("leaves") + F.coalesce("l", zero), "saved": F.col("saved") + F.coalesce("s", zero)}).drop("l", "s")
    summed = _along(each, "path", "d", {"leaves": SUM, "saved": SUM}, back=True)

    last = occurs.join(convs.select("conv_id", F.col("size").alias("d")), ["conv_id", "d"]).select(*KEY, "conv_id")
    none = convs.where("size = 0").select(*[zero.alias(c) for c in KEY], "conv_id")
    out = summed.join(ends(last.unionByName(none)), list(KEY), "left")
    return out.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    )
