"""Helpers shared by the corpus operators: lineage cuts, size-checked joins,
distributed prefix sums and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ``[^\x20\x09-\x0D]+`` is a word everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: A side is broadcast only when a count shows at most this many rows (keys are
#: 8 or 16 bytes, so a relation of at most about 64 MB); beyond it, joins shuffle.
BROADCAST_ROWS = 1_000_000
#: The same check for sides that carry payload, in bytes of that payload.
BROADCAST_BYTES = 32 << 20

#: Rows handed to a Python worker at once.
BATCH_BYTES = 2 << 20
#: Rows of a Parquet file that a task decodes at once, and bytes of its pieces.
SCAN_ROWS, PIECE_BYTES = 64, 256 << 10

NO_ID = (1 << 63) - 1


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands at most about ``BATCH_BYTES`` of rows to a Python
    worker at a time, as text is long: by default a batch is 10,000 rows or 64 MB, which
    an executor holds several times, in its JVM and in each worker. Results are the same;
    a single longer row is still a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def small_scans(spark: SparkSession) -> None:
    """From now on this session reads Parquet by pieces and decodes ``SCAN_ROWS`` rows at a time,
    writes it in pages of ``PIECE_BYTES``, and aggregates in one map, not two. By default pieces
    have 8 MB, pages 1 MB, 4096 rows' texts are one array of tens of MB, doubled and copied as it
    fills, and every map takes a page of 32 MB. Arrays of half a MB or more need room in one
    piece and go only when all of the heap has been marked; so the heap grows long before it is
    full, and an executor's memory from query to query. Results are the same."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))
    spark.conf.set("parquet.read.allocation.size", str(PIECE_BYTES))
    spark.conf.set("parquet.page.size", str(PIECE_BYTES))
    spark.conf.set("spark.sql.codegen.aggregate.map.twolevel.enabled", "false")


def lean_driver(spark: SparkSession) -> None:
    """From now on this session broadcasts the side of a join only where the plan or a hint
    says so (:func:`maybe_broadcast`), not since both sides, shuffled already, turn out to be
    small: such a side is gathered and hashed on the driver, which saves a sort in the tasks
    and, with many small joins, fills the driver. Shuffle files go at the end of the query
    that made them, not when the driver happens to collect its garbage, which a lean driver
    seldom does. Results are the same."""
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, where it is
    unset (tests, local sessions), a folder inside the warehouse."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, but as a compressed Parquet table: for larger results."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_key(column: str = "doc_id") -> Column:
    """doc_id as a key; null ids sort behind all others and equal each other."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows (reads no more than that)."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it small, else as it is."""
    return F.broadcast(df) if small(df, rows) else df


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Distinct non-null doc_ids labelled quality 1 and not toxic in every label."""
    return (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .where("q = 1 and t = 0")
        .select("doc_id")
    )


def running_offsets(df: DataFrame, group: list[str], order: Column, value: str, out: str) -> DataFrame:
    """Exclusive running sum ``out`` of ``value`` within ``group`` in the order
    of the 64-bit hash column ``order`` (ties: by all other columns' hash).

    No window holds a whole group: the hash order is cut into 256 x 256 ranges;
    sums of ranges are added up level by level, and only the rows of one range
    are sorted together. A hot group is so split over 65,536 keys.
    """
    others = [c for c in df.columns]
    keyed = df.withColumns({"_h": order}).withColumns(
        {
            "_tie": F.xxhash64(*others),
            "_b1": F.shiftrightunsigned("_h", 56).cast("int"),
            "_b2": F.shiftrightunsigned("_h", 48).bitwiseAND(F.lit(255)).cast("int"),
        }
    )
    fine = keyed.groupBy(*group, "_b1", "_b2").agg(F.sum(value).alias("_s"))
    coarse = fine.groupBy(*group, "_b1").agg(F.sum("_s").alias("_s"))
    before = lambda *p: Window.partitionBy(*p)
    upto = (Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    coarse = coarse.select(*group, "_b1", F.coalesce(F.sum("_s").over(before(*group).orderBy("_b1").rowsBetween(*upto)), zero).alias("_o1"))
    fine = fine.select(*group, "_b1", "_b2", F.coalesce(F.sum("_s").over(before(*group, "_b1").orderBy("_b2").rowsBetween(*upto)), zero).alias("_o2"))
    same = [keyed[c].eqNullSafe(fine[c]) for c in (*group, "_b1", "_b2")]
    base = fine.alias("f").join(coarse.alias("c"), [F.col(f"f.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*group, "_b1")])
    base = base.select(*[F.col(f"f.{c}").alias(f"_k_{c}") for c in (*group, "_b1", "_b2")], (F.col("_o1") + F.col("_o2")).alias("_base"))
    same = [keyed[c].eqNullSafe(base[f"_k_{c}"]) for c in (*group, "_b1", "_b2")]
    within = before(*group, "_b1", "_b2").orderBy("_h", "_tie").rowsBetween(*upto)
    return keyed.join(base, same).withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(within), zero)).select(*others, out)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u, v long): ``node`` and ``root``, the
    smallest node of its component, for every node that has an edge.

    Alternating large-star and small-star steps; every step is a groupBy-min
    (combined before its shuffle) and an equi-join that adaptive execution may
    split, so a star's hub is not gathered in one task. Each round is cut by a
    checkpoint; the edge set never gets larger than its input.
    """

    def star(pairs: DataFrame, keep: str) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(low, "u").where(keep).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")

    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, "v > u").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("y")), F.struct(F.col("v").alias("x"), F.col("m").alias("y")))).alias("p"))
        now = cut(small_star.select(F.col("p.x").alias("u"), F.col("p.y").alias("v")).where("u <> v").distinct())
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaf = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaf.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
