"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

A version is a text under a path. Its blob is the SHA-256 sum of the text, so equal
texts of any path or time are one blob. The ledger remembers which rules, each with a
version number, have been applied to which blob, and what they found. A scan applies
only pairs of blob and rule that the ledger lacks, commits them, and joins the
findings of all asked rules back to every path. A rule with a new version number is a
new pair for every blob; old findings stay in the ledger, and are not reported.

The ledger is a folder of Parquet tables, two a commit (pairs; findings), and a table
that names the commits. A commit counts only once its name is there: what a lost job
leaves behind is never read. Texts are combined by blob before their only shuffle, and
paths of the same blob meet only hashes and findings, never each other.

A rule's matches are the leftmost ones that do not overlap. Places come from the pieces
of text between matches: their lengths are summed up per text, in characters.

Null text: the empty text. Null path: kept. Repeated rows are repeated in the result.
Empty table: empty result, and no commit. Columns other than the path and the text are
left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, small


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters.

    Patterns repeat single characters only, never groups, so that matching needs no
    deep stack; and mean the same in Java's and in RE2's syntax."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def any_case(word: str) -> str:
    """A pattern of the ASCII letters of ``word`` in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


# Names and forms of secrets.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
BASE = (
    Rule("assign", "(" + "|".join(map(any_case, NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24,}"),  # as all runs of 24 or more
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z0-9\x20]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hub", "gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("url", r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)
RULES = (*BASE, *ADDED)

PAIR = "blob binary, rules array<string>"
FINDING = "blob binary, rule string, start long, end long"


class Ledger:
    """Commits of pairs and findings in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/secret-ledgers/{uuid.uuid4().hex}"

    def commits(self) -> list[str]:
        """Names of the commits, a row each."""
        try:
            return sorted(r[0] for r in self.spark.read.schema("commit string").parquet(f"{self.path}/commits").collect())
        except AnalysisException:  # nothing there yet
            return []

    def _read(self, what: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{what}/{c}" for c in self.commits()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def pairs(self) -> DataFrame:
        return self._read("pairs", PAIR)

    def findings(self) -> DataFrame:
        return self._read("findings", FINDING)

    def table(self, what: str, commit: str, rows: DataFrame) -> DataFrame:
        """``rows``, written for a commit to come."""
        rows.write.parquet(f"{self.path}/{what}/{commit}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{what}/{commit}")

    def commit(self, name: str) -> None:
        self.spark.createDataFrame([(name,)], "commit string").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def findings_of(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """blob, rule, start, end of rows with blob, text and todo (keys of rules)."""
    due = lambda r: F.array_contains("todo", r.key)
    hits = texts.select("blob", "text", "todo", *[F.when(due(r), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias(f"hit{k}") for k, r in enumerate(rules)])
    some = reduce(lambda a, b: a | b, [F.coalesce(F.size(f"hit{k}") > 0, F.lit(False)) for k in range(len(rules))])
    # few texts go on; the pieces between their matches
    pieces = hits.where(some).select(
        "blob",
        *[f"hit{k}" for k in range(len(rules))],
        *[F.when(F.size(f"hit{k}") > 0, F.split("text", r.pattern, -1)).alias(f"gap{k}") for k, r in enumerate(rules)],
        *[F.when(F.size(f"hit{k}") > 0, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))).alias(f"value{k}") for k, r in enumerate(rules)],
    )
    none = F.array().cast("array<struct<rule: string, least: int, at: int, gap: int, n: int, value: int>>")

    def rows(k: int, r: Rule) -> Column:
        each = lambda hit, i: F.struct(F.lit(r.key).alias("rule"), F.lit(r.least).alias("least"), i.alias("at"), F.length(F.get(f"gap{k}", i)).alias("gap"), F.length(hit).alias("n"), F.length(F.get(f"value{k}", i)).alias("value"))
        return F.coalesce(F.transform(f"hit{k}", each), none)

    every = pieces.select("blob", F.inline(F.concat(*[rows(k, r) for k, r in enumerate(rules)])))
    along = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # of one text
    end = F.sum(F.col("gap").cast("long") + F.col("n")).over(along)
    placed = every.select("blob", "rule", "least", "value", "n", end.alias("end"))
    return placed.where("value >= least").select("blob", "rule", (F.col("end") - F.col("n")).alias("start"), "end")


def update(versions: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES) -> int:
    """Apply to the texts of ``versions`` what the ledger lacks; how many blobs had
    such pairs."""
    keys = [r.key for r in rules]
    blobs = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    asked, first_time = F.array(*map(F.lit, keys)), not ledger.commits()
    todo = blobs.select("blob").distinct()
    if first_time:
        todo = todo.select("blob", asked.alias("rules"))
    else:
        seen = ledger.pairs().groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
        left = F.array_except(asked, F.coalesce("seen", F.array().cast("array<string>")))
        todo = todo.join(seen, "blob", "left").select("blob", left.alias("rules")).where(F.size("rules") > 0)
    name = uuid.uuid4().hex
    todo = ledger.table("pairs", name, todo)
    count = todo.count()
    if not count:
        return 0
    if first_time:
        texts = blobs.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", asked)
    else:
        due = todo.select("blob", F.col("rules").alias("todo"))
        due = F.broadcast(due) if count <= 200_000 else due  # of a hash and a few names each
        texts = blobs.join(due, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    ledger.table("findings", name, findings_of(texts, rules))
    ledger.commit(name)
    return count


def scan(versions: DataFrame, path: str = "doc_id", ledger: Ledger | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``path``, blob and ``spans`` (start, place, kind, end; by start, then the place
    of the kind among ``rules``) of every version, a row with ``path`` and ``text``."""
    ledger = ledger or Ledger(versions.sparkSession)
    update(versions, ledger, rules)
    spans = "array<struct<start: long, place: int, kind: string, end: long>>"
    named = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.key), F.struct(F.lit(k).alias("place"), F.lit(r.kind).alias("kind")))])
    found = ledger.findings().where(F.col("rule").isin([r.key for r in rules])).withColumn("r", named[F.col("rule")])
    few = small(found, 200_000)  # of about 100 bytes each
    grouped = found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", F.col("r.place").alias("place"), F.col("r.kind").alias("kind"), "end"))).alias("spans"))
    paths = versions.select(F.col(path), blob_of(F.col("text")).alias("blob"))
    joined = paths.join(F.broadcast(grouped) if few else grouped, "blob", "left")
    return joined.select(path, "blob", F.coalesce("spans", F.array().cast(spans)).alias("spans"))


def report(found: DataFrame, path: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, their checksum, and all spans written out."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    written = lambda spans: F.array_join(F.transform(spans, line), ",")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        path,
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
