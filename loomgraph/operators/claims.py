"""The claim store: append-only tables, statuses from evidence, invalidation, derived facts, relocation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .history import latest


class Store:
    """Append-only Parquet tables under one folder; the newest row of a key is its state. Nothing is updated or removed."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, name: str, rows: DataFrame, actor: str = "engine") -> None:
        """rows with the batch they came in; batches are numbered, and a failed write leaves no row."""
        batch = self.batches(name)
        rows.withColumn("batch", F.lit(batch).cast("long")).withColumn("actor", F.lit(actor)).withColumn("batch_id", F.lit(uuid.uuid4().hex)).write.mode("append").parquet(f"{self.root}/{name}")

    def batches(self, name: str) -> int:
        try:
            found = self.read(name).agg(F.max("batch").alias("b")).first()["b"]
        except Exception as e:  # noqa: BLE001  the table is not there yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0
        return 0 if found is None else int(found) + 1

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def state(self, name: str, keys: list[str]) -> DataFrame:
        return latest(self.read(name), keys, ["batch"])


def claim_status(evidence: DataFrame) -> DataFrame:
    """(claim_id, status) from evidence(claim_id, grp, relation, grade): a group of supports is as strong as its weakest
    grade, the claim as its strongest group; a refutation makes it unknown."""
    rank = T.status_rank(F.col("grade"))
    groups = evidence.groupBy("claim_id", "grp").agg(F.max(F.when(F.col("relation") == "supports", rank)).alias("weak"), F.max((F.col("relation") == "refutes").cast("int")).alias("refuted"))
    claims = groups.groupBy("claim_id").agg(F.min("weak").alias("best"), F.max("refuted").alias("refuted"))
    return claims.select("claim_id", F.when(F.col("refuted") == 1, F.lit("unknown")).otherwise(T.rank_status(F.coalesce("best", F.lit(3)))).alias("status"))


def weakest(rows: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    return rows.groupBy(*keys).agg(T.rank_status(F.max(T.status_rank(F.col(status)))).alias("status"))


def duplicates(claims: DataFrame) -> DataFrame:
    """(claim_key, n, verdict): claims of one key fold if their statuses agree and conflict if they do not."""
    g = claims.groupBy("claim_key").agg(F.count("*").alias("n"), F.count_distinct("status").alias("k")).where("n > 1")
    return g.select("claim_key", "n", F.when(F.col("k") == 1, "fold").otherwise("conflict").alias("verdict"))


def invalidate(claims: DataFrame, deps: DataFrame, facets: DataFrame, changed_files: DataFrame) -> DataFrame:
    """(claim_id, verdict) of active claims: stale where deps(claim_id, dep_key, fp) differ from facets(dep_key, fp) now or
    are gone; rebound where their files (deps.file) changed and the facets did not."""
    d = deps.join(claims.where("status not in ('stale', 'invalidated')").select("claim_id"), "claim_id", "left_semi")
    now = d.join(facets.withColumnRenamed("fp", "now"), "dep_key", "left").join(changed_files.select("file", F.lit(1).alias("touched")).distinct(), "file", "left")
    per = now.groupBy("claim_id").agg(F.max((~F.col("fp").eqNullSafe(F.col("now"))).cast("int")).alias("stale"), F.max(F.coalesce("touched", F.lit(0))).alias("touched"))
    return per.select("claim_id", F.when(F.col("stale") == 1, "stale").when(F.col("touched") == 1, "rebound").alias("verdict")).where("verdict is not null")


def derived(facts: DataFrame, inputs: DataFrame, rounds: int = 10) -> DataFrame:
    """(name, status) of derived facts: inputs(name, input) over facts(name, status), the weakest of all below."""
    known = facts.select("name", T.status_rank(F.col("status")).alias("rank"))
    out = inputs.select("name").distinct().join(known.select("name"), "name", "left_anti").withColumn("rank", F.lit(None).cast("int"))
    for _ in range(rounds):
        ranks = known.unionByName(out)
        step = inputs.join(ranks.select(F.col("name").alias("input"), "rank"), "input", "left").groupBy("name").agg(F.when(F.count("*") == F.count("rank"), F.max("rank")).alias("rank"))
        out = step
        if not out.where("rank is null").take(1):
            break
    return out.select("name", T.rank_status(F.coalesce("rank", F.lit(3))).alias("status"))


def refresh_queue(facts: DataFrame, limit: int) -> DataFrame:
    """The facts(name, refreshed, depth) to refresh next: inputs before what rests on them, oldest first."""
    return facts.orderBy("depth", F.col("refreshed").asc_nulls_first(), "name").limit(limit)


def relocate(anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """(anchor, line) where the text of anchors(anchor, file, line, text) stands now: the nearest equal line, the upper of two."""
    on = [F.col("a.file") == F.col("l.file"), F.sha2(F.trim("a.text"), 256) == F.sha2(F.trim("l.text"), 256)]
    both = anchors.alias("a").join(lines.alias("l"), on)
    return both.groupBy("a.anchor").agg(F.min_by(F.col("l.line"), F.struct(F.abs(F.col("l.line") - F.col("a.line")), F.col("l.line"))).alias("line"))


def call_on_line(text: Column, target: Column) -> Column:
    """Whether a line calls the target: its bare name before a parenthesis, outside a comment."""
    bare = F.regexp_replace(text, r"#.*$|//.*$", "")
    return F.exists(F.regexp_extract_all(bare, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)), lambda x: x == F.regexp_replace(target, r"[().]", ""))


def expired(memory: DataFrame, now: Column) -> DataFrame:
    """memory with status invalidated from its expiry on; nothing is deleted."""
    return memory.withColumn("status", F.when(F.col("expires_at") <= now, "invalidated").otherwise(F.col("status")))


def except_baseline(found: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Violations beyond the known ones: the n-th of a key is known if the baseline has n of it."""
    turn = lambda df: df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy("line")))
    return turn(found).join(turn(baseline).select(*keys, "occurrence"), [*keys, "occurrence"], "left_anti")


def consolidation_batch(claims: DataFrame, limit: int) -> DataFrame:
    """The claims verified longest ago."""
    return claims.orderBy(F.col("verified").asc_nulls_first(), "claim_id").limit(limit)
