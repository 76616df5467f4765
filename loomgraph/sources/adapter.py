"""The supplied tables as the engine's inputs: a property graph, text lines, histories and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lowering import Graph
from ..runtime import table

KINDS = ("customer", "order", "part", "supplier", "nation", "region")
RELATIONS = ("placed", "contains", "supplied_by", "located_in", "in_region")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node a row of the six entity tables; the folder of source_file groups them."""

    def made(name: str, kind: str, key: str, label: str, folder: str) -> DataFrame:
        t = table(spark, sf_dir, name)
        return t.select(
            F.expr(f"concat('{kind}:', {key})").alias("id"),
            F.expr(label).cast("string").alias("label"),
            F.expr(label).cast("string").alias("name"),
            F.lit(kind).alias("file_type"),
            F.expr(f"concat('{kind}/', {folder})").alias("source_file"),
            F.expr(key).cast("int").alias("line"),
            F.lit(None).cast("int").alias("line_end"),
            F.array(F.lit(kind)).alias("kinds"),
        )

    parts = [
        made("customer", "customer", "c_custkey", "c_name", "c_mktsegment"),
        made("orders", "order", "o_orderkey", "concat('Order#', o_orderkey)", "o_orderpriority"),
        made("part", "part", "p_partkey", "p_name", "p_brand"),
        made("supplier", "supplier", "s_suppkey", "s_name", "s_nationkey"),
        made("nation", "nation", "n_nationkey", "n_name", "n_regionkey"),
        made("region", "region", "r_regionkey", "r_name", "'all'"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """Edges of the wanted relations only, so that the others' tables are not read."""

    def made(df: DataFrame, relation: str, src: str, dst: str, line: str = "1", guess: str = "false") -> DataFrame:
        own = df.select(
            F.expr(src).alias("src"), F.expr(dst).alias("dst"), F.lit(relation).alias("relation"), F.expr(f"if({guess}, 'INFERRED', 'EXTRACTED')").alias("confidence"), F.expr(line).cast("int").alias("line")
        )
        return own.withColumn("edge_id", F.xxhash64("src", "dst", "relation", "confidence", "line"))

    t = lambda name: table(spark, sf_dir, name)
    parts = {
        "placed": lambda: [made(t("orders"), "placed", "concat('customer:', o_custkey)", "concat('order:', o_orderkey)")],
        "contains": lambda: [made(t("lineitem"), "contains", "concat('order:', l_orderkey)", "concat('part:', l_partkey)", "l_linenumber", "l_returnflag = 'R'")],
        "supplied_by": lambda: [made(t("lineitem").select("l_partkey", "l_suppkey").distinct(), "supplied_by", "concat('part:', l_partkey)", "concat('supplier:', l_suppkey)")],
        "located_in": lambda: [
            made(t("customer"), "located_in", "concat('customer:', c_custkey)", "concat('nation:', c_nationkey)"),
            made(t("supplier"), "located_in", "concat('supplier:', s_suppkey)", "concat('nation:', s_nationkey)"),
        ],
        "in_region": lambda: [made(t("nation"), "in_region", "concat('nation:', n_nationkey)", "concat('region:', n_regionkey)")],
    }
    chosen = [df for r in relations for df in parts[r]()]
    out = chosen[0]
    for p in chosen[1:]:
        out = out.unionByName(p)
    return out


def graph(spark: SparkSession, sf_dir: str, relations: tuple[str, ...] = RELATIONS) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir, relations), None, KINDS, RELATIONS)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, text): the lines of the documents, file being the document's id."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("p", "text")).select("file", (F.col("p") + 1).alias("line"), "text")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit, ts, author, path): an order is a commit of its parts by its customer."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("commit"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("author"), F.col("l_partkey").alias("path"))


def blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, author, lines, last): a supplier's summed quantity of a part, and its last shipping date."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("author")).agg(F.sum("l_quantity").cast("long").alias("lines"), F.max("l_shipdate").alias("last"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, test, tree, outcome): an event is a run of its user's test on its day, passed at a value of 50 or more."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("test"), F.date_format("ts", "yyyy-MM-dd").alias("tree"), F.when(F.col("value") >= 50, "pass").otherwise("fail").alias("outcome"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(claim_id, seq, ts, status): an event changes the status of its user's claim to its type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("claim_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("status"))
