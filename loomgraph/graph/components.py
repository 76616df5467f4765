"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Saved


def _mark(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["x"], row["s"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable; only nodes of edges appear.

    Each round hooks the neighbours of a node to the least node around it, so the number of rounds is logarithmic in the
    length of chains; rounds are written to the shared folder and the plan never grows. Edges with a null end and loops
    are left out of the search (a node with nothing but a loop appears as its own component).
    """
    own = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    state = Saved(own.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    loops = state.df.where("a = b").select(F.col("a").alias("node"))
    current, held, seen = state.df.where("a <> b"), [state], None
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the least neighbours are written, so that the join sees two plain exchanges and a node of very many edges can be split
        near = Saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        least = near.df
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        turned = large.where("a <> b")
        lower = turned.groupBy("a").agg(F.min("b").alias("m"))
        small = turned.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b")))
        step = Saved(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
        near.drop()
        now = _mark(step.df)
        if not now[0] or (now == seen and step.df.join(current, ["a", "b"], "left_anti").isEmpty()):
            break
        seen, current = now, step.df
        held.append(step)
        if len(held) > 3:
            held.pop(1).drop()
    linked = step.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = linked.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    alone = loops.join(linked.select("node").union(roots.select("node")), "node", "left_anti").withColumn("component", F.col("node"))
    return linked.union(roots).union(alone)
