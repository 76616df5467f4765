"""Traversals as frontier joins: one loop for reachability, bounded and shortest paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import saved


def oriented(edges: DataFrame, way: str = "out", relations: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(u, v, edge_id, inferred, line): edges as they are walked, restricted to some relations; loops once."""
    own = edges.filter(F.col("relation").isin(*relations)) if relations else edges
    line = F.coalesce(F.col("line").cast("int"), F.lit(10**9))
    rest = [F.col("edge_id"), (F.col("confidence") != "EXTRACTED").alias("inferred"), line.alias("line")]
    out = own.select(F.col("src").alias("u"), F.col("dst").alias("v"), *rest)
    if way == "out":
        return out
    back = own.select(F.col("dst").alias("u"), F.col("src").alias("v"), *rest)
    return back if way == "in" else out.unionByName(back.filter("u <> v"))


def best_edges(hops: DataFrame) -> DataFrame:
    """One edge for each (u, v): EXTRACTED before others, then the lower line, then the lower id."""
    return hops.groupBy("u", "v").agg(F.min(F.struct("inferred", "line", "edge_id")).alias("e")).select("u", "v", "e.edge_id", "e.inferred", "e.line")


def bounded_paths(starts: DataFrame, hops: DataFrame, low: int, high: int) -> DataFrame:
    """(start, end, depth, inferred, edge_ids) of paths of low to high hops that use no edge twice.

    With low <= 1 every end comes once, at its least depth (a start is its own end at depth 0 if low is 0, else only
    through a cycle). With low >= 2 it comes once, at the first depth from low on; one path for each (start, end) is kept a
    level, paths without an inferred edge first, then the surer, lower last edge, which bounds the frontier by the number
    of pairs. hops may hold parallel edges: they are met by the frontier first and the best is chosen in the same
    aggregate. Each level is written, so none is computed again by those after it.
    """
    own = starts.select(F.col("id").alias("start")).distinct()
    front = own.select("start", F.col("start").alias("end"), F.lit(0).alias("depth"), F.lit(False).alias("inferred"), F.array().cast("array<bigint>").alias("edge_ids"))
    levels = [front] if low == 0 else []
    step = hops.select(F.col("u"), F.col("v"), F.col("edge_id").alias("via"), F.col("inferred").alias("guess"), F.col("line").alias("via_line"))
    for depth in range(1, high + 1):
        moved = front.join(step, F.col("end") == F.col("u"))
        if low >= 2:  # a first arrival repeats no edge, so only later ones are looked at
            moved = moved.where(~F.array_contains("edge_ids", F.col("via")))
        best = F.min(F.struct((F.col("inferred") | F.col("guess")).alias("inferred"), "guess", "via_line", "via", F.concat("edge_ids", F.array("via")).alias("edge_ids"))).alias("best")
        found = moved.groupBy("start", F.col("v").alias("end")).agg(best)
        if low <= 1 and levels:
            seen = reduce(DataFrame.unionByName, [x.select("start", "end") for x in levels])
            found = found.join(seen, ["start", "end"], "left_anti")
        front = saved(found.select("start", "end", F.lit(depth).alias("depth"), F.col("best.inferred").alias("inferred"), F.col("best.edge_ids").alias("edge_ids")), "front")
        if depth >= low:
            levels.append(front)
    out = reduce(DataFrame.unionByName, levels)
    if low >= 2:
        first = F.min(F.struct("depth", "inferred", "edge_ids")).alias("best")
        out = out.groupBy("start", "end").agg(first).select("start", "end", "best.depth", "best.inferred", "best.edge_ids")
    return out


def reach(starts: DataFrame, hops: DataFrame, depth: int | None = None, through: DataFrame | None = None) -> DataFrame:
    """(id, distance) of every node reached, starts at 0; to a fix-point if depth is None.

    through: nodes (id) that may be walked from; others are reached and not left (starts always are). A level is one join
    of the frontier with the hops and one anti-join with all that was seen.
    """
    seen = [saved(starts.select("id").distinct().withColumn("distance", F.lit(0)), "reach")]
    step, d = hops.select("u", "v"), 0
    while depth is None or d < depth:
        d += 1
        outgoing = seen[-1] if through is None or d == 1 else seen[-1].join(through.select("id"), "id", "left_semi")
        found = outgoing.join(step, F.col("id") == F.col("u")).select(F.col("v").alias("id")).distinct()
        found = found.join(reduce(DataFrame.unionByName, [x.select("id") for x in seen]), "id", "left_anti")
        if d == depth:
            seen.append(found.withColumn("distance", F.lit(d)))  # the last level is only read once
            break
        new = saved(found.withColumn("distance", F.lit(d)), "reach")
        if new.isEmpty():
            break
        seen.append(new)
    return reduce(DataFrame.unionByName, seen)


def hub_threshold(degrees: DataFrame, floor: int = 50, share: float = 0.99) -> int:
    """max(floor, the degree at place int(share * n) of the sorted degrees), from the histogram of degrees."""
    counts = degrees.groupBy("degree").agg(F.count("*").alias("n"))
    run = counts.withColumn("upto", F.sum("n").over(Window.orderBy("degree"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    got = run.where(F.col("upto") > F.floor(F.col("all") * share)).agg(F.min("degree").alias("d")).first()
    return max(floor, int(got["d"] or 0))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): edge ends at each node, 0 for isolated ones; a loop counts twice."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    counted = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def guarded_bfs(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int, floor: int = 50) -> DataFrame:
    """Undirected reach that does not pass through hubs; seeds that are hubs are left all the same."""
    d = degrees(nodes, edges)
    calm = d.where(F.col("degree") < hub_threshold(d, floor)).select("id")
    return reach(starts, oriented(edges, "both"), depth, through=calm)


def shortest_path(starts: DataFrame, ends: DataFrame, hops: DataFrame, high: int = 10) -> DataFrame:
    """(start, end, depth, inferred, edge_ids) of a shortest path between the given nodes."""
    found = bounded_paths(starts, hops, 0, high)
    return found.join(ends.select(F.col("id").alias("end")).distinct(), "end", "left_semi").select("start", "end", "depth", "inferred", "edge_ids")


def innermost(spans: DataFrame, points: DataFrame, bucket: int = 256) -> DataFrame:
    """points (file, line, ...) with the symbol of the shortest span (file, symbol, start, end) that holds the line.

    Spans are cut into buckets of lines, so the containment join is an equi-join on (file, bucket). Ties: later start,
    then symbol. Points in no span keep a null symbol.
    """
    cut = spans.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    keyed = points.withColumn("p_id", F.monotonically_increasing_id()).withColumn("b", F.floor(F.col("line") / bucket))
    s, p = cut.alias("s"), keyed.alias("p")
    on = (F.col("p.file") == F.col("s.file")) & (F.col("p.b") == F.col("s.b")) & (F.col("p.line") >= F.col("s.start")) & (F.col("p.line") <= F.col("s.end"))
    best = p.join(s, on, "left").groupBy("p.p_id", *[F.col(f"p.{c}") for c in points.columns])
    key = F.when(F.col("s.symbol").isNotNull(), F.struct((F.col("s.end") - F.col("s.start")).alias("size"), (-F.col("s.start")).alias("later"), F.col("s.symbol").alias("symbol")))
    return best.agg(F.min(key).alias("k")).select(*points.columns, F.col("k.symbol").alias("symbol"))
