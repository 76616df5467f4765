"""Graph tables: validation, degrees, differences, merges, collapses, groups, centrality, communities, cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import Dealt, Saved, saved
from .traverse import degrees, oriented, reach

# What a node and an edge must have, and the values their enumerations allow.
NODE_FIELDS = ("id", "label", "file_type", "source_file")
EDGE_FIELDS = ("src", "dst", "relation", "confidence", "source_file")
FILE_TYPES = ("code", "document", "paper", "image", "rationale", "concept")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
IMPACT_RELATIONS = ("calls", "imports", "imports_from", "uses", "inherits", "method", "references")


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(item, problem) of every missing field, bad enumeration and dangling end."""
    found = []
    for df, names, key in ((nodes, NODE_FIELDS, F.col("id")), (edges, EDGE_FIELDS, F.concat_ws("->", "src", "dst"))):
        for n in names:
            missing = F.col(n).isNull() if n in df.columns else F.lit(True)
            found.append(df.where(missing).select(key.alias("item"), F.lit(f"missing {n}").alias("problem")))
    found.append(nodes.where(~F.col("file_type").isin(*FILE_TYPES)).select(F.col("id").alias("item"), F.lit("unknown file_type").alias("problem")))
    found.append(edges.where(~F.col("confidence").isin(*CONFIDENCES)).select(F.concat_ws("->", "src", "dst").alias("item"), F.lit("unknown confidence").alias("problem")))
    for end in ("src", "dst"):
        loose = edges.join(nodes.select(F.col("id").alias(end)), end, "left_anti")
        found.append(loose.select(F.concat_ws("->", "src", "dst").alias("item"), F.lit(f"dangling {end}").alias("problem")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def top_degrees(nodes: DataFrame, edges: DataFrame, n: int = 10, hub_percentile: float | None = None) -> DataFrame:
    """(id, label, degree) of the n nodes of most edges, ties by id; hubs strictly above the percentile's degree left out."""
    d = degrees(nodes, edges)
    if hub_percentile is not None:
        counts = d.groupBy("degree").agg(F.count("*").alias("c"))
        total = nodes.count()
        place = max(0, int(total * hub_percentile / 100) - 1)
        limit = counts.withColumn("upto", F.sum("c").over(Window.orderBy("degree"))).where(F.col("upto") > place).agg(F.min("degree").alias("d")).first()["d"]
        d = d.where(F.col("degree") <= F.lit(limit))
    return d.join(nodes.select("id", "label"), "id").orderBy(F.desc("degree"), "id").limit(n).select("id", "label", "degree")


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): rows by key that only one side has."""
    a, b = old.select(*keys).distinct(), new.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("removed")))


def merge(old: DataFrame, new: DataFrame, pruned: list[str] = ()) -> DataFrame:
    """old without the files that new brings or that are pruned, and new."""
    kept = old.join(new.select("source_file").distinct(), "source_file", "left_anti")
    if pruned:
        kept = kept.where(~F.col("source_file").isin(*pruned))
    return kept.select(*new.columns).unionByName(new)


def tagged(df: DataFrame, tag: str, columns: tuple[str, ...]) -> DataFrame:
    """ids of a graph of a set of graphs: tag::id."""
    return df.withColumns({c: F.concat(F.lit(f"{tag}::"), F.col(c)) for c in columns})


def without_tag(df: DataFrame, tag: str, column: str = "id") -> DataFrame:
    return df.where(~F.col(column).startswith(f"{tag}::"))


def collapse(edges: DataFrame, ordinal: Column, generic: tuple[str, ...] = ("references", "uses")) -> DataFrame:
    """One edge a pair of nodes whatever its direction: a specific relation before a generic one, then the first by ordinal."""
    rank = F.struct(F.col("relation").isin(*generic).alias("generic"), ordinal.alias("ordinal"), F.col("src").alias("src"), F.col("dst").alias("dst"), F.col("relation").alias("relation"))
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(rank).alias("e")).select("e.src", "e.dst", "e.relation")


def dedupe_edges(edges: DataFrame, ordinal: Column) -> DataFrame:
    """The first edge of each (src, dst, relation)."""
    w = Window.partitionBy("src", "dst", "relation").orderBy(ordinal)
    return edges.withColumn("first_r", F.row_number().over(w)).where("first_r = 1").drop("first_r")


def dedupe_nodes(nodes: DataFrame, ordinal: str) -> DataFrame:
    """The last row of each id, at the place (ordinal) of its first."""
    others = [c for c in nodes.columns if c not in ("id", ordinal)]
    return nodes.groupBy("id").agg(F.max_by(F.struct(*others), F.col(ordinal)).alias("row"), F.min(ordinal).alias(ordinal)).select("id", ordinal, *[f"row.{c}" for c in others])


def group_matrix(nodes: DataFrame, edges: DataFrame, group: Column) -> DataFrame:
    """(group_from, group_to, refs): references between groups of nodes; the folder matrix if group is a folder.

    Ids move as compact_id(), and a group's references to a node are counted before they meet the node."""
    g = nodes.where("id is not null").select(*compact_id("id", "h", "n"), group.alias("grp"))
    a = g.select(F.col("h").alias("src_h"), F.col("n").alias("src_n"), F.col("grp").alias("group_from"))
    b = g.select(F.col("h").alias("dst_h"), F.col("n").alias("dst_n"), F.col("grp").alias("group_to"))
    ends = edges.where("src is not null and dst is not null").select(*compact_id("src", "src_h", "src_n"), *compact_id("dst", "dst_h", "dst_n"))
    named = ends.join(a, ["src_h", "src_n"]).groupBy("dst_h", "dst_n", "group_from").agg(F.count("*").alias("refs"))
    return named.join(b, ["dst_h", "dst_n"]).groupBy("group_from", "group_to").agg(F.sum("refs").alias("refs"))


def compact_id(column: str, head: str, number: str) -> list[Column]:
    """An id that is not null as two columns that are equal exactly where ids are: kind:number as kind and a number, which
    take much less room in an exchange than text; any other id as itself after a mark, and 0."""
    c = F.col(column).cast("string")
    tail = F.substring_index(c, ":", -1)
    n = tail.try_cast("long")
    plain = F.coalesce((n.cast("string") == tail) & (F.length(tail) < F.length(c)), F.lit(False))
    # neither is nullable, so that a join by them does not work them out once more to filter nulls
    kind = F.coalesce(F.when(plain, F.substring(c, F.lit(1), F.length(c) - F.length(tail))).otherwise(F.concat(F.lit("="), c)), F.lit(""))
    return [kind.alias(head), F.coalesce(F.when(plain, n), F.lit(0)).cast("long").alias(number)]


def file_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_from, group_to, refs) between different files."""
    return group_matrix(nodes, edges, F.col("source_file")).where("group_from <> group_to")


def hierarchy(nodes: DataFrame) -> DataFrame:
    """Counts by (folder, file) with folder totals and the grand total (nulls)."""
    return nodes.withColumn("folder", T.folder(F.col("source_file"))).rollup("folder", "source_file").agg(F.count("*").alias("symbols"))


def pagerank(nodes: DataFrame, edges: DataFrame, focus: DataFrame | None = None, damping: float = 0.85, jump: float = 0.9, rounds: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """(id, rank) over edges (src, dst, weight). A random jump goes to the focus nodes with probability ``jump``, if there are
    any, else anywhere; dangling mass follows the jump. Ends at an L1 change under tolerance * n or after ``rounds``."""
    ids = nodes.select("id").distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    share = F.lit(1.0 / n)
    if focus is not None and (f := focus.select("id").distinct().count()):
        marked = ids.join(focus.select("id", F.lit(1).alias("f")).distinct(), "id", "left")
        start = marked.select("id", (F.lit((1 - jump) / n) + F.coalesce("f", F.lit(0)) * F.lit(jump / f)).alias("jump"))
    else:
        start = ids.select("id", share.alias("jump"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    base = Saved(start.join(out.withColumnRenamed("src", "id"), "id", "left"), "base").df
    links = Saved(edges.join(out, "src").groupBy("src", "dst").agg((F.sum("weight") / F.first("total")).alias("p")), "links").df
    held = Saved(base.select("id", share.alias("rank")), "ranks")
    for turn in range(rounds):
        state = base.join(held.df, "id")
        dangling = state.where("total is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("d")).first()["d"]
        moved = links.join(held.df.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("inflow"))
        rank = F.lit(1 - damping) * F.col("jump") + F.lit(damping) * (F.coalesce("inflow", F.lit(0.0)) + F.lit(float(dangling)) * F.col("jump"))
        new = Saved(state.join(moved, "id", "left").select("id", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("moved")), "ranks")
        if turn:
            held.drop()
        held = new
        if held.df.agg(F.sum("moved").alias("m")).first()["m"] < tolerance * n:
            break
    return held.df.select("id", "rank")


def pagerank_unrolled(nodes: DataFrame, edges: DataFrame, rounds: int = 3, damping: float = 0.85) -> DataFrame:
    """A few rounds in one lazy plan, without dangling mass: for dashboards and checks."""
    n = nodes.count()
    out = edges.groupBy("src").agg(F.count("*").alias("total"))
    links = edges.groupBy("src", "dst").agg(F.count("*").alias("k")).join(out, "src").select("src", "dst", (F.col("k") / F.col("total")).alias("p"))
    rank = nodes.select("id", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        flow = links.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("inflow"))
        rank = nodes.select("id").join(flow, "id", "left").select("id", (F.lit((1 - damping) / n) + F.lit(damping) * F.coalesce("inflow", F.lit(0.0))).alias("rank"))
    return rank


def personalised_pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = 0.3, rounds: int = 10) -> DataFrame:
    """(id, rank) by power iteration with restart at seeds (id, mass): close to, not equal to, a local push."""
    total = seeds.agg(F.sum("mass").alias("m")).first()["m"] or 1.0
    start = seeds.select("id", (F.col("mass") / F.lit(float(total))).alias("s"))
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))
    # the links lie in buckets by their source, so that no round moves or sorts them anew
    links = Dealt(edges.where("src is not null").select("src", "dst", share.alias("p")), "src", "links")
    rank = start.withColumnRenamed("s", "rank")
    for turn in range(rounds):
        flow = links.df.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("flow"))
        rank = start.join(flow, "id", "full").select("id", (F.lit(alpha) * F.coalesce("s", F.lit(0.0)) + F.lit(1 - alpha) * F.coalesce("flow", F.lit(0.0))).alias("rank"))
        if turn % 3 == 2 or turn == rounds - 1:
            rank = saved(rank, "ppr")
    links.drop()
    return nodes.select("id").join(rank, "id")


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community): each round a node takes the commonest label around it (its own counts once), ties to the least.

    The invariant is a partition: every node has one community, named by a node of it at the start."""
    numbers, both = numbered(nodes, oriented(edges).where("u <> v").select("u", "v"))
    labels = Saved(numbers.where("n > 0").select("number", F.col("number").alias("community"), "n"), "labels")
    for turn in range(rounds):
        votes = both.join(labels.df.withColumnRenamed("number", "v"), "v").select(F.col("u").alias("number"), "community", "n").unionByName(labels.df)
        # one exchange by node serves both counts
        counted = votes.repartition("number").groupBy("number", "community").agg(F.sum("n").alias("n"))
        new = Saved(counted.groupBy("number").agg(F.min(F.struct((-F.col("n")).alias("n"), "community"))["community"].alias("community")).withColumn("n", F.lit(1).cast("long")), "labels")
        labels.drop()
        labels = new
    name = numbers.select("number", "id")
    return labels.df.join(name, "number").join(name.select(F.col("number").alias("community"), F.col("id").alias("least")), "community").select("id", F.col("least").alias("community"))


def numbered(nodes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes as numbers in the order of their ids: (id, number, n), n being how often nodes has the id, 0 for one that only
    pairs(u, v) name; and the distinct pairs of numbers (u, v), each both ways. Both are in the shared folder.

    Rounds over numbers move a fraction of what they move over ids, and the least number is the least id."""

    def number(ids: DataFrame) -> DataFrame:
        return saved(ids.orderBy("id").select("id", F.monotonically_increasing_id().alias("number"), "n"), "numbers")

    def side(end: str, n: str) -> DataFrame:
        return numbers.select(F.col("id").alias(end), F.col("number").alias(n))

    own = nodes.groupBy("id").agg(F.count("*").alias("n"))
    numbers = number(own)
    while True:
        half = pairs.join(side("u", "a"), "u", "left").select("a", F.when(F.col("a").isNull(), F.col("u")).alias("lost_u"), "v")
        whole = half.join(side("v", "b"), "v", "left").select("a", "b", "lost_u", F.when(F.col("b").isNull(), F.col("v")).alias("lost_v"))
        met = Saved(whole, "pairs")
        lost = met.df.select(F.explode(F.array("lost_u", "lost_v")).alias("id")).where("id is not null").distinct()
        if lost.isEmpty():
            break
        # ends that are no nodes take part too: number them among the others and meet once more
        numbers = number(saved(own.unionByName(lost.withColumn("n", F.lit(0).cast("long"))), "ids"))
        met.drop()
    both = met.df.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(met.df.select(F.col("b").alias("u"), F.col("a").alias("v")))
    found = saved(both.repartition("v").distinct(), "both")
    met.drop()
    return numbers, found


def renumber(members: DataFrame) -> DataFrame:
    """(id, community) with communities numbered from 0 by size, largest first, then by their least member."""
    sizes = members.groupBy("community").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    numbered = sizes.withColumn("number", F.row_number().over(Window.orderBy(F.desc("n"), "least")) - 1)
    return members.join(numbered.select("community", "number"), "community").select("id", F.col("number").alias("community"))


def remap(old: DataFrame, new: DataFrame) -> dict[int, int]:
    """new community -> old one, one to one by largest overlap, then ids; the others get the lowest free numbers.

    Only the overlap counts, one a pair of communities, reach the driver."""
    pairs = new.alias("n").join(old.alias("o"), "id").groupBy(F.col("o.community").alias("a"), F.col("n.community").alias("b")).count().orderBy(F.desc("count"), "a", "b").collect()
    taken, out = set(), {}
    for r in pairs:
        if r["b"] not in out and r["a"] not in taken:
            out[r["b"]] = r["a"]
            taken.add(r["a"])
    free = 0
    for b in sorted(r["community"] for r in new.select("community").distinct().collect()):
        if b not in out:
            while free in taken:
                free += 1
            out[b] = free
            taken.add(free)
    return out


def fingerprints(members: DataFrame) -> DataFrame:
    return members.groupBy("community").agg(T.member_fingerprint(F.collect_set("id")).alias("fingerprint"))


def cohesion(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, n, inner, cohesion): distinct linked pairs inside over possible pairs; 1 for a single node."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    m = members.select("id", "community")
    inner = pairs.join(m.withColumnRenamed("id", "a").withColumnRenamed("community", "ca"), "a").join(m.withColumnRenamed("id", "b").withColumnRenamed("community", "cb"), "b").where("ca = cb")
    counts = inner.groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("inner"))
    sizes = m.groupBy("community").agg(F.count("*").alias("n"))
    n = F.col("n")
    return sizes.join(counts, "community", "left").select("community", "n", F.coalesce("inner", F.lit(0)).cast("long").alias("inner"), F.when(n <= 1, F.lit(1.0)).otherwise(F.coalesce("inner", F.lit(0)) / (n * (n - 1) / 2)).alias("cohesion"))


def hub_labels(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, label) of the member of most edges, ties to the greater id."""
    d = degrees(nodes, edges).join(nodes.select("id", "label"), "id")
    return members.join(d, "id").groupBy("community").agg(F.max_by("label", F.struct("degree", "id")).alias("label"))


def surprise(nodes: DataFrame, edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(src, dst, relation, score): confidence 3/2/1 from least sure, +2 other file type, +2 other top folder, +1 other
    community, half as much again for semantically_similar_to, +1 from a peripheral node to a hub; the structural parts do
    not count for INFERRED calls or uses across file types."""
    d = degrees(nodes, edges)
    about = nodes.select("id", "file_type", F.split("source_file", "/")[0].alias("top")).join(d, "id")
    if members is not None:
        about = about.join(members, "id", "left")
    else:
        about = about.withColumn("community", F.lit(None).cast("int"))
    side = lambda end: about.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("file_type", "top", "degree", "community")])
    e = edges.join(side("src"), "src").join(side("dst"), "dst")
    sure = F.when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1)
    held = (F.col("confidence") == "INFERRED") & F.col("relation").isin("calls", "uses") & (F.col("src_file_type") != F.col("dst_file_type"))
    place = F.when(F.col("src_file_type") != F.col("dst_file_type"), 2).otherwise(0) + F.when(F.col("src_top") != F.col("dst_top"), 2).otherwise(0) + F.when(F.col("src_community") != F.col("dst_community"), 1).otherwise(0)
    score = sure + F.when(held, 0).otherwise(place)
    score = F.when(F.col("relation") == "semantically_similar_to", F.floor(score * 1.5)).otherwise(score)
    low, high = F.least("src_degree", "dst_degree"), F.greatest("src_degree", "dst_degree")
    score = score + F.when((low <= 2) & (high >= 5), 1).otherwise(0)
    return e.select("src", "dst", "relation", score.cast("int").alias("score"))


def questions(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(kind, item): ambiguous edges, edges between communities, isolated nodes, loose communities."""
    name = F.concat_ws("->", "src", "dst")
    m = members.select("id", "community")
    across = edges.join(m.select(F.col("id").alias("src"), F.col("community").alias("ca")), "src").join(m.select(F.col("id").alias("dst"), F.col("community").alias("cb")), "dst").where("ca <> cb")
    parts = [
        edges.where("confidence = 'AMBIGUOUS'").select(F.lit("ambiguous").alias("kind"), name.alias("item")),
        across.select(F.lit("bridge").alias("kind"), name.alias("item")),
        degrees(nodes, edges).where("degree = 0").select(F.lit("isolated").alias("kind"), F.col("id").alias("item")),
        cohesion(members, edges).where("n >= 5 and cohesion < 0.15").select(F.lit("loose").alias("kind"), F.col("community").cast("string").alias("item")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def hyperedge_members(hyperedges: DataFrame, nodes: DataFrame) -> DataFrame:
    """hyperedges(id, members) with distinct, sorted, existing members; those of fewer than two go."""
    flat = hyperedges.select(F.col("id").alias("h"), F.explode("members").alias("id")).join(nodes.select("id"), "id", "left_semi")
    return flat.groupBy(F.col("h").alias("id")).agg(F.sort_array(F.collect_set("id")).alias("members")).where("size(members) > 1")


def bounded_cycles(pairs: DataFrame, longest: int = 5, top: int = 20) -> DataFrame:
    """(cycle, length) of simple cycles over pairs (src, dst), turned so that the least node is first, shortest first."""
    hop = pairs.select("src", "dst").distinct()
    front = hop.where("dst >= src").select(F.array("src", "dst").alias("p")).where("p[0] < p[1]")
    loops = hop.where("src = dst").select(F.array("src").alias("cycle"), F.lit(1).alias("length"))
    found = [loops]
    for n in range(2, longest + 1):
        step = front.join(hop, F.element_at("p", -1) == F.col("src"))
        found.append(step.where(F.col("dst") == F.col("p")[0]).select(F.col("p").alias("cycle"), F.lit(n).alias("length")))
        if n < longest:
            front = step.where((F.col("dst") > F.col("p")[0]) & ~F.array_contains("p", F.col("dst"))).select(F.concat("p", F.array("dst")).alias("p"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.orderBy("length", F.array_join("cycle", "|")).limit(top)


def strong_components(nodes: DataFrame, pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): strongly connected components, named by their greatest id.

    Each round spreads the greatest id forward to a fix-point inside the open part of the graph; the nodes that reach the
    id's node backwards within its colour are one component and leave. Ends when no node is open."""
    open_nodes = saved(nodes.select("id").distinct(), "scc")
    hop = saved(pairs.where("src <> dst").select("src", "dst").distinct(), "hops")
    done = []
    for _ in range(rounds):
        if open_nodes.isEmpty():
            break
        live = saved(hop.join(open_nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(open_nodes.withColumnRenamed("id", "dst"), "dst", "left_semi"), "live")
        colour = saved(open_nodes.select("id", F.col("id").alias("c")), "colour")
        while True:
            spread = live.join(colour, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "c").unionByName(colour).groupBy("id").agg(F.max("c").alias("c"))
            new = saved(spread, "colour")
            if new.join(colour, ["id", "c"], "left_anti").isEmpty():
                break
            colour = new
        inside = live.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        back = reach(colour.where("id = c").select("id"), inside.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        closed = saved(colour.join(back.select("id"), "id", "left_semi").select("id", F.col("c").alias("component")), "closed")
        done.append(closed)
        open_nodes = saved(open_nodes.join(closed.select("id"), "id", "left_anti"), "scc")
    out = done[0] if done else nodes.select("id", F.col("id").alias("component")).limit(0)
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def feedback_edges(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """(src, dst) whose removal leaves each component without a cycle: a greedy order by in- and out-weight, whose backward
    edges are then put back while they close no cycle. Components are handed to a function one at a time, and only those of
    cycles, which are the small part of a dependency graph."""
    import pandas as pd

    a = component.select(F.col("id").alias("src"), F.col("component").alias("c"))
    b = component.select(F.col("id").alias("dst"), F.col("component").alias("cd"))
    inner = pairs.groupBy("src", "dst").agg(F.count("*").alias("w")).where("src <> dst").join(a, "src").join(b, "dst").where("c = cd").select("c", "src", "dst", "w")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = {(s, d): w for s, d, w in zip(pdf["src"], pdf["dst"], pdf["w"], strict=True)}
        left, right, rest = [], [], sorted({x for e in edges for x in e})
        while rest:
            out = {n: sum(w for (s, d), w in edges.items() if s == n and d in rest) for n in rest}
            into = {n: sum(w for (s, d), w in edges.items() if d == n and s in rest) for n in rest}
            sinks = [n for n in rest if not out[n]]
            sources = [n for n in rest if not into[n]]
            if sinks:
                pick = sinks[0]
                right.insert(0, pick)
            elif sources:
                pick = sources[0]
                left.append(pick)
            else:
                pick = max(rest, key=lambda n: (out[n] - into[n], n))
                left.append(pick)
            rest.remove(pick)
        place = {n: i for i, n in enumerate(left + right)}
        kept = {e for e in edges if place[e[0]] < place[e[1]]}
        gone = []
        for e in sorted((e for e in edges if place[e[0]] > place[e[1]]), key=lambda e: (-edges[e], e)):
            seen, todo = set(), [e[1]]
            while todo:
                n = todo.pop()
                if n not in seen:
                    seen.add(n)
                    todo += [d for s, d in kept if s == n]
            if e[0] in seen:
                gone.append(e)
            else:
                kept.add(e)
        return pd.DataFrame(gone, columns=["src", "dst"])

    kind = pairs.schema["src"].dataType.simpleString()
    return inner.groupBy("c").applyInPandas(cut, f"src {kind}, dst {kind}")


def topological_order(groups: list[str], weights: dict[tuple[str, str], int]) -> list[str]:
    """Groups so that each comes before what it uses, by name where free; members of a cycle by least backward weight.

    For the group graph of a matrix, which is on the driver."""
    import itertools

    uses = {g: {d for (s, d) in weights if s == g and d != g} for g in groups}
    order, rest = [], sorted(groups)
    while rest:
        free = [g for g in rest if not any(g in uses[o] for o in rest if o != g)]
        if free:
            order.append(free[0])
            rest.remove(free[0])
            continue

        def below(g: str, rest: list[str] = rest) -> set[str]:
            seen, todo = set(), [g]
            while todo:
                n = todo.pop()
                todo += [d for d in uses[n] if d in rest and d not in seen]
                seen |= uses[n] & set(rest)
            return seen

        down = {g: below(g) for g in rest}
        knot = next(sorted(k) for g in rest if (k := [h for h in rest if h == g or (h in down[g] and g in down[h])]) and not any(set(k) & down[o] for o in rest if o not in k))
        back = lambda p: sum(w for (s, d), w in weights.items() if s in p and d in p and p.index(s) > p.index(d))
        if len(knot) <= 7:
            best = min(itertools.permutations(knot), key=lambda p: (back(p), p))
        else:
            score = {g: sum(w for (s, _), w in weights.items() if s == g) - sum(w for (_, d), w in weights.items() if d == g) for g in knot}
            best = tuple(sorted(knot, key=lambda g: (-score[g], g)))
        order += best
        rest = [g for g in rest if g not in knot]
    return order


def impact(edges: DataFrame, targets: DataFrame, depth: int = 4, relations: tuple[str, ...] = IMPACT_RELATIONS) -> DataFrame:
    """(id, distance) of what depends on the targets, nearest first; the targets themselves left out."""
    return reach(targets, oriented(edges, "in", relations), depth).where("distance > 0")


def unreached(nodes: DataFrame, edges: DataFrame, entries: DataFrame, relations: tuple[str, ...] = ()) -> DataFrame:
    """Nodes no entry reaches."""
    return nodes.join(reach(entries, oriented(edges, "out", relations)).select("id"), "id", "left_anti")


def reached_tests(edges: DataFrame, tests: DataFrame, depth: int = 3) -> DataFrame:
    """(symbol, test): what each test reaches within depth hops."""
    from .traverse import bounded_paths

    return bounded_paths(tests, oriented(edges), 1, depth).select(F.col("end").alias("symbol"), F.col("start").alias("test"))


def wrong_side(edges: DataFrame, entries: DataFrame, flagged: DataFrame) -> DataFrame:
    """(id, distance) of flagged nodes that the entries of the other side reach."""
    return reach(entries, oriented(edges)).join(flagged.select("id"), "id", "left_semi")


def butterfly(edges: DataFrame, center: DataFrame, depth: int = 2, relations: tuple[str, ...] = ("calls",)) -> DataFrame:
    """(side, id, distance): callers on the one side, callees on the other."""
    sides = [("callers", "in"), ("callees", "out")]
    a, b = (reach(center, oriented(edges, way, relations), depth).where("distance > 0").withColumn("side", F.lit(name)) for name, way in sides)
    return a.unionByName(b).select("side", "id", "distance")


def entry_paths(edges: DataFrame, entries: DataFrame, sinks: DataFrame, depth: int = 6) -> DataFrame:
    """(start, end, depth, edge_ids) of shortest paths from entries to sinks."""
    from .traverse import bounded_paths

    found = bounded_paths(entries, oriented(edges), 1, depth)
    return found.join(sinks.select(F.col("id").alias("end")), "end", "left_semi").select("start", "end", "depth", "edge_ids")


def taint(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame, depth: int = 8) -> DataFrame:
    """(start, end, depth) of paths from sources to sinks that enter no sanitizer."""
    clean = edges.join(sanitizers.select(F.col("id").alias("dst")), "dst", "left_anti")
    return entry_paths(clean, sources, sinks, depth).select("start", "end", "depth")


def slice_of(edges: DataFrame, statements: DataFrame, backward: bool = True, depth: int | None = None) -> DataFrame:
    """(id, distance) over data and control dependence edges: what statements depend on, or what depends on them."""
    return reach(statements, oriented(edges, "in" if not backward else "out"), depth)


def group_links(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """(member, user, definer, module, name): uses in one repository of what another defines."""
    on = ["module", "name"]
    d = definitions.select("module", "name", F.col("member").alias("definer"))
    return uses.select("module", "name", F.col("member").alias("user")).join(d, on).where("user <> definer")


def group_link_counts(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """(user, definer, module, name, n): group_links() counted. Both sides are counted before they meet, so a name of many
    uses and many definitions is one row of each, not their product."""
    on = ["module", "name"]
    u = uses.groupBy("module", "name", F.col("member").alias("user")).agg(F.count("*").alias("used"))
    d = definitions.groupBy("module", "name", F.col("member").alias("definer")).agg(F.count("*").alias("defined"))
    return u.join(d, on).where("user <> definer").select("user", "definer", "module", "name", (F.col("used") * F.col("defined")).alias("n"))


def join_routes(clients: DataFrame, routes: DataFrame) -> DataFrame:
    """(client, route): client calls (method, path) against the route table, whose ``{x}`` segments match any segment.

    An equi-join on method and number of segments, then a residual on the segments."""
    c = clients.withColumn("parts", F.split(F.regexp_replace("path", "^/|/$", ""), "/")).withColumn("n", F.size("parts"))
    r = routes.select("method", F.col("path").alias("route"), F.split(F.regexp_replace("path", "^/|/$", ""), "/").alias("pattern")).withColumn("n", F.size("pattern"))
    same = F.forall(F.zip_with("parts", "pattern", lambda a, b: (a == b) | b.rlike(r"^\{.*\}$")), lambda x: x)
    return c.join(r, ["method", "n"]).where(same).drop("parts", "pattern", "n")


def compose_routes(mounts: DataFrame, routes: DataFrame, rounds: int = 5) -> DataFrame:
    """routes(router, method, path) with the prefixes of mounts(parent, router, prefix) put before, outermost first."""
    own = routes
    for _ in range(rounds):
        up = own.join(mounts, "router", "left")
        own = up.select(F.coalesce("parent", "router").alias("router"), "method", F.when(F.col("prefix").isNull(), F.col("path")).otherwise(F.concat(F.regexp_replace("prefix", "/$", ""), "path")).alias("path"))
    return own


def checked_guards(nodes: DataFrame, edges: DataFrame, rules: DataFrame, level: Column) -> DataFrame:
    """(rule, src, dst, verdict) of edges that rules(rule, from_group, to_group) forbid; INFERRED ones are only possible."""
    g = nodes.select("id", level.alias("grp"))
    e = edges.join(g.select(F.col("id").alias("src"), F.col("grp").alias("from_group")), "src").join(g.select(F.col("id").alias("dst"), F.col("grp").alias("to_group")), "dst")
    hit = e.join(rules, ["from_group", "to_group"])
    return hit.select("rule", "src", "dst", F.when(F.col("confidence") == "EXTRACTED", "VIOLATED").otherwise("POSSIBLE").alias("verdict"))
