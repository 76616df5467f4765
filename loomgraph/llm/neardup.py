"""Near-duplicate embeddings by NN-descent over cosine similarity."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph.components import components
from ..runtime import Saved, saved, tidy
from .textkernel import across, runs, spanning

#: Vectors of the recall audit: those of the lowest hashes of their id.
AUDIT_ROWS = 1000
#: Probability with which the partitions of a round may miss a pair at the threshold.
MISSED = 1e-3
#: Most classes of a cell's block, and rows of it compared at once; a task holds a bit pattern of two blocks and a few such strips.
BLOCK, CHUNK = 2048, 128
#: Rows of results that a task sends at once.
SENT = 1 << 15


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat doubles (nulls as nan) and lengths (-1: null) of a column of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.asarray(flat, float), np.where(np.isnan(sizes.astype(float)), -1, np.nan_to_num(sizes.astype(float))).astype(np.int64)


def _prepare(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, and the vector as bytes of doubles with their digest; null for a vector that links with nothing."""
    for batch in items:
        flat, sizes = _lists(batch.column("embedding"))
        ends = np.cumsum(np.maximum(sizes, 0))
        raws, keys = [], []
        for size, end in zip(sizes.tolist(), ends.tolist(), strict=True):
            v = flat[end - max(size, 0) : end]
            ok = size > 0 and np.isfinite(v).all() and np.any(v)
            raw = (v + 0.0).tobytes() if ok else None
            raws.append(raw)
            keys.append(hashlib.md5(raw).digest() if ok else None)
        yield pa.record_batch([batch.column("vec_id"), pa.array(raws, pa.binary()), pa.array(keys, pa.binary())], ["vec_id", "raw", "key"])


def unit_rows(raws: list[bytes]) -> np.ndarray:
    """Unit vectors of one dimension; scaled by their largest part first, so that squares neither overflow nor vanish."""
    m = np.frombuffer(b"".join(raws), np.float64).reshape(len(raws), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of many small batches in fewer of SENT rows or so; the memory of the parts goes back to the system."""
    held, n = [], 0
    for part in parts:
        if part.num_rows:
            held.append(part)
            n += part.num_rows
        if n >= SENT:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    pa.default_memory_pool().release_unused()


def _planes(dim: int, table: int, bits: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([dim, table])).standard_normal((dim, max(bits, 1)))


def _buckets(tables: list[int], bits: int):
    """Each vector once a table, with the signs of its products with the table's random planes as bucket."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(max(bits, 1), dtype=np.int64)
        for batch in items:
            cid, raws = batch.column("cid"), batch.column("raw").to_pylist()
            sizes = np.array([len(r) // 8 for r in raws], np.int64)
            for t in tables:
                bucket = np.zeros(len(raws), np.int64)
                for dim in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == dim)
                    signs = unit_rows([raws[i] for i in at]) @ _planes(dim, t, bits) > 0
                    bucket[at] = (signs * weights).sum(axis=1) * (bits > 0) * 4096 * 64 + dim % 4096
                yield pa.record_batch([pa.array(bucket * 64 + t % 64, pa.int64()), cid, batch.column("floor"), batch.column("raw")], ["g", "cid", "floor", "raw"])

    return run


def _pairs(u: np.ndarray, v: np.ndarray, sim: np.ndarray, span: bool) -> pa.RecordBatch:
    return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float64()), pa.array(np.full(len(u), span))], ["u", "v", "sim", "span"])


def _best(k: int, threshold: float):
    """Of a cell's block pair: the k most similar rows of each row, and (span) links that span all links between the blocks.

    Every pair is compared, and two rows that are linked are joined by a path of spanning links, however full a list is.
    Pairs under the floor of a row, which its list has k rows above or at, would not enter the list and are not sent.
    """

    def parts(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(items, ["g", "i", "j"]):
            raws, one = group.column("raw").to_pylist(), group.column("i")[0].as_py() == group.column("j")[0].as_py()
            lengths = np.array([len(r) for r in raws])
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                n = len(at)
                if n < 2:
                    continue
                cid, blk, floor, unit = *(group.column(c).to_numpy()[at] for c in ("cid", "blk", "floor")), unit_rows([raws[x] for x in at])
                link, m = np.zeros((n, n), bool), min(k, n - 1)
                for lo in range(0, n, CHUNK):
                    sims = unit[lo : lo + CHUNK] @ unit.T
                    own = np.arange(lo, lo + len(sims))
                    sims[np.arange(len(sims)), own] = -2
                    if not one:
                        sims[blk[own][:, None] == blk[None, :]] = -2
                    near = sims >= threshold
                    link[own] |= near
                    link[:, own] |= near.T
                    top = np.argpartition(sims, n - m, axis=1)[:, n - m :].ravel()
                    rows = np.repeat(np.arange(len(sims)), m)
                    some = (sims[rows, top] > -2) & (sims[rows, top] >= floor[own[rows]])
                    yield _pairs(cid[own[rows[some]]], cid[top[some]], sims[rows, top][some], False)
                a, b = spanning(link)
                yield _pairs(cid[a], cid[b], np.full(len(a), threshold), True)

    return lambda items: _gathered(parts(items))


def _local_join(threshold: float):
    """Pairs of neighbours of one node that improve on the least similar neighbour either of them has, and spanning links."""

    def parts(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(items, ["u", "s"]):
            n = group.num_rows
            raws = group.column("raw").to_pylist()
            if n < 2 or len({len(r) for r in raws}) > 1:
                continue
            cid, floor, unit = group.column("v").to_numpy(), group.column("floor").to_numpy(), unit_rows(raws)
            sims = unit @ unit.T
            apart = cid[:, None] != cid[None, :]
            a, b = np.nonzero((sims > np.minimum(floor[:, None], 2)) & apart)
            if len(a):
                yield _pairs(cid[a], cid[b], sims[a, b], False)
            link = (sims >= threshold) & apart
            a, b = spanning(link | link.T)
            if len(a):
                yield _pairs(cid[a], cid[b], np.full(len(a), threshold), True)

    return lambda items: _gathered(parts(items))


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of each node."""
    best = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    return best.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))).where(F.col("r") <= k).drop("r")


def tables_for(threshold: float, bits: int, least: int) -> int:
    """Partitions by so many planes until a pair at the threshold shares a cell of one with a probability of 1 - MISSED."""
    same = min((1 - math.acos(min(max(threshold, -1.0), 1.0)) / math.pi) ** bits, 1 - 1e-12)
    return max(least, math.ceil(math.log(MISSED) / math.log1p(-same)))


def least_recall(rows: list[tuple[int, int]]) -> float:
    """The least mean recall of vectors with about as many links (1, 2-3, 4-7, ...); rows: links, and those found, of each."""
    strata: dict[int, list[float]] = {}
    for true, found in rows:
        if true:
            strata.setdefault(true.bit_length(), []).append(found / true)
    return min((sum(x) / len(x) for x in strata.values()), default=1.0)


def _compare(threshold: float):
    """Every pair of a component's block pair: weights of links, and spanning links."""

    def parts(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(items, ["g", "i", "j"]):
            n = group.num_rows
            if n < 2:
                continue
            cid, blk, mult = (group.column(c).to_numpy() for c in ("cid", "blk", "mult"))
            unit = unit_rows(group.column("raw").to_pylist())
            link = unit @ unit.T >= threshold
            link |= link.T
            np.fill_diagonal(link, False)
            if group.column("i")[0].as_py() != group.column("j")[0].as_py():
                p, q = across(link, blk)
                link &= blk[:, None] != blk[None, :]
            else:
                p, q = spanning(link)
            weight = link @ mult
            a = [*cid[weight > 0].tolist(), *cid[p].tolist()]
            b = [None] * int((weight > 0).sum()) + cid[q].tolist()
            w = [*weight[weight > 0].tolist(), *[0] * len(p)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (a, b, w)], ["a", "b", "w"])

    return lambda items: _gathered(parts(items))


def _audit(asked: list[tuple[int, int, bytes]], threshold: float):
    """Links of each asked vector, by brute force, and how many of them lie in one component."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list[tuple[int, int, bytes]]] = {}
        for q in asked:
            by_dim.setdefault(len(q[2]), []).append(q)
        for batch in items:
            cid, comp, raws = batch.column("cid").to_numpy(), batch.column("g").to_numpy(), batch.column("raw").to_pylist()
            sizes = np.array([len(r) for r in raws])
            for dim, qs in by_dim.items():
                at = np.flatnonzero(sizes == dim)
                own, unit = np.array([q[0] for q in qs]), unit_rows([q[2] for q in qs])
                true, found = np.zeros(len(qs), np.int64), np.zeros(len(qs), np.int64)
                for lo in range(0, len(at), 1024):
                    part = at[lo : lo + 1024]
                    link = unit @ unit_rows([raws[i] for i in part]).T >= threshold
                    link &= own[:, None] != cid[part][None, :]
                    true += link.sum(axis=1)
                    found += (link & (np.array([q[1] for q in qs])[:, None] == comp[part][None, :])).sum(axis=1)
                some = true > 0
                yield pa.record_batch([pa.array(own[some], pa.int64()), pa.array(true[some]), pa.array(found[some])], ["cid", "true", "found"])

    return run


def link_vectors(
    vectors: DataFrame, threshold: float = 0.9, k: int = 10, tables: int = 6, rounds: int = 1, target: float = 0.99, most_rounds: int = 6, leaf: int = 128, block: int = 512
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector; links have cosine >= threshold, in double precision.

    Equal vectors are one class. The neighbour graph starts from random-plane partitions (about ``leaf`` classes a cell;
    ``tables`` at a time, and as many in all as a pair at the threshold needs to share a cell but once in 1 / MISSED).
    All pairs of a cell are compared, a large cell's as pairs of blocks. The graph keeps the ``k`` best of each node, and is
    refined by ``rounds`` of NN-descent: every node compares its neighbours and reverse neighbours with each other (in
    parts of 64, so a hub is many tasks). Both also give links that span all those they saw, which no length of list cuts;
    these and the graph's form components, and within these every pair is compared. Recall is audited against brute
    force for AUDIT_ROWS vectors, by the number of links; while a class of vectors is under ``target``, new partitions and
    another round follow, ``most_rounds`` in all, and then every pair of classes is compared. So it is at once for so few
    classes that the cells would hold as many pairs.

    Null, zero or empty vectors and those with null or non-finite components link with nothing; neither do vectors of
    different lengths. Null vec_id: compared like any other. Repeated rows are equal vectors. Ties: equal similarities in a
    list go to the lower class; a cosine of exactly ``threshold`` is a link. Empty table: no rows. Extra columns are
    ignored.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = saved(own.mapInArrow(_prepare, "vec_id long, raw binary, key binary"), "vectors")
    groups = rows.where("raw is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("raw").alias("raw"))
    classes = saved(groups.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    bits = max(0, round(math.log2(max(n, 1) / leaf)))
    lowest = classes.orderBy(F.xxhash64("rep"), "cid").limit(AUDIT_ROWS).select("cid", "raw").collect()

    graph, spans, at, done = None, None, 0, 0
    schema = "u long, v long, sim double, span boolean"
    most = tables_for(threshold, bits, tables)
    whole = n <= most * leaf

    def add(found: DataFrame) -> None:
        nonlocal graph, spans
        step = Saved(found, "pairs")
        new, span = step.df.where("not span").select("u", "v", "sim"), step.df.where("span").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        old = graph, spans
        graph = Saved(_top(new if graph is None else graph.df.union(new), k), "graph")
        spans = Saved((span if spans is None else spans.df.union(span)).distinct(), "spans")
        for x in (step, *old):
            if x is not None:
                x.drop()
        tidy(own.sparkSession)

    def with_floors() -> DataFrame:
        """cid, floor, raw of each class; its floor is the least similarity in its list, if that is full."""
        if graph is None:
            return classes.select("cid", F.lit(-2.0).alias("floor"), "raw")
        floors = graph.df.groupBy("u").agg(F.min("sim").alias("low"), F.count("*").alias("c")).where(F.col("c") >= k).select(F.col("u").alias("cid"), F.col("low").alias("floor"))
        return classes.select("cid", "raw").join(floors, "cid", "left").select("cid", F.coalesce("floor", F.lit(-2.0)).alias("floor"), "raw")

    def partition(numbers: list[int], planes: int) -> None:
        schema_of = "g long, cid long, floor double, raw binary"
        dealt = with_floors().mapInArrow(_buckets(numbers, planes), schema_of)
        counts = classes.select("cid", F.lit(-2.0).alias("floor"), "raw").mapInArrow(_buckets(numbers, planes), schema_of).groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
        cells = dealt.join(counts, "g", "left").withColumn("many", F.coalesce(F.ceil(F.col("n") / F.lit(BLOCK)), F.lit(1)).cast("int"))
        split = cells.withColumn("blk", F.pmod(F.xxhash64("cid", "g"), F.col("many")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
        blocks = split.select("g", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "cid", "floor", "raw")
        add(blocks.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_best(k, threshold), schema))

    while True:
        if whole:
            partition([0], 0)
        else:
            for lo in range(at, at + most, tables):
                partition(list(range(lo, min(lo + tables, at + most))), bits)
            at += most
            for _ in range(rounds):
                about = with_floors().withColumnRenamed("cid", "v")
                both = graph.df.select("u", "v").union(graph.df.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
                degree = both.groupBy("u").agg(F.count("*").alias("n"))
                near = both.join(degree, "u").withColumn("s", F.pmod(F.xxhash64("v", "u"), F.ceil(F.col("n") / F.lit(64)))).join(about, "v")
                add(near.select("u", "s", "v", "raw", "floor").repartition("u", "s").sortWithinPartitions("u", "s").mapInArrow(_local_join(threshold), schema))
        done += 1
        links = graph.df.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
        linked = saved(components(links.union(spans.df)), "linked")
        placed = classes.select("cid", "raw", "mult").join(linked.select(F.col("node").alias("cid"), F.col("component").alias("g")), "cid", "left").withColumn("g", F.coalesce("g", "cid"))
        if whole:
            break
        comp = {r["cid"]: r["g"] for r in placed.join(classes.orderBy(F.xxhash64("rep"), "cid").limit(AUDIT_ROWS).select("cid"), "cid").select("cid", "g").collect()}
        asked = [(r["cid"], comp[r["cid"]], bytes(r["raw"])) for r in lowest]
        seen = placed.select("cid", "g", "raw").mapInArrow(_audit(asked, threshold), "cid long, true long, found long").groupBy("cid").agg(F.sum("true").alias("t"), F.sum("found").alias("f")).collect()
        if least_recall([(r["t"], r["f"]) for r in seen]) >= target:
            break
        whole = done >= most_rounds

    sizes = linked.groupBy("component").agg(F.count("*").alias("n"))
    members = placed.join(sizes, F.col("g") == F.col("component"))
    many = F.ceil(F.col("n") / F.lit(block)).cast("int")
    split = members.withColumn("many", many).withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("many")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    pairs = split.select("g", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "cid", "mult", "raw").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    judged = saved(pairs.mapInArrow(_compare(threshold), "a long, b long, w long"), "judged")
    links = judged.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("w").alias("links"))
    joined = components(judged.where("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    reps = joined.join(classes.select("cid", "rep"), "cid").groupBy("component").agg(F.min("rep").alias("least"))
    final = classes.join(joined.join(reps, "component").select("cid", "least"), "cid", "left").join(links, "cid", "left")
    answer = final.select(F.col("key").alias("c_key"), F.when(F.col("least").isNull(), F.col("rep")).otherwise(F.col("least")).alias("root"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"))
    out = rows.select("vec_id", "key").join(answer, F.col("key") == F.col("c_key"), "left")
    component = F.when(F.col("c_key").isNull(), F.col("vec_id")).otherwise(F.col("root"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
