"""Near-duplicate join on word n-grams: an LSH forest of MinHash signatures, then exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph.components import components
from ..runtime import Saved, saved, tidy
from .textkernel import Words, across, batches, mix, once, runs, spanning

TREES, DEEPEST = 16, 8
#: Texts of the recall audit, at most: those of the lowest hashes of their text, of no more characters than AUDIT_CHARS.
AUDIT_ROWS, AUDIT_CHARS = 400, 20_000
#: Pairs of a shingle and an asked text counted at once.
PAIRS = 1 << 20
#: A pair of a bucket is a candidate if its signatures agree in a share of places within SLACK of the threshold; a pair at
#: 0.8 fails that once in 1e8.
SLACK = 0.2
_RNG = np.random.Generator(np.random.PCG64(90210))
_A = _RNG.integers(1, 1 << 63, TREES * DEEPEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TREES * DEEPEST, dtype=np.uint64)
_STEP = 4096


def expected_recall(threshold: float, depth: int, trees: int = TREES) -> float:
    """The probability that a pair at the threshold shares a prefix of depth in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of TREES * DEEPEST minimum hashes (32 bits) for each set hashes[bounds[i]:bounds[i + 1]]; all ones if empty."""
    out = np.full((len(bounds) - 1, TREES * DEEPEST), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(hashes), _STEP):
        part = hashes[lo : lo + _STEP]
        first, last = np.searchsorted(bounds, lo, "right") - 1, np.searchsorted(bounds, lo + len(part), "left")
        starts = np.maximum(bounds[first:last], lo) - lo
        full = np.flatnonzero(np.diff(np.append(starts, len(part))) > 0)
        with np.errstate(over="ignore"):
            values = ((part[:, None] * _A[None, :] + _B[None, :]) >> np.uint64(32)).astype(np.uint32)
        lows = np.minimum.reduceat(values, starts[full], axis=0)
        out[first + full] = np.minimum(out[first + full], lows)
    return out


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each text (of all its words if it has fewer), and their bounds."""
    words = Words(column)
    grams, at = words.grams(k)
    docs = words.doc[at]
    n = len(words.bounds) - 1
    sizes = np.diff(words.bounds)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        sums = np.array([int(mix(np.array([len(h) + 1], np.uint64))[0]) ^ _fold(h) for h in (words.hash[words.bounds[i] : words.bounds[i + 1]] for i in short)], np.uint64)
        grams, docs = np.concatenate([grams, sums]), np.concatenate([docs, short])
        order = np.argsort(docs, kind="stable")
        grams, docs = grams[order], docs[order]
    return grams, np.searchsorted(docs, np.arange(n + 1), "left")


def _fold(hashes: np.ndarray) -> int:
    made = 1469598103934665603
    for h in hashes.tolist():
        made = ((made ^ h) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return made


def _sign(k: int):
    """Of each text: the signature, a row of big-endian 32-bit labels a tree, and one byte of each label as a sketch."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(items):
            grams, bounds = shingle_sets(batch.column("text"), k)
            rows = signatures(grams, bounds)
            some = np.diff(bounds) > 0
            labels = rows.astype(">u4")
            small = np.ascontiguousarray((rows & 0xFF).astype(np.uint8))
            whole, brief = (pa.array([m[i].tobytes() if some[i] else None for i in range(len(rows))], pa.binary()) for m in (labels, small))
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_id"), whole, brief], ["doc_id", "text_id", "labels", "sketch"])

    return run


def _prefixes(depth: int):
    """A row a text and tree: the hash of its prefix of depth labels (g), and the labels below it."""
    power = _A[:DEEPEST]
    seeds = mix(np.arange(1, TREES + 1, dtype=np.uint64))

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            n = batch.num_rows
            rows = np.frombuffer(b"".join(batch.column("labels").to_pylist()), ">u4").reshape(n, TREES, DEEPEST)
            with np.errstate(over="ignore"):
                keys = mix((rows[:, :, :depth].astype(np.uint64) * power[:depth]).sum(axis=2, dtype=np.uint64) + seeds)
            below = np.ascontiguousarray(rows[:, :, depth:])
            width = 4 * (DEEPEST - depth)
            raw = below.tobytes()
            rest = pa.array([raw[i : i + width] for i in range(0, len(raw), width)] if width else [b""] * (n * TREES), pa.binary())
            yield pa.record_batch([pa.array(keys.astype(np.int64).ravel()), batch.column("cid").take(pa.array(np.repeat(np.arange(n), TREES))), rest], ["g", "cid", "rest"])

    return run


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows (with n, the rows of their group g, and cid) dealt to pairs of blocks of about size rows: columns i <= j, blk.

    Every two rows of a group meet in exactly one pair of blocks (rows of one block in i = j), and no task holds more
    than two blocks however large the group is.
    """
    many = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(size))).cast("int")
    dealt = rows.withColumn("many", many).withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("many")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).withColumn("i", F.least("blk", "other")).withColumn("j", F.greatest("blk", "other")).drop("other", "many", "n")


def trie_links(rest: list[bytes], sketch: np.ndarray, apart: np.ndarray | None, least: float) -> list[tuple[int, int]]:
    """Spanning links among texts of one subtree of a trie, sorted by their labels below its root.

    Matches are taken at the longest prefix first, and the prefix is shortened a label at a time down to the root of the
    subtree; at each length only texts that no longer prefix has joined are compared, by their sketches. apart: the block
    of each text, where only links between blocks are wanted; texts of one block are joined first, as their own task does.
    """
    n = len(rest)
    root, kept = np.arange(n), []
    for across in (False,) if apart is None else (False, True):
        for width in range(len(rest[0]) if n else 0, -1, -4):
            cut = [0, *(i for i in range(1, n) if rest[i][:width] != rest[i - 1][:width]), n]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if (root[lo:hi] == root[lo]).all():
                    continue
                for x in range(lo, hi - 1):
                    y = np.flatnonzero(root[x + 1 : hi] != root[x]) + x + 1
                    if apart is not None:
                        y = y[(apart[y] != apart[x]) == across]
                    if not len(y):
                        continue
                    y = y[(sketch[y] == sketch[x]).mean(axis=1) >= least]
                    for z in y.tolist():
                        if root[z] != root[x]:
                            if across or apart is None:
                                kept.append((x, z))
                            root[root == root[z]] = root[x]
    return kept


def _bucket_links(least: float):
    """Links that span the candidates of each block pair of each bucket."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in runs(items, ["g", "i", "j"]):
            n = group.num_rows
            if n > 1:
                cid, blk = group.column("cid").to_numpy(), group.column("blk").to_numpy()
                sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(n, -1)
                cross = group.column("i")[0].as_py() != group.column("j")[0].as_py()
                for x, y in trie_links(group.column("rest").to_pylist(), sketch, blk if cross else None, least):
                    a.append(cid[x])
                    b.append(cid[y])
            if len(a) > 4096:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def common_counts(grams: np.ndarray, docs: np.ndarray, n: int, width: int = 4096) -> np.ndarray:
    """The n x n table of how many distinct grams two docs share, by products of blocks of columns."""
    _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    column, docs = number[column[shared]], docs[shared]
    order = np.argsort(column, kind="stable")
    column, docs = column[order], docs[order]
    out = np.zeros((n, n), np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        p, q = np.searchsorted(column, [lo, lo + width])
        table = np.zeros((n, width), np.float32)
        table[docs[p:q], column[p:q] - lo] = 1
        out += table @ table.T
    return out.astype(np.int64)


def set_rows(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted within it, and their bounds."""
    grams, bounds = shingle_sets(column, k)
    docs = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((grams, docs))
    grams, docs = grams[order], docs[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
    return grams[new], np.searchsorted(docs[new], np.arange(len(bounds)))


def _differences(k: int):
    """Of each member of a cluster's block: how many shingles it has, which of its block's first text it has not, and which it has besides.

    The first text of every block is one and the same text of the cluster, so two members share as many shingles as the
    first text has, less those either of them misses, plus those both have besides.
    """

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(items, ["g", "blk"]):
            first = group.column("lead").to_pylist().index(True)
            texts, cids, mult, lead = (group.column(c) for c in ("text", "cid", "mult", "lead"))
            base = np.unique(shingle_sets(texts.slice(first, 1).combine_chunks(), k)[0])
            own = [i for i, x in enumerate(lead.to_pylist()) if not x]
            table = group.take(pa.array(own, pa.int64()))
            for batch in table.combine_chunks().to_batches():
                for part in batches(iter([batch])):
                    grams, bounds = set_rows(part.column("text"), k)
                    at = np.minimum(np.searchsorted(base, grams), max(len(base) - 1, 0))
                    shared = base[at] == grams if len(base) else np.zeros(len(grams), bool)
                    miss, more = [], []
                    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        gone = np.ones(len(base), bool)
                        gone[at[lo:hi][shared[lo:hi]]] = False
                        miss.append(base[gone].tobytes())
                        more.append(grams[lo:hi][~shared[lo:hi]].tobytes())
                    yield pa.record_batch(
                        [*(part.column(c) for c in ("g", "blk", "cid", "mult")), pa.array(np.diff(bounds), pa.int64()), pa.array(np.full(part.num_rows, len(base), np.int64)), pa.array(miss, pa.binary()), pa.array(more, pa.binary())],
                        ["g", "blk", "cid", "mult", "size", "base", "miss", "more"],
                    )

    return run


def _verify(threshold: float):
    """Exact similarity of every pair of a cluster's block pair: link counts of each text and spanning links."""
    part = Fraction(threshold).limit_denominator(10_000)

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["a", "b", "w"])

        def shared(group: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
            rows = group.column(name).to_pylist()
            counts = np.array([len(r) // 8 for r in rows], np.int64)
            grams = np.frombuffer(b"".join(rows), np.uint64)
            return counts, common_counts(grams, np.repeat(np.arange(len(rows)), counts), len(rows))

        for group in runs(items, ["g", "i", "j"]):
            n = group.num_rows
            if n > 1:
                cid, blk, mult, size = (group.column(c).to_numpy() for c in ("cid", "blk", "mult", "size"))
                missing, both_miss = shared(group, "miss")
                _, both_more = shared(group, "more")
                both = group.column("base")[0].as_py() - missing[:, None] - missing[None, :] + both_miss + both_more
                link = (both > 0) & (both * (part.numerator + part.denominator) >= part.numerator * (size[:, None] + size[None, :]))
                np.fill_diagonal(link, False)
                if group.column("i")[0].as_py() != group.column("j")[0].as_py():
                    p, q = across(link, blk)
                    link &= blk[:, None] != blk[None, :]
                else:
                    p, q = spanning(link)
                weight = link @ mult
                out += [(int(c), None, int(w)) for c, w in zip(cid, weight, strict=True) if w]
                out += [(x, y, 0) for x, y in zip(cid[p].tolist(), cid[q].tolist(), strict=True)]
            if len(out) > 4096:
                yield made()
                out.clear()
        yield made()

    return run


def _audit(asked: list[tuple[int, np.ndarray]], k: int, threshold: float):
    """Links of each asked text to all others, by shingles counted against every text."""
    part = Fraction(threshold).limit_denominator(10_000)
    known = np.unique(np.concatenate([s for _, s in asked]))
    owner = np.concatenate([np.full(len(s), i) for i, (_, s) in enumerate(asked)])
    place = np.searchsorted(known, np.concatenate([s for _, s in asked]))
    order = np.argsort(place, kind="stable")
    owner, begin = owner[order], np.searchsorted(place[order], np.arange(len(known) + 1))
    sizes, cids = np.array([len(s) for _, s in asked]), np.array([c for c, _ in asked])
    maybe = np.zeros(1 << 24, bool)  # by the upper bits, before the search
    maybe[known >> np.uint64(40)] = True

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(items):
            grams, bounds = shingle_sets(batch.column("text"), k)
            hit = np.flatnonzero(maybe[grams >> np.uint64(40)])
            at = np.minimum(np.searchsorted(known, grams[hit]), len(known) - 1)
            same = known[at] == grams[hit]
            doc = np.searchsorted(bounds, hit[same], "right") - 1
            once_each = np.unique(doc * len(known) + at[same])
            doc, at = once_each // len(known), once_each % len(known)
            times = begin[at + 1] - begin[at]
            pairs, counts = [], []
            firsts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
            work = np.add.reduceat(times, firsts) if len(doc) else firsts
            group = np.cumsum(work) // PAIRS  # whole texts, of about so many pairs of a shingle and an asked text
            edges = [*firsts[np.flatnonzero(np.diff(group, prepend=-1))].tolist(), len(doc)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                many = times[lo:hi]
                index = np.repeat(begin[at[lo:hi]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                found = np.unique(np.repeat(doc[lo:hi], many) * len(asked) + owner[index], return_counts=True)
                pairs.append(found[0])
                counts.append(found[1])
            pair, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pairs, counts))
            d, q = pair // len(asked), pair % len(asked)
            enough = count * part.denominator >= part.numerator * sizes[q]  # a link shares this much of either set
            d, q, count = d[enough], q[enough], count[enough]
            own = {int(x): len(np.unique(grams[bounds[x] : bounds[x + 1]])) for x in np.unique(d)}
            whole = np.array([own[int(x)] for x in d], np.int64) + sizes[q]
            link = count * (part.numerator + part.denominator) >= part.numerator * whole
            yield pa.record_batch([pa.array(cids[q][link]), batch.column("text_id").take(pa.array(d[link]))], ["a", "m_text"])

    return run


def link_classes(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 256) -> DataFrame:
    """doc_id, text_id (md5 of the text), class_id, n_links of every row of docs.

    Rows of one text are copies: one class of them goes through the search, and counts as many as it has. Two different
    texts are linked if the Jaccard similarity of their sets of runs of ``words`` words (of all words, for a shorter
    text) is at least ``threshold``. class_id is the least doc_id among all rows reachable by links or copies; n_links
    the number of other rows linked directly, copies included.

    The forest has TREES tries of signatures of DEEPEST labels, kept as sorted keys. A round brings together the texts
    that share a prefix in a trie; in its subtree matches are taken at the longest prefix first, and the prefix is
    shortened a label at a time (trie_links()). How short it gets is found by measuring: it starts at the longest whose
    expected recall at the threshold is ``recall``, then every link of AUDIT_ROWS texts, counted by brute force, is
    looked up in the clusters, and while fewer than ``recall`` of them are there, for texts with few links and with many
    alike, all tries are cut a label shorter and joined again. Depth 0 is one bucket, that is every pair.

    Clusters are verified exactly: within one every pair is compared, by how each text differs from one text of the
    cluster, so that a large cluster of near copies moves short lists and not texts. Buckets and clusters are dealt to
    pairs of blocks of ``block`` texts, so a group with a third of all rows is many small tasks; a task returns link
    counts and spanning links, never all pairs.

    Null text is an empty text. Texts without words link with their copies only. Very long texts are compared whole.
    Ties: a similarity of exactly ``threshold`` is a link (integer arithmetic). Null doc_id: compared like any other (a
    class of nothing but null ids has a null class_id). Repeated rows are copies. Empty table: no rows. Extra columns
    are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("text_id", F.unhex(F.md5("text")))
    signed = saved(own.mapInArrow(_sign(words), "doc_id long, text_id binary, labels binary, sketch binary"), "signed")
    copies = signed.groupBy("text_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("mult"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch"))
    classes = saved(copies.withColumn("cid", F.monotonically_increasing_id()), "classes")
    filled = classes.where("labels is not null")

    def text_of(some: DataFrame) -> DataFrame:
        """text beside the columns of some, which has cid, text_id and rep; one row of each cid."""
        wanted = some.withColumnRenamed("text_id", "m_text").hint("shuffle_hash")
        both = own.join(wanted, own["doc_id"].eqNullSafe(wanted["rep"]) & (own["text_id"] == wanted["m_text"])).drop("doc_id", "text_id", "m_text", "rep")
        return both.mapInArrow(once, both.schema)

    depth = DEEPEST
    while depth > 1 and expected_recall(threshold, depth) < recall:
        depth -= 1
    true: DataFrame | None = None
    links: Saved | None = None
    while True:
        thin = filled.select("cid", "labels").mapInArrow(_prefixes(depth), "g long, cid long, rest binary") if depth else filled.select(F.lit(0).cast("long").alias("g"), "cid", F.expr("binary('')").alias("rest"))
        shared = Saved(thin.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "shared")
        hits = thin.join(shared.df, "g").join(filled.select("cid", "sketch"), "cid")
        buckets = _blocks(hits, block).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "rest")
        found = buckets.select("g", "i", "j", "blk", "cid", "rest", "sketch").mapInArrow(_bucket_links(threshold - SLACK), "a long, b long")
        old, links = links, Saved((found if links is None else found.union(links.df)).distinct(), "links")
        clusters = saved(components(links.df).withColumnRenamed("node", "cid").withColumnRenamed("component", "g"), "clusters")
        shared.drop()
        if old is not None:
            old.drop()
        tidy(spark)
        if not depth:
            break
        if true is None:
            true = saved(_audited(classes, text_of, own, words, threshold), "audit")
        held = true.join(clusters.select(F.col("cid").alias("a"), F.col("g").alias("ga")), "a", "left").join(clusters.select(F.col("cid").alias("b"), F.col("g").alias("gb")), "b", "left")
        rows = held.groupBy("a").agg(F.count("*").alias("t"), F.sum(F.coalesce(F.col("ga") == F.col("gb"), F.lit(False)).cast("int")).alias("f")).collect()
        if least_recall([(r["t"], r["f"]) for r in rows]) >= recall:
            break
        depth -= 1

    counts = Saved(clusters.groupBy("g").agg(F.count("*").alias("n"), F.min("cid").alias("lead_cid")), "sizes").df
    members = clusters.join(counts, "g").join(classes.select("cid", "text_id", "rep", "mult"), "cid")
    texts = Saved(text_of(members), "members")
    many = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block))).cast("int")
    dealt = texts.df.withColumn("many", many)
    plain = dealt.select("g", F.pmod(F.xxhash64("cid"), F.col("many")).cast("int").alias("blk"), "n", "cid", "mult", "text", F.lit(False).alias("lead"))
    leads = dealt.where("cid = lead_cid").select("g", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("blk"), "n", "cid", "mult", "text", F.lit(True).alias("lead"))
    grouped = plain.union(leads).repartition("g", "blk").sortWithinPartitions("g", "blk")
    short = Saved(grouped.mapInArrow(_differences(words), "g long, blk int, cid long, mult long, size long, base long, miss binary, more binary"), "differences")
    tidy(spark)
    pairs = _blocks(short.df.join(counts.select("g", "n"), "g"), block).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    judged = saved(pairs.select("g", "i", "j", "blk", "cid", "mult", "size", "base", "miss", "more").mapInArrow(_verify(threshold), "a long, b long, w long"), "judged")
    for x in (texts, short, links):
        x.drop()
    tidy(spark)

    linked = judged.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("w").alias("links"))
    joined = components(judged.where("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    reps = joined.join(classes.select("cid", "rep"), "cid").groupBy("component").agg(F.min("rep").alias("least"))
    place = joined.join(reps, "component").select("cid", "least")
    final = classes.join(place, "cid", "left").join(linked, "cid", "left").select(
        F.col("text_id").alias("c_text"),
        F.when(F.col("least").isNull(), F.col("rep")).otherwise(F.col("least")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"),
    )
    return signed.select("doc_id", "text_id").join(final, F.col("text_id") == F.col("c_text")).select("doc_id", "text_id", "class_id", "n_links")


def least_recall(rows: list[tuple[int, int]]) -> float:
    """The least mean recall of texts with about as many links (1, 2-3, 4-7, ...); rows: links, and those found, of each."""
    strata: dict[int, list[float]] = {}
    for true, found in rows:
        strata.setdefault(true.bit_length(), []).append(found / true)
    return min((sum(x) / len(x) for x in strata.values()), default=1.0)


def _audited(classes: DataFrame, text_of, own: DataFrame, words: int, threshold: float) -> DataFrame:
    """(a, b): every link of the texts of the audit, counted against all texts; class ids."""
    lowest = classes.where("labels is not null").orderBy(F.xxhash64("text_id"), "cid").limit(AUDIT_ROWS).select("cid", "text_id", "rep")
    rows = text_of(lowest).where(F.length("text") <= AUDIT_CHARS).select("cid", "text").mapInArrow(_sets(words), "cid long, shingles binary").collect()
    asked = [(r["cid"], np.frombuffer(r["shingles"], np.uint64)) for r in sorted(rows, key=lambda r: r["cid"])]
    if not asked:
        return classes.sparkSession.createDataFrame([], "a long, b long")
    found = own.select("text_id", "text").mapInArrow(_audit(asked, words, threshold), "a long, m_text binary").distinct()
    return found.join(classes, F.col("m_text") == F.col("text_id")).select("a", F.col("cid").alias("b")).where("a <> b")


def _sets(k: int):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(items):
            grams, bounds = set_rows(batch.column("text"), k)
            sets = [grams[lo:hi].tobytes() for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column("cid"), pa.array(sets, pa.binary())], ["cid", "shingles"])

    return run


def keep_one(docs: DataFrame, **options: object) -> DataFrame:
    """One row of docs for each class of link_classes(): that of the least doc_id, unchanged, with columns of any names.

    Where several rows have that doc_id, one of them stays; classes without any doc_id keep one row each text.
    """
    linked = link_classes(docs, **options)
    keep = linked.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "text_id").distinct()
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").cast("long").alias("id"), F.unhex(F.md5(F.coalesce(F.col("row.text").cast("string"), F.lit("")))).alias("own"))
    both = rows.join(keep.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("text_id")))
    first = Window.partitionBy("id", "own").orderBy(*[F.col("row").getField(c) for c in docs.columns if c != "text"])
    return both.withColumn("turn", F.row_number().over(first)).where("turn = 1").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
