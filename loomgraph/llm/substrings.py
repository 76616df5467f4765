"""Exact substring deduplication by seed and extend: documents meet at winnowed anchors, matches grow both ways from there,
and the maximal repeats that are long enough are cut."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Saved, tidy
from .textkernel import Words, batches, gram_hashes, once

#: Places of one anchor that are compared pair by pair at most; more are extended all at once, by window.
PAIRED = 64
#: Pairs compared at once.
STEP = 1 << 15

SEED = 10
EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(words: Words, window: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed seeds: hashes of all runs of ``seed`` words, the word each starts at, and for every window of ``window``
    words (by the word it starts at) the run chosen in it: the one of least hash, the last of equals.

    The choice depends on the window's words alone, so equal windows choose equal runs at equal places.
    """
    grams, at = words.grams(seed)
    width = window - seed + 1
    if len(grams) < width:
        return grams, at, np.zeros(0, np.int64), np.zeros(0, np.int64)
    docs = words.doc[at]
    whole = np.flatnonzero(docs[: len(docs) - width + 1] == docs[width - 1 :])
    best = width - 1 - sliding_window_view(grams, width)[:, ::-1].argmin(axis=1)
    return grams, at, at[whole], whole + best[whole]


def _seeds(window: int):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(items):
            words = Words(batch.column("text"))
            grams, at, _, chosen = anchors(words, window)
            chosen = np.unique(chosen)
            docs = words.doc[at[chosen]] if len(chosen) else np.zeros(0, np.int64)
            bounds = np.searchsorted(docs, np.arange(batch.num_rows + 1))
            place = at[chosen] - words.bounds[docs] if len(chosen) else docs
            offs = pa.array(bounds, pa.int32())
            raw = words.raw.tobytes()
            shas = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(words.offs[:-1].tolist(), words.offs[1:].tolist(), strict=True)]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("text_id"),
                    pa.array(np.diff(words.bounds), pa.int64()),
                    pa.array(shas, pa.string()),
                    pa.ListArray.from_arrays(offs, pa.array(grams[chosen].astype(np.int64))),
                    pa.ListArray.from_arrays(offs, pa.array(place, pa.int32())),
                ],
                ["doc_id", "text_id", "n_words", "whole_sha", "seeds", "places"],
            )

    return run


def _contexts(window: int):
    """Of each place of an anchor: the word hashes that a window around it can hold to the left (nearest first) and right."""
    side = window - SEED

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(items):
            words = Words(batch.column("text"))
            lists, seeds, few = batch.column("places"), batch.column("seeds").flatten(), batch.column("few").flatten().to_numpy(zero_copy_only=False).astype(bool)
            doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))[few]
            place = lists.flatten().to_numpy(zero_copy_only=False)[few]
            at = words.bounds[doc] + place
            steps = np.arange(side)
            padded = np.concatenate([words.hash, np.zeros(1, np.uint64)])
            near = at[:, None] - 1 - steps[None, :]
            left = padded[np.where(near >= words.bounds[doc][:, None], near, len(words.hash))]
            near = at[:, None] + SEED + steps[None, :]
            right = padded[np.where(near < words.bounds[doc + 1][:, None], near, len(words.hash))]
            raw = np.ascontiguousarray(np.concatenate([left, right], axis=1)).tobytes()
            width = 16 * side
            yield pa.record_batch(
                [seeds.filter(pa.array(few)), batch.column("cid").take(pa.array(doc)), pa.array(place, pa.int32()), pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())],
                ["seed", "cid", "place", "around"],
            )

    return run


def match_lengths(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many leading columns of each row of one equal those of two; 0 stands for no word and matches nothing."""
    differ = (one != two) | (one == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), one.shape[1])


def _extend(window: int):
    """Every two places of an anchor, extended word by word to both sides; of each place the longest repeat found there."""
    side = window - SEED

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(items, "seed"):
            n = batch.num_rows
            seed, cid, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("seed", "cid", "place"))
            around = np.frombuffer(b"".join(batch.column("around").to_pylist()), np.uint64).reshape(n, 2 * side)
            starts = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
            last = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
            later = last - np.arange(n) - 1  # partners after each row in its group
            left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
            ends = np.cumsum(later)
            for lo in range(0, int(ends[-1]) if n else 0, STEP):
                pair = np.arange(lo, min(lo + STEP, int(ends[-1])))
                x = np.searchsorted(ends, pair, "right")
                y = x + 1 + pair - (ends[x] - later[x])
                l, r = match_lengths(around[x, :side], around[y, :side]), match_lengths(around[x, side:], around[y, side:])
                long = l + r >= side  # with the anchor, a repeat of window words
                for rows in (x[long], y[long]):
                    np.maximum.at(left, rows, l[long])
                    np.maximum.at(right, rows, r[long])
            hit = np.flatnonzero(left + right >= side)
            yield pa.record_batch([pa.array(cid[hit]), pa.array(place[hit] - left[hit], pa.int64()), pa.array(place[hit] + SEED + right[hit], pa.int64())], ["cid", "low", "high"])

    return run


def _whole_groups(items: Iterator[pa.RecordBatch], key: str, rows: int = 8192) -> Iterator[pa.Table]:
    """The rows, sorted by key, in tables of about so many rows that end where a key ends."""
    held: list[pa.RecordBatch] = []
    for batch in items:
        lo = 0
        while lo < batch.num_rows:
            part = batch.slice(lo, rows)
            lo += part.num_rows
            values = part.column(key).to_numpy(zero_copy_only=False)
            if held:
                last = held[-1].column(key)[held[-1].num_rows - 1].as_py()
                same = int(np.searchsorted(values != last, True)) if values[-1] != last else len(values)
                if same < len(values) and sum(b.num_rows for b in held) + same >= rows:
                    held.append(part.slice(0, same))
                    yield pa.Table.from_batches(held)
                    held = [part.slice(same)]
                    continue
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _windows(window: int):
    """Windows around the anchors of many places: two hashes of all their words, that is of the anchor extended to each side."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(items):
            words = Words(batch.column("text"), seeds=(7, 11))
            _, at, starts, chosen = anchors(words, window)
            hot = np.zeros(len(words.hash), bool)
            lists, many = batch.column("places"), ~batch.column("few").flatten().to_numpy(zero_copy_only=False).astype(bool)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            hot[(np.repeat(words.bounds[:-1], lists.value_lengths().to_numpy(zero_copy_only=False)) + flat)[many]] = True
            keep = hot[at[chosen]] if len(chosen) else np.zeros(0, bool)
            starts = starts[keep]
            one, first = gram_hashes(words.hashes[0], words.doc, window)
            two, _ = gram_hashes(words.hashes[1], words.doc, window)
            index = np.searchsorted(first, starts)
            docs = words.doc[starts] if len(starts) else np.zeros(0, np.int64)
            yield pa.record_batch(
                [pa.array(one[index].astype(np.int64)), pa.array(two[index].astype(np.int64)), batch.column("cid").take(pa.array(docs)), pa.array(starts - words.bounds[docs] if len(starts) else docs, pa.int64())],
                ["h1", "h2", "cid", "at"],
            )

    return run


def _cut():
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(items):
            words = Words(batch.column("text"))
            low, high = (batch.column(c) for c in ("low", "high"))
            base = np.repeat(words.bounds[:-1], low.value_lengths().to_numpy(zero_copy_only=False))
            change = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(change, base + low.flatten().to_numpy(zero_copy_only=False), 1)
            np.add.at(change, base + high.flatten().to_numpy(zero_copy_only=False), -1)
            gone = np.cumsum(change)[:-1] > 0
            removed = np.add.reduceat(np.append(gone, False), words.bounds[:-1]) * (np.diff(words.bounds) > 0)
            raw, shas, kept = words.raw.tobytes(), [], []
            for lo, hi in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
                stay = np.flatnonzero(~gone[lo:hi]) + lo
                joined = b" ".join([raw[a:b] for a, b in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)])
                shas.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode())
            yield pa.record_batch([batch.column("cid"), pa.array(removed, pa.int64()), pa.array(shas), pa.array(kept)], ["cid", "n_removed", "sha", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = 35, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row: words in a run of ``window`` words that starts anywhere else
    are removed; with ``texts``, also kept_text of the texts that changed in part (null where all or nothing stays).

    Anchors are runs of SEED words, winnowed so that every window chooses one, by its own words alone: equal windows hold
    one anchor at one place, and an anchor found once in the corpus lies in no repeated window. The places of an anchor
    are brought together with the words around them, every two of them are extended word by word to both sides as far as
    a window can reach, and a match of ``window`` words or more is a repeat at both; at each place the longest to either
    side stays, and overlapping ones join into the maximal repeats that are cut. An anchor with more than PAIRED places
    would make their square of pairs: there all extensions are taken at once, each window around the anchor compared
    whole by 128 bits of hash and counted with map-side combination, which finds the same words.

    Copies of a text are one row of the search; all their words go if there are enough for one window. Null text: no
    words. Null doc_id: kept. Repeated rows are copies. Very long texts are searched whole. Ties: all places of a repeat
    are cut, none is preferred. Empty table: no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("text_id", F.unhex(F.md5("text")))
    rows = Saved(own.mapInArrow(_seeds(window), "doc_id long, text_id binary, n_words long, whole_sha string, seeds array<long>, places array<int>"), "seeds").df
    copies = rows.groupBy("text_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("mult"))
    classes = Saved(copies.select(F.col("text_id").alias("k_text"), "rep", "mult", F.monotonically_increasing_id().alias("cid")), "copies").df
    one = rows.where("size(seeds) > 0").join(classes, (F.col("text_id") == F.col("k_text")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    reps = Saved(one.dropDuplicates(["cid"]).select("cid", F.arrays_zip("seeds", "places").alias("z")), "reps")
    tidy(spark)
    flat = reps.df.select("cid", F.explode("z").alias("z")).select("cid", F.col("z.seeds").alias("seed"), F.col("z.places").alias("place"))
    # written, so that the join sees two plain exchanges and a seed of very many places can be split at run time
    often = Saved(flat.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed", (F.col("n") <= PAIRED).alias("few")), "often")
    found = flat.join(often.df, "seed").select("cid", F.struct("place", "seed", "few").alias("z"))
    gathered = Saved(found.groupBy("cid").agg(F.collect_list("z").alias("z")), "places")
    reps.drop()
    tidy(spark)
    wanted = gathered.df.join(classes, "cid").hint("shuffle_hash")
    held = own.join(wanted, own["doc_id"].eqNullSafe(wanted["rep"]) & (own["text_id"] == wanted["k_text"]))
    parts = held.select("cid", "mult", "text", F.col("z.place").alias("places"), F.col("z.seed").alias("seeds"), F.col("z.few").alias("few"))
    made = Saved(parts.mapInArrow(once, parts.schema), "held")
    tidy(spark)

    around = made.df.where(F.exists("few", lambda x: x)).select("cid", "text", "places", "seeds", "few").mapInArrow(_contexts(window), "seed long, cid long, place int, around binary")
    paired = Saved(around.repartition("seed").sortWithinPartitions("seed").mapInArrow(_extend(window), "cid long, low long, high long"), "paired")
    tidy(spark)
    crowded = made.df.where(F.exists("few", lambda x: ~x)).select("cid", "text", "places", "few").mapInArrow(_windows(window), "h1 long, h2 long, cid long, at long")
    windows = Saved(crowded, "windows")
    again = Saved(windows.df.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "again")
    repeated = windows.df.join(again.df, ["h1", "h2"], "left_semi").select("cid", F.col("at").alias("low"), (F.col("at") + window).alias("high"))
    spans = paired.df.union(repeated).groupBy("cid").agg(F.collect_list(F.struct("low", "high")).alias("z"))
    ranges = Saved(spans.select(F.col("cid").alias("r_cid"), F.col("z.low").alias("low"), F.col("z.high").alias("high")), "ranges")
    for x in (often, gathered, paired, windows, again):
        x.drop()
    tidy(spark)
    cut_in = made.df.where("mult = 1").select("cid", "text").join(ranges.df.hint("shuffle_hash"), F.col("cid") == F.col("r_cid"))
    cut = Saved(cut_in.select("cid", "text", "low", "high").mapInArrow(_cut(), "cid long, n_removed long, sha string, kept_text string"), "cut").df
    made.drop()
    ranges.drop()
    tidy(spark)
    cut = cut if texts else cut.drop("kept_text")
    final = rows.select("doc_id", "text_id", "n_words", "whole_sha").join(classes, F.col("text_id") == F.col("k_text")).join(cut, "cid", "left")
    copied = (F.col("mult") > 1) & (F.col("n_words") >= window)
    return final.select(
        "doc_id",
        "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(EMPTY)).otherwise(F.coalesce("sha", "whole_sha")).alias("kept_sha256"),
        *(["kept_text"] if texts else []),
    )
