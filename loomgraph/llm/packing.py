"""Vector best-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import saved
from .textkernel import batches

#: Words whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 800_000


class WordIds(dict):
    """Ids of a word as little-endian unsigned 32-bit bytes, remembered.

    The tokenizer drops white space and never joins what it separates, so a text's ids are its words' ids in a row. It
    lower-cases after looking for added tokens and after composing marks (J with a caron has no composed form, j has), so
    A-Z may be lowered first only where neither is concerned: texts that hold an added token in any case are encoded
    whole, and the words of texts with combining marks keep their case.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.folded = [x.content.encode().lower() for x in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if len(text) > 1 and text[-1] in ",." and text[-2].isascii() and text[-2].isalpha():  # the tokenizer always splits these two apart
            ids = self[word[:-1]] + self[word[-1:]]
        else:
            ids = self.encode(text)
        self[word] = ids
        return ids

    def text(self, raw: bytes) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        low = raw.lower()  # bytes.lower() does A-Z
        if any(x in low for x in self.folded):
            return self.encode(raw.decode())
        marks = b"\xcc" in raw or b"\xcd" in raw  # U+0300 to U+037F begin with these bytes
        return b"".join(map(self.__getitem__, (raw if marks else low).split()))


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of at most capacity ids; null text: only the end id."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end, width = _word_ids(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches(items, size=16 << 20):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer() if text.is_valid else None
                ids = (ids_of.text(raw.to_pybytes()) if raw is not None else b"") + end
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    rows.append((doc, k // width, k // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def plan_bins(counts: dict[int, int], tokens: int, documents: int, attention: int, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> pd.DataFrame:
    """Best-fit of counts[length] items of each length, longest first, for bins with three capacities.

    An item of length n takes n tokens, one document and n * n attention cost. Of the bins in which it fits under every
    capacity, rule "norm" picks the one that leaves the least weighted residual norm, "dot" the one whose residual has the
    largest weighted dot product with the item; with none, a bin opens. Bins of equal residuals are one group of
    consecutive ids, so the work depends on the number of lengths (at most ``tokens``), not of items. Under "norm" the
    chosen bin stays the best for the next equal item, so it is filled with as many as fit.

    Returns rows (length, low, high, sequence, per, offset): the items of a length ranked low .. high - 1 go to the
    sequences from ``sequence`` on, ``per`` in each, from place ``offset``.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    caps, w = np.array([tokens, documents, attention], float), np.array(weights, float)
    groups = np.zeros((64, 5), np.int64)  # residual tokens, documents, attention; first id; bins
    used, next_id, out = 0, 0, []

    def add(row: tuple) -> None:
        nonlocal groups, used
        if used == len(groups):
            groups = np.concatenate([groups, np.zeros_like(groups)])
        groups[used] = row
        used += 1

    for n in sorted(counts, reverse=True):
        left, low = int(counts[n]), 0
        item = np.array([n, 1, n * n])
        if left and (item > caps).any():
            raise ValueError(f"an item of length {n} fits in no bin")
        most = lambda rest, item=item: int(min(rest[k] // item[k] for k in range(3)))
        while left:
            live = groups[:used]
            fits = np.flatnonzero((live[:, :3] >= item).all(axis=1) & (live[:, 4] > 0))
            if len(fits):
                rest = live[fits, :3]
                score = (w * ((rest - item) / caps) ** 2).sum(axis=1) if rule == "norm" else -(w * (rest / caps) * (item / caps)).sum(axis=1)
                g = int(fits[np.argmin(score)])
            else:
                per = most(caps.astype(np.int64)) if rule == "norm" else 1
                add((tokens, documents, attention, next_id, -(-left // per)))
                g = used - 1
                next_id += int(groups[g, 4])
            t, d, a, first, bins = (int(x) for x in groups[g])
            per = most((t, d, a)) if rule == "norm" else 1
            whole = min(bins, left // per)
            if whole:
                out.append((n, low, low + whole * per, first, per, tokens - t))
                add((t - per * n, d - per, a - per * n * n, first, whole))
                low, left = low + whole * per, left - whole * per
            else:
                out.append((n, low, low + left, first, left, tokens - t))
                add((t - left * n, d - left, a - left * n * n, first, 1))
                low, left, whole = low + left, 0, 1
            groups[g] = (t, d, a, first + whole, bins - whole)
        if used > 64:  # closed groups go; equal residuals side by side stay apart, which only costs rows
            keep = (groups[:used, 4] > 0) & (groups[:used, 0] > 0) & (groups[:used, 1] > 0)
            packed = groups[:used][keep]
            used = len(packed)
            groups[:used] = packed
    return pd.DataFrame(out, columns=["length", "low", "high", "sequence", "per", "offset"]).astype("int64")


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    end_id: int = 1,
    max_documents: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
    salt_rows: int = 256,
) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` ids, ``max_documents`` pieces and ``max_attention`` cost
    (sum of squared lengths); the defaults of the last two never bind.

    Only the histogram of piece lengths (``capacity`` rows at most) reaches the driver; the plan made of it goes back as a
    broadcast of a few rows a length. Pieces get their rank within their length from counts by (length, salt), with a
    salt for every ``salt_rows`` pieces of the length (for more, where all pieces would make over a million salts), so a
    length that many pieces share is spread over tasks.

    Null text: an empty document, one piece of the end id. Null doc_id: packed like any other. Repeated rows are packed
    each. Empty table: no rows. Very long texts are tokenised whole and cut into pieces of ``capacity``. Ties, that is
    pieces of one length, are ranked by salt, doc_id, piece, crc and start. Extra columns are ignored.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    pieces = saved(tokenized_pieces(docs, tokenizer, capacity, end_id), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    bins = plan_bins(histogram, capacity, max_documents or capacity, max_attention or capacity * capacity, weights, rule)
    plan = docs.sparkSession.createDataFrame(bins, "length long, low long, high long, sequence long, per long, offset long")
    each = max(salt_rows, math.ceil(sum(histogram.values()) / 1_000_000))
    salts = docs.sparkSession.createDataFrame([(n, max(1, math.ceil(count / each))) for n, count in histogram.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    counted = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = counted.select("length", "salt", (F.sum("n").over(order) - F.col("n")).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = salted.withColumn("inside", F.row_number().over(inside) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("inside"))
    r, p = ranked.alias("r"), F.broadcast(plan).alias("p")
    placed = r.join(p, (F.col("r.length") == F.col("p.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    turn = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        F.col("r.length").alias("length"),
        "ids_crc32",
        (F.col("sequence") + F.floor(turn / F.col("per")).cast("long")).alias("sequence_id"),
        (F.col("offset") + F.pmod(turn, F.col("per")) * F.col("r.length")).cast("long").alias("offset"),
    )
