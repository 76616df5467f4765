"""Vectorised words and word hashes of UTF-8 texts, straight on Arrow buffers.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which equals the code-point pattern
``[^\\x20\\x09-\\x0D]+`` because those bytes never occur inside a multi-byte character.

Hashes are sums of random byte values times powers of an odd number, modulo 2**64, so that the hash of any range comes
from two prefix sums; a final mix spreads them. They depend on the bytes alone, so every executor computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Every ASCII character but letters and digits, for words without punctuation.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Bytes of text handled at once; the arrays made on the way take about 40 times as much.
SLICE = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C17 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)


def _bytes(seed: int, lower: bool) -> np.ndarray:
    values = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    if lower:
        values[65:91] = values[97:123]
    return values


_VALUES = {(seed, lower): _bytes(seed, lower) for seed in (7, 11) for lower in (False, True)}
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                own = np.full(size, base, np.uint64)
                own[0] = 1
                _powers[k] = np.multiply.accumulate(own)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (nulls as empty texts) and the n + 1 offsets of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def _span_words(raw: np.ndarray, edges: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of raw; edges: where texts begin (a word never crosses one)."""
    word = ~breaks[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = word[:-1]
    before[edges] = False
    after = np.zeros(len(raw), bool)
    after[:-1] = word[1:]
    after[edges[edges > 0] - 1] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def _cuts(raw: np.ndarray, size: int) -> list[int]:
    """Positions that cut raw into pieces of about size bytes, each at white space or, failing that, anywhere later."""
    cuts, at = [0], size
    while at < len(raw):
        step = 1 << 12
        while at < len(raw):
            found = np.flatnonzero(SPACE[raw[at : at + step]])
            if len(found):
                at += int(found[0])
                break
            at += step
        if at < len(raw):
            cuts.append(at)
        at += size
    return [*cuts, len(raw)]


class Words:
    """The words of some texts: doc (index of the text), start and end (bytes of raw), hash; bounds: first word of each text."""

    def __init__(self, column: pa.Array, lower: bool = False, seeds: tuple[int, ...] = (7,), breaks: np.ndarray = SPACE) -> None:
        self.raw, self.offs = raw, offs = text_buffers(column)
        starts, ends, hashes = [], [], [[] for _ in seeds]
        cuts = _cuts(raw, SLICE)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            edges = offs[np.searchsorted(offs, lo, "left") : np.searchsorted(offs, hi, "left")] - lo
            piece = raw[lo:hi]
            s, e = _span_words(piece, edges, breaks)
            starts.append(s + lo)
            ends.append(e + lo)
            power, inverse = powers(len(piece) + 1)
            for k, seed in enumerate(seeds):
                with np.errstate(over="ignore"):
                    sums = np.zeros(len(piece) + 1, np.uint64)
                    np.cumsum(_VALUES[seed, lower][piece] * power[:-1], out=sums[1:])
                    hashes[k].append(mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)))
        cat = lambda parts, kind: np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, kind)
        self.start, self.end = cat(starts, np.int64), cat(ends, np.int64)
        self.hashes = [cat(h, np.uint64) for h in hashes]
        self.hash = self.hashes[0]
        self.bounds = np.searchsorted(self.start, offs, "left")
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.bounds))

    def grams(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words of one text, and the index of the first word of each."""
        return gram_hashes(self.hashes[which], self.doc, k)


def gram_hashes(values: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k values within one doc, and the index of the first value of each."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    power, inverse = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[:-1], out=sums[1:])
        return mix((sums[at + k] - sums[at]) * inverse[at] + _U(k)), at


def batches(items: Iterator[pa.RecordBatch], text: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of items in batches of about size bytes of text; a longer text is a batch of its own."""
    for batch in items:
        if not batch.num_rows:
            continue
        lengths = np.nan_to_num(np.asarray(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False), float))
        group = (np.cumsum(lengths) // size).astype(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(lo, hi - lo)


def runs(items: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The consecutive rows of equal integer keys, each run as one table; rows must come sorted by keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in items:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(int(c[0]) for c in columns)
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for n, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if held and (n or first != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
        last = tuple(int(c[-1]) for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def once(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each cid of a task, for rows that are repeated and have come to one task by their key."""
    seen: set[int] = set()
    for batch in items:
        keep = []
        for c in batch.column("cid").to_pylist():
            keep.append(c not in seen)
            seen.add(c)
        yield batch.filter(pa.array(keep, pa.bool_()))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph over n nodes with edges a - b."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def spanning(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph with the symmetric matrix link, breadth first."""
    free, a, b = link.any(axis=1), [], []
    while free.any():
        front = np.array([free.argmax()])
        free[front] = False
        while len(front):
            rows = link[front]
            new = np.flatnonzero(rows.any(axis=0) & free)
            a.append(front[rows[:, new].argmax(axis=0)] if len(new) else new)
            b.append(new)
            free[new] = False
            front = new
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def across(link: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks of rows that, with those inside the blocks, span the graph of the symmetric matrix link: as
    few as there are parts to join, not one a row."""
    inside = link & (block[:, None] == block[None, :])
    label = np.arange(len(link))
    for p, q in zip(*(x.tolist() for x in spanning(inside)), strict=True):  # breadth first, so p has its final label
        label[q] = label[p]
    x, y = np.nonzero(np.triu(link & (block[:, None] != block[None, :])))
    _, first = np.unique(label[x] * len(link) + label[y], return_index=True)
    x, y = x[first], y[first]
    kept = forest(len(link), label[x], label[y])
    place = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(label[x], label[y], strict=True))}
    at = [place[k] for k in kept]
    return x[at], y[at]
