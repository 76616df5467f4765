"""Language-model scores from a probabilistic suffix tree over words.

The tree is never in one place. Texts become chunks, saved once as token streams; a chunk asks for what it needs of the
tree by key (an n-gram or a context), keys are summed up in buckets by hash, and the answers go back to the chunks that
asked. So the model is as large as the corpus makes it, and nothing of it is gathered on the driver or broadcast.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Saved, shared_dir, tidy
from .textkernel import Words, batches, mix

#: The begin of a text, a symbol of contexts only, and its end, counted as a token; no word hashes to them but by chance.
BEGIN, END = np.uint64(0xBE61BE61BE61BE61), np.uint64(0x5EED5EED5EED5EED)
#: Bytes of text in a chunk, and keys in a bucket, about.
CHUNK, BUCKET = 4 << 20, 1 << 20

#: Steps of one in which stored logarithms are rounded.
_STEPS = 1 << 18

_STATE = "chunk long, tokens long, train long, size long, data binary"
_ASK = "bucket int, kind int, chunk long, at long, size long, data binary"
_REPLY = "chunk long, kind int, at long, types long, size long, data binary"


def _pack(value: object) -> tuple[int, bytes]:
    raw = pickle.dumps(value, 5)
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(size: int, data: bytes) -> object:
    return pickle.loads(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True))  # noqa: S301 - written by _pack


def _bytes(values: np.ndarray) -> np.ndarray:
    """The values by byte: bytes that are nearly all alike compress away."""
    rows = values.view(np.uint8).reshape(len(values), values.dtype.itemsize)
    out = np.empty(rows.shape[::-1], np.uint8)
    for i in range(len(out)):  # a plane at a time takes a fraction of the time of a transposed copy
        out[i] = rows[:, i]
    return out


def _values(planes: np.ndarray, kind: type) -> np.ndarray:
    rows = np.empty(planes.shape[::-1], np.uint8)
    for i in range(len(planes)):
        rows[:, i] = planes[i]
    return rows.view(kind).ravel()


def _changes(ordered: np.ndarray) -> np.ndarray:
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return new


def distinct(values: np.ndarray) -> np.ndarray:
    """np.unique(values) by a sort of the bare values, which is vectorised."""
    ordered = np.sort(values)
    return ordered[_changes(ordered)]


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique(values, return_index=True, return_inverse=True) of 64-bit keys. Their upper bits are sorted as numbers with
    the place as lower bits, which is vectorised and stable; if keys that differ in their lower bits alone come in disorder,
    the whole keys are."""
    bits = np.uint64(max(len(values) - 1, 1).bit_length())
    order = values >> bits << bits
    order |= np.arange(len(values), dtype=np.uint64)
    order.sort()
    order &= (np.uint64(1) << bits) - np.uint64(1)
    order = order.view(np.int64)
    ordered = values[order]
    if (ordered[1:] < ordered[:-1]).any():
        order = np.argsort(values, kind="stable")
        ordered = values[order]
    new = _changes(ordered)
    inverse = np.empty(len(values), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


def _planes(keys: np.ndarray) -> np.ndarray:
    """Steps between sorted keys, whose upper bytes are nearly all zero, by byte."""
    return _bytes(np.diff(keys, prepend=np.uint64(0)))


def _keys(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(_values(planes, np.uint64), dtype=np.uint64)


def extend(gram: np.ndarray, word: np.ndarray, order: int) -> np.ndarray:
    """The key of each n-gram of ``order`` words: gram, of one less, and the word after it."""
    with np.errstate(over="ignore"):
        return mix(gram * np.uint64(0x9E3779B97F4A7C15) + word * np.uint64(2) + np.uint64(order))


class Chunk:
    """The token streams of some texts (begin, words, end), and what is known of the tree at each of their places.

    count[m] is how often the n-gram of m tokens that ends at a place occurs in training texts, 0 for once or never if
    m > 1; own marks one place of each n-gram of the last order that this chunk reports; log is the running log10
    probability of the token at a place, 0 once it has been added to the score of its text. vocab has the frequent words
    of the chunk first, and loses those, and symbol the places, that no repeated n-gram needs any more.
    """

    def __init__(self, ids: list, held: np.ndarray, bounds: np.ndarray, vocab: np.ndarray, symbol: np.ndarray) -> None:
        self.ids, self.held, self.bounds, self.vocab, self.symbol = ids, held, bounds, vocab, symbol
        self.count: dict[int, np.ndarray] = {}
        self.known = np.zeros(0, np.int64)  # training count of each word of vocab
        self.own, self.log = np.zeros(0, bool), np.zeros(0)
        self.score, self.base, self.found = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)

    def __getstate__(self) -> dict:
        made = self.__dict__ | {"symbol": _bytes(self.symbol), "log": _bytes(np.rint(self.log * -_STEPS).astype(np.uint32))}
        return made | {"count": {m: _bytes(c.astype(np.uint32) if c.max(initial=0) < 1 << 32 else c) for m, c in self.count.items()}}

    def __setstate__(self, made: dict) -> None:
        self.__dict__.update(made)
        self.symbol, self.log = _values(made["symbol"], np.int32), _values(made["log"], np.uint32) / -_STEPS
        self.count = {m: _values(c, np.uint32 if len(c) == 4 else np.int64).astype(np.int64) for m, c in made["count"].items()}

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.bounds))

    @property
    def first(self) -> np.ndarray:
        out = np.zeros(len(self.symbol), bool)
        out[self.bounds[:-1]] = True
        return out

    def grams(self, *orders: int) -> dict[int, np.ndarray]:
        """For each order the key of the n-gram that ends at each place; meaningless where the text has too few tokens before it."""
        word = self.vocab[self.symbol]
        out, made = word, {1: word} if 1 in orders else {}
        for m in range(2, max(orders) + 1):
            out = extend(np.concatenate([out[:1], out[:-1]]), word, m)
            if m in orders:
                made[m] = out
        return made

    def times(self, order: int) -> np.ndarray:
        return self.known[self.symbol] if order == 1 else self.count[order]

    def grams_asked(self, order: int) -> np.ndarray:
        """Places of the n-grams that may occur twice: both n-grams of one word less within them do."""
        fits = ~self.first
        if order > 2:
            often = self.times(order - 1) >= 2
            fits &= often
            fits[1:] &= often[:-1]
        return np.flatnonzero(fits)

    def contexts_asked(self, order: int) -> np.ndarray:
        """Places whose context of so many tokens occurs twice or more."""
        fits = ~self.first
        fits[1:] &= self.times(order)[:-1] >= 2
        return np.flatnonzero(fits)

    def begin(self, tokens: int, types: int) -> None:
        self.log = np.log10((self.known + 1.0) / (tokens + types + 1))[self.symbol]
        self.log[self.first] = 0.0
        self.base = np.bincount(self.doc, self.log, len(self.ids))
        self.found = np.bincount(self.doc, (self.known[self.symbol] > 0) & ~self.first, len(self.ids)).astype(np.int64)

    def forget(self) -> None:
        """Drop the symbols that lie in no n-gram of two tokens that occurs twice, and the words that are left nowhere."""
        often = self.count[2] >= 2
        used = often.copy()
        used[:-1] |= often[1:]
        words, symbol = np.unique(self.symbol[used], return_inverse=True)
        self.vocab = np.append(self.vocab[words], np.uint64(0))
        self.symbol = np.full(len(self.symbol), len(words), np.int32)
        self.symbol[used] = symbol
        self.known = np.zeros(0, np.int64)

    def asks(self, step: int, depth: int) -> Iterator[tuple[int, np.ndarray, dict]]:
        """(kind, sorted keys, what comes with them) of a step: positive kinds are orders of n-grams, negative ones of contexts."""
        train = ~np.repeat(self.held, np.diff(self.bounds))
        gram = self.grams(*([step + 1] * (step <= depth) + [step - 1] * (step > 1)))
        if step == 1:
            order = np.argsort(self.vocab)
            yield 1, self.vocab[order], {"n": np.bincount(self.symbol, train, len(self.vocab)).astype(np.int64)[order]}
        if step <= depth:
            at = self.grams_asked(step + 1)
            keys, _, index = grouped(gram.pop(step + 1)[at])
            yield step + 1, keys, {"n": np.bincount(index, train[at], len(keys)).astype(np.int64)}
        if step > 1:
            k = step - 1
            before, at = gram[k], self.contexts_asked(k)
            keys = distinct(before[at - 1])
            mine = np.flatnonzero(self.own)
            place = np.searchsorted(keys, before[mine - 1])
            n, c, p = self.times(k)[mine - 1].astype(float), self.times(k + 1)[mine].astype(float), 10.0 ** self.log[mine]
            used, index = np.unique(place, return_inverse=True)
            add = lambda x: np.bincount(index, x, len(used))
            size = np.zeros(len(used))
            size[index] = n
            yield -k, keys, {"at": used, "sums": np.column_stack([size, add(np.ones(len(mine))), add(c), add(p), add(c * np.log10(c / (n * p)))])}

    def learn(self, step: int, depth: int, replies: dict[int, list[tuple[int, dict]]], discount: float) -> None:
        """Take in the answers to asks(step)."""
        gram = self.grams(*([step + 1] * (step <= depth) + [step - 1] * (step > 1)))
        if step == 1:
            self.known = np.zeros(len(self.vocab), np.int64)
            self.known[np.argsort(self.vocab)] = np.concatenate([x["n"] for _, x in sorted(replies[1], key=lambda r: r[0])])
        if step > 1:
            k = step - 1
            at = self.contexts_asked(k)
            keys, _, index = grouped(gram.pop(k)[at - 1])
            left = np.full(len(keys), np.nan)
            for start, x in replies.get(-k, []):
                left[start + x["at"]] = x["left"]
            left = left[index]
            kept = ~np.isnan(left)
            at, left = at[kept], left[kept]
            c, n = self.times(k + 1)[at], self.times(k)[at - 1]
            self.log[at] = np.log10(np.where(c >= 2, (c - discount) / n, 0.0) + left * 10.0 ** self.log[at])
        if step <= depth:
            order = step + 1
            at = self.grams_asked(order)
            keys, first, index = grouped(gram.pop(order)[at])
            total, mine = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
            for start, x in replies.get(order, []):
                total[start + x["at"]], mine[start + x["at"]] = x["n"], x["own"]
            self.count[order], self.own = np.zeros(len(self.symbol), np.int64), np.zeros(len(self.symbol), bool)
            self.count[order][at] = total[index]
            self.own[at[first[mine]]] = True
        if step > 1:
            over = np.ones(len(self.symbol), bool)
            if step <= depth:
                over[self.contexts_asked(step)] = False
            self.score += np.bincount(self.doc[over], self.log[over], len(self.ids))
            self.log[over] = 0.0
            if step == 2:
                self.forget()
            self.count.pop(step - 1, None)


def _chunks(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches(items, size=CHUNK):
        words = Words(batch.column("text"), lower=True)
        n = batch.num_rows
        bounds = words.bounds + 2 * np.arange(n + 1)
        stream = np.full(int(bounds[-1]), BEGIN, np.uint64)
        inside = np.ones(len(stream), bool)
        inside[bounds[:-1]] = inside[bounds[1:] - 1] = False
        stream[bounds[1:] - 1] = END
        stream[inside] = words.hash
        vocab, symbol, times = np.unique(stream, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        held = batch.column("held_out").to_numpy(zero_copy_only=False)
        sizes = np.diff(bounds) - 1
        chunk = Chunk(batch.column("doc_id").to_pylist(), held, bounds, vocab[order], rank[symbol])
        yield _row((part << 32) + number, int(sizes.sum()), int(sizes[~held].sum()), chunk)
        number += 1


def _row(number: int, tokens: int, train: int, chunk: Chunk) -> pa.RecordBatch:
    size, data = _pack(chunk)
    return pa.record_batch([pa.array([number]), pa.array([tokens]), pa.array([train]), pa.array([size]), pa.array([data], pa.binary())], ["chunk", "tokens", "train", "size", "data"])


def _chunk_of(table: pa.RecordBatch | pa.Table, i: int) -> Chunk:
    return _unpack(table.column("size")[i].as_py(), table.column("data")[i].as_py())


def _asking(step: int, depth: int, buckets: int, tokens: int, types: int):
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64) if buckets > 1 else np.zeros(0, np.uint64)

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            for i in range(batch.num_rows):
                chunk, rows = _chunk_of(batch, i), []
                if step == 2:
                    chunk.begin(tokens, types)
                for kind, keys, more in chunk.asks(step, depth):
                    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        if lo == hi:
                            continue
                        if kind > 0:
                            own = {"n": more["n"][lo:hi]}
                        else:
                            p, q = np.searchsorted(more["at"], [lo, hi])
                            own = {"at": more["at"][p:q] - lo, "sums": more["sums"][p:q]}
                        rows.append((b, kind, batch.column("chunk")[i].as_py(), lo, *_pack(own | {"keys": _planes(keys[lo:hi])})))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["bucket", "kind", "chunk", "at", "size", "data"])

    return run


def left_to_parent(sums: np.ndarray, discount: float, strictness: float) -> np.ndarray:
    """The probability a context leaves to its suffix, nan for contexts that the divergence test does not retain.

    sums has a row a context: its size, and over the next symbols seen twice or more their number, counts, probabilities
    under the suffix, and counts times log10 of the ratio of both. The gain in log likelihood over the suffix is the
    size times the divergence of both distributions, the other symbols taken as one; it must exceed ``strictness``
    times half the logarithm of the size for each of these and the remainder.
    """
    size, kinds, seen, above, gain = sums.T
    rest = size - seen
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gain + np.where(rest > 0, rest * np.log10(np.where(rest > 0, rest, 1) / size / np.maximum(1 - above, 1e-12)), 0.0)
        keep = (kinds > 0) & (gain > strictness * 0.5 * np.log10(size) * (kinds + 1))
        return np.where(keep, (rest + discount * kinds) / size, np.nan)


def _answering(discount: float, strictness: float):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(range(table.num_rows), key=lambda i: table.column("chunk")[i].as_py())
        got = [_unpack(table.column("size")[i].as_py(), table.column("data")[i].as_py()) for i in rows]
        kind = table.column("kind")[0].as_py()
        parts = [_keys(x["keys"]) for x in got]
        cuts = np.cumsum([0, *(len(p) for p in parts)])
        keys, first, index = grouped(np.concatenate(parts))
        out, types = [], 0
        if kind > 0:
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, index, np.concatenate([x["n"] for x in got]))
            types = int(((total > 0) & (keys != BEGIN)).sum())
        else:
            sums = np.zeros((len(keys), 5))
            for x, lo in zip(got, cuts, strict=False):
                own = index[lo + x["at"]]
                sums[own, 0] = x["sums"][:, 0]
                sums[own, 1:] += x["sums"][:, 1:]  # a chunk has a context once
            left = left_to_parent(sums, discount, strictness)
        for j, i in enumerate(rows):
            own = index[cuts[j] : cuts[j + 1]]
            if kind == 1:
                reply = {"n": total[own]}
            elif kind > 0:
                at = np.flatnonzero(total[own] >= 2)
                reply = {"at": at, "n": total[own[at]], "own": first[own[at]] == at + cuts[j]}
            else:
                at = np.flatnonzero(~np.isnan(left[own]))
                reply = {"at": at, "left": left[own[at]]}
            out.append((table.column("chunk")[i].as_py(), kind, table.column("at")[i].as_py(), types if kind == 1 and j == 0 else 0, *_pack(reply)))
        names, kinds = ("chunk", "kind", "at", "types", "size", "data"), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*out, strict=True), kinds, strict=True)})

    return run


def _learning(step: int, depth: int, tokens: int, types: int, discount: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, same = _chunk_of(left, 0), [left.column(c)[0].as_py() for c in ("chunk", "tokens", "train")]
        replies: dict[int, list] = {}
        for i in range(right.num_rows):
            replies.setdefault(right.column("kind")[i].as_py(), []).append((right.column("at")[i].as_py(), _unpack(right.column("size")[i].as_py(), right.column("data")[i].as_py())))
        if step == 2:
            chunk.begin(tokens, types)
        del left, right
        chunk.learn(step, depth, replies, discount)
        return pa.Table.from_batches([_row(*same, chunk)])

    return run


def _scores(tokens: int):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            for i in range(batch.num_rows):
                chunk = _chunk_of(batch, i)
                yield pa.record_batch(
                    [
                        pa.array(chunk.ids, pa.int64()),
                        pa.array(chunk.held),
                        pa.array(np.diff(chunk.bounds) - 1, pa.int64()),
                        pa.array(chunk.found),
                        pa.array(np.full(len(chunk.ids), tokens, np.int64)),
                        pa.array(chunk.base),
                        pa.array(chunk.score),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


class _Dealt(Saved):
    """Chunks in a table of the shared folder with ``parts`` buckets by chunk: to be joined with answers, it need not move."""

    def __init__(self, df: DataFrame, parts: int) -> None:
        self.spark, self.schema, self.name = df.sparkSession, df.schema, f"loomgraph_chunks_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/loomgraph/{self.name}"
        df.write.format("parquet").bucketBy(parts, "chunk").option("path", self.path).saveAsTable(self.name)

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self) -> None:
        """Take the table from the catalogue; its files stay."""
        self.spark.sql(f"drop table if exists {self.name}")

    def drop(self) -> None:
        self.forget()
        super().drop()


def score(docs: DataFrame, held_out_of: int = 7, held_out: int = 2, depth: int = 3, discount: float = 0.5, strictness: float = 1.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    The tree has a node for every context of up to ``depth`` tokens that training texts have twice or more and that the
    divergence test retains (left_to_parent()); no share of the corpus and no size decides. A node gives each next token
    seen twice or more its count less ``discount``, and what is left goes to the distribution of its suffix; the root is
    the add-one distribution of base_score. A token is scored at the longest retained suffix of what precedes it. An
    n-gram is asked for only where its two shorter ones occur twice, which loses none. Words and contexts are 64-bit hashes.

    Each of the depth + 1 steps is one exchange of keys, summed in the chunks first, to buckets and back: a word in every
    text is one key a chunk. Null or empty text: only the end token. A very long text is a chunk of its own, whole. Null
    doc_id: a training row. Repeated rows count each. Empty table: no rows. There are no ties to break: equal texts have
    equal scores. Extra columns are ignored.
    """
    spark = docs.sparkSession
    out = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % held_out_of == held_out, F.lit(False))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), out.alias("held_out"))
    state = _Dealt(own.mapInArrow(_chunks, _STATE), 4 * spark.sparkContext.defaultParallelism)
    sums = state.df.agg(F.sum("train").alias("n"), F.sum("tokens").alias("all"), F.count("*").alias("chunks")).first()
    tokens, types = int(sums["n"] or 0), 0
    buckets = max(8, math.ceil(int(sums["all"] or 0) / BUCKET))
    for step in range(1, depth + 2):
        asked = state.df.mapInArrow(_asking(step, depth, buckets, tokens, types), _ASK)
        replies = Saved(asked.groupBy("bucket", "kind").applyInArrow(_answering(discount, strictness), _REPLY), "replies")
        del asked
        tidy(spark)
        tidy(spark)  # what was asked is the largest exchange; its files should be gone before the chunks are written anew
        if step == 1:
            types = int(replies.df.agg(F.sum("types")).first()[0] or 0)
        held = state.table
        learned = held.groupBy("chunk").cogroup(replies.df.groupBy("chunk")).applyInArrow(_learning(step, depth, tokens, types, discount), _STATE)
        after = _Dealt(learned, max(8, math.ceil(int(sums["chunks"]) / 4)))
        del held, learned
        state.drop()
        replies.drop()
        tidy(spark)
        state = after
    state.forget()
    return state.df.mapInArrow(_scores(tokens), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
