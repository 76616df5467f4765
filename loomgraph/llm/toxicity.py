"""Toxicity categories by a chain of linear classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import PUNCTUATION, Words, batches, mix

#: Labelled rows that models are fitted on, at most: those of the lowest hashes of doc_id.
SAMPLE_ROWS = 20_000


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, word hash) pairs, as two arrays; words are runs of letters and digits, A-Z in lower case."""
    words = Words(column, lower=True, breaks=PUNCTUATION)
    order = np.lexsort((words.hash, words.doc))
    doc, word = words.doc[order], words.hash[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])
    return doc[new], word[new]


def _sampled(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(items):
        doc, word = _features(batch.column("text"))
        offs = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32())
        yield pa.record_batch([batch.column("doc_id"), batch.column("labels"), pa.ListArray.from_arrays(offs, pa.array(word.astype(np.int64)))], ["doc_id", "labels", "words"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Linear:
    """Logistic regression on the presence of words and on dense columns (logits of earlier categories)."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, dense: np.ndarray, bias: float) -> None:
        self.words, self.weights, self.dense, self.bias = words, weights, dense, bias

    def probability(self, doc: np.ndarray, word: np.ndarray, n: int, dense: np.ndarray) -> np.ndarray:
        total = np.full(n, self.bias) + dense @ self.dense
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            hit = self.words[at] == word
            total += np.bincount(doc[hit], self.weights[at[hit]], n)
        return _sigmoid(total)


def fit(doc: np.ndarray, word: np.ndarray, dense: np.ndarray, label: np.ndarray, least: float = 20.0, most: int = 4096, penalty: float = 1.0, steps: int = 80) -> Linear:
    """Words of a chi-square of least or more against the label (most of them), then L2-penalised L-BFGS.

    label is 0 or 1 for each of the docs; without both of them, the model says the base rate.
    """
    n, positive = len(label), float(label.sum())
    if not positive or positive == n:
        rate = (positive + 0.5) / (n + 1) if n else 0.0
        return Linear(np.zeros(0, np.uint64), np.zeros(0), np.zeros(dense.shape[1]), float(_logit(np.array([rate]))[0]))
    names, column = np.unique(word, return_inverse=True)
    df = np.bincount(column, minlength=len(names)).astype(float)
    hits = np.bincount(column, label[doc], len(names))
    expected = df * positive / n
    chi = (hits - expected) ** 2 / np.maximum(expected * (1 - positive / n) * (1 - df / n), 1e-9)
    chosen = np.flatnonzero((chi >= least) & (df >= 3))
    chosen = np.sort(chosen[np.lexsort((names[chosen], -chi[chosen]))][:most])
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    used = place[column] >= 0
    rows, cols, k, d = doc[used], place[column[used]], len(chosen), dense.shape[1]

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = w[-1] + np.bincount(rows, w[cols], n) + dense @ w[k : k + d]
        loss = float(np.logaddexp(0, -np.where(label > 0, z, -z)).sum() + penalty / 2 * (w[:-1] ** 2).sum())
        err = _sigmoid(z) - label
        return loss, np.concatenate([np.bincount(cols, err[rows], k) + penalty * w[:k], dense.T @ err + penalty * w[k : k + d], [err.sum()]])

    w = np.zeros(k + d + 1)
    loss, grad = value(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        step, alphas = grad.copy(), []
        for s, y in reversed(pairs):
            alphas.append(s @ step / (y @ s))
            step -= alphas[-1] * y
        step *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(grad).max())
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            step += s * (a - y @ step / (y @ s))
        size = 1.0
        while True:
            moved = w - size * step
            new, slope = value(moved)
            if new <= loss - 1e-4 * size * (grad @ step) or size < 1e-8:
                break
            size /= 2
        s, y = moved - w, slope - grad
        if s @ y > 1e-12:
            pairs = [*pairs[-7:], (s, y)]
        done = loss - new < 1e-7 * max(1.0, loss)
        w, loss, grad = moved, new, slope
        if done:
            break
    return Linear(names[chosen], w[:k], w[k : k + d], float(w[-1]))


def fit_chain(doc: np.ndarray, word: np.ndarray, labels: np.ndarray, fold: np.ndarray, folds: int = 3) -> list[Linear]:
    """A model a category, in order; each sees the logits of the earlier ones, predicted for rows they were not fitted on."""
    n, chain, dense = len(labels), [], np.zeros((len(labels), 0))
    for c in range(labels.shape[1]):
        out = np.zeros(n)
        for f in range(folds):
            test = fold == f
            if not test.any():
                continue
            number = np.cumsum(~test) - 1
            use = ~test[doc]
            part = fit(number[doc[use]], word[use], dense[~test], labels[~test, c])
            out[test] = part.probability(doc, word, n, dense)[test]
        chain.append(fit(doc, word, dense, labels[:, c]))
        dense = np.column_stack([dense, _logit(out)])
    return chain


def classify(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], threshold: float = 0.3) -> DataFrame:
    """doc_id, p_<category> of each category and, for the last one, a boolean of its name, of every row of docs.

    ``labels`` has doc_id and a 0 / 1 column a category; rows with a null among them are left out, of repeated ids one
    row counts. The chain is fitted on the driver on SAMPLE_ROWS labelled documents at most; scoring is one narrow pass.

    Null or empty text: no words, so the models' biases decide. Very long texts are read whole; a sampled one reaches the
    driver as its distinct words. Null doc_id: scored, never a sample. Repeated rows are scored each, and each is a row of
    the sample if its id is in it. Ties: a probability of exactly ``threshold`` is toxic. Empty tables: no rows; without labels, base rates. Extra columns are ignored.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.array(*[F.col(c).cast("int") for c in categories]).alias("labels"))
    marks = marks.where("l_id is not null").where(~F.exists("labels", lambda x: x.isNull())).groupBy("l_id").agg(F.max("labels").alias("labels"))
    sample = marks.orderBy(F.xxhash64("l_id"), "l_id").limit(SAMPLE_ROWS)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = own.join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).select("doc_id", "labels", "text")
    got = rows.mapInArrow(_sampled, "doc_id long, labels array<int>, words array<long>").toArrow()
    ids = got.column("doc_id").to_numpy()
    lists = got.column("words").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    word = lists.flatten().to_numpy().astype(np.uint64)
    doc = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths(), np.int64))
    marked = np.array(got.column("labels").to_pylist(), float).reshape(len(ids), len(categories))
    # the order of rows must not matter: by id, and of repeated ids by their words
    with np.errstate(over="ignore"):
        sums = np.zeros(len(ids), np.uint64)
        np.add.at(sums, doc, mix(word))
    by = np.lexsort((sums, ids))
    rank = np.empty(len(ids), np.int64)
    rank[by] = np.arange(len(ids))
    chain = fit_chain(rank[doc], word, marked[by], (mix(ids[by].astype(np.uint64)) % np.uint64(3)).astype(np.int64))
    models = spark.sparkContext.broadcast(chain)

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unique(np.concatenate([m.words for m in models.value]))
        for batch in batches(items):
            words = Words(batch.column("text"), lower=True, breaks=PUNCTUATION)
            at = np.minimum(np.searchsorted(known, words.hash), max(len(known) - 1, 0))
            hit = known[at] == words.hash if len(known) else np.zeros(len(at), bool)
            pair = np.unique(words.doc[hit] * max(len(known), 1) + at[hit])
            d, w = pair // max(len(known), 1), known[pair % max(len(known), 1)] if len(known) else np.zeros(0, np.uint64)
            dense, out = np.zeros((batch.num_rows, 0)), []
            for m in models.value:
                out.append(m.probability(d, w, batch.num_rows, dense))
                dense = np.column_stack([dense, _logit(out[-1])])
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(p) for p in out), pa.array(out[-1] >= threshold)], ["doc_id", *(f"p_{c}" for c in categories), categories[-1]])

    return own.mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double" for c in categories) + f", {categories[-1]} boolean")
