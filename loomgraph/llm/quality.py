"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between a trusted and the raw corpus.

The n-grams are pairs of neighbouring words, and of their shapes, which tell text from markup in any language. On halves of
the labelled documents, these two kinds part good from bad by a wider gap than with single words or single shapes added.

Built-in functions only: texts become arrays of words, and every count is an expression over those arrays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import let

BLANK = " \t\n\x0b\x0c\r"
BLANKS = r"[\x20\x09-\x0D]+"
#: Documents whose n-grams make the trusted distribution, at most: those of the lowest hashes of doc_id.
TRUSTED_ROWS = 20_000
WINDOW = 8


def words(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BLANKS, -1), "")


def _shift(values: Column, k: int) -> Column:
    """values without the first k; empty if there are no more than k."""
    return F.slice(values, k + 1, F.greatest(F.size(values) - k, F.lit(0)))


def _pairs(values: Column, k: int) -> Column:
    """A hash of values[i] and values[i + k] for every i that has both."""
    short = lambda v: F.slice(v, 1, F.greatest(F.size(v) - k, F.lit(0)))
    return let(values, lambda v: F.zip_with(short(v), _shift(v, k), lambda a, b: F.xxhash64(a, b)))


def covered_by_repeats(hashes: Column, width: int = WINDOW) -> Column:
    """How many tokens lie in a window of width tokens whose hash occurs twice or more."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def marks(rows: Column) -> Column:
        same = F.zip_with(rows, _shift(rows, 1), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        before = F.concat(F.array(F.lit(False)), F.slice(same, 1, F.greatest(F.size(same) - 1, F.lit(0))))
        either = F.zip_with(same, before, lambda x, y: x | y)
        return F.filter(F.zip_with(rows, either, lambda r, e: F.when(e, r["i"])), lambda i: i.isNotNull())

    at = F.sort_array(F.transform(F.array(placed), marks)[0])
    steps = F.transform(F.array(at), lambda p: F.zip_with(p, _shift(p, 1), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width)))))[0]
    return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)


def measures(words_of: Column, ratios: Column | None = None, buckets: tuple[int, int] = (0, 0)) -> Column:
    """struct(n, repeated, total): the words of a text, those in windows that occur twice, and the sum of the ratios of the
    pairs of words; each array is made once a row. Windows have a 64-bit hash from hashes of 1, 2 and 4 words."""

    def of_windows(one: Column, two: Column, h: Column) -> Column:
        repeated = F.when(F.size(F.array_distinct(h)) < F.size(h), covered_by_repeats(h)).otherwise(F.lit(0))
        total = F.lit(0).cast("long")
        if ratios is not None:
            total = _sum(two, ratios, buckets[0], buckets[1])
        return F.struct(F.size(one).alias("n"), repeated.alias("repeated"), total.alias("total"))

    ones = F.transform(words_of, lambda w: F.xxhash64(w))
    return let(ones, lambda one: let(_pairs(one, 1), lambda two: let(_pairs(_pairs(two, 2), 4), lambda h: of_windows(one, two, h))))


def _bucket(h: Column, first: int, buckets: int) -> Column:
    place = F.pmod(h, F.lit(buckets))
    return (place + F.lit(first) if first else place).cast("int")


def _sum(hashes: Column, ratios: Column, first: int, buckets: int) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.get(ratios, _bucket(h, first, buckets)))


def base_counts(docs: DataFrame, ratios: Column | None = None, buckets: tuple[int, int] = (0, 0)) -> DataFrame:
    """doc_id and text with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), and total of measures().

    The windows of a text are compared by 64-bit hashes, so two different windows of one text count as equal with a
    probability of about its squared number of words in 2**65.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.ltrim(x, F.lit(BLANK)) != "")
    counts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        # the words are made once for their characters and their measures
        let(words(text), lambda ws: F.struct(F.length(F.array_join(ws, "")).alias("chars"), measures(ws, ratios, buckets).alias("m"))).alias("q"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("q_dup"),
    )
    return counts.select(
        "doc_id",
        "text",
        F.col("q.m.n").cast("long").alias("n_words"),
        F.col("q.chars").cast("long").alias("word_chars"),
        (F.size(F.split(F.coalesce("text", F.lit("")), r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        F.col("q_dup").cast("long").alias("n_dup_lines"),
        F.col("q.m.repeated").cast("long").alias("n_repeat_words"),
        F.col("q.m.total").alias("total"),
    )


def shapes(text: Column) -> Column:
    """Words with runs of lower-case (or caseless) letters as a, of upper-case letters as A, of digits as 0."""
    # the ranges, though parts of the classes, are asked first and spare most characters a look-up of their category
    t = F.regexp_replace(text.cast("string"), r"[a-z[\p{Ll}\p{Lo}\p{M}]]+", "a")
    return words(F.regexp_replace(F.regexp_replace(t, r"[A-Z[\p{Lu}]]+", "A"), r"[0-9]+", "0"))


def _pair_hashes(tokens: Column) -> Column:
    return _pairs(F.transform(tokens, lambda w: F.xxhash64(w)), 1)


def grams(text: Column, buckets: tuple[int, int]) -> Column:
    """Buckets of the hashed pairs of shapes, then, after buckets[0] of those, of the pairs of words."""
    of_shapes = F.transform(_pair_hashes(shapes(text)), lambda h: _bucket(h, 0, buckets[0]))
    return F.concat(of_shapes, F.transform(_pair_hashes(words(text)), lambda h: _bucket(h, *buckets)))


def _counted(docs: DataFrame, ids: DataFrame, buckets: tuple[int, int]) -> DataFrame:
    """bucket, raw, target: the n-grams of a bucket in all documents, and in those of ids (t_id); null is not an n-gram."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), grams(F.col("text"), buckets).alias("g"))
    marked = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("t_id"), "left")
    # outer: else the planner asks first whether a text has any n-gram, and makes those of each text twice
    each = marked.select(F.col("t_id").isNotNull().alias("good"), F.explode_outer("g").alias("bucket"))
    return each.groupBy("bucket").agg(F.count("*").alias("raw"), F.count(F.when(F.col("good"), 1)).alias("target"))


def ratio_table(docs: DataFrame, trusted: DataFrame, buckets: tuple[int, int], smoothing: float = 20.0) -> list[int]:
    """For every bucket, 1e6 times the natural logarithm of its trusted over its raw probability, rounded. Both counts are
    smoothed on the raw corpus's scale, so that a small trusted corpus is not at a disadvantage.

    trusted: doc_id of trusted documents, TRUSTED_ROWS at most. Raw counts are of all documents. Only a row of counts a
    bucket reaches the driver. No trusted document: all zero, so that every document is at the threshold's mercy equally.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("t_id")).where("t_id is not null").distinct().orderBy(F.xxhash64("t_id"), "t_id").limit(TRUSTED_ROWS)
    raw, target = [0] * sum(buckets), [0] * sum(buckets)
    for r in _counted(docs, ids, buckets).collect():
        if r["bucket"] is None:  # texts without n-grams
            continue
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not sum(target):
        return [0] * sum(buckets)
    scale = sum(raw) / sum(target)
    return [round(1e6 * math.log((t * scale + smoothing) / (r + smoothing))) for t, r in zip(target, raw, strict=True)]


def _table(docs: DataFrame, trusted: DataFrame, buckets: tuple[int, int]) -> Column:
    return F.split(F.lit(",".join(map(str, ratio_table(docs, trusted, buckets)))), ",").cast("array<long>")


def _shape_score(text: Column, ratios: Column, buckets: int) -> Column:
    """The sum of the ratios of a text's pairs of shapes, of which there are as many as pairs of words."""
    return _sum(_pair_hashes(shapes(text)), ratios, 0, buckets)


def _n_grams(n: Column) -> Column:
    return (F.lit(2) * F.greatest(n - 1, F.lit(0))).cast("long")


def judge(docs: DataFrame, trusted: DataFrame, buckets: tuple[int, int] = (4096, 65536), threshold: float = -0.15) -> DataFrame:
    """doc_id, base counts, base_failed, score (mean log-likelihood ratio of its n-grams), kept, for every document.

    A document fails the base rules with under 20 words, or over 30 % of words in repeated windows. It is kept if it does
    not and its score, in whole millionths, is at least threshold times its number of n-grams: integer arithmetic, so
    reruns and other partitionings agree, and a score at the threshold (a tie) is kept. Null or empty text: no words,
    base_failed. Very long texts are read whole. Null doc_id: judged, never trusted. Repeated rows are judged each. Empty
    table: no rows. Extra columns are ignored.
    """
    ratios = _table(docs, trusted, buckets)
    counts = base_counts(docs, ratios, buckets).withColumn("q_shapes", _shape_score(F.col("text"), ratios, buckets[0]))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    scored = counts.select(*base, _n_grams(F.col("n_words")).alias("q_n"), (F.col("total") + F.col("q_shapes")).alias("q_total"))
    return scored.select(
        *base,
        failed.alias("base_failed"),
        F.when(F.col("q_n") > 0, F.col("q_total") / F.col("q_n") / F.lit(1e6)).otherwise(F.lit(0.0)).alias("score"),
        (~failed & (F.col("q_total") >= F.lit(round(threshold * 1e6)) * F.col("q_n"))).alias("kept"),
    )


def keep_good(docs: DataFrame, trusted: DataFrame, buckets: tuple[int, int] = (4096, 65536), threshold: float = -0.15) -> DataFrame:
    """The rows of docs that judge() keeps, unchanged, in one pass without a shuffle: the verdict is an expression. Columns
    may have any names."""
    ratios, text = _table(docs, trusted, buckets), F.col("row.text").cast("string")
    held = docs.select(F.struct("*").alias("row")).select("row", measures(words(text), ratios, buckets).alias("m"), _shape_score(text, ratios, buckets[0]).alias("s"))
    n = F.col("m.n").cast("long")
    good = (n >= 20) & (100 * F.col("m.repeated").cast("long") <= 30 * n) & (F.col("m.total") + F.col("s") >= F.lit(round(threshold * 1e6)) * _n_grams(n))
    return held.where(good).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
