"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Saved, saved

#: Words, as every operator here counts them.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources planned on the driver at most (two numbers and a name each, broadcast back); more are planned by aggregates.
MAX_SOURCES = 1_000_000


def fill(sizes: list[int], weights: list[int], budget: float, cap: float) -> list[float]:
    """Shares of budget by weight; none above cap times its size, the excess reshared by weight among the others."""
    capped = [s == 0 for s in sizes]
    while True:
        rest = budget - sum(cap * s for s, c in zip(sizes, capped, strict=True) if c)
        open_weight = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        shares = [cap * s if c else rest * w / open_weight for s, w, c in zip(sizes, weights, capped, strict=True)]
        over = [not c and t > cap * s for s, t, c in zip(sizes, shares, capped, strict=True)]
        if not any(over):
            return shares
        capped = [c or o for c, o in zip(capped, over, strict=True)]
        if all(capped):
            return [cap * s for s in sizes]


def sainte_lague(votes: np.ndarray, seats: int, limits: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients votes / (2 s + 1), ties to the earlier row, never above limits.

    The seats that all quotients above a bound would take are found by bisection of that bound; only the seats left after
    it are dealt one by one, at most one for each row. Empty votes or no seats: zeros.
    """
    votes = np.asarray(votes, float)
    limits = np.full(len(votes), np.iinfo(np.int64).max) if limits is None else np.asarray(limits, np.int64)
    limits = np.where(votes > 0, limits, 0)
    seats = int(min(seats, limits.astype(float).sum()))
    if seats <= 0 or not len(votes):
        return np.zeros(len(votes), np.int64)

    def above(bound: float) -> np.ndarray:
        return np.minimum(np.floor(np.maximum(votes / bound + 1, 0) / 2), limits.astype(float)).astype(np.int64)

    low, high = votes[votes > 0].min() / (4.0 * seats + 4), votes.max() * 2 + 1
    while above(low).sum() < seats:
        low /= 2
    for _ in range(200):
        middle = math.sqrt(low * high)
        if above(middle).sum() >= seats:
            low = middle
        else:
            high = middle
    taken = above(high)
    while (left := seats - int(taken.sum())) > 0:
        quotients = np.where(taken < limits, votes / (2 * taken + 1), -1.0)
        order = np.argsort(-quotients, kind="stable")[:left]
        taken[order[quotients[order] > 0]] += 1
    return taken


def planned_here(found: pd.DataFrame, weights: tuple[int, ...], share: float, max_epochs: float, block_tokens: int) -> pd.DataFrame:
    """source, source_size, target and blocks of sources(source, source_size), planned on the driver."""
    names = sorted(found["source"].tolist(), key=lambda x: (x is None, (x or "").encode()))
    size_of = dict(zip(found["source"].tolist(), found["source_size"].astype("int64").tolist(), strict=True))
    sizes = [int(size_of[x]) for x in names]
    targets = fill(sizes, [weights[k % len(weights)] for k in range(len(names))], share * sum(sizes), max_epochs) if names else []
    limit = np.array([int(max_epochs * s) // block_tokens for s in sizes], np.int64)
    blocks = sainte_lague(np.array(targets), round(sum(targets) / block_tokens), limit + 1)
    return pd.DataFrame(
        {"source": pd.Series(names, dtype="object"), "source_size": pd.Series(sizes, dtype="int64"), "target": pd.Series(targets, dtype="float64"), "dealt": pd.Series(blocks, dtype="int64")}
    )


def planned_apart(sources: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float, block_tokens: int, ways: int = 32) -> DataFrame:
    """The same plan for any number of sources: ranks by ranges, capped targets by rounds of sums, Sainte-Lague by a bound on
    the quotients, narrowed ``ways`` at a time, and the seats left over to the highest quotients."""
    order = (F.col("source").isNull(), F.col("source"))
    ranged = Saved(sources.repartitionByRange(64, *order).withColumn("part", F.spark_partition_id()), "ranged").df
    before, starts = 0, []
    for r in sorted(ranged.groupBy("part").count().collect()):
        starts.append((r["part"], before))
        before += r["count"]
    spark = sources.sparkSession
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("start")
    listed = ranged.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part").withColumn("rank", place)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    state = Saved(listed.select("source", "source_size", "rank", weight.alias("weight"), (F.col("source_size") == 0).alias("capped")), "plan").df
    budget = share * float(state.agg(F.sum("source_size")).first()[0])
    top = F.lit(max_epochs) * F.col("source_size")
    while True:
        r = state.agg(F.coalesce(F.sum(F.when(F.col("capped"), top)), F.lit(0.0)).alias("used"), F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("open")).first()
        rest, opened = budget - r["used"], r["open"]
        own = F.when(F.col("capped"), top).otherwise(F.lit(float(rest)) * F.col("weight") / F.lit(float(opened))) if opened else top
        state = Saved(state.withColumn("target", own).withColumn("over", ~F.col("capped") & (F.col("target") > top)), "plan").df
        if state.where("over").isEmpty():
            break
        state = state.select("source", "source_size", "rank", "weight", (F.col("capped") | F.col("over")).alias("capped"))
    limit = F.when(F.col("target") > 0, F.floor(top / F.lit(block_tokens)) + 1).otherwise(F.lit(0)).cast("long")
    state = Saved(state.select("source", "source_size", "rank", "target", limit.alias("limit")), "plan").df
    sums = state.agg(F.sum("target").alias("t"), F.sum("limit").alias("l"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("low"), F.max("target").alias("high")).first()
    seats = int(min(round((sums["t"] or 0.0) / block_tokens), sums["l"] or 0))
    if seats <= 0:
        return state.select("source", "source_size", "target", F.lit(0).cast("long").alias("dealt"))

    def above(bound: float) -> Column:
        return F.least(F.floor((F.col("target") / F.lit(bound) + 1) / 2), F.col("limit")).cast("long")

    low, high = sums["low"] / (4.0 * seats + 4), sums["high"] * 2 + 1
    while state.agg(F.sum(above(low))).first()[0] < seats:
        low /= 2
    for _ in range(12):
        bounds = [low * (high / low) ** (k / ways) for k in range(1, ways)]
        counts = state.agg(*[F.sum(above(b)).alias(f"c{k}") for k, b in enumerate(bounds)]).first()
        low, high = max([low, *(b for b, c in zip(bounds, counts, strict=True) if c >= seats)]), min([high, *(b for b, c in zip(bounds, counts, strict=True) if c < seats)])
    state = state.withColumn("dealt", above(high))
    while (left := seats - int(state.agg(F.sum("dealt")).first()[0])) > 0:
        state = Saved(state, "plan").df
        more = state.where("dealt < limit").orderBy((F.col("target") / (2 * F.col("dealt") + 1)).desc(), "rank").limit(left).select(F.col("rank").alias("more"))
        state = state.join(more, F.col("rank") == F.col("more"), "left").withColumn("dealt", F.col("dealt") + F.col("more").isNotNull().cast("long")).drop("more")
    return state.select("source", "source_size", "target", "dealt")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    block_tokens: int = 16,
    shard_tokens: int = 1 << 20,
    seed: int = 20240,
) -> DataFrame:
    """How much of every document a mix takes.

    Sources, by code point with null last, weigh ``weights`` in turn and share ``share`` times all words; a source's
    target stops at ``max_epochs`` times its words. Target words become equal blocks; Sainte-Lague deals the whole number
    of blocks to sources, and a source's blocks to its shards (documents dealt by a seeded hash, about ``shard_tokens``
    words each, so a source with a third of all rows is many shards). A shard lays its documents end to end in seeded
    order; whole epochs take every document, and the remaining blocks are the first of that order, so at most one
    document a shard is cut. Nothing but the list of sources reaches the driver, and of over MAX_SOURCES only sums.

    Null or empty text: size 0, taken 0. Very long texts are one document, cut like any other. Null doc_id: kept, ordered
    first. Repeated rows count each. Ties: equal quotients go to the earlier source or shard. Empty table: no rows.
    Extra columns are ignored. Returns doc_id, size, source, source_size, target, taken, first_word, last_word (the cut).
    """
    seed = int(seed)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    spark = docs.sparkSession
    rows = saved(rows, "mix")
    counted = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = counted.limit(MAX_SOURCES + 1).toPandas()
    small = len(found) <= MAX_SOURCES
    if small:
        plan = spark.createDataFrame(planned_here(found, weights, share, max_epochs, block_tokens), "source string, source_size long, target double, dealt long")
    else:
        plan = planned_apart(counted, weights, share, max_epochs, block_tokens)
    size = F.col("source_size")
    wanted = plan.withColumn("wanted", F.least(F.floor(F.lit(max_epochs) * size), F.col("dealt") * block_tokens).cast("long"))
    epochs = F.when(size > 0, F.floor(F.col("wanted") / size)).otherwise(F.lit(0)).cast("long")
    rest = F.ceil((F.col("wanted") - F.col("epochs") * size) / F.lit(block_tokens)).cast("long")
    made = wanted.withColumn("epochs", epochs).withColumn("blocks", rest).withColumn("shards", F.greatest(F.lit(1), F.ceil(size / F.lit(shard_tokens))).cast("long"))
    made = made.select("source", "source_size", "target", "epochs", "blocks", "shards")
    sources = F.broadcast(made) if small else Saved(made, "sources").df

    key: Column = F.xxhash64(F.col("doc_id"), F.lit(seed))
    placed = (
        rows.alias("d")
        .join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("doc_id", F.col("d.source").alias("source"), "size", "source_size", "target", "epochs", F.pmod(key, F.col("shards")).alias("shard"), F.xxhash64(key, F.lit(seed + 1)).alias("turn"))
    )
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        """The shards of one source: as many rows as it has shards, whatever its documents."""
        pdf = pdf.sort_values("shard", kind="stable").reset_index(drop=True)
        room = -(-pdf["shard_size"].to_numpy(np.int64) // block_tokens)
        pdf["quota"] = sainte_lague(pdf["shard_size"].to_numpy(), int(pdf["blocks"].iloc[0]), room)
        return pdf[["source_key", "shard", "quota"]]

    quotas = (
        shards.alias("h")
        .join(sources.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
        .select(F.coalesce(F.concat(F.lit("="), F.col("h.source")), F.lit("")).alias("source_key"), "shard", "shard_size", "blocks")
        .groupBy("source_key")
        .applyInPandas(deal, "source_key string, shard long, quota long")
    )
    line = Window.partitionBy("source_key", "shard").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = placed.withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    last = F.sum("size").over(line)
    partial = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") * F.lit(block_tokens) - F.col("before")))
    return (
        keyed.join(quotas, ["source_key", "shard"])
        .withColumn("before", last - F.col("size"))
        .withColumn("partial", partial.cast("long"))
        .select("doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("partial")).cast("long").alias("taken"), "epochs", "partial")
    )


def apply(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of docs as the mix takes them, with all their columns: once for each epoch, and once more, cut to the words
    that the last block of its shard reaches, where a document is taken in part (its words are then joined by one space).

    n_chars, if there, is measured anew on a cut row. A null or empty text takes no words, so it is left out.
    """
    size = F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select(F.struct("*").alias("row"))
    rows = own.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), size.alias("size"))
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("source", "size"))
    taken = mix(docs, **options).withColumn("turn", turn).select("doc_id", "turn", "epochs", "partial")
    both = rows.withColumn("turn", turn).alias("r").join(taken.hint("shuffle_hash").alias("t"), F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("r.turn") == F.col("t.turn")))
    whole = F.array_repeat(F.lit(-1).cast("long"), F.when(F.col("size") > 0, F.col("epochs")).otherwise(F.lit(0)).cast("int"))
    part = F.when((F.col("partial") > 0) & (F.col("partial") < F.col("size")), F.array(F.col("partial"))).when(F.col("partial") > 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
    out = both.select("row", F.explode(F.concat(whole, part)).alias("cut"))
    words = F.filter(F.split(F.col("row.text"), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    text = F.when(F.col("cut") >= 0, F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("cut"), F.lit(0)).cast("int")), " ")).otherwise(F.col("row.text"))
    out = out.withColumn("text", text)
    fields = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.when(F.col("cut") >= 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars").cast("long"))
    return out.select(*[fields.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
