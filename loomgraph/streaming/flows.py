"""Change-driven flows on Structured Streaming: watching, debouncing, deduplication, invalidation, stateful statuses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import claims as C
from ..operators import search as S


def watch(spark: SparkSession, path: str, schema: StructType | None = None, per_batch: int | None = None, form: str = "parquet") -> DataFrame:
    """New files of a folder as a stream; without a schema, that of the files there now."""
    own = schema or spark.read.format(form).load(path).schema
    reader = spark.readStream.format(form).schema(own)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(path)


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length) of files that appear below a folder."""
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")


def debounced(events: DataFrame, key: str, gap: str, late: str = "1 minute") -> DataFrame:
    """(key, start, end, n): bursts of events with no gap as long as ``gap``; works on tables and streams alike."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = own.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once while its watermark holds it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def racy_again(files: DataFrame, refreshed: Any, seconds: int = 3) -> DataFrame:
    """Files to read once more: changed within ``seconds`` of the last refresh, or after it."""
    return files.where(F.col("modificationTime") >= F.lit(refreshed) - F.make_dt_interval(secs=F.lit(seconds)))


def last_status(events: DataFrame) -> DataFrame:
    """(claim_id, status, seq): the status of each claim after all its events, kept in state across batches."""
    schema = "claim_id long, status string, seq long"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for pdf in batches:
            for ts, seq, status in zip(pdf["ts"], pdf["seq"], pdf["status"], strict=True):
                row = (int(ts.value), int(seq), status)
                best = row if best is None or row[:2] > tuple(best)[:2] else best
        if best is not None:
            state.update(tuple(best))
            yield pd.DataFrame({"claim_id": [key[0]], "status": [best[2]], "seq": [best[1]]})

    return events.groupBy("claim_id").applyInPandasWithState(run, schema, "ts long, seq long, status string", "update", "NoTimeout")


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """All that is there now, batch by batch. The checkpoint counts a batch once it is done, so one that failed half way is
    given again with its number: ``each`` writes exactly once if it overwrites by that number."""
    query: StreamingQuery = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_into(store: C.Store, name: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that appends to the claim store, whose state is the newest row of a key."""
    return lambda df, _: store.append(name, df, "stream")


def invalidation(claims: DataFrame, deps: DataFrame, store: C.Store) -> Callable[[DataFrame, int], None]:
    """A foreachBatch over changed facets (dep_key, fp, file) that records which claims they make stale or rebind."""

    def each(df: DataFrame, _: int) -> None:
        touched = deps.join(df.select("dep_key"), "dep_key", "left_semi")
        store.append("verdicts", C.invalidate(claims, touched, df.select("dep_key", "fp"), df.select("file")), "invalidation")

    return each


def monitor(rx: str, baseline: DataFrame, store: C.Store) -> Callable[[DataFrame, int], None]:
    """A foreachBatch over lines(file, line, text) that records matches beyond the baseline."""
    return lambda df, _: store.append("matches", S.new_matches(df, baseline, rx), "monitor")


def maintained_postings(old: DataFrame, changed: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings after files(file, text) changed and others (file) went: theirs replaced, all others untouched."""
    out = changed.select("file").unionByName(gone.select("file"))
    return old.join(out, "file", "left_anti").select(*old.columns).unionByName(S.postings(changed))


def affected_closure(changed: DataFrame, imports: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, distance) of files to extract again: the changed ones and those that import them, however far."""
    from ..operators.traverse import reach

    return reach(changed.select(F.col("file").alias("id")), imports.select(F.col("dst").alias("u"), F.col("src").alias("v")), depth)


def detect_changes(now: DataFrame, then: DataFrame) -> DataFrame:
    """(path, change) between two manifests (path, sha): new, changed or deleted."""
    both = now.select("path", F.col("sha").alias("a")).join(then.select("path", F.col("sha").alias("b")), "path", "full")
    change = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")
