"""Incremental ingestion: chunk logs, append-only partials, bounded history, compaction. Ordinary tables, or foreachBatch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stateroll.operators import states as S
from stateroll.sources.scratch import dropped, folder
from stateroll.sources.sinks import append_aggregate, current, newest, publish, receipts, scan_aggregate, stamped, visible, write_aggregate

__all__ = ["compact", "compacted", "current", "current_hash_only", "freshness", "history_rows", "lineage", "newest", "partials_stream", "pending", "pruned", "rebuild", "reconciled", "run_totals", "several", "visible"]


def pending(chunks: DataFrame, log: DataFrame, spec_hash: str) -> DataFrame:
    """Chunks to do: those without a latest success of the same fingerprint and hash."""
    done = visible(log).where(F.col("config_hash") == spec_hash).select("chunk_id", "fingerprint")
    return chunks.join(done, ["chunk_id", "fingerprint"], "left_anti")


def current_hash_only(stored: DataFrame, spec_hash: str) -> DataFrame:
    """Rows of an earlier configuration can't be queried until their chunks are done again."""
    return stored.where(F.col("config_hash") == spec_hash)


def partials_stream(stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, spec_hash: str, run_id: str = "stream"):
    """Each micro-batch reduces to states of its own chunk (the batch's number) and is written; a repeated batch replaces itself.

    A batch costs what its rows cost and some small jobs, whatever came before it.
    """

    def write(batch: DataFrame, number: int) -> None:
        append_aggregate(stamped(build(batch), run_id, f"batch-{number:08d}", spec_hash), path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def late_deduplicated(stream: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """A contact that comes again within the delay is not counted again."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def history_rows(events: DataFrame, contact: list[str], time: str, flags: list[str], order: list[str], day: str = "day") -> DataFrame:
    """A bounded history: one row a contact, with its first time and order and any of its flags, by day."""
    got = events.groupBy(*contact).agg(F.min(time).alias(time), *[F.bool_or(f).alias(f) for f in flags], F.min(F.struct(*order)).alias("first_order"))
    return got.withColumn(day, F.to_date(time))


def lookback(history: DataFrame, target: str, days: int, day: str = "day") -> DataFrame:
    """The days before the target that its window can reach."""
    t = F.lit(target).cast("date")
    return history.where((F.col(day) >= F.date_sub(t, days)) & (F.col(day) < t))


def reconciled(retained: DataFrame, expected: DataFrame, order: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Of a history's journal: the entries that stay, and the expected ones that are missing.

    What stays is the longest common beginning of the expected entries with equal fingerprints; anything after a
    difference is done again.
    """
    r = retained.select(F.col("chunk_id").alias("r_chunk"), F.col("fingerprint").alias("r_print"))
    both = expected.join(r, (F.col("chunk_id") == F.col("r_chunk")) & (F.col("fingerprint") == F.col("r_print")), "left")
    broken = F.broadcast(both.agg(F.min(F.when(F.col("r_chunk").isNull(), F.col(order))).alias("_first")))  # one row
    marked = both.crossJoin(broken)
    stays = marked.where(F.col("_first").isNull() | (F.col(order) < F.col("_first"))).select(*expected.columns)
    missing = marked.where(F.col("_first").isNotNull() & (F.col(order) >= F.col("_first"))).select(*expected.columns)
    return stays, missing


def pruned(history: DataFrame, latest: str, days: int, day: str = "day") -> DataFrame:
    return history.where(F.col(day) >= F.date_sub(F.lit(latest).cast("date"), days))


def compacted(stored: DataFrame, attempts: DataFrame, keys: tuple[str, ...] = ("period", "chunk_id", "config_hash")) -> DataFrame:
    """The rows of the newest successful attempt of each part; the rest was superseded."""
    ok = attempts.where("status = 'ok'").select("pipeline_run_id", "chunk_id").distinct()
    rows = stored.join(ok, ["pipeline_run_id", "chunk_id"], "left_semi")
    last = F.max(F.struct("created_at", "pipeline_run_id")).over(W.partitionBy(*keys))
    return rows.withColumn("_last", last).where("created_at = _last.created_at AND pipeline_run_id = _last.pipeline_run_id").drop("_last")


def compact(stored: DataFrame, attempts: DataFrame, target: str) -> None:
    """Rewrite what compacted() keeps as the target's new version."""
    publish(compacted(stored, attempts), target)


def rebuild(spark: SparkSession, chunks: dict[str, Callable[[], DataFrame]], target: str, run_id: str, spec_hash: str) -> int:
    """Do all chunks into a working folder, and publish them as the target's new version only if every one succeeded. Rows written.

    Whatever fails, the version before stays the current one. A chunk may have no rows.
    """
    staging = folder(spark)
    try:
        for name, make in chunks.items():
            write_aggregate(stamped(make(), run_id, name, spec_hash), staging)
        publish(scan_aggregate(spark, staging, every_attempt=True), target)
    finally:
        dropped(spark, staging)
    return current(spark, target).count()


def several(df: DataFrame, keys: list[str], processors: dict[str, list[S.State]]) -> dict[str, DataFrame]:
    """Processors with the same keys share one aggregate over one scan; each gets its own columns back."""
    own = lambda p, name: name and f"{p}__{name}"
    one = S.build(df, keys, [replace(s, name=own(p, s.name), mean=own(p, s.mean), weight=own(p, s.weight)) for p, states in processors.items() for s in states])
    return {p: one.select(*keys, *[F.col(f"{p}__{s.name}").alias(s.name) for s in states]) for p, states in processors.items()}


def run_totals(log: DataFrame) -> DataFrame:
    return log.groupBy("pipeline_run_id").agg(F.sum("rows_in").alias("rows_in"), F.sum("rows_kept").alias("rows_kept"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"))


def lineage(stored: DataFrame, processor: str, grain: str) -> DataFrame:
    return receipts(stored).withColumns({"processor": F.lit(processor), "grain": F.lit(grain)})


def freshness(stored: DataFrame, day: str = "Day") -> DataFrame:
    return stored.agg(F.max(F.col("period").cast("string")).alias("latest_period"), F.max("created_at").alias("last_created_at"), F.max(day).alias("latest_data_date"))
