"""Sinks: partitioned aggregates with provenance, metric tables, views, and capped SQL.

A stored aggregate is a folder of Parquet parts by period, chunk and run, with two small records beside them: `_schema`
holds the columns of all that was written (a file for each different set), `_log` a row for each chunk of each write.
Readers take the columns from the first, so that no part's footer is read to plan a query, and the attempts that they
show from the second: a join of the parts with it on the partition columns, from which Spark prunes the others before it
reads them.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stateroll.sources.scratch import dropped, folder, settled

PROVENANCE = ["pipeline_run_id", "chunk_id", "period", "created_at", "config_hash"]
#: Folders of a stored aggregate, from the outside in.
PARTS = ("period", "chunk_id", "pipeline_run_id")
#: The log's bytes up to which the attempts to be shown are broadcast; its columns (written_at is in nanoseconds).
LOG_BYTES = 64 << 20
LOG = "chunk_id string, pipeline_run_id string, config_hash string, created_at timestamp, n_rows long, written_at long"


def canonical(value):
    """Nulls dropped, whole floats as integers, keys in order; a choice of two is a case of one condition."""
    if isinstance(value, dict):
        if value.get("op") == "when_then" and all(k in value for k in ("cond", "then", "else")):
            value = {"op": "case", "when": [{k: value[k] for k in ("cond", "then")}], "else": value["else"]}
        return {str(k): canonical(v) for k, v in sorted(value.items()) if v is not None}
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() else value


def config_hash(spec: dict, execution_only: tuple[str, ...] = ("parallel", "threads", "memory_limit", "description")) -> str:
    """SHA-256 of what changes results; settings of execution aren't part of it."""
    kept = {k: v for k, v in spec.items() if k not in execution_only}
    return hashlib.sha256(json.dumps(canonical(kept), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def stamped(df: DataFrame, run_id: str, chunk: str | None, spec_hash: str, created_at: str | None = None) -> DataFrame:
    """Provenance columns; a chunk of None keeps the frame's own chunk_id."""
    made = F.lit(created_at).cast("timestamp") if created_at else F.current_timestamp()
    out = df.withColumn("pipeline_run_id", F.lit(run_id)).withColumn("config_hash", F.lit(spec_hash)).withColumn("created_at", made)
    return out if chunk is None else out.withColumn("chunk_id", F.lit(chunk))


def write_aggregate(df: DataFrame, path: str) -> DataFrame:
    """append_aggregate(), and the receipts of what was written, for which all parts' folders are listed."""
    done = append_aggregate(df, path)
    return receipts(_stored(df.sparkSession, path).where(_one_of(done)))


def append_aggregate(df: DataFrame, path: str) -> list[tuple[str, str]]:
    """Write rows with provenance, partitioned by period, chunk and run. Gives the chunks and runs written. What was written before isn't listed or read.

    The reduction runs once, into a working table, which is checked and then published; so runs of one chunk lie side
    by side, and a failed one leaves those before it. Rows without a period, chunk or run, and chunks of more than one run
    or hash in one write, are refused. Of repeated attempts, scan_aggregate() shows the newest. Readers see a write
    once it is in the log, which comes last.
    """
    missing = [c for c in PROVENANCE if c not in df.columns]
    if missing:
        raise ValueError(f"provenance columns are missing: {', '.join(missing)}")
    spark, staging = df.sparkSession, folder(df.sparkSession)
    staged = settled(df, staging)
    try:
        texts = [F.col(c).cast("string").alias(c) for c in ("chunk_id", "pipeline_run_id", "config_hash")]
        bare = F.count_if(F.expr(" OR ".join(f"coalesce(cast({c} AS string), '') = ''" for c in PARTS))).alias("bare")
        # a row a chunk of this write
        done = staged.groupBy(*texts).agg(F.max("created_at").alias("created_at"), F.count(F.lit(1)).alias("n_rows"), bare).collect()
        if any(r.bare for r in done):
            raise ValueError("rows without a period, a chunk or a run")
        if len({r.chunk_id for r in done}) < len(done):
            raise ValueError("a chunk of several runs or configurations")
        _note_schema(spark, path, staged.schema)
        staged.write.partitionBy(*PARTS).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
        at = time.time_ns()
        spark.createDataFrame([(r.chunk_id, r.pipeline_run_id, r.config_hash, r.created_at, r.n_rows, at) for r in done], LOG).coalesce(1).write.mode("append").parquet(f"{path}/_log")
    finally:
        dropped(spark, staging)
    return [(r.chunk_id, r.pipeline_run_id) for r in done]


def _attempt() -> Column:
    """Chunk and run as one text, of partition columns alone: Spark evaluates it for each folder before it reads any."""
    return F.concat("chunk_id", F.lit("\n"), "pipeline_run_id")


def _one_of(attempts: list[tuple[str, str]]) -> Column:
    return _attempt().isin([f"{c}\n{r}" for c, r in attempts])


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _note_schema(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Keep the columns of a write, under a name that follows from them; a column of another type than before is refused."""
    _joint([*_schemas(spark, path), schema])
    text = schema.json()
    store, file = _file(spark, f"{path}/_schema/{hashlib.sha256(text.encode()).hexdigest()}.json")
    if not store.exists(file):
        out = store.create(file, True)
        out.write(bytearray(text.encode()))
        out.close()


def _schemas(spark: SparkSession, path: str) -> list[T.StructType]:
    store, at = _file(spark, f"{path}/_schema")
    out = []
    for status in store.listStatus(at) if store.exists(at) else []:
        source = store.open(status.getPath())
        out.append(T.StructType.fromJson(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))))
        source.close()
    return out


def _joint(schemas: list[T.StructType]) -> T.StructType:
    """All columns of all schemas; folders' names are text: a chunk `01` isn't the number 1."""
    fields: dict[str, T.StructField] = {}
    for f in (f for s in schemas for f in s):
        kind = T.StringType() if f.name in PARTS else f.dataType
        if f.name in fields and fields[f.name].dataType != kind:
            raise ValueError(f"column {f.name} is stored as {fields[f.name].dataType.simpleString()} and as {kind.simpleString()}")
        fields[f.name] = T.StructField(f.name, kind)
    return T.StructType(sorted(fields.values(), key=lambda f: f.name in PARTS))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """All parts of a partitioned folder; of one that keeps no record of its columns, by their footers."""
    known = _schemas(spark, path)
    return spark.read.schema(_joint(known or [spark.read.option("mergeSchema", True).parquet(path).schema])).parquet(path)


def attempts_of(spark: SparkSession, path: str, spec_hash: str | None = None) -> DataFrame:
    """The log's rows; of one configuration if asked for."""
    log = spark.read.schema(LOG).parquet(f"{path}/_log").where("n_rows > 0")
    return log if spec_hash is None else log.where(F.col("config_hash") == spec_hash)


def _shown(path: str, stored: DataFrame, pointer: DataFrame) -> DataFrame:
    """The parts that the pointer names: it is broadcast, and partitions are pruned by it. It holds rows of the log, whose size is checked; a larger one is joined as Spark sees fit."""
    store, log = _file(stored.sparkSession, f"{path}/_log")
    small = store.getContentSummary(log).getLength() <= LOG_BYTES
    names = pointer.select(_attempt().alias("_attempt"))
    return stored.join(F.broadcast(names) if small else names, _attempt() == F.col("_attempt"), "left_semi")


def receipts(stored: DataFrame) -> DataFrame:
    """(run, chunk, period, hash) with rows, files and their bytes."""
    keys = ["pipeline_run_id", "chunk_id", "period", "config_hash"]
    by_file = stored.withColumn("period", F.col("period").cast("string")).groupBy(*keys, F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("size"))
    return by_file.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("size_bytes"))


def scan_aggregate(spark: SparkSession, path: str, spec_hash: str | None = None, every_attempt: bool = False) -> DataFrame:
    """Stored rows, of each chunk its newest attempt (of equal times, the greater run), or with every_attempt all; of one configuration if asked for."""
    stored, log = _stored(spark, path), attempts_of(spark, path, spec_hash)
    if not every_attempt:
        last = F.max_by("pipeline_run_id", F.struct("created_at", "pipeline_run_id")).alias("pipeline_run_id")
        log = log.groupBy("chunk_id").agg(last)
    shown = _shown(path, stored, log)
    return shown if spec_hash is None else shown.where(F.col("config_hash") == spec_hash)


def visible_rows(spark: SparkSession, path: str, attempts: DataFrame, spec_hash: str) -> DataFrame:
    """What current_view() shows, from a stored aggregate: attempts that are visible, newest of each chunk, by one scan of their parts.

    The pointer, a row a visible chunk, is written first: what prunes partitions is then one small scan, as it must be.
    """
    log = attempts_of(spark, path, spec_hash).join(visible(attempts).select("chunk_id", "pipeline_run_id"), ["chunk_id", "pipeline_run_id"], "left_semi")
    newest_of = log.withColumn("_last", F.max("created_at").over(W.partitionBy("chunk_id"))).where("created_at = _last")
    pointer = settled(newest_of.select("chunk_id", "pipeline_run_id", "n_rows")).where("n_rows > 0")
    shown = _shown(path, _stored(spark, path), pointer)
    return without_binary(shown.where(F.col("config_hash") == spec_hash))


@dataclass(frozen=True)
class Removed:
    """A folder that vacuum removed, or would: what it held, and how much."""

    path: str
    kind: str
    bytes: int


def vacuum(spark: SparkSession, path: str, older_than: float, spec_hash: str | None = None, dry_run: bool = False, now: float | None = None) -> list[Removed]:
    """Remove what no reader of a stored aggregate is shown any more, and hasn't been for so many seconds.

    Superseded attempts go (a newer one of their chunk and configuration is in the log, and has been for that long), with spec_hash those of
    other configurations too, and parts of attempts that never came into the log (a failed write). Readers that began
    before, within that time, still find what they were shown.
    """
    limit = ((time.time() if now is None else now) - older_than) * 1e9
    order = W.partitionBy("chunk_id", "config_hash").orderBy("created_at", "pipeline_run_id")
    log = spark.read.schema(LOG).parquet(f"{path}/_log").where("n_rows > 0")
    # of repeated writes of one attempt the last counts
    log = log.groupBy("chunk_id", "pipeline_run_id", "config_hash").agg(F.max("created_at").alias("created_at"), F.max("written_at").alias("written_at"))
    # superseded once any later attempt was written
    later = F.min("written_at").over(order.rowsBetween(1, W.unboundedFollowing))
    rows = log.withColumn("until", F.greatest(later, "written_at"))
    if spec_hash is not None:
        rows = rows.withColumn("until", F.when(F.col("config_hash") == spec_hash, F.when(later.isNotNull(), F.col("until"))).otherwise(F.col("written_at")))
    else:
        rows = rows.withColumn("until", F.when(later.isNotNull(), F.col("until")))
    state = {(r.chunk_id, r.pipeline_run_id): r.until for r in rows.select("chunk_id", "pipeline_run_id", "until").toLocalIterator()}  # a row an attempt
    store, pattern = _file(spark, f"{path}/" + "/".join(f"{p}=*" for p in PARTS))
    out = []
    for status in store.globStatus(pattern) or []:
        names = dict(part.split("=", 1) for part in status.getPath().toString().split("/")[-len(PARTS) :])
        attempt = (unquote(names["chunk_id"]), unquote(names["pipeline_run_id"]))
        kind = "superseded" if attempt in state else "unfinished"
        until = state[attempt] if attempt in state else status.getModificationTime() * 1e6
        if until is not None and until < limit:
            out.append(_removed(store, status.getPath(), kind, dry_run))
    return out


def _removed(store, at, kind: str, dry_run: bool) -> Removed:
    one = Removed(at.toString(), kind, store.getContentSummary(at).getLength())
    if not dry_run:
        store.delete(at, True)
    return one


def vacuum_versions(spark: SparkSession, target: str, older_than: float, dry_run: bool = False, now: float | None = None) -> list[Removed]:
    """Remove a published table's versions but the current one, where a later one was published so many seconds ago; and those that were never published."""
    limit = ((time.time() if now is None else now) - older_than) * 1e9
    pointers = spark.read.parquet(f"{target}/pointers").orderBy(F.desc("at"), "version").select("version", "at").collect()  # a row a version
    until = {r.version: (pointers[k - 1].at if k else None) for k, r in enumerate(pointers)}
    store, at = _file(spark, f"{target}/versions")
    out = []
    for status in store.listStatus(at):
        name = status.getPath().getName()
        end = until[name] if name in until else status.getModificationTime() * 1e6
        if end is not None and end < limit:
            out.append(_removed(store, status.getPath(), "superseded" if name in until else "unfinished", dry_run))
    return out


def publish(df: DataFrame, target: str, by: tuple[str, ...] = ("period", "chunk_id", "pipeline_run_id")) -> None:
    """Write df as a new version of the target and then point to it: readers see the version before until all of it is there."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.partitionBy(*by).parquet(f"{target}/versions/{version}")
    _note_schema(spark, f"{target}/versions/{version}", df.schema)
    pointer = spark.range(1).select(F.lit(version).alias("version"), F.lit(time.time_ns()).alias("at"))
    pointer.write.mode("append").parquet(f"{target}/pointers")


def current(spark: SparkSession, target: str) -> DataFrame:
    """The version that was published last."""
    version = spark.read.parquet(f"{target}/pointers").orderBy(F.desc("at"), "version").first().version
    return _stored(spark, f"{target}/versions/{version}")


def without_binary(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in df.schema if f.dataType.typeName() != "binary"])


def export_metrics(spark: SparkSession, metrics: dict[str, Callable[[], DataFrame]], tags: dict[str, str], grain: str) -> DataFrame:
    """A table metric_NAME_GRAIN for each metric, with tag columns; and a manifest of what was exported, and what was skipped and why."""
    done = []
    for name, make in metrics.items():
        try:
            df = without_binary(make()).withColumns({"_metric": F.lit(name), "_grain": F.lit(grain)} | {f"_{k}": F.lit(v) for k, v in tags.items()})
            df.write.mode("overwrite").saveAsTable(f"metric_{name}_{grain}")
            done.append((name, f"metric_{name}_{grain}", "exported", ""))
        except ValueError as e:  # a metric that doesn't exist at this grain
            done.append((name, None, "skipped", str(e)))
    return spark.createDataFrame(done, "metric string, table_name string, status string, reason string")


def visible(attempts: DataFrame) -> DataFrame:
    """Of each source and chunk the latest attempt that succeeded in a finished run; a failed replacement leaves the one before."""
    ok = attempts.where("status = 'ok' AND run_status IN ('ok', 'failed', 'partial')")
    n = F.row_number().over(W.partitionBy("source", "chunk_id").orderBy(F.desc("attempt_at"), F.desc("pipeline_run_id")))
    return ok.withColumn("_n", n).where("_n = 1").drop("_n")


def newest(df: DataFrame) -> DataFrame:
    """Of each chunk the rows with the greatest created_at."""
    last = df.groupBy(F.col("chunk_id").alias("_chunk")).agg(F.max("created_at").alias("_last"))
    return df.join(last, F.col("chunk_id").eqNullSafe(F.col("_chunk")) & (F.col("created_at") == F.col("_last")), "left_semi")


def current_view(stored: DataFrame, attempts: DataFrame, spec_hash: str, name: str | None = None) -> DataFrame:
    """Rows of visible attempts under the current hash, newest per chunk, without sketches; registered under `name`."""
    keys = visible(attempts).select("pipeline_run_id", "chunk_id")
    df = without_binary(newest(stored.where(F.col("config_hash") == spec_hash).join(keys, ["pipeline_run_id", "chunk_id"], "left_semi")))
    if name:
        df.createOrReplaceTempView(name)
    return df


def run_sql(spark: SparkSession, sql: str, limit: int = 500, most: int = 2_000) -> tuple[DataFrame, bool]:
    """At most `limit` rows of a query, without binary columns, and whether there were more."""
    cap = max(1, min(limit, most))
    df = without_binary(spark.sql(sql))
    return df.limit(cap), len(df.limit(cap + 1).select(F.lit(1)).collect()) > cap


def governed_tables(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(table, column, type, rows with a value) of the session's tables and views (or the named ones), sketches left out."""
    out = None
    for t in names or [t.name for t in spark.catalog.listTables()]:
        df = without_binary(spark.table(t))
        counts = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"_{k}") for k, f in enumerate(df.schema)])
        rows = F.explode(F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"_{k}").alias("non_null")) for k, f in enumerate(df.schema)]))
        one = counts.select(rows.alias("r")).select("r.*")
        out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], "table_name string, column_name string, data_type string, non_null long")
