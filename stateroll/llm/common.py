"""What the operators of this subpackage share: tables, cut lineage, and Arrow passes over whole rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one vectorised step handles; the arrays of a step take some 40 times as much.
STEP_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and a task's Python, at most (a longer row is a batch of its own).
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on Arrow batches to BATCH_BYTES, so that long texts don't pile up in tasks.

    Spark reads the bound from the session when a plan runs, so it stays lowered for what the caller runs later.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, "67108864").rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def working_tables() -> Iterator[list[str]]:
    """The folders that shared_dir() gives out meanwhile, so that a caller can drop them once their readers are done."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a session on one machine (as in tests) gets a temporary folder; on a cluster that
    would be another folder on each machine, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="stateroll-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/stateroll-{uuid.uuid4().hex}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    if (made := _MADE.get()) is not None:
        made.append(out)
    return out


def file_system(folder: str):
    """The store of a folder's URI, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"file://{folder[5:]}" if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def column(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col(f"`{name}`")


def written(df: DataFrame, path: str | None = None, by: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, and is smaller than an RDD checkpoint."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.partitionBy(*(by or [])).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not by else spark.read.parquet(path)


def drop_written(spark: SparkSession, path: str) -> None:
    """Delete a table of written() that nothing will read again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def steps(lengths: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose texts sum to limit at most; a longer text is a range of its own."""
    total = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right"))
        yield at, max(end, at + 1)
        at = max(end, at + 1)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and where each text begins (one more offset than texts); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if len(texts) else pa.array([], pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def with_row(df: DataFrame) -> DataFrame:
    """All columns of df as one struct `row`: no column that an operator adds can clash with it."""
    small_batches(df.sparkSession)
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def map_texts(
    df: DataFrame, id_col: str | None, text_col: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.Array, pa.Array], dict[str, pa.Array | list]]], keep: str = "row"
) -> DataFrame:
    """One pass over df in Arrow batches, with no shuffle: `row` (all columns; or only the id, as `id`) and the given fields.

    make() runs once a task and gives a function of (ids, texts) that returns one value a row for each field.
    """
    small_batches(df.sparkSession)
    ids = [F.col(f"`{id_col}`").alias("id")] if id_col else []
    source = with_row(df) if keep == "row" else df.select(*ids, F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([source.schema["row" if keep == "row" else "id"], *fields])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        f = make()
        kinds = [to_arrow_type(x.dataType) for x in fields]
        for b in batches:
            if not b.num_rows:
                continue
            first = b.column(0)
            if keep == "row":
                columns = dict(zip([x.name for x in first.type], first.flatten(), strict=True))
                ids_, texts = columns.get(id_col), columns[text_col]
            else:
                ids_, texts = first, b.column(1)
            for s, e in steps(np.array(pc.fill_null(pc.binary_length(texts), 0), np.int64)):
                n = e - s
                out = f(ids_ if ids_ is None else ids_.slice(s, n), texts.slice(s, n))
                yield pa.RecordBatch.from_arrays([first.slice(s, n), *(out[c].cast(k) if isinstance(out[c], pa.Array) else pa.array(out[c], k) for c, k in zip(names, kinds, strict=True))], names=["row" if keep == "row" else "id", *names])

    return source.mapInArrow(run, schema)
