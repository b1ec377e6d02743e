"""Cut lineage: tables in the folder that spark.checkpoint.dir names, which all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder name. Where the setting is absent, a session on one machine gets a temporary folder; on a cluster, where that would be another folder on each machine, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="stateroll-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/stateroll-{uuid.uuid4().hex}"


def settled(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written once and read back: what it computed stays as it was, whatever executor is lost."""
    path = path or folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing will read again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
