"""Tables that several branches of a plan read: written once, so that the fact table behind them is scanned once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def once(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder of spark.checkpoint.dir and read back, which also cuts its lineage. Where the session names none, a folder of this machine if all tasks run here; on a cluster the table is persisted instead. forget() ends either; files go with the session at the latest."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            held = df.persist(StorageLevel.MEMORY_AND_DISK)
            held._forget = held.unpersist
            return held
        root = f"file://{tempfile.mkdtemp(prefix='talkscale-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/talkscale/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._forget = lambda: files.delete(place, True)
    return out


def forget(df: DataFrame) -> None:
    """Delete or release what once() made of df; nothing may read df afterwards. Other DataFrames are left alone."""
    end = getattr(df, "_forget", None)
    if end:
        end()
