"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that spark.checkpoint.dir names. Only where one machine does all the work (local mode) is a temporary one made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tenderline-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: for what several aggregations read, which would each compute it anew."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables by session, source and name, and where they are.
_kept: dict[tuple[str, str, str], tuple[DataFrame, str]] = {}


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def once(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """build(), written the first time a session asks for `name` over `source` and read from there on: for tables that many queries are made of. Written anew if its folder is gone."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _kept or not _there(spark, _kept[key][1]):
        path = folder(spark, name)
        df = build()
        df.write.parquet(path)
        _kept[key] = (spark.read.schema(df.schema).parquet(path), path)
    return _kept[key][0]
