"""Intermediate tables that outlive a lost executor."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[object, str]] = []


def reachable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package; on a cluster it is installed or sent with --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    found = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in found.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, found]))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where one machine does all the work (local mode, as in tests) a temporary one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tenderline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def store(df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends here.

    Without `dictionary` no time is spent on dictionaries, which tables of hashes don't profit from.

    Shuffle files of what led to the table go once the driver has collected its garbage, which is asked for. The table is
    removed by release(), or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def release(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        paths = {f.rsplit("/", 1)[0] for f in t.inputFiles()}
        for spark, path in [x for x in _written if x[1].split(":", 1)[-1].replace("//", "/") in {p.split(":", 1)[-1].replace("//", "/") for p in paths}]:
            _delete(spark, path)
            _written.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: its scratch folder goes with the cluster
            return
