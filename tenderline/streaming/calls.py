"""Call statistics over an arriving log (ST-02)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tenderline.sources.scratch import folder as new_folder


def windowed_calls(calls: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Calls of a stream (ts, node, latency_ms, ok) by window and node; rows later than `late` are dropped by the watermark.

    Exact medians are not streamable: counts, sums, the largest latency and failures only.
    """
    x = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return x.groupBy(F.window("ts", window).alias("w"), "node").agg(F.count("*").alias("n_calls"), F.sum("latency_ms").alias("latency_ms"), F.max("latency_ms").alias("max_ms"), F.count_if(~F.col("ok")).alias("n_failed")).select(F.col("w.start").alias("start"), "node", "n_calls", "latency_ms", "max_ms", "n_failed")


def drain(stream: DataFrame, keys: list[str], at: str | None = None) -> DataFrame:
    """Runs a stream over what has arrived and gives the last state of each key.

    Updates are appended to a table by micro-batch number, each batch into its own folder, so that a batch that is run again
    replaces itself. `at` holds state and updates: a later run with the same folder goes on from there, with watermark and
    open windows as they were left. Rows whose window ended before the watermark of the run before are dropped.
    """
    spark = stream.sparkSession
    folder = at or new_folder(spark, "stream")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    last = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return spark.read.parquet(f"{folder}/out").withColumn("k", F.row_number().over(last)).where("k = 1").drop("k", "batch")
