"""Streams of model outputs and of review rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tenderline.sources.files import check_contract
from tenderline.sources.scratch import folder


def drain_contract(raw: DataFrame, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """ST-01: check_contract() over a stream of texts until its end: (good, quarantined), as far as they have arrived.

    Each micro-batch writes both sides into its own folder, so that one that is run again replaces itself.
    """
    spark, out = raw.sparkSession, folder(raw.sparkSession, "contract")

    def keep(batch: DataFrame, n: int) -> None:
        for name, rows in zip(("good", "bad"), check_contract(batch, schema, required)):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={n}")

    raw.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return tuple(spark.read.parquet(f"{out}/{name}").drop("batch") for name in ("good", "bad"))


def paired_rounds(pending: DataFrame, results: DataFrame, late: str = "2 hours") -> DataFrame:
    """ST-03: each pending round (id, ts, ...) with its recomputed result (id, done, ...), if that comes within `late`. Stream-stream join.

    Both sides have watermarks of that length, so the state of a round is dropped once no result can meet it.
    """
    a, b = pending.withWatermark("ts", late), results.withColumnRenamed("id", "of").withWatermark("done", late)
    return a.join(b, F.expr(f"id = of and done >= ts and done <= ts + interval {late}")).drop("of")


def drain_pairs(pairs: DataFrame, at: str | None = None) -> DataFrame:
    """The rows of a stream of pairs until its end; `at` holds state and rows, and a later run with the same folder goes on from there.

    A row behind the watermark of the run before meets nothing.
    """
    spark, out = pairs.sparkSession, at or folder(pairs.sparkSession, "pairs")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")

    pairs.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")
