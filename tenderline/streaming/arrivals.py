"""An event log as it arrives: part by part, some rows days after they were written."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

#: Parts that the log arrives in, days that each spans, and days that rows of some numbers (remainders by 13) come late.
PARTS, DAYS, LATE_DAYS = 5, 7, {5: 10, 7: 3}


def part_of(log: DataFrame, n: Column, ts: Column) -> Column:
    """The part, from 0, in which a row of number n arrives. Parts count from the first day of the log; the last one takes all that is left."""
    start = log.agg(F.min(F.to_date(ts))).first()[0]
    late = F.coalesce(*[F.when(n % 13 == r, F.lit(days)) for r, days in LATE_DAYS.items()], F.lit(0))
    return F.least(F.floor((F.date_diff(F.to_date(ts), F.lit(start)) + late) / DAYS), F.lit(PARTS - 1)).cast("int")


def replay(tables: dict[str, DataFrame], run: Callable[[], DataFrame]) -> Iterator[DataFrame]:
    """Publishes the rows of each part (`part`, of tables by folder) and runs the streams that read these folders, part after part; what each run gives."""
    for k in range(PARTS):
        for path, rows in tables.items():
            rows.where(F.col("part") == k).drop("part").write.mode("append").parquet(path)
        yield run()
