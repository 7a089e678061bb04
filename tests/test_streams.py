"""Streams that are run again and again as parts arrive; what the watermark drops is computed by hand."""

import datetime

from pyspark.sql import functions as F

from tenderline.sources import scratch
from tenderline.streaming import arrivals, calls, contracts


def at(day, hour=0, minute=0):
    return datetime.datetime(2024, 1, day, hour, minute)


def test_windows_go_on_and_late_rows_drop(spark):
    parts = [
        [(at(1), "a", 5, True), (at(2), "a", 7, False)],
        [(at(2, 9), "a", 1, True), (at(12), "b", 2, True)],  # the window of day 2 is still open
        [(at(3), "a", 9, True), (at(5), "a", 4, True)],  # behind 12 January less 7 days: day 3 goes, day 5 just stays
    ]
    rows = spark.createDataFrame([(*r, k) for k, p in enumerate(parts) for r in p], "ts timestamp, node string, latency_ms long, ok boolean, part int")
    log, state = scratch.folder(spark, "log"), scratch.folder(spark, "state")
    run = lambda: calls.drain(calls.windowed_calls(spark.readStream.schema(rows.drop("part").schema).parquet(log)), ["start", "node"], state)
    seen = [{(r["start"].day, r["node"]): (r["n_calls"], r["latency_ms"], r["max_ms"], r["n_failed"]) for r in out.collect()} for out in arrivals.replay({log: rows}, run)]
    assert seen[0] == {(1, "a"): (1, 5, 5, 0), (2, "a"): (1, 7, 7, 1)}
    assert seen[1] == {(1, "a"): (1, 5, 5, 0), (2, "a"): (2, 8, 7, 1), (12, "b"): (1, 2, 2, 0)}
    assert seen[2] == seen[1] | {(5, "a"): (1, 4, 4, 0)} and seen[4] == seen[2]


def test_pairs_across_runs(spark):
    pending = spark.createDataFrame([(1, at(1, 8), 0), (2, at(1, 9), 0), (3, at(1, 9), 1), (4, at(2, 9), 1), (5, at(1, 5), 2)], "id long, ts timestamp, part int")
    # 1 comes at once, 2 a run later though behind nothing, 4 too long after, 5 is far behind the watermark by then
    results = spark.createDataFrame([(1, at(1, 8, 30), 0), (2, at(1, 10), 1), (3, at(1, 9, 30), 1), (4, at(2, 12), 1), (5, at(1, 6), 2)], "id long, done timestamp, part int")
    root, state = scratch.folder(spark, "rounds"), scratch.folder(spark, "state")
    read = lambda t, name: spark.readStream.schema(t.drop("part").schema).parquet(f"{root}/{name}")
    run = lambda: contracts.drain_pairs(contracts.paired_rounds(read(pending, "p"), read(results, "r")), state)
    seen = [sorted(r["id"] for r in out.collect()) for out in arrivals.replay({f"{root}/p": pending, f"{root}/r": results}, run)]
    assert seen[:3] == [[1], [1, 2, 3], [1, 2, 3]] and seen[4] == seen[2]


def test_parts_of_a_log(spark):
    rows = spark.createDataFrame([(0, at(1)), (5, at(1)), (7, at(6)), (1, at(8)), (2, at(31))], "n long, ts timestamp")
    assert [r[0] for r in rows.select(arrivals.part_of(rows, F.col("n"), F.col("ts"))).collect()] == [0, 1, 1, 1, 4]
