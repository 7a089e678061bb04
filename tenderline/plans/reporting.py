"""Queries on runs, calls, edits and accuracy, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderline.operators import operations as op
from tenderline.plans.quoting import rounded
from tenderline.sources.adapters import ctes, domain, doubles


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Quoted prices against recorded costs at the same part, plant and quantity."""
    h = domain(spark, d, "history").select("part_id", "plant", "qty", F.col("unit_price").alias("estimate"))
    return h.join(domain(spark, d, "part_costs").withColumnRenamed("unit_cost", "actual"), ["part_id", "plant", "qty"])


def trace_totals(spark, d):
    return op.trace_totals(domain(spark, d, "calls"))


def call_log(spark, d):
    return op.call_log_summary(domain(spark, d, "calls"))


def call_stats(spark, d):
    return op.call_stats(domain(spark, d, "calls"))


def latest_runs(spark, d):
    return op.latest_runs(domain(spark, d, "calls")).select("rfq_id", "node", "ok")


def time_edits(spark, d):
    return op.time_edits(domain(spark, d, "edited")).withColumns({c: rounded(c) for c in ("cycle_ratio", "setup_ratio")})


def edits_by_work_center(spark, d):
    return op.by_work_center(op.time_edits(domain(spark, d, "edited"))).withColumns({c: rounded(c) for c in ("cycle_ratio", "setup_ratio")})


def correction_factors(spark, d):
    return op.correction_factors(op.time_edits(domain(spark, d, "edited"))).withColumn("factor", rounded("factor"))


def error_metrics(spark, d):
    cols = ("median_abs", "within_10", "within_20", "median_signed", "mean_signed")
    return op.error_metrics(_points(spark, d), ["plant"]).withColumns({c: rounded(c) for c in cols})


def error_histogram(spark, d):
    return op.error_histogram(_points(spark, d))


def latest_quotes(spark, d):
    return op.upsert_latest(domain(spark, d, "history"), ["part_id", "plant"], ["quote_no"]).select("part_id", "plant", "quote_no", "qty")


QUERIES = {f.__name__: f for f in (trace_totals, call_log, call_stats, latest_runs, time_edits, edits_by_work_center, correction_factors, error_metrics, error_histogram, latest_quotes)}
_EDITS = ctes("edited") + """, t AS (SELECT rfq_id, line_no, seq, centre, CASE WHEN removed THEN 'removed' WHEN abs(after_cycle - before_cycle) > 1e-9 OR abs(after_setup - before_setup) > 1e-9 THEN 'time' END AS kind,
    CASE WHEN NOT removed THEN after_cycle / before_cycle END AS cycle_ratio, CASE WHEN NOT removed THEN after_setup / before_setup END AS setup_ratio FROM edited), e AS (SELECT * FROM t WHERE kind IS NOT NULL)"""
_POINTS = ctes("history", "part_costs") + ", p AS (SELECT plant, unit_price AS estimate, unit_cost AS actual, (unit_price - unit_cost) / unit_cost AS e FROM history JOIN part_costs USING (part_id, plant, qty))"
ORACLES = {
    "trace_totals": ctes("calls") + " SELECT rfq_id, count(*) AS n_calls, count(*) FILTER (WHERE cache_hit) AS cache_hits, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, sum(latency_ms)::BIGINT AS latency_ms FROM calls GROUP BY 1",
    "call_log": ctes("calls") + " SELECT node, count(*) AS n_calls, count(*) FILTER (WHERE cache_hit) AS cache_hits, sum(tokens_in + tokens_out)::BIGINT AS tokens, count(*) FILTER (WHERE NOT ok) AS failures FROM calls GROUP BY 1",
    "call_stats": ctes("calls") + " SELECT node, count(*) AS n, median(latency_ms) AS median_ms, max(latency_ms) AS max_ms, sum(greatest(attempts - 1, 0))::BIGINT AS retries FROM calls GROUP BY 1",
    "latest_runs": ctes("calls") + " SELECT rfq_id, node, ok FROM (SELECT *, row_number() OVER (PARTITION BY rfq_id ORDER BY ts DESC, id DESC) AS k FROM calls) WHERE k = 1",
    "time_edits": _EDITS + " SELECT rfq_id, line_no, seq, centre, kind, round(cycle_ratio + 1e-7, 4) AS cycle_ratio, round(setup_ratio + 1e-7, 4) AS setup_ratio FROM e",
    "edits_by_work_center": _EDITS + " SELECT centre, count(*) AS n_edits, round(avg(cycle_ratio) + 1e-7, 4) AS cycle_ratio, round(avg(setup_ratio) + 1e-7, 4) AS setup_ratio, count(*) FILTER (WHERE kind = 'removed') AS removals FROM e GROUP BY 1",
    "correction_factors": _EDITS + " SELECT centre, round(median(cycle_ratio) + 1e-7, 4) AS factor, count(*) AS n, count(DISTINCT rfq_id) AS n_rfqs FROM e WHERE cycle_ratio IS NOT NULL GROUP BY 1 HAVING count(*) >= 20 AND count(DISTINCT rfq_id) >= 5",
    "error_metrics": _POINTS + " SELECT plant, count(*) AS n, count(*) FILTER (WHERE estimate IS NULL) AS infeasible, round(median(abs(e)) + 1e-7, 4) AS median_abs, round(avg((abs(e) <= 0.1)::INT) + 1e-7, 4) AS within_10, round(avg((abs(e) <= 0.2)::INT) + 1e-7, 4) AS within_20, round(median(e) + 1e-7, 4) AS median_signed, round(avg(e) + 1e-7, 4) AS mean_signed FROM p GROUP BY GROUPING SETS ((plant), ())",
    "error_histogram": _POINTS + " SELECT floor(greatest(-0.6, least(0.6, e)) / 0.05 + 1e-9)::BIGINT AS bin, count(*) AS n FROM p WHERE estimate IS NOT NULL AND actual <> 0 GROUP BY 1",
    "latest_quotes": ctes("history") + " SELECT part_id, plant, quote_no, qty FROM (SELECT *, row_number() OVER (PARTITION BY part_id, plant ORDER BY quote_no DESC) AS k FROM history) WHERE k = 1",
}
ORACLES = {k: doubles(v) for k, v in ORACLES.items()}
