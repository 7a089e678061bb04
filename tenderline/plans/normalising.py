"""Queries on printed sizes, made parts and price changes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderline.operators import normalise
from tenderline.plans.quoting import rounded
from tenderline.sources.adapters import ctes, domain, doubles

SIZES = ["nominal", "len_mm", "band"]


def metric_features(spark: SparkSession, d: str) -> DataFrame:
    """NR-07."""
    rows = domain(spark, d, "features").join(domain(spark, d, "printed").select("part_id", "inch"), "part_id")
    out = normalise.metric(rows.select("part_id", "fid", *SIZES, "inch"), SIZES, F.col("inch")).drop("inch")
    return out.withColumns({c: rounded(c) for c in SIZES})


def derived_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """NR-08, NR-09."""
    out = normalise.derived_envelopes(domain(spark, d, "printed").drop("inch"), domain(spark, d, "features"))
    return out.withColumns({c: rounded(c) for c in ("max_diameter_mm", "length_mm")})


def make_plants(spark: SparkSession, d: str) -> DataFrame:
    """CO-11."""
    return normalise.make_plants(domain(spark, d, "make_items"), ["rfq_id"])


def price_changes(spark: SparkSession, d: str) -> DataFrame:
    """FB-07."""
    return normalise.price_changes(domain(spark, d, "price_edits")).withColumns({c: rounded(c) for c in ("before", "after")})


_MM = ", ".join(f"CASE WHEN inch THEN round(round({c} * {normalise.INCH_MM} + 1e-7, 4) + 1e-7, 4) ELSE round({c} + 1e-7, 4) END AS {c}" for c in SIZES)
QUERIES = {f.__name__: f for f in (metric_features, derived_envelopes, make_plants, price_changes)}
ORACLES = {
    "metric_features": ctes("features", "printed") + f" SELECT f.part_id, fid, {_MM}, inch AS converted FROM features f JOIN printed p ON p.part_id = f.part_id",
    "derived_envelopes": ctes("features", "printed") + """, k AS (SELECT part_id, max(CASE WHEN ftype = 'gear' AND teeth <> 0 AND module <> 0 THEN module * (teeth + 2) WHEN ftype IN ('outer_diameter', 'spline') AND nominal <> 0 THEN nominal END) AS d, round(sum(CASE WHEN ftype = 'outer_diameter' THEN len_mm END) + 1e-7, 3) AS l FROM features GROUP BY 1),
        x AS (SELECT p.part_id, shape_class, width_mm, height_mm, CASE WHEN shape_class = 'rotational' THEN coalesce(max_diameter_mm, d) ELSE max_diameter_mm END AS dm, CASE WHEN shape_class = 'rotational' THEN coalesce(length_mm, l) ELSE length_mm END AS lm,
            shape_class = 'rotational' AND max_diameter_mm IS NULL AND d IS NOT NULL AS derived_diameter, shape_class = 'rotational' AND length_mm IS NULL AND l IS NOT NULL AS derived_length FROM printed p LEFT JOIN k ON k.part_id = p.part_id)
        SELECT part_id, shape_class, round(dm + 1e-7, 4) AS max_diameter_mm, round(lm + 1e-7, 4) AS length_mm, width_mm, height_mm, derived_diameter, derived_length,
            CASE shape_class WHEN 'rotational' THEN dm IS NULL OR lm IS NULL WHEN 'prismatic' THEN lm IS NULL OR width_mm IS NULL OR height_mm IS NULL ELSE FALSE END AS incomplete FROM x""",
    "make_plants": ctes("make_items") + " SELECT rfq_id, CASE WHEN count(*) FILTER (make) = 0 THEN NULL WHEN count(DISTINCT coalesce(plant, '?')) FILTER (make) = 1 AND bool_and(plant IS NOT NULL) FILTER (make) THEN min(plant) FILTER (make) ELSE 'DE' END AS make_plant FROM make_items GROUP BY 1",
    "price_changes": ctes("price_edits") + """, m AS (SELECT rfq_id, max(round) AS round FROM price_edits GROUP BY 1)
        SELECT e.rfq_id, e.round, cell, round(before + 1e-7, 4) AS before, round(after + 1e-7, 4) AS after, round(after - before + 1e-7, 2) AS change, round((after - before) / nullif(before, 0) * 100 + 1e-7, 2) AS change_pct FROM price_edits e JOIN m ON m.rfq_id = e.rfq_id AND m.round = e.round""",
}
ORACLES = {k: doubles(v) for k, v in ORACLES.items()}
