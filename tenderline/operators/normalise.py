"""Clean-up of printed sizes, the plant of made parts, and price changes of a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderline.functions.expressions import truthy

INCH_MM = 25.4


def in_mm(x: Column) -> Column:
    """A size in inches as millimetres, to four places; a missing size stays missing."""
    return F.round(x * INCH_MM + 1e-7, 4)


def metric(rows: DataFrame, sizes: list[str], inch: Column) -> DataFrame:
    """rows with the size columns in millimetres and `converted`, true where they were in inches. A projection (NR-07)."""
    is_inch = F.coalesce(inch, F.lit(False))
    return rows.withColumns({c: F.when(is_inch, in_mm(F.col(c))).otherwise(F.col(c)) for c in sizes} | {"converted": is_inch})


def outer_size() -> Column:
    """A feature's outer size: tip diameter m (z + 2) of gears, nominal size of outer diameters and splines, else null (NR-08)."""
    teeth, module = truthy(F.col("teeth")), truthy(F.col("module"))
    gear = (F.col("ftype") == "gear") & teeth.isNotNull() & module.isNotNull()
    return F.when(gear, module * (teeth + 2)).when(F.col("ftype").isin("outer_diameter", "spline"), F.col("nominal"))


def derived_envelopes(printed: DataFrame, features: DataFrame) -> DataFrame:
    """Envelopes with what features tell where nothing is printed, for rotational parts only (NR-09).

    The diameter is the largest outer size, the length the sum over outer diameters. derived_diameter and derived_length tell which were;
    incomplete: a size that the shape needs is still missing. Features are summed before the shuffle.
    """
    known = features.groupBy("part_id").agg(
        F.max(truthy(outer_size())).alias("_d"),
        F.round(F.sum(F.when(F.col("ftype") == "outer_diameter", truthy(F.col("len_mm")))) + 1e-7, 3).alias("_l"),
    )
    turned = F.col("shape_class") == "rotational"
    from_d, from_l = (turned & F.col(c).isNull() & F.col(k).isNotNull() for c, k in (("max_diameter_mm", "_d"), ("length_mm", "_l")))
    joined = printed.join(known, "part_id", "left").withColumns({"derived_diameter": from_d, "derived_length": from_l})
    filled = joined.withColumns({"max_diameter_mm": F.when(turned, F.coalesce("max_diameter_mm", "_d")).otherwise(F.col("max_diameter_mm")), "length_mm": F.when(turned, F.coalesce("length_mm", "_l")).otherwise(F.col("length_mm"))})
    lacking = lambda *names: F.greatest(*[F.col(n).isNull() for n in names])
    gaps = F.when(turned, lacking("max_diameter_mm", "length_mm")).when(F.col("shape_class") == "prismatic", lacking("length_mm", "width_mm", "height_mm")).otherwise(F.lit(False))
    return filled.withColumn("incomplete", gaps).drop("_d", "_l")


def make_plants(items: DataFrame, keys: list[str], home: str = "DE", *more: Column) -> DataFrame:
    """Per line the plant its made parts come from: their common one, the home plant if they differ or one is unknown, null without any (CO-11); with further aggregates."""
    made = F.when(F.col("make"), F.col("plant"))
    same = (F.min(made) == F.max(made)) & (F.count(made) == F.count_if("make"))
    return items.groupBy(*keys).agg(F.when(F.count_if("make") == 0, F.lit(None)).when(same, F.min(made)).otherwise(F.lit(home)).alias("make_plant"), *more)


def price_changes(edits: DataFrame) -> DataFrame:
    """Absolute and percent change of each price cell in a request's last review round; null where a price is missing (FB-07)."""
    last = edits.withColumn("_last", F.max("round").over(Window.partitionBy("rfq_id"))).where(F.col("round") == F.col("_last")).drop("_last")
    step = F.col("after") - F.col("before")
    return last.withColumns({"change": F.round(step + 1e-7, 2), "change_pct": F.round(step / truthy(F.col("before")) * 100 + 1e-7, 2)})
