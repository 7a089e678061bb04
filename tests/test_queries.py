"""Registered queries against their SQL on the smallest tables, and hand-computed cases."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tenderline.functions import expressions as fx
from tenderline.operators import costing
from tenderline.sources.adapters import GIVEN

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat()[:10] if hasattr(v, "isoformat") else v


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in GIVEN:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    cols = sorted(want.columns)
    rows = [tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()]
    df = entry.queries()[name](spark, str(DATA))
    assert sorted(df.columns) == cols
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == sorted(rows, key=repr)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def test_norm_token(spark):
    from pyspark.sql import functions as F

    assert one(spark, fx.norm_token(F.col("x")), "m6 × 20-8.8") == "M6X2088"
    assert one(spark, fx.slug(F.col("x")), " Größe é 12! ") == "gro-e-e-12"
    assert one(spark, fx.plain_number(F.col("x")), 4.20, "double") == "4.2"
    assert one(spark, fx.money(F.col("x"), "de"), 1234.5, "double") == "1.234,50"


def test_simple_part_price(spark):
    """Turning 30 / 4.2 minutes at 95 an hour, 1.5 kg at 2.40, 200 pieces."""
    cells = spark.createDataFrame([(1, 1, 200, "DE", "M", 1.5, 0.10, 0.03, 5, 0, None)], "rfq_id long, line_no int, qty int, plant string, material_code string, weight_kg double, overhead_pct double, logistics_pct double, base_weeks int, ord int, due date")
    ops = spark.createDataFrame([(1, 1, 10, "TURN", None, 30.0, 4.2, False), (1, 1, 20, "GRIND", None, 9.0, 9.0, True)], "rfq_id long, line_no int, seq int, centre string, service string, setup_min double, cycle_min double, suggested boolean")
    centres = spark.createDataFrame([("TURN", "DE", 95.0)], "code string, plant string, rate_eur_h double")
    services = spark.createDataFrame([("HT", 2.0, 120.0)], "code string, price_eur_kg double, lot_min_eur double")
    materials = spark.createDataFrame([("M", 2.4)], "code string, price_eur_kg double")
    row = costing.breakdown(cells, costing.cost_lines(cells, ops, centres, services, materials)).first()
    assert row["feasible"] and abs(row["unit_price"] - ((1.5 * 2.4 * 1.03) + (30 / 200 + 4.2) / 60 * 95) * 1.13 / 0.82) < 1e-9
    lacking = costing.breakdown(cells, costing.cost_lines(cells, ops, centres.where("false"), services, materials)).first()
    assert not lacking["feasible"] and lacking["reason"] == "no TURN at DE" and lacking["unit_price"] is None
