"""Hand-computed cases of single operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from tenderline.operators import bom, costing, drawings, intake, matching, normalise, quantiles, quotes, reviews, scoring, search, triage, validation
from tenderline.sources import files

CELL = "rfq_id long, line_no int, qty int, plant string, material_code string, weight_kg double, overhead_pct double, logistics_pct double, base_weeks int, ord int, due date"


def cells(spark, *rows):
    return spark.createDataFrame([(1, 1, *r) for r in rows], CELL)


def tables(spark):
    ops = spark.createDataFrame([(1, 1, 10, "TURN", None, 0.0, 6.0, False), (1, 1, 20, "GRIND", None, 9.0, 9.0, True), (1, 1, 30, None, "HT", 0.0, 0.0, False)], "rfq_id long, line_no int, seq int, centre string, service string, setup_min double, cycle_min double, suggested boolean")
    centres = spark.createDataFrame([("TURN", "DE", 60.0), ("TURN", "PL", 60.0)], "code string, plant string, rate_eur_h double")
    services = spark.createDataFrame([("HT", 2.0, 120.0)], "code string, price_eur_kg double, lot_min_eur double")
    return ops, centres, services, spark.createDataFrame([("M", 2.0)], "code string, price_eur_kg double")


def test_lot_minimum_and_order_floor(spark):
    """1.2 kg at 2.00: 12 a piece of ten by the lot minimum of 120, 2.40 of a thousand; an order below 500 costs 500."""
    c = cells(spark, (10, "DE", None, 1.2, 0.0, 0.0, 5, 0, None), (1000, "DE", None, 1.2, 0.0, 0.0, 5, 0, None))
    lines = costing.cost_lines(c, *tables(spark)).where("category = 'outsourced'")
    assert {r["qty"]: round(r["amount"], 9) for r in lines.collect()} == {10: 12.0, 1000: 2.4}
    b = {r["qty"]: r for r in costing.breakdown(c, costing.cost_lines(c, *tables(spark))).collect()}
    assert b[10]["min_order_applied"] and b[10]["total"] == 500.0 and not b[1000]["min_order_applied"]
    assert b[10]["lead_weeks"] == 6


def breakdowns(spark, *rows):
    return spark.createDataFrame([(1, 1, 200, *r) for r in rows], "rfq_id long, line_no int, qty int, plant string, feasible boolean, meets_due boolean, unit_cost double, unit_price double, ord int")


def test_recommended_plant(spark):
    """On time goes before cheap, equal cents go to the home plant, no due date to the cheapest."""
    best = lambda *rows: costing.recommend_plant(breakdowns(spark, *rows)).first()["plant"]
    assert best(("CN", True, False, 7.0, 8.0, 2), ("PL", True, True, 8.0, 9.0, 1), ("DE", True, True, 9.0, 10.0, 0)) == "PL"
    assert best(("CN", True, None, 7.0, 8.0, 2), ("PL", True, None, 8.0, 9.0, 1)) == "CN"
    assert best(("PL", True, True, 9.0, 10.00, 1), ("DE", True, True, 9.0, 10.001, 0)) == "DE"
    assert best(("CN", False, True, None, None, 2), ("PL", True, False, 9.0, 9.0, 1)) == "PL"


def test_price_deviation(spark):
    """Eight times the volume scales a cost of 10 to 40, 12 is 70 % below; without costs, prices and quotes are compared."""
    chosen = spark.createDataFrame([(1, 1, 200, "DE", 7, 12.0, 14.63)], "rfq_id long, line_no int, qty int, plant string, part_id long, unit_cost double, unit_price double")
    top, volumes, refs = spark.createDataFrame([(7, 3)], "part_id long, ref_id long"), spark.createDataFrame([(7, 8.0)], "part_id long, volume double"), spark.createDataFrame([(3, 1.0)], "ref_id long, ref_volume double")
    costs = spark.createDataFrame([(3, "DE", 200, 10.0), (3, "DE", 900, 1.0), (3, "PL", 200, 5.0)], "part_id long, plant string, qty int, unit_cost double")
    quotes = spark.createDataFrame([(3, "DE", 200, 14.0)], "part_id long, plant string, qty int, unit_price double")
    r = costing.price_deviation(chosen, top, volumes, refs, costs, quotes).first()
    assert r["basis"] == "cost" and abs(r["deviation"] - (12 - 40) / 40) < 1e-12
    r = costing.price_deviation(chosen, top, volumes.withColumn("volume", F.lit(1.0)), refs, costs.where("plant = 'PL'"), quotes).first()
    assert r["basis"] == "quote" and abs(r["deviation"] - 0.63 / 14) < 1e-12
    assert costing.price_deviation(chosen, top, volumes, refs, costs.limit(0), quotes.limit(0)).first()["deviation"] is None


def test_make_plants_and_quantities(spark):
    rows = [(1, "PL", True), (1, "PL", True), (2, "PL", True), (2, "CN", True), (3, None, True), (4, "PL", False)]
    got = normalise.make_plants(spark.createDataFrame(rows, "rfq_id long, plant string, make boolean"), ["rfq_id"])
    assert {r[0]: r[1] for r in got.collect()} == {1: "PL", 2: "DE", 3: "DE", 4: None}
    asked = spark.createDataFrame([(1, [200]), (2, [500, 100, 500, 0]), (3, [9000])], "id int, quantities array<int>")
    assert {r["id"]: r["offered"] for r in costing.offer_quantities(asked).collect()} == {1: [200, 500], 2: [100, 500], 3: [9000]}


def test_overrides(spark):
    b = breakdowns(spark, ("DE", True, True, 8.0, 10.0, 0), ("PL", True, True, 9.0, 11.0, 1), ("CN", False, True, None, None, 2))
    rec = costing.recommend_plant(b)
    one = lambda margin, plant: costing.override_plants(rec, b, spark.createDataFrame([(1, margin, plant)], "rfq_id long, margin double, plant string")).first()
    assert one(None, None)["plant"] == "DE" and one(None, "auto")["plant"] == "DE" and one(None, "CN")["plant"] == "DE"
    r = one(20.0, "PL")
    assert r["plant"] == "PL" and r["overridden"] and abs(r["unit_price"] - 9 / 0.8) < 1e-12


def assessed(spark, **change):
    row = {"shape_class": "rotational", "extraction": 1.0, "top_score": 0.9, "coverage": 1.0, "deviation": 0.1, "bom_match": None, "n_blockers": 0, "n_warnings": 0} | change
    return triage.assess(spark.createDataFrame([tuple(row.values())], "shape_class string, extraction double, top_score double, coverage double, deviation double, bom_match double, n_blockers int, n_warnings int")).first()


def test_tiers(spark):
    r = assessed(spark)
    assert r["tier"] == "fast_track" and abs(r["overall"] - (0.35 + 0.25 * 0.9 + 0.4)) < 1e-12
    assert (assessed(spark, n_blockers=1)["tier"], assessed(spark, n_blockers=1)["overall"]) == ("manual", 0.0)
    assert assessed(spark, n_warnings=1)["reason"] == "warnings present"
    assert assessed(spark, top_score=None, deviation=None)["tier"] == "standard"
    bands = {None: 0.6, 0.15: 1.0, -0.3: 0.7, 0.31: 0.4}
    assert all(assessed(spark, deviation=d)["price_sanity"] == v for d, v in bands.items())
    built = assessed(spark, shape_class="assembly", bom_match=0.5)
    assert abs(built["overall"] - (0.3 + 0.2 * 0.9 + 0.15 + 0.15 + 0.1)) < 1e-12


def test_saved_minutes(spark):
    rows = [(1, "fast_track"), (2, "manual"), (2, "fast_track")]
    got = {r["rfq_id"]: (r["tier"], r["minutes"], r["saved_minutes"]) for r in triage.rollup(spark.createDataFrame(rows, "rfq_id long, tier string")).collect()}
    assert got == {1: ("fast_track", 30, 210), 2: ("manual", 240, 0)}


def test_catalog_match(spark):
    catalog = spark.createDataFrame([(1, "DIN 912-M6x20", 0.1, "DIN912|M6X20"), (2, "X-9", 2.0, "washer|6"), (3, "Q", 9.0, "6|9")], "ord long, part_number string, unit_price double, tokens string")
    items = [("din912 M6 x 20", "screw", None), ("77", "Cylinder screw M6x20", "DIN 912"), (None, "Washer for M6", None), ("69", "cap", None), ("5", "cap", None), (None, None, None)]
    got = bom.match_catalog(spark.createDataFrame(items, "part_number string, description string, standard string"), catalog)
    assert [(r["catalog_number"], r["how"]) for r in got.collect()].count((None, None)) == 2
    assert {r["part_number"]: (r["catalog_number"], r["how"]) for r in got.where("part_number is not null").collect()} == {"din912 M6 x 20": ("DIN 912-M6x20", "exact"), "77": ("DIN 912-M6x20", "normalized"), "69": ("Q", "normalized"), "5": (None, None)}


def test_calibration_blends(spark):
    """Score 0.8 blends with weight 0.64; a spare inspection is taken by its centre; the rest is suggested."""
    ops = spark.createDataFrame([(1, 10, "TURN", "CNC_TURN", None, 30.0, 4.0, 0.7), (1, 20, "INSPECT", "INSPECT", None, 0.0, 1.5, 0.7)], "part_id long, seq int, op_code string, work_center string, service_code string, setup_min double, cycle_min double, confidence double")
    rec = spark.createDataFrame([(2, 1, "TURN", "CNC_TURN", None, 30.0, 9.0), (2, 2, "STRAIGHTEN", "INSPECT", None, 5.0, 2.0), (2, 3, "CMM", "INSPECT_CMM", None, 15.0, 4.0)], "part_id long, seq int, op_code string, work_center string, service_code string, setup_min double, cycle_min double")
    volumes = spark.createDataFrame([(1, 5.0), (2, 5.0)], "part_id long, envelope_cm3 double")
    top = lambda s: spark.createDataFrame([(1, 2, s)], "part_id long, ref_part_id long, score double")
    got = {r["op_code"]: r for r in matching.calibrate(ops, top(0.8), rec, volumes).collect()}
    assert got["TURN"]["cycle_min"] == round(0.64 * 9 + 0.36 * 4, 2) and got["INSPECT"]["cycle_min"] == round(0.64 * 2 + 0.36 * 1.5, 2)
    assert got["CMM"]["suggested"] and got["CMM"]["confidence"] == 0.48 and len(got) == 3
    assert all(r["basis"] == "rule" for r in matching.calibrate(ops, top(0.55), rec, volumes).collect())


def test_prose_and_fasteners(spark):
    from tenderline.operators.routing import FASTENER

    texts = ["x" * 50 + " @ for 12,50 EUR", "x" * 50 + " @ and € 5", "x" * 50 + " @ 5 europium", "x" * 50 + " @\n- item", "x" * 50 + " @ - dash", "short @"]
    got = matching.prose_guard(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), "@", allow_lists=False).orderBy("id")
    assert [r["reason"] for r in got.collect()] == ["currency amount", "currency amount", None, "list items", None, "too short"]
    words = {"hex nuts m6": True, "iso 4762 x": True, "din912": True, "schrauben": True, "muttern": True, "pinion": False, "nutmeg": False, "bolted joint": False, "parallel keys": True}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.col("w").rlike(FASTENER).alias("hit"))
    assert {r["w"]: r["hit"] for r in rows.collect()} == words


def test_repair_and_retype(spark):
    schema = "drawing long, n int, ftype string, evidence string, nominal double, len_mm double, qty int, fit string, upper_mm double, lower_mm double, ra_um double, thread string, shape_class string"
    rows = [(1, 1, "hole", "4 x Ø6,5", None, None, 1, None, None, None, None, None, "prismatic"), (1, 2, "bore", "20 P9", 20.0, None, 1, "p9", 0.0, 0.0, None, None, "rotational"), (1, 3, "bore", "Ø30 h7", None, None, 1, "h7", None, None, None, None, "rotational"), (1, 4, "thread", "M8 × 1.25", None, None, 1, None, None, None, None, "", "rotational"), (1, 5, "pocket", "POCKET 40x25", 40.0, None, 1, None, None, None, None, None, "prismatic")]
    got = {r["n"]: r for r in drawings.retype(drawings.repair(spark.createDataFrame(rows, schema))).collect()}
    assert (got[1]["qty"], got[1]["nominal"]) == (4, 6.5)
    assert (got[2]["ftype"], got[2]["fit"], got[2]["upper_mm"]) == ("keyway", "P9", None)
    assert (got[3]["ftype"], got[3]["nominal"]) == ("outer_diameter", 30.0)
    assert (got[4]["thread"], got[4]["nominal"]) == ("M8x1.25", 8.0)
    assert (got[5]["nominal"], got[5]["len_mm"]) == (25.0, 40.0)


def test_attachments(spark):
    lines = spark.createDataFrame([(1, 1, "SH_4711.PDF"), (1, 2, "4711"), (1, 3, "see FL-2208 rev a"), (1, 4, None), (1, 5, "zz")], "rfq_id long, line_no int, drawing_ref string")
    f = spark.createDataFrame([(1, "sh-4711.pdf"), (1, "fl-2208.pdf"), (1, "x4711.png"), (2, "zz.pdf")], "rfq_id long, file string")
    got = {r["line_no"]: r["file"] for r in intake.match_attachments(lines, f).collect()}
    assert got == {1: "sh-4711.pdf", 2: None, 3: "fl-2208.pdf", 4: None, 5: None}


def test_edits(spark):
    ops = spark.createDataFrame([(r, 1, s, f"OP{s}", 1.0, 2.0, s == 20) for r in (1, 2) for s in (10, 20)], "rfq_id long, line_no int, seq int, op_code string, setup_min double, cycle_min double, suggested boolean")
    edits = [(1, 1, 1, "cycle_min", 10, 5.0), (1, 1, 2, "accept_suggested", 20, None), (1, 1, 3, "remove_op", 10, None), (1, 1, 4, "add_op", None, 7.0), (2, 1, 1, "remove_op", 10, None), (2, 1, 2, "cycle_min", 10, 1.0), (9, 1, 1, "remove_op", 10, None)]
    out, bad = reviews.apply_edits(ops, spark.createDataFrame(edits, "rfq_id long, line_no int, ordinal int, field string, seq int, new_value double"))
    got = {(r["rfq_id"], r["seq"]): (r["cycle_min"], r["basis"], r["suggested"]) for r in out.collect()}
    assert got == {(1, 20): (2.0, "rule", False), (1, 25): (7.0, "manual", False), (2, 10): (2.0, "rule", False), (2, 20): (2.0, "rule", True)}
    assert {r["rfq_id"]: r["error"] for r in bad.collect()} == {2: "no such operation", 9: "no such line"}


def test_greedy_pairs_and_texts(spark):
    g = spark.createDataFrame([(1, 1, "hole", 10.0), (1, 2, "hole", 10.4), (1, 3, "bore", None)], "drawing long, n int, ftype string, nominal double")
    p = spark.createDataFrame([(1, 1, "hole", 10.3), (1, 2, "hole", 9.7), (1, 3, "bore", None), (1, 4, "bore", 3.0)], "drawing long, n int, ftype string, nominal double")
    assert {(r["g"], r["p"]) for r in scoring.match_features(p, g).collect()} == {(2, 1), (1, 2), (3, 3)}
    pairs = [("Zinc plated, delivered", "zinc  plating with delivery", True), ("Zinc", "black oxide", False), (None, "", True), ("x", None, False)]
    got = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string").select(scoring.same_meaning(F.col("a"), F.col("b")))
    assert [r[0] for r in got.collect()] == [w for *_, w in pairs]


def test_sections_and_search(spark):
    text = "# Title\nlost\n## Heat treatment\nharden steel parts\n```\n## no heading\n```\n### Heat treatment ##\ntemper after hardening\n## Empty\n\n# End\nlost too"
    found = search.sections(spark.createDataFrame([("a.md", text)], "file string, content string"))
    assert [r["id"] for r in found.orderBy("k").collect()] == ["a.md#heat-treatment", "a.md#heat-treatment-2"]
    asked = spark.createDataFrame([(1, "how to temper"), (2, "zzzz")], "id long, text string")
    got = search.search(asked, found).collect()
    assert got[0]["id"] == "a.md#heat-treatment-2" and got[0]["rank"] == 1 and all(r["query"] == 1 for r in got)


def test_contract(spark):
    raw = spark.createDataFrame([(1, '```json\n{"k": 5}\n```'), (2, 'so: {"k": 6}.'), (3, "none"), (4, '{"k": "x"}'), (5, '{"j": 1}'), (6, "{broken}")], "id long, value string")
    good, bad = files.check_contract(raw, "k int", ["k"])
    assert {r["id"]: r["data"]["k"] for r in good.collect()} == {1: 5, 2: 6}
    assert {r["id"]: r["error"] for r in bad.collect()} == {3: "no object", 4: "not as declared", 5: "missing k", 6: "not as declared"}


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_exact_quantiles(spark, n):
    import numpy as np

    rng = np.random.default_rng(n)
    v = np.round(rng.normal(size=n), 1)
    rows = spark.createDataFrame([(None if i % 2 else "a", float(x)) for i, x in enumerate(v)] + [("b", None)], "k string, v double")
    got = {r["k"]: r for r in quantiles.exact_quantiles(rows, ["k"], {"q": ("v", 0.25), "m": ("v", 0.5)}).collect()}
    for k, own in (("a", v[::2]), (None, v[1::2])):
        if len(own):
            assert np.allclose([got[k]["q"], got[k]["m"]], np.quantile(own, [0.25, 0.5]))
    assert "b" not in got


def test_rule_grade_and_dates(spark):
    row = spark.createDataFrame([("H7/g6", None), ("h9", None), ("H7", 3)], "fit string, it_grade int").select(validation.rule_grade())
    assert [r[0] for r in row.collect()] == [6, 9, 3]
    c = cells(spark, (10, "DE", None, None, 0.0, 0.0, 5, 0, datetime.date(1996, 2, 5)), (20, "DE", None, None, 0.0, 0.0, 5, 0, datetime.date(1996, 2, 4)), (30, "DE", None, None, 0.0, 0.0, 5, 0, None))
    ops, *rest = tables(spark)
    got = {r["qty"]: r["meets_due"] for r in costing.breakdown(c, costing.cost_lines(c, ops.where("service is null"), *rest)).collect()}
    assert got == {10: True, 20: False, 30: None}


def test_catalog_rows_with_the_same_tokens_meet_texts_once(spark, monkeypatch):
    """Three hundred rows have three lists of tokens: texts meet three, and the first row by ord is found."""
    met = []
    monkeypatch.setattr(bom, "written", lambda df, name: met.append(df.count()) or df)
    rows = [(300 - k, f"C{k}", float(k), ("screw|M5x20", "M5 x 20|screw", "cover|PT-1", "x9")[k % 4]) for k in range(300)]
    catalog = spark.createDataFrame(rows, "ord int, part_number string, unit_price double, tokens string")
    items = [(None, f"Screw M5x20 no {k}", None) for k in range(50)] + [("C7", "Screw M5x20", None), (None, None, None), ("Q x9", None, "Q"), ("a", "b", "c")]
    got = {(r["part_number"], r["description"]): (r["catalog_number"], r["how"]) for r in bom.match_catalog(spark.createDataFrame(items, "part_number string, description string, standard string"), catalog).collect()}
    assert met == [3]
    assert all(got[None, f"Screw M5x20 no {k}"] == ("C297", "normalized") for k in range(50))
    assert got["C7", "Screw M5x20"] == ("C7", "exact") and got[None, None] == (None, None) and got["Q x9", None] == ("C299", "normalized") and got["a", "b"] == (None, None)


def test_breakdown_of_lines_equals_that_of_cost_lines(spark):
    """Without a row for each cost line the cells are the same: missing centres, unknown services, no weight, assemblies, lines without operations; a line's cells are made without moving it again."""
    lines = spark.createDataFrame(
        [(1, 1, 7, 20, "rotational", "M", 1.2, None, None), (1, 2, 8, 1000, "assembly", "M", 3.0, 13.0, "PL"), (2, 1, 9, 5, None, None, None, 99.0, "DE"), (2, 2, 7, 0, "rotational", "M", 1.2, None, None), (3, 1, 10, 3, "assembly", None, None, None, None)],
        "rfq_id long, line_no int, part_id long, qty int, shape_class string, material_code string, weight_kg double, parts_cost double, make_plant string",
    ).withColumn("due", F.lit("1996-02-20").cast("date"))
    steps = [("TURN", None, 30.0, 6.0, False), ("SAW", None, 5.0, 1.0, False), (None, "HT", 0.0, 0.0, False), (None, "NONE", 0.0, 0.0, False), ("GRIND", None, 9.0, 9.0, True), (None, None, 1.0, 1.0, False)]
    ops = spark.createDataFrame([(r, n, 10 * k, *s) for r, n in ((1, 1), (1, 2), (2, 1), (2, 2)) for k, s in enumerate(steps)], "rfq_id long, line_no int, seq int, centre string, service string, setup_min double, cycle_min double, suggested boolean")
    plants = spark.createDataFrame([("DE", 0.1, 0.0, 4, 0), ("PL", 0.08, 0.01, 6, 1), ("CN", 0.05, 0.02, 8, 2)], "code string, overhead_pct double, logistics_pct double, base_weeks int, ord int")
    centres = spark.createDataFrame([("TURN", "DE", 60.0), ("SAW", "DE", 40.0), ("TURN", "PL", 50.0)], "code string, plant string, rate_eur_h double")
    services = spark.createDataFrame([("HT", 2.0, 120.0)], "code string, price_eur_kg double, lot_min_eur double")
    materials = spark.createDataFrame([("M", 2.0)], "code string, price_eur_kg double")
    items = spark.createDataFrame([(8, 1, 2, "catalog", "x", 6.5, None), (8, 2, 1, "new", None, None, None), (9, 1, 1, "catalog", "y", 99.0, None)], "part_id long, item_no int, qty int, source string, matched string, unit_cost double, plant string")
    cells = costing.grid(lines, plants)
    want = costing.breakdown(cells, costing.cost_lines(cells, ops, centres, services, materials, items))
    got = costing.line_breakdown(lines, ops, plants, centres, services, materials, more=("part_id", "make_plant"))
    plain = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.select(*want.columns).collect()))
    assert plain(got) == plain(want) and len(plain(got)) == 12
    assert {r["plant"] for r in costing.recommend_plant(got, more=("part_id",)).where("part_id = 10").collect()} == {"DE"}


def test_files_are_written_by_several_tasks(spark, tmp_path):
    """Forty folders of one partition: no task writes all of them."""
    rows = spark.range(40).select(F.col("id").cast("string").alias("value"), F.col("id").alias("rfq")).coalesce(1)
    files.write_files(rows, f"file://{tmp_path}/x", ["rfq"])
    found = list((tmp_path / "x").glob("rfq=*/part-*"))
    assert len(found) == 40 and len({f.name.split("-")[1] for f in found}) > 1 and {f.read_text().strip() for f in found} == {str(k) for k in range(40)}


def test_terms_are_counted_where_their_document_is(spark):
    """Only documents are shuffled, by id: no exchange by (id, term)."""
    docs = spark.createDataFrame([("a", "one two one two"), ("b", "two")], "id string, doc string")
    for cut in (search.word_terms, search.piece_terms):
        plan = cut(docs)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
    assert {(r["id"], r["term"]): r["n"] for r in search.word_terms(docs).collect()} == {("a", "one"): 2, ("a", "two"): 2, ("a", "one two"): 2, ("a", "two one"): 1, ("b", "two"): 1}


def test_tables_that_grow_with_the_parts_are_not_broadcast(spark):
    lines, materials = spark.range(9).selectExpr("id AS rfq_id", "id % 3 AS part_id"), spark.range(1).selectExpr("'M' AS code", "2.0D AS density")
    parts = spark.range(3).selectExpr("id AS part_id", "'prismatic' AS shape_class", "'M' AS material_code", "1.0D AS main_mm", "1.0D AS length_mm", "1.0D AS width_mm", "1.0D AS height_mm")
    plan = costing.with_weight(lines, parts, materials)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [part_id" in plan and "BroadcastHashJoin [part_id" not in plan
    told = spark.range(3).selectExpr("id AS part_id", "'x' AS items")
    b = spark.range(3).selectExpr("id AS rfq_id", "id AS line_no", "id AS part_id", "1 AS qty", "'DE' AS plant", "1.0D AS unit_price", "true AS feasible", "false AS min_order_applied", "5 AS lead_weeks")
    plan = quotes.quote_lines(b, b.select("rfq_id", "line_no", "qty", "plant"), told)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [part_id" in plan and "BroadcastHashJoin" not in plan


def test_quantiles_rank_few_rows(spark, monkeypatch):
    """Only the cells that hold a wanted rank are ranked: few rows of a group, with far values, equal ones and null keys among them."""
    import numpy as np

    rng = np.random.default_rng(5)
    data = [("a", float(v)) for v in rng.normal(0, 1, 20_000)] + [("a", -1e300), ("a", 1e300)] + [(None, float(v)) for v in rng.exponential(1, 3001)] + [("c", 2.5)] * 4000 + [("d", None)] + [("e", -1.0), ("e", float("inf"))]
    rows = spark.createDataFrame(data, "k string, v double").withColumn("w", -F.col("v"))
    seen, inside = [], quantiles._inside
    monkeypatch.setattr(quantiles, "_inside", lambda *a: seen.append(inside(*a)) or seen[-1])
    got = {r["k"]: r for r in quantiles.exact_quantiles(rows, ["k"], {"q": ("v", 0.25), "m": ("v", 0.5), "n": ("w", 0.5)}).collect()}
    of = lambda k, q, s=1: np.quantile([s * v for x, v in data if x == k and v is not None], q)
    for k in ("a", None, "c"):
        assert got[k]["q"] == pytest.approx(of(k, 0.25), abs=1e-12) and got[k]["m"] == pytest.approx(of(k, 0.5), abs=1e-12) and got[k]["n"] == pytest.approx(of(k, 0.5, -1), abs=1e-12)
    assert "d" not in got and got["e"]["m"] == float("inf")
    assert seen[-1].where("k = 'a' and _c = 0").count() < 2000


def test_search_has_no_row_for_each_pair(spark):
    """The best of each query come from every partition, equal scores by file and place; pairs of a query and a section are no rows."""
    words = ["alpha beta gamma", "alpha beta", "delta alpha", "beta beta gamma", "omega"]
    files_ = [(f"f{i:03}.md", "\n".join(f"## part {k}\n{words[(i + k) % 5]}" for k in range(3))) for i in range(60)]
    found = search.sections(spark.createDataFrame(files_, "file string, content string"))
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(["alpha", "beta gamma", "omega", "zz"])], "id long, text string")
    out = search.search(asked, found, 2)
    assert "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["query"], r["rank"]): r for r in out.collect()}
    assert sorted(got) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 2)]
    # of equal sections the first by file, then by place
    assert [got[2, i]["id"] for i in (1, 2)] == ["f002.md#part-2", "f003.md#part-1"] and got[2, 1]["score"] == got[2, 2]["score"]
