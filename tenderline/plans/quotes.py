"""Queries on quotes, questions, review rounds, the backtest and scores of what models have read, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderline.operators import backtest, bom as bom_ops, costing, matching, operations, quotes, reviews, routing, scoring, triage
from tenderline.params import DEFAULT
from tenderline.plans import engineering as eng, quoting, records
from tenderline.plans.quoting import rounded
from tenderline.sources.adapters import ctes, domain, doubles
from tenderline.sources.scratch import written

LINE = costing.LINE
#: Date up to which corrections count.
AS_OF = "1998-01-01"
METRICS = ("median_abs", "within_10", "within_20", "median_signed", "mean_signed")


def quote_lines(spark: SparkSession, d: str) -> DataFrame:
    """CO-17."""
    b = quoting._kept_breakdown(spark, d)
    return quotes.quote_lines(b, quoting._recommended(b), bom_ops.unpriced(quoting._priced_bom(spark, d)))


def quote_assumptions(spark: SparkSession, d: str) -> DataFrame:
    """CO-18."""
    parts, materials = domain(spark, d, "parts"), domain(spark, d, "materials")
    about = domain(spark, d, "specs").join(parts.select("part_id", "shape_class", "material_code"), "part_id").join(materials.select(F.col("code").alias("material_code"), "mat_group"), "material_code", "left")
    open_ = bom_ops.unpriced(quoting._priced_bom(spark, d)).select("part_id", F.lit(True).alias("open"))
    b = quoting._kept_breakdown(spark, d)
    at = quoting._recommended(b).select(*LINE, "qty", "plant").join(b.select(*LINE, "qty", "plant", "min_order_applied").hint("merge"), [*LINE, "qty", "plant"]).groupBy(*LINE).agg(F.max("min_order_applied").alias("min_order"))
    lines = domain(spark, d, "items").join(about.hint("merge"), "part_id").join(open_.hint("merge"), "part_id", "left").join(at.hint("merge"), LINE, "left")
    label = F.concat(F.lit("P"), F.col("part_id").cast("string"))
    return quotes.assumptions(domain(spark, d, "overrides"), lines.withColumns({"label": label, "unpriced": F.coalesce("open", F.lit(False))}))


def customer_questions(spark: SparkSession, d: str) -> DataFrame:
    """VA-18."""
    mm = lambda f: f["nominal"].cast("int").cast("string")
    about = lambda f: F.when(f["code"] == "DFM-001", F.concat(F.lit("wall "), mm(f), F.lit(" mm"))).when(f["code"] == "DFM-002", F.concat(F.lit("hole "), mm(f), F.lit(" mm")))
    return quotes.customer_questions(eng._listed(spark, d, "nominal"), domain(spark, d, "overrides"), about)


def tier_reasons(spark: SparkSession, d: str) -> DataFrame:
    """TR-07."""
    top = quoting._similar(spark, d).where("rank = 1").select(F.col("query_id").alias("part_id"), "score")
    return quotes.reasons(eng._assessed(spark, d), eng._listed(spark, d), quotes.operation_notes(records._calibrated(spark, d), top))


def decision_history(spark: SparkSession, d: str) -> DataFrame:
    """OP-08."""
    own = F.struct("ts", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "action", "reviewer", "n_edits", "remark")
    held = domain(spark, d, "reviews").groupBy("rfq_id").agg(F.array_sort(F.collect_list(own)).alias("reviews"))
    return quotes.decision_history(held).drop("ts", "event_id")


def _edited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ops = domain(spark, d, "ops").withColumn("op_code", F.coalesce("centre", "service"))
    return reviews.apply_edits(ops, domain(spark, d, "edits"))


def edited_operations(spark: SparkSession, d: str) -> DataFrame:
    """FB-01: operations after their review round."""
    return _edited(spark, d)[0].withColumns({c: rounded(c) for c in ("setup_min", "cycle_min")})


def rejected_rounds(spark: SparkSession, d: str) -> DataFrame:
    """FB-01: rounds with an edit that cannot be done."""
    return _edited(spark, d)[1]


def line_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """FB-02."""
    b = quoting._kept_breakdown(spark, d)
    plants = costing.override_plants(quoting._recommended(b), b, domain(spark, d, "overrides"))
    x = reviews.snapshots(domain(spark, d, "ops"), b, plants, eng._assessed(spark, d))
    prices = F.array_join(F.array_sort(F.transform(F.map_entries("unit_prices"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"])))), ";")
    cycles = F.aggregate("routing", F.lit(0.0), lambda a, o: a + o["cycle_min"])
    return x.select(*LINE, F.size("routing").alias("n_ops"), rounded(cycles).alias("cycle_min"), rounded("margin").alias("margin"), "plant", prices.alias("prices"), "tier")


def _table_edits(spark: SparkSession, d: str) -> DataFrame:
    ops = domain(spark, d, "ops").select(*LINE, "seq", F.coalesce("centre", "service").alias("op_code"), F.col("centre").alias("work_center"), "setup_min", "cycle_min", "suggested", "rule_cycle_min")
    return reviews.table_edits(ops, domain(spark, d, "edit_rows"))


def edit_table(spark: SparkSession, d: str) -> DataFrame:
    """FB-04, FB-05: what reviewers changed in the tables of operations, and what each edit does to the price."""
    chosen = quoting._recommended(quoting._breakdown(spark, d)).select(*LINE, "qty", "plant")
    out = reviews.price_effects(_table_edits(spark, d), chosen, domain(spark, d, "centres"), domain(spark, d, "plants"))
    return out.select(*LINE, "seq", "field", "op_code", "work_center", "plant", "qty", *[rounded(c).alias(c) for c in ("before", "after", "ratio", "rule_ratio", "price_effect")])


def edit_table_by_centre(spark: SparkSession, d: str) -> DataFrame:
    """FB-06."""
    return reviews.edits_by_centre(_table_edits(spark, d)).withColumns({c: rounded(c) for c in ("cycle_ratio", "setup_ratio", "rule_ratio")})


def _points(spark: SparkSession, d: str) -> DataFrame:
    rules, cal = routing.rule_routing(eng._context(spark, d)), records._calibrated(spark, d)
    m = domain(spark, d, "materials").select(F.col("code").alias("material_code"), "density", "price_eur_kg")
    kilos = lambda v: F.col(v) * F.col("density") / 1000
    stock = eng._measured(spark, d).join(m, "material_code", "left").select("part_id", kilos("stock_cm3").alias("stock_kg"), kilos("finished_cm3").alias("finished_kg"), "price_eur_kg")
    built = domain(spark, d, "parts").where("shape_class = 'assembly'").select("part_id")
    pieces = quoting._priced_bom(spark, d).join(built, "part_id", "left_semi").groupBy("part_id").agg(F.sum(F.col("qty") * F.col("unit_cost")).alias("piece"))
    actuals = domain(spark, d, "part_costs").withColumnRenamed("unit_cost", "actual")
    return backtest.points(actuals, {"rules": rules, "calibrated": cal.where("not suggested"), "accepted": cal}, stock, pieces, domain(spark, d, "plants"), domain(spark, d, "shop"), domain(spark, d, "shop_services"))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    found = _points(spark, d).join(domain(spark, d, "parts").select("part_id", "family"), "part_id")
    return backtest.sliced_metrics(written(found.select("method", "family", "plant", "qty", "actual", "estimate"), "points"))


def backtest_points(spark: SparkSession, d: str) -> DataFrame:
    """EV-01."""
    return _points(spark, d).withColumns({c: rounded(c) for c in ("actual", "estimate")})


def backtest_metrics(spark: SparkSession, d: str) -> DataFrame:
    """EV-02, EV-03."""
    return _metrics(spark, d).withColumns({c: rounded(c) for c in METRICS})


def backtest_counts(spark: SparkSession, d: str) -> DataFrame:
    """EV-04."""
    top = quoting._similar(spark, d).where("rank = 1").select(F.col("query_id").alias("part_id"), "score")
    return backtest.part_counts(top, quoting.reuse_hints(spark, d), records._calibrated(spark, d), domain(spark, d, "parts").select("part_id", "family"))


def family_gains(spark: SparkSession, d: str) -> DataFrame:
    """EV-05."""
    return backtest.family_gains(_metrics(spark, d)).withColumns({c: rounded(c) for c in ("rules", "calibrated")})


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return domain(spark, d, name)


def feature_pairs(spark: SparkSession, d: str) -> DataFrame:
    """EV-06."""
    return scoring.match_features(_read(spark, d, "read_features"), _read(spark, d, "true_features"))


def drawing_scores(spark: SparkSession, d: str) -> DataFrame:
    """EV-07."""
    got, want = _read(spark, d, "read_features"), _read(spark, d, "true_features")
    return scoring.score_drawings(got, want, scoring.match_features(got, want))


def pooled_scores(spark: SparkSession, d: str) -> DataFrame:
    """EV-12: tuning and held-out drawings, as read and with sizes cut to whole mm."""
    got, want = _read(spark, d, "read_features"), _read(spark, d, "true_features")
    sets = F.when(F.col("drawing") % 3 == 0, "held out").otherwise("tuning")
    out = None
    for variant, rows in (("model", got), ("repaired", got.withColumn("nominal", F.floor("nominal").cast("double")))):
        s = scoring.score_drawings(rows, want, scoring.match_features(rows, want)).withColumns({"variant": F.lit(variant), "set": sets})
        out = s if out is None else out.unionByName(s)
    return scoring.pool_scores(out, ["set", "variant"]).withColumns({c: rounded(c) for c in ("recall", "precision", "tolerances")})


def rolling_factors(spark: SparkSession, d: str) -> DataFrame:
    """FB-08."""
    edits = operations.time_edits(domain(spark, d, "edited")).join(domain(spark, d, "items").select("rfq_id", "line_no", "part_id"), LINE).join(domain(spark, d, "reviewed"), "rfq_id")
    return operations.rolling_factors(edits, AS_OF).withColumn("factor", rounded("factor"))


def inbox(spark: SparkSession, d: str) -> DataFrame:
    """OP-04."""
    versions = matching.next_versions(domain(spark, d, "requests"), domain(spark, d, "quotes"))
    out = operations.inbox(operations.latest_runs(domain(spark, d, "calls")), domain(spark, d, "wanted"), triage.rollup(eng._assessed(spark, d)), versions)
    return out.withColumn("updated", F.date_format("updated", "yyyy-MM-dd HH:mm:ss"))


def equal_values(spark: SparkSession, d: str) -> DataFrame:
    """EV-09."""
    x = domain(spark, d, "understood").join(domain(spark, d, "wanted").toDF("rfq_id", "c", "p", "i", "t"), "rfq_id")
    return x.select("rfq_id", scoring.same_text(F.col("customer"), F.col("c")).alias("customer"), scoring.same_text(F.col("priority"), F.col("p")).alias("priority"), scoring.same_number(F.col("total"), F.col("t")).alias("total"))


def text_matches(spark: SparkSession, d: str) -> DataFrame:
    """EV-10: turns of a conversation against the turn before."""
    x = domain(spark, d, "conversations").select("conv_id", "turn", "text")
    before = x.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("want"))
    return x.join(before, ["conv_id", "turn"]).select("conv_id", "turn", scoring.same_meaning(F.col("text"), F.col("want")).alias("same"))


def reading_scores(spark: SparkSession, d: str) -> DataFrame:
    """EV-11: whole requests with their requirements."""
    heads = [domain(spark, d, t).withColumn("requirements", F.split("requirements", r"\|")) for t in ("read_requests", "sent_requests")]
    lines = [domain(spark, d, t).withColumn("quantities", F.transform(F.split("quantities", ","), lambda q: q.cast("int"))) for t in ("read_lines", "sent_lines")]
    return scoring.score_readings(*heads, *lines).withColumn("missed", F.array_join("missed", "; "))


def request_scores(spark: SparkSession, d: str) -> DataFrame:
    """EV-11."""
    items = domain(spark, d, "items").select("rfq_id", "line_no", "qty", "due")
    got = items.where("line_no < 6 or rfq_id % 3 > 0").withColumn("qty", F.when(F.col("rfq_id") % 8 == 0, F.col("qty") + 1).otherwise(F.col("qty")))
    return scoring.score_requests(domain(spark, d, "understood"), domain(spark, d, "wanted"), got, items)


def _texts(table: dict, i: int) -> str:
    return ", ".join(f"('{k}', '{t[i]}')" for k, t in table.items())


_UNPRICED = ", open_ AS (SELECT part_id, string_agg(trim(concat_ws(' ', part_number, description)), '; ' ORDER BY item_no) AS items FROM pb WHERE unit_cost IS NULL GROUP BY 1)"
_LISTED = f", ord_ AS (SELECT *, CAST(row_number() OVER (PARTITION BY rfq_id, line_no ORDER BY list_position({list(eng.validation.SEVERITIES)}, severity), list_position({list(eng.validation.REGISTRY)}, code), fid NULLS FIRST) AS INT) AS ordinal FROM lf)"


def _steps() -> str:
    """Three edits one after another: operations s1 to s3 and the first error of each."""
    out = ", s0 AS (SELECT rfq_id, line_no, seq, coalesce(centre, service) AS op_code, setup_min, cycle_min, 'rule' AS basis, suggested FROM ops)"
    for k in (1, 2, 3):
        e, s = f"(SELECT * FROM edits WHERE ordinal = {k})", f"s{k - 1}"
        hit = "e.seq = s.seq"
        out += f""", e{k} AS (SELECT e.rfq_id, e.line_no, CASE WHEN field = 'margin' THEN CASE WHEN NOT (CASE WHEN new_value > 1 THEN new_value / 100 ELSE new_value END >= 0 AND CASE WHEN new_value > 1 THEN new_value / 100 ELSE new_value END < 0.9) THEN 'margin out of range' END
                WHEN field <> 'add_op' AND s.seq IS NULL THEN 'no such operation' WHEN field IN ('cycle_min', 'setup_min') AND new_value < 0 THEN 'negative time' WHEN field = 'accept_suggested' AND NOT s.suggested THEN 'not suggested' END AS error FROM {e} e LEFT JOIN {s} s ON s.rfq_id = e.rfq_id AND s.line_no = e.line_no AND {hit}),
            s{k} AS (SELECT s.rfq_id, s.line_no, s.seq, s.op_code, CASE WHEN field = 'setup_min' AND {hit} THEN new_value ELSE s.setup_min END AS setup_min, CASE WHEN field = 'cycle_min' AND {hit} THEN new_value ELSE s.cycle_min END AS cycle_min, CASE WHEN field IN ('cycle_min', 'setup_min') AND {hit} THEN 'manual' ELSE s.basis END AS basis, CASE WHEN field = 'accept_suggested' AND {hit} THEN FALSE ELSE s.suggested END AS suggested
                FROM {s} s LEFT JOIN {e} e ON s.rfq_id = e.rfq_id AND s.line_no = e.line_no WHERE NOT coalesce(field = 'remove_op' AND {hit}, FALSE)
                UNION ALL SELECT e.rfq_id, e.line_no, CAST(coalesce(max(s.seq), 0) + {reviews.ADD_STEP} AS INT), '{reviews.ADDED}', 0.0, any_value(new_value), 'manual', FALSE FROM {e} e LEFT JOIN {s} s ON s.rfq_id = e.rfq_id AND s.line_no = e.line_no WHERE field = 'add_op' GROUP BY 1, 2)"""
    return out + """, er AS (SELECT e1.rfq_id, e1.line_no, coalesce(e1.error, e2.error, e3.error) AS error FROM e1 JOIN e2 ON e2.rfq_id = e1.rfq_id AND e2.line_no = e1.line_no JOIN e3 ON e3.rfq_id = e1.rfq_id AND e3.line_no = e1.line_no)"""


_BACKTEST = ctes("parts", "features", "specs", "materials", "bom", "recorded", "catalog", "part_numbers", "part_costs", "plants", "shop", "shop_services").replace("WITH ", "WITH RECURSIVE ", 1) + quoting.BOM_BODY + records.CALIBRATED + f""", allops AS (SELECT 'rules' AS method, part_id, work_center, service_code, setup_min, cycle_min FROM ops_ UNION ALL SELECT 'calibrated', part_id, work_center, service_code, setup_min, cycle_min FROM cal WHERE NOT suggested UNION ALL SELECT 'accepted', part_id, work_center, service_code, setup_min, cycle_min FROM cal),
    atp AS (SELECT DISTINCT part_id, plant FROM part_costs),
    ins AS (SELECT a.part_id, a.plant, method, sum(setup_min / 60 * rate_eur_h) AS lot, sum(cycle_min / 60 * rate_eur_h) AS per_piece, count(*) FILTER (rate_eur_h IS NULL) AS lacking FROM atp a JOIN allops o USING (part_id) LEFT JOIN shop r ON r.code = o.work_center AND r.plant = a.plant WHERE service_code IS NULL GROUP BY 1, 2, 3),
    kg AS (SELECT m.part_id, stock_cm3 * density / 1000 AS stock_kg, finished_cm3 * density / 1000 AS finished_kg, price_eur_kg FROM measured m LEFT JOIN materials t ON t.code = m.material_code),
    outs AS (SELECT c.part_id, c.plant, c.qty, method, sum(greatest(s.price_eur_kg * coalesce(finished_kg, 0.0), s.lot_min_eur / c.qty)) AS services FROM part_costs c JOIN allops o USING (part_id) JOIN shop_services s ON s.code = o.service_code LEFT JOIN kg USING (part_id) GROUP BY 1, 2, 3, 4),
    pcs AS (SELECT part_id, sum(qty * unit_cost) AS piece FROM pb WHERE part_id IN (SELECT part_id FROM parts WHERE shape_class = 'assembly') GROUP BY 1),
    pts AS (SELECT c.part_id, c.plant, c.qty, c.unit_cost AS actual, md.method, CASE WHEN coalesce(lacking, 0) = 0 THEN (coalesce(stock_kg * price_eur_kg * {1 + DEFAULT.scrap}, 0.0) + coalesce(piece, 0.0) + coalesce(lot, 0.0) / c.qty + coalesce(per_piece, 0.0) + coalesce(services, 0.0)) * (1 + overhead_pct + logistics_pct) END AS estimate
        FROM part_costs c CROSS JOIN (VALUES ('rules'), ('calibrated'), ('accepted')) md(method) LEFT JOIN ins i ON i.part_id = c.part_id AND i.plant = c.plant AND i.method = md.method LEFT JOIN outs o ON o.part_id = c.part_id AND o.plant = c.plant AND o.qty = c.qty AND o.method = md.method LEFT JOIN kg ON kg.part_id = c.part_id LEFT JOIN pcs ON pcs.part_id = c.part_id JOIN plants p ON p.code = c.plant)"""
_SLICED = _BACKTEST + f""", sl AS (SELECT method, actual, estimate, 'all' AS slice, 'all' AS key FROM pts UNION ALL SELECT method, actual, estimate, 'family', family FROM pts JOIN parts USING (part_id) UNION ALL SELECT method, actual, estimate, 'plant', plant FROM pts UNION ALL SELECT method, actual, estimate, 'home batch', 'DE' FROM pts WHERE plant = 'DE' AND qty = {DEFAULT.default_batch}),
    se AS (SELECT *, (estimate - actual) / nullif(actual, 0) AS e FROM sl),
    mt AS (SELECT method, slice, key, count(*) AS n, count(*) FILTER (estimate IS NULL) AS infeasible, avg((abs(e) <= 0.1)::INT) AS within_10, avg((abs(e) <= 0.2)::INT) AS within_20, avg(e) AS mean_signed, median(abs(e)) AS median_abs, median(e) AS median_signed FROM se GROUP BY 1, 2, 3)"""
#: Words and parting signs of a text; blanks only between two words. Points at the ends go.
_PARTS = "regexp_extract_all(trim(translate(lower(coalesce(CAST({0} AS VARCHAR), '')), '×ø⌀', 'x'), ' .'), '[x:/+.,;-]|[^x:/+.,;\\s-]+')"
_PLAIN = f"list_reduce(list_prepend('', {_PARTS}), lambda a, b : CASE WHEN a = '' OR contains('x:/+-.,;', right(a, 1)) OR contains('x:/+-.,;', b) THEN a || b ELSE a || ' ' || b END)"
_STEMS = "list_distinct(list_transform(list_filter(regexp_split_to_array(" + _PLAIN + ", '[^\\p{{L}}\\p{{N}}.]+'), lambda w : w <> '' AND NOT list_contains(" + str(list(scoring.STOP_WORDS)) + ", w)), lambda w : substring(w, 1, 5)))"
_NUM_EQ = "CASE WHEN {0} IS NULL OR {1} IS NULL THEN {0} IS NULL AND {1} IS NULL ELSE abs({0} - {1}) <= {2} * greatest(abs({1}), 1e-9) END"


def _paired(got: str = "read_features", k: str = "") -> str:
    """CTE fragment pairs_ (drawing, g, p) of the true features and those of `got`."""
    return f""", cand{k} AS (SELECT g.drawing, g.ftype, CASE WHEN g.nominal IS NULL AND p.nominal IS NULL THEN 0.0 ELSE round(abs(p.nominal - g.nominal), 9) END AS d, g.n AS g, p.n AS p FROM true_features g JOIN {got} p ON p.drawing = g.drawing AND p.ftype = g.ftype),
    cl_{k} AS (SELECT drawing, ftype, list({{'g': [g], 'p': [p]}} ORDER BY d, g, p) AS c FROM cand{k} WHERE d <= 0.5 GROUP BY 1, 2),
    ch_{k} AS (SELECT drawing, list_reduce(c, lambda a, b : CASE WHEN list_has_any(a.g, b.g) OR list_has_any(a.p, b.p) THEN a ELSE {{'g': list_concat(a.g, b.g), 'p': list_concat(a.p, b.p)}} END) AS m FROM cl_{k}),
    pairs_{k} AS (SELECT drawing, unnest(m.g) AS g, unnest(m.p) AS p FROM ch_{k})"""


def _scored(got: str = "read_features", k: str = "") -> str:
    """CTE fragment score_ (of score_drawings) of the features in `got`; needs pairs_ before it."""
    return f""", sx{k} AS (SELECT g.*, m.p AS p, t.band AS got, t.qty AS p_qty, t.len_mm AS p_len FROM true_features g LEFT JOIN pairs_{k} m ON m.drawing = g.drawing AND m.g = g.n LEFT JOIN {got} t ON t.drawing = m.drawing AND t.n = m.p),
        sy{k} AS (SELECT drawing, count(p) AS n_matched, count(band) AS n_tolerances, count(*) FILTER (p IS NOT NULL AND band IS NOT NULL AND ({_NUM_EQ.format('got', 'band', '0.001')})) AS n_right, count(*) FILTER (p IS NOT NULL AND band IS NULL AND got IS NOT NULL) AS n_made_up, count(*) FILTER (p IS NOT NULL AND p_qty IS NOT DISTINCT FROM qty) AS n_quantities, count(*) FILTER (p IS NOT NULL AND ({_NUM_EQ.format('p_len', 'len_mm', '0.01')})) AS n_lengths, count(*) AS n_expected FROM sx{k} GROUP BY 1),
        score_{k} AS (SELECT y.*, coalesce(r.k, 0) AS n_read FROM sy{k} y LEFT JOIN (SELECT drawing, count(*) AS k FROM {got} GROUP BY 1) r ON r.drawing = y.drawing)"""


_PAIRS = ctes("read_features", "true_features") + _paired()

#: Edits of tables: rows by number and occurrence against operations.
TABLE_EDITS = """, er AS (SELECT rfq_id, line_no, seq, nullif(upper(trim(op_code)), '') AS new_op, coalesce(nullif(upper(trim(work_center)), ''), nullif(upper(trim(op_code)), '')) AS new_centre, setup_min AS ns, cycle_min AS nc, accept, row_number() OVER (PARTITION BY rfq_id, line_no, seq ORDER BY pos) AS nth FROM edit_rows),
    op_ AS (SELECT rfq_id, line_no, CAST(seq AS BIGINT) AS seq, coalesce(centre, service) AS op_code, centre AS work_center, setup_min, cycle_min, suggested, rule_cycle_min FROM ops),
    hitr AS (SELECT o.*, ns, nc, accept, e.rfq_id IS NOT NULL AS given FROM op_ o LEFT JOIN er e ON e.rfq_id = o.rfq_id AND e.line_no = o.line_no AND e.seq = o.seq AND e.nth = 1),
    newr AS (SELECT e.* FROM er e LEFT JOIN op_ o ON e.rfq_id = o.rfq_id AND e.line_no = o.line_no AND e.seq = o.seq AND e.nth = 1 WHERE o.rfq_id IS NULL AND new_op IS NOT NULL),
    te AS (SELECT rfq_id, line_no, seq, 'cycle_min' AS field, op_code, work_center, cycle_min AS before, nc AS after, nc / nullif(cycle_min, 0) AS ratio, nc / nullif(rule_cycle_min, 0) AS rule_ratio, CASE WHEN suggested THEN 0.0 ELSE nc - cycle_min END AS dc, 0.0 AS ds FROM hitr WHERE given AND abs(nc - cycle_min) > 1e-9
        UNION ALL SELECT rfq_id, line_no, seq, 'setup_min', op_code, work_center, setup_min, ns, ns / nullif(setup_min, 0), NULL, 0.0, CASE WHEN suggested THEN 0.0 ELSE ns - setup_min END FROM hitr WHERE given AND abs(ns - setup_min) > 1e-9
        UNION ALL SELECT rfq_id, line_no, seq, 'accept_suggested', op_code, work_center, 0.0, coalesce(nc, cycle_min), NULL, NULL, coalesce(nc, cycle_min), coalesce(ns, setup_min) FROM hitr WHERE given AND suggested AND accept
        UNION ALL SELECT rfq_id, line_no, seq, 'remove_op', op_code, work_center, CASE WHEN suggested THEN 0.0 ELSE cycle_min END, 0.0, NULL, NULL, CASE WHEN suggested THEN 0.0 ELSE -cycle_min END, CASE WHEN suggested THEN 0.0 ELSE -setup_min END FROM hitr WHERE NOT given
        UNION ALL SELECT rfq_id, line_no, seq, 'add_op', new_op, new_centre, 0.0, coalesce(nc, 0.0), NULL, NULL, coalesce(nc, 0.0), coalesce(ns, 0.0) FROM newr)"""

QUERIES = {f.__name__: f for f in (edit_table, edit_table_by_centre, quote_lines, quote_assumptions, customer_questions, tier_reasons, decision_history, edited_operations, rejected_rounds, line_snapshots, backtest_points, backtest_metrics, backtest_counts, family_gains, feature_pairs, drawing_scores, pooled_scores, rolling_factors, inbox, equal_values, text_matches, request_scores, reading_scores)}
ORACLES = {
    "edit_table": ctes("edit_rows", *quoting._COST_TABLES) + quoting._COST_BODY + quoting.RECOMMENDED + TABLE_EDITS + f""", at_ AS (SELECT rfq_id, line_no, min(qty) AS qty, arg_min(plant, qty) AS plant FROM rec GROUP BY 1, 2)
        SELECT t.rfq_id, t.line_no, t.seq, field, op_code, work_center, a.plant, a.qty, round(before + 1e-7, 4) AS before, round(after + 1e-7, 4) AS after, round(ratio + 1e-7, 4) AS ratio, round(rule_ratio + 1e-7, 4) AS rule_ratio,
            round((dc + ds / a.qty) / 60 * rate_eur_h * (1 + overhead_pct + logistics_pct) / (1 - {DEFAULT.margin}) + 1e-7, 4) AS price_effect
        FROM te t LEFT JOIN at_ a ON a.rfq_id = t.rfq_id AND a.line_no = t.line_no LEFT JOIN centres w ON w.code = t.work_center AND w.plant = a.plant LEFT JOIN plants p ON p.code = a.plant""",
    "edit_table_by_centre": ctes("edit_rows", "ops") + TABLE_EDITS + """ SELECT work_center, count(*) AS n_edits, round(avg(ratio) FILTER (field = 'cycle_min') + 1e-7, 4) AS cycle_ratio, round(avg(ratio) FILTER (field = 'setup_min') + 1e-7, 4) AS setup_ratio, round(avg(rule_ratio) FILTER (field = 'cycle_min') + 1e-7, 4) AS rule_ratio,
        count(*) FILTER (field IN ('add_op', 'remove_op', 'accept_suggested')) AS op_changes FROM te GROUP BY 1""",
    "quote_lines": quoting._COST + quoting.RECOMMENDED + _UNPRICED + """, x AS (SELECT b.*, i.part_id, r.plant IS NOT NULL AS chosen FROM broken b JOIN items i ON i.rfq_id = b.rfq_id AND i.line_no = b.line_no LEFT JOIN rec r ON r.rfq_id = b.rfq_id AND r.line_no = b.line_no AND r.qty = b.qty AND r.plant = b.plant),
        y AS (SELECT rfq_id, line_no, part_id, max(plant) FILTER (chosen) AS plant, string_agg(qty || ':' || printf('%.2f', round(unit_price + 1e-7, 2)) || CASE WHEN min_order_applied THEN '*' ELSE '' END, ', ' ORDER BY qty) FILTER (chosen AND feasible) AS prices, coalesce(arg_min(lead_weeks, qty) FILTER (chosen), max(lead_weeks)) AS lead_weeks FROM x GROUP BY 1, 2, 3)
        SELECT rfq_id, line_no, coalesce(plant, '-') AS plant, coalesce(prices, '') AS prices, lead_weeks, concat_ws('; ', CASE WHEN prices IS NULL THEN 'no plant can make it' END, o.items) AS unpriced FROM y LEFT JOIN open_ o ON o.part_id = y.part_id""",
    "quote_assumptions": ctes("specs", "overrides", *quoting._COST_TABLES) + quoting._COST_BODY + quoting.RECOMMENDED + _UNPRICED + f""", mo AS (SELECT rfq_id, line_no, bool_or(min_order_applied) AS min_order FROM rec GROUP BY 1, 2),
        ln AS (SELECT i.rfq_id, i.line_no, 'P' || i.part_id AS label, p.shape_class <> 'assembly' AS made, s.*, mat_group, coalesce(min_order, FALSE) AS min_order, o.part_id IS NOT NULL AS unpriced FROM items i JOIN specs s ON s.part_id = i.part_id JOIN parts p ON p.part_id = i.part_id LEFT JOIN materials m ON m.code = p.material_code LEFT JOIN open_ o ON o.part_id = i.part_id LEFT JOIN mo ON mo.rfq_id = i.rfq_id AND mo.line_no = i.line_no),
        ks AS (SELECT rfq_id, line_no, label, unnest(list_filter([{{'k': 0, 'key': CASE WHEN NOT made THEN 'assembly' END}}, {{'k': 1, 'key': CASE WHEN made THEN CASE WHEN trim(coalesce(general_tolerance, '')) <> '' THEN 'tolerance' ELSE 'no_tolerance' END END}}, {{'k': 2, 'key': CASE WHEN made AND trim(coalesce(heat_treatment, '')) <> '' THEN 'heat' END}}, {{'k': 3, 'key': CASE WHEN made AND trim(coalesce(surface_treatment, '')) <> '' THEN 'surface' END}},
            {{'k': 4, 'key': CASE WHEN made AND mat_group IN ('aluminium', 'stainless') THEN 'indexed' END}}, {{'k': 5, 'key': CASE WHEN min_order THEN 'min_order' END}}, {{'k': 6, 'key': CASE WHEN unpriced THEN 'unpriced' END}}], lambda x : x.key IS NOT NULL)) AS x FROM ln),
        al AS (SELECT rfq_id, -1 AS line_no, coalesce(incoterm, 'FCA') AS label, 0 AS k, 'prices' AS key FROM overrides UNION ALL SELECT rfq_id, line_no, label, x.k, x.key FROM ks UNION ALL SELECT rfq_id, 1000, '', 0, 'lead' FROM overrides UNION ALL SELECT rfq_id, 1001, '', 0, 'validity' FROM overrides),
        en(key, t) AS (VALUES {_texts(quotes.ASSUMPTIONS, 0)}), de(key, t) AS (VALUES {_texts(quotes.ASSUMPTIONS, 1)})
        SELECT al.rfq_id, CAST(row_number() OVER (PARTITION BY al.rfq_id ORDER BY line_no, k) AS INT) AS ordinal, replace(CASE WHEN language = 'de' THEN de.t ELSE en.t END, '{{}}', label) AS text FROM al JOIN overrides o ON o.rfq_id = al.rfq_id JOIN en ON en.key = al.key JOIN de ON de.key = al.key""",
    "customer_questions": ctes(*eng.FOUND_TABLES, "overrides") + quoting.BOM_BODY + eng._FOUND + _LISTED + f""", en(code, t) AS (VALUES {_texts(quotes.QUESTIONS, 0)}), de(code, t) AS (VALUES {_texts(quotes.QUESTIONS, 1)}),
        q AS (SELECT o.rfq_id, o.line_no, ordinal AS k, '#' || o.line_no || coalesce(' (' || CASE o.code WHEN 'DFM-001' THEN 'wall ' || CAST(nominal AS INT) || ' mm' WHEN 'DFM-002' THEN 'hole ' || CAST(nominal AS INT) || ' mm' END || ')', '') || ': ' || CASE WHEN language = 'de' THEN coalesce(de.t, '{quotes.OTHER_QUESTION[1]}') ELSE coalesce(en.t, '{quotes.OTHER_QUESTION[0]}') END AS text
            FROM ord_ o JOIN overrides v ON v.rfq_id = o.rfq_id LEFT JOIN features f ON f.fid = o.fid LEFT JOIN en ON en.code = o.code LEFT JOIN de ON de.code = o.code WHERE severity IN ('blocker', 'warning') UNION ALL SELECT rfq_id, 1000, 0, trim(remark) FROM overrides WHERE trim(coalesce(remark, '')) <> '')
        SELECT rfq_id, CAST(row_number() OVER (PARTITION BY rfq_id ORDER BY line_no, k) AS INT) AS ordinal, text FROM q""",
    "tier_reasons": eng.ASSESSED.replace("WITH ", "WITH RECURSIVE ", 1) + records.CAL_TAIL + _LISTED + f""", nt AS (SELECT c.part_id, CASE WHEN suggested THEN 'suggested ' || op_code WHEN c.confidence < {quotes.LOW_CONFIDENCE} THEN 'unsure ' || op_code WHEN basis = 'rule' AND service_code IS NULL AND t.score >= 0.6 THEN 'rule only ' || op_code END AS note FROM cal c LEFT JOIN top t ON t.query_id = c.part_id AND t.rank = 1),
        ns AS (SELECT part_id, list(note ORDER BY note) AS l FROM nt WHERE note IS NOT NULL GROUP BY 1),
        tc AS (SELECT rfq_id, line_no, severity, code, count(*) AS k, min(ordinal) AS o FROM ord_ WHERE severity IN ('blocker', 'warning') GROUP BY 1, 2, 3, 4),
        tt_ AS (SELECT rfq_id, line_no, list(upper(severity) || ' ' || code || CASE WHEN k > 1 THEN ' x' || k ELSE '' END ORDER BY o) AS l FROM tc GROUP BY 1, 2)
        SELECT tr.rfq_id, tr.line_no, tier, array_to_string(list_concat(coalesce(a.l, []), coalesce(ns.l, []), CASE WHEN reason IS NULL THEN [] ELSE [reason] END), '; ') AS reasons FROM tr LEFT JOIN tt_ a ON a.rfq_id = tr.rfq_id AND a.line_no = tr.line_no LEFT JOIN ns ON ns.part_id = tr.part_id""",
    "decision_history": ctes("reviews") + " SELECT rfq_id, CAST(row_number() OVER (PARTITION BY rfq_id ORDER BY ts, event_id) AS INT) AS ordinal, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, action, reviewer, n_edits, remark FROM reviews",
    "edited_operations": ctes("ops", "edits") + _steps() + """ SELECT s.rfq_id, s.line_no, seq, op_code, round(setup_min + 1e-7, 4) AS setup_min, round(cycle_min + 1e-7, 4) AS cycle_min, basis, suggested FROM s3 s LEFT JOIN er ON er.rfq_id = s.rfq_id AND er.line_no = s.line_no WHERE error IS NULL
        UNION ALL SELECT s.rfq_id, s.line_no, seq, op_code, round(setup_min + 1e-7, 4), round(cycle_min + 1e-7, 4), basis, suggested FROM s0 s JOIN er ON er.rfq_id = s.rfq_id AND er.line_no = s.line_no WHERE error IS NOT NULL""",
    "rejected_rounds": ctes("ops", "edits") + _steps() + " SELECT rfq_id, line_no, error FROM er WHERE error IS NOT NULL",
    "line_snapshots": eng.assessed("overrides") + f""", w AS (SELECT rfq_id, CASE WHEN margin > 1 THEN margin / 100 ELSE margin END AS m, nullif(upper(plant), 'AUTO') AS wish FROM overrides),
        pl AS (SELECT r.rfq_id, r.line_no, coalesce(b.plant, r.plant) AS plant, CASE WHEN m >= 0 AND m < 0.9 THEN m ELSE {DEFAULT.margin} END AS margin FROM rec r LEFT JOIN w USING (rfq_id) LEFT JOIN broken b ON b.rfq_id = r.rfq_id AND b.line_no = r.line_no AND b.qty = r.qty AND b.plant = w.wish AND b.feasible),
        pr AS (SELECT rfq_id, line_no, string_agg(x, ';' ORDER BY x) AS prices FROM (SELECT rfq_id, line_no, plant || '@' || qty || '=' || printf('%.2f', round(unit_price + 1e-7, 2)) AS x FROM broken WHERE feasible) GROUP BY 1, 2),
        os AS (SELECT rfq_id, line_no, CAST(count(*) AS INT) AS n_ops, sum(cycle_min) AS c FROM ops GROUP BY 1, 2)
        SELECT os.rfq_id, os.line_no, n_ops, round(c + 1e-7, 4) AS cycle_min, round(margin + 1e-7, 4) AS margin, plant, prices, tier FROM os LEFT JOIN pr ON pr.rfq_id = os.rfq_id AND pr.line_no = os.line_no LEFT JOIN pl ON pl.rfq_id = os.rfq_id AND pl.line_no = os.line_no LEFT JOIN tr ON tr.rfq_id = os.rfq_id AND tr.line_no = os.line_no""",
    "backtest_points": _BACKTEST + " SELECT part_id, plant, qty, round(actual + 1e-7, 4) AS actual, method, round(estimate + 1e-7, 4) AS estimate FROM pts",
    "backtest_metrics": _SLICED + f" SELECT method, slice, key, n, infeasible, {', '.join(f'round({c} + 1e-7, 4) AS {c}' for c in METRICS)} FROM mt",
    "backtest_counts": ctes(*records._CAL_TABLES).replace("WITH ", "WITH RECURSIVE ", 1) + records.CALIBRATED + f""", h AS (SELECT DISTINCT t.query_id FROM top t JOIN v q ON q.part_id = t.query_id JOIN v p ON p.part_id = t.part_id WHERE rank = 1 AND score >= 0.92 AND q.material_code = p.material_code AND greatest(CASE WHEN diameter <= 0 THEN 1.0 ELSE 1 - exp(0.35 * ln(diameter)) END, CASE WHEN len4 <= 0 THEN 1.0 ELSE 1 - exp(0.35 * ln(len4)) END) < 0.05),
        sg AS (SELECT family, op_code, count(*) AS n FROM cal JOIN parts USING (part_id) WHERE suggested GROUP BY 1, 2), sl AS (SELECT family, string_agg(op_code || ':' || n, ',' ORDER BY op_code || ':' || n) AS suggested FROM sg GROUP BY 1),
        b AS (SELECT family, count(*) AS n_parts, count(*) FILTER (t.score >= 0.6) AS n_calibrated, count(h.query_id) AS n_reuse FROM parts p LEFT JOIN top t ON t.query_id = p.part_id AND t.rank = 1 LEFT JOIN h ON h.query_id = p.part_id GROUP BY 1) SELECT b.*, coalesce(suggested, '') AS suggested FROM b LEFT JOIN sl USING (family)""",
    "family_gains": _SLICED + """, fg AS (SELECT key AS family, max(median_abs) FILTER (method = 'rules') AS rules, max(median_abs) FILTER (method = 'calibrated') AS calibrated FROM mt WHERE slice = 'family' GROUP BY 1)
        SELECT family, round(rules + 1e-7, 4) AS rules, round(calibrated + 1e-7, 4) AS calibrated, rules - calibrated > 0.01 AS improved FROM fg WHERE rules IS NOT NULL AND calibrated IS NOT NULL""",
    "feature_pairs": _PAIRS + " SELECT * FROM pairs_",
    "drawing_scores": _PAIRS + _scored() + " SELECT * FROM score_",
    "pooled_scores": _PAIRS + ", cutf AS (SELECT * REPLACE (floor(nominal) AS nominal) FROM read_features)" + _paired("cutf", "2") + _scored() + _scored("cutf", "2") + """, u AS (SELECT *, 'model' AS variant FROM score_ UNION ALL SELECT *, 'repaired' FROM score_2)
        SELECT CASE WHEN drawing % 3 = 0 THEN 'held out' ELSE 'tuning' END AS set, variant, count(*) AS n_drawings, round(sum(n_matched) / nullif(sum(n_expected), 0) + 1e-7, 4) AS recall, round(sum(n_matched) / nullif(sum(n_read), 0) + 1e-7, 4) AS precision, round(sum(n_right) / nullif(sum(n_tolerances), 0) + 1e-7, 4) AS tolerances FROM u GROUP BY 1, 2""",
    "rolling_factors": ctes("edited", "items", "reviewed") + f""", x AS (SELECT e.centre, after_cycle / nullif(before_cycle, 0) AS r, part_id, reviewer FROM edited e JOIN items i ON i.rfq_id = e.rfq_id AND i.line_no = e.line_no JOIN reviewed v ON v.rfq_id = e.rfq_id WHERE NOT removed AND (abs(after_cycle - before_cycle) > 1e-9 OR abs(after_setup - before_setup) > 1e-9) AND NOT reused AND done <= DATE '{AS_OF}' AND done > DATE '{AS_OF}' - INTERVAL 6 MONTH)
        SELECT centre, count(*) AS n, count(DISTINCT part_id) AS n_parts, count(DISTINCT reviewer) AS n_engineers, round(median(r) + 1e-7, 4) AS factor FROM x WHERE r IS NOT NULL GROUP BY 1 HAVING count(*) >= 20 AND count(DISTINCT part_id) >= 5 AND count(DISTINCT reviewer) >= 2""",
    "inbox": eng.assessed("calls", "wanted", "requests", "quotes") + """, rn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rfq_id ORDER BY ts DESC, id DESC) AS k FROM calls) WHERE k = 1),
        rk AS (SELECT rfq_id, max(CASE tier WHEN 'manual' THEN 3 WHEN 'standard' THEN 2 ELSE 1 END) AS r, count(*) AS n_lines FROM tr GROUP BY 1), vs AS (SELECT r.rfq_id, 'Q-' || r.rfq_id || '-v' || coalesce(v + 1, 1) AS quote_id FROM requests r LEFT JOIN (SELECT rfq_id, max(version) AS v FROM quotes GROUP BY 1) q ON q.rfq_id = r.rfq_id)
        SELECT rn.rfq_id, customer, node, ok, ['fast_track', 'standard', 'manual'][r] AS tier, n_lines, quote_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated FROM rn LEFT JOIN wanted w ON w.rfq_id = rn.rfq_id LEFT JOIN rk ON rk.rfq_id = rn.rfq_id LEFT JOIN vs ON vs.rfq_id = rn.rfq_id""",
    "equal_values": ctes("understood", "wanted") + f" SELECT u.rfq_id, {_PLAIN.format('u.customer')} = {_PLAIN.format('w.customer')} AS customer, {_PLAIN.format('u.priority')} = {_PLAIN.format('w.priority')} AS priority, {_NUM_EQ.format('u.total', 'w.total', '0.01')} AS total FROM understood u JOIN wanted w ON w.rfq_id = u.rfq_id",
    "text_matches": f"""WITH x AS (SELECT a.conv_id, a.turn, a.text AS got, b.text AS want, {_STEMS.format('a.text')} AS gs, {_STEMS.format('b.text')} AS ws FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn)
        SELECT conv_id, turn, CASE WHEN coalesce(got, '') = '' OR coalesce(want, '') = '' THEN coalesce(got, '') = '' AND coalesce(want, '') = '' ELSE len(ws) > 0 AND len(list_intersect(ws, gs)) >= 0.6 * len(ws) END AS same FROM x""",
    "reading_scores": ctes("sent_requests", "read_requests", "sent_lines", "read_lines") + f""", hd AS (SELECT w.rfq_id, list_filter([{', '.join(f"CASE WHEN {_PLAIN.format('g.' + h)} <> {_PLAIN.format('w.' + h)} THEN '{h}' END" for h in scoring.HEADERS)}], lambda m : m IS NOT NULL) AS bad FROM sent_requests w LEFT JOIN read_requests g ON g.rfq_id = w.rfq_id),
        sl AS (SELECT *, row_number() OVER (PARTITION BY rfq_id ORDER BY line_no) AS k FROM sent_lines), rl AS (SELECT *, row_number() OVER (PARTITION BY rfq_id ORDER BY line_no) AS k FROM read_lines),
        lp AS (SELECT s.rfq_id, s.k, s.line_no, r.rfq_id IS NOT NULL AS paired, list_filter([CASE WHEN r.quantities IS DISTINCT FROM s.quantities THEN 'quantities' END, CASE WHEN r.due IS DISTINCT FROM s.due THEN 'due' END, CASE WHEN r.drawing_ref IS DISTINCT FROM s.drawing_ref THEN 'drawing_ref' END, CASE WHEN {_PLAIN.format('r.part_number')} <> {_PLAIN.format('s.part_number')} THEN 'part_number' END], lambda m : m IS NOT NULL) AS bad FROM sl s LEFT JOIN rl r ON r.rfq_id = s.rfq_id AND r.k = s.k),
        la AS (SELECT rfq_id, count(*) AS n, count(*) FILTER (paired) AS paired, sum(len(bad)) FILTER (paired) AS wrong, flatten(list(list_transform(bad, lambda f : 'line ' || line_no || ' ' || f) ORDER BY k) FILTER (paired)) AS m FROM lp GROUP BY 1), ra AS (SELECT rfq_id, count(*) AS n FROM read_lines GROUP BY 1),
        wt0 AS (SELECT rfq_id, unnest(string_split(requirements, '|')) AS text, generate_subscripts(string_split(requirements, '|'), 1) AS o FROM sent_requests), gt0 AS (SELECT rfq_id, unnest(string_split(requirements, '|')) AS text, generate_subscripts(string_split(requirements, '|'), 1) AS o FROM read_requests),
        wt AS (SELECT *, {_STEMS.format('text')} AS s FROM wt0), gt AS (SELECT *, {_STEMS.format('text')} AS s FROM gt0),
        al AS (SELECT w.rfq_id, w.o AS wo, g.o AS go FROM wt w JOIN gt g ON g.rfq_id = w.rfq_id WHERE len(w.s) > 0 AND len(list_intersect(w.s, g.s)) >= 0.6 * len(w.s)),
        wa AS (SELECT rfq_id, count(*) AS n, count(*) FILTER (hit) AS hits, list('-' || text ORDER BY o) FILTER (NOT hit) AS m FROM (SELECT *, (rfq_id, o) IN (SELECT (rfq_id, wo) FROM al) AS hit FROM wt) GROUP BY 1), ga AS (SELECT rfq_id, count(*) AS n, count(*) FILTER (hit) AS hits, list('+' || text ORDER BY o) FILTER (NOT hit) AS m FROM (SELECT *, (rfq_id, o) IN (SELECT (rfq_id, go) FROM al) AS hit FROM gt) GROUP BY 1)
        SELECT h.rfq_id, CAST(7 - len(bad) AS INT) AS header_right, coalesce(la.n, 0) = coalesce(ra.n, 0) AS same_count, CAST(coalesce(la.paired, 0) * 4 - coalesce(la.wrong, 0) AS BIGINT) AS line_right, CAST(coalesce(la.paired, 0) * 4 AS BIGINT) AS line_fields, CAST(coalesce(wa.hits, 0) AS INT) AS found, CAST(coalesce(wa.n, 0) AS INT) AS required, CAST(coalesce(ga.hits, 0) AS INT) AS confirmed, CAST(coalesce(ga.n, 0) AS INT) AS "read",
            array_to_string(list_concat(bad, coalesce(la.m, []), coalesce(wa.m, []), coalesce(ga.m, [])), '; ') AS missed FROM hd h LEFT JOIN la ON la.rfq_id = h.rfq_id LEFT JOIN ra ON ra.rfq_id = h.rfq_id LEFT JOIN wa ON wa.rfq_id = h.rfq_id LEFT JOIN ga ON ga.rfq_id = h.rfq_id""",
    "request_scores": ctes("understood", "wanted", "items") + f""", got AS (SELECT rfq_id, line_no, CASE WHEN rfq_id % 8 = 0 THEN qty + 1 ELSE qty END AS qty, due FROM items WHERE line_no < 6 OR rfq_id % 3 > 0),
        a AS (SELECT *, row_number() OVER (PARTITION BY rfq_id ORDER BY line_no) AS k FROM items), b AS (SELECT *, row_number() OVER (PARTITION BY rfq_id ORDER BY line_no) AS k FROM got),
        c AS (SELECT a.rfq_id, count(*) AS na, count(b.k) AS nb, count(*) FILTER (b.k IS NOT NULL AND a.qty IS NOT DISTINCT FROM b.qty) + count(*) FILTER (b.k IS NOT NULL AND a.due IS NOT DISTINCT FROM b.due) AS ok FROM a LEFT JOIN b ON b.rfq_id = a.rfq_id AND b.k = a.k GROUP BY 1)
        SELECT w.rfq_id, CAST(({_PLAIN.format('u.customer')} = {_PLAIN.format('w.customer')})::INT + ({_PLAIN.format('u.priority')} = {_PLAIN.format('w.priority')})::INT + (u.issued IS NOT DISTINCT FROM w.issued)::INT + ({_NUM_EQ.format('u.total', 'w.total', '0.01')})::INT AS INT) AS header_right,
            CAST(coalesce((na = nb)::INT, 1) AS INT) AS same_count, CAST(coalesce(ok, 0) AS INT) AS item_right, CAST(coalesce(2 * nb, 0) AS INT) AS item_fields FROM wanted w JOIN understood u ON u.rfq_id = w.rfq_id LEFT JOIN c ON c.rfq_id = w.rfq_id""",
}
ORACLES = {k: doubles(v) if k not in ("quote_assumptions", "customer_questions") else v for k, v in ORACLES.items()}
