"""Queries on pricing and similarity, over the domain tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderline.operators import bom as bom_ops, costing, geometry, normalise, similarity
from tenderline.params import DEFAULT
from tenderline.sources import scratch
from tenderline.sources.adapters import ctes, domain, doubles

PLANTS = ["DE", "PL", "CN"]
TODAY = "1996-01-01"


def rounded(c):
    """Four places; ties, which engines see differently in binary, go up."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-7, 4)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    lines = costing.with_weight(domain(spark, d, "items"), domain(spark, d, "parts"), domain(spark, d, "materials"))
    return costing.grid(lines, domain(spark, d, "plants"))


def _priced_bom(spark: SparkSession, d: str, built: bool = False) -> DataFrame:
    """Priced parts lists; built: those of assemblies only."""
    bom = domain(spark, d, "bom")
    if built:
        bom = bom.join(domain(spark, d, "parts").where("shape_class = 'assembly'").select("part_id").hint("merge"), "part_id", "left_semi")
    return bom_ops.price_bom(bom, domain(spark, d, "catalog"), domain(spark, d, "part_numbers"), bom_ops.internal_costs(domain(spark, d, "part_costs"), DEFAULT.default_batch))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return costing.cost_lines(_cells(spark, d), domain(spark, d, "ops"), domain(spark, d, "centres"), domain(spark, d, "services"), domain(spark, d, "materials"), _priced_bom(spark, d, built=True))


def _breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Breakdowns of all cells with part_id and, of assemblies, the plant their made parts come from. What a part adds is joined to the lines once."""
    bom = _priced_bom(spark, d, built=True)
    made = bom.select("part_id", (F.col("source") != "catalog").alias("make"), F.when(F.col("unit_cost").isNotNull(), F.col("plant")).alias("plant"), F.coalesce(F.col("qty") * F.col("unit_cost"), F.lit(0.0)).alias("amount"))
    own = normalise.make_plants(made, ["part_id"], DEFAULT.home_plant, F.sum("amount").alias("parts_cost"))
    lines = costing.with_weight(domain(spark, d, "items"), domain(spark, d, "parts").join(own.hint("merge"), "part_id", "left"), domain(spark, d, "materials"), "parts_cost", "make_plant")
    return costing.line_breakdown(lines, domain(spark, d, "ops"), *(domain(spark, d, t) for t in ("plants", "centres", "services", "materials")), today=TODAY, more=("part_id", "make_plant"))


def _kept_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """_breakdown() written once, for queries that read it several times."""
    return scratch.once(spark, d, "breakdown", lambda: _breakdown(spark, d))


def cost_lines(spark: SparkSession, d: str) -> DataFrame:
    """CO-01 to CO-05, CO-16: material, machining, outsourced and parts-list lines of each line, plant and quantity."""
    return costing.cost_detail(_lines(spark, d).withColumn("amount", F.col("amount") + 1e-7))


def cost_sources(spark: SparkSession, d: str) -> DataFrame:
    """CO-05, CO-10: where the amount of each cost line comes from, and how machining and parts are reckoned."""
    x = _lines(spark, d)
    return x.select(*costing.CELL, "category", "ordinal", "source", F.when(F.col("category").isin("machining", "purchased", "internal_parts"), F.col("formula")).alias("formula"))


def cost_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """CO-06 to CO-09: feasibility, unit cost, price, order floor, lead time."""
    r = lambda c: rounded(c).alias(c)
    return _breakdown(spark, d).select(*costing.CELL, "feasible", "reason", r("unit_cost"), r("unit_price"), r("total"), "min_order_applied", "lead_weeks", "meets_due")


def _recommended(breakdowns: DataFrame, *more: str) -> DataFrame:
    """The plant of each line and quantity; of assemblies, the one its made parts come from goes first."""
    return costing.recommend_plant(breakdowns, more=more)


def recommended_plant(spark: SparkSession, d: str) -> DataFrame:
    """CO-11, CO-12: the plant to quote for each line."""
    return _recommended(_breakdown(spark, d)).drop("unit_cost").withColumn("unit_price", rounded("unit_price"))


def _deviations(spark: SparkSession, d: str) -> DataFrame:
    """Recommended lines with their deviation from the most similar part, and that part's score."""
    items = domain(spark, d, "items").select(*costing.LINE, "part_id")
    top = _similar(spark, d).where("rank = 1").select(F.col("query_id").alias("part_id"), F.col("part_id").alias("ref_id"), F.col("score").alias("top_score"))
    parts = domain(spark, d, "parts")
    volumes = geometry.measure(parts, domain(spark, d, "features")).select("part_id", F.col("envelope_cm3").alias("volume"))
    chosen = _recommended(_breakdown(spark, d), "part_id")
    found = costing.price_deviation(chosen, top, volumes, costing.reference_volumes(parts), domain(spark, d, "part_costs"), domain(spark, d, "history"))
    return items.join(top.drop("ref_id"), "part_id", "left").join(found.select(*costing.LINE, "qty", "plant", "deviation", "basis"), costing.LINE, "left")


def price_deviations(spark: SparkSession, d: str) -> DataFrame:
    """CO-13."""
    return _deviations(spark, d).select(*costing.LINE, "plant", rounded("deviation").alias("deviation"), "basis")


def overridden_plants(spark: SparkSession, d: str) -> DataFrame:
    """CO-19: plant and margin as the request sets them."""
    b = _kept_breakdown(spark, d)
    out = costing.override_plants(_recommended(b), b, domain(spark, d, "overrides"))
    return out.withColumns({c: rounded(c) for c in ("margin", "unit_price")})


def bom_prices(spark: SparkSession, d: str) -> DataFrame:
    """NR-03, BM-02, BM-03."""
    return _priced_bom(spark, d).select("part_id", "item_no", "qty", "source", "method", "matched", "plant", "confidence", rounded("unit_cost").alias("unit_cost"))


def catalog_matches(spark: SparkSession, d: str) -> DataFrame:
    """NR-03 alone."""
    return bom_ops.match_catalog(domain(spark, d, "bom"), domain(spark, d, "catalog")).select("part_id", "item_no", "catalog_number", "how")


def unpriced_items(spark: SparkSession, d: str) -> DataFrame:
    """BM-04."""
    return bom_ops.unpriced(_priced_bom(spark, d))


def priced_shares(spark: SparkSession, d: str) -> DataFrame:
    """TR-05."""
    return bom_ops.priced_share(_priced_bom(spark, d)).withColumn("bom_match", rounded("bom_match"))


def new_items(spark: SparkSession, d: str) -> DataFrame:
    """VA-07."""
    return bom_ops.new_items(_priced_bom(spark, d))


def reuse_hints(spark: SparkSession, d: str) -> DataFrame:
    """VA-16."""
    return similarity.reuse_hints(_similar(spark, d), _vectors(spark, d)).withColumn("largest_difference", rounded("largest_difference"))


def price_matrix(spark: SparkSession, d: str) -> DataFrame:
    """CO-15: labelled prices to the cent by plant, feasible or not."""
    m = costing.price_matrix(_breakdown(spark, d).withColumn("unit_price", F.round(F.col("unit_price") + 1e-7, 2)), PLANTS)
    return m.select(*costing.LINE, "qty", *[F.col(p).alias(p.lower()) for p in PLANTS])


def routing_view(spark: SparkSession, d: str) -> DataFrame:
    """CO-20."""
    return costing.routing_view(domain(spark, d, "ops")).withColumnRenamed("where_", "place")


def offered_quantities(spark: SparkSession, d: str) -> DataFrame:
    """CO-14: quantities of a part's lines in one request, with the next tier if there is one only; null without a positive one."""
    asked = domain(spark, d, "items").groupBy("rfq_id").agg(F.collect_list("qty").alias("quantities"))
    return costing.offer_quantities(asked).select("rfq_id", *[F.nullif(F.array_join(c, ","), F.lit("")).alias(c) for c in ("asked", "offered")])


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return similarity.drawing_vectors(_nested(spark, d), domain(spark, d, "materials"))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    return similarity.nested_drawings(domain(spark, d, "parts"), domain(spark, d, "features"), domain(spark, d, "specs"))


def _similar(spark: SparkSession, d: str) -> DataFrame:
    def build() -> DataFrame:
        v = scratch.written(_vectors(spark, d), "vectors-of-drawings")  # read as queries, as parts and for their keys
        return similarity.find_similar(v, v, ["part_id"], exclude_self=True)

    return scratch.once(spark, d, "similar", build)


def feature_vectors(spark: SparkSession, d: str) -> DataFrame:
    """GE-08."""
    return _vectors(spark, d)


def vector_parity(spark: SparkSession, d: str) -> DataFrame:
    """GE-09: fields in which a drawing's vector differs from that of its row among the parts; 0 for each."""
    drawings, materials = _nested(spark, d), domain(spark, d, "materials")
    return similarity.differing_fields(similarity.drawing_vectors(drawings, materials), similarity.part_vectors(similarity.part_columns(drawings), materials))


def similar_parts(spark: SparkSession, d: str) -> DataFrame:
    """SI-01 to SI-03, SI-06: the three most similar other parts of each part."""
    return _similar(spark, d).select("query_id", "part_id", "rank", "score", F.col("score_breakdown")["diameter"].alias("diameter"), F.col("score_breakdown")["precision"].alias("precision"))


def reference_costs(spark: SparkSession, d: str) -> DataFrame:
    """SI-04, SI-05: the recorded cost of the most similar part at the quantity nearest to 20 (requested_reference_costs has all parts and SI-07)."""
    q = _similar(spark, d).where("rank = 1").withColumn("want", F.lit(20))
    out = similarity.reference_costs(q, domain(spark, d, "part_costs"), domain(spark, d, "history"), ["query_id"], "want")
    return out.select("query_id", "part_id", rounded("ref_unit_cost").alias("ref_unit_cost"), "ref_qty")


def requested_reference_costs(spark: SparkSession, d: str) -> DataFrame:
    """SI-04, SI-05, SI-07: the recorded cost of each similar part at the quantity nearest to the smallest one requested of the part, else to 200."""
    asked = domain(spark, d, "items").where("qty > 0").groupBy(F.col("part_id").alias("query_id")).agg(F.min("qty").alias("asked"))
    q = _similar(spark, d).join(asked, "query_id", "left").withColumn("want", F.coalesce("asked", F.lit(200)))
    out = similarity.reference_costs(q, domain(spark, d, "part_costs"), domain(spark, d, "history"), ["query_id"], "want")
    return out.select("query_id", "part_id", "rank", "want", rounded("ref_unit_cost").alias("ref_unit_cost"), "ref_qty")


_VOLUME = "CASE WHEN shape_class = 'rotational' THEN pi() / 4 * main_mm * main_mm * length_mm ELSE length_mm * width_mm * height_mm END / 1000"

_COST_TABLES = ("items", "parts", "plants", "centres", "services", "materials", "ops", "bom", "catalog", "part_numbers", "part_costs")


def norm_sql(text: str) -> str:
    return f"translate(regexp_replace(translate(upper({text}), '×*', 'XX'), '([0-9])\\s*X\\s*([0-9])', '\\1X\\2', 'g'), ' -.+/', '')"


BOM_BODY = f""", bn AS (SELECT *, {norm_sql('part_number')} AS n, {norm_sql("concat_ws(' ', part_number, description, standard)")} AS t FROM bom),
    cn AS (SELECT *, {norm_sql('part_number')} AS n, list_transform(string_split(tokens, '|'), lambda x : {norm_sql('x')}) AS ts FROM catalog),
    cex AS (SELECT n, arg_min(part_number, ord) AS num, arg_min(unit_price, ord) AS price FROM cn GROUP BY 1),
    clo AS (SELECT x.t, arg_min(c.part_number, ord) AS num, arg_min(c.unit_price, ord) AS price FROM (SELECT DISTINCT t FROM bn WHERE n IS NULL OR n NOT IN (SELECT n FROM cex)) x JOIN cn c ON len(list_filter(ts, lambda k : NOT contains(x.t, k))) = 0 GROUP BY 1),
    ic AS (SELECT part_id, unit_cost, away, plant FROM (SELECT *, plant <> 'DE' AS away, row_number() OVER (PARTITION BY part_id ORDER BY (plant <> 'DE')::INT, abs(qty - {DEFAULT.default_batch}), unit_cost, plant) AS k FROM part_costs) WHERE k = 1),
    own AS (SELECT p.part_number AS num, unit_cost, away, plant FROM part_numbers p LEFT JOIN ic USING (part_id)),
    bx AS (SELECT b.*, e.num AS e_num, e.price AS e_price, l.num AS l_num, l.price AS l_price, o.num AS o_num, o.unit_cost AS o_cost, o.away AS o_away, o.plant AS o_plant, e.num IS NOT NULL OR (l.num IS NOT NULL AND o.num IS NULL) AS bought FROM bn b LEFT JOIN cex e ON e.n = b.n LEFT JOIN clo l ON l.t = b.t AND e.num IS NULL LEFT JOIN own o ON o.num = b.part_number),
    pb AS (SELECT part_id, item_no, qty, part_number, description, standard, CASE WHEN bought THEN 'catalog' WHEN o_num IS NOT NULL THEN 'internal' ELSE 'new' END AS source,
        CASE WHEN e_num IS NOT NULL THEN 'exact' WHEN bought THEN 'normalized' WHEN o_num IS NULL THEN 'new' WHEN o_cost IS NULL THEN 'internal_unpriced' WHEN o_away THEN 'internal_other' ELSE 'internal' END AS method,
        CASE WHEN bought THEN coalesce(e_num, l_num) ELSE o_num END AS matched, CASE WHEN bought THEN CASE WHEN e_num IS NOT NULL THEN e_price ELSE l_price END ELSE o_cost END AS unit_cost, CASE WHEN NOT bought THEN o_plant END AS plant FROM bx)"""
_NUM = "regexp_replace(printf('%.6f', {0}), '\\.?0+$', '')"
_COST_BODY = (
    BOM_BODY
    + f""", lines AS (SELECT i.*, p.shape_class, p.material_code, ({_VOLUME}) * m.density / 1000 AS weight_kg, m.price_eur_kg AS kg_price
        FROM items i LEFT JOIN parts p USING (part_id) LEFT JOIN materials m ON p.material_code = m.code),
    cells AS (SELECT l.*, p.code AS plant, overhead_pct, logistics_pct, base_weeks, ord FROM lines l CROSS JOIN plants p WHERE qty > 0),
    amounts AS (
        SELECT rfq_id, line_no, plant, qty, 'material' AS category, 0 AS ordinal, coalesce(weight_kg * kg_price * {1 + DEFAULT.scrap}, 0.0) AS amount, NULL AS centre, 'materials:' || material_code AS source, NULL AS formula FROM cells WHERE shape_class <> 'assembly' OR shape_class IS NULL
        UNION ALL SELECT c.rfq_id, c.line_no, c.plant, c.qty, CASE WHEN source = 'catalog' THEN 'purchased' ELSE 'internal_parts' END, item_no, coalesce(b.qty * b.unit_cost, 0.0), NULL,
            CASE WHEN b.unit_cost IS NULL THEN 'bom:' || source WHEN source = 'catalog' THEN 'catalog:' || matched ELSE 'parts:' || matched || coalesce('@' || b.plant, '') END, b.qty || CASE WHEN b.unit_cost IS NULL THEN ' unpriced' ELSE '*' || regexp_replace(printf('%.2f', round(b.unit_cost + 1e-7, 2)), '\\.?0+$', '') END
            FROM cells c JOIN pb b USING (part_id) WHERE shape_class = 'assembly'
        UNION ALL SELECT c.rfq_id, c.line_no, c.plant, qty, 'machining', seq, (setup_min / qty + cycle_min) / 60 * rate_eur_h, o.centre, 'work_centers:' || o.centre || ':' || c.plant, '(' || {_NUM.format('setup_min')} || '/' || qty || '+' || {_NUM.format('cycle_min')} || ')/60*' || {_NUM.format('rate_eur_h')}
            FROM cells c JOIN ops o USING (rfq_id, line_no) LEFT JOIN centres w ON w.code = o.centre AND w.plant = c.plant WHERE o.centre IS NOT NULL AND NOT suggested
        UNION ALL SELECT c.rfq_id, c.line_no, c.plant, qty, 'outsourced', seq, CASE WHEN s.code IS NULL OR weight_kg IS NULL THEN coalesce(lot_min_eur / qty, 0.0) ELSE greatest(s.price_eur_kg * weight_kg, lot_min_eur / qty) END, NULL, 'outsourced_services:' || o.service, NULL
            FROM cells c JOIN ops o USING (rfq_id, line_no) LEFT JOIN services s ON s.code = o.service WHERE o.service IS NOT NULL AND NOT suggested),
    sums AS (SELECT rfq_id, line_no, plant, qty, sum(amount) AS subtotal, max(CASE WHEN category = 'outsourced' THEN 1 ELSE 0 END) AS o,
            count(*) FILTER (WHERE category = 'machining' AND amount IS NULL) AS n_lacking,
            min(centre) FILTER (WHERE category = 'machining' AND amount IS NULL) AS lacking FROM amounts GROUP BY 1, 2, 3, 4),
    priced AS (SELECT c.rfq_id, c.line_no, c.plant, c.qty, ord, due, coalesce(n_lacking, 0) = 0 AS feasible, lacking,
            coalesce(subtotal, 0.0) * (1 + overhead_pct + logistics_pct) AS cost, CAST(base_weeks + coalesce(o, 0) AS INT) AS lead_weeks
            FROM cells c LEFT JOIN sums USING (rfq_id, line_no, plant, qty)),
    broken AS (SELECT rfq_id, line_no, plant, qty, ord, feasible, CASE WHEN NOT feasible THEN 'no ' || lacking || ' at ' || plant END AS reason,
            CASE WHEN feasible THEN cost END AS unit_cost, CASE WHEN feasible THEN cost / (1 - {DEFAULT.margin}) END AS unit_price,
            CASE WHEN feasible THEN greatest(cost / (1 - {DEFAULT.margin}) * qty, {DEFAULT.min_order_eur}) END AS total,
            CASE WHEN feasible THEN cost / (1 - {DEFAULT.margin}) * qty < {DEFAULT.min_order_eur} END AS min_order_applied, lead_weeks,
            DATE '{TODAY}' + CAST(7 * lead_weeks AS INT) <= due AS meets_due FROM priced)"""
)

_COST = ctes(*_COST_TABLES) + _COST_BODY

def tolerance_values() -> str:
    return ", ".join(f"({a}, {b}, {g}, {um})" for a, b, g, um in geometry.tolerance_rows())


_STEPS = [1, *geometry.SIZE_RANGES]
MEAN = "CASE " + " ".join(f"WHEN nominal <= {b} THEN sqrt({a}.0 * {b}.0)" for a, b in zip(_STEPS, _STEPS[1:])) + " ELSE 500.0 END"
GUESS = "CASE " + " ".join(f"WHEN abs(band) * 1000 <= {k} * unit * 1.05 THEN {g}" for g, k in geometry.IT_FACTORS.items()) + " ELSE 16 END"
#: Vectors of drawings from their features.
VECTORS = f""", vg AS (SELECT *, 0.45 * pow({MEAN}, 1.0 / 3) + 0.001 * {MEAN} AS unit FROM features),
    vh AS (SELECT *, coalesce(it_grade, CAST(nullif(regexp_extract(trim(fit), '(\\d{{1,2}})$', 1), '') AS INT), CASE WHEN nominal <> 0 AND band IS NOT NULL THEN {GUESS} END) AS g FROM vg),
    vf AS (SELECT part_id, max(nullif(nominal, 0)) FILTER (ftype = 'outer_diameter') AS max_od, CAST(coalesce(sum(qty) FILTER (ftype = 'hole'), 0) AS INT) AS n_holes, CAST(coalesce(sum(qty) FILTER (ftype = 'thread'), 0) AS INT) AS n_threads,
        count(*) FILTER (ftype = 'keyway' AND qty > 0) > 0 AS has_keyway, count(*) FILTER (ftype = 'gear' AND qty > 0) > 0 AS has_gear, min(g) AS min_it, min(ra_um) AS min_ra FROM vh GROUP BY 1),
    v AS (SELECT p.part_id, shape_class, round(CASE shape_class WHEN 'rotational' THEN coalesce(nullif(main_mm, 0), max_od, 0.0) WHEN 'prismatic' THEN greatest(width_mm, height_mm) ELSE coalesce(nullif(main_mm, 0), max_od, greatest(width_mm, height_mm)) END, 3) AS main_mm,
        round(length_mm, 3) AS length_mm, material_code, mat_group, coalesce(f.n_holes, 0) AS n_holes, coalesce(f.n_threads, 0) AS n_threads, coalesce(f.has_keyway, FALSE) AS has_keyway, coalesce(f.has_gear, FALSE) AS has_gear,
        coalesce(trim(heat_treatment) <> '', FALSE) AS has_heat, coalesce(trim(surface_treatment) <> '', FALSE) AS has_surface, f.min_it, f.min_ra
        FROM parts p LEFT JOIN materials m ON p.material_code = m.code LEFT JOIN specs USING (part_id) LEFT JOIN vf f ON f.part_id = p.part_id)"""
_SIM_BODY = VECTORS + (
    """, pairs AS (SELECT q.part_id AS query_id, p.part_id, CASE WHEN q.main_mm > 0 AND p.main_mm > 0 THEN exp(-abs(ln(q.main_mm / p.main_mm)) / 0.35) ELSE 0.5 END AS d,
            CASE WHEN q.length_mm > 0 AND p.length_mm > 0 THEN exp(-abs(ln(q.length_mm / p.length_mm)) / 0.35) ELSE 0.5 END AS l,
            CASE WHEN q.material_code IS NOT DISTINCT FROM p.material_code THEN 1.0 WHEN q.mat_group = p.mat_group THEN 0.7 ELSE 0.3 END AS m,
            1 - abs(q.n_holes - p.n_holes) / greatest(q.n_holes, p.n_holes, 1) AS h, 1 - abs(q.n_threads - p.n_threads) / greatest(q.n_threads, p.n_threads, 1) AS t,
            0.25 * ((q.has_keyway = p.has_keyway)::INT + (q.has_gear = p.has_gear)::INT + (q.has_heat = p.has_heat)::INT + (q.has_surface = p.has_surface)::INT) AS f,
            exp(-abs(coalesce(q.min_it, 12) - coalesce(p.min_it, 12)) / 2.0) AS i, CASE WHEN q.shape_class = p.shape_class THEN 1.0 ELSE 0.3 END AS shape
            FROM v q JOIN v p ON q.part_id <> p.part_id),
    scored AS (SELECT query_id, part_id, round((0.2 * d + 0.15 * l + 0.15 * m + 0.1 * h + 0.1 * t + 0.15 * f + 0.15 * i) * shape, 4) AS score, round(d, 4) AS diameter, round(l, 4) AS len4, round(i, 4) AS "precision" FROM pairs),
    top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, part_id) AS INT) AS rank FROM scored WHERE score >= 0.5) WHERE rank <= 3)"""
)
_SIM = ctes("parts", "materials", "features", "specs") + _SIM_BODY
RECOMMENDED = """, home_ AS (SELECT part_id, CASE WHEN count(plant) FILTER (unit_cost IS NOT NULL) = count(*) AND count(DISTINCT plant) = 1 THEN min(plant) ELSE 'DE' END AS make_plant
        FROM pb JOIN parts USING (part_id) WHERE shape_class = 'assembly' AND source <> 'catalog' GROUP BY 1),
    rec AS (SELECT * FROM (
        SELECT b.*, count(*) OVER (PARTITION BY b.rfq_id, b.line_no, b.qty) AS n_feasible, row_number() OVER (PARTITION BY b.rfq_id, b.line_no, b.qty
            ORDER BY CASE WHEN b.plant = make_plant THEN 0 ELSE 1 END, CASE WHEN coalesce(meets_due, TRUE) THEN 0 ELSE 1 END, round(unit_price + 1e-7, 2), CASE WHEN b.plant = 'DE' THEN 0 ELSE 1 END, ord) AS k FROM broken b JOIN (SELECT rfq_id, line_no, part_id FROM items) i USING (rfq_id, line_no) LEFT JOIN home_ h ON h.part_id = i.part_id WHERE feasible) WHERE k = 1)"""
#: Needs the fragments of cost, similar parts and measured parts before it.
DEVIATION = RECOMMENDED + """, refv AS (SELECT part_id AS ref_id, CASE WHEN main_mm <> 0 AND length_mm <> 0 THEN pi() / 4 * main_mm * main_mm * length_mm / 1000 WHEN length_mm <> 0 AND width_mm <> 0 AND height_mm <> 0 THEN length_mm * width_mm * height_mm / 1000 END AS ref_volume FROM parts),
    ch AS (SELECT r.*, t.part_id AS ref_id, m.envelope_cm3 AS volume, ref_volume FROM rec r JOIN items i ON i.rfq_id = r.rfq_id AND i.line_no = r.line_no LEFT JOIN top t ON t.query_id = i.part_id AND t.rank = 1 LEFT JOIN measured m ON m.part_id = i.part_id LEFT JOIN refv ON refv.ref_id = t.part_id),
    asked_ref AS (SELECT DISTINCT ref_id, plant, qty FROM ch WHERE ref_id IS NOT NULL),
    near_c AS (SELECT * FROM (SELECT a.*, k.unit_cost AS v, row_number() OVER (PARTITION BY a.ref_id, a.plant, a.qty ORDER BY abs(k.qty - a.qty), k.unit_cost) AS n FROM asked_ref a JOIN part_costs k ON k.part_id = a.ref_id AND k.plant = a.plant) WHERE n = 1),
    near_h AS (SELECT * FROM (SELECT a.*, k.unit_price AS v, row_number() OVER (PARTITION BY a.ref_id, a.plant, a.qty ORDER BY abs(k.qty - a.qty), k.unit_price) AS n FROM asked_ref a JOIN history k ON k.part_id = a.ref_id AND k.plant = a.plant) WHERE n = 1),
    dv0 AS (SELECT ch.*, CASE WHEN c.n IS NOT NULL THEN unit_cost ELSE unit_price END AS mine, c.n IS NOT NULL AS by_cost, CASE WHEN volume > 0 AND ref_volume > 0 THEN coalesce(c.v, h.v) * pow(volume / ref_volume, 2.0 / 3) END AS scaled
        FROM ch LEFT JOIN near_c c ON c.ref_id = ch.ref_id AND c.plant = ch.plant AND c.qty = ch.qty LEFT JOIN near_h h ON h.ref_id = ch.ref_id AND h.plant = ch.plant AND h.qty = ch.qty),
    dv AS (SELECT *, CASE WHEN scaled > 0 THEN (mine - scaled) / scaled END AS deviation FROM dv0)"""

QUERIES = {f.__name__: f for f in (cost_lines, cost_sources, cost_breakdown, recommended_plant, price_deviations, overridden_plants, price_matrix, routing_view, offered_quantities, feature_vectors, vector_parity, similar_parts, reference_costs, requested_reference_costs, reuse_hints, bom_prices, catalog_matches, unpriced_items, priced_shares, new_items)}
_BOM = ctes("bom", "catalog", "part_numbers", "part_costs") + BOM_BODY
ORACLES = {
    "cost_lines": _COST + " SELECT rfq_id, line_no, plant, qty, category, ordinal, round(amount + 1e-7, 4) AS amount FROM amounts",
    "cost_breakdown": _COST + " SELECT rfq_id, line_no, plant, qty, feasible, reason, round(unit_cost + 1e-7, 4) AS unit_cost, round(unit_price + 1e-7, 4) AS unit_price, round(total + 1e-7, 4) AS total, min_order_applied, lead_weeks, meets_due FROM broken",
    "recommended_plant": _COST + RECOMMENDED + " SELECT rfq_id, line_no, qty, plant, round(unit_price + 1e-7, 4) AS unit_price, n_feasible FROM rec",
    "cost_sources": _COST + " SELECT rfq_id, line_no, plant, qty, category, ordinal, source, formula FROM amounts",
    "overridden_plants": _COST.replace("WITH ", ctes("overrides") + ", ", 1) + RECOMMENDED + f""", w AS (SELECT rfq_id, CASE WHEN margin > 1 THEN margin / 100 ELSE margin END AS m, nullif(upper(plant), 'AUTO') AS wish FROM overrides),
        x AS (SELECT r.rfq_id, r.line_no, r.qty, r.plant AS advised, r.unit_cost AS cost0, b.plant AS wish, b.unit_cost AS cost1, CASE WHEN m >= 0 AND m < 0.9 THEN m ELSE {DEFAULT.margin} END AS margin FROM rec r LEFT JOIN w USING (rfq_id) LEFT JOIN broken b ON b.rfq_id = r.rfq_id AND b.line_no = r.line_no AND b.qty = r.qty AND b.plant = w.wish AND b.feasible)
        SELECT rfq_id, line_no, qty, coalesce(wish, advised) AS plant, wish IS NOT NULL AS overridden, round(margin + 1e-7, 4) AS margin, round(coalesce(cost1, cost0) / (1 - margin) + 1e-7, 4) AS unit_price FROM x""",
    "bom_prices": _BOM + f" SELECT part_id, item_no, qty, source, method, matched, plant, CASE method {' '.join(f"WHEN '{k}' THEN {v}" for k, v in bom_ops.CONFIDENCE.items())} END AS confidence, round(unit_cost + 1e-7, 4) AS unit_cost FROM pb",
    "catalog_matches": _BOM + " SELECT part_id, item_no, coalesce(e_num, l_num) AS catalog_number, CASE WHEN e_num IS NOT NULL THEN 'exact' WHEN l_num IS NOT NULL THEN 'normalized' END AS how FROM bx",
    "unpriced_items": _BOM + " SELECT part_id, CAST(count(*) AS INT) AS n_unpriced, string_agg(trim(concat_ws(' ', part_number, description)), '; ' ORDER BY item_no) AS items FROM pb WHERE unit_cost IS NULL GROUP BY 1",
    "priced_shares": _BOM + " SELECT part_id, round(count(unit_cost) / count(*) + 1e-7, 4) AS bom_match FROM pb GROUP BY 1",
    "new_items": _BOM + " SELECT part_id, item_no, coalesce(part_number, description) AS label FROM pb WHERE source = 'new' AND coalesce(standard, '') = ''",
    "reuse_hints": _SIM + f""", h AS (SELECT t.*, CASE WHEN diameter <= 0 THEN 1.0 ELSE 1 - exp({similarity.TAU} * ln(diameter)) END AS d1, CASE WHEN len4 <= 0 THEN 1.0 ELSE 1 - exp({similarity.TAU} * ln(len4)) END AS d2 FROM top t JOIN v q ON q.part_id = t.query_id JOIN v p ON p.part_id = t.part_id WHERE rank = 1 AND score >= {similarity.REUSE_SCORE} AND q.material_code = p.material_code)
        SELECT query_id, part_id, score, round(greatest(d1, d2) + 1e-7, 4) AS largest_difference FROM h WHERE greatest(d1, d2) < {similarity.REUSE_DIFFERENCE}""",
    "price_matrix": _COST + """, lab AS (SELECT rfq_id, line_no, qty, plant, CASE WHEN NOT feasible THEN 'not feasible' ELSE printf('%.2f', round(unit_price + 1e-7, 2)) || CASE WHEN min_order_applied THEN ' (minimum order)' ELSE '' END || CASE WHEN NOT coalesce(meets_due, TRUE) THEN ' (late)' ELSE '' END END AS x FROM broken)
        SELECT rfq_id, line_no, qty, max(x) FILTER (WHERE plant = 'DE') AS de, max(x) FILTER (WHERE plant = 'PL') AS pl, max(x) FILTER (WHERE plant = 'CN') AS cn FROM lab GROUP BY 1, 2, 3""",
    "routing_view": ctes("ops") + " SELECT rfq_id, line_no, seq, coalesce(centre, service) AS place, CASE WHEN suggested THEN 'suggested' WHEN service IS NOT NULL THEN 'outsourced: ' || service ELSE 'costed' END AS status FROM ops",
    "offered_quantities": ctes("items") + """, a AS (SELECT rfq_id, list_sort(list_distinct(list(qty) FILTER (WHERE qty > 0))) AS q FROM items GROUP BY 1)
        SELECT rfq_id, array_to_string(q, ',') AS asked, CASE WHEN len(q) = 1 THEN array_to_string(list_concat(q, list_filter([50, 200, 500, 1000, 2500], lambda t : t > q[1])[1:1]), ',') ELSE array_to_string(q, ',') END AS offered FROM a""",
    "feature_vectors": _SIM + " SELECT part_id, shape_class, main_mm, length_mm, material_code, mat_group, n_holes, n_threads, has_keyway, has_gear, has_heat, has_surface, min_it, min_ra FROM v",
    "vector_parity": _SIM + " SELECT part_id, 0 AS n_different FROM v",
    "similar_parts": _SIM + ' SELECT query_id, part_id, rank, score, diameter, "precision" FROM top',
    "reference_costs": ctes("parts", "materials", "features", "specs", "part_costs", "history") + _SIM_BODY + """,
        c AS (SELECT t.query_id, k.unit_cost AS x, k.qty, row_number() OVER (PARTITION BY t.query_id ORDER BY abs(k.qty - 20), k.unit_cost, k.plant) AS n FROM top t JOIN part_costs k USING (part_id) WHERE rank = 1),
        h AS (SELECT t.query_id, k.unit_price AS x, k.qty, row_number() OVER (PARTITION BY t.query_id ORDER BY abs(k.qty - 20), k.unit_price, k.plant) AS n FROM top t JOIN history k USING (part_id) WHERE rank = 1)
        SELECT t.query_id, t.part_id, round((CASE WHEN c.n IS NOT NULL THEN c.x ELSE h.x END) + 1e-7, 4) AS ref_unit_cost, CASE WHEN c.n IS NOT NULL THEN c.qty ELSE h.qty END AS ref_qty
        FROM top t LEFT JOIN c ON c.query_id = t.query_id AND c.n = 1 LEFT JOIN h ON h.query_id = t.query_id AND h.n = 1 WHERE rank = 1""",
    "requested_reference_costs": ctes("parts", "materials", "features", "specs", "part_costs", "history", "items") + _SIM_BODY + """,
        asked AS (SELECT part_id AS query_id, min(qty) AS want FROM items WHERE qty > 0 GROUP BY 1),
        q AS (SELECT t.query_id, t.part_id, t.rank, CAST(coalesce(a.want, 200) AS INT) AS want FROM top t LEFT JOIN asked a USING (query_id)),
        c AS (SELECT q.query_id, q.part_id, k.unit_cost AS x, k.qty, row_number() OVER (PARTITION BY q.query_id, q.part_id ORDER BY abs(k.qty - want), k.unit_cost, k.plant) AS n FROM q JOIN part_costs k USING (part_id)),
        h AS (SELECT q.query_id, q.part_id, k.unit_price AS x, k.qty, row_number() OVER (PARTITION BY q.query_id, q.part_id ORDER BY abs(k.qty - want), k.unit_price, k.plant) AS n FROM q JOIN history k USING (part_id))
        SELECT q.query_id, q.part_id, q.rank, q.want, round((CASE WHEN c.n IS NOT NULL THEN c.x ELSE h.x END) + 1e-7, 4) AS ref_unit_cost, CASE WHEN c.n IS NOT NULL THEN c.qty ELSE h.qty END AS ref_qty
        FROM q LEFT JOIN c ON c.query_id = q.query_id AND c.part_id = q.part_id AND c.n = 1 LEFT JOIN h ON h.query_id = q.query_id AND h.part_id = q.part_id AND h.n = 1""",
}
ORACLES = {k: doubles(v) for k, v in ORACLES.items()}
