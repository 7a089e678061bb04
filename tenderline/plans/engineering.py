"""Queries on geometry, routing, findings and triage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderline.operators import bom as bom_ops, geometry, routing, triage, validation
from tenderline.params import DEFAULT
from tenderline.plans import drawings, quoting
from tenderline.plans.quoting import GUESS, MEAN, rounded, tolerance_values
from tenderline.sources import scratch
from tenderline.sources.adapters import ctes, domain, doubles

VOLUMES = ["envelope_cm3", "finished_cm3", "stock_cm3", "removed_cm3", "cut_mm"]


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return geometry.measure(domain(spark, d, "parts"), domain(spark, d, "features"))


def _context(spark: SparkSession, d: str) -> DataFrame:
    return routing.rule_context(_measured(spark, d), domain(spark, d, "features"), domain(spark, d, "specs"), domain(spark, d, "materials"), domain(spark, d, "bom"))


def _drawings(spark: SparkSession, d: str) -> DataFrame:
    return domain(spark, d, "parts").select("part_id", "shape_class", "material_code").join(domain(spark, d, "specs"), "part_id")


def _findings(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return validation.drawing_findings(_drawings(spark, d), domain(spark, d, "features"), domain(spark, d, "materials"), more)


def tolerance_grades(spark: SparkSession, d: str) -> DataFrame:
    """NR-04 to NR-06 for every feature."""
    return geometry.tolerances(domain(spark, d, "features")).select("fid", "part_id", "grade", "upper_mm", "lower_mm")


def part_geometry(spark: SparkSession, d: str) -> DataFrame:
    """GE-01 to GE-05."""
    return _measured(spark, d).select("part_id", "d", "stock", "stock_mm", "standard_stock", *[rounded(v).alias(v) for v in VOLUMES])


def rule_operations(spark: SparkSession, d: str) -> DataFrame:
    """RT-01 to RT-15, RT-18, GE-07."""
    return routing.rule_routing(_context(spark, d))


def single_part_boms(spark: SparkSession, d: str) -> DataFrame:
    """BM-01."""
    return bom_ops.single_part_bom(_measured(spark, d), routing.rule_routing(_context(spark, d)), domain(spark, d, "materials"))


def uncovered_features(spark: SparkSession, d: str) -> DataFrame:
    """RT-16, TR-03."""
    return routing.uncovered(_context(spark, d)).withColumn("coverage", rounded("coverage"))


def drawing_findings(spark: SparkSession, d: str) -> DataFrame:
    """VA-02, VA-03, VA-05, VA-06, VA-08 to VA-15."""
    return _findings(spark, d)


def _listed(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Lists of findings of all lines, with columns `more` of the feature that each is about."""
    built = domain(spark, d, "parts").where("shape_class = 'assembly'").select("part_id")
    unknown = bom_ops.new_items(quoting._priced_bom(spark, d)).join(built, "part_id")
    unreadable = drawings.rejected_drawings(spark, d).withColumnRenamed("drawing", "rfq_id")
    return validation.listed(domain(spark, d, "items"), _drawings(spark, d), _findings(spark, d, *more), unknown, unreadable, more)


def findings_by_request(spark: SparkSession, d: str) -> DataFrame:
    """VA-01, VA-04, VA-17."""
    return validation.rollup(validation.ordered(_listed(spark, d)))


def ordered_findings(spark: SparkSession, d: str) -> DataFrame:
    """VA-17: the list of each line."""
    return validation.ordered(_listed(spark, d))


def _assessed(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their scores: what was read of the request's drawing and with what evidence, most similar part, deviation of the recommended price from it, priced
    share of the parts list, coverage, and all findings of the line."""

    def build() -> DataFrame:
        cover = routing.uncovered(_context(spark, d)).select("part_id", "coverage")
        x = domain(spark, d, "parts").select("part_id", "shape_class").join(cover, "part_id").join(bom_ops.priced_share(quoting._priced_bom(spark, d)), "part_id", "left").fillna({"bom_match": 0.0})
        read, features, _ = drawings.read_drawings(spark, d)
        told = triage.extraction_scores(read, features, domain(spark, d, "titles")).withColumnRenamed("drawing", "rfq_id")
        lines = quoting._deviations(spark, d).drop("qty").join(x, "part_id").join(domain(spark, d, "items").select("rfq_id", "line_no", F.col("qty").alias("asked")), ["rfq_id", "line_no"])
        lines = lines.join(validation.count_listed(_listed(spark, d)), ["rfq_id", "line_no"], "left").join(told, "rfq_id", "left")
        lines = lines.withColumn("extraction", triage.extraction(F.col("has"), F.col("told"), F.col("n_faults"), F.col("asked")))
        return triage.assess(lines.drop("has", "told", "n_faults", "asked"))

    return scratch.once(spark, d, "assessed", build)


def line_tiers(spark: SparkSession, d: str) -> DataFrame:
    """TR-01, TR-02, TR-04 to TR-06."""
    return _assessed(spark, d).select("rfq_id", "line_no", "tier", "reason", rounded("overall").alias("overall"))


def request_tiers(spark: SparkSession, d: str) -> DataFrame:
    """TR-08, OP-03."""
    return triage.rollup(_assessed(spark, d))


def tier_distribution(spark: SparkSession, d: str) -> DataFrame:
    """OP-02."""
    return triage.tier_distribution(_assessed(spark, d))


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({column}, '')), '{w}')" for w in words) + ")"


def _service(column: str, table: dict[str, tuple[str, ...]]) -> str:
    return "CASE " + " ".join(f"WHEN {_any(column, w)} THEN '{k}'" for k, w in table.items()) + " END"


def _series(v: str, series: tuple[int, ...]) -> str:
    return f"list_filter({[float(s) for s in series]}, lambda s : s >= {v} - 0.000000001)[1]"


_CYL = "pi() / 4 * {0} * {0} * {1} / 1000"
_MEASURED = f""", g AS (SELECT *, nullif(nominal, 0) AS n, nullif(len_mm, 0) AS ln FROM features),
    gs AS (SELECT part_id, max(n) FILTER (ftype = 'outer_diameter') AS max_od, sum({_CYL.format('n', 'ln')} * qty) FILTER (ftype = 'outer_diameter') AS seg_cm3,
        sum(ln * qty) FILTER (ftype = 'outer_diameter' AND n IS NOT NULL) AS seg_len, min(n) FILTER (ftype = 'outer_diameter' AND ln IS NOT NULL) AS seg_min,
        sum({_CYL.format('n', 'ln')} * qty) FILTER (ftype IN ('bore', 'hole')) AS hole_cm3, sum({_CYL.format('n', '1')} * qty) FILTER (ftype IN ('bore', 'hole') AND ln IS NULL) AS hole_per_mm,
        sum(n * ln * qty / 1000) FILTER (ftype IN ('pocket', 'slot')) AS cut_cm2 FROM g GROUP BY 1),
    dims AS (SELECT p.part_id, shape_class, material_code, coalesce(nullif(main_mm, 0), max_od, 0.0) AS d, length_mm AS l, width_mm AS w, height_mm AS h, seg_cm3, seg_len, seg_min, coalesce(hole_cm3, 0.0) AS hc, coalesce(hole_per_mm, 0.0) AS hm, coalesce(cut_cm2, 0.0) AS cc FROM parts p LEFT JOIN gs USING (part_id)),
    vols AS (SELECT *, CASE WHEN shape_class = 'rotational' THEN {_CYL.format('d', 'l')} ELSE l * w * h / 1000 END AS envelope_cm3,
        CASE WHEN shape_class = 'rotational' THEN CASE WHEN seg_cm3 IS NULL THEN {_CYL.format('d', 'l')} * 0.7 ELSE seg_cm3 + CASE WHEN l > seg_len THEN {_CYL.format('seg_min', '(l - seg_len)')} ELSE 0.0 END - hc - hm * l END
            WHEN hc + hm * h + cc * h / 2 <= 0 THEN l * w * h / 1000 * 0.6 ELSE l * w * h / 1000 - (hc + hm * h + cc * h / 2) END AS v0,
        list_sort([l, w, h]) AS sides FROM dims),
    stocks AS (SELECT *, CASE WHEN shape_class = 'assembly' OR envelope_cm3 <= 0 THEN 0.0 ELSE least(greatest(v0, envelope_cm3 * 0.15), envelope_cm3) END AS finished_cm3,
        CASE shape_class WHEN 'rotational' THEN 'bar' WHEN 'prismatic' THEN 'plate' ELSE 'none' END AS stock,
        CASE shape_class WHEN 'rotational' THEN {_series('d + 3', DEFAULT.bars_mm)} WHEN 'prismatic' THEN {_series('sides[1] + 3', DEFAULT.plates_mm)} END AS found FROM vols),
    sized AS (SELECT *, CASE WHEN shape_class <> 'assembly' THEN coalesce(found, ceil((CASE WHEN shape_class = 'rotational' THEN d ELSE sides[1] END + 3) / 10) * 10) END AS stock_mm, CASE WHEN shape_class <> 'assembly' THEN found IS NOT NULL END AS standard_stock FROM stocks),
    measured AS (SELECT *, CASE shape_class WHEN 'rotational' THEN {_CYL.format('stock_mm', '(l + 5)')} WHEN 'prismatic' THEN (sides[3] + 3) * (sides[2] + 3) * stock_mm / 1000 ELSE 0.0 END AS stock_cm3,
        CASE WHEN shape_class = 'assembly' THEN 0.0 ELSE greatest(CASE shape_class WHEN 'rotational' THEN {_CYL.format('stock_mm', '(l + 5)')} ELSE (sides[3] + 3) * (sides[2] + 3) * stock_mm / 1000 END - finished_cm3, 0.0) END AS removed_cm3,
        CASE shape_class WHEN 'rotational' THEN stock_mm WHEN 'prismatic' THEN sqrt((sides[2] + 3) * stock_mm) ELSE 0.0 END AS cut_mm FROM sized)"""

_ROUTED = (
    _MEASURED
    + f""", gm AS (SELECT f.*, d, shape_class, {MEAN} AS mean FROM features f JOIN measured USING (part_id)),
    gu AS (SELECT *, 0.45 * pow(mean, 1.0 / 3) + 0.001 * mean AS unit FROM gm),
    gg AS (SELECT *, coalesce(it_grade, CAST(nullif(regexp_extract(trim(fit), '(\\d{{1,2}})$', 1), '') AS INT), CASE WHEN nominal <> 0 AND band IS NOT NULL THEN {GUESS} END) AS grade,
        0.3 * qty * (1 + coalesce(nullif(len_mm, 0) / nullif(nominal, 0), 2.0) / 5) AS drill, ftype = 'thread' AND nominal > 0 AND d > 0 AND nominal >= d / 2 AS outside FROM gu),
    cnt AS (SELECT part_id, sum(qty) AS n_all, count(*) AS n_features, coalesce(sum(qty) FILTER (ftype = 'outer_diameter'), 0) AS n_od, coalesce(sum(qty) FILTER (ftype = 'groove'), 0) AS n_groove, coalesce(sum(qty) FILTER (ftype = 'chamfer'), 0) AS n_chamfer,
        coalesce(sum(qty) FILTER (ftype = 'bore'), 0) AS n_bore, coalesce(sum(qty) FILTER (ftype = 'pocket'), 0) AS n_pocket, coalesce(sum(qty) FILTER (ftype IN ('slot', 'groove', 'keyway')), 0) AS n_slots, coalesce(sum(qty) FILTER (ftype IN ('slot', 'keyway')), 0) AS n_keys,
        coalesce(sum(qty) FILTER (ftype = 'thread'), 0) AS n_thr, coalesce(sum(qty) FILTER (outside), 0) AS n_out, coalesce(sum(qty) FILTER (ftype = 'hole'), 0) AS n_drilled, coalesce(sum(qty) FILTER (ftype = 'gear'), 0) AS n_gears,
        coalesce(sum(drill) FILTER (ftype = 'hole'), 0.0) AS hole_min, coalesce(sum(drill) FILTER (ftype IN ('hole', 'bore')), 0.0) AS hb_min,
        coalesce(sum(0.12 * coalesce(teeth, 20) * coalesce(nullif(len_mm, 0), 20.0) / 10 * sqrt(coalesce(module, 2.0)) * qty) FILTER (ftype = 'gear'), 0.0) AS gear_min, count(*) FILTER (ftype = 'gear' AND (teeth IS NULL OR module IS NULL)) > 0 AS gear_guess,
        coalesce(sum(qty) FILTER (grade <= 6 OR ra_um <= 0.8), 0) AS n_ground, coalesce(sum(coalesce(nullif(len_mm, 0), 20.0) * qty) FILTER (grade <= 6 OR ra_um <= 0.8), 0.0) AS ground_mm, coalesce(sum(qty) FILTER (grade <= 7), 0) AS n_tight,
        count(*) FILTER (shape_class = 'rotational' AND ftype = 'pocket') AS n_uncovered FROM gg GROUP BY 1),
    lists AS (SELECT part_id, coalesce(sum(qty) FILTER (fast), 0) AS n_fast, coalesce(sum(qty) FILTER (NOT fast), 0) AS n_items FROM (SELECT *, regexp_matches(lower(concat_ws(' ', description, standard, part_number)), '{routing.FASTENER}') AS fast FROM bom) GROUP BY 1),
    ctx AS (SELECT m.*, heat_treatment, surface_treatment, notes, mat_group, coalesce(machinability, 1.0) AS mach, n_fast, n_items, coalesce(n_all, 0) AS n_all, coalesce(n_features, 0) AS n_features, coalesce(n_uncovered, 0) AS n_uncovered, coalesce(gear_guess, FALSE) AS gear_guess,
        {', '.join(f'coalesce({c}, 0) AS {c}' for c in 'n_od n_groove n_chamfer n_bore n_pocket n_slots n_keys n_thr n_out n_drilled n_gears hole_min hb_min gear_min n_ground ground_mm n_tight'.split())},
        coalesce({_service('heat_treatment', routing.HEAT_WORDS)}, CASE WHEN {_any('heat_treatment', routing.HARD_WORDS)} THEN 'HT_QT' END) AS heat, ({_service('heat_treatment', routing.HEAT_WORDS)}) IS NULL AS generic, {_service('surface_treatment', routing.SURFACE_WORDS)} AS surface
        FROM measured m LEFT JOIN cnt USING (part_id) LEFT JOIN specs USING (part_id) LEFT JOIN lists USING (part_id) LEFT JOIN materials t ON m.material_code = t.code)"""
)
_OPS = [  # condition, op, centre, service, setup, cycle, rules, confidence
    ("shape_class <> 'assembly'", "SAW", "'SAW'", "NULL", "5", "0.5 + 0.02 * cut_mm", "R01", "0.7"),
    ("shape_class = 'rotational'", "TURN", "'CNC_TURN'", "NULL", "CASE WHEN n_od >= 3 OR (n_bore > 0 AND n_od >= 2) THEN 40 ELSE 30 END", "1 + 0.015 * removed_cm3 / mach + 0.3 * n_od + 0.4 * (n_groove + n_out) + 0.1 * n_chamfer", "R02", "0.7"),
    ("shape_class = 'prismatic'", "MILL", f"CASE WHEN {_any('notes', routing.FIVE_AXIS)} THEN 'CNC_MILL_5AX' ELSE 'CNC_MILL_3AX' END", "NULL", "45", "2 + 0.02 * removed_cm3 / mach + 0.5 * n_pocket + 0.3 * n_slots + hb_min + 0.4 * n_thr", "' || CASE WHEN hb_min > 0 OR n_thr > 0 THEN 'R03,R04' ELSE 'R03' END || '", "0.7"),
    ("shape_class = 'rotational' AND (n_drilled > 0 OR n_thr > n_out)", "DRILL", "'DRILL'", "NULL", "15", "hole_min + 0.4 * (n_thr - n_out)", "R04", "0.7"),
    ("shape_class = 'rotational' AND n_keys > 0", "KEYWAY", "'CNC_MILL_3AX'", "NULL", "20", "1.5 * n_keys", "R05", "0.7"),
    ("shape_class <> 'assembly' AND n_gears > 0", "HOB", "'HOB'", "NULL", "40", "gear_min", "R06", "CASE WHEN gear_guess THEN 0.5 ELSE 0.7 END"),
    ("shape_class <> 'assembly' AND heat IS NOT NULL", "HEAT_TREAT", "'OUTSOURCED'", "heat", "0", "0", "R07", "CASE WHEN generic THEN 0.5 ELSE 0.8 END"),
    ("shape_class <> 'assembly' AND n_ground > 0", "GRIND", "CASE WHEN shape_class = 'rotational' THEN 'GRIND_CYL' ELSE 'GRIND_SURF' END", "NULL", "25", "1.5 * n_ground + 0.02 * ground_mm", "R08", "0.7"),
    ("shape_class <> 'assembly' AND surface IS NOT NULL", "SURFACE", "'OUTSOURCED'", "surface", "0", "0", "R09", "CASE WHEN surface = 'ANODIZE' AND mat_group <> 'aluminium' THEN 0.4 ELSE 0.8 END"),
    ("shape_class <> 'assembly'", "DEBURR", "'DEBURR'", "NULL", "0", "0.5 + 0.05 * n_all", "R10", "0.7"),
    ("shape_class <> 'assembly'", "INSPECT", "CASE WHEN n_tight >= 3 THEN 'INSPECT_CMM' ELSE 'INSPECT' END", "NULL", "CASE WHEN n_tight >= 3 THEN 15 ELSE 0 END", "CASE WHEN n_tight >= 3 THEN 4.0 ELSE 1.5 END", "R11", "0.7"),
    ("shape_class = 'assembly'", "ASSEMBLY", "'ASSEMBLY'", "NULL", "20", "1.2 * coalesce(n_items, 0) + 0.3 * coalesce(n_fast, 0)", "R12", "CASE WHEN n_items IS NULL THEN 0.4 ELSE 0.7 END"),
    ("shape_class = 'assembly'", "TEST", "'TEST'", "NULL", "10", "5.0", "R13", "0.7"),
    ("TRUE", "WASH_PACK", "'WASH_PACK'", "NULL", "0", "0.3", "R14", "0.7"),
]
_FIRED = " UNION ALL ".join(f"SELECT part_id, {k} AS k, '{o}' AS op_code, {w} AS work_center, {s} AS service_code, CAST({su} AS DOUBLE) AS setup_min, round({cy} + 1e-7, 2) AS cycle_min, '{r}' AS rule_ids, CAST({cf} AS DOUBLE) * CASE WHEN mat_group IS NULL AND shape_class <> 'assembly' THEN 0.8 ELSE 1.0 END AS cf FROM ctx WHERE {c}" for k, (c, o, w, s, su, cy, r, cf) in enumerate(_OPS))
_COVERAGE = f""", cov0 AS (SELECT part_id, n_uncovered, n_features, shape_class <> 'assembly' AND coalesce(heat_treatment, '') <> '' AND heat IS NULL AS unknown_heat, shape_class <> 'assembly' AND coalesce(surface_treatment, '') <> '' AND surface IS NULL AS unknown_surface FROM ctx),
    cov AS (SELECT *, CASE WHEN n_features = 0 THEN 1.0 ELSE greatest(0.0, 1 - (n_uncovered + unknown_heat::INT + unknown_surface::INT) / n_features) END AS coverage FROM cov0)"""
_WALL = "CASE mat_group WHEN 'aluminium' THEN 1.5 WHEN 'cast_iron' THEN 3.0 ELSE 2.0 END"
_FOUND = f""", dr AS (SELECT p.part_id, shape_class, material_code, mat_group, s.* EXCLUDE (part_id) FROM parts p JOIN specs s USING (part_id) LEFT JOIN materials m ON p.material_code = m.code),
    ff AS (SELECT f.*, {_WALL} AS least_wall, coalesce(it_grade, list_min(list_transform(regexp_extract_all(fit, '[0-9]+'), lambda x : CAST(x AS INT)))) AS vgrade, nullif(len_mm, 0) / nullif(nominal, 0) AS deep FROM features f JOIN dr USING (part_id)),
    finds AS (SELECT part_id, NULL::BIGINT AS fid, 'VAL-001' AS code, 'blocker' AS severity FROM dr WHERE trim(coalesce(material_text, '')) = '' AND shape_class <> 'assembly'
        UNION ALL SELECT part_id, NULL, 'VAL-002', 'warning' FROM dr WHERE trim(coalesce(material_text, '')) <> '' AND material_code IS NULL
        UNION ALL SELECT part_id, NULL, 'VAL-004', 'warning' FROM dr WHERE trim(coalesce(general_tolerance, '')) = '' AND shape_class <> 'assembly'
        UNION ALL SELECT part_id, NULL, 'VAL-005', 'info' FROM dr WHERE trim(coalesce(general_tolerance, '')) = '' AND part_id IN (SELECT part_id FROM ff WHERE nominal <> 0 AND band IS NULL AND fit IS NULL)
        UNION ALL SELECT part_id, fid, 'DFM-001', 'warning' FROM ff WHERE ftype = 'wall' AND nominal < least_wall
        UNION ALL SELECT part_id, fid, 'DFM-002', 'warning' FROM ff WHERE ftype IN ('hole', 'bore') AND deep > 10
        UNION ALL SELECT part_id, fid, 'DFM-003', 'info' FROM ff WHERE vgrade <= 6
        UNION ALL SELECT part_id, fid, 'DFM-004', 'warning' FROM ff WHERE ra_um <= 0.4
        UNION ALL SELECT part_id, NULL, 'DFM-004', 'warning' FROM dr WHERE default_ra <= 0.4
        UNION ALL SELECT part_id, NULL, 'DFM-005', 'info' FROM dr WHERE trim(coalesce(heat_treatment, '')) <> '' AND part_id IN (SELECT part_id FROM ff WHERE vgrade <= 7 OR ra_um <= 0.8)
        UNION ALL SELECT part_id, fid, 'DFM-006', 'warning' FROM ff WHERE ftype IN ('pocket', 'slot') AND radius < 0.5
        UNION ALL SELECT part_id, NULL, 'DFM-006', 'warning' FROM dr WHERE regexp_matches(lower(notes), '(sharp|scharf).*(corner|radi|ecke)')
        UNION ALL SELECT part_id, fid, 'DFM-007', 'info' FROM ff WHERE ftype = 'thread' AND deep > 3),
    lf0 AS (SELECT rfq_id, line_no, fid, code, severity FROM items JOIN finds USING (part_id) UNION ALL SELECT rfq_id, line_no, NULL, 'VAL-010', 'blocker' FROM items WHERE part_id NOT IN (SELECT part_id FROM dr)
        UNION ALL SELECT rfq_id, line_no, NULL, 'VAL-003', 'blocker' FROM items WHERE coalesce(qty, 0) <= 0),
    lf AS (SELECT * FROM lf0 UNION ALL SELECT rfq_id, line_no, NULL, 'VAL-011', 'warning' FROM items JOIN pb USING (part_id) JOIN parts USING (part_id) WHERE shape_class = 'assembly' AND source = 'new' AND coalesce(standard, '') = ''
        UNION ALL SELECT rfq_id, line_no, NULL, 'VAL-010', 'blocker' FROM items i WHERE rfq_id IN (SELECT drawing FROM titles UNION SELECT drawing FROM notes) AND rfq_id NOT IN (SELECT drawing FROM views) AND NOT EXISTS (SELECT 1 FROM lf0 l WHERE l.rfq_id = i.rfq_id AND l.line_no = i.line_no AND severity = 'blocker'))"""
_TIERS = """, fc AS (SELECT rfq_id, line_no, count(*) FILTER (severity = 'blocker') AS nb, count(*) FILTER (severity = 'warning') AS nw FROM lf GROUP BY 1, 2),
    tb AS (SELECT drawing, unnest(['part_number', 'revision', 'title', 'material', 'general_tolerance', 'default_ra', 'scale']) AS field, unnest([part_number, revision, title, material, general_tolerance, default_ra::VARCHAR, scale]) AS val, evidence FROM titles),
    tf AS (SELECT drawing, count(*) AS n, count(*) FILTER (contains(';' || evidence, ';' || field || '=')) AS shown, bool_or(field = 'part_number') AS pn, bool_or(field = 'material') AS mt FROM tb WHERE trim(val) <> '' GROUP BY 1),
    fe AS (SELECT drawing, count(*) AS n, count(evidence) AS shown FROM f4 GROUP BY 1),
    ex AS (SELECT nd.drawing, CASE WHEN coalesce(tf.n, 0) + coalesce(fe.n, 0) = 0 THEN 0.0 ELSE (coalesce(tf.shown, 0) + coalesce(fe.shown, 0)) / (coalesce(tf.n, 0) + coalesce(fe.n, 0)) END AS told, len(warnings) AS faults,
        coalesce(pn, FALSE)::INT + (coalesce(mt, FALSE) OR shape_class = 'assembly')::INT + (coalesce(fe.n, 0) > 0 OR (shape_class = 'assembly' AND items IS NOT NULL))::INT
        + coalesce(CASE shape_class WHEN 'rotational' THEN max_diameter_mm > 0 AND length_mm > 0 WHEN 'prismatic' THEN length_mm > 0 AND width_mm > 0 AND height_mm > 0 ELSE coalesce(max_diameter_mm > 0, FALSE) OR coalesce(length_mm > 0, FALSE) OR coalesce(width_mm > 0, FALSE) OR coalesce(height_mm > 0, FALSE) END, FALSE)::INT AS has
        FROM normal nd LEFT JOIN tf ON tf.drawing = nd.drawing LEFT JOIN fe ON fe.drawing = nd.drawing),
    ps_ AS (SELECT part_id, count(unit_cost) / count(*) AS bm FROM pb GROUP BY 1),
    sc AS (SELECT p.part_id, p.shape_class, coverage, coalesce(bm, 0.0) AS bm FROM parts p JOIN cov USING (part_id) LEFT JOIN ps_ USING (part_id)),
    rw AS (SELECT i.rfq_id, i.line_no, sc.*, coalesce(nb, 0) AS nb, coalesce(nw, 0) AS nw, t.score AS top, dv.deviation AS dev, CASE WHEN told IS NULL THEN 0.0 ELSE least(1.0, greatest(0.0, (has + (i.qty > 0)::INT) / 5 * told * (1 - 0.1 * faults))) END AS extraction
        FROM items i JOIN sc USING (part_id) LEFT JOIN fc ON fc.rfq_id = i.rfq_id AND fc.line_no = i.line_no LEFT JOIN ex ON ex.drawing = i.rfq_id LEFT JOIN top t ON t.query_id = i.part_id AND t.rank = 1 LEFT JOIN dv ON dv.rfq_id = i.rfq_id AND dv.line_no = i.line_no),
    rs AS (SELECT *, CASE WHEN dev IS NULL THEN 0.6 WHEN abs(dev) <= 0.15 THEN 1.0 WHEN abs(dev) <= 0.3 THEN 0.7 ELSE 0.4 END AS ps FROM rw),
    ov AS (SELECT *, CASE WHEN shape_class = 'assembly' THEN 0.3 * extraction + 0.2 * coalesce(top, 0.3) + 0.15 * coverage + 0.15 * ps + 0.2 * bm ELSE 0.35 * extraction + 0.25 * coalesce(top, 0.3) + 0.2 * coverage + 0.2 * ps END AS raw FROM rs),
    gt AS (SELECT *, CASE WHEN nw > 0 THEN 'warnings present' WHEN coalesce(top, 0) < 0.85 THEN 'no close precedent' WHEN dev IS NULL OR abs(dev) > 0.3 THEN 'price not confirmed' END AS gate FROM ov),
    tr AS (SELECT rfq_id, line_no, part_id, CASE WHEN nb > 0 OR raw < 0.55 THEN 'manual' WHEN raw >= 0.8 AND gate IS NULL THEN 'fast_track' ELSE 'standard' END AS tier,
        CASE WHEN nb > 0 THEN 'blocked' WHEN raw < 0.55 THEN 'low confidence' WHEN raw >= 0.8 THEN gate END AS reason, CASE WHEN nb > 0 THEN 0.0 ELSE raw END AS overall FROM gt)"""


_TABLE = tolerance_values()
_M, _R = ctes("parts", "features"), ctes("parts", "features", "specs", "materials", "bom")
FOUND_TABLES = ("parts", "features", "specs", "materials", "items", "bom", "catalog", "part_numbers", "part_costs", "views", "titles", "notes")
_F = ctes(*FOUND_TABLES) + quoting.BOM_BODY
ASSESSED_TABLES = ("features", "specs", "history", "recorded", *drawings.READ_TABLES, *quoting._COST_TABLES)


def assessed(*more: str) -> str:
    """SQL up to the tiers of lines (tr), with more domain tables before it."""
    return ctes(*ASSESSED_TABLES, *more) + drawings.READ + quoting._COST_BODY + quoting._SIM_BODY + _ROUTED + quoting.DEVIATION + _COVERAGE + _FOUND + _TIERS


ASSESSED = assessed()

QUERIES = {f.__name__: f for f in (tolerance_grades, part_geometry, rule_operations, single_part_boms, uncovered_features, drawing_findings, findings_by_request, ordered_findings, line_tiers, request_tiers, tier_distribution)}
ORACLES = {
    "tolerance_grades": _M + f""", tt(above, upto, g, um) AS (VALUES {_TABLE}), near AS (SELECT fid, g FROM (SELECT fid, g, row_number() OVER (PARTITION BY fid ORDER BY abs(um - band * 1000), g DESC) AS k FROM features JOIN tt ON nominal > above AND nominal <= upto WHERE fit IS NULL AND band > 0) WHERE k = 1),
        fl AS (SELECT f.*, n.g AS near_g, regexp_extract(fit, '^([A-Za-z]+)[0-9]+$', 1) AS letters, t.um / 1000 AS mm FROM features f LEFT JOIN near n USING (fid) LEFT JOIN tt t ON f.nominal > t.above AND f.nominal <= t.upto AND f.fit NOT LIKE '%/%' AND t.g = CAST(nullif(regexp_extract(f.fit, '([0-9]+)', 1), '') AS INT))
        SELECT fid, part_id, coalesce(CAST(nullif(regexp_extract(fit, '([0-9]+)', 1), '') AS INT), near_g) AS grade, CASE letters WHEN 'H' THEN mm WHEN 'h' THEN mm * 0 WHEN 'JS' THEN mm / 2 END AS upper_mm, CASE letters WHEN 'H' THEN mm * 0 WHEN 'h' THEN -mm WHEN 'JS' THEN -mm / 2 END AS lower_mm FROM fl""",
    "part_geometry": _M + _MEASURED + f" SELECT part_id, d, stock, stock_mm, standard_stock, {', '.join(f'round({v} + 1e-7, 4) AS {v}' for v in VOLUMES)} FROM measured",
    "rule_operations": _R + _ROUTED + f", fired AS ({_FIRED}) SELECT part_id, CAST(10 * row_number() OVER (PARTITION BY part_id ORDER BY k) AS INT) AS seq, op_code, work_center, service_code, setup_min, cycle_min, rule_ids, round(cf + 1e-9, 3) AS confidence FROM fired",
    "price_deviations": ctes("features", "specs", "history", *quoting._COST_TABLES) + quoting._COST_BODY + quoting._SIM_BODY + _MEASURED + quoting.DEVIATION + """
        SELECT i.rfq_id, i.line_no, dv.plant, round(deviation + 1e-7, 4) AS deviation, CASE WHEN deviation IS NOT NULL THEN CASE WHEN by_cost THEN 'cost' ELSE 'quote' END END AS basis FROM items i LEFT JOIN dv ON dv.rfq_id = i.rfq_id AND dv.line_no = i.line_no""",
    "single_part_boms": _R + _ROUTED + f""", fired AS ({_FIRED}), mk AS (SELECT m.part_id, m.material_code, stock_cm3, finished_cm3, density, price_eur_kg FROM measured m LEFT JOIN materials t ON m.material_code = t.code WHERE shape_class <> 'assembly'),
        sv AS (SELECT part_id, service_code, min(k) AS k, arg_min(cf, k) AS cf FROM fired WHERE service_code IS NOT NULL GROUP BY 1, 2)
        SELECT part_id, 1 AS item_no, CASE WHEN density IS NOT NULL THEN material_code END AS number, 'raw_material' AS source, round(coalesce(stock_cm3 * density / 1000, 0.0) + 1e-7, 3) AS qty, price_eur_kg AS unit_cost, CASE WHEN density IS NOT NULL THEN 0.9 ELSE 0.2 END AS confidence FROM mk
        UNION ALL SELECT part_id, CAST(1 + row_number() OVER (PARTITION BY part_id ORDER BY k) AS INT), service_code, 'service', round(coalesce(finished_cm3 * density / 1000, 0.0) + 1e-7, 3), NULL, round(cf + 1e-9, 3) FROM sv JOIN mk USING (part_id)""",
    "uncovered_features": _R + _ROUTED + _COVERAGE + " SELECT part_id, n_uncovered, n_features, unknown_heat, unknown_surface, round(coverage + 1e-7, 4) AS coverage FROM cov",
    "drawing_findings": _F + _FOUND + " SELECT * FROM finds",
    "findings_by_request": _F + _FOUND + " SELECT rfq_id, count(*) FILTER (severity = 'blocker') AS n_blocker, count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'info') AS n_info, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, count(*) FILTER (severity = 'blocker') > 0 AS blocked FROM lf GROUP BY 1",
    "ordered_findings": _F + _FOUND + f" SELECT *, CAST(row_number() OVER (PARTITION BY rfq_id, line_no ORDER BY list_position({list(validation.SEVERITIES)}, severity), list_position({list(validation.REGISTRY)}, code), fid NULLS FIRST) AS INT) AS ordinal FROM lf",
    "line_tiers": ASSESSED + " SELECT rfq_id, line_no, tier, reason, round(overall + 1e-7, 4) AS overall FROM tr",
    "request_tiers": ASSESSED + """, rk AS (SELECT rfq_id, max(CASE tier WHEN 'manual' THEN 3 WHEN 'standard' THEN 2 ELSE 1 END) AS r, count(*) AS n_lines FROM tr GROUP BY 1)
        SELECT rfq_id, ['fast_track', 'standard', 'manual'][r] AS tier, r = 1 AS auto, n_lines, [30, 90, 240][r] AS minutes, 240 - [30, 90, 240][r] AS saved_minutes, (240 - [30, 90, 240][r]) / 60 * 65.0 AS saved_eur FROM rk""",
    "tier_distribution": ASSESSED + " SELECT t AS tier, count(tier) AS n_lines FROM (VALUES ('fast_track'), ('standard'), ('manual')) x(t) LEFT JOIN tr ON tier = t GROUP BY 1",
}
ORACLES = {k: doubles(v) for k, v in ORACLES.items()}
