"""Queries on drawings and requests as models have read them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderline.functions import callouts as co
from tenderline.operators import drawings as dr, geometry, intake
from tenderline.plans.quoting import norm_sql, rounded, tolerance_values
from tenderline.sources import scratch
from tenderline.sources.adapters import ctes, domain, doubles

FEATURE = ["drawing", "n", "ftype", "nominal", "len_mm", "qty", "fit", "upper_mm", "lower_mm", "thread"]


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    """Readings repaired and retyped, written once: callouts are read in one pass, and several aggregations of a drawing need the outcome."""
    shapes = domain(spark, d, "views").select("drawing", "shape_class")
    return scratch.once(spark, d, "repaired", lambda: dr.retype(dr.repair(domain(spark, d, "readings")).join(shapes, "drawing")).drop("shape_class"))


def _merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    views, titles = domain(spark, d, "views"), domain(spark, d, "titles")
    features, _ = dr.complete(_repaired(spark, d), views)
    return dr.merge_regions(dr.plausible_envelopes(views, titles), titles, domain(spark, d, "notes"), features)


def repaired_features(spark: SparkSession, d: str) -> DataFrame:
    """NR-12, NR-13."""
    return _repaired(spark, d).select(*FEATURE)


def completed_features(spark: SparkSession, d: str) -> DataFrame:
    """NR-14: features numbered anew."""
    return dr.complete(_repaired(spark, d), domain(spark, d, "views"))[0].select("drawing", "n", "ftype", "nominal")


def feature_repairs(spark: SparkSession, d: str) -> DataFrame:
    """NR-14: what was dropped and added."""
    return dr.complete(_repaired(spark, d), domain(spark, d, "views"))[1]


def plausible_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """NR-15."""
    return dr.plausible_envelopes(domain(spark, d, "views"), domain(spark, d, "titles"))


def merged_drawings(spark: SparkSession, d: str) -> DataFrame:
    """NR-16."""
    x, own, _ = _merged(spark, d)
    per = own.groupBy("drawing").agg(F.count("*").alias("n_features"), F.max(F.when(F.col("evidence") == "gear data", F.col("nominal"))).alias("gear_mm"))
    return x.join(per, "drawing", "left").select("drawing", "shape_class", "no_title", "no_notes", "n_ignored", F.coalesce("n_features", F.lit(0)).alias("n_features"), "gear_mm")


def rejected_drawings(spark: SparkSession, d: str) -> DataFrame:
    """NR-16: drawings without views."""
    return dr.without_views(dr.plausible_envelopes(domain(spark, d, "views"), domain(spark, d, "titles")), domain(spark, d, "titles"), domain(spark, d, "notes"))


def drawing_checks(spark: SparkSession, d: str) -> DataFrame:
    """NR-10."""
    x, own, _ = _merged(spark, d)
    return dr.checks(x, own).select("drawing", F.array_join("warnings", ",").alias("warnings"))


def read_drawings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """NR-11: (drawings, features) of requests, brought to one form and written once; and the numbers of those that cannot be read."""
    x, own, rejected = _merged(spark, d)
    out, features = dr.normalise_drawings(x, own, domain(spark, d, "material_keys"))
    return scratch.once(spark, d, "normal_drawings", lambda: out), scratch.once(spark, d, "normal_features", lambda: features), rejected


def normalised_drawings(spark: SparkSession, d: str) -> DataFrame:
    """NR-11."""
    out, features, _ = read_drawings(spark, d)
    graded = features.groupBy("drawing").agg(F.count("grade").alias("n_graded"), F.round(F.sum("upper_mm") + 1e-7, 3).alias("upper_sum"))
    out = out.join(graded, "drawing", "left")
    return out.select("drawing", "shape_class", "material_code", rounded("max_diameter_mm").alias("max_diameter_mm"), rounded("length_mm").alias("length_mm"), F.coalesce("n_graded", F.lit(0)).alias("n_graded"), "upper_sum", F.array_join("warnings", ",").alias("warnings"))


def matched_attachments(spark: SparkSession, d: str) -> DataFrame:
    """NR-17."""
    return intake.match_attachments(domain(spark, d, "intake_items").select("rfq_id", "line_no", "drawing_ref"), domain(spark, d, "attachments"))


def normalised_requests(spark: SparkSession, d: str) -> DataFrame:
    """NR-18: header fields."""
    return intake.normalise_requests(domain(spark, d, "intake")).select("rfq_id", "currency", "incoterm", F.array_join("requirements", "|").alias("requirements"))


def normalised_lines(spark: SparkSession, d: str) -> DataFrame:
    """NR-18: lines."""
    return intake.normalise_lines(domain(spark, d, "intake_items")).select("rfq_id", "line_no", F.array_join("quantities", ",").alias("quantities"), "notes")


def _got(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"


def _num(x: str) -> str:
    return f"CAST(replace({x}, ',', '.') AS DOUBLE)"


_ZERO = "(fit IS NOT NULL AND coalesce(upper_mm = 0 AND lower_mm = 0, FALSE))"
_IS = lambda x: f"({x} >= '0' AND {x} < ':')"
_AT = lambda cond: f"list_filter(range(1, len(m) + 1), lambda i : {cond})[1]"
_VAL = lambda x: f"TRY_CAST(replace({x}, ',', '.') AS DOUBLE)"
#: Marks of evidence (m) and fit (g), words of evidence (w); then the places of a size, thread, chamfer and pair among the marks.
_REPAIRED = f""", r0 AS (SELECT r.*, shape_class, regexp_extract_all(coalesce(evidence, ''), '{co.MARK}') AS m, regexp_extract_all(coalesce(fit, ''), '{co.MARK}') AS g, list_filter(regexp_split_to_array(coalesce(evidence, ''), '\\s+'), lambda x : x <> '') AS w FROM readings r JOIN views v ON v.drawing = r.drawing),
    r1 AS (SELECT *, {_AT(f"m[i] IN ('Ø', '⌀', 'M') AND {_IS('m[i + 1]')}")} AS at_size, {_AT(f"m[i] = 'M' AND {_IS('m[i + 1]')}")} AS at_thread, {_AT(f"{_IS('m[i]')} AND m[i + 1] IN ('x', '×') AND {_IS('m[i + 2]')} AND {_VAL('m[i + 2]')} = 45")} AS at_chamfer, {_AT(f"{_IS('m[i]')} AND m[i + 1] IN ('x', '×') AND {_IS('m[i + 2]')}")} AS at_pair,
        CASE WHEN w[2] IS NOT NULL AND right(w[1], 1) IN ('x', '×') THEN TRY_CAST(left(w[1], -1) AS INT) WHEN w[3] IS NOT NULL AND w[2] IN ('x', '×') THEN TRY_CAST(w[1] AS INT) END AS times, array_to_string(list_filter(g, lambda x : regexp_matches(x, '[A-Za-z]')), '') AS kind FROM r0),
    r2 AS (SELECT drawing, n, evidence, coalesce(nominal, CASE WHEN ftype = 'chamfer' THEN {_VAL('m[at_chamfer]')} END, {_VAL('m[at_size + 1]')}) AS nominal, len_mm, CASE WHEN qty = 1 THEN coalesce(times, qty) ELSE qty END AS qty, fit, CASE WHEN NOT {_ZERO} THEN upper_mm END AS upper_mm, CASE WHEN NOT {_ZERO} THEN lower_mm END AS lower_mm, ra_um, shape_class,
        CASE WHEN ftype = 'thread' AND coalesce(thread, '') = '' THEN 'M' || m[at_thread + 1] || CASE WHEN m[at_thread + 2] IN ('x', '×') AND {_IS('m[at_thread + 3]')} THEN 'x' || m[at_thread + 3] ELSE '' END ELSE thread END AS thread,
        {_VAL('m[at_pair]')} AS p1, {_VAL('m[at_pair + 2]')} AS p2,
        CASE WHEN ftype IN ('bore', 'hole') AND len(g) = 2 AND upper(g[1]) IN ('N', 'P', 'JS', 'D') AND g[2] IN ('9', '10') AND len(m) > 0 AND NOT list_has_any(m, ['Ø', '⌀']) THEN 'keyway' WHEN ftype IN ('bore', 'hole') AND kind <> '' AND kind = lower(kind) AND shape_class = 'rotational' THEN 'outer_diameter'
            WHEN ftype = 'outer_diameter' AND kind <> '' AND kind = upper(kind) THEN CASE shape_class WHEN 'prismatic' THEN 'hole' ELSE 'bore' END WHEN ftype = 'bore' AND shape_class = 'prismatic' THEN 'hole' ELSE ftype END AS ftype FROM r1),
    r3 AS (SELECT *, coalesce(ftype IN ('pocket', 'slot') AND p1 IS NOT NULL AND (nominal IS NULL OR abs(nominal - greatest(p1, p2)) < 1e-6), FALSE) AS swapped FROM r2),
    rep AS (SELECT drawing, n, ftype, evidence, CASE WHEN swapped THEN least(p1, p2) ELSE nominal END AS nominal, CASE WHEN swapped THEN greatest(p1, p2) ELSE len_mm END AS len_mm, qty, CASE WHEN ftype = 'keyway' THEN upper(fit) ELSE fit END AS fit, upper_mm, lower_mm, ra_um, thread, shape_class FROM r3)"""
_COMPLETE = f""", lo AS (SELECT *, ftype = 'face' AND fit IS NULL AND upper_mm IS NULL AND lower_mm IS NULL AND ra_um IS NULL AS loose FROM rep),
    lack AS (SELECT drawing, max_diameter_mm AS d FROM views WHERE shape_class = 'rotational' AND max_diameter_mm <> 0 AND drawing NOT IN (SELECT l.drawing FROM lo l JOIN views v ON v.drawing = l.drawing WHERE NOT loose AND ftype = 'outer_diameter' AND abs(nominal - max_diameter_mm) <= {dr.NEAR_MM})),
    full0 AS (SELECT drawing, n, ftype, evidence, nominal, len_mm, qty, fit, upper_mm, lower_mm, ra_um, thread FROM lo WHERE NOT loose UNION ALL SELECT drawing, -1, 'outer_diameter', 'envelope', d, NULL, 1, NULL, NULL, NULL, NULL, NULL FROM lack),
    compl AS (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY drawing ORDER BY n) AS INT) AS n) FROM full0)"""
_SC = [_num(_got("scale", dr.SCALE, g)) for g in (1, 2)]
_ENV = f""", sheet AS (SELECT v.*, {dr.SHEET_MM} * coalesce(CASE WHEN {_SC[0]} > 0 THEN {_SC[1]} / {_SC[0]} END, 1.0) AS most FROM views v LEFT JOIN titles t ON t.drawing = v.drawing),
    env AS (SELECT drawing, shape_class, {', '.join(f'CASE WHEN {c} <= most THEN {c} END AS {c}' for c in dr.SIDES)}, {' + '.join(f'coalesce({c} > most, FALSE)::INT' for c in dr.SIDES)} AS n_misread FROM sheet)"""
_MERGED = _REPAIRED + _COMPLETE + _ENV + """, per AS (SELECT drawing, count(*) AS k, bool_or(ftype = 'gear') AS geared FROM compl GROUP BY 1),
    mg AS (SELECT e.*, t.material, t.units, n.gear_module, n.gear_teeth, n.items, t.drawing IS NULL AS no_title, n.drawing IS NULL AS no_notes, coalesce(k, 0) AS k, e.shape_class = 'assembly' OR n.items IS NOT NULL AS built, coalesce(geared, FALSE) AS geared
        FROM env e LEFT JOIN titles t ON t.drawing = e.drawing LEFT JOIN notes n ON n.drawing = e.drawing LEFT JOIN per p ON p.drawing = e.drawing),
    mf AS (SELECT c.* FROM compl c JOIN mg ON mg.drawing = c.drawing WHERE NOT built UNION ALL SELECT drawing, CAST(k + 1 AS INT), 'gear', 'gear data', round(gear_module * gear_teeth + 1e-7, 3), NULL, 1, NULL, NULL, NULL, NULL, NULL FROM mg WHERE NOT built AND gear_module <> 0 AND gear_teeth <> 0 AND NOT geared)"""


def _checked(d: str, f: str) -> str:
    """CTE fragment ck (drawing, warnings list) over drawings d and features f."""
    mark = lambda cond, k: f"CASE WHEN coalesce({cond}, FALSE) THEN 'F' || n || ':{k}' END"
    outer = "coalesce(nullif(max_diameter_mm, 0), greatest(nullif(length_mm, 0), nullif(width_mm, 0), nullif(height_mm, 0)))"
    marks = [mark(c, k) for c, k in ((f"shape_class = 'rotational' AND ftype = 'outer_diameter' AND nullif(nominal, 0) > nullif(max_diameter_mm, 0) * {dr.SLACK}", "size"), (f"ftype IN ('bore', 'hole') AND nullif(nominal, 0) >= {outer}", "hole"), (f"shape_class = 'rotational' AND nullif(len_mm, 0) > nullif(length_mm, 0) * {dr.SLACK}", "length"), ("ftype = 'thread' AND coalesce(thread, '') = ''", "thread"), ("upper_mm < lower_mm", "band"), ("evidence IS NULL", "evidence"))]
    return f""", ck0 AS (SELECT f.drawing, n, list_filter([{', '.join(marks)}], lambda m : m IS NOT NULL) AS m FROM {f} f JOIN (SELECT drawing, shape_class, {', '.join(dr.SIDES)} FROM {d}) e ON e.drawing = f.drawing),
    ck1 AS (SELECT drawing, flatten(list(m ORDER BY n)) AS l FROM ck0 WHERE len(m) > 0 GROUP BY 1),
    ck AS (SELECT e.drawing, list_concat(coalesce(l, []), list_filter([CASE WHEN shape_class = 'assembly' AND items IS NULL THEN 'no parts list' END, CASE WHEN len(list_distinct(string_split(items, ','))) < len(string_split(items, ',')) THEN 'repeated item numbers' END], lambda m : m IS NOT NULL)) AS warnings FROM {d} e LEFT JOIN ck1 ON ck1.drawing = e.drawing)"""


_MM = lambda c: f"CASE WHEN inch THEN round({c} * 25.4 + 1e-7, 4) ELSE {c} END"
_NORMAL = f""", iu AS (SELECT *, coalesce(units = 'inch', FALSE) AS inch FROM mg),
    keys_ AS (SELECT DISTINCT code, ordinal, {norm_sql('key')} AS k FROM material_keys),
    mats AS (SELECT drawing, arg_min(code, o) AS material_code FROM (SELECT i.drawing, ks.code, row(CASE WHEN {norm_sql('material')} = ks.k THEN 0 ELSE 1 END, CASE WHEN {norm_sql('material')} = ks.k THEN 0 ELSE -length(ks.k) END, ordinal) AS o FROM iu i JOIN keys_ ks ON {norm_sql('material')} = ks.k OR (length(ks.k) >= 4 AND contains({norm_sql('material')}, ks.k))) GROUP BY 1),
    d1 AS (SELECT i.drawing, CASE WHEN items IS NOT NULL THEN 'assembly' ELSE shape_class END AS shape_class, items IS NOT NULL AND shape_class <> 'assembly' AS listed, inch, items, material, material_code, {', '.join(f'{_MM(c)} AS {c}' for c in dr.SIDES)} FROM iu i LEFT JOIN mats m ON m.drawing = i.drawing),
    f1 AS (SELECT f.* REPLACE ({_MM('nominal')} AS nominal, {_MM('len_mm')} AS len_mm) FROM mf f JOIN iu ON iu.drawing = f.drawing),
    tt(above, upto, g, um) AS (VALUES {tolerance_values()}),
    cl AS (SELECT drawing, n, arg_min(g, row(abs(um - (upper_mm - lower_mm) * 1000), -g)) AS g FROM f1 JOIN tt ON nominal > above AND nominal <= upto WHERE fit IS NULL AND upper_mm - lower_mm > 0 GROUP BY 1, 2),
    f2 AS (SELECT f.* EXCLUDE (upper_mm, lower_mm), f.upper_mm AS u0, f.lower_mm AS l0, regexp_extract(trim(fit), '^([A-Za-z]{{1,2}})\\s*(\\d{{1,2}})$', 1) AS letters, t.um / 1000 AS mm, coalesce(CAST(nullif(regexp_extract(fit, '([A-Za-z]{{1,2}})\\s*(\\d{{1,2}})', 2), '') AS INT), cl.g) AS grade
        FROM f1 f LEFT JOIN tt t ON f.nominal > t.above AND f.nominal <= t.upto AND t.g = CAST(nullif(regexp_extract(trim(f.fit), '^([A-Za-z]{{1,2}})\\s*(\\d{{1,2}})$', 2), '') AS INT) LEFT JOIN cl ON cl.drawing = f.drawing AND cl.n = f.n),
    f3 AS (SELECT *, CASE WHEN letters = 'H' THEN mm WHEN letters = 'h' THEN mm * 0 WHEN letters IN ('JS', 'js') THEN mm / 2 END AS u1, CASE WHEN letters = 'H' THEN mm * 0 WHEN letters = 'h' THEN -mm WHEN letters IN ('JS', 'js') THEN -mm / 2 END AS l1 FROM f2),
    f4 AS (SELECT *, CASE WHEN u0 IS NULL OR l0 IS NULL THEN coalesce(u1, u0) ELSE u0 END AS upper_mm, CASE WHEN u0 IS NULL OR l0 IS NULL THEN coalesce(l1, l0) ELSE l0 END AS lower_mm FROM f3),
    kn AS (SELECT drawing, max(nullif(nominal, 0)) FILTER (ftype IN ('outer_diameter', 'spline')) AS kd, round(sum(nullif(len_mm, 0)) FILTER (ftype = 'outer_diameter') + 1e-7, 3) AS kl FROM f4 GROUP BY 1),
    d2 AS (SELECT d.* EXCLUDE (max_diameter_mm, length_mm), CASE WHEN shape_class = 'rotational' THEN coalesce(max_diameter_mm, kd) ELSE max_diameter_mm END AS max_diameter_mm, CASE WHEN shape_class = 'rotational' THEN coalesce(length_mm, kl) ELSE length_mm END AS length_mm,
        shape_class = 'rotational' AND max_diameter_mm IS NULL AND kd IS NOT NULL AS from_d, shape_class = 'rotational' AND length_mm IS NULL AND kl IS NOT NULL AS from_l FROM d1 d LEFT JOIN kn ON kn.drawing = d.drawing),
    d3 AS (SELECT *, CASE shape_class WHEN 'rotational' THEN max_diameter_mm IS NULL OR length_mm IS NULL WHEN 'prismatic' THEN length_mm IS NULL OR width_mm IS NULL OR height_mm IS NULL ELSE FALSE END AS incomplete FROM d2)""" + _checked("d3", "f4") + """, gr AS (SELECT drawing, count(grade) AS n_graded, round(sum(upper_mm) + 1e-7, 3) AS upper_sum FROM f4 GROUP BY 1),
    normal AS (SELECT d.drawing, shape_class, items, width_mm, height_mm, material_code, round(max_diameter_mm + 1e-7, 4) AS max_diameter_mm, round(length_mm + 1e-7, 4) AS length_mm, coalesce(n_graded, 0) AS n_graded, upper_sum,
        list_filter(list_concat([CASE WHEN inch THEN 'inches converted' END, CASE WHEN listed THEN 'set to assembly' END, CASE WHEN material IS NOT NULL AND material_code IS NULL AND shape_class <> 'assembly' THEN 'material not found' END, CASE WHEN material IS NULL AND shape_class <> 'assembly' THEN 'no material' END,
            CASE WHEN from_d THEN 'diameter derived' END, CASE WHEN from_l THEN 'length derived' END, CASE WHEN incomplete THEN 'envelope incomplete' END], ck.warnings), lambda m : m IS NOT NULL) AS warnings FROM d3 d JOIN ck ON ck.drawing = d.drawing LEFT JOIN gr ON gr.drawing = d.drawing)"""
#: What the drawings of requests look like once read, merged and normalised: (normal, f4).
READ = _MERGED + _NORMAL
_KEY = "regexp_replace(lower(regexp_replace({0}, '\\.[A-Za-z0-9]+$', '')), '[^a-z0-9]', '', 'g')"
_READ = ctes("readings", "views")
READ_TABLES = ("readings", "views", "titles", "notes", "material_keys")
_ALL = ctes("readings", "views", "titles", "notes")

QUERIES = {f.__name__: f for f in (repaired_features, completed_features, feature_repairs, plausible_envelopes, merged_drawings, rejected_drawings, drawing_checks, normalised_drawings, matched_attachments, normalised_requests, normalised_lines)}
ORACLES = {
    "repaired_features": _READ + _REPAIRED + f" SELECT {', '.join(FEATURE)} FROM rep",
    "completed_features": _READ + _REPAIRED + _COMPLETE + " SELECT drawing, n, ftype, nominal FROM compl",
    "feature_repairs": _READ + _REPAIRED + _COMPLETE + " SELECT v.drawing, coalesce(k, 0) AS n_dropped, v.drawing IN (SELECT drawing FROM lack) AS added FROM views v LEFT JOIN (SELECT drawing, count(*) FILTER (loose) AS k FROM lo GROUP BY 1) x ON x.drawing = v.drawing",
    "plausible_envelopes": ctes("views", "titles") + _ENV + " SELECT * FROM env",
    "merged_drawings": _ALL + _MERGED + " SELECT mg.drawing, shape_class, no_title, no_notes, CASE WHEN built THEN k ELSE 0 END AS n_ignored, coalesce(c, 0) AS n_features, gear_mm FROM mg LEFT JOIN (SELECT drawing, count(*) AS c, max(nominal) FILTER (evidence = 'gear data') AS gear_mm FROM mf GROUP BY 1) x ON x.drawing = mg.drawing",
    "rejected_drawings": ctes("views", "titles", "notes") + " SELECT drawing FROM (SELECT drawing FROM titles UNION SELECT drawing FROM notes) WHERE drawing NOT IN (SELECT drawing FROM views)",
    "drawing_checks": _ALL + _MERGED + _checked("mg", "mf") + " SELECT drawing, array_to_string(warnings, ',') AS warnings FROM ck",
    "normalised_drawings": ctes(*READ_TABLES) + READ + " SELECT drawing, shape_class, material_code, max_diameter_mm, length_mm, n_graded, upper_sum, array_to_string(warnings, ',') AS warnings FROM normal",
    "matched_attachments": ctes("intake_items", "attachments") + f""", x AS (SELECT i.rfq_id, line_no, file, {_KEY.format('drawing_ref')} AS r, {_KEY.format('file')} AS k FROM intake_items i JOIN attachments a ON a.rfq_id = i.rfq_id WHERE {_KEY.format('drawing_ref')} <> ''),
        b AS (SELECT rfq_id, line_no, min(file) FILTER (r = k) AS same, min(file) FILTER (contains(r, k) OR contains(k, r)) AS one, count(*) FILTER (contains(r, k) OR contains(k, r)) AS n FROM x GROUP BY 1, 2)
        SELECT i.rfq_id, i.line_no, drawing_ref, coalesce(same, CASE WHEN n = 1 THEN one END) AS file FROM intake_items i LEFT JOIN b ON b.rfq_id = i.rfq_id AND b.line_no = i.line_no""",
    "normalised_requests": ctes("intake") + """, t AS (SELECT rfq_id, upper(coalesce(nullif(trim(currency), ''), 'EUR')) AS currency, nullif(string_split(upper(trim(incoterm)), ' ')[1], '') AS incoterm, requirements FROM intake)
        SELECT rfq_id, currency, incoterm, array_to_string(list_filter(string_split(requirements, '|'), lambda r : incoterm IS NULL OR NOT list_contains(regexp_split_to_array(upper(r), '[^A-Z0-9_]+'), incoterm)), '|') AS requirements FROM t""",
    "normalised_lines": ctes("intake_items") + """ SELECT rfq_id, CAST(row_number() OVER (PARTITION BY rfq_id ORDER BY line_no) AS INT) AS line_no, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(quantities, ','), lambda q : TRY_CAST(q AS INT)), lambda q : q > 0))), ',') AS quantities, nullif(trim(notes), '') AS notes FROM intake_items""",
}
ORACLES = {k: doubles(v) for k, v in ORACLES.items()}
