"""Queries on names, parts lists, calibrated operations, comparisons and the call stream, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderline.operators import matching, operations as op
from tenderline.operators import routing
from tenderline.plans import engineering as eng, quoting
from tenderline.plans.quoting import rounded
from tenderline.plans.reporting import _points
from tenderline.sources import scratch
from tenderline.sources.adapters import ctes, domain, doubles
from tenderline.streaming import arrivals, calls as stream

FIELDS = ["nominal", "band"]
PLACEHOLDER = "Tion"


def resolved_materials(spark: SparkSession, d: str) -> DataFrame:
    """NR-01, NR-02."""
    return matching.resolve_materials(domain(spark, d, "callouts"), domain(spark, d, "material_keys")).select("id", "text", "code")


def calibrated_operations(spark: SparkSession, d: str) -> DataFrame:
    """RT-17: rule operations blended with those recorded for the most similar part."""
    return _calibrated(spark, d).select("part_id", "op_code", "work_center", "service_code", "cycle_min", "basis", "suggested", "confidence")


def _calibrated(spark: SparkSession, d: str) -> DataFrame:
    ops = routing.rule_routing(eng._context(spark, d))
    top = quoting._similar(spark, d).where("rank = 1").select(F.col("query_id").alias("part_id"), F.col("part_id").alias("ref_part_id"), "score")
    return scratch.once(spark, d, "calibrated", lambda: matching.calibrate(ops, top, domain(spark, d, "recorded"), eng._measured(spark, d)))


def edit_diff(spark: SparkSession, d: str) -> DataFrame:
    """FB-03."""
    c = F.col
    after = lambda name: F.when(~c("removed"), c(name))
    fields = {"setup_min": (c("before_setup"), after("after_setup")), "cycle_min": (c("before_cycle"), after("after_cycle"))}
    return matching.changes(domain(spark, d, "edited"), ["rfq_id", "line_no", "seq"], fields).withColumns({k: rounded(k) for k in ("before", "after")})


def extraction_scores(spark: SparkSession, d: str) -> DataFrame:
    """EV-08, EV-12."""
    out = matching.score_rows(domain(spark, d, "predicted"), domain(spark, d, "gold"), ["drawing", "n"], FIELDS, ["ftype"])
    return out.withColumn("field_share", rounded("field_share"))


def extraction_diff(spark: SparkSession, d: str) -> DataFrame:
    """EV-13."""
    return matching.run_diff(domain(spark, d, "predicted"), domain(spark, d, "gold"), ["drawing", "n"], FIELDS)


def stale_drawings(spark: SparkSession, d: str) -> DataFrame:
    """EV-15."""
    return matching.stale(domain(spark, d, "gold"), domain(spark, d, "predicted"), ["drawing", "n"])


def repeated_calls(spark: SparkSession, d: str) -> DataFrame:
    """IO-08."""
    return matching.repeated_calls(domain(spark, d, "calls"), ["node", "tokens_in", "attempts"])


def prose_check(spark: SparkSession, d: str) -> DataFrame:
    """OP-07 over the conversation texts."""
    return matching.prose_guard(domain(spark, d, "conversations"), PLACEHOLDER, allow_lists=False).select("conv_id", "turn", "reason")


def next_versions(spark: SparkSession, d: str) -> DataFrame:
    """OP-06."""
    return matching.next_versions(domain(spark, d, "requests"), domain(spark, d, "quotes"))


def error_boxes(spark: SparkSession, d: str) -> DataFrame:
    """EV-17."""
    return op.error_boxes(_points(spark, d), "plant").withColumns({c: rounded(c) for c in ("q1", "q2", "q3")})


def stream_calls(spark: SparkSession, d: str) -> DataFrame:
    """ST-02: the event log in parts, a run of the stream for each; calls whose window the watermark has passed are dropped."""
    log, at, state = domain(spark, d, "events"), scratch.folder(spark, "log"), scratch.folder(spark, "calls")
    rows = log.select("event_id", "ts", F.col("event_type").alias("node"), F.floor(F.col("value") * 10).alias("latency_ms"), (F.col("event_id") % 17 != 0).alias("ok")).withColumn("part", arrivals.part_of(log, F.col("event_id"), F.col("ts")))
    run = lambda: stream.drain(stream.windowed_calls(spark.readStream.schema(rows.drop("part").schema).parquet(at)), ["start", "node"], state)
    *_, out = arrivals.replay({at: rows}, run)
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


#: Events with the part in which each arrives.
ARRIVALS = "ev AS (SELECT *, CAST(least((datediff('day', (SELECT min(ts) FROM events), ts) + CASE event_id % 13 WHEN 5 THEN 10 WHEN 7 THEN 3 ELSE 0 END) // 7, 4) AS INT) AS part FROM events)"
_norm = quoting.norm_sql
_CAL_TABLES = ("parts", "features", "specs", "materials", "bom", "recorded")
_POINTS = ctes("history", "part_costs") + ", e AS (SELECT plant, unit_price / unit_cost - 1 AS e, (unit_price - unit_cost) / unit_cost AS err FROM history JOIN part_costs USING (part_id, plant, qty) WHERE unit_cost <> 0)"
#: Needs the fragments of similar parts and routing before it.
CAL_TAIL = f""", fired AS ({eng._FIRED}), ops_ AS (SELECT part_id, k, op_code, work_center, service_code, setup_min, cycle_min, round(cf + 1e-9, 3) AS confidence FROM fired),
    best AS (SELECT t.query_id AS part_id, t.part_id AS ref, score, round(score * score + 1e-9, 4) AS w, CASE WHEN a.envelope_cm3 > 0 AND b.envelope_cm3 > 0 THEN pow(a.envelope_cm3 / b.envelope_cm3, 2.0 / 3) ELSE 1.0 END AS scale FROM top t JOIN measured a ON a.part_id = t.query_id JOIN measured b ON b.part_id = t.part_id WHERE rank = 1 AND score >= 0.6),
    tk AS (SELECT b.part_id, CAST(o.seq AS BIGINT) AS k, o.op_code, o.work_center, o.service_code, o.setup_min, o.cycle_min AS cycle FROM best b JOIN recorded o ON o.part_id = b.ref),
    both_ AS (SELECT part_id, ms, ts FROM (SELECT part_id, list(struct_pack(k := CAST(k AS BIGINT), o := op_code, c := work_center, s := service_code) ORDER BY k) AS ms FROM ops_ GROUP BY 1) JOIN (SELECT part_id, list(struct_pack(k := k, o := op_code, c := work_center, s := service_code) ORDER BY k) AS ts FROM tk GROUP BY 1) USING (part_id)),
    greedy(part_id, pos, used, hits, ms, ts) AS (SELECT part_id, 0::BIGINT, []::BIGINT[], []::BIGINT[], ms, ts FROM both_
        UNION ALL SELECT part_id, pos + 1, list_append(used, coalesce(h, -1)), list_append(hits, h), ms, ts FROM (SELECT *, CASE WHEN ms[pos + 1].s IS NOT NULL THEN list_filter(ts, lambda r : NOT list_contains(used, r.k) AND r.s = ms[pos + 1].s)[1].k
            ELSE coalesce(list_filter(ts, lambda r : NOT list_contains(used, r.k) AND r.c = ms[pos + 1].c AND r.o = ms[pos + 1].o)[1].k, list_filter(ts, lambda r : NOT list_contains(used, r.k) AND r.c = ms[pos + 1].c AND coalesce(r.s, '') = '')[1].k) END AS h FROM greedy WHERE pos < len(ms))),
    pairs2 AS (SELECT * FROM (SELECT part_id, unnest(list_transform(ms, lambda m : m.k)) AS k, unnest(hits) AS rk FROM greedy WHERE pos = len(ms)) WHERE rk IS NOT NULL),
    cal AS (SELECT o.part_id, o.op_code, o.work_center, o.service_code, o.setup_min, CASE WHEN t.k IS NOT NULL AND o.service_code IS NULL THEN round(w * t.cycle * scale + (1 - w) * o.cycle_min + 1e-7, 2) ELSE o.cycle_min END AS cycle_min, CASE WHEN t.k IS NOT NULL AND o.service_code IS NULL THEN 'blend' ELSE 'rule' END AS basis, FALSE AS suggested,
            CASE WHEN t.k IS NOT NULL AND o.service_code IS NULL THEN round(least(0.95, confidence + 0.25 * w) + 1e-9, 3) ELSE confidence END AS confidence FROM ops_ o LEFT JOIN pairs2 p ON p.part_id = o.part_id AND p.k = o.k LEFT JOIN tk t ON t.part_id = o.part_id AND t.k = p.rk LEFT JOIN best b ON b.part_id = o.part_id
        UNION ALL SELECT t.part_id, t.op_code, CASE WHEN t.service_code IS NOT NULL THEN 'OUTSOURCED' ELSE t.work_center END, t.service_code, CASE WHEN t.service_code IS NOT NULL THEN 0.0 ELSE round(t.setup_min + 1e-7, 2) END, CASE WHEN t.service_code IS NOT NULL THEN 0.0 ELSE round(t.cycle * scale + 1e-7, 2) END, 'blend', TRUE, round(0.6 * score + 1e-9, 3) FROM tk t JOIN best b ON b.part_id = t.part_id WHERE (t.part_id, t.k) NOT IN (SELECT (part_id, rk) FROM pairs2))"""
CALIBRATED = quoting._SIM_BODY + eng._ROUTED + CAL_TAIL
QUERIES = {f.__name__: f for f in (resolved_materials, calibrated_operations, edit_diff, extraction_scores, extraction_diff, stale_drawings, repeated_calls, prose_check, next_versions, error_boxes, stream_calls)}
ORACLES = {
    "resolved_materials": ctes("callouts", "material_keys") + f""", ks AS (SELECT DISTINCT code, ordinal, {_norm('key')} AS k FROM material_keys), m AS (SELECT id, text, code, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN t = k THEN 0 ELSE 1 END, CASE WHEN t = k THEN 0 ELSE -length(k) END, ordinal) AS r
        FROM (SELECT *, {_norm('text')} AS t FROM callouts) c LEFT JOIN ks ON t = k OR (length(k) >= 4 AND contains(t, k))) SELECT id, text, code FROM m WHERE r = 1""",
    "calibrated_operations": (ctes(*_CAL_TABLES) + CALIBRATED).replace("WITH ", "WITH RECURSIVE ", 1) + " SELECT part_id, op_code, work_center, service_code, cycle_min, basis, suggested, confidence FROM cal",
    "edit_diff": ctes("edited") + """, c AS (SELECT rfq_id, line_no, seq, 'setup_min' AS path, before_setup AS b, CASE WHEN NOT removed THEN after_setup END AS a FROM edited UNION ALL SELECT rfq_id, line_no, seq, 'cycle_min', before_cycle, CASE WHEN NOT removed THEN after_cycle END FROM edited)
        SELECT rfq_id, line_no, seq, path, round(b + 1e-7, 4) AS before, round(a + 1e-7, 4) AS after FROM c WHERE a IS DISTINCT FROM b""",
    "extraction_scores": ctes("predicted", "gold") + """, x AS (SELECT g.ftype, p.n IS NOT NULL AS found, (p.n IS NOT NULL AND p.nominal IS NOT DISTINCT FROM g.nominal)::INT + (p.n IS NOT NULL AND p.band IS NOT DISTINCT FROM g.band)::INT AS ok FROM gold g LEFT JOIN predicted p ON p.drawing = g.drawing AND p.n = g.n)
        SELECT ftype, count(*) AS n_rows, count(*) FILTER (found) AS n_found, count(*) FILTER (ok = 2) AS n_full, sum(ok)::BIGINT AS n_fields, round(sum(ok) / (count(*) * 2) + 1e-7, 4) AS field_share FROM x GROUP BY 1""",
    "extraction_diff": ctes("predicted", "gold") + " SELECT coalesce(a.drawing, b.drawing) AS drawing, coalesce(a.n, b.n) AS n, a.nominal AS nominal_a, a.band AS band_a, b.nominal AS nominal_b, b.band AS band_b FROM predicted a FULL JOIN gold b ON a.drawing = b.drawing AND a.n = b.n WHERE a.n IS NULL OR b.n IS NULL OR a.nominal IS DISTINCT FROM b.nominal OR a.band IS DISTINCT FROM b.band",
    "stale_drawings": ctes("predicted", "gold") + " SELECT drawing, n FROM gold EXCEPT SELECT drawing, n FROM predicted",
    "repeated_calls": ctes("calls") + " SELECT sha256('attempts=' || attempts || '|node=' || node || '|tokens_in=' || tokens_in) AS content_key, count(*) AS n_calls, min(id) AS first_id FROM calls GROUP BY 1 HAVING count(*) > 1",
    "prose_check": f"""WITH x AS (SELECT conv_id, turn, coalesce(text, '') AS t, replace(coalesce(text, ''), '{PLACEHOLDER}', '') AS bare FROM conversations) SELECT conv_id, turn, CASE WHEN length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) < 40 THEN 'too short' WHEN length(t) > 3000 THEN 'too long'
        WHEN length(t) - length(bare) <> {len(PLACEHOLDER)} THEN 'placeholder not there exactly once' WHEN regexp_matches(t, '{matching.CURRENCY}') THEN 'currency amount' WHEN regexp_matches(bare, '{matching.LIST_ITEM}') THEN 'list items' END AS reason FROM x""",
    "next_versions": ctes("requests", "quotes") + " SELECT r.rfq_id, CAST(coalesce(v + 1, 1) AS BIGINT) AS version, 'Q-' || r.rfq_id || '-v' || coalesce(v + 1, 1) AS quote_id, CAST(issued + 30 AS DATE) AS valid_until FROM requests r LEFT JOIN (SELECT rfq_id, max(version) AS v FROM quotes GROUP BY 1) USING (rfq_id)",
    "error_boxes": _POINTS + " SELECT plant, round(quantile_cont(err, 0.25) + 1e-7, 4) AS q1, round(quantile_cont(err, 0.5) + 1e-7, 4) AS q2, round(quantile_cont(err, 0.75) + 1e-7, 4) AS q3 FROM e GROUP BY 1",
    "stream_calls": f"""WITH {ARRIVALS}, top AS (SELECT part, max(ts) AS ts FROM ev GROUP BY 1), kept AS (SELECT e.* FROM ev e LEFT JOIN (SELECT e.part, max(t.ts) - INTERVAL 7 DAY AS mark FROM (SELECT DISTINCT part FROM ev) e JOIN top t ON t.part < e.part GROUP BY 1) w ON w.part = e.part WHERE w.mark IS NULL OR date_trunc('day', e.ts) + INTERVAL 1 DAY > w.mark)
        SELECT strftime(ts, '%Y-%m-%d') AS start, event_type AS node, count(*) AS n_calls, sum(floor(value * 10)::BIGINT)::BIGINT AS latency_ms, max(floor(value * 10)::BIGINT) AS max_ms, count(*) FILTER (event_id % 17 = 0) AS n_failed FROM kept GROUP BY 1, 2""",
}
ORACLES = {k: doubles(v) if k not in ("prose_check",) else v for k, v in ORACLES.items()}
