"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenderline.llm import conversations, decontaminate, jaccard, language, lines, merkle, neardup, neighbours, pieces, quality, sharding, suffixes, toxicity

from tenderline.llm.storage import reachable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 50 = 0"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup_lines(_table(spark, sf_dir, "documents"), maximal=True))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.dedup_substrings(_table(spark, sf_dir, "documents")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.encode(_table(spark, sf_dir, "documents")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digest(_table(spark, sf_dir, "conversations"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(_table(spark, sf_dir, "documents"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_decontaminate, op3_toxicity, op4_sharding, op5_language, op6_neighbours, op7_line_dedup, op8_near_dedup, op9_suffix_dedup, op10_sentencepiece, op11_conversation_repair, op12_merkle, op13_jaccard_join)
}

WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: CRC-32 of a short ASCII text, bit by bit.
CRC = "xor(list_reduce(list_transform(range(1, strlen({0}) + 1), lambda p : ascii(substr({0}, p, 1))::BIGINT), lambda acc, b : list_reduce(range(8)::BIGINT[], lambda c, k : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(acc, b)), 4294967295::BIGINT), 4294967295::BIGINT)"


def _merkle_sql() -> str:
    """Trees level by level, in joins: up to 8 levels in a language and 3 above."""
    mark = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(mark(c) for c in (*merkle.FIELDS[:-1], text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = f"""WITH langs AS (SELECT l, row_number() OVER (ORDER BY l IS NOT NULL, encode(l)) - 1 AS t FROM (SELECT DISTINCT lang AS l FROM documents)),
        d AS (SELECT doc_id, t, {leaf("text")} AS leaf, CASE WHEN {CRC.format("doc_id::VARCHAR")} % 3 = 0 THEN {leaf(lower)} END AS changed FROM documents JOIN langs ON lang IS NOT DISTINCT FROM l),
        a0 AS (SELECT doc_id, leaf, coalesce(changed, leaf) AS f, t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, '' AS proof FROM d),
        l0 AS (SELECT t, i, leaf AS h FROM a0)"""

    def level(k: int, l: str, a: str, nl: str, na: str) -> str:  # noqa: E741
        return f""", c{k} AS (SELECT t, count(*) AS n FROM {l} GROUP BY t), r{k} AS (SELECT t, i // 8 AS run, list(h ORDER BY i) AS hs FROM {l} JOIN c{k} USING (t) WHERE n > 1 GROUP BY 1, 2),
        {nl} AS (SELECT t, run AS i, sha256(array_to_string(hs, '')) AS h FROM r{k} UNION ALL SELECT t, i, h FROM {l} JOIN c{k} USING (t) WHERE n = 1),
        {na} AS (SELECT a.doc_id, a.leaf, a.t, CASE WHEN hs IS NULL THEN i ELSE i // 8 END AS i,
            CASE WHEN hs IS NULL THEN f ELSE sha256(array_to_string(list_concat(list_concat(hs[1:i % 8], [f]), hs[i % 8 + 2:]), '')) END AS f,
            CASE WHEN hs IS NULL THEN proof ELSE proof || array_to_string(list_concat(hs[1:i % 8], hs[i % 8 + 2:]), '') END AS proof{{extra}} FROM {a} a LEFT JOIN r{k} r ON r.t = a.t AND r.run = a.i // 8)"""

    for k in range(8):
        sql += level(k, f"l{k}", f"a{k}", f"l{k + 1}", f"a{k + 1}").format(extra="")
    sql += ", l9 AS (SELECT 0 AS t, t AS i, h FROM l8), a9 AS (SELECT doc_id, leaf, 0 AS t, a.t AS i, f, proof, h AS subroot FROM a8 a JOIN l8 USING (t))"
    for k in range(9, 12):
        sql += level(k, f"l{k}", f"a{k}", f"l{k + 1}", f"a{k + 1}").format(extra=", subroot")
    return sql + " SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM a12, l12"


def _repair_sql() -> str:
    """A recursion over the rows of all conversations at once, which keeps the best letters of each of the four states (0 nothing, 1 system, 2 user, 3 assistant)."""
    after = {(0, "u"): 2, (0, "s"): 1, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    steps = []
    for start in range(4):
        state = start
        for n in range(3):
            steps += [(start, "I" * n, "D", "", state, 2 * n + 3)]
            steps += [(start, "I" * n, "K", role, end, 2 * n) for (s, role), end in after.items() if s == state]
            steps += [(start, "I" * n, "R", "", end, 2 * n + 2) for (s, role), end in after.items() if s == state and role != "s"]
            state = next(end for (s, role), end in after.items() if s == state and role != "s")
    values = ", ".join(f"({a}, '{i}', '{e}', '{r}', {b}, {c})" for a, i, e, r, b, c in steps)
    solid, blank = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
    return f"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        hurt AS (SELECT *, {CRC.format("k")} % 20 AS w FROM raw),
        damaged AS (SELECT conv_id, turn, CASE WHEN w = 4 THEN 'user' ELSE role END AS role, CASE w WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM hurt, unnest(range(CASE WHEN w = 3 THEN 2 ELSE 1 END)) AS t(c) WHERE w <> 0),
        convs AS (SELECT row_number() OVER () AS g, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
        placed AS (SELECT g, turn, role, text, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged d JOIN convs c ON c.conv_id IS NOT DISTINCT FROM d.conv_id),
        faulty AS (SELECT *, substr(role, 1, 1) AS i, CASE WHEN NOT regexp_matches(text, '{solid}') THEN 1 WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY k) > 1 THEN 2
            WHEN regexp_extract(text, '({solid}){blank}*$', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(substr(role, 1, 1)) OVER (PARTITION BY g ORDER BY k) AS before FROM placed),
        steps(a, ins, edit, own, b, price) AS (VALUES {values}),
        search(g, k, state, cost, audit) AS (SELECT g, 0::BIGINT, 0, 0::BIGINT, '' FROM convs
            UNION ALL SELECT g, k, b, cost, audit FROM (SELECT x.*, row_number() OVER (PARTITION BY g, b ORDER BY cost, audit) AS r FROM (
                SELECT s.g, f.k, t.b, s.cost + t.price + CASE WHEN fault = 3 AND edit <> 'D' THEN 1 ELSE 0 END AS cost, s.audit || ins || edit AS audit
                FROM search s JOIN faulty f ON f.g = s.g AND f.k = s.k + 1 JOIN steps t ON t.a = s.state AND (edit = 'D' OR fault NOT IN (1, 2)) AND (edit <> 'K' OR own = f.i)) x) WHERE r = 1),
        done AS (SELECT g, s.cost + 2 * e.n AS cost, s.audit || repeat('I', e.n) AS audit, row_number() OVER (PARTITION BY g ORDER BY s.cost + 2 * e.n, s.audit || repeat('I', e.n)) AS r
            FROM search s JOIN (VALUES (0, 0), (1, 2), (2, 1), (3, 0)) e(st, n) ON e.st = s.state JOIN (SELECT g AS gg, max(k) AS last FROM search GROUP BY 1) z ON z.gg = s.g AND s.k = z.last),
        letters AS (SELECT g, p, substr(audit, p, 1) AS edit FROM done, unnest(range(1, strlen(audit) + 1)) AS t(p) WHERE r = 1),
        spots AS (SELECT g, p, edit, count(*) FILTER (edit <> 'I') OVER w AS k, count(*) FILTER (edit <> 'D') OVER w AS o FROM letters WINDOW w AS (PARTITION BY g ORDER BY p)),
        written AS (SELECT s.g, p, o, edit, f.role, f.text, f.i FROM spots s LEFT JOIN faulty f ON f.g = s.g AND f.k = s.k AND edit <> 'I' WHERE edit <> 'D'),
        led AS (SELECT g, bool_or(o = 1 AND edit = 'K' AND i = 's')::INT AS lead FROM written GROUP BY 1),
        repaired AS (SELECT g, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS t FROM written JOIN led USING (g) GROUP BY 1),
        counts AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
            count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY 1)
        SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
        FROM convs LEFT JOIN counts USING (g) LEFT JOIN done ON done.g = convs.g AND r = 1 LEFT JOIN repaired ON repaired.g = convs.g"""


ORACLES: dict[str, str] = {
    "op11_conversation_repair": _repair_sql(),
    "op12_merkle": _merkle_sql(),
    "op2_decontaminate": f"""
        WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
        b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
            FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
        ngram AS (
            SELECT doc_id, l.n, i, array_to_string(w[i:i + l.n - 1], ' ') AS s
            FROM d, (SELECT DISTINCT n FROM win) AS l, unnest(range(1, len(w) - l.n + 2)) AS t(i)),
        hit AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM ngram AS g JOIN win ON g.n = win.n AND g.s = win.s),
        cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) AS x GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
