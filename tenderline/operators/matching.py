"""Resolving names, pricing parts lists, blending operations with recorded ones, and comparing versions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderline.functions.expressions import norm_token
from tenderline.params import DEFAULT, Params

#: Least length of a key that may be found inside a text.
MIN_KEY = 4
# fixed values: signs and codes of currencies
CURRENCY_SIGNS, CURRENCY_CODES = "€$£", ("eur", "euro", "usd", "pln", "cny", "rmb")
_MONEY = rf"(?:[{CURRENCY_SIGNS}]|\b(?:{'|'.join(CURRENCY_CODES)})s?\b)"
#: An amount: a number with a currency before or after it. A list item: a line that a bullet or a number with a point or bracket opens.
CURRENCY = rf"(?i){_MONEY} ?\d|\d[.,-]* ?{_MONEY}"
LIST_ITEM = r"(?m)^[ \t]*(?:[•*-]|\d{1,3}[.)])[ \t]+[^ \t]"
MIN_PROSE, MAX_PROSE = 40, 3000


def resolve_materials(callouts: DataFrame, keys: DataFrame) -> DataFrame:
    """NR-02: callouts (id, text) with the code of the key that equals the text, first by ordinal; else of the longest
    key (MIN_KEY characters at least) inside it; else null. Keys: code, key, ordinal.

    Texts are resolved once each, however many rows share one. Both joins are on equal values: the whole text, and for keys inside
    it their first MIN_KEY characters, which must be one of the text's pieces of that length.
    """
    k = keys.select("code", "ordinal", norm_token(F.col("key")).alias("k")).where("k <> ''").distinct()
    texts = callouts.select("text").where("text is not null").distinct().withColumn("t", norm_token(F.col("text")))
    exact = texts.join(k.withColumnRenamed("k", "t"), "t").groupBy("text").agg(F.min_by("code", "ordinal").alias("exact"))
    rest = texts.join(exact.select("text"), "text", "left_anti").where(F.length("t") >= MIN_KEY)
    within = pieces_of(rest, "t", MIN_KEY).join(k.where(F.length("k") >= MIN_KEY).withColumn("piece", F.substring("k", 1, MIN_KEY)), "piece").where(F.contains("t", "k"))
    inside = within.groupBy("text").agg(F.min_by("code", F.struct(-F.length("k"), "ordinal")).alias("inside"))
    return callouts.join(exact, "text", "left").join(inside, "text", "left").withColumn("code", F.coalesce("exact", "inside")).drop("exact", "inside")


def pieces_of(rows: DataFrame, column: str, n: int) -> DataFrame:
    """rows once for each different `piece` of n characters of the column."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(column) - n + 1, F.lit(1)))
    return rows.withColumn("piece", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(column), i, F.lit(n))))))


def assign(ops: DataFrame, recorded: DataFrame) -> DataFrame:
    """Which recorded operation each operation of a part takes: part_id, seq, ref_seq, one row for each that finds one.

    Operations choose in their order, each among what those before it have left: an outsourced one the first of the same service; any other the first of the same centre and operation, else the
    first of the same centre that is not outsourced. A part's operations are few, so both lists of a part are one row, and the choice is a fold over them that carries what is used.
    """
    fields = ("op_code", "work_center", "service_code")
    listed = lambda df, name: df.groupBy("part_id").agg(F.array_sort(F.collect_list(F.struct("seq", *fields))).alias(name))
    both = listed(ops.withColumn("seq", F.col("seq").cast("long")), "mine").join(listed(recorded.withColumn("seq", F.col("seq").cast("long")), "theirs"), "part_id")

    def choose(acc: Column, op: Column) -> Column:
        free = F.filter("theirs", lambda r: ~F.array_contains(acc["used"], r["seq"]))
        first = lambda fits: F.get(F.filter(free, fits), F.lit(0))["seq"]
        centre = lambda r: F.coalesce(r["work_center"] == op["work_center"], F.lit(False))
        same = first(lambda r: F.coalesce(r["service_code"] == op["service_code"], F.lit(False)))
        alike = first(lambda r: centre(r) & F.coalesce(r["op_code"] == op["op_code"], F.lit(False)))
        near = first(lambda r: centre(r) & (F.coalesce(r["service_code"], F.lit("")) == ""))
        hit = F.when(op["service_code"].isNotNull(), same).otherwise(F.coalesce(alike, near))
        pair = F.array(F.struct(op["seq"].alias("seq"), hit.alias("ref_seq")))
        return F.when(hit.isNull(), acc).otherwise(F.struct(F.array_append(acc["used"], hit).alias("used"), F.concat(acc["pairs"], pair).alias("pairs")))

    none = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<seq: bigint, ref_seq: bigint>>").alias("pairs"))
    return both.select("part_id", F.explode(F.aggregate("mine", none, choose)["pairs"]).alias("p")).select("part_id", "p.*")


def calibrate(ops: DataFrame, top: DataFrame, recorded: DataFrame, volumes: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """RT-17: rule operations blended with the recorded ones of the most similar part, and its other operations as suggestions.

    top: part_id, ref_part_id, score (one row a part; below min_blend no effect). The weight is the squared score, recorded
    times scale with volume to 2/3. Which recorded operation an operation takes: assign().
    """
    v = volumes.select("part_id", "envelope_cm3")
    t = top.where(F.col("score") >= params.min_blend).join(v, "part_id", "left").join(v.toDF("ref_part_id", "ref_cm3"), "ref_part_id", "left")
    scale = F.when((F.col("envelope_cm3") > 0) & (F.col("ref_cm3") > 0), F.pow(F.col("envelope_cm3") / F.col("ref_cm3"), F.lit(2 / 3))).otherwise(1.0)
    t = t.select("part_id", "ref_part_id", "score", F.round(F.col("score") * F.col("score") + 1e-9, 4).alias("w"), scale.alias("scale"))
    refs = t.select("part_id", "ref_part_id").join(recorded.withColumnRenamed("part_id", "ref_part_id"), "ref_part_id")
    pairs = assign(ops, refs)
    theirs = refs.select("part_id", F.col("seq").cast("long").alias("ref_seq"), *[F.col(c).alias(f"ref_{c}") for c in ("op_code", "work_center", "service_code", "setup_min", "cycle_min")])
    mine = ops.withColumn("seq", F.col("seq").cast("long")).join(pairs, ["part_id", "seq"], "left").drop("seq")
    # operations with what they took, and what nobody took: one full join
    x = mine.join(theirs, ["part_id", "ref_seq"], "full_outer").drop("ref_seq").join(t, "part_id", "left")
    blended = F.col("op_code").isNotNull() & F.col("ref_op_code").isNotNull() & F.col("service_code").isNull() & F.col("w").isNotNull()
    extra, serviced = F.col("op_code").isNull(), F.col("ref_service_code").isNotNull()
    cycle = F.when(extra & serviced, 0.0).when(extra, F.round(F.col("ref_cycle_min") * F.col("scale") + 1e-7, 2)).when(blended, F.round(F.col("w") * F.col("ref_cycle_min") * F.col("scale") + (1 - F.col("w")) * F.col("cycle_min") + 1e-7, 2)).otherwise(F.col("cycle_min"))
    sure = F.when(extra, F.round(0.6 * F.col("score") + 1e-9, 3)).when(blended, F.round(F.least(F.lit(0.95), F.col("confidence") + 0.25 * F.col("w")) + 1e-9, 3)).otherwise(F.col("confidence"))
    return x.select(
        "part_id", F.coalesce("op_code", "ref_op_code").alias("op_code"), F.when(extra & serviced, "OUTSOURCED").otherwise(F.coalesce("work_center", "ref_work_center")).alias("work_center"),
        F.when(extra, F.col("ref_service_code")).otherwise(F.col("service_code")).alias("service_code"), F.when(extra & serviced, 0.0).when(extra, F.round(F.col("ref_setup_min") + 1e-7, 2)).otherwise(F.col("setup_min")).alias("setup_min"), cycle.alias("cycle_min"), F.when(blended | extra, "blend").otherwise("rule").alias("basis"), extra.alias("suggested"), sure.alias("confidence"),
    )


def changes(rows: DataFrame, keys: list[str], fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """FB-03: one row for each field that differs (nulls are equal): keys, path, before, after."""
    cells = F.array(*[F.struct(F.lit(name).alias("path"), a.cast("double").alias("before"), b.cast("double").alias("after")) for name, (a, b) in fields.items()])
    return rows.select(*keys, F.explode(F.filter(cells, lambda c: ~c["before"].eqNullSafe(c["after"]))).alias("c")).select(*keys, "c.*")


def score_rows(predicted: DataFrame, gold: DataFrame, keys: list[str], fields: list[str], by: list[str]) -> DataFrame:
    """EV-08, EV-12: expected rows found, fully right rows and right fields, pooled by `by`, with the share of right fields."""
    p = predicted.select(*keys, *[F.col(f).alias(f"p_{f}") for f in fields], F.lit(True).alias("found"))
    x = gold.join(p, keys, "left")
    found = F.coalesce(F.col("found"), F.lit(False))
    right = [(found & F.col(f).eqNullSafe(F.col(f"p_{f}"))).cast("int") for f in fields]
    n_right = sum(right[1:], right[0])
    return x.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(found).alias("n_found"), F.count_if(n_right == len(fields)).alias("n_full"), F.sum(n_right).alias("n_fields"), (F.sum(n_right) / (F.count("*") * len(fields))).alias("field_share"))


def run_diff(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """EV-13: keys of which any field differs between two runs, or that one run lacks, with both values."""
    x = a.select(*keys, *[F.col(f).alias(f"{f}_a") for f in fields], F.lit(True).alias("in_a")).join(b.select(*keys, *[F.col(f).alias(f"{f}_b") for f in fields], F.lit(True).alias("in_b")), keys, "full_outer")
    same = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    for f in fields:
        same = same & F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b"))
    return x.where(~same).drop("in_a", "in_b")


def stale(stored: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """EV-15: stored keys that a run didn't use."""
    return stored.select(*keys).distinct().join(used.select(*keys).distinct(), keys, "left_anti")


def repeated_calls(calls: DataFrame, fields: list[str]) -> DataFrame:
    """IO-08: content keys (SHA-256 of the fields, tagged and null-safe) that more than one call has."""
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.lit(f"{f}="), F.col(f).cast("string")), F.lit(f"{f}:null")) for f in sorted(fields)])
    return calls.groupBy(F.sha2(text, 256).alias("content_key")).agg(F.count("*").alias("n_calls"), F.min("id").alias("first_id")).where("n_calls > 1")


def prose_guard(texts: DataFrame, placeholder: str, text: str = "text", allow_lists: bool = True) -> DataFrame:
    """OP-07: rows with `reason`, why generated prose is not usable (null: it is). The first failing check counts."""
    t = F.coalesce(F.col(text), F.lit(""))
    times = (F.length(t) - F.length(F.replace(t, F.lit(placeholder), F.lit("")))) / len(placeholder)
    reason = F.when(F.length(F.regexp_replace(t, r"^\s+|\s+$", "")) < MIN_PROSE, "too short").when(F.length(t) > MAX_PROSE, "too long").when(times != 1, "placeholder not there exactly once").when(t.rlike(CURRENCY), "currency amount")
    if not allow_lists:
        reason = reason.when(F.replace(t, F.lit(placeholder), F.lit("")).rlike(LIST_ITEM), "list items")
    return texts.withColumn("reason", reason)


def next_versions(requests: DataFrame, quotes: DataFrame, valid_days: int = 30) -> DataFrame:
    """OP-06: per request the version after its latest (1 without one), the quote's id, and how long it is valid from its request date."""
    latest = quotes.groupBy("rfq_id").agg(F.max("version").alias("v"))
    n = F.coalesce(F.col("v") + 1, F.lit(1))
    return requests.join(latest, "rfq_id", "left").select("rfq_id", n.cast("long").alias("version"), F.concat(F.lit("Q-"), F.col("rfq_id").cast("string"), F.lit("-v"), n.cast("string")).alias("quote_id"), F.date_add("issued", valid_days).alias("valid_until"))
