"""Scores of what models have read against what is true: features, drawings, requests, and free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: how far sizes of one feature may be apart in mm, relative slack of numbers and tolerances, share of words that makes a text the same
NOMINAL_MM, NUMBER_SLACK, BAND_SLACK, TEXT_RECALL, STEM = 0.5, 0.01, 0.001, 0.6, 5
# fixed values: words that don't count
STOP_WORDS = ("with", "the", "and", "per", "of", "in", "as", "a", "an", "to", "for", "be", "by", "on")


# fixed values: signs that stand for another or for none; signs that part words, whatever blanks are round them
TWINS, PARTING = ("×ø⌀", "x"), "x:/+-.,;"


def parts(x: Column) -> Column:
    """EV-09: what counts of a text, as a list: its words and parting signs in small letters, without points at the ends. Blanks only part words."""
    low = F.translate(F.lower(F.coalesce(x.cast("string"), F.lit(""))), *TWINS)
    signs = F.array(*[F.lit(s) for s in PARTING])
    # each sign becomes a part of its own, then blanks cut the rest
    loose = F.aggregate(signs, low, lambda text, sign: F.replace(text, sign, F.concat(F.lit(" "), sign, F.lit(" "))))
    found = F.filter(F.split(loose, r"\s"), lambda p: p != "")
    told = F.filter(F.transform(found, lambda p, i: F.when(p != ".", i)), lambda i: i.isNotNull())
    return F.when(F.size(told) == 0, F.array().cast("array<string>")).otherwise(F.slice(found, F.array_min(told) + 1, F.array_max(told) - F.array_min(told) + 1))


def same_text(a: Column, b: Column) -> Column:
    """EV-09: equal parts; null is an empty text."""
    return parts(a) == parts(b)


def same_number(a: Column, b: Column, slack: float = NUMBER_SLACK) -> Column:
    """EV-09: within `slack` of the expected b; both missing are the same."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= slack * F.greatest(F.abs(b), F.lit(1e-9)))


def stems(x: Column) -> Column:
    """The different words of a text, cut to STEM characters, without stop words. Words may hold points and the letter x, which part nothing here."""
    joined = F.aggregate(
        parts(x),
        F.struct(F.lit("").alias("text"), F.lit(True).alias("open")),
        lambda acc, p: F.struct(F.concat(acc["text"], F.when(acc["open"] | F.contains(F.lit(PARTING), p), "").otherwise(" "), p).alias("text"), F.contains(F.lit(PARTING), p).alias("open")),
        lambda acc: acc["text"],
    )
    words = F.filter(F.split(joined, r"[^\p{L}\p{N}.]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, STEM)))


def _alike(got: Column, got_stems: Column, want: Column, want_stems: Column, recall: float) -> Column:
    empty = lambda t: F.coalesce(t, F.lit("")) == ""
    enough = (F.size(want_stems) > 0) & (F.size(F.array_intersect(want_stems, got_stems)) >= recall * F.size(want_stems))
    return F.when(empty(got) | empty(want), empty(got) & empty(want)).otherwise(enough)


def same_meaning(got: Column, want: Column, recall: float = TEXT_RECALL) -> Column:
    """EV-10: enough of the expected text's stems are in the other; two empty texts are the same."""
    return _alike(got, stems(got), want, stems(want), recall)


def match_features(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """EV-06: drawing, g, p (numbers n of matched features): of one type and nominal sizes NOMINAL_MM apart at most, each once, the closest first.

    Ties go to the smaller gold number, then the smaller predicted one. Candidates of a drawing and type are few; the choice is a fold over them.
    """
    g, p = gold.select("drawing", F.col("n").alias("g"), "ftype", F.col("nominal").alias("want")), predicted.select("drawing", F.col("n").alias("p"), "ftype", F.col("nominal").alias("got"))
    gap = F.when(F.col("want").isNull() & F.col("got").isNull(), 0.0).otherwise(F.round(F.abs(F.col("got") - F.col("want")), 9))
    found = g.join(p, ["drawing", "ftype"]).withColumn("d", gap).where(F.col("d") <= NOMINAL_MM)
    sorted_ = found.groupBy("drawing", "ftype").agg(F.array_sort(F.collect_list(F.struct("d", "g", "p"))).alias("c"))
    none = F.array().cast("array<struct<g:int,p:int>>")
    take = lambda acc, x: F.when(F.exists(acc, lambda a: (a["g"] == x["g"]) | (a["p"] == x["p"])), acc).otherwise(F.concat(acc, F.array(F.struct(x["g"].alias("g"), x["p"].alias("p")))))
    return sorted_.select("drawing", F.explode(F.aggregate("c", none, take)).alias("m")).select("drawing", "m.*")


def score_drawings(predicted: DataFrame, gold: DataFrame, pairs: DataFrame) -> DataFrame:
    """EV-07: per drawing the features matched, read and expected, tolerances (band) expected, right and made up, and equal quantities and lengths of matched ones."""
    per = lambda t, name: t.groupBy("drawing").agg(F.count("*").alias(name))
    g = gold.select("drawing", F.col("n").alias("g"), F.col("band").alias("want"), F.col("qty").alias("g_qty"), F.col("len_mm").alias("g_len"))
    p = predicted.select("drawing", F.col("n").alias("p"), F.col("band").alias("got"), F.col("qty").alias("p_qty"), F.col("len_mm").alias("p_len"))
    x = g.join(pairs, ["drawing", "g"], "left").join(p, ["drawing", "p"], "left")
    matched, toleranced = F.col("p").isNotNull(), F.col("want").isNotNull()
    sums = x.groupBy("drawing").agg(
        F.count("p").alias("n_matched"),
        F.count("want").alias("n_tolerances"),
        F.count_if(matched & toleranced & same_number(F.col("got"), F.col("want"), BAND_SLACK)).alias("n_right"),
        F.count_if(matched & ~toleranced & F.col("got").isNotNull()).alias("n_made_up"),
        F.count_if(matched & F.col("p_qty").eqNullSafe(F.col("g_qty"))).alias("n_quantities"),
        F.count_if(matched & same_number(F.col("p_len"), F.col("g_len"))).alias("n_lengths"),
    )
    return sums.join(per(gold, "n_expected"), "drawing").join(per(predicted, "n_read"), "drawing", "left").fillna(0, ["n_read"])


def score_requests(understood: DataFrame, wanted: DataFrame, got_items: DataFrame, items: DataFrame) -> DataFrame:
    """EV-11: per request the header fields, the item count and item fields that are right, and how many there are; items are compared in their order.

    Headers: customer, priority (text), issued, total (number); items: rfq_id, line_no, qty, due.
    """
    w = wanted.select("rfq_id", *[F.col(c).alias(f"w_{c}") for c in ("customer", "priority", "issued", "total")])
    x = w.join(understood, "rfq_id", "left")
    head = [same_text(F.col(c), F.col(f"w_{c}")) for c in ("customer", "priority")] + [F.col("issued").eqNullSafe(F.col("w_issued")), same_number(F.col("total"), F.col("w_total"))]
    place = lambda t, name: t.groupBy("rfq_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "qty", "due"))).alias(name))
    both = place(items, "a").join(place(got_items, "b"), "rfq_id", "left")
    right = F.filter(F.arrays_zip("a", "b"), lambda z: z["a"].isNotNull() & z["b"].isNotNull())
    score = F.aggregate(right, F.lit(0), lambda acc, z: acc + z["a"]["qty"].eqNullSafe(z["b"]["qty"]).cast("int") + z["a"]["due"].eqNullSafe(z["b"]["due"]).cast("int"))
    lines = both.select("rfq_id", (F.size("a") == F.coalesce(F.size("b"), F.lit(0))).cast("int").alias("same_count"), F.coalesce(score, F.lit(0)).alias("ok"), (2 * F.greatest(F.size(right), F.lit(0))).alias("n"))
    out = x.join(lines, "rfq_id", "left")
    return out.select("rfq_id", sum((F.coalesce(h, F.lit(False)).cast("int") for h in head), F.lit(0)).alias("header_right"), F.coalesce("same_count", F.lit(1)).alias("same_count"), F.coalesce("ok", F.lit(0)).alias("item_right"), F.coalesce("n", F.lit(0)).alias("item_fields"))


#: Fields of a request's head, and of its lines with how they compare.
HEADERS = ("customer", "contact", "email", "language", "received", "incoterm", "currency")
LINE_FIELDS = {"quantities": Column.eqNullSafe, "due": Column.eqNullSafe, "drawing_ref": Column.eqNullSafe, "part_number": same_text}


def score_readings(read: DataFrame, sent: DataFrame, read_lines: DataFrame, sent_lines: DataFrame) -> DataFrame:
    """EV-11: per sent request the fields of its head and lines that were read right, its line count, its requirements found and those read that were sent, and what was missed.

    read, sent: rfq_id, HEADERS, requirements (array); lines: rfq_id, line_no, LINE_FIELDS. Lines pair by their place in the request, and those without
    a partner are told by the count alone. A requirement is found if any that was read means the same, and the other way round. `missed` lists fields by name,
    those of lines with the sent number, then requirements missed (-) and made up (+), in order. A request that was not read has nothing right
    but what is empty, and no lines. Repeated rfq_id in `read` would repeat rows.
    """
    c = F.col
    with_stems = lambda t: F.transform(F.coalesce(t, F.array().cast("array<string>")), lambda r: F.struct(r.alias("text"), stems(r).alias("stems")))
    want = sent.select("rfq_id", *[c(h).alias(f"w_{h}") for h in HEADERS], with_stems(c("requirements")).alias("_w"))
    got = read.select("rfq_id", *HEADERS, with_stems(c("requirements")).alias("_g"))
    x = want.join(got, "rfq_id", "left").withColumn("_g", F.coalesce("_g", F.array().cast("array<struct<text:string,stems:array<string>>>")))
    alike = lambda p, g: _alike(p["text"], p["stems"], g["text"], g["stems"], TEXT_RECALL)
    x = x.withColumns({"_lost": F.filter("_w", lambda g: ~F.exists("_g", lambda p: alike(p, g))), "_new": F.filter("_g", lambda p: ~F.exists("_w", lambda g: alike(p, g)))})
    x = x.withColumn("_bad", F.filter(F.array(*[F.when(~same_text(c(h), c(f"w_{h}")), F.lit(h)) for h in HEADERS]), lambda m: m.isNotNull()))

    place = Window.partitionBy("rfq_id").orderBy("line_no")
    numbered = lambda t, p: t.select("rfq_id", F.row_number().over(place).alias("_k"), c("line_no").alias(f"{p}line_no"), *[c(f).alias(f"{p}{f}") for f in LINE_FIELDS])
    wrong = F.filter(F.array(*[F.when(~same(c(f"g_{f}"), c(f"w_{f}")), F.lit(f)) for f, same in LINE_FIELDS.items()]), lambda m: m.isNotNull())
    pairs = numbered(sent_lines, "w_").join(numbered(read_lines, "g_"), ["rfq_id", "_k"], "left").withColumn("_bad", F.when(c("g_line_no").isNotNull(), wrong))
    told = F.transform("_bad", lambda f: F.concat(F.lit("line "), c("w_line_no").cast("string"), F.lit(" "), f))
    per = pairs.groupBy("rfq_id").agg(F.count("*").alias("_n"), F.count("_bad").alias("_paired"), F.sum(F.size("_bad")).alias("_wrong"), F.array_sort(F.collect_list(F.when(F.size("_bad") > 0, F.struct(c("_k"), told.alias("m"))))).alias("_lines"))
    counts = read_lines.groupBy("rfq_id").agg(F.count("*").alias("_m"))
    x = x.join(per, "rfq_id", "left").join(counts, "rfq_id", "left").fillna(0, ["_n", "_m", "_paired", "_wrong"])
    texts = lambda rows, sign: F.transform(rows, lambda r: F.concat(F.lit(sign), F.coalesce(r["text"], F.lit(""))))
    lines = F.coalesce(F.flatten(F.transform("_lines", lambda s: s["m"])), F.array().cast("array<string>"))
    return x.select(
        "rfq_id",
        (F.lit(len(HEADERS)) - F.size("_bad")).alias("header_right"),
        (c("_n") == c("_m")).alias("same_count"),
        (c("_paired") * len(LINE_FIELDS) - c("_wrong")).alias("line_right"),
        (c("_paired") * len(LINE_FIELDS)).alias("line_fields"),
        (F.size("_w") - F.size("_lost")).alias("found"),
        F.size("_w").alias("required"),
        (F.size("_g") - F.size("_new")).alias("confirmed"),
        F.size("_g").alias("read"),
        F.concat("_bad", lines, texts(c("_lost"), "-"), texts(c("_new"), "+")).alias("missed"),
    )


def pool_scores(scores: DataFrame, by: list[str]) -> DataFrame:
    """EV-12: score_drawings() rows summed up by set and variant, with recall, precision and the share of right tolerances as ratios of sums."""
    sums = scores.groupBy(*by).agg(F.count("*").alias("n_drawings"), *[F.sum(c).alias(c) for c in ("n_matched", "n_expected", "n_read", "n_right", "n_tolerances")])
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return sums.select(*by, "n_drawings", share("n_matched", "n_expected").alias("recall"), share("n_matched", "n_read").alias("precision"), share("n_right", "n_tolerances").alias("tolerances"))
