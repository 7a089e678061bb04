"""Deletes repeated line runs, by a suffix array over line ids (native).

The lines of a document, blank ones aside, are a sequence of line ids. Suffixes are ranked by distributed prefix doubling:
the rank of the first 2h lines is the rank of the pair (rank of the first h, rank of the h after). Suffixes of equal rank at depth h
form the intervals of the suffix array whose common prefix is h lines or more. A run starts at each line and takes as many lines
as hold `min_words` words; as its length follows from its lines, equal runs are exactly such an interval at that depth.
Of each interval the first run (in order of document, then line) stays; the lines of all others are deleted. Overlapping and
adjoining runs join. With runs that end at each line and grow backward as well (`maximal`), maximal repeated runs go as a whole: a
line of one either has min_words words from there to its end, or stands in the run that ends with it.

The words of a line are counted by blanks; a line that has few of them counts by its characters, as text does that is
written without spaces.

Lines that occur once end every run; only repeated lines are ranked, and only classes of two or more go on to the next depth.
Doubling ends at the depth that holds min_words lines. Deeper intervals delete nothing more: a repeated run of n lines, n above that depth,
is covered by runs of that depth that stand at each of its lines, and each of these is a later copy as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderline.llm.storage import store

BLANKS = " \t\r\f\x0b"
#: Characters that count as a word where blanks give fewer words: of any kind, and of scripts written without spaces.
WORD_CHARS, DENSE_CHARS = 8, 2
DENSE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"


def _key(docs: DataFrame) -> DataFrame:
    """docs with the row key (_d, _h): rows of one doc_id and text are one document, null ids come last."""
    return docs.withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).withColumn("_h", F.xxhash64(F.lit(9), "text"))


def _words(x: Column) -> Column:
    """Words of a line: its blanks and one, or what its characters come to if that is more."""
    blanks = F.length(x) - F.length(F.translate(x, BLANKS, "")) + 1
    dense = F.when(F.octet_length(x) > F.length(x), F.regexp_count(x, F.lit(DENSE))).otherwise(0)
    return F.greatest(blanks, F.floor(F.length(x) / WORD_CHARS).cast("int"), F.floor(dense / DENSE_CHARS).cast("int"))


def line_table(docs: DataFrame) -> DataFrame:
    """_d, _h, i (number among the lines that are not blank), p (line number), a, b (128-bit line id), w (words).

    Rows of one doc_id and text give their lines once; only keys that occur again are gathered for that.
    """
    found = F.filter(F.transform(F.split("text", "\n"), lambda x, p: F.struct(p.alias("p"), F.trim(x, F.lit(BLANKS)).alias("x"))), lambda s: s["x"] != "")
    rows = _key(docs.select("doc_id", F.col("text").cast("string").alias("text"))).where("text is not null")
    again = store(rows.groupBy("_d", "_h").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated_rows")
    rows = rows.join(again, ["_d", "_h"], "left_anti").unionByName(rows.join(again, ["_d", "_h"], "left_semi").dropDuplicates(["_d", "_h"]))
    rows = rows.select("_d", "_h", F.posexplode(found).alias("i", "s"))
    x = F.col("s.x")
    return rows.select("_d", "_h", "i", F.col("s.p").alias("p"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), _words(x).alias("w"))


def dense_rank(classes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct rows `classes` with their number (from 1) in the order of keys: ranges first, then ranks within a range."""
    ranged = store(classes.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    bases = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))  # a row for each range
    ranked = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    return ranked.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_r")).drop("_part", "_base", "_r")


def suffix_ranks(lines: DataFrame, depth: int) -> DataFrame:
    """Ranks r1, r2, r4, ... (up to `depth`, a power of 2) of the suffixes at the lines that occur more than once.

    r_h is the place of the suffix among all, by its first h lines; null if those h lines are not all repeated, or their
    sequence occurs once. Adds to _d, _h, i, p, w.
    """
    repeated = lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    out = lines.join(dense_rank(repeated, ["a", "b"], "r1"), ["a", "b"]).drop("a", "b")
    h = 1
    order = Window.partitionBy("_d", "_h").orderBy("i")
    while h < depth:
        # the rank h lines on, if the lines between are there
        ahead = out.withColumn("_x", F.when(F.lead("i", h).over(order) == F.col("i") + h, F.lead(f"r{h}", h).over(order)))
        ahead = store(ahead, f"depth{h}")
        pairs = ahead.where(F.col(f"r{h}").isNotNull() & F.col("_x").isNotNull()).groupBy(f"r{h}", "_x").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        out = ahead.join(dense_rank(pairs, [f"r{h}", "_x"], f"r{2 * h}"), [f"r{h}", "_x"], "left").drop("_x")
        h *= 2
    return out


def repeated_runs(lines: DataFrame, min_words: int, maximal: bool = False) -> DataFrame:
    """_d, _h and dead (array of line numbers): the lines of runs that also start earlier."""
    depth = 2 ** max(0, math.ceil(math.log2(min_words)))
    ranks = suffix_ranks(lines, depth)
    powers = [2**k for k in range(int(math.log2(depth)) + 1)]
    order = Window.partitionBy("_d", "_h").orderBy("i")
    line = F.struct("i", "p", "w", *[f"r{h}" for h in powers])

    def reach(near: str, step: int) -> Column:
        """w and n: words and lines of the run at a line, over the lines `near` from it on."""

        def add(acc: Column, x: Column) -> Column:
            go = (acc["w"] < min_words) & acc["on"] & (x["i"] == acc["i"])
            return F.struct((acc["i"] + step).alias("i"), F.when(go, acc["w"] + x["w"]).otherwise(acc["w"]).alias("w"), F.when(go, acc["n"] + 1).otherwise(acc["n"]).alias("n"), (go | (acc["w"] >= min_words)).alias("on"))

        return F.aggregate(near, F.struct(F.col("i").alias("i"), F.lit(0).alias("w"), F.lit(0).alias("n"), F.lit(True).alias("on")), add)

    runs = ranks.withColumn("_x", F.collect_list(line).over(order.rowsBetween(0, min_words - 1)))
    if maximal:
        runs = runs.withColumn("_y", F.reverse(F.collect_list(line).over(order.rowsBetween(1 - min_words, 0))))
    runs = runs.withColumn("_s", reach("_x", 1))
    found = [F.when(F.col("_s.w") >= min_words, F.slice("_x", 1, F.col("_s.n")))]
    if maximal:  # those with enough words before the last line; all others also grow forward from their first line
        runs = runs.withColumn("_t", reach("_y", -1))
        found.append(F.when(F.col("_t.w") - F.col("w") >= min_words, F.reverse(F.slice("_y", 1, F.col("_t.n")))))
    runs = runs.select("_d", "_h", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("_x")).withColumn("n", F.size("_x"))
    first, second = F.lit(None).cast("long"), F.lit(None).cast("long")
    for h in powers:  # n lines are covered by the h first and the h last of them, h the largest power in n
        inside = (F.col("n") >= h) & (F.col("n") < 2 * h)
        first = F.when(inside, F.element_at("_x", 1)[f"r{h}"]).otherwise(first)
        second = F.when(inside, F.element_at("_x", F.col("n") - h + 1)[f"r{h}"]).otherwise(second)
    runs = runs.withColumn("_a", first).withColumn("_b", second).where("_a is not null and _b is not null")
    runs = store(runs.select("_d", "_h", F.element_at("_x", 1)["i"].alias("i"), "n", "_a", "_b", F.transform("_x", lambda s: s["p"]).alias("ps")), "runs")
    intervals = runs.groupBy("n", "_a", "_b").agg(F.min(F.struct("_d", "_h", "i")).alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    intervals = store(intervals, "intervals")  # a table of its own, so that a join partition with a very common run can be split
    later = runs.join(intervals, ["n", "_a", "_b"]).where(F.struct("_d", "_h", "i") != F.col("first"))
    return later.groupBy("_d", "_h").agg(F.array_distinct(F.flatten(F.collect_list("ps"))).alias("dead"))


def dedup_lines(docs: DataFrame, min_words: int = 4, maximal: bool = False) -> DataFrame:
    """docs with the later copies of repeated line runs deleted from `text`, and n_lines, n_removed.

    A run is as many consecutive lines as hold min_words words; blank lines are no part of runs, compared lines are trimmed, and a line is a run
    alone if it has the words. With `maximal`, repeated runs go up to their last line, however few words it has. What stays is joined by line feeds as it was. Null texts stay null, empty ones empty, with no
    line removed. Rows with the same doc_id and text are one document and fare alike; a null doc_id comes after all others. Columns
    n_lines and n_removed of the input are replaced, and those named _d, _h, _lines and dead go.
    """
    dead = repeated_runs(store(line_table(docs), "lines"), min_words, maximal)
    kept = _key(docs.drop("n_lines", "n_removed", "_d", "_h", "_lines", "dead").withColumn("text", F.col("text").cast("string")))
    joined = kept.join(dead.hint("shuffle_hash"), ["_d", "_h"], "left")
    joined = joined.withColumn("_lines", F.when(F.col("dead").isNotNull(), F.split("text", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "dead")  # by hashing: linear in the lines
    rest = F.when(F.col("dead").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda p: F.col("_lines")[p]), "\n"))
    return joined.withColumn("n_lines", F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))).withColumn("n_removed", F.coalesce(F.size("dead"), F.lit(0))).withColumn("text", rest).drop("_d", "_h", "dead", "_lines")


def digest(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the checksum of the text that stays."""
    return cleaned.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
