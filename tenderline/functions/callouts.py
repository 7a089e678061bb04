"""Callouts, the short texts printed beside the dimensions of a drawing, read mark by mark.

A mark is a number (point or comma before its decimals), a word of letters or any other single sign. What a callout states follows from neighbouring
marks: a diameter sign or an M before a number gives a size, two numbers with a times sign between them a pair of sides, and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MARK = r"\d+(?:[.,]\d+)?|[A-Za-z]+|[^\sA-Za-z\d]"
# fixed values: signs of diameters and of repetition, letter of metric threads, angle of a plain chamfer, coarsest standard grade
ROUND, TIMES, METRIC, CHAMFER_DEGREES, COARSEST = ("Ø", "⌀"), ("x", "×"), "M", 45, 18
# fixed values: letters and grades of the fits of key widths
KEY_LETTERS, KEY_GRADES = ("N", "P", "JS", "D"), (9, 10)


def marks(text: Column) -> Column:
    """The marks of a text in their order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MARK), 0)


def number(mark: Column) -> Column:
    """The value of a number; null for other marks."""
    return F.when((mark >= "0") & (mark < ":"), F.replace(mark, F.lit(","), F.lit(".")).cast("double"))


def letters(mark: Column) -> Column:
    return mark.rlike("^[A-Za-z]")


def windows(of: Column) -> Column:
    """Each mark with the three that follow it (a, b, c, d; null beyond the end); `of`: a column of marks."""
    return F.transform(of, lambda a, i: F.struct(a.alias("a"), *[F.get(of, i + k).alias(n) for k, n in enumerate("bcd", 1)]))


def first(rows: Column, where, value) -> Column:
    """value(row) of the first row that meets where(row); null without one."""
    return F.get(F.transform(F.filter(rows, where), value), F.lit(0))


def callout(text: Column, of: Column, rows: Column) -> Column:
    """What a callout states, as a struct: count, size, thread, chamfer, short and long (sides of a pair), round (has a diameter sign); `of`: marks(text), `rows`: windows(of)."""
    times = lambda m: m.isin(*TIMES)
    sized = lambda w: w["a"].isin(*ROUND, METRIC) & number(w["b"]).isNotNull()
    paired = lambda w: number(w["a"]).isNotNull() & times(w["b"]) & number(w["c"]).isNotNull()
    pitch = lambda w: F.when(times(w["c"]) & number(w["d"]).isNotNull(), F.concat(F.lit("x"), w["d"])).otherwise("")
    # a count is a word of its own, with or without the sign (4x, 4 x), and something follows it
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    head, sign, more = (F.get(words, F.lit(i)) for i in range(3))
    bare = F.rtrim(head, F.lit("".join(TIMES)))
    whole = bare.rlike(r"^\d+$")
    count = F.when(whole & (F.length(head) == F.length(bare) + 1) & sign.isNotNull(), bare.cast("int")).when(whole & (head == bare) & times(sign) & more.isNotNull(), bare.cast("int"))
    side = lambda which: first(rows, paired, lambda w: which(number(w["a"]), number(w["c"])))
    return F.struct(
        count.alias("count"),
        first(rows, sized, lambda w: number(w["b"])).alias("size"),
        first(rows, lambda w: (w["a"] == METRIC) & number(w["b"]).isNotNull(), lambda w: F.concat(w["a"], w["b"], pitch(w))).alias("thread"),
        first(rows, lambda w: paired(w) & (number(w["c"]) == CHAMFER_DEGREES), lambda w: number(w["a"])).alias("chamfer"),
        side(F.least).alias("short"),
        side(F.greatest).alias("long"),
        F.exists(of, lambda m: m.isin(*ROUND)).alias("round"),
    )


def fit_kind(of: Column) -> Column:
    """shaft for the marks of a fit whose letters are all small, hole for all capitals; else null."""
    word = F.array_join(F.filter(of, letters), "")
    return F.when(word == "", None).when(word == F.lower(word), "shaft").when(word == F.upper(word), "hole")


def key_width(of: Column) -> Column:
    """Whether the marks of a fit are those of a key's width."""
    return (F.size(of) == 2) & F.upper(F.get(of, F.lit(0))).isin(*KEY_LETTERS) & number(F.get(of, F.lit(1))).isin(*KEY_GRADES)


def finest_grade(fit: Column) -> Column:
    """The least grade behind letters in a fit such as H7/g6; null without one."""
    of = marks(fit)
    graded = F.filter(F.zip_with(of, F.slice(of, 2, F.greatest(F.size(of), F.lit(1))), lambda a, b: F.when(letters(a), number(b))), lambda g: g.isNotNull() & (g <= COARSEST))
    return F.array_min(graded).cast("int")
