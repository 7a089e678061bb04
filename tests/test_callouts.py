"""Callouts as drawing standards print them, types by convention, equal texts and headings; cases computed by hand."""

import pytest
from pyspark.sql import functions as F

from tenderline.functions import callouts
from tenderline.operators import drawings, scoring, search

CALLOUTS = {
    "4x Ø12,5 H7": (4, 12.5, None, None, None, None, True),
    "2 × M20": (2, 20.0, "M20", None, None, None, False),
    "M 8 × 1.25": (None, 8.0, "M8x1.25", None, 1.25, 8.0, False),  # a thread with its pitch also reads as a pair
    "1,5x45°": (None, None, None, 1.5, 1.5, 45.0, False),
    "POCKET 40x25": (None, None, None, None, 25.0, 40.0, False),
    "⌀30 h6": (None, 30.0, None, None, None, None, True),
    "4x": (None, None, None, None, None, None, False),
    "4xM6": (None, None, None, None, None, None, False),
    "12 P9": (None, None, None, None, None, None, False),
    "": (None, None, None, None, None, None, False),
    None: (None, None, None, None, None, None, False),
}


def test_callouts(spark):
    rows = spark.createDataFrame([(t,) for t in CALLOUTS], "t string")
    x = rows.withColumn("m", callouts.marks(F.col("t"))).withColumn("w", callouts.windows(F.col("m")))
    got = {r["t"]: tuple(r["c"]) for r in x.select("t", callouts.callout(F.col("t"), F.col("m"), F.col("w")).alias("c")).collect()}

    assert got == CALLOUTS


FITS = {"H7": ("hole", False, 7), "g6": ("shaft", False, 6), "js 9": ("shaft", True, 9), "P9": ("hole", True, 9), "Js10": (None, True, 10), "D11": ("hole", False, 11), "H7/g6": (None, False, 6), "N99": ("hole", False, None), "7": (None, False, None), None: (None, False, None)}


def test_fits(spark):
    x = spark.createDataFrame([(f,) for f in FITS], "f string").withColumn("m", callouts.marks(F.col("f")))
    got = {r["f"]: (r["kind"], bool(r["key"]), r["grade"]) for r in x.select("f", callouts.fit_kind(F.col("m")).alias("kind"), callouts.key_width(F.col("m")).alias("key"), callouts.finest_grade(F.col("f")).alias("grade")).collect()}
    assert got == FITS


# type as read, shape, fit, evidence, nominal; type, fit, nominal and length that conventions give
TYPED = [
    ("bore", "rotational", "p9", "12 p9", 12.0, "keyway", "P9", 12.0, None),
    ("bore", "rotational", "P9", None, 12.0, "bore", "P9", 12.0, None),
    ("bore", "prismatic", "P9", "Ø12 P9", 12.0, "hole", "P9", 12.0, None),
    ("hole", "rotational", "h7", "Ø12 h7", 12.0, "outer_diameter", "h7", 12.0, None),
    ("hole", "prismatic", "h7", "Ø12 h7", 12.0, "hole", "h7", 12.0, None),
    ("outer_diameter", "rotational", "H7", "Ø12 H7", 12.0, "bore", "H7", 12.0, None),
    ("outer_diameter", "prismatic", "H7", "Ø12 H7", 12.0, "hole", "H7", 12.0, None),
    ("outer_diameter", None, "H7/g6", None, 12.0, "outer_diameter", "H7/g6", 12.0, None),
    ("pocket", "prismatic", None, "40x25", 40.0, "pocket", None, 25.0, 40.0),
    ("slot", "prismatic", None, "40x25", None, "slot", None, 25.0, 40.0),
    ("pocket", "prismatic", None, "40x25", 12.0, "pocket", None, 12.0, None),
]


def test_types_by_convention(spark):
    rows = [(i, *r[:5], None) for i, r in enumerate(TYPED)]
    out = drawings.retype(spark.createDataFrame(rows, "n int, ftype string, shape_class string, fit string, evidence string, nominal double, len_mm double"))
    assert [tuple(r) for r in out.orderBy("n").select("ftype", "fit", "nominal", "len_mm").collect()] == [r[5:] for r in TYPED]
    assert out.columns == ["n", "ftype", "shape_class", "fit", "evidence", "nominal", "len_mm"]


@pytest.mark.parametrize(("a", "b", "same"), [(" M8 × 1,25 ", "m8x1,25", True), ("Ø12  H7.", "12 h7", True), ("a b", "ab", False), ("a - b", "a-b", True), ("1 .5", "1.5", True), (None, " . ", True), ("...", "", True), ("x", "", False), ("fox trot", "foxtrot", True)])
def test_same_text(spark, a, b, same):
    x = spark.createDataFrame([(a, b)], "a string, b string")
    assert x.select(scoring.same_text(F.col("a"), F.col("b"))).first()[0] is same


LINES = {"# A": (1, "A"), "##  B c ##  ": (2, "B c"), "###\tD#": (3, "D"), "####  E": (0, None), "##F": (0, None), "## ##": (0, None), " # G": (0, None), "": (0, None), "text # x": (0, None)}


def test_headings(spark):
    n, title = search.heading(F.col("t"))
    got = {r["t"]: (r["n"], r["h"] if r["n"] else None) for r in spark.createDataFrame([(t,) for t in LINES], "t string").select("t", n.alias("n"), title.alias("h")).collect()}
    assert got == LINES


def test_score_readings(spark):
    head = "rfq_id long, customer string, contact string, email string, language string, received string, incoterm string, currency string, requirements array<string>"
    line = "rfq_id long, line_no int, quantities array<int>, due string, drawing_ref string, part_number string"
    sent = spark.createDataFrame([(1, "A GmbH", "B", "b@a.de", "de", "2024-01-02", "DAP", "EUR", ["Zinc plated", "Deliver in boxes"]), (2, "C", None, None, "en", None, None, "EUR", None)], head)
    read = spark.createDataFrame([(1, "a  gmbh.", "B", "b@a.de", "en", "2024-01-02", "dap", "EUR", ["boxes for delivery", "paint"])], head)
    lines = spark.createDataFrame([(1, 10, [5, 9], "d", "x-1", "P 1"), (1, 20, [1], "d", None, None), (1, 30, [1], "d", None, None)], line)
    got = spark.createDataFrame([(1, 1, [5, 9], "e", "x-1", "p 1"), (1, 2, [1, 2], "d", None, "q")], line)
    out = {r["rfq_id"]: tuple(r)[1:] for r in scoring.score_readings(read, sent, got, lines).collect()}
    # "Deliver in boxes" has the stems deliv and boxes; "Zinc plated" is missed, paint is made up
    assert out[1] == (6, False, 5, 8, 1, 2, 1, 2, ["language", "line 10 due", "line 20 quantities", "line 20 part_number", "-Zinc plated", "+paint"])
    assert out[2] == (4, True, 0, 0, 0, 0, 0, 0, ["customer", "language", "currency"])
