"""Clean-up of requests as a model has read them: fields, quantities, requirements, and the files that lines refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def file_key(name: Column) -> Column:
    """Lower-case letters and digits of a file name without its ending."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")), "[^a-z0-9]", "")


def match_attachments(lines: DataFrame, files: DataFrame) -> DataFrame:
    """NR-17: lines (rfq_id, line_no, drawing_ref) with `file` of their request: of equal key (first by name), else the only one whose key holds the line's or stands in it; else null.

    Files meet the lines of their own request only.
    """
    f = files.select("rfq_id", "file", file_key(F.col("file")).alias("k"))
    x = lines.select("rfq_id", "line_no", file_key(F.col("drawing_ref")).alias("r")).where("r <> ''").join(f, "rfq_id")
    near = F.contains("r", "k") | F.contains("k", "r")
    best = x.groupBy("rfq_id", "line_no").agg(F.min(F.when(F.col("r") == F.col("k"), F.col("file"))).alias("same"), F.min(F.when(near, F.col("file"))).alias("one"), F.count_if(near).alias("n"))
    return lines.join(best, ["rfq_id", "line_no"], "left").withColumn("file", F.coalesce("same", F.when(F.col("n") == 1, F.col("one")))).drop("same", "one", "n")


def normalise_requests(requests: DataFrame) -> DataFrame:
    """NR-18: currency in capitals (EUR if none), the incoterm's first word in capitals, blank fields null, and requirements (cut by |) that don't name the incoterm."""
    term = F.nullif(F.element_at(F.split(F.upper(F.trim("incoterm")), r"\s+"), 1), F.lit(""))
    x = requests.withColumns({"currency": F.upper(F.coalesce(F.nullif(F.trim("currency"), F.lit("")), F.lit("EUR"))), "incoterm": term})
    words = lambda r: F.split(F.upper(r), "[^A-Z0-9_]+")
    kept = F.filter(F.split("requirements", r"\|"), lambda r: F.col("incoterm").isNull() | ~F.array_contains(words(r), F.col("incoterm")))
    return x.withColumn("requirements", kept)


def normalise_lines(lines: DataFrame) -> DataFrame:
    """NR-18: lines numbered from 1, their different positive quantities (read as text, cut by commas) ascending, blank notes null."""
    n = F.row_number().over(Window.partitionBy("rfq_id").orderBy("line_no"))
    asked = F.array_sort(F.array_distinct(F.filter(F.transform(F.split("quantities", ","), lambda q: q.try_cast("int")), lambda q: q > 0)))
    return lines.withColumns({"line_no": n, "quantities": asked, "notes": F.nullif(F.trim("notes"), F.lit(""))})
