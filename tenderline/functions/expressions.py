"""Column builders that several jobs share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def norm_token(text: Column) -> Column:
    """Upper case, × and * as X, no gap round an X between digits, no space, hyphen, dot, plus or slash."""
    up = F.translate(F.upper(text), "×*", "XX")
    return F.translate(F.regexp_replace(up, r"(?<=\d)\s*X\s*(?=\d)", "X"), " -.+/", "")


def truthy(x: Column) -> Column:
    """Null for a missing value and for 0: both mean `not printed`."""
    return F.nullif(x, F.lit(0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def plain_number(x: Column, digits: int = 6) -> Column:
    """A number as text, with at most `digits` decimals and no trailing zeros."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", x), r"\.?0+$", "")


def money(x: Column, language: str = "en") -> Column:
    """1,234.50 or, in German, 1.234,50."""
    text = F.format_number(x, 2)
    return F.translate(text, ",.", ".,") if language == "de" else text


def ascii_fold(text: Column) -> Column:
    """Letters with the common accents as plain ASCII letters."""
    return F.translate(text, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")


def slug(text: Column) -> Column:
    """Lower-case ASCII words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


def value_equal(a: Column, b: Column, relative: float = 0.01) -> Column:
    """Numbers within 1 % of the larger; both missing are equal."""
    near = F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)


def median(x: Column) -> Column:
    """Exact interpolated median."""
    return F.percentile(x, 0.5)
