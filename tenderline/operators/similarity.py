"""Similar parts: explainable pair score, top k, and reference costs."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderline.functions.expressions import truthy
from tenderline.operators import geometry
from tenderline.params import DEFAULT, Params
from tenderline.sources import scratch

# fixed values: weights of the seven terms (they sum to 1) and the scale of size similarity
WEIGHTS = {"diameter": 0.20, "length": 0.15, "material": 0.15, "holes": 0.10, "threads": 0.10, "flags": 0.15, "precision": 0.15}
TAU = 0.35
# fixed values: likeness of materials that are the same, of one group, neither; grade that counts where none is known
MATERIAL, NO_GRADE = (1.0, 0.7, 0.3), 12
FLAGS = ("has_keyway", "has_gear", "has_heat", "has_surface")
#: Width of a band of main sizes (of their logarithm); grades that are looked up one by one.
BAND, NEAR_GRADES = 0.2, 4
#: Marks among grades and bands: more than NEAR_GRADES away; size unknown; any size. Scores have four places.
FAR, UNKNOWN, ALL = -1000, -100_000, -100_001
SLACK = 1e-4
#: Vectors of a page at most (2 ** PAGE; twice as many for each fourfold of 2 ** FEW vectors, as pages that meet are shuffled); width of the bands of main sizes that pages are cut from; how near to a score others are kept: four places, and what single precision loses.
PAGE, FEW, PAGE_BAND, NEAR = 11, 18, 0.1, 1.2e-4
#: Queries of a page that meet another page at once.
STEP = 64
# fixed values: least score and largest size difference at which a part counts as the same but for details
REUSE_SCORE, REUSE_DIFFERENCE = 0.92, 0.05
#: Factor for parts of another shape class.
OTHER_SHAPE = 0.3

FIELDS = ["shape_class", "main_mm", "length_mm", "material_code", "mat_group", "n_holes", "n_threads", "has_keyway", "has_gear", "has_heat", "has_surface", "min_it"]
VECTOR = ["part_id", *FIELDS]


def nested_drawings(parts: DataFrame, features: DataFrame, specs: DataFrame) -> DataFrame:
    """Drawings as one row each: part_id, shape_class, material_code, the sizes of the envelope (null: not printed), treatments, and their features as an array of structs.

    A drawing has as many features as a sheet holds, so the array is small.
    """
    own = features.groupBy("part_id").agg(F.collect_list(F.struct("fid", "ftype", "nominal", "len_mm", "qty", "band", "it_grade", "ra_um", "fit")).alias("features"))
    sizes = [truthy(F.col(c)).alias(n) for c, n in (("main_mm", "max_diameter_mm"), ("length_mm", "length_mm"), ("width_mm", "width_mm"), ("height_mm", "height_mm"))]
    x = parts.select("part_id", "shape_class", "material_code", *sizes).join(specs.select("part_id", "heat_treatment", "surface_treatment"), "part_id", "left").join(own, "part_id", "left")
    none = F.array().cast(own.schema["features"].dataType)
    return x.withColumn("features", F.coalesce("features", none))


def _main_size(shape: Column, d: Column, w: Column, h: Column) -> Column:
    """Diameter of turned parts, larger side of milled ones; of assemblies the diameter, else the larger side. 0: unknown."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    side = F.greatest(z(w), z(h))
    return F.round(F.when(shape == "rotational", z(d)).when(shape == "prismatic", side).otherwise(F.coalesce(truthy(d), side)), 3)


def part_columns(drawings: DataFrame) -> DataFrame:
    """GE-09: nested drawings as rows of a table of parts: sizes with what outer diameters tell where none is printed, counts, flags, least grade and roughness.

    The inverse of what part_vectors() reads: both ways to a vector agree.
    """
    of = lambda kind: F.filter("features", lambda f: f["ftype"] == kind)
    count = lambda kind: F.aggregate(of(kind), F.lit(0), lambda n, f: n + F.coalesce(f["qty"], F.lit(0)))
    ods = F.filter(of("outer_diameter"), lambda f: truthy(f["nominal"]).isNotNull())
    length = F.aggregate(ods, F.lit(0.0), lambda n, f: n + F.coalesce(f["len_mm"], F.lit(0.0)) * f["qty"])
    told = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    least = lambda get: F.array_min(F.filter(F.transform("features", get), lambda v: v.isNotNull()))
    return drawings.select(
        "part_id", "shape_class", "material_code",
        F.round(F.coalesce(truthy(F.col("max_diameter_mm")), F.array_max(F.transform(ods, lambda f: f["nominal"]))), 3).alias("max_diameter_mm"), F.round(F.coalesce(truthy(F.col("length_mm")), truthy(length)), 3).alias("length_mm"),
        F.round("width_mm", 3).alias("width_mm"), F.round("height_mm", 3).alias("height_mm"), count("hole").alias("n_holes"), count("thread").alias("n_threads"), (count("keyway") > 0).alias("has_keyway"), (count("gear") > 0).alias("has_gear"),
        told("heat_treatment").alias("has_heat"), told("surface_treatment").alias("has_surface"), least(lambda f: geometry.scoring_grade(lambda c: f[c])).alias("min_it"), least(lambda f: f["ra_um"]).alias("min_ra"),
    )


def _grouped(rows: DataFrame, materials: DataFrame) -> DataFrame:
    return rows.join(materials.select(F.col("code").alias("material_code"), "mat_group"), "material_code", "left").select(*VECTOR, "min_ra")


def part_vectors(rows: DataFrame, materials: DataFrame) -> DataFrame:
    """GE-09: vectors of recorded parts (part_columns): a missing shape is turned, missing counts are 0, missing flags false."""
    shape = F.coalesce("shape_class", F.lit("rotational"))
    x = rows.withColumn("main_mm", _main_size(shape, F.col("max_diameter_mm"), F.col("width_mm"), F.col("height_mm")))
    x = x.withColumns({"shape_class": shape, "length_mm": F.round(F.coalesce("length_mm", F.lit(0.0)), 3)} | {c: F.coalesce(c, F.lit(0)) for c in ("n_holes", "n_threads")} | {c: F.coalesce(c, F.lit(False)) for c in FLAGS})
    return _grouped(x, materials)


def drawing_vectors(drawings: DataFrame, materials: DataFrame) -> DataFrame:
    """GE-08: vectors of nested drawings, straight from their features: 12 fields that pairs are scored on, and the least roughness."""
    kinds = {"n_holes": "hole", "n_threads": "thread", "_keyways": "keyway", "_gears": "gear"}
    f = F.col("f")
    flat = drawings.select("part_id", F.explode_outer("features").alias("f"))
    od = (f["ftype"] == "outer_diameter") & truthy(f["nominal"]).isNotNull()
    sums = flat.groupBy("part_id").agg(
        F.max(F.when(od, f["nominal"])).alias("_d"), F.sum(F.when(od, F.coalesce(f["len_mm"], F.lit(0.0)) * f["qty"])).alias("_l"), *[F.coalesce(F.sum(F.when(f["ftype"] == kind, f["qty"])), F.lit(0)).cast("int").alias(c) for c, kind in kinds.items()],
        F.min(geometry.scoring_grade(lambda c: f[c])).alias("min_it"), F.min(f["ra_um"]).alias("min_ra"),
    )
    x = drawings.drop("features").join(sums, "part_id")
    told = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    x = x.withColumns({
        "main_mm": _main_size(F.col("shape_class"), F.coalesce(truthy(F.col("max_diameter_mm")), "_d"), F.col("width_mm"), F.col("height_mm")), "length_mm": F.round(F.coalesce(truthy(F.col("length_mm")), "_l", F.lit(0.0)), 3),
        "has_keyway": F.col("_keyways") > 0, "has_gear": F.col("_gears") > 0, "has_heat": told("heat_treatment"), "has_surface": told("surface_treatment"),
    })
    return _grouped(x, materials)


def differing_fields(a: DataFrame, b: DataFrame) -> DataFrame:
    """part_id and n_different: fields in which two tables of vectors differ; a part that one of them lacks differs in all."""
    fields = [*FIELDS, "min_ra"]
    x, y = a.select("part_id", F.struct(*fields).alias("x")), b.select("part_id", F.struct(*fields).alias("y"))
    unlike = sum((F.when(F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), 0).otherwise(1) for c in fields), F.lit(0))
    lone = F.col("x").isNull() | F.col("y").isNull()
    return x.join(y, "part_id", "full_outer").select("part_id", F.when(lone, len(fields)).otherwise(unlike).alias("n_different"))


def _size(a: Column, b: Column) -> Column:
    known = (F.coalesce(a, F.lit(0)) > 0) & (F.coalesce(b, F.lit(0)) > 0)
    return F.when(known, F.exp(-F.abs(F.ln(a / b)) / TAU)).otherwise(F.lit(0.5))


def _count(a: Column, b: Column) -> Column:
    return 1 - F.abs(a - b) / F.greatest(a, b, F.lit(1))


def pair_terms(q: str = "q", p: str = "p") -> dict[str, Column]:
    """The seven terms of a joined pair, each 0 to 1 (SI-01)."""
    c = lambda side, name: F.col(f"{side}.{name}")
    same = lambda name: c(q, name).eqNullSafe(c(p, name))
    flags = sum((F.when(same(f), 1 / len(FLAGS)).otherwise(0.0) for f in FLAGS), F.lit(0.0))
    return {
        "diameter": _size(c(q, "main_mm"), c(p, "main_mm")),
        "length": _size(c(q, "length_mm"), c(p, "length_mm")),
        "material": F.when(same("material_code"), MATERIAL[0]).when(c(q, "mat_group") == c(p, "mat_group"), MATERIAL[1]).otherwise(MATERIAL[2]),
        "holes": _count(c(q, "n_holes"), c(p, "n_holes")),
        "threads": _count(c(q, "n_threads"), c(p, "n_threads")),
        "flags": flags,
        "precision": F.exp(-F.abs(F.coalesce(c(q, "min_it"), F.lit(NO_GRADE)) - F.coalesce(c(p, "min_it"), F.lit(NO_GRADE))) / 2.0),
    }


def _moves(loss: float) -> list[dict]:
    """Ways in which two parts may differ in grade, flags and material at a loss of score of `loss` at most, each with what is left for their other terms.

    d: difference of grades (FAR: more than NEAR_GRADES); mask: flags that differ; mode: same material, same group, or neither.
    """
    out = []
    for d in [*range(-NEAR_GRADES, NEAR_GRADES + 1), FAR]:
        gap = NEAR_GRADES + 1 if d == FAR else abs(d)
        for mask in range(2 ** len(FLAGS)):
            for mode, like in enumerate(MATERIAL):
                gone = WEIGHTS["precision"] * (1 - math.exp(-gap / 2)) + WEIGHTS["flags"] * mask.bit_count() / len(FLAGS) + WEIGHTS["material"] * (1 - like)
                if gone <= loss:
                    out.append({"d": d, "mask": mask, "mode": mode, "left": loss - gone})
    return out


def _keys(rows: DataFrame) -> DataFrame:
    """Vectors with what they are looked up by: grade, flags as bits, and band of the main size (null: unknown)."""
    flags = sum((F.when(F.col(f), 1 << k).otherwise(0) for k, f in enumerate(FLAGS)), F.lit(0))
    return rows.withColumns({"_it": F.coalesce(F.col("min_it"), F.lit(NO_GRADE)).cast("int"), "_flags": flags, "_ln": F.when(F.col("main_mm") > 0, F.ln("main_mm"))}).withColumn("_band", F.floor(F.col("_ln") / BAND).cast("int"))


def candidates(queries: DataFrame, parts: DataFrame, loss: float) -> DataFrame:
    """Pairs (q, p) of vectors that may score 1 - loss or more: all such pairs are among them, each once (SI-02).

    Queries are dealt to the keys at which such parts can stand (shape class, material, grade, flags, band of the main size), one for each way to differ
    and each band that what is left of the loss can reach; parts stand at theirs. The join is on equal keys.
    """
    moves = _moves(loss + SLACK)
    far, wide = any(m["d"] == FAR for m in moves), max(m["left"] for m in moves)
    ways = F.from_json(F.lit(json.dumps(moves)), "array<struct<d: int, mask: int, mode: int, left: double>>")
    # queries become many rows here, which Spark's sizes don't tell: as many tasks as for a shuffle, and neither side is broadcast
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = _keys(queries).repartition(tasks, "_v").withColumn("_m", F.explode(ways))
    left = F.col("_m.left")
    # unknown sizes score a half: an unknown query meets all bands for half the weight, a known one the unknown band too
    half = left >= WEIGHTS["diameter"] / 2
    gap = -TAU * F.ln(1 - left / WEIGHTS["diameter"])
    near = F.sequence(F.floor((F.col("_ln") - gap) / BAND).cast("int"), F.floor((F.col("_ln") + gap) / BAND).cast("int"))
    some = F.when(half, F.array_append(near, F.lit(UNKNOWN))).otherwise(near)
    bands = F.when(left >= WEIGHTS["diameter"], F.array(F.lit(ALL))).when(F.col("_ln").isNotNull(), some).when(half, F.array(F.lit(ALL)))
    material = lambda mode: F.when(mode == 0, F.concat(F.lit("c"), F.coalesce("material_code", F.lit("-")))).when(mode == 1, F.concat(F.lit("g"), F.col("mat_group"))).otherwise("a")
    grade = F.when(F.col("_m.d") == FAR, FAR).otherwise(F.col("_it") + F.col("_m.d"))
    q = q.select(*queries.columns, F.col("_it").alias("_i"), F.col("_m.mode").alias("_mode"), material(F.col("_m.mode")).alias("_mat"), grade.alias("_grade"), F.col("_flags").bitwiseXOR(F.col("_m.mask")).alias("_flags"), F.explode(bands).alias("_band"))
    p = _keys(parts)
    spots = F.array(F.coalesce("_band", F.lit(UNKNOWN)), F.lit(ALL)) if wide >= WEIGHTS["diameter"] / 2 else F.array(F.coalesce("_band", F.lit(UNKNOWN)))
    modes, grades = F.array(*[F.lit(m) for m in sorted({m["mode"] for m in moves})]), F.array("_it", F.lit(FAR)) if far else F.array("_it")
    p = p.withColumn("_mode", F.explode(modes)).withColumn("_mat", material(F.col("_mode"))).where("_mat is not null").withColumn("_grade", F.explode(grades)).withColumn("_band", F.explode(spots))
    p = p.select(*parts.columns, F.col("_it").alias("_i"), "_mat", "_grade", "_flags", "_band")
    q, p = q.alias("q"), p.hint("merge").alias("p")
    c = F.col
    on = (c("q.shape_class").eqNullSafe(c("p.shape_class"))) & (c("q._mat") == c("p._mat")) & (c("q._grade") == c("p._grade")) & (c("q._flags") == c("p._flags")) & (c("q._band") == c("p._band"))
    same, group = c("q.material_code").eqNullSafe(c("p.material_code")), F.coalesce(c("q.mat_group") == c("p.mat_group"), F.lit(False))
    other = F.when(c("q._mode") == 0, True).when(c("q._mode") == 1, ~same).otherwise(~same & ~group)
    apart = (c("q._grade") != FAR) | (F.abs(c("q._i") - c("p._i")) > NEAR_GRADES)
    return q.join(p, on & other & apart)


def _pages(rows: DataFrame, name: str, *more: str) -> DataFrame:
    """Vectors in pages of one shape class and near sizes: a row each with its columns as arrays and the ranges of its sizes (logarithms).

    name: the column with the vector's number, which becomes `id`.
    """
    size = lambda c: F.when(F.col(c) > 0, F.ln(c)).cast("float")
    n = rows.count()
    bits = PAGE + max(0, n.bit_length() - FEW) // 2
    tasks = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, n >> bits))
    plain = {"main": size("main_mm"), "length": size("length_mm"), "grade": F.coalesce("min_it", F.lit(NO_GRADE)).cast("float"), "holes": F.col("n_holes").cast("float"), "threads": F.col("n_threads").cast("float")}
    coded = {"material": F.xxhash64("material_code"), "like": F.when(F.col("mat_group").isNotNull(), F.xxhash64("mat_group")).otherwise(0)} | {f: F.when(F.col(f), 1).when(~F.col(f), 0).otherwise(2) for f in FLAGS}
    x = rows.select(F.coalesce("shape_class", F.lit("\0")).alias("shape"), F.col(name).alias("id"), *[c.alias(n) for n, c in (plain | coded).items()], *more)
    order = ["shape", F.floor(F.col("main") / PAGE_BAND), "length", "holes", "threads", "id"]
    x = x.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("cut", F.shiftright(F.monotonically_increasing_id(), bits))
    columns = ["id", *plain, *coded, *more]
    ranges = [f(c).alias(f"{n}_{c}") for c in ("main", "length") for n, f in (("min", F.min), ("max", F.max), ("none", lambda c: F.max(F.isnull(c))))]
    x = x.groupBy("shape", "cut").agg(F.collect_list(F.struct(*columns)).alias("rows"), *ranges)
    return x.select("shape", F.monotonically_increasing_id().alias("page"), *[f"{n}_{c}" for c in ("main", "length") for n in ("min", "max", "none")], *[F.col(f"rows.{c}").alias(c) for c in columns])


def _terms() -> dict[tuple[str, ...], Callable[[dict, dict], np.ndarray]]:
    """The sum of pair_terms() for columns of pages in three summands, each by the columns it is made of."""
    near = lambda q, p, c, scale: np.exp(np.abs(q[c][:, None] - p[c]) * np.float32(-1 / scale))

    def size(q: dict, p: dict, c: str) -> np.ndarray:
        return np.nan_to_num(near(q, p, c, TAU), nan=0.5)

    def count(q: dict, p: dict, c: str) -> np.ndarray:
        a, b = q[c][:, None], p[c]
        return 1 - np.abs(a - b) / np.maximum(np.maximum(a, b), 1)

    def kind(q: dict, p: dict) -> np.ndarray:
        like = np.where((q["like"][:, None] == p["like"]) & (p["like"] != 0), np.float32(MATERIAL[1]), np.float32(MATERIAL[2]))
        like[q["material"][:, None] == p["material"]] = MATERIAL[0]
        flags = sum((q[f][:, None] == p[f]).astype(np.float32) for f in FLAGS) / np.float32(len(FLAGS))
        return np.float32(WEIGHTS["material"]) * like + np.float32(WEIGHTS["flags"]) * flags + np.float32(WEIGHTS["precision"]) * near(q, p, "grade", 2.0)

    return {
        ("main", "length"): lambda q, p: np.float32(WEIGHTS["diameter"]) * size(q, p, "main") + np.float32(WEIGHTS["length"]) * size(q, p, "length"),
        ("material", "like", *FLAGS, "grade"): kind,
        ("holes", "threads"): lambda q, p: np.float32(WEIGHTS["holes"]) * count(q, p, "holes") + np.float32(WEIGHTS["threads"]) * count(q, p, "threads"),
    }


TERMS = _terms()


def _different(x: dict[str, np.ndarray], columns: tuple[str, ...]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The different rows of some columns, and which of them each row has."""
    code = np.zeros(len(x["id"]), np.int64)
    for c in columns:
        values, place = np.unique(x[c], return_inverse=True)
        code = np.unique(code * len(values) + place, return_inverse=True)[1]
    _, first, place = np.unique(code, return_index=True, return_inverse=True)
    return {c: x[c][first] for c in columns}, place


def _tables(q: dict[str, np.ndarray], p: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each summand of the score its values for the different rows of either page, and which of these a query and a part have: pages have few different sizes, kinds and counts, pairs are many."""
    out = []
    for columns, term in TERMS.items():
        (a, i), (b, j) = _different(q, columns), _different(p, columns)
        out.append((term(a, b).astype(np.float32), i, j))
    return out


def _looked_up(tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: slice | np.ndarray, columns: slice | np.ndarray) -> np.ndarray:
    """Scores of all pairs of some queries and some parts in single precision, -1 where a count is missing."""
    return np.nan_to_num(sum(np.take(table[i[rows]], j[columns], axis=1) for table, i, j in tables), copy=False, nan=-1.0)


def _page_scores(q: dict[str, np.ndarray], p: dict[str, np.ndarray]) -> np.ndarray:
    """Scores of all pairs of two pages: the sum of pair_terms()."""
    return _looked_up(_tables(q, p), slice(None), slice(None))


def _reach(q: dict[str, np.ndarray], p: dict[str, np.ndarray], step: int) -> np.ndarray:
    """For each `step` queries of a page, which are alike, the parts of another page (true) that may reach the floor of some of them: of the queries only the ranges of sizes, grades and
    counts and the different materials and flags are looked at, of all steps at once."""
    cuts = np.arange(0, len(q["id"]), step)
    at = np.arange(len(q["id"])) // step
    bound = np.full((len(cuts), len(p["id"])), 1 + NEAR, np.float32)

    def outside(c: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How far parts are from a step's range (infinite if it has none), its least value, whether some of it is unknown."""
        low, high = np.fmin.reduceat(q[c], cuts)[:, None], np.fmax.reduceat(q[c], cuts)[:, None]
        return np.maximum(np.maximum(low - p[c], p[c] - high), 0), low, np.logical_or.reduceat(np.isnan(q[c]), cuts)[:, None]

    def shared(c: str, none: int | None = None) -> np.ndarray:
        """Whether some query of a step has a part's value."""
        values, place = np.unique(np.concatenate([q[c], p[c]]), return_inverse=True)
        has = np.zeros((len(cuts), len(values)), bool)
        has[at, place[: len(at)]] = True
        if none is not None:
            has[:, values == none] = False
        return has[:, place[len(at) :]]

    for c, name in (("main", "diameter"), ("length", "length")):
        gap, _, unknown = outside(c)
        like = np.nan_to_num(np.exp(gap * np.float32(-1 / TAU)), nan=0.5)
        bound -= np.float32(WEIGHTS[name]) * (1 - np.where(unknown, np.maximum(like, np.float32(0.5)), like))
    # no material at all is equal to none: nulls have one number, as in _page_scores()
    like = np.where(shared("material"), np.float32(MATERIAL[0]), np.where(shared("like", 0), np.float32(MATERIAL[1]), np.float32(MATERIAL[2])))
    bound -= np.float32(WEIGHTS["material"]) * (1 - like)
    for f in FLAGS:
        bound -= np.float32(WEIGHTS["flags"] / len(FLAGS)) * ~shared(f)
    bound -= np.float32(WEIGHTS["precision"]) * (1 - np.exp(outside("grade")[0] * np.float32(-0.5)))
    for c in ("holes", "threads"):
        gap, low, _ = outside(c)
        bound -= np.float32(WEIGHTS[c]) * np.nan_to_num(gap / np.maximum(np.maximum(low, p[c]), 1), nan=0.0)
    return bound >= np.minimum.reduceat(q["floor"], cuts)[:, None]


def _in_reach(q: dict[str, np.ndarray], p: dict[str, np.ndarray]) -> np.ndarray:
    """Places in a page of the parts that may reach the floor of some of the queries."""
    return np.flatnonzero(_reach(q, p, len(q["id"]))[0])


def _alike(q: dict[str, np.ndarray]) -> np.ndarray:
    """An order of a page's queries in which neighbours have the same material, flags and grade; unknown sizes, whose floors are low, stand apart."""
    return np.lexsort([q["floor"], q["grade"], *[q[f] for f in FLAGS], q["material"], *[np.isnan(q[c]) for c in ("threads", "holes", "length", "main")]])


def _meeting(most: int, seeds: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over pairs of pages (columns q_* and p_*). seeds: for each query of the page the score that `most` parts of the other page reach (-1: none). Else the
    pairs at or above a query's floor (column `floor`), without those that `most` vectors of the page surpass."""

    def side(batch: pa.RecordBatch, i: int, prefix: str) -> dict[str, np.ndarray]:
        return {n[2:]: batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in batch.schema.names if n.startswith(prefix) and pa.types.is_list(batch.schema.field(n).type)}

    def least(s: np.ndarray, n: np.ndarray) -> np.ndarray:
        best = np.argpartition(-s, most - 1, axis=1)[:, :most] if s.shape[1] > most else np.argsort(-s, axis=1)
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1), 1)
        reached = np.cumsum(n[best], axis=1) >= most
        value = np.take_along_axis(s, best[np.arange(len(s)), reached.argmax(axis=1)][:, None], 1)[:, 0]
        return np.where(reached.any(axis=1), value, np.float32(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, p = side(batch, i, "q_"), side(batch, i, "p_")
                if not seeds:  # a page's sizes are near each other: its queries by what else they have, so that those met at once are alike
                    alike = _alike(q)
                    q = {c: v[alike] for c, v in q.items()}
                tables, steps = _tables(q, p), [slice(k, k + STEP) for k in range(0, len(q["id"]), STEP)]
                if seeds:
                    floors = np.concatenate([least(_looked_up(tables, step, slice(None)), p["n"]) for step in steps])
                    yield pa.RecordBatch.from_pydict({"page": pa.array([batch.column("page")[i].as_py()], pa.int64()), "floor": pa.array([floors], pa.list_(pa.float32()))})
                    continue
                out: list[tuple] = [(q["id"][:0], p["id"][:0], np.zeros(0, np.float32))]
                for step, near in zip(steps, _reach(q, p, STEP)):
                    at = np.flatnonzero(near)
                    if not len(at):
                        continue
                    s = _looked_up(tables, step, at)
                    floor = q["floor"][step]
                    if s.shape[1] > most:
                        floor = np.maximum(floor, np.partition(s, -most, axis=1)[:, -most])
                    a, b = np.nonzero(s >= (floor - np.float32(NEAR))[:, None])
                    out.append((q["id"][step][a], p["id"][at][b], s[a, b]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["_v", "_p", "s"])

    return run


def nearest(queries: DataFrame, parts: DataFrame, most: int, min_similarity: float) -> DataFrame:
    """Pairs (_v, _p) of numbered vectors of one shape class, among them all whose score is among a query's `most` best (parts counted by the size of `ids`), up to ties
    in four places, and min_similarity or more.

    Pages of queries meet pages of parts. The nearest page of parts gives each query a score that its best surpass, and other pages are met only where their sizes allow
    the least such score of the page; of such a page, the parts that sizes, material, flags, grade and counts allow it to some of STEP queries, taken in the order of these. Every page is met by a task of its own, so that memory is that of two pages; the work is quadratic only where sizes rule out nothing.
    """
    spark = queries.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = scratch.written(_pages(queries, "_v"), "query-pages")
    p = scratch.written(_pages(parts.withColumn("n", F.size("ids").cast("float")), "_p", "n"), "part-pages")
    spans = lambda df, s: df.select(F.col("shape").alias("shape"), F.col("page").alias(f"{s}_page"), *[F.col(f"{n}_{c}").alias(f"{s}_{n}_{c}") for c in ("main", "length") for n in ("min", "max", "none")])

    def reach(c: str) -> Column:
        gap = F.greatest(F.col(f"q_min_{c}") - F.col(f"p_max_{c}"), F.col(f"p_min_{c}") - F.col(f"q_max_{c}"), F.lit(0.0))
        return F.greatest(F.exp(-gap / TAU), F.when(F.col(f"q_none_{c}") | F.col(f"p_none_{c}"), 0.5).otherwise(0.0))

    # ranges of pages are few: one row for each 2 ** PAGE vectors
    pairs = spans(q, "q").join(F.broadcast(spans(p, "p")), "shape").withColumn("reach", 1 - WEIGHTS["diameter"] * (1 - reach("main")) - WEIGHTS["length"] * (1 - reach("length")))
    pairs = pairs.where(F.col("reach") >= min_similarity - NEAR)
    apart = F.abs(F.col("q_min_main") - F.col("p_min_main")) + F.abs(F.col("q_min_length") - F.col("p_min_length"))
    first = pairs.groupBy("q_page").agg(F.max_by("p_page", F.struct("reach", -F.coalesce(apart, F.lit(0.0)))).alias("p_page"))
    named = lambda df, s: df.select(F.col("page").alias(f"{s}_page"), *[F.col(f.name).alias(f"{s}_{f.name}") for f in df.schema if f.dataType.typeName() == "array"])

    def met(x: DataFrame, asked: DataFrame, seeds: bool, schema: str) -> DataFrame:
        rows = x.select("q_page", "p_page").join(named(asked, "q").hint("merge"), "q_page").withColumnRenamed("q_page", "page").join(named(p, "p").hint("merge"), "p_page")
        return rows.repartition(tasks, "page", "p_page").mapInArrow(_meeting(most, seeds), schema)

    floors = scratch.written(met(first, q, True, "page long, floor array<float>"), "floors")
    floors = floors.withColumn("floor", F.transform("floor", lambda s: F.greatest(s, F.lit(min_similarity).cast("float"))))
    near = pairs.join(floors.select(F.col("page").alias("q_page"), F.array_min("floor").alias("least")), "q_page").where(F.col("reach") >= F.col("least") - NEAR)
    found = met(near, q.join(floors, "page"), False, "_v long, _p long, s float")
    # what no page alone rules out: below the score that `most` vectors reach
    last = Window.partitionBy("_v").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return found.withColumn("at", F.nth_value("s", most).over(last)).where(F.col("at").isNull() | (F.col("s") >= F.col("at") - NEAR)).select("_v", "_p")


def find_similar(queries: DataFrame, parts: DataFrame, keys: list[str], params: Params = DEFAULT, exclude_self: bool = False) -> DataFrame:
    """keys, part_id, rank, score and score_breakdown of the best parts for each query (SI-01 to SI-03, SI-06).

    queries: keys and a vector; parts: vectors. Order: score, then part_id. Scores are rounded to 4 places.

    Different vectors are compared once each: of parts with equal vectors the first top_k + 1 ids count, so that equal parts, however many, meet nobody.
    Queries with top_k + 1 equal parts look up what scores 1; the others meet the parts in pages (nearest()). A part of another shape class scores OTHER_SHAPE at most;
    only where min_similarity is below that, classes meet each other, in a turn of their own.
    """
    most = params.top_k + 1
    named = lambda df: df.withColumn("_h", F.md5(F.to_json(F.struct(*FIELDS))))
    first = Window.partitionBy("_h").orderBy("part_id")
    p = named(parts).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    p = scratch.written(p.groupBy("_h", *FIELDS).agg(F.array_sort(F.collect_list("part_id")).alias("ids")).withColumn("_p", F.monotonically_increasing_id()), "vectors")
    asked = named(queries)
    numbered = scratch.written(asked.select("_h", *FIELDS).dropDuplicates(["_h"]).withColumn("_v", F.monotonically_increasing_id()), "queries")
    asked = asked.select(*keys, "_h").join(numbered.select("_h", "_v"), "_h").drop("_h")
    vectors = numbered.drop("_h")
    terms = pair_terms()
    total = sum((WEIGHTS[k] * t for k, t in terms.items()), F.lit(0.0))
    best = Window.partitionBy("_v").orderBy(F.desc("score"), "part_id")

    def scored(pairs: DataFrame, least: float, factor: float = 1.0) -> DataFrame:
        x = pairs.where(total * factor >= least - SLACK).select("q._v", F.col("p.ids").alias("ids"), F.round(total * factor, 4).alias("score"), *[F.round(t, 4).alias(f"t_{k}") for k, t in terms.items()])
        x = x.where(F.col("score") >= params.min_similarity)
        return x.withColumn("part_id", F.explode("ids")).drop("ids").withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= most)

    full = numbered.join(p.where(F.size("ids") == most).select("_h"), "_h", "left_semi").drop("_h")
    p = p.drop("_h")
    same = scratch.written(scored(candidates(full, p, 0.0), 1.0).where("score >= 1"), "similar")
    open_ = scratch.written(vectors.join(full.select("_v"), "_v", "left_anti"), "open")
    near = scratch.written(nearest(open_, p, most, params.min_similarity), "near")
    met = near.join(open_.hint("merge").alias("q"), "_v").join(p.hint("merge").alias("p"), "_p")
    found = [same, scored(met, params.min_similarity)]
    if params.min_similarity <= OTHER_SHAPE:
        apart = vectors.alias("q").join(p.alias("p"), ~F.col("q.shape_class").eqNullSafe(F.col("p.shape_class")))
        found.append(scored(apart, params.min_similarity, OTHER_SHAPE))
    all_ = found[0]
    for f in found[1:]:
        all_ = all_.unionByName(f)
    # the best of each query: its own part is no match of its
    x = asked.select(*[F.col(k).alias(k if k != "part_id" else "query_id") for k in keys], "_v").join(all_.drop("_rank"), "_v")
    out_keys = [k if k != "part_id" else "query_id" for k in keys]
    x = x.where(F.col("query_id").isNull() | (F.col("query_id") != F.col("part_id"))) if exclude_self and "part_id" in keys else x
    top = x.withColumn("rank", F.row_number().over(Window.partitionBy(*out_keys).orderBy(F.desc("score"), "part_id"))).where(F.col("rank") <= params.top_k)
    breakdown = F.map_from_arrays(F.array(*[F.lit(k) for k in terms]), F.array(*[F.col(f"t_{k}") for k in terms]))
    return top.select(*out_keys, "part_id", "rank", "score", breakdown.alias("score_breakdown"))


def nearest_cost(rows: DataFrame, costs: DataFrame, keys: list[str], qty: str, value: str = "unit_cost", name: str = "ref") -> DataFrame:
    """rows with the cost of the same part at the nearest quantity; ties to the lower cost (SI-04, SI-05)."""
    near = F.struct(F.abs(costs["qty"] - rows[qty]), costs[value])
    found = rows.join(costs, "part_id").groupBy(*keys, "part_id").agg(F.min_by(F.struct(costs["qty"].alias("qty"), costs["plant"].alias("plant"), costs[value].alias("value")), F.struct(near, costs["plant"])).alias(name))
    return rows.join(found, [*keys, "part_id"], "left")


def reference_costs(similar: DataFrame, part_costs: DataFrame, history: DataFrame, keys: list[str], qty: str) -> DataFrame:
    """similar with ref_unit_cost, ref_qty, ref_plant: the nearest recorded cost, else the nearest quoted price."""
    with_cost = nearest_cost(similar, part_costs, keys, qty, "unit_cost", "c")
    both = nearest_cost(with_cost, history, keys, qty, "unit_price", "h")
    ref = F.coalesce("c", "h")
    return both.withColumns({"ref_unit_cost": ref["value"], "ref_qty": ref["qty"], "ref_plant": ref["plant"]}).drop("c", "h")


def reuse_hints(similar: DataFrame, vectors: DataFrame) -> DataFrame:
    """VA-16: most similar parts that are nearly the same: score, same known material, and main sizes within REUSE_DIFFERENCE.

    The difference of a size, (larger - smaller) / larger, comes back from its term of the score, which has four places.
    """
    m = vectors.select("part_id", "material_code")
    x = similar.where((F.col("rank") == 1) & (F.col("score") >= REUSE_SCORE)).join(m.toDF("part_id", "theirs"), "part_id").join(m.toDF("query_id", "mine"), "query_id").where("mine = theirs")
    gap = lambda term: F.when(term <= 0, 1.0).otherwise(1 - F.exp(TAU * F.ln(term)))
    most = F.greatest(*[gap(F.col("score_breakdown")[k]) for k in ("diameter", "length")])
    return x.withColumn("largest_difference", most).where(F.col("largest_difference") < REUSE_DIFFERENCE).select("query_id", "part_id", "score", "largest_difference")
