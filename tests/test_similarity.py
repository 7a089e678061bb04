"""The pruned similarity join against all pairs, and vectors of drawings against those of part rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderline.operators import similarity as sim
from tenderline.params import Params

KIND = "part_id long, shape_class string, main_mm double, length_mm double, material_code string, mat_group string, n_holes int, n_threads int, has_keyway boolean, has_gear boolean, has_heat boolean, has_surface boolean, min_it int"


def score(q, p):
    """A pair's score, from the weights as published: 20, 15, 15, 10, 10, 15, 15 of a hundred."""
    size = lambda a, b: math.exp(-abs(math.log(a / b)) / 0.35) if (a or 0) > 0 and (b or 0) > 0 else 0.5
    count = lambda a, b: 1 - abs(a - b) / max(a, b, 1)
    like = 1.0 if q[4] == p[4] else 0.7 if q[5] is not None and q[5] == p[5] else 0.3
    grade = lambda x: 12 if x is None else x
    s = 0.2 * size(q[2], p[2]) + 0.15 * size(q[3], p[3]) + 0.15 * like + 0.1 * count(q[6], p[6]) + 0.1 * count(q[7], p[7]) + 0.15 * sum(a == b for a, b in zip(q[8:12], p[8:12])) / 4 + 0.15 * math.exp(-abs(grade(q[12]) - grade(p[12])) / 2)
    return s * (1.0 if q[1] == p[1] else 0.3)


def rows(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        code = rng.choice([None, "A", "B", "C", "D"])
        out.append((i, rng.choice(["rotational", "rotational", "prismatic", None]), rng.choice([None, 0.0, rng.uniform(1, 900), 20.0]), rng.choice([None, rng.uniform(5, 50), 100.0]), code, {"A": "steel", "B": "steel", "C": "alu"}.get(code), rng.choice([0, 1, 5, 40]), rng.choice([0, 2]), rng.random() < 0.3, rng.random() < 0.1, rng.random() < 0.5, False, rng.choice([None, 5, 6, 9, 12, 19])))
    return out


def best(queries, parts, params, own):
    """All pairs; a score so near a rounding step that engines may differ is left to either."""
    out = {}
    for q in queries:
        found = sorted(((-round(score(q, p), 4), p[0]) for p in parts if not (own and p[0] == q[0]) and round(score(q, p), 4) >= params.min_similarity))
        out[q[0]] = [(p, -s) for s, p in found[: params.top_k]]
    return out


@pytest.mark.parametrize("least", [0.5, 0.25, 0.8])
def test_same_rows_as_all_pairs(spark, least):
    data = rows(160) + [(1000 + k, *rows(160)[7][1:]) for k in range(30)]
    df = spark.createDataFrame(data, KIND)
    params = Params(min_similarity=least)
    got = {}
    for r in sim.find_similar(df, df, ["part_id"], params, exclude_self=True).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["part_id"], r["score"]))
    want = best(data, data, params, own=True)
    assert got == {k: v for k, v in want.items() if v}


def test_foreign_queries_keep_all_parts(spark):
    parts = spark.createDataFrame(rows(60), KIND)
    asked = [(r[0] + 5, 1, *r) for r in rows(20, seed=8)]
    queries = spark.createDataFrame(asked, "rfq_id long, line_no int, " + KIND)
    got = {}
    for r in sim.find_similar(queries, parts, ["rfq_id", "line_no"]).orderBy("rfq_id", "rank").collect():
        got.setdefault(r["rfq_id"], []).append((r["part_id"], r["score"]))
    want = best([a[2:] for a in asked], rows(60), Params(), own=False)
    assert got == {k + 5: v for k, v in want.items() if v}
    assert sim.find_similar(queries.where("false"), parts, ["rfq_id", "line_no"]).collect() == []


def test_candidates_hold_all_pairs_within_the_loss(spark):
    data = rows(120, seed=5)
    df = spark.createDataFrame(data, KIND).withColumn("_v", F.col("part_id"))
    for loss in (0.04, 0.13, 0.3):
        pairs = [(r["a"], r["b"]) for r in sim.candidates(df.withColumnRenamed("part_id", "a"), df.withColumnRenamed("part_id", "b"), loss).select("q.a", "p.b").collect()]
        want = {(q[0], p[0]) for q in data for p in data if q[1] == p[1] and score(q, p) >= 1 - loss}
        assert len(pairs) == len(set(pairs)) and want <= set(pairs)
        assert loss > 0.2 or len(pairs) < len(data) ** 2 / 10


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_pages_hold_the_best_and_few_others(spark, monkeypatch, least):
    monkeypatch.setattr(sim, "PAGE", 4)
    data = rows(160, seed=6)
    df = spark.createDataFrame(data, KIND)
    got = {(r["_v"], r["_p"]) for r in sim.nearest(df.withColumnRenamed("part_id", "_v"), df.select(F.col("part_id").alias("_p"), F.array("part_id").alias("ids"), *sim.FIELDS), 4, least).collect()}
    for q in data:
        s = sorted((score(q, p) for p in data if p[1] == q[1]), reverse=True)
        assert {p[0] for p in data if p[1] == q[1] and score(q, p) >= max(s[:4][-1], least)} <= {p for v, p in got if v == q[0]}
    assert len(got) < len(data) ** 2 / 10


def test_sizes_rule_out_parts_of_a_page():
    """Of a page of many lengths few parts are left for queries of near sizes, and all that reach a floor; unknown sizes too."""
    rng = np.random.default_rng(5)

    def page(n, low, high):
        x = {"id": np.arange(n), "main": rng.uniform(3.0, 3.1, n).astype(np.float32), "length": rng.uniform(low, high, n).astype(np.float32), "grade": rng.integers(5, 8, n).astype(np.float32), "holes": rng.integers(0, 2, n).astype(np.float32), "threads": np.zeros(n, np.float32), "material": rng.integers(0, 2, n), "like": np.ones(n, np.int64)}
        x["length"][:: n // 8] = np.nan
        return x | {f: np.zeros(n, np.int64) for f in sim.FLAGS}

    parts = page(800, 2.0, 7.0)
    for queries in (page(16, 4.0, 4.1), {k: v[1:2] for k, v in page(16, 4.0, 4.1).items()}):
        queries["floor"] = np.full(len(queries["id"]), 0.95, np.float32)
        near = sim._page_scores(queries, parts) >= 0.95
        at = sim._in_reach(queries, parts)
        assert near.any() and set(np.flatnonzero(near.any(0))) <= set(at)
    assert len(at) < 200  # a query of known size


def test_queries_met_at_once_are_alike(spark, monkeypatch):
    """Few pairs are scored once materials, flags, grades and counts bound them too, and none that counts is left out."""
    rng = np.random.default_rng(4)
    n = 3000
    at = lambda k: rng.integers(0, k, n)
    page = {"id": np.arange(n), "main": np.log(50 + at(3)).astype(np.float32), "length": np.log(60 + at(4)).astype(np.float32), "grade": (5 + at(2)).astype(np.float32), "holes": at(9).astype(np.float32), "threads": at(9).astype(np.float32), "material": at(7), "like": np.zeros(n, int), **{f: at(2) for f in sim.FLAGS}}
    page["like"] = page["material"] // 3
    page["main"][::50], page["holes"][::70] = np.nan, np.nan
    scores = sim._page_scores(page, page)
    page["floor"] = np.partition(scores, -4, axis=1)[:, -4]
    order = sim._alike(page)
    met = 0
    for k in range(0, n, sim.STEP):
        own = order[k : k + sim.STEP]
        reach = sim._in_reach({c: v[own] for c, v in page.items()}, page)
        met += len(reach)
        wanted = np.flatnonzero((scores[own] >= (page["floor"][own] - sim.NEAR)[:, None]).any(axis=0))
        assert set(wanted) <= set(reach)
    assert met < 0.6 * n * (n / sim.STEP)


def test_scores_are_looked_up_by_what_differs():
    """A page's scores come from tables of its different sizes, kinds and counts, far smaller than its pairs."""
    rng = np.random.default_rng(6)
    n = 600
    page = {"id": np.arange(n), "main": np.log(5 + rng.integers(0, 6, n)).astype(np.float32), "length": np.log(20 + rng.integers(0, 9, n)).astype(np.float32), "grade": rng.integers(5, 8, n).astype(np.float32), "holes": rng.integers(0, 5, n).astype(np.float32), "threads": rng.integers(0, 5, n).astype(np.float32), "material": rng.integers(0, 3, n), "like": np.ones(n, np.int64)} | {f: rng.integers(0, 3, n) // 2 for f in sim.FLAGS}
    page["main"][::40], page["holes"][::90] = np.nan, np.nan
    assert sum(t.size for t, _, _ in sim._tables(page, page)) < n * n / 10
    s = sim._page_scores(page, page)
    flag = lambda i: [page[f][i] for f in sim.FLAGS]
    for i, j in rng.integers(0, n, (200, 2)):
        row = lambda i: (0, "x", *[None if np.isnan(page[c][i]) else math.exp(page[c][i]) for c in ("main", "length")], page["material"][i], "g", page["holes"][i], page["threads"][i], *flag(i), page["grade"][i])
        assert s[i, j] == (-1 if np.isnan(page["holes"][[i, j]]).any() else pytest.approx(score(row(i), row(j)), abs=1e-5))
