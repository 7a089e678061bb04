"""Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderline.llm import jaccard
from tenderline.llm.storage import reachable

KIND = "doc_id long, text string"


@pytest.fixture(autouse=True)
def _reach(spark):
    reachable(spark)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set()


def brute(rows, percent=85):
    sets = [(d, shingles(t)) for d, t in rows]
    ids = sorted({d for d, _ in rows if d is not None})
    up = {d: d for d in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    by_token = {}
    for k, (d, s) in enumerate(sets):
        for t in s:
            by_token.setdefault(t, []).append(k)
    for k, (d, s) in enumerate(sets):
        if d is None:
            continue
        for j in {j for t in s for j in by_token[t] if j < k}:
            e, o = sets[j]
            if e is not None and 100 * len(s & o) >= percent * len(s | o):
                a, b = sorted((top(d), top(e)))
                up[b] = a
    return sorted(((d, len(s), (top(d) if s else d) if d is not None else None) for d, s in sets), key=repr)


def rows_of(df, **kw):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, **kw).collect()), key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 5))) for _ in range(500)]
    out = []
    for _ in range(n):
        out.append([rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 8, 12, 30, 60, 150, 400]))])
    for _ in range(n * 2):
        copy = list(rng.choice(out))
        for _ in range(rng.randint(0, max(1, len(copy) // 25))):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(copy[rng.randint(0, max(0, len(copy) // 12)) :])
    return [" ".join(x) if k % 5 else "  ".join(x).upper() for k, x in enumerate(out)]


@pytest.mark.parametrize("percent", [50, 85, 97])
def test_linked_sets_share_a_partition(percent):
    rng = np.random.default_rng(percent)
    bounds = jaccard.levels(1 << 12, percent)
    found = 0
    for _ in range(2500):
        n = int(rng.integers(1, 40) if rng.random() < 0.5 else rng.integers(40, 900))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        keep = a[rng.random(len(a)) >= rng.uniform(0, 0.3) * (100 - percent) / 50]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(a) * (100 - percent) // 100)), dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if not len(b) or not jaccard.reach(shared, len(a), len(b), percent):
            continue
        found += 1
        with np.errstate(over="ignore"):
            assert set(jaccard.partitions(a, bounds, percent).tolist()) & set(jaccard.partitions(b, bounds, percent).tolist())
        x, y = jaccard.point(a), jaccard.point(b)
        size = min(len(x), len(y))
        assert np.minimum(jaccard.fold(x, size), jaccard.fold(y, size)).sum() >= shared
    assert found > 300


def test_components_equal_all_pairs(spark):
    texts = [*corpus(4), "", None, " \t\n", "one", "ONE", "one two three", "Å b c d e"]
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, "x"), (3, texts[3]), (3, "another text of document three here"), (900, "another text of document three here"), (901, " ".join(str(k) for k in range(60_000)))]
    df = spark.createDataFrame(rows, KIND).withColumns({"key": F.lit("x"), "c": F.lit(1), "comp": F.lit(None).cast("string")})
    assert rows_of(df) == brute(rows)


def test_dense_group_near_the_threshold(spark):
    """Variants of one text, most of them linked with it or with nothing: boxes and pages of several components."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for d in range(700):
        text = list(base)
        for k in rng.sample(range(200), rng.choice([1, 2, 3, 4, 5, 6, 8, 10])):
            text[k] = f"v{rng.randrange(10**6)}"
        rows.append((d, " ".join(text)))
    assert rows_of(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_tree_pairs_are_those_the_bound_allows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAGE", 40)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 90, replace=False), rng.integers(0, 1 << 63, int(k % 9), dtype=np.uint64)])) for k in range(130)]
    points = [jaccard.point(x) for x in sets]
    rows = [(7, k, k // 50, len(x), points[k].tobytes()) for k, x in enumerate(sets)] + [(9, k, k // 50, len(x), points[k].tobytes()) for k, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "key long, c long, comp long, n long, point binary")
    want = {(a, b) for a in range(130) for b in range(a + 1, 130) if a // 50 != b // 50 and jaccard.reach(int(np.minimum(points[a], points[b]).sum()), len(sets[a]), len(sets[b]), 85)}
    got = [(r["a"], r["b"]) for r in jaccard.tree_pairs(df, 85).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_boxes_rule_out_sets_that_share_two_thirds(spark):
    """Sets of 1,500 tokens that share two in three aren't linked, and the points in boxes say so; points survive packing, whatever their counts."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    texts = [(k, " ".join([*(f"b{i}" for i in range(1_005)), *(f"v{rng.integers(1 << 40)}" for _ in range(500))])) for k in range(30)]
    sets = jaccard.read_sets(spark.createDataFrame(texts, KIND), jaccard.profiles(spark.createDataFrame(texts, KIND), 4).select(F.col("doc_id").alias("c"), F.col("doc_id").alias("rep"), "d1", "d2"), 4)
    rows = sets.select(F.lit(7).cast("long").alias("key"), "c", F.col("c").alias("comp"), "n", F.col("coarse").alias("point"))
    assert rows.count() == 30 and jaccard.tree_pairs(rows, 85).count() == 0
    for top in (3, 300, 70_000):
        x = np.append(jaccard.point(base)[:-1], top).astype(np.uint32)
        assert jaccard.unpacked(jaccard.packed(x)).tolist() == x.tolist() == jaccard.unpacked(x.tobytes()).tolist()


def test_empty_table(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], KIND)).collect() == []
