"""Components of links against union-find, and how many rows they and the pairs of near duplicates take."""

import random

import numpy as np
import pyarrow as pa

from tenderline.llm import jaccard, neardup


def least_reachable(links):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in list(up)}


def test_links_of_a_group_meet_labels_once(spark, monkeypatch):
    """A group of links between all, a chain, a star around its largest id and random links: links go once their ends have met."""
    rng = random.Random(8)
    links = [(a, b) for a in range(60) for b in range(a)] + [(k, k + 1) for k in range(100, 220)] + [(399, k) for k in range(300, 399)] + [tuple(rng.sample(range(500, 800), 2)) for _ in range(260)] + [(900, 901), (901, 900)]
    stored, plain = [], neardup.store
    monkeypatch.setattr(neardup, "store", lambda df, name, *a: stored.append((name, out := plain(df, name, *a))) or out)
    got = {r["id"]: r["comp"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == least_reachable(links)
    assert sum(t.count() for name, t in stored if name == "edges") <= 1.5 * len(links)
    assert neardup.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_last_turn_looks_up_no_signatures(spark, monkeypatch):
    """Of copies with 3 changed words of 150, of which few are linked, nearly all pairs are left at last: they come with their signatures."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    copies = []
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(150), 3):
            words[k] = f"v{rng.randrange(10**6)}"
        copies.append((i + 1, " ".join(words)))
    looked_up, plain = [], neardup.verify
    monkeypatch.setattr(neardup, "verify", lambda pairs, *a: looked_up.append(pairs.count()) or plain(pairs, *a))
    found = neardup.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string"))
    assert found.select("component_id").distinct().count() > 20
    assert sum(looked_up) < 24 * len(copies), looked_up


def test_pairs_of_several_partitions_are_given_by_the_least():
    """Points of two partitions: the second gives only pairs of which one is in the second alone, as its members tell."""
    point = np.full(16, 2, np.uint32).tobytes()
    member = lambda c, *keys: {"c": c, "comp": c, "n": 32, "point": point, "keys": list(keys)}
    kind = pa.list_(pa.struct([("c", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("point", pa.binary()), ("keys", pa.list_(pa.int64()))]))

    def pairs(key, x, y=None):
        batch = pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([x], kind), pa.array([y], kind)], names=["key", "x", "y"])
        return sorted((r["a"], r["b"]) for out in jaccard._search(iter([batch]), 85) for r in out.to_pylist())

    both = [member(c, -5, 9) for c in (1, 2)]
    assert pairs(-5, both) == [(1, 2)]
    assert pairs(9, [*both, member(3, 9)]) == [(1, 3), (2, 3)]
    assert pairs(9, both, [member(4, -5, 9), member(5, 9)]) == [(1, 5), (2, 5)]
