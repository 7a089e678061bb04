"""Merkle manifest against trees built one node after another."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tenderline.llm import merkle
from tenderline.llm.storage import reachable

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def _reach(spark):
    reachable(spark)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def way(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 8 * 8
        out.append((i % 8, [x for k, x in enumerate(level[first : first + 8]) if k != i % 8]))
        i //= 8
    return out


def leaf(row):
    return H(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.FIELDS])


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels_of([y[2] for y in sorted(by[x], key=lambda y: y[:3])]) for x in langs}
    above = levels_of([trees[x][-1][0] for x in langs])
    out = []
    for t, lang in enumerate(langs):
        for i, (known, doc_id, own, r) in enumerate(sorted(by[lang], key=lambda y: y[:3])):
            path = way(trees[lang], i) + way(above, t)
            now = own
            if known and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                text = r["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
                now = leaf({**r, "text": text})
            for slot, others in path:
                now = H(*others[:slot], now, *others[slot:])
            out.append((r["doc_id"], own, trees[lang][-1][0], above[-1][0], H(*[x for _, o in path for x in o]), now, now == above[-1][0]))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in merkle.audit(df).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 511, 513, 600])
def test_positions_are_those_of_the_log(n):
    leaves = [hashlib.sha256(bytes([k % 251, k // 251])).digest() for k in range(n)]
    depth = merkle.depth_of(n)
    at, log = merkle.append_log(leaves, depth)
    seen = dict.fromkeys(range(depth + 1), 0)
    for pos, level in enumerate(at):
        assert merkle.position(level, seen[level], n, depth) == pos
        seen[level] += 1
    assert log[-1].hex() == levels_of([x.hex() for x in leaves])[-1][0]


def test_audit_equals_trees_built_in_memory(spark):
    data = [(k, f"Text {k} Ä" if k % 7 else None, ["en", "de", None, "zz", "é"][k % 5], None if k % 11 == 0 else "s", k) for k in range(150)]
    data += [(3, "Text 3 Ä", "zz", "s", 3)] * 20 + [(3, "other", "zz", "s", 3), (None, "NULL id", "en", "s", None), (None, "", "en", None, None), (9, "x" * 300_000, "de", "s", 1), (10**12, "alone", "only", "s", 1)]
    df = spark.createDataFrame(data, KIND)
    assert rows_of(df.withColumns({"tree": F.lit(5), "i": F.lit("x"), "n": F.lit(None), "digest": F.lit(0)})) == brute([r.asDict() for r in df.collect()])


def test_more_than_a_block(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("T"), "id").alias("text"), F.lit("a").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    assert rows_of(df) == brute([r.asDict() for r in df.collect()])


def test_empty_table_and_full_proofs(spark):
    empty = spark.createDataFrame([], KIND)
    assert merkle.audit(empty).collect() == []
    one = spark.createDataFrame([(k, "T", "a", "s", 1) for k in range(10)], KIND)
    leaves, log, trees = merkle.manifest(one)
    for r in merkle.proofs(leaves.where("doc_id < 3"), log, trees, full=True).collect():
        now = r["leaf"]
        for level in r["siblings"]:
            now = H(*level["others"][: level["slot"]], now, *level["others"][level["slot"] :])
        assert now == r["root"] and H(*[x for s in r["siblings"] for x in s["others"]]) == r["proof_sha256"]
