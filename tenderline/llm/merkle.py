"""Merkle manifest of a dataset: a postorder append log of 8-ary trees, and proofs addressed in it by position.

Rows are leaves. Each language has a tree of its own over its leaves by doc_id; the tree roots are the leaves of one tree above them.
At each level, runs of 8 nodes become one (the last run has fewer, perhaps one), until one is left; a lone leaf is its own root.

Builders take aligned blocks of 8**4 leaves, so that a block is a whole subtree (the last one of a tree is smaller), and append its nodes in
the order of their completion: postorder, in which the nodes of a subtree are neighbours and its root is the last of them. The top
of each block goes on to a builder of the next tier. No builder holds more than a block, however large a tree is.

The log has a row for each run of neighbours: (tree, pos, digests), pos being that of its last node. A node's position follows
from sizes of subtrees alone: the nodes completed before its first leaf, and its own subtree. So a proof asks the log for its siblings by
equal positions; those within a block lie in the block's own row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tenderline.llm.lines import dense_rank
from tenderline.llm.storage import store

WIDTH, BLOCK_LEVELS = 8, 4
BLOCK = WIDTH**BLOCK_LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DIGEST = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (lower-case hex) of the fields one after another: `-` if null, else byte count, `:` and value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def parent(run: list[bytes]) -> bytes:
    """Digest of a run of digests, which are hashed as hex text."""
    return hashlib.sha256(b"".join(run).hex().encode()).digest()


def depth_of(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // WIDTH), levels + 1
    return levels


def subtree_size(level: int, j: int, n: int) -> int:
    """Nodes of the subtree whose root is node j of a level, in a tree of n leaves."""
    return sum(-(-min((j + 1) * WIDTH**level, n) // WIDTH**m) - j * WIDTH ** (level - m) for m in range(level + 1))


def position(level: int, j: int, n: int, depth: int) -> int:
    """Place in the log (from 0) of node j of a level: nodes complete before its first leaf, then its subtree, of which it is the last."""
    first = j * WIDTH**level
    return sum(first // WIDTH**m for m in range(depth + 1)) + subtree_size(level, j, n) - 1


def append_log(leaves: list[bytes], levels: int) -> tuple[list[int], list[bytes]]:
    """(levels, digests) of the nodes of the subtree `levels` high over the leaves, in the order of completion."""
    at, log = [], []
    open_runs: list[list[bytes]] = [[] for _ in range(levels + 1)]

    def add(level: int, digest: bytes) -> None:
        while True:
            at.append(level)
            log.append(digest)
            open_runs[level].append(digest)
            if level == levels or len(open_runs[level]) < WIDTH:
                return
            digest, open_runs[level] = parent(open_runs[level]), []
            level += 1

    for leaf in leaves:
        add(0, leaf)
    for level in range(levels):  # the last run of each level may be short
        if open_runs[level]:
            run, open_runs[level] = open_runs[level], []
            add(level + 1, parent(run))
    return at, log


def number_leaves(leaves: DataFrame, tree: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Stored leaves with `i` (place in their tree, from 0) and `n` (leaves of it), and (tree, n) of each tree; trees may be named null.

    Rows are ranked over the whole table in ranges of equal size, so a tree of any size is spread over all tasks; equal rows too.
    """
    ranked = store(dense_rank(leaves.withColumn("_tie", F.monotonically_increasing_id()), [tree, *order, "_tie"], "_rank").drop("_tie"), "ranked")
    trees = store(ranked.groupBy(tree).agg(F.count("*").alias("n"), F.min("_rank").alias("_first")), "trees")
    at = trees.withColumnRenamed(tree, "_t")
    placed = ranked.join(at, ranked[tree].eqNullSafe(at["_t"])).withColumn("i", F.col("_rank") - F.col("_first")).drop("_t", "_rank", "_first")
    return store(placed, "leaves"), trees.select(tree, "n")


def _builder(base: int) -> Callable[[pa.Table], pa.Table]:
    """Writes the rows of the log for one block of nodes of level `base`."""

    def write(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("j")
        tree, n, block = rows["tree"][0].as_py(), rows["n"][0].as_py(), rows["j"][0].as_py() // BLOCK
        depth = depth_of(n)
        levels, digests = append_log(rows["digest"].to_pylist(), min(BLOCK_LEVELS, depth - base))
        if not base:
            spots, parts = [position(levels[-1], block, n, depth)], [b"".join(digests)]
        else:  # the nodes of the tier below are there already
            counts, spots, parts = {m: block * WIDTH ** (BLOCK_LEVELS - m) for m in range(1, BLOCK_LEVELS + 1)}, [], []
            for m, digest in zip(levels, digests):
                if m:
                    spots.append(position(base + m, counts[m], n, depth))
                    parts.append(digest)
                    counts[m] += 1
        last = [k == len(spots) - 1 for k in range(len(spots))]
        tops = [x and base + levels[-1] == depth for x in last]
        same = {c: pa.array([v] * len(spots), pa.int64()) for c, v in (("tree", tree), ("n", n), ("j", block))}
        return pa.table({"tree": same["tree"], "n": same["n"], "pos": pa.array(spots, pa.int64()), "digests": pa.array(parts, pa.binary()), "top": tops, "j": same["j"], "last": last})

    return write


def build(leaves: DataFrame) -> DataFrame:
    """Log (tree, pos, digests, top) of the trees of `leaves` (tree long, n, i, digest binary); `top` marks the row that ends with a root.

    Tier 0 writes the whole subtree of each block as one row; the tiers above write a row for each node.
    """
    tiers, level = [], 0
    work = leaves.select("tree", "n", F.col("i").alias("j"), "digest")
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        tier = work.groupBy("tree", F.expr(f"j div {BLOCK}")).applyInArrow(_builder(level), "tree long, n long, pos long, digests binary, top boolean, j long, last boolean")
        tier = store(tier, "log", dictionary=False)
        tiers.append(tier.select("tree", "pos", "digests", "top"))
        level += BLOCK_LEVELS
        if most <= WIDTH**level:
            break
        work = tier.where("last and not top").select("tree", "n", "j", F.expr(f"substring(digests, -{DIGEST}, {DIGEST})").alias("digest"))
    log = tiers[0]
    for t in tiers[1:]:
        log = log.unionByName(t)
    return log


def _upper_path(log: DataFrame, blocks: DataFrame) -> DataFrame:
    """blocks (tree, block, n) with `segment`, their row of the log, and `upper`: (level, slot in the run, own) and the digests of the whole runs
    on the way from a block's top to the root, fetched by position. A run has WIDTH nodes at most and a way few levels."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("tree", "block", "n", "level", "slot", "pos")}
            for tree, block, n in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n"))):
                depth = depth_of(n)
                top = min(BLOCK_LEVELS, depth)
                wanted = [(-1, 0, position(top, block, n, depth))]
                for level in range(top, depth):
                    run, count = block // WIDTH ** (level - top) // WIDTH, -(-n // WIDTH**level)
                    wanted += [(level, j % WIDTH, position(level, j, n, depth)) for j in range(run * WIDTH, min((run + 1) * WIDTH, count))]
                for level, slot, pos in wanted:
                    for c, v in zip(out, (tree, block, n, level, slot, pos)):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})

    asked = blocks.select("tree", "block", "n").mapInArrow(ask, "tree long, block long, n long, level long, slot long, pos long")
    found = asked.join(log, ["tree", "pos"])
    digest = F.expr(f"substring(digests, -{DIGEST}, {DIGEST})")
    upper = F.sort_array(F.collect_list(F.when(F.col("level") >= 0, F.struct("level", "slot", digest.alias("digest")))))
    return found.groupBy("tree", "block", "n").agg(F.max(F.when(F.col("level") < 0, F.col("digests"))).alias("segment"), upper.alias("upper"))


def _ways(segment: bytes, upper: list[dict], block: int, n: int, leaves: list[int]) -> Iterator[list[tuple[int, list[bytes]]]]:
    """For each leaf of a block its way to the root: at each level its slot in its run and the run's other digests. Nodes are found by position."""
    depth = depth_of(n)
    top = min(BLOCK_LEVELS, depth)
    start = position(top, block, n, depth) + 1 - len(segment) // DIGEST
    runs: dict[tuple[int, int], list[bytes]] = {}
    above: dict[int, list[bytes]] = {}
    for node in upper:
        above.setdefault(node["level"], []).append(node["digest"])
    for i in leaves:
        way = []
        for level in range(depth):
            j = i // WIDTH**level
            if level < top:
                run = runs.get((level, j // WIDTH))
                if run is None:
                    first = j // WIDTH * WIDTH
                    spots = [DIGEST * (position(level, k, n, depth) - start) for k in range(first, min(first + WIDTH, -(-n // WIDTH**level)))]
                    run = runs[level, j // WIDTH] = [segment[s : s + DIGEST] for s in spots]
            else:
                run = above[level]
            way.append((j % WIDTH, run[: j % WIDTH] + run[j % WIDTH + 1 :]))
        yield way


def fold(leaf: bytes, way: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for slot, others in way:
        leaf = parent([*others[:slot], leaf, *others[slot:]])
    return leaf


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, log, trees): leaves (FIELDS but the text, leaf, tampered, tree, i, n), the log of all trees, and trees (tree, lang, subroot, i).

    tree is the place of a language among all (null first, then by bytes), from 0; tree -1 is that of the roots.
    Leaves of one doc_id follow each other by digest; null ids come first. `tampered` is the digest with A-Z of the text lower-cased.
    """
    fields = [F.col(f) for f in FIELDS]
    changed = [*fields[:-1], F.translate(F.col("text").cast("string"), UPPER, LOWER)]
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.unhex(leaf_digest(fields)).alias("digest"), F.unhex(leaf_digest(changed)).alias("tampered"))
    leaves, sizes = number_leaves(store(rows, "digests", dictionary=False), "lang", ["doc_id", "digest"])
    names = store(dense_rank(sizes, ["lang"], "tree").withColumn("tree", F.col("tree").cast("long") - 1), "names")
    at = names.select(F.col("lang").alias("_l"), "tree")
    leaves = store(leaves.join(at, leaves["lang"].eqNullSafe(at["_l"])).drop("_l"), "leaves", dictionary=False)
    log = build(leaves)
    tops = log.where("top").select("tree", F.expr(f"substring(digests, -{DIGEST}, {DIGEST})").alias("subroot"))
    trees = store(names.join(tops, "tree").select("tree", "lang", "subroot"), "trees")
    n_trees = trees.count()
    above = trees.select(F.lit(-1).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("i"), F.col("subroot").alias("digest"))
    log = log.unionByName(build(above)) if n_trees else log
    return leaves, log.select("tree", "pos", "digests", "top"), trees


def _contexts(leaves: DataFrame, log: DataFrame, trees: DataFrame) -> DataFrame:
    """Per block of leaves: its segment, its way above, its tree's root, and the block and slot of that root among the roots, with their ways."""
    blocks = leaves.groupBy("tree", F.expr(f"i div {BLOCK}").alias("block")).agg(F.first("n").alias("n"))
    n_trees = trees.count()
    up = trees.select(F.lit(-1).cast("long").alias("tree"), F.expr(f"tree div {BLOCK}").alias("block"), F.lit(n_trees).cast("long").alias("n")).distinct()
    over = _upper_path(log, up).select(F.col("block").alias("top_block"), F.col("n").alias("n_trees"), F.col("segment").alias("top_segment"), F.col("upper").alias("top_upper"))
    root = log.where("top and tree = -1").select(F.col("tree").alias("_roots"), F.expr(f"substring(digests, -{DIGEST}, {DIGEST})").alias("root"))
    roots = trees.select("tree", "subroot", F.lit(-1).cast("long").alias("_roots"), F.expr(f"tree div {BLOCK}").alias("top_block")).join(over, "top_block").join(root, "_roots")
    return _upper_path(log, blocks).join(roots, "tree")


def proofs(leaves: DataFrame, log: DataFrame, trees: DataFrame, full: bool = False) -> DataFrame:
    """A proof for each row of `leaves` (of all, or of those asked for): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The siblings, level by level up to the subtree's root and on to the root, are hashed to proof_sha256; the tampered leaf is folded with them.
    With `full` the siblings are given too: `siblings`, an array of (slot, others) for each level.
    """
    kind = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    kind += ", siblings array<struct<slot: int, others: array<string>>>" if full else ""

    def extract(key: tuple, rows: pa.Table, context: pa.Table) -> pa.Table:
        c = context.to_pylist()[0]
        root = c["root"]
        (top,) = _ways(c["top_segment"], c["top_upper"], c["top_block"], c["n_trees"], [key[0].as_py()])
        above = b"".join(x for _, others in top for x in others).hex().encode()
        digests, tampered = rows["digest"].to_pylist(), rows["tampered"].to_pylist()
        out: dict[str, list] = {f.split()[0]: [] for f in ("proof_sha256", "folded_root", "verified")}
        siblings = []
        ways = _ways(c["segment"], c["upper"], key[1].as_py(), c["n"], rows["i"].to_pylist())
        for leaf, way in zip(tampered, ways):
            out["proof_sha256"].append(hashlib.sha256(b"".join(x for _, others in way for x in others).hex().encode() + above).hexdigest())
            end = fold(leaf, way + top)
            out["folded_root"].append(end.hex())
            out["verified"].append(end == root)
            if full:
                siblings.append([{"slot": s, "others": [x.hex() for x in others]} for s, others in way + top])
        n = rows.num_rows
        data = {"doc_id": rows["doc_id"].cast(pa.int64()), "leaf": [x.hex() for x in digests], "subroot": [c["subroot"].hex()] * n, "root": [root.hex()] * n, **out}
        if full:
            data["siblings"] = pa.array(siblings, pa.list_(pa.struct([("slot", pa.int32()), ("others", pa.list_(pa.string()))])))
        return pa.table(data)

    asked = leaves.select("tree", F.expr(f"i div {BLOCK}").alias("block"), "doc_id", "i", "digest", "tampered")
    contexts = _contexts(leaves, log, trees)
    return asked.groupBy("tree", "block").cogroup(contexts.groupBy("tree", "block")).applyInArrow(extract, kind)


def audit(docs: DataFrame) -> DataFrame:
    """Each row of docs (FIELDS) with its leaf, subroot, root and proof, and whether its text, tampered with where 3 divides the checksum of doc_id, verifies.

    Nulls in any field have their own mark in the leaf; a null language has a tree of its own, which comes first. A null doc_id comes first in its tree and
    is not tampered with. Repeated rows are leaves of their own. An empty table has no rows. Other columns are ignored.
    """
    leaves, log, trees = manifest(docs)
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return proofs(leaves.withColumn("tampered", F.when(third, F.col("tampered")).otherwise(F.col("digest"))), log, trees)
