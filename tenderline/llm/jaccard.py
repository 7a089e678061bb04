"""Jaccard join of shingle sets: count vectors in R-trees, bounded by summed coordinate minima.

The tokens of a document (hashes of its distinct shingles) are hashed into groups; the counts of its groups are a point, and two documents share at most the
sum over the coordinates of the smaller count. Sets of n and m tokens are linked if 100 * shared >= percent * union, which takes
(100 + percent) * shared >= percent * (n + m): so whole boxes of points, then pairs of points, are ruled out by their coordinates before any set is read.

Partitions of the index. Linked sets differ in few tokens, D at most, which follows from their sizes. The groups of documents of similar size are dealt to more than D blocks, so that
linked documents agree on all tokens of some block: the hash of a block's tokens is a partition of the index, and only points of one partition meet. Blocks without tokens are no partition unless
too few of a document's blocks have tokens. This loses no link: of D + 1 blocks with tokens one is untouched by D differences. Documents of equal sets are one class and
one point, so exact copies meet nobody.

In each partition all points are bounded against one of them first, survivors are verified, and what is linked is joined to components. Where a partition still
holds several components, its points are packed into boxes (by component, then size and coordinates), and boxes into pages of bounded size. Pairs of pages, of boxes and of points are
followed down only where the bound allows a link between different components. Points in boxes are folded to COARSE groups; survivors meet on all groups, then on their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tenderline.llm.lines import dense_rank
from tenderline.llm.neardup import components
from tenderline.llm.storage import store
from tenderline.llm.text import LOWER, SOLID, flat, mix, shingle_hashes, slices, word_hashes

WORDS, PERCENT = 4, 85
#: Points of a box, and of a page (which is what one task row holds; two pages meet in one row).
BOX, PAGE = 32, 512
#: Groups of the points in boxes, at most; pairs that they allow meet on all groups, then on their sets.
COARSE = 256
#: Least partitions of a class that its points carry: a pair with a lesser one in common is met there.
KEYS = 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def levels(largest: int, percent: int) -> np.ndarray:
    """Bounds of the size levels: linked sets lie in one level or in neighbouring ones."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * 100 // percent + 1)
    return np.array([*out, out[-1] * 100 // percent + 1], np.int64)


def differences(n: int, m: int, percent: int) -> int:
    """The most tokens in which linked sets of n and m tokens may differ."""
    return (n + m) * (100 - percent) // (100 + percent)


def partitions(tokens: np.ndarray, bounds: np.ndarray, percent: int) -> np.ndarray:
    """The partitions of a set: for its own size level and the one below, the hashes of its blocks."""
    own = int(np.searchsorted(bounds, len(tokens), "right")) - 1
    spread = mix(tokens * _GOLD)
    found = []
    for level in range(max(own - 1, 0), own + 1):
        most = differences(int(bounds[level + 1]) - 1, int(bounds[level + 2]) - 1, percent)
        blocks = most + 1 + most // 16 + 2
        block = ((tokens >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        sums = np.zeros(blocks, np.uint64)
        np.add.at(sums, block.astype(np.int64), spread)
        keys = mix(sums ^ mix(np.arange(blocks, dtype=np.uint64) + np.uint64(level << 32)))
        filled = np.bincount(block.astype(np.int64), minlength=blocks) > 0
        found.append(keys[filled] if filled.sum() > most else keys)
    return np.concatenate(found)


def point(tokens: np.ndarray) -> np.ndarray:
    """Counts of the tokens in groups; the number of groups is the power of two next to half the set's size, so that points of similar sets can be folded to one length."""
    size = max(16, 1 << max(0, int(len(tokens) // 2 - 1).bit_length()))
    group = (tokens * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - (size.bit_length() - 1))
    return np.bincount(group.astype(np.int64), minlength=size).astype(np.uint32)


def fold(p: np.ndarray, size: int) -> np.ndarray:
    """The point with neighbouring groups summed up, down to `size` of them."""
    return p if len(p) == size else p.reshape(size, -1).sum(1).astype(p.dtype)


def packed(p: np.ndarray) -> bytes:
    """A point in the least number of bytes for each count, which comes first."""
    width = 1 if p.max() < 1 << 8 else 2 if p.max() < 1 << 16 else 4
    return bytes([width]) + p.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The point of packed() bytes, which are odd in number, or of plain ones."""
    if len(data) % 2 == 0:
        return np.frombuffer(data, np.uint32)
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.uint32)


def reach(shared: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """Whether sets of n and m tokens that share `shared` of them, or no more than that, can be linked."""
    return (100 + percent) * shared >= percent * (n + m)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[pa.Array]]]:
    """Batches with the tokens of each text, sorted, and the two columns of 128-bit digests of the sets."""
    for batch in slices(batches, size=1 << 20):
        data, offsets = flat(batch.column("text"))
        hashes, rows = word_hashes(LOWER[data], offsets, SOLID)
        sets = shingle_hashes(hashes, rows, len(offsets) - 1, words)
        with np.errstate(over="ignore"):
            d1 = np.array([mix(x.sum(keepdims=True) + np.uint64(len(x)))[0] for x in sets], np.uint64)
            d2 = np.array([mix(x ^ np.uint64(0x5A5A5A5A)).sum() for x in sets], np.uint64)
        yield batch, sets, [pa.array(d.view(np.int64)) for d in (d1, d2)]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (128-bit digest of the set)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets, digests in _sets(batches, words):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), *digests], names=["doc_id", "n_shingles", "d1", "d2"])

    return _texts(docs).mapInArrow(work, "doc_id long, n_shingles long, d1 long, d2 long")


def with_partitions(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """doc_id, d1, d2 and keys (the partitions of the set); no keys without shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = levels(1 << 12, percent)
        for batch, sets, digests in _sets(batches, words):
            largest = max(len(x) for x in sets)
            if largest >= bounds[-3]:
                bounds = levels(largest * 2, percent)
            with np.errstate(over="ignore"):
                keys = [partitions(x, bounds, percent) if len(x) else x for x in sets]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *digests, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))], names=["doc_id", "d1", "d2", "keys"])

    return _texts(docs).mapInArrow(work, "doc_id long, d1 long, d2 long, keys array<long>")


def read_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """c, n, tokens (sorted 64-bit values), point and coarse (the point on COARSE groups at most, packed) of classes (c, rep, d1, d2), read from the texts of their documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, digests in _sets(batches, words):
            points = [point(x) for x in sets]
            yield pa.RecordBatch.from_arrays([*digests, pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([x.tobytes() for x in points], pa.binary()), pa.array([packed(fold(x, min(len(x), COARSE))) for x in points], pa.binary())], names=["d1", "d2", "n", "tokens", "point", "coarse"])

    kept = _texts(docs).join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    read = kept.mapInArrow(work, "d1 long, d2 long, n long, tokens binary, point binary, coarse binary")
    return read.join(classes.select("c", "d1", "d2"), ["d1", "d2"]).select("c", "n", "tokens", "point", "coarse").dropDuplicates(["c"])


def _bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, pa, pb) those whose points allow a link."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist()):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            size = min(len(x), len(y))
            ok.append(bool(reach(int(np.minimum(fold(x, size), fold(y, size)).sum()), int(x.sum()), int(y.sum()), percent)))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], names=["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, ta, tb) those that are linked; rows come sorted by a, whose set is looked at once."""
    for batch in batches:
        ok, last, left = [], None, None
        for a, x, y in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb")):
            if a != last:
                last, left = a, np.frombuffer(x.as_buffer(), np.uint64)
            right = np.frombuffer(y.as_buffer(), np.uint64)
            shared = len(np.intersect1d(left, right, assume_unique=True))
            ok.append(bool(shared > 0 and reach(shared, len(left), len(right), percent)))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], names=["a", "b"])


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among pairs (a, b) of classes: points first, then whole sets of what is left."""
    points = sets.select("c", "point")
    met = pairs.join(points.toDF("a", "pa"), "a").join(points.toDF("b", "pb"), "b")
    pairs = store(met.select("a", "b", "pa", "pb").mapInArrow(lambda x: _bounded(x, percent), "a long, b long"), "bounded")
    whole = sets.select("c", "tokens")
    met = pairs.join(whole.toDF("b", "tb"), "b").join(whole.toDF("a", "ta"), "a").sortWithinPartitions("a").select("a", "b", "ta", "tb")
    return store(met.mapInArrow(lambda x: _verified(x, percent), "a long, b long"), "links")


class Box:
    """Points of one box: rows of the page, its upper corner, least size, and component if it has one only."""

    def __init__(self, page: Page, rows: slice) -> None:
        self.rows, self.top, self.low = rows, page.grid[rows].max(0), int(page.n[rows].min())
        comps = page.comp[rows]
        self.comp = int(comps[0]) if (comps == comps[0]).all() else None


class Page:
    """A page of points, folded to one number of groups, and its boxes."""

    def __init__(self, members: list[dict], points: list[np.ndarray], size: int, key: int) -> None:
        self.lesser = [{k for k in m["keys"] if k < key} for m in members]
        self.c, self.comp, self.n = (np.array([m[f] for m in members], np.int64) for f in ("c", "comp", "n"))
        self.grid = np.stack([fold(p, size) for p in points]).astype(np.int32)
        self.boxes = [Box(self, slice(k, min(k + BOX, len(members)))) for k in range(0, len(members), BOX)]


def _meet(x: Page, y: Page, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of two pages, or within one, that boxes and points allow, of different components, but for those that a lesser partition has too."""
    for i, one in enumerate(x.boxes):
        for other in y.boxes[i if x is y else 0 :]:
            if (one.comp is not None and one.comp == other.comp) or not reach(int(np.minimum(one.top, other.top).sum()), one.low, other.low, percent):
                continue
            for a in range(one.rows.start, one.rows.stop):
                first = max(other.rows.start, a + 1) if x is y else other.rows.start
                rows = slice(first, other.rows.stop)
                if first >= other.rows.stop:
                    continue
                near = (y.comp[rows] != x.comp[a]) & reach(np.minimum(x.grid[a], y.grid[rows]).sum(1), x.n[a], y.n[rows], percent)
                for b in np.flatnonzero(near) + first:
                    if not x.lesser[a].isdisjoint(y.lesser[b]):
                        continue
                    yield min(int(x.c[a]), int(y.c[b])), max(int(x.c[a]), int(y.c[b]))


def _search(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of the pages x and y (null: x alone) of partition `key` of each row; pairs that several rows of a batch give, once."""
    for batch in batches:
        found: set[tuple[int, int]] = set()
        for key, x, y in zip(batch.column("key").to_pylist(), batch.column("x"), batch.column("y")):
            both = [p for p in (x.as_py(), y.as_py()) if p is not None]
            points = [[unpacked(m["point"]) for m in p] for p in both]
            size = min(len(x) for p in points for x in p)
            pages = [Page(p, x, size, key) for p, x in zip(both, points)]
            found.update(_meet(pages[0], pages[-1], percent))
        pairs = np.array(list(found), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to pages their upper corner, on the fewest groups that a member has."""
    for batch in batches:
        tops = []
        for page in batch.column("members"):
            points = [unpacked(m["point"]) for m in page.as_py()]
            size = min(len(p) for p in points)
            tops.append(np.max([fold(p, size) for p in points], axis=0).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.binary())], names=[*batch.schema.names, "top"])


def _near_pages(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of pairs of pages those whose corners allow a link."""
    for batch in batches:
        ok = []
        for tx, ty, lx, ly in zip(*(batch.column(c).to_pylist() for c in ("tx", "ty", "lx", "ly"))):
            x, y = np.frombuffer(tx, np.uint32).astype(np.int64), np.frombuffer(ty, np.uint32).astype(np.int64)
            size = min(len(x), len(y))
            ok.append(bool(reach(int(np.minimum(fold(x, size), fold(y, size)).sum()), lx, ly, percent)))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("key", "px", "py")], names=["key", "px", "py"])


def tree_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (key, c, comp, n, point) of one partition (key) and of different components whose points allow a link, each once.

    The points of a partition are packed PAGE at a time by component, size and coordinates: their places come from a window, which sorts on disk. Corners of pages meet first; pages are fetched for
    the pairs of pages that are left. A pair is given where it is met first, in the least partition that both are in: of that, points carry the least KEYS of their own.
    """
    rows = rows.withColumn("keys", F.slice(F.array_sort(F.collect_set("key").over(Window.partitionBy("c"))), 1, KEYS))
    place = F.floor((F.row_number().over(Window.partitionBy("key").orderBy("comp", "n", "point", "c")) - 1) / PAGE)
    grouped = rows.withColumn("page", place).groupBy("key", "page").agg(F.collect_list(F.struct("c", "comp", "n", "point", "keys")).alias("members"), F.min("n").alias("low"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    members = grouped.schema["members"].dataType
    kind = f"key long, page long, members {members.simpleString()}, low long, c0 long, c1 long, top binary"
    pages = store(grouped.mapInArrow(_tops, kind), "pages", dictionary=False)
    heads = pages.drop("members")
    x, y = heads.select("key", *[F.col(c).alias(d) for c, d in zip(("page", "top", "low", "c0", "c1"), ("px", "tx", "lx", "x0", "x1"))]), heads.select("key", *[F.col(c).alias(d) for c, d in zip(("page", "top", "low", "c0", "c1"), ("py", "ty", "ly", "y0", "y1"))])
    alike = "x0 = x1 and y0 = y1 and x0 = y0"
    near = x.join(y, "key").where(f"px < py and not ({alike})").select("key", "px", "py", "tx", "ty", "lx", "ly").mapInArrow(lambda b: _near_pages(b, percent), "key long, px long, py long")
    whole = pages.select("key", "page", "members")
    two = near.join(whole.toDF("key", "px", "x"), ["key", "px"]).join(whole.toDF("key", "py", "y"), ["key", "py"]).select("key", "x", "y")
    one = pages.where("c0 <> c1").select("key", F.col("members").alias("x"), F.lit(None).cast(members).alias("y"))
    return store(one.unionByName(two).mapInArrow(lambda b: _search(b, percent), "a long, b long").distinct(), "tree_pairs")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (a number for each different set) of every row of docs (doc_id, text).

    Words are what stands between white space, A-Z lower-cased; shingles have `words` words, and a text of fewer is one shingle. Documents link if
    100 * shared >= percent * union; component_id is the least doc_id that links lead to. Null and wordless texts have no shingle and are linked with
    nothing; a null doc_id is linked with nothing, its component is null. Rows of one doc_id are one document, which is linked with whatever any of its texts is.
    An empty table has no rows; other columns are ignored.
    """
    found = store(profiles(docs, words), "profiles", dictionary=False)
    full = found.where("n_shingles > 0 and doc_id is not null")
    named = store(dense_rank(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), ["d1", "d2"], "c").select("d1", "d2", "rep", F.col("c").cast("long").alias("c")), "classes")
    members = store(full.select("doc_id", "n_shingles", "d1", "d2").join(named.drop("rep"), ["d1", "d2"]).select("doc_id", "n_shingles", "c"), "members")
    # one document of each class gives its partitions; those that no other class is in go where they arrive, in the one shuffle by partition
    firsts = with_partitions(docs, percent, words).join(named.withColumnRenamed("rep", "doc_id").hint("shuffle_hash"), ["doc_id", "d1", "d2"])
    per = Window.partitionBy("key")
    spread = firsts.select("c", F.explode("keys").alias("key")).withColumns({"a": F.min("c").over(per), "z": F.max("c").over(per)})
    met = store(spread.where("a < z").select("key", "c", "a").distinct(), "shared", dictionary=False)  # repeated rows of a document give its keys again
    # near copies share many partitions: of those with the same members one is enough
    members_of = met.groupBy("key").agg(F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"), F.count("*").alias("m"), F.first("a").alias("a"))
    once = store(members_of.groupBy("x", "y", "m", "a").agg(F.min("key").alias("key")).select("key"), "once", dictionary=False)
    met = store(met.join(once, "key"), "met", dictionary=False)
    sets = store(read_sets(docs, named.join(met.select("c").distinct(), "c", "left_semi"), words), "sets", dictionary=False)
    own = members.groupBy("doc_id").agg(F.min("c").alias("a"), F.max("c").alias("z")).where("a < z").select("doc_id", "a")
    texts = members.join(own, "doc_id").select("a", F.col("c").alias("b")).where("a <> b").distinct()
    tried = met.where("a <> c").select("a", F.col("c").alias("b")).distinct()
    links = store(verify(tried, sets, percent).unionByName(texts), "links")
    comp = components(links).toDF("c", "comp")
    at = met.select("key", "c").join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    several = at.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    at = store(at.join(several, "key"), "open", dictionary=False)
    more = verify(tree_pairs(at.join(sets.select("c", "n", F.col("coarse").alias("point")), "c"), percent), sets, percent)
    comp = components(store(links.unionByName(more), "links")).toDF("c", "comp")
    placed = store(members.join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c")), "placed")
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = placed.join(least, "comp").select("doc_id", "n_shingles", "component_id", F.col("c").alias("class_id"))
    alone = found.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_id"))
    return linked.unionByName(alone)
