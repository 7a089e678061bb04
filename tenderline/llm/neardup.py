"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

Documents of equal shingle sets are one class; classes are banded, and links between classes are confirmed on whole sets.
Members of buckets of up to SMALL classes are all compared. Within a larger bucket, members are compared with one of them only, another one in each turn;
members that are connected by then need no further comparison with each other, so groups of many near copies don't give pairs of all with all. If many pairs
of such buckets in different components are left after a turn, members with a rare shingle in common are compared, and those are dropped that cannot be linked
with any other, as their shingles that aren't rare are too few. Once the pairs left are few (two for each row of the buckets), or a turn has not halved them,
or after MAX_TURNS, all that are left are compared, each in the least bucket that it has in common, so no pair of a common bucket that could be a
link is left out.

A pair's signatures are compared in batches. After n of them with m agreements the similarity has a Beta(m + 1, n - m + 1)
posterior (uniform prior); the pair is dropped once the probability that it reaches the threshold is below `miss`. Survivors are
verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenderline.llm.storage import store
from tenderline.llm.text import LOWER, SOLID, flat, mix, shingle_hashes, slices, word_hashes

#: A link of similarity 0.75 is in no common bucket with probability (1 - 0.75**5)**36 = 5.8e-5.
ROWS, BANDS = 5, 36
BATCH, MISS = 20, 1e-5
#: Ids that are sent to all tasks (8 bytes each); more of them are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: Classes of a bucket that are all compared with each other; turns of larger ones, at most.
SMALL, MAX_TURNS = 5, 12
RARE_SLOTS = 16
#: Columns of a pair: two classes, and the components they are in.
PAIR = ["a", "b", "ca", "cb"]
_RNG = np.random.default_rng(77)
MULTIPLIERS = _RNG.integers(1, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADDENDS = _RNG.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)


def sets_of(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles."""
    data, offsets = flat(texts)
    words, rows = word_hashes(LOWER[data], offsets, SOLID)
    return shingle_hashes(words, rows, len(offsets) - 1, width)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (128-bit digest of the set), keys (a bucket for each band), sig (16 bits for each hash)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_hashes = len(MULTIPLIERS)
        for batch in slices(batches, size=1 << 20):
            sets = sets_of(batch.column("text"))
            sizes = np.array([len(s) for s in sets])
            filled = np.flatnonzero(sizes)
            least = np.zeros((len(filled), n_hashes), np.uint32)
            digests = np.zeros((2, len(sets)), np.uint64)
            if len(filled):
                values = np.concatenate([sets[r] for r in filled])
                starts = np.cumsum(sizes[filled]) - sizes[filled]
                small = (values >> np.uint64(32)).astype(np.uint32)
                for j in range(n_hashes):
                    least[:, j] = np.minimum.reduceat(small * MULTIPLIERS[j] + ADDENDS[j], starts)
                digests[0, filled] = mix(np.add.reduceat(values, starts) + sizes[filled].astype(np.uint64))
                digests[1, filled] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5)), starts)
            band = np.zeros((len(filled), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
            for j in range(ROWS):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + least[:, j * BANDS : (j + 1) * BANDS])
            ends = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
            short = (mix(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
            sigs: list[bytes | None] = [None] * len(sets)
            for i, r in enumerate(filled):
                sigs[r] = short[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(band.ravel().view(np.int64))), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "keys", "sig"],
            )

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(work, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, sig binary")


def least_agreements(n: int, threshold: float, miss: float) -> int:
    """The least m of n agreements at which P(similarity >= threshold) is `miss` or more.

    That probability is the Beta(m + 1, n - m + 1) tail, equal to that of at most m successes in n + 1 draws of chance `threshold`.
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _bayes(batches: Iterator[pa.RecordBatch], threshold: float, miss: float) -> Iterator[pa.RecordBatch]:
    """Of pairs (PAIR, sa, sb) those that their signatures leave."""
    n_hashes = ROWS * BANDS
    needed = {n: least_agreements(n, threshold, miss) for n in range(BATCH, n_hashes + 1, BATCH)}
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, n_hashes) for c in ("sa", "sb"))
        alive, agreed = np.arange(len(a)), np.zeros(len(a), np.int64)
        for n, m in needed.items():
            agreed[alive] += (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(1)
            alive = alive[agreed[alive] >= m]
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in PAIR], names=PAIR)


def _exact(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    memo: dict[int, np.ndarray] = {}
    for batch in slices(batches, "tb", 1 << 20):
        left = batch.column("a").to_pylist()
        ok = []
        others = sets_of(batch.column("tb"))
        texts = batch.column("ta")
        for r, a in enumerate(left):
            if a not in memo:  # rows come sorted by a
                memo = {a: sets_of(texts.slice(r, 1))[0]}
            x, y = memo[a], others[r]
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("ca", "cb")], names=["a", "b"])


def pruned(both: DataFrame, percent: int, miss: float) -> DataFrame:
    """Of pairs of classes (a, b) in components (ca, cb), with signatures (sa, sb), those that the signatures leave."""
    return both.select(*PAIR, "sa", "sb").mapInArrow(lambda x: _bayes(x, percent / 100, miss), "a long, b long, ca long, cb long")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int = 75, miss: float = MISS) -> DataFrame:
    """Of pairs of classes (a, b) in components (ca, cb) the components (a, b) that a link joins: Bayesian pruning on signatures, then whole sets."""
    sig = classes.select("rep", "sig")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")
    return confirmed(store(pruned(both, percent, miss), "survivors"), docs, percent)


def confirmed(left: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of pairs of classes (a, b) in components (ca, cb) the components (a, b) that a link joins, on whole sets."""
    ids = left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = F.broadcast(ids) if left.count() * 2 <= BROADCAST_IDS else ids
    texts = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "texts")
    whole = left.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a").sortWithinPartitions("a").select(*PAIR, "ta", "tb")
    return store(whole.mapInArrow(lambda x: _exact(x, percent), "a long, b long").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in links (a, b): the least id it is connected with.

    In each round an id with a smaller neighbour goes to the least one, these steps are followed to their ends, and only different links between different ends
    stay. The larger id of every link goes, and links within what has met go with it, so a group's links meet labels once instead of in each round.
    """
    smaller = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = store(smaller.distinct(), "edges")
    out = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("comp", F.col("id"))
    followed = lambda to: to.join(to.toDF("end", "next"), "end", "left").select("id", F.coalesce("next", "end").alias("end"))
    while edges.limit(1).count():
        to = store(edges.groupBy("a").agg(F.min("b").alias("end")).withColumnRenamed("a", "id"), "steps")
        while to.select(F.col("end").alias("id")).join(to, "id", "left_semi").limit(1).count():
            to = store(followed(followed(to)), "steps")
        a, b = (F.coalesce(f"end_{c}", c) for c in ("a", "b"))
        met = edges.join(to.toDF("a", "end_a"), "a").join(to.toDF("b", "end_b"), "b", "left").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        edges = store(met.where("a <> b").distinct(), "edges")
        out = out.join(to.toDF("comp", "end"), "comp", "left").select("id", F.coalesce("end", "comp").alias("comp"))
    return store(out, "label")


def linkable(rows: DataFrame, sizes: DataFrame, docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of bucket rows (key, rep): those whose class may be linked with another of its bucket, and pairs beside them; exact together.

    A shingle is rare if each of RARE_SLOTS slots that its classes fall into by hash has two at most: first and last of a slot are
    all of them then. Classes with a rare shingle in common are given as pairs (a, b). All others share none, so that a class of n
    shingles, c of them not rare, shares at most min(c, d) with one of m and d, and is linked only if
    (100 + percent) * min(c, d) >= percent * (n + m). Rows (key, rep, n, c) stay that can be linked even with the bucket's smallest class.
    """
    ids = store(rows.select(F.col("rep").alias("doc_id")).distinct(), "open_ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1 << 20):
            sets = sets_of(batch.column("text"))
            owners = np.repeat(batch.column("doc_id").to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(owners), pa.array(np.concatenate(sets).view(np.int64))], names=["rep", "h"])

    slots = texts.mapInArrow(work, "rep long, h long").groupBy("h", F.pmod(F.xxhash64("rep"), F.lit(RARE_SLOTS)).alias("slot")).agg(F.count("*").alias("n"), F.min("rep").alias("x"), F.max("rep").alias("y"))
    by_shingle = slots.groupBy("h").agg(F.max("n").alias("most"), F.array_distinct(F.flatten(F.collect_list(F.array("x", "y")))).alias("reps")).where("most <= 2")
    rare = store(by_shingle.select("reps"), "rare")
    counts = rare.select(F.explode("reps").alias("rep")).groupBy("rep").agg(F.count("*").alias("rare"))
    bound = sizes.join(counts, "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("c"))
    at = store(rows.select("key", "rep").join(bound, "rep"), "bounded")
    kept = at.join(at.groupBy("key").agg(F.min("n").alias("m")), "key").where((100 + percent) * F.col("c") >= percent * (F.col("n") + F.greatest("m", "c")))
    several = rare.where(F.size("reps") > 1).distinct()
    pairs = several.select("reps", F.explode("reps").alias("a")).select("a", F.explode("reps").alias("b")).where("a < b").distinct()
    return store(kept.select("key", "rep", "n", "c"), "buckets"), pairs


def near_duplicates(docs: DataFrame, percent: int = 75, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id of every row of docs (doc_id, text).

    Words are what stands between white space, A-Z lower-cased; shingles have five words, and a text of fewer words is one
    shingle. Documents are linked if 100 * |intersection| >= percent * |union|; component_id is the least doc_id that links
    lead to, kept whether that is the document's own. Null and wordless texts have no shingle and are linked with nothing; a null
    doc_id is compared with nothing and kept, with null component; rows of one doc_id are one document.
    """
    sets = store(signatures(docs), "sets")
    full = sets.where("n_shingles > 0 and doc_id is not null")
    by_set = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    members = store(full.select("doc_id", "n_shingles", "d1", "d2").join(by_set, ["d1", "d2"]), "members")
    reps = members.where("doc_id = rep").select("rep", "d1", "d2").distinct()
    classes = store(full.join(reps.withColumnRenamed("rep", "doc_id"), ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "n_shingles", "sig", "keys"), "classes")
    rows = classes.select("rep", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rows = store(rows.join(shared, "key"), "buckets")  # of buckets with two classes or more

    def one_of(members: DataFrame, turn: int) -> DataFrame:
        """One member of each bucket, with its columns: by an order that a quarter of the buckets share, another one in each turn."""
        order = F.xxhash64("a", F.pmod("key", F.lit(4)), F.lit(turn))
        return members.groupBy("key").agg(F.min_by(F.struct(*[c for c in members.columns if c != "key"]), F.struct(order, "a")).alias("p")).select("key", "p.*")

    def merged(links: DataFrame, comp: DataFrame) -> DataFrame:
        """The components after links between them."""
        return store(comp.join(components(links).toDF("comp", "new"), "comp", "left").select("id", F.coalesce("new", "comp").alias("comp")), "comp")

    small = F.col("size") <= SMALL
    one = rows.withColumnRenamed("rep", "a")
    one = one.where(small).unionByName(one_of(one.where(~small), 1)).withColumnRenamed("size", "size_a")
    other = rows.select("key", F.col("rep").alias("b"))
    apart = F.when(F.col("size_a") <= SMALL, F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
    tested = store(one.join(other, (one["key"] == other["key"]) & apart).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    comp = merged(verify(tested.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), classes, docs, percent, miss), classes.select(F.col("rep").alias("id"), F.col("rep").alias("comp")))
    rows = rows.where(~small).drop("size")
    before, turn, bounded = math.inf, 1, False
    while True:
        at = rows.join(comp.toDF("rep", "comp"), "rep")
        counts = at.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own")).where("comps > 1")
        counts = store(counts, "open")
        at = store(at.join(counts.select("key"), "key"), "open")
        size = counts.agg(F.sum("n").alias("rows"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2).alias("cross")).first()
        if not size["rows"]:
            break
        many, last = size["cross"] > 2 * size["rows"], False
        if many and not bounded:
            rows, pairs = linkable(at, classes.select("rep", F.col("n_shingles").alias("n")), docs, percent)
            pairs = pairs.join(comp.toDF("a", "ca"), "a").join(comp.toDF("b", "cb"), "b").where("ca <> cb").select(*PAIR)
            bounded, before = True, math.inf
        else:
            # another turn pays only while turns halve what is left
            last = not many or size["cross"] > 0.5 * before or turn == MAX_TURNS - 1
            before, turn = size["cross"], turn + 1
            known = ["n", "c"] if bounded else []
            if last:  # the open buckets of each class, to take a pair in the first one only, and its signature, so that pairs need not look it up
                own = at.groupBy("rep").agg(F.collect_set("key").alias("keys")).join(classes.select("rep", "sig"), "rep")
                at = store(at.join(own, "rep"), "open")
                known = [*known, "keys", "sig"]
            one = at.select("key", F.col("rep").alias("a"), F.col("comp").alias("comp_a"), *[F.col(c).alias(f"{c}_a") for c in known])
            other = at.select("key", F.col("rep").alias("b"), F.col("comp").alias("comp_b"), *[F.col(c).alias(f"{c}_b") for c in known])
            fits = (100 + percent) * F.least("c_a", "c_b") >= percent * (F.col("n_a") + F.col("n_b")) if bounded else F.lit(True)
            if not last:
                one = one_of(one, turn)
            apart = (F.col("a") < F.col("b")) if last else F.col("a") != F.col("b")
            once = one["key"] == F.array_min(F.array_intersect("keys_a", "keys_b")) if last else F.lit(True)
            pairs = one.join(other, (one["key"] == other["key"]) & apart & (F.col("comp_a") != F.col("comp_b")) & fits & once)
            if last:
                met = pairs.select("a", "b", F.col("comp_a").alias("ca"), F.col("comp_b").alias("cb"), F.col("sig_a").alias("sa"), F.col("sig_b").alias("sb"))
                left = store(pruned(met, percent, miss).distinct().join(tested, ["a", "b"], "left_anti"), "survivors")
                comp = merged(confirmed(left, docs, percent), comp)
                break
            up = F.col("a") < F.col("b")
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(up, F.col("comp_a")).otherwise(F.col("comp_b")).alias("ca"), F.when(up, F.col("comp_b")).otherwise(F.col("comp_a")).alias("cb"))
        pairs = store(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        tested, comp = tested.unionByName(pairs.select("a", "b")), merged(verify(pairs, classes, docs, percent, miss), comp)
    linked = members.join(comp.toDF("rep", "component_id"), "rep").select("doc_id", "n_shingles", "component_id", F.col("rep").alias("class_id"))
    alone = sets.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    out = linked.unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")
