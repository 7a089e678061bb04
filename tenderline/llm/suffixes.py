"""Removes repeated byte strings with suffix arrays built by induced sorting.

Any two equal strings of `width` bytes hold the same minimiser (the GRAM-byte piece of least hash, the first of equals), at the same
place. Minimisers that occur once in the corpus are left out (a filter of fixed size tells most of them), the strings whose minimiser another
one is (its context, one piece of text; each string is in one context only) are gathered, equal contexts once each, and contexts with a longer piece in common meet in one shard. Each shard's suffix array
is built by induced sorting, and permuted common prefixes tell which strings of `width` bytes occur again; of each such class the first
occurrence (by document, then place) stays and the others are covered. Contexts that are repeated as a whole are covered at
once. So what is sorted grows with the distinct repeated text, not with its copies, and no shard holds more than a bounded number
of contexts of one key; keys beyond that (MAX_GROUP) are compared string by string with Spark's aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenderline.llm.storage import release, store
from tenderline.llm.text import flat, mix, powers_back, prefix_hash, slices, span_hash

WIDTH, GRAM = 100, 20
#: Bits of the filter of repeated minimisers, at most (32 MB; beyond 16 bits for each it only lets more through).
FILTER_BITS, SEGMENTS = 1 << 28, 256
#: Context bytes in a shard, about; contexts of one key that may meet in one shard.
SHARD, MAX_GROUP = 2 << 20, 10_000


# --- suffix arrays -------------------------------------------------------------------------------------------------


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """The suffix array of s (values 0 to k - 1) by induced sorting; the end counts as less than any value.

    Leftmost-smaller substrings are sorted by inducing, named, and the string of the names is sorted by the same function. Inducing works with whole
    arrays: by buckets where they are few for the length (bytes), by levels where they are many (names).
    """
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    s = s.astype(np.uint16 if k <= 1 << 16 else np.int32)
    induced = _by_buckets if n >= 64 * k else _by_levels
    change = np.flatnonzero(s[1:] != s[:-1])
    rises = np.append(s[change] < s[change + 1], False)  # the last run falls to the end
    small = np.repeat(rises, np.diff(np.concatenate([[-1], change, [n - 1]])))  # S-type: less than the suffix after it
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if not len(lms):
        return induced(s, k, lms, small)
    order = induced(s, k, lms, small)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]  # by leftmost-smaller substrings
    length = np.zeros(n, np.int32)  # of the substring up to the next leftmost-smaller value; 0 for the last one, which equals no other
    length[lms[:-1]] = np.diff(lms) + 1
    sizes = length[order]
    same = (sizes[1:] == sizes[:-1]) & (sizes[1:] > 0)
    alive = np.flatnonzero(same)
    a, b, size, j = order[alive], order[alive + 1], sizes[alive], 0
    while len(alive):
        keep = s[a + j] == s[b + j]
        same[alive[~keep]] = False
        j += 1
        keep &= size > j
        alive, a, b, size = alive[keep], a[keep], b[keep], size[keep]
    names = np.zeros(len(order), np.int32)
    names[1:] = np.cumsum(~same)
    by_place = np.empty(n, np.int32)
    by_place[order] = names
    reduced = by_place[lms]
    k2 = int(names[-1]) + 1
    if k2 == len(lms):
        return induced(s, k, order, small)
    return induced(s, k, lms[suffix_array(reduced, k2)], small)


def _by_levels(s: np.ndarray, k: int, seeds: np.ndarray, small: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the given order of leftmost-smaller ones induces, for many buckets.

    A level is what stands one further place before the suffixes that are in order already: all of it is put in at once.
    """
    seeds = seeds[np.argsort(s[seeds], kind="stable")]
    large = _put_in(s, seeds, np.append(np.int32(len(s)), seeds), ~small, False)
    large = large[~small[large]]
    return _put_in(s, large, large, small, True)


def _merged(at: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """old with new[i] put in before old[at[i]]; at is sorted."""
    place = at + np.arange(len(at))
    stay = np.ones(len(old) + len(new), bool)
    stay[place] = False
    out = np.empty(len(stay), old.dtype)
    out[stay], out[place] = old, new
    return out


def _put_in(s: np.ndarray, order: np.ndarray, begin: np.ndarray, kind: np.ndarray, last: bool) -> np.ndarray:
    """order (sorted suffixes) with those of `kind` that stand before `begin` (sorted too), and so on before these.

    Each goes to the bucket of its first value, by the place of the suffix after it; in a bucket, before the given ones, or after them (`last`).
    Levels get smaller; those that are small against the order are merged with each other first, and with the order at the end.
    """
    n = len(s)
    half = n + 2
    rank = np.zeros(n + 1, np.int64)  # of suffixes in order, from 1; 0 is the end
    new = np.zeros(len(order), bool)

    def before(begin: np.ndarray) -> np.ndarray:
        p = begin[begin > 0] - 1
        p = p[kind[p]]
        return p[np.argsort(s[p], kind="stable")]

    p, values = before(begin), s[order].astype(np.int64) * (2 * half)
    while len(p):
        places = np.arange(1, len(order) + 1)
        rank[order] = places
        keys = values + half * (new == last)
        keys[new] += rank[order[new] + 1]
        keys[~new] += places[~new]
        if 8 * len(p) < len(order):
            break
        mine = s[p].astype(np.int64) * (2 * half)
        to = np.searchsorted(keys, mine + rank[p + 1] + half * last)
        order, new, values = _merged(to, order, p), _merged(to, new, np.ones(len(p), bool)), _merged(to, values, mine)
        p = before(p)
    more = int(np.count_nonzero(kind) - np.count_nonzero(new)) + 2
    value = rank * more  # of a suffix that is not in order yet: that of the one before it there, and its place among such
    late, gap = p[:0], np.zeros(0, np.int64)
    while len(p):
        to = np.searchsorted(keys, s[p].astype(np.int64) * (2 * half) + value[p + 1] // more + half * last, "right")
        place = np.searchsorted(s[late].astype(np.int64) * (half * more) + value[late + 1], s[p].astype(np.int64) * (half * more) + value[p + 1])
        late, gap = _merged(place, late, p), _merged(place, gap, to)
        value[late] = gap * more + np.arange(1, len(late) + 1)
        p = before(p)
    return _merged(gap, order, late)


def _by_buckets(s: np.ndarray, k: int, seeds: np.ndarray, small: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the given order of leftmost-smaller ones induces, for few buckets.

    Buckets of equal first values are scanned one after another: entries that a bucket induces in itself come in waves, those for other buckets are dealt out in scan order.
    """
    n = len(s)
    seeds = seeds[np.argsort(s[seeds], kind="stable")]
    cuts = np.searchsorted(s[seeds], np.arange(k + 1))
    large: list[np.ndarray] = []
    parts: list[list[np.ndarray]] = [[] for _ in range(k)]
    parts[s[n - 1]].append(np.array([n - 1], np.int32))
    none = np.zeros(0, np.int32)

    def waves(found: list[np.ndarray], c: int, kind: bool) -> np.ndarray:
        own = found
        last = np.concatenate(own) if own else none
        out = [last]
        while len(last):
            p = last[last > 0] - 1
            last = p[s[p] == c]
            out.append(last)
        return np.concatenate(out) if len(out) > 1 else out[0]

    def deal(scan: np.ndarray, keep: np.ndarray, to: list) -> None:
        p = scan[keep]
        if not len(p):
            return
        t = s[p]
        o = np.argsort(t, kind="stable")
        p, t = p[o], t[o]
        heads = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        for i, h in enumerate(heads):
            to[t[h]].append(p[h : heads[i + 1] if i + 1 < len(heads) else len(p)])

    for c in range(k):
        mine = waves(parts[c], c, False)
        parts[c] = []
        large.append(mine)
        scan = np.concatenate([mine, seeds[cuts[c] : cuts[c + 1]]])
        p = scan[scan > 0] - 1
        deal(p, s[p] > c, parts)
    out: list[np.ndarray] = [none] * k
    for c in range(k - 1, -1, -1):
        mine = waves(parts[c], c, True)
        parts[c] = []
        out[c] = np.concatenate([large[c], mine[::-1]])
        scan = out[c][::-1]
        p = scan[scan > 0] - 1
        deal(p, (s[p] < c) & small[p], parts)
    return np.concatenate(out)


def common_prefixes(s: np.ndarray, order: np.ndarray, left: np.ndarray, least: int = 0) -> np.ndarray:
    """In the order of the suffixes: the bytes each has in common with the one before, up to its context's end; fewer, maybe, where less than `least` bytes are left.

    Computed in text order (permuted): a position whose predecessor's byte equals that of its neighbour's predecessor has one
    less than the position before; only the others are compared. left: bytes to the end of the position's context.
    """
    n = len(s)
    phi = np.full(n, -1, np.int32)
    phi[order[1:]] = order[:-1]
    at = np.arange(n, dtype=np.int32)
    plain = (phi > 0) & (at > 0)
    plain[plain] = s[at[plain] - 1] == s[phi[plain] - 1]
    plain &= np.append(False, left[1:] == left[:-1] - 1)  # not at a context's start
    irreducible = np.flatnonzero(~plain)
    value = np.zeros(n, np.int32)
    # seven values (of 9 bits) at a time; a context's end, 0, differs from all bytes and is cut off below
    packed = np.zeros(n, np.int64)
    for j in range(7):
        packed[: n - j] |= s[j:].astype(np.int64) << (9 * (6 - j))
    alive = irreducible[(phi[irreducible] >= 0) & (left[irreducible] >= least)]
    other, j = phi[alive], 0
    while len(alive):
        ends = np.maximum(alive, other) + j >= n
        differ = packed[np.minimum(alive + j, n - 1)] ^ packed[np.minimum(other + j, n - 1)]
        differ[ends] = -1
        same = differ == 0
        value[alive[same]] += 7
        rest = differ[~same]
        value[alive[~same]] += sum(((rest >> (9 * k)) == 0).astype(np.int32) for k in range(1, 7))
        same &= left[alive] > j + 7
        alive, other = alive[same], other[same]
        j += 7
    value = np.minimum(value, left)
    last = np.maximum.accumulate(np.where(plain, 0, at))
    out = np.maximum(value[last] - (at - last), 0)
    return out[order]


def repeated_in_shard(texts: list[bytes], origin: np.ndarray, width: int) -> np.ndarray:
    """[text, offset] of the strings of `width` bytes that have an equal one of smaller origin (text's origin plus offset)."""
    sizes = np.array([len(t) for t in texts])
    s = np.zeros(int(sizes.sum()) + len(texts), np.uint16)
    starts = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    inside = np.ones(len(s), bool)
    inside[starts + sizes] = False  # a 0 ends each text
    s[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    left = (np.repeat(starts + sizes, sizes + 1) - np.arange(len(s))).astype(np.int32)
    order = suffix_array(s, 257)
    shared = common_prefixes(s, order, left, width)
    group = np.cumsum(shared < width)
    fit = left[order] >= width
    pos, group = order[fit], group[fit]
    key = origin[owner[pos]] + (pos - starts[owner[pos]])
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(key, heads), np.diff(np.append(heads, len(key)))) if len(heads) else key
    later = pos[key > least]
    return np.column_stack([owner[later], later - starts[owner[later]]])


# --- minimisers ----------------------------------------------------------------------------------------------------


def minimisers(data: np.ndarray, offsets: np.ndarray, width: int, running: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the minimisers of all strings of `width` bytes that lie within one text, each with the starts of the first and the last string it is the minimiser of.

    Those strings start next to each other, and which they are follows from the text they lie in: equal strings are in the contexts of equal minimisers.
    """
    n = len(data) - GRAM + 1
    w = width - GRAM + 1
    if n < w:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(n, dtype=np.uint64)
    packed = (running[GRAM:] - running[:-GRAM]) * powers_back(n)
    packed *= np.uint64(0xD6E8FEB86659FD93)
    packed &= np.uint64(0xFFFFFFFF00000000)
    packed |= at
    ends = offsets[1:-1]
    for d in range(1, GRAM):  # pieces across two texts
        cross = ends - d
        packed[cross[(cross >= 0) & (cross < n)]] |= np.uint64(0xFFFFFFFF00000000)
    full = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[:n] = packed
    square = full.reshape(-1, w)
    forth = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = np.minimum(back[: n - w + 1], forth[w - 1 : n])
    pos = (windows & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.arange(len(pos))
    whole = begins + width <= np.repeat(offsets[1:], np.diff(offsets))[: len(pos)]  # not strings across two texts
    pos, begins = pos[whole], begins[whole]
    heads = np.flatnonzero(np.append(True, pos[1:] != pos[:-1])[: len(pos)])
    return pos[heads], begins[heads], begins[np.append(heads[1:], len(pos))[: len(heads)] - 1]


def _bits(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, [probe, bit in the segment]) of hashes in a filter of `bits` bits."""
    per = bits // SEGMENTS
    again = mix(fp + np.uint64(0x1234567))
    probes = np.stack([(again >> np.uint64(s)) & np.uint64(per - 1) for s in (0, 20, 40)])
    return (fp >> np.uint64(56)).astype(np.int64), probes.astype(np.int64)


def bloom_filter(again: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter (bytes of bits, bits) of the hashes fp in a stored table; its size is bounded by FILTER_BITS."""
    bits = 1 << 20
    n = again.count()
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2

    def segment(frame: pd.DataFrame) -> pd.DataFrame:
        fp = frame["fp"].to_numpy(np.int64).view(np.uint64)
        own, probes = _bits(fp, bits)
        flags = np.zeros(bits // SEGMENTS, np.uint8)
        flags[probes.ravel()] = 1
        return pd.DataFrame({"segment": [int(own[0])], "flags": [np.packbits(flags).tobytes()]})

    found = again.groupBy(F.shiftrightunsigned("fp", 56).alias("seg")).applyInPandas(segment, "segment int, flags binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    size = bits // 8 // SEGMENTS
    for r in found:
        out[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(r["flags"], np.uint8)
    return out, bits


def in_filter(fp: np.ndarray, flags: np.ndarray, bits: int) -> np.ndarray:
    own, probes = _bits(fp, bits)
    where = own * (bits // SEGMENTS) + probes
    return ((flags[where >> 3] >> (7 - (where & 7))) & 1).all(axis=0)


# --- the operator --------------------------------------------------------------------------------------------------

KEY = ["doc_id", "crc"]
CONTEXT = ["fp", "ctx", "lr"]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, crc, text of the rows that are compared: those with a doc_id; rows of one doc_id and text once."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").withColumn("crc", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))


def duplicate_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, crc, a, b: byte spans of the texts, each covered by strings of `width` bytes that also start earlier."""
    rows = _rows(docs)
    spark = docs.sparkSession
    reach = width - GRAM  # bytes of a string before its minimiser at most, and after it
    half = reach // 2

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1 << 19):
            data, offsets = flat(batch.column("text"))
            running = prefix_hash(data)
            pos, _, _ = minimisers(data, offsets, width, running)
            fp, n = np.unique(span_hash(running, pos, pos + GRAM), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(n.astype(np.int32))], names=["fp", "n"])

    again = store(rows.select("text").mapInArrow(first, "fp long, n int").groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1").select("fp"), "repeated")
    flags = spark.sparkContext.broadcast(bloom_filter(again))
    release(again)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1 << 19):
            data, offsets = flat(batch.column("text"))
            running = prefix_hash(data)
            pos, a, b = minimisers(data, offsets, width, running)
            fp = span_hash(running, pos, pos + GRAM)
            hit = in_filter(fp, *flags.value)
            pos, fp, a, b = pos[hit], fp[hit], a[hit], b[hit] + width
            row = np.searchsorted(offsets, pos, "right") - 1
            ctx = span_hash(running, a, b)
            ids, crc = batch.column("doc_id").to_numpy(), batch.column("crc").to_numpy()
            lr = (pos - a) * 256 + (b - pos)
            # of each context and minimiser in it (a short text is the context of several), the first place in the slice
            order = np.lexsort((pos - offsets[row], crc[row], ids[row], lr, ctx))
            new = np.append(True, (ctx[order][1:] != ctx[order][:-1]) | (lr[order][1:] != lr[order][:-1]))[: len(order)]
            seen = np.zeros(len(pos), bool)
            seen[order[new]] = True
            raw = data.tobytes()
            texts = [raw[x:y] if s else None for x, y, s in zip(a, b, seen)]
            # what strings share whose minimiser is in their right half, and in their left half; 0 if there are none
            left = np.where((pos - a >= half) & (b - pos >= width - reach), span_hash(running, np.maximum(pos - half, a), pos + GRAM), np.uint64(0))
            right = np.where(b - pos >= half + GRAM, span_hash(running, pos, np.minimum(pos + half + GRAM, b)) ^ np.uint64(1), np.uint64(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(lr.astype(np.int32)), pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), batch.column("doc_id").take(pa.array(row)), batch.column("crc").take(pa.array(row)), pa.array((pos - offsets[row]).astype(np.int64)), pa.array(texts, pa.binary())],
                names=["fp", "ctx", "lr", "kl", "kr", "doc_id", "crc", "pos", "piece"],
            )

    seen = store(rows.select("doc_id", "crc", "text").mapInArrow(second, "fp long, ctx long, lr int, kl long, kr long, doc_id long, crc long, pos long, piece binary"), "contexts", False)
    # each distinct context with its first place, and how often it occurs
    heads = seen.groupBy(*CONTEXT).agg(F.min(F.struct("doc_id", "crc", "pos")).alias("at"), F.min("kl").alias("kl"), F.min("kr").alias("kr"), F.count("*").alias("n"))
    heads = store(heads.select(*CONTEXT, "kl", "kr", "n", F.col("at.doc_id").alias("doc_id"), F.col("at.crc").alias("crc"), F.col("at.pos").alias("pos")), "heads", False)
    left, right = F.floor(F.col("lr") / 256).cast("int"), F.col("lr") % 256
    # contexts that occur again as a whole
    first_ = heads.where("n > 1").select(*CONTEXT, F.col("doc_id").alias("d0"), F.col("crc").alias("c0"), F.col("pos").alias("p0"))
    copies = seen.select(*CONTEXT, *KEY, "pos").join(first_, CONTEXT).where("not (doc_id = d0 and crc = c0 and pos = p0)").where(left + right >= width)
    copies = store(copies.select(*KEY, (F.col("pos") - left).alias("a"), (F.col("pos") + right).alias("b")), "copies")
    # distinct contexts that share 60 bytes: those left of the minimiser, or right of it
    keys = heads.select("lr", F.explode(F.array("kl", "kr")).alias("key")).where("key <> 0")
    groups = store(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "groups")
    wanted = heads.select(*CONTEXT, *KEY, "pos", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("kl").alias("key")), F.struct(F.lit(1).alias("side"), F.col("kr").alias("key")))).alias("x")).select("*", "x.*").drop("x").join(groups, "key")
    wanted = store(wanted, "wanted", False)
    # their texts: a filter of fixed size keeps most of the others from being shuffled
    asked = spark.sparkContext.broadcast(bloom_filter(wanted.select(F.col("ctx").alias("fp"))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(batch.column("ctx").to_numpy().view(np.uint64), *asked.value)))

    texts = seen.where("piece is not null").select(*CONTEXT, *KEY, "pos", "piece").mapInArrow(pick, "fp long, ctx long, lr int, doc_id long, crc long, pos long, piece binary")
    start = F.when(F.col("side") == 0, F.lit(0)).otherwise(F.greatest(left - half, F.lit(0)))
    end = F.when(F.col("side") == 0, left + width - half).otherwise(left + right)
    units = wanted.join(texts, [*CONTEXT, *KEY, "pos"]).select("key", "m", *KEY, (F.col("pos") - left + start).alias("at"), F.substring(F.col("piece"), start + 1, end - start).alias("piece"))
    keyed = store(units.where(F.length("piece") >= width), "units")
    release(seen, heads, wanted, groups)
    size = keyed.where(F.col("m") <= MAX_GROUP).agg(F.sum(F.length("piece"))).first()[0] or 0
    n_shards = max(1, -(-size // SHARD))
    usual = keyed.where(F.col("m") <= MAX_GROUP).withColumn("shard", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(n_shards)))

    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        doc, crc = frame["doc_id"].to_numpy(np.int64), frame["crc"].to_numpy(np.int64)
        order = np.lexsort((crc, doc))
        number = np.empty(len(doc), np.int64)  # of the document, in order
        number[order] = np.cumsum(np.append(False, (doc[order][1:] != doc[order][:-1]) | (crc[order][1:] != crc[order][:-1])))
        origin = (number << 40) + frame["at"].to_numpy(np.int64)
        found = repeated_in_shard(frame["piece"].tolist(), origin, width)
        own, starts = found[:, 0], frame["at"].to_numpy(np.int64)[found[:, 0]] + found[:, 1]
        order = np.lexsort((starts, own))
        own, starts = own[order], starts[order]
        new = np.append(True, (own[1:] != own[:-1]) | (starts[1:] > starts[:-1] + 1)) if len(own) else np.zeros(0, bool)
        first_, last_ = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(own)) - 1 if len(own) else np.zeros(0, int)
        row = own[first_]
        return pd.DataFrame({"doc_id": frame["doc_id"].to_numpy()[row], "crc": frame["crc"].to_numpy()[row], "a": starts[first_], "b": starts[last_] + width if len(own) else starts[first_]})

    sorted_ = usual.groupBy("shard").applyInPandas(shard, "doc_id long, crc long, a long, b long")
    # keys with more contexts than a shard takes: string by string
    many = keyed.where(F.col("m") > MAX_GROUP)
    strings = many.withColumn("o", F.explode(F.sequence(F.lit(0), F.length("piece") - width))).select("key", *KEY, (F.col("at") + F.col("o")).alias("at"), F.expr(f"substring(piece, o + 1, {width})").alias("x"))
    strings = strings.select(F.xxhash64("x").alias("h1"), F.xxhash64("key", "x", F.lit(1)).alias("h2"), *KEY, "at")
    least = strings.groupBy("h1", "h2").agg(F.min(F.struct(*KEY, "at")).alias("least"))
    rest = strings.join(least, ["h1", "h2"]).where(F.struct(*KEY, "at") != F.col("least")).select(*KEY, F.col("at").alias("a"), (F.col("at") + width).alias("b"))
    return copies.unionByName(sorted_).unionByName(rest)


def dedup_substrings(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay) of every row of docs (doc_id, text).

    Each byte is removed that lies in a string of `width` bytes that also starts earlier: in a document of smaller doc_id, or earlier in
    the same one. Texts are compared as UTF-8 bytes, as they were, never across documents. Null texts are empty; a null doc_id is compared
    with nothing and stays whole; rows with the same doc_id and text count as one document and fare alike, different texts of
    one doc_id are ordered by checksum.
    """
    found = store(duplicate_spans(docs, width).groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans")), "spans")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("crc", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    joined = whole.join(found.hint("shuffle_hash"), KEY, "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=8 << 20):
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            spans = batch.column("spans")
            for r, text in enumerate(batch.column("text")):
                raw = (text.as_py() or "").encode()
                merged: list[list[int]] = []
                for x in spans[r].as_py() or ():
                    if merged and x["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["b"])
                    else:
                        merged.append([x["a"], x["b"]])
                out, at = [], 0
                for a, b in merged:
                    out.append(raw[at:a])
                    at = b
                kept.append(b"".join([*out, raw[at:]]))
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(kept[-1]))
                n_spans.append(len(merged))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the checksum of the bytes that stay."""
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
