"""Benchmark decontamination by a positional inverted index.

The index holds, for each training document, the posting lists of the test terms: term, then the positions of its
occurrences. It is cut by document, so that each part answers any phrase about its own documents; phrases are
asked of all parts in blocks of bounded size. A phrase is looked up from its rarest term: that term's positions, less
its offset in the phrase, are the possible starts, and each further term's offset-adjusted list is intersected with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tenderline.llm.storage import store
from tenderline.llm.text import ALNUM, LOWER, cut, flat, slices, spans

#: Terms that are sent to all tasks; phrases that are, a block after the other; phrases of a test set.
MAX_TERMS, BLOCK, MAX_PHRASES = 1_000_000, 200_000, 5_000_000
INDEX = "row long, doc_id long, n_words long, terms array<int>, counts array<int>, positions array<int>"


def words_of(text: str | None) -> list[str]:
    """Words as the index has them: A-Z lower-cased, runs of digits, a-z and non-ASCII characters."""
    data, offsets = flat(pa.array([text], pa.string()))
    data = LOWER[data]
    starts, ends, _ = spans(data, offsets, ALNUM)
    return [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]


def build_index(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Positional postings of `terms` (distinct) in each row of docs (doc_id, text).

    One row for each document: a row number, the numbers of the terms it has, how often it has them, and their positions (word
    numbers), one list after another. Texts that are null or have no word have empty lists. Repeated rows are
    indexed as rows of their own. More than MAX_TERMS terms are refused: they are sent to all tasks.
    """
    if len(terms) > MAX_TERMS:
        raise ValueError(f"index at most {MAX_TERMS} terms at once")
    lookup = docs.sparkSession.sparkContext.broadcast([t.encode() for t in terms])

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(lookup.value, pa.large_binary())
        for batch in slices(batches):
            data, offsets = flat(batch.column("text"))
            data = LOWER[data]
            starts, ends, rows = spans(data, offsets, ALNUM)
            n = batch.num_rows
            bounds = np.searchsorted(rows, np.arange(n + 1))
            found = pc.index_in(cut(data, starts, ends, ALNUM), value_set=known)
            at = np.flatnonzero(pc.is_valid(found).to_numpy(zero_copy_only=False))
            term, row = pc.drop_null(found).to_numpy().astype(np.int64), rows[at]
            order = np.argsort(row * (len(known) + 1) + term, kind="stable")
            term, row, position = term[order], row[order], (at - bounds[row])[order]
            new = np.ones(len(term), bool)
            new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
            heads = np.flatnonzero(new)
            counts = np.diff(np.append(heads, len(term)))
            by_list = np.searchsorted(row[heads], np.arange(n + 1)).astype(np.int32)
            by_position = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            lists = lambda cuts, values: pa.ListArray.from_arrays(pa.array(cuts), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), lists(by_list, term[heads]), lists(by_list, counts), lists(by_position, position)],
                names=["row", "doc_id", "n_words", "terms", "counts", "positions"],
            )

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(postings, INDEX)


def find_phrases(index: DataFrame, terms: list[str], phrases: list[list[str]], slop: int = 0) -> DataFrame:
    """(row, doc_id, n_words, matches) for a stored index: matches is an array of (phrase number, start) of every match in the document.

    slop 0: exact phrases. Otherwise proximity: each term stands within `slop` words of its place relative to the
    phrase's rarest term; start is where that term puts the phrase, and may be negative. Phrases with a term that
    the index doesn't hold match nothing. Every document has a row, also without a match.
    """
    number = {t: i for i, t in enumerate(terms)}
    spark = index.sparkSession
    # occurrences of each test term in the whole corpus: a bounded table, as terms are
    tally = {r["t"]: r["n"] for r in index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("t")).agg(F.sum("x.counts").alias("n")).collect()}
    plans = []
    for k, words in enumerate(phrases):
        ids = [number.get(w, -1) for w in words]
        if ids and all(t in tally for t in ids):
            plans.append((k, sorted(zip(ids, range(len(ids))), key=lambda x: (tally[x[0]], x[1]))))
    blocks = [plans[a : a + BLOCK] for a in range(0, len(plans), BLOCK)] or [[]]
    found = [index.mapInArrow(lambda batches, block=spark.sparkContext.broadcast(x): _match(batches, block.value, slop), "row long, doc_id long, n_words long, phrases array<int>, starts array<int>") for x in blocks]
    found = [x.select("row", "doc_id", "n_words", F.arrays_zip(F.col("phrases").alias("phrase"), F.col("starts").alias("start")).alias("matches")) for x in found]
    if len(found) == 1:
        return found[0]
    return reduce(DataFrame.unionByName, found).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))


def _match(batches: Iterator[pa.RecordBatch], plans: list, slop: int) -> Iterator[pa.RecordBatch]:
    by_anchor: dict[int, list] = {}
    for k, order in plans:
        by_anchor.setdefault(order[0][0], []).append((k, order))
    anchors = np.array(sorted(by_anchor), np.int64)
    for batch in batches:
        terms, counts, positions = (batch.column(c) for c in ("terms", "counts", "positions"))
        t_cut, p_cut = np.asarray(terms.offsets), np.asarray(positions.offsets)
        t_all, c_all, p_all = np.asarray(terms.values), np.asarray(counts.values), np.asarray(positions.values)
        hit = np.isin(t_all, anchors)
        rows = np.unique(np.searchsorted(t_cut, np.flatnonzero(hit), "right") - 1)
        found: dict[int, tuple[list, list]] = {}
        for r in rows:
            own = t_all[t_cut[r] : t_cut[r + 1]]
            ends = np.cumsum(c_all[t_cut[r] : t_cut[r + 1]]) + p_cut[r]
            lists: dict[int, np.ndarray] = {}

            def posting(t: int) -> np.ndarray:
                if t not in lists:
                    i = np.searchsorted(own, t)
                    lists[t] = p_all[ends[i] - c_all[t_cut[r] + i] : ends[i]] if i < len(own) and own[i] == t else p_all[:0]
                return lists[t]

            which, starts = [], []
            for anchor in own[hit[t_cut[r] : t_cut[r + 1]]]:
                for k, order in by_anchor[int(anchor)]:
                    at = posting(order[0][0]) - order[0][1]
                    for t, offset in order[1:]:
                        if not len(at):
                            break
                        near = posting(t) - offset
                        if slop:
                            i = np.searchsorted(near, at - slop)
                            at = at[(i < len(near)) & (near[np.minimum(i, len(near) - 1)] <= at + slop)] if len(near) else at[:0]
                        else:
                            at = at[np.isin(at, near, assume_unique=True)]
                    which += [k] * len(at)
                    starts += at.tolist()
            if which:
                found[int(r)] = (which, starts)
        none = ([], [])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("row", "doc_id", "n_words")), *(pa.array([found.get(r, none)[i] for r in range(batch.num_rows)], pa.list_(pa.int32())) for i in (0, 1))],
            names=["row", "doc_id", "n_words", "phrases", "starts"],
        )


def item_windows(items: Iterable[tuple], width: int = 10) -> tuple[list[list[str]], list[tuple]]:
    """Distinct windows of `width` consecutive words of (item_id, text), and of each window the item ids that have it."""
    owners: dict[tuple, set] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            owners.setdefault(tuple(words[i : i + width]), set()).add(item)
    return [list(w) for w in owners], [tuple(sorted(map(str, v))) for v in owners.values()]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Of each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; and items, hits (word spans).

    A word is hit if any occurrence of a window (`width` consecutive words of an item, or a shorter item as a whole)
    covers it. Null or wordless texts have no words and no hits; items without words have no windows, items without an
    id are left out; repeated rows are judged each by itself; item ids are compared as strings. The windows of the test
    set pass the driver, at most MAX_PHRASES of them (test sets are small and fixed; training text never passes it).
    """
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null")
    windows, owners = item_windows(items.toLocalIterator(), width)
    if len(windows) > MAX_PHRASES:
        raise ValueError(f"{len(windows)} windows: split the test set, {MAX_PHRASES} are checked at once")
    terms = sorted({w for x in windows for w in x})
    index = store(build_index(docs, terms), "postings")
    return _hits(find_phrases(index, terms, windows), windows, owners)


def _hits(matches: DataFrame, windows: list[list[str]], owners: list[tuple]) -> DataFrame:
    facts = matches.sparkSession.sparkContext.broadcast(([len(w) for w in windows], owners))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, who = facts.value
        for batch in batches:
            n_hit, items, spans_ = [], [], []
            for found in batch.column("matches").to_pylist():
                owned: set = set()
                merged: list[list[int]] = []
                for a, b in sorted((m["start"], m["start"] + lengths[m["phrase"]]) for m in found):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                for m in found:
                    owned.update(who[m["phrase"]])
                n_hit.append(sum(b - a for a, b in merged))
                items.append(sorted(owned))
                spans_.append(merged)
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(items, pa.list_(pa.string())), pa.array(spans_, pa.list_(pa.list_(pa.int64())))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hits"],
            )

    return matches.mapInArrow(judge, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hits array<array<long>>")
