"""Language identification by cross-parsing against labelled text.

For each language a bounded sample of its labelled text is turned into a suffix automaton. A text is parsed from left
to right into the longest pieces that occur in a language's sample; its cross-parsing entropy is the number of pieces
times the logarithm of the sample's size, as a piece of a larger sample takes more to name. The language of the least wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tenderline.llm.storage import store
from tenderline.llm.text import slices

#: Letters of a sample for each language, and of all samples together.
SAMPLE, SAMPLES = 40_000, 400_000
#: Transitions that are held as a table, at most (128 MB); automata over larger alphabets are held as sorted transitions.
DENSE = 32_000_000
#: Symbols: 0 ends a piece of text, 1 is a gap between words, 2 a letter that no sample has.
GAP, OTHER, FIRST = 1, 2, 3


@cache
def _folding() -> np.ndarray:
    """Code point -> lower-case code point of a letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points of all texts, offsets); 0 is no letter."""
    codes = [np.frombuffer((t or "").encode("utf-32-le", "replace"), np.uint32) for t in texts]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(c) for c in codes], out=offsets[1:])
    return (_folding()[np.concatenate(codes)] if codes else np.zeros(0, np.uint32)), offsets


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Of each state of the automaton of all substrings its transitions (symbol to state); 0 is the root."""
    link, length, step = [-1], [0], [{}]
    last = 0
    for c in symbols:
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


class Transitions:
    """next(states, symbols) of several automata whose states are numbered on; -1 where there is no transition."""

    def __init__(self, automata: list[list[dict[int, int]]], width: int, dense: int = DENSE):
        states = sum(len(a) for a in automata)
        self.width, base, keys, targets = width, 0, [], []
        for a in automata:
            keys += [np.array([(base + s) * width + c for s, own in enumerate(a) for c in own], np.int64)]
            targets += [np.array([base + t for own in a for t in own.values()], np.int32)]
            base += len(a)
        self.keys, self.targets = (np.concatenate([*x, np.zeros(0, t)]).astype(t) for x, t in ((keys, np.int64), (targets, np.int32)))
        order = np.argsort(self.keys)
        self.keys, self.targets, self.table = self.keys[order], self.targets[order], None
        if states * width <= dense:
            self.table = np.full(states * width, -1, np.int32)
            self.table[self.keys] = self.targets
            self.keys = self.targets = None

    def next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.width + symbol
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], -1)


def train(labelled: DataFrame, sample: int = SAMPLE, max_languages: int = 200) -> dict:
    """A model from rows (text, lang) with non-null lang.

    Of each language, texts are used up to `sample` letters (only letters count), or its share of SAMPLES if there are many
    languages: those of the smallest hashes, so the same texts at every partitioning. `sizes` has the letters of each sample. Languages beyond
    max_languages are refused. Without any labelled text the model knows no language.
    """
    rows = labelled.where("lang is not null and text is not null").select("lang", F.col("text").cast("string").alias("text"))
    langs = sorted(r["lang"] for r in rows.groupBy("lang").count().collect())  # a row for each language
    if len(langs) > max_languages:
        raise ValueError(f"{len(langs)} languages; at most {max_languages}")
    share = min(sample, SAMPLES // max(1, len(langs)))
    # the texts with the smallest hashes, copies once, until their letters fill the share: first by ranges of hashes, then exactly
    keyed = rows.select("lang", F.xxhash64("text").alias("h"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1 << 20):
            codes, offsets = letters(batch.column("text").to_pylist())
            sums = np.concatenate([[0], np.cumsum(codes > 0)])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(np.minimum(sums[offsets[1:]] - sums[offsets[:-1]], share))], names=["lang", "h", "n"])

    sized = store(keyed.mapInArrow(count, "lang string, h long, n long").where("n > 0").groupBy("lang", "h").agg(F.max("n").alias("n")).withColumn("g", F.shiftright("h", 52)), "sizes")
    before = lambda order: F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sized.groupBy("lang", "g").agg(F.sum("n").alias("n")).withColumn("k", before("g")).where(F.col("k") < share)
    least = sized.join(F.broadcast(ranges.select("lang", "g")), ["lang", "g"]).withColumn("k", before("h")).where(F.col("k") < share)
    few = keyed.join(F.broadcast(least.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    few = few.withColumn("text", F.substring(F.regexp_replace("text", r"\P{L}+", " "), 1, 2 * share))
    texts: dict[str, list[str]] = {}
    for r in sorted(few.toLocalIterator()):
        texts.setdefault(r["lang"], []).append(r["text"])
    picked, seen = {}, {}
    for lang, found in sorted(texts.items()):
        codes = np.concatenate([np.append(letters([t])[0], 0) for t in found])
        picked[lang] = codes[: int(np.searchsorted(np.cumsum(codes > 0), share)) + 1]
        for code, k in zip(*np.unique(picked[lang], return_counts=True)):
            seen[int(code)] = seen.get(int(code), 0) + int(k)
    alphabet = sorted(c for c in seen if c)
    symbol = {c: i + FIRST for i, c in enumerate(alphabet)}
    automata = []
    for lang in sorted(picked):
        own = np.array([symbol.get(int(c), GAP) for c in picked[lang]])
        keep = np.ones(len(own), bool)
        keep[1:] = (own[1:] != GAP) | (own[:-1] != GAP)
        automata.append(suffix_automaton(own[keep].tolist()))
    roots = np.cumsum([0, *(len(a) for a in automata)])[: len(automata)].astype(np.int32)
    sizes = np.array([np.count_nonzero(picked[lang]) for lang in sorted(picked)], np.int64)
    return {"langs": sorted(picked), "alphabet": np.array(alphabet, np.uint32), "steps": Transitions(automata, len(alphabet) + FIRST), "roots": roots, "sizes": sizes}


def phrases(model: dict, codes: np.ndarray, offsets: np.ndarray, piece: int = 256) -> np.ndarray:
    """Phrases [text, language] that each text's letters need.

    Texts are parsed in pieces of `piece` symbols, all pieces at once; pieces are parsed again from where the one before
    ends, as far as that differs, until none starts elsewhere, so that phrases go across the cuts.
    """
    n, n_langs = len(offsets) - 1, len(model["langs"])
    row = np.repeat(np.arange(n), np.diff(offsets))
    lut = np.full(0x110000, OTHER, np.uint8 if len(model["alphabet"]) < 250 else np.uint16)
    lut[model["alphabet"]] = np.arange(len(model["alphabet"])) + FIRST
    lut[0] = GAP
    sym = lut[codes]
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != GAP) | (sym[:-1] != GAP) | (row[1:] != row[:-1])
    sym, row = sym[keep], row[keep]
    own = np.bincount(row, minlength=n)
    pieces = -(-own // piece)
    owner = np.repeat(np.arange(n), pieces)
    first = np.concatenate([[0], np.cumsum(own)[:-1]])
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(first, pieces) + nth * piece
    length = np.minimum(piece, np.repeat(own, pieces) - nth * piece)
    step = model["steps"].next

    def walk(which: np.ndarray, state: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(states after symbols first to last - 1 of the pieces `which`, phrases begun in them), [language, piece], from the states before them."""
        order = np.argsort(-length[which], kind="stable")
        size, at, state = length[which][order], start[which][order], state[:, order]
        roots, count = np.repeat(model["roots"], len(which)).reshape(n_langs, -1), np.zeros(state.shape, np.int32)
        active = len(which)
        for t in range(first, last):
            active = int(np.searchsorted(-size[:active], -t, "left"))
            if not active:
                break
            c = sym[at[:active] + t].astype(np.int64)
            go = step(state[:, :active], c)
            bad = go < 0
            if bad.any():
                count[:, :active] += bad
                again = step(roots[:, :active], c)
                go = np.where(bad, np.where(again < 0, roots[:, :active], again), go)
            state[:, :active] = go
        back = np.argsort(order)
        return state[:, back], count[:, back]

    near = max(1, piece // 4)  # a parse from another start mostly falls in with the first one by then
    begun = np.repeat(model["roots"], len(start)).reshape(n_langs, -1)
    everything = np.arange(len(start))
    middle, count_near = walk(everything, begun, 0, near)
    ended, count = walk(everything, middle, near, piece)
    inner, turn = np.flatnonzero(nth > 0), 0
    while len(todo := inner[(ended[:, inner - 1] != begun[:, inner]).any(axis=0)]):
        if turn >= 4:  # then only the first of each text, whose start is final
            todo = todo[np.append(True, owner[todo][1:] != owner[todo][:-1])]
        begun[:, todo] = ended[:, todo - 1]
        state, count_near[:, todo] = walk(todo, begun[:, todo], 0, near)
        off = (state != middle[:, todo]).any(axis=0)
        todo, state = todo[off], state[:, off]
        middle[:, todo] = state
        ended[:, todo], count[:, todo] = walk(todo, state, near, piece)
        turn += 1
    count = count + count_near
    out = np.zeros((n, n_langs), np.int64)
    for k in range(n_langs):
        out[:, k] = np.bincount(owner, count[k], minlength=n) + (own > 0)
    return out


def predict(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """docs' columns `keep` with lang_pred and score (0 to 1: the share of the winner, were each phrase of the largest sample one bit).

    `und` with score 0 for a null text, one without a letter, or a model without languages; ties go to the language
    first in alphabetical order. Texts are used whole, at any length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.withColumn("text", F.col("text").cast("string")).select(*dict.fromkeys([*keep, "text"]))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        bits = np.log2(np.maximum(m["sizes"], 2)) if m["langs"] else np.zeros(0)  # to name a phrase of each sample
        for batch in slices(batches, size=1 << 20):
            codes, offsets = letters(batch.column("text").to_pylist())
            has = np.add.reduceat(np.append(codes > 0, False), offsets[:-1]) * (np.diff(offsets) > 0) > 0
            langs, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if m["langs"]:
                need = phrases(m, codes, offsets) * (bits / bits.max())
                best = need.argmin(axis=1)
                gap = need - need.min(axis=1, keepdims=True)
                share = 1 / np.exp2(-np.minimum(gap, 60).astype(float)).sum(axis=1)
                langs = [m["langs"][b] if h else "und" for b, h in zip(best, has)]
                scores = np.where(has, share, 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text" or "text" in keep)
    return kept.mapInArrow(decide, f"{fields}, lang_pred string, score double")


def fold(docs: DataFrame, modulus: int, rest: int):
    """Whether crc32 of doc_id, as text, leaves `rest`; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang).

    Learns from rows outside the held-out fold (crc32 of doc_id as text, modulo 5, is 0) whose doc_id and lang are not null.
    """
    marked = docs.withColumn("held_out", fold(docs, 5, 0))
    model = train(marked.where("not held_out and doc_id is not null").select("text", "lang"), sample)
    return predict(marked, model, "doc_id", "held_out")
