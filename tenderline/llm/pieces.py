"""SentencePiece encoding and decoding by a shared-prefix forward pass over sorted words.

A text is cut into marked words (space marks, then what follows up to the next space). The distinct marked words of a
batch are sorted, which makes them the depth-first order of their trie, and the forward table over character positions
is a stack: a word keeps the entries of the prefix it shares with the word before and adds only the rest.

The models at hand are of the merge kind (BPE), whose segmentation is not the one of the largest sum of scores. The
forward state that gives their segmentation is the last piece of each prefix: the piece t for which the prefix before t
ends in a piece that stays beside t when the two are merged on their own. At most one piece fits at each position, so
the forward table keeps that piece where a sum-of-scores model would keep the best score; the ids are those of the
model's own encoder. Positions that no segmentation asks for are left open in the table.

For models of sums of scores (unigram), `kind="unigram"` runs the Viterbi pass itself on the same walk: the table keeps, at
each position, the best sum and the piece that it ends with.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tenderline.llm.text import flat, slices

MARK = "▁"
#: Characters of a word up to which open positions of the forward table are filled by nested calls, on demand.
NESTED = 200
#: Encoded words, and pairs of pieces, that a worker remembers (about 30 MB each); ids of encoded words (4 bytes each).
WORDS, PAIRS, IDS = 150_000, 100_000, 5_000_000
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Pieces:
    """The vocabulary of a model file and the forward pass over it."""

    def __init__(self, model: str, kind: str = "bpe", cache_size: int = WORDS):
        import sentencepiece

        self.kind = kind

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.raw: list[bytes] = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unused(i):
                self.raw.append(b"")
            elif sp.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                self.raw.append(piece.replace(MARK, " ").encode())
                self.ids[piece] = i
                self.score[piece] = sp.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that go across words are not supported")
        self.cache_size = cache_size
        #: ends of pieces, and whether they are pieces that merging their characters gives
        self.longest = max(map(len, self.ids))
        #: a character without a piece scores less than any piece (10 below the least)
        self.unknown = min(self.score.values()) - 10
        self.tails = {p[k:]: False for p in self.ids for k in range(len(p))}
        self.tails |= {p: True for p in self.ids if len(self.merge(p)) == 1}
        self.beside: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Empties the cache of encoded words: the number of each, and of each number where its ids are."""
        self.known: dict[bytes, int] = {}
        self.first, self.pool = array("q", [0]), array("i")

    def merge(self, text: str) -> list[str]:
        """The pieces of a short string by merging best pairs first (ties: leftmost)."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        if (a, b) not in self.beside:
            if len(self.beside) > PAIRS:
                self.beside.clear()
            self.beside[a, b] = self.merge(a + b) == [a, b]
        return self.beside[a, b]

    def last(self, word: str, back: list[int | None], i: int) -> int:
        """The length of the last piece of word[:i]; 0 is a character without a piece, spelled in bytes.

        back[j] has what is known of shorter prefixes; what is found on the way is added.
        """
        tail, beside = self.tails.get, self.beside
        ending, n = [], 1
        while n <= i and (good := tail(piece := word[i - n : i])) is not None:
            if good:
                ending.append(piece)
            n += 1
        found = 0
        for piece in reversed(ending):
            n = len(piece)
            at = i - n
            left = back[at] if at else 0
            if left is None:
                left = self.last(word, back, at)
            if not left:
                found = n
                break
            pair = (word[at - left : at], piece)
            ok = beside.get(pair)
            if self.fits(*pair) if ok is None else ok:
                found = n
                break
        back[i] = found
        return found

    def best(self, word: str, back: list[int | None], sums: list[float], start: int) -> None:
        """Fills back and sums from position `start` on: the Viterbi pass, equal sums to the longer piece."""
        score = self.score
        for i in range(start, len(word) + 1):
            top, found = sums[i - 1] + self.unknown, 0
            for n in range(1, min(i, self.longest) + 1):
                s = score.get(word[i - n : i])
                if s is not None and sums[i - n] + s >= top:
                    top, found = sums[i - n] + s, n
            back[i] = found
            sums.append(top)

    def encode_words(self, words: list[bytes]) -> None:
        """Adds the ids of `words` to the cache: one depth-first walk over their trie."""
        ids, back, before, sums = self.ids, [0], "", [0.0]
        for raw in sorted(words):
            word = raw.decode().replace(" ", MARK)
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            back[shared + 1 :] = [None] * (len(word) - shared)
            if self.kind == "unigram":
                del sums[shared + 1 :]
                self.best(word, back, sums, shared + 1)
            elif len(word) > NESTED:  # from the left, so that no call needs another
                for i in range(1, len(word) + 1):
                    if back[i] is None:
                        self.last(word, back, i)
            out, i = [], len(word)
            while i:
                n = back[i]
                if n is None:
                    n = self.last(word, back, i)
                if n:
                    out.append(ids[word[i - n : i]])
                    i -= n
                else:
                    out += [self.bytes[b] for b in reversed(word[i - 1].encode())] if self.bytes else [0]
                    i -= 1
            self.known[raw] = len(self.first) - 1
            self.pool.extend(out[::-1])
            self.first.append(len(self.pool))
            before = word

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        data, offsets = flat(texts)
        n = len(offsets) - 1
        words, owner = marked_words(data, offsets)
        coded = pc.dictionary_encode(words)
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > self.cache_size or len(self.pool) > IDS:
            self.forget()
        self.encode_words([w for w in distinct if w not in self.known])
        numbers = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        ends_of = np.array(self.first)
        sizes = ends_of[numbers + 1] - ends_of[numbers]
        ids = np.array(self.pool)[ranges(ends_of[numbers], sizes)]
        ends = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(owner, sizes, minlength=n).astype(np.int64), out=ends[1:])
        return ids, ends

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The texts (UTF-8) of id lists; the mark that encoding puts in front is taken off."""
        sizes = np.array([len(x) for x in self.raw], np.int64)
        pool = np.frombuffer(b"".join(self.raw), np.uint8)
        firsts = np.cumsum(sizes) - sizes
        data = pool[ranges(firsts[ids], sizes[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])[offsets]
        return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip(ends, ends[1:])]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of range(start, start + size), one after another."""
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return np.arange(len(shift)) + shift


def marked_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The marked words of texts, with a space in front of each text that is not empty, and the row of each word."""
    filled = np.flatnonzero(np.diff(offsets) > 0)
    data = np.insert(data, offsets[filled], 32)
    grown = np.concatenate([[0], np.cumsum(np.diff(offsets) + (np.diff(offsets) > 0))])
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    space = data == 32
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[grown[:-1][filled]] = True
    starts = np.flatnonzero(first)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return words, np.searchsorted(grown, starts, "right") - 1


_loaded: dict[str, Pieces] = {}


def loaded(model: str, kind: str = "bpe") -> Pieces:
    return _loaded.get(f"{kind} {model}") or _loaded.setdefault(f"{kind} {model}", Pieces(model, kind))


def encode(docs: DataFrame, model: str = MODEL, kind: str = "bpe") -> DataFrame:
    """docs' rows with `ids` (array<int>), `n_ids` and `round_trip`: whether decoding gives the text again.

    The ids are those of the model's own encoder (kind `bpe`), or of the largest sum of scores (`unigram`). Null and empty texts have no ids; the null one stays null after a round
    trip, so it counts as one. Text holding the mark U+2581 itself decodes to a space there. Rows are encoded where
    they are read, with no shuffle; repeated words are encoded once in a batch. Columns `ids`, `n_ids`,
    `round_trip` of the input are replaced.
    """
    kept = docs.drop("ids", "n_ids", "round_trip").withColumn("text", F.col("text").cast("string"))
    names = kept.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model, kind)
        for batch in slices(batches, size=1 << 20):
            texts = batch.column("text")
            plain = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
            ids, ends = pieces.encode(plain)
            back = pieces.decode(ids, ends)
            same = [a is None or a.encode() == b for a, b in zip(texts.to_pylist(), back)]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists, pa.array(np.diff(ends).astype(np.int32)), pa.array(same, pa.bool_())], names=[*names, "ids", "n_ids", "round_trip"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(work, f"{fields}, ids array<int>, n_ids int, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """`encoded` (ids array<int>, other columns) with `decoded` (string; one of the input is replaced); null ids give null, no ids an empty text."""
    encoded = encoded.drop("decoded")
    names = encoded.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            lists = batch.column("ids")
            full = pc.fill_null(lists, pa.scalar([], lists.type))
            texts = pieces.decode(np.asarray(full.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum(pc.list_value_length(full).to_numpy(zero_copy_only=False))]).astype(np.int64))
            out = [t.decode("utf-8", "replace") if ok else None for t, ok in zip(texts, pc.is_valid(lists).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], names=[*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(work, f"{fields}, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, the ids, how many they are, and whether they decode to the text."""
    return encoded.select("doc_id", "n_ids", "ids", "round_trip")

