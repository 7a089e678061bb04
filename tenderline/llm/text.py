"""Array kernels over a batch of texts, used inside Spark tasks.

A batch of texts is one byte array and one offset array (row r has data[offsets[r]:offsets[r + 1]]).
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
_BACK = pow(BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of a word once A-Z are lower case: digits, a-z and whatever is not ASCII
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: bytes of a word between white space
SOLID = np.ones(256, bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column; nothing is copied but the offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(texts) else (data[:0], np.zeros(1, np.int64))


def give_back() -> None:
    """Returns memory that is free to the machine: workers live on between tasks, and would keep what their largest slice took."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries don't have it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches again, each with about `size` bytes of text (one row at least); free memory is given back at the end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = (np.cumsum(lengths) - lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    give_back()


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes with inside[byte], never across rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    m = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1] | edge[1:-1]
    last[:-1] &= ~m[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> pa.Array:
    """The runs that spans() found with `inside`, as one binary column."""
    kept = np.ascontiguousarray(data[inside[data]])
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers; those of usual slices are kept (32 MB at most), those of longer texts are not."""
    if len(_powers.get(kind, ())) < n:
        steps = np.full(max(n, 1 << 16), BASE if kind == "up" else _BACK, np.uint64)
        steps[0] = 1
        found = np.cumprod(steps)
        if n > 1 << 22:
            return found
        _powers[kind] = found
    return _powers[kind][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash (modulo 2**64); hashes of any spans follow in constant time each."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _power("up", len(data)), out=out[1:])
    return out


def powers_back(n: int) -> np.ndarray:
    """What brings a difference of the running hash at positions 0 to n - 1 back to position 0."""
    return _power("down", n)


def span_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends], alike wherever the span stands."""
    back = _power("down", len(running))
    return mix((running[ends] - running[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, row) of each word."""
    starts, ends, rows = spans(data, offsets, inside)
    return span_hash(prefix_hash(data), starts, ends), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its `width`-word shingles.

    A row with fewer words, but not none, has its whole sequence as the only shingle.
    """
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    counts = np.diff(bounds)
    out = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        if len(words) >= width:
            n = len(words) - width + 1
            h = words[:n].copy()
            for k in range(1, width):
                h = h * np.uint64(BASE) + words[k : k + n]
            out[:n] = mix(h)
        found = []
        for r, c in enumerate(counts):
            a = bounds[r]
            if c >= width:
                found.append(np.unique(out[a : a + c - width + 1]))
            elif c:
                h = np.uint64(c)
                for w in words[a : a + c]:
                    h = h * np.uint64(BASE) + w
                found.append(mix(np.array([h ^ np.uint64(0x5851F42D4C957F2D)], np.uint64)))
            else:
                found.append(out[:0])
    return found
