"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tenderline.llm.language import fold
from tenderline.llm.storage import store
from tenderline.llm.text import SOLID, flat, prefix_hash, slices, span_hash, spans

#: Byte classes whose shares are statistics of a document.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t", "line": b"\n", "stop": b".,;:", "shout": b"!?", "bar": b"|", "symbol": b"#$%&*+<=>@\\^_`~{}[]/", "quote": b"\"'()-", "high": bytes(range(128, 256))}
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _i, _b in enumerate(CLASSES.values()):
    _CLASS[list(_b)] = _i
#: Matrices that one task adds up.
FAN = 16
LAGS = (1, 2, 3, 4, 5, 6, 8)
N_STATS = len(CLASSES) + len(LAGS) + 9


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[row, statistic] of a batch of texts; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    full = np.maximum(size, 1)
    row = np.repeat(np.arange(n), size)
    cols = [np.bincount(row.astype(np.int64) * 16 + _CLASS[data], minlength=16 * n).reshape(n, 16)[:, : len(CLASSES)] / full[:, None]]
    starts, ends, owner = spans(data, offsets, SOLID)
    running = prefix_hash(data)
    words = span_hash(running, starts, ends)
    count = np.bincount(owner, minlength=n)
    some = np.maximum(count, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(owner, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / some - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    order = np.lexsort((words, owner))
    w, o = words[order], owner[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    heads = np.flatnonzero(new)
    times = np.diff(np.append(heads, len(w)))
    commonest = np.zeros(n)
    np.maximum.at(commonest, o[heads], times)
    distinct = np.bincount(o[heads], minlength=n)
    repeats = [np.bincount(owner[k:], (words[k:] == words[:-k]) & (owner[k:] == owner[:-k]), n) / some if len(words) > k else np.zeros(n) for k in LAGS]
    caps = np.bincount(owner, _CLASS[data[starts]] == 0, n) / some if len(words) else np.zeros(n)
    lines = np.bincount(row, data == 10, n) + 1
    cols.append(np.column_stack([np.log1p(size), np.log1p(count), mean, np.log1p(spread), np.log1p(longest), distinct / some, commonest / some, caps, np.log1p(count / lines), *repeats]))
    out = np.hstack(cols).astype(float)
    out[size == 0] = 0
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and `stats` (array<double>) of each row, stored: the only pass over the texts."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(docs, 3, 1).alias("held_out"), F.col("text").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1 << 20):
            x = statistics(*flat(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_STATS, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), lists], names=["doc_id", "held_out", "stats"])

    return store(kept.mapInArrow(work, "doc_id long, held_out boolean, stats array<double>"), "stats")


def labelled_rows(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """rows outside the held-out fold with `label` (0.0 or 1.0), the largest given for a doc_id."""
    known = labels.where(f"doc_id is not null and {column} is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("double")).alias("label"))
    return rows.where("not held_out").join(known, "doc_id")


class Fourier:
    """Random features whose inner products approximate exp(-|x - y|^2 / (2 width^2)) of standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, n: int = 256, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), n)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def normal_equations(rows: DataFrame, features: Fourier) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each half of the rows (stats, label, half): the sums of z z' and z y, summed in the partitions first."""
    shared = rows.sparkSession.sparkContext.broadcast(features)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for half, own in frame.groupby("half"):
                z = shared.value(np.stack(own["stats"].to_numpy()))
                zy = np.column_stack([z, own["label"].to_numpy()])
                sums[half] = sums.get(half, 0) + z.T @ zy
        if sums:
            yield pd.DataFrame({"half": list(sums), "branch": TaskContext.get().partitionId(), "sums": [x.tobytes() for x in sums.values()]})

    def total(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"half": [key[0]], "branch": [key[1]], "sums": [sum(np.frombuffer(x) for x in frame["sums"]).tobytes()]})

    # a tree of sums: no task adds up more than FAN matrices of each half, and no more than that reach the driver
    own = rows.select("stats", "label", "half")
    found, width = own.mapInPandas(partial, "half int, branch int, sums binary"), max(1, own.rdd.getNumPartitions())
    while width > FAN:
        found = found.groupBy("half", F.floor(F.col("branch") / FAN).cast("int").alias("branch")).applyInPandas(total, "half int, branch int, sums binary")
        width = -(-width // FAN)
    found = found.collect()
    n = len(features.b) + 1
    out = []
    for half in (0, 1):
        s = sum((np.frombuffer(r["sums"]).reshape(n, n + 1) for r in found if r["half"] == half), np.zeros((n, n + 1)))
        out.append((s[:, :n], s[:, n]))
    return out


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing fit, interpolated between the means of the pools."""
    pools: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def scored(stats: DataFrame, train: DataFrame, ridge: float = 1e-3) -> DataFrame:
    """stats' doc_id, held_out with `score`, fitted on train (stats, label).

    The calibration is fitted on scores that each half of the training rows gets from the other half's regression. Without
    training rows the score is 0.5; with one class only it is that class's share.
    """
    rows = store(train.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")), "labelled")
    head = rows.agg(F.count("*").alias("n"), F.sum("label").alias("y"), *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(N_STATS)], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(N_STATS)]).first()
    if not head["n"]:
        return stats.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    scale = np.array([head[f"s{i}"] for i in range(N_STATS)])
    features = Fourier(np.array([head[f"m{i}"] for i in range(N_STATS)]), np.where(scale > 1e-9, scale, 1.0))
    halves = normal_equations(rows, features)

    def solve(parts: list) -> np.ndarray:
        a, b = sum(p[0] for p in parts), sum(p[1] for p in parts)
        return np.linalg.solve(a + ridge * max(a[-1, -1], 1) * np.eye(len(a)), b)

    weights = [solve([halves[1]]), solve([halves[0]]), solve(halves)]
    shared = rows.sparkSession.sparkContext.broadcast((features, weights))

    def raw(frames: Iterator[pd.DataFrame], which: int | None, keep: list[str]) -> Iterator[pd.DataFrame]:
        f, w = shared.value
        for frame in frames:
            if len(frame):
                z = f(np.stack(frame["stats"].to_numpy()))
                r = z @ w[2] if which is None else np.where(frame["half"].to_numpy() == 0, z @ w[0], z @ w[1])
                yield frame[keep].assign(raw=np.clip(r, -1, 2))

    crossed = rows.mapInPandas(lambda x: raw(x, 0, ["label"]), "label double, raw double")
    bins = crossed.groupBy(F.round(F.col("raw") * 500).alias("bin")).agg(F.avg("raw").alias("x"), F.avg("label").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()  # 1,501 bins at most
    x, y = isotonic(*(np.array([b[k] for b in bins], float) for k in ("x", "y", "n")))
    knots = rows.sparkSession.sparkContext.broadcast((x, y))

    def final(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in raw(frames, None, ["doc_id", "held_out"]):
            yield frame.assign(score=np.clip(np.interp(frame.pop("raw"), *knots.value), 0, 1))

    return stats.mapInPandas(final, "doc_id long, held_out boolean, score double")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text); labels (doc_id, quality).

    Only the text is scored. Labels of rows whose crc32(doc_id as text) modulo 3 is 1 (held out) are not read. Null and empty texts
    have the statistics zero and are scored like others; repeated rows get equal scores; a null doc_id has no label.
    """
    stats = measured(docs)
    out = scored(stats, labelled_rows(stats, labels, "quality"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
