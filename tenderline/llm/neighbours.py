"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order of nearness. Inverted files hold, for each pivot, its place in the order of each
vector, the place after the last where it is not among them: as most vectors have most pivots, a file has an entry for each vector of its part. A query adds up, over the files of its own
pivots, how far the places are apart (the footrule distance of the truncated orders); the vectors of least distance are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tenderline.llm.storage import store

PIVOTS, PLACES = 256, 160
#: Share of an index part, and least number of its vectors, that are compared exactly for each query.
SHARE, LEAST = 0.05, 400
#: Vectors in a part of the index; queries asked at once; vectors from which pivots are drawn.
PART, BLOCK, SAMPLE = 20_000, 4_000, 20_000


def usable(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and v (array<double>) of the vectors that can be compared: not null, no null or non-finite component, not zero; of rows of one id, one."""
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(column), lambda c: c.cast("double")).alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return x.where(F.coalesce(finite, F.lit(False))).groupBy("vec_id").agg(F.min("v").alias("v"))


def commonest_dimension(x: DataFrame) -> int:
    """The dimension of most vectors; of equally common ones the larger; 0 without vectors."""
    found = x.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return found[0]["d"] if found else 0


def lengths(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their Euclidean lengths); rows whose squares would leave the range of doubles are divided by their largest component first."""
    most = np.abs(rows).max(axis=1, initial=0.0)
    odd = (most < 1e-100) | (most > 1e100)
    rows = np.where(odd[:, None], rows / most[:, None], rows) if odd.any() else rows
    return rows, np.sqrt(np.einsum("ij,ij->i", rows, rows))


def unit(rows: np.ndarray) -> np.ndarray:
    rows, size = lengths(rows)
    return rows / size[:, None]


def places(units: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """[vector, place]: the nearest pivots, nearest first (ties to the smaller number)."""
    return np.argsort(-(units @ pivots.T), axis=1, kind="stable")[:, :n].astype(np.int32)


def draw_pivots(x: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """n different directions at random among the SAMPLE vectors of least id hash."""
    found = x.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(SAMPLE).select("v").toPandas()
    if not len(found):
        return np.zeros((0, 0))
    units = unit(np.unique(np.stack(found["v"].to_numpy()), axis=0))
    rng = np.random.default_rng(5)
    return units[rng.permutation(len(units))[:n]]


def build_index(x: DataFrame, pivots: np.ndarray, total: int) -> DataFrame:
    """part, vec_id, v, near (numbers of the PLACES nearest pivots, nearest first), stored; parts have about PART vectors."""
    shared = x.sparkSession.sparkContext.broadcast(pivots)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(near=list(places(unit(np.stack(frame["v"].to_numpy())), shared.value, min(PLACES, len(shared.value)))))

    parts = max(1, -(-total // PART))
    keyed = x.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(parts)).cast("int")).repartition(parts, "part").sortWithinPartitions("part", "vec_id")
    return store(keyed.select("part", "vec_id", "v").mapInPandas(work, "part int, vec_id long, v array<double>, near array<int>"), "pivot_index")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: of each query (vec_id, embedding) its k nearest found among the vectors, by cosine in
    double precision, ties to the smaller vec_id; a vector of the query's own id is no candidate.

    Vectors and queries that cannot be compared (see usable) take no part, nor do those of another dimension than most vectors
    have. Fewer candidates than k give fewer rows; of rows of one id with different vectors the least vector counts. The index is stored, in
    parts of about PART vectors; queries are asked in blocks, of every part.
    """
    spark = vectors.sparkSession
    x = usable(vectors)
    d = commonest_dimension(x)
    x = x.where(F.size("v") == d)
    total = x.count()
    drawn = draw_pivots(x)
    index = build_index(x, drawn, total)
    asked = usable(queries).where(F.size("v") == d)
    n_blocks = max(1, -(-asked.count() // BLOCK))
    asked = store(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))), "queries")
    pivots = spark.sparkContext.broadcast(drawn)
    found = []
    for b in range(n_blocks):
        own = asked.where(F.col("block") == b).orderBy("vec_id").toPandas()  # about BLOCK rows
        if len(own):
            block = spark.sparkContext.broadcast((own["vec_id"].to_numpy(np.int64), np.stack(own["v"].to_numpy())))
            found.append(index.mapInPandas(lambda f, block=block: _nearest(f, pivots.value, block.value, k, share), "query_id long, vec_id long, score double"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one part after the other, as far as they stand together."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        for _, own in frame.groupby("part"):
            if held and held[-1]["part"].iloc[0] != own["part"].iloc[0]:
                yield pd.concat(held)
                held = []
            held.append(own)
    if held:
        yield pd.concat(held)


def _nearest(frames: Iterator[pd.DataFrame], pivots: np.ndarray, block: tuple, k: int, share: float) -> Iterator[pd.DataFrame]:
    q_ids, q = block
    m = min(PLACES, len(pivots))
    q_places = places(unit(q), pivots, m)
    q, q_norms = lengths(q)
    for frame in _parts(frames):
        ids, v = frame["vec_id"].to_numpy(np.int64), np.stack(frame["v"].to_numpy())
        order = np.argsort(ids, kind="stable")
        ids, n = ids[order], len(ids)
        v, norms = lengths(v[order])
        own = np.stack(frame["near"].to_numpy())[order]
        # inverted files: by pivot, the place it has in each vector
        files = np.full((n, len(pivots)), m, np.int16)
        np.put_along_axis(files, own, np.arange(m, dtype=np.int16)[None, :], axis=1)
        files = np.ascontiguousarray(files.T)
        keep = min(n, max(LEAST, int(share * n)))
        gap = np.empty(n, np.int16)
        for i in range(len(q_ids)):
            near = np.zeros(n, np.int32)
            for r, p in enumerate(q_places[i]):
                np.subtract(files[p], np.int16(r), out=gap)
                near -= np.abs(gap, out=gap)
            edge = np.partition(near, n - keep)[n - keep]
            sure, tied = np.flatnonzero(near > edge), np.flatnonzero(near == edge)
            cand = np.concatenate([sure, tied[: keep - len(sure)]])  # ties to the smaller vec_id
            cand = cand[ids[cand] != q_ids[i]]
            score = np.einsum("ij,j->i", v[cand], q[i]) / (norms[cand] * q_norms[i])
            best = np.lexsort((ids[cand], -score))[:k]
            yield pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[cand][best], "score": score[best]})
