"""Recall of the permutation index on vectors without clusters, which are all far from each other."""

from pathlib import Path

import numpy as np
import pytest

from tenderline.llm import neighbours
from tenderline.llm.storage import reachable

GIVEN = Path("/root/testdata/sf0.1/embeddings.parquet")


def recall(got, ids, v, asked):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for q in asked:
        s = u @ u[q]
        s[q] = -2
        hits += (got[got.query_id == ids[q]].score >= np.sort(s)[-5] - 1e-12).sum()
    return hits / 5 / len(asked)


@pytest.mark.skipif(not GIVEN.exists(), reason="needs the given tables")
def test_recall_on_the_given_vectors(spark):
    reachable(spark)
    vectors = spark.read.parquet(str(GIVEN))
    found = vectors.toPandas()
    got = neighbours.search(vectors, vectors.where("vec_id % 50 = 0")).toPandas()
    ids = found.vec_id.to_numpy()
    assert recall(got, ids, np.stack([np.asarray(x, float) for x in found.embedding]), np.flatnonzero(ids % 50 == 0)) >= 0.93


def test_recall_without_clusters(spark):
    reachable(spark)
    v = np.random.default_rng(8).normal(size=(20_000, 64))
    vectors = spark.createDataFrame(list(zip(range(20_000), v.tolist())), "vec_id long, embedding array<double>").repartition(4)
    asked = range(0, 20_000, 200)
    got = neighbours.search(vectors, vectors.where("vec_id % 200 = 0")).toPandas()
    assert recall(got, np.arange(20_000), v, list(asked)) >= 0.93
