"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix (native).

The input partitions p hold n_p rows, the shards s get N // S or N // S + 1 rows. Under a uniform permutation
the number of rows that go from p to s follows a multivariate hypergeometric law, so the matrix of counts is drawn
first (numbers only), then each partition permutes its rows and deals out exactly these counts, and each shard
permutes what it has received.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tenderline.llm.storage import store


def communication_matrix(rows: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Counts [partition, shard] of a uniform permutation; column sums differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(rows)
    left = np.full(n_shards, total // n_shards, np.int64)
    left[rng.permutation(n_shards)[: total % n_shards]] += 1
    out = np.zeros((len(rows), n_shards), np.int64)
    for p, n in enumerate(rows):
        out[p] = _draw(rng, left, n)
        left -= out[p]
    return out


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows go to each shard, of which `left` rows are still to come: one hypergeometric draw after another."""
    out, rest, total = np.zeros_like(left), int(n), int(left.sum())
    for s, m in enumerate(left.tolist()):
        out[s] = hypergeometric(rng, m, total - m, rest)
        rest, total = rest - int(out[s]), total - m
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn without replacement are among the `good`, at any size.

    numpy's sampler takes fewer than 10**9 rows; beyond, the distribution is inverted: the ratios of neighbouring probabilities are known,
    so all within 20 standard deviations of the mean (what lies beyond is less than 1e-80) follow from the one in the middle.
    """
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high, total = max(0, n - bad), min(good, n), good + bad
    if low == high:
        return low
    share = good / total
    spread = int(20 * np.sqrt(n * share * (1 - share) * (total - n) / (total - 1))) + 20
    first, last = max(low, int(n * share) - spread), min(high, int(n * share) + spread)
    x = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(bad - n + x + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(weight - weight.max()))
    return first + int(np.searchsorted(chance, rng.random() * chance[-1], "right"))


def shuffle_shards(rows: DataFrame, n_shards: int = 24, seed: int = 7, chunk_rows: int = 200_000) -> DataFrame:
    """`rows` with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in each shard), a uniform permutation.

    Rows: any columns, but not _part, _key, _chunk, _rank or _base. Nulls, ties and repeated rows are rows like
    others: each gets its own slot. An empty table gives an empty table. Shard sizes differ by one at most.
    What is kept in one task is an input partition or a chunk of about chunk_rows rows of a shard.
    """
    spark = rows.sparkSession
    wide = rows.withColumn("_part", F.spark_partition_id()).withColumn("_key", F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), *[c for c, k in rows.dtypes if not k.startswith("map")]))
    wide = store(wide, "shard_rows")
    counts = {r["_part"]: r["n"] for r in wide.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a number for each partition
    parts = sorted(counts)
    total = sum(counts.values())
    matrix = communication_matrix([counts[p] for p in parts], n_shards, seed)
    cumulated = matrix.cumsum(axis=1)
    ends = spark.createDataFrame([(p, [int(x) for x in cumulated[i]]) for i, p in enumerate(parts)], T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_ends", T.ArrayType(T.LongType()))]))
    # permute locally: ranks by a random key within the partition; the r-th row goes to the first shard with r < end
    local = wide.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("_key")).cast("long") - 1)
    dealt = local.join(ends, "_part").withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).cast("int")).drop("_ends", "_rank")
    # permute again in the shard: chunks by a second random key, then ranks in the chunk
    n_chunks = max(1, -(-total // (n_shards * chunk_rows)))
    dealt = dealt.withColumn("_key", F.xxhash64(F.lit(seed + 1), "_key", "_part")).withColumn("_chunk", F.pmod(F.shiftrightunsigned("_key", 17), F.lit(n_chunks)).cast("int"))
    sizes = dealt.groupBy("shard", "_chunk").agg(F.count("*").alias("_n"))
    bases = sizes.select("shard", "_chunk", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_chunk")) - F.col("_n")).alias("_base"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy("_key", "_part")))
    return ranked.join(bases, ["shard", "_chunk"]).withColumn("slot", F.col("_base") + F.col("_rank") - 1).drop("_part", "_key", "_chunk", "_rank", "_base")


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def shard_documents(docs: DataFrame, n_shards: int = 24, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; the law is `rows`.

    Equal texts are rows like others: they spread over the shards. A null text has size 8 and the checksum 0.
    """
    slim = docs.select("doc_id", text_size(F.col("text")).alias("size"), F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"))
    return shuffle_shards(slim, n_shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
