"""Toxicity by weak supervision.

Many weak voters (lexicons mined from labelled texts, and patterns) vote toxic, clean, or not at all. A generative
label model explains the votes by one hidden class: the covariance of two voters that are independent given the class is
the product of their accuracies, so the accuracies come from the off-diagonal of the vote covariance; what they leave
unexplained is the voters' own correlation. Posteriors under that model label the documents on which a linear
classifier is trained, which then scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenderline.llm.language import fold
from tenderline.llm.quality import labelled_rows
from tenderline.llm.storage import store
from tenderline.llm.text import slices

#: Labelled texts (those of least id hash) that the lexicon and the classifier are fitted on; terms of the lexicon; groups of its terms.
SAMPLE, TERMS, GROUPS = 40_000, 600, 8
PREFIXES = (4, 5, 6)
WORD = r"[^\W\d_]+"


def terms_of(word: str) -> tuple[str, ...]:
    """A word as a whole (marked by a final $), and its beginnings, which catch inflected and made-up forms."""
    return (word + "$", *(word[:n] for n in PREFIXES if len(word) > n))


def _words(text: str | None) -> list[str]:
    import regex

    return regex.findall(WORD, (text or "").lower())


def mine_lexicon(sample: DataFrame, n_terms: int = TERMS) -> list[str]:
    """Terms that toxic texts have and others lack, the strongest first; sample has text and label.

    All terms of `least` toxic texts or more are weighed; only the n_terms strongest pass the driver.
    """
    toxic, clean = sample.where("label = 1"), sample.where("label = 0")
    n_toxic, n_clean = (r := sample.agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b")).first())["a"], r["b"]

    def count(rows: DataFrame, name: str) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tally: dict[str, int] = {}
            known: dict[str, tuple] = {}

            def counted() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["term", "n"])

            for batch in batches:
                for text in batch.column("text").to_pylist():
                    found: set = set()
                    for w in set(_words(text)):
                        if w not in known:
                            if len(known) > 300_000:
                                known.clear()
                            known[w] = terms_of(w[:40])
                        found.update(known[w])
                    for t in found:
                        tally[t] = tally.get(t, 0) + 1
                    if len(tally) > 500_000:
                        yield counted()
                        tally = {}
            yield counted()

        return rows.select("text").mapInArrow(work, "term string, n long").groupBy("term").agg(F.sum("n").alias(name))

    if not n_toxic or not n_clean:
        return []
    least = max(3, int(0.002 * n_toxic))
    both = count(toxic, "n").where(F.col("n") >= least).join(count(clean, "m"), "term", "left")
    strength = F.log((F.col("n") + 0.5) / (n_toxic + 1)) - F.log((F.coalesce("m", F.lit(0)) + 0.5) / (n_clean + 1))
    best = both.withColumn("strength", strength).where("strength > 1.5").orderBy(F.desc("strength"), "term").limit(n_terms)
    return [r["term"] for r in best.select("term").collect()]


VOTERS = GROUPS + 6
N_FEATURES = 2 * GROUPS + 6


def measure(docs: DataFrame, lexicon: list[str], *keep: str) -> DataFrame:
    """Columns `keep` with the votes (array<int>: 1 toxic, -1 clean, 0 none) and features of each text.

    Voter g of GROUPS holds each GROUPS-th term of the lexicon: any of its terms votes toxic. Patterns: two or more
    different hits, hits on more than 1 % of the words, two hits within 20 words, a hit in capitals; no hit at all and
    no beginning of any term vote clean.
    """
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(lexicon)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        number, word = shared.value, regex.compile(WORD)
        short = {t.rstrip("$")[:4] for t in number}
        known: dict[str, tuple] = {}
        for batch in slices(batches, size=4 << 20):
            votes, features = [], []
            for text in batch.column("text").to_pylist():
                low = (text or "").lower()
                places, hits, terms, n = [], {}, set(), 0
                for n, w in enumerate(word.findall(low), 1):
                    if w[:4] not in short:
                        continue
                    if w not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[w] = tuple(number[t] for t in terms_of(w[:40]) if t in number)
                    for t in known[w]:
                        hits[t] = hits.get(t, 0) + 1
                    if known[w]:
                        places.append(n)
                        terms.add(w)
                loud = bool(terms) and any(w.isupper() and w.lower() in terms for w in word.findall(text))
                by = np.zeros(GROUPS)
                for t, k in hits.items():
                    by[t % GROUPS] += k
                close = any(b - a <= 20 for a, b in zip(places, places[1:]))
                dense = len(places) > 0.01 * n
                v = [*(by > 0).astype(int), int(len(places) > 1), int(dense and bool(places)), int(close), int(loud), 0 if places else -1, 0 if hits else -1]
                votes.append(v)
                features.append([*np.log1p(by), *(by > 0), np.log1p(len(places)), len(places) / max(n, 1), len(set(hits)) > 1, close, np.log1p(n), loud])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([list(map(int, v)) for v in votes], pa.list_(pa.int32())), pa.array([list(map(float, f)) for f in features], pa.list_(pa.float64()))], names=[*keep, "votes", "features"])

    kept = docs.select(*keep, F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")
    return kept.mapInArrow(work, f"{fields}, votes array<int>, features array<double>")


class LabelModel:
    """Accuracies and correlations of voters from the mean and covariance of their votes alone, and posteriors."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray, prior: float, drop: float = 0.15):
        v = len(mean)
        spread = 4 * prior * (1 - prior)  # variance of the class, coded -1 and 1
        off = ~np.eye(v, dtype=bool)
        # three voters that are independent given the class tell the accuracy of each; the median over all such triples bears some that are not
        safe = np.where(np.abs(cov) > 1e-9, cov, np.nan)
        a = np.zeros(v)
        for i in range(v):
            rest = [j for j in range(v) if j != i]
            told = [safe[i, j] * safe[i, k] / safe[j, k] for n, j in enumerate(rest) for k in rest[n + 1 :]]
            told = [t for t in told if np.isfinite(t) and t > 0]
            a[i] = np.sqrt(np.median(told) / spread) if told else 0.0
        lead = int(np.argmax(a))
        a *= np.where(cov[lead] < 0, -1, 1)
        a = np.clip(a, -1, 1)
        for _ in range(2):  # without pairs that agree more than the class explains
            left = np.abs(cov - spread * np.outer(a, a)) * off
            cut = np.quantile(left[off], 1 - drop) if off.any() else 0
            pairs = off & (left <= cut)
            for _ in range(50):
                a = np.clip((cov * pairs) @ a / np.maximum(spread * (pairs @ a**2), 1e-9), -1, 1)
        self.accuracy = a if a.sum() >= 0 else -a  # better than chance on the whole
        self.correlation = cov - spread * np.outer(self.accuracy, self.accuracy)
        own = (self.correlation + self.correlation.T) / 2
        values, vectors = np.linalg.eigh(own)
        floor = max(1e-2 * np.trace(cov) / v, 1e-4)
        inverse = vectors @ np.diag(1 / np.maximum(values, floor)) @ vectors.T
        self.weight = inverse @ (2 * self.accuracy)
        base = mean - (2 * prior - 1) * self.accuracy  # mean vote at the middle of the classes
        self.bias = np.log(prior / (1 - prior)) - self.weight @ base

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(votes @ self.weight + self.bias, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (the last one is the intercept) of a logistic regression on soft labels, by Newton's method."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    keep = ridge * np.eye(len(w))
    keep[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + keep, z.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text); labels (doc_id, toxic).

    Only the text is scored. Labels of rows whose crc32(doc_id as text) modulo 3 is 1 (held out) are not read; of the others, the
    `sample` rows of least id hash give the lexicon, the class share and the scale of the final score. The label model's
    moments are taken over all documents. Null and empty texts have no hits and score low; repeated rows get equal scores;
    without labelled toxic and clean texts all score 0.5.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(docs, 3, 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    picked = labelled_rows(marked.select("doc_id", "held_out").distinct(), labels, "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "label")
    picked = store(picked, "picked")
    train = store(marked.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text"), "labelled")
    lexicon = mine_lexicon(train)
    if not lexicon:
        return marked.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(int(0.5 >= threshold)).alias("predicted"))
    facts = store(measure(marked, lexicon, "doc_id", "held_out"), "votes")
    pairs = [(i, j) for i in range(VOTERS) for j in range(i, VOTERS)]
    moments = facts.agg(*[F.avg(F.col("votes")[i]).alias(f"m{i}") for i in range(VOTERS)], *[F.avg(F.col("votes")[i] * F.col("votes")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    mean = np.array([moments[f"m{i}"] for i in range(VOTERS)])
    cov = np.zeros((VOTERS, VOTERS))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = moments[f"c{i}_{j}"] - mean[i] * mean[j]
    own = facts.join(F.broadcast(picked), "doc_id").select("label", "votes", "features").toPandas()  # `sample` rows of few numbers
    y = own["label"].to_numpy(float)
    model = LabelModel(mean, cov, float(np.clip(y.mean(), 0.01, 0.99)))
    posterior = model.posterior(np.stack(own["votes"].to_numpy()).astype(float))
    x = np.stack(own["features"].to_numpy())
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    w = logistic((x - center) / scale, posterior)
    # the scale of the score: one slope and one shift, from the given labels
    linear = ((x - center) / scale) @ w[:-1] + w[-1]
    slope, shift = logistic(linear[:, None], y, ridge=1e-2)
    final = (w[:-1] / scale * slope, (w[-1] - center @ (w[:-1] / scale)) * slope + shift)
    line = sum((F.col("features")[i] * float(c) for i, c in enumerate(final[0])), F.lit(float(final[1])))
    return facts.select("doc_id", "held_out", (1 / (1 + F.exp(-line))).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
