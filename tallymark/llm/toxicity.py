"""Toxicity by non-negative positive-unlabelled learning.

A document is the set of its words' character pieces. Pieces that confirmed toxic examples
use far more often than unlabelled text are the features, a numpy logistic model weighs them,
and its risk is the class-prior-corrected one: the positives' part of the unlabelled risk is
taken off, and never below zero (Kiryo and others, 2017).
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Phase, batches, fold, save, text_or_empty

#: Bounds of the training sample, all of it rows with a label, and of the model.
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 4000, 8000, 512
#: Min-hashes of an example's word triples, and how many two examples have in common if they are copies of each other.
SKETCH, BAND, COPY = 64, 8, 52
SPACE = 1 << 20
#: A feature is this many times as frequent in confirmed examples as in unlabelled text, and so many standard deviations from equally frequent. Chosen on the training folds.
LIFT, DEVIATIONS = 2, 4
#: Where the score's decision lies, and by how much at most the bias is raised to bring the share above it to the class prior. Chosen on the training folds.
DECISION, MOST_RAISED = 0.7, 1.0
#: Words a worker remembers, and the longest of them in characters; longer ones are looked at as a whole each time.
MEMORY, LONGEST = 300_000, 128


def pieces(word: str) -> set[int]:
    """The word and its pieces of four to seven bytes, as numbers below SPACE."""
    w, crc = f"<{word}>".encode(), zlib.crc32
    n = len(w)
    out = {crc(w[i : i + k]) & (SPACE - 1) for k in (4, 5, 6, 7) for i in range(n - k + 1)}
    out.add(crc(w) & (SPACE - 1))
    return out


def words(text: str) -> set[str]:
    return set(text.lower().split())


_RANDOM = np.random.default_rng(3)
_TIMES, _PLUS = _RANDOM.integers(1, 1 << 62, SKETCH, np.uint64) | np.uint64(1), _RANDOM.integers(0, 1 << 62, SKETCH, np.uint64)


def sketch(text: str) -> np.ndarray:
    """Min-hashes of the whole text's word triples; the share that two texts have in common estimates their similarity."""
    w = text.lower().encode().split()
    triples = set(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else {tuple(w)}
    h = np.fromiter((zlib.crc32(b" ".join(t)) for t in triples), np.uint64, len(triples))
    least = np.full(SKETCH, (1 << 64) - 1, np.uint64)
    for at in range(0, len(h), 1024):
        least = np.minimum(least, (h[at : at + 1024, None] * _TIMES + _PLUS >> np.uint64(16)).min(0))
    return least


def _sketch(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, 256):
        found = [sketch(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("positive"), pa.array(found, pa.binary())], ["row", "positive", "sketch"])


def copies(sketches: np.ndarray) -> np.ndarray:
    """Which rows have COPY min-hashes or more in common with an earlier one that is none of these itself; found by bands of BAND equal ones."""
    out, seen = np.zeros(len(sketches), bool), {}
    for i, s in enumerate(sketches):
        keys = [(at, s[at : at + BAND].tobytes()) for at in range(0, SKETCH, BAND)]
        near = {j for k in keys for j in seen.get(k, ())}
        if any(int((sketches[j] == s).sum()) >= COPY for j in near):
            out[i] = True
            continue
        for k in keys:
            seen.setdefault(k, []).append(i)
    return out


def one_of_each(sample: DataFrame) -> DataFrame:
    """row, text, positive without near copies, which are folded apart for positive and for other ones: a text that is copied into many examples would make its own words look toxic.

    The driver sees the sketches of the bounded sample.
    """
    found = sample.mapInArrow(_sketch, "row long, positive boolean, sketch binary").collect()
    found.sort(key=lambda r: (r["positive"], r["row"]))
    gone = []
    for kind in (False, True):
        own = [r for r in found if r["positive"] == kind]
        fold_ = copies(np.array([np.frombuffer(r["sketch"], np.uint64) for r in own], np.uint64).reshape(len(own), SKETCH))
        gone += [(r["row"],) for r, c in zip(own, fold_, strict=True) if c]
    small = sample.sparkSession.createDataFrame(gone, "row long")  # at most as many rows as the sample
    return sample.join(F.broadcast(small), "row", "left_anti")


def _frequencies(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many positive and unlabelled documents of the partition each piece is."""
    counts, memory = np.zeros((2, SPACE), np.int32), {}
    for batch in batches(rows, 256):
        for t, positive in zip(batch.column("text").to_pylist(), batch.column("positive").to_pylist(), strict=True):
            found: set[int] = set()
            for w in words(t):
                if (p := memory.get(w)) is None:
                    p = pieces(w)
                    if len(memory) >= 50_000:
                        memory.clear()
                    if len(w) <= LONGEST:
                        memory[w] = p
                found |= p
            counts[0 if positive else 1, list(found)] += 1
    at = np.flatnonzero(counts.any(0))
    for i in range(0, len(at), 50_000):
        part = at[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(counts[0, part], pa.int32()), pa.array(counts[1, part], pa.int32())], ["piece", "p", "u"])


class Memory(dict):
    """Word to its chosen pieces; forgets all when it is full, and never holds a word over LONGEST."""

    def __init__(self, chosen: dict[int, int]):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMORY:
            self.clear()
        chosen = self.chosen
        out = tuple(chosen[p] for p in pieces(word) if p in chosen)
        if len(word) <= LONGEST:
            self[word] = out
        return out


#: A Python worker's memories outlive its tasks: those of the latest scorer.
_MEMORIES: dict[str, Memory] = {}


class Scorer:
    """Document features: which of the chosen pieces it holds."""

    def __init__(self, chosen: dict[int, int], weights: np.ndarray | None = None, bias: float = 0.0):
        self.chosen, self.weights, self.bias, self.name = chosen, weights, bias, uuid.uuid4().hex

    def features(self, text: str) -> set[int]:
        if self.name not in _MEMORIES:
            _MEMORIES.clear()
            _MEMORIES[self.name] = Memory(self.chosen)
        return set().union(*map(_MEMORIES[self.name].__getitem__, words(text)))

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[list(self.features(text))].sum())
        return float(1 / (1 + np.exp(-min(max(z, -50.0), 50.0))))


def train(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 800, rate: float = 0.05, prior_strength: float = 0.03) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise prior * R+(P) + max(0, R-(U) - prior * R-(P)) of the logistic loss, by Adam."""
    l2 = prior_strength / max(1, len(xp))  # a fixed prior on the weights, so a small sample is held back more
    w = np.zeros(xp.shape[1] + 1, np.float64)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    grad = lambda x, d: np.append(x.T @ d.astype(np.float32), d.sum()) / max(1, len(d))
    for step in range(1, steps + 1):
        zp, zu = xp @ w[:-1].astype(np.float32) + w[-1], xu @ w[:-1].astype(np.float32) + w[-1]
        positive = prior * grad(xp, sig(zp) - 1)
        negative = grad(xu, sig(zu)) - prior * grad(xp, sig(zp))
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g = positive + negative if risk >= 0 else -negative  # below zero the correction is undone
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, folds: int, held: int) -> Scorer | None:
    """A scorer from labels of the training folds; None without confirmed examples.

    At most MAX_POSITIVE confirmed documents and MAX_UNLABELLED of all those that have a label, whatever it is, are
    read for it, those with the smallest hash of their id; the latter stand for the unlabelled text, and the class
    prior is the share of confirmed ones among them all. Null labels are no labels; of several labels of one id the largest counts.
    """
    open_rows = labels.where((fold(labels[doc_id], folds) != held) & labels[doc_id].isNotNull() & labels[label].isNotNull())
    known = open_rows.groupBy(doc_id).agg(F.max(label).alias("y"))
    total = known.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    if not total["p"]:
        return None
    prior = min(0.5, max(0.01, total["p"] / total["n"]))
    by_hash = lambda df, n: df.orderBy(F.xxhash64(doc_id), doc_id).limit(n).select(doc_id)
    positive = by_hash(known.where("y = 1"), MAX_POSITIVE).withColumn("positive", F.lit(True))
    plain = by_hash(known, MAX_UNLABELLED).withColumn("positive", F.lit(False))
    chosen = F.broadcast(positive.unionByName(plain))  # at most MAX_POSITIVE + MAX_UNLABELLED ids
    found = docs.select(docs[doc_id].alias("id"), text_or_empty(docs[text]).alias("text")).join(chosen, F.col("id") == F.col(doc_id)).select("id", "text", "positive")
    found = save(found.withColumn("row", F.monotonically_increasing_id()), "found")
    sample = save(one_of_each(found).select("text", "positive"), "sample")
    n = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_p, n_u = n.get(True, 0), n.get(False, 0)
    if not n_p or not n_u:
        return None
    counts = sample.mapInArrow(_frequencies, "piece int, p int, u int").groupBy("piece").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    a, b = F.col("p") / n_p, F.col("u") / n_u
    z = (a - b) / F.sqrt((F.col("p") + F.col("u") + 1) / (n_p + n_u) * (1 / n_p + 1 / n_u))
    best = counts.withColumn("z", z).where((a > LIFT * b) & (F.col("p") >= 3) & (F.col("z") > DEVIATIONS)).orderBy(F.desc("z"), "piece").limit(MAX_FEATURES).collect()
    if not best:
        return None
    scorer = Scorer({r["piece"]: i for i, r in enumerate(best)})

    def vectors(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 256):
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array([sorted(scorer.features(t)) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], ["positive", "f"])

    x = {True: np.zeros((n_p, len(best)), np.float32), False: np.zeros((n_u, len(best)), np.float32)}
    at = {True: 0, False: 0}
    for r in sample.mapInArrow(vectors, "positive boolean, f array<int>").collect():
        x[r["positive"]][at[r["positive"]], r["f"]] = 1
        at[r["positive"]] += 1
    weights, bias = train(x[True], x[False], prior)
    return Scorer(scorer.chosen, weights, bias + raised(x[False] @ weights + bias, prior))


def raised(logits: np.ndarray, prior: float) -> float:
    """What the bias needs so that the share ``prior`` of the unlabelled logits reaches the decision, at most MOST_RAISED: held-back weights leave scores low."""
    least = np.sort(logits)[::-1][min(len(logits) - 1, round(prior * len(logits)))]
    return float(np.clip(math.log(DECISION / (1 - DECISION)) - least, 0, MOST_RAISED))


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held: int = 1) -> DataFrame:
    """One row per input row: ``id, held_out, score``; score is 0 to 1.

    Null text is the empty text: it has no features and the score of the bias alone. Very long texts are
    read whole. Repeated rows and equal texts are scored alike, and ties stay ties. Rows with a null id are in
    the fold of the empty id. Without confirmed examples in the training folds every score is 0. An empty table
    gives no rows. Other columns of ``docs`` are not read, whatever their names.
    """
    with Phase(docs.sparkSession):
        scorer = fit(docs, labels, doc_id, text, label, folds, held)
    kind = docs.schema[doc_id].dataType.simpleString()
    narrow = docs.select(docs[doc_id].alias("id"), (fold(docs[doc_id], folds) == held).alias("held_out"), text_or_empty(docs[text]).alias("text"))
    if scorer is None:
        return narrow.select("id", "held_out", F.lit(0.0).alias("score"))

    def score(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            out = pa.array([scorer.score(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), out], ["id", "held_out", "score"])

    return narrow.mapInArrow(score, f"id {kind}, held_out boolean, score double")
