"""Quality by nearest-neighbour voting over latent-semantic vectors.

A document's terms are its words, hashed, and the shapes of its words (case, digits and marks, runs
folded), with words that repeat their predecessor as a term of their own. Words are weighed by tf-idf,
the document frequencies of which are counted over all documents; shapes by square roots of frequencies.
A truncated singular value decomposition of a bounded sample of labelled documents gives the latent
space. The sample's vectors are broadcast, every document's cosines to all of them come from blocked
matrix products, and its nearest ones vote with the weight of their similarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Phase, batches, fold, fresh, save, text_or_empty

#: At most so many labelled rows of each class are the voters; with RANK floats each they take MAX_VOTERS * 2 * RANK * 4 bytes, a megabyte.
MAX_VOTERS, RANK, NEIGHBOURS, POWER = 2048, 32, 15, 4
#: Word terms by hash; then shapes by hash, the repeated word, and ten steps of the share of different words.
WORDS, SHAPES = 4096, 512
TERMS = WORDS + SHAPES + 11
#: Weight of the words beside the shapes.
SEMANTIC = 1.0
#: Words a worker remembers, a few megabytes, and the longest of them; longer ones are looked at as a whole each time.
MEMORY, LONGEST = 1 << 15, 64
_RUNS = re.compile(r"(.)\1+")


class Marks(dict):
    """Code point to its mark: a letter's case, a digit or the character itself. There are as many as code points at most."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        out = self[point] = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        return out


_MARKS = Marks()


def _term(marks: str) -> int:
    return zlib.crc32(_RUNS.sub(r"\1", marks).encode()) % SHAPES


#: The two shapes of most words.
_SMALL, _CAPITAL = _term("x"), _term("Xx")


def shape(word: str) -> int:
    """The whole word's shape as a term: its marks, where runs count once."""
    if word.isalpha():
        if word.islower():
            return _SMALL
        if word[0].isupper() and word[1:].islower():
            return _CAPITAL
    return _term(word.translate(_MARKS))


def codes_of(word: str) -> int:
    """Shape and word term in one number."""
    return shape(word) * WORDS + zlib.crc32(word.lower().encode()) % WORDS


class Codes(dict):
    """Word to its terms; forgets all when it is full, and never holds a word over LONGEST."""

    def __missing__(self, word: str) -> int:
        if len(word) > LONGEST:
            return codes_of(word)
        if len(self) >= MEMORY:
            self.clear()
        out = self[word] = codes_of(word)
        return out


#: A Python worker's codes outlive its tasks.
_CODES = Codes()


def coded(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_CODES.__getitem__, words), np.int64, len(words))


def term_vector(text: str, idf: np.ndarray) -> np.ndarray:
    words = text.split()
    out = np.zeros(TERMS, np.float32)
    if not words:
        return out
    shapes, terms = np.divmod(coded(words), WORDS)
    tf = np.bincount(terms, minlength=WORDS)
    weighed = np.sqrt(tf) * idf
    if length := float(np.linalg.norm(weighed)):
        out[:WORDS] = weighed * (SEMANTIC / length)
    if sum(map(str.__eq__, words, words[1:])):
        again = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), bool, len(words) - 1)
        shapes[1:][again] = SHAPES
    out[WORDS : WORDS + SHAPES + 1] = np.sqrt(np.bincount(shapes, minlength=SHAPES + 1) / len(words))
    # the share of different words falls with the length in any text, so it is taken over windows of 50
    distinct = np.mean([len(set(words[i : i + 50])) / len(words[i : i + 50]) for i in range(0, len(words), 50)])
    out[WORDS + SHAPES + 1 + min(9, int(distinct * 10))] = 0.3
    return out


def basis_of(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of x, as columns, by subspace iteration from a fixed start."""
    start = np.random.default_rng(17).standard_normal((x.shape[1], min(2 * rank, *x.shape))).astype(np.float32)
    q, _ = np.linalg.qr(x @ start)
    for _ in range(6):
        z, _ = np.linalg.qr(x.T @ q)
        q, _ = np.linalg.qr(x @ z)
    _, s, vt = np.linalg.svd((q.T @ x).astype(np.float64), full_matrices=False)
    return vt[: min(rank, int((s > 1e-6 * max(1e-9, s[0])).sum()))].T.astype(np.float32)


class Voters:
    def __init__(self, vectors: np.ndarray, labels: np.ndarray, weights: np.ndarray, idf: np.ndarray):
        self.prior = float((labels * weights).sum() / weights.sum())
        self.idf, self.basis = idf, basis_of(vectors, RANK)
        self.latent = unit(vectors @ self.basis)
        self.labels, self.weights = labels.astype(np.float32), weights.astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Rows of ``x``: term vectors. All voters as near as the NEIGHBOURS-th vote. Rows without any similarity get the labelled rows' mean."""
        sims = unit(x @ self.basis) @ self.latent.T
        k = min(NEIGHBOURS, sims.shape[1])
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        cosine = np.take_along_axis(sims, near, 1)
        out = self._vote(cosine, self.weights[near], self.labels[near])
        least = cosine.min(1, keepdims=True)
        for r in np.flatnonzero((sims >= least).sum(1) > k):  # ties with the last one
            tied = sims[r] >= least[r]
            out[r] = self._vote(sims[r : r + 1, tied], self.weights[None, tied], self.labels[None, tied])[0]
        return out

    def _vote(self, cosine: np.ndarray, weights: np.ndarray, labels: np.ndarray) -> np.ndarray:
        w = np.maximum(cosine, 0) ** POWER * weights
        total = w.sum(1)
        return np.where(total > 1e-6, (w * labels).sum(1) / np.maximum(total, 1e-6), self.prior)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 1e-9)


def _document_frequencies(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(WORDS, np.int64)
    for batch in batches(rows, 256):
        for t in batch.column("text").to_pylist():
            counts[np.unique(coded(list(set(t.split()))) % WORDS)] += 1
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["term", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """texts: text. ln((documents + 1) / (documents with the term + 1)) of each word term, over all documents; the driver sees at most a row a term."""
    counts, documents = np.zeros(WORDS, np.int64), texts.count()
    for r in texts.mapInArrow(_document_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[r["term"]] = r["n"]
    return np.log((documents + 1) / (counts + 1)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, folds: int, held: int) -> Voters | None:
    """Voters from the training folds: of each class those with the smallest hash of their id, at most MAX_VOTERS.

    A vote counts as much as the class has rows for each of its voters. Of several labels of one id the least counts.
    """
    known = labels.select(F.col(doc_id), F.col(label)).where((fold(F.col(doc_id), folds) != held) & F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id).agg(F.min(label).alias("y"))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64(doc_id), doc_id).limit(MAX_VOTERS) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * MAX_VOTERS rows
    texts = docs.select(docs[doc_id].alias("id"), text_or_empty(docs[text]).alias("text"))
    sample = texts.join(chosen, F.col("id") == F.col(doc_id)).select("id", "text", "y")
    idf = inverse_frequencies(texts.select("text"))

    def vectors(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 256):
            x = [term_vector(t, idf) for t in batch.column("text").to_pylist()]
            at = [np.flatnonzero(v).astype(np.int32) for v in x]
            values = pa.array([v[i].tobytes() for v, i in zip(x, at, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array([i.tobytes() for i in at], pa.binary()), values], ["id", "y", "at", "v"])

    kinds = {f.name: f.dataType.simpleString() for f in sample.schema}
    rows = sorted(save(sample.mapInArrow(vectors, f"id {kinds['id']}, y {kinds['y']}, at binary, v binary"), "voters").collect(), key=lambda r: (r["id"], r["at"], r["v"]))
    if not rows:
        return None
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["v"], np.float32)
    y = np.array([r["y"] for r in rows])
    weights = np.array([n[c] / max(1, (y == c).sum()) for c in y], float)
    return Voters(x, y, weights / weights.max(), idf)


def _scored(docs: DataFrame, voters: Voters | None, text: str, name: str) -> DataFrame:
    if voters is None:
        return docs.withColumn(name, F.lit(0.5))

    def score(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 256):
            x = np.stack([term_vector(t or "", voters.idf) for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(voters.score(x).astype(np.float64))], [*batch.schema.names, name])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held: int = 0) -> DataFrame:
    """One row per input row: ``id, held_out, score`` (0 to 1, higher: label 1 likelier).

    Null and empty texts have no terms and get the voters' mean label; without any voter the
    score is 0.5. Very long texts are read whole. Repeated rows are scored alike. Voters that tie for the
    last place all vote. Rows with a null id are in the fold of the empty id; null labels are no labels.
    An empty table gives no rows. Other columns of ``docs`` are not read, whatever their names.
    """
    with Phase(docs.sparkSession):
        voters = fit(docs, labels, doc_id, text, label, folds, held)
    narrow = docs.select(docs[doc_id].alias("id"), (fold(docs[doc_id], folds) == held).alias("held_out"), docs[text].alias("text"))
    return _scored(narrow, voters, "text", "score").select("id", "held_out", "score")


def keep_quality(docs: DataFrame, labels: DataFrame, least: float, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held: int = 0) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, all columns kept, whatever their names.

    Scores are those of ``score_quality``: so null and empty texts stay if the voters' mean label is ``least`` or more,
    all rows stay without any voter, repeated rows stay or go together, and an empty table gives an empty one.
    """
    name = fresh(docs, "_score")
    with Phase(docs.sparkSession):
        voters = fit(docs, labels, doc_id, text, label, folds, held)
    return _scored(docs, voters, text, name).where(F.col(name) >= least).drop(name)
