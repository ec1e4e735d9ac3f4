"""Secret scans: fixed patterns plus a randomness battery with false-discovery control.

Fixed patterns give the base spans. Other long runs of key characters are candidates: the
encoding is inferred (the smallest alphabet that holds the run), and three tests look at it
as symbols of that alphabet: chi-squared uniformity, the number of runs of character classes,
and lag-one serial correlation. Each has two sides. A run that is unlikely under uniform random
symbols, by any of them, is no candidate. For the others each test gives a p-value against ordinary
writing, in which symbols are as uneven as letters of a language, the class changes at a known
low rate, and so neighbours are alike. The harmonic mean of the three p-values, which allows for their
dependence, is the candidate's; Benjamini-Hochberg over all candidates of the corpus, apart for each
length class, sets the p-value up to which they count. A run of one class has p-value 1 in the last two tests.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, save, text_or_empty

# The patterns of the contract.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
#: One of these is in the lower-cased text wherever ASSIGN matches.
HINTS = ("passw", "secret", "token", "apikey", "api_key")
#: Every access or hex match that is long enough lies in such a run, and starts where a match in the run starts.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

ALPHABETS = [
    ("dec", "0-9", 10), ("hex", "0-9a-f", 16), ("HEX", "0-9A-F", 16), ("base32", "A-Z2-7", 32), ("base36", "a-z0-9", 36), ("BASE36", "A-Z0-9", 36),
    ("base62", "A-Za-z0-9", 62), ("base64", "A-Za-z0-9+/", 64), ("base64url", "A-Za-z0-9_-", 64), ("mixed", "A-Za-z0-9+/_=-", 67),
]
ALPHABETS = [(name, re.compile(f"[{body}]+"), k) for name, body, k in ALPHABETS]
#: Rate at which the character class changes in ordinary words, names, paths and dates.
CHANGE_RATE = 0.15
#: Chance that two letters of ordinary writing are equal; digits are taken as even, so they alone never differ from it.
COINCIDENCE = 0.065
#: A test that is less likely than this for a random string speaks against it.
ALPHA = 1e-3
#: Bins of -log10(p), a tenth each.
BINS = 400
LENGTHS = (20, 32, 64, 128)


def chi2_upper(x: float, k: int) -> float:
    """P(chi-squared with k degrees of freedom >= x), by Wilson and Hilferty's cube-root normal."""
    if x <= 0:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


@lru_cache(maxsize=4096)
def many_changes(changes: int, pairs: int) -> float:
    """-log10 P(at least so many class changes among so many pairs of ordinary writing)."""
    p, q = math.log(CHANGE_RATE), math.log1p(-CHANGE_RATE)
    logs = [math.lgamma(pairs + 1) - math.lgamma(i + 1) - math.lgamma(pairs - i + 1) + i * p + (pairs - i) * q for i in range(changes, pairs + 1)]
    top = max(logs)
    return max(0.0, -(top + math.log(sum(math.exp(x - top) for x in logs))) / math.log(10))


def normal_tail(z: float) -> float:
    """-log10 of P(standard normal >= z), also where it is too small for a float."""
    p = 0.5 * math.erfc(z / math.sqrt(2))
    return -math.log10(p) if p > 1e-300 else (z * z / 2 + math.log(z * math.sqrt(2 * math.pi))) / math.log(10)


def evenness(x2: float, n: int, k: int, letters: float) -> float:
    """-log10 P(chi-squared no larger than ``x2`` in ordinary writing): a non-central one, the larger the more letters there are; normal."""
    excess = letters * letters * n * max(0.0, k * COINCIDENCE - 1)
    return normal_tail((k - 1 + excess - x2) / math.sqrt(2 * (k - 1) + 4 * excess)) if excess else 0.0


def independence(r: float, between: float, n: int) -> float:
    """-log10 P(serial correlation no larger than ``r`` in ordinary writing), where the share of variance that lies between classes goes on from symbol to symbol."""
    return normal_tail((between * (1 - 2 * CHANGE_RATE) - r) * math.sqrt(n)) if between else 0.0


def combined(evidence: list[float]) -> float:
    """-log10 of the harmonic mean of p-values given as -log10."""
    top = max(evidence)
    return max(0.0, top + math.log10(sum(10 ** (e - top) for e in evidence) / len(evidence)))


def battery(s: str) -> float | None:
    """-log10 of the p-value against ordinary writing, or None if the string does not look random."""
    s = s.rstrip("=")
    n = len(s)
    if n < 20:
        return None
    k = next(k for _, body, k in ALPHABETS if body.fullmatch(s))
    codes = np.frombuffer(s.encode(), np.uint8)
    counts = np.bincount(codes)
    x2 = float((counts.astype(float) ** 2).sum()) * k / n - n
    if chi2_upper(x2, k - 1) < ALPHA:
        return None
    kind = (codes >= 48) & (codes <= 57), (codes >= 65) & (codes <= 90), (codes >= 97) & (codes <= 122)
    letters = float((kind[1] | kind[2]).mean())
    kind = kind[0] + 2 * kind[1] + 3 * kind[2]
    _, ranks = np.unique(codes, return_inverse=True)
    d = ranks - ranks.mean()
    power = float((d * d).sum())
    if not power:
        return None
    r = float((d[1:] * d[:-1]).sum()) / power
    if abs(r + 1 / n) * math.sqrt(n) > 3.29:
        return None
    sizes, sums = np.bincount(kind), np.bincount(kind, d)
    between = float((sums[sizes > 0] ** 2 / sizes[sizes > 0]).sum()) / power
    changes = many_changes(int((kind[1:] != kind[:-1]).sum()), n - 1)
    return combined([evenness(x2, n, k, letters), changes, independence(r, between, n)])


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans (start, kind, end) in order, and candidates (start, end, length class, bin)."""
    base, found = [], []
    low = text.lower()
    if any(h in low for h in HINTS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in RUN.finditer(text):
        at, s = run.start(), run[0]
        base += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(s) if m.end() - m.start() >= 20] if "AKIA" in s else []
        base += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(s) if m.end() - m.start() >= 24]
        if (p := battery(s)) is not None:
            found.append((at, at + len(s), sum(len(s) >= x for x in LENGTHS), min(BINS - 1, int(p * 10))))
    base.sort()
    # candidates are in order and apart, so one sweep finds those that a base span overlaps
    free, at, reach = [], 0, 0
    for c in found:
        while at < len(base) and base[at][0] < c[1]:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= c[0]:
            free.append(c)
    return base, free


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
CANDIDATE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("length", pa.int32()), ("bin", pa.int32())]))


def _scan(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows):
        both = [spans(t) for t in batch.column("text").to_pylist()]
        base = pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in b] for b, _ in both], SPAN)
        more = pa.array([[{"start": s, "end": e, "length": n, "bin": p} for s, e, n, p in c] for _, c in both], CANDIDATE)
        yield pa.RecordBatch.from_arrays([batch.column("id"), base, more], ["id", "base", "more"])


def thresholds(found: DataFrame, rate: float) -> dict[int, int]:
    """Benjamini-Hochberg over all candidates: the smallest bin that counts, for each length class.

    The driver sees at most a row per length class and bin.
    """
    bins = found.select(F.explode("more").alias("c")).groupBy("c.length", "c.bin").count().collect()
    out = {}
    for length in {r["length"] for r in bins}:
        counts = np.zeros(BINS, int)
        for r in bins:
            counts[r["bin"]] += r["count"] if r["length"] == length else 0
        above, total = counts[::-1].cumsum()[::-1], counts.sum()
        passing = [b for b in range(BINS) if above[b] and 10 ** (-b / 10) <= rate * above[b] / total]
        if passing:
            out[length] = min(passing)
    return out


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: float = 0.001) -> DataFrame:
    """One row per input row: ``id, n_assign, n_access, n_hex, base, spans`` (kind:start:end, comma-joined, code points, end exclusive).

    Null text is the empty text and has no spans; very long texts are scanned whole. Repeated rows are scanned each
    by itself, and count each among the candidates. Spans of one start are in the order of kinds. An empty table gives
    no rows. Other columns of ``docs`` are not read, whatever their names.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    narrow = docs.select(docs[doc_id].alias("id"), text_or_empty(docs[text]).alias("text"))
    found = save(narrow.mapInArrow(_scan, f"id {kind}, base array<struct<start:bigint,kind:int,end:bigint>>, more array<struct<start:bigint,end:bigint,length:int,bin:int>>"), "spans")
    least = thresholds(found, rate)
    keeps = lambda c: _any([(c["length"] == length) & (c["bin"] >= b) for length, b in least.items()])
    random = F.transform(F.filter("more", keeps), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda a: F.array_join(F.transform(a, name), ",")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), joined(F.col("base")).alias("base"), joined(F.array_sort(F.concat(F.col("base"), random))).alias("spans"))


def _any(tests: list) -> object:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out
