"""Packing along a space-filling curve.

A document is a bag of hashed words, projected by random signs onto three axes; its place in
that space is its Hilbert key. Documents are range-sorted by key, tokenised in that order and
laid end to end; each range cuts its stream into sequences. Every sequence but a range's last
ones is full, and what is left at a range's end is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, text_or_empty

AXES, BITS = 3, 10
#: Bits of a word's hash that are its signs.
SIGN_BITS = (3, 10, 17)
# Fixed value: how byte-level BPE cuts a text before merging.
BYTE_LEVEL_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Anything but printable Latin text and its usual white space.
NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x7E\u00A1-\u024F]")
#: The same of Latin-1 texts.
PLAIN_BYTES = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])
PROBE = "It's 12 o'clock,\n\n  isn't it?\tAieê ñandú  Übergröße... (x_1) we'll  "


def project(text: bytes) -> list[int]:
    """Coordinates of a text, 0 to 2**BITS - 1 on each axis: the standardised sum of its different words' signs through the normal distribution.

    Words count once: else common words would carry all long texts into a few corners, and a range of keys would be all long texts.
    """
    words = set(text.lower().split())
    n = len(words)
    if not n:
        return [0] * AXES
    h = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    sums = [2 * int(np.count_nonzero(h & np.uint32(1 << bit))) - n for bit in SIGN_BITS]
    return [min((1 << BITS) - 1, int(0.5 * math.erfc(-s / math.sqrt(2 * n)) * (1 << BITS))) for s in sums]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Indices of points (rows) on the Hilbert curve, by Skilling's transform (2004), all points at once."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, t)
            x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t ^= np.where(x[-1] & q, q - 1, 0)
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | v >> b & 1
    return out


#: A document's place is its Hilbert key, then so many bits that order documents of one key.
TIE = 32
#: Documents of a range at least.
FEWEST = 16
#: Sampled places for each range, and in all.
PLACES, MOST_PLACES = 100, 1_000_000
PLACED = T.StructType([T.StructField("place", T.LongType()), T.StructField("range", T.IntegerType())])


def placed(bounds: np.ndarray):
    """Place of each text on the curve and the range it is in; the text itself stays in the JVM."""

    @F.arrow_udf(PLACED)
    def run(texts: pa.Array, ties: pa.Array) -> pa.Array:
        rows = batches([pa.RecordBatch.from_arrays([texts], ["text"])], 256)
        points = np.array([project(t) for part in rows for t in part.column("text").to_pylist()], np.int64).reshape(-1, AXES)
        place = hilbert(points) << TIE | ties.to_numpy(zero_copy_only=False)
        number = np.searchsorted(bounds, place, side="right").astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(place), pa.array(number)], ["place", "range"])

    return run


def in_ranges(docs: DataFrame) -> DataFrame:
    """id, text in partitions that are ranges of the curve, sorted by place.

    Borders come from a sample of places, as a range exchange's do, but only sampled texts are
    projected for it. They balance the partitions and decide nothing else.
    """
    spark = docs.sparkSession
    n = docs.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // FEWEST))
    tie = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << TIE) - 1))
    rows = docs.withColumn("tie", tie)
    share = min(1.0, min(PLACES * parts, MOST_PLACES) / max(1, n))
    some = rows.sample(share, seed=1) if share < 1 else rows
    found = some.select(placed(np.empty(0, np.int64))(F.col("text").cast("binary"), "tie")["place"].alias("place")).collect()
    places = np.sort(np.array([r["place"] for r in found], np.int64))
    bounds = places[np.arange(1, parts) * len(places) // parts] if len(places) else places
    rows = rows.withColumn("at", placed(bounds)(F.col("text").cast("binary"), "tie"))
    return rows.repartitionById(parts, F.col("at.range")).sortWithinPartitions("at.place").select("id", "text")


def _bytes_of(token: str, char_bytes: dict[str, int]) -> bytes:
    return bytes(char_bytes[c] for c in token)


def _byte_characters() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others as the characters from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(0x100 + i): b for i, b in enumerate(moved)}


class Encoder:
    """Ids of whole texts by a tokenizer file of the tokenizers library, four bytes each.

    A byte-level BPE file is also read into a tiktoken encoding, which gives the same ids
    several times as fast; it takes the texts of PLAIN characters, on which both libraries'
    character classes agree and which hold no special token. All others, and files of another
    kind, go through the tokenizers library itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._fast()

    def _fast(self) -> object | None:
        """The tiktoken twin of a byte-level file whose ids are the ranks of its merges. None if the file is of another kind."""
        spec = json.loads(self.tokenizer.to_str())
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
            return None
        char_bytes, vocab = _byte_characters(), model["vocab"]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        plain = {t: i for t, i in vocab.items() if t not in self.special}
        # ids in the order of the merges, and no token but bytes and merged ones: then an id is a rank
        in_order = all(x < y for x, y in zip(merged, merged[1:], strict=False)) and {i for t, i in plain.items() if t not in char_bytes} == set(merged)
        if not in_order or model.get("dropout") or model.get("ignore_merges"):
            return None
        import tiktoken

        ranks = {_bytes_of(t, char_bytes): i for t, i in plain.items()}
        twin = tiktoken.Encoding("twin", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        same = twin.encode_ordinary(PROBE) == self.tokenizer.encode(PROBE, add_special_tokens=False).ids
        return twin if same else None

    def plain(self, text: str) -> bool:
        """Whether the twin may take a text: by its characters, whatever its length."""
        try:
            odd = text.encode("latin-1").translate(None, PLAIN_BYTES)
        except UnicodeEncodeError:
            odd = NOT_PLAIN.search(text)
        return not odd and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Copies, which the curve brings together, are encoded once."""
        texts, copies = list(dict.fromkeys(texts)), texts
        out: list[bytes | None] = [self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4", copy=False).tobytes() if self.fast is not None and self.plain(t) else None for t in texts]
        rest = [i for i, c in enumerate(out) if c is None]
        for i, code in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(code.ids, "<u4").tobytes()
        known = dict(zip(texts, out, strict=True))
        return [known[t] for t in copies]


#: A Python worker's encoders outlive its tasks.
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(total: int, at: int, width: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids that begins at offset ``at`` of an open sequence."""
    start = 0
    while start < total:
        n = min(width - at, total - start)
        yield start, n
        start, at = start + n, (at + n) % width


def packer(path: str, width: int, end: int):
    """Packs a partition: full sequences are written as they fill up, the open one at the end as powers of two."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stop = encoder_of(path), np.array([end], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        kind = None
        open_: list[tuple] = []  # id, start, ids, total
        filled = 0
        for batch in batches(rows, 256):
            kind = batch.schema.field("id").type
            done: list[tuple] = []
            ids = batch.column("id").to_pylist()
            for doc, code in zip(ids, encoder.encode(batch.column("text").to_pylist()), strict=True):
                code += stop
                total = len(code) // 4
                for start, n in pieces(total, filled, width):
                    open_.append((doc, start, code[4 * start : 4 * (start + n)], total))
                    filled += n
                    if filled == width:
                        done += _laid(open_, sequence)
                        open_, filled, sequence = [], 0, sequence + 1
            if done:
                yield _out(done, kind)
        rest: list[tuple] = []
        while filled:
            size = 1 << (filled.bit_length() - 1)
            head, open_ = _take(open_, size)
            rest += _laid(head, sequence)
            filled, sequence = filled - size, sequence + 1
        if rest:
            yield _out(rest, kind)

    return run


def _take(parts: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
    """The first ``size`` ids of ``parts`` and the others; a part on the border is cut."""
    head, n = [], 0
    for k, (doc, start, code, total) in enumerate(parts):
        m = len(code) // 4
        if n + m > size:
            cut = size - n
            head += [(doc, start, code[: 4 * cut], total)] if cut else []
            return head, [(doc, start + cut, code[4 * cut :], total), *parts[k + 1 :]]
        head.append(parts[k])
        n += m
    return head, []


def _laid(parts: list[tuple], sequence: int) -> list[tuple]:
    out, at = [], 0
    for doc, start, code, total in parts:
        out.append((doc, start, len(code) // 4, zlib.crc32(code), total, sequence, at))
        at += len(code) // 4
    return out


def _out(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], NAMES)


NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer: str, width: int = 1024, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every document is its ids and ``end``. Null and empty texts are one ``end`` each; very long texts are
    cut over as many sequences as they need. Repeated rows and equal texts are packed each by itself, in an
    order that a hash of the row decides. An empty table gives no rows. ``tokenizer`` is a path that every executor has. Sequence
    ids are unique, not gapless. Other columns of ``docs`` are not read.
    """
    if width & (width - 1):
        raise ValueError("the width of a sequence must be a power of two")
    kind = docs.schema[doc_id].dataType.simpleString()
    ordered = in_ranges(docs.select(docs[doc_id].alias("id"), text_or_empty(docs[text]).alias("text")))
    return ordered.mapInArrow(packer(tokenizer, width, end), f"id {kind}, " + ", ".join(f"{c} long" for c in NAMES[1:]))
