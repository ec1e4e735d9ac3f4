"""Keys, fingerprints and partition numbers of records."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import canon


def key_parts(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Canonical parts of a key: null tokens have one name, so null keys meet."""
    return [canon.text(df[k]) for k in keys]


def uid(parts: Iterable[Column]) -> Column:
    """How a key is written; joins use the parts, so a pipe inside a part cannot make two keys one."""
    return F.concat_ws("|", *parts)


def fingerprint(values: Iterable[Column], algorithm: str = "xxhash64") -> Column:
    """Hash of canonical values, separated so that their borders count."""
    line = F.concat_ws(canon.UNIT, *values)
    if algorithm == "xxhash64":
        return F.xxhash64(line)
    if algorithm == "sha256":
        return F.sha2(line.cast("binary"), 256)
    if algorithm == "md5":
        return md5_long(line)
    if algorithm == "crc64":  # the first eight bytes of sha256, under the name that requests use
        return F.conv(F.substring(F.sha2(line.cast("binary"), 256), 1, 16), 16, -10).cast("long")
    if algorithm == "xxhash128":
        return _xxhash128(line)
    raise ValueError(f"unknown fingerprint: {algorithm}")


def _xxhash128(line: Column) -> Column:
    """The first eight bytes of XXH3's 128 bits; there is no built-in function, so batches go to Python."""

    @F.pandas_udf("long")
    def run(lines: pd.Series) -> pd.Series:
        import xxhash

        return lines.map(lambda x: int.from_bytes(xxhash.xxh3_128_digest(x)[:8], "big", signed=True))

    return run(line)


def md5_long(line: Column) -> Column:
    """The first 15 hexadecimal digits of md5, as a number that other engines can compute too."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long")


def partition_id(key: Column, partitions: int, algorithm: str = "xxhash64") -> Column:
    h = F.xxhash64(key) if algorithm == "xxhash64" else md5_long(key)
    return F.pmod(h, F.lit(partitions)).cast("int")


def row_identity(df: DataFrame, columns: Iterable[str]) -> Column:
    """Identity of a record without a key: a hash of all its named canonical cells."""
    cells = [F.concat(F.lit(f"{c}="), canon.text(df[c])) for c in sorted(columns)]
    return F.sha2(F.concat_ws(canon.UNIT, *cells).cast("binary"), 256)
