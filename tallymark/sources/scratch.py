"""Tables in the shared folder that the cluster names: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession


#: Folders of our own, by application.
_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own, removed at the end, only where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="tallymark-")
        atexit.register(shutil.rmtree, _OWN[sc.applicationId], ignore_errors=True)
    return f"file://{_OWN[sc.applicationId]}"


def _folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/tallymark/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the application's folder."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}/{label}"


class Phase:
    """Tables made in a block, by thread: all are deleted at its end but those that are kept, which belong to the block around it.

    ``with Phase(spark) as phase: ...; return phase.keep(save(df, "result"))``. What is kept must be all that later plans read.
    """

    _open: ClassVar[threading.local] = threading.local()

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    @classmethod
    def stack(cls) -> list[Phase]:
        if not hasattr(cls._open, "phases"):
            cls._open.phases = []
        return cls._open.phases

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, a table that ``save`` gave."""
        self.kept.add(df._scratch_path)
        return df

    def __enter__(self) -> Phase:
        self.stack().append(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.stack().pop()
        for path in self.paths:
            if path not in self.kept:
                _delete(self.spark, path)
            elif self.stack():
                self.stack()[-1].paths.append(path)


def save(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` and read it back: lineage is cut, statistics are known, a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if Phase.stack():
        Phase.stack()[-1].paths.append(path)
    return out


def write_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """A small file at any path that Spark writes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete the application's tables; results that still read them must have been written before."""
    _delete(spark, _folder(spark))
