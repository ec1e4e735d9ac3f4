"""Reconciliation as files arrive: every micro-batch of target rows is checked against the source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.mapping import Field
from ..operators.reconcile import Reconciliation


def watch(source: DataFrame, arriving: DataFrame, keys: Sequence[str], output: str, checkpoint: str, fields: list[Field] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Writes the extra and changed records of each batch of a streaming target as Parquet, a folder a batch.

    Records that are only missing so far are no mismatch until the stream ends, so a batch is joined from its own side: source
    records that it does not ask for are dropped in the join. A batch that is run again after a failure overwrites its own folder, so every batch counts once.
    """

    def check(batch: DataFrame, number: int) -> None:
        found = Reconciliation(source, batch, keys, fields or [], how="right_outer").mismatches()
        found.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return arriving.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
