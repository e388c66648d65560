"""Streams: a compiled program is row-local, so the same projection maps a stream; drift is watched batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from marlspike.operators.drift import DriftReport, classify_drift
from marlspike.operators.profile import Profile, profile
from marlspike.plans.compile import ERROR, CompiledProgram


def map_stream(stream: DataFrame, program: CompiledProgram, keep: list[str] = ()) -> DataFrame:
    """The mapped stream with _error beside the target; stateless, so no watermark is needed."""
    return program.transform(stream, keep=keep)


def write_all(mapped: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """All available records to one Parquet folder, the target with its _error, then stop. Rows go from the executors to files, none to the driver."""
    return mapped.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_split(mapped: DataFrame, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Good records to one Parquet folder, quarantined ones to another, all available data, then stop.

    Each micro-batch is written in a folder of its number, so that a batch that is run again replaces its files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where(f"{ERROR} IS NULL").drop(ERROR).write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.where(f"{ERROR} IS NOT NULL").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.unpersist()

    return mapped.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_drift(stream: DataFrame, baseline: Profile, on_report: Callable[[int, DriftReport], None], checkpoint: str) -> StreamingQuery:
    """Profile each micro-batch and report its drift from the baseline."""

    def compare(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            on_report(number, classify_drift(baseline.signatures(), profile(batch).signatures()))

    return stream.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
