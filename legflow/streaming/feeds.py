"""Streams through the batch operators: change feeds into a delete-file table, windowed counts, sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from legflow.operators.changes import DeltaTable


def into_table(stream: DataFrame, table: DeltaTable, seq: str | Column, gone: Column) -> DataStreamWriter:
    """A writer that appends each micro-batch of changes to the table.

    A batch that is run again after a failure appends its changes again, which no reader sees: order and repeats are settled
    by the sequence numbers, so the stream needs neither watermark nor state, however late a change comes.
    """

    def append(batch: DataFrame, _: int) -> None:
        table.append(batch, seq, gone)

    return stream.writeStream.foreachBatch(append)


def first_seen(stream: DataFrame, key: Sequence[str], time: str, late: str) -> DataFrame:
    """Messages once each: repeats within the lateness are dropped, state older than that is let go."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def counts(stream: DataFrame, time: str, every: str, late: str, by: Sequence[str] = ()) -> DataFrame:
    """Events per tumbling window and group, with what comes up to `late` after the newest event."""
    w = F.window(F.col(time), every)
    g = stream.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(stream: DataFrame, time: str, gap: str, late: str, by: Sequence[str]) -> DataFrame:
    """Events per group in sessions: a pause of `gap` ends one."""
    w = F.session_window(F.col(time), gap)
    g = stream.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
