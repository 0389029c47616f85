"""Incremental refresh: streams are triggers, and what a refresh gives equals a rebuild from scratch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.session import Session


def on_batches(stream: DataFrame, refresh: Callable[[DataFrame], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Run ``refresh`` for each micro-batch; without an interval, for what is there, and then end.

    An error ends the query; started again with the same checkpoint, it repeats the batch that failed.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: refresh(batch))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def upsert(state: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The state's rows with those of the batch in place of equal keys; of a batch's equal keys the largest row counts."""
    rest = [c for c in batch.columns if c != key]
    latest = batch.groupBy(key).agg(F.max(F.struct(*rest)).alias("_row")).select(key, "_row.*")
    return state.join(latest.select(key), key, "left_anti").select(*batch.columns).unionByName(latest.select(*batch.columns))


def watch(session: Session, checkpoint: str, interval: str = "300 milliseconds", failed: Callable[[Exception], None] | None = None) -> StreamingQuery:
    """Refresh again and again until the query is stopped.

    A rate stream is the trigger; the scan finds edits and deletions, which file streams don't report. An error is
    handed to ``failed`` and the loop goes on: a file may vanish while it is read.
    """

    def refresh(_: DataFrame) -> None:
        try:
            session.refresh()
        except Exception as e:  # noqa: BLE001
            if failed:
                failed(e)

    ticks = session.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return on_batches(ticks, refresh, checkpoint, interval)


def trigger(spark: SparkSession, directory: str) -> DataFrame:
    """A stream with a row for each new file below a directory, by name only."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(directory).select("path", "modificationTime", "length")
