"""Watching a stream of events: quiet windows, and arcs that appear or vanish."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.arcs import ARC, live_delta
from ..session import scratch_path


def debounce(events: DataFrame, gap: str, time: str = "ts", key: str = "user_id", late: str | None = None) -> DataFrame:
    """Bursts of each key that ``gap`` of quiet ends: first and last event and their number. The same for batches and, with ``late``, for streams."""
    # streams need an instant to order events by
    df = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else events
    burst = df.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n_events"))
    return burst.select(key, F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "n_events")


def event_arcs(events: DataFrame) -> DataFrame:
    """Arcs from users to types of events."""
    return events.select(F.concat(F.lit("user:"), "user_id").alias("producer"), F.concat(F.lit("type:"), "event_type").alias("consumer"), F.lit("emits").alias("relation")).distinct()


class ArcWatch:
    """Per micro-batch: the arcs of the batch replace the snapshot, and their difference goes to ``sink``.

    Snapshots are versions in the shared folder, so a batch that is repeated
    after a failure sees the snapshot before it and gives the same difference.
    """

    def __init__(self, spark: SparkSession, sink: Callable[[DataFrame, int], None], path: str | None = None):
        self.spark, self.sink, self.path = spark, sink, path or scratch_path(spark, "arc-watch")

    def on_batch(self, batch: DataFrame, number: int) -> None:
        now = event_arcs(batch)
        now.write.mode("overwrite").parquet(f"{self.path}/{number}")
        now = self.spark.read.parquet(f"{self.path}/{number}")
        before = self.spark.read.parquet(f"{self.path}/{number - 1}") if number else now.limit(0)
        self.sink(live_delta(before.select(*ARC), now.select(*ARC)), number)

    def start(self, events: DataFrame, once: bool = False) -> StreamingQuery:
        """Errors of a batch end the query; the next start takes up where it ended."""
        w = events.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", f"{self.path}/progress")
        return (w.trigger(availableNow=True) if once else w.trigger(processingTime="200 milliseconds")).start()
