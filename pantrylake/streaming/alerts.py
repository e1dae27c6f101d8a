"""Windows over events, for batch and for streams, and sinks that may be run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pantrylake.functions.fixed import CRITICAL_CODES


def failure_windows(
    events: DataFrame, at: str = "ts", length: str = "60 minutes", slide: str = "15 minutes", at_least: int = 5, late: str = "1 hour", code: str | None = None, codes: list[str] = CRITICAL_CODES
) -> DataFrame:
    """Windows with at least so many events, with a column `code` only of those whose code is critical; a stream also gets a watermark."""
    if code is not None:
        events = events.filter(F.col(code).isin(codes))
    if events.isStreaming:
        events = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    n = events.groupBy(F.window(at, length, slide)).agg(F.count("*").alias("n"))
    return n.filter(F.col("n") >= at_least).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events without repeats of a key that come within the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def running_summary(reviews: DataFrame, key: str, value: str) -> DataFrame:
    """Count and mean so far; streams write it in update mode."""
    return reviews.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def interval_join(a: DataFrame, b: DataFrame, key: str, at_a: str, at_b: str, reach: str, late: str = "1 hour") -> DataFrame:
    """Pairs of a key with b at most reach after a; state is bounded by the watermarks."""
    if a.isStreaming:
        a, b = a.withWatermark(at_a, late), b.withWatermark(at_b, late)
    b = b.withColumnRenamed(key, "_key")
    return a.join(b, (F.col(key) == F.col("_key")) & (F.col(at_b) >= F.col(at_a)) & (F.col(at_b) <= F.col(at_a) + F.expr(f"INTERVAL {reach}"))).drop("_key")


def write_idempotent(df: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Runs what is there through foreachBatch; each batch overwrites its own partition, so a repeat changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def notify(windows: DataFrame, post: Callable[[str], None]) -> int:
    """Passes every alert, the latest first, to an injected callback; a failing callback doesn't fail the job."""
    sent = 0
    for r in windows.orderBy(F.desc("start")).toLocalIterator():
        try:
            post(f"{r['n']} critical failures since {r['start']}")
            sent += 1
        except Exception:  # noqa: BLE001 - alerting is best effort
            continue
    return sent
