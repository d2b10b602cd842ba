"""Streams: windows over usage, and re-screening as list versions arrive."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout


def alert_rates(events: DataFrame, ts: str = "ts", late: str = "2 days", width: str = "1 day") -> DataFrame:
    """(day, event_type, n, total) of a stream or a table; a stream drops rows later than the watermark."""
    rows = events.withColumn("at", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("at", late)
    out = rows.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("day"), "event_type", "n", "total")


def rescreen_arrivals(
    spark: SparkSession, arrivals: str, schema, checkpoint: str, screen: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Hands each batch of newly arrived list rows to ``screen(rows, batch)`` once, and ends when all are read.

    Batches are numbered, so that a sink which writes by batch number stays exact if one is repeated.
    """
    stream = spark.readStream.schema(schema).parquet(arrivals)
    return stream.writeStream.foreachBatch(screen).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def suppress_repeats(alerts: DataFrame, keys: list[str], at: str, content: str, days: int = 90, late: str = "1 day") -> DataFrame:
    """A stream of alerts (keys, at, content) with ``suppressed``, across batches.

    An alert opens, and keeps like ones of the same keys and content closed for ``days`` from then; another content,
    as of a changed record, opens again at once and takes its place.  Rows of one batch count in order of time; of a
    key its last opening is all the state, which a timer drops when the watermark has passed its end.  A null time
    or content is an error of the source, and opens without being remembered.
    """
    kept, width = [*keys, at, content], pd.Timedelta(days=days)
    rows = alerts.select(*kept).withWatermark(at, late)
    schema = T.StructType([rows.schema[c] for c in kept]).add("suppressed", "boolean")

    def run(key, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values([at, content], kind="stable")  # one key's rows of one batch
        said, until = (state.get if state.exists else (None, None))
        flags = []
        for time, text in zip(rows[at], rows[content]):
            if pd.isna(time) or text is None:
                flags.append(False)
                continue
            now = time.value // 1000
            closed = said == text and now <= until
            flags.append(closed)
            if not closed:
                said, until = text, now + width.value // 1000
        if said is not None:
            state.update((said, until))
            state.setTimeoutTimestamp(max(until // 1000, state.getCurrentWatermarkMs()) + 1)
        yield rows.assign(suppressed=flags)

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "content string, until long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what has arrived into a table, and ends; run again, it goes on where it was."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
