"""Structured Streaming forms: bars with a watermark, bounded deduplication, latest rows, rate limits, state per key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def read(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files at `path`, in the schema they have now."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder)


def bars(events: DataFrame, width: str = "1 hour", delay: str = "0 seconds", key: str = "event_type", ts: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """Tumbling bars; one is emitted when the watermark has passed its end, so the newest stays back."""
    order = F.struct(ts, tie)
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    out = timed.groupBy(F.window(ts, width), key).agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").alias("ticks"))
    return out.select(key, F.col("window.start").alias("start"), "open", "high", "low", "close", "ticks")


def deduplicated(events: DataFrame, ident: str, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first row of each id, remembered for the watermark's delay."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([ident])


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key, kept up to date (complete or update mode)."""
    names = [c for c in events.columns if c != key]
    newest = F.max(F.struct(*order, F.struct(*names).alias("row"))).alias("s")
    return events.groupBy(key).agg(newest).select(key, "s.row.*")


def over_limit(events: DataFrame, key: str, ts: str = "ts", most: int = 120, width: str = "60 seconds", delay: str = "1 minute") -> DataFrame:
    """Windows in which a key has more than `most` events."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.groupBy(F.window(ts, width, "1 second"), key).count().where(f"count > {most}")


def running_average(events: DataFrame, key: str = "user_id", n: int = 20, ts: str = "ts", value: str = "value") -> DataFrame:
    """Exponential average of each key over its events in order of time within a batch; state outlives batches."""
    rate = 2 / (n + 1)

    def step(k, batches, state):
        x, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values([ts, "event_id"])
        for v in rows[value]:
            x, count = (v if x is None else x + rate * (v - x)), count + 1
        state.update((float(x), count))
        yield pd.DataFrame({key: [k[0]], "ema": [float(x)], "n": [count]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, ema double, n long", "ema double, n long", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and ends: Parquet at `path`/data, progress at `path`/progress."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def drain_batches(stream: DataFrame, path: str, mode: str, key: list[str]) -> None:
    """The same for update and complete modes: each batch is a folder of its own, so a batch that runs again writes the same."""

    def put(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
