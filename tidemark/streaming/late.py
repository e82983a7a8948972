"""Bars of a stream in which nothing that comes too late is lost.

A bar is final once the watermark (the latest time of the batches before, less a delay) has passed its end. Rows of final
bars are kept beside them, counted, and mark their bar for a rebuild from the source. All that a batch leaves lies in folders
of its number, so a batch that runs again leaves the same: rows are neither lost nor doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders below the path: final bars, partial ones that are still open, late rows, bars to rebuild, and a row a batch.
BARS, OPEN, LATE, REBUILD, MARKS = "bars", "open", "late", "rebuild", "marks"


def _partial(rows: DataFrame) -> DataFrame:
    """(symbol, start_ms, first, last, high, low, ticks): bars that merge."""
    at = F.struct("ts_ms", "event_id", "mid")
    return rows.groupBy("symbol", "start_ms").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.count("*").alias("ticks"))


def _merged(partial: DataFrame) -> DataFrame:
    return partial.groupBy("symbol", "start_ms").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("ticks").alias("ticks"))


def _bars(partial: DataFrame) -> DataFrame:
    return partial.select("symbol", "start_ms", F.col("first.mid").alias("open"), "high", "low", F.col("last.mid").alias("close"), "ticks")


def _at(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumn("start_ms", F.col("ts_ms") - F.pmod("ts_ms", F.lit(width)))


def keep(ticks: DataFrame, path: str, width: int, delay: int) -> None:
    """Runs a stream of ticks (symbol, ts_ms, event_id, mid) over all that is there; what it leaves is described above.

    Ticks of one time are ordered by event_id. A null time belongs to no bar and counts as late.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(f"{path}/{MARKS}/batch={number - 1}").first() if number else None
        mark = known.newest - delay if known and known.newest is not None else None
        rows = _at(batch, width).withColumn("__late", F.col("ts_ms").isNull() | (F.lit(False) if mark is None else F.col("start_ms") + width <= mark)).persist()
        try:
            write = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
            late = rows.where("__late").drop("__late")
            write(late, LATE)
            write(late.where("ts_ms IS NOT NULL").groupBy("symbol", "start_ms").agg(F.count("*").alias("late"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms")), REBUILD)
            seen = rows.agg(F.max("ts_ms").alias("newest"), F.count("*").alias("rows"), F.count_if("__late").alias("late")).first()
            newest = max((x for x in (seen.newest, known and known.newest) if x is not None), default=None)
            partial = _partial(rows.where("NOT __late"))
            if number:
                partial = _merged(partial.unionByName(spark.read.parquet(f"{path}/{OPEN}/batch={number - 1}")))
            final = F.lit(False) if newest is None else F.col("start_ms") + width <= newest - delay
            write(_bars(partial.where(final)), BARS)
            write(partial.where(~final), OPEN)
            write(spark.createDataFrame([(newest, seen.rows, seen.late)], "newest long, rows long, late long"), MARKS)
        finally:
            rows.unpersist()

    ticks.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()


def rebuilt(spark: SparkSession, path: str, ticks: DataFrame, width: int) -> DataFrame:
    """Final bars of `path` in which those that late rows belong to are made anew from `ticks`, a table of all rows.

    A late row of a span that had no bar makes one.
    """
    marked = spark.read.parquet(f"{path}/{REBUILD}").select("symbol", "start_ms").distinct()
    kept = spark.read.parquet(f"{path}/{BARS}").drop("batch").join(marked, ["symbol", "start_ms"], "left_anti")
    anew = _at(ticks, width).join(marked, ["symbol", "start_ms"], "left_semi")
    return kept.unionByName(_bars(_partial(anew)))
