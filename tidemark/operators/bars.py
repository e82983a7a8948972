"""Quotes to bars: validation, deduplication, tumbling bars of several widths, roll-ups, gaps and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import ratio
from tidemark.functions.timebase import DAY, HOUR, MINUTE, bucket

TICK_KEY = ["symbol", "ts_ms", "bid", "ask"]
#: Spreads in sums: exact to eight places.
SPREAD = "decimal(27,8)"


def average_spread(total: Column, n: Column) -> Column:
    """The one division of an exact sum; null without a spread."""
    return F.when(n > 0, total.cast("double") / n)


def distinct_ticks(ticks: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Ticks of overlapping files once; a null differs from 0."""
    return ticks.dropDuplicates(key or ticks.columns)


def build_bars(ticks: DataFrame, widths: list[int], tie: str = "event_id", close_last: bool = False) -> DataFrame:
    """Bars on the mid of `ticks` (symbol, ts_ms, mid, spread, tie) for each width in ms.

    A bar is given once a later bar of its symbol and width has begun, unless `close_last`. Empty bars are not
    made. Ticks of one millisecond are ordered by `tie`. Aggregation is partial before its one shuffle. Spreads are
    added as SPREAD decimals (`spread_sum`), so no average depends on how rows are dealt; a tick without a spread counts for none.
    """
    spread = ticks.withColumn("width", F.explode(F.array(*map(F.lit, widths)))) if len(widths) > 1 else ticks.withColumn("width", F.lit(widths[0]))
    order = F.struct("ts_ms", tie)
    bars = (
        spread.groupBy("symbol", "width", (F.col("ts_ms") - F.pmod("ts_ms", "width")).alias("start_ms"))
        .agg(
            F.min_by("mid", order).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", order).alias("close"), F.count("*").alias("ticks"),
            F.sum(F.col("spread").cast(SPREAD)).alias("spread_sum"), F.count("spread").alias("spreads"), F.min("spread").alias("min_spread"), F.max("spread").alias("max_spread"), F.max_by("spread", order).alias("close_spread"),
        )
        .withColumn("avg_spread", average_spread(F.col("spread_sum"), F.col("spreads")))
    )
    if not close_last:
        newest = F.max("start_ms").over(Window.partitionBy("symbol", "width"))
        bars = bars.withColumn("newest", newest).where("start_ms < newest").drop("newest")
    return bars.withColumn("close_ms", F.col("start_ms") + F.col("width"))


def roll_up(bars: DataFrame, width: int, boundary: int = 0) -> DataFrame:
    """Coarser bars out of finer ones of one width: tick-weighted spread, coverage, completeness and provenance."""
    out = bars.groupBy("symbol", bucket(F.col("start_ms"), width, boundary).alias("begin_ms")).agg(
        F.min_by("open", "start_ms").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "start_ms").alias("close"), F.sum("ticks").alias("ticks"),
        average_spread(F.sum("spread_sum"), F.sum("spreads")).alias("avg_spread"), F.count("*").alias("observed"), F.min("width").alias("fine"),
        F.max("close_ms").alias("available_ms"), F.array_sort(F.collect_list("start_ms")).alias("sources"),
    )
    expected = (F.lit(width) / F.col("fine")).cast("long")
    return out.withColumns(
        {"expected": expected, "coverage": F.col("observed") / expected, "complete": F.col("observed") == expected, "available_ms": F.greatest("available_ms", F.col("begin_ms") + width)}
    ).drop("fine")


def gap_table(ticks: DataFrame, key: str = "symbol") -> DataFrame:
    """Time to the tick before, by key."""
    gap = F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy(key).orderBy("ts_ms", "event_id"))
    return ticks.select(key, "ts_ms", "event_id", gap.alias("gap_ms")).where("gap_ms IS NOT NULL")


def gap_kind(gap: Column) -> Column:
    return F.when(gap > DAY, "OVER_DAY").when(gap > HOUR, "OVER_HOUR").when(gap > MINUTE, "OVER_MINUTE").otherwise("SHORT")


def compare(left: DataFrame, right: DataFrame, fields: list[str], tolerance: float = 1e-9) -> DataFrame:
    """One row: bars on either side alone, and per field how many differ and by how much at most."""
    both = left.alias("l").join(right.alias("r"), ["symbol", "start_ms"], "full_outer")
    alone = [F.count_if(F.col("r.open").isNull()).alias("only_left"), F.count_if(F.col("l.open").isNull()).alias("only_right")]
    per = []
    for f in fields:
        gap = F.abs(F.col(f"l.{f}") - F.col(f"r.{f}"))
        per += [F.count_if(gap > tolerance).alias(f"{f}_differs"), F.max(gap).alias(f"{f}_most")]
    return both.agg(*alone, *per)


def range_overlaps(spans: DataFrame) -> DataFrame:
    """Spans (source, begin_ms, end_ms) that begin before an earlier one has ended; a table of files, so one window is enough."""
    before = F.max("end_ms").over(Window.orderBy("begin_ms", "source").rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("overlaps", F.coalesce(before >= F.col("begin_ms"), F.lit(False)))


def position(close: Column, high: Column, low: Column) -> Column:
    return ratio(close - low, high - low)
