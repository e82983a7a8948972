"""Joins on time: as-of in both directions, intervals, first touch of a barrier, extremes of a range.

All of them put time into buckets and join on (key, bucket), so a key with many rows is dealt over its buckets and no
pair of rows is looked at that is not near in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timebase import HOUR
from tidemark.operators import barriers


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], strict: bool = False, width: int = 24 * HOUR) -> DataFrame:
    """`left` with `values` of the last row of `right` at or before (strict: before) it; null if there is none.

    Two steps, so that no window holds a whole key: within a bucket of `width` the last row on the right comes
    from a running window; what a bucket begins with is carried over from the last bucket before that has a row.
    Of rows at one time on the right, the one with the greatest values counts.
    """
    kept = F.struct(F.col(right_ts).alias("__t"), *(F.col(v).alias(v) for v in values))
    l = left.select("*", F.col(left_ts).alias("__at"), F.lit(1 if not strict else 0).alias("__side"), F.lit(None).cast(right.select(kept.alias("x")).schema["x"].dataType).alias("__right"))
    r = right.select(F.col(key), F.col(right_ts).alias("__at"), F.lit(0 if not strict else 1).alias("__side"), kept.alias("__right"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("__bucket", F.floor(F.col("__at") / width))
    order = Window.partitionBy(key, "__bucket").orderBy("__at", "__side", "__right").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__found", F.last("__right", ignorenulls=True).over(order)).where(F.col("__right").isNull())
    ends = r.groupBy(key, F.floor(F.col("__at") / width).alias("__bucket")).agg(F.max("__right").alias("__end"))
    # Per key and bucket the last row of the buckets before: a table of one row a bucket.
    buckets = both.select(key, "__bucket").distinct().join(ends, [key, "__bucket"], "left")
    carried = F.last("__end", ignorenulls=True).over(Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    entry = buckets.select(key, "__bucket", carried.alias("__carried"))
    out = seen.join(entry, [key, "__bucket"], "left").withColumn("__got", F.coalesce("__found", "__carried"))
    return out.select(*left.columns, F.col("__got.__t").alias(f"asof_{right_ts}"), *(F.col(f"__got.{v}").alias(f"asof_{v}") for v in values))


def asof_forward(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], width: int = 24 * HOUR) -> DataFrame:
    """`left` with the first row of `right` at or after it: the backward join on negated times.

    Of rows at one time the one with the greatest values counts.
    """
    l = left.withColumn("__neg", -F.col(left_ts))
    r = right.withColumn("__negr", -F.col(right_ts))
    out = asof_backward(l, r.select(key, "__negr", *values), key, "__neg", "__negr", values, width=width)
    return out.withColumn(f"asof_{right_ts}", -F.col("asof___negr")).drop("__neg", "asof___negr")


def interval_join(left: DataFrame, right: DataFrame, key: str, begin: str, end: str, ts: str, width: int, how: str = "left", closed: str = "right") -> DataFrame:
    """Pairs with `begin` < ts <= `end` (closed="right") or `begin` <= ts < `end` (closed="left").

    Left rows are copied to each bucket of `width` that their interval meets; take a width near the usual length.
    """
    first, last = F.floor(F.col(begin) / width), F.floor(F.col(end) / width)
    l = left.withColumn("__bucket", F.explode(F.sequence(first, F.greatest(first, last))))
    r = right.withColumn("__bucket", F.floor(F.col(ts) / width)).withColumnRenamed(key, "__key")
    inside = (F.col(ts) > F.col(begin)) & (F.col(ts) <= F.col(end)) if closed == "right" else (F.col(ts) >= F.col(begin)) & (F.col(ts) < F.col(end))
    return l.join(r, (l[key] == r["__key"]) & (l["__bucket"] == r["__bucket"]) & inside, how).drop(r["__bucket"]).drop("__key", "__bucket")


def outcomes(anchors: DataFrame, ticks: DataFrame, horizons: dict[str, int], key: str = "symbol", at: str = "anchor_ms", price: str = "entry", ident: str = "anchor_id") -> DataFrame:
    """One row per anchor and horizon: last, best and worst move of `ticks` (key, ts_ms, mid, spread) in (anchor, anchor + horizon].

    Anchors without a tick in it have null outcomes. Ticks become blocks as long as the shortest horizon, each from after a multiple of it up to
    the next; a span is made of its blocks and of the ticks of those at its ends that it takes in part, so no anchor is paired with all its ticks.
    """
    base = min(horizons.values())
    names = F.array(*(F.struct(F.lit(n).alias("horizon"), F.lit(h).alias("span")) for n, h in horizons.items()))
    spans = anchors.select(F.col(ident), F.col(key), F.col(at), F.col(price), F.explode(names).alias("h"))
    spans = spans.select(ident, key, at, price, "h.horizon", (F.col(at) + F.col("h.span")).alias("__until"))
    low, high = F.ceil(F.col(at) / base), F.floor(F.col("__until") / base)
    inside = F.transform(F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>")), lambda b: F.struct(b.alias("block"), F.lit(True).alias("whole")))
    part = lambda end: F.when(F.pmod(end, F.lit(base)) != 0, F.floor(end / base))
    ends = F.transform(F.array_distinct(F.array_compact(F.array(part(F.col(at)), part(F.col("__until"))))), lambda b: F.struct(b.alias("block"), F.lit(False).alias("whole")))
    asked = spans.withColumn("c", F.explode_outer(F.concat(inside, ends))).select(*spans.columns, F.col("c.block").alias("__block"), F.col("c.whole").alias("__whole"))

    rows = ticks.where("ts_ms IS NOT NULL").select(F.col(key).alias("__key"), F.floor((F.col("ts_ms") - 1) / base).alias("__block"), "ts_ms", "event_id", "mid", "spread")
    whole = rows.groupBy("__key", "__block").agg(
        F.lit(True).alias("__whole"), F.max("ts_ms").alias("__ts"), F.max(F.struct("ts_ms", "event_id", "mid")).alias("__last"), F.max("mid").alias("__high"), F.min("mid").alias("__low"), F.max("spread").alias("__spread"), F.count("*").alias("__n"),
    )
    single = rows.select("__key", "__block", F.lit(False).alias("__whole"), F.col("ts_ms").alias("__ts"), F.struct("ts_ms", "event_id", "mid").alias("__last"), F.col("mid").alias("__high"), F.col("mid").alias("__low"), F.col("spread").alias("__spread"), F.lit(1).cast("long").alias("__n"))
    met = asked.join(
        whole.unionByName(single).withColumnsRenamed({"__block": "__of", "__whole": "__all"}),
        (F.col(key) == F.col("__key")) & (F.col("__block") == F.col("__of")) & (F.col("__whole") == F.col("__all")) & (F.col("__whole") | ((F.col("__ts") > F.col(at)) & (F.col("__ts") <= F.col("__until")))), "left",
    )
    return met.groupBy(ident, key, at, price, "horizon").agg(
        (F.max("__last").getField("mid") - F.first(price)).alias("ret"), (F.max("__high") - F.first(price)).alias("mfe"), (F.min("__low") - F.first(price)).alias("mae"),
        F.max("__spread").alias("max_spread"), F.coalesce(F.sum("__n"), F.lit(0)).alias("n_ticks"),
    )


def first_touch(anchors: DataFrame, ticks: DataFrame, conditions: dict[str, Column], horizon: int, key: str = "symbol", at: str = "anchor_ms", ident: str = "anchor_id") -> DataFrame:
    """Per anchor the first time each condition (on columns of both) holds in (anchor, anchor + horizon]; null if never.

    Any condition will do, so all ticks of the span are paired with the anchor; levels are found without pairs by `barriers.first_crossings`.
    """
    spans = anchors.withColumn("__until", F.col(at) + horizon)
    joined = interval_join(spans, ticks, key, at, "__until", "ts_ms", horizon)
    return joined.groupBy(ident).agg(*(F.min(F.when(c, F.col("ts_ms"))).alias(n) for n, c in conditions.items()))


def range_extremes(spans: DataFrame, bars: DataFrame, ident: str, key: str, begin: str, end: str, base: int = HOUR, levels: int = 2) -> DataFrame:
    """Highest high and lowest low of bars that start in [begin, end), from blocks of bars (operators/barriers.py); null where there are none."""
    asked = spans.select(F.col(ident).alias("request"), key, F.col(begin).alias("from_ms"), (F.col(end) - 1).alias("until_ms"))
    found = barriers.extremes(asked, bars.select(key, "start_ms", "high", "low"), ["high", "low"], key, "start_ms", base, levels=levels)
    out = spans.select(F.col(ident)).join(found.withColumnRenamed("request", "__request"), F.col(ident).eqNullSafe(F.col("__request")), "left")
    return out.select(ident, F.col("high_high").alias("highest"), F.col("low_low").alias("lowest"), F.coalesce("rows", F.lit(0)).alias("n_bars"))
