"""Summaries: splits in time, frozen cuts, returns, grouping sets with ALL, deltas and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIODS = ("TRAIN", "VALIDATION", "OOS")


def split_by_time(df: DataFrame, ts: str, shares: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """TRAIN, VALIDATION and OOS by the times at rows floor(n * share) in order; rows of one time stay together.

    The cutoffs come from counts per time, in two steps, so that no window holds all rows.
    """
    n = df.count()
    cutoffs = [cutoff(df, ts, int(n * s)) for s in shares]
    t = F.col(ts)
    if cutoffs[0] is None:
        return df.withColumn("period", F.lit("TRAIN"))
    return df.withColumn("period", F.when(t < F.lit(cutoffs[0]), PERIODS[0]).when(t < F.lit(cutoffs[1]), PERIODS[1]).otherwise(PERIODS[2]))


def cutoff(df: DataFrame, ts: str, rank: int):
    """The value of `ts` (a long) at place `rank` (from 0) in order: by counting in ever finer ranges."""
    low, high = df.agg(F.min(ts), F.max(ts)).first()
    if low is None:
        return None
    below = 0
    while low < high:
        step = max(1, -(-(high - low + 1) // 1000))
        rows = df.where((F.col(ts) >= low) & (F.col(ts) <= high)).groupBy(((F.col(ts) - F.lit(low)) / step).cast("long").alias("b")).count().orderBy("b").collect()
        for r in rows:  # 1000 ranges at most
            if below + r["count"] > rank:
                low, high = low + r.b * step, min(high, low + (r.b + 1) * step - 1)
                break
            below += r["count"]
        else:
            return high
    return low


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], ranges: int = 256) -> DataFrame:
    """One row a group of `by`: `known`, how many values are not null, and `cuts`, the exact quantiles at `shares`, interpolated linearly.

    No task holds a group: a sketch cuts each group's values into ranges, rows are counted by range, and only the ranges in
    which a wanted rank lies are counted by value. Groups without a value have null cuts. NaN counts as the greatest value.
    """
    # A struct is equal to another with the same nulls in it, so a null is a group as any other.
    v = df.select(F.struct(F.lit(0).alias("__one"), *by).alias("__g"), F.col(value).cast("double").alias("__v"))
    probes = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
    splits = v.groupBy("__g").agg(F.count("__v").alias("__n"), F.percentile_approx("__v", probes, F.lit(ranges * 8)).alias("__splits"))
    dealt = v.where("__v IS NOT NULL").join(splits, "__g").select("__g", "__v", F.size(F.filter("__splits", lambda x: x < F.col("__v"))).alias("__range"))
    before = F.sum("__rows").over(Window.partitionBy("__g").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__rows")
    counted = dealt.groupBy("__g", "__range").agg(F.count("*").alias("__rows")).withColumn("__before", before)  # `ranges` rows a group
    wanted = F.explode(F.array(*(F.struct(F.lit(n).alias("at"), (F.lit(float(p)) * (F.col("__n") - 1)).alias("rank")) for n, p in enumerate(shares))))
    ranks = splits.where("__n > 0").select("__g", wanted.alias("w")).select("__g", "w.at", "w.rank", F.explode(F.array_distinct(F.array(F.floor("w.rank"), F.ceil("w.rank")))).alias("place"))
    placed = counted.join(ranks, "__g").where("place >= __before AND place < __before + __rows").select("__g", "__range", "__before", "at", "rank", "place")
    inside = dealt.join(placed.select("__g", "__range", "__before").distinct(), ["__g", "__range"]).groupBy("__g", "__range", "__before", "__v").agg(F.count("*").alias("__rows"))
    upto = F.sum("__rows").over(Window.partitionBy("__g", "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")
    values = inside.withColumn("__to", upto).drop("__before").join(placed, ["__g", "__range"]).where("place < __to AND place >= __to - __rows")
    both = values.groupBy("__g", "at", "rank").agg(F.min("__v").alias("low"), F.max("__v").alias("high"))
    part = F.col("rank") - F.floor("rank")
    exact = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - part) * F.col("low") + part * F.col("high"))
    found = both.groupBy("__g").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", exact.alias("v")))), lambda x: x["v"]).alias("cuts"))
    return splits.join(found, "__g", "left").select(*(F.col("__g")[c].alias(c) for c in by), F.col("__n").alias("known"), "cuts")


def frozen_cuts(df: DataFrame, value: str, shares: list[float], period: str = "period", by: list[str] | None = None) -> DataFrame:
    """Exact quantiles over TRAIN rows alone: `cuts`, one row per group of `by` (or one in all)."""
    return exact_quantiles(df.withColumn(value, F.when(F.col(period) == "TRAIN", F.col(value))), by or [], value, shares).select(*(by or []), "cuts")


def returns_summary(value: str = "ret") -> list[Column]:
    v = F.col(value)
    return [
        F.count(v).alias("cases"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), (100 * F.avg((v > 0).cast("double"))).alias("win_pct"), (100 * F.avg((v < 0).cast("double"))).alias("loss_pct"),
    ]


def profit_factor(value: str) -> Column:
    """Sum of gains by the size of the sum of losses; null without losses."""
    v = F.col(value)
    losses = -F.sum(F.when(v < 0, v))
    return F.when(losses > 0, F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0)) / losses)


def whole_sum(value: str) -> Column:
    """Sum, or null if any row's value is unknown."""
    return F.when(F.count(value) == F.count("*"), F.sum(value))


def gated(value: Column, n: Column, least: int) -> Column:
    return F.when(n >= least, value)


def grouping_all(df: DataFrame, keys: list[str], aggs: list[Column], sets: list[list[str]] | None = None) -> DataFrame:
    """Aggregates over the cube of `keys` (or the given sets), with ALL for what a set leaves out."""
    if sets is None:
        out = df.cube(*keys).agg(*aggs, *(F.grouping(k).alias(f"__{k}") for k in keys))
    else:
        out = df.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(*aggs, *(F.grouping(k).alias(f"__{k}") for k in keys))
    named = {k: F.when(F.col(f"__{k}") == 1, "ALL").otherwise(F.coalesce(F.col(k).cast("string"), F.lit("UNKNOWN"))) for k in keys}
    return out.withColumns(named).drop(*(f"__{k}" for k in keys))


def segments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row once per segment column: (segment, bucket)."""
    pairs = F.array(*(F.struct(F.lit(c).alias("segment"), F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")).alias("bucket")) for c in columns))
    return df.select("*", F.inline(pairs))


def against_baseline(df: DataFrame, ident: list[str], candidate: str, value: str, base: str) -> DataFrame:
    """`delta`: value minus that of the baseline candidate of the same identity."""
    w = Window.partitionBy(*ident)
    return df.withColumn("delta", F.col(value) - F.max(F.when(F.col(candidate) == base, F.col(value))).over(w))


def period_verdict(df: DataFrame, ident: str, value: str) -> DataFrame:
    """Values by period side by side and what they say: ROBUST, PROMISING, UNSTABLE or WORSE."""
    side = df.groupBy(ident).agg(*(F.max(F.when(F.col("period") == p, F.col(value))).alias(p.lower()) for p in PERIODS))
    train, valid, oos = (F.col(p.lower()) for p in PERIODS)
    verdict = F.when((train > 0) & (valid > 0) & (oos > 0), "ROBUST").when((train > 0) & (valid > 0), "PROMISING").when((train <= 0) & (valid <= 0), "WORSE").otherwise("UNSTABLE")
    return side.withColumn("verdict", verdict)


def drawdown(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Largest fall of the running sum below its running peak, which begins at 0."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = df.select(key, *order, F.sum(value).over(w).alias("total"))
    fall = run.withColumn("fall", F.greatest(F.lit(0.0), F.max("total").over(w)) - F.col("total"))
    return fall.groupBy(key).agg(F.max("fall").alias("max_drawdown"))
