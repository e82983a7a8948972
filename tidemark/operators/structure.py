"""Pivots, their alternation, market structure, chart patterns, lines and price zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import by_key


def fractal_pivots(bars: DataFrame, prominence: Column | None = None) -> DataFrame:
    """Bars whose high (low) is strictly above (below) that of the two bars on either side, in long form.

    (symbol, start_ms, confirmed_ms, kind HIGH or LOW, price); a bar may be both. Known from the close of the second bar
    after it. `prominence` is the least distance to the nearest of the four neighbours.
    """
    w = by_key()
    around = lambda c: [f(c, k).over(w) for f in (F.lag, F.lead) for k in (1, 2)]
    high, low = F.greatest(*around("high")), F.least(*around("low"))
    all_there = F.lag("high", 2).over(w).isNotNull() & F.lead("high", 2).over(w).isNotNull()
    need = F.lit(0.0) if prominence is None else prominence
    tops = F.when(all_there & (F.col("high") > high) & (F.col("high") - high >= need), F.struct(F.lit("HIGH").alias("kind"), F.col("high").alias("price")))
    lows = F.when(all_there & (F.col("low") < low) & (low - F.col("low") >= need), F.struct(F.lit("LOW").alias("kind"), F.col("low").alias("price")))
    found = bars.select("symbol", "start_ms", F.lead("close_ms", 2).over(w).alias("confirmed_ms"), F.array_compact(F.array(tops, lows)).alias("p"))
    return found.where("size(p) > 0").select("symbol", "start_ms", "confirmed_ms", F.inline("p"))


def alternate(pivots: DataFrame) -> DataFrame:
    """Runs of one kind as their most extreme pivot; the earliest of equals."""
    w = Window.partitionBy("symbol").orderBy("start_ms", "kind")
    run = pivots.withColumn("new", (F.coalesce(F.lag("kind").over(w), F.lit("")) != F.col("kind")).cast("int")).withColumn("run", F.sum("new").over(w))
    extreme = F.struct(F.when(F.col("kind") == "HIGH", F.col("price")).otherwise(-F.col("price")), -F.col("start_ms"))
    return run.groupBy("symbol", "run", "kind").agg(F.max_by("price", extreme).alias("price"), F.max_by("start_ms", extreme).alias("start_ms"), F.max_by("confirmed_ms", extreme).alias("confirmed_ms"), F.count("*").alias("run_length"))


def classify(high: Column, prev_high: Column, low: Column, prev_low: Column, tolerance: Column) -> Column:
    """BULLISH for higher highs and lows, BEARISH for lower ones, else NEUTRAL; INSUFFICIENT with fewer than two of either."""
    hh, hl, lh, ll = high > prev_high + tolerance, low > prev_low + tolerance, high < prev_high - tolerance, low < prev_low - tolerance
    return F.when(prev_high.isNull() | prev_low.isNull(), "INSUFFICIENT").when(hh & hl, "BULLISH").when(lh & ll, "BEARISH").otherwise("NEUTRAL")


def structure(pivots: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Each pivot with the structure that the last two highs and lows up to it make."""
    w = Window.partitionBy("symbol").orderBy("start_ms", "kind").rowsBetween(Window.unboundedPreceding, 0)
    kept = {}
    for kind in ("HIGH", "LOW"):
        # Among pivots of one kind the one before is the row before; others carry both on.
        mine = Window.partitionBy("symbol", "kind").orderBy("start_ms")
        pivots = pivots.withColumn(f"__{kind}", F.when(F.col("kind") == kind, F.struct("price", F.lag("price").over(mine).alias("before"))))
        kept[kind] = F.last(f"__{kind}", ignorenulls=True).over(w)
    df = pivots.withColumns({"h": kept["HIGH"], "l": kept["LOW"]})
    return df.withColumn("structure", classify(F.col("h.price"), F.col("h.before"), F.col("l.price"), F.col("l.before"), F.lit(tolerance))).drop("__HIGH", "__LOW", "h", "l")


def three_point_line(x: list[Column], y: list[Column]) -> tuple[Column, Column, Column]:
    """Least-squares (slope, intercept, root mean square residual) through three points."""
    mx, my = (x[0] + x[1] + x[2]) / 3, (y[0] + y[1] + y[2]) / 3
    sxx = sum(((a - mx) * (a - mx) for a in x), F.lit(0.0))
    slope = sum(((a - mx) * (b - my) for a, b in zip(x, y)), F.lit(0.0)) / sxx
    cut = my - slope * mx
    rms = F.sqrt(sum(((b - slope * a - cut) * (b - slope * a - cut) for a, b in zip(x, y)), F.lit(0.0)) / 3)
    return slope, cut, rms


def double_patterns(alternating: DataFrame, atr: float, tolerance: float = 0.3, depth: float = 1.0) -> DataFrame:
    """Double bottoms (W) and tops (M): outer pivots of one kind within tolerance, the middle one deep enough."""
    w = Window.partitionBy("symbol").orderBy("start_ms", "kind")
    df = alternating.withColumns({"p2": F.lead("price", 1).over(w), "p3": F.lead("price", 2).over(w), "t2": F.lead("start_ms", 1).over(w), "t3": F.lead("start_ms", 2).over(w), "known_ms": F.lead("confirmed_ms", 2).over(w)})
    level = F.abs(F.col("price") - F.col("p3")) <= tolerance * atr
    deep = F.when(F.col("kind") == "LOW", F.col("p2") - F.greatest("price", "p3")).otherwise(F.least("price", "p3") - F.col("p2")) >= depth * atr
    return df.where(level & deep).select("symbol", F.when(F.col("kind") == "LOW", "W").otherwise("M").alias("pattern"), F.col("start_ms").alias("first_ms"), "t2", "t3", "known_ms", F.col("p2").alias("neckline"), F.when(F.col("kind") == "LOW", F.least("price", "p3")).otherwise(F.greatest("price", "p3")).alias("invalid_at"))


def head_shoulders(alternating: DataFrame, atr: float, shoulder: float = 0.75, head: float = 0.5) -> DataFrame:
    """Head and shoulders (highs) and its inverse (lows) over five alternating pivots."""
    w = Window.partitionBy("symbol").orderBy("start_ms", "kind")
    df = alternating.withColumns({f"q{k}": F.lead("price", k).over(w) for k in (1, 2, 3, 4)} | {"end_ms": F.lead("start_ms", 4).over(w), "known_ms": F.lead("confirmed_ms", 4).over(w)})
    level = F.abs(F.col("price") - F.col("q4")) <= shoulder * atr
    top = (F.col("kind") == "HIGH") & (F.col("q2") - F.greatest("price", "q4") >= head * atr)
    bottom = (F.col("kind") == "LOW") & (F.least("price", "q4") - F.col("q2") >= head * atr)
    return df.where(level & (top | bottom)).select("symbol", F.when(top, "HEAD_SHOULDERS").otherwise("INVERSE").alias("pattern"), F.col("start_ms").alias("first_ms"), "end_ms", "known_ms", ((F.col("q1") + F.col("q3")) / 2).alias("neckline"))


def resolve(patterns: DataFrame, bars: DataFrame, most_bars: int = 36, width: int = 3_600_000) -> DataFrame:
    """First close after a pattern is known that breaks its neckline (CONFIRMED) or its extreme (INVALIDATED); EXPIRED without one in time."""
    from tidemark.operators.joins import interval_join

    spans = patterns.withColumn("until_ms", F.col("known_ms") + most_bars * width).where("known_ms IS NOT NULL")
    joined = interval_join(spans, bars.select("symbol", F.col("close_ms").alias("bar_ms"), "close"), "symbol", "known_ms", "until_ms", "bar_ms", most_bars * width)
    up = F.col("pattern") == "W"
    bad = F.when(up, F.col("close") < F.col("invalid_at")).otherwise(F.col("close") > F.col("invalid_at"))
    good = F.when(up, F.col("close") > F.col("neckline")).otherwise(F.col("close") < F.col("neckline"))
    event = F.when(bad, F.struct("bar_ms", F.lit(0), F.lit("INVALIDATED").alias("state"))).when(good, F.struct("bar_ms", F.lit(0), F.lit("CONFIRMED").alias("state")))
    out = joined.groupBy("symbol", "pattern", "first_ms", "t3").agg(F.min(event).alias("e"))
    return out.select("symbol", "pattern", "first_ms", "t3", F.coalesce("e.state", F.lit("EXPIRED")).alias("state"), F.col("e.bar_ms").alias("resolved_ms"))


def zones(pivots: DataFrame, width: float, period: str = "period") -> DataFrame:
    """Pivot prices in order, cut where a price is over `width` above its zone's first: mean price, touches, strength, bounds.

    A fold over one array of a symbol and period, whose pivots are few; zones are numbered from 0 by price. Null prices are left out.
    """
    from tidemark.operators.levels import heads, let

    of = pivots.where("price IS NOT NULL").groupBy("symbol", period).agg(F.sort_array(F.collect_list(F.struct("price", "start_ms"))).alias("p"))
    marked = F.arrays_zip(F.col("p").alias("p"), heads(F.transform("p", lambda p: p.price), F.lit(width)).alias("head"))
    groups = let(marked, lambda m: F.transform(F.array_distinct(F.transform(m, lambda x: x["head"])), lambda h: F.transform(F.filter(m, lambda x: x["head"] == h), lambda x: x["p"])))
    of = of.select("symbol", period, F.posexplode(groups).alias("zone", "g"))
    prices, touches = F.transform("g", lambda p: p.price), F.size(F.array_distinct(F.transform("g", lambda p: p.start_ms))).cast("long")
    mean = F.aggregate(prices, F.lit(0.0), lambda a, p: a + p) / F.size("g")
    return of.select("symbol", F.col(period).cast("long").alias(period), F.col("zone").cast("long").alias("zone"), mean.alias("price"), touches.alias("touches"), F.least(touches, F.lit(5)).cast("long").alias("strength"), F.array_min(prices).alias("low"), F.array_max(prices).alias("high"))
