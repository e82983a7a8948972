"""Rules on trades and plans: alignment, classes, votes, labels, excursions, netting, daily losses, stop variants, patterns of poles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import first_rule


def alignment(fast: Column, slow: Column) -> Column:
    """How the trends of two frames stand to each other."""
    known = fast.isin("BULLISH", "BEARISH", "NEUTRAL") & slow.isin("BULLISH", "BEARISH", "NEUTRAL")
    return first_rule(
        [(~known, "INSUFFICIENT"), ((fast == "BULLISH") & (slow == "BULLISH"), "ALIGNED_UP"), ((fast == "BEARISH") & (slow == "BEARISH"), "ALIGNED_DOWN"), ((fast != slow) & (fast != "NEUTRAL") & (slow != "NEUTRAL"), "CONFLICT")], "NEUTRAL"
    )


def votes(*rules: Column) -> Column:
    """How many rules hold; one that is unknown does not."""
    return sum((F.coalesce(r, F.lit(False)).cast("int") for r in rules), F.lit(0))


def cancel_label(ret: Column, stop_first: Column) -> Column:
    """What cancelling a plan would have done, by how the trade went on."""
    return first_rule([(stop_first & (ret < 0), "SAVED_LOSER"), (~stop_first & (ret > 0), "KILLED_WINNER")], "INCONCLUSIVE")


def adaptive_stop(current: Column, atr: Column, setup: Column) -> dict[str, Column]:
    """Stop distances with floors: of 1.5 and 2 ATR, and by the kind of setup."""
    return {
        "FLOOR_1_5": F.greatest(current, 1.5 * atr), "FLOOR_2_0": F.greatest(current, 2.0 * atr),
        "BY_SETUP": F.greatest(current, first_rule([(setup == "BREAKOUT", 2.0), (setup == "PULLBACK", 1.5)], 1.2) * atr),
    }


def excursions(ticks: DataFrame, key: str, entry: str) -> DataFrame:
    """Running best and worst result of a position by the quote it could be closed at."""
    w = Window.partitionBy(key).orderBy("ts_ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    result = F.col("bid") - F.col(entry)
    return ticks.withColumns({"mfe": F.max(result).over(w), "mae": F.min(result).over(w)})


def netted(deals: DataFrame, position: str) -> DataFrame:
    """Positions out of deals (position, side IN or OUT, price, volume): volume-weighted prices and whether volumes match."""
    part = lambda s, x: F.sum(F.when(F.col("side") == s, x))
    vol = F.col("volume")
    out = deals.groupBy(position).agg(
        (part("IN", F.col("price") * vol) / part("IN", vol)).alias("entry"), (part("OUT", F.col("price") * vol) / part("OUT", vol)).alias("exit"), F.coalesce(part("IN", vol), F.lit(0.0)).alias("opened"), F.coalesce(part("OUT", vol), F.lit(0.0)).alias("closed")
    )
    return out.withColumn("matched", F.abs(F.col("opened") - F.col("closed")) < 1e-9)


def daily_losses(deals: DataFrame, key: str, day: str, net: str, budget: float) -> DataFrame:
    """Loss realised each day, the greatest so far, and what is left of the day's budget."""
    per = deals.groupBy(key, day).agg((-F.coalesce(F.sum(F.when(F.col(net) < 0, F.col(net))), F.lit(0.0))).alias("loss"))
    worst = F.max("loss").over(Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumns({"worst": worst, "left": F.greatest(F.lit(0.0), F.lit(budget) - F.col("loss"))})


def poles(bars: DataFrame, n: int, atr: Column, least_atr: float = 3.0, least_efficiency: float = 0.6) -> DataFrame:
    """Bars that end a pole: a move of n bars of at least so many ATR whose path is straight enough."""
    w = Window.partitionBy("symbol").orderBy("start_ms")
    move = bars.withColumn("__step", F.abs(F.col("close") - F.lag("close").over(w)))
    net = F.col("close") - F.lag("close", n).over(w)
    path = F.sum("__step").over(w.rowsBetween(1 - n, 0))
    out = move.withColumns({"net": net, "efficiency": F.when(path > 0, F.abs(net) / path), "__atr": atr})
    return out.where((F.abs("net") >= least_atr * F.col("__atr")) & (F.col("efficiency") >= least_efficiency)).withColumn("side", F.when(F.col("net") > 0, "BULL").otherwise("BEAR")).drop("__step", "__atr")


def triangles(alternating: DataFrame, flat: float) -> DataFrame:
    """Four alternating pivots as a triangle or channel by the change of its highs and lows; within `flat` a side is level."""
    w = Window.partitionBy("symbol").orderBy("start_ms", "kind")
    df = alternating.withColumns({f"p{k}": F.lead("price", k).over(w) for k in (1, 2, 3)} | {"end_ms": F.lead("start_ms", 3).over(w)}).where("end_ms IS NOT NULL")
    first, second = F.col("p2") - F.col("price"), F.col("p3") - F.col("p1")
    high, low = F.when(F.col("kind") == "HIGH", first).otherwise(second), F.when(F.col("kind") == "HIGH", second).otherwise(first)
    shape = first_rule(
        [((F.abs(high) <= flat) & (low > flat), "ASCENDING"), ((F.abs(low) <= flat) & (high < -flat), "DESCENDING"), ((high < -flat) & (low > flat), "SYMMETRIC"), ((high > flat) & (low < -flat), "BROADENING"), ((high > flat) & (low > flat), "RISING_CHANNEL"), ((high < -flat) & (low < -flat), "FALLING_CHANNEL")], "LEVEL"
    )
    return df.select("symbol", F.col("start_ms").alias("first_ms"), "end_ms", shape.alias("shape"))


def complete_outcome(spans: DataFrame, bars: DataFrame, key: str, begin: str, end: str, width: int, most: int) -> DataFrame:
    """COMPLETED if every bar of [begin, end) is there, else UNRESOLVABLE_GAP, with the moves of those that are."""
    from tidemark.operators.joins import interval_join

    joined = interval_join(spans, bars.select(key, "start_ms", "high", "low", "close"), key, begin, end, "start_ms", most, closed="left")
    out = joined.groupBy(key, begin, end).agg(F.count("start_ms").alias("n"), F.max("high").alias("highest"), F.min("low").alias("lowest"), F.max_by("close", "start_ms").alias("last"))
    return out.withColumn("status", F.when(F.col("n") == ((F.col(end) - F.col(begin)) / width).cast("long"), "COMPLETED").otherwise("UNRESOLVABLE_GAP"))
