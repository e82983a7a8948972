"""Regimes of bars: thresholds calibrated on earlier bars, states that depend on the state before, ranks and medians of the past.

Everything is windows by symbol over bars. A trend is entered at one slope and left at a smaller one; as the bars in between keep
what the last decisive bar said, the state is the last decisive value, not a fold over all bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import first_rule
from tidemark.functions.timebase import DAY
from tidemark.operators.machines import Machine, named, run
from tidemark.operators.stats import exact_quantiles

#: Bars before the current one that calibrate, and how many of them must be known.
CALIBRATION, LEAST = 256, 30
#: Rank from which a bar is extreme.
SHOCK = 0.98
# The regimes, the one of nothing known first, and those that take over at once.
REGIMES = ["UNKNOWN", "EVENT_SHOCK", "TRANSITION", "TREND_UP", "TREND_DOWN", "RANGE", "VOL_EXPANSION", "VOL_CONTRACTION"]
AT_ONCE = ("EVENT_SHOCK", "TRANSITION")


def _time():
    return Window.partitionBy("symbol").orderBy("start_ms")


def calibrated(bars: DataFrame) -> DataFrame:
    """`bars` (symbol, start_ms, atr, slope, train) with atr_low, atr_high, slope_entry and slope_exit.

    In TRAIN a bar is judged by the CALIBRATION bars before it; after TRAIN by what all TRAIN bars say. Too few known bars give null.
    """
    past = _time().rowsBetween(-CALIBRATION, -1)
    enough = (F.count("atr").over(past) >= LEAST) & (F.count("slope").over(past) >= LEAST)
    at = lambda x, p: F.expr(f"percentile({x}, {p})").over(past)
    found = {"atr_low": at("atr", 0.2), "atr_high": at("atr", 0.8), "slope_entry": F.greatest(F.lit(0.05), at("abs(slope)", 0.6)), "slope_exit": F.greatest(F.lit(0.025), at("abs(slope)", 0.35))}
    known = bars.withColumns({n: F.when(enough & F.col("train"), F.round(c, 8)) for n, c in found.items()})
    both = F.array(F.struct(F.lit("atr").alias("of"), F.col("atr").alias("v")), F.struct(F.lit("slope").alias("of"), F.abs("slope").alias("v")))
    train = exact_quantiles(bars.where("train").select("symbol", F.inline(both)), ["symbol", "of"], "v", [0.2, 0.8, 0.6, 0.35])
    cut = lambda of, at: F.max(F.when(F.col("of") == of, F.col("cuts")[at]))
    cuts = {"atr_low": cut("atr", 0), "atr_high": cut("atr", 1), "slope_entry": F.greatest(F.lit(0.05), cut("slope", 2)), "slope_exit": F.greatest(F.lit(0.025), cut("slope", 3))}
    frozen = train.groupBy("symbol").agg(*(F.when(F.min("known") >= LEAST, F.round(c, 8)).alias(f"__{n}") for n, c in cuts.items()))  # a row a symbol
    out = known.join(frozen, "symbol", "left")
    return out.withColumns({n: F.when(F.col("train"), F.col(n)).otherwise(F.col(f"__{n}")) for n in cuts}).drop(*(f"__{n}" for n in cuts))


def structured(bars: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """`bars` (with atr) with `structure`: what the last two highs and lows say that are known at each bar.

    A pivot is above (below) two bars on either side, not both at once, and known two bars later if that bar's atr is. Of pivots of one
    kind in a row the most extreme counts. Both above the ones before by over `tolerance` atr: BULLISH; both below: BEARISH;
    neither moved by more: RANGE; else MIXED; UNKNOWN before there are two of each, or without atr.
    """
    w, upto = _time(), _time().rowsBetween(Window.unboundedPreceding, 0)
    around = lambda c, f: f(*(F.lag(c, k).over(w) for k in (4, 3, 1)), F.col(c))
    high, low = F.lag("high", 2).over(w), F.lag("low", 2).over(w)
    is_high, is_low = high > around("high", F.greatest), low < around("low", F.least)
    ready = F.lag("high", 4).over(w).isNotNull() & F.col("atr").isNotNull() & (is_high != is_low)
    # Signed, so that within a run of one kind the greatest counts.
    marked = bars.withColumn("__pivot", F.when(ready, F.when(is_high, F.struct(F.lit(1.0).alias("sign"), high.alias("x"))).otherwise(F.struct(F.lit(-1.0).alias("sign"), (-low).alias("x")))))
    pivots = marked.where("__pivot IS NOT NULL").select("symbol", "start_ms", "__pivot.sign", "__pivot.x")
    turned = (F.coalesce(F.lag("sign").over(w), F.lit(0.0)) != F.col("sign")).cast("int")
    pivots = pivots.withColumn("turned", turned).withColumn("run", F.sum("turned").over(upto))
    pivots = pivots.withColumn("now", F.max("x").over(Window.partitionBy("symbol", "run").orderBy("start_ms").rowsBetween(Window.unboundedPreceding, 0)))
    of_run = Window.partitionBy("symbol").orderBy("run")
    runs = pivots.groupBy("symbol", "run").agg(F.max("x").alias("best")).withColumns({f"b{k}": F.lag("best", k).over(of_run) for k in (1, 2, 3)}).drop("best")
    # The run's own kind moved from two runs ago, the other kind from three runs ago to the run before.
    moves = pivots.join(runs, ["symbol", "run"]).select("symbol", "start_ms", (F.col("sign") * (F.col("now") - F.col("b2"))).alias("own"), (-F.col("sign") * (F.col("b1") - F.col("b3"))).alias("other"))
    known = marked.join(moves, ["symbol", "start_ms"], "left").withColumn("__moves", F.last(F.when(F.col("__pivot").isNotNull(), F.struct("own", "other")), ignorenulls=True).over(upto))
    a, b, t = F.col("__moves.own"), F.col("__moves.other"), tolerance * F.col("atr")
    said = first_rule([(a.isNull() | b.isNull() | F.col("atr").isNull(), "UNKNOWN"), ((a > t) & (b > t), "BULLISH"), ((a < -t) & (b < -t), "BEARISH"), ((F.abs(a) <= t) & (F.abs(b) <= t), "RANGE")], "MIXED")
    return known.withColumn("structure", said).drop("__pivot", "__moves", "own", "other")


def ranked(bars: DataFrame, values: dict[str, Column], most: int = 101) -> DataFrame:
    """`bars` with, for each name, the share of up to `most` earlier known values that are not above the bar's; null with fewer than LEAST."""
    bars = bars.withColumns({f"__{n}": c for n, c in values.items()})
    past = _time().rowsBetween(-most, -1)

    def share(value: Column) -> Column:
        seen = F.collect_list(value).over(past)
        return F.when((F.size(seen) >= LEAST) & value.isNotNull(), F.size(F.filter(seen, lambda x: x <= value)) / F.size(seen))

    return bars.withColumns({n: share(F.col(f"__{n}")) for n in values}).drop(*(f"__{n}" for n in values))


def classified(bars: DataFrame) -> DataFrame:
    """`bars` (as of `calibrated`, `structured` and `ranked`) with trend, volatility, transition, regime and confidence.

    An EVENT_SHOCK is a bar whose atr_rank and whose range_rank or spread_rank are at SHOCK at least. A trend against the
    structure is none; what is neither trend nor RANGE is named after its volatility. Unknown atr, slope or thresholds make UNKNOWN.
    """
    known = F.col("atr").isNotNull() & F.col("slope").isNotNull() & F.col("slope_entry").isNotNull()
    size = F.abs("slope")
    decisive = first_rule([(~known, 0), (size >= F.col("slope_entry"), 1), (size < F.col("slope_exit"), 0)])
    out = bars.withColumn("__on", F.coalesce(F.last(decisive, ignorenulls=True).over(_time().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    out = out.withColumn("trend", first_rule([(~known, "UNKNOWN"), ((F.col("__on") == 1) & (F.col("slope") > 0), "UP"), (F.col("__on") == 1, "DOWN")], "FLAT"))
    before = F.coalesce(F.lag("trend").over(_time()), F.lit("UNKNOWN"))
    out = out.withColumn("volatility", first_rule([(~known, "UNKNOWN"), (F.col("atr") >= F.col("atr_high"), "EXPANSION"), (F.col("atr") <= F.col("atr_low"), "CONTRACTION")], "NORMAL"))
    shock = (F.col("atr_rank") >= SHOCK) & (F.coalesce(F.col("range_rank") >= SHOCK, F.lit(False)) | F.coalesce(F.col("spread_rank") >= SHOCK, F.lit(False)))
    out = out.withColumn("transition", first_rule([(~known, "UNKNOWN"), (shock, "SHOCK"), ((before != "UNKNOWN") & (before != F.col("trend")), "TRANSITION")], "STABLE"))
    trend, structure = F.col("trend"), F.col("structure")
    regime = first_rule(
        [
            (~known, "UNKNOWN"), (F.col("transition") == "SHOCK", "EVENT_SHOCK"), (F.col("transition") == "TRANSITION", "TRANSITION"), ((trend == "UP") & (structure != "BEARISH"), "TREND_UP"),
            ((trend == "DOWN") & (structure != "BULLISH"), "TREND_DOWN"), ((structure == "RANGE") | (trend == "FLAT"), "RANGE"), (F.col("volatility") == "EXPANSION", "VOL_EXPANSION"), (F.col("volatility") == "CONTRACTION", "VOL_CONTRACTION"),
        ],
        "UNKNOWN",
    )
    out = out.withColumn("regime", regime)
    strength = F.least(F.lit(1.0), size / F.greatest(F.col("slope_entry") * 2, F.lit(0.01)))
    confidence = first_rule([(F.col("regime") == "UNKNOWN", 0.0), (F.col("regime") == "EVENT_SHOCK", 1.0), (F.col("regime") == "TRANSITION", F.greatest(F.lit(0.75), strength)), (F.col("regime") == "RANGE", 0.5)], strength)
    return out.withColumn("confidence", F.round(confidence, 4)).drop("__on")


def settled(bars: DataFrame, tie: list[str], least: int = 2, enter: float = 0.55, leave: float = 0.45, width: int = 30 * DAY) -> DataFrame:
    """`bars` (regime, confidence) with `settled`, `moved_from`, `moved_to` and `age`: the regime behind single bars.

    Another regime takes over after `least` bars in a row that name it with a confidence of `leave` or more (`enter` while none
    is known); EVENT_SHOCK and TRANSITION do at once. UNKNOWN, the settled regime or a weaker bar ends the run. `age` counts bars,
    from 1 where the regime took over; of rows with one time the first by `tie` counts and the others repeat what holds.
    """
    if least < 1 or not 0 <= leave <= enter <= 1:
        raise ValueError("least must be 1 or more and 0 <= leave <= enter <= 1")

    def rule(state, letter):
        now, candidate, length = state
        new, level = divmod(letter, 3)
        if new in (now, 0) or level < (2 if now == 0 else 1):
            return (now, None, 0), False
        length = length + 1 if new == candidate else 1
        if length < least and REGIMES[new] not in AT_ONCE:
            return (now, new, length), False
        return (new, None, 0), True

    machine = Machine.of((0, None, 0), 3 * len(REGIMES), rule)
    level = F.when(F.col("confidence") >= enter, 2).when(F.col("confidence") >= leave, 1).otherwise(0)
    letter = 3 * (F.array_position(F.array(*map(F.lit, REGIMES)), F.coalesce("regime", F.lit("UNKNOWN"))) - 1) + level
    first = F.row_number().over(Window.partitionBy("symbol", "start_ms").orderBy(*tie)) == 1
    out = run(bars.withColumn("__first", first), machine, F.when(F.col("__first"), letter), "symbol", ["start_ms", *tie], width)
    name = lambda c: named(F.col(c), [REGIMES[s[0]] for s in machine.states])
    moved = {"settled": name("after"), "moved_from": F.when(F.col("entered"), name("before")), "moved_to": F.when(F.col("entered"), name("after"))}
    return out.withColumns(moved).drop("before", "after", "entered", "__first")


def alignment(fast: Column, middle: Column, slow: Column) -> Column:
    """What the trends of three widths say together."""
    both = lambda x: (middle == x) & (slow == x)
    unknown = F.coalesce(middle, F.lit("UNKNOWN")).isin("UNKNOWN") | F.coalesce(slow, F.lit("UNKNOWN")).isin("UNKNOWN")
    against = ((middle == "UP") & (slow == "DOWN")) | ((middle == "DOWN") & (slow == "UP"))
    return first_rule([(both("UP"), "ALIGNED_UP"), (both("DOWN"), "ALIGNED_DOWN"), (unknown, "INSUFFICIENT"), (against, "CONFLICT")], "NEUTRAL")


def prefix_rank(bars: DataFrame, value: str) -> DataFrame:
    """`bars` with rank: share of earlier values that are not greater; in TRAIN of the CALIBRATION bars before, afterwards of all TRAIN bars."""
    past = F.collect_list(value).over(_time().rowsBetween(-CALIBRATION, -1))
    online = F.when(F.size(past) >= LEAST, F.size(F.filter(past, lambda v: v <= F.col(value))) / F.size(past))
    train = F.when(F.col("train") & F.col(value).isNotNull(), 1)
    upto = F.count(train).over(Window.partitionBy("symbol").orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    frozen = upto / F.count(train).over(Window.partitionBy("symbol"))
    return bars.withColumn("rank", F.when(F.col("train"), online).otherwise(frozen))


def rolling_median(bars: DataFrame, value: str, rows: int = 20) -> DataFrame:
    """`bars` with the median of `value` over the `rows` bars before, the current one left out."""
    return bars.withColumn("median", F.expr(f"percentile({value}, 0.5)").over(_time().rowsBetween(-rows, -1)))


def confirmation(bars: DataFrame, atr: str = "atr", rows: int = 20) -> DataFrame:
    """`bars` with volume_ok (ticks 1.05 times the mean of the bars before that have any) and body_up, body_down (half an ATR)."""
    mean = F.avg(F.when(F.col("ticks") > 0, F.col("ticks"))).over(_time().rowsBetween(-rows, -1))
    body = F.col("close") - F.col("open")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return bars.withColumns({"volume_ok": yes(F.col("ticks") >= 1.05 * mean), "body_up": yes(body >= 0.5 * F.col(atr)), "body_down": yes(-body >= 0.5 * F.col(atr))})
