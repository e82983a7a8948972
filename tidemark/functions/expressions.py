"""Scalar rules as column expressions: validation, buckets, directions, scores, stops and targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def ratio(n: Column, d: Column) -> Column:
    """n / d where d > 0, else null."""
    return F.when(d > 0, n / d)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def first_rule(rules: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule that holds; a null condition does not hold."""
    out = reduce(lambda acc, r: acc.when(F.coalesce(r[0], F.lit(False)), r[1]), rules, F)
    return out.otherwise(otherwise)


def quote_fault(bid: Column, ask: Column, ts: Column) -> Column:
    """Reason a quote is discarded for, or null."""
    return first_rule([(ts.isNull(), "timestamp"), (~finite(bid) | ~finite(ask) | (bid <= 0) | (ask <= 0), "bid_or_ask"), (ask < bid, "ask_below_bid")])


def bar_ok() -> Column:
    """Open, high, low and close agree; there is a tick; the spread is not negative."""
    c = F.col
    return (c("high") >= F.greatest("open", "close", "low")) & (c("low") <= F.least("open", "close")) & (c("ticks") >= 1) & (c("avg_spread") >= 0)


def edge_bucket(x: Column, edges: list[float], names: list[str] | None = None) -> Column:
    """Label of the half-open interval [edge, next edge); UNKNOWN for null, OUTSIDE beyond the edges."""
    names = names or [f"{a:g}-{b:g}" for a, b in zip(edges, edges[1:])]
    rules = [(x.isNull(), "UNKNOWN")] + [((x >= a) & (x < b), n) for a, b, n in zip(edges, edges[1:], names)]
    return first_rule(rules, "OUTSIDE")


def cut_bucket(x: Column, cuts: list[Column], names: list[str]) -> Column:
    """Label by frozen cuts, upper bounds inclusive."""
    rules = [(x.isNull() | reduce(lambda a, b: a | b, [c.isNull() for c in cuts]), "UNKNOWN")] + [(x <= c, n) for c, n in zip(cuts, names)]
    return first_rule(rules, names[-1])


def sample_label(n: Column) -> Column:
    return first_rule([(n >= 100, "SUFFICIENT"), (n >= 30, "THIN_SAMPLE")], "INSUFFICIENT")


def align(price: Column, tick: float, up: bool) -> Column:
    """Price on the tick grid, away from float noise of 1e-10 ticks."""
    units = price / tick
    return (F.ceil(units - 1e-10) if up else F.floor(units + 1e-10)) * tick


def round_price(x: Column, digits: int = 2) -> Column:
    scale = 10.0**digits
    return F.floor(x * scale + 0.5 + 1e-10) / scale


def signed_outcome(direction: Column, r: Column, mfe: Column, mae: Column) -> list[Column]:
    """(return, best, worst) for a direction: a short has them negated, with best and worst exchanged."""
    short = direction == "SHORT"
    return [F.when(short, -r).otherwise(r).alias("ret"), F.when(short, -mae).otherwise(mfe).alias("mfe"), F.when(short, -mfe).otherwise(mae).alias("mae")]


def direction(armed: Column, long_score: Column, short_score: Column, structure: Column) -> Column:
    """Armed side; else the higher score; else the side of the structure."""
    return F.coalesce(
        F.when(armed.isin("LONG", "SHORT"), armed),
        first_rule([(long_score > short_score, "LONG"), (short_score > long_score, "SHORT")]),
        first_rule([(structure == "BULLISH", "LONG"), (structure == "BEARISH", "SHORT")]),
    )


def setup_label(breakout: Column, pullback: Column, momentum: Column, recovery: Column, side: Column) -> Column:
    return first_rule([(breakout, "BREAKOUT"), (pullback, "PULLBACK"), (momentum, "MOMENTUM"), (recovery, "RECOVERY")], F.concat(F.lit("CONTINUATION_"), F.coalesce(side, F.lit("NONE"))))


def structural_points(valid: Column, pullback: Column, breakout: Column, momentum: Column) -> Column:
    """15 for a valid structure, 5 for a pullback, 10 for a breakout or else 5 for momentum; 25 at most."""
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    extra = F.when(F.coalesce(breakout, F.lit(False)), 10).otherwise(5 * yes(momentum))
    return F.least(F.lit(25), 15 * yes(valid) + 5 * yes(pullback) + extra)


def technical_score(trend_high: Column, trend_low: Column, adx: Column, rsi_band: Column, structural: Column, volume: Column) -> Column:
    """0 to 100: higher frame 20, lower frame 15, both 5 more, trend strength 10, RSI band 10, structure up to 25, volume 5."""
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    total = 20 * yes(trend_high) + 15 * yes(trend_low) + 5 * yes(trend_high & trend_low) + 10 * yes(adx >= 16) + 10 * yes(rsi_band) + structural + 5 * yes(volume)
    return clamp(total, 0, 100)


def timing_points(side: Column, structure: Column, breakout: Column, momentum: Column, score: Column, gate: int = 58) -> Column:
    """-4 to 4 from the fastest frame: 2 each for structure and breakout, 1 for momentum, negative against the side; 0 below the gate."""
    way = F.when(side == "LONG", 1).when(side == "SHORT", -1).otherwise(0)
    of = lambda c, up, down: F.when(c == up, 1).when(c == down, -1).otherwise(0)
    points = way * (2 * of(structure, "BULLISH", "BEARISH") + 2 * of(breakout, "LONG", "SHORT") + of(momentum, "LONG", "SHORT"))
    return F.when(score >= gate, clamp(points, -4, 4)).otherwise(0)


def stop_candidates(atr: Column, recent: Column, pivot: Column, entry: Column, side: Column) -> Column:
    """Stop distances by rule, as an array of (candidate, distance); null distances stay."""
    way = F.when(side == "LONG", 1.0).otherwise(-1.0)
    extreme, swing = way * (entry - recent) + 0.25 * atr, way * (entry - pivot) + 0.25 * atr
    current = F.least(F.greatest(F.greatest(1.2 * atr, extreme), 0.8 * atr), 2.0 * atr)
    named = {"CURRENT": current, "STRUCTURE": F.when(swing > 0, swing), "ATR_1_0": atr * 1.0, "ATR_1_5": 1.5 * atr, "ATR_2_0": 2.0 * atr, "HYBRID": F.greatest(0.8 * atr, F.when(swing > 0, swing))}
    return F.array(*(F.struct(F.lit(n).alias("candidate"), d.cast("double").alias("distance")) for n, d in named.items()))


def freshness(age_minutes: Column, thresholds: tuple[int, ...] = (5, 15, 60)) -> tuple[Column, Column]:
    """(label, thresholds exceeded)."""
    label = first_rule([(age_minutes.isNull(), "UNKNOWN"), (age_minutes <= thresholds[1], "FRESH")], "STALE")
    return label, F.filter(F.array(*map(F.lit, thresholds)), lambda t: age_minutes > t)


def reliability(n: Column, win_share: Column, profit_factor: Column, drawdown: Column, months: Column) -> Column:
    """0 to 100 out of five bounded terms."""
    return (
        clamp(F.log10(F.greatest(n, F.lit(1))) * 10, 0, 25) + clamp(win_share * 25, 0, 25) + clamp((profit_factor - 1) * 12.5, 0, 25) + clamp(15 - drawdown * 30, 0, 15) + clamp(months / 12 * 10, 0, 10)
    )


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)
