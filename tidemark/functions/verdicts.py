"""Scalar rules that name an outcome, a decision or a quality, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.expressions import align, clamp, finite, first_rule

# What stands for an inactive flag, and codes of deal reasons.
NULL_STATES = ("", "NONE", "NULL", "FALSE", "0", "NO", "UNKNOWN", "N/A")
DEAL_REASONS = {"TP": ("TP",), "SL": ("SL",), "MANUAL": ("CLIENT", "MOBILE", "WEB"), "EA_CLOSE": ("EXPERT",), "BROKER": ("SO",)}
#: Reward multiples of the two classes of trade and the buffer before an obstacle, in ATR.
CHILL_R, GOD_R, BUFFER_ATR = 0.75, 1.25, 0.20


def active(flag: Column) -> Column:
    """True for a flag that is set; null and the names of nothing are not."""
    return ~F.coalesce(F.upper(F.trim(flag.cast("string"))), F.lit("")).isin(*NULL_STATES)


def context_points(bias: Column, confidence: Column, risk: Column, declared: Column, sources_ok: Column, sources: Column, way: Column, fresh: Column, most: int = 3) -> Column:
    """-most to most: -1 for stale context or high risk, 0 if bias and declared side disagree, more than 1 only from reliable sources."""
    leaning = first_rule([(bias > 20, 1), (bias < -20, -1)], 0)
    named = F.upper(declared)
    agrees = ((leaning > 0) & named.isin("LONG", "ALCISTA")) | ((leaning < 0) & named.isin("SHORT", "BAJISTA"))
    reliable = (sources >= 2) & (sources_ok >= 2) & (sources_ok <= sources)
    points = F.when((F.upper(risk) == "LOW") & reliable & (confidence >= 70) & (F.abs(bias) >= 50), most).otherwise(min(1, most))
    return first_rule([(~way.isin(1, -1), 0), (~fresh, -1), (F.upper(risk) == "HIGH", -1), (~agrees | (confidence < 50), 0)], F.when(leaning == way, points).otherwise(-points))


def zone_confidence(h4_pivot: Column, equal_level: Column, touches: Column, h1_pivot: Column, m15_pivot: Column, medium: Column) -> Column:
    """HIGH, MEDIUM or LOW by what a zone consists of; `medium` holds where a recent extreme, a consolidation or a breakout is in it."""
    high = h4_pivot | equal_level | (touches >= 2) | (h1_pivot & m15_pivot)
    return first_rule([(high, "HIGH"), (h1_pivot | medium, "MEDIUM")], "LOW")


def reward_risk(way: Column, entry: Column, stop: Column, target: Column) -> Column:
    return F.when(F.abs(entry - stop) > 0, way * (target - entry) / F.abs(entry - stop))


def runtime_target(way: Column, trade_class: Column, entry: Column, stop: Column, atr: Column, obstacle: Column, tick: float = 0.01) -> tuple[Column, Column]:
    """(target, reason): a fixed reward multiple by class; GOD stops short of an obstacle before it. Aligned outward, a structural target inward."""
    up = lambda raw, outward: F.when((way > 0) == F.lit(outward), align(raw, tick, True)).otherwise(align(raw, tick, False))
    risk = F.abs(entry - stop)
    base = up(entry + way * F.when(trade_class == "CHILL", CHILL_R).otherwise(GOD_R) * risk, True)
    structural = up(obstacle - way * BUFFER_ATR * atr, False)
    nearer = (trade_class == "GOD") & (way * (obstacle - entry) > 0) & (way * (base - obstacle) >= 0) & (way * (structural - entry) > 0) & (way * (base - structural) > 0)
    nearer = F.coalesce(nearer, F.lit(False))
    reason = first_rule([(trade_class == "CHILL", "CHILL_FIXED"), (nearer, "GOD_OBSTACLE")], "GOD_BASELINE")
    return F.when(nearer, structural).otherwise(base), reason


def decision_outcome(text: Column, block: Column, live: Column) -> Column:
    """What became of a signal, by its free text and block code; the first rule that holds."""
    low = F.lower(text)
    has = lambda *names: F.coalesce(low.rlike("|".join(names)), F.lit(False))
    blocked = F.coalesce(~block.isin("", "NONE"), F.lit(False))
    return first_rule(
        [
            (live & has("order_filled", "position_open", "orden enviada", "orden confirmada"), "TRADE_TAKEN"),
            (has("señal simulada", "senal simulada"), "NO_TRADE"),
            (has("margen", "margin"), "BLOCKED_MARGIN"),
            (has("noticia", "calendario", "news"), "BLOCKED_NEWS"),
            (blocked & (block == "MARGIN_CHECK_FAILED"), "BLOCKED_MARGIN"),
            (blocked, "BLOCKED_RISK"),
            (has("riesgo", "drawdown", "pérdida diaria", "perdida diaria", "spread", "presupuesto"), "BLOCKED_RISK"),
            (has("score final", "sin setup", "esperando condiciones", "armado "), "INSUFFICIENT_SCORE"),
        ],
        "NO_TRADE",
    )


def signed_slippage(side: Column, requested: Column, executed: Column) -> Column:
    """Positive where the price was worse than asked for."""
    return F.when(side == "LONG", executed - requested).when(side == "SHORT", requested - executed)


def close_reason(reason: Column) -> Column:
    return first_rule([(reason.isNull(), "UNKNOWN"), *((reason.isin(*codes), name) for name, codes in DEAL_REASONS.items())], "OTHER")


def pattern_quality(difference: Column, tolerance: Column, depth: Column, least_depth: Column, leg1: Column, leg2: Column, breakout_atr: Column, volume: Column, momentum: Column) -> Column:
    """0 to 100: likeness of the extremes 25, depth 25, balance of the legs 20, strength of the breakout 20, volume and momentum 5 each."""
    score = 25 * clamp(1 - difference / tolerance, 0.0, 1.0) + 25 * clamp(depth / (2 * least_depth), 0.0, 1.0) + 20 * F.least(leg1, leg2) / F.greatest(leg1, leg2)
    score = score + 20 * clamp(F.coalesce(breakout_atr, F.lit(0.0)), 0.0, 1.0) + 5 * volume.cast("int") + 5 * momentum.cast("int")
    return F.when((tolerance > 0) & (least_depth > 0), clamp(score, 0.0, 100.0)).otherwise(0.0)


def quality_bonus(quality: Column) -> Column:
    return first_rule([(~finite(quality) | (quality < 50), 0), (quality < 65, 1), (quality < 75, 2), (quality < 85, 3)], 4)


def release_outcome(opposite: Column, original: Column, bars: Column) -> Column:
    """By the place of the first bar that reached each side (null: none): both in one bar are ambiguous, no bars say nothing."""
    return first_rule([(bars == 0, "UNRESOLVABLE"), (opposite == original, "AMBIGUOUS"), (opposite.isNotNull() & (original.isNull() | (opposite < original)), "TRUE_RELEASE"), (original.isNotNull(), "FALSE_RELEASE")], "INCONCLUSIVE")


def presence_quality(*present: Column) -> Column:
    """Per cent of the checks that hold; a null check does not."""
    return F.round(100.0 * sum(F.coalesce(c, F.lit(False)).cast("int") for c in present) / len(present)).cast("int")


def health(age_s: Column, limit_s: Column) -> Column:
    return first_rule([(age_s.isNull(), "NO_DATA"), (age_s > limit_s, "STALE")], "ONLINE")


def causal(provenance: Column, value: Column) -> Column:
    """`value`, where it says that it comes from closed bars alone; fails for any other provenance."""
    return F.when(F.coalesce(provenance, F.lit("")) == "CLOSED_M1_ONLY", value).otherwise(F.raise_error(F.concat(F.lit("not causal: "), F.coalesce(provenance, F.lit("null")))))


def renamed_values(tree: Column, old: str, new: str) -> Column:
    """JSON text in which each string value that is `old`, in any case, is `new`; keys (which a colon follows) and parts of longer strings stay.

    `old` and `new` are words of letters, digits and underscores; a value written with \\u escapes is not taken for `old`.
    """
    if not (re.fullmatch(r"\w+", old, re.ASCII) and re.fullmatch(r"\w+", new, re.ASCII)):
        raise ValueError("old and new must be words")
    return F.regexp_replace(tree, rf'(?<!\\)"(?i:{old})"(?!\s*:)', f'"{new}"')
