"""Levels of several bar widths as evidence at a bar's close, and the zones that evidence makes.

Everything is read from bars that are closed at the observation. What a bar sees of its own width comes from a window
over the last few bars, what it sees of another width by an as-of join on closing times; no bar is paired with all
pivots of its symbol. An observation holds a few dozen pieces of evidence, so zones are folds over one array a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timebase import HOUR, MINUTE
from tidemark.operators.indicators import by_key, last_rows, simple_dmi
from tidemark.operators.joins import asof_backward

# Pivots (share of ATR, least distance in bars), tolerances and bounds as shares of ATR, bars looked at.
PROMINENCE, MIN_BARS = 0.20, 2
MERGE, EQUAL = 0.15, 0.20
NARROWEST, WIDEST, CONSOLIDATION = 0.50, 2.0, 5
LOOKBACK = {"H1": 30, "H4": 12, "M15": 40}
STRENGTH = {"H1": 3, "H4": 4, "M15": 1}
WIDTH = {"H1": HOUR, "H4": 4 * HOUR, "M15": 15 * MINUTE}

EVIDENCE = "array<struct<seq:int,kind:string,price:double,at_ms:bigint,frame:string,source:string,strength:int,weight:int>>"
ZONES = "array<struct<kind:string,price:double,touches:int,strength:int,major:boolean,sources:array<string>,first_ms:bigint,last_ms:bigint>>"
MERGED = "array<struct<kind:string,price:double,weight:bigint,evidence:int,touches:int,first_ms:bigint,last_ms:bigint,h1:boolean,h4:boolean,m15:boolean,equal:boolean,recent:boolean,consolidation:boolean>>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once."""
    return F.transform(F.array(value), f)[0]


def available_pivots(pivots: DataFrame, bars: DataFrame, lookback: int = 30, newest: int = 80) -> DataFrame:
    """`bars` with `pivots`, an array of those confirmed at or before the bar's close that lie among its last `lookback` bars.

    Of more than `newest` confirmed ones the latest count, by confirmation, time and kind (HIGH first). The array is empty where there
    are none. `pivots` are those of these bars (symbol, start_ms, confirmed_ms, kind, price).
    """
    mine = pivots.groupBy("symbol", "start_ms").agg(F.sort_array(F.collect_list(F.struct("start_ms", "confirmed_ms", "kind", "price"))).alias("__of"))
    seen = F.flatten(F.collect_list("__of").over(by_key().rowsBetween(1 - lookback, 0)))
    got = bars.join(mine, ["symbol", "start_ms"], "left").withColumn("__seen", F.filter(seen, lambda p: p.confirmed_ms <= F.col("close_ms")))
    return got.withColumn("pivots", F.slice("__seen", F.greatest(F.lit(1), F.size("__seen") - newest + 1), newest)).drop("__of", "__seen")


def spaced(found: Column, least: int = MIN_BARS) -> Column:
    """Pivots (struct with i) in order, without those that lie fewer than `least` bars after the last one kept."""
    none = F.filter(found, lambda p: F.lit(False))
    return F.aggregate(found, none, lambda acc, p: F.when((F.size(acc) > 0) & (p.i - F.element_at(acc, -1).i < least), acc).otherwise(F.array_append(acc, p)))


def alternating(found: Column) -> Column:
    """Runs of one kind as their most extreme pivot, the earliest of equals."""

    def add(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (last.kind == p.kind)
        beyond = F.when(p.kind == "HIGH", p.price > last.price).otherwise(p.price < last.price)
        return F.when(~same, F.array_append(acc, p)).when(beyond, F.array_append(F.slice(acc, 1, F.size(acc) - 1), p)).otherwise(acc)

    return F.aggregate(found, F.filter(found, lambda p: F.lit(False)), add)


def marked(bars: DataFrame) -> DataFrame:
    """`bars` (symbol, start_ms, open, high, low, close) with number i, atr and `pivot` (i, start_ms, kind, price), null where a bar is none.

    A pivot's high (low) is strictly beyond that of two bars on either side by PROMINENCE of its bar's ATR; a bar that is both is neither.
    """
    w = by_key()
    around = lambda c: [f(c, k).over(w) for f in (F.lag, F.lead) for k in (1, 2)]
    df = simple_dmi(bars).withColumns({"i": F.row_number().over(w), "__h": F.greatest(*around("high")), "__l": F.least(*around("low"))})
    need = PROMINENCE * F.col("atr")
    # The greatest of some neighbours passes over those that are not there yet.
    four = F.lag("high", 2).over(w).isNotNull() & F.lead("high", 2).over(w).isNotNull()
    top = four & (F.col("high") > F.col("__h")) & (F.col("high") - F.col("__h") + 1e-12 >= need)
    low = four & (F.col("low") < F.col("__l")) & (F.col("__l") - F.col("low") + 1e-12 >= need)
    one = lambda kind, c: F.struct("i", "start_ms", F.lit(kind).alias("kind"), F.col(c).alias("price"))
    return df.withColumn("pivot", F.when(top & ~low, one("HIGH", "high")).when(low & ~top, one("LOW", "low"))).drop("__h", "__l")


def frame_pivots(bars: DataFrame, lookback: int) -> DataFrame:
    """`bars` with i, atr and `pivots`: those of `marked` that a bar's last `lookback` bars show, spaced and alternating, oldest first.

    None are given while one of these bars has no ATR above 0.
    """
    w = by_key()
    df = marked(bars)
    # The two bars on either side have to be among those looked at, so a pivot may stand from the third to the third last.
    seen = F.collect_list("pivot").over(w.rowsBetween(3 - lookback, -2))
    ready = F.count(F.when(F.col("atr") > 0, 1)).over(last_rows(lookback)) == F.count(F.lit(1)).over(last_rows(lookback))
    df = df.withColumns({"__seen": seen, "__ready": ready})
    return df.withColumn("pivots", alternating(spaced(F.filter("__seen", lambda p: F.col("__ready"))))).drop("pivot", "__seen", "__ready")


def evidence(bars: DataFrame, recent: int = 9, fine_recent: int = 39) -> DataFrame:
    """(symbol, at_ms, close, atr, evidence) at the close of each H1 bar out of `bars` of the widths of WIDTH (column width).

    Pivots of H1, H4 and M15, extremes of the `recent` H1 bars and the `fine_recent` M15 bars before the newest (0: none), and the bounds of the last
    CONSOLIDATION H1 bars where they span NARROWEST to WIDEST ATR. H4 and M15 are as of the last bar closed at the observation. One without 30 H1,
    2 H4 and 40 M15 closed bars, or without an ATR above 0, has no row. `seq` is the order of building; `strength` is that of research with a point
    for H1 pivots in the last ten bars, `weight` that without it. Nulls in prices are left out by `cluster` and `merge_nearest`.
    """
    seen = {f: frame_pivots(bars.where(F.col("width") == w), LOOKBACK[f]) for f, w in WIDTH.items()}
    before = lambda n: by_key().rowsBetween(-n, -1)
    # The earliest of equal extremes.
    high = lambda n: F.max(F.struct("high", -F.col("start_ms"))).over(before(n))
    low = lambda n: F.min(F.struct("low", "start_ms")).over(before(n))
    last = last_rows(CONSOLIDATION)
    tenth = F.lag("start_ms", 9).over(by_key())
    h1 = seen["H1"].select(
        "symbol", "start_ms", F.col("close_ms").alias("at_ms"), "close", "atr", F.col("i").alias("n_H1"), F.col("pivots").alias("p_H1"), high(recent).alias("top"), low(recent).alias("bottom"),
        F.max("high").over(last).alias("ceiling"), F.min("low").over(last).alias("floor"), tenth.alias("cutoff"),
    )
    fine = [high(fine_recent).alias("top"), low(fine_recent).alias("bottom")] if fine_recent else []
    for frame, more in (("H4", []), ("M15", fine)):
        right = seen[frame].select("symbol", F.col("close_ms").alias(f"t_{frame}"), F.struct("i", "pivots", *more).alias(frame))
        h1 = asof_backward(h1, right, "symbol", "at_ms", f"t_{frame}", [frame]).withColumnRenamed(f"asof_{frame}", frame).drop(f"asof_t_{frame}")
    h1 = h1.where((F.col("n_H1") >= LOOKBACK["H1"]) & (F.col("M15.i") >= LOOKBACK["M15"]) & (F.col("H4.i") >= 2) & (F.col("atr") > 0))

    def item(kind, price, at, frame, source, strength, weight=None):
        price, at = (F.col(c) if isinstance(c, str) else c for c in (price, at))
        strength = strength if isinstance(strength, Column) else F.lit(strength)
        return F.struct(F.lit(0).alias("seq"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), price.cast("double").alias("price"), at.cast("long").alias("at_ms"), F.lit(frame).alias("frame"), (source if isinstance(source, Column) else F.lit(source)).alias("source"), strength.alias("strength"), (strength if weight is None else F.lit(weight)).alias("weight"))

    def pivots(column, frame):
        boost = (lambda p: F.when(p.start_ms >= F.col("cutoff"), 1).otherwise(0)) if frame == "H1" else lambda p: F.lit(0)
        return F.transform(column, lambda p: item(p.kind, p.price, p.start_ms, frame, F.concat(F.lit(f"CONFIRMED_{frame}_PIVOT_"), p.kind), STRENGTH[frame] + boost(p), STRENGTH[frame]))

    parts = [pivots(F.col("p_H1"), "H1"), pivots(F.col("H4.pivots"), "H4"), pivots(F.col("M15.pivots"), "M15")]
    parts.append(F.array(item("HIGH", "top.high", -F.col("top.col2"), "H1", "RECENT_H1_HIGH", 2), item("LOW", "bottom.low", "bottom.start_ms", "H1", "RECENT_H1_LOW", 2)))
    if fine_recent:
        parts.append(F.array(item("HIGH", "M15.top.high", -F.col("M15.top.col2"), "M15", "RECENT_M15_HIGH", 1), item("LOW", "M15.bottom.low", "M15.bottom.start_ms", "M15", "RECENT_M15_LOW", 1)))
    span = F.col("ceiling") - F.col("floor")
    held = (span >= NARROWEST * F.col("atr")) & (span <= WIDEST * F.col("atr"))
    bounds = F.array(item("HIGH", "ceiling", "start_ms", "H1", "H1_CONSOLIDATION_RESISTANCE", 2), item("LOW", "floor", "start_ms", "H1", "H1_CONSOLIDATION_SUPPORT", 2))
    parts.append(F.filter(bounds, lambda e: held))
    numbered = F.transform(F.concat(*parts), lambda e, k: e.withField("seq", k))
    return h1.select("symbol", "at_ms", "close", "atr", numbered.cast(EVIDENCE).alias("evidence"))


def heads(prices: Column, width: Column) -> Column:
    """For ascending prices the first price of each one's group; a group ends before a price over `width` above its first."""
    start = F.struct(F.lit(None).cast("double").alias("head"), F.array().cast("array<double>").alias("all"))

    def step(acc: Column, p: Column) -> Column:
        head = F.when(p - acc.head <= width, acc.head).otherwise(p)
        return F.struct(head.alias("head"), F.array_append(acc["all"], head).alias("all"))

    return F.aggregate(prices, start, step, lambda acc: acc["all"])


def cluster(evidence: Column, atr: Column, point: float = 0.01) -> Column:
    """Zones (ZONES) of evidence (EVIDENCE) by price and kind: a group takes what lies within MERGE of ATR above its first price.

    The price is weighted by strength (1 at least), touches are distinct times, strength is that of the strongest with up to two points for touches, 5 at
    most. Two touches within EQUAL of ATR add EQUAL_HIGH or EQUAL_LOW to the sources. Major: strength 3, two touches or an H4 level. Null
    prices, and unordered or NaN ones, are left out; no ATR above 0 gives no zones. The order of equal prices changes nothing but float rounding: time, then source.
    """
    width, equal = F.greatest(F.lit(point), MERGE * atr), F.greatest(F.lit(point), EQUAL * atr)

    def of_kind(kind: str) -> Column:
        mine = F.filter(evidence, lambda e: (e.kind == kind) & e.price.isNotNull() & ~F.isnan(e.price))
        ordered = F.array_sort(F.transform(mine, lambda e: F.struct(e.price.alias("price"), e.at_ms.alias("at_ms"), e.source.alias("source"), e.frame.alias("frame"), e.strength.alias("strength"), F.greatest(F.lit(1), e.strength).alias("w"))))

        def zone(g: Column) -> Column:
            total = F.aggregate(g, F.lit(0.0), lambda a, e: a + e.price * e.w)
            weight = F.aggregate(g, F.lit(0), lambda a, e: a + e.w)
            times = F.array_distinct(F.transform(g, lambda e: e.at_ms))
            touches = F.size(times)
            level = (touches >= 2) & (F.element_at(g, -1).price - g[0].price <= equal)
            names = F.transform(g, lambda e: e.source)
            strength = F.least(F.lit(5), F.array_max(F.transform(g, lambda e: e.strength)) + F.least(F.lit(2), touches - 1))
            return F.struct(
                F.lit(kind).alias("kind"), (total / weight).alias("price"), touches.alias("touches"), strength.alias("strength"), ((strength >= 3) | (touches >= 2) | F.exists(g, lambda e: e.frame == "H4")).alias("major"),
                F.array_sort(F.array_distinct(F.when(level, F.array_append(names, F.lit(f"EQUAL_{kind}"))).otherwise(names))).alias("sources"), F.array_min(times).alias("first_ms"), F.array_max(times).alias("last_ms"),
            )

        def grouped(items: Column) -> Column:
            marked = F.arrays_zip(items.alias("e"), heads(F.transform(items, lambda e: e.price), width).alias("head"))
            return let(marked, lambda m: F.transform(F.array_distinct(F.transform(m, lambda x: x["head"])), lambda h: zone(F.transform(F.filter(m, lambda x: x["head"] == h), lambda x: x["e"]))))

        return let(ordered, grouped)

    both = F.concat(of_kind("HIGH"), of_kind("LOW"))
    by_price = F.transform(F.array_sort(F.transform(both, lambda z: F.struct(z.price.alias("price"), z.kind.alias("kind"), z.alias("z")))), lambda x: x.z)
    return F.when(atr > 0, by_price).otherwise(F.filter(both, lambda z: F.lit(False))).cast(ZONES)


def merge_nearest(evidence: Column, atr: Column, point: float = 0.01, signed: bool = False) -> Column:
    """Zones (MERGED) in order of making: each piece of evidence, by seq, joins the nearest zone of its kind within MERGE of ATR and moves its price.

    The zone made first wins a tie of distances. A zone's price is the mean weighted by `weight`; a time that is neither its first nor its last counts as a
    touch, and within EQUAL of ATR of the price before as an equal level. Evidence without a price above 0, a time above 0, a weight of 1 or a known kind is left out; no ATR above 0 gives no zones.
    `signed` is for values that may be 0 or less; then any finite price counts.
    """
    reach, equal = F.greatest(F.lit(point), MERGE * atr) + 1e-9, F.greatest(F.lit(point), EQUAL * atr) + 1e-9
    valid = F.filter(evidence, lambda e: e.kind.isin("HIGH", "LOW") & (e.price > float("-inf") if signed else e.price > 0) & ~F.isnan(e.price) & (e.price < float("inf")) & (e.at_ms > 0) & (e.weight >= 1) & (atr > 0))
    ordered = F.transform(F.array_sort(F.transform(valid, lambda e: F.struct(e.seq.alias("seq"), e.alias("e")))), lambda x: x.e)
    flags = lambda e: {"h1": (e.frame == "H1") & e.source.contains("PIVOT"), "h4": (e.frame == "H4") & e.source.contains("PIVOT"), "m15": (e.frame == "M15") & e.source.contains("PIVOT")}
    more = lambda e: {"recent": e.source.startswith("RECENT_H1"), "consolidation": e.source.contains("CONSOLIDATION")}

    def made(e: Column) -> Column:
        f = flags(e) | {"equal": F.lit(False)} | more(e)
        return F.struct(e.kind.alias("kind"), e.price.alias("price"), e.weight.cast("long").alias("weight"), F.lit(1).alias("evidence"), F.lit(1).alias("touches"), e.at_ms.alias("first_ms"), e.at_ms.alias("last_ms"), *(c.alias(n) for n, c in f.items()))

    def moved(z: Column, e: Column) -> Column:
        new = (e.at_ms != z.first_ms) & (e.at_ms != z.last_ms)
        f = {n: z[n] | c for n, c in flags(e).items()} | {"equal": z.equal | (new & (F.abs(z.price - e.price) <= equal))} | {n: z[n] | c for n, c in more(e).items()}
        return F.struct(
            z.kind.alias("kind"), ((z.price * z.weight + e.price * e.weight) / (z.weight + e.weight)).alias("price"), (z.weight + e.weight).alias("weight"), (z.evidence + 1).alias("evidence"), (z.touches + new.cast("int")).alias("touches"),
            F.least(z.first_ms, e.at_ms).alias("first_ms"), F.greatest(z.last_ms, e.at_ms).alias("last_ms"), *(c.alias(n) for n, c in f.items()),
        )

    def add(acc: Column, e: Column) -> Column:
        away = F.transform(acc, lambda z: F.when(z.kind == e.kind, F.abs(z.price - e.price)))
        nearest = let(away, lambda a: F.when(F.array_min(a) <= reach, F.array_position(a, F.array_min(a)) - 1))
        put = lambda k: F.when(k.isNull(), F.array_append(acc, made(e))).otherwise(F.transform(acc, lambda z, n: F.when(n == k, moved(z, e)).otherwise(z)))
        return let(nearest, put)

    return F.aggregate(ordered, F.array().cast(MERGED), lambda acc, e: add(acc, e).cast(MERGED))


def confidence(z: Column) -> Column:
    """HIGH, MEDIUM or LOW of a zone of `merge_nearest`."""
    return F.when(z.h4 | z.equal | (z.touches >= 2) | (z.h1 & z.m15), "HIGH").when(z.h1 | z.recent | z.consolidation, "MEDIUM").otherwise("LOW")
