"""Flags, pennants, triangles and wedges: sequences of alternating pivots, and the first later close that decides each one.

A sequence is read from the pivot's next rows; it meets the few bars after it by their numbers, so no pattern is paired with a stretch
of its symbol. Falling patterns are handled as rising ones of mirrored prices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import SPREAD
from tidemark.operators.indicators import by_key
from tidemark.operators.levels import let, marked


# Fixed values of both: bars until a pattern expires, buffers and body as shares of ATR, volume looked at.
@dataclass(frozen=True)
class Continuation:
    pole_atr: float = 3.0
    pole_bars: tuple[int, int] = (2, 24)
    efficiency: float = 0.60
    retracement: tuple[float, float] = (0.10, 0.60)
    bars: tuple[int, int] = (4, 24)
    wait: int = 12
    move_atr: float = 0.20
    parallel: float = 0.50
    width_tolerance: float = 0.50
    pennant_width: float = 0.75
    balance: float = 0.25
    breakout_atr: float = 0.05
    invalid_atr: float = 0.20
    volume: float = 1.05
    body_atr: float = 0.50


@dataclass(frozen=True)
class Convergence:
    bars: tuple[int, int] = (8, 72)
    wait: int = 12
    level: float = 0.03
    slope: float = 0.05
    separation: float = 0.02
    width: float = 0.80
    fit_atr: float = 0.25
    before_apex: int = 1
    breakout_before_apex: int = 2
    apex_share: float = 2.0
    breakout_atr: float = 0.05
    volume: float = 1.05
    body_atr: float = 0.50


VOLUME_BARS = 20


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def per(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def nearness(value: Column, bounds: tuple[float, float], least_half: float = 0.0) -> Column:
    """1 in the middle of the bounds, 0 at and beyond them."""
    half = max(least_half, (bounds[1] - bounds[0]) / 2)
    return unit(1 - F.abs(value - (bounds[0] + bounds[1]) / 2) / half)


def series(bars: DataFrame) -> DataFrame:
    """`bars` (symbol, start_ms, close_ms, open, high, low, close, ticks) with i, atr, pivot, path (exact sum of the closes' steps so far), mean_ticks (of up to
    VOLUME_BARS before that have ticks) and confirmed_ms, the close of the second bar after."""
    w = by_key()
    df = marked(bars)
    step = F.abs(F.col("close") - F.lag("close").over(w)).cast(SPREAD)
    path = F.coalesce(F.sum(F.col("step")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0).cast(SPREAD))
    mean = F.avg(F.when(F.col("ticks") > 0, F.col("ticks"))).over(w.rowsBetween(-VOLUME_BARS, -1))
    return df.withColumn("step", step).withColumns({"path": path, "mean_ticks": mean, "confirmed_ms": F.lead("close_ms", 2).over(w)}).drop("step")


def alternating_pivots(rows: DataFrame) -> DataFrame:
    """(symbol, i, p) out of `series`: pivots of a symbol's whole series, at least two bars apart, runs of one kind as their most extreme (the earliest of equals).

    A run that still grows may change its pivot later; the identities are those of the finished runs. p holds i, start_ms, kind, price, atr, close, path, confirmed_ms.
    """
    p = rows.where("pivot IS NOT NULL").select("symbol", "i", F.struct("i", "start_ms", "pivot.kind", "pivot.price", "atr", "close", "path", "confirmed_ms").alias("p"))
    w = Window.partitionBy("symbol").orderBy("i")
    # Only neighbours are too near: of a row of neighbouring bars each second one goes.
    p = p.withColumn("island", F.col("i") - F.row_number().over(w)).withColumn("at", F.row_number().over(Window.partitionBy("symbol", "island").orderBy("i"))).where("at % 2 = 1")
    p = p.withColumn("new", (~F.col("p.kind").eqNullSafe(F.lag("p.kind").over(w))).cast("int")).withColumn("run", F.sum("new").over(w))
    extreme = F.struct(F.when(F.col("p.kind") == "HIGH", F.col("p.price")).otherwise(-F.col("p.price")), -F.col("i"))
    return p.groupBy("symbol", "run").agg(F.max_by("p", extreme).alias("p")).select("symbol", F.col("p.i").alias("i"), "p")


def sequences(pivots: DataFrame, n: int) -> DataFrame:
    """(symbol, s): each n pivots that follow one another."""
    w = Window.partitionBy("symbol").orderBy("i")
    s = F.array(*(F.lead("p", k).over(w) for k in range(n)))
    return pivots.select("symbol", s.alias("s")).where(F.col("s")[n - 1].isNotNull())


def decided(found: DataFrame, rows: DataFrame, wait: int, event: Column) -> DataFrame:
    """`found` (symbol, i, end_i, ...) with e, the first non-null `event` (struct with state first) of the next wait + 1 bars (b, k bars after the end); null if none yet."""
    reach = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(wait + 1)))).withColumn("j", F.col("end_i") + F.col("k"))
    b = rows.select(F.col("symbol").alias("__symbol"), F.col("i").alias("__i"), F.struct("start_ms", "open", "close", "ticks", "mean_ticks").alias("b"))
    met = reach.join(b, (F.col("symbol") == F.col("__symbol")) & (F.col("j") == F.col("__i")), "left")
    first = F.min(F.when(F.col("b").isNotNull() & event.state.isNotNull(), F.struct("k", event.alias("e"))))
    return met.groupBy("symbol", "i", "end_i").agg(F.first(F.struct(*found.columns)).alias("f"), first.alias("e")).select("f.*", F.col("e.e").alias("e"), F.col("e.k").alias("bars_after"))


def finished(df: DataFrame, quality: Column, volume: float, body: float) -> DataFrame:
    """Common columns, with quality of 0 to 100 and `newest`: whether a pattern is its symbol's last."""
    q = quality + F.when(F.col("e.volume"), 1).otherwise(0) * volume + F.when(F.col("e.momentum"), 1).otherwise(0) * body
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("i"))) == 1
    return df.select(
        "symbol", "pattern", F.col("s")[0].start_ms.alias("first_ms"), F.element_at("s", -1).start_ms.alias("end_ms"), F.element_at("s", -1).confirmed_ms.alias("known_ms"), F.coalesce("e.state", F.lit("CANDIDATE")).alias("state"),
        F.col("e.event_ms").alias("event_ms"), F.col("e.side").alias("side"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), q)).alias("quality"), newest.alias("newest"),
    )


def outcome(state: Column, side: Column, strength: Column, atr: Column, volume: float, body_atr: float) -> Column:
    """Event of bar b; volume and body count for a confirmation alone."""
    sure = state == "CONFIRMED"
    return F.struct(
        state.alias("state"), F.col("b.start_ms").alias("event_ms"), side.alias("side"), F.when(sure, strength).alias("strength"), (sure & (F.col("b.ticks") >= F.col("b.mean_ticks") * volume)).alias("volume"),
        (sure & (side * (F.col("b.close") - F.col("b.open")) >= body_atr * atr)).alias("momentum"),
    )


def fitted(points: Column) -> Column:
    """(slope, cut, rms) of the least-squares line through points (x, y); nulls where fewer than three."""
    total = lambda f: F.aggregate(points, F.lit(0.0), lambda a, p: a + f(p))
    n = F.size(points)

    def about(m: Column) -> Column:
        slope = per(total(lambda p: (p.x - m.x) * (p.y - m.y)), total(lambda p: (p.x - m.x) * (p.x - m.x)))
        return let(slope, lambda a: let(m.y - a * m.x, lambda b: F.struct(a.alias("slope"), b.alias("cut"), F.sqrt(total(lambda p: (p.y - a * p.x - b) * (p.y - a * p.x - b)) / n).alias("rms"))))

    return F.when(n >= 3, let(F.struct((total(lambda p: p.x) / n).alias("x"), (total(lambda p: p.y) / n).alias("y")), about))


def continuation(bars: DataFrame, config: Continuation | None = None) -> DataFrame:
    """Flags and pennants: a pole between two pivots and three more in a channel against it or a narrowing one.

    (symbol, pattern, first_ms, end_ms, known_ms, state, event_ms, side, quality, newest). A later close beyond the line of the pole's end confirms, one beyond the other line
    invalidates; crossed lines or over `wait` bars expire; CANDIDATE while nothing has decided. Lengths are in ATR, the greatest of the five pivots'.
    """
    c = config or Continuation()
    rows = series(bars)
    df = sequences(alternating_pivots(rows), 5)
    s = F.col("s")
    df = df.withColumns({"i": s[0].i, "end_i": s[4].i, "sign": F.when(s[0].kind == "LOW", 1).otherwise(-1), "atr": F.array_max(F.transform("s", lambda p: p.atr))})
    df = df.withColumn("q", F.transform("s", lambda p: F.col("sign") * p.price))
    q, n = F.col("q"), lambda a, b: (s[b].i - s[a].i).cast("double")
    path, net = (s[1].path - s[0].path).cast("double"), F.col("sign") * (s[1].close - s[0].close)
    df = df.withColumns({"pole": q[1] - q[0], "efficiency": F.when((path > 0) & (net > 0), F.least(F.lit(1.0), net / path)).otherwise(0.0), "near": (q[3] - q[1]) / n(1, 3), "far": (q[4] - q[2]) / n(2, 4), "first_width": q[1] - q[2], "last_width": q[3] - q[4]})
    df = df.withColumns({"retraced": per(q[1] - F.least(q[2], q[4]), F.col("pole")), "narrowed": per(F.col("last_width"), F.col("first_width")), "near_move": F.abs("near") * n(1, 3), "far_move": F.abs("far") * n(2, 4)})
    flat = per(F.least(F.abs("near"), F.abs("far")), F.greatest(F.abs("near"), F.abs("far")))
    balance = per(F.least("near_move", "far_move"), F.greatest("near_move", "far_move"))
    flag = (F.col("near") < 0) & (F.col("far") < 0) & (flat >= c.parallel) & F.col("narrowed").between(1 - c.width_tolerance, 1 + c.width_tolerance)
    pennant = (F.col("near") < 0) & (F.col("far") > 0) & (F.col("narrowed") < 1) & (F.col("narrowed") <= c.pennant_width) & (balance >= c.balance)
    ok = n(0, 1).between(*c.pole_bars) & n(1, 4).between(*c.bars) & (F.col("pole") > 0) & (F.col("pole") >= c.pole_atr * F.col("atr")) & (F.col("efficiency") >= c.efficiency)
    ok &= F.col("retraced").between(*c.retracement) & (F.col("first_width") > 0) & (F.col("last_width") > 0) & (F.least("near_move", "far_move") >= c.move_atr * F.col("atr"))
    kind = F.concat(F.when(F.col("sign") > 0, "BULL_").otherwise("BEAR_"), F.when(flag, "FLAG").when(pennant, "PENNANT"))
    shape = F.when(flag, (flat + unit(1 - F.abs(F.col("narrowed") - 1) / c.width_tolerance)) / 2).otherwise((1 - F.col("narrowed") + balance) / 2)
    found = df.where(ok & (flag | pennant)).withColumns({"pattern": kind, "shape": shape})
    at = F.col("sign") * F.col("b.close")
    near, far = q[3] + F.col("near") * (F.col("j") - s[3].i), q[4] + F.col("far") * (F.col("j") - s[4].i)
    state = F.when((F.col("k") > c.wait) | (near <= far), "EXPIRED").when(at < far - c.invalid_atr * F.col("atr"), "INVALIDATED").when(at > near + c.breakout_atr * F.col("atr"), "CONFIRMED")
    out = decided(found, rows, c.wait, outcome(state, F.col("sign"), (at - near) / F.col("atr"), F.col("atr"), c.volume, c.body_atr))
    strength = unit(F.col("pole") / F.col("atr") / (2 * c.pole_atr))
    quality = 12.5 * (strength + F.col("efficiency")) + 15 * nearness(F.col("retraced"), c.retracement) + 10 * nearness(n(1, 4), c.bars, 0.5) + 25 * unit(F.col("shape")) + 15 * unit(F.coalesce("e.strength", F.lit(0.0)))
    return finished(out, quality, 5.0, 5.0)


def convergence(bars: DataFrame, config: Convergence | None = None, step: float = 0.01) -> DataFrame:
    """Triangles and wedges: lines through three highs and three lows that follow one another and draw together.

    Columns as in `continuation`. A close beyond a line confirms; against an ascending or descending triangle it invalidates. Over `wait` bars, or too near
    the apex, they expire. Lines are least-squares; slopes are in ATR a bar, the greatest ATR of the six pivots.
    """
    c = config or Convergence()
    rows = series(bars)
    df = sequences(alternating_pivots(rows), 6)
    s = F.col("s")
    of = lambda kind: F.filter("s", lambda p: p.kind == kind)
    df = df.withColumns({"i": s[0].i, "end_i": s[5].i, "span": (s[5].i - s[0].i).cast("double"), "atr": F.array_max(F.transform("s", lambda p: p.atr))})
    points = lambda kind: F.transform(F.filter("s", lambda p: p.kind == kind), lambda p: F.struct((p.i - F.col("i")).cast("double").alias("x"), p.price.alias("y")))
    df = df.withColumn("g", F.struct(fitted(points("HIGH")).alias("h"), fitted(points("LOW")).alias("l")))
    fit = c.fit_atr * F.col("atr")

    def shape(g: Column) -> Column:
        first, closing = g.h.cut - g.l.cut, g.l.slope - g.h.slope
        return F.struct(
            (g.h.slope / F.col("atr")).alias("up"), (g.l.slope / F.col("atr")).alias("low"), first.alias("first_width"), per(first - closing * F.col("span"), first).alias("width"), (per(first, closing) - F.col("span")).alias("left"),
            g.h.slope.alias("h_slope"), g.h.cut.alias("h_cut"), g.h.rms.alias("h_rms"), g.l.slope.alias("l_slope"), g.l.cut.alias("l_cut"), g.l.rms.alias("l_rms"),
        )

    def judged(v: Column) -> Column:
        apart = v.low - v.up
        kind = (
            F.when((F.abs(v.up) <= c.level) & (v.low >= c.slope), "ASCENDING_TRIANGLE").when((F.abs(v.low) <= c.level) & (v.up <= -c.slope), "DESCENDING_TRIANGLE")
            .when((v.up <= -c.slope) & (v.low >= c.slope), "SYMMETRICAL_TRIANGLE").when((v.up >= c.slope) & (v.low > v.up), "RISING_WEDGE").when((v.low <= -c.slope) & (v.up < v.low), "FALLING_WEDGE")
        )
        ok = F.col("span").between(*c.bars) & (F.greatest(v.h_rms, v.l_rms) <= fit) & (apart >= c.separation) & (v.first_width > 0) & (v.width > 0) & (v.width <= c.width) & (v.left >= c.before_apex) & (v.left <= c.apex_share * F.col("span"))
        return F.when(ok, kind)

    df = df.withColumn("v", let(F.col("g"), shape)).withColumn("pattern", let(F.col("v"), judged)).where("pattern IS NOT NULL")
    found = df.select("symbol", "s", "i", "end_i", "span", "atr", "pattern", "v.*").withColumns({"apart": F.col("low") - F.col("up"), "apex": F.col("left") + F.col("span")})
    up, low, apart = F.col("up"), F.col("low"), F.col("apart")
    x, close = (F.col("j") - F.col("i")).cast("double"), F.col("b.close")
    upper, lower, buffer = F.col("h_cut") + F.col("h_slope") * x, F.col("l_cut") + F.col("l_slope") * x, F.greatest(F.lit(step), c.breakout_atr * F.col("atr"))
    side = F.when(close > upper + buffer, 1).when(close < lower - buffer, -1)
    against = F.when(F.col("pattern") == "ASCENDING_TRIANGLE", side == -1).when(F.col("pattern") == "DESCENDING_TRIANGLE", side == 1).otherwise(F.lit(False))
    late = (F.col("k") > c.wait) | (F.col("apex") - x < c.breakout_before_apex) | (lower <= 0) | (upper <= lower)
    state = F.when(late, "EXPIRED").when(against, "INVALIDATED").when(side.isNotNull(), "CONFIRMED")
    out = decided(found, rows, c.wait, outcome(state, F.when(state != "EXPIRED", side), F.when(side > 0, close - upper).otherwise(lower - close) / F.col("atr"), F.col("atr"), c.volume, c.body_atr))
    flat = F.when(F.col("pattern") == "ASCENDING_TRIANGLE", F.abs(up)).when(F.col("pattern") == "DESCENDING_TRIANGLE", F.abs(low))
    lean = unit(F.when(F.col("pattern") == "ASCENDING_TRIANGLE", low).when(F.col("pattern") == "DESCENDING_TRIANGLE", -up).otherwise(F.least(F.abs(up), F.abs(low))) / (2 * c.slope))
    drawn = unit(apart / (2 * c.separation))
    slopes = F.when(flat.isNotNull(), (unit(1 - flat / c.level) + lean + drawn) / 3).otherwise((lean + drawn) / 2)
    lines = (unit(1 - F.col("h_rms") / fit) + unit(1 - F.col("l_rms") / fit)) / 2
    place = F.when(F.col("e.state") == "CONFIRMED", unit(1 - F.abs(F.col("bars_after") / F.col("left") - 0.65) / 0.65)).otherwise(unit(1 - F.abs(F.col("left") / F.col("span") - 0.75) / 0.75))
    quality = 20 * lines + 15 * slopes + 15 * drawn + 10 * nearness(F.col("span"), c.bars, 0.5) + 15 * unit(1 - F.col("width")) + 10 * place + 10 * unit(F.coalesce("e.strength", F.lit(0.0)))
    return finished(out, quality, 2.5, 2.5)
