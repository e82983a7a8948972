"""Window features and recursive indicators over bars.

`prior` frames exclude the current row; counts guard short frames, which give null. Recursive indicators are affine
recurrences x[t] = a[t] * x[t-1] + b[t]: they are run chunk by chunk of time, in parallel, with each chunk's total effect
composed first, so no series has to fit into one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import clamp, ratio

KEY, ORDER = "symbol", "start_ms"


def by_key(key: str = KEY, order: str = ORDER):
    return Window.partitionBy(key).orderBy(order)


def last_rows(n: int):
    """Frame of the current row and the n - 1 before."""
    return by_key().rowsBetween(1 - n, 0)


def prior_rows(n: int):
    return by_key().rowsBetween(-n, -1)


def full(value: Column, counted: Column, n: int, frame) -> Column:
    """`value` where the frame holds n rows."""
    return F.when(F.count(counted).over(frame) >= n, value)


def prior_extremes(bars: DataFrame, n: int = 20) -> DataFrame:
    frame = prior_rows(n)
    return bars.withColumns({"prior_high": F.max("high").over(frame), "prior_low": F.min("low").over(frame)})


def volume_ratio(df: DataFrame, volume: str, n: int = 20) -> DataFrame:
    frame = prior_rows(n)
    mean = full(F.avg(volume).over(frame), F.col(volume), n, frame)
    return df.withColumns({"volume_ratio": ratio(F.col(volume), mean), "volume_confirms": F.col(volume) >= mean * 1.05})


def past_rank(df: DataFrame, value: str, most: int = 101, least: int = 30) -> DataFrame:
    """Share of up to `most` earlier values that are not above the current one; null with fewer than `least`."""
    past = F.collect_list(value).over(prior_rows(most))
    share = F.size(F.filter(past, lambda x: x <= F.col(value))) / F.size(past)
    return df.withColumn("past_rank", F.when(F.size(past) >= least, share))


def range_position(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 30)) -> DataFrame:
    out = {}
    for n in windows:
        frame = last_rows(n)
        low, high = F.min("low").over(frame), F.max("high").over(frame)
        out[f"position_{n}"] = full(clamp(ratio(F.col("close") - low, high - low), 0.0, 1.0), F.col("close"), n, frame)
    return bars.withColumns(out)


def efficiency(bars: DataFrame, n: int = 10) -> DataFrame:
    """Net move over n bars by the sum of moves, and the population deviation of n log returns."""
    step = bars.withColumn("move", F.col("close") - F.lag("close").over(by_key())).withColumn("log_ret", F.when((F.col("close") > 0) & (F.lag("close").over(by_key()) > 0), F.ln(F.col("close") / F.lag("close").over(by_key()))))
    frame = last_rows(n)
    return step.withColumns(
        {
            "efficiency": full(ratio(F.abs(F.col("close") - F.lag("close", n).over(by_key())), F.sum(F.abs("move")).over(frame)), F.col("move"), n, frame),
            "realised_vol": full(F.stddev_pop("log_ret").over(frame), F.col("log_ret"), n, frame),
        }
    )


def true_range() -> Column:
    prev = F.lag("close").over(by_key())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def moves(bars: DataFrame) -> DataFrame:
    """True range and directional moves against the bar before; the first bar's range is high - low and it has no moves."""
    up, down = F.col("high") - F.lag("high").over(by_key()), F.lag("low").over(by_key()) - F.col("low")
    return bars.withColumns({"tr": true_range(), "plus_dm": F.when((up > down) & (up > 0), up).otherwise(0.0), "minus_dm": F.when((down > up) & (down > 0), down).otherwise(0.0)})


def simple_dmi(bars: DataFrame, n: int = 14) -> DataFrame:
    """ATR as a plain mean and unsmoothed directional indices over n bars that have one before."""
    frame = last_rows(n)
    df = moves(bars).withColumn("i", F.row_number().over(by_key()))
    tr = F.sum("tr").over(frame)
    ready = F.col("i") > n
    df = df.withColumns({"atr": F.when(ready, tr / n), "plus_di": F.when(ready, ratio(100 * F.sum("plus_dm").over(frame), tr)), "minus_di": F.when(ready, ratio(100 * F.sum("minus_dm").over(frame), tr))})
    return df.withColumn("dx", ratio(100 * F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di"))).drop("i")


def returns(bars: DataFrame) -> DataFrame:
    """Moves over 1, 3 and 5 bars, and by how much the last exceeds a third of the three-bar move."""
    r = {f"r{k}": F.col("close") - F.lag("close", k).over(by_key()) for k in (1, 3, 5)}
    return bars.withColumns(r).withColumn("acceleration", F.col("r1") - F.col("r3") / 3)


def behaviour(bars: DataFrame, windows: tuple[int, ...] = (30, 10, 5, 3)) -> DataFrame:
    """Per window: least-squares slope of the close, net displacement and share of rising candles."""
    df = bars.withColumn("i", F.row_number().over(by_key()).cast("double"))
    out = {}
    for n in windows:
        frame = last_rows(n)
        out[f"slope_{n}"] = full(F.regr_slope("close", "i").over(frame), F.col("close"), n, frame)
        out[f"net_{n}"] = full(F.col("close") - F.first("close").over(frame), F.col("close"), n, frame)
        out[f"rising_{n}"] = full(F.avg((F.col("close") > F.col("open")).cast("double")).over(frame), F.col("close"), n, frame)
    return df.withColumns(out).drop("i")


def affine_scan(df: DataFrame, scans: dict[str, tuple[Column, Column]], width: int, key: str = KEY, order: str = ORDER) -> DataFrame:
    """`df` with, for each name -> (a, b), x = a * x_before + b along `order` for each key; a null b gives null and starts anew.

    Runs over (key, chunk) groups, where a chunk spans `width` of `order`: first each chunk's effect on what enters it,
    then what enters each chunk (one row a chunk), then the chunks themselves. All names go through one pass.
    """
    names = list(scans)
    coeffs = {f"__{x}_{n}": scans[n][k] for n in names for k, x in enumerate("ab")}
    df = df.withColumns(coeffs).withColumn("__chunk", F.floor(F.col(order) / width))
    schema = df.schema

    def fold(a, b, x):
        out = []
        for m, y in zip(a, b):
            x = float("nan") if y != y else (y if m == 0 else m * x + y)
            out.append(x)
        return out, x

    def values(pdf: pd.DataFrame, n: str):
        return pdf[f"__a_{n}"].to_numpy("float64"), pdf[f"__b_{n}"].to_numpy("float64")

    def effect(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        row = {key: pdf[key].iloc[0], "__chunk": pdf["__chunk"].iloc[0]}
        for n in names:
            scale, shift = 1.0, 0.0
            for m, y in zip(*values(pdf, n)):
                scale, shift = (0.0, float("nan")) if y != y else (scale * m, y if m == 0 else m * shift + y)
            row |= {f"scale_{n}": scale, f"shift_{n}": shift}
        return pd.DataFrame([row])

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__chunk")
        out = pdf[[key, "__chunk"]].copy()
        for n in names:
            entering, last = fold(pdf[f"scale_{n}"], pdf[f"shift_{n}"], 0.0)
            out[f"enter_{n}"] = [0.0, *entering[:-1]]
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        for n in names:
            pdf[n] = fold(*values(pdf, n), pdf[f"enter_{n}"].iloc[0])[0]
        return pdf[[*kept, *names]]

    kinds = {f.name: f.dataType.simpleString() for f in schema}
    kept = [c for c in kinds if not c.startswith("__")]
    head = f"`{key}` {kinds[key]}, __chunk {kinds['__chunk']}"
    effects = df.select(key, "__chunk", order, *coeffs).groupBy(key, "__chunk").applyInPandas(effect, head + "".join(f", scale_{n} double, shift_{n} double" for n in names))
    entering = effects.groupBy(key).applyInPandas(enter, head + "".join(f", enter_{n} double" for n in names))
    result = df.join(entering, [key, "__chunk"]).groupBy(key, "__chunk").applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + "".join(f", {n} double" for n in names))
    return result.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


#: Bars of a chunk span so many ms by default: 30 days.
CHUNK = 30 * 86_400_000


def numbered(df: DataFrame) -> DataFrame:
    """`df` with `n_bar`, the number of the bar from 1, which the seeds of recurrences need."""
    return df.withColumn("n_bar", F.row_number().over(by_key()))


def seeded(value: str, n: int, rate: float, gain: float, summed: bool = False, skip: int = 0) -> tuple[Column, Column]:
    """Coefficients of x = rate * x + gain * value that starts with the mean (or sum) of n values after `skip` bars."""
    i, frame = F.col("n_bar") - skip, last_rows(n)
    seed = F.sum(value).over(frame) if summed else F.avg(value).over(frame)
    return F.when(i <= n, 0.0).otherwise(rate), F.when(i == n, seed).when(i > n, gain * F.col(value))


def ema_scan(n: int, value: str = "close", sma_seed: bool = True) -> tuple[Column, Column]:
    """Exponential average of rate 2 / (n + 1), seeded with the mean of the first n values or with the first value."""
    return seeded(value, n if sma_seed else 1, 1 - 2 / (n + 1), 2 / (n + 1))


def wilder_scan(value: str, n: int, summed: bool = False, skip: int = 0) -> tuple[Column, Column]:
    """Wilder's smoothing: mean form x - x/n + v/n, or sum form x - x/n + v."""
    return seeded(value, n, 1 - 1 / n, 1.0 if summed else 1 / n, summed, skip)


def ema(bars: DataFrame, n: int, out: str = "ema", sma_seed: bool = True, width: int = CHUNK) -> DataFrame:
    return affine_scan(numbered(bars), {out: ema_scan(n, sma_seed=sma_seed)}, width).drop("n_bar")


def gains(bars: DataFrame) -> DataFrame:
    move = F.coalesce(F.col("close") - F.lag("close").over(by_key()), F.lit(0.0))
    return bars.withColumns({"gain": F.greatest(move, F.lit(0.0)), "loss": F.greatest(-move, F.lit(0.0))})


def rsi_of(gain: str, loss: str, flat: float = 50.0) -> Column:
    """100 without losses, `flat` without moves."""
    g, l = F.col(gain), F.col(loss)
    return F.when(l == 0, F.when(g == 0, flat).otherwise(100.0)).otherwise(100 - 100 / (1 + g / l))


def rsi(bars: DataFrame, n: int = 14, width: int = CHUNK) -> DataFrame:
    """Relative strength from the n-th move on."""
    df = affine_scan(numbered(gains(bars)), {f"s_{v}": wilder_scan(v, n, skip=1) for v in ("gain", "loss")}, width)
    return df.withColumn("rsi", rsi_of("s_gain", "s_loss")).drop("n_bar", "gain", "loss", "s_gain", "s_loss")


def indicators(bars: DataFrame, n: int = 14, average: int = 20, width: int = CHUNK) -> DataFrame:
    """EMA, RSI, Wilder's ATR (mean form of the summed range), directional indices and ADX, in two passes."""
    df = numbered(gains(moves(bars)))
    scans = {"ema": ema_scan(average)} | {f"s_{v}": wilder_scan(v, n, skip=1) for v in ("gain", "loss")} | {f"s_{v}": wilder_scan(v, n, summed=True) for v in ("tr", "plus_dm", "minus_dm")}
    df = affine_scan(df, scans, width).withColumn("rsi", rsi_of("s_gain", "s_loss"))
    df = df.withColumns({"atr": F.col("s_tr") / n, "plus_di": ratio(100 * F.col("s_plus_dm"), F.col("s_tr")), "minus_di": ratio(100 * F.col("s_minus_dm"), F.col("s_tr"))})
    df = df.withColumn("dx", F.when(F.col("s_tr").isNotNull(), F.coalesce(ratio(100 * F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")), F.lit(0.0))))
    return affine_scan(df, {"adx": wilder_scan("dx", n, skip=n - 1)}, width).drop("n_bar", "gain", "loss", "tr", "plus_dm", "minus_dm", *scans.keys() - {"ema"})


def crosses(bars: DataFrame, fast: str, slow: str) -> Column:
    """UP or DOWN where `fast` has crossed `slow` since the bar before."""
    now, before = F.col(fast) - F.col(slow), F.lag(F.col(fast) - F.col(slow)).over(by_key())
    return F.when((before <= 0) & (now > 0), "UP").when((before >= 0) & (now < 0), "DOWN").otherwise("NONE")


def breakout(level_high: Column, level_low: Column, buffer: Column) -> Column:
    """LONG where the close crosses above the level and a buffer, SHORT where it crosses below."""
    close, before = F.col("close"), F.lag("close").over(by_key())
    up = (before <= level_high + buffer) & (close > level_high + buffer)
    down = (before >= level_low - buffer) & (close < level_low - buffer)
    return F.when(up, "LONG").when(down, "SHORT").otherwise("NONE")
