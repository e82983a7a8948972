"""Queries on bars, indicators, structure and episodes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.functions import timebase as T
from tidemark.operators import bars as B
from tidemark.operators import episodes as E
from tidemark.operators import indicators as I
from tidemark.operators import joins as J
from tidemark.operators import stats as S
from tidemark.operators import structure as P
from tidemark.plans.base import TICKS, WITH, bars, bars_sql, query, r, table, ticks

W = "PARTITION BY symbol ORDER BY start_ms"
_BAR = "symbol, start_ms, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, CAST(ticks AS BIGINT) AS ticks, round(avg_spread, 6) AS avg_spread"


def _bar(df, *more):
    return df.select("symbol", "start_ms", r("open"), r("high"), r("low"), r("close"), "ticks", r("avg_spread"), *more)


for _name, _width in (("1h", T.HOUR), ("4h", 4 * T.HOUR), ("1d", T.DAY)):
    query(f"WITH {TICKS}, {bars_sql(_width)} SELECT {_BAR} FROM bars", f"ohlc_bars_{_name}")(lambda s, d, w=_width: _bar(bars(s, d, w)))


@query(
    f"WITH {TICKS}, {bars_sql(T.HOUR, 'a')}, {bars_sql(4 * T.HOUR, 'b')}, {bars_sql(T.DAY, 'c')} "
    + " UNION ALL ".join(f"SELECT {_BAR}, CAST({w} AS BIGINT) AS width FROM {n}" for n, w in (("a", T.HOUR), ("b", 4 * T.HOUR), ("c", T.DAY)))
)
def ohlc_multi_timeframe(s, d):
    return _bar(B.build_bars(ticks(s, d), [T.HOUR, 4 * T.HOUR, T.DAY]), F.col("width").cast("long").alias("width"))


def _roll_sql(width, boundary=0):
    return f"""{WITH} SELECT symbol, start_ms - (start_ms - {boundary}) % {width} AS begin_ms, round(arg_min(open, start_ms), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low,
 round(arg_max(close, start_ms), 6) AS close, CAST(sum(ticks) AS BIGINT) AS ticks, round(CAST(sum(spread_sum) AS DOUBLE) / sum(ticks), 6) AS avg_spread, count(*) AS observed,
 CAST({width // T.HOUR} AS BIGINT) AS expected, round(count(*) / {width // T.HOUR}.0, 6) AS coverage, count(*) = {width // T.HOUR} AS complete,
 greatest(max(close_ms), min(start_ms) - (min(start_ms) - {boundary}) % {width} + {width}) AS available_ms, array_to_string(list(start_ms ORDER BY start_ms), ',') AS sources
FROM bars GROUP BY 1, 2"""


def _roll(s, d, width, boundary=0):
    df = B.roll_up(bars(s, d), width, boundary)
    return df.select(
        "symbol", "begin_ms", r("open"), r("high"), r("low"), r("close"), "ticks", r("avg_spread"), "observed", "expected", r("coverage"), "complete", "available_ms", F.concat_ws(",", F.transform("sources", lambda x: x.cast("string"))).alias("sources")
    )


query(_roll_sql(4 * T.HOUR), "bars_rollup_1h_to_4h")(lambda s, d: _roll(s, d, 4 * T.HOUR))
query(_roll_sql(T.DAY, 17 * T.HOUR), "day_bucket_with_boundary")(lambda s, d: _roll(s, d, T.DAY, 17 * T.HOUR))


@query(f"WITH {TICKS} SELECT DISTINCT event_id, symbol, ts_ms, round(bid, 6) AS bid, round(ask, 6) AS ask FROM (SELECT * FROM ticks UNION ALL SELECT * FROM ticks WHERE event_id % 3 = 0)")
def tick_exact_dedup(s, d):
    t = ticks(s, d)
    both = t.unionByName(t.where("event_id % 3 = 0"))
    return B.distinct_ticks(both).select("event_id", "symbol", "ts_ms", r("bid"), r("ask"))


_FAULTY = "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts_ms END AS ts_ms, CASE WHEN event_id % 13 = 0 THEN -bid WHEN event_id % 17 = 0 THEN NULL ELSE bid END AS bid, CASE WHEN event_id % 19 = 0 THEN ask - 5 ELSE ask END AS ask FROM ticks"


@query(f"""WITH {TICKS}, q AS ({_FAULTY}) SELECT coalesce(CASE WHEN ts_ms IS NULL THEN 'timestamp' WHEN bid IS NULL OR ask IS NULL OR bid <= 0 OR ask <= 0 THEN 'bid_or_ask' WHEN ask < bid THEN 'ask_below_bid' END, 'valid') AS reason, count(*) AS n FROM q GROUP BY 1""")
def quote_validity_reasons(s, d):
    t = ticks(s, d)
    e = F.col("event_id")
    q = t.select(F.when(e % 11 != 0, F.col("ts_ms")).alias("ts_ms"), F.when(e % 13 == 0, -F.col("bid")).when(e % 17 != 0, F.col("bid")).alias("bid"), F.when(e % 19 == 0, F.col("ask") - 5).otherwise(F.col("ask")).alias("ask"))
    return q.groupBy(F.coalesce(X.quote_fault(F.col("bid"), F.col("ask"), F.col("ts_ms")), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT symbol, count(*) AS n FROM bars WHERE high >= greatest(open, close, low) AND low <= least(open, close) AND ticks >= 1 AND avg_spread >= 0 GROUP BY 1")
def ohlc_integrity_filter(s, d):
    return bars(s, d).where(X.bar_ok()).groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT symbol, start_ms, round(max(high) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS prior_high, round(min(low) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS prior_low FROM bars")
def rolling_extrema_prior_n(s, d):
    return I.prior_extremes(bars(s, d)).select("symbol", "start_ms", r("prior_high"), r("prior_low"))


@query(
    """WITH v AS (SELECT 'ALL' AS symbol, epoch_ms(l_shipdate) AS start_ms, sum(l_quantity) AS volume FROM lineitem GROUP BY 2),
 m AS (SELECT *, CASE WHEN count(*) OVER w >= 20 THEN avg(volume) OVER w END AS mean FROM v WINDOW w AS (PARTITION BY symbol ORDER BY start_ms ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT start_ms, round(volume, 6) AS volume, round(CASE WHEN mean > 0 THEN volume / mean END, 6) AS volume_ratio, volume >= mean * 1.05 AS volume_confirms FROM m"""
)
def rolling_volume_ratio(s, d):
    daily = table(s, d, "lineitem").groupBy(T.wall_ms(F.col("l_shipdate")).alias("start_ms")).agg(F.sum("l_quantity").alias("volume")).withColumn("symbol", F.lit("ALL"))
    return I.volume_ratio(daily, "volume").select("start_ms", r("volume"), r("volume_ratio"), "volume_confirms")


@query(f"""{WITH}, l AS (SELECT symbol, start_ms, close, list(close) OVER ({W} ROWS BETWEEN 101 PRECEDING AND 1 PRECEDING) AS past FROM bars)
SELECT symbol, start_ms, round(CASE WHEN len(past) >= 30 THEN len(list_filter(past, lambda x: x <= close)) / CAST(len(past) AS DOUBLE) END, 6) AS past_rank FROM l""")
def rolling_percentile_rank_past(s, d):
    return I.past_rank(bars(s, d), "close").select("symbol", "start_ms", r("past_rank"))


def _pos(n):
    w = f"({W} ROWS {n - 1} PRECEDING)"
    return f"round(CASE WHEN count(*) OVER {w} >= {n} AND max(high) OVER {w} > min(low) OVER {w} THEN greatest(0, least(1, (close - min(low) OVER {w}) / (max(high) OVER {w} - min(low) OVER {w}))) END, 6) AS position_{n}"


@query(f"{WITH} SELECT symbol, start_ms, {_pos(10)}, {_pos(20)}, {_pos(30)} FROM bars")
def range_position_10_20_30(s, d):
    return I.range_position(bars(s, d)).select("symbol", "start_ms", r("position_10"), r("position_20"), r("position_30"))


@query(f"""{WITH}, m AS (SELECT *, close - lag(close) OVER w AS move, close - lag(close, 10) OVER w AS net, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS lr FROM bars WINDOW w AS ({W}))
SELECT symbol, start_ms, round(CASE WHEN count(move) OVER f >= 10 AND sum(abs(move)) OVER f > 0 THEN abs(net) / sum(abs(move)) OVER f END, 6) AS efficiency,
 round(CASE WHEN count(lr) OVER f >= 10 THEN stddev_pop(lr) OVER f END, 6) AS realised_vol FROM m WINDOW f AS ({W} ROWS 9 PRECEDING)""")
def efficiency_realised_vol(s, d):
    return I.efficiency(bars(s, d)).select("symbol", "start_ms", r("efficiency"), r("realised_vol"))


_MOVES = f"""moves AS (SELECT *, row_number() OVER w AS i, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr,
 CASE WHEN high - lag(high) OVER w > lag(low) OVER w - low AND high - lag(high) OVER w > 0 THEN high - lag(high) OVER w ELSE 0 END AS plus_dm,
 CASE WHEN lag(low) OVER w - low > high - lag(high) OVER w AND lag(low) OVER w - low > 0 THEN lag(low) OVER w - low ELSE 0 END AS minus_dm FROM bars WINDOW w AS ({W}))"""


@query(f"""{WITH}, {_MOVES}, s AS (SELECT symbol, start_ms, i, sum(tr) OVER f AS tr, sum(plus_dm) OVER f AS p, sum(minus_dm) OVER f AS m FROM moves WINDOW f AS ({W} ROWS 13 PRECEDING)),
 t AS (SELECT symbol, start_ms, CASE WHEN i > 14 THEN tr / 14 END AS atr, CASE WHEN i > 14 AND tr > 0 THEN 100 * p / tr END AS plus_di, CASE WHEN i > 14 AND tr > 0 THEN 100 * m / tr END AS minus_di FROM s)
SELECT symbol, start_ms, round(atr, 5) AS atr, round(plus_di, 5) AS plus_di, round(minus_di, 5) AS minus_di, round(CASE WHEN plus_di + minus_di > 0 THEN 100 * abs(plus_di - minus_di) / (plus_di + minus_di) END, 5) AS dx FROM t""")
def sma_atr_dmi_unsmoothed(s, d):
    return I.simple_dmi(bars(s, d)).select("symbol", "start_ms", *(r(c, digits=5) for c in ("atr", "plus_di", "minus_di", "dx")))


_N = f"n AS (SELECT *, row_number() OVER ({W}) AS i FROM bars)"


def _ema_sql(n, sma):
    a = 2 / (n + 1)
    seed = f"SELECT symbol, {n if sma else 1} AS i, {'avg(close)' if sma else 'max(close)'} AS e FROM n WHERE i <= {n if sma else 1} GROUP BY symbol HAVING count(*) = {n if sma else 1}"
    return f"""{WITH.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_N}, e AS ({seed} UNION ALL SELECT n.symbol, n.i, e.e * {1 - a!r} + n.close * {a!r} FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)
SELECT n.symbol, n.start_ms, round(e.e, 5) AS ema FROM n LEFT JOIN e ON n.symbol = e.symbol AND n.i = e.i"""


query(_ema_sql(20, True), "ema_sma_seed")(lambda s, d: I.ema(bars(s, d), 20).select("symbol", "start_ms", r("ema", digits=5)))
query(_ema_sql(20, False), "ema_first_seed")(lambda s, d: I.ema(bars(s, d), 20, sma_seed=False).select("symbol", "start_ms", r("ema", digits=5)))


@query(f"""{WITH.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_N}, g AS (SELECT symbol, start_ms, i, greatest(coalesce(close - lag(close) OVER ({W}), 0), 0) AS gain, greatest(coalesce(lag(close) OVER ({W}) - close, 0), 0) AS loss FROM n),
 e AS (SELECT symbol, 15 AS i, sum(gain) / 14 AS ag, sum(loss) / 14 AS al FROM g WHERE i BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14
   UNION ALL SELECT g.symbol, g.i, (e.ag * 13 + g.gain) / 14, (e.al * 13 + g.loss) / 14 FROM e JOIN g ON g.symbol = e.symbol AND g.i = e.i + 1)
SELECT g.symbol, g.start_ms, round(CASE WHEN al = 0 THEN CASE WHEN ag = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + ag / al) END, 4) AS rsi FROM g LEFT JOIN e ON g.symbol = e.symbol AND g.i = e.i""")
def wilder_rsi(s, d):
    return I.rsi(bars(s, d)).select("symbol", "start_ms", r("rsi", digits=4))


_ADX = f"""{WITH.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_MOVES}, sm AS (SELECT symbol, 14 AS i, sum(tr) AS tr, sum(plus_dm) AS p, sum(minus_dm) AS m FROM moves WHERE i <= 14 GROUP BY symbol HAVING count(*) = 14
   UNION ALL SELECT v.symbol, v.i, sm.tr - sm.tr / 14 + v.tr, sm.p - sm.p / 14 + v.plus_dm, sm.m - sm.m / 14 + v.minus_dm FROM sm JOIN moves v ON v.symbol = sm.symbol AND v.i = sm.i + 1),
 di AS (SELECT symbol, i, tr / 14 AS atr, CASE WHEN tr > 0 THEN 100 * p / tr END AS plus_di, CASE WHEN tr > 0 THEN 100 * m / tr END AS minus_di FROM sm),
 dx AS (SELECT *, coalesce(CASE WHEN plus_di + minus_di > 0 THEN 100 * abs(plus_di - minus_di) / (plus_di + minus_di) END, 0) AS dx FROM di),
 ax AS (SELECT symbol, 27 AS i, sum(dx) / 14 AS adx FROM dx WHERE i BETWEEN 14 AND 27 GROUP BY symbol HAVING count(*) = 14 UNION ALL SELECT dx.symbol, dx.i, (ax.adx * 13 + dx.dx) / 14 FROM ax JOIN dx ON dx.symbol = ax.symbol AND dx.i = ax.i + 1)
SELECT v.symbol, v.start_ms, round(dx.atr, 4) AS atr, round(dx.plus_di, 4) AS plus_di, round(dx.minus_di, 4) AS minus_di, round(ax.adx, 4) AS adx FROM moves v LEFT JOIN dx ON v.symbol = dx.symbol AND v.i = dx.i LEFT JOIN ax ON v.symbol = ax.symbol AND v.i = ax.i"""


@query(_ADX)
def wilder_atr_adx(s, d):
    return I.indicators(bars(s, d)).select("symbol", "start_ms", *(r(c, digits=4) for c in ("atr", "plus_di", "minus_di", "adx")))


@query(f"""{_ema_sql(20, False).split("SELECT n.symbol, n.start_ms")[0].rstrip()}, {_MOVES}, t AS (SELECT symbol, start_ms, i, CASE WHEN i > 14 THEN sum(tr) OVER (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING) / 14 END AS atr FROM moves),
 j AS (SELECT t.symbol, t.start_ms, t.i, t.atr, e.e - lag(e.e, 5) OVER (PARTITION BY t.symbol ORDER BY t.i) AS rise FROM t JOIN e ON e.symbol = t.symbol AND e.i = t.i)
SELECT symbol, start_ms, round(CASE WHEN atr > 0 THEN rise / atr END, 5) AS ema_slope FROM j""")
def ema_slope_atr(s, d):
    """Change of the average over five bars in units of the plain ATR."""
    df = I.simple_dmi(I.ema(bars(s, d), 20, sma_seed=False))
    return df.select("symbol", "start_ms", r(X.ratio(F.col("ema") - F.lag("ema", 5).over(I.by_key()), F.col("atr")), "ema_slope", 5))


_PIV = f"""nb AS (SELECT *, greatest(lag(high, 1) OVER w, lag(high, 2) OVER w, lead(high, 1) OVER w, lead(high, 2) OVER w) AS nh, least(lag(low, 1) OVER w, lag(low, 2) OVER w, lead(low, 1) OVER w, lead(low, 2) OVER w) AS nl,
 lag(high, 2) OVER w IS NOT NULL AND lead(high, 2) OVER w IS NOT NULL AS ok, lead(close_ms, 2) OVER w AS confirmed_ms FROM bars WINDOW w AS ({W})),
 pivots AS (SELECT symbol, start_ms, confirmed_ms, 'HIGH' AS kind, high AS price FROM nb WHERE ok AND high > nh UNION ALL SELECT symbol, start_ms, confirmed_ms, 'LOW', low FROM nb WHERE ok AND low < nl)"""


@query(f"{WITH}, {_PIV} SELECT symbol, start_ms, confirmed_ms, kind, round(price, 6) AS price FROM pivots")
def fractal_pivots_2l2r(s, d):
    return P.fractal_pivots(bars(s, d)).select("symbol", "start_ms", "confirmed_ms", "kind", r("price"))


@query(f"""{WITH}, {_PIV.replace('high > nh', 'high > nh AND high - nh >= 2').replace('low < nl', 'low < nl AND nl - low >= 2')} SELECT symbol, kind, count(*) AS n, round(sum(price), 4) AS prices FROM pivots GROUP BY 1, 2""")
def pivot_prominence(s, d):
    return P.fractal_pivots(bars(s, d), F.lit(2.0)).groupBy("symbol", "kind").agg(F.count("*").alias("n"), r(F.sum("price"), "prices", 4))


_ALT = """rn AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY symbol ORDER BY start_ms, kind) THEN 0 ELSE 1 END AS new FROM pivots),
 rr AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY start_ms, kind) AS run FROM rn),
 alt AS (SELECT symbol, run, kind, arg_max(price, (CASE WHEN kind = 'HIGH' THEN price ELSE -price END, -start_ms)) AS price, arg_max(start_ms, (CASE WHEN kind = 'HIGH' THEN price ELSE -price END, -start_ms)) AS start_ms,
  arg_max(confirmed_ms, (CASE WHEN kind = 'HIGH' THEN price ELSE -price END, -start_ms)) AS confirmed_ms, count(*) AS run_length FROM rr GROUP BY symbol, run, kind)"""


@query(f"{WITH}, {_PIV}, {_ALT} SELECT symbol, kind, start_ms, round(price, 6) AS price, run_length FROM alt")
def pivot_runs_extreme(s, d):
    return P.alternate(P.fractal_pivots(bars(s, d))).select("symbol", "kind", "start_ms", r("price"), "run_length")


@query(f"""{WITH}, {_PIV}, o AS (SELECT *, lag(price) OVER (PARTITION BY symbol, kind ORDER BY start_ms) AS before, row_number() OVER (PARTITION BY symbol ORDER BY start_ms, kind) AS k FROM pivots),
 s AS (SELECT a.symbol, a.start_ms, a.kind, a.k, arg_max(b.price, b.k) FILTER (WHERE b.kind = 'HIGH') AS h, arg_max(b.k, b.k) FILTER (WHERE b.kind = 'HIGH') AS hk, arg_max(b.k, b.k) FILTER (WHERE b.kind = 'LOW') AS lk,
   arg_max(b.price, b.k) FILTER (WHERE b.kind = 'LOW') AS l FROM o a JOIN o b ON a.symbol = b.symbol AND b.k <= a.k GROUP BY 1, 2, 3, 4),
 f AS (SELECT s.*, x.before AS ph, y.before AS pl FROM s LEFT JOIN o x ON x.symbol = s.symbol AND x.k = s.hk LEFT JOIN o y ON y.symbol = s.symbol AND y.k = s.lk)
SELECT symbol, start_ms, kind, CASE WHEN ph IS NULL OR pl IS NULL THEN 'INSUFFICIENT' WHEN h > ph AND l > pl THEN 'BULLISH' WHEN h < ph AND l < pl THEN 'BEARISH' ELSE 'NEUTRAL' END AS structure FROM f""")
def structure_hh_hl_lh_ll(s, d):
    return P.structure(P.fractal_pivots(bars(s, d))).select("symbol", "start_ms", "kind", "structure")


@query(f"""{WITH}, p AS (SELECT *, max(high) OVER f AS ph, min(low) OVER f AS pl, lag(close) OVER ({W}) AS pc FROM bars WINDOW f AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT symbol, start_ms, CASE WHEN pc <= ph + 0.5 AND close > ph + 0.5 THEN 'LONG' WHEN pc >= pl - 0.5 AND close < pl - 0.5 THEN 'SHORT' ELSE 'NONE' END AS breakout FROM p""")
def breakout_cross(s, d):
    df = I.prior_extremes(bars(s, d))
    return df.select("symbol", "start_ms", I.breakout(F.col("prior_high"), F.col("prior_low"), F.lit(0.5)).alias("breakout"))


@query()
def momentum_pullback_recovery(s, d):
    """States of momentum, pullback to and recovery of the 20-bar average from RSI, directional strength and the average."""
    df = I.indicators(bars(s, d))
    up = (F.col("adx") >= 16) & (F.col("plus_di") > F.col("minus_di")) & (F.col("rsi") >= 55)
    down = (F.col("adx") >= 16) & (F.col("minus_di") > F.col("plus_di")) & (F.col("rsi") <= 45)
    prev = F.lag("close").over(I.by_key()) - F.lag("ema").over(I.by_key())
    return df.select(
        "symbol", "start_ms", X.first_rule([(up, "LONG"), (down, "SHORT")], "NONE").alias("momentum"),
        X.first_rule([((F.col("low") <= F.col("ema")) & (F.col("close") > F.col("ema")) & (prev > 0), "LONG"), ((F.col("high") >= F.col("ema")) & (F.col("close") < F.col("ema")) & (prev < 0), "SHORT")], "NONE").alias("pullback"),
        X.first_rule([((prev <= 0) & (F.col("close") > F.col("ema")), "LONG"), ((prev >= 0) & (F.col("close") < F.col("ema")), "SHORT")], "NONE").alias("recovery"),
        r("rsi", digits=3), r("adx", digits=3),
    )


@query(f"""{WITH}, a AS (SELECT *, avg(close) OVER ({W} ROWS 4 PRECEDING) AS fast, avg(close) OVER ({W} ROWS 19 PRECEDING) AS slow FROM bars), g AS (SELECT symbol, start_ms, round(fast - slow, 9) AS now, lag(round(fast - slow, 9)) OVER ({W}) AS before FROM a)
SELECT symbol, start_ms, CASE WHEN before <= 0 AND now > 0 THEN 'UP' WHEN before >= 0 AND now < 0 THEN 'DOWN' ELSE 'NONE' END AS crossing FROM g""")
def average_cross(s, d):
    df = bars(s, d).withColumns({"fast": F.avg("close").over(I.last_rows(5)), "slow": F.avg("close").over(I.last_rows(20))})
    df = df.withColumns({"gap": F.round(F.col("fast") - F.col("slow"), 9), "zero": F.lit(0.0)})
    return df.select("symbol", "start_ms", I.crosses(df, "gap", "zero").alias("crossing"))


@query(f"""{WITH}, x AS (SELECT symbol, start_ms, close - lag(close, 1) OVER w AS r1, close - lag(close, 3) OVER w AS r3, close - lag(close, 5) OVER w AS r5 FROM bars WINDOW w AS ({W}))
SELECT symbol, start_ms, round(r1, 6) AS r1, round(r3, 6) AS r3, round(r5, 6) AS r5, round(r1 - r3 / 3, 6) AS acceleration FROM x""")
def directional_returns_accel(s, d):
    return I.returns(bars(s, d)).select("symbol", "start_ms", r("r1"), r("r3"), r("r5"), r("acceleration"))


def _beh(n):
    w = f"({W} ROWS {n - 1} PRECEDING)"
    c = f"CASE WHEN count(*) OVER {w} >= {n} THEN "
    return f"round({c}regr_slope(close, i) OVER {w} END, 4) AS slope_{n}, round({c}close - first_value(close) OVER {w} END, 6) AS net_{n}, round({c}avg(CAST(close > open AS INT)) OVER {w} END, 6) AS rising_{n}"


@query(f"{WITH}, {_N} SELECT symbol, start_ms, {', '.join(_beh(n) for n in (30, 10, 5, 3))} FROM n")
def window_behavior_30_10_5_3(s, d):
    return I.behaviour(bars(s, d)).select("symbol", "start_ms", *(x for n in (30, 10, 5, 3) for x in (r(f"slope_{n}", digits=4), r(f"net_{n}"), r(f"rising_{n}"))))


@query("SELECT user_id, round(regr_slope(value, CAST(event_id AS DOUBLE)), 6) AS slope, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 3")
def linear_slope_group(s, d):
    return table(s, d, "events").groupBy("user_id").agg(r(F.regr_slope("value", F.col("event_id").cast("double")), "slope"), F.count("*").alias("n")).where("n >= 3")


@query(f"""{WITH}, x AS (SELECT a.symbol, a.kind, a.start_ms AS t1, lead(start_ms, 1) OVER w AS t2, lead(start_ms, 2) OVER w AS t3, price AS p1, lead(price, 1) OVER w AS p2, lead(price, 2) OVER w AS p3 FROM pivots a WINDOW w AS (PARTITION BY symbol, kind ORDER BY start_ms)),
 y AS (SELECT *, 0.0 AS x1, (t2 - t1) / 3600000.0 AS x2, (t3 - t1) / 3600000.0 AS x3 FROM x WHERE t3 IS NOT NULL),
 z AS (SELECT *, (x1 + x2 + x3) / 3 AS mx, (p1 + p2 + p3) / 3 AS mp FROM y),
 l AS (SELECT *, ((x1 - mx) * (p1 - mp) + (x2 - mx) * (p2 - mp) + (x3 - mx) * (p3 - mp)) / ((x1 - mx) * (x1 - mx) + (x2 - mx) * (x2 - mx) + (x3 - mx) * (x3 - mx)) AS slope FROM z)
SELECT symbol, kind, t1, round(slope, 3) AS slope, round(mp - slope * mx, 3) AS intercept, round(sqrt(((p1 - slope * x1 - mp + slope * mx) ** 2 + (p2 - slope * x2 - mp + slope * mx) ** 2 + (p3 - slope * x3 - mp + slope * mx) ** 2) / 3), 3) AS rms FROM l""".replace(WITH, f"{WITH}, {_PIV}"))
def line_fit_three_points(s, d):
    w = Window.partitionBy("symbol", "kind").orderBy("start_ms")
    df = P.fractal_pivots(bars(s, d)).select("symbol", "kind", F.col("start_ms").alias("t1"), *(F.lead("start_ms", k).over(w).alias(f"t{k + 1}") for k in (1, 2)), F.col("price").alias("p1"), *(F.lead("price", k).over(w).alias(f"p{k + 1}") for k in (1, 2))).where("t3 IS NOT NULL")
    slope, cut, rms = P.three_point_line([F.lit(0.0), (F.col("t2") - F.col("t1")) / T.HOUR, (F.col("t3") - F.col("t1")) / T.HOUR], [F.col("p1"), F.col("p2"), F.col("p3")])
    return df.select("symbol", "kind", "t1", r(slope, "slope", 3), r(cut, "intercept", 3), r(rms, "rms", 3))


_W2 = """w2 AS (SELECT symbol, kind, price, start_ms AS first_ms, lead(price, 1) OVER w AS p2, lead(price, 2) OVER w AS p3, lead(start_ms, 2) OVER w AS t3, lead(confirmed_ms, 2) OVER w AS known_ms FROM alt WINDOW w AS (PARTITION BY symbol ORDER BY start_ms, kind)),
 pat AS (SELECT symbol, CASE WHEN kind = 'LOW' THEN 'W' ELSE 'M' END AS pattern, first_ms, t3, known_ms, p2 AS neckline, CASE WHEN kind = 'LOW' THEN least(price, p3) ELSE greatest(price, p3) END AS invalid_at FROM w2
  WHERE abs(price - p3) <= 3 AND CASE WHEN kind = 'LOW' THEN p2 - greatest(price, p3) ELSE least(price, p3) - p2 END >= 10)"""


@query(f"""{WITH}, {_PIV}, {_ALT}, {_W2}, j AS (SELECT p.symbol, pattern, first_ms, t3, b.close_ms AS bar_ms, CASE WHEN (pattern = 'W' AND close < invalid_at) OR (pattern = 'M' AND close > invalid_at) THEN 'INVALIDATED' WHEN (pattern = 'W' AND close > neckline) OR (pattern = 'M' AND close < neckline) THEN 'CONFIRMED' END AS state
  FROM pat p LEFT JOIN bars b ON b.symbol = p.symbol AND b.close_ms > p.known_ms AND b.close_ms <= p.known_ms + 36 * 3600000)
SELECT symbol, pattern, first_ms, t3, coalesce(arg_min(state, bar_ms) FILTER (WHERE state IS NOT NULL), 'EXPIRED') AS state, min(bar_ms) FILTER (WHERE state IS NOT NULL) AS resolved_ms FROM j GROUP BY 1, 2, 3, 4""")
def wm_pattern_scan(s, d):
    b = bars(s, d)
    return P.resolve(P.double_patterns(P.alternate(P.fractal_pivots(b)), 10.0), b)


@query(f"""{WITH}, {_PIV}, {_ALT}, h AS (SELECT symbol, kind, price, start_ms AS first_ms, lead(price, 1) OVER w AS q1, lead(price, 2) OVER w AS q2, lead(price, 3) OVER w AS q3, lead(price, 4) OVER w AS q4, lead(start_ms, 4) OVER w AS end_ms FROM alt WINDOW w AS (PARTITION BY symbol ORDER BY start_ms, kind))
SELECT symbol, CASE WHEN kind = 'HIGH' THEN 'HEAD_SHOULDERS' ELSE 'INVERSE' END AS pattern, first_ms, end_ms, round((q1 + q3) / 2, 6) AS neckline FROM h
WHERE abs(price - q4) <= 7.5 AND CASE WHEN kind = 'HIGH' THEN q2 - greatest(price, q4) ELSE least(price, q4) - q2 END >= 5""")
def head_shoulders_scan(s, d):
    return P.head_shoulders(P.alternate(P.fractal_pivots(bars(s, d))), 10.0).select("symbol", "pattern", "first_ms", "end_ms", r("neckline"))


@query(f"""{WITH.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_PIV}, zo AS (SELECT *, start_ms // 604800000 AS period, row_number() OVER (PARTITION BY symbol, start_ms // 604800000 ORDER BY price, start_ms) AS rn FROM pivots),
 zh AS (SELECT symbol, period, rn, price AS head FROM zo WHERE rn = 1 UNION ALL SELECT o.symbol, o.period, o.rn, CASE WHEN o.price - h.head <= 5 THEN h.head ELSE o.price END FROM zh h JOIN zo o ON o.symbol = h.symbol AND o.period = h.period AND o.rn = h.rn + 1)
SELECT symbol, CAST(period AS BIGINT) AS period, dense_rank() OVER (PARTITION BY symbol, period ORDER BY head) - 1 AS zone, round(avg(price), 6) AS price, count(DISTINCT start_ms) AS touches, least(5, count(DISTINCT start_ms)) AS strength, round(min(price), 6) AS low, round(max(price), 6) AS high FROM zo JOIN zh USING (symbol, period, rn) GROUP BY symbol, period, head""")
def zone_clustering(s, d):
    p = P.fractal_pivots(bars(s, d)).withColumn("period", F.floor(F.col("start_ms") / (7 * T.DAY)))
    z = P.zones(p, 5.0)
    return z.select("symbol", "period", "zone", r("price"), "touches", "strength", r("low"), r("high"))


_STATE = f"{WITH}, st AS (SELECT symbol, start_ms, CASE WHEN close > open THEN 'UP' WHEN close < open THEN 'DOWN' ELSE 'FLAT' END AS state FROM bars)"
_RUNS = f"""{_STATE}, c AS (SELECT *, CASE WHEN state = lag(state) OVER ({W}) THEN 0 ELSE 1 END AS new FROM st), u AS (SELECT *, sum(new) OVER ({W}) AS run FROM c),
 runs AS (SELECT symbol, run, max(state) AS state, min(start_ms) AS begin_ms, count(*) AS length FROM u GROUP BY 1, 2), ended AS (SELECT *, lead(begin_ms) OVER (PARTITION BY symbol ORDER BY run) AS end_ms FROM runs)"""


def _runs(s, d):
    state = F.when(F.col("close") > F.col("open"), "UP").when(F.col("close") < F.col("open"), "DOWN").otherwise("FLAT")
    return E.run_table(bars(s, d).withColumn("state", state), "symbol", "start_ms", ["start_ms"], "state")


@query(f"{_RUNS} SELECT symbol, CAST(run AS BIGINT) AS run, state, begin_ms, end_ms, length FROM ended WHERE end_ms IS NOT NULL")
def stale_bias_runs(s, d):
    return _runs(s, d).select("symbol", "run", "state", "begin_ms", "end_ms", "length")


@query(f"{_RUNS}, n AS (SELECT *, lead(state) OVER (PARTITION BY symbol ORDER BY run) AS next_state FROM ended WHERE end_ms IS NOT NULL) SELECT state, next_state, count(*) AS n, round(avg(length), 6) AS mean_length FROM n WHERE next_state IS NOT NULL GROUP BY 1, 2")
def run_durations_transitions(s, d):
    return E.transitions(_runs(s, d), "symbol").select("state", "next_state", "n", r("mean_length"))


@query(f"{_RUNS} SELECT t.event_id, e.run AS run, e.state FROM ticks t LEFT JOIN (SELECT * FROM ended WHERE end_ms IS NOT NULL AND length >= 3) e ON t.symbol = e.symbol AND t.ts_ms >= e.begin_ms AND t.ts_ms < e.end_ms".replace("e.run AS run", "CAST(e.run AS BIGINT) AS run"))
def episode_containment(s, d):
    spans = _runs(s, d).where("length >= 3").withColumn("t", F.col("begin_ms"))
    got = J.asof_backward(ticks(s, d), spans.select("symbol", "t", "end_ms", "run", "state"), "symbol", "ts_ms", "t", ["end_ms", "run", "state"])
    inside = F.col("ts_ms") < F.col("asof_end_ms")
    return got.select("event_id", F.when(inside, F.col("asof_run")).alias("run"), F.when(inside, F.col("asof_state")).alias("state"))


@query(f"""{_RUNS}, f AS (SELECT symbol, begin_ms AS at_ms, state FROM runs WHERE state <> 'FLAT'), g AS (SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY symbol ORDER BY at_ms) AS was FROM f) WHERE was IS NOT NULL AND was <> state)
SELECT b.symbol, b.start_ms, max(g.at_ms) AS shift_ms FROM bars b LEFT JOIN g ON g.symbol = b.symbol AND g.at_ms <= b.start_ms AND g.at_ms >= b.start_ms - 30 * 3600000 GROUP BY 1, 2""")
def transition_lead(s, d):
    table_ = E.run_table(
        bars(s, d).withColumn("state", F.when(F.col("close") > F.col("open"), "UP").when(F.col("close") < F.col("open"), "DOWN").otherwise("FLAT")), "symbol", "start_ms", ["start_ms"], "state", drop_open=False
    )
    flips = table_.where("state <> 'FLAT'").withColumn("was", F.lag("state").over(Window.partitionBy("symbol").orderBy("begin_ms"))).where("was IS NOT NULL AND was <> state")
    got = J.asof_backward(bars(s, d).select("symbol", "start_ms"), flips.select("symbol", "begin_ms", "state"), "symbol", "start_ms", "begin_ms", ["state"])
    return got.select("symbol", "start_ms", F.when(F.col("start_ms") - F.col("asof_begin_ms") <= 30 * T.HOUR, F.col("asof_begin_ms")).alias("shift_ms"))


@query(f"WITH {TICKS} SELECT symbol, ts_ms - ts_ms % 3600000 AS hour_ms, min(event_id) FILTER (WHERE k = 1) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts_ms - ts_ms % 3600000 ORDER BY ts_ms, event_id) AS k FROM ticks) GROUP BY 1, 2")
def first_checkpoint_per_hour(s, d):
    t = ticks(s, d).withColumn("hour_ms", T.bucket(F.col("ts_ms"), T.HOUR))
    return t.groupBy("symbol", "hour_ms").agg(F.min_by("event_id", F.struct("ts_ms", "event_id")).alias("event_id"))


@query(f"WITH {TICKS} SELECT hour_ms, side, event_id, symbol FROM (SELECT ts_ms - ts_ms % 3600000 AS hour_ms, event_id % 2 AS side, event_id, symbol, row_number() OVER (PARTITION BY ts_ms - ts_ms % 3600000, event_id % 2 ORDER BY CASE symbol WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END DESC, ts_ms, event_id) AS k FROM ticks) WHERE k = 1")
def priority_dedup(s, d):
    t = ticks(s, d).select(T.bucket(F.col("ts_ms"), T.HOUR).alias("hour_ms"), (F.col("event_id") % 2).alias("side"), "event_id", "symbol", "ts_ms")
    rank = F.when(F.col("symbol") == "purchase", 3).when(F.col("symbol") == "signup", 2).when(F.col("symbol") == "click", 1).otherwise(0)
    return E.first_per(t, ["hour_ms", "side"], [rank.desc(), F.col("ts_ms"), F.col("event_id")]).select("hour_ms", "side", "event_id", "symbol")


@query(f"""WITH {TICKS}, g AS (SELECT *, lag(ts_ms) OVER w - ts_ms AS gap, row_number() OVER w AS k FROM ticks WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms DESC, event_id DESC)),
 c AS (SELECT *, sum(CASE WHEN coalesce(gap, 0) > 86400000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts_ms DESC, event_id DESC) AS cut FROM g) SELECT user_id, event_id, ts_ms FROM c WHERE cut = 0 AND k <= 50""")
def newest_contiguous_segment(s, d):
    return E.newest_segment(ticks(s, d), "user_id", "ts_ms", T.DAY, 50, "event_id").select("user_id", "event_id", "ts_ms")


@query(f"""{WITH.replace('WITH ', 'WITH RECURSIVE ', 1)}, v AS (SELECT symbol, start_ms, {_pos(20).replace('round(', '(').replace(', 6) AS', ') AS')} FROM bars), n AS (SELECT *, row_number() OVER ({W}) AS i FROM v WHERE position_20 IS NOT NULL),
 e AS (SELECT symbol, CAST(0 AS BIGINT) AS i, false AS on_, 0 AS streak FROM (SELECT DISTINCT symbol FROM n)
   UNION ALL SELECT symbol, i, CASE WHEN streak + 1 >= 2 AND push THEN NOT on_ ELSE on_ END, CASE WHEN push AND streak + 1 < 2 THEN streak + 1 ELSE 0 END FROM (SELECT n.symbol, n.i, e.on_, e.streak, CASE WHEN e.on_ THEN position_20 < 0.45 ELSE position_20 >= 0.55 END AS push FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1))
SELECT n.symbol, n.start_ms, CASE WHEN e.on_ THEN 'ON' ELSE 'OFF' END AS regime FROM n JOIN e ON e.symbol = n.symbol AND e.i = n.i""")
def hysteresis_regime(s, d):
    df = I.range_position(bars(s, d)).where("position_20 IS NOT NULL").select("symbol", "start_ms", "position_20")
    return E.hysteresis(df, "symbol", "start_ms", "position_20").select("symbol", "start_ms", "regime")


@query(f"""WITH {TICKS}, v AS (SELECT l_returnflag AS flag, epoch_ms(l_shipdate) AS day_ms, sum(l_quantity * (CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END)) AS x FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(x) OVER (PARTITION BY flag ORDER BY day_ms) AS total FROM v),
 p AS (SELECT *, greatest(0, max(total) OVER (PARTITION BY flag ORDER BY day_ms)) - total AS fall FROM c) SELECT flag, round(max(fall), 4) AS max_drawdown FROM p GROUP BY 1""".replace(f"WITH {TICKS}, v", "WITH v"))
def max_drawdown(s, d):
    l = table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), T.wall_ms(F.col("l_shipdate")).alias("day_ms")).agg(F.sum(F.col("l_quantity") * F.when(F.col("l_linestatus") == "O", 1).otherwise(-1)).alias("x"))
    return S.drawdown(l, "flag", "x", ["day_ms"]).select("flag", r("max_drawdown", digits=4))


@query(f"WITH {TICKS}, g AS (SELECT user_id, ts_ms - lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS gap FROM ticks) SELECT CASE WHEN gap > 86400000 THEN 'OVER_DAY' WHEN gap > 3600000 THEN 'OVER_HOUR' WHEN gap > 60000 THEN 'OVER_MINUTE' ELSE 'SHORT' END AS kind, count(*) AS n, max(gap) AS longest_ms FROM g WHERE gap IS NOT NULL GROUP BY 1")
def gap_histogram(s, d):
    return B.gap_table(ticks(s, d), "user_id").groupBy(B.gap_kind(F.col("gap_ms")).alias("kind")).agg(F.count("*").alias("n"), F.max("gap_ms").alias("longest_ms"))


@query(f"WITH {TICKS}, g AS (SELECT user_id, event_id, ts_ms - lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS gap_ms FROM ticks) SELECT user_id, event_id, gap_ms FROM g WHERE gap_ms IS NOT NULL ORDER BY gap_ms DESC, event_id LIMIT 8")
def top_gaps(s, d):
    return B.gap_table(ticks(s, d), "user_id").orderBy(F.desc("gap_ms"), "event_id").limit(8).select("user_id", "event_id", "gap_ms")


@query(f"""{WITH}, o AS (SELECT symbol, start_ms, CASE WHEN start_ms % 7 = 0 THEN close + 1 ELSE close END AS close, high FROM bars WHERE start_ms / 3600000 % 5 <> 0)
SELECT count(*) FILTER (WHERE o.symbol IS NULL) AS only_left, count(*) FILTER (WHERE b.symbol IS NULL) AS only_right, count(*) FILTER (WHERE abs(b.close - o.close) > 1e-9) AS close_differs, round(max(abs(b.close - o.close)), 6) AS close_most FROM bars b FULL OUTER JOIN o ON b.symbol = o.symbol AND b.start_ms = o.start_ms""".replace("start_ms / 3600000 % 5", "(start_ms // 3600000) % 5"))
def full_outer_bar_compare(s, d):
    b = bars(s, d)
    o = b.where((F.col("start_ms") / T.HOUR).cast("long") % 5 != 0).withColumn("close", F.when(F.col("start_ms") % 7 == 0, F.col("close") + 1).otherwise(F.col("close")))
    return B.compare(b, o, ["close"]).select("only_left", "only_right", "close_differs", r("close_most"))


@query(f"WITH {TICKS}, z AS (SELECT user_id, min(ts_ms) AS begin_ms, max(ts_ms) AS end_ms FROM ticks GROUP BY 1) SELECT user_id, begin_ms, end_ms, coalesce(max(end_ms) OVER (ORDER BY begin_ms, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= begin_ms, false) AS overlaps FROM z")
def range_overlap_detect(s, d):
    spans = ticks(s, d).groupBy(F.col("user_id").alias("source")).agg(F.min("ts_ms").alias("begin_ms"), F.max("ts_ms").alias("end_ms"))
    return B.range_overlaps(spans).select(F.col("source").alias("user_id"), "begin_ms", "end_ms", "overlaps")
