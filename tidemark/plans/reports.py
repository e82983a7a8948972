"""Queries on regimes, release paths, opportunities, targets, ledgers, providers and data quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.functions import timebase as T
from tidemark.functions import verdicts as V
from tidemark.operators import regime as G
from tidemark.operators import reports as R
from tidemark.operators import stats as S
from tidemark.plans.base import TICKS, WITH, bars, query, r, table, ticks, written

_W = "PARTITION BY symbol ORDER BY start_ms"
FRAME = f"""{WITH}, f0 AS (SELECT *, CASE WHEN count(*) OVER (w ROWS 13 PRECEDING) = 14 THEN nullif(round(avg(high - low) OVER (w ROWS 13 PRECEDING), 8), 0) END AS atr, round(avg(close) OVER (w ROWS 19 PRECEDING), 8) AS mean20,
  lag(close, 5) OVER w AS close5, round(lead(close, 4) OVER w - close, 6) AS ret, min(start_ms) OVER (PARTITION BY symbol) AS t0, max(start_ms) OVER (PARTITION BY symbol) AS t1 FROM bars WINDOW w AS ({_W})),
 f AS (SELECT *, round((close - close5) / atr, 8) AS slope, CASE WHEN (start_ms - t0) * 10 < (t1 - t0) * 6 THEN 'TRAIN' WHEN (start_ms - t0) * 10 < (t1 - t0) * 8 THEN 'VALIDATION' ELSE 'OOS' END AS period,
  (start_ms - t0) * 10 < (t1 - t0) * 6 AS train, CASE WHEN close >= open THEN 'LONG' ELSE 'SHORT' END AS side, round(greatest(0, least(100, 50 + 20 * (close - mean20) / atr)), 4) AS long_score, 100 - round(greatest(0, least(100, 50 + 20 * (close - mean20) / atr)), 4) AS short_score FROM f0)"""


def frame(s, d):
    """Hourly bars with ATR, mean, slope, period, side, scores and the return over the next four bars."""
    w, of = Window.partitionBy("symbol").orderBy("start_ms"), Window.partitionBy("symbol")
    span = F.max("start_ms").over(of) - F.min("start_ms").over(of)
    out = bars(s, d).withColumns(
        {
            "atr": F.when(F.count("*").over(w.rowsBetween(-13, 0)) == 14, F.nullif(F.round(F.avg(F.col("high") - F.col("low")).over(w.rowsBetween(-13, 0)), 8), F.lit(0.0))),
            "mean20": F.round(F.avg("close").over(w.rowsBetween(-19, 0)), 8),
            "ret": F.round(F.lead("close", 4).over(w) - F.col("close"), 6),
            "__close5": F.lag("close", 5).over(w),
            "__at": (F.col("start_ms") - F.min("start_ms").over(of)) * 10,
            "__span": span,
        }
    )
    train = F.col("__at") < F.col("__span") * 6
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + 20 * (F.col("close") - F.col("mean20")) / F.col("atr"))), 4)
    score = F.when(F.col("atr").isNotNull(), score)
    return out.withColumns(
        {
            "slope": F.round((F.col("close") - F.col("__close5")) / F.col("atr"), 8),
            "train": train,
            "period": F.when(train, "TRAIN").when(F.col("__at") < F.col("__span") * 8, "VALIDATION").otherwise("OOS"),
            "side": F.when(F.col("close") >= F.col("open"), "LONG").otherwise("SHORT"),
            "long_score": score,
            "short_score": 100 - score,
        }
    ).drop("__close5", "__at", "__span")


# In DuckDB, least and greatest leave nulls out: scores count only where ATR is known.
FRAME = FRAME.replace("round(greatest(0, least(100, 50 + 20 * (close - mean20) / atr)), 4)", "CASE WHEN atr IS NOT NULL THEN round(greatest(0, least(100, 50 + 20 * (close - mean20) / atr)), 4) END")

_CAL = f"""{FRAME}, c0 AS (SELECT *, count(atr) OVER p >= 30 AND count(slope) OVER p >= 30 AND train AS enough, quantile_cont(atr, 0.2) OVER p AS q1, quantile_cont(atr, 0.8) OVER p AS q2, quantile_cont(abs(slope), 0.6) OVER p AS q3, quantile_cont(abs(slope), 0.35) OVER p AS q4
  FROM f WINDOW p AS ({_W} ROWS BETWEEN 256 PRECEDING AND 1 PRECEDING)),
 z AS (SELECT symbol, CASE WHEN count(atr) >= 30 AND count(slope) >= 30 THEN [round(quantile_cont(atr, 0.2), 8), round(quantile_cont(atr, 0.8), 8), round(greatest(0.05, quantile_cont(abs(slope), 0.6)), 8), round(greatest(0.025, quantile_cont(abs(slope), 0.35)), 8)] END AS t FROM f WHERE train GROUP BY 1),
 c1 AS (SELECT c0.*, CASE WHEN enough THEN [round(q1, 8), round(q2, 8), round(greatest(0.05, q3), 8), round(greatest(0.025, q4), 8)] WHEN NOT train THEN t END AS t FROM c0 LEFT JOIN z ON z.symbol = c0.symbol),
 c AS (SELECT *, t[1] AS atr_low, t[2] AS atr_high, t[3] AS slope_entry, t[4] AS slope_exit FROM c1)"""

_RANK = "CASE WHEN len({l}) >= 30 AND {x} IS NOT NULL THEN len(list_filter({l}, lambda v: v <= {x})) / CAST(len({l}) AS DOUBLE) END"
_RANKED = f"""{_CAL}, p0 AS (SELECT *, row_number() OVER w AS i, high - low AS wide, list(atr) FILTER (WHERE atr IS NOT NULL) OVER p AS pa, list(high - low) OVER p AS pr, list(avg_spread) OVER p AS ps,
  lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, greatest(lag(high, 4) OVER w, lag(high, 3) OVER w, lag(high) OVER w, high) AS nh, least(lag(low, 4) OVER w, lag(low, 3) OVER w, lag(low) OVER w, low) AS nl, lag(high, 4) OVER w IS NOT NULL AND atr IS NOT NULL AS ready
  FROM c WINDOW w AS ({_W}), p AS ({_W} ROWS BETWEEN 101 PRECEDING AND 1 PRECEDING)),
 p1 AS (SELECT *, {_RANK.format(l="pa", x="atr")} AS atr_rank, {_RANK.format(l="pr", x="wide")} AS range_rank, {_RANK.format(l="ps", x="avg_spread")} AS spread_rank,
  CASE WHEN ready AND (h2 > nh) <> (l2 < nl) THEN CASE WHEN h2 > nh THEN 'H' ELSE 'L' END END AS pivot, CASE WHEN ready AND (h2 > nh) <> (l2 < nl) THEN CASE WHEN h2 > nh THEN h2 ELSE l2 END END AS at_price,
  atr IS NOT NULL AND slope IS NOT NULL AND slope_entry IS NOT NULL AS known FROM p0)"""

#: One fold over the bars of each symbol: the last four alternating pivots, the trend before, the settled regime with candidate, run and age.
_FOLD = f"""{_RANKED.replace("WITH ", "WITH RECURSIVE ", 1)}, fold AS (
 SELECT symbol, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS k, CAST(NULL AS DOUBLE) AS x1, CAST(NULL AS DOUBLE) AS x2, CAST(NULL AS DOUBLE) AS x3, CAST(NULL AS DOUBLE) AS x4, 'UNKNOWN' AS structure, 'UNKNOWN' AS trend, 'UNKNOWN' AS volatility, 'UNKNOWN' AS transition, 'UNKNOWN' AS regime,
  CAST(0 AS DOUBLE) AS confidence, 'UNKNOWN' AS settled, CAST(NULL AS VARCHAR) AS candidate, 0 AS n, CAST(0 AS BIGINT) AS age, CAST(NULL AS VARCHAR) AS moved_from, CAST(NULL AS VARCHAR) AS moved_to FROM (SELECT DISTINCT symbol FROM p1)
 UNION ALL
 SELECT symbol, i, k, x1, x2, x3, x4, structure, trend, volatility, transition, regime, confidence, CASE WHEN go THEN regime ELSE settled END, CASE WHEN ok AND NOT go THEN regime END, CASE WHEN ok AND NOT go THEN m ELSE 0 END, CASE WHEN go THEN 1 ELSE age + 1 END, CASE WHEN go THEN settled END, CASE WHEN go THEN regime END
 FROM (SELECT *, ok AND (m >= 2 OR regime IN ('EVENT_SHOCK', 'TRANSITION')) AS go FROM (
  SELECT *, regime <> settled AND regime <> 'UNKNOWN' AND confidence >= CASE WHEN settled = 'UNKNOWN' THEN 0.55 ELSE 0.45 END AS ok, CASE WHEN regime = candidate THEN n + 1 ELSE 1 END AS m FROM (
  SELECT *, round(CASE regime WHEN 'UNKNOWN' THEN 0 WHEN 'EVENT_SHOCK' THEN 1 WHEN 'TRANSITION' THEN greatest(0.75, strength) WHEN 'RANGE' THEN 0.5 ELSE strength END, 4) AS confidence FROM (
  SELECT *, CASE WHEN NOT known THEN 'UNKNOWN' WHEN transition = 'SHOCK' THEN 'EVENT_SHOCK' WHEN transition = 'TRANSITION' THEN 'TRANSITION' WHEN trend = 'UP' AND structure <> 'BEARISH' THEN 'TREND_UP' WHEN trend = 'DOWN' AND structure <> 'BULLISH' THEN 'TREND_DOWN'
    WHEN structure = 'RANGE' OR trend = 'FLAT' THEN 'RANGE' WHEN volatility = 'EXPANSION' THEN 'VOL_EXPANSION' WHEN volatility = 'CONTRACTION' THEN 'VOL_CONTRACTION' ELSE 'UNKNOWN' END AS regime, least(1.0, abs(slope) / greatest(slope_entry * 2, 0.01)) AS strength FROM (
  SELECT *, CASE WHEN NOT known THEN 'UNKNOWN' WHEN coalesce(atr_rank >= 0.98 AND (coalesce(range_rank >= 0.98, false) OR coalesce(spread_rank >= 0.98, false)), false) THEN 'SHOCK' WHEN before <> 'UNKNOWN' AND before <> trend THEN 'TRANSITION' ELSE 'STABLE' END AS transition,
    CASE WHEN NOT known THEN 'UNKNOWN' WHEN atr >= atr_high THEN 'EXPANSION' WHEN atr <= atr_low THEN 'CONTRACTION' ELSE 'NORMAL' END AS volatility,
    CASE WHEN x4 IS NULL OR atr IS NULL THEN 'UNKNOWN' WHEN x1 - x3 > 0.1 * atr AND x2 - x4 > 0.1 * atr THEN 'BULLISH' WHEN x1 - x3 < -0.1 * atr AND x2 - x4 < -0.1 * atr THEN 'BEARISH' WHEN abs(x1 - x3) <= 0.1 * atr AND abs(x2 - x4) <= 0.1 * atr THEN 'RANGE' ELSE 'MIXED' END AS structure FROM (
  SELECT g.symbol, g.i, g.atr, g.slope, g.atr_low, g.atr_high, g.slope_entry, g.known, g.atr_rank, g.range_rank, g.spread_rank, o.trend AS before, o.settled, o.candidate, o.n, o.age, coalesce(g.pivot, o.k) AS k,
    CASE WHEN g.pivot IS NULL THEN o.x1 WHEN g.pivot = o.k THEN CASE WHEN g.pivot = 'H' THEN greatest(o.x1, g.at_price) ELSE least(o.x1, g.at_price) END ELSE g.at_price END AS x1,
    CASE WHEN g.pivot IS NULL OR g.pivot = o.k THEN o.x2 ELSE o.x1 END AS x2, CASE WHEN g.pivot IS NULL OR g.pivot = o.k THEN o.x3 ELSE o.x2 END AS x3, CASE WHEN g.pivot IS NULL OR g.pivot = o.k THEN o.x4 ELSE o.x3 END AS x4,
    CASE WHEN NOT g.known THEN 'UNKNOWN' WHEN g.slope >= CASE WHEN o.trend IN ('UP', 'DOWN') THEN g.slope_exit ELSE g.slope_entry END THEN 'UP' WHEN g.slope <= -CASE WHEN o.trend IN ('UP', 'DOWN') THEN g.slope_exit ELSE g.slope_entry END THEN 'DOWN' ELSE 'FLAT' END AS trend
  FROM fold o JOIN p1 g ON g.symbol = o.symbol AND g.i = o.i + 1))))))),
 states AS (SELECT fold.*, p1.start_ms, p1.close_ms FROM fold JOIN p1 ON p1.symbol = fold.symbol AND p1.i = fold.i)"""


def _classified(s, d):
    b = G.ranked(G.structured(G.calibrated(written(frame(s, d)))), {"atr_rank": F.col("atr"), "range_rank": F.col("high") - F.col("low"), "spread_rank": F.col("avg_spread")})
    return G.classified(b)


@query(f"{_CAL} SELECT symbol, start_ms, round(atr_low, 6) AS atr_low, round(atr_high, 6) AS atr_high, round(slope_entry, 6) AS slope_entry, round(slope_exit, 6) AS slope_exit FROM c")
def regime_calibration(s, d):
    """Thresholds of the bars before in TRAIN, frozen afterwards."""
    return G.calibrated(written(frame(s, d))).select("symbol", "start_ms", r("atr_low"), r("atr_high"), r("slope_entry"), r("slope_exit"))


@query(f"{_FOLD} SELECT symbol, start_ms, structure, trend, volatility, transition, regime, confidence FROM states")
def regime_states(s, d):
    """Structure, trend entered and left at different slopes, volatility, shock, transition, regime; the SQL folds over the bars."""
    return _classified(s, d).select("symbol", "start_ms", "structure", "trend", "volatility", "transition", "regime", "confidence")


@query(f"""{_FOLD}, copies AS (SELECT *, false AS again FROM states UNION ALL SELECT * REPLACE (CAST(NULL AS VARCHAR) AS moved_from, CAST(NULL AS VARCHAR) AS moved_to), true FROM states WHERE (start_ms // 3600000) % 5 = 0)
SELECT symbol, start_ms, again, settled, age, moved_from, moved_to FROM copies""")
def regime_hysteresis(s, d):
    """The settled regime with its age and moves; every fifth hour's bar comes twice, and the second time changes nothing."""
    b = written(_classified(s, d)).withColumn("again", F.lit(False))
    twice = b.unionByName(b.where("(start_ms div 3600000) % 5 = 0").withColumn("again", F.lit(True)))
    return G.settled(twice, ["again"]).select("symbol", "start_ms", "again", "settled", "age", "moved_from", "moved_to")


@query(f"""{FRAME}, q AS (SELECT symbol, start_ms, train, round(avg_spread, 6) AS x FROM f), p AS (SELECT *, list(x) OVER ({_W} ROWS BETWEEN 256 PRECEDING AND 1 PRECEDING) AS past FROM q),
 z AS (SELECT symbol, list(x) AS train_x FROM q WHERE train GROUP BY 1)
SELECT p.symbol, start_ms, round(CASE WHEN train THEN CASE WHEN len(past) >= 30 THEN len(list_filter(past, lambda v: v <= x)) / len(past) END ELSE len(list_filter(train_x, lambda v: v <= x)) / len(train_x) END, 6) AS rank FROM p JOIN z ON p.symbol = z.symbol""")
def spread_prefix_rank(s, d):
    """Rank of the spread among earlier ones, of TRAIN alone after TRAIN."""
    return G.prefix_rank(frame(s, d).withColumn("x", F.round("avg_spread", 6)), "x").select("symbol", "start_ms", r("rank"))


@query(f"{FRAME} SELECT symbol, start_ms, round(median(avg_spread) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS median FROM f")
def spread_rolling_median(s, d):
    """W26."""
    return G.rolling_median(frame(s, d), "avg_spread").select("symbol", "start_ms", r("median"))


@query(f"""{FRAME}, v AS (SELECT *, coalesce(ticks >= 1.05 * avg(CASE WHEN ticks > 0 THEN ticks END) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), false) AS volume_ok, coalesce(close - open >= 0.5 * atr, false) AS body_up, coalesce(open - close >= 0.5 * atr, false) AS body_down,
  lag(high, 4) OVER ({_W}) AS high4, max(high) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - min(low) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS depth FROM f),
 q AS (SELECT *, least(100, 25 * greatest(0, least(1, 1 - abs(high - high4) / (0.5 * atr))) + 25 * greatest(0, least(1, depth / (2 * atr))) + 10 + 20 * greatest(0, least(1, (open - close) / atr)) + CASE WHEN volume_ok THEN 5 ELSE 0 END + CASE WHEN body_down THEN 5 ELSE 0 END) AS quality FROM v WHERE atr > 0 AND high4 IS NOT NULL)
SELECT symbol, start_ms, volume_ok, body_up, body_down, round(quality, 4) AS quality, CASE WHEN round(quality, 4) < 50 THEN 0 WHEN round(quality, 4) < 65 THEN 1 WHEN round(quality, 4) < 75 THEN 2 WHEN round(quality, 4) < 85 THEN 3 ELSE 4 END AS bonus FROM q""")
def pattern_quality_bonus(s, d):
    """M6, M7: quality of the top formed with the bar four before (legs of 2 and 4 bars), confirmations, bonus."""
    w = Window.partitionBy("symbol").orderBy("start_ms")
    b = G.confirmation(frame(s, d)).withColumns({"high4": F.lag("high", 4).over(w), "depth": F.max("high").over(w.rowsBetween(-4, 0)) - F.min("low").over(w.rowsBetween(-4, 0))}).where("atr > 0 AND high4 IS NOT NULL")
    c = F.col
    q = F.round(V.pattern_quality(F.abs(c("high") - c("high4")), 0.5 * c("atr"), c("depth"), c("atr"), F.lit(2.0), F.lit(4.0), (c("open") - c("close")) / c("atr"), c("volume_ok"), c("body_down")), 4)
    return b.select("symbol", "start_ms", "volume_ok", "body_up", "body_down", q.alias("quality")).withColumn("bonus", V.quality_bonus(F.col("quality")))


_PATH = f"""{FRAME}, a AS (SELECT *, concat(symbol, '-', start_ms) AS id FROM f),
 m AS (SELECT a.id, b.start_ms AS at_ms, a.atr, greatest(0, CASE WHEN a.side = 'SHORT' THEN b.high - a.close ELSE a.close - b.low END) AS opp, greatest(0, CASE WHEN a.side = 'SHORT' THEN a.close - b.low ELSE b.high - a.close END) AS orig
  FROM a JOIN f b ON a.symbol = b.symbol AND b.start_ms > a.start_ms AND b.close_ms <= a.close_ms + 28800000 WHERE a.atr > 0),
 g AS (SELECT id, count(*) AS n, min(CASE WHEN opp >= 0.75 * atr THEN at_ms END) AS o1, min(CASE WHEN orig >= 0.5 * atr THEN at_ms END) AS o2, max(opp) AS opp, max(orig) AS orig FROM m GROUP BY 1),
 p AS (SELECT a.*, coalesce(n, 0) AS bars_seen, coalesce(opp, 0) AS opposite, coalesce(orig, 0) AS original, CASE WHEN n IS NULL THEN 'UNRESOLVABLE' WHEN o1 = o2 THEN 'AMBIGUOUS' WHEN o1 IS NOT NULL AND (o2 IS NULL OR o1 < o2) THEN 'TRUE_RELEASE' WHEN o2 IS NOT NULL THEN 'FALSE_RELEASE' ELSE 'INCONCLUSIVE' END AS outcome FROM a LEFT JOIN g ON a.id = g.id)"""


def _paths(s, d):
    return R.release_paths(frame(s, d), 8 * T.HOUR, 8)


@query(f"{_PATH} SELECT symbol, start_ms, side, outcome, bars_seen, round(opposite, 6) AS opposite, round(original, 6) AS original FROM p")
def release_path_label(s, d):
    """Which threshold was reached first after each bar."""
    return _paths(s, d).select("symbol", "start_ms", "side", "outcome", F.col("bars_seen").cast("long").alias("bars_seen"), r("opposite"), r("original"))


_DIMS = "(SELECT * FROM (VALUES ('ALL'), ('TRAIN'), ('VALIDATION'), ('OOS')) p(period), (VALUES ('LONG'), ('SHORT')) s(side), (VALUES ('TRUE_RELEASE'), ('FALSE_RELEASE'), ('AMBIGUOUS'), ('INCONCLUSIVE'), ('UNRESOLVABLE')) o(outcome))"


@query(f"{_PATH}, q AS (SELECT period, side, outcome FROM p UNION ALL SELECT 'ALL', side, outcome FROM p), c AS (SELECT period, side, outcome, count(*) AS cases FROM q GROUP BY 1, 2, 3) SELECT d.period, d.side, d.outcome, coalesce(cases, 0) AS cases FROM {_DIMS} d LEFT JOIN c ON d.period = c.period AND d.side = c.side AND d.outcome = c.outcome")
def release_summary_cube(s, d):
    """Cases by period, side and outcome, empty groups too."""
    counted = R.with_all(_paths(s, d)).groupBy("period", "side", "outcome").agg(F.count("*").alias("cases"))
    dims = {"period": ["ALL", "TRAIN", "VALIDATION", "OOS"], "side": ["LONG", "SHORT"], "outcome": ["TRUE_RELEASE", "FALSE_RELEASE", "AMBIGUOUS", "INCONCLUSIVE", "UNRESOLVABLE"]}
    return R.with_empty_groups(counted, dims, ["cases"])


@query(f"""{FRAME}, e AS (SELECT *, start_ms - start_ms % 86400000 AS day, lag(low) OVER ({_W}) AS low1, lag(close) OVER ({_W}) AS close1 FROM f),
 g AS (SELECT symbol, day, min(CASE WHEN close < open THEN start_ms END) AS r1, min(CASE WHEN low < low1 THEN start_ms END) AS r2, min(CASE WHEN close < mean20 THEN start_ms END) AS r3, min(CASE WHEN slope < 0 THEN start_ms END) AS r4, min(CASE WHEN close < close1 AND close < open THEN start_ms END) AS r5 FROM e WHERE long_score > short_score OR long_score IS NULL GROUP BY 1, 2),
 u AS (UNPIVOT g ON r1, r2, r3, r4, r5 INTO NAME rule VALUE first) SELECT symbol, day, CASE rule WHEN 'r1' THEN 'BAR' WHEN 'r2' THEN 'LOW' WHEN 'r3' THEN 'MEAN' WHEN 'r4' THEN 'SLOPE' ELSE 'TWO_BARS' END AS rule, first FROM u WHERE first IS NOT NULL""")
def rule_event_detection(s, d):
    """Of each day the first bar that satisfies each of five rules while the old score still leads."""
    w, c = Window.partitionBy("symbol").orderBy("start_ms"), F.col
    e = frame(s, d).withColumns({"day": c("start_ms") - c("start_ms") % T.DAY, "low1": F.lag("low").over(w), "close1": F.lag("close").over(w)}).where("long_score > short_score OR long_score IS NULL")
    rules = {"BAR": c("close") < c("open"), "LOW": c("low") < c("low1"), "MEAN": c("close") < c("mean20"), "SLOPE": c("slope") < 0, "TWO_BARS": (c("close") < c("close1")) & (c("close") < c("open"))}
    return R.first_by_rule(e, ["symbol", "day"], "start_ms", rules)


@query(f"{FRAME} SELECT symbol, start_ms, period, ret, round(abs(ret) / atr, 6) AS move_atr, CASE WHEN ret > 0 THEN 'LONG' ELSE 'SHORT' END AS missed_side FROM f WHERE greatest(long_score, short_score) < 58 AND abs(ret) / atr >= 0.75")
def missed_opportunities(s, d):
    """Bars without a trade that moved 0.75 ATR or more."""
    f = frame(s, d).where((F.greatest("long_score", "short_score") < 58) & (F.abs("ret") / F.col("atr") >= 0.75))
    return f.select("symbol", "start_ms", "period", "ret", r(F.abs("ret") / F.col("atr"), "move_atr"), F.when(F.col("ret") > 0, "LONG").otherwise("SHORT").alias("missed_side"))


@query(f"""{FRAME}, n AS (SELECT period, greatest(long_score, short_score) AS score, CASE WHEN long_score >= short_score THEN ret ELSE -ret END AS r FROM f WHERE long_score IS NOT NULL AND greatest(long_score, short_score) < 76),
 t AS (SELECT * FROM (VALUES ('GOD', 74), ('GOD', 72), ('GOD', 70), ('GOD', 68), ('CHILL', 58), ('CHILL', 56), ('CHILL', 54)) v(class, threshold)), p AS (SELECT * FROM n UNION ALL SELECT 'ALL', score, r FROM n)
SELECT period, class, threshold, count(*) FILTER (WHERE score >= threshold) AS cases, count(*) FILTER (WHERE score >= threshold AND score < CASE class WHEN 'GOD' THEN 74 ELSE 58 END) AS additional_vs_current, round(avg(r) FILTER (WHERE score >= threshold), 6) AS mean FROM p, t GROUP BY 1, 2, 3""")
def counterfactual_thresholds(s, d):
    """X11: what lower thresholds would have let in; the side is the score's, never the outcome's."""
    f = frame(s, d).where("long_score IS NOT NULL AND greatest(long_score, short_score) < 76").withColumns({"score": F.greatest("long_score", "short_score"), "r": F.when(F.col("long_score") >= F.col("short_score"), F.col("ret")).otherwise(-F.col("ret"))})
    levels = [("GOD", t, 74) for t in (74, 72, 70, 68)] + [("CHILL", t, 58) for t in (58, 56, 54)]
    rows = R.with_all(f.select("period", "score", "r")).select("*", F.inline(F.array(*(F.struct(F.lit(c).alias("class"), F.lit(t).alias("threshold"), F.lit(now).alias("now")) for c, t, now in levels))))
    hit = F.col("score") >= F.col("threshold")
    return rows.groupBy("period", "class", "threshold").agg(F.count_if(hit).alias("cases"), F.count_if(hit & (F.col("score") < F.col("now"))).alias("additional_vs_current"), r(F.avg(F.when(hit, F.col("r"))), "mean"))


_CAUSES = ["LOW_SCORE", "WIDE_SPREAD", "FLAT", "THIN"]


@query(f"""{FRAME}, k AS (SELECT period, concat_ws(';', CASE WHEN greatest(long_score, short_score) < 58 THEN 'LOW_SCORE' END, CASE WHEN avg_spread > 0.08 THEN 'WIDE_SPREAD' END, CASE WHEN abs(slope) < 0.5 THEN 'FLAT' END, CASE WHEN ticks < 3 THEN 'THIN' END) AS causes FROM f),
 x AS (SELECT period, unnest(string_split(causes, ';')) AS cause, generate_subscripts(string_split(causes, ';'), 1) = 1 AS dominant FROM k WHERE causes <> ''), y AS (SELECT * FROM x UNION ALL SELECT 'ALL', cause, dominant FROM x),
 c AS (SELECT period, cause, count(*) FILTER (WHERE dominant) AS dominant, count(*) FILTER (WHERE NOT dominant) AS contributing FROM y GROUP BY 1, 2)
SELECT p.period, v.cause, coalesce(dominant, 0) AS dominant, coalesce(contributing, 0) AS contributing FROM (VALUES ('ALL'), ('TRAIN'), ('VALIDATION'), ('OOS')) p(period) CROSS JOIN (VALUES ('LOW_SCORE'), ('WIDE_SPREAD'), ('FLAT'), ('THIN')) v(cause) LEFT JOIN c ON c.period = p.period AND c.cause = v.cause""")
def cause_table(s, d):
    """Dominant and contributing causes, empty groups too."""
    flags = zip((F.greatest("long_score", "short_score") < 58, F.col("avg_spread") > 0.08, F.abs("slope") < 0.5, F.col("ticks") < 3), _CAUSES)
    rows = R.exploded_causes(frame(s, d).select("period", F.concat_ws(";", *(F.when(c, n) for c, n in flags)).alias("causes")), "causes")
    counted = R.with_all(rows).groupBy("period", "cause").agg(F.count_if("dominant").alias("dominant"), F.count_if(~F.col("dominant")).alias("contributing"))
    return R.with_empty_groups(counted, {"period": ["ALL", "TRAIN", "VALIDATION", "OOS"], "cause": _CAUSES}, ["dominant", "contributing"])


@query(f"""{FRAME}, x AS (SELECT period, 'LONG' AS side, long_score AS score, ret FROM f WHERE long_score IS NOT NULL UNION ALL SELECT period, 'SHORT', short_score, -ret FROM f WHERE short_score IS NOT NULL), y AS (SELECT * FROM x UNION ALL SELECT 'ALL', side, score, ret FROM x)
SELECT period, side, CASE WHEN score < 40 THEN '0-40' WHEN score < 58 THEN '40-58' WHEN score < 74 THEN '58-74' ELSE '74-101' END AS bucket, count(*) AS cases, round(avg(ret), 6) AS mean, round(avg(CASE WHEN ret IS NOT NULL THEN CAST(ret > 0 AS INT) END), 6) AS win_share FROM y GROUP BY 1, 2, 3""")
def score_bucket_sides(s, d):
    """Both sides' scores by bucket, period and ALL."""
    rows = R.with_all(R.by_side(frame(s, d).drop("side"), "long_score", "short_score"))
    rows = rows.withColumn("ret", F.when(F.col("side") == "SHORT", -F.col("ret")).otherwise(F.col("ret"))).withColumn("bucket", X.edge_bucket(F.col("score"), [0, 40, 58, 74, 101]))
    return rows.groupBy("period", "side", "bucket").agg(F.count("*").alias("cases"), r(F.avg("ret"), "mean"), r(F.avg((F.col("ret") > 0).cast("int")), "win_share"))


@query(f"""{FRAME}, g AS (SELECT period, side, ret, CASE WHEN slope IS NULL THEN 'INACTIVE' WHEN abs(slope) >= 0.5 THEN 'ACTIVE' ELSE 'INACTIVE' END AS trend, CASE WHEN (slope > 0) = (side = 'LONG') THEN 'SAME_DIRECTION' ELSE 'OTHER' END AS direction, CASE WHEN (close > mean20) = (side = 'LONG') THEN 'ALIGNED' ELSE 'NOT_ALIGNED' END AS mean_side FROM f)
SELECT period, trend, direction, mean_side, count(*) AS cases, round(avg(CASE WHEN side = 'SHORT' THEN -ret ELSE ret END), 6) AS mean FROM g GROUP BY 1, 2, 3, 4""")
def feature_alignment(s, d):
    """X15."""
    c, long = F.col, F.col("side") == "LONG"
    yes = lambda cond, a, b: F.when(F.coalesce(cond, F.lit(False)), a).otherwise(b)
    g = frame(s, d).select("period", "side", "ret", yes(F.abs("slope") >= 0.5, "ACTIVE", "INACTIVE").alias("trend"), yes((c("slope") > 0) == long, "SAME_DIRECTION", "OTHER").alias("direction"), yes((c("close") > c("mean20")) == long, "ALIGNED", "NOT_ALIGNED").alias("mean_side"))
    return g.groupBy("period", "trend", "direction", "mean_side").agg(F.count("*").alias("cases"), r(F.avg(F.when(~long, -c("ret")).otherwise(c("ret"))), "mean"))


_STAB = f"{_PATH}, q AS (SELECT symbol, period, count(*) AS n, 100 * avg(CASE WHEN outcome = 'FALSE_RELEASE' THEN 1.0 ELSE 0.0 END) AS pct, avg(ret) AS mean FROM p GROUP BY 1, 2)"


@query(f"{_STAB} SELECT symbol, round(max(pct) - min(pct), 6) AS spread_pp, round(max(pct) - min(pct), 6) <= 5 AS stable, count(*) = 3 AND min(n) >= 30 AND min(sign(mean)) = max(sign(mean)) AS agrees FROM q GROUP BY 1")
def stability_findings(s, d):
    """Spread of a share over the periods, and whether the mean keeps its sign."""
    q = _paths(s, d).groupBy("symbol", "period").agg(F.count("*").alias("n"), (100 * F.avg((F.col("outcome") == "FALSE_RELEASE").cast("double"))).alias("pct"), F.avg("ret").alias("mean"))
    out = q.groupBy("symbol").agg(r(F.max("pct") - F.min("pct"), "spread_pp")).withColumn("stable", F.col("spread_pp") <= 5)
    return out.join(R.sign_agreement(q, ["symbol"], "mean", "n", 30), "symbol")


@query(f"""{FRAME}, i AS (SELECT *, row_number() OVER ({_W}) AS idx FROM f), j AS (SELECT a.symbol, a.start_ms, a.side, a.idx, a.close, min(b.idx) AS flip FROM i a JOIN i b ON a.symbol = b.symbol AND b.idx > a.idx AND b.idx <= a.idx + 30 AND b.side <> a.side GROUP BY 1, 2, 3, 4, 5)
SELECT j.symbol, j.start_ms, j.side, flip - j.idx AS lead_bars, round(CASE WHEN j.side = 'LONG' THEN j.close - min(k.low) ELSE max(k.high) - j.close END, 6) AS adverse FROM j JOIN i k ON k.symbol = j.symbol AND k.idx > j.idx AND k.idx <= flip GROUP BY j.symbol, j.start_ms, j.side, flip, j.idx, j.close""")
def stale_lead_adverse(s, d):
    """Bars until the side flips (30 at most are looked at) and the worst move up to and with the flip."""
    later = R.following(30, ["side", "low", "high"])
    f = frame(s, d).withColumn("later", later)
    flips = F.transform("later", lambda b: b.side != F.col("side"))
    f = f.withColumn("lead_bars", F.array_position(flips, True)).where("lead_bars > 0")
    seen = F.slice("later", 1, F.col("lead_bars").cast("int"))
    adverse = F.when(F.col("side") == "LONG", F.col("close") - F.array_min(F.transform(seen, lambda b: b.low))).otherwise(F.array_max(F.transform(seen, lambda b: b.high)) - F.col("close"))
    return f.select("symbol", "start_ms", "side", "lead_bars", r(adverse, "adverse"))


_ARM = f"{FRAME}, a AS (SELECT period, side, CASE WHEN abs(slope) >= 0.5 THEN 'MOMENTUM' ELSE 'RANGE' END AS setup, CASE WHEN side = 'SHORT' THEN -ret ELSE ret END AS r FROM f)"


@query(f"""{_ARM}, g AS (SELECT a.period, CASE WHEN grouping(a.side) = 1 THEN 'ALL' ELSE a.side END AS side, CASE WHEN grouping(a.setup) = 1 THEN 'ALL' ELSE a.setup END AS setup, count(r) AS labels, round(-avg(r), 6) AS delta FROM a GROUP BY GROUPING SETS ((a.period), (a.period, a.side), (a.period, a.setup)))
SELECT period, side, setup, labels, delta, CASE WHEN period <> 'OOS' THEN 'NOT_OOS' WHEN labels < 30 THEN 'INSUFFICIENT' WHEN delta > 0 THEN 'INVALIDATE' ELSE 'KEEP' END AS recommendation FROM g""")
def armed_summary(s, d):
    """What invalidating would have saved, by period with ALL, side or setup, and a recommendation from OOS."""
    a = frame(s, d).select("period", "side", F.when(F.abs("slope") >= 0.5, "MOMENTUM").otherwise("RANGE").alias("setup"), F.when(F.col("side") == "SHORT", -F.col("ret")).otherwise(F.col("ret")).alias("r"))
    parts = [("ALL", "ALL"), ("side", "ALL"), ("ALL", "setup")]
    pick = lambda n: F.lit("ALL") if n == "ALL" else F.col(n)
    rows = a.select("period", "r", F.inline(F.array(*(F.struct(pick(x).alias("side"), pick(y).alias("setup")) for x, y in parts))))
    out = rows.groupBy("period", "side", "setup").agg(F.count("r").alias("labels"), r(-F.avg("r"), "delta"))
    return out.withColumn("recommendation", X.first_rule([(F.col("period") != "OOS", "NOT_OOS"), (F.col("labels") < 30, "INSUFFICIENT"), (F.col("delta") > 0, "INVALIDATE")], "KEEP"))


@query()
def runtime_target_v2(s, d):
    """Target by class, cut before an obstacle, and its reward multiple. Tested against a brute-force version."""
    w, c = Window.partitionBy("symbol").orderBy("start_ms"), F.col
    z = frame(s, d).where("atr > 0").withColumns({"top": F.max("high").over(w.rowsBetween(-20, -1)), "bottom": F.min("low").over(w.rowsBetween(-20, -1)), "class": F.when(c("ticks") % 2 == 0, "GOD").otherwise("CHILL"), "way": F.when(c("side") == "LONG", 1).otherwise(-1), "entry": F.round("close", 2)})
    z = z.withColumns({"stop": c("entry") - c("way") * F.round("atr", 2), "obstacle": F.when(c("way") == 1, c("top")).otherwise(c("bottom"))})
    target, reason = V.runtime_target(c("way"), c("class"), c("entry"), c("stop"), c("atr"), c("obstacle"))
    return z.select("symbol", "start_ms", "side", "class", r("entry"), r("stop"), r("atr"), r("obstacle"), r(target, "target", 4), reason.alias("reason"), r(V.reward_risk(c("way"), c("entry"), c("stop"), target), "reward_risk", 4))


@query("SELECT p_partkey, CASE WHEN p_size % 11 = 0 OR p_size % 7 = 0 OR p_size % 5 >= 2 OR p_size % 3 = 0 AND p_size % 2 = 0 THEN 'HIGH' WHEN p_size % 3 = 0 OR p_partkey % 4 = 0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM part")
def zone_confidence_label(s, d):
    """Confidence of a zone by its evidence, here flags made of part sizes."""
    size = F.col("p_size")
    return table(s, d, "part").select("p_partkey", V.zone_confidence(size % 11 == 0, size % 7 == 0, size % 5, size % 3 == 0, size % 2 == 0, F.col("p_partkey") % 4 == 0).alias("confidence"))


@query("""WITH q AS (SELECT c_custkey, CAST(c_acctbal / 50 AS INT) % 101 AS bias, c_custkey % 101 AS confidence, CASE c_custkey % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk, CASE WHEN c_custkey % 4 = 0 THEN 'neutral' WHEN c_acctbal > 0 THEN 'long' ELSE 'short' END AS declared, c_nationkey % 4 AS ok, c_custkey % 4 AS n, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END AS way, c_custkey % 9 <> 0 AS fresh FROM customer),
 l AS (SELECT *, CASE WHEN bias > 20 THEN 1 WHEN bias < -20 THEN -1 ELSE 0 END AS leaning FROM q)
SELECT c_custkey, CASE WHEN NOT fresh OR risk = 'HIGH' THEN -1 WHEN NOT (leaning = 1 AND declared = 'long' OR leaning = -1 AND declared = 'short') OR confidence < 50 THEN 0 ELSE CASE WHEN leaning = way THEN 1 ELSE -1 END * CASE WHEN risk = 'LOW' AND n >= 2 AND ok >= 2 AND ok <= n AND confidence >= 70 AND abs(bias) >= 50 THEN 3 ELSE 1 END END AS points FROM l""".replace("CAST(c_acctbal / 50 AS INT)", "CAST(trunc(c_acctbal / 50) AS INT)"))
def news_context_points(s, d):
    """Points of the context of news, here customers as items."""
    c = F.col
    q = table(s, d, "customer").select(
        "c_custkey", ((c("c_acctbal") / 50).cast("int") % 101).alias("bias"), (c("c_custkey") % 101).alias("confidence"), F.when(c("c_custkey") % 5 == 0, "HIGH").when(c("c_custkey") % 5 == 1, "MEDIUM").otherwise("LOW").alias("risk"),
        F.when(c("c_custkey") % 4 == 0, "neutral").when(c("c_acctbal") > 0, "long").otherwise("short").alias("declared"), (c("c_nationkey") % 4).alias("ok"), (c("c_custkey") % 4).alias("n"), F.when(c("c_custkey") % 2 == 0, 1).otherwise(-1).alias("way"), (c("c_custkey") % 9 != 0).alias("fresh"),
    )
    return q.select("c_custkey", V.context_points(c("bias"), c("confidence"), c("risk"), c("declared"), c("ok"), c("n"), c("way"), c("fresh")).alias("points"))


_TEXTS = ["Order_Filled at market", "margin too low", "news ahead", "spread above limit", "score final 41", "nothing", "señal simulada", "drawdown reached"]
_PICK = "CASE o_orderkey % 8 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_TEXTS)) + " END"


@query(f"""WITH q AS (SELECT o_orderstatus, lower({_PICK}) AS t, CASE o_custkey % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN '' WHEN 2 THEN 'MARGIN_CHECK_FAILED' ELSE 'DAILY_LOSS' END AS block, o_custkey % 2 = 0 AS live FROM orders),
 r AS (SELECT o_orderstatus, CASE WHEN live AND t LIKE 'order_filled%' THEN 'TRADE_TAKEN' WHEN t = 'señal simulada' THEN 'NO_TRADE' WHEN t LIKE 'margin%' THEN 'BLOCKED_MARGIN' WHEN t LIKE 'news%' THEN 'BLOCKED_NEWS' WHEN block = 'MARGIN_CHECK_FAILED' THEN 'BLOCKED_MARGIN' WHEN block = 'DAILY_LOSS' THEN 'BLOCKED_RISK' WHEN t LIKE 'spread%' OR t LIKE 'drawdown%' THEN 'BLOCKED_RISK' WHEN t LIKE 'score final%' THEN 'INSUFFICIENT_SCORE' ELSE 'NO_TRADE' END AS outcome FROM q)
SELECT o_orderstatus, outcome, count(*) AS cases FROM r GROUP BY 1, 2""")
def decision_taxonomy(s, d):
    """Decisions by text and block code, here texts dealt to orders."""
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    block = F.element_at(F.array(*map(F.lit, ["NONE", "", "MARGIN_CHECK_FAILED", "DAILY_LOSS"])), (F.col("o_custkey") % 4 + 1).cast("int"))
    q = table(s, d, "orders").select("o_orderstatus", V.decision_outcome(text, block, F.col("o_custkey") % 2 == 0).alias("outcome"))
    return q.groupBy("o_orderstatus", "outcome").agg(F.count("*").alias("cases"))


_LEDGER = """WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag AS session, CASE WHEN l_suppkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side, CASE l_partkey % 7 WHEN 0 THEN 'TP' WHEN 1 THEN 'SL' WHEN 2 THEN 'WEB' WHEN 3 THEN 'EXPERT' WHEN 4 THEN 'SO' WHEN 5 THEN 'ROLLOVER' END AS code,
 CASE WHEN l_partkey % 50 <> 0 THEN round(CAST(l_extendedprice AS DOUBLE) * (CAST(l_discount AS DOUBLE) - 0.05), 4) END AS net, CAST(l_extendedprice AS DOUBLE) AS asked, round(CAST(l_extendedprice AS DOUBLE) * (1 + CAST(l_tax AS DOUBLE)), 4) AS got FROM lineitem)"""


def _ledger(s, d):
    c = F.col
    code = X.first_rule([(c("l_partkey") % 7 == k, v) for k, v in enumerate(["TP", "SL", "WEB", "EXPERT", "SO", "ROLLOVER"])])
    price = c("l_extendedprice").cast("double")
    return table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", c("l_returnflag").alias("session"), F.when(c("l_suppkey") % 2 == 0, "LONG").otherwise("SHORT").alias("side"), code.alias("code"),
        F.when(c("l_partkey") % 50 != 0, F.round(price * (c("l_discount").cast("double") - 0.05), 4)).alias("net"), price.alias("asked"), F.round(price * (1 + c("l_tax").cast("double")), 4).alias("got"),
    )


@query(f"""{_LEDGER}, n AS (SELECT *, CASE WHEN code IS NULL THEN 'UNKNOWN' WHEN code IN ('TP', 'SL') THEN code WHEN code = 'WEB' THEN 'MANUAL' WHEN code = 'EXPERT' THEN 'EA_CLOSE' WHEN code = 'SO' THEN 'BROKER' ELSE 'OTHER' END AS reason, CASE side WHEN 'LONG' THEN got - asked ELSE asked - got END AS slip FROM l)
SELECT reason, side, count(*) AS cases, round(avg(slip), 4) AS slippage FROM n GROUP BY 1, 2""")
def close_reasons(s, d):
    """Why positions closed and the signed slippage, here lineitems as deals."""
    n = _ledger(s, d).select("side", V.close_reason(F.col("code")).alias("reason"), V.signed_slippage(F.col("side"), F.col("asked"), F.col("got")).alias("slip"))
    return n.groupBy("reason", "side").agg(F.count("*").alias("cases"), r(F.avg("slip"), "slippage", 4))


_STATS = "count(*) AS trades, count(net) AS known, count(*) - count(net) AS unknown, count(*) FILTER (WHERE net > 0) AS wins, count(*) FILTER (WHERE net < 0) AS losses, count(*) FILTER (WHERE net = 0) AS breakeven, round(100.0 * count(*) FILTER (WHERE net > 0) / nullif(count(net), 0), 4) AS win_rate, CASE WHEN count(net) = count(*) THEN round(sum(net), 2) END AS net_pnl, round(coalesce(sum(net) FILTER (WHERE net > 0), 0) / nullif(-sum(net) FILTER (WHERE net < 0), 0), 6) AS profit_factor, max(net) FILTER (WHERE net > 0) AS max_win, min(net) FILTER (WHERE net < 0) AS max_loss"


@query(f"{_LEDGER} SELECT CASE WHEN grouping(l.session) = 1 THEN 'ALL' ELSE l.session END AS session, CASE WHEN grouping(l.side) = 1 THEN 'ALL' ELSE l.side END AS side, {_STATS} FROM l GROUP BY CUBE (l.session, l.side)")
def ledger_segments(s, d):
    """Statistics of a ledger by segment with ALL; sums only where every cost is known."""
    net, won, lost = F.col("net"), F.col("net") > 0, F.col("net") < 0
    aggs = [
        F.count("*").alias("trades"), F.count("net").alias("known"), (F.count("*") - F.count("net")).alias("unknown"), F.count_if(won).alias("wins"), F.count_if(lost).alias("losses"), F.count_if(net == 0).alias("breakeven"),
        r(F.when(F.count("net") > 0, 100.0 * F.count_if(won) / F.count("net")), "win_rate", 4), r(F.when(F.count("net") == F.count("*"), F.sum("net")), "net_pnl", 2), r(S.profit_factor("net"), "profit_factor"), F.max(F.when(won, net)).alias("max_win"), F.min(F.when(lost, net)).alias("max_loss"),
    ]
    return S.grouping_all(_ledger(s, d), ["session", "side"], aggs)


@query(f"WITH {TICKS}, q AS (SELECT user_id % 10 AS file, CASE WHEN event_id % 97 = 0 THEN 'timestamp' WHEN event_id % 31 = 0 THEN 'bid_or_ask' WHEN event_id % 89 = 0 THEN 'ask_below_bid' ELSE 'accepted' END AS reason FROM ticks) SELECT file, reason, count(*) AS rows FROM q GROUP BY 1, 2")
def ingestion_counters(s, d):
    """Rows of each file by fault, or accepted."""
    t, i = ticks(s, d), F.col("event_id")
    bid, ask = F.when(i % 31 == 0, F.lit(-1.0)).otherwise(F.lit(10.0)), F.when((i % 89 == 0) & (i % 31 != 0), F.lit(9.0)).otherwise(F.lit(11.0))
    reason = F.coalesce(X.quote_fault(bid, ask, F.when(i % 97 != 0, F.col("ts_ms"))), F.lit("accepted"))
    return t.select((F.col("user_id") % 10).alias("file"), reason.alias("reason")).groupBy("file", "reason").agg(F.count("*").alias("rows"))


@query("SELECT o_orderkey, CASE WHEN trim(upper(f)) IN ('', 'NONE', 'NULL', 'FALSE', '0', 'NO', 'UNKNOWN', 'N/A') OR f IS NULL THEN false ELSE true END AS active FROM (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'none' WHEN 1 THEN ' ' WHEN 2 THEN 'Breakout' WHEN 3 THEN NULL WHEN 4 THEN 'no ' WHEN 5 THEN 'yes' ELSE 'n/a' END AS f FROM orders)")
def active_flags(s, d):
    """P6."""
    flag = F.element_at(F.array(*(F.lit(x) for x in ["none", " ", "Breakout", None, "no ", "yes", "n/a"])), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(s, d, "orders").select("o_orderkey", V.active(flag).alias("active"))


@query(f"""{FRAME}, q AS (SELECT symbol, start_ms, CASE WHEN close > mean20 THEN 20 ELSE 0 END AS trend, CASE WHEN slope > 0 THEN 15 ELSE 0 END AS slope_points, CASE WHEN ticks >= 3 THEN 5 ELSE 0 END AS volume, CAST(round(long_score) AS INT) AS published FROM f WHERE long_score IS NOT NULL)
SELECT *, published - trend - slope_points - volume AS residual, published - trend - slope_points - volume = 0 AS exact FROM q""")
def score_decomposition(s, d):
    """Points by component, the rest of the published score, and whether nothing is left."""
    c = F.col
    yes = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    q = frame(s, d).where("long_score IS NOT NULL").select("symbol", "start_ms", yes(c("close") > c("mean20"), 20).alias("trend"), yes(c("slope") > 0, 15).alias("slope_points"), yes(c("ticks") >= 3, 5).alias("volume"), F.round("long_score").cast("int").alias("published"))
    return q.withColumn("residual", c("published") - c("trend") - c("slope_points") - c("volume")).withColumn("exact", c("residual") == 0)


@query(f"{FRAME}, o AS (SELECT symbol, start_ms - start_ms % 86400000 AS day, arg_min(open, start_ms) AS session_open FROM f GROUP BY 1, 2) SELECT f.symbol, f.start_ms, round((close - session_open) / atr, 6) AS impulse FROM f JOIN o ON f.symbol = o.symbol AND f.start_ms - f.start_ms % 86400000 = o.day")
def opening_impulse(s, d):
    """The move since the session's open, in ATR; the session's first bar is looked up in a window."""
    day = Window.partitionBy("symbol", F.col("start_ms") - F.col("start_ms") % T.DAY).orderBy("start_ms")
    return frame(s, d).select("symbol", "start_ms", r((F.col("close") - F.first("open").over(day)) / F.col("atr"), "impulse"))


@query("""SELECT c_custkey, CAST(round(100.0 * ((c_name <> '')::INT + (c_acctbal IS NOT NULL)::INT + (c_custkey % 3 <> 0)::INT + (c_acctbal > 0)::INT + (n.n_nationkey IS NOT NULL)::INT + (o.n IS NOT NULL)::INT + (coalesce(o.n, 0) > 5)::INT + (c_custkey % 2 = 0)::INT + (c_custkey % 5 = 0)::INT + (c_nationkey % 2 = 0)::INT) / 10) AS INT) AS quality
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey LEFT JOIN nation n ON n_nationkey = c_nationkey AND n_regionkey <> 2""")
def trader_quality(s, d):
    """Share of ten checks that a profile passes, here customers as traders."""
    c = F.col
    o = table(s, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    n = table(s, d, "nation").where("n_regionkey <> 2").select(c("n_nationkey").alias("c_nationkey"), F.lit(True).alias("known"))
    q = table(s, d, "customer").join(o, "c_custkey", "left").join(n, "c_nationkey", "left")
    checks = [c("c_name") != "", c("c_acctbal").isNotNull(), c("c_custkey") % 3 != 0, c("c_acctbal") > 0, c("known"), c("n").isNotNull(), c("n") > 5, c("c_custkey") % 2 == 0, c("c_custkey") % 5 == 0, c("c_nationkey") % 2 == 0]
    return q.select("c_custkey", V.presence_quality(*checks).alias("quality"))


@query("SELECT l_returnflag, count(*) AS rows FROM lineitem WHERE (l_partkey, l_returnflag) IN (SELECT p_partkey, CASE WHEN p_size < 25 THEN 'A' ELSE 'N' END FROM part WHERE p_size % 2 = 0) GROUP BY 1")
def instrument_whitelist(s, d):
    """Rows whose id and name both stand in the list (semi-join)."""
    allowed = table(s, d, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") < 25, "A").otherwise("N").alias("l_returnflag"))
    return table(s, d, "lineitem").join(allowed, ["l_partkey", "l_returnflag"], "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("rows"))


@query("SELECT o_custkey, CASE WHEN l_linenumber <= 2 THEN 'OWN' ELSE 'COPIED' END AS origin, count(*) AS positions, round(sum(CAST(l_quantity AS DOUBLE)), 4) AS units FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def portfolio_flatten(s, d):
    """Positions of a portfolio and of the trades it copies, out of nested arrays."""
    c = F.col
    line = table(s, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", c("l_quantity").cast("double").alias("units")).alias("p"), (c("l_linenumber") <= 2).alias("own"))
    nested = line.groupBy("l_orderkey").agg(F.collect_list(F.when(c("own"), c("p"))).alias("positions"), F.array(F.struct(F.collect_list(F.when(~c("own"), c("p"))).alias("positions"))).alias("social"))
    o = table(s, d, "orders").select("o_custkey", c("o_orderkey").alias("l_orderkey")).join(nested, "l_orderkey")
    own = o.select("o_custkey", F.lit("OWN").alias("origin"), F.inline("positions"))
    copied = o.select("o_custkey", F.explode("social").alias("t")).select("o_custkey", F.lit("COPIED").alias("origin"), F.inline("t.positions"))
    return own.union(copied).groupBy("o_custkey", "origin").agg(F.count("*").alias("positions"), r(F.sum("units"), "units", 4))


_TREE = r'''{"POSITION_CLOSE":"%s","children":["%s",{"type":"%s" , "note":"a \\"POSITION_CLOSE\\" b"}],"more":"POSITION_CLOSE "}'''
_NOW = "CASE WHEN l_returnflag IN ('A', 'R') THEN 'POSITION_CLOSED' ELSE 'OPEN' END"


@query("SELECT l_orderkey, l_linenumber, concat(" + ", ".join(f"'{part}'" for part in _TREE.split("%s")).replace("', '", f"', {_NOW}, '") + ") AS event FROM lineitem")
def alias_rewrite(s, d):
    """An old name, in any case, becomes the new one wherever it is a whole value of a JSON tree; keys and parts of texts stay."""
    old = F.when(F.col("l_returnflag") == "A", "position_close").when(F.col("l_returnflag") == "R", "POSITION_Close").otherwise("OPEN")
    parts = _TREE.split("%s")
    event = F.concat(F.lit(parts[0]), *(c for part in parts[1:] for c in (old, F.lit(part))))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", V.renamed_values(event, "POSITION_CLOSE", "POSITION_CLOSED").alias("event"))


@query(f"WITH {TICKS}, q AS (SELECT symbol, max(ts_ms) AS last_ms, count(*) AS n FROM ticks GROUP BY 1), z AS (SELECT max(ts_ms) AS now_ms FROM ticks) SELECT v.feed, CASE WHEN q.last_ms IS NULL THEN 'NO_DATA' WHEN (now_ms - last_ms) / 1000 > v.limit_s THEN 'STALE' ELSE 'ONLINE' END AS health, coalesce(n, 0) AS rows FROM (VALUES ('click', 60), ('view', 3600), ('purchase', 1), ('bond', 60)) v(feed, limit_s) LEFT JOIN q ON q.symbol = v.feed, z")
def source_health(s, d):
    """Each feed's state by its own limit; feeds without a row too."""
    t = ticks(s, d)
    feeds = s.createDataFrame([("click", 60), ("view", 3600), ("purchase", 1), ("bond", 60)], "feed string, limit_s int")
    seen = t.groupBy(F.col("symbol").alias("feed")).agg(F.max("ts_ms").alias("last_ms"), F.count("*").alias("rows"))
    now = t.agg(F.max("ts_ms")).first()[0]
    age = (F.lit(now) - F.col("last_ms")) / 1000
    return feeds.join(seen, "feed", "left").select("feed", V.health(age, F.col("limit_s")).alias("health"), F.coalesce("rows", F.lit(0)).alias("rows"))


_CONTRACT = {"price_positive": "CAST(l_extendedprice AS DOUBLE) > 0", "quantity_small": "l_quantity <= 45", "discount_known": "l_discount IS NOT NULL"}


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE NOT coalesce({c}, false)) AS broken FROM lineitem" for n, c in _CONTRACT.items()) + ")")
def contract_violations(s, d):
    """Rows that break each rule, in one scan; `enforce` fails on the first instead."""
    return R.violations(table(s, d, "lineitem"), {n: F.expr(c) for n, c in _CONTRACT.items()})


@query(f"{WITH} SELECT symbol, start_ms, round(close, 6) AS close FROM bars")
def causal_frame(s, d):
    """Bars that say that they come from closed minutes alone; any other provenance fails the job."""
    b = bars(s, d).withColumn("provenance", F.lit("CLOSED_M1_ONLY"))
    return b.select("symbol", "start_ms", r(V.causal(F.col("provenance"), F.col("close")), "close"))


@query(f"{FRAME} SELECT * FROM (SELECT 'atr' AS field, count(atr) AS present, count(*) - count(atr) AS missing FROM f UNION ALL SELECT 'slope', count(slope), count(*) - count(slope) FROM f UNION ALL SELECT 'ret', count(ret), count(*) - count(ret) FROM f UNION ALL SELECT 'long_score', count(long_score), count(*) - count(long_score) FROM f)")
def field_availability(s, d):
    """How many rows know each field; the rest is missing."""
    return R.availability(frame(s, d), ["atr", "slope", "ret", "long_score"])


@query(f"""{FRAME}, i AS (SELECT *, row_number() OVER ({_W}) AS idx, lag(close, 3) OVER ({_W}) AS close3, max(high) OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS top, low <= mean20 + 0.25 * atr AND high >= mean20 - 0.25 * atr AS touch FROM f),
 j AS (SELECT *, max(CASE WHEN touch THEN idx END) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS last_touch FROM i)
SELECT symbol, start_ms, idx - last_touch AS bars_since_pullback, coalesce(close < close3, false) AS counter_momentum, coalesce(close - top > 0.5 * atr, false) AS extended FROM j""")
def lower_frame_context(s, d):
    """Bars since the mean was touched (20 back), momentum against a long over 3 bars, breakout extended by half an ATR."""
    w, c = Window.partitionBy("symbol").orderBy("start_ms"), F.col
    i = frame(s, d).withColumns({"idx": F.row_number().over(w), "close3": F.lag("close", 3).over(w), "top": F.max("high").over(w.rowsBetween(-10, -1)), "touch": (c("low") <= c("mean20") + 0.25 * c("atr")) & (c("high") >= c("mean20") - 0.25 * c("atr"))})
    j = i.withColumn("last_touch", F.max(F.when(c("touch"), c("idx"))).over(w.rowsBetween(-20, 0)))
    yes = lambda x: F.coalesce(x, F.lit(False))
    return j.select("symbol", "start_ms", (c("idx") - c("last_touch")).cast("long").alias("bars_since_pullback"), yes(c("close") < c("close3")).alias("counter_momentum"), yes(c("close") - c("top") > 0.5 * c("atr")).alias("extended"))


_DET = f"""{FRAME}, i AS (SELECT *, row_number() OVER ({_W}) AS idx FROM f), a AS (SELECT symbol, idx, start_ms, side, close, atr, c.name AS candidate, c.k * atr AS risk, h.n AS horizon FROM i, (VALUES ('ATR_1_0', 1.0), ('ATR_1_5', 1.5), ('ATR_2_0', 2.0)) c(name, k), (VALUES (4), (12)) h(n) WHERE atr > 0),
 m AS (SELECT a.symbol, a.start_ms, a.candidate, a.horizon, any_value(risk) AS risk, any_value(a.side) AS side, any_value(a.atr) AS atr, max(CASE WHEN a.side = 'LONG' THEN b.high - a.close ELSE a.close - b.low END) AS mfe, min(CASE WHEN a.side = 'LONG' THEN b.low - a.close ELSE a.close - b.high END) AS mae,
   min(CASE WHEN CASE WHEN a.side = 'LONG' THEN a.close - b.low ELSE b.high - a.close END >= risk THEN b.idx END) AS stop_at, min(CASE WHEN CASE WHEN a.side = 'LONG' THEN b.high - a.close ELSE a.close - b.low END >= risk THEN b.idx END) AS r1_at
  FROM a JOIN i b ON a.symbol = b.symbol AND b.idx > a.idx AND b.idx <= a.idx + a.horizon GROUP BY 1, 2, 3, 4)"""


def _detail(s, d):
    c = F.col
    f = frame(s, d).withColumn("later", R.following(12, ["high", "low"])).where("atr > 0")
    choices = F.array(*(F.struct(F.lit(n).alias("candidate"), F.lit(k).alias("k"), F.lit(h).alias("horizon")) for n, k in (("ATR_1_0", 1.0), ("ATR_1_5", 1.5), ("ATR_2_0", 2.0)) for h in (4, 12)))
    rows = f.select("symbol", "start_ms", "side", "close", "atr", "later", F.inline(choices)).withColumns({"risk": c("k") * c("atr"), "seen": F.slice("later", 1, c("horizon"))}).where(F.size("seen") > 0)
    long = c("side") == "LONG"
    up = lambda b: F.when(long, b.high - c("close")).otherwise(c("close") - b.low)
    down = lambda b: F.when(long, c("close") - b.low).otherwise(b.high - c("close"))
    first = lambda move: F.nullif(F.array_position(F.transform("seen", lambda b: move(b) >= c("risk")), True), F.lit(0))
    return rows.withColumns({"mfe": F.array_max(F.transform("seen", up)), "mae": -F.array_max(F.transform("seen", down)), "stop_at": first(down), "r1_at": first(up)})


@query(f"{_DET} SELECT symbol, start_ms, candidate, horizon, stop_at IS NOT NULL AS stopped, r1_at IS NOT NULL AND (stop_at IS NULL OR r1_at < stop_at) AS r1_before_stop, round(mfe / atr, 6) AS mfe_atr, round(mae / atr, 6) AS mae_atr, round(mfe / risk, 6) AS mfe_r, round(mae / risk, 6) AS mae_r FROM m")
def stop_detail_rows(s, d):
    """A row for each signal, stop candidate and horizon, with hits and excursions in ATR and in risk. A tie loses."""
    c = F.col
    won = c("r1_at").isNotNull() & (c("stop_at").isNull() | (c("r1_at") < c("stop_at")))
    return _detail(s, d).select("symbol", "start_ms", "candidate", "horizon", c("stop_at").isNotNull().alias("stopped"), won.alias("r1_before_stop"), r(c("mfe") / c("atr"), "mfe_atr"), r(c("mae") / c("atr"), "mae_atr"), r(c("mfe") / c("risk"), "mfe_r"), r(c("mae") / c("risk"), "mae_r"))


@query(f"""{_DET} SELECT candidate, horizon, side, count(*) AS cases, count(stop_at) AS stopped, round(avg(CASE WHEN stop_at IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS stop_share, count(*) FILTER (WHERE r1_at IS NOT NULL AND (stop_at IS NULL OR r1_at < stop_at)) AS reached_1r, round(avg(mfe / risk), 6) AS mean_mfe_r, round(avg(mae / risk), 6) AS mean_mae_r,
 round(median(mfe / risk), 6) AS median_mfe_r, round(median(mae / risk), 6) AS median_mae_r, round(quantile_cont(mfe / risk, 0.9), 6) AS p90_mfe_r, round(quantile_cont(mae / risk, 0.1), 6) AS p10_mae_r, count(*) FILTER (WHERE stop_at = r1_at) AS same_bar, count(*) FILTER (WHERE stop_at IS NOT NULL AND r1_at > stop_at) AS premature, round(avg(risk), 6) AS mean_risk FROM m GROUP BY 1, 2, 3""")
def stop_quality_summary(s, d):
    """A5: what each stop candidate did, by horizon and side; premature: stopped, then the target was reached."""
    c = F.col
    won = c("r1_at").isNotNull() & (c("stop_at").isNull() | (c("r1_at") < c("stop_at")))
    f, a = c("mfe") / c("risk"), c("mae") / c("risk")
    return _detail(s, d).groupBy("candidate", "horizon", "side").agg(
        F.count("*").alias("cases"), F.count("stop_at").alias("stopped"), r(F.avg(c("stop_at").isNotNull().cast("double")), "stop_share"), F.count_if(won).alias("reached_1r"), r(F.avg(f), "mean_mfe_r"), r(F.avg(a), "mean_mae_r"), r(F.percentile(f, 0.5), "median_mfe_r"), r(F.percentile(a, 0.5), "median_mae_r"),
        r(F.percentile(f, 0.9), "p90_mfe_r"), r(F.percentile(a, 0.1), "p10_mae_r"), F.count_if(c("stop_at") == c("r1_at")).alias("same_bar"), F.count_if(c("stop_at").isNotNull() & (c("r1_at") > c("stop_at"))).alias("premature"), r(F.avg("risk"), "mean_risk"),
    )


@query(f"""{_DET}, i2 AS (SELECT symbol, start_ms, row_number() OVER ({_W}) AS idx, high, low, close FROM f), x AS (SELECT m.*, s.idx AS idx0, s.close FROM m JOIN i2 s ON s.symbol = m.symbol AND s.start_ms = m.start_ms WHERE r1_at IS NOT NULL AND (stop_at IS NULL OR r1_at < stop_at))
SELECT x.symbol, x.start_ms, candidate, horizon, round(min(CASE WHEN b.idx <= r1_at THEN CASE WHEN side = 'LONG' THEN b.low - x.close ELSE x.close - b.high END END) / any_value(risk), 6) AS mae_before_r, round(max(CASE WHEN b.idx > r1_at THEN CASE WHEN side = 'LONG' THEN b.high - x.close ELSE x.close - b.low END END) / any_value(risk) - 1, 6) AS beyond_target_r
FROM x JOIN i2 b ON b.symbol = x.symbol AND b.idx > idx0 AND b.idx <= idx0 + horizon GROUP BY 1, 2, 3, 4""")
def excursions_around_target(s, d):
    """The worst move up to the bar that reached the target, and how far the price went beyond it afterwards."""
    c = F.col
    x = _detail(s, d).where(c("r1_at").isNotNull() & (c("stop_at").isNull() | (c("r1_at") < c("stop_at"))))
    long, at = c("side") == "LONG", c("r1_at").cast("int")
    before, after = F.slice("seen", 1, at), F.slice("seen", at + 1, F.greatest(F.size("seen") - at, F.lit(0)))
    worst = F.array_max(F.transform(before, lambda b: F.when(long, c("close") - b.low).otherwise(b.high - c("close"))))
    best = F.array_max(F.transform(after, lambda b: F.when(long, b.high - c("close")).otherwise(c("close") - b.low)))
    return x.select("symbol", "start_ms", "candidate", "horizon", r(-worst / c("risk"), "mae_before_r"), r(best / c("risk") - 1, "beyond_target_r"))
