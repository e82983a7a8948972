"""Queries on joins in time, outcomes, barriers, summaries, rules, text, ledgers and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.functions import timebase as T
from tidemark.operators import barriers as A
from tidemark.operators import episodes as E
from tidemark.operators import indicators as I
from tidemark.operators import joins as J
from tidemark.operators import stats as S
from tidemark.operators import structure as P
from tidemark.operators import text as N
from tidemark.plans.base import TICKS, WITH, bars, query, r, scratch, table, ticks
from tidemark.plans.market import _PIV, W
from tidemark.sources import feeds
from tidemark.streaming import streams

T0 = f"WITH {TICKS}"


def _events(s, d):
    return ticks(s, d)


@query(f"{T0} SELECT c.event_id, v.event_id AS view_id, round(v.mid, 6) AS view_value FROM (SELECT * FROM ticks WHERE symbol = 'click') c ASOF LEFT JOIN (SELECT * FROM ticks WHERE symbol = 'view') v ON c.user_id = v.user_id AND v.ts_ms <= c.ts_ms")
def asof_backward(s, d):
    t = ticks(s, d)
    got = J.asof_backward(t.where("symbol = 'click'").select("event_id", "user_id", "ts_ms"), t.where("symbol = 'view'").select("user_id", F.col("ts_ms").alias("view_ms"), F.col("event_id").alias("view_id"), "mid"), "user_id", "ts_ms", "view_ms", ["view_id", "mid"])
    return got.select("event_id", F.col("asof_view_id").alias("view_id"), r(F.col("asof_mid"), "view_value"))


@query(f"{T0} SELECT c.event_id, v.event_id AS next_id, v.ts_ms AS next_ms FROM (SELECT * FROM ticks WHERE symbol = 'view') c ASOF LEFT JOIN (SELECT * FROM ticks WHERE symbol = 'purchase') v ON c.user_id = v.user_id AND v.ts_ms >= c.ts_ms")
def asof_forward_confirm(s, d):
    t = ticks(s, d)
    got = J.asof_forward(t.where("symbol = 'view'").select("event_id", "user_id", "ts_ms"), t.where("symbol = 'purchase'").select("user_id", F.col("ts_ms").alias("next_ms"), F.col("event_id").alias("next_id")), "user_id", "ts_ms", "next_ms", ["next_id"])
    return got.select("event_id", F.col("asof_next_id").alias("next_id"), F.col("asof_next_ms").alias("next_ms"))


@query(f"{WITH} SELECT t.event_id, b.start_ms, round(b.close, 6) AS close FROM ticks t ASOF LEFT JOIN (SELECT *, close_ms + 60000 AS available_ms FROM bars) b ON t.symbol = b.symbol AND b.available_ms <= t.ts_ms")
def availability_asof(s, d):
    b = bars(s, d).select("symbol", (F.col("close_ms") + 60_000).alias("available_ms"), "start_ms", "close")
    got = J.asof_backward(ticks(s, d).select("event_id", "symbol", "ts_ms"), b, "symbol", "ts_ms", "available_ms", ["start_ms", "close"])
    return got.select("event_id", F.col("asof_start_ms").alias("start_ms"), r(F.col("asof_close"), "close"))


@query(f"{T0} SELECT a.event_id, t.event_id AS entry_id, CASE WHEN t.ts_ms <= a.ts_ms + 14400000 THEN t.ask END AS entry FROM (SELECT event_id, ts_ms + 1 AS ts_ms, symbol FROM ticks) a ASOF LEFT JOIN ticks t ON a.symbol = t.symbol AND t.ts_ms >= a.ts_ms".replace("t.ask END", "round(t.ask, 6) END"))
def entry_tick_lookup(s, d):
    """The first tick at or after the anchor, within four hours for its price."""
    return _entry(ticks(s, d))


def _entry(t):
    a = t.select("event_id", (F.col("ts_ms") + 1).alias("at_ms"), "symbol")
    got = J.asof_forward(a, t.select("symbol", "ts_ms", F.col("event_id").alias("entry_id"), "ask"), "symbol", "at_ms", "ts_ms", ["entry_id", "ask"])
    return got.select("event_id", F.col("asof_entry_id").alias("entry_id"), F.round(F.when(F.col("asof_ts_ms") <= F.col("at_ms") + 4 * T.HOUR, F.col("asof_ask")), 6).alias("entry"))


HORIZONS = {"1h": T.HOUR, "4h": 4 * T.HOUR, "24h": T.DAY}
_OUT = f"""{WITH}, h AS (SELECT * FROM (VALUES ('1h', 3600000), ('4h', 14400000), ('24h', 86400000)) v(horizon, span)),
 a AS (SELECT concat(symbol, '-', start_ms) AS anchor_id, symbol, close_ms AS anchor_ms, close AS entry FROM bars),
 o AS (SELECT anchor_id, a.symbol, anchor_ms, horizon, arg_max(t.mid, (t.ts_ms, t.event_id)) - max(entry) AS ret, max(t.mid) - max(entry) AS mfe, min(t.mid) - max(entry) AS mae, max(t.spread) AS max_spread, count(t.ts_ms) AS n_ticks
  FROM a CROSS JOIN h LEFT JOIN ticks t ON t.symbol = a.symbol AND t.ts_ms > a.anchor_ms AND t.ts_ms <= a.anchor_ms + h.span GROUP BY 1, 2, 3, 4)"""


def _outcomes(s, d):
    a = bars(s, d).select(F.concat_ws("-", "symbol", F.col("start_ms").cast("string")).alias("anchor_id"), "symbol", F.col("close_ms").alias("anchor_ms"), F.col("close").alias("entry"))
    return J.outcomes(a, ticks(s, d), HORIZONS)


@query(f"{_OUT} SELECT anchor_id, horizon, round(ret, 6) AS ret, round(mfe, 6) AS mfe, round(mae, 6) AS mae, round(max_spread, 6) AS max_spread, n_ticks FROM o")
def interval_outcomes(s, d):
    return _outcomes(s, d).select("anchor_id", "horizon", r("ret"), r("mfe"), r("mae"), r("max_spread"), "n_ticks")


@query(f"{_OUT} SELECT anchor_id, horizon, CASE WHEN anchor_ms // 3600000 % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, round(CASE WHEN anchor_ms // 3600000 % 2 = 0 THEN ret ELSE -ret END, 6) AS ret, round(CASE WHEN anchor_ms // 3600000 % 2 = 0 THEN mfe ELSE -mae END, 6) AS mfe, round(CASE WHEN anchor_ms // 3600000 % 2 = 0 THEN mae ELSE -mfe END, 6) AS mae FROM o")
def interval_outcomes_direction(s, d):
    side = F.when((F.col("anchor_ms") / T.HOUR).cast("long") % 2 == 0, "LONG").otherwise("SHORT")
    df = _outcomes(s, d).withColumn("direction", side)
    return df.select("anchor_id", "horizon", "direction", *X.signed_outcome(F.col("direction"), F.col("ret"), F.col("mfe"), F.col("mae"))).select("anchor_id", "horizon", "direction", r("ret"), r("mfe"), r("mae"))


_SUM = "count(ret) AS cases, round(avg(ret), 6) AS mean, round(median(ret), 6) AS median, round(100 * avg(CASE WHEN ret IS NOT NULL THEN CAST(ret > 0 AS INT) END), 6) AS win_pct, round(100 * avg(CASE WHEN ret IS NOT NULL THEN CAST(ret < 0 AS INT) END), 6) AS loss_pct"


@query(f"{_OUT}, q AS (SELECT horizon, round(ret, 6) AS ret FROM o) SELECT horizon, {_SUM} FROM q GROUP BY 1")
def summary_returns(s, d):
    df = _outcomes(s, d).withColumn("ret", F.round("ret", 6))
    out = df.groupBy("horizon").agg(*S.returns_summary())
    return out.select("horizon", "cases", r("mean"), r("median"), r("win_pct"), r("loss_pct"))


@query(f"{_OUT}, q AS (SELECT symbol, horizon, round(ret, 6) AS ret FROM o) SELECT symbol, horizon, round(CASE WHEN sum(ret) FILTER (WHERE ret < 0) < 0 THEN coalesce(sum(ret) FILTER (WHERE ret > 0), 0) / -sum(ret) FILTER (WHERE ret < 0) END, 6) AS profit_factor, round(avg(ret), 6) AS expectancy FROM q GROUP BY 1, 2")
def profit_factor_expectancy(s, d):
    df = _outcomes(s, d).withColumn("ret", F.round("ret", 6))
    return df.groupBy("symbol", "horizon").agg(r(S.profit_factor("ret"), "profit_factor"), r(F.avg("ret"), "expectancy"))


def flagship(s, d):
    """Hourly bars, their 20-bar extremes, outcomes, and a summary by symbol and place in the range, with ALL."""
    b = I.prior_extremes(bars(s, d))
    state = X.first_rule([(F.col("close") > F.col("prior_high"), "ABOVE"), (F.col("close") < F.col("prior_low"), "BELOW")], "INSIDE")
    a = b.select(F.concat_ws("-", "symbol", F.col("start_ms").cast("string")).alias("anchor_id"), "symbol", F.col("close_ms").alias("anchor_ms"), F.col("close").alias("entry"), state.alias("state"))
    o = J.outcomes(a.drop("state"), ticks(s, d), {"4h": 4 * T.HOUR}).join(a.select("anchor_id", "state"), "anchor_id").withColumn("ret", F.round("ret", 6))
    out = S.grouping_all(o, ["symbol", "state"], S.returns_summary())
    return out.select("symbol", "state", "cases", r("mean"), r("median"), r("win_pct"), r("loss_pct"))


query(
    f"""{WITH}, p AS (SELECT *, max(high) OVER f AS ph, min(low) OVER f AS pl FROM bars WINDOW f AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
 a AS (SELECT symbol, start_ms, close_ms, close, CASE WHEN close > ph THEN 'ABOVE' WHEN close < pl THEN 'BELOW' ELSE 'INSIDE' END AS state FROM p),
 q AS (SELECT a.symbol, a.start_ms, state, round(arg_max(t.mid, (t.ts_ms, t.event_id)) - max(close), 6) AS ret FROM a LEFT JOIN ticks t ON t.symbol = a.symbol AND t.ts_ms > a.close_ms AND t.ts_ms <= a.close_ms + 14400000 GROUP BY 1, 2, 3)
SELECT CASE WHEN grouping(symbol) = 1 THEN 'ALL' ELSE symbol END AS symbol, CASE WHEN grouping(state) = 1 THEN 'ALL' ELSE state END AS state, {_SUM} FROM q GROUP BY CUBE (q.symbol, q.state)""".replace("grouping(symbol)", "grouping(q.symbol)").replace("grouping(state)", "grouping(q.state)").replace("ELSE symbol", "ELSE q.symbol").replace("ELSE state", "ELSE q.state"),
    "flagship",
)(flagship)


_TOUCH = f"""{WITH}, a AS (SELECT event_id AS anchor_id, symbol, ts_ms AS anchor_ms, ask AS entry, CASE WHEN event_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side FROM ticks),
 b AS (SELECT anchor_id, min(CASE WHEN side = 'LONG' AND t.bid <= entry * 0.5 OR side = 'SHORT' AND t.ask >= entry * 1.5 THEN t.ts_ms END) AS stop_ms, min(CASE WHEN side = 'LONG' AND t.bid >= entry * 1.5 OR side = 'SHORT' AND t.ask <= entry * 0.5 THEN t.ts_ms END) AS target_ms
  FROM a LEFT JOIN ticks t ON t.symbol = a.symbol AND t.ts_ms > anchor_ms AND t.ts_ms <= anchor_ms + 14400000 GROUP BY 1)"""


def _touch(t):
    """For each tick the first one after it at half its price, and the first at half as much again; a long one is closed at the bid, a short one at the ask."""
    long = F.col("event_id") % 2 == 0
    of, low, high = F.when(long, "bid").otherwise("ask"), F.col("ask") * 0.5, F.col("ask") * 1.5
    ends = {"stop_ms": (of, long, F.when(long, low).otherwise(high)), "target_ms": (of, ~long, F.when(long, high).otherwise(low))}
    return A.crossings_ahead(t, ends, ["bid", "ask"], 4 * T.HOUR).withColumnRenamed("event_id", "anchor_id")


@query(f"{_TOUCH} SELECT anchor_id, stop_ms, target_ms, CASE WHEN stop_ms IS NULL AND target_ms IS NULL THEN 'NEITHER' WHEN target_ms IS NULL OR stop_ms <= target_ms THEN 'STOP' ELSE 'TARGET' END AS first FROM b")
def first_touch_barriers(s, d):
    return _first(_touch(ticks(s, d)))


def _first(touched):
    first = F.when(F.col("stop_ms").isNull() & F.col("target_ms").isNull(), "NEITHER").when(F.col("target_ms").isNull() | (F.col("stop_ms") <= F.col("target_ms")), "STOP").otherwise("TARGET")
    return touched.withColumn("first", first)


@query(f"{_TOUCH} SELECT count(*) AS cases, count(stop_ms) AS stopped, count(target_ms) AS reached, round(avg(CASE WHEN target_ms IS NOT NULL AND (stop_ms IS NULL OR target_ms < stop_ms) THEN 1.0 ELSE 0.0 END), 6) AS target_first FROM b")
def stop_target_summary(s, d):
    return _summary(_touch(ticks(s, d)))


def _summary(touched):
    won = F.col("target_ms").isNotNull() & (F.col("stop_ms").isNull() | (F.col("target_ms") < F.col("stop_ms")))
    return touched.agg(F.count("*").alias("cases"), F.count("stop_ms").alias("stopped"), F.count("target_ms").alias("reached"), r(F.avg(F.when(won, 1.0).otherwise(0.0)), "target_first"))


@query(f"{WITH} SELECT a.symbol, a.start_ms, round(max(b.high), 6) AS highest, round(min(b.low), 6) AS lowest, count(b.start_ms) AS n_bars FROM bars a LEFT JOIN bars b ON a.symbol = b.symbol AND b.start_ms >= a.close_ms AND b.start_ms < a.close_ms + 43200000 GROUP BY 1, 2")
def range_extrema_lookup(s, d):
    b = bars(s, d)
    spans = b.select("symbol", F.struct("symbol", "start_ms").alias("ident"), F.col("close_ms").alias("begin_ms"), (F.col("close_ms") + 12 * T.HOUR).alias("end_ms"))
    out = J.range_extremes(spans, b, "ident", "symbol", "begin_ms", "end_ms")
    return out.select("ident.symbol", "ident.start_ms", r("highest"), r("lowest"), "n_bars")


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def enrichment_left(s, d):
    c = table(s, d, "customer").where("c_custkey % 7 <> 0").select("c_custkey", "c_name", "c_nationkey")
    o = table(s, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.join(table(s, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("SELECT o_orderstatus, count(*) AS orphans FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 7 <> 0) GROUP BY 1")
def enrichment_orphans(s, d):
    c = table(s, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(s, d, "orders").join(c, "o_custkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("orphans"))


@query("SELECT event_id, count(DISTINCT value) AS contents FROM (SELECT event_id, value FROM events UNION ALL SELECT event_id, value + CASE WHEN event_id % 30 = 0 THEN 1 ELSE 0 END FROM events WHERE event_id % 10 = 0) GROUP BY 1 HAVING count(DISTINCT value) > 1")
def conflicting_duplicates(s, d):
    e = table(s, d, "events").select("event_id", "value")
    again = e.where("event_id % 10 = 0").withColumn("value", F.col("value") + F.when(F.col("event_id") % 30 == 0, 1.0).otherwise(0.0))
    return feeds.conflicts(e.unionByName(again), "event_id")


@query("SELECT event_type, count(*) AS fresh FROM events WHERE ts >= (SELECT ts FROM events ORDER BY ts LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.6) AS BIGINT) FROM events)) GROUP BY 1")
def dedup_against_history(s, d):
    """Events that the history, all of the TRAIN period, does not hold."""
    e = _split(s, d)
    return _fresh(e.select("event_id", "event_type"), e.where("period = 'TRAIN'").select("event_id"))


def _fresh(e, seen):
    return e.join(seen, "event_id", "left_anti").groupBy("event_type").agg(F.count("*").alias("fresh"))


@query("WITH v AS (SELECT l_returnflag AS ident, l_linestatus AS candidate, round(avg(l_extendedprice), 4) AS x FROM lineitem GROUP BY 1, 2) SELECT ident, candidate, x, round(x - max(CASE WHEN candidate = 'F' THEN x END) OVER (PARTITION BY ident), 4) AS delta FROM v")
def baseline_delta(s, d):
    v = table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("ident"), F.col("l_linestatus").alias("candidate")).agg(F.round(F.avg("l_extendedprice"), 4).alias("x"))
    return S.against_baseline(v, ["ident"], "candidate", "x", "F").withColumn("delta", F.round("delta", 4))


_SPLIT = """n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events),
 c AS (SELECT max(ts) FILTER (WHERE i = CAST(floor(n * 0.6) AS BIGINT)) AS c1, max(ts) FILTER (WHERE i = CAST(floor(n * 0.8) AS BIGINT)) AS c2 FROM n),
 sp AS (SELECT events.*, CASE WHEN ts < c1 THEN 'TRAIN' WHEN ts < c2 THEN 'VALIDATION' ELSE 'OOS' END AS period FROM events, c)"""


def _split(s, d):
    e = table(s, d, "events").withColumn("ts_us", F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())))
    return S.split_by_time(e, "ts_us")


@query(f"WITH {_SPLIT} SELECT event_id, period FROM sp")
def temporal_split_ties(s, d):
    return _split(s, d).select("event_id", "period")


@query(f"WITH {_SPLIT}, q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM sp WHERE period = 'TRAIN') SELECT period, CASE WHEN value <= a THEN 'Q1' WHEN value <= b THEN 'Q2' WHEN value <= c THEN 'Q3' ELSE 'Q4' END AS bucket, count(*) AS n FROM sp, q GROUP BY 1, 2")
def train_quantile_bucket(s, d):
    df = _split(s, d)
    a, b, c = S.frozen_cuts(df, "value", [0.25, 0.5, 0.75]).first().cuts or [None] * 3
    label = X.cut_bucket(F.col("value"), [F.lit(x).cast("double") for x in (a, b, c)], ["Q1", "Q2", "Q3", "Q4"])
    return df.groupBy("period", label.alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {_SPLIT}, v AS (SELECT event_type AS ident, period, round(avg(value), 6) - 49.5 AS x FROM sp GROUP BY 1, 2), w AS (SELECT ident, max(x) FILTER (WHERE period = 'TRAIN') AS train, max(x) FILTER (WHERE period = 'VALIDATION') AS validation, max(x) FILTER (WHERE period = 'OOS') AS oos FROM v GROUP BY 1) SELECT ident, round(train, 5) AS train, round(validation, 5) AS validation, round(oos, 5) AS oos, CASE WHEN train > 0 AND validation > 0 AND oos > 0 THEN 'ROBUST' WHEN train > 0 AND validation > 0 THEN 'PROMISING' WHEN train <= 0 AND validation <= 0 THEN 'WORSE' ELSE 'UNSTABLE' END AS verdict FROM w")
def period_pivot_verdict(s, d):
    v = _split(s, d).groupBy(F.col("event_type").alias("ident"), "period").agg((F.round(F.avg("value"), 6) - 49.5).alias("x"))
    return S.period_verdict(v, "ident", "x").select("ident", r("train", digits=5), r("validation", digits=5), r("oos", digits=5), "verdict")


@query("SELECT CASE WHEN value >= 0 AND value < 10 THEN '0-10' WHEN value >= 10 AND value < 50 THEN '10-50' WHEN value >= 50 AND value < 100 THEN '50-100' ELSE 'OUTSIDE' END AS bucket, count(*) AS n, CASE WHEN count(*) >= 100 THEN 'SUFFICIENT' WHEN count(*) >= 30 THEN 'THIN_SAMPLE' ELSE 'INSUFFICIENT' END AS sample FROM events GROUP BY 1")
def fixed_edge_bucket(s, d):
    out = table(s, d, "events").groupBy(X.edge_bucket(F.col("value"), [0, 10, 50, 100]).alias("bucket")).agg(F.count("*").alias("n"))
    return out.withColumn("sample", X.sample_label(F.col("n")))


@query("SELECT upper(trim(event_type)) AS raw, CASE WHEN event_type IN ('click', 'view') THEN 'BROWSE' WHEN event_type IN ('purchase') THEN 'BUY' ELSE 'OTHER' END AS alias, count(*) AS n FROM events GROUP BY 1, 2")
def alias_normalise(s, d):
    names = F.create_map(*(F.lit(x) for pair in {"CLICK": "BROWSE", "VIEW": "BROWSE", "PURCHASE": "BUY"}.items() for x in pair))
    e = table(s, d, "events").select(F.upper(F.trim("event_type")).alias("raw"))
    return e.groupBy("raw", F.coalesce(F.try_element_at(names, F.col("raw")), F.lit("OTHER")).alias("alias")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'K_MISSING' WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL THEN 'K_INVALID' WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90 THEN 'K_OUT_OF_RANGE' WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'EVENT_INVALID' WHEN value <= 0 THEN 'PRICE_INVALID' ELSE 'VALID' END AS reason, count(*) AS n FROM events GROUP BY 1")
def payload_validation(s, d):
    k = F.get_json_object("props", "$.k")
    n = k.try_cast("bigint")
    reason = X.first_rule([(k.isNull(), "K_MISSING"), (n.isNull(), "K_INVALID"), (n >= 90, "K_OUT_OF_RANGE"), (~F.col("event_type").isin("click", "view", "purchase", "signup"), "EVENT_INVALID"), (F.col("value") <= 0, "PRICE_INVALID")], "VALID")
    return table(s, d, "events").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN grouping(event_type) = 1 THEN 'ALL' ELSE event_type END AS setup, CASE WHEN grouping(side) = 1 THEN 'ALL' ELSE side END AS direction, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT event_type, CASE WHEN event_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side, value FROM events) GROUP BY GROUPING SETS ((), (side), (event_type), (event_type, side))")
def grouping_sets_all(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("setup"), F.when(F.col("event_id") % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), "value")
    return S.grouping_all(e, ["setup", "direction"], [F.count("*").alias("n"), r(F.avg("value"), "mean")], [[], ["direction"], ["setup"], ["setup", "direction"]])


@query("WITH e AS (SELECT event_type, CAST(hour(ts) AS VARCHAR) AS hour, CAST(event_id % 2 AS VARCHAR) AS side, value FROM events) SELECT segment, bucket, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT 'event_type' AS segment, event_type AS bucket, value FROM e UNION ALL SELECT 'hour', hour, value FROM e UNION ALL SELECT 'side', side, value FROM e) GROUP BY 1, 2 HAVING count(*) >= 30")
def multi_segment_unpivot(s, d):
    e = table(s, d, "events").select("event_type", F.hour("ts").alias("hour"), (F.col("event_id") % 2).alias("side"), "value")
    return S.segments(e, ["event_type", "hour", "side"]).groupBy("segment", "bucket").agg(F.count("*").alias("n"), r(F.avg("value"), "mean")).where("n >= 30")


@query("SELECT source, lang, CASE WHEN count(toxic) = count(*) THEN CAST(sum(toxic) AS BIGINT) END AS toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def all_or_nothing_sum(s, d):
    j = table(s, d, "documents").select("doc_id", "source", "lang").join(table(s, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return j.groupBy("source", "lang").agg(S.whole_sum("toxic").alias("toxic"), F.count("*").alias("n"))


@query("SELECT l_suppkey, count(*) AS n, round(CASE WHEN count(*) >= 20 THEN quantile_cont(l_extendedprice, 0.95) END, 4) AS p95, count(DISTINCT l_shipdate) AS days FROM lineitem GROUP BY 1")
def gated_p95_distinct_days(s, d):
    l = table(s, d, "lineitem")
    return l.groupBy("l_suppkey").agg(F.count("*").alias("n"), r(S.gated(F.percentile("l_extendedprice", 0.95), F.count("*"), 20), "p95", 4), F.countDistinct("l_shipdate").alias("days"))


@query("WITH v AS (SELECT event_type, user_id, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) AS net, max(1 + user_id % 5) AS w FROM events GROUP BY 1, 2), c AS (SELECT event_type, sum(CASE WHEN net > 0 THEN w ELSE 0 END) AS l, sum(CASE WHEN net < 0 THEN w ELSE 0 END) AS s, count(*) AS voters FROM v GROUP BY 1) SELECT event_type, voters, round(CASE WHEN l + s > 0 THEN CAST(l AS DOUBLE) / (l + s) END, 6) AS long_share, CASE WHEN l + s = 0 THEN 'NONE' WHEN CAST(l AS DOUBLE) / (l + s) >= 0.6 THEN 'LONG' WHEN CAST(l AS DOUBLE) / (l + s) <= 0.4 THEN 'SHORT' ELSE 'MIXED' END AS consensus FROM c")
def weighted_consensus(s, d):
    e = table(s, d, "events").select("event_type", "user_id", F.when(F.col("event_id") % 2 == 0, "LONG").otherwise("SHORT").alias("side"), (1.0 + F.col("user_id") % 5).alias("w"))
    return N.consensus(e, "event_type", "user_id", "side", "w").select("event_type", "voters", r("long_share"), "consensus")


@query("WITH o AS (SELECT o_custkey, count(*) AS n, avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END) AS w, count(DISTINCT date_trunc('month', o_orderdate)) AS m FROM orders GROUP BY 1) SELECT o_custkey, round(greatest(0, least(25, log10(greatest(n, 1)) * 10)) + greatest(0, least(25, w * 25)) + greatest(0, least(25, (1 + w - 1) * 12.5)) + greatest(0, least(15, 15 - (1 - w) * 30)) + greatest(0, least(10, m / 12.0 * 10)), 4) AS score FROM o")
def reliability_score(s, d):
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg(F.when(F.col("o_totalprice") > 200000, 1.0).otherwise(0.0)).alias("w"), F.countDistinct(F.date_trunc("month", "o_orderdate")).alias("m"))
    return o.select("o_custkey", r(X.reliability(F.col("n"), F.col("w"), 1 + F.col("w"), 1 - F.col("w"), F.col("m")), "score", 4))


WEIGHTS = {"the": 1, "and": 1, "tion": 2, "scum": -6, "idiot": -5, "stupid": -4, "licensed": 3}


@query("SELECT doc_id, CAST(greatest(-8, least(8, " + " + ".join(f"CASE WHEN contains(lower(text), '{k}') THEN {v} ELSE 0 END" for k, v in WEIGHTS.items()) + ")) AS INT) AS score FROM documents")
def keyword_sentiment(s, d):
    score, _ = N.sentiment(F.col("text"), WEIGHTS)
    return table(s, d, "documents").select("doc_id", score.alias("score"))


@query("WITH t AS (SELECT doc_id, trim(regexp_replace(lower(substr(text, 1, 60)), '[^a-z0-9]+', ' ', 'g')) AS title_key, n_chars FROM documents) SELECT doc_id, title_key FROM (SELECT *, row_number() OVER (PARTITION BY title_key ORDER BY n_chars DESC, doc_id) AS k FROM t) WHERE k = 1")
def title_dedup_latest(s, d):
    t = table(s, d, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"), "n_chars")
    return N.distinct_titles(t, "title", [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "title_key")


@query("SELECT doc_id, CAST(3 * abs(" + " + ".join(f"CASE WHEN contains(lower(text), '{k}') THEN {v} ELSE 0 END" for k, v in WEIGHTS.items()) + ") + doc_id % 10 AS BIGINT) AS rank_score FROM documents ORDER BY rank_score DESC, doc_id LIMIT 30")
def news_topk_rank(s, d):
    score, _ = N.sentiment(F.col("text"), WEIGHTS, 1000)
    t = table(s, d, "documents").select("doc_id", (3 * F.abs(score) + F.col("doc_id") % 10).cast("long").alias("rank_score"))
    return t.orderBy(F.desc("rank_score"), "doc_id").limit(30)


@query(f"""{WITH}, {_PIV}, w AS (SELECT *, start_ms - start_ms % 604800000 AS week FROM bars), z AS (SELECT symbol, start_ms - start_ms % 604800000 + 604800000 AS week, price FROM pivots)
SELECT w.symbol, w.start_ms, round(min(price) FILTER (WHERE price > close), 6) AS above, round(max(price) FILTER (WHERE price < close), 6) AS below FROM w LEFT JOIN z ON w.symbol = z.symbol AND w.week = z.week GROUP BY 1, 2""")
def nearest_level_above_below(s, d):
    """Nearest pivot prices of the week before."""
    week = lambda c: T.bucket(F.col(c), 7 * T.DAY)
    b = bars(s, d)
    # The levels of a week as one sorted array, so a bar meets one row and not each pivot.
    levels = P.fractal_pivots(b).groupBy("symbol", (week("start_ms") + 7 * T.DAY).alias("week")).agg(F.sort_array(F.collect_set("price")).alias("levels"))
    j = b.withColumn("week", week("start_ms")).join(levels, ["symbol", "week"], "left")
    return j.select("symbol", "start_ms", r(F.array_min(F.filter("levels", lambda x: x > F.col("close"))), "above"), r(F.array_max(F.filter("levels", lambda x: x < F.col("close"))), "below"))


@query("SELECT event_type, arg_max(event_id, (value, event_id)) AS best_id, max(value) AS best FROM events GROUP BY 1")
def argmax_evidence(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("best_id"), F.max("value").alias("best"))


@query(f"""{WITH}, x AS (SELECT *, avg(high - low) OVER ({W} ROWS 13 PRECEDING) AS atr, min(low) OVER ({W} ROWS 19 PRECEDING) AS recent, min(low) OVER ({W} ROWS 4 PRECEDING) AS pv FROM bars),
 y AS (SELECT *, close - recent + 0.25 * atr AS extreme, CASE WHEN close - pv + 0.25 * atr > 0 THEN close - pv + 0.25 * atr END AS swing FROM x),
 u AS (SELECT symbol, start_ms, 'CURRENT' AS candidate, least(greatest(1.2 * atr, extreme, 0.8 * atr), 2.0 * atr) AS distance FROM y UNION ALL SELECT symbol, start_ms, 'STRUCTURE', swing FROM y UNION ALL SELECT symbol, start_ms, 'ATR_1_0', atr FROM y
  UNION ALL SELECT symbol, start_ms, 'ATR_1_5', 1.5 * atr FROM y UNION ALL SELECT symbol, start_ms, 'ATR_2_0', 2.0 * atr FROM y UNION ALL SELECT symbol, start_ms, 'HYBRID', greatest(0.8 * atr, coalesce(swing, 0.8 * atr)) FROM y) SELECT symbol, start_ms, candidate, round(distance, 5) AS distance FROM u""")
def stop_candidates_explode(s, d):
    b = bars(s, d).withColumns({"atr": F.avg(F.col("high") - F.col("low")).over(I.last_rows(14)), "recent": F.min("low").over(I.last_rows(20)), "pivot": F.min("low").over(I.last_rows(5))})
    return b.select("symbol", "start_ms", F.inline(X.stop_candidates(F.col("atr"), F.col("recent"), F.col("pivot"), F.col("close"), F.lit("LONG")))).select("symbol", "start_ms", "candidate", r("distance", digits=5))


@query(f"{WITH}, g AS (SELECT * FROM (VALUES (1.0), (1.5), (2.0)) a(stop_atr), (VALUES (1.0), (2.0), (3.0)) b(target_r)), x AS (SELECT symbol, start_ms, close, round(avg(high - low) OVER ({W} ROWS 13 PRECEDING), 4) AS atr FROM bars) SELECT symbol, start_ms, CAST(stop_atr AS DOUBLE) AS stop_atr, CAST(target_r AS DOUBLE) AS target_r, round(close - stop_atr * atr, 7) AS stop, round(close + target_r * (stop_atr * atr + 0.3), 7) AS target FROM x, g")
def tp_candidate_grid(s, d):
    grid = F.array(*(F.struct(F.lit(a).alias("stop_atr"), F.lit(b).alias("target_r")) for a in (1.0, 1.5, 2.0) for b in (1.0, 2.0, 3.0)))
    b = bars(s, d).withColumn("atr", F.round(F.avg(F.col("high") - F.col("low")).over(I.last_rows(14)), 4)).select("symbol", "start_ms", "close", "atr", F.inline(grid))
    return b.select("symbol", "start_ms", "stop_atr", "target_r", r(F.col("close") - F.col("stop_atr") * F.col("atr"), "stop", 7), r(F.col("close") + F.col("target_r") * (F.col("stop_atr") * F.col("atr") + 0.3), "target", 7))


@query(f"{WITH}, x AS (SELECT symbol, round(avg(high - low) OVER ({W} ROWS 13 PRECEDING), 6) AS risk FROM bars), a AS (SELECT unnest([200, 300, 500, 750, 1000]) AS equity) SELECT symbol, CAST(equity AS INT) AS equity, count(*) FILTER (WHERE risk / 0.02 <= equity) AS executable, round(quantile_cont(risk / 0.02, 0.5), 4) AS median_min_equity FROM x, a GROUP BY 1, 2")
def min_equity_by_account(s, d):
    x = bars(s, d).select("symbol", F.round(F.avg(F.col("high") - F.col("low")).over(I.last_rows(14)), 6).alias("risk"))
    x = x.select("symbol", (F.col("risk") / 0.02).alias("need"), F.explode(F.array(*map(F.lit, (200, 300, 500, 750, 1000)))).alias("equity"))
    return x.groupBy("symbol", "equity").agg(F.count_if(F.col("need") <= F.col("equity")).alias("executable"), r(F.percentile("need", 0.5), "median_min_equity", 4))


@query()
def score_core(s, d):
    """Technical score with its structural and timing parts on the recursive indicators."""
    df = I.prior_extremes(I.indicators(bars(s, d)))
    up = F.col("close") > F.col("ema")
    strong = (F.col("adx") >= 16) & (F.col("plus_di") > F.col("minus_di"))
    broke = I.breakout(F.col("prior_high"), F.col("prior_low"), F.lit(0.0))
    points = X.structural_points(up, (F.col("low") <= F.col("ema")) & up, broke == "LONG", strong)
    df = df.withColumns({"structural": points, "broke": broke})
    score = X.technical_score(up, F.col("close") > F.col("open"), F.col("adx"), F.col("rsi").between(50, 70), F.col("structural"), F.col("ticks") >= 5)
    df = df.withColumn("score", score)
    timing = X.timing_points(F.lit("LONG"), F.when(up, "BULLISH").otherwise("BEARISH"), F.col("broke"), F.when(strong, "LONG").otherwise("NONE"), F.col("score"))
    return df.select("symbol", "start_ms", "structural", "score", timing.alias("timing"))


@query(f"{WITH}, c AS (SELECT symbol, start_ms, CASE WHEN avg_spread > 0.0805 THEN 3 ELSE 0 END AS a, CASE WHEN ticks < 3 THEN 2 ELSE 0 END AS b, CASE WHEN high - low > 60 THEN 3 ELSE 0 END AS c FROM bars) SELECT CASE WHEN greatest(a, b, c) = 0 THEN 'NONE' WHEN CAST(a = greatest(a, b, c) AS INT) + CAST(b = greatest(a, b, c) AS INT) + CAST(c = greatest(a, b, c) AS INT) > 1 THEN 'MULTIPLE_CAUSES' WHEN a = greatest(a, b, c) THEN 'SPREAD' WHEN b = greatest(a, b, c) THEN 'ACTIVITY' ELSE 'RANGE' END AS cause, count(*) AS n FROM c GROUP BY 1")
def dominant_cause(s, d):
    causes = F.array(
        F.struct(F.when(F.col("avg_spread") > 0.0805, 3).otherwise(0).alias("w"), F.lit("SPREAD").alias("name")), F.struct(F.when(F.col("ticks") < 3, 2).otherwise(0).alias("w"), F.lit("ACTIVITY").alias("name")),
        F.struct(F.when(F.col("high") - F.col("low") > 60, 3).otherwise(0).alias("w"), F.lit("RANGE").alias("name")),
    )
    df = bars(s, d).select(causes.alias("c")).withColumn("most", F.array_max(F.transform("c", lambda x: x["w"])))
    top = F.filter("c", lambda x: x["w"] == F.col("most"))
    cause = F.when(F.col("most") == 0, "NONE").when(F.size(top) > 1, "MULTIPLE_CAUSES").otherwise(F.element_at(top, 1)["name"])
    return df.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT o_orderkey AS k, o_orderdate + INTERVAL (o_orderkey % 24) HOUR AS ts FROM orders), y AS (SELECT *, make_date(year(ts), 3, 31) AS m31, make_date(year(ts), 10, 31) AS o31, make_date(year(ts), 3, 1) AS m1, make_date(year(ts), 11, 1) AS n1 FROM e),
 b AS (SELECT *, m31 - CAST(dayofweek(m31) AS INT) AS ls, o31 - CAST(dayofweek(o31) AS INT) AS le, m1 + CAST((7 - dayofweek(m1)) % 7 + 7 AS INT) AS ns, n1 + CAST((7 - dayofweek(n1)) % 7 AS INT) AS ne FROM y),
 o AS (SELECT *, CASE WHEN ts >= CAST(ls AS TIMESTAMP) + INTERVAL 1 HOUR AND ts < CAST(le AS TIMESTAMP) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS lo, CASE WHEN ts >= CAST(ns AS TIMESTAMP) + INTERVAL 7 HOUR AND ts < CAST(ne AS TIMESTAMP) + INTERVAL 6 HOUR THEN -4 ELSE -5 END AS ny FROM b),
 c AS (SELECT dayofweek(ts) AS dow, hour(ts) AS h, lo, ny FROM o), n AS (SELECT *, concat_ws('+', CASE WHEN h < 9 THEN 'TOKYO' END, CASE WHEN h + lo >= 8 AND h + lo < 17 THEN 'LONDON' END, CASE WHEN (h + ny + 24) % 24 >= 8 AND (h + ny + 24) % 24 < 17 THEN 'NEW_YORK' END) AS names FROM c)
SELECT CASE WHEN dow IN (0, 6) THEN 'CLOSED' WHEN names = '' THEN 'OFF' ELSE names END AS session, lo AS london, ny AS new_york, count(*) AS n FROM n GROUP BY 1, 2, 3""")
def session_context_dst(s, d):
    e = table(s, d, "orders").select((F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).alias("ts"))
    return e.groupBy(T.session(F.col("ts")).alias("session"), T.london_offset(F.col("ts")).alias("london"), T.new_york_offset(F.col("ts")).alias("new_york")).agg(F.count("*").alias("n"))


_LEDGER = """ev AS (SELECT l_orderkey AS trade, l_linenumber AS line, l_orderkey * 10 + l_linenumber AS base, round(min(l_extendedprice) - 40000, 2) AS gross, -round(min(l_tax) * 100, 2) AS costs, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2)"""


@query(f"WITH {_LEDGER}, s AS (SELECT trade, count(*) FILTER (WHERE flag <> 'R') AS closes, count(*) FILTER (WHERE line = 3) AS bad, count(*) AS n, max(round(gross + costs, 2)) FILTER (WHERE flag <> 'R') AS net FROM ev GROUP BY 1) SELECT trade AS trade_id, CASE WHEN closes > 1 THEN 'CONFLICT' WHEN closes = 1 THEN 'CLOSED' ELSE 'OPEN' END AS state, CASE WHEN closes = 1 THEN net END AS net, CAST(n + closes AS BIGINT) AS events FROM s")
def ledger_projection(s, d):
    """Fills and closes derived from lines: a line is a fill, one that was not returned is a close too."""
    lines = table(s, d, "lineitem")
    parts = E.parts_for(lines)
    l = lines.repartition(parts, "l_orderkey").groupBy("l_orderkey", "l_linenumber")
    l = l.agg(F.min("l_extendedprice").alias("l_extendedprice"), F.min("l_tax").alias("l_tax"), F.max("l_returnflag").alias("l_returnflag"))
    base = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    gross, costs = F.round(F.col("l_extendedprice") - 40000, 2), -F.round(F.col("l_tax") * 100, 2)
    net = F.round(gross + costs, 2)
    unknown = [F.lit(None).cast("double").alias(c) for c in ("gross", "costs", "net", "risk", "r")]
    fill = F.struct((base * 2).alias("seq"), F.concat(F.lit("f"), base).alias("event_id"), F.lit("FILL").alias("event"), base.alias("deal"), *unknown)
    close = F.struct((base * 2 + 1).alias("seq"), F.concat(F.lit("c"), base).alias("event_id"), F.lit("CLOSE").alias("event"), (-base).alias("deal"), gross.alias("gross"), costs.alias("costs"), net.alias("net"), F.lit(100.0).alias("risk"), (net / 100).alias("r"))
    both = F.array_compact(F.array(fill, F.when(F.col("l_returnflag") != "R", close)))
    events = l.select(F.col("l_orderkey").alias("trade_id"), F.explode(F.when(F.col("l_orderkey") % 5 == 0, F.concat(both, both)).otherwise(both)).alias("e"))
    return E.ledger(events.select("trade_id", "e.*"), 2 * parts).select("trade_id", "state", "net", "events")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def latest_by_key_snapshot(s, d):
    return streams.latest(table(s, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("WITH b AS (SELECT event_type, date_trunc('hour', ts) AS h, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS ticks FROM events GROUP BY 1, 2) SELECT event_type, epoch_us(h) // 1000 AS start_ms, open, high, low, close, ticks FROM b WHERE h < (SELECT max(h) FROM b)")
def stream_bars_equals_batch(s, d):
    path = scratch(s)
    streams.drain(streams.bars(streams.read(s, f"{d}/events.parquet")), path)
    return s.read.parquet(f"{path}/data").select("event_type", F.unix_millis(F.to_utc_timestamp("start", F.current_timezone())).alias("start_ms"), "open", "high", "low", "close", "ticks")


@query("SELECT DISTINCT event_id, event_type FROM events")
def stream_dedup(s, d):
    e = streams.read(s, f"{d}/events.parquet")
    path = scratch(s)
    streams.drain(streams.deduplicated(e.unionByName(e.where("event_id % 4 = 0")), "event_id").select("event_id", "event_type"), path)
    return s.read.parquet(f"{path}/data")


@query("WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, n, round(sum(value * power(19 / CAST(21 AS DOUBLE), n - i) * CASE WHEN i = 1 THEN 1 ELSE 2 / CAST(21 AS DOUBLE) END), 6) AS ema FROM o GROUP BY 1, 2")
def stream_running_average(s, d):
    path = scratch(s)
    streams.drain_batches(streams.running_average(streams.read(s, f"{d}/events.parquet").select("user_id", "event_id", "ts", "value")), path, "update", ["user_id"])
    out = s.read.parquet(f"{path}/data")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), r(F.max_by("ema", "n"), "ema"))


@query(f"{T0}, g AS (SELECT o_orderkey % 1000 AS k, o_orderkey FROM orders) SELECT k, string_agg(CAST(o_orderkey AS VARCHAR), ';' ORDER BY o_orderkey) AS members, sha256(concat_ws('|', CAST(k AS VARCHAR), CAST(count(*) AS VARCHAR))) AS ident FROM g GROUP BY 1".replace(f"{T0}, g", "WITH g"))
def deterministic_ids(s, d):
    o = table(s, d, "orders").select((F.col("o_orderkey") % 1000).alias("k"), "o_orderkey").groupBy("k").agg(F.sort_array(F.collect_list("o_orderkey")).alias("m"))
    return o.select("k", F.concat_ws(";", F.transform("m", lambda x: x.cast("string"))).alias("members"), X.stable_id(F.col("k").cast("string"), F.size("m").cast("string")).alias("ident"))


@query(f"{T0}, q AS (SELECT ts_ms, bid FROM ticks UNION ALL SELECT ts_ms, bid FROM ticks WHERE event_id % 2 = 0) SELECT CAST(row_number() OVER (ORDER BY ts_ms, bid) AS BIGINT) AS place, ts_ms, round(bid, 6) AS bid FROM q ORDER BY ts_ms, bid LIMIT 500")
def chronological_merge_limit(s, d):
    """Two sorted feeds merged by time and key; the first 500 ticks (a limit of the feature)."""
    t = ticks(s, d)
    merged = t.select("ts_ms", "bid").unionByName(t.where("event_id % 2 = 0").select("ts_ms", "bid")).orderBy("ts_ms", "bid").limit(500)
    return merged.withColumn("place", F.row_number().over(Window.orderBy("ts_ms", "bid")).cast("long")).select("place", "ts_ms", r("bid"))
