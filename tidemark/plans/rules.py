"""Queries on trade rules, manifests, rates and windows of activity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.functions import timebase as T
from tidemark.operators import episodes as E
from tidemark.operators import structure as P
from tidemark.operators import trades as R
from tidemark.plans.base import TICKS, WITH, bars, query, r, table, ticks
from tidemark.plans.market import _ALT, _PIV, W
from tidemark.sources import feeds

T0 = f"WITH {TICKS}"


@query(f"""{WITH}, s AS (SELECT symbol, start_ms, CASE WHEN close > lag(close) OVER w THEN 'BULLISH' WHEN close < lag(close) OVER w THEN 'BEARISH' WHEN lag(close) OVER w IS NOT NULL THEN 'NEUTRAL' END AS f, CASE WHEN close > lag(close, 10) OVER w THEN 'BULLISH' WHEN close < lag(close, 10) OVER w THEN 'BEARISH' WHEN lag(close, 10) OVER w IS NOT NULL THEN 'NEUTRAL' END AS s FROM bars WINDOW w AS ({W}))
SELECT CASE WHEN f IS NULL OR s IS NULL THEN 'INSUFFICIENT' WHEN f = 'BULLISH' AND s = 'BULLISH' THEN 'ALIGNED_UP' WHEN f = 'BEARISH' AND s = 'BEARISH' THEN 'ALIGNED_DOWN' WHEN f <> s AND f <> 'NEUTRAL' AND s <> 'NEUTRAL' THEN 'CONFLICT' ELSE 'NEUTRAL' END AS alignment, count(*) AS n FROM s GROUP BY 1""")
def trend_alignment(s, d):
    w = Window.partitionBy("symbol").orderBy("start_ms")
    trend = lambda k: X.first_rule([(F.col("close") > F.lag("close", k).over(w), "BULLISH"), (F.col("close") < F.lag("close", k).over(w), "BEARISH"), (F.lag("close", k).over(w).isNotNull(), "NEUTRAL")])
    df = bars(s, d).select(F.coalesce(trend(1), F.lit("?")).alias("f"), F.coalesce(trend(10), F.lit("?")).alias("s"))
    return df.groupBy(R.alignment(F.col("f"), F.col("s")).alias("alignment")).agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT symbol, start_ms, CAST(close < open AS INT) + CAST(ticks < 3 AS INT) + CAST(avg_spread > 0.0805 AS INT) + CAST(coalesce(close < lag(low) OVER ({W}), false) AS INT) AS votes FROM bars")
def release_votes(s, d):
    w = Window.partitionBy("symbol").orderBy("start_ms")
    b = bars(s, d)
    return b.select("symbol", "start_ms", R.votes(F.col("close") < F.col("open"), F.col("ticks") < 3, F.col("avg_spread") > 0.0805, F.col("close") < F.lag("low").over(w)).alias("votes"))


@query("SELECT CASE WHEN l_returnflag = 'R' AND l_discount - 0.05 < 0 THEN 'SAVED_LOSER' WHEN l_returnflag <> 'R' AND l_discount - 0.05 > 0 THEN 'KILLED_WINNER' ELSE 'INCONCLUSIVE' END AS label, count(*) AS n FROM lineitem GROUP BY 1")
def cancel_outcome_label(s, d):
    l = table(s, d, "lineitem")
    return l.groupBy(R.cancel_label(F.col("l_discount") - 0.05, F.col("l_returnflag") == "R").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, round(max(greatest(l_tax * 100, 1.5 * l_quantity)), 5) AS floor_1_5, round(max(greatest(l_tax * 100, 2.0 * l_quantity)), 5) AS floor_2_0, round(max(greatest(l_tax * 100, CASE l_returnflag WHEN 'A' THEN 2.0 WHEN 'N' THEN 1.5 ELSE 1.2 END * l_quantity)), 5) AS by_setup FROM lineitem GROUP BY 1, 2")
def adaptive_stop_variants(s, d):
    setup = F.when(F.col("l_returnflag") == "A", "BREAKOUT").when(F.col("l_returnflag") == "N", "PULLBACK").otherwise("OTHER")
    v = R.adaptive_stop(F.col("l_tax") * 100, F.col("l_quantity"), setup)
    return table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), *(r(F.max(c), n.lower(), 5) for n, c in v.items()))


@query(f"{T0}, p AS (SELECT user_id, event_id, ts_ms, bid, first_value(ask) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS entry FROM ticks) SELECT user_id, event_id, round(max(bid - entry) OVER w, 6) AS mfe, round(min(bid - entry) OVER w, 6) AS mae FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, event_id)")
def running_excursions(s, d):
    first = F.first("ask").over(Window.partitionBy("user_id").orderBy("ts_ms", "event_id"))
    return R.excursions(ticks(s, d).withColumn("entry", first), "user_id", "entry").select("user_id", "event_id", r("mfe"), r("mae"))


@query("WITH l AS (SELECT l_orderkey, l_linenumber % 2 AS way, round(l_extendedprice * 100) AS cents, l_quantity AS q FROM lineitem) SELECT l_orderkey, sum(cents * q) FILTER (WHERE way = 1) / sum(q) FILTER (WHERE way = 1) AS entry, sum(cents * q) FILTER (WHERE way = 0) / sum(q) FILTER (WHERE way = 0) AS exit, coalesce(sum(q) FILTER (WHERE way = 1), 0) = coalesce(sum(q) FILTER (WHERE way = 0), 0) AS matched FROM l GROUP BY 1")
def deal_netting_vwap(s, d):
    """Prices in cents, so that the sums are whole numbers."""
    deals = table(s, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 1, "IN").otherwise("OUT").alias("side"), F.round(F.col("l_extendedprice") * 100).alias("price"), F.col("l_quantity").alias("volume"))
    return R.netted(deals, "l_orderkey").select("l_orderkey", "entry", "exit", "matched")


@query("WITH p AS (SELECT o_orderstatus, epoch_us(o_orderdate) // 1000 AS day_ms, round(-coalesce(sum(o_totalprice - 200000) FILTER (WHERE o_totalprice < 200000), 0), 4) AS loss FROM orders GROUP BY 1, 2) SELECT o_orderstatus, day_ms, loss, max(loss) OVER (PARTITION BY o_orderstatus ORDER BY day_ms) AS worst, round(greatest(0, 500000 - loss), 4) AS left_over FROM p")
def daily_loss_budget(s, d):
    o = table(s, d, "orders").select("o_orderstatus", T.wall_ms(F.col("o_orderdate")).alias("day_ms"), (F.col("o_totalprice") - 200000).alias("net"))
    out = R.daily_losses(o, "o_orderstatus", "day_ms", "net", 500000.0)
    return out.select("o_orderstatus", "day_ms", r("loss", digits=4), r("worst", digits=4), r(F.col("left"), "left_over", 4))


@query(f"""{WITH}, m AS (SELECT *, abs(close - lag(close) OVER ({W})) AS step, close - lag(close, 6) OVER ({W}) AS net FROM bars), e AS (SELECT *, abs(net) / nullif(sum(step) OVER ({W} ROWS 5 PRECEDING), 0) AS eff FROM m)
SELECT symbol, start_ms, CASE WHEN net > 0 THEN 'BULL' ELSE 'BEAR' END AS side, round(net, 6) AS net, round(eff, 6) AS efficiency FROM e WHERE abs(net) >= 60 AND eff >= 0.3""")
def pole_efficiency(s, d):
    return R.poles(bars(s, d), 6, F.lit(20.0), 3.0, 0.3).select("symbol", "start_ms", "side", r("net"), r("efficiency"))


@query(f"""{WITH}, {_PIV}, {_ALT}, t AS (SELECT symbol, kind, start_ms AS first_ms, lead(start_ms, 3) OVER w AS end_ms, lead(price, 2) OVER w - price AS a, lead(price, 3) OVER w - lead(price, 1) OVER w AS b FROM alt WINDOW w AS (PARTITION BY symbol ORDER BY start_ms, kind)),
 u AS (SELECT symbol, first_ms, end_ms, CASE WHEN kind = 'HIGH' THEN a ELSE b END AS h, CASE WHEN kind = 'HIGH' THEN b ELSE a END AS l FROM t WHERE end_ms IS NOT NULL)
SELECT symbol, first_ms, end_ms, CASE WHEN abs(h) <= 5 AND l > 5 THEN 'ASCENDING' WHEN abs(l) <= 5 AND h < -5 THEN 'DESCENDING' WHEN h < -5 AND l > 5 THEN 'SYMMETRIC' WHEN h > 5 AND l < -5 THEN 'BROADENING' WHEN h > 5 AND l > 5 THEN 'RISING_CHANNEL' WHEN h < -5 AND l < -5 THEN 'FALLING_CHANNEL' ELSE 'LEVEL' END AS shape FROM u""")
def triangle_scan(s, d):
    return R.triangles(P.alternate(P.fractal_pivots(bars(s, d))), 5.0)


@query(f"{WITH}, a AS (SELECT symbol, close_ms AS begin_ms, close_ms + 14400000 AS end_ms FROM bars) SELECT a.symbol, begin_ms, count(b.start_ms) AS n, CASE WHEN count(b.start_ms) = 4 THEN 'COMPLETED' ELSE 'UNRESOLVABLE_GAP' END AS status, round(max(b.high), 6) AS highest, round(min(b.low), 6) AS lowest, round(arg_max(b.close, b.start_ms), 6) AS last FROM a LEFT JOIN bars b ON a.symbol = b.symbol AND b.start_ms >= begin_ms AND b.start_ms < end_ms GROUP BY 1, 2")
def complete_live_outcome(s, d):
    b = bars(s, d)
    spans = b.select("symbol", F.col("close_ms").alias("begin_ms"), (F.col("close_ms") + 4 * T.HOUR).alias("end_ms"))
    return R.complete_outcome(spans, b, "symbol", "begin_ms", "end_ms", T.HOUR, 4 * T.HOUR).select("symbol", "begin_ms", "n", "status", r("highest"), r("lowest"), r("last"))


@query(f"{T0}, m AS (SELECT max(ts_ms) AS now FROM ticks), a AS (SELECT user_id, (max(now) - max(ts_ms)) // 60000 AS age FROM ticks, m GROUP BY 1) SELECT user_id, age AS age_minutes, CASE WHEN age <= 15 THEN 'FRESH' ELSE 'STALE' END AS label, CAST(age > 5 AS INT) + CAST(age > 15 AS INT) + CAST(age > 60 AS INT) AS exceeded FROM a")
def freshness_by_key(s, d):
    t = ticks(s, d)
    now = t.agg(F.max("ts_ms")).first()[0]
    age = ((F.lit(now) - F.max("ts_ms")) / 60000).cast("long")
    label, over = X.freshness(F.col("age_minutes"))
    return t.groupBy("user_id").agg(age.alias("age_minutes")).select("user_id", "age_minutes", label.alias("label"), F.size(over).alias("exceeded"))


@query(f"{T0} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts_ms RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW) > 3 AS limited FROM ticks")
def sliding_rate_limit(s, d):
    """More than three events of a user within a day back."""
    w = Window.partitionBy("user_id").orderBy("ts_ms").rangeBetween(-(T.DAY - 1), 0)
    return ticks(s, d).select("event_id", (F.count("*").over(w) > 3).alias("limited"))


@query("WITH c AS (SELECT o_custkey AS path, count(*) AS size, max(o_orderkey) AS modified FROM orders GROUP BY 1), k AS (SELECT o_custkey AS path, count(*) AS size, max(o_orderkey) AS modified FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1) SELECT CASE WHEN c.size IS NULL THEN 'MISSING' WHEN k.size IS NULL THEN 'NEW' WHEN c.size = k.size THEN 'SUCCESS' WHEN c.modified > k.modified THEN 'CHANGED_REQUIRES_REBUILD' ELSE 'WAITING_FOR_STABLE_FILE' END AS state, count(*) AS n FROM c FULL OUTER JOIN k ON c.path = k.path GROUP BY 1")
def manifest_state_machine(s, d):
    o = table(s, d, "orders")
    files = lambda df: df.groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("size"), F.max("o_orderkey").alias("modified")).withColumn("digest", F.col("size").cast("string"))
    return feeds.manifest_states(files(o), files(o.where("o_orderkey % 10 <> 0"))).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN l_quantity >= 25 AND l_discount > 0.05 THEN 'GOD' WHEN l_quantity >= 10 THEN 'CHILL' ELSE 'NONE' END AS class, count(*) AS n, CAST(sum(CAST(ceil(l_extendedprice / 0.25 - 1e-10) AS BIGINT)) AS BIGINT) AS ticks_up, CAST(sum(CAST(floor(l_extendedprice / 0.25 + 1e-10) AS BIGINT)) AS BIGINT) AS ticks_down FROM lineitem GROUP BY 1")
def trade_class_and_alignment(s, d):
    label = X.first_rule([((F.col("l_quantity") >= 25) & (F.col("l_discount") > 0.05), "GOD"), (F.col("l_quantity") >= 10, "CHILL")], "NONE")
    up, down = (F.round(X.align(F.col("l_extendedprice"), 0.25, u) / 0.25).cast("long") for u in (True, False))
    return table(s, d, "lineitem").groupBy(label.alias("class")).agg(F.count("*").alias("n"), F.sum(up).alias("ticks_up"), F.sum(down).alias("ticks_down"))


@query("WITH x AS (SELECT o_orderpriority, o_totalprice / 100000 AS cur, greatest(o_totalprice, 150000) / 100000 AS cand FROM orders) SELECT o_orderpriority, round(avg(cur / cand), 6) AS multiplier, count(*) FILTER (WHERE abs(cand * (cur / cand) / cur - 1) < 1e-9) AS unchanged_risk FROM x GROUP BY 1")
def constant_risk_multiplier(s, d):
    x = table(s, d, "orders").select("o_orderpriority", (F.col("o_totalprice") / 100000).alias("cur"), (F.greatest(F.col("o_totalprice"), F.lit(150000.0)) / 100000).alias("cand"))
    m = X.ratio(F.col("cur"), F.col("cand"))
    return x.groupBy("o_orderpriority").agg(r(F.avg(m), "multiplier"), F.count_if(F.abs(F.col("cand") * m / F.col("cur") - 1) < 1e-9).alias("unchanged_risk"))


@query(f"{T0}, z AS (SELECT event_id, user_id, ts_ms, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) > 43200000 THEN 1 ELSE 0 END AS new FROM ticks), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS part FROM z) SELECT user_id, min(ts_ms) AS begin_ms, max(ts_ms) AS end_ms, count(*) AS n FROM y GROUP BY user_id, part")
def gap_segments(s, d):
    w = Window.partitionBy("user_id").orderBy("ts_ms", "event_id")
    t = ticks(s, d).withColumn("new", F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(w) > 12 * T.HOUR, F.lit(False)).cast("int")).withColumn("part", F.sum("new").over(w))
    return t.groupBy("user_id", "part").agg(F.min("ts_ms").alias("begin_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("n")).drop("part")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def lexicographic_choice(s, d):
    return E.first_per(table(s, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")
