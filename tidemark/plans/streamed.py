"""Queries on streams with timers, order-sensitive state and late rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import timebase as T
from tidemark.plans.analysis import _OUT, HORIZONS
from tidemark.plans.base import TICKS, WITH, bars, query, r, scratch, ticks
from tidemark.streaming import late, stateful, streams

_DONE = "anchor_ms + CASE horizon WHEN '1h' THEN 3600000 WHEN '4h' THEN 14400000 ELSE 86400000 END <= (SELECT max(ts_ms) FROM ticks)"


def _stream(s, df, path):
    """A stream of `df`, written as a table before, by the tasks that read it."""
    df.write.parquet(path)
    return s.readStream.schema(s.read.parquet(path).schema).parquet(path)


@query(f"{_OUT} SELECT anchor_id, horizon, round(ret, 6) AS ret, round(mfe, 6) AS mfe, round(mae, 6) AS mae, round(max_spread, 6) AS max_spread, n_ticks FROM o WHERE {_DONE}")
def stream_progressive_outcomes(s, d):
    """The outcomes of all anchors whose horizon the stream has passed, each given when it has."""
    path = scratch(s)
    a = bars(s, d).select(F.concat_ws("-", "symbol", F.col("start_ms").cast("string")).alias("anchor_id"), "symbol", F.col("close_ms").alias("anchor_ms"), F.col("close").alias("entry"))
    out = stateful.outcomes(_stream(s, a, f"{path}/anchors"), _stream(s, ticks(s, d).select("symbol", "ts_ms", "event_id", "mid", "spread"), f"{path}/ticks"), HORIZONS, lanes=4, base=T.HOUR)
    with stateful.state_store(s):
        streams.drain(out, path)
    return s.read.parquet(f"{path}/data").select("anchor_id", "horizon", r("ret"), r("mfe"), r("mae"), r("max_spread"), "n_ticks")


#: Observations made of ticks: whole numbers decide, so that both sides see the same ones.
_OBS = f"""WITH RECURSIVE {TICKS}, obs AS (SELECT symbol, ts_ms - ts_ms % 14400000 AS bar_ms, ts_ms, event_id, user_id % 3 <> 0 AS candidate, CASE WHEN user_id % 5 < 3 THEN 1 ELSE -1 END AS way, CAST(60 + user_id % 31 AS INT) AS score, CASE WHEN user_id % 2 = 0 THEN 'BREAKOUT' ELSE 'PULLBACK' END AS setup,
  event_id % 4 = 0 AS trigger_up, event_id % 6 = 0 AS trigger_down, CAST(event_id % 11 AS INT) AS boost_up, CAST(event_id % 9 AS INT) AS boost_down, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS breakout, CAST(30 + event_id % 41 AS DOUBLE) AS rsi, CAST(user_id % 9 - 4 AS DOUBLE) AS impulse FROM ticks),
 n AS (SELECT *, row_number() OVER (PARTITION BY symbol, bar_ms ORDER BY ts_ms, event_id) AS i FROM obs),
 fold AS (SELECT symbol, bar_ms, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS ts_ms, CAST(NULL AS BIGINT) AS event_id, '' AS action, 0 AS said_way, 0 AS said_score, '' AS said_setup, false AS used, 0 AS way, 0 AS held, '-' AS setup, 0 AS gone_way, '-' AS gone_setup FROM (SELECT DISTINCT symbol, bar_ms FROM obs)
 UNION ALL SELECT symbol, bar_ms, i, ts_ms, event_id, action, CASE action WHEN 'USED' THEN 0 WHEN 'CANCELLED' THEN old_way WHEN 'WAITING' THEN 0 ELSE way END, CASE action WHEN 'USED' THEN score WHEN 'CANCELLED' THEN old_held WHEN 'WAITING' THEN score ELSE worth END,
   CASE action WHEN 'USED' THEN '-' WHEN 'CANCELLED' THEN old_setup WHEN 'WAITING' THEN '-' ELSE setup END,
   used OR action = 'ENTERED', CASE WHEN action IN ('READY', 'ARMED', 'HELD') THEN way ELSE 0 END, CASE WHEN action IN ('READY', 'ARMED', 'HELD') THEN held ELSE 0 END, CASE WHEN action IN ('READY', 'ARMED', 'HELD') THEN setup ELSE '-' END,
   CASE WHEN action = 'CANCELLED' THEN old_way ELSE gone_way END, CASE WHEN action = 'CANCELLED' THEN old_setup ELSE gone_setup END
 FROM (SELECT *, CASE WHEN used THEN 'USED' WHEN cancelled THEN 'CANCELLED' WHEN way = 0 THEN 'WAITING' WHEN worth >= 74 AND CASE WHEN way > 0 THEN trigger_up ELSE trigger_down END THEN 'ENTERED' WHEN worth >= 74 THEN 'READY' WHEN old_way = 0 THEN 'ARMED' ELSE 'HELD' END AS action
 FROM (SELECT *, CASE WHEN candidate AND new_way = way THEN score ELSE least(100, held + CASE WHEN way > 0 THEN boost_up ELSE boost_down END) END AS worth
 FROM (SELECT *, CASE WHEN arms THEN new_way ELSE old_way END AS way, CASE WHEN arms THEN score ELSE old_held END AS held, CASE WHEN arms THEN new_setup ELSE old_setup END AS setup
 FROM (SELECT n.symbol, n.bar_ms, n.i, n.ts_ms, n.event_id, n.candidate, n.way AS new_way, n.score, n.setup AS new_setup, n.trigger_up, n.trigger_down, n.boost_up, n.boost_down, f.used, f.way AS old_way, f.held AS old_held, f.setup AS old_setup, f.gone_way, f.gone_setup,
   f.way <> 0 AND n.breakout = -f.way AND CASE WHEN f.way < 0 THEN n.rsi >= 55 ELSE n.rsi <= 45 END AND n.breakout * n.impulse >= 1.5 AS cancelled,
   n.candidate AND f.way IN (0, n.way) AND NOT (n.way = f.gone_way AND n.setup = f.gone_setup) AS arms FROM fold f JOIN n ON n.symbol = f.symbol AND n.bar_ms = f.bar_ms AND n.i = f.i + 1)))))"""
_PLANS = f"""{_OBS} SELECT symbol, bar_ms, ts_ms, event_id, action, said_way AS way, said_score AS score, said_setup AS setup FROM fold WHERE i > 0
 UNION ALL SELECT symbol, bar_ms, bar_ms + 14400000, NULL, 'EXPIRED', way, held, setup FROM fold WHERE way <> 0 AND i = (SELECT max(i) FROM n WHERE n.symbol = fold.symbol AND n.bar_ms = fold.bar_ms)"""


def _observations(s, d):
    e, u = F.col("event_id"), F.col("user_id")
    return ticks(s, d).select(
        "symbol", "ts_ms", "event_id", (u % 3 != 0).alias("candidate"), F.when(u % 5 < 3, 1).otherwise(-1).alias("way"), (60 + u % 31).cast("int").alias("score"), F.when(u % 2 == 0, "BREAKOUT").otherwise("PULLBACK").alias("setup"),
        (e % 4 == 0).alias("trigger_up"), (e % 6 == 0).alias("trigger_down"), (e % 11).cast("int").alias("boost_up"), (e % 9).cast("int").alias("boost_down"),
        F.when(e % 3 == 0, 1).when(e % 3 == 1, -1).otherwise(0).alias("breakout"), (30 + e % 41).cast("double").alias("rsi"), (u % 9 - 4).cast("double").alias("impulse"),
    )


@query(_PLANS)
def armed_plan_lifecycle(s, d):
    """What becomes of armed plans, four hours a bar; the SQL folds over the observations."""
    return stateful.armed_plans_batch(_observations(s, d), 4 * T.HOUR)


@query(f"SELECT * FROM ({_PLANS}) WHERE ts_ms <= (SELECT epoch_us(max(ts)) // 1000 FROM events)")
def stream_armed_plans(s, d):
    """The same as a stream: all that lies before its watermark."""
    path = scratch(s)
    with stateful.state_store(s):
        streams.drain(stateful.armed_plans(_stream(s, _observations(s, d), f"{path}/in"), 4 * T.HOUR), path)
    return s.read.parquet(f"{path}/data")


_FILES = f"""{WITH}, q AS (SELECT *, ts_ms - ts_ms % 3600000 AS start_ms, CASE WHEN event_id % 40 = 0 THEN 3 ELSE (ts_ms - min(ts_ms) OVER ()) * 4 // (max(ts_ms) OVER () - min(ts_ms) OVER () + 1) END AS file FROM ticks),
 m AS (SELECT file, max(newest) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 7200000 AS mark FROM (SELECT file, max(ts_ms) AS newest FROM q GROUP BY 1))"""


def _late(s, d):
    """Ticks in four files in the order of time, but one in forty comes with the last; bars of an hour, two hours' delay."""
    path, t = scratch(s), ticks(s, d).select("symbol", "ts_ms", "event_id", "mid")
    low, high = t.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    file = F.when(F.col("event_id") % 40 == 0, 3).otherwise(F.floor((F.col("ts_ms") - low) * 4 / (high - low + 1)))
    for n in range(4):  # files are taken in the order in which they were written
        t.where(file == n).coalesce(1).write.mode("append").parquet(f"{path}/in")
    late.keep(s.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), path, T.HOUR, 2 * T.HOUR)
    return path


@query(f"{_FILES} SELECT event_id, symbol, ts_ms, start_ms FROM q JOIN m USING (file) WHERE coalesce(start_ms + 3600000 <= mark, false)")
def stream_late_rows(s, d):
    """Rows that came after their bar was final."""
    return s.read.parquet(f"{_late(s, d)}/{late.LATE}").select("event_id", "symbol", "ts_ms", "start_ms")


@query(f"""WITH {TICKS}, b AS (SELECT symbol, ts_ms - ts_ms % 3600000 AS start_ms, arg_min(mid, (ts_ms, event_id)) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, (ts_ms, event_id)) AS close, count(*) AS ticks FROM ticks GROUP BY 1, 2)
SELECT symbol, start_ms, open, high, low, close, ticks FROM b WHERE start_ms + 3600000 <= (SELECT max(ts_ms) FROM ticks) - 7200000""")
def stream_bars_rebuilt(s, d):
    """Final bars, those with late rows made anew: the same as without any delay."""
    return late.rebuilt(s, _late(s, d), ticks(s, d).select("symbol", "ts_ms", "event_id", "mid"), T.HOUR)
