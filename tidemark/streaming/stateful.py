"""Streams that hold state by key: outcomes that are given as their horizons end, and plans that are armed, judged and triggered.

Both take rows in any order within the watermark's delay: what an earlier row may still come before waits in the state. Both
work by event-time timers and let their state go when nothing can follow, so it is bounded by what is open.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started here keep their state in the store that timers and lists need; the session's setting comes back afterwards."""
    key, before = "spark.sql.streaming.stateStore.providerClass", None
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def event_time(ms: Column) -> Column:
    return F.timestamp_millis(ms)


# ---- outcomes

_OPEN = "anchor_id string, horizon string, anchor_ms long, until_ms long, price double, last_ms long, last_id long, last double, high double, low double, spread double, n long"
#: Ticks of a block: the newest one's time, id and price, the extremes, and how many there are.
_BLOCK = "ts_ms long, event_id long, mid double, high double, low double, spread double, n long"
#: Rows of blocks that a task merges again, and that it holds at most.
MERGED, HELD = 20_000, 200_000
_OUTCOME = "symbol string, lane int, anchor_id string, anchor_ms long, horizon string, ret double, mfe double, mae double, max_spread double, n_ticks long"


class _Outcomes(StatefulProcessor):
    """Open (anchor, horizon) pairs of a key with what their ticks say so far, and the blocks of ticks that a later anchor may still need."""

    def __init__(self, horizons: dict[str, int]):
        self.horizons = horizons

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open, self.ticks = handle.getListState("open", _OPEN), handle.getListState("ticks", _BLOCK)

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs()
        new = pd.concat(list(rows), ignore_index=True)
        asked, fresh = new[new["anchor_id"].notna()], new[new["anchor_id"].isna()]
        ticks = [(int(t.ts_ms), int(t.event_id), float(t.mid), float(t.high), float(t.low), float(t.spread), int(t.n)) for t in fresh.itertuples()]
        held = [tuple(t) for t in self.ticks.get()] if self.ticks.exists() else []
        ticks.sort()
        times = [t[0] for t in ticks]
        open_now = [self._see(tuple(o), ticks, times) for o in self.open.get()] if self.open.exists() else []
        if len(asked):
            both = sorted(held + ticks)
            times = [t[0] for t in both]
            for a in asked.itertuples():
                for name, span in self.horizons.items():
                    until = int(a.ts_ms) + span
                    open_now.append(self._see((a.anchor_id, name, int(a.ts_ms), until, float(a.mid), None, None, None, None, None, None, 0), both, times))
                    self.handle.registerTimer(until)
        # Anchors at or before the watermark cannot come any more; ticks after it can be needed.
        self._keep(open_now, [t for t in held + ticks if t[0] > mark])
        if not len(asked) and not open_now and len(fresh):
            self.handle.registerTimer(int(fresh["ts_ms"].max()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        open_now = [tuple(o) for o in self.open.get()] if self.open.exists() else []
        done = [o for o in open_now if o[3] <= mark]  # a tick at the watermark cannot come any more
        held = [tuple(t) for t in self.ticks.get()] if self.ticks.exists() else []
        if done or any(t[0] <= mark for t in held):
            self._keep([o for o in open_now if o[3] > mark], [t for t in held if t[0] > mark])
        if done:
            rows = [(*key, o[0], o[2], o[1], *((o[7] - o[4], o[8] - o[4], o[9] - o[4], o[10]) if o[11] else (None,) * 4), o[11]) for o in done]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUTCOME.split(", ")])

    def _keep(self, open_now: list[tuple], ticks: list[tuple]) -> None:
        for state, rows in ((self.open, open_now), (self.ticks, ticks)):
            if rows:
                state.put(rows)
            else:
                state.clear()

    @staticmethod
    def _see(o: tuple, ticks: list[tuple], times: list[int]) -> tuple:
        """`o` after the blocks of ticks (in order, of these times) that lie in (anchor, until]."""
        first, last = bisect_right(times, o[2]), bisect_right(times, o[3])
        inside = ticks[first:last]
        if not inside:
            return o
        newest = inside[-1]
        high, low, spread = max(t[3] for t in inside), min(t[4] for t in inside), max(t[5] for t in inside)
        if o[11] and (o[5], o[6]) > newest[:2]:
            newest = (o[5], o[6], o[7])
        if o[11]:
            high, low, spread = max(high, o[8]), min(low, o[9]), max(spread, o[10])
        return (*o[:5], newest[0], newest[1], newest[2], high, low, spread, o[11] + sum(t[6] for t in inside))


def _merged(table: pa.Table) -> pa.Table:
    """Blocks of a symbol and number as one row each; the newest tick is the last by time and id."""
    every = pc.ScalarAggregateOptions(skip_nulls=False)
    of = {"ts_ms": "last", "event_id": "last", "mid": "last", "high": "max", "low": "min", "spread": "max", "n": "sum"}
    out = table.sort_by([("ts_ms", "ascending"), ("event_id", "ascending")]).group_by(["symbol", "block"], use_threads=False).aggregate([(c, f, every) for c, f in of.items()])
    return out.select(["symbol", "block", *(f"{c}_{f}" for c, f in of.items())]).rename_columns(["symbol", "block", *of])


def in_blocks(ticks: DataFrame, base: int) -> DataFrame:
    """(symbol, _BLOCK): the ticks (symbol, ts_ms, event_id, mid, spread) of a task and batch, a row for those after a multiple of `base` up to the next."""
    names = [c.split()[0] for c in _BLOCK.split(", ")]

    def run(batches):
        held, wanted = [], MERGED
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held.append(pa.table([t["symbol"], t["block"], t["ts_ms"], t["event_id"], t["mid"], t["mid"], t["mid"], t["spread"], pa.array(np.ones(len(t), np.int64))], names=["symbol", "block", *names]))
            if sum(map(len, held)) >= wanted:
                held = [_merged(pa.concat_tables(held))]
                wanted = len(held[0]) + MERGED
                if len(held[0]) > HELD:
                    yield from held.pop().select(["symbol", *names]).combine_chunks().to_batches()
                    wanted = MERGED
        if held:
            yield from _merged(pa.concat_tables(held)).select(["symbol", *names]).combine_chunks().to_batches()

    numbered = ticks.where("ts_ms IS NOT NULL").select("symbol", F.floor((F.col("ts_ms") - 1) / base).alias("block"), "ts_ms", "event_id", F.col("mid").cast("double").alias("mid"), F.col("spread").cast("double").alias("spread"))
    return numbered.mapInArrow(run, f"symbol string, {_BLOCK}")


def outcomes(anchors: DataFrame, ticks: DataFrame, horizons: dict[str, int], delay: str = "0 seconds", lanes: int = 1, base: int = 1) -> DataFrame:
    """Outcomes as `operators.joins.outcomes` gives them, each once the watermark has reached the end of its horizon.

    `anchors` (symbol, anchor_id, anchor_ms, entry) and `ticks` (symbol, ts_ms, event_id, mid, spread) are streams. With more
    `lanes` the anchors of a symbol are dealt over so many keys, each of which sees all its ticks. Rows behind the watermark are late.
    Where all anchors and horizons are multiples of `base` ms, keys see and hold ticks as blocks of that length, which the tasks that read them make.
    """
    if any(h % base for h in horizons.values()):
        raise ValueError("horizons must be multiples of base")
    lane = F.pmod(F.xxhash64("anchor_id"), F.lit(lanes)).cast("int")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    a = anchors.select("symbol", lane.alias("lane"), F.col("anchor_ms").alias("ts_ms"), *none("long", "event_id", "n"), F.col("entry").alias("mid"), *none("double", "high", "low", "spread"), "anchor_id")
    t = in_blocks(ticks, base).withColumns({"lane": F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))), "anchor_id": F.lit(None).cast("string")})
    both = a.unionByName(t).withColumn("at", event_time(F.col("ts_ms"))).withWatermark("at", delay)
    out = both.groupBy("symbol", "lane").transformWithStateInPandas(_Outcomes(horizons), _OUTCOME, "Append", "EventTime")
    return out.select("anchor_id", "symbol", "anchor_ms", "horizon", "ret", "mfe", "mae", "max_spread", "n_ticks")


# ---- armed plans

#: The score that a trade needs, the most a score is, limits of the counter breakout.
MIN_SCORE, MOST, RSI_HIGH, RSI_LOW, IMPULSE_ATR = 74, 100, 55.0, 45.0, 1.5
PLAN_IN = "ts_ms long, event_id long, candidate boolean, way int, score int, setup string, trigger_up boolean, trigger_down boolean, boost_up int, boost_down int, breakout int, rsi double, impulse double"
PLAN_OUT = "ts_ms long, event_id long, action string, way int, score int, setup string"
#: used, way (0: not armed), score, setup, and the way and setup that were cancelled.
_PLAN = "used boolean, way int, score int, setup string, cancelled_way int, cancelled_setup string"
NO_PLAN = (False, 0, 0, "-", 0, "-")


def countered(way: int, breakout: int, rsi: float, impulse: float) -> bool:
    """A confirmed breakout against an armed plan, which momentum and the size of the move since the bar's open agree with."""
    if breakout != -way or not np.isfinite(rsi) or not np.isfinite(impulse):
        return False
    return (rsi >= RSI_HIGH if way < 0 else rsi <= RSI_LOW) and breakout * impulse + 1e-9 >= IMPULSE_ATR


def advance(plan: tuple, row: tuple) -> tuple[tuple, tuple]:
    """(plan, (action, way, score, setup)) after an observation: the plan that is armed is judged before a new one may take its place.

    A cancelled plan never turns into its opposite at once, and its like is not armed again in the same bar; after an
    entry the bar is used up.
    """
    used, way, held, setup, gone_way, gone_setup = plan
    _, _, candidate, new_way, score, new_setup, trigger_up, trigger_down, boost_up, boost_down, breakout, rsi, impulse = row
    if used:
        return plan, ("USED", 0, score, "-")
    if way and countered(way, breakout, rsi, impulse):
        return (False, 0, 0, "-", way, setup), ("CANCELLED", way, held, setup)
    before = way
    if candidate and new_way and way in (0, new_way) and (new_way, new_setup) != (gone_way, gone_setup):
        way, held, setup = new_way, score, new_setup
    if not way:
        return (False, 0, 0, "-", gone_way, gone_setup), ("WAITING", 0, score, "-")
    worth = score if candidate and new_way == way else min(MOST, held + (boost_up if way > 0 else boost_down))
    plan = (False, way, held, setup, gone_way, gone_setup)
    if worth >= MIN_SCORE and (trigger_up if way > 0 else trigger_down):
        return (True, 0, 0, "-", gone_way, gone_setup), ("ENTERED", way, worth, setup)
    return plan, ("READY" if worth >= MIN_SCORE else "ARMED" if not before else "HELD", way, worth, setup)


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    """Rows in the types and order of PLAN_IN; what is unknown counts as not there."""
    out = []
    for r in pdf[[c.split()[0] for c in PLAN_IN.split(", ")]].itertuples(index=False):
        flag, whole = (lambda x: False if pd.isna(x) else bool(x)), (lambda x: 0 if pd.isna(x) else int(x))
        number = lambda x: float("nan") if pd.isna(x) else float(x)
        out.append((int(r[0]), int(r[1]), flag(r[2]), whole(r[3]), whole(r[4]), "-" if pd.isna(r[5]) else r[5], flag(r[6]), flag(r[7]), whole(r[8]), whole(r[9]), whole(r[10]), number(r[11]), number(r[12])))
    return out


class _Plans(StatefulProcessor):
    """The plan of a (symbol, bar) and the observations that an earlier one may still come before."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.plan, self.waiting = handle.getValueState("plan", _PLAN), handle.getListState("waiting", PLAN_IN)

    def handleInputRows(self, key, rows, timerValues):
        new = _rows(pd.concat(list(rows), ignore_index=True))
        self.waiting.appendList(new)
        self.handle.registerTimer(min(r[0] for r in new))
        self.handle.registerTimer(int(key[1]) + self.width)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark, end = timerValues.getCurrentWatermarkInMs(), int(key[1]) + self.width
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        plan = tuple(self.plan.get()) if self.plan.exists() else NO_PLAN
        out = []
        for row in (r for r in waiting if r[0] <= mark):
            plan, said = advance(plan, row)
            out.append((row[0], row[1], *said))
        left = [r for r in waiting if r[0] > mark]
        if mark >= end:
            if plan[1]:
                out.append((end, None, "EXPIRED", plan[1], plan[2], plan[3]))
            self.plan.clear()
            self.waiting.clear()
        else:
            self.plan.update(plan)
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(left[0][0])
            else:
                self.waiting.clear()
        if out:
            yield self._frame(key, out)

    @staticmethod
    def _frame(key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=["symbol", "bar_ms", *(c.split()[0] for c in PLAN_OUT.split(", "))])


def _barred(observations: DataFrame, width: int) -> DataFrame:
    return observations.withColumn("bar_ms", F.col("ts_ms") - F.pmod("ts_ms", F.lit(width))).select("symbol", "bar_ms", *(c.split()[0] for c in PLAN_IN.split(", ")))


def armed_plans(observations: DataFrame, width: int, delay: str = "0 seconds") -> DataFrame:
    """What becomes of plans, an action an observation (symbol and PLAN_IN), in the order of time, and EXPIRED where a bar ends an armed one.

    A plan lives within one bar of `width`, so state is held by (symbol, bar) and goes when the watermark has passed the bar.
    Observations of one time are ordered by event_id; one behind the watermark is late and has no action.
    """
    rows = _barred(observations, width).withColumn("at", event_time(F.col("ts_ms"))).withWatermark("at", delay)
    return rows.groupBy("symbol", "bar_ms").transformWithStateInPandas(_Plans(width), f"symbol string, bar_ms long, {PLAN_OUT}", "Append", "EventTime")


def armed_plans_batch(observations: DataFrame, width: int) -> DataFrame:
    """The same over a table: each (symbol, bar) by itself."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        plan, out = NO_PLAN, []
        for row in sorted(_rows(pdf)):
            plan, said = advance(plan, row)
            out.append((row[0], row[1], *said))
        if plan[1]:
            out.append((int(key[1]) + width, None, "EXPIRED", plan[1], plan[2], plan[3]))
        return _Plans._frame(key, out)

    return _barred(observations, width).groupBy("symbol", "bar_ms").applyInPandas(fold, f"symbol string, bar_ms long, {PLAN_OUT}")
