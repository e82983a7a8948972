"""Queries over whole tables, which have no SQL, against brute force on the first events."""

import pytest

from tidemark.plans.base import ticks
from tidemark.plans.catalog import QUERIES

HOURS_4 = 4 * 3_600_000


@pytest.fixture(scope="module")
def small(spark, tiny, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small"))
    spark.read.parquet(f"{tiny}/events.parquet").orderBy("ts", "event_id").limit(400).write.parquet(f"{path}/events.parquet")
    return path


@pytest.fixture(scope="module")
def rows(spark, small):
    return ticks(spark, small).collect()


def touches(rows):
    out = {}
    for a in rows:
        long = a.event_id % 2 == 0
        after = [t for t in rows if t.symbol == a.symbol and a.ts_ms < t.ts_ms <= a.ts_ms + HOURS_4]
        stop = [t.ts_ms for t in after if (t.bid <= a.ask * 0.5 if long else t.ask >= a.ask * 1.5)]
        target = [t.ts_ms for t in after if (t.bid >= a.ask * 1.5 if long else t.ask <= a.ask * 0.5)]
        out[a.event_id] = (min(stop, default=None), min(target, default=None))
    return out


def first(stop, target):
    return "NEITHER" if stop is None and target is None else "STOP" if target is None or stop is not None and stop <= target else "TARGET"


def test_entry_of_every_tick(spark, small, rows):
    got = {r.event_id: (r.entry_id, r.entry) for r in QUERIES["entry_tick_lookup"](spark, small).collect()}
    assert set(got) == {a.event_id for a in rows}
    for a in rows:
        after = [t for t in rows if t.symbol == a.symbol and t.ts_ms > a.ts_ms]
        at = min((t.ts_ms for t in after), default=None)
        fit = {t.event_id: t.ask for t in after if t.ts_ms == at}
        entry_id, entry = got[a.event_id]
        assert entry_id in fit if fit else entry_id is None
        assert entry == pytest.approx(fit[entry_id], abs=1e-6) if fit and at <= a.ts_ms + 1 + HOURS_4 else entry is None


def test_barriers_of_every_tick(spark, small, rows):
    got = {r.anchor_id: (r.stop_ms, r.target_ms, r.first) for r in QUERIES["first_touch_barriers"](spark, small).collect()}
    want = touches(rows)
    assert got == {k: (*v, first(*v)) for k, v in want.items()} and len({v[2] for v in got.values()}) > 1
    summary = QUERIES["stop_target_summary"](spark, small).collect()[0]
    won = sum(t is not None and (s is None or t < s) for s, t in want.values()) / len(rows)
    assert summary.asDict() == {"cases": len(rows), "stopped": sum(s is not None for s, _ in want.values()), "reached": sum(t is not None for _, t in want.values()), "target_first": pytest.approx(won, abs=1e-6)}


def test_history_grows_with_the_table(spark, tiny, small):
    for path in (tiny, small):
        events = spark.read.parquet(f"{path}/events.parquet").select("event_id", "event_type", "ts").collect()
        cut = sorted(e.ts for e in events)[int(len(events) * 0.6)]
        known = {e.event_id for e in events if e.ts < cut}
        want = {}
        for e in events:
            if e.event_id not in known:
                want[e.event_type] = want.get(e.event_type, 0) + 1
        assert {r.event_type: r.fresh for r in QUERIES["dedup_against_history"](spark, path).collect()} == want
