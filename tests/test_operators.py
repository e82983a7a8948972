"""Operators against small cases worked out by hand, and causality: later rows change nothing that was known before."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.functions import timebase as T
from tidemark.operators import bars, episodes, indicators, joins, stats, structure
from tidemark.sources import feeds

BAR = "symbol string, start_ms long, close_ms long, open double, high double, low double, close double, ticks long"


def series(spark, closes, symbol="x"):
    rows = [(symbol, k * T.HOUR, (k + 1) * T.HOUR, float(c), c + 1.0, c - 1.0, float(c), 3) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


def by_time(df, column):
    return [r[column] for r in df.orderBy("start_ms").collect()]


def ema(values, n, sma):
    out, x = [], None
    for k, v in enumerate(values):
        if sma:
            x = sum(values[:n]) / n if k == n - 1 else x if k < n else x + 2 / (n + 1) * (v - x)
        else:
            x = v if k == 0 else x + 2 / (n + 1) * (v - x)
        out.append(x if not sma or k >= n - 1 else None)
    return out


@pytest.mark.parametrize("sma", [True, False])
@pytest.mark.parametrize("width", [3 * T.HOUR, 1000 * T.HOUR])
def test_ema_does_not_depend_on_chunks(spark, sma, width):
    values = [math.sin(k) * 10 + k for k in range(40)]
    got = by_time(indicators.ema(series(spark, values), 5, sma_seed=sma, width=width), "ema")
    want = ema(values, 5, sma)
    assert all((g is None) == (w is None) and (g is None or abs(g - w) < 1e-9) for g, w in zip(got, want))


def test_indicators_are_causal(spark):
    values = [math.sin(k / 3) * 10 + k for k in range(60)]
    whole, part = (indicators.indicators(series(spark, v), width=7 * T.HOUR) for v in (values, values[:45]))
    for name in ("ema", "rsi", "adx", "atr"):
        assert by_time(whole, name)[:45] == pytest.approx(by_time(part, name), nan_ok=True)


def test_rsi_edges(spark):
    assert set(by_time(indicators.rsi(series(spark, range(30))), "rsi")[14:]) == {100.0}
    assert set(by_time(indicators.rsi(series(spark, [5] * 30)), "rsi")[14:]) == {50.0}


def test_bars_hold_the_open_one_back(spark):
    ticks = spark.createDataFrame([("x", 10, 1, 1.0, 0.1), ("x", 10, 0, 2.0, 0.1), ("x", 50, 2, 3.0, 0.3), ("x", 130, 3, 9.0, 0.1)], "symbol string, ts_ms long, event_id long, mid double, spread double")
    (row,) = bars.build_bars(ticks, [100]).collect()
    assert (row.open, row.close, row.high, row.ticks, row.close_spread) == (2.0, 3.0, 3.0, 3, 0.3)
    assert bars.build_bars(ticks, [100], close_last=True).count() == 2


def test_bucket_floors_below_zero(spark):
    assert spark.range(1).select(T.bucket(F.lit(-7), 2)).first()[0] == -8


def test_asof_both_ways(spark):
    left = spark.createDataFrame([("k", 5), ("k", 10), ("k", 300), ("j", 5)], "key string, t long")
    right = spark.createDataFrame([("k", 5, 1), ("k", 7, 2), ("k", 250, 3)], "key string, u long, v long")
    back = {(r.key, r.t): r.asof_v for r in joins.asof_backward(left, right, "key", "t", "u", ["v"], width=20).collect()}
    assert back == {("k", 5): 1, ("k", 10): 2, ("k", 300): 3, ("j", 5): None}
    strict = {(r.key, r.t): r.asof_v for r in joins.asof_backward(left, right, "key", "t", "u", ["v"], strict=True, width=20).collect()}
    assert strict[("k", 5)] is None
    ahead = {(r.key, r.t): (r.asof_v, r.asof_u) for r in joins.asof_forward(left, right, "key", "t", "u", ["v"], width=20).collect()}
    assert ahead == {("k", 5): (1, 5), ("k", 10): (3, 250), ("k", 300): (None, None), ("j", 5): (None, None)}


def test_first_touch_bounds(spark):
    anchors = spark.createDataFrame([(1, "x", 0), (2, "x", 1000)], "anchor_id long, symbol string, anchor_ms long")
    ticks = spark.createDataFrame([("x", 0, 9.0), ("x", 100, 9.0), ("x", 101, 9.0)], "symbol string, ts_ms long, bid double")
    got = {r.anchor_id: r.hit for r in joins.first_touch(anchors, ticks, {"hit": F.col("bid") > 5}, 100).collect()}
    assert got == {1: 100, 2: None}
    late = ticks.where("ts_ms = 101")
    assert joins.first_touch(anchors, late, {"hit": F.col("bid") > 5}, 100).where("hit IS NOT NULL").count() == 0


def test_short_swaps_best_and_worst(spark):
    df = spark.createDataFrame([("SHORT", 1.0, 3.0, -2.0)], "d string, r double, a double, b double")
    assert tuple(df.select(*X.signed_outcome(F.col("d"), F.col("r"), F.col("a"), F.col("b"))).first()) == (-1.0, 2.0, -3.0)


def test_split_keeps_ties_together(spark):
    df = spark.createDataFrame([(t,) for t in [1, 2, 3, 3, 3, 3, 3, 8, 9, 10]], "t long")
    got = {(r.t, r.period) for r in stats.split_by_time(df, "t").collect()}
    assert {p for t, p in got if t == 3} == {"VALIDATION"} and (1, "TRAIN") in got and (9, "OOS") in got
    assert stats.split_by_time(df.limit(0), "t").count() == 0


def test_pivots_and_structure(spark):
    closes = [1, 2, 5, 2, 1, 3, 8, 3, 2, 5, 9, 4, 3, 2]
    p = structure.fractal_pivots(series(spark, closes))
    got = [(r.kind, r.price) for r in p.orderBy("start_ms").collect()]
    assert got == [("HIGH", 6.0), ("LOW", 0.0), ("HIGH", 9.0), ("LOW", 1.0), ("HIGH", 10.0)]
    assert structure.structure(p).orderBy(F.desc("start_ms")).first().structure == "BULLISH"


def test_hysteresis(spark):
    df = spark.createDataFrame([("k", n, s) for n, s in enumerate([0.6, 0.5, 0.6, 0.6, 0.4, 0.5, 0.4, 0.4])], "key string, n int, score double")
    got = [r.regime for r in episodes.hysteresis(df, "key", "n", "score").orderBy("n").collect()]
    assert got == ["OFF", "OFF", "OFF", "ON", "ON", "ON", "ON", "OFF"]


LEDGER = "trade_id long, seq long, event_id string, event string, deal long, gross double, costs double, net double, risk double, r double"


def test_ledger_conflicts(spark):
    fill = lambda t, s, e, d: (t, s, e, "FILL", d, None, None, None, None, None)
    close = lambda t, s, e, d, net=10.25: (t, s, e, "CLOSE", d, 12.0, -1.75, net, 25.0, net / 25)
    rows = [fill(1, 1, "a", 1), close(1, 2, "b", 2), close(1, 3, "b", 2), fill(2, 4, "c", 3), close(2, 5, "d", 4), close(2, 6, "e", 5), fill(3, 7, "f", 6), close(3, 8, "g", 7, 11.0), fill(4, 9, "h", 8), (5, 10, "i", "REJECT", *[None] * 6), fill(6, 11, "j", 9), fill(6, 12, "k", 9)]
    got = {r.trade_id: (r.state, r.net) for r in episodes.ledger(spark.createDataFrame(rows, LEDGER)).collect()}
    assert got == {1: ("CLOSED", 10.25), 2: ("CONFLICT", None), 3: ("CONFLICT", None), 4: ("OPEN", None), 5: ("REJECTED", None), 6: ("CONFLICT", None)}


def test_tick_csv(spark, tmp_path):
    lines = ["﻿<DATE>;<TIME>;<BID>;<ASK>;<LAST>", "2025.05.15;07:12:07.5;10.0;10.2;", "2025-05-15;07:12:08;10.0;9.0;1", "2025/05/15;99:00:00;1;2;3", "2025.05.15;07:12:09.1239;NaN;10;x", ""]
    (tmp_path / "t.csv").write_text("\n".join(lines), encoding="utf-8")
    ticks = feeds.read_ticks(spark, str(tmp_path), "GOLD")
    assert {r.fault for r in ticks.collect()} == {None, "ask_below_bid", "timestamp", "bid_or_ask"}
    good = ticks.where("fault IS NULL").first()
    assert (good.ts_ms, good.symbol) == (1747293127500, "GOLD")
    (row,) = feeds.read_stats(ticks).collect()
    assert (row.good, row.timestamp, row.bid_or_ask, row.ask_below_bid) == (1, 1, 1, 1)


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "sink")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string")
    assert feeds.append_new(df, path, "id") == 2
    assert feeds.append_new(spark.createDataFrame([(2, "b"), (3, "c")], "id long, v string"), path, "id") == 1
    with pytest.raises(ValueError):
        feeds.append_new(spark.createDataFrame([(3, "other")], "id long, v string"), path, "id")


def test_manifest(spark):
    kind = "path string, size long, modified long, digest string"
    now = spark.createDataFrame([("a", 1, 5, "x"), ("b", 1, 9, "y"), ("c", 1, 5, "z"), ("e", 2, 5, "q")], kind)
    known = spark.createDataFrame([("a", 1, 5, "x"), ("b", 1, 5, "o"), ("d", 1, 5, "w"), ("e", 1, 5, "p")], kind)
    got = {r.path: r.state for r in feeds.manifest_states(now, known).collect()}
    assert got == {"a": "SUCCESS", "b": "CHANGED_REQUIRES_REBUILD", "c": "NEW", "d": "MISSING", "e": "WAITING_FOR_STABLE_FILE"}


def test_runtime_target_matches_brute_force(spark):
    from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

    from tidemark.functions import verdicts as V

    rng = random.Random(9)
    rows = [(rng.choice([1, -1]), rng.choice(["GOD", "CHILL"]), round(rng.uniform(50, 60), 2), round(rng.uniform(0.2, 3), 2), round(rng.uniform(0.2, 2), 3), round(rng.uniform(45, 65), 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "way int, class string, entry double, risk double, atr double, obstacle double")
    c = F.col
    target, reason = V.runtime_target(c("way"), c("class"), c("entry"), c("entry") - c("way") * c("risk"), c("atr"), c("obstacle"))
    got = df.select(F.round(target, 2).alias("t"), reason.alias("r")).collect()
    grid = lambda x, up: x.quantize(Decimal("0.01"), ROUND_CEILING if up else ROUND_FLOOR)
    for (way, kind, entry, risk, atr, obstacle), g in zip(rows, got):
        entry, risk, atr, obstacle = (Decimal(str(x)) for x in (entry, risk, atr, obstacle))
        base = grid(entry + way * Decimal("0.75" if kind == "CHILL" else "1.25") * risk, way > 0)
        near = grid(obstacle - way * Decimal("0.2") * atr, way < 0)
        cut = kind == "GOD" and way * (obstacle - entry) > 0 and way * (base - obstacle) >= 0 and way * (near - entry) > 0 and way * (base - near) > 0
        assert Decimal(str(g.t)) == (near if cut else base) and g.r == ("CHILL_FIXED" if kind == "CHILL" else "GOD_OBSTACLE" if cut else "GOD_BASELINE")


def test_contracts_and_provenance_fail_closed(spark):
    from tidemark.functions import verdicts as V
    from tidemark.operators import reports as R

    df = spark.createDataFrame([(1, "CLOSED_M1_ONLY"), (2, "LIVE")], "x int, p string")
    assert R.enforce(df, {"positive": F.col("x") > 0}).count() == 2
    with pytest.raises(Exception, match="contract broken: small"):
        R.enforce(df, {"positive": F.col("x") > 0, "small": F.col("x") < 2}).collect()
    with pytest.raises(Exception, match="not causal: LIVE"):
        df.select(V.causal(F.col("p"), F.col("x"))).collect()


def test_each_tick_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("<DATE>\t<TIME>\t<BID>\t<ASK>\t<FLAGS>\n2025.01.02\t10:00:00.000\t10.0\t10.2\tBID\n2025.01.02\t10:00:01.000\tx\t10.2\t6\n")
    (tmp_path / "b.csv").write_text("Symbol;Ask;Bid;Date;Time\nBIDU;11.2;11.0;2025.01.02;10:00:02.000\n")
    (tmp_path / "c.csv").write_text("2025.01.02,10:00:00.000,1,2\n")
    got = {(r.symbol, r.bid, r.ask, r.fault) for r in feeds.read_ticks(spark, f"file://{tmp_path}", "S").collect()}
    assert got == {("S", 10.0, 10.2, None), ("S", None, 10.2, "bid_or_ask"), ("BIDU", 11.0, 11.2, None), ("S", None, None, "header")}


def test_json_faults_files_and_reports(spark, tmp_path):
    texts = ['{"a": 1}', '{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1e999}', "[1]", "{", None, '{"a": {"b": 1, "b": 1}}']
    got = [r.fault for r in feeds.json_faults(spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1), "t").collect()]
    assert got == [None, "duplicate_key", "not_finite", "not_finite", "not_an_object", "malformed", "malformed", "duplicate_key"]
    feeds.write_report(spark.createDataFrame([(2, "b"), (1, None)], "k int, v string"), f"file://{tmp_path}/report", ["k"])
    assert [r.k for r in spark.read.option("header", True).option("inferSchema", True).csv(f"file://{tmp_path}/report").collect()] == [1, 2]
    found = feeds.discover(spark, f"file://{tmp_path}", "*.csv").collect()
    assert found and all(r.bytes > 0 and r.path.endswith(".csv") for r in found)


def test_ledgers_parts_grow_with_the_events(spark, monkeypatch):
    """Twice as many rows a task as given make as many parts again; events that stand twice count once."""
    rows = [(k // 3, 2 * k + n, f"{'fc'[n]}{k}", ("FILL", "CLOSE")[n], (k, -k - 1)[n], *((None,) * 5 if n == 0 else (5.0, -1.0, 4.0, 100.0, 0.04))) for k in range(300) for n in (0, 1) if n == 0 or k % 3 == 0]
    df = spark.createDataFrame(rows + rows[::5], "trade_id long, seq long, event_id string, event string, deal long, gross double, costs double, net double, risk double, r double")
    monkeypatch.setattr(episodes, "ROWS_A_TASK", 20)
    assert episodes.parts_for(df) == 24 and episodes.parts_for(df.limit(0)) == 4
    out = episodes.ledger(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [event_id" in plan and "RepartitionByExpression [trade_id" in plan and ", 24" in plan
    assert sorted(map(tuple, out.collect())) == [(k, "CLOSED", 4.0, 0.04, 4) for k in range(100)]
