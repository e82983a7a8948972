"""Patterns on drawn series: shapes, the close that decides them, mirrored prices."""

import pytest

from tidemark.operators import patterns

SCHEMA = "symbol string, start_ms long, close_ms long, open double, high double, low double, close double, ticks long"
POLE = [100.0] * 20 + [99.5, 99.0, 98.0] + [98.0 + k for k in range(1, 11)] + [107.2, 106.4, 105.6, 106.2, 106.8, 107.4, 106.6, 105.8, 105.0]
RISING_LOWS = [105.0] * 20 + [106, 107, 108, 109, 110, 108, 106, 104, 102, 100, 102, 104, 106, 108, 110, 109, 107.5, 106, 105, 104, 105, 106, 107.5, 109, 110, 109.6, 109.2, 108.8, 108.4, 108]


def bars(spark, symbols):
    rows = []
    for name, closes in symbols.items():
        for k, c in enumerate(closes):
            rows.append((name, k * 60, k * 60 + 60, float(closes[k - 1] if k else c), c + 0.25, c - 0.25, float(c), 5 if k < len(closes) - 1 else 50))
    return spark.createDataFrame(rows, SCHEMA)


def test_flags_and_what_decides_them(spark):
    ends = {"confirmed": [105.8, 106.6, 109.0], "invalid": [105.8, 105.6, 103.0], "waiting": [105.8, 105.6], "expired": [105.8] + [105.6 - 0.1 * k for k in range(12)]}
    series = {f"up {n}": POLE + e for n, e in ends.items()}
    series |= {n.replace("up", "down"): [200 - c for c in s] for n, s in series.items()}
    got = {r.symbol: r for r in patterns.continuation(bars(spark, series)).collect()}
    assert set(got) == set(series)
    states = {"confirmed": "CONFIRMED", "invalid": "INVALIDATED", "waiting": "CANDIDATE", "expired": "EXPIRED"}
    for n, state in states.items():
        up, down = got[f"up {n}"], got[f"down {n}"]
        assert (up.pattern, up.state, up.newest) == ("BULL_FLAG", state, True) and (down.pattern, down.state) == ("BEAR_FLAG", state)
        assert up.quality == pytest.approx(down.quality) and (up.side, down.side) == ((None, None) if n == "waiting" else (1, -1))
        assert up.first_ms == 22 * 60 and up.end_ms == 41 * 60 and up.known_ms == 44 * 60
    assert got["up confirmed"].event_ms == 44 * 60 and got["up expired"].event_ms == (41 + 13) * 60
    # Volume and body count for the confirming bar: 5 points each, and the strength of the break.
    assert got["up confirmed"].quality > got["up waiting"].quality + 10


def test_a_weak_pole_is_none_and_a_short_or_empty_series_gives_nothing(spark):
    weak = [100 + (c - 100) / 100 if k < 33 else c for k, c in enumerate(POLE)]
    assert patterns.continuation(bars(spark, {"a": weak + [105.8, 106.6, 109.0], "b": POLE[:15], "c": [5.0]})).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert patterns.continuation(empty).count() == 0 and patterns.convergence(empty).count() == 0
    gaps = spark.createDataFrame([("a", k, k + 1, None, None, None, None, None) for k in range(30)], SCHEMA)
    assert patterns.continuation(gaps).count() == 0 and patterns.convergence(gaps).count() == 0


def test_triangles_and_what_decides_them(spark):
    series = {"long": RISING_LOWS + [109, 109.3, 111.5], "short": RISING_LOWS + [108.5, 108.4, 104.0], "near apex": RISING_LOWS + [108.9, 109.2, 109.5, 109.6, 109.7, 109.8]}
    series |= {f"{n} mirrored": [220 - c for c in s] for n, s in series.items()}
    got = {(r.symbol, r.pattern): r for r in patterns.convergence(bars(spark, series)).collect()}
    for mirror, pattern, side in (("", "ASCENDING_TRIANGLE", 1), (" mirrored", "DESCENDING_TRIANGLE", -1)):
        long, short, near = (got[n + mirror, pattern] for n in ("long", "short", "near apex"))
        assert (long.state, long.side) == ("CONFIRMED", side) and (short.state, short.side) == ("INVALIDATED", -side)
        assert (near.state, near.side) == ("EXPIRED", None) and near.event_ms > near.known_ms
    assert got["long", "ASCENDING_TRIANGLE"].quality == pytest.approx(got["long mirrored", "DESCENDING_TRIANGLE"].quality)


def test_of_neighbouring_pivots_each_second_one_goes_and_runs_keep_their_extreme(spark):
    closes = [100.0] * 20 + [101, 103, 106, 103, 101, 102, 104, 107, 104, 102, 100, 97, 100, 102, 103]
    got = [(r.p.kind, r.p.price) for r in patterns.alternating_pivots(patterns.series(bars(spark, {"a": closes}))).orderBy("i").collect()]
    # Between the highs there is a low at 100.75; all three stay, as kinds alternate.
    assert got == [("HIGH", 106.25), ("LOW", 100.75), ("HIGH", 107.25), ("LOW", 96.75)]
