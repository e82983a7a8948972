"""State machines by chunks against a plain loop, exact quantiles by counting, structure of pivots."""

import random

import numpy as np
import pytest

from tidemark.operators import machines, regime, stats


def loop(rows, least=2, enter=0.55, leave=0.45):
    """The rule as a loop over (time, regime, confidence) in order; a time that comes again changes nothing."""
    state, candidate, run, age, last, out = "UNKNOWN", None, 0, 0, None, []
    for at, name, confidence in rows:
        moved = (None, None)
        if at != last:
            last, age = at, age + 1
            if name in (state, "UNKNOWN") or confidence < (leave if state != "UNKNOWN" else enter):
                candidate, run = None, 0
            else:
                candidate, run = (name, run + 1) if name == candidate else (name, 1)
                if name in ("EVENT_SHOCK", "TRANSITION") or run >= least:
                    moved, state, candidate, run, age = (state, name), name, None, 0, 1
        out.append((state, *moved, age))
    return out


@pytest.mark.parametrize("least,width", [(2, 7), (3, 1), (1, 1000)])
def test_settled_regimes(spark, least, width):
    rnd = random.Random(least)
    rows = []
    for key in ("a", "b", None):
        name = "UNKNOWN"
        for t in range(120):
            name = rnd.choice(regime.REGIMES) if rnd.random() < 0.5 else name
            rows += [(key, t, copy, name if copy == 0 else rnd.choice(regime.REGIMES), rnd.choice([0.3, 0.45, 0.5, 0.55, 0.9])) for copy in range(1 + (t % 9 == 0))]
    df = spark.createDataFrame(rows, "symbol string, start_ms long, copy int, regime string, confidence double")
    got = regime.settled(df, ["copy"], least=least, width=width).collect()
    for key in ("a", "b", None):
        mine = sorted((r for r in got if r.symbol == key), key=lambda r: (r.start_ms, r.copy))
        want = loop([(t, n, c) for k, t, _, n, c in rows if k == key], least)
        assert [(r.settled, r.moved_from, r.moved_to, r.age) for r in mine] == want


def test_settled_refuses_wrong_limits(spark):
    df = spark.createDataFrame([], "symbol string, start_ms long, copy int, regime string, confidence double")
    with pytest.raises(ValueError):
        regime.settled(df, ["copy"], enter=0.4, leave=0.5)
    assert regime.settled(df, ["copy"]).collect() == []


def test_effects_compose():
    machine = machines.Machine.of(0, 3, lambda s, x: ((s * 2 + x) % 5, (s + x) % 3 == 0))
    rnd = random.Random(1)
    letters = [rnd.randrange(3) for _ in range(50)]
    state, age, entered = machine.effect(letters)
    first, second = machine.effect(letters[:20]), machine.effect(letters[20:])
    for s in range(len(machine.states)):
        middle = first[0][s]
        assert state[s] == second[0][middle] and entered[s] == (first[2][s] or second[2][middle])
        assert age[s] == (second[1][middle] if second[2][middle] else first[1][s] + second[1][middle])


def test_exact_quantiles(spark):
    rnd = np.random.default_rng(4)
    groups = {"a": rnd.normal(size=5000), "b": np.array([1.0] * 3000 + [2.0] * 10), "c": np.array([7.0]), None: np.arange(10.0)}
    rows = [(k, "x", float(v)) for k, values in groups.items() for v in values] + [("a", "x", None), ("none", "x", None)]
    df = spark.createDataFrame(rows, "g string, h string, v double").repartition(5)
    shares = [0.0, 0.2, 0.5, 0.8, 1.0]
    got = {r.g: r for r in stats.exact_quantiles(df, ["g", "h"], "v", shares, ranges=16).collect()}
    assert set(got) == {"a", "b", "c", None, "none"} and got["none"].cuts is None and got["none"].known == 0
    for k, values in groups.items():
        assert got[k].known == len(values) and got[k].cuts == pytest.approx(np.quantile(values, shares).tolist(), abs=1e-12)
    assert stats.exact_quantiles(df, [], "v", [0.5]).collect()[0].known == sum(map(len, groups.values()))
    assert stats.exact_quantiles(df.where("false"), ["g"], "v", [0.5]).collect() == []


def test_structure_of_alternating_pivots(spark):
    rnd = random.Random(5)
    bars = [("s", t, 100 + rnd.gauss(0, 3)) for t in range(150)]
    rows = [(s, t, p + abs(rnd.gauss(0, 1)), p - abs(rnd.gauss(0, 1)), 2.0 if t > 5 else None) for s, t, p in bars]
    got = [r.structure for r in regime.structured(spark.createDataFrame(rows, "symbol string, start_ms long, high double, low double, atr double")).orderBy("start_ms").collect()]
    pivots, want = [], []
    for t, (_, _, _, _, atr) in enumerate(rows):
        if t >= 4 and atr:
            five = rows[t - 4 : t + 1]
            up, down = five[2][2] > max(five[k][2] for k in (0, 1, 3, 4)), five[2][3] < min(five[k][3] for k in (0, 1, 3, 4))
            if up != down:
                kind, price = ("H", five[2][2]) if up else ("L", five[2][3])
                if pivots and pivots[-1][0] == kind:
                    pivots[-1] = (kind, (max if up else min)(price, pivots[-1][1]))
                else:
                    pivots.append((kind, price))
        moves = [p[-1] - p[-2] for p in ([x for k, x in pivots if k == kind] for kind in "HL") if len(p) > 1]
        if len(moves) < 2 or not atr:
            want.append("UNKNOWN")
        else:
            signs = {(m > 0.2) - (m < -0.2) for m in moves}
            want.append({(1,): "BULLISH", (-1,): "BEARISH", (0,): "RANGE"}.get(tuple(signs), "MIXED"))
    assert got == want and {"BULLISH", "BEARISH", "MIXED"} <= set(got)
