"""Block extremes against a plain search over all ticks."""

import random

from pyspark.sql import functions as F

from tidemark.operators import barriers, joins


def made(spark, seed=1):
    rnd = random.Random(seed)
    ticks, price = [], {"a": 100.0, "b": 50.0}
    for k in range(1500):
        s = rnd.choice("ab")
        price[s] += rnd.gauss(0, 1)
        ticks.append((s, rnd.choice([k * 40, k * 40 + rnd.randrange(400), 20_000]), price[s], price[s] + rnd.random()))
    requests = []
    for k in range(300):
        begin = rnd.randrange(-2000, 62_000)
        until = rnd.choice([begin, begin + rnd.randrange(30_000), begin + 200_000, begin - 5, None])
        requests.append((k, rnd.choice(["a", "b", "none"]), begin, until, rnd.choice(["bid", "ask"]), rnd.random() < 0.5, rnd.choice([price["a"] + rnd.gauss(0, 15), price["b"] + rnd.gauss(0, 15), None])))
    return ticks, requests, spark.createDataFrame(ticks, "symbol string, ts_ms long, bid double, ask double"), spark.createDataFrame(requests, "request long, symbol string, from_ms long, until_ms long, of string, falls boolean, level_at double")


def test_first_crossings(spark):
    ticks, requests, t, r = made(spark)
    want = {}
    for k, key, begin, until, of, falls, level in requests:
        if until is not None and level is not None:
            inside = [(ts, bid if of == "bid" else ask) for s, ts, bid, ask in ticks if s == key and begin <= ts <= until]
            hits = [ts for ts, v in inside if (v <= level if falls else v >= level)]
            if hits:
                want[k] = min(hits)
    for base, levels in ((1000, 2), (37, 4)):
        assert {x.request: x.hit_ms for x in barriers.first_crossings(r, t, ["bid", "ask"], base=base, levels=levels).collect()} == want
    assert len(want) > 25


def test_extremes(spark):
    ticks, requests, t, r = made(spark, 2)
    want = {}
    for k, key, begin, until, *_ in requests:
        inside = [bid for s, ts, bid, _ in ticks if until is not None and s == key and begin <= ts <= until]
        if inside:
            want[k] = (len(inside), min(inside), max(inside))
    assert {x.request: (x.rows, x.low_bid, x.high_bid) for x in barriers.extremes(r, t, ["bid"], base=100).collect()} == want
    assert barriers.extremes(r, t.where("false"), ["bid"]).collect() == [] == barriers.first_crossings(r.where("false"), t, ["bid", "ask"]).collect()


def test_covers_are_exact_and_short(spark):
    rows = [(b, b + n) for b in range(0, 4000, 137) for n in (0, 5, 63, 64, 1000, 5000)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", barriers.cover(F.col("a"), F.col("b"), 1).alias("c"))
    for r in df.collect():
        got = [x for c in r.c for x in range(c.block * barriers.FAN**c.level, (c.block + 1) * barriers.FAN**c.level)]
        assert got == list(range(r.a + 1, r.b)) and len(r.c) <= 2 * barriers.FAN * (barriers.LEVELS - 1) + 5000 // barriers.FAN ** (barriers.LEVELS - 1) + 2


def test_outcomes_are_made_of_blocks(spark):
    """Anchors on and off the blocks' bounds, ticks on the bounds, a symbol without ticks and none; no anchor meets all its ticks."""
    rng = random.Random(9)
    ticks = [(rng.choice("ab"), rng.choice([rng.randrange(9000), 500 * rng.randrange(18)]), k, float(rng.randrange(100)), float(rng.randrange(9))) for k in range(600)]
    anchors = [(f"n{k}", rng.choice("abc"), rng.choice([rng.randrange(9000), 500 * rng.randrange(18)]), 50.0) for k in range(80)] + [("none", None, 0, 1.0)]
    spans = {"short": 500, "middle": 1250, "long": 4000}
    df = joins.outcomes(spark.createDataFrame(anchors, "anchor_id string, symbol string, anchor_ms long, entry double"), spark.createDataFrame(ticks, "symbol string, ts_ms long, event_id long, mid double, spread double"), spans)
    want = []
    for ident, symbol, at, entry in anchors:
        for name, span in spans.items():
            t = sorted((x[1:] for x in ticks if x[0] == symbol and at < x[1] <= at + span))
            mids = [x[2] for x in t]
            want.append((ident, symbol, at, entry, name, *((mids[-1] - entry, max(mids) - entry, min(mids) - entry, max(x[3] for x in t), len(t)) if t else (None, None, None, None, 0))))
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :]


def test_crossings_ahead_of_every_tick(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.choice(["a", "b", None]), rnd.choice([k * 40, k * 40 + rnd.randrange(400), 20_000, 3_000, None]), rnd.choice([100 + rnd.gauss(0, 9), 100.0, None, float("nan")]), 100 + rnd.gauss(0, 9), rnd.choice(["bid", "ask"]), rnd.random() < 0.5, rnd.choice([100 + rnd.gauss(0, 12), 100.0, None])) for k in range(700)]
    t = spark.createDataFrame(rows, "event_id long, symbol string, ts_ms long, bid double, ask double, of string, falls boolean, level double")
    end = lambda falls: (F.col("of"), falls, F.col("level"))
    for span in (1_000, 7_000, 10**6):
        got = barriers.crossings_ahead(t, {"one": end(F.col("falls")), "other": end(~F.col("falls"))}, ["bid", "ask"], span).collect()
        assert len(got) == len(rows)
        of_id = {r.event_id: (r.one, r.other) for r in got}
        for k, symbol, at, _, _, of, falls, level in rows:
            ahead = [(ts, bid if of == "bid" else ask) for _, s, ts, bid, ask, *_ in rows if None not in (symbol, at, level, s, ts) and s == symbol and at < ts <= at + span]
            ahead = [(ts, float("inf") if v != v else v) for ts, v in ahead if v is not None]
            want = [min((ts for ts, v in ahead if (v <= level if down else v >= level)), default=None) for down in (falls, not falls)]
            assert of_id[k] == tuple(want)
    assert barriers.crossings_ahead(t.where("false"), {"one": end(F.col("falls"))}, ["bid", "ask"], 5).collect() == []


def test_touches_of_all_ticks_are_found_without_pairs(spark, tiny):
    from tidemark.plans.catalog import QUERIES

    for name in ("stop_target_summary", "first_touch_barriers"):
        assert "Join" not in QUERIES[name](spark, tiny)._jdf.queryExecution().toString()
