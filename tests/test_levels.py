"""Zones of evidence against plain loops, and levels on small series."""

import random

from pyspark.sql import functions as F

from tidemark.operators import levels, structure


def items(rng, n):
    """Evidence with ties of prices, times and distances; prices are multiples of 1/8, so weighted sums are exact."""
    out = []
    for k in range(n):
        frame = rng.choice(["H1", "H4", "M15"])
        kind = rng.choice(["HIGH", "LOW"])
        source = rng.choice([f"CONFIRMED_{frame}_PIVOT_{kind}", "RECENT_H1_HIGH", "H1_CONSOLIDATION_SUPPORT"])
        strength = rng.randint(0, 5)
        out.append((k, kind, 100 + rng.randint(0, 60) / 8, 1000 * rng.randint(1, 8), frame, source, strength, max(1, strength)))
    rng.shuffle(out)
    return out


def clustered(evidence, atr, point=0.01):
    if atr is None or atr <= 0:
        return []
    out = []
    for kind in ("HIGH", "LOW"):
        groups = []
        for e in sorted((e for e in evidence if e[1] == kind and e[2] is not None), key=lambda e: (e[2], e[3], e[5])):
            if groups and e[2] - groups[-1][0][2] <= max(point, atr * 0.15):
                groups[-1].append(e)
            else:
                groups.append([e])
        for g in groups:
            w = [max(1, e[6]) for e in g]
            times = {e[3] for e in g}
            names = {e[5] for e in g}
            if len(times) > 1 and g[-1][2] - g[0][2] <= max(point, atr * 0.2):
                names.add("EQUAL_" + kind)
            strength = min(5, max(e[6] for e in g) + min(2, len(times) - 1))
            major = strength >= 3 or len(times) > 1 or any(e[4] == "H4" for e in g)
            out.append((kind, sum(e[2] * k for e, k in zip(g, w)) / sum(w), len(times), strength, major, sorted(names), min(times), max(times)))
    return sorted(out, key=lambda z: (z[1], z[0]))


def merged(evidence, atr, point=0.01):
    zones = []
    for _, kind, price, at, frame, source, _, weight in sorted(evidence):
        if price is None or atr is None or atr <= 0:
            continue
        best = None
        for z in zones:
            away = abs(z["price"] - price)
            if z["kind"] == kind and away <= max(point, atr * 0.15) + 1e-9 and (best is None or away < best[0]):
                best = (away, z)
        if best is None:
            zones.append({"kind": kind, "price": price, "weight": weight, "n": 1, "touches": 1, "first": at, "last": at, "equal": False})
            continue
        z = best[1]
        if at not in (z["first"], z["last"]):
            z["touches"] += 1
            z["equal"] = z["equal"] or best[0] <= max(point, atr * 0.2) + 1e-9
        z["price"] = (z["price"] * z["weight"] + price * weight) / (z["weight"] + weight)
        z["weight"] += weight
        z["n"] += 1
        z["first"], z["last"] = min(z["first"], at), max(z["last"], at)
    return [tuple(z.values()) for z in zones]


def test_zones_against_loops(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([1.0, 2.5, 5.0, 9.0]), items(rng, rng.randint(0, 40))) for k in range(60)]
    rows += [(60, None, items(rng, 5)), (61, 0.0, items(rng, 5)), (62, 4.0, []), (63, 4.0, [(0, "HIGH", None, 5, "H1", "x", 1, 1), (1, "HIGH", 7.0, 5, "H4", "y", 1, 1)])]
    df = spark.createDataFrame(rows, f"id int, atr double, evidence {levels.EVIDENCE}")
    got = {r.id: r for r in df.select("id", levels.cluster(F.col("evidence"), F.col("atr")).alias("c"), levels.merge_nearest(F.col("evidence"), F.col("atr")).alias("m")).collect()}
    for k, atr, evidence in rows:
        assert [tuple(z) for z in got[k].c] == clustered(evidence, atr), k
        assert [(z.kind, z.price, z.weight, z.evidence, z.touches, z.first_ms, z.last_ms, z.equal) for z in got[k].m] == merged(evidence, atr), k


def test_first_zone_wins_a_tie_and_no_evidence_gives_no_zone(spark):
    rows = [(0, "HIGH", 10.0, 1, "H1", "a", 1, 1), (1, "HIGH", 12.0, 2, "H1", "a", 1, 1), (2, "HIGH", 11.0, 3, "H1", "a", 1, 1)]
    df = spark.createDataFrame([(1, 1.0 / 0.15, rows), (2, 1.0, None)], f"id int, atr double, evidence {levels.EVIDENCE}")
    got = {r.id: r.m for r in df.select("id", levels.merge_nearest(F.col("evidence"), F.col("atr")).alias("m")).collect()}
    assert [(z.price, z.evidence) for z in got[1]] == [(10.5, 2), (12.0, 1)]
    assert not got[2]


def test_signed_values_make_zones_too(spark):
    rows = [(0, "LOW", 0.0, 1, "H1", "a", 1, 1), (1, "LOW", 0.25, 2, "H1", "a", 1, 1), (2, "HIGH", -3.0, 3, "H1", "a", 1, 1), (3, "LOW", None, 4, "H1", "a", 1, 1), (4, "LOW", float("-inf"), 5, "H1", "a", 1, 1)]
    df = spark.createDataFrame([(rows,)], f"evidence {levels.EVIDENCE}")
    (got,) = df.select(levels.merge_nearest(F.col("evidence"), F.lit(2.0), signed=True).alias("s"), levels.merge_nearest(F.col("evidence"), F.lit(2.0)).alias("p")).collect()
    assert [(z.kind, z.price, z.evidence) for z in got.s] == [("LOW", 0.125, 2), ("HIGH", -3.0, 1)]
    assert [(z.kind, z.price, z.evidence) for z in got.p] == [("LOW", 0.25, 1)]


def test_zones_of_zero_values_agree_with_the_sql(spark, tmp_path):
    """Every few hours a low of 0, as in the events of sf0.1."""
    import duckdb

    from tidemark.plans.catalog import ORACLE, QUERIES

    spark.sql(
        "SELECT id AS event_id, CAST(timestamp_seconds(1704067200 + id * 300) AS TIMESTAMP_NTZ) AS ts, id % 7 AS user_id, 'view' AS event_type, IF(id % 97 = 0, 0D, CAST(pmod(id * 7919, 997) AS DOUBLE) / 100) AS value FROM range(900)"
    ).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES["nearest_zone_merge"](spark, str(tmp_path))
    names = ", ".join(got.columns)
    rows = sorted(map(tuple, got.collect()))
    assert rows and rows == sorted(con.sql(f"SELECT {names} FROM ({ORACLE['nearest_zone_merge']})").fetchall())


def test_a_group_ends_by_its_first_price(spark):
    # Each price is within 5 of the one before, so a chain would never end.
    rows = [("a", 0, 1000 * k, 100.0 + 3 * k) for k in range(6)] + [("a", 0, 9000, None)]
    got = structure.zones(spark.createDataFrame(rows, "symbol string, period long, start_ms long, price double"), 5.0).orderBy("zone").collect()
    assert [(r.zone, r.low, r.high, r.touches) for r in got] == [(0, 100.0, 103.0, 2), (1, 106.0, 109.0, 2), (2, 112.0, 115.0, 2)]


def test_pivots_are_spaced_and_alternate(spark):
    p = [(3, 30, "HIGH", 5.0), (4, 40, "LOW", 1.0), (6, 60, "HIGH", 5.0), (9, 90, "HIGH", 6.0), (11, 110, "LOW", 2.0), (14, 140, "LOW", 2.0)]
    df = spark.createDataFrame([(p,), ([],)], "p array<struct<i:int,start_ms:long,kind:string,price:double>>")
    got = [[(x.i, x.kind) for x in r.q] for r in df.select(levels.alternating(levels.spaced(F.col("p"))).alias("q")).collect()]
    # The low right after the first high is too near; of three highs the greatest stays, of two equal lows the first.
    assert got == [[(9, "HIGH"), (11, "LOW")], []]


def test_a_pivot_is_not_seen_before_it_is_confirmed_nor_after_its_bars(spark):
    schema = "symbol string, start_ms long, close_ms long"
    bars = spark.createDataFrame([("a", k * 10, k * 10 + 10) for k in range(8)], schema)
    pivots = spark.createDataFrame([("a", 20, 50, "HIGH", 7.0), ("a", 20, 50, "LOW", 6.0), ("a", 30, 60, "LOW", 1.0)], "symbol string, start_ms long, confirmed_ms long, kind string, price double")
    got = [[(p.start_ms, p.kind) for p in r.pivots] for r in levels.available_pivots(pivots, bars, 4).orderBy("start_ms").collect()]
    two, three = [(20, "HIGH"), (20, "LOW")], [(30, "LOW")]
    assert got == [[], [], [], [], two, two + three, three, []]
    assert [len(r.pivots) for r in levels.available_pivots(pivots, bars, 4, newest=1).orderBy("start_ms").collect()] == [0, 0, 0, 0, 1, 1, 1, 0]
    assert levels.evidence(spark.createDataFrame([], "symbol string, width long, start_ms long, close_ms long, open double, high double, low double, close double")).count() == 0
