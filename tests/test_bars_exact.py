"""Bars and roll-ups do not depend on how rows are dealt: bit for bit the same with 1, 8 and 200 partitions."""

import struct

from tidemark.functions.timebase import DAY, HOUR
from tidemark.operators.bars import build_bars, roll_up
from tidemark.plans.base import ticks


def bits(rows):
    return sorted(repr([struct.pack("<d", v) if isinstance(v, float) else v for v in r]) for r in rows)


def test_bars_by_partitions(spark, tiny):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in (1, 8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            t = ticks(spark, tiny).repartition(n)
            hourly = build_bars(t, [HOUR])
            seen.append((bits(hourly.collect()), bits(roll_up(hourly, DAY, 17 * HOUR).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_average_of_a_tie_is_exact(spark):
    rows = [(k, "A", k, 1.0, 0.02 * (1 + k % 7)) for k in range(640)] + [(640, "A", HOUR, 1.0, None)]
    bars = build_bars(spark.createDataFrame(rows, "event_id long, symbol string, ts_ms long, mid double, spread double"), [HOUR], close_last=True)
    got = {b.start_ms: (b.ticks, b.avg_spread) for b in bars.collect()}
    assert got[0] == (640, sum(2 * (1 + k % 7) for k in range(640)) / 100 / 640)
    assert got[HOUR] == (1, None)
