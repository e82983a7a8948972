"""Streams in several batches, rows shuffled within the delay, against the batch operators after every trigger."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins
from tidemark.streaming import late, stateful

HORIZONS = {"short": 500, "long": 3000}


def write(spark, rows, schema, path, n):
    """In n files, which a stream takes one after the other in the order in which they were written."""
    size = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def shuffled(rows, by, spread):
    rnd = random.Random(7)
    return sorted(rows, key=lambda r: r[by] + rnd.randrange(spread))


def batches(spark, stream, path):
    """[(rows of a batch, watermark that it worked with)] until all is taken."""
    found = {}
    with stateful.state_store(spark):
        query = stream.writeStream.outputMode("append").foreachBatch(lambda df, n: found.__setitem__(n, df.collect())).option("checkpointLocation", path).trigger(availableNow=True).start()
        query.awaitTermination()
    marks = {p["batchId"]: datetime.datetime.fromisoformat(p["eventTime"]["watermark"].replace("Z", "+00:00")).timestamp() * 1000 for p in query.recentProgress if "watermark" in p["eventTime"]}
    return [(found[n], round(marks.get(n, 0))) for n in sorted(found)]


@pytest.mark.parametrize("lanes", [1, 3])
def test_outcomes_after_every_batch(spark, tmp_path, lanes):
    rnd = random.Random(3)
    ticks = [(rnd.choice("ab"), rnd.randrange(10_000), k, rnd.gauss(100, 5), rnd.random()) for k in range(400)]
    anchors = [("ab"[k % 2], f"n{k}", 400 * k + 17, 100.0) for k in range(20)]
    t_schema, a_schema = "symbol string, ts_ms long, event_id long, mid double, spread double", "symbol string, anchor_id string, anchor_ms long, entry double"
    # One stream of files holds both, so that anchors and ticks move on together.
    both = [(*t, None) for t in ticks] + [(a[0], a[2], None, a[3], None, a[1]) for a in anchors]
    source = write(spark, shuffled(both, 1, 300), "symbol string, ts_ms long, event_id long, mid double, spread double, anchor_id string", str(tmp_path / "in"), 6)
    a = source.where("anchor_id IS NOT NULL").select("symbol", "anchor_id", F.col("ts_ms").alias("anchor_ms"), F.col("mid").alias("entry"))
    out = stateful.outcomes(a, source.where("anchor_id IS NULL"), HORIZONS, delay="300 milliseconds", lanes=lanes)
    batch = joins.outcomes(spark.createDataFrame(anchors, a_schema), spark.createDataFrame(ticks, t_schema), HORIZONS, price="entry")
    want = {(r.anchor_id, r.horizon): (r.anchor_ms + HORIZONS[r.horizon], r.ret, r.mfe, r.mae, r.max_spread, r.n_ticks) for r in batch.collect()}
    got, sizes = {}, []
    for rows, mark in batches(spark, out, str(tmp_path / "progress")):
        for r in rows:
            assert (r.anchor_id, r.horizon) not in got
            got[r.anchor_id, r.horizon] = (r.anchor_ms + HORIZONS[r.horizon], r.ret, r.mfe, r.mae, r.max_spread, r.n_ticks)
        assert set(got) == {k for k, v in want.items() if v[0] <= mark}
        sizes.append(len(got))
    assert all(got[k] == pytest.approx(want[k]) for k in got) and len(set(sizes)) > 3 and len(got) > 30


def test_plans_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(11)
    rows = []
    for k in range(400):
        rows.append((rnd.choice("ab"), rnd.randrange(20_000), k, rnd.random() < 0.6, rnd.choice([1, 1, -1]), rnd.randrange(60, 90), rnd.choice(["x", "y"]), rnd.random() < 0.2, rnd.random() < 0.2, rnd.randrange(12), rnd.randrange(12), rnd.choice([1, -1, 0]), rnd.choice([40.0, 50.0, 60.0, None]), rnd.choice([-2.0, 2.0, 0.0])))
    schema = f"symbol string, {stateful.PLAN_IN}"
    source = write(spark, shuffled(rows, 1, 400), schema, str(tmp_path / "in"), 5)
    want = sorted(map(tuple, stateful.armed_plans_batch(spark.createDataFrame(rows, schema), 1000).collect()), key=repr)
    got = []
    for found, mark in batches(spark, stateful.armed_plans(source, 1000, "400 milliseconds"), str(tmp_path / "progress")):
        got += map(tuple, found)
        assert sorted(got, key=repr) == [r for r in want if r[2] <= mark]
    assert {r[4] for r in got} == {"WAITING", "ARMED", "HELD", "READY", "ENTERED", "USED", "CANCELLED", "EXPIRED"}


def test_plans_are_judged_before_they_are_replaced():
    up = (0, 1, True, 1, 70, "s", False, False, 10, 0, 0, 50.0, 0.0)
    plan, said = stateful.advance(stateful.NO_PLAN, up)
    assert said == ("ARMED", 1, 70, "s")
    against = (1, 2, True, -1, 90, "t", False, True, 0, 0, -1, 40.0, -1.5)
    gone, said = stateful.advance(plan, against)
    assert said == ("CANCELLED", 1, 70, "s") and gone[1] == 0  # it does not turn round at once
    assert stateful.advance(gone, up)[1][0] == "WAITING"  # its like is not armed again in the bar
    assert stateful.advance(gone, against)[1][:2] == ("ENTERED", -1)
    assert stateful.advance(plan, (*against[:11], 46.0, -1.5))[1] == ("HELD", 1, 70, "s")
    entered, said = stateful.advance(plan, (2, 3, False, 0, 0, "-", True, False, 4, 0, 0, 50.0, 0.0))
    assert said == ("ENTERED", 1, 74, "s") and stateful.advance(entered, up)[1][0] == "USED"


def test_no_late_row_vanishes(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), rnd.randrange(100_000), k, rnd.gauss(100, 5)) for k in range(600)] + [("a", None, 601, 1.0)]
    schema = "symbol string, ts_ms long, event_id long, mid double"
    order = shuffled([r for r in rows if r[1] is not None], 1, 30_000)
    source = write(spark, [*order, rows[-1]], schema, str(tmp_path / "in"), 6)
    path = str(tmp_path / "out")
    late.keep(source, path, 1000, 2000)
    kept = spark.read.parquet(f"{path}/{late.LATE}")
    marks = spark.read.parquet(f"{path}/{late.MARKS}").orderBy("batch").collect()
    assert sum(m.rows for m in marks) == 601 and sum(m.late for m in marks) == kept.count() > 20 and len(marks) >= 6
    everything = spark.createDataFrame(rows, schema)
    whole = {(b.symbol, b.start_ms): tuple(b) for b in late._bars(late._partial(late._at(everything.where("ts_ms IS NOT NULL"), 1000))).collect()}
    newest = max(r[1] for r in rows if r[1] is not None)
    final = {k: v for k, v in whole.items() if k[1] + 1000 <= newest - 2000}
    before = [tuple(b) for b in spark.read.parquet(f"{path}/{late.BARS}").drop("batch").collect()]
    assert len({b[:2] for b in before}) == len(before)
    # On time or late, each row counts once.
    assert sum(b[6] for b in before) + kept.where("ts_ms IS NOT NULL").count() == sum(v[6] for v in final.values())
    got = {b[:2]: tuple(b) for b in late.rebuilt(spark, path, everything, 1000).select("symbol", "start_ms", "open", "high", "low", "close", "ticks").collect()}
    assert got == final and {tuple(b) for b in before} != set(final.values())


def test_outcomes_over_blocks_hold_no_ticks(spark, tmp_path):
    """Ticks on and off the bounds of blocks, several files a batch: the same outcomes, of rows that do not grow with the ticks."""
    rnd = random.Random(5)
    ticks = [(rnd.choice("ab"), rnd.choice([rnd.randrange(20_000), 500 * rnd.randrange(40)]), k, float(rnd.randrange(90)), float(rnd.randrange(9))) for k in range(3000)] + [("a", 40_000, 9999, 1.0, 1.0)]
    anchors = [("ab"[k % 2], f"n{k}", 500 * k + 500, 50.0) for k in range(40)]
    t_schema, a_schema = "symbol string, ts_ms long, event_id long, mid double, spread double", "symbol string, anchor_id string, anchor_ms long, entry double"
    spark.createDataFrame(ticks, t_schema).repartition(3).write.parquet(f"{tmp_path}/ticks")
    spark.createDataFrame(anchors, a_schema).write.parquet(f"{tmp_path}/anchors")
    assert stateful.in_blocks(spark.read.parquet(f"{tmp_path}/ticks").coalesce(1), 500).count() <= 2 * 41 + 1
    read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
    out = stateful.outcomes(read("anchors", a_schema), read("ticks", t_schema), {"short": 500, "long": 3000}, lanes=2, base=500)
    got = sorted(tuple(r) for rows, _ in batches(spark, out, str(tmp_path / "progress")) for r in rows)
    want = joins.outcomes(spark.createDataFrame(anchors, a_schema), spark.createDataFrame(ticks, t_schema), {"short": 500, "long": 3000})
    assert got == sorted(map(tuple, want.select("anchor_id", "symbol", "anchor_ms", "horizon", "ret", "mfe", "mae", "max_spread", "n_ticks").collect()))
    with pytest.raises(ValueError):
        stateful.outcomes(read("anchors", a_schema), read("ticks", t_schema), {"short": 700}, base=500)


def test_a_streams_table_is_written_by_the_tasks_that_read_it(spark, tmp_path):
    from tidemark.plans.streamed import _stream

    _stream(spark, spark.range(0, 1000, numPartitions=3), str(tmp_path / "in"))
    assert len(list((tmp_path / "in").glob("part-*"))) == 3
