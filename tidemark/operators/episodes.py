"""Runs of a state, episodes, priorities, segments without gaps, state machines and ledger projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timebase import DAY
from tidemark.operators.machines import Machine, named, run


def runs(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """`df` with `run`: the number of the unbroken stretch of one state, by key."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = (~F.col(state).eqNullSafe(F.lag(state).over(w))) | (F.row_number().over(w) == 1)
    return df.withColumn("run", F.sum(changed.cast("int")).over(w))


def run_table(df: DataFrame, key: str, ts: str, order: list[str], state: str, drop_open: bool = True) -> DataFrame:
    """One row a run: state, begin, end (begin of the next), length; the last run, which has no end, is left out on request."""
    table = runs(df, key, order, state).groupBy(key, "run").agg(F.first(state).alias("state"), F.min(ts).alias("begin_ms"), F.count("*").alias("length"))
    table = table.withColumn("end_ms", F.lead("begin_ms").over(Window.partitionBy(key).orderBy("run")))
    return table.where("end_ms IS NOT NULL") if drop_open else table


def transitions(table: DataFrame, key: str) -> DataFrame:
    """How often each state follows each other."""
    pairs = table.withColumn("next_state", F.lead("state").over(Window.partitionBy(key).orderBy("run"))).where("next_state IS NOT NULL")
    return pairs.groupBy("state", "next_state").agg(F.count("*").alias("n"), F.avg(F.col("length").cast("double")).alias("mean_length"))


def first_per(df: DataFrame, by: list, order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def newest_segment(df: DataFrame, key: str, ts: str, limit_ms: int, most: int, tie: str) -> DataFrame:
    """Rows of each key back from the newest until a gap over `limit_ms`, `most` at most (the feature's limit)."""
    back = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    gap = F.coalesce(F.lag(ts).over(back) - F.col(ts), F.lit(0))
    marked = df.withColumn("__cut", F.sum((gap > limit_ms).cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(back))
    return marked.where(f"__cut = 0 AND __n <= {most}").drop("__cut", "__n")


def hysteresis(df: DataFrame, key: str, order: str, score: str, enter: float = 0.55, leave: float = 0.45, least: int = 2, width: int = 30 * DAY) -> DataFrame:
    """`regime`: ON after `least` rows in a row at `enter` or more, OFF again after as many below `leave`; a null score ends a streak.

    A machine over chunks of `width` in the unit of `order` (operators/machines.py).
    """

    def rule(state, letter):
        on, streak = state
        streak = streak + 1 if (letter & 2 if on else letter & 1) else 0
        return ((not on, 0), True) if streak >= least else ((on, streak), False)

    machine = Machine.of((False, 0), 4, rule)
    high, low = (F.coalesce(c, F.lit(False)).cast("int") for c in (F.col(score) >= enter, F.col(score) < leave))
    out = run(df, machine, high + 2 * low, key, [order], width)
    return out.withColumn("regime", named(F.col("after"), ["ON" if on else "OFF" for on, _ in machine.states])).drop("before", "after", "entered", "age")


#: Rows that a task sorts or groups at once, where tables are dealt by their size.
ROWS_A_TASK = 1_000_000


def parts_for(df: DataFrame) -> int:
    """Into how many parts `df` is dealt so that each has some ROWS_A_TASK rows, the session's number of shuffle partitions at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_A_TASK))


def ledger(events: DataFrame, parts: int | None = None) -> DataFrame:
    """One row a trade out of its events (trade_id, seq, event_id, event, deal, gross, costs, net, risk, r).

    The first row of an event id counts. A trade is in CONFLICT if one deal stands under several event ids, if it is closed
    twice, if gross and costs do not make net within 0.011, or if net / risk is not r within 0.001; REJECTED only
    before any fill; else CLOSED, OPEN or PENDING. Events are dealt into `parts` by event, then by trade, so that a task's share need not grow
    with the table (`parts_for`, which counts rows).
    """
    parts = parts or parts_for(events)
    once = first_per(events.repartition(parts, "event_id"), ["event_id"], ["seq"]).repartition(parts, "trade_id")
    deal = once.where("deal IS NOT NULL").groupBy("trade_id", "deal").agg(F.count("*").alias("n")).where("n > 1").select("trade_id").distinct().withColumn("twice", F.lit(True))
    close = F.col("event") == "CLOSE"
    bad = close & ((F.abs(F.col("gross") + F.col("costs") - F.col("net")) > 0.011) | (F.abs(F.col("net") / F.col("risk") - F.col("r")) > 0.001) | F.col("net").isNull())
    per = once.groupBy("trade_id").agg(
        F.count_if(close).alias("closes"), F.count_if(F.col("event") == "FILL").alias("fills"), F.count_if(F.col("event") == "REJECT").alias("rejects"),
        F.count_if(bad).alias("bad"), F.max(F.when(close, F.col("net"))).alias("net"), F.max(F.when(close, F.col("r"))).alias("r"), F.count("*").alias("events"),
    ).join(deal, "trade_id", "left")
    conflict = F.coalesce("twice", F.lit(False)) | (F.col("closes") > 1) | (F.col("bad") > 0)
    state = F.when(conflict, "CONFLICT").when(F.col("closes") == 1, "CLOSED").when(F.col("fills") > 0, "OPEN").when(F.col("rejects") > 0, "REJECTED").otherwise("PENDING")
    return per.select("trade_id", state.alias("state"), F.when(state == "CLOSED", F.col("net")).alias("net"), F.when(state == "CLOSED", F.col("r")).alias("r"), "events")
