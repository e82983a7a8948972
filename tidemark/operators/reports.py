"""Report rows: paths after an event, first events by rule, tables that keep empty groups, accounting of fields and orphans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.verdicts import release_outcome


def following(n: int, columns: list[str], key: str = "symbol", time: str = "start_ms") -> Column:
    """The next n rows of the key as an array of structs, nearest first."""
    w = Window.partitionBy(key).orderBy(time).rowsBetween(1, n)
    return F.sort_array(F.collect_list(F.struct(time, *columns)).over(w))


def release_paths(bars: DataFrame, span_ms: int, n: int, opposite_atr: float = 0.75, original_atr: float = 0.5) -> DataFrame:
    """`bars` (symbol, start_ms, close_ms, high, low, close, atr, side) with outcome, bars_seen, opposite and original (greatest moves).

    The later bars of `span_ms` after the close count, n at most by construction of the bars. `side` is the stale side.
    """
    later = F.filter(following(n, ["close_ms", "high", "low"]), lambda b: b.close_ms <= F.col("close_ms") + span_ms)
    move = lambda b, up: F.greatest(F.lit(0.0), F.when(F.lit(up) == (F.col("side") == "SHORT"), b.high - F.col("close")).otherwise(F.col("close") - b.low))
    out = bars.withColumn("__later", F.when(F.col("atr") > 0, later).otherwise(F.filter(later, lambda b: F.lit(False))))
    both = F.transform("__later", lambda b: F.struct(b.start_ms.alias("at"), move(b, True).alias("opposite"), move(b, False).alias("original")))
    out = out.withColumn("__moves", both)
    first = lambda name, part: F.array_min(F.transform(F.filter("__moves", lambda m: m[name] >= part * F.col("atr")), lambda m: m["at"]))
    greatest = lambda name: F.coalesce(F.array_max(F.transform("__moves", lambda m: m[name])), F.lit(0.0))
    outcome = release_outcome(first("opposite", opposite_atr), first("original", original_atr), F.size("__moves"))
    return out.withColumns({"outcome": outcome, "bars_seen": F.size("__moves"), "opposite": greatest("opposite"), "original": greatest("original")}).drop("__later", "__moves")


def first_by_rule(rows: DataFrame, episode: list[str], time: str, rules: dict[str, Column]) -> DataFrame:
    """(episode, rule, first): the first time that each rule holds in an episode; rules that never hold have no row."""
    found = rows.groupBy(*episode).agg(*(F.min(F.when(c, F.col(time))).alias(n) for n, c in rules.items()))
    long = found.select(*episode, F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("first")) for n in rules))).alias("r"))
    return long.select(*episode, "r.rule", "r.first").where("first IS NOT NULL")


def with_empty_groups(counted: DataFrame, dims: dict[str, list[str]], values: list[str]) -> DataFrame:
    """`counted` with a row of zeros for each combination of the dimensions' values that it lacks."""
    spark = counted.sparkSession
    combined = [()]
    for names in dims.values():
        combined = [(*c, n) for c in combined for n in names]
    grid = spark.createDataFrame(combined, ", ".join(f"{d} string" for d in dims))
    return grid.join(counted, list(dims), "left").select(*dims, *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def exploded_causes(rows: DataFrame, causes: str, separator: str = ";") -> DataFrame:
    """A row for each cause in the list, with `dominant` for the first; rows without causes go."""
    parts = F.filter(F.split(F.coalesce(causes, F.lit("")), separator), lambda c: c != "")
    return rows.select("*", F.posexplode(parts).alias("__at", "cause")).withColumn("dominant", F.col("__at") == 0).drop("__at")


def by_side(rows: DataFrame, long_score: str, short_score: str) -> DataFrame:
    """Two rows of each, one a side, with that side's score; a null score has no row."""
    sides = F.array(F.struct(F.lit("LONG").alias("side"), F.col(long_score).alias("score")), F.struct(F.lit("SHORT").alias("side"), F.col(short_score).alias("score")))
    return rows.select("*", F.inline(sides)).where("score IS NOT NULL")


def with_all(rows: DataFrame, column: str = "period") -> DataFrame:
    """Each row twice: under its own name and under ALL."""
    return rows.withColumn(column, F.explode(F.array(F.lit("ALL"), F.col(column))))


def sign_agreement(table: DataFrame, keys: list[str], value: str, n: str, least: int, periods: int = 3) -> DataFrame:
    """(keys, agrees): whether all periods have the same sign of `value` and `least` cases each."""
    signs = table.groupBy(*keys).agg(F.min(F.signum(value)).alias("x"), F.max(F.signum(value)).alias("y"), F.min(n).alias("n"), F.count("*").alias("p"))
    return signs.select(*keys, F.coalesce((F.col("x") == F.col("y")) & (F.col("n") >= least) & (F.col("p") >= periods), F.lit(False)).alias("agrees"))


def availability(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, present, missing) in one aggregation."""
    counted = rows.agg(F.count("*").alias("__n"), *(F.count(f).alias(f) for f in fields))
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("present"), (F.col("__n") - F.col(f)).alias("missing")) for f in fields))
    return counted.select(F.inline(each))


def violations(rows: DataFrame, contract: dict[str, Column]) -> DataFrame:
    """(rule, broken): rows that break each rule of a contract; a null condition breaks it."""
    counted = rows.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in contract.items()))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in contract))))


def enforce(rows: DataFrame, contract: dict[str, Column]) -> DataFrame:
    """`rows`; fails as soon as a row that breaks a rule is read."""
    names = reduce(lambda acc, r: acc.when(~F.coalesce(r[1], F.lit(False)), F.lit(r[0])), contract.items(), F.when(F.lit(False), ""))
    return rows.withColumn("__broken", names).where(F.col("__broken").isNull() | F.raise_error(F.concat(F.lit("contract broken: "), "__broken")).isNotNull()).drop("__broken")
