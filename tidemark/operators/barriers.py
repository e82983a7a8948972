"""When a price first crosses a level, and how far it went, after many anchors at once: by extremes of blocks of time.

Blocks of `base`, of FAN times that, and so on up hold the least and the greatest price of each key. A span of time is a
few blocks of each size and two parts of a base block at its ends. A request meets the blocks of its span, takes the first that
crosses its level, and goes down into it; ticks are read in the one base block that is left and in the two ends. So what
is joined grows with the logarithm of the span and with the ticks of a base block, not with the ticks of the span.

Where every tick is an anchor of one span, base blocks would meet all their ticks in pairs. `crossings_ahead` deals ticks to
buckets as long as the span instead, each with the bucket after it, and searches a tree of minima over a bucket's ticks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timebase import MINUTE

#: Blocks below a block, and sizes of blocks, a minute to eight and a half hours; spans of few base blocks need fewer.
FAN, LEVELS = 8, 4

#: Cuts the lineage of a table that is read several times, where the caller gives a way.
Keep = Callable[[DataFrame], DataFrame]


def _same(df: DataFrame) -> DataFrame:
    return df


def blocks(ticks: DataFrame, values: list[str], key: str = "symbol", ts: str = "ts_ms", base: int = MINUTE, keep: Keep = _same, levels: int = LEVELS) -> DataFrame:
    """(key, level, block, rows, low_v and high_v of each value): blocks that hold a tick."""
    ends = lambda low, high: [f(c.format(v)).alias(n.format(v)) for v in values for f, c, n in ((F.min, low, "low_{}"), (F.max, high, "high_{}"))]
    level = ticks.groupBy(F.col(key), F.floor(F.col(ts) / base).alias("block")).agg(F.count("*").alias("rows"), *ends("{}", "{}"))
    level = keep(level)
    out = [level.withColumn("level", F.lit(0))]
    for n in range(1, levels):
        level = level.groupBy(F.col(key), F.floor(F.col("block") / FAN).alias("block")).agg(F.sum("rows").alias("rows"), *ends("low_{}", "high_{}"))
        out.append(level.withColumn("level", F.lit(n)))
    return keep(reduce(DataFrame.unionByName, out))


def cover(begin: Column, end: Column, base: int, levels: int = LEVELS) -> Column:
    """Array of (level, block): the blocks that lie within [begin, end], without the base blocks of its two ends; at most 2 * FAN of a level below the top."""

    def span(level: int, low: Column, high: Column) -> Column:
        return F.transform(F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>")), lambda b: F.struct(F.lit(level).alias("level"), b.alias("block")))

    def at(level: int, low: Column, high: Column) -> Column:
        if level == levels - 1:
            return span(level, low, high)
        up, down = F.ceil(low / FAN), F.floor(high / FAN)
        return F.when(up >= down, span(level, low, high)).otherwise(F.concat(span(level, low, up * FAN), at(level + 1, up, down), span(level, down * FAN, high)))

    return at(0, F.floor(begin / base) + 1, F.floor(end / base))


def _crosses(values: list[str], low: str, high: str) -> Column:
    """Whether a row with the given least and greatest values crosses the request's level."""
    out = F.lit(False)
    for v in values:
        out = F.when(F.col("of") == v, F.when(F.col("falls"), F.col(low.format(v)) <= F.col("level_at")).otherwise(F.col(high.format(v)) >= F.col("level_at"))).otherwise(out)
    return out


def first_crossings(requests: DataFrame, ticks: DataFrame, values: list[str], key: str = "symbol", ts: str = "ts_ms", base: int = MINUTE, keep: Keep = _same, made: DataFrame | None = None, levels: int = LEVELS) -> DataFrame:
    """(request, hit_ms): the first time in [from_ms, until_ms] at which value `of` is at `level_at` or beyond, below it where it `falls`.

    `requests` (request, key, from_ms, until_ms, of, falls, level_at) have an id each; those that nothing crosses, and those
    with a null in a bound or level, have no row. Both ends belong to the span. `made`: the blocks of `ticks`, where they are there.
    """
    asked = requests.where(F.col("from_ms") <= F.col("until_ms")).where("level_at IS NOT NULL").select("request", key, "from_ms", "until_ms", "of", "falls", "level_at")
    known = blocks(ticks, values, key, ts, base, keep, levels) if made is None else made
    crossing = _crosses(values, "low_{}", "high_{}")
    # The first block and its level in one number, which aggregates without a sort.
    width = F.expr(f"CAST(power({FAN}, level) AS BIGINT)")
    first = F.min(F.col("block") * width * levels + F.col("level")).alias("b")

    def pick(rows: DataFrame) -> DataFrame:
        met = rows.join(known, [key, "level", "block"]).where(crossing).groupBy("request").agg(first)
        return met.select("request", F.pmod("b", F.lit(levels)).cast("int").alias("level"), F.floor(F.col("b") / levels).alias("start")).select("request", "level", (F.col("start") / width).cast("long").alias("block"))

    found = pick(asked.withColumn("c", F.explode(cover(F.col("from_ms"), F.col("until_ms"), base, levels))).select(*asked.columns, "c.level", "c.block"))
    for level in range(levels - 1, 0, -1):
        found = keep(found)
        above = found.where(F.col("level") == level).withColumn("block", F.explode(F.sequence(F.col("block") * FAN, F.col("block") * FAN + FAN - 1))).withColumn("level", F.lit(level - 1))
        found = found.where(F.col("level") < level).unionByName(pick(asked.join(above, "request")))
    ends = asked.select("request", F.explode(F.array_distinct(F.array(F.floor(F.col("from_ms") / base), F.floor(F.col("until_ms") / base)))).alias("block"))
    looked = asked.join(ends.unionByName(found.select("request", "block")).distinct(), "request")
    near = ticks.select(key, F.floor(F.col(ts) / base).alias("block"), F.col(ts).alias("__at"), *values)
    hits = looked.join(near, [key, "block"]).where(F.col("__at").between(F.col("from_ms"), F.col("until_ms")) & _crosses(values, "{}", "{}"))
    return hits.groupBy("request").agg(F.min("__at").alias("hit_ms"))


def extremes(requests: DataFrame, ticks: DataFrame, values: list[str], key: str = "symbol", ts: str = "ts_ms", base: int = MINUTE, keep: Keep = _same, made: DataFrame | None = None, levels: int = LEVELS) -> DataFrame:
    """(request, rows, low_v and high_v of each value) of the ticks in [from_ms, until_ms]; a request without any has no row."""
    asked = requests.where(F.col("from_ms") <= F.col("until_ms")).select("request", key, "from_ms", "until_ms")
    known = blocks(ticks, values, key, ts, base, keep, levels) if made is None else made
    both = [f"{end}_{v}" for v in values for end in ("low", "high")]
    whole = asked.withColumn("c", F.explode(cover(F.col("from_ms"), F.col("until_ms"), base, levels))).select("request", key, "c.level", "c.block").join(known, [key, "level", "block"])
    ends = asked.withColumn("block", F.explode(F.array_distinct(F.array(F.floor(F.col("from_ms") / base), F.floor(F.col("until_ms") / base)))))
    near = ticks.select(key, F.floor(F.col(ts) / base).alias("block"), F.col(ts).alias("__at"), F.lit(1).cast("long").alias("rows"), *(F.col(c.partition("_")[2]).alias(c) for c in both))
    near = ends.join(near, [key, "block"]).where(F.col("__at").between(F.col("from_ms"), F.col("until_ms")))
    together = whole.select("request", "rows", *both).unionByName(near.select("request", "rows", *both))
    return together.groupBy("request").agg(F.sum("rows").alias("rows"), *((F.min if c.startswith("low_") else F.max)(c).alias(c) for c in both))


def first_at_most(values: np.ndarray, start: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each start, the first place from there on with a value of `limit` or less; len(values) where there is none."""
    height = len(values).bit_length()
    tree = [np.concatenate([values, np.full((1 << height) - len(values), np.inf)])]
    for _ in range(height):
        tree.append(np.minimum(tree[-1][::2], tree[-1][1::2]))
    place, found = start.copy(), np.full(len(start), -1)
    who = np.arange(len(start))
    for level in range(height):
        # A right child is looked at before the node above and to the right of it.
        at = place[who]
        hit = (at & 1).astype(bool)
        hit[hit] = tree[level][at[hit]] <= limit[who[hit]]
        found[who[hit]] = level
        who, at = who[~hit], at[~hit]
        place[who] = at + 1 >> 1
    top = who[place[who] == 0]
    found[top[tree[height][0] <= limit[top]]] = height
    for level in range(height - 1, -1, -1):
        who = np.flatnonzero(found > level)
        place[who] *= 2
        place[who] += tree[level][place[who]] > limit[who]
    return np.where((found >= 0) & (place < len(values)), place, len(values))


def crossings_ahead(ticks: DataFrame, ends: dict[str, tuple[Column, Column, Column]], values: list[str], span: int, ident: str = "event_id", key: str = "symbol", ts: str = "ts_ms") -> DataFrame:
    """(ident, a column of each of `ends`): for each tick, the first time after it, `span` later at most, at which a price crosses a level.

    An end is (of, falls, level_at), as in first_crossings; it is null where nothing crosses, or where key, time or level are null.
    """
    known = F.col(key).isNotNull() & F.col(ts).isNotNull()
    bucket = F.floor(F.col(ts) / span)
    asked = [x for k, (of, falls, level) in enumerate(ends.values()) for x in (F.when(known, of).alias(f"__of{k}"), falls.alias(f"__falls{k}"), F.when(known, level.cast("double")).alias(f"__level{k}"))]
    dealt = F.explode(F.when(known, F.array(F.struct(F.lit(True).alias("anchor"), bucket.alias("bucket")), F.struct(F.lit(False).alias("anchor"), (bucket - 1).alias("bucket")))).otherwise(F.array(F.struct(F.lit(True).alias("anchor"), bucket.alias("bucket"))))).alias("__d")
    rows = ticks.select(ident, key, F.col(ts).cast("long").alias(ts), *(F.col(v).cast("double").alias(v) for v in values), *asked, dealt).select("*", F.col("__d.anchor").alias("__anchor"), F.col("__d.bucket").alias("__bucket")).drop("__d")
    # NaN is the greatest number, in Spark as in SQL.
    names = list(ends)
    numbers = lambda c, null: np.nan_to_num(pc.fill_null(c, null).to_numpy(), nan=np.inf, posinf=np.inf, neginf=-np.inf)

    def search(part: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part, sort_keys=[(ts, "ascending")])).combine_chunks()
        at = pc.fill_null(part.column(ts), 0).to_numpy()
        anchors = part.filter(part.column("__anchor"))
        own = pc.fill_null(anchors.column(ts), 0).to_numpy()
        start, stop = np.searchsorted(at, own, "right"), np.searchsorted(at, own + span, "right")
        out = []
        for k in range(len(names)):
            when, there, level = np.full(len(own), -1), anchors.column(f"__level{k}").is_valid().to_numpy(), numbers(anchors.column(f"__level{k}"), 0.0)
            for v in values:
                for falls in (True, False):
                    one = there & pc.fill_null(pc.equal(anchors.column(f"__of{k}"), v), False).to_numpy() & (pc.fill_null(anchors.column(f"__falls{k}"), False).to_numpy() == falls)
                    who = np.flatnonzero(one)
                    if len(who):
                        prices = numbers(part.column(v), np.inf) if falls else -numbers(part.column(v), -np.inf)
                        got = first_at_most(prices, start[who], level[who] if falls else -level[who])
                        hit = got < stop[who]
                        when[who[hit]] = got[hit]
            out.append(pa.array(at[when], pa.int64(), mask=when < 0))
        return pa.Table.from_arrays([anchors.column(ident), *out], [ident, *names])

    kind = ticks.schema[ident].dataType.simpleString()
    return rows.groupBy(key, "__bucket").applyInArrow(search, f"{ident} {kind}, " + ", ".join(f"{e} long" for e in names))
