"""Mixing to target weights: iterative proportional fitting of token weights, then sampling.

Documents are added up to cells (source, language, topic); the cells' token masses are raked until their margins
meet the targets, no cell giving more than it has, and a cell's documents are drawn with the probability that gives its
raked mass. The cell table is made in Spark. Up to CELLS_AT_DRIVER cells, which are sums over names, are raked in one loop
on the driver; a larger table stays in Spark, and a few sums a sweep reach the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, documents

MARGINS = ("source", "lang", "topic")
#: Margins are met when no target is off by more than this share of it, or after so many sweeps.
TOLERANCE, SWEEPS = 3e-3, 30
#: Cells, of some 100 bytes, that the driver rakes itself.
CELLS_AT_DRIVER = 100_000
#: Sweeps that bring the worst target no nearer by a tenth, after which targets count as contradicting each other.
STUCK = 3
#: Weights above 1 all mean the probability 1; they are kept for later sweeps, up to this.
CEILING = 1e6
#: Targets are natural shares to these powers: below 1 they level large and small groups.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Share of all tokens to be drawn.
BUDGET = 0.6
SEED = 17
UNNAMED = "?"


def topic_of(text: Column) -> Column:
    """A topic by form, where no column of topics is at hand: the first rule that holds."""
    return (
        F.when(text.isNull() | (F.length(text) == 0), "empty")
        .when(text.contains("icensed under") | text.contains("opyright"), "licence")
        .when(text.rlike(r"[\w.]+@[\w.]+\.\w"), "contact")
        .when(text.contains(" | "), "table")
        .when(F.length(text) < 400, "short")
        .when(F.length(text) >= 8000, "long")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """Words, as the measure of mass: runs of anything but white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("double")


def tempered(cells: DataFrame, powers: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """Targets (name, share) of each margin: its natural token shares to a power, made to sum to 1."""
    out = {}
    for margin, power in (powers or POWERS).items():
        sums = cells.groupBy(F.col(margin).alias("name")).agg(F.pow(F.sum("mass"), F.lit(power)).alias("x")).where("x > 0")
        whole = sums.agg(F.sum("x")).first()[0] or 1.0
        out[margin] = sums.select("name", (F.col("x") / F.lit(whole)).alias("share"))
    return out


def attainable(cells: DataFrame, targets: dict[str, DataFrame], total: float, budget: float, scratch: Scratch) -> DataFrame:
    """(margin, name, share, want): tokens of each name, `budget` of all in each margin, by the shares but never more than there are.

    What a name lacks the others of its margin get. Names without a target want nothing; a target without mass is left
    out, and the others share its part. Each step fixes the names that the last scale would exhaust, so the scale only
    grows and soon stays.
    """
    parts = []
    for margin, target in targets.items():
        mass = cells.groupBy(F.col(margin).alias("name")).agg(F.sum("mass").alias("mass"))
        share = F.when(F.col("mass") > 0, F.coalesce(F.col("share"), F.lit(0.0))).otherwise(0.0)
        parts.append(mass.join(target.select("name", "share"), "name", "left").select(F.lit(margin).alias("margin"), "name", "mass", share.alias("share")))
    names = scratch.write(reduce(DataFrame.union, parts), "names")
    wanted, whole = min(budget, 1.0) * total, {r.margin: r.x or 1.0 for r in names.groupBy("margin").agg(F.sum("share").alias("x")).collect()}
    by_margin = lambda of: reduce(lambda out, m: out.when(F.col("margin") == m, F.lit(float(of[m]))), of, F.when(F.lit(False), 0.0))
    scale = {m: wanted / whole.get(m, 1.0) for m in targets}
    for _ in range(50):
        full = by_margin(scale) * F.col("share") >= F.col("mass")
        sums = names.where("share > 0").groupBy("margin").agg(F.sum(F.when(full, F.col("mass")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("share"))).alias("free"))
        new = {r.margin: max(scale[r.margin], (wanted - r.full) / r.free if r.free > 0 else 0.0) for r in sums.collect()}
        if all(x <= scale[m] * (1 + 1e-12) for m, x in new.items()):
            break
        scale |= new
    share = F.col("share") / by_margin(whole)
    return scratch.write(names.select("margin", "name", share.alias("share"), F.least(F.col("mass"), by_margin(scale) * F.col("share")).alias("want")), "wanted")


def rake_arrays(names: dict[str, list], mass: np.ndarray, raked: np.ndarray, wanted: dict[str, dict], capped: bool, tolerance: float, sweeps: int) -> np.ndarray:
    """The steps of `rake` over cells in arrays: `names` has each cell's name by margin, `wanted` what a name wants."""
    codes, wants = {}, {}
    for margin, own in names.items():
        order = {name: k for k, name in enumerate(dict.fromkeys(own))}
        codes[margin] = np.fromiter((order[x] for x in own), np.int64, len(own))
        wants[margin] = np.array([wanted[margin].get(x, np.nan) for x in order], float)
    some, least, stuck = mass > 0, float("inf"), 0
    for _ in range(sweeps):
        worst = 0.0
        for margin, code in codes.items():
            n, full_cell = len(wants[margin]), (raked >= 1) & capped
            per_name = lambda x, code=code, n=n: np.bincount(code[some], x[some], n)
            full, free, want = per_name(np.where(full_cell, mass, 0.0)), per_name(np.where(full_cell, 0.0, mass * raked)), wants[margin]
            here, given = (np.bincount(code[some], minlength=n) > 0) & ~np.isnan(want), full + free
            with np.errstate(divide="ignore", invalid="ignore"):
                factor = np.where((free > 0) & (want > full), (want - full) / free, np.where(given > 0, want / given, 1.0))
                apart = np.where(want > 0, np.abs(given / want - 1), np.where(given > 0, 1.0, 0.0))
            raked = np.minimum(raked * np.where(here, factor, 0.0)[code], CEILING)
            worst = max(worst, apart[here].max(initial=0.0))
        stuck = stuck + 1 if worst > 0.9 * least else 0
        least = min(least, worst)
        if worst < tolerance or stuck == STUCK:
            break
    return raked


def rake(cells: DataFrame, start: Column, wanted: DataFrame, capped: bool, scratch: Scratch, tolerance: float = TOLERANCE, sweeps: int = SWEEPS) -> DataFrame:
    """`cells` (margins, mass, ...) with `raked`, from `start` on, so that mass * raked meets `wanted` (margin, name, want).

    Up to CELLS_AT_DRIVER cells, a table of sums, are raked in one numpy loop (`rake_arrays`); more by Spark, by the same steps.

    For each margin in turn a name's cells are scaled so that they give what it wants. Where `capped`, a cell gives its
    mass at most: cells at 1 or above count as they are and only the others are scaled to the rest, so margins hold under
    the cap. Margins that contradict each other leave the last one met and the others as near as the sweeps came.
    """
    margins = [r.margin for r in wanted.select("margin").distinct().orderBy("margin").collect()]
    if cells.count() <= CELLS_AT_DRIVER:
        started = cells.withColumn("raked", F.when(F.col("mass") > 0, start).otherwise(0.0).cast("double"))
        table = started.toArrow()
        want = {m: {r.name: r.want for r in wanted.where(F.col("margin") == m).collect()} for m in margins}  # a row a name of the cells
        mass, raked = (table.column(c).to_numpy().astype(float) for c in ("mass", "raked"))
        found = rake_arrays({m: table.column(m).to_pylist() for m in margins}, mass, raked, want, capped, tolerance, sweeps)
        table = table.set_column(table.schema.get_field_index("raked"), "raked", pa.array(found, pa.float64()))
        return scratch.write(cells.sparkSession.createDataFrame(table, started.schema), f"raked-{capped}")
    current = scratch.write(cells.withColumn("raked", F.when(F.col("mass") > 0, start).otherwise(0.0)), f"raked-{capped}-0")
    least, stuck = float("inf"), 0
    for sweep in range(1, sweeps + 1):
        df, off = current, F.lit(0.0)
        for margin in margins:
            full = (F.col("raked") >= 1) & F.lit(capped)
            have = df.where("mass > 0").groupBy(margin).agg(F.sum(F.when(full, F.col("mass")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("mass") * F.col("raked"))).alias("free"))
            want = wanted.where(F.col("margin") == margin).select(F.col("name").alias(margin), "want")
            given = F.col("full") + F.col("free")
            factor = F.when((F.col("free") > 0) & (F.col("want") > F.col("full")), (F.col("want") - F.col("full")) / F.col("free")).when(given > 0, F.col("want") / given).otherwise(1.0)
            apart = F.when(F.col("want") > 0, F.abs(given / F.col("want") - 1)).otherwise(F.when(given > 0, 1.0).otherwise(0.0))
            df = df.join(have.join(want, margin).select(margin, factor.alias("factor"), apart.alias("apart")), margin, "left")
            df = df.withColumn("raked", F.least(F.col("raked") * F.coalesce("factor", F.lit(0.0)), F.lit(CEILING)))
            df = df.withColumn("__off", F.greatest(off, F.coalesce("apart", F.lit(0.0)))).drop("factor", "apart")
            off = F.col("__off")
        done = scratch.write(df, f"raked-{capped}-{sweep}")
        worst = done.agg(F.max("__off")).first()[0] or 0.0
        current = done.drop("__off")
        scratch.drop(f"raked-{capped}-{sweep - 1}")
        stuck = stuck + 1 if worst > 0.9 * least else 0
        least = min(least, worst)
        if worst < tolerance or stuck == STUCK:
            break
    return current


def weigh(cells: DataFrame, targets: dict[str, DataFrame], budget: float, scratch: Scratch) -> DataFrame:
    """`cells` with `weight`, raked to the targets as they are, and `probability`, raked to what is attainable of them at `budget`."""
    total = cells.agg(F.sum("mass")).first()[0] or 0.0
    if not total:
        return cells.withColumns({"weight": F.lit(1.0), "probability": F.lit(1.0)})
    wanted = attainable(cells, targets, total, budget, scratch)
    weighed = rake(cells, F.lit(1.0), wanted.select("margin", "name", (F.col("share") * total).alias("want")), False, scratch).withColumnRenamed("raked", "weight")
    found = rake(weighed, F.col("weight") * budget, wanted, True, scratch)
    return found.withColumn("probability", F.least(F.lit(1.0), "raked")).drop("raked")


def draw(id_col: str, seed: int = SEED) -> Column:
    """A uniform number in [0, 1) that depends on the id and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11).cast("double") / float(1 << 53)


def mix(docs: DataFrame, topic: Column | None = None, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with mix_topic, mix_tokens, mix_weight, mix_probability and mix_drawn; columns of these names are replaced.

    Null sources, languages and topics are one name, UNNAMED, as is everything where the column is not there. Documents of no tokens have no mass and are not
    drawn, unless none has any: then all are. Rows that repeat an id share their number, so copies stay or go
    together. `targets` gives (name, share) by margin; natural shares to POWERS where it is not given. mix_weight is the
    weight raked to the targets; mix_probability is raked under the cap of 1; `budget` is the share of all tokens that is expected to be drawn.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    docs = docs.drop("mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_drawn")
    name = lambda c: F.coalesce(c.cast("string"), F.lit(UNNAMED))
    keyed = docs.withColumns({"mix_topic": name(topic if topic is not None else topic_of(F.col(text))), "mix_tokens": tokens_of(F.col(text))})
    given = lambda c: F.col(c) if c in docs.columns else F.lit(None)
    of = {"source": name(given("source")), "lang": name(given("lang")), "topic": F.col("mix_topic")}
    cells = scratch.write(keyed.groupBy(*(c.alias(m) for m, c in of.items())).agg(F.sum("mix_tokens").alias("mass"), F.count("*").alias("documents")), "cells")
    found = weigh(cells, tempered(cells) if targets is None else targets, budget, scratch)
    found = scratch.write(found.select(*(F.col(m).alias(f"__{m}") for m in MARGINS), F.col("weight").alias("mix_weight"), F.col("probability").alias("mix_probability")), "found")
    on = of["source"] == found["__source"]
    on &= (of["lang"] == found["__lang"]) & (of["topic"] == found["__topic"])
    joined = keyed.join(found, on, "left").drop(*(f"__{m}" for m in MARGINS))
    return joined.withColumn("mix_drawn", draw(id_col) < F.col("mix_probability"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select(
        "doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").cast("long").alias("n_tokens"),
        F.col("mix_weight").alias("weight"), F.col("mix_probability").alias("probability"), F.col("mix_drawn").alias("drawn"),
    )
