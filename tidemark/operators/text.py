"""News and consensus: keyword sentiment, title deduplication, ranking, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import clamp


def sentiment(text: Column, weights: dict[str, int], most: int = 8) -> tuple[Column, Column]:
    """(sum of the weights of keywords in the text, clamped; the first ten found)."""
    low = F.lower(text)
    hit = {w: low.contains(w) for w in weights}
    total = sum((F.when(hit[w], v).otherwise(0) for w, v in weights.items()), F.lit(0))
    found = F.array_compact(F.array(*(F.when(hit[w], F.lit(w)) for w in weights)))
    return clamp(total, -most, most).cast("int"), F.slice(found, 1, 10)


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def distinct_titles(rows: DataFrame, title: str, prefer: list[Column]) -> DataFrame:
    """One row for each normalised title: the first by `prefer`."""
    keyed = rows.withColumn("title_key", normal_title(F.col(title)))
    return keyed.withColumn("__n", F.row_number().over(Window.partitionBy("title_key").orderBy(*prefer))).where("__n = 1").drop("__n")


def consensus(votes: DataFrame, item: str, voter: str, side: str, weight: str) -> DataFrame:
    """Net side of each voter, then the weighted share of either side, by item; 60 % makes a consensus."""
    net = votes.groupBy(item, voter).agg(F.sum(F.when(F.col(side) == "LONG", 1).otherwise(-1)).alias("net"), F.max(weight).alias("w"))
    out = net.groupBy(item).agg(F.sum(F.when(F.col("net") > 0, F.col("w")).otherwise(0.0)).alias("long_w"), F.sum(F.when(F.col("net") < 0, F.col("w")).otherwise(0.0)).alias("short_w"), F.count("*").alias("voters"))
    total = F.col("long_w") + F.col("short_w")
    share = F.when(total > 0, F.col("long_w") / total)
    return out.withColumns({"long_share": share, "consensus": F.when(share >= 0.6, "LONG").when(share <= 0.4, "SHORT").when(share.isNull(), "NONE").otherwise("MIXED")})
