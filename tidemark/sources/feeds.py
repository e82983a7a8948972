"""Readers and writers: tick CSV with reasons for what is discarded, JSON lines, manifests, deduplicating sinks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import quote_fault
from tidemark.functions.timebase import parse_wall


def _headers(lines: DataFrame) -> DataFrame:
    """(file, head, sep, names) of each file: the line that names DATE, TIME, BID and ASK, whole and not as part of a value."""
    plain = F.upper(F.regexp_replace(F.trim("value"), "[<>\ufeff]", ""))
    named = lines.withColumn("__plain", plain)
    for name in ("DATE", "TIME", "BID", "ASK"):
        named = named.where(F.col("__plain").rlike(rf"(^|[\t,;])\s*{name}\s*([\t,;]|$)"))
    count = lambda c: F.length("__plain") - F.length(F.replace("__plain", F.lit(c)))
    sep = F.when((count("\t") >= count(",")) & (count("\t") >= count(";")), "\t").when(count(",") >= count(";"), ",").otherwise(";")
    one = named.groupBy("file").agg(F.min_by(F.struct("value", "__plain"), F.length("value")).alias("h")).select("file", F.col("h.value").alias("head"), F.col("h.__plain").alias("__plain"))
    return one.withColumn("sep", sep).select("file", "head", "sep", F.transform(F.split("__plain", F.col("sep")), lambda n: F.trim(n)).alias("names"))


def read_ticks(spark: SparkSession, path: str, symbol: str = "") -> DataFrame:
    """Rows of tick CSV files with `fault`: null for a good row.

    The separator (tab, comma or semicolon) and the columns come from each file's own header: names in angle
    brackets or not, DATE, TIME, BID and ASK wanted, LAST, VOLUME, FLAGS and SYMBOL optional. Faults: header (the file has
    none), timestamp, bid_or_ask, ask_below_bid. Optional numbers that do not parse are null.
    """
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    heads = _headers(lines)
    if heads.isEmpty():
        raise ValueError("no header with DATE, TIME, BID and ASK was found")
    body = lines.where(F.trim("value") != "").join(heads, "file", "left").where("head IS NULL OR value <> head")
    part = F.split("value", F.coalesce("sep", F.lit(",")))
    col = lambda n: F.trim(F.try_element_at(part, F.nullif(F.array_position("names", n), F.lit(0)).cast("int")))
    out = body.select(
        "file", parse_wall(col("DATE"), col("TIME")).alias("ts_ms"), col("BID").try_cast("double").alias("bid"), col("ASK").try_cast("double").alias("ask"), col("LAST").try_cast("double").alias("last"),
        col("VOLUME").try_cast("double").alias("volume"), col("FLAGS").alias("flags"), F.coalesce(col("SYMBOL"), F.lit(symbol)).alias("symbol"), F.col("head").isNull().alias("__bare"),
    )
    return out.withColumn("fault", F.when(F.col("__bare"), "header").otherwise(quote_fault(F.col("bid"), F.col("ask"), F.col("ts_ms")))).drop("__bare")


def discover(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, modified) of the files below a folder; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def json_faults(records: DataFrame, column: str) -> DataFrame:
    """`records` with `fault`: malformed, not_an_object, duplicate_key or not_finite, which Spark's reader lets pass; null for a good object."""

    class Refused(Exception):
        pass

    def pairs(items):
        if len({k for k, _ in items}) < len(items):
            raise Refused("duplicate_key")
        return dict(items)

    def constant(_):
        raise Refused("not_finite")

    def number(text):
        value = float(text)
        return value if abs(value) != float("inf") else constant(text)

    def fault(text):
        try:
            found = json.loads(text, object_pairs_hook=pairs, parse_constant=constant, parse_float=number)
        except Refused as e:
            return str(e)
        except (TypeError, ValueError, RecursionError):
            return "malformed"
        return None if isinstance(found, dict) else "not_an_object"

    @F.pandas_udf("string")
    def faults(texts: pd.Series) -> pd.Series:
        return texts.map(fault)

    return records.withColumn("fault", faults(F.col(column).cast("string")))


def write_report(rows: DataFrame, path: str, order: list[str]) -> None:
    """CSV with a header, sorted within and across its files by `order`; a report that is there is replaced."""
    rows.orderBy(*order).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_stats(ticks: DataFrame) -> DataFrame:
    """Per file: good rows, first and last time, and the number of each fault."""
    return ticks.groupBy("file").agg(
        F.count_if(F.col("fault").isNull()).alias("good"), F.min(F.when(F.col("fault").isNull(), F.col("ts_ms"))).alias("first_ms"), F.max(F.when(F.col("fault").isNull(), F.col("ts_ms"))).alias("last_ms"),
        *(F.count_if(F.col("fault") == f).alias(f) for f in ("timestamp", "bid_or_ask", "ask_below_bid")),
    )


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; strict fails on a malformed line, else `malformed` holds it."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, malformed string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed").json(path)


def conflicts(records: DataFrame, ident: str) -> DataFrame:
    """Ids under which different contents stand."""
    content = F.sha2(F.to_json(F.struct(*sorted(records.columns))), 256)
    return records.select(ident, content.alias("__c")).groupBy(ident).agg(F.countDistinct("__c").alias("contents")).where("contents > 1")


def append_new(records: DataFrame, path: str, ident: str) -> int:
    """Appends the records whose id is not at `path`; fails if an id stands for other contents. Gives how many it wrote."""
    spark = records.sparkSession
    if not conflicts(records, ident).isEmpty():
        raise ValueError("one id stands for different records in the batch")
    fresh = records.dropDuplicates([ident])
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        old = spark.read.schema(records.schema).parquet(path)
        if not conflicts(old.join(records.select(ident), ident, "left_semi").unionByName(records), ident).isEmpty():
            raise ValueError("an id at hand stands for another record")
        fresh = fresh.join(old.select(ident), ident, "left_anti")
    n = fresh.count()
    fresh.write.mode("append").parquet(path)
    return n


def manifest_states(current: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, size, modified, digest) of a scan against the manifest: NEW, SUCCESS, CHANGED_REQUIRES_REBUILD, WAITING_FOR_STABLE_FILE or MISSING."""
    both = current.alias("c").join(known.alias("k"), "path", "full_outer")
    state = (
        F.when(F.col("c.size").isNull(), "MISSING").when(F.col("k.size").isNull(), "NEW").when(F.col("c.digest") == F.col("k.digest"), "SUCCESS")
        .when(F.col("c.modified") > F.col("k.modified"), "CHANGED_REQUIRES_REBUILD").otherwise("WAITING_FOR_STABLE_FILE")
    )
    return both.select("path", state.alias("state"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified, digest) of files, by Spark's binary reader."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"))


def out_of_order(ticks: DataFrame, order: str) -> DataFrame:
    """Rows of a file that are earlier than the row before them."""
    before = F.lag("ts_ms").over(Window.partitionBy("file").orderBy(order))
    return ticks.withColumn("before_ms", before).where("ts_ms < before_ms")
