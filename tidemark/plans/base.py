"""What the registered queries share: their registry, the driver's tables as ticks and bars, and the same in DuckDB SQL."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timebase import HOUR, wall_ms
from tidemark.operators.bars import build_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers f(spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as quotes: a symbol is an event type."""
    half = 0.01 * (1 + F.col("event_id") % 7)
    return table(spark, sf_dir, "events").select(
        "event_id", wall_ms(F.col("ts")).alias("ts_ms"), F.col("event_type").alias("symbol"), "user_id", F.col("value").alias("mid"), (2 * half).alias("spread"), (F.col("value") - half).alias("bid"), (F.col("value") + half).alias("ask")
    )


def bars(spark: SparkSession, sf_dir: str, width: int = HOUR) -> DataFrame:
    return build_bars(ticks(spark, sf_dir), [width])


def scratch(spark: SparkSession) -> str:
    """A new folder in that which the cluster names in spark.checkpoint.dir; a temporary one where it is unset and all runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    path = f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"

    def drop():
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended before
            pass

    atexit.register(drop)
    return path


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder, for plans that read it several times; it also cuts the lineage."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def r(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    """Rounded for comparison."""
    c, name = (F.col(c), name or c) if isinstance(c, str) else (c, name)
    return F.round(c, digits).alias(name)


TICKS = "ticks AS (SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, event_type AS symbol, user_id, value AS mid, 2 * (CAST(0.01 AS DOUBLE) * (1 + event_id % 7)) AS spread, value - CAST(0.01 AS DOUBLE) * (1 + event_id % 7) AS bid, value + CAST(0.01 AS DOUBLE) * (1 + event_id % 7) AS ask FROM events)"


def bars_sql(width: int = HOUR, name: str = "bars") -> str:
    return f"""{name} AS (SELECT *, start_ms + {width} AS close_ms FROM (
  SELECT symbol, ts_ms - ts_ms % {width} AS start_ms, arg_min(mid, (ts_ms, event_id)) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, (ts_ms, event_id)) AS close,
    count(*) AS ticks, sum(CAST(spread AS DECIMAL(27, 8))) AS spread_sum, CAST(sum(CAST(spread AS DECIMAL(27, 8))) AS DOUBLE) / count(*) AS avg_spread, min(spread) AS min_spread, max(spread) AS max_spread, arg_max(spread, (ts_ms, event_id)) AS close_spread
  FROM ticks GROUP BY 1, 2) QUALIFY start_ms < max(start_ms) OVER (PARTITION BY symbol))"""


WITH = f"WITH {TICKS}, {bars_sql()}"
