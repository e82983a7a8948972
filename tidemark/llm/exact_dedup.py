"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch of new documents is reduced to one row per
digest (partial aggregation first, so a large group of copies shuffles one row per task), joined with the
index by sort-merge on the bucketing, and digests that the index lacks are appended.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, documents, lower_ascii, small, whole_text

#: The columns this module adds; their names are free of those that documents may bring.
DIGEST = "text_sha256"


class DigestIndex:
    """Digest -> document that stays, kept at `path`, which outlives the session.

    `buckets` (spark.sql.shuffle.partitions by default) is fixed when the index is made: an empty marker file
    in its folder tells later sessions. About 1e7 digests a bucket is a good size at most.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self._made_with(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        buckets = self.buckets
        self.table = "digest_index_" + hashlib.md5(self.path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _made_with(self, buckets: int) -> int:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(conf)
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "_buckets-*")) or []:
            return int(status.getPath().getName().rpartition("-")[2])
        fs.create(jvm.org.apache.hadoop.fs.Path(folder, f"_buckets-{buckets}")).close()
        return buckets

    def entries(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def append(self, new: DataFrame) -> None:
        """One file a bucket; Spark's commit makes the append visible as a whole or not at all."""
        new.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)

    def absent(self, groups: DataFrame, batch: str) -> DataFrame:
        """Groups whose digest no other batch has put into the index (sort-merge anti-join on the buckets)."""
        old = self.entries().where(F.col("batch") != batch).select("digest")
        return groups.hint("merge").join(old, "digest", "left_anti")


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with DIGEST: sha256 of the text, A-Z lower-cased; null counts as empty."""
    return docs.withColumn(DIGEST, F.sha2(lower_ascii(whole_text(text)), 256))


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size (within `docs`), kept, text_sha256; appends to the index.

    Of equal texts in `docs` the largest id stays, unless an earlier batch holds the text: then that batch's
    document stays. Rows that repeat an id with the same text are one document and get the same answer. A null
    id never stays where another id has the text. Running a batch again changes neither index nor answers.
    An empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "exact-dedup")
    each = digests(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", F.col(DIGEST).alias("digest"))
    groups = scratch.write(each.groupBy("digest").agg(F.max("doc_id").alias("own_id"), F.count("*").alias("group_size")), "groups")
    fresh = index.absent(groups, batch)
    mine = index.entries().where(F.col("batch") == batch).select("digest")
    index.append(fresh.join(mine, "digest", "left_anti").select("digest", F.col("own_id").alias("keep_id"), F.lit(batch).alias("batch")))
    found = scratch.write(groups.hint("merge").join(index.entries().select("digest", "keep_id"), "digest"), "found")
    # Both sides are read and shuffled plainly, so that adaptive execution can split a digest that many rows have.
    return each.join(found, "digest").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.col("digest").alias(DIGEST)
    )


def drop_copies(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id") -> DataFrame:
    """`docs` without the rows whose text stays elsewhere; all columns are kept as they are.

    Of rows that repeat one id and text, one stays.
    """
    tagged, scratch = docs.withColumn("__digest", F.sha2(lower_ascii(whole_text()), 256)), Scratch(docs.sparkSession, "drop-copies")
    found = scratch.write(exact_dedup(docs, index, batch, id_col).select("doc_id", "kept", DIGEST), "found")
    dropped = scratch.write(found.where("NOT kept").select(F.col("doc_id").alias("__id"), F.col(DIGEST).alias("__key")).distinct(), "dropped")
    kept = tagged.join(small(dropped), tagged[id_col].eqNullSafe(dropped["__id"]) & (tagged["__digest"] == dropped["__key"]), "left_anti")
    if not found.groupBy("doc_id", DIGEST).count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, "__digest"])
    return kept.drop("__digest")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` as the first batch of an index of its own."""
    scratch = Scratch(spark, "digest-index")
    return exact_dedup(documents(spark, sf_dir), DigestIndex(spark, scratch.path("index")), "documents")


ORACLE = {
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
"""
}
