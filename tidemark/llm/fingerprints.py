"""Canonical exact fingerprints, by DataFrame functions alone.

A text's canonical form is NFC normalised (ICU, called by SQL's `reflect`), case folded and has each run of white
space as one space. Its fingerprint is two xxhash64 of that form with different seeds: 128 bits. Where several
documents share a fingerprint their canonical bytes are compared; a fingerprint under which they differ gets a
part of the form's SHA-256 appended, so different texts never share one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, documents, whole_text

#: Documents in one bucket of neighbouring ids, on average, and the most buckets there are (their table is broadcast).
BUCKET_ROWS = 64
MOST_BUCKETS = 1_000_000
#: Ids (8 bytes each) up to which a list of ids is broadcast rather than shuffled.
BROADCAST_IDS = 500_000


def canonical(text: Column) -> Column:
    nfc = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    # Folding by way of upper case; Spark leaves the sharp s, and a final sigma differs from others.
    folded = F.replace(F.replace(F.lower(F.upper(nfc)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_xxhash(canon: Column) -> Column:
    """32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("wide"), canon)), 16, "0")))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`docs` with next_<column>: that column of the next row in ascending (doc_id, text) order, after the last of the first.

    Ids are cut into buckets of equal width; within a bucket the next row is the window's lead, and the first
    row of each bucket is also put behind the one before it. The bucket table has MOST_BUCKETS rows at most.
    """
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high = (0, 0) if low is None else (low, high)
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    width = (high - low) // buckets + 1
    key = F.coalesce("doc_id", F.lit(low))
    placed = docs.withColumn("__key", key).withColumn("__bucket", F.expr(f"CAST((__key - {low}) DIV {width} AS INT)"))
    firsts = docs.select(key.alias("__key")).withColumn("__bucket", F.expr(f"CAST((__key - {low}) DIV {width} AS INT)")).groupBy("__bucket").agg(F.min("__key").alias("__key"))
    last = F.max("__bucket").over(Window.partitionBy())
    before = F.coalesce(F.lag("__bucket").over(Window.orderBy("__bucket")), last)
    halo = firsts.select("__key", before.alias("__before"))
    both = F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("extra")), F.struct(F.col("__before").alias("b"), F.lit(True).alias("extra")))
    one = F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("extra")))
    spread = placed.join(F.broadcast(halo), "__key", "left").withColumn("__at", F.explode(F.when(F.col("__before").isNull(), one).otherwise(both)))
    spread = spread.select(*docs.columns, F.col("__at.b").alias("__bucket"), F.col("__at.extra").alias("__extra"))
    order = Window.partitionBy("__bucket").orderBy("__extra", "doc_id", "text")
    out = spread.select(*docs.columns, "__extra", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return out.where("NOT __extra").drop("__extra")


def differing(docs: DataFrame, shared: DataFrame, fp: Column, scratch: Scratch) -> DataFrame:
    """(fp): fingerprints in `shared` under which canonical bytes differ. `docs` is (doc_id, text)."""
    ids = scratch.write(shared.select("doc_id").distinct(), "shared-ids")
    n = ids.count()
    if not n:
        return shared.select("fp").limit(0)
    texts = docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    canon = texts.select(canonical(F.col("text")).alias("canon")).select(fp.alias("fp"), "canon")
    return canon.groupBy("fp").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b").select("fp")


def document_fingerprints(docs: DataFrame, digest: Callable[[Column], Column] = wide_xxhash, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars/2) code points replaced by the first as many of the next text in
    ascending (doc_id, text) order, null ids first; after the last row comes the first, which of a single row is
    itself. An exact fingerprint's likeness is 1 where the canonical bytes are equal and 0 elsewhere. Null texts
    count as empty. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    canon = plain.withColumn("canon", canonical(F.col("text")))
    known = canon.select("doc_id", "text", digest(F.col("canon")).alias("fp"), F.sha2("canon", 256).alias("form"))
    pairs = with_next(known, ["text", "fp"])
    half = F.expr("length(text) DIV 2")
    edited = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    folded = edited.withColumn("edited_canon", canonical(F.col("edited")))
    out = folded.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fp",
        "form",
        digest(F.col("edited_canon")).alias("edited_fp"),
        F.sha2("edited_canon", 256).alias("edited_form"),
        F.when((digest(F.col("edited_canon")) == F.col("fp")) & (canonical(F.col("text")) == F.col("edited_canon")), 1.0).otherwise(0.0).alias("near_edited"),
        F.when((F.col("next_fp") == F.col("fp")) & (canonical(F.col("text")) == canonical(F.col("next_text"))), 1.0).otherwise(0.0).alias("near_next"),
    )
    found = scratch.write(out, "found")
    # Written first: of two plain tables Spark can split a fingerprint that many documents have.
    many = scratch.write(found.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "many")
    clash = scratch.write(differing(plain, found.select("doc_id", "fp").join(many, "fp"), digest(F.col("canon")), scratch), "clash")
    if clash.isEmpty():
        mark = found.withColumns({"fingerprint": F.col("fp"), "edited_fingerprint": F.col("edited_fp")})
    else:
        own = found.join(clash.select("fp", F.lit(True).alias("clash")), "fp", "left")
        own = own.join(clash.select(F.col("fp").alias("edited_fp"), F.lit(True).alias("edited_clash")), "edited_fp", "left")
        told = lambda fp, form, yes: F.concat(fp, F.when(F.col(yes), F.concat(F.lit("-"), F.substring(form, 1, 16))).otherwise(F.lit("")))
        mark = own.withColumns({"fingerprint": told(F.col("fp"), F.col("form"), "clash"), "edited_fingerprint": told(F.col("edited_fp"), F.col("edited_form"), "edited_clash")})
    return mark.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(documents(spark, sf_dir))
