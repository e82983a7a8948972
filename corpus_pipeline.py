"""From documents to token ids: toxicity, exact copies, near copies, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the shared folder as
Parquet and gives it to the next. All but the last return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, mixing, near_copies, sentencepiece_codec, toxicity
from tidemark.llm.common import Scratch, documents

#: Near copies: words in a shingle, and the least share of common shingles (Jaccard) that a dropped document has with the one that stays.
SHINGLE, SIMILARITY = 5, 0.8
#: Share of the tokens that mixing keeps.
BUDGET = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, fitted on the labels of the documents at `sf_dir`.

    Null and empty texts get a score as any other; repeated rows get the same one. No rows give none.
    """
    model = toxicity.train(toxicity.training_sample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.score_toxicity(docs, model, column="__toxicity").where(F.col("__toxicity") < toxicity.THRESHOLD).drop("__toxicity")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, A-Z lower-cased: that with the largest id. A null text is an empty one.

    Rows that repeat id and text are one document. A null id stays only where no other has the text. No rows give none.
    """
    index = exact_dedup.DigestIndex(spark, Scratch(spark, "pipeline-index").path("index"))
    return exact_dedup.drop_copies(docs, index, "documents")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Texts without a word, null ones too, are near copies of each other; rows that repeat id and text are one document;
    null ids come last. No rows give none.
    """
    return near_copies.drop_near_copies(docs, SHINGLE, SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of BUDGET of the tokens whose margins are levelled. Null sources and languages are a name of their own.

    Texts without a token are not drawn, unless there are no others. Repeated rows stay or go together. No rows give none.
    """
    return mixing.mix(docs, budget=BUDGET).where("mix_drawn").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, parity of the documents that stay; a null text has no ids. No rows give none."""
    return sentencepiece_codec.digests(sentencepiece_codec.encode_documents(docs, sentencepiece_codec.model_bytes()))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The stages fit a network, follow links and rake weights, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for `documents`."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
