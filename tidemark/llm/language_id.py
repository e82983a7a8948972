"""Language identification with hyperdimensional profiles.

Letters have random +1/-1 vectors. A trigram's vector binds (multiplies) its letters' vectors, each permuted by its
place; a text's vector bundles (adds) those of its trigrams. A language's prototype bundles all of its training
texts, which Spark sums; a text is given the language whose prototype has the greatest cosine with it.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, map_batches

DIMENSIONS = 1024
#: Letter classes: 0 ends words, 1-26 are a-z, other letters share the rest by code point.
CLASSES = 64
SEED = 7
#: Code points handled at once.
SLICE = 1_000_000
#: What a text without letters is given.
UNKNOWN = "und"


@lru_cache(1)
def letter_classes() -> np.ndarray:
    """Class of each code point."""
    points = np.arange(sys.maxunicode + 1)
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in points), bool, len(points))
    classes = np.where(letter, 27 + points % (CLASSES - 27), 0)
    classes[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return classes.astype(np.uint8)


@lru_cache(1)
def letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter vectors for the first, second and third place of a trigram: permuted twice, once and not at all."""
    rng = np.random.default_rng(SEED)
    letters = rng.choice(np.array([-1, 1], np.float32), (CLASSES, DIMENSIONS))
    order = rng.permutation(DIMENSIONS)
    return np.ascontiguousarray(letters[:, order][:, order]), np.ascontiguousarray(letters[:, order]), letters


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    first, second, third = letter_vectors()
    return first[codes // CLASSES**2] * second[codes // CLASSES % CLASSES] * third[codes % CLASSES]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, trigram code) of all trigrams; runs of what is no letter count as one word end."""
    lowered = [f" {t.lower()} " if t else " " for t in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    classes = letter_classes()[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)]
    of = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    stay = np.ones(len(classes), bool)
    stay[1:] = (classes[1:] != 0) | (classes[:-1] != 0) | (of[1:] != of[:-1])
    classes, of = classes[stay].astype(np.int32), of[stay]
    if len(classes) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    codes = (classes[:-2] * CLASSES + classes[1:-1]) * CLASSES + classes[2:]
    inside = (of[:-2] == of[2:]) & (classes[1:-1] != 0)
    return of[:-2][inside], codes[inside]


def slices(texts: list[str | None]):
    """Runs of texts of about SLICE code points."""
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t or "") + 2
        if size >= SLICE:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def bundles(texts: list[str | None]) -> np.ndarray:
    """One vector per text."""
    of, codes = trigrams(texts)
    used = np.flatnonzero(np.bincount(codes, minlength=1))
    if not len(codes):
        return np.zeros((len(texts), DIMENSIONS), np.float32)
    at = np.zeros(int(used[-1]) + 1, np.int64)
    at[used] = np.arange(len(used))
    counts = np.bincount(of.astype(np.int64) * len(used) + at[codes], minlength=len(texts) * len(used)).astype(np.float32).reshape(len(texts), len(used))
    return counts @ trigram_vectors(used)


def prototypes(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from `train` (lang, text), all of it.

    What reaches the driver is DIMENSIONS numbers a language.
    """

    def count(batch: pa.RecordBatch) -> pa.Table:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        names = sorted(set(langs))
        number = np.fromiter(map({x: k for k, x in enumerate(names)}.get, langs), np.int64, len(langs))
        total = np.zeros(len(names) * CLASSES**3, np.int64)
        for a, b in slices(texts):
            of, codes = trigrams(texts[a:b])
            total += np.bincount(number[a:b][of] * CLASSES**3 + codes, minlength=len(total))
        some = np.flatnonzero(total)
        return pa.table({"lang": pa.array(names).take(pa.array(some // CLASSES**3)), "code": (some % CLASSES**3).astype(np.int32), "n": total[some]})

    def bundle(batch: pa.RecordBatch) -> pa.Table:
        lang = np.array(batch.column(0).to_pylist(), object)
        code, n = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.float64)
        out = []
        for name in sorted(set(lang)):
            mine = lang == name
            vector = n[mine] @ trigram_vectors(code[mine])
            out.append(pa.table({"lang": pa.array([name] * DIMENSIONS), "dim": np.arange(DIMENSIONS, dtype=np.int32), "x": vector}))
        return pa.concat_tables(out)

    counts = map_batches(train, count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rows = map_batches(counts, bundle, "lang string, dim int, x double").groupBy("lang", "dim").agg(F.sum("x").alias("x")).collect()
    names = sorted({r.lang for r in rows})
    sums = np.zeros((len(names), DIMENSIONS))
    for r in rows:
        sums[names.index(r.lang), r.dim] = r.x
    return names, (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def predict(docs: DataFrame, names: list[str], unit: np.ndarray, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (the cosine with that language's prototype, 0 where it is negative).

    Columns of these names that `docs` brings are replaced.

    Null texts and texts without a letter get UNKNOWN and 0; so do all texts if no language was learned. Of
    equal cosines the first language in order of name is given.
    """
    docs = docs.drop("lang_pred", "score")
    schema = docs.select("*").schema.add("lang_pred", "string").add("score", "double")
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        cosines = np.zeros((len(texts), max(1, len(names))), np.float32)
        for a, b in slices(texts):
            if names:
                vectors = bundles(texts[a:b])
                cosines[a:b] = vectors @ unit.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        known = [bool(names) and any(map(str.isalpha, t or "")) for t in texts]
        best = cosines.argmax(1)
        pred = [names[k] if ok else UNKNOWN for k, ok in zip(best, known)]
        score = np.where(known, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0.0).astype(np.float64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return map_batches(docs, run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents whose crc32(doc_id) mod 4 is not 2; predicts for all."""
    docs = documents(spark, sf_dir).withColumn("held_out", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2)
    learned = prototypes(docs.where("NOT held_out AND lang IS NOT NULL").select("lang", "text"))
    return predict(docs.select("doc_id", "held_out", "text"), *learned).drop("text")
