"""SimHash near-duplicates with a pigeonring filter.

A fingerprint is the bitwise majority of the XXH64 hashes of a document's word shingles. Two fingerprints link
at `max_bits` or fewer differing bits. The 64 bits are cut into `segments` segments; linked fingerprints agree
wholly in segments - max_bits of them at least, so each choice of so many segments is a key, and candidates
share a key. The pigeonring test then prunes: on the ring of segments some start must exist from which every
chain of n consecutive segments has at most n * max_bits / segments differences. Only pairs that pass have
their full Hamming distance counted.

Equal fingerprints are joined before (partial aggregation), so copies cost one row. A key that more than
`block` fingerprints share is cut into blocks, and each pair of blocks is a group of its own: no group holds more
than two blocks, nothing is left out, and a group reports a spanning star instead of all of its links.
"""

from __future__ import annotations

from itertools import combinations
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, by_group, documents, map_batches
from tidemark.llm.components import components

SEED = 42
MAX_BITS = 4
SEGMENTS = 7
BLOCK = 512


def shingle_texts(text: str | None, n: int) -> list[bytes]:
    """Word shingles, A-Z lower-cased, words joined by one space; fewer than n words are one shingle, none give none."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(n)))))


def majority(parts: list[bytes], seed: int = SEED) -> int:
    """The bits set in over half of the parts' XXH64; 0 without parts."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), np.uint64, len(parts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 4, seed: int = SEED) -> int:
    return majority(shingle_texts(text, shingle), seed)


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null text counts as empty; a row each, repeated ids too."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, fp long")


def segment_masks(segments: int) -> list[int]:
    """64 bits cut into `segments` runs whose lengths differ by one at most."""
    edges = [64 * k // segments for k in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def keys(fp: Column, max_bits: int, segments: int) -> Column:
    """An array of one key for each choice of segments - max_bits segments."""
    chosen = combinations(segment_masks(segments), segments - max_bits)
    return F.array(*(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(signed(reduce(int.__or__, masks))).cast("long"))) for k, masks in enumerate(chosen)))


def pigeonring(differing: np.ndarray, max_bits: int, segments: int) -> np.ndarray:
    """Of XORed fingerprints, those with a start on the ring whose every chain stays within its proportional budget."""
    each = np.stack([np.bitwise_count(differing & np.uint64(m)) for m in segment_masks(segments)]).astype(np.int16)
    budget = [(n * max_bits) // segments for n in range(1, segments + 1)]
    any_start = np.zeros(len(differing), bool)
    for start in range(segments):
        total, fits = np.zeros(len(differing), np.int16), np.ones(len(differing), bool)
        for n in range(segments):
            total = total + each[(start + n) % segments]
            fits &= total <= budget[n]
        any_start |= fits
    return any_start


def star(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n rows linked by a-b: the least row each is connected with."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = np.minimum(new, new[new])
        if (new == low).all():
            return low
        low = new


def links(fps: np.ndarray, group: np.ndarray, max_bits: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges among fingerprints of the same group (rows of a group stand together)."""
    n = len(fps)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n])) if n else starts
    rows = np.arange(n)
    low, pend, held = rows, [], 0
    step = 1
    while True:
        rows = rows[rows + step < ends[rows]]
        if not len(rows):
            break
        differing = fps[rows] ^ fps[rows + step]
        fits = np.flatnonzero(pigeonring(differing, max_bits, segments))
        fits = fits[np.bitwise_count(differing[fits]) <= max_bits]
        if len(fits):
            pend.append((rows[fits], rows[fits] + step))
            held += len(fits)
        if held > 1_000_000:
            a, b = (np.concatenate(x) for x in zip(*pend))
            low = star(np.r_[a, np.arange(n)], np.r_[b, low], n)
            pend, held = [], 0
        step += 1
    if pend:
        a, b = (np.concatenate(x) for x in zip(*pend))
        low = star(np.r_[a, np.arange(n)], np.r_[b, low], n)
    moved = np.flatnonzero(low != np.arange(n))
    return fps[moved], fps[low[moved]]


def fingerprint_links(distinct: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) among the distinct fingerprints `distinct` (fp long), such as span every component."""
    keyed = distinct.select("fp", F.explode(keys(F.col("fp"), max_bits, segments)).alias("key"))
    shared = scratch.write(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")
    rows = keyed.join(shared, "key")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(mine, other).alias("p"), F.greatest(mine, other).alias("q")))
    dealt = rows.select("fp", F.explode(pairs).alias("pair"), "key").select("fp", F.xxhash64("key", "pair.p", "pair.q").alias("grp"))

    def run(part: pa.Table) -> pa.Table:
        a, b = links(part.column("fp").to_numpy().view(np.uint64), part.column("grp").to_numpy(), max_bits, segments)
        return pa.Table.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.repartition("grp").sortWithinPartitions("grp", "fp").mapInArrow(by_group("grp", run), "a long, b long")


def near_components(fps: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """(fp, component_id): each distinct fingerprint with the smallest doc_id reachable from it. `fps` is (doc_id, fp)."""
    distinct = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    edges = fingerprint_links(distinct.select("fp"), scratch, max_bits, segments, block)
    label = components(edges, scratch)
    joined = scratch.write(
        distinct.join(label.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component")), "labelled"
    )
    least = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return scratch.write(joined.join(least, "component").select("fp", "component_id"), "components")


def simhash_near_dedup(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS, segments: int = SEGMENTS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, fp long, component_id (smallest doc_id reachable over links).

    Null text counts as empty (fingerprint 0, linked like any other). Rows that repeat an id get a row each. A
    null id joins its component but never names it, unless all ids there are null. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.write(fingerprints(docs, shingle, id_col, text), "fingerprints")
    found = near_components(fps, scratch, max_bits, segments)
    return fps.join(found, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_near_dedup(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
