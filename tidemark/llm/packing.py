"""Packing of documents into sequences of a fixed number of tokens, by the sum-of-squares rule.

What is open is described by how many open sequences have each residual gap. A piece goes to an open sequence of that gap
with which the sum of the squared counts becomes smallest, so no gap piles up and whatever comes later finds a fitting
one; a new sequence is begun where no open one has room. Pieces are taken in falling length.

A task packs the documents it reads in windows of WINDOW ids and writes filled sequences at once. What ends in sequences
that are not filled goes into the task's next window, at its end into a second round, which gathers it from all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, documents, small_batches
from tidemark.llm.token_files import encoder, tokenizer_text

#: Ids of a sequence, and the id that ends a document.
CAPACITY, END = 2048, 0
#: Ids that are packed together.
WINDOW = 6_000_000
#: A sequence is filled if its gap is so large at most; others are packed again, up to this share of a window.
GAP, AGAIN = CAPACITY // 100, 0.25
_SCHEMA = "doc_id long, piece int, start long, ids binary, open boolean, sequence_id long, offset long"


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces of 1 to `capacity` ids, sequences numbered from 0; equal sums take the smallest gap."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    whole = int((lengths == capacity).sum())
    sequence[order[:whole]] = np.arange(whole)
    made = whole
    # counts[g]: open sequences with the gap g; open_at[g]: which. Gap 0 counts for nothing, which the -0.5 stands for below.
    counts, open_at = np.zeros(capacity + 1), [[] for _ in range(capacity + 1)]
    for k in order[whole:].tolist():
        size = int(lengths[k])
        here, after = counts[size:], counts[: capacity - size + 1].copy()
        after[0] = -0.5
        # Half of what the sum of squares grows by when a gap g becomes g - size, but for the same constant everywhere.
        grows = np.where(here > 0, after - here, np.inf)
        best = int(grows.argmin())
        if grows[best] < np.inf:
            gap = size + best
            number = open_at[gap].pop()
            counts[gap] -= 1
        else:
            gap, number = capacity, made
            made += 1
        sequence[k], offset[k] = number, capacity - gap
        if gap > size:
            counts[gap - size] += 1
            open_at[gap - size].append(number)
    return sequence, offset


def _gather(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(lengths)
    return ids[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], ends


class _Packer:
    """The pieces that a task holds: doc_id, piece, length of each, and their ids one after the other."""

    def __init__(self, capacity: int, window: int, first: int):
        self.capacity, self.window, self.number = capacity, window, first
        self.held, self.size = [], 0

    def add(self, doc_ids: pa.Array, pieces: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((doc_ids, pieces, lengths, ids))
        self.size += len(ids)

    def pack(self, last: bool, again: bool):
        """Rows of filled sequences; pieces of others stay held, or, `last`, are given as open ones if they are to be packed `again`."""
        if not self.held:
            return
        docs, pieces, lengths, ids = (list(c) for c in zip(*self.held))
        doc_ids, pieces, lengths, ids = pa.concat_arrays(docs), np.concatenate(pieces), np.concatenate(lengths), np.concatenate(ids)
        starts = np.cumsum(lengths) - lengths
        sequence, offset = place(lengths, self.capacity)
        fill = np.bincount(sequence, lengths).astype(np.int64)
        # The emptiest sequences, up to a share of the window.
        order = np.argsort(fill, kind="stable")
        emptiest = order[(np.cumsum(fill[order]) <= AGAIN * self.window) & (fill[order] < self.capacity - GAP)] if again else order[:0]
        left = np.zeros(len(fill), bool)
        left[emptiest] = True
        left = left[sequence]
        self.held, self.size = [], 0
        done = np.flatnonzero(~left)
        done = done[np.lexsort((offset[done], sequence[done]))]
        yield from self.rows(doc_ids, pieces, lengths, ids, starts, done, sequence + self.number, offset, False)
        self.number += len(fill)
        rest = np.flatnonzero(left)
        if last:
            yield from self.rows(doc_ids, pieces, lengths, ids, starts, rest, sequence, offset, True)
        elif len(rest):
            self.add(doc_ids.take(pa.array(rest)), pieces[rest], lengths[rest], _gather(ids, starts[rest], lengths[rest])[0])

    def rows(self, doc_ids, pieces, lengths, ids, starts, chosen, sequence, offset, is_open):
        for k in range(0, len(chosen), 2000):
            part = chosen[k : k + 2000]
            flat, ends = _gather(ids, starts[part], lengths[part])
            data = pa.py_buffer(flat.astype("<u4").tobytes())
            offsets = pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32).tobytes())
            binary = pa.Array.from_buffers(pa.binary(), len(part), [None, offsets, data])
            yield pa.RecordBatch.from_arrays(
                [doc_ids.take(pa.array(part)), pa.array(pieces[part], pa.int32()), pa.array(pieces[part] * self.capacity, pa.int64()), binary, pa.array([is_open] * len(part)), pa.array(sequence[part]), pa.array(offset[part])],
                ["doc_id", "piece", "start", "ids", "open", "sequence_id", "offset"],
            )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, piece, start, ids, sequence_id, offset): each document's ids in pieces, each with its place in a sequence.

    `ids` are little-endian unsigned 32-bit integers. A null text is an empty one, which has the end id alone. Documents of
    up to `capacity` ids are whole; longer ones are cut after each `capacity` ids. Pieces of a sequence lie without a gap from
    offset 0. Repeated rows and null ids are packed like any others; no rows give none. A piece's sequence depends on how rows are dealt.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "packing")
    held = spark.sparkContext.broadcast(tokenizer)

    def first(batches):
        packer = _Packer(capacity, window, TaskContext.get().partitionId() << 36)
        for batch in batches:
            n, ids = encoder(held.value)(batch.column(1), end)
            parts = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), parts)
            pieces = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            packer.add(batch.column(0).take(pa.array(row)), pieces, np.minimum(n[row] - pieces * capacity, capacity), ids)
            if packer.size >= window:
                yield from packer.pack(last=False, again=True)
        yield from packer.pack(last=True, again=True)

    def second(batches):
        packer = _Packer(capacity, window, 1 << 62 | TaskContext.get().partitionId() << 36)
        for batch in batches:
            raw = batch.column(2)
            bounds = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, 4 * raw.offset)
            ids = np.frombuffer(raw.buffers()[2], "<u4", (bounds[-1] - bounds[0]) // 4, int(bounds[0])) if bounds[-1] > bounds[0] else np.zeros(0, "<u4")
            packer.add(batch.column(0), batch.column(1).to_numpy().astype(np.int64), np.diff(bounds).astype(np.int64) // 4, ids)
            if packer.size >= window:
                yield from packer.pack(last=False, again=True)
        yield from packer.pack(last=True, again=False)

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    written = scratch.write(plain.mapInArrow(first, _SCHEMA), "first")
    left = written.where("open").select("doc_id", "piece", "ids")
    size = left.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    again = left.repartition(max(1, -(-size // (4 * window)))).mapInArrow(second, _SCHEMA)
    return written.where("NOT open").drop("open").unionByName(scratch.write(again, "second").drop("open"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(documents(spark, sf_dir), tokenizer_text())
    return packed.select("doc_id", "piece", "start", F.expr("CAST(octet_length(ids) div 4 AS BIGINT)").alias("length"), F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
