"""Token ids in compressed files.

Documents are encoded with the tokenizers library, an end id is added to each, and the ids go in ascending order
of doc_id into frames. A frame holds whole documents; its ids are cut into blocks of range_coder.BLOCK ids, each coded
by itself from a fresh model and followed by a checksum, so a damaged or missing block costs no other. A shard of the
output (a range of doc_ids) is a run of frames; the frames are the rows of a Parquet table.

Frame, little-endian: magic, u32 documents, u32 ids, u32 blocks; per document i64 doc_id (with u8 1 if null) and u32
ids; per block u32 ids, u32 bytes, u32 CRC-32 of its ids as u32, u32 CRC-32 of its bytes; u32 CRC-32 of all before; then the
blocks' bytes.
"""

from __future__ import annotations

import json
import string
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import range_coder
from tidemark.llm.common import Scratch, documents, small_batches

MAGIC = b"TMF1"
#: A frame is closed by the document with which it has so many ids.
FRAME_IDS = 4_000_000
#: Words whose ids a worker remembers.
MEMORY = 600_000
END = 1
#: Words of letters that are encoded as one text.
JOINED = 200
#: The pattern of a tokenizer that parts letters from other signs.
PARTED = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class DamagedFrame(ValueError):
    pass


def pack(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    blocks = [ids[k : k + range_coder.BLOCK] for k in range(0, len(ids), range_coder.BLOCK)]
    coded = range_coder.encode(blocks) if blocks else []
    head = MAGIC + struct.pack("<3I", len(counts), len(ids), len(blocks))
    head += np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + np.array(counts, "<u4").tobytes()
    table = np.array([(len(b), len(c), zlib.crc32(b.astype("<u4").tobytes()), zlib.crc32(c)) for b, c in zip(blocks, coded)], "<u4").reshape(-1, 4)
    head += table.tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(coded)


def unpack(frame: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, all ids); raises DamagedFrame if a checksum or length is wrong."""
    if frame[:4] != MAGIC or len(frame) < 16:
        raise DamagedFrame("no frame starts here")
    docs, total, n = struct.unpack_from("<3I", frame, 4)
    at = 16
    if len(frame) < at + docs * 13 + n * 16 + 4:
        raise DamagedFrame("the frame is cut off")
    doc_ids = np.frombuffer(frame, "<i8", docs, at).tolist()
    nulls = frame[at + 8 * docs : at + 9 * docs]
    counts = np.frombuffer(frame, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs
    table = np.frombuffer(frame, "<u4", 4 * n, at).reshape(n, 4).astype(np.int64)
    at += 16 * n
    if struct.unpack_from("<I", frame, at)[0] != zlib.crc32(frame[:at]):
        raise DamagedFrame("the frame's head does not match its checksum")
    at += 4
    ends = at + np.cumsum(table[:, 1])
    if n and ends[-1] != len(frame) or table[:, 0].sum() != total or counts.sum() != total:
        raise DamagedFrame("the frame's lengths do not add up")
    coded = [frame[e - s : e] for e, s in zip(ends, table[:, 1])]
    for k, c in enumerate(coded):
        if zlib.crc32(c) != table[k, 3]:
            raise DamagedFrame(f"the bytes of block {k} do not match their checksum")
    blocks = range_coder.decode(coded, table[:, 0].tolist()) if n else []
    for k, block in enumerate(blocks):
        if zlib.crc32(block.astype("<u4").tobytes()) != table[k, 2]:
            raise DamagedFrame(f"block {k} does not match its checksum")
    return [None if x else d for d, x in zip(doc_ids, nulls)], counts, np.concatenate(blocks) if blocks else np.zeros(0, np.int64)


class Encoder:
    """Encodes texts with a tokenizer that lets white space go: words are encoded by themselves and remembered.

    Arrow splits at the six ASCII white-space characters and numbers the words; what other white space a word holds
    the tokenizer splits itself. Where the tokenizer lower-cases, A-Z are lower-cased before. Where it parts letters
    from other signs, a word that ends in punctuation is put together from two others, and words of letters are encoded
    as one text, whose ids that end a word tell them apart.
    """

    def __init__(self, data: str):
        self.tokenizer = Tokenizer.from_str(data)
        self.tokenizer.encode_special_tokens = True
        settings = json.loads(data)
        self.lower = '"Lowercase"' in json.dumps(settings.get("normalizer"))
        self.parted = PARTED in json.dumps(settings.get("pre_tokenizer")).replace("\\\\", "\\")
        suffix, vocabulary = settings["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        # Word n, numbered from 1, has sizes[n] ids from starts[n] on.
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def add(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])

    def spell(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these words, and how many stand before each word and after the last."""
        sizes = self.sizes[numbers]
        after = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=after[1:])
        # Each word's ids start where those of the words before it stop.
        return self.ids[np.repeat(self.starts[numbers] - after[:-1], sizes) + np.arange(after[-1])], after

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not known."""
        stems = [w.rstrip(string.punctuation) for w in words] if self.parted else words
        whole, cut = [], []
        for word, stem in zip(words, stems):
            if len(stem) < len(word) and stem and stem[-1].isalpha():
                cut.append((word, stem, word[len(stem) :]))
            else:
                whole.append(word)
        pieces = dict.fromkeys(whole)
        pieces.update((p, None) for _, *both in cut for p in both if p not in self.known)
        single, joined, found = [], [], []
        for piece in pieces:
            (joined if self.parted and piece.isalpha() else single).append(piece)
        if joined:
            groups = [joined[k : k + JOINED] for k in range(0, len(joined), JOINED)]
            for group, coded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(coded.ids, np.int64)
                stops = np.flatnonzero(self.ends[ids]) + 1
                # A word of letters has one end at least; so many ends as words are one each.
                if len(stops) == len(group) and stops[-1] == len(ids):
                    found.append((group, np.diff(stops, prepend=0), ids))
                else:
                    single += group
        if single:
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(single, add_special_tokens=False)]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            found.append((single, sizes, np.fromiter((k for ids in coded for k in ids), np.int64, int(sizes.sum()))))
        if found:
            names, sizes, ids = zip(*found)
            self.add([w for group in names for w in group], np.concatenate(sizes), np.concatenate(ids))
        if cut:
            ids, after = self.spell(np.array([self.known[p] for _, *both in cut for p in both], np.int64))
            self.add([word for word, *_ in cut], np.diff(after[::2]), ids)

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text and all ids; `end` follows each text, a null text is an empty one."""
        if len(self.known) > MEMORY:
            self.forget()
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if self.lower else texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        missing = [w for w in words if w not in self.known]
        if missing:
            self.learn(missing)
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ids, after = self.spell(numbers[coded.indices.to_numpy()])
        bounds = lists.offsets.to_numpy()
        bounds = after[bounds - bounds[0]]
        return np.diff(bounds) + 1, np.insert(ids, bounds[1:], np.uint32(end))


_ENCODER: dict[str, Encoder] = {}


def encoder(data: str) -> Encoder:
    """The worker's encoder, kept over the tasks that the worker runs."""
    if data not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[data] = Encoder(data)
    return _ENCODER[data]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text: str = "text", end: int = END) -> None:
    """Frames of all documents at `path`: (shard long, seq int, n_ids long, frame binary).

    A null text is empty, an empty one has the end id alone. Null doc_ids come first; rows that repeat a doc_id
    follow each other in the order of their text. Shards are numbered in the order of doc_id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(tokenizer)

    def run(batches):
        from pyspark import TaskContext

        shard, seq = TaskContext.get().partitionId(), 0
        doc_ids, counts, parts, size = [], [], [], 0

        def frame():
            nonlocal doc_ids, counts, parts, size, seq
            ids = np.concatenate(parts)
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([pack(doc_ids, counts, ids)], pa.binary())], ["shard", "seq", "n_ids", "frame"])
            doc_ids, counts, parts, size, seq = [], [], [], 0, seq + 1
            return out

        for batch in batches:
            n, ids = encoder(held.value)(batch.column(1), end)
            ends = size + np.cumsum(n)
            doc_list, done = batch.column(0).to_pylist(), 0
            while done < len(doc_list):
                # Up to the document with which the frame is full.
                upto = min(int(np.searchsorted(ends, FRAME_IDS)) + 1, len(doc_list))
                taken = int(n[done:upto].sum())
                doc_ids += doc_list[done:upto]
                counts += n[done:upto].tolist()
                parts.append(ids[:taken])
                ids, size, done = ids[taken:], size + taken, upto
                if size >= FRAME_IDS:
                    ends -= size
                    yield frame()
        if doc_ids:
            yield frame()

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "shard long, seq int, n_ids long, frame binary").write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Raises DamagedFrame where a checksum does not match.
    """
    frames = spark.read.parquet(path)
    sizes = frames.select("shard", "seq", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("ids"))  # a row for each task that wrote
    before = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    inside = sizes.select("shard", "seq", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n_ids")).alias("inside"))
    starts = inside.join(before, "shard").select("shard", "seq", (F.col("before") + F.col("inside")).alias("begin"))

    def run(batches):
        for batch in batches:
            for shard, seq, frame in zip(*(batch.column(k).to_pylist() for k in range(3))):
                doc_ids, counts, ids = unpack(frame)
                flat = ids.astype("<u4")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(flat[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist())]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int64()), pa.array([seq] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())],
                    ["shard", "seq", "doc_id", "place", "n_tokens", "ids_crc32"],
                )

    read = frames.select("shard", "seq", "frame").mapInArrow(run, "shard long, seq int, doc_id long, place long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["shard", "seq"]).select("doc_id", (F.col("begin") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_text(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path("files")
    write_tokens(documents(spark, sf_dir), tokenizer_text(), path)
    return read_tokens(spark, path)
