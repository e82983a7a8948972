"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed here: pieces with scores and types, the normaliser and what the trainer says of byte
fallback. From them a tokenizers model is rebuilt (BPE with merges in the order of scores, or unigram), with the
precompiled normaliser, the metaspace marker and byte fallback. Parity with the sentencepiece library is verified
for everything: where texts are cut at the markers, for each distinct chunk that a task meets, else for each text. What
differs is encoded by that library.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, Tokenizer
from tokenizers import models as tm
from tokenizers import normalizers as tn

from tidemark.llm.common import documents, small_batches

MARK = "▁"
#: Where texts cannot be cut into chunks, one text in so many is checked against the sentencepiece library: all.
PARITY_EVERY = 1
#: Chunks whose ids a task remembers.
MEMORY = 120_000
#: New chunks encoded as one text.
JOINED = 32
#: Texts encoded at once, and their bytes (one longer text is taken alone).
SLICE, SLICE_BYTES = 1000, 500_000
# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes):
    """(number, value) of a protobuf message's fields: ints, floats as 4 bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """What the protobuf says."""

    def __init__(self, data: bytes):
        self.data = data
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unknown = "unigram", False, 0
        self.charsmap, self.prefix, self.squeeze, self.escape = b"", True, True, True
        for number, value in fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        (score,) = struct.unpack("<f", v)
                    elif n == 3:
                        kind = v
                if kind == UNKNOWN:
                    self.unknown = len(self.pieces)
                self.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in fields(value):
                    if n == 3:
                        self.kind = {1: "unigram", 2: "bpe"}.get(v, "other")
                    elif n == 35:
                        self.byte_fallback = bool(v)
            elif number == 3:
                for n, v in fields(value):
                    if n == 2:
                        self.charsmap = v
                    elif n == 3:
                        self.prefix = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        if self.kind == "other":
            raise ValueError("only unigram and BPE models can be rebuilt")

    def normalizer(self):
        steps = [tn.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [tn.Replace(Regex("^ +| +$"), ""), tn.Replace(Regex(" {2,}"), " ")]
        if self.prefix:
            steps.append(tn.Prepend(" "))
        if self.escape:
            steps.append(tn.Replace(" ", MARK))
        return tn.Sequence(steps)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, in the order of the made piece's score."""
        usable = {p: (s, k) for k, (p, s, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        found = [(-score, k, cut, piece) for piece, (score, k) in usable.items() for cut in range(1, len(piece)) if piece[:cut] in usable and piece[cut:] in usable]
        return [(piece[:cut], piece[cut:]) for _, _, cut, piece in sorted(found)]

    def tokenizer(self) -> Tokenizer:
        """Of normalised texts; control, unknown and user-defined strings in a text are text."""
        if self.kind == "bpe":
            vocab = {p: k for k, (p, _, _) in enumerate(self.pieces)}
            core = tm.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown][0], byte_fallback=self.byte_fallback, fuse_unk=True, cache_capacity=0)
        else:
            least = min(s for _, s, kind in self.pieces if kind == NORMAL)
            scored = [(p, s if kind in (NORMAL, USER, BYTE) else least - 100.0) for p, s, kind in self.pieces]
            core = tm.Unigram(scored, self.unknown, self.byte_fallback)
        return Tokenizer(core)


class Codec:
    """Encodes and decodes texts by a model.

    Where no piece has the marker behind another character, and the marker is a piece, no piece and no run of unknowns
    crosses from one marker-led chunk to the next, so chunks are encoded by themselves and remembered; for other models whole
    texts are encoded. Where the normaliser only sets markers, so do whole columns (`encode_column`).
    """

    def __init__(self, data: bytes):
        self.model = Model(data)
        self.normal, self.tokens = self.model.normalizer(), self.model.tokenizer()
        usable = {p for p, _, kind in self.model.pieces if kind in (NORMAL, USER)}
        self.chunked = MARK in usable and not any(MARK in p.lstrip(MARK) for p in usable) and self.model.escape
        self.by_column = self.chunked and not self.model.charsmap and not self.model.squeeze
        self.known: dict[str, tuple[int, ...]] = {}
        self.bytes = [self._bytes(p, kind) for p, _, kind in self.model.pieces]
        self.piece_ends = np.cumsum([len(b) for b in self.bytes])
        self.piece_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._forget()

    def _forget(self) -> None:
        """No chunk is known: chunks, where the ids of each end with a 0 before, their ids, and whether both libraries agree on them."""
        self.chunks, self.ends, self.ids, self.agrees = pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)

    def _bytes(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else (piece.replace(MARK, " ") if self.model.escape else piece).encode()

    def normalise(self, text: str) -> str:
        """Marked text; empty where nothing is left."""
        if not text:
            return ""
        if not self.model.charsmap and not self.model.squeeze:
            return (MARK if self.model.prefix else "") + text.replace(" ", MARK) if self.model.escape else (" " if self.model.prefix else "") + text
        out = self.normal.normalize_str(text)
        return "" if not out.strip(MARK + " ") and self.model.squeeze else out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        marked = [self.normalise(t or "") for t in texts]
        if not self.chunked:
            return [e.ids for e in self.tokens.encode_batch_fast(marked, add_special_tokens=False)]
        if len(self.known) > MEMORY:
            self.known = {}
        # "a▁▁b▁c" is cut into "a", "▁▁b" and "▁c".
        cut = [re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", m) for m in marked]
        new = list({c for chunks in cut for c in chunks if c not in self.known})
        if new:
            self.known.update(zip(new, (tuple(e.ids) for e in self.tokens.encode_batch_fast(new, add_special_tokens=False))))
        get = self.known.__getitem__
        return [[k for ids in map(get, chunks) for k in ids] for chunks in cut]

    def _learn(self, chunks: pa.Array) -> None:
        """Encodes chunks, led by spaces instead of markers, by both libraries; where they differ, the ids are those of sentencepiece."""
        # Chunks that neither begin without a marker nor consist of markers stay chunks where they stand side by side.
        joins = pc.and_(pc.starts_with(chunks, " "), pc.invert(pc.ends_with(chunks, " ")))
        for part, together in ((chunks.filter(joins), True), (chunks.filter(pc.invert(joins)), False)):
            ids, lengths, agrees = (self._together(part) if together else None) or self._apart(part)
            self.chunks = pa.concat_arrays([self.chunks, part])
            self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(lengths)]
            self.ids, self.agrees = np.r_[self.ids, ids], np.r_[self.agrees, agrees]

    def _both(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of either library; sentencepiece puts the first marker itself, and a marker alone is a piece."""
        ours = [e.ids for e in self.tokens.encode_batch_fast([t.replace(" ", MARK) for t in texts], add_special_tokens=False)]
        led = 1 if self.model.prefix else 0
        theirs = self.reference.encode([t[led:] for t in texts], num_threads=1)
        return ours, [[self.reference.piece_to_id(MARK)] if led and t == " " else x for t, x in zip(texts, theirs)]

    def _together(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids, ids of each chunk, agreement) of chunks encoded in texts of JOINED; none if the libraries differ or ids do not end with the chunks."""
        if not len(chunks):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
        offsets = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1]
        some = np.r_[offsets[:-1:JOINED], offsets[-1]]
        ours, theirs = self._both(pa.StringArray.from_buffers(len(some) - 1, pa.py_buffer(some), chunks.buffers()[2]).to_pylist())
        if ours != theirs:
            return None
        ids = np.concatenate([np.array(x, np.int32) for x in theirs])
        after = np.cumsum(np.diff(self.piece_ends, prepend=0)[ids])
        last = np.searchsorted(after, offsets[1:] - offsets[0])
        if (ids == self.model.unknown).any() or last[-1] != len(ids) - 1 or (after[last] != offsets[1:] - offsets[0]).any():
            return None
        return ids, np.diff(last, prepend=-1), np.ones(len(chunks), bool)

    def _apart(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of chunks encoded one by one."""
        ours, theirs = self._both(chunks.to_pylist())
        return np.fromiter((k for x in theirs for k in x), np.int32), np.array([len(x) for x in theirs], np.int64), np.array([a == b for a, b in zip(ours, theirs)], bool)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's end with a 0 before, whether the libraries agree on all of its chunks)."""
        if len(self.chunks) > MEMORY:
            self._forget()
        marked = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), MARK, " ")
        if self.model.prefix:
            marked = pc.if_else(pc.equal(pc.binary_length(marked), 0), "", pc.binary_join_element_wise(" ", marked, ""))
        offsets = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + len(marked) + 1]
        data = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        # A chunk begins with the first of some spaces, and with a text.
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        at = np.flatnonzero(begins).astype(np.int32)
        cut = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.r_[at, np.int32(len(data))]), pa.py_buffer(data.tobytes())).dictionary_encode()
        new = cut.dictionary.filter(pc.invert(pc.is_in(cut.dictionary, self.chunks)))
        if len(new):
            self._learn(new)
        chunk = pc.index_in(cut.dictionary, self.chunks).to_numpy()[cut.indices.to_numpy()]
        lengths = np.diff(self.ends)[chunk]
        after = np.r_[0, np.cumsum(lengths)]
        first = np.searchsorted(at, offsets)  # of each text, its first chunk
        wrong = np.r_[0, np.cumsum(~self.agrees[chunk])][first]
        return self.ids[np.repeat(self.ends[chunk] - after[:-1], lengths) + np.arange(after[-1])], after[first].astype(np.int32), wrong[1:] == wrong[:-1]

    def decode_column(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ids in a row, where each text's end with a 0 before."""
        stop, size = self.piece_ends[ids], np.diff(self.piece_ends, prepend=0)[ids]
        after = np.r_[0, np.cumsum(size)]
        data = self.piece_bytes[np.repeat(stop - after[1:], size) + np.arange(after[-1])]
        offsets = after[ends]
        if self.model.prefix:
            led = offsets[:-1][np.diff(offsets) > 0]
            led = led[data[led] == 32]
            data, offsets = np.delete(data, led), offsets - np.searchsorted(led, offsets)
        out = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes()))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string())
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text

    @property
    def reference(self):
        return _reference(self.model.data)


@lru_cache(2)
def _reference(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def _slices(batch: pa.RecordBatch):
    """Parts of a batch of at most SLICE rows and SLICE_BYTES of text; a longer text is one of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        fits = np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, side="right")
        end = min(max(int(fits), at + 1), at + SLICE)
        yield batch.slice(at, end - at)
        at = end


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text: str = "text", parity_every: int = PARITY_EVERY) -> DataFrame:
    """One row per row of `docs`: id, ids (array of int), decoded (text of the ids), checked and parity.

    Null and empty texts have no ids. `checked` says whether the row was compared with the sentencepiece library,
    `parity` whether the compared texts agreed; the ids are always that library's. Models whose texts are cut into chunks are compared
    chunk by chunk, so all rows are checked and `parity` is the row's own. Of other models one text in `parity_every`
    is compared, all by default; if one differs, its batch is encoded by the library.
    `model` (a model file's bytes, some MB whatever the corpus) goes to the tasks as a broadcast.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        codec, seen = None, 0
        for batch in (part for b in batches for part in _slices(b)):
            codec = codec or Codec(held.value)
            if codec.by_column:
                flat, ends, parity = codec.encode_column(batch.column(1))
                decoded, checked = codec.decode_column(flat, ends), np.ones(batch.num_rows, bool)
            else:
                texts = batch.column(1).to_pylist()
                ids = codec.encode(texts)
                checked = [(seen + k) % parity_every == 0 for k in range(len(texts))]
                seen += len(texts)
                agree = all(codec.reference.encode(texts[k] or "") == ids[k] for k, c in enumerate(checked) if c)
                if not agree:
                    ids = codec.reference.encode([t or "" for t in texts], num_threads=1)
                ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                flat = np.fromiter((k for x in ids for k in x), np.int32, int(ends[-1]))
                decoded, parity = pa.array([codec.decode(x) for x in ids], pa.string()), [agree] * len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), decoded, pa.array(checked), pa.array(parity)],
                [id_col, "ids", "decoded", "checked", "parity"],
            )

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string, checked boolean, parity boolean")


def digests(encoded: DataFrame, docs_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_ids, ids_crc32 of the ids as little-endian unsigned 32-bit integers, decoded_sha256, parity)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(1)
            flat, offsets = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            sha = [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), batch.column(3)],
                [docs_id, "n_ids", "ids_crc32", "decoded_sha256", "parity"],
            )

    kind = encoded.select(docs_id).schema[0].dataType.simpleString()
    return encoded.select(docs_id, "ids", "decoded", "parity").mapInArrow(run, f"`{docs_id}` {kind}, n_ids long, ids_crc32 long, decoded_sha256 string, parity boolean")


def model_bytes(name: str = "piece_bpe_32k.model") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(documents(spark, sf_dir), model_bytes()))
