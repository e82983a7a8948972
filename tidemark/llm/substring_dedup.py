"""Removal of passages that occur earlier in the corpus.

A window is `window` consecutive words. Its minimiser is the `gram`-word gram in it with the least hash, so equal
windows have equal minimisers. A document is cut into segments: runs of windows that have the same minimiser at
the same place. Segments are dealt by minimiser, so whatever could match meets in one shard, and a minimiser
that one distinct segment alone has needs no search.

Equal segments are joined first (in the task, before the shuffle): every occurrence but the first is a repeat
from end to end. Where a minimiser has several distinct segments, their first occurrences are put into the FM-index
of their shard, and streaming them through backward search gives the matching statistics; windows that match to
full length at an earlier place are reported as intervals. A minimiser with over `hot` distinct segments is dealt
anew by whole window, where equal windows are joined by aggregation: nothing is dropped, no shard grows with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, documents, map_batches, release, words_of
from tidemark.llm.fm_index import FMIndex

WINDOW = 20
GRAM = 6
#: Distinct segments of one minimiser beyond which it is dealt by whole window.
HOT = 1000
#: Words in one FM-index.
INDEX_WORDS = 200_000
#: Words whose hashes a task remembers.
MEMORY = 200_000

_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def cut(documents_words: list[list[bytes]], window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Segments of several documents: doc (place in the list), start (word), n (windows), h (minimiser), seg (hash of the words)."""
    lengths = np.fromiter(map(len, documents_words), np.int64, len(documents_words))
    total = int(lengths.sum())
    none = {k: np.zeros(0, np.int64) for k in ("doc", "start", "n", "h", "seg")}
    if total < window:
        return none
    word = np.fromiter((_hashes[w] for ws in documents_words for w in ws), np.uint64, total)
    grams = np.zeros(total - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * np.uint64(_MUL) + word[k : total - gram + 1 + k]
    grams = _mix(grams)
    span = window - gram + 1
    least = np.arange(total - window + 1) + np.lib.stride_tricks.sliding_window_view(grams, span).argmin(1)
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = np.flatnonzero(doc[: total - window + 1] == doc[window - 1 :])
    if not len(at):
        return none
    new = np.r_[True, (least[at][1:] != least[at][:-1]) | (doc[at][1:] != doc[at][:-1])]
    first = at[new]
    n = np.diff(np.r_[np.flatnonzero(new), len(at)])
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(word * _powers(_MUL, total), dtype=np.uint64)]
    seg = _mix((sums[first + n + window - 1] - sums[first]) * _powers(_INV, total)[first] + (n * 64 + least[first] - first).astype(np.uint64))
    return {"doc": doc[first], "start": first - (ends - lengths)[doc[first]], "n": n, "h": grams[least[first]].view(np.int64), "seg": seg.view(np.int64)}


SEGMENT = "row long, doc_id long, start int, n int, h long, seg long"


def segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, doc_id = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        got = cut([words_of(t) for t in batch.column(2).to_pylist()], window, gram)
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (row[got["doc"]], doc_id[got["doc"]], got["start"].astype(np.int32), got["n"].astype(np.int32), got["h"], got["seg"])],
            ["row", "doc_id", "start", "n", "h", "seg"],
        )

    return map_batches(docs, run, SEGMENT)


def joined_in_task(found: DataFrame) -> DataFrame:
    """Equal segments of a batch as one row: the first of them and how many there are."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = {n: batch.column(n).to_numpy() for n in batch.schema.names}
        order = np.lexsort((cols["start"], cols["doc_id"], cols["seg"], cols["h"]))
        h, seg = cols["h"][order], cols["seg"][order]
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (seg[1:] != seg[:-1])])
        count = np.diff(np.r_[new, len(h)])
        return pa.RecordBatch.from_arrays([*(pa.array(c[order[new]]) for c in cols.values()), pa.array(count)], [*cols, "times"])

    return map_batches(found, run, f"{SEGMENT}, times long")


def search(shard: pa.Table, window: int) -> pa.RecordBatch:
    """Repeated windows among the segments (row, start, words) of `shard`, which stand in document order."""
    rows, starts = shard.column("row").to_numpy(), shard.column("start").to_numpy()
    lists = [w.split() for w in shard.column("words").to_pylist()]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    names: dict[str, int] = {}
    flat = np.fromiter((names.setdefault(w, len(names) + 1) for ws in lists for w in ws), np.int64, int(lengths.sum()))
    index = FMIndex(flat, lengths, len(names) + 1)
    begin = np.cumsum(lengths + 1) - lengths - 1
    per = lengths - window + 1
    of = np.repeat(np.arange(len(lists)), per)
    offset = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    place = begin[of] + offset
    length, low, high = index.matching(place + window - 1, window)
    full = np.flatnonzero(length >= window)
    full = full[index.first_place(low[full], high[full]) < place[full]] if len(full) else full
    # Windows that follow one another are one interval.
    of, offset = of[full], offset[full]
    new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(full) else full
    n = np.diff(np.r_[new, len(full)])
    return pa.RecordBatch.from_arrays([pa.array(rows[of[new]]), pa.array((starts[of[new]] + offset[new]).astype(np.int32)), pa.array(n.astype(np.int32))], ["row", "start", "n"])


def searched(indexed: DataFrame, window: int) -> DataFrame:
    """`indexed` (h, doc_id, row, start, words) -> repeated intervals (row, start, n): an FM-index for each run of minimisers."""

    def run(batches):
        held, words = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            words += sum(len(x) for x in batch.column("words").to_pylist()) // 6
            if words >= INDEX_WORDS:
                table = pa.Table.from_batches(held)
                h = table.column("h").to_numpy()
                last = int(np.searchsorted(h, h[-1]))  # the last minimiser may go on
                if last:
                    yield search(table.slice(0, last), window)
                    held, words = table.slice(last).to_batches(), 0
        if held:
            yield search(pa.Table.from_batches(held), window)

    return indexed.repartition("h").sortWithinPartitions("h", "doc_id", "start").mapInArrow(run, "row long, start int, n int")


def spans_text(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """Words of the spans (row, start, n, h, hot): segments whole, those of hot minimisers window by window, where h is the window's hash."""
    per = spans.groupBy("row").agg(F.collect_list(F.struct("start", "n", "h", "hot")).alias("spans"))
    joined = docs.join(per, "row").select("row", "doc_id", "text", "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row, doc_id, text, got in zip(*(batch.column(k).to_pylist() for k in range(4))):
            words = words_of(text)
            for s in got:
                a, n = s["start"], s["n"]
                if not s["hot"]:
                    out.append((s["h"], doc_id, row, a, False, b" ".join(words[a : a + n + window - 1])))
                    continue
                for k in range(a, a + n):
                    whole = b" ".join(words[k : k + window])
                    out.append((int.from_bytes(xxhash.xxh3_64_digest(whole), "big", signed=True), doc_id, row, k, True, whole))
        cols = list(zip(*out)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([x.decode() for x in c] if t == pa.string() else c, t) for c, t in zip(cols, kinds)], ["h", "doc_id", "row", "start", "hot", "words"])

    return map_batches(joined, run, "h long, doc_id long, row long, start int, hot boolean, words string")


def repeated_spans(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, unique: bool = True) -> DataFrame:
    """(row, spans of (start, n)): runs of windows of `docs` (row, doc_id, text) whose words also start earlier.

    `unique` says that no row stands twice.
    """
    spark = docs.sparkSession
    found = segments(docs, window, gram)
    group = (
        joined_in_task(found)
        .repartition("h")
        .groupBy("h", "seg")
        .agg(F.min(F.struct("doc_id", "start", "row", "n")).alias("at"), F.sum("times").alias("times"))
        .selectExpr("h", "seg", "at.doc_id", "at.start", "at.row", "at.n", "times", "count(*) OVER (PARTITION BY h) AS distinct_segs")
    )
    known = scratch.write(group.where("times > 1 OR distinct_segs > 1"), "known")
    release(spark)
    first = known.where("times > 1").select("h", "seg", F.col("doc_id").alias("first_id"), F.col("start").alias("first_start"))
    again = found.join(first, ["h", "seg"]).where("doc_id > first_id OR doc_id = first_id AND start > first_start").select("row", "start", "n")
    again = scratch.write(again, "again")
    release(spark)
    spans = known.where("distinct_segs > 1").select("row", "start", "n", "h", (F.col("distinct_segs") > hot).alias("hot"))
    texts = scratch.write(spans_text(docs if unique else docs.dropDuplicates(["row"]), spans, window), "texts")
    release(spark)
    matched = scratch.write(searched(texts.where("NOT hot").drop("hot"), window), "matched")
    windows = texts.where("hot").select("h", "doc_id", "row", "start")
    least = scratch.write(windows.groupBy("h").agg(F.min(F.struct("doc_id", "start")).alias("at"), F.count("*").alias("times")).where("times > 1"), "hot-windows")
    least = least.select("h", F.col("at.doc_id").alias("first_id"), F.col("at.start").alias("first_start"))
    later = windows.join(least, "h").where("doc_id > first_id OR doc_id = first_id AND start > first_start").select("row", "start", F.lit(1).alias("n"))
    out = scratch.write(again.union(matched).union(later).groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "spans")
    release(spark)
    return out


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept (text of the words that stay, joined by one space).

    Words are `[^\\x20\\x09-\\x0D]+`; null text has none. Each word goes that a window covers whose words also start
    earlier: at a smaller id, or earlier in the same document. Null ids come after all others. Rows that repeat
    an id are compared by (id, start) like any others, so plain copies of a row do not remove each other. Other
    columns are not read. An empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "substring")
    plain = docs.select(F.col(id_col).cast("long").alias("given"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.col(text).alias("text"))
    unique = plain.groupBy("doc_id").count().where("count > 1").isEmpty()
    keyed = plain.withColumn("row", F.col("doc_id") if unique else F.xxhash64("doc_id", "text"))
    spans = repeated_spans(keyed.select("row", "doc_id", "text"), scratch, window, gram, unique=unique)
    joined = keyed.select("row", "given", "text").join(spans, "row", "left").select("given", "text", "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept = [], [], []
        for t, got in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = words_of(t)
            if got:
                gone = np.zeros(len(words) + 1, np.int32)
                for s in got:
                    gone[s["start"]] += 1
                    gone[s["start"] + s["n"] + window - 1] -= 1
                stay = np.cumsum(gone)[:-1] == 0
                left = [w for w, k in zip(words, stay.tolist()) if k]
            else:
                left = words
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return map_batches(joined, run, "doc_id long, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = {
    "op2_substring_dedup": """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS g FROM w, unnest(range(1, len(words) - 18)) AS t(s) WHERE len(words) >= 20
), rep AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM win) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, s + k AS p FROM rep, unnest(range(0, 20)) AS t(k)
), each AS (
  SELECT w.doc_id, p, words[p] AS word FROM w, unnest(range(1, len(words) + 1)) AS t(p)
), kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.p) AS t FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
}
