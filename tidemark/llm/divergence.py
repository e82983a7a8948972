"""Which sources of a language use other words than the rest: smoothed word shares of each source, compared exactly.

Two passes over the texts. The first counts in how many documents of a language each term stands; those in enough of
them are kept. The kept terms of a language are dealt into shards by hash, and each shard becomes a minimal perfect hash
(perfect_hash.py) in a task of its own. The shards are broadcast; the second pass looks each distinct word of a batch up,
checks it against the key kept in its slot, and adds to a dense row of slots of its (language, source). What a broadcast
holds is bounded by BROADCAST_BYTES: more shards than that are taken in several rounds over the texts.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, documents, small, small_batches
from tidemark.llm.perfect_hash import PerfectHash, hashes

#: Documents of its language in which a kept term stands at least.
LEAST = 30
#: Added to each count, and what shares are scaled to.
SMOOTHING, SCALE = 5, 1_000_000_000
#: Ranks of single terms that are reported.
TOP = 50
#: Keys of a shard, and bytes of shards that are broadcast at once.
SHARD_KEYS, BROADCAST_BYTES = 1 << 16, 64_000_000
#: Distinct terms, and bytes of dense rows, that a task holds before it passes its counts on.
HELD_TERMS, HELD_BYTES = 300_000, 128_000_000
#: Slots of all sources of a language that are compared at once.
BLOCK = 1024
#: A to Z become a to z; letters and all bytes above ASCII stay, all else parts terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The matches of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased; all parting characters are ASCII."""
    return text.translate(_TERMS).split()


def _plain(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).cast("binary").alias("text"))


def frequent_terms(plain: DataFrame, least: int) -> DataFrame:
    """(lang, term binary): terms in at least `least` documents of the language."""

    def run(batches):
        held: dict[str, Counter] = defaultdict(Counter)

        def rows():
            for lang, counter in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counter), pa.string()), pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())], ["lang", "term", "n"]
                )
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[lang].update(set(terms_of(text)))
            if sum(map(len, held.values())) > HELD_TERMS:
                yield from rows()
        yield from rows()

    counted = plain.select("lang", "text").mapInArrow(run, "lang string, term binary, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


def shards(kept: DataFrame) -> DataFrame:
    """One perfect hash a row: (lang, shard, of, n, bytes, sizes, bits, keys in the order of slots, spare)."""
    of = kept.groupBy("lang").agg(F.ceil(F.count("*") / SHARD_KEYS).cast("long").alias("of"))  # a row a language
    dealt = kept.join(of, "lang").withColumn("shard", F.pmod(F.shiftrightunsigned(F.xxhash64(F.col("term")), 32), F.col("of")))

    def build(key, table):
        made = PerfectHash.build(table.column("term").to_pylist())
        n = len(made.keys)
        return pa.table(
            {
                "lang": pa.array([key[0].as_py()]), "shard": pa.array([key[1].as_py()], pa.int64()), "of": pa.array([key[2].as_py()], pa.int64()), "n": pa.array([n], pa.int64()),
                "bytes": pa.array([made.keys.nbytes + len(made.set) * 9], pa.int64()), "sizes": pa.array([made.sizes], pa.list_(pa.int64())), "bits": pa.array([made.bits], pa.binary()),
                "keys": pa.array([made.keys.to_pylist()], pa.list_(pa.binary())), "spare": pa.array([made.spare], pa.int64()),
            }
        )

    schema = "lang string, shard long, of long, n long, bytes long, sizes array<long>, bits binary, keys array<binary>, spare long"
    return dealt.select("lang", "shard", "of", "term").groupBy("lang", "shard", "of").applyInArrow(build, schema)


class Lookup:
    """Some shards of each language, and the first slot of each shard."""

    def __init__(self, rows: list[tuple]):
        # (lang, shard, of, first slot, sizes, bits, keys, spare); a worker unpacks a hash when it first meets its language.
        self.rows, self.ready = rows, {}

    def slots(self, lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(which of `words` are kept terms of these shards, their slots among all of the language)."""
        if lang not in self.ready:
            self.ready[lang] = [(shard, of, first, PerfectHash(list(sizes), bits, pa.array(keys, pa.binary()), spare)) for l, shard, of, first, sizes, bits, keys, spare in self.rows if l == lang]
        if not self.ready[lang]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h, array = hashes(words), pa.array(words, pa.binary())
        dealt = (h >> np.uint64(32)) % np.uint64(self.ready[lang][0][1])
        places, found = [], []
        for shard, of, first, made in self.ready[lang]:
            mine = np.arange(len(h)) if of == 1 else np.flatnonzero(dealt == shard)
            slots = made.slots(array.take(pa.array(mine)), h[mine])
            places.append(mine[slots >= 0])
            found.append(first + slots[slots >= 0])
        return np.concatenate(places), np.concatenate(found)


def recount(plain: DataFrame, lookup: Lookup, totals: dict[str, int]) -> DataFrame:
    """(lang, source, slot, n): occurrences of the terms of `lookup`, as a task counted them."""
    spark = plain.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast((lookup, totals))

    def run(batches):
        found, totals = held.value
        dense: dict[tuple[str, str], np.ndarray] = {}

        def rows():
            for (lang, source), row in dense.items():
                at = np.flatnonzero(row)
                for k in range(0, len(at), 100_000):
                    part = at[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part), pa.array(row[part])], ["lang", "source", "slot", "n"])
            dense.clear()

        for batch in batches:
            groups = defaultdict(list)
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if lang in totals:
                    groups[lang, source].append(text)
            for (lang, source), texts in groups.items():
                counter = Counter(terms_of(b" ".join(texts)))
                if counter:
                    places, slots = found.slots(lang, list(counter))
                    if (lang, source) not in dense:
                        if sum(r.nbytes for r in dense.values()) + 8 * totals[lang] > HELD_BYTES:
                            yield from rows()
                        dense[lang, source] = np.zeros(totals[lang], np.int64)
                    # Words are distinct here, so no slot stands twice.
                    dense[lang, source][slots] += np.fromiter(counter.values(), np.int64, len(counter))[places]
        yield from rows()

    return plain.mapInArrow(run, "lang string, source string, slot long, n long")


def _share(n: str, total: str, kept: str) -> str:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * kept)) in decimals, as SCALE * n may pass 64 bits."""
    return f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + {SMOOTHING} AS DECIMAL(19,0))) div CAST({total} + {SMOOTHING} * {kept} AS DECIMAL(19,0))"


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed distance of shares of each two sources of a language, by blocks of slots."""
    blocks = groups.withColumn("block", F.explode(F.expr(f"sequence(0L, greatest(kept - 1, 0L) div {BLOCK})")))
    listed = shares.groupBy("lang", "source", F.expr(f"slot div {BLOCK}").alias("block")).agg(F.collect_list(F.struct(F.expr(f"CAST(slot % {BLOCK} AS INT)").alias("at"), "p")).alias("at"))
    rows = blocks.join(listed, ["lang", "source", "block"], "left")
    zero = F.expr(f"CASE WHEN kept > 0 THEN {_share('0L', 'total', 'kept')} ELSE 0L END").alias("zero")
    width = F.expr(f"CAST(least({BLOCK}L, kept - block * {BLOCK}) AS INT)").alias("width")
    rows = rows.select("lang", "source", "block", zero, width, F.col("at.at").alias("places"), F.col("at.p").alias("p"))

    def compare(key, table):
        sources, width = table.column("source").to_pylist(), table.column("width")[0].as_py()
        dense = np.repeat(table.column("zero").to_numpy()[:, None], width, axis=1)
        for k, (at, p) in enumerate(zip(table.column("places").to_pylist(), table.column("p").to_pylist())):
            if at:
                dense[k, at] = p
        n = len(sources)
        for k in range(n):
            others = np.flatnonzero(np.arange(n) != k)
            if len(others):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0].as_py()] * len(others)), pa.array([sources[k]] * len(others)), pa.array([sources[o] for o in others]), pa.array(np.abs(dense[others] - dense[k]).sum(1).astype(np.int64))],
                    ["lang", "source", "item", "value"],
                )

    def whole(key, table):
        made = list(compare(key, table))
        return pa.Table.from_batches(made, pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]))

    summed = rows.groupBy("lang", "block").applyInArrow(whole, "lang string, source string, item string, value long")
    return summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and by which terms.

    Part `pair` ranks the other sources by the summed distance of shares over all kept terms (0 if the language keeps
    none); part `term` the terms whose share in the source is above that in the language, up to rank `top`. Equal values rank by
    item. Null texts, languages and sources are empty ones; repeated rows count as often as they stand. A language with one source
    has no pairs; no rows give none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "divergence")
    plain = _plain(docs, lang, source, text)
    kept = scratch.write(frequent_terms(plain, least), "kept")
    hashed = scratch.write(shards(kept), "shards")

    # A row for each SHARD_KEYS kept terms.
    heads = sorted((r.lang, r.shard, r.n, r.bytes) for r in hashed.select("lang", "shard", "n", "bytes").collect())
    first, totals = {}, Counter()
    for name, shard, n, _ in heads:
        first[name, shard] = totals[name]
        totals[name] += n
    rounds, size = [], BROADCAST_BYTES + 1
    for name, shard, _, held in heads:
        if size + held > BROADCAST_BYTES:
            rounds.append([])
            size = 0
        rounds[-1].append((name, shard, first[name, shard]))
        size += held
    counted = spark.createDataFrame([], "lang string, source string, slot long, n long")
    for number, part in enumerate(rounds):
        chosen = F.broadcast(spark.createDataFrame(part, "lang string, shard long, first long"))
        rows = hashed.join(chosen, ["lang", "shard"]).select("lang", "shard", "of", "first", "sizes", "bits", "keys", "spare").collect()  # BROADCAST_BYTES at most
        part_counts = recount(plain, Lookup([tuple(r) for r in rows]), dict(totals)).groupBy("lang", "source", "slot").agg(F.sum("n").alias("n"))
        counted = counted.unionByName(scratch.write(part_counts, f"counts-{number}"))

    places = small(scratch.write(spark.createDataFrame([(*k, v) for k, v in first.items()], "lang string, shard long, first long"), "first"))
    names = hashed.join(places, ["lang", "shard"]).select("lang", F.col("first"), F.posexplode("keys").alias("at", "term")).select("lang", (F.col("first") + F.col("at")).alias("slot"), F.col("term").cast("string").alias("item"))
    sizes = spark.createDataFrame(list(totals.items()), "lang string, kept long")  # a row a language
    occurring = plain.select("lang", "source").distinct()
    group_totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = occurring.join(group_totals, ["lang", "source"], "left").join(F.broadcast(sizes), "lang", "left")
    groups = scratch.write(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")), "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    known = small(groups)

    shares = counted.join(known, ["lang", "source"]).withColumn("p", F.expr(_share("n", "total", "kept")))
    pairs = _pairs(shares, groups).withColumn("part", F.lit("pair"))
    of_lang = counted.groupBy("lang", "slot").agg(F.sum("n").alias("lang_n"))
    both = shares.join(of_lang, ["lang", "slot"]).join(F.broadcast(langs), "lang").withColumn("q", F.expr(_share("lang_n", "lang_total", "kept")))
    above = both.where("p > q").join(names, ["lang", "slot"]).select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    terms = above.select("*", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    ranked = pairs.select("*", rank)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).unionByName(terms.select(*columns))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


_P = "1 + CAST(1000000000 AS HUGEINT) * ({n} + 5) // ({total} + 5 * {kept})"
ORACLE = {
    "op12_source_divergence": rf"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS terms FROM documents),
 t AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
 kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= 30),
 c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
 v AS (SELECT lang, count(*) AS kept FROM kept GROUP BY 1),
 g AS (SELECT o.lang, o.source, coalesce(any_value(v.kept), 0) AS kept, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN v ON v.lang = o.lang LEFT JOIN c ON c.lang = o.lang AND c.source = o.source GROUP BY 1, 2),
 q AS (SELECT c.lang, c.term, {_P.format(n="sum(c.n)", total="any_value(l.total)", kept="any_value(v.kept)")} AS q FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY 1) l USING (lang) GROUP BY 1, 2),
 p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, {_P.format(n="coalesce(c.n, 0)", total="g.total", kept="g.kept")} AS p FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
 s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
 terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(p.p - q.q AS BIGINT) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 50"""
}
