"""Near copies by wide SimHash fingerprints, pigeonring chains and exact verification on word shingles.

A fingerprint is the bitwise majority of the hashes of a document's distinct words, 1008 bits on a ring of 72 segments.
Words, not shingles, vote: one changed word alters five shingles of five words but only one word, so texts whose shingles
have the Jaccard similarity 0.8 differ in some 6 % of the bits, and texts of unlike words in half of them.

The pigeonring principle: if two fingerprints differ in at most MAX_BITS bits, some start on the ring exists from which every
chain of n consecutive segments has at most n * MAX_BITS / SEGMENTS differences. A key is a chain of two segments without
a difference, from any start; four more segments go along, and a pair is a candidate only if the cumulative
differences of all six stay within their budgets. Only candidates have the whole distance counted, a parity bitmap
of the shingles then rules out what cannot reach the similarity, and what is left has its texts compared.
Pairs within SEGMENTS / 2 - 1 bits always share a key; of wider ones the chance to share one of the 72 is 0.999 and more at
the distances that near copies have (measured; see the README).

Large groups stay linear: keys are dealt by ranges of (key, document), so a key that many documents have is split; a run of
more than WIDE documents is linked to leaders first and verified links join documents to components. Documents of such a
key that are still in different components are compared only where they share one of their rarest shingles, early enough
for the similarity (prefix filtering, which is exact), and where a small parity bitmap that goes along leaves it possible;
texts just below the similarity differ in more than these. So a document meets a few others of each of its keys, however many have it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, by_group, map_batches, release, small
from tidemark.llm.components import components

#: Segments on the ring, bits in each, and the greatest distance of two fingerprints that are compared further.
SEGMENTS, WIDTH, MAX_BITS = 72, 14, 151
BITS = SEGMENTS * WIDTH
#: Segments of a key, and of the whole chain that goes with it.
KEY, CHAIN = 2, 6
#: Documents with one key up to which all are compared at once, leaders tried in a longer run, documents in a block,
#: texts whose shingles are counted together.
WIDE, LEADERS, BLOCK, TEXTS = 4, 8, 2048, 256
#: The budget for a leader's chain. Whom no leader takes is compared by rare shingles, so this costs no link.
LEADER_BITS = MAX_BITS // 4
#: Bits of the parity bitmap, and of the small one that goes with each rare shingle.
PARITY, SMALL_PARITY = 1024, 512

_LANES = 16
_STEPS = np.arange(1, _LANES + 1, dtype=np.uint64)
_ODD = (_STEPS * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def fingerprint(words: np.ndarray) -> np.ndarray:
    """Bits set in over half of the words' 1008-bit hashes, as 0 and 1; none without words. `words` are distinct XXH64."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(words), 1 << 13):
        part = mixed((words[at : at + (1 << 13), None] + _STEPS) * _ODD)
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, count=BITS).sum(0, dtype=np.int32)
    return (ones * 2 > len(words)).astype(np.uint8)


def shingle_hashes(places: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the n-word shingles of a text whose words are hashes[places]; shorter texts have one."""
    h = hashes[places]
    if len(h) < n:
        h, n = np.r_[h, np.zeros(n - len(h), np.uint64)], n
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out + h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(out)


def parity(h: np.ndarray, bits: int = PARITY) -> np.ndarray:
    """Bit k is the parity of the number of hashes that fall to k: two sets differ in as many elements as bits, or more."""
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The place of each word among the distinct ones, and the hashes of these."""
    index: dict[bytes, int] = {}
    places = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    return places, np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))


def describe(text: str | None, shingle: int) -> tuple[bytes, bytes, int, bytes]:
    """Digest of the word sequence (A-Z lower-cased), fingerprint, distinct shingles, their parity bitmap."""
    words = words_of(text)
    places, hashes = word_hashes(words)
    h = shingle_hashes(places, hashes, shingle)
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest(), np.packbits(np.r_[fingerprint(hashes), np.zeros(-BITS % 64, np.uint8)]).tobytes(), len(h), parity(h).tobytes()


def described(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, sha, digest, fp, size, bits) of each row of `docs` (id long, sha, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(zip(*(describe(t, shingle) for t in batch.column(2).to_pylist())))
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(found, kinds))], ["id", "sha", "digest", "fp", "size", "bits"])

    return map_batches(docs.select("id", "sha", "text"), run, "id long, sha string, digest binary, fp binary, size int, bits binary")


def unpacked(column: pa.ChunkedArray | pa.Array, bits: int) -> np.ndarray:
    n = len(column)
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1)
    return np.unpackbits(data, axis=1, count=bits)


def chains(features: DataFrame) -> DataFrame:
    """(key, node, chain, comp): a row for each start on the ring; `features` has node, comp and fp."""
    powers = 1 << np.arange(WIDTH, dtype=np.int64)[::-1]

    def run(batch: pa.RecordBatch) -> pa.Table:
        segments = unpacked(batch.column(2), BITS).reshape(batch.num_rows, SEGMENTS, WIDTH) @ powers
        turn = lambda k: np.roll(segments, -k, axis=1)
        key = np.arange(SEGMENTS, dtype=np.int64)[None, :] << (KEY * WIDTH)
        for k in range(KEY):
            key = key | turn(k) << (WIDTH * (KEY - 1 - k))
        chain = np.zeros_like(segments)
        for k in range(KEY, CHAIN):
            chain = chain << WIDTH | turn(k)
        node, comp = (np.repeat(batch.column(k).to_numpy(), SEGMENTS) for k in (0, 1))
        return pa.Table.from_arrays([pa.array(x) for x in (key.ravel(), node, chain.ravel(), comp)], ["key", "node", "chain", "comp"])

    return map_batches(features.select("node", "comp", "fp"), run, "key long, node long, chain long, comp long")


def within(differing: np.ndarray, bits: int = MAX_BITS) -> np.ndarray:
    """Of XORed chains, those whose cumulative differences stay within the proportional budgets at every length."""
    total, fits = np.zeros(len(differing), np.int64), np.ones(len(differing), bool)
    for n in range(KEY, CHAIN):
        total += np.bitwise_count(differing >> (WIDTH * (CHAIN - 1 - n)) & ((1 << WIDTH) - 1))
        fits &= total <= (n + 1) * bits // SEGMENTS
    return fits


def runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that stand together by `group`: the first row of each row's run, and the row after its last."""
    n = len(group)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    lengths = np.diff(np.r_[starts, n])
    return np.repeat(starts, lengths), np.repeat(starts + lengths, lengths)


def first_links(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (rows a, b) among the documents of each key, and the keys that were not compared pair by pair."""
    key, chain = part.column("key").to_numpy(), part.column("chain").to_numpy()
    begin, end = runs(key)
    short = end - begin <= WIDE
    found = [(np.zeros(0, np.int64),) * 2]
    rows, step = np.flatnonzero(short & (end - begin > 1)), 1
    while len(rows := rows[rows + step < end[rows]]):
        fits = rows[within(chain[rows] ^ chain[rows + step])]
        found.append((fits, fits + step))
        step += 1
    rest = np.flatnonzero(~short)
    for _ in range(LEADERS):
        if not len(rest):
            break
        lead = rest[runs(key[rest])[0]]
        fits = within(chain[lead] ^ chain[rest], LEADER_BITS)
        linked = fits & (lead != rest)
        found.append((lead[linked], rest[linked]))
        rest = rest[~fits]
    a, b = (np.concatenate(x) for x in zip(*found))
    return a, b, np.unique(key[~short])


def candidates(features: DataFrame) -> DataFrame:
    """(hot, a, b): pairs of nodes, a < b, where not hot; where hot, a is a key whose documents are yet to be compared pair by pair.

    Keys that more than WIDE documents have are hot, and so are the first and last key of each range, which may go on in
    the next one.
    """

    def run(batches):
        edges: list[int] = []

        def links(part: pa.Table) -> pa.Table:
            key, node = part.column("key").to_numpy(), part.column("node").to_numpy()
            edges[:] = [*edges[:1], int(key[-1])] if edges else [int(key[0]), int(key[-1])]
            a, b, hot = first_links(part)
            pairs = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])], 1), axis=0)
            flag = np.r_[np.zeros(len(pairs), bool), np.ones(len(hot), bool)]
            return pa.Table.from_arrays([pa.array(flag), pa.array(np.r_[pairs[:, 0], hot]), pa.array(np.r_[pairs[:, 1], hot])], ["hot", "a", "b"])

        yield from by_group("key", links)(batches)
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(edges)), pa.array(edges, pa.int64()), pa.array(edges, pa.int64())], ["hot", "a", "b"])

    keyed = chains(features).select("key", "node", "chain")
    return keyed.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(run, "hot boolean, a long, b long").distinct()


def rest_of(hot: DataFrame, features: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) of the documents that share one of the keys `hot` (key), a written table, with one of another component."""
    rows = scratch.write(chains(features).join(small(hot), "key").select("key", "node", "comp"), "hot-rows")
    several = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    return rows.join(several, "key", "left_semi").select("node", "comp").distinct()


def least_common(x, y, similarity: float):
    """Shingles that sets of `x` and `y` shingles have in common at least, if they have the similarity."""
    return np.ceil(similarity / (1 + similarity) * (x + y) - 1e-6)


def prefixes(texts: DataFrame, shingle: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(h, node, comp, size, at, bits): each text's rarest shingles, of which similar texts share one; `texts`, a written table, is (node, comp, text).

    Shingles are ordered by the number of texts that hold them. Two sets with c elements in common share one of the
    first |x| - c + 1 of the one and |y| - c + 1 of the other, and c is similarity * |x| at least. `at` is the place in this
    order, from 0, and `bits` the small parity bitmap of all the text's shingles. A shingle that no other text holds takes a
    place but has no row. Texts are counted and ordered by chunks of TEXTS, so that what most of them hold is shuffled once a chunk.
    """
    hashed = lambda part: [shingle_hashes(*word_hashes(words_of(t)), shingle) for t in part.column("text").to_pylist()]

    def count(part: pa.Table) -> pa.Table:
        h, n = np.unique(np.concatenate(hashed(part)), return_counts=True)
        return pa.Table.from_arrays([pa.array(np.full(len(h), part.column("chunk")[0].as_py())), pa.array(h.view(np.int64)), pa.array(n)], ["chunk", "h", "n"])

    def order(part: pa.Table, shared: pa.Table) -> pa.Table:
        known, n = (shared.column(c).to_numpy() for c in ("h", "n"))
        by = np.argsort(known)
        known, n, out, bits = known[by], n[by], [(np.zeros(0, np.int64),) * 5], []
        for node, comp, h in zip(part.column("node").to_pylist(), part.column("comp").to_pylist(), hashed(part)):
            size, (_, _, held) = len(h), np.intersect1d(h.view(np.int64), known, assume_unique=True, return_indices=True)
            alone = size - len(held)
            first = held[np.lexsort((known[held], n[held]))][: max(0, size - int(np.ceil(similarity * size - 1e-6)) + 1 - alone)]
            out.append((known[first], *(np.full(len(first), x) for x in (node, comp, size)), alone + np.arange(len(first))))
            bits += [parity(h, SMALL_PARITY).tobytes()] * len(first)
        return pa.Table.from_arrays([*(pa.array(np.concatenate(x)) for x in zip(*out)), pa.array(bits, pa.binary())], ["h", "node", "comp", "size", "at", "bits"])

    chunks = texts.count() // TEXTS + 1
    dealt = texts.select("node", "comp", "text", F.pmod(F.xxhash64("node"), F.lit(chunks)).alias("chunk"))
    counts = scratch.write(dealt.groupBy("chunk").applyInArrow(count, "chunk long, h long, n long"), "more-counts")
    totals = counts.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    shared = counts.drop("n").join(totals, "h")
    return dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(order, "h long, node long, comp long, size long, at long, bits binary")


def sharing(rare: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of different components that share a shingle of `rare`, a written table of `prefixes`, early enough to be similar, and that their bitmaps do not rule out."""
    several = rare.groupBy("h").agg(F.count("*").alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("h", "n")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(own, other).alias("p"), F.greatest(own, other).alias("q")))
    dealt = rare.join(several, "h").select("node", "comp", "size", "at", "bits", "h", F.explode(pairs).alias("pair")).select("node", "comp", "size", "at", "bits", F.xxhash64("h", "pair.p", "pair.q").alias("grp"))

    def compare(part: pa.Table) -> pa.Table:
        node, comp, size, at, group = (part.column(c).to_numpy().astype(np.int64) for c in ("node", "comp", "size", "at", "grp"))
        bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint64).reshape(len(node), -1)
        # What stands too late for the smallest set of the group that is large enough is too late for all.
        begin, _ = runs(group)
        smallest = np.minimum.reduceat(size, np.unique(begin))[np.unique(begin, return_inverse=True)[1]]
        early = at + least_common(size, np.maximum(smallest, similarity * size), similarity) <= size
        node, comp, size, at, group, bits = (x[early] for x in (node, comp, size, at, group, bits))
        found = [np.zeros((0, 2), np.int64)]
        if len(node):
            _, end = runs(group)
            rows, step = np.arange(len(node)), 1
            while len(rows := rows[rows + step < end[rows]]):
                a = rows[comp[rows] != comp[rows + step]]
                b = a + step
                least = least_common(size[a], size[b], similarity)
                fits = (at[a] + least <= size[a]) & (at[b] + least <= size[b])
                a, b, least = a[fits], b[fits], least[fits]
                fits = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64) <= size[a] + size[b] - 2 * least
                found.append(np.stack([np.minimum(node[a], node[b])[fits], np.maximum(node[a], node[b])[fits]], 1))
                step += 1
        out = np.unique(np.concatenate(found), axis=0)
        return pa.Table.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    return dealt.repartition("grp").sortWithinPartitions("grp", "node").mapInArrow(by_group("grp", compare), "a long, b long").distinct()


def measured(pairs: DataFrame, features: DataFrame, similarity: float) -> DataFrame:
    """(a, b, bits) of `pairs` within MAX_BITS that the parity bitmaps do not rule out."""
    side = lambda n: features.select(F.col("node").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in ("fp", "size", "bits")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = lambda k: np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        bits = np.bitwise_count(words(2) ^ words(5)).sum(1, dtype=np.int64)
        x, y = (batch.column(k).to_numpy().astype(np.int64) for k in (3, 6))
        # As many shingles in common as the similarity asks for, so at most so many that only one of the two has.
        least = least_common(x, y, similarity)
        fits = (bits <= MAX_BITS) & (np.minimum(x, y) >= least) & (np.bitwise_count(words(4) ^ words(7)).sum(1, dtype=np.int64) <= x + y - 2 * least)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits)], ["a", "b", "bits"]).filter(pa.array(fits))

    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return map_batches(both.select("a", "b", "a_fp", "a_size", "a_bits", "b_fp", "b_size", "b_bits"), run, "a long, b long, bits long")


def shingles(text: str | None, n: int) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    return set(zip(*(words[k:] for k in range(n)))) if len(words) >= n else {tuple(words)}


def similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b) of `pairs` whose word shingles have the Jaccard similarity or more; `texts` is (node, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, last, p = [], None, set()
        for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if a != last:
                last, p = a, shingles(x, shingle)
            q = shingles(y, shingle)
            both = len(p & q)
            keep.append(both >= similarity * (len(p) + len(q) - both))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    one = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    both = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    return map_batches(both.select("a", "b", "a_text", "b_text"), run, "a long, b long")


def nearest(pairs: DataFrame) -> DataFrame:
    """(a, b) of `pairs` (a, b, bits): for each node the nearest of the others, the smaller one on a tie."""
    both = pairs.select(F.col("a").alias("x"), "a", "b", "bits").union(pairs.select(F.col("b").alias("x"), "a", "b", "bits"))
    return both.groupBy("x").agg(F.min_by(F.struct("a", "b"), F.struct("bits", "a", "b")).alias("p")).select("p.a", "p.b").distinct()


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each group of near copies, that with the smallest id; all columns are kept.

    Two documents are linked if the Jaccard similarity of their word shingles (A-Z lower-cased) is `similarity` or more; a group
    is what links connect. Texts of the same words in the same order are always linked; those without a word are,
    null ones too. Null ids come after all others; of rows that repeat one id and text one stays, of rows of one
    group that repeat an id with different texts one of the lesser sha256. Columns may have any names. No rows give none.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "near-copies")
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__sha": F.sha2(F.coalesce(F.col(text), F.lit("")), 256)})
    plain = keyed.select(F.col("__id").alias("id"), F.col("__sha").alias("sha"), F.col(text).alias("text"))
    # Numbered as they are written: whichever attempt of a task is kept, all later steps read that one.
    rows = scratch.write(described(plain, shingle).withColumn("node", F.monotonically_increasing_id()), "rows")
    same = scratch.write(rows.groupBy("digest").agg(F.min("node").alias("node")), "same")
    features = scratch.write(rows.select("node", F.col("node").alias("comp"), "fp", "size", "bits").join(same, "node", "left_semi"), "features")
    found = scratch.write(candidates(features), "candidates")
    release(spark)
    pairs = scratch.write(measured(found.where("NOT hot"), features, similarity), "pairs")

    def texts_of(nodes: DataFrame, name: str) -> DataFrame:
        wanted = scratch.write(rows.select("node", "sha").join(small(scratch.write(nodes, f"{name}-nodes")), "node", "left_semi"), f"{name}-wanted")
        return scratch.write(plain.select("sha", "text").join(small(wanted), "sha").dropDuplicates(["node"]).select("node", "text"), name)

    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "texts")
    close = scratch.write(nearest(pairs), "nearest")
    links = scratch.write(similar(close, texts, shingle, similarity), "links-nearest")

    def label(links: DataFrame, name: str, known: DataFrame | None = None) -> DataFrame:
        """The components of `links` and of what is joined already, of which each node's link to its component is enough."""
        if known is not None:
            links = links.union(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return scratch.write(components(links, Scratch(spark, "near-copies-components")), name)

    def apart(links: DataFrame, known: DataFrame) -> DataFrame:
        of = lambda n: known.select(F.col("node").alias(n), F.col("component").alias(f"{n}_comp"))
        joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return joined.where(F.coalesce("a_comp", "a") != F.coalesce("b_comp", "b")).select("a", "b")

    known = label(links, "linked")
    others = scratch.write(apart(pairs, known).join(close, ["a", "b"], "left_anti"), "others")
    links = scratch.write(similar(others, texts, shingle, similarity), "links-others")
    scratch.drop("texts")
    known = label(links, "linked-2", known)
    release(spark)

    joined = features.drop("comp").join(known, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    rest = scratch.write(rest_of(scratch.write(found.where("hot").select(F.col("a").alias("key")).distinct(), "hot"), joined, scratch), "rest")
    texts = scratch.write(texts_of(rest.select("node"), "more-texts").join(small(rest), "node"), "rest-texts")
    rare = scratch.write(prefixes(texts, shingle, similarity, scratch), "rare")
    scratch.drop("more-texts", "more-counts")
    more = scratch.write(sharing(rare, similarity), "more")
    more = scratch.write(measured(more.join(pairs.select("a", "b"), ["a", "b"], "left_anti"), features, similarity), "more-pairs")
    links = scratch.write(similar(more, texts, shingle, similarity), "links-more")
    known = label(links, "linked-3", known)
    release(spark)

    named = rows.select("id", "sha", "digest").join(same, "digest").join(known, "node", "left").select("id", "sha", F.coalesce("component", "node").alias("component"))
    named = scratch.write(named.groupBy("component", "id", "sha").agg(F.count("*").alias("n")), "named")
    stays = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sha")).alias("s")).select("component", F.col("s.id").alias("s_id"), F.col("s.sha").alias("s_sha"))
    differs = ~(F.col("id").eqNullSafe(F.col("s_id")) & (F.col("sha") == F.col("s_sha")))
    gone = scratch.write(named.join(stays, "component").where(differs).select(F.col("id").alias("__gone_id"), F.col("sha").alias("__gone_sha")), "gone")
    kept = keyed.join(small(gone), F.col("__id").eqNullSafe(F.col("__gone_id")) & (F.col("__sha") == F.col("__gone_sha")), "left_anti")
    if not named.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["__id", "__sha"])
    return kept.drop("__id", "__sha")
