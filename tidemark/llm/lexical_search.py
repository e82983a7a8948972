"""The best documents for each of a set of texts, by an integer form of weighted term matching, found with two trees.

The first pass reduces each document to its number of terms and to how often it holds the items' terms; these rows are
written once, and the statistics come from them. The second pass searches them in batches: a batch's documents and the
items each form a hierarchy whose nodes hold, per term, the greatest impact (weight) of what lies below. The product of
two nodes bounds the score of every pair below them. A pair of nodes is left out where that bound is below the weakest
kth score that the items below have so far, so whole batches of pairs go without being looked at, and none that could
enter a result. What the items have at the start of a batch comes from a search of a part of the documents before.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, documents, small_batches

#: Documents reported for an item.
K = 10
#: Items, and distinct terms of theirs, that are broadcast and searched at once; more are taken in several rounds.
ITEMS_AT_ONCE, TERMS_AT_ONCE = 512, 16_384
#: One document in so many gives the scores that pruning begins with.
SEED_SHARE = 32
#: Bytes of the dense impacts of a batch of documents.
BATCH_BYTES = 64_000_000
#: Rows of a leaf and nodes below a node, of items and of documents.
ITEM_LEAF, ITEM_FAN, DOC_LEAF, DOC_FAN = 2, 4, 16, 8
#: A to Z become a to z; digits, letters and all bytes above ASCII stay, all else parts terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased."""
    return text.translate(_TERMS).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = 10 + 90 * n * documents // length
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Tree:
    """Rows of a dense non-negative matrix in groups of `leaf`, these in groups of `fan`, up to one group; `top[level]` has a node's maxima a row."""

    def __init__(self, dense: np.ndarray, leaf: int, fan: int):
        self.rows, self.leaf, self.fan = dense, leaf, fan
        self.top = [np.maximum.reduceat(dense, np.arange(0, len(dense), leaf), axis=0)]
        while len(self.top[-1]) > 1:
            self.top.append(np.maximum.reduceat(self.top[-1], np.arange(0, len(self.top[-1]), fan), axis=0))

    def below(self, level: int, node: int) -> tuple[int, int]:
        """The nodes of the next level down, or the rows of a leaf."""
        size, upper = (self.leaf, len(self.rows)) if level == 0 else (self.fan, len(self.top[level - 1]))
        return node * size, min((node + 1) * size, upper)

    def span(self, level: int, node: int) -> tuple[int, int]:
        """The rows below a node."""
        size = self.leaf * self.fan**level
        return node * size, min((node + 1) * size, len(self.rows))


class Items:
    """The items of a round: their terms as numbers, later with weights; in an order that puts like ones together."""

    def __init__(self, names: list, terms: list[list[int]], size: int):
        self.names, self.terms, self.size, self.seeds, self.tree = names, terms, size, None, None

    def weigh(self, weights: list[int], df: list[int]) -> None:
        """Items that share their most frequent terms come together, which keeps languages apart."""
        rank = {t: k for k, t in enumerate(sorted(range(self.size), key=lambda t: (-df[t], t)))}
        order = sorted(range(len(self.names)), key=lambda i: sorted(rank[t] for t in self.terms[i]))
        self.names, self.terms = [self.names[i] for i in order], [self.terms[i] for i in order]
        self.weights, self.seeds = weights, [0] * len(order)
        self.common = sorted(rank, key=rank.get)[:64]

    def ready(self) -> None:
        """The tree of weights and, for each node, its terms and the maxima of what lies below; made once in a worker."""
        if self.tree is None:
            dense = np.zeros((len(self.names), self.size))
            for row, terms in zip(dense, self.terms):
                row[terms] = [self.weights[t] for t in terms]
            if dense.sum(1).max(initial=0) * 1_000_000 >= 2**53:
                dense = dense.astype(np.int64)  # a float64 would not hold such a score
            self.tree = Tree(dense, ITEM_LEAF, ITEM_FAN)
            self.parts = []
            for level, top in enumerate(self.tree.top):
                rows = []
                for node, most in enumerate(top):
                    used = np.flatnonzero(most)
                    first, last = self.tree.below(level, node)
                    rows.append((used, (self.tree.rows if level == 0 else self.tree.top[level - 1])[first:last][:, used], most[used][None, :]))
                self.parts.append(rows)


class Search:
    """The k best documents of each item so far, of the batches that were searched."""

    def __init__(self, items: Items, k: int = K):
        items.ready()
        self.items, self.k = items, k
        self.best: list[list[tuple]] = [[] for _ in items.names]
        self.floor = np.array(items.seeds, np.float64)  # scores below cannot be among the k best
        self.pairs = self.scored = 0

    def add(self, ids: list, dense: np.ndarray) -> None:
        """Searches documents whose impacts are the rows of `dense`; those with one common term and one heaviest term come together."""
        weighed = dense * np.array(self.items.weights, dense.dtype)
        order = np.lexsort((weighed.max(1), weighed.argmax(1), (dense[:, self.items.common] > 0).argmax(1)))
        self.ids, self.docs = [ids[k] for k in order], Tree(dense[order], DOC_LEAF, DOC_FAN)
        self.pairs += len(ids) * len(self.items.names)
        self.visit(len(self.items.tree.top) - 1, 0, len(self.docs.top) - 1, 0)

    def visit(self, li: int, i: int, ld: int, d: int) -> None:
        used, maxima, own = self.items.parts[li][i]
        if li == 0 and ld == 0:
            self.score(i, d, used, maxima)
            return
        # An item's leaf stays whole until the documents have come down to a leaf too, and the other way round.
        i0, left = (i, own) if li == 0 else (self.items.tree.below(li, i)[0], maxima)
        if ld == 0:
            d0, right = d, self.docs.top[0][d : d + 1]
        else:
            d0, last = self.docs.below(ld, d)
            right = self.docs.top[ld - 1][d0:last]
        bounds = left @ right[:, used].astype(left.dtype).T
        next_i, next_d = max(li - 1, 0), max(ld - 1, 0)
        for flat in np.argsort(-bounds, axis=None).tolist():
            a, b = divmod(flat, bounds.shape[1])
            first, last = self.items.tree.span(next_i, i0 + a)
            if bounds[a, b] > 0 and bounds[a, b] >= self.floor[first:last].min():
                self.visit(next_i, i0 + a, next_d, d0 + b)

    def score(self, i: int, d: int, used: np.ndarray, weights: np.ndarray) -> None:
        first, _ = self.items.tree.below(0, i)
        begin, end = self.docs.below(0, d)
        scores = weights @ self.docs.rows[begin:end][:, used].astype(weights.dtype).T
        self.scored += scores.size
        for a in np.flatnonzero((scores >= self.floor[first : first + len(scores), None]).any(1)).tolist():
            item, row = first + a, scores[a]
            found = self.best[item]
            for b in np.flatnonzero((row >= self.floor[item]) & (row > 0)).tolist():
                doc = self.ids[begin + b]
                found.append((-int(row[b]), doc is None, doc or 0))
            found.sort()
            del found[self.k :]
            if len(found) == self.k:
                self.floor[item] = max(self.floor[item], -found[-1][0])

    def rows(self) -> list[tuple]:
        return [(at, None if null else doc, -score) for at, found in enumerate(self.best) for score, null, doc in found]


def rounds(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[Items, dict[bytes, int]]]:
    """Items in rounds of bounded size, one after the other, each with the numbers of its terms; rows of one id are one item."""
    rows = items.select(F.col(item_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text")).orderBy("id", "text")
    names, terms, numbers = [], [], {}
    for row in rows.toLocalIterator():
        own = dict.fromkeys(terms_of(bytes(row.text)))
        same = bool(names) and names[-1] == row.id
        if not same and names and (len(names) >= ITEMS_AT_ONCE or len(numbers) + len(own) > TERMS_AT_ONCE):
            yield Items(names, terms, len(numbers)), numbers
            names, terms, numbers = [], [], {}
        ids = [numbers.setdefault(t, len(numbers)) for t in own]
        if same:
            terms[-1] = sorted({*terms[-1], *ids})
        else:
            names.append(row.id)
            terms.append(ids)
    if names:
        yield Items(names, terms, len(numbers)), numbers


def project(docs: DataFrame, numbers: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tf): documents with at least one term, reduced to the terms in `numbers`."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(numbers)

    def run(batches):
        known = held.value
        for batch in batches:
            lengths, counts, terms, tfs = [], [], [], []
            for content in batch.column(1).to_pylist():
                words = terms_of(content)
                found = [(known[w], c) for w, c in Counter(words).items() if w in known]
                lengths.append(len(words))
                counts.append(len(found))
                terms += [t for t, _ in found]
                tfs += [c for _, c in found]
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>").where("n > 0")


def search(reduced: DataFrame, items: Items, documents: int, length: int, k: int) -> DataFrame:
    """(at, doc_id, score): for each task and item the best of its documents that may be among the k best of all."""
    held = reduced.sparkSession.sparkContext.broadcast(items)
    most = max(DOC_LEAF, BATCH_BYTES // (8 * max(1, items.size)))

    def run(batches):
        found = Search(held.value, k)
        for batch in batches:
            lists, all_ids, n = batch.column(2), batch.column(0).to_pylist(), batch.column(1).to_numpy()
            offsets, terms, tf = lists.offsets.to_numpy(), lists.values.to_numpy(), batch.column(3).values.to_numpy().astype(np.int64)
            for begin in range(0, batch.num_rows, most):
                end = min(begin + most, batch.num_rows)
                a, b = offsets[begin], offsets[end]
                row = np.repeat(np.arange(end - begin), np.diff(offsets[begin : end + 1]))
                if b > a:
                    dense = np.zeros((end - begin, items.size), np.float32)  # impacts are below 10**6, which it holds exactly
                    dense[row, terms[a:b]] = impact(tf[a:b], n[begin:end][row], documents, length)
                    found.add(all_ids[begin:end], dense)
        rows = found.rows()
        if rows:
            at, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["at", "doc_id", "score"])

    return reduced.where("size(terms) > 0").mapInArrow(run, "at int, doc_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("at").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` best documents of each item with a score above 0, ties by doc_id, null ids last.

    A null text has no term, and a document without one counts nowhere. Repeated documents each have a rank. Rows of one
    item_id are one item with the terms of all. Items without a term, or no documents, give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    out = spark.createDataFrame([], f"item_id {dict(items.dtypes)[item_id]}, rank int, doc_id long, score long")
    for number, (part, numbers) in enumerate(rounds(items, item_id, item_text)):
        reduced = scratch.write(project(docs, numbers, doc_id, text), f"reduced-{number}")
        total = reduced.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        if not total.documents:
            continue
        df = [0] * part.size
        for r in reduced.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # TERMS_AT_ONCE rows at most, or one item's terms
            df[r.t] = r["count"]
        part.weigh([weight(total.documents, n) for n in df], df)
        first = best(search(reduced.where(F.pmod(F.xxhash64("doc_id"), F.lit(SEED_SHARE)) == 0), part, total.documents, total.length, k), k)
        for r in first.where(F.col("rank") == k).select("at", "score").collect():  # a row an item of the round
            part.seeds[r.at] = r.score
        found = best(search(reduced, part, total.documents, total.length, k), k)
        names = F.broadcast(spark.createDataFrame(list(enumerate(part.names)), f"at int, item_id {dict(items.dtypes)[item_id]}"))
        out = out.unionByName(found.join(names, "at").select("item_id", "rank", "doc_id", "score"))
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = r"list_filter(string_split_regex(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = {
    "op13_lexical_search": f"""WITH d AS (SELECT doc_id, {_SPLIT.format(c="text")} AS terms FROM documents WHERE text IS NOT NULL),
 e AS (SELECT row_number() OVER () AS k, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
 s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM e),
 i AS (SELECT DISTINCT item_id, unnest({_SPLIT.format(c="text")}) AS term FROM benchmark),
 t AS (SELECT k, doc_id, n, term, count(*) AS tf FROM (SELECT k, doc_id, n, unnest(terms) AS term FROM e) WHERE term IN (SELECT term FROM i) GROUP BY 1, 2, 3, 4),
 w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(s.docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY 1),
 c AS (SELECT t.k, t.doc_id, t.term, w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (10 + (90 * t.n * s.docs) // s.length))) AS part FROM t JOIN w USING (term), s),
 f AS (SELECT i.item_id, c.k, c.doc_id, CAST(sum(c.part) AS BIGINT) AS score FROM i JOIN c USING (term) GROUP BY 1, 2, 3 HAVING sum(c.part) > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10"""
}
