"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word gives the network its word input (how labels lean where the word occurs) and character inputs (the same
for the character n-grams of the word: the greatest of the short and of the long ones, and the mean). The leanings are counted on the
training sample; a training document's own occurrences are left out of what it is shown. A document is cut into
overlapping windows, every one is scored, and its score is that of its highest window.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, small_batches

WINDOW, STRIDE = 32, 24
HIDDEN = 8
FEATURES = 5
#: Labelled documents of each class that the network is fitted on at most, taken in the order of a hash of the id.
SAMPLE = {1: 1200, 0: 2400}
BUCKETS = 1 << 18
NGRAMS = (3, 4, 5, 6)
#: Prior weight of the label share in a leaning, in documents.
PRIOR = 10.0
THRESHOLD = 0.7
#: Unique words whose inputs a task remembers, and windows that go through the network at once.
MEMORY, LANES = 150_000, 1024
_SPLIT = bytes(32 if not (48 <= b < 58 or 97 <= b < 123 or b > 127) else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words of letters and digits (all that is not ASCII counts as a letter)."""
    return text.lower().encode("utf-8", "replace").translate(_SPLIT).split() if text else []


def word_buckets(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % BUCKETS


def gram_buckets(words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length in NGRAMS: the bucket of each byte n-gram of <word>, and where each word's n-grams begin.

    A word that is shorter than n with its borders is one n-gram, padded.
    """
    data = np.frombuffer(b"".join(b"<" + w + b">" + b"\0" * max(0, NGRAMS[-1] - 2 - len(w)) for w in words), np.uint8).astype(np.uint64)
    lengths = np.fromiter((max(NGRAMS[-1], len(w) + 2) for w in words), np.int64, len(words))
    begin = np.cumsum(lengths) - lengths
    out, h, of = [], np.zeros(len(data), np.uint64), np.repeat(np.arange(len(words)), lengths)
    for n in range(1, NGRAMS[-1] + 1):
        h = h[: len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :] + np.uint64(1)
        if n in NGRAMS:
            inside = of[: len(h)] == of[n - 1 :]
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
            out.append(((mixed[inside] >> np.uint64(40)).astype(np.int32) % BUCKETS, begin - np.arange(len(words)) * (n - 1)))
    return out


def leaning(toxic: np.ndarray, seen: np.ndarray, share: float) -> np.ndarray:
    p = (toxic + PRIOR * share) / (seen + PRIOR)
    return (np.log(p / (1 - p)) - np.log(share / (1 - share))).astype(np.float32)


def inputs(word: np.ndarray, known: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of FEATURES for each word: its leaning, the greatest of its short and of its long n-grams, their mean, and whether the word was seen."""
    most = [np.maximum.reduceat(x, at) for x, at in grams]
    total = [np.add.reduceat(x, at) for x, at in grams]
    count = sum(np.diff(np.r_[at, len(x)]) for x, at in grams)
    half = len(grams) // 2
    return np.stack([word, np.maximum.reduce(most[:half]), np.maximum.reduce(most[half:]), sum(total) / count, known], axis=1).astype(np.float32)


@dataclass
class Network:
    """Weights of both directions, of the attention and of the output."""

    w: list[np.ndarray]
    u: list[np.ndarray]
    b: list[np.ndarray]
    attend: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.w, *self.u, *self.b, self.attend, self.out, self.bias]


def fresh(rng: np.random.Generator) -> Network:
    draw = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
    return Network(
        [draw(FEATURES, 3 * HIDDEN) for _ in range(2)], [draw(HIDDEN, 3 * HIDDEN) for _ in range(2)], [np.zeros(3 * HIDDEN, np.float32) for _ in range(2)],
        draw(2 * HIDDEN), draw(2 * HIDDEN), np.zeros(1, np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _direction(projected: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
    """Gated recurrent unit over (steps, windows, 3 * HIDDEN): the states; `keep` collects what training needs."""
    steps, n, _ = projected.shape
    h = np.zeros((n, HIDDEN), np.float32)
    states = np.empty((steps, n, HIDDEN), np.float32)
    gates, fresh_part = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
    for t in range(steps):
        zr = h @ gates
        zr += projected[t, :, : 2 * HIDDEN]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        g = (r * h) @ fresh_part
        g += projected[t, :, 2 * HIDDEN :]
        np.tanh(g, out=g)
        if keep is not None:
            keep.append((h, z, r, g))
        new = np.subtract(g, h, out=states[t])
        new *= z
        if not mask[t].all():
            new *= mask[t][:, None]
        new += h
        h = new
    return states


def logits(net: Network, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """`x` (steps, windows, FEATURES), `mask` (steps, windows): 0 where a window has ended."""
    states = []
    for d in range(2):
        order = slice(None, None, -1 if d else 1)
        held: list | None = [] if keep is not None else None
        got = _direction((x @ net.w[d] + net.b[d])[order], mask[order], net.u[d], held)
        states.append(got[order])
        if keep is not None:
            keep[d] = held
    h = np.concatenate(states, axis=2)
    score = h @ net.attend + (mask - 1) * 1e9
    score = np.exp(score - score.max(0))
    share = score / score.sum(0)
    pooled = (share[:, :, None] * h).sum(0)
    if keep is not None:
        keep["h"], keep["share"], keep["pooled"] = h, share, pooled
    return pooled @ net.out + net.bias[0]


def gradients(net: Network, x: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted cross-entropy and its gradients, by backpropagation through time."""
    keep: dict = {}
    logit = logits(net, x, mask, keep)
    p = _sigmoid(logit)
    loss = -float((weight * (label * np.log(p + 1e-7) + (1 - label) * np.log(1 - p + 1e-7))).sum() / weight.sum())
    dlogit = (weight * (p - label) / weight.sum()).astype(np.float32)
    h, share, pooled = keep["h"], keep["share"], keep["pooled"]
    dout, dbias = pooled.T @ dlogit, np.array([dlogit.sum()], np.float32)
    dpooled = dlogit[:, None] * net.out
    dscore = share * ((h * dpooled).sum(2) - (pooled * dpooled).sum(1))
    dattend = np.einsum("tnk,tn->k", h, dscore)
    dh_all = share[:, :, None] * dpooled + dscore[:, :, None] * net.attend
    dws, dus, dbs = [], [], []
    for d in range(2):
        order = slice(None, None, -1 if d else 1)
        xs, ms, dhs, u = x[order], mask[order], dh_all[order][:, :, d * HIDDEN : (d + 1) * HIDDEN], net.u[d]
        du, dproj = np.zeros_like(u), np.zeros((*x.shape[:2], 3 * HIDDEN), np.float32)
        dh = np.zeros(dhs.shape[1:], np.float32)
        for t in range(len(xs) - 1, -1, -1):
            before, z, r, g = keep[d][t]
            dh = dh + dhs[t]
            m = ms[t][:, None]
            dz, dg = dh * m * (g - before) * z * (1 - z), dh * m * z * (1 - g * g)
            back = dg @ u[:, 2 * HIDDEN :].T
            dr = back * before * r * (1 - r)
            du[:, :HIDDEN] += before.T @ dz
            du[:, HIDDEN : 2 * HIDDEN] += before.T @ dr
            du[:, 2 * HIDDEN :] += (r * before).T @ dg
            dproj[t] = np.concatenate([dz, dr, dg], axis=1)
            dh = dh * (1 - m * z) + back * r + dz @ u[:, :HIDDEN].T + dr @ u[:, HIDDEN : 2 * HIDDEN].T
        dws.append(np.einsum("tnf,tnk->fk", xs, dproj))
        dus.append(du)
        dbs.append(dproj.sum((0, 1)))
    return loss, [*dws, *dus, *dbs, dattend, dout, dbias]


def fit(x: np.ndarray, mask: np.ndarray, label: np.ndarray, epochs: int = 6, size: int = 256, rate: float = 0.01, seed: int = 5, net: Network | None = None) -> Network:
    """Adam on windows; the classes weigh the same."""
    rng = np.random.default_rng(seed)
    net = net or fresh(rng)
    some = max(1.0, label.sum())
    weight = np.where(label > 0, 0.5 / some, 0.5 / max(1.0, len(label) - label.sum())).astype(np.float32)
    params = net.parameters()
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    rounds = max(1, -(-len(label) // size))
    for epoch in range(max(epochs, 150 // rounds)):
        order = rng.permutation(len(label))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            _, grads = gradients(net, x[:, pick], mask[:, pick], label[pick], weight[pick])
            step += 1
            for k, (p, g) in enumerate(zip(params, grads)):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                p -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def window_starts(n: int) -> list[int]:
    """First words of the overlapping windows of a text of n words; the last window ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


@dataclass
class Model:
    """What scoring needs: leanings by bucket and the network; its size does not depend on the corpus."""

    words: np.ndarray
    seen: np.ndarray
    grams: np.ndarray
    net: Network

    def word_inputs(self, words: list[bytes]) -> np.ndarray:
        k = word_buckets(words)
        return inputs(self.words[k], self.seen[k], [(self.grams[b], at) for b, at in gram_buckets(words)])


def mined(net: Network, docs: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document (inputs, label) its highest windows: the highest of a toxic one, the three highest of others."""
    parts, labels = [], []
    for at in range(0, len(docs), 200):
        some = docs[at : at + 200]
        where = [(k, s) for k, (x, _) in enumerate(some) for s in window_starts(len(x))]
        x, mask = stacked([some[k][0][s : s + WINDOW] for k, s in where])
        logit = np.concatenate([logits(net, x[:, a : a + LANES], mask[:, a : a + LANES]) for a in range(0, len(where), LANES)])
        of = np.array([k for k, _ in where])
        for n in np.lexsort((-logit, of)):
            k = of[n]
            room = 1 if some[k][1] else 3
            if len(labels) >= room and all(who == (at, k) for who, _ in labels[-room:]):
                continue
            s = where[n][1]
            parts.append(some[k][0][s : s + WINDOW])
            labels.append(((at, k), some[k][1]))
    return *stacked(parts), np.array([y for _, y in labels], np.float32)


def stacked(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([np.pad(p, ((0, WINDOW - len(p)), (0, 0))) for p in parts], axis=1)
    return x, (np.arange(WINDOW)[:, None] < np.array([len(p) for p in parts])).astype(np.float32)


def train(sample: list[tuple[str, int]]) -> Model | None:
    """Fits on (text, toxic); none if a class is missing.

    The first fit takes the windows that lean most; two more take those that the last network scores highest.
    """
    lists = [tokens(t) for t, _ in sample]
    label = np.array([y for _, y in sample], np.float32)
    if not 0 < label.sum() < len(label):
        return None
    share = float(label.mean())
    seen, toxic = np.zeros((2, BUCKETS), np.float32), np.zeros((2, BUCKETS), np.float32)
    for ws, y in zip(lists, label):
        if words := list(dict.fromkeys(ws)):
            for k, buckets in enumerate((np.unique(word_buckets(words)), np.unique(np.concatenate([b for b, _ in gram_buckets(words)])))):
                seen[k, buckets] += 1
                toxic[k, buckets] += y
    docs = []
    for ws, y in zip(lists, label):
        if words := list(dict.fromkeys(ws)):
            # The document's own occurrences do not count in what it is shown.
            k, grams = word_buckets(words), gram_buckets(words)
            each = lambda kind, b: leaning(toxic[kind, b] - y, seen[kind, b] - 1, share)  # noqa: E731, B023
            x = inputs(each(0, k), seen[0, k] > 1, [(each(1, b), at) for b, at in grams])
            number = {w: n for n, w in enumerate(words)}
            docs.append((x[np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))], float(y)))
    del lists
    parts, labels = [], []
    for x, y in docs:
        starts = window_starts(len(x))
        lean = [np.sort(x[s : s + WINDOW, :2].max(1))[-3:].sum() for s in starts]
        for n in np.argsort(lean)[::-1][: 1 if y else 2]:
            parts.append(x[starts[n] : starts[n] + WINDOW])
            labels.append(y)
    net = fit(*stacked(parts), np.array(labels, np.float32))
    for _ in range(2):
        net = fit(*mined(net, docs), net=net)
    return Model(leaning(toxic[0], seen[0], share), seen[0] > 0, leaning(toxic[1], seen[1], share), net)


class Scorer:
    """Scores texts in a task; the inputs of words are remembered."""

    def __init__(self, model: Model):
        self.model, self.at, self.table, self.used = model, {}, np.zeros((1024, 6 * HIDDEN), np.float32), 0

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Rows of `table` with the words' inputs, projected for the gates of both directions."""
        if len(self.at) > MEMORY:
            self.at, self.used = {}, 0
        net, new = self.model.net, [w for w in dict.fromkeys(words) if w not in self.at]
        if new:
            x = self.model.word_inputs(new)
            while self.used + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.used : self.used + len(new)] = np.concatenate([x @ net.w[d] + net.b[d] for d in range(2)], axis=1)
            self.at.update(zip(new, range(self.used, self.used + len(new))))
            self.used += len(new)
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def windows(self, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        net, steps = self.model.net, int(lengths.max())
        at = starts[None, :] + np.minimum(np.arange(steps)[:, None], lengths[None, :] - 1)
        mask = (np.arange(steps)[:, None] < lengths).astype(np.float32)
        gathered = self.table[rows[at]]
        forward = _direction(gathered[:, :, : 3 * HIDDEN], mask, net.u[0], None)
        backward = _direction(gathered[::-1, :, 3 * HIDDEN :], mask[::-1], net.u[1], None)[::-1]
        score = forward @ net.attend[:HIDDEN] + backward @ net.attend[HIDDEN:] + (mask - 1) * 1e9
        score = np.exp(score - score.max(0))
        each = forward @ net.out[:HIDDEN] + backward @ net.out[HIDDEN:]
        return _sigmoid((score * each).sum(0) / score.sum(0) + net.bias[0])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """The greatest window score of each text; 0 for a text without words."""
        out = np.zeros(len(texts))
        doc, starts, lengths, words = [], [], [], []

        def flush() -> None:
            if doc:
                rows = self.rows(words)
                d, s, n = np.array(doc), np.array(starts), np.array(lengths)
                for at in range(0, len(d), LANES):
                    part = slice(at, at + LANES)
                    np.maximum.at(out, d[part], self.windows(rows, s[part], n[part]))
            for x in (doc, starts, lengths, words):
                x.clear()

        for k, text in enumerate(texts):
            ws = tokens(text)
            if not ws:
                continue
            begin = window_starts(len(ws))
            doc += [k] * len(begin)
            starts += [len(words) + b for b in begin]
            lengths += [min(WINDOW, len(ws))] * len(begin)
            words += ws
            if len(doc) >= LANES:
                flush()
        flush()
        return out


def training_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """Up to SAMPLE labelled documents of each class, by a hash of the id: rows whose crc32(doc_id) mod 3 is not 1."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y"))
    rows = rows.groupBy("id").agg(F.max("y").alias("y")).where(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(3)) != 1)
    order = F.xxhash64(F.col("id"), F.lit("toxicity"))
    ids = rows.where("y = 1").orderBy(order).limit(SAMPLE[1]).union(rows.where("y = 0").orderBy(order).limit(SAMPLE[0]))
    got = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids), "id").select("id", "text", "y").collect()
    return [(r.text or "", r.y) for r in sorted(got, key=lambda r: (r.id, r.text or ""))]


def score_toxicity(docs: DataFrame, model: Model | None, text: str = "text", column: str = "score") -> DataFrame:
    """`docs` with `column`: 0 to 1, higher where the text is likelier toxic; it replaces a column of that name.

    Null and empty texts, texts without words and all texts under no model get 0. Whole texts are scored, all
    windows of them; every row gets its score, repeated rows the same.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(column)
    schema = docs.select("*").schema.add(column, "double")
    at = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(held.value) if held.value else None
        for batch in batches:
            texts = batch.column(at).to_pylist()
            scores = scorer(texts) if scorer else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(training_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
