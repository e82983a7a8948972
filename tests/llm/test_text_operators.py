"""The text operators against brute force, on hard cases and on held-out documents."""

import hashlib
import random
import unicodedata
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from tidemark.llm import common, components, exact_dedup, fingerprints, fm_index, html_extract, language_id, mixing, near_copies, queries, range_coder, sentencepiece_codec, simhash, substring_dedup, token_files, toxicity

HARD = [None, "", " \t\n", "a", "A b\x0bc", "x " * 5000, "é" + "é" * 3 + "　z", "\x00\x1f\x85", "🙂 " * 30, "repeat these words again and again " * 20]


def frame(spark, texts, first=0, **extra):
    """`documents` with extra columns."""
    rows = [(first + k, t, "en", f"s{k % 3}", len(t or ""), *(v for v in extra.values())) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, brute.DOCS + "".join(f", {c} string" for c in extra))


@pytest.fixture(scope="module")
def tiny_docs(tiny):
    return duckdb.sql(f"SELECT doc_id, text FROM '{tiny}/documents.parquet'").fetchall()


def corpus(n=60, seed=3):
    """Texts that share passages, copies and near copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    shared = [" ".join(word() for _ in range(rng.randint(18, 45))) for _ in range(4)]
    out = []
    for k in range(n):
        text = " ".join(word() for _ in range(rng.randint(0, 60)))
        if k % 2:
            text += " " + rng.choice(shared) + " " + " ".join(word() for _ in range(rng.randint(0, 25)))
        if k % 7 == 0 and out:
            text = rng.choice(out)
        if k % 11 == 0 and out:
            words = rng.choice(out).split()
            text = " ".join(words[: len(words) // 2] + ["new"] + words[len(words) // 2 :])
        out.append(text)
    return out


# exact deduplication


def index(spark, tmp_path, name="index", buckets=4):
    return exact_dedup.DigestIndex(spark, f"file://{tmp_path}/{name}", buckets)


def test_exact_matches_brute_force(spark, tmp_path):
    docs = list(enumerate(HARD + HARD[::-1] + ["Same", "sAME", "ÉA", "éa"]))
    got = exact_dedup.exact_dedup(frame(spark, [t for _, t in docs], keep_id="x", digest="y"), index(spark, tmp_path), "one").collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == brute.exact(docs)


def test_exact_index_outlives_batches(spark, tmp_path):
    first, second = frame(spark, ["a", "b", "b"]), frame(spark, ["B", "c", "c"], first=10)
    exact_dedup.exact_dedup(first, index(spark, tmp_path), "one").collect()
    for _ in range(2):  # running a batch again changes nothing
        again = index(spark, tmp_path, buckets=99)
        assert again.buckets == 4
        got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(second, again, "two").collect()}
        assert got == {10: (2, False), 11: (12, False), 12: (12, True)}
        assert again.entries().count() == 3
    assert "left_anti" and "SortMergeJoin" in again.absent(second.select(F.col("text").alias("digest")), "x")._jdf.queryExecution().toString()


def test_exact_drop_and_empty(spark, tmp_path):
    docs = frame(spark, ["a", "A", "b", None, ""]).union(frame(spark, ["c", "c"], first=7).where("doc_id = 7")).union(frame(spark, ["c"], first=7))
    kept = exact_dedup.drop_copies(docs, index(spark, tmp_path), "one")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 7] and kept.columns == docs.columns
    assert exact_dedup.exact_dedup(docs.limit(0), index(spark, tmp_path, "other"), "one").count() == 0


# substring deduplication


def test_substring_matches_brute_force(spark):
    docs = list(enumerate(corpus() + HARD + ["w " * 100, "a b " * 60]))
    got = substring_dedup.substring_dedup(frame(spark, [t for _, t in docs], row="r", spans="s")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept)) for r in got} == brute.substring(docs)


def test_substring_hot_minimisers_are_exact(spark):
    docs = [(k, t) for k, t in enumerate(corpus(40, 5))]
    plain = frame(spark, [t for _, t in docs]).select(F.col("doc_id").alias("row"), "doc_id", "text")
    spans = lambda hot: {(r.row, s.start + k) for r in substring_dedup.repeated_spans(plain, common.Scratch(spark, "t"), hot=hot).collect() for s in r.spans for k in range(s.n)}
    assert spans(1) == spans(1000) and spans(1)


def test_substring_repeated_ids_and_empty(spark):
    text = " ".join(map(str, range(30)))
    docs = frame(spark, [text]).union(frame(spark, [text])).union(frame(spark, ["other " + text], first=5))
    got = sorted((r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == [(0, 0), (0, 0), (5, 30)]
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def test_fm_index_matching_statistics():
    rng = np.random.default_rng(1)
    lists = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(20)]
    index = fm_index.FMIndex(np.concatenate(lists), np.array([len(x) for x in lists]), 4)
    text = index.text.tolist()
    ends = np.flatnonzero(index.text)
    length, low, high = index.matching(ends, 5)
    for end, n, a, b in zip(ends.tolist(), length.tolist(), low.tolist(), high.tolist()):
        best = 0
        for m in range(1, 6):
            part = text[end - m + 1 : end + 1] if end >= m - 1 else [0]
            if len(part) < m or 0 in part or sum(text[k : k + m] == part for k in range(len(text))) < 2:
                break
            best = m
        assert n == best
        if best == 5:
            places = [k for k in range(len(text)) if text[k : k + 5] == text[end - 4 : end + 1]]
            assert b - a == len(places) and index.first_place(np.array([a]), np.array([b]))[0] == places[0]


# simhash


def test_simhash_matches_brute_force(spark, tiny_docs):
    docs = tiny_docs[:80] + [(1000 + k, t) for k, t in enumerate(HARD + corpus(40, 9))]
    df = spark.createDataFrame([(i, t, "c", "x") for i, t in docs], "doc_id long, text string, component string, fp string")
    got = {r.doc_id: (f"{r.fp % (1 << 64):016x}", r.component_id) for r in simhash.simhash_near_dedup(df).collect()}
    assert got == brute.near(docs)


def test_pigeonring_keeps_all_links():
    rng = np.random.default_rng(2)
    differing = np.array([sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in rng.integers(0, 5, 2000)], np.uint64)
    for segments in (5, 7, 9):
        assert simhash.pigeonring(differing, 4, segments).all()
    far = np.array([(1 << 64) - 1], np.uint64)
    assert not simhash.pigeonring(far, 4, 7)[0]


def test_simhash_blocks_lose_no_link(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)}
    rows = [(k, f - (1 << 64) if f >= 1 << 63 else f) for k, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    whole, cut = ({r.fp: r.component_id for r in simhash.near_components(df, common.Scratch(spark, "t"), block=b).collect()} for b in (512, 8))
    assert whole == cut and len(whole) == len(rows)


def test_near_copies_keep_one_of_each_group(spark):
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 9999)}" for _ in range(400)]
    near = words[:200] + ["changed"] + words[201:]
    other = [f"v{rng.randint(0, 9999)}" for _ in range(400)]
    docs = frame(spark, [" ".join(other), " ".join(words), " ".join(near), " ".join(words[:100]), None, ""], extra="e")
    kept = near_copies.drop_near_copies(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3, 4] and kept.columns == docs.columns
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0
    again = near_copies.drop_near_copies(docs.union(docs).union(docs).withColumn("node", F.lit(1)).withColumn("fp", F.lit("x")))
    assert sorted(r.doc_id for r in again.collect()) == [0, 1, 3, 4]
    assert simhash.simhash_near_dedup(docs.limit(0)).count() == 0


def jaccard_survivors(texts, n, similarity):
    """Places of the texts that stay, by comparing all pairs."""
    words = [brute.lower(t).split() for t in texts]
    sets = [{tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} for w in words]
    low = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if low[a] != low[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((low[a], low[b]))
                low = [x if v == y else v for v in low]
    return [k for k in range(len(texts)) if low[k] == k]


def varied(rng, words, changes):
    out = list(words)
    for k in rng.sample(range(len(out)), changes):
        out[k] = f"c{rng.randint(0, 10**9)}"
    return " ".join(out)


def test_near_copies_at_the_threshold_with_the_pipelines_parameters(spark):
    import corpus_pipeline

    rng = random.Random(5)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(6, 400))]
        texts += [" ".join(words), varied(rng, words, max(1, len(words) // 50))]
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame(spark, texts), "").collect())
    assert len(kept) < 100 and kept == jaccard_survivors(texts, corpus_pipeline.SHINGLE, corpus_pipeline.SIMILARITY)


def test_large_groups_around_the_threshold_leave_no_surplus(spark):
    import corpus_pipeline

    rng = random.Random(6)
    texts = []
    for _ in range(2):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
        texts += [varied(rng, words, rng.choice([3, 4, 4, 5, 6])) for _ in range(150)]
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame(spark, texts), "").collect())
    want = jaccard_survivors(texts, corpus_pipeline.SHINGLE, corpus_pipeline.SIMILARITY)
    assert 2 < len(want) < len(texts) and kept == want


def test_pairs_compared_of_a_large_group_below_the_threshold(spark, monkeypatch):
    rng, seen, write = random.Random(7), {}, common.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        seen[name] = out.count() if name == "more" else -1
        return out

    monkeypatch.setattr(common.Scratch, "write", counted)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    # All but one in fifty of 400 have more changes than two similar ones may have between them.
    texts = [varied(rng, words, 1 if k % 50 == 0 else rng.choice([5, 6, 7])) for k in range(400)]
    kept = sorted(r.doc_id for r in near_copies.drop_near_copies(frame(spark, texts)).collect())
    assert kept == jaccard_survivors(texts, 5, 0.8) and len(kept) > 300
    assert seen["more"] < 10 * len(texts)


def test_rows_of_pairs_stay_few_where_a_group_shares_keys(spark, monkeypatch):
    rng, seen, write = random.Random(10), {}, common.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        seen[name] = out.count() if name in ("candidates", "more") else -1
        return out

    monkeypatch.setattr(common.Scratch, "write", counted)
    # The same words in other orders have one fingerprint, and hardly a shingle in common; every fourth text has a near copy.
    words, texts = [f"w{rng.randint(0, 10**6)}" for _ in range(120)], []
    for k in range(40):
        rng.shuffle(words)
        texts += [" ".join(words)] if k % 4 else [" ".join(words), " ".join(words[:-1])]
    kept = sorted(r.doc_id for r in near_copies.drop_near_copies(frame(spark, texts)).collect())
    assert kept == jaccard_survivors(texts, 5, 0.8) and len(kept) == 40
    pairs = len(texts) * (len(texts) - 1) // 2
    assert seen["candidates"] < pairs // 3 and seen["more"] <= len(texts)


def test_rare_shingles_find_every_similar_pair(spark):
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    texts = [varied(rng, words[rng.randint(0, 8) : rng.randint(100, 120)], rng.randint(0, 4)) for _ in range(80)] + ["", "a b", "a b c d e", None]
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "node long, comp long, text string")
    scratch = common.Scratch(spark, "t")
    found = {(r.a, r.b) for r in near_copies.sharing(scratch.write(near_copies.prefixes(rows, 5, 0.8, scratch), "rare"), 0.8).collect()}
    sets = [near_copies.shingles(t, 5) for t in texts]
    want = {(a, b) for b in range(len(texts)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want and want <= found


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(-60, 60)] + [(500, 501), (501, 501)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges, common.Scratch(spark, "t")).collect()}
    assert got == {k: -60 for k in range(-60, 61)} | {500: 500, 501: 500}
    assert components.components(edges.limit(0), common.Scratch(spark, "t")).count() == 0


# fingerprints


def canon(t):
    import re

    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", t).upper().lower()).strip()


def test_fingerprints(spark):
    texts = ["Straße  X", "STRASSE x", "é a", "É A", "plain", None, "", "plain", "long " * 3000]
    got = {r.doc_id: r for r in fingerprints.document_fingerprints(frame(spark, texts, fp="f", canon="c")).collect()}
    for k, t in enumerate(texts):
        t, nxt = t or "", texts[(k + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[k].edited_sha256 == brute.sha(edited) and got[k].n_chars == len(t)
        assert (got[k].near_next, got[k].near_edited) == (float(canon(t) == canon(nxt)), float(canon(t) == canon(edited)))
        for j, u in enumerate(texts):
            assert (got[k].fingerprint == got[j].fingerprint) == (canon(t) == canon(u or ""))
    assert fingerprints.document_fingerprints(frame(spark, texts).limit(0)).count() == 0
    plan = fingerprints.document_fingerprints(frame(spark, texts))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_colliding_digests_are_told_apart_by_bytes(spark):
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(2)).cast("string")
    texts = ["a", "b", "c", "A", "d", "e"]
    got = {r.doc_id: r.fingerprint for r in fingerprints.document_fingerprints(frame(spark, texts), digest=weak).collect()}
    assert got[0] == got[3] and len(set(got.values())) == 5


def test_next_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 2)
    ids = [5, 6, 90, 91, 1000, 1001, 1002, 7000]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "null")], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(df, ["text"]).collect()}
    order = [None, *ids]
    assert got == {a: "null" if b is None else f"t{b}" for a, b in zip(order, order[1:] + order[:1])}


# language identification


def test_language_on_held_out_documents(spark, tiny):
    got = language_id.op9_language_id(spark, tiny)
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) > 20
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got.collect())


def test_language_hard_cases(spark):
    train = spark.createDataFrame([("xx", "foo bar baz " * 5), ("yy", "quux zyzzy " * 5), ("yy", None)], "lang string, text string")
    learned = language_id.prototypes(train)
    assert learned[0] == ["xx", "yy"]
    docs = frame(spark, [*HARD, "foo bar", "zyzzy"], lang_pred="taken")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, *learned).collect()}
    assert got[len(HARD)][0] == "xx" and got[len(HARD) + 1][0] == "yy"
    assert all(got[k] == ("und", 0.0) for k in (0, 1, 2, 7, 8))
    none = language_id.prototypes(train.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, *none).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), *learned).count() == 0


def test_bundles_match_a_plain_sum():
    first, second, third = language_id.letter_vectors()
    classes = language_id.letter_classes()
    marked = [classes[ord(c)] for c in " ab c "]
    want = sum(first[a] * second[b] * third[c] for a, b, c in zip(marked, marked[1:], marked[2:]) if b)
    assert (language_id.bundles(["ab .c"])[0] == want).all()


# toxicity


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.fresh(rng)
    for p in net.parameters():
        p[...] = rng.normal(size=p.shape) * 0.5
    x, mask = rng.normal(size=(6, 4, toxicity.FEATURES)).astype(np.float32), np.ones((6, 4), np.float32)
    mask[4:, 1] = 0
    label, weight = np.array([1, 0, 1, 0], np.float32), np.array([1, 2, 1, 1], np.float32)
    _, grads = toxicity.gradients(net, x, mask, label, weight)
    for p, g in zip(net.parameters(), grads):
        flat = p.reshape(-1)
        k = int(rng.integers(len(flat)))
        old, h = flat[k], 1e-2
        flat[k] = old + h
        up, _ = toxicity.gradients(net, x, mask, label, weight)
        flat[k] = old - h
        down, _ = toxicity.gradients(net, x, mask, label, weight)
        flat[k] = old
        assert abs((up - down) / (2 * h) - g.reshape(-1)[k]) < 2e-3


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    plain = [" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)) for _ in range(300)]
    sample = []
    for k, t in enumerate(plain):
        words = t.split()
        if k % 4 == 0:
            for at in (10, 30, 50):
                words[at] = rng.choice(["zorkish", "zorkum", "zorkly", "vuxling", "vuxer"])
        sample.append((" ".join(words), int(k % 4 == 0)))
    return toxicity.train(sample)


def test_toxicity_learns_words_and_stems(model):
    score = toxicity.Scorer(model)
    clean = "abcd efgh hgfe dcba " * 50
    got = score([clean, clean + "zorkum vuxer zorkly", clean + "zorkette vuxous zorkify " + clean, "", None])
    assert got[0] < 0.5 < toxicity.THRESHOLD <= got[1] and got[2] > got[0] and got[3] == got[4] == 0


def test_toxicity_scores_all_windows(model):
    score = toxicity.Scorer(model)
    clean = ["abcd", "efgh", "hgfe", "dcba"] * 400
    base = score([" ".join(clean)])[0]
    for at in (0, 700, 1597):
        words = list(clean)
        words[at : at + 3] = ["zorkum", "vuxer", "zorkly"]
        assert score([" ".join(words)])[0] > max(base, 0.5)
    assert [toxicity.window_starts(n)[-1] for n in (1, 32, 33, 100)] == [0, 0, 1, 68]


def test_toxicity_hard_cases(spark, model):
    docs = frame(spark, HARD, score="taken")
    got = toxicity.score_toxicity(docs, model)
    assert got.count() == len(HARD) and got.columns[-1] == "score" and dict(got.dtypes)["score"] == "double"
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}
    assert toxicity.train([]) is None and toxicity.train([("a", 1)]) is None


# html


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head><body>
<nav><ul><li>menu</ul></nav><div class="cookie-notice">cookies</div><article class="post"><header><h1>Head &amp; more</h1><p class="byline">by me</p></header>
<p>One  <b>bold</b>
text<br>next<p>Two &eacute;&#233;&nbsp;end<ul><li>a<li>b</ul><div class="share">share</div><aside>side</aside><form><input>form</form><!-- no -->
<section class="comments"><article class="comment">a reader's long, long comment that is longer than the article itself, so that it would be taken first</article></section></article><footer>foot</footer></body></html>"""


def test_html_rules():
    assert html_extract.main_text(PAGE) == "Head & more\nOne bold text next\nTwo éé end\na\nb"
    assert html_extract.main_text("<p>a<p>b") == "a\nb" and html_extract.main_text("plain") == "plain"
    for odd in (None, "", "<", "<p", "<a href='", "</p>", "<!--", "<script>x", "&amp", "<div>" * 5000 + "deep" + "</b>" * 5000):
        assert isinstance(html_extract.main_text(odd), str)
    assert html_extract.main_text("<div>" * 5000 + "deep") == "deep"


def test_html_templates(spark):
    box = '<div><div class="k7">Read our other stories today</div></div>'
    pages = [(k, f"http://site.example/{k}", f"<body>{box}<article><p>text {k}</p><p>every page says this</p>{box}</article></body>") for k in range(8)]
    pages += [(100 + k, f"http://few.example/{k}", f"<body><article><p>t</p>{box}</article></body>") for k in range(2)]
    pages += [(200, None, None), (201, "", ""), (202, "not a url", "<p>x</p>")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract_pages(df).collect()}
    assert got[3] == "text 3\nevery page says this" and got[100] == "t\nRead our other stories today"
    assert (got[200], got[201], got[202]) == ("", "", "x")
    assert html_extract.extract_pages(df.limit(0)).count() == 0


# token files


def site(n, page):
    return [(k, f"https://h.example/{k}", page(k)) for k in range(n)]


def extracted(spark, rows):
    return {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_templates_of_a_site_go(spark):
    # No tag, role or class gives these away: a notice that recurs, and a menu whose words change from page to page.
    menu = lambda k: "".join(f"<li><a href='/{k}{j}'>go{k}-{j}</a></li>" for j in range(3 + k % 4))
    page = lambda k: f"<body><div><ul>{menu(k)}</ul></div><div>All rights kept</div><div><h1>Head {k}</h1><p>Text {k}</p><p>more</p></div></body>"
    assert extracted(spark, site(12, page)) == {k: f"Head {k}\nText {k}" for k in range(12)}
    few = extracted(spark, site(3, page))
    assert all("All rights kept" in t and "more" in t for t in few.values())


def test_templates_of_a_section_go_on_a_large_host(spark):
    page = lambda k: f"<body>{'<div>Section note</div>' if k < 10 else ''}<div><p>Text {k}</p></div></body>"
    assert extracted(spark, site(100, page)) == {k: f"Text {k}" for k in range(100)}


def test_copies_of_a_page_keep_their_text(spark):
    for wrap in ("<article><h1>T</h1><div><p>real text</p></div></article>", "<body><div><h1>T</h1><div><p>real text</p></div></div></body>"):
        assert set(extracted(spark, site(20, lambda k: wrap)).values()) == {"T\nreal text"}  # noqa: B023


def test_several_articles_stay_in_page_order():
    assert html_extract.main_text("<article><p>one</p></article><nav>x</nav><article><p>two, longer</p></article>") == "one\ntwo, longer"


def test_range_coder_round_trip():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 65536, range_coder.BLOCK), rng.integers(0, 3, 700), np.zeros(range_coder.BLOCK, int), np.zeros(0, int), np.array([65535]), rng.zipf(1.3, range_coder.BLOCK) % 5000]
    coded = range_coder.encode(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(range_coder.decode(coded, [len(b) for b in blocks]), blocks))
    assert [range_coder.encode([b])[0] for b in blocks] == coded  # a block does not depend on its neighbours
    assert len(coded[2]) < 40 and len(coded[5]) < 2 * len(blocks[5])


def test_frames_tell_damage():
    ids = np.arange(5000) % 700
    frame_ = token_files.pack([3, None], [4000, 1000], ids)
    docs, counts, back = token_files.unpack(frame_)
    assert docs == [3, None] and counts.tolist() == [4000, 1000] and (back == ids).all()
    for at in (0, 30, len(frame_) - 5):
        broken = bytearray(frame_)
        broken[at] ^= 255
        with pytest.raises(token_files.DamagedFrame):
            token_files.unpack(bytes(broken))
    with pytest.raises(token_files.DamagedFrame):
        token_files.unpack(frame_[:-1])


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = [*HARD, "It's <|endoftext|> a\x1ctest", "日本語 ÀB"]
    data = token_files.tokenizer_text()
    plain = Tokenizer.from_str(data)
    plain.encode_special_tokens = True
    docs = frame(spark, texts, start="s", frame="f").repartition(3)
    token_files.write_tokens(docs, data, f"file://{tmp_path}/t")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(spark, f"file://{tmp_path}/t").collect()}
    start = 0
    for k, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        assert got[k] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    token_files.write_tokens(docs.limit(0), data, f"file://{tmp_path}/none")
    assert token_files.read_tokens(spark, f"file://{tmp_path}/none").count() == 0


# sentencepiece


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(sentencepiece_codec.model_bytes())


def test_sentencepiece_parity(codec, tiny_docs):
    texts = [t for _, t in tiny_docs] + HARD + ["<s>a</s><unk><0x0A>", "▁a ▁ b", "ﬁ １２", "日本語🙂"]
    ids = codec.encode(texts)
    assert ids == codec.reference.encode([t or "" for t in texts])
    assert [codec.decode(i) for i in ids] == codec.reference.decode(ids)
    assert all(codec.decode(i) == t for i, t in zip(ids, texts) if t and "▁" not in t)


def test_sentencepiece_unigram_parity():
    """A unigram model written by hand in the model format."""
    import struct

    import sentencepiece

    def field(n, kind, data):
        return bytes([n << 3 | kind]) + data

    def piece(text, score, kind):
        body = field(1, 2, bytes([len(text.encode())]) + text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        return field(1, 2, bytes([len(body)]) + body)

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.0, 1), ("a", -2.5, 1), ("b", -2.7, 1), ("ab", -3.1, 1), ("▁ab", -3.3, 1), ("ba", -4.0, 1)]
    data = b"".join(piece(*p) for p in pieces) + field(2, 2, bytes([2]) + field(3, 0, bytes([1])))
    codec = sentencepiece_codec.Codec(data)
    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    for t in ("ab ab", "abba  b a", "", "b", " aab "):
        assert codec.encode([t])[0] == reference.encode(t), t


def test_sentencepiece_operator(spark):
    docs = frame(spark, HARD, ids="i", decoded="d")
    got = {r.doc_id: r for r in sentencepiece_codec.encode_documents(docs, sentencepiece_codec.model_bytes(), parity_every=1).collect()}
    assert all(got[k].decoded == (t or "") and got[k].parity and got[k].checked for k, t in enumerate(HARD))
    assert sentencepiece_codec.digests(sentencepiece_codec.encode_documents(docs.limit(0), sentencepiece_codec.model_bytes())).count() == 0


def test_sentencepiece_compares_every_text(spark):
    texts = [f"word{k} Zebra{k} and {k}" for k in range(450)] + HARD
    docs = frame(spark, texts, ids="i", decoded="d").coalesce(1)
    got = {r.doc_id: r for r in sentencepiece_codec.encode_documents(docs, sentencepiece_codec.model_bytes()).collect()}
    assert all(got[k].checked and got[k].parity and got[k].decoded == (t or "") for k, t in enumerate(texts))


def test_sentencepiece_takes_the_librarys_ids_where_a_chunk_differs():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_bytes())
    want = [codec.reference.encode(t or "") for t in HARD]
    texts = HARD + ["a  b ", " ", "  ", "▁a ▁ b", None, "plain words"]
    ids, ends, agree = codec.encode_column(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want + [codec.reference.encode(t or "") for t in texts[len(HARD) :]] and agree.all()
    assert codec.decode_column(ids, ends).to_pylist() == [codec.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])]
    lone = np.array([codec.reference.piece_to_id("<0xFF>")], np.int32)  # no UTF-8
    assert codec.decode_column(np.r_[ids, lone], np.r_[ends, ends[-1] + 1]).to_pylist()[-1] == codec.decode(lone.tolist())

    class Wrong:
        """The tokenizer, but for one word."""

        def __init__(self, right):
            self.right = right

        def encode_batch_fast(self, texts, **options):
            return self.right.encode_batch_fast([t.replace("plain", "plane") for t in texts], **options)

    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_bytes())
    codec.tokens = Wrong(codec.tokens)
    texts = ["other words"] * 199 + ["plain words", "words"]
    ids, ends, agree = codec.encode_column(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == codec.reference.encode(texts)
    assert agree.tolist() == [True] * 199 + [False, True]


# mixing


def test_raking_matches_numpy(spark):
    rng = random.Random(2)
    texts = [" ".join("w" for _ in range(rng.randint(1, 900))) for _ in range(200)] + [None, ""]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, brute.DOCS)
    got = mixing.mix(docs, budget=0.5).collect()
    total = sum(r.mix_tokens for r in got)
    for margin, power in mixing.POWERS.items():
        name = lambda r: (r.mix_topic if margin == "topic" else r[margin] or mixing.UNNAMED)  # noqa: B023, E731
        have, want = {}, {}
        for r in got:
            have[name(r)] = have.get(name(r), 0) + r.mix_tokens * r.mix_weight / total
            want[name(r)] = want.get(name(r), 0) + r.mix_tokens
        whole = sum(v**power for v in want.values() if v)
        for k, v in want.items():
            if v:
                assert abs(have[k] - v**power / whole) < 5e-3 * v**power / whole
    assert abs(sum(r.mix_tokens * r.mix_probability for r in got) / total - 0.5) < 1e-3
    assert all(0 <= r.mix_probability <= 1 for r in got)


def test_drawn_margins_hold_under_the_cap(spark):
    rng = random.Random(4)
    texts = [" ".join("w" for _ in range(rng.randint(1, 900))) for _ in range(400)]
    rows = [(k, t, rng.choice(["en", "en", "de", "fr"]), rng.choice("aaaaaabbbc"), 0) for k, t in enumerate(texts)]
    got = mixing.mix(spark.createDataFrame(rows, brute.DOCS), budget=0.8).collect()
    total = sum(r.mix_tokens for r in got)
    assert sum(r.mix_probability == 1 for r in got) > 20
    for margin, power in mixing.POWERS.items():
        mass, have = {}, {}
        for r in got:
            name = r.mix_topic if margin == "topic" else r[margin]
            mass[name] = mass.get(name, 0) + r.mix_tokens
            have[name] = have.get(name, 0) + r.mix_tokens * r.mix_probability
        low, high = 0.0, 1e9
        for _ in range(200):  # the scale at which the capped targets make up the budget
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(m, mid * m**power) for m in mass.values()) < 0.8 * total else (low, mid)
        for name, m in mass.items():
            assert have[name] == pytest.approx(min(m, high * m**power), rel=0.01)


def test_mixing_without_source_and_language(spark):
    docs = frame(spark, ["one two three"] * 6).drop("source", "lang")
    assert all(r.mix_probability == pytest.approx(0.4) for r in mixing.mix(docs, budget=0.4).collect())


def test_mixing_targets_and_edges(spark):
    docs = frame(spark, ["one two three"] * 6, mix_weight="w")
    targets = {"source": spark.createDataFrame([("s0", 0.5), ("s1", 0.5)], "name string, share double")}
    got = mixing.mix(docs, targets=targets, budget=0.4).collect()
    weight = {r.source: r.mix_weight for r in got}
    assert weight["s2"] == 0 and weight["s0"] == pytest.approx(1.5)
    assert all(not r.mix_drawn for r in got if r.source == "s2")
    again = mixing.mix(docs, targets=targets, budget=0.4).collect()
    assert sorted((r.doc_id, r.mix_drawn) for r in got) == sorted((r.doc_id, r.mix_drawn) for r in again)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert all(r.mix_drawn for r in mixing.mix(frame(spark, [None, ""])).collect())


# registered queries


def test_registered_sql(spark, tiny):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    for name, sql in queries.ORACLE.items():
        df = queries.QUERIES[name](spark, tiny)
        names = sorted(df.columns)
        out = con.sql(sql)
        at = [out.columns.index(c) for c in names]
        assert sorted(map(tuple, df.select(*names).collect())) == sorted(tuple(r[k] for k in at) for r in out.fetchall())


def test_all_ten_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}


def test_ids_beyond_the_coders_width_are_refused():
    with pytest.raises(ValueError):
        range_coder.encode([np.array([70000, 3])])


def test_digest_of_ids_is_little_endian():
    table = pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
    assert table.num_rows == 1 and zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")
