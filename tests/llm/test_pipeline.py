"""The pipeline's stages, one after another, on the smallest table."""

import corpus_pipeline
from tidemark.llm import toxicity
from tidemark.llm.common import Scratch, documents

import brute


def test_stages(spark, tiny):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]
    docs, scratch, seen = documents(spark, tiny), Scratch(spark, "t"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = scratch.write(stage(spark, docs, tiny), name)
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= set(before) and (docs.columns == columns or name == names[-1])
        seen[name] = (before, after)
    before, after = seen["exact_dedup"]
    assert after == {i for i, (_, _, kept, _) in brute.exact(list(before.items())).items() if kept}
    before, after = seen["simhash_near_dedup"]
    shingles = lambda t: {tuple(brute.lower(t).split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    for gone in set(before) - after:
        mine = shingles(before[gone])
        assert any(len(mine & s) >= 0.8 * len(mine | s) for i, t in before.items() if i != gone for s in [shingles(t)])
    before, after = seen["sentencepiece"]
    assert after == set(before)


def test_toxic_documents_go(spark, tiny):
    docs = documents(spark, tiny)
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, tiny).collect()}
    model = toxicity.train(toxicity.training_sample(docs, labels))
    scores = toxicity.Scorer(model)
    for r in docs.collect():
        assert (r.doc_id in kept) == (scores([r.text])[0] < toxicity.THRESHOLD)
