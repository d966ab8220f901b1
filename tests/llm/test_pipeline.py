"""The stages in order, each against what its operator says of its own input."""

import corpus_pipeline
from flowlab.llm import jaccard_bayes, quality_crf, secret_lexer, suffix_dcx
from flowlab.session import materialise
from flowlab.sources.tables import table


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        after = materialise(stage(spark, docs, data), "stage")
        if name != "packing":
            assert after.columns == inputs["quality rules"].columns
        docs = after
    model = quality_crf.fit(inputs["quality rules"], table(spark, data, "labels"))
    assert ids(inputs["n-gram Jaccard join"]) == ids(quality_crf.rate(inputs["quality rules"], model).where("kept"))
    assert ids(inputs["suffix-array dedup"]) == ids(jaccard_bayes.join_similar(inputs["n-gram Jaccard join"]).where("class_id = doc_id"))
    left = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dcx.repeats(inputs["suffix-array dedup"]).collect()}
    stripped = {r.doc_id: len(r.text.encode()) for r in inputs["secret scans"].collect()}
    assert set(stripped) == {d for d, n in left.items() if n}
    # Bytes of cut characters go as well.
    assert all(left[d] - 12 <= n <= left[d] for d, n in stripped.items())
    assert {r.doc_id: r.text for r in inputs["packing"].collect()} == {r.doc_id: secret_lexer.masked(r.text) for r in inputs["secret scans"].collect()}
    tokens = {r.doc_id: r.n for r in docs.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert tokens == {r.doc_id: r.doc_tokens for r in docs.collect()}


def test_run_is_registered(spark, data):
    from flowlab.plans.catalog.registry import QUERIES

    assert QUERIES["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "secret scans", "packing"]
