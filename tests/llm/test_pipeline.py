import re
from collections import Counter

import corpus_pipeline
from bitstrata.llm import queries
from test_operators import library, shingle_set, union, words

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = queries.table(spark, SF, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns
        rows, was = {r.doc_id: r.text for r in kept.collect()}, {r.doc_id: r.text for r in before.collect()}
        if name == "near_dedup":
            sets = {i: shingle_set(t) for i, t in was.items()}
            ids = list(sets)
            links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            own = union(links, ids)
            assert set(rows) == {i for i in ids if own[i] == i}
        if name == "decontaminate":
            items = [shingle_set(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
            assert set(rows) == {i for i, t in was.items() if not any(len(s & shingle_set(t)) >= 0.8 * len(s) for s in items)}
        if name == "language_id":
            assert {i for i, t in was.items() if re.search(r"[^\W\d_]", t)} - set(rows) == set()
        if name == "mixing":
            assert set(rows) == set(was)
    out = corpus_pipeline.STAGES[-1][1](spark, kept, SF).orderBy("start").collect()
    texts = {r.doc_id: r.text for r in kept.collect()}
    sizes = {i: len(ids) + 1 for i, ids in zip(texts, library("word_bpe_49k.json", list(texts.values())), strict=True)}
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in kept.collect())
    at = 0
    for r in out:
        assert (r.start, r.n_tokens) == (at, sizes[r.doc_id])
        at += r.n_tokens
    assert corpus_pipeline.run(spark, SF).count() == len(out) and words("A b") == [b"a", b"b"]
