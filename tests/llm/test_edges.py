"""Hard cases of the training-data operators: names, empty tables, sizes, partitions."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bitstrata.llm import decontaminate, language_id, license_scan, queries, scratch
from bitstrata.llm.decontaminate import contaminated
from bitstrata.llm.lattice_lm import DISCOUNT, FIRST_END, lattice_scores, load_pieces
from bitstrata.llm.license_scan import scan, size_class
from bitstrata.llm.line_dedup import deduplicated_lines
from bitstrata.llm.mixing import mix, mixed
from bitstrata.llm.names import fresh
from bitstrata.llm.near_dedup import deduplicated, near_duplicates
from bitstrata.llm.token_counts import token_counts
from bitstrata.llm.topk_search import LARGEST, top_k

SF = "/root/testdata/sf0.001"
NAMES = ["score", "lang_pred", "rejected", "hits", "repeats", "h", "id_2", "h_2", "copy", "place", "gone", "node", "n", "text_", "__id", "a", "b", "line", "g", "n_tokens", "start", "component"]


@pytest.fixture(scope="module")
def named(spark):
    """Real documents with columns called as the operators call their own."""
    docs = queries.table(spark, SF, "documents")
    return docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in NAMES})


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_of_any_name(spark, named, k):
    _, stage = corpus_pipeline.STAGES[k]
    plain, out = stage(spark, named.select("doc_id", "text", "lang", "source", "n_chars"), SF), stage(spark, named, SF)
    assert out.columns == named.columns
    assert rows_of(out.select(plain.columns)) == rows_of(plain)
    assert out.filter(F.col("hits") != F.concat(F.lit("hits"), F.col("doc_id").cast("string"))).count() == 0


def test_last_stage_with_columns_of_any_name(spark, named):
    out = corpus_pipeline.STAGES[-1][1](spark, named, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == named.count()


@pytest.mark.parametrize("k", range(5))
def test_stages_of_an_empty_table(spark, named, k):
    out = corpus_pipeline.STAGES[k][1](spark, named.limit(0), SF)
    assert out.count() == 0 and (k == 4 or out.columns == named.columns)


@pytest.mark.parametrize("k", range(5))
def test_stages_of_nulls_and_repeats(spark, named, k):
    """Nulls in every column, an empty and a very long text, repeated rows."""
    docs = named.select("doc_id", "text", "lang", "source", "n_chars").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "ein Text ohne Nummer und Quelle", None, None, None), (10**9, None, "de", None, 0), (10**9 + 1, "", None, "s", None), (10**9 + 2, "word " * 300_000, "en", None, None), (10**9 + 2, "word " * 300_000, "en", None, None)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(3))
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    n = {0: lambda x: x, 3: lambda x: x, 4: lambda x: x}.get(k)
    assert out.count() > 30 and (n is None or k == 3 or out.count() <= docs.count())


def test_empty_tables(spark, named):
    none = named.limit(0)
    assert near_duplicates(none).count() == deduplicated(none).count() == token_counts(none, queries.vocabulary("byte_bpe_50k.json")).count() == 0
    bench = queries.table(spark, SF, "benchmark")
    assert contaminated(none, bench).count() == 0 and sorted(contaminated(none, bench.limit(0)).columns) == sorted(none.columns)
    assert mixed(none, max_repeats=2.0).count() == mix(none, max_repeats=2.0).count() == 0
    assert deduplicated_lines(none).count() == 0 and language_id.identify(none).count() == 0


def test_fresh_names():
    assert fresh(["A", "b", "b_"], "a", "b", "c") == ["a_", "b__", "c"]


# ---------------------------------------------------------------- 1, 5


@pytest.mark.parametrize("parts", [1, 16])
def test_candidates_are_one_row_a_text(spark, monkeypatch, parts):
    """A pair of similar lines in many partitions is compared once."""
    rows = [(k, "the first of two lines that are nearly alike\nthe first of two lines that are nearly alike!") for k in range(64)]
    found, keep = {}, scratch.keep

    def counted(df, name, **options):
        out = keep(df, name, **options)
        found.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(scratch, "keep", counted)
    out = deduplicated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
    assert sum(r.n_kept for r in out.collect()) == 1
    assert found["candidates"] == [2] and found["links"] == [1] and found["star"] == [1]


def test_rows_with_one_id_and_other_texts_are_not_lost(spark):
    df = spark.createDataFrame([(1, "one text of five words", "x"), (1, "another text of six words here", "y"), (1, "one text of five words", "x"), (2, "one text of five words", "z")], "doc_id long, text string, gone string")
    assert sorted(tuple(r) for r in deduplicated(df).collect()) == [(1, "another text of six words here", "y"), (1, "one text of five words", "x")]


# ---------------------------------------------------------------- 2


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_blocks_of_items(spark, monkeypatch, block):
    """Several blocks give what one gives, also for repeated rows and null ids."""
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(200)]
    texts = [" ".join(rng.choices(vocab, k=80)) for _ in range(20)]
    docs = spark.createDataFrame([(k % 17 if k % 5 else None, t, "h") for k, t in enumerate(texts + texts[:6])], "doc_id long, text string, hits string")
    items = [(k, " ".join(texts[k].split()[10 : 10 + n])) for k, n in enumerate([3, 6, 12, 25, 40, 60])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", block)
    out = contaminated(docs, bench, hits_col="found")
    want = Counter((t, item) for t in texts + texts[:6] for item, w in items if f" {w} " in f" {t} ")
    assert Counter((r.text, h.item_id) for r in out.collect() for h in r.found) == want and out.columns == [*docs.columns, "found"]
    assert out.count() == 26


# ---------------------------------------------------------------- 4


def test_same_fit_for_any_partitioning(spark):
    docs = queries.table(spark, SF, "documents").select(F.col("doc_id").alias("id"), "text", "lang").dropna()
    a, b = (language_id.fit(docs.repartition(n), 80) for n in (1, 7))
    assert a.langs == b.langs and np.array_equal(a.centroids, b.centroids) and np.array_equal(a.floor, b.floor)


# ---------------------------------------------------------------- 6


@pytest.mark.parametrize("scale", [1.0, 1e8, 1e25])
def test_scores_of_large_components(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=5), 3) * scale]) for i in range(60)]
    rows += [(7, [x + scale for x in rows[7][1]]), (70, [float(x) for x in np.round(rng.normal(size=5), 3)])]
    vectors = {}
    for i, v in rows:
        vectors[i] = min(v, vectors.get(i, v))
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors.items()}
    want = set()
    for q, x in whole.items():
        if q % 50 == 0:
            scores = sorted((-max(-LARGEST, min(LARGEST, sum(a * b for a, b in zip(x, y, strict=True)))), i) for i, y in whole.items() if i != q)[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)}
    got = {tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 50 == 0).collect()}
    assert got == want


# ---------------------------------------------------------------- 8


def brute_scan(text, templates, threshold=0.8):
    w, found = license_scan._template_words(text or ""), {}
    for name, t in templates.items():
        own = license_scan._template_words(t)
        reach, size = size_class(len(own))
        want = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)}
        for first in range(0, max(1, len(w)), reach):
            cut = w[first : first + 2 * reach]
            common = len(want & {tuple(cut[k : k + size]) for k in range(len(cut) - size + 1)})
            if common >= threshold * len(want) - 1e-9:
                old = found.get(name, (0, first + 1))
                found[name] = (max(old[0], common), old[1])
    return {(name, n, at) for name, (n, at) in found.items()}


def test_license_scan_is_brute_force(spark):
    """Templates with words lost, changed and put in, from well above to well below the threshold."""
    rng = random.Random(12)
    templates, rows = license_scan.TEMPLATES, []
    for k in range(360):
        name = rng.choice(sorted(templates))
        w = templates[name].split()
        for _ in range(rng.randint(0, max(1, len(w) // 14))):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["changed"], [w[at], "put", "in"]])
        before, after = ([f"w{rng.randrange(3000)}" for _ in range(rng.randint(0, 90))] for _ in range(2))
        rows.append((k, " ".join([*before, *w, *after])))
    got = {(r.doc_id, r.license, r.n_common, r.first_word) for r in scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = {(k, *x) for k, t in rows for x in brute_scan(t, templates)}
    assert got <= want  # every match is verified
    assert len(got) >= 0.995 * len(want) and 150 < len(want)


def test_license_scan_of_a_long_text(spark):
    """20,000 words with an anchor in every tenth place take seconds, not minutes."""
    rng = random.Random(1)
    text = " ".join("license" if k % 10 == 0 else f"w{rng.randrange(5000)}" for k in range(20_000)) + " " + license_scan.TEMPLATES["mit"]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    scan(df).collect()
    began = time.time()
    assert {r.license for r in scan(df).collect()} == {"mit"}
    assert time.time() - began < 30


# ---------------------------------------------------------------- 9


def test_scores_are_brute_force(spark):
    """Each word by its own arc and all its spellings; one round of learning left out, to know the pieces' probabilities."""
    path = queries.vocabulary("piece_bpe_32k.model")
    texts = ["the cat the dog", "The cat sat", None, "", "unseen zzzq words", "the zzzq", "été à la mer"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = F.col("doc_id") >= 4
    got = {r.doc_id: r for r in lattice_scores(docs, path, held, rounds=0).collect()}
    pieces, p = load_pieces(path)
    value = dict(zip(pieces, p, strict=True))

    def spelt(w, factor):
        total = [1.0] + [0.0] * len(w)
        for j in range(1, len(w) + 1):
            total[j] = sum(total[i] * value.get(w[i:j], 0.0) * factor for i in range(j))
        return total[-1]

    words = [[w.encode() for w in (t or "").lower().split()] for t in texts]
    c = Counter(w for d in words[:4] for w in d)
    n, v = sum(c.values()) + 4, len(c) + 1
    end = max(0.0, 4 - DISCOUNT) / n + DISCOUNT * v / n * FIRST_END
    for k, d in enumerate(words):
        score = math.log10(end) + sum(math.log10(max(0.0, c[w] - DISCOUNT) / n + DISCOUNT * v / n * spelt(b" " + w, 1.0)) for w in d)
        plain = math.log10(FIRST_END) + sum(math.log10(spelt(b" " + w, 1 - FIRST_END)) for w in d)
        assert math.isclose(got[k].score, score, rel_tol=1e-9) and math.isclose(got[k].plain_score, plain, rel_tol=1e-9)
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(d) + 1, sum(c[w] > 0 for w in d) + 1, n)


@pytest.mark.parametrize("chunk", [1, 1 << 26])
def test_scores_for_any_chunks(spark, monkeypatch, chunk):
    """Chunks of one slice each, or one a task, give one result."""
    from bitstrata.llm import lattice_lm

    docs = queries.table(spark, SF, "documents").select("doc_id", "text").limit(60)
    held = F.col("doc_id") % 5 == 1
    path = queries.vocabulary("piece_bpe_32k.model")
    want = {r.doc_id: tuple(r)[1:] for r in lattice_scores(docs, path, held, rounds=1).collect()}
    monkeypatch.setattr(lattice_lm, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(lattice_lm, "SLICE_BYTES", 2000)
    got = {r.doc_id: tuple(r)[1:] for r in lattice_scores(docs.repartition(3), path, held, rounds=1).collect()}
    assert got.keys() == want.keys() and all(got[k][:4] == want[k][:4] and np.allclose(got[k][4:], want[k][4:], rtol=1e-9) for k in want)
