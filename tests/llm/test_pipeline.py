"""The pipeline's stages, each against plain Python on a small corpus, and the whole of it."""

import random
from collections import Counter

import pytest
from test_native_operators import slow_targets, words
from test_similar_texts import slow_components
from test_substring_dedup import brute

import corpus_pipeline
from ordwise.llm import sentencepiece_codec

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, decoded string, digest int"


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "ti", "re"]) for _ in range(rng.randint(1, 4)))
    good = lambda n=60: " ".join(word() for _ in range(n)) + "."
    bad = lambda: " ".join(word() + "%%%" for _ in range(50))
    passage = good(30)
    rows, labels = [], []
    for i in range(220):
        text = good() if i % 4 else bad()
        if i % 20 == 1:
            text = f"{good()}\n{passage} {good(20)}"
        if i % 20 == 2:
            text = rows[-1][1].replace("an", "an", 1) + " more"  # a near copy
        rows.append((i, text))
        labels.append((i, int(i % 4 > 0 or i % 20 in (1, 2)), 0))
    rows += [rows[5], (None, rows[6][1]), (None, good()), (300, None), (301, ""), (302, passage), (303, "ok " * 40_000)]
    full = [(i, t, "en", rng.choice(["a", "b", None]), len(t or ""), "mine", None, "x", 1) for i, t in rows]
    return full, labels


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], COLUMNS).write.parquet(f"{d}/empty.parquet")
    return d


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_stages_in_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_filter", "neardup_filter", "substring_filter", "mix_sources", "tokenize"]


def test_empty_documents(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/empty.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_quality_keeps_good_rows_whole(spark, docs, sf_dir):
    out = corpus_pipeline.quality_filter(spark, docs, sf_dir)
    rows = Counter(map(tuple, docs.collect()))
    kept = Counter(map(tuple, out.collect()))
    assert out.columns == docs.columns and not kept - rows
    bad = {r for r in rows if r[1] and "%%%" in r[1] and r[0] is not None}
    good = {r for r in rows if r[0] is not None and r[0] < 220} - bad
    assert len(bad & kept.keys()) <= 2 and len(good - kept.keys()) <= 4


def test_near_duplicates(spark, docs, sf_dir):
    rows = docs.collect()
    comp = slow_components([r.text for r in rows])
    best = {}
    for c, r in zip(comp, rows):
        key = (r.doc_id is None, r.doc_id or 0)
        best[c] = min(best.get(c, key), key)
    got = corpus_pipeline.neardup_filter(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == Counter(best.values())


def test_substrings(spark, docs, sf_dir):
    rows = docs.collect()
    want = Counter((i, n) for i, n, gone, _ in ((x[0], x[1] - x[2], x[2], x[3]) for x in brute([(r.doc_id, r.text) for r in rows], 13)) if not gone or n)
    got = corpus_pipeline.substring_filter(spark, docs, sf_dir)
    assert got.columns == docs.columns
    found = got.collect()
    assert Counter((r.doc_id, len(words(r.text))) for r in found) == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.score == "mine" for r in found)


def test_mix(spark, docs, sf_dir):
    got = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert got.columns == docs.columns
    sizes, taken = Counter(), Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    found = got.collect()
    for r in found:
        taken[r.source] += len(words(r.text))
    most = max(len(words(r.text)) for r in docs.collect())
    assert all(abs(taken[s] - t) <= 2 * most for s, t in slow_targets(sizes).items())
    assert max(Counter(map(tuple, found)).values()) <= 4  # two equal rows, each at most twice


def test_tokens(spark, docs, sf_dir):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    got = corpus_pipeline.tokenize(spark, docs, sf_dir)
    assert got.columns == [*docs.columns, "tokens", "round_trip"]
    for r in got.collect():
        assert r.decoded == "x" and r.tokens == (None if r.text is None else library.encode(r.text)) and r.round_trip == (None if r.text is None else True)


def test_whole_pipeline_is_its_stages(spark, docs, sf_dir):
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, sf_dir)
    want = Counter(map(str, step.collect()))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(map(str, got)) == want and len(got) > 100
    assert all(r.round_trip is not False and "%%%" not in (r.text or "") for r in got)
