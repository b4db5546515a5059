"""SentencePiece codec against the library, language identification and the quality classifier on small corpora."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ordwise.llm import language_id, quality_classifier
from ordwise.llm import sentencepiece_codec as sp

ODD = [None, "", " ", "  two  spaces ", "a", "▁", "日本語テキスト", "😀 x", "\x00\x01", "é" * 50, "\n\n\t x", "a" * 300, " " * 40, "tionsation" * 30, "</s><s>"]


def test_codec_equals_the_library_and_comes_back(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abcdetn s.▁é\n1:/<s>") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    model = sp.load(sp.MODEL)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, decoded string")
    both = {r.doc_id: r for r in sp.encode_decode(df, model).collect()}
    apart = {r.doc_id: r.decoded for r in sp.decode(sp.encode(df, model), model).collect()}
    for i, t in enumerate(texts):
        assert both[i].tokens == (None if t is None else library.encode(t))
        assert both[i].decoded == apart[i] == (None if t is None else t.replace("▁", " "))
    assert sp.encode_decode(df.limit(0), model).count() == 0


def test_codec_of_long_words_repeats_and_many_batches(spark, monkeypatch):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sp.MODEL)
    rng = random.Random(3)
    long = "".join(rng.choice("abcdent") for _ in range(1_000_000))
    words = ["".join(rng.choice("abcdeé.日") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts = [long, long, "x" * 200_000, " ".join(words) + " " + " ".join(words), *(" ".join(rng.choices(words, k=9)) for _ in range(500))]
    texts += [texts[-1], texts[-2] + " ", " " + texts[-3], "a  " + texts[-4]]
    monkeypatch.setattr(sp, "CACHE_WORDS", 500)
    monkeypatch.setattr(sp, "BATCH_BYTES", 5_000)
    coder, decoder = sp.Encoder(sp.load(sp.MODEL)), sp.Decoder(sp.load(sp.MODEL))
    got = []
    for part in sp._by_chars(pa.array(texts)):
        ids = coder.encode(part)
        got += zip(ids.to_pylist(), decoder.texts(ids).to_pylist())
    for t, (ids, back) in zip(texts, got, strict=True):
        assert ids == library.encode(t) and back == t


def test_decode_of_bytes_that_are_no_text():
    v = sp.load(sp.MODEL)
    bad = [v.byte_ids[0xFF]]
    assert sp.Decoder(v).texts(pa.array([bad, None, [], [v.ids["▁a"]]], pa.list_(pa.int32()))).to_pylist() == ["\ufffd", None, "", "a"]
    for ids in ([-1], [len(v.pieces)]):
        with pytest.raises(ValueError):
            sp.Decoder(v).texts(pa.array([ids], pa.list_(pa.int32())))


def test_unigram_models_take_the_best_path():
    pieces = ["<unk>", "a", "b", "ab", "ba", "aba", "▁", "▁a"]
    scores = [0.0, -2.0, -2.5, -2.2, -3.0, -6.0, -1.0, -2.1]
    v = sp.Vocabulary(pieces, scores, "unigram", [], 0, [])

    def best(word):
        if not word:
            return 0.0
        return max((scores[v.ids[word[:n]]] + best(word[n:]) for n in range(1, 4) if word[:n] in v.ids), default=-1e9)

    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for w, ids in zip(words, sp.Encoder(v).encode(pa.array(words)).to_pylist()):
        assert abs(sum(scores[i] for i in ids) - best("▁" + w)) < 1e-9


def plain_language(rows, text):
    """The method in plain Python, over complete counts: (language, probability)."""
    counts = {}
    for lang, t in rows:
        if lang is not None and t is not None:
            counts.setdefault(lang, Counter()).update(language_id.words_of(t))
    langs = sorted(counts)
    tables = {0: counts}
    for n in range(1, 6):
        tables[n] = {k: Counter() for k in langs}
        for k in langs:
            for w, c in counts[k].items():
                for g in language_id.grams(w, n):
                    tables[n][k][g] += c
    every = {n: set().union(*t.values()) for n, t in tables.items()}
    total = {n: {k: sum(t[k].values()) for k in langs} for n, t in tables.items()}
    log = lambda n, k, x: math.log(tables[n][k][x] or 0.5) - math.log(total[n][k] + 0.5 * len(every[n]))
    words = language_id.words_of(text) if text else []
    if not words:
        return "und", 0.0
    score = {k: math.log(total[0][k] / sum(total[0].values())) if total[0][k] else -math.inf for k in langs}
    for w in words:
        found, size = [w] if w in every[0] else [], 1
        n = 0
        if not found:
            for n in range(5, 0, -1):
                size = n
                if found := [g for g in language_id.grams(w, n) if g in every[n]]:
                    break
        for k in langs:
            score[k] += sum(log(n, k, x) for x in found) / size
    best = max(langs, key=lambda k: (score[k], -langs.index(k)))
    return best, 1 / sum(math.exp(s - score[best]) for s in score.values())


@pytest.mark.parametrize("known_words", [100_000, 20, 1])
def test_language_scores_equal_plain_ones_however_few_words_are_broadcast(spark, known_words):
    rng = random.Random(3)
    parts = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ung", "ei", "ber", "ka"], None: ["zzz"]}
    word = lambda k: "".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 4)))
    rows = [(i, k, " ".join(word(k) for _ in range(12))) for i in range(25) for k in parts] + [(99, "xx", None), (99, "xx", ""), (98, "vv", ""), (97, "zz", " ".join(f"{a}{b}q" for a in "abcdefgh" for b in "abcdefghij"))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.fit(df)
    assert model.langs == ["vv", "xx", "yy", "zz"]
    texts = ["KAlolomitu kakaka", "schungeiber", None, "12 %", "", "本", "½ ② Ⅷ ²", "x½y", "kaq lolo lolo eiei xyz", "cat", "a", "ka " * 300_000, *[r[2] for r in rows[:12]]]
    test = [(i % 9, t, "mine", 3) for i, t in enumerate(texts + texts[:3])]
    got = language_id.predict(spark.createDataFrame(test, "doc_id int, text string, lang_pred string, score int").withColumn("rid", F.col("doc_id")), model, known_words=known_words)
    assert got.columns == ["doc_id", "text", "rid", "lang_pred", "score"]
    want = {t: plain_language([r[1:] for r in rows], t) for t in texts}
    found = got.collect()
    assert Counter(r.text for r in found) == Counter(r[1] for r in test)
    for r in found:
        assert r.lang_pred == want[r.text][0] and abs(r.score - want[r.text][1]) < 1e-6, (r.text, r, want[r.text])
    assert [want[t][0] for t in (None, "12 %", "", "½ ② Ⅷ ²")] == ["und"] * 4


def test_language_id_of_empty_tables(spark):
    df = spark.createDataFrame([(1, "xx", "ka lo")], "doc_id long, lang string, text string")
    none = language_id.fit(df.limit(0))
    assert language_id.predict(df, none).select("lang_pred", "score").first() == ("und", 0.0)
    assert language_id.predict(df.limit(0), language_id.fit(df)).count() == 0


def test_quality_classifier(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "ti"]) for _ in range(rng.randint(1, 4)))
    good = lambda: " ".join(word() for _ in range(60)) + "."
    bad = lambda: rng.choice([" ".join(word() + "%%%" for _ in range(40)), " ".join([word()] * 50)])
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(300)]
    df = spark.createDataFrame([r[:2] for r in rows] + [(None, "x"), (7, rows[7][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (9999, 0), (5, None)], "doc_id long, label int")
    model = quality_classifier.fit(df, labels)
    fresh = [(i, good() if i % 2 else bad()) for i in range(60)] + [(100, None), (101, ""), (102, "a " * 600_000)]
    got = {r.doc_id: r.score for r in quality_classifier.score(spark.createDataFrame(fresh, "doc_id long, text string"), model).collect()}
    assert sum((got[i] >= 0.7) == bool(i % 2) for i in range(60)) >= 58
    assert got[100] == got[101] and all(0 <= s <= 1 for s in got.values())
    assert quality_classifier.score(df.limit(1), quality_classifier.fit(df, labels.limit(0))).first().score == 0.5
    named = df.select("doc_id", "text", F.lit(1).alias("label"), F.lit("mine").alias("score"), F.lit(0).alias("id"))
    again = quality_classifier.fit(named.unionByName(named.where("doc_id = 7")), labels)
    out = quality_classifier.score(named.unionByName(named), again, output="q")
    assert out.columns == [*named.columns, "q"] and out.count() == 2 * named.count() and out.where("score <> 'mine'").count() == 0
    assert out.groupBy("doc_id", "text").agg(F.countDistinct("q").alias("n")).where("n > 1").count() == 0
    assert quality_classifier.score(named.limit(0), again).count() == 0
