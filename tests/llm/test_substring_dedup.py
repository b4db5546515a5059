"""Substring dedup against brute force."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from ordwise.llm import substring_dedup as sd


def split(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def brute(rows, window):
    first = {}
    for i, t in rows:
        w = split(t)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, vocabulary, n=60):
    rng = random.Random(seed)
    word = lambda: "w" + str(min(int(rng.expovariate(1) * vocabulary / 4), vocabulary))
    passages = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(6)] + ["a " * 40, "a b " * 20, "a a b " * 15]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 50)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), " ".join(word() for _ in range(rng.randint(0, 30)))]
        texts.append(rng.choice([" ", "\n", " \t\v"]).join(parts))
    texts += texts[:5] + [texts[3] + " more", "ä " * 13, "ä " * 14, "", None, " \n", "one", None]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[i]) for i in order]


@pytest.mark.parametrize(("seed", "vocabulary", "window"), [(1, 5, 13), (2, 400, 13), (3, 40, 5), (4, 2, 13)])
def test_digest(spark, seed, vocabulary, window):
    rows = corpus(seed, vocabulary)
    rows += [rows[0], rows[5], (None, rows[1][1]), (None, rows[2][1])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, bucket int, name int")
    got = sorted(map(tuple, sd.substring_dedup(df, window=window, bucket_bytes=2000).collect()), key=str)
    assert got == brute(rows, window)


def test_text_keeps_columns_and_white_space(spark):
    shared = " ".join(f"s{i}" for i in range(20))
    rows = [(1, f"a\n{shared}\nb  c", 7, "x"), (2, f"  d\t{shared} e\n\nf ", 8, None), (3, None, None, "y"), (4, "", 0, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, lang string")
    got = {r.doc_id: r for r in sd.substring_dedup(df, output="text").collect()}
    assert [c for c in got[1].asDict()] == ["doc_id", "text", "lang", "n_words", "n_removed"]
    assert (got[1].text, got[2].text, got[3].text, got[4].text) == (rows[0][1], "  d\te\n\nf ", None, "")
    assert (got[1].n_removed, got[2].n_removed, got[2].lang, got[3].lang) == (0, 20, None, "y")
    assert sd.substring_dedup(df.limit(0), output="text").count() == 0
    assert sd.substring_dedup(df.limit(0)).count() == 0


def test_windows_name_their_interior_alike_in_any_surroundings():
    rng = np.random.default_rng(1)
    for vocabulary in (2, 3, 20, 5000):
        core = rng.integers(1, vocabulary + 1, 30).astype(np.uint64)
        seen = []
        for _ in range(30):
            before, after = (rng.integers(1, vocabulary + 1, rng.integers(0, 20)).astype(np.uint64) for _ in range(2))
            h = np.r_[before, core, after]
            doc = np.r_[np.zeros(len(before) // 2), np.ones(len(h) - len(before) // 2)].astype(int)
            seen.append(sd.anchors(h, doc, np.arange(len(before), len(before) + 18), 13).tolist())
        assert all(x == seen[0] for x in seen)


def test_rows_of_one_id_are_judged_apart(spark):
    texts = [" ".join(f"{x}{i}" for i in range(20)) for x in "abc"]
    rows = [(3, texts[0]), (5, texts[0]), (5, texts[1]), (8, texts[1]), (9, texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, sd.substring_dedup(df).collect()), key=str) == brute(rows, 13)


def bucket(texts, window):
    import pyarrow as pa

    none = np.empty(0, np.int64)
    table = pa.table({"__id": pa.array(range(len(texts)), pa.int64()), "__text": pa.array([t and t.encode() for t in texts], pa.binary())})
    return sd._Bucket(table, [none] * 3, window)


@pytest.mark.parametrize(("window", "size"), [(13, 1), (13, 50), (5, 7), (13, 1 << 20)])
def test_portions_of_any_size_name_windows_alike(window, size):
    for seed, vocabulary in ((1, 2), (2, 40), (3, 5000)):
        k = bucket([t for _, t in corpus(seed, vocabulary)], window)
        assert k.interiors(window, size).tolist() == sd.anchors(k.h, k.row, k.starts, window).view(np.int64).tolist()
        w1, w2 = k.windows(window, size)
        assert w1.tolist() == sd.window_names(k.other, window, 11)[k.starts].view(np.int64).tolist()
        assert w2.tolist() == (sd.window_names(k.h ^ (k.other >> np.uint64(7)), window, 23)[k.starts] >> np.uint64(32)).astype(np.int64).tolist()
    assert len(bucket(["one", None], window).interiors(window, size)) == 0


def test_a_bucket_is_named_without_parsing_it_as_one():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, 20_000)}" for _ in range(n)) for n in (400_000, 100_000, *[200] * 500)]  # one text is over half of it
    k = bucket(texts, 13)

    def held(fn):
        tracemalloc.start()
        try:
            out = fn()
            return out, tracemalloc.get_traced_memory()[1] / len(k.h)
        finally:
            tracemalloc.stop()

    (at_once, most), (name, least), (_, windows) = held(lambda: sd.anchors(k.h, k.row, k.starts, 13)), held(lambda: k.interiors(13)), held(lambda: k.windows(13))
    assert (at_once.view(np.int64) == name).all()
    assert most > 150 and least < 60 and windows < 40  # bytes a word


def batches(rows, size):
    import pyarrow as pa

    cols = [np.array(c, np.int64) for c in zip(*rows)]
    return [pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in cols], [f"c{k}" for k in range(len(cols))]) for i in range(0, len(rows), size)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_groups_pass_through_in_batches_of_any_size(size):
    rng = random.Random(9)
    rows = sorted((rng.randint(0, 40), b, int(rng.random() < 0.1)) for b in range(120))
    many = {n for n, _, m in rows if m or sum(r[0] == n for r in rows) > 1}
    got = sorted((r["a"], r["bucket"]) for out in sd._shared_names(batches([(n, 2 * b + m) for n, b, m in rows], size)) for r in out.to_pylist())
    assert got == sorted((n, b) for n, b, _ in rows if n in many)
    rows = sorted((rng.randint(0, 9), rng.randint(0, 3), low := rng.randint(0, 50), low + rng.randint(0, 9), b) for b in range(200))
    least = {}
    for w1, w2, low, _, _ in rows:
        least[w1, w2] = min(least.get((w1, w2), low), low)
    got = sorted((r["a"], r["b"], r["c"], r["bucket"]) for out in sd._first_docs(batches(rows, size)) for r in out.to_pylist())
    assert got == sorted((w1, w2, least[w1, w2], b) for w1, w2, _, high, b in rows if high > least[w1, w2])
