"""Near-duplicates by shingle sets, and the pipeline's stage, against brute force."""

import random

import numpy as np

import corpus_pipeline
from ordwise.llm import simhash_neardup


def slow_set(text, k=5):
    w = [x for x in __import__("re").split("[ \t-\r]+", (text or "").lower()) if x]
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def slow_components(texts, threshold=0.8):
    sets, root = [slow_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (len(a & b) / len(a | b) if a | b else 1) >= threshold:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def made():
    rng = random.Random(8)
    word = lambda: "w" + str(rng.randint(0, 900))
    bases = [[word() for _ in range(rng.randint(60, 300))] for _ in range(12)]
    texts = []
    for b in bases:
        texts.append(" ".join(b))
        for edits in (1, 2, 3, 4, 6, 8):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = word()
            texts.append(" ".join(c))
    return [*texts, texts[0].upper(), "", None, " ", "one", "ONE", "one two"]


def test_components(spark):
    texts = made()
    want = slow_components(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(simhash_neardup.similar_classes(df).collect()) == dict(enumerate(want))
    assert simhash_neardup.similar_classes(df.limit(0)).count() == 0


def test_pipeline_stage_drops_what_is_similar_at_eight_tenths(spark):
    texts = made()
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.neardup_filter(spark, df, "").collect())
    assert got == sorted(set(slow_components(texts)))


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a, 2), (None, a, 1), (None, a + " more", 0), (7, b, 0), (None, b, 0), (5, c, 0), (5, d, 0), (6, d, 0), (5, d + " more", 1), (None, None, 0), (None, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, corpus_pipeline.neardup_filter(spark, df, "").collect()), key=str)
    assert got == sorted([(None, a, 1), (7, b, 0), (5, c, 0), (5, d, 0), (None, None, 0)], key=str)
    assert corpus_pipeline.neardup_filter(spark, df.limit(0), "").count() == 0


def test_links_behind_nearer_copies(spark):
    """Each text has nearer copies in every trie node than the one that links its group to another; and short texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    texts = []
    for _ in range(4):
        a = [word() for _ in range(1500)]
        b = [word() if i % 50 == 20 else w for i, w in enumerate(a)]
        texts += [" ".join([*t, word()]) for t in (a, b) for _ in range(6)]
    for _ in range(30):
        short = " ".join(word() for _ in range(8))
        texts += [short, f"{short} {word()}"]
    want = slow_components(texts)
    assert len(set(want)) == 34
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(simhash_neardup.similar_classes(df).collect()) == dict(enumerate(want))


def sets_of_shingles():
    rng = np.random.default_rng(3)
    out = []
    for size in (1, 2, 4, 5, 9, 30, 200):
        for _ in range(6):
            h = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            out += [h, h[: max(1, -(-9 * len(h) // 10))], np.unique(np.r_[h, rng.integers(0, 1 << 64, max(1, size // 4), dtype=np.uint64)])]
    return out


def test_shingles_left_bound_the_difference_of_sets():
    sets = sets_of_shingles()
    for a in sets:
        for b in sets:
            assert simhash_neardup.differ(simhash_neardup.odd_bits(a), simhash_neardup.odd_bits(b)) <= len(np.setxor1d(a, b))


def test_left_pairs_are_all_similar_pairs_of_two_groups(spark):
    sets = sets_of_shingles()
    seen = np.unique(np.concatenate(sets))
    frequent = seen[::3]
    rank = np.arange(len(frequent)) % 7
    rows = [(i, len(h), simhash_neardup.odd_bits(h).tobytes(), simhash_neardup.prefix(h, frequent, rank).view(np.int64).tolist()) for i, h in enumerate(sets)]
    classes = spark.createDataFrame(rows, "class long, n int, odd binary, first array<long>")
    root = {i: i - 1 for i in range(len(sets)) if i % 9 == 1}
    root |= {i: i for i in root.values()}
    roots = spark.createDataFrame(list(root.items()), "node long, root long")
    want = {(i, j) for i in range(len(sets)) for j in range(i) if root.get(i, i) != root.get(j, j) and simhash_neardup.similarity(sets[i], sets[j]) >= 0.8}
    assert len(want) > 20
    for parts in ({}, {int(g): 3 for g in seen.view(np.int64)}):
        got = [(r.u, r.v) for r in simhash_neardup.left_pairs(classes, roots, parts).collect()]
        assert len(got) == len(set(got)) and want <= set(got) and all(root.get(u, u) != root.get(v, v) for u, v in got)


def test_pairs_that_met_before_are_not_given_again():
    rng = np.random.default_rng(7)
    shared = rng.choice(1 << 62, 300, replace=False).astype(np.uint64) + np.uint64(1)
    sets = [np.unique(np.concatenate([shared[a : a + int(rng.integers(40, 120))], rng.integers(1, 1 << 62, int(rng.integers(0, 60))).astype(np.uint64)])) for a in rng.integers(0, 180, 60)]
    frequent = np.sort(shared[::3])
    firsts = [simhash_neardup.prefix(h, frequent, np.arange(len(frequent))) for h in sets]
    many = np.array([len(x) for x in firsts])
    row, key = np.repeat(np.arange(len(sets)), many), np.concatenate(firsts)
    n = np.array([len(h) for h in sets])[row]
    room = n - (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many))
    earlier = simhash_neardup.earlier_least(key, many)
    for i in range(0, len(key), 17):
        before = [int(k) for k, r in zip(key[:i], row[:i]) if r == row[i]]
        assert earlier[i].tolist() == [min((k for k in before if k % simhash_neardup.MET == c), default=0) for c in range(simhash_neardup.MET)]
    group = np.unique(key, return_inverse=True)[1]
    found = []
    for known in ((), tuple(earlier.T)):
        pairs = [(min(row[a], row[b]), max(row[a], row[b])) for x, y in simhash_neardup._across(group, np.full(len(key), 2), row, room, n, 0.8, known) for a, b in zip(x, y)]
        found.append((set(pairs), len(pairs)))
    assert found[0][0] == found[1][0] and len(found[0][0]) > 20
    assert found[1][1] < found[0][1] / 2
