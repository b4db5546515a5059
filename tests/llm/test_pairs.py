"""SimHash and embedding near-duplicates against brute force."""

import math
import random

import numpy as np
import pytest
import xxhash

from ordwise.llm import embedding_neardup, simhash_neardup
from ordwise.llm.components import connected_components


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200, 202: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_fingerprint(text):
    w = [x for x in __import__("re").split("[ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t\r\n", "One", "a b c", "A b C d", "ÄÖ a  b\vc\fd e É", "x " * 300, "Long " + "words and More " * 70_000, "y" * 100_000, "the quick brown fox jumps over the lazy dog " * 9])
def test_fingerprint(text):
    assert simhash_neardup.fingerprint(text.encode() if text is not None else None) == slow_fingerprint(text)


def flips(rng, base, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        base ^= 1 << b
    return base


@pytest.mark.parametrize(("seed", "chunk", "balls", "budget"), [(1, 4096, 40, 4), (2, 16, 4, 4), (3, 7, 1, 4), (4, 2, 9, 4), (5, 50, 9, 0), (6, 8, 9, 1), (7, 64, 9, 6), (8, 40, 5, 3)])
def test_links_connect_what_brute_force_connects(spark, seed, chunk, balls, budget):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(balls)]
    fps = sorted({flips(rng, rng.choice(centres), budget + 1) for _ in range(250)} | {rng.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash_neardup.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), budget, chunk).collect()
    at = {s: i for i, s in enumerate(signed)}
    got = components(len(fps), [(at[u], at[v]) for u, v in edges])
    assert got == components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= budget])


@pytest.mark.parametrize("budget", range(7))
def test_walk_splits_prunes_and_links(budget):
    rng = np.random.default_rng(5)
    near = np.uint64(0xABCDEF0123456789) ^ (np.uint64(1) << rng.integers(0, 64, (300, 4), dtype=np.uint64)).sum(1, dtype=np.uint64)
    fp = np.unique(np.r_[rng.integers(0, 1 << 64, 2000, dtype=np.uint64), near])
    seen = {"split": 0, "pruned": 0, "compared": 0}
    at = {x: i for i, x in enumerate(fp.tolist())}
    pairs = []
    for half in (0, 1):
        t = np.full(len(fp), half)
        u, v = simhash_neardup.trie_links(np.zeros(len(fp), np.int64), np.full(len(fp), 2), simhash_neardup._turned(fp, t), budget, seen)
        pairs += [(at[a], at[b]) for a, b in zip(*(simhash_neardup._turned(x, t[: len(x)]).tolist() for x in (u, v)))]
    close = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= budget
    assert components(len(fp), pairs) == components(len(fp), zip(*np.nonzero(np.triu(close, 1))))
    assert seen["split"] > 1000 and seen["pruned"] > 1000 and seen["compared"] < len(fp) ** 2 / 20


def test_walk_of_two_sides():
    rng = np.random.default_rng(6)
    fp = np.unique(rng.integers(0, 1 << 12, 900, dtype=np.uint64))
    side, key = rng.integers(0, 2, len(fp)), rng.integers(0, 3, len(fp))
    u, v = simhash_neardup.trie_links(key, side, fp, 1)
    at = {x: i for i, x in enumerate(fp.tolist())}
    near = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 1) & (side[:, None] != side[None, :]) & (key[:, None] == key[None, :])
    assert components(len(fp), [(at[a], at[b]) for a, b in zip(u.tolist(), v.tolist())]) == components(len(fp), zip(*np.nonzero(np.triu(near, 1))))


def test_nearest_in_group():
    rng = np.random.default_rng(7)
    f = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    f[200:] = f[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    group = np.r_[np.arange(200) % 20, np.arange(200) % 20]
    x, y = simhash_neardup.nearest_in_group(group, np.full(400, 2), f, 21)
    assert dict(zip(x.tolist(), y.tolist())) == {i: (i + 200) % 400 for i in range(400)}


def test_documents_end_to_end(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["Alpha", "beta", "gam", "del", "eps", "zeta", "eta"]) + str(rng.randint(0, 30)) for _ in range(400)) for _ in range(6)]
    texts = [*base, base[0], base[0].upper() + " \n", base[1] + " one two", "", None, " ", "one", None]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts, 10)]
    rows += [rows[3], (None, base[2], "x", "y")]
    got = simhash_neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")).collect()
    want = [slow_fingerprint(r[1]) for r in rows]
    comp = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (want[i] ^ want[j]).bit_count() <= 4])
    ids = {}
    for c, r in zip(comp, rows):
        ids[c] = min(x for x in (ids.get(c), r[0]) if x is not None)
    assert sorted((r[0] or -1, r[1] % (1 << 64), r[2]) for r in got) == sorted((r[0] or -1, w, ids[c]) for r, w, c in zip(rows, want, comp))
    assert simhash_neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def slow_links(rows, threshold):
    def sound(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    n = [0] * len(rows)
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i], rows[j]
            if sound(a) and sound(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(z[1], np.float32).astype(float) for z in (a, b))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    pairs.append((i, j))
                    n[i] += 1
                    n[j] += 1
    return n, components(len(rows), pairs)


@pytest.mark.parametrize(("chunk", "visitors", "stream"), [(1024, 1 << 20, 4096), (5, 1 << 20, 3), (7, 20, 2)])
def test_embeddings(spark, chunk, visitors, stream, monkeypatch):
    monkeypatch.setattr(embedding_neardup, "STREAM", stream)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 16))
    rows = []
    for i in range(260):
        x = centres[i % 9] + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.2, 1.0])
        rows.append([i, [float(np.float32(z)) for z in x * rng.uniform(0.1, 9)], int(i % 3)])
    for i in range(260, 300):
        rows.append([i, rows[7][1], 1])
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan] * 16, [inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 4, [1.0] * 4]
    rows += [[400 + i, e, 1] for i, e in enumerate(odd)] + [[500, rows[0][1], None], [501, rows[0][1], None]]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "vec_id long, embedding array<float>, label int, cid string, n long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_neardup.near_duplicates(df, chunk=chunk, visitors=visitors).collect()}
    n, comp = slow_links(rows, 0.98)
    assert got == {r[0]: (k, rows[c][0], rows[c][0] == r[0]) for r, k, c in zip(rows, n, comp)}
    assert sum(n) > 500


def test_embeddings_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (4, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, embedding_neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 1, 3, True), (4, 1, 3, False), (None, 0, None, False)], key=str)
    assert embedding_neardup.near_duplicates(df.limit(0)).count() == 0


def test_cut_tables_go_and_small_tables_are_dealt(spark, tmp_path, monkeypatch):
    from ordwise.llm import _shared

    start = _shared.mark()
    kept, gone = _shared.cut(spark.range(5).toDF("a"), "kept"), _shared.cut(spark.range(6).toDF("b"), "gone")
    _shared.forget(start, kept)
    assert kept.count() == 5 and len(_shared._written) == start + 1
    with pytest.raises(Exception, match="(?i)exist|found"):
        gone.count()
    _shared.forget(start)
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert _shared.spread(table) is table
    monkeypatch.setattr(_shared, "SPREAD_BYTES", 1)
    dealt = _shared.spread(table)
    assert dealt is not table and sorted(r.id for r in dealt.collect()) == list(range(1000))
