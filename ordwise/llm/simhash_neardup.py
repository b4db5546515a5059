"""Near-duplicates by SimHash, linked through a binary trie self-join.

Fingerprints are joined with themselves by walking pairs of trie nodes together: a pair of nodes carries the number
of bits in which their prefixes differ, and is dropped as soon as that exceeds the error budget.

Of two fingerprints within the budget, one half of the bits differs in at most half the budget. So there are two
tries, each with another half in front, and in its upper 32 levels only half the budget is allowed: a walk of n
fingerprints visits some n * log2(n)^2 / 2 node pairs at a budget of 4, whatever n. The walk is spread over a cluster
by its first levels: each pair of prefixes that is still within the budget there is a task's to walk on, down to
single fingerprints. A prefix that holds far more than CHUNK (near copies of one text) is dealt into chunks, whose
pairs are walked apart. A task reports what it linked as a spanning forest (each fingerprint with the least one it
reached), not as pairs.

Texts similar at 0.8 differ in too many bits for that (`similar_classes`): there, a longer fingerprint is laid into many
tries, each with bit positions of its own in front, whose first levels are walked without budget. There a text meets
its nearest alone, which joins most of a group at little cost. The rest is exact (`left_pairs`): similar sets share one
of the first shingles of each in an order of all shingles, so whatever is similar and still in two groups meets under one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordwise.llm._shared import cut, forget, join_small, mark
from ordwise.llm.components import connected_components

BUDGET = 4
SHINGLE = 4
#: Fingerprints under one prefix that one task walks with those of another, and first levels that are always prefixes.
CHUNK = 1 << 15
LEVELS = 4
#: A node pair with at most so many fingerprint pairs is a leaf: they are compared.
LEAF = 8
#: Similar texts: words of a shingle, their Jaccard similarity, and 64-bit words of their fingerprint.
WIDE_SHINGLE, SIMILARITY, WIDE = 5, 0.8, 8
#: What is left of the chance that two texts of that similarity share a node in no trie, and by how many standard
#: deviations their fingerprints may be further apart than the similarity makes likely to be compared at all.
MISSED, APART = 0.005, 4
#: Bits beyond a text's nearest candidate that its second round looks at: one and a half standard deviations.
NEXT = 12
#: Distinct texts, about, whose shingles are counted for the order of all shingles, and shingles that are put last there,
#: beyond those seen once. They decide what the exact pairs cost, not which are found.
SAMPLE, FREQUENT = 5_000, 1 << 17
#: Earlier shingles that a row carries, by which two rows know that they met before.
MET = 4
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_U = np.uint64


def _grams(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text, in order; null or without words: none."""
    w = text.translate(_LOWER).split() if text else []
    if not w:
        return np.empty(0, _U)
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) > shingle else [b" ".join(w)]
    return np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), _U)


def _majority(h: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words (rows, words) to the words whose bits are set in over half of them."""
    raw = np.ascontiguousarray(h).view(np.uint8).reshape(len(h), -1)
    total = np.zeros(raw.shape[1] * 8, np.int64)
    for i in range(0, len(raw), 255):  # so many rows that a byte holds the sum
        total += np.unpackbits(raw[i : i + 255], axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(h), bitorder="little").view(_U)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the XXH64 (seed 42) of word shingles; null or without words: 0.

    A-Z are lower-cased, words are runs of anything but ASCII white space, fewer words than a shingle are one
    shingle, repeats count, and a bit is set if it is in over half the hashes.
    """
    h = _grams(text, shingle)
    return int(_majority(h[:, None])[0]) if len(h) else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), one row per document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def _pairs_below(fp: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, budget: int, seen: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk pairs of tries together and yield linked index pairs.

    A node is a range of the array `fp`, sorted within each trie: [a0, a1) with [b0, b1), the same range for a trie
    that is joined with itself. In the upper 32 levels half the budget is allowed. seen counts node pairs that were
    split, pruned by the budget, and compared.
    """
    top = _U(63)
    frontier = [(a0, a1, b0, b1, np.zeros(len(a0), np.int64), 0)]
    while frontier:
        a0, a1, b0, b1, err, depth = frontier.pop()
        if len(a0) > 1 << 15:  # bounded memory: the rest waits
            frontier.append((a0[1 << 15 :], a1[1 << 15 :], b0[1 << 15 :], b1[1 << 15 :], err[1 << 15 :], depth))
            a0, a1, b0, b1, err = a0[: 1 << 15], a1[: 1 << 15], b0[: 1 << 15], b1[: 1 << 15], err[: 1 << 15]
        leaf = (a1 - a0) * (b1 - b0) <= LEAF if depth < 64 else np.ones(len(a0), bool)
        if leaf.any():
            seen["compared"] += int(leaf.sum())
            x, y = _compare(fp, a0[leaf], a1[leaf], b0[leaf], b1[leaf], budget)
            if len(x):
                yield x, y
        go = ~leaf
        if not go.any():
            continue
        a0, a1, b0, b1, err = a0[go], a1[go], b0[go], b1[go], err[go]
        seen["split"] += len(a0)
        bit = top - _U(depth)
        am, bm = _split(fp, a0, a1, bit), _split(fp, b0, b1, bit)
        same, allowed = a0 == b0, budget // 2 if depth < 32 else budget
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), (am, a1, b0, bm, err + 1)]
        keep = []
        for k, (p0, p1, q0, q1, e) in enumerate(parts):
            there = (p1 > p0) & (q1 > q0)
            if k == 3:
                there &= ~same  # the mirror of the third
            ok = there & (e <= allowed)
            seen["pruned"] += int(there.sum() - ok.sum())
            keep.append((p0[ok], p1[ok], q0[ok], q1[ok], e[ok]))
        frontier.append((*(np.concatenate(c) for c in zip(*keep)), depth + 1))


def _split(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First index of each sorted range whose `bit` is set (all higher bits are equal in a range)."""
    one = _U(1)
    out = np.where((fp[lo] >> bit) & one == one, lo, hi)  # mostly one side has all
    mixed = np.flatnonzero((out == hi) & ((fp[hi - 1] >> bit) & one == one))
    lo, hi = lo[mixed], hi[mixed]
    while len(lo) and (lo < hi).any():
        mid = (lo + hi) >> 1
        is_set = ((fp[np.minimum(mid, len(fp) - 1)] >> bit) & one == one) | (lo >= hi)
        hi, lo = np.where(is_set, np.minimum(mid, hi), hi), np.where(is_set, lo, mid + 1)
    out[mixed] = lo
    return out


def _products(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of each [a0, a1) x [b0, b1), in portions of about `most` at most."""
    rows = np.maximum(1, most // np.maximum(b1 - b0, 1))
    if (a1 - a0 > rows).any():  # long sides in pieces
        pieces = -(-(a1 - a0) // rows)
        k = np.repeat(np.arange(len(a0)), pieces)
        at = a0[k] + (np.arange(len(k)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * rows[k]
        a0, a1, b0, b1 = at, np.minimum(at + rows[k], a1[k]), b0[k], b1[k]
    n = (a1 - a0) * (b1 - b0)
    at, ends = 0, np.cumsum(n)
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        s, m = slice(at, to), n[at:to]
        k = np.repeat(np.arange(len(m)), m)
        off = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        wide = (b1[s] - b0[s])[k]
        yield a0[s][k] + off // wide, b0[s][k] + off % wide
        at = to


def _compare(fp: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for x, y in _products(a0, a1, b0, b1):
        ok = (np.bitwise_count(fp[x] ^ fp[y]) <= budget) & (x != y)
        found.append((x[ok], y[ok]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, int), np.empty(0, int))


class _Forest:
    """Union-find over array indices; the least index of a set is its root."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        root = self.root
        while len(x):
            rx, ry = root[x], root[y]
            differ = rx != ry
            x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
            if not len(x):
                return
            np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
            while True:  # every chain to its end
                up = root[root]
                if (up == root).all():
                    break
                root = self.root = up


def _sides(key: np.ndarray, side: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """An order by group, side and fingerprint, and in it the two ranges of each group that has both.

    side: 0 and 1 are joined with each other, 2 with itself.
    """
    order = np.lexsort((fp, side, key))
    key, side = key[order], side[order]
    if not len(key):
        return order, (np.empty(0, int),) * 4
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (side[1:] != side[:-1])])
    end = np.r_[first[1:], len(key)]
    own = (side[first] == 2) & (end - first > 1)
    both = np.r_[(key[first][:-1] == key[first][1:]) & (side[first][:-1] == 0) & (side[first][1:] == 1), False]
    other = np.where(both, np.minimum(np.arange(len(first)) + 1, len(first) - 1), np.arange(len(first)))
    some = own | both
    return order, (first[some], end[some], first[other][some], end[other][some])


def trie_links(key: np.ndarray, side: np.ndarray, fp: np.ndarray, budget: int = BUDGET, seen: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints of equal key as a forest: (fp, least fp reached in its group), as unsigned.

    Links whose upper 32 bits differ in more than half the budget are left to the trie of the other half.
    key: groups, in any order; side as in `_sides`. seen: gets counts of the walk.
    """
    order, ranges = _sides(key, side, fp)
    fp = fp[order]
    forest = _Forest(len(fp))
    for x, y in _pairs_below(fp, *ranges, budget, {"split": 0, "pruned": 0, "compared": 0} if seen is None else seen):
        forest.link(x, y)
    hung = np.flatnonzero(forest.root != np.arange(len(fp)))
    return fp[hung], fp[forest.root[hung]]


def _by_unit_pair(rows: DataFrame, payload: list[str], make, schema: str) -> DataFrame:  # noqa: ANN001
    """Give each (key, lo, hi) of `rows` whole to one call of make(group numbers, side, *payload columns), which gives batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        n = 0

        def done(parts: list[list[np.ndarray]]) -> Iterable[pa.RecordBatch]:
            k, lo, hi, side, *rest = (np.concatenate(c) for c in zip(*parts))
            group = np.cumsum(np.r_[0, (k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            return make(group, side, *rest)

        for b in batches:  # sorted, so that a group is contiguous; whole groups are walked together
            if not b.num_rows:
                continue
            cols = [c.to_numpy() for c in b.columns]
            if n > 1 << 15:
                k, lo, hi = (kept[-1][i][-1] for i in range(3))
                new = np.flatnonzero((cols[0] != k) | (cols[1] != lo) | (cols[2] != hi))
                if len(new):
                    kept.append([c[: new[0]] for c in cols])
                    yield from done(kept)
                    kept, n, cols = [], 0, [c[new[0] :] for c in cols]
            kept.append(cols)
            n += len(cols[0])
        if kept:
            yield from done(kept)

    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").select("key", "lo", "hi", "side", *payload).mapInArrow(run, schema)


def _turned(fp: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Fingerprints with their halves exchanged where t is 1."""
    return np.where(t == 1, (fp << _U(32)) | (fp >> _U(32)), fp)


def fingerprint_links(distinct: DataFrame, budget: int = BUDGET, chunk: int = CHUNK) -> DataFrame:
    """Distinct fingerprints (fp long) to edges (u, v) that connect exactly what links within `budget` bits connect."""
    depth = max(LEVELS, math.ceil(math.log2(max(distinct.count(), 1) / chunk)))
    swapped = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    rows = distinct.select(F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("key"), x.alias("fp")) for t, x in enumerate((F.col("fp"), swapped))])).alias("r")).select("r.*")
    rows = rows.withColumn("prefix", F.shiftrightunsigned("fp", 64 - depth))
    nodes = rows.groupBy("key", "prefix").agg(F.ceil(F.count(F.lit(1)) / (2 * chunk)).cast("int").alias("chunks"))
    nodes = cut(nodes.select(F.col("key").alias("k"), F.col("prefix").alias("p"), "chunks"), "trie-nodes")
    there = (F.col("key") == F.col("k")) & (F.col("prefix") == F.col("p"))
    rows = join_small(rows, nodes, there).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks"))).select("key", "fp", F.col("prefix").alias("own"), "c")
    # the prefixes within the budget: their number depends on the depth and the budget alone
    near = F.array(*[F.lit(m).cast("long") for m in range(1 << depth) if m.bit_count() <= budget // 2])
    rows = join_small(rows.withColumn("mask", F.explode(near)).withColumn("prefix", F.col("own").bitwiseXOR(F.col("mask"))), nodes, there)
    rows = rows.select("key", "fp", "own", "c", "prefix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("oc"))
    me, it = (F.shiftleft(F.col(p), 32).bitwiseOR(F.col(c)) for p, c in (("own", "c"), ("prefix", "oc")))
    side = F.when(me == it, 2).when(me < it, 0).otherwise(1)
    rows = rows.select("key", F.least(me, it).alias("lo"), F.greatest(me, it).alias("hi"), side.alias("side"), F.col("key").alias("t"), "fp")

    def walk(group: np.ndarray, side: np.ndarray, t: np.ndarray, fp: np.ndarray) -> list[pa.RecordBatch]:
        ends = []
        for half in (0, 1):
            of = t == half
            u, v = trie_links(group[of], side[of], fp[of].view(_U), budget)
            ends.append([_turned(x, np.full(len(x), half)).view(np.int64) for x in (u, v)])
        u, v = (np.concatenate(x) for x in zip(*ends))
        return [pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])]

    return _by_unit_pair(rows, ["t", "fp"], walk, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Documents (doc_id, text) to doc_id, fp, component_id (the least doc_id that links reach, itself included).

    Null, empty and blank texts have fingerprint 0 and link like any other; repeated rows stay rows; a null doc_id
    is in a component but never names it unless nothing else does; an empty table gives no rows; other columns are
    ignored.
    """
    fps = cut(fingerprints(docs), "fingerprints")
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = connected_components(fingerprint_links(classes.select("fp"), budget))
    of = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    of = cut(of, "roots")
    names = cut(of.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "r"), "names")
    named = cut(of.join(names, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"), "named")
    return fps.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")

# texts of a given similarity


def shingle_set(text: bytes | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """The distinct XXH64 (seed 42) of word shingles, sorted; null or blank: none."""
    return np.unique(_grams(text, shingle))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; of two empty ones 1."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same) if len(both) else 1.0


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """WIDE words of SimHash of a shingle set: each word from hashes of the hashes."""
    if not len(h):
        return np.zeros(WIDE, _U)
    x = h[:, None] + np.arange(1, WIDE + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return _majority(x ^ (x >> _U(31)))


def expected(bits: int, threshold: float, sigmas: float) -> float:
    """Share of `bits` in which texts of that similarity differ, and so many standard deviations more."""
    p = math.acos(min(1.0, 2 * threshold / (1 + threshold))) / math.pi
    return p + sigmas * math.sqrt(p * (1 - p) / bits)


def trie_orders(n: int, threshold: float = SIMILARITY) -> np.ndarray:
    """Leading bit positions of each trie (tries, levels) for n fingerprints: as many levels as leave some 256
    fingerprints in a node (16 at least), and as many tries as leave a chance of MISSED."""
    levels = max(16, math.ceil(math.log2(max(n, 2))) - 8)
    meet = (1 - expected(64 * WIDE, threshold, 1)) ** levels
    tries = max(1, math.ceil(math.log(MISSED) / math.log(1 - meet))) if meet < 1 else 1
    rng = np.random.default_rng(42)
    return np.stack([rng.permutation(64 * WIDE)[:levels] for _ in range(tries)])


def nearest_in_group(group: np.ndarray, side: np.ndarray, fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs: each row with the nearest other row of its group (the first of equals), if within the budget."""
    order, ranges = _sides(group, side, fp)
    fp = fp[order]
    none = np.iinfo(np.int64).max
    best = np.full(len(fp), none)
    for x, y in _products(*ranges):
        d = np.bitwise_count(fp[x] ^ fp[y]).astype(np.int64)
        ok = (d <= budget) & (x != y)
        x, y, d = x[ok], y[ok], d[ok] << 40
        np.minimum.at(best, x, d + y)
        np.minimum.at(best, y, d + x)
    at = np.flatnonzero(best < none)
    return order[at], order[best[at] & ((1 << 40) - 1)]


def _named() -> list[Column]:
    """What tells rows apart, up to rows of one id and text."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest")]


def prefix(h: np.ndarray, frequent: np.ndarray, rank: np.ndarray, threshold: float = SIMILARITY) -> np.ndarray:
    """The first shingles of a set (sorted) in the order of all, of which every set as similar holds one of its own first.

    First come those not in `frequent` (sorted), then the others by their rank. Of sets that share at least m of n
    shingles, the first one shared is within the first n - m + 1.
    """
    n = len(h) - math.ceil(threshold * len(h) - 1e-6) + 1 if len(h) else 0
    if not len(frequent):
        return h[:n]
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    last = frequent[at] == h
    first = h[~last][:n]
    if len(first) == n:
        return first
    return np.concatenate([first, h[last][np.argsort(rank[at[last]], kind="stable")]])[:n]


def odd_bits(h: np.ndarray) -> np.ndarray:
    """Bytes of a bitmap, of two bits or more a shingle, that tells which of its slots hold an odd number of the set.

    Where two such maps differ, the sets differ too; a map is folded to half its size by an exclusive or of its halves.
    """
    size = 1 << max(6, (2 * len(h) - 1).bit_length()) if len(h) else 64
    return np.packbits(np.bincount((h & _U(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little")


def differ(a: np.ndarray, b: np.ndarray) -> int:
    """At least so many shingles are in one of two sets alone, by their `odd_bits`."""
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def frequent_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts of a sample (about SAMPLE distinct texts), sorted, and in how many texts each may be."""
    text = docs.select(F.col("text").cast("binary").alias("t"), F.xxhash64("text").alias("h")).where("t IS NOT NULL")
    share = max(1, text.agg(F.approx_count_distinct("h")).first()[0] // SAMPLE)

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x.as_py(), shingle).view(np.int64))], ["g"])

    one = text.where(F.pmod("h", F.lit(share)) == 0).groupBy("h").agg(F.first("t").alias("t"))
    most = one.select("t").mapInArrow(grams, "g long").groupBy("g").count().where("count > 1").orderBy(F.desc("count"), "g").limit(FREQUENT).toArrow()
    g, n = most.column("g").to_numpy().view(_U), most.column("count").to_numpy()
    order = np.argsort(g)
    return g[order], n[order] * share


def _wide(docs: DataFrame, shingle: int, threshold: float, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
    """doc_id, digest of the text, class (a hash of its shingle set), and of that set fp (its fingerprint's words), n (its
    size), odd (`odd_bits`) and first (`prefix`), one row per document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                sets = [shingle_set(x.as_py(), shingle) for x in b.column(2)]
                key = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], _U).view(np.int64)
                odd = pa.array([odd_bits(h).tobytes() for h in sets], pa.binary())
                rest = [lists([wide_fingerprint(h) for h in sets]), pa.array([len(h) for h in sets], pa.int32()), odd, lists([prefix(h, frequent, rank, threshold) for h in sets])]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key), *rest], ["doc_id", "digest", "class", "fp", "n", "odd", "first"])

    return docs.select(*_named(), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, digest string, class long, fp array<long>, n int, odd binary, first array<long>")


def candidates(classes: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Classes (class, fp) to pairs (u > v) with d, the bits in which they differ.

    In each trie every class meets those that share its node, and is paired with the nearest of them.
    """
    orders = trie_orders(classes.count(), threshold)
    first, whole = (int(bits * expected(bits, threshold, APART)) for bits in (64, 64 * WIDE))

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _U(1) << np.arange(orders.shape[1], dtype=_U)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                words = b.column(1).flatten().to_numpy().reshape(-1, WIDE)
                bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little").astype(_U)
                key = np.concatenate([bits[:, o] @ powers + _U(t << 52) for t, o in enumerate(orders)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.tile(b.column(0).to_numpy(), len(orders))), pa.array(np.tile(words[:, 0], len(orders)))], ["key", "class", "f"])

    def meet(group: np.ndarray, side: np.ndarray, cls: np.ndarray, f: np.ndarray) -> list[pa.RecordBatch]:
        x, y = nearest_in_group(group, side, f.view(_U), first)
        pairs = np.unique(np.stack([np.maximum(cls[x], cls[y]), np.minimum(cls[x], cls[y])]), axis=1) if len(x) else np.empty((2, 0), np.int64)
        return [pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])]

    posted = cut(classes.select("class", "fp").mapInArrow(post, "key long, class long, f long"), "tries")
    sizes = cut(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * CHUNK).select(F.col("key").alias("k"), F.ceil(F.col("n") / (2 * CHUNK)).cast("int").alias("chunks")), "trie-sizes")
    rows = join_small(posted, sizes, F.col("key") == F.col("k"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    c, other = F.pmod(F.xxhash64("class"), F.col("chunks")).cast("long"), F.col("oc").cast("long")
    rows = rows.select("key", "class", "f", c.alias("c"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("oc"))
    rows = rows.select("key", "class", "f", F.least("c", other).alias("lo"), F.greatest("c", other).alias("hi"), F.when(F.col("c") == other, 2).when(F.col("c") < other, 0).otherwise(1).alias("side"))
    pairs = cut(_by_unit_pair(rows, ["class", "f"], meet, "u long, v long").distinct(), "node-pairs")
    ends = lambda x: classes.select(F.col("class").alias(f"k{x}"), F.col("fp").alias(x))
    both = pairs.join(ends("a"), F.col("u") == F.col("ka")).join(ends("b"), F.col("v") == F.col("kb"))
    d = F.aggregate(F.zip_with("a", "b", lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("int")), F.lit(0), lambda p, q: p + q)
    return both.select("u", "v", d.alias("d")).where(F.col("d") <= whole)


def earlier_least(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of the shingles before each one in its row of `first` (rows of so many): the least in each of MET classes; 0: none."""
    none = _U(0xFFFFFFFFFFFFFFFF)
    own = np.where((first % _U(MET))[:, None] == np.arange(MET, dtype=_U), first[:, None], none)
    out = np.full((len(first), MET), none)
    ends = np.cumsum(many)
    for a, b in zip((ends - many).tolist(), ends.tolist()):
        if b - a > 1:
            np.minimum.accumulate(own[a : b - 1], axis=0, out=out[a + 1 : b])
    out[out == none] = 0
    return out


def _across(group: np.ndarray, side: np.ndarray, root: np.ndarray, room: np.ndarray, n: np.ndarray, threshold: float, earlier: tuple[np.ndarray, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one group and different roots that may be similar, for all that is known of one shingle.

    room: shingles of the row's set (of n) from that one on, in the order of all. Sides 0 and 1 have no roots in common.
    earlier: columns of `earlier_least`. Rows that have one in common met under that shingle too, with more room, and are
    no pair here; under the first shingle that two rows share, they have none in common.
    """
    order = np.lexsort((root, side, group))
    earlier = [e[order] for e in earlier]
    group, side, root, room, n = group[order], side[order], root[order], room[order], n[order]
    new = lambda *cols: np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)])
    block = new(group, side, root)
    ends = np.r_[block[1:], len(group)]
    end = np.r_[new(group)[1:], len(group)][np.searchsorted(new(group), block, side="right") - 1]
    # a block meets the blocks after it: on its own side (2), or on the other one (0)
    other = np.r_[new(group, side), len(group)]
    start = np.where(side[block] == 2, ends, other[np.searchsorted(other, block, side="right")])
    some = (side[block] != 1) & (start < end)
    share = threshold / (1 + threshold)
    for x, y in _products(block[some], ends[some], start[some], end[some]):
        ok = np.minimum(room[x], room[y]) >= (n[x] + n[y]) * share - 1e-6
        x, y = x[ok], y[ok]
        for e in earlier:
            ok = (e[x] != e[y]) | (e[x] == 0)
            x, y = x[ok], y[ok]
        yield order[x], order[y]


def left_pairs(classes: DataFrame, roots: DataFrame, frequent: dict[int, int], threshold: float = SIMILARITY) -> DataFrame:
    """All pairs (u > v) of classes (class, n, odd, first) of different roots (node, root; others: themselves) that may be
    similar, with d, the least number of shingles in which they differ. No similar pair is missing.

    frequent: the parts into which classes under one shingle are dealt by their roots, where it is not 1.
    """
    met = [f"met{i}" for i in range(MET)]
    limit = 1 - 2 * threshold / (1 + threshold)  # of both sizes: shingles that similar sets do not share

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                many = b.column(3).value_lengths().to_numpy()
                row = np.repeat(np.arange(b.num_rows), many)
                key = b.column(3).flatten().to_numpy()
                cls, root, n = (b.column(i).to_numpy() for i in range(3))
                room = n[row] - (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32)
                lo = np.zeros(len(row), np.int32)
                cols = [key, lo, lo, lo + np.int32(2), root[row], cls[row], room, n[row], *earlier_least(key.view(_U), many).view(np.int64).T]
                if frequent:
                    parts = np.fromiter((frequent.get(k, 1) for k in key.tolist()), np.int64, len(key))
                    i = np.repeat(np.arange(len(key)), parts)
                    other = np.arange(len(i)) - np.repeat(np.cumsum(parts) - parts, parts)
                    own = (root[row].view(_U)[i] * _U(0x9E3779B97F4A7C15) >> _U(33)).astype(np.int64) % parts[i]
                    sides = np.where(own == other, 2, np.where(own < other, 0, 1))
                    cols = [key[i], *(x.astype(np.int32) for x in (np.minimum(own, other), np.maximum(own, other), sides)), *(c[i] for c in cols[4:])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "lo", "hi", "side", "root", "class", "room", "n", *met])

    def meet(group: np.ndarray, side: np.ndarray, root: np.ndarray, cls: np.ndarray, room: np.ndarray, n: np.ndarray, *earlier: np.ndarray) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(held, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

        for x, y in _across(group, side, root, room, n, threshold, earlier):
            if len(x):
                held.append(np.stack([np.maximum(cls[x], cls[y]), np.minimum(cls[x], cls[y])]))
                size += len(x)
            if size > 1 << 20:  # bounded memory
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, n = b.column(2), b.column(3), b.column(4).to_numpy()
            d = np.fromiter((differ(np.frombuffer(x[i].as_py(), np.uint8), np.frombuffer(y[i].as_py(), np.uint8)) for i in range(b.num_rows)), np.int64, b.num_rows)
            ok = np.flatnonzero(d <= n * limit + 1e-6)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), b.column(1).take(pa.array(ok)), pa.array(d[ok])], ["u", "v", "d"])

    rows = classes.join(roots, F.col("class") == F.col("node"), "left").select("class", F.coalesce("root", "class").alias("root"), "n", "first")
    rows = rows.mapInArrow(post, "key long, lo int, hi int, side int, root long, class long, room int, n int" + "".join(f", {x} long" for x in met))
    pairs = cut(_by_unit_pair(rows, ["root", "class", "room", "n", *met], meet, "u long, v long").distinct(), "shingle-pairs")
    ends = lambda x: classes.select(F.col("class").alias(f"k{x}"), F.col("odd").alias(x), F.col("n").cast("long").alias(f"n{x}"))
    both = pairs.join(ends("a"), F.col("u") == F.col("ka")).join(ends("b"), F.col("v") == F.col("kb"))
    return both.select("u", "v", "a", "b", F.col("na") + F.col("nb")).mapInArrow(near, "u long, v long, d long")


def _confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs (u, v) of classes whose shingle sets are similar enough."""

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(x.as_py(), shingle).tobytes() for x in b.column(1)], pa.binary())], ["class", "grams"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            ok = [similarity(np.frombuffer(x[i].as_py(), _U), np.frombuffer(y[i].as_py(), _U)) >= threshold for i in range(b.num_rows)]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    ends = pairs.select(F.explode(F.array("u", "v")).alias("k")).distinct()
    one = sets.join(ends, F.col("class") == F.col("k"), "left_semi").groupBy("class").agg(F.min(F.struct("digest")).alias("r")).select(F.col("class").alias("__class"), F.col("r.digest").alias("__digest"))
    one = cut(one, "ends")
    texts = join_small(docs.select(F.col("text").cast("binary").alias("t"), F.md5(F.coalesce("text", F.lit(""))).alias("digest")), one, F.col("digest") == F.col("__digest"))
    known = cut(texts.dropDuplicates(["__class"]).select("__class", "t").mapInArrow(grams, "class long, grams binary"), "end-sets")
    side = lambda x: known.select(F.col("class").alias(f"k{x}"), F.col("grams").alias(x))
    both = pairs.join(side("a"), F.col("u") == F.col("ka")).join(side("b"), F.col("v") == F.col("kb"))
    return both.select("u", "v", "a", "b").mapInArrow(compare, "u long, v long")


def _joined(open_: DataFrame, roots: DataFrame | None, rounds: tuple[int | None, ...], sets: DataFrame, docs: DataFrame, shingle: int, threshold: float) -> DataFrame | None:
    """The roots (node, root) after all pairs of `open_` (u, v, d) that are similar and join two groups have joined them.

    rounds: how much further apart than the nearest of either end the pairs of a round are; None: all that are left.
    """
    start = mark()  # what is written from here on goes as soon as it was read
    of = lambda x, r: r.select(F.col("node").alias(f"n{x}"), F.col("root").alias(f"r{x}"))
    for more in rounds:
        if not open_.limit(1).count():
            break
        tried = open_
        if more is not None:
            ends = open_.select(F.col("u").alias("n"), "d").unionByName(open_.select(F.col("v").alias("n"), "d"))
            least = cut(ends.groupBy("n").agg(F.min("d").alias("least")), "nearest")
            near = lambda x: least.select(F.col("n").alias(f"n{x}"), (F.col("least") + more).alias(f"m{x}"))  # noqa: E731, B023
            tried = open_.join(near("u"), F.col("u") == F.col("nu")).join(near("v"), F.col("v") == F.col("nv"))
            tried = cut(tried.where(F.col("d") <= F.greatest("mu", "mv")).select("u", "v", "d"), "tried")
        found = _confirmed(tried.select("u", "v"), sets, docs, shingle, threshold)
        if roots is not None:  # links between groups, by their names
            found = found.join(of("u", roots), F.col("u") == F.col("nu"), "left").join(of("v", roots), F.col("v") == F.col("nv"), "left")
            found = found.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
        joined = cut(connected_components(found), "joined")
        if roots is None:
            roots = joined
        else:
            again = roots.join(of("x", joined), F.col("root") == F.col("nx"), "left").select("node", F.coalesce("rx", "root").alias("root"))
            roots = cut(again.unionByName(joined.join(roots.select("node"), "node", "left_anti")), "row-roots")
        forget(start, open_, tried, roots)
        if more is not None:
            left = open_.join(tried.select("u", "v"), ["u", "v"], "left_anti")
            left = left.join(of("u", roots), F.col("u") == F.col("nu"), "left").join(of("v", roots), F.col("v") == F.col("nv"), "left")
            open_ = cut(left.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v", "d"), "candidates")
            forget(start, open_, roots)
    return roots


def row_roots(docs: DataFrame, shingle: int = WIDE_SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, digest of the text and root (a name of the row's group) of every row of (doc_id, text).

    Candidates are confirmed by their shingle sets in three rounds: those as near as a class's nearest, those within
    NEXT bits more, and the rest; after each round only pairs that would still join two groups are left. So a large
    group of near copies costs some comparisons a member, and pairs are compared whole only if nothing else joins them.
    What the tries paired with something nearer is among the pairs of two groups that `left_pairs` then gives in full.
    """
    start = mark()  # what is written from here on goes as soon as it was read
    frequent, rank = frequent_shingles(docs, shingle)
    wide = cut(_wide(docs, shingle, threshold, frequent, rank), "wide")
    classes = cut(wide.groupBy("class").agg(*(F.first(c).alias(c) for c in ("fp", "n", "odd", "first"))), "classes")
    sets = cut(wide.select("doc_id", "digest", "class"), "sets")
    forget(start, classes, sets)
    open_ = cut(candidates(classes, threshold), "candidates")
    forget(start, classes, sets, open_)
    roots = _joined(open_, None, (0, NEXT, None), sets, docs, shingle, threshold)
    forget(start, classes, sets, roots)
    none = classes.select(F.col("class").alias("node"), F.col("class").alias("root")).limit(0)
    parts = {g: -(-n // (2 * CHUNK)) for g, n in zip(frequent.view(np.int64).tolist(), rank.tolist()) if n > 2 * CHUNK}
    open_ = cut(left_pairs(classes, none if roots is None else roots, parts, threshold), "left-pairs")
    forget(start, sets, roots, open_)
    roots = _joined(open_, roots, (0, None), sets, docs, shingle, threshold)
    if roots is None:
        return sets.select("doc_id", "digest", F.col("class").alias("root"))
    rows = sets.select("doc_id", "digest", "class").join(roots, F.col("class") == F.col("node"), "left")
    rows = cut(rows.select("doc_id", "digest", F.coalesce("root", "class").alias("root")), "row-roots")
    forget(start, rows)
    return rows


def similar_classes(docs: DataFrame, shingle: int = WIDE_SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """Documents (doc_id, text) to doc_id, component_id (the least doc_id that links reach, itself included).

    Links are pairs with Jaccard similarity of their sets of word shingles of at least `threshold`, each confirmed;
    none is missed. Texts without words link with each other; a null doc_id is in a component but never names it unless nothing else does; an empty
    table gives no rows; other columns are ignored.
    """
    rows = row_roots(docs, shingle, threshold)
    names = cut(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("root", "r"), "names")
    return rows.join(names, F.col("root") == F.col("r")).select("doc_id", "component_id")


def drop_duplicates(docs: DataFrame, shingle: int = WIDE_SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that stay, one of each group: that of the least doc_id, null ids last; columns unchanged.

    Of several rows with that id, or of rows without one, the least by all columns stays.
    """
    rows = row_roots(docs, shingle, threshold)
    names = cut(rows.groupBy("root").agg(F.min("doc_id").alias("least")).withColumnRenamed("root", "r"), "names")
    first = rows.join(names, (F.col("root") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("least")))
    first = cut(first.groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n")), "first")
    size = cut(first.groupBy("root").agg(F.sum("n").alias("__n")).withColumnRenamed("root", "r"), "sizes")
    stay = first.join(size, F.col("root") == F.col("r")).select(F.col("root").alias("__root"), F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "__n")
    stay = cut(stay, "stay")
    ident, digest = _named()
    found = join_small(docs, stay, ident.eqNullSafe(F.col("__id")) & (digest == F.col("__digest")))
    out = found.where("__n = 1").select(*docs.columns)
    if stay.where("__n > 1").limit(1).count():
        least = found.where("__n > 1").groupBy("__root").agg(F.min(F.struct(*docs.columns)).alias("r"))
        out = out.unionByName(least.select("r.*"))
    return out
