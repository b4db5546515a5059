"""Positional operators against plain Python, in every strategy."""

import bisect
import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from ordwise.operators import compact, intervals, joins, numeric, scan, search, sets, sorting
from ordwise.operators import reduce as red
from ordwise.operators.monoid import ADD, MAX, MEAN, MIN
from ordwise.sources.tables import from_values, to_values

#: A published example of an exclusive and an inclusive scan begins so.
SCAN_IN, SCAN_EXCLUSIVE = [1, 7, 4, 0], [0, 1, 8, 12]


def test_scan_golden(spark):
    df = from_values(spark, SCAN_IN)
    assert to_values(scan.scan(df, "v"), "scanned") == SCAN_EXCLUSIVE
    assert to_values(scan.scan(df, "v", kind="inclusive"), "scanned") == [1, 8, 12, 12]
    assert to_values(scan.scan(df, "v", total_at_end=True), "scanned") == [*SCAN_EXCLUSIVE, 12]


@pytest.mark.parametrize("n", [0, 1, 12, 1200, 8193])
@pytest.mark.parametrize("strategy", ["single", "bucket", "range"])
def test_scans(spark, n, strategy):
    rng = random.Random(n)
    v = [rng.randint(-9, 9) for _ in range(n)]
    df = from_values(spark, v)
    run = lambda m, k: to_values(scan.scan(df, "v", m, k, strategy=strategy, bucket=100), "scanned")
    assert run(ADD, "inclusive") == list(accumulate(v))
    assert run(ADD, "exclusive") == [0, *accumulate(v)][:n]
    assert run(MIN, "exclusive") == [2**63 - 1, *accumulate(v, min)][:n]
    assert run(MAX, "inclusive") == list(accumulate(v, max))


@pytest.mark.parametrize("n", [0, 1, 513])
def test_reduce(spark, n):
    v = list(range(n))
    df = from_values(spark, v)
    one = lambda m: red.reduce(df, "v", m).first()[0]
    assert (one(ADD), one(MIN), one(MAX)) == (sum(v), min(v, default=2**63 - 1), max(v, default=-(2**63)))
    assert one(MEAN) == (sum(v) / n if n else None)
    runs = red.reduce_by_run(df.withColumn("k", F.floor(F.col("v") / 4) % 2), "k", "v", ADD).orderBy("run").collect()
    assert [r.result for r in runs] == [sum(v[i : i + 4]) for i in range(0, n, 4)]


def test_insert_and_remove(spark):
    b = from_values(spark, range(100))
    kept = compact.bulk_remove(b, from_values(spark, range(1, 100, 3)).select(F.col("v").alias("pos")))
    assert to_values(kept) == [x for x in range(100) if x % 3 != 1]
    at = [0, 3, 3, 50, 100]
    a = spark.createDataFrame([(k, i, 1000 + k) for k, i in enumerate(at)], "pos long, i long, v long")
    want = list(range(100))
    for k in reversed(range(len(at))):
        want.insert(at[k], 1000 + k)
    assert to_values(compact.bulk_insert(a, b)) == want
    assert compact.bulk_insert(a, b.limit(0)).count() == 5 and to_values(compact.bulk_insert(a.limit(0), b)) == list(range(100))


@pytest.mark.parametrize("strategy", ["single", "bucket", "range"])
def test_sorted_search(spark, strategy):
    rng = random.Random(7)
    hay, needles = sorted(rng.randint(0, 99) for _ in range(200)), [rng.randint(-5, 110) for _ in range(100)]
    n, h = from_values(spark, needles, name="k"), from_values(spark, hay, name="k")
    for bound, f in (("lower", bisect.bisect_left), ("upper", bisect.bisect_right)):
        got = search.sorted_search(n, h, bound=bound, strategy=strategy).orderBy("pos").collect()
        assert [r.idx for r in got] == [f(hay, x) for x in needles]
        assert [r.matched for r in got] == [x in set(hay) for x in needles]
    assert {r.idx for r in search.sorted_search(n, h.limit(0)).collect()} == {0}


def test_expand_move_and_balance(spark):
    counts = [3, 0, 1, 40000, 2]
    df = spark.createDataFrame([(i, c, i * 10, i * 5, i * 50000) for i, c in enumerate(counts)], "pos long, count long, v long, gather_start long, scatter_start long")
    want = [i for i, c in enumerate(counts) for _ in range(c)]
    assert to_values(search.load_balance(df), "owner", "slot") == want
    assert to_values(intervals.interval_expand(df)) == [i * 10 for i in want]
    data = from_values(spark, range(50000))
    moved = {r.pos: r.v for r in intervals.interval_move(df, data).collect()}
    assert moved == {i * 50000 + r: i * 5 + r for i, c in enumerate(counts) for r in range(c)}
    assert search.load_balance(df.limit(0)).count() == 0


@pytest.mark.parametrize("strategy", ["single", "range"])
def test_sort_and_merge_are_stable(spark, strategy):
    rng = random.Random(5)
    k = [rng.randint(0, 5) for _ in range(300)]
    df = spark.createDataFrame([(i, x, i) for i, x in enumerate(k)], "pos long, k long, v long")
    assert to_values(sorting.sort_pairs(df, strategy=strategy), "v", "out") == sorted(range(300), key=lambda i: k[i])
    assert to_values(sorting.sort_pairs(df, descending=True, strategy=strategy), "v", "out") == sorted(range(300), key=lambda i: -k[i])
    a, b = sorted(k[:100]), sorted(k[100:])
    left = spark.createDataFrame([(i, x, i) for i, x in enumerate(a)], "pos long, k long, v long")
    right = spark.createDataFrame([(i, x, 100 + i) for i, x in enumerate(b)], "pos long, k long, v long")
    want = sorted([(x, 0, i, i) for i, x in enumerate(a)] + [(x, 1, i, 100 + i) for i, x in enumerate(b)])
    assert to_values(sorting.merge_pairs(left, right), "v", "out") == [w[3] for w in want]


def test_multisets(spark):
    a, b = [1, 1, 1, 2, 5, 5], [1, 2, 2, 2, 7]
    of = lambda x, s: spark.createDataFrame([(i, k, s + i) for i, k in enumerate(x)], "pos long, k long, v long")
    keys = {"intersection": [1, 2], "union": [1, 1, 1, 2, 2, 2, 5, 5, 7], "difference": [1, 1, 5, 5], "symmetric": [1, 1, 2, 2, 5, 5, 7]}
    for op, want in keys.items():
        assert sorted(r.k for r in sets.set_keys(of(a, 0), of(b, 100), op).collect()) == want
        pairs = sets.set_pairs(of(a, 0), of(b, 100), op, ranked=True).orderBy("out").collect()
        assert [r.k for r in pairs] == want
    assert [r.v for r in sets.set_pairs(of(a, 0), of(b, 100), "difference", ranked=True).orderBy("out").collect()] == [1, 2, 4, 5]


def test_joins_with_empty_and_null_sides(spark):
    a = spark.createDataFrame([(0, 1), (1, 2), (2, 2), (3, None)], "pos long, k long")
    b = spark.createDataFrame([(0, 2), (1, 2), (2, 9), (3, None)], "pos long, k long")
    pairs = lambda kind: [(r.a_pos, r.b_pos) for r in joins.relational_join(a, b, kind, ordered=True, sentinel=-1).orderBy("rank").collect()]
    both = [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert pairs("inner") == both
    assert pairs("left") == [(0, -1), *both, (3, -1)]
    assert pairs("right") == [*both, (-1, 2), (-1, 3)]
    assert pairs("full") == [(0, -1), *both, (3, -1), (-1, 2), (-1, 3)]
    assert joins.relational_join(a.limit(0), b, "left").count() == 0


def test_scatter_refuses_two_rows_for_one_place(spark):
    df = spark.createDataFrame([(0, 5, 1), (1, 5, 2)], "pos long, i long, v long")
    with pytest.raises(ValueError, match="not unique"):
        compact.scatter(df)


def test_sobol_points_fill_every_cell(spark):
    rows = numeric.sobol(spark, 64, 6).collect()
    for d in range(6):
        assert sorted(int(r.u * 64) for r in rows if r.dim == d) == list(range(64))


def test_generators_jump_and_repeat(spark):
    first = [r.value for r in numeric.mrg32k3a(spark, 2, 10, jump=5).orderBy("stream", "step").collect()]
    assert first[5:10] == first[10:15]
    normal = [r.value for r in numeric.mrg32k3a(spark, 4, 1000, distribution="normal").collect()]
    assert abs(sum(normal) / len(normal)) < 0.1 and len(normal) == 4000
    later = [r.value for r in numeric.xorshift7(spark, 1, 5, skip=5).orderBy("step").collect()]
    assert [r.value for r in numeric.xorshift7(spark, 1, 10).orderBy("step").collect()][5:] == later
