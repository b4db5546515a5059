"""Numeric workloads: matrix product, tridiagonal systems, quasi-random and pseudo-random numbers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows, columns and inner places of a block of a matrix product.
SIDE = 1024


def matmul(a: DataFrame, b: DataFrame, side: int = SIDE) -> DataFrame:
    """The product of matrices given as (i, k, v) and (k, j, v): i, j, v. Absent entries are zero, repeated ones add up.

    Blocks of `side` places meet and are multiplied dense, so what is summed after that are block products, not one
    row for each i, k and j. Each side goes to the blocks of the other that its inner places have. v is a long
    (exact while products fit) or else a double; entries with a null are left out.
    """
    kind = "long" if all(dict(x.dtypes)["v"] in ("tinyint", "smallint", "int", "bigint") for x in (a, b)) else "double"
    at = lambda c: F.floor(F.col(c) / side)
    x = a.dropna().select(at("i").alias("bi"), at("k").alias("bk"), F.col("i").cast("long").alias("o"), F.col("k").cast("long").alias("k"), F.col("v").cast(kind).alias("v"))
    y = b.dropna().select(at("j").alias("bj"), at("k").alias("bk"), F.col("j").cast("long").alias("o"), F.col("k").cast("long").alias("k"), F.col("v").cast(kind).alias("v"))
    to = x.select("bi", "bk").distinct().join(y.select("bj", "bk").distinct(), "bk")  # pairs of blocks, not of entries
    left = x.join(to.select(F.col("bi").alias("ti"), F.col("bk").alias("tk"), "bj"), (F.col("bi") == F.col("ti")) & (F.col("bk") == F.col("tk"))).select("bi", "bj", "bk", "o", "k", "v")
    right = y.join(to.select(F.col("bj").alias("tj"), F.col("bk").alias("tk"), "bi"), (F.col("bj") == F.col("tj")) & (F.col("bk") == F.col("tk"))).select(*[F.col(c).alias(c) for c in ("bi", "bj", "bk", "o", "k", "v")])

    def product(p: pa.Table, q: pa.Table) -> pa.Table:
        (pi, pk, pv), (qj, qk, qv) = ([t.column(c).to_numpy() for c in "okv"] for t in (p, q))
        rows, ri = np.unique(pi, return_inverse=True)
        cols, cj = np.unique(qj, return_inverse=True)
        inner, k = np.unique(np.r_[pk, qk], return_inverse=True)
        m, n = np.zeros((len(rows), len(inner)), pv.dtype), np.zeros((len(inner), len(cols)), qv.dtype)
        np.add.at(m, (ri, k[: len(pk)]), pv)
        np.add.at(n, (k[len(pk) :], cj), qv)
        held = [np.zeros(x.shape, np.float32) for x in (m, n)]
        held[0][ri, k[: len(pk)]] = 1
        held[1][k[len(pk) :], cj] = 1
        r, c = np.nonzero(held[0] @ held[1])  # pairs that meet in some inner place have an entry, be it 0
        return pa.table({"i": rows[r], "j": cols[c], "v": (m @ n)[r, c]})

    keys = ("bi", "bj", "bk")
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(product, f"i long, j long, v {kind}")
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


def solve_tridiagonal(systems: DataFrame) -> DataFrame:
    """(sys_id long, l, d, u, b arrays of one length) to (sys_id, x): l below, d on and u above the diagonal.

    Elimination without pivoting, vectorized over systems of equal size in a batch; l[0] and u[-1] are not read. A
    null array gives null, an empty system an empty x; a zero pivot gives non-finite numbers.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            out: list = [None] * batch.num_rows
            sizes: dict[int, list[int]] = {}
            for r in range(batch.num_rows):
                if all(cols[c][r] is not None for c in range(1, 5)):
                    sizes.setdefault(len(cols[2][r]), []).append(r)
            for n, at in sizes.items():
                low, dia, up, rhs = (np.array([cols[c][r] for r in at], float).reshape(len(at), n) for c in range(1, 5))
                x = np.zeros((len(at), n))
                with np.errstate(all="ignore"):
                    for i in range(1, n):
                        m = low[:, i] / dia[:, i - 1]
                        dia[:, i] -= m * up[:, i - 1]
                        rhs[:, i] -= m * rhs[:, i - 1]
                    for i in range(n - 1, -1, -1):
                        x[:, i] = (rhs[:, i] - (up[:, i] * x[:, i + 1] if i + 1 < n else 0)) / dia[:, i]
                for r, v in zip(at, x.tolist()):
                    out[r] = v
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["sys_id", "x"])

    kind = "array<double>"
    return systems.select(F.col("sys_id").cast("long"), *[F.col(c).cast(kind) for c in "ldub"]).mapInArrow(run, f"sys_id long, x {kind}")


@cache
def _primitive_polynomials(count: int) -> list[tuple[int, int]]:
    """(degree, inner coefficients) of the first primitive polynomials over two elements, by degree and value."""
    out, degree = [], 1
    while len(out) < count:
        order = (1 << degree) - 1
        factors = {p for p in range(2, order + 1) if order % p == 0 and all(p % q for q in range(2, int(p**0.5) + 1))}

        def power(e: int, poly: int, degree: int = degree) -> int:
            result, base = 1, 2 if degree > 1 else 1
            while e:
                if e & 1:
                    result = _times(result, base, poly, degree)
                base, e = _times(base, base, poly, degree), e >> 1
            return result

        for inner in range(1 << max(0, degree - 1)):
            if inner.bit_count() % 2 == 0 and degree > 1:
                continue  # an even number of terms has a factor
            poly = (1 << degree) | (inner << 1) | 1
            if power(order, poly) == 1 and all(power(order // f, poly) != 1 for f in factors):
                out.append((degree, inner))
        degree += 1
    return out[:count]


def _times(a: int, b: int, poly: int, degree: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a <<= 1
        if a >> degree & 1:
            a ^= poly
        b >>= 1
    return out


def sobol_directions(dims: int, bits: int = 32) -> list[list[int]]:
    """Direction numbers per dimension. The first is van der Corput's; others follow a primitive polynomial each, with
    all initial numbers 1 (any odd ones give a Sobol sequence)."""
    out = [[1 << (bits - 1 - i) for i in range(bits)]]
    for s, a in _primitive_polynomials(dims - 1):
        v = [1 << (bits - 1 - i) for i in range(min(s, bits))]
        for i in range(s, bits):
            x = v[i - s] ^ (v[i - s] >> s)
            for k in range(1, s):
                if a >> (s - 1 - k) & 1:
                    x ^= v[i - k]
            v.append(x)
        out.append(v)
    return out[:dims]


#: Dimensions up to which a point's numbers are one expression.
UNROLLED = 32


def sobol(spark: SparkSession, n: int, dims: int, offset: int = 0) -> DataFrame:
    """Points offset .. offset + n - 1 of a Sobol sequence: point, dim, x (32 bits as long), u (in [0, 1)).

    Point p is the exclusive or of the direction numbers at the set bits of p's Gray code: built-in functions alone.
    """
    p = F.col("point")
    points = spark.range(offset, offset + n).withColumnRenamed("id", "point").withColumn("g", p.bitwiseXOR(F.shiftright(p, 1)))
    directions = sobol_directions(dims)
    if dims <= UNROLLED:
        xs: list[Column] = []
        for v in directions:
            x = F.lit(0).cast("long")
            for i, d in enumerate(v):
                x = x.bitwiseXOR(F.when(F.shiftright("g", i).bitwiseAND(F.lit(1)) == 1, F.lit(d)).otherwise(F.lit(0)))
            xs.append(x)
        rows = points.select("point", F.posexplode(F.array(*xs)).alias("dim", "x"))
    else:  # one row of 32 numbers a dimension: as large as the model, whatever n
        table = spark.createDataFrame([(i, v) for i, v in enumerate(directions)], "d int, v array<long>")
        rows = points.withColumn("dim", F.explode(F.sequence(F.lit(0), F.lit(dims - 1)))).join(F.broadcast(table), F.col("dim") == F.col("d"))
        bits = F.transform("v", lambda x, i: F.when(F.call_function("getbit", F.col("g"), i) == 1, x).otherwise(F.lit(0).cast("long")))
        rows = rows.select("point", "dim", F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)).alias("x"))
    return rows.select("point", F.col("dim").cast("long").alias("dim"), "x", (F.col("x") / F.lit(float(1 << 32))).alias("u"))


#: Fixed values of the published generator MRG32k3a: moduli and recurrence matrices.
_M1, _M2 = 4294967087, 4294944443
_A1 = ((0, 1, 0), (0, 0, 1), (-810728, 1403580, 0))
_A2 = ((0, 1, 0), (0, 0, 1), (-1370589, 0, 527612))


def _matrix_power(a: tuple, e: int, m: int) -> list[list[int]]:
    mul = lambda x, y: [[sum(x[i][k] * y[k][j] for k in range(3)) % m for j in range(3)] for i in range(3)]
    out, base = [[int(i == j) for j in range(3)] for i in range(3)], [list(r) for r in a]
    while e:
        if e & 1:
            out = mul(out, base)
        base, e = mul(base, base), e >> 1
    return out


def _mrg_states(first: int, count: int, jump: int, seed: int | tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """States (3, count) of both components `first` * jump steps on, and each jump after that."""
    seeds = (seed,) * 6 if isinstance(seed, int) else tuple(seed)
    out = []
    for a, m, start in ((_A1, _M1, seeds[:3]), (_A2, _M2, seeds[3:])):
        at, hop = _matrix_power(a, first * jump, m), _matrix_power(a, jump, m)
        x, states = [sum(c * v for c, v in zip(r, start)) % m for r in at], np.empty((3, count), np.int64)
        for i in range(count):
            states[:, i] = x
            x = [sum(c * v for c, v in zip(r, x)) % m for r in hop]
        out.append(states)
    return out[0], out[1]


def _mrg_steps(x: np.ndarray, y: np.ndarray, steps: int) -> np.ndarray:
    """The next `steps` numbers of each state (steps, count): all states step together, in exact 64-bit arithmetic."""
    x, y, out = [*x], [*y], np.empty((steps, x.shape[1]), np.int64)
    for i in range(steps):
        x = [x[1], x[2], (1403580 * x[1] - 810728 * x[0]) % _M1]
        y = [y[1], y[2], (527612 * y[2] - 1370589 * y[0]) % _M2]
        out[i] = (x[2] - y[2]) % _M1
    out[out == 0] = _M1
    return out


#: Steps that one lane of a stream takes; the lanes of a stream start so far apart.
LANE = 256


def mrg32k3a(spark: SparkSession, streams: int, steps: int, seed: int | tuple[int, ...] = 12345, jump: int = 1 << 67, distribution: str = "raw", shape: float = 2.0) -> DataFrame:
    """stream, step, value of the combined multiple recursive generator; stream s starts s * jump steps on.

    seed: one number, or the six of both components. distribution: raw (0 .. 2**32), uniform (0, 1), exponential,
    normal (pairs of steps make two), gamma of an integer shape (`shape` steps make one). Streams are independent
    tasks; within a stream, lanes that start LANE steps apart step together.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = -(-steps // LANE)
        hop = [_matrix_power(a, LANE, m) for a, m in ((_A1, _M1), (_A2, _M2))]
        for b in batches:
            for s in b.column(0).to_pylist():
                start = [z[:, 0].tolist() for z in _mrg_states(s, 1, jump, seed)]
                states = []
                for x, h, m in zip(start, hop, (_M1, _M2)):
                    each = np.empty((3, lanes), np.int64)
                    for i in range(lanes):
                        each[:, i] = x
                        x = [sum(c * v for c, v in zip(r, x)) % m for r in h]
                    states.append(each)
                out = _mrg_steps(*states, min(LANE, steps)).T.ravel()[:steps].astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(steps, s)), pa.array(np.arange(steps)), pa.array(out)], ["stream", "step", "value"])

    raw = spark.range(streams).mapInArrow(run, "stream long, step long, value double")
    u = F.col("value") / (_M1 + 1)
    if distribution == "raw":
        return raw
    if distribution == "uniform":
        return raw.withColumn("value", u)
    if distribution == "exponential":
        return raw.withColumn("value", -F.log(u))
    if distribution == "normal":
        pair = raw.groupBy("stream", F.floor(F.col("step") / 2).alias("p")).agg(F.max(F.when(F.col("step") % 2 == 0, u)).alias("a"), F.max(F.when(F.col("step") % 2 == 1, u)).alias("b")).where("b IS NOT NULL")
        r, t = F.sqrt(-2 * F.log("a")), 2 * np.pi * F.col("b")
        return pair.select("stream", F.posexplode(F.array(r * F.cos(t), r * F.sin(t))).alias("k", "value"), "p").select("stream", (2 * F.col("p") + F.col("k")).alias("step"), "value")
    if distribution == "gamma":
        k = int(shape)
        return raw.groupBy("stream", F.floor(F.col("step") / k).alias("step")).agg((-F.sum(F.log(u))).alias("value"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).drop("n")
    raise ValueError(distribution)


def _xorshift_step(state: list) -> list:
    """One step; words are Python ints or numpy arrays of uint64."""
    # Taps and shifts of the published generator.
    low = 0xFFFFFFFF
    t = state[7]
    t = t ^ (t << 13 & low)
    t = t ^ (t << 9 & low)
    w = state[4] ^ (state[4] << 7 & low)
    v = state[3] ^ state[3] >> 3
    r = state[1] ^ state[1] >> 10
    z = state[0] ^ state[0] >> 7
    z = z ^ (z << 24 & low)
    return [*state[1:], t ^ w ^ v ^ r ^ z]


def _xorshift_jump(steps: int) -> list[int]:
    """What `steps` steps make of each of the 256 bits of a state: columns of a matrix over two elements."""
    pack = lambda words: sum(int(x) << (32 * i) for i, x in enumerate(words))
    unpack = lambda v: [v >> (32 * i) & 0xFFFFFFFF for i in range(8)]

    def times(columns: list[int], v: int) -> int:
        out = 0
        while v:
            low = v & -v
            out ^= columns[low.bit_length() - 1]
            v ^= low
        return out

    base, out = [pack(_xorshift_step(unpack(1 << i))) for i in range(256)], [1 << i for i in range(256)]
    while steps:
        if steps & 1:
            out = [times(base, c) for c in out]
        base, steps = [times(base, c) for c in base], steps >> 1
    return out


def xorshift7(spark: SparkSession, streams: int, steps: int, seed: int = 1, skip: int = 0) -> DataFrame:
    """stream, step, value (32 bits as long) of the seven-step xorshift generator on eight words of state.

    Each stream's state comes from its number and the seed; `skip` steps are left out (a later run of the same
    stream), by powers of the step's matrix. The streams of a task step together.
    """
    jump = _xorshift_jump(skip) if skip else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            states = np.stack([np.random.SeedSequence([seed, int(s)]).generate_state(8) for s in ids], axis=1).astype(np.uint64)
            if jump:
                bits = (states[:, None, :] >> np.arange(32, dtype=np.uint64)[None, :, None] & np.uint64(1)).reshape(256, -1)
                columns = np.array([[c >> (32 * i) & 0xFFFFFFFF for c in jump] for i in range(8)], np.uint64)
                states = np.stack([np.bitwise_xor.reduce(np.where(bits == 1, c[:, None], np.uint64(0)), axis=0) for c in columns])
            state, out = list(states), np.empty((steps, len(ids)), np.int64)
            for i in range(steps):
                state = _xorshift_step(state)
                out[i] = state[7]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, steps)), pa.array(np.tile(np.arange(skip, skip + steps), len(ids))), pa.array(out.T.ravel())], ["stream", "step", "value"])

    return spark.range(streams).mapInArrow(run, "stream long, step long, value long")


# The swaption portfolio of the published LIBOR market model example.
MATURITIES = (4, 4, 4, 8, 8, 8, 20, 20, 20, 28, 28, 28, 40, 40, 40)
SWAP_RATES = (0.045, 0.05, 0.055) * 5


def libor_paths(spark: SparkSession, paths: int, rates: int = 80, steps: int = 40, delta: float = 0.25, volatility: float = 0.2, start: float = 0.051, maturities: tuple = MATURITIES, swap_rates: tuple = SWAP_RATES, seed: int | tuple[int, ...] = (1, 2, 3, 1, 2, 3), block: int = 4096) -> DataFrame:
    """path, value, greek: a swaption portfolio under the LIBOR market model, one row for each Monte-Carlo path.

    Forward rates are driven by one normal number a step (log-Euler, flat volatility); the portfolio pays 100 times
    what each swap is below par, discounted over the path. greek is the pathwise derivative by the last initial rate.
    Paths take normals from generator streams of their own (2**76 steps apart) and are simulated by block.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in b.column(0).to_pylist():
                n = min(block, paths - first)
                u = _mrg_steps(*_mrg_states(first, n, 1 << 76, seed), 2 * -(-steps // 2)) / (_M1 + 1)
                r, t = np.sqrt(-2 * np.log(u[0::2])), 2 * np.pi * u[1::2]
                z = np.stack([r * np.cos(t), r * np.sin(t)], axis=1).reshape(-1, n)
                x, slope = np.full((rates, n), start), np.ones(n)
                con = delta * volatility
                for k in range(steps):
                    drift = np.cumsum(con * x[k + 1 :] / (1 + delta * x[k + 1 :]), axis=0)
                    grown = np.exp(con * drift + volatility * (np.sqrt(delta) * z[k] - 0.5 * con))
                    own = con * slope / (1 + delta * x[-1]) ** 2
                    slope = grown[-1] * (slope + x[-1] * con * own)
                    x[k + 1 :] *= grown
                bond = np.cumprod(1 / (1 + delta * x[steps:]), axis=0)
                annuity = delta * np.cumsum(bond, axis=0)
                value, greek = np.zeros(n), np.zeros(n)
                by_last = -bond[-1] * delta * slope / (1 + delta * x[-1])
                for m, rate in zip(maturities, swap_rates):
                    swap = bond[m - 1] + rate * annuity[m - 1] - 1
                    value += np.where(swap < 0, -100 * swap, 0.0)
                    if m == rates - steps:
                        greek += np.where(swap < 0, -100 * by_last * (1 + rate * delta), 0.0)
                discount = np.prod(1 / (1 + delta * x[:steps]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.array(value * discount), pa.array(greek * discount)], ["path", "value", "greek"])

    return spark.range(0, paths, block, -(-paths // block)).mapInArrow(run, "path long, value double, greek double")


def libor(spark: SparkSession, paths: int = 96000, **model: object) -> DataFrame:
    """One row: mean value and mean greek over the paths, with the standard errors of both."""
    each = libor_paths(spark, paths, **model)
    mean = lambda c: [F.avg(c).alias(c), (F.stddev(c) / F.sqrt(F.count(c))).alias(f"{c}_error")]
    return each.agg(*mean("value"), *mean("greek"))
