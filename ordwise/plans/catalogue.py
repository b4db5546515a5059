"""The registered queries over the driver's tables, each with DuckDB SQL that gives the same rows.

Positions are dense keys of the tables: o_orderkey, event_id, c_custkey. Money is counted in whole cents, so that sums
don't depend on their order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordwise.functions import bits, tables
from ordwise.operators import compact, intervals, joins, numeric, scan, search, sets, sorting
from ordwise.operators import reduce as red
from ordwise.operators.monoid import ADD, MAX, MEAN, MIN, MUL
from ordwise.plans.materialize import shared_dir
from ordwise.sources.tables import read_positioned, read_table, write_csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_O = f"o AS (SELECT o_orderkey AS pos, {_CENTS} AS v, o_custkey AS c FROM orders)"
_E = "e AS (SELECT event_id AS pos, event_type AS t, CAST(round(value * 100) AS BIGINT) AS v FROM events)"


def _orders(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "orders").selectExpr("o_orderkey AS pos", f"{_CENTS} AS v", "o_custkey AS c")


def _events(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "events").selectExpr("event_id AS pos", "event_type AS t", "CAST(round(value * 100) AS BIGINT) AS v")


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _register(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLES[name] = f, sql


# reductions

_REDUCE = {"add": (ADD, "sum(v)::BIGINT"), "min": (MIN, "min(v)"), "max": (MAX, "max(v)"), "mean": (MEAN, "avg(v)")}
for _n, (_m, _x) in _REDUCE.items():
    _register(f"reduce_{_n}", lambda s, d, m=_m: red.reduce(_orders(s, d), "v", m), f"WITH {_O} SELECT {_x} AS result FROM o")


@query("SELECT c_nationkey, round(ln(product(1 + c_custkey % 3)), 6) AS log_result FROM customer GROUP BY c_nationkey")
def reduce_mul(s: SparkSession, d: str) -> DataFrame:
    c = read_table(s, d, "customer").selectExpr("c_nationkey", "1 + c_custkey % 3 AS x")
    return red.reduce_by_key(c, ["c_nationkey"], "x", MUL).select("c_nationkey", F.round(F.log("result"), 6).alias("log_result"))


@query(f"WITH {_O} SELECT c, sum(v)::BIGINT AS result FROM o GROUP BY c")
def reduce_by_key(s: SparkSession, d: str) -> DataFrame:
    return red.reduce_by_key(_orders(s, d), ["c"], "v", ADD)


_RUNS = f"{_E}, h AS (SELECT *, CASE WHEN lag(t) OVER (ORDER BY pos) = t THEN 0 ELSE 1 END AS f FROM e), r AS (SELECT *, sum(f) OVER (ORDER BY pos) - 1 AS run FROM h)"


@query(f"WITH {_RUNS} SELECT run::BIGINT AS run, t, count(*) AS n, sum(v)::BIGINT AS result FROM r GROUP BY run, t")
def reduce_by_run(s: SparkSession, d: str) -> DataFrame:
    return red.reduce_by_run(_events(s, d), "t", "v", ADD)


@query(f"WITH {_O} SELECT pos // 128 AS tile, sum(v)::BIGINT AS result FROM o GROUP BY 1")
def tile_reduce(s: SparkSession, d: str) -> DataFrame:
    return red.tile_reduce(_orders(s, d), "v", ADD, 128)


@query(f"WITH {_O}, r AS (SELECT c, pos, v, min(pos) OVER (PARTITION BY c) AS p FROM o) SELECT c, sum(CASE WHEN pos = p THEN v ELSE -v END)::BIGINT AS result FROM r GROUP BY c")
def ordered_fold_sub(s: SparkSession, d: str) -> DataFrame:
    return red.ordered_fold(_orders(s, d), "v", lambda a, b: a - b, by=["c"])


@query("SELECT k AS c, 1 + 2 + k AS folded FROM (SELECT c_custkey AS k FROM customer)")
def array_reduce(s: SparkSession, d: str) -> DataFrame:
    arr = F.array(F.lit(1), F.lit(2), F.col("c"))
    return read_table(s, d, "customer").selectExpr("c_custkey AS c").select("c", red.array_reduce(arr, lambda a, b: a + b).cast("long").alias("folded"))


@query("SELECT least(floor((o_totalprice - 1000) / 25000), 19)::BIGINT AS bin, count(*) AS n FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 501000 GROUP BY 1")
def histogram_even(s: SparkSession, d: str) -> DataFrame:
    return red.histogram_even(read_table(s, d, "orders"), "o_totalprice", 1000, 501000, 20)


@query("SELECT (CASE WHEN p_size < 5 THEN 0 WHEN p_size < 12 THEN 1 WHEN p_size < 40 THEN 2 ELSE 3 END)::BIGINT AS bin, count(*) AS n FROM part WHERE p_size >= 1 AND p_size < 51 GROUP BY 1")
def histogram_edges(s: SparkSession, d: str) -> DataFrame:
    return red.histogram_edges(read_table(s, d, "part"), "p_size", [1, 5, 12, 40, 51])


@query(
    """SELECT o_custkey AS x, bit_count(o_custkey)::INT AS popc, (CASE WHEN o_custkey = 0 THEN 32 ELSE 31 - floor(log2(o_custkey)) END)::INT AS clz,
(CASE WHEN o_custkey = 0 THEN 0 ELSE log2(o_custkey & -o_custkey) + 1 END)::INT AS ffs, (o_custkey >> 3) & 31 AS bfe,
((o_custkey & 15) << 4) | (o_orderkey & 4294967055) AS bfi FROM orders"""
)
def bit_operations(s: SparkSession, d: str) -> DataFrame:
    o, x = read_table(s, d, "orders"), F.col("o_custkey")
    return o.select(x.alias("x"), bits.popc(x).alias("popc"), bits.clz(x).alias("clz"), bits.ffs(x).alias("ffs"), bits.bfe(x, 3, 5).alias("bfe"), bits.bfi(x, F.col("o_orderkey"), 4, 4).alias("bfi"))


# scans

_INC, _EXC = "ROWS UNBOUNDED PRECEDING", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_SCANS = {
    "scan_inclusive": ({"kind": "inclusive"}, ADD, f"sum(v) OVER (ORDER BY pos {_INC})::BIGINT"),
    "scan_exclusive": ({}, ADD, f"coalesce(sum(v) OVER (ORDER BY pos {_EXC}), 0)::BIGINT"),
    "scan_min": ({}, MIN, f"coalesce(min(v) OVER (ORDER BY pos {_EXC}), 9223372036854775807)"),
    "scan_max": ({"kind": "inclusive"}, MAX, f"max(v) OVER (ORDER BY pos {_INC})"),
    "scan_mean": ({"kind": "inclusive"}, MEAN, f"(sum(v) OVER (ORDER BY pos {_INC}))::DOUBLE / (count(v) OVER (ORDER BY pos {_INC}))"),
    "scan_identityless": ({"identity": False}, ADD, f"sum(v) OVER (ORDER BY pos {_EXC})::BIGINT"),
    "scan_two_level": ({"strategy": "bucket", "bucket": 1000}, ADD, f"coalesce(sum(v) OVER (ORDER BY pos {_EXC}), 0)::BIGINT"),
    "scan_range": ({"strategy": "range"}, ADD, f"coalesce(sum(v) OVER (ORDER BY pos {_EXC}), 0)::BIGINT"),
    "scan_segmented": ({"partition_by": ["c"]}, ADD, f"coalesce(sum(v) OVER (PARTITION BY c ORDER BY pos {_EXC}), 0)::BIGINT"),
}
for _n, (_kw, _m, _x) in _SCANS.items():
    _register(_n, lambda s, d, kw=_kw, m=_m: scan.scan(_orders(s, d), "v", m, **kw), f"WITH {_O} SELECT pos, v, c, {_x} AS scanned FROM o")


@query(f"WITH {_O} SELECT pos, v, c, coalesce(sum(v) OVER (ORDER BY pos {_EXC}), 0)::BIGINT AS scanned FROM o UNION ALL SELECT count(*), NULL, NULL, sum(v)::BIGINT FROM o")
def scan_total_at_end(s: SparkSession, d: str) -> DataFrame:
    return scan.scan(_orders(s, d), "v", total_at_end=True)


@query(
    f"WITH {_O} SELECT pos, v, c, pos // 32 AS tile, coalesce(sum(v) OVER (PARTITION BY pos // 32 ORDER BY pos {_EXC}), 0)::BIGINT AS scanned, sum(v) OVER (PARTITION BY pos // 32)::BIGINT AS aggregate FROM o"
)
def tile_scan(s: SparkSession, d: str) -> DataFrame:
    return scan.tile_scan(_orders(s, d), "v", 32)


@query("SELECT c_custkey AS c, [0, c_custkey, c_custkey + 2] AS exclusive, [c_custkey, c_custkey + 2, c_custkey + 7] AS inclusive FROM customer")
def array_scan(s: SparkSession, d: str) -> DataFrame:
    arr, zero = F.array(F.col("c"), F.lit(2).cast("long"), F.lit(5).cast("long")), F.lit(0).cast("long")
    both = [scan.array_scan(arr, lambda a, b: a + b, zero, k).alias(k) for k in ("exclusive", "inclusive")]
    return read_table(s, d, "customer").selectExpr("c_custkey AS c").select("c", *both)


# movement

@query(f"WITH {_E} SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, t, v FROM e WHERE t = 'purchase'")
def select_if(s: SparkSession, d: str) -> DataFrame:
    return compact.select_if(_events(s, d), F.col("t") == "purchase")


@query(f"WITH {_E} SELECT row_number() OVER (ORDER BY t <> 'click', pos) - 1 AS pos, t, v FROM e")
def partition_flag(s: SparkSession, d: str) -> DataFrame:
    return compact.partition_if(_events(s, d), F.col("t") == "click")


@query(f"WITH {_E} SELECT pos, t, v, coalesce(lag(v, 3) OVER (ORDER BY pos), -1) AS before, coalesce(lead(v, 2) OVER (ORDER BY pos), -2) AS after FROM e")
def shift(s: SparkSession, d: str) -> DataFrame:
    return compact.shift(compact.shift(_events(s, d), "v", 3, -1, out="before"), "v", -2, -2, out="after")


@query(f"WITH {_E} SELECT pos, t, v, (lag(t) OVER (ORDER BY pos)) IS DISTINCT FROM t AS head, (lead(t) OVER (ORDER BY pos)) IS DISTINCT FROM t AS tail FROM e")
def discontinuity(s: SparkSession, d: str) -> DataFrame:
    return compact.discontinuity(_events(s, d), "t")


@query("SELECT o_orderkey AS pos, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey")
def gather(s: SparkSession, d: str) -> DataFrame:
    names = read_table(s, d, "customer").selectExpr("c_custkey AS pos", "c_name AS name")
    return compact.gather(_orders(s, d).select("pos", F.col("c").alias("i")), names)


@query(f"WITH {_O} SELECT (SELECT max(pos) FROM o) - pos AS pos, v FROM o")
def scatter(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d)
    top = o.agg(F.max("pos").alias("top"))
    return compact.scatter(o.crossJoin(F.broadcast(top)).select("pos", (F.col("top") - F.col("pos")).alias("i"), "v"))


@query(f"WITH {_O} SELECT g.range AS pos, coalesce(v, -1) AS v FROM range(0, 20000) g LEFT JOIN o ON o.pos = g.range")
def load_with_default(s: SparkSession, d: str) -> DataFrame:
    return compact.load(_orders(s, d).select("pos", "v"), 20000, -1)


@query(f"WITH {_O}, n AS (SELECT count(*) AS n FROM o) SELECT o_custkey AS i, CASE WHEN o_custkey % 2 = 0 THEN a.v ELSE b.c_nationkey END AS v, o_orderkey AS pos FROM orders LEFT JOIN o a ON a.pos = o_custkey LEFT JOIN customer b ON b.c_custkey = o_custkey WHERE CASE WHEN o_custkey % 2 = 0 THEN a.v ELSE b.c_nationkey END IS NOT NULL")
def two_source_gather(s: SparkSession, d: str) -> DataFrame:
    start = 1 << 40
    a, b = _orders(s, d).select("pos", "v"), read_table(s, d, "customer").selectExpr("c_custkey AS pos", "CAST(c_nationkey AS BIGINT) AS v")
    index = _orders(s, d).select("pos", F.when(F.col("c") % 2 == 0, F.col("c")).otherwise(F.col("c") + start).alias("i"))
    out = compact.two_source_gather(index.withColumn("j", F.col("i")), a, b, start)
    return out.select(F.when(F.col("j") >= start, F.col("j") - start).otherwise(F.col("j")).alias("i"), "v", "pos")


@query(f"WITH {_O} SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, v, c FROM o WHERE pos % 3 <> 0")
def bulk_remove(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d)
    return compact.bulk_remove(o, o.where("pos % 3 = 0").select("pos"))


@query(f"WITH {_O}, {_E}, u AS (SELECT pos // 7 AS i, 0 AS s, pos AS k, v FROM e UNION ALL SELECT pos, 1, pos, v FROM o) SELECT row_number() OVER (ORDER BY i, s, k) - 1 AS pos, v FROM u")
def bulk_insert(s: SparkSession, d: str) -> DataFrame:
    return compact.bulk_insert(_events(s, d).select("pos", F.floor(F.col("pos") / 7).alias("i"), "v"), _orders(s, d).select("pos", "v"))


@query("SELECT (pos // 512) * 512 + (pos % 512) % 4 * 128 + (pos % 512) // 4 AS pos, v FROM (SELECT o_orderkey AS pos, o_custkey AS v FROM orders)")
def block_exchange(s: SparkSession, d: str) -> DataFrame:
    return compact.exchange(_orders(s, d).select("pos", F.col("c").alias("v")), compact.to_striped(F.col("pos"), 128, 4))


@query(f"WITH {_O} SELECT pos, v FROM o ORDER BY v DESC, pos LIMIT 1")
def arg_max(s: SparkSession, d: str) -> DataFrame:
    return compact.arg_extreme(_orders(s, d), "v", largest=True)


@query("SELECT range AS pos, 5 + 3 * range AS value, 7 AS constant, (5 + 3 * range) * 2 AS doubled FROM range(0, 1000)")
def iterators(s: SparkSession, d: str) -> DataFrame:
    rows = compact.counting(s, 1000, 5, 3).join(compact.constant(s, 1000, 7).withColumnRenamed("value", "constant"), "pos")
    return compact.transform(rows, doubled=F.col("value") * 2)


# searches

def _needles(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "orders").selectExpr("o_orderkey AS pos", "o_custkey AS k")


def _haystack(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "lineitem").selectExpr("l_partkey % 1777 AS k")


for _b, _op in (("lower", "<"), ("upper", "<=")):
    _register(
        f"{_b}_bound",
        lambda s, d, b=_b: search.sorted_search(_needles(s, d), _haystack(s, d), bound=b),
        f"""WITH h AS (SELECT l_partkey % 1777 AS k, count(*) AS n FROM lineitem GROUP BY 1), q AS (SELECT DISTINCT o_custkey AS k FROM orders),
        r AS (SELECT q.k, coalesce(sum(CASE WHEN h.k {_op} q.k THEN n END), 0)::BIGINT AS idx, coalesce(bool_or(h.k = q.k), false) AS matched FROM q, h GROUP BY q.k)
        SELECT o_orderkey AS pos, o_custkey AS k, idx, matched FROM orders JOIN r ON r.k = o_custkey""",
    )


@query("SELECT o_orderkey AS pos, o_custkey AS k, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey % 1777 = o_custkey) AS matched FROM orders")
def sorted_search_match(s: SparkSession, d: str) -> DataFrame:
    return search.match_flags(_needles(s, d), _haystack(s, d))


@query("SELECT count(*) AS matches FROM orders WHERE o_custkey IN (SELECT l_partkey % 1777 FROM lineitem)")
def match_count(s: SparkSession, d: str) -> DataFrame:
    return search.match_count(_needles(s, d), _haystack(s, d))


@query("WITH h AS (SELECT l_partkey % 1777 AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS pos, o_custkey AS k, greatest(coalesce(h.n, 0), 1) AS n FROM orders LEFT JOIN h ON h.k = o_custkey")
def equality_count(s: SparkSession, d: str) -> DataFrame:
    return search.equality_count(_needles(s, d), _haystack(s, d), at_least_one=True)


@query("WITH h AS (SELECT l_partkey % 1777 AS k FROM lineitem), p AS (SELECT range AS part, least(range * 100, 1777) AS k FROM range(0, 19)) SELECT part, p.k, count(h.k) AS idx FROM p LEFT JOIN h ON h.k < p.k GROUP BY ALL")
def search_partitions(s: SparkSession, d: str) -> DataFrame:
    return search.search_partitions(_haystack(s, d), 1777, 100)


_PARTS = "p AS (SELECT p_partkey AS pos, p_size % 4 AS c, p_size AS v, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part), x AS (SELECT *, coalesce(sum(c) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM p), g AS (SELECT *, unnest(generate_series(0, c - 1)) AS rank FROM x)"


def _parts(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "part").selectExpr("p_partkey AS pos", "p_size % 4 AS count", "p_size AS v")


@query(f"WITH {_PARTS} SELECT off + rank AS slot, pos AS owner, rank FROM g")
def load_balance(s: SparkSession, d: str) -> DataFrame:
    return search.load_balance(_parts(s, d))


_ASOF = "l AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase'), r AS (SELECT ts AS rts, event_id AS last_id, user_id AS u FROM events WHERE event_type = 'purchase')"


def _asof(s: SparkSession, d: str, **kw: object) -> DataFrame:
    e = read_table(s, d, "events")
    left, right = e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_id"))
    return search.asof(left, right, "ts", ["last_id"], **kw)


_register("asof_backward", lambda s, d: _asof(s, d), f"WITH {_ASOF} SELECT event_id, user_id, ts, last_id FROM l ASOF LEFT JOIN r ON ts >= rts")
_register("asof_forward_by_user", lambda s, d: _asof(s, d, by=["user_id"], forward=True), f"WITH {_ASOF} SELECT event_id, user_id, ts, last_id FROM l ASOF LEFT JOIN r ON user_id = u AND ts <= rts")


# intervals

@query(f"WITH {_PARTS} SELECT off + rank AS pos, pos AS src_pos, rank, v FROM g")
def interval_expand(s: SparkSession, d: str) -> DataFrame:
    return intervals.interval_expand(_parts(s, d))


def _intervals(s: SparkSession, d: str) -> DataFrame:
    return _parts(s, d).selectExpr("pos", "count", "pos * 2 AS gather_start", "pos * 4 AS scatter_start")


_register("interval_gather", lambda s, d: intervals.interval_gather(_intervals(s, d), _orders(s, d)), f"WITH {_PARTS}, {_O} SELECT off + rank AS pos, o.v FROM g JOIN o ON o.pos = g.pos * 2 + rank")
_register("interval_scatter", lambda s, d: intervals.interval_scatter(_intervals(s, d), _orders(s, d)), f"WITH {_PARTS}, {_O} SELECT g.pos * 4 + rank AS pos, o.v FROM g JOIN o ON o.pos = off + rank")
_register("interval_move", lambda s, d: intervals.interval_move(_intervals(s, d), _orders(s, d)), f"WITH {_PARTS}, {_O} SELECT g.pos * 4 + rank AS pos, o.v FROM g JOIN o ON o.pos = g.pos * 2 + rank")


# joins: orders by customer; keys of customers are offset, so that both sides have unmatched rows

_JA, _JB = "a AS (SELECT o_orderkey AS pos, o_custkey AS k FROM orders)", "b AS (SELECT c_custkey AS pos, c_custkey + 50 AS k FROM customer)"


def _join_sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _needles(s, d), read_table(s, d, "customer").selectExpr("c_custkey AS pos", "c_custkey + 50 AS k")


for _k, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    _register(
        f"join_{_k}",
        lambda s, d, k=_k: joins.relational_join(*_join_sides(s, d), k, ordered=True, sentinel=-1),
        f"WITH {_JA}, {_JB} SELECT coalesce(a.pos, -1) AS a_pos, coalesce(b.pos, -1) AS b_pos, row_number() OVER (ORDER BY a.pos NULLS LAST, b.pos) - 1 AS rank FROM a {_sql} b ON a.k = b.k",
    )
_register("join_semi", lambda s, d: joins.semi_join(*_join_sides(s, d)), f"WITH {_JA}, {_JB} SELECT * FROM a WHERE k IN (SELECT k FROM b)")
_register("join_anti", lambda s, d: joins.anti_join(*_join_sides(s, d)), f"WITH {_JA}, {_JB} SELECT * FROM a WHERE k NOT IN (SELECT k FROM b)")
_register(
    "join_payload",
    lambda s, d: compact.gather(joins.relational_join(*_join_sides(s, d)).select(F.col("a_pos").alias("pos"), F.col("b_pos").alias("i")), read_table(s, d, "customer").selectExpr("c_custkey AS pos", "c_name")),
    "SELECT o_orderkey AS pos, c_name FROM orders JOIN customer ON o_custkey = c_custkey + 50",
)


# multisets

_SA = "a AS (SELECT p_partkey AS pos, p_size AS k, p_partkey AS v FROM part)"
_SB = "b AS (SELECT c_custkey AS pos, c_nationkey + 20 AS k, -c_custkey AS v FROM customer)"
_CNT = "ca AS (SELECT k, count(*) AS n FROM a GROUP BY k), cb AS (SELECT k, count(*) AS n FROM b GROUP BY k), c AS (SELECT coalesce(ca.k, cb.k) AS k, coalesce(ca.n, 0) AS x, coalesce(cb.n, 0) AS y FROM ca FULL JOIN cb ON ca.k = cb.k)"
_OCC = "pa AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS occ FROM a), pb AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS occ FROM b), j AS (SELECT coalesce(pa.k, pb.k) AS k, coalesce(pa.occ, pb.occ) AS occ, coalesce(pa.v, pb.v) AS v, pa.v IS NOT NULL AS ia, pb.v IS NOT NULL AS ib FROM pa FULL JOIN pb ON pa.k = pb.k AND pa.occ = pb.occ)"


def _set_sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return read_table(s, d, "part").selectExpr("p_partkey AS pos", "p_size AS k", "p_partkey AS v"), read_table(s, d, "customer").selectExpr("c_custkey AS pos", "c_nationkey + 20 AS k", "-c_custkey AS v")


for _op, _short, _times, _has in (("intersection", "intersect", "least(x, y)", "ia AND ib"), ("union", "union_max", "greatest(x, y)", "true"), ("difference", "diff", "greatest(x - y, 0)", "ia AND NOT ib"), ("symmetric", "symdiff", "abs(x - y)", "ia <> ib")):
    _register(f"set_{_short}", lambda s, d, op=_op: sets.set_keys(*_set_sides(s, d), op), f"WITH {_SA}, {_SB}, {_CNT} SELECT k FROM (SELECT k, unnest(generate_series(1, {_times})) FROM c)")
    _register(f"set_{_short}_pairs", lambda s, d, op=_op: sets.set_pairs(*_set_sides(s, d), op, ranked=True), f"WITH {_SA}, {_SB}, {_OCC} SELECT k, occ, v, row_number() OVER (ORDER BY k, occ) - 1 AS out FROM j WHERE {_has}")


# sorts

_KEYS = "o AS (SELECT o_orderkey AS pos, o_custkey AS k, o_orderkey * 3 AS v FROM orders)"


def _keyed(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "orders").selectExpr("o_orderkey AS pos", "o_custkey AS k", "o_orderkey * 3 AS v")


_register("sort_keys", lambda s, d: sorting.sort_keys(_keyed(s, d)), f"WITH {_KEYS} SELECT row_number() OVER (ORDER BY k, pos) - 1 AS out, k FROM o")
_register("sort_pairs", lambda s, d: sorting.sort_pairs(_keyed(s, d), strategy="range"), f"WITH {_KEYS} SELECT pos, k, v, row_number() OVER (ORDER BY k, pos) - 1 AS out FROM o")
_register("sort_descending", lambda s, d: sorting.sort_pairs(_keyed(s, d), descending=True), f"WITH {_KEYS} SELECT pos, k, v, row_number() OVER (ORDER BY k DESC, pos) - 1 AS out FROM o")
_register("sort_indices", lambda s, d: sorting.sort_indices(_keyed(s, d)), f"WITH {_KEYS} SELECT row_number() OVER (ORDER BY k, pos) - 1 AS out, k, pos AS index FROM o")
_register("locality_sort", lambda s, d: sorting.locality_sort_pairs(_keyed(s, d)), f"WITH {_KEYS} SELECT pos, k, v, row_number() OVER (ORDER BY k, pos) - 1 AS out FROM o")
_register("block_sort", lambda s, d: sorting.block_sort(_keyed(s, d), 256), f"WITH {_KEYS} SELECT pos, k, v, row_number() OVER (ORDER BY pos // 256, k, pos) - 1 AS out FROM o")
_register("sort_network", lambda s, d: read_table(s, d, "lineitem").selectExpr("array(l_partkey, l_suppkey, l_orderkey) AS a").select(sorting.sort_network(F.col("a")).alias("sorted")), "SELECT list_sort([l_partkey, l_suppkey, l_orderkey]) AS sorted FROM lineitem")

_MERGE = "x AS (SELECT o_custkey // 3 AS k, o_orderkey AS v FROM orders), a AS (SELECT *, row_number() OVER (ORDER BY k, v) - 1 AS pos FROM x), y AS (SELECT c_custkey // 2 AS k, -c_custkey AS v FROM customer), b AS (SELECT *, row_number() OVER (ORDER BY k, v) - 1 AS pos FROM y), u AS (SELECT k, v, 0 AS s, pos FROM a UNION ALL SELECT k, v, 1, pos FROM b), m AS (SELECT k, v, s, row_number() OVER (ORDER BY k, s, pos) - 1 AS out FROM u)"


def _sorted_sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from ordwise.operators.positional import with_pos

    a = read_table(s, d, "orders").selectExpr("CAST(floor(o_custkey / 3) AS BIGINT) AS k", "o_orderkey AS v")
    b = read_table(s, d, "customer").selectExpr("CAST(floor(c_custkey / 2) AS BIGINT) AS k", "-c_custkey AS v")
    return with_pos(a, ["k", "v"]), with_pos(b, ["k", "v"])


_register("merge_keys", lambda s, d: sorting.merge_keys(*_sorted_sides(s, d)), f"WITH {_MERGE} SELECT out, k FROM m")
_register("merge_pairs", lambda s, d: sorting.merge_pairs(*_sorted_sides(s, d)), f"WITH {_MERGE} SELECT out, k, v FROM m")
_register(
    "merge_path_partitions",
    lambda s, d: search.merge_path_partitions(*_sorted_sides(s, d), 700),
    f"WITH {_MERGE}, n AS (SELECT count(*) AS n FROM m), p AS (SELECT part, least(part * 700, n) AS diagonal FROM (SELECT unnest(generate_series(0, ceil(n / 700)::BIGINT)) AS part, n FROM n)) SELECT part, diagonal, count(CASE WHEN s = 0 THEN 1 END) AS a_count, diagonal - count(CASE WHEN s = 0 THEN 1 END) AS b_count FROM p LEFT JOIN m ON out < diagonal GROUP BY part, diagonal",
)

_SEG = f"{_E}, s AS (SELECT pos, v, sum(CASE WHEN pos > 0 AND v % 7 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY pos)::BIGINT AS seg_id FROM e)"
_register(
    "segsort_flags",
    lambda s, d: sorting.segsort_from_flags(_events(s, d).withColumn("head", F.col("v") % 7 == 0), "v").select("pos", "v", "seg_id", "out"),
    f"WITH {_SEG} SELECT pos, v, seg_id, row_number() OVER (ORDER BY seg_id, v, pos) - 1 AS out FROM s",
)
_register(
    "segsort_indices",
    lambda s, d: sorting.segsort_from_heads(_events(s, d).select("pos", "v"), _events(s, d).where("v % 7 = 0").select("pos"), "v"),
    f"WITH {_SEG} SELECT pos, v, seg_id, row_number() OVER (ORDER BY seg_id, v, pos) - 1 AS out FROM s",
)


# numeric

@query(
    """WITH e AS (SELECT vec_id AS k, unnest(range(0, len(embedding))) AS i, round(unnest(embedding)::DOUBLE * 1000)::BIGINT AS v FROM embeddings)
SELECT a.i, b.i AS j, sum(a.v * b.v)::BIGINT AS v FROM e a JOIN e b ON a.k = b.k GROUP BY a.i, b.i"""
)
def matmul(s: SparkSession, d: str) -> DataFrame:
    """The transpose of all vectors times themselves: as large as a vector is long, squared, whatever their number."""
    e = read_table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "x"))
    e = e.selectExpr("CAST(j AS BIGINT) AS i", "vec_id AS k", "CAST(round(x * 1000) AS BIGINT) AS v")
    return numeric.matmul(e, e.select("k", F.col("i").alias("j"), "v"))


@query("SELECT o_orderkey AS sys_id, [1.0, 2.0, 3.0]::DOUBLE[] AS x FROM orders")
def tridiagonal(s: SparkSession, d: str) -> DataFrame:
    """One system per order whose solution is (1, 2, 3)."""
    o = read_table(s, d, "orders").selectExpr("o_orderkey AS sys_id", "CAST(1 + o_custkey % 5 AS DOUBLE) AS t")
    sys = o.selectExpr("sys_id", "array(0D, t, t) AS l", "array(4 * t, 4 * t, 4 * t) AS d", "array(t, t, 0D) AS u", "array(6 * t, 12 * t, 14 * t) AS b")
    return numeric.solve_tridiagonal(sys).select("sys_id", F.transform("x", lambda v: F.round(v, 9)).alias("x"))


@query("WITH p AS (SELECT range AS point, xor(range, range >> 1) AS g FROM range(0, 4096)) SELECT point, 0::BIGINT AS dim, bit_xor(CASE WHEN (g >> i) & 1 = 1 THEN 1::BIGINT << (31 - i) ELSE 0 END)::BIGINT AS x, bit_xor(CASE WHEN (g >> i) & 1 = 1 THEN 1::BIGINT << (31 - i) ELSE 0 END)::DOUBLE / 4294967296 AS u FROM p, (SELECT range::INT AS i FROM range(0, 32)) GROUP BY point")
def sobol_first(s: SparkSession, d: str) -> DataFrame:
    return numeric.sobol(s, 4096, 1)


_DIRECTIONS = ", ".join(f"({d}, {i}, {v})" for d, vs in enumerate(numeric.sobol_directions(8)) for i, v in enumerate(vs))
_register(
    "sobol",
    lambda s, d: numeric.sobol(s, 4096, 8),
    f"WITH p AS (SELECT range AS point, xor(range, range >> 1) AS g FROM range(0, 4096)), v AS (SELECT * FROM (VALUES {_DIRECTIONS}) t(dim, i, v)) SELECT point, dim::BIGINT AS dim, bit_xor(CASE WHEN (g >> i) & 1 = 1 THEN v::BIGINT ELSE 0 END)::BIGINT AS x, bit_xor(CASE WHEN (g >> i) & 1 = 1 THEN v::BIGINT ELSE 0 END)::DOUBLE / 4294967296 AS u FROM p, v GROUP BY point, dim",
)

_register("sobol_many", lambda s, d: numeric.sobol(s, 256, 200).groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.shiftright("x", 24)).alias("cells")), "SELECT range AS dim, 256::BIGINT AS n, 256::BIGINT AS cells FROM range(0, 200)")

_STREAMS, _STEPS = 16, 1000


def _mrg_sql() -> str:
    """The generator as a recursion, from the first state of each stream."""
    x, y = numeric._mrg_states(0, _STREAMS, 1 << 67, 12345)
    start = ", ".join(f"({s}, {', '.join(map(str, [*x[:, s], *y[:, s]]))})" for s in range(_STREAMS))
    mod = lambda e, m: f"((({e}) % {m}) + {m}) % {m}"
    m1, m2 = numeric._M1, numeric._M2
    return f"""WITH RECURSIVE g AS (SELECT s::BIGINT AS stream, -1::BIGINT AS step, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d, e::BIGINT AS e, f::BIGINT AS f FROM (VALUES {start}) t(s, a, b, c, d, e, f)
UNION ALL SELECT stream, step + 1, b, c, {mod("1403580 * b - 810728 * a", m1)}, e, f, {mod("527612 * f - 1370589 * d", m2)} FROM g WHERE step < {_STEPS - 1}),
r AS (SELECT stream, step, (CASE WHEN c = f THEN {m1} ELSE {mod("c - f", m1)} END)::DOUBLE AS value, (CASE WHEN c = f THEN {m1} ELSE {mod("c - f", m1)} END)::DOUBLE / {m1 + 1} AS u FROM g WHERE step >= 0)"""


def _mrg(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: numeric.mrg32k3a(s, _STREAMS, _STEPS, distribution=kind).withColumn("value", F.round("value", 9))


_register("mrg32k3a_raw", _mrg("raw"), f"{_mrg_sql()} SELECT stream, step, value FROM r")
_register("mrg32k3a_uniform", _mrg("uniform"), f"{_mrg_sql()} SELECT stream, step, round(u, 9) AS value FROM r")
_register("mrg32k3a_exponential", _mrg("exponential"), f"{_mrg_sql()} SELECT stream, step, round(-ln(u), 9) AS value FROM r")
_register("mrg32k3a_gamma", _mrg("gamma"), f"{_mrg_sql()} SELECT stream, step // 2 AS step, round(-sum(ln(u)), 9) AS value FROM r GROUP BY stream, step // 2")
_register(
    "mrg32k3a_normal",
    _mrg("normal"),
    f"{_mrg_sql()} SELECT a.stream, a.step + k AS step, round(sqrt(-2 * ln(a.u)) * CASE WHEN k = 0 THEN cos(2 * pi() * b.u) ELSE sin(2 * pi() * b.u) END, 9) AS value FROM r a JOIN r b ON a.stream = b.stream AND b.step = a.step + 1 AND a.step % 2 = 0, (SELECT unnest([0::BIGINT, 1]) AS k)",
)


def _xorshift_sql(seed: int = 1) -> str:
    import numpy as np

    rows = ", ".join(f"({s}, {', '.join(map(str, np.random.SeedSequence([seed, s]).generate_state(8)))})" for s in range(_STREAMS))
    low = "4294967295"
    t1 = f"xor(h, (h << 13) & {low})"
    z = "xor(a, a >> 7)"
    new = f"xor(xor(xor(xor(xor({t1}, (({t1}) << 9) & {low}), xor(e, (e << 7) & {low})), xor(d, d >> 3)), xor(b, b >> 10)), xor({z}, (({z}) << 24) & {low}))"
    return f"""WITH RECURSIVE x AS (SELECT s::BIGINT AS stream, -1::BIGINT AS step, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d, e::BIGINT AS e, f::BIGINT AS f, g::BIGINT AS g, h::BIGINT AS h FROM (VALUES {rows}) t(s, a, b, c, d, e, f, g, h)
UNION ALL SELECT stream, step + 1, b, c, d, e, f, g, h, {new} FROM x WHERE step < {_STEPS - 1})"""


_register("xorshift7", lambda s, d: numeric.xorshift7(s, _STREAMS, _STEPS), f"{_xorshift_sql()} SELECT stream, step, h AS value FROM x WHERE step >= 0")
_register("xorshift7_jump", lambda s, d: numeric.xorshift7(s, _STREAMS, 100, skip=900), f"{_xorshift_sql()} SELECT stream, step, h AS value FROM x WHERE step >= 900")
_register("libor", lambda s, d: numeric.libor(s), None)


# forms of the above that nothing else asks for

@query(f"WITH {_O} SELECT pos, v, c, round(ln(product(1 + v % 3) OVER (PARTITION BY c ORDER BY pos {_INC})), 6) AS log_scanned FROM o")
def scan_mul(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d).withColumn("x", (1 + F.col("v") % 3).cast("double"))
    return scan.scan(o, "x", MUL, "inclusive", partition_by=["c"]).select("pos", "v", "c", F.round(F.log("scanned"), 6).alias("log_scanned"))


@query(f"WITH {_O} SELECT pos, v, c, pos // 32 AS tile, sum(v) OVER (PARTITION BY pos // 32 ORDER BY pos {_INC})::BIGINT AS scanned, sum(v) OVER (PARTITION BY pos // 32)::BIGINT AS aggregate FROM o")
def tile_scan_inclusive(s: SparkSession, d: str) -> DataFrame:
    return scan.tile_scan(_orders(s, d), "v", 32, kind="inclusive")


@query("WITH o AS (SELECT o_orderkey AS pos, o_custkey AS c, 1 + o_orderkey % 4 AS v FROM orders), r AS (SELECT *, min(pos) OVER (PARTITION BY c) AS p FROM o) SELECT c, round(sum(CASE WHEN pos = p THEN ln(v) ELSE -ln(v) END), 6) AS log_result FROM r GROUP BY c")
def ordered_fold_div(s: SparkSession, d: str) -> DataFrame:
    o = read_table(s, d, "orders").selectExpr("o_orderkey AS pos", "o_custkey AS c", "CAST(1 + o_orderkey % 4 AS DOUBLE) AS v")
    return red.ordered_fold(o, "v", lambda a, b: a / b, by=["c"]).select("c", F.round(F.log("result"), 6).alias("log_result"))


@query(
    """SELECT o_custkey AS x, list_sum(list_transform(range(32), lambda i: ((o_custkey >> i) & 1) << (31 - i)))::BIGINT AS brev,
((o_custkey & 255) | (((o_orderkey >> 8) & 255) << 8) | (((o_custkey >> 16) & 255) << 16) | (((o_orderkey >> 24) & 255) << 24))::BIGINT AS prmt, (o_custkey + 6) // 7 AS div_up FROM orders"""
)
def bit_permutations(s: SparkSession, d: str) -> DataFrame:
    x, y = F.col("o_custkey"), F.col("o_orderkey")
    return read_table(s, d, "orders").select(x.alias("x"), bits.brev(x).alias("brev"), bits.prmt(x, y, 0x7250).alias("prmt"), bits.div_up(x, 7).alias("div_up"))


@query(f"WITH {_E} SELECT pos, t, v, coalesce(lag(v // 5000) OVER (ORDER BY pos) <> v // 5000, true) AS head, coalesce(lead(v // 5000) OVER (ORDER BY pos) <> v // 5000, true) AS tail FROM e")
def discontinuity_equality(s: SparkSession, d: str) -> DataFrame:
    """Runs by an equality of one's own: values in one bracket of 5,000."""
    return compact.discontinuity(_events(s, d), "v", equal=lambda a, b: F.floor(a / 5000) == F.floor(b / 5000))


for _op, _short, _has in (("intersection", "intersect", "ca > 0 AND cb > 0"), ("union", "union_max", "true"), ("difference", "diff", "ca > 0 AND cb = 0"), ("symmetric", "symdiff", "(ca > 0) <> (cb > 0)")):
    _register(f"set_{_short}_distinct", lambda s, d, op=_op: sets.set_keys(*_set_sides(s, d), op, duplicates=False), f"WITH {_SA}, {_SB}, n AS (SELECT k, count(CASE WHEN s = 0 THEN 1 END) AS ca, count(CASE WHEN s = 1 THEN 1 END) AS cb FROM (SELECT k, 0 AS s FROM a UNION ALL SELECT k, 1 FROM b) GROUP BY k) SELECT k FROM n WHERE {_has}")


@query(f"WITH {_JA}, {_JB} SELECT a.pos AS a_pos, b.pos AS b_pos FROM a LEFT JOIN b ON a.k // 2 = b.k // 2")
def join_comparator(s: SparkSession, d: str) -> DataFrame:
    return joins.relational_join(*_join_sides(s, d), "left", comparable=F.floor(F.col("k") / 2))


@query("SELECT o_orderkey AS pos, o_custkey AS k, (o_custkey >> 3) & 15 AS digit, row_number() OVER (ORDER BY (o_custkey >> 3) & 15, o_orderkey) - 1 AS rank FROM orders")
def radix_rank(s: SparkSession, d: str) -> DataFrame:
    return sorting.radix_rank(_needles(s, d), 3, 4)


@query(f"WITH {_KEYS} SELECT pos, k, v, row_number() OVER (ORDER BY (k >> 2) & 255, pos) - 1 AS out FROM o")
def radix_sort(s: SparkSession, d: str) -> DataFrame:
    return sorting.radix_sort(_keyed(s, d), first=2, last=10)


@query(
    """WITH h AS (SELECT l_partkey % 1777 AS k, count(*) AS n FROM lineitem GROUP BY 1), q AS (SELECT DISTINCT o_custkey AS k FROM orders),
r AS (SELECT q.k, coalesce(sum(CASE WHEN h.k < q.k THEN n END), 0)::BIGINT AS idx, coalesce(bool_or(h.k = q.k), false) AS matched FROM q, h GROUP BY q.k)
SELECT o_orderkey AS pos, CASE WHEN matched THEN idx | 2147483648 ELSE idx END AS packed FROM orders JOIN r ON r.k = o_custkey"""
)
def sorted_search_packed(s: SparkSession, d: str) -> DataFrame:
    found = search.sorted_search(_needles(s, d), _haystack(s, d))
    return found.select("pos", search.packed(F.col("idx"), F.col("matched")).alias("packed"))


@query("SELECT row_number() OVER (ORDER BY n_name) - 1 AS pos, n_nationkey, n_name, n_regionkey FROM nation")
def positioned_source(s: SparkSession, d: str) -> DataFrame:
    return read_positioned(s, f"{d}/nation.parquet", ["n_name"]).select("pos", "n_nationkey", "n_name", "n_regionkey")


@query("SELECT p_partkey AS pos, unnest(range(0, p_size % 4)) AS rank, p_size AS value FROM part")
def sql_expand(s: SparkSession, d: str) -> DataFrame:
    """Interval expansion asked for in SQL."""
    tables.register(s)
    parts = _parts(s, d)
    return s.sql("SELECT p.pos, e.rank, CAST(e.value AS INT) AS value FROM {parts} p, LATERAL ordwise_expand(p.v, p.count) e", parts=parts)


@query("SELECT n_nationkey, t AS tile, t * 3 AS first, least(t * 3 + 3, n_nationkey) AS past FROM (SELECT n_nationkey, unnest(range(0, (n_nationkey + 2) // 3)) AS t FROM nation)")
def sql_tiles(s: SparkSession, d: str) -> DataFrame:
    tables.register(s)
    return s.sql("SELECT n.n_nationkey, t.* FROM {nation} n, LATERAL ordwise_tiles(n.n_nationkey, 3) t", nation=read_table(s, d, "nation"))


@query("SELECT n_nationkey, range AS pos, 5 + n_nationkey * range AS value FROM nation, range(0, 4)")
def sql_counting(s: SparkSession, d: str) -> DataFrame:
    tables.register(s)
    return s.sql("SELECT n.n_nationkey, c.* FROM {nation} n, LATERAL ordwise_counting(4, 5, n.n_nationkey) c", nation=read_table(s, d, "nation"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_sink(s: SparkSession, d: str) -> DataFrame:
    """A table written as CSV to the shared folder and read back."""
    nation = read_table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = f"{shared_dir(s)}/csv-{uuid.uuid4().hex}"
    write_csv(nation, path)
    return s.read.csv(path, header=True, schema=nation.schema)


ORACLES = {k: v for k, v in ORACLES.items() if v is not None}
