"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted the same fractional number of times, target / source size. The whole part is
taken outright. The fractional parts are rounded so that a source's words come out near its target: units are
paired, one of a pair takes the other's mass until one of the two is 0 or 1, and the unit still fractional goes on
to the next pair. Pairs are formed within blocks of a source's units ordered by size, so that mass moves between
documents of like size. What a block leaves over (at most one unit) enters the next level of the reduction tree; a
source's last unit is decided by a coin with its remaining probability.

Rows that agree in id, source, size and text are counted first: n of them with probability p are floor(n * p) taken
ones and one unit with what is left, so copies never meet in one block. Only DataFrame functions are used. A block
holds a bounded number of narrow rows, whatever a source's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordwise.llm._shared import cut, join_small, n_words

#: Rows that a block has on average; a hash deals them, so a block can have a few more.
BLOCK = 512
#: Copies of a row that are written out by one task.
RUN = 4096
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets per source: source, source_size, n_docs, target.

    sizes: source, size (long). The sources, by code point and null last, weigh `weights`, repeating, and share
    `share` of all words by weight; none gets more than `cap` times its own words, the excess going to the others
    by weight until none is above. One row per source passes through a single ordered window.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("limit_", F.lit(float(cap)) * F.col("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("limit_") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    level = (
        (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit_").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )  # words per unit of weight if the sources before this one are full and no other is
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit_"), F.struct(F.col("limit_") / F.col("weight"), "level"))).over(everything)["level"])
    full = F.coalesce(F.col("level"), F.lit(float("inf")))
    return per.select("source", "source_size", "n_docs", F.least("limit_", full * F.col("weight")).alias("target"))


def _coin(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone, so that a rerun or a retried task agrees."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


#: What a unit is: equal rows, of which `base` are taken once more than all are, and one with probability p.
_UNIT = ("doc_id", "digest", "n")


def _pivot(units: DataFrame, seed: int, level: int) -> DataFrame:
    """One level of the tree: units (source, size, base, p, ...) in blocks to units done (p = -1) or left over."""
    unit = "struct<neg:bigint, doc_id:bigint, digest:string, n:bigint, base:bigint, p:double>"

    def made(x: Column, base: Column, p: Column) -> Column:
        return F.struct(x["neg"].alias("neg"), *[x[c].alias(c) for c in _UNIT], base.cast("long").alias("base"), p.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        a, b, had = acc["carry"], x, acc["carry"].isNotNull()
        pa, pb = a["p"], b["p"]
        both = pa + pb
        u = _coin(F.lit(seed), F.lit(level), a["doc_id"], b["doc_id"], a["digest"], b["digest"], a["neg"], b["neg"], acc["n"])
        low = both < 1 - EPS
        a_goes_on = F.when(low, u * both < pa).otherwise(u * (2 - both) >= 1 - pb)
        # low: who goes on has all the mass, the other 0; else who stops has 1 and the other goes on with the rest
        stops = F.when(low, F.lit(0)).otherwise(F.lit(1))
        left = F.when(low, both).otherwise(F.greatest(both - 1, F.lit(0.0)))
        on = F.when(a_goes_on, a).otherwise(b)
        off = F.when(a_goes_on, b).otherwise(a)
        done, whole = made(off, off["base"] + stops, F.lit(-1.0)), left < EPS
        out = F.concat(acc["out"], F.array(done), F.when(whole, F.array(made(on, on["base"], F.lit(-1.0)))).otherwise(F.array().cast(f"array<{unit}>")))
        carry = F.when(~whole, made(on, on["base"], left))
        return F.struct(
            F.when(had, out).otherwise(acc["out"]).alias("out"),
            F.when(had, carry).otherwise(b).alias("carry"),
            (acc["n"] + 1).alias("n"),
        )

    start = F.struct(F.array().cast(f"array<{unit}>").alias("out"), F.lit(None).cast(unit).alias("carry"), F.lit(0).alias("n"))
    finish = lambda acc: F.when(acc["carry"].isNotNull(), F.concat(acc["out"], F.array(acc["carry"]))).otherwise(acc["out"])
    block = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("neg"), *_UNIT, "base", "p")))
    return (
        units.groupBy("source", "block")
        .agg(block.alias("units"))
        .select("source", F.explode(F.aggregate("units", start, step, finish)).alias("u"))
        .select("source", *[F.col(f"u.{c}").alias(c) for c in _UNIT], (-F.col("u.neg")).alias("size"), F.col("u.base").alias("base"), F.col("u.p").alias("p"))
    )


def copies(sizes: DataFrame, targets: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """How often to take rows: doc_id, source, size, digest, n (equal rows), source_size, target, base, extra.

    sizes: doc_id, source, size, digest (of the text); targets as of `source_targets`. `extra` of the n rows are taken
    base + 1 times, the others `base` times. A null doc_id is a value like any other.
    """
    t = targets.select("source", "source_size", "target", "n_docs")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + EPS)
    plan = t.withColumn("always", whole.cast("int")).withColumn("rate", F.when(rate - whole > EPS, rate - whole).otherwise(F.lit(0.0))).withColumnRenamed("source", "s")
    classes = sizes.groupBy("source", "doc_id", "size", "digest").agg(F.count(F.lit(1)).alias("n"))
    units = join_small(classes, plan.select("s", "rate", "n_docs"), F.col("source").eqNullSafe(F.col("s")), "inner")
    mass = F.col("n") * F.col("rate")
    units = units.withColumn("base", F.floor(mass + EPS)).withColumn("p", mass - F.col("base"))
    units = units.withColumn("p", F.when(F.col("p") > EPS, F.col("p")).otherwise(F.lit(0.0)))
    cols = ["source", "doc_id", "size", "digest", "n", "base"]
    most = plan.where(F.col("rate") > 0).agg(F.max("n_docs")).first()[0] or 0
    blocks = F.greatest(F.ceil(F.col("n_docs") / block), F.lit(1))
    live = units.where(F.col("p") > 0).select(*cols, "p", blocks.alias("blocks"))
    level, done = 0, [units.where(F.col("p") == 0).select(*cols)]
    while True:
        keyed = live.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size", "digest"), F.col("blocks")))
        got = cut(_pivot(keyed, seed, level), f"pivot{level}")
        left = got.where(F.col("p") >= 0)
        done.append(got.where(F.col("p") < 0).select(*cols))
        most, level = -(-most // block), level + 1
        if most <= 1:
            break
        count = F.greatest(F.ceil(F.col("n_docs") / F.lit(float(block) ** (level + 1))), F.lit(1))
        live = join_small(left, plan.select("s", count.alias("blocks")), F.col("source").eqNullSafe(F.col("s")), "inner").drop("s")
    rows = left.withColumn("base", F.col("base") + (_coin(F.lit(seed), F.lit(-1), F.col("source"), F.col("doc_id"), F.col("digest")) < F.col("p")).cast("int")).select(*cols)
    for x in done:
        rows = rows.unionByName(x)
    out = join_small(rows, plan.select("s", "source_size", "target", "always"), F.col("source").eqNullSafe(F.col("s")), "inner")
    return out.select("doc_id", "source", "size", "digest", "n", "source_size", "target", F.col("always").alias("base"), F.col("base").alias("extra"))


def _repeated(df: DataFrame, times: str) -> DataFrame:
    """Every row of `df` as often as its column `times` says, without that column; rows with many are dealt out first."""
    again = lambda x, n: x.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), n.cast("long")))).drop(times)
    some = df.where(F.col(times) > 0)
    out = again(some.where(F.col(times) <= RUN), F.col(times))
    many = some.where(F.col(times) > RUN)
    if many.limit(1).count():
        part = f"{times}_part"
        many = many.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / RUN)))).repartition(part, times)
        many = many.withColumn(times, F.least(F.lit(RUN), F.col(times) - RUN * F.col(part))).drop(part)
        out = out.unionByName(again(many, F.col(times)))
    return out


def _sized(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("digest")]


def _taken(docs: DataFrame, seed: int, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    sizes = cut(docs.select(*_sized(docs)), "sizes")
    return cut(copies(sizes, cut(source_targets(sizes, weights, share, cap), "targets"), seed), "copies")


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Documents (doc_id, text, source) to doc_id, source, size, source_size, target, copies, taken (= copies * size).

    One row for each document, also for repeated rows, each of which is taken for itself. A null text has size 0; a
    null source is a source of its own, a null doc_id a value like any other; an empty table gives no rows; other
    columns are ignored. No document is taken more than ceil(cap) times.
    """
    of = _taken(docs, seed, weights, share, cap)
    each = F.array(F.struct((F.col("base") + 1).cast("int").alias("copies"), F.col("extra").alias("times")), F.struct(F.col("base").alias("copies"), (F.col("n") - F.col("extra")).alias("times")))
    rows = of.select("doc_id", "source", "size", "source_size", "target", F.explode(each).alias("c")).select("*", "c.copies", "c.times").drop("c")
    return _repeated(rows, "times").withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mixed documents themselves: every row as often as `mix` takes it, columns unchanged.

    Of rows that agree in id, source and text, the least by all columns are taken more often. Nulls as in `mix`; an
    empty table gives no rows; names of other columns don't matter.
    """
    cols = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), *_sized(docs))
    key = ("doc_id", "source", "size", "digest")
    of = _taken(docs, seed, weights, share, cap).select(*[F.col(c).alias(f"m_{c}") for c in key], "n", "base", "extra")
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"m_{c}"))
    lone = inner.join(of.where((F.col("n") == 1) & (F.col("base") + F.col("extra") > 0)), on).select("row", (F.col("base") + F.col("extra")).alias("times"))
    out = lone.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row")
    if of.where("n > 1").limit(1).count():  # counted first: a class of any size is few rows
        same = inner.join(of.where("n > 1"), on).groupBy("row", *key, "base", "extra").agg(F.count(F.lit(1)).alias("c"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*key).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        more = F.greatest(F.lit(0), F.least(F.col("c"), F.col("extra") - before))
        out = out.unionByName(_repeated(cut(same.select("row", (F.col("c") * F.col("base") + more).alias("times")), "copied"), "times").select("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in cols])


__all__ = ["apply_mix", "copies", "mix", "source_targets"]
