"""Rule filter whose thresholds adapt to each language and source.

Per document a few counts are taken. The documents that pass two fixed base rules feed mergeable quantile sketches
(KLL), one for each metric, language and source; sketches of small groups are merged into their language's, and
those of small languages into one of all. Their quantiles are the thresholds, joined back to the counts:

  what should be rare (symbols, repeated lines, repeated words, each a word): some times the group's usual upper level.
      That level climbs from the median over the quantiles of CLIMB while they rise steadily; above a gap stands what
      does not belong to the group, however much of it there is. A source in which symbols are common allows them.
  mean word length: some interquartile ranges around the group's median, and the spread that few words make.

No threshold is a constant; only whole items of rounding are added. Only DataFrame functions are used; the text is read
once, and only counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordwise.llm._shared import SPACE, cut, join_small, words

SYMBOLS = "#*$%&|<>"
#: Entries of a sketch; up to about so many rows its quantiles are exact.
SKETCH_K = 4096
#: A group with fewer rows takes its language's thresholds, a language with fewer those of all rows.
LEAST_ROWS = 30
#: Metric: (numerator, what the next quantile may add to three times the one below, items that are always allowed).
METRICS = {"symbols": ("n_symbols", 0.02, 2), "dup_lines": ("n_dup_lines", 0.01, 1), "repeats": ("n_repeat_words", 0.05, 10)}
CLIMB = (50, 75, 90, 95, 99)
#: The level may be exceeded so many times.
TIMES = 3.0
#: Mean word length may leave the median by so many interquartile ranges, and characters times 1/sqrt(words).
WORD_LENGTH = (4.0, 8.0)


def counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source"), text: str = "text") -> DataFrame:
    """The columns `keep` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    long = lambda c: c.cast("long")
    df = docs.select(*keep, t.alias("__t"), words(F.col(text)).alias("__w"), lines.alias("__lines"))
    df = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    n = F.size("__w")
    df = df.select(
        *keep,
        long(n).alias("n_words"),
        long(F.length(F.array_join("__w", ""))).alias("word_chars"),
        long(F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get("__h", i + k) for k in range(5)]))).otherwise(F.array().cast("array<long>")).alias("__five"),
        "__w",
    )
    some = F.size(F.array_distinct("__five")) < F.size("__five")  # few texts repeat anything: only their words are compared
    five = F.transform("__five", lambda _, i: F.struct(F.array_join(F.slice("__w", i + 1, 5), " ").alias("k"), i.alias("i")))
    df = df.withColumn("__sorted", F.when(some, F.sort_array(five)))
    same = lambda x, j: (x["k"] == F.get("__sorted", j - 1)["k"]) | (x["k"] == F.get("__sorted", j + 1)["k"])
    at = F.transform(F.filter("__sorted", lambda x, j: F.coalesce(same(x, j), x["k"] == F.get("__sorted", j + 1)["k"], x["k"] == F.get("__sorted", j - 1)["k"])), lambda x: x["i"])
    df = df.withColumn("__at", F.sort_array(at))
    covered = F.aggregate(F.transform("__at", lambda p, j: F.least(F.lit(5), F.coalesce(F.get("__at", j + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", long(F.coalesce(covered, F.lit(0))))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.drop("__w", "__five", "__sorted", "__at").withColumn("base_failed", failed)


def _ratio(name: str) -> Column:
    return F.col(name).cast("double") / F.col("n_words")


def thresholds(counted: DataFrame) -> DataFrame:
    """Per (lang, source): top_symbols, top_dup_lines, top_repeats, mid_length, len_range, from merged sketches."""
    ok = counted.where(~F.col("base_failed"))
    metric = {k: _ratio(v[0]) for k, v in METRICS.items()} | {"length": _ratio("word_chars")}
    group = cut(ok.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(c, F.lit(SKETCH_K)).alias(k) for k, c in metric.items()]), "sketches")
    merged = lambda df, keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(k, F.lit(SKETCH_K)).alias(k) for k in metric])
    by_lang = cut(merged(group, ["lang"]), "lang-sketches")
    of_all = merged(by_lang, [])

    def quantiles(df: DataFrame, prefix: str) -> DataFrame:
        at = lambda k: F.array(*[F.kll_sketch_get_quantile_double(k, F.lit(q / 100)) for q in (25, *CLIMB)]).alias(f"{prefix}_{k}")
        return df.select(*[c for c in df.columns if c in ("lang", "source")], F.col("n").alias(f"{prefix}_n"), *[at(k) for k in metric])

    g, lang, al = quantiles(group, "g"), quantiles(by_lang, "l").withColumnRenamed("lang", "l"), quantiles(of_all.where("n > 0"), "a")
    t = join_small(g, lang, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(al), F.lit(True), "left")  # al: one row
    pick = lambda k: F.when(F.col("g_n") >= LEAST_ROWS, F.col(f"g_{k}")).when(F.col("l_n") >= LEAST_ROWS, F.col(f"l_{k}")).otherwise(F.col(f"a_{k}"))
    t = t.select("lang", "source", *[pick(k).alias(k) for k in metric])

    def top(k: str) -> Column:
        steady = lambda a, x: a["on"] & (x <= 3 * a["top"] + METRICS[k][1])
        climb = lambda a, x: F.struct(F.when(steady(a, x), x).otherwise(a["top"]).alias("top"), steady(a, x).alias("on"))
        return F.aggregate(F.slice(k, 3, len(CLIMB) - 1), F.struct(F.get(k, F.lit(1)).alias("top"), F.lit(True).alias("on")), climb, lambda a: a["top"]).alias(f"top_{k}")

    at = lambda i: F.get("length", F.lit(i))
    return t.select("lang", "source", *[top(k) for k in METRICS], at(1).alias("mid_length"), (at(2) - at(0)).alias("len_range"))


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, and kept: within every fence of the document's language and source.

    A null text counts as empty and fails the base rules; null languages and sources are groups like others; an
    empty table gives no rows; repeated rows are judged alike. A group all of whose documents fail the base rules
    has no fences and needs none. Words are runs of anything but space and U+0009 to U+000D.
    """
    counted = cut(counts(docs, text=text), "counts")
    fences = cut(thresholds(counted).withColumnsRenamed({"lang": "__l", "source": "__s"}), "fences")
    on = F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s"))
    out = join_small(counted, fences, on, "left")
    iqr, thin = WORD_LENGTH
    inside = F.abs(_ratio("word_chars") - F.col("mid_length")) <= iqr * F.col("len_range") + thin / F.sqrt("n_words")
    for k, (count, _, items) in METRICS.items():
        inside = inside & (F.col(count) <= TIMES * F.col(f"top_{k}") * F.col("n_words") + items)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(True)))
    return out.select(*counted.columns, kept.alias("kept"))
