"""Language identification by word-first backoff.

A word seen in training scores by its log frequency in each language. A word that wasn't falls back to its character
n-grams (with marks at its ends): the longest length of which any n-gram is known decides, and shorter ones only if
none is. Counts cover every training document, and every word and n-gram is scored by its full counts.

The count tables stay distributed. A bounded number of the most frequent words goes to the workers that read the
texts, and answers for most of them; what a document holds besides, it names with its counts, and these words get
their scores by joins: on the word table, and, for words that training never saw, on the n-gram table of each length
in turn. The limit of the broadcast thus decides how much is joined, never what a word scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordwise.llm._shared import cut, join_small

#: Words whose counts workers hold.
KNOWN_WORDS = 300_000
LONGEST = 5
#: Distinct words after which a counting task hands on what it has.
FLUSH = 200_000
#: Count of a word or n-gram in a language that never showed it.
ABSENT = 0.5
UNKNOWN = "und"


_ASCII, _WORD = re.compile("[a-z]+"), re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    text = text.lower()
    if text.isascii():
        return _ASCII.findall(text)
    found = _WORD.findall(text)
    if all(map(str.isalpha, found)):
        return found
    # numerals that are no digits pass for letters in the pattern
    return [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between marks; at n = 1 its letters alone."""
    w = f"^{word}$" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _grams(word: Column, n: int) -> Column:
    """The same as an array column."""
    w = F.concat(F.lit("^"), word, F.lit("$")) if n > 1 else word
    at = F.when(F.length(w) >= n, F.sequence(F.lit(1), F.length(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substr(w, i, F.lit(n)))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.int32()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])
        counts.clear()

    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1)
        for i, lang in enumerate(langs):
            counts.setdefault(lang, Counter()).update(words_of(texts[i].as_py()))
            if i % 64 == 63 and sum(map(len, counts.values())) > FLUSH:
                yield from out()
    yield from out()


class Model:
    """Counts per language. words: the distributed table (word, n: counts by language number)."""

    def __init__(self, langs: list[str], words: DataFrame | None, totals: list[int], distinct: int) -> None:
        self.langs, self.words, self.totals, self.distinct = langs, words, totals, distinct
        self.by_length: dict[int, tuple[DataFrame, list[int], int]] = {}

    def prior(self) -> np.ndarray:
        """Log share of each language; one without a word is never predicted."""
        with np.errstate(divide="ignore"):
            return np.log(np.array(self.totals, float) / max(1, sum(self.totals)))

    def grams(self, n: int) -> tuple[DataFrame, list[int], int]:
        """All n-grams of length n with their counts by language, the totals of these, and how many there are."""
        if n not in self.by_length:
            parts = self.words.select(F.explode(_grams(F.col("word"), n)).alias("gram"), "n")
            sums = parts.groupBy("gram").agg(F.array(*[F.sum(F.get("n", i)) for i in range(len(self.langs))]).alias("n"))
            self.by_length[n] = _with_totals(cut(sums, f"grams{n}"), len(self.langs))
        return self.by_length[n]


def _with_totals(table: DataFrame, n_langs: int) -> tuple[DataFrame, list[int], int]:
    row = table.agg(F.count(F.lit(1)), *[F.sum(F.get("n", F.lit(i))) for i in range(n_langs)]).first()
    return table, [x or 0 for x in row[1:]], row[0]


def fit(labelled: DataFrame) -> Model:
    """Learn from (lang, text), over all rows with both. The driver receives the languages and a total for each.

    A row of the word table is as wide as there are languages, which are taken to be few (not documents).
    """
    ok = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    langs = sorted(r["lang"] for r in ok.select("lang").distinct().collect())
    if not langs:
        return Model([], None, [], 0)
    number = F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)])
    counted = ok.select(F.element_at(number, F.col("lang")).alias("lang"), "text").mapInArrow(_count, "lang int, word string, n long")
    each = [F.coalesce(F.sum(F.when(F.col("lang") == i, F.col("n"))), F.lit(0)) for i in range(len(langs))]
    table, totals, distinct = _with_totals(cut(counted.groupBy("word").agg(F.array(*each).alias("n")), "word-counts"), len(langs))
    return Model(langs, table, totals, distinct)


def _logs(n: Column, totals: list[int], distinct: int) -> list[Column]:
    """Log probability in each language, from counts by language."""
    return [F.log(F.when(F.get(n, F.lit(i)) > 0, F.get(n, F.lit(i)).cast("double")).otherwise(ABSENT)) - F.lit(float(np.log(t + ABSENT * max(1, distinct)))) for i, t in enumerate(totals)]


class Reader:
    """Sums what the frequent words of documents score; one for each task."""

    def __init__(self, number: dict[str, int], rows: np.ndarray) -> None:
        self.number, self.rows = number, rows

    def read(self, texts: pa.Array) -> list[pa.Array]:
        """For each text the sum of scores by language (null without letters) and the other words with their counts."""
        get, size = self.number.get, self.rows.shape[1]
        sums, none, others, times, ends = np.zeros((len(texts), size)), np.zeros(len(texts), bool), [], [], [0]
        for i, t in enumerate(texts):
            words = words_of(t.as_py()) if t.is_valid else None
            none[i] = not words
            if words:
                at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                missing = np.flatnonzero(at < 0)
                if len(missing):
                    rest = Counter(map(words.__getitem__, missing.tolist()))
                    others.extend(rest)
                    times.extend(rest.values())
                    at = at[at >= 0]
                for k in range(0, len(at), 1 << 16):
                    sums[i] += self.rows[at[k : k + (1 << 16)]].sum(0)
            ends.append(len(others))
        flat = pa.StructArray.from_arrays([pa.array(others, pa.string()), pa.array(times, pa.int32())], ["w", "n"])
        known = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * size), pa.array(sums.ravel()), mask=pa.array(none))
        return [known, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]


def _frequent(model: Model, most: int) -> pa.Table:
    """The most frequent words, at most `most`, with their scores: those above a count that leaves so many."""
    bucket = F.floor(16 * F.log2(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)))
    tally = model.words.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("b")).collect()  # 16 a power of two
    n, least = 0, None
    for r in tally:
        n += r["c"]
        if n > most:
            break
        least = r["b"]
    some = model.words.where(bucket >= least if least is not None else F.lit(False))
    return some.select("word", *[c.alias(f"s{i}") for i, c in enumerate(_logs(F.col("n"), model.totals, model.distinct))]).toArrow()


def _unseen(words: DataFrame, model: Model) -> DataFrame:
    """Words (w) that training never saw to (w, v: score by language)."""
    out, rest = [], words
    langs = range(len(model.langs))
    for size in range(LONGEST, 0, -1):
        if not rest.limit(1).count():
            break
        table, totals, distinct = model.grams(size)
        parts = rest.select("w", F.explode(_grams(F.col("w"), size)).alias("g"))
        met = join_small(parts, table.select("gram", *[c.alias(f"s{i}") for i, c in enumerate(_logs(F.col("n"), totals, distinct))]), F.col("g") == F.col("gram"))
        found = cut(met.groupBy("w").agg(F.array(*[F.sum(f"s{i}") / size for i in langs]).alias("v")), f"backoff{size}")
        out.append(found)
        rest = cut(rest.join(found.select("w"), "w", "left_anti"), "unseen")
    out.append(rest.select("w", F.array(*[F.lit(0.0) for _ in langs]).alias("v")))
    scored = out[0]
    for x in out[1:]:
        scored = scored.unionByName(x)
    return scored


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, known_words: int = KNOWN_WORDS) -> DataFrame:
    """All columns of `docs` (or those of `keep`) with lang_pred and score (0 to 1), replacing columns so named.

    Null texts and texts without a letter: "und", 0. A text of letters of which nothing is known takes the most
    frequent language; of languages with one score the first by code point. An empty table gives no rows; repeated
    rows are predicted alike. Whole texts are read.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    if not model.langs:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    langs, kinds = range(len(model.langs)), dict(docs.dtypes)
    top = _frequent(model, known_words)
    rows = np.stack([top.column(f"s{i}").to_numpy() for i in langs], axis=1)
    shared = docs.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(top.column("word").to_pylist())}, rows))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *reader.read(b.column(b.num_columns - 1))], [*b.schema.names[:-1], "known", "other"])
        pa.default_memory_pool().release_unused()

    inner = docs.select(F.monotonically_increasing_id().alias("rid"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(kept)], F.col(text).cast("string").alias("t"))
    schema = "rid long, " + "".join(f"x{i} {kinds[c]}, " for i, c in enumerate(kept)) + "known array<double>, other array<struct<w:string,n:int>>"
    # written: from here on a row has its number, whatever is run again
    scored = cut(inner.mapInArrow(read, schema), "known-scores")
    named = scored.where(F.size("other") > 0).select("rid", F.explode("other").alias("o")).select("rid", F.col("o.w").alias("w"), F.col("o.n").alias("n"))
    distinct = cut(named.select("w").distinct().join(model.words.withColumnRenamed("n", "c"), F.col("w") == F.col("word"), "left").select("w", "c"), "other-words")
    vectors = distinct.where("c IS NOT NULL").select("w", F.array(*_logs(F.col("c"), model.totals, model.distinct)).alias("v"))
    vectors = cut(vectors.unionByName(_unseen(distinct.where("c IS NULL").select("w"), model)), "other-scores")
    more = named.join(vectors.withColumnRenamed("w", "k"), F.col("w") == F.col("k")).groupBy(F.col("rid").alias("r"))
    more = more.agg(F.array(*[F.sum(F.col("n") * F.get("v", F.lit(i))) for i in langs]).alias("more"))
    prior = F.array(*[F.lit(float(x)) for x in model.prior()])
    total = F.zip_with(F.zip_with("known", prior, lambda a, b: a + b), F.coalesce("more", F.array(*[F.lit(0.0) for _ in langs])), lambda a, b: a + b)
    out = scored.join(more, F.col("rid") == F.col("r"), "left").withColumn("total", total).withColumn("most", F.array_max("total"))
    best = F.get(F.array(*[F.lit(x) for x in model.langs]), (F.array_position("total", F.col("most")) - 1).cast("int"))
    score = F.lit(1.0) / F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most")))
    return out.select(*[F.col(f"x{i}").alias(c) for i, c in enumerate(kept)], F.coalesce(best, F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(score, F.lit(0.0)).alias("score"))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; null ids: null."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


__all__ = ["Model", "Reader", "fit", "grams", "predict", "remainder", "words_of"]
