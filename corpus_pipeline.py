"""The training-data pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns documents; the last one
adds their tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordwise.llm import mixing, quality_classifier, sentencepiece_codec, simhash_neardup, substring_dedup
from ordwise.llm._shared import cut, forget, mark, spread


def _free(docs: DataFrame, name: str) -> str:
    """`name`, or with underscores in front what no column of `docs` is called."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality classifier accepts. Null and empty texts are judged by the bias alone."""
    labels, name = spark.read.parquet(f"{sf_dir}/labels.parquet"), _free(docs, "score")
    scored = quality_classifier.score(docs, quality_classifier.learned(docs.select("doc_id", "text"), labels), output=name)
    return scored.where(F.col(name) >= quality_classifier.THRESHOLD).select(*docs.columns)


def neardup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group (5-word shingles, Jaccard >= 0.8): the least id's, null ids last.

    Null, empty and blank texts are one group; repeated rows are a group; an empty table gives no rows.
    """
    return simhash_neardup.drop_duplicates(docs)


def substring_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut words in windows that an earlier document holds; a document that loses everything goes.

    Null and empty texts stay as they are, and so do rows without doc_id; n_chars follows the text if there is one.
    """
    words, removed = _free(docs, "n_words"), _free(docs, "n_removed")
    out = substring_dedup.substring_dedup(docs, output="text", counts=(words, removed))
    out = out.where((F.col(removed) == 0) | (F.col(removed) < F.col(words)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it. Null texts count no words; null sources are a source of their own."""
    return mixing.apply_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with `tokens`, and `round_trip`: whether these decode to the text again (null for a null text).

    Columns of these names are replaced.
    """
    model, back = sentencepiece_codec.load(sentencepiece_codec.MODEL), _free(docs, "decoded")
    kept = [c for c in docs.columns if c not in ("tokens", "round_trip")]
    coded = sentencepiece_codec.encode_decode(docs.select(*kept), model, back=back)
    same = F.col(back) == F.replace(F.col("text"), F.lit(sentencepiece_codec.MARK), F.lit(" "))
    return coded.select(*kept, "tokens", same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", neardup_filter),
    ("substring dedup", substring_filter),
    ("mixing sources", mix_sources),
    ("SentencePiece", tokenize),
]

#: A trained classifier, fingerprints and hashed rounding have no SQL form; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each stage's rows are written and read again by the next."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    start = mark()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(start, docs)  # what the stage wrote on its way, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
