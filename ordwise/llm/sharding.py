"""Sharding by extendible hashing.

A directory is an array indexed by the leading bits of a key's hash; each slot names a bucket, and several slots name
one bucket that needs fewer bits. Only a bucket above the byte limit splits, on one more bit, until every bucket fits.
Which buckets split follows from byte sums of hash prefixes alone: sums of the slots are rolled up, and each slot takes
the shallowest depth that fits. A key finds its bucket by one equality join on its slot. Slots too large even at the
directory's depth get a directory of their own, some bits deeper, which only their keys enter.

The directory's depth is that of an average bucket and two bits more, so it has a few slots for each shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordwise.llm._shared import cut, join_small

#: Bits of the hash that a directory can use.
BITS = 60
BYTE_LIMIT = 1 << 20


def _keys(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, n_bytes and the 60-bit hash h of the id; a row without id is hashed by its text."""
    key = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.conv(F.substring(key, 1, BITS // 4), 16, 10).cast("long").alias("h"), *more)


def _slot(depth: int) -> Column:
    return F.shiftright("h", BITS - depth)


def directory(keys: DataFrame, byte_limit: int) -> list[tuple[int, DataFrame]]:
    """The directories over (h, n_bytes): (bits, slots), where slots are slot, depth and shard_bytes.

    depth is null where the next directory decides. Keys with one and the same hash can't be split: their shard stays
    above the limit at depth 60.
    """
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    bits = (total // byte_limit).bit_length()
    least, depth = max(0, bits - 4), min(BITS, max(1, bits + 2))
    out, live = [], keys
    while True:
        fine = cut(live.groupBy(_slot(depth).alias("slot")).agg(F.sum("n_bytes").alias("b")), f"slots{depth}")
        if not out and least:  # buckets that would fit above `least` bits are rare: then all depths are looked at
            up = fine.groupBy(F.shiftright("slot", depth - least)).agg(F.sum("b").alias("b"))
            least = 0 if up.where(F.col("b") <= byte_limit).limit(1).count() else least
        paths = fine.select("slot", "b", F.explode(F.sequence(F.lit(least), F.lit(depth))).alias("d")).withColumn("prefix", F.expr(f"shiftright(slot, {depth} - d)"))
        fits = cut(paths.groupBy("d", "prefix").agg(F.sum("b").alias("sum")).where(F.col("sum") <= byte_limit).select(F.col("d").alias("fd"), F.col("prefix").alias("fp"), "sum"), f"fits{depth}")
        best = join_small(paths, fits, (F.col("d") == F.col("fd")) & (F.col("prefix") == F.col("fp"))).groupBy("slot").agg(F.min(F.struct("d", "sum")).alias("best"))
        slots = fine.join(best.withColumnRenamed("slot", "k"), F.col("slot") == F.col("k"), "left").select("slot", F.col("best.d").alias("depth"), F.coalesce("best.sum", "b").alias("shard_bytes"))
        if depth == BITS:
            slots = slots.withColumn("depth", F.coalesce("depth", F.lit(BITS)))
        slots = cut(slots, f"directory{depth}")
        out.append((depth, slots))
        over = slots.where("depth IS NULL").select(F.col("slot").alias("k"))
        if depth == BITS or not over.limit(1).count():
            return out
        live = join_small(live, over, _slot(depth) == F.col("k"), "left_semi")
        least, depth = depth + 1, min(BITS, depth + 8)


def _placed(rows: DataFrame, directories: list[tuple[int, DataFrame]]) -> DataFrame:
    """Rows with h to the same with depth, shard and shard_bytes instead."""
    cols, out = [c for c in rows.columns if c != "h"], None
    for bits, slots in directories:
        found = join_small(rows, slots.withColumnRenamed("slot", "k"), _slot(bits) == F.col("k"))
        shard_name = F.expr(f"left(lpad(bin(h), {BITS}, '0'), depth)").alias("shard")
        here = found.where("depth IS NOT NULL").select(*cols, F.col("depth").cast("int").alias("depth"), shard_name, "shard_bytes")
        out = here if out is None else out.unionByName(here)
        rows = found.where("depth IS NULL").select(*cols, "h")
    return out


def shard(docs: DataFrame, byte_limit: int = BYTE_LIMIT) -> DataFrame:
    """Documents (doc_id, text) to doc_id, n_bytes, depth, shard (the hash prefix as a bit string), shard_bytes.

    Every shard holds at most `byte_limit` bytes of text, unless all its rows share one doc_id (or are one row).
    A null text has 0 bytes; rows without doc_id are dealt by their text; repeated rows stay together; an empty
    table gives no rows; other columns are ignored.
    """
    keys = cut(_keys(docs).select("doc_id", "n_bytes", "h"), "keys")
    return _placed(keys, directory(keys, byte_limit))


def write_shards(docs: DataFrame, path: str, byte_limit: int = BYTE_LIMIT) -> str:
    """Write the documents, one folder of Parquet per shard, at `path`; a shard is written by one task.

    Gives the name of the column that the folders carry: shard, with underscores in front while a column is so named.
    """
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    hashed = _keys(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    directories = directory(cut(hashed.select("n_bytes", "h"), "keys"), byte_limit)
    placed = _placed(hashed.select("row", "h"), directories)
    placed.select("row.*", F.concat(F.lit("s"), "shard").alias(name)).repartition(name).write.partitionBy(name).parquet(path)
    return name
