"""Near-duplicate embeddings by PCA-ordered tiled comparison.

All vectors give one rotation to principal axes, largest variance first. Unit vectors whose cosine reaches the
threshold t lie within w = sqrt(2 - 2t) of each other, hence within w on each leading axis: cells of width w on two
leading axes have partners in the adjacent cells only. A cell with more than CHUNK vectors is dealt into chunks. Each
chunk is the base of a tile, which the chunks after it of the same and adjacent cells visit; a vector thus travels
once to its own tile and to those it visits, half of the chunks around it. Visitors stream past the base in tiles:
dot products are accumulated over leading dimensions first, what remains is bounded by the product of suffix norms,
and a pair (or tile) stops as soon as it cannot reach the threshold. Pairs that get through are decided by the cosine
of the vectors as given, in double. A base with more than VISITORS visitors has several tasks.

Equal vectors are one class before that. A tile reports, for each class, how many vectors it linked and the least
class it reached, never its pairs; so hot vectors, cells and labels cost neither rows nor memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordwise.llm._shared import cut, join_small
from ordwise.llm.components import connected_components
from ordwise.llm.simhash_neardup import _Forest

#: Vectors of a base: as many as a task holds with ease, since a vector travels to each base that it visits.
CHUNK = 1 << 15
#: Visitors of a base in one task, on average, and at once.
VISITORS, STREAM = 1 << 20, 4096
#: Dimensions accumulated before each check of the bound; the last step takes the rest.
STEPS = (8, 16, 32)
#: Beyond rounding errors of the rotated products.
SLACK = 1e-9


def _matrix(col: pa.Array) -> np.ndarray:
    """List column without nulls and of one length to float64 rows."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def _one(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def rotation(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes (rows, by falling variance) of the unit vectors, for the most frequent dimension.

    vectors: embedding (valid). Sums of products are taken per partition and added up in Spark; the driver gets
    dimension squared numbers. Vectors of another dimension are compared along their own axes.
    """
    top = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if top is None:
        return {}
    d = top["d"]

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((d + 1, d)), 0
        for b in batches:
            x = _matrix(b.column(0))
            x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x.reshape(0, d)
            total[:d] += x.T @ x
            total[d] += x.sum(0)
            n += len(x)
        if n:
            flat = np.r_[total.ravel(), n]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    rows = vectors.where(F.size("embedding") == d).select("embedding").mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros((d + 1) * d + 1)
    for r in rows:  # dimension squared numbers
        flat[r["i"]] = r["v"]
    total, n = flat[:-1].reshape(d + 1, d), flat[-1]
    mean = total[d] / n
    _, axes = np.linalg.eigh(total[:d] / n - np.outer(mean, mean))
    return {d: np.ascontiguousarray(axes.T[::-1])}


def linked_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray | None, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of x, of y) with cosine >= threshold; same: x is y, and each pair comes once, first index smaller."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    ux, uy = x / nx[:, None], y / ny[:, None]
    if axes is not None:
        ux, uy = ux @ axes.T, uy @ axes.T
    d = ux.shape[1]
    stops = [s for s in STEPS if s < d] + [d]
    rest = lambda u: {s: np.sqrt(np.maximum((u[:, s:] ** 2).sum(1), 0.0)) for s in stops}
    rx, ry, least, tile = rest(ux), rest(uy), threshold - SLACK, 512
    for i in range(0, len(ux), tile):
        for j in range(i if same else 0, len(uy), tile):
            a, b = slice(i, i + tile), slice(j, j + tile)
            dots, at, pairs = ux[a, : stops[0]] @ uy[b, : stops[0]].T, stops[0], None
            for stop in stops[1:] + [None]:
                if pairs is None:
                    ok = dots + rx[at][a][:, None] * ry[at][b][None, :] >= least
                    if same and i == j:
                        ok &= np.tri(*ok.shape, k=-1, dtype=bool).T
                    p, q = np.nonzero(ok)
                    if not len(p):
                        break
                    if stop is not None and 20 * len(p) > ok.size:  # still dense: on with the whole tile
                        dots = dots + ux[a, at:stop] @ uy[b, at:stop].T
                        at = stop
                        continue
                    pairs, value = (p + i, q + j), dots[p, q]
                else:
                    ok = value + rx[at][pairs[0]] * ry[at][pairs[1]] >= least
                    pairs, value = (pairs[0][ok], pairs[1][ok]), value[ok]
                if not len(value):
                    break
                if stop is not None:
                    value = value + np.einsum("ij,ij->i", ux[pairs[0], at:stop], uy[pairs[1], at:stop])
                    at = stop
            if pairs is not None and len(pairs[0]):
                p, q = pairs
                for k in range(0, len(p), 1 << 15):
                    s = slice(k, k + (1 << 15))
                    exact = np.einsum("ij,ij->i", x[p[s]], y[q[s]]) / (nx[p[s]] * ny[q[s]])
                    ok = exact >= threshold
                    yield p[s][ok], q[s][ok]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, chunk: int = CHUNK, visitors: int = VISITORS) -> DataFrame:
    """Vectors (vec_id, embedding, label) to vec_id, n_links, component_id, kept; one row per vector.

    n_links counts the other vectors of the same label with cosine >= threshold; component_id is the least vec_id
    that links reach, itself included; kept: vec_id = component_id. Vectors that are null, empty, zero or hold null
    or non-finite components, have no label, or differ in dimension link with nothing, nor do rows without vec_id
    (component null, not kept). Rows with one vec_id and different vectors share the links of both. An empty table
    gives no rows; other columns are ignored.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    inf = F.lit(float("inf"))
    sound = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < inf)) & F.exists("embedding", lambda e: e != 0)
    ok = v.where(F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = cut(ok.groupBy("label", "embedding").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("mult")), "vector-classes")
    axes = rotation(classes.select("embedding"))
    width = float(np.sqrt(max(2 - 2 * threshold, 0.0))) + SLACK

    def lead(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(0).value_lengths().to_numpy(zero_copy_only=False)
            out = np.zeros((2, b.num_rows), np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _matrix(b.column(0).take(pa.array(at)))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                y = x @ axes[d][:2].T if d in axes else x[:, :2]
                out[: y.shape[1], at] = np.floor(y.T / width)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims, pa.int32()), pa.array(out[0]), pa.array(out[1])], [*b.schema.names, "d", "c1", "c2"])

    kind = dict(vectors.dtypes)["embedding"]
    placed = cut(classes.select("embedding", "label", "cid", "mult").mapInArrow(lead, f"embedding {kind}, label string, cid long, mult long, d int, c1 int, c2 int"), "placed")
    cell = ("label", "d", "c1", "c2")
    cells = cut(placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")), "cells")
    near = F.explode(F.array(*[F.struct((F.col("c1") + i).alias("n1"), (F.col("c2") + j).alias("n2")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}{i}") for i, c in enumerate(cell)], *[c for c in df.columns if c not in cell])
    at = lambda p, *cols: (F.col("label") == F.col(f"{p}0")) & (F.col("d") == F.col(f"{p}1")) & (F.col(cols[0]) == F.col(f"{p}2")) & (F.col(cols[1]) == F.col(f"{p}3"))
    around = cells.select(*cell, near.alias("near")).select(*cell, "near.n1", "near.n2")
    around = join_small(around, named(cells, "o"), at("o", "n1", "n2")).groupBy(*cell).agg(F.sum("n").alias("around"))
    parts = join_small(cells, named(around, "a"), at("a", "c1", "c2")).select(*cell, F.ceil(F.col("n") / chunk).cast("int").alias("chunks"), F.ceil(F.col("around") / visitors).cast("int").alias("tasks"))
    parts = cut(parts, "parts")
    own = named(parts.select(*cell, F.col("chunks").alias("own")), "m")
    rows = join_small(placed, own, at("m", "c1", "c2")).withColumn("c", F.pmod(F.xxhash64("cid"), F.col("own")).cast("int"))
    rows = rows.select("embedding", "cid", "mult", *cell, "c", near.alias("near")).select("*", "near.n1", "near.n2").drop("near")
    rows = join_small(rows, named(parts, "o"), at("o", "n1", "n2"))
    rows = rows.withColumn("oc", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    me, base = F.struct(F.col("c1").alias("x"), F.col("c2").alias("y"), F.col("c").alias("z")), F.struct(F.col("n1").alias("x"), F.col("n2").alias("y"), F.col("oc").alias("z"))
    rows = rows.where(me >= base).withColumn("visits", me > base)
    task = F.when(F.col("visits"), F.array(F.pmod(F.xxhash64("cid", F.lit(1)), F.col("tasks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("tasks") - 1))
    rows = rows.select("label", "d", F.col("n1").alias("b1"), F.col("n2").alias("b2"), F.col("oc").alias("b3"), "visits", "cid", "mult", "embedding", F.explode(task).alias("task"))
    key = ("tile", "label", "d", "b1", "b2", "b3", "task")
    tiles = rows.withColumn("tile", F.xxhash64("label", "d", "b1", "b2", "b3", "task"))  # only deals and sorts; the columns themselves tell tiles apart
    tiles = tiles.repartition("tile").sortWithinPartitions(*key, "visits")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(base: pa.Table, guests: pa.Table | None) -> pa.RecordBatch | None:
            """What a base links with its guests, or (without) within itself."""
            both = base if guests is None else pa.concat_tables([base, guests])
            cid, mult = (both.column(c).to_numpy() for c in ("cid", "mult"))
            x = _matrix(_one(both.column("embedding")))
            n, forest, m = np.zeros(len(x), np.int64), _Forest(len(x)), base.num_rows
            for p, q in linked_pairs(x[:m], x if guests is None else x[m:], axes.get(x.shape[1]), threshold, guests is None):
                q = q if guests is None else q + m
                np.add.at(n, p, mult[q])
                np.add.at(n, q, mult[p])
                forest.link(p, q)
            hit = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(cid[hit]), pa.array(n[hit]), pa.array(cid[forest.root[hit]])], ["cid", "n", "root"]) if len(hit) else None

        before, held, base = None, [], None  # the tile, base rows so far, the whole base
        for b in batches:
            if not b.num_rows:
                continue
            codes = [c.dictionary_encode().indices.to_numpy() if pa.types.is_string(c.type) else c.to_numpy(zero_copy_only=False) for c in (b.column(k) for k in (*key, "visits"))]
            new = np.r_[0, 1 + np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)), b.num_rows]
            for lo, hi in zip(new[:-1], new[1:]):  # rows of one tile and side
                tile = tuple(b.column(k)[lo].as_py() for k in key)
                part, guest = pa.Table.from_batches([b.slice(lo, hi - lo)]).select(["cid", "mult", "embedding"]), b.column("visits")[lo].as_py()
                if tile != before:
                    if held and base is None and before[-1] == 0 and (out := links(pa.concat_tables(held), None)) is not None:
                        yield out
                    before, held, base = tile, [], None
                if not guest:
                    held.append(part)
                    continue
                if base is None:
                    if not held:  # no vector fell into this chunk
                        continue
                    base = pa.concat_tables(held)
                    if tile[-1] == 0 and (out := links(base, None)) is not None:
                        yield out
                for k in range(0, part.num_rows, STREAM):
                    if (out := links(base, part.slice(k, STREAM))) is not None:
                        yield out
        if held and base is None and before[-1] == 0 and (out := links(pa.concat_tables(held), None)) is not None:
            yield out

    found = cut(tiles.select(*key, "visits", "cid", "mult", "embedding").mapInArrow(compare, "cid long, n long, root long"), "tile-links")
    per = found.groupBy("cid").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    known = classes.join(per, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
    known = cut(known.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "cid").alias("component_id")), "class-links")
    linked = ok.join(known, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left").select("vec_id", "n_links", "component_id")
    alone = v.where(~F.coalesce(sound, F.lit(False)) | F.col("label").isNull() | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
