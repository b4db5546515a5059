"""Quality classifier: naive Bayes support vectors.

A text is the set of its n-grams (words and word pairs; character strings of one to three bytes; which of five
neighbouring words are equal), hashed into DIM features. Features are scaled by their log-count ratio between the
classes, texts to about unit length (short ones to less, since they say less), and a linear hinge-loss model is fitted
to that by dual coordinate descent. A sigmoid fitted to texts held back turns margins into
probabilities.

The model is fitted on a bounded sample: at most ROWS labelled documents of each class, chosen by a hash of the id.
Its size is fixed, so its broadcast is too. Scoring reads whole texts, once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordwise.llm._shared import cut, map_column

DIM = 1 << 18
#: Labelled documents of each class that the model is fitted on, at most.
ROWS = 4_000
THRESHOLD = 0.7
C, EPOCHS = 1.0, 12
#: Added to squared lengths, as a share of their median.
FLOOR = 0.5
_CHUNK = 1 << 20
_WORDS_KEPT = 200_000
_M = np.uint32(0x9E3779B1)


def _fold(x: np.ndarray, salt: int) -> np.ndarray:
    """32-bit keys to feature numbers."""
    x = (x ^ np.uint32(salt)) * _M
    x ^= x >> np.uint32(15)
    return ((x * np.uint32(0x85EBCA6B)) >> np.uint32(14)).astype(np.int32)


class Features:
    """Distinct features of texts; remembers hashes of words and has room to mark features in."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}
        self.last = np.zeros(DIM, np.int64)

    def distinct(self, ids: np.ndarray) -> np.ndarray:
        order = np.arange(len(ids))
        self.last[ids] = order
        return ids[self.last[ids] == order]

    def of(self, text: bytes | None) -> np.ndarray:
        """Feature numbers, each once. Long texts are read in pieces that overlap by what an n-gram needs."""
        if not text:
            return np.empty(0, np.int32)
        found = []
        for i in range(0, len(text), _CHUNK):
            b = np.frombuffer(text, np.uint8, min(_CHUNK + 2, len(text) - i), i).astype(np.uint32)
            parts = [_fold(b, 1), _fold(b[:-1] << np.uint32(8) | b[1:], 2), _fold(b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:], 3)]
            found.append(self.distinct(np.concatenate(parts)))
        known, get = self.words, self.words.get
        w = text.split()
        h = np.empty(len(w), np.uint32)
        for k, x in enumerate(w):
            v = get(x)
            if v is None:
                if len(known) > _WORDS_KEPT:
                    known.clear()
                v = known[x] = xxhash.xxh32_intdigest(x)
            h[k] = v
        found += [_fold(h, 4), _fold(h[:-1] * np.uint32(31) + h[1:], 5)]
        e = (h[1:] == h[:-1]).astype(np.uint32)
        m = max(0, len(e) - 3)
        found.append(_fold(np.unique(e[:m] + 2 * e[1 : m + 1] + 4 * e[2 : m + 2] + 8 * e[3 : m + 3]), 6))
        return self.distinct(np.concatenate(found))


class Model:
    """A weight for each feature and its square scale; a margin is (sum of weights) / length + bias.

    floor: what is added to a text's squared length, so that a few features alone don't decide.
    """

    def __init__(self, weight: np.ndarray, square: np.ndarray, floor: float, bias: float, slope: float, shift: float) -> None:
        self.weight, self.square, self.floor, self.bias, self.slope, self.shift = weight, square, floor, bias, slope, shift

    def margin(self, ids: np.ndarray) -> float:
        length = float(np.sqrt(self.square[ids].sum() + self.floor))
        return (float(self.weight[ids].sum()) / length if length else 0.0) + self.bias

    def score(self, ids: np.ndarray) -> float:
        return _sigmoid(self.slope * self.margin(ids) + self.shift)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def _descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, floor: float, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """L1-loss linear SVM by dual coordinate descent: weights per feature (scales included) and the bias."""
    rng = np.random.default_rng(0)
    v = [scale[i] for i in rows]
    v = [x / max(float(np.sqrt((x * x).sum() + floor)), 1e-12) for x in v]
    square = [float(x @ x) + 1.0 for x in v]  # 1 for the bias
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            i, x = rows[k], v[k]
            g = y[k] * (float(w[i] @ x) + bias) - 1
            new = min(max(alpha[k] - g / square[k], 0.0), cost[k])
            if new != alpha[k]:
                step = (new - alpha[k]) * y[k]
                w[i] += step * x
                bias += step
                alpha[k] = new
    return w * scale, bias


def _calibrate(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0.1) and shift of the sigmoid that fits margins best, by Newton steps on weighted log loss."""
    a, b = 4.0, 0.0
    t = np.where(y > 0, 1 - 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        e, s = weight * (p - t), weight * p * (1 - p) + 1e-9
        grad = np.array([(e * m).sum() + 1e-3 * (a - 4), e.sum()])
        hess = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum()]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = max(0.1, a - step[0]), b - step[1]
    return float(a), float(b)


def train(rows: list[np.ndarray], y: np.ndarray, share: float) -> Model:
    """rows: distinct features of each text; y: +1 or -1; share: of class +1 among all labelled documents."""
    zero = np.zeros(DIM, np.float32)
    if not len(y) or abs(y.sum()) == len(y):  # nothing to tell apart
        p = 0.5 if not len(y) else 0.99 if y[0] > 0 else 0.01
        return Model(zero, zero, 0.0, 0.0, 0.0, float(np.log(p / (1 - p))))
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    use = np.flatnonzero(~held)
    count = {s: np.bincount(np.concatenate([np.empty(0, np.int32), *(rows[k] for k in use if y[k] == s)]), minlength=DIM) + 1.0 for s in (1, -1)}
    n = {s: (y[use] == s).sum() + 2.0 for s in (1, -1)}
    ratio = np.log(count[1] / n[1]) - np.log(count[-1] / n[-1])
    ratio[(count[1] + count[-1]) <= 3] = 0.0  # in one text alone
    cost = C * np.where(y[use] > 0, len(use) / (2 * (y[use] > 0).sum()), len(use) / (2 * (y[use] < 0).sum()))
    square = (ratio**2).astype(np.float32)
    floor = FLOOR * float(np.median([square[rows[k]].sum() for k in use]))
    weight, bias = _descend([rows[k] for k in use], y[use], ratio, floor, cost)
    model = Model(weight.astype(np.float32), square, floor, bias, 1.0, 0.0)
    test = np.flatnonzero(held) if held.any() else use
    m = np.array([model.margin(rows[k]) for k in test])
    part = np.where(y[test] > 0, share / max(1, (y[test] > 0).sum()), (1 - share) / max(1, (y[test] < 0).sum())) * len(test)
    model.slope, model.shift = _calibrate(m, y[test], part)
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """Learn from documents (doc_id, text) and labels (doc_id, label 0 or 1).

    Of each class, the `rows` labelled documents with the least hash of their id are fitted on. Other labels, and rows
    without id, are ignored; an id with both labels counts as 0, an id with several texts uses one of them. Without
    labels every score is 0.5, with one class alone 0.01 or 0.99.
    """
    told = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    told = cut(told.join(docs.where("doc_id IS NOT NULL").select("doc_id"), "doc_id", "left_semi"), "labels")
    size = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}  # two rows
    pick = lambda c: told.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = pick(0).unionByName(pick(1)).select(F.col("doc_id").alias("__id"), "label")

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for b in batches:
            ids = [f.of(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.sort(x) for x in ids], pa.list_(pa.int32()))], ["id", "label", "ids"])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))  # at most 2 * rows narrow rows
    found = joined.select("__id", "label", F.col("text").cast("binary")).mapInArrow(features, "id long, label int, ids array<int>")
    found = cut(found.groupBy("id").agg(F.min(F.struct("label", "ids")).alias("r")).select("id", "r.label", "r.ids"), "fitted-on")
    share = size.get(1, 0) / max(1, sum(size.values()))

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids = t.column("ids").combine_chunks()
        ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        y = np.where(t.column("label").to_numpy() == 1, 1, -1)
        order = np.random.default_rng(1).permutation(len(y))
        m = train([flat[ends[k] : ends[k + 1]] for k in order], y[order], share)
        return pa.table({"weight": [m.weight.tobytes()], "square": [m.square.tobytes()], "floor": [m.floor], "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})

    got = found.groupBy(F.lit("all")).applyInArrow(one, "weight binary, square binary, floor double, bias double, slope double, shift double").first()
    if got is None:
        return train([], np.empty(0, int), 0.5)
    return Model(np.frombuffer(got["weight"], np.float32), np.frombuffer(got["square"], np.float32), got["floor"], got["bias"], got["slope"], got["shift"])


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, output: str = "score") -> DataFrame:
    """All columns of `docs` (or those of `keep`) with `output` (0 to 1, higher: class 1 likelier), replacing one so named.

    Null and empty texts have no features and score what the bias alone says. Repeated rows score alike; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():  # noqa: ANN202
        f, m = Features(), shared.value

        def run(texts: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
            yield len(texts), [pa.array([m.score(f.of(x.as_py())) for x in texts.cast(pa.binary())], pa.float64())]

        return run

    return map_column(docs, text, "string", make, {output: "double"}, keep)


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS) -> Model:
    """The model of `label`, learned only from documents whose crc32(doc_id as text) mod 4 is not 2."""
    kept = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    return fit(docs.where(kept), labels.where(kept).select("doc_id", F.col(label).alias("label")), rows)
