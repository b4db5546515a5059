"""Exact substring dedup by recompression.

A word that lies in a window of `window` consecutive words which also starts in a document with a smaller id is
removed. To find such windows without shuffling every window, texts are recompressed in rounds: each maximal run of
a symbol becomes one symbol, then each adjacent pair whose first symbol is of the left class and whose second of the
right class (a bit of their names). Names are hashes of what they stand for, so all documents name equal runs and
pairs alike without a dictionary. Along with each symbol goes the stretch of words that its parse depends on, and the
name of that stretch, made in the same rounds from the names of the symbols in it. Equal windows hold the same symbols
wherever that stretch lies within the window, whatever surrounds them.

  round 1  each window takes the name of its best such symbol (the highest level, then the least name); a Spark round
           finds the names that occur in more than one document: only windows around shared symbols can repeat.
  round 2  those windows are named whole, from other hashes of their words (96 bits besides the symbol's); a Spark
           round finds the least document id of each, which verifies the repeat.
  round 3  the covered words go.

Documents meet in buckets of about BUCKET_BYTES of text (one exchange, read by all three rounds), and a bucket sends
a name once however many of its documents hold it: a passage in a third of all documents is one row a bucket, and
the rows of one name pass through their task in sorted order without being gathered. Exact copies are found first by digest; the later ones lose everything or (under one window) nothing, and need no rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordwise.llm._shared import cut, trim

WINDOW = 13
LEVELS = 2
BUCKET_BYTES = 4 << 20
#: Words of a bucket that are parsed together.
PORTION = 1 << 16
_FAR = np.int64(1) << np.int64(40)
_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Parse:
    """Symbols of one level over all words of a bucket: name, covered words [start, end), needed words [lo, hi) and `full`,
    the name of these."""

    def __init__(self, name: np.ndarray, start: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, full: np.ndarray) -> None:
        self.name, self.start, self.end, self.lo, self.hi, self.doc, self.full = name, start, end, lo, hi, doc, full


def _named(*parts: np.ndarray) -> np.ndarray:
    """A name for a sequence of names."""
    out = parts[0]
    for x in parts[1:]:
        out = _mix(out * _MULT + x)
    return out


def _with(lo: np.ndarray, hi: np.ndarray, there: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretch that covers (lo, hi) and (lo2, hi2); without a neighbour there it is out of every window's reach."""
    return np.where(there, np.minimum(lo, lo2), -_FAR), np.where(there, np.maximum(hi, hi2), _FAR)


def recompress(p: Parse, level: int) -> Parse:
    """One round: runs to symbols, then left-right pairs to symbols. Beside a document's edge nothing is certain."""
    n = len(p.name)
    if not n:
        return p
    new = np.r_[True, (p.name[1:] != p.name[:-1]) | (p.doc[1:] != p.doc[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], n] - 1
    length = last - first + 1
    name = np.where(length == 1, p.name[first], _mix(p.name[first] + _MULT * length.astype(_U)))
    doc = p.doc[first]
    # that a run is maximal depends on the symbols beside it, hence on all that they depend on
    prv, nxt = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    has_prev, has_next = (first > 0) & (p.doc[prv] == doc), (last + 1 < n) & (p.doc[nxt] == doc)
    lo, hi = np.minimum.reduceat(p.lo, first), np.maximum.reduceat(p.hi, first)
    lo, hi = _with(lo, hi, has_prev, p.lo[prv], p.hi[prv])
    lo, hi = _with(lo, hi, has_next, p.lo[nxt], p.hi[nxt])
    full = _named(p.full[prv], p.full[first], length.astype(_U), p.full[last], p.full[nxt])
    start, end = p.start[first], p.end[last]

    right = (_mix(name + _U(level + 1)) & _U(1)).astype(bool)
    n = len(name)
    joined = np.zeros(n, bool)  # with the next
    joined[:-1] = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:])
    second = np.r_[False, joined[:-1]]
    nxt = np.minimum(np.arange(n) + 1, n - 1)
    prv = np.maximum(np.arange(n) - 1, 0)
    has_next = np.r_[doc[:-1] == doc[1:], False]
    has_prev = np.r_[False, has_next[:-1]]
    lone = ~joined & ~second
    lo_next, hi_next = _with(lo, hi, has_next, lo[nxt], hi[nxt])
    lo_prev, hi_prev = _with(lo, hi, has_prev, lo[prv], hi[prv])
    # a pair depends on both; a lone left symbol on the class of the next, a lone right one on that of the one before
    on_next, on_prev = joined | (lone & ~right), lone & right
    lo2 = np.where(on_next, lo_next, np.where(on_prev, lo_prev, lo))
    hi2 = np.where(on_next, hi_next, np.where(on_prev, hi_prev, hi))
    name2 = np.where(joined, _mix(name * _MULT + _mix(name[nxt] + _U(level * 2 + 3))), name)
    full2 = _named(np.where(on_prev, full[prv], full), np.where(on_next, full[nxt], full))
    end2 = np.where(joined, end[nxt], end)
    keep = ~second
    return Parse(name2[keep], start[keep], end2[keep], lo2[keep], hi2[keep], doc[keep], full2[keep])


def window_names(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A name for each stretch of `size` words (word hashes h), at its first word."""
    m = max(0, len(h) - size + 1)
    x = np.full(m, _U(seed))
    for j in range(size):
        x = _mix(x * _MULT + h[j : j + m])
    return x


def anchors(h: np.ndarray, doc: np.ndarray, starts: np.ndarray, window: int, levels: int = LEVELS) -> np.ndarray:
    """For the window at each of `starts`: the name of its interior.

    Each symbol that fits with what it depends on offers the name of that stretch to the windows around it. The
    highest level wins, then the least name. A single word fits in any window.
    """
    n = len(h)
    at = np.arange(n, dtype=np.int64)
    parses = [Parse(h, at, at + 1, at, at + 1, doc, h)]
    for level in range(levels):
        parses.append(recompress(parses[-1], level))
    none = _U(0xFFFFFFFFFFFFFFFF)
    best, open_ = np.full(len(starts), none), np.arange(len(starts))
    for level in range(levels, -1, -1):
        p = parses[level]
        fits = np.flatnonzero((p.hi - p.lo <= window) & (p.lo >= 0) & (p.hi <= n))
        lo, hi = p.lo[fits], p.hi[fits]
        offer = (_mix(p.full[fits] + _U(level)) >> _U(2)) | _U((levels - level) << 62)
        here = np.full(n + window, -1, np.int32)  # the symbol that starts at a word
        here[p.start[fits]] = np.arange(len(fits), dtype=np.int32)
        first, most = starts[open_], np.full(len(open_), none)
        for off in range(window):
            k = here[first + off]
            some = np.flatnonzero(k >= 0)
            k = k[some]
            ok = (lo[k] >= first[some]) & (hi[k] <= first[some] + window)
            some, k = some[ok], k[ok]
            most[some] = np.minimum(most[some], offer[k])
        best[open_] = most
        open_ = open_[most == none]  # only windows without a symbol look at lower levels
        if not len(open_):
            break
    return best


def portions(starts: np.ndarray, n: int, window: int, size: int = PORTION) -> Iterator[tuple[slice, slice]]:
    """Slices of `starts` (sorted, of n words), and of the words that the windows there hold: about `size` words each.

    A window is named by its own words, whatever surrounds them, so it may be named inside its slice.
    """
    for at in range(0, n, size):
        a, b = np.searchsorted(starts, (at, at + size)).tolist()
        if a < b:
            yield slice(a, b), slice(at, min(at + size + window - 1, n))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word of all texts (words, 2), text after text, and the number of words of each text."""
    split = pc.ascii_split_whitespace(texts.view(pa.string()))  # bytes are looked at one by one
    words = split.flatten().dictionary_encode()
    distinct = words.dictionary.view(pa.binary()).to_pylist()
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), _U).reshape(-1, 2)
    at = words.indices.to_numpy()
    there = np.array([bool(x) for x in distinct], bool)[at]  # white space at the ends leaves empty words
    upto = np.r_[0, np.cumsum(there)]
    ends = split.offsets.to_numpy()
    return h[at[there]], upto[ends[1:]] - upto[ends[:-1]]


class _Bucket:
    """The words of a bucket's documents that take part: those with an id that are no later copies."""

    def __init__(self, table: pa.Table, later: list[np.ndarray], window: int) -> None:
        ids = table.column("__id")
        self.known = ~np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy().astype(np.int64)
        self.later = np.isin(self.ids, later[0]) & self.known if len(later[0]) else np.zeros(len(self.ids), bool)
        copies = set(zip(*(x.tolist() for x in later)))
        for i in np.flatnonzero(self.later):  # another row of the same id may have a text of its own
            d = hashlib.md5(table.column("__text")[int(i)].as_py() or b"").hexdigest()
            self.later[i] = (int(self.ids[i]), int(d[:15], 16), int(d[15:30], 16)) in copies
        used = pa.array(self.known & ~self.later)
        both, self.counts = word_hashes(pc.if_else(used, _whole(table.column("__text")), pa.scalar(None, pa.binary())))
        self.h, self.other = both[:, 0], both[:, 1]
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.doc = self.ids[self.row]
        ends = np.repeat(np.cumsum(self.counts), self.counts)
        self.starts = np.flatnonzero(np.arange(len(self.h)) + window <= ends)  # where a window fits its text

    def interiors(self, window: int, size: int = PORTION) -> np.ndarray:
        """`anchors` of all windows; what a parse holds besides is some portion's."""
        name = np.empty(len(self.starts), np.int64)
        for s, w in portions(self.starts, len(self.h), window, size):
            name[s] = anchors(self.h[w], self.row[w], self.starts[s] - w.start, window).view(np.int64)
        return name

    def windows(self, window: int, size: int = PORTION) -> tuple[np.ndarray, np.ndarray]:
        w1, w2 = (np.empty(len(self.starts), np.int64) for _ in range(2))
        for s, w in portions(self.starts, len(self.h), window, size):
            h, other, first = self.h[w], self.other[w], self.starts[s] - w.start
            w1[s] = window_names(other, window, 11)[first].view(np.int64)
            w2[s] = (window_names(h ^ (other >> _U(7)), window, 23)[first] >> _U(32)).astype(np.int64)
        return w1, w2


def _least(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of distinct keys (their first indices), with the least and the largest doc of each."""
    if not len(doc):
        e = np.empty(0, np.int64)
        return e, e, e
    order = np.lexsort((doc, *keys))
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(new)
    return order[first], doc[order[first]], doc[order[np.r_[first[1:], len(order)] - 1]]


def _whole(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _shared_names(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, place), by name: the (bucket, name) of names in several buckets or documents.

    place: twice the bucket, and one more if several of its documents hold the name. A row is told as soon as its name
    is known to be shared; only the first row of a name ever waits.
    """
    wait: tuple[int, int] | None = None  # the name and bucket of a last row that is alone so far
    last = None  # the name of the last row
    for b in batches:
        name, place = (c.to_numpy() for c in b.columns)
        if not len(name):
            continue
        bucket = place >> 1
        new = np.r_[last is None or name[0] != last, name[1:] != name[:-1]]
        first = np.flatnonzero(np.r_[True, new[1:]])
        size = np.diff(np.r_[first, len(name)])
        told = (size > 1) | (place[first] & 1 > 0)
        if not new[0]:
            told[0] = True
            if wait is not None:
                yield _reply(np.array([wait[1]]), np.array([wait[0]]), np.zeros(1, np.int64), np.zeros(1, np.int64))
        rows = np.repeat(told, size)
        yield _reply(bucket[rows], name[rows], np.zeros(int(rows.sum()), np.int64), np.zeros(int(rows.sum()), np.int64))
        last = name[-1]
        wait = None if told[-1] else (int(name[-1]), int(bucket[-1]))


def _first_docs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, w2, least, largest, bucket), by all but the last two: each window's least id, to buckets with a larger one.

    The first row of a window has the least id, so rows are answered as they come.
    """
    before: tuple[int, int, int] | None = None  # w1, w2 and least id of the last row
    for b in batches:
        w1, w2, least, largest, bucket = (c.to_numpy() for c in b.columns)
        if not len(w1):
            continue
        new = np.r_[before is None or (w1[0], w2[0]) != before[:2], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]
        first = np.flatnonzero(np.r_[True, new[1:]])
        low = least[first]
        if not new[0]:
            low[0] = before[2]
        low = np.repeat(low, np.diff(np.r_[first, len(w1)]))
        told = largest > low
        yield _reply(bucket[told], w1[told], w2[told], low[told])
        before = (w1[-1], w2[-1], low[-1])


def _reply(bucket: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(np.ones(len(a), np.int32)), pa.array(a), pa.array(b), pa.array(c)], ["bucket", "kind", "a", "b", "c"])


_REPLY = "bucket int, kind int, a long, b long, c long"  # kind 0: a is the id of a later copy, b and c are of its digest; 1: an answer


def substring_dedup(docs: DataFrame, window: int = WINDOW, output: str = "digest", bucket_bytes: int = BUCKET_BYTES, counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """Documents (doc_id, text) to doc_id, n_words, n_removed and what is kept.

    output 'digest': kept_sha256, of the kept words joined by one space; 'text': all columns of `docs` with `text`
    cut (each removed word with the white space after it), besides the numbers of words and of removed ones under the
    names `counts`, which replace columns so named.

    Words are runs of anything but space and U+0009 to U+000D. Null and empty texts have no words. A row with a null
    doc_id keeps everything and removes nothing elsewhere; rows that repeat a doc_id are one document for the rule
    (equal ids are not smaller). An empty table gives no rows. A text is held whole by one task.
    """
    if output not in ("digest", "text"):
        raise ValueError(output)
    ident, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    seen = cut(docs.select(ident.alias("doc_id"), F.md5(text).alias("digest"), F.octet_length(text).cast("long").alias("bytes")), "digests")
    total = seen.agg(F.sum("bytes")).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    first = cut(seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first"), "copied")
    later = seen.join(first, F.col("digest") == F.col("d")).where("doc_id > first").select("doc_id", "digest").distinct()
    part = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    later = cut(later.select(bucket(F.col("doc_id")).alias("bucket"), F.lit(0).alias("kind"), F.col("doc_id").alias("a"), part(1).alias("b"), part(16).alias("c")), "later")

    outs = [c for c in docs.columns if c not in counts]
    extra = [c for c in outs if c != "text"] if output == "text" else []
    named = {c: f"x{i}" for i, c in enumerate(extra)}  # names of our own never clash with theirs
    dealt = docs.select(bucket(F.coalesce(ident, F.xxhash64(text))).alias("bucket"), ident.alias("__id"), F.col("text").cast("binary").alias("__text"), *[F.col(c).alias(k) for c, k in named.items()])
    by_bucket = dealt.groupBy("bucket")

    def with_later(fn):  # noqa: ANN001, ANN202
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            kind = right.column("kind").to_numpy()
            a, b, c = (right.column(x).to_numpy() for x in "abc")
            out = fn(left, _Bucket(left, [x[kind == 0] for x in (a, b, c)], window), a[kind == 1], b[kind == 1], c[kind == 1])
            trim()
            return out

        return run

    def name_interiors(left: pa.Table, k: _Bucket, *_: np.ndarray) -> pa.Table:
        name = k.interiors(window)
        at, least, largest = _least([name], k.doc[k.starts])
        which = left.column("bucket")[0].as_py() if left.num_rows else 0
        return pa.table({"name": name[at], "place": pa.array((2 * which + (largest > least)).astype(np.int64))})

    def name_windows(left: pa.Table, k: _Bucket, a: np.ndarray, *_: np.ndarray) -> pa.Table:
        some = np.isin(k.interiors(window), a)
        w1, w2 = (x[some] for x in k.windows(window))
        at, least, largest = _least([w1, w2], k.doc[k.starts][some])
        which = left.column("bucket")[0].as_py() if left.num_rows else 0
        return pa.table({"w1": w1[at], "w2": w2[at], "least": least, "largest": largest, "bucket": pa.array(np.full(len(at), which, np.int32))})

    def remove(left: pa.Table, k: _Bucket, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.Table:
        gone = np.zeros(len(k.h) + 1, np.int64)
        if len(a):
            w1, w2 = k.windows(window)
            order = np.lexsort((b, a))
            a, b, c = a[order], b[order], c[order]
            at = np.searchsorted(a, w1)
            hit = np.zeros(len(w1), bool)
            while True:  # windows with one w1 and several w2 are rare; each step looks at the next
                here = np.minimum(at, len(a) - 1)
                same = (at < len(a)) & (a[here] == w1)
                if not same.any():
                    break
                hit |= same & (b[here] == w2) & (c[here] < k.doc[k.starts])
                at = at + same
            np.add.at(gone, k.starts[hit], 1)
            np.add.at(gone, k.starts[hit] + window, -1)
        gone = np.cumsum(gone)[:-1] > 0
        ends = np.cumsum(k.counts)
        n_words, n_removed, kept = [], [], []
        for i, t in enumerate(left.column("__text").to_pylist()):
            null, t = t is None, t or b""
            if k.later[i] or not k.known[i]:
                size = len(t.split())
                mask = np.full(size, bool(k.later[i] and size >= window))
            else:
                mask = gone[ends[i] - k.counts[i] : ends[i]]
                size = len(mask)
            n_words.append(size)
            n_removed.append(int(mask.sum()))
            kept.append(_digest(t, mask) if output == "digest" else None if null else _cut(t, mask))
        what = {"kept_sha256": pa.array(kept, pa.string())} if output == "digest" else {"__kept": pa.array(kept, pa.binary())}
        return pa.table({"doc_id": left.column("__id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), **what, **{x: left.column(x) for x in named.values()}})

    interiors = by_bucket.cogroup(later.groupBy("bucket")).applyInArrow(with_later(name_interiors), "name long, place long")
    shared = interiors.repartition("name").sortWithinPartitions("name").select("name", "place").mapInArrow(_shared_names, _REPLY)
    whole = by_bucket.cogroup(shared.unionByName(later).groupBy("bucket")).applyInArrow(with_later(name_windows), "w1 long, w2 long, least long, largest long, bucket int")
    firsts = whole.repartition("w1", "w2").sortWithinPartitions("w1", "w2", "least").select("w1", "w2", "least", "largest", "bucket").mapInArrow(_first_docs, _REPLY)
    types = dict(docs.dtypes)
    schema = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if output == "digest" else "__kept binary") + "".join(f", {x} {types[c]}" for c, x in named.items())
    out = by_bucket.cogroup(firsts.unionByName(later).groupBy("bucket")).applyInArrow(with_later(remove), schema)
    if output == "digest":
        return out
    back: list[Column] = [F.col("__kept").cast("string").alias("text") if c == "text" else F.col(named[c]).alias(c) for c in outs]
    return out.select(*back, F.col("n_words").alias(counts[0]), F.col("n_removed").alias(counts[1]))


def _digest(text: bytes, mask: np.ndarray) -> str:
    w = text.split()
    if mask.any():
        w = [x for x, m in zip(w, mask.tolist()) if not m]
    return hashlib.sha256(b" ".join(w)).hexdigest()


def _cut(text: bytes, mask: np.ndarray) -> bytes:
    """The text without the masked words and the white space after each; other bytes stay as they are."""
    if not mask.any():
        return text
    b = np.frombuffer(text, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    start = ~space & np.r_[True, space[:-1]]
    word = np.cumsum(start) - 1  # white space belongs to the word before it
    keep = np.ones(len(b), bool)
    some = word >= 0
    keep[some] = ~mask[word[some]]
    return b[keep].tobytes()
