"""SentencePiece encoding and decoding with a forward pass shared by common prefixes.

Texts are marked (spaces become U+2581, one is put in front) and split into marked words at places that no piece
spans, so each word can be encoded alone. The distinct new words of a batch are sorted, which orders them as the
leaves of a trie, and walked depth first: the forward states of a word's characters depend only on its prefix, so
those of the prefix it shares with the word before are kept and only the rest is computed.

  unigram models  a state is the best score of the prefix and where its last piece starts (Viterbi).
  BPE models      merging is not a best path by score, but it has a forward form too: a prefix's encoding is that of a
                  shorter prefix plus one last piece, and of all pieces that end there exactly one is right, namely
                  one that merging keeps apart from the last piece of the shorter prefix. Whether it does is decided by
                  merging the two pieces' characters, once for each pair of pieces.

Texts stay in their partitions: there is no shuffle, and a task keeps the codes of a bounded number of words.
The model is read on the driver from a path that the caller names, and never trained.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ordwise.llm._shared import map_column

MARK = "▁"
#: The public model that the registered query encodes with.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose codes a task keeps, and bytes of text that are encoded at once.
CACHE_WORDS = 600_000
BATCH_BYTES = 4_000_000


class Vocabulary:
    """Pieces, scores and special ids of a model; picklable."""

    def __init__(self, pieces: list[str], scores: list[float], kind: str, byte_ids: list[int], unk: int, control: list[int], dummy_prefix: bool = True) -> None:
        self.pieces, self.kind, self.byte_ids, self.unk, self.control, self.dummy_prefix = pieces, kind, byte_ids, unk, set(control), dummy_prefix
        special = {unk, *control, *byte_ids}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special}
        self.scores = scores
        self.longest = max(map(len, self.ids), default=1)
        alphabet = {c for p in self.ids if len(p) > 1 for c in p} - {MARK}
        inside = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        letters = "".join(map(re.escape, sorted(alphabet)))
        # words: marks and what follows them; characters of no longer piece stand alone. A vocabulary with marks
        # inside pieces has no such places, and a whole text is one word.
        self.apart_at_spaces = dummy_prefix and not inside
        self.words = re.compile(".+" if inside else f"{MARK}*[{letters}]+|{MARK}+|[^{MARK}{letters}]" if letters else ".", re.DOTALL)

    def mark(self, text: str) -> str:
        return (MARK if self.dummy_prefix and text else "") + text.replace(" ", MARK)

    def bytes_of(self) -> list[bytes]:
        """What each id stands for in a decoded text."""
        out = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        for i in self.control:
            out[i] = b""
        out[self.unk] = " ⁇ ".encode()
        return out


def load(path: str) -> Vocabulary:
    """Read a model file; models that normalize more than marking spaces are refused, for they would be misread."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    n, t = proto.normalizer_spec, proto.trainer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or t.treat_whitespace_as_suffix:
        raise ValueError("only models with identity normalization are supported")
    kinds = [p.type for p in proto.pieces]
    if 4 in kinds or 5 in kinds:
        raise ValueError("user-defined and unused pieces are not supported")
    by_byte = sorted((int(p.piece[1:-1], 16), i) for i, p in enumerate(proto.pieces) if p.type == 6)
    return Vocabulary(
        [p.piece for p in proto.pieces], [p.score for p in proto.pieces], {1: "unigram", 2: "bpe"}[t.model_type],
        [i for _, i in by_byte] if t.byte_fallback else [], kinds.index(2), [i for i, k in enumerate(kinds) if k == 3], n.add_dummy_prefix,
    )


def merge(symbols: str, ids: dict[str, int], scores: list[float]) -> list[str]:
    """Plain BPE: again and again join the neighbours whose piece scores best, leftmost first. For short strings."""
    parts: list[str | None] = list(symbols)
    right, left = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(-scores[i], k, 2) for k in range(len(parts) - 1) if (i := ids.get(symbols[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, size = heapq.heappop(heap)
        j = right[k] if parts[k] is not None else len(parts)
        if j >= len(parts) or len(parts[k]) + len(parts[j]) != size:
            continue
        parts[k], parts[j] = parts[k] + parts[j], None
        right[k] = right[j]
        if right[k] < len(parts):
            left[right[k]] = k
        for a, b in ((left[k], k), (k, right[k])):
            if a >= 0 and b < len(parts) and (i := ids.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-scores[i], a, len(parts[a]) + len(parts[b])))
    return [p for p in parts if p is not None]


def _shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Encoder:
    """Codes of marked words; one for each task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = v = vocabulary
        self.codes: dict[str, bytes] = {}  # of chunks between spaces
        self.again: set[str] = set()
        self.unknown_score = min((v.scores[i] for i in v.ids.values()), default=0.0) - 10.0
        # BPE: only pieces that merging their characters gives back can end an encoding
        self.usable = {p for p in v.ids if v.kind == "unigram" or len(p) == 1 or merge(p, v.ids, v.scores) == [p]}
        self.bytes_of = {p: np.array([i], np.int32).tobytes() for p, i in v.ids.items()}
        self.by_bytes: dict[str, bytes] = {}  # of characters that are no piece
        long: dict[str, set[int]] = {}
        for p in self.usable:
            if len(p) > 4:
                long.setdefault(p[-4:], set()).add(len(p))
        self.long = {k: tuple(sorted(n, reverse=True)) for k, n in long.items()}
        #: for the last four characters of a prefix, how long a usable piece that ends there can be, longest first
        self.sizes: dict[str, tuple[int, ...]] = {}
        #: for a last piece, the pieces after it: whether merging leaves the two as they are
        self.apart: dict[str, dict[str, bool]] = {}
        self.n_apart = 0

    def _code(self, pieces: Iterable[str]) -> bytes:
        out, byte_ids, after_unknown = [], self.v.byte_ids, False
        for p in pieces:
            known = self.bytes_of.get(p)
            if known is not None:
                out.append(known)
            elif byte_ids:
                out.append(np.array([byte_ids[b] for b in p.encode("utf-8", "surrogatepass")], np.int32).tobytes())
            elif not after_unknown:  # neighbouring unknowns are one
                out.append(np.array([self.v.unk], np.int32).tobytes())
            after_unknown = known is None
        return b"".join(out)

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Codes of words, from walking their trie depth first."""
        if len(self.sizes) > CACHE_WORDS:
            self.sizes.clear()
        if self.n_apart > CACHE_WORDS:
            self.apart.clear()
            self.n_apart = 0
        return (self._walk_unigram if self.v.kind == "unigram" else self._walk_bpe)(sorted(words))

    def _walk_unigram(self, words: list[str]) -> dict[str, bytes]:
        ids, scores, longest, codes = self.v.ids, self.v.scores, self.v.longest, {}
        before, start, best = "", [0], [0.0]  # start[i]: where the last piece of the first i characters starts
        for word in words:
            shared = _shared_prefix(before, word)
            del start[shared + 1 :], best[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                at, value = i - 1, -np.inf
                for j in range(max(0, i - longest), i):
                    k = ids.get(word[j:i])
                    score = best[j] + (scores[k] if k is not None else self.unknown_score if j == i - 1 else -np.inf)
                    if score > value:
                        at, value = j, score
                start.append(at)
                best.append(value)
            cuts, i = [], len(word)
            while i:
                cuts.append(word[start[i] : i])
                i = start[i]
            codes[word] = self._code(reversed(cuts))
            before = word
        return codes

    def _piece_code(self, piece: str) -> bytes:
        """Ids of a piece of a model that spells other characters by their bytes."""
        known = self.bytes_of.get(piece) or self.by_bytes.get(piece)
        if known is None:
            if len(self.by_bytes) > CACHE_WORDS:
                self.by_bytes.clear()
            known = self.by_bytes[piece] = self._code([piece])
        return known

    def _ends(self, tail: str) -> tuple[int, ...]:
        """Sizes of the pieces that may end where these (at most four) characters end; kept for a bounded number of tails."""
        short = [n for n in range(len(tail), 1, -1) if tail[-n:] in self.usable]
        out = self.sizes[tail] = (*self.long.get(tail, ()), *short, 1)
        return out

    def _walk_bpe(self, words: list[str]) -> dict[str, bytes]:
        ids, scores, usable, sizes, apart, spelt = self.v.ids, self.v.scores, self.usable, self.sizes, self.apart, bool(self.v.byte_ids)
        known_code, codes = self.bytes_of.get, {}
        first: dict[str, bool] = {}  # nothing stands before the first piece
        # last[i]: the last piece of the first i characters; after[i]: what is known to follow it; code[i]: their ids
        before, last, after, code = "", [""], [first], [b""]
        for word in words:
            shared = _shared_prefix(before, word)
            del last[shared + 1 :], after[shared + 1 :], code[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                tail = word[i - 4 : i] if i > 4 else word[:i]
                for size in sizes.get(tail) or self._ends(tail):
                    if size > i:
                        continue
                    piece = word[i - size : i]
                    if size > 4 and piece not in usable:
                        continue
                    ok = after[i - size].get(piece)
                    if ok is None:
                        a = last[i - size]
                        ok = after[i - size][piece] = not a or merge(a + piece, ids, scores) == [a, piece]
                        self.n_apart += 1
                    if ok:
                        break
                else:
                    raise AssertionError(f"no last piece for {word[:i]!r}")
                last.append(piece)
                known = apart.get(piece)
                if known is None:
                    known = apart[piece] = {}
                after.append(known)
                if spelt and len(word) < 1024:  # longer words would hold too many prefixes' ids
                    code.append(code[i - size] + (known_code(piece) or self._piece_code(piece)))
            if len(code) == len(last):
                codes[word] = code[-1]
            else:
                cuts, i = [], len(word)
                while i:
                    cuts.append(last[i])
                    i -= len(last[i])
                codes[word] = self._code(reversed(cuts))
                del last[1:], after[1:], code[1:]
                word = ""
            before = word
        return codes

    def _chunk_codes(self, chunks: list[str]) -> list[bytes]:
        """Codes of distinct chunks, each with a mark in front; those that came before are kept."""
        if len(self.codes) > CACHE_WORDS:  # chunks that came again are worth keeping
            self.codes = {w: self.codes[w] for w in self.again if w in self.codes}
            self.again = set()
        codes = self.codes
        new = [c for c in chunks if c not in codes]
        if len(new) < len(chunks) and len(self.again) < CACHE_WORDS // 2:
            self.again.update(set(chunks).difference(new))
        split = [self.v.words.findall(MARK + c) for c in new]
        words = self.learn(set(chain.from_iterable(split)))
        for c, parts in zip(new, split):
            codes[c] = words[parts[0]] if len(parts) == 1 else b"".join(map(words.__getitem__, parts))
        return list(map(codes.__getitem__, chunks))

    def encode_one_by_one(self, texts: list[str | None]) -> pa.ListArray:
        """Ids of each text, from words found by the expression; null stays null."""
        split = [self.v.words.findall(self.v.mark(t)) if t is not None else None for t in texts]
        words = self.learn(set(chain.from_iterable(x for x in split if x)))
        return _lists([np.frombuffer(b"".join(map(words.__getitem__, x)), np.int32) if x is not None else None for x in split])

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; null stays null.

        Texts with single spaces only fall apart at these; the distinct chunks are coded and their codes taken.
        """
        if not self.v.apart_at_spaces:
            return self.encode_one_by_one(texts.to_pylist())
        odd = pc.fill_null(pc.or_(pc.match_substring_regex(texts, f"^( |$)|  |{MARK}"), pc.equal(texts, "")), True)
        plain = texts.filter(pc.invert(odd))
        split = pc.split_pattern(plain, " ")
        chunks = split.flatten().dictionary_encode()
        each = self._chunk_codes(chunks.dictionary.to_pylist())
        taken = _listed(each).take(chunks.indices)
        at = taken.offsets.to_numpy()[split.offsets.to_numpy()]
        done = pa.ListArray.from_arrays(pa.array(at), taken.values) if len(plain) else pa.array([], pa.list_(pa.int32()))
        if len(plain) == len(texts):
            return done
        rest = self.encode_one_by_one(texts.filter(odd).to_pylist())
        mask = odd.to_numpy(zero_copy_only=False)
        place = np.where(mask, len(plain) + np.cumsum(mask) - 1, np.cumsum(~mask) - 1)
        return pa.concat_arrays([done, rest]).take(pa.array(place))


def _listed(codes: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, codes)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(codes), np.int32)))


def _shared(spark: SparkSession, v: Vocabulary):  # noqa: ANN202
    """A broadcast of the vocabulary (a file's worth: its size is the model's, whatever the data)."""
    return spark.sparkContext.broadcast(v)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", output: str = "tokens") -> DataFrame:
    """All columns of `docs`, and `output`: the ids of `text` as array<int>.

    Null texts have null ids, empty ones none. Repeated rows, other columns and their names don't matter; a column
    named `output` is replaced. Long texts are encoded whole.
    """
    return _coded(docs, vocabulary, text, {output: "array<int>"})


def encode_decode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", output: str = "tokens", back: str = "decoded") -> DataFrame:
    """As `encode`, with the text decoded from the ids again in column `back`, by the same worker in one pass."""
    return _coded(docs, vocabulary, text, {output: "array<int>", back: "string"})


def _coded(docs: DataFrame, vocabulary: Vocabulary, text: str, outs: dict[str, str]) -> DataFrame:
    model = _shared(docs.sparkSession, vocabulary)

    def make():  # noqa: ANN202
        coder = Encoder(model.value)  # goes with its task, so that workers don't keep memory
        decoder = Decoder(model.value) if len(outs) > 1 else None

        def run(texts: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
            for part in _by_chars(texts):
                ids = coder.encode(part)
                yield len(part), [ids, decoder.texts(ids)] if decoder else [ids]

        return run

    return map_column(docs, text, "string", make, outs)


class Decoder:
    """Ids to text."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        raw = vocabulary.bytes_of()
        self.n, self.raw, self.silent = len(raw), raw, np.array(sorted(vocabulary.control))
        # the space of the mark in front goes: a first piece is looked up among those without it
        self.pieces = pa.array(raw + [x.removeprefix(b" ") for x in raw] if vocabulary.dummy_prefix else raw, pa.binary())
        self.first = vocabulary.dummy_prefix

    def texts(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list; null for null; ids outside the vocabulary raise."""
        ends = ids.offsets.to_numpy()
        flat = ids.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64)
        if len(flat) and (flat.min() < 0 or flat.max() >= self.n):
            raise ValueError("token id outside the vocabulary")
        if self.first:
            heads = (ends[:-1] - ends[0])[ends[1:] > ends[:-1]]
            if np.isin(flat[heads], self.silent).any():  # what stands first is found piece by piece
                return pa.array([None if x is None else b"".join(self.raw[i] for i in x).removeprefix(b" ").decode("utf-8", "replace") for x in ids.to_pylist()], pa.string())
            flat[heads] += self.n
        raw = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends - ends[0]), self.pieces.take(pa.array(flat))), b"")
        if ids.null_count:
            raw = pc.if_else(ids.is_valid(), raw, pa.scalar(None, pa.binary()))
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:  # not all of it is UTF-8
            return pa.array([x if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def _by_chars(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of an array with a bounded amount of text each (or one text)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")))
        yield texts.slice(at, to - at)
        at = to


def _lists(ids: list[np.ndarray | None]) -> pa.Array:
    flat = np.concatenate([x for x in ids if x is not None] or [np.empty(0, np.int32)])
    ends = np.cumsum([0, *(len(x) if x is not None else 0 for x in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([x is None for x in ids]))


def decode(rows: DataFrame, vocabulary: Vocabulary, tokens: str = "tokens", output: str = "decoded") -> DataFrame:
    """All columns of `rows`, and `output`: the text of `tokens`.

    Encoding and decoding give a text back exactly, except that U+2581 in it comes back as a space. Null ids give
    null; ids outside the vocabulary raise; bytes that are no UTF-8 become U+FFFD. A column named `output` is replaced.
    """
    model = _shared(rows.sparkSession, vocabulary)

    def make():  # noqa: ANN202
        decoder = Decoder(model.value)

        def run(ids: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
            for at in range(0, len(ids), 256):
                part = ids.slice(at, 256)
                yield len(part), [decoder.texts(part)]

        return run

    return map_column(rows, tokens, "array<int>", make, {output: "string"})
