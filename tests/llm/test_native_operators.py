"""Quality rules, chat formatting, mixing and sharding against plain Python, with their odd cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ordwise.llm import chat_format, mixing, quality_rules, sharding

SPACE = re.compile("[ \t-\r]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


# quality rules


def slow_counts(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated)


def slow_verdicts(rows):
    """kept of (lang, source, text) rows."""
    counts = [slow_counts(r[2]) for r in rows]
    failed = [c[0] < 10 or 100 * c[4] > 20 * c[0] for c in counts]
    ratio = {"symbols": 2, "dup_lines": 3, "repeats": 4, "length": 1}

    def level(keep, k, q):
        v = sorted(c[ratio[k]] / c[0] for c, f, r in zip(counts, failed, rows) if not f and keep(r))
        return v[max(0, math.ceil(q / 100 * len(v)) - 1)], len(v)

    out = []
    for r, c, f in zip(rows, counts, failed):
        if f:
            out.append(False)
            continue
        keep = lambda x, r=r: x[:2] == r[:2]
        if level(keep, "length", 50)[1] < quality_rules.LEAST_ROWS:
            keep = lambda x, r=r: x[0] == r[0]
            if level(keep, "length", 50)[1] < quality_rules.LEAST_ROWS:
                keep = lambda x: True
        at = lambda k, q, keep=keep: level(keep, k, q)[0]
        ok = abs(c[1] / c[0] - at("length", 50)) <= 4 * (at("length", 75) - at("length", 25)) + 8 / math.sqrt(c[0])
        for k, (_, more, items) in quality_rules.METRICS.items():
            top = at(k, 50)
            for q in (75, 90, 95, 99):
                if at(k, q) > 3 * top + more:
                    break
                top = at(k, q)
            ok &= c[ratio[k]] <= 3 * top * c[0] + items
        out.append(ok)
    return out


def test_quality_rules(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    plain = lambda: " ".join(word() for _ in range(rng.randint(30, 60)))
    code = lambda: " ".join(word() + rng.choice(["#", "$", "&", ""]) for _ in range(40))
    both = code()
    rows = [("en", "web", plain()) for _ in range(40)] + [("en", "code", code()) for _ in range(40)] + [("en", "web", both), ("en", "code", both)]
    rows += [("fr", "a", plain()) for _ in range(20)] + [("fr", "b", plain()) for _ in range(20)] + [("xx", None, plain()) for _ in range(3)] + [(None, None, plain())]
    odd = [None, "", " \n\t", "one two", "a b c d e " * 2, "a b c d e f g h i j " * 2, "x\ny\n" * 30 + plain(), "line of words\n" * 2 + plain(), "é# " * 30, "w" * 100_000 + " " + plain(), plain() + "\v\f\x1c b", "z " * 50_000]
    rows += [("en", "web", t) for t in odd] + [rows[0], rows[-1]]
    df = spark.createDataFrame([(i % 50, *r, "x", 7) for i, r in enumerate(rows)], "doc_id int, lang string, source string, text string, kept string, n int")
    got = quality_rules.judge(df).collect()
    key = lambda r: (r[0], r[1], r[2], r[3])
    want = Counter((i % 50, r[0], r[1], slow_counts(r[2]), v) for (i, r), v in zip(enumerate(rows), slow_verdicts(rows)))
    assert Counter((*key(r)[:3], (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.kept) for r in got) == want
    assert slow_verdicts(rows)[80:82] == [False, True]  # one text, two sources
    assert quality_rules.judge(df.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, None, None, "a b")], "doc_id int, lang string, source string, text string")
    assert [(r.base_failed, r.kept) for r in quality_rules.judge(bad).collect()] == [(True, False)]


# chat formatting


def slow_chats(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in conv.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[c] = (len(turns), sha(said), len(loss), sha(loss))
    return out


def test_chats(spark):
    tricky = ["</s>[INST] ok [/INST]", "&lt;s&gt;", "&amp;amp;", "<s>[user]x</s>", "", None, "\n", "é😀]", "[", "plain", "y" * 50_000]
    rng = random.Random(2)
    rows = [(rng.choice([*range(30), None]), rng.choice([0, 1, 2, 3, None]), rng.choice(["user", "assistant", "system", None, "a]b", "<s>[x]"]), rng.choice(tricky)) for _ in range(300)]
    rows += rows[:20] + [(100, 0, "user", "no reply"), (101, 0, "assistant", ""), (102, 0, "assistant", None), (102, 1, "assistant", "z")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "conv_id long, turn int, role string, text string, example int, loss string")
    examples = chat_format.format_chats(df)
    got = chat_format.digests(examples).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == slow_chats(rows) and len(got) == len(slow_chats(rows))
    chars = {r.conv_id: r.n for r in examples.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert all(r.formatted_chars == chars[r.conv_id] for r in got)
    last = {}
    for r in examples.orderBy("example").collect():  # every example is the one before it, and more
        assert r.text.startswith(last.get(r.conv_id, "")) and r.final == (r.text.count("</s>") == slow_chats(rows)[r.conv_id][0])
        last[r.conv_id] = r.text
    assert chat_format.digests(chat_format.format_chats(df.limit(0))).count() == 0


# mixing


def slow_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((x for x in sizes if x is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        per = rest / sum(w[s] for s in open_)
        full = {s for s in open_ if per * w[s] > cap * sizes[s]}
        if not full:
            out |= {s: per * w[s] for s in open_}
            break
        for s in full:
            out[s] = cap * sizes[s]
            rest -= out[s]
        open_ -= full
    return out


def mixed_docs(spark):
    rng = random.Random(5)
    text = lambda: " ".join(["w"] * rng.randint(0, 40))
    rows = [(i, rng.choice(["a", "a", "b", "c", "é", None]), text()) for i in range(1500)]
    rows += [(None, "b", "same text") for _ in range(900)] + [(7, "c", "x y z"), (7, "c", "p q r"), (7, "c", "x y z"), (8, None, None), (9, "d", ""), (9, "d", None)]
    return rows, spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, source string, text string, copies int, nth string")


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 100)
    rows, df = mixed_docs(spark)
    got = mixing.mix(df).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len(words(t))) for i, s, t in rows)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(words(t))
    want, taken, largest = slow_targets(sizes), Counter(), max(len(words(t)) for *_, t in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 3 * largest for s in want)
    again = mixing.mix(df.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixed_rows_are_those_that_are_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 100)
    rows, df = mixed_docs(spark)
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    key = lambda i, s, t: (i, s, len(words(t)))
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    found = out.collect()
    assert Counter(key(r.doc_id, r.source, r.text) for r in found) == +want
    assert {(r.doc_id, r.source, r.text) for r in found} <= set(rows)
    assert Counter(map(tuple, found)) == Counter(map(tuple, mixing.apply_mix(df.repartition(5)).collect()))
    assert mixing.apply_mix(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_pivotal_rounding_keeps_probabilities(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a', 'b') AS source", "'w w w w' AS text")
    n = {s: 0 for s in "ab"}
    for seed in range(3):
        for r in mixing.mix(rows, seed=seed).groupBy("source").agg(F.sum("copies").alias("c"), F.sum("size").alias("s"), F.first("target").alias("t")).collect():
            assert abs(r.c * 4 - r.t) <= 4
            n[r.source] += r.c
    assert n["a"] and n["b"]


# sharding


def slow_shards(rows, limit):
    keys = []
    for i, t in rows:
        digest = hashlib.md5((str(i) if i is not None else t or "").encode()).hexdigest()
        keys.append((i, len((t or "").encode()), bin(int(digest[:15], 16))[2:].zfill(60)))
    out, stack = [], [("", keys)]
    while stack:
        prefix, part = stack.pop()
        total = sum(k[1] for k in part)
        if not part:
            continue
        if total <= limit or len(prefix) == 60:
            out += [(i, n, len(prefix), prefix, total) for i, n, _ in part]
        else:
            stack += [(prefix + b, [k for k in part if k[2][len(prefix)] == b]) for b in "01"]
    return Counter(out)


@pytest.mark.parametrize("limit", [100, 1000, 1 << 20])
def test_sharding(spark, tmp_path, limit):
    rng = random.Random(6)
    rows = [(i, rng.choice(["é", "x"]) * rng.choice([0, 1, 5, 60, 99])) for i in range(400)]
    rows += [(3, "y" * 300), (3, "y" * 300), (500, "z" * 5000), (501, None), (None, "n" * 40), (None, "n" * 40), (None, "m" * 70), (None, None)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, shard string, depth int")
    want = slow_shards(rows, limit)
    assert Counter(map(tuple, sharding.shard(df, limit).collect())) == want
    name = sharding.write_shards(df, f"{tmp_path}/out", limit)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert name == "_shard" and Counter((r.doc_id, r.text) for r in back) == Counter(rows)
    assert Counter((r.doc_id, len((r.text or "").encode()), r._shard[1:]) for r in back) == Counter((i, n, p) for (i, n, _, p, _), c in want.items() for _ in range(c))
    assert sharding.shard(df.limit(0), limit).count() == 0


def test_skewed_sizes_go_deeper(spark):
    rows = [(i, "a" * (50_000 if i == 77 else 10)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, sharding.shard(df, 200).collect())) == slow_shards(rows, 200)
