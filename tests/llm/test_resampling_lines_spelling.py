"""Importance resampling, line dedup and spelling variants against brute force, and their hard cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import line_dedup, resampling, spelling

D = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, n_features string, kept int, word string, row double, gone string"
HARD = [None, "", " \n\t\n", "one two", "É 中 😀 ×÷ \x00 x", "word " * 30_000, "A" * 20_000 + "\n" + "b c " * 9_000, "x\n" * 5_000]


def rows_of(spark, texts, schema=CLASH):
    return spark.createDataFrame([(i, t, "n", 1, "w", 1.0, "g") for i, t in texts], schema)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# ---------------------------------------------------------------- resampling


def brute_resample(docs, target, least=20, percent=25, seed=7):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = Counter(), Counter()
    for texts, c in (([x for _, x in docs], s), (target, t)):
        for x in texts:
            c.update(features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = {id(r): k for k, r in enumerate(able[: len(able) * percent // 100], 1)}
    return sorted((*map(str, r[:4]), str(drawn.get(id(r)))) for r in out)


def test_resampling_matches_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["É", "中文", "a1"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(200)] + [(1000 + i, t) for i, t in enumerate(HARD)] + [(None, "lone " * 25)]
    docs += [(5000, "same same text of words " * 8)]
    target = [" ".join(rng.choices(words[:40], k=50)) for _ in range(20)] + [None, ""]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(rows_of(spark, docs), goal).collect()
    assert sorted(tuple(map(str, r)) for r in got) == brute_resample(docs, target)


def test_resampling_of_repeats_ties_and_nothing(spark):
    goal = spark.createDataFrame([("a b c",)], "text string")
    same = rows_of(spark, [(7, "the same words again and again " * 5)] * 8 + [(None, "the same words again and again " * 5)] * 4)
    ranks = sorted(r.rank for r in resampling.resample(same, goal).collect() if r.rank)
    assert ranks == [1, 2, 3]
    got = resampling.resample(same, goal, percent=100).collect()
    assert sorted(r.rank for r in got) == list(range(1, 13)) and len({(r.doc_id, r.score) for r in got}) == 2
    assert resampling.resample(same.limit(0), goal).count() == 0
    assert resampling.resample(same, goal.limit(0)).where("rank is not null").count() == 3
    assert [r.rank for r in resampling.resample(rows_of(spark, [(1, "few words")]), goal).collect()] == [None]


def test_ranks_over_many_partitions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k % 97).cast("string")) for k in range(1, 31)]).alias("text"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        got = resampling.resample(docs, docs.limit(50)).where("rank is not null").orderBy("rank").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [r["rank"] for r in got] == list(range(1, 751))
    assert all((a.score, -a.doc_id) > (b.score, -b.doc_id) for a, b in zip(got, got[1:]))


# ---------------------------------------------------------------- line dedup


def brute_lines(docs, chars=40, least=5):
    holders = defaultdict(set)
    key = lambda line: low(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(i)
    keep = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= least}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in keep or keep[key(x)] == i]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(map(str, out))


@pytest.mark.parametrize("bits", [29, 15])
def test_line_dedup_matches_brute_force(spark, bits, monkeypatch):
    monkeypatch.setattr(line_dedup, "HELD", 50)
    monkeypatch.setattr(line_dedup, "LINE_BITS", 1 if bits == 15 else 16)
    rng = random.Random(2)
    pool = [f"line number {i} that stands in several of the documents" for i in range(40)] + ["é" * 40, "é" * 39, "中" * 40, " \t" + "Q" * 40 + "\x0b ", "q" * 40, "short", ""]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 12)) + [f"a line of its own, of document {i} and of no other one"])) for i in range(120)]
    docs += [(500 + i, t) for i, t in enumerate(HARD)] + [(None, pool[0]), (None, pool[1] + "\n" + pool[1]), (3, pool[2]), (700, (pool[3] + "\n") * 4000), (900, pool[0] + "\r\n" + pool[1].upper())]
    got = line_dedup.line_dedup(rows_of(spark, docs).repartition(6), filter_bits=bits).collect()
    assert sorted(str((r.doc_id, r.kept, r.n_lines, r.n_dropped)) for r in got) == brute_lines(docs)


def test_line_dedup_of_repeats_and_nothing(spark):
    line = "a passage that every one of these documents has in common"
    docs = [(7, line)] * 300 + [(i, line + "\nown") for i in range(4)] + [(7, line)] * 9
    got = line_dedup.line_dedup(rows_of(spark, docs)).collect()
    assert Counter((r.doc_id == 7, r.kept, r.n_dropped) for r in got) == {(True, line, 0): 309, (False, "own", 1): 4}
    few = line_dedup.line_dedup(rows_of(spark, docs[:303])).collect()  # one document of 300 equal rows, three more
    assert {r.n_dropped for r in few} == {0}
    assert line_dedup.line_dedup(rows_of(spark, docs).limit(0)).count() == 0


def test_filter_holds_every_repeated_key_and_few_others(spark):
    docs = spark.createDataFrame([(f"a line that only document {i} has, long enough to count\nline shared by two documents, number {i // 2} of them all",) for i in range(2000)], "text string").repartition(5)
    bits = 16
    packed = line_dedup.repeated_filter(docs, 40, bits)

    def inside(key):
        b = line_dedup.bits_of(np.frombuffer(hashlib.blake2b(key, digest_size=16).digest(), np.uint64), bits)
        return all(packed[int(x) % 64, int(x) // 64 >> 3] >> (int(x) // 64 & 7) & 1 for x in b)

    assert all(inside(f"line shared by two documents, number {k} of them all".encode()) for k in range(1000))
    assert sum(inside(f"a line that only document {i} has, long enough to count".encode()) for i in range(2000)) < 200


# ---------------------------------------------------------------- spelling


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_spelling(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", low(t)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(map(str, ((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)))


def spelled(rng, size):
    base = ["spelling", "variant", "grouping", "straße", "übermäßig", "aaaaaab", "aaaaab", "banana", "bananna", "ÀÉÎõüÿ"] + ["".join(rng.choices("abcd", k=rng.randint(6, 9))) for _ in range(60)]
    out = []
    for _ in range(size):
        w = rng.choice(base)
        if rng.random() < 0.25:
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abzé") + w[k:], w[:k] + rng.choice("abzé") + w[k + 1 :]])
        out.append(w if rng.random() < 0.8 else w.upper())
    return out


@pytest.mark.parametrize("states,shard,round_bytes", [(1 << 19, 1 << 16, 64 << 20), (40, 25, 3000)])
def test_spelling_matches_brute_force(spark, monkeypatch, states, shard, round_bytes):
    monkeypatch.setattr(spelling, "STATES", states)
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    monkeypatch.setattr(spelling.near_words, "__defaults__", (round_bytes,))
    rng = random.Random(9)
    docs = [(i, "\n".join(spelled(rng, 120))) for i in range(80)] + [(900 + i, t) for i, t in enumerate(HARD)] + [(None, "nullid " * 7 + "nullidx " * 40)] + [(i, "repeated " * 4) for i in (1, 1, 1)]
    got = spelling.spelling_variants(rows_of(spark, docs)).collect()
    assert sorted(map(str, map(tuple, got))) == brute_spelling(docs)


def test_trie_pairs_are_whole_and_single():
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 7))) for _ in range(150)})
    trie = spelling.Trie([w.encode("latin-1") for w in words], np.ones(len(words)))
    m, lengths = spelling.matrix([w.encode("latin-1") for w in words])
    pairs = [(int(a), int(b)) for q, w in trie.neighbours(m, lengths) for a, b in zip(q, w)]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(i, k) for i, a in enumerate(words) for k, b in enumerate(words) if one_apart(a, b)}


def test_spelling_of_very_long_words_and_nothing(spark):
    long = "q" * 3000
    docs = [(i, f"{long}x {long} {long}") for i in range(9)] + [(50, "few words only")]
    got = {r.word: r for r in spelling.spelling_variants(rows_of(spark, docs)).collect()}
    assert sorted(map(str, map(tuple, got.values()))) == brute_spelling(docs)
    assert spelling.spelling_variants(rows_of(spark, docs).limit(0)).count() == 0
    assert spelling.spelling_variants(rows_of(spark, docs[-1:])).count() == 0


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("x", "w5")]
    got = {r.word: r.root for r in spelling._roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert set(got.values()) == {"w13"} and len(got) == 14
