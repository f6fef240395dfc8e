"""Spelling variants: words one edit apart, found by Levenshtein automata over broadcast trie shards."""

from __future__ import annotations

import pickle
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, staged, tidy, unstage
from .resampling import CRC_TABLE, crc_sql

# Fixed value: what parts the runs of letters.
BETWEEN = r"[^A-Za-zÀ-ÿ]+"
#: Production values: a slip in one of so many runs (by hash); a word's code points and occurrences; how much more frequent a form is.
SLIP, LEAST_CHARS, LEAST_COUNT, TIMES = 199, 6, 5, 5
#: Words of a trie shard and cells of the matrix it is built from; bytes of the shards that are broadcast at a time.
SHARD_WORDS, SHARD_CELLS, ROUND_BYTES = 1 << 16, 1 << 22, 64 << 20
#: Words matched together (and cells of their matrix), and states of their automata that are carried on at a time.
BLOCK_WORDS, BLOCK_CELLS, STATES = 4096, 1 << 20, 1 << 19


def counted_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case, after the slips that the contract plants by a hash of id and run."""
    run, at = F.col("run"), F.col("h") % F.length("run")
    low = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.split(low, BETWEEN)).alias("run")).where(F.length("run") >= least_chars)
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    slipped = F.concat(F.substr(run, F.lit(1), at.cast("int")), F.substr(run, (at + 2).cast("int")))
    rows = rows.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(run).alias("word")).where(F.length("word") >= least_chars)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of bytes filled up with 0 (one column more than the longest has), and their lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    width = int(lengths.max(initial=0)) + 1
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width), lengths


class Trie:
    """The trie of sorted words in flat arrays; a node's children follow one another in the order of their letters.

    Nodes are numbered level by level: ``label`` is the letter that leads to a node, ``first`` and ``count`` its children, ``word`` the
    number of the word that ends there (from 1). Letters are bytes of Latin-1, whose order is that of the code points.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.words, self.counts = words, np.asarray(counts, np.int64)
        m, lengths = matrix(words)
        same = np.zeros(len(words), np.int64)  # letters shared with the word before
        if len(words) > 1:
            alike = m[1:] == m[:-1]
            same[1:] = np.where(alike.all(axis=1), m.shape[1], alike.argmin(axis=1))
            same[1:] = np.minimum(same[1:], lengths[:-1])
        label, first, count, word = [np.zeros(1, np.uint8)], [], [], [np.zeros(1, np.int64)]
        live, node, base, begin = np.arange(len(words)), np.zeros(len(words), np.int64), 0, 1
        d = 0
        while True:
            on = lengths[live] > d
            live, node = live[on], node[on]
            width = begin - base
            if not len(live):
                first.append(np.zeros(width, np.int64))
                count.append(np.zeros(width, np.int64))
                break
            new = same[live] <= d
            new[0] = True
            heads = live[new]
            kids = np.bincount(node[new] - base, minlength=width)
            first.append(begin + np.cumsum(kids) - kids)
            count.append(kids)
            ids = begin + np.cumsum(new) - 1
            label.append(m[heads, d])
            ends = np.zeros(len(heads), np.int64)
            over = lengths[live] == d + 1
            ends[ids[over] - begin] = live[over] + 1
            word.append(ends)
            node, base, begin, d = ids, begin, begin + len(heads), d + 1
        self.label = np.concatenate(label)
        self.first, self.count = np.concatenate(first).astype(np.int32), np.concatenate(count).astype(np.int32)
        self.word = np.concatenate(word).astype(np.int32)
        self.edges = np.repeat(np.arange(len(self.count), dtype=np.int64), self.count) << 8 | self.label[1:]  # ascending

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child by a letter, 0 (the root, which is nobody's child) where there is none."""
        asked = node.astype(np.int64) << 8 | letter
        at = np.searchsorted(self.edges, asked)
        at[at == len(self.edges)] = 0
        return np.where(self.edges[at] == asked, at + 1, 0) if len(self.edges) else np.zeros(len(node), np.int64)

    def neighbours(self, m: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) pairs at distance one, each once, for queries that are the rows of a matrix.

        A query's automaton holds, at a node of depth d, the exact state (all of the first d letters met) or states after the one edit, which know
        how many letters of the query are used up. Descent is depth-first over a stack of bundles of states; a bundle over STATES is halved. Of equal edits one is made: a letter is
        put in or taken out at the end of a run of it.
        """
        q0 = np.arange(len(m))
        none = np.zeros(0, np.int64)
        stack = [(0, q0, np.zeros(len(m), np.int64), none, none, none)]
        while stack:
            d, q, v, eq, ev, ei = stack.pop()
            if len(q) + len(eq) > STATES and len(both := np.union1d(q, eq)) > 1:
                half = both[len(both) // 2]
                a, b = q < half, eq < half
                stack.append((d, q[~a], v[~a], eq[~b], ev[~b], ei[~b]))
                stack.append((d, q[a], v[a], eq[b], ev[b], ei[b]))
                continue
            # take out the query's letter here
            width = m.shape[1] - 1
            inside = d < lengths[q]
            now, nxt = m[q, min(d, width)], m[q, min(d + 1, width)]
            out = inside & (now != nxt)
            eq, ev, ei = np.concatenate([eq, q[out]]), np.concatenate([ev, v[out]]), np.concatenate([ei, np.full(out.sum(), d + 1)])
            done = ei == lengths[eq]
            ends = self.word[ev[done]]
            if ends.any():
                yield eq[done][ends > 0], ends[ends > 0] - 1
            eq, ev, ei = eq[~done], ev[~done], ei[~done]
            # the edited ones go on by the query's next letter
            to = self.child(ev, m[eq, ei])
            on = to > 0
            eq, ev, ei = eq[on], to[on], ei[on] + 1
            # the exact ones by each child: the same letter, another in its place, or one put in before it
            n = self.count[v]
            at = np.repeat(np.arange(len(q)), n)
            kid = np.repeat(self.first[v] - np.cumsum(n) + n, n) + np.arange(len(at))
            hit = self.label[kid] == now[at]
            other, edited = q[at[~hit]], kid[~hit]
            swap = inside[at[~hit]]
            eq = np.concatenate([eq, other[swap], other])
            ev = np.concatenate([ev, edited[swap], edited])
            ei = np.concatenate([ei, np.full(swap.sum(), d + 1), np.full(len(other), d)])
            if hit.any() or len(eq):
                stack.append((d + 1, q[at[hit]], kid[hit], eq, ev, ei))


def trie_shards(words: DataFrame, n_words: int) -> DataFrame:
    """(id, size, blob): the tries of the words (word, n) in order, each of bounded size; a very long word is a shard of its own."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, longest = [], [], 0

        def out() -> pa.RecordBatch:
            blob = pickle.dumps(Trie(held, np.array(counts)), protocol=5)
            first = held[0].decode("latin-1")
            held.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([first]), pa.array([len(blob)], pa.int64()), pa.array([blob], pa.binary())], ["first", "size", "blob"])

        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                word = w.encode("latin-1")
                if held and (len(held) == SHARD_WORDS or (len(held) + 1) * (1 + max(longest, len(word))) > SHARD_CELLS):
                    yield out()
                    longest = 0
                held.append(word)
                counts.append(n)
                longest = max(longest, len(word))
        if held:
            yield out()

    parts = max(1, -(-n_words // SHARD_WORDS))
    return words.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(tidy(build), "first string, size long, blob binary")


def _matched(words: DataFrame, blobs: list[bytes]) -> DataFrame:
    """(word, n, near, best): how many neighbours the shards hold, and the most frequent one's (n, word), for words that have some."""
    shared = words.sparkSession.sparkContext.broadcast(blobs)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [pickle.loads(x) for x in shared.value]
        for b in batches:
            texts, counts = [w.encode("latin-1") for w in b.column(0).to_pylist()], b.column(1).to_pylist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            at = 0
            while at < len(order):
                end = at + 1
                while end < len(order) and end - at < BLOCK_WORDS and (end - at + 1) * (len(texts[order[end]]) + 1) <= BLOCK_CELLS:
                    end += 1
                some = order[at:end]
                at = end
                m, lengths = matrix([texts[i] for i in some])
                near, best_n, best = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64), [""] * len(some)
                for trie in tries:
                    found = list(trie.neighbours(m, lengths))
                    if not found:
                        continue
                    q, w = (np.concatenate(x) for x in zip(*found, strict=True))
                    near += np.bincount(q, minlength=len(some))
                    by = np.lexsort((w, -trie.counts[w], q))
                    q, w = q[by], w[by]
                    first = np.ones(len(q), bool)
                    first[1:] = q[1:] != q[:-1]
                    q, w = q[first], w[first]
                    more = trie.counts[w] > best_n[q]  # shards are in order: of equal counts the earlier word stays
                    best_n[q[more]] = trie.counts[w[more]]
                    for i, k in zip(q[more].tolist(), w[more].tolist(), strict=True):
                        best[i] = trie.words[k].decode("latin-1")
                has = np.flatnonzero(near).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([texts[some[i]].decode("latin-1") for i in has], pa.string()), pa.array([counts[some[i]] for i in has], pa.int64()),
                        pa.array(near[has]), pa.array(best_n[has]), pa.array([best[i] for i in has], pa.string()),
                    ],
                    ["word", "n", "near", "best_n", "best"],
                )

    return words.mapInArrow(tidy(match), "word string, n long, near long, best_n long, best string")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each step doubles how far a root is followed; counts grow along forms, so chains are short."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = staged(now.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        unstage(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def near_words(words: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n, n_near, best_n, best) for the words (word, n; distinct, letters of Latin-1) that have a neighbour at distance one.

    Trie shards are broadcast in rounds of at most ``round_bytes`` (one shard at least), however many there are: each round is one pass over
    the words. Counts and best neighbours of the rounds are reduced by word. Ties go to the first word in code-point order.
    """
    spark = words.sparkSession
    shards = staged(trie_shards(words, words.count()), "tries")
    sizes = shards.select("first", "size").orderBy("first").collect()  # a row for each 65,536 words
    rounds: list[list[str]] = []
    left = 0
    for r in sizes:
        if r["size"] > left:
            rounds.append([])
            left = round_bytes
        rounds[-1].append(r["first"])
        left -= r["size"]
    out = None
    spread = words.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for some in rounds:
        blobs = [bytes(r.blob) for r in shards.where(F.col("first").between(some[0], some[-1])).orderBy("first").select("blob").collect()]
        got = staged(_matched(spread, blobs), "near")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], "word string, n long, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b")
    out = out.groupBy("word", "n").agg(F.sum("near").alias("n_near"), best)
    return out.select("word", "n", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``least_chars`` code points or more and ``least_count`` occurrences or more.

    Words are near if one inserted, deleted or replaced code point makes one the other. A word's form is its most frequent near word (ties: the first in
    code-point order) if that is at least ``times`` as frequent, else null; its root is where forms lead, itself without one. Null text has
    no runs, a null id counts as the empty one in the hash that plants slips, rows that repeat count again, extra columns are left out, an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    words = staged(counted_words(docs, key, text, least_chars, least_count), "words")
    near = near_words(words)
    fits: Column = F.col("best_n") >= times * F.col("n")
    near = staged(near.select("word", "n_near", F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(near.where("form is not null").select("word", "form"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their forms and roots."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = {
    "op13_spelling_variants": f"""
WITH RECURSIVE r AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents) GROUP BY ALL),
h AS (SELECT run, k, {crc_sql("(doc_id || ':' || run)")} AS h FROM r, {CRC_TABLE} t WHERE length(run) >= {LEAST_CHARS}),
w AS (SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
c AS (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM w, (SELECT unnest(range(1, 1000)) AS i) WHERE i <= length(word)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM c a JOIN c b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM c a JOIN w b ON a.cut = b.word
      UNION SELECT b.word, a.word, a.n FROM c a JOIN w b ON a.cut = b.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS best, max(near_n) AS best_n FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {TIMES} * n THEN best END AS form, CASE WHEN best_n >= {TIMES} * n THEN best_n END AS form_n
      FROM w LEFT JOIN b USING (word)),
s AS (SELECT word, word AS place, 0 AS steps FROM f UNION ALL SELECT s.word, f.form, steps + 1 FROM s JOIN f ON f.word = s.place WHERE f.form IS NOT NULL),
l AS (SELECT word, arg_max(place, steps) AS root FROM s GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN l USING (word)"""
}
QUERIES = {"op13_spelling_variants": op13_spelling_variants}
