"""Masked pseudo-likelihood scores from a bidirectional window network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, hashed_words, slots_of, small_batches, staged, text_blocks, tidy, unstage, utf8_texts

#: Most words with a count of their own (24 MB in a worker); words seen once, or less often than this allows, are the unknown token.
VOCABULARY = 1 << 21
#: The most frequent words are numbered; of them OWN are classes by themselves, the others fall into CLUSTERS classes, all other words into one.
NUMBERED, OWN, CLUSTERS = 1 << 15, 96, 95
CLASSES = OWN + CLUSTERS + 1
#: Words with an input row of their own; frequent words beside which others are counted to build the clusters, and passes of that.
INPUT, ANCHORS, CLUSTER_STEPS = 1024, 32, 12
#: Tokens seen on each side, embedding and hidden sizes.
SIDE, DIM, HIDDEN = 2, 8, 24
#: Training: rounds, tokens of a shard on average, minibatches of so many tokens, first rate.
ROUNDS, SHARD, BATCH, RATE = 4, 1 << 20, 1024, 0.05
#: Input rows: own words, clusters, other words, and the place beyond a text's ends.
ROWS = INPUT + CLUSTERS + 2
_SHAPES = {"emb": (ROWS, DIM), "w1": (2 * SIDE * DIM, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, CLASSES), "b2": (CLASSES,)}
_SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


# ---------------------------------------------------------------- vocabulary


@dataclass
class Vocabulary:
    """Sorted word hashes with the logs of their counts and their numbers (1 to NUMBERED - 1 by falling count, 0 for others); an unknown word counts ``unknown``, the unknown words' mean."""

    hashes: np.ndarray
    logs: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray  # of the numbered words; place 0 holds all others
    unknown: float

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, logs of counts) of hashed words."""
        distinct, of = np.unique(words, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        number = np.where(known, self.numbers[at], 0) if len(self.hashes) else np.zeros(len(distinct), np.uint16)
        log = np.where(known, self.logs[at], np.float32(np.log(self.unknown))) if len(self.hashes) else np.full(len(distinct), np.log(self.unknown), np.float32)
        return number[of].astype(np.uint16), log[of]


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each hashed word (between white space, A-Z as a-z) occurs in all texts. Tasks send each word once per million they hold, sums do the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h = np.concatenate([x for x, _ in held])
            c = np.concatenate([x for _, x in held])
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            return h[first], np.add.reduceat(c, first)

        def out(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        for b in batches:
            texts = utf8_texts(b.column(0))
            for i, j in text_blocks(texts):
                words = hashed_words(texts[i:j])[0]
                if len(words):
                    held.append(np.unique(words, return_counts=True))
                    size += len(held[-1][0])
                if size > 1 << 20:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1 << 19:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*merged())

    return docs.select("text").mapInArrow(tidy(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def vocabulary(docs: DataFrame, most: int = VOCABULARY) -> Vocabulary:
    """Words seen at least m times, m being 2 or the least number that leaves ``most`` words or fewer; all words are counted."""
    counted = staged(word_counts(docs), "words")
    by_count = sorted(((r[0], r[1]) for r in counted.groupBy("c").count().collect()), reverse=True)  # as many rows as different counts
    least, kept = 2, 0
    for c, n in by_count:
        if c < 2 or kept + n > most:
            least = max(2, c + 1)
            break
        kept += n
    tokens, types = sum(c * n for c, n in by_count), sum(n for _, n in by_count)

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).astype("<i8").tobytes()]) for c in b.columns], ["h", "c"])

    parts = counted.where(F.col("c") >= least).mapInArrow(blobs, "h binary, c binary").collect()
    h = np.frombuffer(b"".join(r[0] for r in parts), "<i8").view(np.uint64)
    c = np.frombuffer(b"".join(r[1] for r in parts), "<i8")
    unstage(counted)
    order = np.argsort(h)
    h, c = h[order], c[order]
    top = np.lexsort((h, -c))[: NUMBERED - 1]
    numbers, counts = np.zeros(len(h), np.uint16), np.zeros(NUMBERED)
    numbers[top] = np.arange(1, len(top) + 1)
    counts[1 : len(top) + 1] = c[top]
    counts[0] = tokens - counts.sum()
    unknown = (tokens - c.sum()) / max(1, types - len(h)) or 1.0
    return Vocabulary(h, np.log(c).astype(np.float32), numbers, counts, float(unknown))


# ---------------------------------------------------------------- tokens, neighbours, classes


def numbered(docs: DataFrame, known) -> DataFrame:
    """(row columns..., n, base, ids): each text's tokens as 16-bit numbers, and the sum of the logs of their counts."""
    keep = [x for x in docs.columns if x != "text"]
    place = docs.columns.index("text")
    added = {"n": pa.int64(), "base": pa.float64(), "ids": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8_texts(b.column(place))
            n, base, ids = np.zeros(len(texts), np.int64), np.zeros(len(texts)), [b""] * len(texts)
            for i, j in text_blocks(texts):
                words, at = hashed_words(texts[i:j])
                if not len(words):
                    continue
                number, log = known.value.look_up(words)
                total = np.concatenate([[0.0], np.cumsum(log, dtype=np.float64)])
                n[i:j], base[i:j] = np.diff(at), np.diff(total[at])
                for k in range(i, j):
                    ids[k] = number[at[k - i] : at[k - i + 1]].astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in keep), pa.array(n), pa.array(base), pa.array(ids, pa.binary())], [*keep, *added])

    from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

    kinds = (LongType(), DoubleType(), BinaryType())
    return docs.mapInArrow(tidy(run), StructType([*(docs.schema[x] for x in keep), *(StructField(x, k) for x, k in zip(added, kinds, strict=True))]))


def _batch_ids(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all tokens, where each text's begin)."""
    at = np.concatenate([[0], np.cumsum([len(x) // 2 for x in blobs], dtype=np.int64)])
    return np.frombuffer(b"".join(blobs), "<u2").astype(np.int64), at


def _some(blobs: list[bytes], limit: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``limit`` tokens (a longer text is one of its own)."""
    return text_blocks(blobs, 2 * limit)


def neighbours(tokens: DataFrame) -> np.ndarray:
    """(NUMBERED, ANCHORS): how often each numbered word stands within SIDE tokens of each of the most frequent words, over all texts (4 MB)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(NUMBERED * ANCHORS, np.int32)
        for b in batches:
            blobs = b.column(0).to_pylist()
            for i, j in _some(blobs):
                ids, at = _batch_ids(blobs[i:j])
                doc = np.repeat(np.arange(j - i), np.diff(at))
                for d in range(1, SIDE + 1):
                    for x, y in ((ids[:-d], ids[d:]), (ids[d:], ids[:-d])):
                        near = (y > 0) & (y <= ANCHORS) & (doc[:-d] == doc[d:])
                        got += np.bincount(x[near] * ANCHORS + y[near] - 1, minlength=len(got)).astype(np.int32)
        yield slots_of(got)

    out = fold(tokens.select("ids").mapInArrow(tidy(run), "slot int, blob binary"), "<i4", "add", wide="<i8")
    return (out if len(out) == NUMBERED * ANCHORS else np.zeros(NUMBERED * ANCHORS)).reshape(NUMBERED, ANCHORS)


def clusters(near: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Class of each numbered word: frequent words have their own, others that of the cluster whose words have like neighbours (k-means on square roots of shares, begun at the most frequent words)."""
    out = np.zeros(NUMBERED, np.int64)
    out[0] = CLASSES - 1
    out[1 : OWN + 1] = np.arange(OWN)
    rest = np.arange(OWN + 1, NUMBERED)
    rest = rest[counts[rest] > 0]
    if not len(rest):
        return out
    share = (near[rest] + 0.5 * near.sum(axis=0) / max(1.0, near.sum())) / (near[rest].sum(axis=1, keepdims=True) + 0.5)
    x = np.sqrt(share)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centre = x[:CLUSTERS].copy()
    for _ in range(CLUSTER_STEPS):
        of = np.argmax(x @ centre.T, axis=1)
        sums = np.stack([np.bincount(of, x[:, k] * counts[rest], len(centre)) for k in range(ANCHORS)], axis=1)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centre)
    out[rest] = OWN + of
    return out


class Net:
    """P(token | both sides) = P(class | window network) * count(token) / count(class), over the counts of the whole corpus."""

    def __init__(self, classes: np.ndarray, counts: np.ndarray, flat: np.ndarray | None = None):
        self.klass = classes
        self.mass = np.bincount(classes, counts, CLASSES)
        self.row = np.where(np.arange(NUMBERED) <= INPUT, np.arange(NUMBERED) - 1, INPUT + classes - OWN)
        self.row[0] = ROWS - 2
        if flat is None:
            rng = np.random.default_rng(11)
            flat = np.concatenate([(rng.standard_normal(s) * (0.1 if len(s) > 1 else 0)).ravel() for s in _SHAPES.values()])
            flat[-CLASSES:] = np.log((self.mass + 0.25) / (self.mass + 0.25).sum())
        self.flat, at = flat.astype(np.float32), 0
        for name, shape in _SHAPES.items():
            setattr(self, name, self.flat[at : at + int(np.prod(shape))].reshape(shape))
            at += int(np.prod(shape))

    def windows(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Input rows of the tokens on both sides of each token; the last row stands beyond a text's ends."""
        n = len(ids)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        rows = self.row[ids]
        out = np.full((n, 2 * SIDE), ROWS - 1, np.int32)
        for k, d in enumerate([x for x in range(-SIDE, SIDE + 1) if x]):
            a, b = (slice(-d, n), slice(0, n + d)) if d < 0 else (slice(0, n - d), slice(d, n))
            if n > abs(d):
                out[a, k] = np.where(doc[a] == doc[b], rows[b], ROWS - 1)
        return out

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.emb[windows].reshape(len(windows), -1)
        h = np.tanh(x @ self.w1 + self.b1)
        return x, h, h @ self.w2 + self.b2  # logits stay small: tanh and a few steps bound them

    def class_log_probs(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log P(class of each token | both sides)."""
        out, w, t = np.empty(len(ids), np.float32), self.windows(ids, at), self.klass[ids]
        for lo in range(0, len(ids), 4096):
            z = self.forward(w[lo : lo + 4096])[2]
            z -= z.max(axis=1, keepdims=True)
            own = z[np.arange(len(z)), t[lo : lo + 4096]]
            out[lo : lo + 4096] = own - np.log(np.exp(z, out=z).sum(axis=1))
        return out

    def learn(self, ids: np.ndarray, at: np.ndarray, seen: dict) -> None:
        """One pass of Adagrad over minibatches of consecutive tokens."""
        windows, target = self.windows(ids, at), self.klass[ids]
        for lo in range(0, len(ids), BATCH):
            w, t = windows[lo : lo + BATCH], target[lo : lo + BATCH]
            n = len(t)
            x, h, p = self.forward(w)
            p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            p *= (1 / (n * p.sum(axis=1, keepdims=True))).astype(np.float32)
            p[np.arange(n), t] -= np.float32(1 / n)
            dh = (p @ self.w2.T) * (1 - h * h)
            dx = (dh @ self.w1.T).reshape(-1, DIM)
            places = (w.ravel()[:, None] * DIM + np.arange(DIM)).ravel()
            emb = np.bincount(places, dx.ravel(), ROWS * DIM).reshape(ROWS, DIM)
            for name, g in (("emb", emb), ("w1", x.T @ dh), ("b1", dh.sum(0)), ("w2", h.T @ p), ("b2", p.sum(0))):
                g = g.astype(np.float32)
                s = seen.setdefault(name, np.full(_SHAPES[name], 1e-6, np.float32))
                s += g * g
                getattr(self, name)[...] -= np.float32(RATE) * g / np.sqrt(s)


def train(tokens: DataFrame, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rounds of local training, one net per shard, averaged by the tokens of each.

    A hash of id and content deals every text to one shard of one round, and a shard's texts are taken in the order of that hash: so
    results depend on the rows alone, not on how they lie in files and partitions. A task streams its shards, whatever their size.
    """
    spark = tokens.sparkSession
    total = int(counts.sum())
    shards = max(1, -(-total // (ROUNDS * SHARD)))
    deal = F.xxhash64(F.col("doc_id").cast("string"), "n", "base")
    dealt = tokens.where("n > 0").select("ids", deal.alias("deal"))
    dealt = dealt.select("ids", "deal", F.pmod("deal", F.lit(ROUNDS)).cast("int").alias("round"), F.pmod(F.shiftright("deal", 8), F.lit(shards)).cast("int").alias("shard"))
    flat = Net(classes, counts).flat
    per = -(-(_SIZE + 1) // 64)
    known = spark.sparkContext.broadcast((classes, counts))
    for k in range(ROUNDS):
        start = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net, seen, n, now = None, {}, 0, None
            total = np.zeros(per * 64)
            for b in batches:
                blobs, shard = b.column(0).to_pylist(), np.asarray(b.column(1))
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if hi > lo and shard[lo] != now:
                        if n:
                            total[:_SIZE] += net.flat.astype(float) * n
                            total[_SIZE] += n
                        net, seen, n, now = Net(*known.value, start.value.copy()), {}, 0, shard[lo]  # noqa: B023
                    for i, j in _some(blobs[lo:hi]):
                        ids, at = _batch_ids(blobs[lo + i : lo + j])
                        net.learn(ids, at, seen)
                        n += len(ids)
            if n:
                total[:_SIZE] += net.flat.astype(float) * n
                total[_SIZE] += n
            yield slots_of(total, "<f8")

        some = dealt.where(F.col("round") == k).repartition(min(shards, 4096), "shard").sortWithinPartitions("shard", "deal").select("ids", "shard")
        got = fold(some.mapInArrow(tidy(run), "slot int, blob binary"), "<f8", "add")
        if len(got) == per * 64 and got[_SIZE]:
            flat = (got[:_SIZE] / got[_SIZE]).astype(np.float32)
    return flat


def lm_score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's (doc_id, n_tokens, pll, pll_per_token): the sum and mean of log P(token | both sides) over all tokens of the whole text.

    Words are counted in all texts; those seen twice or more are tokens of the vocabulary, the rest is the unknown token, whose words
    share its probability evenly. The network is trained on every text, and doesn't depend on the table's layout. Null, empty and blank
    texts have 0 tokens, pll 0 and a null mean; repeated rows each count; no rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    words = vocabulary(rows)
    known = spark.sparkContext.broadcast(words)
    tokens = staged(numbered(rows, known), "tokens")
    known.unpersist()
    classes = clusters(neighbours(tokens), words.counts)
    model = spark.sparkContext.broadcast((classes, words.counts, train(tokens, classes, words.counts)))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(*model.value)
        log_mass = np.log(np.maximum(net.mass, 1.0)).astype(np.float32)
        for b in batches:
            blobs = b.column(3).to_pylist()
            n, sums = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).copy()
            for i, j in _some(blobs):
                ids, at = _batch_ids(blobs[i:j])
                if len(ids):
                    part = net.class_log_probs(ids, at) - log_mass[net.klass[ids]]
                    sums[i:j] += np.diff(np.concatenate([[0.0], np.cumsum(part, dtype=np.float64)])[at])
            mean = [float(s / c) if c else None for s, c in zip(sums, n, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums), pa.array(mean, pa.float64())], ["doc_id", "n_tokens", "pll", "pll_per_token"])

    return tokens.select("doc_id", "n", "base", "ids").mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, pll double, pll_per_token double")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op8_lm_score": op8_lm_score}
