"""Mixing sources to target weights with soft domain memberships."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, drawn, hashed_words, small_batches, staged, text_blocks, tidy, unstage, utf8_texts

#: Bounds of the labelled sample that trains the classifier (rows, bytes of text), its hashed features and gradient steps.
TRAIN_ROWS, TRAIN_BYTES, FEATURES, TRAIN_STEPS = 4000, 32 << 20, 1 << 18, 60
#: A feature counts if so many labelled rows have it; its significance (the largest z-score of its share in a domain against the others) scales it, up to this.
LEAST_ROWS, MOST_Z = 5, 20
#: A domain's share may miss its target by so much. The weight of keeping rates near 1 starts at RIDGE and falls to a quarter until all meet that, but not below LEAST; most passes in all.
TOLERANCE, RIDGE, LEAST, PASSES = 0.002, 0.05, 1e-7, 80
#: Targets of the query as shares of all tokens: domains are quality and toxicity of `labels`. Soft posteriors never are 0, so targets of 0 would drop half the rows to come near.
TARGETS = {"q1t0": 0.93, "q0t0": 0.05, "q1t1": 0.018, "q0t1": 0.002}


def features(text_block: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
    """(feature numbers, words) of each text: its distinct hashed words."""
    hashes, at = hashed_words(text_block)
    slots = (hashes >> U64(64 - FEATURES.bit_length() + 1)).astype(np.int64)
    for s, e in zip(at[:-1], at[1:], strict=True):
        yield np.unique(slots[s:e]), int(e - s)


def significance(rows: list[tuple[int, np.ndarray]], classes: int) -> np.ndarray:
    """Each feature's weight in a text: the largest z-score of its share in one domain against the others; 0 if few rows have it."""
    n = np.bincount([r[0] for r in rows], minlength=classes).astype(float)
    held = np.zeros((FEATURES, classes))
    for label, idx in rows:
        held[idx, label] += 1
    total = held.sum(axis=1, keepdims=True)
    inside, outside = (held + 0.5) / (n + 1), (total - held + 0.5) / (n.sum() - n + 1)
    z = np.abs(inside - outside) / np.sqrt(outside * (1 - outside) * (1 / np.maximum(n, 1) + 1 / np.maximum(n.sum() - n, 1)) + 1e-9)
    return np.where(total[:, 0] >= LEAST_ROWS, np.minimum(z.max(axis=1), MOST_Z) / MOST_Z, 0).astype(np.float32)


def train(rows: list[tuple[int, np.ndarray]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on (label, feature numbers) by Adagrad: (weights with the bias last, the features' significance). A text is the vector of its features' significance, scaled to length 1."""
    w = np.zeros((FEATURES + 1, classes), np.float64)
    if not rows:
        return w, np.zeros(FEATURES, np.float32)
    scale = significance(rows, classes)
    rows = [(label, idx[scale[idx] > 0]) for label, idx in rows]
    label = np.array([r[0] for r in rows])
    idx = np.concatenate([np.append(r[1], FEATURES) for r in rows])
    val = np.concatenate([np.append(scale[r[1]] / max(1e-9, float(np.linalg.norm(scale[r[1]]))), 1.0) for r in rows])
    used, place = np.unique(idx, return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) + 1 for r in rows])
    at = np.flatnonzero(np.diff(row, prepend=-1))
    own, seen = np.zeros((len(used), classes)), np.full((len(used), classes), 1e-8)
    for _ in range(TRAIN_STEPS):
        p = softmax(np.add.reduceat(own[place] * val[:, None], at, axis=0))
        p[np.arange(len(rows)), label] -= 1
        p /= len(rows)
        g = np.stack([np.bincount(place, p[row, k] * val, len(used)) for k in range(classes)], axis=1) + 1e-7 * own
        seen += g * g
        own -= 0.5 * g / np.sqrt(seen)
    w[used] = own
    return w.astype(np.float32), scale


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], max_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Train on at most ``max_rows`` labelled documents, drawn by a hash of the id and then of the text where ids repeat; labels with a null part or an unknown domain are ignored."""
    spark = docs.sparkSession
    name = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("domain")).where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()
    if not some:
        return train([], len(domains))
    picked = spark.createDataFrame([(r[0], domains.index(r[1])) for r in some], "doc_id long, label int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at = utf8_texts(b.column(1)), b.column(0).to_pylist()
            for i, j in text_blocks(texts):
                for k, (idx, _) in enumerate(features(texts[i:j])):
                    yield pa.RecordBatch.from_arrays([pa.array([at[i + k]], pa.int32()), pa.array([idx.astype("<i4").tobytes()], pa.binary())], ["label", "idx"])

    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    rows = drawn(found, len(some), max_rows, TRAIN_BYTES).select("label", "text").mapInArrow(tidy(run), "label int, idx binary").collect()
    return train([(a, np.frombuffer(i, "<i4")) for a, i in sorted((r[0], bytes(r[1])) for r in rows)], len(domains))


def posteriors(texts: list[bytes], model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(domain posteriors, words) of each text; a text without words the model knows has the bias's posteriors."""
    weights, scale = model
    out, words = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts), np.int64)
    for i, j in text_blocks(texts):
        hashes, at = hashed_words(texts[i:j])
        slots = (hashes >> U64(64 - FEATURES.bit_length() + 1)).astype(np.int64)
        n = np.diff(at)
        doc = np.repeat(np.arange(j - i), n)
        known = scale[slots] > 0
        key = np.unique(doc[known] * FEATURES + slots[known])  # one sort for all texts of a block
        d, f = key // FEATURES, key % FEATURES
        v = scale[f].astype(float)
        z = np.stack([np.bincount(d, v * weights[f, k], j - i) for k in range(weights.shape[1])], axis=1)
        out[i:j] = z / np.maximum(np.sqrt(np.bincount(d, v * v, j - i)), 1e-9)[:, None]
        words[i:j] = n
    return softmax(out + weights[-1]), words


def rates_of(p: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Rates of documents with posteriors ``p``: a function of the posteriors and one number per domain, so no rates are stored between steps."""
    return np.maximum(0.0, 1 - p @ pull)


def solve(table: DataFrame, targets: np.ndarray, ridge: float = RIDGE, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """The domains' pulls for rows (n_tokens, p array), and by how much their expected shares then miss the targets.

    Projected gradient steps on the rates, scaled by the second moments of the rows that still have a rate: unscaled ones need hundreds of passes.
    For one weight ``ridge``, rates of 0 or more minimise the squared misses of the shares plus ridge times the token-weighted squared
    distance of rates from 1. At that minimum a rate is max(0, 1 - p . pull) with ridge * pull = miss: a convex problem in D numbers,
    solved in steps that are each one distributed sum of D * (D + 1) + 1 numbers and halved where the objective would rise. The weight
    falls until every domain is within TOLERANCE, so rates leave 1 no further than the targets ask; where soft posteriors make the
    targets impossible, it ends at LEAST with the nearest shares.
    """
    d = len(targets)

    def sums(pull: np.ndarray) -> np.ndarray | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = np.zeros(d * (d + 1) + 2)
            for b in batches:
                if b.num_rows:
                    p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    n = b.column(0).to_numpy(zero_copy_only=False).astype(float)
                    r = rates_of(p, pull)
                    got += np.concatenate([(n * r) @ p, ((p.T * (n * (r > 0))) @ p).ravel(), [n @ (r * r), n.sum()]])
            yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in got], [f"s{i}" for i in range(len(got))])

        width = d * (d + 1) + 2
        out = table.select("n_tokens", "p").mapInArrow(tidy(run), ", ".join(f"s{i} double" for i in range(width))).agg(*[F.sum(f"s{i}") for i in range(width)]).first()
        return np.array(out[:-1]) / out[-1] if out[-1] else None

    pull = np.zeros(d)
    got = sums(pull)
    if got is None:
        return pull, np.zeros(d)
    left = passes - 1
    while True:
        cost = lambda g, x: 0.5 * g[-1] + targets @ x + 0.5 * ridge * x @ x  # noqa: B023, E731
        while left > 0:
            gap = got[:d] - targets - ridge * pull
            if np.abs(gap).max() < TOLERANCE / 100:
                break
            step = np.linalg.solve(got[d:-1].reshape(d, d) + ridge * np.eye(d), gap)
            while left > 0:
                more, left = sums(pull + step), left - 1
                if cost(more, pull + step) <= cost(got, pull) - 1e-4 * (step @ gap):
                    pull, got = pull + step, more
                    break
                step = step / 2
        miss = got[:d] - targets
        if np.abs(miss).max() <= TOLERANCE or ridge <= LEAST or left <= 0:
            return pull, miss
        ridge = max(LEAST, ridge / 4)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], ridge: float = RIDGE, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """The input columns with n_tokens, p (posteriors in the targets' order), rate, copies, and miss: by how much the domains' expected shares miss their targets at most.

    A classifier trained on labelled rows gives each text's domain posteriors; ``solve`` finds rates of 0 or more whose expected
    domain tokens (sum of rate * words * posterior) meet ``targets``, shares of all words, within TOLERANCE where posteriors allow it.
    copies is the rate rounded up or down by a hash of the id, so that it is the rate on average. Null and empty texts have 0 words and
    the prior's posteriors; columns of the names added are replaced; repeated rows are rated each; no rows give none; no words at all leave every rate 1. Texts are never shuffled:
    the last pass computes each row's posteriors again.
    """
    small_batches(docs.sparkSession)
    names = sorted(targets)
    sc = docs.sparkSession.sparkContext
    weights = sc.broadcast(fit(docs, labels, names, max_rows))
    goal = np.array([targets[x] for x in names])
    add = {"n_tokens": pa.int64(), "p": pa.list_(pa.float64()), "rate": pa.float64()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, n = posteriors(utf8_texts(b.column(0)), weights.value)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(list(p), add["p"])], ["n_tokens", "p"])

    table = staged(docs.select("text").mapInArrow(tidy(score), "n_tokens long, p array<double>"), "posteriors")
    pull, missed = solve(table, goal, ridge)
    unstage(table)
    docs = docs.drop(*add, "copies", "miss")
    place = docs.columns.index("text")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, n = posteriors(utf8_texts(b.column(place)), weights.value)
            more = [pa.array(n), pa.array(list(p), add["p"]), pa.array(rates_of(p, pull))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *add])

    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("n_tokens", LongType()), StructField("p", ArrayType(DoubleType())), StructField("rate", DoubleType())])
    out = docs.mapInArrow(tidy(rate), schema)
    u = F.pmod(F.xxhash64(F.lit("copies"), F.col("doc_id").cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return out.withColumn("copies", F.floor(F.col("rate") + u).cast("long")).withColumn("miss", F.lit(float(np.abs(missed).max())))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = sorted(TARGETS)
    mixed = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS)
    return mixed.select("doc_id", "n_tokens", *[F.element_at("p", i + 1).alias(f"p_{x}") for i, x in enumerate(names)], "rate", "copies", "miss")


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op6_mixing": op6_mixing}
