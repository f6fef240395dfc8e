"""Exact top-k by inner product: MaxScore over shards of integer vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import small_batches, tidy

#: Vectors of a shard, queries of a block (8 MB of 64 components; each vector is moved once for each block), and the least groups of shards that a block meets in parallel.
SHARD, BLOCK, GROUPS = 4096, 16384, 24
#: Terms probed at once.
STEP = 8


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.maximum(q * high, q * low)


def shard_topk(q: np.ndarray, lists: np.ndarray, high: np.ndarray, low: np.ndarray, least, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, scores) of every row of a shard that can be among the best k with a score of ``least`` or more.

    ``lists`` holds each term's postings (terms x rows). A query term adds at most its bound over the shard. Terms are taken by falling
    range of what they can add; the essential ones are the shortest prefix without which no row can reach ``least`` by the others' bounds
    (all, while there is no threshold). Essential postings are summed for all rows; the rest is probed, a few terms at a time, for rows
    whose sum plus the remaining bounds still reaches it.
    """
    top, bottom = _bounds(q, high, low), -_bounds(-q, high, low)
    order = np.argsort(-(top - bottom), kind="stable")
    after = np.append(np.cumsum(top[order][::-1])[::-1], 0)  # bounds of the terms from each place on
    if least is None or after[0] < least:
        n = len(q) if least is None else 0
    else:
        # what rows without any gain over a term's bottom in the first n terms can reach
        reach = np.concatenate([[0], np.cumsum(bottom[order])]) + after
        n = int(np.argmax(reach < least)) if (reach < least).any() else len(q)
    if not n and least is not None:
        return np.empty(0, np.int64), np.empty(0, lists.dtype)
    terms = order[:n]
    score = q[terms] @ lists[terms]
    rows = np.arange(lists.shape[1])
    while True:
        if least is not None:
            keep = score + after[n] >= least
            rows, score = rows[keep], score[keep]
        if n >= len(q) or not len(rows):
            break
        terms = order[n : n + STEP]
        score = score + q[terms] @ lists[np.ix_(terms, rows)]
        n += len(terms)
    if len(rows) > k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        keep = score >= floor
        rows, score = rows[keep], score[keep]
    return rows, score


def _matrix(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, "<i8").reshape(-1, width)


def _blocks(df: DataFrame, size: int, cols: str) -> DataFrame:
    """Rows (…key columns, id, v binary) of each task as rows of up to ``size`` vectors: (key columns, ids binary, vs binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(part: int) -> pa.RecordBatch:
            got = held.pop(part)
            ids, vs = b"".join(int(x[0]).to_bytes(8, "little", signed=True) for x in got), b"".join(x[1] for x in got)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([ids], pa.binary()), pa.array([vs], pa.binary())], ["part", "ids", "vs"])

        for b in batches:
            for part, i, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(part, []).append((i, v))
                if len(held[part]) >= size:
                    yield out(part)
        for part in list(held):
            yield out(part)

    return df.select(*cols.split()).mapInArrow(tidy(run), "part int, ids binary, vs binary")


def topk(vectors: DataFrame, is_query: F.Column, k: int = 5, key: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the highest integer inner product with each query row, ties to the smaller id.

    Components become floor(scale * x) as 64-bit integers, saturated. Rows with a null id, and vectors that are null or hold a null or
    non-finite component, take no part; a row is not its own candidate, nor is another row with its id. Vectors of different length meet
    as if the shorter one ended in zeros. Fewer candidates than k give all of them; repeated query rows give their result once.
    Queries go in blocks of ``BLOCK`` against shards of ``SHARD`` rows; each task keeps k rows for each query of its block, and the
    shards' results are merged by rank.
    """
    small_batches(vectors.sparkSession)
    x = F.col("embedding")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("q"))
    fine = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = rows.where(F.coalesce(fine, F.lit(False))).withColumn("v", F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, width)
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(-1, width)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in flat], pa.binary())], ["vec_id", "q", "v"])

    rows = rows.select("vec_id", "q", "v").mapInArrow(tidy(pack), "vec_id long, q boolean, v binary")
    queries = rows.where("q").dropDuplicates(["vec_id"])
    blocks = max(1, -(-queries.count() // BLOCK))
    groups = max(GROUPS, -(-rows.count() // (16 * SHARD)))  # a task meets 16 shards or so
    of = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    asked = queries.withColumn("part", of(blocks)).repartition(blocks, "part")
    asked = _blocks(asked, BLOCK, "part vec_id v").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(F.col("part").alias("block"), "g", F.col("ids").alias("qids"), F.col("vs").alias("qs"))
    shards = _blocks(rows.withColumn("part", of(groups)), SHARD, "part vec_id v").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("block", F.col("part").alias("g"), "ids", "vs")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        names = ["query_id", "vec_id", "score"]

        def flush() -> pa.RecordBatch:
            found = [(q, i, s) for q, got in best.items() for s, i in got]
            best.clear()
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        for b in batches:
            for qids, qs, ids, vs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                qids, ids = np.frombuffer(qids, "<i8"), np.frombuffer(ids, "<i8")
                q, x = _matrix(qs, width), _matrix(vs, width).T
                if len(best) + len(qids) > 4 * BLOCK:
                    yield flush()
                most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * width * 2
                kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object  # exact for integers of these sizes
                q, x = q.astype(kind), np.ascontiguousarray(x.astype(kind))
                high, low = x.max(axis=1), x.min(axis=1)
                for qid, one in zip(qids.tolist(), q, strict=True):
                    got = best.setdefault(qid, [])
                    least = got[-1][0] if len(got) >= k else None
                    if least is None and x.shape[1] > 64:  # a few rows give the first threshold
                        s = one @ x[:, :64]
                        s = s[ids[:64] != qid]
                        least = np.partition(s, len(s) - k)[len(s) - k] if len(s) >= k else None
                    found, score = shard_topk(one, x, high, low, least, k + 1)  # the query's own row may be one of them
                    got += [(min(max(int(s), -(2**63)), 2**63 - 1), int(i)) for i, s in zip(ids[found], score, strict=True) if i != qid]
                    got.sort(key=lambda t: (-t[0], t[1]))
                    del got[k:]
        yield flush()

    met = asked.hint("merge").join(shards, ["block", "g"]).select("qids", "qs", "ids", "vs")
    found = met.mapInArrow(tidy(search), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = {
    "op4_maxscore": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5"""
}
QUERIES = {"op4_maxscore": op4_maxscore}
