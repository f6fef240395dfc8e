"""Shards of bounded bytes by extendible hashing (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import staged

#: Bits of the key's hash that the directory may use.
HASH_BITS = 48
#: Cells of the finest level for each shard that the total calls for, as a power of two; bits added where cells are still too large.
SPARE_BITS, MORE_BITS = 4, 8
#: Production value of the query: bytes of text in a shard.
LIMIT_BYTES = 1 << 20


def key_hash(column: F.Column) -> F.Column:
    """The first 48 bits of the MD5 of the key as text, which other engines can compute too; a null key hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """The leaves (depth, prefix, bytes, rows, one_key) of the directory over rows (h, bytes).

    A node is the rows that share ``depth`` leading bits. The root splits if it is over the limit, and so does each node below it that
    is, until it fits or all its rows share one hash. All levels of a pass come from one aggregation into cells of the finest level, which
    number about 16 for each shard; only cells that are still too large are read again with more bits.
    """
    total = int(sizes.agg(F.sum("bytes")).first()[0] or 0)
    low, top = 0, min(HASH_BITS, (total // max(1, limit)).bit_length() + SPARE_BITS)
    rows, found = sizes, None
    while True:
        cells = rows.groupBy(F.expr(f"shiftright(h, {HASH_BITS - top})").alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        nodes = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(top))).alias("depth"))
        nodes = nodes.groupBy("depth", F.expr(f"shiftright(cell, {top} - depth)").alias("prefix")).agg(
            F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        )
        nodes = nodes.withColumn("splits", (F.col("bytes") > limit) & (F.col("lo") < F.col("hi")))
        nodes = staged(nodes, "nodes")
        parents = nodes.where("splits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        below = nodes.where(F.col("depth") > low).withColumn("parent", F.expr("shiftright(prefix, 1)")).join(parents, ["depth", "parent"], "left_semi")
        live = nodes.where(F.col("depth") == low).unionByName(below.drop("parent"))
        leaves = live.where("not splits").select("depth", "prefix", "bytes", "rows", (F.col("lo") == F.col("hi")).alias("one_key"))
        found = leaves if found is None else found.unionByName(leaves)
        open_ = live.where(F.col("splits") & (F.col("depth") == top)).select(F.col("prefix").alias("cell"))
        if open_.isEmpty():
            return found
        rows = rows.withColumn("cell", F.expr(f"shiftright(h, {HASH_BITS - top})")).join(open_, "cell", "left_semi").drop("cell")
        low, top = top, min(HASH_BITS, top + MORE_BITS)


def _placed(rows: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """The rows, which hold _h and _bytes, with _depth, _prefix, _all (bytes of the bucket) and _part."""
    depths = [r[0] for r in found.select("depth").distinct().orderBy("depth").collect()] or [0]  # HASH_BITS + 1 values at most
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.expr(f"shiftright(_h, {HASH_BITS - d})").alias("prefix")) for d in depths]))
    leaves = found.select(F.col("depth").alias("_depth"), F.col("prefix").alias("_prefix"), F.col("bytes").alias("_all"), F.col("rows").alias("_rows"))
    own = rows.columns
    put = rows.withColumn("_at", at).select(*own, F.col("_at.depth").alias("_depth"), F.col("_at.prefix").alias("_prefix")).join(leaves, ["_depth", "_prefix"])
    put = put.withColumn("_part", F.lit(0).cast("long"))
    full = (F.col("_all") > limit) & (F.col("_rows") > 1)
    if not found.where((F.col("bytes") > limit) & (F.col("rows") > 1)).isEmpty():
        leaf = ["_depth", "_prefix"]
        tight = staged(put.where(full).withColumn("_src", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()), "tight")
        sums = tight.groupBy(*leaf, "_src").agg(F.sum("_bytes").alias("sum"), F.max("_bytes").alias("most"))
        across = W.partitionBy(*leaf).orderBy("_src")  # a row for each input partition
        sums = sums.select(*leaf, "_src", (F.sum("sum").over(across) - F.col("sum")).alias("_base"), F.max("most").over(W.partitionBy(*leaf)).alias("_most"))
        run = F.sum("_bytes").over(W.partitionBy(*leaf, "_src").orderBy("_nth")) - F.col("_bytes")
        cut = tight.withColumn("_run", run).join(sums, [*leaf, "_src"])
        cut = cut.withColumn("_part", F.floor((F.col("_base") + F.col("_run")) / F.greatest(F.lit(limit) - F.col("_most"), F.lit(1))).cast("long"))
        put = put.where(~full).unionByName(cut.select(put.columns))
    return put


def _sized(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.withColumn("_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn("_h", key_hash(F.col(key)))


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """Each row's (doc_id, bytes, shard_depth, shard_prefix, shard_part, shard_bytes); (depth, prefix, part) names its shard.

    Every shard's texts fit ``limit`` bytes; one text longer than that is a shard by itself. Rows that share one key also share every bit
    of its hash: if together they are over the limit, ``shard_part`` (0 elsewhere) cuts them by running bytes, counted per input
    partition and then across partitions, so no task gathers them; their ``shard_bytes`` is that of the whole bucket. Null text has 0
    bytes, a null key hashes as the empty text, repeated rows each count, extra columns are left out, no rows give no shards.
    """
    rows = staged(_sized(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text").drop("text"), "sizes")
    found = staged(directory(rows.select(F.col("_h").alias("h"), F.col("_bytes").alias("bytes")), limit), "directory")
    put = _placed(rows, found, limit)
    return put.select(
        "doc_id", F.col("_bytes").alias("bytes"), F.col("_depth").cast("long").alias("shard_depth"), F.col("_prefix").alias("shard_prefix"), F.col("_part").alias("shard_part"), F.col("_all").alias("shard_bytes")
    )


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> None:
    """Write all columns of the documents as Parquet folders ``_shard=depth-prefix-part``.

    Each row goes to its own part, so rows of one key that are cut over parts are written to those. Texts are shuffled once, by shard;
    input columns named _h, _bytes and the like, or _shard, would clash and are an error.
    """
    made = {"_h", "_bytes", "_depth", "_prefix", "_all", "_rows", "_part", "_src", "_nth", "_run", "_base", "_most", "_at", "_shard"}
    if made & set(docs.columns):
        raise ValueError(f"columns {sorted(made & set(docs.columns))} are names this writer uses")
    rows = _sized(docs, key, text)
    found = staged(directory(rows.select(F.col("_h").alias("h"), F.col("_bytes").alias("bytes")), limit), "directory")
    put = _placed(rows, found, limit).withColumn("_shard", F.concat_ws("-", "_depth", "_prefix", "_part"))
    put.select(*docs.columns, "_shard").repartition("_shard").write.partitionBy("_shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = {
    "op10_sharding": f"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h FROM documents),
n AS (SELECT d, h >> ({HASH_BITS} - d) AS prefix, sum(bytes)::BIGINT AS bytes, sum(bytes) > {LIMIT_BYTES} AND min(h) < max(h) AS splits
      FROM r, (SELECT unnest(range(0, {HASH_BITS} + 1))::INTEGER AS d) GROUP BY 1, 2),
f AS (SELECT x.* FROM n x LEFT JOIN n p ON p.d = x.d - 1 AND p.prefix = x.prefix >> 1 WHERE NOT x.splits AND (x.d = 0 OR p.splits))
SELECT doc_id, r.bytes, f.d::BIGINT AS shard_depth, f.prefix AS shard_prefix, 0::BIGINT AS shard_part, f.bytes AS shard_bytes
FROM r JOIN f ON r.h >> ({HASH_BITS} - f.d) = f.prefix"""
}
QUERIES = {"op10_sharding": op10_sharding}
