"""Exact duplicates by a persistent digest index (native)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _delete, join_groups, staged, unstage

def with_digest(df: DataFrame, text: str = "text", digest: str = "digest") -> DataFrame:
    """Add the SHA-256 (32 bytes) of the text in UTF-8; a null text counts as the empty one."""
    return df.withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))


class DigestIndex:
    """A table (digest, keep_id, n) bucketed and sorted by digest in the session's warehouse.

    ``add`` deduplicates a batch within itself, drops by a sort-merge anti-join what the index has, and appends the rest with the
    id that stays; of known digests it appends only how many rows more there are (keep_id null, again true). The index side is read bucket by bucket
    without a shuffle. It survives the session: ``DigestIndex(spark, name)`` finds the files again, and their number of buckets,
    which is stored beside them. Null ids are never kept in favour of others (max ignores null); an empty batch appends nothing.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = 0):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = self._stored() or buckets or max(12, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
        if not self._stored():
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.mode("overwrite").parquet(f"{self.path}_buckets")
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, n BIGINT, again BOOLEAN) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )

    def _stored(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}_buckets/_SUCCESS")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(f"{self.path}_buckets").first()[0] if there else 0

    @property
    def path(self) -> str:
        return f"{self.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{self.name}"

    def table(self) -> DataFrame:
        """(digest, keep_id, n): each digest with the id that stays and its rows of all batches. Bucketing makes the sums local."""
        return self.spark.table(self.name).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def groups(self, batch: DataFrame, key: str) -> DataFrame:
        """One row per distinct digest of the batch; partial sums run before the shuffle, so a hot text is one row per task."""
        return batch.groupBy("digest").agg(F.max(key).cast("long").alias("keep_id"), F.count("*").alias("n"))

    def _append(self, rows: DataFrame) -> None:
        (
            rows.repartition(self.buckets, "digest").sortWithinPartitions("digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)
        )

    def add(self, batch: DataFrame, key: str) -> None:
        groups = staged(self.groups(batch, key), "batch")
        known = self.spark.table(self.name).where("not again").select("digest").hint("merge")
        new = groups.join(known, "digest", "left_anti").withColumn("again", F.lit(False))
        more = groups.join(known, "digest", "left_semi").withColumn("again", F.lit(True)).withColumn("keep_id", F.lit(None).cast("long"))
        self._append(new.unionByName(more))
        unstage(groups)

    def drop(self) -> None:
        """Remove the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        for path in (self.path, f"{self.path}_buckets"):
            _delete(self.spark, path)


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """Each row's (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical; of equal texts the row with the largest id stays, unless an index given holds the text already: then
    the indexed row stays. group_size counts the rows of that text in this and all earlier batches. Null text is empty; rows that repeat
    with the same id are all marked kept (they are one document); of rows without an id all are kept where no other has the text. Extra
    columns are left out, an empty table gives no rows. Only ids and digests are shuffled, never texts; members of hot groups meet
    their group by broadcast. Without an index given, one is made for this call and removed.
    """
    spark = docs.sparkSession
    own = index is None
    index = index or DigestIndex(spark)
    rows = with_digest(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text").select("doc_id", "digest")
    rows = staged(rows, "digests")
    total = rows.count()
    index.add(rows, "doc_id")
    groups = index.table().withColumnRenamed("n", "group_size")
    if not own:  # an index may hold far more than this batch
        groups = groups.join(rows.select("digest").distinct(), "digest", "left_semi")
    groups = staged(groups, "groups")
    if own:
        index.drop()
    return join_groups(rows, groups, ["digest"], "group_size", total).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with an index of their own."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = {
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
QUERIES = {"op9_exact_dedup": op9_exact_dedup}
