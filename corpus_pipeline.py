"""From documents to packed training sequences: language ID, exact dedup, near-duplicate removal, mixing, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame whose result is written as Parquet and read again as the next one's ``docs``. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import exact_dedup, language_id, mixing, ngram_join, packing
from quire.llm.common import split_by, staged, unstage

#: A text whose words' mean marginal for its language is lower is rejected; four languages at random would give 0.25.
LEAST_SCORE = 0.4


#: Columns that tell rows apart while a stage runs: ids may repeat or be null.
ROW, DIGEST = "_row", "_digest"
#: The columns that stages read; all others only pass through them, under names that no stage uses.
USED = ("doc_id", "text", "lang", "source")


def _aside(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{x}`").alias(x if x in USED else f"_in_{x}") for x in docs.columns])


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as they were."""
    return rows.select(*[F.col(f"`{x if x in USED else f'_in_{x}'}`").alias(x) for x in docs.columns])


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose words' mean marginal for their language is ``LEAST_SCORE`` or more; texts without letters go."""
    tagged = language_id.language_id(_aside(docs), carry=True)
    return _back(tagged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that of the largest id, and one of those where rows repeat with that id. Only texts of such rows are shuffled."""
    key = ["_id", DIGEST]
    marked = exact_dedup.exact_dedup(docs).select(F.xxhash64("doc_id").alias("_id"), F.unhex("text_sha256").alias(DIGEST), "kept")
    marked = marked.groupBy(*key).agg(F.first("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
    marked = staged(marked.withColumn(ROW, F.xxhash64("_id", DIGEST)), "marked")
    rows = exact_dedup.with_digest(_aside(docs), "text", DIGEST).withColumn("_id", F.xxhash64("doc_id")).withColumn(ROW, F.xxhash64("_id", DIGEST))
    some, others = split_by(rows, ROW, marked.select(ROW))
    some = some.dropDuplicates(["doc_id", *key]).join(marked.where("not kept").select(*key), key, "left_anti")
    return _back(some.select(rows.columns).unionByName(others), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that of the least id, null last. Rows are told apart by a hash of id and text; only texts of rows that go are shuffled."""
    rows = _aside(docs).withColumn(ROW, F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    found = ngram_join.ngram_join(rows, ROW).select(F.col("doc_id").alias(ROW), "component_id")
    ids = rows.select(ROW, F.col("doc_id").alias("id"))
    found = staged(found.join(ids, ROW), "components")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", ROW))
    groups = staged(found.groupBy("component_id").agg(first.alias("x"), F.count("*").alias("n")).where("n > 1"), "groups")
    members = found.where(F.col(ROW) != F.col("component_id")).select(ROW).unionByName(groups.select(F.col("component_id").alias(ROW)))
    gone = staged(members.join(groups.select(F.col(f"x.{ROW}").alias(ROW)), ROW, "left_anti").distinct(), "gone")
    some, others = split_by(rows, ROW, gone)
    return _back(some.join(gone, ROW, "left_anti").select(rows.columns).unionByName(others), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its rate says: 0 times where the targets leave no room for its domain."""
    mixed = mixing.mix(_aside(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), mixing.TARGETS)
    return _back(mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: SQL can't express the trained classifiers; tests compare the copy stages with brute force, the others with their operators' rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table goes when the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
            unstage(before)
    return docs
