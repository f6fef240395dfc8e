"""Places of rows in the order of their work, however large one work is: no task ever holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.sources.shared import staged

#: Rows of a work that one task windows at a time.
BLOCK = 1000


def positions(rows: DataFrame, by: list[str], key: str, name: str = "pos") -> DataFrame:
    """Add ``name``: each row's place in its group, from 0, by ``key`` (nulls first, ties in any order).

    Rows are range-partitioned by group and key, so a group may lie in many tasks; each task numbers its own rows, and the sums of the tasks'
    counts along a group (a row for each task and group) give every task its first place. Rows are staged, as a second reading of a
    range partitioning may cut elsewhere; pass only the columns that are needed.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in (*by, key)]
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": at}), "ordered")
    counts = rows.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    along = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(along), F.lit(0)) - F.col("_first")).alias("_base"))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(base, same).withColumn(name, F.col("_at") + F.col("_base")).select(*[c for c in rows.columns if c not in ("_part", "_at")], name)


def in_blocks(rows: DataFrame, after: int, pos: str = "pos", size: int = BLOCK) -> DataFrame:
    """Add block and own: each row in the block of its place, and the first ``after`` rows of a block in the one before too (not own), so that windows over blocks see every follower."""
    nth = F.floor(F.col(pos) / size)
    here = F.struct(nth.alias("block"), F.lit(True).alias("own"))
    before = F.when((F.col(pos) % size < after) & (nth > 0), F.struct((nth - 1).alias("block"), F.lit(False).alias("own")))
    return rows.withColumn("_x", F.explode(F.array_compact(F.array(here, before)))).select(*rows.columns, "_x.block", "_x.own")
