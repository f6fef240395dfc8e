"""Importance resampling of documents towards a target distribution of hashed word features."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, unstage

# The characters that part words, once A-Z are in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Buckets of features, which bounds all that reaches the driver.
BUCKETS = 10_000
#: Production values: words a document needs to be drawn, the share drawn in hundredths, and the seed of the noise.
LEAST_WORDS, PERCENT, SEED = 20, 25, 7


def words(text: Column) -> Column:
    """The words of a text in order; A-Z count as a-z."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, SEPARATORS), "")


def buckets(words: Column) -> Column:
    """The bucket of each word and of each two neighbours joined by a space."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    at = lambda x: (F.crc32(x.cast("binary")) % BUCKETS).cast("int")
    pairs = F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: at(F.concat(a, F.lit(" "), b)))
    return F.concat(F.transform(words, at), pairs)


def featured(rows: DataFrame, text: str) -> DataFrame:
    """The rows with ``_words``' number as n_words and their buckets, in place of the text."""
    got = rows.withColumn("_words", words(F.col(text))).drop(text)
    return got.select("*", F.size("_words").alias("n_words"), buckets(F.col("_words")).alias("buckets")).drop("_words")


def totals(rows: DataFrame, text: str) -> list[int]:
    """How many features of all rows each bucket has. Each task sums its own first, so only totals are shuffled.

    The outer form of explode keeps Spark from asking for the arrays' sizes in a filter before it, which would make every array again.
    """
    out = [0] * BUCKETS
    for r in featured(rows.select(text), text).select(F.explode_outer("buckets").alias("b")).groupBy("b").count().collect():
        if r.b is not None:
            out[r.b] = r["count"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """A bucket's gain in thousandths: the logarithm of its smoothed share in the target over that in the source, rounded down."""
    s_all, t_all = float(sum(source) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source, target, strict=True)]


def literal_array(values: list[int]) -> Column:
    """An array of numbers as one literal: a folded constant in place of an expression for each entry."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """Each row's (doc_id, n_features, weight, score, rank): rank is null unless the row is drawn.

    A row's weight is the mean gain of its features, rounded down (0 without features); its score adds noise that follows from seed and id, so the
    highest scores are a draw without replacement in proportion to exp(weight / 1000). Of the rows with ``least_words`` words or more
    the ``percent`` hundredths with the highest scores are drawn, ties to the smaller id, an absent id last. Null text has no words; rows that repeat
    count and are ranked each; a null id's noise is that of the empty text; extra columns are left out; an empty table gives no rows, and
    an empty target only its smoothed shares.

    Scoring explodes nothing: a row's buckets stay an array, which is summed over the gains, a literal of fixed size. Ranks
    come from a range-partitioned sort of the scores and the number of rows in each partition, never from one task.
    """
    spark = docs.sparkSession
    gain = literal_array(gains(totals(docs, text), totals(target, target_text)))
    rows = featured(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")), "_text")
    rows = rows.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(gain, b + 1)).alias("sum"))
    n, total = F.col("n_features"), F.col("sum")
    weight = F.when(n == 0, 0).otherwise(F.expr("(sum - pmod(sum, n_features)) div n_features"))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((noise + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = rows.withColumn("weight", weight.cast("long"))
    rows = rows.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "scores")
    able = F.col("n_words") >= least_words
    drawn = rows.where(able).count() * percent // 100
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [~able, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranked = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranked = ranked.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranked = staged(ranked, "ranked")
    unstage(rows)
    sizes = {r.part: r["count"] for r in ranked.groupBy("part").count().collect()}  # a row for each partition
    before, base = 0, []
    for p in range(max(sizes, default=0) + 1):
        base.append(before)
        before += sizes.get(p, 0)
    rank = F.element_at(literal_array(base), F.col("part") + 1) + F.col("at") + 1
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).cast("long").alias("rank"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words or more, drawn towards the features of the benchmark."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 of the UTF-8 bytes of s in DuckDB, over the table t.crc of its 256 steps.
CRC_TABLE = """(SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc_sql(s: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({s})),
  lambda i: ('0x' || substr(hex({s}), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1])))"""


ORACLE_SQL = {
    "op11_resampling": f"""
WITH x AS (SELECT 0 AS part, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT part, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM x),
f AS (SELECT part, doc_id, len(w) AS n_words, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
c AS (SELECT part, doc_id, f, count(*) AS k FROM f GROUP BY ALL),
b AS (SELECT f, {crc_sql("f")} % {BUCKETS} AS b FROM (SELECT DISTINCT f FROM c), {CRC_TABLE} t),
n AS (SELECT b, coalesce(sum(k) FILTER (WHERE part = 0), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (WHERE part = 1), 0)::DOUBLE AS t FROM c JOIN b USING (f) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + {BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM n) + {BUCKETS}))))::BIGINT AS gain FROM n),
d AS (SELECT doc_id, sum(k)::BIGINT AS n_features, sum(k * gain)::BIGINT AS total FROM c JOIN b USING (f) JOIN g USING (b) WHERE part = 0 GROUP BY doc_id),
r AS (SELECT w.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(floor(total / n_features), 0)::BIGINT AS weight,
             ('0x' || substr(sha256('{SEED}:' || w.doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN d USING (doc_id) WHERE part = 0),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place,
             (SELECT count(*) * {PERCENT} // 100 FROM r WHERE n_words >= {LEAST_WORDS}) AS drawn FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= drawn THEN place END AS rank FROM o"""
}
QUERIES = {"op11_resampling": op11_resampling}
