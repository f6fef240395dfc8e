"""Page folders, tables and guarded writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import strip_comments

#: Fixed value: how a page declares its join with the next one.
JOINS = r"joins-next:\s*(hyphen|space|para)"


def read_pages(spark: SparkSession, folder: str, first: int, last: int, number: str = r"(\d+)\.\w+$") -> DataFrame:
    """(n, path, body, joins_next, sha256) of whole-text pages first..last; a missing number is an error, never skipped. [S1]"""
    raw = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    pages = raw.withColumn("n", F.regexp_extract("path", number, 1).cast("int")).where(F.col("n").between(first, last))
    missing = spark.range(first, last + 1).select(F.col("id").cast("int").alias("n")).join(pages.select("n"), "n", "left_anti")
    gone = [r[0] for r in missing.orderBy("n").limit(8).collect()]
    if gone:
        raise FileNotFoundError(f"pages missing from {folder}: {gone}")
    note = F.regexp_extract("value", JOINS, 1)
    return pages.select("n", "path", F.trim(strip_comments(F.col("value"))).alias("body"), F.when(note != "", note).alias("joins_next"), F.sha2(F.col("value"), 256).alias("sha256"))


def read_tsv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A tab-separated table with a header and a given schema; malformed rows are an error (``corpus.read_table`` checks rules too). [S4]"""
    return spark.read.csv(path, sep="\t", header=True, schema=columns, mode="FAILFAST", quote="", comment="#")


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Nested documents with a given schema. [S11]"""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_if_clean(df: DataFrame, findings: DataFrame, path: str) -> int:
    """Write only if there is no finding; returns how many there are. [K1]"""
    n = findings.count()
    if not n:
        df.write.parquet(path)
    return n


def html_paragraphs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, text, is_link) of paragraphs, tags removed; is_link if a link is all there is. [S8, T3]"""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1))
    rows = pages.select(key, F.posexplode(found).alias("pos", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"\s+", " "))
    return rows.select(key, F.col("pos").cast("long").alias("pos"), text.alias("text"), F.trim("raw").rlike(r"(?s)^<a [^>]*>[^<]*</a>$").alias("is_link"))
