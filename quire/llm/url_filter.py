"""URL filters by a temporal list join (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A list of up to so many intervals is broadcast; a longer one is joined by sort and merge.
BROADCAST_ROWS = 100_000
#: The list of the query: (date, host or host/path prefix, action). Hosts and paths occur in the pages.
ENTRIES = (
    ("2024-01-01", "example.org", "watch"),
    ("2024-02-10", "tionsh.example.net", "block"),
    ("2024-06-15", "tionsh.example.net", "remove"),
    ("2024-09-01", "tionsh.example.net", "block"),
    ("2024-03-01", "tionsh.example.net/en", "allow"),
    ("2024-10-01", "tionsh.example.net/en", "remove"),
    ("2024-01-20", "tionble.example.com", "block"),
    ("2024-07-01", "blog.tionble.example.com", "allow"),
    ("2024-04-01", "m.tiontion.example.com/de", "block"),
    ("2024-05-05", "ththth.example.org", "block"),
    ("2024-05-20", "ththth.example.org", "allow"),
    ("2024-08-01", "thering.example.org/de", "block"),
    ("2024-11-11", "therha.example.net", "block"),
    ("2024-12-24", "example.com", "watch"),
)


def intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (entry_date, pattern, action) as (pattern, action, valid_from, valid_to): each holds until the pattern's next entry.

    ``remove`` only ends what was before; of entries of one pattern and day the last action in alphabetical order counts. Patterns are
    lower-cased and lose a trailing slash; entries with a null part are ignored. valid_to is null for the entry that still holds.
    """
    clean = entries.select(F.to_date("entry_date").alias("valid_from"), F.lower(F.regexp_replace("pattern", "/+$", "")).alias("pattern"), "action").dropna()
    clean = clean.groupBy("pattern", "valid_from").agg(F.max("action").alias("action"))
    w = W.partitionBy("pattern").orderBy("valid_from")
    return clean.withColumn("valid_to", F.lead("valid_from").over(w)).where("action <> 'remove'")


def host_of(url: Column) -> Column:
    """The URL's lower-case host without user, port or trailing dot; empty if the URL has no scheme and host."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1), r"\.+$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_on", key: str = "page_id") -> DataFrame:
    """Each capture's (key, url, host, at, decision, matched, valid_from, valid_to) by the entries active on its date.

    A pattern matches its host and all subdomains, with a path also every path below it. The most specific active pattern decides:
    more labels, then more path segments; without one, ``keep``. A null or malformed URL and a null date match nothing. Repeated captures
    stay repeated. A capture is expanded only into the keys that patterns of this list can have (their largest numbers of labels and
    segments), so no key of a long URL is lost; the as-of condition is part of the equi-join on the key. Only keys that match are
    grouped by capture, and only a row number and the winner of each come back to the captures. The list is broadcast only if counted small; a hot
    host is otherwise split by AQE. Captures must come from files or staged tables, which give the same rows when read twice; extra
    columns are left out, and an empty table gives no rows.
    """
    valid = intervals(entries)
    labels = F.size(F.split(F.element_at(F.split("pattern", "/"), 1), r"\."))
    n, most, deep = valid.agg(F.count("*"), F.max(labels), F.max(F.size(F.split("pattern", "/")) - 1)).first()
    rows = captures.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.to_date(F.col(at)).alias("fetched_on"))
    rows = rows.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit(""))).withColumn("row", F.monotonically_increasing_id())
    parts = F.when(F.col("host") != "", F.split("host", r"\.")).otherwise(F.array().cast("array<string>"))
    steps = F.filter(F.split(F.lower(F.coalesce(path_of(F.col("url")), F.lit(""))), "/"), lambda s: s != "")
    keys = rows.withColumn("p", parts).withColumn("s", steps)
    hosts = F.expr(f"transform(sequence(1, least(size(p), {most or 0})), k -> struct(k as labels, concat_ws('.', slice(p, size(p) - k + 1, k)) as name))")
    hosts = F.when(F.least(F.size("p"), F.lit(most or 0)) > 0, hosts)
    keys = keys.withColumn("hosts", hosts)
    pats = F.expr(
        f"flatten(transform(hosts, h -> transform(sequence(0, least(size(s), {deep or 0})), "
        "d -> struct(h.labels as labels, d as segments, concat_ws('/', h.name, case when d > 0 then concat_ws('/', slice(s, 1, d)) end) as pattern))))"
    )
    tried = keys.select("row", "fetched_on", F.explode(pats).alias("k")).select("row", "fetched_on", "k.*")
    right = F.broadcast(valid) if n <= BROADCAST_ROWS else valid.hint("merge")
    hit = tried.alias("t").join(
        right.alias("v"),
        (F.col("t.pattern") == F.col("v.pattern")) & (F.col("v.valid_from") <= F.col("t.fetched_on")) & (F.col("v.valid_to").isNull() | (F.col("t.fetched_on") < F.col("v.valid_to"))),
    )
    best = hit.groupBy("t.row").agg(F.max(F.struct("t.labels", "t.segments", "v.pattern", "v.action", "v.valid_from", "v.valid_to")).alias("b"))
    return rows.join(best, "row", "left").select(
        "page_id", "url", "host", "fetched_on", F.coalesce("b.action", F.lit("keep")).alias("decision"), F.col("b.pattern").alias("matched"), F.col("b.valid_from").alias("valid_from"), F.col("b.valid_to").alias("valid_to")
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; as the table has no fetch dates, page_id mod 366 counts the days from 2024-01-01."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id, 366) as int))").alias("fetched_on"))
    return url_filter(captures, spark.createDataFrame(list(ENTRIES), "entry_date string, pattern string, action string"))


_VALUES = ", ".join(f"(DATE '{d}', '{p}', '{a}')" for d, p, a in ENTRIES)
ORACLE_SQL = {
    "op1_url_filter": rf"""
WITH e(d, pattern, action) AS (VALUES {_VALUES}),
v AS (SELECT pattern, action, d AS valid_from, lead(d) OVER (PARTITION BY pattern ORDER BY d) AS valid_to FROM e),
c AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INTEGER AS fetched_on,
             lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) AS host,
             lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)) AS path FROM pages),
m AS (SELECT c.page_id, v.*, row_number() OVER (PARTITION BY c.page_id ORDER BY len(string_split(split_part(pattern, '/', 1), '.')) DESC, len(string_split(pattern, '/')) DESC, pattern DESC) AS k
      FROM c JOIN v ON ('.' || c.host) LIKE ('%.' || split_part(pattern, '/', 1))
        AND (NOT contains(pattern, '/') OR starts_with(c.path || '/', substr(pattern, instr(pattern, '/')) || '/'))
        AND valid_from <= fetched_on AND (valid_to IS NULL OR fetched_on < valid_to) AND action <> 'remove')
SELECT c.page_id, c.url, c.host, c.fetched_on, coalesce(m.action, 'keep') AS decision, m.pattern AS matched, m.valid_from, m.valid_to
FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.k = 1"""
}
QUERIES = {"op1_url_filter": op1_url_filter}
