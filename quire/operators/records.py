"""Records about texts: incidents, decisions, waivers, ordered and nested tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import signature


def incident_clusters(events: DataFrame) -> DataFrame:
    """(signature, n, users, first_ts) by log template. [A10, T21]"""
    return events.groupBy(signature(F.col("event_type"), F.col("props")).alias("signature")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("first_ts"))


def open_incidents(events: DataFrame, time: str = "ts") -> DataFrame:
    """(user_id, event_type, day, n, last_ts): repeats of an open incident raise its count. Runs on a batch or, with a watermark, on a stream. [X1]"""
    return events.groupBy("user_id", "event_type", F.date_trunc("day", time).alias("day")).agg(F.count("*").alias("n"), F.max(time).alias("last_ts"))


def findings(rows: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; null conditions break nothing. [P8, P12, P13, P14]"""
    return rows.select(key, F.explode(F.array_compact(F.array(*[F.when(c, name) for name, c in rules]))).alias("rule"))


def gate_status(found: DataFrame, waivers: DataFrame, gates: list[str], on: list[str]) -> DataFrame:
    """(gate, n_open, n_waived, status): a gate passes if no finding is left open by waivers. [J18, A11]"""
    marked = found.join(waivers.select(*on).distinct().withColumn("_w", F.lit(1)), on, "left")
    sums = marked.groupBy("gate").agg(F.count_if(F.col("_w").isNull()).alias("n_open"), F.count_if(F.col("_w").isNotNull()).alias("n_waived"))
    every = found.sparkSession.createDataFrame([(g,) for g in gates], "gate string").join(sums, "gate", "left").fillna(0)
    return every.withColumn("status", F.when(F.col("n_open") > 0, "fail").when(F.col("n_waived") > 0, "waived").otherwise("pass"))


def compare_runs(results: DataFrame, key: str, label: str, value: str, a: str, b: str, order: list[str] | None = None) -> DataFrame:
    """(key, mean_a, mean_b, spread, delta, within_noise) of two labels' samples. [A12]

    Sums of doubles depend on their order. With ``order`` (columns that are unique in a key) each label's values are added one by one in it, and
    the means are the same whatever the files and partitions; without it, in the order in which they come.
    """
    held = lambda x: F.when(F.col(label) == x, F.col(value))
    total = lambda x: F.sum(held(x))
    if order:
        w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        results = results.where(F.col(label).isin(a, b)).select(key, label, value, *[c for c in order if c not in (key, label, value)])
        results = results.withColumns({"_ta": F.sum(held(a)).over(w), "_tb": F.sum(held(b)).over(w), "_at": F.struct(*order)})
        total = lambda x: F.max_by("_ta" if x == a else "_tb", "_at")
    agg = results.groupBy(key).agg(
        *[(total(x) / F.count(held(x))).alias(f"mean_{n}") for n, x in (("a", a), ("b", b))],
        *[(F.max(held(x)) - F.min(held(x))).alias(f"_s{n}") for n, x in (("a", a), ("b", b))],
    )
    out = agg.where("mean_a is not null and mean_b is not null").select(key, "mean_a", "mean_b", F.greatest("_sa", "_sb").alias("spread"), (F.col("mean_b") - F.col("mean_a")).alias("delta"))
    return out.withColumn("within_noise", F.abs("delta") <= F.col("spread"))


def round_robin(rows: DataFrame, by: str, key: str, n: int, seed: str) -> DataFrame:
    """(round, by, key): one row of each work in turn, in an order fixed by a hash of the seed, until n. [O2, O3]"""
    rank = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    turn = rows.select(by, key, F.row_number().over(W.partitionBy(by).orderBy(rank)).cast("long").alias("round")).where(F.col("round") <= n)  # n of each work are kept before the shuffle
    return turn.orderBy("round", by).limit(n)


def todo_chunks(rows: DataFrame, done: DataFrame, key: str, size: int = 15) -> DataFrame:
    """(key, chunk): what is not done yet, in chunks of neighbouring ids. Positions come from counts per id range, so no single task orders all rows. [S13, X2, J19]"""
    left = rows.select(key).distinct().join(done.select(key).distinct(), key, "left_anti").withColumn("_r", F.floor(F.col(key) / 10000))
    base = left.groupBy("_r").agg(F.count("*").alias("_n")).withColumn("_b", F.sum("_n").over(W.orderBy("_r")) - F.col("_n"))
    nth = F.row_number().over(W.partitionBy("_r").orderBy(key)) - 1
    return left.withColumn("_i", nth).join(base, "_r").select(key, F.floor((F.col("_b") + F.col("_i")) / size).cast("long").alias("chunk"))


def latest(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """(key, columns) of each key's last row by ``order``, reduced before the shuffle. [W8]"""
    return rows.groupBy(key).agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in columns])


def order_checks(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, n, falls, gaps): rows whose value is under the running maximum, and steps of more than one above it. [W2]"""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    marked = rows.withColumn("_m", F.max(value).over(w))
    return marked.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(value) < F.col("_m")).alias("falls"), F.count_if(F.col(value) > F.col("_m") + 1).alias("gaps"))


def nest(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str = "items") -> DataFrame:
    """Parents with an array of their children, ordered by the fields. [K2, S11]"""
    inner = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(inner, key, "left").withColumn(name, F.coalesce(name, F.array().cast(inner.schema[name].dataType)))


def flatten(nested: DataFrame, key: str, name: str = "items") -> DataFrame:
    return nested.select(key, F.explode(name).alias("_x")).select(key, "_x.*")


def ancestor_spans(nodes: DataFrame, leaves: DataFrame, depth: int = 8) -> DataFrame:
    """(node, lo, hi, n): the span of leaf values below each node of (node, parent), climbing at most ``depth`` levels. [K2]"""
    level = leaves.groupBy("node").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    out = level
    for _ in range(depth):
        level = level.join(nodes.where("parent is not null"), "node").groupBy(F.col("parent").alias("node")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
        out = out.unionByName(level)
    return out.groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def zones(rows: DataFrame, key: str, order: str, opens: dict[str, str]) -> DataFrame:
    """Add zone: the name of the last marker at or before the line (a map from pattern to zone), ``none`` before the first. [W5]"""
    mark = F.coalesce(*[F.when(F.col("line").rlike(p), z) for p, z in opens.items()])
    return rows.withColumn("zone", F.coalesce(F.last(mark, ignorenulls=True).over(W.partitionBy(key).orderBy(order)), F.lit("none")))


def sections(rows: DataFrame, heading: Column, key: str, order: str) -> DataFrame:
    """Add section (0 before the first heading, then counting) to ordered lines. [W4]"""
    return rows.withColumn("section", F.sum(heading.cast("long")).over(W.partitionBy(key).orderBy(order)))


def with_companions(texts: DataFrame, batch: str, keys: list[str]) -> DataFrame:
    """Add status to the texts of all batches: tree in the fullest batch, ties to the least name; merged where another batch's section has its keys there; else refused. [J22]"""
    sizes = texts.where(F.col(batch).isNotNull()).groupBy(batch).agg(F.count("*").alias("n"))
    tree = sizes.orderBy(F.desc("n"), batch).limit(1).select(F.col(batch).alias("_tree"))
    rows = texts.join(F.broadcast(tree), F.col(batch) == F.col("_tree"), "left")
    sections = rows.where("_tree is not null").select(*keys).distinct().withColumn("_known", F.lit(True))
    status = F.when(F.col("_tree").isNotNull(), "tree").when(F.col("_known"), "merged").otherwise("refused")
    return rows.join(sections, keys, "left").withColumn("status", status).drop("_tree", "_known")


def rekey(judged: DataFrame, new: DataFrame, key: str, house: Callable[[Column], Column]) -> DataFrame:
    """(key, verdict): whether a judgement of ``judged`` (key, text) holds for ``new`` (key, text): same, house where only the house pass changed the text, reread otherwise, gone without a new text. [J23]"""
    rows = judged.select(key, F.col("text").alias("old")).join(new.select(key, F.col("text").alias("now"), F.lit(True).alias("there")), key, "left")
    verdict = F.when(F.col("there").isNull(), "gone").when(F.col("old").eqNullSafe(F.col("now")), "same").when(house(F.col("old")).eqNullSafe(F.col("now")), "house").otherwise("reread")
    return rows.select(key, verdict.alias("verdict"))
