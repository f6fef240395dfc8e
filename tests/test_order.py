"""Places in order: against plain sorting, with a group that holds most rows, nulls and ties."""

import random
from itertools import groupby

from pyspark.sql import functions as F

from quire.operators import align, assemble, order, screens
from quire.sources.corpus import packets


def rows_of(n: int) -> list[tuple]:
    rng = random.Random(7)
    return [(rng.choice(["hot"] * 8 + ["a", None]), k, rng.choice(["x y", "Z.", "simi-", "", None, "# h"])) for k in rng.sample(range(10 * n), n)]


def test_positions(spark):
    rows = rows_of(3000)
    df = spark.createDataFrame(rows, "work string, n long, text string").repartition(7)
    got = {(r.work, r.n): r.pos for r in order.positions(df.select("work", "n"), ["work"], "n").collect()}
    want = {}
    for work, group in groupby(sorted(rows, key=lambda r: (r[0] or "", r[1])), key=lambda r: r[0]):
        want |= {(work, r[1]): i for i, r in enumerate(group)}
    assert got == want


def test_positions_ties_and_empty(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", 5)], "work string, n long")
    assert sorted((r.work, r.pos) for r in order.positions(df, ["work"], "n").collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    assert order.positions(df.limit(0), ["work"], "n").count() == 0
    assert sorted(r.packet for r in packets(df, "n", 2).collect()) == [0, 0, 1, 1]


def test_blocks_see_their_followers(spark):
    df = spark.range(25).select(F.col("id").alias("pos"))
    got = order.in_blocks(df, 3, size=10)
    assert {(r.pos, r.block) for r in got.where("own").collect()} == {(i, i // 10) for i in range(25)}
    assert {(r.pos, r.block) for r in got.where("not own").collect()} == {(i, i // 10 - 1) for i in (10, 11, 12, 20, 21, 22)}


def test_ranges_and_joins(spark):
    rows = rows_of(600)
    df = spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(5)
    got = {r.source: r.ranges for r in assemble.page_ranges(df.withColumnRenamed("doc_id", "n").where("source is not null"), ["source"]).collect()}
    for source in ("hot", "a"):
        pages = sorted(r[1] for r in rows if r[0] == source)
        spans = [(p, p) for p in pages]
        whole = []
        for a, b in spans:
            whole = [*whole[:-1], (whole[-1][0], b)] if whole and whole[-1][1] + 1 == a else [*whole, (a, b)]
        assert got[source] == ",".join(str(a) if a == b else f"{a}-{b}" for a, b in whole)
    kinds = screens.join_kinds(df).groupBy().agg(F.sum("n")).first()[0]
    by_source = lambda s: [r[2] for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[1])]
    assert kinds == sum(sum(t is not None for t in by_source(s)[1:]) for s in ("hot", "a", None))


def test_neighbours_over_blocks(spark, monkeypatch):
    rows = [("w", i, f"one two three w{i // 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(4)
    whole = sorted(map(tuple, align.line_set_jaccard(df, least=0.0).collect()))
    monkeypatch.setattr(order.in_blocks, "__defaults__", ("pos", 7))
    assert sorted(map(tuple, align.line_set_jaccard(df, least=0.0).collect())) == whole
    assert len(whole) == 39 + 38 + 37
