"""Further cases of the operators: levels and recall, very long texts, reopened indexes, written shards, empty tables and clashing names."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import common, exact_dedup, language_id, maxscore, mixing, ngram_join, packing, secret_scan, sharding, url_filter

D = "/root/testdata/sf0.001"
TEXT = "doc_id long, text string"
URLS = "page_id long, url string, fetched_on string"
ENTRIES = "entry_date string, pattern string, action string"


def docs_of(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


# ---------------------------------------------------------------- URL filter, secret scan


def test_url_filter_on_empty_tables_and_more_columns(spark):
    entries = spark.createDataFrame([("2024-01-01", "bad.org", "block")], ENTRIES)
    rows = spark.createDataFrame([(1, "http://bad.org/" + "x/" * 50_000, "2024-01-02", "a", 3)], URLS + ", host string, row int")
    assert [(r.page_id, r.decision) for r in url_filter.url_filter(rows, entries).collect()] == [(1, "block")]
    assert url_filter.url_filter(rows.limit(0), entries).count() == 0 and url_filter.url_filter(rows, entries.limit(0)).first().decision == "keep"


def test_battery_has_its_level(spark):
    rng = np.random.default_rng(3)
    rows = [(name, "".join(t)) for name, _, letters in secret_scan.ALPHABETS for n in (20, 25, 40, 96) for t in rng.choice(np.array(list(letters)), (2500, n))]
    got = spark.createDataFrame(rows, "name string, t string").withColumn("b", secret_scan.battery(F.col("t"))).where("b.encoding = name")
    for r in got.groupBy("name").agg(F.avg((F.col("b.p") <= 0.05).cast("double")).alias("level"), F.count("*").alias("n")).collect():
        assert r.n > 5000 and 0.04 <= r.level <= 0.06, r


def test_secret_scan_finds_planted_tokens_and_leaves_names_alone(spark):
    rng = np.random.default_rng(8)
    letters = np.array(list(secret_scan.ALPHABETS[3][2]))
    planted = ["the key " + "".join(rng.choice(letters, int(n))) + " is here" for n in rng.integers(20, 80, 400)]
    names = ["internationalization", "get_default_configuration", "MultiLoopChildWatcher", "https-everywhere-extension", "dropDuplicatesWithinWatermark", "sched_get_priority_max", "UnsupportedOperationException", "maybe-produces-warning"]
    plain = [f"see {a} and {b}" for a in names for b in names] * 4
    got = secret_scan.secret_scan(spark.createDataFrame(list(enumerate(planted + plain)), TEXT)).collect()
    hit = {r.doc_id for r in got if r.n_random}
    assert len([i for i in hit if i < 400]) >= 360 and not [i for i in hit if i >= 400]
    assert all(len(r.random_p) == r.n_random and all(0 < p <= 1 for p in r.random_p) for r in got)


def test_secret_scan_of_many_matches_and_no_rows(spark):
    text = "token=abcdefgh1 " * 6000
    rows = spark.createDataFrame([(1, text, "x", 5)], TEXT + ", spans string, base int")
    r = secret_scan.secret_scan(rows).first()
    assert r.n_assign == 6000 and r.spans.split(",")[-1] == f"assign:{5999 * 16}:{5999 * 16 + 15}"
    assert secret_scan.secret_scan(rows.limit(0)).count() == 0


# ---------------------------------------------------------------- language, packing, search


def test_words_are_letters_alone():
    w = language_id.Words(np.frombuffer("a — b…«çé»×5µm €ok 中。文 😀x ".encode(), np.uint8))
    words = [w.keys[c] for c in w.codes]
    plain = language_id.Words(np.frombuffer("a b çé µm ok 中 文 x ".encode(), np.uint8))
    assert words == [plain.keys[c] for c in plain.codes]


def test_long_texts_keep_their_chains(spark, monkeypatch):
    docs = [r.text for r in docs_of(spark).where("text is not null and lang is not null").limit(120).collect()]
    model = language_id.train([t.encode() for t in docs], ["a" if i % 2 else "b" for i in range(len(docs))])
    long = " ".join(docs)[:120_000].encode()
    whole = language_id.label_texts([long], model)
    monkeypatch.setattr(language_id, "BLOCK_BYTES", 7000)
    cut = language_id.label_texts([long], model)
    assert all(np.allclose(a, b, rtol=1e-4) for a, b in zip(whole, cut, strict=True))


def test_language_id_repeats_and_clashes(spark):
    docs = docs_of(spark).select("*", F.lit("keep").alias("score"), F.lit(0).alias("n_words"))
    got = language_id.language_id(docs.union(docs)).groupBy("doc_id").agg(F.countDistinct("lang_pred", "score").alias("k"), F.count("*").alias("n")).collect()
    assert {(r.k, r.n) for r in got} == {(1, 2)}
    kept = corpus_pipeline.keep_languages(spark, docs, D)
    assert kept.columns == docs.columns and {r.score for r in kept.select("score").distinct().collect()} == {"keep"}
    assert corpus_pipeline.keep_languages(spark, docs.limit(0), D).count() == 0


def test_language_sample_is_bounded(spark):
    rows = spark.createDataFrame([(7, "hot text of many rows", "en")] * 500 + [(i, "y" * 400, "de") for i in range(300)], "doc_id long, text string, lang string")
    for max_rows, max_bytes in ((50, 1 << 20), (1000, 4000), (10, 10)):
        got = common.drawn(rows, 800, max_rows, max_bytes).collect()
        assert 0 < len(got) <= max_rows and (sum(len(r.text) for r in got) <= max_bytes or len(got) == 1) and len(set(got)) == len(got)


def test_split_by_bitmaps_keeps_every_member(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"), "id")
    members = rows.where("id % 7 = 0").select("h")
    may, others = common.split_by(rows, "h", members)
    got = {r.id for r in may.collect()}
    assert got >= set(range(0, 20_000, 7)) and len(got) < 4000 and {r.id for r in others.collect()} == set(range(20_000)) - got
    assert common.split_by(rows, "h", members.limit(0))[0].count() == 0


def test_most_packed_documents_stay_whole():
    rng = np.random.default_rng(0)
    for length in (2048, 64):
        sizes = np.minimum(length - 1, rng.lognormal(np.log(length / 4), 0.9, 700).astype(int) + 1).tolist()
        got = packing.packed(sizes, length)
        pieces = defaultdict(list)
        for w in got:
            assert 0 < sum(n for _, _, n in w) <= length
            for i, at, n in w:
                pieces[i].append((at, n))
        assert len(got) == -(-sum(sizes) // length) and len(pieces) == len(sizes)
        for i, got_pieces in pieces.items():
            ends = np.cumsum([n for _, n in sorted(got_pieces)])
            assert [a for a, _ in sorted(got_pieces)] == [0, *ends[:-1]] and ends[-1] == sizes[i]
        assert sum(map(len, pieces.values())) < len(sizes) + 2 * len(got)
    assert packing.packed([], 2048) == [[]] or not any(packing.packed([], 2048))


def test_maxscore_repeated_queries(spark):
    rows = [(i % 60, [float(i % 7), 1.0]) for i in range(60)] + [(0, [0.0, 1.0])] * 3
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, score string, rank int")
    got = maxscore.topk(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, k) for q in (0, 50) for k in range(1, 6)]


# ---------------------------------------------------------------- dedup, shards


def digests(spark, rows):
    return exact_dedup.with_digest(spark.createDataFrame(rows, TEXT)).select("doc_id", "digest")


def test_index_reopened_with_other_settings(spark):
    name = "index_reopened"
    index = exact_dedup.DigestIndex(spark, name, 4)
    rows = [(i, f"text {i}") for i in range(50)]
    index.add(digests(spark, rows), "doc_id")
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('external.table.purge' = 'false')")
    spark.sql(f"DROP TABLE {name}")  # the files of a table at a location stay
    again = exact_dedup.DigestIndex(spark, name)
    assert again.buckets == 4
    again.add(digests(spark, [(100 + i, t) for i, t in rows]), "doc_id")
    got = again.table().collect()
    assert sorted(r.keep_id for r in got) == list(range(50)) and {r.n for r in got} == {2}
    again.drop()
    assert not spark.catalog.tableExists(name)


def test_group_size_counts_all_batches(spark):
    index = exact_dedup.DigestIndex(spark, "index_of_batches", 4)
    first = spark.createDataFrame([(1, "a"), (2, "b")], TEXT)
    later = spark.createDataFrame([(8, "a"), (9, "a"), (7, None)], TEXT)
    assert {tuple(r)[:4] for r in exact_dedup.exact_dedup(first, index=index).collect()} == {(1, 1, 1, True), (2, 2, 1, True)}
    assert {tuple(r)[:4] for r in exact_dedup.exact_dedup(later, index=index).collect()} == {(8, 1, 3, False), (9, 1, 3, False), (7, 7, 1, True)}
    index.drop()


def test_hot_groups_meet_by_broadcast(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i}") for i in range(900)], TEXT)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(rows).collect()}
    assert len(got) == 900 and all(got[i] == ((899, 600) if i % 3 else (i, 1)) for i in range(900))
    joined = ngram_join.ngram_join(rows).collect()
    assert len(joined) == 900 and {r.component_id for r in joined if r.doc_id % 3} == {1}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]


@pytest.mark.parametrize("limit", [100, 5000])
def test_written_shards_fit(spark, tmp_path, limit):
    rows = [(i, "x" * (i % 60), i) for i in range(200)] + [(5, "y" * 50, 1000 + k) for k in range(9)] + [(None, None, 2000), (6, "z" * 300, 2001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bytes int")
    sharding.write_shards(docs, str(tmp_path / "out"), limit=limit)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    sizes = back.groupBy("_shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"), F.count("*").alias("k")).collect()
    assert all(r.n <= limit or r.k == 1 for r in sizes)
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("_part", F.lit(1)), str(tmp_path / "no"))


# ---------------------------------------------------------------- mixing, pipeline


def test_mixing_matches_plain_projected_gradient():
    """The scaled steps end where plain projected gradient descent on the same objective ends after many steps."""
    rng = np.random.default_rng(5)
    p, n = rng.dirichlet([0.4, 0.1, 2.0, 0.3], 300), rng.integers(1, 400, 300).astype(float)
    share, goal, ridge = n / n.sum(), np.array([0.04, 0.01, 0.9, 0.05]), 0.05
    r = np.ones(300)
    for _ in range(20_000):
        r = np.maximum(0, r - 0.5 * (p @ ((share * r) @ p - goal) + ridge * (r - 1)))
    pull = np.linalg.solve(ridge * np.eye(4), (share * r) @ p - goal)
    assert np.allclose(r, mixing.rates_of(p, pull), atol=1e-6)  # the form that ``solve`` searches


def test_mixing_reports_its_miss(spark):
    docs, labels = docs_of(spark), spark.read.parquet(f"{D}/labels.parquet")
    got = mixing.mix(docs.withColumn("rate", F.lit("x")), labels, mixing.TARGETS).toPandas()
    p, n = np.array(got["p"].tolist()), got["n_tokens"].to_numpy()
    goal = np.array([mixing.TARGETS[k] for k in sorted(mixing.TARGETS)])
    assert np.allclose(np.abs((n * got["rate"].to_numpy()) @ p / n.sum() - goal).max(), got["miss"].iloc[0]) and got["miss"].nunique() == 1


def test_pipeline_on_hard_and_empty_documents(spark, tmp_path):
    hard = [(1, None, None, None), (2, "", "en", "s"), (3, "…—", None, "s"), (None, "the of and is in to the", "en", "s"), (4, "the of and " * 60_000, "en", "s")]
    kinds = "doc_id long, text string, lang string, source string"
    more = docs_of(spark).select("doc_id", "text", "lang", "source").union(spark.createDataFrame(hard, kinds)).withColumns({c: F.lit(c) for c in ("p", "rate", "copies", "_row", "_digest", "score", "held_out")})
    for name, docs in (("hard", more), ("empty", more.limit(0))):
        home = str(tmp_path / name)
        docs.write.parquet(f"{home}/documents.parquet")
        spark.read.parquet(f"{D}/labels.parquet").write.parquet(f"{home}/labels.parquet")
        now = spark.read.parquet(f"{home}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES[:-1]:
            now = common.staged(run(spark, now, home), stage)
            assert now.columns == docs.columns
            assert all(r[c] == c for r in now.limit(5).collect() for c in ("p", "rate", "copies", "_row", "_digest", "score", "held_out"))
        assert (corpus_pipeline.run(spark, home).count() > 0) == (name == "hard")
