"""Word sites, edits at spans, and runs of outside tools."""

import pytest
from pyspark.sql import functions as F

from quire.operators import sites


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_edits(spark):
    texts = table(spark, [("a", "one two three two"), ("b", "x y"), ("c", "stays"), ("d", None)], "unit string, text string")
    decisions = table(spark, [("a", 4, 7, "two", "2", "zwei", "=b"), ("a", 4, 7, "two", "2", "zwei", "=b"), ("a", 14, 17, "two", "2", "zwei", "=ocr"), ("a", 0, 3, "one", "1", None, "=a"), ("b", 0, 1, "q", "r", None, "r"), ("c", 0, 2, "st", "", None, "ST"), ("c", 1, 3, "ta", "", None, "TA"), ("d", 0, 1, "x", "y", None, "MANUAL")], "unit string, start long, end long, a string, b string, ocr string, decision string")
    done, refused = sites.apply_edits(texts, sites.replacements(decisions))
    assert {r.unit: r.text for r in done.collect()} == {"a": "one 2 three zwei", "b": "x y", "c": "stays", "d": None}
    assert sorted((r.unit, r.problem) for r in refused.collect()) == [("b", "stale"), ("c", "overlap"), ("c", "overlap"), ("d", "manual")]
    assert sites._window("a b c a b d", 2, 3) == (0, 5) and sites._window("a a", 0, 1, 0) is None
    got = texts.where("unit = 'a'").select(sites.unique_window("text", F.lit(4), F.lit(7)).alias("w"), "text").first()
    assert got.text.count(got.text[got.w.start : got.w.end]) == 1
    phrases = table(spark, [("a", "three"), ("a", "two"), ("a", "gone"), ("a", "")], "unit string, phrase string")
    assert [(r.phrase, r["at"]) for r in sites.unique_anchors(phrases, texts).collect()] == [("three", 8)]


def test_word_sites(spark):
    rows = [(1, "the old kingdom sat in xij fields here", "the olde king dom stood in xiv here"), (2, "a b", None), (3, "ſee *this* now", "see this then now"), (4, "same", "same"), (5, None, None), (6, "praecisum aequum", "precisum equum")]
    df = table(spark, rows, "k int, a string, b string")
    got = [(r.k, r.kind, r.a, r.b) for r in sites.word_sites(df, "a", "b", ["k"]).orderBy("k", "a_at").collect()]
    assert got[:2] == [(1, "span", "old kingdom sat", "olde king dom stood"), (1, "span", "xij fields", "xiv")]
    assert ("a-block-only" in {x[1] for x in got if x[0] == 2}) and {x[1] for x in got if x[0] == 6} == {"orthography"} and not [x for x in got if x[0] in (4, 5)]
    glued = table(spark, [(1, "in primis est", "inprimis est"), (2, "one xij two", "one xiv two")], "k int, a string, b string")
    assert [(r.k, r.kind, r.a, r.b) for r in sites.word_sites(glued, "a", "b", ["k"]).orderBy("k").collect()] == [(1, "glue-b", "in primis", "inprimis"), (2, "numeral", "xij", "xiv")]
    seen = sites.witness_sites(df.where("k = 3"), "a", "b", ["k"]).collect()
    assert [(r["at"], r.page, r.witness) for r in seen] == [(2, "", "then")]
    cover = sites.cover(table(spark, [("abcd", "xabyd"), ("", "a"), (None, None)], "a string, b string"), "a", "b").collect()
    assert [r.cover for r in cover] == [75.0, 0.0, 0.0]


def test_punctuation(spark):
    texts = table(spark, [("a", "One, two. One, two."), ("b", "x")], "unit string, text string")
    rows = table(spark, [("a", "two.", "two;", "1", False), ("a", "One", "one", "*", True), ("a", "One", "Two", "*", False), ("b", "gone", "Gone", "*", True)], "unit string, find string, put string, occurrence string, case_rule boolean")
    done, stale = sites.punctuate(texts, rows)
    assert {r.unit: r.text for r in done.collect()} == {"a": "one, two; one, two.", "b": "x"}
    assert sorted((r.unit, r.put) for r in stale.collect()) == [("a", "Two"), ("b", "Gone")]


def test_outside_tools(spark):
    jobs = table(spark, [("i1", "s", "o"), ("i2", "s", "o'x y")], "image string, stem string, out string")
    keyed = sites.cache_keys(jobs, ["stem", "image", "out"])
    assert [r.key for r in keyed.orderBy("image").collect()] == [sites.cache_key({"image": i, "stem": "s", "out": o}) for i, o in (("i1", "o"), ("i2", "o'x y"))]
    cache = keyed.select("key", F.when(F.col("image") == "i1", "read").alias("result"))
    hit, miss = sites.cached(keyed, cache)
    assert [r.image for r in hit.collect()] == ["i1"] and [r.image for r in miss.collect()] == ["i2"]
    lines = {r.image: r.command for r in sites.command_lines(jobs, "run {image} > {out}").collect()}
    assert lines == {i: f"run {i} > {sites.shell_quote(o)}" for i, o in (("i1", "o"), ("i2", "o'x y"))}
    with pytest.raises(ValueError):
        sites.command_lines(jobs, "{other}")
    df = table(spark, [("Ab",), (None,)], "t string")
    assert [r.x for r in df.select(sites.edition_function("def edition(text):\n    return text.lower()")("t").alias("x")).collect()] == ["ab", None]
    with pytest.raises(ValueError):
        sites.edition_function("x = 1")
    pages = table(spark, [(i,) for i in range(4)], "page int")
    uploads = table(spark, [(0, 1, 500), (0, 2, 200), (1, 1, 429), (2, 1, 404)], "page int, ts int, status int")
    assert {r.state: r.n for r in sites.batch_state(pages, uploads, "h", "h").collect()} == {"done": 1, "waiting": 2, "failed": 1}
    with pytest.raises(ValueError):
        sites.batch_state(pages, uploads, "h", "g")
    shares = sites.start_shares(table(spark, [("s", 1, "alpha betas gamma delta x")], "section string, leaf int, text string"), table(spark, [(1, "Alpha, betas."), (2, "gamma alpha betas delta")], "leaf int, text string"))
    assert {r.leaf: r.share for r in shares.collect()} == {1: 50.0, 2: 100.0}
