"""Nested manifests of any depth, both ways."""

import json

import pytest

from quire.operators import manifest


def test_units_of_any_depth(spark):
    deep = {"section_key": "leaf", "texts": [{"language": "la", "content": "deep"}]}
    for i in range(40):
        deep = {"children": [deep, {"slug": f"s{i}"}]}
    one = {
        "sources": [{"source_key": "x", "slug": "no-texts"}],
        "works": [{"slug": "w", "sections": [
            {"section_key": "a", "slug": "b", "texts": [{"language": "la", "content": "A"}, {"language": "en", "content": "A en"}, {"language": "de"}, "loose"]},
            {"slug": "b", "texts": {"la": "B", "en": {"content": "B en"}, "de": None, "fr": 3}, "sections": [{"texts": {"la": "inherits b"}}]},
            {"id": 7, "section_type": "article", "texts": {"la": "live"}}, {"id": 8, "texts": {"la": "by id"}},
            {"op": "put_text", "section_id": 12, "language": "en", "content": "put", "children": [{"texts": {"la": "hidden"}}]}, {"op": "put_text", "section_id": 13, "texts": {"la": "no content"}}, deep,
        ]}],
    }
    two = {"works": [{"slug": "x", "sections": [{"section_key": "q1", "texts": {"la": "x1"}}]}, {"slug": "y", "sections": [{"section_key": "q1", "texts": {"la": "y1"}}]}]}
    files = [("one", json.dumps(one)), ("two", json.dumps(two)), ("broken", "{\"works\": ["), ("empty", ""), ("null", None), ("list", json.dumps([{"slug": "l", "texts": {"la": "L"}}]))]
    got = manifest.manifest_units(spark.createDataFrame(files, "path string, text string")).collect()
    assert sorted((r.path, r.unit, r.language, r.content) for r in got) == sorted([
        ("one", "a", "la", "A"), ("one", "a", "en", "A en"), ("one", "b", "la", "B"), ("one", "b", "en", "B en"), ("one", "b", "la", "inherits b"), ("one", "section-7", "la", "live"), ("one", "8", "la", "by id"),
        ("one", "section-12", "en", "put"), ("one", "w", "la", "no content"), ("one", "leaf", "la", "deep"), ("two", "x/q1", "la", "x1"), ("two", "y/q1", "la", "y1"), ("list", "l", "la", "L"),
    ])
    order = [r.content for r in sorted((r for r in got if r.path == "one"), key=lambda r: r.place)]
    assert order.index("A") < order.index("B en") < order.index("live") < order.index("put") < order.index("deep")


TREE = [("w", "l1", None, 1, "Liber I", None, None), ("w", "q1", "l1", 2, "Q1", None, None), ("w", "a1", "q1", 3, "A1", 5, 7), ("w", "a2", "q1", 4, "A2", 8, None), ("w", "q2", "l1", 5, "Q2", 9, 9), ("w", "x", None, 6, "X", None, None), ("v", "a1", None, 1, "Other", 40, 41)]
SECTIONS = "work string, key string, parent string, seq int, title string, printed_start int, printed_end int"


def test_locators_climb(spark):
    got = manifest.locators(spark.createDataFrame(TREE, SECTIONS), ["work"]).collect()
    assert {(r.work, r.key): r.locator for r in got} == {("w", "l1"): "pp. 5-9", ("w", "q1"): "pp. 5-8", ("w", "a1"): "pp. 5-7", ("w", "q2"): "p. 9", ("v", "a1"): "pp. 40-41"}
    half = [("w", "p", None, 1, "", 3, None), ("w", "c", "p", 2, "", 4, 6), ("w", "top", None, 0, "", None, None)]
    got = manifest.locators(spark.createDataFrame(half + [("w", "p2", "top", 3, "", 10, None)], SECTIONS), ["work"]).collect()
    assert {r.key: r.locator for r in got} == {"p": "pp. 4-6", "c": "pp. 4-6", "top": "p. 10"}
    assert manifest.locators(spark.createDataFrame(TREE, SECTIONS).limit(0), ["work"]).count() == 0


def test_build_and_its_findings(spark):
    sections = spark.createDataFrame(TREE, SECTIONS)
    text = lambda k, *pairs: [("w", k, lang, t) for lang, t in pairs]
    texts = text("a1", ("la", "one\n\ntwo"), ("en", "one\n \ntwo")) + text("a2", ("la", "x"), ("en", "x\n\ny")) + text("q2", ("la", "z"))
    texts = spark.createDataFrame(texts, "work string, key string, language string, content string")
    titles = spark.createDataFrame([("w", k, "en", "T") for k in ("l1", "q1", "a1", "a2")], "work string, key string, language string, title string")
    wanted = lambda *k: spark.createDataFrame([("w", x) for x in k], "work string, key string")
    out, found = manifest.build(sections, texts, titles, wanted("a1"), ["la", "en"])
    assert found.count() == 0
    got = out.first().sections
    assert [(r.key, r.parent, r.locator, [t.language for t in r.texts]) for r in got] == [("l1", None, "pp. 5-9", []), ("q1", "l1", "pp. 5-8", []), ("a1", "q1", "pp. 5-7", ["en", "la"])]
    _, found = manifest.build(sections, texts, titles, wanted("a2", "q2", "x", "nowhere", "q1"), ["la", "en"])
    assert {(r.key, r.problem) for r in found.collect()} == {
        ("a2", "en has 2 blocks, la has 1"), ("q2", "no text in en"), ("q2", "no title in en"), ("x", "no text"), ("x", "no title in en"), ("nowhere", "unknown key"),
    }


def test_loops_and_lost_parents(spark):
    rows = [("w", "a", "b"), ("w", "b", "c"), ("w", "c", "a"), ("w", "d", "gone"), ("w", "e", None)]
    sections = spark.createDataFrame(rows, "work string, key string, parent string")
    kept, found = manifest.included(sections, spark.createDataFrame([("w", "a"), ("w", "d"), ("w", "e")], "work string, key string"), ["work"])
    assert {(r.key, r.problem) for r in found.collect()} == {("a", "parents go round in a loop"), ("gone", "parent is not in the structure")}
    assert {(r.key, r.own) for r in kept.collect()} == {("a", True), ("b", False), ("c", False), ("d", True), ("e", True)}
    with pytest.raises(Exception, match="RECURSION"):
        below = sections.unionByName(spark.createDataFrame([("w", "x", "a")], sections.schema))
        manifest.locators(below.selectExpr("*", "if(key = 'x', 1, null) as printed_start", "cast(null as int) as printed_end"), ["work"]).collect()


def test_units_are_walked_without_a_shuffle(spark):
    files = spark.createDataFrame([("one", '{"works": [{"slug": "w", "texts": {"la": "A"}}, {"slug": "v"}]}')], "path string, text string")
    got = manifest.manifest_units(files)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.unit, r.content) for r in got.collect()] == [("w/w", "A")]


def test_units_are_walked_in_one_pass_however_deep(spark):
    """Each manifest is read and walked once, not once for each level of brackets; numbers stay numbers, whatever their size."""
    deep = '{"slug": "x", "texts": {"la": "D"}}'
    for _ in range(150):
        deep = f'{{"children": [{deep}]}}'
    numbers = '{"id": 1e3, "texts": {"la": 1E400, "en": "Infinity", "de": 12}, "a": {"id": 100.0, "texts": [{"language": -0, "content": "A"}, {"content": -1E999}]}, "op": "put_text", "section_id": 1E400, "content": null}'
    files = spark.createDataFrame([("deep", deep), ("numbers", numbers)], "path string, text string")
    got = manifest.manifest_units(files)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [("deep", "x", "la", "D", "/".join(["children/000000000"] * 150) + "/000000000"), ("numbers", "100", "0", "A", "a/000000000"), ("numbers", "1000.0", "en", "Infinity", "/000000001")]
