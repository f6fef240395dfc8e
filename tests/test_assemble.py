"""Page joins, sections and readers on small inputs."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions.notes import by_text
from quire.operators import assemble
from quire.sources import corpus, editions


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_join_kinds(spark):
    rows = [("exem-", "plum", "hyphen"), ("exem-^[1. n [x]]", "plum", "hyphen"), ("ends.", "Next", "para"), ("no stop", "Next", "space"), ("ends.", "lower", "space"), ("x", "# H", "para"), ("x", "**Bold", "para"), ("x", "**bold", "space"), ("x", "a) list", "para"), ("of S.", "Thomas", "space"), ("says:", "Next", "para"), ("", "x", "para"), ("x", None, "para"), ("ends.^[n]", "Next", "para")]
    got = table(spark, [(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, want string").select("want", assemble.join_kind(F.col("a"), F.col("b")).alias("got"), "a", "b").collect()
    assert [(r.a, r.b, r.got) for r in got if r.got != r.want] == []


def test_pages_join_and_notes_wait(spark):
    pages = [
        ("w", 1, "One para.\n\nA sentence runs *exem-*\n\n^[1. a foot note.]"), ("w", 2, "*plum* on here.\n\nNew para ^[2. cut ⟦NOTE-CONTINUES⟧] and"), ("w", 3, "more words words\n\n⟦CONTINUED-NOTE⟧ to its end.]"), ("w", 4, "words, then Done."), ("v", 1, None),
    ]
    joined = assemble.join_pages(table(spark, pages, "work string, n int, body string"), drop_repeats=True)
    got = {r.work: r.text for r in assemble.joined_text(joined, ["work"]).collect()}
    assert got["w"] == "One para.\n\nA sentence runs *exemplum* on here.\n\n^[1. a foot note.]\n\nNew para ^[2. cut to its end.] and more words words , then Done."
    assert got["v"] == ""
    given = table(spark, [("w", 4, "para", "seen on the scan"), ("w", 3, "para", " ")], "work string, n int, join string, evidence string")
    kinds = {r.n: r.kind for r in assemble.join_pages(table(spark, pages, "work string, n int, body string"), given).where("work = 'w'").collect()}
    assert kinds == {1: None, 2: "hyphen", 3: "space", 4: "para"}
    assert assemble.page_ranges(table(spark, [("w", i) for i in (1, 2, 3, 7, 9, 10)], "work string, n int"), ["work"]).first().ranges == "1-3,7,9-10"
    cut = assemble.seam_fragments(table(spark, [("w", 1, "a simi- <!-- joins-next: hyphen -->"), ("w", 2, "*liter* b"), ("w", 3, "c")], "work string, n int, text string")).collect()
    assert {(r.n, r.fragment, r.whole) for r in cut} == {(1, "simi", "similiter"), (2, "liter", "similiter")}


def test_zones(spark):
    rows = [(1, "The text runs\n<<<GLOSS>>>\nnot ours\nKEEP me\n<<<END gloss>>>\non here."), (2, "a\n<<<GLOSS>>>\nb"), (3, "a.\n<<<END GLOSS>>>\nb"), (4, None), (5, "plain")]
    got = {r.k: (r.kept, r.dropped, r.problems) for r in assemble.drop_zones(table(spark, rows, "k int, text string"), ("GLOSS",), ("^KEEP",)).collect()}
    assert got[1] == ("The text runs KEEP me\non here.", 1, [])
    assert got[2][2] == ["never closed: GLOSS"] and got[3][2] == ["line 2: close GLOSS"] and got[4][0] is None and got[5] == ("plain", 0, [])
    blank = assemble.blank_pages(table(spark, [(1, " <!-- x -->\n"), (2, "y"), (3, None), (4, "<<<GLOSS>>>\nz\n<<<END GLOSS>>>")], "k int, text string"), ("GLOSS",))
    assert sorted(r.k for r in blank.collect()) == [1, 3, 4]


def test_sections(spark):
    text = "preface\n# Liber I\n\n**Caput I.** body one\n\nmore\n**Caput II.**\n**On things**\nbody two\n# Liber II\nonly child text"
    entries = [{"key": "pre", "type": "none"}, {"key": "l1", "type": "book"}, {"key": "c1", "type": "chapter", "parent": "l1"}, {"key": "c2", "type": "chapter", "parent": "l1"}, {"key": "l2", "type": "book"}, {"key": "c3", "type": "chapter", "parent": "l2"}]
    options = {"pre": "pre", "first_child": {"book": "chapter"}, "title_line": True}
    headings = {"book": r"# Liber", "chapter": r"\*\*Caput"}
    got, errors = assemble.split_sections(text, entries, headings, **options)
    assert errors == [] and got == {"pre": "preface", "c1": "body one\n\nmore", "c2": "body two", "c3": "only child text"}
    assert assemble.split_sections(text, entries[:3], headings)[1][0] == "text before the first heading"
    rows = assemble.section_rows(table(spark, [("w", text), ("x", "**Caput I.** a\n# Liber I\nb")], "work string, text string"), entries, headings, **options).collect()
    assert [(r.section, r.body) for r in rows if r.work == "w"] == list(got.items()) and any(r.error for r in rows if r.work == "x")


def test_pieces_and_margins(spark):
    pieces = table(spark, [("a", 2, "liter goes. "), ("a", 1, "one simi-⟨CONT⟩"), ("b", 1, "x *it⟨CONT⟩"), ("b", 3, "y"), ("c", 1, "see *this*⟨CONT⟩"), ("c", 2, "*and that*")], "k string, part int, text string")
    got = {r.k: (r.text, r.missing) for r in assemble.join_pieces(pieces, "k").collect()}
    assert got == {"a": ("one similiter goes.", False), "b": ("x *it y", True), "c": ("see *this and that*", False)}
    texts = {"a[*7] b[*3]\n*3 three\n*7 seven": "a[*1] b[*2]\n*2 three\n*1 seven", "a[*1] b[*1]\n*1 x\n*1 y": "a[*1] b[*2]\n*1 x\n*2 y", "a[*2] b[*9]\n*2 x": "a[*2] b[*9]\n*2 x"}
    df = table(spark, [(k,) for k in texts], "t string")
    assert {r.t: r.x for r in df.select("t", assemble.margins_in_order("t").alias("x")).collect()} == texts


def test_corpus_reader(spark, tmp_path):
    (tmp_path / "a.md").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    (tmp_path / "skip.md").write_text("no")
    (tmp_path / "bad.json").write_text("{")
    sections = [{"section_key": "s1", "texts": [{"language": "la", "content": "x"}, {"language": "en", "content": "y"}], "children": [{"slug": "s2", "texts": {"la": {"content": "z"}}}]}, {"section_key": "s1", "texts": [{"language": "la", "content": "w"}]}, {"section_type": "c", "id": 5, "texts": {"la": "live"}}]
    (tmp_path / "m.json").write_text(json.dumps({"works": [{"slug": "w", "sections": sections}]}))
    got = corpus.read_corpus(spark, [f"{tmp_path}/*.md", f"{tmp_path}/*.*"], exclude=("skip*",)).collect()
    assert sorted((r.unit, r.text) for r in got) == [("a", "one"), ("b", "two"), ("s1", "x\n\nw"), ("s2", "z"), ("section-5", "live")]


def test_rows_and_tables(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "b"}\n')
    rows = corpus.read_rows(spark, str(tmp_path / "l.jsonl"), "id string, n int")
    assert sorted(map(tuple, rows.collect())) == [("a", 1, 1), ("b", None, 3)]
    assert corpus.read_rows(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0
    corpus.write_rows(rows.withColumn("_from", F.lit("x")), str(tmp_path / "out"))
    assert set(spark.read.json(str(tmp_path / "out")).columns) == {"id", "n", "line"}
    good = tmp_path / "map.tsv"
    good.write_text("form\tedition\treason\n# note\nfoo$\tbar\twhy\nab\tcd\tx\n")
    assert [r.form for r in corpus.read_table(spark, str(good), ["form", "edition", "reason"], corpus.spelling_rules(), ("form",)).orderBy("line").collect()] == ["foo$", "ab"]
    good.write_text("form\tedition\treason\nfoo\tb4r\twhy\nfoo\tbar\n")
    with pytest.raises(corpus.TableRefused, match="line 2: edition; line 3: (reason|too few columns|repeated)"):
        corpus.read_table(spark, str(good), ["form", "edition", "reason"], corpus.spelling_rules(), ("form",))


def test_witness_maps_and_boxes(spark):
    maps = table(spark, [(json.dumps({"pg-1": "one", "p2.md": {"left": "l", "right": "r"}, "3": {"text": "t"}}),)], "text string")
    pages = table(spark, [("1",), ("2",), ("3",), ("4",)], "page string")
    assert {r.page: r.witness for r in corpus.page_witness(pages, corpus.witness_pages(maps)).collect()} == {"1": "one", "2": "l r", "3": "t", "4": None}
    word = '<word xMin="{}" yMin="{}" xMax="{}" yMax="{}">{}</word>'
    page = "<page><line>" + word.format(1, 2, 3, 4, "a&amp;b") + word.format(5, 2, 6, 4, "simi-") + "</line><line>" + word.format(1, 5, 2, 6, "liter") + word.format(3, 5, 4, 6, "end") + "</line>"
    boxes = table(spark, [("x", page)], "k string, t string").select("k", F.explode(corpus.word_boxes("t")).alias("b")).select("k", "b.*")
    assert [(r.word, r.x0, r.y0) for r in boxes.collect()] == [("a&b", 1.0, 2.0), ("similiter", 5.0, 2.0), ("end", 3.0, 5.0)]
    box = corpus.crop_box(boxes, ["k"]).first()
    assert (box.x0, box.y0, box.x1, box.y1) == (-5.0, -4.0, 12.0, 12.0) and corpus.crop_box(boxes, ["k"], tallest=1).count() == 0
    assert [r.packet for r in corpus.packets(table(spark, [(i,) for i in range(5)], "i int"), "i", 2).orderBy("i").collect()] == [0, 0, 1, 1, 2]


def test_docx_html_records(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t, i="": f"<w:r><w:rPr>{i}</w:rPr><w:t>{t}</w:t></w:r>"
    body = f"<w:document {ns}><w:body><w:p>{run('Hel', '<w:i/>')}{run('lo wor')}{run('ld', '<w:i/>')}<w:r><w:noBreakHyphen/></w:r></w:p><w:p/></w:body></w:document>"
    notes = f'<w:footnotes {ns}><w:footnote w:id="0"><w:p>{run("sep")}</w:p></w:footnote><w:footnote w:id="1"><w:p>{run("a note")}</w:p></w:footnote></w:footnotes>'
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/footnotes.xml", notes)
    got = [(r.kind, r.text, r.italic) for r in corpus.read_docx(spark, str(tmp_path / "x.docx")).orderBy("pos").collect()]
    assert got == [("body", "Hello world-", [True, False]), ("note", "a note", [False, False])]
    page = "<html><head><p>no</p></head><body><!-- <p>c</p> --><p><a href=x>link</a></p><p>One &lt;b&gt;<br>two</p><p>[1] note</p><div id='sdfootnote1'><p>foot</p></div></body></html>"
    df = table(spark, [(1, bytearray(page.encode())), (2, bytearray("<p>caf\xe9</p>".encode("latin1"))), (3, None)], "k int, h binary")
    assert {r.k: [(x.kind, x.text) for x in r.b or []] for r in df.select("k", corpus.html_blocks("h").alias("b")).collect()} == {1: [("body", "One <b> two"), ("note", "[1] note"), ("note", "foot")], 2: [("body", "café")], 3: []}
    records = corpus.cut_records(table(spark, [("f", "intro\n§1 Anno 1200. body a\n§2 Anno 1300. body b")], "path string, text string"), r"§(\d+) Anno (\d+)\.", ["id", "year"])
    assert [(r.pos, r.id, r.year, r.body) for r in records.collect()] == [(0, "1", "1200", "body a"), (1, "2", "1300", "body b")]
    assert corpus.source_flow(table(spark, [("f", "a\n\n b \n")], "path string, text string")).count() == 2
    assert table(spark, [("<p>a&nbsp;b</p> &copy;",)], "t string").select(corpus.witness_text(F.col("t"))).first()[0] == "a b ©"


def test_trailing_notes_of_any_depth(spark):
    rows = [("word-^[a [b [c [d [e]]]]] ^[2] ", "word-", "^[a [b [c [d [e]]]]] ^[2]"), ("no note]", "no note]", ""), ("x [^[y]]", "x [^[y]]", ""), ("^[alone]", "", "^[alone]"), ("text", "text", ""), ("", "", ""), (None, "", ""), ("a ^[b] c", "a ^[b] c", ""), ("a b]] ^[n]", "a b]]", "^[n]"), ("a [b]", "a [b]", "")]
    got = table(spark, rows, "t string, body string, notes string").select("*", assemble.trailing_notes(F.col("t")).alias("x")).collect()
    assert [(r.x.body, r.x.notes) for r in got] == [(r.body, r.notes) for r in got]


def test_notes_behind_a_hyphen_follow_the_word(spark):
    pages = [("w", 1, "A *sen-*^[1. x [y [z]]]^[2. b]"), ("w", 2, "*tence* and ca"), ("w", 3, "put."), ("w", 4, "**A un**"), ("w", 5, "**it** there")]
    given = table(spark, [("w", 3, "hyphen", "seen"), ("w", 5, "hyphen", "seen")], "work string, n int, join string, evidence string")
    joined = assemble.join_pages(table(spark, pages, "work string, n int, body string"), given)
    assert assemble.joined_text(joined, ["work"]).first().text == "A *sentence^[1. x [y [z]]]^[2. b]* and caput.\n\n**A unit** there"


def test_join_decisions_are_bound_to_both_pages(spark):
    pages = [("w", i, b, f"h{i}", d) for i, b, d in ((1, "ends ca", None), (2, "put goes on-", "hyphen"), (3, "ly", None), (4, "a", "para"), (5, "b", None), (6, "c", None), (7, "d", None), (8, "e-", None), (9, "f", "space"), (10, "Last.", None))]
    df = table(spark, pages, "work string, n int, body string, sha256 string, declared string")
    rows = [
        ("w", 2, "hyphen", False, "h1", "h2", "catchword"), ("w", 3, "hyphen", False, "h2", "h3", "x"), ("w", 4, "space", None, "h3", "stale", "x"), ("w", 5, "space", None, "h4", "h5", "x"), ("w", 6, "space", None, "h5", "h6", " "), ("w", 7, "glue", None, "h6", "h7", "x"),
        ("w", 8, "hyphen", None, "h7", "h8", "x"), ("w", 9, "para", True, "h8", "h9", "x"), ("w", 99, "para", None, "h98", "h99", "x"),
    ]
    decisions = table(spark, rows, "work string, n int, join string, printed_hyphen boolean, left_sha256 string, right_sha256 string, evidence string")
    good, problems = assemble.bound_joins(df, decisions)
    assert {(r.n, r["join"]) for r in good.collect()} == {(2, "hyphen")}
    assert {r.n: r.problem for r in problems.collect()} == {
        3: "a hyphen is printed", 4: "stale page hash", 5: "against the page's declaration", 6: "no evidence", 7: "invalid join", 8: "no printed hyphen", 9: "printed_hyphen without a hyphen join", 99: "unknown boundary",
    }
    none = decisions.limit(0)
    assert [(r.n, r.problem) for r in assemble.bound_joins(df, none)[1].orderBy("n").collect()] == [(5, "declared otherwise: decide")]


def test_only_pages_before_a_hyphen_go_to_python(spark, monkeypatch):
    """Of a hundred pages and ten decisions one asks for its page's end: one text is walked, once, in batches of 2 MB."""
    seen, foot = spark.sparkContext.accumulator(0), assemble._foot

    def counted(text):
        seen.add(1)
        return dict(zip(("main", "notes"), foot(text), strict=True))

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(1 << 30))
    monkeypatch.setattr(assemble, "foot_notes", by_text(counted, "struct<main:string,notes:string>"))
    df = table(spark, [("w", i, f"page {i}-", f"h{i}") for i in range(100)], "work string, n int, body string, sha256 string")
    rows = [("w", i, "hyphen" if i == 30 else "space", None, f"h{i - 1}", f"h{i}", "seen") for i in range(10, 110, 10)]
    good, problems = assemble.bound_joins(df, table(spark, rows, "work string, n int, join string, printed_hyphen boolean, left_sha256 string, right_sha256 string, evidence string"))
    assert sorted(r.n for r in good.collect()) == list(range(10, 100, 10))
    assert [(r.n, r.problem) for r in problems.collect()] == [(100, "unknown boundary")]
    assert seen.value == 1 and int(spark.conf.get(key)) <= 2 << 20


def test_published_sections(spark):
    rows = [("w", 1, "a", "^[⟦M⟧⟦R⟧ On *things*.] **1.** Text ^[⟦M⟧ a marginal] here^[9. note].\n\nMore ^[Editor's note: x]."), ("w", 2, "b", "Next ^[4. y] ⟦M⟧ <!-- z -->"), ("w", 3, "c", " \n"), ("w", 4, "d", "open ^[ note"), ("v", 1, "e", "Fine ^[3. n].")]
    out, found = assemble.published_sections(table(spark, rows, "work string, n int, key string, body string"))
    got = {r.key: r.body for r in out.collect()}
    assert got["a"] == "**1.** *On things*.— Text ^[a marginal] here^[1. note].\n\nMore ^[2. Editor's note: x]." and got["e"] == "Fine ^[1. n]." and got["b"].startswith("Next ^[3. y]")
    assert {(r.key, r.problem) for r in found.collect()} == {("b", "sentinel"), ("b", "comment"), ("c", "empty"), ("d", "unclosed note")}


# ---------------------------------------------------------------- lines, records, editions


def test_lines_keep_their_numbers_over_byte_ranges(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = [json.dumps({"id": i, "t": "é" * (i % 90)}, ensure_ascii=False) if i % 7 else "" for i in range(1, 5001)]
    (tmp_path / "a.jsonl").write_bytes("\r\n".join(rows).encode())
    (tmp_path / "b.jsonl").write_text("\n" + rows[0] + "\n\n")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        got = corpus.read_rows(spark, str(tmp_path / "*.jsonl"), "id long, t string")
        assert got.rdd.getNumPartitions() > 10
        kept = got.collect()
        assert sorted((r.line, r.id) for r in kept if len(r.t or "") or r.id % 90 == 0) == sorted([(i, i) for i in range(1, 5001) if i % 7] + [(2, 1)])
        plain = corpus.read_rows(spark, str(tmp_path / "*.jsonl"), "id long, t string", numbered=False)
        assert plain.columns == ["id", "t"] and plain.where("id > 4990").count() == 8
        assert "PushedFilters: [IsNotNull(id), GreaterThan(id,4990)]" in plain.where("id > 4990")._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert corpus.read_rows(spark, str(tmp_path / "none.jsonl"), "id long").columns == ["id", "line"]
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{"id": \n')
    for numbered in (True, False):
        with pytest.raises(Exception, match="MALFORMED"):
            corpus.read_rows(spark, str(tmp_path / "bad.jsonl"), "id long", numbered=numbered).collect()


def test_edition_chapters(spark):
    head = lambda i, cap, kind, lib=1: f"[{i}] Super Sent., lib. {lib} cap. {cap} {kind}. "
    files = [
        ("f1", "junk " + head(1, "1", "tit") + "On <b>one</b>" + head(2, "1", "n") + "text&nbsp;a" + head(3, "2-3", "tit") + "Two and three" + head(4, "2-3", "n") + "b" + head(5, "2-3", "n") + "c" + head(6, "4", "n") + "d" + head(7, "4", "n") + "e © 2019 all" + head(8, "9", "n") + "© 2019 rights"),
        ("f2", head(9, "4", "n") + "lost" + head(10, "4", "tit") + "Four, later" + head(11, "4", "n") + "f" + head(12, "5-6", "n", 2) + "g"), ("f3", ""), ("f4", None),
    ]
    got = corpus.edition_chapters(table(spark, files, "path string, text string")).collect()
    assert {(r.liber, r.cap, r.low, r.high, r.title, r.text) for r in got} == {
        (1, 1, 1, 1, "On one", "text a"), (1, 2, 2, 3, "Two and three", "b c"), (1, 3, 2, 3, "Two and three", "b c"), (1, 4, 4, 4, "", "d e f"), (2, 5, 5, 6, "", "g"), (2, 6, 5, 6, "", "g"),
    }


def test_an_edition_is_published_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    store = editions.EditionStore(spark, str(tmp_path / "edition"))
    sections = lambda *x: table(spark, list(x), "key string, body string")
    pages, none, bad = table(spark, [("p1", "h1")], "name string, sha256 string"), table(spark, [], "key string, problem string"), table(spark, [("a", "empty")], "key string, problem string")
    one, two = sections(("a", " One two \n"), ("b", "three")), sections(("a", "other"), ("c", "new"))
    with pytest.raises(editions.PublishRefused, match="a empty"):
        store.publish(one, pages, bad)
    with pytest.raises(editions.PublishRefused, match="2 sections"):
        store.publish(one.union(one.limit(1)), pages, none)
    assert store.current() is None and not (tmp_path / "edition").exists()
    first = store.publish(one, pages, none, ["joined"], {"zones": "x"})
    assert store.current() == first and {(r.key, r.words) for r in store.record().collect()} == {("a", 2), ("b", 1)} and store.check().count() == 0
    replace = editions.EditionStore._replace
    for dies_at in ("EDITION.json", editions.CURRENT):
        def die(self, name, content, at=dies_at):
            if name.endswith(at):
                raise OSError("the writer dies")
            replace(self, name, content)

        monkeypatch.setattr(editions.EditionStore, "_replace", die)
        with pytest.raises(OSError):
            store.publish(two, pages, none)
        assert store.current() == first and {r.key for r in store.sections().collect()} == {"a", "b"}
    monkeypatch.setattr(editions.EditionStore, "_replace", replace)
    second = store.publish(two, pages, none)
    assert store.current() == second != first and store.publish(two, pages, none) == second
    assert store.publish(one, pages, none, options={"zones": "x"}) == first and store.clean() == [second]
    assert {r.key for r in store.sections().collect()} == {"a", "b"}
    table(spark, [("a", "tampered"), ("z", "more")], "key string, body string").write.mode("overwrite").parquet(str(tmp_path / f"edition/versions/{first}/sections"))
    assert {(r.key, r.problem) for r in editions.EditionStore(spark, str(tmp_path / "edition")).check().collect()} == {("a", "changed"), ("b", "lost"), ("z", "added")}


def test_batches_go_out_under_their_own_report(spark):
    batch = table(spark, [("m1", "x"), ("m2", "y"), ("m3", "z"), ("m4", "w")], "manifest string, content string")
    sha = {k: hashlib.sha256(k.encode()).hexdigest() for k in "xz"}
    reports = table(spark, [("m1", sha["x"], "g", True), ("m2", sha["x"], "g", True), ("m3", sha["z"], "g", True), ("m3", sha["z"], "h", False)], "manifest string, sha256 string, gate string, passed boolean")
    assert {(r.manifest, r.problem) for r in editions.refusals(batch, reports).collect()} == {("m2", "report on another manifest"), ("m3", "a gate failed"), ("m4", "no report")}
    pages = table(spark, [("b1", 1, "h1"), ("b1", 2, "h2"), ("b2", 1, "h3")], "batch string, page int, sha256 string")
    uploads = table(spark, [("b1", 1, 200, 1), ("b1", 2, 503, 1), ("b1", 2, 201, 2), ("b2", 1, 429, 1)], "batch string, page int, status int, ts int")
    assert {(r.batch, r.page, r.sha256) for r in editions.recorded_pages(pages, uploads).collect()} == {("b1", 1, "h1"), ("b1", 2, "h2"), ("b2", 1, None)}


def test_books_pass_in_batches(spark):
    """A batch holds many books: none has a Python call of its own, and records are cut once."""
    files = [(f"w{i}", "1", f"[1] S A, lib. 1 cap. 1 tit. t{i} [2] S A, lib. 1 cap. 2-3 n. a [3] S A, lib. 1 cap. 2 n. b") for i in range(30)]
    got = corpus.edition_chapters(table(spark, files, "w string, path string, text string"), work="w")
    assert sorted((r.work, r.cap, r.title, r.text) for r in got.collect()) == sorted(x for i in range(30) for x in ((f"w{i}", 1, f"t{i}", ""), (f"w{i}", 2, "", "a b"), (f"w{i}", 3, "", "a b")))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "regexp_extract_all" not in plan
