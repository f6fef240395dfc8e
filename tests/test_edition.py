"""Editing operators on small literal inputs."""

import unicodedata

from pyspark.sql import functions as F

from quire.functions import unicode
from quire.operators import align, edition, lexicon
from quire.operators.edition import BAR


def lex(spark, **forms):
    return spark.createDataFrame(list(forms.items()), "form string, n long")


def tokens(spark, *names):
    return spark.createDataFrame([(x,) for x in names], "token string")


def test_nasals(spark):
    words = lex(spark, tantum=100, tamtum=2, cano=3, camo=3, rana=1)
    t = tokens(spark, f"ta{BAR}tu{BAR}", f"ca{BAR}o", f"ra{BAR}a", f"xo{BAR}", "plain", None, f"a{BAR}" * 9)
    got = {r.token: (r.status, r.form) for r in edition.expand_nasals(t, words).collect()}
    assert got == {
        f"ta{BAR}tu{BAR}": ("frequency", "tantum"), f"ca{BAR}o": ("variant", None), f"ra{BAR}a": ("unique", "rana"), f"xo{BAR}": ("none", None), f"a{BAR}" * 9: ("undecided", None),
    }
    prefer = edition.expand_nasals(tokens(spark, f"ca{BAR}o"), words, lex(spark, camo=5)).first()
    assert (prefer.status, prefer.form) == ("prefer", "camo")


def test_uv_sums_spellings_before_it_chooses(spark):
    # the nasal reading with n has more together, though its single forms are not ahead by the ratio
    words = lex(spark, uinum=30, vinum=200, uimum=1, vimum=5)
    got = edition.decide_uv(tokens(spark, f"ui{BAR}um", "avus"), words)
    assert {r.token: (r.status, r.form) for r in got.collect()} == {f"ui{BAR}um": ("frequency", "vinum"), "avus": ("none", None)}
    tie = edition.decide_uv(tokens(spark, "uinum", "q\u0304uis"), lex(spark, uinum=3, vinum=4))
    assert {r.token: (r.status, r.form) for r in tie.collect()} == {"uinum": ("variant", None), "q\u0304uis": ("other-marks", None)}


def test_all_bars_are_read(spark):
    words = lex(spark, quam=50, tantum=100, non=9)
    t = tokens(spark, "quā", "quã", "Qua\u0305", "tātū", "nōn", "q̄uam", "quǡ")
    got = {r.token: (r.status, r.form) for r in edition.expand_nasals(t, words).collect()}
    assert got == {
        "quā": ("unique", "quam"), "quã": ("unique", "quam"), "Qua\u0305": ("unique", "Quam"), "tātū": ("unique", "tantum"), "nōn": ("none", None), "q̄uam": ("other-marks", None), "quǡ": ("none", None),
    } or got["quǡ"][0] in ("other-marks", "none")


def test_long_s(spark):
    words = lex(spark, sit=500, fit=30, fine=1, sine=100, ofa=500, osa=25)
    got = {(r.token, r.other, r.kind) for r in edition.long_s_doubts(words.select(F.col("form").alias("token")), words).collect()}
    assert got == {("fit", "sit", "context"), ("fine", "sine", "misread")}


def test_doubts_and_places(spark):
    docs = spark.createDataFrame([(1, "a b ⟦see?⟧, c"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in edition.doubt_sites(docs).collect()] == [(1, 2, "see", "a b", "c")]
    rows = spark.createDataFrame([(1, "x.y x.y x.y", "x.y", 5), (2, "xay", "x.y", 0), (3, "ab", "", 0), (4, None, "a", 0)], "id int, text string, probe string, near int")
    assert [r["at"] for r in edition.locate_nearest(rows).orderBy("id").collect()] == [4, None, None, None]


def test_source_order(spark):
    flow = spark.createDataFrame([(1, i, f"{c} one two three") for i, c in enumerate("abcd")], "doc_id long, pos long, line string")
    ours = spark.createDataFrame([(1, i, f"{c} one two three") for i, c in enumerate("bacxa")] + [(1, 9, "too short")], "doc_id long, pos long, line string")
    assert {(r.pos, r.kind) for r in edition.source_order(ours, flow).collect()} == {(1, "order"), (3, "absent"), (4, "repeat"), (3, "missing")}


def test_notes_run_through_a_work(spark):
    docs = spark.createDataFrame([("w", 1, "a^[q] b^[3. q] [^1]"), ("w", 9000, "^[Editor's note: c] ^[8. Editor's note: d]"), ("v", 2, "d^[12. z]"), (None, 3, None)], "source string, doc_id long, text string")
    got = {r.doc_id: (r.text, r.first, r.n) for r in edition.renumber_notes(docs).collect()}
    assert got == {1: ("a^[q] b^[1. q] [^1]", 1, 1), 9000: ("^[2. Editor's note: c] ^[3. Editor's note: d]", 2, 2), 2: ("d^[1. z]", 1, 1), 3: ("", 1, 0)}


def test_rubrics_and_quotes(spark):
    texts = ["**2.**^[4. n] Now ^[⟦M⟧⟦R⟧ On *faith*.] and ^[⟦M⟧ Hope] then ^[⟦M⟧⟦R⟧ Charity]", "plain", None, "a ^[⟦R⟧ no] b", "a ^[⟦M⟧⟦R⟧ ] b", "^[⟦M⟧⟦R⟧ alone]"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(edition.hoist_rubrics(F.col("t"))).collect()] == ["**2.**^[4. n] *On faith*.— *Charity*.— Now  and ^[⟦M⟧ Hope] then", "plain", None, None, None, None]
    quoted = ["« a «b» c »", "«x\n> «y»", "x\ny»", "", None, "«\u00a0a ‹b\u202f›\u00a0»"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(quoted)], "i int, t string").orderBy("i")
    got = [tuple(r.q) for r in df.select(edition.english_quotes("t").alias("q")).collect()]
    assert got == [("“a ‘b’ c”", None), ("“x\n> “y”", None), (None, 1), ("", None), (None, None), ("“a ‘b’”", None)]


def test_dictionary_reads_what_an_edition_may_keep(spark):
    texts = ["Sanctus <!-- notes: editor junk --> sanctus [[a|target]] ſanctus quòd æs nõ qvis ius jus Zürich", "Sanctus <!-- notes: editor junk --> sanctus [[a|target]] ſanctus quòd æs nõ qvis ius jus Zürich", "sanctus e\u0300st", None]
    got = {r.form: r.n for r in lexicon.build(spark.createDataFrame([(x,) for x in texts], "text string")).collect()}
    assert got == {"sanctus": 3, "a": 1, "ius": 1, "zürich": 1}


def test_folds(spark):
    df = spark.createDataFrame([("ſanctuſ æVJf Éſt ﬁ-yhæ",)], "t string")
    got = {k: df.select(unicode.fold(F.col("t"), k)).first()[0] for k in unicode.FOLDS}
    assert got == {
        "collate": "sanctus aevjf est ﬁ-yhae", "coverage": "sanctusvjfestfiyh", "omission": "sanctus ævjf est fi-yhæ", "old-omission": "sanctus æuis est si-yhæ", "longs": "sanctus aeuif ést ﬁ-yhae",
        "longs-key": "sanctus aeuis est ﬁ-yhae", "shared": "sanctusaeuisestsiyhae", "variant": "ſanctuſ æuif eſt ﬁiæ", "plain": "sanctusaeuifestﬁyhae", "words": "ſanctuſ æVJf Éſt ﬁ-yhæ", "letters": "ſanctuſ ævjf éſt ﬁ yhæ",
    }
    assert df.select(unicode.composed(F.lit("e\u0301a\u0323\u0302q\u0304"))).first()[0] == unicodedata.normalize("NFC", "e\u0301a\u0323\u0302q\u0304")
    counts = df.select(unicode.class_counts(F.lit("ſ æ & ⁊ ã ò ñ ü đ"))).first()[0]
    assert counts == {"long-s": 1, "ligature": 1, "ampersand": 1, "abbrev-mark": 2, "accent": 1}
    pairs = spark.createDataFrame([("ſanctuſ eſt ſpiritus", "sanctus est spiritus")], "page string, witness string")
    assert align.coverage(pairs).first().status == "ok"


def test_word_and_character_errors(spark):
    rows = [("one two three", "one too three"), ("a b", "a x b"), ("", "q"), (None, None), ("aa bb", "bb aa")]
    got = [(r.edits, r.wer, r.char_edits, r.cer) for r in align.word_errors(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a string, b string"), "a", "b").orderBy("i").collect()]
    assert got == [(1, 0.33333, 1, 0.07692), (1, 0.5, 2, 0.66667), (1, 1.0, 2, 2.0), (0, 0.0, 0, 0.0), (2, 1.0, 6, 1.2)]


def test_policy(spark):
    calls = [
        ("read", "other/a", None, None), ("write", "other/a", None, "territory"), ("read", "no/a", None, "forbidden"), ("write", "work/x.env", None, "secret"),
        ("shell", None, "cat a | tee work/b && rm -f other/c", "territory"), ("shell", None, "echo 1 >> work/gen/x", "derived"), ("write", "work/../no/a", None, "forbidden"), ("shell", None, None, None),
    ]
    df = spark.createDataFrame(calls, "tool string, path string, command string, want string")
    for r in edition.judge_calls(df, ["no"], [r"\.env$"], ["/gen/"], ["work"]).collect():
        assert (r.rule, r.allow) == (r.want, r.want is None), r


def test_collation_sites(spark):
    rows = [
        (1, "the old king sat here", "the old ring sat here", "the old king sat here"), (2, "one old king sat here", "one old sat here", "one old sat here"), (3, "aaa bbb ccc", "aaa xxx ccc", "aaa yyy ccc"),
        (4, "see page 12 now", "see page 13 now", None), (5, None, "words", ""), (6, "aaa bbb ccc", "aaa bxb ccc", None),
    ]
    df = spark.createDataFrame(rows, "k int, a string, b string, c string")
    got = [(r.k, r.kind, r.start, r.a, r.b, r.third, r.agrees) for r in align.collation_sites(df, "a", "b", "c", ["k"]).orderBy("k").collect()]
    assert got == [
        (1, "replace", 2, "king", "ring", "king", "a"), (2, "delete", 2, "king", "", "", "b"), (3, "replace", 1, "bbb", "xxx", "yyy", "neither"),
        (5, "insert", 0, "", "words", None, "unknown"), (6, "replace", 1, "bbb", "bxb", None, "unknown"),
    ]


def test_shared_errors(spark):
    site = "k int, kind string, start long, a string, b string, before string, after string"
    rows = [(1, "replace", 3, "thc", "the", "x", "y"), (2, "replace", 3, "fame", "same", "x", "y"), (3, "replace", 3, "sames", "same", "x", "y"), (4, "replace", 0, "thc", "the", "", "y"), (5, "insert", 1, "", "the", "x", "y")]
    words = lex(spark, the=900, fame=40, same=300, sames=40)
    got = {(r.k, r.own, r.other) for r in align.shared_errors(spark.createDataFrame(rows, site), words, ["k"]).collect()}
    assert got == {(1, "thc", "the"), (2, "fame", "same")}


def test_shared_errors_query(spark, tmp_path):
    """A word that only ends in ``that`` doesn't make the next one a repeat; long gaps and accents don't hide one."""
    from quire.plans.edition import shared_errors

    spark.createDataFrame([(1, "that " * 60)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    turns = [(1, "say hethat that you"), (2, "say that --------- that you"), (3, "that is"), (4, "say thât you"), (5, "so that"), (6, "we that say")]
    spark.createDataFrame(turns, "conv_id long, text string").withColumn("turn", F.lit(0)).write.parquet(str(tmp_path / "conversations.parquet"))
    assert {(r.conv_id, r.start) for r in shared_errors(spark, str(tmp_path)).collect()} == {(1, 2), (4, 1), (6, 1)}


def test_tokens_meet_forms_by_one_key(spark):
    """Only known forms meet a token, and as those that trying every spelling finds."""
    forms = ["uua", "vua", "uva", "vva", "quamuum", "quanuum", "quamvum", "tamtum", "tantum", "bb", "nun", "mum"]
    lex = spark.createDataFrame([(f, i + 1) for i, f in enumerate(forms)], "form string, n long")
    tokens = spark.createDataFrame([(t,) for t in ("uua", "vva", "qua\u0304uum", "Ta\u0304tum", "u" * 9, "nu\u0304", "mum")], "token string").withColumn("bare", F.col("token"))
    for uv in (True, False):
        tried = tokens.select("token", F.explode(edition.spellings(F.col("bare"), uv)).alias("x")).select("token", F.lower("x.form").alias("form"), F.col("x.sig" if uv else "x.form").alias("reading")).join(lex, "form")
        tried = tried if not uv else tried.where("token <> 'Ta\u0304tum'")
        want = sorted((r.token, r.form, r.reading) for r in tried.collect())
        assert want and sorted((r.token, r.form, r.reading) for r in edition._met(tokens, lex, uv).collect()) == want


def test_collation_goes_to_python_in_small_batches(spark):
    """2 MB a batch and whole strings, not 10,000 rows of words, however many rows a task has."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.createDataFrame([(1, "unum duo tres", "unum quinque tres", None), (2, None, "", "")], "k int, a string, b string, c string")
    for run in (lambda: align.collation_sites(df, "a", "b", "c", ["k"]), lambda: align.word_errors(df, "a", "b"), lambda: align.coverage(df, "a", "b")):
        spark.conf.set(key, str(1 << 30))
        out = run()
        assert int(spark.conf.get(key)) <= 2 << 20
        assert out.count()
    sites = align.collation_sites(df, "a", "b", "c", ["k"])
    assert [(r.k, r.start, r.a, r.b) for r in sites.collect()] == [(1, 1, "duo", "quinque")]
    assert "array_join" in sites._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_of_many_open_letters_are_decided(spark, tmp_path):
    """A token of nine or more bars, u or v meets the dictionary as any other; one without a reading is none, not left out."""
    import duckdb

    from quire.plans import catalog, edition as plans

    many, uv = "anbencindonfun" * 2, "subuululatuumuuuu"
    words = lex(spark, **{many: 50, many.replace("n", "m"): 2, uv: 7, uv.replace("u", "v"): 100, "i\u0307sam": 4})
    barred = many.replace("n", BAR)
    got = {r.token: (r.status, r.form) for r in edition.expand_nasals(tokens(spark, barred, barred.capitalize(), f"\u0130sa{BAR}"), words).collect()}
    assert got == {barred: ("frequency", many), barred.capitalize(): ("frequency", many.capitalize()), f"\u0130sa{BAR}": ("unique", "\u0130sam")}
    open_, none = barred.replace("f", "u"), f"a{BAR}" * 9
    known = words.union(lex(spark, **{open_.replace(BAR, "n").replace("u", "v"): 3}))
    got = {r.token: (r.status, r.form) for r in edition.decide_uv(tokens(spark, uv, open_, none), known).collect()}
    assert got == {uv: ("frequency", uv.replace("u", "v")), open_: ("unique", open_.replace(BAR, "n").replace("u", "v")), none: ("none", None)}

    d = str(tmp_path)
    texts = [(i, (many + " ") * 3 + f"{uv} usui{i}") for i in range(25)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    for run in (plans.uv_decision, plans.nasal_expansion):
        want = con.execute(catalog.ORACLE[run.__name__]).fetchall()
        assert want and sorted(map(tuple, run(spark, d).select("token", "status", "form", "n").collect())) == sorted(want)
