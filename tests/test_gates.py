"""Gates and the ledger on small rows."""

from quire.operators import gates, ledger, lexicon, screens


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_notes_and_identifiers(spark):
    texts = spark.createDataFrame([("a", "One ^[whole.] two ^[cut and]\n\n# H ^[cut]\n\nb ^[λόγος]"), ("b", None)], "section_key string, content string")
    assert pairs(gates.note_ends(texts), "section_key", "block", "note") == [("a", 0, "cut and")]
    fields = spark.createDataFrame([("a", "slug", "good-one"), ("a", "slug", "Bad One"), ("b", "title", "x" * 501), ("b", "other", "Y Y")], "section_key string, field string, value string")
    assert pairs(gates.identifier_problems(fields, {"slug": gates.SLUG}), "section_key", "field", "problem") == [("a", "slug", "pattern"), ("b", "title", "length")]


def test_text_and_source_metadata(spark):
    kinds = "section_key string, language string, source_key string, role string, license_code string, rights_basis string, source_locator string, op string, expected_text_id string"
    rows = [("a", "la", "s", "transcription", "c", "r", None, None, None), ("b", "en", "s", "translation", "c", " ", None, None, None), ("c", None, None, None, None, None, None, "put_text", "9")]
    assert pairs(gates.text_metadata(spark.createDataFrame(rows, kinds)), "section_key", "problem") == [("a", "missing source_locator"), ("b", "missing rights_basis")]
    kinds = "source_key string, rights_basis string, publication_year int, license_code string, license_url string, attribution_text string, license_exempt string, import_mode string"
    rows = [("s", "public_domain_edition", None, "CC", "u", "by us", None, None), ("t", "own_contribution", 1, "MIT", "u", "x", None, None), ("u", "own_contribution", 1, None, None, None, "theirs", None), ("v", "licensed", 1, None, None, None, None, None)]
    sources = spark.createDataFrame(rows, kinds)
    assert pairs(gates.source_years(sources), "source_key") == [("s",)]
    assert pairs(gates.licences(sources, "CC", "u", "by us"), "source_key", "problem") == [("t", "credit"), ("t", "licence")]


def test_structure_and_phrases(spark):
    kinds = "work string, section_key string, parent_key string, sequence int, title string, section_type string, import_mode string"
    rows = [("w", "l1", None, 1, "Liber I", "book", None), ("w", "l2", None, 1, "LIBER I. again", "book", None), ("w", "c1", "l1", 1, "Caput II. Caput III", "chapter", None), ("w", "toc", None, 3, "Contents", "", None), ("w", "e", "l2", None, "Empty", "", None), ("w", "ix", None, 5, "Index rerum", "index", None)]
    texts = [("c1", "la", "**Quaestio IV**\n\nplain"), ("toc", "la", "x"), ("ix", "la", "\n\n".join(f"thing {i}" for i in range(12)))]
    got = gates.structure(spark.createDataFrame(rows, kinds), spark.createDataFrame(texts, "section_key string, language string, content string"))
    assert pairs(got, "section_key", "problem") == [("c1", "heading-as-text"), ("c1", "two-headings"), ("e", "empty"), ("ix", "navigation"), ("l2", "same-label"), ("l2", "same-sequence"), ("toc", "navigation")]
    texts = spark.createDataFrame([("a", "en", "translation", "one\n\nNo Inconvenience here"), ("b", "en", "note", "no inconvenience")], "section_key string, language string, role string, content string")
    phrases = spark.createDataFrame([("no inconvenience", "calque")], "phrase string, reason string")
    assert pairs(gates.banned_phrases(texts, phrases), "section_key", "block", "phrase") == [("a", 1, "no inconvenience")]
    marks = spark.createDataFrame([("a", "en", "«x» ‹"), ("b", "la", "«x»"), ("c", "en", "“x”")], "section_key string, language string, content string")
    assert pairs(gates.quote_marks(marks), "section_key", "n") == [("a", 3)]


LEDGER = "id string, line int, unit string, pg string, layer string, quoted string, issue string, category string, verdict string, rung string, evidence string, final string, proof_target string, bad string, raised_by string"


def rows_of(spark, *rows):
    names = [x.split()[0] for x in LEDGER.split(", ")]
    base = dict.fromkeys(names) | {"layer": "la", "issue": "i", "category": "misreading", "verdict": "corrected", "rung": "scan", "evidence": "e"}
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], LEDGER)


def test_ledger_schema(spark):
    rows = rows_of(spark, {"id": "1", "unit": "u", "quoted": "q", "final": "f"}, {"id": "2", "unit": "", "quoted": "q", "category": "x", "verdict": "open"}, {"id": "2", "unit": "u", "quoted": "q", "rung": "no", "evidence": " "}, {"id": "3", "unit": "u", "quoted": "q", "final": "joins-next: never", "proof_target": "page_metadata"})
    assert pairs(gates.ledger_problems(rows), "id", "problem") == [("2", "category"), ("2", "decided without evidence"), ("2", "decided without rung"), ("2", "duplicate id"), ("2", "duplicate id"), ("2", "missing unit"), ("2", "no final"), ("3", "metadata final")]
    old = spark.createDataFrame([("latin-dubious", "resolved", None), ("omission", None, "en")], "category string, verdict string, layer string")
    assert pairs(ledger.renamed(old), "category", "verdict", "layer") == [("misreading", "corrected", "la"), ("omission", "open", "en")]


def test_scope_and_proof(spark):
    layer = spark.createDataFrame([("q12-a3", "the new reading ^[4. Editor's note: the print reads old.]"), ("summa/q12-a30", "other"), ("pg-007", "exem-"), ("pg-008", "plum stands <!-- notes: x; joins-next: space -->"), ("q1", "old word stays")], "unit string, text string")
    rows = rows_of(spark, {"id": "a", "unit": "q12-a3", "quoted": "old", "final": "new reading"}, {"id": "b", "unit": "summa/q12-a3", "quoted": "new", "final": "absent"}, {"id": "c", "unit": "pg-007", "pg": "pg-007", "quoted": "exempum", "final": "exemplum"}, {"id": "d", "unit": "q99", "quoted": "x", "final": "y"}, {"id": "e", "unit": "q1", "quoted": "old", "final": "word"}, {"id": "f", "unit": "q1", "quoted": "gone", "verdict": "open"}, {"id": "g", "unit": "q1", "quoted": "word", "final": "stays", "verdict": "editorial-note"})
    assert {r.id: r.text and r.text[:5] for r in ledger.scope(rows, layer).collect()} == {"a": "the n", "b": "the n", "c": "exem-", "d": None, "e": "old w", "f": "old w", "g": "old w"}
    assert pairs(ledger.prove(rows, layer, "manifest"), "id", "problem") == [("b", "final not there"), ("d", "unit not found"), ("e", "old reading still there"), ("f", "open"), ("g", "no editor's note"), ("g", "old reading still there")]
    assert pairs(ledger.triage(rows, layer), "id") == [("f",)]
    fields = rows_of(spark, {"id": "m", "unit": "pg-008", "quoted": "para", "final": "joins-next:  space", "proof_target": "page_metadata"}, {"id": "n", "unit": "pg-008", "quoted": "x", "final": "catchword: y", "proof_target": "page_metadata"})
    assert pairs(ledger.prove_metadata(fields, layer), "id", "problem") == [("n", "final not there")]
    assert pairs(ledger.summary(rows), "what", "value", "n") == [("category", "misreading", 7), ("rung", "scan", 6), ("verdict", "corrected", 5), ("verdict", "editorial-note", 1), ("verdict", "open", 1)]
    made = ledger.fixtures(rows_of(spark, {"id": "a", "pg": "pg-1", "final": "x", "quoted": "y", "raised_by": "Preflight gate"}, {"id": "b", "bad": "z", "quoted": "y", "verdict": "retained"}, {"id": "c", "quoted": "y"}))
    assert pairs(made, "id", "kind", "correct", "late") == [("a", "reading", "x", True), ("b", "gate", "y", False)]


def test_incidents_waivers_and_notes(spark):
    kinds = "id string, ts string, kind string, what string, stage string, status string, fix string, why string"
    rows = [("1", "t", "human", "w", None, None, None, None), ("2", None, "odd", "w", "read", "promoted", "nowhere", None), ("3", "t", "retry", "w", "x", "fixed-here", None, "y")]
    assert pairs(gates.incident_problems(spark.createDataFrame(rows, kinds), "quire"), "id", "problem") == [("2", "closed without why"), ("2", "fix is no target"), ("2", "kind"), ("2", "missing ts"), ("3", "stage")]
    waivers = spark.createDataFrame([("duobus", "blind read: duobus"), ("quam", "blind read: quā, twice"), ("sed", "seems so"), ("non", "blind read: non")], "form string, reason string")
    reads = spark.createDataFrame([("duobus", "a", "duobus"), ("duobus", "b", "diobus"), ("quam", "a", "quā"), ("quam", "b", "Quam."), ("non", "a", "non"), ("non", "a", "nõ")], "form string, reader string, word string")
    assert pairs(gates.waived_misreadings(waivers, reads), "form") == [("quam",)]
    texts = spark.createDataFrame([("a", "la", "x ^[Editor's note: the print reads teſt; read test.]"), ("a", "en", "x ^[1. Editor's note: the print reads text; read test.]"), ("b", "la", "^[Editor's note: the print reads ſecunda; read secunda.]")], "section_key string, language string, content string")
    assert pairs(gates.stale_print_notes(texts), "section_key", "language", "reading") == [("a", "en", "text"), ("a", "la", "teſt"), ("b", "la", "ſecunda")]
    both = spark.createDataFrame([(1, "*a* ^[n]", "*a* ^[n] ^[2. Editor's note: x]"), (2, "*a*", "a"), (3, "# a", "a")], "k int, source string, target string")
    none = spark.createDataFrame([], "sha256 string, note string")
    got = gates.signature_mismatch(both, none)
    assert pairs(got, "k") == [(2,), (3,)]
    cleared = got.where("k = 2").selectExpr("sha256", "'the print has no emphasis here at all' as note")
    assert pairs(gates.signature_mismatch(both, cleared), "k") == [(3,)]
    assert gates.union_findings(("a", both.select("k")), ("b", texts)).count() == 6
    assert pairs(gates.add_unseen(both, both.selectExpr("k + 2 as k", "source", "target"), "k"), "k") == [(1,), (2,), (3,), (4,), (5,)]


def test_orthography_and_leftovers(spark):
    docs = spark.createDataFrame([(1, "ſic *quòd* æs & neq; Julius QVOD XIV ñu qvis <!-- ſ --> ^[Editor's note: ſic]"), (2, "ſic λόγος до"), (3, None)], "doc_id long, text string")
    got = pairs(screens.print_forms(docs, allow=("ñu",)), "category", "token", "n")
    assert got == [("abbrev-mark", "neq;", 1), ("accent", "quòd", 1), ("ampersand", "&", 1), ("caps-v", "QVOD", 1), ("consonantal-j", "Julius", 1), ("ligature", "æs", 1), ("long-s", "ſic", 2), ("qv", "qvis", 1)]
    found = {r.ch: (r.script, r.n, r.contexts) for r in screens.script_contexts(docs).collect()}
    assert found["д"] == ("Cyrillic", 1, ["ſic λόγος до"]) and found["ο" if "ο" in found else "ό"][0] == "Greek"
    texts = spark.createDataFrame([("a", "la", "⟦x⟧ est ; TODO * [?]\n*3.* y ap-]"), ("b", "fr", "est ; DE TODO GÉNERO XXXIV"), ("c", "en", None)], "section_key string, language string, content string")
    assert pairs(screens.leftovers(texts, ["section_key"]), "section_key", "label") == [("a", "italic numeral"), ("a", "note cut mid-word"), ("a", "sentinel"), ("a", "space before punctuation"), ("a", "stray asterisk"), ("a", "todo"), ("a", "uncertainty mark")]


def test_spelling_map(spark):
    rows = spark.createDataFrame([("theat", "that", False), ("there", "there", False), ("ther", "their", False), ("on$", "un", False), ("Silvius", "Sylvius", False), ("cion", "tion", True)], "form string, edition string, ending boolean")
    words = spark.createDataFrame([(w,) for w in ("Theatre", "THEAT", "therein", "thereof", "other", "thers", "on", "one", "ON", "Silvius", "SILVIUS", "silvius", "nacion", "NACION", "cion", None)], "word string")
    got = {r.word: r.new for r in lexicon.respell_words(words, rows).collect()}
    assert got == {"Theatre": "Thatre", "THEAT": "THAT", "thers": "theirs", "on": "un", "ON": "UN", "Silvius": "Sylvius", "SILVIUS": "SYLVIUS", "nacion": "nation", "NACION": "NATION"}


def test_waived_readings_cut_the_documents_once(spark):
    """Waivers and readings start from the same staged forms."""
    from quire.plans import rules

    plan = rules.readings_waived(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(text" not in plan
