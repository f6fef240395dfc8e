"""Queries over gates, the ledger and blind readings; their rows are derived from the tables so that every rule meets rows that break it and rows that don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import assemble, gates, ledger
from quire.plans.catalog import query, table
from quire.sources.shared import staged


def _one_of(values: tuple, nth: Column) -> Column:
    """The value at ``nth`` modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (nth % len(values) + 1).cast("int"))


def _sql_list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _listed(*rules: tuple[str, str]) -> str:
    """SQL of one row for each rule (name, condition) that holds."""
    cases = ", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, c in rules)
    return f"unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS problem"


def _key(doc_id: Column) -> Column:
    return F.format_string("d%010d", doc_id)


# ---------------------------------------------------------------- sections

TITLES = ("CAPUT I. de rebus", "Contents", "Index rerum", "CAPUT I. CAPUT II. de rebus", "index capitulorum", "De rebus", "CAPUT II. de rebus")


@query(f"""
WITH s AS (
  SELECT doc_id, 'w' || (doc_id // 100) AS work, doc_id // 10 AS parent, doc_id % 10 = 0 AS root, doc_id % 4 AS seq, doc_id % 7 AS k, doc_id % 11 AS m, doc_id % 9 = 0 AS stub,
         CASE WHEN doc_id % 11 < 2 THEN NULL WHEN doc_id % 11 = 3 THEN repeat('de re 12.' || chr(10) || chr(10), 12)
              WHEN doc_id % 11 = 2 THEN text WHEN doc_id % 7 = 2 THEN replace(text, ' ', ' 12 ') ELSE text END AS body
  FROM documents WHERE text IS NOT NULL AND trim(text) <> ''),
r AS (SELECT *, CASE k WHEN 0 THEN 'CAPUT I' WHEN 3 THEN 'CAPUT I' WHEN 6 THEN 'CAPUT II' END AS label,
             len(regexp_extract_all(body, '\\b\\d{{1,4}}\\b')) AS numbers, len(regexp_extract_all(body, '\\p{{L}}+')) AS words FROM s),
w AS (SELECT *, row_number() OVER (PARTITION BY work, root, CASE WHEN NOT root THEN parent END, seq ORDER BY doc_id) AS nth_seq,
             row_number() OVER (PARTITION BY work, root, CASE WHEN NOT root THEN parent END, label ORDER BY doc_id) AS nth_label,
             count(*) OVER (PARTITION BY parent) > 1 AS kids FROM r)
SELECT 'd' || lpad(doc_id::VARCHAR, 10, '0') AS section_key, {_listed(
    ("same-sequence", "nth_seq > 1"), ("navigation", "k IN (1, 4) OR (k = 2 AND (m = 3 OR (body IS NOT NULL AND numbers >= 10 AND numbers * 100 >= words * 7)))"),
    ("empty", "body IS NULL AND NOT stub AND NOT (root AND kids)"), ("heading-as-text", "m = 2"), ("two-headings", "k = 3"), ("same-label", "label IS NOT NULL AND nth_label > 1"))}
FROM w""")
def structure_rules(spark, d):
    """Documents as sections of works of a hundred, every tenth the parent of those after it; titles, contents and modes by the id, so that all six rules meet both cases. [P10]"""
    rows = table(spark, d, "documents").where("trim(text) <> ''")
    k, m = F.col("doc_id") % 7, F.col("doc_id") % 11
    sections = rows.select(
        F.concat(F.lit("w"), F.expr("doc_id div 100")).alias("work"), _key(F.col("doc_id")).alias("section_key"),
        F.when(F.col("doc_id") % 10 != 0, _key(F.expr("doc_id - doc_id % 10"))).alias("parent_key"), (F.col("doc_id") % 4).alias("sequence"), _one_of(TITLES, F.col("doc_id")).alias("title"),
        F.lit("chapter").alias("section_type"), F.when(F.col("doc_id") % 9 == 0, "update_metadata").otherwise("new").alias("import_mode"),
    )
    content = (
        F.when(m == 1, "  ").when(m == 2, F.concat(F.lit("**CAPUT I**\n\n"), "text")).when(m == 3, F.repeat(F.lit("de re 12.\n\n"), 12))
        .when(k == 2, F.replace("text", F.lit(" "), F.lit(" 12 "))).otherwise(F.col("text"))
    )
    texts = rows.where(m != 0).select(_key(F.col("doc_id")).alias("section_key"), F.lit("la").alias("language"), content.alias("content"))
    return gates.structure(sections, texts)


@query(r"""
WITH l AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM (
  SELECT doc_id, list_filter(list_transform(string_split(translate(coalesce(text, ''), '[]^\', ''), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)),
n AS (SELECT *, pos % 4 AS k, CASE WHEN pos % 4 = 0 THEN line WHEN pos % 4 = 1 THEN regexp_replace(line, '[.!?…:;*_»"''’”)]+$', '') ELSE line || ' ,' END AS note FROM l),
b AS (SELECT *, trim(regexp_replace(note, '[*_»"''’”)]+$', '')) AS bare FROM n WHERE k < 3 AND trim(note) <> '')
SELECT doc_id, pos::INTEGER AS block, note FROM b
WHERE NOT regexp_matches(line, '^(#|[-*+] |\d+[.)] |[a-z]\) )') AND bare <> '' AND NOT regexp_matches(bare, '[.!?…:;]$')
  AND NOT coalesce(unicode(nullif(regexp_extract(bare, '.*(\p{L})', 1), '')) >= 880, false)""")
def note_ends(spark, d):
    """Lines as blocks with a note of the line itself, of the line without its stop, or with a comma at its end; every fourth has none. [P7]"""
    clean = F.transform(F.split(F.translate(F.coalesce("text", F.lit("")), "[]^\\", ""), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    note = lambda x, i: F.when(i % 4 == 0, x).when(i % 4 == 1, F.regexp_replace(x, r"[.!?…:;*_»\"'’”)]+$", "")).otherwise(F.concat(x, F.lit(" ,")))
    block = lambda x, i: F.when(i % 4 == 3, x).otherwise(F.concat(x, F.lit(" ^["), note(x, i), F.lit("] x")))
    content = F.array_join(F.transform(F.filter(clean, lambda x: x != ""), block), "\n\n")
    return gates.note_ends(table(spark, d, "documents").select("doc_id", content.alias("content")), "doc_id")


@query("""
SELECT doc_id AS section_key, ((length(text) - length(replace(text, 'th', ''))) + (length(text) - length(replace(text, 'on', ''))) // 2)::BIGINT AS n FROM documents
WHERE lang = 'en' AND (contains(text, 'th') OR contains(text, 'on'))""")
def quote_gate(spark, d):
    """English texts with guillemets around each ``th`` and one in each ``on``. [P9]"""
    content = F.replace(F.replace("text", F.lit("th"), F.lit("«th»")), F.lit("on"), F.lit("o‹n"))
    return gates.quote_marks(table(spark, d, "documents").select(F.col("doc_id").alias("section_key"), F.col("lang").alias("language"), content.alias("content")))


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract(text, '\p{L}+') AS w FROM documents WHERE regexp_matches(text, '\p{L}')),
said AS (SELECT doc_id, 'la' AS language, w AS reading, CASE WHEN doc_id % 5 = 0 THEN w ELSE 'zzz' END AS better FROM w
         UNION ALL SELECT doc_id, 'en', CASE WHEN doc_id % 3 = 0 THEN w || 'q' ELSE w END, CASE WHEN doc_id % 5 = 0 THEN w ELSE 'zzz' END FROM w)
SELECT doc_id AS section_key, language, reading, 'not in the Latin notes' AS problem FROM said WHERE language = 'en' AND reading NOT IN (SELECT reading FROM said WHERE language = 'la')
UNION ALL SELECT doc_id, language, reading, 'says what the print says' FROM said WHERE reading = better""")
def print_notes(spark, d):
    """Each document's first word in a note on what the print reads, in Latin and in English; every third English note has another word, every fifth pair names one word twice. [J24]"""
    rows = table(spark, d, "documents").withColumn("w", F.regexp_extract("text", r"\p{L}+", 0)).where("w <> ''")
    better = F.when(F.col("doc_id") % 5 == 0, F.col("w")).otherwise("zzz")
    said = lambda reading: F.concat(F.lit("x ^[1. Editor's note: the print reads "), reading, F.lit("; read "), better, F.lit(".] y"))
    english = F.when(F.col("doc_id") % 3 == 0, F.concat("w", F.lit("q"))).otherwise(F.col("w"))
    sides = F.array(F.struct(F.lit("la").alias("language"), said(F.col("w")).alias("content")), F.struct(F.lit("en").alias("language"), said(english).alias("content")))
    return gates.stale_print_notes(rows.select(F.col("doc_id").alias("section_key"), F.explode(sides).alias("x")).select("section_key", "x.*"))


@query(r"""
SELECT DISTINCT form FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS form FROM documents)
WHERE regexp_matches(form, '^[a-z]{4,}$') AND length(form) % 5 <> 0 AND length(form) % 3 <> 0 AND length(form) % 7 <> 0""")
def readings_waived(spark, d):
    """Each word of four ASCII letters or more as a waived form, read blind with a bar for ``an``, in capitals with long s, and wrongly or not at all by its length; lengths also leave out the quotation. [P17, T23]"""
    forms = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("form")).where("form rlike '^[a-z]{4,}$'").distinct()
    forms = staged(forms, "forms")  # waivers and readings both start from them
    size, barred = F.length("form"), F.replace("form", F.lit("an"), F.lit("ã"))
    quoted = F.when(size % 5 == 0, "seen by eye").otherwise(F.concat(F.lit('blind read: "'), barred, F.lit('", agreed')))
    reads = F.array_compact(F.array(
        F.struct(F.lit("r1").alias("reader"), barred.alias("word")), F.when(size % 7 != 0, F.struct(F.lit("r2").alias("reader"), F.replace(F.upper("form"), F.lit("S"), F.lit("ſ")).alias("word"))),
        F.when(size % 3 == 0, F.struct(F.lit("r3").alias("reader"), F.concat("form", F.lit("x")).alias("word"))),
    ))
    readings = forms.select("form", F.explode(reads).alias("x")).select("form", "x.*")
    return gates.waived_misreadings(forms.select("form", quoted.alias("reason")), readings).select("form")


@query(r"""
SELECT 'quotes' AS gate, to_json({'section_key': doc_id, 'n': (length(text) - length(replace(text, 'th', '')))::BIGINT // 2}) AS finding FROM documents WHERE lang = 'en' AND contains(text, 'th')
UNION ALL SELECT 'blank', to_json({'doc_id': doc_id}) FROM documents WHERE doc_id % 5 < 2 OR coalesce(trim(regexp_replace(text, '\s+', '', 'g')), '') = ''""")
def findings_union(spark, d):
    """Guillemets in English texts, and documents that are blank once comments (every fifth) and dropped zones (the one after it) are gone, as one table of findings. [U2, A13]"""
    docs, k = table(spark, d, "documents"), F.col("doc_id") % 5
    quotes = gates.quote_marks(docs.select(F.col("doc_id").alias("section_key"), F.col("lang").alias("language"), F.replace("text", F.lit("th"), F.lit("t»h")).alias("content")))
    text = F.when(k == 0, F.concat(F.lit("<!-- "), "text", F.lit(" -->"))).when(k == 1, F.concat(F.lit("<<<NOTE>>>\n"), "text", F.lit("\n<<<END NOTE>>>"))).otherwise(F.col("text"))
    blank = assemble.blank_pages(docs.select("doc_id", text.alias("text")), ("NOTE",)).select("doc_id")
    return gates.union_findings(("quotes", quotes), ("blank", blank))


# ---------------------------------------------------------------- ledger and incidents

VERDICTS, RUNGS, CATEGORIES = (*gates.VERDICTS, "resolved"), (*gates.RUNGS, "guess", None), (*gates.CATEGORIES, "odd", None)
FINALS = (None, "a <!-- b", "joins-next: space", "running-head: X", "running-head: ", "word", " ", "joins-next: column", "catchword: et")
TARGETS = (None, "text", "page_metadata", "other")


@query(f"""
WITH r AS (
  SELECT event_id AS e, CASE WHEN event_id % 101 <> 0 THEN (event_id // 2 * (1 + event_id % 3))::VARCHAR END AS id, event_id % 17 = 0 AS no_unit, event_id % 19 = 0 AS no_quoted, event_id % 23 = 0 AS no_issue,
         {_sql_list(CATEGORIES)}[user_id % {len(CATEGORIES)} + 1] AS category, {_sql_list(VERDICTS)}[event_id % {len(VERDICTS)} + 1] AS verdict,
         {_sql_list(RUNGS)}[event_id % {len(RUNGS)} + 1] AS rung, event_id % 5 = 0 AS no_evidence, event_id % {len(FINALS)} AS f, {_sql_list(TARGETS)}[event_id // 8 % 4 + 1] AS target FROM events),
k AS (SELECT *, CASE WHEN id IS NOT NULL THEN count(*) OVER (PARTITION BY id) END AS k FROM r)
SELECT e AS line, {_listed(
    ("missing id", "id IS NULL"), ("missing unit", "no_unit"), ("missing quoted", "no_quoted"), ("missing issue", "no_issue"), ("duplicate id", "k > 1"),
    ("category", "category IS NULL OR category = 'odd'"), ("verdict", "verdict = 'resolved'"), ("decided without rung", "verdict <> 'open' AND (rung IS NULL OR rung = 'guess')"),
    ("decided without evidence", "verdict <> 'open' AND no_evidence"), ("no final", "verdict IN ('corrected', 'editorial-note') AND f IN (0, 6)"), ("comment in final", "f = 1"), ("proof target", "target = 'other'"),
    ("metadata note", "target = 'page_metadata' AND verdict = 'editorial-note'"), ("metadata final", "target = 'page_metadata' AND verdict = 'corrected' AND f NOT IN (2, 3, 8)"))}
FROM k""")
def ledger_rules(spark, d):
    """Events as ledger rows; each field by its own modulus of the ids, so that all fourteen rules meet rows that break them, alone and together. [P13]"""
    e, blank = F.col("event_id"), lambda n, v: F.when(F.col("event_id") % n != 0, v)
    rows = table(spark, d, "events").select(
        e.alias("line"), F.when(e % 101 != 0, F.expr("cast(event_id div 2 * (1 + event_id % 3) as string)")).alias("id"), blank(17, "u").alias("unit"), F.coalesce(blank(19, "q"), F.lit(" ")).alias("quoted"), blank(23, "i").alias("issue"),
        _one_of(CATEGORIES, F.col("user_id")).alias("category"), _one_of(VERDICTS, e).alias("verdict"), _one_of(RUNGS, e).alias("rung"), blank(5, "seen").alias("evidence"), _one_of(FINALS, e).alias("final"),
        _one_of(TARGETS, F.floor(e / 8)).alias("proof_target"),
    )
    return gates.ledger_problems(rows).select("line", "problem")


KINDS, STAGES, STATUSES = (*gates.INCIDENT_KINDS, "odd"), (*gates.STAGES, "odd"), (*gates.STATUSES, "odd")
FIXES = (None, "work-readme", "skill:page-joins", "quire:screens.seams", "skill:", "other:screens", "house-style", "a note", "")


@query(f"""
WITH r AS (
  SELECT event_id, event_id % 101 = 0 AS no_id, event_id % 103 = 0 AS no_ts, CASE WHEN event_id % 29 <> 0 THEN {_sql_list(KINDS)}[event_id % {len(KINDS)} + 1] END AS kind, event_id % 31 = 0 AS no_what,
         coalesce(CASE WHEN event_id % 37 <> 0 THEN {_sql_list(STAGES)}[event_id % {len(STAGES)} + 1] END, 'other') AS stage,
         coalesce(CASE WHEN event_id % 41 <> 0 THEN {_sql_list(STATUSES)}[user_id % {len(STATUSES)} + 1] END, 'open') AS status, event_id % {len(FIXES)} AS f, event_id % 3 = 0 AS no_why FROM events)
SELECT event_id, {_listed(
    ("missing id", "no_id"), ("missing ts", "no_ts"), ("missing kind", "kind IS NULL"), ("missing what", "no_what"), ("kind", "kind = 'odd'"), ("stage", "stage = 'odd'"), ("status", "status = 'odd'"),
    ("fix is no target", "f IN (4, 5, 7)"), ("closed without why", "status IN ('fixed-here', 'promoted') AND no_why"), ("promoted without fix", "status = 'promoted' AND f IN (0, 8)"))} FROM r""")
def incident_rules(spark, d):
    """Events as incidents; each field by its own modulus of the ids, so that every rule meets rows that break it. Ids are asked back from the line, as some are missing. [P14]"""
    e, blank = F.col("event_id"), lambda n, v: F.when(F.col("event_id") % n != 0, v)
    rows = table(spark, d, "events").select(
        blank(101, e.cast("string")).alias("id"), blank(103, F.col("ts")).alias("ts"), blank(29, _one_of(KINDS, e)).alias("kind"), blank(31, F.lit("w")).alias("what"), blank(37, _one_of(STAGES, e)).alias("stage"),
        blank(41, _one_of(STATUSES, F.col("user_id"))).alias("status"), _one_of(FIXES, e).alias("fix"), blank(3, F.lit("because")).alias("why"), e.alias("event_id"),
    )
    return gates.incident_problems(rows, "quire", keys=("event_id",))


def _ledger(spark, d) -> tuple[DataFrame, DataFrame]:
    """(rows, layer): the first word of five letters of each document is to be read with zq for its first letter. Units are named exactly, by a longer key, by their page, or by nothing that there is."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.regexp_extract("text", r"\p{L}{5,}", 0).alias("w")).where("w <> ''")
    docs = docs.withColumns({"final": F.concat(F.lit("zq"), F.substr("w", F.lit(2))), "key": F.concat(F.lit("doc-"), "doc_id"), "u": F.col("doc_id") % 5})
    unit = F.when(F.col("u") == 0, F.concat(F.lit("w/"), "key")).when(F.col("u").isin(1, 2), F.concat(F.lit("gone-"), "doc_id")).otherwise(F.col("key"))
    rows = docs.select(
        F.col("doc_id").alias("id"), unit.alias("unit"), F.when(F.col("u") == 1, F.col("key")).alias("pg"), F.col("w").alias("quoted"), "final", F.lit("la").alias("layer"),
        _one_of(("open", "corrected", "corrected", "editorial-note"), F.col("doc_id")).alias("verdict"),
    )
    base = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.replace("text", F.col("w"), F.col("final"))).otherwise(F.concat_ws(" ", "text", "final"))
    note = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit(" ^[1. Editor's note: the print reads "), "w", F.lit("; so it stands.]"))).otherwise(F.lit(""))
    return rows, docs.select(F.col("key").alias("unit"), F.concat(base, note).alias("text"))


_LEDGER = r"""
d AS (SELECT doc_id, regexp_replace(nfc_normalize(text), '\s+', ' ', 'g') AS t, regexp_extract(text, '\p{L}{5,}') AS w FROM documents WHERE regexp_matches(text, '\p{L}{5,}')),
f AS (SELECT *, 'zq' || substr(w, 2) AS final, doc_id % 5 <> 2 AS found FROM d),
b AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN t WHEN 1 THEN replace(t, w, final) ELSE t || ' ' || final END AS base, doc_id % 7 <> 0 AS noted FROM f)"""


@query(rf"""
WITH {_LEDGER},
p AS (SELECT doc_id, found, noted, doc_id % 4 AS v, contains(base, final) AS there, NOT contains(final, w) AND regexp_matches(base, '(^|[^\p{{L}}\p{{N}}_])' || w || '([^\p{{L}}\p{{N}}_]|$)') AS old FROM b)
SELECT doc_id AS id, {_listed(
    ("open", "v = 0"), ("unit not found", "v > 0 AND NOT found"), ("final not there", "v > 0 AND found AND NOT there"), ("old reading still there", "v > 0 AND found AND there AND old"),
    ("no editor''s note", "v = 3 AND found AND NOT noted"))} FROM p""")
def ledger_proof(spark, d):
    """A ledger of every document's first long word, proved against texts that have the new reading, the old one or both, with and without an editor's note. [J16, J17]"""
    return ledger.prove(*_ledger(spark, d), "edition").select("id", "problem")


@query(rf"""
WITH {_LEDGER}
SELECT doc_id AS id FROM b WHERE doc_id % 4 = 0 AND found AND NOT contains(base || CASE WHEN noted THEN w ELSE '' END, w)""")
def ledger_triage(spark, d):
    """Rows of the same ledger that are still open and whose words are nowhere in their unit. [J16]"""
    return ledger.triage(*_ledger(spark, d)).select("id")
