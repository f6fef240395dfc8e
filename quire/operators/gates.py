"""Gates of a batch: findings over sections, texts, sources, ledgers and incidents as rows (key, problem)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.automaton import bounded, phrase_hits
from quire.functions.notes import markdown_signature, note_bodies, note_is_whole, text_paragraphs
from quire.functions.unicode import fold

# Patterns of identifiers, longest texts of fields, fields that a text needs, vocabularies.
SLUG, SLUG_PATH, KEY = r"^[a-z0-9-]+$", r"^[a-z0-9-]+(/[a-z0-9-]+)*$", r"^[a-z0-9][a-z0-9._:-]*$"
IDENTIFIERS = dict.fromkeys(("slug", "author_slug", "duplicate"), SLUG) | dict.fromkeys(("section_path", "parent_path"), SLUG_PATH) | dict.fromkeys(("section_key", "parent_key", "source_key", "author_key"), KEY)
LONGEST = {"title": 500, "original_title": 500, "canonical_locus": 500, "commented_locus": 500, "source_url": 1000, "license_url": 1000, "description": 10000}
TEXT_NEEDS = ("language", "source_key", "role", "license_code", "rights_basis")
# Types and titles of sections that only lead to other pages.
CONTENTS_TYPES = ("toc", "contents", "table_of_contents")
CONTENTS_TITLE = r"(?i)^(?:table of contents|contents|tabula (?:contentorum|materiarum)|index capitulorum)$"
INDEX_TITLE = r"(?i)^index\b"
INDEX_OF = r"(?i)\b(?:sententiarum|rerum|materiarum|locorum|verborum|nominum|copiosissimus)\b"
OWN_BASES = ("public_domain_edition", "public_domain_life_70", "own_contribution")
CATEGORIES = ("omission", "addition", "transposition", "misreading", "normalization", "structure", "translation")
VERDICTS = ("open", "corrected", "retained", "editorial-note", "withdrawn")
RUNGS = ("context", "grammar", "parallel", "witness", "ocr", "scan")
INCIDENT_KINDS = ("gate-failure", "blocked-call", "overturn", "alignment-flag", "retry", "tool-error", "human")
STAGES = ("scout", "read", "adjudicate", "expand", "assemble", "translate", "align", "preflight", "stage", "other")
STATUSES = ("open", "fixed-here", "promoted", "wontfix")
METADATA_FIELD = r"^(?:joins-next:\s*(?:hyphen|space|para)|(?:catchword|running-head):\s*\S[^;\n]*)$"
LABEL = r"(?i)\b(?:[A-Z]{0,3}SECTIO|DISP[UV]TATIO|QU?AESTIO|ARTICULUS|CAPUT|LIBER|LECTIO|TRACTATUS|LIBELLUS|PARS)\s+[IVXLCDM]+\b\.?"


def _blank(c: str | Column) -> Column:
    return F.coalesce(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("")) == ""


def _listed(rows: DataFrame, keys: Iterable[str], rules: Iterable[tuple[str, Column]]) -> DataFrame:
    """(keys, problem) for each rule that holds on a row; rules that are null don't."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules]))
    return rows.select(*keys, F.explode(found).alias("problem"))


def note_ends(texts: DataFrame, key: str = "section_key", text: str = "content") -> DataFrame:
    """(key, block, note) of notes that stop in the middle of a sentence; list items and headings are no prose. [P7]"""
    rows = texts.select(key, F.posexplode(F.filter(F.transform(F.split(text, "\n\n"), lambda b: F.trim(b)), lambda b: b != "")).alias("block", "body"))
    rows = rows.where(~F.col("body").rlike(r"^(#|[-*+] |\d+[.)] |[a-z]\) )") & F.contains("body", F.lit("^[")))
    return rows.select(key, "block", F.explode(note_bodies("body")).alias("note")).where(~note_is_whole("note"))


def identifier_problems(fields: DataFrame, patterns: dict[str, str] = IDENTIFIERS, longest: dict[str, int] = LONGEST) -> DataFrame:
    """(section_key, field, problem) of fields (section_key, field, value), at any depth of a batch: values off their pattern or too long. [P8]"""
    spark = fields.sparkSession
    rules = F.broadcast(spark.createDataFrame([(f, p, None) for f, p in patterns.items()] + [(f, None, n) for f, n in longest.items()], "field string, pattern string, longest int"))
    met = fields.join(rules, "field").withColumn("problem", F.when(F.expr("not value rlike pattern"), "pattern").when(F.length("value") > F.col("longest"), "length"))
    return met.where("problem is not null").select("section_key", "field", "problem")


def text_metadata(texts: DataFrame) -> DataFrame:
    """(section_key, problem): fields that a text lacks; a replacement of a known text needs none. Texts have the columns of TEXT_NEEDS, source_locator, op and expected_text_id. [P8]"""
    rules = [(f"missing {c}", _blank(c)) for c in TEXT_NEEDS] + [("missing source_locator", (F.col("role") == "transcription") & _blank("source_locator"))]
    rows = texts.where(~F.coalesce((F.col("op") == "put_text") & ~_blank("expected_text_id"), F.lit(False)))
    return _listed(rows, ["section_key"], rules)


def source_years(sources: DataFrame) -> DataFrame:
    """(source_key, problem): editions in the public domain without their year. [P8]"""
    return _listed(sources, ["source_key"], [("public_domain_edition without publication_year", (F.col("rights_basis") == "public_domain_edition") & F.col("publication_year").isNull())])


def quote_marks(texts: DataFrame, language: str = "en") -> DataFrame:
    """(section_key, n): guillemets in texts of a language that has none. [P9]"""
    rows = texts.where(F.col("language") == language).select("section_key", F.regexp_count("content", F.lit("[«»‹›]")).cast("long").alias("n"))
    return rows.where("n > 0")


def structure(sections: DataFrame, texts: DataFrame) -> DataFrame:
    """(section_key, problem) of sections (work, section_key, parent_key, sequence, title, section_type, import_mode) and their texts (section_key, language, content). [P10]

    same-sequence and same-label: a sibling before it (by key) has the sequence or the label; navigation: a printed contents list or an index
    of page numbers; empty: neither texts nor subsections; heading-as-text: a block that is a heading alone; two-headings: a title with two labels.
    """
    mine = ["work", "parent_key"]
    label = F.upper(F.trim(F.regexp_replace(F.regexp_extract("title", LABEL, 0), r"[^\p{L}\p{N}_]+", " ")))
    rows = sections.withColumn("_label", F.when(F.ltrim("title").rlike("^" + LABEL.replace(r"\b(?:", "(?:", 1)), label))
    nth = lambda c: F.row_number().over(W.partitionBy(*mine, c).orderBy("section_key"))
    rows = rows.withColumns({"_seq": nth("sequence"), "_lab": nth("_label")})
    filled = texts.where(~_blank("content"))
    children = sections.select("work", F.col("parent_key").alias("section_key")).where("section_key is not null").distinct().withColumn("_parent", F.lit(True))
    blocks = filled.select("section_key", F.explode(text_paragraphs("content")).alias("b"))
    heading = blocks.where(F.col("b").rlike(r"^\*\*[^*\n]+\*\*$") & F.regexp_replace("b", r"^\*+", "").rlike("^" + LABEL)).select("section_key").distinct().withColumn("_heading", F.lit(True))
    located = blocks.groupBy("section_key").agg(F.count("*").alias("_n"), F.count_if(F.col("b").rlike(r"\b\d{1,4}[.\s*]*$")).alias("_located"))
    numbers = filled.groupBy("section_key").agg(F.sum(F.regexp_count("content", F.lit(r"\b\d{1,4}\b"))).alias("_numbers"), F.sum(F.regexp_count("content", F.lit(r"\p{L}+"))).alias("_words"))
    for other in (children, heading, located, numbers):
        rows = rows.join(other, [c for c in ("work", "section_key") if c in other.columns], "left")
    kind, title = F.lower(F.coalesce("section_type", F.lit(""))), F.trim("title")
    contents = kind.isin(*CONTENTS_TYPES) | title.rlike(CONTENTS_TITLE)
    index = (kind == "index") | title.rlike(INDEX_TITLE)
    many = ((F.col("_n") >= 10) & (F.col("_located") * 2 >= F.col("_n"))) | (
        title.rlike(INDEX_OF) & (F.col("_numbers") >= 10) & (F.col("_numbers") * 100 >= F.col("_words") * 7)
    )
    return _listed(rows, ["section_key"], [
        ("same-sequence", F.col("sequence").isNotNull() & (F.col("_seq") > 1)), ("navigation", contents | (index & many)),
        ("empty", F.col("_n").isNull() & F.col("_parent").isNull() & (F.coalesce("import_mode", F.lit("")) != "update_metadata")), ("heading-as-text", F.col("_heading")),
        ("two-headings", F.regexp_count("title", F.lit(LABEL)) > 1), ("same-label", F.col("_label").isNotNull() & (F.col("_lab") > 1)),
    ])


def banned_phrases(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(section_key, language, block, phrase, reason): phrases (phrase, reason) found, in any case, in blocks of translations. [P11]

    All phrases are looked for in one pass over each block, however many a brief lists (MOST_PATTERNS at most).
    """
    blocks = texts.where("role = 'translation'").select("section_key", "language", F.posexplode(F.split("content", "\n\n")).alias("block", "b"))
    listed = bounded(phrases.select("phrase", "reason", F.lower("phrase").alias("low")).where("phrase is not null"), "phrases of a brief")
    find = phrase_hits(texts.sparkSession, [r.low for r in listed])
    named = texts.sparkSession.createDataFrame([(i, r.phrase, r.reason) for i, r in enumerate(listed)], "i int, phrase string, reason string")
    met = blocks.select("section_key", "language", "block", F.explode(find(F.lower("b"))).alias("i"))
    return met.join(F.broadcast(named), "i").select("section_key", "language", "block", "phrase", "reason")


def licences(sources: DataFrame, code: str, url: str, credit: str, exempt: str = "license_exempt") -> DataFrame:
    """(source_key, problem): sources made here that lack the licence code and its address, or the credit; those with a value in ``exempt`` and batches of corrections alone are not asked. [P12]"""
    ours = F.col("rights_basis").isin(*OWN_BASES) & _blank(exempt) & (F.coalesce("import_mode", F.lit("")) != "edit")
    wrong = (F.coalesce("license_code", F.lit("")) != code) | (F.coalesce("license_url", F.lit("")) != url)
    return _listed(sources.where(ours), ["source_key"], [("licence", wrong), ("credit", ~F.coalesce(F.col("attribution_text").contains(credit), F.lit(False)))])


def ledger_problems(rows: DataFrame) -> DataFrame:
    """(id, line, problem) of ledger rows against their schema. [P13]"""
    rows = rows.withColumn("_k", F.count("*").over(W.partitionBy("id")))
    decided, final = F.col("verdict") != "open", F.coalesce("final", F.lit(""))
    metadata = F.col("proof_target") == "page_metadata"
    return _listed(rows, ["id", "line"], [
        *[(f"missing {c}", _blank(c)) for c in ("id", "unit", "quoted", "issue")], ("duplicate id", ~_blank("id") & (F.col("_k") > 1)), ("category", ~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False))),
        ("verdict", ~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False))), ("decided without rung", decided & ~F.coalesce(F.col("rung").isin(*RUNGS), F.lit(False))),
        ("decided without evidence", decided & _blank("evidence")), ("no final", F.col("verdict").isin("corrected", "editorial-note") & _blank("final")), ("comment in final", final.rlike("<!--|-->")),
        ("proof target", ~F.coalesce("proof_target", F.lit("text")).isin("text", "page_metadata")), ("metadata note", metadata & (F.col("verdict") == "editorial-note")),
        ("metadata final", metadata & (F.col("verdict") == "corrected") & ~F.trim(final).rlike(METADATA_FIELD)),
    ])


def incident_problems(rows: DataFrame, tool: str, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, problem) of incidents against their schema; ``tool`` names the library in routing targets ``tool:module``. [P14]"""
    status = F.coalesce("status", F.lit("open"))
    route = rf"^(work-readme|house-style|agents-md|harness|skill:[\w.-]+|{tool}:[\w.]+)$"
    return _listed(rows, keys, [
        *[(f"missing {c}", _blank(F.col(c).cast("string"))) for c in ("id", "ts", "kind", "what")], ("kind", ~_blank("kind") & ~F.col("kind").isin(*INCIDENT_KINDS)), ("stage", ~F.coalesce("stage", F.lit("other")).isin(*STAGES)),
        ("status", ~status.isin(*STATUSES)), ("fix is no target", ~_blank("fix") & ~F.col("fix").rlike(route)), ("closed without why", status.isin("fixed-here", "promoted") & _blank("why")), ("promoted without fix", (status == "promoted") & _blank("fix")),
    ])


def reads_as(word: Column, form: Column) -> Column:
    """Whether a reader's word gives an edition's form: case, long s, ligatures, u and v, i and j, hyphens and stops fold, q; is que, and a marked vowel may stand for the vowel with m or n. [T23]"""
    spelled = F.regexp_replace(F.regexp_replace(F.lower(word), r"q[;ꝫ]", "que"), r"[-¬\s.,:]", "")
    from quire.operators.edition import bars_apart
    from quire.operators.expand import accents_as_bars

    parts = F.split(bars_apart(accents_as_bars(spelled)), "̄", -1)
    pattern = F.array_join(F.transform(parts, lambda c: fold(c, "plain")), "[mn]?")
    return F.rlike(fold(form, "plain"), F.concat(F.lit("^"), pattern, F.lit("$")))


def waived_misreadings(waivers: DataFrame, reads: DataFrame) -> DataFrame:
    """Waivers (form, reason) that hold: the reason quotes a blind read of the form, two readers or more of ``reads`` (form, reader, word) give it, and none gives another. [P17]"""
    quoted = F.regexp_extract("reason", r"(?i)blind read:\s*(\S+)", 1)
    rows = waivers.where(reads_as(F.regexp_replace(quoted, r"[\"'«»“”,.;)]+$|^[\"'«»“”(]+", ""), F.col("form")) & (quoted != "")).withColumn("_k", fold(F.col("form"), "plain"))
    met = rows.join(reads.select(fold(F.col("form"), "plain").alias("_k"), "reader", "word"), "_k")
    met = met.withColumn("_same", reads_as(F.col("word"), F.col("form")))
    met = met.groupBy("form", "reason").agg(F.count_distinct(F.when(F.col("_same"), F.col("reader"))).alias("agree"), F.count_if(~F.col("_same")).alias("differ"))
    return met.where("agree >= 2 and differ = 0").select("form", "reason")


def signature_mismatch(pairs: DataFrame, exceptions: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Pairs whose markup differs: the target may only have more notes, the editor's. An exception (sha256 of source, NUL, target; a note of six words) clears a pair whose emphasis alone differs. [T19]"""
    rows = pairs.withColumn("_a", markdown_signature(F.col(source))).withColumn("_b", markdown_signature(F.regexp_replace(target, r"\^\[(?:\d+\.\s*)?Editor's note:[^\]]*\]", "")))
    emphasis = ("bold", "star", "underscore")
    same = lambda names: F.array(*[F.col(f"_a.`{n}`") for n in names]) == F.array(*[F.col(f"_b.`{n}`") for n in names])
    rows = rows.withColumn("sha256", F.sha2(F.concat(F.col(source), F.lit("\0"), F.col(target)), 256)).withColumns({"_emphasis": ~same(emphasis), "_rest": ~same(("inline-note", "note-mark", "heading"))})
    cleared = exceptions.where(F.size(F.filter(F.split("note", r"\s+"), lambda w: w != "")) >= 6).select("sha256").distinct().withColumn("_ok", F.lit(True))
    rows = rows.join(cleared, "sha256", "left").where("_rest or (_emphasis and _ok is null)")
    return rows.drop("_a", "_b", "_emphasis", "_rest", "_ok")


def stale_print_notes(texts: DataFrame, latin: str = "la") -> DataFrame:
    """(section_key, language, reading, problem): translations' notes whose ``the print reads X`` no Latin note has, and notes whose reading is the print's own form. [J24]"""
    reads = F.regexp_extract_all("content", F.lit(r"(?i)Editor['’]s note:\s*the print reads\s+([^;\]]+?)\s*;"), F.lit(1))
    said = texts.select("section_key", "language", F.explode(reads).alias("reading"))
    known = said.where(F.col("language") == latin).select("reading").distinct()
    unknown = said.where(F.col("language") != latin).join(known, "reading", "left_anti").withColumn("problem", F.lit("not in the Latin notes"))
    pair = r"(?i)the print reads\s+([^;\]]+?)\s*;\s*read\s+([^\]]+)"
    both = F.arrays_zip(F.regexp_extract_all("content", F.lit(pair), F.lit(1)).alias("a"), F.regexp_extract_all("content", F.lit(pair), F.lit(2)).alias("b"))
    rows = texts.select("section_key", "language", F.explode(both).alias("x")).select("section_key", "language", F.col("x.a").alias("reading"), F.regexp_replace("x.b", r"\.\s*$", "").alias("b"))
    signs = lambda c: F.regexp_replace(F.trim(c), r"[\p{L}\p{N}_\s]", "")
    same = rows.where((fold(F.col("reading"), "plain") == fold(F.col("b"), "plain")) & (signs(F.col("reading")) == signs(F.col("b"))))
    return unknown.select("section_key", "language", "reading", "problem").unionByName(same.select("section_key", "language", "reading", F.lit("says what the print says").alias("problem")))


def union_findings(*findings: tuple[str, DataFrame]) -> DataFrame:
    """(gate, finding): findings of different shapes under their gates' names, each as JSON. [U2]"""
    rows = [df.select(F.lit(gate).alias("gate"), F.to_json(F.struct(*df.columns)).alias("finding")) for gate, df in findings]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def add_unseen(known: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """The known rows, and those of ``more`` whose key is new. [U2, W6]"""
    return known.unionByName(more.join(known.select(key), key, "left_anti").select(known.columns))
