"""Queries over the driver's tables; ``oracle`` holds the same in DuckDB SQL, written independently of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import ACCENTED, PLAIN, case_class, recase, tokens
from quire.operators import align, lexicon, records, screens
from quire.sources.pages import html_paragraphs
from quire.sources.shared import new_folder
from quire.streaming.incidents import incidents, run_available, run_lifecycle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# Pieces of SQL used below.
TOK = r"regexp_extract_all(lower({0}), '\p{{L}}+')"
#: What the dictionary reads of a text, and the forms it leaves out.
SAID = r"regexp_extract_all(nfc_normalize(regexp_replace(regexp_replace(text, '<!--.*?-->', ' ', 'gs'), '\|[^\]|]*\]\]', ']]', 'g')), '\p{L}+')"
PRINT = f"regexp_matches(form, '{lexicon.PRINT_FORM}')"
LEX = f"lex AS (SELECT lower(form) AS form, count(*) AS n FROM (SELECT unnest({SAID}) AS form FROM (SELECT DISTINCT text FROM documents)) WHERE NOT {PRINT} GROUP BY 1)"
LINES = r"lines AS (SELECT doc_id, source, lang, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM (SELECT doc_id, source, lang, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents))"
LOW = r"(regexp_extract({0}, '\p{{L}}') <> '' AND regexp_extract({0}, '\p{{L}}') = lower(regexp_extract({0}, '\p{{L}}')) AND regexp_extract({0}, '\p{{L}}') <> upper(regexp_extract({0}, '\p{{L}}')) AND NOT regexp_matches({0}, '^(#|[-*+] |\||[0-9]+[.)] |[a-z]\) )'))"
OPEN = r"(NOT regexp_matches({0}, '[.!?…:][\"''»”’)\]*_]*$'))"
SEAM = f"{LINES}, lp AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM lines), seam AS (SELECT doc_id, pos, line, 'lower-start' AS kind FROM lp WHERE {LOW.format('line')} UNION ALL SELECT doc_id, pos, line, 'pair-seam' FROM lp WHERE NOT {LOW.format('line')} AND nxt IS NOT NULL AND {OPEN.format('line')} AND {LOW.format('nxt')} UNION ALL SELECT doc_id, pos, line, 'tail-terminal' FROM lp WHERE nxt IS NULL AND {OPEN.format('line')})"
GRAM = "{0} AS (SELECT {1}, unnest(range(0, len(t) - {2} + 1)) AS pos, unnest(list_transform(range(1, len(t) - {2} + 2), lambda i: array_to_string(t[i:i + {2} - 1], ' '))) AS gram FROM (SELECT {1}, regexp_extract_all(lower(text), '\\p{{L}}+') AS t FROM {3}) WHERE len(t) >= {2})"
PAIRS = f"{GRAM.format('gd', 'doc_id', 5, 'documents')}, {GRAM.format('gi', 'item_id', 5, 'benchmark')}, pairs AS (SELECT DISTINCT doc_id, item_id FROM gd JOIN gi USING (gram))"
TURNS = "t AS (SELECT *, lead(role) OVER w AS nrole, lead(text) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), pr AS (SELECT conv_id, turn, text AS src, nxt AS tgt FROM t WHERE role = 'user' AND nrole = 'assistant')"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _lex(spark, d):
    return lexicon.build(table(spark, d, "documents"))


def _pairs(spark, d):
    return align.candidate_pairs(table(spark, d, "documents"), table(spark, d, "benchmark"))


def _turns(spark, d):
    """User turns with the assistant turn that follows."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("nrole", F.lead("role").over(w)).withColumn("tgt", F.lead("text").over(w))
    return rows.where("role = 'user' and nrole = 'assistant'").select("conv_id", "turn", F.col("text").alias("src"), "tgt")


# ---------------------------------------------------------------- dictionaries


@query(f"WITH {LEX} SELECT form, n FROM lex")
def lexicon_build(spark, d):
    return _lex(spark, d)


@query(f"SELECT source, lower(form) AS form, count(*) AS n FROM (SELECT source, unnest({SAID}) AS form FROM (SELECT DISTINCT source, text FROM documents)) WHERE NOT {PRINT} GROUP BY 1, 2 HAVING count(*) >= 5")
def lexicon_by_source(spark, d):
    return lexicon.build(table(spark, d, "documents"), by="source").where("n >= 5")


@query(rf"WITH {LEX}, b AS (SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS form FROM benchmark) SELECT form, count(*) AS n FROM b WHERE length(form) >= 4 AND form NOT IN (SELECT form FROM lex) GROUP BY form")
def oov_vs_benchmark(spark, d):
    return lexicon.out_of_vocabulary(table(spark, d, "benchmark"), _lex(spark, d))


@query(f"WITH {LEX}, m AS (SELECT a.form, b.form AS best, b.n AS best_n, row_number() OVER (PARTITION BY a.form ORDER BY b.n DESC, b.form DESC) AS k FROM lex a JOIN lex b ON a.n = 1 AND length(a.form) >= 5 AND b.n >= 200 AND abs(length(a.form) - length(b.form)) <= 1 AND regexp_replace(a.form, '[ -~]', '', 'g') = regexp_replace(b.form, '[ -~]', '', 'g') AND damerau_levenshtein(a.form, b.form) = 1) SELECT form, best, best_n FROM m WHERE k = 1")
def near_misses(spark, d):
    return lexicon.near_misses(_lex(spark, d), same=lambda c: F.regexp_replace(c, "[ -~]", ""))


@query(f"WITH {LEX} SELECT translate(form, '{ACCENTED}', '{PLAIN}') AS key, count(*) AS n_forms, sum(n)::BIGINT AS total FROM lex GROUP BY 1 HAVING count(*) > 1")
def fold_variants(spark, d):
    return lexicon.fold_variants(_lex(spark, d))


_MAP = ", ".join(f"('{a}', '{b}')" for a, b in lexicon.SPELLING)


@query(f"WITH {LEX}, m(a, b) AS (VALUES {_MAP}), r AS (SELECT form, n, a, b, row_number() OVER (PARTITION BY form ORDER BY length(a) DESC) AS k FROM lex JOIN m ON starts_with(form, a)) SELECT form, b || substr(form, length(a) + 1) AS new, n FROM r WHERE k = 1 AND a <> b")
def spelling_respell(spark, d):
    return lexicon.respell(_lex(spark, d))


_PAIRS = (("the", "that"), ("and", "onand"), ("of", "in"), ("was", "is"))


@query(r"WITH f AS (SELECT source, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS form FROM documents), p(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _PAIRS) + ") SELECT source, a, b, count(*) FILTER (form = a) AS n_a, count(*) FILTER (form = b) AS n_b, CASE WHEN n_a >= n_b THEN a ELSE b END AS winner FROM f JOIN p ON form IN (a, b) GROUP BY 1, 2, 3 HAVING n_a > 0 AND n_b > 0")
def pair_majority(spark, d):
    return lexicon.pair_majority(table(spark, d, "documents"), _PAIRS)


_REWRITES = ", ".join(f"('{a}', '{b}')" for a, b in lexicon.REWRITES)


@query(f"WITH {LEX}, r(a, b) AS (VALUES {_REWRITES}), v AS (SELECT DISTINCT form, n, substr(form, 1, instr(form, a) - 1) || b || substr(form, instr(form, a) + length(a)) AS other FROM lex JOIN r ON contains(form, a) WHERE n >= 5) SELECT v.form, v.other, v.n, lex.n AS other_n FROM v JOIN lex ON lex.form = v.other AND lex.n >= 5 ORDER BY least(v.n, lex.n) DESC, v.form, v.other LIMIT 60")
def spelling_candidates(spark, d):
    return lexicon.spelling_candidates(_lex(spark, d))


@query(r"WITH o AS (SELECT doc_id, form, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS form FROM documents) GROUP BY 1, 2) SELECT doc_id, form, n AS last_occurrence FROM o WHERE n >= 3")
def occurrence_numbering(spark, d):
    return lexicon.occurrences(table(spark, d, "documents")).groupBy("doc_id", "form").agg(F.max("occurrence").cast("long").alias("last_occurrence")).where("last_occurrence >= 3")


@query("SELECT d.doc_id, coalesce(l.x, CASE WHEN d.source = 'src0' THEN 'house' END, CASE WHEN d.lang = 'en' THEN 'modern' END, 'none') AS decision FROM documents d LEFT JOIN (SELECT doc_id, max(CASE WHEN toxic = 1 THEN 'drop' ELSE 'keep' END) AS x FROM labels GROUP BY 1) l USING (doc_id)")
def decision_priority(spark, d):
    own = table(spark, d, "labels").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, "drop").otherwise("keep")).alias("decision"))
    by_source = spark.createDataFrame([("src0", "house")], "source string, decision string")
    by_lang = spark.createDataFrame([("en", "modern")], "lang string, decision string")
    rows = table(spark, d, "documents").select("doc_id", "source", "lang")
    return lexicon.decide(rows, [(own, ["doc_id"]), (by_source, ["source"]), (by_lang, ["lang"])], default=F.lit("none")).select("doc_id", "decision")


@query(r"WITH w AS (SELECT regexp_extract(text, '\p{L}+') AS first FROM documents) SELECT CASE WHEN length(first) > 1 AND first = upper(first) AND first <> lower(first) THEN 'upper' WHEN first[1] = upper(first[1]) AND first[1] <> lower(first[1]) THEN 'initial' ELSE 'lower' END AS kind, count(*) AS n, count(DISTINCT first) AS forms FROM w GROUP BY 1")
def casing_transfer(spark, d):
    first = F.regexp_extract("text", r"\p{L}+", 0)
    rows = table(spark, d, "documents").select(first.alias("first"), recase(first, F.lower(first)).alias("again"))
    return rows.groupBy(case_class(F.col("again")).alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("first").alias("forms"))


# ---------------------------------------------------------------- screens


@query(rf"WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS ch FROM documents) SELECT ch, count(*) AS n, count(DISTINCT doc_id) AS docs, CASE WHEN contains('{screens.LIGATURES}', ch) THEN 'ligature' WHEN contains('{screens.ACCENTS}', ch) THEN 'accent' ELSE 'other' END AS category FROM c GROUP BY ch")
def char_inventory(spark, d):
    return screens.char_inventory(table(spark, d, "documents"))


_HARD = "|".join(rf"\p{{{s}}}" for s in screens.SCRIPTS if s != "Greek")


@query(rf"SELECT doc_id, len(regexp_extract_all(t, '{_HARD}')) AS hard, len(regexp_extract_all(t, '\p{{Greek}}')) AS soft FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(replace(text, 'a', 'а'), 'o', 'ο') ELSE text END AS t FROM documents)")
def script_screen(spark, d):
    """Every second text has Cyrillic a and Greek o put in, so that both branches return rows."""
    mixed = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "ao", "аο")).otherwise(F.col("text"))
    return screens.scripts(table(spark, d, "documents").select("doc_id", mixed.alias("text")))


@query(rf"WITH w AS (SELECT regexp_replace(unnest(string_split_regex(text, '[ \t\n\r\f\v]+')), '[^\p{{L}}]', '', 'g') AS token FROM documents), s AS (SELECT token, count(*) AS n FROM w WHERE token <> '' GROUP BY 1) SELECT * FROM (SELECT 'accent' AS category, token, n FROM s WHERE regexp_matches(token, '[{screens.ACCENTS}]') UNION ALL SELECT 'ligature', token, n FROM s WHERE regexp_matches(token, '[{screens.LIGATURES}]') UNION ALL SELECT 'consonantal-j', token, n FROM s WHERE contains(lower(token), 'j')) WHERE token NOT IN ('ja', 'Ja', 'jo')")
def orthography_screen(spark, d):
    return screens.orthography(table(spark, d, "documents"), allow=("ja", "Ja", "jo"))


_RES = " UNION ALL ".join(f"SELECT kind, id, '{a}' AS label, len(regexp_extract_all(text, '{p}')) AS n FROM u" for a, p in screens.RESIDUE)


@query(f"WITH u AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations) SELECT * FROM ({_RES}) WHERE n > 0")
def residue_gate(spark, d):
    docs = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    turns = table(spark, d, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return screens.residue(docs.unionByName(turns), ["kind", "id"])


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n_odd FROM lines WHERE len(regexp_extract_all(line, '\\*')) % 2 = 1 GROUP BY 1")
def markup_parity(spark, d):
    return screens.odd_stars(table(spark, d, "documents"))


_WRAPPED = LINES.replace("coalesce(text", "coalesce(replace(text, ' of ', chr(10) || 'of ')")


@query(f"WITH {_WRAPPED}, lp AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM lines) SELECT doc_id, count(*) AS breaks FROM lp WHERE nxt IS NOT NULL AND {OPEN.format('line')} AND {LOW.format('nxt')} GROUP BY 1 HAVING count(*) >= 3")
def hard_wrap_screen(spark, d):
    """Texts are wrapped before each ``of`` first, as the tables have no hard wraps."""
    docs = table(spark, d, "documents").withColumn("text", F.replace("text", F.lit(" of "), F.lit("\nof ")))
    return screens.hard_wraps(docs)


@query(f"WITH {SEAM} SELECT doc_id, pos, kind FROM seam")
def seam_findings(spark, d):
    return screens.seams(table(spark, d, "documents"))


@query(f"WITH {SEAM}, q AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) SELECT doc_id, pos, kind, sha256(line) AS sha256 FROM seam WHERE NOT (kind = 'tail-terminal' AND doc_id IN (SELECT doc_id FROM q))")
def boundary_audit_hash(spark, d):
    cleared = table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit("tail-terminal").alias("kind")).distinct()
    return screens.boundary_audit(table(spark, d, "documents"), cleared)


@query("SELECT doc_id, len(regexp_extract_all(replace(text, '.', ' .'), '[ \\t\u00a0]+[,;:?!.]')) AS n FROM documents")
def stop_spacing(spark, d):
    """Counted after a space is put before each full stop, as the tables have none."""
    return screens.stop_spacing(table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("."), F.lit(" .")).alias("text")))


@query(rf"WITH {LINES}, w AS (SELECT lang, doc_id, pos, array_to_string(regexp_extract_all(lower(line), '\p{{L}}+'), ' ') AS k, len(regexp_extract_all(line, '\p{{L}}+')) AS n FROM lines), f AS (SELECT *, first_value(doc_id) OVER o AS first_doc_id, first_value(pos) OVER o AS first_pos, row_number() OVER o AS r FROM w WHERE n >= 12 WINDOW o AS (PARTITION BY lang, k ORDER BY doc_id, pos)) SELECT lang, doc_id, pos, first_doc_id, first_pos FROM f WHERE r > 1")
def duplicate_blocks(spark, d):
    return screens.duplicate_blocks(table(spark, d, "documents"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keeper FROM documents QUALIFY doc_id <> keeper")
def duplicate_docs(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("")).alias("h"))
    return rows.join(rows.groupBy("h").agg(F.min("doc_id").alias("keeper")), "h").where("doc_id <> keeper").select("doc_id", "keeper")


@query(rf"WITH p AS (SELECT source, trim(text, ' ') AS t, lead(trim(text, ' ')) OVER (PARTITION BY source ORDER BY doc_id) AS x FROM documents) SELECT source, CASE WHEN t = '' OR x = '' THEN 'para' WHEN regexp_matches(t, '\p{{L}}-[*_]*$') THEN 'hyphen' WHEN regexp_matches(x, '^(#|\*\*|[a-z]\))') THEN 'para' WHEN regexp_matches(x, '^\p{{Ll}}') THEN 'space' WHEN {OPEN.format('t')} THEN 'space' ELSE 'para' END AS kind, count(*) AS n FROM p WHERE x IS NOT NULL GROUP BY 1, 2")
def join_kind_pairs(spark, d):
    return screens.join_kinds(table(spark, d, "documents"))


# ---------------------------------------------------------------- two witnesses


@query(rf"WITH {PAIRS}, o AS (SELECT item_id, pos, w, row_number() OVER (PARTITION BY item_id, w ORDER BY pos) AS k FROM (SELECT item_id, unnest(t) AS w, unnest(range(0, len(t))) AS pos FROM (SELECT item_id, regexp_extract_all(lower(text), '\p{{L}}+') AS t FROM (SELECT item_id, text || ' ' || text AS text FROM benchmark)))), h AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS w FROM documents) GROUP BY 1, 2), a AS (SELECT doc_id, item_id, pos, pos - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS run FROM pairs JOIN o USING (item_id) LEFT JOIN h USING (doc_id, w) WHERE coalesce(h.n, 0) < k) SELECT doc_id, item_id, min(pos) AS start, count(*) AS length FROM a GROUP BY doc_id, item_id, run HAVING count(*) >= 4")
def omission_runs(spark, d):
    """Each witness is taken twice over, so that its second half is missing where the page has the passage once."""
    items = table(spark, d, "benchmark").select("item_id", F.concat_ws(" ", "text", "text").alias("text"))
    return align.omission_runs(table(spark, d, "documents"), items, _pairs(spark, d))


@query(rf"WITH {PAIRS}, a AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{{L}}+') AS a FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '\p{{L}}+') AS b FROM benchmark) SELECT doc_id, item_id, len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS only_ours, len(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))) AS only_gold, floor(len(a) * 1000 / greatest(len(b), 1))::BIGINT AS permille FROM pairs JOIN a USING (doc_id) JOIN b USING (item_id)")
def witness_collate(spark, d):
    return align.bag_collation(table(spark, d, "documents"), table(spark, d, "benchmark"), _pairs(spark, d))


@query(f"WITH {PAIRS}, v AS (SELECT doc_id, item_id, gd.pos - gi.pos AS offset_, count(*) AS votes FROM gd JOIN gi USING (gram) GROUP BY 1, 2, 3) SELECT doc_id, item_id, offset_ AS offset, votes FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY votes DESC, offset_) = 1")
def shingle_containment(spark, d):
    return align.shingle_offsets(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query(f"WITH {GRAM.format('gd', 'doc_id', 4, 'documents')}, {GRAM.format('gi', 'item_id', 4, 'benchmark')}, a AS (SELECT doc_id, gram, min(pos) AS pos FROM gd GROUP BY 1, 2 HAVING count(*) = 1), b AS (SELECT item_id, gram, min(pos) AS item_pos FROM gi GROUP BY 1, 2 HAVING count(*) = 1) SELECT doc_id, item_id, pos, item_pos FROM a JOIN b USING (gram)")
def anchor_pairs(spark, d):
    return align.anchors(table(spark, d, "documents"), table(spark, d, "benchmark"), least_distinct=1)


@query(None)
def anchor_chain(spark, d):
    return align.monotone(anchor_pairs(spark, d))


def _witnesses(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    return _pairs(spark, d).join(docs.select("doc_id", F.col("text").alias("page")), "doc_id").join(items.select("item_id", F.col("text").alias("witness")), "item_id")


@query(None)
def coverage_status(spark, d):
    return align.coverage(_witnesses(spark, d)).select("doc_id", "item_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), "status")


_BAG = " + ".join(f"least(length(a) - length(replace(a, '{c}', '')), length(b) - length(replace(b, '{c}', '')))" for c in "abcdefghijklmnopqrstuvwxyz0123456789")


@query(f"WITH {PAIRS}, f AS (SELECT doc_id, item_id, regexp_replace(strip_accents(lower(d.text)), '[^a-z0-9]', '', 'g') AS a, regexp_replace(strip_accents(lower(i.text)), '[^a-z0-9]', '', 'g') AS b FROM pairs JOIN documents d USING (doc_id) JOIN benchmark i USING (item_id)) SELECT doc_id, item_id, ({_BAG})::BIGINT AS bound FROM f")
def char_bag_bound(spark, d):
    return align.char_bag(_witnesses(spark, d), "page", "witness", ["doc_id", "item_id"])


@query(None)
def cer_pairs(spark, d):
    """Edits between whole turns in code points (DuckDB's levenshtein counts bytes, so a test compares with brute force)."""
    return _turns(spark, d).select("conv_id", "turn", F.levenshtein("src", "tgt").cast("long").alias("edits"))


@query(None)
def wer_pairs(spark, d):
    return align.word_errors(_turns(spark, d), "src", "tgt").select("conv_id", "turn", "edits", "wer", "char_edits", "cer")


@query(None)
def block_alignment(spark, d):
    """Lines of user turns against those of the answers."""
    rows = _turns(spark, d).withColumn("pair", F.col("conv_id") * 1000 + F.col("turn"))
    side = lambda c, s: rows.select("pair", F.lit(s).alias("side"), F.posexplode(F.split(c, r"[.\n]+")).alias("pos", "t")).select("pair", "side", "pos", tokens(F.col("t")).alias("words")).where(F.size("words") > 0)
    return align.block_alignment(side("src", "a").unionByName(side("tgt", "b")))


_JAC = r"s AS (SELECT source, doc_id, list_distinct(regexp_extract_all(lower(text), '\p{L}+')) AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)"


@query(f"WITH {_JAC}, p AS (SELECT a.source, a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS t FROM s a JOIN s b ON a.source = b.source AND b.r BETWEEN a.r + 1 AND a.r + 3) SELECT source, a, b, floor(i * 1000 / greatest(t - i, 1))::BIGINT AS permille FROM p WHERE floor(i * 1000 / greatest(t - i, 1)) >= 100")
def block_jaccard(spark, d):
    return align.line_set_jaccard(table(spark, d, "documents"), least=0.10)


# ---------------------------------------------------------------- paired turns


@query(r"WITH n AS (SELECT conv_id, role, sum(len(list_filter(string_split_regex(trim(text), '\n+'), lambda x: x <> '')))::BIGINT AS n FROM conversations GROUP BY 1, 2) SELECT conv_id, max(n) FILTER (role = 'user') AS n_user, max(n) FILTER (role = 'assistant') AS n_assistant FROM n GROUP BY 1 HAVING n_user <> n_assistant")
def parity_turns(spark, d):
    n = F.size(F.filter(F.split(F.trim("text"), r"\n+"), lambda x: x != ""))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "user", n)).alias("n_user"), F.sum(F.when(F.col("role") == "assistant", n)).alias("n_assistant"))
    return rows.where("n_user <> n_assistant")


@query(f"WITH {TURNS}, f AS (SELECT *, length(tgt) * 100 // greatest(length(src), 1) AS ratio, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS last_, md5('7:' || conv_id || ':' || turn) AS h FROM pr) SELECT conv_id, turn, ratio, (ratio < 50 OR ratio > 200) AS off, last_ AS is_final, row_number() OVER (PARTITION BY conv_id ORDER BY h) = 1 AS sampled FROM f")
def alignment_flags(spark, d):
    rows = _turns(spark, d).withColumn("ratio", F.floor(F.length("tgt") * 100 / F.greatest(F.length("src"), F.lit(1))).cast("long"))
    h = F.md5(F.concat_ws(":", F.lit("7"), "conv_id", "turn"))
    first = lambda o: F.row_number().over(W.partitionBy("conv_id").orderBy(o)) == 1
    return rows.select("conv_id", "turn", "ratio", ((F.col("ratio") < 50) | (F.col("ratio") > 200)).alias("off"), first(F.desc("turn")).alias("is_final"), first(h).alias("sampled"))


@query(r"WITH l AS (SELECT conv_id, turn, unnest(x) AS line, unnest(range(0, len(x))) AS pos FROM (SELECT conv_id, turn, string_split_regex(text, '\n+') AS x FROM conversations WHERE role = 'assistant')), n AS (SELECT conv_id, turn, pos, regexp_replace(lower(trim(line)), '\s+', ' ', 'g') AS note FROM l), c AS (SELECT *, count(*) OVER (PARTITION BY note) AS copies, len(string_split(note, ' ')) AS w FROM n WHERE note <> '') SELECT conv_id, turn, pos, CASE WHEN w < 6 THEN 'short' ELSE 'repeated' END AS problem FROM c WHERE w < 6 OR copies > 1")
def alignment_note_dupes(spark, d):
    """Each whole line of an answer is a note (whole answers don't repeat)."""
    note = F.regexp_replace(F.lower(F.trim("line")), r"\s+", " ")
    lines = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.split("text", r"\n+")).alias("pos", "line"))
    rows = lines.select("conv_id", "turn", "pos", note.alias("note")).where("note <> ''").select("conv_id", "turn", "pos", F.sha2("note", 256).alias("h"), F.size(F.split("note", " ")).alias("w"))
    twice = rows.groupBy("h").agg(F.count("*").alias("copies"))
    out = rows.join(twice, "h").where("w < 6 or copies > 1")
    return out.select("conv_id", "turn", "pos", F.when(F.col("w") < 6, "short").otherwise("repeated").alias("problem"))


# ---------------------------------------------------------------- pages and sections

_ZONES = {"(?i)<script": "script", "(?i)</script|<body": "body", "(?i)<head": "head", "(?i)<footer|<nav": "frame"}
_ZSQL = " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{z}'" for p, z in _ZONES.items())


@query(f"WITH l AS (SELECT page_id, unnest(x) AS line, unnest(range(0, len(x))) AS pos FROM (SELECT page_id, string_split(html, '>') AS x FROM pages)), z AS (SELECT *, CASE {_ZSQL} END AS m FROM l), f AS (SELECT page_id, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos), 'none') AS zone FROM z) SELECT page_id, zone, count(*) AS n FROM f GROUP BY 1, 2")
def zone_carry_forward(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.posexplode(F.split("html", ">")).alias("pos", "line"))
    return records.zones(rows, "page_id", "pos", _ZONES).groupBy("page_id", "zone").agg(F.count("*").alias("n"))


_P = r"p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1)) AS raw FROM pages), q AS (SELECT page_id, trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text, regexp_matches(trim(raw), '(?s)^<a [^>]*>[^<]*</a>$') AS link FROM p)"


@query(f"WITH {_P} SELECT page_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM q GROUP BY 1")
def html_paragraph_counts(spark, d):
    return html_paragraphs(table(spark, d, "pages")).groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {_P} SELECT page_id, count(*) FILTER (link) AS links FROM q GROUP BY 1")
def html_link_only(spark, d):
    return html_paragraphs(table(spark, d, "pages")).groupBy("page_id").agg(F.count_if("is_link").alias("links"))


@query(rf"WITH {LINES}, s AS (SELECT *, sum((length(line) < 60)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM lines) SELECT doc_id, section::BIGINT AS section, count(*) AS n_lines, sum(len(regexp_extract_all(line, '\p{{L}}+')))::BIGINT AS n_words, sha256(string_agg(line, chr(10) ORDER BY pos)) AS sha256 FROM s GROUP BY 1, 2")
def section_split(spark, d):
    """Lines under 60 characters are headings; hashes of the joined lines let the split be undone and checked."""
    rows = records.sections(screens.unit_lines(table(spark, d, "documents")), F.length("line") < 60, "doc_id", "pos")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.size(tokens(F.col("line")))).alias("n_words"), F.sha2(joined, 256).alias("sha256"))


# ---------------------------------------------------------------- records


@query("WITH l AS (SELECT labels.*, d.doc_id IS NULL AS orphan, count(*) OVER (PARTITION BY labels.doc_id) AS k FROM labels LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d USING (doc_id)) SELECT doc_id, rule FROM (SELECT doc_id, 'toxic-good' AS rule FROM l WHERE quality = 1 AND toxic = 1 UNION ALL SELECT doc_id, 'missing-value' FROM l WHERE quality IS NULL OR toxic IS NULL UNION ALL SELECT doc_id, 'unknown-unit' FROM l WHERE orphan UNION ALL SELECT doc_id, 'duplicate' FROM l WHERE k > 1 UNION ALL SELECT doc_id, 'poor-undecided' FROM l WHERE quality = 0 AND toxic = 0)")
def ledger_validate(spark, d):
    known = table(spark, d, "documents").select("doc_id").distinct().withColumn("known", F.lit(True))
    twice = table(spark, d, "labels").groupBy("doc_id").agg(F.count("*").alias("k"))
    rows = table(spark, d, "labels").join(known, "doc_id", "left").join(twice, "doc_id", "left")
    c = F.col
    return records.findings(rows, "doc_id", [
        ("toxic-good", (c("quality") == 1) & (c("toxic") == 1)), ("missing-value", c("quality").isNull() | c("toxic").isNull()), ("unknown-unit", c("known").isNull()),
        ("duplicate", c("k") > 1), ("poor-undecided", (c("quality") == 0) & (c("toxic") == 0)),
    ])


@query(f"WITH {PAIRS} SELECT doc_id, item_id, contains(d.text, i.text) AS present, contains(lower(d.text), lower(i.text)) AS any_case FROM pairs JOIN documents d USING (doc_id) JOIN benchmark i USING (item_id)")
def ledger_proof(spark, d):
    rows = _witnesses(spark, d)
    return rows.select("doc_id", "item_id", F.col("page").contains(F.col("witness")).alias("present"), F.lower("page").contains(F.lower("witness")).alias("any_case"))


@query("SELECT left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(event_type || '|' || props), '\"[^\"]*\"', '<q>', 'g'), '\\S*/\\S+', '<path>', 'g'), '[0-9]+', 'N', 'g'), '\\s+', ' ', 'g'), 120) AS signature, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_ts FROM events GROUP BY 1")
def incident_clusters(spark, d):
    return records.incident_clusters(table(spark, d, "events"))


@query("SELECT user_id, event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY 1, 2, 3")
def incident_upsert(spark, d):
    return records.open_incidents(table(spark, d, "events"))


@query("SELECT user_id, event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY 1, 2, 3")
def incident_stream(spark, d):
    place = new_folder(spark, "incidents")
    out = run_available(spark, d, table(spark, d, "events").schema, f"{place}/state", f"{place}/checkpoint", pattern="events.parquet*")
    return out.withColumn("day", F.col("day").cast("timestamp_ntz")).withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@query(r"""
WITH e AS (SELECT 'w' || user_id % 50 AS work, event_id::VARCHAR AS event_id, ts, event_type = 'purchase' AS human, event_type || ' ' || coalesce(props, '') AS what FROM events),
s AS (SELECT *, 'tool-error|other|' || left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(what), '["''«»“”].*?["''«»“”]', '‹q›', 'g'), '\S*/\S*', '‹path›', 'g'), '[0-9]+', 'N', 'g'), '\s+', ' ', 'g')), 120) AS signature FROM e),
g AS (SELECT work, signature, human, min((ts, event_id)) AS first, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY work, signature, human, CASE WHEN human THEN event_id END)
SELECT work, 'pc-' || strftime(first[1], '%Y-%m-%d') || '-' || row_number() OVER (PARTITION BY work, date_trunc('day', first[1]) ORDER BY first) AS id, signature, n, first[1] AS ts, last_ts FROM g""")
def incident_lifecycle(spark, d):
    """Events as reports of incidents, through keyed state; purchases are a human's reports, which never merge."""
    c = F.col
    rows = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet*").parquet(d)
    null = lambda x: F.lit(None).cast("string").alias(x)
    events = rows.select(
        F.concat(F.lit("w"), (c("user_id") % 50).cast("string")).alias("work"), c("event_id").cast("string").alias("event_id"), c("ts").cast("timestamp").alias("ts"), F.lit("add").alias("action"), F.lit("tool-error").alias("kind"), null("stage"),
        F.concat("event_type", F.lit(" "), F.coalesce("props", F.lit(""))).alias("what"), F.when(c("event_type") == "purchase", "human").otherwise("auto").alias("source"), *map(null, ("incident", "status", "why", "fix", "evidence")),
    )
    place = new_folder(spark, "lifecycle")
    run_lifecycle(events, f"{place}/changes", f"{place}/checkpoint")
    out = incidents(spark.read.parquet(f"{place}/changes"))
    ntz = lambda x: c(x).cast("timestamp_ntz").alias(x)
    return out.select("work", "id", "signature", c("count").alias("n"), ntz("ts"), ntz("last_ts"))


@query("WITH r AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS mean_a, avg(value) FILTER (event_type = 'view') AS mean_b, max(value) FILTER (event_type = 'click') - min(value) FILTER (event_type = 'click') AS sa, max(value) FILTER (event_type = 'view') - min(value) FILTER (event_type = 'view') AS sb FROM events GROUP BY 1) SELECT user_id, floor(mean_a * 1000 + 0.5)::BIGINT AS mean_a, floor(mean_b * 1000 + 0.5)::BIGINT AS mean_b, abs(mean_b - mean_a) <= greatest(sa, sb) AS within_noise FROM r WHERE mean_a IS NOT NULL AND mean_b IS NOT NULL")
def replay_compare(spark, d):
    out = records.compare_runs(table(spark, d, "events"), "user_id", "event_type", "value", "click", "view", ["event_id", "ts", "value"])
    milli = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c)
    return out.select("user_id", milli("mean_a"), milli("mean_b"), "within_noise")


@query("SELECT source, doc_id, round_ AS round FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('sentinel' || doc_id)) AS round_ FROM documents) ORDER BY round_, source LIMIT 100")
def sentinel_round_robin(spark, d):
    return records.round_robin(table(spark, d, "documents"), "source", "doc_id", 100, "sentinel")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 15 AS chunk FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL))")
def resume_todo(spark, d):
    return records.todo_chunks(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT user_id, ts, event_id, event_type, ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS stale FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_state(spark, d):
    events = table(spark, d, "events")
    last = records.latest(events, "user_id", ["ts", "event_id"], ["ts", "event_id", "event_type"])
    end = events.agg(F.max("ts").alias("end"))
    return last.crossJoin(F.broadcast(end)).withColumn("stale", F.col("ts") < F.col("end") - F.expr("interval 1 day")).drop("end")


@query("WITH m AS (SELECT l_orderkey, l_linenumber AS v, max(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM lineitem) SELECT l_orderkey, count(*) AS n, count(*) FILTER (v < m) AS falls, count(*) FILTER (v > m + 1) AS gaps FROM m GROUP BY 1")
def facsimile_order(spark, d):
    return records.order_checks(table(spark, d, "lineitem"), "l_orderkey", ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"], "l_linenumber")


@query("SELECT o_custkey, count(*) AS n_items, sum(l_quantity)::BIGINT AS quantity, count(DISTINCT o_orderkey) AS n_orders FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def manifest_nest(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    nested = records.nest(table(spark, d, "orders").select("o_orderkey", "o_custkey"), items, "o_orderkey", ["l_linenumber", "l_quantity"])
    flat = nested.select("o_custkey", "o_orderkey", F.explode("items").alias("x"))
    return flat.groupBy("o_custkey").agg(F.count("*").alias("n_items"), F.sum("x.l_quantity").cast("long").alias("quantity"), F.count_distinct("o_orderkey").alias("n_orders"))


@query("WITH n AS (SELECT 'n' || n_nationkey AS node, min(c_custkey) AS lo, max(c_custkey) AS hi, count(*) AS n, 'r' || n_regionkey AS p FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), r AS (SELECT p AS node, min(lo) AS lo, max(hi) AS hi, sum(n)::BIGINT AS n FROM n GROUP BY 1) SELECT node, lo, hi, n FROM n UNION ALL SELECT * FROM r UNION ALL SELECT 'world', min(lo), max(hi), sum(n)::BIGINT FROM r")
def ancestor_spans(spark, d):
    c = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    nodes = table(spark, d, "nation").select(c("n", "n_nationkey").alias("node"), c("r", "n_regionkey").alias("parent"))
    nodes = nodes.unionByName(table(spark, d, "region").select(c("r", "r_regionkey").alias("node"), F.lit("world").alias("parent")))
    return records.ancestor_spans(nodes, table(spark, d, "customer").select(c("n", "c_nationkey").alias("node"), F.col("c_custkey").alias("value")), depth=3)


@query(f"WITH {SEAM}, f AS (SELECT kind AS gate, doc_id FROM seam), m AS (SELECT f.*, w.doc_id IS NOT NULL AS waived FROM f LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) w USING (doc_id)), s AS (SELECT gate, count(*) FILTER (NOT waived) AS n_open, count(*) FILTER (waived) AS n_waived FROM m GROUP BY 1), g(gate) AS (VALUES ('lower-start'), ('pair-seam'), ('tail-terminal')) SELECT gate, coalesce(n_open, 0) AS n_open, coalesce(n_waived, 0) AS n_waived, CASE WHEN n_open > 0 THEN 'fail' WHEN n_waived > 0 THEN 'waived' ELSE 'pass' END AS status FROM g LEFT JOIN s USING (gate)")
def waiver_gate(spark, d):
    found = screens.seams(table(spark, d, "documents")).select(F.col("kind").alias("gate"), "doc_id")
    return records.gate_status(found, table(spark, d, "labels").where("quality = 1"), ["lower-start", "pair-seam", "tail-terminal"], ["doc_id"])


@query(rf"WITH {SEAM}, {LEX}, t AS (SELECT source, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS form FROM documents), k AS (SELECT source, count(*) AS n_tokens, count(*) FILTER (lex.n IS NULL OR lex.n < 2) AS n_rare FROM t LEFT JOIN lex USING (form) GROUP BY 1), s AS (SELECT source, count(*) AS n_seams FROM seam JOIN documents USING (doc_id) GROUP BY 1), c AS (SELECT source, count(*) AS n_docs, count(DISTINCT text) AS n_texts FROM documents GROUP BY 1) SELECT source, n_docs, n_texts, n_tokens, n_rare, coalesce(n_seams, 0) AS n_seams FROM c LEFT JOIN k USING (source) LEFT JOIN s USING (source)")
def source_card(spark, d):
    """The flagship: for each source its documents, distinct texts, tokens, tokens rare in the dictionary, and seam findings."""
    docs = table(spark, d, "documents")
    forms = docs.select("source", F.explode(tokens(F.col("text"))).alias("form")).groupBy("source", "form").agg(F.count("*").alias("k"))
    kinds = forms.join(_lex(spark, d), "form", "left").groupBy("source").agg(F.sum("k").alias("n_tokens"), F.coalesce(F.sum(F.when(F.coalesce("n", F.lit(0)) < 2, F.col("k"))), F.lit(0)).alias("n_rare"))
    found = screens.seams(docs).groupBy("doc_id").agg(F.count("*").alias("n")).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("n").alias("n_seams"))
    cards = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_distinct(F.sha2("text", 256)).alias("n_texts"))
    return cards.join(kinds, "source", "left").join(found, "source", "left").fillna(0, ["n_seams"])


# ---------------------------------------------------------------- gates and merges


_LONG = r"d AS (SELECT doc_id, source, CASE WHEN lang = 'en' THEN regexp_replace(coalesce(text, ''), 's(\p{L})', 'ſ\1', 'g') ELSE coalesce(text, '') END AS t FROM documents)"


@query(rf"WITH {_LONG}, c AS (SELECT doc_id, source, length(t) - length(replace(t, 's', '')) - len(regexp_extract_all(t, 's([^\p{{L}}]|$)')) AS medial_s, length(t) - length(replace(t, 'ſ', '')) AS long_s FROM d), w AS (SELECT source, max(long_s) > 0 AS printed FROM c GROUP BY source) SELECT doc_id, medial_s, long_s, printed AND medial_s >= 30 AND long_s < 0.1 * (long_s + medial_s) AS fails FROM c JOIN w ON c.source IS NOT DISTINCT FROM w.source")
def long_s_gate(spark, d):
    """English texts are given long s in the middle of words; the tables have none."""
    text = F.coalesce("text", F.lit(""))
    long = F.when(F.col("lang") == "en", F.regexp_replace(text, r"s(\p{L})", "ſ$1")).otherwise(text)
    rows = table(spark, d, "documents").select("doc_id", "source", long.alias("text"))
    return screens.long_s_gate(rows, "source").select("doc_id", "medial_s", "long_s", "fails")


@query("WITH t AS (SELECT conv_id, turn // 2 AS pair, role FROM conversations), b AS (SELECT role FROM t WHERE role IS NOT NULL GROUP BY role ORDER BY count(*) DESC, role LIMIT 1), s AS (SELECT DISTINCT conv_id, pair FROM t WHERE role = (SELECT role FROM b)) SELECT t.conv_id, t.pair, t.role, CASE WHEN t.role = (SELECT role FROM b) THEN 'tree' WHEN s.conv_id IS NOT NULL THEN 'merged' ELSE 'refused' END AS status, count(*) AS n FROM t LEFT JOIN s ON t.conv_id = s.conv_id AND t.pair = s.pair GROUP BY ALL")
def companion_merge(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.expr("turn div 2").alias("pair"), "role")
    return records.with_companions(rows, "role", ["conv_id", "pair"]).groupBy("conv_id", "pair", "role", "status").agg(F.count("*").alias("n"))


@query(r"WITH o AS (SELECT l.doc_id, d.text, d.lang FROM (SELECT DISTINCT doc_id FROM labels) l JOIN documents d USING (doc_id)), n AS (SELECT doc_id, CASE lang WHEN 'en' THEN text WHEN 'de' THEN replace(text, 'ss', 'ß') ELSE lower(text) END AS now FROM documents) SELECT doc_id, CASE WHEN text IS NOT DISTINCT FROM now THEN 'same' WHEN replace(text, 'ss', 'ß') IS NOT DISTINCT FROM now THEN 'house' ELSE 'reread' END AS verdict FROM o JOIN n USING (doc_id)")
def rekey_judgements(spark, d):
    """The new texts are derived: English ones stay, German ones get ß by the house rule, the others lose their capitals."""
    docs = table(spark, d, "documents")
    house = lambda c: F.replace(c, F.lit("ss"), F.lit("ß"))
    now = F.when(F.col("lang") == "en", F.col("text")).when(F.col("lang") == "de", house(F.col("text"))).otherwise(F.lower("text"))
    judged = docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    return records.rekey(judged, docs.select("doc_id", now.alias("text")), "doc_id", house)
