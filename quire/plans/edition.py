"""Queries of ``quire.operators.edition`` over the driver's tables and their SQL; marks that the tables lack are put in first."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import ACCENTED, PLAIN, fold_accents, let, lines
from quire.operators import align, edition
from quire.operators.edition import BAR
from quire.plans.catalog import LEX, LINES, _lex, query, table
from quire.sources.shared import staged

# Frequent forms, their m and n after vowels written as bars.
TOK = rf"{LEX}, tok AS (SELECT DISTINCT regexp_replace(form, '([aeiou])[mn]', '\1{BAR}', 'g') AS token FROM lex WHERE n >= 20 AND regexp_matches(form, '[aeiou][mn]'))"
WORDS = r"list_filter(string_split_regex({0}, '[ \t\n\r\f\v]+'), lambda x: x <> '')"


def _barred(lex):
    often = lex.where((F.col("n") >= 20) & F.col("form").rlike("[aeiou][mn]"))
    return often.select(F.regexp_replace("form", "([aeiou])[mn]", f"$1{BAR}").alias("token"))


@query(
    f"WITH {TOK}, c AS (SELECT token, form, n FROM tok JOIN lex ON translate(token, 'mn{BAR}', '___') = translate(form, 'mn', '__') AND regexp_full_match(form, replace(token, '{BAR}', '[mn]'))), "
    "r AS (SELECT *, row_number() OVER w AS k, lead(n) OVER w AS n2 FROM c WINDOW w AS (PARTITION BY token ORDER BY n DESC, form DESC)) "
    "SELECT token, CASE WHEN contains(token, 'ñ') THEN 'other-marks' WHEN form IS NULL THEN 'none' WHEN n2 IS NULL THEN 'unique' WHEN n >= 20 * n2 THEN 'frequency' ELSE 'variant' END AS status, CASE WHEN status IN ('none', 'variant', 'other-marks') THEN '' ELSE form END AS form, CASE WHEN status IN ('none', 'variant', 'other-marks') THEN 0 ELSE n END AS n FROM tok LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (token)"
)
def nasal_expansion(spark, d):
    lex = staged(_lex(spark, d), "lexicon")
    return edition.expand_nasals(_barred(lex), lex).fillna({"form": "", "n": 0})


@query(
    f"WITH {TOK}, u AS (SELECT DISTINCT translate(token, 'v', 'u') AS token FROM tok), c AS (SELECT token, form, n, translate(form, 'v', 'u') AS sig FROM u JOIN lex ON translate(token, 'mn{BAR}', '___') = translate(form, 'vmn', 'u__') "
    f"AND regexp_full_match(form, replace(replace(token, 'u', '[uv]'), '{BAR}', '[mn]')) WHERE NOT regexp_matches(substr(form, 2), 'v') OR contains(substr(token, 2), 'u')), "
    "s AS (SELECT token, sig, sum(n) AS sn FROM c GROUP BY ALL), s1 AS (SELECT *, row_number() OVER w AS k, lead(sn) OVER w AS sn2 FROM s WINDOW w AS (PARTITION BY token ORDER BY sn DESC, sig DESC)), "
    "f AS (SELECT c.*, sn, sn2, row_number() OVER w AS kf, lead(n) OVER w AS n2 FROM c JOIN (SELECT * FROM s1 WHERE k = 1) USING (token, sig) WINDOW w AS (PARTITION BY token ORDER BY n DESC, form DESC)) "
    "SELECT token, CASE WHEN contains(token, 'ñ') THEN 'other-marks' WHEN form IS NULL THEN 'none' WHEN sn < 20 * sn2 OR n < 5 * n2 THEN 'variant' WHEN sn2 IS NOT NULL OR n2 IS NOT NULL THEN 'frequency' ELSE 'unique' END AS status, CASE WHEN status IN ('none', 'variant', 'other-marks') THEN '' ELSE form END AS form, CASE WHEN status IN ('none', 'variant', 'other-marks') THEN 0 ELSE n END AS n "
    "FROM u LEFT JOIN (SELECT * FROM f WHERE kf = 1) USING (token)"
)
def uv_decision(spark, d):
    lex = staged(_lex(spark, d), "lexicon")
    return edition.decide_uv(_barred(lex).select(F.translate("token", "v", "u").alias("token")), lex).fillna({"form": "", "n": 0})


@query(
    f"WITH {LEX}, t AS (SELECT DISTINCT regexp_replace(form, 's', 'f') AS token FROM lex WHERE n >= 20 AND contains(form, 's') UNION SELECT form FROM lex WHERE contains(form, 'f')), p AS (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM t), "
    "o AS (SELECT token, substr(token, 1, i - 1) || 's' || substr(token, i + 1) AS other FROM p WHERE substr(token, i, 1) = 'f'), m AS (SELECT o.token, o.other, coalesce(f.n, 0) AS f_n, s.n AS s_n FROM o JOIN lex s ON s.form = o.other LEFT JOIN lex f ON f.form = o.token) "
    "SELECT *, CASE WHEN f_n * 20 < s_n THEN 'misread' ELSE 'context' END AS kind FROM m WHERE s_n >= 20 AND s_n * 20 > f_n"
)
def long_s_doubts(spark, d):
    lex = _lex(spark, d)
    wrong = lex.where("n >= 20 and contains(form, 's')").select(F.expr("overlay(form placing 'f' from instr(form, 's') for 1)").alias("token"))
    return edition.long_s_doubts(wrong.union(lex.select("form")), lex)


@query(
    f"WITH w AS (SELECT doc_id, {WORDS.format('replace(text, chr(32) || chr(111) || chr(102) || chr(32), chr(32) || chr(10214) || chr(111) || chr(102) || chr(63) || chr(10215) || chr(32))')} AS w FROM documents), p AS (SELECT doc_id, w, unnest(w) AS x, unnest(range(0, len(w))) AS pos FROM w) "
    "SELECT doc_id, pos, 'of' AS word, array_to_string(w[greatest(pos - 5, 1):pos], ' ') AS before, array_to_string(w[pos + 2:pos + 7], ' ') AS after FROM p WHERE x = '⟦of?⟧'"
)
def doubt_sites(spark, d):
    """Each ``of`` between spaces is marked as a doubtful reading first."""
    return edition.doubt_sites(table(spark, d, "documents").select("doc_id", F.replace("text", F.lit(" of "), F.lit(" ⟦of?⟧ ")).alias("text")))


@query(
    r"WITH t AS (SELECT doc_id, lower(text) AS t, regexp_extract(lower(text), '\p{L}+') AS probe, length(text) // 2 AS near FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, near, length(probe) AS m, string_split(t, probe) AS l FROM t WHERE probe <> ''), "
    "x AS (SELECT doc_id, near, m, len(l) AS c, unnest(l) AS piece, unnest(range(0, len(l))) AS i FROM p), y AS (SELECT doc_id, near, c, i, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) + i * m AS pos FROM x) "
    'SELECT doc_id, pos::BIGINT AS "at" FROM y WHERE i < c - 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY abs(pos - near), pos) = 1'
)
def nearest_location(spark, d):
    """The occurrence of a text's first word, also inside words, that is nearest to its middle."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.lower("text").alias("text"), F.expr("length(text) div 2").alias("near"))
    return edition.locate_nearest(rows.withColumn("probe", F.regexp_extract("text", r"\p{L}+", 0))).where("at is not null").select("doc_id", "at")


_HEAD = "SELECT doc_id, {0} AS {1}, head, row_number() OVER (PARTITION BY doc_id, head ORDER BY {0}) AS k FROM (SELECT doc_id, {0}, array_to_string(w[1:8], ' ') AS head FROM (SELECT doc_id, {0}, " + WORDS.format("line") + " AS w FROM {2}) WHERE len(w) >= 4)"


@query(
    f"WITH {LINES}, b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN xor(pos, 1) ELSE pos END AS place, line FROM lines WHERE pos % 7 <> 3 UNION ALL SELECT doc_id, 1000000, line FROM lines WHERE pos = 0 AND doc_id % 3 = 0), "
    f"o AS ({_HEAD.format('place', 'i', 'b')}), s AS ({_HEAD.format('pos', 'j', 'lines')}), "
    "m AS (SELECT o.doc_id, i, s.j, (o.doc_id, o.head) IN (SELECT (doc_id, head) FROM s) AS known FROM o LEFT JOIN s USING (doc_id, head, k)), h AS (SELECT *, max(j) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM m), "
    "f AS (SELECT doc_id, i AS pos, CASE WHEN NOT known THEN 'absent' WHEN j IS NULL THEN 'repeat' WHEN j < high THEN 'order' END AS kind FROM h) "
    "SELECT * FROM f WHERE kind IS NOT NULL UNION ALL SELECT s.doc_id, s.j, 'missing' FROM s LEFT JOIN o USING (doc_id, head, k) WHERE o.i IS NULL"
)
def source_order(spark, d):
    """Blocks are a text's lines with neighbours swapped in even texts, some left out, and some first lines repeated at the end."""
    flow = table(spark, d, "documents").select("doc_id", F.inline(lines(F.col("text"))))
    ours = flow.where("pos % 7 <> 3").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.expr("pos ^ 1L")).otherwise(F.col("pos")).alias("pos"), "line")
    again = flow.where("pos = 0 and doc_id % 3 = 0").select("doc_id", F.lit(1000000).cast("long").alias("pos"), "line")
    return edition.source_order(ours.unionByName(again), flow)


_NOTE = edition.NOTE.replace("'", "''")


@query(
    "WITH t AS (SELECT source, doc_id, replace(coalesce(text, ''), '.', CASE WHEN doc_id % 3 = 0 THEN '^[Editor''s note: x].' ELSE '^[7. x].' END) AS t FROM documents), "
    f"c AS (SELECT *, len(regexp_extract_all(t, '{_NOTE}')) AS n, CASE WHEN doc_id % 3 = 0 THEN 'Editor''s note: ' ELSE '' END AS own FROM t), "
    "f AS (SELECT *, (1 + coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first FROM c), "
    f"p AS (SELECT *, string_split_regex(t, '{_NOTE}') AS l FROM f) "
    "SELECT source, doc_id, first, n, sha256(array_to_string(list_transform(l, lambda x, i: CASE WHEN i = 1 THEN x ELSE '^[' || (first + i - 2) || '. ' || own || x END), '')) AS sha256 FROM p"
)
def footnote_renumber(spark, d):
    """A note is put before each full stop first: the editor's in every third text, a numbered one elsewhere."""
    note = F.when(F.col("doc_id") % 3 == 0, "^[Editor's note: x].").otherwise("^[7. x].")
    docs = table(spark, d, "documents").select("source", "doc_id", F.replace("text", F.lit("."), note).alias("text"))
    return edition.renumber_notes(docs).select("source", "doc_id", "first", "n", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query(
    "WITH t AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 2 = 1 THEN '**' || turn || '** ' ELSE '' END AS num, len(string_split(text, ',')) - 1 AS n FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL) "
    "SELECT conv_id, turn, CASE WHEN n = 0 THEN num || text ELSE num || repeat('*' || role || '*.— ', n) || trim(replace(text, ',', ' '), ' ') END AS text FROM t"
)
def run_in_rubrics(spark, d):
    """Commas become run-in rubrics that hold the role; every second turn starts with a bold numeral."""
    rows = table(spark, d, "conversations").where("text is not null and role is not null")
    text = F.expr("concat(if(turn % 2 = 1, concat('**', turn, '** '), ''), replace(text, ',', concat(' ^[⟦M⟧⟦R⟧ ', role, '.]')))")
    return rows.select("conv_id", "turn", edition.hoist_rubrics(text).alias("text"))


@query("SELECT conv_id, turn, replace(replace(text, 'th', '‘th’'), ', ', ', “') || repeat('”', len(string_split(text, ', ')) - 1) AS text FROM conversations WHERE len(string_split(text, ', ')) = 2 AND NOT contains(string_split(text, ', ')[1], 'th')")
def quotation_nesting(spark, d):
    """Turns of one comma and no ``th`` before it: what follows it is quoted, with each ``th`` quoted inside."""
    rows = table(spark, d, "conversations").where("size(split(text, ', ', -1)) = 2 and not contains(split(text, ', ', -1)[0], 'th')")
    rows = rows.select("conv_id", "turn", F.expr("concat(replace(replace(text, 'th', '‹th›'), ', ', ', « '), ' »')").alias("text"))
    return rows.select("conv_id", "turn", edition.english_quotes("text")["text"].alias("text"))


@query(
    "WITH c AS (SELECT doc_id, doc_id % 3 AS kind, coalesce(source, 'none') || '/' || coalesce(lang, 'und') || '/' || doc_id || '.md' AS p FROM documents), "
    "t AS (SELECT doc_id, CASE kind WHEN 0 THEN [p] WHEN 1 THEN [p] ELSE ['src1/log', p] END AS a, CASE kind WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [p] ELSE ['src1/log', p] END AS w FROM c), "
    r"r AS (SELECT doc_id, CASE WHEN len(list_filter(a, lambda x: starts_with(x, 'src0/'))) > 0 THEN 'forbidden' WHEN len(list_filter(a, lambda x: regexp_matches(x, '/[0-9]*7\.md$'))) > 0 THEN 'secret' "
    "WHEN len(list_filter(w, lambda x: contains(x, '/de/'))) > 0 THEN 'derived' WHEN len(list_filter(w, lambda x: NOT regexp_matches(x, '^src[1-3]/'))) > 0 THEN 'territory' ELSE 'none' END AS rule FROM t) SELECT doc_id, rule, rule = 'none' AS allow FROM r"
)
def call_policy(spark, d):
    """Calls are derived from documents: reads, writes, and shell commands with a redirection and an edit in place."""
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("und")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    kind = F.col("doc_id") % 3
    calls = table(spark, d, "documents").select(
        "doc_id", F.when(kind == 0, "read").when(kind == 1, "write").otherwise("shell").alias("tool"), F.when(kind < 2, path).alias("path"),
        F.when(kind == 2, F.concat(F.lit("echo x > src1/log && sed -i s/a/b/ "), path)).alias("command"),
    )
    judged = edition.judge_calls(calls, ["src0"], [r"/[0-9]*7\.md$"], ["/de/"], ["src1", "src2", "src3"])
    return judged.select("doc_id", F.coalesce("rule", F.lit("none")).alias("rule"), "allow")


_FOLDED = rf"regexp_extract_all(translate(lower(text), '{ACCENTED}', '{PLAIN}'), '[\p{{L}}\p{{N}}]+')"


@query(
    rf"WITH t AS (SELECT conv_id, turn, {_FOLDED} AS w FROM conversations WHERE text IS NOT NULL), p AS (SELECT *, list_position(list_transform(w, lambda x: length(x) >= 6), true) AS i FROM t) "
    "SELECT conv_id, turn, (i - 1)::BIGINT AS start, w[i] AS a, 'zzq' AS b, array_to_string(w[greatest(1, i - 6):i - 1], ' ') AS before, array_to_string(w[i + 1:i + 6], ' ') AS after, "
    "CASE WHEN i = 1 OR i = len(w) THEN 'unknown' WHEN turn % 3 = 0 THEN 'a' WHEN turn % 3 = 1 THEN 'b' ELSE 'unknown' END AS agrees FROM p WHERE i IS NOT NULL"
)
def collation_sites(spark, d):
    """The second witness has ``zzq`` for the first word of six or more letters; the third voice is one of the two, or absent."""
    rows = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", "text")
    rows = rows.withColumn("other", F.regexp_replace("text", r"(?s)^(.*?)(?<![\p{L}\p{N}])[\p{L}\p{N}]{6,}", "$1zzq"))
    rows = rows.withColumn("ocr", F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.col("other")))
    return align.collation_sites(rows, "text", "other", "ocr", ["conv_id", "turn"]).drop("kind", "third")


@query(
    rf"WITH {LEX}, t AS (SELECT conv_id, turn, {_FOLDED} AS w FROM conversations), p AS (SELECT conv_id, turn, w, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM t), f AS (SELECT *, x = 'that' AND lag(x) OVER o <> 'that' AND lead(x) OVER o <> 'that' AS hit FROM p WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i)) "
    "SELECT conv_id, turn, (i - 1)::BIGINT AS start, 'thxt' AS own, 'that' AS other, 0::BIGINT AS own_n, (SELECT n FROM lex WHERE form = 'that') AS other_n FROM f WHERE hit AND (SELECT n FROM lex WHERE form = 'that') >= 50"
)
def shared_errors(spark, d):
    """The two agreed witnesses read ``thxt`` for each lone ``that`` of the third voice."""
    rows = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", fold_accents(F.col("text")).alias("text"))
    other = lambda w, i: F.coalesce(F.get(w, i) != "that", F.lit(False))
    misread = lambda w: F.transform(w, lambda x, i: F.when((x == "that") & other(w, i - 1) & other(w, i + 1), "thxt").otherwise(x))
    own = F.array_join(let(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), misread), " ")
    rows = rows.withColumn("own", own).withColumn("none", F.lit(None).cast("string"))
    return align.shared_errors(align.collation_sites(rows, "own", "text", "none", ["conv_id", "turn"]), _lex(spark, d), ["conv_id", "turn"])
