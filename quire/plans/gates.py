"""Queries of folds, gates, page joins, edits and ledgers over the driver's tables and their SQL; columns that the tables lack are derived first."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import notes, unicode
from quire.operators import assemble, gates, ledger, sites
from quire.plans.catalog import query, table

ACCENT = unicode.class_pattern("accent")
PHRASES = (("stupid", "insult"), ("The Of", "order"), ("trash", "insult"))
_PHRASES = ", ".join(f"('{p}', '{r}')" for p, r in PHRASES)


@query("""
SELECT doc_id, sha256(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '', 'g')) AS coverage,
       sha256(replace(replace(replace(strip_accents(lower(text)), 'æ', 'ae'), 'œ', 'oe'), 'ſ', 's')) AS collate
FROM documents WHERE text IS NOT NULL""")
def comparison_folds(spark, d):
    """Whole texts under two of the folds."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", *[F.sha2(unicode.fold(F.col("text"), k).cast("binary"), 256).alias(k) for k in ("coverage", "collate")])


@query(f"""
SELECT doc_id, (length(nfc_normalize(text)) - length(regexp_replace(nfc_normalize(text), '{ACCENT}', '', 'g')))::BIGINT AS n
FROM documents WHERE regexp_matches(nfc_normalize(text), '{ACCENT}')""")
def accent_counts(spark, d):
    """Accented vowels of each text that has any."""
    n = F.element_at(unicode.class_counts(F.col("text")), "accent")
    return table(spark, d, "documents").where("text is not null").select("doc_id", n.alias("n")).where("n is not null")


@query(r"""
WITH p AS (SELECT a.doc_id AS n, regexp_replace(coalesce(a.text, ''), '\s+$', '') AS t, regexp_replace(coalesce(b.text, ''), '^\s+', '') AS x
           FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
f AS (SELECT *, regexp_extract(x, '\p{L}') AS c FROM p)
SELECT n, CASE WHEN t = '' OR x = '' THEN 'para' WHEN regexp_matches(t, '[A-Za-zÀ-ÿſ]-[*_]*$') THEN 'hyphen'
               WHEN starts_with(x, '#') OR regexp_matches(x, '^\*\*[^*\p{L}]*\p{Lu}') OR regexp_matches(x, '^[*_]*[a-zα-ωά-ώ]\)[*_]*\s') THEN 'para'
               WHEN c = lower(c) AND c <> upper(c) THEN 'space' WHEN regexp_matches(t, '\bS\.$') THEN 'space'
               WHEN NOT regexp_matches(t, '[.!?…]\s*[''"”’»)\]*_]*\s*$') AND NOT ends_with(t, ':') THEN 'space' ELSE 'para' END AS kind
FROM f""")
def page_joins(spark, d):
    """How each text would go on in the text with the next id; texts meet by an equi-join on the number, not in a window."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("n"), "text")
    following = docs.select((F.col("n") - 1).alias("n"), F.col("text").alias("next"))
    return docs.join(following, "n").select("n", assemble.join_kind(F.col("text"), F.col("next")).alias("kind"))


@query("""
WITH g AS (SELECT source, doc_id, doc_id - row_number() OVER (PARTITION BY source ORDER BY doc_id) AS g FROM (SELECT DISTINCT source, doc_id FROM documents)),
r AS (SELECT source, min(doc_id) AS a, max(doc_id) AS b FROM g GROUP BY source, g)
SELECT source, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM r GROUP BY source""")
def page_ranges(spark, d):
    """The ids of each source as ranges."""
    return assemble.page_ranges(table(spark, d, "documents").withColumnRenamed("doc_id", "n"), ["source"])


@query(r"""
WITH t AS (SELECT conv_id, turn, replace(replace('# h' || chr(10) || text, 'th', '**th**'), ' in ', ' ^[in] *in* [^1] ') AS t FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, (length(t) - length(replace(t, '**', '')))::BIGINT // 2 AS bold, (length(t) - length(replace(t, '^[', '')))::BIGINT // 2 AS notes,
       (length(t) - length(replace(t, '[^', '')))::BIGINT // 2 AS marks, len(regexp_extract_all(t, '(?m)^#{1,6} '))::BIGINT AS headings FROM t""")
def markup_signature(spark, d):
    """Turns with a heading, bold, notes and note marks put in."""
    text = F.expr("replace(replace(concat('# h\n', text), 'th', '**th**'), ' in ', ' ^[in] *in* [^1] ')")
    rows = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", notes.markdown_signature(text).alias("s"))
    return rows.select("conv_id", "turn", F.col("s.bold").alias("bold"), F.col("s.`inline-note`").alias("notes"), F.col("s.`note-mark`").alias("marks"), F.col("s.heading").alias("headings"))


@query(f"""
WITH p(phrase, reason) AS (VALUES {_PHRASES}),
b AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS b, unnest(range(0, len(string_split(text, chr(10) || chr(10)))))::INTEGER AS block FROM documents)
SELECT doc_id::VARCHAR AS section_key, block, phrase, reason FROM b JOIN p ON contains(lower(b), lower(phrase))""")
def banned_phrases(spark, d):
    """Blocks of all documents, as translations, that hold a listed phrase."""
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("section_key"), F.col("lang").alias("language"), F.lit("translation").alias("role"), F.col("text").alias("content"))
    return gates.banned_phrases(texts, spark.createDataFrame(list(PHRASES), "phrase string, reason string")).select("section_key", "block", "phrase", "reason")


@query(f"""
WITH f AS (SELECT p_partkey::VARCHAR AS section_key, unnest(['slug', 'title', 'section_key']) AS field, unnest([p_name, p_type || repeat('x', p_size * 12), p_brand]) AS value FROM part)
SELECT section_key, field, CASE WHEN field = 'title' THEN 'length' ELSE 'pattern' END AS problem FROM f
WHERE (field = 'title' AND length(value) > 500) OR (field = 'slug' AND NOT regexp_matches(value, '{gates.SLUG}')) OR (field = 'section_key' AND NOT regexp_matches(value, '{gates.KEY}'))""")
def identifier_gate(spark, d):
    """Parts' names, types (made longer by their size) and brands as slugs, titles and keys."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in (("slug", F.col("p_name")), ("title", F.expr("concat(p_type, repeat('x', p_size * 12))")), ("section_key", F.col("p_brand")))])
    fields = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("section_key"), F.explode(pairs).alias("x")).select("section_key", "x.*")
    return gates.identifier_problems(fields)


@query("""
WITH s AS (SELECT s_suppkey, s_suppkey % 3 AS k, s_nationkey AS n FROM supplier)
SELECT s_suppkey::VARCHAR AS source_key, unnest(list_filter([CASE WHEN n % 2 = 0 THEN 'licence' END, CASE WHEN n % 5 <> 0 THEN 'credit' END], lambda x: x IS NOT NULL)) AS problem FROM s WHERE k < 2""")
def licence_gate(spark, d):
    """Suppliers as sources: of three bases by their key, licences and credits by their nation."""
    rows = table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("source_key"), F.expr("element_at(array('own_contribution', 'public_domain_edition', 'licensed'), cast(s_suppkey % 3 as int) + 1)").alias("rights_basis"),
        F.when(F.col("s_nationkey") % 2 != 0, "CC").alias("license_code"), F.lit("u").alias("license_url"), F.when(F.col("s_nationkey") % 5 == 0, "credit us").alias("attribution_text"),
        F.lit(None).cast("string").alias("license_exempt"), F.lit("new").alias("import_mode"),
    )
    return gates.licences(rows, "CC", "u", "credit us")


@query("""
WITH s AS (SELECT n_nationkey, n_regionkey, n_nationkey % 3 AS q, row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 3 ORDER BY n_nationkey) AS k FROM nation)
SELECT 'n' || lpad(n_nationkey::VARCHAR, 3, '0') AS section_key, unnest(list_filter([CASE WHEN k > 1 THEN 'same-sequence' END, CASE WHEN n_nationkey % 4 = 0 THEN 'empty' END], lambda x: x IS NOT NULL)) AS problem FROM s""")
def structure_gate(spark, d):
    """Nations as sections of their regions, in sequences by their key; every fourth has no text."""
    key = F.format_string("n%03d", F.col("n_nationkey"))
    sections = table(spark, d, "nation").select(
        F.lit("w").alias("work"), key.alias("section_key"), F.col("n_regionkey").cast("string").alias("parent_key"), (F.col("n_nationkey") % 3).alias("sequence"), F.col("n_name").alias("title"), F.lit("chapter").alias("section_type"), F.lit("new").alias("import_mode"),
    )
    texts = table(spark, d, "nation").where("n_nationkey % 4 <> 0").select(key.alias("section_key"), F.lit("la").alias("language"), F.lit("some text").alias("content"))
    return gates.structure(sections, texts)


@query("""
WITH r AS (SELECT doc_id, quality, toxic, count(*) OVER (PARTITION BY doc_id // 2) AS k FROM labels)
SELECT (doc_id // 2)::VARCHAR AS id, unnest(list_filter([CASE WHEN k > 1 THEN 'duplicate id' END, CASE WHEN quality = 0 THEN 'category' END, CASE WHEN toxic = 1 THEN 'decided without rung' END,
       CASE WHEN toxic = 1 AND quality = 1 THEN 'no final' END], lambda x: x IS NOT NULL)) AS problem FROM r""")
def ledger_schema(spark, d):
    """Labels as ledger rows whose ids repeat: categories by quality, verdicts by toxicity."""
    none = F.lit(None).cast("string")
    rows = table(spark, d, "labels").select(
        F.expr("cast(doc_id div 2 as string)").alias("id"), F.lit(1).alias("line"), F.lit("u").alias("unit"), F.lit("q").alias("quoted"), F.lit("i").alias("issue"), F.when(F.col("quality") == 1, "omission").otherwise("odd").alias("category"),
        F.when((F.col("toxic") == 1) & (F.col("quality") == 1), "corrected").when(F.col("toxic") == 1, "retained").otherwise("open").alias("verdict"), none.alias("rung"), F.lit("e").alias("evidence"), none.alias("final"), none.alias("proof_target"),
    )
    return gates.ledger_problems(rows).select("id", "problem")


@query("""
SELECT event_id::VARCHAR AS id, unnest(list_filter([CASE WHEN event_type NOT IN ('human', 'retry') THEN 'kind' END, CASE WHEN user_id % 3 = 0 THEN 'status' END,
       CASE WHEN user_id % 3 = 1 AND value < 10 THEN 'closed without why' END], lambda x: x IS NOT NULL)) AS problem FROM events""")
def incident_schema(spark, d):
    """Events as incidents: their types are no kinds, states by the user."""
    status = F.when(F.col("user_id") % 3 == 0, "odd").when(F.col("user_id") % 3 == 1, "fixed-here").otherwise("open")
    rows = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("id"), "ts", F.col("event_type").alias("kind"), F.lit("w").alias("what"), F.lit("read").alias("stage"), status.alias("status"), F.lit(None).cast("string").alias("fix"),
        F.when(F.col("value") >= 10, "because").alias("why"),
    )
    return gates.incident_problems(rows, "quire")


@query(r"""
WITH t AS (SELECT doc_id, text, regexp_extract(text, '\p{L}+') AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT *, instr(text, w) - 1 AS s FROM t WHERE w <> '')
SELECT t.doc_id, sha256(CASE WHEN p.w IS NULL THEN t.text WHEN p.doc_id % 5 = 0 THEN t.text ELSE left(t.text, p.s) || '<' || p.w || '>' || substr(t.text, p.s + length(p.w) + 1) END) AS sha256, coalesce(p.doc_id % 5 = 0, false) AS refused
FROM t LEFT JOIN p USING (doc_id)""")
def span_edits(spark, d):
    """Each text's first word is put in brackets at its span; every fifth edit is stale and refused."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    word = F.regexp_extract("text", r"\p{L}+", 0)
    at = F.expr(r"instr(text, regexp_extract(text, '\\p{L}+', 0)) - 1").cast("long")
    edits = docs.where(word != "").select("doc_id", at.alias("start"), (at + F.length(word)).alias("end"), F.when(F.col("doc_id") % 5 == 0, F.concat(word, F.lit("?"))).otherwise(word).alias("was"), F.concat(F.lit("<"), word, F.lit(">")).alias("new"))
    done, refused = sites.apply_edits(docs, edits, "doc_id")
    return done.join(refused.select("doc_id", F.lit(True).alias("refused")), "doc_id", "left").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.coalesce("refused", F.lit(False)).alias("refused"))


@query(r"""
WITH t AS (SELECT doc_id, text, regexp_extract(text, '\p{L}+') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (instr(text, w) - 1)::BIGINT AS "at" FROM t WHERE w <> '' AND len(string_split(text, w)) = 2""")
def unique_anchors(spark, d):
    """Where a text's first word stands, if its letters occur once in the text."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return sites.unique_anchors(docs.select("doc_id", F.regexp_extract("text", r"\p{L}+", 0).alias("phrase")), docs, "doc_id").select("doc_id", "at")


@query("""
WITH u AS (SELECT user_id AS page, CASE WHEN event_id % 7 = 0 THEN 200 WHEN event_id % 7 < 3 THEN 503 ELSE 404 END AS status, ts, event_id FROM events),
l AS (SELECT page, arg_max(status, event_id) AS status FROM u GROUP BY page)
SELECT CASE WHEN status BETWEEN 200 AND 299 THEN 'done' WHEN status IS NULL OR status = 429 OR status >= 500 THEN 'waiting' ELSE 'failed' END AS state, count(*) AS n
FROM (SELECT DISTINCT c_custkey AS page FROM customer) LEFT JOIN l USING (page) GROUP BY 1""")
def batch_state(spark, d):
    """Customers as pages, events as answers to their uploads."""
    status = F.when(F.col("event_id") % 7 == 0, 200).when(F.col("event_id") % 7 < 3, 503).otherwise(404)
    uploads = table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("ts"), status.alias("status"))
    return sites.batch_state(table(spark, d, "customer").select(F.col("c_custkey").alias("page")), uploads, "same", "same")


@query("""
SELECT what, value, count(*) AS n FROM (
  SELECT unnest(['verdict', 'category', CASE WHEN toxic = 1 THEN 'rung' END]) AS what, unnest([CASE WHEN toxic = 1 THEN 'corrected' ELSE 'open' END, CASE WHEN quality = 1 THEN 'omission' ELSE 'addition' END, 'scan']) AS value
  FROM labels) WHERE what IS NOT NULL GROUP BY 1, 2""")
def ledger_summary(spark, d):
    """Labels as ledger rows, counted by verdict, category and rung."""
    rows = table(spark, d, "labels").select(F.when(F.col("toxic") == 1, "corrected").otherwise("open").alias("verdict"), F.when(F.col("quality") == 1, "omission").otherwise("addition").alias("category"), F.lit("scan").alias("rung"))
    return ledger.summary(rows)
