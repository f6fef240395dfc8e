"""Queries over the spelling map, readers, manifests, bound joins and published editions; texts that the tables lack are derived from them by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import assemble, house, manifest
from quire.plans.catalog import query, table
from quire.sources import corpus, editions
from quire.sources.shared import new_folder

# A spelling map and its pairs for the tables' invented words.
HOUSE = (("theat", "that"), ("ther", "their"), ("there", "there"), ("on", "un"), ("one$", "one"), ("Wh", "Vh"), ("le", "la"), ("les", "les"), ("an", "ane"), ("of$", "off"))
PAIRS = (("was", "is", "word"), ("ed", "et", "ending"), ("the", "to", "prefix"))
_MAP = ", ".join(
    [f"('{f.rstrip('$')}', '{e}', '{'word' if f.endswith('$') else 'prefix'}', {str(f != f.lower()).lower()}, -1, {i})" for i, (f, e) in enumerate(HOUSE)]
    + [f"('{x}', '{y}', '{kind}', false, {2 * k + side}, {100 + 2 * k + side})" for k, (a, b, kind) in enumerate(PAIRS) for side, (x, y) in enumerate(((a, b), (b, a)))]
)
_SIDES = ", ".join(f"('{x}', '{kind}', {k}, {side})" for k, (a, b, kind) in enumerate(PAIRS) for side, x in enumerate((a, b)))


def spelling_map() -> house.SpellingMap:
    dressed = {"word": "{}$", "ending": "-{}", "prefix": "{}"}
    pairs = [("|".join(dressed[kind].format(x) for x in (a, b)), "majority", "both are written") for a, b, kind in PAIRS]
    return house.SpellingMap([(f, e, "house") for f, e in HOUSE] + pairs)


@query(rf"""
WITH m(form, edition, kind, exact, side, nth) AS (VALUES {_MAP}), s(form, kind, pair, side) AS (VALUES {_SIDES}),
w AS (SELECT source, word, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(text, '[\p{{L}}\p{{Nl}}\p{{No}}]+')) AS word FROM documents) GROUP BY ALL),
c AS (SELECT source, pair, side, sum(n) AS n FROM (
    SELECT DISTINCT ON (source, word, pair) source, word, n, pair, s.side FROM w JOIN s
      ON CASE s.kind WHEN 'word' THEN lower(word) = s.form WHEN 'prefix' THEN starts_with(lower(word), s.form) ELSE ends_with(lower(word), s.form) AND length(word) > length(s.form) END
    ORDER BY source, word, pair, s.side) GROUP BY ALL),
j AS (SELECT a.source, 2 * a.pair + CASE WHEN a.n >= b.n THEN 1 ELSE 0 END AS lost FROM c a JOIN c b ON a.source IS NOT DISTINCT FROM b.source AND a.pair = b.pair AND a.side = 0 AND b.side = 1),
x AS (SELECT w.source, word, n, m.*, word = upper(word) AND word <> lower(word) AS caps FROM w JOIN m
      ON CASE m.kind WHEN 'word' THEN lower(word) = lower(m.form) WHEN 'prefix' THEN starts_with(lower(word), lower(m.form)) ELSE ends_with(lower(word), m.form) AND length(word) > length(m.form) END
      WHERE (m.side < 0 OR EXISTS (FROM j WHERE j.source IS NOT DISTINCT FROM w.source AND j.lost = m.side))
        AND (NOT exact OR starts_with(word, CASE WHEN word = upper(word) AND word <> lower(word) THEN upper(m.form) ELSE m.form END))),
b AS (SELECT *, CASE WHEN kind = 'ending' THEN left(lower(word), length(word) - length(form)) || edition ELSE edition || substr(lower(word), length(form) + 1) END AS raw
      FROM x QUALIFY row_number() OVER (PARTITION BY source, word ORDER BY length(form) DESC, kind <> 'word', nth) = 1),
r AS (SELECT source, word AS old, n, form, edition, CASE WHEN caps AND length(word) > 1 THEN upper(raw) WHEN kind = 'ending' THEN word[1] || substr(raw, 2)
             WHEN word[1] = upper(word[1]) AND word[1] <> lower(word[1]) THEN upper(raw[1]) || substr(raw, 2) ELSE raw END AS new FROM b WHERE edition <> form)
SELECT source, old, new, form, n FROM r WHERE old <> new""")
def house_residual(spark, d):
    """What the map would change in all documents; the pairs are decided for each source."""
    docs = table(spark, d, "documents")
    return house.residual(docs.where("text is not null"), spelling_map(), ["source"], work=["source"])


@query("SELECT doc_id, length(text) AS n_chars, true AS in_place FROM documents")
def jsonl_lines(spark, d):
    """All documents written as JSON lines, each with the number of its line in its file, and read again with line numbers."""
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    home = new_folder(spark, "jsonl")
    table(spark, d, "documents").withColumn("nth", nth).select(F.to_json(F.struct("doc_id", "text", "nth")).alias("value")).write.text(home)
    rows = corpus.read_rows(spark, home, "doc_id long, text string, nth long")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), (F.col("line") == F.col("nth")).alias("in_place"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, p, p // 3 AS g, trim(regexp_replace(replace(replace(regexp_replace(line, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&copy;', '©'), '\s+', ' ', 'g')) AS t FROM l),
h AS (SELECT doc_id, g, coalesce(max(t) FILTER (p % 3 = 0), '') AS title, coalesce(string_agg(t, ' ' ORDER BY p) FILTER (p % 3 > 0 AND t <> ''), '') AS text FROM c GROUP BY ALL),
n AS (SELECT *, unnest(CASE WHEN g % 2 = 1 THEN [2 * g + 1, 2 * g + 2] ELSE [2 * g + 1] END) AS cap FROM h)
SELECT doc_id::VARCHAR AS work, cap, title, text FROM n""")
def edition_chapters(spark, d):
    """Each document as an edition file: every third line is a chapter's title, every other chapter a pair ``N-M``."""
    p, g = F.col("pos"), F.expr("pos div 3")
    low = (2 * g + 1).cast("string")
    caps = F.when(g % 2 == 1, F.concat(low, F.lit("-"), (2 * g + 2).cast("string"))).otherwise(low)
    header = F.concat(F.lit("["), p.cast("string"), F.lit("] Super Librum, lib. 1 cap. "), caps, F.lit(" "), F.when(p % 3 == 0, "tit").otherwise("n"), F.lit(". "))
    record = lambda x, i: F.concat(x["header"], x["line"])
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    files = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", header.alias("header"), "line"))).alias("x"))
    files = files.select(F.col("doc_id").cast("string").alias("work"), F.lit("1").alias("path"), F.array_join(F.transform("x", record), "\n").alias("text"))
    return corpus.edition_chapters(files, work="work").select("work", F.col("cap").cast("long").alias("cap"), "title", "text")


@query("""
WITH l AS (SELECT o_orderkey::VARCHAR AS path, l_linenumber AS i, l_partkey, l_returnflag || l_linestatus AS flags, strftime(l_shipdate, '%Y-%m-%d') AS shipped, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT path, 'items/l' || i AS unit, 'la' AS language, flags AS content FROM l UNION ALL SELECT path, 'items/section-' || l_partkey, 'en', shipped FROM l
UNION ALL SELECT path, 'items/section-' || l_partkey, 'la', 'part' FROM l UNION ALL SELECT path, 'items/section-' || l_suppkey, 'de', 'put' FROM l WHERE i % 2 = 0
UNION ALL SELECT o_orderkey::VARCHAR, 'head', 'la', o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT o_orderkey::VARCHAR, 'head/head', 'la', o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def manifest_units(spark, d):
    """Each order as a manifest of two works: its lines with parts below them, and its head; orders without lines have one work."""
    text = lambda lang, c: F.struct(F.lit(lang).alias("language"), c.alias("content"))
    c = F.col

    def section(x):
        part = F.struct(x["l_partkey"].alias("id"), F.lit("article").alias("section_type"), F.struct(F.struct(F.date_format(x["l_shipdate"], "yyyy-MM-dd").alias("content")).alias("en"), F.lit("part").alias("la")).alias("texts"))
        put = F.when(x["l_linenumber"] % 2 == 0, F.array(F.struct(F.lit("put_text").alias("op"), x["l_suppkey"].alias("section_id"), F.lit("de").alias("language"), F.lit("put").alias("content"))))
        own = F.array(text("la", F.concat(x["l_returnflag"], x["l_linestatus"])))
        return F.struct(F.concat(F.lit("l"), x["l_linenumber"]).alias("section_key"), F.lit("slug").alias("slug"), own.alias("texts"), F.array(part).alias("children"), put.alias("ops"))

    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate")
    lines = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("x")).select("o_orderkey", F.transform("x", section).alias("sections"))
    rows = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    head = F.struct(F.lit("head").alias("slug"), F.struct(c("o_orderpriority").alias("la")).alias("texts"), F.lit(None).cast(lines.schema["sections"].dataType).alias("sections"))
    items = F.struct(F.lit("items").alias("slug"), F.lit(None).cast("struct<la:string>").alias("texts"), "sections")
    works = F.when(c("sections").isNull(), F.array(head)).otherwise(F.array(items, head))
    files = rows.select(c("o_orderkey").cast("string").alias("path"), F.to_json(F.struct(works.alias("works"))).alias("text"))
    return manifest.manifest_units(files).select("path", "unit", "language", "content")


_TREE = """s AS (SELECT l_orderkey AS work, 'l' || l_linenumber AS key, CASE WHEN l_linenumber <= 2 THEN 'o' ELSE 'l' || (l_linenumber - 2) END AS parent,
  CASE WHEN l_linenumber % 3 = 0 THEN l_partkey END AS lo, CASE WHEN l_linenumber = 3 THEN l_partkey + l_quantity::BIGINT END AS hi
  FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) UNION ALL SELECT DISTINCT l_orderkey, 'o', NULL, NULL::BIGINT, NULL::BIGINT FROM lineitem)"""


@query(f"""
WITH RECURSIVE {_TREE},
u(work, key, parent, lo, hi, steps) AS (SELECT work, key, parent, lo, coalesce(hi, lo), 0 FROM s WHERE lo IS NOT NULL
  UNION ALL SELECT u.work, s.key, CASE WHEN s.lo IS NULL THEN s.parent END, u.lo, u.hi, steps + 1 FROM u JOIN s ON s.work = u.work AND s.key = u.parent),
b AS (SELECT work, key, min(lo) AS lo, max(hi) AS hi FROM u WHERE steps > 0 GROUP BY ALL),
r AS (SELECT s.work, s.key, CASE WHEN s.lo IS NOT NULL AND s.hi IS NOT NULL THEN s.lo ELSE b.lo END AS lo, CASE WHEN s.lo IS NOT NULL AND s.hi IS NOT NULL THEN s.hi ELSE b.hi END AS hi
      FROM s LEFT JOIN b USING (work, key))
SELECT work, key, CASE WHEN lo = hi THEN 'p. ' || lo ELSE 'pp. ' || lo || '-' || hi END AS locator FROM r WHERE lo IS NOT NULL""")
def manifest_locators(spark, d):
    """Orders as works: a line hangs below the line two before it, every third has pages, and the others take theirs from below."""
    c, i = F.col, F.col("l_linenumber")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_quantity")).alias("x"))
    name = lambda n: F.concat(F.lit("l"), n.cast("string"))
    lines = lines.select(
        c("l_orderkey").alias("work"), name(i).alias("key"), F.when(i <= 2, "o").otherwise(name(i - 2)).alias("parent"),
        F.when(i % 3 == 0, c("x.l_partkey")).alias("printed_start"), F.when(i == 3, c("x.l_partkey") + c("x.l_quantity").cast("long")).alias("printed_end"),
    )
    none = F.lit(None).cast("long")
    roots = lines.select("work").distinct().select("work", F.lit("o").alias("key"), F.lit(None).cast("string").alias("parent"), none.alias("printed_start"), none.alias("printed_end"))
    return manifest.locators(lines.unionByName(roots), ["work"])


@query(r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id::VARCHAR AS key, CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '\s+')) END AS words, sha256(t) AS sha256 FROM t""")
def edition_publish(spark, d):
    """All documents published as one edition's sections; what a reader then finds in its record."""
    docs = table(spark, d, "documents")
    name = F.col("doc_id").cast("string")
    store = editions.EditionStore(spark, new_folder(spark, "edition"))
    pages = docs.select(name.alias("name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    none = spark.createDataFrame([], "key string, problem string")
    store.publish(docs.select(name.alias("key"), F.col("text").alias("body")), pages, none)
    return store.record()


@query(r"""
WITH p AS (SELECT doc_id AS n, coalesce(text, '') AS body, sha256(coalesce(text, '')) AS sha FROM documents),
x AS (SELECT r.n, l.body AS l_body, CASE WHEN r.n % 15 = 0 THEN 'hyphen' WHEN r.n % 35 = 0 THEN 'glue' ELSE 'space' END AS j, r.n % 10 = 0 AS blank, r.n % 3 = 0 AND l.n IS NOT NULL AS same
      FROM p r LEFT JOIN p l ON l.n = r.n - 1 WHERE r.n % 5 = 0)
SELECT n, CASE WHEN l_body IS NULL THEN 'unknown boundary' WHEN j = 'glue' THEN 'invalid join' WHEN blank THEN 'no evidence' WHEN NOT same THEN 'stale page hash'
               WHEN j = 'hyphen' AND NOT regexp_matches(regexp_replace(l_body, '\s+$', ''), '-[*_]*$') THEN 'no printed hyphen' ELSE 'holds' END AS verdict FROM x""")
def bound_joins(spark, d):
    """Every fifth document has a decision on how it goes on from the one before: some on another text, some without evidence, some of an unknown kind."""
    docs = table(spark, d, "documents")
    body, n = F.coalesce("text", F.lit("")), F.col("n")
    pages = docs.select(F.lit("w").alias("work"), F.col("doc_id").alias("n"), body.alias("body"), F.sha2(body, 256).alias("sha256"))
    left = pages.select((n + 1).alias("n"), F.col("sha256").alias("left"))
    some = pages.where(n % 5 == 0).join(left, "n", "left")
    decisions = some.select(
        "work", "n", F.when(n % 15 == 0, "hyphen").when(n % 35 == 0, "glue").otherwise("space").alias("join"), F.lit(None).cast("boolean").alias("printed_hyphen"),
        F.when(n % 3 == 0, F.col("left")).otherwise("another").alias("left_sha256"), F.col("sha256").alias("right_sha256"), F.when(n % 10 == 0, " ").otherwise("seen on the scan").alias("evidence"),
    )
    good, problems = assemble.bound_joins(pages, decisions)
    return good.select("n", F.lit("holds").alias("verdict")).unionByName(problems.select("n", F.col("problem").alias("verdict")))
