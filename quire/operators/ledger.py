"""The defects ledger: which text a row is about, whether its verdict shows there, and fixtures that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.unicode import composed

# Older names of categories and verdicts.
CATEGORY_NAMES = {"latin-dubious": "misreading", "latin-apparently-wrong": "misreading", "normalization-suspect": "normalization", "translation-difficult": "translation"}
VERDICT_NAMES = {"retained-as-printed": "retained", "resolved": "corrected", "review": "open", "unresolved": "open"}
COMMENT, NOTE, EDITORS = r"(?s)<!--.*?-->", r"\^\[[^\]]*\]", r"(?i)Editor['’]s note"
RUN = r"[\p{L}\p{N}_-]+"


def renamed(rows: DataFrame) -> DataFrame:
    """Ledger rows with today's category and verdict; the verdict is open and the layer la where they have none. [S3]"""
    name = lambda c, names: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col(c)), F.col(c))
    return rows.withColumns({"category": name("category", CATEGORY_NAMES), "verdict": name("verdict", VERDICT_NAMES) if "verdict" in rows.columns else F.lit("open")}).fillna({"verdict": "open", "layer": "la"})


def plain(text: Column) -> Column:
    return F.regexp_replace(composed(text), r"\s+", " ")


def _within(a: str, b: str) -> Column:
    """Whether the value of column ``a`` stands in ``b`` with no letter, digit, _ or - beside it."""
    return F.expr(rf"{b} rlike concat('(?<![\\p{{L}}\\p{{N}}_-])\\Q', {a}, '\\E(?![\\p{{L}}\\p{{N}}_-])')")


def scope(rows: DataFrame, layer: DataFrame) -> DataFrame:
    """Add text: the layer's (unit, text) that a row (id, unit, pg) is about: its own unit, else units that contain its key or lie in it, joined by blank lines, else its page; null if none. [J16]

    Containment is an equi-join on the runs of the two keys, then checked; texts are joined by row, never crossed.
    """
    keys = layer.select(F.col("unit").alias("key"))
    exact = rows.select("id", "unit").join(keys, F.col("unit") == F.col("key")).select("id", "key").withColumn("rank", F.lit(0))
    runs = lambda df, c: df.withColumn("run", F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(RUN), F.lit(0)))))
    met = runs(rows.select("id", "unit"), F.col("unit")).join(runs(keys, F.col("key")), "run").select("id", "unit", "key").distinct()
    near = met.where(_within("unit", "key") | _within("key", "unit")).select("id", "key").withColumn("rank", F.lit(1))
    page = rows.select("id", "pg").join(keys, F.col("pg") == F.col("key")).select("id", "key").withColumn("rank", F.lit(2))
    hits = exact.unionByName(near).unionByName(page)
    best = hits.groupBy(F.col("id").alias("_id")).agg(F.min("rank").alias("_rank"))
    hits = hits.join(best, (F.col("id") == F.col("_id")) & (F.col("rank") == F.col("_rank"))).select("id", "key")
    texts = hits.join(layer.select(F.col("unit").alias("key"), "text"), "key").groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return rows.join(texts, "id", "left")


def triage(rows: DataFrame, layer: DataFrame) -> DataFrame:
    """Open rows whose quoted words no longer occur where they were raised, white space and composition apart. [J16]"""
    open_rows = scope(rows.where("verdict = 'open'"), layer).where("text is not null")
    return open_rows.where(~plain(F.col("text")).contains(plain(F.col("quoted")))).drop("text")


def _whole_word(text: Column, needle: Column) -> Column:
    word = r"[\p{L}\p{N}_]"
    left = F.when(needle.rlike(f"^{word}"), rf"(?<!{word})").otherwise("")
    right = F.when(needle.rlike(f"{word}$"), rf"(?!{word})").otherwise("")
    return F.rlike(text, F.concat(left, F.lit(r"\Q"), needle, F.lit(r"\E"), right))


def seam_words(pages: DataFrame) -> DataFrame:
    """(unit, seams): a page with the next one, and the words that a line or a note cuts between them joined. Units are pg-<n>. [T15, J17]"""
    numbered = pages.where(F.col("unit").rlike(r"^pg-\d+$")).select("unit", "text", F.regexp_extract("unit", r"(\d+)$", 1).cast("long").alias("n"))
    both = numbered.alias("a").join(numbered.alias("b"), F.col("b.n") == F.col("a.n") + 1)
    text = F.regexp_replace(F.concat_ws("\n\n", "a.text", "b.text"), COMMENT, "")
    rows = both.select(F.col("a.unit").alias("unit"), text.alias("t"))
    joined = F.regexp_replace(F.col("t"), r"(?<=[\p{L}\p{N}_])-\s*\n\s*(?=[\p{L}\p{N}_])", "")
    noted = F.regexp_extract_all("t", F.lit(r"(?s)([\p{L}\p{N}_]+)-⟦NOTE-CONTINUES⟧.*?⟦CONTINUED-NOTE⟧([\p{L}\p{N}_]+)"), F.lit(1))
    ends = F.regexp_extract_all("t", F.lit(r"(?s)([\p{L}\p{N}_]+)-⟦NOTE-CONTINUES⟧.*?⟦CONTINUED-NOTE⟧([\p{L}\p{N}_]+)"), F.lit(2))
    return rows.select("unit", F.concat_ws("\n", "t", joined, F.array_join(F.zip_with(noted, ends, lambda a, b: F.concat(a, b)), "\n")).alias("seams"))


def prove(rows: DataFrame, layer: DataFrame, name: str, language: str | None = None) -> DataFrame:
    """(id, layer, problem): rows that are still open, and corrected or noted rows whose verdict the layer doesn't show. [J17]

    The final reading must stand in the text without comments: as it is, without its notes' numbers, without notes, or over a page's seam. The old
    reading must be gone as a whole word outside the editor's notes, unless the final holds it or says ``so the print``. A noted row needs an
    editor's note. A layer of pages, or of a language, is only asked for rows of its language.
    """
    undecided = rows.where("verdict = 'open'").select("id", F.lit(name).alias("layer"), F.lit("open").alias("problem"))
    asked = rows.where("verdict in ('corrected', 'editorial-note')")
    asked = asked.where(F.col("layer") == (language or "la")) if language or name.startswith("pages") else asked
    found = scope(asked, layer).join(seam_words(layer).withColumnRenamed("unit", "_page"), F.coalesce("pg", "unit") == F.col("_page"), "left")
    body = F.regexp_replace("text", COMMENT, "")
    unnumbered = lambda c: F.regexp_replace(c, r"\^\[\d+\.\s*", "^[")
    found = found.withColumns({"_raw": body, "_final": unnumbered(plain(F.col("final"))), "_quoted": plain(F.col("quoted"))})
    found = found.withColumns({"_text": unnumbered(plain(F.col("_raw"))), "_seams": F.coalesce(unnumbered(plain(F.col("seams"))), F.lit(""))})
    there = F.col("_text").contains(F.col("_final")) | F.regexp_replace("_text", NOTE, "").contains(F.col("_final")) | F.col("_seams").contains(F.col("_final"))
    own = F.regexp_replace(F.regexp_replace("_text", r"(?i)\^\[(?:\d+\.\s*)?Editor['’]s note[^\]]*\]", ""), r"Editor['’]s note:[^\]]*", "")
    left = ~F.col("_final").contains(F.col("_quoted")) & ~F.col("_final").rlike(r"(?i)\^\[[^\]]*so the print") & _whole_word(own, F.col("_quoted"))
    problems = F.array_compact(F.array(
        F.when(F.col("text").isNull(), "unit not found").when(~there, "final not there").when(left, "old reading still there"),
        F.when(F.col("text").isNotNull() & (F.col("verdict") == "editorial-note") & ~F.col("_text").rlike(EDITORS), "no editor's note"),
    ))
    return undecided.unionByName(found.select("id", F.lit(name).alias("layer"), F.explode(problems).alias("problem")))


def prove_metadata(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, problem): corrected rows about a page's own fields (joins-next, catchword, running-head), which live in its comments. [J17]"""
    asked = rows.where("verdict = 'corrected' and proof_target = 'page_metadata'").join(pages.select(F.col("unit").alias("_page"), "text"), F.coalesce("pg", "unit") == F.col("_page"), "left")
    comments = F.array_join(F.regexp_extract_all("text", F.lit(r"(?s)<!--(.*?)-->"), F.lit(1)), "\n")
    fields = F.transform(F.regexp_extract_all(comments, F.lit(r"(?<![\w-])((?:joins-next|catchword|running-head):\s*[^;\n]+)"), F.lit(1)), lambda x: F.regexp_replace(F.trim(x), r":\s*", ": "))
    final = F.regexp_replace(F.trim("final"), r":\s*", ": ")
    old = ~final.contains(F.col("quoted")) & comments.contains(F.col("quoted"))
    problem = F.when(F.col("text").isNull(), "page not found").when(~F.array_contains(fields, final), "final not there").when(old, "old value still there")
    return asked.select("id", problem.alias("problem")).where("problem is not null")


def summary(rows: DataFrame) -> DataFrame:
    """(what, value, n): rows by verdict, by category, and by rung for decided ones. [A11]"""
    sides = F.array(F.struct(F.lit("verdict").alias("what"), F.col("verdict").alias("value")), F.struct(F.lit("category").alias("what"), F.col("category").alias("value")), F.when(F.col("verdict") != "open", F.struct(F.lit("rung").alias("what"), F.col("rung").alias("value"))))
    return rows.select(F.explode(F.array_compact(sides)).alias("x")).groupBy("x.what", "x.value").agg(F.count("*").alias("n"))


def fixtures(rows: DataFrame, late: tuple[str, ...] = ("preflight", "translate", "align", "stage", "replay", "review")) -> DataFrame:
    """(id, kind, bad, correct, late) that a ledger yields for replays: reading fixtures with a page and an expected text, gate fixtures with a bad one. [X3]

    The correct text is the final one of corrected and noted rows, the quoted one of retained rows; late rows were raised by a late stage.
    """
    correct = F.when(F.col("verdict").isin("corrected", "editorial-note"), F.col("final")).when(F.col("verdict") == "retained", F.col("quoted"))
    kind = F.when(F.col("bad").isNotNull(), "gate").when(F.col("pg").isNotNull() & correct.isNotNull(), "reading")
    return rows.select("id", kind.alias("kind"), "bad", correct.alias("correct"), F.lower(F.coalesce("raised_by", F.lit(""))).rlike("|".join(late)).alias("late")).where("kind is not null")
