"""Form-frequency dictionaries and decisions against them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import fold_accents, tokens
from quire.functions.unicode import class_count, class_pattern, words_of

#: Forms of old print, left out of a dictionary: j, qv, and any long s, ligature, accent or abbreviation mark.
PRINT_FORM = "[jJ]|[qQ][vV]|" + class_pattern()
#: Lists of up to so many digests of texts with copies are broadcast.
MOST_COPIES = 1_000_000
# Ordered rewrites that tell spelling variants, and a spelling map (form, edition; equal ones shield).
REWRITES = (("ae", "e"), ("oe", "e"), ("ph", "f"), ("th", "t"), ("ch", "c"), ("y", "i"), ("ti", "ci"), ("ss", "s"), ("nn", "n"), ("tt", "t"))
SPELLING = (("theat", "that"), ("ther", "their"), ("there", "there"), ("thr", "tr"), ("on", "un"), ("one", "one"), ("wh", "w"), ("le", "la"), ("les", "les"), ("an", "ane"))


def is_print_form(form: Column) -> Column:
    """Whether a form matches PRINT_FORM."""
    return form.rlike("[jJ]|[qQ][vV]") | (class_count(form) > 0)


def build(docs: DataFrame, text: str = "text", by: str | None = None, exclude: Callable[[Column], Column] = is_print_form) -> DataFrame:
    """(form, n), for each ``by`` value if given: lower-case letter tokens of the distinct texts, without excluded forms. [A1, T1, O4]

    Equal texts have equal tokens, so the tokens of texts with c copies are counted in all copies and divided by c: only digests are
    grouped, and only the list of those with copies meets the texts: by broadcast if it counts as small, so that texts aren't shuffled.
    """
    keys = [by] if by else []
    rows = docs.select(*keys, text).where(F.col(text).isNotNull()).withColumn("_d", F.unhex(F.sha2(F.col(text).cast("binary"), 256)))
    copies = rows.groupBy(F.col("_d").alias("_of"), *[F.col(k).alias("_by") for k in keys]).agg(F.count("*").alias("_c")).where("_c > 1")
    copies = F.broadcast(copies) if copies.count() <= MOST_COPIES else copies
    on = F.col("_d") == F.col("_of")
    if by:
        on = on & F.col(by).eqNullSafe(F.col("_by"))
    # the outer form: else Spark asks for the arrays' sizes first, which makes them twice
    met = rows.join(copies, on, "left").select(*keys, F.coalesce("_c", F.lit(1)).alias("_c"), F.explode_outer(words_of(F.col(text))).alias("form"))
    forms = met.groupBy(*keys, "_c", "form").agg(F.count("*").alias("n")).where("form is not null")
    # asked of n too, so that Spark can't ask it of each token before they are counted
    kept = F.when(F.col("n") > 0, ~exclude(F.col("form")))
    return forms.where(kept).groupBy(*keys, F.lower("form").alias("form")).agg(F.sum(F.expr("n div _c")).alias("n"))


def out_of_vocabulary(texts: DataFrame, lexicon: DataFrame, least_length: int = 4, min_count: int = 1, text: str = "text") -> DataFrame:
    """(form, n) of the tokens whose dictionary count is under ``min_count``. [J1]"""
    seen = texts.select(F.explode(tokens(F.col(text))).alias("form")).where(F.length("form") >= least_length).groupBy("form").agg(F.count("*").alias("n"))
    return seen.join(lexicon.where(F.col("n") >= min_count).select("form"), "form", "left_anti")


def near_misses(lexicon: DataFrame, rare: int = 1, common: int = 200, least_length: int = 5, same: Callable[[Column], Column] | None = None) -> DataFrame:
    """(form, best, best_n): rare forms one edit (also an adjacent swap) from a common form, by joining one-letter deletions; of several the most frequent. With ``same``, only forms of which it says the same meet. [J2]"""
    cuts = lambda c: F.concat(F.array(F.col(c)), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(F.col(c), F.lit(1), i - 1), F.substr(F.col(c), i + 1))))
    low = lexicon.where((F.col("n") <= rare) & (F.length("form") >= least_length)).select("form", F.explode(F.array_distinct(cuts("form"))).alias("cut"))
    high = lexicon.where(F.col("n") >= common).select(F.col("form").alias("best"), F.col("n").alias("best_n"))
    high = high.withColumn("cut", F.explode(F.array_distinct(cuts("best"))))
    swap = F.expr("length(form) = length(best) and exists(sequence(1, length(form)), i -> concat(substr(form, 1, i - 1), substr(form, i + 1, 1), substr(form, i, 1), substr(form, i + 2)) = best)")
    met = low.join(high, "cut").where((F.levenshtein("form", "best") == 1) | swap)
    met = met.where(same(F.col("form")) == same(F.col("best"))) if same else met
    return met.groupBy("form").agg(F.max(F.struct("best_n", "best")).alias("m")).select("form", "m.best", "m.best_n")


def fold_variants(lexicon: DataFrame) -> DataFrame:
    """(key, n_forms, total) of forms that merge when accents are folded. [T2]"""
    return lexicon.groupBy(fold_accents(F.col("form")).alias("key")).agg(F.count("*").alias("n_forms"), F.sum("n").alias("total")).where("n_forms > 1")


def respell(lexicon: DataFrame, rows=SPELLING) -> DataFrame:
    """(form, new, n): the longest listed prefix decides; a row whose edition is its form shields. [T9, A7]"""
    spark = lexicon.sparkSession
    table = F.broadcast(spark.createDataFrame(list(rows), "old string, edition string"))
    tried = lexicon.withColumn("old", F.explode(F.expr("transform(sequence(1, length(form)), k -> substr(form, 1, k))"))).join(table, "old")
    best = tried.groupBy("form", "n").agg(F.max_by(F.struct("old", "edition"), F.length("old")).alias("b"))
    return best.where("b.old <> b.edition").select("form", F.concat("b.edition", F.expr("substr(form, length(b.old) + 1)")).alias("new"), "n")


def respell_words(words: DataFrame, rows: DataFrame) -> DataFrame:
    """(word, new, form) for words that a spelling map changes; rows are (form, edition, ending). [T9]

    The longest form that a word begins with decides, one for whole words (``form$``) before others of its length. A form with a capital minds case, but
    also meets words in capitals. ``ending`` rows meet the end of longer words. A row whose edition is its form keeps the word. The case
    of the word stays.
    """
    from quire.operators.expand import recased

    table = rows.select(F.regexp_replace("form", r"\$$", "").alias("form"), "edition", F.coalesce("ending", F.lit(False)).alias("ending"), F.col("form").endswith("$").alias("whole"))
    table = table.withColumns({"exact": F.col("form") != F.lower("form"), "_key": F.lower("form")})
    words = words.select("word").distinct().withColumn("low", F.lower("word"))
    heads = words.select("word", "low", F.explode(F.expr("transform(sequence(1, length(low)), k -> substr(low, 1, k))")).alias("_key"), F.lit(False).alias("_tail"))
    tails = words.where("length(low) > 1").select("word", "low", F.explode(F.expr("transform(sequence(2, length(low)), k -> substr(low, k))")).alias("_key"), F.lit(True).alias("_tail"))
    met = heads.unionByName(tails).join(table, "_key").where("ending = _tail and (not whole or length(form) = length(low))")
    upper = (F.col("word") == F.upper("word")) & (F.col("word") != F.lower("word"))
    fits = ~F.col("exact") | F.col("word").startswith(F.col("form")) | (upper & F.col("word").startswith(F.upper("form")))
    best = met.where(fits).groupBy("word", "low").agg(F.max(F.struct(F.length("form").alias("n"), "whole", "form", "edition", "ending")).alias("b")).select("word", "low", "b.*")
    ended = F.concat(F.expr("substr(word, 1, length(word) - n)"), "edition")
    new = F.when(F.col("ending"), F.when(upper & (F.length("word") > 1), F.upper(ended)).otherwise(ended)).otherwise(recased(F.col("word"), F.concat("edition", F.expr("substr(low, n + 1)"))))
    return best.where("edition <> form").select("word", new.alias("new"), "form").where("new <> word")


def pair_majority(docs: DataFrame, pairs, by: str = "source") -> DataFrame:
    """(by, a, b, n_a, n_b, winner) of two spellings counted over a work; ties go to the first, and only pairs with both are returned. [A6]"""
    table = docs.sparkSession.createDataFrame(list(pairs), "a string, b string")
    sides = F.broadcast(table.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("form"), F.lit(1).alias("first")), F.struct(F.col("b").alias("form"), F.lit(0).alias("first")))).alias("x")).select("a", "b", "x.*"))
    met = docs.select(by, F.explode(tokens(F.col("text"))).alias("form")).join(sides, "form")
    out = met.groupBy(by, "a", "b").agg(F.count_if(F.col("first") == 1).alias("n_a"), F.count_if(F.col("first") == 0).alias("n_b"))
    return out.where("n_a > 0 and n_b > 0").withColumn("winner", F.when(F.col("n_a") >= F.col("n_b"), F.col("a")).otherwise(F.col("b")))


def spelling_candidates(lexicon: DataFrame, floor: int = 5, top: int = 60) -> DataFrame:
    """(form, other, n, other_n): both frequent, other being the form with one rewrite at its first occurrence; the most frequent pairs. [A8, O1]"""
    first = lambda a, b: F.when(F.instr("form", a) > 0, F.concat(F.expr(f"substr(form, 1, instr(form, '{a}') - 1)"), F.lit(b), F.expr(f"substr(form, instr(form, '{a}') + {len(a)})")))
    often = lexicon.where(F.col("n") >= floor)
    tried = often.select("form", "n", F.explode(F.array_distinct(F.array(*[first(a, b) for a, b in REWRITES]))).alias("other")).where("other is not null")
    met = tried.join(often.select(F.col("form").alias("other"), F.col("n").alias("other_n")), "other")
    return met.select("form", "other", "n", "other_n").orderBy(F.desc(F.least("n", "other_n")), "form", "other").limit(top)


def occurrences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, form, occurrence): the how-manieth of its form in the text each token is. [W6, J6]"""
    rows = docs.select(key, F.posexplode(tokens(F.col("text"))).alias("pos", "form"))
    return rows.withColumn("occurrence", F.row_number().over(W.partitionBy(key, "form").orderBy("pos")))


def decide(rows: DataFrame, levels: list[tuple[DataFrame, list[str]]], value: str = "decision", default: Column | None = None) -> DataFrame:
    """Add ``value`` from the first of several lookup tables, most specific first, that has the row's keys. [J6]"""
    names = []
    for i, (table, keys) in enumerate(levels):
        names.append(f"_{i}")
        rows = rows.join(table.select(*keys, F.col(value).alias(names[-1])), keys, "left")
    found = F.coalesce(*map(F.col, names), default if default is not None else F.lit(None).cast("string"))
    return reduce(lambda d, n: d.drop(n), names, rows.withColumn(value, found))
