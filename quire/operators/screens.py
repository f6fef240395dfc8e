"""Validation screens: each returns findings, or counts per unit so that a clean unit shows as zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import ends_open, lines, starts_lower, tokens, words
from quire.functions.unicode import CLASSES, class_count, composed
from quire.operators.order import positions

# Residue labels with their patterns, and the scripts counted as foreign.
RESIDUE = (("stray-asterisks", r"\*\*\*"), ("comment", r"<!--"), ("todo", r"TODO|XXX"), ("uncertain", r"\[\?\]"), ("wrapper", r"<<<|>>>"), ("soft-hyphen", "­"), ("url", r"https?://"), ("email", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+"))
# What may not be left in a text that is published, a space before a Latin stop, and words that hand work on.
LEFTOVERS = (
    ("sentinel", r"[⟦⟪][^⟧⟫]*[⟧⟫]"), ("html comment", r"<!--"), ("zone marker", r"<<<|>>>"), ("wrapper tag", r"</?content>"), ("soft hyphen", "\u00ad"), ("uncertainty mark", r"(?i)\[illegible|\[\?\]|\(\?\)"),
    ("todo", r"(?<![A-ZÁÉÍÓÚÜÑ] )\b(?:TODO|TBD|FIXME)\b(?! [A-ZÁÉÍÓÚÜÑ]{2})|(?<![IVXLCDM])XXX(?![IVXLCDM]|[.,]? ?\p{Lu})"), ("placeholder", r"\[(?:Block|Translation|Paragraph) \d+[^\]]*\]"),
    ("stray asterisk", r"(?<=\s)\*+(?=\s)"), ("italic numeral", r"(?m)^(?:\d+\*\.|\*\d+\.\*)\s"), ("note cut mid-word", r"\p{L}-\s*\]"),
    ("unfinished note", r"(?i)Editor['’]s note:[^\]]*?(?:no continuation|ends the note here|note (?:is )?(?:cut|truncated))"),
)
SPACE_BEFORE = r"(?m)(?<=[^\s\"'“‘«(\[{—–-])[ \t]+[,;:!?](?=\s|$)"
SCRIPTS = ("Cyrillic", "Greek", "Hebrew", "Arabic", "Han")
LIGATURES, ACCENTS = "æœÆŒﬀﬁﬂﬃﬄﬅﬆ", "àáâèéêìíîòóôùúûÀÁÂÈÉÊÌÍÎÒÓÔÙÚÛ"


def unit_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.explode(lines(F.col(text))).alias("x")).select(key, "x.pos", "x.line")


def char_inventory(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(ch, category, n, docs) of non-ASCII characters. [T22]"""
    rows = docs.select(key, F.explode(F.regexp_extract_all("text", F.lit(r"[^\x00-\x7F]"), F.lit(0))).alias("ch"))
    kind = F.when(F.instr(F.lit(LIGATURES), F.col("ch")) > 0, "ligature").when(F.instr(F.lit(ACCENTS), F.col("ch")) > 0, "accent").otherwise("other")
    return rows.groupBy("ch").agg(F.count("*").alias("n"), F.count_distinct(key).alias("docs")).withColumn("category", kind)


def scripts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hard, soft): characters of foreign scripts in each unit; Greek is soft. [P2]"""
    hard = "|".join(rf"\p{{Is{s}}}" for s in SCRIPTS if s != "Greek")
    count = lambda p: F.coalesce(F.regexp_count(F.col(text), F.lit(p)), F.lit(0)).cast("long")
    return docs.select(key, count(hard).alias("hard"), count(r"\p{IsGreek}").alias("soft"))


def orthography(docs: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """(category, token, n): tokens with accents, ligatures or a j, once per category, without allowed ones. [P1]"""
    rows = docs.select(F.explode(words(F.col("text"))).alias("raw")).select(F.regexp_replace("raw", r"[^\p{L}]", "").alias("token")).where("token <> ''")
    seen = rows.groupBy("token").agg(F.count("*").alias("n"))
    kinds = F.array_compact(F.array(F.when(F.col("token").rlike(f"[{ACCENTS}]"), "accent"), F.when(F.col("token").rlike(f"[{LIGATURES}]"), "ligature"), F.when(F.lower("token").contains("j"), "consonantal-j")))
    out = seen.select(F.explode(kinds).alias("category"), "token", "n")
    return out.where(~F.col("token").isin(*allow)) if allow else out


def print_forms(docs: DataFrame, allow: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """(category, token, n) of what an edition may not keep, in how many places: the character classes, once a token each; the -que mark; j, qv, and V for a vowel in capitals; ñ as low-enye. [P1]

    Words between white space are cut at emphasis marks and lose stops and brackets; comments, link targets and the editor's notes are not read.
    """
    body = composed(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", " "), r"\|[^\]|]*\]\]", "]]"), r"\^\[(?:\d+\.\s*)?(?i:Editor['’]s note|Editorial note)[^\[\]]*\]", " "))
    rows = docs.where(F.col(text).isNotNull()).select(body.alias("t"))
    strip = lambda c: F.regexp_replace(c, r"^[.,;:!?()\[\]«»\"'_^]+|[.,;:!?()\[\]«»\"'_^]+$", "")
    pieces = rows.select(F.explode(F.split("t", r"\s+|[*_`]+")).alias("w")).select(strip(F.col("w")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))
    kinds = [F.when(class_count(F.col("token"), k) > 0, k) for k in CLASSES] + [F.when(F.col("token").rlike("[ñÑ]"), "low-enye")]
    found = pieces.select(F.explode(F.array_compact(F.array(*kinds))).alias("category"), "token", "n")
    marks = rows.select(F.explode(F.regexp_extract_all("t", F.lit(r"\p{L}*[qQ][;:]"), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).select(F.lit("abbrev-mark").alias("category"), "token", "n")
    letters = rows.select(F.explode(F.regexp_extract_all("t", F.lit(r"\p{L}+"), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    token = F.col("token")
    capital = (F.length(token) >= 3) & (token == F.upper(token)) & (token != F.lower(token)) & ~token.rlike("^[IVXLCDM]+$")
    more = [F.when(token.rlike("[jJ]"), "consonantal-j"), F.when(capital & token.rlike("QV|V(?=[^AEIOUY])|V$"), "caps-v"), F.when(token.rlike("[qQ]v"), "qv")]
    found = found.unionByName(marks).unionByName(letters.select(F.explode(F.array_compact(F.array(*more))).alias("category"), "token", "n"))
    return found.where(~token.isin(*allow)) if allow else found


def script_contexts(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3, around: int = 20) -> DataFrame:
    """(script, ch, n, contexts): characters of foreign scripts, how often, and up to ``most`` contexts, those of the least keys. [P2]"""
    name = F.coalesce(*[F.when(F.col("ch").rlike(rf"\p{{Is{s}}}"), s) for s in SCRIPTS], F.when(F.col("ch").rlike("[\uff00-\uffef]"), "Fullwidth"))
    foreign = "[" + "".join(rf"\p{{Is{s}}}" for s in SCRIPTS) + "\uff00-\uffef]"
    rows = docs.where(F.col(text).rlike(foreign)).select(key, text, F.explode(F.regexp_extract_all(text, F.lit(foreign), F.lit(0))).alias("ch")).groupBy(key, text, "ch").agg(F.count("*").alias("n"))
    at = F.instr(F.col(text), F.col("ch"))
    rows = rows.select(key, "ch", "n", F.substr(F.col(text), F.greatest(at - around, F.lit(1)), F.least(at, F.lit(around + 1)) + around).alias("context"))
    rows = rows.withColumn("_k", F.row_number().over(W.partitionBy("ch").orderBy(key)))
    return rows.groupBy("ch").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.when(F.col("_k") <= most, F.col("context")))).alias("contexts")).withColumn("script", name)


def leftovers(texts: DataFrame, keys: list[str], text: str = "content", latin: str = "la") -> DataFrame:
    """(keys, label, n) of what may not be left in a text; a space before a stop counts in Latin alone (a column language). [P3]"""
    rows = residue(texts, keys, text, LEFTOVERS)
    return rows.unionByName(residue(texts.where(F.col("language") == latin), keys, text, (("space before punctuation", SPACE_BEFORE),)))


def residue(units: DataFrame, keys: list[str], text: str = "text", patterns=RESIDUE) -> DataFrame:
    """(keys, label, n) of the patterns that occur in a unit. [P3]"""
    counts = F.array(*[F.struct(F.lit(a).alias("label"), F.regexp_count(F.col(text), F.lit(p)).cast("long").alias("n")) for a, p in patterns])
    return units.select(*keys, F.explode(counts).alias("x")).select(*keys, "x.*").where("n > 0")


def odd_stars(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_odd): lines with an odd number of asterisks. [P4]"""
    rows = unit_lines(docs, key).where(F.regexp_count("line", F.lit(r"\*")) % 2 == 1)
    return rows.groupBy(key).agg(F.count("*").alias("n_odd"))


def line_pairs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, line, next) of neighbouring lines; next is null on the last."""
    return unit_lines(docs, key).withColumn("next", F.lead("line").over(W.partitionBy(key).orderBy("pos")))


def hard_wraps(docs: DataFrame, key: str = "doc_id", least: int = 3) -> DataFrame:
    """(key, breaks) of units with at least so many line pairs broken inside a sentence. [P4]"""
    broken = line_pairs(docs, key).where("next is not null").where(ends_open(F.col("line")) & starts_lower(F.col("next")))
    return broken.groupBy(key).agg(F.count("*").alias("breaks")).where(F.col("breaks") >= least)


def seams(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, kind) of lower-start, pair-seam and tail-terminal findings; a line that starts lower is not a pair's end too. [P5, W7]"""
    rows = line_pairs(docs, key)
    low = starts_lower(F.col("line"))
    kinds = F.array_compact(
        F.array(
            F.when(low, "lower-start"),
            F.when(~low & F.col("next").isNotNull() & ends_open(F.col("line")) & starts_lower(F.col("next")), "pair-seam"),
            F.when(F.col("next").isNull() & ends_open(F.col("line")), "tail-terminal"),
        )
    )
    return rows.select(key, "pos", F.explode(kinds).alias("kind"))


def boundary_audit(docs: DataFrame, dispositions: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, kind, sha256) of findings that no disposition (key, kind) clears; the hash binds a finding to its line. [P6, T20, J18]"""
    found = seams(docs, key).join(unit_lines(docs, key), [key, "pos"]).select(key, "pos", "kind", F.sha2("line", 256).alias("sha256"))
    return found.join(dispositions, [key, "kind"], "left_anti")


def stop_spacing(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n): spaces before a stop. [T10]"""
    return docs.select(key, F.coalesce(F.regexp_count(F.col(text), F.lit(r"[ \t ]+[,;:?!.]")), F.lit(0)).cast("long").alias("n"))


def duplicate_blocks(docs: DataFrame, by: str = "lang", key: str = "doc_id", least_words: int = 12) -> DataFrame:
    """(by, key, pos, first_key, first_pos): lines of enough words that repeat an earlier one within a language. [A9]"""
    rows = unit_lines(docs.select(by, key, "text").withColumn("_k", F.struct(by, key)), "_k").select(f"_k.{by}", f"_k.{key}", "pos", tokens(F.col("line")).alias("w"))
    rows = rows.where(F.size("w") >= least_words).withColumn("h", F.sha2(F.concat_ws(" ", "w"), 256))
    first = rows.groupBy(by, "h").agg(F.min(F.struct(key, "pos")).alias("f"), F.count("*").alias("k")).where("k > 1")
    out = rows.join(first, [by, "h"]).select(by, key, "pos", F.col(f"f.{key}").alias(f"first_{key}"), F.col("f.pos").alias("first_pos"))
    return out.where((F.col(key) != F.col(f"first_{key}")) | (F.col("pos") != F.col("first_pos")))


def join_kinds(docs: DataFrame, by: str = "source", key: str = "doc_id") -> DataFrame:
    """(by, kind, n): how each page joins the next of its work: hyphen, para or space. [J7]"""
    t = F.col("t")
    ends = F.when(t == "", "blank").when(t.rlike(r"\p{L}-[*_]*$"), "hyphen").when(ends_open(t), "open").otherwise("whole")
    begins = F.when(t == "", "blank").when(t.rlike(r"^(#|\*\*|[a-z]\))"), "mark").when(t.rlike(r"^\p{Ll}"), "small").otherwise("other")
    rows = docs.select(by, key, F.trim("text").alias("t")).select(by, key, ends.alias("ends"), F.when(t.isNotNull(), begins).alias("begins"))  # texts stay where they are
    rows = positions(rows, [by], key)
    after = rows.select(F.col(by).alias("_by"), (F.col("pos") - 1).alias("_pos"), F.col("begins").alias("next")).where("next is not null")
    rows = rows.join(after, F.col(by).eqNullSafe(F.col("_by")) & (F.col("pos") == F.col("_pos")))
    kind = (
        F.when((F.col("ends") == "blank") | (F.col("next") == "blank"), "para").when(F.col("ends") == "hyphen", "hyphen").when(F.col("next") == "mark", "para")
        .when(F.col("next") == "small", "space").when(F.col("ends") == "open", "space").otherwise("para")
    )
    return rows.groupBy(by, kind.alias("kind")).agg(F.count("*").alias("n"))


def long_s_gate(pages: DataFrame, work: str, text: str = "text", least: int = 30, share: float = 0.1) -> DataFrame:
    """Add medial_s, long_s and fails: a page of a work that has long s, with ``least`` medial s or more and hardly any long ones. [P16]

    Works are aggregated before the join, so that a work of any size is spread over tasks. Null text has none of either.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = pages.withColumns({"medial_s": F.regexp_count(body, F.lit(r"s(?=\p{L})")).cast("long"), "long_s": (F.length(body) - F.length(F.replace(body, F.lit("ſ"), F.lit("")))).cast("long")})
    printed = rows.groupBy(F.col(work).alias("_work")).agg((F.max("long_s") > 0).alias("_printed"))
    rows = rows.join(printed, F.col(work).eqNullSafe(F.col("_work")), "left")
    rare = F.col("long_s") < share * (F.col("long_s") + F.col("medial_s"))
    return rows.withColumn("fails", F.col("_printed") & (F.col("medial_s") >= least) & rare).drop("_work", "_printed")
