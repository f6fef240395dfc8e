"""Places where two texts differ, edits that a decision makes there, and what proves or bounds them."""

from __future__ import annotations

import hashlib
import json
import re
import shlex
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.notes import by_text
from quire.functions.unicode import fold

#: Longest run of sites that is tried as words joined or cut, and how many may share a page.
MOST_GLUED = 200
_NUMERAL = re.compile(r"[0-9]+|[ivxlcdmj]+")


# ---------------------------------------------------------------- edits at spans


def replacements(decisions: DataFrame) -> DataFrame:
    """(unit, start, end, was, new, problem) from decisions (unit, start, end, a, b, ocr, decision): =a leaves the text, =b and =ocr take that reading, MANUAL is refused, anything else is the new text. [K6]"""
    new = F.when(F.col("decision") == "=b", F.col("b")).when(F.col("decision") == "=ocr", F.col("ocr")).otherwise(F.col("decision"))
    rows = decisions.where("decision <> '=a'").select("unit", "start", "end", F.col("a").alias("was"), F.when(F.col("decision") != "MANUAL", new).alias("new"))
    return rows.distinct().withColumn("problem", F.when(F.col("new").isNull(), "manual"))


def apply_edits(texts: DataFrame, edits: DataFrame, unit: str = "unit", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with their edits, refused edits): spans (unit, start, end, was, new) from 0, end exclusive. [K6]

    Equal edits count once. An edit whose text is no longer what it was is stale; two that overlap refuse each other; a unit with a
    refused edit is left as it is. Edits of a unit are applied together, so offsets are those of the text before.
    """
    rows = edits.where("new is not null").select(unit, "start", "end", "was", "new").distinct().join(texts.select(unit, text), unit, "left")
    now = F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start"))
    by_unit = W.partitionBy(unit).orderBy("start", "end", "new")
    rows = rows.withColumns({"_last": F.max("end").over(by_unit.rowsBetween(W.unboundedPreceding, -1)), "_next": F.lead("start").over(by_unit)})
    problem = F.when(F.col(text).isNull(), "no unit").when(now != F.col("was"), "stale").when((F.col("_last") > F.col("start")) | (F.col("_next") < F.col("end")), "overlap")
    rows = rows.withColumn("problem", problem)
    refused = rows.where("problem is not null").select(unit, "start", "end", "was", "new", "problem").unionByName(edits.where("new is null").select(unit, "start", "end", "was", "new", F.lit("manual").alias("problem")))
    clean = rows.join(refused.select(unit).distinct(), unit, "left_anti").groupBy(unit).agg(F.sort_array(F.collect_list(F.struct("start", "end", "new"))).alias("_e"))
    body = F.col(text)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    piece = lambda a, e: F.substr(body, (a["at"] + 1).cast("int"), (e["start"] - a["at"]).cast("int"))
    step = lambda a, e: F.struct(e["end"].cast("long").alias("at"), F.concat(a["out"], F.array(piece(a, e), e["new"])).alias("out"))
    done = F.aggregate("_e", zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(body, (a["at"] + 1).cast("int"))))
    return texts.join(clean, unit, "left").withColumn(text, F.when(F.col("_e").isNotNull(), done).otherwise(body)).drop("_e"), refused


def _window(text: str, start: int, end: int, most: int = 6) -> tuple[int, int] | None:
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    before, after = [a for a, b in words if b <= start], [b for a, b in words if a >= end]
    for k in range(1, most + 1):
        left, right = before[-k] if len(before) >= k else 0, after[k - 1] if len(after) >= k else len(text)
        for a, b in ((left, right), (left, end), (start, right)):
            if text.count(text[a:b]) == 1:
                return a, b
    return None


def unique_window(text: str | Column, start: str | Column, end: str | Column) -> Column:
    """A struct (start, end): the span grown by 1 to 6 words on both sides, the left or the right, until it occurs once in the text. [K6, T24]"""

    def run(t: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        got = [None if x is None else _window(x, int(i), int(j)) for x, i, j in zip(t, a, b, strict=True)]
        return pd.DataFrame({"start": pd.array([g and g[0] for g in got], dtype="Int32"), "end": pd.array([g and g[1] for g in got], dtype="Int32")})

    return F.pandas_udf(run, "struct<start:int,end:int>")(text, start, end)


def unique_anchors(phrases: DataFrame, texts: DataFrame, unit: str = "unit") -> DataFrame:
    """Phrases (unit, phrase) with at: where they stand, if they occur exactly once in their unit's text. [T24]"""
    met = phrases.join(texts.select(unit, "text"), unit).withColumn("_n", F.size(F.split("text", F.concat(F.lit("\\Q"), F.col("phrase"), F.lit("\\E")), F.lit(-1))) - 1)
    return met.where("_n = 1 and phrase <> ''").withColumn("at", F.expr("instr(text, phrase) - 1").cast("long")).drop("_n", "text")


# ---------------------------------------------------------------- word sites


def _spelling(word: str) -> str:
    low = re.sub(r"[^\w]", "", word.lower()).replace("ſ", "s").replace("v", "u").replace("j", "i").replace("æ", "ae").replace("œ", "oe")
    return low.replace("y", "i").replace("ae", "e").replace("oe", "e")


def _sites(a: list[str], b: list[str]) -> list[dict]:
    """Differences of two word lists. Runs of them whose letters are the same once white space is gone are words joined or cut (the longest run first)."""
    raw = [(i, j, k, m) for tag, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag != "equal"]
    out, at = [], 0
    while at < len(raw):
        i, _, k, _ = raw[at]
        last = next((n for n in range(min(len(raw), at + MOST_GLUED) - 1, at - 1, -1) if "".join(a[i : raw[n][1]]) == "".join(b[k : raw[n][3]]) != ""), None)
        if last is not None:
            j, m = raw[last][1], raw[last][3]
            out.append({"kind": "glue-a" if j - i < m - k else "glue-b", "a_at": i, "b_at": k, "a": " ".join(a[i:j]), "b": " ".join(b[k:m])})
            at = last + 1
            continue
        i, j, k, m = raw[at]
        x, y = a[i:j], b[k:m]
        if not x or not y:
            kind = "b-only" if not x else "a-only"
        elif len(x) != len(y):
            kind = "span"
        else:
            kind = ""
            for n, (p, q) in enumerate(zip(x, y, strict=True)):
                both = _NUMERAL.fullmatch(p.lower().strip(".")) and _NUMERAL.fullmatch(q.lower().strip("."))
                out.append({"kind": "numeral" if both else "orthography" if _spelling(p) == _spelling(q) else "word", "a_at": i + n, "b_at": k + n, "a": p, "b": q})
        if kind:
            out.append({"kind": kind, "a_at": i, "b_at": k, "a": " ".join(x), "b": " ".join(y)})
        at += 1
    return out


_SITES = "array<struct<kind:string,a_at:int,b_at:int,a:string,b:string>>"


def word_sites(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """(keys, kind, a_at, b_at, a, b) of the places where two texts' words differ: word, orthography, numeral, span, a-only, b-only, glue-a, glue-b; a whole text that only one side has is a-block-only or b-block-only. [J14]"""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else _sites(s.split(), t.split()) for s, t in zip(x, y, strict=True)])

    rows = pairs.withColumn("_s", F.pandas_udf(run, _SITES)(a, b))
    lone = F.struct(F.when(F.col(b).isNull(), "a-block-only").otherwise("b-block-only").alias("kind"), F.lit(0).alias("a_at"), F.lit(0).alias("b_at"), F.col(a).alias("a"), F.col(b).alias("b"))
    one = F.col(a).isNull() != F.col(b).isNull()
    return rows.select(*keys, F.explode(F.when(one, F.array(lone)).otherwise(F.col("_s"))).alias("x")).select(*keys, "x.*")


def witness_sites(pairs: DataFrame, page: str, witness: str, keys: list[str]) -> DataFrame:
    """(keys, at, page, witness) of words where a second reading differs, long s and emphasis apart; an insertion is read at the word before which it stands. [J12]"""
    plain = lambda c: F.translate(F.replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), F.lit("*"), F.lit("")), "ſ", "s")
    rows = pairs.withColumns({"_a": plain(F.col(page)), "_b": plain(F.col(witness))})
    found = word_sites(rows, "_a", "_b", keys)
    return found.select(*keys, F.col("a_at").alias("at"), F.col("a").alias("page"), F.col("b").alias("witness"))


def cover(pairs: DataFrame, probe: str, text: str) -> DataFrame:
    """Add cover: 100 times the characters of ``probe`` in matching blocks with ``text``, over the probe's length. [M4]"""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        match = lambda s, t: sum(m.size for m in SequenceMatcher(None, s, t, autojunk=False).get_matching_blocks())
        return pd.Series([100.0 * match(s or "", t or "") / max(len(s or ""), 1) for s, t in zip(x, y, strict=True)])

    return pairs.withColumn("cover", F.pandas_udf(run, "double")(probe, text))


def skeleton_kept(find: Column, put: Column, case_rule: Column) -> Column:
    """Whether a punctuation row keeps the letters and digits as they are, or a case row changes nothing but case. [T12]"""
    alnum = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")
    return F.when(case_rule, (F.lower(find) == F.lower(put)) & (find != put)).otherwise((alnum(find) == alnum(put)) & (find != put))


def punctuate(texts: DataFrame, rows: DataFrame, unit: str = "unit", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, stale rows): rows (unit, find, put, occurrence, case_rule) that pass ``skeleton_kept`` applied at the n-th occurrence, or all for *; a row whose text is gone, or that fails, is returned. [T12]"""
    met = rows.join(texts.select(unit, text), unit, "left")
    n = F.size(F.split(text, F.concat(F.lit("\\Q"), F.col("find"), F.lit("\\E")), F.lit(-1))) - 1
    fine = skeleton_kept(F.col("find"), F.col("put"), F.col("case_rule")) & (F.when(F.col("occurrence") == "*", n > 0).otherwise((F.col("occurrence").try_cast("int") >= 1) & (n >= F.col("occurrence").try_cast("int"))))
    met = met.withColumn("_ok", F.coalesce(fine, F.lit(False)))
    refused = met.where("not _ok").select(rows.columns)
    pieces = F.split(text, F.concat(F.lit("\\Q"), F.col("find"), F.lit("\\E")), F.lit(-1))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, p: F.struct((a["at"] + F.length(p) + F.length("find")).alias("at"), F.array_append(a["out"], a["at"] + F.length(p)).alias("out"))
    starts = F.aggregate(F.slice(pieces, 1, n), zero, step, lambda a: a["out"])  # where each occurrence begins, counted along once
    met = met.where("_ok").withColumn("_starts", starts)
    nth = F.when(F.col("occurrence") == "*", F.col("_starts")).otherwise(F.array(F.element_at("_starts", F.greatest(F.coalesce(F.col("occurrence").try_cast("int"), F.lit(1)), F.lit(1)))))
    spans = met.select(unit, "find", "put", F.explode(nth).alias("start"))
    edits = spans.select(unit, F.col("start").cast("long").alias("start"), (F.col("start") + F.length("find")).cast("long").alias("end"), F.col("find").alias("was"), F.col("put").alias("new"))
    return apply_edits(texts, edits, unit, text)[0], refused


# ---------------------------------------------------------------- runs of outside tools


def cache_keys(jobs: DataFrame, parts: list[str]) -> DataFrame:
    """Add key: the SHA-256 of the parts (image hash, stem, options, ...) as JSON with sorted names; a changed part is another key. [K4]"""
    return jobs.withColumn("key", F.sha2(F.to_json(F.struct(*sorted(parts))), 256))


def cached(jobs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs with their result, jobs still to run) by key; an entry without a readable result is a miss. [K4]"""
    known = cache.where("result is not null").select("key", "result").dropDuplicates(["key"])
    return jobs.join(known, "key"), jobs.join(known, "key", "left_anti")


def batch_state(pages: DataFrame, uploads: DataFrame, report_sha256: str, manifest_sha256: str) -> DataFrame:
    """(state, n) of a batch's pages, which go out only under a passing report on the very manifest: done, failed, waiting. [K5]"""
    if report_sha256 != manifest_sha256:
        raise ValueError("no passing report on this manifest: nothing is sent")
    last = uploads.groupBy("page").agg(F.max_by("status", "ts").alias("status"))
    state = F.when(F.col("status").between(200, 299), "done").when(F.col("status").isNull() | (F.col("status") == 429) | (F.col("status") >= 500), "waiting").otherwise("failed")
    return pages.select("page").distinct().join(last, "page", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def edition_function(source: str) -> Callable[[str | Column], Column]:
    """A user's Python source that defines ``edition(text)`` or ``apply(text)`` as a function of columns. [F1]"""
    names: dict = {}
    exec(compile(source, "edition rules", "exec"), names)  # noqa: S102 (the user's own rules)
    f = names.get("edition") or names.get("apply")
    if not callable(f):
        raise ValueError("the rules define neither edition(text) nor apply(text)")
    return by_text(f, "string")


def command_lines(jobs: DataFrame, template: str, names: tuple[str, ...] = ("image", "page", "out", "file")) -> DataFrame:
    """Add command: a shell template with each {name} replaced by the row's value, quoted for the shell. [F2]"""
    quoted = lambda c: F.when(F.col(c).cast("string").rlike(r"^[\w@%+=:,./-]+$"), F.col(c).cast("string")).otherwise(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))
    parts = re.split(r"\{(\w+)\}", template)
    unknown = set(parts[1::2]) - set(names)
    if unknown:
        raise ValueError(f"unknown names in the template: {sorted(unknown)}")
    return jobs.withColumn("command", F.concat(*[quoted(p) if i % 2 else F.lit(p) for i, p in enumerate(parts)]))


def shell_quote(text: str) -> str:
    """What ``command_lines`` makes of a value."""
    return shlex.quote(text)


def cache_key(values: dict) -> str:
    """``cache_keys`` for one row of texts."""
    return hashlib.sha256(json.dumps(dict(sorted(values.items())), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def start_shares(sections: DataFrame, leaves: DataFrame, longest: int = 30) -> DataFrame:
    """(section, leaf, share): how many percent of a section's first long words a leaf holds, by folded equality; under 45, or 15 less than the next leaf, the section starts elsewhere. [J20]"""
    words = F.slice(F.filter(F.split(fold(F.col("text"), "letters"), " "), lambda w: F.length(w) >= 5), 1, longest)
    first = sections.select("section", "leaf", F.explode(words).alias("w"))
    held = leaves.select("leaf", F.explode(F.array_distinct(F.split(fold(F.col("text"), "letters"), " "))).alias("w")).withColumn("hit", F.lit(1))
    both = first.unionByName(first.withColumn("leaf", F.col("leaf") + 1))
    return both.join(held, ["leaf", "w"], "left").groupBy("section", "leaf").agg((100 * F.count("hit") / F.count("*")).alias("share"))

