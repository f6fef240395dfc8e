"""Unicode as column expressions: composition, marks, comparison folds and character classes. Tables come from Unicode's own data by rule."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import let

#: Code points that the tables cover: Latin, Greek, Cyrillic and their extensions, presentation forms and full-width letters.
COVERED = (range(0xA0, 0x0600), range(0x1D00, 0x2200), range(0xA720, 0xA800), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F))
# Marks of an omitted m or n (tilde, macron, overline), accents (grave, acute, circumflex), vowels that carry them, ligatures, and other abbreviation marks.
NASAL_MARKS = (0x0303, 0x0304, 0x0305)
ACCENT_MARKS = (0x0300, 0x0301, 0x0302)
VOWELS = "aeiouyAEIOUY"
LIGATURES = "æœÆŒ" + "".join(map(chr, range(0xFB00, 0xFB07)))
ABBREVIATIONS = "⁊ęĘ̾"
ABBREVIATION_SPANS = ((0x0363, 0x036F), (0x1DD3, 0x1DFF), (0xA730, 0xA7FF))


def _covered() -> Iterable[str]:
    return (chr(c) for r in COVERED for c in r)


@lru_cache
def bare_table(form: str) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters, single characters they are without marks, pairs for those that become several) under NFD or NFKD."""
    one, to, many = [], [], []
    for ch in _covered():
        bare = "".join(c for c in unicodedata.normalize(form, ch) if unicodedata.category(c) != "Mn")
        if bare == ch or unicodedata.category(ch) == "Mn" or not bare.strip():
            continue
        if len(bare) == 1:
            one.append(ch)
            to.append(bare)
        elif bare.isalpha():
            many.append((ch, bare))
    return "".join(one), "".join(to), tuple(many)


def without_marks(text: Column, compatible: bool = False) -> Column:
    """Letters without their marks: NFD, or NFKD with ``compatible`` (long s is s, ligatures are spelled out)."""
    one, to, many = bare_table("NFKD" if compatible else "NFD")
    out = F.regexp_replace(F.translate(text, one, to), r"\p{Mn}+", "")
    spelled = out
    for ch, letters in many:
        spelled = F.replace(spelled, F.lit(ch), F.lit(letters))
    return F.when(out.rlike("[" + "".join(ch for ch, _ in many) + "]"), spelled).otherwise(out) if many else out


@lru_cache
def _composed() -> str:
    pairs = {}
    for ch in _covered():
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and unicodedata.normalize("NFC", ch) == ch:
            pairs[parts] = ch
            half = unicodedata.normalize("NFC", parts[:-1]) + parts[-1]
            pairs[half] = ch
    return json.dumps(pairs)


def composed(text: Column) -> Column:
    """NFC: letters followed by combining marks become single letters where there are such."""
    table = F.from_json(F.lit(_composed()), "map<string,string>")

    def compose(cluster: Column) -> Column:
        step = lambda acc, m: F.coalesce(F.element_at(table, F.concat(acc, m)), F.concat(acc, m))
        marks = F.filter(F.split(F.substr(cluster, F.lit(2)), ""), lambda m: m != "")
        return F.when(F.length(cluster) == 1, cluster).otherwise(F.aggregate(marks, F.substring(cluster, 1, 1), step))

    clusters = F.regexp_extract_all(text, F.lit(r"(?s)\P{M}\p{M}*|\p{M}+"), F.lit(0))
    return F.when(text.rlike(r"\p{M}"), F.array_join(F.transform(clusters, compose), "")).otherwise(text)


# ---------------------------------------------------------------- character classes


def char_class(ch: str) -> str | None:
    """What an edition may not keep of a print's characters: long-s, ligature, ampersand, abbrev-mark or accent; None for others. [T22]"""
    if ch in "ñÑ":
        return None
    simple = {"ſ": "long-s", "&": "ampersand"} | dict.fromkeys(LIGATURES, "ligature") | dict.fromkeys(ABBREVIATIONS, "abbrev-mark")
    if ch in simple:
        return simple[ch]
    marks = {ord(c) for c in unicodedata.normalize("NFD", ch)[1:]}
    barred = ord(ch) in NASAL_MARKS or not marks.isdisjoint(NASAL_MARKS)
    if barred or any(a <= ord(ch) <= b for a, b in ABBREVIATION_SPANS):
        return "abbrev-mark"
    base = unicodedata.normalize("NFD", ch)[0]
    if base in VOWELS and not marks.isdisjoint(ACCENT_MARKS):
        return "accent"
    stroked = marks and base in "bdhlBDHL" and "STROKE" in unicodedata.name(ch, "")
    return "abbrev-mark" if stroked else None


@lru_cache
def class_chars(*kinds: str) -> str:
    """The characters of the given classes (of all, if none is named)."""
    return "".join(sorted({ch for ch in ["&", *_covered(), *map(chr, range(0x0300, 0x0370))] if (k := char_class(ch)) and (not kinds or k in kinds)}))


def class_count(text: Column, *kinds: str) -> Column:
    """How many characters of the classes a (composed) text has: by a table look-up for each character, as a pattern would try hundreds of ranges."""
    return (F.length(text) - F.length(F.translate(text, class_chars(*kinds), ""))).cast("long")


@lru_cache
def class_pattern(*kinds: str) -> str:
    """A regular expression for one character of the given classes (all, if none is named); for long texts ``class_count`` is much faster."""
    codes, spans = sorted(map(ord, class_chars(*kinds))), []
    for c in codes:
        if spans and c == spans[-1][1] + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in spans) + "]"


CLASSES = ("long-s", "ligature", "ampersand", "abbrev-mark", "accent")


def class_counts(text: Column) -> Column:
    """A map from class to the number of its characters in the (composed) text, for classes that occur. [T22]"""
    text = composed(text)
    found = F.array(*[F.struct(F.lit(k).alias("key"), class_count(text, k).alias("value")) for k in CLASSES])
    return F.map_from_entries(F.filter(found, lambda x: x["value"] > 0))


# ---------------------------------------------------------------- comparison folds


def _spell(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def fold(text: Column, kind: str) -> Column:
    """Keys for comparing words; the kinds are not interchangeable. [T2]

    collate: no marks, ligatures spelled, s for long s. coverage: letters and digits of ASCII alone. omission: no marks; old-omission also
    f, v, j as s, u, i. longs: marks stay, v, j, ligatures as u, i, letters; longs-key: no marks, f as s too. shared: letters
    alone, with all of these. variant: also y, ae, oe, ci, h as i, e, e, ti, nothing. plain: v, j as u, i, word characters alone.
    words: white space collapsed. letters: and punctuation dropped, lower case.
    """
    low = F.lower(text)
    ligatures = (("æ", "ae"), ("œ", "oe"))
    if kind == "collate":
        return F.translate(_spell(without_marks(low), ligatures), "ſ", "s")
    if kind == "coverage":
        return F.regexp_replace(F.lower(without_marks(text, True)), "[^a-z0-9]+", "")
    if kind in ("omission", "old-omission"):
        out = F.lower(without_marks(text, True))
        return F.translate(out, "fvj", "sui") if kind == "old-omission" else out
    if kind == "longs":
        return F.translate(_spell(composed(low), (*ligatures, ("ę", "ae"))), "ſvj", "sui")
    if kind == "longs-key":
        return F.translate(_spell(without_marks(low), ligatures), "ſfvj", "ssui")
    if kind == "shared":
        spelled = without_marks(F.lower(_spell(text, (*ligatures, ("Æ", "ae"), ("Œ", "oe"), ("&", "et"), ("ſ", "s")))), True)
        return F.translate(F.regexp_replace(spelled, r"\P{L}+", ""), "vjf", "uis")
    if kind == "variant":
        out = _spell(F.translate(without_marks(low), "vjy", "uii"), (("ae", "e"), ("oe", "e"), ("ci", "ti"), ("h", "")))
        return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", ""))
    if kind == "plain":
        return F.regexp_replace(F.translate(_spell(without_marks(low), ligatures), "ſvj", "sui"), r"[^\p{L}\p{N}_]", "")
    if kind == "words":
        return F.trim(F.regexp_replace(text, r"\s+", " "))
    if kind == "letters":
        return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    raise ValueError(f"no fold named {kind!r}")


FOLDS = ("collate", "coverage", "omission", "old-omission", "longs", "longs-key", "shared", "variant", "plain", "words", "letters")

# ---------------------------------------------------------------- tokens

#: Token classes: runs of letters; letters with combining marks; letters and digits, or a note bracket; letters and digits; ASCII letters and æ; what stands between white space.
TOKENS = {
    "letters": r"\p{L}+", "marked": r"(?:\p{L}|[\x{300}-\x{36F}\x{1DC0}-\x{1DFF}\x{FE20}-\x{FE2F}])+", "collate": r"[\p{L}\p{N}]+|[⟨⟩]", "alnum": r"[\p{L}\p{N}]+",
    "ascii": "[a-zæ]+", "words": r"\S+",
}


def words_of(text: Column, kind: str = "letters") -> Column:
    """Tokens of one of the classes of TOKENS; those of letters are read from composed text without comments and link targets, those of ASCII from lower case. [T1]"""
    if kind == "letters":
        for sign, pattern, put in (("<!--", r"(?s)<!--.*?-->", " "), ("]]", r"\|[^\]|]*\]\]", "]]")):
            text = let(text, lambda t: F.when(F.contains(t, F.lit(sign)), F.regexp_replace(t, pattern, put)).otherwise(t))  # noqa: B023 (most texts have neither)
        text = let(text, composed)
    text = F.lower(text) if kind == "ascii" else text
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKENS[kind]), F.lit(0)), F.array().cast("array<string>"))
