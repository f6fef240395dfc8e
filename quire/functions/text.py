"""Columns over text: tokens, folds, lines, case, signatures. All are JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what each folds to, in order.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
TERMINAL = r"[.!?…:][\"'»”’)\]*_]*$"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f names it: expressions otherwise grow with every use."""
    return F.element_at(F.transform(F.array(value), f), 1)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def lines(text: Column) -> Column:
    """(pos, line) structs of the non-blank lines, trimmed; pos counts from 0 among them."""
    kept = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(kept, lambda x, i: F.struct(i.cast("long").alias("pos"), x.alias("line")))


def blocks(text: Column) -> Column:
    """Paragraphs between blank lines, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n+"), lambda x: F.trim(x)), lambda x: x != "")


def fold_accents(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def recase(source: Column, target: Column) -> Column:
    """Give ``target`` the case of ``source``: all capitals (more than one letter), an initial capital, or none."""
    upper = (F.length(source) > 1) & (source == F.upper(source)) & (source != F.lower(source))
    first = F.substring(source, 1, 1)
    return F.when(upper, F.upper(target)).when((first == F.upper(first)) & (first != F.lower(first)), F.concat(F.upper(F.substring(target, 1, 1)), F.substr(target, F.lit(2)))).otherwise(target)


def case_class(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    return (
        F.when((F.length(word) > 1) & (word == F.upper(word)) & (word != F.lower(word)), "upper")
        .when((first == F.upper(first)) & (first != F.lower(first)), "initial").otherwise("lower")
    )


def signature(*parts: Column) -> Column:
    """A log template: lower case, quoted spans, paths and digits blanked, white space collapsed, 120 characters."""
    s = F.lower(F.concat_ws("|", *parts))
    for pattern, to in ((r'"[^"]*"', "<q>"), (r"\S*/\S+", "<path>"), (r"[0-9]+", "N"), (r"\s+", " ")):
        s = F.regexp_replace(s, pattern, to)
    return F.substring(s, 1, 120)


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", " ")


def starts_lower(line: Column) -> Column:
    """The first letter is lower case, and the line is no heading, list item or table."""
    first = F.regexp_extract(line, r"\p{L}", 0)
    return (first != "") & (first == F.lower(first)) & (first != F.upper(first)) & ~line.rlike(r"^(#|[-*+] |\||[0-9]+[.)] |[a-z]\) )")


def ends_open(line: Column) -> Column:
    return ~line.rlike(TERMINAL)


def roman(text: Column) -> Column:
    """Arabic or roman numerals as a number, subtractive and without a check of form; null for anything else."""
    value = lambda c: F.element_at(F.create_map(*[F.lit(x) for p in zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in p]), c)
    chars = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    step = lambda acc, c: F.struct((acc["t"] + value(c) - F.when(acc["p"] < value(c), 2 * acc["p"]).otherwise(0)).alias("t"), value(c).alias("p"))
    total = F.aggregate(chars, F.struct(F.lit(0).alias("t"), F.lit(10000).alias("p")), step, lambda a: a["t"])
    return F.when(text.rlike(r"^[0-9]+$"), text.cast("int")).when(text.rlike("^[IVXLCDMivxlcdm]+$"), total)
