"""Nested manifests of any depth as rows, and rows as manifests, whose sections are climbed by recursive queries."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.shared import small_batches

#: The highest that sections are climbed; higher trees are an error of Spark's, never cut.
DEEPEST = 100


@contextmanager
def _views(spark: SparkSession, **frames: DataFrame) -> Iterator[dict[str, str]]:
    """Temporary views of the frames under names of their own; a plan keeps what it needs of them."""
    names = {k: f"{k}_{uuid.uuid4().hex}" for k in frames}
    for k, df in frames.items():
        df.createOrReplaceTempView(names[k])
    try:
        yield names
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)


def _unbounded(spark: SparkSession) -> None:
    """Recursive queries may give any number of rows; their depth stays bounded."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(DEEPEST))


class _Number(str):
    """A number as the JSON text writes it; whole ones may be int."""


_WORK = re.compile("works/([0-9]{9})")
_ESCAPED = re.compile("[\x00-\x1f]")
_UNIT_ROWS = "unit string, language string, content string, place string"


def _json(v: object) -> str:
    """A value as compact JSON, as VARIANT writes it."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{_json(k)}:{_json(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_json, v)) + "]"
    if isinstance(v, str) and not isinstance(v, _Number):
        return re.sub(r"\\u00[01][a-f]", lambda m: m[0][:4] + m[0][4:].upper(), json.dumps(v, ensure_ascii=False)) if _ESCAPED.search(v) else json.dumps(v, ensure_ascii=False)
    if isinstance(v, _Number) and v.endswith("Infinity"):
        return f'"{v}"'
    return "null" if v is None else _said(v)


def _said(v: object) -> str | None:
    """A value as a string; null stays null."""
    if v is None or type(v) is str:
        return v
    return "true" if v is True else "false" if v is False else str(v) if isinstance(v, (_Number, int)) else _json(v)


def _own(v: dict, name: str) -> str:
    """A node's key, else that of the node it stands in."""
    full = _said(v.get("section_key"))
    if not full and v.get("section_type") is not None and v.get("id") is not None:
        return f"section-{_said(v['id'])}"
    return full or _said(v.get("slug")) or _said(v.get("id")) or name


def _texts(root: object) -> Iterator[tuple[str | None, str | None, str, str]]:
    """(name, language, content, place) of a manifest's texts, node by node; no recursion, so that any depth is walked."""
    todo: list[tuple[str, object, str]] = [("", root, "")]
    while todo:
        name, v, place = todo.pop()
        if isinstance(v, dict):
            name = _own(v, name)
            if v.get("op") == "put_text" and v.get("content") is not None:
                section = _said(v.get("section_id"))
                yield None if section is None else f"section-{section}", _said(v.get("language")), _said(v["content"]), place
                continue
            texts = v.get("texts")
            if isinstance(texts, dict):
                for i, (key, x) in enumerate(texts.items()):
                    content = x.get("content") if isinstance(x, dict) else x
                    if type(content) is str:
                        yield name, key, content, f"{place}/{i:09d}"
            elif isinstance(texts, list):
                for i, x in enumerate(texts):
                    if isinstance(x, dict) and type(content := x.get("content")) is str:
                        yield name, _said(x.get("language")), content, f"{place}/{i:09d}"
        above = f"{place}/" if place else ""
        if isinstance(v, dict):
            todo.extend((name, x, above + key) for key, x in v.items() if isinstance(x, (dict, list)) and key != "texts")
        elif isinstance(v, list):
            todo.extend((name, x, f"{above}{i:09d}") for i, x in enumerate(v) if isinstance(x, (dict, list)))


_READ = json.JSONDecoder(parse_float=_Number, parse_constant=_Number).decode
_READ_NUMBERS = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_Number).raw_decode


def _numbered(v: object, written: object) -> object:
    """The value with numbers beyond a double's reach, which VARIANT gives back as strings, as numbers again, where they are written so."""
    if isinstance(v, dict) and isinstance(written, dict):
        return {k: _numbered(x, written.get(k)) for k, x in v.items()}
    if isinstance(v, list) and isinstance(written, list):
        return [_numbered(x, y) for x, y in zip(v, written, strict=True)]
    return _Number(v) if isinstance(written, _Number) else v


def _unit_rows(batches: Iterator[pa.RecordBatch], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of manifests (path, json, written) to rows of their texts, some thousand at a time."""
    for b in batches:
        of, rows = [], []

        def done(b: pa.RecordBatch = b) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * 4
            out = pa.RecordBatch.from_arrays([b.column("path").take(pa.array(of, pa.int32())), *[pa.array(c, pa.string()) for c in columns]], ["path", *[f.split()[0] for f in _UNIT_ROWS.split(", ")]])
            of.clear()
            rows.clear()
            return out

        for n, (text, written) in enumerate(zip(b.column("json").to_pylist(), b.column("written").to_pylist(), strict=True)):
            root = _READ(text)
            if written is not None:
                root = _numbered(root, _READ_NUMBERS(written.lstrip())[0])
            works = root.get("works") if isinstance(root, dict) else None
            slugs = [_said(w.get("slug")) if isinstance(w, dict) else None for w in works] if isinstance(works, list) and len(works) > 1 else []
            for name, language, content, place in _texts(root):
                at = _WORK.match(place) if slugs else None
                slug = slugs[int(at[1])] if at and int(at[1]) < len(slugs) else None
                of.append(n)
                rows.append((name if slug is None else slug if name is None else f"{slug}/{name}", language, content, place))
                if len(rows) >= most:
                    yield done()
        yield done()


def manifest_units(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, unit, language, content, place) for every text of manifests in JSON, at any depth. [S11]

    A node's key is ``section-<id>`` where it has a section_type and an id but no section_key (a live outline's node), else its
    section_key, slug or id, else that of the node it stands in. Texts are a list of objects or a map from language to an object or a
    string; an object ``op: put_text`` is a text of ``section-<section_id>``. Where a manifest has several works, units are
    ``<slug>/<key>``. ``place`` orders a manifest's texts: lists keep their order, fields of an object go by name. Broken JSON has no texts.
    Spark reads the JSON and brings its fields in order; a helper walks one manifest at a time.
    """
    small_batches(files.sparkSession)
    rows = files.select(F.col(path).alias("path"), F.to_json(F.try_parse_json(F.col(text))).alias("json"), F.col(text).alias("written")).where("json is not null")
    rows = rows.withColumn("written", F.when(F.col("json").rlike('"-?Infinity"'), F.col("written")))
    return rows.mapInArrow(_unit_rows, f"path {rows.schema['path'].dataType.simpleString()}, {_UNIT_ROWS}")


# ---------------------------------------------------------------- rows to manifests


def ancestors(sections: DataFrame, start: DataFrame, by: list[str]) -> DataFrame:
    """(by, key, above, steps, loop): every section above the keys of ``start`` (by, key), climbing parents (by, key, parent) of any height; ``loop`` where the climb comes back to where it has been. [K2]"""
    spark = sections.sparkSession
    _unbounded(spark)
    keys = ", ".join(by)
    on = " AND ".join(f"s.{c} = u.{c}" for c in by)
    with _views(spark, sections=sections.select(*by, "key", "parent").where("parent is not null"), start=start.select(*by, "key").distinct()) as at:
        out = spark.sql(f"""
WITH RECURSIVE up({keys}, start, above, been, steps, loop) AS (
  SELECT {keys}, key, key, array(key), 0, false FROM {at['start']}
  UNION ALL
  SELECT {', '.join('u.' + c for c in by)}, u.start, s.parent, concat(u.been, array(s.parent)), u.steps + 1, array_contains(u.been, s.parent)
  FROM up u JOIN {at['sections']} s ON {on} AND s.key = u.above AND NOT u.loop
)
SELECT {keys}, start AS key, above, steps, loop FROM up WHERE steps > 0""")
        out.schema
    return out


def included(sections: DataFrame, wanted: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sections that a batch holds, with own (asked for, not only above one), findings (by, key, problem)): unknown keys, parents that don't exist, and loops refuse it. [K2]"""
    above = ancestors(sections, wanted, by)
    known = sections.select(*by, "key").distinct().withColumn("_known", F.lit(True))
    asked = wanted.select(*by, "key").distinct()
    need = asked.withColumn("own", F.lit(True)).unionByName(above.where("not loop").select(*by, F.col("above").alias("key"), F.lit(False).alias("own")))
    need = need.groupBy(*by, "key").agg(F.bool_or("own").alias("own")).join(known, [*by, "key"], "left")
    missing = need.where("_known is null").select(*by, "key", F.when(F.col("own"), "unknown key").otherwise("parent is not in the structure").alias("problem"))
    loops = above.where("loop").select(*by, "key", F.lit("parents go round in a loop").alias("problem")).distinct()
    return sections.join(need.where("_known").drop("_known"), [*by, "key"]), missing.unionByName(loops)


def locators(sections: DataFrame, by: list[str]) -> DataFrame:
    """(by, key, locator): ``p. N`` or ``pp. A-B`` of sections (by, key, parent, printed_start, printed_end): their own pages, or the span of those below them. [K2]

    A section without both ends takes the least start and greatest end of its children; a child with a start gives that and its end (or the start
    again), one without gives what it takes from its own children. Without any pages there is no row.
    """
    spark = sections.sparkSession
    _unbounded(spark)
    keys = ", ".join(by)
    on = " AND ".join(f"s.{c} = u.{c}" for c in by)
    with _views(spark, s=sections.select(*by, "key", "parent", "printed_start", "printed_end")) as at:
        below = spark.sql(f"""
WITH RECURSIVE up({keys}, key, parent, lo, hi, steps) AS (
  SELECT {keys}, key, parent, printed_start, coalesce(printed_end, printed_start), 0 FROM {at['s']} WHERE printed_start IS NOT NULL
  UNION ALL
  SELECT {', '.join('u.' + c for c in by)}, s.key, CASE WHEN s.printed_start IS NULL THEN s.parent END, u.lo, u.hi, u.steps + 1
  FROM up u JOIN {at['s']} s ON {on} AND s.key = u.parent
)
SELECT {keys}, key, min(lo) AS lo, max(hi) AS hi FROM up WHERE steps > 0 GROUP BY {keys}, key""")
        below.schema
    own = sections.select(*by, "key", "printed_start", "printed_end", (F.col("printed_start").isNotNull() & F.col("printed_end").isNotNull()).alias("_own"))
    met = own.join(below, [*by, "key"], "left")
    lo, hi = F.when(F.col("_own"), F.col("printed_start")).otherwise(F.col("lo")), F.when(F.col("_own"), F.col("printed_end")).otherwise(F.col("hi"))
    name = F.when(lo == hi, F.concat(F.lit("p. "), lo.cast("string"))).otherwise(F.concat(F.lit("pp. "), lo.cast("string"), F.lit("-"), hi.cast("string")))
    return met.where(lo.isNotNull()).select(*by, "key", name.alias("locator"))


def build(sections: DataFrame, texts: DataFrame, titles: DataFrame, wanted: DataFrame, languages: list[str], original: str = "la") -> tuple[DataFrame, DataFrame]:
    """(manifests (work, sections: array in order of their texts, own locators and parents), findings (work, key, problem)). [K2]

    ``sections`` (work, key, parent, seq, title, printed_start, printed_end), ``texts`` (work, key, language, content), ``titles`` (work, key, language,
    title) of translations. Sections above a wanted one travel with it and carry no texts. A wanted section that has none below it and no text in the
    original language, a translation missing beside it or with another number of blocks, an included section without a translated title, unknown keys, missing parents and loops
    are findings; while there are any, no manifest may go out.
    """
    by = ["work"]
    held, findings = included(sections, wanted, by)
    held = held.join(locators(sections, by), ["work", "key"], "left")
    blocks = F.size(F.filter(F.split(F.trim("content"), r"\n\s*\n+"), lambda b: F.trim(b) != "")).cast("long")
    said = texts.where(F.trim(F.coalesce("content", F.lit(""))) != "").select("work", "key", "language", F.trim("content").alias("content"), blocks.alias("blocks"))
    own = held.where("own").select("work", "key")
    first = said.where(F.col("language") == original).select("work", "key", F.col("blocks").alias("n"))
    parents = sections.select("work", F.col("parent").alias("key")).where("key is not null").distinct()
    bare = own.join(first, ["work", "key"], "left_anti").join(parents, ["work", "key"], "left_anti").select("work", "key", F.lit("no text").alias("problem"))
    others = [x for x in languages if x != original]
    asked = F.explode(F.array(*map(F.lit, others))) if others else F.explode(F.array().cast("array<string>"))
    beside = own.join(first, ["work", "key"]).withColumn("language", asked).join(said.select("work", "key", "language", "blocks"), ["work", "key", "language"], "left")
    wrong = F.when(F.col("blocks").isNull(), F.concat(F.lit("no text in "), "language")).when(F.col("blocks") != F.col("n"), F.concat("language", F.lit(" has "), F.col("blocks").cast("string"), F.lit(" blocks, "), F.lit(original), F.lit(" has "), F.col("n").cast("string")))
    beside = beside.select("work", "key", wrong.alias("problem")).where("problem is not null")
    named = titles.where(F.trim(F.coalesce("title", F.lit(""))) != "").select("work", "key", "language").distinct()
    untitled = held.select("work", "key").withColumn("language", asked).join(named, ["work", "key", "language"], "left_anti").select("work", "key", F.concat(F.lit("no title in "), "language").alias("problem"))
    findings = findings.unionByName(bare).unionByName(beside).unionByName(untitled)
    listed = said.where(F.col("language").isin(*languages)).join(own, ["work", "key"], "left_semi")
    listed = listed.groupBy("work", "key").agg(F.sort_array(F.collect_list(F.struct("language", "content"))).alias("texts"))
    rows = held.join(listed, ["work", "key"], "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<struct<language:string,content:string>>")))
    out = rows.groupBy("work").agg(F.sort_array(F.collect_list(F.struct("seq", "key", "parent", "title", "locator", "texts"))).alias("sections"))
    return out, findings
