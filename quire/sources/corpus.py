"""Readers of a corpus: text and manifest files, JSON lines, checked tables, witness maps, line boxes, DOCX and HTML, editions cut by headers."""

from __future__ import annotations

import html
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions.notes import by_text
from quire.operators.order import positions
from quire.sources.shared import small_batches, staged


def _files(spark: SparkSession, patterns: list[str], exclude: list[str], recursive: bool) -> DataFrame:
    """(path, text) of the files that match, each once; text is read whole."""
    rows = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(patterns, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    for pattern in exclude:
        rows = rows.where(~F.col("path").rlike("(^|/)" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".") + "$"))
    return rows.dropDuplicates(["path"])


def _texts(content: str | None) -> list[tuple[str, str, str, str]]:
    """(work, section, language, content) of a manifest, depth first; broken JSON has none. [S11]"""
    try:
        data = json.loads(content or "")
    except ValueError:
        return []
    works = data.get("works") if isinstance(data, dict) else None
    parts = [(w.get("slug") or "", w) for w in works] if isinstance(works, list) and len(works) > 1 and all(isinstance(w, dict) for w in works) else [("", data)]
    found: list[tuple[str, str, str, str]] = []
    for work, root in parts:
        todo = [(root, "")]
        while todo:
            node, key = todo.pop()
            if isinstance(node, list):
                todo += [(x, key) for x in reversed(node)]
                continue
            if not isinstance(node, dict):
                continue
            if node.get("op") == "put_text" and isinstance(node.get("content"), str):
                found.append((work, f"section-{node.get('section_id')}", node.get("language"), node["content"]))
                continue
            own = node.get("section_key") or node.get("slug") or str(node.get("id") or "")
            if "section_type" in node and node.get("id") is not None and not node.get("section_key"):
                own = f"section-{node['id']}"
            key = own or key
            texts = node.get("texts")
            listed = [(t.get("language"), t.get("content")) for t in texts if isinstance(t, dict)] if isinstance(texts, list) else []
            listed += [(lang, t.get("content") if isinstance(t, dict) else t) for lang, t in texts.items()] if isinstance(texts, dict) else []
            found += [(work, key, lang, text) for lang, text in listed if isinstance(text, str)]
            todo += [(v, key) for k, v in reversed(node.items()) if k != "texts"]
    return found


_UNITS = "array<struct<work:string,section:string,language:string,content:string>>"
manifest_texts = by_text(lambda t: [dict(zip(("work", "section", "language", "content"), x, strict=True)) for x in _texts(t)], _UNITS)


def read_corpus(spark: SparkSession, patterns: list[str], exclude: tuple[str, ...] = (), language: str = "la", recursive: bool = False) -> DataFrame:
    """(path, unit, text): .md and .txt files whole under their stem, and the texts of one language in manifests (.json) under their section, those of one section joined by blank lines. [S2, S11]

    A file that several patterns match is read once; patterns in ``exclude`` (with * and ?) leave paths out; broken JSON is left out.
    """
    rows = _files(spark, patterns, list(exclude), recursive)
    stem = F.regexp_extract("path", r"([^/]+?)\.[^./]*$", 1)
    plain = rows.where(F.col("path").rlike(r"\.(md|txt)$")).select("path", stem.alias("unit"), "text")
    units = rows.where(F.col("path").rlike(r"\.json$")).select("path", F.posexplode(manifest_texts("text")).alias("pos", "x")).where(F.col("x.language") == language)
    named = F.when(F.col("x.work") != "", F.concat_ws("/", "x.work", "x.section")).otherwise(F.col("x.section"))
    units = units.groupBy("path", named.alias("unit")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x.content"))), lambda y: y["content"]), "\n\n").alias("text"))
    return plain.unionByName(units)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): the lines of text files with their numbers from 1. [S3]

    A large file is read in byte ranges by many tasks. Each task numbers the lines of its ranges as it meets them; the ranges' line counts (a row for each range of
    ``spark.sql.files.maxPartitionBytes``) are summed along their file and give every range its first number. Lines are never shuffled or
    sorted.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_nth"), F.regexp_replace("value", r"\r$", "").alias("value")
    )
    ranges = rows.groupBy("path", "_start").agg(F.min("_nth").alias("_first"), F.count("*").alias("_n"))
    along = W.partitionBy("path").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("path", "_start", (F.coalesce(F.sum("_n").over(along), F.lit(0)) - F.col("_first") + 1).alias("_base"))
    return rows.join(ranges, ["path", "_start"]).select("path", (F.col("_nth") + F.col("_base")).alias("line"), "value")


def read_rows(spark: SparkSession, path: str, schema: str, missing_ok: bool = True, numbered: bool = True) -> DataFrame:
    """JSON lines as (schema, line): blank lines are skipped but counted, a broken line is an error, and a missing file is an empty relation. [S3]

    Without ``numbered`` there is no line, and Spark's own reader of JSON takes the file: filters on the columns are then pushed down
    into its parser. Both read one file in as many tasks as it has byte ranges.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if missing_ok and not p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p):
        return spark.createDataFrame([], schema + (", line long" if numbered else ""))
    if not numbered:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "line").select("r.*", "line")


def write_rows(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, without null fields and without those that begin with _ (where a row came from). [S3]"""
    rows.select(*[c for c in rows.columns if not c.startswith("_")]).write.mode("overwrite").json(path)


class TableRefused(ValueError):
    """A table has malformed rows: none of it is read."""


def read_table(spark: SparkSession, path: str, columns: list[str], rules: dict[str, Column] | None = None, unique: tuple[str, ...] = (), least: int = 0, comments: bool = True) -> DataFrame:
    """A tab-separated table with a header (columns, line): # lines are comments, and any malformed row refuses the whole table. [S4]

    A row needs ``least`` columns (all, if 0) and must meet every rule; ``unique`` columns may not repeat together. The refusal names
    up to 20 rows. Tables of this kind are dimensions: a few thousand lines.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "x")).where(F.trim("x") != "")
    lines = lines.where(~F.col("x").startswith("#")) if comments else lines
    rows = lines.select((F.col("line") + 1).alias("line"), F.split("x", "\t", -1).alias("c"))
    rows = rows.where(~((F.col("line") == 1) & (F.col("c")[0] == columns[0])))
    rows = rows.select("line", F.size("c").alias("_n"), *[F.get("c", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    bad = [("too few columns", F.col("_n") < (least or len(columns))), *[(name, ~F.coalesce(rule, F.lit(False))) for name, rule in (rules or {}).items()]]
    found = rows.select("line", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in bad]))).alias("problem"))
    if unique:
        twice = rows.groupBy(*unique).agg(F.max("line").alias("line"), F.count("*").alias("k")).where("k > 1")
        found = found.unionByName(twice.select("line", F.lit("repeated").alias("problem")))
    named = found.orderBy("line").limit(20).collect()
    if named:
        raise TableRefused(f"{path}: " + "; ".join(f"line {r.line}: {r.problem}" for r in named))
    return rows.drop("_n")


def spelling_rules() -> dict[str, Column]:
    """Rules of a spelling map (form, edition, reason): forms of letters alone, with $ at their end for whole words, and a reason."""
    return {"form": F.col("form").rlike(r"^\p{L}+\$?$"), "edition": F.col("edition").rlike(r"^\p{L}+$"), "reason": F.trim("reason") != ""}


def decision_rules() -> dict[str, Column]:
    """Rules of decisions (page, token, occurrence, edition, method, evidence): a method of the vocabulary, and evidence."""
    return {"method": F.col("method").isin("editor", "scan"), "evidence": F.trim("evidence") != ""}


def witness_pages(maps: DataFrame, text: str = "text") -> DataFrame:
    """(key, text) of witness maps in JSON: values are texts, two columns (left and right, joined by a space), or objects with a text. [S5]"""
    value = F.col("v")
    field = lambda f: F.get_json_object(value, f"$.{f}")
    both = F.concat_ws(" ", field("left"), field("right"))
    rows = maps.select(F.explode(F.from_json(text, "map<string,string>")).alias("key", "v"))
    found = F.when(~value.rlike(r"^\s*\{"), value).when(field("text").isNotNull(), field("text")).when(field("left").isNotNull() | field("right").isNotNull(), both)
    return rows.select("key", found.alias("text"))


def page_witness(pages: DataFrame, witnesses: DataFrame, keys: tuple[str, ...] = ("pg-{page}.jpg", "pg-{page}", "p{page}.md", "{page}")) -> DataFrame:
    """Add witness to pages (page string): the text under the first of the key patterns that the map has. [S5]"""
    tried = pages.select("page", F.posexplode(F.array(*[F.format_string(k.replace("{page}", "%s"), F.col("page")) for k in keys])).alias("_i", "key"))
    best = tried.join(witnesses, "key").groupBy("page").agg(F.min_by("text", "_i").alias("witness"))
    return pages.join(best, "page", "left")


_WORD = re.compile(r'<word xMin="([\d.]+)" yMin="([\d.]+)" xMax="([\d.]+)" yMax="([\d.]+)">(.*?)</word>', re.S)


def _boxes(text: str) -> list[dict]:
    out: list[dict] = []
    for number, page in enumerate(re.split(r"<page\b[^>]*>", text)[1:], 1):
        held = None
        for line in re.split(r"<line\b[^>]*>", page) if "<line" in page else [page]:
            words = [(*map(float, m.groups()[:4]), html.unescape(m[5])) for m in _WORD.finditer(line)]
            for k, (x0, y0, x1, y1, word) in enumerate(words):
                if held and k == 0:
                    (x0, y0, x1, y1), word, held = held[0], held[1] + word, None
                if k == len(words) - 1 and len(word) > 1 and word[-1] in "-¬":
                    held = ((x0, y0, x1, y1), word[:-1])
                else:
                    out.append({"page": number, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "word": word})
        if held:
            out.append({"page": number, **dict(zip(("x0", "y0", "x1", "y1"), held[0], strict=True)), "word": held[1]})
    return out


#: Words of a text layer with boxes, as written by a PDF tool: a word cut at a line's end is one, with its first half's box. [S6]
word_boxes = by_text(_boxes, "array<struct<page:int,x0:double,y0:double,x1:double,y1:double,word:string>>")


def crop_box(boxes: DataFrame, keys: list[str], pad: float = 6.0, tallest: float = 120.0) -> DataFrame:
    """(keys, page, x0, y0, x1, y1) around each group's words on the page that has most of them; boxes that are too tall are left out. [S14, A14, T24]"""
    per = boxes.groupBy(*keys, "page").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    best = per.groupBy(*keys).agg(F.max_by(F.struct("page", "x0", "y0", "x1", "y1"), F.struct("n", -F.col("page"))).alias("b"))
    out = best.select(*keys, "b.page", (F.col("b.x0") - pad).alias("x0"), (F.col("b.y0") - pad).alias("y0"), (F.col("b.x1") + pad).alias("x1"), (F.col("b.y1") + pad).alias("y1"))
    return out.where(F.col("y1") - F.col("y0") <= tallest)


def packets(sites: DataFrame, order: str, size: int = 25, by: str | None = None) -> DataFrame:
    """Add packet: runs of ``size`` sites in order (within ``by``); sites that differ in spelling alone should be left out before. [S14]"""
    return positions(sites, [by] if by else [], order, "_pos").withColumn("packet", F.floor(F.col("_pos") / size).cast("long")).drop("_pos")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _runs(paragraph: ElementTree.Element) -> list[tuple[bool, str]]:
    out = []
    for run in paragraph.iter(f"{_W}r"):
        mark = run.find(f"{_W}rPr/{_W}i")
        italic = mark is not None and mark.get(f"{_W}val") not in ("0", "false")
        text = ""
        for x in run:
            name = x.tag.removeprefix(_W)
            text += {"br": " ", "cr": " ", "tab": " ", "noBreakHyphen": "-"}.get(name, "")
            text += (x.text or "") if name == "t" else chr(int(x.get(f"{_W}char"), 16)) if name == "sym" else ""
        out.append((italic, re.sub("[­​-‍﻿]", "", text).replace(" ", " ")))
    return out


def _docx(data: bytes) -> list[dict]:
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = [("body", ElementTree.fromstring(z.read("word/document.xml")).iter(f"{_W}p"))]
        if "word/footnotes.xml" in z.namelist():
            notes = [n for n in ElementTree.fromstring(z.read("word/footnotes.xml")).iter(f"{_W}footnote") if int(n.get(f"{_W}id", "0")) > 0]
            parts.append(("note", (p for n in notes for p in n.iter(f"{_W}p"))))
        for kind, paragraphs in parts:
            for p in paragraphs:
                flags, text = [], ""
                for italic, piece in _runs(p):
                    text += piece
                    flags += [italic] * len(piece)
                words = [(m[0], flags[m.start()]) for m in re.finditer(r"\S+", text)]
                if words:
                    out.append({"kind": kind, "text": " ".join(w for w, _ in words), "italic": [i for _, i in words]})
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, kind, text, italic) of the paragraphs and then the footnotes of Word files: white space collapsed, invisible characters gone, one italic flag a word. [S7]"""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, *x.values()) for p, c in zip(b["path"], b["content"], strict=True) for i, x in enumerate(_docx(c))]
            yield pd.DataFrame(rows, columns=["path", "pos", "kind", "text", "italic"])

    return files.mapInPandas(parse, StructType.fromDDL("path string, pos long, kind string, text string, italic array<boolean>"))


def _html(data: bytes | None) -> list[dict]:
    if data is None:
        return []
    try:
        text = bytes(data).decode("utf-8")
    except UnicodeDecodeError:
        named = re.search(rb"charset=[\"']?([\w-]+)", bytes(data))
        charset = named[1].decode().lower() if named else "cp1252"
        text = bytes(data).decode("cp1252" if charset in ("latin1", "iso-8859-1") else charset, "replace")
    text = re.sub(r"(?is)<!--.*?-->|<head\b.*?</head>|<(script|style)\b.*?</\1>", "", text)
    body = re.search(r"(?is)<body\b[^>]*>(.*)</body>", text)
    text = body[1] if body else text
    notes = re.findall(r"(?is)<div[^>]*id=[\"']sdfootnote\d+[\"'][^>]*>(.*?)</div>", text)
    text = re.sub(r"(?is)<div[^>]*id=[\"']sdfootnote\d+[\"'][^>]*>.*?</div>", "", text)
    clean = lambda x: re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"(?i)<br\s*/?>", " ", x)))).strip()
    out = []
    for p in re.findall(r"(?is)<p\b[^>]*>(.*?)</p>", text):
        if re.fullmatch(r"(?is)\s*(?:<a\b[^>]*>.*?</a>[\s|·]*)+", p) or not clean(p):
            continue
        note = out and re.match(r"\[?\d+\]? ", clean(p))
        out.append({"kind": "note" if note else "body", "text": clean(p)})
    return out + [{"kind": "note", "text": clean(n)} for n in notes if clean(n)]


#: Paragraphs of web pages (bytes): boilerplate and paragraphs of links dropped, numbered ones after the first are notes, entities decoded last; UTF-8, or the charset a page names. [S8]
html_blocks = by_text(_html, "array<struct<kind:string,text:string>>")


def witness_text(page: Column) -> Column:
    """A page's text for a witness: tags to spaces, the entities of space and copyright decoded, white space collapsed. [S8]"""
    out = F.regexp_replace(page, r"(?s)<[^>]*>", " ")
    out = F.replace(F.replace(out, F.lit("&nbsp;"), F.lit(" ")), F.lit("&copy;"), F.lit("©"))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def cut_records(texts: DataFrame, header: str, names: list[str], key: str = "path", text: str = "text") -> DataFrame:
    """(key, pos, names..., body): an edition's records, each from a header that the pattern matches (its groups give ``names``) to the next. [S9]"""
    groups = [F.regexp_extract_all(text, F.lit(header), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    bodies = F.slice(F.split(text, F.lit(re.sub(r"(?<!\\)\((?!\?)", "(?:", header)), F.lit(-1)), 2, 1 << 30).alias("body")
    return texts.select(key, F.posexplode(F.arrays_zip(*groups, bodies)).alias("pos", "x")).select(key, "pos", *[F.col("x").getField(n).alias(n) for n in names], F.trim(F.regexp_replace(F.col("x").getField("body"), r"^\s+|\s+$", "")).alias("body"))


# How an edition's records begin (number, book, chapters, kind), and what its last record ends in.
RECORD_HEADER = r"\[(\d+)\] [A-Za-z .']+, lib\. (\d) cap\. ([\d\-]+)\s*(tit|n)\."
RECORD_NAMES = ["id", "liber", "caps", "kind"]
RECORD_TAIL = "© 2019"


def _owners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which record begins the chapter that each record belongs to, and the chapters it stands for: rows are books with their records (path, pos, low, high, kind) in order, without their texts."""
    for b in batches:
        out = []
        for book in b.itertuples(index=False):
            owner: dict[int, tuple] = {}
            file, inside = None, False
            for path, pos, low, high, kind in zip(book.path, map(int, book.pos), map(int, book.low), map(int, book.high), book.kind, strict=True):
                if path != file:
                    file, inside = path, False
                if kind == "tit" or low not in owner:
                    inside = True
                    new = [c for c in range(low, high + 1) if c not in owner]
                    owner.update(dict.fromkeys(new, (path, pos)))
                    out.append((book.work, book.liber, path, pos, path, pos, new))
                elif inside:
                    out.append((book.work, book.liber, path, pos, *owner[low], []))
        yield pd.DataFrame(out, columns=["work", "liber", "path", "pos", "o_path", "o_pos", "starts"])


def edition_chapters(texts: DataFrame, header: str = RECORD_HEADER, tail: str = RECORD_TAIL, key: str = "path", text: str = "text", work: str | None = None) -> DataFrame:
    """(work, liber, cap, low, high, title, text): an edition's chapters from its records, in the order of the files' names and within them; without ``work`` all files are one. [S9]

    A record ``N-M`` stands for all chapters from N to M, which share its text. A ``tit`` record begins a chapter with that title; so does an ``n`` record of
    a chapter that none began, without a title. The first that begins a chapter has it; later records of a chapter add their text, with a space, to
    what has its first number. In a file, an ``n`` record before any that begins is left out if its chapter was begun elsewhere. Tags become spaces, the
    entities of space and copyright are decoded, white space is collapsed, and what follows ``tail`` goes, with a record that has nothing else.

    Only the records' numbers go through a book's one task; texts are joined to them and put together by chapter.
    """
    named = texts.select(F.struct((F.col(work) if work else F.lit("")).cast("string").alias("work"), F.col(key).cast("string").alias("path")).alias("_k"), F.col(text).alias("_t"))
    rows = cut_records(named, header, RECORD_NAMES, "_k", "_t").select("_k.work", "_k.path", "pos", F.col("liber").cast("int").alias("liber"), "caps", "kind", witness_text(F.col("body")).alias("body"))
    rows = rows.withColumn("_cut", F.col("body").contains(tail)).withColumn("body", F.when(F.col("_cut"), F.trim(F.element_at(F.split("body", F.lit("\\Q" + tail + "\\E")), 1))).otherwise(F.col("body")))
    rows = rows.where(~F.col("_cut") | (F.col("body") != "")).drop("_cut")
    span = F.split("caps", "-")
    rows = rows.withColumns({"low": span[0].cast("int"), "high": F.when(F.size(span) > 1, F.element_at(span, 2)).otherwise(span[0]).cast("int")})
    rows = staged(rows, "records")
    small_batches(texts.sparkSession)
    books = rows.groupBy("work", "liber").agg(F.sort_array(F.collect_list(F.struct("path", "pos", "low", "high", "kind"))).alias("x")).select("work", "liber", "x.path", "x.pos", "x.low", "x.high", "x.kind")
    owners = books.mapInPandas(_owners, "work string, liber int, path string, pos int, o_path string, o_pos int, starts array<int>")
    place = ["work", "liber", "path", "pos"]
    met = rows.join(owners, place)
    mine = (F.col("path") == F.col("o_path")) & (F.col("pos") == F.col("o_pos"))
    said = F.when(~(mine & (F.col("kind") == "tit")) & (F.col("body") != ""), F.struct("path", "pos", "body"))
    whole = met.groupBy("work", "liber", F.col("o_path").alias("path"), F.col("o_pos").alias("pos")).agg(F.sort_array(F.collect_list(said)).alias("x"))
    whole = whole.select(*place, F.array_join(F.transform("x", lambda r: r["body"]), " ").alias("text"))
    begun = met.where(mine).select(*place, "low", "high", F.when(F.col("kind") == "tit", F.col("body")).otherwise("").alias("title"), F.explode("starts").alias("cap"))
    return begun.join(whole, place).select("work", "liber", "cap", "low", "high", "title", "text")


def source_flow(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, pos, line): one paragraph for each non-blank line of the source files, to be read in the order of their names. [S10]"""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return files.select(path, F.posexplode(lines).alias("pos", "line"))
