"""Publishing an edition all or nothing: versions in folders of their own, a record of hashes, one atomic step that makes a version current."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.shared import delete

#: White space as it is cut off a section's ends.
_ENDS = r"^\s+|\s+$"
CURRENT = "CURRENT"


class PublishRefused(ValueError):
    """There are findings, or what was written isn't what was meant: nothing is published."""


def section_record(sections: DataFrame) -> DataFrame:
    """(key, words, sha256) of sections (key, body): words between white space and the hash of the text without white space at its ends."""
    body = F.regexp_replace(F.coalesce("body", F.lit("")), _ENDS, "")
    words = F.when(body == "", 0).otherwise(F.size(F.split(body, r"\s+"))).cast("long")
    return sections.select("key", words.alias("words"), F.sha2(body.cast("binary"), 256).alias("sha256"))


def _digest(rows: DataFrame, *columns: Column) -> tuple[int, str]:
    """(rows, a number that follows from all rows in any order): two 64-bit hashes, each summed over the rows."""
    value = F.concat_ws("\0", *[F.coalesce(c.cast("string"), F.lit("\1")) for c in columns])
    sums = [F.sum(F.xxhash64(F.lit(salt), value).cast("decimal(38,0)")).alias(f"s{salt}") for salt in (1, 2)]
    r = rows.agg(F.count("*").alias("n"), *sums).first()
    return r.n, f"{int(r.s1 or 0) & (1 << 96) - 1:024x}{int(r.s2 or 0) & (1 << 96) - 1:024x}"


class EditionStore:
    """An edition's versions under a folder.

    ``versions/<name>/sections`` (key, body), ``record`` (key, words, sha256) and ``pages`` (name, sha256) are written first, then read back and compared with
    what was meant; then ``versions/<name>/EDITION.json`` says what the version holds; last, CURRENT is put in place by one rename that replaces
    it. A reader sees the old version or the new one, never parts. A writer that dies leaves a folder that nobody reads; writing the
    same edition again finds its name, which follows from its content, and starts over or, if it was complete, only makes it current.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- small files through Hadoop's file systems

    def _file(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self):
        return self._file().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, *parts: str) -> str | None:
        p = self._file(*parts)
        if not self._fs().exists(p):
            return None
        return "\n".join(r.value for r in self.spark.read.text(p.toString()).collect())  # a small file of this class

    def _replace(self, name: str, content: str) -> None:
        """Write a small file beside its place and move it there in one step."""
        fs, new = self._fs(), self._file(f".{name}.new")
        out = fs.create(new, True)
        out.write(bytearray(content.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._file().toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, self._file(name), options)

    # ---- versions

    def current(self) -> str | None:
        """The name of the version that readers see."""
        return self._read(CURRENT)

    def _frame(self, kind: str, version: str | None = None) -> DataFrame:
        version = version or self.current()
        if version is None:
            raise FileNotFoundError(f"{self.path} has no edition")
        return self.spark.read.parquet(f"{self.path}/versions/{version}/{kind}")

    def sections(self) -> DataFrame:
        return self._frame("sections")

    def record(self) -> DataFrame:
        return self._frame("record")

    def pages(self) -> DataFrame:
        return self._frame("pages")

    def publish(self, sections: DataFrame, pages: DataFrame, findings: DataFrame, report: list[str] = (), options: dict | None = None) -> str:
        """Publish sections (key, body) made from pages (name, sha256), unless ``findings`` has rows or a key repeats; return the version's name. [K1]"""
        found = findings.limit(20).collect()
        twice = sections.groupBy("key").agg(F.count("*").alias("n")).where("n > 1 or key is null").limit(20).collect()
        problems = [" ".join(str(x) for x in r if x is not None) for r in found] + [f"{r.key}: {r.n} sections" for r in twice]
        if problems:
            raise PublishRefused("; ".join(problems))
        sections, record = sections.select("key", "body"), section_record(sections)
        meant = {"sections": _digest(record, F.col("key"), F.col("words"), F.col("sha256")), "pages": _digest(pages, F.col("name"), F.col("sha256"))}
        version = F.sha2(F.lit(json.dumps([meant, sorted((options or {}).items())], default=str)), 256)
        version = self.spark.range(1).select(F.substring(version, 1, 32)).first()[0]
        home = f"versions/{version}"
        if self._read(home, "EDITION.json") is None:
            delete(self.spark, f"{self.path}/{home}")  # what a writer that died has left of this very version
            sections.write.parquet(f"{self.path}/{home}/sections")
            written = self._frame("sections", version)
            section_record(written).write.parquet(f"{self.path}/{home}/record")
            pages.select("name", "sha256").write.parquet(f"{self.path}/{home}/pages")
            got = {
                "sections": _digest(self._frame("record", version), F.col("key"), F.col("words"), F.col("sha256")),
                "pages": _digest(self._frame("pages", version), F.col("name"), F.col("sha256")),
            }
            if got != meant:
                raise PublishRefused(f"written {got}, meant {meant}: the input changed while it was written")
            totals = self._frame("record", version).agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
            self._replace(f"{home}/EDITION.json", json.dumps({"sections": totals[0], "words": totals[1], "report": list(report), "options": options or {}}, ensure_ascii=False))
        self._replace(CURRENT, version)
        return version

    def check(self) -> DataFrame:
        """(key, problem) of sections of the current version that are not what its record says: changed, lost or added after it was published."""
        now = section_record(self.sections()).select("key", F.col("sha256").alias("now"))
        met = self.record().select("key", "sha256").join(now, "key", "full")
        problem = F.when(F.col("now").isNull(), "lost").when(F.col("sha256").isNull(), "added").when(F.col("now") != F.col("sha256"), "changed")
        return met.select("key", problem.alias("problem")).where("problem is not null")

    def clean(self) -> list[str]:
        """Remove all versions but the current one; returns their names. Not while readers may hold an older one."""
        keep, gone = self.current(), []
        home = self._file("versions")
        for status in self._fs().listStatus(home) if self._fs().exists(home) else ():
            name = status.getPath().getName()
            if name != keep:
                delete(self.spark, f"{self.path}/versions/{name}")
                gone.append(name)
        return gone


# ---------------------------------------------------------------- batches


def refusals(batch: DataFrame, reports: DataFrame) -> DataFrame:
    """(manifest, problem) of batches (manifest, content) that may not go out: without a report (manifest, sha256, gate, passed), with one on other bytes, or with a gate that failed. [K5, T20]"""
    made = batch.select("manifest", F.sha2(F.col("content").cast("binary"), 256).alias("now"))
    said = reports.groupBy("manifest").agg(F.max("sha256").alias("sha256"), F.min("sha256").alias("_other"), F.bool_and(F.coalesce("passed", F.lit(False))).alias("passed"))
    met = made.join(said, "manifest", "left")
    stale = (F.col("sha256") != F.col("now")) | (F.col("_other") != F.col("now"))
    problem = F.when(F.col("sha256").isNull(), "no report").when(stale, "report on another manifest").when(~F.col("passed"), "a gate failed")
    return met.select("manifest", problem.alias("problem")).where("problem is not null")


def recorded_pages(pages: DataFrame, uploads: DataFrame) -> DataFrame:
    """Pages (batch, page, sha256) with the hash that is recorded for them: that of the upload, if every page of the batch went (its last upload has a status of 200 to 299); else null for all. [K5]"""
    last = uploads.groupBy("batch", "page").agg(F.max_by("status", "ts").alias("_status"))
    met = pages.join(last, ["batch", "page"], "left")
    went = met.groupBy("batch").agg(F.bool_and(F.coalesce(F.col("_status").between(200, 299), F.lit(False))).alias("_went"))
    return met.join(went, "batch").select("batch", "page", F.when(F.col("_went"), F.col("sha256")).alias("sha256"))
