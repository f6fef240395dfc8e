"""Lines that repeat across documents, dropped but for one document, by two Bloom filters."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_BYTES, U64, join_groups, small_batches, split_by, staged, tidy, unstage

#: Production values: a key has so many code points at least, and goes from so many documents on.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Bits of a filter for each line, and the most bits of one filter (64 MB), as a power of two. Beyond that more lines are suspected
#: and shuffled as digests; results are the same.
LINE_BITS, FILTER_BITS = 16, 29
#: Interleaved parts of the filters, which are merged side by side; keys of a task held until their bits are given out.
PARTS, HELD = 64, 1 << 19


def keyed_lines(text: bytes, least: int) -> dict[bytes, list[int]]:
    """The numbers of a text's lines by key (as a digest of 16 bytes): stripped, A-Z lower-cased, ``least`` code points or more."""
    out: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split(b"\n")):
        if len(line) >= least:
            key = line.strip(SPACE_BYTES).lower()  # bytes: only A-Z have a lower case
            if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
                out.setdefault(blake2b(key, digest_size=16).digest(), []).append(i)
    return out


def bits_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The two bits that each digest (a row of two numbers) sets in a filter of 2**bits bits."""
    return keys & U64((1 << bits) - 1)


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    for x in batch.column(name).cast(pa.binary()):
        yield x.as_py() or b""


def repeated_filter(docs: DataFrame, least: int, bits: int) -> np.ndarray:
    """The packed twice-seen filter over the keys of all documents (text).

    Each task gives the bits of its keys to the once-seen filter, and those of keys that several of its documents have to the twice-seen
    one too. Where tasks meet, a bit that is given to the once-seen filter again goes to the twice-seen filter; so every key of two
    documents or more has both bits there, and a key seen once has them only by chance.
    """

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def out() -> pa.RecordBatch:
            keys = np.frombuffer(b"".join(held), U64).reshape(-1, 2)
            held.clear()
            keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
            first = np.ones(len(keys), bool)
            first[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            again = np.unique(bits_of(keys[~first], bits))
            once = np.unique(bits_of(keys[first], bits))
            rows = []
            for p in range(PARTS):
                of = [(x[x % U64(PARTS) == p] // U64(PARTS)).astype(np.uint32).tobytes() for x in (once, again)]
                if of[0]:
                    rows.append((p, *of))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                ["part", "once", "again"],
            )

        for b in batches:
            for text in _texts(b):
                held.extend(keyed_lines(text, least))
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["part", "twice"])

        for b in batches:
            for p, o, a in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if p != part:
                    if part is not None:
                        yield done()
                    part, once, twice = p, np.zeros((1 << bits) // PARTS, bool), np.zeros((1 << bits) // PARTS, bool)
                o, a = np.frombuffer(o, np.uint32), np.frombuffer(a, np.uint32)
                twice[o[once[o]]] = True
                once[o] = True
                twice[a] = True
        if part is not None:
            yield done()

    given = docs.select("text").mapInArrow(tidy(give), "part int, once binary, again binary")
    met = given.repartition(PARTS, "part").sortWithinPartitions("part").mapInArrow(tidy(merge), "part int, twice binary")
    width = (1 << bits) // PARTS // 8
    out = np.zeros((PARTS, width), np.uint8)
    for r in met.collect():  # the filter: 64 MB at most
        out[r.part] = np.frombuffer(r.twice, np.uint8)
    return out


def suspected(rows: DataFrame, seen_twice: np.ndarray, least: int, bits: int) -> DataFrame:
    """(key, doc_id, row, lines) for the keys of each row (doc_id, row, text) that the twice-seen filter holds."""
    shared = rows.sparkSession.sparkContext.broadcast(seen_twice)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = shared.value
        for b in batches:
            ids, names = b.column("doc_id").to_pylist(), b.column("row").to_pylist()
            keys, at, lines = [], [], []
            for i, text in enumerate(_texts(b)):
                for key, where in keyed_lines(text, least).items():
                    keys.append(key)
                    at.append(i)
                    lines.append(where)
            if not keys:
                continue
            bit = bits_of(np.frombuffer(b"".join(keys), U64).reshape(-1, 2), bits)
            inside = bit // U64(PARTS)
            found = ((filter_[bit % U64(PARTS), inside >> U64(3)] >> (inside & U64(7)).astype(np.uint8)) & 1).all(axis=1)
            some = np.flatnonzero(found).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[k] for k in some], pa.binary()), pa.array([ids[at[k]] for k in some], pa.int64()),
                    pa.array([names[at[k]] for k in some], pa.binary()), pa.array([lines[k] for k in some], pa.list_(pa.int32())),
                ],
                ["key", "doc_id", "row", "lines"],
            )

    return rows.mapInArrow(tidy(probe), "key binary, doc_id long, row binary, lines array<int>")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, dropped, total = [], [], []
        for text, gone in zip(_texts(b), b.column("gone").to_pylist(), strict=True):
            lines, out = text.split(b"\n"), set(gone or ())
            total.append(len(lines))
            dropped.append(len(out))
            kept.append(b"\n".join([x for i, x in enumerate(lines) if i not in out]) if out else text)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())],
            ["doc_id", "kept", "n_lines", "n_dropped"],
        )


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Each row's (doc_id, kept, n_lines, n_dropped): ``kept`` is its text without the lines that go.

    A line's key is the line without white space at its ends and with A-Z in lower case. Keys of ``least_chars`` code points or more that
    ``least_docs`` documents or more hold lose all their lines, but for those in the document of the largest id. Documents are told
    apart by id; rows that repeat an id are one document, all rows without an id are one too, which never counts as the largest. Null text is empty: one
    empty line, kept as the empty text. Extra columns are left out, an empty table gives no rows. A document all of whose lines go has
    the empty text left.

    Texts are read in five passes and never shuffled, but for those that lose a line: they meet the numbers of their lines by a digest of
    id and text. Only bits of filters and the digests of suspected lines are shuffled besides. The input must come from files or a staged table.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    lines = rows.agg(F.sum(n_lines)).first()[0] or 0
    bits = min(filter_bits, max(15, int(LINE_BITS * lines).bit_length()))
    name = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")).cast("binary")))
    named = rows.withColumn("row", name)
    found = staged(suspected(named, repeated_filter(rows, least_chars, bits), least_chars, bits), "suspected")
    total = found.count()
    by_doc = found.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    keys = by_doc.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_id"), F.sum("n").alias("n"))
    keys = staged(keys.where(F.col("n_docs") >= least_docs), "repeated")
    lost = join_groups(found, keys, ["key"], "n", total).where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # rows that repeat as a whole share their name and their lines: a set holds those once
    gone = staged(lost.groupBy("row").agg(F.flatten(F.collect_set("lines")).alias("gone")), "gone")
    unstage(found, keys)
    place = F.xxhash64("row")
    some, others = split_by(named.withColumn("_h", place), "_h", gone.select(place.alias("h")))
    cut = some.join(gone, "row", "left").select("doc_id", "text", "gone")
    cut = cut.mapInArrow(tidy(_without), "doc_id long, kept string, n_lines long, n_dropped long")
    return cut.unionByName(others.select("doc_id", F.col("text").alias("kept"), n_lines.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: lines of 40 code points or more that five documents hold; the digest of what each keeps."""
    got = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op12_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
m AS (SELECT k.*, g.key IS NOT NULL AND doc_id <> keep_id AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
}
QUERIES = {"op12_line_dedup": op12_line_dedup}
