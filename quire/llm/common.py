"""What several operators share: the shared folder, staged tables, byte blocks and hashing of words in numpy."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled by one numpy pass; temporaries take about 30 times as much.
BLOCK_BYTES = 1 << 19
#: The white space that separates words (space, tab to carriage return).
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local master (as in tests) gets one of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    got = sc._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


_homes: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _delete_homes() -> None:
    spark = SparkSession.getActiveSession()
    if spark and spark.sparkContext._jsc:
        for home in _homes:
            _delete(spark, home)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder for staged tables, which goes when the driver's Python ends."""
    home = f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}"
    if not _homes:
        atexit.register(_delete_homes)
    _homes.add(home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and a lost executor costs nothing that was staged."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_path = path
    return back


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in frames:
        path = getattr(df, "staged_path", None)
        if path:
            _delete(df.sparkSession, path)


def small_batches(spark: SparkSession, limit: int = 2 << 20) -> None:
    """Hold the session's Arrow batches to 2 MB of data, so that Python workers and their buffers stay small whatever the texts' length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key)) or 0) > limit:
        spark.conf.set(key, str(limit))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done: it does so when their objects are collected as garbage."""
    gc.collect()
    spark._jvm.System.gc()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for mapInArrow, after which the worker gives free memory back: workers live on between tasks, and executors are bounded."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
        if trim:
            trim(0)

    return tidied


# ---------------------------------------------------------------- vectors folded over tasks

SLOTS = 64


def slots_of(vector: np.ndarray, kind: str | None = None) -> pa.RecordBatch:
    """A task's vector as rows (slot, blob) of its 64 interleaved parts, those of zeros alone left out."""
    parts = [(k, x) for k, x in enumerate(vector.reshape(-1, SLOTS).T) if x.any()]
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in parts], pa.int32()), pa.array([(x.astype(kind) if kind else x).tobytes() for _, x in parts], pa.binary())], ["slot", "blob"]
    )


def fold(df: DataFrame, kind: str, op: str, wide: str | None = None) -> np.ndarray:
    """Fold rows (slot int, blob binary) of all tasks into one vector of fixed size on the driver; ``op`` is or, or add (in numbers of type ``wide``)."""
    wide = wide or kind

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for slot, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(blob, kind)
                if slot not in got:
                    got[slot] = v.astype(wide)
                elif op == "or":
                    got[slot] |= v
                else:
                    got[slot] += v
        for slot, v in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["slot", "blob"])

    n = min(SLOTS, 2 * df.sparkSession.sparkContext.defaultParallelism)
    parts = df.select("slot", "blob").repartition(n, "slot").mapInArrow(tidy(add), "slot int, blob binary").collect()
    width = max((len(r[1]) for r in parts), default=0) // np.dtype(wide).itemsize
    out = np.zeros((SLOTS, max(1, width)), wide)
    for slot, blob in parts:
        out[slot] = np.frombuffer(blob, wide)
    return out.T.reshape(-1)


#: Groups with more than one in so many of all rows are hot; there are fewer of them than that.
HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with their group's row, which holds in ``count`` how many rows it has; the keys have no nulls.

    Rows of hot groups meet those (fewer than HOT, whatever the input) by broadcast and are not shuffled; all other groups are at most a
    HOT-th of the rows, so no task of the shuffled join gets much more than its share.
    """
    hot = F.broadcast(groups.where(F.col(count) > max(100, total // HOT)))
    cold = groups.join(hot.select(*keys), keys, "left_anti")
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold, keys))


#: Most bits of the bitmaps over hashes (64 MB, as a power of two).
BITMAP_BITS = 29


def split_by(rows: DataFrame, column: str, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash (a long column without nulls) may be among ``members`` (one column), and those whose isn't.

    The members' bitmaps, sized by their number up to BITMAP_BITS, are broadcast: so rows without a member are never shuffled. Members
    beyond that size only make the first part larger; an exact join must follow on it.
    """
    n = members.count()
    bits = min(BITMAP_BITS, max(15, (64 * n).bit_length()))
    at = lambda c: F.pmod(c, F.lit(1 << bits))
    place = members.select(at(F.col(members.columns[0])).alias("x"))
    maps = place.groupBy(F.bitmap_bucket_number("x").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("_bitmap"))
    x = at(F.col(column))
    met = rows.withColumn("_place", x).join(F.broadcast(maps), F.bitmap_bucket_number(x) == F.col("_bucket"), "left")
    bit = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bitmap", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.expr("shiftright(_byte, cast(_bit % 8 as int)) & 1") == 1, F.lit(False))
    met = met.withColumn("_bit", bit).withColumn("_byte", byte).withColumn("_may", may)
    return met.where("_may").select(*rows.columns), met.where("not _may").select(*rows.columns)


def drawn(rows: DataFrame, n: int, max_rows: int, max_bytes: int, text: str = "text") -> DataFrame:
    """A bounded sample of the different ones of ``n`` rows, in the order of a hash of all columns: ``max_rows`` and ``max_bytes`` of text at most (but one text at least). Repeated rows count once, however many they are."""
    draw, space = "_draw", 1 << 24
    marked = rows.withColumn(draw, F.xxhash64(*rows.columns))
    rank = F.pmod(draw, F.lit(space))
    some = marked.where(rank < int(min(1.0, 2 * max_rows / max(n, 1)) * space) + 1)
    sizes = some.groupBy(draw).agg(F.max(F.octet_length(text)).alias("size")).orderBy(rank, draw).limit(max_rows).collect()
    picked, left = [], max_bytes
    for r in sizes:
        if r["size"] <= left:
            picked.append(r[draw])
            left -= r["size"]
    if not picked and sizes:
        picked = [min(sizes, key=lambda r: r["size"])[draw]]
    return some.where(F.col(draw).isin(picked)).dropDuplicates([draw]).orderBy(rank, draw).drop(draw)


def crc_mod(column: str, modulus: int) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


# ---------------------------------------------------------------- numpy: words of byte blocks


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (multiply and xor-shift)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
        x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
        return x ^ (x >> U64(33))


_P = 0x5851F42D4C957F2D
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(base: int, name: str, n: int) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        out = np.full(size, U64(base), dtype=U64)
        out[0] = 1
        with np.errstate(over="ignore"):
            got = np.multiply.accumulate(out)
        if size <= 2 * BLOCK_BYTES:
            _powers[name] = got
    return got


def _byte_values(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    outside = np.zeros(256, dtype=bool)
    outside[list(separators)] = True
    values[outside] = 0
    return values, outside


_VALUES, _SPACE = _byte_values(SPACE_BYTES)


def word_hashes(data: np.ndarray, values: np.ndarray = _VALUES, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(start of each word, its 64-bit hash) of a byte array; A-Z count as a-z."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, U64)
    inside = ~outside[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.empty(0, U64)
    with np.errstate(over="ignore"):
        terms = values[data]
        terms *= _power_table(_P, "up", n)[:n]
        sums = np.add.reduceat(terms, starts)
        return starts, mix64(sums * _power_table(_P_INV, "down", n)[starts])


def text_blocks(texts: Iterable[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of up to ``limit`` bytes each (a longer text is a range of its own)."""
    begin, size, i = 0, 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if size:
        yield begin, i + 1


def hashed_words(texts: list[bytes], values: np.ndarray = _VALUES, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a few texts in order, and where each text's words begin (n + 1 offsets). Very long texts go in slices cut at white space."""
    if len(texts) == 1 and len(texts[0]) > 2 * BLOCK_BYTES:
        parts, at, text = [], 0, texts[0]
        while at < len(text):
            end = min(len(text), at + BLOCK_BYTES)
            while end < len(text) and not outside[text[end]]:
                end += 1
            parts.append(word_hashes(np.frombuffer(text, np.uint8, end - at, at), values, outside)[1])
            at = end
        hashes = np.concatenate(parts)
        return hashes, np.array([0, len(hashes)])
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, hashes = word_hashes(data, values, outside)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends)])


def utf8_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
