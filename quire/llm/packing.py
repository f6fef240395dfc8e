"""Packing token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, tidy

LENGTH = 2048
#: Windows of one differencing problem.
WINDOWS = 128
#: The id that ends each document.
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Texts of these characters are split alike by both tokenizer libraries, whatever their Unicode versions.
_OTHER = re.compile("[^\x00-ɏ‐-‧]").search


def encoder(path: str, pattern: str | None = None) -> Callable[[str], np.ndarray]:
    """text -> ids (uint32) of a ``tokenizers`` file; where a ``.tiktoken`` file of the same vocabulary lies beside it, texts of plain characters that hold no added token's string go through that, which is faster."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    added = [x.content for x in whole.get_added_tokens_decoder().values()]
    slow = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
    ranks_file = Path(path).with_suffix(".tiktoken")
    if pattern is None or not ranks_file.exists():
        return slow
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.read_bytes().splitlines())}
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: slow(text) if _OTHER(text) or any(x in text for x in added) else fast.encode_to_numpy(text, disallowed_special=())


_encoders: dict[tuple, Callable] = {}


def _encoder(path: str, pattern: str | None) -> Callable[[str], np.ndarray]:
    if (path, pattern) not in _encoders:
        _encoders.clear()
        _encoders[path, pattern] = encoder(path, pattern)
    return _encoders[path, pattern]


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """k-way Karmarkar-Karp: the two partial partitions of the largest imbalance are merged, largest sums onto smallest, until one is left.

    A partial partition lists only its non-empty windows as (sum, tree of items), largest first; returns the items of each window.
    """
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    nth = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = max(0, len(a) + len(b) - k)  # windows where a sum meets a sum
        at = len(a) - both
        met = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[at:], reversed(b[len(b) - both :]), strict=True)] if both else []
        merged = sorted(a[:at] + met + b[: len(b) - both], key=lambda x: -x[0])
        heapq.heappush(heap, (-(merged[0][0] - (merged[-1][0] if len(merged) == k else 0)), nth, merged))
        nth += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                items.append(x)
        out.append(items)
    return out


def windows(sizes: list[int], length: int = LENGTH) -> list[list[int]]:
    """Items in near-equal windows: as few as their sum needs, one more each time that differencing leaves a window over the length."""
    k = max(1, -(-sum(sizes) // length))
    while True:
        got = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= length for w in got):
            return got
        k += 1


def packed(sizes: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Pieces (which, start, size) of each window: as few windows as the sum needs, made near-equal by differencing of whole items; then what a window holds beyond the length is cut off and fills the gaps of others."""
    got = difference(sizes, max(1, -(-sum(sizes) // length)))
    out = [[(i, 0, sizes[i]) for i in w] for w in got]
    sums = [sum(n for _, _, n in w) for w in out]
    gaps = sorted((w for w in range(len(out)) if sums[w] < length), key=lambda w: sums[w])
    for w in [w for w in range(len(out)) if sums[w] > length]:
        while sums[w] > length:
            over = sums[w] - length
            # the shortest piece that covers the excess, or else the longest
            at = min(range(len(out[w])), key=lambda k: (out[w][k][2] < over, out[w][k][2] if out[w][k][2] >= over else -out[w][k][2]))
            i, start, n = out[w].pop(at)
            moved = min(over, n)
            if n > moved:
                out[w].append((i, start, n - moved))
            sums[w] -= moved
            start += n - moved
            while moved:
                to = gaps[-1]  # the smallest gap is closed first
                part = min(moved, length - sums[to])
                out[to].append((i, start, part))
                sums[to] += part
                start, moved = start + part, moved - part
                if sums[to] == length:
                    gaps.pop()
    return out


def pack(docs: DataFrame, tokenizer: str, pattern: str | None = None, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document's ids, then ``end_id``, are cut where needed: whole windows of a long document are sequences by themselves. Each task collects
    the rests, which are shorter than a window, into problems of ``WINDOWS`` full windows (the last rest is cut to fit) and solves them by differencing;
    what near-equal windows hold too much is cut off, so most documents lie in one sequence. Only a task's last problem has padding. Nothing is shuffled, a task holds one problem, and ids repeat if a task is run again. Null and empty texts are the
    end id alone; repeated rows are packed each; sequence_id is the input partition's number times 2^40 plus a count. No rows give
    no pieces.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    room = WINDOWS * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _encoder(tokenizer, pattern)
        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) << 40
        held: list[tuple] = []  # (doc_id, start, document's ids, bytes of the ids)
        size = 0
        out: list[tuple] = []

        def solve() -> None:
            nonlocal next_id, held, size
            for window in packed([len(x[3]) // 4 for x in held], length):
                offset = 0
                joined: list[list[int]] = []
                for i, at, n in sorted(window):  # neighbouring pieces of a document are one
                    if joined and joined[-1][0] == i and joined[-1][1] + joined[-1][2] == at:
                        joined[-1][2] += n
                    else:
                        joined.append([i, at, n])
                for i, at, n in joined:
                    doc, start, total, raw = held[i]
                    out.append((doc, start + at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), total, next_id, offset))
                    offset += n
                next_id += 1
            held, size = [], 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(t) if t else np.empty(0, np.uint32), np.uint32(end_id)).astype("<u4")
                total, at = len(ids), 0
                raw = memoryview(ids.tobytes())
                while total - at >= length:
                    out.append((doc, at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), total, next_id, 0))
                    next_id += 1
                    at += length
                while at < total:
                    n = min(total - at, room - size)
                    held.append((doc, at, total, bytes(raw[4 * at : 4 * (at + n)])))
                    at += n
                    size += n
                    if size == room:
                        solve()
                if len(out) > 50_000:
                    yield flush()
        if held:
            solve()
        if out:
            yield flush()

    return docs.mapInArrow(tidy(run), SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op3_packing": op3_packing}
