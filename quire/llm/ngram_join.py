"""N-gram Jaccard self-join: rare-first prefixes, length, positional and suffix filters, one verification per pair.

The global order of shingles is (number of texts that hold it, hash). One pass hashes the texts and deals their shingles out to slices of
the hash space, which number as many as the input calls for; a slice's task counts its shingles and sends back, to the chunk of
texts they came from, only those that another text has too. What a text shares with no other comes first in the order, so a text that has
enough of its own has no shared shingle in its prefix and is done; the rest is joined on prefix shingles. Only documents of candidate
pairs are read again, with their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, fold, hashed_words, join_groups, mix64, release, slots_of, small_batches, staged, text_blocks, tidy, unstage, utf8_texts
from .graph import components

WORDS = 5
#: Similarity as a fraction: documents link when DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: Bytes of text whose shingles one slice of the hash space gets on average, most slices (as a power of two), bytes and texts of a chunk.
SLICE_BYTES, SLICE_BITS, CHUNK_BYTES, CHUNK_TEXTS = 12 << 20, 24, 4 << 20, 1 << 16
#: Counts from here on are one rank of the order; entries of a slice that are held before such frequent shingles are sent on.
FREQUENT, HELD = 4095, 4 << 20
#: Parts of the hash space that the suffix filter compares; tables of up to so many nodes are broadcast.
BINS, BROADCAST_ROWS = 256, 200_000
#: Bits for each member of the filter over document ids, and its bounds as powers of two; a fuller filter lets more rows through to an exact join, never fewer.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 29
PARITIES = ("p0", "p1", "p2", "p3")
SET = ("sig", "sig2", "n")
NO_ID = -(1 << 63)
_COEFF = mix64(np.arange(101, 101 + WORDS, dtype=U64)) | U64(1)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words than a shingle has, the whole sequence is one; without words, none."""
    out: list[np.ndarray] = []
    for i, j in text_blocks(texts):
        hashes, at = hashed_words(texts[i:j])
        coeff = _COEFF if words == WORDS else mix64(np.arange(101, 101 + words, dtype=U64)) | U64(1)
        with np.errstate(over="ignore"):
            m = max(0, len(hashes) - words + 1)
            full = np.zeros(m, U64)
            for k in range(words):
                full += hashes[k : k + m] * coeff[k]
            full = mix64(full)
            for s, e in zip(at[:-1], at[1:], strict=True):
                if e - s >= words:
                    out.append(np.unique(full[s : e - words + 1]))
                elif e > s:
                    out.append(mix64(np.array([(hashes[s:e] * coeff[: e - s]).sum() + U64(e - s)], U64)))
                else:
                    out.append(np.empty(0, U64))
    out.extend(np.empty(0, U64) for _ in range(len(texts) - len(out)))
    return out


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a shingle set."""
    with np.errstate(over="ignore"):
        sums = np.array([mix64(s ^ U64(0x3C79AC492BA7B653)).sum(), mix64(s + U64(0x1C69B3F74AC4AE35)).sum()], U64) + U64(len(s))
    a, b = mix64(sums).view(np.int64).tolist()
    return a, b


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-n * num // den) + 1 if n else 0


def _parities(s: np.ndarray) -> list[int]:
    """Whether the number of members in each of 256 hash ranges is odd, as four longs."""
    c = np.bincount((s >> U64(56)).astype(np.int64), minlength=BINS)
    return np.packbits((c & 1).astype(bool)).view("<i8").tolist()


# ---------------------------------------------------------------- filter over document ids


def _places(values: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(values.astype(np.int64).view(U64)) >> U64(64 - bits)).astype(np.int64)


def id_filter(ids: DataFrame, members: int) -> np.ndarray:
    """A packed bit set over the long column of ``ids``, sized by the number of its members."""
    bits = min(MOST_BITS, max(LEAST_BITS, (members * BITS_EACH).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            at = np.unique(_places(b.column(0).to_numpy(zero_copy_only=False), bits))
            if len(at):
                first = np.flatnonzero(np.diff(at >> 3, prepend=-1))
                got[at[first] >> 3] |= np.bitwise_or.reduceat((128 >> (at & 7)).astype(np.uint8), first)
        yield slots_of(got)

    got = fold(ids.mapInArrow(tidy(mark), "slot int, blob binary"), "u1", "or")
    return got if len(got) == (1 << bits) // 8 else np.zeros((1 << bits) // 8, np.uint8)


def _passes(filled: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = _places(values, len(filled).bit_length() + 2)
    return (filled[at >> 3] & (128 >> (at & 7)).astype(np.uint8)) > 0


# ---------------------------------------------------------------- passes over the texts

#: A row is a text (idx not null) or a blob of shingles of a chunk that fall into a slice.
_ROWS = {"slice": "int", "chunk": "long", "idx": "int", "doc_id": "long", "n": "long", "sig": "long", "sig2": "long", "p0": "long", "p1": "long", "p2": "long", "p3": "long", "blob": "binary"}
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMA = ", ".join(f"{k} {v}" for k, v in _ROWS.items())


def _batch(size: int, /, **columns: list | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], _TYPES[v]) if k in columns else pa.nulls(size, _TYPES[v]) for k, v in _ROWS.items()], list(_ROWS))


def _planes(x: np.ndarray) -> bytes:
    """An array's bytes, the highest of all numbers first: sorted numbers compress well that way."""
    return np.ascontiguousarray(x.astype(x.dtype.newbyteorder(">")).view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def _unplanes(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds)
    n, at, out = len(blob) // width, 0, []
    for k in map(np.dtype, kinds):
        part = np.frombuffer(blob, np.uint8, n * k.itemsize, at).reshape(k.itemsize, n)
        out.append(np.ascontiguousarray(part.T).view(k.newbyteorder(">")).reshape(-1).astype(k))
        at += n * k.itemsize
    return out


def scan(docs: DataFrame, bits: int) -> DataFrame:
    """Rows (_ROWS) of each text of (doc_id, text), and the shingles of each chunk of texts in 2^bits slices: 32 bits of each, and the number of its text. Equal sets within a chunk send their shingles once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        chunk = (context.partitionId() if context else 0) << 22
        sets: list[np.ndarray] = []
        owner: list[int] = []
        seen: set[tuple[int, int]] = set()
        rows: list[tuple] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, size
            if rows:
                cols = list(zip(*rows, strict=True))
                yield _batch(len(rows), slice=-1 - np.arange(len(rows)) % (1 << bits), chunk=np.full(len(rows), chunk), **dict(zip(list(_ROWS)[2:-1], cols, strict=True)))
            if sets:
                h = np.concatenate(sets)
                idx = np.repeat(np.array(owner, np.uint16), [len(s) for s in sets])
                order = np.argsort(h)
                h, idx = h[order], idx[order]
                part = (h >> U64(64 - bits)).astype(np.int64)
                key = (h >> U64(32 - bits)).astype(np.uint32)
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                ends = np.append(cuts[1:], len(h))
                for lo in range(0, len(cuts), 256):
                    blobs = [_planes(key[a:b]) + _planes(idx[a:b]) for a, b in zip(cuts[lo : lo + 256], ends[lo : lo + 256], strict=True)]
                    yield _batch(len(blobs), slice=part[cuts[lo : lo + 256]], chunk=np.full(len(blobs), chunk), blob=blobs)
            chunk += 1
            size = 0
            for x in (sets, owner, rows):
                x.clear()
            seen.clear()

        for b in batches:
            ids, texts = b.column(0).to_pylist(), utf8_texts(b.column(1))
            for i, j in text_blocks(texts):
                for k, s in enumerate(shingle_sets(texts[i:j]), i):
                    sig = set_digest(s)
                    rows.append((len(rows), ids[k], len(s), *sig, *_parities(s)))
                    if len(s) and sig not in seen:
                        seen.add(sig)
                        sets.append(s)
                        owner.append(len(rows) - 1)
                    size += len(texts[k])
                    if size >= CHUNK_BYTES or len(rows) == CHUNK_TEXTS:
                        yield from close()
        yield from close()

    return docs.mapInArrow(tidy(run), _SCHEMA)


def shared(scanned: DataFrame, bits: int) -> DataFrame:
    """The rows of texts, and for each chunk and slice a blob of the shingles that occur more than once: (number of the text, 32 bits, count up to FREQUENT).

    A task streams its slices. Shingles that were met FREQUENT times are sent on as soon as many entries are held, so a shingle of any
    number of texts takes bounded memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, limit = None, 0, HELD
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        often = np.empty(0, np.uint32)

        def send(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            rows = [r for r in rows if len(r[1])]
            if rows:
                blobs = [_planes(idx) + _planes(key) + _planes(count) for _, key, idx, count in rows]
                yield _batch(len(rows), slice=np.full(len(rows), now), chunk=[r[0] for r in rows], blob=blobs)

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, often
            if not held:
                return
            key = np.concatenate([k for _, k, _ in held])
            distinct, of, count = np.unique(key, return_inverse=True, return_counts=True)
            count = np.minimum(count, FREQUENT).astype(np.uint16)
            many = count == FREQUENT
            goes = (count > 1) if last else many
            often = np.union1d(often, distinct[many])
            out, left, at = [], [], 0
            for chunk, k, idx in held:
                c = of[at : at + len(k)]
                at += len(k)
                some = goes[c]
                out.append((chunk, k[some], idx[some], count[c[some]]))
                if not last and not some.all():
                    left.append((chunk, k[~some], idx[~some]))
            yield from send(out)
            held, size = left, sum(len(k) for _, k, _ in left)

        for b in batches:
            texts = b.filter(b.column(2).is_valid())
            if texts.num_rows:
                yield texts
            blobs = b.filter(b.column(2).is_null())
            for part, chunk, blob in zip(blobs.column(0).to_pylist(), blobs.column(1).to_pylist(), blobs.column(11).to_pylist(), strict=True):
                if part != now:
                    yield from settle(True)
                    now, held, size, often, limit = part, [], 0, np.empty(0, np.uint32), HELD
                key, idx = _unplanes(blob, (np.uint32, np.uint16))
                if len(often):
                    known = np.isin(key, often)
                    yield from send([(chunk, key[known], idx[known], np.full(int(known.sum()), FREQUENT, np.uint16))])
                    key, idx = key[~known], idx[~known]
                held.append((chunk, key, idx))
                size += len(key)
                if size > limit:
                    yield from settle(False)
                    limit = max(HELD, 2 * size)
        yield from settle(True)

    n = 1 << bits
    return scanned.repartition(n, "slice").sortWithinPartitions("slice").mapInArrow(tidy(run), _SCHEMA)


def prefixes(rows: DataFrame, bits: int) -> DataFrame:
    """Prefix postings (h, node, n, pos, nth, score, prev) of texts from rows (chunk, idx, n) and blobs (chunk, slice, blob).

    A text's own shingles come first in its order, then shared ones by (count, hash); nth counts the shared ones before: own ones can't
    agree. prev is the shared one before. The score is the mean of log counts over all its shingles: among near copies it is highest for the text
    that the others were made from. Of shingles whose kept bits are equal, the first place and the highest nth count, so bounds hold.
    """
    names, kinds = ("h", "node", "n", "pos", "nth", "score", "prev"), (np.int64, np.int64, np.int32, np.int32, np.int32, np.float32, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sizes = None, np.zeros(CHUNK_TEXTS, np.int64)
        parts: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            idx, h, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            if not len(idx):
                return
            order = np.lexsort((h, count, idx))
            idx, h, count = idx[order], h[order], count[order].astype(np.int64)
            first = np.flatnonzero(np.diff(idx.astype(np.int64), prepend=-1))
            per = np.diff(np.append(first, len(idx)))
            n = sizes[idx[first]]
            score = np.add.reduceat(np.log(count), first) / np.maximum(n, 1)
            own = n - per
            length = n - -(-n * NUM // DEN) + 1
            rank = np.arange(len(idx)) - np.repeat(first, per)
            fresh = np.append(True, (h[1:] != h[:-1]) | (idx[1:] != idx[:-1]))
            at = np.flatnonzero(fresh)
            last = np.append(at[1:], len(idx)) - 1  # of equal ones
            of = np.repeat(np.arange(len(first)), per)[at]
            prev = np.append(0, h[at[:-1]])
            prev[rank[at] == 0] = 0
            keep = rank[at] < (length - own)[of]
            at, last, of, prev = at[keep], last[keep], of[keep], prev[keep]
            for lo in range(0, len(at), 100_000):
                a, z, o = at[lo : lo + 100_000], last[lo : lo + 100_000], of[lo : lo + 100_000]
                cols = (h[a], (np.int64(now) << 16) + idx[a].astype(np.int64), n[o], own[o] + rank[a], rank[z], score[o], prev[lo : lo + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(k)) for c, k in zip(cols, kinds, strict=True)], list(names))

        for b in batches:
            for chunk, part, idx, n, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk != now:
                    yield from close()
                    now = chunk
                    sizes[:] = 0
                if idx is not None:
                    sizes[idx] = n
                    continue
                i, key, count = _unplanes(blob, (np.uint16, np.uint32, np.uint16))
                mine = sizes[i] > 0
                parts.append((i[mine], (np.int64(part) << 32) + key[mine].astype(np.int64), count[mine]))
        yield from close()

    dealt = rows.repartition(1 << bits, "chunk").sortWithinPartitions("chunk", F.col("idx").asc_nulls_last()).select("chunk", "slice", "idx", "n", "blob")
    return dealt.mapInArrow(tidy(run), "h long, node long, n int, pos int, nth int, score float, prev long")


def set_pass(docs: DataFrame, filled) -> DataFrame:
    """(sig, sig2, n, shingles) of the documents whose id passes the filter; a task sends one of many like sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for b in batches:
            ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            texts = utf8_texts(b.column(1).filter(pa.array(_passes(filled.value, ids))))
            for i, j in text_blocks(texts):
                sets = [(set_digest(s), s) for s in shingle_sets(texts[i:j])]
                sets = [x for k, x in enumerate(sets) if x[0] not in done and all(x[0] != y[0] for y in sets[max(0, k - 8) : k])]
                if len(done) > 1 << 14:
                    done.clear()
                done.update(x for x, _ in sets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x, _ in sets], pa.int64()), pa.array([x[1] for x, _ in sets], pa.int64()), pa.array([len(s) for _, s in sets], pa.int64()), pa.array([s.view(np.int64) for _, s in sets], pa.list_(pa.int64()))],
                    [*SET, "shingles"],
                )

    return docs.mapInArrow(tidy(run), "sig long, sig2 long, n long, shingles array<long>")


# ---------------------------------------------------------------- filters and verification


def least_overlap(na: Column, nb: Column, num: int = NUM, den: int = DEN) -> Column:
    """The smallest intersection of linked sets: ceil(num * (na + nb) / (num + den))."""
    return F.floor(((na + nb) * num + (num + den - 1)) / (num + den)).cast("long")


def may_link(a: str, b: str) -> Column:
    """Length and positional filters on two postings of one shingle: before it at most min(nth) shingles agree, after it at most the shorter rest."""
    c = lambda s, x: F.col(f"{s}.{x}").cast("long")
    na, nb = c(a, "n"), c(b, "n")
    length = F.least(na, nb) * DEN >= F.greatest(na, nb) * NUM
    return length & (1 + F.least(na - c(a, "pos") - 1, nb - c(b, "pos") - 1) + F.least(c(a, "nth"), c(b, "nth")) >= least_overlap(na, nb))


def parts_agree(a: str, b: str) -> Column:
    """Suffix filter: over a fixed partition of the hash space, each part with an odd and an even count holds at least one shingle of the symmetric difference, and linked sets differ little."""
    c = lambda s, x: F.col(f"{s}.{x}")
    na, nb = c(a, "n").cast("long"), c(b, "n").cast("long")
    differ = sum((F.bit_count(c(a, p).bitwiseXOR(c(b, p))) for p in PARITIES[1:]), F.bit_count(c(a, "p0").bitwiseXOR(c(b, "p0"))))
    return differ <= na + nb - 2 * least_overlap(na, nb)


def suffix_filter(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that pass the suffix filter."""
    info = classes.select("node", "n", *PARITIES)
    both = pairs.join(info.alias("x"), F.col("a") == F.col("x.node")).join(info.alias("y"), F.col("b") == F.col("y.node"))
    return both.where(parts_agree("x", "y")).select("a", "b")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link, by their exact intersections."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("i"))
    return both.where(DEN * F.col("i") >= NUM * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b").distinct()


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's (doc_id, n_shingles, component_id, class_id): class_id is the least id of equal shingle sets, component_id of all reachable by links.

    Null and empty texts, and those of white space alone, have no shingles and stay alone. Equal sets (by 128 bits and size) are one node of
    the graph, so copies are never paired. At each shared prefix shingle every text meets first the text with the highest centre score; texts still in
    different components then meet each other, except those that a filter rules out. So no link between components is lost, and a
    group of near copies costs about one verification per member instead of one per pair. Rows with a null id are returned with
    component_id null where nothing else is in it. An empty table gives no rows. Texts are read from their source up to four times: it must
    give the same rows each time, as files and staged tables do.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    bits = min(SLICE_BITS, max(2, ((size or 0) // SLICE_BYTES).bit_length()))
    found = staged(shared(scan(docs, bits), bits), "shared")
    release(spark)
    texts = found.where("idx is not null").withColumn("node", F.shiftleft("chunk", 16) + F.col("idx"))
    some = texts.where("n > 0").groupBy(*SET).agg(F.min("node").alias("node"), F.min("doc_id").alias("class_id"), F.count("*").alias("rows"), *[F.min(p).alias(p) for p in PARITIES])
    classes = staged(some, "classes")
    first = classes.select(F.shiftright("node", 16).alias("chunk"), F.lit(None).cast("int").alias("slice"), F.expr("cast(node & 65535 as int)").alias("idx"), "n", F.lit(None).cast("binary").alias("blob"))
    posts = prefixes(first.unionByName(found.where("idx is null").select("chunk", "slice", "idx", "n", "blob")), bits)
    posts = staged(posts, "posts")
    release(spark)

    def links_of(pairs: DataFrame) -> DataFrame:
        """The candidate pairs that link; only documents that pass all filters are shuffled with their sets."""
        pairs = staged(suffix_filter(pairs, classes), "pairs")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        some = staged(classes.join(ends, "node", "left_semi").select("node", "class_id", *SET), "nodes")
        n = some.count()
        if not n:
            return pairs
        filled = sc.broadcast(id_filter(some.select(F.coalesce("class_id", F.lit(NO_ID).cast("long"))), n))
        known = some.select("node", *SET)
        sets = set_pass(docs, filled).join(F.broadcast(known) if n <= BROADCAST_ROWS else known.hint("merge"), [*SET]).select("node", "shingles")
        sets = staged(sets, "sets")
        found = staged(verify(pairs, sets), "links")
        unstage(sets, some, pairs)
        release(spark)
        return found

    pivot = staged(posts.groupBy("h").agg(F.max(F.struct("score", "node", "n", "pos", "nth")).alias("p"), F.count("*").alias("k")).where("k > 1").select("h", "k", "p.*"), "pivot")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")
    both = posts.alias("x").join(small(pivot).alias("p"), "h").withColumn("pair", (F.col("x.node") != F.col("p.node")) & may_link("x", "p"))
    # a shingle of two texts is decided by the star alone
    met = staged(both.where("pair or k > 2").select("h", "k", *[f"x.{c}" for c in ("node", "n", "pos", "nth", "prev")], F.when(F.col("pair"), F.col("p.node")).alias("center")), "met")
    star = met.where("center is not null").select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()
    star = staged(star, "star")
    unstage(posts, pivot)
    links = links_of(star)
    comps = staged(components(links), "comps")

    named = met.where("k > 2").drop("k", "center").join(small(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = staged(named.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h"), "mixed")
    left = named.join(small(mixed), "h", "left_semi").join(classes.select("node", *PARITIES), "node")
    left = staged(left.select("h", "node", "comp", "n", "pos", "nth", "prev", *PARITIES), "left")
    x, y = left.alias("x"), left.alias("y")
    # texts that share the kept shingle before have met there, and what ruled them out there rules them out here
    again = (F.col("x.nth") > 0) & (F.col("y.nth") > 0) & (F.col("x.prev") == F.col("y.prev"))
    fits = ~again & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & may_link("x", "y") & parts_agree("x", "y")
    rest = x.join(y, (F.col("x.h") == F.col("y.h")) & fits)
    more = links_of(rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(star, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        comps = staged(components(links.union(more)), "comps")

    named = classes.select(*SET, "rows", "node", "class_id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = staged(named, "named")
    roots = staged(named.groupBy("comp").agg(F.min("class_id").alias("component_id"), F.count("*").alias("members")), "roots")
    groups = staged(join_groups(named, roots, ["comp"], "members", rows).select(*SET, "rows", "class_id", "component_id"), "groups")
    unstage(met, left, mixed, classes, star, named, roots)
    out = join_groups(texts.where("n > 0").select("doc_id", *SET), groups, list(SET), "rows", rows)
    alone = texts.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return out.select("doc_id", "n", "component_id", "class_id").unionByName(alone).withColumnRenamed("n", "n_shingles")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = {
    "op5_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN unnest(list_transform(generate_series(1, greatest(1, len(ws) - 4)), lambda i: array_to_string(ws[i:i + 4], ' ')))
         ELSE array_to_string(ws, ' ') END AS s FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
k AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id),
q AS (SELECT doc_id, list(s ORDER BY s) AS ss FROM g GROUP BY doc_id),
t AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY ss) AS class_id FROM q)
SELECT k.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id, coalesce(t.class_id, k.doc_id) AS class_id
FROM k LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
QUERIES = {"op5_ngram_join": op5_ngram_join}
