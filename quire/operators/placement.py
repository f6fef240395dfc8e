"""Finding where a text stands in another: streams placed in OCR, openings on leaves, paragraphs in their source's order."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.sources.shared import small_batches, staged

#: A stream's chunk, a gram that occurs more often is no evidence, votes are summed so far around an offset and must be so many, the window
#: is so much wider on both sides, and unplaced runs of so many tokens are tried again.
CHUNK, MOST_HITS, SMOOTH, LEAST_VOTES, MARGIN, LEAST_RUN = 40, 8, 3, 2, 15, 8
#: The opening's long words that are looked for, the length of a long word, and the percentages that flag a leaf.
START_WORDS, LONG, START_MIN, START_GAP = 30, 5, 45, 15


# ---------------------------------------------------------------- streams in OCR


def _blocks(seg: list[int], window: list[int]) -> list[tuple[int, int, int]]:
    """Matching blocks (a, b, size) in order, as SequenceMatcher has them without junk: the longest run of equal words, the first of those, then the same on both its sides."""
    where, runs, open_at = {}, [], {}
    for j, w in enumerate(window):
        where.setdefault(w, []).append(j)
    for i, w in enumerate(seg):
        at = {}
        for j in where.get(w, ()):
            run = open_at.get(j - 1)
            if run is None:
                runs.append(run := [i, j, 0])
            run[2] += 1
            at[j] = run
        open_at = at
    out, todo = [], [(0, len(seg), 0, len(window), runs)] if runs else []
    while todo:
        a, a_end, b, b_end, within = todo.pop()
        size = 0
        for i, j, n in within:
            # the part of the run inside these bounds
            x, y, n = i, j, i + n
            if x < a:
                x, y = a, y + a - x
            if y < b:
                x, y = x + b - y, b
            n = (n if n < a_end else a_end) - x
            if n > b_end - y:
                n = b_end - y
            if n > size or (n == size and n > 0 and (x < at_a or (x == at_a and y < at_b))):
                at_a, at_b, size = x, y, n
        if size > 0:
            out.append((at_a, at_b, size))
            if len(within) > 1:
                end_a, end_b = at_a + size, at_b + size
                if before := [r for r in within if r[0] < at_a and r[1] < at_b]:
                    todo.append((a, at_a, b, at_b, before))
                if after := [r for r in within if r[0] + r[2] > end_a and r[1] + r[2] > end_b]:
                    todo.append((end_a, a_end, end_b, b_end, after))
    return sorted(out)


def _place(stream: list[int], ocr: list[int], chunk: int) -> tuple[list[int], list[int]]:
    """(pos, ocr_pos) of one page's words, given by number."""
    three = lambda x: zip(x, x[1:], x[2:])
    grams = {g: [] for g in three(stream)}
    for k, g in enumerate(three(ocr)):
        if g in grams:
            grams[g].append(k)
    hits = [at if len(at := grams[g]) <= MOST_HITS else () for g in three(stream)]
    todo = [(lo, min(lo + chunk, len(stream))) for lo in range(0, len(stream), chunk)]
    pos, ocr_pos = [], []
    while todo:
        lo, hi = todo.pop()
        votes: dict[int, int] = defaultdict(int)
        for k in range(lo, hi - 2 if hi - lo >= 4 else lo):
            for p in hits[k]:
                votes[p - k] += 1
        # of offsets with as many votes the least
        n, off = max(((sum(votes.get(o + d, 0) for d in range(-SMOOTH, SMOOTH + 1)), -o) for o in votes), default=(0, 0))
        if n < LEAST_VOTES:
            continue
        start = lo - off
        at, last = max(start - MARGIN, 0), lo
        for i, j, size in [*_blocks(stream[lo:hi], ocr[at : start + hi - lo + MARGIN]), (hi - lo, 0, 0)]:
            # what lies before a match, or before the segment's end, is tried again
            if LEAST_RUN <= lo + i - last < hi - lo:
                todo.append((last, lo + i))
            last = lo + i + size
            pos += range(lo + i, last)
            ocr_pos += range(at + j, at + j + size)
    return pos, ocr_pos


def place_words(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``place_stream`` of pages (key, stream, ocr) whose words stand in two arrays of one row: nothing is shuffled or staged. Words become numbers batch by batch; null words equal nothing. [J9]"""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [b.column(1), b.column(2)]
            ids = pa.concat_arrays([x.flatten() for x in sides]).dictionary_encode().indices
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy().astype("int64")
            ids[nulls] = -1 - np.arange(nulls.sum())
            sizes = [x.value_lengths().to_numpy() for x in sides]
            ends = [np.cumsum(sizes[0]), sizes[0].sum() + np.cumsum(sizes[1])]
            found = [_place(*(ids[e[k] - n[k] : e[k]].tolist() for e, n in zip(ends, sizes, strict=True)), chunk) for k in range(b.num_rows)]
            keys = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), [len(x[0]) for x in found])))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array([i for x in found for i in x[side]], pa.int32()) for side in (0, 1))], ["key", "pos", "ocr_pos"])

    kind = pages.schema["key"].dataType.simpleString()
    rows = pages.where("key is not null and size(stream) > 0 and size(ocr) > 0").select("key", "stream", "ocr")
    return rows.mapInArrow(run, f"key {kind}, pos int, ocr_pos int")


def place_stream(stream: DataFrame, ocr: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, pos, ocr_pos): for tokens of a stream (key, pos, w; pos from 0 without gaps) the OCR token (key, pos, w) that each equals, where one is found. [J9]

    OCR reads a page in its own order of blocks, so each chunk of the stream is placed by itself: its trigrams vote on an offset, and the words
    there, with a margin, are aligned with it. Runs that stay unplaced, shorter than their segment, are placed in the same way, until none is left. A
    page's words are brought together once; its segments are then placed in one pass.
    """
    row = lambda df, name: df.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "w")))["w"].alias(name))
    return place_words(row(stream, "stream").join(row(ocr, "ocr"), "key"), chunk)


# ---------------------------------------------------------------- openings on leaves


def near_words(a: str, b: str) -> F.Column:
    """Whether two words are spelled nearly the same: the same initial, lengths at most one apart, one edit (two from nine letters of the first on)."""
    x, y = F.col(a), F.col(b)
    most = F.when(F.length(x) < 9, 1).otherwise(2)
    return (x == y) | ((F.abs(F.length(x) - F.length(y)) <= 1) & (F.substring(x, 1, 1) == F.substring(y, 1, 1)) & (F.levenshtein(x, y) <= most))


def _scores(asked: DataFrame, leaves: DataFrame) -> DataFrame:
    """(section, leaf, score) of openings (section, leaf, x: their words as structs of i and w)."""
    first = lambda c: F.substring(c, 1, 1)
    # one edit leaves the first or the second half of a word as it is
    half = lambda w, side: F.when(F.length(w) < 9, side(w, F.floor(F.length(w) / 2).cast("int"))).otherwise("")
    probe = lambda x: F.struct(x["i"].alias("i"), x["w"].alias("a"), half(x["w"], F.left).alias("head"), half(x["w"], F.right).alias("tail"))
    some = lambda x: F.filter(x, lambda y: y["w"] != "")
    by_initial = lambda x: F.map_from_entries(F.transform(F.array_distinct(F.transform(x, lambda y: first(y["w"]))), lambda k: F.struct(k, F.transform(F.filter(x, lambda y: first(y["w"]) == k), probe))))
    asked = asked.select("section", "leaf", F.size("x").cast("long").alias("n"), some("x").alias("x")).withColumns({"least": F.array_min(F.transform("x", lambda y: F.length(y["w"]))), "own": by_initial(F.col("x"))})
    if "words" in leaves.columns:
        leaves, each = leaves.select("leaf", "words"), F.posexplode_outer("words").alias("pos", "b")
    else:
        leaves, each = leaves.groupBy("leaf").agg(F.collect_list(F.struct("pos", F.col("w").alias("b"))).alias("words")), F.inline_outer("words").alias("pos", "b")
    met = asked.join(leaves, "leaf").select("section", "leaf", "n", "least", "own", each).where("length(b) >= least - 1")
    hits = met.select("section", "leaf", "n", "pos", "b", F.explode_outer(F.try_element_at("own", first("b"))).alias("x"))
    hits = hits.select("section", "leaf", "n", F.col("pos").cast("long").alias("pos"), "x.*", "b").where((F.startswith("b", "head") | F.endswith("b", "tail")) & near_words("a", "b"))
    before = F.coalesce(F.lag("pos").over(W.partitionBy("section", "leaf", "i").orderBy("pos")), F.lit(-1))
    spans = hits.select("section", "leaf", "pos", (F.greatest(before, F.col("pos") - 3 * F.col("n")) + 1).alias("s")).where("s <= pos")
    ends = spans.select("section", "leaf", F.inline(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct((F.col("pos") + 1).alias("at"), F.lit(-1).alias("d")))))
    best = ends.withColumn("c", F.sum("d").over(W.partitionBy("section", "leaf").orderBy("at"))).groupBy("section", "leaf").agg(F.max("c").alias("c"))
    out = asked.select("section", "leaf", "n").join(best, ["section", "leaf"], "left")
    return out.select("section", "leaf", (100.0 * F.coalesce("c", F.lit(0)) / F.col("n")).alias("score"))


def start_scores(probes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(section, leaf, score): the percentage of a section's opening words (section, leaf, i, w) that one stretch of a leaf (leaf, pos, w; or leaf, words) holds, nearly spelled; a stretch is three times as long as the opening. [J20]

    An opening meets its leaf in one row, and only words with the same initial are compared. A hit counts for the stretches that start after the word's hit
    before and reach it; most of these meet at one of their ends, which is a hit, so a running sum over starts and ends finds the best.
    """
    return _scores(probes.groupBy("section", "leaf").agg(F.collect_list(F.struct("i", "w")).alias("x")), leaves)


def start_findings(openings: DataFrame, leaves: DataFrame, least: float = START_MIN, gap: float = START_GAP) -> DataFrame:
    """(section, leaf, score, next_score) of sections whose opening isn't on the first leaf they are filed on: under ``least``, or the next leaf is better by more than ``gap``. [J20]

    ``openings`` (section, leaf, next_leaf, i, w) hold the first long words of a section, title included; ``leaves`` are (leaf, pos, w). Both may have
    an array ``words`` instead, with a row for each section and leaf, which spares a shuffle of words. Openings and scores are staged, as both leaves of a section ask for them.
    """
    if "words" in openings.columns:
        openings = openings.select("section", "leaf", "next_leaf", F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))).alias("x"))
    else:
        openings = openings.groupBy("section", "leaf", "next_leaf").agg(F.collect_set(F.struct("i", "w")).alias("x"))
    openings = staged(openings, "openings").where("size(x) > 0")
    sides = openings.select("section", F.explode(F.array("leaf", "next_leaf")).alias("leaf"), "x").where("leaf is not null")
    sides = sides.groupBy("section", "leaf").agg(F.collect_list("x").alias("x"))
    sides = sides.withColumn("x", F.when(F.size("x") == 1, F.col("x")[0]).otherwise(F.array_distinct(F.flatten("x"))))
    scores = staged(_scores(sides, leaves), "scores")
    filed = openings.select("section", "leaf", "next_leaf").distinct()
    met = filed.join(scores, ["section", "leaf"]).join(scores.select("section", F.col("leaf").alias("next_leaf"), F.col("score").alias("next_score")), ["section", "next_leaf"], "left")
    return met.where((F.col("score") < least) | (F.col("next_score") > F.col("score") + gap)).select("section", "leaf", "score", "next_score")


def long_words(words: F.Column, most: int = START_WORDS, long: int = LONG) -> F.Column:
    """The first ``most`` words of ``long`` letters or more of an array column."""
    return F.slice(F.filter(words, lambda w: F.length(w) >= long), 1, most)


def opening_words(sections: DataFrame, words: F.Column, most: int = START_WORDS, long: int = LONG) -> DataFrame:
    """The sections with (i, w): their ``long_words``, a row each."""
    return sections.select("*", F.posexplode(long_words(words, most, long)).alias("i", "w"))


# ---------------------------------------------------------------- order in a source

HEAD, ALIKE, LEAST_WORDS, EXACT = 12, 0.75, 4, 8


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = [SequenceMatcher(None, list(s), list(h), autojunk=False).ratio() >= ALIKE for s, h in zip(b["theirs"], b["ours"], strict=True)]
        yield b.loc[keep, ["work", "o", "j"]]


def _walk(blocks: Iterable[tuple], hits: dict[str, list[int]], restart: bool) -> list[tuple]:
    """(i, j, kind, gap_from): where each block (i, text, g) of one work goes: to its first candidate of ``hits`` behind the cursor that is free, else the first free one, else the first."""
    found = {g: (sorted(js), list(range(len(js) + 1))) for g, js in hits.items()}
    out, used, cursor, text = [], set(), -1, None

    def free(js: list[int], then: list[int], k: int) -> int | None:
        """The first free candidate from the k-th on; those passed are skipped the next time."""
        passed = []
        while k < len(js) and (then[k] != k or js[k] in used):
            passed.append(k)
            k = then[k] if then[k] != k else k + 1
        for x in passed:
            then[x] = k
        return js[k] if k < len(js) else None

    for i, own, g in blocks:
        if restart and own != text:
            cursor, text = -1, own
        if g not in found:
            out.append((i, None, "absent", None))
            continue
        js, then = found[g]
        j = free(js, then, bisect_right(js, cursor))
        j = free(js, then, 0) if j is None else j
        j = js[0] if j is None else j
        if j in used:
            out.append((i, j, "repeat", None))
        elif j < cursor:
            out.append((i, j, "order", None))
        else:
            out.append((i, j, None, cursor + 1 if cursor >= 0 else None))
            cursor = j
        used.add(j)
    return out


def _walks(restart: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                hits = defaultdict(list)
                for g, j in zip(r.hit, r.at, strict=True) if r.hit is not None else ():
                    hits[g].append(int(j))
                out += [(r.work, *x) for x in _walk(zip(map(int, r.i), r.text, r.g, strict=True), hits, restart)]
            yield pd.DataFrame(out, columns=["work", "i", "j", "kind", "gap_from"]).astype({"i": "Int32", "j": "Int32", "gap_from": "Int32"})

    return run


def order_in_source(blocks: DataFrame, flow: DataFrame, each_text: bool = False) -> DataFrame:
    """(work, i, j, kind): blocks (work, text, i, words) that are absent from their source's paragraphs (work, j, words, line), repeat one, or stand out of order, and paragraphs missing between matched blocks (i is null). [J21]

    A block of four words or more goes to paragraphs with its first eight words; without any, to those whose first twelve are alike by 0.75 or more (twice the
    matching words in order, over all words). Candidates share one of their rarest words: of heads alike by so much a block's ceil(0.4 n) + 1 rarest words can't
    all be missing, so no pair is lost and no other is tried; of those, pairs with too few common words aren't aligned, and equal beginnings are compared once. Only numbers go through a work's cursor. With ``each_text`` every text starts its own cursor, and nothing
    between is missing. Paragraphs of up to two words in capitals, and those that are a whole block or a title given as one, may be left out.
    """
    head, key = F.slice("words", 1, HEAD), F.array_join(F.slice("words", 1, EXACT), " ").alias("key")
    label = (F.size("words") <= 2) & (F.trim("line") == F.upper(F.trim("line")))
    theirs = staged(flow.select("work", F.col("j").cast("int").alias("j"), head.alias("theirs"), key, F.array_join("words", " ").alias("whole"), (label | (F.size("words") == 0)).alias("label")), "flow")
    ours = blocks.where(F.size("words") >= LEAST_WORDS).select("work", "text", F.col("i").cast("int").alias("i"), head.alias("ours"), key)
    ours = staged(ours.join(theirs.select("work", "key").distinct().withColumn("known", F.lit(True)), ["work", "key"], "left"), "blocks")
    # beginnings that occur more than once are compared once: o and j are the first that have them
    heads = ours.where("known is null").groupBy("work", "ours").agg(F.min(F.concat_ws(":", F.col("text").cast("string"), F.col("i").cast("string"))).alias("o"), F.collect_list(F.struct("i", "text")).alias("all"))
    heads, firsts = staged(heads, "heads"), staged(theirs.groupBy("work", "theirs").agg(F.min("j").alias("j"), F.collect_list("j").alias("all")), "firsts")
    sought = firsts.select("work", "j", F.explode(F.array_distinct("theirs")).alias("w"))
    counts = sought.groupBy("work", "w").agg(F.count("*").alias("c"))
    asked = heads.select("work", "o", F.size("ours").alias("m"), F.explode(F.array_distinct("ours")).alias("w")).join(counts, ["work", "w"], "left").fillna(0, ["c"])
    nth = F.row_number().over(W.partitionBy("work", "o").orderBy("c", "w"))
    rare = asked.withColumn("r", nth).where(F.col("r") <= F.ceil(F.col("m") * 0.4) + 1).select("work", "o", "w")
    met = rare.join(sought, ["work", "w"]).select("work", "o", "j").distinct()
    pairs = met.join(heads.drop("all"), ["work", "o"]).join(firsts.drop("all"), ["work", "j"])
    # words in order are no more than words that the other has too: 2 M / T >= 0.75 asks for 8 M >= 3 T
    shared = lambda x, y: F.size(F.filter(x, lambda w: F.array_contains(y, w)))
    pairs = pairs.where(8 * F.least(shared("ours", F.col("theirs")), shared("theirs", F.col("ours"))) >= 3 * (F.size("ours") + F.size("theirs")))
    kind = ours.schema["work"].dataType.simpleString()
    alike = pairs.mapInPandas(_alike, f"work {kind}, o string, j int")
    every = firsts.select("work", F.col("j").alias("first"), F.explode("all").alias("j"))
    exact = theirs.join(ours.where("known").select("work", "key").distinct(), ["work", "key"]).select("work", F.concat(F.lit("="), "key").alias("g"), "j")
    hits = exact.unionByName(alike.select("work", F.concat(F.lit("~"), "o").alias("g"), F.col("j").alias("first")).join(every, ["work", "first"]).drop("first"))
    rows = ours.where("known").select("work", F.struct("i", "text", F.concat(F.lit("="), "key").alias("g")).alias("x"))
    rest = heads.select("work", "o", F.explode("all").alias("x")).select("work", F.struct("x.i", "x.text", F.concat(F.lit("~"), "o").alias("g")).alias("x"))
    rows = rows.unionByName(rest)
    # a work's numbers in one row each side: works are walked batch by batch, as most are short
    rows = rows.groupBy("work").agg(F.sort_array(F.collect_list("x")).alias("x")).select("work", "x.i", "x.text", "x.g")
    hits = hits.groupBy("work").agg(F.collect_list(F.struct("g", "j")).alias("h")).select("work", F.col("h.g").alias("hit"), F.col("h.j").alias("at"))
    small_batches(blocks.sparkSession)
    walked = staged(rows.join(hits, "work", "left").mapInPandas(_walks(each_text), f"work {kind}, i int, j int, kind string, gap_from int"), "walked")
    found = walked.where("kind is not null").select("work", "i", "j", "kind")
    if each_text:
        return found
    gaps = walked.where("gap_from is not null and j > gap_from").select("work", F.explode(F.sequence(F.col("gap_from"), F.col("j") - 1)).alias("j"))
    lost = gaps.join(theirs.where("not label"), ["work", "j"]).join(blocks.select("work", F.array_join("words", " ").alias("whole")).distinct(), ["work", "whole"], "left_anti")
    return found.unionByName(lost.select("work", F.lit(None).cast("int").alias("i"), "j", F.lit("missing").alias("kind")))
