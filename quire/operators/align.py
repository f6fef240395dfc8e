"""Comparing two witnesses of a text: n-gram anchors, omissions, bags, coverage, block similarity."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from quire.functions.text import fold_accents, tokens
from quire.functions.unicode import fold as fold_as
from quire.operators.order import in_blocks
from quire.operators.order import positions as in_order
from quire.sources.shared import small_batches, staged


def positions(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, w) of each token."""
    return df.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "w"))


def ngrams(df: DataFrame, key: str, n: int, text: str = "text") -> DataFrame:
    """(key, pos, gram) of each run of n tokens, built in the row without a window: its tokens, each beginning one later, are laid side by side."""
    t = df.select(key, tokens(F.col(text)).alias("t"))
    runs = F.greatest(F.size("t") - (n - 1), F.lit(0))
    beside = F.arrays_zip(*[F.slice("t", k + 1, runs).alias(f"w{k}") for k in range(n)])
    return t.select(key, F.posexplode(beside).alias("pos", "g")).select(key, "pos", F.concat_ws(" ", *[F.col(f"g.w{k}") for k in range(n)]).alias("gram"))


#: Grams of a witness set that are broadcast as 8-byte hashes to thin out the texts' grams; larger sets are joined as they are.
MOST_GRAMS = 2_000_000


def known_grams(docs: DataFrame, items: DataFrame, n: int, key: str, item: str) -> tuple[DataFrame, DataFrame]:
    """The grams of both sides, those of the texts only where the items may have them: by hashes, so texts' other grams are never shuffled."""
    ours, theirs = ngrams(docs, key, n), ngrams(items, item, n)
    hashes = theirs.select(F.xxhash64("gram").alias("_h")).distinct()
    if hashes.count() <= MOST_GRAMS:
        ours = ours.withColumn("_h", F.xxhash64("gram")).join(F.broadcast(hashes), "_h", "left_semi").drop("_h")
    return ours, theirs


def candidate_pairs(docs: DataFrame, items: DataFrame, n: int = 5, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(key, item) that share an n-gram: the pairs that the other operators compare."""
    ours, theirs = known_grams(docs, items, n, key, item)
    return ours.select(key, "gram").distinct().join(theirs.select(item, "gram").distinct(), "gram").select(key, item).distinct()


def omission_runs(docs: DataFrame, items: DataFrame, pairs: DataFrame, least: int = 4, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(key, item, start, length): maximal runs of a witness's tokens that the page lacks, counting occurrences. [A4, W1, U3]

    The pairs are staged, as both the pages and the witnesses are joined with them.
    """
    pairs = staged(pairs.select(key, item), "pairs")
    own = positions(items, item).withColumn("k", F.row_number().over(W.partitionBy(item, "w").orderBy("pos")))
    have = positions(docs.join(pairs.select(key).distinct(), key, "left_semi"), key).groupBy(key, "w").agg(F.count("*").alias("n"))
    rows = pairs.join(own, item).join(have, [key, "w"], "left").withColumn("absent", F.coalesce("n", F.lit(0)) < F.col("k"))
    rows = rows.where("absent").withColumn("run", F.col("pos") - F.row_number().over(W.partitionBy(key, item).orderBy("pos")))
    return rows.groupBy(key, item, "run").agg(F.min("pos").cast("long").alias("start"), F.count("*").alias("length")).where(F.col("length") >= least).drop("run")


def bag_collation(docs: DataFrame, items: DataFrame, pairs: DataFrame, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(key, item, only_ours, only_gold, permille): distinct tokens on one side only, and the ratio of token counts. [A2, U1]"""
    a = docs.select(key, tokens(F.col("text")).alias("a"))
    b = items.select(item, tokens(F.col("text")).alias("b"))
    rows = pairs.join(a, key).join(b, item)
    size = lambda x, y: F.size(F.array_except(F.array_distinct(x), y)).cast("long")
    return rows.select(key, item, size("a", "b").alias("only_ours"), size("b", "a").alias("only_gold"), F.floor(F.size("a") * 1000 / F.greatest(F.size("b"), F.lit(1))).cast("long").alias("permille"))


def shingle_offsets(docs: DataFrame, items: DataFrame, n: int = 5, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(key, item, offset, votes): the offset that most shared n-grams agree on, ties to the smallest. [J9]"""
    ours, theirs = known_grams(docs, items, n, key, item)
    met = ours.alias("x").join(theirs.alias("y"), F.col("x.gram") == F.col("y.gram"))
    votes = met.groupBy(key, item, (F.col("x.pos") - F.col("y.pos")).cast("long").alias("offset")).agg(F.count("*").alias("votes"))
    best = votes.groupBy(key, item).agg(F.max(F.struct("votes", (-F.col("offset")).alias("o"))).alias("m"))
    return best.select(key, item, (-F.col("m.o")).alias("offset"), F.col("m.votes").alias("votes"))


def anchors(docs: DataFrame, items: DataFrame, n: int = 4, key: str = "doc_id", item: str = "item_id", least_distinct: int = 3) -> DataFrame:
    """(key, item, pos, item_pos) of n-grams that occur once in each and have ``least_distinct`` different words or more. [J10]

    Texts' grams that no item has are dropped by their hashes before anything is counted.
    """
    ours, theirs = known_grams(docs, items, n, key, item)
    varied = lambda d: d.where(F.size(F.array_distinct(F.split("gram", " "))) >= least_distinct) if least_distinct > 1 else d
    once = lambda d, k: varied(d).groupBy(k, "gram").agg(F.min("pos").cast("long").alias(f"p_{k}"), F.count("*").alias("c")).where("c = 1").drop("c")
    met = once(ours, key).join(once(theirs, item), "gram")
    return met.select(key, item, F.col(f"p_{key}").alias("pos"), F.col(f"p_{item}").alias("item_pos"))


def heaviest_chain(rows: DataFrame, weight: str = "weight", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """The chain of anchors (key, item, pos, item_pos, weight) that rises on both sides and weighs most, for each pair (a group is one pair's anchors). [J10]

    A Fenwick tree over the item's positions holds the heaviest chain that ends up to each, so a pair of n anchors takes n log n steps.
    """

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "item_pos"], ascending=[True, False]).reset_index(drop=True)
        place = {v: i for i, v in enumerate(sorted(set(pdf["item_pos"])), 1)}
        tree: list[tuple[float, int]] = [(0.0, -1)] * (len(place) + 1)
        back, total = [-1] * len(pdf), [0.0] * len(pdf)
        for i, (v, w) in enumerate(zip(pdf["item_pos"].tolist(), pdf[weight].tolist(), strict=True)):
            k, best = place[v] - 1, (0.0, -1)
            while k:
                best = max(best, tree[k], key=lambda x: x[0])
                k &= k - 1
            total[i], back[i] = best[0] + w, best[1]
            k = place[v]
            while k < len(tree):
                if total[i] > tree[k][0]:
                    tree[k] = (total[i], i)
                k += k & -k
        keep, i = [], max(range(len(pdf)), key=total.__getitem__, default=-1)
        while i >= 0:
            keep.append(i)
            i = back[i]
        return pdf.iloc[sorted(keep)]

    return rows.groupBy(key, item).applyInPandas(chain, rows.schema)


def monotone(rows: DataFrame, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """The longest chain of anchors rising on both sides, for each pair (a group is one pair's anchors). [J10]"""

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "item_pos"], ascending=[True, False]).reset_index(drop=True)
        ends: list[int] = []
        at: list[int] = []
        back = [-1] * len(pdf)
        for i, v in enumerate(pdf["item_pos"].tolist()):
            k = bisect_left(ends, v)
            back[i] = at[k - 1] if k else -1
            if k == len(ends):
                ends.append(v)
                at.append(i)
            else:
                ends[k], at[k] = v, i
        keep, i = [], at[-1] if at else -1
        while i >= 0:
            keep.append(i)
            i = back[i]
        return pdf.iloc[sorted(keep)]

    return rows.groupBy(key, item).applyInPandas(chain, rows.schema)


def coverage(pairs: DataFrame, page: str = "page", witness: str = "witness", fail: float = 0.90, watch: float = 0.94) -> DataFrame:
    """Add recall, precision and status of a page against a witness by matching blocks of folded letters and digits. [A3]"""
    small_batches(pairs.sparkSession)
    fold = lambda c: fold_as(F.coalesce(F.col(c), F.lit("")), "coverage")

    @F.pandas_udf("long")
    def matched(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()) for x, y in zip(a, b, strict=True)])

    rows = pairs.withColumn("_a", fold(page)).withColumn("_b", fold(witness)).withColumn("_m", matched("_a", "_b"))
    share = lambda c: F.when(F.length(c) > 0, F.col("_m") / F.length(c)).otherwise(0.0)
    rows = rows.withColumn("recall", share("_b")).withColumn("precision", share("_a"))
    score = F.least("recall", "precision")
    blank = (F.col("_a") == "") & (F.col("_b") == "")
    status = F.when(F.col(page).isNull(), "missing").when(F.col(witness).isNull(), "no-witness").when(blank, "blank").when(score < fail, "fail").when(score < watch, "watch").otherwise("ok")
    return rows.withColumn("status", status).drop("_a", "_b", "_m")


def char_bag(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """(keys, bound): characters that the folded texts share as multisets, the most that any alignment can match. [A3]"""
    fold = lambda c: fold_as(F.col(c), "coverage")
    rows = pairs.select(*keys, fold(a).alias("a"), fold(b).alias("b"))
    total = F.lit(0)
    for ch in "abcdefghijklmnopqrstuvwxyz0123456789":
        n = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit(ch), F.lit("")))  # noqa: B023, E731
        total = total + F.least(n("a"), n("b"))
    return rows.select(*keys, total.cast("long").alias("bound"))


def edit_distance(a: list | str, b: list | str) -> int:
    """Insertions, deletions and substitutions, each 1, over any two sequences. [M1]"""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _hunks(a: str | None, b: str | None) -> list[tuple[list[str], list[str]]]:
    x, y = (a or "").split(), (b or "").split()
    ops = SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
    return [(x[i:j], y[k:m]) for tag, i, j, k, m in ops if tag != "equal"]


def word_errors(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Add edits, wer, char_edits and cer of ``b`` against ``a``: exact edits within each run of differing words, over the words and characters of ``a``.

    A run that only one side has costs one character more, for its space. Null counts as empty. [M2]
    """
    small_batches(pairs.sparkSession)

    @F.pandas_udf(StructType().add("edits", LongType()).add("char_edits", LongType()))
    def edits(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for s, t in zip(x, y, strict=True):
            found = _hunks(s, t)
            chars = sum(edit_distance(" ".join(p), " ".join(q)) + (not p or not q) for p, q in found)
            out.append((sum(edit_distance(p, q) for p, q in found), chars))
        return pd.DataFrame(out, columns=["edits", "char_edits"])

    words = F.filter(F.split(F.coalesce(F.col(a), F.lit("")), r"\s+"), lambda w: w != "")
    rows = pairs.withColumn("_e", edits(a, b)).withColumn("_w", words)
    per = lambda n, size: F.round(n / F.greatest(size, F.lit(1)), 5)
    rows = rows.withColumn("edits", F.col("_e.edits")).withColumn("wer", per(F.col("edits"), F.size("_w")))
    return rows.withColumn("char_edits", F.col("_e.char_edits")).withColumn("cer", per(F.col("char_edits"), F.length(F.array_join("_w", " ")))).drop("_e", "_w")


def block_alignment(blocks: DataFrame, floor: float = 0.30, gap: float = -0.35, band: int = 40) -> DataFrame:
    """Align rows (pair, side 'a' or 'b', pos, words array) by dynamic programming over token-set Jaccard; one group is one pair of documents. [J13]

    Returns (pair, a_pos, b_pos, sim); a side is null where a block has no partner. A diagonal step under the floor costs 1 and yields two
    unpaired blocks; ties prefer the diagonal, then a.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        side = {s: g.sort_values("pos") for s, g in pdf.groupby("side")}
        rows = {s: ([(p, frozenset(w)) for p, w in zip(side[s]["pos"], side[s]["words"], strict=True)] if s in side else []) for s in "ab"}
        a, b = rows["a"], rows["b"]
        sim = lambda i, j: len(a[i][1] & b[j][1]) / len(a[i][1] | b[j][1]) if a[i][1] and b[j][1] and abs(i - j) <= band else 0.0
        best = [[(gap * (i + j), "u" if i else "l") for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                s = sim(i - 1, j - 1)
                best[i][j] = max((best[i - 1][j - 1][0] + (s if s >= floor else -1.0), "d"), (best[i - 1][j][0] + gap, "u"), (best[i][j - 1][0] + gap, "l"), key=lambda x: (x[0], "lud".index(x[1])))
        out, i, j = [], len(a), len(b)
        while i or j:
            step = "l" if not i else "u" if not j else best[i][j][1]
            s = sim(i - 1, j - 1) if step == "d" else None
            if step == "d" and s >= floor:
                out.append((a[i - 1][0], b[j - 1][0], s))
            else:
                out += ([(None, b[j - 1][0], None)] if step in "dl" else []) + ([(a[i - 1][0], None, None)] if step in "du" else [])
            i, j = i - (step in "du"), j - (step in "dl")
        got = pd.DataFrame(out[::-1], columns=["a_pos", "b_pos", "sim"]).astype({"a_pos": "Int64", "b_pos": "Int64", "sim": "float64"})
        got.insert(0, "pair", pdf["pair"].iloc[0])
        return got

    return blocks.groupBy("pair").applyInPandas(solve, "pair long, a_pos long, b_pos long, sim double")


def line_set_jaccard(docs: DataFrame, by: str = "source", key: str = "doc_id", band: int = 3, least: float = 0.30) -> DataFrame:
    """(by, a, b, permille) of neighbouring documents of a work whose token sets are alike; the band keeps the join linear. [J13, M3]"""
    rows = in_order(docs.select(by, key, F.array_distinct(tokens(F.col("text"))).alias("s")), [by], key)
    w = W.partitionBy(by, "block").orderBy("pos")
    near = in_blocks(rows, band).select(by, F.col(key).alias("a"), "s", "own", F.array(*[F.lead(F.struct(key, "s"), k).over(w) for k in range(1, band + 1)]).alias("ns")).where("own")
    near = near.select(by, "a", "s", F.explode("ns").alias("n")).where("n is not null")
    i, u = F.size(F.array_intersect("s", "n.s")), F.size(F.array_union("s", "n.s"))
    return near.select(by, "a", F.col(f"n.{key}").alias("b"), F.floor(i * 1000 / F.greatest(u, F.lit(1))).cast("long").alias("permille")).where(F.col("permille") >= int(least * 1000))


# ---------------------------------------------------------------- sites where voices differ

_SITE = "array<struct<kind:string,start:bigint,a:string,b:string,before:string,after:string,third:string,agrees:string>>"
#: Words of context, how far an anchor may lie from a site, and how much longer than the site the third voice's gap may be.
CONTEXT, REACH, SLACK = 6, 5, 3


def _third_reading(links: dict[int, int], third: list[str], i1: int, i2: int, n: int) -> str | None:
    """What the third voice has between the nearest tokens on both sides that it shares; None where they are too far or the gap too long."""
    left = next((i for i in range(i1 - 1, max(-1, i1 - 1 - REACH), -1) if i in links), None)
    right = next((i for i in range(i2, min(n, i2 + REACH)) if i in links), None)
    if left is None or right is None:
        return None
    lo, hi = links[left] + (i1 - left), links[right] - (right - i2)
    return " ".join(third[lo:hi]) if 0 <= hi - lo <= i2 - i1 + SLACK else None


def _sites(a: list[str], b: list[str], third: list[str] | None) -> list[dict]:
    out, links = [], {}
    if third is not None:
        for m in SequenceMatcher(None, a, third, autojunk=False).get_matching_blocks():
            links.update((m.a + k, m.b + k) for k in range(m.size))
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal" or all(len(w) <= 2 or w.isnumeric() for w in a[i1:i2] + b[j1:j2]):
            continue
        x, y = " ".join(a[i1:i2]), " ".join(b[j1:j2])
        read = _third_reading(links, third, i1, i2, len(a)) if third is not None else None
        agrees = "unknown" if read is None else "a" if read == x else "b" if read == y else "neither"
        out.append({"kind": tag, "start": i1, "a": x, "b": y, "before": " ".join(a[max(0, i1 - CONTEXT) : i1]), "after": " ".join(a[i2 : i2 + CONTEXT]), "third": read, "agrees": agrees})
    return out


def collation_sites(pairs: DataFrame, a: str, b: str, third: str, keys: list[str]) -> DataFrame:
    """(keys, kind, start, a, b, before, after, third, agrees): each run of folded words in which witness ``b`` differs from ``a``, and which of them the third voice reads.

    Runs of numerals and words of two letters or fewer are left out. A null third voice is unknown everywhere; null texts are empty. The rows given
    are compared one by one, each whole, in a task; words go there as lines of one string, in batches of 2 MB. [J8, J12]
    """
    small_batches(pairs.sparkSession)

    @F.pandas_udf(_SITE)
    def compare(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([_sites(p.split(), q.split(), None if r is None else r.split()) for p, q, r in zip(x, y, z, strict=True)])

    w = lambda c: F.array_join(F.regexp_extract_all(fold_accents(F.coalesce(F.col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), "\n")
    rows = pairs.select(*keys, w(a).alias("_a"), w(b).alias("_b"), F.when(F.col(third).isNotNull(), w(third)).alias("_c"))
    return rows.select(*keys, F.inline(compare("_a", "_b", "_c")))


def shared_errors(sites: DataFrame, lexicon: DataFrame, keys: list[str], least: int = 50, rare: int = 5, sure: int = 200) -> DataFrame:
    """(keys, start, own, other, own_n, other_n) of single words that two agreed witnesses may share as an error, from their sites against a third voice.

    The third voice's form must be frequent, of three letters or more and near the other's in spelling. It is selected if the witnesses' form is
    rare; otherwise if that pair occurs once, neither form begins or ends the other, and the third's is very frequent. [J11]
    """
    pair = sites.where("kind = 'replace' and before <> '' and after <> '' and not contains(a, ' ') and not contains(b, ' ') and length(b) >= 3")
    pair = pair.where(F.levenshtein("a", "b") <= F.greatest(F.lit(2), F.floor(F.length("b") / 3))).select(*keys, "start", F.col("a").alias("own"), F.col("b").alias("other"))
    met = pair.join(lexicon.select(F.col("form").alias("other"), F.col("n").alias("other_n")).where(F.col("n") >= least), "other")
    met = met.join(lexicon.select(F.col("form").alias("own"), F.col("n").alias("own_n")), "own", "left").fillna(0, ["own_n"])
    once = met.groupBy("own", "other").agg(F.count("*").alias("_k"))
    ends = lambda x, y: F.startswith(F.col(x), F.col(y)) | F.endswith(F.col(x), F.col(y))
    apart = (F.col("_k") == 1) & ~ends("own", "other") & ~ends("other", "own") & (F.col("other_n") >= sure)
    return met.join(once, ["own", "other"]).where((F.col("own_n") < rare) | apart).select(*keys, "start", "own", "other", "own_n", "other_n")
