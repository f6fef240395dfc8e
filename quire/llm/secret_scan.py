"""Secret scans: fixed patterns, and a battery of randomness tests on long tokens (native)."""

from __future__ import annotations

import json
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

# The kinds of spans in their order, and the patterns of the first three.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

def _runs(letters: str, end: str) -> str:
    """Runs of ``letters`` with = as padding at their end alone; padding counts towards the 20 characters, so ``_candidates`` drops shorter matches."""
    return rf"[{letters}]{{20,}}(?:=+{end})?|[{letters}]{{1,19}}+=+{end}"


CANDIDATE = _runs("A-Za-z0-9+/_-", "(?![A-Za-z0-9+/_=-])")
#: What a token that mixes both alphabets of base 64 is cut into.
PARTS = (_runs("A-Za-z0-9+/", ""), _runs("A-Za-z0-9_-", ""))
ALPHABETS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("base64", r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Pooled cells of the alphabets: short tokens leave too few letters in each cell of a whole alphabet. Digits are pooled with signs.
POOLS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789+/_-")
#: Length classes (lower bounds) within which the false-discovery rate is held, and that rate.
LENGTHS, RATE = (20, 32, 48, 96), 0.05
#: P-values are ranked in steps of a twentieth of a decade, down to 10^-30.
STEPS, PER_DECADE = 600, 20
#: Lengths whose null distribution is simulated (a token takes that of the longest that isn't longer), simulated tokens of each, and the steps down to which their quantiles are read.
NULL_LENGTHS, NULL_TOKENS, NULL_STEPS = (20, 21, 22, 24, 26, 28, 32, 36, 40, 44, 48, 56, 64, 80, 96, 128, 256), 12000, 50
#: Matches of a block: offsets are summed within blocks and then across them, so that many matches take linear time.
BLOCK = 256


@lru_cache(maxsize=1)
def null_tables() -> tuple[tuple[float, ...], ...]:
    """Upper quantiles of the combined statistic of random tokens, one row for each alphabet size and null length: at 10^(-step / PER_DECADE) for steps 0 to NULL_STEPS.

    The three tests depend on each other, and short tokens are far from their limits, so no textbook distribution has the right level.
    """
    rng = np.random.default_rng(20)
    upper = lambda z: np.minimum(1.0, 1 / (1 + np.exp(np.minimum(1.5976 * z + 0.07056 * z**3, 600))))
    cube = lambda chi, df: (np.cbrt(np.maximum(chi, 0) / df) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    out = []
    for _, _, letters in ALPHABETS:
        k = len(letters)
        for n in NULL_LENGTHS:
            codes = rng.integers(0, k, (NULL_TOKENS, n))
            counts = np.bincount((codes + k * np.arange(NULL_TOKENS)[:, None]).ravel(), minlength=k * NULL_TOKENS).reshape(-1, k)
            df = k - 1
            chi = np.maximum((counts.astype(float) ** 2).sum(axis=1) * k / n - n, 0)
            z1 = cube(chi, df)
            runs = 1 + ((codes[:, 1:] < k / 2) != (codes[:, :-1] < k / 2)).sum(axis=1)
            z2 = np.abs(runs - (n + 1) / 2) / np.sqrt((n - 1) / 4)
            c = codes - df / 2
            z3 = np.abs((c[:, 1:] * c[:, :-1]).sum(axis=1)) / ((k * k - 1) / 12) / np.sqrt(n - 1)
            pools = [[letters.index(c) for c in pool if c in letters] for pool in POOLS]
            share = np.array([len(p) for p in pools if p]) / k
            got = np.stack([counts[:, p].sum(axis=1) for p in pools if p], axis=1)
            z4 = cube((got**2 / share).sum(axis=1) / n - n, len(share) - 1)
            x = -2 * (np.log(upper(z1)) + np.log(2 * upper(z2)) + np.log(2 * upper(z3)) + np.log(upper(z4)))
            out.append(tuple(np.quantile(x, 1 - 10.0 ** (-np.arange(NULL_STEPS + 1) / PER_DECADE)).round(4).tolist()))
    return tuple(out)


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """The pattern's leftmost non-overlapping matches as structs (s, k, e, m, v); offsets in code points, v is group 2 of an assignment.

    ``split`` leaves the pieces between matches, so running lengths of pieces and matches give offsets.
    """
    k = KINDS.index(kind)
    pat = F.lit(pattern)
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, pat, F.lit(0)).alias("m"), F.regexp_extract_all(text, pat, F.lit(2 if kind == "assign" else 0)).alias("v")
    )  # the last piece has no match
    span = "struct<s:bigint,k:int,e:bigint,m:string,v:string>"
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))).cast("long").alias("at"),
        F.when(
            x["m"].isNotNull(),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["p"])).cast("long").alias("s"), F.lit(k).alias("k"), (acc["at"] + F.length(x["p"]) + F.length(x["m"])).cast("long").alias("e"), x["m"].alias("m"), x["v"].alias("v")))),
        ).otherwise(acc["out"]).alias("out"),
    )
    zero = lambda at: F.struct(at.cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("out"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / BLOCK).cast("int")), lambda i: F.slice(zipped, i * BLOCK + 1, BLOCK))

    def add(acc: Column, block: Column) -> Column:
        inner = F.aggregate(block, zero(acc["at"]), step)
        return F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))[0]

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{span}>>").alias("out"))
    return F.when(text.rlike(pattern), F.flatten(F.aggregate(blocks, start, add, lambda a: a["out"]))).otherwise(F.array().cast(f"array<{span}>"))


def _candidates(text: Column) -> Column:
    """Spans of 20 characters or more that the battery tests: tokens, or the runs of either base-64 alphabet in a token that mixes both.

    So a secret behind KEY= or a path is tested by itself. Runs of the two alphabets can overlap; the same run is taken once.
    """
    def parts(x: Column) -> Column:
        both = F.array_distinct(F.concat(*(_spans(x["m"], pattern, "random") for pattern in PARTS)))
        return F.transform(both, lambda y: F.struct((x["s"] + y["s"]).alias("s"), y["k"].alias("k"), (x["s"] + y["e"]).alias("e"), y["m"].alias("m"), y["v"].alias("v")))

    mixed = lambda x: x["m"].rlike("[+/]") & x["m"].rlike("[_-]")
    found = F.flatten(F.transform(_spans(text, CANDIDATE, "random"), lambda x: F.when(mixed(x), parts(x)).otherwise(F.array(x))))
    return F.filter(found, lambda x: x["e"] - x["s"] >= LENGTHS[0])


def _named(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _upper(z: Column) -> Column:
    """The normal distribution's upper tail (logistic approximation)."""
    y = 1.5976 * z + 0.07056 * z * z * z
    return F.least(F.lit(1.0), 1 / (1 + F.exp(F.least(y, F.lit(600.0)))))


def _in_pool(letters: Column, pool: str, most: int | None = None) -> Column:
    """How many letters of the alphabet, or 1 if any, are in the pool."""
    n = F.length(F.regexp_replace(letters, f"[^{pool}]", "")).cast("double")
    return n if most is None else F.least(n, F.lit(float(most)))


def _pool_term(body: Column, letters: Column, k: Column, pool: str) -> Column:
    """Squared count of the pool's letters over its share of the alphabet."""
    got = F.length(F.regexp_replace(body, f"[^{pool}]", "")).cast("double")
    return F.when(_in_pool(letters, pool) > 0, got * got * k / F.greatest(_in_pool(letters, pool), F.lit(1.0))).otherwise(0.0)


def battery(token: Column) -> Column:
    """The combined p-value that the token is a random string of its inferred encoding, as a struct (encoding, p).

    Chi-squared uniformity over the alphabet and over its pools of vowels, consonants and digits (in the cube-root normal form), runs above and below the alphabet's middle, and lag-1 serial
    correlation of the codes, their logs summed as in Fisher's method. The sum's p-value is read from its simulated distribution for the
    alphabet and length (``null_tables``), between quantiles by straight lines and beyond the last one along the last decade's
    slope. Padding is left out; a token of no single encoding has p 0.
    """
    name, letters = F.lit("mixed"), F.lit("")
    for encoding, pattern, alphabet in reversed(ALPHABETS):
        name, letters = F.when(token.rlike(pattern), encoding).otherwise(name), F.when(token.rlike(pattern), alphabet).otherwise(letters)
    let = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    named = F.struct(name.alias("name"), letters.alias("letters"), token.alias("token"))
    read = lambda x: F.struct(
        x["name"].alias("name"), x["letters"].alias("letters"), F.length(x["letters"]).cast("double").alias("k"),
        F.regexp_replace(F.when(x["name"] == "hex", F.lower(x["token"])).otherwise(x["token"]), "=+$", "").alias("body"),
    )
    coded = lambda x: F.struct(
        x["name"].alias("name"), x["k"].alias("k"), F.length(x["body"]).cast("double").alias("n"),
        F.transform(F.filter(F.split(x["body"], ""), lambda c: c != ""), lambda c: F.instr(x["letters"], c).cast("double") - 1).alias("codes"),
        F.aggregate(
            F.filter(F.split(x["letters"], ""), lambda c: c != ""), F.lit(0.0),
            lambda acc, c: acc + F.pow((F.length(x["body"]) - F.length(F.replace(x["body"], c, F.lit("")))).cast("double"), F.lit(2.0)),
        ).alias("squares"),
        sum((_pool_term(x["body"], x["letters"], x["k"], pool) for pool in POOLS[1:]), _pool_term(x["body"], x["letters"], x["k"], POOLS[0])).alias("pooled"),
        sum((_in_pool(x["letters"], pool, 1) for pool in POOLS[1:]), _in_pool(x["letters"], POOLS[0], 1)).alias("pools"),
    )
    paired = lambda x: F.struct(
        x["name"].alias("name"), x["k"].alias("k"), x["n"].alias("n"), x["squares"].alias("squares"), x["pooled"].alias("pooled"), x["pools"].alias("pools"),
        F.zip_with(F.slice(x["codes"], 1, F.size(x["codes"]) - 1), F.slice(x["codes"], 2, F.size(x["codes"]) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("pairs"),
    )

    def tested(x):
        k, n, df = x["k"], x["n"], x["k"] - 1
        chi = F.greatest(x["squares"] * k / n - n, F.lit(0.0))
        cube = lambda chi, df: (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        z1, z4 = cube(chi, df), cube(F.greatest(x["pooled"] / n - n, F.lit(0.0)), x["pools"] - 1)
        runs = F.aggregate(x["pairs"], F.lit(1.0), lambda acc, y: acc + F.when((y["a"] < k / 2) != (y["b"] < k / 2), 1.0).otherwise(0.0))
        z2 = F.abs(runs - (n + 1) / 2) / F.sqrt((n - 1) / 4)
        serial = F.aggregate(x["pairs"], F.lit(0.0), lambda acc, y: acc + (y["a"] - df / 2) * (y["b"] - df / 2))
        z3 = F.abs(serial) / ((k * k - 1) / 12) / F.sqrt(n - 1)
        logs = lambda p: F.log(F.greatest(p, F.lit(1e-40)))
        place = F.lit(0)
        for i, (encoding, _, _) in enumerate(ALPHABETS):
            place = F.when(x["name"] == encoding, i * len(NULL_LENGTHS)).otherwise(place)
        place = place + sum((F.when(n >= least, 1).otherwise(0) for least in NULL_LENGTHS[1:]), F.lit(1))
        return F.struct(
            x["name"].alias("name"), (-2 * (logs(_upper(z1)) + logs(2 * _upper(z2)) + logs(2 * _upper(z3)) + logs(_upper(z4)))).alias("x"), F.element_at(tables, place.cast("int")).alias("null"),
        )

    tables = F.from_json(F.lit(json.dumps(null_tables())), "array<array<double>>")
    above = lambda x: F.struct(x["name"].alias("name"), x["x"].alias("x"), x["null"].alias("null"), F.size(F.filter(x["null"], lambda q: q <= x["x"])).alias("j"))

    def step(x):
        q = lambda j: F.element_at(x["null"], j)
        j = F.least(F.greatest(x["j"], F.lit(1)), F.lit(NULL_STEPS))
        inside = (j - 1) + F.least(F.greatest((x["x"] - q(j)) / F.greatest(q(j + 1) - q(j), F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
        slope = F.greatest((q(F.lit(NULL_STEPS + 1)) - q(F.lit(NULL_STEPS + 1 - PER_DECADE))) / PER_DECADE, F.lit(1e-3))
        return F.when(x["j"] > NULL_STEPS, NULL_STEPS + (x["x"] - q(F.lit(NULL_STEPS + 1))) / slope).otherwise(inside)

    p = lambda x: F.pow(F.lit(10.0), -step(x) / PER_DECADE)
    done = lambda x: F.struct(x["name"].alias("encoding"), F.when(x["name"] == "mixed", 0.0).otherwise(F.least(F.coalesce(p(x), F.lit(0.0)), F.lit(1.0))).alias("p"))
    return let(let(let(let(let(let(named, read), coded), paired), tested), above), done)


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, random_p).

    Base spans come from three patterns. A token of 20 or more characters of common encodings that no base span touches is also a span, of kind
    ``random``, if the battery can't tell it from random text: each token's null hypothesis is randomness, and Benjamini-Hochberg
    within its length class decides which are rejected as ordinary, so that at most ``RATE`` of those rejected are expected to be
    random. = ends a token unless it is padding, and tokens that mix the base-64 alphabets are tested in parts. random_p has
    the random spans' p-values. Ranks come from a histogram of 601 steps for each of four length classes, whatever the input. Null text is
    empty; repeated rows are each scanned; extra columns are left out; no rows give none. Texts are only read, and only spans are kept.
    """
    spark = docs.sparkSession
    t = F.col("text")
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id", F.filter(_spans(t, ASSIGN, "assign"), lambda x: F.length(x["v"]) >= 8).alias("a"), _spans(t, ACCESS, "access").alias("c"), _spans(t, HEX, "hex").alias("h"),
        _candidates(t).alias("r"),
    )
    rows = rows.withColumn("base", F.concat("a", "c", "h"))
    rows = rows.withColumn("r", F.filter("r", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))))
    step = lambda p: F.when(p <= 0, STEPS).otherwise(F.least(F.lit(STEPS), F.floor(-F.log10(p) * PER_DECADE))).cast("int")
    size = lambda x: reduce(lambda a, b: a + b, [F.when(x["e"] - x["s"] >= n, 1).otherwise(0) for n in LENGTHS[1:]])
    rows = rows.select(
        "doc_id", F.size("a").cast("long").alias("n_assign"), F.size("c").cast("long").alias("n_access"), F.size("h").cast("long").alias("n_hex"),
        F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))).alias("base"),
        F.transform("r", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), size(x).alias("size"), battery(x["m"]).alias("test"))).alias("r"),
    )
    rows = rows.withColumn("r", F.transform("r", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["size"].alias("size"), x["test"]["p"].alias("p"), step(x["test"]["p"]).alias("step"))))
    rows = staged(rows, "spans")
    # Benjamini-Hochberg per length class: the smallest step (largest p-value) whose rank reaches it
    seen = rows.select(F.explode("r").alias("x")).groupBy("x.size", "x.step").agg(F.count("*").alias("n"))
    up = W.partitionBy("size").orderBy(F.desc("step"))
    ranked = seen.withColumn("rank", F.sum("n").over(up)).withColumn("m", F.sum("n").over(W.partitionBy("size")))
    reject = ranked.where(F.pow(F.lit(10.0), -F.col("step") / PER_DECADE) <= RATE * F.col("rank") / F.col("m")).groupBy("size").agg(F.min("step").alias("least"))
    limits = [STEPS + 1] * len(LENGTHS)
    for n, least in reject.collect():  # four rows at most
        limits[n] = least
    limit = F.array(*map(F.lit, limits))
    rows = rows.withColumn("r", F.transform(F.filter("r", lambda x: x["step"] < F.element_at(limit, x["size"] + 1)), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["p"].alias("p"))))
    bare = F.transform("r", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_named(F.col("base")).cast("binary"), 256).alias("base_sha256"), _named(F.concat("base", bare)).alias("spans"),
        F.size("r").cast("long").alias("n_random"), F.transform("r", lambda x: x["p"]).alias("random_p"),
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op7_secret_scan": op7_secret_scan}
