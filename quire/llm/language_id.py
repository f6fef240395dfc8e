"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, _byte_values, crc_mod, drawn, small_batches, text_blocks, tidy, utf8_texts, word_hashes

#: Bounds of the training sample: documents, their bytes, and words of their runs.
TRAIN_DOCS, TRAIN_BYTES, TRAIN_WORDS = 3000, 16 << 20, 300_000
STEPS, RATE, L2 = 50, 0.3, 1e-6
#: Hashed n-gram features; lexicon words of each language; words of a chain.
FEATURES, LEXICON, CHAIN = 1 << 15, 2000, 256
UNKNOWN = "und"
_LETTERS = {*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(128, 256)}
_VALUES, _OUTSIDE = _byte_values(bytes(set(range(256)) - _LETTERS))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
#: Where UTF-8 has no letters. Second bytes after C2 that are letters (the ordinals and the micro sign), those after C3 that aren't (times, divided by).
_C2_LETTERS, _C3_SIGNS = (0xAA, 0xB5, 0xBA), (0x97, 0xB7)


def letters_only(data: np.ndarray) -> np.ndarray:
    """The bytes with space for punctuation and signs beyond ASCII: Latin-1 signs, U+2000 to U+2BFF and U+2E00 to U+303F, the byte order mark, and emoji (U+1F000 to U+1FFFF)."""
    out = data
    padded = np.append(data, np.zeros(3, np.uint8))
    for lead, width in ((0xC2, 2), (0xC3, 2), (0xE2, 3), (0xE3, 3), (0xEF, 3), (0xF0, 4)):
        at = np.flatnonzero(data == lead)
        if not len(at):
            continue
        second, third = padded[at + 1], padded[at + 2]
        if lead == 0xC2:
            sign = ~np.isin(second, _C2_LETTERS)
        elif lead == 0xC3:
            sign = np.isin(second, _C3_SIGNS)
        elif lead == 0xE2:
            sign = (second <= 0xAF) | (second >= 0xB8)
        elif lead == 0xE3:
            sign = second == 0x80
        elif lead == 0xEF:
            sign = (second == 0xBB) & (third == 0xBF)
        else:
            sign = second == 0x9F
        at = at[sign]
        if len(at):
            out = out.copy() if out is data else out
            for k in range(width):
                out[np.minimum(at + k, len(out) - 1)] = 0x20
    return out


class Words:
    """The words (runs of letters) of a byte block: their number among the block's distinct words, where they start, and the distinct words' features."""

    def __init__(self, data: np.ndarray):
        data = letters_only(data)
        self.starts, hashes = word_hashes(data, _VALUES, _OUTSIDE)
        inside = ~_OUTSIDE[data]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = np.flatnonzero(last) + 1
        self.codes, self.keys = pd.factorize(hashes)
        n = len(self.keys)
        first = np.empty(n, np.int64)
        first[self.codes[::-1]] = np.arange(len(hashes))[::-1]
        s, lengths = self.starts[first], ends[first] - self.starts[first]
        # the distinct words, each between two zero bytes: n-grams with a zero are affixes
        self.at = np.concatenate([[0], np.cumsum(lengths + 1)])
        chars = np.zeros(self.at[-1] + 4, np.uint32)
        fill = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        chars[np.repeat(self.at[:-1] + 1, lengths) + fill] = _FOLD[data[np.repeat(s, lengths) + fill]]
        self.features: list[np.ndarray] = []
        m = int(self.at[-1])
        zero, key, broken = chars == 0, np.zeros(m, np.uint32), np.zeros(m, bool)
        with np.errstate(over="ignore"):
            for k in range(4):
                part = chars[k : k + m]
                broken |= zero[k - 1 : k - 1 + m] if k > 1 else False  # a word's end lies inside the n-gram
                key = (key + part + np.uint32(1)) * np.uint32(0x9E3779B1)
                mixed = key ^ (key >> np.uint32(15))
                feature = (mixed % np.uint32(FEATURES - 1) + np.uint32(1)).astype(np.int16)
                feature[broken] = 0  # feature 0 has no weight
                self.features.append(feature)

    def scores(self, model: dict) -> np.ndarray:
        """Emission scores of the distinct words: sums of n-gram, affix and lexicon weights."""
        w = model["weights"]
        if not len(self.keys):
            return np.zeros((0, w.shape[1]), np.float32)
        total = w[self.features[0]]
        for f in self.features[1:]:
            total = total + w[f]
        return np.add.reduceat(total, self.at[:-1], axis=0) + model["lexicon_weights"][self.lexicon(model)]

    def lexicon(self, model: dict) -> np.ndarray:
        """Each distinct word's row of the lexicon's weights: the language sets that list it; 0 if none does."""
        at = np.minimum(np.searchsorted(model["lexicon"], self.keys), max(0, len(model["lexicon"]) - 1))
        return np.where(model["lexicon"][at] == self.keys, model["lexicon_rows"][at], 0) if len(model["lexicon"]) else np.zeros(len(self.keys), np.int64)


def forward_backward(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginals, expected transitions, log-likelihood normaliser) of chains padded at the end: emission is (steps, chains, labels)."""
    steps, chains, labels = emission.shape
    shift = emission.max(axis=2, keepdims=True)
    e = np.exp(emission - shift)
    t = np.exp(transition).astype(emission.dtype)
    alpha, scale = np.empty_like(e), np.ones((steps, chains, 1), emission.dtype)
    a = e[0]
    for i in range(steps):
        if i:
            a = (alpha[i - 1] @ t) * e[i]
        scale[i] = a.sum(axis=1, keepdims=True)
        alpha[i] = a / scale[i]
    live = np.arange(steps)[:, None] < lengths[None, :]
    beta = np.ones((chains, labels), emission.dtype)
    expected = np.zeros((labels, labels))
    out = alpha
    for i in range(steps - 2, -1, -1):
        ahead = e[i + 1] * beta / scale[i + 1]
        on = live[i + 1][:, None]
        if pairs:
            expected += (alpha[i] * on).T @ ahead * t
        beta = np.where(on, ahead @ t.T, 1)
        out[i] = alpha[i] * beta  # alpha[i] is not needed by the earlier steps
    z = float(((np.log(scale) + shift)[:, :, 0] * live).sum())
    return out, expected, z


def _chains(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step, chain) of each word, and the chains' lengths, for texts of so many words; a text's words are cut into chains of CHAIN words."""
    n = -(-counts // CHAIN)
    first = np.cumsum(n) - n
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    chain = np.repeat(first, counts) + within // CHAIN
    return within % CHAIN, chain, np.bincount(chain, minlength=int(n.sum()))


def train(texts: list[bytes], langs: list[str], seed: int = 7) -> dict:
    """Fit weights and transitions by maximum likelihood on code-switched chains: runs of 4 to 64 words of the labelled texts in random order."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    words = Words(data)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), words.starts, side="right")
    label = np.array([names.index(x) for x in langs])[doc]
    # runs that stay within a text
    cut, n = [], len(doc)
    at = 0
    while at < n:
        cut.append(at)
        at += int(rng.integers(4, 65))
    cuts = np.union1d(np.array(cut, np.int64), np.flatnonzero(np.diff(doc, prepend=-1)))
    runs = np.stack([cuts, np.append(cuts[1:], n)], axis=1)
    runs = runs[rng.permutation(len(runs))]
    sizes = (runs[:, 1] - runs[:, 0]).cumsum()
    runs = runs[: max(1, int(np.searchsorted(sizes, TRAIN_WORDS)))]
    order = np.concatenate([np.arange(a, b) for a, b in runs])
    codes, label = words.codes[order], label[order]
    k, u = len(names), len(words.keys)
    per = np.stack([np.bincount(codes[label == i], minlength=u) for i in range(k)], axis=1)
    listed = np.zeros(u, np.int64)  # bit i: among the most frequent words of language i
    for i in range(k):
        top = np.argsort(-per[:, i], kind="stable")[:LEXICON]
        listed[top[per[top, i] > 1]] |= 1 << i
    rows = {m: r for r, m in enumerate([0, *sorted(set(listed.tolist()) - {0})])}
    order = np.argsort(words.keys)
    model = {
        "names": names, "weights": np.zeros((FEATURES, k), np.float32), "transition": np.zeros((k, k)), "lexicon_weights": np.zeros((len(rows), k), np.float32),
        "lexicon": words.keys[order][listed[order] > 0], "lexicon_rows": np.array([rows[m] for m in listed[order].tolist() if m], np.int64),
    }
    n = len(codes)
    step, chain, lengths = _chains(np.array([n]))
    prior = np.zeros((k, k))
    same = np.flatnonzero(step[1:] > 0)
    np.add.at(prior, (label[same], label[same + 1]), 1)
    word_of = np.repeat(np.arange(u), np.diff(words.at))
    lex = words.lexicon(model)
    grads = {x: np.zeros_like(model[x], np.float64) for x in ("weights", "transition", "lexicon_weights")}
    for _ in range(STEPS):
        emission = np.zeros((CHAIN, len(lengths), k), np.float32)
        emission[step, chain] = words.scores(model)[codes]
        marginal, expected, _ = forward_backward(emission, lengths, model["transition"], pairs=True)
        g = marginal[step, chain].astype(np.float64)
        g[np.arange(n), label] -= 1
        by_word = np.stack([np.bincount(codes, g[:, i], u) for i in range(k)], axis=1)
        new = {"transition": (expected - prior) / n, "weights": L2 * model["weights"].astype(np.float64), "lexicon_weights": np.zeros_like(grads["lexicon_weights"])}
        for f in words.features:
            new["weights"] += np.stack([np.bincount(f, by_word[word_of, i], FEATURES) for i in range(k)], axis=1) / n
        new["weights"][0] = 0
        np.add.at(new["lexicon_weights"], lex, by_word / n)
        for x, v in new.items():  # Adagrad
            grads[x] += v * v
            model[x] = (model[x] - RATE * v / (np.sqrt(grads[x]) + 1e-8)).astype(model[x].dtype)
    return model


def label_texts(texts: list[bytes], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums of the words' label marginals, words, switches between neighbouring words' best labels) of each text."""
    k = len(model["names"])
    sums, counts, switches = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    pieces: list[tuple[int, bytes]] = []
    for i, t in enumerate(texts):  # a very long text is cut where a chain ends, so that pieces change no chain
        at = 0
        while len(t) - at > 2 * BLOCK_BYTES:
            size = BLOCK_BYTES
            while True:
                starts = word_hashes(letters_only(np.frombuffer(t, np.uint8, min(size, len(t) - at), at)), _VALUES, _OUTSIDE)[0]
                whole = (len(starts) - 1) // CHAIN * CHAIN
                if whole > 0 or size >= len(t) - at:
                    break
                size *= 2
            end = at + int(starts[whole]) if whole > 0 else len(t)
            pieces.append((i, t[at:end]))
            at = end
        pieces.append((i, t[at:] if at else t))
    for a, b in text_blocks([p for _, p in pieces]):
        part = [p for _, p in pieces[a:b]]
        of = np.array([i for i, _ in pieces[a:b]])
        words = Words(np.frombuffer(b"\n".join(part) + b"\n", np.uint8))
        n = np.diff(np.searchsorted(words.starts, np.cumsum([0] + [len(t) + 1 for t in part])))
        if not n.sum():
            continue
        step, chain, lengths = _chains(n)
        order = np.argsort(-lengths, kind="stable")  # chains of like length go together
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        scores, doc = words.scores(model), np.repeat(of, n)
        marginal = np.empty((len(step), k), np.float32)
        for lo in range(0, len(order), 1024):
            mine = lengths[order[lo : lo + 1024]]
            some = np.flatnonzero((place[chain] >= lo) & (place[chain] < lo + 1024))
            emission = np.zeros((int(mine[0]), len(mine), k), np.float32)
            emission[step[some], place[chain[some]] - lo] = scores[words.codes[some]]
            marginal[some] = forward_backward(emission, mine, model["transition"])[0][step[some], place[chain[some]] - lo]
        best = marginal.argmax(axis=1)
        for i in range(k):
            sums[:, i] += np.bincount(doc, marginal[:, i], len(texts))
        counts += np.bincount(doc, minlength=len(texts))
        moved = (best[1:] != best[:-1]) & (doc[1:] == doc[:-1])
        switches += np.bincount(doc[1:][moved], minlength=len(texts))
    return sums, counts, switches


def fit(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES) -> dict | None:
    """Train on a bounded sample of the different labelled rows (doc_id, text, lang), drawn by a hash; None if there is none with letters."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    n = known.count()
    rows = drawn(known, n, max_docs, max_bytes).select(F.col("text").cast("binary"), "lang").collect() if n else []
    texts, langs = [bytes(r[0]) for r in rows], [r[1] for r in rows]
    if not any(len(word_hashes(letters_only(np.frombuffer(t, np.uint8)), _VALUES, _OUTSIDE)[0]) for t in texts):
        return None
    return train(texts, langs)


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = TRAIN_DOCS, carry: bool = False) -> DataFrame:
    """Each row's (doc_id, held_out, lang_pred, score, n_words, n_switches); with ``carry`` after all input columns (theirs of these names go, but for the id).

    The model is learned from text and lang of rows whose CRC-32 of the id is not 1 modulo 3, a bounded sample of them; it labels every word
    of every whole text. A word is a run of letters (white space and signs end it, so a text in a script without spaces is one word); a text's
    words form chains of CHAIN words, whatever its length. lang_pred is the language of the
    largest sum of word marginals (ties: first by name), score its mean. A text that is null or has no letter is ``und`` with score 0;
    so is every text if no labelled row exists. Repeated rows are each labelled. Null ids are not held out (their CRC is null) and never train.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    rest = crc_mod("doc_id", 3)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = sc.broadcast(fit(rows.where(rest != 1), max_docs))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            texts = utf8_texts(b.column(2))
            found = [m is not None and any(map(str.isalpha, t.decode("utf-8", "replace"))) for t in texts]
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            counts = switches = np.zeros(len(texts), np.int64)
            if m is not None:
                sums, counts, switches = label_texts(texts, m)
                score = np.where(found, sums.max(axis=1) / np.maximum(counts, 1), 0).clip(0, 1)
                pred = [m["names"][i] if f else UNKNOWN for i, f in zip(sums.argmax(axis=1), found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred), pa.array(score), pa.array(counts), pa.array(switches)], ["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches"])

    added = "held_out boolean, lang_pred string, score double, n_words long, n_switches long"
    held = F.coalesce(crc_mod(key, 3) == 1, F.lit(False)).alias("held_out")
    if not carry:
        return docs.select(F.col(key).alias("doc_id"), held, F.col(text).alias("text")).mapInArrow(tidy(run), f"doc_id {id_type}, {added}")
    own = docs.drop("held_out", "lang_pred", "score", "n_words", "n_switches")
    place = own.columns.index(text)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(b.columns) - 1
            for out in run([pa.RecordBatch.from_arrays([b.column(n), b.column(n), b.column(place)], ["a", "b", "c"])]):
                yield pa.RecordBatch.from_arrays([*b.columns, *out.columns[2:]], [*b.schema.names, *out.schema.names[2:]])

    from pyspark.sql.types import StructType

    return own.withColumn("held_out", held).mapInArrow(tidy(carried), StructType([*own.schema.fields, *_parsed(added)]))


def _parsed(ddl: str) -> list:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fields


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op2_language_id": op2_language_id}
