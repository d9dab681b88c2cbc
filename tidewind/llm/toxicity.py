"""Toxicity of texts, scored on what a noisy channel restores.

A character trigram model is counted over all texts. Words that look disguised (letters mixed with digits or signs, letters spaced
out, a letter twice and more) span a lattice: each sign may stand for a letter it looks like, for itself or for nothing, and each
repetition may go. Viterbi decoding picks the reading that channel and language model find likeliest; a word without such signs has one
path, itself. What holds no letter at all is not decoded unless it is spaced out. The restored words and their beginnings are the features of a logistic regression, learned from labelled rows.

Labels are learned from rows alone whose crc32(identifier as text) mod 5 isn't 0; of these at most TRAIN_ROWS, drawn by a hash of the
identifier. Scores use nothing but the text.

Defined results: null and empty texts get the score of a text without features; a null identifier is not held out; a label that is null
is left out, of several labels of an identifier the largest counts; without labels of both kinds every score is the share of toxic
labels (0 if there are none); repeated rows are scored each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, by_rows, columns, hinted, map_rows, shared_dir, table, written

#: Symbols of the character model: 0 is what is no letter, 1 to 26 are a to z, other letters share the rest by their code points.
SYMBOLS = 64
#: Labelled rows that the classifier is fitted on, at most; and its features, at most (those that tell the labels best apart).
TRAIN_ROWS, FEATURES = 12_000, 6_000
#: Letters of the word beginnings that are features beside the word itself.
PREFIXES = (4, 5, 6)
BROADCAST_ROWS = 1_000_000
#: Bytes of restored words that a task remembers.
REMEMBERED = 24 << 20
#: Characters of text that the counting works on at once.
PART = 1 << 19

#: What each sign may stand for (fixed values of common disguises).
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "#": "h", "&": "a", "%": "o",
}
#: Costs of the channel (negative log probabilities).
STANDS, STAYS, DROPS, NOTHING, REPEATS, AGAIN = 1.0, 9.0, 6.0, 2.5, 0.7, 2.5

_EDGE = re.compile(r"^[^\w@$!|+(<&%#€£]+|[^\w@$!|+(<&%#€£]+$")
_MARKS = re.compile(r"^([^\w])\1\1+|([^\w])\2\2+$|^[!(<&#%]+(?=[^\W\d_]{2})|[!+(<&#%|]+$")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+](?=[ ._*~-]))(?:[ ._*~-]++[^\W_]|[ ._*~-]++[@$!|+](?=[ ._*~-])){2,}(?![^\W_])")
#: What every text with a match of _SPACED has too; searched first, as it is found faster.
_HINT = re.compile(r"[ ._*~-][^\s][ ._*~-]+[^\s](?![^\W_])")
_LETTERS = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"([^\W\d_])\1")
_ONCE = re.compile(r"(.)\1+")


def _symbol(c: int) -> int:
    if 97 <= c <= 122:
        return c - 96
    return 27 + c % (SYMBOLS - 27) if chr(c).isalpha() else 0


_TABLE = np.array([_symbol(c) if not 0xD800 <= c < 0xE000 else 0 for c in range(0x3000)], np.uint8)


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], 27 + codes % (SYMBOLS - 27)).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigrams of each batch: what is gathered grows with the texts."""
    for pdf in batches:
        total = np.zeros(SYMBOLS**3, np.int64)
        part, size = [], 0
        texts = [t for t in pdf["text"] if t]
        for k, t in enumerate(texts):
            for a in range(0, len(t), PART):
                part.append(t[max(0, a - 2) : a + PART])
                size += len(part[-1])
                if size >= PART:
                    total += _trigrams(part)
                    part, size = [], 0
            part.append("  ")
        if part:
            total += _trigrams(part)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at.astype(np.int32), "n": total[at]})


def _trigrams(part: list[str]) -> np.ndarray:
    s = symbols("  " + "".join(part))
    return np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)


def language_model(docs: DataFrame) -> np.ndarray:
    """cost[a, b, c]: negative log probability of c after a and b, counted over all texts (text)."""
    rows = docs.select("text").mapInPandas(_count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SYMBOLS**3)
    got = rows.toPandas()  # at most SYMBOLS ** 3 rows
    counts[got["gram"].to_numpy()] = got["n"].to_numpy(float)
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = three.sum(0) + 0.1
    back = two / two.sum(1, keepdims=True)
    p = (three + 8 * back[None]) / (three.sum(2, keepdims=True) + 8)
    return -np.log(p).astype(np.float32)


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """Readings of each place of a lower-case word, with their costs."""
    out = []
    for k, c in enumerate(word):
        again = k > 0 and word[k - 1] == c
        if c in LOOKS:
            here = [(x, STANDS + 0.2 * i) for i, x in enumerate(LOOKS[c])] + [("", AGAIN if again else DROPS)]
            here.append((c, STAYS))
        elif c.isalpha():
            here = [(c, 0.0)] if not again else [(c, AGAIN), ("", REPEATS)]
        else:
            here = [("", NOTHING), (c, STAYS)]
        out.append(here)
    return out


class Channel:
    """Viterbi decoding of character lattices under the trigram costs."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost.tolist()
        self.known = Remembered(REMEMBERED)

    def decode(self, word: str) -> str:
        cost = self.cost
        at: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for here in lattice(word):
            then: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (total, path) in at.items():
                for c, channel in here:
                    if c:
                        s = _symbol(ord(c)) if ord(c) < 0x3000 else 27 + ord(c) % (SYMBOLS - 27)
                        key, now, way = (b, s), total + channel + cost[a][b][s], (path, c)
                    else:
                        key, now, way = (a, b), total + channel, path
                    if key not in then or now < then[key][0]:
                        then[key] = (now, way)
            at = then
        _, path = min(((total + cost[a][b][0], path) for (a, b), (total, path) in at.items()), key=lambda x: x[0])
        out = []
        while path:
            path, c = path
            out.append(c)
        return "".join(reversed(out))

    def words(self, token: str) -> tuple[str, ...]:
        """The words that a lower-case token without white space stands for."""
        token = _MARKS.sub("", token)
        plain = _LETTERS.findall(token)
        bare = _EDGE.sub("", token)
        if bare.isalpha() and not _RUN.search(bare):
            return (bare,)
        if not any(c.isalpha() for c in bare):
            return tuple(plain)
        return (*plain, *_LETTERS.findall(self.decode(bare)))

    def restore(self, text: str | None) -> set[str]:
        """All distinct words of a text, disguised ones as restored."""
        if not text:
            return set()
        text = text.lower()
        out: set[str] = set()
        for token in set(text.split()):
            got = self.known[token]
            if got is None:
                got = self.known.put(token, self.words(token))
            out.update(got)
        for m in _SPACED.finditer(text) if _HINT.search(text) else ():
            out.update(_LETTERS.findall(self.decode(m[0])))
        return out


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


class Model:
    """Channel, features and weights; score() is a text's probability to be labelled toxic."""

    def __init__(self, cost: np.ndarray, weights: dict[str, float], bias: float):
        self.channel, self.weights, self.bias = Channel(cost), weights, bias
        # how words that have a feature begin: as they are, and with repeated letters once
        self.heads = {f.rstrip("*")[:4] for f in weights}
        self.once = {_ONCE.sub(r"\1", h) for h in self.heads}
        self.known = Remembered(REMEMBERED)

    def _own(self, token: str) -> tuple[str, ...]:
        got = self.known[token]
        if got is None:
            got = self.known.put(token, tuple({f for w in self.channel.words(token) for f in features(w) if f in self.weights}))
        return got

    def _may_begin(self, word: str) -> bool:
        """Whether a reading of a word of letters can begin like a feature: readings differ in how often letters are repeated."""
        if not _RUN.search(word):
            return False
        word, once = _ONCE.sub(r"\1", word), self.once
        return word[:4] in once or word[:3] in once or word[:2] in once or word[:1] in once

    def score(self, text: str | None) -> float:
        found: set[str] = set()
        if text:
            text = text.lower()
            heads, own_of = self.heads, self._own
            for token in set(text.split()):
                word = token.rstrip(".,;:")
                if word.isalpha() and word[:4] not in heads and not self._may_begin(word):
                    continue  # none of its readings has a feature
                if own := own_of(token):
                    found.update(own)
            for m in _SPACED.finditer(text) if _HINT.search(text) else ():
                for w in _LETTERS.findall(self.channel.decode(m[0])):
                    found.update(f for f in features(w) if f in self.weights)
        x = self.bias + sum(self.weights[f] for f in found)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def known_features(rows: list[tuple[int, list[str]]], among) -> Iterator[tuple[int, set[str]]]:
    """(label, features that are in among) of each row; what a word has is looked up once."""
    seen: dict[str, tuple[str, ...]] = {}
    for label, words in rows:
        out: set[str] = set()
        for w in words:
            own = seen.get(w)
            if own is None:
                own = seen[w] = tuple(f for f in features(w) if f in among)
            if own:
                out.update(own)
        yield label, out


def choose(rows: list[tuple[int, list[str]]]) -> list[str]:
    """The features that tell the labels best apart (G-squared), out of words and their beginnings."""
    n = Counter(label for label, _ in rows)
    toxic: Counter = Counter()
    for label, words in rows:
        if label:
            toxic.update({f for w in words for f in features(w)})
    toxic = Counter({f: c for f, c in toxic.items() if c >= 3})
    clean: Counter = Counter()
    for label, own in known_features(rows, toxic):
        if not label:
            clean.update(own)
    told = []
    for f, a in toxic.items():
        b = clean[f]
        p, q, r = a / n[1], b / max(1, n[0]), (a + b) / (n[0] + n[1])
        g = sum(k * math.log(x / y) for k, x, y in ((a, p, r), (n[1] - a, 1 - p, 1 - r), (b, q, r), (n[0] - b, 1 - q, 1 - r)) if k > 0 and x > 0 and y > 0)
        if g >= 12:
            told.append((g, f))
    return [f for _, f in sorted(told, reverse=True)[:FEATURES]]


def fit(rows: list[tuple[int, list[str]]], steps: int = 300, ridge: float = 0.5) -> tuple[dict[str, float], float]:
    """Weights and bias of a logistic regression on chosen features; rows: (label, restored words)."""
    n = Counter(label for label, _ in rows)
    if not n[0] or not n[1]:
        p = n[1] / max(1, n[0] + n[1])
        return {}, math.log(max(p, 1e-9) / max(1 - p, 1e-9))
    names = choose(rows)
    place = {f: k for k, f in enumerate(names)}
    own = [sorted(place[f] for f in found) for _, found in known_features(rows, place)]
    at, row = np.concatenate([np.array(x, np.int64) for x in own]) if own else np.empty(0, np.int64), np.repeat(np.arange(len(rows)), [len(x) for x in own])
    y = np.array([label for label, _ in rows], float)
    weight = np.where(y == 1, max(1.0, math.sqrt(n[0] / n[1])), 1.0)  # toxic rows are few
    w, bias = np.zeros(len(names)), math.log(n[1] / n[0])
    g2, b2 = np.full(len(names), 1e-6), 1e-6
    for _ in range(steps):  # AdaGrad over all rows at once
        z = bias + np.bincount(row, w[at], minlength=len(rows))
        d = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        g = np.bincount(at, d[row], minlength=len(names)) + ridge * w
        g2 += g * g
        w -= 0.3 * g / np.sqrt(g2)
        b2 += d.sum() ** 2
        bias -= 0.3 * d.sum() / math.sqrt(b2)
    return {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, float(bias)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. The sample of labelled rows is bounded, the character model counts all of docs."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    cost = language_model(docs)
    told = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    told = written(told, "labels", folder)
    share = min(1.0, TRAIN_ROWS / max(1, told.count()))
    told = hinted(written(told.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000), "sample", folder), BROADCAST_ROWS)
    shared = spark.sparkContext.broadcast(cost)

    def restored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel = Channel(shared.value)
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "words": [" ".join(sorted(channel.restore(t))) for t in pdf["text"]]})

    sample = docs.join(told, "doc_id").select("toxic", "text").mapInPandas(restored, "toxic int, words string").distinct()
    pool: dict[str, str] = {}  # a word of many texts is held once
    rows = [(int(r.toxic), [pool.setdefault(w, w) for w in r.words.split(" ")]) for r in sample.toLocalIterator()]
    rows.sort()
    return Model(cost, *fit(rows))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((np.array(model.channel.cost, np.float32), model.weights, model.bias))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for pdf in batches:
            score = [own.score(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": score, "predicted": [int(s >= 0.5) for s in score]})

    return by_rows(docs, run, "score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs, with all their columns, whose score is below one half."""
    model, at = train(columns(docs, doc_id=id_col, text=text_col), columns(labels, doc_id=id_col, toxic=label_col)), docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((np.array(model.channel.cost, np.float32), model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_rows(docs, run)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    docs, labels = columns(docs, doc_id=id_col, text=text_col), columns(labels, doc_id=id_col, toxic=label_col)
    return scored(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
