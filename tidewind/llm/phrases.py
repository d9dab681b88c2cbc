"""Phrases of two to five words that stand together more often than their parts' counts let expect, for each language.

First pass: each task counts the hashes of all runs of one to five words in a count-min sketch of its own; the sketches are merged by
aggregation. A cell never holds less than the runs that fall into it, so each run's least cell overestimates its count. Second pass: runs
whose estimate reaches min_count, and whose shorter runs do, are written out with their texts and counted exactly by aggregation, so
nothing frequent is lost. Then phrases are scored by their lowest-scoring cut, by joins with the counts of their parts, and those that stand
in a longer phrase as often as anywhere are subsumed.

The sketch has two rows of 2**16 to 2**29 cells, more for more text, and cells as wide as min_count needs (they stay at the largest value
that they can hold). A task counts 2**27 cells of a row at most, so beyond some 8 GB of text the first pass goes over the text once for each
slice of so many cells. Of the merged cells only whether they reach min_count is kept, a bit for each. A sketch that is full for the text lets
more runs through to the exact count; the result is the same.

Defined results: null and empty texts have no words; a null language counts as und; rows with equal identifiers count each for itself; a
phrase's words are joined by one space whatever stands between them; words of any length and texts without any end of a sentence are
taken whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, shared_dir, table, written
from .tokens import _BASE, _LOWER, _VALUES, _weights, mix

#: Words of a phrase at most, its occurrences at least, and phrases of a language in the report.
LONGEST, MIN_COUNT, TOP = 5, 100, 2_000
#: What ends a piece, and what stands between words besides (fixed values of the contract).
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Runs for each cell of a row that the sketch is made for, and the powers of two that a row's cells are between.
LOAD, SMALLEST, LARGEST = 32, 16, 29
#: Cells of a row that a task counts at most, as a power of two.
SLICE = 27
#: Cells of a block of the sketch.
BLOCK = 1 << 16
#: Tasks of the first pass are so many times fewer than would write as many bytes of sketches as there are of text.
SHARE = 4
#: Bytes of text that are worked on at once; a longer text is taken in parts.
PART = 1 << 21

_END, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_END[list(ENDS)] = True
_BLANK[list(ENDS + BLANKS)] = True
_WORD = re.compile(rb"[^ \t.,;:!?\n\x0b\x0c\r]+")
#: What the hash of a run of so many words begins with.
_SALT = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class Words:
    """The words of a buffer of lower-cased text: where they begin and end, their hashes, and a number for the piece of each."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray):
        """starts: where documents begin."""
        self.buf = _LOWER[buf]
        inside = ~_BLANK[self.buf]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        border = _END[self.buf]
        cut = starts[starts < len(buf)]
        first[cut] |= inside[cut]
        at = np.flatnonzero(inside)
        begin = np.flatnonzero(first[at])
        lengths = np.diff(np.append(begin, len(at)))
        self.begin = at[begin]
        self.end = self.begin + lengths
        if len(at):
            offset = np.arange(len(at)) - np.repeat(begin, lengths)
            sums = np.add.reduceat(_VALUES[0][self.buf[at]] * _weights(offset, 0), begin)
            self.hash = mix(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        else:
            self.hash = np.empty(0, np.uint64)
        self.doc = np.searchsorted(starts, self.begin, "right") - 1
        self.piece = np.cumsum(border, dtype=np.int64)[self.begin] + self.doc if len(at) else np.empty(0, np.int64)

    def runs(self, longest: int, salt: np.ndarray, own: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, hashes, whole) of the runs of n words that begin at the first own words; whole: which of them stay in a piece. salt: of each word's language."""
        h = np.zeros(len(self.hash), np.uint64)
        for n in range(1, longest + 1):
            m = max(0, len(self.hash) - n + 1)
            h = h[:m] * np.uint64(_BASE) + self.hash[n - 1 :][:m]
            k = min(m, own)
            yield n, mix(h[:k] ^ salt[:k] ^ _SALT[n]), self.piece[:k] == self.piece[n - 1 : n - 1 + k]

    def text(self, k: int, n: int) -> str:
        return b" ".join(self.buf[self.begin[i] : self.end[i]].tobytes() for i in range(k, k + n)).decode("utf-8", "replace")


def parts(texts: pa.Array, longest: int) -> Iterator[tuple[int, Words, int]]:
    """(first row, words, own) for groups of rows; row first + words.doc. Of a text that is taken in parts, each part ends some words after the next one's begin, and only its first own words count."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and offsets[-1] else np.empty(0, np.uint8)
    k = 0
    while k < n:
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + PART, "right")) - 1)
        buf = data[offsets[k] : offsets[end]]
        if end == k + 1 and len(buf) > PART:
            raw, a = buf.tobytes(), 0
            while a < len(raw):
                b = a + PART
                if b < len(raw):
                    while b < len(raw) and not _BLANK[raw[b]]:
                        b += 1
                    after = [m.end() for _, m in zip(range(longest - 1), _WORD.finditer(raw, b), strict=False)]
                    words = Words(buf[a : after[-1] if after else len(raw)], np.zeros(1, np.int64))
                    yield k, words, int(np.searchsorted(words.begin, b - a))
                else:
                    words = Words(buf[a:], np.zeros(1, np.int64))
                    yield k, words, len(words.begin)
                a = b
        else:
            words = Words(buf, (offsets[k:end] - offsets[k]).astype(np.int64))
            yield k, words, len(words.begin)
        k = end


def _salts(langs: list[str]) -> np.ndarray:
    return mix(np.array([zlib.crc32(x.encode()) | zlib.adler32(x.encode()) << 32 for x in langs], np.uint64)) if langs else np.empty(0, np.uint64)


class Sketch:
    """Two rows of bits: which cells reach least. Cells were counted as numbers of kind that don't pass their largest value."""

    def __init__(self, power: int, kind: str, least: int, bits: np.ndarray):
        self.power, self.kind, self.least, self.bits = power, kind, least, bits

    def estimate(self, h: np.ndarray) -> np.ndarray:
        """No less than the occurrences of the runs with these hashes: below least, or the largest value."""
        reach = np.ones(len(h), bool)
        for row, x in zip(self.bits, _cells(h, self.power), strict=True):
            reach &= (row[x >> np.uint32(3)] << (x & np.uint32(7)).astype(np.uint8) & np.uint8(128)).astype(bool)
        return np.where(reach, np.iinfo(self.kind).max, self.least - 1)


def _cells(h: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each hash in both rows."""
    mask = np.uint64((1 << power) - 1)
    return (h & mask).astype(np.uint32), ((h >> np.uint64(32)) & mask).astype(np.uint32)


def sketch_power(n_bytes: int) -> int:
    """Of so many bytes of text: cells of a row, as a power of two. Some half of a run of words for each byte."""
    return min(LARGEST, max(SMALLEST, (n_bytes // (2 * LOAD)).bit_length()))


def sketched(docs: DataFrame, longest: int, min_count: int, folder: str) -> Sketch:
    """The merged sketch of docs (lang, text)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    power, kind = sketch_power(size), "u1" if min_count < 1 << 8 else "u2" if min_count < 1 << 16 else "u4"
    top, width = np.iinfo(kind).max, min(power, SLICE)

    def count(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = np.zeros((2, 1 << width), kind)
            for batch in batches:
                salts = _salts(batch.column("lang").to_pylist())
                for first, words, own in parts(batch.column("text"), longest):
                    h = np.concatenate([h[whole] for _, h, whole in words.runs(longest, salts[first + words.doc], own)])
                    for row, x in zip(cells, _cells(h, power), strict=True):
                        if width < power:
                            x = x[x >> np.uint32(width) == number] & np.uint32((1 << width) - 1)
                        x = np.sort(x)
                        begin = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, int)
                        at = x[begin]
                        row[at] = np.minimum(row[at] + np.diff(np.append(begin, len(x))), top)
            blocks = cells.reshape(-1, BLOCK)
            some = np.flatnonzero([own.any() for own in blocks])
            half = len(blocks) // 2
            for a in range(0, len(some), 64):
                at = some[a : a + 64]
                place = (at // half * (1 << power - width) + number) * half + at % half  # rows one after the other, slices within
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array([zlib.compress(blocks[k].tobytes(), 1) for k in at], pa.binary())], names=["block", "cells"])

        return run

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.uint64)
        for x in rows.column("cells").to_pylist():
            total += np.frombuffer(zlib.decompress(x), kind)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "cells": pa.array([zlib.compress(np.packbits(total >= min_count).tobytes(), 1)], pa.binary())})

    bytes_ = 2 * np.dtype(kind).itemsize << width
    tasks = max(2 * spark.sparkContext.defaultParallelism, size // (SHARE * bytes_))
    counted = [docs.coalesce(tasks).mapInArrow(count(number), "block long, cells binary") for number in range(1 << power - width)]
    found = functools.reduce(DataFrame.unionByName, counted).groupBy("block").applyInArrow(merge, "block long, cells binary")
    out = np.zeros((2 << power) // BLOCK * BLOCK // 8, np.uint8).reshape(-1, BLOCK // 8)
    for r in written(found, "sketch", folder).toLocalIterator():  # 2**30 bits at most
        out[r.block] = np.frombuffer(zlib.decompress(r.cells), np.uint8)
    return Sketch(power, kind, min_count, out.reshape(2, -1))


def frequent(docs: DataFrame, sketch: Sketch, longest: int, min_count: int) -> DataFrame:
    """lang, phrase, k (its words), f: the exact counts of all runs of words that stand min_count times at least in docs (lang, text); a null phrase of 0 words counts all words of a language."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            salts = _salts(langs)
            for first, words, own in parts(batch.column("text"), longest):
                names, phrases, sizes, counts = [], [], [], []
                doc, n = np.unique(words.doc[:own], return_counts=True)
                for d, c in zip(doc.tolist(), n.tolist(), strict=True):
                    names.append(langs[first + d]), phrases.append(None), sizes.append(0), counts.append(c)
                alive = None
                for k, h, whole in words.runs(longest, salts[first + words.doc], len(words.begin)):
                    if alive is not None:  # both runs of one word less may be frequent
                        whole &= alive[: len(whole)] & alive[1 : 1 + len(whole)]
                    at = np.flatnonzero(whole)
                    at = at[sketch.estimate(h[at]) >= min_count]
                    alive = np.zeros(len(whole), bool)
                    alive[at] = True
                    at = at[at < own]
                    _, place, c = np.unique(h[at], return_index=True, return_counts=True)
                    for p in at[place].tolist():
                        names.append(langs[first + words.doc[p]]), phrases.append(words.text(p, k)), sizes.append(k)
                    counts += c.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(phrases, pa.string()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())], names=["lang", "phrase", "k", "f"])

    rows = docs.mapInArrow(count, "lang string, phrase string, k int, f long")
    return rows.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where((F.col("f") >= min_count) | (F.col("k") == 0))


def _big(name: str) -> Column:
    """Counts of up to 13 digits, so that the products of three stay exact."""
    return F.col(name).cast("decimal(13,0)")


def scored(counts: DataFrame, totals: DataFrame, folder: str) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of the phrases among counts (lang, phrase, k, f), by the lowest-scoring cut, the first of several."""
    words = F.split("phrase", " ", -1)
    cut = lambda i: F.struct(i.alias("cut"), F.array_join(F.slice("w", F.lit(1), i), " ").alias("first"), F.array_join(F.slice("w", i + 1, F.col("k") - i), " ").alias("rest"))
    cuts = counts.where("k > 1").withColumn("w", words).select("lang", "phrase", "k", F.col("f").alias("a"), F.inline(F.transform(F.sequence(F.lit(1), F.col("k") - 1), cut)))
    one = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    both = cuts.join(one("first", "l"), ["lang", "first"]).join(one("rest", "r"), ["lang", "rest"])
    both = both.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    both = both.withColumns({"top": F.lit(1000).cast("decimal(4,0)") * _big("a") * _big("n"), "below": _big("l") * _big("r")})
    both = both.withColumn("score", F.expr("CAST(top DIV below AS BIGINT)"))
    return written(both.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "phrase", "k", "a", "b.l", "b.r", "n", "b.score"), "scored", folder)


def subsumed(phrases: DataFrame) -> DataFrame:
    """phrases (lang, phrase, k, a) without those of which a longer one that holds them has as many occurrences.

    A phrase stands in a longer one at most as often as in one of one word more, so the two ends of each phrase do."""
    w = F.split("phrase", " ", -1)
    ends = F.array(F.array_join(F.slice(w, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("k") - 1), " "))
    longer = phrases.where("k > 2").select("lang", F.explode(ends).alias("phrase"), F.col("a").alias("most")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    return phrases.join(longer, ["lang", "phrase"], "left").where("most IS NULL OR most < a").drop("most")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    folder = shared_dir(docs.sparkSession)
    docs = columns(docs, text=text_col, lang=lang_col).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
    counts = written(frequent(docs, sketched(docs, longest, min_count, folder), longest, min_count), "counts", folder)
    phrases = subsumed(scored(counts.where("k > 0"), counts.where("k = 0").select("lang", F.col("f").alias("n")), folder))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return phrases.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents WHERE text IS NOT NULL),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k))
  GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
scores AS (
  SELECT c.lang, c.phrase, c.k, a, cut, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ') JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(f) AS most
  FROM (SELECT lang, f, w, i, unnest(range(i + 1, len(w) + 1)) AS j FROM (SELECT lang, f, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS i FROM f WHERE k > 2))
  WHERE j - i + 1 < len(w) GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT b.lang, b.phrase, a, l, r, n, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE most IS NULL OR 100 * most < 100 * a)
WHERE rank <= 2000
"""
