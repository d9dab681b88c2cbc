"""Spelling variants of the words of a corpus, grouped by full neighbourhood generation.

Words are maximal runs of letters, counted over all documents by aggregation. For each word of the vocabulary all distinct deletions,
replacements and insertions over the alphabet that the vocabulary uses are made, as rolling hashes in numpy: a candidate costs a few
operations on the hashes of the word's prefixes and suffixes. Candidates that a Bloom filter of the vocabulary excludes end there; the others
are written out and hash-joined with the vocabulary. What joins differs by exactly one edit by the way it was made, so no distance is
computed. A word's form is its near word of largest count, if that is RATIO times the word's own; roots are found by pointer jumping, in as
many rounds as counts that grow by RATIO with each step allow.

The Bloom filter has BITS bits for each word and FILTER_BYTES at most; a fuller filter lets more candidates through to the join, which
decides alone.

Defined results: null and empty texts have no words; rows with equal identifiers are counted each for itself; a null identifier counts
as an empty text where words are altered; words of any length are taken whole; ties of forms go to the smallest word in code-point order;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, shared_dir, table, written
from .tokens import mix

#: Code points that a word has at least, and its occurrences.
SHORTEST, LEAST = 7, 2
#: How much more frequent a form must be than its variant.
RATIO = 10
#: Of the runs of so many pairs of a document and a run, one on average loses a code point.
ALTERED = 31
#: Bits of the filter for each word, in segments of so many bits, probes of a word, and bytes of the filter at most.
BITS, SEGMENT_BITS, PROBES, FILTER_BYTES = 32, 1 << 19, 4, 64 << 20
#: Candidates that are made at once.
AT_ONCE = 1 << 20

_BASE = np.uint64(0xD6E8FEB86659FD93)
_VALUE = np.uint64(0x9E3779B97F4A7C15)


def run_pattern(shortest: int = 1) -> re.Pattern:
    """Maximal runs of letters of so many code points at least."""
    return re.compile("[A-Za-zÀ-ÿ]{%d,}" % shortest)


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, every: int | None = ALTERED) -> DataFrame:
    """word, n: the words of docs (doc_id, text) with so many code points and occurrences at least. every: None alters nothing."""
    runs = run_pattern(shortest)  # a run only gets shorter, so shorter ones make no word

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: Counter = Counter()
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    found = Counter(runs.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))  # A to Z alone
                    if every is None:
                        own.update(found)
                        continue
                    start = zlib.crc32(f"{doc or ''}:".encode())
                    for run, n in found.items():
                        h = zlib.crc32(run.encode(), start)
                        if h % every == 0:
                            if len(run) == shortest:
                                continue
                            k = h % len(run)
                            run = run[:k] + run[k + 1 :]
                        own[run] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where("text IS NOT NULL")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def code_points(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def _values(points: np.ndarray) -> np.ndarray:
    return mix((points.astype(np.uint64) + np.uint64(1)) * _VALUE)


def hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word: the sum of its code points' values times powers of their places."""
    out = np.zeros(len(words), np.uint64)
    for n, at in _by_length(words):
        out[at] = _finished(_polynomial(_values(code_points([words[k] for k in at]))), n)
    return out


def _finished(h: np.ndarray, length: int) -> np.ndarray:
    return mix(h + np.uint64(length * int(_VALUE) % (1 << 64)))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.array([1] + [int(_BASE)] * n, np.uint64))


def _polynomial(v: np.ndarray) -> np.ndarray:
    return (v * _powers(v.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        yield int(n), np.flatnonzero(lengths == n)


def neighbours(words: list[str], alphabet: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(edit, hashes, word, place, letter) of all distinct deletions, replacements and insertions, in blocks of some AT_ONCE candidates.

    Equal code points side by side give one deletion, the one of the first; a letter is inserted behind an equal one only, not before it."""
    letters, size = _values(alphabet), len(alphabet)
    for n, members in _by_length(words):
        step = max(1, AT_ONCE // ((2 * n + 1) * size + n))
        for a in range(0, len(members), step):
            at = members[a : a + step]
            points = code_points([words[k] for k in at])
            v, power = _values(points), _powers(n + 1)
            terms = v * power[:n]
            before = np.concatenate([np.zeros((len(at), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)  # of the first k
            whole = before[:, -1:]
            same = points[:, 1:] == points[:, :-1]
            # a place's suffix moves down by one power when something before it goes, up by one when something comes
            down = np.concatenate([np.cumsum((v[:, 1:] * power[: n - 1])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1], np.zeros((len(at), 1), np.uint64)], axis=1) if n > 1 else np.zeros((len(at), 1), np.uint64)
            keep = np.concatenate([np.ones((len(at), 1), bool), ~same], axis=1)
            w, p = np.nonzero(keep)
            yield "delete", _finished((before[:, :n] + down)[w, p], n - 1), at[w], p, np.zeros(len(w), np.int64)
            rest = whole - terms
            up = np.concatenate([np.cumsum((v * power[1 : n + 1])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1], np.zeros((len(at), 1), np.uint64)], axis=1)
            places = max(1, AT_ONCE // (size * len(at)))
            for lo in range(0, n + 1, places):
                own, of = points[:, lo : lo + places], np.arange(lo, min(lo + places, n))
                other = own[:, :, None] != alphabet[None, None, :]
                h = _finished(rest[:, of][:, :, None] + letters[None, None, :] * power[of][None, :, None], n)
                w, p, c = np.nonzero(other)
                yield "replace", h[w, p, c], at[w], p + lo, c
                of = np.arange(lo, min(lo + places, n + 1))
                new = np.ones((len(at), len(of), size), bool)
                new[:, : own.shape[1]] = other
                h = _finished((before + up)[:, of][:, :, None] + letters[None, None, :] * power[of][None, :, None], n + 1)
                w, p, c = np.nonzero(new)
                yield "insert", h[w, p, c], at[w], p + lo, c


def edited(word: str, edit: str, place: int, letter: str) -> str:
    return word[:place] + ("" if edit == "delete" else letter) + word[place + (edit != "insert") :]


def _probe(x: np.ndarray, k: int) -> np.ndarray:
    """The place of a hash's bit in its segment."""
    return ((mix(x + np.uint64((k + 1) * int(_VALUE) % (1 << 64))) >> np.uint64(20)) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64)


def _segment(key: tuple, rows: pa.Table) -> pa.Table:
    bits = np.zeros(SEGMENT_BITS, np.uint8)
    h = rows.column("h").to_numpy().view(np.uint64)
    for k in range(PROBES):
        bits[_probe(h, k)] = 1
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def word_filter(words: DataFrame, n_words: int, most: int = FILTER_BYTES) -> np.ndarray:
    """A Bloom filter of words (word), a row of bytes for each segment."""
    segments = max(1, min(most * 8 // SEGMENT_BITS, -(-n_words * BITS // SEGMENT_BITS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hashes(batch.column("word").to_pylist()).view(np.int64))], names=["h"])

    dealt = words.select("word").mapInArrow(run, "h long").withColumn("segment", F.pmod("h", F.lit(segments)))
    out = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for r in dealt.groupBy("segment").applyInArrow(_segment, "segment long, bits binary").toLocalIterator():
        out[r.segment] = np.frombuffer(r.bits, np.uint8)
    return out


def passing(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places of those hashes that may be words."""
    at = np.arange(len(h))
    for k in range(PROBES):
        x = h[at]
        row, bit = x.view(np.int64) % len(filter_), _probe(x, k)
        at = at[(filter_[row, bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)]
    return at


def near_words(words: DataFrame, n_words: int) -> DataFrame:
    """word, near, m: all pairs of words (word, n) that differ by one edit, in both orders, with the count of the near one."""
    spark = words.sparkSession
    points = words.select(F.explode(F.split("word", "")).alias("c")).distinct().select(F.ascii("c").alias("c")).collect()  # an alphabet
    alphabet = np.array(sorted(r.c for r in points), np.uint32)
    shared = spark.sparkContext.broadcast((word_filter(words, n_words), alphabet))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, alphabet = shared.value
        letters = [chr(c) for c in alphabet]
        for batch in batches:
            own = batch.column("word").to_pylist()
            for edit, h, word, place, letter in neighbours(own, alphabet):
                ok = passing(filter_, h)
                made = [(own[w], edited(own[w], edit, p, letters[c])) for w, p, c in zip(word[ok].tolist(), place[ok].tolist(), letter[ok].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in made], pa.string()), pa.array([c for _, c in made], pa.string())], names=["word", "near"])

    candidates = words.select("word").mapInArrow(run, "word string, near string")
    return candidates.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near").select("word", "near", "m")


def rooted(forms: DataFrame, most: int, ratio: int, folder: str) -> DataFrame:
    """word, root: forms (word, form) followed to the last, for counts of most at most. Each round doubles the steps."""
    steps, now = max(1, math.ceil(math.log(max(2, most), ratio))), forms.select("word", F.col("form").alias("root"))
    for k in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        now = written(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")), f"roots{k}", folder)
    return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, every: int | None = ALTERED) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of the documents."""
    folder = shared_dir(docs.sparkSession)
    words = written(vocabulary(columns(docs, doc_id=id_col, text=text_col), shortest, least, every), "words", folder)
    size = words.agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("most")).first()
    near = near_words(words, size.words)
    # the largest count first, then the smallest word
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    form = F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best.near"))
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.m")).alias("form_n")), "near", folder)
    roots = rooted(found.where("form IS NOT NULL"), size.most or 1, ratio, folder)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM runs, crc_table WHERE length(run) >= 7),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM summed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
cut AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
gone AS (SELECT DISTINCT word, n, a || b AS rest FROM cut),
near AS (
  SELECT x.word, y.word AS near, y.n AS m FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT g.word, w.word, w.n FROM gone g JOIN words w ON w.word = g.rest
  UNION ALL SELECT w.word, g.word, g.n FROM gone g JOIN words w ON w.word = g.rest),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, (list(near ORDER BY m DESC, near))[1] AS near FROM near GROUP BY word),
found AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN near END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
roots AS (
  SELECT word, word AS root, 0 AS k FROM found
  UNION ALL SELECT r.word, f.form, k + 1 FROM roots r JOIN found f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM found JOIN (SELECT word, arg_max(root, k) AS root FROM roots GROUP BY word) USING (word)
"""
OP11_SQL = OP11_SQL.replace("WITH crc_table", "WITH RECURSIVE crc_table", 1)
