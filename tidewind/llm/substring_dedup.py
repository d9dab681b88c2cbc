"""Substring deduplication: removal of every 50-word window that starts in a document with a smaller identifier too.

The reference blocks are the non-overlapping blocks of half a window that begin at words 0, 25, 50 and so on of each document; the index
has each block's hash and the smallest identifier that it stands in. A window of 50 words holds one of them whole wherever it starts, so
every rolling block of every document is probed against the index: a probe hits if its block is a reference block of a document with a
smaller identifier. Hits are extended to the windows around them, which are compared by two independent 64-bit hashes of their words, and
runs of repeated windows make up the maximal repeats. Documents that are equal word for word are merged beforehand. Nothing is paired
within a group: each block or window hash is aggregated to the smallest identifier it stands in.

Probes that can't hit are left out before they are shuffled by a Bloom filter of the index, as long as that stays below BLOOM_BYTES;
beyond, all probes are shuffled. The result is the same.

Defined results: null and empty texts have no words; documents of fewer words than a window keep all of them; rows that share an
identifier count as one document, so they don't repeat each other; a null identifier is larger than all others (2^63 - 1 ranks with it);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_rows, columns, hinted, shared_dir, table, written
from .tokens import SECOND_BASE, mix, pieces, rolling, whole

WINDOW = 50
#: Up to so many identifiers are sent to every executor to thin a scan; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: A Bloom filter is made of segments of so many bits, each for SEGMENT_BLOCKS blocks on average, and has so many bytes at most.
SEGMENT_BITS, SEGMENT_BLOCKS, BLOOM_BYTES = 1 << 19, 40_000, 64 << 20
#: What a null identifier counts as.
LAST = (1 << 63) - 1


def _index(size: int):
    """doc, rev, n_words, digest (of all words) and the reference blocks of each document."""
    half = size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, digests, blocks = [], [], []
            for first, end, h, edges in pieces(batch.column("text")):
                rolled = mix(rolling(h, half)).view(np.int64)
                for k in range(end - first):
                    a, b = int(edges[k]), int(edges[k + 1])
                    n_words.append(b - a)
                    digests.append(hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest())
                    blocks.append(rolled[a : max(a, b - half + 1) : half] if b - a >= size else rolled[:0])
            edges = np.cumsum([0, *map(len, blocks)]).astype(np.int32)
            flat = np.concatenate(blocks) if blocks else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("rev"), pa.array(n_words, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], names=["doc", "rev", "n_words", "digest", "blocks"]
            )

    return run


def _bits(h: np.ndarray) -> list[np.ndarray]:
    """The places of a block's bits in its segment."""
    x = mix(h.view(np.uint64))
    return [((x >> np.uint64(19 * k)) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64) for k in range(3)]


def _segment(key: tuple, rows: pa.Table) -> pa.Table:
    bits = np.zeros(SEGMENT_BITS, np.uint8)
    h = rows.column("block").to_numpy()
    for at in _bits(h):
        bits[at] = 1
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def bloom(index: DataFrame, most: int = BLOOM_BYTES) -> np.ndarray | None:
    """A Bloom filter of index (block), a row of bytes for each segment; None if it would take more than so many bytes."""
    segments = max(1, index.count() // SEGMENT_BLOCKS)
    if segments * SEGMENT_BITS // 8 > most:
        return None
    dealt = index.select("block", F.pmod("block", F.lit(segments)).alias("segment"))
    out = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for r in dealt.groupBy("segment").applyInArrow(_segment, "segment long, bits binary").toLocalIterator():
        out[r.segment] = np.frombuffer(r.bits, np.uint8)
    return out


def may_hold(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the blocks h may be in the index."""
    row = h % len(filter_)
    ok = np.ones(len(h), bool)
    for at in _bits(h):
        ok &= (filter_[row, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


def _probes(size: int, shared):
    """doc, rev, block: the distinct rolling blocks of each document that may be in the index."""
    half = size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = shared.value if shared is not None else None
        for batch in batches:
            docs, revs = batch.column("doc"), batch.column("rev")
            for first, end, h, edges in pieces(batch.column("text")):
                rolled = mix(rolling(h, half)).view(np.int64)
                ok = whole(edges, half, len(rolled)) & (may_hold(filter_, rolled) if filter_ is not None else True)
                own, rows = [], []
                for k in range(end - first):
                    a, b = int(edges[k]), int(edges[k + 1])
                    if b - a >= size:
                        own.append(np.unique(rolled[a : b - half + 1][ok[a : b - half + 1]]))
                        rows.append(np.full(len(own[-1]), first + k))
                if own:
                    rows = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([docs.take(rows), revs.take(rows), pa.array(np.concatenate(own))], names=["doc", "rev", "block"])

    return run


def _windows(size: int):
    """doc, rev, h1, h2 of each distinct window that holds one of the document's live blocks, at (its first place), more (others, if any)."""
    half = size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, revs, live = batch.column("doc"), batch.column("rev"), batch.column("live")
            for (first, end, h, edges), (_, _, g, _) in zip(pieces(batch.column("text")), pieces(batch.column("text"), kind=1), strict=True):
                rolled = mix(rolling(h, half)).view(np.int64)
                one, two = mix(rolling(h, size)).view(np.int64), mix(rolling(g, size, SECOND_BASE)).view(np.int64)
                for k in range(end - first):
                    a, b = int(edges[k]), int(edges[k + 1]) - size + 1
                    if b <= a:
                        continue
                    hit = np.flatnonzero(np.isin(rolled[a : b + size - half], live[first + k].values.to_numpy()))
                    edge = np.zeros(b - a + size + 1, np.int32)  # starts of the windows that hold a hit
                    np.add.at(edge, np.maximum(hit - (size - half), 0), 1)
                    np.add.at(edge, hit + 1, -1)
                    at = np.flatnonzero(np.cumsum(edge)[: b - a] > 0)
                    if len(at):
                        x, y = one[a:b][at], two[a:b][at]
                        order = np.lexsort((at, y, x))  # a window that a document repeats is one row
                        x, y, at = x[order], y[order], at[order].astype(np.int32)
                        begin = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
                        end_of = np.append(begin[1:], len(at))
                        more = pa.array([at[i + 1 : j] if j - i > 1 else None for i, j in zip(begin.tolist(), end_of.tolist(), strict=True)], pa.list_(pa.int32()))
                        doc, rev = (pa.array(np.full(len(begin), c[first + k].as_py()), c.type) for c in (docs, revs))
                        yield pa.RecordBatch.from_arrays([doc, rev, pa.array(at[begin]), more, pa.array(x[begin]), pa.array(y[begin])], names=["doc", "rev", "at", "more", "h1", "h2"])

    return run


def repeats(docs: DataFrame, size: int = WINDOW, bloom_bytes: int = BLOOM_BYTES) -> tuple[DataFrame, DataFrame]:
    """(doc, rev of documents whose words are all those of a smaller one), (doc, rev, starts of repeated windows).

    docs: doc (long, not null), rev (long; tells rows of one identifier apart), text."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    shape = "doc long, rev long, n_words long, digest binary, blocks array<long>"
    blocks = written(docs.mapInArrow(_index(size), shape), "blocks", folder).where(F.col("n_words") >= size)
    owners = written(blocks.groupBy("digest").agg(F.min("doc").alias("owner")), "owners", folder)
    owned = blocks.join(owners, "digest")
    equal = written(owned.where("doc > owner").select("doc", "rev").distinct(), "equal", folder)
    # one document of each group of equal ones goes on
    index = owned.where("doc = owner").select("doc", F.explode("blocks").alias("block")).groupBy("block").agg(F.min("doc").alias("low"))
    index = written(index, "index", folder)
    filter_ = bloom(index, bloom_bytes)
    shared = spark.sparkContext.broadcast(filter_) if filter_ is not None else None
    probed = docs.join(hinted(equal, BROADCAST_ROWS), ["doc", "rev"], "left_anti").select("doc", "rev", "text")
    probes = written(probed.mapInArrow(_probes(size, shared), "doc long, rev long, block long"), "probes", folder)
    if shared is not None:
        shared.destroy()
    hits = written(probes.join(index, "block").where("doc > low").select("block").distinct(), "hits", folder)
    live = written(probes.join(hits, "block", "left_semi").groupBy("doc", "rev").agg(F.collect_set("block").alias("live")), "live", folder)
    found = docs.join(hinted(live.select("doc", "rev"), BROADCAST_ROWS), ["doc", "rev"], "left_semi").join(live, ["doc", "rev"])
    windows = written(found.select("doc", "rev", "text", "live").mapInArrow(_windows(size), "doc long, rev long, at int, more array<int>, h1 long, h2 long"), "windows", folder)
    least = windows.groupBy("h1", "h2").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    # as a table of its own, so that the join's other side can be split where a window is very common
    least = written(least.select("h1", "h2", "low"), "least", folder)
    again = windows.join(least, ["h1", "h2"]).where("doc > low")
    starts = F.array_sort(F.array_union(F.collect_set("at"), F.flatten(F.collect_list("more"))))
    starts = written(again.groupBy("doc", "rev").agg(starts.alias("starts")), "starts", folder)
    return equal, starts


def removed(n: int, starts, size: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of starts."""
    edge = np.zeros(n + 1, np.int32)
    at = np.asarray(starts, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + size, n), -1)
    return np.cumsum(edge[:n]) > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, bloom_bytes: int = BLOOM_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, removed (ranges of words, end exclusive), text (kept words joined by one space)."""
    rows = columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "rev": F.xxhash64("text")})
    equal, starts = repeats(rows.select("doc", "rev", "text"), size, bloom_bytes)
    gone = equal.withColumn("all", F.lit(True)).join(starts, ["doc", "rev"], "full_outer")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n_words, n_removed, ranges, kept = [], [], [], []
            for text, at, whole in zip(pdf["text"], pdf["starts"], pdf["all"], strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                n = len(words)
                if whole is True:
                    spans, keep = [(0, n)], []
                elif at is not None:
                    out = removed(n, at, size)
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], out.view(np.int8), [0]))))
                    spans, keep = edge.reshape(-1, 2).tolist(), [w for w, gone in zip(words, out, strict=True) if not gone]
                else:
                    spans, keep = [], words
                n_words.append(n)
                n_removed.append(n - len(keep))
                ranges.append([{"start": a, "end": b} for a, b in spans])
                kept.append(b" ".join(keep).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": n_words, "n_removed": n_removed, "removed": ranges, "text": kept})

    joined = rows.join(gone, ["doc", "rev"], "left").select("doc_id", "text", "starts", "all")
    return by_rows(joined, run, "n_words long, n_removed long, removed array<struct<start: int, end: int>>, text string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT win, min(doc_id) AS low FROM s GROUP BY win HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM s JOIN f USING (win) WHERE doc_id > low),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM g)),
k AS (SELECT p.doc_id, count(g.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.p) FILTER (g.p IS NULL), '') AS kept
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.p = g.p GROUP BY p.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, array_to_string(w, ' '))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
