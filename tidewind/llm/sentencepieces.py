"""SentencePiece encoding and decoding by a table of distinct chunks.

A chunk is a word with the white-space markers before it. Where no piece of a model holds a marker behind another character, no merge
crosses the border of a chunk, so each chunk is segmented on its own and a text's ids are those of its chunks, in order.

All chunks are counted by aggregation. Those that stand in the documents more than once make up the table and are segmented once, in tasks;
a chunk that stands there once is segmented where it stands. The most frequent entries of the table, up to TABLE_BYTES, are sent to every
executor (20 bytes for each, and 2 or 4 for each id) and joined back by position there. If the table has more entries, the chunks of each
distinct text that are not among those are joined with it by shuffles, and what a text needs comes to it as a map. Both ways give the
same ids.

Defined results: a null text is empty; an empty text has the end id alone and decodes to an empty text; U+2581 counts as a space, as it does
in the library; very long chunks are chunks like others; rows with equal identifiers are encoded each for itself; a null identifier stays
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_rows, columns, shared_dir, table, written

#: What a space becomes (a fixed value of the format).
MARK = "▁"
#: Bytes of the part of the table that goes to every executor.
TABLE_BYTES = 128 << 20
#: Characters of text of which the chunks are worked on at once; a longer text is worked on alone.
PART = 4 << 20
#: Bytes of an entry besides its ids: two hashes, and where its ids end.
ENTRY = 20

#: The last model that a worker read.
_MODELS: dict = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model_of(path: str):
    import sentencepiece

    if path not in _MODELS:
        _MODELS.clear()
        _MODELS[path] = checked(sentencepiece.SentencePieceProcessor(model_file=path))
    return _MODELS[path]


def checked(model):
    """The model, if its chunks can be segmented on their own; an error says why not."""
    n = model.get_piece_size()
    if any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(n)):
        raise ValueError("a piece of the model crosses a white-space marker")
    odd = "  x\tﬁ Ａ Éİ\r\n  y "
    if model.normalize(odd) != MARK + odd.replace(" ", MARK):
        raise ValueError("the model changes texts other than by marking their spaces")
    if model.piece_to_id(MARK) == model.unk_id() or model.eos_id() < 0:
        raise ValueError("the model has no piece for a marker alone, or no end id")
    return model


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without the first of its markers and with spaces for the others."""
    if not text:
        return []
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return words
    out, spaces = [], 0
    for w in words:
        if w:
            out.append(" " * spaces + w)
            spaces = 0
        else:
            spaces += 1
    if spaces:
        out.append(" " * (spaces - 1))
    return out


def segmented(model, own: list[str]) -> list[list[int]]:
    """The ids of each chunk: the library puts the first marker before it."""
    alone = [model.piece_to_id(MARK)]
    return [ids if c else alone for c, ids in zip(own, model.encode(own, num_threads=1), strict=True)] if own else []


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > PART:
            yield first, k
            first, held = k, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)


def chunk_table(docs: DataFrame, path: str) -> DataFrame:
    """chunk, n, digest, ids (2 or 4 bytes each) of the chunks that docs (text) hold more than once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            for a, b in _parts(texts):
                own: Counter = Counter()
                for t in texts[a:b]:
                    own.update(chunks(t))
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["chunk", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        kind = width(model)
        for batch in batches:
            own = batch.column("chunk").to_pylist()
            ids = pa.array([np.array(x, kind).tobytes() for x in segmented(model, own)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("n"), pa.array([digest(c) for c in own], pa.binary()), ids], names=["chunk", "n", "digest", "ids"])

    counted = docs.select("text").mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    return counted.where("n > 1").mapInArrow(encode, "chunk string, n long, digest binary, ids binary")


def width(model) -> str:
    return "<u2" if model.get_piece_size() <= 1 << 16 else "<u4"


def digest(chunk: str) -> bytes:
    return xxhash.xxh3_128_digest(chunk.encode("utf-8", "surrogatepass"))


def halves(digests: bytes) -> np.ndarray:
    """The two 64-bit halves of each digest."""
    return np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64)


class Frequent:
    """The entries that every task has, in arrays sorted by digest. ids: of all entries one after the other, edges: where each one's begin and the last one's end."""

    def __init__(self, digests: bytes, ids: np.ndarray, edges: np.ndarray):
        d = halves(digests)
        order = np.argsort(d[:, 0], kind="stable")
        self.h, self.g = d[order, 0], d[order, 1]
        sizes = np.diff(edges)[order]
        self.edges = np.append(0, np.cumsum(sizes)).astype(np.int64 if edges[-1] >= 1 << 31 else np.int32)
        self.ids = ids[np.arange(len(ids)) - np.repeat(self.edges[:-1] - edges[:-1][order], sizes)]

    def find(self, own: list[str]) -> np.ndarray:
        """The place of each chunk, or -1."""
        if not len(self.h) or not own:
            return np.full(len(own), -1)
        d = halves(b"".join(map(digest, own)))
        at = np.minimum(np.searchsorted(self.h, d[:, 0]), len(self.h) - 1)
        return np.where((self.h[at] == d[:, 0]) & (self.g[at] == d[:, 1]), at, -1)


def frequent_level(entries: DataFrame, most: int) -> int:
    """The least n from which on the table's entries have no more than so many bytes together; 0: all of them."""
    size = F.sum(F.octet_length("ids") + ENTRY)
    levels = entries.groupBy(F.floor(F.log2(F.col("n").cast("double"))).alias("level")).agg(size.alias("bytes")).collect()  # 63 rows at most
    held = 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        held += r["bytes"]
        if held > most:
            return 1 << (r["level"] + 1)
    return 0


def _collected(entries: DataFrame, kind: str) -> Frequent:
    got = entries.select("digest", "ids").toArrow().combine_chunks()  # TABLE_BYTES at most
    if not got.num_rows:
        return Frequent(b"", np.empty(0, kind), np.zeros(1, np.int64))

    def flat(name: str) -> tuple[pa.Buffer, np.ndarray]:
        c = got.column(name).cast(pa.large_binary()).combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        edges = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        return c.buffers()[2].slice(int(edges[0]), int(edges[-1] - edges[0])), edges - edges[0]

    ids, edges = flat("ids")
    return Frequent(flat("digest")[0], np.frombuffer(ids, kind), edges // np.dtype(kind).itemsize)


def _unknown(shared):
    """key, chunk: the distinct chunks of each text that the shared entries don't have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column("text").fill_null("").to_pylist(), batch.column("key")
            for a, b in _parts(texts):
                each = [dict.fromkeys(chunks(t)) for t in texts[a:b]]
                own = list(dict.fromkeys(c for one in each for c in one))
                gone = {c for c, k in zip(own, shared.value.find(own).tolist(), strict=True) if k >= 0}
                rows = [(a + k, c) for k, one in enumerate(each) for c in one if c not in gone]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array([k for k, _ in rows], pa.int64())), pa.array([c for _, c in rows], pa.string())], names=["key", "chunk"])

    return run


def _encoded(path: str, shared, with_ids: bool):
    """Of rows (doc_id, text, own: entries that the shared ones don't have) the ids, joined by position, and what they decode to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of(path)
        kind, end = width(model), [model.eos_id()]
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in _parts(texts):
                cut = [chunks(t) for t in texts[a:b]]
                known: dict[str, list[int]] = {}
                if "own" in pdf.columns:
                    for own in pdf["own"].iloc[a:b]:
                        for e in own if own is not None else ():
                            known[e["chunk"]] = np.frombuffer(e["ids"], kind).tolist()
                ask = [c for c in dict.fromkeys(c for one in cut for c in one) if c not in known]
                found, f = shared.value.find(ask), shared.value
                for c, k in zip(ask, found.tolist(), strict=True):
                    if k >= 0:
                        known[c] = f.ids[f.edges[k] : f.edges[k + 1]].tolist()
                once = [c for c, k in zip(ask, found.tolist(), strict=True) if k < 0]
                known.update(zip(once, segmented(model, once), strict=True))
                rows = []
                for doc, one in zip(pdf["doc_id"].iloc[a:b], cut, strict=True):
                    ids = [i for c in one for i in known[c]] + end
                    text = model.decode(ids)
                    told = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
                    rows.append((doc, len(ids), told, hashlib.sha256(text.encode()).hexdigest(), *([ids, text] if with_ids else [])))
                yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])])

    return run


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, table_bytes: int = TABLE_BYTES, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens (with the end id), ids_sha256, decoded_sha256 of each row; with_ids: and ids and the decoded text."""
    spark, path = docs.sparkSession, path or default_model()
    kind = width(model_of(path))
    docs = columns(docs, doc_id=id_col, text=text_col)
    entries = written(chunk_table(docs, path), "chunks", shared_dir(spark))
    least = frequent_level(entries, table_bytes)
    shared = spark.sparkContext.broadcast(_collected(entries.where(F.col("n") >= least), kind))
    if least:
        # texts are known by a digest, so equal ones share a map and no row number is needed
        digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
        unknown = docs.select(digest.alias("key"), "text").mapInArrow(_unknown(shared), "key string, chunk string").distinct()
        rest = entries.where(F.col("n") < least).select("chunk", "ids")
        maps = unknown.join(rest, "chunk").groupBy("key").agg(F.collect_list(F.struct("chunk", "ids")).alias("own"))
        docs = docs.withColumn("key", digest).join(maps, "key", "left").drop("key")
    return by_rows(docs, _encoded(path, shared, with_ids), "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else ""))


def decoded(ids: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id and text of rows of ids; null ids are none."""
    path = path or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [model.decode([int(i) for i in x]) if x is not None and len(x) else "" for x in pdf["ids"]]})

    return by_rows(columns(ids, doc_id=id_col, ids=ids_col), run, "text string")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
