"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds the normalised words of the test items, several thousand items in each block; training words are streamed through
it and the longest match that ends at each word is tracked. A window of an item is SIZE consecutive words of it, or all of an item that
has fewer; whenever a match is as long as a window, its words are hit. A document is contaminated if its hit words reach the coverage
limit; decontaminate() also returns the hit spans and the text without those that reach the length limit.

Up to BLOCKS_A_PASS automata are used in one pass over the documents. A larger benchmark takes several passes, each of which writes only the
rows that it hits (row key and hit words, no texts); they are merged by row at the end.

Defined results: null texts have no words; an item without words, or with a null identifier, has no windows; items that are repeated
count once by identifier; an empty benchmark hits nothing; an empty table gives an empty result; other columns are passed on, whatever their names, but for those that
decontaminate() says it adds, which are replaced; the query ignores them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .common import columns, every, fresh, map_rows, quoted, shared_dir, table, written

SIZE = 13
#: Words of one automaton; a larger benchmark is dealt into blocks of so many, so what is broadcast stays below some 100 MB.
BLOCK_WORDS = 250_000
#: So many automata are used in one pass over the documents.
BLOCKS_A_PASS = 4
#: The white space between words after normalising: everything in ASCII but letters and digits.
_TABLE = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words [0-9a-z\\x80-]+ in UTF-8, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences. hits() gives the windows that end at each word of a document."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int = SIZE):
        self.size, self.vocabulary = size, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.windows: dict[int, set[str]] = {}  # by state: items that have a window of the full size there
        self.short: dict[int, list[tuple[int, str]]] = {}  # by state: whole items of fewer words
        coded = []
        for item, words in items:
            if words:
                coded.append((item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.at_size = [self._shortest(v, size) for v in range(len(self.link))]
        for item, ids in coded:
            self._mark(item, ids)
        # the nearest state upwards, itself included, at which a whole short item ends
        self.up = [-1] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.up[v] = v if v in self.short else self.up[self.link[v]]
        self.least = min([size, *(len(ids) for _, ids in coded)])

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(link)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.link)
        self.next.append(dict(self.next[q])), self.link.append(self.link[q]), self.length.append(self.length[p] + 1)
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _shortest(self, v: int, size: int) -> int:
        """The state of the last size words of v's longest sequence; -1 if that is shorter."""
        if self.length[v] < size:
            return -1
        while self.length[self.link[v]] >= size:
            v = self.link[v]
        return v

    def _mark(self, item: str, ids: list[int]) -> None:
        v = 0
        for i, c in enumerate(ids):
            v = self.next[v][c]
            if i + 1 >= self.size:
                self.windows.setdefault(self.at_size[v], set()).add(item)
        if len(ids) < self.size:
            while self.length[self.link[v]] >= len(ids):
                v = self.link[v]
            self.short.setdefault(v, []).append((len(ids), item))

    def hits(self, words: list[bytes], hit: bytearray | None, found: set[str]) -> tuple[bytearray | None, int]:
        """Marks the hit words, adds the items; returns the marks (None if there are none) and the longest match."""
        get, nxt, link, length = self.vocabulary.get, self.next, self.link, self.length
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        known = np.concatenate(([0], (ids >= 0).view(np.int8), [0]))
        edge = np.diff(known)
        longest = 0
        for start, end in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if end - start < self.least:  # no window is so short
                continue
            v = n = 0
            for i, c in enumerate(ids[start:end].tolist(), int(start)):
                while v and c not in nxt[v]:
                    v = link[v]
                    n = length[v]
                if c in nxt[v]:
                    v = nxt[v][c]
                    n += 1
                else:
                    v = n = 0
                if n > longest:
                    longest = n
                if n >= self.size:
                    # at_size is of v's longest sequence, and so of each of its suffixes that v stands for
                    hit = hit or bytearray(len(words))
                    hit[i + 1 - self.size : i + 1] = b"\1" * self.size
                    found |= self.windows[self.at_size[v]]
                u = self.up[v]
                while u != -1:
                    for k, item in self.short[u]:
                        if k <= n:
                            hit = hit or bytearray(len(words))
                            hit[i + 1 - k : i + 1] = b"\1" * k
                            found.add(item)
                    u = self.up[self.link[u]]
        return hit, longest


def blocks(items: Iterator[tuple[str | None, str | None]], most: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of so many words; an item that is longer itself is cut into parts that overlap by SIZE - 1 words."""
    block, n = [], 0
    for item, text in items:
        words = words_of(text) if item is not None else []
        step = max(most, SIZE)
        parts = [words] if len(words) <= step else [words[i : i + step + SIZE - 1] for i in range(0, len(words) - SIZE + 1, step)]
        for part in parts:
            if part:
                block.append((str(item), part))
                n += len(part)
            if n >= most:
                yield block
                block, n = [], 0
    if block:
        yield block


FOUND = "n_words: bigint, n_hit: bigint, hit: binary, items: array<string>, longest: int"


@F.pandas_udf(BinaryType())
def _merged(hits: pd.Series) -> pd.Series:
    return hits.map(lambda x: None if x is None or not len(x) else np.bitwise_or.reduce([np.frombuffer(h, np.uint8) for h in x]).tobytes())


def match(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> tuple[DataFrame, str]:
    """docs with a column more, and its name: n_words, hit (a byte for each word; null if none is hit), items, longest (match in words)."""
    spark = docs.sparkSession
    (found,) = fresh(docs.columns, "found")
    rows = columns(benchmark, item=item_col, text=item_text).where("item IS NOT NULL AND text IS NOT NULL")
    groups: list[list] = [[]]
    folder = part = None
    for block in blocks(((str(r.item), r.text) for r in rows.toLocalIterator()), block_words):
        if len(groups[-1]) == BLOCKS_A_PASS:
            # a larger benchmark: rows get a key that every pass sees
            if folder is None:
                folder = shared_dir(spark)
                (key,) = fresh([*docs.columns, found], "row")
                docs = written(docs.withColumn(key, F.monotonically_increasing_id()), "docs", folder)
            part = _hit_rows(docs, key, text_col, groups[-1], folder, len(groups), part)
            groups.append([])
        groups[-1].append(spark.sparkContext.broadcast(Automaton(block)))
    automata = groups[-1]
    full = docs.withColumn(found, F.lit(None).cast(f"struct<{FOUND}>"))
    names = full.columns
    at, last = names.index(text_col), len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_found(words_of(text), automata) for text in batch.column(at).to_pylist()]
            yield batch.set_column(last, batch.schema.field(last), pa.array(out, batch.schema.field(last).type))

    full = map_rows(full, run)
    if folder is None:
        return full, found
    was, late = fresh([*names, key], "was", "late")
    part = part.groupBy(F.col("row").alias(was)).agg(F.struct(F.collect_list("hit").alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("longest").alias("longest")).alias(late))
    both = full.join(part, F.col(quoted(key)) == F.col(quoted(was)), "left")
    f, w = quoted(found), quoted(late)
    hits = F.filter(F.concat(F.coalesce(F.col(f"{w}.hits"), F.array().cast("array<binary>")), F.array(F.col(f"{f}.hit"))), lambda x: x.isNotNull())
    hit = _merged(hits)
    ones = F.length(F.replace(F.hex(hit), F.lit("00"), F.lit(""))) / 2
    new = F.struct(
        F.col(f"{f}.n_words").alias("n_words"), F.coalesce(ones, F.lit(0)).cast("long").alias("n_hit"), hit.alias("hit"),
        F.array_sort(F.array_union(F.col(f"{f}.items"), F.coalesce(F.col(f"{w}.items"), F.array().cast("array<string>")))).alias("items"),
        F.greatest(F.col(f"{f}.longest"), F.col(f"{w}.longest")).alias("longest"),
    )
    return both.select(*[F.col(quoted(c)) if c != found else new.alias(found) for c in names if c != key]), found


def _found(words: list[bytes], automata: list) -> dict:
    items: set[str] = set()
    hit, longest = None, 0
    for a in automata:
        hit, n = a.value.hits(words, hit, items)
        longest = max(longest, n)
    return {"n_words": len(words), "n_hit": sum(hit) if hit else 0, "hit": bytes(hit) if hit else None, "items": sorted(items), "longest": longest}


def _hit_rows(docs: DataFrame, key: str, text_col: str, automata: list, folder: str, k: int, before: DataFrame | None) -> DataFrame:
    """row, hit, items, longest of the rows that these automata match at all, and those of the passes before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = _found(words_of(text), automata)
                if got["longest"]:
                    rows.append({"row": row, "hit": got["hit"], "items": got["items"], "longest": got["longest"]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("row", pa.int64()), ("hit", pa.binary()), ("items", pa.list_(pa.string())), ("longest", pa.int32())]))

    out = written(columns(docs, row=key, text=text_col).mapInArrow(run, "row long, hit binary, items array<string>, longest int"), f"pass{k}", folder)
    for a in automata:
        a.destroy()
    return out if before is None else before.unionByName(out)


@F.pandas_udf(StringType())
def _digest(items: pd.Series) -> pd.Series:
    return items.map(lambda x: hashlib.sha256(",".join(x).encode()).hexdigest())


def spans_of(hit: bytes | None) -> list[tuple[int, int]]:
    """[start, end) in words of each run of hit words."""
    edge = np.diff(np.concatenate(([0], np.frombuffer(hit or b"", np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def without(text: str, hit: bytes | None, longest_span: int) -> str:
    """The text without the runs of at least so many hit words."""
    gone = [(a, b) for a, b in spans_of(hit) if b - a >= longest_span]
    if not gone:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw)]
    out, last = [], 0
    for a, b in gone:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", coverage: float = 0.05, longest_span: int = SIZE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, n_hit, contaminated (coverage reached), spans, clean_text (hit spans of that length cut), items and longest; columns of these names are replaced."""
    added = ["n_words", "n_hit", "contaminated", "spans", "clean_text", "items", "longest"]
    docs = docs.select(*every(docs, added))
    found, name = match(docs, benchmark, text_col, block_words=block_words)

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def spans(hit: pd.Series) -> pd.Series:
        return hit.map(lambda h: [{"start": a, "end": b} for a, b in spans_of(h)])

    @F.pandas_udf("string")
    def clean(text: pd.Series, hit: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or h is None else without(t, h, longest_span) for t, h in zip(text, hit, strict=True)])

    got = lambda x: F.col(f"{quoted(name)}.{x}")
    return found.select(
        *every(docs), got("n_words").alias("n_words"), got("n_hit").alias("n_hit"), contaminated(name, coverage).alias("contaminated"),
        spans(got("hit")).alias("spans"), clean(F.col(quoted(text_col)), got("hit")).alias("clean_text"), got("items").alias("items"), got("longest").alias("longest"),
    )


def contaminated(name: str, coverage: float = 0.05) -> Column:
    """Whether the hit words in column name reach the coverage limit."""
    n_hit, n_words = F.col(f"{quoted(name)}.n_hit"), F.col(f"{quoted(name)}.n_words")
    return (n_hit > 0) & (n_hit >= F.lit(str(coverage)).cast("decimal(10,6)") * n_words)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", coverage: float = 0.05) -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated."""
    found, name = match(docs, benchmark, text_col)
    return found.where(~contaminated(name, coverage)).select(*every(docs))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found, name = match(docs, table(spark, sf_dir, "benchmark"))
    got = lambda x: F.col(f"{name}.{x}")
    return found.select(
        "doc_id", got("n_words").alias("n_words"), got("n_hit").alias("n_hit"), F.size(got("items")).cast("long").alias("n_items"), _digest(got("items")).alias("items_sha256"),
        ((got("n_hit") > 0) & (20 * got("n_hit") >= got("n_words"))).alias("contaminated"),
    )


_WORDS_SQL = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS_SQL.format("text")} AS w FROM documents),
bw AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {_WORDS_SQL.format("text")} AS w FROM benchmark) WHERE len(w) > 0),
bn AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM bw)),
dn AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, dn.k, i FROM dn JOIN bn ON dn.k = bn.k AND dn.win = bn.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
