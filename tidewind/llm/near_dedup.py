"""Near-duplicates with an LSH forest over MinHash signatures.

A document is the set of its shingles. Each of ORDERS orders of the signature gives a sorted list of documents. Documents that share a
prefix of DEPTHS[0] values there make up a region; in regions of more than REGION documents the prefix gets longer, and the least
document of each longer prefix stands for it in the region above. Within a region, documents are sorted by the values after its prefix,
so neighbours are those with the longest common prefix. Two rounds take each document's neighbours as candidates and confirm, on the
full sets, the best of them, then the best that leads out of its component.

The last round leaves no pair out: it looks at every region of the shortest prefix that still holds several components. Documents with a
similar sketch in another component are found first; their full sets then go to the tasks of their regions (large regions are dealt into
pairs of blocks), where all such pairs are confirmed and only links that join components leave. No pair is ever written; a pair that
several orders share is compared in the first of them alone. Sets that are equal are one node, so copies are never paired.

A pair of similarity 0.75 is lost if it shares a shortest prefix in no order or if its sketches differ too much (see missed()).

Defined results: a document of fewer words than a shingle is the one sequence of its words; without words its set is empty and it is
linked with nothing; a null identifier gives a component of its own (null, kept); rows that share an identifier count as one document;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, hinted, shared_dir, table, written
from .components import components
from .tokens import mix, pieces, rolling, whole

SHINGLE = 5
THRESHOLD = 0.75
#: Values of a signature, orders of it, and values in the prefixes of a region (the first for small regions).
VALUES, ORDERS, DEPTHS = 96, 32, (4, 8, 16)
#: Documents of a region beyond which its prefix gets longer.
REGION = 2048
#: The first rounds compare all documents of regions of up to SMALL, in larger ones the next AHEAD in the order.
SMALL, AHEAD = 32, 8
#: Documents of a block in the last round, bytes of sets in one, and rows of it that are compared with others at once.
BLOCK, BLOCK_BYTES, CHUNK = 1024, 16 << 20, 128
#: Sketch estimate below which a pair is no candidate: 4 standard errors below THRESHOLD.
MAYBE = 0.57
BROADCAST_ROWS = 1_000_000

_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_ORDER = np.array([_RANDOM.permutation(VALUES)[: DEPTHS[-1] + 2] for _ in range(ORDERS)])
#: Values that documents are sorted by after the prefixes of DEPTHS, and bits of each.
_AFTER = ((4, 5, 6, 7), (8, 9), (16, 17))
_NIBBLES = int("1" * VALUES, 16)


def missed(similarity: float) -> float:
    """Probability that the last round doesn't compare a pair of this similarity on the full sets."""
    out = 0.0
    for k in range(VALUES + 1):
        p = math.comb(VALUES, k) * similarity**k * (1 - similarity) ** (VALUES - k)
        apart = (1 - math.comb(k, DEPTHS[0]) / math.comb(VALUES, DEPTHS[0])) ** ORDERS
        least = math.ceil(VALUES * (MAYBE * 15 / 16 + 1 / 16)) - k  # values that must agree in their low bits alone
        unlike = sum(math.comb(VALUES - k, j) * 15 ** (VALUES - k - j) / 16 ** (VALUES - k) for j in range(max(0, min(least, VALUES - k + 1))))
        out += p * (1 - (1 - apart) * (1 - unlike))
    return out


def shingles(h: np.ndarray, edges: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a piece."""
    all_of = mix(rolling(h, size))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(all_of[a : b - size + 1]))
        else:
            out.append(mix(rolling(h[a:b], b - a) + np.uint64(b - a)) if b > a else np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (32 bits) of each set, a row each; all sets have members."""
    flat, begin = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), VALUES), np.uint32)
    for k in range(VALUES):
        out[:, k] = np.minimum.reduceat((flat * _A[k] + _B[k]) >> np.uint64(32), begin)
    return out


def _sign(size: int):
    """doc, n (size of the set), digest (of the set; null if empty), signature and sketch (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, signed, sketches = [], [], [], []
            for _, _, h, edges in pieces(batch.column("text"), lower=True):
                sets = shingles(h, edges, size)
                full = [s for s in sets if len(s)]
                made = iter(signatures(full)) if full else iter(())
                for s in sets:
                    n.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    values = next(made) if len(s) else None
                    signed.append(values.tobytes() if len(s) else None)
                    sketches.append(sketch(values) if len(s) else None)
            arrays = [pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, signed, sketches))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *arrays], names=["doc", "n", "digest", "signature", "sketch"])

    return run


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, k0, k1, k2 (hash of the order and its first DEPTHS values), r0, r1 (the values that follow, 16 bits each): a row for each order."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, VALUES)
            docs = part.column("doc").to_numpy()
            for t in range(ORDERS):
                values = sig[:, _ORDER[t]].astype(np.uint64)
                key, keys = np.full(len(sig), t + 1, np.uint64), []
                for d in range(DEPTHS[-1]):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, d])
                    if d + 1 in DEPTHS:
                        # the low bits tell the order
                        keys.append(pa.array((key // np.uint64(ORDERS) * np.uint64(ORDERS) + np.uint64(t)).view(np.int64)))
                rests = []
                for after in (_AFTER[0], _AFTER[1] + _AFTER[2]):
                    rest = np.zeros(len(sig), np.uint64)
                    for d in after:
                        rest = rest << np.uint64(16) | values[:, d] >> np.uint64(16)
                    rests.append(pa.array(rest.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(docs), *keys, *rests], names=["doc", "k0", "k1", "k2", "r0", "r1"])


def sketch(values: np.ndarray) -> bytes:
    """The lowest 4 bits of each value."""
    low = (values & 15).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


def estimate(a: int, b: int) -> float:
    """Similarity of two sets from their sketches."""
    x = a ^ b
    same = VALUES - ((x | x >> 1 | x >> 2 | x >> 3) & _NIBBLES).bit_count()
    return (same / VALUES - 1 / 16) / (15 / 16)


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """doc, e, a, b: the best pair of each document among its neighbours in each region that are not in one component yet.

    Rows come sorted by region and, there, by the order's values."""

    def compare(region: list[tuple[int, int, int]], done: int, small: bool, found: list) -> None:
        """Compares region[done:] with what is near before them."""
        best: dict[int, tuple] = {}
        for i in range(done, len(region)):
            doc, component, own = region[i]
            for j in range(i) if small else {0, *range(max(0, i - AHEAD), i)}:
                other, its, theirs = region[j]
                if its == component or j >= i or (e := estimate(own, theirs)) < MAYBE:
                    continue
                pair = (e, min(doc, other), max(doc, other))
                for d in (doc, other):
                    if d not in best or pair > best[d]:
                        best[d] = pair
        found += [(d, *pair) for d, pair in best.items()]

    key, region, found, done, long = None, [], [], 1, False
    for pdf in batches:
        for k, doc, component, own in zip(pdf["key"].tolist(), pdf["doc"].tolist(), pdf["component"].tolist(), pdf["sketch"], strict=True):
            if k != key:
                if len(region) > done:
                    compare(region, done, not long and len(region) <= SMALL, found)
                key, region, done, long = k, [], 1, False
            region.append((doc, component, int.from_bytes(own, "big")))
            if len(region) > 1024:  # of a long region the hub and the last few documents go on
                compare(region, done, False, found)
                region = [region[0], *region[-AHEAD:]]
                done, long = len(region), True
        if len(found) > 20_000:
            yield pd.DataFrame(found, columns=["doc", "e", "a", "b"])
            found = []
    if len(region) > done:
        compare(region, done, not long and len(region) <= SMALL, found)
    yield pd.DataFrame(found, columns=["doc", "e", "a", "b"]).astype({"doc": "int64", "e": "float64", "a": "int64", "b": "int64"})


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of x and y (sketches as rows of words) have an estimate of MAYBE at least."""
    differ = np.zeros((len(x), len(y)), np.uint8)
    for w in range(x.shape[1]):
        z = x[:, w, None] ^ y[None, :, w]
        z |= z >> np.uint64(1)
        z |= z >> np.uint64(2)
        z &= np.uint64(0x1111111111111111)
        differ += np.bitwise_count(z)
    return ((VALUES - differ.astype(np.float64)) / VALUES - 1 / 16) / (15 / 16) >= MAYBE


def _groups(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each group (by names), of rows that come sorted by them."""
    kept: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        new = np.zeros(len(pdf), bool)
        for c in names:
            v = pdf[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
            new[0] |= bool(kept) and kept[-1][c].iloc[-1] != v[0]
        edges = [0, *(np.flatnonzero(new[1:]) + 1).tolist(), len(pdf)]
        if kept and new[0]:
            yield pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0]
            kept = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if kept and a:
                yield pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0]
                kept = []
            kept.append(pdf.iloc[a:b])
    if kept:
        yield pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0]


def _across(group: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of a group (sorted by component) with similar sketches and in two components; between its blocks i and j if i < j."""
    component, block = group["component"].to_numpy(), group["block"].to_numpy()
    x = np.frombuffer(b"".join(group["sketch"]), np.uint64).reshape(len(group), -1)
    across = group["i"].iloc[0] < group["j"].iloc[0]
    first = int((block == block[0]).sum()) if across else len(group)  # components are in the order of blocks
    for at in range(0, first, CHUNK):
        end = min(first, at + CHUNK)
        begin = max(first if across else 0, int(np.searchsorted(component, component[at], "right")))
        for to in range(begin, len(group), 8 * CHUNK):
            part = slice(to, to + 8 * CHUNK)
            u, v = np.nonzero(alike(x[at:end], x[part]) & (component[at:end, None] < component[None, part]))
            if len(u):
                yield u + at, v + to


_GROUP = ["key", "i", "j"]


def _wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key, i, j, block, component, doc of those documents of a group that have a similar sketch in another component: a row each."""
    for group in _groups(batches, _GROUP):
        if group["component"].iloc[0] == group["component"].iloc[-1]:
            continue
        mark = np.zeros(len(group), bool)
        for u, v in _across(group):
            mark[u] = mark[v] = True
        if mark.any():
            yield group.loc[mark, [*_GROUP, "block", "component", "doc"]]


def _joined(threshold: int):
    """u, v: links between components of a group, as many as join them. Rows have signature and set too."""

    def similar(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)):
            return False
        both = np.sort(np.concatenate((x, y)), kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= threshold * (len(x) + len(y) - common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, _GROUP):
            component, doc, sets = group["component"].tolist(), group["doc"].tolist(), group["set"].tolist()
            signed = np.frombuffer(b"".join(group["signature"]), np.uint32).reshape(len(group), VALUES)
            order = int(group["key"].iloc[0]) % ORDERS
            root: dict[int, int] = {}
            found = []

            def top(c: int, root: dict[int, int] = root) -> int:
                while (up := root.get(c, c)) != c:
                    root[c] = root.get(up, up)
                    c = up
                return c

            for u, v in _across(group):
                first = np.ones(len(u), bool)  # whether no earlier order has both in one region
                for t in range(order):
                    first &= ~(signed[u][:, _ORDER[t, : DEPTHS[0]]] == signed[v][:, _ORDER[t, : DEPTHS[0]]]).all(1)
                for a, b in zip(u[first].tolist(), v[first].tolist(), strict=True):
                    p, q = top(component[a]), top(component[b])
                    if p != q and similar(sets[a], sets[b]):
                        root[max(p, q)] = min(p, q)
                        found.append((doc[a], doc[b]))
            if found:
                yield pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return run


def forest(nodes: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents of each region of the forest over nodes (doc, n, signature, sketch); those alone in theirs are left out.

    The first table (key, rest, doc, sketch, n) has the regions as they are split. The others have the regions of the shortest prefix: the second
    those whose documents and sets one task can hold, the third those that must be dealt into blocks."""
    trees = nodes.select("doc", "signature").mapInArrow(_grow, "doc long, k0 long, k1 long, k2 long, r0 long, r1 long")
    several = lambda rows, k: rows.groupBy(k).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # the trees are made twice rather than written, which spares disk
    shared = written(trees.join(written(several(trees, "k0").select("k0"), "several", folder), "k0"), "shared", folder)
    rows, levels, split = shared.select("k0", "k1", "k2", "doc", "r0", "r1"), [], None
    for upper, lower, rest in (("k0", "k1", F.col("r0")), ("k1", "k2", F.shiftrightunsigned("r1", 32))):
        large = written(several(rows, upper).where(F.col("n") > REGION).select(upper, F.lit(True).alias("deep")), f"large_{upper}", folder)
        sized = rows.join(hinted(large, BROADCAST_ROWS), upper, "left")
        levels.append(sized.where("deep IS NULL").select(F.col(upper).alias("key"), "doc", rest.alias("rest"), F.lit(split is None).alias("whole")))
        rows = sized.where("deep").drop("deep")
        split = rows if split is None else split
        heads = rows.groupBy(upper, lower).agg(F.min(F.struct(F.col("doc"), rest.alias("rest"))).alias("head"))
        levels.append(heads.select(F.col(upper).alias("key"), "head.doc", "head.rest", F.lit(False).alias("whole")))
    levels.append(rows.select(F.col("k2").alias("key"), "doc", F.col("r1").bitwiseAND(F.lit(0xFFFFFFFF)).alias("rest"), F.lit(False).alias("whole")))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    sketches = nodes.select("doc", "sketch", "n")
    out = written(out.join(sketches, "doc"), "forest", folder)
    whole = out.where("whole").select("key", "doc", "sketch", "n")
    heavy = written(whole.groupBy("key").agg(F.sum(8 * F.col("n")).alias("bytes")).where(F.col("bytes") > 2 * BLOCK_BYTES).select("key"), "heavy", folder)
    heavy = hinted(heavy, BROADCAST_ROWS)
    split = split.select(F.col("k0").alias("key"), "doc").join(sketches, "doc").unionByName(whole.join(heavy, "key", "left_semi"))
    return out, whole.join(heavy, "key", "left_anti"), written(split, "split", folder)


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("component", F.col("doc"))
    return rows.join(hinted(labels, BROADCAST_ROWS), rows["doc"] == labels["node"], "left").withColumn("component", F.coalesce("component", "doc")).drop("node")


def candidates(regions: DataFrame, labels: DataFrame | None) -> DataFrame:
    """a, b: of each document the best neighbour in the forest that is not in its component."""
    rows = _labelled(regions, labels).select("key", "rest", "doc", "component", "sketch").repartition("key").sortWithinPartitions("key", "rest", "doc")
    pairs = rows.mapInPandas(_neighbours, "doc long, e double, a long, b long")
    return pairs.groupBy("doc").agg(F.max(F.struct("e", "a", "b")).alias("p")).select("p.a", "p.b").distinct()


def last_links(whole: DataFrame, split: DataFrame, labels: DataFrame | None, nodes: DataFrame, docs: DataFrame, size: int, threshold: float, folder: str) -> DataFrame:
    """u, v: links of all documents that share a shortest prefix and are in two components, as many as join the components of each region."""
    zero = F.lit(0).cast("long")
    rows = _labelled(whole, labels).select("key", zero.alias("i"), zero.alias("j"), zero.alias("block"), "component", "doc", "sketch")
    if split.head(1):
        order = Window.partitionBy("key").orderBy("component", "doc")
        parts = _labelled(split, labels)
        parts = parts.withColumn("block", F.floor(F.greatest((F.row_number().over(order) - 1) / BLOCK, F.sum(8 * F.col("n")).over(order) / BLOCK_BYTES)).cast("long"))
        parts = written(parts.select("key", "block", "component", "doc", "sketch"), "blocks", folder)
        ends = parts.groupBy("key", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        low, high = ends.select("key", F.col("block").alias("i"), "lo"), ends.select("key", F.col("block").alias("j"), "hi")
        # blocks come in the order of components: if the first and the last are equal, all are
        both = low.join(high, "key").where("i <= j AND lo <> hi").select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
        rows = rows.unionByName(both.join(parts, ["key", "block"]).select(rows.columns))
    sort = [*_GROUP, "component", "doc"]
    wanted = rows.repartition(*_GROUP).sortWithinPartitions(*sort).mapInPandas(_wanted, "key long, i long, j long, block long, component long, doc long")
    wanted = written(wanted, "wanted", folder)
    if not wanted.head(1):
        return docs.sparkSession.createDataFrame([], "u long, v long")
    sets = written(sets_of(wanted.select("doc").distinct(), docs, size, folder), "last_sets", folder)
    own = nodes.select("doc", "signature", "sketch").join(sets, "doc")
    full = wanted.join(own, "doc").repartition(*_GROUP).sortWithinPartitions(*sort)
    return written(full.mapInPandas(_joined(round(100 * threshold)), "u long, v long"), "last", folder)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [s.tobytes() for _, _, h, edges in pieces(batch.column("text"), lower=True) for s in shingles(h, edges, size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(made, pa.large_binary()).cast(pa.binary())], names=["doc", "set"])

    return run


def _linked(threshold: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= threshold * (len(x) + len(y) - common))
            yield pdf.loc[ok, ["a", "b"]].rename(columns={"a": "u", "b": "v"})

    return run


def sets_of(ids: DataFrame, docs: DataFrame, size: int, folder: str) -> DataFrame:
    """doc, set: the full sets of the documents in ids (doc)."""
    ids = written(ids, f"ids_{uuid.uuid4().hex[:6]}", folder)
    rows = docs.join(hinted(ids, BROADCAST_ROWS), "doc", "left_semi").mapInArrow(_sets(size), "doc long, set binary")
    return rows.groupBy("doc").agg(F.first("set").alias("set"))


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, threshold: float, folder: str) -> DataFrame:
    """u, v: the pairs (a, b) whose full sets are similar enough."""
    sets = written(sets_of(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), docs, size, folder), "sets", folder)
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("doc").alias("b"), F.col("set").alias("y")), "b")
    return written(both.select("a", "b", "x", "y").mapInPandas(_linked(round(100 * threshold)), "u long, v long"), "links", folder)


def links(regions: DataFrame, whole: DataFrame, split: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """node, component of each node that confirmed links join to a smaller one.

    Three rounds: the best candidate of each document; the best that leads out of its component; all pairs that still do."""
    spark = docs.sparkSession
    edges = labels = tried = None
    for last in (False, False, True):
        folder = shared_dir(spark)
        if last:
            new = last_links(whole, split, labels, nodes, docs, size, threshold, folder)
        else:
            pairs = candidates(regions, labels)
            pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs", folder)
            tried = pairs
            new = confirmed(pairs, docs, size, threshold, folder)
        if new.head(1):
            edges = new if edges is None else edges.union(new)
            labels = components(edges)
    return labels if labels is not None else spark.createDataFrame([], "node long, component long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest identifier that links reach), kept (it is its own component's)."""
    folder = shared_dir(docs.sparkSession)
    rows = columns(docs, doc=id_col, text=text_col).withColumn("doc", F.col("doc").cast("long"))
    signed = written(rows.mapInArrow(_sign(size), "doc long, n long, digest binary, signature binary, sketch binary"), "signed", folder)
    known = signed.where("doc IS NOT NULL AND digest IS NOT NULL")
    # equal sets are one node, named by their smallest document
    classes = written(known.groupBy("digest").agg(F.min("doc").alias("node"), F.first(F.struct("n", "signature", "sketch")).alias("s")), "classes", folder)
    nodes = written(classes.groupBy(F.col("node").alias("doc")).agg(F.first("s").alias("s")).select("doc", "s.n", "s.signature", "s.sketch"), "nodes", folder)
    labels = links(*forest(nodes, folder), nodes, rows, size, threshold)
    named = signed.join(classes.select("digest", "node"), "digest", "left").join(labels, "node", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "node", "doc"))
    kept = F.coalesce(F.col("doc") == component, F.lit(True))
    return named.select(F.col("doc").cast(docs.schema[id_col].dataType).alias("doc_id"), F.col("n").alias("n_shingles"), component.cast(docs.schema[id_col].dataType).alias("component_id"), kept.alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS k, n FROM s JOIN n USING (doc_id) JOIN (SELECT g, count(*) AS f FROM s GROUP BY g) USING (g)),
p AS (SELECT * FROM r WHERE k <= n - ceil(0.75 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)),
i AS (SELECT a, b, count(*) AS m FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.g = y.g GROUP BY a, b),
e AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 75 * (na.n + nb.n - m)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
t AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT u.b, t.root FROM t JOIN u ON u.a = t.node WHERE t.root < u.b),
l AS (SELECT node, min(root) AS component_id FROM t GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN l ON l.node = d.doc_id
"""
