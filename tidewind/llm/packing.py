"""Best-fit packing of tokenised documents with a grouping genetic algorithm.

Pieces are dealt evenly into shards. A shard whose plain best-fit packing meets a lower bound of the bins that can do is done. Each
other shard evolves on several islands, each island a task of its own with its own population: crossover injects whole well-filled bins
of one packing into another, takes out the bins that hold the same pieces, and puts the pieces that this displaces where they fit best.
After each epoch the islands' populations go through a shuffle, in which each island gets the elite of the one before it. A shard's best
packing stays. Its bins that are poorly filled are opened, their pieces are dealt anew into fewer shards, and these evolve again, so that
pieces of different shards meet.

Defined results: a null text is empty and gives the end token alone; rows with equal identifiers are packed each for itself; a null
identifier stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_rows, columns, shared_dir, table, written

CAPACITY = 1024
END_ID = 2
#: Pieces of a shard, islands of a shard, packings of an island, generations of an epoch, and epochs.
SHARD, ISLANDS, PACKINGS, GENERATIONS, EPOCHS = 8192, 3, 4, 8, 3
#: Bins that are less full are opened and packed again.
WELL_FILLED = 0.998
#: Lengths among which a bin's exact fill is looked for.
TRIED = 48
#: Pre-tokenisation of the byte-level BPE vocabulary (a fixed value of its format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The vocabulary file writes bytes as printable characters: these stand for themselves, the others for U+0100 onwards (fixed values).
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: White space as the patterns have it, in very long runs.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4000,}")
#: The last vocabulary that a worker read.
_MODELS: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary(path: str):
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    byte_of = {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in told["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Token ids of texts, in 4 bytes each, least first. A text is encoded whole, outside of Python; nothing is remembered between texts."""

    def __init__(self, path: str):
        if path not in _MODELS:
            _MODELS.clear()
            _MODELS[path] = vocabulary(path)
        self.model = _MODELS[path]

    def _ids(self, text: str) -> bytes:
        return self.model.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes() if text else b""

    def __call__(self, text: str) -> bytes:
        out, last = [], 0
        # the tokenizer's patterns can't take very long runs of white space: such a run, but for its last character before other text, is one piece
        for m in _LONG_RUN.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += [self._ids(text[last : m.start()]), array("I", self.model._core_bpe.encode_single_piece(text[m.start() : end].encode())).tobytes()]
            last = end
        return b"".join([*out, self._ids(text[last:] if last else text)])


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; of a longer document, the first piece takes what full ones leave."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


PIECES = "piece int, start long, length long, ids_crc32 long"


def tokenized(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of docs (doc_id, text); with_ids: and ids, 4 bytes each."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = Encoder(path), END_ID.to_bytes(4, "little")
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = encode(text or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, k, start, length, zlib.crc32(own), *([own] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return by_rows(docs, run, PIECES + (", ids binary" if with_ids else ""))


class Packing:
    """Bins of piece numbers, and how full each is."""

    def __init__(self, bins: list[list[int]], fill: list[int]):
        self.bins, self.fill = bins, fill
        self.score = (len(bins), -sum(f * f for f in fill))


def best_fit(bins: list[list[int]], fill: list[int], pieces: list[int], lengths: list[int], capacity: int) -> Packing:
    """Puts each piece, in the given order, into the bin that it leaves least room in. Bins are found by what they have left, in one step."""
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: there is a bin with r left
    for b, f in enumerate(fill):
        if f < capacity:
            left[capacity - f].append(b)
            open_ |= 1 << (capacity - f)
    for p in pieces:
        need = lengths[p]
        fits = open_ >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = left[room].pop()
            if not left[room]:
                open_ ^= 1 << room
            bins[b].append(p)
        else:
            room, b = capacity, len(bins)
            bins.append([p])
            fill.append(0)
        fill[b] += need
        if room > need:
            left[room - need].append(b)
            open_ |= 1 << (room - need)
    return Packing(bins, fill)


def crossover(one: Packing, two: Packing, lengths: list[int], capacity: int, rng: random.Random) -> Packing:
    """one, with some of two's well-filled bins injected."""
    full = [b for b, f in enumerate(two.fill) if f >= WELL_FILLED * capacity]
    full.sort(key=lambda b: (-two.fill[b], rng.random()))
    inject = rng.sample(full[: max(1, len(full) // 2)], min(len(full), max(1, len(full) // 8))) if full else []
    come = {p for b in inject for p in two.bins[b]}
    bins, fill, displaced = [], [], []
    poor = rng.random()
    for own, f in zip(one.bins, one.fill, strict=True):
        if come.isdisjoint(own) and (f >= WELL_FILLED * capacity or rng.random() < poor):
            bins.append(list(own))
            fill.append(f)
        else:  # it holds a piece that comes again, or is poorly filled
            displaced += [p for p in own if p not in come]
    bins += [list(two.bins[b]) for b in inject]
    fill += [two.fill[b] for b in inject]
    displaced.sort(key=lambda p: -lengths[p] * rng.uniform(0.97, 1.0))
    return best_fit(bins, fill, displaced, lengths, capacity)


def fill_exactly(lengths: list[int], capacity: int, rng: random.Random) -> Packing:
    """Bins that start with the longest piece left and are filled up as far as some of TRIED lengths, longer ones first, can add up to."""
    own: dict[int, list[int]] = {}
    for p, n in enumerate(lengths):
        own.setdefault(n, []).append(p)
    sizes = sorted(own)
    bins, fill = [], []

    def take(n: int) -> int:
        p = own[n].pop()
        if not own[n]:
            del own[n]
            sizes.pop(bisect_left(sizes, n))
        return p

    while sizes:
        room = capacity - sizes[-1]
        bins.append([take(sizes[-1])])
        below = bisect_right(sizes, room)
        tried = sorted(rng.sample(range(below), min(below, TRIED)), reverse=True)
        reach, ways = [1], []
        for n in (sizes[k] for k in tried for _ in range(min(4, len(own[sizes[k]])))):
            reach.append((reach[-1] | reach[-1] << n) & ((2 << room) - 1))
            ways.append(n)
            if reach[-1] >> room:
                break
        at = reach[-1].bit_length() - 1
        fill.append(capacity - room + at)
        for k in range(len(ways), 0, -1):
            if not reach[k - 1] >> at & 1:
                bins[-1].append(take(ways[k - 1]))
                at -= ways[k - 1]
    return Packing(bins, fill)


def least_bins(lengths, capacity: int = CAPACITY) -> int:
    """A lower bound of the bins that can do: pieces longer than half a bin need one each, and what their bins can't take of the others needs more, whatever short pieces are left out."""
    n = np.bincount(np.asarray(lengths, np.int64), minlength=capacity + 1)[: capacity + 1]
    if not n.sum():
        return 0
    count, total = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * np.arange(capacity + 1)))
    half, k = capacity // 2, np.arange(capacity // 2 + 1)
    long_ = count[capacity + 1] - count[half + 1]
    # pieces of half a bin to capacity - k can take others of k at least
    room = (count[capacity - k + 1] - count[half + 1]) * capacity - (total[capacity - k + 1] - total[half + 1])
    return int(long_ + max(0, (-(-(total[half + 1] - total[k] - room) // capacity)).max()))


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> Packing:
    return best_fit([], [], sorted(range(len(lengths)), key=lambda p: -lengths[p]), lengths, capacity)


def of_bins(bins, lengths: list[int]) -> Packing:
    """The packing that puts each piece in the bin of that number."""
    out: dict[int, list[int]] = {}
    for p, b in enumerate(bins):
        out.setdefault(b, []).append(p)
    return Packing(list(out.values()), [sum(lengths[p] for p in own) for own in out.values()])


def population(start: Packing, lengths: list[int], capacity: int, rng: random.Random) -> list[Packing]:
    """An island's first packings: the plain one, one of exact fills, and best fits in disturbed orders."""
    order = sorted(range(len(lengths)), key=lambda p: -lengths[p])
    out = [start, fill_exactly(lengths, capacity, rng)]
    for k in range(PACKINGS - 2):
        out.append(best_fit([], [], sorted(order, key=lambda p: -lengths[p] * rng.uniform(0.85 + 0.1 * k, 1.0)), lengths, capacity))
    return out


def epoch(packings: list[Packing], lengths: list[int], capacity: int, rng: random.Random, least: int, generations: int = GENERATIONS) -> list[Packing]:
    """An island's packings after so many generations, the best first. It stops where the bound is met."""
    packings = sorted(packings, key=lambda p: p.score)
    for _ in range(generations):
        if packings[0].score[0] <= least or len(packings) < 2:
            break
        one, two = sorted(rng.sample(packings, 2), key=lambda p: p.score)
        child = min(crossover(one, two, lengths, capacity, rng), crossover(two, one, lengths, capacity, rng), key=lambda p: p.score)
        if child.score < packings[-1].score:
            packings = sorted([*packings[:-1], child], key=lambda p: p.score)
    return packings[:PACKINGS]


def _numbers(found: Packing, n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for b, own in enumerate(found.bins):
        out[own] = b
    return out


def _plain(capacity: int):
    """The shard with at (number of a piece in it), bin (of the plain best fit) and whether that may be too many bins."""

    def run(key: tuple, shard: pa.Table) -> pa.Table:
        lengths = shard.column("length").to_pylist()
        found = best_fit_decreasing(lengths, capacity)
        n, open_ = shard.num_rows, len(found.bins) > least_bins(lengths, capacity)
        for name, values in (("at", np.arange(n, dtype=np.int32)), ("bin", _numbers(found, n)), ("open", np.full(n, open_))):
            shard = shard.append_column(name, pa.array(values))
        return shard

    return run


def _island(capacity: int, number: int):
    """One epoch of one island: its row (shard, island, lengths, packings: the bin of each piece), and the elite that comes from the island before."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, island = key
        rows = rows.sort_values("elite")
        lengths = [int(n) for n in rows["lengths"].iloc[0]]
        rng = random.Random(f"{shard} {island} {number}")
        packings = [of_bins([int(b) for b in bins], lengths) for own in rows["packings"] for bins in own]
        if number == 0:
            packings = population(packings[0], lengths, capacity, rng)
        least = least_bins(lengths, capacity)
        packings = epoch(packings, lengths, capacity, rng, least)
        bins = [_numbers(p, len(lengths)) for p in packings]
        return pd.DataFrame([(shard, island, False, np.array(lengths, np.int32), bins, packings[0].score[0], packings[0].score[1], least)], columns=["shard", "island", "elite", "lengths", "packings", "n", "square", "least"])

    return run


_STATE = "shard long, island int, elite boolean, lengths array<int>, packings array<array<int>>, n int, square long, least int"


def evolved(shards: DataFrame, capacity: int, folder: str, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """shard, at, bin: the best packing that a shard's islands find, for each piece of shards (shard, at, length, bin).

    A row of the state is an island (of no more than some thousand pieces), and a task of its own; after each epoch the rows are written,
    and the elite of each island goes to the next one through the shuffle."""
    own = shards.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("at", F.col("length").cast("int").alias("length"), "bin"))).alias("p"))
    zero = F.lit(0).cast("int")
    state = own.select(
        "shard", F.explode(F.array(*[F.lit(i).cast("int") for i in range(islands)])).alias("island"), F.lit(False).alias("elite"), F.col("p.length").alias("lengths"), F.array("p.bin").alias("packings"), zero.alias("n"), zero.cast("long").alias("square"), zero.alias("least")
    )
    for k in range(epochs):
        if k:
            moved = state.withColumns({"island": ((F.col("island") + 1) % islands).cast("int"), "elite": F.lit(True), "packings": F.slice("packings", 1, 1)})
            state = state.unionByName(moved)
        state = written(state.groupBy("shard", "island").applyInPandas(_island(capacity, k), _STATE), f"epoch{k}", folder)
        best = state.groupBy("shard").agg(F.min(F.struct("n", "square", "island")).alias("b"), F.first("least").alias("least"))
        if not best.where("b.n > least").head(1):
            break
    best = best.select("shard", F.col("b.island").alias("island"))
    return state.join(best, ["shard", "island"]).select("shard", F.posexplode(F.element_at("packings", 1)).alias("at", "bin"))


def packed(pieces: DataFrame, capacity: int, folder: str, size: int = SHARD, **islands: int) -> DataFrame:
    """pieces with shard, bin (in the shard) and filled (tokens of the bin) after plain best fit and, where that may be too many bins, evolution."""
    shards = max(1, -(-pieces.count() // size))
    # repeated rows are told apart by where they are written, so that they are dealt out too
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, {PIECES}, shard long, at int, bin int, open boolean"
    plain = written(dealt.groupBy("shard").applyInArrow(_plain(capacity), shape), "plain", folder)
    still = plain.where("open")
    found = plain.where("NOT open").drop("open", "at")
    if still.head(1):
        better = evolved(still, capacity, folder, **islands)
        found = found.unionByName(still.drop("bin", "open").join(better, ["shard", "at"]).drop("at").select(found.columns))
    bins = found.groupBy("shard", "bin").agg(F.sum("length").alias("filled"))
    return written(found.join(bins, ["shard", "bin"]), "packed", folder)


def pack(pieces: DataFrame, capacity: int = CAPACITY, size: int = SHARD, **islands: int) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    folder = shared_dir(pieces.sparkSession)
    pieces = written(pieces, "pieces", folder)
    names = pieces.columns
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": F.lit(1 << 62) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    one = packed(pieces.where(F.col("length") < capacity), capacity, f"{folder}/one", size, **islands)
    rest = written(one.where(F.col("filled") < WELL_FILLED * capacity).select(names), "rest", folder)
    two = packed(rest, capacity, f"{folder}/two", size, **islands)
    before = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "piece", "ids_crc32"))
    out = full
    for first, rows in ((0, one.where(F.col("filled") >= WELL_FILLED * capacity)), (1 << 61, two)):
        # a bin has no more rows than capacity, so its window is bounded
        rows = rows.withColumn("k", before)
        at = F.sum("length").over(Window.partitionBy("shard", "bin").orderBy("k")) - F.col("length")
        number = F.lit(first) + F.shiftleft("shard", 20) + F.col("bin")
        out = out.unionByName(rows.select(*names, number.alias("sequence_id"), at.alias("offset")))
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(tokenized(columns(docs, doc_id=id_col, text=text_col), path, capacity), capacity)


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """sequence_id, ids (4 bytes each, least first): the packed sequences themselves, from pieces with ids and from where they were put."""
    own = packed.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    return own.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
