"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are encoded once where they are read; from then on only piece ids and lengths move. A
piece of the full capacity is a sequence; the others are dealt at random to shards of a few thousand.
Each shard is packed by several islands: a population, whose first members best-fit the pieces in
random order, evolves by grouping crossover, which injects whole well-filled sequences of one parent
into the other, removes the pieces that this doubles, and best-fits the displaced ones. Between
epochs an island's elite moves to the next island of the ring. The best packing of a shard stands,
but for its badly filled sequences: their pieces of all shards are packed again together, until one
shard is left, so sharding costs next to nothing.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweft.llm.arrow import bounded, relax
from roadweft.llm.columns import named
from roadweft.llm.tokens import Encoder, slices
from roadweft.session import materialize

CAPACITY = 2048
SHARD_PIECES = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
#: Per epoch.
GENERATIONS = 20
RELEASE = 0.97
END_ID = 0
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

Packing = list[list[int]]


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """PIECES of every whole text: its ids and a closing 0, cut every ``capacity`` ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        relax()  # of what earlier stages left
        encoder, closing = Encoder.of(tokenizer, "words"), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            texts, keys = batch.column(1), batch.column(0).to_pylist()
            for first, stop in slices(texts):
                ids, counts = encoder.ids(texts.slice(first, stop - first))
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                sizes = counts + 1  # with the closing id
                many = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                begin = (np.cumsum(counts) - counts)[doc] + start
                end = begin + length - (start + length == sizes[doc])
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist())]
                for k in np.flatnonzero(start + length == sizes[doc]).tolist():
                    crc[k] = zlib.crc32(closing, crc[k])
                own = pa.array(keys[first:stop], pa.int64()).take(pa.array(doc))
                columns = [own, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PIECES.split(", ")])
        relax()

    return docs.select(named(doc_id).cast("bigint").alias("doc_id"), named(text).cast("string").alias("text")).mapInArrow(pieces, PIECES)


class _Filled(list):
    """A sequence that knows its fill; never changed once its packing is made."""

    __slots__ = ("fill",)


class _Rooms:
    """Sequences by the room they have left; the tightest that fits is found by a bit trick."""

    def __init__(self, sequences: Packing, sizes: list[int], capacity: int) -> None:
        self.sequences, self.capacity = sequences, capacity
        self.own: set[int] = set()
        self.at: dict[int, list[int]] = {}
        self.mask = 0
        for k, sequence in enumerate(sequences):
            self._put(k, capacity - _fill(sequence, sizes))

    def _put(self, k: int, room: int) -> None:
        places = self.at.get(room)
        if places:
            places.append(k)
            return
        if places is None:
            self.at[room] = [k]
        else:
            places.append(k)
        self.mask |= 1 << room

    def best_fit(self, item: int, size: int) -> None:
        fits = self.mask >> size
        if not fits:
            k, room, sequence = len(self.sequences), self.capacity, _Filled()
            self.own.add(k)
            self.sequences.append(sequence)
        else:
            room = size + (fits & -fits).bit_length() - 1
            places = self.at[room]
            k = places.pop()
            if not places:
                self.mask &= ~(1 << room)
            sequence = self.sequences[k]
            if k not in self.own:  # other packings share it
                sequence = self.sequences[k] = _Filled(sequence)
                self.own.add(k)
        sequence.append(item)
        sequence.fill = self.capacity - room + size
        self._put(k, room - size)


def best_fit(items: list[int], sizes: list[int], capacity: int, sequences: Packing | None = None) -> Packing:
    """Add items to sequences in the order given, each to the tightest that has room."""
    packed = list(sequences or [])
    rooms = _Rooms(packed, sizes, capacity)
    for i in items:
        rooms.best_fit(i, sizes[i])
    return packed


def _fill(sequence: list[int], sizes: list[int]) -> int:
    return sequence.fill if type(sequence) is _Filled else sum(map(sizes.__getitem__, sequence))


def _filled(sequence: list[int], sizes: list[int]) -> _Filled:
    out = _Filled(sequence)
    out.fill = _fill(sequence, sizes)
    return out


def fitness(packing: Packing, sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then the more unevenly filled, which leaves room to improve."""
    return -len(packing), sum((_fill(s, sizes) / capacity) ** 2 for s in packing)


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Inject some of b's best-filled sequences whole into a; a's sequences that share a piece with
    them dissolve, and what is displaced is best-fitted again, longest first."""
    filled = sorted(b, key=lambda s: -_fill(s, sizes))
    pool = filled[: max(1, (3 * len(filled)) // 4)]
    injected = rng.sample(pool, max(1, len(pool) // 2))
    doubled = {i for s in injected for i in s}
    kept, displaced = [], []
    for s in a:
        if doubled.isdisjoint(s):
            kept.append(s)
        else:
            displaced += [i for i in s if i not in doubled]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(displaced, sizes, capacity, injected + kept)


def mutate(packing: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Dissolve the worst-filled sequences and some others, and best-fit their pieces again."""
    order = sorted(packing, key=lambda s: _fill(s, sizes))
    n = max(2, len(order) // 20)
    gone = order[:n] + [s for s in order[n:] if rng.random() < 0.02]
    ids = {id(s) for s in gone}
    loose = sorted((i for s in gone for i in s), key=lambda i: -sizes[i])
    return best_fit(loose, sizes, capacity, [s for s in packing if id(s) not in ids])


class Member(NamedTuple):
    """A packing of the population, by what it was made and in which generation."""

    packing: Packing
    by: str
    generation: int


def evolve(
    sizes: list[int], capacity: int, seed: int, start: Sequence[Member] = (), population: int = POPULATION, generations: int = GENERATIONS, since: int = 0
) -> Member:
    """The best packing that an island finds from ``start``, or from best-fitting the pieces in
    random orders; it stops where the lower bound ceil(sum / capacity) is met. Generations count
    from ``since``."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    pool = [m._replace(packing=[_filled(s, sizes) for s in m.packing]) for m in start]
    while len(pool) < population and not start:
        pool.append(Member(best_fit(rng.sample(range(len(sizes)), len(sizes)), sizes, capacity), "start", 0))
    scored = sorted(((fitness(m.packing, sizes, capacity), -m.generation, m) for m in pool), key=lambda m: m[:2], reverse=True)
    for generation in range(since + 1, since + generations + 1):
        if len(scored[0][2].packing) <= least:
            break
        a = scored[0][2].packing
        b = scored[rng.randrange(1, len(scored))][2].packing if len(scored) > 1 else a
        for by, child in (("crossover", crossover(a, b, sizes, capacity, rng)), ("crossover", crossover(b, a, sizes, capacity, rng)), ("mutation", mutate(a, sizes, capacity, rng))):
            scored.append((fitness(child, sizes, capacity), -generation, Member(child, by, generation)))
            if len(child) <= least:
                break
        scored = sorted(scored, key=lambda m: m[:2], reverse=True)[:population]
    return scored[0][2]


def _packing_of(sequence: pd.Series) -> Packing:
    """Row positions by sequence number."""
    order = np.argsort(sequence.to_numpy(), kind="stable")
    values = sequence.to_numpy()[order]
    return [list(map(int, part)) for part in np.split(order, np.flatnonzero(np.diff(values)) + 1)]


def _assigned(packing: Packing, n: int) -> np.ndarray:
    at = np.empty(n, dtype=np.int64)
    for k, s in enumerate(packing):
        at[s] = k
    return at


def _island(capacity: int, epoch: int, seed: int):
    def step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, island = key
        # a piece comes once, or with the own elite's and the neighbour's sequence
        rows = rows.sort_values(["uid", "origin"], kind="stable")
        own = rows[rows.origin == rows.origin.iloc[0]].reset_index(drop=True)
        parts = [rows[rows.origin == o] for o in sorted(rows.origin.unique()) if o >= 0]
        start = [Member(_packing_of(p.sequence), p["by"].iloc[0], int(p.generation.iloc[0])) for p in parts]
        sizes = own.length.astype(int).tolist()
        best = evolve(sizes, capacity, zlib.crc32(f"{seed}:{shard}:{island}:{epoch}".encode()), start, since=epoch * GENERATIONS)
        return pd.DataFrame({"shard": shard, "island": int(island), "uid": own.uid, "length": own.length, "sequence": _assigned(best.packing, len(sizes)), "by": best.by, "generation": best.generation})

    return step


_STATE = "shard bigint, island int, uid bigint, length bigint, sequence bigint, by string, generation int"
_PACKED = "shard bigint, uid bigint, length bigint, sequence bigint, fill bigint, offset bigint, by string, generation int"


def pack_level(items: DataFrame, shards: int, capacity: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """_PACKED: the best packing of each shard, by what it was found and in which generation."""
    dealt = items.select("uid", "length", F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(shards)).alias("shard"))
    everywhere = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    state = everywhere.select("*", F.lit(-1).alias("origin"), F.lit(-1).cast("bigint").alias("sequence"), F.lit("").alias("by"), F.lit(0).alias("generation"))
    for epoch in range(epochs):
        state = materialize(state.groupBy("shard", "island").applyInPandas(_island(capacity, epoch, seed), _STATE), "islands")
        if epoch + 1 < epochs:  # the elites of an island and of the one before it in the ring
            here = state.withColumn("origin", F.lit(0))
            come = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")).withColumn("origin", F.lit(1))
            state = here.unionByName(come)

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = rows.groupby("island").sequence.nunique()
        best = rows[rows.island == counts.index[int(np.argmin(counts.to_numpy()))]].sort_values(["sequence", "uid"])
        grouped = best.groupby("sequence").length
        best = best.assign(fill=grouped.transform("sum"), offset=grouped.cumsum() - best.length)
        relax()
        return best[[f.split()[0] for f in _PACKED.split(", ")]]

    return materialize(state.groupBy("shard").applyInPandas(choose, _PACKED), "packed")


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    shard_pieces: int = SHARD_PIECES,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    release: float = RELEASE,
    seed: int = 7,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """PIECES with sequence_id, offset, found_by and generation: every document's ids in sequences of
    ``capacity`` at most.

    Only documents longer than a sequence are cut, each piece full but the last. Sequence ids are
    unique, offsets gapless from 0. found_by and generation say what made the packing that a sequence
    is from: full (a piece of the full capacity, which needs no packing), start (best fit in random
    order), crossover or mutation. Pieces of sequences filled below ``release`` are packed again,
    unless they are over half of a level's.

    Defined cases: null and empty texts are the closing id alone; long texts are cut whole; repeated
    rows and rows that share an id are packed each; ties of length fall by row; null ids are kept; an
    empty table gives an empty result; other columns are not read. Memory is bounded by
    ``shard_pieces``.
    """
    bounded(docs.sparkSession)
    pieces = materialize(cut(docs, tokenizer, capacity, doc_id, text).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = pieces.filter(F.col("length") == capacity)
    parts = [full.select(F.col("uid").alias("_uid"), (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.lit("full").alias("found_by"), F.lit(0).alias("generation"))]
    items, level = pieces.filter(F.col("length") < capacity).select("uid", "length"), 0
    while n := items.count():
        shards = max(1, -(-n // shard_pieces))
        packed = pack_level(items, shards, capacity, islands, epochs, seed + level)
        low = F.col("fill") < int(release * capacity)
        # a level that frees most of its pieces is as good as packing gets
        again = shards > 1 and packed.filter(low).count() <= n // 2
        done = packed.filter(~low) if again else packed
        number = F.lit(level << 56) + F.col("shard") * (1 << 24) + F.col("sequence")
        parts.append(done.select(F.col("uid").alias("_uid"), number.cast("bigint").alias("sequence_id"), F.col("offset").cast("bigint").alias("offset"), F.col("by").alias("found_by"), "generation"))
        if not again:
            break
        items, level = packed.filter(low).select("uid", "length"), level + 1
    placed = parts[0]
    for part in parts[1:]:
        placed = placed.unionByName(part)
    return pieces.join(placed.hint("merge"), F.col("uid") == F.col("_uid")).drop("uid", "_uid")
