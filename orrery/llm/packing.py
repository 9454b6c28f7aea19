"""Packing of token sequences: a grouping genetic algorithm on islands, block by block, and again over what stays open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.lineage import dropped, written
from orrery.llm.text_encoder import TextEncoder, vocabulary

#: Pieces that are packed together.
BLOCK = 16384
#: Islands of a block, packings on an island, rounds between which the best ones migrate, generations of a round.
ISLANDS, PACKINGS, MIGRATIONS, GENERATIONS = 2, 6, 2, 16
#: Share of a sequence that may stay free before the next level packs its pieces again.
OPEN = 0.004
#: Documents whose pieces travel back at a time.
SLICE = 256


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts as pieces of at most ``capacity`` token ids, each text's ids followed by the id ``end``.

    Only a text of more than ``capacity`` ids is cut, into pieces of that many; its first piece takes what is over. Special
    tokens that a text spells out are taken as such. Returns one row per piece: ``id, piece`` (from 0), ``start`` (ids
    before it), ``length, ids`` (binary, little-endian unsigned 32-bit). A null or empty text is one piece of the id
    ``end``. Ids of documents may be null or repeat; no rows give no rows; other columns are ignored, whatever their names.
    No shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = TextEncoder(model.value)
        last = np.array([end], "<u4")
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                out = []
                for key, text in zip(batch["id"].iloc[at : at + SLICE], batch["text"].iloc[at : at + SLICE], strict=True):
                    ids = np.concatenate([encoder.encode(text), last]) if text else last
                    over = len(ids) % capacity if len(ids) > capacity else 0
                    cuts = [0, *range(over or min(capacity, len(ids)), len(ids), capacity), len(ids)]
                    out += [(key, k, a, b - a, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInPandas(run, "id string, piece int, start long, length long, ids binary")
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


class Open:
    """Bins with room, by the room that they have; the fullest that a piece fits into is found by one shift of a bit set."""

    def __init__(self, capacity: int, rooms: dict[int, int] | None = None):
        self.capacity, self.bits = capacity, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        for b, room in (rooms or {}).items():
            self.at[room].append(b)
            self.bits |= 1 << room

    def best(self, size: int, new: int) -> int:
        """The bin that takes a piece of this size; ``new`` if none has the room."""
        fits = self.bits >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = self.at[room]
            b = own.pop()
            if not own:
                self.bits ^= 1 << room
        else:
            room, b = self.capacity, new
        if left := room - size:
            if not self.at[left]:
                self.bits |= 1 << left
            self.at[left].append(b)
        return b


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, bins: np.ndarray, loads: np.ndarray) -> np.ndarray:
    """``bins`` with the pieces of ``order`` placed, one after the other, into the bins of these loads or new ones."""
    room = capacity - loads
    free = np.flatnonzero((room > 0) & (loads > 0))
    rooms = Open(capacity, dict(zip(free.tolist(), room[free].tolist(), strict=True)))
    bins, new = bins.copy(), len(loads)
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        b = rooms.best(size, new)
        new += b == new
        bins[i] = b
    return bins


def loads_of(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(bins, sizes).astype(np.int64)


def renumbered(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """The mean square of the bins' fills: of packings into equally many bins, that with the fuller ones is better."""
    loads = loads_of(bins, sizes)
    return float(((loads / capacity) ** 2).sum() / len(loads)) if len(loads) else 1.0


def crossed(sizes: np.ndarray, into: np.ndarray, giver: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A packing that takes whole well-filled bins of ``giver`` into ``into``.

    Bins of ``into`` that hold a piece of an injected bin go, as do some of its emptiest; the pieces that lose their place
    are fitted best into the bins with room, the longest first. Injected bins are among the fullest fourth of ``giver``, and
    bins that both have alike are left alone.
    """
    loads, given = loads_of(into, sizes), loads_of(giver, sizes)
    full = given >= np.quantile(given, 0.75)
    chosen = full & (rng.random(len(given)) < rng.uniform(0.05, 0.3))
    # A bin of the giver is alike if all its pieces, and no others, are in one bin.
    low, high = np.full(len(given), len(loads)), np.full(len(given), -1)
    np.minimum.at(low, giver, into)
    np.maximum.at(high, giver, into)
    chosen &= (low != high) | (loads[np.minimum(low, len(loads) - 1)] != given)
    brought = chosen[giver]
    gone = np.zeros(len(loads), bool)
    gone[into[brought]] = True
    open_bins = np.flatnonzero(loads < capacity)
    gone[open_bins[np.argsort(loads[open_bins], kind="stable")[: rng.integers(1, 2 + len(open_bins) // 8)]]] = True
    out = np.where(brought, len(loads) + giver, into)
    lost = np.flatnonzero(~brought & gone[into])
    room = np.concatenate([np.where(gone, 0, loads), np.where(chosen, given, 0)])
    order = lost[np.lexsort((rng.random(len(lost)), -sizes[lost]))]
    return renumbered(best_fit(sizes, order, capacity, out, room))


def settled(sizes: np.ndarray, capacity: int, count: int, rng: np.random.Generator) -> list[np.ndarray]:
    """First packings: best fit of the longest first, and of orders that stray from it."""
    out = []
    for k in range(count):
        order = np.argsort(-sizes * (1 + 0.25 * k / count * rng.random(len(sizes))), kind="stable")
        out.append(renumbered(best_fit(sizes, order, capacity, np.zeros(len(sizes), np.int64), np.zeros(0, np.int64))))
    return out


def evolved(sizes: np.ndarray, packings: list[np.ndarray], capacity: int, generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The packings after some generations, best first: each of the better half is crossed with another one, and a child
    takes the place of the worst packing if it is better. Ends early where no fewer bins are possible."""
    ranked = sorted(((fitness(sizes, p, capacity), -k, p) for k, p in enumerate(packings)), key=lambda x: x[:2], reverse=True)
    least = -(-int(sizes.sum()) // capacity)
    for _ in range(generations):
        if not len(sizes) or int(ranked[0][2].max()) + 1 <= least:
            break
        for k in range(max(1, len(ranked) // 2)):
            other = int(rng.integers(len(ranked) - 1)) if len(ranked) > 1 else 0
            other += other >= k and len(ranked) > 1
            child = crossed(sizes, ranked[k][2], ranked[other][2], capacity, rng)
            score = fitness(sizes, child, capacity)
            if score > ranked[-1][0] and all(score != r[0] for r in ranked):
                ranked[-1] = (score, 0, child)
                ranked.sort(key=lambda x: x[0], reverse=True)
    return [r[2] for r in ranked]


def _seeded(row, turn: int) -> np.random.Generator:
    return np.random.default_rng([int(row.level), int(row.block), int(row.island), turn])


_ISLAND = "level int, block long, island int, uids array<long>, sizes binary, packings array<binary>"


def _island_rounds(capacity: int, count: int, generations: int, turn: int):
    """A round of each island: its packings (the first ones at turn 0) and the immigrant, if any, evolve."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                sizes, rng = np.frombuffer(row.sizes, "<u4").astype(np.int64), _seeded(row, turn)
                if turn == 0:
                    packings = settled(sizes, capacity, count, rng)
                else:
                    packings = [np.frombuffer(p, "<i4") for p in row.packings]
                    if row.immigrant is not None:
                        packings[-1] = np.frombuffer(row.immigrant, "<i4")
                best = evolved(sizes, packings, capacity, generations, rng)
                yield pd.DataFrame([(row.level, row.block, row.island, row.uids, row.sizes, [p.astype("<i4").tobytes() for p in best])], columns=["level", "block", "island", "uids", "sizes", "packings"])

    return run


def _chosen(capacity: int, slack: int):
    """Places of each block's pieces in the best packing of its islands. ``open`` are the pieces in bins with more than
    ``slack`` room, of which the emptiest are taken that hold half of the block's pieces (but one bin at least)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                sizes = np.frombuffer(row.sizes, "<u4").astype(np.int64)
                bins = max((np.frombuffer(p, "<i4") for p in row.best), key=lambda p: fitness(sizes, p, capacity))
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                first = np.concatenate([[True], np.diff(bins[order]) > 0])
                loads = loads_of(bins, sizes)
                wide = np.flatnonzero(capacity - loads > slack)
                wide = wide[np.argsort(loads[wide], kind="stable")]
                held = np.cumsum(np.bincount(bins)[wide])
                again = np.zeros(len(loads), bool)
                again[wide[: max(1, np.searchsorted(held, len(bins) // 2, "right"))]] = True
                base = np.repeat((ends - sizes[order])[first], np.bincount(bins))
                yield pd.DataFrame({"uid": np.asarray(row.uids)[order], "length": sizes[order], "sequence_id": (int(row.level) << 56) + (int(row.block) << 20) + bins[order].astype(np.int64), "offset": ends - sizes[order] - base, "open": again[bins[order]]})

    return run


def _level(items: DataFrame, level: int, blocks: int, capacity: int, islands: int, count: int, migrations: int, generations: int) -> DataFrame:
    """Places of ``items`` (uid, length) after one level: ``uid, length, sequence_id, offset, open``."""
    dealt = items.groupBy(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("m"))
    sizes = F.unhex(F.array_join(F.transform("m.length", lambda n: _little_endian(n)), ""))
    rows = dealt.select(F.lit(level).alias("level"), "block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("m.uid").alias("uids"), sizes.alias("sizes"))
    state = written(rows.mapInPandas(_island_rounds(capacity, count, generations, 0), _ISLAND), "packings")
    for turn in range(1, migrations + 1 if islands > 1 else 1):
        # The best packing of each island goes to the next one of its block.
        leaving = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("packings")[0].alias("immigrant"))
        after = written(state.join(leaving, ["block", "island"], "left").mapInPandas(_island_rounds(capacity, count, generations, turn), _ISLAND), "packings")
        dropped(state)
        state = after
    best = state.groupBy("level", "block").agg(F.first("uids").alias("uids"), F.first("sizes").alias("sizes"), F.collect_list(F.col("packings")[0]).alias("best"))
    out = written(best.mapInPandas(_chosen(capacity, int(capacity * OPEN)), "uid long, length long, sequence_id long, offset long, open boolean"), "placed")
    dropped(state)
    return out


def _little_endian(n):
    """A number below 2**32 as eight hex digits, the lowest byte first."""
    h = F.lpad(F.hex(n), 8, "0")
    return F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))


def packed(pieces: DataFrame, capacity: int = 1024, length_col: str = "length", block: int = BLOCK, islands: int = ISLANDS, count: int = PACKINGS, migrations: int = MIGRATIONS, generations: int = GENERATIONS) -> DataFrame:
    """Pieces put into as few sequences of at most ``capacity`` as a grouping genetic algorithm finds.

    Pieces are dealt by number into blocks of some ``block`` pieces. Several islands pack each block: a packing takes whole
    well-filled sequences of another one, pieces that are then there twice leave their old sequences, and what these held
    besides is fitted best into the room there is. Between rounds each island's best packing migrates to the next island.
    Each block's best packing counts; of the sequences that it leaves open, the emptiest are taken apart and packed again at
    the next level, in half as many blocks or fewer, until one is left. Which pieces meet hangs on their numbers alone, so one
    document, however often it occurs, makes no task larger; a piece of full length is a sequence and is not dealt.

    Returns the columns of ``pieces`` with ``sequence_id`` (any number) and ``offset`` (place in it, gapless from 0). Rows
    are kept one for one, whatever repeats; no rows give no rows. A length that is null, below 1 or above ``capacity`` gets
    nulls. Columns named sequence_id or offset are replaced.
    """
    size = F.col(length_col).cast("long")
    items = written(pieces.drop("sequence_id", "offset").withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    rest = items.where(size.between(1, capacity - 1)).select(F.col("_uid").alias("uid"), size.alias("length"))
    done, level, n = [], 0, rest.count()
    while n:
        blocks = -(-n // block)
        placed = _level(rest, level, blocks, capacity, islands, count, migrations, generations)
        if blocks == 1:
            done.append(placed)
            break
        done.append(placed.where("not open"))
        rest, level = placed.where("open").select("uid", "length"), level + 1
        n = rest.count()
    places = items.where(size == capacity).select("_uid", (-1 - F.col("_uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for d in done:
        places = places.unionByName(d.select(F.col("uid").alias("_uid"), "sequence_id", "offset"))
    return items.join(places, "_uid", "left").drop("_uid")
