"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Pieces that fill a sequence alone need no search. The others are dealt by hash into shards of about
``SHARD`` pieces; each shard's population lives on ``ISLANDS`` islands that evolve on their own and
pass their elite to the next island between rounds. An individual is a set of bins (groups):
crossover injects whole well-filled bins of one parent into the other, removes the bins that now
hold duplicates, lets displaced pieces replace one or two smaller ones where that fills a bin better,
and best-fits the rest. Where best fit alone meets the lower bound, which it does on most corpora,
there is nothing to search and no child is bred.

Bins that stay under-filled are opened again and their pieces packed with those of other shards,
level by level. What counts as under-filled goes from more than ``SLACK`` free places to more than half
a sequence; of the latter a shard has one bin at most, so pieces become few and the last level is one
shard. A piece is a small row: texts and ids are never shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm import kernel
from hearthline.llm.common import materialise
from hearthline.llm.tokens import encoder

CAPACITY = 2048
SHARD, ISLANDS, ROUNDS = 4096, 3, 2
POPULATION, GENERATIONS, PATIENCE = 5, 24, 5
#: A bin with at most so many free places is not opened again at the first level; at each level four times as many.
SLACK = 4
PIECES = "piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and a closing 0, cut only where longer than ``capacity``."""
    path = tokenizer or tokenizer_path()

    def cut(batches):
        codec = encoder(path)
        for batch in batches:
            raw, offsets = kernel.utf8(batch.column(1))
            raw = raw.tobytes()
            for a, b in kernel.slices(offsets, 1 << 20):
                rows = []
                for k, ids in zip(range(a, b), codec.encode([raw[offsets[i] : offsets[i + 1]] for i in range(a, b)]), strict=True):
                    ids += b"\0\0\0\0"
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((k, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                place, *rest = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                columns = [batch.column(0).take(pa.array(place)), *map(pa.array, rest)]
                columns[1] = columns[1].cast(pa.int32())
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(kernel.tidy(cut), f"doc_id {kind}, {PIECES}")


# --- the search within one shard -------------------------------------------------------------------


def best_fit(sizes: np.ndarray, items, bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Puts ``items`` (in their order) into the fullest bin that still has room, opening bins as needed.

    Bins are kept by room, and a bit mask says which rooms exist.
    """
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        if r:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r
    for item in items:
        size = int(sizes[item])
        fitting = mask >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            held = by_room[r]
            b = held.pop()
            if not held:
                mask ^= 1 << r
        else:
            r, b = capacity, len(bins)
            bins.append([])
            room.append(capacity)
        bins[b].append(item)
        room[b] = r = r - size
        if r:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r


class Shard:
    """Populations for one set of sizes."""

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int):
        self.sizes, self.capacity = sizes, capacity
        self.random = np.random.default_rng(seed)
        self.least = -(-int(sizes.sum()) // capacity)

    def cost(self, one) -> tuple[int, int]:
        """Fewer bins first; among equals, the one whose bins are more unevenly (so better) filled."""
        return len(one[1]), -sum((self.capacity - r) ** 2 for r in one[1])

    def built(self, noise: float) -> tuple[list[list[int]], list[int]]:
        order = np.argsort(-self.sizes * (1 + noise * self.random.random(len(self.sizes))), kind="stable").tolist()
        bins: list[list[int]] = []
        room: list[int] = []
        best_fit(self.sizes, order, bins, room, self.capacity)
        return bins, room

    def child(self, a, b):
        """``a`` with some of the best bins of ``b`` in it."""
        full = [k for k, r in enumerate(b[1]) if r <= self.capacity // 64]
        if not full:
            full = np.argsort(b[1])[: max(1, len(b[1]) // 4)].tolist()
        chosen = [k for k in full if self.random.random() < 0.5] or full[:1]
        brought = {item for k in chosen for item in b[0][k]}
        bins, room = [list(b[0][k]) for k in chosen], [b[1][k] for k in chosen]
        displaced = []
        worst = set(np.argsort(-np.array(a[1]))[: 1 + len(a[1]) // 100].tolist())  # the mutation: open the emptiest bins
        for k, held in enumerate(a[0]):
            if k in worst or not brought.isdisjoint(held):
                displaced += [i for i in held if i not in brought]
            else:
                bins.append(list(held))
                room.append(a[1][k])
        displaced = self.replaced(bins, room, displaced)
        best_fit(self.sizes, displaced, bins, room, self.capacity)
        return bins, room

    def replaced(self, bins: list[list[int]], room: list[int], displaced: list[int]) -> list[int]:
        """Puts displaced items in the place of one or two smaller ones of a bin where they fill it better.

        Returns the items that are displaced then, largest first.
        """
        size = self.sizes.tolist()
        out = sorted(displaced, key=size.__getitem__)
        keys = [size[i] for i in out]
        for b in sorted((b for b, r in enumerate(room) if r), key=room.__getitem__, reverse=True):
            held, free = bins[b], room[b]
            if not keys:
                break
            singles = [(size[i], (i,)) for i in held]
            pairs = [(x + y, (*i, *j)) for k, (x, i) in enumerate(singles) for y, j in singles[k + 1 :]] if len(held) <= 12 else []
            gain, best, spot = 0, (), -1
            for total, items in singles + pairs:
                k = bisect_right(keys, total + free) - 1
                if k >= 0 and keys[k] - total > gain:
                    gain, best, spot = keys[k] - total, items, k
            if gain:
                held.append(out.pop(spot))
                del keys[spot]
                for i in best:
                    held.remove(i)
                    k = bisect_right(keys, size[i])
                    keys.insert(k, size[i])
                    out.insert(k, i)
                room[b] = free - gain
        return out[::-1]

    def evolve(self, seeds: list) -> list:
        """The population after some generations, best first."""
        population = sorted([*seeds, self.built(0.0)], key=self.cost)
        if len(population[0][1]) == self.least:
            return population
        population += [self.built(noise) for noise in (0.02, 0.1, 0.3, 0.6)[: max(0, POPULATION - len(population))]]
        population.sort(key=self.cost)
        still = 0
        for _ in range(GENERATIONS):
            if len(population[0][1]) == self.least or still == PATIENCE:
                break
            before = self.cost(population[0])
            i, j = self.random.choice(len(population), 2, replace=False) if len(population) > 1 else (0, 0)
            population.append(self.child(population[i], population[j]))
            population.append(self.child(population[0], population[max(i, j)]))
            population.sort(key=self.cost)
            del population[POPULATION:]
            still = still + 1 if self.cost(population[0]) == before else 0
        return population


def _dump(one) -> bytes:
    """An individual as item, bin number pairs: the bin of every item."""
    bins = one[0]
    out = np.empty(sum(map(len, bins)), np.int32)
    for k, held in enumerate(bins):
        out[held] = k
    return out.tobytes()


def _load(raw: bytes, sizes: np.ndarray, capacity: int):
    owner = np.frombuffer(raw, np.int32)
    bins: list[list[int]] = [[] for _ in range(int(owner.max()) + 1)] if len(owner) else []
    for item, b in enumerate(owner.tolist()):
        bins[b].append(item)
    return bins, (capacity - np.bincount(owner, sizes, len(bins)).astype(int)).tolist()


STATE = "shard long, island int, uids binary, sizes binary, best binary, least int, bins int"


def _settle(items: DataFrame, capacity: int) -> DataFrame:
    """One state row per shard and island from (uid, length, shard)."""

    def settle(table: pa.Table) -> pa.Table:
        uids, sizes = table["uid"].to_numpy(), table["length"].to_numpy()
        order = np.argsort(uids, kind="stable")
        uids, sizes = uids[order], sizes[order]
        shard = table["shard"][0].as_py()
        rows = [(shard, k, uids.tobytes(), sizes.tobytes(), None, 0, 0) for k in range(ISLANDS)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _STATE_TYPES, strict=True)], names=_STATE_NAMES)

    return items.groupBy("shard").applyInArrow(settle, STATE)


_STATE_NAMES = [f.split()[0] for f in STATE.split(", ")]
_STATE_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]


def _round(state: DataFrame, number: int, capacity: int) -> DataFrame:
    """Every island evolves; after the first round with the elite of its neighbour among its population."""

    def evolve(table: pa.Table) -> pa.Table:
        row = table.slice(0, 1).to_pylist()[0]
        sizes = np.frombuffer(row["sizes"], np.int64)
        shard = Shard(sizes, capacity, abs(row["shard"]) * 1009 + row["island"] * 31 + number)
        seeds = [_load(x, sizes, capacity) for x in sorted({x for x in table["best"].to_pylist() if x is not None})]
        best = shard.evolve(seeds)[0]
        row |= {"best": _dump(best), "least": shard.least, "bins": len(best[1])}
        return pa.table([pa.array([row[n]], t) for n, t in zip(_STATE_NAMES, _STATE_TYPES, strict=True)], names=_STATE_NAMES)

    if number:
        moved = state.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
        state = state.unionByName(moved)
    return state.groupBy("shard", "island").applyInArrow(evolve, STATE)


def _placed(state: DataFrame, capacity: int) -> DataFrame:
    """(uid, shard, bin, offset, room) by the best island of each shard."""
    best = state.groupBy("shard").agg(F.min_by(F.struct("uids", "sizes", "best"), F.struct("bins", "island")).alias("b")).select("shard", "b.*")

    def place(batches):
        for batch in batches:
            for row in batch.to_pylist():
                uids, sizes, owner = (np.frombuffer(row[n], t) for n, t in (("uids", np.int64), ("sizes", np.int64), ("best", np.int32)))
                order = np.lexsort((uids, owner))
                ends = np.cumsum(sizes[order])
                fill = np.bincount(owner, sizes).astype(np.int64)
                before = np.cumsum(fill) - fill
                offset = np.empty(len(uids), np.int64)
                offset[order] = ends - sizes[order] - before[owner[order]]
                columns = [uids, np.full(len(uids), row["shard"]), owner.astype(np.int64), offset, capacity - fill[owner]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["uid", "shard", "bin", "offset", "room"])

    return best.mapInArrow(place, "uid long, shard long, bin long, offset long, room long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_size: int = SHARD) -> DataFrame:
    """``pieces`` (with a long ``uid`` and ``length``) plus sequence_id and offset.

    Every piece is placed once; a sequence's pieces lie one after another from 0. No piece is longer
    than ``capacity``. Levels: the bins that fall short are opened and packed across shards.
    """
    spark = pieces.sparkSession
    whole = pieces.where(F.col("length") >= capacity)
    whole = whole.withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    left = pieces.where(F.col("length") < capacity).select("uid", "length")
    count, level, homes = left.count(), 0, []
    while count:
        shards = max(1, -(-count // shard_size))
        items = left.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)))
        state = _settle(items, capacity)
        for number in range(ROUNDS):
            state = materialise(_round(state, number, capacity), "islands")
        placed = materialise(_placed(state, capacity), "placed")
        final = F.lit(True) if shards == 1 else F.col("room") <= min(SLACK << 2 * level, capacity // 2)
        number = F.lit(level << 56) + (F.col("shard") * (1 << 20)) + F.col("bin")
        homes.append(placed.where(final).select("uid", number.alias("sequence_id"), "offset"))
        left = materialise(left.join(placed.where(~final).select("uid"), "uid"), "left")
        count = left.count()
        level += 1
    if not homes:
        return whole.drop("uid")
    places = homes[0]
    for home in homes[1:]:
        places = places.unionByName(home)
    return whole.unionByName(pieces.where(F.col("length") < capacity).join(places, "uid").select(*whole.columns)).drop("uid")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    Null and empty texts are the closing id alone; rows that repeat are packed each; null ids pass
    through; an empty table packs nothing. Longer texts than a sequence are the only ones cut.
    """
    cut = cut_pieces(docs, id_col, text_col, tokenizer, capacity)
    pieces = materialise(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, capacity)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
