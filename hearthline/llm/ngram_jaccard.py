"""N-gram Jaccard join by a token-group matrix.

A token is the 64-bit hash of a word shingle; a document is its set of tokens, and equal sets form
one class from the start. "Exact" below is but for collisions of those hashes. Three steps find the
components of all links between classes:

1. Groups. Minhash bands propose, per bucket, links to the bucket's smallest document; those that
   hold exactly are kept. Their components are the groups, so a huge family of near copies is a few
   groups and never a bucket's pairs. What the bands miss is left to the next steps.
2. Token-group matrix. Tokens are ordered by how many prefixes share them. Of two linked sets, the
   first token in common lies in the larger one's prefix of ``n - ceil(0.8 n) + 1`` tokens and so
   early in the smaller one that the tokens from there on can still be enough (``reach``). The matrix
   keeps, per token and group, the bounds of its members; groups meet where a row has both, by those
   bounds. Documents of one template that are too different to link meet nowhere: their own tokens
   come first and the template's too late.
3. The members of the smaller of two groups that meet are queries against the larger one. The tokens
   a query finds in the group's rows bound its overlap with every set of it; groups that qualify are
   opened block by block, each behind a second bound by the block's whole token union, and members of
   qualified blocks are compared exactly.

The links of 1 and 3 give the final components. Texts are never shuffled, and only candidates' sets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm import kernel
from hearthline.llm.common import Scratch, materialise
from hearthline.llm.components import components

SHINGLE = 5
NUMERATOR, DENOMINATOR = 80, 100
BANDS, ROWS = 8, 2
#: Documents in a block of a group; a block's token union is what a query is bounded against.
BLOCK = 32
#: Heads of a bucket by the order of a hash, besides its most central class.
HEADS = 3
#: Proposals whose minhashes agree in fewer places than this are not compared (the matrix finds what that misses).
AGREE = 8
#: Places of the broadcast tables, as powers of two, whatever the corpus: token levels (LEVEL_WIDTH bits each), bits of shared tokens, bits of rows.
LEVEL_BITS, LEVEL_WIDTH, SHARED_BITS, ROW_BITS = 26, 2, 26, 24
#: A token is locally frequent in this many documents of a task, and frequent in this many overall.
LOCAL, OVERALL = 3, 24
#: Prefixes are counted, and cut anew with shared tokens later in the order, this often.
REFINE = 2
#: Candidates of one document that share a task when sets are joined to pairs.
PER_SALT = 256


def _tokens(column: pa.Array, size: int):
    """(row, sorted distinct tokens) of every text that has words; a text with fewer words than a shingle is one token."""
    raw, offsets = kernel.utf8(column)
    for a, b in kernel.slices(offsets):
        starts, ends, first = kernel.find_words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], kernel.WHITE)
        words = kernel.hash_words(raw[offsets[a] : offsets[b]], starts, ends)
        grams = kernel.combine(words, size)
        for k in range(b - a):
            n = first[k + 1] - first[k]
            if n >= size:
                yield a + k, np.unique(grams[first[k] : first[k + 1] - size + 1])
            elif n:
                yield a + k, kernel.combine(words[first[k] : first[k + 1]], n) ^ np.uint64(n)


_MULTIPLIERS = kernel.fmix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _bands(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit key per band of minhashes, and a byte of each minhash."""
    least = np.array([(tokens * m).min() for m in _MULTIPLIERS])
    mins = (kernel.fmix(least) & np.uint64(255)).astype(np.uint8).view(np.int8)
    least = least.reshape(BANDS, ROWS)
    keys = kernel.fmix(least[:, 0] + np.arange(BANDS, dtype=np.uint64))
    for k in range(1, ROWS):
        keys = kernel.fmix(keys ^ least[:, k])
    return keys.astype(np.int64), mins


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    with np.errstate(over="ignore"):
        a = kernel.fmix(tokens ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
        b = kernel.fmix(tokens * np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def required(n):
    """Least tokens that a partner of a set of ``n`` must share with it: ceil(0.8 n), in integers."""
    return -(-n * NUMERATOR // DENOMINATOR)


def linked(shared, n, m):
    """Whether two sets of ``n`` and ``m`` tokens with ``shared`` in common are similar enough."""
    return shared * DENOMINATOR >= (n + m - shared) * NUMERATOR


def _summaries(docs: DataFrame) -> DataFrame:
    """(row, id, n, s1, s2, bands, mins) of all rows (n is 0 without words), and tokens that are frequent within a task as (token, local)."""

    def summarise(batches):
        local: list[np.ndarray] = []
        held = 0
        counts: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def fold(counts, local):
            values, n = np.unique(np.concatenate(local), return_counts=True) if local else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = n >= LOCAL
            values, place = np.unique(np.concatenate([counts[0], values[often]]), return_inverse=True)
            return values, np.bincount(place, np.concatenate([counts[1], n[often]]), len(values)).astype(np.int64)

        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            marks = np.zeros((2, batch.num_rows), np.int64)
            bands = np.zeros((batch.num_rows, BANDS), np.int64)
            mins = np.zeros((batch.num_rows, BANDS * ROWS), np.int8)
            for row, tokens in _tokens(batch.column(2), SHINGLE):
                sizes[row] = len(tokens)
                marks[:, row] = _signature(tokens)
                bands[row], mins[row] = _bands(tokens)
                local.append(tokens)
                held += len(tokens)
                if held > 2_000_000:
                    counts, local, held = fold(counts, local), [], 0
            empty = sizes == 0
            lists = _lists(bands, empty), _lists(mins, empty)
            none = pa.nulls(batch.num_rows, pa.int64())
            ones, twos = (pa.array(m, mask=empty) for m in marks)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), ones, twos, *lists, none, none], _NAMES)
        tokens, n = fold(counts, local)
        gone = [pa.nulls(len(tokens), t) for t in (*(pa.int64(),) * 5, pa.list_(pa.int64()), pa.list_(pa.int8()))]
        yield pa.RecordBatch.from_arrays([*gone, pa.array(tokens.astype(np.int64)), pa.array(n)], _NAMES)

    return docs.mapInArrow(kernel.tidy(summarise), "row long, id long, n long, s1 long, s2 long, bands array<long>, mins array<tinyint>, token long, local long")


_NAMES = ["row", "id", "n", "s1", "s2", "bands", "mins", "token", "local"]


def _lists(values: np.ndarray, empty: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists; those marked empty have none."""
    lengths = np.where(empty, 0, values.shape[1])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values[~empty].ravel()))


# --- tables of fixed size that are broadcast ---------------------------------------------------------


def _packed(places: DataFrame, bits: int, width: int) -> np.ndarray:
    """``2**bits`` values of ``width`` bits each in 64-bit words, from (place, value): the largest value of a place, 0 where there is none.

    Values are packed by a map-side combined aggregation, so the driver gets at most
    ``2**bits * width / 64`` rows, whatever the corpus.
    """
    per = 64 // width
    values = places.groupBy("place").agg(F.max("value").cast("long").alias("value"))
    word = F.shiftright("place", per.bit_length() - 1).alias("word")
    shift = ((F.col("place") % per) * width).cast("int")
    found = values.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.col("value"), shift)).alias("held")).toArrow()
    table = np.zeros((1 << bits) // per, np.uint64)
    table[found["word"].to_numpy()] = found["held"].to_numpy().view(np.uint64)
    return table


def _look(table: np.ndarray, hashes: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The values at the places of 64-bit hashes."""
    place = hashes >> np.uint64(64 - bits)
    per = 64 // width
    word = table[(place >> np.uint64(per.bit_length() - 1)).astype(np.int64)]
    return (word >> ((place & np.uint64(per - 1)) * np.uint64(width))) & np.uint64((1 << width) - 1)


def _place(column: str, bits: int) -> Column:
    return F.shiftrightunsigned(column, 64 - bits).alias("place")


def _powers(counts: DataFrame) -> DataFrame:
    """(place, power): the power of two of the prefixes that share a token of that place, from (token, n)."""
    return counts.where("n > 1").groupBy(_place("token", LEVEL_BITS)).agg(F.floor(F.log2(F.max("n"))).cast("int").alias("power"))


def _levels(powers: list[DataFrame]) -> np.ndarray:
    """A level per token place; two powers of two are a level. It only orders tokens.

    The least power that counts rises until at most an eighth of the places have a level.
    """
    places = reduce(DataFrame.unionByName, powers).groupBy("place").agg(F.max("power").alias("power"))
    sizes = dict(places.groupBy("power").count().collect())  # one row per power of two
    least = 1
    while sum(n for k, n in sizes.items() if k >= least) > (1 << LEVEL_BITS) // 8:
        least += 1
    level = F.least(F.floor((F.col("power") - least) / 2) + 1, F.lit((1 << LEVEL_WIDTH) - 1))
    return _packed(places.where(F.col("power") >= least).select("place", level.alias("value")), LEVEL_BITS, LEVEL_WIDTH)


def _bits(column: DataFrame, bits: int) -> np.ndarray:
    """A bit per place, set for every value of the only column (a long whose high bits are well mixed)."""
    return _packed(column.select(_place(column.columns[0], bits), F.lit(1).alias("value")), bits, 1)


def _row_bits(rows: DataFrame) -> np.ndarray:
    """A bit table of row numbers; rows that are not among them may be let through, those that are always are."""
    return _bits(rows.select(F.xxhash64("row").alias("h")), ROW_BITS)


def _only(docs: DataFrame, rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, object]:
    """``docs`` with the hash of each row, and a broadcast bit table of ``rows``."""
    return docs.select("row", "text", F.xxhash64("row").alias("h")), scratch.broadcast(_row_bits(rows))


def _chosen(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    return batch.filter(pa.array(_look(bits, batch.column(2).to_numpy().view(np.uint64), ROW_BITS, 1).astype(bool)))


# --- exact comparison ------------------------------------------------------------------------------


def _sets(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, tokens) of the rows in ``wanted`` and of a few others, made anew from their texts where they lie."""
    docs, table = _only(docs, wanted, scratch)

    def make(batches):
        for batch in batches:
            batch = _chosen(batch, table.value)
            rows, sets, held = [], [], 0
            for row, tokens in _tokens(batch.column(1), SHINGLE):
                rows.append(row)
                sets.append(tokens.tobytes())
                held += len(tokens)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(sets, pa.binary())], ["row", "tokens"])
                    rows, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sets, pa.binary())], ["row", "tokens"])

    return docs.mapInArrow(kernel.tidy(make), "row long, tokens binary")


def _shared(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    spot = np.searchsorted(y, x)
    return int((y[np.minimum(spot, len(y) - 1)] == x).sum())


def _with_sets(wide: DataFrame, pairs: DataFrame, key: str, other: str, sets: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """``wide``, the rows of ``pairs`` with other columns, plus the set of ``key`` as ``name``; a key with very many pairs is dealt to several tasks."""
    salts = pairs.groupBy(key).agg(F.ceil(F.count("*") / PER_SALT).cast("int").alias("salts")).where("salts > 1")
    salts = scratch.table(salts, "salts")
    held = sets.select(F.col("row").alias(key), F.col("tokens").alias(name)).join(salts, key, "left").fillna(1, ["salts"])
    held = held.select(key, name, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = wide.join(salts, key, "left").fillna(1, ["salts"])
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64(other), F.col("salts")).cast("int")).drop("salts")
    return dealt.join(held, [key, "salt"]).drop("salt")


def _verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b), a written table, whose sets are similar enough."""

    def check(batches):
        for batch in batches:
            a, b, ta, tb = (batch.column(k) for k in range(4))
            keep = [linked(_shared(x, y), len(x) // 8, len(y) // 8) for x, y in zip(ta.to_pylist(), tb.to_pylist(), strict=True)]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    wide = _with_sets(pairs, pairs, "a", "b", sets, "ta", scratch)
    wide = _with_sets(wide, pairs, "b", "a", sets, "tb", scratch)
    return wide.select("a", "b", "ta", "tb").mapInArrow(kernel.tidy(check), "a long, b long")


# --- groups ----------------------------------------------------------------------------------------


def _proposals(reps: DataFrame) -> DataFrame:
    """(a, b): per band bucket, every class with the bucket's heads, where sizes and minhashes allow a link.

    The heads of a bucket are its most central class, the one whose other buckets are the largest, and
    ``HEADS`` classes by the order of a hash. In a family whose members link with only some of the
    others, most link with one of these; pairs grow with the number of classes alone.
    """
    banded = reps.select("row", "n", "mins", F.explode("bands").alias("key"))
    many = banded.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    central = banded.select("row", "key").join(many, "key").groupBy("row").agg(F.sum(F.log2("many")).alias("central"))
    banded = banded.join(central, "row")
    this = F.struct("row", "n", "mins")
    chosen = [F.max_by(this, F.struct("central", -F.col("row"))), *[F.min_by(this, F.struct(F.xxhash64("row", F.lit(k)), "row")) for k in range(HEADS)]]
    heads = banded.groupBy("key").agg(F.array_distinct(F.array(*chosen)).alias("heads"), F.count("*").alias("many")).where("many > 1").drop("many")
    met = banded.join(heads, "key").select("row", "n", "mins", F.explode("heads").alias("head")).where(F.col("row") != F.col("head.row"))
    fits = F.least("n", "head.n") * DENOMINATOR >= F.greatest("n", "head.n") * NUMERATOR
    alike = F.size(F.filter(F.zip_with("mins", "head.mins", lambda x, y: x == y), lambda same: same)) >= AGREE
    return met.where(fits & alike).select(F.least("row", "head.row").alias("a"), F.greatest("row", "head.row").alias("b")).distinct()


# --- the matrix ------------------------------------------------------------------------------------


def _prefix(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The first ``n - ceil(0.8 n) + 1`` of sorted tokens in the order of (level, token)."""
    keep = len(tokens) - required(len(tokens)) + 1
    level = _look(levels, tokens, LEVEL_BITS, LEVEL_WIDTH).astype(np.uint8)
    return tokens[np.argsort(level, kind="stable")[:keep]] if level.any() else tokens[:keep]


def _counted(docs: DataFrame, rows: DataFrame, levels: list[np.ndarray], scratch: Scratch) -> DataFrame:
    """(token, n): in how many prefixes by the last of ``levels`` a token is that was not in the same set's prefix by the one before, if there is one."""
    docs, table = _only(docs, rows, scratch)
    orders = scratch.broadcast(levels[-2:])

    def cut(batches):
        for batch in batches:
            out = []
            for _, tokens in _tokens(_chosen(batch, table.value).column(1), SHINGLE):
                prefix = _prefix(tokens, orders.value[-1])
                if len(orders.value) > 1:
                    prefix = np.setdiff1d(prefix, _prefix(tokens, orders.value[0]), assume_unique=True)
                out.append(prefix)
            flat = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            for k in range(0, len(flat), 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(flat[k : k + (1 << 20)])], ["token"])

    return docs.mapInArrow(kernel.tidy(cut), "token long").groupBy("token").agg(F.count("*").alias("n"))


def _order(docs: DataFrame, rows: DataFrame, summaries: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(levels, shared): the order of tokens, and bits that are set at least for all tokens that two prefixes of that order share.

    What tasks saw to be frequent comes last; then the prefixes themselves are counted, exactly and
    over all classes, and tokens that several share are put later. Any order is right for the prefix
    principle; this one keeps what many documents quote out of their prefixes. The prefixes of the
    last order are counted whole, so that a token gets a bit only if two of them have it.
    """
    often = summaries.where("token is not null").groupBy("token").agg(F.sum("local").alias("n")).where(F.col("n") >= OVERALL)
    powers = [scratch.table(_powers(often), "powers")]
    levels = [_levels(powers)]
    for _ in range(REFINE):
        counts = scratch.table(_counted(docs, rows, levels, scratch).where("n > 1"), "counts")
        powers.append(scratch.table(_powers(counts), "powers"))
        scratch.drop(counts)
        levels.append(_levels(powers))
    counts = scratch.table(_counted(docs, rows, levels[-1:], scratch).where("n > 1"), "counts")
    shared = _bits(counts.select("token"), SHARED_BITS)
    scratch.drop(counts)
    return levels[-1], shared


def _entries(docs: DataFrame, members: DataFrame, levels: np.ndarray, shared: np.ndarray, scratch: Scratch) -> DataFrame:
    """(row, n, token, reach, group, size) of every prefix token that may be shared.

    ``reach`` is the size of the largest partner that a set can still link with if this token, at its
    place in the order, is the first they have in common.
    """
    source, table = _only(docs, members, scratch)
    order = scratch.broadcast((levels, shared))

    def cut(batches):
        for batch in batches:
            batch = _chosen(batch, table.value)
            rows, sizes, tokens_, places = [], [], [], []
            for row, tokens in _tokens(batch.column(1), SHINGLE):
                prefix = _prefix(tokens, order.value[0])
                spot = np.flatnonzero(_look(order.value[1], prefix, SHARED_BITS, 1))
                rows.append(np.full(len(spot), row))
                sizes.append(np.full(len(spot), len(tokens)))
                tokens_.append(prefix[spot].view(np.int64))
                places.append(spot)
            if rows:
                n, left = np.concatenate(sizes), np.concatenate(sizes) - np.concatenate(places)
                reach = ((NUMERATOR + DENOMINATOR) * left - NUMERATOR * n) // NUMERATOR
                columns = [batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(n), pa.array(np.concatenate(tokens_)), pa.array(reach)]
                table_ = pa.Table.from_arrays(columns, ["row", "n", "token", "reach"])
                yield from table_.to_batches(max_chunksize=1 << 18)

    return source.mapInArrow(kernel.tidy(cut), "row long, n long, token long, reach long").join(members.select("row", "group", "size"), "row")


def _may_link(n: Column, i: Column, least: Column, most: Column) -> Column:
    """Whether a set of ``n`` tokens may link with one of ``least`` to ``most`` that has ``i`` of its prefix tokens.

    The query's own part is best at the smallest partner. The partner's part grows with its size,
    except that a multiple of 5 needs more than the size before it and leaves no more tokens outside
    its prefix, so the largest size and the one before it are both tried.
    """
    near = F.greatest(least, -F.floor(-n * NUMERATOR / DENOMINATOR))
    far = F.least(most, F.floor(n * DENOMINATOR / NUMERATOR))
    before = F.greatest(near, far - 1)

    def outside(m):
        return F.ceil(m * NUMERATOR / DENOMINATOR) - 1

    def enough(m, most_shared):
        return most_shared * (DENOMINATOR + NUMERATOR) >= (n + m) * NUMERATOR

    fits = (least <= n * DENOMINATOR / NUMERATOR) & (most >= n * NUMERATOR / DENOMINATOR)
    return fits & (enough(near, outside(n) + i) | enough(far, outside(far) + i) | enough(before, outside(before) + i))


def _met(matrix: DataFrame) -> DataFrame:
    """(low, high): pairs of groups that a token may link, by the bounds of their members.

    In a linked pair the smaller set has the first common token early enough for a partner no smaller
    than itself, the larger one early enough for the smaller one.
    """
    early = matrix.where("early is not null").select("token", F.col("group").alias("other"), "early", "far")
    met = matrix.select("token", "group", "least", "reach").join(early, "token")
    met = met.where((F.col("group") != F.col("other")) & (F.col("early") <= F.col("reach")) & (F.col("least") <= F.col("far")))
    return met.select(F.least("group", "other").alias("low"), F.greatest("group", "other").alias("high")).distinct()


def _qualified(entries: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """(query, group): classes and groups, at least as large as their own, whose shared prefix tokens allow a link.

    Of a query's ``p`` prefix tokens let ``i`` be in the group's row of the matrix. Whichever set's
    prefix ends first in the token order, its tokens outside the other's prefix are not shared at all,
    so at most ``n - p + i`` tokens of that set are. A link needs 0.8 / 1.8 of both sizes together;
    the bound is taken at the partner size that favours a link most, so it never loses one.
    """
    first = F.col("reach") >= F.col("n")
    matrix = entries.groupBy("token", "group").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("reach"), F.min(F.when(first, F.col("n"))).alias("early"), F.max(F.when(first, F.col("reach"))).alias("far")
    )
    matrix = scratch.table(matrix, "matrix")
    met = scratch.table(_met(matrix), "met")
    sizes = members.select("group", "size").where("size > 1").distinct()
    for side in ("low", "high"):
        met = met.join(sizes.select(F.col("group").alias(side), F.col("size").alias(f"{side}_size")), side, "left").fillna(1, [f"{side}_size"])
    swap = F.col("low_size") > F.col("high_size")
    asked = met.select(F.when(swap, F.col("high")).otherwise(F.col("low")).alias("group"), F.when(swap, F.col("low")).otherwise(F.col("high")).alias("other"))
    found = entries.select("row", "n", "token", "group").join(asked, "group").drop("group")
    found = found.join(matrix.select("token", F.col("group").alias("other"), "least", "most"), ["token", "other"])
    found = found.groupBy(F.col("row").alias("query"), "other").agg(F.count("*").alias("i"), F.first("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    return found.where(_may_link(*map(F.col, ("n", "i", "least", "most")))).select("query", F.col("other").alias("group"))


def _opened(queries: DataFrame, members: DataFrame, source: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that the queries find. A group of one is compared at once; of larger ones each
    block's token union bounds the query first, and only blocks that qualify are opened: the one that
    shares most tokens first, and the others only for queries that have no link with the group by then,
    as one link with a group is as good as several."""
    single = members.where("size = 1").select("group", F.col("row").alias("b"))
    alone = scratch.table(queries.join(single, "group").select(F.col("query").alias("a"), "b"), "alone")
    blocks = members.where("size > 1").select("group", "block").distinct()
    several = scratch.table(queries.join(blocks, "group").select("query", "group", "block"), "several")
    held = members.where("size > 1").join(several.select("block").distinct(), "block", "left_semi").select("row", "group", "block")
    held = scratch.table(held, "held")
    rows = alone.select(F.col("a").alias("row")).union(alone.select("b")).union(several.select("query")).union(held.select("row"))
    sets = scratch.table(_sets(source, rows, scratch), "sets")

    def unite(table: pa.Table) -> pa.Table:
        tokens = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["tokens"]]))
        return pa.table({"block": table["block"].slice(0, 1), "union": pa.array([tokens.tobytes()], pa.binary())})

    # Written out, as otherwise each task of the bound below would hold two Python workers.
    unions = held.join(sets, "row").select("block", "tokens").groupBy("block").applyInArrow(unite, "block string, union binary")
    unions = scratch.table(unions, "unions")

    def bound(batches):
        for batch in batches:
            shared = np.array([_shared(t, u) for t, u in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)], np.int64)
            n = np.array([len(t) // 8 for t in batch.column(3).to_pylist()], np.int64)
            keep = pa.array(shared >= required(n))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(keep) for k in range(3)), pa.array(shared).filter(keep)], ["query", "group", "block", "shared"])

    bounded = _with_sets(several, several, "query", "block", sets, "tokens", scratch).join(unions, "block")
    open_ = bounded.select("query", "group", "block", "tokens", "union").mapInArrow(kernel.tidy(bound), "query long, group long, block string, shared long")
    order = Window.partitionBy("query", "group").orderBy(F.desc("shared"), "block")
    open_ = scratch.table(open_.withColumn("place", F.row_number().over(order)), "open")
    scratch.drop(unions)

    def opened(part: DataFrame) -> DataFrame:
        return part.join(held.select("row", "block"), "block").select(F.col("query").alias("a"), F.col("row").alias("b"))

    pairs = scratch.table(opened(open_.where("place = 1")).unionByName(alone), "pairs")
    links = scratch.table(_verified(pairs, sets, scratch), "links")
    done = links.join(held.select(F.col("row").alias("b"), "group"), "b").select(F.col("a").alias("query"), "group").distinct()
    rest = scratch.table(opened(open_.where("place > 1").join(done, ["query", "group"], "left_anti")), "pairs")
    return links.unionByName(_verified(rest, sets, scratch))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, n_shingles, component_id, component_row) of every row of ``docs``.

    ``row`` numbers the rows of ``docs`` as ``monotonically_increasing_id`` does, and
    ``component_row`` is a row that stands for the component.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a set holds the distinct
    5-word shingles, or the whole text as one where it has fewer words. Rows without words have the
    empty set and link with nothing; rows without an id take part through a number of their own and
    get a null id in components of null ids only. The component is the smallest id reachable by
    links, so repeated rows share it. An empty table gives an empty result. ``docs`` is scanned more
    than once and must give its rows in the same order each time, as a table of files does.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    with Scratch(docs.sparkSession, "ngram-jaccard") as scratch:
        summaries = scratch.table(_summaries(source), "summaries")
        rows = summaries.where("row is not null").select("row", "id", "n", "s1", "s2")
        classes = summaries.where("n > 0").groupBy("s1", "s2", "n")
        classes = classes.agg(F.min("row").alias("class_row"), F.min("id").alias("least"), F.first("bands").alias("bands"), F.first("mins").alias("mins"))
        classes = scratch.table(classes, "classes")
        reps = classes.select(F.col("class_row").alias("row"), "n", "bands", "mins")
        proposals = scratch.table(_proposals(reps), "proposals")
        sets = scratch.table(_sets(source, proposals.select(F.col("a").alias("row")).union(proposals.select("b")), scratch), "sets")
        links = scratch.table(_verified(proposals, sets, scratch), "links")
        scratch.drop(sets)
        groups = components(links, scratch)
        members = reps.select("row").join(groups.withColumnRenamed("node", "row"), "row", "left").select("row", F.coalesce("component", "row").alias("group"))
        large = members.groupBy("group").agg(F.count("*").alias("size")).where("size > 1")
        members = members.join(large, "group", "left").select("row", "group", F.coalesce("size", F.lit(1)).alias("size"))
        cell = F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / BLOCK))
        members = scratch.table(members.withColumn("block", F.concat_ws(":", "group", cell)), "members")
        entries = scratch.table(_entries(source, members, *_order(source, members, summaries, scratch), scratch), "entries")
        queries = scratch.table(_qualified(entries, members, scratch), "queries")
        scratch.drop(entries)
        more = scratch.table(_opened(queries, members, source, scratch), "links")
        final = components(links.unionByName(more), scratch).withColumnRenamed("node", "class_row")
        placed = classes.join(final, "class_row", "left").withColumn("root", F.coalesce("component", "class_row"))
        least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
        placed = placed.join(least, "root").select("s1", "s2", "n", F.col("root").alias("component_row"), "component_id")
        known = rows.where("n > 0").join(placed, ["s1", "s2", "n"]).select("id", "row", "n", "component_id", "component_row")
        bare = rows.where("n = 0").select("id", "row", "n", F.col("id").alias("component_id"), F.col("row").alias("component_row"))
        return materialise(known.unionByName(bare), "near-duplicates").withColumnRenamed("n", "n_shingles")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one of each component: the smallest id stays, of repeated rows the first."""
    found = near_duplicates(docs, id_col, text_col)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    stays = found.groupBy("component_row").agg(F.min(order)["row"].alias("row")).select("row")
    # Written out, so that its size is known before the join and texts are not shuffled for a short list.
    gone = materialise(found.select("row").join(stays, "row", "left_anti").withColumnRenamed("row", "__row"), "gone")
    numbered = docs.withColumn("__own", F.monotonically_increasing_id())
    return numbered.join(gone, F.col("__own") == F.col("__row"), "left_anti").drop("__own")


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, b AS other FROM sides
  UNION SELECT r.doc_id, e.b FROM reach r JOIN sides e ON r.other = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       least(w.doc_id, coalesce((SELECT min(other) FROM reach r WHERE r.doc_id = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""
