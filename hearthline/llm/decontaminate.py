"""Benchmark decontamination as a prefix-filtered set join.

An item becomes windows of ten consecutive words (one shorter window if it has fewer). The windows'
shingles (word pairs; the word itself where a window is a single word) are ordered by how often they
occur in all documents. A window must be contained whole, so its necessary prefix is its one rarest
shingle: documents are joined with the windows on that shingle alone. Length and positional bounds
then fix the only place a window could have in the document, and the words there are compared, all of
them, by their 64-bit hashes: exact but for collisions of those.

How often shingles occur is counted for the whole benchmark in one scan of the documents, by places of
a table of fixed size (the order is right however many shingles share a place). The benchmark comes to
the executors in blocks of at most ``BLOCK_BYTES`` of text, each a broadcast of bounded size, one after
another in one more scan; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm import kernel

WINDOW = 10
BLOCK_BYTES, BLOCKS = 2 << 20, 4
#: Places of the table of shingle counts, as a power of two.
PLACE_BITS = 22
RESULT = "n_words long, n_hit long, n_items long, items array<{}>, contaminated boolean"


class Lookup:
    """Places of 64-bit keys in a sorted array, behind a flag table that most other keys fail."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in hashes, position in keys) of every hash that is a key."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.flags[(hashes >> np.uint64(44)).astype(np.int64)])
        spot = np.searchsorted(self.keys, hashes[at])
        good = self.keys[np.minimum(spot, len(self.keys) - 1)] == hashes[at]
        return at[good], spot[good]


def _words(column: pa.Array):
    """Slices of a text column: (first text, last text, word hashes, first word of each text)."""
    raw, offsets = kernel.utf8(column)
    for a, b in kernel.slices(offsets):
        part, own = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = kernel.find_words(part, own, kernel.ALNUM)
        yield a, b, kernel.hash_words(part, starts, ends), first


def _pairs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the word pairs that lie within one text."""
    pairs = kernel.combine(hashes, 2)
    inside = np.ones(len(pairs), bool)
    ends = first[1:] - 1
    inside[ends[(ends >= 0) & (ends < len(pairs))]] = False
    place = np.flatnonzero(inside)
    return pairs[place], place


class Block:
    """The windows of some benchmark items, and the shingles they are made of."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        column = pa.array(texts, pa.large_string())
        raw, offsets = kernel.utf8(column)
        starts, ends, first = kernel.find_words(raw, offsets, kernel.ALNUM)
        self.words = kernel.hash_words(raw, starts, ends)
        counts = np.diff(first)
        size = np.minimum(counts, WINDOW)
        per_item = np.where(counts > 0, counts - size + 1, 0)
        self.start = kernel.ranges(first[:-1], per_item)
        self.size = np.repeat(size, per_item)
        self.item = np.repeat(np.arange(len(ids)), per_item)
        # The shingles of window w: single for one-word windows, else its word pairs.
        pairs = np.concatenate([kernel.combine(self.words, 2), np.zeros(1, np.uint64)])
        n_shingles = np.maximum(self.size - 1, 1)
        self.offset = kernel.ranges(np.zeros(len(n_shingles), np.int64), n_shingles)
        self.owner = np.repeat(np.arange(len(n_shingles)), n_shingles)
        place = self.start[self.owner] + self.offset
        single = self.size[self.owner] == 1
        self.shingle = np.where(single, self.words[place], pairs[np.minimum(place, len(pairs) - 1)])
        self.single = single
        self.keys = np.unique(self.shingle)

    def index(self, counts: np.ndarray) -> "Index":
        """The windows under their rarest shingle, given how often the shingles of each place occur in the documents."""
        rarity = counts[_places(self.shingle)]
        order = np.lexsort((self.offset, rarity, self.owner))
        head = np.ones(len(order), bool)
        head[1:] = self.owner[order][1:] != self.owner[order][:-1]
        chosen = order[head]
        return Index(self, chosen)


class Index:
    """Windows by prefix shingle."""

    def __init__(self, block: Block, chosen: np.ndarray):
        order = np.argsort(block.shingle[chosen], kind="stable")
        chosen = chosen[order]
        keys, begin = np.unique(block.shingle[chosen], return_index=True)
        self.lookup = Lookup(keys)
        self.begin = np.append(begin, len(chosen))
        window = block.owner[chosen]
        self.offset, self.start = block.offset[chosen], block.start[window]
        self.size, self.item = block.size[window], block.item[window]
        self.words, self.ids = block.words, block.ids
        self.singles = bool(block.single.any())

    def occurrences(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, size, item's place in ids) of every occurrence of a window."""
        pairs, place = _pairs(hashes, first)
        at, key = self.lookup.find(pairs)
        at = place[at]
        if self.singles:
            more, key2 = self.lookup.find(hashes)
            at, key = np.concatenate([at, more]), np.concatenate([key, key2])
        many = self.begin[key + 1] - self.begin[key]
        window = kernel.ranges(self.begin[key], many)
        start = np.repeat(at, many) - self.offset[window]
        size = self.size[window]
        text = np.searchsorted(first, np.repeat(at, many), "right") - 1
        fits = (start >= first[text]) & (start + size <= first[text + 1])  # the positional and length bounds
        start, size, window = start[fits], size[fits], window[fits]
        same = np.ones(len(start), bool)
        for k in range(WINDOW):
            live = np.flatnonzero(same & (size > k))
            same[live] = hashes[start[live] + k] == self.words[self.start[window[live]] + k]
        return start[same], size[same], self.item[window[same]]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    ids, texts, held = [], [], 0
    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col)
    for item, text in rows.toLocalIterator():
        if ids and held + len(text) > BLOCK_BYTES:
            yield Block(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(item)
        texts.append(text)
        held += len(text)
    if ids:
        yield Block(ids, texts)


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - PLACE_BITS)).astype(np.int64)


def _rarity(docs: DataFrame, text_col: str, wanted: np.ndarray) -> np.ndarray:
    """How often the shingles of each wanted place occur in all documents; at most as many rows come back as there are places."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def count(batches):
        table = np.unpackbits(shared.value).astype(bool)
        total = np.zeros(len(table), np.int64)
        for batch in batches:
            for _, _, hashes, first in _words(batch.column(0)):
                for found in (_pairs(hashes, first)[0], hashes):
                    place = _places(found)
                    place, n = np.unique(place[table[place]], return_counts=True)
                    total[place] += n
        seen = np.flatnonzero(total)
        for k in range(0, len(seen), 1 << 18):
            some = seen[k : k + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    found = docs.select(text_col).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(wanted), np.int64)
    counts[found["k"].to_numpy()] = found["n"].to_numpy()
    return counts


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus n_words, n_hit, n_items, items and contaminated.

    A document word inside any occurrence of an item's window is hit; ``items`` are the distinct ids
    of items with an occurring window, ascending. Words are ``[0-9a-z]`` and non-ASCII runs after
    lower-casing A-Z. Null or empty texts have no words; items without id or words have no windows;
    repeated items and rows count alike; an empty benchmark hits nothing. Ids of items may be of any
    atomic type. Input columns that bear a result's name are replaced.
    """
    spark = docs.sparkSession
    kind = benchmark.schema[item_id].dataType.simpleString()
    names = [f.split()[0] for f in RESULT.split(", ")]
    kept = [c for c in docs.columns if c not in names]
    width = len(kept)
    rows = docs.select(*kept, F.lit(None).cast("binary").alias("__marks"), F.lit(None).cast(f"array<{kind}>").alias("__items"))
    schema = rows.schema
    spot = kept.index(text_col)
    wanted = np.zeros(1 << PLACE_BITS, bool)
    for block in _blocks(benchmark, item_id, item_text):
        wanted[_places(block.keys)] = True
    counts = _rarity(docs, text_col, wanted) if wanted.any() else wanted
    indexes = [spark.sparkContext.broadcast(block.index(counts)) for block in _blocks(benchmark, item_id, item_text)]

    def match(batches, some):
        for batch in batches:
            for index in some:
                batch = _matched(batch, spot, width, index.value)
            yield batch

    def finish(batches, some):
        for batch in match(batches, some):
            yield _finished(batch, spot, width, names)

    out = docs.select(*kept).schema
    types = spark.createDataFrame([], RESULT.format(kind)).schema
    for field in types:
        out = out.add(field)
    # A worker holds the indexes of BLOCKS blocks at once; the last ones are matched where the result is made.
    while len(indexes) > BLOCKS:
        rows = rows.mapInArrow(partial(match, some=indexes[:BLOCKS]), schema)
        indexes = indexes[BLOCKS:]
    return rows.mapInArrow(partial(finish, some=indexes), out)


def _matched(batch: pa.RecordBatch, spot: int, width: int, index: Index) -> pa.RecordBatch:
    """Adds a block's occurrences to the batch's marks (hit words as bits) and items."""
    marks, items = batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()
    for a, b, hashes, first in _words(batch.column(spot)):
        start, size, item = index.occurrences(hashes, first)
        if not len(start):
            continue
        depth = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(depth, start, 1)
        np.add.at(depth, start + size, -1)
        hit = np.cumsum(depth[:-1]) > 0
        text = np.searchsorted(first, start, "right") - 1
        for t in np.unique(text):
            own = hit[first[t] : first[t + 1]]
            if marks[a + t] is not None:
                own = own | np.unpackbits(np.frombuffer(marks[a + t], np.uint8), count=len(own)).astype(bool)
            marks[a + t] = np.packbits(own).tobytes()
            items[a + t] = sorted({*(items[a + t] or ()), *(index.ids[k] for k in set(item[text == t].tolist()))})
    columns = [batch.column(k) for k in range(width)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(marks, pa.binary()), pa.array(items, batch.schema.field(width + 1).type)], schema=batch.schema)


def _finished(batch: pa.RecordBatch, spot: int, width: int, names: list[str]) -> pa.RecordBatch:
    raw, offsets = kernel.utf8(batch.column(spot))
    n_words = np.zeros(batch.num_rows, np.int64)
    for a, b in kernel.slices(offsets):
        found = kernel.find_words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], kernel.ALNUM)[2]
        n_words[a:b] = np.diff(found)
    marks, items = batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()
    n_hit = np.array([0 if m is None else int(np.unpackbits(np.frombuffer(m, np.uint8)).sum()) for m in marks], np.int64)
    n_items = np.array([len(x or ()) for x in items], np.int64)
    results = [pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array([x or [] for x in items], batch.schema.field(width + 1).type), pa.array(n_hit > 0)]
    columns = [batch.column(k) for k in range(width)]
    return pa.RecordBatch.from_arrays([*columns, *results], [*batch.schema.names[:width], *names])


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return marked.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(names, 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, w, least(len(w), 10) AS size FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM iw)),
sizes AS (SELECT DISTINCT size FROM win),
occ AS (
  SELECT d.doc_id, d.i, d.size, win.item_id
  FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS s
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)) d
  JOIN win ON win.size = d.size AND win.s = d.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
        FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
