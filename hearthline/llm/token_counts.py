"""Token counts by a linear longest-match automaton.

A vocabulary's pieces form a trie with two roots, one for the beginning of a word and one for what
follows. Every node has a failure link and the number of pieces that are popped on the way, so
greedy longest-match lengths come from one pass over a word's characters and no piece is built.
Transitions with their pops are completed as they are met, and a bounded cache keeps the counts of
words that were seen.

A word is cut as ``▁`` and its characters: the root of the beginnings stands for ``▁``, which is a
piece of its own where no longer piece begins the word. Where the vocabulary has byte pieces, a
character outside it counts as its UTF-8 bytes, and the word is among n_unknown.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm import kernel

UNKNOWN = 1 << 40
CACHE, LONGEST = 500_000, 64


class Automaton:
    """Counts greedy longest-match pieces of words.

    An empty head is a piece that may come before any tail. With ``fallback`` a character that is no
    piece counts as its UTF-8 bytes; without it a word that cannot be cut whole is one unknown token.
    """

    HEAD, TAIL = 0, 1

    def __init__(self, heads: list[str], tails: list[str], fallback: bool = False):
        self.fallback = fallback
        self.next: list[dict[str, int]] = [{}, {}]
        ends = [0, 0]
        for root, pieces in ((self.HEAD, heads), (self.TAIL, tails)):
            for piece in pieces:
                node = root
                for char in piece:
                    if char not in self.next[node]:
                        self.next[node][char] = len(self.next)
                        self.next.append({})
                        ends.append(0)
                    node = self.next[node][char]
                if piece:
                    ends[node] = 1
        if fallback:
            for char in sorted({c for piece in (*heads, *tails) for c in piece}):
                node = self.next[self.TAIL].setdefault(char, len(self.next))
                if node == len(self.next):
                    self.next.append({})
                    ends.append(0)
                ends[node] = ends[node] or self._bytes(char)
        self.link: list[int] = [-1] * len(self.next)
        self.pops: list[int] = [0] * len(self.next)
        if "" in heads:
            self.link[self.HEAD], self.pops[self.HEAD] = self.TAIL, 1
        queue = [self.HEAD, self.TAIL]
        for node in queue:
            for char, child in self.next[node].items():
                if ends[child]:
                    self.link[child], self.pops[child] = self.TAIL, ends[child]
                else:
                    at, popped = self.link[node], self.pops[node]
                    while at >= 0 and char not in self.next[at]:
                        popped += self.pops[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[child], self.pops[child] = self.next[at][char], popped
                queue.append(child)
        self.moves: list[dict[str, tuple[int, int]]] = [{} for _ in self.next]

    @staticmethod
    def _bytes(char: str) -> int:
        return UNKNOWN + len(char.encode())

    def _move(self, node: int, char: str) -> tuple[int, int]:
        """(node after the character or -1, pieces popped before it)."""
        at, popped = node, 0
        while at >= 0 and char not in self.next[at]:
            popped += self.pops[at]
            at = self.link[at]
        if at >= 0:
            found = self.next[at][char], popped
        elif self.fallback:
            found = self.TAIL, popped + self._bytes(char)
        else:
            found = -1, popped
        self.moves[node][char] = found
        return found

    def count(self, word: str) -> int:
        """Pieces of the word, and ``UNKNOWN`` more where it holds a character outside the vocabulary."""
        node, total, moves = self.HEAD, 0, self.moves
        for char in word:
            node, popped = moves[node].get(char) or self._move(node, char)
            if node < 0:
                return UNKNOWN + 1
            total += popped
        while node not in (self.HEAD, self.TAIL):
            total += self.pops[node]
            node = self.link[node]
            if node < 0:
                return UNKNOWN + 1
        return total if total < UNKNOWN else total % UNKNOWN + UNKNOWN


def sentencepiece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """(pieces that begin a word, pieces that go on) of a sentencepiece model's vocabulary; the lone ``▁`` is an empty beginning.

    Only a ``▁`` in the text itself makes a piece with one go on.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i) for i in plain]
    return [p[1:] for p in pieces if p.startswith("▁")], pieces


def has_bytes(path: str) -> bool:
    """Whether a sentencepiece model's vocabulary has byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return any(model.is_byte(i) for i in range(model.vocab_size()))


class WordCounter:
    """Counts per word behind a two-generation cache, which words of more than ``LONGEST`` bytes don't enter."""

    def __init__(self, path: str):
        self.automaton = Automaton(*sentencepiece_vocabulary(path), has_bytes(path))
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def totals(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(words, tokens, unknown words) of each text."""
        out = []
        for text in texts:
            words = text.split()
            counts = list(map(self.young.get, words))
            if None in counts:
                fresh = {}
                for word, value in zip(words, counts, strict=True):
                    if value is None and word not in fresh:
                        value = self.old.get(word)
                        fresh[word] = self.automaton.count(word.decode()) if value is None else value
                counts = [fresh[w] if c is None else c for w, c in zip(words, counts, strict=True)]
                if len(self.young) + len(fresh) > CACHE:
                    self.old, self.young = self.young, {}
                self.young.update((word, n) for word, n in fresh.items() if len(word) <= LONGEST)
            total = sum(counts)
            out.append((len(words), total % UNKNOWN, total // UNKNOWN))
        return out


_COUNTERS: dict[str, WordCounter] = {}


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` plus n_words, n_tokens and n_unknown.

    Words are runs of anything but ASCII white space; null and empty texts count nothing; rows that
    repeat are counted each; input columns that bear a result's name are replaced.
    """
    path = vocabulary or tokenizer_path()
    names = ["n_words", "n_tokens", "n_unknown"]
    kept = [c for c in docs.columns if c not in names]
    spot, width = kept.index(text_col), len(kept)

    def count(batches):
        if path not in _COUNTERS:
            _COUNTERS[path] = WordCounter(path)
        for batch in batches:
            raw, offsets = kernel.utf8(batch.column(spot))
            raw = raw.tobytes()
            totals = _COUNTERS[path].totals([raw[a:b] for a, b in zip(offsets, offsets[1:], strict=False)])
            results = np.array(totals, np.int64).reshape(-1, 3)
            columns = [batch.column(k) for k in range(width)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(results[:, k]) for k in range(3))], [*batch.schema.names, *names])

    schema = docs.select(*kept).schema
    for name in names:
        schema = schema.add(name, "long")
    return docs.select(*kept).mapInArrow(count, schema)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", F.col("n_words"), "n_tokens", "n_unknown")
