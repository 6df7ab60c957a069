"""Token ids by a published tokenizer file, with each chunk of a text encoded once.

The tokenizer drops white space before anything else, so a text's ids are those of its white-space
separated chunks one after another. Chunks are looked up in a two-generation cache of bounded size;
only unseen ones go through the tokenizer, many at a time. Chunks of more than ``LONGEST`` bytes are
encoded each time they occur, so the cache is bounded in bytes too.
"""

from __future__ import annotations

import os
import re

import numpy as np

CACHE, LONGEST = 400_000, 64
#: Letters that normalising and lower-casing leave letters, one for one, so a word of them is one word for the tokenizer.
#: (Not so U+0130, whose lower case ends in a combining mark.)
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ſΑ-ΡΣ-Ωα-ωА-я]+")


def plain(chunk: bytes) -> bool:
    """Whether the tokenizer takes the chunk as one word of letters."""
    return chunk.isalpha() or (not chunk.isascii() and LETTERS.fullmatch(chunk.decode()) is not None)


class ChunkEncoder:
    """Little-endian unsigned 32-bit ids of texts, chunk by chunk."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = cache
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.final = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.final[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        found, missing = [], {}
        get = self.young.get
        for text in texts:
            # Lower case is part of the tokenizer; doing A-Z first only saves cache entries. A special token's
            # spelling is left alone, and so are texts with combining marks (U+0300 to U+036F), some of which compose
            # with a small letter only.
            chunks = (text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()).split()
            ids = list(map(get, chunks))
            if None in ids:
                for chunk, value in zip(chunks, ids, strict=True):
                    if value is None:
                        missing[chunk] = None
            found.append((chunks, ids))
        self._resolve(missing)
        out = []
        for chunks, ids in found:
            if None in ids:
                ids = [missing[c] if v is None else v for c, v in zip(chunks, ids, strict=True)]
            out.append(b"".join(ids))
        return out

    def _resolve(self, missing: dict[bytes, bytes | None]) -> None:
        """Fills in ``missing`` and the cache. A word with closing punctuation is the word's ids, then the punctuation's."""
        old, young, fresh, split = self.old.get, self.young.get, {}, []
        for chunk in missing:
            if (value := old(chunk)) is not None:
                missing[chunk] = value
                continue
            core = chunk.rstrip(b".,!?;:*#$%&)")
            if len(core) < len(chunk) and plain(core):
                tail = chunk[len(core) :]
                split.append((chunk, core, tail))
                for part in (core, tail):
                    if part not in missing:
                        value = young(part) or old(part)
                        fresh[part] = value
            else:
                fresh[chunk] = None
        wanted = [part for part, value in fresh.items() if value is None]
        for k in range(0, len(wanted), 8192):
            some = wanted[k : k + 8192]
            fresh.update(zip(some, self._encode_chunks(some), strict=True))
        missing.update(fresh)
        for chunk, core, tail in split:
            missing[chunk] = missing[core] + missing[tail]
        if len(self.young) + len(missing) > self.size:
            self.old, self.young = self.young, {}
        self.young.update((chunk, ids) for chunk, ids in missing.items() if len(chunk) <= LONGEST)

    def _encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Words of plain letters have one word-final token, so they can share one call; others get an entry each."""
        words = [c for c in chunks if plain(c)]
        out: dict[bytes, bytes] = {}
        if words:
            ids = np.array(self._ids([b" ".join(words)])[0], "<u4")
            cuts = ((np.flatnonzero(self.final[ids]) + 1) * 4).tolist()
            if len(cuts) == len(words):
                raw = ids.tobytes()
                out = {c: raw[a:b] for c, a, b in zip(words, [0, *cuts], cuts, strict=False)}
        rest = [c for c in chunks if c not in out] if len(out) < len(chunks) else []
        out.update((c, np.array(i, "<u4").tobytes()) for c, i in zip(rest, self._ids(rest), strict=True))
        return [out[c] for c in chunks]

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This process's encoder for a file; Python workers are reused, and so is its cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
