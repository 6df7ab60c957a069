"""Chat formatting by columnar byte assembly.

Rows are range-partitioned by conversation and turn, so one enormous conversation spreads over many
tasks. A batch's turns become segments (header, escaped content, footer); their lengths give
cumulative offsets, and numpy scatters all bytes into one preallocated Arrow buffer. Each run of a
conversation's turns inside a batch is one fragment row: formatted bytes plus the loss mask.

Template (fixed strings): every turn begins with ``<s>``; user ``[INST] .. [/INST]``, system
``<<SYS>> .. <</SYS>>``, assistant `` .. </s>``, any other role ``[ROLE]role[/ROLE] .. </s>``.
Control strings inside texts and roles become a backslash and a letter; backslashes are doubled.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm import kernel
from hearthline.llm.common import materialise

# The control strings of the template, in the order of their escape letters.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
LETTERS = "abcdefgh"
KNOWN = {"user": ("<s>[INST] ", " [/INST]"), "system": ("<s><<SYS>> ", " <</SYS>>"), "assistant": ("<s> ", " </s>")}
FRAGMENT_TURNS, FRAGMENT_BYTES = 1024, 1 << 20
FRAGMENT = "conv_id long, part int, seq int, n_turns int, formatted binary, loss array<struct<start:int,length:int>>"


def escape(texts: pa.Array) -> pa.Array:
    """Texts in which no control string is left; ``unescape`` gives them back."""
    texts = pc.replace_substring(texts, "\\", "\\\\")
    for control, letter in zip(CONTROLS, LETTERS, strict=True):
        texts = pc.replace_substring(texts, control, "\\" + letter)
    return texts


_ESCAPED = re.compile(rb"\\(.)", re.S)
_MEANING = {b"\\": b"\\", **{x.encode(): c.encode() for x, c in zip(LETTERS, CONTROLS, strict=True)}}


def unescape(raw: bytes) -> bytes:
    return _ESCAPED.sub(lambda m: _MEANING[m[1]], raw) if b"\\" in raw else raw


def _frames(roles: list[str]) -> tuple[list[bytes], list[bytes]]:
    """Header and footer of each role."""
    heads, feet = [], []
    for role in roles:
        if role in KNOWN:
            head, foot = KNOWN[role]
        else:
            head, foot = f"<s>[ROLE]{escape(pa.array([role]))[0].as_py()}[/ROLE] ", " </s>"
        heads.append(head.encode())
        feet.append(foot.encode())
    return heads, feet


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, offsets of turns, start of each content, its length) of the formatted turns."""
    names = pc.dictionary_encode(roles.fill_null(""))
    heads, feet = _frames(names.dictionary.to_pylist())
    which = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    content, content_at = kernel.utf8(escape(texts.fill_null("")))
    lengths = np.empty((len(which), 3), np.int64)
    head_len, foot_len = (np.array([len(x) for x in xs], np.int64) for xs in (heads, feet))
    lengths[:, 0], lengths[:, 1], lengths[:, 2] = head_len[which], np.diff(content_at), foot_len[which]
    ends = np.cumsum(lengths.ravel())
    begins = (ends - lengths.ravel()).reshape(-1, 3)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for column, parts, sizes in ((0, heads, head_len), (2, feet, foot_len)):
        pool = np.frombuffer(b"".join(parts), np.uint8)
        from_at = np.cumsum(sizes) - sizes
        out[kernel.ranges(begins[:, column], sizes[which])] = pool[kernel.ranges(from_at[which], sizes[which])]
    out[kernel.ranges(begins[:, 1], lengths[:, 1])] = content
    return out, np.append(begins[:, 0], len(out)), begins[:, 1], lengths[:, 1]


def _fragments(batch: pa.RecordBatch, part: int, seq: int) -> pa.RecordBatch:
    """Fragments of a sorted batch (conv_id, role, text): breaks at each conversation and at the fragment limits."""
    conv = batch.column(0)
    ids, gone = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
    out, at, start, length = assemble(batch.column(1), batch.column(2))
    n = len(ids)
    new = np.ones(n, bool)
    new[1:] = (ids[1:] != ids[:-1]) | (gone[1:] != gone[:-1])
    run = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    new |= (np.arange(n) - run) % FRAGMENT_TURNS == 0
    cell = (at[:-1] - at[run]) // FRAGMENT_BYTES
    new[1:] |= cell[1:] != cell[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], n)
    offsets = at[np.append(first, n)]
    formatted = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
    loss = pc.equal(batch.column(1), "assistant").fill_null(False).to_numpy(zero_copy_only=False)
    owner = np.searchsorted(first, np.arange(n), "right") - 1
    spans = pa.StructArray.from_arrays(
        [pa.array((start - offsets[owner])[loss], pa.int32()), pa.array(length[loss], pa.int32())], ["start", "length"]
    )
    counts = np.bincount(owner[loss], minlength=len(first))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), spans)
    columns = [
        conv.take(pa.array(first)).cast(pa.int64()),
        pa.array(np.full(len(first), part), pa.int32()),
        pa.array(seq + np.arange(len(first)), pa.int32()),
        pa.array(last - first, pa.int32()),
        formatted.cast(pa.binary()),
        lists,
    ]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "seq", "n_turns", "formatted", "loss"])


def format_conversations(rows: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """Fragments of all conversations, in order of (part, seq) within each.

    Rows go by turn, ties by role and then text; null turns come first, null roles and texts are
    empty, rows without a conversation id form one conversation; repeated rows stay. ``loss`` marks
    the bytes of each assistant text inside ``formatted``. An empty table gives no fragments.
    """
    plain = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    ordered = plain.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def build(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = kernel.utf8(batch.column(2))[1]
            for a, b in kernel.slices(sizes):
                piece = _fragments(batch.slice(a, b - a), part, seq)
                seq += piece.num_rows
                # A few fragments at a time, so that later readers get small batches.
                yield from (piece.slice(k, 64) for k in range(0, piece.num_rows, 64))

    return ordered.select("conv_id", "role", "text").mapInArrow(build, FRAGMENT)


def parse_turns(formatted: bytes):
    """(role, content start, content end) of every turn in a fragment."""
    at = 0
    while at < len(formatted):
        stop = formatted.find(b"<s>", at + 3)
        stop = len(formatted) if stop < 0 else stop
        body = at + 3
        if formatted.startswith(b"[INST] ", body):
            yield b"user", body + 7, stop - 8
        elif formatted.startswith(b"<<SYS>> ", body):
            yield b"system", body + 8, stop - 9
        elif formatted.startswith(b"[ROLE]", body):
            end = formatted.index(b"[/ROLE] ", body)
            yield unescape(formatted[body + 6 : end]), end + 8, stop - 5
        else:
            yield b"assistant", body + 1, stop - 5
        at = stop


def read_back(fragments: DataFrame) -> DataFrame:
    """Per conversation, what the formatted fragments say: turns, their digest, and the text under the loss mask.

    Fragments are streamed in order, so a conversation is never held whole.
    """
    ordered = fragments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def digest(batches):
        state, done = None, []
        for batch in batches:
            for row in zip(*(batch.column(k) for k in (0, 4, 5)), strict=True):
                conv, formatted, loss = (x.as_py() for x in row)
                if state is None or state[0] != conv:
                    done += [state] if state else []
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, a, b in parse_turns(formatted):
                    state[1] += 1
                    state[2].update(role + b"\n" + unescape(formatted[a:b]) + b"\n")
                for span in loss:
                    text = unescape(formatted[span["start"] : span["start"] + span["length"]])
                    state[3] += len(text.decode())
                    state[4].update(text)
                state[5] += len(formatted.decode())
            if len(done) >= 1000:
                yield _digests(done)
                done = []
        yield _digests(done + ([state] if state else []))

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(digest, schema)


def _digests(states: list) -> pa.RecordBatch:
    conv, turns, all_text, chars, loss, total = ([s[k] for s in states] for k in range(6))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(conv, pa.int64()),
            pa.array(turns, pa.int64()),
            pa.array([h.hexdigest() for h in all_text], pa.string()),
            pa.array(chars, pa.int64()),
            pa.array([h.hexdigest() for h in loss], pa.string()),
            pa.array(total, pa.int64()),
        ],
        ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    )


EXTRA = "</s>[INST] ok [/INST]"


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, written, and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA), (-7, 1, "assistant", EXTRA)], "conv_id long, turn long, role string, text string")
    return read_back(materialise(format_conversations(rows.unionByName(extra)), "chat"))


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
      '\', '\\'), '<s>', '\a'), '</s>', '\b'), '[INST]', '\c'), '[/INST]', '\d'), '<<SYS>>', '\e'), '<</SYS>>', '\f'), '[ROLE]', '\g'), '[/ROLE]', '\h'))
    + CASE role WHEN 'user' THEN 18 WHEN 'system' THEN 20 WHEN 'assistant' THEN 9 ELSE 22 + length(role) END AS chars
  FROM rows)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
