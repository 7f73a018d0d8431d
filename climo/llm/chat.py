"""Chat formatting with offset-aligned loss masks.

Conversations are rendered whole and encoded once, with character offsets.  A token is under the loss as far as
it overlaps the text of an assistant turn: the sorted turn spans are searched by bisection for all tokens of a batch of stretches at once.

A template marks turns as ``<turn ROLE>\\nTEXT</turn>\\n``.  Inside roles and texts a backslash becomes ``\\\\``, ``<turn``
becomes ``\\<turn`` and ``</turn`` becomes ``\\</turn``, so no text can hold a mark; reading back undoes it.

Rows are dealt by conversation and sorted by turn; a task reads them as a stream and hands a conversation on in stretches of
about ``stretch_chars`` characters, cut between turns, where the tokenizer always starts anew (its split pattern ends a
token at a line break followed by a non-space).  So a conversation of any length takes bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climo.session import ship_package

#: The template's marks (fixed values).
OPEN, CLOSE = "<turn ", "</turn>\n"
_MARKS = re.compile(r"\\|</?turn")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TOKEN = re.compile(r"\\.|</turn>\n", re.DOTALL)

#: Characters of short conversations that are searched and handed on together.
BATCH_CHARS = 1 << 18


def escape(text: str) -> str:
    return _MARKS.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, sorted spans of the assistant texts in it) of (role, text) turns."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role).replace(chr(10), chr(92) + chr(10))}>\n", escape(text)
        parts += [head, body, CLOSE]
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        head = at + len(OPEN)
        end = head
        while formatted[end] != "\n":
            end += 2 if formatted[end] == "\\" else 1
        close = next(m for m in _TOKEN.finditer(formatted, end + 1) if m[0] == CLOSE)
        turns.append((unescape(formatted[head:end - 1]), unescape(formatted[end + 1:close.start()])))
        at = close.end()
    return turns


def loss_parts(starts: np.ndarray, ends: np.ndarray, span_starts: np.ndarray, span_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(token, start, end) arrays: what each token covers of the sorted, disjoint spans.

    Tokens stand in order.  Those that share a character (its bytes are split between them) overlap; the first of
    them gets it.  Two binary searches per token find the spans that it meets.
    """
    none = np.zeros(0, np.int64)
    if not len(starts) or not len(span_starts):
        return none, none, none
    fresh = starts.copy()
    fresh[1:] = np.maximum(starts[1:], np.maximum.accumulate(ends)[:-1])
    first = np.searchsorted(span_ends, fresh, "right")
    met = np.where(fresh < ends, np.maximum(np.searchsorted(span_starts, ends, "left") - first, 0), 0)
    token = np.repeat(np.arange(len(starts)), met)
    span = np.arange(len(token)) - np.repeat(np.cumsum(met) - met, met) + first[token]
    start, end = np.maximum(fresh[token], span_starts[span]), np.minimum(ends[token], span_ends[span])
    real = start < end
    return token[real], start[real], end[real]


def default_tokenizer_path() -> str:
    """The public 50k byte-level tokenizer installed beside Spark."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


STRETCH_SCHEMA = ("conv_id long, part int, n_turns int, formatted string, ids array<int>, starts array<int>, ends array<int>, "
                  "loss_tokens array<int>, loss_starts array<int>, loss_ends array<int>, last boolean")


def _stretches(rows: DataFrame, path: str, stretch_chars: int) -> DataFrame:
    ints = pa.list_(pa.int32())
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int32()), ("formatted", pa.string()), ("ids", ints),
                        ("starts", ints), ("ends", ints), ("loss_tokens", ints), ("loss_starts", ints), ("loss_ends", ints),
                        ("last", pa.bool_())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True       # their strings in a text are ordinary text

        held = []                                    # (conv, part, turns, formatted, spans, last)

        def flush() -> pa.RecordBatch:
            """The stretches held, as one batch; their characters stand one after the other in one row of numbers."""
            texts = [h[3] for h in held]
            base = np.cumsum([0, *map(len, texts)])
            coded = [tokenizer.encode(t, add_special_tokens=False) for t in texts]
            sizes = np.array([len(c) for c in coded], np.int64)
            offsets = np.fromiter(chain.from_iterable(chain.from_iterable(c.offsets for c in coded)), np.int64, 2 * int(sizes.sum()))
            shift, begun = np.repeat(base[:-1], sizes), np.cumsum([0, *sizes])
            starts, ends = offsets[::2] + shift, offsets[1::2] + shift
            spans = np.array([(a + at, b + at) for h, at in zip(held, base, strict=False) for a, b in h[4]], np.int64).reshape(-1, 2)
            token, lo, hi = loss_parts(starts, ends, spans[:, 0], spans[:, 1])
            row = np.searchsorted(begun, token, "right") - 1
            parts_begun = np.searchsorted(row, np.arange(len(held) + 1))

            def lists(values, cuts):
                return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()))

            ids = np.fromiter(chain.from_iterable(c.ids for c in coded), np.int64, int(sizes.sum()))
            arrays = [pa.array([h[i] for h in held], schema.field(i).type) for i in range(4)]
            arrays += [lists(ids, begun), lists(offsets[::2], begun), lists(offsets[1::2], begun)]
            arrays += [lists(v, parts_begun) for v in (token - begun[row], lo - base[row], hi - base[row])]
            arrays.append(pa.array([h[5] for h in held], pa.bool_()))
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        conv, part, turns, chars, begun, waiting = None, 0, [], 0, False, 0
        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                other = begun and c != conv
                if other or chars >= stretch_chars:
                    held.append((conv, part, len(turns), *render(turns), other))
                    waiting += chars
                    part, turns, chars = 0 if other else part + 1, [], 0
                    if waiting >= min(stretch_chars, BATCH_CHARS):
                        yield flush()
                        waiting = 0
                conv, begun = c, True
                turns.append((role or "", text or ""))
                chars += len(role or "") + len(text or "")
        if begun:
            held.append((conv, part, len(turns), *render(turns), True))
            yield flush()

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(encode, STRETCH_SCHEMA)


def format_conversations(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", tokenizer_path: str | None = None, stretch_chars: int = 1 << 20) -> DataFrame:
    """STRETCH_SCHEMA: the formatted text, token ids and offsets, and the parts of tokens under the loss.

    One row per conversation, or several (``part``, the final one ``last``) where it is longer than
    ``stretch_chars``.  Turns are in order of ``turn`` (null first), ties by role, then text; repeated rows are turns of their
    own.  Null roles and texts are empty.  Rows without id form a conversation of their own.  An empty table gives
    no rows.  Other columns are not read.
    """
    ship_package(conversations.sparkSession)
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
                                F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    return _stretches(rows, tokenizer_path or default_tokenizer_path(), stretch_chars)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens: read back from the output.

    Turns are parsed out of the formatted text; the loss text is cut out of it by the token parts under the mask.
    Stretches of a conversation must stand in order in one partition, as ``format_conversations`` leaves them, and are digested
    as a stream.  A table read back from files needs ``repartition("conv_id").sortWithinPartitions("conv_id", "part")`` first.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, turns, loss, sums = [], hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
        for batch in batches:
            conv, texts, sizes, last = (batch.column(i).to_pylist() for i in (0, 1, 2, 5))
            lengths = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            starts, ends = (batch.column(i).flatten().to_numpy() for i in (3, 4))
            row = np.repeat(np.arange(len(texts)), lengths)
            cut = np.ones(len(row), bool)            # parts that follow one another are cut out at once
            cut[1:] = (starts[1:] != ends[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(cut)
            final = np.append(first[1:], len(row))[:len(first)] - 1
            masks = [[] for _ in texts]
            for i, a, b in zip(row[first].tolist(), starts[first].tolist(), ends[final].tolist(), strict=True):
                masks[i].append(texts[i][a:b])
            for i, formatted in enumerate(texts):
                for role, text in parse(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    sums[0] += 1
                masked = unescape("".join(masks[i]))
                loss.update(masked.encode())
                sums[1] += len(masked)
                sums[2] += len(formatted)
                sums[3] += sizes[i]
                if last[i]:
                    rows.append((conv[i], sums[0], turns.hexdigest(), sums[1], loss.hexdigest(), sums[2], sums[3]))
                    turns, loss, sums = hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []

    needed = formatted.select("conv_id", "formatted", F.size("ids").alias("n"), "loss_starts", "loss_ends", "last")
    return needed.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                     "formatted_chars long, n_tokens long")
