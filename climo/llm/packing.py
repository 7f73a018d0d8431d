"""Cost-balanced packing of tokenized documents into fixed-length training sequences.

Method: a document's attention cost is estimated as ``linear * n + quadratic * n^2``; pieces are
assigned in descending order of cost to the lowest-cost sequence that still has room.

Every task packs its own documents in windows of about ``window_tokens`` tokens, so nothing is
shuffled, no group can grow beyond a window, and a task that is run again writes the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from climo.llm.tokens import TextEncoder, default_ranks_path
from climo.session import ship_package

PIECES_SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
                 "offset long, sequence_tokens long, sequence_cost double")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("sequence_tokens", pa.int64()), ("sequence_cost", pa.float64())])
#: Sequence numbers of one task; its partition number stands above these bits.
SEQUENCE_BITS = 40


def attention_cost(n, linear: float = 1.0, quadratic: float = 1.0 / 1024):
    """Estimated cost of a piece of ``n`` tokens: linear layers plus attention within the piece."""
    return linear * n + quadratic * n * n


def sequence_capacities(total: int, max_tokens: int, last: bool) -> list[int]:
    """Lengths of the sequences for ``total`` tokens.

    All are ``max_tokens`` long but for the rest of a task's last window, which is laid out as powers of
    two (those need no padding).  Other windows leave their rest to the next window.
    """
    full, rest = divmod(total, max_tokens)
    out = [max_tokens] * full
    if last:
        out += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return out


def assign_pieces(pieces: list[tuple], capacities: list[int], cost=attention_cost) -> tuple[list[list], list[tuple]]:
    """Assign ``pieces`` (key, start, n) to sequences of the given capacities.

    Pieces go in descending order of length (hence of cost) to the lowest-cost sequence with room.  A
    piece that fits nowhere is cut: the lowest-cost sequence with any room takes what it can hold.
    Returns the pieces of each sequence, and what no sequence had room for.
    """
    room = np.array(capacities, dtype=np.int64)
    spent = np.zeros(len(room))
    held: list[list] = [[] for _ in capacities]
    left: list[tuple] = []
    for key, start, n in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        while n:
            fits = room >= n
            if not fits.any():
                fits = room > 0
                if not fits.any():
                    left.append((key, start, n))
                    break
            at = int(np.where(fits, spent, np.inf).argmin())
            part = min(n, int(room[at]))
            held[at].append((key, start, part))
            room[at] -= part
            spent[at] += cost(part)
            start, n = start + part, n - part
    return held, left


class _TaskPacker:
    def __init__(self, max_tokens: int, window_tokens: int):
        self.max_tokens, self.window_tokens = max_tokens, window_tokens
        self.next_id = TaskContext.get().partitionId() << SEQUENCE_BITS
        self.docs: list[tuple] = []          # (doc_id, ids)
        self.pieces: list[tuple] = []        # (index into docs, start, n)
        self.tokens = 0

    def add(self, doc_id, ids: bytes) -> bool:
        """Keep a document; True when the window is full."""
        self.docs.append((doc_id, ids))
        self.pieces.append((len(self.docs) - 1, 0, len(ids) // 4))
        self.tokens += len(ids) // 4
        return self.tokens >= self.window_tokens

    def flush(self, last: bool) -> Iterator[pa.RecordBatch]:
        full, rests = [], []
        for key, start, n in self.pieces:
            for _ in range(n // self.max_tokens):
                full.append([(key, start, self.max_tokens)])
                start += self.max_tokens
            if n % self.max_tokens:
                rests.append((key, start, n % self.max_tokens))
        capacities = sequence_capacities(sum(p[2] for p in rests), self.max_tokens, last)
        held, left = assign_pieces(rests, capacities)
        cols: list[list] = [[] for _ in _ARROW]
        for sequence in full + held:
            total, spent, offset = sum(p[2] for p in sequence), sum(attention_cost(p[2]) for p in sequence), 0
            for key, start, n in sequence:
                doc_id, ids = self.docs[key]
                row = (doc_id, start, n, ids[4 * start:4 * (start + n)], len(ids) // 4, self.next_id, offset, total, spent)
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
                offset += n
            self.next_id += 1
        kept = sorted({p[0] for p in left})
        moved = {key: i for i, key in enumerate(kept)}
        self.docs = [self.docs[key] for key in kept]
        self.pieces = [(moved[key], start, n) for key, start, n in left]
        self.tokens = sum(p[2] for p in left)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048,
                   end_id: int = 1, ranks_path: str | None = None, window_tokens: int = 1 << 20,
                   specials: bool = False) -> DataFrame:
    """Tokenize whole texts and pack them into sequences of at most ``max_tokens`` tokens.

    Returns one row per piece: doc_id, start (the document's ids before it), length, ids (little-endian
    uint32 bytes), doc_tokens (with the end id), sequence_id, offset, sequence_tokens, sequence_cost.
    Each id of a document, ``end_id`` included, lies in exactly one piece; offsets in a sequence have
    no gaps.  Full stretches of ``max_tokens`` stand alone, shorter rests are balanced by cost.

    A null or empty text is the end id alone.  A null id stays null.  Repeated rows are packed each on
    their own; ties of length go by input order.  An empty table gives no rows.  Other columns of
    ``docs`` are not read.  With ``specials`` the text <|endoftext|> is the tokenizer's special id, otherwise ordinary text.
    """
    ship_package(docs.sparkSession)
    path = ranks_path or default_ranks_path()
    end = int(end_id).to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = TextEncoder(path, specials), _TaskPacker(max_tokens, window_tokens)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if packer.add(doc_id.as_py(), encoder.ids_bytes(text.as_py() or "") + end):
                    yield from packer.flush(last=False)
        yield from packer.flush(last=True)

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(pack, PIECES_SCHEMA)
