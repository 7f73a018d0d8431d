"""Token ids of whole texts by a public byte-level BPE vocabulary, with a cache of space-delimited words.

The vocabulary's split pattern always starts a new piece before a space that is followed by a non-space
character, so a text may be cut there and its parts encoded on their own: the ids are the same.  Words
recur, so most parts come from the cache.  Texts with other runs of white space are encoded whole.
"""

from __future__ import annotations

import base64
import re
import struct

#: The vocabulary's split pattern (fixed value).
PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_SPACE_RUN = re.compile(r" (?=\s|\Z)")
#: The tokenizer's only special token (fixed values).
END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", 50256
CACHE_WORDS = 200_000
CACHE_WORD_CHARS = 48


def default_ranks_path() -> str:
    """The public 50k byte-level vocabulary installed beside Spark."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Parts(dict):
    """Word -> its ids as little-endian uint32 bytes; at most CACHE_WORDS words of bounded length are kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word):
        ids = self.encode(" " + word)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHE_WORD_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = packed
        return packed


class TextEncoder:
    """``ids_bytes(text)``: the ids of a whole text, packed as little-endian unsigned 32-bit integers.

    ``specials``: the text of the special token is its id, as for the tokenizer by default; otherwise it is ordinary text.
    """

    def __init__(self, ranks_path: str, specials: bool = False):
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks,
                                         special_tokens={}).encode_ordinary
        self._parts = _Parts(self._encode)
        self._specials = specials

    def ids_bytes(self, text: str) -> bytes:
        if not text:
            return b""
        if self._specials and END_OF_TEXT in text:
            return struct.pack("<I", END_OF_TEXT_ID).join(map(self._ordinary, text.split(END_OF_TEXT)))
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        if _SPACE_RUN.search(text):
            ids = self._encode(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        first, *rest = text.split(" ")
        ids = self._encode(first) if first else []
        return struct.pack(f"<{len(ids)}I", *ids) + b"".join(map(self._parts.__getitem__, rest))
