"""Byte-level BPE ids of whole texts, fast enough for a corpus.

A text splits safely before any space that follows a non-space character: no match of the pre-token pattern
reaches over such a place. The chunks between those places repeat, so a task keeps the ids of the chunks it
has met, in a table of bounded size. A text with other white space before a space is encoded whole.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np
import public_tokenizers
import tiktoken

RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
#: Chunks that a task remembers, and the longest of them in characters.
CHUNKS, CHUNK_CHARS = 300_000, 48


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Chunks(dict):
    """The packed ids of a space and the key."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit = encode, limit

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(" " + chunk), "<u4").tobytes()
        if len(chunk) <= CHUNK_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = ids
        return ids


def added_tokens(path: str = TOKENIZER) -> dict[str, int]:
    """Strings that the tokenizer's JSON file gives an id of their own, wherever they stand in a text."""
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


class Encoder:
    """Ids by the ranks; texts are first cut at the strings in added, if any, which have an id each."""

    def __init__(self, path: str = RANKS, limit: int = CHUNKS, added: dict[str, int] | None = None):
        self.encode = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={}
        ).encode_ordinary
        self.chunks = Chunks(self.encode, limit)
        self.unsafe = re.compile(r"\s ").search
        self.added = {k: np.array([v], "<u4").tobytes() for k, v in (added or {}).items()}
        self.cuts = re.compile("|".join(f"({re.escape(k)})" for k in sorted(self.added, key=lambda k: (-len(k), k)))) if added else None

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cuts and self.cuts.search(text):
            parts = [p for p in self.cuts.split(text) if p]
            return b"".join(self.added[p] if p in self.added else self.plain(p) for p in parts)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if self.unsafe(text):
            return np.array(self.encode(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.encode(first), "<u4").tobytes() + b"".join(map(self.chunks.__getitem__, rest))
