"""Encoding a whole corpus with a public tokenizer.

Method, for byte-level BPE: the text is cut by the tokenizer's public pattern;
each piece becomes a doubly linked list of symbols; a heap holds the merge
ranks of adjacent pairs, and entries whose symbols have changed since are
skipped.  Ids are decoded by concatenating the vocabulary's strings.

The vocabulary file is read on the driver and broadcast; its size is checked.
Pieces recur, so each worker keeps the ids of the pieces it has met, up to a
fixed number.  Other kinds of public tokenizers are run by their own libraries.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame

from vectrine.functions.arrow_vectors import flat, list_column

#: Fixed value: the published pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_FOLDER = "/opt/tokenizers"
#: Largest vocabulary file that is broadcast.
MOST_BYTES = 64 << 20
#: Pieces whose ids a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 1 << 18, 64


class BytePairEncoder:
    """Byte-level BPE from a file of ``base64 rank`` lines."""

    def __init__(self, file: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}
        self.strings = {r: s for s, r in self.ranks.items()}
        # the published tokenizers' \s is Unicode white space, without the separators U+001C to U+001F
        white = r"\p{White_Space}"
        self.find = regex.compile(pattern.replace(r"[^\s", rf"[^{white}").replace(r"\S", rf"\P{{White_Space}}").replace(r"\s", white)).findall
        self.memory: dict[str, tuple[int, ...]] = {}

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        end = list(range(1, n + 1))  # symbol i is piece[i:end[i]]; end[i] is also the next symbol
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        dead = bytearray(n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if dead[i] or j >= n or end[j] != stop:
                continue  # stale: one of the two symbols has changed
            dead[j] = 1
            end[i] = stop
            if stop < n:
                prev[stop] = i
                r = ranks.get(piece[i : end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            p = prev[i]
            if p >= 0:
                r = ranks.get(piece[p:stop])
                if r is not None:
                    heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of the text as it is; none for an empty or null text."""
        out: list[int] = []
        if not text:
            return out
        memory, extend = self.memory, out.extend
        for piece in self.find(text):
            ids = memory.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode())
                if len(piece) <= LONGEST:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[piece] = ids
            extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode(errors="replace")


class _Library:
    """A tokenizer that is run by its own library."""

    def __init__(self, file: bytes, kind: str):
        if kind == "json":
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(file.decode())
            t.encode_special_tokens = True
            self.encode_text = lambda s: t.encode(s, add_special_tokens=False).ids
        else:
            import sentencepiece

            self.encode_text = sentencepiece.SentencePieceProcessor(model_proto=file).encode

    def encode(self, text: str | None) -> list[int]:
        return self.encode_text(text) if text else []


@dataclass(frozen=True)
class TokenizerFile:
    """A vocabulary file: ``.tiktoken`` (byte-level ranks), ``.json`` or ``.model``."""

    name: str = "byte_bpe_50k.tiktoken"
    folder: str = DEFAULT_FOLDER

    def read(self) -> tuple[bytes, str]:
        path = Path(self.folder, self.name)
        if path.stat().st_size > MOST_BYTES:
            raise ValueError(f"{path} is too large to broadcast")
        return path.read_bytes(), path.suffix[1:]


@lru_cache(maxsize=2)
def build(file: bytes, kind: str):
    """The encoder of a vocabulary file; a worker builds it once."""
    return BytePairEncoder(file) if kind == "tiktoken" else _Library(file, kind)


def _encode(shared, lengths_only: bool):
    def run(batches):
        coder = build(*shared.value)
        for b in batches:
            texts = flat(b.column(1)).to_pylist()
            counts, flat_ids = np.zeros(len(texts), np.int64), []
            for n, t in enumerate(texts):
                ids = coder.encode(t)
                counts[n] = len(ids)
                if not lengths_only:
                    flat_ids.append(np.array(ids, np.int32))
            if lengths_only:
                yield pa.record_batch([b.column(0), pa.array(counts)], ["id", "n"])
            else:
                values = np.concatenate(flat_ids) if flat_ids else np.empty(0, np.int32)
                yield pa.record_batch([b.column(0), list_column(values, counts, pa.int32())], ["id", "ids"])

    return run


def encode_corpus(df: DataFrame, record: Column, text: Column, file: TokenizerFile = TokenizerFile()) -> DataFrame:
    """(id, ids): the token ids of every row's text, without special tokens.

    Empty and null texts give an empty list.  The text is taken whole and as it
    is, white space included.  Every row gives a row, repeated and null ids
    too; an empty table gives an empty result.  Other columns play no part.
    """
    shared = df.sparkSession.sparkContext.broadcast(file.read())
    rows = df.select(record.alias("id"), text.alias("t"))
    return rows.mapInArrow(_encode(shared, False), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, record: Column, text: Column, file: TokenizerFile = TokenizerFile()) -> DataFrame:
    """(id, n): as :func:`encode_corpus`, only the number of tokens."""
    shared = df.sparkSession.sparkContext.broadcast(file.read())
    rows = df.select(record.alias("id"), text.alias("t"))
    return rows.mapInArrow(_encode(shared, True), f"id {rows.schema['id'].dataType.simpleString()}, n long")
