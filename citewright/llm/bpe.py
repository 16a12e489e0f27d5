"""Byte-level BPE: encoding by backtracking over longest matches, and decoding.

The bytes of a text are mapped to Latin-1 characters so that the trie of
``pyahocorasick`` finds the longest vocabulary entry at a place. Encoding then takes the
longest entry at each place and steps back to a shorter one where two
neighbouring tokens could not have come out of the merges. Whether they could
depends on the two tokens alone, so the answer is memoised, and a place that
turned out a dead end is never entered twice: time is linear in the text.

* A null or empty text has no tokens; a very long one is encoded whole.
* Rows are encoded one by one, so ties, repeated rows and empty tables need no rule.
* Only the text column is read; the others pass through, unless they are named
  like a result column, which replaces them.
"""

from __future__ import annotations

import base64
import struct
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewright.llm.shared import extended, held, slices, with_fields

# Entries of each of a worker's three memo tables (some 25 MB); a full table is emptied and fills again.
MEMO_ENTRIES = 150_000
# Longer pieces are seldom seen twice and are not remembered.
MEMO_PIECE = 48
# A space after white space: there the text does not split at single spaces.
DOUBLE_SPACE = regex.compile(r"\s ")


class Vocabulary:
    """Ranks of byte strings, as tokens of a byte-level BPE."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.size = 1 + max(ranks.values(), default=-1)
        self.spelling: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.spelling[rank] = token
        self.reach = max(map(len, ranks), default=0)
        # Every prefix of a token leads to the longest token that it begins with, or -1.
        best: dict[bytes, int] = {}
        self.shorter = [-1] * self.size
        for token, rank in ranks.items():
            found = -1
            for n in range(1, len(token) + 1):
                self.shorter[rank] = found
                found = best[token[:n]] = ranks.get(token[:n], found)
        self.trie = ahocorasick.Automaton()
        for start, rank in best.items():
            self.trie.add_word(start.decode("latin-1"), rank)
        self.sizes = [len(token) for token in self.spelling]
        self._fits: dict[tuple[int, int], bool] = {}
        self._merged: dict[tuple[int, int], int] = {}
        self._halves: list[tuple[int, int]] = [(rank, rank) for rank in range(self.size)]
        for rank in sorted(ranks.values()):
            self._learn(rank)
        self._fits.clear()

    def _learn(self, rank: int) -> None:
        """Find the two earlier tokens whose merge is ``rank``."""
        spelling = self.spelling[rank]
        left = self.shorter[rank]
        while left >= 0:
            right = self.ranks.get(spelling[len(self.spelling[left]) :], -1)
            if 0 <= right < rank and left < rank and self._compatible(left, right):
                self._merged[left, right] = rank
                self._halves[rank] = (left, right)
                return
            left = self.shorter[left]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges can leave these two tokens side by side; -1 is the start of the text."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= MEMO_ENTRIES:
                self._fits.clear()
            known = self._fits[left, right] = left < 0 or self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the later of the two merges again and again: had a merge across the
        # border come before one that was undone, the border would have vanished.
        bound = self.size
        while True:
            if self._merged.get((left, right), bound) < bound:
                return False
            for last in (left > right, left <= right):
                if last:
                    bound, part = left, self._halves[left][1]
                    if part != left:
                        left = part
                        break
                else:
                    bound, part = right + 1, self._halves[right][0]
                    if part != right:
                        right = part
                        break
            else:
                return True

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one piece of text."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        sizes, shorter, fits = self.sizes, self.shorter, self._fits
        longest, known, reach = self.trie.longest_prefix, self.trie.get, self.reach
        latin = data.decode("latin-1")
        dead = set()
        tokens: list[int] = []
        place, last = 0, -1
        token = known(latin[: longest(latin[:reach])], -1)
        while token >= 0:
            while token >= 0:
                end = place + sizes[token]
                pair = last, token
                if end not in dead and (fits[pair] if pair in fits else self.fits(last, token)):
                    tokens.append(token)
                    place, last = end, token
                    ahead = latin[end : end + reach]
                    token = known(ahead[: longest(ahead)], -1) if ahead else -1
                    break
                token = shorter[token]
            else:
                dead.add(place)
                if not tokens:
                    break
                token = tokens.pop()
                place -= sizes[token]
                last = tokens[-1] if tokens else -1
        if place < len(data):
            raise ValueError("the vocabulary does not hold every byte of the text")
        return tokens


def pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else struct.pack(f"<{len(ids)}I", *ids)


def rank_file(path: str) -> dict[bytes, int]:
    """What a rank file holds: a base64 byte string and its rank per line."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(rank_file(path))


class Encoder:
    """Splits texts by a pattern and encodes each match; remembers the ids of short pieces.

    ``by_words`` says that no match of the pattern goes on from a character that is
    not white space to one that is, and that a match depends on nothing beyond the
    white space and the word it lies in. A text then splits at its single spaces
    first, and the ids of a space and what follows it are remembered together. It
    also says that a space and letters after it are one match.
    """

    def __init__(self, words: Vocabulary, pattern: str, by_words: bool) -> None:
        self.words = words
        self.split = regex.compile(pattern).findall
        self.by_words = by_words
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.by_words or DOUBLE_SPACE.search(text):
            return self._pieces(text)
        parts, memo = text.split(" "), self.parts
        first = self._pieces(parts[0])
        del parts[0]
        try:
            return first + b"".join(map(memo.__getitem__, parts))
        except KeyError:
            return first + b"".join([memo.get(part) or self._part(part) for part in parts])

    def _pieces(self, text: str) -> bytes:
        memo = self.pieces
        return b"".join([memo.get(piece) or self._piece(piece) for piece in self.split(text)])

    def _part(self, part: str) -> bytes:
        """The ids of a space and ``part``; a space and letters are one piece."""
        if part.isalpha():
            return self._kept(self.parts, part, self.words.piece(b" " + part.encode()))
        found = b""
        for piece in self.split(" " + part):
            if piece[0] == " " and piece[1:].isalpha():
                found += self.parts.get(piece[1:]) or self._part(piece[1:])
            else:
                found += self.pieces.get(piece) or self._piece(piece)
        return self._remembered(self.parts, part, found)

    def _piece(self, piece: str) -> bytes:
        return self._kept(self.pieces, piece, self.words.piece(piece.encode("utf-8", "replace")))

    def _kept(self, memo: dict[str, bytes], key: str, tokens: list[int]) -> bytes:
        return self._remembered(memo, key, pack(tokens))

    def _remembered(self, memo: dict[str, bytes], key: str, found: bytes) -> bytes:
        if len(key) <= MEMO_PIECE:
            if len(memo) >= MEMO_ENTRIES:
                memo.clear()
            memo[key] = found
        return found


def encoder(ranks: str, pattern: str, by_words: bool) -> Encoder:
    """One encoder for all tasks of a worker, so that what it remembers outlives a task."""
    return held(("byte_bpe", ranks, pattern, by_words), lambda: Encoder(vocabulary(ranks), pattern, by_words))


@lru_cache(maxsize=2)
def spellings(path: str) -> list[bytes]:
    """The bytes of each id of a rank file: a few MB, kept beside an encoder."""
    ranks = rank_file(path)
    found = [b""] * (1 + max(ranks.values(), default=-1))
    for token, rank in ranks.items():
        found[rank] = token
    return found


Batches = Iterator[pa.RecordBatch]


def _encoding(ranks: str, pattern: str, text: str, by_words: bool) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        ids_of = encoder(ranks, pattern, by_words).ids
        for batch in slices(batches, text):
            ids = [ids_of(value or "") for value in batch.column(text).to_pylist()]
            counts = pa.array([len(value) // 4 for value in ids], pa.int64())
            yield extended(batch, ids=pa.array(ids, pa.binary()), n_tokens=counts)

    return run


def _decoding(ranks: str, ids: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        spelling = spellings(ranks)
        for batch in slices(batches, ids):
            numbers = (np.frombuffer(value or b"", "<u4").tolist() for value in batch.column(ids).to_pylist())
            texts = [b"".join(map(spelling.__getitem__, row)) for row in numbers]
            yield extended(batch, decoded=pa.array(texts, pa.binary()))

    return run


ENCODED = T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())
DECODED = T.StructField("decoded", T.BinaryType())


def encode(
    texts: DataFrame, ranks: str, pattern: str, text: str = "text", by_words: bool = False
) -> DataFrame:
    """``texts`` with ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``.

    ``ranks`` is the path of a rank file that every executor has; each match of
    ``pattern`` is encoded by itself, as the public library for such files does.
    ``by_words`` may be set for patterns as ``Encoder`` describes; it saves time only.
    """
    return texts.mapInArrow(_encoding(ranks, pattern, text, by_words), with_fields(texts.schema, *ENCODED))


def decode(encoded: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes its ids stand for; null ids are none."""
    return encoded.mapInArrow(_decoding(ranks, ids), with_fields(encoded.schema, DECODED))


def round_trip(
    texts: DataFrame, ranks: str, pattern: str, text: str = "text", by_words: bool = False
) -> DataFrame:
    """``texts`` as ``encode`` and then ``decode`` leave it, in one pass: a task needs one worker."""
    there, back = _encoding(ranks, pattern, text, by_words), _decoding(ranks, "ids")

    def run(batches: Batches) -> Batches:
        return back(there(batches))

    return texts.mapInArrow(run, with_fields(texts.schema, *ENCODED, DECODED))


def token_digests(
    texts: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", by_words: bool = False
) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every row: encoded, then decoded again."""
    rows = texts.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return round_trip(rows, ranks, pattern, by_words=by_words).select(
        F.col("key").alias(key),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
