"""BPE with word ends: encoding over a contiguous array of adjacent ranks, and decoding.

A vocabulary file names its normaliser, how it splits a text into words, its merges and
its added tokens. Normalising and splitting are left to the public library's parts; the
merges are this module's. A word is held as its parts and, beside them, the rank of each
boundary between two. The least rank is found by a scan, its boundary is deleted, and
the two ranks next to it are looked up again, until no boundary has a rank. A
short word fits a few cache lines, so the scan is cheaper than any queue. The new words of
a slice of texts lie in one array, a word a row, and take their steps together. Long words, for
which scans would be quadratic, take their pairs from a heap; the order is the same.

A text is cut at its spaces first, and what stands between two of them is remembered
with its ids. That needs a file that drops white space, as is checked when it is read.

* A null or empty text has no tokens; a very long one is encoded whole, a very long
  word in n log n steps.
* The strings of added tokens in a text become those tokens, as in the library.
* Rows are encoded one by one, so ties, repeated rows and empty tables need no rule.
* Only the text column is read; the others pass through, unless they are named
  like a result column, which replaces them.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from citewright.llm.bpe import pack
from citewright.llm.shared import extended, held, slices, with_fields

# Words of at most so many letters share an array; longer ones take their pairs from a heap.
WIDTHS = 6, 9, 14, 24, 48, 100
# A worker remembers about so many stretches of text, and so many words, of at most so many characters (some 60 MB).
MEMO_ENTRIES = 200_000
MEMO_CHARACTERS = 40
NO_RANK = 1 << 40
# Visible ASCII, and letters that composition and newer versions of Unicode leave as they are.
PLAIN = regex.compile("[!-~\u00C0-\u00FF]+").fullmatch
# How bytes are spelled: visible ones of Latin-1 as themselves, the others as the characters from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
SPELLED = {byte: 256 + i for i, byte in enumerate(b for b in range(256) if b not in _VISIBLE)}


class WordVocabulary:
    """Tokens, merges and rules of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as lines:
            file = json.load(lines)
        model = file["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("unk_token"):
            raise ValueError("not a plain BPE vocabulary")
        if file.get("decoder") is not None:
            raise ValueError("tokens are put together by a rule that is not known here")
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.single, self.closing = np.full((2, 0x110000), -1, np.int32)
        for token, number in self.ids.items():
            if len(token) == 1:
                self.single[ord(token)] = number
            if len(token) == 1 + len(self.end) and token.endswith(self.end):
                self.closing[ord(token[0])] = number
        self.added = {token["content"]: token["id"] for token in file["added_tokens"]}
        self.spelling = {number: token for token, number in {**self.ids, **self.added}.items()}
        # A pair of ids, as one number, to its rank; and the token that each rank makes.
        self.ranks: dict[int, int] = {}
        made = []
        self.shift = max(self.ids.values()).bit_length()
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.ids[left] << self.shift | self.ids[right]] = rank
            made.append(self.ids[left + right])
        self.made = np.array(made, np.int64)
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.fromiter(self.ranks.values(), np.int64, len(keys))[order]
        rules = Tokenizer.from_file(path)
        self.normal = rules.normalizer.normalize_str if rules.normalizer else str
        self.split = rules.pre_tokenizer.pre_tokenize_str
        choices = "|".join(regex.escape(token) for token in sorted(self.added, key=len, reverse=True))
        self.cut = regex.compile(f"({choices})").split if choices else lambda text: [text]
        if any(" " in token for token in self.added) or [word for word, _ in self.split(" a b ")] != ["a", "b"]:
            raise ValueError("the vocabulary keeps white space")
        plain = self._plain(file)
        self.plain = regex.compile(f"\\n|{plain}").findall if plain else None

    def _plain(self, file: dict) -> str | None:
        """The pattern whose matches in lower case are the words of a text of ``PLAIN`` letters,
        where the file splits it in that way."""
        letters = "".join(filter(PLAIN, map(chr, range(256))))
        steps = (file.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if self.normal(letters) != letters.lower() or [step["type"] for step in steps] != ["Split", "ByteLevel"]:
            return None
        matches = steps[0]["behavior"] == "Removed" and steps[0]["invert"] and "Regex" in steps[0]["pattern"]
        if not matches or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
            return None
        return steps[0]["pattern"]["Regex"]

    def merged(self, words: list[str]) -> list[bytes]:
        """The packed tokens that the merges leave of each word."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for high in (*WIDTHS, int(sizes.max(initial=0))):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = max(low, high)
            if not len(rows):
                continue
            if high > WIDTHS[-1]:
                for row in rows.tolist():
                    out[row] = pack(self._merged_long(self._letters([words[row]]).tolist()))
                continue
            tokens = np.full((len(rows), high), -1, np.int64)
            tokens[np.arange(high) < sizes[rows, None]] = self._letters([words[row] for row in rows.tolist()])
            tokens = self._merged_short(tokens)
            ends = np.cumsum((tokens >= 0).sum(axis=1)) * 4
            packed = tokens[tokens >= 0].astype("<u4").tobytes()
            for row, start, stop in zip(rows.tolist(), [0, *ends.tolist()], ends.tolist()):
                out[row] = packed[start:stop]
        return out

    def _letters(self, words: list[str]) -> np.ndarray:
        """The tokens of single letters, those that end a word in their own form."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        tokens = self.single[codes]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) - 1
        tokens[ends] = self.closing[codes[ends]]
        if (tokens < 0).any():
            raise ValueError("the vocabulary does not hold every byte")
        return tokens

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << self.shift | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((right >= 0) & (self.keys[at] == keys), self.key_ranks[at], NO_RANK)

    def _merged_short(self, tokens: np.ndarray) -> np.ndarray:
        """A word a row: ``tokens`` i and i + 1 meet at boundary i, whose rank is ``near`` i; -1 is beyond the word.

        All words take one step at a time: scan for the least rank, delete that
        boundary, refresh the ranks beside it.
        """
        done = np.full_like(tokens, -1)
        rows, width = np.arange(len(tokens)), tokens.shape[1]
        gap = np.full((len(tokens), 1), -1, np.int64)
        tokens = np.concatenate([tokens, gap], axis=1)
        near = self._rank(tokens[:, :-1], tokens[:, 1:])
        while len(rows):
            at = near.argmin(axis=1)
            least = near[np.arange(len(rows)), at]
            ended = least == NO_RANK
            if ended.any():
                done[rows[ended]] = tokens[ended, :width]
                rows, tokens, near, at, least = rows[~ended], tokens[~ended], near[~ended], at[~ended], least[~ended]
                if not len(rows):
                    break
            every, places = np.arange(len(rows)), np.arange(width)
            after = places + (places >= at[:, None])
            tokens[every, at + 1] = self.made[least]
            tokens[:, :-1] = np.take_along_axis(tokens, after, axis=1)
            tokens[:, -1] = -1
            near[:, :-1] = np.take_along_axis(near, after[:, :-1], axis=1)
            near[:, -1] = NO_RANK
            near[every, at] = self._rank(tokens[every, at], tokens[every, at + 1])
            inner = np.flatnonzero(at)
            before = at[inner] - 1
            near[inner, before] = self._rank(tokens[inner, before], tokens[inner, before + 1])
        return done

    def _merged_long(self, tokens: list[int]) -> list[int]:
        """The same merges: pairs by rank and place from a heap, stale ones passed over."""
        rank, made, shift, count = self.ranks.get, self.made.tolist(), self.shift, len(tokens)
        tokens, after, before = list(tokens), list(range(1, count + 1)), list(range(-1, count - 1))
        queue: list[tuple[int, int, int, int]] = []

        def meet(left: int) -> None:
            right = after[left]
            if left >= 0 and right < count:
                found = rank(tokens[left] << shift | tokens[right], NO_RANK)
                if found < NO_RANK:
                    heapq.heappush(queue, (found, left, tokens[left], tokens[right]))

        for place in range(count - 1):
            meet(place)
        while queue:
            least, left, first, second = heapq.heappop(queue)
            right = after[left]
            # A part that another one has swallowed is marked -1.
            if tokens[left] != first or right >= count or tokens[right] != second:
                continue
            tokens[left], tokens[right], after[left] = made[least], -1, after[right]
            if after[left] < count:
                before[after[left]] = left
            if before[left] >= 0:
                meet(before[left])
            meet(left)
        return [token for token in tokens if token >= 0]

    def words_of(self, stretches: list[str]) -> list[list[str]]:
        """What each stretch of text is encoded as: words spelled in bytes, and added tokens as they are."""
        joined = "\n".join(stretches)
        marked = any(token in joined for token in self.added)
        out: list[list[str]] = [[] for _ in stretches]
        simple = [] if self.plain is None else [
            i for i, stretch in enumerate(stretches) if PLAIN(stretch) and not (marked and any(t in stretch for t in self.added))
        ]
        at = 0
        for word in self.plain("\n".join([stretches[i] for i in simple]).lower()) if simple else ():
            if word == "\n":
                at += 1
            else:
                out[simple[at]].append(word if word.isascii() else word.encode().decode("latin-1").translate(SPELLED))
        for i in set(range(len(stretches))).difference(simple):
            for part in self.cut(stretches[i]) if marked else [stretches[i]]:
                if part in self.added:
                    out[i].append(part)
                elif part:
                    out[i] += [word for word, _ in self.split(self.normal(part))]
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens of known ids, with a space between two."""
        return " ".join([token for token in map(self.spelling.get, ids) if token is not None])


class Encoder:
    """Encodes texts stretch by stretch between spaces, and remembers stretches and words with their ids."""

    def __init__(self, words: WordVocabulary) -> None:
        self.words = words
        self.stretches: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [text.replace("\n", " ").split(" ") for text in texts]
        memo = self.stretches
        if len(memo) >= MEMO_ENTRIES:
            memo.clear()
        fresh = list(set().union(*cut).difference(memo))
        self._learn(fresh)
        long = [stretch for stretch in fresh if len(stretch) > MEMO_CHARACTERS]
        found = [b"".join(map(memo.__getitem__, stretches)) for stretches in cut]
        for stretch in long:
            del memo[stretch]
        return found

    def _learn(self, stretches: list[str]) -> None:
        if len(self.known) >= MEMO_ENTRIES:
            self.known = {}
        known = self.known
        parts = self.words.words_of(stretches)
        fresh = list(set().union(*parts).difference(known, self.words.added))
        known.update(zip(fresh, self.words.merged(fresh)))
        known.update({token: pack([number]) for token, number in self.words.added.items()})
        self.stretches.update(zip(stretches, [b"".join(map(known.__getitem__, words)) for words in parts]))
        for word in fresh:
            if len(word) > MEMO_CHARACTERS:
                del known[word]


def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker, so that what it remembers outlives a task."""
    return held(("word_bpe", path), lambda: Encoder(WordVocabulary(path)))


Batches = Iterator[pa.RecordBatch]


def _encoding(path: str, text: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        encode_all = encoder(path).encode
        for batch in slices(batches, text):
            ids = encode_all([value or "" for value in batch.column(text).to_pylist()])
            counts = pa.array([len(value) // 4 for value in ids], pa.int64())
            yield extended(batch, ids=pa.array(ids, pa.binary()), n_tokens=counts)

    return run


def _decoding(path: str, ids: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        text_of = encoder(path).words.decode
        for batch in slices(batches, ids):
            numbers = (np.frombuffer(value or b"", "<u4").tolist() for value in batch.column(ids).to_pylist())
            yield extended(batch, decoded=pa.array([text_of(row) for row in numbers], pa.string()))

    return run


ENCODED = T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())
DECODED = T.StructField("decoded", T.StringType())


def encode(texts: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``texts`` with ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``.

    ``path`` is that of a vocabulary file in the public library's JSON format, which
    every executor has.
    """
    return texts.mapInArrow(_encoding(path, text), with_fields(texts.schema, *ENCODED))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids; null ids are none."""
    return encoded.mapInArrow(_decoding(path, ids), with_fields(encoded.schema, DECODED))


def round_trip(texts: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``texts`` as ``encode`` and then ``decode`` leave it, in one pass: a task needs one worker."""
    there, back = _encoding(path, text), _decoding(path, "ids")

    def run(batches: Batches) -> Batches:
        return back(there(batches))

    return texts.mapInArrow(run, with_fields(texts.schema, *ENCODED, DECODED))


def token_digests(texts: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every row: encoded, then decoded again."""
    rows = texts.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return round_trip(rows, path).select(
        F.col("key").alias(key),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
