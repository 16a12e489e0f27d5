"""Language identification by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary. The
probability of a word is the sum over all ways to cut it into pieces, which a
forward pass computes; that of a text is the product over its words, because no
piece goes beyond a word. So a word is scored once per worker and then counted.
The probabilities come from expected piece counts (forward and backward passes)
over labelled texts, by a few rounds of expectation maximisation.

A word is a run of letters, lower-cased, behind the vocabulary's word mark. A
letter that is no piece counts as one unknown piece.

* A text that is null, empty or has no letters is ``und`` with score 0; so is
  every text if there was nothing to learn from. Very long texts and words are
  scored whole, in time linear in their length; very long words are learned from in stretches.
* Equal scores go to the first language in order of its name.
* Columns named like a result column make way for it in ``identify``; ``predict`` reads three columns only.
* Rows are scored one by one, so repeated rows repeat their result; rows whose
  label or text is null teach nothing.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewright.llm.shared import extended, held, slices, with_fields, written

MARK = "▁"
ALPHABETIC = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"

# About so many labelled texts of each language are learned from, chosen by a
# hash of their key; a piece gets this much more than its expected count.
TEXTS_PER_LANGUAGE = 1_000
ROUNDS = 3
SMOOTHING = 0.01

# Words that a worker remembers the scores of, and that a task counts before it
# passes the counts on (some 30 MB).
MEMO_WORDS = 150_000
# Letters of words of one length that are scored at once.
BLOCK = 65_536
# In what is learned from, a longer word counts as stretches of so many letters.
LONGEST_LEARNED = 512


def letter_runs(text: str | None) -> list[str]:
    """The words of a text: runs of letters, lower-cased."""
    found = ALPHABETIC.findall((text or "").lower())
    if found and not "".join(found).isalpha():
        # The pattern also takes fractions and letter-like numbers, which are no letters.
        parts = ("".join(c if c.isalpha() else " " for c in word).split() for word in found)
        found = [part for split in parts for part in split]
    return found


@dataclass(frozen=True)
class Model:
    """``weights[piece, language]``: probabilities; the last two rows are a
    longer string that is no piece (0), and an unknown letter."""

    languages: tuple[str, ...]
    weights: np.ndarray
    priors: np.ndarray
    vocabulary: str


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[dict[str, int], int]:
    """Piece numbers of a vocabulary, and its longest piece. Only plain pieces count."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = model.is_control, model.is_unknown, model.is_byte, model.is_unused
    plain = [model.id_to_piece(i) for i in range(model.vocab_size()) if not any(test(i) for test in special)]
    return {piece: n for n, piece in enumerate(plain)}, max(map(len, plain), default=1)


def _grid(block: list[str], known: dict[str, int], reach: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """For marked words of one length: each place pair and the piece between, by end and start."""
    size, none = len(block[0]), len(known)
    for end in range(1, size + 1):
        for start in range(max(0, end - reach), end):
            miss = none + 1 if end - start == 1 else none
            found = (known.get(word[start:end], miss) for word in block)
            yield start, end, np.fromiter(found, np.int32, len(block))


def word_scores(words: Iterable[str], weights: np.ndarray, path: str) -> Iterator[tuple[str, np.ndarray]]:
    """Log probability of each word in each language."""
    known, reach = pieces(path)
    by_size: dict[int, list[str]] = defaultdict(list)
    for word in words:
        by_size[len(word)].append(word)
    for size, same in by_size.items():
        step = max(1, BLOCK // (size + 1))
        for at in range(0, len(same), step):
            block = same[at : at + step]
            logs = np.zeros((len(block), weights.shape[1]))
            sums = {0: np.ones_like(logs)}
            for start, end, ids in _grid([MARK + word for word in block], known, reach):
                part = sums[start] * weights[ids]
                sums[end] = sums[end] + part if end in sums else part
                if start == end - 1 and end % 16 == 0:
                    # Keep what is still needed near one; its size goes to the logs.
                    scale = sums[end].copy()
                    logs += np.log(scale)
                    sums = {place: value / scale for place, value in sums.items() if place > end - reach}
            logs += np.log(sums[len(block[0]) + 1])
            yield from zip(block, logs)


def expected_counts(
    words: list[str], langs: np.ndarray, counts: np.ndarray, weights: np.ndarray, path: str
) -> np.ndarray:
    """``[piece, language]``: how often each piece is used, over all segmentations of the words."""
    known, reach = pieces(path)
    total = np.zeros_like(weights)
    sizes = np.array([len(word) for word in words])
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for same in np.split(order, cuts) if len(order) else []:
        size = 1 + int(sizes[same[0]])
        step = max(1, BLOCK // size)
        for at in range(0, len(same), step):
            rows = same[at : at + step]
            lang = langs[rows]
            edges = _grid([MARK + words[i] for i in rows], known, reach)
            scaled = [(start, end, ids, weights[ids, lang]) for start, end, ids in edges]
            into, onward = [[] for _ in range(size + 1)], [[] for _ in range(size + 1)]
            for start, end, _, p in scaled:
                into[end].append((start, p))
                onward[start].append((end, p))
            ahead = np.zeros((size + 1, len(rows)))
            back = np.zeros((size + 1, len(rows)))
            ahead[0] = back[size] = 1
            logs_ahead = np.zeros((size + 1, len(rows)))
            for end in range(1, size + 1):
                # Each place is scaled to one, relative to the place before it.
                here = sum(ahead[s] * p * np.exp(logs_ahead[s] - logs_ahead[end - 1]) for s, p in into[end])
                logs_ahead[end] = logs_ahead[end - 1] + np.log(here)
                ahead[end] = 1
            logs_back = np.zeros((size + 1, len(rows)))
            for start in range(size - 1, -1, -1):
                here = sum(back[e] * p * np.exp(logs_back[e] - logs_back[start + 1]) for e, p in onward[start])
                logs_back[start] = logs_back[start + 1] + np.log(here)
                back[start] = 1
            for start, end, ids, p in scaled:
                share = p * np.exp(logs_ahead[start] + logs_back[end] - logs_ahead[size])
                np.add.at(total, (ids, lang), share * counts[rows])
    return total


def _normal(counts: np.ndarray) -> np.ndarray:
    """Probabilities from counts; a string that is no piece keeps none."""
    weights = counts + SMOOTHING
    weights[-2] = 0
    return weights / weights.sum(axis=0)


def _stretches(words: list[str]) -> Iterator[str]:
    for word in words:
        if len(word) <= LONGEST_LEARNED:
            yield word
        else:
            yield from (word[at : at + LONGEST_LEARNED] for at in range(0, len(word), LONGEST_LEARNED))


def _count_words(rows: DataFrame) -> DataFrame:
    """``lang, word, n`` of all rows; each task counts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[str]] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                words, n = pa.array(list(found), pa.string()), pa.array(found.values(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), words, n], names=["lang", "word", "n"])
            counts.clear()

        for batch in slices(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counts[lang].update(_stretches(letter_runs(text)))
            if sum(map(len, counts.values())) >= MEMO_WORDS:
                yield from out()
        yield from out()

    counted = rows.mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(
    labelled: DataFrame,
    vocabulary: str,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    texts_per_language: int = TEXTS_PER_LANGUAGE,
) -> Model:
    """A model from labelled texts.

    The texts are a sample of bounded size: about ``texts_per_language`` of each
    language, the same ones on every run; rows that repeat key and text are chosen together. What reaches the driver is a number per
    piece and language.
    """
    rows = labelled.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")
    ).filter("text is not null and lang is not null")
    sizes = {row["lang"]: row["n"] for row in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    known, _ = pieces(vocabulary)
    shape = (len(known) + 2, len(languages))
    if not languages:
        return Model((), np.zeros(shape), np.zeros(0), vocabulary)
    share = F.element_at(
        F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, texts_per_language / n))]), F.col("lang")
    )
    # The text is part of what is hashed, so that rows of one key, or of none, are not chosen together.
    chosen = rows.filter(F.pmod(F.xxhash64("key", "text"), F.lit(1_000_003)) < share * 1_000_003).select("lang", "text")
    words = written(_count_words(chosen), "language-words")
    number = {name: n for n, name in enumerate(languages)}
    counts = np.ones(shape)
    counts[-2] = 0
    weights = _normal(counts)
    for _ in range(ROUNDS):
        shared = words.sparkSession.sparkContext.broadcast((weights, number, vocabulary))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, numbers, path = shared.value
            total = np.zeros_like(now)
            for batch in batches:
                langs = np.array([numbers[name] for name in batch.column("lang").to_pylist()], np.int64)
                n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
                total += expected_counts(batch.column("word").to_pylist(), langs, n, now, path)
            at = np.nonzero(total)
            columns = [pa.array(at[0], pa.int64()), pa.array(at[1], pa.int64()), pa.array(total[at], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["piece", "lang", "n"])

        used = words.mapInArrow(run, "piece long, lang long, n double").groupBy("piece", "lang")
        found = used.agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(shape)
        counts[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
        weights = _normal(counts)
    total = sum(sizes.values())
    return Model(languages, weights, np.log([sizes[name] / total for name in languages]), vocabulary)


class _Scorer:
    """Scores texts; keeps the scores of words across the tasks of a worker."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def totals(self, texts: list[str | None]) -> list[np.ndarray | None]:
        counted = [Counter(letter_runs(text)) for text in texts]
        if len(self.place) >= MEMO_WORDS:
            self.place = {}
        new = list({word for counts in counted for word in counts if word not in self.place})
        known = len(self.place)
        if known + len(new) > len(self.scores):
            # Room for twice as many, so that a slice does not copy what is known.
            room = np.zeros((2 * (known + len(new)), len(self.model.languages)))
            room[:known] = self.scores[:known]
            self.scores = room
        for number, (word, score) in enumerate(word_scores(new, self.model.weights, self.model.vocabulary), known):
            self.place[word] = number
            self.scores[number] = score
        place, out = self.place, []
        for counts in counted:
            where = np.fromiter(map(place.__getitem__, counts), np.int64, len(counts))
            times = np.fromiter(counts.values(), float, len(counts))
            out.append(times @ self.scores[where] if counts else None)
        return out


def identify(texts: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``texts`` with ``lang_pred`` and ``score``, its share among all learned languages (0 to 1)."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    ident = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("language", ident), lambda: _Scorer(shared.value))
        names, priors = scorer.model.languages, scorer.model.priors
        for batch in slices(batches, text):
            langs, scores = [], []
            for total in scorer.totals(batch.column(text).to_pylist()) if names else [None] * batch.num_rows:
                best, score = UNKNOWN, 0.0
                if total is not None:
                    odds = np.exp(total + priors - (total + priors).max())
                    best, score = names[int(odds.argmax())], float(odds.max() / odds.sum())
                langs.append(best)
                scores.append(score)
            yield extended(batch, lang_pred=pa.array(langs, pa.string()), score=pa.array(scores, pa.float64()))

    added = T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())
    return texts.mapInArrow(run, with_fields(texts.schema, *added))


def held_out(key: str) -> Column:
    """Whether a row is set aside: its key's CRC-32, as text, leaves 2 when divided by 4; null is not."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, held_out, lang_pred, score`` of every document, learned from those not set aside."""
    usable = documents.filter(~held_out(key) & F.col(f"`{key}`").isNotNull())
    model = learn(usable, vocabulary, key, text, lang)
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), held_out(key).alias("held_out"))
    found = identify(rows, model)
    return found.select(F.col("key").alias(key), "held_out", "lang_pred", "score")
