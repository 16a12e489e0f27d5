"""Spelling variants: words one edit apart, found in a trie over letter-group counts.

A word's letters are counted in groups, and words are arranged by the successive counts.
One edit adds one letter to a group (surplus), takes one from a group (deficit), or does
both, so a depth-first search for near words spends a surplus and a deficit of one each
on the way down; words at the leaves it reaches are compared letter by letter.

Spark holds the upper levels of the trie: a cell is a word length and the first counts. A
word lies in one cell and is sent, with what is left of its budget, to the few others
that it can reach. A cell that holds more rows than a task should is parted by its next
count, and so on down to the leaves; a leaf too large still is parted by the halves of
its words, of which one edit leaves one unchanged. A task then builds the rest of the
trie for one cell after the other. Every pair of near words is met once: a search goes
to longer words, to words of the same length later in the trie, or later in the same leaf.

* A null text has no words, a null id is the empty string; a very long text is read whole
  and so is a very long word. Of forms that occur equally often the first in code-point
  order is taken. Repeated rows count as often as they occur; an empty table has no words.
* Only id and text are read; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.llm.shared import discard, partitions_for, slices, written

# Words have so many letters and occurrences at least.
LEAST_LETTERS = 5
LEAST_COUNT = 3
# One run of letters in so many loses a letter.
SLIPS = 97
# A form occurs so many times as often as its variant.
TIMES = 2
# Letters counted together, frequent ones alone; all others, with marks or not, are the last group.
GROUPS = "e", "a", "i", "n", "r", "t", "s", "o", "lv", "udk", "cmx", "pgq", "bhf"
DEPTH = len(GROUPS) + 1
# Levels that Spark deals out at once; a cell of more rows is parted further.
FIRST_LEVELS = 3
MOST_ROWS = 65_536
# A leaf of more words is looked up by halves.
MOST_LEAF = 24
# A task hands on its words at so many (some 60 MB).
MOST_WORDS = 400_000
# A form occurs at least twice as often as its variant, so a chain is shorter than 2**6 words.
DOUBLINGS = 6

# The states of a search: a word at home, one with its surplus spent, with both spent, and
# one on its way to longer words, before and after its surplus. Each step: change of the
# count, next state.
HOME, MORE, BOTH, LONG, LONGER = range(5)
STEPS = {
    HOME: ((0, HOME), (1, MORE)),
    MORE: ((0, MORE), (-1, BOTH)),
    BOTH: ((0, BOTH),),
    LONG: ((0, LONG), (1, LONGER)),
    LONGER: ((0, LONGER),),
}

_LETTERS = {*range(65, 91), *range(97, 123), *range(0xC0, 0x100)}
# A-Z in lower case, other letters as they are, all else a space, in Latin-1.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b in _LETTERS else 32 for b in range(256))
GROUP_OF = bytes(next((i for i, g in enumerate(GROUPS) if chr(b) in g), len(GROUPS)) for b in range(256))


def counted(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: the distinct words and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in slices(batches, "text"):
            for ident, value in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                runs = Counter((value or "").encode("latin-1", "replace").translate(FOLDED).split())
                start = crc32(f"{ident or ''}:".encode())
                for word, n in runs.items():
                    if len(word) >= LEAST_LETTERS:
                        spelled = word if word.isascii() else word.decode("latin-1").encode()
                        mark = crc32(spelled, start)
                        if mark % SLIPS == 0:
                            at = mark % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < LEAST_LETTERS:
                                continue
                        found[word] += n
                if len(found) >= MOST_WORDS:
                    yield _batch(found)
                    found.clear()
        if found:
            yield _batch(found)

    rows = documents.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    words = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.filter(F.col("n") >= LEAST_COUNT)


def _batch(found: Counter[bytes]) -> pa.RecordBatch:
    words = [word.decode("latin-1") for word in found]
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])


def counts(word: str) -> list[int]:
    groups = word.encode("latin-1").translate(GROUP_OF)
    return [groups.count(g) for g in range(DEPTH)]


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes ``a`` ``b``; ``a`` is not longer than ``b``."""
    if len(b) - len(a) > 1 or a == b:
        return False
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _deeper(word: str, vector: list[int], state: int, cell: str, level: int) -> Iterator[tuple[int, str]]:
    """Where a word in a cell goes at the next level. At the leaves: to the halves of words."""
    if level < DEPTH:
        for change, follows in STEPS[state]:
            if vector[level] + change >= 0:
                yield follows, f"{cell},{vector[level] + change}"
        return
    for half in _halves(word, state):
        yield state, f"{cell}|{half}"


def _halves(word: str, state: int) -> list[str]:
    """Keys of which two near words in one leaf share one: one edit leaves a half of the word
    as it is, where halves are those of the shorter word. ``=``: words of one length."""
    keys = []
    if state in (HOME, BOTH):
        half = len(word) // 2
        keys += [f"=<{word[:half]}", f"=>{word[half:]}"]
    if state in (HOME, LONGER):
        half = (len(word) - (state == HOME)) // 2
        keys += [f"+<{word[:half]}", f"+>{word[half + (state == HOME) :]}"]
    return keys


def _searches(words: DataFrame, level: int, upto: int) -> DataFrame:
    """``word, n, state, cell`` at level ``upto``, of rows at ``level`` (before the first: words alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            states, cells = (batch.column(c).to_pylist() if level else [None] * batch.num_rows for c in ("state", "cell"))
            for word, n, state, cell in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), states, cells):
                vector = counts(word)
                at = [(state, cell)] if level else [(HOME, f"{len(word)}:"), (LONG, f"{len(word) + 1}:")]
                for step in range(level, upto):
                    at = [place for state, cell in at for place in _deeper(word, vector, state, cell, step)]
                out.extend((word, n, state, cell) for state, cell in at)
            kinds = pa.string(), pa.int64(), pa.int32(), pa.string()
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "n", "state", "cell"])

    return words.mapInArrow(run, "word string, n long, state int, cell string")


class _Cell:
    """The trie below one cell."""

    def __init__(self, cell: str) -> None:
        path, _, self.half = cell.partition("|")
        self.level = path.count(",")
        self.root: dict = {}
        self.leaves: dict[tuple[int, ...], list[tuple[str, int]]] = {}
        self.crowded: dict[int, dict[str, list]] = {}

    def add(self, word: str, n: int, vector: list[int]) -> None:
        rest = tuple(vector[self.level :])
        leaf = self.leaves.get(rest)
        if leaf is None:
            leaf = self.leaves[rest] = []
            node = self.root
            for count in rest[:-1]:
                node = node.setdefault(count, {})
            if rest:
                node[rest[-1]] = leaf
        leaf.append((word, n))

    def near(self, word: str, vector: list[int], state: int) -> Iterator[tuple[str, int]]:
        """Words one edit away."""
        if state == HOME and self.half.startswith("+"):
            return
        for at, leaf in self._reached(vector[self.level :], state):
            for other, n in leaf if len(leaf) <= MOST_LEAF else self._alike(leaf, word, at):
                if (at != HOME or word < other) and one_edit(word, other) and not self._twice(word, other):
                    yield other, n

    def _reached(self, rest: list[int], state: int) -> Iterator[tuple[int, list]]:
        """Leaves within the budget, depth first. Once it is spent, the leaf is known."""
        nodes = [(self.root, 0, state, rest)]
        while nodes:
            node, level, state, rest = nodes.pop()
            if state == BOTH or state == LONGER or level == len(rest):
                leaf = self.leaves.get(tuple(rest))
                if leaf is not None:
                    yield state, leaf
                continue
            for change, follows in STEPS[state]:
                below = node.get(rest[level] + change)
                if below is not None:
                    way = rest
                    if change:
                        way = rest.copy()
                        way[level] += change
                    nodes.append((below, level + 1, follows, way))

    def _alike(self, leaf: list, word: str, state: int) -> set[tuple[str, int]]:
        """Words of a crowded leaf that share a half with ``word``."""
        index = self.crowded.get(id(leaf))
        if index is None:
            index = self.crowded[id(leaf)] = {}
            for other, n in leaf:
                for key in _halves(other, HOME):
                    index.setdefault(key, []).append((other, n))
        keys = _halves(word, state)
        return {entry for key in keys[:2] for entry in index.get(key, ())}

    def _twice(self, word: str, other: str) -> bool:
        """Whether a cell of second halves holds a pair that the cell of first halves has too."""
        half = len(word) // 2
        return self.half.startswith("+>") and word[:half] == other[:half]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n, other, other_n`` of near words, from rows that come cell by cell, words at home first."""
    names, kinds = ["word", "n", "other", "other_n"], (pa.string(), pa.int64(), pa.string(), pa.int64())
    cell: _Cell | None = None
    name, home = None, []

    def among_home() -> Iterator[tuple]:
        for word, n, vector in home:
            for other, count in cell.near(word, vector, HOME):
                yield word, n, other, count

    for batch in batches:
        out: list[tuple] = []
        for word, n, state, at in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "state", "cell"))):
            if at != name:
                out.extend(among_home())
                cell, name, home = _Cell(at), at, []
            vector = counts(word)
            if state == HOME:
                cell.add(word, n, vector)
                home.append((word, n, vector))
            else:
                out.extend((word, n, other, count) for other, count in cell.near(word, vector, state))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
    out = list(among_home())
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: every pair of words that are one edit apart, once."""
    rows, level, ready = _searches(words, 0, FIRST_LEVELS), FIRST_LEVELS, []
    while True:
        rows = written(rows, "spelling-searches")
        at_home = F.count(F.when(F.col("state") == HOME, True)).alias("home")
        cells = rows.groupBy("cell").agg(at_home, F.count("*").alias("load")).filter("home > 0 and load > 1")
        dealt = written(rows.join(cells.drop("home"), "cell").select("word", "n", "state", "cell", "load"), "spelling-cells")
        discard(rows)
        last = level > DEPTH
        ready.append(dealt if last else dealt.filter(F.col("load") <= MOST_ROWS))
        large = dealt.filter(F.col("load") > MOST_ROWS)
        if last or large.isEmpty():
            break
        rows, level = _searches(large.drop("load"), level, level + 1), level + 1
    found = ready[0]
    for more in ready[1:]:
        found = found.unionByName(more)
    dealt = found.drop("load").repartition(partitions_for(words.sparkSession), "cell").sortWithinPartitions("cell", "state")
    return dealt.mapInArrow(_pairs, "word string, n long, other string, other_n long")


def _roots(links: DataFrame) -> DataFrame:
    """``word, root`` of ``word, root`` steps that lead from variants to forms: the last of each chain."""
    for _ in range(DOUBLINGS):
        links = written(links, "spelling-roots")
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if links.join(ahead, "root", "left_semi").isEmpty():
            break
        links = links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return links


def grouped(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word.

    The form is the near word that occurs most, if it occurs ``TIMES`` as often as the
    word at least; the root is the last of the forms that follow from it.
    """
    words = written(counted(documents, key, text), "spelling-words")
    pairs = near_words(words)
    ways = F.array(
        F.struct("word", "other", F.col("other_n").alias("size")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("size")),
    )
    best = F.min(F.struct((-F.col("size")).alias("size"), "other")).alias("best")
    found = pairs.select(F.explode(ways).alias("p")).select("p.*").groupBy("word")
    joined = words.join(found.agg(F.count("*").alias("n_near"), best), "word", "left")
    fits = -F.col("best.size") >= TIMES * F.col("n")
    forms = written(
        joined.select(
            "word",
            F.when(fits, F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(fits, -F.col("best.size")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(forms.filter("form is not null").select("word", F.col("form").alias("root")))
    every = forms.join(roots, "word", "left")
    return every.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
