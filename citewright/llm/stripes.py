"""How the sources of one language differ in their words: an audit by in-mapper stripes.

A task folds whole documents into stripes, one per language and term: in how many
documents the term occurs, and how often in each source. A full table of stripes is
spilled as rows and begun anew; rows of the same stripe are added up by key. The merged
stripes of a language are dealt into shares that fit a task, each beside the list of the
language's sources, and a share gives at once its part of every divergence and its best
terms per source.

All numbers are whole, as in ``audited``: ``p`` of a term is 1 + floor(10^9 (count + 2) /
(N + 2 V)), with ``N`` the count of all kept terms and ``V`` their number; a term adds
floor((p - q)^2 / (p + q)) to the divergence of ``p`` from ``q``.

* A null text, language or source is the empty string, a group like any other. An empty
  text has no terms; its group still occurs. A very long text is counted whole.
* Equal values are ranked by item, in the order of their UTF-8 bytes. Repeated rows count
  as often as they occur. An empty table gives no rows.
* Only the three named columns are read; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewright.llm.shared import slices, written

# A term of a language is kept from so many of its documents on.
LEAST_DOCUMENTS = 10
# Terms are ranked so far, per source.
TOP = 10
UNIT = 10**9
# A task spills its stripes at so many entries (some 80 MB) or documents, and a share of merged ones has so many cells.
MOST_ENTRIES = 500_000
MOST_DOCUMENTS = 1 << 20
MOST_CELLS = 1 << 19
# How a count of a task is packed: occurrences, documents, and the number of the source.
DOCUMENT_BITS, SOURCE_BITS = 40, 63
ONE_DOCUMENT, COUNT = 1 << DOCUMENT_BITS, (1 << SOURCE_BITS) - 1
# Counts up to here times UNIT fit 64 bits.
SAFE_COUNT = 9 * 10**9
# Letters are A-Z, made lower case, a-z and every byte of a longer character; all else parts terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(text: str | None) -> Counter[bytes]:
    return Counter((text or "").encode().translate(LETTERS).split())


def stripes(documents: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, term, docs, sources``: in how many documents of the language a term
    occurs, and ``source, n`` of every source that has it."""
    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table()
        for batch in slices(batches, "text"):
            columns = (batch.column(name).to_pylist() for name in ("lang", "source", "text"))
            for of_lang, of_source, value in zip(*columns):
                table.add(of_lang, of_source, _terms(value))
                if table.entries >= MOST_ENTRIES or table.documents >= MOST_DOCUMENTS:
                    yield from table.spilled()
                    table = _Table()
        yield from table.spilled()

    spilled = documents.select(*named).mapInArrow(fold, "lang string, term string, source string, n long, docs long")
    added = spilled.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return added.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources")
    )


class _Table:
    """Stripes of some documents: by language, then by term, the counts of each source.

    A count is one number, occurrences plus ``ONE_DOCUMENT`` for each document. Most
    terms have one source only; their stripe is that source and count, as one number too.
    """

    def __init__(self) -> None:
        self.stripes: dict[str, dict[bytes, int | dict[int, int]]] = {}
        self.sources: dict[str, int] = {}
        self.entries = self.documents = 0

    def add(self, lang: str, source: str, terms: Counter[bytes]) -> None:
        stripes_of = self.stripes.setdefault(lang, {})
        number = self.sources.setdefault(source, len(self.sources))
        alone, known = number << SOURCE_BITS, stripes_of.get
        before = len(stripes_of)
        for term, n in terms.items():
            n += ONE_DOCUMENT
            stripe = known(term)
            if stripe is None:
                stripes_of[term] = alone + n
            elif type(stripe) is dict:
                if number in stripe:
                    stripe[number] += n
                else:
                    stripe[number] = n
                    self.entries += 1
            elif stripe >> SOURCE_BITS == number:
                stripes_of[term] = stripe + n
            else:
                stripes_of[term] = {stripe >> SOURCE_BITS: stripe & COUNT, number: n}
                self.entries += 1
        self.entries += len(stripes_of) - before
        self.documents += 1

    def spilled(self, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
        """A row for each term and source."""
        names = pa.array(list(self.sources), pa.string())
        for lang, stripes_of in self.stripes.items():
            terms, sources, counts = [], [], []
            for term, stripe in stripes_of.items():
                if type(stripe) is dict:
                    terms.extend([term] * len(stripe))
                    sources.extend(stripe)
                    counts.extend(stripe.values())
                else:
                    terms.append(term)
                    sources.append(stripe >> SOURCE_BITS)
                    counts.append(stripe & COUNT)
            for at in range(0, len(terms), rows):
                numbers = np.array(counts[at : at + rows], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang], pa.string()).take(pa.array(np.zeros(len(numbers), np.int32))),
                        pa.array(terms[at : at + rows], pa.binary()).cast(pa.string()),
                        names.take(pa.array(sources[at : at + rows], pa.int32())),
                        pa.array(numbers & (ONE_DOCUMENT - 1)),
                        pa.array(numbers >> DOCUMENT_BITS),
                    ],
                    names=["lang", "term", "source", "n", "docs"],
                )


def _rates(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``p`` of each count, exactly."""
    if counts.size and counts.max() >= SAFE_COUNT:
        return (1 + (counts.astype(object) + 2) * UNIT // (total + 2 * terms)).astype(np.int64)
    return 1 + (counts + 2) * UNIT // (total + 2 * terms)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _share(stripes_of: pa.Table, groups: pa.Table) -> pa.Table:
    """One share's part of all divergences between the sources of a language, and its best terms."""
    lang = groups.column("lang")[0].as_py()
    listed = sorted(zip(groups.column("source").to_pylist(), groups.column("total").to_pylist()))
    names, totals = [name for name, _ in listed], [total for _, total in listed]
    terms, whole = groups.column("terms")[0].as_py(), groups.column("all")[0].as_py()
    spelled = stripes_of.column("term").combine_chunks()
    order = pc.sort_indices(spelled.cast(pa.binary()))
    spelled = spelled.take(order).to_pylist()
    lists = stripes_of.column("sources").combine_chunks().take(order)
    entries = lists.flatten()
    rows = pc.index_in(entries.field("source"), value_set=pa.array(names, pa.string())).to_numpy(zero_copy_only=False)
    columns = np.repeat(np.arange(len(spelled)), lists.value_lengths().to_numpy(zero_copy_only=False))
    counts = np.zeros((len(names), len(spelled)), np.int64)
    counts[rows.astype(np.int64), columns] = entries.field("n").to_numpy(zero_copy_only=False)
    out: list[tuple] = []
    if spelled:
        rates = np.stack([_rates(counts[i], totals[i], terms) for i in range(len(names))])
        of_lang = _rates(counts.sum(axis=0), whole, terms)
    for i, name in enumerate(names):
        if not spelled:
            out.extend((lang, name, "pair", other, 0) for other in names[i + 1 :])
            continue
        for first in range(i + 1, len(names), 64):
            sums = _gaps(rates[i], rates[first : first + 64]).sum(axis=1).tolist()
            out.extend((lang, name, "pair", other, value) for other, value in zip(names[first:], sums))
        chosen = np.flatnonzero((counts[i] > 0) & (rates[i] > of_lang))
        values = _gaps(rates[i][chosen], of_lang[chosen])
        best = np.argsort(-values, kind="stable")[:TOP]
        out.extend((lang, name, "term", spelled[chosen[b]], int(values[b])) for b in best)
    columns = zip(*out) if out else [[]] * 5
    kinds = [pa.string()] * 4 + [pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "part", "item", "value"])


def audited(documents: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: the divergence of a source from each other one of its language. Part
    ``term``: the terms that a source has more of than its language, by what they add
    to the divergence from it, the first ten.
    """
    merged = stripes(documents, lang, source, text).filter(F.col("docs") >= LEAST_DOCUMENTS)
    kept = written(merged, "stripes")
    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]
    groups = documents.select(*named).distinct()
    counted = kept.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source"))
    totals = counted.agg(F.sum("s.n").alias("total"))
    groups = written(groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]), "stripe-groups")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("width"), F.sum("total").alias("all"))
    sizes = sizes.join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left").fillna(0, ["terms"])
    shares = F.ceil(F.col("width") * F.col("terms") / F.lit(float(MOST_CELLS)))
    sizes = written(sizes.withColumn("shares", F.greatest(shares, F.lit(1)).cast("int")), "stripe-sizes")
    dealt = kept.join(sizes.select("lang", "shares"), "lang").select(
        "lang", F.expr("cast(pmod(xxhash64(term), shares) as int)").alias("share"), "term", "sources"
    )
    beside = groups.join(sizes, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "source", "total", "terms", "all"
    )
    found = (
        dealt.groupBy("lang", "share")
        .cogroup(beside.groupBy("lang", "share"))
        .applyInArrow(_share, "lang string, source string, part string, item string, value long")
    )
    found = written(found, "stripe-shares")
    sums = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", "part", "value", both.alias("s")).select("lang", "s.source", "part", "s.item", "value")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = pairs.withColumn("rank", F.row_number().over(by_value))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= TOP)
    return ranked.unionByName(terms)
