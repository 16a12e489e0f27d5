"""Finding and redacting personal data, row by row and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citewright.functions.strings import (
    INLINE_SPACE,
    SPAN,
    WORD_END,
    WORD_START,
    WS,
    let,
    match_spans,
    slice0,
)

_LOCAL = "[A-Za-z0-9._%+-]"
_GAP = f"[-.{INLINE_SPACE}\\n]"

# What each kind of personal data looks like, most important first.
# An earlier kind wins where two overlap. The e-mail pattern starts only where a
# run of name characters starts or the last match ended, and the others look ahead
# for a digit before they look back: neither changes what matches, both keep the
# scan linear and quick.
PII_PATTERNS = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}",
    "ssn": f"(?=[0-9]){WORD_START}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{WORD_END}",
    "phone": (
        f"(?=[+(0-9])(?:\\+?1{_GAP}?)?(?:\\([0-9]{{3}}\\){WS}?|[0-9]{{3}}{_GAP})[0-9]{{3}}{_GAP}[0-9]{{4}}{WORD_END}"
    ),
    "account-number": (
        f"(?i)(?=[0-9]{{9}})(?<={WORD_START}(?:account|acct|a/c|routing|iban){WORD_END}[^0-9]{{0,12}})"
        f"[0-9]{{9,17}}{WORD_END}"
    ),
}

PII_TYPES = list(PII_PATTERNS)

PII_SPAN = "struct<type:string,start:int,end:int>"


def placeholder(pii_type: Column) -> Column:
    return F.concat(F.lit("[REDACTED:"), pii_type, F.lit("]"))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _typed(pii_type: str, spans: Column) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            F.lit(pii_type).alias("type"), s["start"].alias("start"), s["end"].alias("end")
        ),
    )


def detect_pii(text: Column) -> Column:
    """``array<struct<type,start,end>>`` by position in ``text``.

    Matches of one kind never overlap each other, so keeping the best kind first
    means: each kind in turn keeps the matches that no earlier kind has covered.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def found(s: Column) -> Column:
        likely = [s["text"].contains("@")] + [s["digits"]] * (len(PII_TYPES) - 1)
        return F.struct(
            *[
                F.when(likely[i], match_spans(s["text"], pattern)).otherwise(none).alias(f"k{i}")
                for i, pattern in enumerate(PII_PATTERNS.values())
            ]
        )

    def resolve(spans: Column) -> Column:
        kept = _typed(PII_TYPES[0], spans["k0"])
        for i, pii_type in enumerate(PII_TYPES[1:], start=1):
            kept = let(
                F.struct(kept.alias("kept"), _typed(pii_type, spans[f"k{i}"]).alias("new")),
                lambda s: F.when(F.size(s["new"]) == 0, s["kept"])
                .when(F.size(s["kept"]) == 0, s["new"])
                .otherwise(
                    F.concat(
                        s["kept"],
                        F.filter(
                            s["new"],
                            lambda n: ~F.exists(s["kept"], lambda k: _overlaps(n, k)),
                        ),
                    )
                ),
            )
        return F.array_sort(
            kept,
            lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0),
        )

    facts = F.struct(text.alias("text"), text.rlike("[0-9]{3}").alias("digits"))
    nothing = F.array().cast(f"array<{PII_SPAN}>")
    return let(
        facts,
        lambda s: F.when(s["digits"] | s["text"].contains("@"), let(found(s), resolve)).otherwise(
            nothing
        ),
    )


def redact_pii(text: Column) -> Column:
    """``struct<text, hits>``: the redacted text and where its placeholders stand.

    A hit carries the kind and the offsets in the redacted text, never the value.
    """

    def rebuild(s: Column) -> Column:
        raw, spans = s["raw"], s["spans"]
        pieces = F.transform(
            spans,
            lambda k, i: F.concat(
                slice0(raw, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), k["start"]),
                placeholder(k["type"]),
            ),
        )
        last = F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0))
        tail = slice0(raw, last, F.length(raw))
        zero = F.struct(
            F.lit(0).alias("shift"), F.array().cast(f"array<{PII_SPAN}>").alias("out")
        )

        def step(acc: Column, k: Column) -> Column:
            start = k["start"] + acc["shift"]
            end = start + F.length(placeholder(k["type"]))
            hit = F.struct(k["type"].alias("type"), start.alias("start"), end.alias("end"))
            return F.struct(
                (end - k["end"]).alias("shift"), F.concat(acc["out"], F.array(hit)).alias("out")
            )

        hits = F.aggregate(spans, zero, step, lambda acc: acc["out"])
        return F.when(
            F.size(spans) == 0,
            F.struct(raw.alias("text"), F.array().cast(f"array<{PII_SPAN}>").alias("hits")),
        ).otherwise(
            F.struct(F.concat(F.array_join(pieces, ""), tail).alias("text"), hits.alias("hits"))
        )

    return let(
        text,
        lambda raw: let(F.struct(raw.alias("raw"), detect_pii(raw).alias("spans")), rebuild),
    )
