"""String rules shared by every text operator.

All offsets are 0-based, half-open and counted in code points. White space and
word boundaries are spelled out as character classes because the JVM's own
``\\s``, ``\\b`` and ``trim`` disagree with the rules the operators need: white
space includes the no-break space and U+FEFF, and a word character is ASCII only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space set, without the line feed and with it.
INLINE_SPACE = (
    "\\t\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
)
WS = f"[{INLINE_SPACE}\\n]"
# Inline white space where a carriage return already counts as a line break.
INLINE_NO_CR = f"[{INLINE_SPACE.replace(chr(92) + 'r', '')}]"

WORD_START = "(?<![A-Za-z0-9_])"
WORD_END = "(?![A-Za-z0-9_])"

# The look-ahead rules out most positions before the dearer look-behind is tried.
_EDGE_SPACE = f"^{WS}++|(?={WS})(?<!{WS}){WS}++\\z"


def trim_ws(text: Column) -> Column:
    """Strip the full white space set from both ends."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def collapse_ws(text: Column) -> Column:
    """Turn each run of white space into one space and strip the ends."""
    return trim_ws(F.regexp_replace(text, f"{WS}+", " "))


def slice0(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` with 0-based half-open offsets."""
    return F.substring(text, start + F.lit(1), end - start)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times inside ``body``.

    A plain column expression that is used within a higher-order function is
    evaluated again for each element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


SPAN = "struct<start:int,end:int,text:string>"


def match_spans(text: Column, pattern: str) -> Column:
    """All non-overlapping matches of ``pattern`` with their offsets.

    Spark has no function for match positions, but splitting on a pattern and
    extracting it yield alternating gaps and matches whose running lengths are
    the offsets. Texts without a match skip both.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(
        gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit"))
    )
    empty = F.array().cast(f"array<{SPAN}>")
    zero = F.struct(F.lit(0).alias("pos"), empty.alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        start = acc["pos"] + piece["gap"]
        end = start + F.length(piece["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), piece["hit"].alias("text"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    spans = F.aggregate(
        F.filter(pieces, lambda piece: piece["hit"].isNotNull()), zero, step, lambda acc: acc["out"]
    )
    return F.when(text.rlike(pattern), spans).otherwise(empty)
