"""A span of text with its surroundings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citewright.functions.strings import let, slice0

# Fixed value: how many characters to show on each side.
CONTEXT_CHARS = 160


def highlight_span(text: Column, start: Column, end: Column, context: int = CONTEXT_CHARS) -> Column:
    """``struct<before,match,after,truncated_before,truncated_after>``.

    Offsets are clamped to the text, so a stale span never fails.
    """
    size = F.length(text)
    lo = F.greatest(F.lit(0), F.least(start, size))
    bounds = F.struct(
        text.alias("text"), size.alias("size"), lo.alias("lo"),
        F.greatest(lo, F.least(end, size)).alias("hi"),
    )

    def cut(s: Column) -> Column:
        first = F.greatest(F.lit(0), s["lo"] - F.lit(context))
        last = F.least(s["size"], s["hi"] + F.lit(context))
        return F.struct(
            slice0(s["text"], first, s["lo"]).alias("before"),
            slice0(s["text"], s["lo"], s["hi"]).alias("match"),
            slice0(s["text"], s["hi"], last).alias("after"),
            (first > 0).alias("truncated_before"),
            (last < s["size"]).alias("truncated_after"),
        )

    return let(bounds, cut)
