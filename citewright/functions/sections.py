"""Section detection in filing text: Part and Item headings, last one wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citewright.functions.strings import WORD_END, WORD_START, WS, collapse_ws, let, match_spans

# A Part marker, and an Item heading with its title up to the line end.
# The look-ahead for the first letter changes no match: it spares the costlier look
# behind for a word start at every other place.
PART = f"(?i)(?=P){WORD_START}PART{WS}+(IV|I{{1,3}}){WORD_END}"
ITEM = f"(?i)(?=I){WORD_START}Item{WS}+([0-9]{{1,2}}[A-Z]?)\\.{WS}+([A-Za-z][^\\n]{{2,90}})"


def detect_sections(text: Column) -> Column:
    """``array<struct<id,label,part,item,title,start,end>>`` in document order.

    Each heading belongs to the part named last before it. A heading without a
    part is dropped when its item also occurs with one (a table of contents), and
    of equal headings the last stays. The sections tile the text from the first
    kept heading to the end; a text without headings has none.
    """
    def matches(raw: Column) -> Column:
        return F.struct(
            match_spans(raw, PART).alias("parts"),
            match_spans(raw, ITEM).alias("items"),
            F.length(raw).alias("size"),
        )

    def build(s: Column) -> Column:
        parts = F.transform(
            s["parts"],
            lambda m: F.struct(
                m["start"].alias("start"),
                F.upper(F.regexp_extract(m["text"], PART, 1)).alias("part"),
            ),
        )
        hits = let(
            parts,
            lambda marks: F.transform(
                s["items"],
                lambda m: F.struct(
                    F.try_element_at(
                        F.filter(marks, lambda p: p["start"] <= m["start"]), F.lit(-1)
                    )["part"].alias("part"),
                    F.upper(F.regexp_extract(m["text"], ITEM, 1)).alias("item"),
                    collapse_ws(F.regexp_extract(m["text"], ITEM, 2)).alias("title"),
                    m["start"].alias("start"),
                ),
            ),
        )
        kept = let(
            hits,
            lambda all_hits: F.filter(
                all_hits,
                lambda h: ~F.exists(
                    all_hits,
                    lambda o: (o["item"] == h["item"])
                    & (
                        (h["part"].isNull() & o["part"].isNotNull())
                        | (o["part"].eqNullSafe(h["part"]) & (o["start"] > h["start"]))
                    ),
                ),
            ),
        )

        def section(h: Column, end: Column) -> Column:
            part, item = h["part"], h["item"]
            prefix = F.coalesce(F.concat(F.lit("part-"), F.lower(part), F.lit("-")), F.lit(""))
            heading = F.coalesce(F.concat(F.lit("Part "), part, F.lit(", ")), F.lit(""))
            return F.struct(
                F.concat(prefix, F.lit("item-"), F.lower(item)).alias("id"),
                F.concat(heading, F.lit("Item "), item, F.lit(": "), h["title"]).alias("label"),
                part.alias("part"),
                item.alias("item"),
                h["title"].alias("title"),
                h["start"].alias("start"),
                end.alias("end"),
            )

        return let(
            kept,
            lambda heads: F.transform(
                heads,
                lambda h, i: section(h, F.coalesce(F.get(heads, i + 1)["start"], s["size"])),
            ),
        )

    return let(text, lambda raw: let(matches(raw), build))
