"""HTML to canonical plain text, as one Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citewright.functions.strings import INLINE_NO_CR, WORD_END, WS, let, trim_ws

# Elements whose tags become line breaks.
BLOCK_TAGS = "p div br tr li h1 h2 h3 h4 h5 h6 table section article".split()

# The named entities that are decoded; any other stays as written.
NAMED_ENTITIES = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": " ",
    "rsquo": "’",
    "lsquo": "‘",
    "rdquo": "”",
    "ldquo": "“",
    "mdash": "—",
    "ndash": "–",
    "hellip": "…",
}

COMMENT = "(?s)<!--.*?-->"
DROPPED_ELEMENT = f"(?is)<(script|style|head){WORD_END}[^>]*>.*?</\\1>"
BLOCK_TAG = f"(?i)</?(?:{'|'.join(BLOCK_TAGS)}){WORD_END}[^>]*>"
ANY_TAG = "<[^>]+>"
ENTITY = "&(#x?[0-9a-fA-F]+|[a-zA-Z]+);"

MAX_CODE_POINT = 0x10FFFF


def _code_point_char(code: Column) -> Column:
    """The character of a code point; lone surrogates become U+FFFD."""
    safe = F.when(code.between(0xD800, 0xDFFF), F.lit(0xFFFD)).otherwise(code)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def _decode_entity(body: Column) -> Column:
    """Decode what stands between ``&`` and ``;``, or give the entity back whole."""
    hex_digits = F.regexp_extract(body, "^#x0*([0-9a-fA-F]{1,6})$", 1)
    dec_digits = F.regexp_extract(body, "^#0*([0-9]{1,7})(?![0-9])", 1)
    code = F.when(hex_digits != "", F.conv(hex_digits, 16, 10).cast("long")).when(
        dec_digits != "", dec_digits.cast("long")
    )
    named = F.create_map(*[F.lit(x) for pair in NAMED_ENTITIES.items() for x in pair])
    return (
        F.when(code <= MAX_CODE_POINT, _code_point_char(code))
        .when(
            ~body.startswith("#"),
            F.coalesce(F.try_element_at(named, F.lower(body)), F.concat(F.lit("&"), body, F.lit(";"))),
        )
        .otherwise(F.concat(F.lit("&"), body, F.lit(";")))
    )


def decode_entities(text: Column) -> Column:
    """Decode character references in a single pass."""
    pieces = F.zip_with(
        F.split(text, ENTITY, -1),
        F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1)),
        lambda gap, body: F.when(body.isNull(), gap).otherwise(
            F.concat(gap, let(body, _decode_entity))
        ),
    )
    return F.array_join(pieces, "")


def normalise_lines(text: Column) -> Column:
    """Collapse inline white space, trim lines and drop blank ones."""
    inline = F.regexp_replace(text, f"{INLINE_NO_CR}+", " ")
    return trim_ws(F.regexp_replace(inline, f" ?[\\r\\n]{WS}*+", "\n"))


def strip_markup(html: Column) -> Column:
    """Remove comments, scripts and tags, keeping block boundaries as line feeds."""
    text = F.regexp_replace(html, COMMENT, " ")
    text = F.regexp_replace(text, DROPPED_ELEMENT, " ")
    text = F.regexp_replace(text, BLOCK_TAG, "\n")
    return F.regexp_replace(text, ANY_TAG, " ")


def extract_text(html: Column) -> Column:
    """Canonical text of an HTML document. Entities are decoded after the tags go."""
    decoded = let(
        strip_markup(html),
        lambda text: F.when(text.contains("&"), decode_entities(text)).otherwise(text),
    )
    return normalise_lines(decoded)
