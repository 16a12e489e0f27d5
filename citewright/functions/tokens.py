"""Tokens for embedding, for keyword queries and for the keyword index."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# 32-bit FNV-1a.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
MASK_32 = 4294967295


def tokenize(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def fnv1a(token: Column) -> Column:
    """32-bit FNV-1a of an ASCII token, as an unsigned number in a BIGINT."""
    return F.aggregate(
        F.split(token, ""),
        F.lit(FNV_OFFSET).cast("long"),
        lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(
            F.lit(MASK_32).cast("long")
        ),
    )


def query_terms(query: Column) -> Column:
    """The terms a keyword query asks for: tokens of two characters or more.

    Repeated terms stay, and nothing is left out as too common.
    """
    return F.filter(tokenize(query), lambda t: F.length(t) > 1)


def match_expression(query: Column) -> Column:
    """The same terms as a quoted OR expression; empty when there are none."""
    return F.array_join(
        F.transform(query_terms(query), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR "
    )


@lru_cache(maxsize=1)
def accent_map() -> tuple[str, str]:
    """Characters to fold and what they fold to, for ``translate``.

    Covers the lower-case Latin letters of the Latin-1 to Latin Extended
    Additional blocks whose canonical decomposition is a base letter with marks.
    The combining marks themselves come last and have no counterpart, so they go.
    """
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if char.islower() and len(parts) > 1 and not unicodedata.combining(parts[0]):
            source.append(char)
            target.append(parts[0])
    marks = [chr(code) for code in range(0x0300, 0x0370)]
    return "".join(source + marks), "".join(target)


def fold_accents(text: Column) -> Column:
    source, target = accent_map()
    folded = F.translate(text, source, target)
    return F.when(text.rlike("[^\\x00-\\x7F]"), folded).otherwise(text)


def index_terms(text: Column) -> Column:
    """Terms a chunk is indexed under: folded runs of letters and numbers."""
    return F.regexp_extract_all(
        fold_accents(F.lower(text)), F.lit("[\\p{L}\\p{N}\\p{Co}]+"), F.lit(0)
    )
