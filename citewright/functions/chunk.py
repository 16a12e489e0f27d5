"""Cutting sections into overlapping windows that end at sentence boundaries.

Where a window starts depends on where the one before it ended, so this is the
one text step that no built-in expression covers. It runs over Arrow batches: Spark
ships texts with their section offsets and gets back a row per window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The same white space set as in ``strings``.
_WS_CHARS = (
    "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
)
_NOT_WS = re.compile(f"[^{_WS_CHARS}]")
_LAST_WS = re.compile(f"[{_WS_CHARS}](?=[^{_WS_CHARS}]*\\Z)")

@dataclass(frozen=True)
class ChunkOptions:
    """Window sizes in characters. Defaults are fixed values."""

    max_chars: int = 1200
    min_chars: int = 400
    overlap_chars: int = 150

    def __post_init__(self) -> None:
        if not 0 <= self.overlap_chars < self.min_chars:
            raise ValueError(
                f"overlap_chars ({self.overlap_chars}) must be >= 0 and < min_chars ({self.min_chars})"
            )
        if self.min_chars > self.max_chars:
            raise ValueError(
                f"min_chars ({self.min_chars}) must be <= max_chars ({self.max_chars})"
            )


def _next_ink(text: str, start: int, end: int) -> int:
    """The first position in ``[start, end)`` that is not white space, or ``end``."""
    found = _NOT_WS.search(text, start, end)
    return found.start() if found else end


def _boundary(text: str, low: int, high: int) -> int:
    """Just after the last sentence mark in ``[low, high)``, else the last space, else ``high``."""
    last = max(text.rfind(mark, low, high) for mark in ".!?")
    if last < 0:
        space = _LAST_WS.search(text[low:high])
        if space is None:
            return high
        last = low + space.start()
    return last + 1


def windows(text: str, start: int, end: int, options: ChunkOptions) -> Iterator[tuple[int, int]]:
    """Offsets of the windows of one section ``text[start:end]``."""
    pos = _next_ink(text, start, end)
    while pos < end:
        stop = pos + options.max_chars
        if stop >= end:
            yield pos, end
            return
        stop = _boundary(text, pos + options.min_chars, stop)
        yield pos, stop
        pos = _next_ink(text, max(pos + 1, stop - options.overlap_chars), end)


def chunk_rows(sectioned: DataFrame, keep: list[str], options: ChunkOptions | None = None) -> DataFrame:
    """One row per window: ``keep``, ``section``, ``start``, ``end`` and ``text``.

    ``sectioned`` has ``canonical_text`` and ``sections``; ``section`` is the
    section's struct. Whole documents go in, one Arrow batch at a time, so no
    task ever holds more than its batch.
    """
    opts = options or ChunkOptions()
    source = sectioned.select(*keep, "canonical_text", "sections")
    section_type = sectioned.schema["sections"].dataType.elementType
    schema = T.StructType(
        [
            *[sectioned.schema[name] for name in keep],
            T.StructField("section", section_type),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("text", T.StringType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sections = batch.column("sections")
            offsets = sections.offsets.to_pylist()
            bounds = sections.values
            section_starts = bounds.field("start").to_pylist()
            section_ends = bounds.field("end").to_pylist()
            rows, picked, starts, ends, texts = [], [], [], [], []
            for row, text in enumerate(batch.column("canonical_text")):
                body = text.as_py()
                for i in range(offsets[row], offsets[row + 1]):
                    for a, b in windows(body, section_starts[i], section_ends[i], opts):
                        rows.append(row)
                        picked.append(i)
                        starts.append(a)
                        ends.append(b)
                        texts.append(body[a:b])
            at = pa.array(rows, pa.int32())
            columns = [batch.column(name).take(at) for name in keep]
            columns += [
                bounds.take(pa.array(picked, pa.int32())),
                pa.array(starts, pa.int32()),
                pa.array(ends, pa.int32()),
                pa.array(texts, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return source.mapInArrow(cut, schema)
