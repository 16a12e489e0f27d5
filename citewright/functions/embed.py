"""Embedders: text in, one float vector of fixed size out, in order."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewright.functions.tokens import FNV_OFFSET, FNV_PRIME, fnv1a


class Embedder(Protocol):
    """Anything that turns texts into vectors; it is shipped to the tasks."""

    id: str
    dimensions: int
    remote: bool

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


_IS_TOKEN = np.zeros(256, dtype=bool)
_IS_TOKEN[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = True


def _token_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The text number and the FNV-1a hash of each token, over a whole batch at once."""
    encoded = [text.lower().encode() for text in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)
    inside = np.concatenate(([False], _IS_TOKEN[data]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    order = np.argsort(starts - ends, kind="stable")
    starts, lengths = starts[order], (ends - starts)[order]
    hashes = np.full(len(starts), FNV_OFFSET, dtype=np.uint32)
    prime = np.uint32(FNV_PRIME)
    for i in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -i, side="left"))
        hashes[:live] = (hashes[:live] ^ data[starts[:live] + i]) * prime
    text_ends = np.cumsum([len(e) + 1 for e in encoded])
    return np.searchsorted(text_ends, starts, side="right"), hashes


@dataclass(frozen=True)
class HashEmbedder:
    """Counts tokens by hash bucket and scales to unit length. Needs no network."""

    dimensions: int = 256
    remote: bool = False

    @property
    def id(self) -> str:
        return f"fake-hash-v1:{self.dimensions}"

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        if not len(texts):
            return np.zeros((0, self.dimensions))
        rows, hashes = _token_hashes(texts)
        cells = rows * self.dimensions + hashes % np.uint32(self.dimensions)
        counts = np.bincount(cells, minlength=len(texts) * self.dimensions)
        vectors = counts.reshape(len(texts), self.dimensions).astype(np.float64)
        norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        return np.divide(vectors, norms, out=vectors, where=norms > 0)


# Vector sizes of the hosted models; any other has the default.
REMOTE_DIMENSIONS = {"voyage-3": 1024, "voyage-3-large": 1024, "voyage-3-lite": 512}
DEFAULT_REMOTE_DIMENSIONS = 1024


@dataclass(frozen=True)
class RemoteEmbedder:
    """A hosted embedding endpoint. ``post`` sends a JSON body and returns the reply.

    One request per Arrow batch; replies are put back into request order.
    """

    post: Callable[[str], str]
    model: str = "voyage-3"
    size: int | None = None
    input_type: str = "document"
    remote: bool = True

    @property
    def dimensions(self) -> int:
        return self.size or REMOTE_DIMENSIONS.get(self.model, DEFAULT_REMOTE_DIMENSIONS)

    @property
    def id(self) -> str:
        return f"voyage:{self.model}:{self.dimensions}"

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        if not len(texts):
            return np.zeros((0, self.dimensions))
        body = {"input": list(texts), "model": self.model, "input_type": self.input_type}
        data = json.loads(self.post(json.dumps(body)))["data"]
        ordered = sorted(data, key=lambda item: item["index"])
        return np.asarray([item["embedding"] for item in ordered], dtype=np.float64)


def embed_column(text: Column, embedder: Embedder) -> Column:
    """``array<float>`` of ``text``; raises if the embedder's size is not the one it states."""
    dims = embedder.dimensions

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pa.Array) -> pa.Array:
        vectors = np.asarray(embedder.embed(texts.to_pylist()), dtype=np.float32)
        if vectors.shape != (len(texts), dims):
            raise ValueError(f"expected {len(texts)} vectors of size {dims}, got {vectors.shape}")
        offsets = np.arange(0, (len(texts) + 1) * dims, dims, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))

    # Marked so that the optimizer never repeats a call, which may be a paid one.
    return embed.asNondeterministic()(F.coalesce(text, F.lit("")))


def hash_buckets(tokens: Column, dimensions: int) -> Column:
    """Bucket number of each token, built from native expressions only."""
    return F.transform(tokens, lambda t: (fnv1a(t) % F.lit(dimensions)).cast("int"))
