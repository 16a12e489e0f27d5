from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from citewright.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text: str, by_words: bool) -> list[int]:
    data = bpe.encoder(PATH, PATTERN, by_words).ids(text)
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


@pytest.mark.parametrize("by_words", [True, False])
def test_ids_equal_the_library(library, by_words):
    rng = random.Random(5)
    parts = ["a", "b", "th", "e", " ", "  ", "\n", "\t", "é", "日", "🎉", "1", "'s", "'", "!", "-", "\x1c", "\x85", " ", "ing"]
    texts = ["", " ", "a" * 3000, "<|endoftext|>", "it's  \n\n x ", "é" * 400]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    for text in texts:
        assert ids(text, by_words) == library.encode_ordinary(text), text


def test_rows_and_edges(spark, library):
    rows = [(1, "the rest of it, and a line\n"), (2, None), (3, ""), (4, "word " * 60_000), (1, "the rest of it, and a line\n"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(7)).withColumn("decoded", F.lit("x"))
    got = bpe.token_digests(df, PATH, PATTERN, by_words=True).collect()
    want = []
    for key, text in rows:
        tokens = library.encode_ordinary(text or "")
        packed = b"".join(t.to_bytes(4, "little") for t in tokens)
        digests = hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
        want.append((key, len(tokens), *digests))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.token_digests(df.limit(0), PATH, PATTERN).count() == 0
    kept = bpe.encode(df, PATH, PATTERN)
    assert sorted(kept.columns) == ["decoded", "doc_id", "ids", "n_tokens", "text"]
