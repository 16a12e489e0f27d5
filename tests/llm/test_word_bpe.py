from __future__ import annotations

import hashlib
import random
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citewright.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def words():
    return word_bpe.WordVocabulary(PATH)


def texts():
    rng = random.Random(11)
    parts = ["a", "b", "th", "e", " ", "  ", "\n", "\t", "é", "é", "́", "日", "🎉", "1", "'s", "'", "'LL", "!", "-", "\x1c", "\x85"]
    parts += [" ", "​", "ing", "Σ", "ΑΣ", "İ", "ß", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "Ᲊ", "Ꟛ", "\x00", "ﬁ"]
    yield from ["", " ", "it's  \n\n x ", "é" * 400, "don'T you'll", "a" * 99, "a" * 100, "a" * 101, "ab" * 700]
    for _ in range(4000):
        yield "".join(rng.choice(parts) for _ in range(rng.randint(1, 60)))


def test_ids_and_text_equal_the_library(library, words):
    every = list(texts())
    for text, found in zip(every, word_bpe.Encoder(words).encode(every)):
        ids = [int.from_bytes(found[i : i + 4], "little") for i in range(0, len(found), 4)]
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert words.decode(ids) == library.decode(ids, skip_special_tokens=False), text


def test_every_code_point_equals_the_library(library, words):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4000):
        text = "".join(f"a{c}b" + " " * (i % 100 == 99) for i, c in enumerate(points[at : at + 4000]))
        assert word_bpe.Encoder(words).encode([text])[0] == word_bpe.pack(library.encode(text, add_special_tokens=False).ids)


def test_scan_and_heap_merge_alike(words):
    rng = random.Random(3)
    for _ in range(2000):
        word = "".join(rng.choice("theinaro") for _ in range(rng.randint(1, 90)))
        tokens = words._letters([word])
        row = words._merged_short(tokens.astype("int64").reshape(1, -1))[0].tolist()
        assert [token for token in row if token >= 0] == words._merged_long(tokens.tolist())


def test_plain_letters_are_split_as_by_the_library(words):
    rng = random.Random(9)
    assert words.plain
    texts = ["".join(rng.choice("abSTLV'09-!\"x.remlÀéßÿ×") for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    assert words.words_of(texts) == [[word for word, _ in words.split(words.normal(text))] for text in texts]


def test_what_is_remembered_stays_small(words, monkeypatch):
    monkeypatch.setattr(word_bpe, "MEMO_ENTRIES", 50)
    encoder = word_bpe.Encoder(words)
    for i in range(30):
        texts = [f"w{i}x{j} {'long' * 20}{j}" for j in range(20)]
        assert encoder.encode(texts) == word_bpe.Encoder(words).encode(texts)
        assert len(encoder.stretches) < 120 and len(encoder.known) < 240
        assert max(map(len, encoder.stretches)) <= word_bpe.MEMO_CHARACTERS


def test_a_very_long_word_takes_no_square_of_its_length(library, words):
    word = "".join(random.Random(2).choice("abcdefghij") for _ in range(200_000))
    began = time.perf_counter()
    ids = word_bpe.Encoder(words).encode([word])[0]
    assert time.perf_counter() - began < 20
    assert ids == word_bpe.pack( library.encode(word, add_special_tokens=False).ids)


def test_rows_and_edges(spark, library):
    rows = [(1, "the rest of it, and a Line\n"), (2, None), (3, ""), (4, "word " * 60_000), (1, "the rest of it, and a Line\n"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(7)).withColumn("decoded", F.lit("x"))
    got = word_bpe.token_digests(df, PATH).collect()
    want = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((key, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert word_bpe.token_digests(df.limit(0), PATH).count() == 0
    assert sorted(word_bpe.encode(df, PATH).columns) == ["decoded", "doc_id", "ids", "n_tokens", "text"]


def test_the_whole_table_against_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {row["doc_id"]: row["ids_sha256"] for row in word_bpe.token_digests(docs, PATH).collect()}
    for row in docs.collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert got[row["doc_id"]] == hashlib.sha256(word_bpe.pack(ids)).hexdigest()
