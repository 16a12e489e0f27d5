from __future__ import annotations

import re

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citewright.functions.chunk import ChunkOptions, windows
from citewright.functions.embed import HashEmbedder, RemoteEmbedder, embed_column
from citewright.functions.highlight import highlight_span
from citewright.functions.html import extract_text
from citewright.functions.pii import detect_pii, redact_pii
from citewright.functions.sections import detect_sections
from citewright.functions.strings import trim_ws
from citewright.functions.tokens import fnv1a, index_terms, match_expression, tokenize
from citewright.plans.ingest import canonical_filings, chunk_filings


def run(spark, texts, *exprs):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = rows.select("i", *[e(F.col("t")).alias(f"e{n}") for n, e in enumerate(exprs)]).orderBy("i")
    return [tuple(r)[1:] if len(exprs) > 1 else r[1] for r in out.collect()]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<!-- a\n b --><HEAD><style>x</style></HEAD><header>k</header>z", "k z"),
        ("<SCRIPT a=b>x</p></script>q<P class=c>l1<br/>l2 ﻿ x\r\n\r\n y \t</p>", "q\nl1\nl2 x\ny"),
        ("&AMP; &copy; &#8217;&#x1F600; &#12ab;| &#abc; &#X41; &#9999999999;", "& &copy; ’😀 | &#abc; &#X41; &#9999999999;"),
        ("&amp;lt; &lt;b&gt; &#xD800; &#x110000;&#0065;", "&lt; <b> � &#x110000;A"),
        ("a\rb<articles>c</articles><h1>d</h1>", "a\nb c\nd"),
        ("<!-- never closed <p>x<b>y", "y"),
        ("", ""),
    ],
)
def test_extract(spark, html, text):
    assert run(spark, [html], extract_text) == [text]


def test_trim_uses_the_full_white_space_set(spark):
    assert run(spark, ["﻿  a b  \n", "\u0085x\u0085"], trim_ws) == ["a b", "\u0085x\u0085"]


PII_CASES = [
    ("Mail desk@orchard.example by noon.", "Mail [REDACTED:email] by noon."),
    ("Holder 561-40-7732 signed.", "Holder [REDACTED:ssn] signed."),
    ("iban m@n.io 4400917726", "iban [REDACTED:email] [REDACTED:account-number]"),
    ("ring +1 (312) 555-0176 or 312.555.0176", "ring [REDACTED:phone] or [REDACTED:phone]"),
    ("routing 440091772610533872 is too long", "routing 440091772610533872 is too long"),
    ("p@q.com+r@s.org", "[REDACTED:email][REDACTED:email]"),
    ("312-555-0176@post.example", "[REDACTED:email]"),
    ("takings of $9,310 from 7700125501 crates", "takings of $9,310 from 7700125501 crates"),
    ("ü561-40-7732 y", "ü[REDACTED:ssn] y"),
    ("", ""),
]


def test_redact(spark):
    out = run(spark, [t for t, _ in PII_CASES], redact_pii)
    assert [r.text for r in out] == [t for _, t in PII_CASES]
    for row in out:
        for hit in row.hits:
            assert row.text[hit.start : hit.end] == f"[REDACTED:{hit.type}]"


_LOCAL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# What counts as personal data.
PLAIN_PATTERNS = [
    ("email", _LOCAL, 0),
    ("ssn", r"(?a)\b\d{3}-\d{2}-\d{4}\b", 0),
    ("phone", r"(?a)(?:\+?1[-.\s]?)?(?:\(\d{3}\)\s?|\d{3}[-.\s])\d{3}[-.\s]\d{4}\b", 0),
    ("account-number", r"(?a)(?<=\b(?:account|acct|a/c|routing|iban)\b\D{0,12})\d{9,17}\b", regex.I),
]


def plain_pii(text):
    kept = []
    for kind, pattern, flags in PLAIN_PATTERNS:
        for m in regex.finditer(pattern, text, flags):
            if not any(m.start() < e and s < m.end() for _, s, e in kept):
                kept.append((kind, m.start(), m.end()))
    return sorted(kept, key=lambda x: x[1])


pieces = st.lists(
    st.sampled_from(
        ["acct ", "Account", " a@b.co", "x.y@z.org", "561-40-7732", "312-555-0176", "(312) 555-0176", "1",
         "123456789", "@", "+", "-", " ", "\n", "é", "iban:", "000000000000", ".com", "a/c #", "😀"]
    ),
    max_size=14,
).map("".join)


@settings(max_examples=20, deadline=None)
@given(st.lists(pieces, min_size=30, max_size=60))
def test_detect_matches_plain_scan(spark, texts):
    out = run(spark, texts, detect_pii)
    assert [[(s.type, s.start, s.end) for s in row] for row in out] == [plain_pii(t) for t in texts]


headings = st.lists(
    st.sampled_from(
        ["PART I\n", "Part II\n", "part iv ", "Item 1. Alpha text\n", "ITEM 1A. Beta here\n",
         "Item 2.\nGamma line\n", "see Item 1, no\n", "body words. ", "xItem 3. Nope\n", "Item 10. Delta\n", "😀 ", "Item 4. 😀x\n", "Item 5. Ab😀c\n"]
    ),
    max_size=12,
).map("".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(headings, min_size=20, max_size=40))
def test_sections_keep_their_promises(spark, texts):
    heading = re.compile(r"(?i)\bItem\s+([0-9]{1,2}[A-Z]?)\.\s+[A-Za-z][^\n]{2,90}", re.A)
    marker = re.compile(r"(?i)\bPART\s+(IV|I{1,3})\b", re.A)
    for text, row in zip(texts, run(spark, texts, detect_sections)):
        found = {m.start(): m[1].upper() for m in heading.finditer(text)}
        named = {m.start(): m[1].upper() for m in marker.finditer(text)}
        part_at = lambda at: named[max(p for p in named if p <= at)] if any(p <= at for p in named) else None
        # They tile the text from the first kept heading to the end.
        assert bool(row) == bool(found)
        assert [s.end for s in row] == [s.start for s in row[1:]] + [len(text)] * bool(row)
        # Each is a heading under the part named last before it, and no other heading of its kind follows.
        for s in row:
            assert found[s.start] == s.item and part_at(s.start) == s.part
            assert not any(i == s.item and part_at(at) == s.part for at, i in found.items() if at > s.start)
        # A heading that is missing has a later twin, or no part while its item has one elsewhere.
        kept = {(s.part, s.item) for s in row}
        for at, item in found.items():
            part = part_at(at)
            assert (part, item) in kept or (part is None and any(i == item and p for p, i in kept))
            if part is None and any(i == item and part_at(o) for o, i in found.items()):
                assert (None, item) not in kept


def test_sections_of_filing(spark, raw):
    row = canonical_filings(raw).filter("cik = '0000000001'").select(
        "canonical_text", detect_sections(F.col("canonical_text")).alias("s"), "redactions"
    ).first()
    assert [(s.id, s.label) for s in row.s] == [
        ("part-i-item-1", "Part I, Item 1: Accounts"),
        ("part-i-item-2", "Part I, Item 2: Discussion of harvest"),
        ("part-ii-item-1", "Part II, Item 1: Legal matters"),
        ("part-ii-item-1a", "Part II, Item 1A: Risk factors"),
    ]
    assert row.s[-1].end == len(row.canonical_text)
    assert [h.type for h in row.redactions] == ["email", "phone", "ssn", "account-number"]
    assert "orchard.example" not in row.canonical_text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. !\n ", max_size=200), st.integers(1, 30), st.integers(0, 20), st.integers(0, 9))
def test_windows_keep_their_promises(text, low, more, overlap):
    o = ChunkOptions(low + more, low, min(overlap, low - 1))
    got = list(windows(text, 0, len(text), o))
    white = " \n\u00a0"
    ink = {at for at, char in enumerate(text) if char not in white}
    assert ink <= {at for a, b in got for at in range(a, b)}
    assert bool(got) == bool(ink)
    for n, (a, b) in enumerate(got):
        assert a in ink and a < b <= min(a + o.max_chars, len(text))
        assert (b == len(text)) == (n == len(got) - 1) or not ink & set(range(b, len(text)))
        if b < len(text):
            # It ends behind the last sentence mark it may end at, else behind the last space, else at its limit.
            room = range(a + o.min_chars, a + o.max_chars)
            marks, spaces = ([at for at in room if text[at] in kind] for kind in (".!?", white))
            assert b == (max(marks) + 1 if marks else max(spaces) + 1 if spaces else a + o.max_chars)
    for (a, b), (c, _) in zip(got, got[1:]):
        # The next one begins with the first ink at the overlap.
        assert c > a and c >= b - o.overlap_chars and not ink & set(range(max(a + 1, b - o.overlap_chars), c))


@pytest.mark.parametrize("bad", [(1200, 400, 400), (1200, 400, -1), (300, 400, 10)])
def test_chunk_options_are_checked(bad):
    with pytest.raises(ValueError):
        ChunkOptions(*bad)


def test_chunks_slice_the_text_and_stay_in_their_section(spark, raw):
    filings = canonical_filings(raw)
    texts = {r.accession: r.canonical_text for r in filings.collect()}
    chunks = chunk_filings(filings).collect()
    assert len({c.chunk_id for c in chunks}) == len(chunks) == 8
    for c in chunks:
        assert texts[c.accession][c.start_offset : c.end_offset] == c.text
        assert c.chunk_id == f"{c.accession}:{c.start_offset}-{c.end_offset}"
        assert len(c.text) <= 1200


def test_text_without_headings_has_no_chunks(spark):
    row = ("0000000003", "0000000003-26-000003", "C", "10-K", "2026-01-01", "plain words 😀", [])
    filings = spark.createDataFrame(
        [row],
        "cik string, accession string, company string, form string, filing_date string, "
        "canonical_text string, redactions array<int>",
    )
    assert chunk_filings(filings).count() == 0


def plain_embedding(text, dims):
    vector = [0.0] * dims
    for token in re.findall("[a-z0-9]+", text.lower()):
        h = 2166136261
        for c in token:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        vector[h % dims] += 1
    norm = sum(v * v for v in vector) ** 0.5
    return [v / norm if norm else 0.0 for v in vector]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB9é \n.zé", max_size=40), max_size=8), st.sampled_from([1, 16, 256]))
def test_hash_embedder_matches_plain_loop(texts, dims):
    got = HashEmbedder(dims).embed(texts)
    assert got.shape == (len(texts), dims)
    assert np.allclose(got, np.array([plain_embedding(t, dims) for t in texts]).reshape(-1, dims))


def test_embedding_column(spark):
    texts = ["cider takings grew", "", "Cider TAKINGS grew!", "frost"]
    out = run(spark, texts, lambda c: embed_column(c, HashEmbedder(64)))
    assert np.allclose(out, [plain_embedding(t, 64) for t in texts], atol=1e-6)
    assert out[0] == out[2] and not any(out[1])
    assert HashEmbedder().id == "fake-hash-v1:256"


def test_remote_embedder_restores_order_and_checks_size(spark):
    def post(body):
        import json

        n = len(json.loads(body)["input"])
        data = [{"index": i, "embedding": [float(i), 1.0]} for i in range(n)]
        return json.dumps({"data": data[::-1]})

    remote = RemoteEmbedder(post, size=2)
    assert remote.embed(["a", "b", "c"])[:, 0].tolist() == [0, 1, 2]
    assert remote.embed([]).shape == (0, 2)
    assert RemoteEmbedder(post, "voyage-3-lite").dimensions == 512
    frame = spark.createDataFrame([("a",)], "t string").coalesce(1)
    assert frame.select(embed_column(F.col("t"), remote).alias("v")).first().v == [0.0, 1.0]
    with pytest.raises(Exception, match="expected 1 vectors of size 3"):
        frame.select(embed_column(F.col("t"), RemoteEmbedder(post, size=3)).alias("v")).collect()


def test_tokens(spark):
    assert run(spark, ["sales"], fnv1a) == [2258376375]
    assert run(spark, ["Élan vital, 31%"], tokenize) == [["lan", "vital", "31"]]
    assert run(spark, ["Éléve éte Straße 31%"], index_terms) == [["eleve", "ete", "straße", "31"]]
    assert run(spark, ["cider takings (grew 31%) a", "a ?"], match_expression) == [
        '"cider" OR "takings" OR "grew" OR "31"', "",
    ]


@pytest.mark.parametrize(
    ("start", "end", "want"),
    [(2, 4, ("ab", "cd", "ef", False, True)), (-5, 2, ("", "ab", "cd", False, True)),
     (6, 99, ("ef", "gh", "", True, False)), (50, 40, ("gh", "", "", True, False))],
)
def test_highlight(spark, start, end, want):
    got = run(spark, ["abcdefgh"], lambda c: highlight_span(c, F.lit(start), F.lit(end), 2))[0]
    assert tuple(got) == want
