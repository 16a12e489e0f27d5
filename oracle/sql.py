"""The registered queries restated in SQL, built from shared table expressions."""

from __future__ import annotations

import unicodedata

# Fixed values, stated here again so that a wrong one elsewhere shows.
BLOCK_TAGS = ["p", "div", "br", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "article"]
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
MODEL_RATES = {
    "claude-opus-4-8": (5.0, 25.0),
    "claude-sonnet-4-6": (3.0, 15.0),
    "claude-haiku-4-5": (1.0, 5.0),
}
REFUSAL_MESSAGE = "This question is not supported by the available corpus."

_SPACES = (
    r"\t\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
WS = f"[{_SPACES}\\n]"
INLINE = f"[{_SPACES}]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sub(text: str, pattern: str, by: str, flags: str = "g") -> str:
    return f"regexp_replace({text}, {_q(pattern)}, {_q(by)}, '{flags}')"


def _trim(text: str) -> str:
    return _sub(_sub(text, f"\\A{WS}+", ""), f"{WS}+\\z", "")


def _collapse(text: str) -> str:
    return _trim(_sub(text, f"{WS}+", " "))


def _extract(html: str) -> str:
    """Canonical text, one replacement after another."""
    text = _sub(html, "(?s)<!--.*?-->", " ")
    for name in ("script", "style", "head"):
        text = _sub(text, f"(?is)<{name}\\b[^>]*>.*?</{name}>", " ")
    text = _sub(text, f"(?i)</?(?:{'|'.join(BLOCK_TAGS)})\\b[^>]*>", "\n")
    text = _sub(text, "<[^>]+>", " ")
    for name, char in list(NAMED_ENTITIES.items())[1:]:
        text = _sub(text, f"(?i)&{name};", char)
    for body, char in (("#64", "@"), ("#8217", "’"), ("#x2019", "’")):
        text = f"replace({text}, '&{body};', {_q(char)})"
    text = _sub(text, "(?i)&amp;", "&")
    text = _sub(text, "\\r\\n?", "\n")
    text = _sub(text, f"{INLINE}+", " ")
    text = _sub(text, " ?\\n ?", "\n")
    return _trim(_sub(text, "\\n{2,}", "\n"))


def _spans(name: str, source: str, key: str, pattern: str, group: int = 0, flags: str = "") -> str:
    """A table of match positions: key, number, start, end, hit."""
    found = f"regexp_extract_all(body, {_q(flags + pattern)})"
    gaps = f"string_split_regex(body, {_q(flags + pattern)})"
    return f"""
{name}_p AS MATERIALIZED (
  SELECT {key}, unnest({found}) AS hit, unnest(list_slice({gaps}, 1, len({found}))) AS gap,
         unnest(range(1, len({found}) + 1)) AS no
  FROM {source} WHERE regexp_matches(body, {_q(flags + pattern)})),
{name} AS MATERIALIZED (
  SELECT {key}, no, hit, e - length(hit) AS s, e FROM (
    SELECT {key}, no, hit,
           sum(length(gap) + length(hit)) OVER (PARTITION BY {key} ORDER BY no)::BIGINT AS e
    FROM {name}_p))"""


EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
SSN = "\\b\\d{3}-\\d{2}-\\d{4}\\b"
_GAP = f"[-.{_SPACES}\\n]"
PHONE = f"(?:\\+?1{_GAP}?)?(?:\\(\\d{{3}}\\){WS}?|\\d{{3}}{_GAP})\\d{{3}}{_GAP}\\d{{4}}\\b"
ACCOUNT = "\\b(?:account|acct|a/c|routing|iban)\\b\\D{0,12}\\d{9,17}\\b"


def _pii(source: str, key: str) -> str:
    """Kept spans of ``source(key, body)``: each kind minus what earlier kinds cover."""
    parts = [
        _spans("pii_email", source, key, EMAIL),
        _spans("pii_ssn", source, key, SSN),
        _spans("pii_phone", source, key, PHONE),
        _spans("pii_acct_kw", source, key, ACCOUNT, flags="(?i)"),
        f"""
pii_acct AS (
  SELECT {key}, no, e - length(regexp_extract(hit, '[0-9]+$')) AS s, e FROM pii_acct_kw)""",
    ]
    kept = f"pii0 AS MATERIALIZED (SELECT {key}, 'email' AS type, s, e FROM pii_email)"
    parts.append(kept)
    for i, (name, kind) in enumerate(
        (("ssn", "ssn"), ("phone", "phone"), ("acct", "account-number")), start=1
    ):
        parts.append(
            f"""
pii{i} AS MATERIALIZED (
  SELECT * FROM pii{i - 1} UNION ALL
  SELECT {key}, '{kind}' AS type, s, e FROM pii_{name} n
  WHERE NOT EXISTS (SELECT 1 FROM pii{i - 1} k
                    WHERE {_same("k", "n", key)} AND n.s < k.e AND k.s < n.e))"""
        )
    parts.append(
        f"""
pii AS MATERIALIZED (
  SELECT *, coalesce(lag(e) OVER w, 0) AS prev,
         (s + coalesce(sum(length(type) + 11 - (e - s)) OVER
           (PARTITION BY {key} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS spot
  FROM pii3 WINDOW w AS (PARTITION BY {key} ORDER BY s))"""
    )
    parts.append(
        f"""
redacted AS MATERIALIZED (
  SELECT t.*, coalesce(p.n, 0) AS n_hits,
         CASE WHEN p.n IS NULL THEN t.body
              ELSE p.start_text || substr(t.body, p.last + 1) END AS clean
  FROM {source} t LEFT JOIN (
    SELECT {", ".join("x." + k.strip() for k in key.split(","))}, count(*) AS n, max(x.e) AS last,
           string_agg(substr(y.body, x.prev + 1, x.s - x.prev) || '[REDACTED:' || x.type || ']', ''
                      ORDER BY x.s) AS start_text
    FROM pii x JOIN {source} y ON {_same("x", "y", key)}
    GROUP BY {", ".join("x." + k.strip() for k in key.split(","))}) p ON {_same("t", "p", key)})"""
    )
    return ",".join(parts)


def _same(a: str, b: str, key: str) -> str:
    return " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in key.split(","))


def _meta(key: str, company: str) -> str:
    return f"""lpad(({key} % 9973)::VARCHAR, 10, '0') AS cik,
  lpad({key}::VARCHAR, 10, '0') || '-24-' || lpad(({key} % 1000000)::VARCHAR, 6, '0') AS accession,
  'Issuer ' || {company} AS company,
  CASE WHEN {key} % 2 = 0 THEN '10-Q' ELSE '10-K' END AS form,
  '2024-' || lpad(({key} % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad(({key} % 28 + 1)::VARCHAR, 2, '0')
    AS filing_date"""


FILINGS = f"""
raw AS MATERIALIZED (
  SELECT {_meta("doc_id", "source")},
    'Contents' || chr(10) || 'Item 1. Business overview' || chr(10) || 'Item 7. Results of operations'
    || chr(10) || 'Item 9B. Other matters' || chr(10) || 'PART I' || chr(10)
    || 'Item 1. Business overview' || chr(10) || substr(text, 1, length(text) // 2) || chr(10)
    || 'PART II' || chr(10) || 'Item 7. Results of operations' || chr(10)
    || substr(text, length(text) // 2 + 1) || chr(10)
    || 'Item 8. Contact details' || chr(10) || 'Holder SSN ' || lpad((doc_id % 1000)::VARCHAR, 3, '0')
    || '-' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 10000)::VARCHAR, 4, '0')
    || ', account no. ' || lpad(doc_id::VARCHAR, 12, '0')
    || ', phone (425) 555-' || lpad((doc_id % 10000)::VARCHAR, 4, '0')
    || ', desk 425-555-' || lpad((doc_id % 10000)::VARCHAR, 4, '0')
    || '@mail.example, acct u@ma.io 9990' || lpad(doc_id::VARCHAR, 8, '0') || '.' AS body
  FROM documents)"""

PAGE_FILINGS = f"""
page_html AS (
  SELECT page_id, url, '<p>PART I</p><p>Item 1. Business &amp; strategy</p>' || html
    || '<div>Item 2. Properties&nbsp;held</div><p>Write to desk&#64;mail.example &#8217;now&#x2019;.</p>'
    AS html FROM pages),
raw AS MATERIALIZED (
  SELECT {_meta("page_id", "regexp_extract(url, '^https?://([^/]+)', 1)")}, {_extract("html")} AS body
  FROM page_html)"""

PART = f"(?i)\\bPART{WS}+(IV|I{{1,3}})\\b"
ITEM = f"(?i)\\bItem{WS}+(\\d{{1,2}}[A-Z]?)\\.{WS}+([A-Za-z][^\\n]{{2,90}})"


def _sections(source: str, key: str = "accession") -> str:
    """``sections`` of ``source(key, body)``."""
    return f"""{_spans("parts", source, key, PART)},{_spans("items", source, key, ITEM)},
heads AS MATERIALIZED (
  SELECT i.{key}, i.s, upper(regexp_extract(i.hit, {_q(ITEM)}, 1)) AS item,
         {_collapse(f"regexp_extract(i.hit, {_q(ITEM)}, 2)")} AS title,
         (SELECT upper(regexp_extract(arg_max(p.hit, p.s), {_q(PART)}, 1)) FROM parts p
          WHERE p.{key} = i.{key} AND p.s <= i.s) AS part
  FROM items i),
kept AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, max(part) OVER (PARTITION BY {key}, item) AS some_part,
           row_number() OVER (PARTITION BY {key}, part, item ORDER BY s DESC) AS back
    FROM heads)
  WHERE back = 1 AND NOT (part IS NULL AND some_part IS NOT NULL)),
sections AS MATERIALIZED (
  SELECT k.{key}, lower(coalesce('part-' || part || '-', '') || 'item-' || item) AS id,
         coalesce('Part ' || part || ', ', '') || 'Item ' || item || ': ' || title AS label,
         part, item, title, k.s AS start,
         coalesce(lead(k.s) OVER (PARTITION BY k.{key} ORDER BY k.s), length(t.body)) AS "end", t.body
  FROM kept k JOIN {source} t USING ({key}))"""


def _skip(text: str, at: str) -> str:
    """``at`` moved past white space within a section text that is 0-based."""
    return f"({at} + length(regexp_extract(substr({text}, {at} + 1), '\\A{WS}*')))"


_WINDOW = "substr(sec, pos + 401, 800)"
_MARK = f"length(regexp_extract({_WINDOW}, '(?s)\\A.*[.!?]'))"
_SPACE = f"length(regexp_extract({_WINDOW}, '(?s)\\A.*{WS}'))"
_STOP = f"""CASE WHEN pos + 1200 >= size THEN size
  ELSE pos + 400 + CASE WHEN {_MARK} > 0 THEN {_MARK} WHEN {_SPACE} > 0 THEN {_SPACE} ELSE 800 END END"""

CHUNKS = f"""
cut_start AS (
  SELECT accession, id, label, start, substr(body, start + 1, "end" - start) AS sec, "end" - start AS size
  FROM sections),
cut AS (
  SELECT *, {_STOP} AS stop FROM (
    SELECT *, {_skip("sec", "0")} AS pos FROM cut_start) WHERE pos < size
  UNION ALL
  SELECT *, {_STOP} AS stop FROM (
    SELECT accession, id, label, start, sec, size, {_skip("sec", "greatest(pos + 1, stop - 150)")} AS pos
    FROM cut WHERE stop < size) WHERE pos < size),
chunks AS MATERIALIZED (
  SELECT accession || ':' || (start + pos) || '-' || (start + stop) AS chunk_id, accession,
         id AS section_id, label AS section_label, start + pos AS start_offset,
         start + stop AS end_offset, substr(sec, pos + 1, stop - pos) AS text
  FROM cut)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip() for p in parts) + "\n"


CLEAN = "clean_texts AS MATERIALIZED (SELECT * EXCLUDE (body, clean), clean AS body FROM redacted)"
# The filings after a way through HTML.
STORED = [
    FILINGS.replace("raw AS", "texts AS", 1),
    "raw AS MATERIALIZED (SELECT * EXCLUDE (body), "
    + _extract("('<pre>' || replace(replace(body, '&', '&amp;'), '<', '&lt;') || '</pre>')")
    + " AS body FROM texts)",
    _pii("raw", "accession"),
    CLEAN,
    _sections("clean_texts"),
    CHUNKS,
]
CORPUS = [FILINGS, _pii("raw", "accession"), CLEAN, _sections("clean_texts"), CHUNKS]

_FNV = (
    "list_reduce(list_transform(string_split(token, ''), lambda c: ascii(c)::BIGINT), "
    "lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT)"
)


def _tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def _sparse(name: str, source: str, key: str, text: str) -> str:
    """``name(key, bucket, n, w)``: hashed counts and their float32 unit weights."""
    return f"""
{name}_t AS MATERIALIZED (
  SELECT {key}, token, count(*) AS n FROM (
    SELECT {key}, unnest({_tokens(text)}) AS token FROM {source}) GROUP BY ALL),
{name}_h AS MATERIALIZED (
  SELECT token, {_FNV} % 256 AS bucket FROM (SELECT DISTINCT token FROM {name}_t)),
{name} AS MATERIALIZED (
  SELECT *, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS w FROM (
    SELECT {key}, bucket, sum(n)::BIGINT AS n FROM {name}_t JOIN {name}_h USING (token) GROUP BY ALL))"""


VECTOR = f"""{_sparse("cv", "chunks", "accession, start_offset", "text")},
{_sparse("qv", "benchmark", "item_id", "text")},
cn AS MATERIALIZED (
  SELECT c.accession, c.start_offset, coalesce(sum(w * w), 0) AS sq
  FROM chunks c LEFT JOIN cv USING (accession, start_offset) GROUP BY ALL),
qn AS MATERIALIZED (
  SELECT b.item_id, coalesce(sum(w * w), 0) AS sq FROM benchmark b LEFT JOIN qv USING (item_id) GROUP BY ALL),
dots AS MATERIALIZED (
  SELECT qv.item_id, cv.accession, cv.start_offset, sum(qv.w * cv.w) AS dot
  FROM qv JOIN cv USING (bucket) GROUP BY ALL),
vec AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dk, accession, start_offset) AS vector_rank
    FROM (
      SELECT qn.item_id AS query_id, cn.accession, cn.start_offset,
             floor(sqrt(greatest(qn.sq + cn.sq - 2 * coalesce(dot, 0), 0)) * 1e9 + 0.5) AS dk
      FROM qn CROSS JOIN cn LEFT JOIN dots
        ON dots.item_id = qn.item_id AND dots.accession = cn.accession AND dots.start_offset = cn.start_offset))
  WHERE vector_rank <= 20)"""

def _base(char: str) -> str:
    """The first letter that a character decomposes to, step by step; itself if to none."""
    while (parts := unicodedata.decomposition(char).split()) and not parts[0].startswith("<"):
        char = chr(int(parts[0], 16))
    return char


_LETTERS = [chr(code) for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00))]
_FOLDED = {char: _base(char) for char in _LETTERS if char.islower() and _base(char) != char}
_FROM = "".join(_FOLDED) + "".join(map(chr, range(0x0300, 0x0370)))
_TO = "".join(_FOLDED.values())


def _index_terms(text: str) -> str:
    return (
        f"regexp_extract_all(translate(lower({text}), {_q(_FROM)}, {_q(_TO)}), "
        "'[\\p{L}\\p{N}\\p{Co}]+')"
    )


KEYWORD = f"""
lens AS MATERIALIZED (
  SELECT accession, start_offset, {_index_terms("text")} AS terms FROM chunks),
tf AS MATERIALIZED (
  SELECT accession, start_offset, n_terms, term, count(*) AS tf FROM (
    SELECT accession, start_offset, len(terms) AS n_terms, unnest(terms) AS term FROM lens) GROUP BY ALL),
totals AS (SELECT count(*)::DOUBLE AS n, sum(len(terms)) / count(*) AS mean FROM lens),
asked AS MATERIALIZED (
  SELECT item_id AS query_id, term, count(*) AS times FROM (
    SELECT item_id, unnest({_tokens("text")}) AS term FROM benchmark) WHERE length(term) > 1 GROUP BY ALL),
idf AS MATERIALIZED (
  SELECT term, CASE WHEN raw > 0 THEN raw ELSE 1e-6 END AS idf FROM (
    SELECT term, ln(((SELECT n FROM totals) - count(*) + 0.5) / (count(*) + 0.5)) AS raw
    FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term)),
kw AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, accession, start_offset)
      AS keyword_rank
    FROM (
      SELECT query_id, accession, start_offset, round(sum(times * idf * tf * 2.2
        / (tf + 1.2 * (0.25 + 0.75 * n_terms / (SELECT mean FROM totals)))), 9) AS score
      FROM asked JOIN idf USING (term) JOIN tf USING (term) GROUP BY ALL))
  WHERE keyword_rank <= 20)"""

FUSED = """
fused AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, accession, start_offset) AS fused_rank
  FROM (
    SELECT query_id, accession, start_offset, vector_rank, keyword_rank, dk / 1e9 AS distance,
           coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) AS rrf
    FROM vec FULL JOIN kw USING (query_id, accession, start_offset)))"""

HYBRID = """
top8 AS MATERIALIZED (
  SELECT f.*, c.chunk_id, c.section_id, c.section_label, c.end_offset, c.text,
         m.cik, m.company, m.form, m.filing_date
  FROM fused f JOIN chunks c USING (accession, start_offset) JOIN clean_texts m USING (accession)
  WHERE fused_rank <= 8)"""

RETRIEVAL = [*CORPUS, VECTOR, KEYWORD, FUSED, HYBRID]

TOPS = f"""
tops AS MATERIALIZED (
  SELECT b.item_id AS query_id, b.text AS query, a.chunk_id AS id1, a.text AS t1, a.start_offset AS o1,
         a.company AS company1, a.section_id AS s1, a.section_label AS l1,
         z.chunk_id AS id2, z.text AS t2, z.start_offset AS o2, z.section_id AS s2,
         length(b.text) % 6 AS kind, substr(a.text, 11, 60) AS quote
  FROM benchmark b
  JOIN top8 a ON a.query_id = b.item_id AND a.fused_rank = 1
  JOIN top8 z ON z.query_id = b.item_id AND z.fused_rank = 2),
made AS MATERIALIZED (
  SELECT query_id, kind, unnest(CASE kind
    WHEN 0 THEN [sound] WHEN 1 THEN [sound, misquoted] WHEN 2 THEN [uncited]
    WHEN 3 THEN [sound, fabricated] WHEN 5 THEN [sound, unrelated] ELSE [] END) AS c,
    unnest(CASE WHEN kind IN (0, 2) THEN [0] WHEN kind = 4 THEN [] ELSE [0, 1] END) AS claim_no
  FROM (SELECT *,
    {{'text': 'Stated: ' || quote, 'ids': [id2, id1], 'quote': '  ' || quote || ' '}} AS sound,
    {{'text': 'Misquoted', 'ids': [id1], 'quote': upper(quote)}} AS misquoted,
    {{'text': 'Uncited', 'ids': []::VARCHAR[], 'quote': quote}} AS uncited,
    {{'text': 'Made up', 'ids': ['missing:0-1', id1], 'quote': quote}} AS fabricated,
    {{'text': 'zzzz', 'ids': [id1], 'quote': quote}} AS unrelated FROM tops)),
cites AS MATERIALIZED (
  SELECT m.query_id, m.claim_no, m.c.text AS claim, m.c.quote AS quote, m.cite_no, m.chunk_id,
         t.chunk_id IS NOT NULL AS chunk_found, {_trim("m.c.quote")} AS needle, t.start_offset AS o,
         t.section_id,
         CASE WHEN length({_trim("m.c.quote")}) > 0 THEN coalesce(instr(t.text, {_trim("m.c.quote")}), 0)
              ELSE 0 END AS pos
  FROM (SELECT *, unnest(c.ids) AS chunk_id, unnest(range(len(c.ids))) AS cite_no FROM made) m
  LEFT JOIN top8 t ON t.query_id = m.query_id AND t.chunk_id = m.chunk_id),
claims AS MATERIALIZED (
  SELECT m.query_id, m.claim_no, m.c.text AS claim, count(*) FILTER (c.pos > 0) > 0 AS supported,
         arg_min(c.chunk_id, c.cite_no) FILTER (c.pos > 0) AS chunk_id,
         arg_min(c.o + c.pos - 1, c.cite_no) FILTER (c.pos > 0) AS start_offset,
         arg_min(c.needle, c.cite_no) FILTER (c.pos > 0) AS needle
  FROM made m LEFT JOIN cites c ON c.query_id = m.query_id AND c.claim_no = m.claim_no
  GROUP BY ALL),
judged AS MATERIALIZED (
  SELECT *, supported AND len(list_intersect(
    regexp_extract_all(lower(claim), '[a-z0-9]{{4,}}'),
    regexp_extract_all(lower(needle), '[a-z0-9]{{4,}}'))) > 0 AS verified FROM claims),
checks AS MATERIALIZED (
  SELECT b.item_id AS query_id,
    (SELECT count(*) FROM cites c WHERE c.query_id = b.item_id AND NOT chunk_found) = 0 AS passed,
    (SELECT coalesce(string_agg(DISTINCT c.chunk_id, ','), '') FROM cites c
     WHERE c.query_id = b.item_id AND NOT chunk_found) AS unknown,
    (SELECT count(*) FROM claims j WHERE j.query_id = b.item_id) AS n_claims,
    (SELECT count(*) FROM judged j WHERE j.query_id = b.item_id AND supported) AS n_grounded,
    (SELECT count(*) FROM judged j WHERE j.query_id = b.item_id AND verified) AS n_verified,
    (SELECT max(rrf) FROM top8 j WHERE j.query_id = b.item_id) AS top_rrf
  FROM benchmark b)"""

GOVERN = [*RETRIEVAL, TOPS]


def _reason(verified: str) -> str:
    return f"""CASE WHEN top_rrf IS NULL THEN 'no_retrieval' WHEN top_rrf < 0.02 THEN 'low_retrieval_score'
  WHEN NOT passed THEN 'citation_precheck_failed' WHEN n_claims = 0 THEN 'no_claims'
  WHEN {verified} < n_claims THEN 'unverified_claims' END"""


AUDIT = """
log AS (
  SELECT 'req-' || lpad(event_id::VARCHAR, 8, '0') AS request_id,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at,
         event_type || ' Rate 100%_net ' || props AS query,
         CASE WHEN event_type = 'error' THEN 'refused' ELSE 'answered' END AS verdict,
         CASE WHEN event_type = 'error' THEN 'no_claims' END AS refusal_reason,
         '[{"accession":"' || lpad(user_id::VARCHAR, 10, '0') || '","company":"Issuer ' || user_id
         || '"},{"accession":"' || lpad((user_id + 1)::VARCHAR, 10, '0') || '","company":"Issuer '
         || (user_id + 1) || '"}]' AS retrieved_json,
         value / 1000 AS cost_usd, (props->>'k')::BIGINT AS latency_ms, user_id
  FROM events)"""


def _case(values: dict[str, tuple[float, float]], which: int) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v[which]}" for k, v in values.items())
    return f"CASE model {whens} ELSE 0 END"


def statements() -> dict[str, str]:
    all_turns = """turns AS MATERIALIZED (
  SELECT conv_id, turn, text AS body FROM conversations UNION ALL
  SELECT -1, substr(accession, 1, 10)::BIGINT, body FROM raw)"""
    sentence = _collapse("t1")
    return {
        "extract_text_pages": f"SELECT page_id, {_extract('html')} AS canonical FROM pages",
        "pii_detect_spans": _with(FILINGS, _pii("raw", "accession"))
        + 'SELECT accession, type, s AS start, e AS "end" FROM pii',
        "pii_redact": _with(FILINGS, _pii("raw", "accession"))
        + "SELECT accession, clean AS canonical_text, n_hits FROM redacted",
        "pii_redaction_hits": _with(FILINGS, all_turns, _pii("turns", "conv_id, turn"))
        + 'SELECT conv_id, turn, type, spot AS start, spot + length(type) + 11 AS "end" FROM pii',
        "section_detect": _with(FILINGS, _sections("raw"))
        + 'SELECT accession, id, label, part, item, title, start, "end" FROM sections',
        "chunk_windows": _with(FILINGS, _sections("raw"), CHUNKS)
        + "SELECT chunk_id, accession, section_id, start_offset, end_offset, text FROM chunks",
        "ingest_pages": _with(PAGE_FILINGS, _pii("raw", "accession"), CLEAN, _sections("clean_texts"), CHUNKS)
        + """SELECT accession, (SELECT count(*) FROM sections s WHERE s.accession = t.accession) AS section_count,
       (SELECT count(*) FROM chunks s WHERE s.accession = t.accession) AS chunk_count,
       n_hits AS redaction_count, length(body) AS canonical_length FROM clean_texts t""",
        "meta_validate": """SELECT c_custkey, CASE c_custkey % 7 WHEN 1 THEN 'cik' WHEN 2 THEN 'accession'
  WHEN 3 THEN 'company' WHEN 4 THEN 'form' WHEN 5 THEN 'filing_date' ELSE '' END AS invalid FROM customer""",
        "tokenize_documents": f"""SELECT doc_id, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS tokens
FROM (SELECT doc_id, {_tokens("text")} AS tokens FROM documents)""",
        "fnv_hash": f"""SELECT token, {_FNV} AS hash FROM (
  SELECT DISTINCT unnest({_tokens("text")}) AS token FROM documents)""",
        "hash_embedding_sparse": _with(_sparse("e", "conversations", "conv_id, turn", "text"))
        + "SELECT conv_id, turn, bucket, n FROM e",
        "hash_embedding_norm": _with(_sparse("e", "conversations", "conv_id, turn", "text"))
        + "SELECT conv_id, turn, bucket, round(w, 6) AS weight FROM e",
        "vector_topk_centres": """WITH parts AS (
  SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings),
centres AS (SELECT label, list(v ORDER BY i) AS q FROM (
  SELECT label, i, avg(v) AS v FROM parts GROUP BY ALL) GROUP BY label)
SELECT query_id, vec_id, vector_rank, round(dk / 1e9, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dk, vec_id) AS vector_rank FROM (
    SELECT c.label::BIGINT AS query_id, vec_id,
           floor(list_distance(q, embedding::DOUBLE[]) * 1e9 + 0.5) AS dk
    FROM centres c CROSS JOIN embeddings)) WHERE vector_rank <= 20""",
        "fts_query_terms": f"""SELECT item_id AS query_id, array_to_string(list_transform(
  list_filter({_tokens("text")}, lambda t: length(t) > 1), lambda t: '"' || t || '"'), ' OR ') AS expression
FROM benchmark""",
        "postings_index": f"""SELECT conv_id, turn, term, count(*) AS tf, n_terms FROM (
  SELECT conv_id, turn, len(terms) AS n_terms, unnest(terms) AS term FROM (
    SELECT conv_id, turn, {_index_terms("text")} AS terms FROM conversations)) GROUP BY ALL""",
        "vector_topk_chunks": _with(*CORPUS, VECTOR)
        + """SELECT query_id, accession, start_offset, vector_rank, round(dk / 1e9, 6) AS distance FROM vec""",
        "bm25_topk_chunks": _with(*CORPUS, KEYWORD)
        + "SELECT query_id, accession, start_offset, keyword_rank, round(score, 6) AS score FROM kw",
        "bm25_topk_postings": _with(*CORPUS, KEYWORD)
        + "SELECT query_id, accession, start_offset, keyword_rank, round(score, 6) AS score FROM kw",
        "rrf_two_list": _with(*CORPUS, VECTOR, KEYWORD, FUSED)
        + """SELECT query_id, accession, start_offset, fused_rank, vector_rank, keyword_rank,
  round(rrf, 9) AS rrf FROM fused""",
        "rrf_n_list": """WITH r AS (
  SELECT o_custkey AS query_id, o_orderkey,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r0,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r1,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r2 FROM orders),
c AS (SELECT query_id, o_orderkey, r0 AS rank_0, r1 AS rank_1, r2 AS rank_2 FROM r),
s AS (
  SELECT *, coalesce(1.0::DOUBLE / (60 + rank_0), 0) + coalesce(1.0::DOUBLE / (60 + rank_1), 0)
    + coalesce(1.0::DOUBLE / (60 + rank_2), 0) AS rrf FROM c)
SELECT query_id, o_orderkey, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, o_orderkey) AS fused_rank,
       round(rrf, 9) AS rrf, rank_0, rank_1, rank_2 FROM s""",
        "hybrid_retrieve_chunks": _with(*RETRIEVAL)
        + """SELECT query_id, chunk_id, fused_rank, vector_rank, keyword_rank, round(distance, 6) AS distance,
  round(rrf, 9) AS rrf FROM top8""",
        "hydrate_provenance": _with(*RETRIEVAL)
        + """SELECT query_id, chunk_id, cik, accession, company, form, filing_date, section_id, section_label,
  start_offset, end_offset, text FROM top8""",
        "retrieval_gate_reasons": _with(*RETRIEVAL)
        + """SELECT item_id AS query_id, count(chunk_id) AS n_retrieved, round(coalesce(max(rrf), 0), 9) AS top_rrf,
  CASE WHEN count(chunk_id) = 0 THEN 'no_retrieval' WHEN max(rrf) < 0.02 THEN 'low_retrieval_score' END AS reason,
  CASE WHEN count(chunk_id) = 0 THEN 'no_retrieval' WHEN max(rrf) < 0.0325 THEN 'low_retrieval_score' END
    AS strict_reason
FROM benchmark LEFT JOIN top8 ON query_id = item_id GROUP BY item_id""",
        "gate_intersection_fastpath": _with(*RETRIEVAL)
        + """SELECT item_id AS query_id, coalesce(max(rrf), 0) >= 0.02 AS sufficient
FROM benchmark LEFT JOIN top8 ON query_id = item_id GROUP BY item_id""",
        "prompt_render": _with(*RETRIEVAL)
        + """SELECT item_id AS query_id, '<sources>' || chr(10) || coalesce(string_agg(
  '<source>' || chr(10) || 'chunk_id: ' || chunk_id || ' | ' || company || ' ' || form || ' | ' || section_label
  || chr(10) || '---' || chr(10) || t.text || chr(10) || '</source>', chr(10) || chr(10) ORDER BY fused_rank), '')
  || chr(10) || '</sources>' || chr(10) || chr(10) || 'Question:' || chr(10) || any_value(b.text) AS prompt
FROM benchmark b LEFT JOIN top8 t ON query_id = item_id GROUP BY item_id""",
        "cost_estimate": f"""SELECT model, count(*) AS calls, round(sum(
  l_partkey / 1000000.0::DOUBLE * {_case(MODEL_RATES, 0)} + l_suppkey / 1000000.0::DOUBLE * {_case(MODEL_RATES, 1)}), 6)
  AS cost_usd
FROM (SELECT *, ['claude-opus-4-8', 'claude-sonnet-4-6', 'claude-haiku-4-5', 'other'][l_linenumber % 4 + 1] AS model
      FROM lineitem) GROUP BY model""",
        "reply_validation": """WITH parts AS (SELECT conv_id, turn, text, (conv_id + turn) % 8 AS kind,
  json_object('text', role, 'chunk_ids', [conv_id::VARCHAR], 'quote', substr(text, 1, 30)) AS whole,
  json_object('text', role, 'chunk_ids', [conv_id::VARCHAR]) AS unquoted,
  json_object('text', '', 'chunk_ids', [conv_id::VARCHAR], 'quote', substr(text, 1, 30)) AS untold FROM conversations),
replies AS (SELECT *, CASE kind WHEN 0 THEN json_object('answer', text, 'claims', [whole])::VARCHAR
  WHEN 1 THEN json_object('claims', [whole])::VARCHAR
  WHEN 2 THEN json_object('answer', text)::VARCHAR
  WHEN 3 THEN json_object('answer', text, 'claims', [unquoted])::VARCHAR
  WHEN 4 THEN json_object('answer', text, 'claims', [untold])::VARCHAR
  WHEN 5 THEN left(json_object('answer', text, 'claims', [whole])::VARCHAR, -1)
  WHEN 6 THEN 'So: ' || text END AS reply FROM parts),
parsed AS (SELECT *, TRY_CAST(reply AS JSON) AS j FROM replies),
judged AS (SELECT *, CASE WHEN reply IS NULL THEN NULL WHEN j IS NULL THEN 'not json'
  WHEN j->>'$.answer' IS NULL THEN 'answer'
  WHEN coalesce(json_type(j, '$.claims'), 'NULL') = 'NULL' THEN 'claims'
  WHEN coalesce(length(j->>'$.claims[0].text'), 0) < 1 THEN 'claim 0: text'
  WHEN coalesce(json_type(j, '$.claims[0].chunk_ids'), 'NULL') = 'NULL' THEN 'claim 0: chunk_ids'
  WHEN j->>'$.claims[0].quote' IS NULL THEN 'claim 0: quote' END AS problem FROM parsed)
SELECT conv_id, turn, problem, CASE WHEN problem IS NULL THEN j->>'$.answer' END AS answer,
  CASE WHEN problem IS NULL THEN json_array_length(j, '$.claims')::BIGINT END AS n_claims,
  CASE WHEN problem IS NULL THEN j->>'$.claims[0].quote' END AS quote FROM judged""",
        "grounded_generation": _with(*GOVERN)
        + f"""SELECT query_id, 'A grounded answer drawn from the filing.' AS answer,
  'From the filing: ' || q AS claim, id1 AS chunk_ids, q AS quote
FROM (SELECT *, {_trim("substr(t1, 1, 30)")} AS q FROM tops)""",
        "sentence_generation": _with(*GOVERN)
        + f"""SELECT query_id, 'Per ' || company1 || ' (' || l1 || '): ' || q AS answer, q AS claim, id1 AS chunk_ids,
  q AS quote
FROM (SELECT *, {_trim("CASE WHEN instr(flat, '. ') > 41 THEN substr(flat, 1, instr(flat, '. ')) ELSE substr(flat, 1, 160) END")}
        AS q FROM (SELECT *, {sentence} AS flat FROM tops))""",
        "citation_resolve": _with(*GOVERN)
        + """SELECT c.query_id, c.claim_no::BIGINT AS claim_no, x.cite_no::BIGINT AS cite_no, c.supported,
  x.chunk_id, x.chunk_found, CASE WHEN x.cite_no IS NOT NULL THEN x.pos > 0 END AS quote_found,
  CASE WHEN x.pos > 0 THEN x.o + x.pos - 1 END AS start_offset,
  CASE WHEN x.pos > 0 THEN x.o + x.pos - 1 + length(x.needle) END AS end_offset, x.section_id
FROM claims c LEFT JOIN cites x ON x.query_id = c.query_id AND x.claim_no = c.claim_no""",
        "citation_precheck": _with(*GOVERN) + "SELECT query_id, passed, unknown, n_claims FROM checks",
        "first_resolvable_citation": _with(*GOVERN)
        + "SELECT query_id, claim_no::BIGINT AS claim_no, chunk_id, start_offset FROM claims",
        "judge_overlap": """SELECT a.conv_id, a.turn, y AS entailed, CASE WHEN y THEN 0.9 ELSE 0.1 END::DOUBLE AS confidence,
  CASE WHEN y THEN 'Evidence shares supporting terms with the claim.'
       ELSE 'Evidence does not appear to support the claim.' END AS rationale
FROM (SELECT a.conv_id, a.turn, len(list_intersect(
        regexp_extract_all(lower(a.text), '[a-z0-9]{4,}'), regexp_extract_all(lower(b.text), '[a-z0-9]{4,}'))) > 0 AS y
      FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1) a""",
        "verify_claims_verdicts": _with(*GOVERN)
        + """SELECT query_id, CASE WHEN passed AND n_claims > 0 AND n_verified = n_claims THEN 'supported'
  ELSE 'unsupported' END AS verdict, CASE WHEN n_grounded > 0 THEN 'scripted-verifier' END AS verifier_id,
  0.0::DOUBLE AS cost_usd, n_verified, n_grounded FROM checks""",
        "refusal_precedence": """SELECT CASE WHEN o_orderstatus = 'P' THEN 'citation_precheck_failed'
  WHEN o_custkey % 3 = 0 THEN 'no_claims' WHEN NOT o_orderpriority < '3' THEN 'unverified_claims' END AS reason,
  count(*) AS n FROM orders GROUP BY reason""",
        "answer_or_refuse": _with(*GOVERN)
        + f"""SELECT query_id::VARCHAR AS request_id,
  '2026-06-12T12:00:00.' || lpad((query_id % 1000)::VARCHAR, 3, '0') || 'Z' AS created_at, b.text AS query,
  CASE WHEN reason IS NULL THEN 'answered' ELSE 'refused' END AS verdict, reason AS refusal_reason,
  CASE WHEN reason IS NULL THEN 'Mixed.' END AS answer,
  CASE WHEN reason IS NULL THEN 'Mixed.' ELSE {_q(REFUSAL_MESSAGE)} END AS message,
  (SELECT string_agg(chunk_id, ',' ORDER BY fused_rank) FROM top8 t WHERE t.query_id = k.query_id) AS retrieved,
  CASE WHEN top_rrf >= 0.02 THEN n_claims END AS n_claims,
  CASE WHEN top_rrf >= 0.02 THEN CASE WHEN passed AND n_claims > 0 AND n_verified = n_claims THEN 'supported'
       ELSE 'unsupported' END END AS verification,
  'fake-hash-v1:256' AS embedder_id, CASE WHEN top_rrf >= 0.02 THEN 'mixed-generator' END AS generation_model,
  CASE WHEN top_rrf >= 0.02 AND n_grounded > 0 THEN 'scripted-verifier' END AS verifier_id,
  0.0::DOUBLE AS cost_usd, 0::BIGINT AS latency_ms
FROM (SELECT *, {_reason("n_verified")} AS reason FROM checks) k JOIN benchmark b ON b.item_id = k.query_id""",
        "eval_summary": _with(*GOVERN)
        + f"""SELECT query_id::VARCHAR AS case_id, CASE WHEN reason IS NULL THEN 'answered' ELSE 'refused' END AS verdict,
  reason AS refusal_reason, reason IS NULL AS answer_present,
  CASE WHEN top_rrf >= 0.02 THEN n_claims ELSE 0 END AS claim_count,
  top_rrf >= 0.02 AND n_claims > 0 AND n_grounded = n_claims AS all_claims_supported,
  top_rrf >= 0.02 AND n_claims > 0 AND n_grounded = n_claims AS citations_resolved,
  CASE WHEN top_rrf >= 0.02 THEN 'unsupported' END AS verification_verdict,
  (SELECT company1 FROM tops t WHERE t.query_id = k.query_id) AS company,
  CASE WHEN reason = 'low_retrieval_score' THEN 'retrieve' ELSE 'retrieve,generate,verify' END AS trace,
  CASE WHEN reason = 'low_retrieval_score' THEN 1 ELSE 3 END::BIGINT AS steps, 0.0::DOUBLE AS cost_usd
FROM (SELECT *, {_reason("0")} AS reason FROM checks) k""",
        "audit_list_page": _with(AUDIT)
        + """SELECT request_id, created_at, query, verdict, cost_usd, latency_ms FROM log
WHERE verdict = 'answered' AND created_at >= '2024-01-02' AND created_at <= '2024-01-20'
  AND contains(lower(query), 'rate 100%_n')
ORDER BY created_at DESC, request_id DESC LIMIT 100 OFFSET 25""",
        "audit_by_request": _with(AUDIT)
        + """SELECT request_id, created_at, query, verdict, refusal_reason, cost_usd FROM log
WHERE request_id = 'req-00000042'""",
        "audit_filter_accession": _with(AUDIT)
        + """SELECT request_id, verdict, CASE WHEN verdict = 'answered' THEN 'Issuer ' || user_id ELSE '—' END AS document
FROM log WHERE user_id IN (7, 8) AND created_at <= '2024-02-01'""",
        "audit_totals": _with(AUDIT)
        + """SELECT count(*) AS total, count(*) FILTER (verdict = 'answered') AS answered,
  count(*) FILTER (verdict <> 'answered') AS refused, round(sum(cost_usd), 6) AS total_cost_usd FROM log""",
        "audit_duplicate_check": """WITH i AS (
  SELECT 'req-' || CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id END AS request_id FROM events)
SELECT request_id FROM i GROUP BY request_id HAVING count(*) > 1
UNION SELECT 'req-' || o_orderkey FROM orders
WHERE 'req-' || o_orderkey IN (SELECT request_id FROM i)""",
        "store_counts": _with(*CORPUS)
        + """SELECT 'filings' AS name, count(*) AS n FROM documents UNION ALL
SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'audit', count(*) FROM events""",
        "filing_list": _with(FILINGS) + "SELECT cik, accession, company, form, filing_date FROM raw",
        "chunks_by_filing": _with(*CORPUS)
        + """SELECT c.accession, company, start_offset, end_offset, chunk_id,
  substr(body, start_offset + 1, end_offset - start_offset) = c.text AS exact
FROM chunks c JOIN clean_texts USING (accession)""",
        "reingest_upsert": """SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer
WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier""",
        "snapshot_texts": _with(*GOVERN)
        + """SELECT accession, body AS canonical_text FROM clean_texts WHERE accession IN (
  SELECT split_part(c.chunk_id, ':', 1) FROM cites c JOIN checks k USING (query_id)
  WHERE c.chunk_found AND k.top_rrf >= 0.02)""",
        "snapshot_audit": _with(AUDIT)
        + """SELECT request_id, created_at, query, verdict, retrieved_json FROM log""",
        "snapshot_roundtrip": _with(FILINGS, _pii("raw", "accession"), CLEAN, AUDIT)
        + """SELECT '2026-06-12T12:00:00.000Z' AS generated_at, 'text' AS part, accession AS id, body AS value
FROM clean_texts UNION ALL SELECT '2026-06-12T12:00:00.000Z', 'audit', request_id, 'Issuer ' || user_id FROM log""",
        "store_reingest": _with(*STORED)
        + """SELECT accession, CASE WHEN n % 6 = 3 THEN 0 WHEN n % 3 = 0 THEN 1
  ELSE (SELECT count(*) FROM chunks c WHERE c.accession = t.accession) END AS n_chunks,
  CASE WHEN n % 6 = 3 THEN 15 WHEN n % 3 = 0 THEN 31 END AS length
FROM (SELECT accession, substr(accession, 1, 10)::BIGINT AS n FROM clean_texts) t
UNION ALL SELECT 'kelp', count(*) FILTER (n % 6 = 0), NULL
FROM (SELECT substr(accession, 1, 10)::BIGINT AS n FROM clean_texts)""",
        "highlight_spans": _with(FILINGS, _pii("raw", "accession"))
        + """SELECT accession, spot AS start, substr(clean, greatest(spot - 160, 0) + 1, spot - greatest(spot - 160, 0)) AS before,
  substr(clean, spot + 1, length(type) + 11) AS match, substr(clean, spot + length(type) + 12, 160) AS after,
  spot - 160 > 0 AS truncated_before, spot + length(type) + 11 + 160 < length(clean) AS truncated_after
FROM pii JOIN redacted USING (accession)""",
        "citation_context": _with(*GOVERN)
        + """SELECT query_id::VARCHAR AS request_id, claim_no::BIGINT AS claim_no, cite_no::BIGINT AS cite_no,
  s AS start_offset, e AS end_offset, accession, company, section_label,
  substr(body, greatest(s - 160, 0) + 1, s - greatest(s - 160, 0)) AS before, substr(body, s + 1, e - s) AS match,
  substr(body, e + 1, 160) AS after, s - 160 > 0 AS truncated_before, e + 160 < length(body) AS truncated_after
FROM (SELECT x.*, t.accession, t.company, t.section_label, x.o + x.pos - 1 AS s,
             x.o + x.pos - 1 + length(needle) AS e
      FROM cites x JOIN top8 t ON t.query_id = x.query_id AND t.chunk_id = x.chunk_id
      JOIN checks k ON k.query_id = x.query_id WHERE x.pos > 0 AND k.top_rrf >= 0.02)
JOIN clean_texts USING (accession, company)""",
        "recent_filings_filter": """SELECT c_custkey, '10-K' AS form,
  lpad(c_custkey::VARCHAR, 10, '0') || '-24-000000' AS accession, '2024-01-15' AS filing_date, 'a.htm' AS primary_document
FROM customer
UNION ALL SELECT c_custkey, '10-Q', lpad(c_custkey::VARCHAR, 10, '0') || '-24-000002', '2024-03-15',
  'd' || c_custkey || '.htm' FROM customer WHERE c_custkey % 3 <> 0""",
        "document_urls": _with(FILINGS)
        + """SELECT accession, 'https://www.sec.gov/Archives/edgar/data/' || cik::BIGINT || '/' || replace(accession, '-', '')
  || '/main.htm' AS url, 'https://data.sec.gov/submissions/CIK' || cik || '.json' AS listing FROM raw""",
    }
