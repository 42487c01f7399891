"""Where queries and their SQL are listed."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def longs(sql: str, columns: str) -> str:
    """The SQL with these columns as BIGINT, the type that Spark's side has."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in columns.split())}) FROM ({sql})"


# Common tables of the oracles.
EVENTS = """e AS (SELECT user_id, ts, event_id, event_type, value, CASE event_type WHEN 'view' THEN 'B' WHEN 'purchase' THEN 'E' WHEN 'signup' THEN 'D' WHEN 'click' THEN 'T' ELSE 'X' END AS kind FROM events)"""
DOCUMENTS = """d AS (SELECT *, source || '/' || CAST(doc_id // 20000 AS VARCHAR) AS file_id FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY doc_id) AS page_pos, length(text) AS n FROM d),
len AS (SELECT *, (SELECT coalesce(sum(9 + least(25000, n - i) + 2 * ((least(25000, n - i) + 249) // 250)), 0) FROM range(0, n, 25000) AS r(i)) + (CASE WHEN n > 0 THEN 2 ELSE 0 END) AS text_bytes FROM p),
pl AS (SELECT *, 9 + (9 + 4 + 5 + 4 + length(CAST(doc_id AS VARCHAR))) + (9 + 4 + 4 + 4 + length(lang)) + 9 + text_bytes + 9 + 9 AS page_len FROM len),
pg AS (SELECT *, 17 + coalesce(sum(page_len) OVER (PARTITION BY file_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byte_offset FROM pl)"""
_TEXT = r"""array_to_string([y FOR y IN [regexp_replace(substr(text, i, 250), '[\x00-\x1F\x7F-\x9F]', '', 'g') FOR i IN range(1, length(text) + 1, 250)] IF trim(y) <> ''], ' ')"""
PAGE_TEXTS = f"""{DOCUMENTS}, t AS (SELECT file_id, page_pos, doc_id, lang, {_TEXT} AS text FROM pg)"""

_CP037 = bytes(range(256)).decode("cp037")
#: Bytes of the code page by code point, in hex; its 256 characters are the first 256 code points.
_BYTE = ", ".join(f"'{_CP037.index(chr(i)):02X}'" for i in range(256))


def _ebcdic(text: str) -> str:
    """SQL for a text's bytes in the default code page, in hex."""
    return f"array_to_string(list_transform(string_split_regex({text}, ''), lambda c: CASE WHEN c = '' THEN '' WHEN unicode(c) < 256 THEN ([{_BYTE}])[unicode(c) + 1] ELSE '3F' END), '')"


def _tag(key: str, value: str) -> str:
    k = "".join(f"{_CP037.index(c):02X}" for c in key)
    v = _ebcdic(value)
    return f"'5A' || printf('%04X', {8 + 4 + len(key) + 4} + length({value})) || 'D3A090000000' || '{len(key) + 4:02X}020B00{k}' || printf('%02X', length({value}) + 4) || '360000' || {v}"


# h: pages as they lie in the files, in hex (text fields of 100 controls of 250 bytes); fh: files, with what is before and behind their pages.
PAGE_BYTES = f"""{DOCUMENTS}, enc AS MATERIALIZED (SELECT *, {_ebcdic('text')} AS x FROM pg),
h AS MATERIALIZED (SELECT file_id, source, doc_id, page_pos, page_len, '5A0008D3A8AD000000' || {_tag('DOCID', 'CAST(doc_id AS VARCHAR)')} || {_tag('LANG', 'lang')} || '5A0008D3A89B000000' || array_to_string([
  '5A' || printf('%04X', CAST(8 + (CASE WHEN j = 0 THEN 2 ELSE 0 END) + least(25000, n - j) + 2 * ((least(25000, n - j) + 249) // 250) AS INTEGER)) || 'D3EE9B000000' || (CASE WHEN j = 0 THEN '2BD3' ELSE '' END) ||
  array_to_string([printf('%02X', CAST(least(250, n - i) + 2 AS INTEGER)) || 'DB' || substr(x, CAST(2 * i + 1 AS BIGINT), 500) FOR i IN range(j, least(j + 25000, n), 250)], '') FOR j IN range(0, n, 25000)], '') || '5A0008D3A99B0000005A0008D3A9AD000000' AS hex FROM enc),
fh AS MATERIALIZED (SELECT file_id, '5A0010D3A8A8000000' || any_value({_ebcdic("substr(upper(source) || '        ', 1, 8)")}) AS head, string_agg(hex, '' ORDER BY page_pos) AS mid, '5A0008D3A9A8000000' AS foot, count(*) AS pages FROM h GROUP BY file_id)"""
