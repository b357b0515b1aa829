"""DuckDB SQL for the queries of this package that SQL can express, over the driver's views."""

from __future__ import annotations


def crc32_table() -> list[int]:
    """The 256 steps of CRC-32 (polynomial 0xEDB88320), a byte at a time."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def crc32_sql(blob: str) -> str:
    """An expression for the unsigned CRC-32 of a BLOB expression."""
    table = "([" + ",".join(map(str, crc32_table())) + "]::BIGINT[])"
    octets = f"list_transform(range(octet_length({blob})), lambda i: ('0x' || substr(hex({blob}), 2 * i::INT + 1, 2))::BIGINT)"
    step = f"lambda c, b: xor({table}[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), {step}), 4294967295::BIGINT)"


SHARDS = f"""
WITH rows AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, encode(coalesce(text, '')) AS body FROM documents),
placed AS (
  SELECT doc_id, size, body,
         CAST(sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start,
         CAST(sum(size) OVER () AS BIGINT) AS total
  FROM rows),
cut AS (SELECT doc_id, size, body, CAST((16 * (2 * start + size)) // (2 * total) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, {crc32_sql("body")} AS text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut"""

#: Words of a text after folding A-Z alone.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {FOLDED_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, array_to_string(w[i + 1 : i + 10], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {FOLDED_WORDS} AS w FROM documents),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item, i, n FROM spots JOIN windows USING (win, n)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""

#: Words of a text, cut at ASCII white space.
WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

QUALITY = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (SELECT doc_id, i, w[i + 1 : i + 3] AS win FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM docs WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY doc_id),
base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) AS n_upper
  FROM docs LEFT JOIN again USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words
            OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines OR 2 * n_upper > n_words) AS kept
FROM base"""

LINE_DEDUP = """
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, l, unnest(range(len(l))) AS no FROM cut),
lines AS (
  SELECT doc_id, no, doc_id * 1000000 + no AS pos, l[no + 1] AS line, regexp_extract_all(l[no + 1], '[^\\x20\\x09-\\x0D]+') AS w
  FROM numbered),
firsts AS (SELECT w, len(w) AS n, min(pos) AS first FROM lines WHERE len(w) > 0 GROUP BY w),
lacking AS (
  SELECT first, n, i, list_concat(w[1 : i], w[i + 2 :]) AS rest
  FROM (SELECT first, n, w, unnest(range(n)) AS i FROM firsts WHERE n >= 8)),
gone AS (
  SELECT pos FROM lines JOIN firsts USING (w) WHERE pos > first
  UNION SELECT first FROM (SELECT first, min(first) OVER (PARTITION BY n, i, rest) AS other FROM lacking) WHERE other < first
  UNION SELECT greatest(a.first, b.first) FROM lacking a JOIN firsts b ON a.rest = b.w AND b.n >= 8),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone.pos IS NOT NULL) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE gone.pos IS NULL), '') AS text
  FROM lines LEFT JOIN gone USING (pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, k.text
FROM documents d LEFT JOIN kept k USING (doc_id)"""
