"""DuckDB SQL twins, written from the contracts and not from the Spark expressions."""

from __future__ import annotations

from gridloom.llm import secret_scan
from gridloom.llm.quality_rules import RULES, STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _rule(rule) -> str:
    upper = "" if rule.most is None else f" OR 100 * {rule.part} > {rule.most} * {rule.whole}"
    return f"NOT (n_words >= {rule.from_words} AND (100 * {rule.part} < {rule.least} * {rule.whole}{upper}))"


QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT r, unnest(range(1, len(w) - 3)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) AS five
  FROM d WHERE len(w) >= 5),
twice AS (SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, five) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(pos, pos + 5)) AS p FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g'))::BIGINT AS n_capitals,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(_rule(r) for r in RULES)} AS kept
FROM b"""


def _secret_spans(rank: int, rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: {{
      'start': (coalesce(list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i - 1], lambda x: length(x))), 0))::BIGINT,
      'rank': {rank}, 'kind': '{rule.kind}', 'size': length(regexp_extract_all(t, '{pattern}')[i]),
      'checked': length(regexp_extract_all(t, '{pattern}', {rule.group})[i])}}), lambda s: s.checked >= {rule.least})"""


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id, list_sort(list_concat({", ".join(_secret_spans(k, r) for k, r in enumerate(secret_scan.RULES))})) AS s
  FROM d),
shown AS (
  SELECT doc_id, s, list_transform(s, lambda x: x.kind || ':' || x.start || ':' || (x.start + x.size)) AS spans,
    list_transform(list_filter(s, lambda x: x.kind IN ('assign', 'access', 'hex')), lambda x: x.kind || ':' || x.start || ':' || (x.start + x.size)) AS base
  FROM found)
SELECT doc_id, len(list_filter(s, lambda x: x.kind = 'assign'))::BIGINT AS n_assign,
  len(list_filter(s, lambda x: x.kind = 'access'))::BIGINT AS n_access, len(list_filter(s, lambda x: x.kind = 'hex'))::BIGINT AS n_hex,
  sha256(array_to_string(base, ',')) AS base_sha256, array_to_string(spans, ',') AS spans
FROM shown"""


VECTORS = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
sound AS (
  SELECT r, e, sqrt(list_sum([x * x FOR x IN e])) AS n FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
unit AS (SELECT r, [x / n FOR x IN e] AS u FROM sound),
links AS (SELECT a.r AS x, b.r AS y FROM unit a JOIN unit b ON a.r <> b.r AND len(a.u) = len(b.u) AND list_dot_product(a.u, b.u) >= 0.9),
reach(r, low) AS (SELECT r, vec_id FROM v UNION SELECT y, low FROM reach JOIN links ON x = r),
lowest AS (SELECT r, min(low) AS low FROM reach GROUP BY r),
degrees AS (SELECT x AS r, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, low AS component_id, coalesce(vec_id = low, false) AS kept
FROM v JOIN lowest USING (r) LEFT JOIN degrees USING (r)"""

SHINGLES = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
u AS (SELECT r, len(sh) AS n, unnest(sh) AS g FROM s),
meet AS (SELECT a.r AS x, b.r AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT x, y FROM meet WHERE 100 * c >= 85 * (na + nb - c)),
reach(r, low) AS (SELECT r, doc_id FROM s UNION SELECT y, low FROM reach JOIN links ON x = r),
lowest AS (SELECT r, min(low) AS low FROM reach GROUP BY r)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, low AS component_id, coalesce(doc_id = low, false) AS kept
FROM s JOIN lowest USING (r)"""


EQUAL_TEXTS = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS chars,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER best = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW best AS (PARTITION BY t ORDER BY chars DESC, doc_id ASC NULLS LAST, r)"""

#: The entry of a CRC-32 table for one byte, by its rule: eight steps of a shift that the reflected polynomial joins on a set bit.
_CRC_STEPS = "list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)"

DRAWN = rf"""
WITH crc AS (SELECT list({_CRC_STEPS} ORDER BY b) AS steps FROM (SELECT unnest(range(256)) AS b)),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT side, r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT side, r, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))],
    [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) AS f FROM words),
kinds AS (SELECT side, r, f, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM kinds)),
buckets AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, [('0x' || h[2 * i + 1:2 * i + 2])::BIGINT FOR i IN range(len(h) // 2)]),
    lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM bytes, crc),
found AS (SELECT side, r, bucket, sum(n)::BIGINT AS n FROM kinds JOIN buckets USING (f) GROUP BY ALL),
counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM found GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000))))::BIGINT AS gain
  FROM counts),
weights AS (SELECT r, sum(n * gain)::BIGINT AS weight, sum(n)::BIGINT AS n_features FROM found JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (r) WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id ASC NULLS LAST) AS place, count(*) OVER (PARTITION BY able) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * n // 100 THEN place END AS rank FROM placed"""

RANKED = r"""
WITH texts AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark),
terms AS (
  SELECT side, r, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM texts),
total AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM terms WHERE side = 'd'),
asked AS (SELECT r AS q, id AS item_id, unnest(list_distinct(w)) AS term FROM terms WHERE side = 'b'),
spread AS (SELECT r, id AS doc_id, len(w) AS n, unnest(w) AS term FROM terms WHERE side = 'd'),
postings AS (SELECT r, doc_id, n, term, count(*) AS tf FROM spread WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), total),
scores AS (
  SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), total GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS place FROM scores WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM placed WHERE place <= 50"""
