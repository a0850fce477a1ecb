"""DuckDB texts of the queries whose rows SQL can give."""

from __future__ import annotations

#: The CRC-32 (polynomial 0xEDB88320) of the bits 0 to 7 of a byte, by which those of all bytes follow.
_CRC_BITS = (0x77073096, 0xEE0E612C, 0x076DC419, 0x0EDB8832, 0x1DB71064, 0x3B6E20C8, 0x76DC4190, 0xEDB88320)


def crc32(text: str) -> str:
    """The CRC-32 of a string expression's UTF-8 bytes, a byte at a time."""
    x = "(xor(c, b) & 255)"
    step = "c >> 8"
    for k, value in enumerate(_CRC_BITS):
        step = f"xor({step}, (({x} >> {k}) & 1) * {value}::BIGINT)"
    bytes_ = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex(encode({text})), (2 * i - 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: {step}), 4294967295::BIGINT)"


OP11 = f"""
WITH texts AS (
  SELECT 0 AS side, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
worded AS (
  SELECT side, doc_id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
features AS (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM worded),
buckets AS (SELECT f, {crc32("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM features)),
counted AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM features JOIN buckets USING (f) GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counted),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM counted, totals),
weights AS (
  SELECT r, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM features JOIN buckets USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT doc_id, r, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM worded LEFT JOIN weights USING (r) WHERE side = 0),
able AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN able USING (r)
"""

OP12 = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS place,
         sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS mark, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n, {crc32("conv_id::VARCHAR")} % 9 AS h, conv_id - conv_id % 5 AS b FROM turns GROUP BY conv_id),
plans AS (SELECT s.*, CASE WHEN s.b = s.conv_id THEN 0 ELSE least(s.h, coalesce(o.n, 0)) END AS lent, CASE WHEN s.b = s.conv_id THEN 0 ELSE s.h END AS cut FROM sizes s LEFT JOIN sizes o ON o.conv_id = s.b),
built AS (
  SELECT conv_id, place - cut + lent AS d, mark, bytes FROM turns JOIN plans USING (conv_id) WHERE place > cut
  UNION ALL SELECT p.conv_id, place, mark, bytes FROM plans p JOIN turns t ON t.conv_id = p.b WHERE place <= lent),
steps AS (
  SELECT conv_id, d, sha256(string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k, bytes FROM built
  UNION ALL SELECT conv_id, 0, 'root', 0 FROM plans),
linked AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS above, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM steps),
nodes AS (
  SELECT k, any_value(d) AS depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM linked GROUP BY k),
children AS (SELECT above AS k, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
sums AS (
  SELECT l.k, sum(n.saved) AS saved_tokens, count(*) FILTER (c.k IS NULL) AS n_leaves
  FROM nodes n JOIN linked l ON l.conv_id = n.conv_id AND l.d <= n.depth LEFT JOIN children c ON c.k = n.k GROUP BY l.k)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (k) LEFT JOIN children USING (k) LEFT JOIN nodes p ON p.k = n.above
"""
