"""Pages read by the collector: their elements, what they declare, and the feature channel over all of it."""

from __future__ import annotations

from weftline.operators import collector, features
from weftline.plans import mapping, similarity  # noqa: F401  their views
from weftline.plans.views import FRAME, SHARED

# SQL finds the same by expressions, as all pages of the tables quote their classes doubly and have no inline style
FRAME("page_elements", lambda s, d, cards: collector.page_elements(cards), "SELECT * FROM {nodes}", "cards")
FRAME("page_collected", lambda s, d, rows: collector.collected(rows), r"""SELECT n.*, coalesce(m.n_classes, 0) AS n_classes, m.n_inline, m.n_role, m.n_alt, m.n_aria, m.n_data, m.style_chars, m.script_chars FROM
  (SELECT batch, config, config_ord, slot, count(*) AS n, count(DISTINCT tag) AS n_tags, max(depth) AS max_depth, CAST(sum(depth) AS BIGINT) AS sum_depth FROM {nodes} GROUP BY ALL) n JOIN
  (SELECT slot, CAST(list_sum([len(regexp_extract_all(x, '\S+')) for x in regexp_extract_all(html, '\bclass="([^"]*)"', 1)]) AS BIGINT) AS n_classes, len(regexp_extract_all(tags, '\sstyle=')) AS n_inline,
    len(regexp_extract_all(tags, '\srole\b')) AS n_role, len(regexp_extract_all(tags, '\salt\b')) AS n_alt, len(regexp_extract_all(tags, '\saria-')) AS n_aria, len(regexp_extract_all(tags, '\sdata-')) AS n_data,
    coalesce(CAST(list_sum([length(x) for x in regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style>', 1)]) AS BIGINT), 0) AS style_chars,
    coalesce(CAST(list_sum([length(x) for x in regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script>', 1)]) AS BIGINT), 0) AS script_chars
    FROM (SELECT *, array_to_string(regexp_extract_all(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'), '<[a-zA-Z][^<>]*>'), '') AS tags FROM cards)) m ON n.slot = m.slot""", "page_elements")
FRAME("source_features", lambda s, d, rows: collector.feature_rows(rows, similarity._API), "SELECT * FROM {feature_set}", "page_elements")
FRAME("source_feature_pairs", lambda s, d, cards, rows: features.jaccard_pairs(features.token_sets(rows, cards)), "SELECT * FROM {feature_jaccard_pairs}", "cards source_features")
SHARED |= {"page_elements"}

ROWS_ONLY = ["page_elements"]
QUERIES = "page_collected source_features source_feature_pairs".split()
