"""Similarity channels over cards and texts."""

from __future__ import annotations

from weftline.operators import features
from weftline.plans import mapping
from weftline.plans.views import FRAME, VIEW

FRAME("cards", mapping.cards, mapping.CARDS_SQL.split(" AS (", 1)[1][:-1])
FRAME("texts", mapping.texts, mapping.TEXTS_SQL.split(" AS (", 1)[1][:-1])

# pairs: all of one configuration, and those of two in order
VIEW("slot_pairs", """SELECT a.batch, a.config AS config_a, b.config AS config_b, a.slot AS slot_a, b.slot AS slot_b,
  CASE WHEN a.config = b.config THEN 'self' ELSE 'cross' END AS kind
  FROM {cards} a JOIN {cards} b ON a.batch = b.batch AND (a.config_ord < b.config_ord OR a.config_ord = b.config_ord AND a.slot < b.slot)""")
VIEW("pair_counts", "SELECT batch, config_a, config_b, kind, count(*) AS n_pairs FROM {slot_pairs} GROUP BY batch, config_a, config_b, kind")
VIEW("slot_counts", "SELECT batch, config, count(*) AS m FROM {cards} GROUP BY batch, config")
VIEW("pair_completeness", """SELECT coalesce(g.batch, e.batch) AS batch, coalesce(g.config_a, e.config_a) AS config_a, coalesce(g.config_b, e.config_b) AS config_b,
  e.n AS expected, g.n_pairs AS got, coalesce(g.n_pairs = e.n, false) AS complete
  FROM (SELECT a.batch, a.config AS config_a, b.config AS config_b, CASE WHEN a.config = b.config THEN CAST(a.m * (a.m - 1) / 2 AS BIGINT) ELSE a.m * b.m END AS n
        FROM {slot_counts} a JOIN {slot_counts} b ON a.batch = b.batch AND a.config <= b.config WHERE a.config < b.config OR a.m > 1) e
  FULL OUTER JOIN {pair_counts} g ON e.batch = g.batch AND e.config_a = g.config_a AND e.config_b = g.config_b""")

_DUCK_NORMAL = r"""trim(regexp_replace(lower(regexp_replace(html, '(?s)<!--.*?(?:-->|\z)|(:?)/\*.*?(?:\*/|\z)|(:/)|//[^\n]*', '\1\2', 'g')), '[ \t\n\r\f\x0B]+', ' ', 'g'))"""
VIEW("shingles", "", duck=f"""SELECT DISTINCT batch, config, config_ord, slot, substr(t, CAST(i AS BIGINT), 5) AS token
  FROM (SELECT *, unnest(range(1, length(t) - 3)) AS i FROM (SELECT *, {_DUCK_NORMAL} AS t FROM {{cards}}) WHERE length(t) >= 5)""")
_LEX = features.LEXER.replace("'", "''")
VIEW("winnow", "", duck=f"""SELECT DISTINCT batch, config, config_ord, slot, unnest(list_transform(range(1, len(h) - least(4, len(h)) + 2), lambda i: list_min(h[i:i + least(4, len(h)) - 1]))) AS token
  FROM (SELECT *, list_transform(range(1, len(t) - 3), lambda i: substr(sha256(array_to_string(t[i:i + 4], chr(10))), 1, 16)) AS h
    FROM (SELECT batch, config, config_ord, slot, list_transform(regexp_extract_all(html, '{_LEX}'), lambda x: CASE WHEN length(x) > 1 AND regexp_full_match(x, '(?s)".*"|''.*''') THEN 'STR'
      WHEN regexp_matches(x, '^\\.?\\d') THEN 'NUM' WHEN regexp_matches(x, '^\\.[A-Za-z_-]') THEN 'CLS' WHEN regexp_matches(x, '^[A-Za-z_]') THEN 'ID' ELSE x END) AS t FROM {{cards}}) WHERE len(t) >= 5)""")
_VOID = ", ".join(f"'{x}'" for x in features.VOID)
FRAME("tags", lambda s, d, cards: features.tag_tokens(cards), f"""SELECT batch, config, config_ord, slot, CAST(pos AS INT) AS pos, tag, closing, tag IN ({_VOID}) AS void FROM
  (SELECT *, lower(regexp_replace(raw, '^</?', '')) AS tag, starts_with(raw, '</') AS closing FROM
    (SELECT batch, config, config_ord, slot, unnest(x) AS raw, unnest(range(0, len(x))) AS pos FROM
      (SELECT *, regexp_extract_all(regexp_replace(html, '(?is)(<script\\b[^>]*>).*?(</script>)|(<style\\b[^>]*>).*?(</style>)|<!--.*?-->', '\\1\\2\\3\\4', 'g'), '</?[a-zA-Z][a-zA-Z0-9]*') AS x FROM cards)))""", "cards")
FRAME("nodes", lambda s, d, cards: features.dom_nodes(cards), """SELECT n.batch, n.config, n.config_ord, n.slot, n.pos, n.tag, n.depth, n.void,
  (SELECT max(u.pos) FROM levels u WHERE u.slot = n.slot AND u.depth = n.depth - 1 AND u.pos < n.pos AND NOT u.void) AS parent FROM {levels} n""", "cards")
VIEW("levels", """SELECT * FROM (SELECT *, 1 + coalesce(CAST(sum(CASE WHEN void THEN 0 WHEN closing THEN -1 ELSE 1 END)
  OVER (PARTITION BY slot ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS depth FROM {tags}) WHERE NOT closing""")


def values(view: str, columns: list[tuple[str, str]], where: str = "value <> 0") -> str:
    """Rows ``token, value`` of ``(token, expression)`` over a view of one row a slot, read once."""
    each = ", ".join(f"'{t}', CAST({e} AS DOUBLE)" for t, e in columns)
    return f"SELECT * FROM (SELECT batch, config, config_ord, slot, stack({len(columns)}, {each}) AS (token, value) FROM {{{view}}}) x WHERE {where}"


def jaccard(name: str, features_view: str, frame) -> None:
    """Exact set similarity of all pairs: intersections of one array a slot in Spark (``frame`` gives them from cards), an
    inverted index in the oracle; null where a side has no feature."""
    FRAME(f"{features_view}_sets", frame, f"SELECT batch, config, config_ord, slot, list(token) AS tokens FROM {{{features_view}}} GROUP BY ALL", "cards" if features_view in ("shingles", "winnow") else f"cards {features_view}")
    VIEW(f"{name}_sizes", f"SELECT slot, count(*) AS n FROM {{{features_view}}} GROUP BY slot")
    VIEW(f"{name}_shared", f"""SELECT a.slot AS slot_a, b.slot AS slot_b, count(*) AS shared FROM {{{features_view}}} a JOIN {{{features_view}}} b
      ON a.batch = b.batch AND a.token = b.token AND (a.config_ord < b.config_ord OR a.config_ord = b.config_ord AND a.slot < b.slot) GROUP BY a.slot, b.slot""")
    FRAME(name, lambda s, d, sets: features.jaccard_pairs(sets), f"""SELECT p.batch, p.config_a, p.config_b, p.kind, p.slot_a, p.slot_b, coalesce(s.shared, 0) AS shared, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b,
      CASE WHEN a.n > 0 AND b.n > 0 THEN coalesce(s.shared, 0) / (a.n + b.n - coalesce(s.shared, 0)) END AS s
      FROM {{slot_pairs}} p LEFT JOIN {{{name}_sizes}} a ON p.slot_a = a.slot LEFT JOIN {{{name}_sizes}} b ON p.slot_b = b.slot
      LEFT JOIN {{{name}_shared}} s ON p.slot_a = s.slot_a AND p.slot_b = s.slot_b""", f"{features_view}_sets")


def cosine(name: str, vectors: str) -> None:
    """Sparse cosine of ``slot, key, value`` rows, equal vectors exactly 1, clamped to [0, 1]; null for an empty side."""
    VIEW(f"{name}_norms", f"SELECT slot, sum(value * value) AS q, count(*) AS n FROM {{{vectors}}} WHERE value <> 0 GROUP BY slot")
    VIEW(f"{name}_dots", f"""SELECT a.slot AS slot_a, b.slot AS slot_b, sum(a.value * b.value) AS dot, sum(CASE WHEN a.value = b.value THEN 1 ELSE 0 END) AS same FROM {{{vectors}}} a JOIN {{{vectors}}} b
      ON a.batch = b.batch AND a.token = b.token AND (a.config_ord < b.config_ord OR a.config_ord = b.config_ord AND a.slot < b.slot) WHERE a.value <> 0 AND b.value <> 0 GROUP BY a.slot, b.slot""")
    VIEW(f"{name}_raw", "", duck=f"""SELECT p.batch, p.config_a, p.config_b, p.kind, p.slot_a, p.slot_b,
      CASE WHEN a.n IS NULL OR b.n IS NULL THEN NULL WHEN d.same = a.n AND d.same = b.n THEN CAST(1 AS DOUBLE)
        ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), coalesce(d.dot, CAST(0 AS DOUBLE)) / sqrt(a.q * b.q))) END AS s
      FROM {{slot_pairs}} p LEFT JOIN {{{name}_norms}} a ON p.slot_a = a.slot LEFT JOIN {{{name}_norms}} b ON p.slot_b = b.slot
      LEFT JOIN {{{name}_dots}} d ON p.slot_a = d.slot_a AND p.slot_b = d.slot_b""")
    FRAME(name, lambda s, d, cards, rows: features.cosine_pairs(cards, rows, digits=6), f"SELECT * REPLACE (round(s, 6) AS s) FROM {{{name}_raw}}", f"cards {vectors}")


jaccard("shingle_jaccard_pairs", "shingles", lambda s, d, cards: features.char_shingles(cards))
jaccard("winnow_jaccard_pairs", "winnow", lambda s, d, cards: features.winnowed(cards))

# feature sets of tags, classes, style properties (in braces) and script words
#: The words of scripts that count.
JS_API = """AbortController Array Date IntersectionObserver JSON Map Math MutationObserver Number Object Promise Set URL URLSearchParams WebSocket XMLHttpRequest addEventListener appendChild async
 await cancelAnimationFrame classList clearInterval clearTimeout console createElement dataset document fetch getAttribute getContext getElementById getElementsByClassName getElementsByTagName
 innerHTML insertAdjacentHTML localStorage matchMedia navigator querySelector querySelectorAll removeChild removeEventListener requestAnimationFrame sessionStorage setAttribute setInterval
 setTimeout textContent then window""".split()
_API = rf"\b({'|'.join(JS_API)})\b"
_PROPERTY = r"^\s*(-{0,2}[A-Za-z_][A-Za-z0-9_-]*)\s*:"
FRAME("feature_set", lambda s, d, cards, nodes: _feature_set(cards, nodes), r"""SELECT DISTINCT batch, config, config_ord, slot, 'tag:' || tag AS token FROM nodes
  UNION SELECT DISTINCT batch, config, config_ord, slot, 'class:' || c FROM (SELECT *, unnest(string_split_regex(v, '\s+')) AS c FROM
    (SELECT *, unnest(regexp_extract_all(html, '\bclass\s*=\s*"([^"]*)"', 1)) AS v FROM cards)) WHERE c <> ''
  UNION SELECT DISTINCT batch, config, config_ord, slot, 'css:' || lower(p) FROM (SELECT *, regexp_extract(d, 'PROPERTY', 1) AS p FROM (SELECT *, unnest(regexp_extract_all(v, '[^{};]*[;}]')) AS d FROM
    (SELECT *, unnest(regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style>', 1)) AS v FROM cards))) WHERE p <> ''
  UNION SELECT DISTINCT batch, config, config_ord, slot, 'jsapi:' || w FROM (SELECT *, unnest(regexp_extract_all(v, 'API', 1)) AS w FROM
    (SELECT *, unnest(regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script>', 1)) AS v FROM cards))""".replace("PROPERTY", _PROPERTY).replace("API", _API), "cards nodes")


def _feature_set(cards, nodes):
    from pyspark.sql import functions as F

    key = features.KEY
    found = lambda text, pattern, group=1: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    named = lambda prefix, tokens: F.transform(tokens, lambda x: F.concat(F.lit(prefix), x))
    inside = lambda tokens, pattern, group=1: F.flatten(F.transform(tokens, lambda x: found(x, pattern, group)))
    classes = F.filter(F.flatten(F.transform(found("html", r'\bclass\s*=\s*"([^"]*)"'), lambda x: F.split(x, r"\s+"))), lambda x: x != "")
    declared = inside(found("html", r"(?is)<style\b[^>]*>(.*?)</style>"), r"[^{};]*[;}]", 0)
    styles = F.filter(F.transform(declared, lambda x: F.lower(F.regexp_extract(x, _PROPERTY, 1))), lambda x: x != "")
    api = inside(found("html", r"(?is)<script\b[^>]*>(.*?)</script>"), _API)
    tags = nodes.select(*key, F.concat(F.lit("tag:"), "tag").alias("token"))
    tokens = F.concat(named("class:", classes), named("css:", styles), named("jsapi:", api))
    return tags.union(cards.select(*key, F.explode(tokens).alias("token"))).distinct()


jaccard("feature_jaccard_pairs", "feature_set", lambda s, d, cards, rows: features.token_sets(rows, cards))

# root-to-leaf paths
VIEW("inner_nodes", "SELECT DISTINCT slot, parent AS pos FROM {nodes} WHERE parent IS NOT NULL")
FRAME("tag_paths", lambda s, d, nodes: features.tag_paths(nodes), """WITH RECURSIVE paths AS (SELECT batch, config, config_ord, slot, pos, tag AS path FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.batch, n.config, n.config_ord, n.slot, n.pos, p.path || '>' || n.tag FROM nodes n JOIN paths p ON n.slot = p.slot AND n.parent = p.pos)
  SELECT DISTINCT p.batch, p.config, p.config_ord, p.slot, p.path AS token FROM paths p WHERE NOT EXISTS (SELECT 1 FROM {inner_nodes} i WHERE p.slot = i.slot AND p.pos = i.pos)""", "nodes")
jaccard("tagpath_jaccard_pairs", "tag_paths", lambda s, d, cards, rows: features.token_sets(rows, cards))

# pq-grams (p = 2, q = 3) as multisets and their Dice similarity; Spark lists a page's elements, and a batch makes its grams of them
VIEW("siblings", """SELECT n.*, coalesce(p.tag, '*') AS up, coalesce(lag(n.tag, 2) OVER w, '*') AS t1, coalesce(lag(n.tag, 1) OVER w, '*') AS t2,
  lead(n.tag, 1) OVER w IS NULL AS last_one FROM {nodes} n LEFT JOIN {nodes} p ON n.slot = p.slot AND n.parent = p.pos WINDOW w AS (PARTITION BY n.slot, n.parent ORDER BY n.pos)""")
VIEW("grandparents", "SELECT s.*, coalesce(g.up, '*') AS upper FROM {siblings} s LEFT JOIN {siblings} g ON s.slot = g.slot AND s.parent = g.pos")
FRAME("pq_grams", lambda s, d, nodes: features.elements(nodes), """SELECT batch, config, config_ord, slot, gram AS token, count(*) AS n FROM (
  SELECT batch, config, config_ord, slot, upper || '|' || up || '|' || t1 || '|' || t2 || '|' || tag AS gram FROM {grandparents} WHERE parent IS NOT NULL
  UNION ALL SELECT batch, config, config_ord, slot, upper || '|' || up || '|' || t2 || '|' || tag || '|*' FROM {grandparents} WHERE parent IS NOT NULL AND last_one
  UNION ALL SELECT batch, config, config_ord, slot, upper || '|' || up || '|' || tag || '|*|*' FROM {grandparents} WHERE parent IS NOT NULL AND last_one
  UNION ALL SELECT s.batch, s.config, s.config_ord, s.slot, s.up || '|' || s.tag || '|*|*|*' FROM {siblings} s LEFT JOIN {inner_nodes} i ON s.slot = i.slot AND s.pos = i.pos WHERE i.pos IS NULL) x
  GROUP BY batch, config, config_ord, slot, gram""", "nodes")
VIEW("pq_sizes", "SELECT slot, CAST(sum(n) AS BIGINT) AS n FROM {pq_grams} GROUP BY slot")
FRAME("pqgram_dice_pairs", lambda s, d, cards, listed: features.dice_pairs(cards, listed), """SELECT p.batch, p.config_a, p.config_b, p.kind, p.slot_a, p.slot_b, coalesce(s.shared, 0) AS shared,
  CASE WHEN a.n > 0 AND b.n > 0 THEN 2 * coalesce(s.shared, 0) / (a.n + b.n) END AS s FROM {slot_pairs} p LEFT JOIN {pq_sizes} a ON p.slot_a = a.slot LEFT JOIN {pq_sizes} b ON p.slot_b = b.slot
  LEFT JOIN (SELECT a.slot AS slot_a, b.slot AS slot_b, CAST(sum(least(a.n, b.n)) AS BIGINT) AS shared FROM {pq_grams} a JOIN {pq_grams} b ON a.batch = b.batch AND a.token = b.token
    AND (a.config_ord < b.config_ord OR a.config_ord = b.config_ord AND a.slot < b.slot) GROUP BY a.slot, b.slot) s ON p.slot_a = s.slot_a AND p.slot_b = s.slot_b""", "cards pq_grams")

# sparse vectors of the extended channels
#: Elements with a meaning of their own.
_SEMANTIC = "header nav main section article aside footer figure figcaption h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th button label time address mark details summary fieldset legend output progress meter".split()
_SEM = ", ".join(f"'{x}'" for x in _SEMANTIC)
VIEW("semantics_wide", f"""SELECT batch, config, config_ord, slot, count(*) AS n, sum(CASE WHEN tag IN ({_SEM}) THEN 1 ELSE 0 END) / count(*) AS sem_ratio,
  sum(CASE WHEN tag = 'div' THEN 1 ELSE 0 END) / count(*) AS div_ratio, sum(CASE WHEN tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') THEN 1 ELSE 0 END) / count(*) AS heading_ratio,
  sum(CASE WHEN tag IN ('ul', 'ol', 'li') THEN 1 ELSE 0 END) / count(*) AS list_ratio, max(depth) / 25 AS max_depth, sum(depth) / count(*) / 15 AS mean_depth, count(DISTINCT tag) / 40 AS distinct_tags
  FROM {{nodes}} GROUP BY batch, config, config_ord, slot""")
_SEM_COLUMNS = ["sem_ratio", "div_ratio", "heading_ratio", "list_ratio", "max_depth", "mean_depth", "distinct_tags"]
VIEW("semantics", values("semantics_wide", [(c, c) for c in _SEM_COLUMNS]), " UNION ALL ".join(f"SELECT batch, config, config_ord, slot, '{c}' AS token, CAST({c} AS DOUBLE) AS value FROM {{semantics_wide}} WHERE {c} <> 0" for c in _SEM_COLUMNS))
cosine("semantics_cosine_pairs", "semantics")

FRAME("css_text", lambda s, d, cards: _css_text(cards), r"""SELECT batch, config, config_ord, slot, array_to_string(regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style>', 1), chr(10)) AS css FROM cards""", "cards")
FRAME("css_values", lambda s, d, css: _css_counts(css), r"""SELECT batch, config, config_ord, slot, token, CAST(count(*) AS DOUBLE) AS value FROM (
  SELECT batch, config, config_ord, slot, 'prop:' || lower(unnest(regexp_extract_all(css, '([a-zA-Z-]+)\s*:', 1))) AS token FROM {css_text}
  UNION ALL SELECT batch, config, config_ord, slot, 'unit:' || lower(unnest(regexp_extract_all(css, '(?i)\d(px|rem|em|vw|vh|%|pt|fr|deg|ms|s)\b', 1))) FROM {css_text}
  UNION ALL SELECT batch, config, config_ord, slot, 'val:' || lower(unnest(regexp_extract_all(css, ':\s*([^;}]+)', 1))) FROM {css_text}) GROUP BY ALL""", "css_text")


def _css_text(cards):
    from pyspark.sql import functions as F

    return cards.select(*features.KEY, F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<style\b[^>]*>(.*?)</style>"), F.lit(1)), "\n").alias("css"))


def _css_counts(css):
    from pyspark.sql import functions as F

    key = features.KEY
    found = lambda prefix, pattern: css.select(*key, F.explode(F.regexp_extract_all("css", F.lit(pattern), F.lit(1))).alias("v")).select(*key, F.concat(F.lit(prefix), F.lower("v")).alias("token"))
    rows = found("prop:", r"([a-zA-Z-]+)\s*:").union(found("unit:", r"(?i)\d(px|rem|em|vw|vh|%|pt|fr|deg|ms|s)\b")).union(found("val:", r":\s*([^;}]+)"))
    return rows.groupBy(*key, "token").agg(F.count(F.lit(1)).cast("double").alias("value"))


cosine("css_value_profile", "css_values")
VIEW("classes", "SELECT batch, config, config_ord, slot, substr(token, 7) AS c FROM {feature_set} WHERE token LIKE 'class:%'")
VIEW("naming_style", r"""SELECT batch, config, slot, c AS class_token, CASE WHEN c LIKE '%\_\_%' OR c LIKE '%--%' THEN 'bem' WHEN c RLIKE '[a-z][A-Z]' THEN 'camel'
  WHEN c RLIKE '^[a-z0-9]+(-[a-z0-9]+)+$' THEN CASE WHEN c RLIKE '(^|-)([0-9]+|[a-z0-9]{{1,3}})(-|$)' THEN 'utility' ELSE 'kebab' END WHEN c RLIKE '^[a-z0-9]+$' THEN 'single' ELSE 'other' END AS style FROM {classes}""",
  r"""SELECT batch, config, slot, c AS class_token, CASE WHEN contains(c, '__') OR contains(c, '--') THEN 'bem' WHEN regexp_matches(c, '[a-z][A-Z]') THEN 'camel'
  WHEN regexp_matches(c, '^[a-z0-9]+(-[a-z0-9]+)+$') THEN CASE WHEN regexp_matches(c, '(^|-)([0-9]+|[a-z0-9][a-z0-9]?[a-z0-9]?)(-|$)') THEN 'utility' ELSE 'kebab' END WHEN regexp_matches(c, '^[a-z0-9]+$') THEN 'single' ELSE 'other' END AS style FROM {classes}""")

# texts
FRAME("text_sets", lambda s, d, texts: features.text_pairs(texts), "SELECT slot FROM texts", "texts")
VIEW("text_tokens", "", duck=r"""SELECT DISTINCT batch, variant, config, slot, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS token FROM
  (SELECT *, list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: CASE WHEN regexp_matches(x, '\p{Nd}') THEN '#' ELSE x END) AS w FROM {texts}) WHERE len(w) >= 5""")
VIEW("text_sizes", "SELECT slot, count(*) AS n FROM {text_tokens} GROUP BY slot")
FRAME("text_shingle_pairs", lambda s, d, p: p.filter("shared > 0"), """SELECT s.batch, s.variant, s.slot_a, s.slot_b, s.shared, a.n AS n_a, b.n AS n_b, s.shared / (a.n + b.n - s.shared) AS s FROM
  (SELECT a.batch, a.variant, a.slot AS slot_a, b.slot AS slot_b, count(*) AS shared FROM {text_tokens} a JOIN {text_tokens} b ON a.batch = b.batch AND a.variant = b.variant AND a.token = b.token AND a.slot < b.slot
   GROUP BY a.batch, a.variant, a.slot, b.slot) s JOIN {text_sizes} a ON s.slot_a = a.slot JOIN {text_sizes} b ON s.slot_b = b.slot""", "text_sets")

# dense vectors
VIEW("vectors", "SELECT vec_id, label, embedding FROM {embeddings}")
VIEW("vector_rows", "SELECT vec_id, label, pos, CAST(x AS DOUBLE) AS x FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS pos, x",
     "SELECT vec_id, label, CAST(unnest(range(0, len(embedding))) AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM {embeddings}")
VIEW("embedding_cosine_pairs", """SELECT a.vec_id AS a, b.vec_id AS b, round(aggregate(zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS DOUBLE) * y), CAST(0 AS DOUBLE), (s, x) -> s + x)
  / sqrt(aggregate(a.embedding, CAST(0 AS DOUBLE), (s, x) -> s + CAST(x AS DOUBLE) * x) * aggregate(b.embedding, CAST(0 AS DOUBLE), (s, x) -> s + CAST(x AS DOUBLE) * x)), 5) AS cosine
  FROM {embeddings} a JOIN {embeddings} b ON a.label = b.label AND floor(a.vec_id / 100) = floor(b.vec_id / 100) AND a.vec_id < b.vec_id""",
  """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine
  FROM {embeddings} a JOIN {embeddings} b ON a.label = b.label AND floor(a.vec_id / 100) = floor(b.vec_id / 100) AND a.vec_id < b.vec_id""")
VIEW("palette_bins", "SELECT vec_id, label, CAST(pos % 16 AS INT) AS bin, sum(abs(x)) AS weight FROM {vector_rows} GROUP BY vec_id, label, pos % 16")
VIEW("palette_top", "SELECT vec_id, bin, rank FROM (SELECT vec_id, bin, row_number() OVER (PARTITION BY vec_id ORDER BY round(weight, 9) DESC, bin) AS rank FROM {palette_bins}) WHERE rank <= 8")
VIEW("palette_kernel", """SELECT vec_id, round(sum(a_w * b_w * exp(-CAST((a_b - b_b) * (a_b - b_b) AS DOUBLE) / 200)), 4) AS self_kernel FROM
  (SELECT a.vec_id, a.weight AS a_w, b.weight AS b_w, a.bin AS a_b, b.bin AS b_b FROM {palette_bins} a JOIN {palette_bins} b ON a.vec_id = b.vec_id) GROUP BY vec_id""")
# layout: boxes made from node places (the tables have no layout), on a grid of 40 x 40 pixels
BOX = "(pos * 37) % 1200 AS x, (pos * 91) % 740 AS y, 20 + (pos * 53) % 200 AS w, 10 + (pos * 29) % 90 AS h"
VIEW("boxes", f"SELECT batch, config, config_ord, slot, pos, {BOX} FROM {{nodes}}")
VIEW("cells_x", "SELECT *, cx FROM {boxes} LATERAL VIEW explode(sequence(CAST(floor(x / 40) AS INT), CAST(floor((x + w - 1) / 40) AS INT))) t AS cx",
     "SELECT *, unnest(range(CAST(floor(x / 40) AS BIGINT), CAST(floor((x + w - 1) / 40) AS BIGINT) + 1)) AS cx FROM {boxes}")
VIEW("cells_xy", "SELECT *, cy FROM {cells_x} LATERAL VIEW explode(sequence(CAST(floor(y / 40) AS INT), CAST(floor((y + h - 1) / 40) AS INT))) t AS cy",
     "SELECT *, unnest(range(CAST(floor(y / 40) AS BIGINT), CAST(floor((y + h - 1) / 40) AS BIGINT) + 1)) AS cy FROM {cells_x}")
VIEW("occupancy", """SELECT batch, config, config_ord, slot, cy * 32 + cx AS token, least(CAST(1600 AS BIGINT), CAST(sum((least(x + w, (cx + 1) * 40) - greatest(x, cx * 40)) * (least(y + h, (cy + 1) * 40) - greatest(y, cy * 40))) AS BIGINT)) AS v
  FROM {cells_xy} WHERE cx < 32 AND cy < 20 GROUP BY batch, config, config_ord, slot, cy * 32 + cx""")
VIEW("occupancy_sums", "SELECT slot, CAST(sum(v) AS BIGINT) AS n FROM {occupancy} GROUP BY slot")
FRAME("layout_iou_pairs", lambda s, d, cards, boxes: features.layout_pairs(cards, boxes), """SELECT p.batch, p.config_a, p.config_b, p.kind, p.slot_a, p.slot_b, CASE WHEN a.n > 0 AND b.n > 0 THEN coalesce(s.low, 0) / (a.n + b.n - coalesce(s.low, 0)) END AS s
  FROM {slot_pairs} p LEFT JOIN {occupancy_sums} a ON p.slot_a = a.slot LEFT JOIN {occupancy_sums} b ON p.slot_b = b.slot
  LEFT JOIN (SELECT a.slot AS slot_a, b.slot AS slot_b, CAST(sum(least(a.v, b.v)) AS BIGINT) AS low FROM {occupancy} a JOIN {occupancy} b ON a.batch = b.batch AND a.token = b.token
    AND (a.config_ord < b.config_ord OR a.config_ord = b.config_ord AND a.slot < b.slot) GROUP BY a.slot, b.slot) s ON p.slot_a = s.slot_a AND p.slot_b = s.slot_b""", "cards boxes")

QUERIES = """pair_counts pair_completeness shingle_jaccard_pairs winnow_jaccard_pairs feature_jaccard_pairs tagpath_jaccard_pairs pqgram_dice_pairs semantics_cosine_pairs
 css_value_profile naming_style text_shingle_pairs embedding_cosine_pairs palette_top palette_kernel layout_iou_pairs""".split()
