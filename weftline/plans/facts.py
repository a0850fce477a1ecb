"""Visibility, ancestors, occurrences and bindings of facts, boards, pages, telemetry and windows of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import phrases, spans
from weftline.plans import channels, mapping, similarity  # noqa: F401  their views
from weftline.plans.views import FRAME, VIEW

#: The viewport, the least opacity of what is seen and the share of the viewport from which a box is its backdrop.
WIDTH, HEIGHT, OPACITY, BACKDROP = 1280, 800, 0.05, 0.99

# visibility: the tables have no styles, so display and opacity are made from element places
VIEW("styled", f"SELECT *, CASE WHEN pos % 29 = 0 THEN 'none' ELSE 'block' END AS display, CASE WHEN pos % 31 = 0 THEN 'hidden' ELSE 'visible' END AS visibility, (pos % 21) / 20 AS opacity, CASE WHEN pos % 37 = 0 THEN {WIDTH} ELSE w END AS bw, CASE WHEN pos % 37 = 0 THEN {HEIGHT} ELSE h END AS bh FROM {{boxes}}")
_SEEN = f"display <> 'none' AND visibility = 'visible' AND opacity > {OPACITY} AND least(x + bw, {WIDTH}) > greatest(x, 0) AND least(y + bh, {HEIGHT}) > greatest(y, 0)"
VIEW("visible_elements", f"""SELECT batch, config, slot, count(*) AS n, sum(CASE WHEN {_SEEN} THEN 1 ELSE 0 END) AS visible, sum(CASE WHEN {_SEEN} AND bw * bh < {BACKDROP} * {WIDTH * HEIGHT} THEN 1 ELSE 0 END) AS counted FROM {{styled}} GROUP BY batch, config, slot""")
VIEW("visible_texts", "SELECT conv_id, turn, length(text) AS n FROM {conversations} WHERE role <> 'system' AND length(trim(text)) > 0")

# the lowest common ancestor of each element and the tenth after it: of all elements after the first one up to the second,
# the first of the least depth hangs below it, unless the first element is itself above all of them
FRAME("common_ancestors", lambda s, d, nodes: _common_ancestors(nodes), """SELECT p.slot, p.a, p.b, coalesce(max(CASE WHEN y.up IS NOT NULL THEN x.up END), -1) AS ancestor FROM
  (SELECT slot, pos AS a, lead(pos, 10) OVER (PARTITION BY slot ORDER BY pos) AS b FROM nodes) p
  LEFT JOIN {ancestors} x ON x.slot = p.slot AND x.pos = p.a LEFT JOIN {ancestors} y ON y.slot = p.slot AND y.pos = p.b AND y.up = x.up
  WHERE p.b IS NOT NULL GROUP BY p.slot, p.a, p.b""", "nodes")
VIEW("ancestors", "", duck="""WITH RECURSIVE up AS (SELECT slot, pos, pos AS up FROM {nodes} UNION ALL SELECT u.slot, u.pos, n.parent FROM up u JOIN {nodes} n ON u.slot = n.slot AND u.up = n.pos WHERE n.parent IS NOT NULL) SELECT * FROM up""")


def _common_ancestors(nodes):
    from pyspark.sql.window import Window

    order = Window.partitionBy("slot").orderBy("pos")
    top = F.min(F.struct("depth", "pos", "parent")).over(order.rowsBetween(1, 10))
    rows = nodes.select("slot", F.col("pos").alias("a"), F.lead("pos", 10).over(order).alias("b"), "depth", top.alias("top")).filter("b is not null")
    return rows.select("slot", "a", "b", F.when(F.col("top.depth") > F.col("depth"), F.col("a")).otherwise(F.coalesce("top.parent", F.lit(-1))).alias("ancestor"))


# occurrences: labelled temperatures and hours in lines made from line items; the longest hit at a place wins, hits that
# overlap it are dropped, and a value with two labels is void
VIEW("fact_lines", """SELECT l_orderkey, l_linenumber, 'High: ' || CAST(CAST(l_quantity AS INT) AS STRING) || '.5' || chr(176) || 'C, low ' || CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '' END || CAST(CAST(l_quantity AS INT) % 17 AS STRING) || chr(176) ||
  ' at ' || CAST(10 + l_linenumber AS STRING) || ':00, max/min ' || CAST(l_linenumber AS STRING) || chr(176) AS line FROM {lineitem}""")
#: A label, then a value with a degree sign; a minus may be a sign of its own.
FACT = r"(?i)\b(high|max/min|max|low|min)\b:?\s*([-\x{2212}]?\d+(?:\.\d+)?)\x{b0}"
HOUR = r"\b([01]?\d|2[0-3]):00\b"
FRAME("fact_hits", lambda s, d, lines: _hits(lines), f"""SELECT l_orderkey, l_linenumber, nth, kind, value FROM (SELECT l_orderkey, l_linenumber, CAST(unnest(range(0, len(x))) AS INT) AS nth,
  unnest(list_transform(x, lambda m: CASE WHEN contains(lower(m), '/') THEN 'void' WHEN regexp_matches(lower(m), '^(high|max)') THEN 'max' ELSE 'min' END)) AS kind,
  CAST(unnest(list_transform(x, lambda m: replace(regexp_extract(m, {channels.duck(FACT)}, 2), chr(8722), '-'))) AS DOUBLE) AS value FROM (SELECT *, regexp_extract_all(line, {channels.duck(FACT)}) AS x FROM fact_lines))""", "fact_lines")
FRAME("shown_hours", lambda s, d, lines: lines.select("l_orderkey", F.explode(F.regexp_extract_all("line", F.lit(HOUR), F.lit(1))).alias("h")).select("l_orderkey", F.col("h").cast("int").alias("hour")).distinct(),
  f"SELECT DISTINCT l_orderkey, CAST(unnest(regexp_extract_all(line, {channels.duck(HOUR)}, 1)) AS INT) AS hour FROM fact_lines", "fact_lines")
VIEW("hour_order", "SELECT l_orderkey, hour, row_number() OVER (PARTITION BY l_orderkey ORDER BY hour) - 1 AS place FROM {shown_hours}")


def _hits(lines):
    """The matches of FACT in turn; an alternation tries the longest label first, and matches never overlap."""
    x = lines.select("l_orderkey", "l_linenumber", F.posexplode(F.regexp_extract_all("line", F.lit(FACT), F.lit(0))).alias("nth", "m"))
    label = F.lower("m")
    kind = F.when(label.contains("/"), "void").when(label.rlike("^(high|max)"), "max").otherwise("min")
    value = F.replace(F.regexp_extract("m", FACT, 2), F.lit("\u2212"), F.lit("-")).cast("double")
    return x.select("l_orderkey", "l_linenumber", "nth", kind.alias("kind"), value.alias("value"))


#: A label binds the value of its kind where there is one value only; equal values of both kinds are ambiguous.
VIEW("fact_binding", """SELECT l_orderkey, l_linenumber, CASE WHEN high = least_high AND low = least_low AND high = low THEN 'ambiguous' WHEN high = least_high AND low = least_low THEN 'bound' WHEN high IS NULL AND low IS NULL THEN 'not-shown'
  WHEN high > least_high OR low > least_low THEN 'several' ELSE 'single' END AS state, CASE WHEN high = least_high THEN high END AS high, CASE WHEN low = least_low THEN low END AS low, n_void FROM (SELECT l_orderkey, l_linenumber,
  max(CASE WHEN kind = 'max' THEN value END) AS high, min(CASE WHEN kind = 'max' THEN value END) AS least_high, max(CASE WHEN kind = 'min' THEN value END) AS low, min(CASE WHEN kind = 'min' THEN value END) AS least_low,
  count(CASE WHEN kind = 'void' THEN 1 END) AS n_void FROM {fact_hits} GROUP BY l_orderkey, l_linenumber) x""",
  """SELECT l_orderkey, l_linenumber, CASE WHEN n_max = 1 AND n_min = 1 AND high = low THEN 'ambiguous' WHEN n_max = 1 AND n_min = 1 THEN 'bound' WHEN n_max + n_min = 0 THEN 'not-shown' WHEN n_max > 1 OR n_min > 1 THEN 'several' ELSE 'single' END AS state,
  CASE WHEN n_max = 1 THEN high END AS high, CASE WHEN n_min = 1 THEN low END AS low, n_void FROM (SELECT l_orderkey, l_linenumber, count(DISTINCT CASE WHEN kind = 'max' THEN value END) AS n_max, count(DISTINCT CASE WHEN kind = 'min' THEN value END) AS n_min,
  max(CASE WHEN kind = 'max' THEN value END) AS high, max(CASE WHEN kind = 'min' THEN value END) AS low, count(CASE WHEN kind = 'void' THEN 1 END) AS n_void FROM {fact_hits} GROUP BY l_orderkey, l_linenumber) x""")

# the same with several patterns that overlap, as spans, and what the labels of an order bind
VIEW("fact_notes", """SELECT l_orderkey, l_linenumber, CASE CAST(l_partkey % 7 AS INT) WHEN 0 THEN 'High ' || q || '.5°C at ' || h || ':00, low −' || r || '°' WHEN 1 THEN 'max ' || q || '°c / min ' || r || '℃ by ' || l_linenumber || ' pm'
  WHEN 2 THEN 'Today ' || r || '–' || q || '° hi ' || h || 'h' WHEN 3 THEN 'maximum' WHEN 4 THEN '-' || r || '.25 °f at ' || h || ':30°' WHEN 5 THEN 'lo ' || q || ' degrees, minimum' ELSE q || '°' END AS line
  FROM (SELECT *, CAST(CAST(l_quantity AS INT) AS STRING) AS q, CAST(CAST(l_quantity AS INT) % 17 AS STRING) AS r, CAST(10 + l_linenumber AS STRING) AS h FROM {lineitem})""")
FRAME("note_spans", lambda s, d, lines: spans.fact_spans(lines, ["l_orderkey", "l_linenumber"]), "", "fact_notes")
FRAME("note_bindings", lambda s, d, found, lines: spans.bound_extremes(found, lines, "l_orderkey", "l_linenumber"), "", "note_spans fact_notes")

# conditions by the longest phrase at each place; SQL tries all phrases at all places
VIEW("sky_notes", """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 11 = 1 THEN l_returnflag ELSE 'Day ' || CAST(l_linenumber AS STRING) || ':  ' || a || ' ' || b || CASE WHEN l_quantity > 30 THEN ', then ' || c ELSE '.' END END AS line FROM
  (SELECT *, CASE CAST(l_suppkey % 8 AS INT) WHEN 0 THEN 'Light' WHEN 1 THEN 'HEAVY' WHEN 2 THEN 'moderate' WHEN 3 THEN 'mostly' WHEN 4 THEN 'light freezing' WHEN 5 THEN 'no' WHEN 6 THEN 'depositing rime' ELSE 'Thunderstorm with heavy' END AS a,
  CASE CAST(l_partkey % 7 AS INT) WHEN 0 THEN 'rain showers' WHEN 1 THEN 'snow' WHEN 2 THEN 'Fog' WHEN 3 THEN 'drizzle' WHEN 4 THEN 'sunny' WHEN 5 THEN 'hail' ELSE 'rains' END AS b,
  CASE CAST(l_linenumber % 4 AS INT) WHEN 0 THEN 'clear  sky' WHEN 1 THEN 'partly cloudy' WHEN 2 THEN 'snow grains' ELSE 'wind' END AS c FROM {lineitem})""")
VIEW("sky_expected", "SELECT o_orderkey AS l_orderkey, CASE CAST(o_custkey % 6 AS INT) WHEN 0 THEN 0 WHEN 1 THEN 80 WHEN 2 THEN 48 WHEN 3 THEN 71 WHEN 4 THEN 99 ELSE 61 END AS expected FROM {orders}")
_PHRASES = ", ".join(f"('{p}', {c})" for p, c in phrases.VOCABULARY)
FRAME("condition_hits", lambda s, d, lines: phrases.condition_hits(lines, ["l_orderkey", "l_linenumber"]), f"""SELECT l_orderkey, l_linenumber, CAST(i AS INT) AS start, CAST(i + max(length(p)) AS INT) AS stop, arg_max(p, length(p)) AS phrase, arg_max(code, length(p)) AS code FROM
  (SELECT *, unnest(range(length(line))) AS i FROM (SELECT row_number() OVER () AS r, l_orderkey, l_linenumber, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) AS line FROM sky_notes)) n JOIN (VALUES {_PHRASES}) v(p, code) ON substr(line, i + 1, length(p)) = p GROUP BY r, l_orderkey, l_linenumber, i""", "sky_notes")
FRAME("condition_verdicts", lambda s, d, hits, expected: phrases.condition_verdicts(hits, expected, "l_orderkey", "l_linenumber"), """SELECT l_orderkey, expected, CASE WHEN first_line IS NOT NULL THEN 'match' WHEN n > 0 THEN 'mismatch' ELSE 'not-found' END AS state, first_line, CASE WHEN first_line IS NULL AND n > 0 THEN others END AS others FROM
  (SELECT e.l_orderkey, e.expected, min(CASE WHEN h.code = e.expected THEN h.l_linenumber END) AS first_line, count(h.code) AS n, array_to_string(list_sort(list(DISTINCT h.code)), ',') AS others FROM sky_expected e LEFT JOIN
   (SELECT l_orderkey, l_linenumber, code FROM condition_hits QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY stop - start DESC, code) = 1) h ON e.l_orderkey = h.l_orderkey GROUP BY e.l_orderkey, e.expected)""", "condition_hits sky_expected")

# expected facts of a snapshot: decimals as strings become numbers of display precision
VIEW("expected_facts", """SELECT n.n_name AS name, CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS day, CAST(CAST(CAST(max(o.o_totalprice) AS DECIMAL(18, 2)) / 10000 AS DECIMAL(9, 1)) AS DOUBLE) AS temp_max, CAST(CAST(CAST(min(o.o_totalprice) AS DECIMAL(18, 2)) / 10000 AS DECIMAL(9, 1)) AS DOUBLE) AS temp_min FROM {orders} o
  JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name, CAST(o.o_orderdate AS DATE)""")

# adjacent frames: the difference of neighbouring values, its median and most
VIEW("frame_changes", """SELECT user_id, count(change) AS n, round(PCT(change, 0.5), 6) AS median_change, round(max(change), 6) AS max_change FROM (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS change FROM {events}) x
  GROUP BY user_id HAVING count(change) > 0""")
VIEW("telemetry_sums", """SELECT o_orderpriority AS config, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS prompt_tokens, CAST(sum(CAST(l_quantity AS BIGINT) * l_linenumber) AS BIGINT) AS total_tokens FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderpriority""")
VIEW("region_class", """SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') OR p_type LIKE 'PROMO%' THEN 'east' WHEN p_brand IN ('Brand#3', 'Brand#4') OR p_type LIKE 'ECONOMY%' OR p_type LIKE 'SMALL%' THEN 'west' ELSE 'other' END AS region FROM {part}""")
VIEW("first_representative", """SELECT user_id, event_type, event_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM {events}) x WHERE r = 1""")
VIEW("catalog_page", "SELECT p_partkey, p_brand, p_size FROM {part} ORDER BY p_brand, p_size DESC, p_partkey LIMIT 24 OFFSET 48")
VIEW("compare_set", """SELECT place, p.p_partkey, p.p_name FROM (SELECT pos AS place, id FROM (SELECT posexplode(array(7, 3, 100000000, 11, 5, 3000, 2, 19, 23, 29, 31, 37, 41, 43, 47)) AS (pos, id)) w) x JOIN {part} p ON x.id = p.p_partkey ORDER BY place LIMIT 12""",
  """SELECT place, p.p_partkey, p.p_name FROM (SELECT CAST(unnest(range(0, 15)) AS INT) AS place, unnest([7, 3, 100000000, 11, 5, 3000, 2, 19, 23, 29, 31, 37, 41, 43, 47]) AS id) x JOIN {part} p ON x.id = p.p_partkey ORDER BY place LIMIT 12""")
VIEW("board_rows", """SELECT o_orderpriority AS arm, o_orderstatus AS model, count(*) AS n, array_join(transform(array_sort(collect_set(year(o_orderdate))), y -> CAST(y AS STRING)), ',') AS cells FROM {orders} GROUP BY o_orderpriority, o_orderstatus""",
  """SELECT o_orderpriority AS arm, o_orderstatus AS model, count(*) AS n, array_to_string(list_sort(list(DISTINCT year(o_orderdate))), ',') AS cells FROM {orders} GROUP BY ALL""")
VIEW("double_render", """SELECT a.page_id AS a, b.page_id AS b, SHA(a.html) = SHA(b.html) AS same FROM {pages} a JOIN {pages} b ON a.page_id + 1 = b.page_id""")
VIEW("env_digest", """SELECT p_partkey, SHA(chr(123) || '"brand":"' || p_brand || '","size":' || CAST(p_size AS STRING) || chr(125)) AS digest FROM {part}""")
VIEW("five_minute_stats", """SELECT window_start, event_type, n, round(CAST(total AS DOUBLE), 4) AS total FROM (SELECT CAST(floor(unix_seconds(CAST(ts AS TIMESTAMP)) / 300) * 300 AS BIGINT) AS window_start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18, 6))) AS total FROM {events} GROUP BY 1, 2) x""",
  """SELECT window_start, event_type, n, round(CAST(total AS DOUBLE), 4) AS total FROM (SELECT CAST(floor(floor(epoch(ts)) / 300) * 300 AS BIGINT) AS window_start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18, 6))) AS total FROM {events} GROUP BY ALL) x""")
#: After a restart: running jobs are queued again, and a voter has three queued ones at most.
VIEW("boot_reconcile", """SELECT event_id, voter, state FROM (SELECT event_id, user_id AS voter, CASE WHEN event_type = 'purchase' THEN 'done' WHEN row_number() OVER (PARTITION BY user_id, event_type <> 'purchase' ORDER BY ts, event_id) <= 3 THEN 'queued' ELSE 'rejected' END AS state FROM {events}) x""")
VIEW("voter_maps", """SELECT voter, map_keys(m) AS kinds, aggregate(map_values(m), 0L, (s, x) -> s + x) AS n FROM (SELECT user_id AS voter, map_from_entries(array_sort(collect_list(struct(event_type, c)))) AS m FROM (SELECT user_id, event_type, count(*) AS c FROM {events} GROUP BY user_id, event_type) x GROUP BY user_id) y""",
  "SELECT user_id AS voter, list_sort(list(DISTINCT event_type)) AS kinds, count(*) AS n FROM {events} GROUP BY user_id")
FRAME("voter_kinds", lambda s, d, m: m.select("voter", F.array_join("kinds", ",").alias("kinds"), "n"), "SELECT voter, array_to_string(kinds, ',') AS kinds, n FROM voter_maps", "voter_maps")

VIEW("share_reveal", "SELECT conv_id, count(*) AS n, array_join(transform(array_sort(collect_list(struct(turn, role))), x -> x.role), ',') AS reveal FROM {conversations} GROUP BY conv_id",
  "SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn, role) AS reveal FROM {conversations} GROUP BY conv_id")
VIEW("valid_items", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, event_type FROM {events} WHERE get_json_object(props, '$.k') IS NOT NULL AND event_type <> 'error' AND value > 0",
  "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type FROM {events} WHERE json_extract_string(props, '$.k') IS NOT NULL AND event_type <> 'error' AND value > 0")
VIEW("request_fields", "SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'reasoning_effort=high' WHEN '2' THEN 'reasoning_effort=medium' WHEN '3' THEN 'reasoning_effort=low' WHEN '4' THEN 'thinking.budget_tokens=4096' ELSE 'none' END AS field FROM {orders}")

# words of the same variant and batch: all pairs, also those that share nothing; null where a side has no shingle
FRAME("d_text_pairs", lambda s, d, p: p.select("batch", "variant", "slot_a", "slot_b", "s"), """SELECT a.batch, a.variant, a.slot AS slot_a, b.slot AS slot_b, CASE WHEN x.n > 0 AND y.n > 0 THEN coalesce(s.shared, 0) / (x.n + y.n - coalesce(s.shared, 0)) END AS s FROM {texts} a
  JOIN {texts} b ON a.batch = b.batch AND a.variant = b.variant AND a.slot < b.slot LEFT JOIN {text_sizes} x ON a.slot = x.slot LEFT JOIN {text_sizes} y ON b.slot = y.slot
  LEFT JOIN (SELECT a.slot AS slot_a, b.slot AS slot_b, count(*) AS shared FROM {text_tokens} a JOIN {text_tokens} b ON a.batch = b.batch AND a.variant = b.variant AND a.token = b.token AND a.slot < b.slot GROUP BY a.slot, b.slot) s ON a.slot = s.slot_a AND b.slot = s.slot_b""", "text_sets")


ROWS_ONLY = "note_spans note_bindings".split()
QUERIES = """visible_elements visible_texts common_ancestors fact_hits hour_order fact_binding expected_facts frame_changes telemetry_sums region_class first_representative catalog_page compare_set board_rows double_render
 condition_hits condition_verdicts env_digest five_minute_stats share_reveal valid_items request_fields boot_reconcile voter_kinds d_text_pairs""".split()
