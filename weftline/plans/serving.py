"""Registry, facets, arena votes, rankings, lookups and other serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import draws
from weftline.plans import mapping
from weftline.plans.views import FRAME, VIEW

FRAME("votes", mapping.votes, mapping.VOTES_SQL.split(" AS (", 1)[1][:-1])
FRAME("configs", mapping.configs, mapping.CONFIGS_SQL.split(" AS (", 1)[1][:-1])

#: Gates and constants of the arena.
Z, VOTES_MIN, VOTERS_MIN, DWELL_MIN, DWELL_MAX = 1.959963984540054, 20, 8, 2500, 600_000

# registry
VIEW("winners", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY n_valid DESC, created DESC, batch_id DESC) AS place FROM {configs}) x WHERE place = 1")
VIEW("winner_per_config", "SELECT config_id, family, model_id, effort, protocol, batch_id, created, n_valid FROM {winners}")
VIEW("registry_totals", "SELECT count(*) AS n_configs, count(DISTINCT model_id) AS n_models, CAST(sum(n_valid) AS BIGINT) AS n_valid, count(DISTINCT batch_id) AS n_batches FROM {winners}")
VIEW("facet_values", """SELECT 'family' AS facet, family AS value, count(*) AS n FROM {winners} GROUP BY family UNION ALL SELECT 'effort', effort, count(*) FROM {winners} GROUP BY effort
  UNION ALL SELECT 'protocol', protocol, count(*) FROM {winners} GROUP BY protocol UNION ALL SELECT 'model', model_id, count(*) FROM {winners} GROUP BY model_id""")
VIEW("facet_filter", "SELECT config_id, model_id, effort FROM {winners} WHERE family IN ('fam0', 'fam1', 'fam3') AND effort IN ('low', 'high', '8000') AND n_valid > 0 AND lower(model_id) LIKE '%model-%'")
VIEW("config_arms", """SELECT config_id, CASE WHEN protocol IN ('cli', 'agent') THEN 'harness' ELSE 'api' END AS arm_group, CASE WHEN effort = 'none' AND protocol = 'api' THEN 'qualified' WHEN protocol = 'agent' THEN 'dev'
  WHEN effort = 'max' THEN 'community' ELSE 'qualified' END AS grade, family || ' ' || model_id || ' ' || effort || ' (' || protocol || ')' AS label FROM {winners}""")
VIEW("axis_filter", "SELECT a.* FROM {config_arms} a JOIN (SELECT arm_group, count(*) FILTER (WHERE grade = 'qualified') AS q FROM {config_arms} GROUP BY arm_group) g ON a.arm_group = g.arm_group WHERE a.grade = 'qualified' OR g.q < 5")
VIEW("effort_ladder_order", """SELECT config_id, effort, CASE WHEN effort = 'none' THEN 0 WHEN effort = 'low' THEN 1 WHEN effort = 'medium' THEN 2 WHEN effort = 'high' THEN 3 WHEN effort = 'max' THEN 5 WHEN TRY_CAST(effort AS INT) IS NOT NULL THEN 100 + TRY_CAST(effort AS INT) ELSE 50 END AS effort_rank FROM {winners}""")
VIEW("browse_order", """SELECT w.config_id, row_number() OVER (ORDER BY w.family, w.model_id, e.effort_rank, w.protocol, w.config_id) AS place FROM {winners} w JOIN {effort_ladder_order} e ON w.config_id = e.config_id""")
VIEW("coverage_gap", """SELECT family, count(*) AS n_models, count(*) FILTER (WHERE has_data) AS n_with_data, count(*) FILTER (WHERE has_api) AS n_api, NOT bool_or(has_data) AS zero_data FROM
  (SELECT family, model_id, bool_or(n_valid > 0) AS has_data, bool_or(protocol = 'api') AS has_api FROM {winners} GROUP BY family, model_id) x GROUP BY family""")
VIEW("growth_multiple", """SELECT model_id, n_points, CASE WHEN n_points >= 2 AND most >= 1.5 * least THEN round(most / least, 6) END AS multiple FROM
  (SELECT model_id, count(*) AS n_points, CAST(max(n_valid) AS DOUBLE) AS most, CAST(min(CASE WHEN n_valid > 0 THEN n_valid END) AS DOUBLE) AS least FROM {configs} GROUP BY model_id) x""")
VIEW("valid_by_variant", "SELECT config_id, count(*) FILTER (WHERE created % 2 = 0) AS m_min, count(*) FILTER (WHERE created % 2 = 1) AS m_q FROM {configs} GROUP BY config_id")
VIEW("missing_batches", "SELECT DISTINCT w.config_id, w.batch_id FROM {winners} w LEFT ANTI JOIN (SELECT batch_id FROM {configs} GROUP BY batch_id HAVING count(*) >= 3) r ON w.batch_id = r.batch_id",
     "SELECT DISTINCT w.config_id, w.batch_id FROM {winners} w ANTI JOIN (SELECT batch_id FROM {configs} GROUP BY batch_id HAVING count(*) >= 3) r ON w.batch_id = r.batch_id")
VIEW("readable_configs", "SELECT c.config_id, c.batch_id FROM {configs} c LEFT SEMI JOIN (SELECT batch_id FROM {configs} GROUP BY batch_id HAVING count(*) >= 3) r ON c.batch_id = r.batch_id",
     "SELECT c.config_id, c.batch_id FROM {configs} c SEMI JOIN (SELECT batch_id FROM {configs} GROUP BY batch_id HAVING count(*) >= 3) r ON c.batch_id = r.batch_id")
VIEW("duplicate_ids", "SELECT config_id, count(*) AS n FROM {configs} GROUP BY config_id HAVING count(*) > 1")
VIEW("constraint_violations", """SELECT 'orders.status' AS rule, o_orderkey AS id FROM {orders} WHERE o_orderstatus NOT IN ('O', 'F', 'P') UNION ALL SELECT 'orders.total', o_orderkey FROM {orders} WHERE o_totalprice < 0
  UNION ALL SELECT 'lineitem.discount', l_orderkey FROM {lineitem} WHERE l_discount > 0.1 OR l_discount < 0 UNION ALL SELECT 'lineitem.order', l_orderkey FROM {lineitem} WHERE l_returnflag = 'R' AND l_linestatus = 'O'
  UNION ALL SELECT 'customer.balance', c_custkey FROM {customer} WHERE c_acctbal < -900""")
VIEW("default_session", "SELECT batch_id, n_qualified, n_configs FROM (SELECT batch_id, count(*) FILTER (WHERE n_valid > 3) AS n_qualified, count(*) AS n_configs FROM {configs} GROUP BY batch_id) x ORDER BY n_qualified DESC, n_configs DESC, batch_id LIMIT 1")
VIEW("latest_per_model", "SELECT model_id, config_id, created FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY created DESC, config_id) AS r FROM {configs}) x WHERE r = 1")
VIEW("first_seen", "SELECT c.config_id, min(f.first_batch) AS first_batch, max(c.created) AS last_created FROM {configs} c LEFT JOIN (SELECT model_id, min(batch_id) AS first_batch FROM {configs} GROUP BY model_id) f ON c.model_id = f.model_id GROUP BY c.config_id")
VIEW("cost_estimate", "SELECT protocol, CAST(sum(n_valid * 2) AS BIGINT) AS n_calls, CAST(round(sum(n_valid * 2 * CASE protocol WHEN 'api' THEN 0.012 WHEN 'cli' THEN 0.02 ELSE 0.05 END), 4) AS DOUBLE) AS usd FROM {winners} GROUP BY protocol",
     "SELECT protocol, CAST(sum(n_valid * 2) AS BIGINT) AS n_calls, CAST(round(sum(n_valid * 2 * CASE protocol WHEN 'api' THEN 0.012 WHEN 'cli' THEN 0.02 ELSE 0.05 END), 4) AS DOUBLE) AS usd FROM {winners} GROUP BY protocol")
VIEW("patch_lookup", "SELECT o.o_orderkey, coalesce(p.n_lines, 0) AS n_lines, CASE WHEN p.n_lines IS NOT NULL THEN 'patched' ELSE 'original' END AS source FROM {orders} o LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY l_orderkey) p ON o.o_orderkey = p.l_orderkey")
VIEW("name_search", "SELECT p_partkey, p_name FROM {part} WHERE lower(p_name) LIKE '%a%' AND lower(p_brand) LIKE '%1%'")
VIEW("job_queue_head", "SELECT event_type, event_id AS next_job FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM {events}) x WHERE r = 1")
VIEW("board_cells", "SELECT DISTINCT family || '|' || model_id || '|' || effort || '|' || protocol AS cell_key, family, model_id FROM {configs}")

# arena
VIEW("accepted", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY voter, config_a, config_b ORDER BY ts, vote_id) AS nth FROM {{votes}} WHERE dwell_ms BETWEEN {DWELL_MIN} AND {DWELL_MAX} AND choice <> 'skip') x WHERE nth = 1")
VIEW("vote_dedup_dwell", "SELECT vote_id, voter, config_a, config_b, choice, variant FROM {accepted}")
VIEW("sides", """SELECT vote_id, voter, variant, config_a AS config, CASE choice WHEN 'a' THEN 'win' WHEN 'b' THEN 'loss' ELSE choice END AS result FROM {accepted}
  UNION ALL SELECT vote_id, voter, variant, config_b, CASE choice WHEN 'b' THEN 'win' WHEN 'a' THEN 'loss' ELSE choice END FROM {accepted}""")
VIEW("tallies", """SELECT variant, config, count(*) AS n, count(DISTINCT voter) AS n_voters, count(*) FILTER (WHERE result = 'win') AS wins, count(*) FILTER (WHERE result = 'loss') AS losses,
  count(*) FILTER (WHERE result = 'tie') AS ties, count(*) FILTER (WHERE result = 'both_bad') AS both_bad FROM {sides} GROUP BY variant, config""")
VIEW("arena_tallies", """SELECT t.variant, t.config, t.n, t.n_voters, t.wins, t.losses, t.ties, t.both_bad, round(t.both_bad / t.n, 6) AS both_bad_rate, round(m.most / t.n, 6) AS max_voter_share FROM {tallies} t
  JOIN (SELECT variant, config, max(c) AS most FROM (SELECT variant, config, voter, count(*) AS c FROM {sides} GROUP BY variant, config, voter) x GROUP BY variant, config) m ON t.variant = m.variant AND t.config = m.config""")
VIEW("pref_wilson", f"""SELECT variant, config, n, CASE WHEN ok THEN round(p, 6) END AS pref_rate, CASE WHEN ok THEN round((p + {Z**2} / (2 * d) - {Z} * sqrt(p * (1 - p) / d + {Z**2} / (4 * d * d))) / (1 + {Z**2} / d), 6) END AS low,
  CASE WHEN ok THEN round((p + {Z**2} / (2 * d) + {Z} * sqrt(p * (1 - p) / d + {Z**2} / (4 * d * d))) / (1 + {Z**2} / d), 6) END AS high FROM
  (SELECT *, CAST(wins + losses + ties AS DOUBLE) AS d, (wins + CAST(ties AS DOUBLE) / 2) / (wins + losses + ties) AS p, n >= {VOTES_MIN} AND n_voters >= {VOTERS_MIN} AS ok FROM {{tallies}} WHERE wins + losses + ties > 0) x""")
VIEW("leaderboard", "SELECT variant, config, pref_rate, row_number() OVER (PARTITION BY variant ORDER BY CASE WHEN pref_rate IS NULL THEN 1 ELSE 0 END, pref_rate DESC, config) AS place FROM {pref_wilson}")
VIEW("vote_counts", "SELECT config, count(*) AS n_all, count(*) FILTER (WHERE variant = 'min') AS n_min, count(*) FILTER (WHERE variant = 'q') AS n_q FROM {sides} GROUP BY config")
VIEW("issue_weights", "SELECT config, n_all, round(1 / (1 + n_all) / sum(CAST(1 AS DOUBLE) / (1 + n_all)) OVER (), 6) AS weight FROM {vote_counts}")
VIEW("pool", "SELECT variant, config, count(*) AS votes FROM {sides} GROUP BY variant, config")
VIEW("asks", "SELECT event_id AS ask, CASE WHEN user_id % 3 = 0 THEN 'min' ELSE 'q' END AS variant FROM {events} WHERE event_type = 'view'")
FRAME("issued_pairs", lambda s, d, asks, pool: draws.issue_pairs(asks, pool), """WITH line AS (SELECT variant, config, w, row_number() OVER o - 1 AS nth, sum(w) OVER o - w AS below, count(*) OVER (PARTITION BY variant) AS n, sum(w) OVER (PARTITION BY variant) AS total
    FROM (SELECT variant, config, greatest(1, 1000000000 // (1 + votes)) AS w FROM {pool}) x WINDOW o AS (PARTITION BY variant ORDER BY substr(sha256(config), 1, 2), config)),
  drawn AS (SELECT ask, variant, ('0x' || substr(sha256('issue:a:' || ask), 1, 15))::HUGEINT AS ha, ('0x' || substr(sha256('issue:b:' || ask), 1, 15))::HUGEINT AS hb FROM {asks})
  SELECT d.ask, d.variant, a.config AS config_a, b.config AS config_b FROM drawn d JOIN line a ON a.variant = d.variant AND a.n >= 2 AND (d.ha * a.total) // 1152921504606846976 BETWEEN a.below AND a.below + a.w - 1
  JOIN line b ON b.variant = d.variant AND b.nth = (a.nth + 1 + (d.hb * (a.n - 1)) // 1152921504606846976) % a.n""", "asks pool")
VIEW("part_demand", "SELECT p_brand, p_partkey, count(l_orderkey) AS n_lines, CAST(1 AS DOUBLE) / (1 + count(l_orderkey)) AS weight FROM {part} LEFT JOIN {lineitem} ON l_partkey = p_partkey GROUP BY p_brand, p_partkey")
FRAME("fresh_parts", lambda s, d, demand: draws.weighted_sample(demand, "p_brand", "p_partkey", "weight", 5, "fresh").drop("weight").withColumn("place", F.col("place").cast("long")),
  """SELECT p_brand, p_partkey, n_lines, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY ln((('0x' || substr(sha256('fresh:' || p_brand || ':' || p_partkey), 1, 15))::BIGINT::DOUBLE + 0.5) / 1152921504606846976::DOUBLE) / weight DESC, p_partkey) AS place
  FROM {part_demand}) x WHERE place <= 5""", "part_demand")
VIEW("votes_export", "SELECT vote_id, substr(SHA(CAST(voter AS STRING)), 1, 12) AS voter_hash, config_a, config_b, choice FROM {accepted}")
VIEW("unconsumed_pairs", "SELECT a.vote_id FROM {votes} a LEFT JOIN {accepted} b ON a.vote_id = b.vote_id WHERE b.vote_id IS NULL")
VIEW("daily_rate", "SELECT voter, CAST(CAST(ts AS DATE) AS STRING) AS day, count(*) AS n, count(*) > 30 AS blocked FROM {votes} GROUP BY voter, CAST(ts AS DATE)")

# tiered lookup with a tolerance in two coordinates, by a grid of one cell and its neighbours
VIEW("places", "SELECT s_suppkey AS id, CAST((s_suppkey * 7919) % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST((s_suppkey * 104729) % 18000 AS DOUBLE) / 100 - 90 AS lat FROM {supplier}")
VIEW("asked", "SELECT c_custkey AS ask, CAST((c_custkey * 7919) % 36000 AS DOUBLE) / 100 - 180 + 0.0004 AS lon, CAST((c_custkey * 104729) % 18000 AS DOUBLE) / 100 - 90 - 0.0003 AS lat FROM {customer}")
VIEW("place_cells", "SELECT *, CAST(floor(lon * 100) AS BIGINT) + dx AS gx, CAST(floor(lat * 100) AS BIGINT) + dy AS gy FROM {places} JOIN (VALUES (-1), (0), (1)) a(dx) ON true JOIN (VALUES (-1), (0), (1)) b(dy) ON true",
     "SELECT *, CAST(floor(lon * 100) AS BIGINT) + dx AS gx, CAST(floor(lat * 100) AS BIGINT) + dy AS gy FROM {places}, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)")
VIEW("coord_tolerance_lookup", "SELECT a.ask, p.id FROM {asked} a JOIN {place_cells} p ON CAST(floor(a.lon * 100) AS BIGINT) = p.gx AND CAST(floor(a.lat * 100) AS BIGINT) = p.gy WHERE abs(a.lon - p.lon) <= 0.001 AND abs(a.lat - p.lat) <= 0.001",
     "SELECT a.ask, p.id FROM {asked} a JOIN {places} p ON abs(a.lon - p.lon) <= 0.001 AND abs(a.lat - p.lat) <= 0.001")
VIEW("tiered_lookup", """SELECT c.c_custkey AS ask, coalesce(e.id, t.id) AS id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN t.id IS NOT NULL THEN 'near' ELSE 'none' END AS tier FROM {customer} c
  LEFT JOIN (SELECT s_suppkey AS id FROM {supplier} WHERE s_acctbal > 0) e ON c.c_custkey = e.id LEFT JOIN (SELECT ask, min(id) AS id FROM {coord_tolerance_lookup} GROUP BY ask) t ON c.c_custkey = t.ask""")
VIEW("numbers", "SELECT o_orderkey, round(o_totalprice, 2) AS price, CASE WHEN CAST(o_orderkey AS STRING) RLIKE '^(0|[1-9][0-9]*)$' THEN TRY_CAST(CAST(o_orderkey AS STRING) AS BIGINT) END AS as_number FROM {orders}",
     "SELECT o_orderkey, round(o_totalprice, 2) AS price, CASE WHEN regexp_full_match(CAST(o_orderkey AS STRING), '0|[1-9][0-9]*') THEN TRY_CAST(CAST(o_orderkey AS STRING) AS BIGINT) END AS as_number FROM {orders}")

# the configurations' output: bytes, lines, licence of the extraction gates
VIEW("card_bytes", r"""SELECT slot, octet_length(html) AS total, octet_length(array_join(regexp_extract_all(html, '(?is)<style\\b[^>]*>(.*?)</style>', 1), '')) AS css, octet_length(array_join(regexp_extract_all(html, '(?is)<script\\b[^>]*>(.*?)</script>', 1), '')) AS js FROM {cards}""",
     r"""SELECT slot, octet_length(encode(html)) AS total, octet_length(encode(array_to_string(regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style>', 1), ''))) AS css, octet_length(encode(array_to_string(regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script>', 1), ''))) AS js FROM {cards}""")
VIEW("output_gate", """SELECT slot, html LIKE '<!DOCTYPE html>%' OR html LIKE '<html%' AS starts, html LIKE '%</html>' AS ends, html LIKE '%```%' AS fenced, length(html) AS n FROM {cards}""")

QUERIES = """winner_per_config registry_totals facet_values facet_filter config_arms axis_filter effort_ladder_order browse_order coverage_gap growth_multiple valid_by_variant missing_batches readable_configs
 duplicate_ids constraint_violations default_session latest_per_model first_seen cost_estimate patch_lookup name_search job_queue_head board_cells vote_dedup_dwell arena_tallies pref_wilson leaderboard vote_counts
 issue_weights issued_pairs fresh_parts votes_export unconsumed_pairs daily_rate coord_tolerance_lookup tiered_lookup numbers card_bytes output_gate""".split()
