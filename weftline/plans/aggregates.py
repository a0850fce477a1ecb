"""Summary cells, descriptive statistics, merged consensus and findings over the channels of all cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import features
from weftline.plans import channels, similarity  # noqa: F401  their views
from weftline.plans.views import FRAME, VIEW

#: Gates of eligible cells, of the common scale and of the findings.
N_EFF_MIN, M_CROSS_MIN, LOCK_VALUES, LOCK_SPAN, CONSENSUS_CHANNELS = 4, 2, 8, 0.02, 6
DIVERGENCE_MIN, COHESION_MIN, REACH_MIN, LOWEST = 30, 10, 100, 8
#: All channels in their order, those that are shown and never counted, and those of the hypotheses.
REGISTRY = """v-phash v-dhash v-color v-palette v-layout v-edge v-ssim c-shingle c-winnow c-feature c-ast-js c-css-prop c-ncd d-geom d-text d-pqgram d-tagpath
 x-color x-css-values x-layout x-naming x-semantics""".split()
DIAGNOSTIC = ("c-ncd", "d-tagpath")
SCALARS = "colorfulness brightness contrast whitespace_ratio frame_change_median".split()
#: The channels that have scores of all slot pairs.
CHANNELS = {
    "c-shingle": "shingle_jaccard_pairs", "c-winnow": "winnow_jaccard_pairs", "c-feature": "feature_jaccard_pairs", "c-ast-js": "c_script_tokens_pairs", "c-css-prop": "c_css_prop_pairs",
    "d-geom": "layout_iou_pairs", "d-pqgram": "pqgram_dice_pairs", "d-tagpath": "tagpath_jaccard_pairs", "x-color": "x_color_pairs", "x-css-values": "x_css_values_pairs",
    "x-layout": "x_layout_pairs", "x-naming": "x_naming_pairs", "x-semantics": "x_semantics_pairs",
}
_FORMAL = ", ".join(f"'{c}'" for c in CHANNELS if c not in DIAGNOSTIC)
_ROWS = ", ".join(f"('{c}', {i}, '{c[0]}', {str(c not in DIAGNOSTIC).lower()}, {str(c not in DIAGNOSTIC and c[0] != 'x').lower()}, {str(c in CHANNELS).lower()})" for i, c in enumerate(REGISTRY))
VIEW("channel_list", f"SELECT * FROM (VALUES {_ROWS}) AS t(channel, ord, family, is_formal, in_hypotheses, in_summary)")
VIEW("channel_registry", """SELECT l.channel, l.ord, l.family, l.is_formal, l.in_hypotheses, l.in_summary, coalesce(n.n_scores, 0) AS n_scores, coalesce(n.n_null, 0) AS n_null FROM {channel_list} l
  LEFT JOIN (SELECT channel, count(s) AS n_scores, count(*) - count(s) AS n_null FROM {pair_scores} GROUP BY channel) n ON l.channel = n.channel""")
_L1 = ", ".join(f"('{c}', {100 + i})" for i, c in enumerate(SCALARS))
VIEW("hypothesis_family", f"""SELECT 'H-pooled-channel-' || channel AS hypothesis_id, 'channel' AS kind, channel AS target, ord, n_scores FROM {{channel_registry}} WHERE in_hypotheses
  UNION ALL SELECT 'H-pooled-l1-' || scalar, 'l1-scalar', scalar, ord, n FROM (VALUES {_L1}) AS s(scalar, ord), (SELECT count(*) AS n FROM {{cards}}) c""")

#: Which of them are sets or bags, and which are vectors, with the views that hold those.
SETS = {"c-shingle": "shingles_sets", "c-winnow": "winnow_sets", "c-feature": "feature_set_sets", "d-tagpath": "tag_paths_sets"}
VECTORS = {"c-ast-js": "script_bigrams", "c-css-prop": "css_properties", "x-color": "color_buckets", "x-css-values": "css_units", "x-layout": "layout_values", "x-naming": "naming_values", "x-semantics": "semantic_values"}


def pair_scores(spark, sf_dir, cards, layout, grams, *views):
    """The scores of all channels and slot pairs, a part for each channel."""
    named = dict(zip([*SETS, *VECTORS], views, strict=True))
    found = {c: features.jaccard_pairs(named[c]) for c in SETS} | {c: features.cosine_pairs(cards, named[c]) for c in VECTORS}
    found |= {"d-geom": layout, "d-pqgram": features.dice_pairs(cards, grams)}
    return [found[c].select("batch", "config_a", "config_b", "kind", "slot_a", "slot_b", F.lit(c).alias("channel"), "s") for c in CHANNELS]


FRAME("pair_scores", pair_scores, " UNION ALL ".join(f"SELECT batch, config_a, config_b, kind, slot_a, slot_b, '{c}' AS channel, s FROM {{{v + '_raw' * (c in VECTORS)}}}" for c, v in CHANNELS.items()),
      " ".join(["cards", "layout_iou_pairs", "pq_grams", *SETS.values(), *VECTORS.values()]))
VIEW("raw_cells", """SELECT batch, config_a, config_b, kind, channel, PCT(s, 0.5) AS median, PCT(s, 0.25) AS p25, PCT(s, 0.75) AS p75, count(s) AS n_eff, avg(s) AS mean FROM {pair_scores} GROUP BY batch, config_a, config_b, kind, channel""")
_OK = f"c.n_eff >= {N_EFF_MIN} AND (c.kind = 'self' OR a.m >= {M_CROSS_MIN} AND b.m >= {M_CROSS_MIN})"
VIEW("cells", f"""SELECT c.batch, c.config_a, c.config_b, c.kind, c.channel, CASE WHEN {_OK} THEN c.median END AS median, CASE WHEN {_OK} THEN c.p25 END AS p25, CASE WHEN {_OK} THEN c.p75 END AS p75,
  c.n_eff, a.m AS m_a, b.m AS m_b FROM {{raw_cells}} c JOIN {{slot_counts}} a ON c.batch = a.batch AND c.config_a = a.config JOIN {{slot_counts}} b ON c.batch = b.batch AND c.config_b = b.config""")
VIEW("summary_cells", "SELECT batch, config_a, config_b, kind, channel, round(median, 6) AS median, round(p25, 6) AS p25, round(p75, 6) AS p75, n_eff, m_a, m_b FROM {cells}")
VIEW("sufficient_cells", f"SELECT * FROM {{summary_cells}} WHERE median IS NOT NULL AND n_eff >= {N_EFF_MIN} AND (kind = 'self' OR m_a >= {M_CROSS_MIN} AND m_b >= {M_CROSS_MIN})")
VIEW("compact_summary", """SELECT c.batch, ch.id AS channel_id, a.id AS a_id, b.id AS b_id, round(c.median, 4) AS median, round(c.p25, 4) AS p25, round(c.p75, 4) AS p75, c.n_eff FROM {cells} c
  JOIN (SELECT channel, row_number() OVER (ORDER BY channel) - 1 AS id FROM (SELECT DISTINCT channel FROM {cells}) x) ch ON c.channel = ch.channel
  JOIN (SELECT config, row_number() OVER (ORDER BY config) - 1 AS id FROM (SELECT DISTINCT config FROM {slot_counts}) x) a ON c.config_a = a.config
  JOIN (SELECT config, row_number() OVER (ORDER BY config) - 1 AS id FROM (SELECT DISTINCT config FROM {slot_counts}) x) b ON c.config_b = b.config""")
VIEW("flagship_sync", """SELECT 'flagship' AS batch_id, c.channel, c.config_a, c.config_b, c.n_eff FROM {summary_cells} c JOIN {roster} a ON c.config_a = a.config JOIN {roster} b ON c.config_b = b.config""")
VIEW("roster", "SELECT DISTINCT config FROM {cards} WHERE config_ord < 6")

# descriptive statistics: m = 0 has no row, m = 1 has a null row
VIEW("channel_slots", "SELECT batch, config, channel, max(m) AS m FROM (SELECT m.batch, m.config, p.channel, m.m FROM {slot_counts} m JOIN (SELECT DISTINCT batch, channel FROM {pair_scores}) p ON m.batch = p.batch) x GROUP BY batch, config, channel")
VIEW("self_means", f"""SELECT m.batch, m.config, m.channel, m.m, coalesce(s.n, 0) AS n_eff, CASE WHEN s.n >= {N_EFF_MIN} THEN s.mean END AS mean FROM {{channel_slots}} m
  LEFT JOIN (SELECT batch, config_a, channel, count(s) AS n, avg(s) AS mean FROM {{pair_scores}} WHERE kind = 'self' GROUP BY batch, config_a, channel) s
  ON m.batch = s.batch AND m.config = s.config_a AND m.channel = s.channel""")
VIEW("self_consistency", "SELECT batch, config, channel, m, n_eff, round(mean, 6) AS self_mean FROM {self_means}")
VIEW("cross_means", f"""SELECT c.batch, c.config_a, c.config_b, c.channel, c.n_eff, CASE WHEN {_OK} THEN c.mean END AS mean, CASE WHEN {_OK} THEN c.median END AS median, CASE WHEN {_OK} THEN c.p75 - c.p25 END AS iqr
  FROM {{raw_cells}} c JOIN {{slot_counts}} a ON c.batch = a.batch AND c.config_a = a.config JOIN {{slot_counts}} b ON c.batch = b.batch AND c.config_b = b.config WHERE c.kind = 'cross'""")
VIEW("cross_cells", "SELECT batch, config_a, config_b, channel, n_eff, round(mean, 6) AS mean, round(median, 6) AS median, round(iqr, 6) AS iqr FROM {cross_means}")
VIEW("loro_runs", """SELECT batch, config_a AS config, channel, slot, sum(CAST(s AS DECIMAL(18, 12))) AS run_sum, count(s) AS run_n FROM (SELECT batch, config_a, channel, slot_a AS slot, s FROM {pair_scores} WHERE kind = 'self'
  UNION ALL SELECT batch, config_a, channel, slot_b, s FROM {pair_scores} WHERE kind = 'self') x GROUP BY batch, config_a, channel, slot""")
VIEW("loro_ranges", f"""SELECT r.batch, r.config, r.channel, round(min(CAST(t.total - r.run_sum AS DOUBLE) / (t.n - r.run_n)), 6) AS low, round(max(CAST(t.total - r.run_sum AS DOUBLE) / (t.n - r.run_n)), 6) AS high, count(*) AS n_drops
  FROM {{loro_runs}} r JOIN (SELECT batch, config_a AS config, channel, sum(CAST(s AS DECIMAL(18, 12))) AS total, count(s) AS n FROM {{pair_scores}} WHERE kind = 'self' GROUP BY batch, config_a, channel) t
  ON r.batch = t.batch AND r.config = t.config AND r.channel = t.channel WHERE t.n - r.run_n >= {N_EFF_MIN} GROUP BY r.batch, r.config, r.channel""")
VIEW("mirrored", """SELECT batch, channel, config_a AS config, config_b AS other, mean FROM {cross_means} WHERE mean IS NOT NULL UNION ALL SELECT batch, channel, config_b, config_a, mean FROM {cross_means} WHERE mean IS NOT NULL""")
VIEW("nearest", """SELECT batch, channel, config, other AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY batch, channel, config ORDER BY round(mean, 9) DESC, other) AS r FROM {mirrored}) x WHERE r = 1""")
VIEW("separation_distinctiveness", """SELECT s.batch, s.config, s.channel, CASE WHEN o.n * 5 >= (t.n - 1) * 4 THEN round(s.mean - o.mean, 5) + CAST(0 AS DOUBLE) END AS separation, round(1 - o.most, 6) + CAST(0 AS DOUBLE) AS distinctiveness, o.n AS n_others, n.nearest
  FROM {self_means} s JOIN (SELECT batch, channel, config, avg(mean) AS mean, max(mean) AS most, count(*) AS n FROM {mirrored} GROUP BY batch, channel, config) o ON s.batch = o.batch AND s.channel = o.channel AND s.config = o.config
  JOIN (SELECT batch, count(*) AS n FROM {slot_counts} GROUP BY batch) t ON s.batch = t.batch JOIN {nearest} n ON s.batch = n.batch AND s.channel = n.channel AND s.config = n.config""")

# the common scale of channels and what is built on it
VIEW("lock", f"""SELECT batch, channel, PCT(median, 0.01) AS lo, PCT(median, 0.99) AS hi, count(*) AS n_cross FROM {{cells}} WHERE kind = 'cross' AND median IS NOT NULL AND channel IN ({_FORMAL}) GROUP BY batch, channel
  HAVING count(*) >= {LOCK_VALUES} AND PCT(median, 0.99) - PCT(median, 0.01) >= {LOCK_SPAN}""")
VIEW("merge_domain", "SELECT batch, channel, round(lo, 6) AS lo, round(hi, 6) AS hi, n_cross FROM {lock}")
VIEW("stretched", """SELECT c.batch, c.config_a, c.config_b, c.kind, c.channel, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (c.median - l.lo) / (l.hi - l.lo))) AS v, c.median <= l.lo OR c.median >= l.hi AS clamped
  FROM {cells} c JOIN {lock} l ON c.batch = l.batch AND c.channel = l.channel WHERE c.median IS NOT NULL""")
VIEW("merged", f"SELECT batch, config_a, config_b, kind, avg(v) AS merged, count(*) AS n_channels FROM {{stretched}} GROUP BY batch, config_a, config_b, kind HAVING count(*) >= {CONSENSUS_CHANNELS}")
VIEW("merged_consensus", "SELECT batch, config_a, config_b, kind, round(merged, 6) AS merged, n_channels FROM {merged}")
VIEW("clamp_rate", "SELECT batch, channel, kind, count(*) AS n, round(avg(CASE WHEN clamped THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS clamp_rate FROM {stretched} GROUP BY batch, channel, kind")
VIEW("families", "SELECT DISTINCT config, 'f' || CAST(config_ord % 3 AS STRING) AS family FROM {cards}")
VIEW("merged_families", """SELECT m.batch, m.kind, m.merged, m.config_a, m.config_b, a.family AS fa, b.family AS fb FROM {merged} m JOIN {families} a ON m.config_a = a.config JOIN {families} b ON m.config_b = b.config""")
VIEW("midranks", """SELECT batch, fa = fb AS within, rank() OVER (PARTITION BY batch ORDER BY round(merged, 9)) + (count(*) OVER (PARTITION BY batch, round(merged, 9)) - 1) / 2 AS midrank FROM {merged_families} WHERE kind = 'cross'""")
VIEW("family_auc", """SELECT batch, n1, n0, round((r1 - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM (SELECT batch, count(*) FILTER (WHERE within) AS n1, count(*) FILTER (WHERE NOT within) AS n0, sum(midrank) FILTER (WHERE within) AS r1
  FROM {midranks} GROUP BY batch) x WHERE n1 > 0 AND n0 > 0""")
VIEW("merged_sides", """SELECT config_a AS config, fa AS family, fa = fb AS same, merged FROM {merged_families} WHERE kind = 'cross' UNION ALL SELECT config_b, fb, fa = fb, merged FROM {merged_families} WHERE kind = 'cross'""")
VIEW("divergence", f"""SELECT config, n, mean FROM (SELECT *, row_number() OVER (ORDER BY mean, config) AS r FROM (SELECT config, count(*) AS n, round(avg(merged), 6) AS mean FROM {{merged_sides}} GROUP BY config HAVING count(*) >= {DIVERGENCE_MIN}) x) y WHERE r <= {LOWEST}""")
VIEW("least_consistent", f"""SELECT config, n, mean FROM (SELECT *, row_number() OVER (ORDER BY mean, config) AS r FROM (SELECT config_a AS config, count(*) AS n, round(avg(merged), 6) AS mean FROM {{merged_families}} WHERE kind = 'self' GROUP BY config_a) x) y WHERE r <= {LOWEST}""")
VIEW("findings_report", f"""SELECT CASE WHEN fa = fb THEN 'within family' ELSE 'between families' END AS section, 'all' AS name, count(*) AS n, round(avg(merged), 6) AS mean FROM {{merged_families}} WHERE kind = 'cross' GROUP BY fa = fb
  UNION ALL SELECT 'self-consistency', 'all', count(*), round(avg(merged), 6) FROM {{merged_families}} WHERE kind = 'self' HAVING count(*) > 0
  UNION ALL SELECT 'most divergent', config, n, mean FROM {{divergence}} UNION ALL SELECT 'least self-consistent', config, n, mean FROM {{least_consistent}}
  UNION ALL SELECT 'cohesion', fa, count(*), round(avg(merged), 6) FROM {{merged_families}} WHERE kind = 'cross' AND fa = fb GROUP BY fa HAVING count(*) >= {COHESION_MIN}
  UNION ALL SELECT 'reach', family, count(*), round(avg(merged), 6) FROM {{merged_sides}} WHERE NOT same GROUP BY family HAVING count(*) >= {REACH_MIN}""")
VIEW("most_divergent", "SELECT batch, config_a, config_b, round(merged, 6) AS merged FROM {merged} WHERE kind = 'cross' ORDER BY round(merged, 6), batch, config_a, config_b LIMIT 8")
VIEW("neighbor_ranks", """SELECT *, row_number() OVER (PARTITION BY batch, channel, config ORDER BY round(mean, 9) DESC, other) AS near, row_number() OVER (PARTITION BY batch, channel, config ORDER BY round(mean, 9), other) AS far,
  count(*) OVER (PARTITION BY batch, channel, config) AS n FROM {mirrored}""")
VIEW("neighbors_head_tail", "SELECT batch, channel, config, other, near, round(mean, 6) AS mean FROM {neighbor_ranks} WHERE n <= 10 OR near <= 5 OR far <= 5")
VIEW("cluster_runs", """SELECT batch, channel, config, run, count(*) AS length, min(near) AS first_place FROM (SELECT *, sum(changed) OVER (PARTITION BY batch, channel, config ORDER BY near) AS run FROM
  (SELECT *, CASE WHEN floor(mean * 10) = lag(floor(mean * 10)) OVER (PARTITION BY batch, channel, config ORDER BY near) THEN 0 ELSE 1 END AS changed FROM {neighbor_ranks}) x) y GROUP BY batch, channel, config, run""",
  """SELECT batch, channel, config, CAST(run AS BIGINT) AS run, count(*) AS length, min(near) AS first_place FROM (SELECT *, sum(changed) OVER (PARTITION BY batch, channel, config ORDER BY near) AS run FROM
  (SELECT *, CASE WHEN floor(mean * 10) = lag(floor(mean * 10)) OVER (PARTITION BY batch, channel, config ORDER BY near) THEN 0 ELSE 1 END AS changed FROM {neighbor_ranks}) x) y GROUP BY batch, channel, config, run""")
VIEW("display_contrast", """SELECT batch, channel, CASE WHEN count(*) >= 8 AND PCT(median, 0.95) - PCT(median, 0.05) >= 0.02 THEN round(PCT(median, 0.05), 6) END AS lo,
  CASE WHEN count(*) >= 8 AND PCT(median, 0.95) - PCT(median, 0.05) >= 0.02 THEN round(PCT(median, 0.95), 6) END AS hi FROM {cells} WHERE kind = 'cross' AND median IS NOT NULL GROUP BY batch, channel""")
VIEW("mirrored_lookup", """SELECT config_a AS row_config, config_b AS column_config, batch, channel, median FROM {summary_cells}
  UNION ALL SELECT config_b, config_a, batch, channel, median FROM {summary_cells} WHERE kind = 'cross'""")

QUERIES = """channel_registry hypothesis_family summary_cells sufficient_cells compact_summary flagship_sync self_consistency cross_cells loro_ranges separation_distinctiveness merge_domain merged_consensus clamp_rate
 family_auc findings_report most_divergent neighbors_head_tail cluster_runs display_contrast mirrored_lookup""".split()
