"""The family of hypotheses tested: each configuration's pages in two variants, five blocks of both."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import raster
from weftline.operators import hypotheses as randomized
from weftline.plans import aggregates, visual  # noqa: F401  their views
from weftline.plans.views import FRAME, SHARED, VIEW

# configurations k and k + 5 of a batch are the two variants of one: all pairs of their ten pages have scores
VIEW("hypothesis_list", f"SELECT 'channel' AS kind, channel AS target, ord FROM {{channel_list}} WHERE in_hypotheses UNION ALL SELECT 'l1-scalar', scalar, ord FROM (VALUES {aggregates._L1}) AS s(scalar, ord)")
VIEW("sided_slots", "SELECT batch, config_ord % 5 AS config_ord, CASE WHEN config_ord < 5 THEN 0 ELSE 1 END AS side, slot FROM {cards}")
VIEW("tested_pairs", """SELECT channel, slot_a, slot_b, s FROM (SELECT channel, config_a, config_b, slot_a, slot_b, s FROM {pair_scores} UNION ALL SELECT channel, config_a, config_b, slot_a, slot_b, s FROM {visual_pairs}) p
  WHERE CAST(substr(config_a, 2) AS INT) % 5 = CAST(substr(config_b, 2) AS INT) % 5 AND channel IN (SELECT target FROM {hypothesis_list} WHERE kind = 'channel')""")
FRAME("page_scalars", lambda s, d, pages, pictures: visual.of_pages(pages, visual.each_picture(pictures, raster.page_scalars, "scalar string, v double")), "", "painted pictures")
FRAME("t_tables", lambda s, d, slots, pairs, scalars: randomized.t_tables(randomized.unit_runs(slots), pairs, scalars), "", "sided_slots tested_pairs page_scalars")
FRAME("exploratory_hypotheses", lambda s, d, t: randomized.exploratory(t).withColumns({c: F.round(c, 9) for c in ("t_obs", "p")}), "", "t_tables")
FRAME("pooled_hypotheses", lambda s, d, t, family: randomized.pooled(t, family), "", "t_tables hypothesis_list")
SHARED |= {"t_tables"}

ROWS_ONLY = "page_scalars exploratory_hypotheses pooled_hypotheses".split()
