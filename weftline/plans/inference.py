"""Randomization inference: assignments, relabelled statistics, exact p-values and Holm's correction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.views import FRAME, VIEW

# a configuration's blocks: five orders of a customer in order of key make a run pair (min, q) each
VIEW("blocks", """SELECT c.c_custkey AS config, CAST(row_number() OVER (PARTITION BY c.c_custkey ORDER BY o.o_orderkey) - 1 AS INT) AS block, CAST(round(o.o_totalprice) AS BIGINT) % 97 AS run_min, CAST(round(o.o_totalprice) AS BIGINT) % 89 AS run_q,
  CAST(o.o_orderkey % 2 AS INT) AS bit FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""")
VIEW("block_groups", "SELECT config * 1000 + CAST(floor(block / 5) AS BIGINT) AS unit, block % 5 AS block, run_min, run_q, bit FROM {blocks}")
VIEW("units", "SELECT unit, count(*) AS n FROM {block_groups} GROUP BY unit HAVING count(*) >= 2")
VIEW("sizes", "SELECT DISTINCT n FROM {units}")
VIEW("omega", """SELECT n, bits FROM (SELECT n, explode(sequence(0, CAST(pow(2, n) AS INT) - 1)) AS bits FROM {sizes}) x WHERE abs(n - 2 * bit_count(bits)) <= 1""",
     """SELECT n, bits FROM (SELECT n, CAST(unnest(range(0, CAST(pow(2, n) AS BIGINT))) AS INT) AS bits FROM {sizes}) x WHERE abs(n - 2 * bit_count(bits)) <= 1""")
VIEW("omega_space", "SELECT n, count(*) AS omega_size, CAST(sum(bits) AS BIGINT) AS bit_sum FROM {omega} GROUP BY n")
# Spark holds a unit as one row, its assignments and their T in lists beside it: no row is made, joined or summed for an
# assignment and block
FRAME("relabelled", lambda s, d, blocks: _relabelled(blocks), """SELECT u.unit, o.bits, avg(CASE WHEN CAST(floor(o.bits / pow(2, g.block)) AS INT) % 2 = g.bit THEN g.run_q - g.run_min ELSE g.run_min - g.run_q END) AS t
  FROM {units} u JOIN {omega} o ON u.n = o.n JOIN {block_groups} g ON u.unit = g.unit GROUP BY u.unit, o.bits""", "block_groups")
VIEW("observed", "SELECT unit, avg(run_q - run_min) AS t_obs FROM {block_groups} GROUP BY unit")
VIEW("t_table", "SELECT unit, x.bits, round(x.t, 6) AS t FROM (SELECT unit, explode(arrays_zip(bits, t)) AS x FROM {relabelled}) y", "SELECT unit, bits, round(t, 6) AS t FROM {relabelled}")
VIEW("p_values", "SELECT unit, round(t_obs, 6) AS t_obs, CAST(size(t) AS BIGINT) AS omega_size, CAST(size(filter(t, x -> round(abs(x), 6) >= round(abs(t_obs), 6))) AS BIGINT) / CAST(size(t) AS BIGINT) AS p FROM {relabelled}",
     "SELECT r.unit, round(o.t_obs, 6) AS t_obs, count(*) AS omega_size, count(*) FILTER (WHERE round(abs(r.t), 6) >= round(abs(o.t_obs), 6)) / count(*) AS p FROM {relabelled} r JOIN {observed} o ON r.unit = o.unit GROUP BY r.unit, o.t_obs")
VIEW("exploratory_p", "SELECT unit, t_obs, omega_size, round(p, 6) AS p FROM {p_values}")
VIEW("holm_ranks", "SELECT floor(unit / 100000) AS family, unit, p, row_number() OVER (PARTITION BY floor(unit / 100000) ORDER BY p, unit) AS r, count(*) OVER (PARTITION BY floor(unit / 100000)) AS k FROM {p_values}")
VIEW("holm_adjust", "SELECT unit, round(p, 6) AS p, round(max(least(CAST(1 AS DOUBLE), (k - r + 1) * p)) OVER (PARTITION BY family ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS p_holm FROM {holm_ranks}")
VIEW("seed_assign", "SELECT c_custkey AS config, SHA(CAST(c_custkey AS STRING) || ':' || c_name) AS digest, substr(SHA(CAST(c_custkey AS STRING) || ':' || c_name), 1, 16) AS seed_hex FROM {customer}")
VIEW("coverage_string", "SELECT c_mktsegment AS segment, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS b, CAST(count(*) FILTER (WHERE c_acctbal > 0) AS STRING) || '/' || CAST(count(*) AS STRING) AS coverage, count(*) FILTER (WHERE c_acctbal > 0) * 5 >= (count(*) - 1) * 4 AS enough FROM {customer} GROUP BY c_mktsegment")


def _relabelled(blocks: DataFrame) -> DataFrame:
    """``unit, t_obs, bits, t``: the balanced assignments of a unit of two blocks or more in order, and T of each."""
    units = blocks.groupBy("unit").agg(F.collect_list(F.struct("block", "bit", (F.col("run_q") - F.col("run_min")).alias("x"))).alias("b")).filter("size(b) >= 2")
    held = units.withColumns({
        "bits": F.expr("filter(sequence(0, CAST(pow(2, size(b)) AS INT) - 1), o -> abs(size(b) - 2 * bit_count(o)) <= 1)"), "n": F.expr("nullif(size(filter(b, e -> e.x IS NOT NULL)), 0)"),
    })
    signed = "aggregate(b, 0L, (s, e) -> s + coalesce(CASE WHEN (shiftright(o, e.block) & 1) = e.bit THEN e.x ELSE -e.x END, 0L))"
    return held.select("unit", F.expr("aggregate(b, 0L, (s, e) -> s + coalesce(e.x, 0L)) / n").alias("t_obs"), "bits", F.expr(f"transform(bits, o -> {signed} / n)").alias("t"))


QUERIES = "omega_space t_table exploratory_p holm_adjust seed_assign coverage_string".split()
