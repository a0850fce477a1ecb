"""State machines, streams and grouped operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import grouped
from weftline.plans import aggregates, facts, inference, serving, similarity  # noqa: F401  their views
from weftline.plans.views import FRAME, VIEW, VIEWS
from weftline.sources.shared import shared_folder
from weftline.streaming import positions
from weftline.streaming import votes as streams

# attempts of a position until one reaches the model: five unsent ones end it
VIEW("attempts", """SELECT user_id AS voter, CAST(CAST(ts AS DATE) AS STRING) AS day, event_id, event_type, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS nth,
  count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS unsent FROM {events}""",
  )
VIEWS["attempts"].text = """SELECT user_id AS voter, CAST(CAST(ts AS DATE) AS STRING) AS day, event_id, event_type, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS nth,
  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS unsent FROM {events}"""
VIEW("ends", "SELECT voter, day, min(CASE WHEN event_type <> 'error' THEN nth END) AS reached, min(CASE WHEN unsent >= 5 THEN nth END) AS exhausted, count(*) AS n FROM {attempts} GROUP BY voter, day")
VIEW("slot_fsm", """SELECT e.voter, e.day, CASE WHEN e.reached IS NOT NULL AND (e.exhausted IS NULL OR e.reached < e.exhausted) THEN CASE a.event_type WHEN 'purchase' THEN 'valid' WHEN 'view' THEN 'empty' WHEN 'click' THEN 'truncated' ELSE 'refused' END
  WHEN e.exhausted IS NOT NULL THEN 'infra_error' ELSE 'missing' END AS state, coalesce(e.reached, e.n) AS n_attempts FROM {ends} e LEFT JOIN {attempts} a ON e.voter = a.voter AND e.day = a.day AND e.reached = a.nth""")
VIEW("stream_folds", """SELECT conv_id, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars, bool_or(role = 'assistant') AS answered, max_by(role, turn) AS last_role,
  CASE WHEN max_by(role, turn) = 'assistant' THEN 'done' ELSE 'infra_error' END AS state FROM {conversations} GROUP BY conv_id""")
VIEW("sessions", """SELECT voter, session, count(*) AS n FROM (SELECT user_id AS voter, sum(CASE WHEN gap IS NULL OR gap > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM
  (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM {events}) x) y GROUP BY voter, session""")
VIEWS["sessions"].text = VIEWS["sessions"].text.replace("CAST(floor(epoch(ts)) AS BIGINT)", "unix_seconds(CAST(ts AS TIMESTAMP))")
VIEWS["sessions"].duck = VIEWS["sessions"].duck.replace("SELECT user_id AS voter, sum(", "SELECT user_id AS voter, CAST(sum(").replace("ORDER BY ts, event_id) AS session", "ORDER BY ts, event_id) AS BIGINT) AS session")
FRAME("token_bucket", lambda s, d, events: streams.token_bucket(events.select(F.col("user_id").alias("voter"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))),
  """SELECT voter, event_id, allowed, tokens FROM (WITH RECURSIVE steps AS (SELECT voter, event_id, t, r, CAST(30 AS DOUBLE) >= 1 AS allowed, CAST(29 AS DOUBLE) AS left_over FROM requests WHERE r = 1
     UNION ALL SELECT q.voter, q.event_id, q.t, q.r, least(30.0::DOUBLE, s.left_over + (q.t - s.t) * 30 / 600) >= 1, least(30.0::DOUBLE, s.left_over + (q.t - s.t) * 30 / 600) - CASE WHEN least(30.0::DOUBLE, s.left_over + (q.t - s.t) * 30 / 600) >= 1 THEN 1 ELSE 0 END
     FROM steps s JOIN requests q ON s.voter = q.voter AND q.r = s.r + 1) SELECT voter, event_id, allowed, round(left_over, 4) AS tokens FROM steps)""", "events")
VIEW("requests", "SELECT user_id AS voter, event_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM {events}")
VIEWS["token_bucket"].duck = VIEWS["token_bucket"].duck.replace("requests WHERE", "{requests} WHERE", 1)


FRAME("vote_stream", lambda s, d, events: streams.stream_pairs(s, d, shared_folder(s, "stream")), "SELECT DISTINCT user_id AS voter, event_type, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events", "events")

# the same rules as streams: positions by timers, votes in time by an interval join, tallies kept up to date by batch
FRAME("position_stream", lambda s, d, events: positions.position_table(s, f"{d}/events.parquet", shared_folder(s, "positions")), "SELECT * FROM {slot_fsm} WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY < (SELECT max(ts) - INTERVAL 15 MINUTE FROM events)", "events")
FRAME("votes_in_time", lambda s, d, events: positions.votes_in_time(s, f"{d}/events.parquet", shared_folder(s, "in-time")), """SELECT p.event_id AS issue, v.event_id AS vote, p.user_id AS voter FROM events p JOIN events v ON p.user_id = v.user_id AND p.event_type = 'view' AND v.event_type = 'click'
  AND v.ts >= p.ts + INTERVAL 2500 MILLISECONDS AND v.ts <= p.ts + INTERVAL 600 SECONDS""", "events")
FRAME("tally_stream", lambda s, d, events: positions.tally_table(s, f"{d}/events.parquet", shared_folder(s, "tallies")), "SELECT * FROM {five_minute_stats}", "events")

# dates of several spellings, decimals at display precision, binding of labelled values
VIEW("date_spellings", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
  WHEN 1 THEN CAST(day(o_orderdate) AS STRING) || '.' || CAST(month(o_orderdate) AS STRING) || '.' || CAST(year(o_orderdate) AS STRING) ELSE CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING) END AS shown FROM {orders}""")
VIEW("judge_date", """SELECT o_orderkey, shown, CASE WHEN shown LIKE '%-%' THEN CAST(shown AS DATE) WHEN shown LIKE '%.%' THEN make_date(CAST(split_part(shown, '.', 3) AS INT), CAST(split_part(shown, '.', 2) AS INT), CAST(split_part(shown, '.', 1) AS INT))
  ELSE make_date(CAST(split_part(shown, '/', 3) AS INT), CAST(split_part(shown, '/', 1) AS INT), CAST(split_part(shown, '/', 2) AS INT)) END = d AS match FROM {date_spellings}""")
VIEW("value_state", """SELECT l_orderkey, l_linenumber, CASE WHEN abs(floor(l_extendedprice + 0.5) - floor(l_extendedprice * (1 - l_discount) + 0.5)) = 0 THEN 'match' WHEN l_discount > 0.05 THEN 'mismatch' ELSE 'not-shown' END AS state FROM {lineitem}""")
VIEW("field_states", "SELECT l_orderkey, count(*) FILTER (WHERE state = 'match') AS n_match, count(*) FILTER (WHERE state = 'mismatch') AS n_mismatch, CAST(count(*) FILTER (WHERE state <> 'not-shown') AS STRING) || '/' || CAST(count(*) AS STRING) AS coverage, CASE WHEN bool_or(state = 'mismatch') THEN 'fail' WHEN bool_or(state = 'match') THEN 'pass' ELSE 'void' END AS verdict FROM {value_state} GROUP BY l_orderkey")
VIEW("label_binding", """SELECT l_orderkey, -r.x AS max_line, -r.y AS min_line FROM (SELECT a.l_orderkey, max(named_struct('near', -abs(a.l_linenumber - b.l_linenumber), 'more', a.l_quantity - b.l_quantity, 'x', -a.l_linenumber, 'y', -b.l_linenumber)) AS r
  FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_quantity > b.l_quantity AND a.l_linenumber <> b.l_linenumber GROUP BY a.l_orderkey) x""",
  """SELECT l_orderkey, max_line, min_line FROM (SELECT a.l_orderkey, a.l_linenumber AS max_line, b.l_linenumber AS min_line, row_number() OVER (PARTITION BY a.l_orderkey ORDER BY abs(a.l_linenumber - b.l_linenumber), a.l_quantity - b.l_quantity DESC, a.l_linenumber, b.l_linenumber) AS r
  FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_quantity > b.l_quantity AND a.l_linenumber <> b.l_linenumber) x WHERE r = 1""")
VIEW("text_base", "SELECT conv_id, turn, coalesce(CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS base FROM {conversations}")
VIEW("terminal_states", "SELECT event_id, CASE event_type WHEN 'error' THEN 'infra_error' WHEN 'purchase' THEN 'valid' WHEN 'signup' THEN 'refused' ELSE 'empty' END AS state, event_type <> 'error' AS charged FROM {events}")

# grouped operators, checked by rows and in the tests
FRAME("bradley_terry", lambda s, d, accepted: grouped.bradley_terry(accepted), "", "accepted")
FRAME("upgma_order", lambda s, d, cells: grouped.upgma_order(cells), "", "cells")
FRAME("ncd_pairs", lambda s, d, cards: grouped.compression_pairs(cards), "", "cards")
FRAME("pooled_permutation", lambda s, d, blocks: grouped.pooled_permutation(blocks), "", "block_groups")
FRAME("assignment_table", lambda s, d, cards: grouped.assignment_table(cards.select(F.sha2(F.col("batch").cast("string"), 256).alias("manifest_hash"), "config_ord", F.col("config").alias("config_id"), F.lit(5).alias("n")).distinct()), "", "cards")
FRAME("hourly_assignment", lambda s, d, blocks: grouped.hourly_assignment(blocks.select("unit", F.col("block").cast("long").alias("point"), F.col("run_min").alias("value"))), "", "block_groups")
FRAME("visual_signatures", lambda s, d, e: grouped.visual_signatures(e.select("vec_id", "embedding")), "", "embeddings")
FRAME("ssim_pairs", lambda s, d, e: grouped.structural_similarity(_vector_pairs(e)), "", "embeddings")


def _vector_pairs(e):
    near = e.withColumn("g", F.floor(F.col("vec_id") / 20))
    b = near.select("g", F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return near.select("g", F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(b, "g").filter("a < b").select("a", "b", "x", "y")


QUERIES = "position_stream votes_in_time tally_stream slot_fsm stream_folds sessions token_bucket vote_stream judge_date value_state field_states label_binding text_base terminal_states".split()
ROWS_ONLY = "assignment_table bradley_terry upgma_order ncd_pairs pooled_permutation hourly_assignment visual_signatures ssim_pairs".split()
