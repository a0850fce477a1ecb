"""Streams against the batch rules, also for late events and after a restart."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.streaming import positions

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events(seed=3, n=600):
    rng, start = random.Random(seed), datetime(2024, 5, 1, 20)
    return [(i, start + timedelta(seconds=rng.randint(0, 3 * 86_400)), rng.randint(1, 12), rng.choice(["view", "click", "purchase", *["error"] * 6]), rng.random()) for i in range(n)]


def put(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def by_day(rows):
    days = {}
    for i, ts, user, kind, _ in rows:
        days.setdefault((user, ts.date().isoformat()), []).append((ts, i, kind))
    return {k: positions.outcome([kind for *_, kind in sorted(v)]) for k, v in days.items()}


def test_outcomes():
    assert positions.outcome(["error", "click", "purchase"]) == ("truncated", 2)
    assert positions.outcome(["error"] * 4) == ("missing", 4) and positions.outcome(["error"] * 6) == ("infra_error", 6)
    assert positions.outcome(["error"] * 5 + ["purchase"]) == ("infra_error", 6)


def test_positions_wait_for_late_events_and_go_on_after_a_restart(spark, tmp_path):
    rows = sorted(events(), key=lambda r: r[1])
    for k in range(0, 600, 2):  # neighbours come in the wrong order
        rows[k], rows[k + 1] = rows[k + 1], rows[k]
    path, out = str(tmp_path / "events"), str(tmp_path / "out")
    put(spark, rows[:250], path)
    first = positions.position_table(spark, path, out, files=1).count()
    put(spark, rows[250:420], path)
    put(spark, rows[420:], path)
    got = {(r.voter, r.day): (r.state, r.n_attempts) for r in positions.position_table(spark, path, out, files=1).collect()}
    passed = max(r[1] for r in rows) - timedelta(minutes=15)
    want = {k: v for k, v in by_day(rows).items() if datetime.fromisoformat(k[1]) + timedelta(days=1) < passed}
    assert got == want and 0 < first < len(got)


def test_votes_in_time_equal_a_join(spark, tmp_path):
    rng, start = random.Random(5), datetime(2024, 5, 1)
    rows = sorted(((i, start + timedelta(milliseconds=rng.randint(0, 4_000_000)), rng.randint(1, 4), rng.choice(["view", "click"]), 1.0) for i in range(300)), key=lambda r: r[1])
    path = str(tmp_path / "events")
    for k in range(0, 300, 100):
        put(spark, rows[k : k + 100], path)
    got = sorted((r.issue, r.vote) for r in positions.votes_in_time(spark, path, str(tmp_path / "out"), files=1).collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[2] == b[2] and a[3] == "view" and b[3] == "click" and timedelta(milliseconds=2500) <= b[1] - a[1] <= timedelta(minutes=10))
    assert got == want and want


def test_tallies_equal_the_batch_after_each_run_and_a_repeated_batch(spark, tmp_path):
    path, out, rows = str(tmp_path / "events"), str(tmp_path / "out"), events(7, 300)
    key = lambda df: sorted((r.window_start, r.event_type, r.n, round(float(r.total), 4)) for r in df.collect())
    for k in (100, 200, 300):
        put(spark, rows[k - 100 : k], path)
        got = key(positions.tally_table(spark, path, out, files=1))
        assert got == key(positions.tally(spark.createDataFrame(rows[:k], SCHEMA)).withColumn("total", F.round(F.col("total").cast("double"), 4)))
    positions.tally(spark.createDataFrame(rows[200:], SCHEMA)).write.mode("overwrite").parquet(f"{out}/partials/batch=2")  # a batch that ran again
    assert key(positions.tallies(spark, out)) == got


@pytest.mark.parametrize("name", ["a.parquet", "folder"])
def test_a_table_of_one_file_is_a_stream_too(spark, tmp_path, name):
    put(spark, events(1, 10), str(tmp_path / name))
    assert positions.events_stream(spark, str(tmp_path / name)).isStreaming


def test_positions_need_no_python_and_follow_the_clock_of_the_session(spark, tmp_path):
    """A day is a day of the session's time zone, and an event without type counts as an answer."""
    rows = [(0, datetime(2024, 5, 1, 22), 1, "error", 1.0), (1, datetime(2024, 5, 2, 2), 1, None, 1.0), (2, datetime(2024, 5, 2, 5), 1, "view", 1.0), (3, datetime(2024, 5, 4), 2, "view", 1.0)]
    path = str(tmp_path / "events")
    put(spark, rows, path)
    plan = positions.positions(positions.events_stream(spark, path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "PySpark" not in plan
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 4 hours behind
    try:
        got = {(r.voter, r.day): (r.state, r.n_attempts) for r in positions.position_table(spark, path, str(tmp_path / "out")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {(1, "2024-05-01"): ("refused", 2), (1, "2024-05-02"): ("empty", 1)}
