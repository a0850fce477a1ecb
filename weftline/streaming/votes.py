"""Votes, attempts and rate limits as streams and as batches with the same rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Tokens of the bucket and the seconds in which it fills.
TOKENS, REFILL_S = 30.0, 600.0


def single_use(votes: DataFrame, key: str = "pair_id", ts: str = "ts", delay: str = "15 minutes") -> DataFrame:
    """The first vote of each key within the watermark; later uses of the key are dropped."""
    return votes.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def in_time(pairs: DataFrame, votes: DataFrame, *more: str, least_ms: int = 2500, most_ms: int = 600_000) -> DataFrame:
    """Votes joined to the issue of their pair, if they come between ``least_ms`` and ``most_ms`` after it; ``more``: further
    columns of the issue."""
    p, v = pairs.withWatermark("issued", "15 minutes").alias("p"), votes.withWatermark("ts", "15 minutes").alias("v")
    on = F.expr(f"p.pair_id = v.pair_id AND v.ts >= p.issued + INTERVAL {least_ms} MILLISECONDS AND v.ts <= p.issued + INTERVAL {most_ms} MILLISECONDS")
    return p.join(v, on).select("v.*", "p.issued", *more)


def take(rows: pd.DataFrame, tokens: float, last: float | None) -> tuple[pd.DataFrame, float, float | None]:
    """One key's requests in order: whether each finds a token, and how many are left then."""
    allowed, left = [], []
    for t in rows["t"]:
        tokens = TOKENS if last is None else min(TOKENS, tokens + (t - last) * TOKENS / REFILL_S)
        last = t
        allowed.append(tokens >= 1)
        tokens -= tokens >= 1
        left.append(round(tokens, 4))
    return rows.assign(allowed=allowed, tokens=left), tokens, last


def token_bucket(requests: DataFrame) -> DataFrame:
    """``voter, event_id, allowed, tokens`` of stored requests (``voter, event_id, t`` in seconds)."""
    run = lambda rows: take(rows.sort_values(["t", "event_id"]), TOKENS, None)[0][["voter", "event_id", "allowed", "tokens"]]
    return requests.groupBy("voter").applyInPandas(run, "voter long, event_id long, allowed boolean, tokens double")


def token_bucket_stream(requests: DataFrame) -> DataFrame:
    """The same on a stream; a voter's state is two numbers and stays."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (TOKENS, None)
        rows, tokens, last = take(pd.concat(list(frames)).sort_values(["t", "event_id"]), tokens, last)
        state.update((float(tokens), float(last)))
        yield rows[["voter", "event_id", "allowed", "tokens"]]

    return requests.groupBy("voter").applyInPandasWithState(run, "voter long, event_id long, allowed boolean, tokens double", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def stream_pairs(spark, sf_dir: str, out: str) -> DataFrame:
    """Read the events as a stream, keep each (voter, type, minute) once, write a table and read it back."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    once = events.select(F.concat_ws("|", "user_id", "event_type", F.date_trunc("minute", "ts")).alias("pair_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("voter"), "event_type", F.date_format(F.date_trunc("minute", "ts"), "yyyy-MM-dd HH:mm").alias("minute"))
    query = single_use(once).select("voter", "event_type", "minute").writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{out}/table")
    query.awaitTermination()
    return spark.read.schema("voter long, event_type string, minute string").parquet(f"{out}/table")
