"""Positions, votes in time and tallies as streams whose results equal the batch queries on the same events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.streaming.votes import in_time

#: Unsent attempts that end a position, minutes that late events may take, minutes of one slot of tallies.
UNSENT, LATE_MIN, SLOT_MIN = 5, 15, 5
#: What the first attempt that reaches the model makes of a position.
REACHED = {"purchase": "valid", "view": "empty", "click": "truncated"}
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def outcome(kinds: list[str]) -> tuple[str, int]:
    """State and number of attempts of a position's events in order: the first that is no error fills it, the fifth error
    ends it. The rule in plain Python, which the stream is held against."""
    errors = 0
    for n, kind in enumerate(kinds, 1):
        errors += kind == "error"
        if kind != "error":
            return REACHED.get(kind, "refused"), n
        if errors >= UNSENT:
            return "infra_error", len(kinds) if not any(k != "error" for k in kinds[n:]) else next(i for i, k in enumerate(kinds, 1) if k != "error")
    return "missing", len(kinds)


def positions(events: DataFrame) -> DataFrame:
    """``voter, day, state, n_attempts`` of each voter's day once the watermark has passed it; ``events`` is a stream.

    A day is a window of the session's clock. Its events are kept in whatever order they come, and :func:`outcome` of
    them in order is an expression over the list, so that no row and no key goes through Python.
    """
    ts = F.col("ts").cast("timestamp")
    clock = F.from_utc_timestamp(ts, events.sparkSession.conf.get("spark.sql.session.timeZone"))
    rows = events.select(F.col("user_id").alias("voter"), clock.alias("clock"), F.struct(F.unix_micros(ts).alias("t"), "event_id", "event_type").alias("e")).withWatermark("clock", f"{LATE_MIN} minutes")
    days = rows.groupBy(F.window("clock", "1 day").alias("w"), "voter").agg(F.array_sort(F.collect_list("e")).alias("e"))
    kinds = days.select("voter", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros("w.start") / 86_400_000_000).cast("int")).cast("string").alias("day"), F.transform("e", lambda x: F.coalesce(x["event_type"], F.lit("none"))).alias("kinds"))
    first = F.array_position(F.transform("kinds", lambda k: k != "error"), F.lit(True))  # 0: all are errors
    found = kinds.withColumn("errors", F.when(first > 0, first - 1).otherwise(F.size("kinds"))).withColumn("kind", F.get("kinds", F.col("errors").cast("int")))
    made = F.coalesce(F.create_map(*[F.lit(x) for pair in REACHED.items() for x in pair])[F.col("kind")], F.lit("refused"))
    state = F.when(F.col("errors") >= UNSENT, "infra_error").when(F.col("kind").isNull(), "missing").otherwise(made)
    return found.select("voter", "day", state.alias("state"), F.least(F.col("errors") + 1, F.size("kinds")).cast("long").alias("n_attempts"))


def events_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A table of events, or a folder of such, as a stream of at most ``files`` new files at a time."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path if "." not in path.rpartition("/")[2] else path[:-1] + f"[{path[-1]}]")


def run(stream: DataFrame, out: str) -> None:
    """Write all that the stream has now, and go on where an earlier run ended."""
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{out}/table").awaitTermination()


def position_table(spark: SparkSession, path: str, out: str, files: int | None = None) -> DataFrame:
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # open days are on disk and not in the heap
    try:
        run(positions(events_stream(spark, path, files)), out)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema("voter long, day string, state string, n_attempts long").parquet(f"{out}/table")


def votes_in_time(spark: SparkSession, path: str, out: str, files: int | None = None) -> DataFrame:
    """``issue, vote, voter``: clicks between 2.5 seconds and ten minutes after a view of the same voter, by an interval join
    of two streams, whose watermarks bound what either side remembers."""
    both = events_stream(spark, path, files).select("event_id", F.col("user_id").alias("pair_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    issued = both.filter("event_type = 'view'").select("pair_id", F.col("ts").alias("issued"), F.col("event_id").alias("issue"))
    cast = both.filter("event_type = 'click'").select("pair_id", "ts", F.col("event_id").alias("vote"))
    run(in_time(issued, cast, "p.issue").select("issue", "vote", F.col("pair_id").alias("voter")), out)
    return spark.read.schema("issue long, vote long, voter long").parquet(f"{out}/table")


def tally(events: DataFrame) -> DataFrame:
    start = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (60 * SLOT_MIN)) * 60 * SLOT_MIN).cast("long")
    return events.groupBy(start.alias("window_start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18, 6)")).alias("total"))


def keep_tallies(events: DataFrame, out: str) -> None:
    """Partial tallies of five-minute slots, one folder for each micro-batch: a batch that runs again after a failure
    replaces its own folder, so that nothing counts twice."""

    def put(batch: DataFrame, number: int) -> None:
        tally(batch).write.mode("overwrite").parquet(f"{out}/partials/batch={number}")

    events.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def tallies(spark: SparkSession, out: str) -> DataFrame:
    """``window_start, event_type, n, total`` up to now, from the partial tallies and not from the events."""
    parts = spark.read.parquet(f"{out}/partials")
    return parts.groupBy("window_start", "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total").cast("double"), 4).alias("total"))


def tally_table(spark: SparkSession, path: str, out: str, files: int | None = None) -> DataFrame:
    keep_tallies(events_stream(spark, path, files), out)
    return tallies(spark, out)
