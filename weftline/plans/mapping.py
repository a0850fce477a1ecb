"""How the analytic grain (batch, variant, configuration, slot) is read from the driver's tables.

cards    pages: a batch is 50 neighbouring pages, a configuration one of ten by page number, the slot is the page
texts    documents: a batch is 200 neighbouring documents, configuration = source, variant = language
votes    events: voter = user, choice by event type, the two sides from the JSON property and the event number
Every row of a table belongs to a batch, so the pairs within batches grow in proportion to the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_BATCH, CONFIGS, DOC_BATCH = 50, 10, 200

#: The vote that each event type stands for.
CHOICES = {"view": "a", "click": "b", "purchase": "tie", "signup": "both_bad", "error": "skip"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` in a task for each core at least: a file of few row groups is read by as few tasks, and what is made of a page
    or a text takes far longer than to read it."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, key)


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``batch, config, config_ord, slot, html, url``."""
    pages = spread(table(spark, sf_dir, "pages"), "page_id")
    return pages.select(
        F.floor(F.col("page_id") / PAGE_BATCH).alias("batch"), F.concat(F.lit("c"), F.col("page_id") % CONFIGS).alias("config"),
        (F.col("page_id") % CONFIGS).cast("int").alias("config_ord"), F.col("page_id").alias("slot"), "html", "url",
    )


CARDS_SQL = f"""cards AS (SELECT CAST(floor(page_id / {PAGE_BATCH}) AS BIGINT) AS batch, 'c' || (page_id % {CONFIGS}) AS config,
  CAST(page_id % {CONFIGS} AS INT) AS config_ord, page_id AS slot, html, url FROM pages)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``batch, variant, config, slot, text``."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    return docs.select(F.floor(F.col("doc_id") / DOC_BATCH).alias("batch"), F.col("lang").alias("variant"), F.col("source").alias("config"), F.col("doc_id").alias("slot"), "text")


TEXTS_SQL = f"""texts AS (SELECT CAST(floor(doc_id / {DOC_BATCH}) AS BIGINT) AS batch, lang AS variant, source AS config,
  doc_id AS slot, text FROM documents)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vote_id, voter, ts, config_a, config_b, choice, dwell_ms, variant``; the two sides always differ."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    choice = F.create_map(*[F.lit(x) for pair in CHOICES.items() for x in pair])[F.col("event_type")]
    a = F.coalesce(k, F.lit(0)) % 12
    b = (a + 1 + F.col("event_id") % 11) % 12
    return events.select(
        F.col("event_id").alias("vote_id"), F.col("user_id").alias("voter"), "ts",
        F.concat(F.lit("m"), a).alias("config_a"), F.concat(F.lit("m"), b).alias("config_b"), choice.alias("choice"),
        (F.col("value") * 1000).cast("long").alias("dwell_ms"), F.when(F.col("event_id") % 2 == 0, "min").otherwise("q").alias("variant"),
    )


VOTES_SQL = """votes AS (SELECT event_id AS vote_id, user_id AS voter, ts, 'm' || a AS config_a, 'm' || ((a + 1 + event_id % 11) % 12) AS config_b,
  CASE event_type WHEN 'view' THEN 'a' WHEN 'click' THEN 'b' WHEN 'purchase' THEN 'tie' WHEN 'signup' THEN 'both_bad' WHEN 'error' THEN 'skip' END AS choice,
  CAST(trunc(value * 1000) AS BIGINT) AS dwell_ms, CASE WHEN event_id % 2 = 0 THEN 'min' ELSE 'q' END AS variant
  FROM (SELECT *, coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) % 12 AS a FROM events))"""


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration record for each supplier: ``config_id, family, model_id, effort, protocol, batch, created, valid``."""
    s = table(spark, sf_dir, "supplier")
    effort = F.element_at(F.array(*[F.lit(x) for x in EFFORTS]), (F.col("s_suppkey") % len(EFFORTS) + 1).cast("int"))
    protocol = F.element_at(F.array(*[F.lit(x) for x in PROTOCOLS]), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return s.select(
        F.concat(F.lit("cfg"), F.col("s_suppkey") % 40).alias("config_id"), F.concat(F.lit("fam"), F.col("s_nationkey") % 5).alias("family"),
        F.concat(F.lit("model-"), F.col("s_nationkey")).alias("model_id"), effort.alias("effort"), protocol.alias("protocol"),
        F.concat(F.lit("b"), F.lpad((F.floor(F.col("s_suppkey") / 40)).cast("string"), 4, "0")).alias("batch_id"),
        F.col("s_suppkey").alias("created"), F.greatest(F.floor(F.col("s_acctbal") / 1000), F.lit(0)).alias("n_valid"),
    )


#: Effort tokens and protocols in the order of the mapping.
EFFORTS = ["none", "low", "medium", "high", "max", "8000"]
PROTOCOLS = ["api", "cli", "agent"]

CONFIGS_SQL = f"""configs AS (SELECT 'cfg' || (s_suppkey % 40) AS config_id, 'fam' || (s_nationkey % 5) AS family, 'model-' || s_nationkey AS model_id,
  list_extract({EFFORTS!r}, CAST(s_suppkey % {len(EFFORTS)} + 1 AS INT)) AS effort, list_extract({PROTOCOLS!r}, CAST(s_suppkey % 3 + 1 AS INT)) AS protocol,
  'b' || lpad(CAST(CAST(floor(s_suppkey / 40) AS BIGINT) AS VARCHAR), 4, '0') AS batch_id, s_suppkey AS created,
  greatest(CAST(floor(s_acctbal / 1000) AS BIGINT), 0) AS n_valid FROM supplier)"""
