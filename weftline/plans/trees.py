"""Batch trees: JSON documents written from the tables to the shared folder and read with their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans import similarity  # noqa: F401  its views
from weftline.plans.views import FRAME
from weftline.sources import documents
from weftline.sources.shared import shared_folder

#: Every fifth batch has no manifest; every seventh slot is empty.
UNREADABLE, EMPTY = 5, 7


def _lines(rows: DataFrame, name: str) -> str:
    """The path of JSON lines with the columns of ``rows``."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.json(path)
    return path


def _batch(c: str = "batch"):
    return F.concat(F.lit("b"), c)


def index(spark: SparkSession, sf_dir: str, cards: DataFrame) -> DataFrame:
    """The batches of the index that can be read, in the order of the index."""
    each = cards.select("batch").distinct().select(F.struct(_batch().alias("id"), F.lit("2024-01-01").alias("date"), F.array(F.lit("min"), F.lit("q")).alias("variants")).alias("b"), "batch")
    listed = each.agg(F.array_sort(F.collect_list(F.struct("batch", "b"))).alias("x")).select(F.expr("transform(x, y -> y.b)").alias("batches"))
    found = documents.batches(spark, _lines(listed, "index"))
    return documents.readable(found, _manifests(spark, cards)).select("place", "id", F.size("variants").alias("n_variants"))


def _manifests(spark: SparkSession, cards: DataFrame) -> DataFrame:
    ids = F.expr("transform(array_sort(collect_set(struct(-config_ord AS o, config))), y -> y.config)")  # not in order of names
    rows = cards.filter(F.col("batch") % UNREADABLE != 4).groupBy("batch").agg(ids.alias("config_ids"), F.count(F.lit(1)).cast("int").alias("N")).select(_batch().alias("snapshot_sha256"), "config_ids", "N")
    return documents.read_documents(spark, "manifest", _lines(rows, "manifest"), lines=True).withColumn("batch_id", F.col("snapshot_sha256"))


def config_order(spark: SparkSession, sf_dir: str, cards: DataFrame) -> DataFrame:
    found = _manifests(spark, cards)
    return found.select("batch_id", F.posexplode("config_ids").alias("config_ord", "config_id"))


def _slots(spark: SparkSession, cards: DataFrame) -> DataFrame:
    state = F.when(F.col("slot") % EMPTY == 0, "empty").otherwise("valid")
    flags = F.when(F.col("slot") % 2 == 0, F.array(F.lit("even"), F.lit("patched"))).otherwise(F.array().cast("array<string>"))
    rows = cards.select(_batch().alias("batch_id"), F.col("config").alias("config_id"), F.col("slot").alias("slot_index"), state.alias("state"), flags.alias("flags"))
    return documents.read_documents(spark, "slot", _lines(rows, "slots"), lines=True)


def inventory(spark: SparkSession, sf_dir: str, cards: DataFrame) -> DataFrame:
    return documents.slot_inventory(_slots(spark, cards))


def load_batch(spark: SparkSession, sf_dir: str, cards: DataFrame) -> DataFrame:
    """What statistics read of a batch: its manifest's configurations, slots by outcome and whether both are complete."""
    order, slots = config_order(spark, sf_dir, cards), _slots(spark, cards)
    m = slots.groupBy("batch_id", "config_id").agg(F.count(F.lit(1)).alias("n_slots"), F.sum((F.col("state") == "valid").cast("long")).alias("m_valid"), F.sum(F.array_contains("flags", "patched").cast("long")).alias("n_patched"))
    joined = order.join(m, ["batch_id", "config_id"], "left")
    return joined.select("batch_id", "config_ord", "config_id", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("m_valid", F.lit(0)).alias("m_valid"), F.coalesce("n_patched", F.lit(0)).alias("n_patched"))


_READABLE = f"batch % {UNREADABLE} <> 4"
FRAME("batch_index", index, f"""SELECT CAST(place AS INT) AS place, id, 2 AS n_variants FROM (SELECT batch, 'b' || batch AS id, row_number() OVER (ORDER BY batch) - 1 AS place FROM (SELECT DISTINCT batch FROM cards)) WHERE {_READABLE}""", "cards")
FRAME("manifest_order", config_order, f"""SELECT 'b' || batch AS batch_id, CAST(row_number() OVER (PARTITION BY batch ORDER BY config_ord DESC) - 1 AS INT) AS config_ord, config AS config_id FROM (SELECT DISTINCT batch, config, config_ord FROM cards) WHERE {_READABLE}""", "cards")
FRAME("slot_inventory", inventory, f"""SELECT 'b' || batch AS batch_id, config AS config_id, slot AS slot_index, sha256('b' || batch || '|' || config || '|' || slot || '|' || CASE WHEN slot % 2 = 0 THEN 'even,patched' ELSE '' END) AS digest FROM cards WHERE slot % {EMPTY} <> 0""", "cards")
FRAME("batch_inputs", load_batch, f"""SELECT 'b' || batch AS batch_id, CAST(row_number() OVER (PARTITION BY batch ORDER BY config_ord DESC) - 1 AS INT) AS config_ord, config AS config_id, count(*) AS n_slots,
  CAST(sum(CASE WHEN slot % {EMPTY} <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS m_valid, CAST(sum(CASE WHEN slot % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_patched FROM cards WHERE {_READABLE} GROUP BY batch, config, config_ord""", "cards")

QUERIES = "batch_index manifest_order slot_inventory batch_inputs".split()
