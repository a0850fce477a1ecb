"""JSON document sources of a batch tree, with explicit schemas; sinks for exports and guarded inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas by document kind.
SCHEMAS = {
    "index": "batches array<struct<id string, date string, event string, created_at string, variants array<string>, n_configs int, manifest_hash string, merged_into string>>",
    "manifest": "prompt_min_sha256 string, prompt_q_sha256 string, snapshot_sha256 string, cities array<struct<city string, date string, lat string, lon string>>, config_ids array<string>, N int, env_digest string, pipeline_commit string",
    "config": "config_id string, family string, model_id string, effort string, protocol string, billing string, served_model string, m struct<min int, q int>, N int",
    "slot": "batch_id string, config_id string, slot_index long, state string, telemetry map<string, double>, flags array<string>",
    "pairs": "batch_id string, variant string, config_a string, config_b string, kind string, channels array<string>, pairs array<struct<slot_a long, slot_b long, s map<string, double>, diagnostics map<string, double>>>",
    "send_log": "batch_id string, config_id string, N int, positions array<struct<variant string, slot_index long, block_index long, terminal_state string, attempts array<struct<attempt_index int, outcome string, reached_model boolean, reason string, backoff_ms long>>>>",
    "snapshot": "locations array<struct<city string, date string, lat string, lon string, canary struct<daily map<string, string>, hourly array<string>>>>",
}


def read_documents(spark: SparkSession, kind: str, path: str, lines: bool = False) -> DataFrame:
    """One row for each JSON file, or for each line of files with ``lines``, with the file's path; a malformed document is
    an error."""
    return spark.read.schema(SCHEMAS[kind]).option("multiLine", not lines).option("mode", "FAILFAST").json(path).withColumn("file", F.input_file_name())


def readable(index: DataFrame, manifests: DataFrame) -> DataFrame:
    """The batches of an index that have a manifest; ``manifests`` has ``batch_id``."""
    return index.join(manifests.select(F.col("batch_id").alias("id")).distinct(), "id", "left_semi")


def slot_inventory(slots: DataFrame) -> DataFrame:
    """``batch_id, config_id, slot_index, digest`` of the valid slots; the digest is of what the slot's document says."""
    valid = slots.filter("state = 'valid'")
    return valid.select("batch_id", "config_id", "slot_index", F.sha2(F.concat_ws("|", "batch_id", "config_id", F.col("slot_index").cast("string"), F.array_join("flags", ",")), 256).alias("digest"))


def batches(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, "index", path).select(F.posexplode("batches").alias("place", "b")).select("place", "b.*")


def config_order(manifests: DataFrame) -> DataFrame:
    """``config_ord, config_id``: the order of a manifest is part of its meaning."""
    return manifests.select("file", F.posexplode("config_ids").alias("config_ord", "config_id"))


def pair_scores(pairs: DataFrame) -> DataFrame:
    """Long form: a row for each pair of slots and channel; the two sides in byte order."""
    rows = pairs.select("variant", "config_a", "config_b", "kind", F.explode("pairs").alias("p")).select("variant", "config_a", "config_b", "kind", "p.slot_a", "p.slot_b", F.explode("p.s").alias("channel", "s"))
    swapped = F.col("config_a") > F.col("config_b")
    pick = lambda a, b: F.when(swapped, F.col(b)).otherwise(F.col(a)).alias(a)
    return rows.select("variant", pick("config_a", "config_b"), pick("config_b", "config_a"), "kind", pick("slot_a", "slot_b"), pick("slot_b", "slot_a"), "channel", "s")


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """``file, digest, length, content`` of binary files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("digest"), "length", "content")


def stream_lines(lines: DataFrame) -> DataFrame:
    """``value`` lines of an event stream: the JSON after ``data:``, and whether it is the terminal one."""
    data = F.regexp_extract("value", r"^data:\s*(.*)$", 1)
    return lines.filter(F.col("value").startswith("data:")).select("*", data.alias("data"), (data == "[DONE]").alias("done"), F.get_json_object(data, "$.choices[0].delta.content").alias("content"))


def insert_absent(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``new`` whose key ``table`` doesn't have: the first writer wins."""
    return new.dropDuplicates(key).join(table.select(*key).distinct(), key, "left_anti")


def canonical(df: DataFrame) -> DataFrame:
    """One JSON text for each row: columns in byte order, -0.0 as 0.0, NaN as null."""
    columns = []
    for f in sorted(df.schema, key=lambda f: f.name.encode()):
        c = F.col(f"`{f.name}`")
        columns.append((F.when(F.isnan(c), None).when(c == 0, F.lit(0.0)).otherwise(c) if f.dataType.typeName() in ("double", "float") else c).alias(f.name))
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def write_votes_csv(votes: DataFrame, path: str) -> None:
    """Quoted CSV in order of id; the voter as the first 12 hexadecimal digits of a hash."""
    rows = votes.select("vote_id", F.substring(F.sha2(F.col("voter").cast("string"), 256), 1, 12).alias("voter"), "config_a", "config_b", "choice")
    rows.orderBy("vote_id").write.option("header", True).option("quoteAll", True).csv(path)
