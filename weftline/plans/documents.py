"""Documents in canonical form: manifests of batches with their digests, and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.canonical import canonical_json, digest
from weftline.plans.views import FRAME, VIEW

# a batch is a thousand orders: its places are the customers' nations of a date, its configurations the clerks' priorities
VIEW("manifest_places", """SELECT DISTINCT CAST(floor(o_orderkey / 1000) AS BIGINT) AS batch, n_name AS city, substr(CAST(o_orderdate AS STRING), 1, 7) AS month, CAST(CAST(n_nationkey AS DECIMAL(6, 2)) * 3 - 24.50 AS DECIMAL(8, 2)) AS lat, CAST(CAST(n_nationkey * n_nationkey AS DECIMAL(8, 3)) / 8 AS DECIMAL(10, 3)) AS lon
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""")
VIEW("manifest_configs", "SELECT DISTINCT CAST(floor(o_orderkey / 1000) AS BIGINT) AS batch, o_orderpriority || ' \"' || o_orderstatus || '\"' AS config FROM {orders}")


def manifests(places: DataFrame, configs: DataFrame) -> DataFrame:
    """``batch, n_cities, document, manifest_hash``: places by their own canonical form, configurations by name. A batch has
    as many of both as there are nations by months and configurations."""
    city = F.struct("city", F.col("month").alias("date"), "lat", "lon")
    kind = places.select(city.alias("c")).schema["c"].dataType
    listed = places.select("batch", F.struct(canonical_json(city, kind).alias("o"), city.alias("c")).alias("x")).groupBy("batch").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]).alias("cities"))
    named = configs.groupBy("batch").agg(F.array_sort(F.collect_list("config")).alias("config_ids"))
    whole = F.struct("cities", "config_ids", F.lit(5).alias("N"), F.sha2(F.col("batch").cast("string"), 256).alias("snapshot_sha256"), (F.size("cities") / 8).alias("share"))
    both = listed.join(named, "batch").select("batch", F.size("cities").alias("n_cities"), whole.alias("m"))
    return both.select("batch", "n_cities", canonical_json(F.col("m"), both.schema["m"].dataType).alias("document")).withColumn("manifest_hash", digest(F.col("document")))


_NUMBER = "regexp_replace(CAST({} AS VARCHAR), '\\.0$', '')"
_PLAIN = "regexp_replace(CAST({} AS VARCHAR), '\\.?0+$', '')"
_CITY = f"""'{{"city":"' || city || '","date":"' || month || '","lat":"' || {_PLAIN.format('lat')} || '","lon":"' || {_PLAIN.format('lon')} || '"}}'"""
FRAME("manifest_digests", lambda s, d, places, configs: manifests(places, configs), f"""SELECT batch, n_cities, document, sha256(document) AS manifest_hash FROM (SELECT p.batch, CAST(n AS INT) AS n_cities,
  '{{"N":5,"cities":[' || cities || '],"config_ids":[' || ids || '],"share":' || {_NUMBER.format('n / 8')} || ',"snapshot_sha256":"' || sha256(CAST(p.batch AS VARCHAR)) || '"}}' AS document FROM
  (SELECT batch, count(*) AS n, string_agg(c, ',' ORDER BY c) AS cities FROM (SELECT batch, {_CITY} AS c FROM manifest_places) GROUP BY batch) p JOIN
  (SELECT batch, string_agg('"' || replace(config, '"', '\\"') || '"', ',' ORDER BY config) AS ids FROM manifest_configs GROUP BY batch) c ON p.batch = c.batch)""", "manifest_places manifest_configs")


def event_documents(events: DataFrame) -> DataFrame:
    """``event_id, document, digest`` of each event, with its properties as a map."""
    rows = events.select("event_id", F.struct("event_id", F.col("user_id").alias("user"), F.col("event_type").alias("type"), F.round("value", 4).alias("value"), F.from_json("props", "map<string, long>").alias("props")).alias("d"))
    return rows.select("event_id", canonical_json(F.col("d"), rows.schema["d"].dataType).alias("document")).withColumn("digest", digest(F.col("document")))


FRAME("event_documents", lambda s, d, events: event_documents(events), f"""SELECT *, sha256(document) AS digest FROM (SELECT event_id, '{{"event_id":' || event_id || ',"props":' || coalesce(replace(props, ' ', ''), 'null') || ',"type":' || coalesce('"' || event_type || '"', 'null') || ',"user":' || coalesce(CAST(user_id AS VARCHAR), 'null')
  || ',"value":' || coalesce({_NUMBER.format('round(value, 4)')}, 'null') || '}}' AS document FROM events)""", "events")

QUERIES = "manifest_digests event_documents".split()
