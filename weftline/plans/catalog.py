"""Every query by name, with its SQL where SQL can express it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import aggregates, channels, documents, facts, hypotheses, inference, serving, similarity, sources, stateful, trees, views, visual


def _query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.dataframe(spark, sf_dir, name)


_WITH_SQL = [*similarity.QUERIES, *channels.QUERIES, *facts.QUERIES, *trees.QUERIES, *aggregates.QUERIES, *serving.QUERIES, *inference.QUERIES, *stateful.QUERIES, *sources.QUERIES, *documents.QUERIES]
QUERIES = {name: partial(_query, name) for name in [*_WITH_SQL, *stateful.ROWS_ONLY, *facts.ROWS_ONLY, *sources.ROWS_ONLY, *hypotheses.ROWS_ONLY, *visual.ROWS_ONLY]}
ORACLE_SQL = {name: views.oracle(name) for name in _WITH_SQL}
