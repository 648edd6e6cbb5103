"""Queries over how the articles are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidende.io import table
from tidende.operators import compaction


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.adds_nothing(table(spark, sf, "example_documents"))


def p3_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """The consolidated table itself."""
    return compaction.compact(table(spark, sf, "example_documents"))


QUERIES = {"p3_found": p3_found, "p3_compacted": p3_compacted}

_EARLIER = "row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at ASC NULLS LAST, encode(file_path)) AS k"
SQL = {
    "p3_found": f"SELECT file_path FROM (SELECT doc_id, file_path, {_EARLIER} FROM example_documents) WHERE k > 1 AND doc_id IS NOT NULL",
    "p3_compacted": f"SELECT doc_id, text, pub_date, ext_id, file_path, loaded_at FROM (SELECT *, {_EARLIER} FROM example_documents) WHERE k = 1 OR doc_id IS NULL",
}
