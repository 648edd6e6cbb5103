"""Registration of queries, and inputs that many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidende.io import table

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, text, pub_date, ext_id``: the first delivery of each article with a text."""
    order = F.struct(F.col("loaded_at").isNull().alias("late"), "loaded_at", "file_path", "text", "pub_date", "ext_id")
    first = table(spark, sf, "example_documents").where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(order).alias("x"))
    return first.select("doc_id", "x.text", "x.pub_date", "x.ext_id").where(F.trim("text") != "")


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, pos, mention, kb, entity`` without repeated rows and null mentions."""
    return table(spark, sf, "disambiguations").where(F.col("mention").isNotNull() & (F.trim("mention") != "")).distinct()


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """``title, text``: the uses of the link dictionary written as links on their pages."""
    p = table(spark, sf, "priors").where(F.col("page_title").isNotNull() & F.col("entity").isNotNull() & (F.trim("mention") != ""))
    link = F.concat(F.lit("[["), F.col("entity"), F.lit("|"), F.trim("mention"), F.lit("]]"))
    return p.groupBy(F.col("page_title").alias("title")).agg(F.array_join(F.array_sort(F.collect_list(link)), " ").alias("text"))


#: The same in SQL.
ARTS = """arts AS (SELECT doc_id, text, pub_date, ext_id FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at ASC NULLS LAST, encode(file_path)) AS k FROM example_documents WHERE doc_id IS NOT NULL)
  WHERE k = 1 AND trim(text) <> '')"""
MENTIONS = "men AS (SELECT DISTINCT doc_id, pos, mention, kb, entity FROM disambiguations WHERE trim(mention) <> '')"
LINKS = r"""links AS (SELECT page_title AS title, lower(trim(mention)) AS anchor, lower(trim(entity)) AS target FROM priors
  WHERE page_title IS NOT NULL AND entity IS NOT NULL AND trim(mention) <> '')"""
BOW = r"bow AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM arts) GROUP BY ALL)"
PRIOR = """counted AS (SELECT lower(trim(mention)) AS mention, entity, count(*) AS n FROM priors WHERE entity IS NOT NULL AND trim(mention) <> '' GROUP BY ALL),
prior AS (SELECT mention, entity, n, n / sum(n) OVER (PARTITION BY mention) AS prior, row_number() OVER (PARTITION BY mention ORDER BY n DESC, encode(entity)) AS k FROM counted)"""
