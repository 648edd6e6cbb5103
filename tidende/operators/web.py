"""Undecided mentions looked up in a table of search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidende.functions import text
from tidende.operators import entities


def queries(mentions: DataFrame, sites: list[str]) -> DataFrame:
    """``doc_id, pos, mention, query``: the mention and its neighbours, on certain sites; pure strings, nothing is fetched."""
    near = entities.neighbours(mentions)
    q = F.concat_ws(" ", F.concat(F.lit('"'), F.col("mention"), F.lit('"')), text.or_query(F.col("context"), F.array(*[F.lit(s) for s in sites])))
    return near.select("doc_id", "pos", "mention", q.alias("query"))


def best_profile(results: DataFrame, take: int = 3) -> DataFrame:
    """``mention, slug, matches``: of the first ``take`` results the one whose words match most, an s at the end tolerated; without any match
    the first letters must agree, else it is null."""
    r = results.where(F.col("rank") <= take).withColumn("words", text.slug_words(F.col("url")))
    parts = F.filter(F.split(F.lower("mention"), r"[\s-]+"), lambda w: w != "")
    stem = lambda w: F.regexp_replace(w, "s$", "")
    hits = F.size(F.filter(parts, lambda m: F.exists("words", lambda w: (w == m) | (stem(w) == stem(m)))))
    slug = F.array_join("words", "-")
    scored = r.select("mention", "rank", hits.alias("matches"), slug.alias("slug"))
    best = scored.groupBy("mention").agg(F.max(F.struct("matches", F.expr("-rank").alias("early"), "slug")).alias("x"))
    fits = (F.col("x.matches") > 0) | (F.lower(F.substring("mention", 1, 1)) == F.substring(F.col("x.slug"), 1, 1))
    return best.select("mention", F.when(fits, F.col("x.slug")).alias("slug"), F.col("x.matches").alias("matches"))


def resolved(disambiguations: DataFrame, results: DataFrame) -> DataFrame:
    """Undecided mentions with the profile found for them, knowledge base ``l``; the others unchanged."""
    found = best_profile(results).where(F.col("slug").isNotNull()).select(F.lower("mention").alias("key"), "slug").groupBy("key").agg(F.min("slug").alias("slug"))
    j = disambiguations.withColumn("key", F.lower("mention")).join(found, "key", "left")
    use = F.col("entity").isNull() & F.col("slug").isNotNull()
    return j.select("doc_id", "pos", "mention", F.when(use, "l").otherwise(F.col("kb")).alias("kb"), F.when(use, F.col("slug")).otherwise(F.col("entity")).alias("entity"))
