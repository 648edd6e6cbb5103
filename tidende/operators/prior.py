"""Candidates of mentions: popularity priors and the rules around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def popularity(uses: DataFrame, k: int | None = 5) -> DataFrame:
    """``mention, entity, n, prior``: share of each entity in a mention's resolved uses, the ``k`` highest; ties by entity.

    ``uses`` is ``mention, entity``, a row a use; counts are aggregated before the shuffle, so a hot mention is only as many rows
    as it has entities.
    """
    counted = uses.where(F.col("entity").isNotNull() & (F.trim("mention") != "")).groupBy(F.lower(F.trim("mention")).alias("mention"), "entity").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("mention"))
    out = counted.withColumn("prior", F.col("n") / total)
    if k is None:
        return out
    rank = F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("n"), "entity"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def candidates(mentions: DataFrame, prior: DataFrame) -> DataFrame:
    """``doc_id, mention, entity, prior`` with a row of nulls for a mention without any; a mention of a document counts once."""
    m = mentions.select("doc_id", "mention", F.lower(F.trim("mention")).alias("key")).where(F.col("key") != "").distinct()
    return m.join(prior.select(F.col("mention").alias("key"), "entity", "prior"), "key", "left").select("doc_id", "mention", "entity", "prior")


def genitive_fallback(found: DataFrame, prior: DataFrame) -> DataFrame:
    """Mentions without candidates that end in s, looked up again without it; the name stays."""
    empty = found.where(F.col("entity").isNull() & F.lower("mention").endswith("s"))
    key = F.expr("substring(lower(trim(mention)), 1, length(trim(mention)) - 1)")
    again = empty.select("doc_id", "mention", key.alias("key")).join(prior.select(F.col("mention").alias("key"), "entity", "prior"), "key", "left").select("doc_id", "mention", "entity", "prior")
    return found.where(~(F.col("entity").isNull() & F.lower("mention").endswith("s"))).unionByName(again)


def genitive_names(found: DataFrame, prior: DataFrame, sure: float = 0.8) -> DataFrame:
    """A mention in s one of whose candidates, below the first surer than ``sure``, is its name without s takes that name's candidates."""
    stem = F.expr("substring(lower(trim(mention)), 1, length(trim(mention)) - 1)")
    by = Window.partitionBy("doc_id", "mention")
    sure_at = F.min(F.when(F.col("prior") > sure, F.col("prior"))).over(by)
    same = F.max(F.when((F.col("entity") == stem) & F.lower("mention").endswith("s"), F.col("prior"))).over(by)
    flagged = found.withColumn("swap", F.coalesce(same.isNotNull() & ((sure_at.isNull()) | (same <= sure_at)), F.lit(False)))
    swapped = flagged.where("swap").select("doc_id", "mention", stem.alias("key")).distinct()
    other = swapped.join(prior.select(F.col("mention").alias("key"), "entity", "prior"), "key").select("doc_id", "mention", "entity", "prior")
    replaced = other.select("doc_id", "mention").distinct().withColumn("has", F.lit(True))
    kept = flagged.join(replaced, ["doc_id", "mention"], "left").where(F.col("has").isNull()).select("doc_id", "mention", "entity", "prior")
    return kept.unionByName(other)


def language_names(found: DataFrame, languages: DataFrame) -> DataFrame:
    """A mention that is the name of a language keeps its top candidate, with prior 1; ``languages`` is a fixed list, ``name``."""
    names = F.broadcast(languages.select(F.lower(F.trim("name")).alias("key")).distinct().withColumn("is_language", F.lit(True)))
    marked = found.join(names, F.lower(F.trim("mention")) == F.col("key"), "left").drop("key")
    rank = F.row_number().over(Window.partitionBy("doc_id", "mention").orderBy(F.desc_nulls_last("prior"), "entity"))
    kept = marked.withColumn("rank", rank).where(F.col("is_language").isNull() | (F.col("rank") == 1))
    prior = F.when(F.col("is_language") & F.col("entity").isNotNull(), F.lit(1.0)).otherwise(F.col("prior"))
    return kept.select("doc_id", "mention", "entity", prior.alias("prior"))


def few_keyphrases(found: DataFrame, sizes: DataFrame, most: int = 4000, sure: float = 0.8) -> DataFrame:
    """A mention with a candidate of more than ``most`` keyphrases and no candidate surer than ``sure`` loses all; ``sizes`` is ``entity, n``."""
    by = Window.partitionBy("doc_id", "mention")
    sized = found.join(sizes, "entity", "left")
    gone = (F.max(F.coalesce("n", F.lit(0))).over(by) > most) & (F.max("prior").over(by) < sure)
    marked = sized.withColumn("gone", gone)
    first = F.row_number().over(by.orderBy(F.desc_nulls_last("prior"), "entity"))
    emptied = marked.withColumn("k", first).where(~F.coalesce("gone", F.lit(False)) | (F.col("k") == 1))
    blank = lambda c: F.when(~F.coalesce("gone", F.lit(False)), F.col(c)).alias(c)
    return emptied.select("doc_id", "mention", blank("entity"), blank("prior"))


def short_circuit(found: DataFrame, sure: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Those decided by their prior alone, with similarity 1 for the top and 0 for the others, and those to be compared."""
    top = F.max("prior").over(Window.partitionBy("doc_id", "mention"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "mention").orderBy(F.desc_nulls_last("prior"), "entity"))
    marked = found.where(F.col("entity").isNotNull()).withColumn("top", top).withColumn("rank", rank)
    sure_ones = marked.where(F.col("top") > sure).select("doc_id", "mention", "entity", "prior", F.when(F.col("rank") == 1, 1.0).otherwise(0.0).alias("similarity"))
    return sure_ones, marked.where(F.col("top") <= sure).select("doc_id", "mention", "entity", "prior")
