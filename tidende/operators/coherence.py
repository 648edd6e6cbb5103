"""Coherence of entities by the pages that link to both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Articles of the encyclopedia, by default (a fixed value).
ARTICLES = 474_017
#: Entities of one source that meet in one task.
PART = 500


def milne_witten(a: Column, b: Column, both: Column, n: Column) -> Column:
    """1 - (ln max - ln both) / (ln n - ln min)."""
    return 1.0 - (F.log(F.greatest(a, b).cast("double")) - F.log(both.cast("double"))) / (F.log(n.cast("double")) - F.log(F.least(a, b).cast("double")))


def coherence(inlink: DataFrame, pairs: DataFrame | None = None, articles: int = ARTICLES, hub: int | None = None) -> DataFrame:
    """``a, b, shared, coherence`` (a < b) of entities with a linking page in common and a value above 0.

    ``inlink`` is ``entity, source``. With ``pairs`` (``a, b``, the candidates of the documents) only these are worked out: the
    sources of the rarer entity are looked up among those of the other. Without it, sources are self-joined, those of many entities
    in parts; ``hub`` then takes out those that link to more entities than that, for the pairs whose other shared
    sources are to decide.
    """
    links = inlink.select("entity", "source").distinct()
    sizes = links.groupBy("entity").agg(F.count("*").alias("n"))
    if pairs is not None:
        wanted = pairs.where(F.col("a") < F.col("b")).select("a", "b").distinct()
        sized = wanted.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b")
        # The entity of fewer sources is expanded, the other one only looked up.
        few = F.when(F.col("n_a") <= F.col("n_b"), F.col("a")).otherwise(F.col("b"))
        sided = sized.select("a", "b", few.alias("few"), F.when(few == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("many"))
        left = sided.join(links.toDF("few", "source"), "few")
        shared = left.join(links.toDF("many", "source"), ["many", "source"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("shared"))
    else:
        if hub:
            wide = links.groupBy("source").agg(F.count("*").alias("k")).where(F.col("k") <= hub).select("source")
            links = links.join(wide, "source", "left_semi")
        # A source of many entities is cut into parts; each pair of its parts is a key of its own.
        parts = links.groupBy("source").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        split = links.join(parts, "source").withColumn("part", F.pmod(F.xxhash64("entity"), F.col("parts")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        low = split.select("source", F.col("entity").alias("a"), F.col("part").alias("pa"), every.alias("pb"))
        high = split.select("source", F.col("entity").alias("b"), F.col("part").alias("pb"), every.alias("pa"))
        both = low.join(high, ["source", "pa", "pb"]).where(F.col("a") < F.col("b"))
        shared = both.groupBy("a", "b").agg(F.count("*").alias("shared"))
    joined = shared.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b")
    value = milne_witten(F.col("n_a"), F.col("n_b"), F.col("shared"), F.lit(articles))
    return joined.select("a", "b", "shared", value.alias("coherence")).where(F.col("coherence") > 0)
