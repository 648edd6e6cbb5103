"""Documents as weighted terms and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidende.functions import text
from tidende.io import materialize


def tokens(documents: DataFrame, splitter=text.words) -> DataFrame:
    """``doc_id, token``, a row an occurrence."""
    return documents.select("doc_id", F.explode(splitter(F.col("text"))).alias("token"))


def bag_of_words(documents: DataFrame, splitter=text.words) -> DataFrame:
    """``doc_id, token, tf``."""
    return tokens(documents, splitter).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


def dictionary(documents: DataFrame, least: int = 2) -> DataFrame:
    """``token, df, id``: tokens of at least ``least`` documents; dense ids in their order, given by ranges, not in one task."""
    df = bag_of_words(documents).groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    return dense_ids(df, "token")


def dense_ids(df: DataFrame, key: str, start: int = 0) -> DataFrame:
    """A dense ``id`` by order of ``key``: rows are counted by hash-free ranges first, then numbered within each."""
    ranged = df.repartitionByRange(key).withColumn("part", F.spark_partition_id())

    ranged = materialize(ranged, "ids")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    within = F.row_number().over(Window.partitionBy("part").orderBy(key))
    return ranged.withColumn("k", within).join(F.broadcast(before), "part").withColumn("id", F.col("before") + F.col("k") - 1 + start).drop("part", "k", "before")


def stop_words(common: list[str], entities: DataFrame | None = None) -> DataFrame:
    """``word``: the common words and those of entity names with their stems by ending."""

    spark = SparkSession.active()
    base = spark.createDataFrame([(w,) for w in common], "word string")
    if entities is None:
        return base.distinct()
    word = F.explode(F.split(F.lower("entity"), r"\s+"))
    w = F.col("w")
    cut = lambda n: F.expr(f"substring(w, 1, length(w) - {n})")
    forms = F.array(w, F.when(w.rlike("(en|s|er|e)$"), cut(1)), F.when(w.rlike("(en|er)$"), cut(2)))
    stems = entities.select(word.alias("w")).distinct().select(F.explode(forms).alias("word")).where(F.col("word").isNotNull() & (F.col("word") != ""))
    return base.unionByName(stems).distinct()


def tfidf(documents: DataFrame, stop: DataFrame | None = None, k: int | None = 50, splitter=text.tfidf_tokens) -> DataFrame:
    """``doc_id, term, tf, df, tfidf``: tf * (ln((1 + n) / (1 + df)) + 1), of unit length over the whole document, the ``k`` highest.

    The number of documents is that of the table, with or without terms. ``stop`` is ``word``.
    """
    bow = bag_of_words(documents, splitter).withColumnRenamed("token", "term")
    if stop is not None:
        bow = bow.join(stop.select(F.col("word").alias("term")), "term", "left_anti")
    df = bow.groupBy("term").agg(F.count("*").alias("df"))
    n = F.broadcast(documents.agg(F.countDistinct("doc_id").alias("n_docs")))
    weighted = bow.join(df, "term").join(n).withColumn("w", F.col("tf") * (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    out = weighted.withColumn("tfidf", F.col("w") / norm).select("doc_id", "term", "tf", "df", "tfidf")
    if k is None:
        return out
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("tfidf"), "term"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def entity_tags(disambiguations: DataFrame) -> DataFrame:
    """``doc_id, kind, term`` of each mention once: ``w`` where it was resolved in the encyclopedia, ``r`` where it was only recognised."""
    kind = F.when((F.col("kb") == "w") & F.col("entity").isNotNull(), "w").otherwise("r")
    return disambiguations.where(F.col("mention").isNotNull() & (F.trim("mention") != "")).select("doc_id", kind.alias("kind"), F.trim("mention").alias("term")).distinct()


def document_terms(weighted: DataFrame, tags: DataFrame) -> DataFrame:
    """``doc_id, kind, term``: plain terms and tagged entities together."""
    return weighted.select("doc_id", F.lit("").alias("kind"), "term").unionByName(tags)


def rendered(terms: DataFrame) -> DataFrame:
    """Tags written out, as text sinks have them."""
    tag = F.when(F.col("kind") == "", F.col("term")).otherwise(F.concat(F.lit("*"), F.col("kind"), F.lit("."), F.col("term")))
    return terms.select("doc_id", tag.alias("term"))


def inverted_entities(disambiguations: DataFrame) -> DataFrame:
    """``term, doc_id, n``: occurrences of each recognised mention, and of each resolved entity."""
    rows = disambiguations.where(F.col("mention").isNotNull() & (F.trim("mention") != ""))
    r = rows.select(F.concat(F.lit("*r."), F.lower(F.trim("mention"))).alias("term"), "doc_id")
    w = rows.where((F.col("kb") == "w") & F.col("entity").isNotNull()).select(F.concat(F.lit("*w."), F.lower("entity")).alias("term"), "doc_id")
    return r.unionByName(w).groupBy("term", "doc_id").agg(F.count("*").alias("n"))


def surface_forms(disambiguations: DataFrame) -> DataFrame:
    """``entity, mention``: every form of each resolved entity."""
    return disambiguations.where((F.col("kb") == "w") & F.col("entity").isNotNull() & F.col("mention").isNotNull()).select("entity", F.trim("mention").alias("mention")).distinct()


def reversed_table(df: DataFrame, key: str, value: str) -> DataFrame:
    """``value``, and the keys that had it, in order and each once."""
    return df.groupBy(value).agg(F.array_sort(F.collect_set(key)).alias(key))


def inverted_index(documents: DataFrame) -> DataFrame:
    """``term, doc_id, tf, length``: postings with the length of their document."""
    bow = bag_of_words(documents).withColumnRenamed("token", "term")
    return bow.withColumn("length", F.sum("tf").over(Window.partitionBy("doc_id")))


def bm25(index: DataFrame, query: str, n_docs: int, mean_length: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``doc_id, score``: best matches first by score; a query is words, or words and quoted ones, all weighed alike."""
    wanted = sorted(set(query.lower().replace('"', " ").split()))
    hits = index.where(F.col("term").isin(wanted))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1.0 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("length") / mean_length))
    return hits.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.sum(score).alias("score"))


def search(documents: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The ``limit`` best documents of a query."""
    index = inverted_index(documents)
    stats = index.select("doc_id", "length").distinct().agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    return bm25(index, query, stats["n"] or 0, stats["mean"] or 1.0).orderBy(F.desc("score"), "doc_id").limit(limit)


