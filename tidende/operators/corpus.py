"""Corpora over time: duplicates, slices, date ranges, similar documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidende.functions import text
from tidende.operators import alike

#: First day of the reference range (a fixed value), for queries that ask for it.
FIRST_DAY = "2014-01-01"


def first_of_each(articles: DataFrame) -> DataFrame:
    """Articles of equal day and id in their name once, the first by name.

    By a minimum over whole rows before the shuffle, so copies are no hot group; a ``doc_id`` stored several times gives the row first
    delivered, by ``loaded_at`` and ``file_path`` where the table has them, then by its other columns.
    """
    key = ["pub_date", "ext_id"]
    order = ["doc_id", *[c for c in ("loaded_at", "file_path") if c in articles.columns]]
    rest = [c for c in articles.columns if c not in key and c not in order]
    late = [F.col(c).isNull().alias(f"no_{c}") for c in order[1:2]]
    first = articles.groupBy(*key).agg(F.min(F.struct("doc_id", *late, *order[1:], *sorted(rest))).alias("x"))
    return first.select(*[F.col(c) if c in key else F.col(f"x.{c}") for c in articles.columns])


def in_range(articles: DataFrame, first: str = "0001-01-01", last: str = "9999-12-31") -> DataFrame:
    return articles.where(F.col("pub_date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))


def slices(articles: DataFrame, resolution: str = "month", first: str = "0001-01-01", last: str = "9999-12-31", legacy: bool = False) -> DataFrame:
    """``doc_id, pub_date, slice, slice_start``: dense numbers of days, months or years that have documents; undated articles and those outside the range are in none.

    The distinct slices are numbered, not the documents. ``legacy`` opens a slice only when the day, month or year field
    exceeds that of the slice's first document, so a new year doesn't open one by itself.
    """
    ranged = in_range(articles, first, last)
    begin = F.trunc("pub_date", "month" if resolution == "month" else "year") if resolution != "day" else F.col("pub_date")
    marked = ranged.select("doc_id", "pub_date", begin.cast("date").alias("slice_start"))
    starts = marked.select("slice_start").distinct()
    if legacy:
        field = {"day": F.dayofmonth, "month": F.month, "year": F.year}[resolution]("slice_start")
        # A slice opens when its field exceeds every one since the last opening: a running maximum over the few distinct slices.
        order = Window.orderBy("slice_start").rowsBetween(Window.unboundedPreceding, -1)
        numbered = starts.withColumn("f", field).withColumn("top", F.max("f").over(order))
        opened = numbered.withColumn("opens", F.when(F.col("top").isNull() | (F.col("f") > F.col("top")), 1).otherwise(0))
        numbered = opened.withColumn("slice", F.sum("opens").over(Window.orderBy("slice_start")) - 1).select("slice_start", "slice")
    else:
        numbered = starts.withColumn("slice", F.dense_rank().over(Window.orderBy("slice_start")) - 1)
    return marked.join(F.broadcast(numbered), "slice_start").select("doc_id", "pub_date", "slice", "slice_start")


def without_id(articles: DataFrame) -> DataFrame:
    """Articles whose name carries no id are left out."""
    return articles.where(~F.col("doc_id").contains("_noid"))


def term_vectors(articles: DataFrame, splitter=text.tfidf_tokens) -> DataFrame:
    """``doc_id, pub_date, t, n``: the hashes of an article's terms, each once, and how often it has them; of a row by itself, so nothing is shuffled."""
    hashed = F.transform(splitter(F.col("text")), lambda t: F.xxhash64(t))
    return articles.select("doc_id", "pub_date", hashed.alias("t")).mapInArrow(alike.term_counts, "doc_id string, pub_date date, t array<bigint>, n array<int>")


def similar_pairs(vectors: DataFrame, sliced: DataFrame, threshold: float = 0.15) -> DataFrame:
    """``slice, a, b, cosine`` (a < b) of documents of one slice whose TF-IDF vectors of unit length have a cosine above ``threshold``.

    ``vectors`` is a row a document, of ``term_vectors``, and is read several times. A slice is cut into an odd number s of blocks; each meets
    itself and the next (s - 1) / 2 around, which is every pair of blocks once, so a vector is shuffled (s + 1) / 2 times and neither
    candidates nor their vectors are stored.
    """
    spark = vectors.sparkSession
    # A day is in one slice, so the few days number the documents.
    days = sliced.select("pub_date", "slice").distinct()
    placed = vectors.where(F.size("t") > 0).join(F.broadcast(days), "pub_date")
    n_docs, tasks, plan = vectors.count(), 0, []
    for r in placed.groupBy("slice").agg(F.count("*").alias("n")).orderBy("slice").collect():
        blocks = -(-r["n"] // alike.STRIPE) // 2 * 2 + 1
        plan.append((r["slice"], blocks, tasks))
        tasks += blocks
    cut = placed.join(F.broadcast(spark.createDataFrame(plan, "slice long, blocks int, first int")), "slice").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))
    sent = cut.select("slice", "doc_id", "t", "n", "first", "block", "blocks", F.explode(F.sequence(F.lit(0), F.expr("div(blocks - 1, 2)").cast("int"))).alias("away"))
    documents = sent.select((F.col("first") + F.pmod(F.col("block") - F.col("away"), "blocks")).cast("int").alias("task"), F.when(F.col("away") == 0, 1).otherwise(2).alias("kind"), "slice", "doc_id", "t", "n")
    df = vectors.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").cast("int").alias("df")).where(F.col("df") > 1)
    part = df.groupBy(F.pmod("t", F.lit(256)).alias("part")).agg(F.collect_list(F.struct("t", "df")).alias("v"))
    known = part.select(F.explode(F.sequence(F.lit(0), F.lit(max(0, tasks - 1)))).alias("task"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("slice"), F.lit(None).cast("string").alias("doc_id"), F.col("v.t").alias("t"), F.col("v.df").alias("n"))
    return known.unionByName(documents).repartitionById(max(1, tasks), "task").sortWithinPartitions("kind").select("kind", "slice", "doc_id", "t", "n").mapInArrow(lambda rows: alike.block_pairs(rows, n_docs, threshold), "slice long, a string, b string, cosine double")


def included(pairs: DataFrame, sliced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with another one alike in their slice, and the others."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return sliced.join(ends, "doc_id", "left_semi"), sliced.join(ends, "doc_id", "left_anti")


def first_sentences(sentences: DataFrame) -> DataFrame:
    """Of sentences with equal letters, ``doc_id, sent_no, sentence``, the first; those without ASCII letters all stay."""
    key = text.letters_key(F.col("sentence"))
    keyed = sentences.withColumn("key", key)
    first = keyed.where(F.col("key") != "").groupBy("key").agg(F.min(F.struct("doc_id", "sent_no", "sentence")).alias("x")).select("x.doc_id", "x.sent_no", "x.sentence")
    return first.unionByName(keyed.where(F.col("key") == "").select("doc_id", "sent_no", "sentence"))


def sentence_rows(documents: DataFrame) -> DataFrame:
    """``doc_id, sent_no, sentence`` of the simple split, in order."""
    return documents.select("doc_id", F.posexplode(text.sentence_array(text.soft_abbreviations(F.col("text")))).alias("sent_no", "sentence")).where(F.trim("sentence") != "")


def near_sentences(sentences: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id, sent_no, other``, both ways round, of sentences of one document whose words as bags have a cosine above ``threshold``."""
    words = sentences.select("doc_id", "sent_no", F.explode(text.words(F.col("sentence"))).alias("word")).groupBy("doc_id", "sent_no", "word").agg(F.count("*").cast("double").alias("n"))
    norms = words.groupBy("doc_id", "sent_no").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    other = words.select("doc_id", "word", F.col("sent_no").alias("other"), F.col("n").alias("m"))
    dots = words.join(other, ["doc_id", "word"]).where(F.col("sent_no") < F.col("other")).groupBy("doc_id", "sent_no", "other").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    both = dots.join(norms, ["doc_id", "sent_no"]).join(norms.toDF("doc_id", "other", "norm_other"), ["doc_id", "other"])
    near = both.where(F.col("dot") / (F.col("norm") * F.col("norm_other")) > threshold)
    return near.select("doc_id", "sent_no", "other").unionByName(near.select("doc_id", F.col("other").alias("sent_no"), F.col("sent_no").alias("other")))


def without_beaten(scored: DataFrame, near: DataFrame, group: list[str]) -> DataFrame:
    """``scored`` without sentences that are near another of the document, and of the group, of higher score, or as high and before it."""
    rival = scored.select(*group, "doc_id", F.col("sent_no").alias("other"), F.col("score").alias("o_score"))
    ahead = (F.col("o_score") > F.col("score")) | ((F.col("o_score") == F.col("score")) & (F.col("other") < F.col("sent_no")))
    met = scored.select(*group, "doc_id", "sent_no", "score").join(near, ["doc_id", "sent_no"]).join(rival, [*group, "doc_id", "other"])
    return scored.join(met.where(ahead).select(*group, "doc_id", "sent_no").distinct(), [*group, "doc_id", "sent_no"], "left_anti")


def distinct_sentences(sentences: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id, sent_no, sentence, score`` without those whose words another of the document of higher score, or as high and before it,
    shares by more than ``threshold``."""
    return without_beaten(sentences, near_sentences(sentences, threshold), [])


def sample(df: DataFrame, keys: list[str], group: list[str], k: int = 5, seed: int = 10) -> DataFrame:
    """``k`` rows of each group by a seeded hash of their keys, without replacement."""
    drawn = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(drawn, *keys))
    return df.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
