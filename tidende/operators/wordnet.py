"""Synonyms and hypernyms from word-net tables, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hypernyms too general to say anything (fixed values).
BANNED_RANKS = ["person", "hoved", "menneske", "individ", "mand", "m", "k'er"]


def allowed_terms(terms: DataFrame, first: int = 31) -> DataFrame:
    """The first plain terms of each document, ``doc_id, rank, kind, term``, those with foreign letters, slashes or apostrophes left out."""
    plain = terms.where((F.col("kind") == "") & ~F.col("term").rlike(r"[łż'/]"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "term"))
    return plain.withColumn("k", order).where(F.col("k") <= first).select("doc_id", "term")


def synonyms(words: DataFrame, senses: DataFrame) -> DataFrame:
    """``form, synonym``: other single words of a word's synsets."""
    s = words.join(senses, words["id"] == senses["word_id"]).select("form", "synset_id")
    pairs = s.join(s.select(F.col("form").alias("synonym"), "synset_id"), "synset_id")
    return pairs.where((F.col("form") != F.col("synonym")) & ~F.trim("synonym").contains(" ")).select("form", "synonym").distinct()


def hypernyms(words: DataFrame, senses: DataFrame, relations: DataFrame, synsets: DataFrame) -> DataFrame:
    """``form, hypernym``: single words one level up, but for the top and banned ones."""
    own = words.join(senses, words["id"] == senses["word_id"]).select("form", "synset_id")
    up = relations.where(F.col("name2") == "has_hyperonym").select(F.col("synsets_id").alias("synset_id"), F.col("value").alias("up_id"))
    above = synsets.select(F.col("id").alias("up_id"))
    upper = words.select(F.col("id").alias("word_id"), F.col("form").alias("hypernym")).join(senses.withColumnRenamed("synset_id", "up_id"), "word_id").select("up_id", "hypernym")
    found = own.join(up, "synset_id").join(above, "up_id").join(upper, "up_id")
    kept = (F.col("hypernym") != "TOP") & ~F.trim("hypernym").contains(" ") & ~F.lower("hypernym").isin(BANNED_RANKS) & ~F.col("hypernym").rlike(r"[łż'/]")
    return found.where(kept).select("form", "hypernym").distinct()


def expanded(terms: DataFrame, syn: DataFrame, hyper: DataFrame, skip_without_synonyms: bool = True) -> DataFrame:
    """``doc_id, kind, term`` with tag ``f`` of the terms' synonyms and hypernyms; hypernyms only of documents with a synonym, by default."""
    s = terms.join(syn, terms["term"] == syn["form"]).select("doc_id", F.lower("synonym").alias("term"))
    h = terms.join(hyper, terms["term"] == hyper["form"]).select("doc_id", F.lower("hypernym").alias("term"))
    if skip_without_synonyms:
        h = h.join(s.select("doc_id").distinct(), "doc_id", "left_semi")
    return s.unionByName(h).distinct().select("doc_id", F.lit("f").alias("kind"), "term")


def ranked(terms: DataFrame, hyper: DataFrame) -> DataFrame:
    """``doc_id, rank, lemmas``: a document's terms under each hypernym."""
    found = terms.join(hyper, terms["term"] == hyper["form"]).select("doc_id", F.lower("hypernym").alias("rank"), "term")
    return found.groupBy("doc_id", "rank").agg(F.array_sort(F.collect_set("term")).alias("lemmas"))
