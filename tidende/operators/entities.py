"""Entity names within documents: variants of one another, terms they cover, headlines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Endings by which variants of a name may differ (fixed values).
ENDINGS = ["", "e", "else", "en", "er", "et", "ende", "ene", "erne", "es", "i", "ing", "is", "isme", "s", "ske", "n", "ne", "ning", "h", "hed"]


def variants(mentions: DataFrame) -> DataFrame:
    """``mention, canonical, n``: mentions that hold another as words, its ending apart, share a canonical name.

    ``mentions`` is ``mention`` by occurrence, recognised names only. Each name gives its runs of words, the last one with each
    ending off, so containment is an equi-join; the canonical name is the shortest one contained, and of several
    the most frequent, then the first.
    """
    counted = mentions.where(F.trim("mention") != "").groupBy(F.lower(F.trim("mention")).alias("mention")).agg(F.count("*").alias("n"))
    words = F.split(F.regexp_replace("mention", "-", " "), r"\s+")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.size("w") - i + 1), lambda k: F.array_join(F.slice("w", i, k), " "))))
    split = counted.withColumn("w", words).withColumn("run", F.explode(F.array_distinct(runs)))
    ending = F.explode(F.array(*[F.lit(e) for e in ENDINGS])).alias("ending")
    stems = split.select("mention", "n", "run", ending).where(F.expr("ending = '' or (run like concat('%', ending) and length(run) > length(ending) + 2)"))
    stems = stems.select("mention", "n", F.expr("substring(run, 1, length(run) - length(ending))").alias("stem")).distinct()
    whole = counted.select(F.regexp_replace("mention", "-", " ").alias("stem"), F.col("mention").alias("base"), F.col("n").alias("base_n"))
    found = stems.join(whole, "stem")
    best = F.min(F.struct(F.length("base"), (-F.col("base_n")).alias("f"), "base"))
    return found.groupBy("mention").agg(F.max("n").alias("n"), best.alias("b")).select("mention", F.col("b.base").alias("canonical"), "n")


def concatenated(found: DataFrame) -> DataFrame:
    """``mention, name``: all variants of a canonical name joined, the most frequent first."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("f"), "mention")))
    groups = found.groupBy("canonical").agg(F.array_join(F.transform(listed, lambda x: F.concat(F.lit("*r."), x["mention"])), "").alias("name"), F.count("*").alias("k"))
    return found.join(groups.where(F.col("k") > 1), "canonical").select("mention", "name")


def without_covered_terms(terms: DataFrame) -> DataFrame:
    """``doc_id, kind, term`` without plain terms that stand in an entity of the same document; the document is the key, so only its rows meet."""
    plain, tagged = terms.where(F.col("kind") == ""), terms.where(F.col("kind") != "")
    names = tagged.groupBy("doc_id").agg(F.concat_ws("\n", F.array_sort(F.collect_set(F.lower("term")))).alias("names"))
    kept = plain.join(names, "doc_id", "left").where(F.col("names").isNull() | (F.instr(F.col("names"), F.col("term")) == 0)).select("doc_id", "kind", "term")
    return kept.unionByName(tagged)


def annotate(headline: str, names: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Entities found in a headline, the longest name first, and the words that are left."""
    low, found = f" {headline.lower()} ", []
    for name, term in sorted(names, key=lambda x: (-len(x[0]), x)):
        bare = name.split("(")[0].strip().lower()
        if bare and bare in low:
            low = low.replace(bare, " ")
            found.append(term)
    return found, low.split()


def annotated_headlines(headlines: DataFrame, tags: DataFrame) -> DataFrame:
    """``doc_id, term`` of headlines ``doc_id, headline``: tagged entities of the document found in it, and its other words."""
    by_doc = tags.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct(F.col("term").alias("name"), F.concat(F.lit("*"), F.col("kind"), F.lit("."), F.col("term")).alias("tag")))).alias("names"))

    @F.pandas_udf("array<string>")
    def run(titles: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for t, n in zip(titles, names, strict=True):
            found, rest = annotate(t or "", [(x["name"], x["tag"]) for x in n] if n is not None else [])
            out.append(list(dict.fromkeys([*found, *[w.strip(".,:;!?()\"»«”“") for w in rest]])))
        return pd.Series(out, dtype=object)

    return headlines.join(by_doc, "doc_id", "left").select("doc_id", F.explode(run("headline", "names")).alias("term")).where(F.col("term") != "")


def importance(cluster_entities: DataFrame) -> DataFrame:
    """``entity, clusters``: in how many clusters each entity is."""
    return cluster_entities.groupBy("entity").agg(F.countDistinct("cluster_id").alias("clusters"))


def neighbours(mentions: DataFrame, most_words: int = 32, most: int = 10) -> DataFrame:
    """``doc_id, pos, mention, context``: the mentions around each, backward and forward by turns, up to so many words and mentions."""
    by = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-most, most)
    here = F.collect_list(F.struct("pos", "mention")).over(by)
    near = F.array_sort(F.transform(F.filter("around", lambda x: x["pos"] != F.col("pos")), lambda x: F.struct(F.abs(x["pos"] - F.col("pos")).alias("d"), x["pos"].alias("p"), x["mention"].alias("m"))))
    step = lambda s, x: F.struct((s["w"] + F.size(F.split(x["m"], " "))).alias("w"), F.when((s["w"] + F.size(F.split(x["m"], " ")) <= most_words) & (F.size(s["l"]) < most), F.concat(s["l"], F.array(x["m"]))).otherwise(s["l"]).alias("l"))
    start = F.struct(F.size(F.split("mention", " ")).alias("w"), F.array().cast("array<string>").alias("l"))
    dense = mentions.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "mention")))
    return dense.withColumn("around", here).select("doc_id", "pos", "mention", F.aggregate(near, start, step)["l"].alias("context"))
