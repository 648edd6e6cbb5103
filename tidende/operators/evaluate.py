"""Metrics of recognition and disambiguation, and statistics of a case."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiset_matches(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """``doc_id, key, gold, predicted, matched`` by lower-cased mention: each prediction is used up by one gold mention, so the lesser count matches."""
    g = gold.groupBy("doc_id", F.lower("mention").alias("key")).agg(F.count("*").alias("gold"))
    p = predicted.groupBy("doc_id", F.lower("mention").alias("key")).agg(F.count("*").alias("predicted"))
    both = g.join(p, ["doc_id", "key"], "full").fillna(0, ["gold", "predicted"])
    return both.withColumn("matched", F.least("gold", "predicted"))


def partial_matches(rows: list[tuple[str, int, int, int]]) -> tuple[int, int, int]:
    """Matched, missed and left-over words of one document, of rows ``mention, gold, predicted, matched`` in order."""
    matched = sum(n * len(key.split(" ")) for key, _, _, n in rows)
    missed = sum((g - n) * len(key.split(" ")) for key, g, _, n in rows)
    left = [key for key, _, p, n in rows for _ in range(p - n)]
    for key, g, _, _ in rows:
        for _ in range(g):
            for i, other in enumerate(left):
                if key in other:
                    rest = left.pop(i).replace(key, "")
                    if any(c.isalpha() for c in rest):
                        left.append(rest)
                    matched, missed = matched + 1, missed - 1
                    break
    return matched, missed, sum(len(x.split(" ")) for x in left)


def partial_sums(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row, ``matched_words, gold_words, predicted_words``, by ``partial_matches`` of each document."""
    rows = multiset_matches(gold, predicted).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("key", "gold", "predicted", "matched"))).alias("rows"))

    @F.pandas_udf("matched long, missed long, excess long")
    def partial(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([partial_matches([(x["key"], int(x["gold"]), int(x["predicted"]), int(x["matched"])) for x in rows]) for rows in batch], columns=["matched", "missed", "excess"])

    return rows.select(partial("rows").alias("p")).agg(F.sum("p.matched").alias("matched_words"), F.sum(F.col("p.matched") + F.col("p.missed")).alias("gold_words"), F.sum(F.col("p.matched") + F.col("p.excess")).alias("predicted_words"))


def without_prefixes(gold: DataFrame, bad: list[str]) -> DataFrame:
    """Gold mentions without those whose entity begins with a bad prefix."""
    out = gold
    for prefix in bad:
        out = out.where(F.col("entity").isNull() | ~F.col("entity").startswith(prefix))
    return out


def recognition(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: precision and recall, strict and partial, and counts of the predictions' documents.

    Partial: a strict match counts as many words as it has. Then each gold mention, in order, that stands inside a prediction left over uses
    that up, the first by name; letters that remain of it are a prediction again. Such a match counts one, what is left its words.
    """
    m = multiset_matches(gold, predicted)
    sums = m.agg(F.sum("matched").alias("matched"), F.sum("gold").alias("gold"), F.sum("predicted").alias("predicted"))
    sums = sums.join(partial_sums(gold, predicted))
    per = predicted.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct(F.lower("mention")).alias("d")).agg(F.avg("n").alias("mentions_per_doc"), F.stddev_pop("n").alias("mentions_std"), F.avg("d").alias("distinct_per_doc"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return sums.join(per).select("matched", "gold", "predicted", ratio("matched", "predicted").alias("precision"), ratio("matched", "gold").alias("recall"), ratio("matched_words", "predicted_words").alias("word_precision"), ratio("matched_words", "gold_words").alias("word_recall"), "mentions_per_doc", "mentions_std", "distinct_per_doc")


def accuracy(gold: DataFrame, predicted: DataFrame, bad_prefixes: list[str] | None = None) -> DataFrame:
    """One row, ``n, correct, accuracy``: over gold mentions with a prediction; nulls agree with nulls; gold entities of bad prefixes are left out."""
    g = without_prefixes(gold, bad_prefixes or [])
    p = predicted.groupBy("doc_id", F.lower("mention").alias("key")).agg(F.max("entity").alias("found"))
    j = g.withColumn("key", F.lower("mention")).join(p, ["doc_id", "key"])
    ok = F.coalesce(F.lower("entity").eqNullSafe(F.lower("found")), F.lit(False))
    return j.agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("correct"), F.avg(ok.cast("double")).alias("accuracy"))


def case_statistics(articles: DataFrame, disambiguations: DataFrame) -> DataFrame:
    """One row: recognitions and resolutions, in all, a document, and distinct; words a document."""
    words = articles.select("doc_id", F.size(F.split(F.trim("text"), r"\s+")).alias("words"))
    per = disambiguations.groupBy("doc_id").agg(F.count("*").alias("rec"), F.count("entity").alias("dis"))
    docs = words.join(per, "doc_id", "left").fillna(0, ["rec", "dis"])
    a = docs.agg(F.count("*").alias("docs"), F.sum("rec").alias("recognitions"), F.sum("dis").alias("resolutions"), F.avg("words").alias("words_per_doc"), F.avg("rec").alias("rec_per_doc"), F.avg("dis").alias("dis_per_doc"))
    b = disambiguations.join(articles.select("doc_id"), "doc_id", "left_semi").agg(F.countDistinct(F.lower("mention")).alias("distinct_mentions"), F.countDistinct("entity").alias("distinct_entities"))
    return a.join(b)


def restored_order(found: DataFrame, mentions: DataFrame) -> DataFrame:
    """``doc_id, pos, mention, entity``: results in the order of the document, the first match of each mention; ``found`` has the ``pos`` it was found at."""
    first = found.groupBy("doc_id", F.lower("mention").alias("key")).agg(F.min(F.struct("pos", "entity"))["entity"].alias("entity"))
    return mentions.select("doc_id", "pos", "mention", F.lower("mention").alias("key")).join(first, ["doc_id", "key"], "left").select("doc_id", "pos", "mention", "entity")
