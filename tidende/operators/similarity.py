"""Keyphrase similarity of documents and candidate entities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidende.functions import text


def keyphrase_words(keyphrases: DataFrame, most: int = 10) -> DataFrame:
    """``entity, keyphrase, words``: at most ``most`` words of each keyphrase."""
    return keyphrases.select("entity", "keyphrase", F.slice(text.plain_tokens(F.col("keyphrase")), 1, most).alias("words"))


def without_stop_words(phrases: DataFrame, stop: list[str]) -> DataFrame:
    """Stop words out, but for the first word."""
    return phrases.withColumn("words", F.filter("words", lambda w, i: (i == 0) | ~w.isin(stop)))


def word_document_frequency(phrases: DataFrame, inlink: DataFrame) -> DataFrame:
    """``entity, word, n_entities``: of an entity and those linking to it, how many have the word in a keyphrase."""
    words = phrases.select("entity", F.explode(F.array_distinct("words")).alias("word")).where(F.col("word") != "").distinct()
    around = inlink.select("entity", "source").unionByName(phrases.select("entity", F.col("entity").alias("source"))).distinct()
    return around.join(words.select(F.col("entity").alias("source"), "word"), "source").groupBy("entity", "word").agg(F.countDistinct("source").alias("n_entities"))


def word_phrase_frequency(phrases: DataFrame) -> DataFrame:
    """``word, n_phrases``: keyphrases that contain the word."""
    each = phrases.select("entity", "keyphrase", F.explode(F.array_distinct("words")).alias("word")).where(F.col("word") != "")
    return each.groupBy("word").agg(F.count("*").alias("n_phrases"))


def npmi_weights(phrases: DataFrame, inlink: DataFrame, n_candidates: int | None = None) -> DataFrame:
    """``entity, word, weight``: normalised pointwise mutual information of word and entity, not below 0; numbers weigh nothing."""
    df = word_document_frequency(phrases, inlink)
    kf = word_phrase_frequency(phrases)
    sizes = inlink.groupBy("entity").agg(F.countDistinct("source").alias("n_in"))
    totals = phrases.agg(F.count("*").alias("n_kp"), F.countDistinct("entity").alias("n_ent"))
    own = phrases.select("entity", F.explode(F.array_distinct("words")).alias("word")).where(F.col("word") != "").distinct()
    joined = own.join(df, ["entity", "word"]).join(kf, "word").join(sizes, "entity", "left").join(F.broadcast(totals))
    j = F.col("n_entities") / (F.coalesce("n_in", F.lit(0)) + 1)
    p_e = F.lit(1.0) / (F.lit(float(n_candidates)) if n_candidates else F.col("n_ent"))
    pmi = F.log10(j / (p_e * F.col("n_phrases") / F.col("n_kp")))
    npmi = F.when(F.col("word").rlike(r"^\d+$"), 0.0).when(j >= 1, pmi).otherwise(F.greatest(F.lit(0.0), pmi / -F.log10(j)))
    return joined.select("entity", "word", npmi.alias("weight"))


def minimal_cover(positions: list[list[int]]) -> tuple[int, int, int]:
    """The smallest window that holds a position of every list: its first and last position and its span; the first wins."""
    events = sorted((p, k) for k, ps in enumerate(positions) for p in ps)
    held: dict[int, int] = {}
    best, left = (0, 0, 0), 0
    for p, k in events:
        held[k] = held.get(k, 0) + 1
        while len(held) == len(positions) and len(positions):
            first, which = events[left]
            if best[2] == 0 or p - first + 1 < best[2]:
                best = (first, p, p - first + 1)
            held[which] -= 1
            if not held[which]:
                del held[which]
            left += 1
    return best


def fold_score(phrases: list[list[str]], weights: dict[str, float], document: list[str], stop: frozenset[str] = frozenset()) -> float:
    """An entity's score against a document: keyphrases in order, each word counted in the first that matches."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(document):
        if w:
            at.setdefault(w, []).append(i)
    seen: set[str] = set()
    score = 0.0
    for phrase in sorted(phrases):
        left = [w for i, w in enumerate(phrase[:10]) if (i == 0 or w not in stop) and w not in seen]
        matched = list(dict.fromkeys(w for w in left if w in at))
        if not matched:
            continue
        span = minimal_cover([at[w] for w in matched])[2]
        whole = sum(weights.get(w, 0.0) for w in dict.fromkeys(left))
        seen.update(left)
        if whole:
            score += len(matched) / span * (sum(weights.get(w, 0.0) for w in matched) / whole) ** 2
    return score


def similarity_scores(found: DataFrame, documents: DataFrame, phrases: DataFrame, weights: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """``doc_id, mention, entity, similarity`` of candidates with their document.

    A sequential fold over an entity's keyphrases, so a vectorised UDF over rows that hold the two lists; a document's words and
    an entity's keyphrases are grouped once each, and joined to the pairs.
    """
    pairs = found.where(F.col("entity").isNotNull()).select("doc_id", "entity").distinct()
    words = documents.select("doc_id", text.plain_tokens(F.regexp_replace("text", r"\s+", " ")).alias("document"))
    w = weights.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("weights"))
    p = phrases.groupBy("entity").agg(F.collect_list("words").alias("phrases"))
    stops = frozenset(stop or [])

    @F.pandas_udf("double")
    def score(ps: pd.Series, ws: pd.Series, ds: pd.Series) -> pd.Series:
        return pd.Series([fold_score([list(x) for x in a], dict(b) if b is not None else {}, list(d), stops) for a, b, d in zip(ps, ws, ds, strict=True)], dtype=float)

    ready = pairs.join(p, "entity").join(w, "entity", "left").join(words, "doc_id")
    scored = ready.select("doc_id", "entity", score("phrases", "weights", "document").alias("similarity"))
    return found.select("doc_id", "mention", "entity").join(scored, ["doc_id", "entity"], "left").fillna(0.0, ["similarity"]).select("doc_id", "mention", "entity", "similarity")


def normalised(scores: DataFrame) -> DataFrame:
    """Each mention's similarities over their sum; all 1 where that is 0."""
    total = F.sum("similarity").over(Window.partitionBy("doc_id", "mention"))
    return scores.withColumn("similarity", F.when(total == 0, 1.0).otherwise(F.col("similarity") / total))
