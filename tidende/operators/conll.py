"""Dependency trees as token rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Word classes that head a noun in the treebank, and lemmas by which an adjective does (fixed values).
HEADING_CLASSES = ("PO", "PD", "AC", "PI")
HEADING_LEMMAS = ("sådan", "hel", "al")


def mapped_tags(tokens: DataFrame, table: DataFrame, default: str = "*NONE*") -> DataFrame:
    """Tags by a table ``tag, universal``; those not in it get the default."""
    t = F.broadcast(table.select(F.col("tag").alias("cpos"), "universal"))
    joined = tokens.join(t, "cpos", "left").withColumn("u", F.coalesce("universal", F.lit(default)))
    return joined.withColumn("cpos", F.col("u")).withColumn("pos", F.col("u")).drop("u", "universal")


def ambiguity(lexicon: DataFrame, table: DataFrame, kept: tuple[str, ...] = ("ADJ", "ADP", "ADV", "CONJ", "NOUN", "PRON", "VERB", "X")) -> DataFrame:
    """``form, tag``: the universal tags that a form can have."""
    return lexicon.join(F.broadcast(table), "tag").where(F.col("universal").isin(*kept)).select("form", F.col("universal").alias("tag")).distinct()


def trees(tokens: DataFrame) -> DataFrame:
    """``sentence_id, tree``: a sentence as one array of structs, in order."""
    plain = [F.col("index").cast("int").alias("index"), "form", "lemma", "pos", F.col("head").cast("int").alias("head"), "label"]
    if "feats" not in tokens.columns:
        return tokens.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct(*plain))).alias("tree"))
    # Maps have no order, so they are put beside the tokens when these are sorted.
    sortable = F.struct(*plain, F.col("feats").alias("feats"))
    back = lambda t: F.struct(*[t[c].alias(c) for c in ("index", "form", "lemma", "pos", "head", "label")], F.str_to_map(t["feats"], F.lit(r"\|"), F.lit("=")).alias("feats"))
    return tokens.groupBy("sentence_id").agg(F.transform(F.array_sort(F.collect_list(sortable)), back).alias("tree"))



def column(tree, name: str):
    """Forms, lemmas or tags of a sentence."""
    return F.transform(tree, lambda t: t[name])


def features(tree):
    """The attributes of each token, joined."""
    return F.transform(tree, lambda t: F.array_join(F.map_keys(t["feats"]), "-"))


def children(tree, index):
    return F.filter(tree, lambda t: t["head"] == index)


def head_of(tree, index):
    """The token that a token hangs on; null for the root."""
    own = F.get(F.filter(tree, lambda t: t["index"] == index), F.lit(0))
    return F.get(F.filter(tree, lambda t: t["index"] == own["head"]), F.lit(0))


def head_word(tree):
    """The first token that hangs on the root; null if none does."""
    return F.get(F.filter(tree, lambda t: t["head"] == 0), F.lit(0))


def root_path(tree, index):
    """The heads above a token, the nearest first, up to that which hangs on the root; a circle ends where it closes."""
    step = lambda s, _: F.struct(
        F.when((s["at"] != 0) & ~F.array_contains(s["path"], s["at"]), F.concat(s["path"], F.array(s["at"]))).otherwise(s["path"]).alias("path"),
        F.coalesce(F.get(F.filter(tree, lambda t: t["index"] == s["at"]), F.lit(0))["head"], F.lit(0)).alias("at"),
    )
    first = F.coalesce(F.get(F.filter(tree, lambda t: t["index"] == index), F.lit(0))["head"], F.lit(0))
    return F.aggregate(tree, F.struct(F.array().cast("array<int>").alias("path"), first.alias("at")), step)["path"]


def with_token(tree, token):
    """The sentence with one more token at its end."""
    return F.concat(tree, F.array(token))


def rendered(tree):
    """A line a token: its index, form, tag, head and label."""
    return F.array_join(F.transform(tree, lambda t: F.concat_ws("\t", t["index"].cast("string"), t["form"], t["pos"], t["head"].cast("string"), t["label"])), "\n")


def tagged_by(tokens: DataFrame, tagger: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The hook for an external tagger or parser: it gets batches of whole sentences, ``sentence_id, tree``, and gives rows of ``schema``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield tagger(batch)

    return trees(tokens).mapInPandas(run, schema)


def head_words(tree) -> object:
    """Tokens whose head is the root."""
    return F.transform(F.filter(tree, lambda t: t["head"] == 0), lambda t: t["form"])


def noun_headed(rows: list[dict]) -> list[dict]:
    """Nouns headed by a determiner become heads: its other children and its own place go to them."""
    tree = {r["index"]: dict(r) for r in rows}
    for r in rows:
        noun = tree[r["index"]]
        article = tree.get(noun["head"])
        if article is None or not (noun["pos"] or "").lower().startswith("n"):
            continue
        if article["pos"] in HEADING_CLASSES or (article["pos"] == "AN" and (article["lemma"] or "").lower() in HEADING_LEMMAS):
            for other in tree.values():
                if other["head"] == article["index"] and other is not noun:
                    other["head"] = noun["index"]
            noun["head"], noun["label"] = article["head"], article["label"]
            article["head"] = noun["index"]
    return [tree[r["index"]] for r in rows]


def switched(sentences: DataFrame) -> DataFrame:
    """``sentence_id, index, form, head, label`` after nouns took the heads of their determiners; a sentence is one row."""

    @F.pandas_udf("array<struct<index:int,form:string,head:int,label:string>>")
    def run(batch: pd.Series) -> pd.Series:
        keys = ("index", "form", "head", "label")
        return pd.Series([[{k: t[k] for k in keys} for t in noun_headed([dict(t) for t in tree])] for tree in batch], dtype=object)

    return sentences.select("sentence_id", F.explode(run("tree")).alias("t")).select("sentence_id", "t.*")
