"""How distinctive a term is per record: parsimonious language models."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidende.io import materialize
from tidende.llm.common import latest_terms

#: Terms with more than one of so many of all rows (record, term) are broadcast (about 100 bytes each); there are fewer than that.
HOT_SHARE = 100_000


def em_probabilities(tf: list[np.ndarray], background: list[np.ndarray], mix: float, max_iter: int, tol: float) -> list[np.ndarray]:
    """P(term | record) of each record by expectation-maximisation, all records of a batch at once.

    E: e = tf * mix * p / (mix * p + (1 - mix) * background); M: p = e / sum of e in the record.
    """
    sizes = np.array([len(x) for x in tf], dtype=np.int64)
    out: list[np.ndarray] = [np.zeros(0)] * len(tf)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    starts = np.concatenate([[0], np.cumsum(sizes[filled])[:-1]])
    owner = np.repeat(np.arange(len(filled)), sizes[filled])
    count = np.concatenate([np.asarray(tf[i], dtype=float) for i in filled])
    back = (1.0 - mix) * np.concatenate([np.asarray(background[i], dtype=float) for i in filled])
    p = count / np.add.reduceat(count, starts)[owner]
    for _ in range(max_iter):
        own = mix * p
        e = count * own / (own + back)
        new = e / np.maximum(np.add.reduceat(e, starts), 1e-300)[owner]
        moved = np.abs(new - p).max()
        p = new
        if moved < tol:
            break
    for k, i in enumerate(filled):
        out[i] = p[starts[k] : starts[k] + sizes[i]]
    return out


def term_frequencies(doc2terms: DataFrame) -> DataFrame:
    """``rid, doc_id, terms, tf`` of each record with a term: its different terms and their counts, side by side, counted within the record."""

    @F.pandas_udf("terms array<string>, tf array<int>")
    def counted(lists: pd.Series) -> pd.DataFrame:
        counts = [Counter(x) for x in lists]
        return pd.DataFrame({"terms": [list(c) for c in counts], "tf": [list(c.values()) for c in counts]})

    latest = latest_terms(doc2terms).select("doc_id", counted.asNondeterministic()("terms").alias("c"))
    return materialize(latest.where(F.size("c.terms") > 0).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "c.terms", "c.tf"), "p1-records")


def scored_records(doc2terms: DataFrame, mix: float = 0.5, max_iter: int = 60, tol: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """``rid, n_docs, size, terms`` of each record: its occurrences, and its terms as structs ``term, tf, df, background, plm``; and ``rid, doc_id``.

    Between the shuffles a record goes by a number. Hot terms get their background by broadcast and the others by a join in which no
    key is hot.
    """
    records = term_frequencies(doc2terms)
    tf = records.select("rid", F.explode(F.arrays_zip("terms", "tf")).alias("t")).select("rid", F.col("t.terms").alias("term"), "t.tf")
    df = materialize(tf.groupBy("term").agg(F.count("*").alias("df")), "p1-df")
    # Two scalars.
    n, total = records.count(), df.agg(F.sum("df")).first()[0] or 1
    is_hot = F.col("df") * HOT_SHARE > total
    cold = tf.join(F.broadcast(df.where(is_hot).select("term")), "term", "left_anti").join(df.where(~is_hot), "term")
    joined = tf.join(F.broadcast(df.where(is_hot)), "term").unionByName(cold)
    per = joined.groupBy("rid").agg(F.sum("tf").alias("size"), F.collect_list(F.struct("term", "tf", "df")).alias("t"))

    @F.pandas_udf("array<double>")
    def em(counts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series(em_probabilities(list(counts), [np.asarray(x, dtype=float) / total for x in dfs], mix, max_iter, tol), dtype=object)

    background = lambda t: (t["df"] / F.lit(float(total))).alias("background")
    both = F.zip_with("t", em(F.col("t.tf"), F.col("t.df")), lambda t, p: F.struct(t["term"].alias("term"), t["tf"].alias("tf"), t["df"].alias("df"), background(t), p.alias("plm")))
    return per.select("rid", F.lit(n).alias("n_docs"), "size", both.alias("terms")), records.select("rid", "doc_id")


def parsimonious_weights(doc2terms: DataFrame, mix: float = 0.5, max_iter: int = 60, tol: float = 1e-6) -> DataFrame:
    """``doc_id, term, tf, df, n_docs, background, plm``: every term of every record with its parsimonious probability.

    The background model is P(t | collection) = df / sum of df, so a term of every record is explained by the
    background and loses its mass, and rare ones keep theirs; terms whose mass vanished stay with a ``plm`` near 0.
    A record without terms gives no row; an empty table gives an empty result. Ties keep equal weights. Extra columns are
    ignored.
    """
    scored, named = scored_records(doc2terms, mix, max_iter, tol)
    rows = scored.join(named, "rid").select("doc_id", "n_docs", F.explode("terms").alias("x"))
    return rows.select("doc_id", "x.term", "x.tf", "x.df", "n_docs", "x.background", "x.plm")


def gained(x: Column) -> Column:
    """Whether expectation-maximisation left a term of ``scored_records`` its share of the record at least, as the background took none of it."""
    return x["plm"] * F.col("size") >= x["tf"]


def candidates() -> Column:
    """The terms of a record that the converged probabilities rank above the background; all of them if there is none."""
    kept = F.filter("terms", gained)
    return F.when(F.size(kept) > 0, kept).otherwise(F.col("terms"))


def most_distinctive(doc2terms: DataFrame) -> DataFrame:
    """``doc_id, term``: each record's term of greatest weight, among those that the converged probabilities rank above the background.

    The exact check within the record: weights, tf * (ln((1 + n) / (1 + df)) + 1), are worked out for the candidates; a
    term that lost mass to the background is looked at only if its tf times the greatest possible factor reaches the best
    of them, so none is lost. Ties by code point.
    """
    most = F.log((F.lit(1.0) + F.col("n_docs")) / F.lit(2.0)) + F.lit(1.0)
    weight = lambda x: x["tf"] * (F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + x["df"])) + F.lit(1.0))
    ranked = lambda terms: F.array_min(F.transform(terms, lambda x: F.struct((-weight(x)).alias("w"), x["term"].alias("term"))))
    scored, named = scored_records(doc2terms)
    best = scored.withColumn("best", ranked(candidates()))
    rest = F.filter("terms", lambda x: ~gained(x) & (x["tf"] * most >= -F.col("best.w")))
    found = best.select("rid", F.least("best", F.coalesce(ranked(rest), F.col("best")))["term"].alias("term"))
    return found.join(named, "rid").select("doc_id", "term")
