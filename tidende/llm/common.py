"""What several operators of this subpackage share."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: What counts as blank around a term or a label.
BLANKS = " \t\r\n\u00a0"


def _nfc(terms: pd.Series) -> pd.Series:
    compose = unicodedata.normalize
    return terms.map(lambda row: None if row is None else [None if t is None else compose("NFC", t) for t in row])


#: Called nondeterministic so that the optimizer doesn't run it once more for a filter on its result.
nfc_array = F.pandas_udf(_nfc, ArrayType(StringType())).asNondeterministic()


def trim_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def latest_terms(doc2terms: DataFrame) -> DataFrame:
    """``doc_id, terms``: the cleaned terms of each document's latest run.

    A term is composed (NFC), trimmed and lower-cased; null and blank ones are no terms. Rows of equal
    ``run_at`` are taken as equal (the greatest list wins, so the choice is deterministic); a null ``run_at`` is
    older than any other; rows without ``doc_id`` name no record and are left out. Only lists that hold a
    character from U+0300 on (all below are composed already) pass through Python.
    """
    latest = doc2terms.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.struct("run_at", "terms")).alias("r")).select("doc_id", F.col("r.terms").alias("terms"))
    odd = F.exists("terms", lambda t: F.coalesce(t.rlike(r"[^\x00-\x{2FF}]"), F.lit(False)))
    composed = F.coalesce(nfc_array(F.when(odd, F.col("terms"))), F.col("terms"))
    clean = F.transform(composed, lambda t: F.lower(trim_blanks(t)))
    kept = F.filter(clean, lambda t: t.isNotNull() & (t != ""))
    return latest.select("doc_id", F.coalesce(kept, F.array().cast("array<string>")).alias("terms"))
