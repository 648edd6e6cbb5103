"""Queries of this subpackage, and the SQL that says the same where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidende.io import table
from tidende.llm import distinctive, encoding, language, mixing, names, neardup, ngrams, sentences, tokenizer

#: Cleaned terms of the latest runs, as the operators make them.
_LATEST = r"""
latest AS (
  SELECT doc_id, terms FROM (
    SELECT doc_id, terms, row_number() OVER (PARTITION BY doc_id ORDER BY run_at DESC NULLS LAST, terms DESC NULLS LAST) AS k
    FROM doc2terms WHERE doc_id IS NOT NULL) WHERE k = 1),
tokens AS (
  SELECT doc_id, lower(trim(nfc_normalize(t), ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS term
  FROM (SELECT doc_id, unnest(terms) AS t FROM latest) WHERE t IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens WHERE term <> '' GROUP BY ALL),
n AS (SELECT count(DISTINCT doc_id) AS n FROM tf),
df AS (SELECT term, count(*) AS df, sum(tf) AS occurrences FROM tf GROUP BY term)
"""


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return distinctive.most_distinctive(table(spark, sf, "doc2terms"))


def p1_weights(spark: SparkSession, sf: str) -> DataFrame:
    return distinctive.parsimonious_weights(table(spark, sf, "doc2terms"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.garbled_records(table(spark, sf, "example_documents")).select("doc_id").distinct()


def p2_restored(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.garbled_records(table(spark, sf, "example_documents"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.alike_documents(table(spark, sf, "example_documents"))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicates by runs of five words, from 0.8 on: one row a document."""
    return neardup.near_duplicates(table(spark, sf, "example_documents"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    found = sentences.sentences(table(spark, sf, "example_documents"), table(spark, sf, "abbreviations"))
    return found.select("doc_id", "start_char", "end_char").distinct()


def p5_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentences(table(spark, sf, "example_documents"), table(spark, sf, "abbreviations"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.variant_pairs(table(spark, sf, "priors"))


def p6_names(spark: SparkSession, sf: str) -> DataFrame:
    """Each spelling with the name it stands for."""
    return names.linked_names(table(spark, sf, "priors"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return ngrams.marked_terms(table(spark, sf, "doc2terms")).where(F.col("mark").isNotNull()).select("term", "mark")


def p7_terms(spark: SparkSession, sf: str) -> DataFrame:
    return ngrams.marked_terms(table(spark, sf, "doc2terms"))


def p7_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """The n-grams that occur more than once, of up to eight terms, written out."""
    return ngrams.term_statistics(table(spark, sf, "doc2terms"), 8, 2).select(F.translate("ngram", ngrams.SEP, "|").alias("ngram"), "n", "tf", "df")


def p7_classes(spark: SparkSession, sf: str) -> DataFrame:
    """All n-grams, of any length, in classes of equal occurrences."""
    return ngrams.ngram_classes(table(spark, sf, "doc2terms")).select("record", "start", "n_min", "n_max", "tf", "df")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizer.encode_texts(table(spark, sf, "documents"), keep=["doc_id"])


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.shares(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """The mix of distinct texts, each of all sources that delivered it."""
    d, t = table(spark, sf, "documents"), table(spark, sf, "mix_targets")
    return mixing.mix(d, t, sized=mixing.distinct_texts(d))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.label_cases(table(spark, sf, "documents"), table(spark, sf, "language_names")).select("doc_id", "lang")


def p10_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's segments with language and confidence."""
    return language.detect(table(spark, sf, "documents"), table(spark, sf, "language_names"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_weights, p2_found, p2_restored, p4_found, p4_groups, p5_found, p5_sentences, p6_found, p6_names, p7_found, p7_terms, p7_ngrams, p7_classes, p8_ids, p9_mix, p9_shares, p9_overlap, p10_found, p10_segments)}

SQL = {
    "p1_found": f"""WITH {_LATEST},
w AS (SELECT doc_id, term, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0) AS w FROM tf JOIN df USING (term), n)
SELECT doc_id, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, encode(term)) AS k FROM w) WHERE k = 1""",
    "p4_found": r"""WITH w AS (
  SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\x0B\f]+'), lambda x: x <> '') AS w
  FROM example_documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
d AS (SELECT row_number() OVER () AS k, doc_id, list_distinct([w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2] for i in range(1, len(w) - 1)]) AS runs FROM w WHERE len(w) >= 3),
r AS (SELECT k, doc_id, len(runs) AS n, unnest(runs) AS run FROM d),
p AS (SELECT a.k, b.k AS l, any_value(a.doc_id) AS x, any_value(b.doc_id) AS y, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM r a JOIN r b ON a.run = b.run AND a.k <> b.k GROUP BY a.k, b.k)
SELECT DISTINCT x AS doc_id_a, y AS doc_id_b FROM p WHERE encode(x) < encode(y) AND c >= 0.5 * (na + nb - c)""",
    "p7_found": f"""WITH {_LATEST}
SELECT term, CASE WHEN df < 3 THEN 'rare' ELSE 'common' END AS mark FROM df, n WHERE df < 3 OR df > 0.25 * n""",
    "p7_ngrams": r"""WITH latest AS (
  SELECT doc_id, list_filter(list_transform(terms, lambda t: lower(trim(nfc_normalize(t), ' ' || chr(9) || chr(10) || chr(13) || chr(160)))), lambda t: t IS NOT NULL AND t <> '') AS w FROM (
    SELECT doc_id, terms, row_number() OVER (PARTITION BY doc_id ORDER BY run_at DESC NULLS LAST, terms DESC NULLS LAST) AS k FROM doc2terms WHERE doc_id IS NOT NULL) WHERE k = 1),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM latest), g AS (SELECT doc_id, w, i, unnest(range(1, least(8, len(w) - i + 1) + 1)) AS n FROM places)
SELECT array_to_string(w[i:i + n - 1], '|') AS ngram, n::INT AS n, count(*) AS tf, count(DISTINCT doc_id) AS df FROM g GROUP BY 1, 2 HAVING count(*) > 1""",
    "p7_terms": f"""WITH {_LATEST}
SELECT term, occurrences::BIGINT AS tf, df, CASE WHEN df < 3 THEN 'rare' WHEN df > 0.25 * n THEN 'common' END AS mark FROM df, n""",
}
