"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

import datetime as d

import pytest
from pyspark.sql import functions as F

from tidende.llm import distinctive, encoding, language, mixing, names, neardup, ngrams, sentences, tokenizer

T = d.datetime(2018, 1, 1)
LONG = "Hus og ø bil. " * 20_000
#: Names used inside the operators.
CLASH = ["k", "n", "term", "tf", "df", "r", "s", "w", "runs", "class_id", "segment", "x", "pattern", "times", "h", "code", "toks", "uses", "key", "name", "ids2", "terms2"]

DOCS = ("doc_id string, text string", [("a", "Det er en god dag i byen. Hun kom."), ("a", "Det er en god dag i byen. Hun kom."), ("b", None), (None, "tekst uden id"), ("c", ""), ("d", "  \n "), ("e", LONG), ("f", "Det er en god dag i byen. Hun kom.")])
TERMS = ("doc_id string, terms array<string>, run_at timestamp_ntz", [("a", ["Hus", " hus ", None, "", "bil"], T), ("a", ["Hus", " hus ", None, "", "bil"], T), ("a", ["gammel"], None), ("b", None, T), (None, ["x"], T), ("c", [], T), ("d", ["bil", "hus"], T), ("e", ["ord"] * 300_000, T)])
PRIORS = ("mention string, entity string", [("Anna Hansen", "anna hansen"), ("Anna Hansen", None), ("anna hansen", None), (None, "x"), ("", None), ("-", None), ("By", "by (sogn)"), ("Bo " + "x" * 50_000, None)])
NUMBERED = ("doc_id long, text string, lang string, source string", [(1, "Det er en meget god dag i byen, siger hun til avisen.", "da", "A "), (1, "Det er en meget god dag i byen, siger hun til avisen.", "da", "a"), (2, None, None, None), (None, "x", "da", "a"), (3, "", "", "b"), (4, "😀 !!", "xx", " "), (5, LONG, "DA", "b"), (6, "The house is very old and the street is long, she said.", "da", "b")])
LABELS = ("label string, lang string", [("da", "da"), ("en", "en"), (None, "x"), ("DA", "da")])
TARGETS = ("source string, target_share double, max_repeats int", [("a", 0.5, 2), ("b", 0.5, 3), ("none", None, None), (None, 0.1, 1)])
ABBR = ("abbr string", [("f.eks.",), (None,), ("kl.",)])


def run_all(make):
    """Each operator over tables made from its rows."""
    return {
        "p1": lambda: distinctive.most_distinctive(make(TERMS)),
        "p1w": lambda: distinctive.parsimonious_weights(make(TERMS)),
        "p2": lambda: encoding.garbled_records(make(DOCS)),
        "p4": lambda: neardup.alike_documents(make(DOCS)),
        "p4g": lambda: neardup.near_duplicates(make(DOCS)),
        "p5": lambda: sentences.sentences(make(DOCS), make(ABBR)),
        "p6": lambda: names.variant_pairs(make(PRIORS)),
        "p7": lambda: ngrams.term_statistics(make(TERMS), 3),
        "p7m": lambda: ngrams.marked_terms(make(TERMS)),
        "p8": lambda: tokenizer.encode_texts(make(NUMBERED), keep=["doc_id"]),
        "p9": lambda: mixing.mix(make(NUMBERED), make(TARGETS)),
        "p9s": lambda: mixing.shares(make(NUMBERED), make(TARGETS)),
        "p9o": lambda: mixing.mix(make(NUMBERED), make(TARGETS), sized=mixing.distinct_texts(make(NUMBERED))),
        "p10": lambda: language.label_cases(make(NUMBERED), make(LABELS)),
    }


ALL = list(run_all(None))


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ALL)
def test_empty_tables(spark, name):
    out = run_all(lambda t: spark.createDataFrame([], t[0]))[name]()
    assert out.count() == 0


@pytest.mark.parametrize("name", ALL)
def test_all_null(spark, name):
    out = run_all(lambda t: spark.createDataFrame([tuple([None] * (t[0].count(",") + 1))] * 2, t[0]))[name]()
    assert out.count() == (2 if name == "p8" else 0)


@pytest.mark.parametrize("name", ALL)
def test_dirty_rows_and_clashing_columns(spark, name):
    plain = rows(run_all(lambda t: spark.createDataFrame(t[1], t[0]))[name]())
    more = rows(run_all(lambda t: spark.createDataFrame(t[1], t[0]).select("*", *[F.lit(7).alias(c) for c in CLASH if f"{c} " not in t[0]]))[name]())
    assert plain == more


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_defined_results(spark):
    make = lambda t: spark.createDataFrame(t[1], t[0])
    assert values(distinctive.most_distinctive(make(TERMS))) == [("a", "hus"), ("d", "bil"), ("e", "ord")]
    assert values(ngrams.term_statistics(make(TERMS), 1)) == [("bil", 1, 2, 2), ("hus", 1, 3, 2), ("ord", 1, 300_000, 1)]
    assert values(neardup.alike_documents(make(DOCS))) == [("a", "f")]
    assert values(names.variant_pairs(make(PRIORS))) == [("Anna Hansen", "anna hansen")]
    found = sentences.sentences(make(DOCS), make(ABBR)).where("doc_id in ('a', 'b', 'c', 'd')")
    assert values(found.select("doc_id", "start_char", "end_char")) == [("a", 0, 25), ("a", 26, 34)]
    ids = {r.doc_id: r.ids for r in tokenizer.encode_texts(make(NUMBERED), keep=["doc_id"]).collect()}
    assert ids[2] == [] and ids[3] == [] and len(ids[5]) > 10_000
    assert {(r.source, r.most_times) for r in mixing.shares(make(NUMBERED), make(TARGETS)).where("uses > 0").collect()}
