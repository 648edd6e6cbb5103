"""Frequency of every distinct term and n-gram: a suffix array in sorted shards, and its common-prefix intervals."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidende.io import materialize
from tidende.llm.common import latest_terms

#: A term, or the first terms of a suffix, with more than one of so many suffixes is hot: its shard is cut by twice as many terms.
HOT_SHARE = 2_000
#: First terms that shards are cut by at most; a longer passage in so many places is one shard, which is read in order and never held.
DEEPEST = 8
#: Terms whose repeats decide how far a suffix is sorted.
STEP = 4
#: Suffixes handed on at once.
BATCH = 50_000
#: Between the terms of an n-gram, and between a term and how often it follows itself.
SEP, RUN = "\x1f", "\x1d"

Interval = tuple[int, int, int, int, int, int]


def suffix_ends(size: int, repeated: np.ndarray) -> np.ndarray:
    """Where each suffix of a record need be sorted to: n-grams that go on beyond it occur once.

    ``repeated`` are the places whose first ``STEP`` terms occur elsewhere, too.
    """
    flags = np.zeros(size + 1, dtype=bool)
    flags[repeated] = True
    # The next place from which no repeated run begins, seen from each place.
    stops = np.flatnonzero(~flags)
    stop = stops[np.searchsorted(stops, np.arange(size))]
    return np.minimum(size, np.where(flags[:size], stop - 1 + STEP, np.arange(size) + STEP - 1))


def run_lengths(terms: list[str]) -> np.ndarray:
    """How often each term follows itself from its place on, itself included."""
    n = len(terms)
    codes = pd.factorize(np.asarray(terms, dtype=object))[0]
    last = np.append(np.flatnonzero(codes[1:] != codes[:-1]), n - 1) if n else np.zeros(0, int)
    return last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1


def sign(term: str, run: int) -> str:
    """A term, or a run of it; runs of a term follow each other by length, after the term alone and before any other."""
    return term if run == 1 else f"{term}{RUN}{run:08x}"


def common_prefix(a: list[str], b: list[str]) -> int:
    """Terms in common from the start, of two suffixes as signs."""
    out = 0
    for x, y in zip(a, b):
        if x == y:
            out += 1 if RUN not in x else int(x[-8:], 16)
            continue
        term, _, m = x.partition(RUN)
        other, _, n = y.partition(RUN)
        if term == other:
            out += min(int(m or "1", 16), int(n or "1", 16))
        break
    return out


class Intervals:
    """The common-prefix intervals of sorted suffixes that share their first ``k`` terms, in one pass with a stack.

    Each interval stands for all n-grams of ``n_min`` to ``n_max`` terms with the same occurrences. Its records are the suffixes
    less, for each suffix, the one before of the same record, taken off at the smallest interval that holds both; copies of a record
    count as often as there are.
    """

    def __init__(self, k: int):
        self.k = k
        self.depth: list[int] = []
        self.first: list[int] = []
        self.tf: list[int] = []
        self.df: list[int] = []
        self.place: list[tuple[int, int]] = []
        self.last: dict[int, int] = {}
        self.seen = 0
        self.out: list[Interval] = []

    def close(self, common: int) -> None:
        """Intervals deeper than ``common`` have ended."""
        while self.depth and self.depth[-1] > common:
            depth, first, tf, df, place = self.depth.pop(), self.first.pop(), self.tf.pop(), self.df.pop(), self.place.pop()
            below = self.depth[-1] if self.depth else self.k - 1
            self.out.append((*place, max(common, below) + 1, depth, tf, df))
            if self.depth and below >= common:
                self.tf[-1] += tf
                self.df[-1] += df
                self.place[-1] = min(self.place[-1], place)
            elif common >= self.k:
                self.push(common, first, tf, df, place)
                break

    def push(self, depth: int, first: int, tf: int, df: int, place: tuple[int, int]) -> None:
        self.depth.append(depth)
        self.first.append(first)
        self.tf.append(tf)
        self.df.append(df)
        self.place.append(place)

    def add(self, common: int, record: int, start: int, left: int, copies: int) -> None:
        """The next suffix, with so many terms in common with the one before."""
        self.close(common)
        before = self.last.get(record)
        if before is not None:
            self.df[bisect_right(self.first, before) - 1] -= copies
        self.push(left, self.seen, copies, copies, (record, start))
        self.last[record] = self.seen
        self.seen += 1

    def take(self) -> list[Interval]:
        out, self.out = self.out, []
        return out


def depth_of(terms: list[str], at: int, hot: list[frozenset[str]]) -> int:
    """By how many first terms the shard of a suffix is cut; more than it has, if those it has are hot."""
    k = 1
    for level in hot:
        if at + k > len(terms) or SEP.join(terms[at : at + k]) not in level:
            break
        k *= 2
    return k


def records_of(doc2terms: DataFrame) -> DataFrame:
    """``record, doc_id, copies, terms``: each distinct list of terms once, with the number of records that have it and the least of them."""
    latest = latest_terms(doc2terms).where(F.size("terms") > 0)
    return materialize(latest.groupBy("terms").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id")).withColumn("record", F.monotonically_increasing_id()), "p7-records")


def hot_prefixes(records: DataFrame, total: int) -> list[frozenset[str]]:
    """Hot runs of 1, 2, 4, ... terms; at most ``HOT_SHARE`` of each."""
    found: list[frozenset[str]] = []
    k = 1
    while k <= DEEPEST // 2:
        grams = F.col("terms")
        if k > 1:  # only what begins with a hot run of half as many terms can be hot
            begins = lambda i: F.array_join(F.slice("terms", i, k // 2), SEP).isin(*found[-1])  # noqa: B023, E731
            places = F.filter(F.sequence(F.lit(1), F.size("terms") - (k - 1)), begins)
            grams = F.transform(places, lambda i: F.array_join(F.slice("terms", i, k), SEP))  # noqa: B023
        each = records.where(F.size("terms") >= k).select(F.explode(grams).alias("gram"))
        hot = frozenset(r.gram for r in each.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") * HOT_SHARE > total).select("gram").collect())
        if not hot:
            break
        found.append(hot)
        k *= 2
    return found


def with_repeats(records: DataFrame, total: int) -> DataFrame:
    """``records`` with ``repeated``, the places whose first ``STEP`` terms occur elsewhere, too.

    Runs meet by their hash: two that share one by chance are sorted further than they need be and told apart then.
    Hot ones are joined by broadcast, as there are few.
    """
    runs = F.transform(F.sequence(F.lit(1), F.size("terms") - (STEP - 1)), lambda i: F.xxhash64(F.slice("terms", i, STEP)))
    each = records.where(F.size("terms") >= STEP).select("record", F.posexplode(runs).alias("at", "h"))
    counts = materialize(each.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 1), "p7-repeats")
    hot, cold = counts.where(F.col("n") * HOT_SHARE > total).select("h"), counts.where(F.col("n") * HOT_SHARE <= total).select("h")
    found = each.join(F.broadcast(hot), "h", "left_semi").unionByName(each.join(F.broadcast(hot), "h", "left_anti").join(cold, "h", "left_semi"))
    return records.join(found.groupBy("record").agg(F.collect_list("at").alias("repeated")), "record", "left")


def ngram_classes(doc2terms: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """``record, start, n_min, n_max, tf, df, term``: all n-grams of the collection, of any length, each in one row.

    The n-grams that begin at ``start`` of the record and have ``n_min`` to ``n_max`` terms occur ``tf`` times in ``df`` records; ``term``
    is the first where ``n_min`` is 1. There are fewer than two rows a suffix, however long the records.

    Suffixes are shuffled by their first terms and sorted, as far as anything in them is repeated; a run of one term
    is one sign. Shards of hot terms are cut by more terms, and the n-grams shorter than that are counted by themselves.
    A repeated passage of n terms costs n * n / 2 of them. Records without terms have none; an empty table gives an empty result.
    """
    records = records if records is not None else records_of(doc2terms)
    total = records.agg(F.sum(F.size("terms"))).first()[0] or 0
    hot = hot_prefixes(records, total)
    schema = "record long, start int, n_min int, n_max int, tf long, df long, term string"

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        names = ["key", "rest", "record", "start", "left", "copies", "k"]
        for batch in batches:
            for record, copies, terms, repeated in zip(batch["record"], batch["copies"], map(list, batch["terms"]), batch["repeated"], strict=True):
                n, runs = len(terms), run_lengths(terms).tolist()
                ends = suffix_ends(n, np.asarray(repeated, dtype=np.int64) if repeated is not None else np.zeros(0, np.int64)).tolist()
                signs = [sign(t, r) for t, r in zip(terms, runs, strict=True)]
                plain, first = max(runs) == 1, hot[0] if hot else frozenset()
                for at in range(n):
                    k = depth_of(terms, at, hot) if terms[at] in first else 1
                    if at + k > n:
                        continue
                    if plain:
                        rest = signs[at + k : ends[at]]
                    else:
                        rest, i = [], at + k
                        while i < ends[at]:
                            rest.append(signs[i])
                            i += runs[i]
                    rows.append((SEP.join(terms[at : at + k]), SEP.join(rest), record, at, n - at, copies, k))
                    if len(rows) >= BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, pass_, before, found = None, None, [], []

        def rows(intervals: list[Interval], name: str) -> list[tuple]:
            return [(*x, name.split(SEP, 1)[0] if x[2] == 1 else None) for x in intervals]

        for batch in batches:
            for k, name, rest, record, start, left, copies in zip(*[batch[c].tolist() for c in ("k", "key", "rest", "record", "start", "left", "copies")], strict=True):
                tokens = rest.split(SEP) if rest else []
                if name != key:
                    if pass_ is not None:
                        pass_.close(-1)
                        found += rows(pass_.take(), key)
                    key, pass_, common = name, Intervals(k), k
                else:
                    common = k + common_prefix(before, tokens)
                pass_.add(common, record, start, left, copies)
                before = tokens
            found += rows(pass_.take(), key) if pass_ is not None else []
            yield pd.DataFrame(found, columns=[c.split()[0] for c in schema.split(", ")])
            found = []
        if pass_ is not None:
            pass_.close(-1)
            yield pd.DataFrame(rows(pass_.take(), key), columns=[c.split()[0] for c in schema.split(", ")])

    tails = with_repeats(records, total).select("record", "copies", "terms", "repeated").mapInPandas(suffixes, "key string, rest string, record long, start int, left int, copies long, k int")
    deep = tails.repartition("key").sortWithinPartitions("key", "rest", "record", "start").mapInPandas(sweep, schema)
    if not hot:
        return deep

    def stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record, copies, terms in zip(batch["record"], batch["copies"], map(list, batch["terms"]), strict=True):
                counts: Counter = Counter()
                places: dict[str, tuple[int, int]] = {}
                for at in [i for i, t in enumerate(terms) if t in hot[0]]:
                    for n in range(1, min(depth_of(terms, at, hot), len(terms) - at + 1)):
                        gram = SEP.join(terms[at : at + n])
                        counts[gram] += 1
                        places.setdefault(gram, (at, n))
                rows += [(gram, *places[gram], tf * copies, copies, record) for gram, tf in counts.items()]
            yield pd.DataFrame(rows, columns=["gram", "start", "n", "tf", "df", "record"])

    shallow = records.select("record", "copies", "terms").mapInPandas(stems, "gram string, start int, n int, tf long, df long, record long")
    shallow = shallow.groupBy("gram", "n").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"), F.min(F.struct("record", "start")).alias("x"))
    return deep.unionByName(shallow.select("x.record", "x.start", F.col("n").alias("n_min"), F.col("n").alias("n_max"), "tf", "df", F.when(F.col("n") == 1, F.col("gram")).alias("term")))


def term_statistics(doc2terms: DataFrame, most: int | None = None, least_tf: int = 1) -> DataFrame:
    """``ngram, n, tf, df``: the classes written out, one row an n-gram, of at most ``most`` terms, or any number, that occur at least ``least_tf`` times."""
    records = records_of(doc2terms)
    classes = ngram_classes(doc2terms, records).where(F.col("tf") >= least_tf)
    top = F.least("n_max", F.lit(most)) if most else F.col("n_max")
    sized = classes.where(F.col("n_min") <= top).select("record", "start", "tf", "df", F.explode(F.sequence(F.col("n_min"), top)).alias("n"))
    return sized.join(records.select("record", "terms"), "record").select(F.array_join(F.slice("terms", F.col("start") + 1, F.col("n")), SEP).alias("ngram"), "n", "tf", "df")


def marked_terms(doc2terms: DataFrame, rare_below: int = 3, common_share: float = 0.25) -> DataFrame:
    """``term, tf, df, mark``: each term as ``rare``, ``common`` or null; a term that is both, in a tiny collection, is rare."""
    records = records_of(doc2terms)
    n = records.agg(F.sum("copies")).first()[0] or 0
    mark = F.when(F.col("df") < rare_below, "rare").when(F.col("df") > F.lit(common_share * n), "common")
    return ngram_classes(doc2terms, records).where(F.col("n_min") == 1).select("term", "tf", "df", mark.alias("mark"))
