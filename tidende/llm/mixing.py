"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded selection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidende.io import materialize
from tidende.llm.tokenizer import TOKENIZERS, ByteBPE, load

#: Parts in which the documents of a pattern are lined up by a seeded hash.
BUCKETS = 4096
#: Steps, of a hundredth of its quota each, in which a source takes what others can't give; each costs more than the last.
OVERFLOW_STEPS, OVERFLOW_COST = 400, 1_000


class Flow:
    """Successive shortest paths; the graph has a node for each pattern and source, whatever the number of documents."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        self.out[a].append(len(self.arcs))
        self.arcs.append([b, capacity, cost])
        self.out[b].append(len(self.arcs))
        self.arcs.append([a, 0, -cost])
        return len(self.arcs) - 2

    def run(self, source: int, sink: int, most: int) -> int:
        sent = 0
        while sent < most:
            far = {source: 0}
            via: dict[int, int] = {}
            queue = [source]
            while queue:
                later = []
                for a in queue:
                    for k in self.out[a]:
                        b, capacity, cost = self.arcs[k]
                        if capacity > 0 and far[a] + cost < far.get(b, 1 << 60):
                            far[b], via[b] = far[a] + cost, k
                            later.append(b)
                queue = later
            if sink not in far:
                break
            path, node = [], sink
            while node != source:
                path.append(via[node])
                node = self.arcs[via[node] ^ 1][0]
            amount = min([most - sent, *(self.arcs[k][1] for k in path)])
            for k in path:
                self.arcs[k][1] -= amount
                self.arcs[k ^ 1][1] += amount
            sent += amount
        return sent


def route(capacity: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each membership pattern gives to each source.

    A pattern's r-th use costs r squared, so documents are repeated as evenly as can be; a source is filled to its quota at
    no further cost, and beyond it, where others fall short, in steps that cost ever more, so that the rest spreads by
    target share, and then without bound but its repeats: the total is reached if the documents' repeats allow it. A
    source of share 0 gets nothing.
    """
    patterns, sources = sorted(capacity), sorted(targets)
    node = {("p", p): 2 + i for i, p in enumerate(patterns)} | {("s", s): 2 + len(patterns) + i for i, s in enumerate(sources)}
    flow = Flow(2 + len(node))
    given: dict[tuple[tuple[str, ...], str], list[int]] = {}
    for p in patterns:
        most = max((targets[s][1] for s in p), default=0)
        flow.add(0, node["p", p], capacity[p] * most, 0)
        for s in p:
            given[p, s] = [flow.add(node["p", p], node["s", s], capacity[p], r * r) for r in range(1, targets[s][1] + 1)]
    for s in sources:
        quota = int(round(targets[s][0] * total))
        if not targets[s][0]:  # no share wanted, none given
            continue
        flow.add(node["s", s], 1, quota, 0)
        for step in range(1, OVERFLOW_STEPS + 1):
            flow.add(node["s", s], 1, max(1, quota // 100), OVERFLOW_COST * step)
        # Beyond the steps only the repeats bound it.
        flow.add(node["s", s], 1, total, OVERFLOW_COST * (OVERFLOW_STEPS + 1))
    flow.run(0, 1, total)
    return {k: sum(flow.arcs[a ^ 1][1] for a in arcs) for k, arcs in given.items()}


def token_counts(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, sources, tokens``: membership and size of each document; null and empty texts have none."""
    vocabulary = documents.sparkSession.sparkContext.broadcast(load(tokenizer, folder))

    @F.pandas_udf("long")
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = ByteBPE(vocabulary.value)
        for texts in batches:
            yield texts.map(lambda t: len(bpe.encode(t))).astype("int64")

    source = F.lower(F.trim("source"))
    member = F.when(source != "", F.array(source)).otherwise(F.array().cast("array<string>"))
    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(member, F.array().cast("array<string>")).alias("sources"), size("text").alias("tokens"), *(keep or []))


def distinct_texts(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, sources, tokens`` of each distinct text: the least ``doc_id`` that holds it, and all sources it came from.

    A text that several sources delivered may fill the share of any of them. Copies are brought together by two hashes of the
    text, aggregated before the shuffle; no text is shuffled.
    """
    sized = token_counts(documents.where(F.col("text").isNotNull()), tokenizer, folder, keep=["text"])
    hashed = sized.select("doc_id", "sources", "tokens", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    one = F.explode_outer("sources")
    each = hashed.select("h1", "h2", "doc_id", "tokens", one.alias("source")).groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"), F.array_sort(F.collect_set("source")).alias("sources"))
    return each.select("doc_id", "sources", "tokens")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 42, tokenizer: str = "byte_bpe_50k", sized: DataFrame | None = None) -> DataFrame:
    """``doc_id, source, times, tokens``: how often each chosen document is used, for which source, and its size.

    The total is that of ``documents``. Documents of null, blank or unknown sources aren't used; a source without documents or
    with too few of them falls short, and the others take its part by target share as far as their repeats allow. Chosen
    are the documents that come first by a seeded hash, so a source is met to within one document. ``sized`` may give documents
    with several sources each, ``doc_id, sources, tokens``; the flow then decides which source uses how much of each membership pattern. An empty table gives an empty mix.
    """
    sized = materialize(sized if sized is not None else token_counts(documents, tokenizer), "p9-sizes")
    # A row a source: the table of targets is small and fixed.
    rows = targets.where(F.col("source").isNotNull()).select(F.lower(F.trim("source")).alias("s"), "target_share", "max_repeats").collect()
    wanted = {r.s: (float(r.target_share or 0.0), int(r.max_repeats or 0)) for r in rows}
    known = F.array_sort(F.array_distinct(F.filter("sources", lambda s: s.isin(list(wanted))))) if wanted else F.array().cast("array<string>")
    members = sized.select("doc_id", known.alias("pattern"), "tokens")
    total = members.agg(F.sum("tokens")).first()[0] or 0
    # A row a membership pattern.
    capacity = {tuple(r.pattern): int(r.tokens) for r in members.where(F.size("pattern") > 0).groupBy("pattern").agg(F.sum("tokens").alias("tokens")).collect() if r.tokens}
    routed = route(capacity, wanted, int(total))
    plan, begin = [], dict.fromkeys(capacity, 0)
    for (p, s), amount in sorted(routed.items()):
        if amount:
            plan.append((list(p), s, begin[p] % capacity[p], amount, capacity[p]))
            begin[p] += amount
    spark = sized.sparkSession
    plans = spark.createDataFrame(plan, "pattern array<string>, source string, begin long, amount long, size long")
    # Documents in a line by hash: where each begins, from sums of the parts before and a running sum within its part.
    order = F.xxhash64(F.lit(seed), "doc_id")
    lined = members.where((F.size("pattern") > 0) & (F.col("tokens") > 0)).withColumn("h", order).withColumn("part", F.pmod("h", F.lit(BUCKETS)))
    parts = lined.groupBy("pattern", "part").agg(F.sum("tokens").alias("sum"))
    before = parts.withColumn("before", F.sum("sum").over(Window.partitionBy("pattern").orderBy("part")) - F.col("sum")).select("pattern", "part", "before")
    within = F.sum("tokens").over(Window.partitionBy("pattern", "part").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    placed = lined.withColumn("within", within).join(F.broadcast(before), ["pattern", "part"]).withColumn("at", F.col("before") + F.col("within"))
    used = placed.join(F.broadcast(plans), "pattern")
    # The stretch goes round the line as often as the documents are repeated.
    away = F.pmod(F.col("at") - F.col("begin"), F.col("size"))
    times = F.floor((F.col("amount") - 1 - away) / F.col("size")) + 1
    return used.withColumn("times", F.greatest(times, F.lit(0)).cast("int")).where("times > 0").select("doc_id", "source", "times", "tokens")


def shares(documents: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """``source, target_share, documents, uses, tokens, share, most_times``: what each source of the targets really reached."""
    chosen = mix(documents, targets, seed).groupBy("source").agg(F.count("*").alias("documents"), F.sum("times").alias("uses"), F.sum(F.col("times") * F.col("tokens")).alias("tokens"), F.max("times").alias("most_times"))
    wanted = targets.where(F.col("source").isNotNull()).select(F.lower(F.trim("source")).alias("source"), "target_share")
    out = wanted.join(chosen, "source", "left").fillna(0, ["documents", "uses", "tokens", "most_times"])
    total = F.sum("tokens").over(Window.partitionBy())
    return out.withColumn("share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
