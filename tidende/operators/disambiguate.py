"""Collective disambiguation: the weighted graph of mentions and entities, and its greedy solution."""

from __future__ import annotations

import heapq
import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidende.operators import coherence as co

Edge = tuple[str, str, str, float]
Node = tuple[str, str]


def mention_edges(scored: DataFrame, alpha: float = 0.45, beta: float = 0.45) -> DataFrame:
    """``doc_id, src, dst, kind, weight`` from mention to entity."""
    weight = alpha * F.col("prior") + beta * F.col("similarity")
    return scored.where(F.col("entity").isNotNull()).select("doc_id", F.col("mention").alias("src"), F.col("entity").alias("dst"), F.lit("mention").alias("kind"), weight.alias("weight"))


def entity_edges(scored: DataFrame, inlink: DataFrame, gamma: float = 0.1, articles: int = co.ARTICLES) -> DataFrame:
    """``doc_id, src, dst, kind, weight`` between the candidates of a document, of different entities once."""
    entities = scored.where(F.col("entity").isNotNull()).select("doc_id", "entity").distinct()
    pairs = entities.withColumnRenamed("entity", "a").join(entities.withColumnRenamed("entity", "b"), "doc_id").where(F.col("a") < F.col("b"))
    values = co.coherence(inlink, pairs, articles)
    return pairs.join(values, ["a", "b"]).select("doc_id", F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("entity").alias("kind"), (gamma * F.col("coherence")).alias("weight"))


def weighted_degree(edges: DataFrame) -> DataFrame:
    """``doc_id, node, is_entity, degree``."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), (F.col("kind") == "entity").alias("is_entity")), F.struct(F.col("dst").alias("node"), F.lit(True).alias("is_entity"))))
    return edges.select("doc_id", "weight", ends.alias("x")).groupBy("doc_id", "x.node", "x.is_entity").agg(F.sum("weight").alias("degree"))


def solve(mentions: list[str], edges: list[Edge]) -> dict[str, str | None]:
    """Greedy densest subgraph of ``kind, src, dst, weight``: the entity of least degree that no mention needs goes, until none is left;
    the graph with the greatest least degree decides. Ties go by name."""
    graph: dict[Node, dict[Node, float]] = {("m", m): {} for m in mentions}
    for kind, src, dst, weight in edges:
        a, b = ("m" if kind == "mention" else "e", src), ("e", dst)
        if a == b:
            continue
        graph.setdefault(a, {})[b] = weight
        graph.setdefault(b, {})[a] = weight
    degree = {node: sum(near.values()) for node, near in graph.items()}
    live = {node for node, near in graph.items() if near}
    alone = {next(iter(near)) for node, near in graph.items() if node[0] == "m" and len(near) == 1}
    # Entities by their degree; an entry is stale once the degree has changed.
    heap = [(degree[e], e[1]) for e in graph if e[0] == "e"]
    heapq.heapify(heap)
    order: list[Node] = []
    gone: set[Node] = set()
    best, most = 0, min((degree[x] for x in live), default=0.0)
    while heap:
        d, name = heapq.heappop(heap)
        e = ("e", name)
        if e in gone or e in alone or d != degree[e]:
            continue
        gone.add(e)
        order.append(e)
        live.discard(e)
        for other, weight in graph[e].items():
            if other in gone:
                continue
            left = [x for x in graph[other] if x not in gone]
            degree[other] = sum(graph[other][x] for x in left)
            if not left:
                live.discard(other)
            if other[0] == "e":
                heapq.heappush(heap, (degree[other], other[1]))
            elif len(left) == 1:
                alone.add(left[0])
        if (now := min((degree[x] for x in live), default=0.0)) > most:
            best, most = len(order), now
    dropped = set(order[:best])
    out: dict[str, str | None] = {}
    for m in mentions:
        kept = {e[1]: w for e, w in graph["m", m].items() if e not in dropped}
        out[m] = min(kept, key=lambda e: (-kept[e], e)) if kept else None
    return out


def solve_exhaustively(mentions: list[str], edges: list[Edge]) -> float:
    """The greatest least degree over every choice of entities that leaves each connected mention one; for small graphs."""
    entities = sorted({d for _, _, d, _ in edges} | {s for k, s, _, _ in edges if k == "entity"})
    connected = {s for k, s, _, _ in edges if k == "mention"}
    top = 0.0
    for n in range(1, len(entities) + 1):
        for chosen in itertools.combinations(entities, n):
            held = set(chosen)
            live = [(k, s, d, w) for k, s, d, w in edges if d in held and (k == "mention" or s in held)]
            if {s for k, s, _, _ in live if k == "mention"} != connected:
                continue
            degree: dict[tuple[str, str], float] = {}
            for k, s, d, w in live:
                for node in (("m" if k == "mention" else "e", s), ("e", d)):
                    degree[node] = degree.get(node, 0.0) + w
            top = max(top, min(degree.values(), default=0.0))
    return top


def disambiguate(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id, mention, entity``, null where a mention has none. A document's graph is small and solved as a whole."""
    named = mentions.select("doc_id", F.col("mention").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit("alone").alias("kind"), F.lit(0.0).alias("weight")).distinct()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(rows.loc[rows["kind"].isin(["alone", "mention"]), "src"]))
        links = rows[rows["kind"] != "alone"]
        found = solve(names, list(zip(links["kind"], links["src"], links["dst"], links["weight"], strict=True)))
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[0], "mention": names, "entity": [found[m] for m in names]})

    return named.unionByName(edges.select("doc_id", "src", "dst", "kind", "weight")).groupBy("doc_id").applyInPandas(run, "doc_id string, mention string, entity string")
