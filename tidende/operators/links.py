"""Dictionaries over a linked encyclopedia, as normal-form tables."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidende.functions import text
from tidende.io import materialize

#: Maintenance categories that say nothing about a page (fixed values).
STOP_CATEGORIES = [
    "artikler med døde links",
    "commons-kategori på wikidata er ens med lokalt link",
    "commons-kategori på wikidata er ens med sidetitel",
    "intet lokalt billede og intet billede på wikidata",
    "sider, der bruger automatiske isbn-henvisninger",
    "wikipedia artikler med gnd autoritetsdata-id",
    "wikipedia artikler med ndl autoritetsdata-id",
    "wikipedia artikler med bnf autoritetsdata-id",
    "wikipedia artikler med isni autoritetsdata-id",
    "wikipedia artikler med lccn autoritetsdata-id",
    "lokalt billede identisk med wikidata",
    "lokalt billede forskelligt fra wikidata",
    "wikipedia artikler med viaf autoritetsdata-id",
    "articles with invalid date parameter in template",
    "artikler hvor enkelte passager behøver uddybning (samlet liste)",
    "artikler med filmpersonhenvisninger fra wikidata",
    "kilder mangler (samlet liste)",
]
#: Prefixes of link targets that are no articles (fixed values).
NAMESPACES = r"^(kategori:|fil:|file:|billede:|:)"


def page_links(pages: DataFrame) -> DataFrame:
    """``title, link``: every link of every page, repeats kept; null texts have none."""
    return pages.select("title", F.explode(text.links(F.col("text"))).alias("link"))


def article_links(pages: DataFrame) -> DataFrame:
    """``title, anchor, target`` of links to articles."""
    parts = page_links(pages).select("title", F.trim(text.link_anchor(F.col("link"))).alias("anchor"), F.trim(text.link_target(F.col("link"))).alias("target"))
    return parts.where(~F.col("target").rlike(NAMESPACES) & (F.col("target") != ""))


def inlink_counts(pages: DataFrame) -> DataFrame:
    """``target, title, n``: which pages link to a target and how often; links with ``fil:`` anywhere are left out."""
    kept = page_links(pages).where(~F.col("link").contains("fil:"))
    return kept.groupBy(F.trim(text.link_target(F.col("link"))).alias("target"), "title").agg(F.count("*").alias("n"))


def inlinks(pages: DataFrame) -> DataFrame:
    """``target, title`` without repeats; target before the last pipe, those that begin with ``fil:`` left out."""
    target = F.trim(text.link_target_greedy(F.col("link")))
    return page_links(pages).where(~F.col("link").startswith("fil:")).select(target.alias("target"), "title").distinct()


def anchor_texts(pages: DataFrame) -> DataFrame:
    """``entity, anchor``: the texts of links with a pipe on the entity's own page."""
    piped = page_links(pages).where(F.col("link").contains("|") & ~F.col("link").contains("fil:"))
    return piped.select(F.lower("title").alias("entity"), F.trim(text.link_anchor(F.col("link"))).alias("anchor"))


def reference_texts(pages: DataFrame) -> DataFrame:
    """``entity, reference``."""
    return pages.select(F.lower("title").alias("entity"), F.explode(text.references(F.col("text"))).alias("reference"))


def categories(category_links: DataFrame) -> DataFrame:
    """``entity, category``: one row an entity of each line of a sort key, maintenance categories left out."""
    lines = category_links.select(F.explode(F.split("cl_sortkey", r"\r?\n")).alias("entity"), F.lower(F.replace("cl_to", F.lit("_"), F.lit(" "))).alias("category"))
    stop = F.broadcast(lines.sparkSession.createDataFrame([(c,) for c in STOP_CATEGORIES], "category string"))
    return lines.select(F.lower(F.trim("entity")).alias("entity"), "category").where(F.col("entity") != "").join(stop, "category", "left_anti").select("entity", "category")


def categories_of(titles: DataFrame, category_links: DataFrame) -> DataFrame:
    """``title, category`` of given titles by one equi-join."""
    return titles.select("title", F.lower("title").alias("entity")).join(categories(category_links), "entity").select("title", "category")


def keyphrases(references: DataFrame, cats: DataFrame, anchors: DataFrame, inlink: DataFrame) -> DataFrame:
    """``entity, keyphrase`` from the four sources, without repeats; each table is ``entity, keyphrase``."""
    out = references
    for other in (cats, anchors, inlink):
        out = out.unionByName(other)
    return out.where(F.trim("keyphrase") != "").distinct()


def possibilities(mentions: DataFrame, pages: DataFrame) -> DataFrame:
    """``mention, target``: the articles that links with the mention as their text lead to."""
    anchors = article_links(pages).select("anchor", "target").distinct()
    return mentions.select("mention").distinct().join(anchors, F.lower(F.trim("mention")) == F.col("anchor")).select("mention", "target").distinct()


def unions(batches: Iterator[pa.RecordBatch], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """``entity, keyphrase``, each once, of rows ``kind, name, values``: first the pages with their keyphrases, then the entities with their pages.

    The pages' keyphrases lie as numbers in a local file that is mapped into memory.
    """
    page: dict[str, int] = {}
    number: dict[str, int] = {}
    sizes: list[np.ndarray] = []
    names: list[str] = []
    hits: list[np.ndarray] = []
    members = offsets = words = marked = None

    def out() -> pa.RecordBatch:
        entity = pa.array(names).take(pa.array(np.repeat(np.arange(len(hits)), [len(x) for x in hits])))
        return pa.RecordBatch.from_arrays([entity, words.take(pa.array(np.concatenate(hits)))], ["entity", "keyphrase"])

    with tempfile.TemporaryFile() as file:
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            cut = int(np.searchsorted(kinds, 1))
            if cut:
                b = batch.slice(0, cut)
                flat = b.column("values").flatten().dictionary_encode()
                codes = np.array([number.setdefault(k, len(number)) for k in flat.dictionary.to_pylist()], np.int32)
                codes[flat.indices.to_numpy()].tofile(file)
                sizes.append(np.diff(b.column("values").offsets.to_numpy()))
                for name in b.column("name").to_pylist():
                    page[name] = len(page)
            if cut == len(batch) or not page:
                continue
            if members is None:
                file.flush()
                offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).tolist()
                members = np.memmap(file, np.int32, "r").view(np.ndarray) if offsets[-1] else np.zeros(0, np.int32)
                words, marked = pa.array(list(number), pa.string()), np.zeros(len(number), bool)
            b = batch.slice(cut)
            for name, sources in zip(b.column("name").to_pylist(), b.column("values").to_pylist(), strict=True):
                for k in (page[s] for s in sources if s in page):
                    marked[members[offsets[k] : offsets[k + 1]]] = True
                hit = np.flatnonzero(marked)
                marked[hit] = False
                names.append(name)
                hits.append(hit)
                if sum(map(len, hits[-100:])) >= most or len(hits) == 100:
                    yield out()
                    names, hits = [], []
        if hits:
            yield out()


def foreign_keyphrases(inlink: DataFrame, anchors: DataFrame) -> DataFrame:
    """``entity, keyphrase``: anchor texts of the entities that link to an entity; ``inlink`` is ``entity, source``.

    Every keyphrase of a page meets every entity that it links to, far more than there are different ones. So neither is shuffled: the
    entities are cut into blocks, and each gets all pages with their keyphrases. Blocks are as many as the root of the links, so
    that copies of the pages and the links of a block grow alike.
    """
    pages = anchors.groupBy(F.col("entity").alias("name")).agg(F.collect_set("keyphrase").alias("values"))
    linked = materialize(inlink.groupBy(F.col("entity").alias("name")).agg(F.collect_set("source").alias("values")), "inlinks")
    blocks = max(1, round(math.sqrt(linked.agg(F.sum(F.size("values"))).first()[0] or 0) / 90))
    sent = pages.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "name", "values")
    rows = sent.unionByName(linked.select(F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), "name", "values"))
    return rows.repartitionById(blocks, "block").sortWithinPartitions("kind").select("kind", "name", "values").mapInArrow(unions, "entity string, keyphrase string")
