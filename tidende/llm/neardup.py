"""Near-duplicate records: binary trie self-join of set sketches under a Hamming error budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidende.io import materialize

#: Bits of a sketch.
BITS = 512
#: Sketches of one trie; a larger shard is cut into blocks, and each pair of blocks is a task of its own.
BLOCK = 2000
#: A class, or a run, of more than one of so many documents, or classes, is hot; there are few, by this very share.
HOT_SHARE = 1000
#: Parts that the members of a hot class are split into.
PARTS = 32
#: Pairs of sketches a step of the traversal compares at once.
STEP = 200_000

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def word_runs(text: Column, words: int) -> Column:
    """The distinct runs of ``words`` consecutive words of the lower-cased text, as 64-bit hashes; words end at spaces, tabs and line breaks."""
    w = F.filter(F.split(F.lower(text), r"[ \t\n\r\x0B\f]+"), lambda x: x != "")
    size = F.size(w)
    # The list beside itself shifted by 1, 2, ...: each word is split off once a shift, not once a run.
    shifted = F.arrays_zip(*[F.slice(w, k, F.greatest(size, F.lit(1))).alias(f"w{k}") for k in range(1, words + 1)])
    runs = F.transform(F.slice(shifted, 1, F.greatest(size - (words - 1), F.lit(0))), lambda x: F.xxhash64(x))
    return F.when(size >= words, F.array_distinct(runs))


def odd_sketch(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The parity of the hashes falling on each bit. Two sets that differ in d elements have sketches that differ in at most d bits."""
    at = (hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits.bit_length() + 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def trie_pairs(sketches: np.ndarray, sizes: np.ndarray, shard: np.ndarray, ratio: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one shard whose sketches differ in no more bits than their error budget, ``ratio`` times the sum of their sizes.

    The sorted sketches of a shard form a binary trie, read in steps of eight bits. Pairs of nodes are traversed together from
    the root; each pair carries the bits that differ so far and is pruned once these exceed the budget of the largest
    sets below its two nodes. With ``side`` only pairs of rows of different sides are wanted.
    """
    n, width = sketches.shape
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort([*sketches.T[::-1], shard])
    s, size, group = sketches[order], sizes[order].astype(np.int64), shard[order]
    apart = s[1:] != s[:-1]
    depth = np.where(apart.any(axis=1), apart.argmax(axis=1), width)  # common bytes with the row before
    depth = np.concatenate([[-1], np.where(group[1:] != group[:-1], -1, depth)])
    pieces_a, pieces_b = [], []

    def nodes(level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node of each row, first rows of the nodes (and the end), greatest set below each, at this depth."""
        first = np.flatnonzero(depth < level)
        return np.cumsum(depth < level) - 1, np.append(first, n), np.maximum.reduceat(size, first)

    node, first, most = nodes(0)
    roots = np.flatnonzero(np.diff(first) > 1)
    frontier = [(0, roots, roots, np.zeros(len(roots), dtype=np.int64))]
    while frontier:
        level, a, b, differ = frontier.pop()
        if not len(a):
            continue
        if len(a) > STEP:
            half = len(a) // 2
            frontier += [(level, a[:half], b[:half], differ[:half]), (level, a[half:], b[half:], differ[half:])]
            continue
        node, first, most = nodes(level)
        single = (np.diff(first)[a] == 1) & (np.diff(first)[b] == 1)
        if single.any():  # leaves: the rest of the bits at once, cut short where the budget is gone
            i, j, d = first[a[single]], first[b[single]], differ[single]
            for at in range(level, width, 8):
                d = d + _POPCOUNT[s[i, at : at + 8] ^ s[j, at : at + 8]].sum(axis=1)
                keep = d <= ratio * (size[i] + size[j]) + 1e-9
                i, j, d = i[keep], j[keep], d[keep]
            keep = i != j
            pieces_a.append(i[keep])
            pieces_b.append(j[keep])
            a, b, differ = a[~single], b[~single], differ[~single]
        if not len(a):
            continue
        if level == width:  # equal sketches below one node
            for x, y, d in zip(a.tolist(), b.tolist(), differ.tolist(), strict=True):
                i, j = np.arange(first[x], first[x + 1]), np.arange(first[y], first[y + 1])
                i, j = np.triu_indices(len(i), 1) if x == y else (np.repeat(np.arange(len(i)), len(j)), np.tile(np.arange(len(j)), len(i)))
                i, j = first[x] + i, first[y] + j
                keep = d <= ratio * (size[i] + size[j]) + 1e-9
                pieces_a.append(i[keep])
                pieces_b.append(j[keep])
            continue
        below, start, most = nodes(level + 1)
        lo_a, hi_a, lo_b, hi_b = below[first[a]], below[first[a + 1] - 1] + 1, below[first[b]], below[first[b + 1] - 1] + 1
        count_b = hi_b - lo_b
        count = (hi_a - lo_a) * count_b
        edges = np.concatenate([[0], np.cumsum(count)])
        lo = 0
        while lo < len(a):  # pairs of children, a bounded number at once
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + STEP, side="right")) - 1)
            owner = np.repeat(np.arange(lo, hi), count[lo:hi])
            within = np.arange(len(owner)) - np.repeat(edges[lo:hi] - edges[lo], count[lo:hi])
            x, y = lo_a[owner] + within // count_b[owner], lo_b[owner] + within % count_b[owner]
            keep = (a[owner] != b[owner]) | (x <= y)
            x, y, d = x[keep], y[keep], differ[owner][keep]
            d = d + _POPCOUNT[s[start[x], level] ^ s[start[y], level]]
            keep = (d <= ratio * (most[x] + most[y]) + 1e-9) & ((x != y) | (start[x + 1] - start[x] > 1))
            frontier.append((level + 1, x[keep], y[keep], d[keep]))
            lo = hi
    if not pieces_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = order[np.concatenate(pieces_a)], order[np.concatenate(pieces_b)]
    if side is not None:
        keep = side[i] != side[j]
        i, j = i[keep], j[keep]
    return i, j


def _join_shards(ratio: float):
    """mapInPandas over rows sorted by shard; a shard is carried over the edge of a batch, many shards are joined at once."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        shard = pd.factorize(pd.MultiIndex.from_frame(rows[["run", "block"]]))[0] if len(rows) else np.zeros(0, int)
        sketches = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8).reshape(len(rows), -1)
        side = rows["side"].to_numpy()
        mixed = side >= 0  # blocks against blocks
        ids, size = rows["class_id"].to_numpy(), rows["size"].to_numpy()
        found = []
        for part, sides in ((~mixed, False), (mixed, True)):
            at = np.flatnonzero(part)
            if len(at) > 1:
                i, j = trie_pairs(sketches[at], size[at], shard[at], ratio, side[at] if sides else None)
                found.append(np.stack([ids[at][i], ids[at][j]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=object)
        return pd.DataFrame({"a": np.minimum(*pairs), "b": np.maximum(*pairs)}, dtype=object).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch[["run", "block"]].iloc[-1]
            tail = ((batch["run"] == last["run"]) & (batch["block"] == last["block"])).to_numpy()
            if tail.all() and held and (held[-1][["run", "block"]].iloc[-1] == last).all():
                held.append(batch)
                continue
            held.append(batch[~tail])
            yield solve(pd.concat(held))
            held = [batch[tail]]
        if held:
            yield solve(pd.concat(held))

    return run


def text_classes(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal word-run sets, ``class_id, runs``, and ``doc_id, class_id`` of each document with such a set.

    Copies, even a third of all rows, are one class, found by 128 bits of hash of the whole set before anything is compared.
    """
    runs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.array_sort(word_runs(F.col("text"), words)).alias("runs")).where(F.col("runs").isNotNull())
    # Two seeds: the second hash goes through the set from another state.
    halves = [F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64("runs"), F.xxhash64(F.lit(7), "runs"))]
    named = materialize(runs.select("doc_id", "runs", F.unhex(F.concat(*halves)).alias("class_id")), "p4-runs")
    classes = named.groupBy("class_id").agg(F.first("runs").alias("runs"))
    return classes, named.select("doc_id", "class_id").distinct()


def with_frequency(exploded: DataFrame, classes: int) -> DataFrame:
    """``class_id, size, run, df`` of the runs of several classes. Hot runs, at most ``HOT_SHARE`` times the mean size of a set, are
    joined by broadcast; the keys of the other join are none that many rows share."""
    df = materialize(exploded.groupBy("run").agg(F.count("*").alias("df")).where(F.col("df") > 1), "p4-df")
    hot = F.broadcast(df.where(F.col("df") * HOT_SHARE > classes))
    cold = exploded.join(hot.select("run"), "run", "left_anti").join(df.where(F.col("df") * HOT_SHARE <= classes), "run")
    return exploded.join(hot, "run").unionByName(cold)


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """``a, b, jaccard`` (a < b) of classes alike by at least ``threshold``: exact, no pair is lost.

    Sets alike by t share at least t / (1 + t) of the sum of their sizes, so they differ in at most (1 - t) / (1 + t) of it, the error
    budget, and their sketches differ in no more bits. Both hold one of the floor((1 - t) * size) + 1 rarest runs of each other,
    so classes are sharded by these runs; runs of a single class are left out. Shards beyond ``BLOCK`` are cut in
    blocks. The pairs that the tries leave are checked by their sets.
    """
    budget = (1.0 - threshold) / (1.0 + threshold)
    classes = materialize(classes, "p4-classes")
    exploded = classes.select("class_id", F.size("runs").alias("size"), F.explode("runs").alias("run"))
    # Runs in rare-first order; those of one class only stand first and need no shard, yet count for the prefix.
    shared = with_frequency(exploded, classes.count())
    ranked = shared.groupBy("class_id", "size").agg(F.array_sort(F.collect_list(F.struct("df", "run"))).alias("r"))
    lone = F.col("size") - F.size("r")
    prefix = F.floor(F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)) + 1) - lone
    kept = ranked.where(prefix > 0).select("class_id", "size", F.slice("r", 1, F.least(prefix, F.size("r")).cast("int")).alias("r"))

    @F.pandas_udf("binary")
    def sketch(runs: pd.Series) -> pd.Series:
        return runs.map(lambda r: odd_sketch(np.asarray(r)).tobytes())

    sketches = classes.join(kept.select("class_id"), "class_id", "left_semi").select("class_id", sketch("runs").alias("sketch"))
    shards = materialize(kept.join(sketches, "class_id").select("class_id", "size", "sketch", F.explode("r").alias("x")).select("class_id", "size", "sketch", "x.run"), "p4-shards")
    count = shards.groupBy("run").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    sized = shards.join(count, "run")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("class_id"), blocks).cast("int")
    # A block meets itself (side -1) and every other block (side 0 the lower, 1 the higher of the two).
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    placed = sized.withColumn("mine", mine).withColumn("blocks", blocks).withColumn("other", other)
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    tasks = placed.select("run", (low * F.col("blocks") + high).alias("block"), side.cast("int").alias("side"), "class_id", "size", "sketch")
    tasks = tasks.repartition("run", "block").sortWithinPartitions("run", "block")
    pairs = tasks.mapInPandas(_join_shards(budget), "a binary, b binary").distinct()
    sets = classes.select("class_id", "runs")
    both = pairs.join(sets.toDF("a", "runs_a"), "a").join(sets.toDF("b", "runs_b"), "b")
    common = F.size(F.array_intersect("runs_a", "runs_b"))
    alike = common / (F.size("runs_a") + F.size("runs_b") - common)
    return both.select("a", "b", alike.alias("jaccard")).where(F.col("jaccard") >= F.lit(threshold))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """``doc_id, class_id, copies, links``: each document with its class of equal sets, the class's size, and the number of other classes alike.

    Null ``doc_id`` or text and texts of fewer than ``words`` words are in no class and give no row; a ``doc_id`` stored with
    several texts is in several classes; an empty table gives an empty result.
    """
    classes, members = text_classes(docs, words)
    links = similar_classes(classes, threshold)
    both = links.select(F.col("a").alias("class_id")).unionByName(links.select(F.col("b").alias("class_id")))
    counted = both.groupBy("class_id").agg(F.count("*").alias("links"))
    sizes = members.groupBy("class_id").agg(F.count("*").alias("copies"))
    named = sizes.join(counted, "class_id", "left").select("class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    # The narrow side of a hot class is one row.
    hot = named.where(F.col("copies") * HOT_SHARE > members.count())
    cold = members.join(F.broadcast(hot.select("class_id")), "class_id", "left_anti").join(named, "class_id")
    return members.join(F.broadcast(hot), "class_id").unionByName(cold).select("doc_id", F.lower(F.hex("class_id")).alias("class_id"), "copies", "links")


def alike_documents(docs: DataFrame, threshold: float = 0.5, words: int = 3) -> DataFrame:
    """``doc_id_a, doc_id_b`` (a < b by code point): every pair of different documents alike by at least ``threshold``.

    The pairs of classes, expanded to the documents in them; copies of one text are pairs too, as the result asks for.
    """
    classes, members = text_classes(docs, words)
    members = materialize(members, "p4-members")
    links = similar_classes(classes, threshold)
    sizes = materialize(members.groupBy("class_id").agg(F.count("*").alias("n")), "p4-sizes")
    # Fewer than HOT_SHARE rows: classes that hold more than that share of all documents.
    hot = F.broadcast(sizes.where(F.col("n") * HOT_SHARE > members.count()).select("class_id", F.lit(PARTS).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64("doc_id"), parts).cast("int")
    split = members.join(hot, "class_id", "left").select("doc_id", "class_id", parts.alias("parts"), part.alias("part"))
    every = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    # A link meets the members of its two classes part by part.
    wide = links.select("a", "b")
    for c in "ab":
        wide = wide.join(hot.select(F.col("class_id").alias(c), F.col("parts").alias(f"parts_{c}")), c, "left")
    wide = wide.withColumn("part_a", every(F.coalesce("parts_a", F.lit(1)))).withColumn("part_b", every(F.coalesce("parts_b", F.lit(1)))).select("a", "b", "part_a", "part_b")
    side = split.select("doc_id", "class_id", "part")
    alike = wide.join(side.toDF("x", "a", "part_a"), ["a", "part_a"]).join(side.toDF("y", "b", "part_b"), ["b", "part_b"]).select("x", "y")
    # So do the copies of a class: each pair of its parts is a key of its own.
    copies = split.join(sizes.where(F.col("n") > 1).select("class_id"), "class_id", "left_semi")
    left = copies.select(F.col("doc_id").alias("x"), "class_id", F.col("part").alias("px"), every(F.col("parts")).alias("py"))
    right = copies.select(F.col("doc_id").alias("y"), "class_id", F.col("part").alias("py"), every(F.col("parts")).alias("px"))
    equal = left.join(right, ["class_id", "px", "py"]).where(F.col("x") < F.col("y")).select("x", "y")
    pairs = alike.where(F.col("x") != F.col("y")).unionByName(equal)
    return pairs.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()
