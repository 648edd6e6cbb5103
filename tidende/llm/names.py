"""Variant spellings of names: trie join with Levenshtein automata, then token order, short forms and initials."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidende.io import materialize

#: Titles before a name and legal forms after one (fixed values); further titles are learned.
TITLES = ("hr", "fru", "frk", "dr", "prof", "advokat", "borgmester", "direktør", "formand", "rektor")
LEGAL = ("a/s", "aps", "a.m.b.a", "amba", "i/s", "p/s", "k/s", "a.m.b.a.", "(selskabet)", "selskabet")
#: Letters and the two that stand for them where a keyboard lacks them (fixed values).
SPELLED = (("aa", "å"), ("ae", "æ"), ("oe", "ø"))
#: A short form stands for a full one if it comes with it under so many of its key names, and so many times.
ALIAS_SHARE, ALIAS_SUPPORT = 0.6, 2
#: A form of so many keys of its own is no short form by its letters alone unless it comes with the full one as often as that share.
OWN_KEYS, OWN_SHARE = 5, 0.4


def fold(mention: str) -> str:
    """Escapes undone, composed, lower case, single blanks."""
    text = re.sub(r"\\x([0-9a-fA-F]{2})", lambda m: chr(int(m.group(1), 16)), mention)
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", text).lower()).strip()


def name_tokens(mention: str | None) -> list[str]:
    """The tokens of a name in reading order: ``Last, First`` turned round, legal forms, possessives and ``i`` left out.

    A dot at the end stays on short forms, as it tells them from words.
    """
    if mention is None:
        return []
    text = re.sub(r"['’`]s\b", "", fold(mention))
    if text.count(",") == 1 and all(p.strip() for p in text.split(",")):
        last, first = text.split(",")
        if first.strip() in LEGAL:
            text = last
        else:
            text = f"{first.strip()} {last.strip()}"
    tokens = [t.strip(",;:") for t in re.split(r"[\s\-]+", text)]
    tokens = [t for t in tokens if t and t not in LEGAL and t.strip(".") not in LEGAL and re.search(r"\w", t)]
    return [t for k, t in enumerate(tokens) if not (t == "i" and 0 < k < len(tokens) - 1)]


class Trie:
    """Words by their letters; ``near`` follows a Levenshtein automaton of one edit, neighbouring letters swapped included."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = word

    def near(self, word: str) -> list[str]:
        found: list[str] = []
        n = len(word)
        # States: node, letters of the word read, edits left; the automaton dies where neither fits.
        stack = [(self.root, 0, 1)]
        while stack:
            node, i, left = stack.pop()
            if i == n and "" in node:
                found.append(node[""])
            if i < n and word[i] in node:
                stack.append((node[word[i]], i + 1, left))
            if left:
                if i < n:
                    stack.append((node, i + 1, 0))
                for c, below in node.items():
                    if not c:
                        continue
                    stack.append((below, i, 0))
                    if i < n and c != word[i]:
                        stack.append((below, i + 1, 0))
                        if i + 1 < n and c == word[i + 1] and word[i] in below:
                            stack.append((below[word[i]], i + 2, 0))
        return [w for w in dict.fromkeys(found) if w != word]


def near_words(words: DataFrame) -> DataFrame:
    """``a, b`` of different words of column ``word``, both ways round, that are one edit apart (a swap of neighbours is one).

    One edit leaves the first or the last part of a word as it was, so words are sharded by both; a shard is one trie. Words of
    fewer than three letters aren't compared. Words are distinct, so copies make no shard large.
    """
    length = F.length("word")
    half = lambda n: F.greatest(F.lit(1), F.floor((n - 2) / 2)).cast("int")
    cuts = F.array_distinct(F.array(half(length - 1), half(length), half(length + 1)))
    keys = F.flatten(F.transform(cuts, lambda h: F.array(F.concat(F.lit("<"), F.substring("word", F.lit(1), h)), F.concat(F.lit(">"), F.substring("word", -h, h)))))
    sharded = words.where(length >= 3).distinct().select("word", F.explode(keys).alias("shard"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held = None, []

        def solve() -> pd.DataFrame:
            trie = Trie()
            for w in held:
                trie.add(w)
            pairs = [(w, x) for w in held for x in trie.near(w)] if len(held) > 1 else []
            return pd.DataFrame(pairs, columns=["a", "b"], dtype="str")

        for batch in batches:
            out = []
            for s, w in zip(batch["shard"], batch["word"], strict=True):
                if s != shard:
                    if len(held) > 1:
                        out.append(solve())
                    shard, held = s, []
                held.append(w)
            if out:
                yield pd.concat(out)
        if len(held) > 1:
            yield solve()

    # As many tasks as the session shuffles into: the shards are few bytes, but work.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sharded.repartition(tasks, "shard").sortWithinPartitions("shard").mapInPandas(join, "a string, b string").distinct()


def distinct_mentions(priors: DataFrame) -> DataFrame:
    """``mention, uses, entity, toks``: each spelling once, with how it was most often resolved, if ever, and its tokens."""

    @F.pandas_udf("array<string>")
    def tokens(mentions: pd.Series) -> pd.Series:
        return mentions.map(name_tokens)

    counted = priors.where(F.col("mention").isNotNull()).groupBy("mention", "entity").agg(F.count("*").alias("n"))
    known = F.when(F.col("entity").isNotNull(), F.struct("n", "entity"))
    m = counted.groupBy("mention").agg(F.sum("n").alias("uses"), F.max(known)["entity"].alias("entity"))
    return materialize(m.withColumn("toks", tokens("mention")), "p6-mentions")


def without_titles(m: DataFrame) -> DataFrame:
    """Leading titles off: the fixed ones, and those learned: a first token without which three names or more are names too."""
    plain = m.where(F.size("toks") >= 2).select(F.concat_ws(" ", "toks").alias("name")).distinct()
    led = m.where(F.size("toks") >= 3).select(F.get("toks", F.lit(0)).alias("title"), F.concat_ws(" ", F.slice("toks", 2, F.size("toks"))).alias("name")).distinct()
    learned = led.join(plain, "name", "left_semi").groupBy("title").agg(F.count("*").alias("n")).where(F.col("n") >= 3).select("title")
    bare = F.regexp_replace(F.get("toks", F.lit(0)), r"\.$", "")
    flagged = m.join(learned.withColumn("is_title", F.lit(True)), F.get("toks", F.lit(0)) == F.col("title"), "left")
    off = (F.size("toks") >= 3) & (bare.isin(*TITLES) | F.coalesce("is_title", F.lit(False)))
    return flagged.withColumn("toks", F.when(off, F.slice("toks", 2, F.size("toks"))).otherwise(F.col("toks"))).drop("title", "is_title")


def usual_order(m: DataFrame) -> DataFrame:
    """Names of the same tokens in any order take the order that is used most; of equal ones the first."""
    same = F.array_sort("toks")
    used = m.groupBy(same.alias("same"), "toks").agg(F.sum("uses").alias("u"))
    best = used.groupBy("same").agg(F.max_by("toks", F.struct("u", F.transform("toks", lambda t: -F.ascii(t)), "toks")).alias("usual"), F.count("*").alias("orders")).where(F.col("orders") > 1)
    # Few names come in several orders; the others don't meet.
    return m.withColumn("same", same).join(best.select("same", "usual"), "same", "left").withColumn("toks", F.coalesce("usual", "toks")).drop("same", "usual")


def best_neighbour(stats: DataFrame, near: DataFrame) -> DataFrame:
    """``word, to``: each word's most used neighbour at one edit, itself where none is used more; over two steps."""
    rank = F.struct("uses", "word")
    other = near.join(stats.select(F.col("word").alias("b"), F.struct("uses", F.col("word")).alias("r")), "b").groupBy("a").agg(F.max("r").alias("r"))
    one = stats.join(other, F.col("word") == F.col("a"), "left").select("word", F.when(F.col("r") > rank, F.col("r.word")).otherwise(F.col("word")).alias("to"))
    two = one.select(F.col("word").alias("mid"), F.col("to").alias("end"))
    return one.join(two, F.col("to") == F.col("mid")).select("word", F.col("end").alias("to"))


def _short(c: Column) -> Column:
    """A short form by its looks: with dots, but no single initial."""
    return c.contains(".") & (F.length(F.replace(c, F.lit("."), F.lit(""))) > 1)


def linked_names(priors: DataFrame) -> DataFrame:
    """``mention, uses, key, name, middle``: each spelling of a person or organisation with the name it stands for.

    ``key`` is the surname, or the place of an organisation, in its most used spelling; ``name`` is the first name, or the kind of
    organisation. Names of one token (places, the country, blank ones) are left out. Null mentions give no
    row; extra columns don't matter; an empty table gives an empty result.
    """
    m = without_titles(distinct_mentions(priors)).where(F.size("toks") >= 2)
    m = materialize(m.select("mention", "uses", "entity", "toks"), "p6-names")
    # Order of the tokens: each has its share of uses at the end.
    ends = m.select("uses", F.explode(F.array(F.struct(F.get("toks", F.lit(0)).alias("word"), F.lit(0).alias("end")), F.struct(F.element_at("toks", -1).alias("word"), F.lit(1).alias("end")))).alias("x"))
    share = ends.groupBy("x.word").agg((F.sum(F.col("uses") * F.col("x.end")) / F.sum("uses")).alias("share"))
    head, tail = share.toDF("w0", "share0"), share.toDF("w1", "share1")
    ordered = m.join(head, F.get("toks", F.lit(0)) == F.col("w0")).join(tail, F.element_at("toks", -1) == F.col("w1"))
    turn = F.col("share0") - F.col("share1") > 0.3
    rest = F.concat(F.slice("toks", 2, F.size("toks")), F.slice("toks", 1, 1))
    back = F.concat(F.slice("toks", -1, 1), F.slice("toks", 1, F.size("toks") - 1))
    # "Last First Middle" brings the first token to the end, "Kind Place" the last to the front; of two tokens both are the same.
    ordered = ordered.withColumn("toks", F.when(turn & (F.col("share0") >= 0.5), rest).when(turn, back).otherwise(F.col("toks"))).drop("w0", "w1", "share0", "share1")
    # What the ends don't say, other orders of the same tokens do.
    ordered = materialize(usual_order(materialize(ordered, "p6-turned")), "p6-ordered")

    words = ordered.select("uses", F.explode("toks").alias("word")).groupBy("word").agg(F.sum("uses").alias("uses"))
    spelled = F.col("word")
    for two, one in SPELLED:
        spelled = F.replace(spelled, F.lit(two), F.lit(one))
    two_letter = words.select(F.col("word").alias("a"), spelled.alias("b")).where("a <> b").join(words.select(F.col("word").alias("b")), "b", "left_semi").select("a", "b")
    near = materialize(near_words(words.select("word").where(~F.col("word").contains("."))).unionByName(two_letter).unionByName(two_letter.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "p6-near")
    to = materialize(best_neighbour(words, near), "p6-to")
    # Kinds of organisations close more names than any of their first tokens opens; with surnames it is the other way round.
    no_initial = F.length(F.regexp_replace("first", r"\.", "")) > 1
    ends_of = ordered.select(F.get("toks", F.lit(0)).alias("first"), F.element_at("toks", -1).alias("last")).distinct().where(no_initial)
    opened = ends_of.groupBy("first").agg(F.count("*").alias("opens"))
    closed = ends_of.join(opened, "first").groupBy("last").agg(F.count("*").alias("closes"), F.max("opens").alias("opens"))
    kinds = materialize(closed.where((F.col("closes") >= 3) & (F.col("closes") > F.col("opens"))).select(F.col("last").alias("word")), "p6-kinds")
    kind_like = kinds.unionByName(near.join(kinds.withColumnRenamed("word", "b"), "b").select(F.col("a").alias("word"))).distinct()
    places = ends_of.join(kinds.withColumnRenamed("word", "last"), "last", "left_semi").select(F.col("first").alias("place")).distinct()
    places = places.unionByName(near.join(places.withColumnRenamed("place", "b"), "b").select(F.col("a").alias("place"))).distinct()
    flagged = ordered.join(kind_like.withColumnRenamed("word", "kind"), F.element_at("toks", -1) == F.col("kind"), "left").join(places, F.get("toks", F.lit(0)) == F.col("place"), "left")
    org = F.col("kind").isNotNull() | F.col("place").isNotNull() | _short(F.element_at("toks", -1))
    parts = flagged.select(
        "mention", "uses", "entity",
        F.when(org, F.get("toks", F.lit(0))).otherwise(F.element_at("toks", -1)).alias("key"),
        F.when(org, F.element_at("toks", -1)).otherwise(F.get("toks", F.lit(0))).alias("first"),
        F.when(~org & (F.size("toks") > 2), F.get("toks", F.lit(1))).alias("middle"), org.alias("org"),
    )
    keyed = parts.join(to.toDF("key", "canonical"), "key").drop("key").withColumnRenamed("canonical", "key")
    keyed = materialize(keyed, "p6-keyed")

    # Full first names and kinds: used under several keys, and no short form of another.
    by_key = materialize(keyed.groupBy("first", "key", "org").agg(F.sum("uses").alias("uses")), "p6-by-key")
    spread = materialize(by_key.groupBy("first", "org").agg(F.count("*").alias("keys"), F.sum("uses").alias("all")), "p6-spread")
    short = by_key.join(spread, ["first", "org"]).select("first", "key", "org", "keys", "all")
    full = short.toDF("full", "key", "org", "full_keys", "full_all")
    together = short.where(F.length(F.regexp_replace("first", r"\.", "")) > 1).join(full, ["key", "org"]).where((F.col("first") != F.col("full")) & ((F.col("full_keys") > F.col("keys")) | ((F.col("full_keys") == F.col("keys")) & (F.col("full_all") > F.col("all")))))
    support = materialize(together.groupBy("first", "full", "org", "keys", "full_keys").agg(F.count("*").alias("n")), "p6-support")
    alias = support.where((F.col("n") >= ALIAS_SUPPORT) & (F.col("n") >= ALIAS_SHARE * F.col("keys")))
    alias = alias.groupBy("first", "org").agg(F.max(F.struct("n", "full_keys", "full")).alias("x")).select("first", "org", F.col("x.full").alias("full"))
    alias = materialize(alias, "p6-alias")

    forms = keyed.select("key", "org", "first").distinct()
    bare = F.regexp_replace("first", r"\.", "")
    fulls = by_key.join(alias.select("first", "org"), ["first", "org"], "left_anti").where(F.length(F.regexp_replace("first", r"\.", "")) > 1)
    fulls = fulls.join(spread.select("first", "org", "keys"), ["first", "org"]).select("key", "org", F.col("first").alias("full"), "uses", "keys")
    fulls = materialize(fulls, "p6-fulls")
    initial = F.length(F.regexp_replace("first", r"\.", "")) == 1
    options = [
        forms.select("*", F.col("first").alias("full"), F.lit(3).alias("cost")),
        forms.join(alias, ["first", "org"]).select("key", "org", "first", "full", F.lit(0).alias("cost")),
        forms.join(near.toDF("first", "full"), "first").select("key", "org", "first", "full", F.lit(1).alias("cost")),
    ]
    # Typed wrongly and short at once: the neighbour's full form.
    options.append(forms.join(near.toDF("first", "mid"), "first").join(alias.toDF("mid", "org", "full"), ["mid", "org"]).select("key", "org", "first", "full", F.lit(2).alias("cost")))
    # Short by its letters: those of the full form in the same order, some left out.
    letters_of = F.concat(F.lit("^"), F.lit(".*"), F.array_join(F.split(bare, ""), ".*"), F.lit(".*"))
    often = support.select("first", "full", "org", F.col("n").alias("n_both"))
    shorter = forms.where((F.length(bare) > 1) & bare.rlike(r"^[\p{L}/]+$")).join(fulls.select("key", "org", "full", "keys"), ["key", "org"]).where(F.length("full") > F.length(bare))
    shorter = shorter.where(F.rlike("full", letters_of)).join(spread.select("first", "org", F.col("keys").alias("short_keys")), ["first", "org"]).join(often, ["first", "full", "org"], "left")
    shorter = shorter.where((F.col("short_keys") < OWN_KEYS) | (F.coalesce("n_both", F.lit(0)) >= OWN_SHARE * F.col("short_keys"))).where(F.col("keys") >= F.col("short_keys"))
    # A letter too many or too few is a typing error, judged as such.
    shorter = shorter.join(near.toDF("first", "full"), ["first", "full"], "left_anti")
    options.append(shorter.select("key", "org", "first", "full", F.lit(2).alias("cost")))
    tried = options[0]
    for o in options[1:]:
        tried = tried.unionByName(o)
    present = materialize(tried, "p6-tried").join(fulls, ["key", "org", "full"])
    own = F.col("full") == F.col("first")
    # A neighbour must be a name of more keys than the form itself, else the form is its own name.
    mine = spread.select("first", "org", F.col("keys").alias("own_keys"), F.col("all").alias("own_all"))
    present = present.join(mine, ["first", "org"])
    better = own | F.col("cost").isin(0, 2) | (F.col("keys") > F.col("own_keys")) | ((F.col("keys") == F.col("own_keys")) & (F.col("own_keys") == 1) & (F.col("uses") > F.col("own_all")))
    letters = forms.where(initial).select("key", "org", "first", F.substring("first", 1, 1).alias("letter"))
    by_letter = letters.join(fulls.withColumn("letter", F.substring("full", 1, 1)), ["key", "org", "letter"])
    by_letter = by_letter.select("key", "org", "first", "full", F.lit(2).alias("cost"), "uses", "keys")
    # Of what a full form may stand for, those short of none count, the most widely used among equals.
    scored = present.where(better).select("key", "org", "first", "full", "cost", "uses", "keys").unionByName(by_letter)
    scored = materialize(scored, "p6-scored")
    chosen = scored.groupBy("key", "org", "first").agg(F.min(F.struct("cost", (-F.col("keys")).alias("k"), (-F.col("uses")).alias("u"), "full")).alias("x")).select("key", "org", "first", F.col("x.full").alias("name"))
    named = keyed.join(chosen, ["key", "org", "first"], "left").withColumn("name", F.coalesce("name", "first"))
    named = materialize(named, "p6-named")

    # An initial may stand for several names under its key: what it was resolved to decides, where it was.
    settled = named.where(F.col("entity").isNotNull() & ~initial).groupBy("entity").agg(F.max(F.struct("uses", "key", "org", "name")).alias("x")).select("entity", F.col("x.key").alias("key"), F.col("x.org").alias("org"), F.col("x.name").alias("resolved"))
    named = named.join(settled, ["entity", "key", "org"], "left").withColumn("name", F.when(initial, F.coalesce("resolved", "name")).otherwise(F.col("name"))).drop("resolved")

    middles = named.where(F.length(F.regexp_replace("middle", r"\.", "")) > 1).join(to.toDF("middle", "mid"), "middle").groupBy("key", "org", "name", "mid").agg(F.sum("uses").alias("u"))
    several = middles.groupBy("key", "org", "name").agg(F.count("*").alias("k"), F.max(F.struct("u", "mid"))["mid"].alias("main"))
    out = named.join(to.toDF("middle", "mid"), "middle", "left").join(several, ["key", "org", "name"], "left")
    with_middle = F.when(F.col("k") > 1, F.when(F.length(F.regexp_replace("middle", r"\.", "")) > 1, F.col("mid")).otherwise(F.col("main")))
    return out.select("mention", "uses", "entity", "org", "key", "name", with_middle.alias("middle"))


def variant_pairs(priors: DataFrame) -> DataFrame:
    """``mention_a, mention_b`` (a < b by code point): every two different spellings of one person or organisation."""
    names = materialize(linked_names(priors).select("mention", F.xxhash64("org", "key", "name", F.coalesce("middle", F.lit(""))).alias("id")), "p6-linked")
    both = names.toDF("mention_a", "id").join(names.toDF("mention_b", "id"), "id")
    return both.where(F.col("mention_a") < F.col("mention_b")).select("mention_a", "mention_b")
