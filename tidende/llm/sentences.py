"""Sentence boundaries by document-centred disambiguation, with corpus fallback and rules for each script's terminators."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidende.io import materialize
from tidende.llm import encoding

#: Month names that are capitalised after an ordinal (fixed values).
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember january february march may june july october december".split())
#: Words before an ordinal that make it a date (fixed values).
BEFORE_DATE = frozenset("am vom zum den der dem d the on".split())
#: Words of a reporting clause after a quotation in Chinese (fixed values).
REPORTING_ZH = ("说", "道", "表示", "问", "回答")
#: A word starts sentences in general if it does in more than one of so many texts.
STARTER_SHARE = 5_000

_MARKS = re.compile(r"[.!?…؟。！？।;;]+|\n+|(?<=[฀-๿])[ \t]+(?=[฀-๿])")
_QUOTES = "\"'”“»«’‘›‹„"
_BRACKETS = ")]}"
_CJK = re.compile("[぀-ヿ㐀-鿿＀-￯　-〿]")
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_NO_DOT = re.compile("[ऀ-ॿ฀-๿]")
_DOTTED = re.compile(r"^(?:[^\W\d_]{1,4}\.)+[^\W\d_]{1,4}$")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Corpus:
    """What the whole collection says: abbreviations with the rate at which they close a sentence, and general starters."""

    closing: dict[str, float] = field(default_factory=dict)
    digits: dict[str, float] = field(default_factory=dict)
    starters: frozenset[str] = frozenset()


def lowers(c: str) -> bool:
    return c.islower()


class Splitter:
    """Boundaries of one document: its own unambiguous occurrences first, then the corpus."""

    def __init__(self, corpus: Corpus):
        self.corpus = corpus

    def spans(self, text: str) -> list[tuple[int, int]]:
        """``start, end`` of each sentence, without white space at either end."""
        self.text = text
        # Words in lower case in this document, and tokens followed by a dot and a lower-case word.
        self.low = {w for w in _WORD.findall(text) if w.islower()}
        self.short = {m.group(1).lower() for m in re.finditer(r"(?<![^\s(»«”“\"])([^\s.]{1,8}(?:\.[^\s.]{1,4})*)\.\s+(?=[a-zæøåäöüß])", text)}
        out, last = [], 0
        for m in _MARKS.finditer(text):
            if m.start() < last:
                continue
            end = self.closes(m, last)
            if end is not None:
                out.append((last, end))
                last = end
        out.append((last, len(text)))
        trimmed = []
        for a, b in out:
            part = text[a:b]
            left = len(part) - len(part.lstrip())
            part = part.strip()
            if not part:
                continue
            if not re.search(r"\w", part) and trimmed:  # stray marks belong to what they follow
                trimmed[-1] = (trimmed[-1][0], a + left + len(part))
            else:
                trimmed.append((a + left, a + left + len(part)))
        return trimmed

    def closes(self, m: re.Match, begin: int) -> int | None:
        """The end of the sentence that this mark closes, or nothing."""
        text, mark, at = self.text, m.group(), m.end()
        if mark[0] in "\n \t":
            return m.start() if mark.strip(" \t") == "" and "\n" not in mark else at
        if mark[0] in ";;":
            if not _GREEK.search(text[begin : m.start()]):
                return None
            return at if at >= len(text) or text[at].isspace() else None
        if mark[0] in "。！？":
            while at < len(text) and text[at] in "」』”’）)":
                at += 1
            if at > m.end() and at < len(text):
                if text[at] == "と" or text[at] in "，、,":
                    return None
                after = re.match(r"[^。！？\n]*", text[at:]).group()
                if text[at - 1] in "”’" and any(w in after for w in REPORTING_ZH) and not after.startswith("“"):
                    return None
            return at
        # Closing quotes and brackets; a quotation mark before a letter opens.
        while at < len(text) and (text[at] in _BRACKETS or (text[at] in _QUOTES and not (at + 1 < len(text) and text[at + 1].isalnum()))):
            at += 1
        if at >= len(text):
            return at
        gap = re.compile(r"\s*").match(text, at).end()
        if gap >= len(text):
            return at
        if "\n" in text[at:gap]:
            return at
        after = text[gap]
        if after in ",;:)" or (after in "—–-" and re.match(r"[—–-]\s*[^\W\d_]", text[gap:]) and lowers(re.search(r"\w", text[gap:]).group())):
            return None
        spaced = gap > at
        if lowers(after):
            return None
        if mark[0] in "।":
            return at
        if mark[0] in "!?…؟" or (len(mark) > 1 and set(mark) != {"."}):
            return at if spaced or after.isupper() or after in _QUOTES or not after.isascii() else None
        if not spaced and not (after.isupper() or (after in _QUOTES + "(" and at > m.end() - 1)):
            return None
        if len(mark) > 1:
            return at
        return at if at > m.end() or self.dot_closes(m.start(), gap, spaced, begin) else None

    def dot_closes(self, dot: int, gap: int, spaced: bool, begin: int) -> bool:
        """Whether a single dot closes a sentence, with something other than a lower-case letter after it."""
        text = self.text
        head = re.search(r"\S*$", text[max(begin, dot - 40) : dot]).group()
        token = head.lstrip(_QUOTES + "([")
        low = token.lower()
        after = text[gap]
        word = re.match(r"[" + re.escape(_QUOTES) + r"(\[]*([^\W\d_]*)", text[gap:]).group(1)
        if not token:
            return True
        if not spaced:
            # A missing blank: a word, its dot, and a capital; no address, no letters with dots between.
            return bool(re.search(r"[^\W\d_]{2,}$|\d$|[)%]$", token)) and not re.search(r"[/@]|www", token) and not _DOTTED.match(low) and bool(re.match(r"[^\W\d_]([^\W\d_]|\.|\s)", text[gap:]) or after in _QUOTES + "(")
        if re.search(_NO_DOT, token):
            return False
        if re.fullmatch(r"[^\W\d_]", token) and not token.isdigit():
            # An initial never closes, a unit may.
            return token.islower() and token.isascii() and self.abbreviation_closes(low, word, after)
        if re.fullmatch(r"\d{1,2}", token):
            before = re.search(r"([^\W\d_]+)\.?\s+\S*$", text[max(begin, dot - 40) : dot])
            if word.lower() in MONTHS:
                return False
            return not (before and before.group(1).lower() in BEFORE_DATE and word and not word.islower() and word.lower() not in self.low and word.lower() not in self.corpus.starters)
        if token[-1].isdigit():
            return True
        if _DOTTED.match(low) or low in self.short or low in self.corpus.closing:
            return self.abbreviation_closes(low, word, after)
        return True

    def abbreviation_closes(self, low: str, word: str, after: str) -> bool:
        """Whether an abbreviation's dot also closes: yes before a word known in lower case, else as it mostly does in the corpus."""
        rate = self.corpus.closing.get(low, 0.0)
        if after.isdigit():
            return rate > 0.8 and self.corpus.digits.get(low, 1.0) < 0.2
        known = word.lower() in self.low or word.lower() in self.corpus.starters
        if word and known:
            return rate > 0.05
        return rate > 0.5


def corpus_statistics(docs: DataFrame, abbreviations: DataFrame) -> Corpus:
    """Counts over all distinct texts: for each short token with a dot what follows it, and which words start sentences.

    Copies of a text count once, so they change nothing; what a token needs is a share of the texts, two of them at least.
    """
    texts = materialize(docs.where(F.col("text").isNotNull()).select("text").distinct(), "p5-distinct")
    n = texts.count()
    follows = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![^\s(»”“\"])[\p{L}][\p{L}.]{0,9}\. +[\p{L}\p{N}]+"), 0)).alias("x"))
    split = follows.select(F.regexp_extract("x", r"^(.*)\. +", 1).alias("token"), F.regexp_extract("x", r"\. +([\p{L}\p{N}]+)$", 1).alias("word"))
    # Scripts with upper and lower case only; no initials.
    split = split.where(F.col("token").rlike(r"^[\p{Lu}\p{Ll}.]+$") & ~F.col("token").rlike(r"^\p{Lu}$")).withColumn("token", F.lower("token"))
    plain = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}.])(\p{L}{1,4})(?= )"), 1)).alias("x")).groupBy(F.lower("x").alias("token")).agg(F.count("*").alias("plain"))
    # Words at the start of what follows a longer word, or another mark; the same in lower case after a word.
    starts = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?:[\p{L}]{5,}\.|[!?])\.* +(\p{Lu}\p{L}*)"), 1)).alias("w")).groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n_start"))
    inside = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<=[\p{L},] )(\p{Ll}\p{L}*)"), 1)).alias("w")).groupBy("w").agg(F.count("*").alias("n_low"))
    upper = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<=[\p{Ll},] )(\p{Lu}\p{L}*)"), 1)).alias("w")).groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n_up"))
    # At most STARTER_SHARE times the sentences of a record; names and nouns with capitals stand inside sentences, too.
    often = starts.where(F.col("n_start") >= max(2, -(-n // STARTER_SHARE))).join(inside, "w", "left").join(upper, "w", "left").fillna(0)
    general = often.where((F.col("n_up") <= 0.2 * F.col("n_start")) | (F.col("n_low") > F.col("n_up"))).select("w")
    starters = frozenset(r.w for r in general.collect())
    kind = F.when(F.col("word").rlike(r"^\p{N}"), "digit").when(F.col("word").rlike(r"^\p{Lu}"), "capital").otherwise("low")
    kind = F.when(F.col("word").rlike(r"^[\p{N}\p{Lu}\p{Ll}]"), kind)
    capital = F.col("kind") == "capital"
    words = general.withColumn("starter", F.lit(True))
    counted = split.withColumn("kind", kind).groupBy("token", "kind", F.lower("word").alias("w")).agg(F.count("*").alias("n")).join(words, "w", "left")
    rates = counted.groupBy("token").agg(
        F.sum(F.when(F.col("kind") == "low", F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(F.col("kind") == "digit", F.col("n")).otherwise(0)).alias("digit"),
        F.sum(F.when(capital, F.col("n")).otherwise(0)).alias("capital"), F.sum(F.when(capital & F.col("starter"), F.col("n")).otherwise(0)).alias("starting"),
    )
    rates = rates.join(plain, "token", "left").fillna(0)
    given = [r.abbr.strip().lower().rstrip(".") for r in abbreviations.where(F.col("abbr").isNotNull()).select("abbr").collect()]
    # Followed by lower case or a number as a rule, though a word may close before a number now and then; a dotted one, or a given one.
    dotted = F.col("token").rlike(r"^(\p{L}{1,4}\.)+\p{L}{1,4}$")
    found = rates.where((F.col("low") >= 2) & (F.col("low") + F.col("digit") > 0.05 * F.col("capital")) | (F.col("digit") > 0.6 * (F.col("low") + F.col("digit") + F.col("capital"))) & (F.col("digit") >= 3) | dotted & (F.col("low") + F.col("digit") + F.col("capital") >= 2) | F.col("token").isin(given) | ((F.col("starting") < 0.02 * F.col("capital")) & (F.col("capital") >= 5) & (F.length("token") <= 4) & (F.col("plain") < 0.2 * F.col("capital"))))
    # Short tokens with dots in use by several records: a closed class, bounded as the starters are.
    rows = found.where(F.col("low") + F.col("digit") + F.col("capital") >= max(2, -(-n // STARTER_SHARE))).collect()
    closing = {r.token: (r.starting / r.capital if r.capital else 0.0) for r in rows}
    digits = {r.token: r.digit / (r.digit + r.capital + r.low) for r in rows}
    for a in given:
        closing.setdefault(a, 0.0)
    return Corpus(closing, digits, starters)


def offsets(stored: str, restored: str, tables: list[list[str]]) -> list[int]:
    """For each character of ``restored``, and the end, where its garbled form begins in ``stored``."""
    images: dict[str, list[str]] = {}

    def of(c: str) -> list[str]:
        if c not in images:
            seen, level = [], [c]
            for _ in range(3):
                level = ["".join(t[b - 128] if b > 127 else chr(b) for b in x.encode("utf-8")) for x in level for t in tables]
                seen += level
            images[c] = sorted(set(seen) - {c}, key=len, reverse=True)
        return images[c]

    out, i = [], 0
    for c in restored:
        out.append(i)
        garbled = next((x for x in of(c) if stored.startswith(x, i)), None) if not c.isascii() else None
        i += len(garbled) if garbled else 1
    return [*out, len(stored)]


def sentences(docs: DataFrame, abbreviations: DataFrame, corpus: Corpus | None = None, model: encoding.Model | None = None) -> DataFrame:
    """``doc_id, sent_no, start_char, end_char, sentence``: the sentences of each document with a non-blank text, in order.

    Positions count Unicode characters of the stored text. Garbled text is split as what it was, and the positions
    refer to what is stored. A ``doc_id`` delivered several times counts once for each different text. Null, empty and
    blank texts and null ``doc_id`` give no row; an empty table gives an empty result.
    """
    docs = encoding.stored_texts(docs, "p5-texts")
    corpus = corpus or corpus_statistics(docs, abbreviations)
    model = model or encoding.learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast((corpus, model))

    @F.pandas_udf("array<struct<start_char:int,end_char:int,sentence:string>>")
    def split(texts: pd.Series) -> pd.Series:
        corpus, model = shared.value
        splitter, restorer = Splitter(corpus), encoding.Restorer(model)
        tables = [encoding.decode_table(r) for r in model.readers]
        out = []
        for text in texts:
            fixed, n = restorer.restore(text) if not text.isascii() else (text, 0)
            if n:
                at = offsets(text, fixed, tables)
                spans = [(at[a], at[b]) for a, b in splitter.spans(fixed)]
                spans = [(a + len(text[a:b]) - len(text[a:b].lstrip()), b - len(text[a:b]) + len(text[a:b].rstrip())) for a, b in spans]
            else:
                spans = splitter.spans(text)
            out.append([{"start_char": a, "end_char": b, "sentence": text[a:b]} for a, b in spans])
        return pd.Series(out, dtype=object)

    found = docs.select("doc_id", F.posexplode(split("text")).alias("sent_no", "s"))
    return found.select("doc_id", "sent_no", "s.start_char", "s.end_char", "s.sentence")
