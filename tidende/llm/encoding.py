"""Text garbled by a wrong character encoding: learn transformations from clean near-twins, then find and restore."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from encodings.aliases import aliases
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidende.io import materialize

#: Single-byte encodings that come first where others explain the same signs equally well (fixed values).
USUAL = ("cp1252", "latin-1", "cp850", "cp437", "mac_roman", "iso8859-15", "cp1251", "cp1253", "cp1250", "cp1254", "koi8-r")
#: ASCII letters that two sentences must have in common, and in all, to count as twins.
TWIN_LETTERS = 12
#: Share of a word's uses from which it stands for all words that differ in non-ASCII letters only.
ALONE = 0.9
#: Readers of UTF-8 kept with any support; another one must explain a run that no better supported one does (fixed values).
CLOSE = ("latin-1", "cp1252", "cp850", "cp437", "mac_roman")
#: Letters followed through a pair of single-byte encodings (fixed values).
LETTERS = "æøåÆØÅäöüÄÖÜéß"
#: Quotation marks put back together with them (fixed values).
QUOTES = "«»“”„"
#: Marks that belong at the ends of a word; there they show nothing, though some are images of letters too.
EDGES = QUOTES + "‘’‚‹›"
#: What a multi-byte character looks like in bytes.
_MULTI = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def decode_table(name: str) -> list[str]:
    """The characters of the upper 128 bytes; a byte without one stays the control character of its number."""
    out = []
    for b in range(128, 256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def single_byte() -> dict[str, list[str]]:
    """The upper tables of all of Python's single-byte encodings that hold ASCII, equal ones once, the usual ones first."""
    out: dict[str, list[str]] = {}
    lower = bytes(range(32, 127))
    for name in (*USUAL, *sorted(set(aliases.values()))):
        try:
            if lower.decode(name) != lower.decode("ascii"):
                continue
            known = [b for b in range(128, 256) if len(bytes([b]).decode(name, "ignore")) == 1]
            # A lead byte of a multi-byte encoding takes the next byte with it.
            if len(known) < 64 or len(bytes(known).decode(name)) != len(known):
                continue
        except (LookupError, UnicodeError):
            continue
        table = decode_table(name)
        if table not in out.values():
            out[name] = table
    return out


#: Encodings considered as the one written (besides UTF-8) or read.
TABLES = single_byte()


@dataclass
class Model:
    """What was learned: readers of UTF-8 bytes, pairs of single-byte encodings, and the characters native to the corpus."""

    readers: list[str] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    native: frozenset[str] = frozenset()


class Restorer:
    """Applies the learned readers of UTF-8 to texts."""

    def __init__(self, model: Model):
        self.native = model.native
        self.tables = []
        for name in model.readers:
            to_byte = {c: 128 + i for i, c in reversed(list(enumerate(decode_table(name))))}
            self.tables.append((to_byte, re.compile("[" + re.escape("".join(to_byte)) + "]{2,}")))

    def step(self, run: str, to_byte: dict[str, int]) -> tuple[str, list[str]]:
        """The run with every valid multi-byte character decoded, and these."""
        data = bytes(to_byte[c] for c in run)
        out, last, found = [], 0, []
        for m in _MULTI.finditer(data):
            try:
                c = m.group().decode("utf-8")
            except UnicodeDecodeError:
                continue
            out += [run[last : m.start()], c]
            found.append(c)
            last = m.end()
        return "".join([*out, run[last:]]), found

    def run(self, run: str, known: bool, depth: int = 3) -> tuple[str, int] | None:
        """The run put back to characters native to the corpus, over up to three rounds of garbling, and how many were.

        A lone character of another script may be two signs that happened to meet; elsewhere garbled text must be ``known``
        to take it for one.
        """
        best = None
        # A word in another script's letters, as it is written; such letters are bytes too where a reader of that script was learned.
        natural = len(run) > 2 and run.isalpha() and run[1:].islower() and min(run) >= "\u0370"
        for to_byte, runs in self.tables:
            good = 0
            if runs.fullmatch(run) is None or natural:
                continue
            fixed, found = self.step(run, to_byte)
            if not found:
                continue
            if all(c in self.native for c in found):
                alone = len(found) == 1 and ord(found[0]) >= 0x370 and not 0x2000 <= ord(found[0]) < 0x2200
                good = 0 if alone and not known else len(found)
            elif depth > 1:
                deeper = self.text(fixed, known, depth - 1)
                fixed, good = deeper
            if good and (best is None or good > best[1] or good == best[1] and len(fixed) < len(best[0])):
                best = (fixed, good)
        return best

    def text(self, text: str, known: bool, depth: int = 3) -> tuple[str, int]:
        count = 0

        def put(m: re.Match) -> str:
            nonlocal count
            fixed = self.run(m.group(), known, depth)
            if fixed is None:
                return m.group()
            count += fixed[1]
            return fixed[0]

        for _, runs in self.tables:
            text = runs.sub(put, text)
        return text, count

    def restore(self, text: str) -> tuple[str, int]:
        """Repeated, as text may be garbled twice, and once more where garbled text was found."""
        total = 0
        for _ in range(6):
            text, n = self.text(text, total > 0)
            if not n:
                break
            total += n
        return text, total


def skeleton(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]+", "")


def segments(docs: DataFrame) -> DataFrame:
    """``doc_id, segment``: the pieces of each text up to an end mark or line break that hold a non-ASCII character."""
    pieces = F.split("text", r"(?<=[.!?\n])\s*")
    return docs.select("doc_id", F.explode(pieces).alias("segment")).where(F.col("segment").rlike(r"[^\x00-\x7F]"))


def align(garbled: str, clean: str) -> list[tuple[str, str]]:
    """Non-ASCII runs that stand at the same place of the common ASCII skeleton and differ."""
    parts_a, parts_b = re.split(r"([\x00-\x7f])", garbled), re.split(r"([\x00-\x7f])", clean)
    if len(parts_a) != len(parts_b):
        return []
    return [(a, b) for a, b in zip(parts_a[::2], parts_b[::2], strict=True) if a != b and a and b]


@cache
def single_byte_signs() -> dict[tuple[str, str], list[tuple[str, str]]]:
    """The pairs ``(written, read)`` that turn a letter into a sign, by ``(sign, letter)``."""
    out: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for w, written in TABLES.items():
        for c in LETTERS:
            if c in written:
                for r, read in TABLES.items():
                    sign = read[written.index(c)]
                    if sign != c:
                        out.setdefault((sign, c), []).append((w, r))
    return out


def explanations(a: str, b: str) -> list[str]:
    """What may explain an aligned run, in either direction: ``u`` and the readers of UTF-8 that turn one side into the other, or ``s``, a sign and its letter.

    Runs fall into few such classes, whatever their number: subsets of the readers, and signs times letters.
    """
    out = []
    for garbled, clean in ((a, b), (b, a)):
        data = clean.encode("utf-8", "replace")
        if len(data) == len(garbled) and min(data) >= 128:
            readers = [r for r, table in TABLES.items() if all(table[x - 128] == c for x, c in zip(data, garbled, strict=True))]
            if readers:
                out.append("u" + ",".join(readers))
        if (garbled, clean) in single_byte_signs():
            out.append(f"s{garbled}{clean}")
    return out


def infer(classes: dict[str, int]) -> tuple[list[str], list[tuple[str, str]]]:
    """Readers of UTF-8 and single-byte pairs from the support of each class of ``explanations``.

    Of pairs that read every letter and quotation mark alike, the most usual one stands for all.
    """
    explained: dict[str, set[str]] = {}
    readers: dict[str, int] = {}
    pairs: dict[tuple[str, str], int] = {}
    for key, support in classes.items():
        if key[0] == "u":
            for r in key[1:].split(","):
                readers[r] = readers.get(r, 0) + support
                explained.setdefault(r, set()).add(key)
        else:
            for pair in single_byte_signs()[key[1], key[2]]:
                pairs[pair] = pairs.get(pair, 0) + support
    order = {name: k for k, name in enumerate(TABLES)}
    ranked = sorted(pairs, key=lambda p: (-pairs[p], order[p[0]] + order[p[1]], p))
    alike: dict[frozenset, tuple[str, str]] = {}
    for pair in ranked:
        alike.setdefault(frozenset(reverse_signs(*pair).items()), pair)
    kept, seen = [], set()
    for r in sorted(readers, key=lambda r: (-readers[r], r not in CLOSE, order[r])):
        if r in CLOSE or not explained[r] <= seen:
            kept.append(r)
            seen |= explained[r]
    return kept, list(alike.values())


def stored_texts(docs: DataFrame, name: str) -> DataFrame:
    """``doc_id, text`` without nulls, each text of a record once, written once: what follows reads it often and shuffles no text again."""
    kept = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return materialize(kept.select("doc_id", "text").distinct(), name)


def learn(docs: DataFrame) -> Model:
    """Join sentences with their most frequent twin on the text stripped of non-ASCII characters; align; infer.

    Equal sentences are counted before they are joined, and each variant meets one twin only, so no group is expanded into
    pairs. All aligned runs count; they are brought down to the classes of ``explanations`` where they are found, and their sums are
    few. The characters native to the corpus are those of at least three records and of more than one in 20,000.
    """
    s = segments(docs).select("segment", skeleton(F.col("segment")).alias("s"))
    s = s.where(F.length(F.regexp_replace("s", "[^A-Za-z]", "")) >= TWIN_LETTERS)
    variants = s.groupBy("s", "segment").agg(F.count("*").alias("n"))
    best = variants.groupBy("s").agg(F.max(F.struct("n", "segment")).alias("top"), F.count("*").alias("k")).where(F.col("k") > 1)
    twins = variants.join(best, "s").where(F.col("segment") != F.col("top.segment")).select("segment", F.col("top.segment").alias("clean"))

    @F.pandas_udf("array<string>")
    def classes(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[k for x, y in align(g, c) for k in explanations(x, y)] for g, c in zip(a, b, strict=True)], dtype=object)

    found = twins.select(F.explode(classes("segment", "clean")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    readers, pairs = infer({r.k: r.n for r in found.collect()})
    chars = docs.select(F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where(F.col("c").rlike(r"[^\x00-\x{9F}]")).groupBy("c").agg(F.count("*").alias("n"))
    n = docs.count()
    # At most as many as there are characters in Unicode.
    native = frozenset(r.c for r in chars.where((F.col("n") >= 3) & (F.col("n") * 20_000 > n)).select("c").collect())
    return Model(readers, pairs, native)


def words(c: Column) -> Column:
    """Runs of letters and non-ASCII signs."""
    return F.regexp_extract_all(c, F.lit(r"[^\x00-\x40\x5B-\x60\x7B-\x7F\s]+"), 0)


def reverse_signs(written: str, read: str) -> dict[str, str]:
    """What a sign read by the wrong one of two single-byte encodings was, for letters and quotation marks."""
    table, out = decode_table(read), {}
    for c in LETTERS + QUOTES:
        try:
            out.setdefault(table[c.encode(written)[0] - 128], c)
        except UnicodeEncodeError:
            continue
    return out


def restore_segments(text: str, swaps: list[dict] | None, reverse: list[dict[str, str]]) -> str:
    """Each piece of the text that holds a confirmed word, read by the pair of encodings that most of its words have; of equal ones, that of the text."""
    if swaps is None:
        return text
    out, everywhere = [], Counter(k for s in swaps for k in s["pairs"])
    for piece in re.split(r"(?<=[.!?\n])(?=\s)", text):
        hits = Counter(k for s in swaps if s["word"] in piece for k in s["pairs"])
        out.append(piece.translate(str.maketrans(reverse[max(hits, key=lambda k: (hits[k], everywhere[k], -k))])) if hits else piece)
    return "".join(out)


def other_script(c: str) -> bool:
    return c >= "\u0370" and c.isalpha()


def mixed_pairs(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Pairs not learned that turn letters into those of another script: a word that mixes them with ASCII ones shows them by itself."""
    out: dict[frozenset, tuple[str, str]] = {}
    for w in CLOSE:
        for r in TABLES:
            images = reverse_signs(w, r).items()
            if (w, r) not in pairs and sum(other_script(sign) for sign, c in images if c in LETTERS) >= 3:
                out.setdefault(frozenset(images), (w, r))
    return list(out.values())


def single_byte_cases(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, word, pairs``: words that pairs of single-byte encodings turn into a word known from the corpus.

    The word so restored must be in more distinct sentences than the garbled one, or else in more records, at least twice as
    many, so that foreign names and units that belong in the text stay, and copies of a garbled text don't outnumber the clean
    ones. Whatever these numbers, a word is taken if its sentences so restored are in the corpus, or if it mixes scripts and is
    known restored. Only words with a sign that is the image of a letter are joined, each word once.
    """
    tables = []
    for k, pair in enumerate([*model.pairs, *mixed_pairs(model.pairs)]):
        images = {ord(sign): c for sign, c in reverse_signs(*pair).items() if c in LETTERS and sign not in "æøåÆØÅ" and sign != c}
        if k >= len(model.pairs):
            images = {sign: c for sign, c in images.items() if other_script(chr(sign))}
        if images:
            tables.append((k, images))
    if not tables:
        return docs.sparkSession.createDataFrame([], "doc_id string, word string, pairs array<int>")
    found = docs.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).where(F.col("word").rlike(r"[^\x00-\x7F]"))
    found = materialize(found, "p2-found")
    pieces = materialize(segments(docs).select("segment").distinct(), "p2-segments")
    spoken = pieces.select(F.explode(F.array_distinct(words(F.col("segment")))).alias("word")).where(F.col("word").rlike(r"[^\x00-\x7F]"))
    lowered = [x.select(F.lower("word").alias("word"), F.lit(k).alias("k")) for k, x in enumerate((found, spoken))]
    counts = lowered[0].unionAll(lowered[1]).groupBy("word").agg(F.count_if(F.col("k") == 0).alias("n"), F.count_if(F.col("k") == 1).alias("m"))
    counts = materialize(counts, "p2-words")
    signs = "".join(dict.fromkeys(chr(x) for _, images in tables for x in images))
    # Two of the signs can be quotation marks; a word needs one beside a letter.
    suspects = found.where((F.translate("word", signs, "") != F.col("word")) & F.col("word").rlike("[A-Za-z]"))

    @F.pandas_udf("array<struct<fixed:string,pairs:array<int>>>")
    def options(found: pd.Series) -> pd.Series:
        out = []
        for word in found:
            by: dict[str, list[int]] = {}
            for k, images in tables:
                by.setdefault(word.translate(images), []).append(k)
            by.pop(word, None)
            out.append([{"fixed": f, "pairs": p} for f, p in by.items()])
        return pd.Series(out, dtype=object)

    tried = suspects.select("word").distinct().select("word", F.explode(options("word")).alias("t")).select("word", "t.*")
    known = counts.select(F.col("word").alias("fixed_key"), F.col("n").alias("n_fixed"), F.col("m").alias("m_fixed"))
    own = counts.select(F.col("word").alias("word_key"), F.col("n").alias("n_own"), F.col("m").alias("m_own"))
    both = tried.join(known, F.lower("fixed") == F.col("fixed_key")).join(own, F.lower("word") == F.col("word_key"))
    often = [F.col(f"{x}_fixed") >= F.greatest(F.lit(2), 2 * F.col(f"{x}_own")) for x in "nm"]
    mixed = ~F.translate("word", "".join(c for c in signs if other_script(c)), "").rlike(r"[^\x00-\x7F]")
    sure = both.where(often[0] | often[1] | mixed).select("word", "pairs").unionByName(proved_words(pieces, own, tables, signs))
    return suspects.join(sure.groupBy("word").agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs")), "word").select("doc_id", "word", "pairs")


def proved_words(pieces: DataFrame, own: DataFrame, tables: list[tuple[int, dict[int, str]]], signs: str) -> DataFrame:
    """``word, pairs``: words that a pair restores in half of their distinct sentences at least to another sentence of the corpus.

    A twin alone doesn't say which of the two is garbled: many sentences have the clean form, and its garbled twin is one.
    """
    s = pieces.withColumn("s", skeleton(F.col("segment"))).where(F.length(F.regexp_replace("s", "[^A-Za-z]", "")) >= TWIN_LETTERS)
    several = s.groupBy("s").agg(F.count("*").alias("k")).where(F.col("k") > 1).select("s")
    s = s.where(F.translate("segment", signs, "") != F.col("segment")).join(several, "s").select("segment")

    @F.pandas_udf("array<struct<restored:string,pairs:array<int>>>")
    def options(found: pd.Series) -> pd.Series:
        out = []
        for segment in found:
            by: dict[str, list[int]] = {}
            held = {ord(c) for c in segment if c > "\x7f"}
            for k, images in tables:
                if not held.isdisjoint(images):
                    by.setdefault(segment.translate(images), []).append(k)
            out.append([{"restored": f, "pairs": p} for f, p in by.items()])
        return pd.Series(out, dtype=object)

    tried = s.select("segment", F.explode(options("segment")).alias("t")).select("segment", "t.*")
    sure = tried.join(pieces.select(F.col("segment").alias("restored")), "restored", "left_semi")
    found = sure.select("segment", F.explode(words(F.col("segment"))).alias("word"), "pairs").where((F.translate("word", signs, "") != F.col("word")) & F.col("word").rlike("[A-Za-z]"))
    each = found.select("segment", "word", F.explode("pairs").alias("pair")).distinct().groupBy("word", "pair").agg(F.count("*").alias("proved"))
    each = each.join(own, F.lower("word") == F.col("word_key")).where(2 * F.col("proved") >= F.col("m_own"))
    images_of = dict(tables)

    @F.pandas_udf("boolean")
    def read(found: pd.Series, pairs: pd.Series) -> pd.Series:
        """Whether the pair reads a sign of this very word, marks at its ends apart."""
        return pd.Series([not images_of[k].keys().isdisjoint(map(ord, w.strip(EDGES))) for w, k in zip(found, pairs, strict=True)], dtype=bool)

    return each.where(read("word", "pair")).groupBy("word").agg(F.collect_list("pair").alias("pairs"))


def garbled_records(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, text, restored, signs``: each row with garbled text, restored as far as it can be known.

    ``signs`` counts the multi-byte characters put back; U+FFFD stands for a letter that is lost, put back from a
    twin sentence, or else where the corpus knows one word only that it can have been. Null and empty texts, and texts without such signs, give no row; an empty table gives an empty
    result. A null ``doc_id`` is no record.
    """
    docs = stored_texts(docs, "p2-texts")
    model = model or learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("restored string, signs int")
    def multi(texts: pd.Series) -> pd.DataFrame:
        restorer = Restorer(shared.value)
        return pd.DataFrame([restorer.restore(t) for t in texts], columns=["restored", "signs"])

    reverse = [reverse_signs(w, r) for w, r in [*model.pairs, *mixed_pairs(model.pairs)]]

    @F.pandas_udf("string")
    def put_back(texts: pd.Series, swaps: pd.Series) -> pd.Series:
        return pd.Series([restore_segments(t, s, reverse) for t, s in zip(texts, swaps, strict=True)], dtype=object)

    tried = docs.where(F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", "text", multi("text").alias("m")).select("doc_id", "text", "m.*")
    cases = single_byte_cases(docs, model).groupBy("doc_id").agg(F.collect_set(F.struct("word", "pairs")).alias("swaps"))
    joined = tried.join(cases, "doc_id", "left")
    lost = F.col("text").contains("\ufffd")
    found = joined.where((F.col("signs") > 0) | F.col("swaps").isNotNull() | lost)
    return _from_words(_from_twins(found.select("doc_id", "text", put_back("restored", "swaps").alias("restored"), "signs"), docs), docs)


def same_case(broken: str, known: str) -> str:
    """A lower-case word put in place of one with lost letters; what was not lost stays as it was written."""
    kept, letters = re.split("\ufffd+", broken), re.findall(r"[^\x00-\x7f]+", known)
    loud = len(re.sub("[^A-Za-z]", "", broken)) > 1 and broken.upper() == broken
    if len(letters) != len(kept) - 1:
        return broken
    letters = [x.upper() if loud else x for x in letters]
    return "".join(x for pair in zip(kept, [*letters, ""], strict=True) for x in pair)


def _from_words(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Words with lost letters replaced by the word of the corpus that has any letters in their place, if there is one only, or as good as one.

    Only records with lost letters take part; the words of the corpus are cut down to those that fit one of theirs.
    """
    lost = F.col("restored").contains("\ufffd")
    key = lambda c: F.regexp_replace(F.lower(c), r"[^\x00-\x7F]+", "\ufffd")
    broken = found.where(lost).select("doc_id", F.explode(F.array_distinct(words(F.col("restored")))).alias("word")).where(F.col("word").contains("\ufffd") & F.col("word").rlike("[A-Za-z]"))
    # A word that holds lost and other non-ASCII letters fits none by its key alone, unless they stand apart.
    broken = broken.where(~F.replace("word", F.lit("\ufffd"), F.lit("")).rlike(r"[^\x00-\x7F]")).withColumn("key", key(F.col("word")))
    known = docs.where(F.col("text").rlike(r"[^\x00-\x7F]")).select(F.explode(words(F.col("text"))).alias("w")).where(F.col("w").rlike(r"[^\x00-\x7F]") & ~F.col("w").contains("\ufffd") & (F.regexp_replace("w", r"[^\x00-\x7F\p{L}]", "") == F.col("w")))
    known = known.groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n")).withColumn("key", key(F.col("w"))).join(broken.select("key").distinct(), "key", "left_semi")
    one = known.groupBy("key").agg(F.max(F.struct("n", "w")).alias("top"), F.sum("n").alias("all")).where(F.col("top.n") >= ALONE * F.col("all")).select("key", F.col("top.w").alias("known"))
    swaps = broken.join(one, "key").groupBy("doc_id").agg(F.collect_set(F.struct("word", "known")).alias("lost_words"))

    @F.pandas_udf("string")
    def put(texts: pd.Series, swaps: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, swaps, strict=True):
            if found is not None:
                fixed = {x["word"]: same_case(x["word"], x["known"]) for x in found}
                text = re.sub("[^\x00-\x40\x5b-\x60\x7b-\x7f\\s]+", lambda m: fixed.get(m.group(), m.group()), text)
            out.append(text)
        return pd.Series(out, dtype=object)

    return found.join(swaps, "doc_id", "left").select("doc_id", "text", put("restored", "lost_words").alias("restored"), "signs")


def _from_twins(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Sentences with lost letters replaced by a twin without any, the most frequent one."""
    broken = segments(found.where(F.col("restored").contains("\ufffd")).select("doc_id", F.col("restored").alias("text"))).where(F.col("segment").contains("\ufffd"))
    broken = broken.select("doc_id", "segment", skeleton(F.col("segment")).alias("s")).where(F.length(F.regexp_replace("s", "[^A-Za-z]", "")) >= TWIN_LETTERS)
    whole = segments(docs).where(~F.col("segment").contains("\ufffd")).select("segment", skeleton(F.col("segment")).alias("s"))
    whole = whole.join(broken.select("s").distinct(), "s", "left_semi").groupBy("s", "segment").agg(F.count("*").alias("n"))
    best = whole.groupBy("s").agg(F.max(F.struct("n", "segment")).alias("t")).select("s", F.col("t.segment").alias("clean"))
    swaps = broken.join(best, "s").groupBy("doc_id").agg(F.collect_set(F.struct("segment", "clean")).alias("twins"))
    none = F.array().cast("array<struct<segment:string,clean:string>>")
    put = F.aggregate(F.coalesce("twins", none), F.col("restored"), lambda t, s: F.replace(t, s["segment"], s["clean"]))
    return found.join(swaps, "doc_id", "left").select("doc_id", "text", put.alias("restored"), "signs")
