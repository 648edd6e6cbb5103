"""Scalar functions over text, all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Escapes that stand for letters in recogniser output (fixed values).
ESCAPES = {r"\xe6": "æ", r"\xc6": "Æ", r"\xf8": "ø", r"\xd8": "Ø", r"\xe5": "å", r"\xc5": "Å", r"\xf4": "ô", r"\xfc": "ü", r"\xdc": "Ü", r"\xf6": "ö", r"\xd6": "Ö", r"\u2019": "'"}
#: Abbreviations whose dots end no sentence (fixed values).
SOFT_DOTS = {"tidl.": "tidl․", "f.eks.": "f․eks․", "fx.": "fx․"}
#: Words dropped besides the stop list (fixed values).
DROPPED_WORDS = ["bliver", "ligger", "siger", "mange", "får", "siden"]
#: Signs taken off both ends of a token (fixed values).
END_SIGNS = ".,:;<>!?(){}[]\"'\n-"
WORD = r"[\p{L}\p{N}_]+"


def _replace_all(c: Column, table: dict[str, str]) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), table.items(), c)


def words(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def tfidf_tokens(c: Column) -> Column:
    """Lower-case tokens of two signs or more that start with a letter."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-zøæå][\p{L}\p{N}_]+"), 0)


def links(c: Column) -> Column:
    """What stands between double square brackets, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"\[\[([^\]]*)\]\]"), 1)


def link_anchor(link: Column) -> Column:
    """The part after the last pipe, or the whole link."""
    return F.element_at(F.split(link, r"\|"), -1)


def link_target(link: Column) -> Column:
    """The part before the first pipe, or the whole link."""
    return F.get(F.split(link, r"\|"), F.lit(0))


def link_target_greedy(link: Column) -> Column:
    """The part before the last pipe, or the whole link."""
    return F.when(link.contains("|"), F.regexp_extract(link, r"^(.*)\|", 1)).otherwise(link)


def references(c: Column) -> Column:
    """Cleaned texts of footnotes, nested superscripts included; of a template with a title, the title."""
    low = F.lower(c)
    found = F.regexp_extract_all(low, F.lit(r"<ref>([^<]*(?:<sup>[^<]*</sup>[^<]*)?)</ref>"), 1)

    def clean(r: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(r, r"[\[\]]", ""), r"\{.*\}", "")
        bare = F.regexp_replace(bare, r"https?:[^ ]* ", "")
        titled = F.regexp_extract(r, r"title=([^|}]*)", 1)
        return F.trim(F.when(r.contains("title="), titled).otherwise(bare))

    return F.filter(F.transform(found, clean), lambda x: x != "")


def unescape_danish(c: Column) -> Column:
    return _replace_all(c, ESCAPES)


def url_letters(c: Column) -> Column:
    """Percent escapes decoded; text that holds none stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def strip_signs(c: Column) -> Column:
    return F.btrim(c, F.lit(END_SIGNS))


def plain_tokens(c: Column) -> Column:
    """Split at blanks, without signs at the ends, in lower case; empty strings stay."""
    return F.transform(F.split(c, " "), lambda t: F.lower(strip_signs(t)))


def mention_of_line(c: Column) -> Column:
    """A recogniser's line as one mention: its quoted segments joined by blanks; a corrupt line gives an empty string."""
    mixed = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(u?(?:'[^']*'|\"[^\"]*\"))"), 1), lambda s: F.regexp_replace(s, r"^u?['\"]|['\"]$", "")), " ")
    return F.coalesce(mixed, F.lit(""))


def format_paragraph(c: Column) -> Column:
    """A paragraph closed by a dot, doubled where one was there; two dots stay."""
    return F.when(c.endswith(".."), c).otherwise(F.concat(c, F.lit(".")))


def soft_abbreviations(c: Column) -> Column:
    return _replace_all(c, SOFT_DOTS)


def spaced_marks(c: Column) -> Column:
    """One blank after each end mark or slash, none before."""
    return F.regexp_replace(F.regexp_replace(c, r"([.!?/])", "$1 "), r" +([.!?/])", "$1")


def sentence_array(c: Column) -> Column:
    """Split after an end mark and blanks."""
    return F.split(F.trim(spaced_marks(c)), r"(?<=[.!?]) +")


def sentence_candidates(sentences: Column) -> Column:
    """Sentences worth scoring: of several words, on one line; the first always stays."""
    two = lambda s: (F.size(F.split(F.trim(s), r"\s+")) == 2) & ~F.get(F.split(F.trim(s), r"\s+"), F.lit(0)).rlike(r"^\p{L}+$")
    return F.filter(sentences, lambda s, i: (i == 0) | ((F.length(s) > 1) & s.contains(" ") & ~s.contains("\n") & ~two(s)))


def letters_key(c: Column) -> Column:
    """ASCII letters only, as a key for equal sentences."""
    return F.regexp_replace(c, "[^A-Za-z]+", "")


def clean_term(c: Column) -> Column:
    """A term without signs, in lower case; dropped words and numbers become empty."""
    bare = F.lower(F.regexp_replace(F.trim(c), r"[,.()?!:;+]", ""))
    return F.when(bare.isin(DROPPED_WORDS) | bare.rlike(r"^\d+$"), F.lit("")).otherwise(bare)


def first_of_concatenated(c: Column) -> Column:
    """Of several recognised names joined to one, the first."""
    return F.when(c.startswith("*r"), F.regexp_extract(c, r"^(\*r.*?)(?:\*r|$)", 1)).otherwise(c)


def xml_token(c: Column) -> Column:
    """Lower case, without escape signs, safe in XML."""
    bare = F.lower(F.replace(c, F.lit("\x1b"), F.lit("")))
    return _replace_all(bare, {"&": "&amp;", "<": "&lt;", ">": "&gt;"})


def or_query(mentions: Column, sites: Column | None = None) -> Column:
    """A search string: the quoted mentions, any of them, on certain sites."""
    quoted = F.array_join(F.transform(mentions, lambda m: F.concat(F.lit('"'), m, F.lit('"'))), " OR ")
    return quoted if sites is None else F.concat_ws(" ", quoted, F.array_join(F.transform(sites, lambda s: F.concat(F.lit("site:"), s)), " OR "))


def slug_words(url: Column) -> Column:
    """Words of the last path element of a profile address."""
    slug = F.regexp_extract(F.regexp_replace(F.lower(url_letters(url)), r"[/?#]+$", ""), r"([^/?#]+)$", 1)
    return F.filter(F.split(slug, "-"), lambda w: w != "")


def format_chars_off(c: Column) -> Column:
    """Invisible format characters removed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\p{Cf}", "")))


#: Signs that stand alone among the tokens: of each of Unicode's classes of punctuation and symbols all but the connectors and marks of writing words.
SINGLE = r"\p{Pd}\p{Ps}\p{Pe}\p{Pi}\p{Pf}\p{Po}\p{S}"
#: An address: a scheme or none, labels with dots between, the last one of letters, and a path or none.
ADDRESS = r"(?:[a-z]+://)?(?:[\p{L}\p{N}_\-]+\.)+\p{L}{2,}(?:/[^\s,;]*)?"


def _literal(s: str) -> str:
    """A text as a pattern of itself."""
    return "".join(c if c.isalnum() else f"\\{c}" for c in s)


def danish_tokens(c: Column, abbreviations: list[str]) -> Column:
    """Tokens: known abbreviations, addresses, the genitive after an apostrophe, words, and any other sign alone; the first that fits at a place wins.

    A word is a run of anything but white space and the signs that stand alone.
    """
    short = "|".join(_literal(a) for a in sorted(abbreviations, key=lambda a: (-len(a), a)))
    parts = [short, ADDRESS, "'s", rf"[^\s{SINGLE}]+", r"\S"]
    return F.regexp_extract_all(c, F.lit("|".join(p for p in parts if p)), 0)


def token_sentences(tokens: Column) -> Column:
    """Tokens grouped to sentences: a dot closes, other end marks only before a capital, quoted or not."""
    upper = lambda t: F.substring(t, 1, 1).rlike(r"^\p{Lu}$")

    def cut(t: Column, i: Column) -> Column:
        after, later = F.get(tokens, i + 1), F.get(tokens, i + 2)
        quoted = after.isin("\"", "'", "»", "«", "”", "“") & F.coalesce(upper(later), F.lit(False))
        closes = (t == ".") | (t.isin("?", "!", "...") & (F.coalesce(upper(after), F.lit(False)) | F.coalesce(quoted, F.lit(False))))
        return closes & (i > 0) & (i < F.size(tokens) - 1)

    flags = F.transform(tokens, lambda t, i: F.when(cut(t, i), i))
    ends = F.concat(F.filter(flags, lambda x: x.isNotNull()), F.array(F.size(tokens) - 1))
    return F.when(F.size(tokens) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(ends, lambda e, k: F.slice(tokens, F.when(k == 0, 1).otherwise(F.get(ends, k - 1) + 2), e - F.when(k == 0, -1).otherwise(F.get(ends, k - 1)))))


def holds_all(a: Column, b: Column) -> Column:
    """Whether every entry of the list ``a`` is in ``b``; not the other way round."""
    return F.size(F.array_except(a, b)) == 0
