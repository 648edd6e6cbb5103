"""Queries over texts: words, sentences, weights, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidende.functions import text
from tidende.io import table
from tidende.operators import corpus, entities, representation
from tidende.plans.base import ARTS, BOW, MENTIONS, Plans, articles, mentions

P = Plans()
QUERIES, SQL = P.queries, P.sql


@P.query(f"WITH {ARTS}, {BOW} SELECT doc_id, token, tf FROM bow")
def doc_bow(spark, sf):
    return representation.bag_of_words(articles(spark, sf))


@P.query(f"WITH {ARTS}, {BOW} SELECT token, df, row_number() OVER (ORDER BY encode(token)) - 1 AS id FROM (SELECT token, count(*) AS df FROM bow GROUP BY token HAVING count(*) > 1)")
def dictionary_df_gt1(spark, sf):
    return representation.dictionary(articles(spark, sf))


_TFIDF = rf"""WITH {ARTS}, bow AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zøæå][\p{{L}}\p{{N}}_]+')) AS term FROM arts) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM bow GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM arts),
w AS (SELECT doc_id, term, tf, df, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0) AS w FROM bow JOIN df USING (term), n),
tfidf AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM w)"""


@P.query(f"{_TFIDF} SELECT doc_id, term, tf, df, round(tfidf, 6) AS tfidf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, encode(term)) AS k FROM tfidf) WHERE k <= 50")
def tfidf_top50(spark, sf):
    return representation.tfidf(articles(spark, sf)).withColumn("tfidf", F.round("tfidf", 6))


@P.query(f"""WITH {ARTS}, {BOW} SELECT term, doc_id, tf, sum(tf) OVER (PARTITION BY doc_id)::BIGINT AS length FROM (SELECT token AS term, doc_id, tf FROM bow)""")
def inverted_index(spark, sf):
    return representation.inverted_index(articles(spark, sf)).select("term", "doc_id", "tf", "length")


@P.query(
    f"""WITH {ARTS}, {BOW}, len AS (SELECT doc_id, sum(tf) AS length FROM bow GROUP BY doc_id), s AS (SELECT count(*) AS n, avg(length) AS mean FROM len),
hits AS (SELECT * FROM bow JOIN len USING (doc_id) WHERE token IN ('bestyrelsen', 'viljen')), df AS (SELECT token, count(*) AS df FROM hits GROUP BY token)
SELECT doc_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM hits JOIN df USING (token), s GROUP BY doc_id ORDER BY score DESC, encode(doc_id) LIMIT 10"""
)
def bm25_search(spark, sf):
    """A top-10 report."""
    return representation.search(articles(spark, sf), "bestyrelsen viljen").withColumn("score", F.round("score", 6))


_SENTENCES = rf"""soft AS (SELECT doc_id, replace(replace(replace(text, 'tidl.', 'tidl․'), 'f.eks.', 'f․eks․'), 'fx.', 'fx․') AS t FROM arts),
spaced AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '([.!?/])', '\1 ', 'g'), ' +([.!?/])', '\1', 'g')) AS t FROM soft),
cut AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?]) +', '\1' || chr(30), 'g'), chr(30)) AS s FROM spaced),
sent AS (SELECT doc_id, i - 1 AS sent_no, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM cut) WHERE trim(s[i]) <> '')"""


@P.query(f"WITH {ARTS}, {_SENTENCES} SELECT doc_id, sent_no, sentence FROM sent")
def sentence_split(spark, sf):
    return corpus.sentence_rows(articles(spark, sf))


@P.query(
    f"""WITH {ARTS}, {_SENTENCES}, keyed AS (SELECT *, regexp_replace(sentence, '[^A-Za-z]+', '', 'g') AS key FROM sent)
SELECT doc_id, sent_no, sentence FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY encode(doc_id), sent_no) AS k FROM keyed) WHERE k = 1 OR key = ''"""
)
def letters_only_dedup(spark, sf):
    return corpus.first_sentences(corpus.sentence_rows(articles(spark, sf)))


@P.query(
    r"""SELECT DISTINCT mention, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(mention, '\xe6', 'æ'), '\xc6', 'Æ'), '\xf8', 'ø'), '\xd8', 'Ø'), '\xe5', 'å'), '\xc5', 'Å'), '\xf4', 'ô'), '\xfc', 'ü'), '\xdc', 'Ü'), '\xf6', 'ö'), '\xd6', 'Ö'), '\u2019', '''') AS plain
FROM priors WHERE contains(mention, '\x')"""
)
def danish_unescape(spark, sf):
    return table(spark, sf, "priors").where(F.contains("mention", F.lit("\\x"))).select("mention").distinct().withColumn("plain", text.unescape_danish(F.col("mention")))


@P.query("SELECT DISTINCT mention, mention AS decoded FROM priors WHERE trim(mention) <> ''")
def url_decode(spark, sf):
    m = table(spark, sf, "priors").where(F.trim("mention") != "").select("mention").distinct()
    return m.select("mention", text.url_letters(F.url_encode("mention")).alias("decoded")).withColumn("decoded", F.replace("decoded", F.lit("+"), F.lit(" ")))


@P.query(
    r"""WITH t AS (SELECT lower(regexp_replace(trim(t), '[,.()?!:;+]', '', 'g')) AS term FROM (SELECT unnest(terms) AS t FROM doc2terms) WHERE t IS NOT NULL)
SELECT term, count(*) AS n FROM t WHERE term <> '' AND term NOT IN ('bliver', 'ligger', 'siger', 'mange', 'får', 'siden') AND NOT regexp_matches(term, '^[0-9]+$') GROUP BY term"""
)
def clean_terms(spark, sf):
    t = table(spark, sf, "doc2terms").select(F.explode("terms").alias("t")).where(F.col("t").isNotNull()).select(text.clean_term(F.col("t")).alias("term"))
    return t.where(F.col("term") != "").groupBy("term").agg(F.count("*").alias("n"))


@P.query(
    f"""WITH {MENTIONS}, r AS (SELECT '*r.' || lower(trim(mention)) AS term, doc_id FROM men UNION ALL SELECT '*w.' || lower(entity), doc_id FROM men WHERE kb = 'w' AND entity IS NOT NULL)
SELECT term, doc_id, count(*) AS n FROM r GROUP BY ALL"""
)
def inverted_entities(spark, sf):
    return representation.inverted_entities(mentions(spark, sf))


@P.query(f"WITH {MENTIONS} SELECT DISTINCT entity, trim(mention) AS mention FROM men WHERE kb = 'w' AND entity IS NOT NULL")
def surface_forms(spark, sf):
    return representation.surface_forms(mentions(spark, sf))


@P.query(
    rf"""WITH {MENTIONS}, w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(entity), '\s+')) AS w FROM men WHERE entity IS NOT NULL),
f AS (SELECT w AS word FROM w UNION SELECT w[:-2] FROM w WHERE regexp_matches(w, '(en|s|er|e)$') UNION SELECT w[:-3] FROM w WHERE regexp_matches(w, '(en|er)$') UNION SELECT 'er' UNION SELECT 'og')
SELECT DISTINCT word FROM f WHERE word <> ''"""
)
def stop_words(spark, sf):
    return representation.stop_words(["er", "og"], mentions(spark, sf).where(F.col("entity").isNotNull()))


@P.query(
    f"""WITH {ARTS}, {BOW}, {MENTIONS}, tag AS (SELECT DISTINCT doc_id, CASE WHEN kb = 'w' AND entity IS NOT NULL THEN 'w' ELSE 'r' END AS kind, trim(mention) AS term FROM men),
names AS (SELECT doc_id, string_agg(DISTINCT lower(term), chr(10)) AS names FROM tag GROUP BY doc_id)
SELECT bow.doc_id, '' AS kind, token AS term FROM bow LEFT JOIN names USING (doc_id) WHERE names IS NULL OR NOT contains(names, token) UNION ALL SELECT doc_id, kind, term FROM tag"""
)
def covered_terms(spark, sf):
    plain = representation.bag_of_words(articles(spark, sf)).select("doc_id", F.lit("").alias("kind"), F.col("token").alias("term"))
    return entities.without_covered_terms(plain.unionByName(representation.entity_tags(mentions(spark, sf))))


@P.query(f"WITH {ARTS}, {BOW} SELECT doc_id, token AS term, tf, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, encode(token)) AS k FROM bow) WHERE k <= 10")
def top_terms(spark, sf):
    from tidende.sources import sinks

    bow = representation.bag_of_words(articles(spark, sf)).select(F.col("doc_id").alias("cluster_id"), F.col("token").alias("term"), F.col("tf").alias("weight"))
    return sinks.top_terms(bow).select(F.col("cluster_id").alias("doc_id"), "term", F.col("weight").alias("tf"), "rank")


_ENDS = "['', 'e', 'else', 'en', 'er', 'et', 'ende', 'ene', 'erne', 'es', 'i', 'ing', 'is', 'isme', 's', 'ske', 'n', 'ne', 'ning', 'h', 'hed']"


@P.query(
    rf"""WITH {MENTIONS}, named AS (SELECT mention FROM men WHERE entity IS NULL UNION ALL SELECT split_part(mention, ' ', 1) || 's' FROM men WHERE entity IS NULL AND pos % 2 = 0 UNION ALL SELECT split_part(mention, ' ', 1) FROM men WHERE entity IS NULL AND pos % 3 = 0),
c AS (SELECT lower(trim(mention)) AS mention, count(*) AS n FROM named GROUP BY 1), w AS (SELECT mention, n, regexp_split_to_array(replace(mention, '-', ' '), '\s+') AS w FROM c),
r AS (SELECT DISTINCT mention, n, array_to_string(w[i:j], ' ') AS run FROM (SELECT *, unnest(range(i, len(w) + 1)) AS j FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w))),
s AS (SELECT DISTINCT mention, n, left(run, len(run) - len(e)) AS stem FROM (SELECT *, unnest({_ENDS}) AS e FROM r) WHERE e = '' OR (ends_with(run, e) AND len(run) > len(e) + 2)),
f AS (SELECT s.mention, s.n, c.mention AS base, row_number() OVER (PARTITION BY s.mention ORDER BY len(c.mention), c.n DESC, encode(c.mention)) AS k FROM s JOIN c ON s.stem = replace(c.mention, '-', ' ')),
v AS (SELECT mention, base AS canonical, n FROM f WHERE k = 1), g AS (SELECT canonical, string_agg('*r.' || mention, '' ORDER BY n DESC, encode(mention)) AS name FROM v GROUP BY canonical HAVING count(*) > 1)
SELECT mention, canonical, n, name FROM v LEFT JOIN g USING (canonical)"""
)
def entity_canonicalize(spark, sf):
    """Variants of recognised names, and their concatenated name."""
    m = mentions(spark, sf).where(F.col("entity").isNull())
    # Single names, and names in the genitive, beside the whole ones.
    first = F.split_part("mention", F.lit(" "), F.lit(1))
    more = m.where("pos % 2 = 0").select(F.concat(first, F.lit("s")).alias("mention")).unionByName(m.where("pos % 3 = 0").select(first.alias("mention")))
    found = entities.variants(m.select("mention").unionByName(more))
    return found.join(entities.concatenated(found), "mention", "left")


_TOKENS = r"""ab AS (SELECT string_agg(regexp_replace(abbr, '([^\p{L}\p{N}])', '\\\1', 'g'), '|' ORDER BY len(abbr) DESC, encode(abbr)) AS a FROM abbreviations WHERE abbr IS NOT NULL),
tk AS (SELECT doc_id, regexp_extract_all(text, a || '|(?:[a-z]+://)?(?:[\p{L}\p{N}_\-]+\.)+\p{L}{2,}(?:/[^\s,;]*)?|' || chr(39) || 's|[^\s\x0B\p{Pd}\p{Ps}\p{Pe}\p{Pi}\p{Pf}\p{Po}\p{S}]+|[^\s\x0B]') AS t FROM arts, ab),
pos AS (SELECT doc_id, i, t[i] AS tok, t[i + 1] AS after, t[i + 2] AS later, len(t) AS n FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM tk)),
fl AS (SELECT *, (tok = '.' OR (tok IN ('?', '!', '...') AND (coalesce(regexp_matches(after, '^\p{Lu}'), false) OR (coalesce(after, '') IN ('"', chr(39), '»', '«', '”', '“') AND coalesce(regexp_matches(later, '^\p{Lu}'), false))))) AND i > 1 AND i < n AS cut FROM pos),
gr AS (SELECT *, coalesce(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_no FROM fl)"""


@P.query(f"WITH {ARTS}, {_TOKENS} SELECT doc_id, CAST(sent_no AS INT) AS sent_no, list(tok ORDER BY i) AS tokens FROM gr GROUP BY doc_id, sent_no")
def danish_tokens(spark, sf):
    """Tokens by first matching pattern, grouped to sentences."""
    abbr = [r.abbr for r in table(spark, sf, "abbreviations").where(F.col("abbr").isNotNull()).collect()]
    t = articles(spark, sf).select("doc_id", text.danish_tokens(F.col("text"), abbr).alias("tokens"))
    return t.select("doc_id", F.posexplode(text.token_sentences(F.col("tokens"))).alias("sent_no", "tokens"))


@P.query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
