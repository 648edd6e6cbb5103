"""Queries over the link dictionary and disambiguation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidende.io import materialize, table
from tidende.operators import coherence as co
from tidende.operators import disambiguate, evaluate, links, prior, similarity, web
from tidende.plans.base import ARTS, LINKS, MENTIONS, PRIOR, Plans, articles, mentions, pages
from tidende.sources import readers

P = Plans()
QUERIES, SQL = P.queries, P.sql


def _uses(spark, sf):
    return table(spark, sf, "priors").select("mention", "entity")


def _prior(spark, sf):
    return prior.popularity(_uses(spark, sf))


def _inlinks(spark, sf):
    p = table(spark, sf, "priors").where(F.col("entity").isNotNull() & F.col("page_title").isNotNull())
    return p.select("entity", F.col("page_title").alias("source")).distinct()


def _candidates(spark, sf):
    return prior.candidates(mentions(spark, sf), _prior(spark, sf))


_CAND = "cand AS (SELECT DISTINCT m.doc_id, m.mention, p.entity, p.prior FROM men m LEFT JOIN (SELECT * FROM prior WHERE k <= 5) p ON lower(trim(m.mention)) = p.mention)"


@P.query(f"WITH {PRIOR} SELECT mention, entity, n, round(prior, 6) AS prior FROM prior WHERE k <= 5")
def popularity_prior_top5(spark, sf):
    return _prior(spark, sf).withColumn("prior", F.round("prior", 6))


@P.query(f"WITH {LINKS} SELECT title, anchor, target, count(*) AS n FROM links GROUP BY ALL")
def link_extract(spark, sf):
    return links.article_links(pages(spark, sf)).groupBy("title", "anchor", "target").agg(F.count("*").alias("n"))


@P.query(f"WITH {LINKS} SELECT target, title, count(*) AS n FROM links GROUP BY ALL")
def inlink_multiset(spark, sf):
    return links.inlink_counts(pages(spark, sf))


@P.query(f"WITH {LINKS} SELECT DISTINCT target, title FROM links")
def inlink_distinct(spark, sf):
    return links.inlinks(pages(spark, sf))


@P.query(f"WITH {LINKS} SELECT lower(title) AS entity, anchor, count(*) AS n FROM links GROUP BY ALL")
def anchor_texts_per_entity(spark, sf):
    return links.anchor_texts(pages(spark, sf)).groupBy("entity", "anchor").agg(F.count("*").alias("n"))


@P.query("SELECT lower(trim(entity)) AS entity, lower(replace(page_title, '_', ' ')) AS category, count(*) AS n FROM (SELECT DISTINCT entity, page_title FROM priors WHERE entity IS NOT NULL AND page_title IS NOT NULL) GROUP BY ALL")
def category_explode(spark, sf):
    rows = _inlinks(spark, sf).groupBy(F.replace("source", F.lit(" "), F.lit("_")).alias("cl_to")).agg(F.array_join(F.array_sort(F.collect_list("entity")), "\n").alias("cl_sortkey"))
    return links.categories(rows).groupBy("entity", "category").agg(F.count("*").alias("n"))


@P.query(
    f"""WITH {PRIOR}, {MENTIONS}, m AS (SELECT DISTINCT doc_id, trim(mention) || 's' AS mention FROM men), top AS (SELECT * FROM prior WHERE k <= 5),
hit AS (SELECT m.doc_id, m.mention, p.entity, p.prior FROM m LEFT JOIN top p ON lower(m.mention) = p.mention),
again AS (SELECT h.doc_id, h.mention, p.entity, p.prior FROM hit h LEFT JOIN top p ON lower(h.mention)[:-2] = p.mention WHERE h.entity IS NULL)
SELECT doc_id, mention, entity, round(prior, 6) AS prior FROM hit WHERE entity IS NOT NULL UNION ALL SELECT doc_id, mention, entity, round(prior, 6) FROM again"""
)
def prior_trailing_s_fallback(spark, sf):
    """The documents' mentions in the genitive."""
    p = _prior(spark, sf)
    m = mentions(spark, sf).select("doc_id", F.concat(F.trim("mention"), F.lit("s")).alias("mention"))
    return prior.genitive_fallback(prior.candidates(m, p), p).withColumn("prior", F.round("prior", 6))


@P.query(
    f"""WITH {PRIOR}, {MENTIONS}, {_CAND}, t AS (SELECT *, max(prior) OVER (PARTITION BY doc_id, mention) AS top, row_number() OVER (PARTITION BY doc_id, mention ORDER BY prior DESC, encode(entity)) AS r FROM cand WHERE entity IS NOT NULL)
SELECT doc_id, mention, entity, round(prior, 6) AS prior, CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS similarity FROM t WHERE top > 0.8"""
)
def prior_short_circuit(spark, sf):
    return prior.short_circuit(_candidates(spark, sf))[0].withColumn("prior", F.round("prior", 6))


@P.query(
    f"""WITH {PRIOR}, m AS (SELECT DISTINCT page_title AS doc_id, mention FROM priors WHERE trim(mention) <> ''),
c AS (SELECT m.doc_id, m.mention, p.entity, p.prior, row_number() OVER (PARTITION BY m.doc_id, m.mention ORDER BY p.prior DESC NULLS LAST, encode(p.entity)) AS r FROM m LEFT JOIN (SELECT * FROM prior WHERE k <= 5) p ON lower(trim(m.mention)) = p.mention)
SELECT doc_id, mention, entity, CASE WHEN lower(trim(mention)) = 'danmark' AND entity IS NOT NULL THEN 1.0 ELSE round(prior, 6) END AS prior FROM c WHERE r = 1 OR lower(trim(mention)) <> 'danmark'"""
)
def prior_language_override(spark, sf):
    """Names on a fixed list keep their top candidate."""
    m = table(spark, sf, "priors").where(F.trim("mention") != "").select(F.col("page_title").alias("doc_id"), "mention")
    names = spark.createDataFrame([("Danmark",)], "name string")
    return prior.language_names(prior.candidates(m, _prior(spark, sf)), names).withColumn("prior", F.round("prior", 6))


@P.query(
    f"""WITH {PRIOR}, {MENTIONS}, {_CAND}, sizes AS (SELECT entity, count(DISTINCT page_title) AS n FROM priors WHERE entity IS NOT NULL AND page_title IS NOT NULL GROUP BY entity),
g AS (SELECT doc_id, mention, max(coalesce(n, 0)) > 25 AND max(prior) < 0.8 AS gone FROM cand LEFT JOIN sizes USING (entity) GROUP BY ALL)
SELECT DISTINCT doc_id, mention, CASE WHEN NOT coalesce(gone, false) THEN entity END AS entity, CASE WHEN NOT coalesce(gone, false) THEN round(prior, 6) END AS prior FROM cand JOIN g USING (doc_id, mention)"""
)
def keyphrase_size_filter(spark, sf):
    sizes = _inlinks(spark, sf).groupBy("entity").agg(F.count("*").alias("n"))
    return prior.few_keyphrases(_candidates(spark, sf), sizes, most=25).withColumn("prior", F.round("prior", 6))


_IN = "inl AS (SELECT DISTINCT entity, page_title AS source FROM priors WHERE entity IS NOT NULL AND page_title IS NOT NULL)"


@P.query(
    f"""WITH {_IN}, size AS (SELECT entity, count(*) AS n FROM inl GROUP BY entity), sh AS (SELECT x.entity AS a, y.entity AS b, count(*) AS shared FROM inl x JOIN inl y ON x.source = y.source AND encode(x.entity) < encode(y.entity) GROUP BY ALL),
v AS (SELECT a, b, shared, 1.0 - (ln(greatest(p.n, q.n)::DOUBLE) - ln(shared::DOUBLE)) / (ln(474017::DOUBLE) - ln(least(p.n, q.n)::DOUBLE)) AS c FROM sh JOIN size p ON a = p.entity JOIN size q ON b = q.entity)
SELECT a, b, shared, round(c, 6) AS coherence FROM v WHERE c > 0"""
)
def coherence_mw(spark, sf):
    return co.coherence(_inlinks(spark, sf)).withColumn("coherence", F.round("coherence", 6))


_SCORED = f"WITH {PRIOR}, {MENTIONS}, {_CAND}, edge AS (SELECT doc_id, mention AS src, entity AS dst, 0.45 * prior + 0.45 / count(*) OVER (PARTITION BY doc_id, mention) AS weight FROM cand WHERE entity IS NOT NULL)"


def _even(spark, sf):
    """Candidates with one similarity for all."""
    return similarity.normalised(_candidates(spark, sf).where(F.col("entity").isNotNull()).withColumn("similarity", F.lit(1.0)))


@P.query(f"{_SCORED} SELECT doc_id, src, dst, 'mention' AS kind, round(weight, 6) AS weight FROM edge")
def mention_entity_edges(spark, sf):
    return disambiguate.mention_edges(_even(spark, sf)).withColumn("weight", F.round("weight", 6))


@P.query(f"{_SCORED}, n AS (SELECT doc_id, src AS node, false AS is_entity, weight FROM edge UNION ALL SELECT doc_id, dst, true, weight FROM edge) SELECT doc_id, node, is_entity, round(sum(weight), 6) AS degree FROM n GROUP BY ALL")
def weighted_degree(spark, sf):
    return disambiguate.weighted_degree(disambiguate.mention_edges(_even(spark, sf))).withColumn("degree", F.round("degree", 6))


@P.query(f"WITH {PRIOR} SELECT mention, entity, round(n / sum(n) OVER (PARTITION BY mention), 6) AS similarity FROM prior WHERE k <= 5")
def sim_normalize(spark, sf):
    s = _prior(spark, sf).select(F.lit("all").alias("doc_id"), "mention", "entity", F.col("n").cast("double").alias("similarity"))
    return similarity.normalised(s).select("mention", "entity", F.round("similarity", 6).alias("similarity"))


def _keyphrases(spark, sf):
    """Anchors on an entity's own page, and the titles of pages that link to it."""
    anchors = links.anchor_texts(pages(spark, sf)).select("entity", F.col("anchor").alias("keyphrase"))
    titles = _inlinks(spark, sf).select("entity", F.lower("source").alias("keyphrase"))
    none = anchors.where(F.lit(False))
    return links.keyphrases(none, none, anchors, titles)


_KP = f"{LINKS}, {_IN}, kp AS (SELECT lower(title) AS entity, anchor AS keyphrase FROM links UNION SELECT entity, lower(source) FROM inl)"


@P.query(f"WITH {_KP} SELECT entity, keyphrase FROM kp WHERE trim(keyphrase) <> ''")
def keyphrase_union(spark, sf):
    return _keyphrases(spark, sf)


_KW = rf"""{_KP}, ph AS (SELECT entity, keyphrase, list_transform(string_split(keyphrase, ' ')[1:10], lambda w: lower(trim(w, '.,:;<>!?(){{}}[]"''-' || chr(10)))) AS words FROM kp WHERE trim(keyphrase) <> ''),
own AS (SELECT DISTINCT entity, unnest(words) AS word FROM ph), ownw AS (SELECT * FROM own WHERE word <> ''),
ar AS (SELECT entity, source FROM inl UNION SELECT entity, entity FROM ph),
wdf AS (SELECT ar.entity, word, count(DISTINCT source) AS n_entities FROM ar JOIN ownw o ON o.entity = ar.source GROUP BY ALL)"""


@P.query(f"WITH {_KW} SELECT entity, word, n_entities FROM wdf")
def keyphrase_word_df(spark, sf):
    return similarity.word_document_frequency(similarity.keyphrase_words(_keyphrases(spark, sf)), _inlinks(spark, sf))


@P.query(
    f"""WITH {_KW}, kf AS (SELECT word, count(*) AS n_phrases FROM (SELECT entity, keyphrase, unnest(list_distinct(words)) AS word FROM ph) WHERE word <> '' GROUP BY word),
sz AS (SELECT entity, count(DISTINCT source) AS n_in FROM inl GROUP BY entity), tot AS (SELECT count(*) AS n_kp, count(DISTINCT entity) AS n_ent FROM ph),
x AS (SELECT o.entity, o.word, n_entities / (coalesce(n_in, 0) + 1.0::DOUBLE) AS j, log10((n_entities / (coalesce(n_in, 0) + 1.0::DOUBLE)) / ((1.0::DOUBLE / n_ent) * n_phrases / n_kp)) AS pmi FROM ownw o JOIN wdf USING (entity, word) JOIN kf USING (word) LEFT JOIN sz USING (entity), tot)
SELECT entity, word, round(CASE WHEN regexp_matches(word, '^[0-9]+$') THEN 0.0 WHEN j >= 1 THEN pmi ELSE greatest(0.0, pmi / -log10(j)) END, 6) AS weight FROM x"""
)
def npmi_weights(spark, sf):
    return similarity.npmi_weights(similarity.keyphrase_words(_keyphrases(spark, sf)), _inlinks(spark, sf)).withColumn("weight", F.round("weight", 6))


#: Stop words of keyphrases.
STOP = ["i", "og", "af", "den", "det", "en", "et", "for", "fra", "på", "til"]


def _scored(spark, sf):
    phrases = similarity.without_stop_words(similarity.keyphrase_words(_keyphrases(spark, sf)), STOP)
    inlink = _inlinks(spark, sf)
    p = _prior(spark, sf)
    found = prior.genitive_names(prior.genitive_fallback(prior.candidates(mentions(spark, sf), p), p), p)
    # Only the candidates' keyphrases matter.
    wanted = found.where(F.col("entity").isNotNull()).select("entity").distinct()
    own = materialize(phrases.join(wanted, "entity", "left_semi"), "keyphrases")
    weights = similarity.npmi_weights(own, inlink.join(wanted, "entity", "left_semi"))
    sure, rest = prior.short_circuit(found)
    scores = similarity.normalised(similarity.similarity_scores(rest, articles(spark, sf), own, weights, STOP))
    return sure.unionByName(rest.join(scores, ["doc_id", "mention", "entity"]))


@P.query()
def keyphrase_simscore(spark, sf):
    return _scored(spark, sf)


@P.query()
def graph_disambiguate(spark, sf):
    """Every document's mentions resolved together."""
    scored = materialize(_scored(spark, sf), "scored")
    edges = disambiguate.mention_edges(scored).unionByName(disambiguate.entity_edges(scored, _inlinks(spark, sf)))
    return disambiguate.disambiguate(mentions(spark, sf).select("doc_id", "mention"), edges)


@P.query(
    f"""WITH {MENTIONS}, {PRIOR}, g AS (SELECT doc_id, lower(mention) AS key, entity FROM men WHERE entity IS NOT NULL), t AS (SELECT mention, entity FROM prior WHERE k = 1),
p AS (SELECT DISTINCT m.doc_id, lower(m.mention) AS key, t.entity AS found FROM men m JOIN t ON lower(trim(m.mention)) = t.mention), f AS (SELECT doc_id, key, max(found) AS found FROM p GROUP BY ALL)
SELECT count(*) AS n, sum((lower(entity) = lower(found))::INT)::BIGINT AS correct, round(avg((lower(entity) = lower(found))::INT), 6) AS accuracy FROM g JOIN f USING (doc_id, key)"""
)
def ned_accuracy(spark, sf):
    """The most popular entity against the resolved one."""
    m = mentions(spark, sf)
    top = prior.popularity(_uses(spark, sf), 1)
    predicted = m.select("doc_id", "mention", F.lower(F.trim("mention")).alias("k")).join(top.select(F.col("mention").alias("k"), "entity"), "k")
    return evaluate.accuracy(m.where(F.col("entity").isNotNull()), predicted).withColumn("accuracy", F.round("accuracy", 6))


@P.query(
    f"""WITH {MENTIONS}, g AS (SELECT doc_id, lower(mention) AS key, count(*) AS gold, count(*) FILTER (WHERE kb = 'w') AS predicted FROM men GROUP BY ALL)
SELECT sum(least(gold, predicted))::BIGINT AS matched, sum(gold)::BIGINT AS gold, sum(predicted)::BIGINT AS predicted, round(sum(least(gold, predicted)) / sum(predicted), 6) AS precision, round(sum(least(gold, predicted)) / sum(gold), 6) AS recall FROM g"""
)
def ner_precision_recall(spark, sf):
    """Resolved mentions against all recognised ones."""
    m = mentions(spark, sf)
    out = evaluate.recognition(m, m.where(F.col("kb") == "w"))
    return out.select("matched", "gold", "predicted", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@P.query(
    rf"""WITH {ARTS}, {MENTIONS}, w AS (SELECT doc_id, len(regexp_split_to_array(trim(text), '\s+')) AS words FROM arts), p AS (SELECT doc_id, count(*) AS rec, count(entity) AS dis FROM men GROUP BY doc_id),
d AS (SELECT words, coalesce(rec, 0) AS rec, coalesce(dis, 0) AS dis FROM w LEFT JOIN p USING (doc_id))
SELECT count(*) AS docs, sum(rec)::BIGINT AS recognitions, sum(dis)::BIGINT AS resolutions, round(avg(words), 6) AS words_per_doc, round(avg(rec), 6) AS rec_per_doc, round(avg(dis), 6) AS dis_per_doc,
(SELECT count(DISTINCT lower(mention)) FROM men WHERE doc_id IN (SELECT doc_id FROM arts)) AS distinct_mentions, (SELECT count(DISTINCT entity) FROM men WHERE doc_id IN (SELECT doc_id FROM arts)) AS distinct_entities FROM d"""
)
def case_statistics(spark, sf):
    out = evaluate.case_statistics(articles(spark, sf), mentions(spark, sf))
    return out.select("docs", "recognitions", "resolutions", *[F.round(c, 6).alias(c) for c in ("words_per_doc", "rec_per_doc", "dis_per_doc")], "distinct_mentions", "distinct_entities")


@P.query(f"WITH {MENTIONS} SELECT m.doc_id, m.pos, m.mention, f.entity FROM men m LEFT JOIN (SELECT doc_id, key, entity FROM (SELECT doc_id, lower(mention) AS key, entity, row_number() OVER (PARTITION BY doc_id, lower(mention) ORDER BY pos, encode(entity) NULLS FIRST) AS k FROM men) WHERE k = 1) f ON f.doc_id = m.doc_id AND f.key = lower(m.mention)")
def restored_order(spark, sf):
    m = mentions(spark, sf)
    return evaluate.restored_order(m, m)


@P.query(f"WITH {ARTS} SELECT DISTINCT doc_id FROM arts WHERE doc_id NOT IN (SELECT doc_id FROM disambiguations WHERE doc_id IS NOT NULL)")
def incremental_anti_join(spark, sf):
    return readers.not_done(articles(spark, sf).select("doc_id"), table(spark, sf, "disambiguations"))


@P.query(f"WITH {MENTIONS} SELECT mention, count(*) AS n FROM men WHERE entity IS NULL GROUP BY mention")
def undecided_mentions(spark, sf):
    return readers.undecided(mentions(spark, sf)).groupBy("mention").agg(F.count("*").alias("n"))


@P.query(
    f"""WITH {MENTIONS}, d AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, encode(mention)) AS INT) AS pos, mention FROM men),
n AS (SELECT a.doc_id, a.pos, a.mention, b.mention AS near, row_number() OVER (PARTITION BY a.doc_id, a.pos ORDER BY abs(b.pos - a.pos), b.pos) AS k, len(string_split(b.mention, ' ')) AS size FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 10),
s AS (SELECT *, len(string_split(mention, ' ')) + sum(size) OVER (PARTITION BY doc_id, pos ORDER BY k) AS words FROM n), c AS (SELECT doc_id, pos, list(near ORDER BY k) AS context FROM s WHERE words <= 32 AND k <= 10 GROUP BY doc_id, pos)
SELECT doc_id, pos, mention, concat_ws(' ', '"' || mention || '"', array_to_string(list_transform(coalesce(context, []), lambda m: '"' || m || '"'), ' OR '), 'site:example.org/in OR site:example.org/company') AS query FROM d LEFT JOIN c USING (doc_id, pos)"""
)
def neighbor_context(spark, sf):
    """Search strings of mentions with those around them."""
    return web.queries(mentions(spark, sf).select("doc_id", "pos", "mention"), ["example.org/in", "example.org/company"])


@P.query(
    f"""WITH {MENTIONS}, r AS (SELECT mention, page_title, row_number() OVER (PARTITION BY mention ORDER BY count(*) DESC, encode(page_title)) AS rank FROM priors WHERE page_title IS NOT NULL AND trim(mention) <> '' GROUP BY mention, page_title),
t AS (SELECT mention, rank, list_filter(string_split(replace(lower(page_title), ' ', '-'), '-'), lambda w: w <> '') AS w, list_filter(regexp_split_to_array(lower(mention), '[\\s-]+'), lambda w: w <> '') AS p FROM r WHERE rank <= 3),
h AS (SELECT mention, rank, array_to_string(w, '-') AS slug, len(list_filter(p, lambda x: len(list_filter(w, lambda y: x = y OR regexp_replace(x, 's$', '') = regexp_replace(y, 's$', ''))) > 0)) AS matches FROM t),
b AS (SELECT lower(mention) AS key, CASE WHEN matches > 0 OR lower(mention[1]) = slug[1] THEN slug END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY matches DESC, rank) AS k FROM h) WHERE k = 1),
f AS (SELECT key, min(slug) AS slug FROM b WHERE slug IS NOT NULL GROUP BY key)
SELECT doc_id, pos, mention, CASE WHEN entity IS NULL AND slug IS NOT NULL THEN 'l' ELSE kb END AS kb, CASE WHEN entity IS NULL AND slug IS NOT NULL THEN slug ELSE entity END AS entity FROM men LEFT JOIN f ON lower(mention) = key"""
)
def slug_policy(spark, sf):
    """Undecided mentions resolved by search results: the pages on which a mention is used most, as profile addresses."""
    uses = table(spark, sf, "priors").where(F.col("page_title").isNotNull() & (F.trim("mention") != "")).groupBy("mention", "page_title").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("n"), "page_title"))
    url = F.concat(F.lit("https://example.org/in/"), F.replace(F.lower("page_title"), F.lit(" "), F.lit("-")))
    return web.resolved(mentions(spark, sf), uses.select("mention", rank.alias("rank"), url.alias("url")))
