"""Queries over sources and sinks, each written by the one and read by the other, and over the operators between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidende import schemas
from tidende.functions import text
from tidende.io import fresh_path, materialize, table
from tidende.operators import community, conll, corpus, disambiguate, evaluate, links, prior, representation, similarity, summary, timeline, wordnet
from tidende.plans.base import ARTS, BOW, LINKS, MENTIONS, PRIOR, Plans, articles, mentions, pages
from tidende.sources import readers, sinks
from tidende.sources.search import SearchResults
from tidende.streaming import articles as streams

P = Plans()
QUERIES, SQL = P.queries, P.sql


# Articles and pages


@P.query(f"WITH {ARTS} SELECT doc_id, text, pub_date, ext_id FROM arts")
def article_roundtrip(spark, sf):
    """Articles written by day and read again."""
    a = articles(spark, sf)
    path = fresh_path(spark, "articles")
    sinks.write_table(a, path, "pub_date")
    return spark.read.schema(a.schema).parquet(path).select("doc_id", "text", "pub_date", "ext_id")


_PARAS = r"""para AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM arts),
parts AS (SELECT doc_id, l[1] AS hl1, list_transform(list_filter(l[2:], lambda x: len(x) > 1), lambda x: CASE WHEN ends_with(x, '..') THEN x ELSE x || '.' END) AS p FROM para)"""


@P.query(f"WITH {ARTS}, {_PARAS} SELECT doc_id, hl1 AS title, hl1 || ' ' || array_to_string(p, ' ') AS text FROM parts WHERE len(p) > 0")
def news_body(spark, sf):
    """Headline and paragraphs of articles of several lines, put together as news files are."""
    lines = F.split("text", "\n")
    return readers.news_text(articles(spark, sf).select("doc_id", F.get(lines, F.lit(0)).alias("hl1"), F.slice(lines, 2, F.size(lines)).alias("p")))


@P.query(f"WITH {LINKS} SELECT title, anchor, target, count(*) AS n FROM links GROUP BY ALL")
def wiki_dump(spark, sf):
    """Pages written as a dump in XML, read again, and their links."""
    path = fresh_path(spark, "dump")
    pages(spark, sf).select("title", F.struct("text").alias("revision")).write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    return links.article_links(readers.read_wiki_pages(spark, path)).groupBy("title", "anchor", "target").agg(F.count("*").alias("n"))


def _referenced(spark, sf):
    """Pages whose footnotes are the mentions on them, some as templates with a title."""
    p = table(spark, sf, "priors").where(F.col("page_title").isNotNull() & (F.trim("mention") != ""))
    note = F.when(F.col("entity").isNull(), F.concat(F.lit("<ref>{{cite|title="), F.trim("mention"), F.lit("|x}}</ref>"))).otherwise(F.concat(F.lit("<ref>["), F.trim("mention"), F.lit("]</ref>")))
    return p.groupBy(F.col("page_title").alias("title")).agg(F.array_join(F.collect_list(note), " ").alias("text"))


@P.query("SELECT lower(page_title) AS entity, lower(trim(mention)) AS reference, count(*) AS n FROM priors WHERE page_title IS NOT NULL AND trim(mention) <> '' GROUP BY ALL")
def reference_texts(spark, sf):
    return links.reference_texts(_referenced(spark, sf)).groupBy("entity", "reference").agg(F.count("*").alias("n"))


_NS = r"""ns AS (SELECT page_title AS title, CASE WHEN starts_with(entity, 'k') THEN 'kategori:' WHEN starts_with(entity, 'r') THEN 'fil:' WHEN starts_with(entity, 'l') THEN ':' ELSE '' END AS ns, lower(trim(entity)) AS target, lower(trim(mention)) AS anchor
FROM priors WHERE page_title IS NOT NULL AND entity IS NOT NULL AND trim(mention) <> '')"""


def _namespaced(spark, sf):
    """Pages on which some links lead to categories, files and other namespaces."""
    p = table(spark, sf, "priors").where(F.col("page_title").isNotNull() & F.col("entity").isNotNull() & (F.trim("mention") != ""))
    e = F.col("entity")
    ns = F.when(e.startswith("k"), "Kategori:").when(e.startswith("r"), "Fil:").when(e.startswith("l"), ":").otherwise("")
    return p.groupBy(F.col("page_title").alias("title")).agg(F.array_join(F.collect_list(F.concat(F.lit("[["), ns, e, F.lit("|"), F.trim("mention"), F.lit("]]"))), " ").alias("text"))


@P.query(f"WITH {_NS} SELECT title, anchor, target, count(*) AS n FROM ns WHERE ns = '' GROUP BY ALL")
def links_to_articles(spark, sf):
    """Links to other namespaces are left out."""
    return links.article_links(_namespaced(spark, sf)).groupBy("title", "anchor", "target").agg(F.count("*").alias("n"))


@P.query(f"WITH {_NS} SELECT DISTINCT ns || target AS target, title FROM ns WHERE ns <> 'fil:'")
def inlinks_without_files(spark, sf):
    return links.inlinks(_namespaced(spark, sf))


@P.query(f"WITH {_NS} SELECT ns || target AS target, title, count(*) AS n FROM ns WHERE ns <> 'fil:' GROUP BY ALL")
def inlink_counts_without_files(spark, sf):
    return links.inlink_counts(_namespaced(spark, sf))


def _category_rows(spark, sf):
    """A category a page, of the entities that it links to, and maintenance categories besides."""
    p = table(spark, sf, "priors").where(F.col("entity").isNotNull() & F.col("page_title").isNotNull()).select("entity", "page_title").distinct()
    name = F.when(F.col("page_title").startswith("K"), "Kilder_mangler_(samlet_liste)").otherwise(F.replace("page_title", F.lit(" "), F.lit("_")))
    return p.groupBy("page_title").agg(F.first(name).alias("cl_to"), F.array_join(F.array_sort(F.collect_list(F.upper("entity"))), "\n").alias("cl_sortkey")).select("cl_to", "cl_sortkey")


_CATS = "cats AS (SELECT DISTINCT lower(trim(entity)) AS entity, page_title, lower(replace(page_title, '_', ' ')) AS category FROM priors WHERE entity IS NOT NULL AND page_title IS NOT NULL AND NOT starts_with(page_title, 'K'))"


@P.query(f"WITH {_CATS} SELECT entity, category, count(*) AS n FROM cats GROUP BY ALL")
def category_table(spark, sf):
    """The category table read from its copy; maintenance categories are left out."""
    path = fresh_path(spark, "categories")
    _category_rows(spark, sf).write.parquet(path)
    return links.categories(readers.read_categories(spark, path=path)).groupBy("entity", "category").agg(F.count("*").alias("n"))


@P.query(f"WITH {MENTIONS}, {_CATS}, t AS (SELECT DISTINCT entity FROM men WHERE entity IS NOT NULL) SELECT t.entity AS title, category, count(*) AS n FROM t JOIN cats ON lower(t.entity) = cats.entity GROUP BY ALL")
def categories_of_titles(spark, sf):
    titles = mentions(spark, sf).where(F.col("entity").isNotNull()).select(F.col("entity").alias("title")).distinct()
    return links.categories_of(titles, _category_rows(spark, sf)).groupBy("title", "category").agg(F.count("*").alias("n"))


@P.query(f"WITH {LINKS}, inl AS (SELECT DISTINCT entity, page_title AS source FROM priors WHERE entity IS NOT NULL AND page_title IS NOT NULL) SELECT DISTINCT inl.entity, anchor AS keyphrase FROM inl JOIN links ON lower(inl.source) = lower(links.title)")
def foreign_keyphrases(spark, sf):
    """Anchors on the pages that link to an entity."""
    inl = table(spark, sf, "priors").where(F.col("entity").isNotNull() & F.col("page_title").isNotNull()).select("entity", F.lower("page_title").alias("source")).distinct()
    return links.foreign_keyphrases(inl, links.anchor_texts(pages(spark, sf)).withColumnRenamed("anchor", "keyphrase"))


@P.query(f"WITH {MENTIONS}, {LINKS} SELECT DISTINCT mention, target FROM men JOIN links ON lower(trim(mention)) = anchor")
def mention_possibilities(spark, sf):
    return links.possibilities(mentions(spark, sf), pages(spark, sf))


# Recognised names


@P.query(rf"""WITH {MENTIONS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, encode(mention), encode(coalesce(kb, '')), encode(coalesce(entity, ''))) - 1 AS INT) AS pos, replace(mention, '''', ' ') AS mention FROM men""")
def recogniser_files(spark, sf):
    """Mentions written as a recogniser does, some with escaped letters, a line each, and read in the order of the file."""
    m = mentions(spark, sf).select("doc_id", "pos", F.coalesce("kb", F.lit("")).alias("k"), F.coalesce("entity", F.lit("")).alias("e"), F.replace("mention", F.lit("'"), F.lit(" ")).alias("mention"))
    line = F.concat(F.lit("[u'"), F.replace("mention", F.lit("ø"), F.lit("\\xf8")), F.lit("']"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "mention", "k", "e", line.alias("line"))))
    raw = m.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("value"))
    return readers.parse_mentions(raw)


@P.query(f"WITH {MENTIONS} SELECT DISTINCT mention FROM men")
def mention_set(spark, sf):
    return readers.mention_set(mentions(spark, sf))


@P.query(
    f"""WITH {PRIOR}, {MENTIONS}, m AS (SELECT DISTINCT doc_id, mention FROM men UNION SELECT DISTINCT doc_id, mention || 's' FROM men), top AS (SELECT * FROM prior WHERE k <= 5),
extra AS (SELECT mention || 's' AS mention, entity, prior FROM top WHERE entity = mention UNION ALL SELECT mention, entity, prior FROM top),
c AS (SELECT m.doc_id, m.mention, e.entity, e.prior, lower(trim(m.mention))[:-2] AS stem FROM m LEFT JOIN extra e ON lower(trim(m.mention)) = e.mention),
f AS (SELECT *, min(CASE WHEN prior > 0.8 THEN prior END) OVER w AS sure, max(CASE WHEN entity = stem AND ends_with(lower(mention), 's') THEN prior END) OVER w AS same FROM c WINDOW w AS (PARTITION BY doc_id, mention)),
g AS (SELECT *, coalesce(same IS NOT NULL AND (sure IS NULL OR same <= sure), false) AS swap FROM f),
o AS (SELECT DISTINCT g.doc_id, g.mention, e.entity, e.prior FROM g JOIN extra e ON g.stem = e.mention WHERE swap)
SELECT doc_id, mention, entity, round(prior, 6) AS prior FROM g WHERE (doc_id, mention) NOT IN (SELECT (doc_id, mention) FROM o) UNION ALL SELECT doc_id, mention, entity, round(prior, 6) FROM o"""
)
def genitive_names(spark, sf):
    """Names in the genitive that the dictionary has with their s take the candidates of the name."""
    p = prior.popularity(table(spark, sf, "priors").select("mention", "entity")).select("mention", "entity", "prior")
    known = p.where(F.col("entity") == F.col("mention")).withColumn("mention", F.concat("mention", F.lit("s"))).unionByName(p)
    m = mentions(spark, sf).select("doc_id", "mention")
    found = prior.candidates(m.unionByName(m.withColumn("mention", F.concat("mention", F.lit("s")))), known)
    return prior.genitive_names(found, known).withColumn("prior", F.round("prior", 6))


@P.query(
    rf"""WITH {LINKS}, kp AS (SELECT DISTINCT lower(title) AS entity, anchor AS keyphrase FROM links),
w AS (SELECT entity, keyphrase, list_transform(string_split(keyphrase, ' ')[1:10], lambda w: lower(trim(w, '.,:;<>!?(){{}}[]"''-' || chr(10)))) AS words FROM kp)
SELECT entity, keyphrase, list_filter(words, lambda w, i: i = 1 OR w NOT IN ('i', 'og', 'gymnasium', 'hald', 'munk')) AS words FROM w"""
)
def keyphrases_without_stop_words(spark, sf):
    kp = links.anchor_texts(pages(spark, sf)).select("entity", F.col("anchor").alias("keyphrase")).distinct()
    return similarity.without_stop_words(similarity.keyphrase_words(kp), ["i", "og", "gymnasium", "hald", "munk"])


@P.query(
    f"""WITH {MENTIONS}, g AS (SELECT doc_id, lower(mention) AS key, count(*) AS gold, count(*) FILTER (WHERE kb = 'w') AS predicted FROM men WHERE entity IS NULL OR NOT starts_with(entity, 'r') GROUP BY ALL)
SELECT sum(len(string_split(key, ' ')) * least(gold, predicted))::BIGINT AS matched_words, sum(len(string_split(key, ' ')) * gold)::BIGINT AS gold_words, sum(len(string_split(key, ' ')) * predicted)::BIGINT AS predicted_words FROM g"""
)
def recognition_by_words(spark, sf):
    """Partial matches where none is but whole; gold entities of a bad prefix are left out."""
    gold = evaluate.without_prefixes(mentions(spark, sf), ["r"])
    out = evaluate.partial_sums(gold, gold.where(F.col("kb") == "w"))
    return out.select("matched_words", "gold_words", "predicted_words")


@P.query(rf"""WITH {MENTIONS}, t AS (SELECT doc_id, '*r' || lower(mention) || CASE WHEN pos % 2 = 0 THEN '*r' || lower(coalesce(entity, mention)) ELSE '' END AS term FROM men)
SELECT doc_id, term, regexp_extract(term, '^(\*r.*?)(?:\*r|$)', 1) AS name FROM t""")
def first_of_concatenated(spark, sf):
    m = mentions(spark, sf)
    term = F.concat(F.lit("*r"), F.lower("mention"), F.when(F.col("pos") % 2 == 0, F.concat(F.lit("*r"), F.lower(F.coalesce("entity", "mention")))).otherwise(""))
    return m.select("doc_id", term.alias("term")).withColumn("name", text.first_of_concatenated(F.col("term")))


@P.query(f"WITH {MENTIONS}, l AS (SELECT doc_id, list(DISTINCT mention) AS names, list(DISTINCT mention) FILTER (WHERE entity IS NOT NULL) AS known FROM men GROUP BY doc_id) SELECT doc_id, len(list_filter(names, lambda x: NOT list_contains(coalesce(known, []), x))) = 0 AS complete FROM l")
def complete_documents(spark, sf):
    """Documents all of whose names were resolved."""
    known = F.collect_set(F.when(F.col("entity").isNotNull(), F.col("mention")))
    return mentions(spark, sf).groupBy("doc_id").agg(F.collect_set("mention").alias("names"), known.alias("known")).select("doc_id", text.holds_all(F.col("names"), F.col("known")).alias("complete"))


@P.query(f"WITH {MENTIONS} SELECT mention, list_sort(list(DISTINCT doc_id), 'ASC', 'NULLS LAST') AS doc_id FROM men GROUP BY mention")
def documents_of_mentions(spark, sf):
    """The table of documents and mentions turned round."""
    return representation.reversed_table(mentions(spark, sf), "doc_id", "mention")


@P.query("SELECT DISTINCT mention, CAST(1 AS INT) AS rank, 'https://example.org/in/' || replace(lower(page_title), ' ', '-') AS url FROM priors WHERE mention IS NOT NULL AND page_title IS NOT NULL")
def search_results(spark, sf):
    """Search results that lie in a folder, through the data source."""
    rows = table(spark, sf, "priors").where(F.col("mention").isNotNull() & F.col("page_title").isNotNull())
    url = F.concat(F.lit("https://example.org/in/"), F.replace(F.lower("page_title"), F.lit(" "), F.lit("-")))
    path = fresh_path(spark, "search")
    rows.select("mention", F.lit(1).alias("rank"), url.alias("url")).distinct().write.json(path)
    spark.dataSource.register(SearchResults)
    return spark.read.format("search_results").option("path", path).load()


# Lists, lines and columns


@P.query(f"WITH {ARTS}, {BOW} SELECT token AS term, sum(tf)::BIGINT AS freq FROM bow GROUP BY token")
def term_list(spark, sf):
    """A frequency list written as lines and read again."""
    bow = representation.bag_of_words(articles(spark, sf)).groupBy("token").agg(F.sum("tf").alias("n"))
    path = fresh_path(spark, "terms")
    bow.select(F.concat_ws(" ", "token", F.col("n").cast("string")).alias("value")).write.text(path)
    return readers.read_terms(spark, path)


@P.query("SELECT DISTINCT trim(abbr) AS abbr FROM abbreviations WHERE trim(abbr) <> ''")
def abbreviation_list(spark, sf):
    path = fresh_path(spark, "abbreviations")
    table(spark, sf, "abbreviations").select(F.concat(F.lit(" "), F.coalesce("abbr", F.lit(""))).alias("value")).write.text(path)
    return readers.read_abbreviations(spark, path)


@P.query("SELECT DISTINCT lower(trim(label)) AS name FROM language_names WHERE trim(label) <> ''")
def language_list(spark, sf):
    path = fresh_path(spark, "languages")
    table(spark, sf, "language_names").select(F.concat(F.lit("‎"), "label").alias("value")).write.text(path)
    return readers.read_languages(spark, path)


@P.query(f"WITH {ARTS}, {BOW}, f AS (SELECT doc_id, token, CASE WHEN tf = 1 THEN 0 ELSE (tf - 1) / 1000.0 END AS w FROM bow) SELECT doc_id AS cluster_id, token AS term, CASE WHEN w = 0 THEN 0.002 ELSE greatest(w, 0.001) END::DOUBLE AS weight FROM f")
def community_lines(spark, sf):
    """Weights written as lines of communities and read again; none is twice the floor."""
    bow = representation.bag_of_words(articles(spark, sf))
    cell = F.concat_ws(",", "token", F.when(F.col("tf") == 1, "0").otherwise(((F.col("tf") - 1) / 1000).cast("string")))
    return readers.parse_communities(bow.groupBy(F.col("doc_id").alias("cluster_id")).agg(F.array_join(F.collect_list(cell), "\t").alias("line")))


@P.query(rf"WITH {ARTS}, l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM arts), t AS (SELECT unnest(regexp_split_to_array(lower(replace(line, chr(13), ' ')), '[ \t\n\x0B\f\r]+')) AS token FROM l) SELECT token, count(*) AS n FROM t WHERE token <> '' GROUP BY token")
def line_corpus(spark, sf):
    """Every line of the articles as a document of its own."""
    path = fresh_path(spark, "lines")
    articles(spark, sf).select(F.explode(F.split(F.replace("text", F.lit("\r"), F.lit(" ")), "\n")).alias("value")).write.text(path)
    return readers.read_line_corpus(spark, path).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@P.query(f"WITH {ARTS} SELECT doc_id, 'body' AS field, text FROM arts UNION ALL SELECT doc_id, 'ids', ext_id || chr(10) || doc_id FROM arts")
def json_documents(spark, sf):
    """Documents as JSON lines, one field a text and one a list of texts."""
    path = fresh_path(spark, "json")
    articles(spark, sf).select(F.to_json(F.struct(F.col("doc_id").alias("_id"), F.col("text").alias("body"), F.array("ext_id", "doc_id").alias("ids"))).alias("value")).write.text(path)
    return readers.read_json_documents(spark, path, "_id", ["body", "ids"])


_TOK = "tok AS (SELECT p_partkey AS sentence_id, i AS tok, len(w) AS n, w[i] AS form, p_brand AS cpos, p_type AS box FROM (SELECT p_partkey, p_brand, p_type, string_split(p_name, ' ') AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part))"


def _tokens(spark, sf):
    """Words of part names as tokens, each hanging on the one before."""
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("sentence_id"), "p_brand", "p_type", F.posexplode(F.split("p_name", " ")).alias("k", "form"))
    k = (F.col("k") + 1).cast("int")
    feats = F.concat(F.lit("box="), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("|no="), k.cast("string"))
    return t.select("sentence_id", k.alias("tok"), k.cast("string").alias("index"), "form", F.lower("form").alias("lemma"), F.col("p_brand").alias("cpos"), F.col("p_brand").alias("pos"), feats.alias("feats"), (k - 1).cast("string").alias("head"), F.when(k == 1, "root").otherwise("x").alias("label"), F.lit("_").alias("phead"), F.lit("_").alias("plabel"))


def _blocks(tokens, line):
    listed = F.array_sort(F.collect_list(F.struct("tok", line.alias("line"))))
    return tokens.groupBy("sentence_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("value")).select("value")


@P.query(f"WITH {_TOK} SELECT tok::VARCHAR AS id, form, lower(form) AS lemma, cpos AS pos, 'pos=' || cpos AS feat, (tok - 1)::VARCHAR AS head, CASE WHEN tok = 1 THEN 'root' ELSE 'x' END AS deprel, count(*) AS n FROM tok GROUP BY ALL")
def conll09_file(spark, sf):
    """Tokens written in the columns of the newer format and read again."""
    path = fresh_path(spark, "conll09")
    lines = sinks.conll09_lines(_tokens(spark, sf))
    _blocks(lines, F.col("line")).write.option("lineSep", "\n\n").text(path)
    return readers.read_conll(spark, path, schemas.CONLL09).groupBy("id", "form", "lemma", "pos", "feat", "head", "deprel").agg(F.count("*").alias("n"))


@P.query(f"WITH {_TOK} SELECT tok::VARCHAR AS index, form, replace(box, ' ', '_') AS box, count(*) AS n FROM tok GROUP BY ALL")
def conll06_file(spark, sf):
    """The older format, with the attributes of each token as a map."""
    path = fresh_path(spark, "conll06")
    t = _tokens(spark, sf)
    _blocks(t, F.concat_ws("\t", *schemas.CONLL06)).write.option("lineSep", "\n\n").text(path)
    rows = readers.read_conll(spark, path, schemas.CONLL06)
    return rows.select("index", "form", readers.feature_map(F.col("feats"))["box"].alias("box")).groupBy("index", "form", "box").agg(F.count("*").alias("n"))


@P.query(
    f"""WITH {_TOK} SELECT sentence_id, string_agg(form, ' ' ORDER BY tok) AS forms, string_agg(lower(form), ' ' ORDER BY tok) AS lemmas, string_agg(cpos, ' ' ORDER BY tok) AS tags, string_agg('box-no', ' ') AS features,
arg_min(form, tok) AS head_word, CASE WHEN any_value(n) > 2 THEN arg_max(form, tok) FILTER (WHERE tok = 2) END AS head_of_third, CASE WHEN any_value(n) > 1 THEN 1 ELSE 0 END AS children_of_first,
array_to_string(list_reverse(range(1, any_value(n))), ' ') AS path, count(*) + 1 AS longer, string_agg(concat_ws(chr(9), tok, form, cpos, tok - 1, CASE WHEN tok = 1 THEN 'root' ELSE 'x' END), chr(10) ORDER BY tok) AS text FROM tok GROUP BY sentence_id"""
)
def tree_functions(spark, sf):
    t = conll.trees(_tokens(spark, sf))
    tree, last = F.col("tree"), F.size("tree")
    joined = lambda c: F.array_join(c, " ")
    return t.select(
        "sentence_id", joined(conll.column(tree, "form")).alias("forms"), joined(conll.column(tree, "lemma")).alias("lemmas"), joined(conll.column(tree, "pos")).alias("tags"), joined(conll.features(tree)).alias("features"),
        conll.head_word(tree)["form"].alias("head_word"), conll.head_of(tree, 3)["form"].alias("head_of_third"), F.size(conll.children(tree, 1)).alias("children_of_first"),
        joined(conll.root_path(tree, last).cast("array<string>")).alias("path"), F.size(conll.with_token(tree, F.get(tree, F.lit(0)))).alias("longer"), conll.rendered(tree).alias("text"),
    )


def _by_ending(batch: pd.DataFrame) -> pd.DataFrame:
    """A tagger of the simplest kind: forms in e are adjectives."""
    rows = [(s, t["index"], "ADJ" if t["form"].endswith("e") else "NOUN") for s, tree in zip(batch["sentence_id"], batch["tree"], strict=True) for t in tree]
    return pd.DataFrame(rows, columns=["sentence_id", "index", "tag"])


@P.query(f"WITH {_TOK} SELECT sentence_id, tok::INT AS index, CASE WHEN ends_with(form, 'e') THEN 'ADJ' ELSE 'NOUN' END AS tag FROM tok")
def tagged_by_hook(spark, sf):
    return conll.tagged_by(_tokens(spark, sf), _by_ending, "sentence_id long, index int, tag string")


@P.query(f"WITH {_TOK}, t AS (SELECT lower(form) AS token, list_sort(list(DISTINCT cpos)) AS tags FROM tok GROUP BY 1) SELECT token, array_to_string(tags, ' ') AS tags, '<entry tags=\"' || array_to_string(tags, ' ') || '\"><token>' || token || '</token></entry>' AS line FROM t")
def tag_dictionary(spark, sf):
    return sinks.tag_dictionary(_tokens(spark, sf).select("form", F.col("cpos").alias("tag")))


@P.query(f"WITH {_TOK} SELECT DISTINCT form, CASE right(cpos, 1) WHEN '1' THEN 'NOUN' ELSE 'VERB' END AS tag FROM tok WHERE right(cpos, 1) IN ('1', '2')")
def ambiguous_forms(spark, sf):
    """Universal tags that a form can have; other tags are left out."""
    lexicon = _tokens(spark, sf).select("form", F.col("cpos").alias("tag"))
    tags = lexicon.select("tag").distinct().withColumn("universal", F.when(F.substring("tag", -1, 1) == "1", "NOUN").when(F.substring("tag", -1, 1) == "2", "VERB").otherwise("."))
    return conll.ambiguity(lexicon, tags)


@P.query(
    f"""WITH {_TOK}, k AS (SELECT p_partkey AS sentence_id, p_size % 3 AS kind FROM part), d AS (SELECT tok.*, kind, (kind < 2 AND n > 1) AS swaps FROM tok JOIN k USING (sentence_id))
SELECT sentence_id, tok::INT AS index, form, CASE WHEN tok = 1 THEN CASE WHEN swaps THEN 2 ELSE 0 END WHEN tok = 2 THEN CASE WHEN swaps THEN 0 ELSE 1 END ELSE CASE WHEN swaps THEN 2 ELSE 1 END END::INT AS head,
CASE WHEN tok = 1 THEN 'root' WHEN tok = 2 AND swaps THEN 'root' ELSE 'x' END AS label FROM d"""
)
def determiners_switched(spark, sf):
    """The second word is a noun that hangs on the first, a determiner, an adjective that heads nouns, or neither; the others hang on the first."""
    t = _tokens(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("sentence_id"), (F.col("p_size") % 3).alias("kind")), "sentence_id")
    first = F.col("tok") == 1
    pos = F.when(first, F.when(F.col("kind") == 0, "PD").when(F.col("kind") == 1, "AN").otherwise("VA")).when(F.col("tok") == 2, "NC").otherwise("AN")
    lemma = F.when(first & (F.col("kind") == 1), "Hel").otherwise(F.col("lemma"))
    return conll.switched(conll.trees(t.drop("feats").withColumn("pos", pos).withColumn("lemma", lemma).withColumn("head", F.when(first, "0").otherwise("1"))))


@P.query(f"WITH {ARTS}, {BOW} SELECT doc_id, token, tf, true AS same FROM bow")
def stamped_table(spark, sf):
    """A dictionary written and read again with its stamp: equal content, equal stamp."""
    bow = representation.bag_of_words(articles(spark, sf))
    path = fresh_path(spark, "stamped")
    sinks.write_table(bow, path)
    back = spark.read.schema(bow.schema).parquet(path)
    one, two = sinks.fingerprint(bow).withColumnRenamed("stamp", "other"), sinks.fingerprint(back)
    return back.join(F.broadcast(one.join(two, "rows").select((F.col("stamp") == F.col("other")).alias("same"))))


@P.query("SELECT id, label, id || chr(9) || label AS line FROM (SELECT n_nationkey AS id, n_name AS label FROM nation WHERE n_nationkey < 20 UNION ALL SELECT 100 + r_regionkey, r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 20))")
def node_labels(spark, sf):
    """Names of the nodes of a graph; nodes without an edge have no line."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    edges = n.where("n_nationkey < 20").select(F.col("n_nationkey").alias("src"), (F.col("n_regionkey") + 100).alias("dst"))
    return sinks.node_labels(edges, n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")).unionByName(r.select((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("label"))))


@P.query("WITH t AS (SELECT o_orderkey AS doc_id, lower(n_name) AS term, lower(r_name) AS rank FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' AND NOT contains(r_name, ' ')) SELECT doc_id, rank || chr(9) || '[' || string_agg(DISTINCT term, ', ' ORDER BY term) || ']' AS line FROM t GROUP BY doc_id, rank")
def ranked_lines(spark, sf):
    """Nations of an order under their region; one region's word is banned."""
    n, r, c, o = (table(spark, sf, x) for x in ("nation", "region", "customer", "orders"))
    words = n.select(F.col("n_nationkey").cast("bigint").alias("id"), F.lower("n_name").alias("form")).unionByName(r.select((F.col("r_regionkey") + 100).cast("bigint").alias("id"), F.when(F.col("r_name") == "ASIA", "menneske").otherwise(F.lower("r_name")).alias("form")))
    senses = n.select(F.col("n_nationkey").cast("bigint").alias("word_id"), F.col("n_regionkey").cast("bigint").alias("synset_id")).unionByName(r.select((F.col("r_regionkey") + 100).cast("bigint").alias("word_id"), (F.col("r_regionkey") + 100).cast("bigint").alias("synset_id")))
    relations = r.select(F.col("r_regionkey").cast("bigint").alias("synsets_id"), F.lit("has_hyperonym").alias("name2"), (F.col("r_regionkey") + 100).cast("bigint").alias("value"))
    hyper = wordnet.hypernyms(words, senses, relations, r.select((F.col("r_regionkey") + 100).cast("bigint").alias("id"), F.col("r_name").alias("label")))
    t = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_orderkey").alias("doc_id"), F.lower("n_name").alias("term"))
    return sinks.ranked_lines(wordnet.ranked(t, hyper))


_SENT = rf"""soft AS (SELECT doc_id, replace(replace(replace(text, 'tidl.', 'tidl․'), 'f.eks.', 'f․eks․'), 'fx.', 'fx․') AS t FROM arts),
spaced AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '([.!?/])', '\1 ', 'g'), ' +([.!?/])', '\1', 'g')) AS t FROM soft),
cut AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?]) +', '\1' || chr(30), 'g'), chr(30)) AS s FROM spaced),
sent AS (SELECT doc_id, i - 1 AS sent_no, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM cut) WHERE trim(s[i]) <> '')"""
_KEPT = rf"""{_SENT}, kept AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent_no) - 1 AS sent_no, sentence FROM (SELECT *, regexp_split_to_array(trim(sentence), '[ \t\n\x0B\f\r]+') AS w FROM (SELECT doc_id, i - 1 AS sent_no, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM cut)))
WHERE sent_no = 0 OR (len(sentence) > 1 AND contains(sentence, ' ') AND NOT contains(sentence, chr(10)) AND NOT (len(w) = 2 AND NOT regexp_matches(w[1], '^\p{{L}}+$')))), cand AS (SELECT * FROM kept WHERE trim(sentence) <> '')"""


@P.query(f"WITH {ARTS}, {_KEPT} SELECT doc_id, sent_no, sentence FROM cand")
def sentence_candidates(spark, sf):
    return summary.sentences_of(articles(spark, sf)).select("doc_id", "sent_no", "sentence")


@P.query(rf"WITH {ARTS}, {_KEPT} SELECT doc_id, sent_no, list_transform(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+'), lambda w: CASE WHEN ends_with(w, 'erne') THEN w[:-5] ELSE w END) AS lemmas FROM cand WHERE len(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+')) > 0")
def lemmatized_sentences(spark, sf):
    """Words by a table of lemmas, here of those in -erne; others stay."""
    s = summary.sentences_of(articles(spark, sf))
    forms = s.select(F.explode("lemmas").alias("form")).distinct().where(F.col("form").endswith("erne"))
    return summary.lemmatized(s, forms.withColumn("lemma", F.expr("substring(form, 1, length(form) - 4)"))).select("doc_id", "sent_no", "lemmas")


@P.query(
    rf"""WITH {ARTS}, {_KEPT}, w AS (SELECT doc_id, sent_no, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+')) AS t FROM cand), c AS (SELECT doc_id, sent_no, t, count(*)::DOUBLE AS n FROM w GROUP BY ALL), z AS (SELECT doc_id, sent_no, sqrt(sum(n * n)) AS z FROM c GROUP BY ALL),
p AS (SELECT a.doc_id, a.sent_no AS lo, b.sent_no AS hi, sum(a.n * b.n) AS d FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.t = b.t AND a.sent_no < b.sent_no GROUP BY ALL),
gone AS (SELECT DISTINCT p.doc_id, p.hi FROM p JOIN z x ON x.doc_id = p.doc_id AND x.sent_no = lo JOIN z y ON y.doc_id = p.doc_id AND y.sent_no = hi WHERE d / (x.z * y.z) > 0.8)
SELECT doc_id, sent_no, sentence FROM cand WHERE (doc_id, sent_no) NOT IN (SELECT (doc_id, hi) FROM gone)"""
)
def sentences_apart(spark, sf):
    """Sentences of a document without those that share most words with one before."""
    s = summary.sentences_of(articles(spark, sf)).select("doc_id", "sent_no", "sentence", F.lit(1.0).alias("score"))
    return corpus.distinct_sentences(s).select("doc_id", "sent_no", "sentence")


@P.query(f"WITH {ARTS}, {_SENT} SELECT doc_id, 'body' AS field, list(sentence ORDER BY sent_no) AS sentences FROM sent GROUP BY doc_id")
def parsed_json(spark, sf):
    """Sentences grouped back to documents as JSON, and read again."""
    rows = corpus.sentence_rows(articles(spark, sf)).withColumn("field", F.lit("body"))
    return sinks.parsed_documents(rows).select("doc_id", "field", F.from_json("parsed", "array<string>").alias("sentences"))


# Months as clusters: what communities are put through, with clusters that SQL can give as well

_CLU = rf"""{ARTS}, {MENTIONS}, sl AS (SELECT doc_id, pub_date, CAST((dense_rank() OVER (ORDER BY date_trunc('month', pub_date)) - 1) AS INT) AS slice FROM arts),
et AS (SELECT DISTINCT slice, doc_id, lower(trim(mention)) AS term FROM men JOIN sl USING (doc_id)),
kinds AS (SELECT lower(trim(mention)) AS term, max(CASE WHEN kb = 'w' AND entity IS NOT NULL THEN 'w' ELSE 'r' END) AS kind FROM men GROUP BY 1),
clu AS (SELECT slice AS cluster_id, slice, kind, term, count(*)::DOUBLE AS weight FROM et JOIN kinds USING (term) GROUP BY ALL)"""
_SCORE = rf"""{_KEPT}, occ AS (SELECT '*w.' || lower(entity) AS term, count(*) AS n FROM men WHERE kb = 'w' AND entity IS NOT NULL AND doc_id IN (SELECT doc_id FROM arts) GROUP BY 1),
forms AS (SELECT DISTINCT lower(entity) AS e, lower(trim(mention)) AS form FROM men WHERE kb = 'w' AND entity IS NOT NULL),
ask AS (SELECT cluster_id, slice, coalesce(form, term) AS form, weight * least(20.0 * coalesce(1.0 / n, 0.05), 3.0) AS value, true AS each FROM (SELECT clu.*, forms.form, n FROM clu LEFT JOIN forms ON term = e LEFT JOIN occ ON occ.term = '*w.' || clu.term WHERE kind = 'w')
  UNION ALL SELECT cluster_id, slice, term, weight, false FROM clu WHERE kind <> 'w'),
q AS (SELECT cluster_id, slice, form, each, max(value) AS value FROM ask GROUP BY ALL), qw AS (SELECT cluster_id, slice, each, value, regexp_extract_all(form, '[\p{{L}}\p{{N}}_]+') AS g FROM q),
cw AS (SELECT doc_id, sent_no, slice, regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+') AS w FROM cand JOIN sl USING (doc_id)), cpos AS (SELECT doc_id, sent_no, slice, w, unnest(range(1, len(w) + 1)) AS i FROM cw),
hit AS (SELECT cluster_id, doc_id, sent_no, g, each, value, count(*) AS hits FROM cpos JOIN qw ON cpos.slice = qw.slice AND cpos.w[i] = g[1] AND w[i:i + len(g) - 1] = g GROUP BY cluster_id, doc_id, sent_no, g, each, value),
scored AS (SELECT cluster_id, doc_id, sent_no, sum(value * CASE WHEN each THEN hits ELSE 1 END) AS score FROM hit GROUP BY ALL)"""


def _months(spark, sf):
    a = materialize(articles(spark, sf), "articles")
    m = mentions(spark, sf)
    sliced = corpus.slices(a)
    terms = m.select("doc_id", F.lower(F.trim("mention")).alias("term")).distinct().join(sliced.select("doc_id", F.col("slice").cast("int").alias("slice")), "doc_id")
    kinds = representation.entity_tags(m).groupBy(F.lower("term").alias("term")).agg(F.max("kind").alias("kind"))
    counted = terms.groupBy("slice", "term").agg(F.count("*").cast("double").alias("weight")).join(kinds, "term")
    clusters = materialize(counted.select(F.col("slice").alias("cluster_id"), "slice", "kind", "term", "weight", F.lit(None).cast("string").alias("headline")), "months")
    return a, m, sliced, clusters


def _month_scores(spark, sf):
    a, m, sliced, clusters = _months(spark, sf)
    sentences = materialize(summary.sentences_of(a), "sentences")
    rarity = summary.entity_rarity(representation.inverted_entities(m), a)
    return a, clusters, sentences, materialize(summary.sentence_scores(clusters, sliced, sentences, rarity, representation.surface_forms(m)), "scores")


@P.query(f"WITH {_CLU}, {_SCORE} SELECT cluster_id, doc_id, sent_no, round(score, 6) AS score FROM scored")
def sentence_score_months(spark, sf):
    """Every sentence of a month by the names of the month."""
    return _month_scores(spark, sf)[3].withColumn("score", F.round("score", 6))


_SUMMARY = rf"""{_SCORE}, s0 AS (SELECT cluster_id, scored.doc_id, scored.sent_no, score, sentence, pub_date, CASE WHEN regexp_replace(sentence, '[^A-Za-z]+', '', 'g') <> '' THEN regexp_replace(sentence, '[^A-Za-z]+', '', 'g') ELSE sentence END AS key FROM scored JOIN cand USING (doc_id, sent_no) JOIN arts USING (doc_id)),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, key ORDER BY score DESC, sent_no, encode(doc_id) DESC, encode(sentence) DESC) AS k FROM s0) WHERE k = 1),
ow AS (SELECT cluster_id, doc_id, sent_no, score, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+')) AS t FROM once), oc AS (SELECT cluster_id, doc_id, sent_no, score, t, count(*)::DOUBLE AS n FROM ow GROUP BY ALL), oz AS (SELECT cluster_id, doc_id, sent_no, sqrt(sum(n * n)) AS z FROM oc GROUP BY ALL),
od AS (SELECT a.cluster_id, a.doc_id, a.sent_no, b.sent_no AS o, sum(a.n * b.n) AS d FROM oc a JOIN oc b ON a.cluster_id = b.cluster_id AND a.doc_id = b.doc_id AND a.t = b.t AND (b.score > a.score OR (b.score = a.score AND b.sent_no < a.sent_no)) GROUP BY ALL),
gone AS (SELECT DISTINCT od.cluster_id, od.doc_id, od.sent_no FROM od JOIN oz x ON x.cluster_id = od.cluster_id AND x.doc_id = od.doc_id AND x.sent_no = od.sent_no JOIN oz y ON y.cluster_id = od.cluster_id AND y.doc_id = od.doc_id AND y.sent_no = o WHERE d / (x.z * y.z) > 0.8),
apart AS (SELECT * FROM once WHERE (cluster_id, doc_id, sent_no) NOT IN (SELECT (cluster_id, doc_id, sent_no) FROM gone)),
days AS (SELECT cluster_id, pub_date, sum(score) AS s FROM apart GROUP BY ALL), win AS (SELECT cluster_id, pub_date AS winner FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(s, 9) DESC, pub_date) AS k FROM days) WHERE k = 1),
dec AS (SELECT apart.* EXCLUDE (score), score * pow(0.95, abs(date_diff('day', winner, pub_date))) AS score FROM apart JOIN win USING (cluster_id)),
top AS (SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, encode(doc_id), sent_no) AS rank, score, sentence, doc_id, pub_date FROM dec), good AS (SELECT *, sum(score) OVER (PARTITION BY cluster_id) AS total FROM top WHERE rank <= 3 AND score >= 1.0),
found AS (SELECT cluster_id, rank, score, sentence, doc_id, pub_date FROM good WHERE total >= 3.0)"""


def _month_summaries(spark, sf):
    a, clusters, sentences, scores = _month_scores(spark, sf)
    return clusters, materialize(summary.summaries(scores, sentences, a, total=3.0), "summaries")


@P.query(f"WITH {_CLU}, {_SUMMARY} SELECT cluster_id, rank, round(score, 6) AS score, sentence, doc_id, CAST(pub_date AS DATE) AS pub_date FROM found")
def summary_months(spark, sf):
    """The three best sentences of each month."""
    return _month_summaries(spark, sf)[1].withColumn("score", F.round("score", 6))


@P.query(f"WITH {_CLU}, {_SUMMARY} SELECT cluster_id, CAST(min(pub_date) FILTER (WHERE rank <= 5) AS DATE) AS early, CAST(min(pub_date) FILTER (WHERE rank = 1) AS DATE) AS best FROM found GROUP BY cluster_id")
def dates_of_months(spark, sf):
    """The earliest day of a cluster's first sentences, and that of its best."""
    found = _month_summaries(spark, sf)[1]
    return timeline.early_dates(found).withColumnRenamed("station_date", "early").join(timeline.cluster_dates(found).withColumnRenamed("station_date", "best"), "cluster_id")


@P.query(
    rf"""WITH {_CLU}, {_SUMMARY}, e AS (SELECT cluster_id, term AS entity, ' ' || array_to_string(regexp_extract_all(term, '[\p{{L}}\p{{N}}_]+'), ' ') || ' ' AS g FROM clu),
f AS (SELECT cluster_id, score, ' ' || array_to_string(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+'), ' ') || ' ' AS said FROM found)
SELECT cluster_id, entity, round(sum(CASE WHEN contains(said, g) THEN score ELSE 0.0 END), 6) AS score FROM e LEFT JOIN f USING (cluster_id) GROUP BY ALL"""
)
def entity_scores_months(spark, sf):
    clusters, found = _month_summaries(spark, sf)
    placed = clusters.select("cluster_id", F.col("term").alias("entity"))
    return timeline.entity_scores(placed, found).withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6))


@P.query(
    rf"""WITH {_CLU}, b AS (SELECT cluster_id, unnest(regexp_extract_all(term, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_]+')) AS token FROM clu), bow AS (SELECT cluster_id, token, count(*) AS tf FROM b GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM bow GROUP BY token), n AS (SELECT count(DISTINCT cluster_id) AS n FROM clu),
w AS (SELECT cluster_id, token, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0) AS w FROM bow JOIN df USING (token), n) SELECT cluster_id, token AS term, round(w / sqrt(sum(w * w) OVER (PARTITION BY cluster_id)), 6) AS weight FROM w"""
)
def cluster_vectors(spark, sf):
    """Months as strings of their names, weighted word by word."""
    return timeline.cluster_vectors(_months(spark, sf)[3]).withColumn("weight", F.round("weight", 6))


@P.query(
    rf"""WITH {_CLU}, p AS (SELECT term AS entity, slice AS cluster_id FROM clu), l AS (SELECT entity, cluster_id FROM p WHERE entity IN (SELECT entity FROM p GROUP BY entity HAVING count(*) > 1)) SELECT entity, cluster_id FROM l"""
)
def lines_of_several(spark, sf):
    """Names of one month only have no line."""
    placed = _months(spark, sf)[3].select(F.col("term").alias("entity"), "cluster_id")
    return timeline.without_single(placed)


@P.query(
    rf"""WITH {_CLU}, s AS (SELECT cluster_id, min(CAST(date_trunc('month', pub_date) AS DATE)) AS station_date, list(DISTINCT term) AS e FROM clu JOIN sl ON sl.slice = clu.slice GROUP BY cluster_id), k AS (SELECT *, row_number() OVER (ORDER BY station_date, cluster_id) AS k, list_sort(e) AS names FROM s),
f AS (SELECT 0 AS k, [count(*)::VARCHAR] AS lines FROM s UNION ALL SELECT k, list_concat(['2', 'clusternr: ' || cluster_id || '*', '1: et', '2: to', strftime(station_date, '%Y'), strftime(station_date, '%m'), strftime(station_date, '%d'), len(names)::VARCHAR], names) FROM k),
r AS (SELECT k, i, lines[i] AS line FROM (SELECT k, lines, unnest(range(1, len(lines) + 1)) AS i FROM f)) SELECT CAST(row_number() OVER (ORDER BY k, i) - 1 AS INT) AS line_no, line FROM r"""
)
def map_text(spark, sf):
    """A map of the months as text: the number of stations, then each with its sentences, day and names."""
    return sinks.metro_map_text(_stations(spark, sf))


def _stations(spark, sf):
    _, _, sliced, clusters = _months(spark, sf)
    days = sliced.groupBy("slice").agg(F.min("slice_start").alias("station_date"))
    return clusters.groupBy("cluster_id", "slice").agg(F.array_sort(F.collect_set("term")).alias("entities")).join(days, "slice").select("cluster_id", "station_date", F.lit(True).alias("multi"), F.array(F.lit("et"), F.lit("to")).alias("sentences"), "entities")


@P.query(f"WITH {_CLU} SELECT DISTINCT cluster_id::VARCHAR AS cluster_id FROM clu")
def map_clusters(spark, sf):
    """The clusters of a map, read from its text."""
    return readers.metro_cluster_ids(sinks.metro_map_text(_stations(spark, sf)).select("line"))


@P.query(
    rf"""WITH {_CLU}, {_KEPT}, q AS (SELECT doc_id, list(DISTINCT t) AS terms, array_to_string(list_sort(list(DISTINCT t)), ' ') AS said FROM (SELECT doc_id, '*r' || lower(trim(mention)) AS t FROM men UNION ALL SELECT doc_id, 'fik stemmer siger' FROM men) GROUP BY doc_id),
s AS (SELECT doc_id, sent_no, sentence, CASE WHEN sent_no % 2 = 0 THEN -1.0 ELSE 1.0 END AS score FROM cand JOIN q USING (doc_id)),
j AS (SELECT s.*, terms, said, list_transform(string_split(sentence, ' '), lambda w: lower(regexp_replace(w, '[.,:;!?"'']', '', 'g'))) AS w FROM s JOIN q USING (doc_id))
SELECT doc_id, sent_no, sentence, score FROM j WHERE score >= 0 OR (len(list_filter(w, lambda x: NOT contains(said, x))) = 0 AND len(list_filter(terms, lambda t: starts_with(t, '*') AND NOT contains(lower(sentence), t) AND NOT contains(lower(sentence), t[3:]))) = 0)"""
)
def negative_sentences(spark, sf):
    """Every other sentence has a negative score and must say what the document's names do, and all of it."""
    m = mentions(spark, sf).select("doc_id", F.concat(F.lit("*r"), F.lower(F.trim("mention"))).alias("t"))
    more = m.select("doc_id").distinct().withColumn("t", F.lit("fik stemmer siger"))
    queries = m.unionByName(more).groupBy("doc_id").agg(F.array_sort(F.collect_set("t")).alias("terms")).withColumnRenamed("doc_id", "cluster_id")
    s = summary.sentences_of(articles(spark, sf)).select(F.col("doc_id").alias("cluster_id"), "doc_id", "sent_no", "sentence", F.when(F.col("sent_no") % 2 == 0, -1.0).otherwise(1.0).alias("score"))
    return summary.pruned(s, queries).select("doc_id", "sent_no", "sentence", "score")


@P.query("SELECT DISTINCT n_name AS term, n_regionkey AS cluster_id FROM nation")
def cluster_cells(spark, sf):
    """Terms and clusters as the cells of a binary matrix."""
    n = table(spark, sf, "nation").select(F.col("n_name").alias("term"), F.col("n_regionkey").alias("cluster_id"))
    return community.cluster_adjacency(n.unionByName(n))


@P.query(
    """WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), w AS (SELECT k, r, [0.1::DOUBLE + 0.01 * k, CASE WHEN r = 0 THEN 1.0 ELSE 0.2 END] AS w FROM n),
p AS (SELECT a.r = b.r AS edge, a.w[1] * b.w[1] + a.w[2] * b.w[2] AS d FROM w a JOIN w b ON a.k <> b.k) SELECT round(-(sum(CASE WHEN edge THEN ln(1 - exp(-d)) ELSE 0 END) - sum(CASE WHEN edge THEN 0 ELSE d END)), 6) AS cost FROM p"""
)
def affiliation_objective(spark, sf):
    """The cost of given weights for the graph of nations of a region."""
    rows = table(spark, sf, "nation").select("n_nationkey", "n_regionkey").groupBy().agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_regionkey"))).alias("n"))

    @F.pandas_udf("double")
    def cost(batch: pd.Series) -> pd.Series:
        out = []
        for n in batch:
            region = np.array([x["n_regionkey"] for x in n])
            adjacency = (region[:, None] == region[None, :]).astype(float)
            np.fill_diagonal(adjacency, 0)
            out.append(community.objective(adjacency, np.array([[0.1 + 0.01 * x["n_nationkey"], 1.0 if x["n_regionkey"] == 0 else 0.2] for x in n])))
        return pd.Series(out)

    return rows.select(F.round(cost("n"), 6).alias("cost"))


@P.query("SELECT CAST(date_trunc('month', first) AS DATE) AS slice_start, count(*) AS n FROM (SELECT file_path, min(loaded_at) AS first FROM example_documents WHERE loaded_at IS NOT NULL GROUP BY file_path) GROUP BY 1")
def stream_months(spark, sf):
    """Deliveries by month as a stream, until it is read to its end."""
    loads = streams.first_loads(streams.table_stream(spark, sf, "example_documents"), "file_path")
    out = fresh_path(spark, "months")
    # A table without files has no batch.
    empty = streams.monthly_counts(spark.createDataFrame([], loads.schema))
    empty.write.parquet(out)
    loads.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{out}-state").foreachBatch(lambda df, _: streams.monthly_counts(df).write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(empty.schema).parquet(out)
