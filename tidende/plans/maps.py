"""Queries over time, similar documents, communities, summaries and the map."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidende.functions import dates
from tidende.io import fresh_path, materialize, table
from tidende.operators import community, conll, corpus, entities, representation, summary, timeline, wordnet
from tidende.plans.base import ARTS, BOW, MENTIONS, Plans, articles, mentions
from tidende.sources import readers, sinks
from tidende.streaming import articles as streams

P = Plans()
QUERIES, SQL = P.queries, P.sql


@P.query("SELECT min(doc_id) AS doc_id, pub_date, ext_id FROM example_documents WHERE doc_id IS NOT NULL GROUP BY pub_date, ext_id")
def dedup_first(spark, sf):
    a = table(spark, sf, "example_documents").where(F.col("doc_id").isNotNull())
    return corpus.first_of_each(a.select("doc_id", "text", "pub_date", "ext_id")).select("doc_id", "pub_date", "ext_id")


@P.query(
    r"""SELECT DISTINCT doc_id, CAST(strptime(string_split(doc_id, '_')[-2][1:8], '%Y%m%d') AS DATE) AS day, regexp_replace(string_split(doc_id, '_')[-1], '\.[A-Za-z]+$', '') AS ext_id FROM example_documents WHERE doc_id IS NOT NULL"""
)
def names_parsed(spark, sf):
    """Day and id out of the file names."""
    d = table(spark, sf, "example_documents").where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return d.select("doc_id", dates.date_of_name(F.col("doc_id")).alias("day"), dates.ext_id_of_name(F.col("doc_id")).alias("ext_id"))


def _slice_sql(begin: str) -> str:
    return f"WITH {ARTS}, s AS (SELECT doc_id, CAST(pub_date AS DATE) AS pub_date, CAST({begin} AS DATE) AS slice_start FROM arts WHERE pub_date >= DATE '2014-01-01') SELECT doc_id, pub_date, (dense_rank() OVER (ORDER BY slice_start) - 1) AS slice, slice_start FROM s"


@P.query(_slice_sql("date_trunc('month', pub_date)"))
def slice_month(spark, sf):
    return corpus.slices(articles(spark, sf), first=corpus.FIRST_DAY)


@P.query(_slice_sql("pub_date"))
def slice_day(spark, sf):
    return corpus.slices(articles(spark, sf), "day", corpus.FIRST_DAY)


@P.query(_slice_sql("date_trunc('year', pub_date)"))
def slice_year(spark, sf):
    return corpus.slices(articles(spark, sf), "year", corpus.FIRST_DAY)


@P.query(
    f"""WITH {ARTS}, s AS (SELECT doc_id, CAST(pub_date AS DATE) AS pub_date, CAST(date_trunc('month', pub_date) AS DATE) AS slice_start FROM arts WHERE pub_date >= DATE '2014-01-01'),
d AS (SELECT DISTINCT slice_start, month(slice_start) AS f FROM s), t AS (SELECT *, max(f) OVER (ORDER BY slice_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM d),
n AS (SELECT slice_start, sum(CASE WHEN top IS NULL OR f > top THEN 1 ELSE 0 END) OVER (ORDER BY slice_start) - 1 AS slice FROM t) SELECT doc_id, pub_date, slice::BIGINT AS slice, slice_start FROM s JOIN n USING (slice_start)"""
)
def slice_month_legacy(spark, sf):
    """Months by their field only: a new year opens no slice by itself."""
    return corpus.slices(articles(spark, sf), first=corpus.FIRST_DAY, legacy=True)


@P.query(f"WITH {ARTS} SELECT doc_id FROM arts WHERE pub_date BETWEEN DATE '2017-09-01' AND DATE '2017-12-31' AND NOT contains(doc_id, '_noid')")
def date_range_filter(spark, sf):
    """Articles of four months, without those that carry no id."""
    return corpus.without_id(corpus.in_range(articles(spark, sf), "2017-09-01", "2017-12-31")).select("doc_id")


_COS = rf"""WITH {ARTS}, bow AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zøæå][\p{{L}}\p{{N}}_]+')) AS term FROM arts) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM bow GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM arts),
w AS (SELECT doc_id, term, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0) AS w FROM bow JOIN df USING (term), n),
v AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x, CAST(date_trunc('month', pub_date) AS DATE) AS slice_start FROM w JOIN arts USING (doc_id)),
pairs AS (SELECT a.slice_start, a.doc_id AS a, b.doc_id AS b, sum(a.x * b.x) AS cosine FROM v a JOIN v b ON a.slice_start = b.slice_start AND a.term = b.term AND encode(a.doc_id) < encode(b.doc_id) GROUP BY ALL HAVING sum(a.x * b.x) > 0.3),
ends AS (SELECT a AS doc_id FROM pairs UNION SELECT b FROM pairs)"""


def _pairs(spark, sf):
    vectors = materialize(corpus.term_vectors(articles(spark, sf)), "vectors")
    sliced = corpus.slices(vectors)
    return corpus.similar_pairs(vectors, sliced, 0.3), sliced


@P.query(f"{_COS} SELECT a, b, round(cosine, 6) AS cosine FROM pairs")
def cosine_pairs(spark, sf):
    """Documents of one month alike by their weighted terms."""
    return _pairs(spark, sf)[0].select("a", "b", F.round("cosine", 6).alias("cosine"))


@P.query(f"{_COS} SELECT doc_id FROM ends")
def cosine_included(spark, sf):
    return corpus.included(*_pairs(spark, sf))[0].select("doc_id")


@P.query(f"{_COS} SELECT doc_id FROM arts WHERE doc_id NOT IN (SELECT doc_id FROM ends)")
def cosine_excluded(spark, sf):
    return corpus.included(*_pairs(spark, sf))[1].select("doc_id")


@P.query("WITH t AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), p AS (SELECT a.l_partkey AS term_a, b.l_partkey AS term_b, count(*) AS w FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL) SELECT term_a, term_b, w FROM p WHERE w >= 2")
def term_cooccurrence(spark, sf):
    """Parts of one order, in two orders or more."""
    t = table(spark, sf, "lineitem").select(F.lit(0).alias("slice"), F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("term"))
    return community.cooccurrence(t, share=0.0).select("term_a", "term_b", "w")


def _entity_terms(spark, sf):
    """``slice, doc_id, term`` of the recognised names of each month's articles."""
    m = mentions(spark, sf).select("doc_id", F.lower(F.trim("mention")).alias("term")).distinct()
    return m.join(corpus.slices(articles(spark, sf)).select("doc_id", "slice"), "doc_id").select(F.col("slice").cast("int").alias("slice"), "doc_id", "term")


_ET = f"""{ARTS}, {MENTIONS}, sl AS (SELECT doc_id, CAST(pub_date AS DATE) AS pub_date, CAST((dense_rank() OVER (ORDER BY date_trunc('month', pub_date)) - 1) AS INT) AS slice FROM arts),
et AS (SELECT DISTINCT slice, doc_id, pub_date, lower(trim(mention)) AS term FROM men JOIN sl USING (doc_id))"""


@P.query(
    f"""WITH {_ET}, n AS (SELECT slice, count(DISTINCT doc_id) AS n FROM et GROUP BY slice), p AS (SELECT a.slice, a.term AS term_a, b.term AS term_b, count(*) AS w FROM et a JOIN et b ON a.doc_id = b.doc_id AND encode(a.term) < encode(b.term) GROUP BY ALL)
SELECT slice, term_a, term_b, w FROM p JOIN n USING (slice) WHERE w >= greatest(2, 0.02 * n)"""
)
def entity_cooccurrence(spark, sf):
    return community.cooccurrence(_entity_terms(spark, sf), share=0.02)


def _clusters(spark, sf):
    terms = materialize(_entity_terms(spark, sf), "entity-terms")
    edges = community.cooccurrence(terms, share=0.0)
    sizes = terms.groupBy("slice").agg(F.countDistinct("doc_id").alias("n_docs"))
    return community.cluster_ids(materialize(community.communities(edges, sizes), "members"))


@P.query()
def community_nmf(spark, sf):
    """Communities of names in each month."""
    return _clusters(spark, sf)


_HEAD = rf"""soft AS (SELECT doc_id, text AS t FROM arts), spaced AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '([.!?/])', '\1 ', 'g'), ' +([.!?/])', '\1', 'g')) AS t FROM soft),
head AS (SELECT doc_id, array_to_string(string_split(regexp_replace(t, '([.!?]) +', '\1' || chr(30), 'g'), chr(30))[1:3], ' ') AS h FROM spaced)"""


@P.query(rf"{_COS}, {_HEAD}, s AS (SELECT doc_id, CAST(dense_rank() OVER (ORDER BY date_trunc('month', pub_date)) - 1 AS INT) AS slice FROM arts) SELECT DISTINCT slice, doc_id, unnest(regexp_extract_all(lower(h), '[\p{{L}}\p{{N}}_]+')) AS term, NULL::DOUBLE AS weight FROM head JOIN s USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM ends)")
def singleton_clusters(spark, sf):
    """Headline terms of documents that nothing is like."""
    pairs, sliced = _pairs(spark, sf)
    lone = corpus.included(pairs, sliced)[1].join(articles(spark, sf).select("doc_id", "text"), "doc_id")
    return community.headline_clusters(lone)


@P.query(
    f"""WITH {_ET}, p AS (SELECT term AS entity, slice AS cluster_id, CAST(date_trunc('month', pub_date) AS DATE) AS station_date FROM et GROUP BY ALL), m AS (SELECT entity FROM p GROUP BY entity HAVING count(DISTINCT station_date) >= 2)
SELECT entity, cluster_id, station_date FROM p WHERE entity IN (SELECT entity FROM m)"""
)
def multi_date_entities(spark, sf):
    return timeline.several_dates(_placed(spark, sf))


def _placed(spark, sf):
    """A month as a cluster: ``entity, cluster_id, station_date``."""
    s = corpus.slices(articles(spark, sf)).select("slice", "slice_start").distinct()
    return _entity_terms(spark, sf).join(s, "slice").select(F.col("term").alias("entity"), F.col("slice").alias("cluster_id"), F.col("slice_start").alias("station_date")).distinct()


@P.query(f"WITH {_ET} SELECT term AS entity, count(DISTINCT slice) AS clusters FROM et GROUP BY term")
def entity_importance(spark, sf):
    return entities.importance(_placed(spark, sf))


@P.query(
    f"""WITH {_ET}, c AS (SELECT slice AS cluster_id, term AS entity, count(*)::DOUBLE AS score, CAST(date_trunc('month', any_value(pub_date)) AS DATE) AS station_date FROM et GROUP BY ALL)
SELECT entity, cluster_id, station_date FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, encode(entity)) AS k FROM c) WHERE k <= 4"""
)
def limit_entities_per_cluster(spark, sf):
    scores = _entity_terms(spark, sf).groupBy(F.col("slice").alias("cluster_id"), F.col("term").alias("entity")).agg(F.count("*").cast("double").alias("score"))
    return timeline.most_entities(_placed(spark, sf), scores)


@P.query(
    f"""WITH {_ET}, p AS (SELECT term AS entity, dense_rank() OVER (ORDER BY encode(doc_id)) AS cluster_id, pub_date AS station_date FROM et), top AS (SELECT entity FROM p GROUP BY entity ORDER BY count(*) DESC, encode(entity) LIMIT 10),
s AS (SELECT cluster_id, station_date, count(*) FILTER (WHERE entity IN (SELECT entity FROM top)) AS hits FROM p GROUP BY ALL), k AS (SELECT cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY station_date ORDER BY hits DESC, cluster_id) AS k FROM s) WHERE k <= 3)
SELECT entity, cluster_id, station_date FROM p WHERE cluster_id IN (SELECT cluster_id FROM k)"""
)
def limit_clusters_per_date(spark, sf):
    """A document as a cluster, at most three a day."""
    terms = materialize(_entity_terms(spark, sf), "entity-terms")
    ids = representation.dense_ids(terms.select("doc_id").distinct(), "doc_id", 1).select("doc_id", F.col("id").alias("cluster_id"))
    placed = terms.join(ids, "doc_id").join(articles(spark, sf).select("doc_id", "pub_date"), "doc_id").select(F.col("term").alias("entity"), "cluster_id", F.col("pub_date").alias("station_date"))
    return timeline.most_clusters(placed)


@P.query(
    f"""WITH {_ET}, d AS (SELECT term, pub_date, count(*) AS n FROM et GROUP BY ALL), win AS (SELECT term, pub_date AS winner FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, pub_date) AS k FROM d) WHERE k = 1)
SELECT term, doc_id, winner, round(pow(0.95, abs(date_diff('day', winner, pub_date))), 6) AS weight FROM et JOIN win USING (term)"""
)
def winner_date_decay(spark, sf):
    """Each name's strongest day, and its documents' weights away from it."""
    e = _entity_terms(spark, sf).join(articles(spark, sf).select("doc_id", "pub_date"), "doc_id")
    days = e.groupBy("term", "pub_date").agg(F.count("*").alias("n"))
    winner = days.groupBy("term").agg(F.max(F.struct("n", F.expr("-datediff(pub_date, date'1970-01-01')").alias("early"), "pub_date")).alias("x")).select("term", F.col("x.pub_date").alias("winner"))
    return e.join(winner, "term").select("term", "doc_id", "winner", F.round(dates.decay(F.col("winner"), F.col("pub_date")), 6).alias("weight"))


@P.query(
    f"""WITH {ARTS}, {MENTIONS}, r AS (SELECT '*r.' || lower(trim(mention)) AS term, doc_id FROM men UNION ALL SELECT '*w.' || lower(entity), doc_id FROM men WHERE kb = 'w' AND entity IS NOT NULL),
c AS (SELECT term, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM arts WHERE NOT contains(doc_id, '_noid'))) AS n FROM r GROUP BY term) SELECT term, CASE WHEN n > 0 THEN round(1.0 / n, 6) END AS idf FROM c"""
)
def entity_inverse_freq(spark, sf):
    occ = representation.inverted_entities(mentions(spark, sf))
    return summary.entity_rarity(occ, corpus.without_id(articles(spark, sf))).select("term", F.round("idf", 6).alias("idf"))


def _scores(spark, sf):
    """Clusters, and the articles, sentences and scores by numbers in the order of the ``doc_id``, which ``names`` has."""
    a = materialize(articles(spark, sf), "articles")
    names = materialize(representation.dense_ids(a.select("doc_id"), "doc_id").select("doc_id", "id"), "names")
    numbered = materialize(a.join(names, "doc_id").select(F.col("id").alias("doc_id"), "text", "pub_date"), "numbered")
    m = mentions(spark, sf)
    clusters = materialize(_clusters(spark, sf), "clusters")
    kinds = representation.entity_tags(m).select("kind", F.lower("term").alias("t")).groupBy("t").agg(F.max("kind").alias("kind"))
    tagged = clusters.join(kinds, F.col("term") == F.col("t")).select("cluster_id", "slice", "kind", "term", "weight", F.lit(None).cast("long").alias("headline"))
    sentences = materialize(summary.sentences_of(numbered), "sentences")
    rarity = summary.entity_rarity(representation.inverted_entities(m), a)
    scores = summary.sentence_scores(tagged, corpus.slices(numbered), sentences, rarity, representation.surface_forms(m))
    return clusters, numbered, names, sentences, scores


def _named(df, names):
    """``doc_id`` in place of its number."""
    return df.withColumnRenamed("doc_id", "id").join(names, "id").select(df.columns)


def _summaries(spark, sf):
    clusters, numbered, names, sentences, scores = _scores(spark, sf)
    found = summary.summaries(materialize(scores, "scores"), sentences, numbered, total=3.0)
    return clusters, materialize(_named(found, names), "summaries")


@P.query()
def sentence_score(spark, sf):
    _, _, names, _, scores = _scores(spark, sf)
    return _named(scores, names)


@P.query()
def summary_topk(spark, sf):
    return _summaries(spark, sf)[1]


def _lines(spark, sf, merged=True):
    clusters, found = _summaries(spark, sf)
    placed = clusters.select(F.col("term").alias("entity"), F.col("cluster_id").cast("long").alias("cluster_id")).distinct().join(timeline.cluster_dates(found), "cluster_id").select("entity", "cluster_id", "station_date")
    vectors = timeline.cluster_vectors(clusters.withColumn("cluster_id", F.col("cluster_id").cast("long")))
    placed = materialize(timeline.several_dates(placed), "placed")
    return clusters, found, timeline.lines(placed, vectors, merged=merged), placed, vectors


@P.query()
def line_split(spark, sf):
    return _lines(spark, sf, merged=False)[2]


@P.query()
def line_merge(spark, sf):
    return _lines(spark, sf)[2]


@P.query()
def metro_map(spark, sf):
    """The stations of the map as lines of text."""
    clusters, found, _, placed, vectors = _lines(spark, sf)
    limited = timeline.most_entities(placed, timeline.entity_scores(placed, found))
    limited = timeline.without_single(timeline.most_clusters(limited))
    lined = timeline.lines(limited, vectors)
    return sinks.metro_map_lines(timeline.stations(lined, found, clusters)).select("station_date", "cluster_id", F.array_join("lines", "\n").alias("text"))


_WN = "wd AS (SELECT n_nationkey AS id, lower(n_name) AS form FROM nation UNION ALL SELECT 100 + r_regionkey, lower(r_name) FROM region), se AS (SELECT n_nationkey AS word_id, n_regionkey AS synset_id FROM nation UNION ALL SELECT 100 + r_regionkey, 100 + r_regionkey FROM region)"


def _wordnet(spark, sf):
    """Nations as words of their region's synset, regions above them."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    words = n.select(F.col("n_nationkey").cast("bigint").alias("id"), F.lower("n_name").alias("form")).unionByName(r.select((F.col("r_regionkey") + 100).cast("bigint").alias("id"), F.lower("r_name").alias("form")))
    senses = n.select(F.col("n_nationkey").cast("bigint").alias("word_id"), F.col("n_regionkey").cast("bigint").alias("synset_id")).unionByName(r.select((F.col("r_regionkey") + 100).cast("bigint").alias("word_id"), (F.col("r_regionkey") + 100).cast("bigint").alias("synset_id")))
    relations = r.select(F.col("r_regionkey").cast("bigint").alias("synsets_id"), F.lit("has_hyperonym").alias("name2"), (F.col("r_regionkey") + 100).cast("bigint").alias("value"))
    synsets = r.select((F.col("r_regionkey") + 100).cast("bigint").alias("id"), F.col("r_name").alias("label"))
    return words, senses, relations, synsets


@P.query(f"WITH {_WN}, s AS (SELECT form, synset_id FROM wd JOIN se ON id = word_id) SELECT DISTINCT a.form, b.form AS synonym FROM s a JOIN s b USING (synset_id) WHERE a.form <> b.form AND NOT contains(trim(b.form), ' ')")
def synonym_join(spark, sf):
    words, senses, _, _ = _wordnet(spark, sf)
    return wordnet.synonyms(words, senses)


@P.query("SELECT DISTINCT lower(n_name) AS form, lower(r_name) AS hypernym FROM nation JOIN region ON n_regionkey = r_regionkey WHERE NOT contains(trim(r_name), ' ')")
def hypernym_join(spark, sf):
    return wordnet.hypernyms(*_wordnet(spark, sf))


@P.query("WITH t AS (SELECT c_custkey AS doc_id, lower(n_name) AS term, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT DISTINCT t.doc_id, lower(n_name) AS term FROM t JOIN nation USING (n_regionkey) WHERE lower(n_name) <> t.term AND NOT contains(trim(n_name), ' ')), h AS (SELECT t.doc_id, lower(r_name) AS term FROM t JOIN region ON n_regionkey = r_regionkey WHERE NOT contains(trim(r_name), ' ') AND t.doc_id IN (SELECT doc_id FROM s)) SELECT doc_id, 'f' AS kind, term FROM s UNION SELECT doc_id, 'f', term FROM h")
def hypernym_expansion(spark, sf):
    """Customers' nations widened by word-net relations."""
    words, senses, relations, synsets = _wordnet(spark, sf)
    t = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("doc_id"), F.lower("n_name").alias("term"))
    return wordnet.expanded(t, wordnet.synonyms(words, senses), wordnet.hypernyms(words, senses, relations, synsets))


@P.query("SELECT src, dst, src || chr(9) || dst AS line FROM (SELECT n_nationkey AS src, n_regionkey + 100 AS dst FROM nation UNION SELECT n_regionkey + 100, n_nationkey FROM nation)")
def snap_edges(spark, sf):
    return sinks.snap_edges(table(spark, sf, "nation").select(F.col("n_nationkey").alias("src"), (F.col("n_regionkey") + 100).alias("dst")))


@P.query("SELECT n_regionkey, count(*) AS n, string_agg(lower(n_name), ', ' ORDER BY encode(lower(n_name))) AS lemmas FROM nation GROUP BY n_regionkey")
def reverse_dict(spark, sf):
    g = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.lower("n_name"))), ", ").alias("lemmas"))
    return g


_TOK = "tok AS (SELECT p_partkey AS sentence_id, i AS tok, w[i] AS form, p_brand AS cpos FROM (SELECT p_partkey, p_brand, string_split(p_name, ' ') AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part))"


def _tokens(spark, sf):
    """Words of part names as tokens of the older column format."""
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("sentence_id"), "p_brand", F.posexplode(F.split("p_name", " ")).alias("k", "form"))
    k = (F.col("k") + 1).cast("int")
    return t.select("sentence_id", k.alias("tok"), k.cast("string").alias("index"), "form", F.lower("form").alias("lemma"), F.col("p_brand").alias("cpos"), F.col("p_brand").alias("pos"), F.lit("_").alias("feats"), F.when(k == 1, 0).otherwise(1).cast("string").alias("head"), F.lit("x").alias("label"))


@P.query(f"WITH {_TOK} SELECT sentence_id, tok, concat_ws(chr(9), tok, form, lower(form), lower(form), cpos, cpos, 'pos=' || cpos, 'pos=' || cpos, CASE WHEN tok = 1 THEN 0 ELSE 1 END, CASE WHEN tok = 1 THEN 0 ELSE 1 END, 'x', 'x', '_') AS line FROM tok")
def conll_project(spark, sf):
    return sinks.conll09_lines(_tokens(spark, sf))


@P.query(f"WITH {_TOK} SELECT sentence_id, tok, form, CASE cpos WHEN 'Brand#1' THEN 'NOUN' WHEN 'Brand#2' THEN 'VERB' ELSE '*NONE*' END AS tag FROM tok")
def pos_map(spark, sf):
    tags = spark.createDataFrame([("Brand#1", "NOUN"), ("Brand#2", "VERB")], "tag string, universal string")
    return conll.mapped_tags(_tokens(spark, sf), tags).select("sentence_id", "tok", "form", F.col("cpos").alias("tag"))


@P.query(f"WITH {_TOK} SELECT sentence_id, string_agg(form || '_' || cpos, ' ' ORDER BY tok) AS line FROM tok GROUP BY sentence_id")
def tagged_tokens(spark, sf):
    return sinks.tagged_tokens(_tokens(spark, sf))


@P.query(f"WITH {MENTIONS} SELECT doc_id, pos, mention || ', [u''' || CASE WHEN entity IS NULL THEN 'None' ELSE concat_ws('.', kb, entity) END || ''']' AS line FROM men")
def disambiguation_lines(spark, sf):
    return sinks.disambiguation_lines(mentions(spark, sf))


@P.query(f"WITH {MENTIONS} SELECT doc_id, pos, mention, CASE WHEN entity IS NOT NULL THEN kb END AS kb, entity FROM men WHERE kb = 'w' OR entity IS NULL")
def disambiguation_roundtrip(spark, sf):
    """Written as lines and read again, those of other knowledge bases left out."""
    return readers.wiki_or_undecided(readers.parse_disambiguations(sinks.disambiguation_lines(mentions(spark, sf))))


@P.query(f"WITH {ARTS}, {BOW} SELECT doc_id, token, tf FROM bow")
def table_roundtrip(spark, sf):
    """A dictionary written as a table and read again."""
    bow = representation.bag_of_words(articles(spark, sf))
    path = fresh_path(spark, "bow")
    sinks.write_table(bow, path)
    return spark.read.schema(bow.schema).parquet(path)


@P.query(f"WITH {ARTS}, s AS (SELECT doc_id, CAST(pub_date AS DATE) AS pub_date, CAST(date_trunc('month', pub_date) AS DATE) AS slice_start FROM arts), k AS (SELECT *, dense_rank() OVER (ORDER BY slice_start) - 1 AS slice FROM s) SELECT doc_id, pub_date, slice, slice_start FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY md5('10' || chr(31) || doc_id), encode(doc_id)) AS r FROM k) WHERE r <= 5")
def sample_k(spark, sf):
    """Five articles of each month."""
    s = corpus.slices(articles(spark, sf))
    return corpus.sample(s, ["doc_id"], ["slice"])


@P.query("SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, event_type, value FROM events) GROUP BY ALL")
def stream_windows(spark, sf):
    """Sliding windows over the events as a stream, until it is read to its end."""
    source = table(spark, sf, "events").schema
    events = spark.readStream.schema(source).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = fresh_path(spark, "windows")
    windows = streams.rolling_values(events)
    run = windows.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{out}-state").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    run.awaitTermination()
    return spark.read.schema(windows.schema).parquet(out).withColumn("total", F.round("total", 4))


