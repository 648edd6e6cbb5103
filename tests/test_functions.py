from pyspark.sql import functions as F

from tidende.functions import dates, text
from tidende.operators import conll, coherence, corpus, disambiguate, entities, evaluate, links, prior, similarity, timeline, web, wordnet
from tidende.sources import readers, sinks


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_links_and_references(spark):
    assert one(spark, "[[A|b]] og [[Fil:x.jpg]] [[C]]", text.links) == ["a|b", "fil:x.jpg", "c"]
    assert one(spark, "a|b|c", text.link_anchor) == "c" and one(spark, "a|b|c", text.link_target) == "a" and one(spark, "a|b|c", text.link_target_greedy) == "a|b"
    assert one(spark, "x<ref>[Bog] af N</ref> <ref>{{cite|title=Titel|y}}</ref><ref>a<sup>2</sup>b</ref>", text.references) == ["bog af n", "titel", "a<sup>2</sup>b"]


def test_lines(spark):
    assert one(spark, "[u'Havby', u'Sejlere']", text.mention_of_line) == "Havby Sejlere"
    assert one(spark, "[u\"Ski'er\"]", text.mention_of_line) == "Ski'er"
    assert one(spark, r"K\xf8benhavn \u2019s", text.unescape_danish) == "København 's"
    assert one(spark, "En tekst.", text.format_paragraph) == "En tekst.." and one(spark, "En..", text.format_paragraph) == "En.."
    assert one(spark, "%C3%A6ble+1", text.url_letters) == "æble+1" and one(spark, "100%", text.url_letters) == "100%"


def test_sentences(spark):
    assert one(spark, "Hej .Det er tidl. formand!Ja", lambda c: text.sentence_array(text.soft_abbreviations(c))) == ["Hej.", "Det er tidl․ formand!", "Ja"]
    assert one(spark, "Første. 2 x. Et par ord her.", lambda c: text.sentence_candidates(text.sentence_array(c))) == ["Første.", "Et par ord her."]
    tokens = lambda c: text.danish_tokens(c, ["f.eks.", "bl.a."])
    assert one(spark, "Se f.eks. www.havby.dk/a?b=1 nu. Ja!", tokens) == ["Se", "f.eks.", "www.havby.dk/a?b=1", "nu", ".", "Ja", "!"]
    assert one(spark, "»Bo's hus«, 3,5 % – a_b (ned(e", tokens) == ["»", "Bo", "'s", "hus", "«", ",", "3", ",", "5", "%", "–", "a_b", "(", "ned", "(", "e"]
    assert one(spark, "x a(b. y", lambda c: text.danish_tokens(c, ["a(b."])) == ["x", "a(b.", "y"] and one(spark, " \n", lambda c: text.token_sentences(tokens(c))) == []
    assert one(spark, "Han kom. Så gik han! Nej", lambda c: text.token_sentences(tokens(c))) == [["Han", "kom", "."], ["Så", "gik", "han", "!"], ["Nej"]]


def test_terms(spark):
    assert one(spark, " Siger! ", text.clean_term) == "" and one(spark, "(12)", text.clean_term) == "" and one(spark, "Hus.", text.clean_term) == "hus"
    assert one(spark, "*r.jens*r.jens hansen", text.first_of_concatenated) == "*r.jens"
    assert one(spark, "‎Dansk ", text.format_chars_off) == "dansk"
    assert evaluate.partial_matches([("bo vimmel", 1, 0, 0), ("havby", 2, 1, 1), ("ida", 0, 1, 0), ("maler bo vimmel nord", 0, 1, 0)]) == (2, 2, 4)
    assert readers.read_paths([" /a ", "/b"]) == readers.Paths("/a", "/b")


def test_dates(spark):
    name = "a_02_side_fre_s002_01_nyt__1407_201707140000_42.txt"
    d = spark.createDataFrame([(name,)], "x string").select(dates.date_of_name(F.col("x")).cast("string"), dates.ext_id_of_name(F.col("x"))).first()
    assert tuple(d) == ("2017-07-14", "42")
    d = spark.createDataFrame([("2017-01-01", "2017-02-03")], "a string, b string").select(F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    r = d.select(dates.decay(F.col("a"), F.col("b")), dates.decay(F.col("a"), F.col("b"), days_only=True)).first()
    assert abs(r[0] - 0.95**33) < 1e-9 and abs(r[1] - 0.95**2) < 1e-9


def test_slices_wrap(spark):
    a = spark.createDataFrame([("a", "2017-12-05"), ("b", "2018-01-04")], "doc_id string, d string").select("doc_id", F.to_date("d").alias("pub_date"))
    assert {r.slice for r in corpus.slices(a).collect()} == {0, 1}
    assert {r.slice for r in corpus.slices(a, legacy=True).collect()} == {0}


def test_prior_rules(spark):
    uses = spark.createDataFrame([("Zk", "zk (firma)")] * 21 + [("Zk", "zk")] * 16 + [("zk ", "zoo kvik")] * 3 + [("x", None)], "mention string, entity string")
    p = prior.popularity(uses)
    assert [(r.entity, round(r.prior, 3)) for r in p.orderBy(F.desc("prior")).collect()] == [("zk (firma)", 0.525), ("zk", 0.4), ("zoo kvik", 0.075)]
    found = prior.candidates(spark.createDataFrame([("d", "ZKs")], "doc_id string, mention string"), p)
    assert prior.genitive_fallback(found, p).count() == 3
    named = prior.language_names(prior.candidates(spark.createDataFrame([("d", "ZK")], "doc_id string, mention string"), p), spark.createDataFrame([("zk",)], "name string"))
    assert [tuple(r) for r in named.collect()] == [("d", "ZK", "zk (firma)", 1.0)]
    both = spark.createDataFrame([("Hansens", "hansen", 3), ("Hansens", "andet", 1)], "mention string, entity string, n int")
    p2 = prior.popularity(both.select("mention", "entity", F.explode(F.sequence(F.lit(1), "n"))).unionByName(spark.createDataFrame([("Hansen", "per hansen", 1)], "mention string, entity string, col int")))
    swapped = prior.genitive_names(prior.candidates(spark.createDataFrame([("d", "Hansens")], "doc_id string, mention string"), p2), p2)
    assert [(r.mention, r.entity) for r in swapped.collect()] == [("Hansens", "per hansen")]


def test_cover_and_fold():
    assert similarity.minimal_cover([[1, 2, 3], [4, 5, 6], [7, 8, 9, 10]]) == (3, 7, 5)
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 4))) for _ in range(rng.randint(1, 4))]
        brute = min(max(c) - min(c) + 1 for c in itertools.product(*lists))
        assert similarity.minimal_cover(lists)[2] == brute
    assert similarity.fold_score([["rød", "bil"]], {"rød": 1.0, "bil": 1.0}, ["en", "rød", "bil"]) == 1.0
    assert similarity.fold_score([], {}, ["x"]) == 0.0


def slow_solve(mentions, edges):
    """The same greedy rule with every degree summed anew at each step."""
    graph = {("m", m): {} for m in mentions}
    for kind, src, dst, weight in edges:
        a, b = ("m" if kind == "mention" else "e", src), ("e", dst)
        if a != b:
            graph.setdefault(a, {})[b] = weight
            graph.setdefault(b, {})[a] = weight
    least = lambda g: min((sum(n.values()) for n in g.values() if n), default=0.0)
    best, most, taboo = {k: dict(v) for k, v in graph.items()}, least(graph), set()
    while True:
        taboo |= {next(iter(n)) for node, n in graph.items() if node[0] == "m" and len(n) == 1}
        free = [e for e in graph if e[0] == "e" and e not in taboo]
        if not free:
            break
        gone = min(free, key=lambda e: (sum(graph[e].values()), e[1]))
        for other in graph.pop(gone):
            del graph[other][gone]
        if least(graph) > most:
            best, most = {k: dict(v) for k, v in graph.items()}, least(graph)
    return {m: min(best["m", m], key=lambda e: (-best["m", m][e], e[1]))[1] if best["m", m] else None for m in mentions}


def test_graphs():
    import random

    edges = [("mention", "kim", "kim a", 3.0), ("mention", "kim", "kim b", 0.25), ("mention", "lo", "lo c", 1.5), ("mention", "lo", "lo d", 1.25), ("entity", "kim a", "lo c", 2.0)]
    assert disambiguate.solve(["kim", "lo", "ene"], edges) == {"kim": "kim a", "lo": "lo c", "ene": None}
    assert disambiguate.solve_exhaustively(["kim", "lo"], edges) == 1.5
    rng = random.Random(5)
    for _ in range(300):
        names, found = [f"m{k}" for k in range(rng.randint(1, 4))], [f"e{k}" for k in range(rng.randint(1, 6))]
        edges = [("mention", m, e, rng.randint(1, 64) / 64) for m in names for e in found if rng.random() < 0.5]
        edges += [("entity", a, b, rng.randint(1, 64) / 64) for a in found for b in found if a < b and rng.random() < 0.4]
        assert disambiguate.solve(names, edges) == slow_solve(names, edges)


def test_coherence_bounds(spark, sf):
    p = spark.read.parquet(f"{sf}/priors.parquet").where("entity is not null and page_title is not null").select("entity", F.col("page_title").alias("source"))
    r = coherence.coherence(p).agg(F.min("coherence"), F.max("coherence")).first()
    assert 0 < r[0] and r[1] <= 1


def test_line_rules():
    placed = [(1, "2017-01-01"), (2, "2017-01-02"), (3, "2017-01-02"), (4, "2017-01-03")]
    lines = timeline.split_lines(placed, {(1, 2): 0.9, (1, 3): 0.8, (3, 4): 0.7})
    assert lines[1] == lines[2] and lines[3] != lines[1] and lines[4] == lines[3]
    day = dict(placed)
    # Only lines that begin after the last day of another join it.
    assert timeline.merge_lines({1: 0, 2: 1, 3: 2, 4: 0}, {1: "a", 2: "b", 3: "d", 4: "c"}, after=True) == {1: 0, 4: 0, 3: 0, 2: 1}
    assert timeline.merge_lines({1: 0, 2: 1, 3: 2, 4: 0}, {1: "a", 2: "b", 3: "d", 4: "c"}) == {1: 0, 4: 0, 2: 0, 3: 0}
    merged = timeline.merge_lines(lines, day)
    for k in set(merged.values()):
        days = [day[c] for c, x in merged.items() if x == k]
        assert len(days) == len(set(days))


def test_tree_switch():
    rows = [{"index": 1, "form": "på", "lemma": "på", "pos": "SP", "head": 0, "label": "root"}, {"index": 2, "form": "det", "lemma": "det", "pos": "PD", "head": 1, "label": "nobj"}, {"index": 3, "form": "danske", "lemma": "dansk", "pos": "AN", "head": 2, "label": "mod"}, {"index": 4, "form": "hold", "lemma": "hold", "pos": "NC", "head": 2, "label": "x"}]
    out = {r["index"]: r["head"] for r in conll.noun_headed(rows)}
    assert out == {1: 0, 2: 4, 3: 4, 4: 1}


def test_web_policy(spark):
    rows = [("Bo-Kaj Vimmel", 1, "https://x/in/bo-kaj-vimmel-9"), ("Bo-Kaj Vimmel", 2, "https://x/in/bo-vimmel-2"), ("Ida Marie Ravns", 1, "https://x/in/ida"), ("Ida Marie Ravns", 2, "https://x/in/mona-marie-ravn"), ("Qq", 1, "https://x/in/zz")]
    best = {x.mention: x.slug for x in web.best_profile(spark.createDataFrame(rows, "mention string, rank int, url string")).collect()}
    assert best == {"Bo-Kaj Vimmel": "bo-kaj-vimmel-9", "Ida Marie Ravns": "mona-marie-ravn", "Qq": None}


def test_readers(spark, tmp_path):
    (tmp_path / "a_b_201707140000_12.txt").write_text("Hej. Der.", encoding="utf-8")
    row = readers.read_articles(spark, str(tmp_path)).first()
    assert (row.doc_id, row.text, str(row.pub_date), row.ext_id) == ("a_b_201707140000_12.txt", "Hej. Der.", "2017-07-14", "12")
    x = tmp_path / "xml"
    x.mkdir()
    (x / "n.xml").write_text("<all><article><hl1>Titel</hl1><p>Et.</p><p>To</p></article><article><hl1>Tom</hl1></article></all>", encoding="utf-8")
    assert [tuple(r) for r in readers.read_news_xml(spark, str(x)).collect()] == [("n.txt", "Titel", "Titel Et.. To.")]
    (tmp_path / "w.xml").write_text("<m><page><title>A</title><revision><text>[[B|c]]</text></revision></page></m>", encoding="utf-8")
    assert [tuple(r) for r in readers.read_wiki_pages(spark, str(tmp_path / "w.xml")).collect()] == [("A", "[[B|c]]")]
    (tmp_path / "t.lst").write_text("  12 er 3\ner 1478564\n\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_terms(spark, str(tmp_path / "t.lst")).collect()] == [("12", None), ("er", 1478564)]
    (tmp_path / "c.conll").write_text("1\tDet\tdet\tPD\tPD\ta=b|c=d\t0\troot\t_\t_\n\n1\tJa\tja\tI\tI\t_\t0\troot\t_\t_\n", encoding="utf-8")
    from tidende.schemas import CONLL06

    c = readers.read_conll(spark, str(tmp_path / "c.conll"), CONLL06)
    assert sorted(r.form for r in c.collect()) == ["Det", "Ja"]
    assert {tuple(sorted(r[0].items())) for r in c.where("form = 'Det'").select(readers.feature_map(F.col("feats"))).collect()} == {(("a", "b"), ("c", "d"))}
    (tmp_path / "j.json").write_text('{"_id": "1", "body": ["a", "b"]}\n{"_id": "2", "body": "c"}\n', encoding="utf-8")
    assert [tuple(r) for r in readers.read_json_documents(spark, str(tmp_path / "j.json"), "_id", ["body"]).orderBy("doc_id").collect()] == [("1", "body", "a\nb"), ("2", "body", "c")]
    (tmp_path / "lang").write_text("‎Dansk\nTysk\n", encoding="utf-8")
    assert {r.name for r in readers.read_languages(spark, str(tmp_path / "lang")).collect()} == {"dansk", "tysk"}


def test_parsers(spark):
    gold = spark.createDataFrame([("d", 1, "Se [*[Anna|w.anna/]*] og [*[X|None]*]")], "doc_id string, line_no int, line string")
    assert [(r.mention, r.entity) for r in readers.parse_gold(gold).orderBy("pos").collect()] == [("Anna", "w.anna"), ("X", None)]
    lines = spark.createDataFrame([("d", 0, "Anna, [u'w.anna']"), ("d", 1, "Bo, [u'None']"), ("d", 2, "kaput")], "doc_id string, pos int, line string")
    assert [tuple(r)[2:] for r in readers.parse_disambiguations(lines).orderBy("pos").collect()] == [("Anna", "w", "anna"), ("Bo", None, None)]
    com = spark.createDataFrame([(1, "a,0.5\tb,0\tc,0.0000001\t")], "cluster_id int, line string")
    assert [(r.term, r.weight) for r in readers.parse_communities(com).orderBy("term").collect()] == [("a", 0.5), ("b", 0.002), ("c", 0.001)]
    assert [r.cluster_id for r in readers.metro_cluster_ids(spark.createDataFrame([("clusternr: 7*",), ("3",)], "line string")).collect()] == ["7"]
    tags = spark.createDataFrame([("Hus", "NOUN"), ("hus", "VERB")], "form string, tag string")
    assert sinks.tag_dictionary(tags).first().line == '<entry tags="NOUN VERB"><token>hus</token></entry>'


def test_entities(spark):
    m = spark.createDataFrame([("Havby",)] * 3 + [("Havbys",), ("Havby Sejlere",), ("Sandlev",)], "mention string")
    found = {r.mention: r.canonical for r in entities.variants(m).collect()}
    assert found == {"havby": "havby", "havbys": "havby", "havby sejlere": "havby", "sandlev": "sandlev"}
    assert entities.annotate("Bo Vimmel i Havby", [("bo vimmel (maler)", "*w.p"), ("vimmel", "*r.h")]) == (["*w.p"], ["i", "havby"])
    heads = spark.createDataFrame([("d", "Bo Vimmel maler i Havby."), ("e", None)], "doc_id string, headline string")
    tags = spark.createDataFrame([("d", "w", "bo vimmel (maler)"), ("d", "r", "havby"), ("e", "r", "x")], "doc_id string, kind string, term string")
    assert {r.term for r in entities.annotated_headlines(heads, tags).collect()} == {"*w.bo vimmel (maler)", "*r.havby", "maler", "i"}


def test_categories_and_wordnet(spark):
    c = spark.createDataFrame([("Byer_i_Jylland", "AALBORG\nRANDERS"), ("Kilder_mangler_(samlet_liste)", "AALBORG")], "cl_to string, cl_sortkey string")
    assert {tuple(r) for r in links.categories(c).collect()} == {("aalborg", "byer i jylland"), ("randers", "byer i jylland")}
    terms = spark.createDataFrame([("d", 1, "", "łx"), ("d", 2, "", "hus"), ("d", 3, "w", "bil")], "doc_id string, rank int, kind string, term string")
    assert [r.term for r in wordnet.allowed_terms(terms).collect()] == ["hus"]
