"""What the reviews found."""

import datetime as d

FILES = "doc_id string, text string, pub_date date, ext_id string, file_path string, loaded_at timestamp_ntz"


def test_stream_months_reads_a_folder_whole_and_late_repeats(spark, tmp_path):
    from tidende.plans import registry

    at = lambda year, month: d.datetime(year, month, 3)
    rows = [("p1", at(2018, 5)), ("p1", at(2018, 2)), ("p2", at(1999, 1)), ("p3", at(2018, 2)), ("p4", None), (None, at(2018, 2))]
    files = spark.createDataFrame([("x", "t", None, None, p, t) for p, t in rows], FILES)
    # One file a row, so that the repeats lie in several; the path is no test's or check's name.
    files.repartition(6, "loaded_at", "file_path").write.parquet(str(tmp_path / "a" / "example_documents.parquet"))
    assert sorted((r.slice_start.isoformat(), r.n) for r in registry.QUERIES["stream_months"](spark, str(tmp_path / "a")).collect()) == [("1999-01-01", 1), ("2018-02-01", 3)]
    spark.createDataFrame([], FILES).write.parquet(str(tmp_path / "b" / "example_documents.parquet"))
    assert registry.QUERIES["stream_months"](spark, str(tmp_path / "b")).collect() == []


def test_alike_blocks_give_all_pairs_once(monkeypatch):
    import numpy as np

    from tidende.operators import alike

    monkeypatch.setattr(alike, "CELLS", 90)
    monkeypatch.setattr(alike, "WIDTH", 3)
    rng = np.random.default_rng(5)
    full = rng.random((40, 60)) * (rng.random((40, 60)) < 0.2 * rng.random(60)) + np.eye(40, 60)
    full /= np.linalg.norm(full, axis=1)[:, None]

    def rows(m):
        of, term = np.nonzero(m)
        return np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(m)))]), term * 7 - 100, m[of, term]

    block = alike.Block(rows(full[:25]), 0.3)
    got = {(int(a), int(b)): x for p in block.own() for a, b, x in zip(*p, strict=True)} | {(int(b), int(a) + 25): x for p in block.others(rows(full[25:])) for a, b, x in zip(*p, strict=True)}
    cos = full @ full.T
    want = {(i, j): cos[i, j] for i in range(25) for j in range(i + 1, 40) if cos[i, j] > 0.3}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 20


def test_cosine_pairs_shuffle_vectors_not_pairs(spark, monkeypatch):
    import os

    import pytest

    import compare
    from tidende.operators import alike
    from tidende.plans import maps

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("test data absent")
    monkeypatch.setattr(alike, "STRIPE", 20)
    assert compare.compare(spark, sf, "cosine_pairs").startswith("ok")
    plan = maps.QUERIES["cosine_pairs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    # No join of candidates with vectors; each vector goes to its block and those around it.
    assert "SortMergeJoin" not in plan and "MapInArrow" in plan


def test_foreign_keyphrases_are_united_where_their_entity_is(spark, monkeypatch):
    import math

    from tidende.operators import links

    inlink = [(f"e{i}", f"p{j}") for i in range(30) for j in range(20) if (i * j) % 7 == 1] + [("e0", "none")]
    anchors = [(f"p{j}", f"k{(j * m) % 23}") for j in range(20) for m in range(9)] * 2 + [("other", "k0")]
    want = {(e, k) for e, p in inlink for q, k in anchors if p == q}
    frames = spark.createDataFrame(inlink, "entity string, source string"), spark.createDataFrame(anchors, "entity string, keyphrase string")
    # Several blocks.
    monkeypatch.setattr(links, "math", type("M", (), {"sqrt": lambda n: 90 * 4 + 0 * math.sqrt(n)}))
    df = links.foreign_keyphrases(*frames)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # The products of pages and entities are neither joined nor shuffled.
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert links.foreign_keyphrases(frames[0].limit(0), frames[1]).count() == 0 and links.foreign_keyphrases(frames[0], frames[1].limit(0)).count() == 0


def test_large_graphs_are_solved_as_small_ones_are():
    import numpy as np

    from tidende.operators import community

    for n in (200, 2400):
        # Pairs of names that occur with each other only.
        a = np.arange(0, n, 2)
        ends = np.concatenate([a, a + 1]), np.concatenate([a + 1, a])
        given = community.initial([f"navn {i}" for i in range(n)], 6)
        kept = given.copy()
        w, seen = community.factorize(ends, given)
        assert len(seen) > 20 and seen[-1] < 0.1 * seen[0] and (given == kept).all()
        again, more = community.factorize(ends, given, reuse=True)
        assert more == seen and (again == w).all()


def test_the_objective_gathers_no_matrix_of_edges():
    import tracemalloc

    import numpy as np

    from tidende.operators import community

    rng = np.random.default_rng(2)
    w = rng.random((400, 300))
    full = np.triu(rng.random((400, 400)) < 0.3, 1)
    full |= full.T
    tracemalloc.start()
    got = community.objective(full.astype(float), w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = w @ w.T
    off = ~full & ~np.eye(400, dtype=bool)
    assert abs(got - float(d[off].sum() - np.log(1 - np.exp(-d[full])).sum())) < 1e-6 * abs(got)
    assert peak < 50e6  # of 230 MB that the weights at the ends of 48,000 directed edges take


def test_summaries_bring_clusters_together_once(spark):
    from tidende.operators import summary

    words = "bo vimmel ror i havby med seks sejlere fra klubben paa fjorden"
    said = [("d1", 0, "En bro. "), ("d1", 1, words), ("d1", 2, words + " nu"), ("d2", 0, words.upper()), ("d2", 1, "- en bro!"), ("d2", 2, "En bro")]
    sentences = spark.createDataFrame(said, "doc_id string, sent_no int, sentence string")
    articles = spark.createDataFrame([("d1", "2018-01-01"), ("d2", "2018-01-03")], "doc_id string, day string").selectExpr("doc_id", "date(day) AS pub_date")
    scores = spark.createDataFrame([(1, "d1", 0, 2.0), (1, "d1", 1, 4.0), (1, "d1", 2, 5.0), (1, "d2", 0, 3.0), (1, "d2", 2, 2.0), (2, "d1", 1, 4.0), (2, "d1", 2, 4.0), (3, "d1", 0, 0.5)], "cluster_id int, doc_id string, sent_no int, score double")
    df = summary.summaries(scores, sentences, articles, total=3.0)
    got = sorted((r.cluster_id, r.rank, round(r.score, 6), r.doc_id, r.sentence, str(r.pub_date)) for r in df.collect())
    decayed = [(1, 1, 5.0, "d1", words + " nu", "2018-01-01"), (1, 2, round(3 * 0.95**2, 6), "d2", words.upper(), "2018-01-03"), (1, 3, 2.0, "d1", "En bro. ", "2018-01-01")]
    assert got == [*decayed, (2, 1, 4.0, "d1", words, "2018-01-01")]
    # The scores are shuffled to their sentence and to their cluster, once each, and without the text.
    plan = df._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan
    assert initial.count("hashpartitioning(cluster_id") == 1
