"""Every registered query of the core on the smallest test data, against its SQL where it has one."""

import os

import pytest

import compare
from tidende.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test data absent")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, sf, name):
    assert compare.compare(spark, sf, name).startswith("ok")


def rows(spark, sf, name):
    return registry.QUERIES[name](spark, sf).collect()


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(registry.QUERIES) - set(registry.SQL) == {"community_nmf", "sentence_score", "summary_topk", "line_split", "line_merge", "metro_map", "keyphrase_simscore", "graph_disambiguate"}


def test_scores_against_a_plain_loop(spark, sf):
    """Keyphrase similarities worked out from the collected tables, pair by pair."""
    import itertools

    from pyspark.sql import functions as F

    from tidende.functions import text
    from tidende.operators import prior, similarity
    from tidende.plans import linking
    from tidende.plans.base import articles

    got = {(r.doc_id, r.mention, r.entity): r.similarity for r in rows(spark, sf, "keyphrase_simscore")}
    assert got
    phrases = similarity.without_stop_words(similarity.keyphrase_words(linking._keyphrases(spark, sf)), linking.STOP)
    p = linking._prior(spark, sf)
    found = prior.genitive_names(prior.genitive_fallback(prior.candidates(linking.mentions(spark, sf), p), p), p)
    wanted = found.where("entity is not null").select("entity").distinct()
    own = phrases.join(wanted, "entity", "left_semi")
    weights = {(r.entity, r.word): r.weight for r in similarity.npmi_weights(own, linking._inlinks(spark, sf).join(wanted, "entity", "left_semi")).collect()}
    by_entity: dict = {}
    for r in own.collect():
        by_entity.setdefault(r.entity, []).append(r.words)
    docs = {r.doc_id: r.w for r in articles(spark, sf).select("doc_id", text.plain_tokens(F.regexp_replace("text", r"\s+", " ")).alias("w")).collect()}

    def score(doc, entity):
        seen, total = set(), 0.0
        for phrase in sorted(by_entity.get(entity, [])):
            left = [w for i, w in enumerate(phrase) if (i == 0 or w not in linking.STOP) and w not in seen]
            matched = [w for w in dict.fromkeys(left) if w and w in doc]
            if not matched:
                continue
            span = min(max(c) - min(c) + 1 for c in itertools.product(*[[i for i, w in enumerate(doc) if w == m] for m in matched]))
            whole = sum(weights.get((entity, w), 0.0) for w in dict.fromkeys(left))
            seen.update(left)
            if whole:
                total += len(matched) / span * (sum(weights.get((entity, w), 0.0) for w in matched) / whole) ** 2
        return total

    want = {}
    groups: dict = {}
    for r in found.where("entity is not null").collect():
        groups.setdefault((r.doc_id, r.mention), []).append((r.entity, r.prior))
    for (doc, mention), options in groups.items():
        if max(x[1] for x in options) > 0.8:
            top = min(options, key=lambda x: (-x[1], x[0]))[0]
            want |= {(doc, mention, e): float(e == top) for e, _ in options}
        else:
            raw = {e: score(docs[doc], e) if doc in docs else 0.0 for e, _ in options}
            total = sum(raw.values())
            want |= {(doc, mention, e): (s / total if total else 1.0) for e, s in raw.items()}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_every_mention_is_resolved_once(spark, sf):
    from tidende.plans.base import mentions

    got = rows(spark, sf, "graph_disambiguate")
    keys = {(r.doc_id, r.mention) for r in mentions(spark, sf).select("doc_id", "mention").distinct().collect()}
    assert len(got) == len(keys) and {(r.doc_id, r.mention) for r in got} == keys
    scored = {(r.doc_id, r.mention): set() for r in got}
    for r in rows(spark, sf, "keyphrase_simscore"):
        scored[r.doc_id, r.mention].add(r.entity)
    assert all(r.entity in scored[r.doc_id, r.mention] if scored[r.doc_id, r.mention] else r.entity is None for r in got)


def test_communities_make_the_graph_likelier(spark, sf):
    """Names that were found together more often share a community more often than any two names do."""
    from tidende.operators import community
    from tidende.plans import maps

    members: dict = {}
    for r in rows(spark, sf, "community_nmf"):
        assert r.weight > community.FLOOR
        members.setdefault((r.slice, r.term), set()).add(r.cluster_id)
    terms = maps._entity_terms(spark, sf)
    edges = {(r.slice, r.term_a, r.term_b) for r in community.cooccurrence(terms, share=0.0).collect()}
    share = lambda pairs: sum(bool(members.get((s, a), set()) & members.get((s, b), set())) for s, a, b in pairs) / max(1, len(pairs))
    names: dict = {}
    for s, a, b in edges:
        names.setdefault(s, set()).update((a, b))
    other = [(s, a, b) for s, x in names.items() for a in x for b in x if a < b and (s, a, b) not in edges]
    assert share(edges) >= share(other) and share(edges) > 0.9


def test_summaries_and_lines_hold_together(spark, sf):
    scores = rows(spark, sf, "sentence_score")
    assert all(r.score > 0 for r in scores) and len({(r.cluster_id, r.doc_id, r.sent_no) for r in scores}) == len(scores)
    top = rows(spark, sf, "summary_topk")
    by: dict = {}
    for r in sorted(top, key=lambda r: (r.cluster_id, r.rank)):
        by.setdefault(r.cluster_id, []).append(r)
    for found in by.values():
        assert [r.rank for r in found] == list(range(1, len(found) + 1)) and len(found) <= 3
        assert all(x.score >= y.score for x, y in zip(found, found[1:], strict=False)) and sum(r.score for r in found) >= 3.0 and found[-1].score >= 1.0
    split, merged = rows(spark, sf, "line_split"), rows(spark, sf, "line_merge")
    key = lambda rs: {(r.entity, r.cluster_id, r.station_date) for r in rs}
    assert key(split) == key(merged) and {r.cluster_id for r in split} <= set(by)
    n: dict = {}
    for which, rs in (("split", split), ("merged", merged)):
        for r in rs:
            n.setdefault((r.entity, which), {}).setdefault(r.line_no, []).append(r.station_date)
    for (entity, which), lines in n.items():
        assert sorted(lines) == list(range(len(lines)))
        assert len(lines) <= len(n[entity, "split"]) or which == "split"
        if which == "merged":
            days = [min(x) for _, x in sorted(lines.items())]
            assert days == sorted(days)
    for r in rows(spark, sf, "metro_map"):
        lines = r.text.split("\n")
        k = int(lines[0])
        assert k <= 3 and lines[1].startswith(f"clusternr: {r.cluster_id}") and "-".join(lines[2 + k : 5 + k]) == str(r.station_date)
        assert len(lines) == 6 + k + int(lines[5 + k]) and len(lines) - 6 - k <= 4


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["mention", "entity", "n", "prior"] and df.count() > 0
