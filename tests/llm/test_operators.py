"""The operators against brute force, exact round trips and held-out accuracy."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from tidende.llm import distinctive, encoding, language, mixing, names, neardup, ngrams, sentences, tokenizer

SF = "/root/testdata/sf0.001"


def test_em_against_a_plain_loop():
    rng = np.random.default_rng(0)
    tf = [rng.integers(1, 9, n).astype(float) for n in (5, 1, 12)] + [np.zeros(0)]
    bg = [rng.random(len(t)) / 20 + 1e-4 for t in tf]
    got = distinctive.em_probabilities(tf, bg, 0.5, 500, 1e-12)
    for t, b, g in zip(tf, bg, got, strict=True):
        if not len(t):
            assert not len(g)
            continue
        p = t / t.sum()
        for _ in range(500):
            e = t * 0.5 * p / (0.5 * p + 0.5 * b)
            p = e / e.sum()
        assert np.allclose(p, g, atol=1e-6) and abs(g.sum() - 1) < 1e-9


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data absent")
def test_probabilities_choose_the_candidates(spark):
    from pyspark.sql import functions as F

    scored, _ = distinctive.scored_records(spark.read.parquet(SF.replace("0.001", "0.01") + "/doc2terms.parquet"))
    weight = lambda x: -x["tf"] * (F.log((1 + F.col("n_docs")) / (1 + x["df"])) + 1)
    top = F.array_min(F.transform("terms", lambda x: F.struct(weight(x).alias("w"), x["term"].alias("term"))))["term"]
    left = distinctive.candidates()
    row = scored.select(F.size(left).alias("c"), F.size("terms").alias("n"), F.exists(left, lambda x: x["term"] == top).cast("int").alias("hit")).agg(F.sum("c"), F.sum("n"), F.avg("hit")).first()
    assert row[0] < 0.9 * row[1] and row[2] > 0.95, row


@pytest.mark.parametrize("share", [2, 2_000_000])
def test_suffix_counts_against_counters(spark, monkeypatch, share):
    """All n-grams of all lengths; with the smaller share hardly a term is hot, with the larger one all are."""
    monkeypatch.setattr(ngrams, "HOT_SHARE", share)
    rng = random.Random(1)
    docs = [[rng.choice("abcd" if k % 3 else "ab") for _ in range(rng.randint(0, 30))] for k in range(20)]
    docs += [docs[3], docs[3], ["x", *docs[3][:9], "y"], ["z"] * 12, ["z"] * 7, ["p", "q"] * 8]
    tf, df = Counter(), Counter()
    for doc in docs:
        grams = [ngrams.SEP.join(doc[i : i + n]) for n in range(1, len(doc) + 1) for i in range(len(doc) - n + 1)]
        tf.update(grams)
        df.update(set(grams))
    table = spark.createDataFrame([(f"d{k}", d, None) for k, d in enumerate(docs)], "doc_id string, terms array<string>, run_at timestamp_ntz")
    rows = ngrams.term_statistics(table).collect()
    assert len(rows) == len(tf)
    assert {r.ngram: r.tf for r in rows} == tf and {r.ngram: r.df for r in rows} == df
    assert all(r.n == r.ngram.count(ngrams.SEP) + 1 for r in rows)
    assert {(r.term, r.tf) for r in ngrams.marked_terms(table).collect()} == {(g, n) for g, n in tf.items() if ngrams.SEP not in g}


def brute(bits, sizes, shard, ratio):
    out = set()
    for i in range(len(bits)):
        for j in range(i + 1, len(bits)):
            if shard[i] == shard[j] and np.unpackbits(bits[i] ^ bits[j]).sum() <= ratio * (sizes[i] + sizes[j]) + 1e-9:
                out.add((i, j))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_trie_join_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (12, 64), dtype=np.uint8)
    bits = np.repeat(base, 6, axis=0)
    for row in bits:
        for b in rng.integers(0, 512, rng.integers(0, 40)):
            row[b // 8] ^= np.uint8(1 << (b % 8))
    bits[7] = bits[8]
    sizes, shard = rng.integers(20, 60, 72), rng.integers(0, 3, 72)
    i, j = neardup.trie_pairs(bits, sizes, shard, 1 / 3)
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == brute(bits, sizes, shard, 1 / 3)
    assert len(i) == len(set(zip(i.tolist(), j.tolist(), strict=True)))


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = rng.integers(-(2**62), 2**62, 80)
        b = np.concatenate([a[: rng.integers(0, 80)], rng.integers(-(2**62), 2**62, 30)])
        x, y = (np.frombuffer(neardup.odd_sketch(v).tobytes(), dtype=np.uint8) for v in (a, b))
        assert np.unpackbits(x ^ y).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_near_duplicates_against_sets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "HOT_SHARE", 10)  # the 20 copies are a hot class, and their runs hot ones
    monkeypatch.setattr(neardup, "PARTS", 3)
    rng = random.Random(4)
    docs = []
    for k in range(12):
        words = [f"w{rng.randint(0, 60)}" for _ in range(40)]
        for v in range(5):
            copy = list(words)
            for _ in range(v):
                copy[rng.randrange(40)] = f"n{rng.randint(0, 9)}"
            docs.append((f"{k:02}-{v}", " ".join(copy)))
    docs += [(f"copy{i}", "en to tre fire fem seks") for i in range(20)]
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in docs}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    df = spark.createDataFrame(docs, "doc_id string, text string")
    assert {tuple(r) for r in neardup.alike_documents(df, 0.5, 3).collect()} == want


def test_names_near_each_other_against_all_pairs(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(150)}

    def one_edit(a, b):
        if a == b:
            return False
        edits = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abc"} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abc"} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        return b in edits

    want = {(a, b) for a in words for b in words if one_edit(a, b)}
    got = {tuple(r) for r in names.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == want


def test_name_tokens():
    assert names.name_tokens("Hansen, Anna") == ["anna", "hansen"]
    assert names.name_tokens("Teater i Havby") == ["teater", "havby"]
    assert names.name_tokens("Havby Mejeri A/S") == ["havby", "mejeri"]
    assert names.name_tokens(r"K\xe5re Hansen's") == ["kåre", "hansen"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data absent")
def test_names_against_resolved_links(spark):
    p = spark.read.parquet(SF.replace("0.001", "0.01") + "/priors.parquet")
    got = names.linked_names(p).where("entity is not null").toPandas()
    got["id"] = list(zip(got.org, got.key, got.name, got.middle.fillna(""), strict=True))
    pairs = lambda s: int((s * (s - 1) // 2).sum())
    both = pairs(got.groupby(["entity", "id"]).size())
    assert both / pairs(got.groupby("id").size()) > 0.97 and both / pairs(got.groupby("entity").size()) > 0.9


def test_tokens_in_any_order(spark):
    rows = [("Anna Munk Dalhøj", 5), ("Dalhøj Munk Anna", 1), ("Munk Dalhøj Anna", 1), ("Munk Anna Dalhøj", 2), ("Anna Dalhøj", 3), ("Bo Dalhøj", 4), ("Anna Kær", 4), ("Bo Kær", 3)]
    p = spark.createDataFrame([(m, None) for m, n in rows for _ in range(n)], "mention string, entity string")
    names_of = {r.mention: (r.key, r.name) for r in names.linked_names(p).collect()}
    assert {names_of[m] for m, _ in rows[:4]} == {("dalhøj", "anna")}
    pairs = {tuple(r) for r in names.variant_pairs(p).collect()}
    four = sorted(m for m, _ in rows[:4])
    assert {(a, b) for a in four for b in four if a < b} <= pairs and ("Bo Dalhøj", "Bo Kær") not in pairs


def test_tokenizer_against_the_public_library():
    lib = pytest.importorskip("tokenizers")
    path = f"{tokenizer.TOKENIZERS}/byte_bpe_50k.json"
    if not os.path.exists(path) or not hasattr(lib, "Tokenizer"):
        pytest.skip("vocabulary absent")
    t = lib.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rng = random.Random(6)
    texts = ["", " ", "<|endoftext|>", "a" * 3000, "Hr. Ærø's  hus\n\n!", "中文字😀" * 50] + ["".join(chr(rng.choice([32, 65, 97, 48, 0x301, 0x4E2D, 0x1F600, 10, 39, 115, 0xE5])) for _ in range(40)) for _ in range(300)]
    bpe = tokenizer.ByteBPE(tokenizer.load())
    assert [bpe.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_garbling_is_found_and_undone(spark):
    base = [f"Den {k}. dag sælger høringen mælken på øen, og købmanden står på gården i nærheden." for k in range(40)]
    docs = [(f"c{k}", t) for k, t in enumerate(base)] + [(f"d{k}", t) for k, t in enumerate(base)]
    kinds = [("utf-8", "latin-1"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("cp850", "cp1252"), ("mac_roman", "latin-1"), ("cp1252", "cp850")]
    bad = {}
    for k, (w, r) in enumerate(kinds):
        for j in range(3):
            text = base[k * 3 + j].replace("sælger", "sælger") + (" Der er fælles mål på øen." if j == 2 else "")
            docs.append((f"g{k}{j}", text.encode(w).decode(r)))
            bad[f"g{k}{j}"] = text
    docs += [("lost", base[5].replace("mælken", "m�lken")), ("ok1", "SÃO DUARTE og ÂME ved 21 °C og 7 µg pr. m³"), ("ok2", "»Åh,« sagde Ænon fra Õrevälja")]
    bad["lost"] = base[5]
    got = {r.doc_id: r.restored for r in encoding.garbled_records(spark.createDataFrame(docs, "doc_id string, text string")).collect()}
    assert set(got) == set(bad)
    assert sum(got[k] == v for k, v in bad.items()) >= len(bad) - 3


def test_any_single_byte_code_page_is_learned(spark):
    base = [f"Den {k}. dag sælger høringen mælken på øen, og købmanden står på gården i nærheden." for k in range(40)]
    docs = [(f"c{k}", t) for k, t in enumerate(base)] + [(f"d{k}", t) for k, t in enumerate(base)]
    docs += [("ru", "Театр закрыть не хочет ёлка."), ("el", "Το μουσείο πρέπει να κλείσει.")]
    # Of the last one no twin sentence is in the table.
    bad = {"cp1251": base[1], "cp1253": base[2], "iso8859_7": base[3], "cp1250": base[4], "koi8_r": "En sætning om mælken står på øen."}
    docs += [(k, t.encode("cp1252").decode(k)) for k, t in bad.items()]
    got = {r.doc_id: r.restored for r in encoding.garbled_records(spark.createDataFrame(docs, "doc_id string, text string")).collect()}
    assert got == bad
    readers, pairs = encoding.infer(Counter(encoding.explanations("ш", "ø") + encoding.explanations("ГҐ", "å")))
    assert "cp1251" in readers and ("cp1252", "cp1251") in pairs


def test_copies_of_a_garbled_text_do_not_hide_it(spark):
    text = "Købmanden på gården sælger mælken ved søen, og tårnet åbner først når børnene står på øen."
    clean = [(f"c{k}", f"Den {k}. bil kører langs vejen mod byen, så man kan nå den.") for k in range(20)] + [("one", text)]
    seen = [(f"s{k}", "Mælken er god.") for k in range(3)]
    garbled = text.encode("cp1252").decode("cp850")
    copies = {f"g{k}": text for k in range(15)}
    docs = clean + seen + [(k, garbled) for k in copies]
    got = {r.doc_id: r.restored for r in encoding.garbled_records(spark.createDataFrame(docs, "doc_id string, text string")).collect()}
    assert got == copies
    # No twin sentence, but more sentences with the clean word than the one that is copied.
    model = encoding.Model([], [("cp1252", "cp850")])
    docs = [(f"g{k}", "Hun bor ved søen.".encode("cp1252").decode("cp850")) for k in range(15)] + [("a", "Nu er søen kold."), ("b", "I dag er søen varm."), ("c", "Hvor er søen?")]
    got = encoding.garbled_records(spark.createDataFrame(docs, "doc_id string, text string"), model).collect()
    assert {r.restored for r in got} == {"Hun bor ved søen."} and len(got) == 15
    # Of two twins, the one whose marks are at the ends of words is the clean one.
    docs = [("clean", "Sie fragte ihn dann: „Warum gerade jetzt?“"), ("bad", "Sie fragte ihn dann: äWarum gerade jetzt?“")]
    model = encoding.Model([], [("cp850", "cp1252")])
    assert not encoding.garbled_records(spark.createDataFrame(docs, "doc_id string, text string"), model).count()


def test_lost_letters_come_back_from_words(spark):
    docs = [(f"c{k}", f"Den {k}. dag hører vi børn i BØRNEHALLEN, og Møde nr. {k} er på søen.") for k in range(5)]
    docs += [("two", "såen"), ("bad", "Nu h�rer de B�RNEHALLEN og m��de, s�en og x�q.")]
    got = {r.doc_id: r.restored for r in encoding.garbled_records(spark.createDataFrame(docs, "doc_id string, text string")).collect()}
    # "s�en" is one word five times of six, too few; "x�q" is none.
    assert got == {"bad": "Nu hører de BØRNEHALLEN og møde, s�en og x�q."}


def test_sentence_statistics_do_not_change_with_copies(spark):
    texts = ["Han kom ca. 7 gange. Hun gik kl. 8 hjem. Men hr. Hansen blev.", "Vi var ca. ti. Hun sang. Men det gik.", "Det var kl. 9. Hun lo, og hun gik."]
    abbr = spark.createDataFrame([("kl.",)], "abbr string")
    one = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "doc_id string, text string")
    ten = spark.createDataFrame([(f"{c}-{k}", t) for c in range(10) for k, t in enumerate(texts)], "doc_id string, text string")
    assert sentences.corpus_statistics(one, abbr) == sentences.corpus_statistics(ten, abbr)


def spans(text, **kw):
    corpus = sentences.Corpus({"dr": 0.0, "kl": 0.0, "nr": 0.0, "m.v": 0.9, "bl.a": 0.0, "ca": 0.0, **kw}, {"kl": 1.0, "nr": 1.0, "ca": 1.0, "m.v": 0.0}, frozenset({"der", "hun"}))
    return [text[a:b] for a, b in sentences.Splitter(corpus).spans(text)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Overskrift uden punktum\n", "Første sætning. ", "Anden sætning.. ", "Tredje..."],
        ["Dr. Hansen kom kl. 7.30 til nr. 5. ", "Hun gik."],
        ["Vi har mad, drikke m.v. ", "Der kom flere."],
        ["”Vi er sen.” ", "»Er det slut?« spurgte hun. ", "(Det gælder ikke.) ", "Nej!"],
        ["Den er lukket.", "Der er 3. kvartal 1985. ", "P. L. Hansen kom."],
        ["„Warum gerade jetzt?“, fragte er am 21. Mai um 8 Uhr. ", "Ja."],
        ["「学校は駅を支持した。」と隣人は述べた。", "ついに港が売った！"],
        ["“博物馆不会支持。”一位居民说。", "剧院关闭？"],
        ["ชาวบ้านใช้เงิน 718 ล้านบาท ", "ชาวนารอ"],
        ["डॉ. Hansen ने कहा। ", "क्या?"],
        ["Γιατί όχι; ", "Ο κ. Hansen ρωτά."],
    ],
)
def test_sentences(parts):
    assert spans("".join(parts)) == [p.strip() for p in parts]


def test_offsets_of_garbled_text():
    text = "Der er øl. Så »nej«."
    garbled = text.encode().decode("latin-1")
    at = sentences.offsets(garbled, text, [encoding.decode_table("latin-1")])
    assert [garbled[at[a] : at[b]] for a, b in ((0, 10), (11, 20))] == [text[:10].encode().decode("latin-1"), text[11:].encode().decode("latin-1")]


def test_flow_reaches_targets_and_spreads_the_rest():
    got = mixing.route({("a",): 1000, ("b",): 100, ("c",): 2000}, {"a": (0.4, 2), "b": (0.3, 2), "c": (0.3, 1)}, 3100)
    assert sum(got.values()) == 3100 and got[("b",), "b"] == 200
    assert got[("c",), "c"] <= 2000 and got[("a",), "a"] <= 2000 and got[("a",), "a"] > got[("c",), "c"]
    both = mixing.route({("a", "b"): 100, ("b",): 100}, {"a": (0.5, 1), "b": (0.5, 1)}, 200)
    assert both[("a", "b"), "a"] == 100 and both[("b",), "b"] == 100


def test_flow_takes_what_the_repeats_allow():
    # Nine tenths of the target have no documents; the repeats of the rest reach the total.
    got = mixing.route({("a",): 1000}, {"a": (0.1, 10), "gone": (0.9, 1)}, 10_000)
    assert got == {(("a",), "a"): 10_000}
    # Small quotas; and a share of 0 gives nothing.
    assert sum(mixing.route({("a",): 1_000_000, ("b",): 10}, {"a": (0.01, 1), "b": (0.99, 1)}, 1_000_010).values()) == 1_000_010
    assert mixing.route({("a",): 1_000_000, ("b",): 10}, {"a": (0.0, 1), "b": (1.0, 1)}, 1_000_010) == {(("a",), "a"): 0, (("b",), "b"): 10}


def test_texts_of_several_sources(spark):
    docs = [(1, "samme tekst", "A"), (2, "samme tekst", "b "), (3, "anden tekst", "a"), (4, None, "a"), (5, "uden kilde", None)]
    got = mixing.distinct_texts(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert {(r.doc_id, tuple(r.sources)) for r in got} == {(1, ("a", "b")), (3, ("a",)), (5, ())}


def test_mix_is_seeded_and_capped(spark):
    docs = [(i, ["a"] if i % 10 else ["b"], 7) for i in range(1000)] + [(5000, [], 9)]
    sized = spark.createDataFrame(docs, "doc_id long, sources array<string>, tokens long")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3)], "source string, target_share double, max_repeats int")
    one = sorted(map(tuple, mixing.mix(sized, targets, sized=sized).collect()))
    assert one == sorted(map(tuple, mixing.mix(sized, targets, sized=sized).collect()))
    used = Counter()
    for _, s, times, n in one:
        assert times <= {"a": 1, "b": 3}[s]
        used[s] += times * n
    assert used["b"] == 2100 and abs(used["a"] + used["b"] - 7009) <= 14


def labelled_texts():
    path = SF.replace("0.001", "0.01") + "/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test data absent")
    import pandas as pd

    docs = pd.read_parquet(path).dropna(subset=["text", "lang"])
    return [(r.lang, language.clean(r.text)) for r in docs[docs.lang.isin(["da", "nb", "sv", "de", "en", "fr", "pl"])].itertuples() if r.text.strip()]


def test_wrong_labels_do_not_confirm_themselves():
    # Pure documents, by models that never saw them; then every tenth gets a wrong label.
    docs = [(lang, [p for p in language.segments(t) if len(p) > 30]) for lang, t in labelled_texts()]
    docs = [d for d in docs if len(d[1]) > 2]
    _, held = language.cross_fit(docs)
    langs = sorted({lang for lang, _ in docs})
    best = held.cost.argmin(axis=1)
    pure = [k for k in range(len(docs)) if (best[held.doc == k] == langs.index(docs[k][0])).all()]
    assert len(pure) > 300
    rng = random.Random(7)
    wrong = [(rng.choice([x for x in langs if x != docs[k][0]]) if rng.random() < 0.1 else docs[k][0], docs[k][1]) for k in pure]
    models = language.calibrate(*language.cross_fit(wrong))
    found = [{lang for _, lang, _ in x if lang} for x in language.judge_all(models, [" ".join(docs[k][1]) for k in pure])]
    right = sum(f == {docs[k][0]} for f, k in zip(found, pure, strict=True))
    assert right / len(pure) >= 0.98


def test_languages_held_out():
    texts = labelled_texts()
    models = language.calibrate(*language.cross_fit([(lang, language.segments(t)) for lang, t in texts[::2]]))
    total = right = 0
    for (lang, _), found in zip(texts[1::2], language.judge_all(models, [t for _, t in texts[1::2]]), strict=True):
        size = Counter()
        for part, x, _ in found:
            size[x] += len(part)
        if size:
            total += 1
            right += size.most_common(1)[0][0] == lang
    # Some labels are wrong on purpose.
    assert right / total > 0.9


def test_segments_and_their_languages():
    da = ["Det er en meget god dag i byen, og hun har boet her længe.", "Han kom kl. 7 til nr. 5 og gik hurtigt igen med det samme.", "Der er mange huse på vejen, som ingen vil købe."] * 30
    en = ["The house is very old and the street is long, she said.", "There are many people who want to live in this town.", "He came back from the market with apples and bread."] * 30
    models = language.calibrate(*language.cross_fit([(x, [p]) for x, ps in (("da", da), ("en", en)) for p in ps]))
    models.short, models.reject = frozenset({"kl", "nr", "hr"}), np.inf  # three sentences say nothing about usual costs
    assert language.segments("Hr. Hansen kom kl. 7. Han gik. Nej", models.short) == ["Hr. Hansen kom kl. 7.", "Han gik.", "Nej"]
    mixed = "Der er mange huse på vejen, og hun har boet her længe. There are many people who want to live in this town. Han gik hurtigt igen med det samme."
    assert [x[1] for x in language.judge(models, mixed)] == ["da", "en", "da"]
    quoted = "Der er mange huse på vejen, og hun har boet her længe. ”There are many people”. Han gik hurtigt igen med det samme."
    assert [x[1] for x in language.judge(models, quoted)] == ["da"]
    assert language.judge(models, None) == [] and language.judge(models, "😀 !!") == []
    # A part longer than a block costs what its halves cost.
    part = " ".join(en)
    whole = language.segment_costs(models, [part])[0]
    language.BLOCK, kept = 1_000, language.BLOCK
    try:
        assert np.allclose(language.segment_costs(models, [part])[0], whole, rtol=1e-4)
    finally:
        language.BLOCK = kept


def test_probabilities_sum_to_one():
    texts = {"x": ["abab abba baba"] * 3, "y": ["cdcd dccd"] * 3}
    models = language.fit(texts)
    assert np.exp(models.grams[0].values[:, 0]).sum() < 1.0 + 1e-6
    assert models.grams[1].find(np.append(models.grams[1].keys, np.uint64(5))).tolist() == [*range(len(models.grams[1].keys)), -1]
    costs, _ = language.segment_costs(models, ["abba", "dcdc"])
    assert costs[0].argmin() == 0 and costs[1].argmin() == 1


def test_models_learn_from_every_labelled_text(spark):
    # More documents than any sample, each with a word of its own at its end.
    words = ["".join("bdfgklmnprstv"[k // 13**i % 13] + "aeiou"[k // 5**i % 5] for i in range(3)) for k in range(400)]
    common = {"da": "Der er mange huse på vejen, og hun har boet her længe. ", "en": "There are many people who want to live in this town. "}
    texts = [(k, common[lang] * 32 + f"{common[lang][:-2]} {w}.", lang) for k, w in enumerate(words) for lang in [("da", "en")[k % 2]]]
    docs = spark.createDataFrame([*texts, (400, "Ring kl. 7 og kl. 8 og kl. 9", "da")], "doc_id long, text string, lang string")
    models = language.train(docs, spark.createDataFrame([("da", "da"), ("en", "en")], "label string, lang string"))
    for k, w in enumerate(words):
        i = models.grams[4].find(language.gram_keys(language.codes(w), 5))
        assert (i >= 0).all(), (k, w)
    assert "kl" in models.short
    assert language.form_counts(["رغم الطقس. المستشفى f.eks. her"]) == {"رغم": [0, 0, 0, 1], "f.eks": [1, 0, 0, 0]}
    assert [x[1] for x in language.judge(models, common["da"] * 2)] == ["da"]


def test_engine_fits_and_calibrates_as_memory_does(spark):
    # Every language but one in both folds; that one is learned from its only text.
    cut = [(k % 2, lang, [language.plain(p) for p in language.segments(t) if len(p) > 20]) for k, (lang, t) in enumerate(labelled_texts()[:80])]
    docs = [d for d in cut if d[2] and d[1] != "pl"] + [(0, "pl", [language.plain("Było to dawno temu, a on wcale nie przyszedł.")])]
    rows = [(fold, lang, parts, [len(p) for p in parts], [0] * len(parts), [k % 7 != 3 for k in range(len(parts))]) for fold, lang, parts in docs]
    table = spark.createDataFrame(rows, language._DOC).coalesce(1)
    langs = sorted({lang for _, lang, _ in docs})
    models = language.fit_all(table, langs, [0, 1, language.WHOLE])
    for m, made in models.items():
        texts = {lang: [p for fold, x, parts, _, _, kept in rows for p, use in zip(parts, kept, strict=True) if x == lang and use and fold != m] for lang in langs}
        texts = {lang: found or [p for _, x, parts in docs for p in parts if x == lang] for lang, found in texts.items()}
        plain = language.fit(texts)
        for a, b in zip(plain.grams + plain.contexts, made.grams + made.contexts, strict=True):
            assert np.array_equal(a.keys, b.keys) and np.array_equal(a.start, b.start) and np.allclose(a.values, b.values, rtol=1e-5)
    found = language.calibrate_all(models[language.WHOLE], language.judged(table, {m: models[m] for m in (0, 1)}))
    docs.sort(key=lambda d: d[0])
    owner = np.repeat(np.arange(len(docs)), [len(d[2]) for d in docs])
    label = np.array([langs.index(d[1]) for d in docs])[owner]
    parts = {m: [p for fold, _, parts in docs for p in parts if fold == m] for m in (0, 1)}
    cost, size = (np.concatenate(x) for x in zip(*(language.segment_costs(models[m], parts[m]) for m in (0, 1)), strict=True))
    main, _ = language.verdicts(owner, label, cost, np.array([len(p) for m in (0, 1) for p in parts[m]]))
    same = language.calibrate(language.fit({lang: ["a b"] for lang in langs}), language.HeldOut(owner, main, cost, size))
    assert np.allclose([found.odds, found.scale, found.reject], [same.odds, same.scale, same.reject])
    assert np.allclose(found.usual, same.usual) and np.allclose(found.spread, same.spread)
