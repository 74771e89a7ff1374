import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlink.llm import chat_format, language_id, mixing, packing, pivot_search, toxicity

SF = "/root/testdata/sf0.01"


def load(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def brute_padding(histogram, k):
    lengths = sorted(histogram)
    best = None
    for n in range(1, min(k, len(lengths)) + 1):
        for ends in itertools.combinations(lengths, n):
            if ends[-1] == lengths[-1]:
                pad = sum(c * (min(e for e in ends if e >= x) - x) for x, c in histogram.items())
                best = pad if best is None else min(best, pad)
    return best


def test_boundaries_are_optimal():
    r = random.Random(4)
    for _ in range(40):
        h = {r.randrange(1, 60): r.randrange(1, 9) for _ in range(r.randrange(1, 9))}
        for k in (1, 2, 3, 20):
            ends, pad = packing.best_boundaries(h, k)
            assert len(ends) <= k and ends[-1] == max(h)
            assert pad == brute_padding(h, k) == sum(c * (min(e for e in ends if e >= x) - x) for x, c in h.items())


def test_pack_keeps_every_token(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 90)), "n", 3) for i in range(200)] + [(500, None, "n", 3), (501, "", "n", 3), (502, "x " * 5000, "n", 3), (502, "x " * 5000, "n", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, bucket int")
    got = packing.pack(docs, buckets=4, max_length=64, budget=256).collect()
    tokens = {}
    for r in got:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
        assert r.n_tokens <= r.padded <= 64 and r.slot * max(1, r.padded) < 256
    assert tokens == {i: (2 * 5000 if i == 502 else len((t or "").split())) for i, t, _, _ in rows}
    places = [(r.bucket, r.shard, r.batch, r.slot) for r in got]
    assert len(set(places)) == len(places)
    assert packing.pack(docs.where("doc_id < 0")).count() == 0


def test_mix_meets_repetition_limit_and_keeps_all(spark):
    rows = [(i, "w " * (5 + i % 30), f"s{int(math.log2(i + 1))}", 1) for i in range(500)] + [(900, None, None, 1), (901, "a b", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, epoch int").repartition(3)
    got = mixing.mix(docs, max_epochs=3.0).toPandas()
    assert set(got.doc_id) == {r[0] for r in rows}
    tokens = {}
    for _, t, s, _ in rows:
        tokens[s or ""] = tokens.get(s or "", 0) + len((t or "").split()) + 1
    drawn = got.groupby("source").n_tokens.sum()
    epochs = {s: drawn[s] / n for s, n in tokens.items()}
    assert 2.9 < max(epochs.values()) < 3.6 and min(epochs.values()) == 1
    assert not got.duplicated(["doc_id", "epoch"]).any() and got.position.between(0, 1).all()
    for s, part in got.groupby("source"):  # places in an epoch are running sums of tokens: a permutation without gaps
        part = part.sort_values("position")
        assert np.allclose(np.diff(part.position) * round(epochs[s] * tokens[s]), part.n_tokens[:-1], rtol=0.2)


def test_repeated_rows_are_runs(spark):
    rows = [(1, "a " * 3, "s")] * 9000 + [(1, "a " * 5, "s")] * 2 + [(None, "b", "s")] * 3 + [(2, "c " * 60000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(docs, max_epochs=1.5).toPandas()
    assert (got[(got.epoch == 0)].groupby(["doc_id", "n_tokens"], dropna=False).size().sort_index().tolist()) == [9000, 2, 1, 3]
    own = got[got.source == "s"].sort_values("position")
    quota = round((own.n_tokens.iloc[0] if len(own) == 1 else (own.position.diff().iloc[1:] / own.n_tokens.iloc[:-1].to_numpy())).pow(-1).median())
    at = np.rint(own.position * quota).astype(int).to_numpy()
    assert (np.diff(at) == own.n_tokens.to_numpy()[:-1]).all() and len(own) > 12000
    packed = packing.pack(docs, buckets=3).toPandas()
    assert len(packed) == 9000 + 2 + 3 + 30 and not packed.duplicated(["bucket", "shard", "batch", "slot"]).any()


def test_mix_entropy_and_budget(spark):
    docs = spark.createDataFrame([(i, "w " * 9, "a" if i < 90 else "b") for i in range(100)], "doc_id long, text string, source string")
    per = docs.groupBy("source").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / 100)
    a = mixing.solve_exponent(per, None, 0.6, None)
    p = np.array([0.9, 0.1]) ** a
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() - 0.6) < 1e-6
    assert mixing.solve_exponent(per, None, 0.1, None) == 1.0 and mixing.solve_exponent(per, None, 5.0, None) == 0.0
    got = mixing.mix(docs, entropy=5.0, budget_tokens=400).toPandas()
    assert dict(got.source.value_counts()) == {"a": 20, "b": 20}
    assert mixing.mix(docs.where("doc_id < 0")).count() == 0


def brute_top(rows, k, every):
    out = []
    for q, v in rows:
        if q % every == 0:
            best = sorted((-int(np.dot(v, w)), x) for x, w in rows if x != q)[:k]
            out += [(q, i + 1, x, -s) for i, (s, x) in enumerate(best)]
    return sorted(out)


def test_pivot_search_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "CANDIDATES", 60)
    monkeypatch.setattr(pivot_search, "QUERIES", 10)
    monkeypatch.setattr(pivot_search, "STEP", 8)
    r = np.random.default_rng(1)
    centres = r.normal(size=(5, 6)) * 3
    rows = [(i, (centres[i % 5] + r.normal(size=6) * 0.1).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    odd = [(2001, None), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows + odd], "vec_id long, embedding array<double>, rank int").repartition(4)
    want = brute_top([(i, np.floor(np.array(v) * 64)) for i, v in rows], 7, 4)
    assert sorted(map(tuple, pivot_search.top_k(df, k=7, every=4).collect())) == want
    few = df.where("vec_id < 3")
    assert sorted(map(tuple, pivot_search.top_k(few, k=7, every=1).collect())) == brute_top([(i, np.floor(np.array(v) * 64)) for i, v in rows[:3]], 7, 1)
    assert pivot_search.top_k(df.where("vec_id < 0")).count() == 0


def clusters(n, width, seed=2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(16, width)) * 6
    return [(i, (centres[r.integers(16)] + r.normal(size=width) * 0.2).tolist()) for i in range(n)]


def test_pivots_spare_most_candidates(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "CANDIDATES", 500)
    monkeypatch.setattr(pivot_search, "QUERIES", 50)
    monkeypatch.setattr(pivot_search, "RING", 10)
    rows = clusters(4000, 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = pivot_search.top_k(df, k=5, every=100, pivots=24, counted=True).toPandas()
    want = brute_top([(i, np.floor(np.array(v) * 64)) for i, v in rows], 5, 100)
    assert sorted(got[["query_id", "rank", "vec_id", "score"]].itertuples(index=False, name=None)) == want
    assert got.drop_duplicates("query_id").evaluated.mean() < 0.2 * len(rows)


def test_large_products_are_exact_or_refused(spark):
    rows = [(i, [float((7919 * i * j + 12345) % 2**26) for j in range(6)]) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, pivot_search.top_k(df, k=4, every=5).collect()))
    whole = {i: [int(x) * 64 for x in v] for i, v in rows}
    want = []
    for q in (i for i in whole if i % 5 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)[:4]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want) and max(x[3] for x in want) > 2**53
    with pytest.raises(ValueError):
        pivot_search.top_k(spark.createDataFrame([(20, [1e18, 1.0]), (21, [1e18, 0.0])], "vec_id long, embedding array<double>"))


def test_toxicity_held_out(spark):
    docs, labels = (load(spark, x, "/root/testdata/sf0.1") for x in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels)
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    held = got.where("held_out").join(labels, "doc_id").toPandas()
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert held.toxic.sum() > 50 and hit / held.toxic.sum() > 0.85 and hit / held.predicted.sum() > 0.95
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "\U0001f600" * 9), (2, "x" * 100000)], "doc_id long, text string")
    assert toxicity.score_toxicity(odd, labels.where("doc_id < 0")).count() == 4
    assert toxicity.score_toxicity(odd.where("false"), labels).count() == 0


def test_trees_and_isotonic():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = toxicity.Trees().fit(x, y)
    assert ((trees.score(x) > 0) == y).mean() > 0.95
    knots, values = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all()


def test_obfuscated_words_are_found():
    lexicon = {b"idiot": 3.0}
    at = toxicity.NAMES.index("hidden")
    assert toxicity.features(b"you 1d10t", lexicon)[at] == 0.5 and toxicity.features(b"an idiot", lexicon)[at] == 0
    assert toxicity.features(b"", lexicon) == [0.0] * len(toxicity.NAMES)


NONE = "cast(null as string)"


def test_language_id_on_documents_and_pages(spark):
    docs = load(spark, "documents")
    got = language_id.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert got.accepted.mean() > 0.99 and (got.language == got.lang).mean() > 0.97
    # by the text alone, each text by the model that has not seen it
    models = language_id.train(docs)
    blind = docs.selectExpr("doc_id as id", "text", f"{NONE} declared", f"{NONE} hint", f"{NONE} host", "'' domain").withColumn("fold", language_id.fold_of())
    blind = language_id.identify(blind, models).withColumnRenamed("id", "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (blind.language == blind.lang).mean() > 0.95
    pages = load(spark, "pages")
    found = language_id.identify_pages(pages, models).join(pages.select("page_id", language_id.declared_of().alias("l")), "page_id").toPandas()
    assert (found.language == found.l).mean() > 0.97
    # pages of which neither address nor markup tells: the text and the host still do
    bare = pages.withColumn("html", F.regexp_replace("html", r"<html\b[^>]*>", "<html>")).withColumn("url", F.regexp_replace("url", r"/(en|de|fr|es)/", "/x/"))
    found = language_id.identify_pages(bare, models).join(pages.select("page_id", language_id.declared_of().alias("l")), "page_id").toPandas()
    assert (found.language == found.l).mean() > 0.9


def test_language_codes_and_addresses(spark):
    codes = spark.createDataFrame([("EN",), ("en-US",), ("de_AT",), ("fil",), ("english",), ("",), (None,)], "c string")
    assert [r[0] for r in codes.select(language_id.code_of(F.col("c"))).collect()] == ["en", "en", "de", "fil", None, None, None]
    html = spark.createDataFrame([("<html lang='fil'>",), ("<HTML class=x LANG=pt-BR dir=ltr>",), ("<html>",)], "html string")
    assert [r[0] for r in html.select(language_id.declared_of()).collect()] == ["fil", "pt", None]
    urls = spark.createDataFrame([("https://u@a.b.example.DE:80/fr/x",), ("http://x.de/tv/",), ("http://shop.acme.co.uk/en-gb/",), ("http://x.de/abc",), ("nonsense",), (None,)], "url string")
    host = language_id.host_of()
    assert [tuple(r) for r in urls.select(host, language_id.domain_of(host), language_id.hint_of(["de", "en", "fr"])).collect()] == [
        ("a.b.example.de", "example.de", "fr"), ("x.de", "x.de", "de"), ("shop.acme.co.uk", "acme.co.uk", "en"), ("x.de", "x.de", "de"), ("", "", None), ("", "", None)
    ]


def test_language_training_joins_codes_and_is_bounded(spark):
    rows = [(i, f"the words of text {i} are these", ("en", "EN", "en-GB")[i % 3]) for i in range(20)] + [(100 + i, f"die worte von text {i} sind das", "de") for i in range(20)]
    rows += [(100, "die worte", "de")] * 50
    models = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [m.languages for m in models] == [["de", "en"]] * 2
    few = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 5)
    kinds = sum((m.table[0] > np.log(1.5 * language_id.UNSEEN / language_id.GRAMS)).sum() for m in few)
    assert 0 < kinds < 5 * 40


def test_language_id_edges(spark):
    docs = load(spark, "documents")
    models = language_id.train(docs)
    rows = spark.createDataFrame(
        [(1, None, None, None, None, None, 0), (2, "", "en", None, "h", "", 0), (3, "12 34 !!", "en", None, "h", "", 1), (4, "zq xv qxz jqk vvx zzq xqj wqx qqz xjx kzq" * 30, None, None, "h", "", 1), (5, "zz", "xx", "yy", "h", "", None)],
        "id long, text string, declared string, hint string, host string, domain string, fold int",
    )
    got = {r.id: r for r in language_id.identify(rows, models).collect()}
    assert not any(got[i].accepted for i in (1, 2, 3, 4)) and got[2].language is None and len(got) == 5
    assert language_id.identify(rows.where("false"), models).count() == 0


def test_toxicity_sample_bounds_rows(spark, monkeypatch):
    docs, labels, seen = load(spark, "documents"), load(spark, "labels"), []
    old = toxicity.materialize
    monkeypatch.setattr(toxicity, "materialize", lambda df, label, *a: seen.append((label, old(df, label, *a))) or seen[-1][1])
    toxicity.train(docs.crossJoin(spark.range(20).select()), labels, 30)
    assert dict(seen)["toxic-sample"].count() == 30


def test_host_priors_decide_what_text_cannot(spark):
    model = language_id.TextModel(["de", "en"], np.log(np.full((3, language_id.GRAMS), 1 / language_id.GRAMS)))
    model.table[0, :] += 1e-9
    rows = [(i, "abc", None, None, "h", "d", 0) for i in range(50)]
    rows = spark.createDataFrame(rows, "id long, text string, declared string, hint string, host string, domain string, fold int")
    assert {r.language for r in language_id.identify(rows, [model]).collect()} == {"de"}


@pytest.mark.parametrize("a, b, n, prompt, chosen, rejected", [
    ([("user", "q"), ("assistant", "x")], [("user", "q"), ("assistant", "y")], 1, "<|im_start|>user\nq<|im_end|>\n", [("x<|im_end|>", True)], [("y<|im_end|>", True)]),
    ([("user", "q")], [("user", "q"), ("assistant", "y")], 1, "<|im_start|>user\nq<|im_end|>\n", [], [("y<|im_end|>", True)]),
    ([], None, 0, "", [], []),
    ([("user", "a<|im_end|>")], [("user", "b")], 0, "", [("a<| im_end |><|im_end|>", False)], [("b<|im_end|>", False)]),
])
def test_preference_pairs(spark, a, b, n, prompt, chosen, rejected):
    kind = "array<struct<turn: int, role: string, text: string>>"
    side = lambda x: None if x is None else [(i, *t) for i, t in enumerate(x)]
    row = spark.createDataFrame([(1, side(a), side(b), "extra")], f"pair_id long, chosen {kind}, rejected {kind}, prompt string")
    got = chat_format.preference_pairs(row).first()
    bodies = lambda parts: [tuple(p) for p in parts if p.text.endswith("<|im_end|>")]
    assert (got.n_prompt_turns, got.prompt, bodies(got.chosen), bodies(got.rejected)) == (n, prompt, chosen, rejected)


def test_last_answer_pairs_edges(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", "x"), (1, 2, "user", None), (1, 3, "assistant", "y"), (2, 0, None, "z"), (None, 0, "user", "n")], "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat_format.preference_pairs(chat_format.last_answer_pairs(turns)).collect()}
    assert set(got) == {1, 2} and got[1].n_prompt_turns == 3 and got[2].n_prompt_turns == 1
    assert got[1].rejected[1].text == "x<|im_end|>" and got[2].chosen == []
    assert chat_format.last_answer_pairs(turns.where("false")).count() == 0
