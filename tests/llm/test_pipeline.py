import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnlink.llm import language_id, toxicity
from tarnlink.llm.common import load, materialize
from tarnlink.llm.mixing import mix

from .test_text_dedup import brute_components, brute_lines

SF = "/root/testdata/sf0.001"
WHITE = b" \t\n\x0b\x0c\r"


def n_words(text):
    return len((text or "").encode().translate(bytes.maketrans(WHITE, b" " * len(WHITE))).split())


def brute_language(rows, models):
    """(doc_id, language, probability, accepted) of each row, by the formula; each text by the model that has not seen it."""
    languages, S = models[0].languages, language_id.SMOOTH
    kinds = len(languages)
    read = [(r, *(x[0] for x in models[fold].means([r.text]))) for r, fold in rows]
    votes = {}
    for r, size, m in read:
        own = votes.setdefault(r.source or "", np.zeros(kinds))
        if size and m.argmax() < kinds:
            own[m.argmax()] += 1
    total = sum(votes.values())
    above = (total + S * (total + 1) / (total.sum() + kinds)) / (total.sum() + S)
    out = []
    for r, size, m in read:
        v = votes[r.source or ""]
        score = m * size * language_id.WEIGHT
        score[:kinds] += np.log((v + S * above) / (v.sum() + S) * 0.999)
        score[kinds] += math.log(0.001)
        said = (r.lang or "").lower().split("-")[0]
        if said in languages:
            for i, x in enumerate(languages):
                score[i] += math.log(language_id.DECLARED if x == said else (1 - language_id.DECLARED) / (kinds - 1))
            score[kinds] += math.log(1 / kinds)
        p = np.exp(score - score.max())
        p = (p / p.sum())[:kinds]
        out.append((r.doc_id, languages[p.argmax()] if size else None, p.max() if size else 0.0, bool(size) and p.max() >= 0.5))
    return out


def least_padding(histogram, buckets):
    ends = sorted(histogram)
    best = {0: 0}  # lengths covered -> padding
    for _ in range(buckets):
        new = dict(best)
        for i, pad in best.items():
            cost = pad
            for j in range(i + 1, len(ends) + 1):
                cost = pad + sum(histogram[x] * (ends[j - 1] - x) for x in ends[i:j])
                new[j] = min(new.get(j, cost), cost)
        best = new
    return best[len(ends)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small documents and planted ones: no text, junk, an exact and a near copy, and lines that repeat."""
    docs = load(spark, SF, "documents").select(*corpus_pipeline.COLUMNS)
    texts = docs.where("lang = 'en' and n_chars between 400 and 2000").orderBy("doc_id").limit(2).collect()
    at = docs.agg(F.max("doc_id")).first()[0]
    lines = "\n".join(w * 2 for w in texts[1].text.split()[:8])
    planted = [None, "", "12 34 !!", "zq xv qxz jqk vvx zzq xqj wqx qqz xjx kzq " * 30, texts[0].text, texts[0].text + " and more", lines + "\n" + texts[1].text, texts[1].text[:200] + "\n" + lines]
    # without a declared language, or so small a table would teach the model that junk is English
    rows = [(at + 1 + i, t, None if i < 4 else "en", "planted", len(t or "")) for i, t in enumerate(planted)]
    where = str(tmp_path_factory.mktemp("pipeline"))
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{where}/documents.parquet")
    return where, at


def test_every_stage_is_brute_force(spark, folder):
    where, at = folder
    docs, seen = load(spark, where, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        seen.append(docs.collect())
        out = stage(spark, docs, where)
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        docs = materialize(out, f"test-{name}")
    start, spoken, lined, single, mixed = seen
    packed = docs.collect()

    read = load(spark, where, "documents")
    folds = {r[0]: r[1] for r in read.select("doc_id", language_id.fold_of()).collect()}
    want = brute_language([(r, folds[r.doc_id]) for r in start], language_id.train(read))
    assert {r.doc_id for r in spoken} == {i for i, *_, accepted in want if accepted}
    got = {r.doc_id: r for r in language_id.identify_documents(read).collect()}
    assert all((got[i].language, got[i].accepted) == (x, a) and abs(got[i].probability - p) < 1e-9 for i, x, p, a in want) and len(got) == len(want)
    assert not {r.doc_id for r in spoken} & set(range(at + 1, at + 5))
    assert Counter(spoken) <= Counter(start)

    assert language_id.accept_documents(read.withColumn("doc_id", F.lit(None).cast("long"))).count() > 0
    want = brute_lines([(r.doc_id, r.text) for r in spoken])
    assert {r.doc_id: r.text for r in lined} == {i: t for i, (t, gone) in want.items() if not gone or t.strip(" ")}
    assert all(r.n_chars == len(r.text) for r in lined) and want[at + 8][1] > 0

    comp = brute_components([(r.doc_id, r.text) for r in lined])
    assert {r.doc_id for r in single} == {i for i, (_, c) in comp.items() if i == c} and len(single) < len(lined)
    assert Counter(single) <= Counter(lined)

    tokens = Counter()
    for r in single:
        tokens[r.source or ""] += n_words(r.text) + 1
    widest = max(tokens.values()) / min(tokens.values())
    a = max(0.0, 1 - math.log(2) / math.log(widest)) if widest > 1 else 0.0
    times = Counter(r.doc_id for r in mixed)
    assert set(times) == {r.doc_id for r in single} and set(mixed) == set(single)
    for s, n in tokens.items():
        own = [r for r in single if (r.source or "") == s]
        quota = (n / max(tokens.values())) ** (a - 1) * n
        drawn = sum(times[r.doc_id] * (n_words(r.text) + 1) for r in own)
        assert quota - 1 <= drawn <= quota + 1 + max(n_words(r.text) + 1 for r in own)
        assert max(times[r.doc_id] for r in own) - min(times[r.doc_id] for r in own) <= 1

    sizes = [n_words(r.text) for r in mixed]
    pieces = Counter(min(2048, n - k) for n in sizes for k in range(0, max(1, n), 2048))
    assert Counter(r.n_tokens for r in packed) == pieces
    assert sum(r.n_tokens for r in packed) == sum(sizes)
    pieces.pop(0, None)
    assert sum(r.padded - r.n_tokens for r in packed) == least_padding(pieces, 8)
    batches = Counter((r.bucket, r.shard, r.batch, r.padded) for r in packed)
    assert all(n * padded <= max(16384, padded) for (*_, padded), n in batches.items())
    assert len({(r.bucket, r.shard, r.batch, r.slot) for r in packed}) == len(packed)


def test_run_gives_the_last_stage(spark, folder):
    got = corpus_pipeline.run(spark, folder[0])
    assert {"doc_id", "segment", "n_tokens", "bucket", "batch", "slot"} <= set(got.columns) and got.count() > 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    load(spark, SF, "documents").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_other_columns_with_clashing_names(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    more = docs.withColumns({c: F.lit(9) for c in ("score", "predicted", "y", "part", "language", "accepted", "n", "host", "id", "k1", "t", "c0", "a.b", "fold", "_mask")})
    pick = lambda rows: sorted(map(tuple, rows.collect()))
    assert pick(toxicity.score_toxicity(more, labels.withColumn("y", F.lit(0)))) == pick(toxicity.score_toxicity(docs, labels))
    kept = language_id.accept_documents(more)
    assert kept.columns == more.columns and pick(kept.select("doc_id")) == pick(language_id.accept_documents(docs).select("doc_id"))


def test_repeated_rows_are_one_and_are_drawn_by_the_mixture(spark):
    schema = load(spark, SF, "documents").select(*corpus_pipeline.COLUMNS).schema
    text = lambda w, n: " ".join(f"{w}{i}" for i in range(n))
    many = [(1, text("a", 40), "en", "small", 9)] * 20
    rest = [(2, text("b", 30), "en", "small", 9), (2, text("c", 30), "en", "small", 9), (3, text("d", 9000), "en", "large", 9), (4, None, None, None, 0)]
    near = corpus_pipeline.near_stage(spark, spark.createDataFrame(many + rest, schema), SF)
    assert Counter(map(tuple, near.collect())) == Counter([many[0], *rest])

    # rows without an id are documents like others, through every stage
    lone = [(None, text("n", 30), "en", "small", 9), (None, text("a", 40), "en", "small", 9), (None, text("m", 25), "en", None, 9), (None, text("m", 25) + " x", "en", None, 9)]
    near = corpus_pipeline.near_stage(spark, spark.createDataFrame(many + rest + lone + lone, schema), SF)
    near = Counter(map(tuple, near.collect()))
    assert {r for r in near if r[0] is None} in ({lone[0], lone[2]}, {lone[0], lone[3]}) and max(near.values()) == 1 and near[many[0]] == 1
    mixed = corpus_pipeline.mix_stage(spark, spark.createDataFrame(rest + lone, schema), SF)
    assert {tuple(r) for r in mixed.collect()} == set(rest + lone)
    assert corpus_pipeline.line_stage(spark, spark.createDataFrame(rest + lone, schema), SF).count() == len(rest + lone)

    # one text of doc_id 6 is a copy of doc_id 5, the other is not and stays; no row stays twice
    own = [(6, text("f", 30), "en", "small", 9)]
    near = corpus_pipeline.near_stage(spark, spark.createDataFrame([(5, text("e", 30), "en", "small", 9), *own, *[(6, text("e", 30), "en", "small", 9)] * 5], schema), SF)
    near = Counter(map(tuple, near.collect()))
    assert near[own[0]] == 1 and max(near.values()) == 1

    docs = spark.createDataFrame(many + rest, schema)
    want = Counter((r.doc_id, r.source, r.n_tokens) for r in mix(docs).collect())
    mixed = Counter(map(tuple, corpus_pipeline.mix_stage(spark, docs, SF).collect()))
    assert Counter({k: sum(n for r, n in mixed.items() if (r[0], r[3] or "", n_words(r[1]) + 1) == k) for k in want}) == want
    assert set(mixed) == set(many + rest) and want[1, "small", 41] > 20
    assert abs(mixed[rest[0]] - mixed[rest[1]]) <= 1


def test_tables_return_native_memory(spark, monkeypatch):
    from tarnlink.llm import common

    assert common.trim(spark)
    asked = []
    monkeypatch.setattr(common, "trim", lambda s: asked.append(s))
    assert common.materialize(spark.range(3), "trim-test").count() == 3 and asked
