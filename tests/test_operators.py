import zlib

import duckdb
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from tarnlink.functions import tokens
from tarnlink.operators import decide, features, fusion, metrics, mining, models, postings, relational, sampling, search, validate
from tarnlink.plans import catalog, linkage
from tarnlink.session import settled
from tarnlink.sources import tsv
from tarnlink.streaming import online

from .oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, catalog.queries()[name], catalog.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"pair_scorer", "gbt_linkage"}))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() >= 0


def test_tsv_round_trip(spark, tmp_path):
    rows = [("S2-1", 'a "q" b', "x\ty", "US"), ("S3-2", "", "null", ""), ("S2-3", "é\nz", "N/A", "IN")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in tsv.SOURCE))
    tsv.write_tsv(df.coalesce(1), str(tmp_path / "t"))
    back = tsv.read_tsv(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert [r[0] for r in back.select(tsv.source_of()).distinct().orderBy(F.col("substring_index(entity_id, -, 1)")).collect()] == ["S2", "S3"]
    tsv.write_json(spark, {"b": "é", "a": 1}, str(tmp_path / "j.json"))
    tsv.write_json(spark, {"a": 2}, str(tmp_path / "k.json"))
    assert tsv.read_json(spark, str(tmp_path / "j.json"), str(tmp_path / "k.json")) == {"a": 2, "b": "é"}
    tsv.write_hits(spark.createDataFrame([(1, 0.12345)], "q long, score double"), str(tmp_path / "h"))
    assert spark.read.text(str(tmp_path / "h")).where("value like '%0.1235' or value like '%0.1234'").count() == 1


def test_fold_is_crc32_parity(spark):
    ids = [f"S1-{i}" for i in range(50)]
    got = spark.createDataFrame([(x, None) for x in ids], "o string, e string").select("o", sampling.fold(F.col("e"), F.col("o")).alias("f")).collect()
    assert all(r.f == "AB"[zlib.crc32(r.o.encode()) % 2] for r in got)


def test_split_keeps_records_with_their_entity(spark):
    e = spark.createDataFrame([(f"S1-{i}",) for i in range(300)], "s1 string")
    r = spark.createDataFrame([(f"S2-{i}", f"S1-{i % 300}" if i % 3 else "") for i in range(900)], "id string, s1 string")
    a, b = sampling.entity_split(e, r, "s1", "id", 0.2)
    assert b.where("s1 <> ''").join(a.withColumnRenamed("is_eval", "x"), "s1").where("x <> is_eval").count() == 0
    assert 30 < a.where("is_eval").count() < 90
    same = sampling.entity_split(e.repartition(7), r, "s1", "id", 0.2)[0]
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, a.collect()))


def test_fusion_ties_and_missing(spark):
    rows = [(1, "b", 1, 10, 0.5), (1, "a", 1, 20, 0.9), (1, "a", 2, 10, 0.1), (2, "b", 1, 5, 0.3)]
    got = fusion.fuse(spark.createDataFrame(rows, "query_id long, method string, rank int, s1_id long, score double"), ["a", "b"]).collect()
    by = {(r.query_id, r.s1_id): r for r in got}
    assert by[1, 10].fused_rank == 1 and abs(by[1, 10].rrf - 1 / 61 - 1 / 62) < 1e-12 and by[2, 5].a_score is None
    assert by[1, 20].fused_rank == 2 and by[1, 20].b_rank is None


def test_macro_f05(spark):
    truth = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (None, 30), (None, 40)], "query_id long, s1_id long")
    guess = spark.createDataFrame([(1, 10), (3, 10), (9, 30)], "query_id long, best_s1 long")
    r = metrics.macro_f05(guess, truth).first()
    assert abs(r.f05 - (1.25 * 1 / (0.25 * 2 + 2) + 0 + 0 + 1) / 4) < 1e-12 and r.entities == 4
    perfect = truth.where("query_id is not null").withColumnRenamed("s1_id", "best_s1")
    assert metrics.macro_f05(perfect, truth).first().f05 == 1.0


def plain_decide(ps, miss):
    ps = sorted(ps, reverse=True)
    best, none = (0.0, 0), 1.0
    for p in ps:
        none *= 1 - p
    for k in range(1, len(ps) + 1):
        v = 1.25 * sum(ps[:k]) / (0.25 * (sum(ps) + miss) + k)
        if v > best[0] + 1e-12:
            best = (v, k)
    return best[1] if best[0] > none else 0


def test_expected_f05(spark):
    groups = {1: [0.9, 0.8, 0.1], 2: [0.05, 0.03], 3: [1.0, 0.5], 4: [0.3, 0.3, 0.3]}
    rows = [(100 * g + i, g, p) for g, ps in groups.items() for i, p in enumerate(ps)]
    got = decide.expected_f05(spark.createDataFrame(rows, "query_id long, best_s1 long, p double")).groupBy("best_s1").count().collect()
    assert {r[0]: r[1] for r in got} == {g: n for g, ps in groups.items() if (n := plain_decide(ps, 0.5))}


def test_baseline_and_error_groups(spark):
    fused = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (2, 20, 1), (3, 30, 1)], "query_id long, s1_id long, fused_rank int")
    best = metrics.baseline(fused)
    truth = spark.createDataFrame([(1, 20), (2, 20), (3, 31), (None, 7)], "query_id long, s1_id long")
    got = {r.query_id: r.error_group for r in metrics.error_groups(best, fused, truth, -1.0).collect()}
    assert got == {1: "wrong_top", 2: "accepted", 3: "not_retrieved"}
    r = metrics.pair_metrics(best, truth, -1.0).first()
    assert (r.accepted, r.correct) == (3, 1) and abs(r.recall - 1 / 3) < 1e-12


def test_validator_finds_each_fault(spark):
    key = "source1_entity_id string, matched_entity_ids string"
    good = [("S1-1", "S2-1,S3-2"), ("S1-2", "")]
    need = spark.createDataFrame([("S1-1",), ("S1-2",)], "source1_entity_id string")
    issues = lambda rows, c=None: {r.kind: (r.level, r.n) for r in validate.output_issues(spark.createDataFrame(rows, key), need, "matched_entity_ids", candidates=c).collect()}
    assert issues(good) == {}
    assert issues([*good, ("S1-2", "")]) == {"duplicate_row": ("ERROR", 1)}
    assert issues([("S1-1", "S2-1,S2-1"), ("S1-2", "S1-9")]) == {"repeated_id": ("ERROR", 1), "s1_id": ("ERROR", 1)}
    assert issues([("S1-1", "X-1"), ("S1-3", "")]) == {"bad_prefix": ("ERROR", 1), "missing_s1": ("ERROR", 1), "unknown_s1": ("ERROR", 1)}
    few = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "")], "source1_entity_id string, candidate_entity_ids string")
    assert issues(good, few) == {"match_not_candidate": ("WARNING", 1)}
    lines = spark.createDataFrame([("a\tb",), ("broken",), ("",)], "value string")
    assert {r.kind: r.n for r in validate.raw_line_issues(lines, "x\ty").collect()} == {"malformed": 1, "header": 1}
    with pytest.raises(ValueError):
        validate.require_unique(spark.createDataFrame([(1,), (1,)], "q long"), "q")


def test_lookup_fails_on_missing_keys(spark):
    a = spark.createDataFrame([(1,), (2,)], "k long")
    with pytest.raises(Exception, match="has no row"):
        relational.lookup(a, a.where("k = 1").withColumn("v", F.lit(1)), ["k"]).collect()
    with pytest.raises(ValueError):
        tsv.aligned_vectors(a, a.where("k = 1").withColumn("v", F.lit(1)), "k")


def test_variants(spark):
    rows = [("shree ram traders", "sri ram traders")] * 3 + [("sri x", "sri x")]
    got = mining.variants(spark.createDataFrame(rows, "a string, b string"), "a", "b", 3).collect()
    assert [(r.variant, r.canonical, r.pairs, r.same, r.precision) for r in got] == [("sri", "shree", 3, 1, 0.75)]


def test_slabs_equal_postings(spark):
    rows = [(i, t, 1.0 + (i * 7 + len(t)) % 3) for i in range(40) for t in ("a", "bb", "ccc", "dddd")[: 1 + i % 4]]
    p = spark.createDataFrame(rows, "id long, term string, weight double")
    q, s = p.withColumnRenamed("id", "q"), p.withColumnRenamed("id", "s")
    a = search.top_k(search.posting_scores(q, s, "q", "s"), 5, "q", "s").select("q", "s", "rank").collect()
    b = search.slab_scores(q, s, "q", "s", 5, 3).select("q", "s", "rank").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_slabs_copy_queries_by_index_tiles_only(spark):
    rows = [(i, t, 1.0 + (i * 7 + len(t)) % 3) for i in range(40) for t in ("a", "bb", "ccc", "dddd")[: 1 + i % 4]]
    p = spark.createDataFrame(rows, "id long, term string, weight double")
    q, s = p.withColumnRenamed("id", "q"), p.withColumnRenamed("id", "s")
    a = search.top_k(search.posting_scores(q, s, "q", "s"), 5, "q", "s").select("q", "s", "rank").collect()
    for tiles, down in ((7, 1), (5, 2), (1, 3)):
        b = search.slab_scores(q, s, "q", "s", 5, tiles, down).select("q", "s", "rank").collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_grams_of_different_words_count_as_grams_of_the_text(spark):
    rows = [(1, "Abab ab, AB x"), (2, ""), (2, "abc ab"), (3, "ÉTÉ été İx"), (None, "ab ab")]
    df, text = spark.createDataFrame(rows, "id long, text string"), tokens.word_chars("text")
    for cut in (tokens.char_ngrams("text", 2), tokens.char_ngrams("text", 3), tokens.skip_bigrams("text")):
        a, b = postings.term_counts(df, ["id"], cut).collect(), postings.term_counts(df, ["id"], cut, {"text": text}).collect()
        assert a and sorted(map(str, a)) == sorted(map(str, b))


def test_copies_of_parts_are_scored_once(spark, tmp_path, monkeypatch):
    part = spark.read.parquet(f"{SF}/part.parquet")
    copies = part.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("p_partkey", F.col("p_partkey") + 1000 * F.col("i")).drop("i")
    odd = copies.limit(3).withColumns({"p_partkey": F.col("p_partkey") + 10**6, "p_name": F.lit(None).cast("string"), "p_brand": F.lit("Brand#7")})
    copies.unionByName(odd).write.parquet(str(tmp_path / "part.parquet"))
    seen, plain = [], search.posting_scores
    monkeypatch.setattr(search, "posting_scores", lambda a, b, *more: seen.append(b.count()) or plain(a, b, *more))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    name = "block_state_fallback"
    assert compare(spark, con, str(tmp_path), catalog.queries()[name], catalog.oracle_sql()[name]) == ""
    assert max(seen) <= 2 * (part.count() + 3)


def test_feature_cache_knows_its_configuration():
    assert features.config_key(a=1) != features.config_key(a=2) and features.score_prefix("address", True) == "ceag"


NAMES = ["Anb Trading Pvt Ltd", "Keeton Foods LLC", "Total Realty Inc", "Gyan Pharma Ltd", "Zeta Steel Corp", "Ps Wisdom Pvt Ltd", "Orchid Paper Co", "Blue Lake Motors"]
NOISY = ["Sri {} ", "{} (India)", "xx t/a {}", "{}."]


def linkage_rows():
    s1 = [(f"S1-{i}-{c}", n, f"{10 + i} Main Street, Peoria, {'IL' if i % 2 else 'MO'}", c) for c in ("US", "USA") for i, n in enumerate(NAMES)]
    other = []
    for k, (i, n, a, c) in enumerate(s1):
        if not i.startswith("S1-7"):
            other += [(f"S2-{k}-{j}", t.format(n), a if j % 2 else f"null, {a.replace('Street', 'St')}" if j else "", c, i) for j, t in enumerate(NOISY)]
    other.append(("S3-900", "Nobody Knows GmbH", "1 Far Away", "Peru", None))
    return s1, other


def test_linkage_end_to_end(spark):
    s1, other = linkage_rows()
    base = ", ".join(f"{c} string" for c in tsv.SOURCE)
    config = linkage.Config(methods=["tri", "words"], per_search=4)
    index = linkage.standardize(spark.createDataFrame(s1, base), config).persist()
    queries = linkage.standardize(spark.createDataFrame([r[:4] for r in other], base), config).persist()
    pairs = linkage.described(linkage.candidates(queries, index, config), queries, index).persist()
    assert pairs.where("query_id = 'S3-900'").isEmpty()
    truth = spark.createDataFrame([(r[0], r[4]) for r in other if r[4]] + [(None, r[0]) for r in s1 if r[0].startswith("S1-7")], "query_id string, s1_id string")
    model, threshold = linkage.fit(pairs, truth, rounds=4, depth=3)
    scored = settled(model.predict(pairs))
    best = decide.best_candidates(scored).where(F.col("p") >= threshold)
    assert metrics.macro_f05(best.select("query_id", "best_s1"), truth).first().f05 > 0.95
    matched, wide = linkage.outputs(scored, spark.createDataFrame(s1, base), threshold)
    assert matched.count() == len(s1) and matched.where("matched_entity_ids = ''").count() >= 2
    required = matched.select("source1_entity_id")
    assert validate.output_issues(matched, required, "matched_entity_ids", candidates=wide).count() == 0
    assert abs(sum(v for _, v in model.importance()) - 1) < 1e-6


def test_stream_of_queries(spark, tmp_path):
    s1, other = linkage_rows()
    base = ", ".join(f"{c} string" for c in tsv.SOURCE)
    config = linkage.Config(methods=["words"], per_search=2)
    index = linkage.standardize(spark.createDataFrame(s1, base), config).persist()
    tsv.write_tsv(spark.createDataFrame([r[:4] for r in other], base), str(tmp_path / "in"))
    out = str(tmp_path / "out")
    online.link_stream(online.tsv_stream(spark, str(tmp_path / "in")), index, config, lambda d, n: d.write.mode("overwrite").parquet(f"{out}/b={n}"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(out).select("query_id").distinct().count() >= 50


def test_average_precision_and_embedder(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1)], "p double, label int")
    assert abs(models.average_precision(rows).first()[0] - (1 + 2 / 3) / 2) < 1e-12
    got = models.HashedEmbedder(64).embed(spark.createDataFrame([("abc",), (None,)], "t string"), "t", "v").collect()
    assert abs(sum(x * x for x in got[0].v) - 1) < 1e-5 and models.batches_by_length(spark.createDataFrame([("abc",)], "t string"), "t").count() == 1


def test_decontaminate_whole_has_no_rank_cut_and_finds_passages_in_long_documents(spark, tmp_path):
    passage = "the seven grey boats left harbour before dawn"
    items = [(i, passage) for i in range(1, 6)] + [(6, "boats at"), (7, " "), (8, None), (9, "other words stand here alone")]
    long = " ".join(f"filler{i}" for i in range(400))
    docs = [(1, passage), (2, f"{long} {passage} {long}"), (3, "lifeboats attend"), (4, None), (5, "the seven grey boats")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.item_id): r.contained for r in catalog.decontaminate_whole(spark, str(tmp_path)).collect()}
    holds = {(d, i) for d, text in docs for i, p in items if text and p and p.strip() and p in text}
    assert {k for k, v in got.items() if v} == holds and {(d, i) for d in (1, 2) for i in range(1, 6)} | {(3, 6)} == holds
    assert set(got) - holds == {(5, i) for i in range(1, 6)}


def test_fuzzy_prefix_expand_has_short_words(spark, tmp_path):
    def osa(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    words, terms = "old red ox blue steel".split(), "old ole olden re red reads reader ox oxen oxygen ble blue bl bluish steal stele st".split()
    spark.createDataFrame([(" ".join(words),)], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(" ".join(terms),)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalog.queries()["fuzzy_prefix_expand"](spark, str(tmp_path)).collect()}
    assert got == {(a, b, osa(a, b)) for a in words for b in terms if a[:2] == b[:2] and osa(a, b) <= 2}


def test_small_index_is_searched_as_a_matrix(spark, tmp_path):
    """no posting of a query is made into a row; the hits are those of the joined search, also for repeated and null ids and
    for letters that Python and the JVM may see differently."""
    texts = ["The quick, brown fox", "fox \u0130stanbul \u01c5 \u023ab", "", None, "Ein Gr\u00f6\u00dfe \u00bd \u00b2 na\u00efve", "\u65e5\u672c\u8a9e \u30c6\u30ad the fox \U0001d518nicode", "a_b c,d\u00a0a b\x1cfox", "brown brown the"]
    rows = [(i // 2 if i < 600 else None, texts[i * 7 % 8]) for i in range(605)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = catalog.all_hits(spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r[0], r[1] is None, r[1] or 0, r[2])
    columns = ["method", "query_id", "rank", "s1_id", "score"]
    want = [tuple(r) for m in catalog.METHODS for r in catalog.method_hits(spark, str(tmp_path), m).withColumn("method", F.lit(m)).select(columns).collect()]
    assert sorted((tuple(r) for r in found.select(columns).collect()), key=key) == sorted(want, key=key)
    assert {m for m, *_ in want} == set(catalog.METHODS)


def test_pair_features_are_those_of_hashing(spark):
    """a left text is cut once for all its pairs, and the places are those that HashingTF gives the crossed words."""
    pairs = spark.createDataFrame([(1, "The fox, the \u65e5\u672c", "fox Bear", False), (2, None, "the \u65e5\u672c the", True), (3, "", "", False)], "i long, left string, right string, same boolean").coalesce(1)
    found = {r.i: [int(x) for x in r._v.indices] for r in models.CrossScorer(1 << 10).vectors(pairs).collect()}
    terms = {1: ["both=fox", "left=the", "left=\u65e5\u672c", "right=bear", "share=2", "bias"], 2: ["both=the", "both=\u65e5\u672c", "left=fox", "share=6", "bias"], 3: ["share=0", "bias"]}
    hashed = HashingTF(numFeatures=1 << 10)
    assert found == {i: sorted({hashed.indexOf(t) for t in ts}) for i, ts in terms.items()}
