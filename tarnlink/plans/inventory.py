"""More registered queries: tokenizers, text rules, groups, windows, samples and features one by one, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import addresses, names, tokens
from ..operators import features, fusion, metrics, models, postings, relational, sampling, search
from ..sources import tsv
from .catalog import _CUT, _DRAW, _FUSED, _HITS, _LABELLED, _NAMES, _name_pairs, all_hits, fused, labelled, query, table, truth_of

# ---- tokenizers ----

_SPACED = "[x FOR x IN string_split_regex(replace(coalesce(text, ''), ',', ' '), '[\\x20\\x09-\\x0D]+') IF x <> '']"
_LISTS = {
    "words": "w", "bi": _CUT["bi"], "tri": _CUT["tri"], "skip": _CUT["skip"], "shingle": "[l[i] || ' ' || l[i + 1] FOR i IN range(1, len(l))]",
    "numbers": "list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]+')))", "plain": "[x FOR x IN w IF NOT regexp_matches(x, '[0-9]')]",
    "fuzzy": "list_slice([x FOR x IN w IF length(x) >= 4 AND regexp_full_match(x, '\\p{L}+')], 1, 10)",
}


@query(f"""WITH t AS (SELECT doc_id, text, {_SPACED} AS w FROM documents), l AS (SELECT *, [lower(x) FOR x IN w] AS l FROM t),
c AS (SELECT doc_id, {', '.join(f'{x} AS {k}' for k, x in _LISTS.items())} FROM l)
SELECT doc_id, {', '.join(f"len({k}) || ':' || md5(coalesce(array_to_string({k}, '|'), '')) AS {k}" for k in _LISTS)} FROM c""")
def tokenizer_digests(spark, sf_dir):
    """K01-K03, K06, K08-K11 over every text: how many tokens, and the md5 of them all."""
    text = F.coalesce("text", F.lit(""))
    cut = {
        "words": tokens.words, "bi": tokens.TOKENIZERS["bi"], "tri": tokens.TOKENIZERS["tri"], "skip": tokens.skip_bigrams, "shingle": tokens.word_shingles,
        "numbers": tokens.numbers, "plain": tokens.plain_words, "fuzzy": lambda c: tokens.fuzzy_words(c, 10, 4, True),
    }
    rows = table(spark, sf_dir, "documents").select("doc_id", *(f(text).alias(k) for k, f in cut.items()))
    return rows.select("doc_id", *(F.concat(F.size(k).cast("string"), F.lit(":"), F.md5(F.array_join(k, "|").cast("binary"))).alias(k) for k in cut))


def _key_sql() -> str:
    out = "word"
    for a, b in tokens.KEY_RULES:
        out = f"replace({out}, '{a}', '{b}')"
    return out


@query(f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS word FROM documents),
c AS (SELECT word, string_split({_key_sql()}, '') AS cs FROM w),
k AS (SELECT word, array_to_string([cs[i] FOR i IN range(1, len(cs) + 1) IF i = 1 OR cs[i] <> cs[i - 1]], '') AS k FROM c)
SELECT word, CASE WHEN regexp_full_match(word, '\\p{{L}}+') THEN substr(k, 1, 1) || regexp_replace(substr(k, 2), '[aeiouh]', '', 'g') ELSE word END AS key FROM k""")
def phonetic_keys(spark, sf_dir):
    """K07 of every word."""
    words = table(spark, sf_dir, "documents").select(F.explode(tokens.word_chars(F.coalesce("text", F.lit("")))).alias("word")).distinct()
    return words.withColumn("key", tokens.phonetic_key(F.col("word")))


# ---- text rules, on an example each ----

_NAME_RULES = [
    ("N01", None, ""), ("N02", "Ａｎｂ Ｌｔｄ", "anb ltd"), ("N03", "CafÃ© Bleu", "cafe bleu"), ("N04", "Zetajax t/a Ps Wisdom Private Limited", "ps wisdom pvt ltd"),
    ("N05", "keetontrading.com", "keetontrading"), ("N05 bar", "A | b.com", "a"), ("N07", "Société Anonyme Züri", "zuri sa"), ("N08", "KEETON Trading", "keeton trading"),
    ("N09", "Rolston & Sons’", "rolston and sons"), ("N10", "A.B.C. Foods", "abc foods"), ("N11", ">> Keeton-Trading/West", "keeton trading west"),
    ("N12", "T0tal Realty 5tudios", "total realty studios"), ("N13", "M/s Shri Ram", "ram"), ("N13 kept", "Mr", "mr"), ("N14", "Sree Etablissements", "shree ets"),
    ("N15", "X Limtied", "x ltd"), ("N16", "Foo Limited Liability Company", "foo llc"), ("N17", "Limited Gyan (India) Pharmaceuticals", "gyan india pharmaceuticals ltd"),
]
_ADDRESS_RULES = [
    ("L01", "12 Main St", "Peru", "12 main st", ""), ("L03", "12 Main St; Peoria|IL", "usa", "12 main st, peoria, il", "il"), ("L04", "Allée Zoë", "France", "allee zoe", ""),
    ("L05", "N/A", "US", "", ""), ("L06", "Peoria, Illinois", "US", "peoria, il", "il"), ("L08", "630 45nd Terrace", "US", "630 45 ter", ""),
    ("L10", "A-12 B/4", "India", "a12 b 4", ""), ("L11", "First Street North", "US", "1 st n", ""), ("L12", "Door No 1038 Sector 9", "India", "1038 sector 9", ""),
    ("L13", "Kansas City", "US", "kansas", ""), ("L14", "Flat 007", "India", "flat 7", ""), ("L15", "1056-1060 Belden Ave", "US", "1056 belden ave", ""),
    ("L16", "Peoria, IL, 12 Main St", "US", "12 main st, peoria, il", "il"), ("L17", "Peoria, PEORIA, 5 Elm", "US", "5 elm, peoria", ""),
    ("L18", "Washington, 2 I Street, DC", "US", "2 i st, wa, dc", "dc"),
]


def _values(rows: list[tuple], columns: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + f") AS t({columns})"


@query(_values([(r, out) for r, _, out in _NAME_RULES], "rule, name_std"))
def name_rules(spark, sf_dir):
    rows = spark.createDataFrame([r[:2] for r in _NAME_RULES], "rule string, name string")
    return names.standardize_names(rows, "name").select("rule", "name_std")


@query(_values([(r, out, state) for r, _, _, out, state in _ADDRESS_RULES], "rule, address_std, state"))
def address_rules(spark, sf_dir):
    rows = spark.createDataFrame([r[:3] for r in _ADDRESS_RULES], "rule string, address string, country string")
    return addresses.standardize_addresses(rows, "address", "country").select("rule", "address_std", "state")


@query("SELECT * FROM (VALUES ('India', 'tg', 'ap'), ('India', 'ap', 'ap'), ('US', 'tg', 'tg'), ('US', '', NULL)) AS t(country, state, state_key)")
def state_groups(spark, sf_dir):
    """States that records use interchangeably have one key."""
    rows = spark.createDataFrame([("India", "tg"), ("India", "ap"), ("US", "tg"), ("US", "")], "country string, state string")
    return rows.withColumn("state_key", addresses.state_group(F.col("state"), F.col("country")))


@query("SELECT * FROM (VALUES ('राम', 'ram', CAST(2 AS BIGINT)), ('ट्रेडर्स', 'traders', CAST(2 AS BIGINT))) AS t(left_word, right_word, votes)")
def native_word_map(spark, sf_dir):
    """Words that two native names share learn their English words; a single vote is not enough."""
    truth = spark.createDataFrame([("S2-1", "S1-1"), ("S2-2", "S1-2"), ("S3-1", "S1-3")], "entity_id string, source1_entity_id string")
    s1 = spark.createDataFrame([("S1-1", "Ram Traders"), ("S1-2", "Ram Traders"), ("S1-3", "Gyan")], "entity_id string, business_name string")
    others = spark.createDataFrame([("S2-1", "राम ट्रेडर्स"), ("S2-2", "राम ट्रेडर्स"), ("S3-1", "ज्ञान")], "entity_id string, business_name string")
    return names.learn_word_map(truth, s1, others)


# ---- scans, sets, groups, windows ----


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus IN ('F', 'P')")
def scan_filtered(spark, sf_dir):
    """Range and list filters and the columns reach the scan."""
    return tsv.read_parquet(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey"], "o_totalprice > 200000 AND o_orderstatus IN ('F', 'P')")


@query("SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS width FROM embeddings")
def aligned_vectors(spark, sf_dir):
    """Rows with their vectors by id; a row without one is an error."""
    v = table(spark, sf_dir, "embeddings")
    return tsv.aligned_vectors(v.select("vec_id", "label"), v.select("vec_id", "embedding"), "vec_id").select("vec_id", "label", F.size("embedding").alias("width"))


@query("""WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_has_all(['A', 'N'], s) AS inside, s = ['A', 'N'] AS same FROM s""")
def set_tests(spark, sf_dir):
    """U04."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("s"))
    other = F.array(F.lit("N"), F.lit("A"))
    return rows.select("l_orderkey", relational.subset(F.col("s"), other).alias("inside"), relational.set_equal(F.col("s"), other).alias("same"))


@query("""SELECT l_orderkey, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity, min(l_extendedprice) AS least_price, max(l_extendedprice) AS most_price,
count(DISTINCT l_suppkey) AS n_suppliers, round(median(l_quantity), 6) AS median_quantity, round(product(1 - l_extendedprice / 200000), 9) AS none FROM lineitem GROUP BY 1""")
def group_measures(spark, sf_dir):
    """A01, A02, A04, A07, A11, A17."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.min("l_extendedprice").alias("least_price"),
        F.max("l_extendedprice").alias("most_price"), F.countDistinct("l_suppkey").alias("n_suppliers"), F.round(F.median("l_quantity"), 6).alias("median_quantity"),
        F.round(F.product(1 - F.col("l_extendedprice") / 200000), 9).alias("none"),
    )


@query("""SELECT d.lang, count(*) AS n, round(avg(CASE WHEN l.quality IS NULL THEN 1.0 ELSE 0.0 END), 9) AS unlabelled
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id) GROUP BY d.lang""")
def null_share(spark, sf_dir):
    """How many documents of a language have no label."""
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(marks, "doc_id", "left")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("quality").isNull().cast("double")), 9).alias("unlabelled"))


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS first_seen,
(lag(event_id) OVER u IS NULL OR event_type IS DISTINCT FROM lag(event_type) OVER u) AS run_start,
CASE WHEN event_id % 2 = 0 THEN count(*) FILTER (WHERE event_id % 2 = 0) OVER (u ROWS UNBOUNDED PRECEDING) END AS kept_rank
FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_marks(spark, sf_dir):
    """First row of a kind, first row of a run, place among kept rows."""
    rows, by = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), (F.col("ts"), F.col("event_id"))
    rows = relational.run_starts(relational.first_seen(rows, ["user_id", "event_type"], *by), ["user_id"], "event_type", *by)
    return relational.rank_among(rows, ["user_id"], F.col("event_id") % 2 == 0, *by).select("event_id", "first_seen", "run_start", "kept_rank")


@query("SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM orders")
def running_total(spark, sf_dir):
    """W01 over all rows, without a single sorting task."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return relational.running(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], {"running": "o_custkey"}).select("o_orderkey", "running")


# ---- search, fusion, features ----


@query(f"""WITH c AS (SELECT item_id, unnest({_CUT['words']}) AS term FROM benchmark), s AS (SELECT item_id, count(*) AS size FROM c GROUP BY 1)
SELECT term, count(DISTINCT item_id) AS df, (SELECT count(DISTINCT item_id) FROM benchmark) AS n, count(*) AS tf, (SELECT round(avg(size), 9) FROM s) AS mean_size FROM c GROUP BY term""")
def term_statistics(spark, sf_dir):
    """Document frequency, total frequency, mean length."""
    items = table(spark, sf_dir, "benchmark")
    counts = postings.term_counts(items.select("item_id", F.lower(F.coalesce("text", F.lit(""))).alias("t")), ["item_id"], tokens.words("t"))
    df = postings.document_frequency(counts, items.agg(F.countDistinct("item_id").alias("n")))
    mean = counts.groupBy("item_id").agg(F.sum("tf").alias("size")).agg(F.round(F.avg("size"), 9).alias("mean_size"))
    return df.join(counts.groupBy("term").agg(F.sum("tf").alias("tf")), "term").crossJoin(F.broadcast(mean))


@query(f"""WITH {_HITS}, z AS (SELECT query_id, s1_id, round(sum(1.0 / (60 + rank)), 12) AS rrf, min(CASE method WHEN 'words' THEN rank ELSE 1000 + rank END) AS seen
FROM hits WHERE method IN ('words', 'tri') GROUP BY ALL)
SELECT * FROM (SELECT query_id, s1_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seen, s1_id) AS fused_rank FROM z) WHERE fused_rank <= 3""")
def method_subset(spark, sf_dir):
    """Two of the searches fused, cut by fused rank."""
    rows = search.rank_prune(fusion.fuse(all_hits(spark, sf_dir), ["words", "tri"]), 3)
    return rows.select("query_id", "s1_id", F.col("fused_rank").cast("long").alias("fused_rank"))


@query(f"""WITH {_FUSED} SELECT query_id, s1_id, tri_score AS ce_logit, round(tri_score - max(tri_score) OVER (PARTITION BY query_id), 6) AS ce_gap,
CASE WHEN tri_score IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY tri_score DESC NULLS LAST, fused_rank) END AS ce_rank FROM fused""")
def pair_score_features(spark, sf_dir):
    """A score that some pairs lack; those are not ranked."""
    rows = fused(spark, sf_dir).select("query_id", "s1_id", "fused_rank", "tri_score")
    scores = rows.where("tri_score is not null").select("query_id", "s1_id", F.col("tri_score").alias("logit"))
    found = features.score_features(rows, scores, features.score_prefix("both"))
    return found.select("query_id", "s1_id", "ce_logit", F.round("ce_gap", 6).alias("ce_gap"), F.col("ce_rank").cast("long").alias("ce_rank"))


def _pair_columns(pairs: DataFrame) -> DataFrame:
    end = lambda c: F.when(F.length(c) % 2 == 0, F.concat(c, F.lit(" ltd"))).otherwise(F.concat(c, F.lit(" pvt ltd")))
    place = lambda c: F.when(F.length(c) % 3 == 0, F.lit("")).otherwise(F.concat(F.length(c).cast("string"), F.lit(" main st 7")))
    cols = {}
    for p, c in (("q", "a"), ("s", "b")):
        cols |= {f"{p}_name": end(F.col(c)), f"{p}_core": F.substring_index(c, " ", 1), f"{p}_address": place(F.col(c))}
    return pairs.withColumns(cols)


def _pair_sql(c: str, p: str) -> str:
    return f"""CASE WHEN length({c}) % 2 = 0 THEN {c} || ' ltd' ELSE {c} || ' pvt ltd' END AS {p}n, split_part({c}, ' ', 1) AS {p}c,
CASE WHEN length({c}) % 3 = 0 THEN '' ELSE length({c}) || ' main st 7' END AS {p}a, CASE WHEN length({c}) % 3 = 0 THEN [] ELSE list_distinct(['7', CAST(length({c}) AS VARCHAR)]) END AS {p}d"""


@query(f"""WITH {_NAMES}, x AS (SELECT a, b, {_pair_sql('a', 'q')}, {_pair_sql('b', 's')} FROM p)
SELECT a, b, CAST(qc = sc AS INTEGER) AS core_exact, CAST(length(a) % 2 = length(b) % 2 AS INTEGER) AS legal_equal, CAST(abs(length(qn) - length(sn)) AS INTEGER) AS name_len_diff,
CAST(qa = '' AS INTEGER) AS query_address_empty, CAST(sa = '' AS INTEGER) AS s1_address_empty, round(jaro_winkler_similarity(qn, sn), 6) AS name_jaro_winkler,
round(len(list_intersect(qd, sd)) / nullif(len(list_distinct(list_concat(qd, sd))), 0), 9) AS number_jaccard,
CASE WHEN qa <> '' AND sa <> '' THEN CAST(length(a) = length(b) AS INTEGER) END AS first_number_equal FROM x""")
def feature_pairs(spark, sf_dir):
    """Part names as names with a legal form, their first words as cores, made-up addresses."""
    rows = features.pair_features(_pair_columns(_name_pairs(spark, sf_dir)))
    whole = ("core_exact", "legal_equal", "name_len_diff", "query_address_empty", "s1_address_empty", "first_number_equal")
    return rows.select("a", "b", *whole, F.round("name_jaro_winkler", 6).alias("name_jaro_winkler"), F.round("number_jaccard", 9).alias("number_jaccard"))


@query("""SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS embedding_cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embedding_cosine(spark, sf_dir):
    """F17 of neighbouring vectors."""
    v = table(spark, sf_dir, "embeddings")
    rows = v.select("vec_id", F.col("embedding").alias("x")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return rows.select("vec_id", F.round(search.cosine("x", "y"), 6).alias("embedding_cosine"))


# ---- samples and metrics ----


@query(f"""WITH {_LABELLED}, r AS (SELECT *, label = 0 AND fused_rank > 5 AS low, row_number() OVER (PARTITION BY query_id, label = 0 AND fused_rank > 5 ORDER BY {_DRAW}, s1_id) AS n FROM lab)
SELECT query_id, s1_id, label FROM r WHERE NOT low OR n <= 2""")
def training_pairs(spark, sf_dir):
    """M06."""
    return sampling.training_pairs(labelled(spark, sf_dir)).select("query_id", "s1_id", "label")


@query("SELECT p_partkey, p_name || ' | ' || p_type AS both_text, p_name AS name_text, p_type AS address_text FROM part")
def pair_texts(spark, sf_dir):
    """M07 in its three modes."""
    text = lambda mode: sampling.pair_text(F.col("p_name"), F.col("p_type"), mode).alias(f"{mode}_text")
    return table(spark, sf_dir, "part").select("p_partkey", text("both"), text("name"), text("address"))


@query(f"""WITH {_LABELLED}, s AS (SELECT greatest(least(coalesce(words_score, 0), 1 - 1e-7), 1e-7) AS p, label FROM lab)
SELECT round(-avg(CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM s""")
def pair_log_loss(spark, sf_dir):
    """M12."""
    rows = labelled(spark, sf_dir).withColumn("p", F.coalesce("words_score", F.lit(0.0)))
    return models.log_loss(rows).select(F.round("log_loss", 6).alias("log_loss"))


@query(f"""WITH {_LABELLED}, b AS (SELECT d.query_id, f.s1_id AS best_s1 FROM (SELECT DISTINCT doc_id AS query_id FROM documents) d LEFT JOIN fused f ON f.query_id = d.query_id AND f.fused_rank = 1)
SELECT count(*) AS accepted, count(*) FILTER (WHERE best_s1 = t.s1_id) AS correct, round(count(*) FILTER (WHERE best_s1 = t.s1_id) / count(*), 9) AS precision,
round(count(*) FILTER (WHERE best_s1 = t.s1_id) / count(t.s1_id), 9) AS recall FROM b LEFT JOIN truth t USING (query_id)""")
def baseline_top1(spark, sf_dir):
    """The top candidate always taken, so that every query counts as accepted."""
    everyone = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"))
    found = metrics.pair_metrics(metrics.baseline(fused(spark, sf_dir), queries=everyone), truth_of(spark, sf_dir), -1.0)
    return found.withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})
