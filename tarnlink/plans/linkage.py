"""The linkage pipeline: standardize, search in blocks, fuse, describe pairs, classify, decide, write."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.addresses import standardize_addresses, state_group
from ..functions.names import standardize_names
from ..operators import features, fusion, postings, relational, search
from ..operators.decide import best_candidates, best_threshold, sweep
from ..operators.models import MatchClassifier
from ..operators.validate import require_unique
from ..session import settled


@dataclass
class Config:
    methods: list[str] = field(default_factory=lambda: ["bi", "tri", "words", "phonetic"])
    per_search: int = 16
    top: int = 100
    rrf_k: int = 60
    name_boost: float = 2.0
    scoring: str = "tfidf"
    state_filter: bool = True
    gap: float | None = None
    threshold: float = 0.5
    word_map: dict[str, str] | None = None


def standardize(records: DataFrame, config: Config) -> DataFrame:
    """T1 with name, core, address, state and the state group as block key."""
    rows = standardize_names(records, "business_name", "name", "core", config.word_map)
    rows = standardize_addresses(rows, "business_address", "country", "address", "state")
    rows = rows.withColumn("state_key", state_group(F.col("state"), F.col("country")))
    return settled(rows.select("entity_id", "country", "state_key", "name", "core", "address"))


def hits(queries: DataFrame, s1: DataFrame, config: Config) -> DataFrame:
    """(query_id, method, rank, s1_id, score, name_score, address_score) of all searches."""
    left, right = queries.withColumnRenamed("entity_id", "query_id"), s1.withColumnRenamed("entity_id", "s1_id")
    out = None
    for method in config.methods:
        cut = tokens.TOKENIZERS[method]
        fields = {}
        for name in ("name", "address"):
            index, asked = postings.fitted(right, left, "s1_id", "query_id", cut(F.col(name)), cut(F.col(name)), config.scoring)
            index = index.join(right.select("s1_id", "country", "state_key"), "s1_id")
            asked = asked.join(left.select("query_id", "country", "state_key"), "query_id")
            found = None
            for a, b, keys in search.in_blocks(asked, index, "country", "state_key" if config.state_filter else None):
                part = search.posting_scores(a, b, "query_id", "s1_id", keys)
                found = part if found is None else found.unionByName(part)
            fields[name] = found
        both = search.combine_fields(fields["name"], fields["address"], "query_id", "s1_id", config.name_boost)
        best = search.top_k(both, config.per_search).withColumn("method", F.lit(method))
        out = best if out is None else out.unionByName(best)
    return out


def candidates(queries: DataFrame, s1: DataFrame, config: Config) -> DataFrame:
    """Fused candidates, pruned."""
    found = settled(hits(queries, s1, config))
    fused = search.rank_prune(fusion.fuse(found, config.methods, config.rrf_k, parts=True), config.top)
    if config.gap is not None:
        fused = fused.join(search.gap_prune(found, config.gap), ["query_id", "s1_id"], "left_semi")
    return settled(features.retrieval_features(fused, config.methods))


def described(pairs: DataFrame, queries: DataFrame, s1: DataFrame) -> DataFrame:
    """Candidates with the text features."""
    side = lambda d, p, key: d.select(F.col("entity_id").alias(key), *(F.col(c).alias(f"{p}_{c}") for c in ("name", "core", "address")))
    rows = relational.lookup(relational.lookup(pairs, side(queries, "q", "query_id"), ["query_id"]), side(s1, "s", "s1_id"), ["s1_id"])
    made = features.pair_features(rows)
    return settled(made.drop(*(f"{p}_{c}" for p in "qs" for c in ("name", "core", "address"))))


def feature_names(pairs: DataFrame) -> list[str]:
    return [c for c, t in pairs.dtypes if t != "string" and c not in ("query_id", "s1_id", "label")]


def fit(pairs: DataFrame, truth: DataFrame, decided: DataFrame | None = None, **trees) -> tuple[MatchClassifier, float]:
    """The classifier on pairs, and its threshold on decided pairs (the same ones, if none are given), from truth
    (query_id, s1_id)."""
    labelled = relational.left_fill(pairs, truth.where("query_id is not null").withColumn("label", F.lit(1)), ["query_id", "s1_id"], 0)
    model = MatchClassifier(feature_names(pairs), **trees).fit(labelled)
    chosen = best_threshold(sweep(best_candidates(model.predict(pairs if decided is None else decided)), truth)).first()
    return model, chosen["threshold"]


def outputs(scored: DataFrame, s1: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The two output tables: accepted queries, and all candidates, of each S1 entity."""
    best = require_unique(best_candidates(scored), "query_id").where(F.col("p") >= threshold)
    everyone = s1.select(F.col("entity_id").alias("source1_entity_id"))
    matched = relational.join_ids(best.select(F.col("best_s1").alias("source1_entity_id"), "query_id"), everyone, "source1_entity_id", "query_id", "matched_entity_ids")
    wide = relational.join_ids(scored.select(F.col("s1_id").alias("source1_entity_id"), "query_id"), everyone, "source1_entity_id", "query_id", "candidate_entity_ids")
    return matched, wide
