"""Commands of the linkage pipeline: python -m tarnlink COMMAND --help.

Sources and outputs are TSV, tables between commands Parquet folders, a model is a folder with a JSON of what made it.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names, tokens
from .operators import decide, metrics, mining, models, relational, sampling, validate
from .plans import linkage
from .session import settled, ship
from .sources import tsv

S1, MATCHED, CANDIDATES = "source1_entity_id", "matched_entity_ids", "candidate_entity_ids"
RECALL = (1, 2, 4, 8, 16, 0)


def links(truth: DataFrame) -> DataFrame:
    """(query_id, s1_id) of T2; entities without records have a null query_id."""
    pairs = relational.explode_ids(truth, S1, MATCHED, "query_id").select("query_id", F.col(S1).alias("s1_id"))
    alone = truth.where(F.coalesce(MATCHED, F.lit("")) == "")
    return pairs.unionByName(alone.select(F.lit(None).cast("string").alias("query_id"), F.col(S1).alias("s1_id")))


def _truth(spark: SparkSession, args) -> DataFrame:
    return tsv.read_tsv(spark, args.truth, (S1, MATCHED))


def _config(spark: SparkSession, args) -> linkage.Config:
    given = {f.name: getattr(args, f.name) for f in fields(linkage.Config) if getattr(args, f.name, None) is not None}
    if args.word_maps:
        given["word_map"] = tsv.read_json(spark, *args.word_maps)
    return linkage.Config(**given)


def _sides(spark: SparkSession, args, config: linkage.Config) -> tuple[DataFrame, DataFrame]:
    records = tsv.read_tsv(spark, args.queries)
    records = records if args.limit is None else relational.hash_limit(records, "entity_id", args.limit)
    return linkage.standardize(records, config), linkage.standardize(tsv.read_tsv(spark, args.s1), config)


def _print(rows: DataFrame, *order) -> None:
    """Reports of a few rows each."""
    for r in (rows.orderBy(*order) if order else rows).collect():
        print("\t".join(f"{k}={v:.6f}" if isinstance(v, float) else f"{k}={v}" for k, v in r.asDict().items()))


def split(spark: SparkSession, args) -> int:
    """Records, with their entity, and truth rows on a train and an eval side."""
    truth = _truth(spark, args)
    owner = links(truth).where("query_id is not null").select(F.col("query_id").alias("entity_id"), F.col("s1_id").alias(S1))
    records = relational.left_fill(tsv.read_tsv(spark, args.queries), owner, ["entity_id"], "")
    truth, records = sampling.entity_split(truth, records, S1, "entity_id", args.fraction, args.seed)
    for name, rows in (("records", records), ("truth", truth)):
        rows = settled(rows)
        for side in ("train", "eval"):
            tsv.write_tsv(rows.where(F.col("is_eval") == (side == "eval")).drop("is_eval"), f"{args.out}/{side}-{name}")
    return 0


def word_map(spark: SparkSession, args) -> int:
    """Native words and their English ones, as JSON; bounded by the vocabulary of native names."""
    owner = links(_truth(spark, args)).where("query_id is not null").toDF("entity_id", S1)
    found = names.learn_word_map(owner, tsv.read_tsv(spark, args.s1), tsv.read_tsv(spark, args.queries), args.min_count)
    tsv.write_json(spark, {r.left_word: r.right_word for r in found.collect()}, args.out)
    return 0


def retrieve(spark: SparkSession, args) -> int:
    """Hits of every search and the fused candidates; with truth, recall at k."""
    config = _config(spark, args)
    queries, s1 = _sides(spark, args, config)
    found = linkage.candidates(queries, s1, config)
    linkage.described(found, queries, s1).write.parquet(f"{args.out}/pairs")
    if args.truth:
        _print(metrics.recall_at(found, links(_truth(spark, args)), RECALL, rank="fused_rank"), "k")
    return 0


def train(spark: SparkSession, args) -> int:
    """The classifier on one fold of the pairs, or on all, and the threshold of greatest F0.5."""
    pairs, truth = spark.read.parquet(f"{args.pairs}/pairs"), links(_truth(spark, args))
    if args.fold:
        known = truth.where("query_id is not null").withColumnRenamed("s1_id", "_owner")
        pairs = pairs.join(known, "query_id", "left").where(sampling.fold(F.col("_owner"), F.col("query_id")) == args.fold).drop("_owner")
        truth = truth.where(sampling.fold(F.col("s1_id"), F.col("s1_id")) == args.fold)
    shown = pairs
    if not args.all_negatives:
        labelled = relational.left_fill(pairs, truth.where("query_id is not null").withColumn("label", F.lit(1)), ["query_id", "s1_id"], 0)
        shown = settled(sampling.negatives(labelled, hard=args.hard, random=args.random)).drop("label")
    model, threshold = linkage.fit(shown, truth, pairs, rounds=args.rounds, depth=args.depth, step=args.step)
    model.save(f"{args.out}/trees")
    tsv.write_json(spark, {"features": model.features, "threshold": threshold, "importance": model.importance()}, f"{args.out}/model.json")
    print(f"threshold={threshold}")
    return 0


def _scored(spark: SparkSession, args) -> tuple[DataFrame, float]:
    about = tsv.read_json(spark, f"{args.model}/model.json")
    model = models.MatchClassifier(about["features"]).load(f"{args.model}/trees")
    scored = settled(model.predict(spark.read.parquet(f"{args.pairs}/pairs")))
    return scored, about["threshold"] if args.threshold is None else args.threshold


def predict(spark: SparkSession, args) -> int:
    """The two output tables."""
    scored, threshold = _scored(spark, args)
    s1 = tsv.read_tsv(spark, args.s1)
    matched, wide = linkage.outputs(scored, s1, threshold)
    if args.per_entity:
        taken = decide.expected_f05(validate.require_unique(decide.best_candidates(scored), "query_id"), args.gamma, args.miss)
        matched = relational.join_ids(taken.select(F.col("best_s1").alias(S1), "query_id"), s1.select(F.col("entity_id").alias(S1)), S1, "query_id", MATCHED)
    tsv.write_tsv(matched, f"{args.out}/matching_results")
    tsv.write_tsv(wide, f"{args.out}/candidate_pairs")
    return 0


def evaluate(spark: SparkSession, args) -> int:
    """Macro F0.5, pair precision and recall, the baseline, error groups; or the grid of M18, M19."""
    scored, threshold = _scored(spark, args)
    truth, best = links(_truth(spark, args)), settled(decide.best_candidates(scored))
    _print(metrics.macro_f05(best.where(F.col("p") >= threshold).select("query_id", "best_s1"), truth))
    _print(metrics.pair_metrics(best, truth, threshold))
    _print(metrics.macro_f05(metrics.baseline(scored).select("query_id", "best_s1"), truth).withColumnRenamed("f05", "baseline_f05"))
    _print(relational.shares(metrics.error_groups(best, scored, truth, threshold), "error_group"), "error_group")
    if args.tune:
        # the grid is chosen on one half of the entities and reported on the other
        half = lambda d, c, x: d.where(sampling.fold(F.col(c), F.col(c)) == x)
        top = decide.tune_expected(half(best, "best_s1", "A"), half(truth, "s1_id", "A")).first()
        taken = decide.expected_f05(half(best, "best_s1", "B"), top["gamma"], top["miss"])
        found = metrics.macro_f05(taken.select("query_id", "best_s1"), half(truth, "s1_id", "B"))
        _print(found.select(F.lit(top["gamma"]).alias("gamma"), F.lit(top["miss"]).alias("miss"), "f05", "entities"))
    return 0


def mine(spark: SparkSession, args) -> int:
    """Spelling variants of matched names, and words of other records that training never has."""
    config = linkage.Config()
    side = lambda paths: linkage.standardize(tsv.read_tsv(spark, paths), config)
    queries, s1 = side(args.queries), side(args.s1)
    pairs = links(_truth(spark, args)).where("query_id is not null")
    pairs = pairs.join(queries.select(F.col("entity_id").alias("query_id"), F.col("name").alias("right")), "query_id")
    pairs = pairs.join(s1.select(F.col("entity_id").alias("s1_id"), F.col("name").alias("left")), "s1_id")
    found = settled(mining.variants(pairs, "left", "right", args.min_report))
    tsv.write_tsv(found, f"{args.out}/variants")
    tsv.write_tsv(mining.lookup_of(found, args.min_count, args.min_precision), f"{args.out}/lookup")
    if args.test:
        cut = lambda d: d.select("country", F.explode(tokens.words("name")).alias("token"))
        unseen = mining.unseen_tokens(cut(side(args.test)), cut(queries).unionByName(cut(s1)), "token", "country", args.min_unseen)
        tsv.write_tsv(unseen, f"{args.out}/unseen")
    return 0


def check(spark: SparkSession, args) -> int:
    """The issues of the two output tables; 1 if one is an error."""
    required = tsv.read_tsv(spark, args.s1).select(F.col("entity_id").alias(S1))
    wide = tsv.read_tsv(spark, args.candidates, (S1, CANDIDATES))
    issues = validate.output_issues(tsv.read_tsv(spark, args.matching, (S1, MATCHED)), required, MATCHED, candidates=wide)
    issues = issues.withColumn("file", F.lit("matching")).unionByName(validate.output_issues(wide, required, CANDIDATES).withColumn("file", F.lit("candidates")))
    issues = settled(issues)
    _print(issues, "file", "kind")
    return int(not issues.where("level = 'ERROR'").isEmpty())


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tarnlink", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def add(run, name: str, *paths: str, **options) -> argparse.ArgumentParser:
        one = commands.add_parser(name, help=run.__doc__, description=run.__doc__)
        one.set_defaults(run=run)
        for p in paths:
            one.add_argument(f"--{p}", required=True, **({"nargs": "+"} if p in ("queries", "s1") else {}))
        for k, v in options.items():
            kind = {"action": "store_true"} if v is False else {"default": v, "type": type(v)}
            one.add_argument(f"--{k.replace('_', '-')}", **kind)
        return one

    add(split, "split", "truth", "queries", "out", fraction=0.05, seed=42)
    add(word_map, "word-map", "truth", "s1", "queries", "out", min_count=2)
    one = add(retrieve, "retrieve", "queries", "s1", "out", per_search=16, top=100, rrf_k=60, name_boost=2.0)
    one.add_argument("--methods", nargs="+", choices=sorted(tokens.TOKENIZERS))
    one.add_argument("--scoring", choices=["tfidf", "bm25"], default="tfidf")
    one.add_argument("--no-state-filter", dest="state_filter", action="store_false")
    one.add_argument("--gap", type=float)
    one.add_argument("--limit", type=int)
    one.add_argument("--word-maps", nargs="*")
    one.add_argument("--truth")
    one = add(train, "train", "pairs", "truth", "out", hard=10, random=5, rounds=30, depth=5, step=0.2, all_negatives=False)
    one.add_argument("--fold", choices=["A", "B"])
    one = add(predict, "predict", "pairs", "model", "s1", "out", per_entity=False, gamma=1.0, miss=0.5)
    one.add_argument("--threshold", type=float)
    one = add(evaluate, "evaluate", "pairs", "model", "truth", tune=False)
    one.add_argument("--threshold", type=float)
    one = add(mine, "mine", "truth", "s1", "queries", "out", min_report=3, min_count=10, min_precision=0.6, min_unseen=20)
    one.add_argument("--test", nargs="*")
    add(check, "validate", "matching", "candidates", "s1")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(ship(spark or SparkSession.builder.appName("tarnlink").getOrCreate()), args)


if __name__ == "__main__":
    sys.exit(main())
