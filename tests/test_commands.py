import pytest

from tarnlink.__main__ import main
from tarnlink.sources import tsv

from .test_operators import linkage_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("commands")
    s1, other = linkage_rows()
    base = ", ".join(f"{c} string" for c in tsv.SOURCE)
    tsv.write_tsv(spark.createDataFrame(s1, base), f"{at}/s1")
    tsv.write_tsv(spark.createDataFrame([r[:4] for r in other], base), f"{at}/records")
    owned = {}
    for r in other:
        owned.setdefault(r[4], []).append(r[0])
    truth = [(i, ",".join(owned.get(i, []))) for i, *_ in s1]
    tsv.write_tsv(spark.createDataFrame(truth, "source1_entity_id string, matched_entity_ids string"), f"{at}/truth")
    return str(at)


def run(spark, at, command, *extra, **paths):
    given = [x for k, v in paths.items() for x in (f"--{k}", f"{at}/{v}")]
    return main([command, *given, *extra], spark)


def test_split_keeps_records_with_their_entity(spark, folder):
    assert run(spark, folder, "split", "--fraction", "0.4", truth="truth", queries="records", out="split") == 0
    columns = (*tsv.SOURCE, "source1_entity_id")
    sides = {s: tsv.read_tsv(spark, f"{folder}/split/{s}-records", columns).collect() for s in ("train", "eval")}
    truth = {s: {r[0] for r in tsv.read_tsv(spark, f"{folder}/split/{s}-truth", columns[-1:] + ("ids",)).collect()} for s in sides}
    assert sum(map(len, sides.values())) == tsv.read_tsv(spark, f"{folder}/records").count()
    assert all(r.source1_entity_id in truth[s] for s in sides for r in sides[s] if r.source1_entity_id) and all(truth.values())


def test_raw_files_to_validated_outputs(spark, folder, capsys):
    searches = ("--methods", "tri", "words", "--per-search", "4", "--truth", f"{folder}/truth")
    assert run(spark, folder, "word-map", truth="truth", s1="s1", queries="records", out="words.json") == 0
    assert run(spark, folder, "retrieve", *searches, "--word-maps", f"{folder}/words.json", queries="records", s1="s1", out="found") == 0
    assert "k=1\t" in capsys.readouterr().out
    assert run(spark, folder, "train", "--rounds", "4", "--depth", "3", pairs="found", truth="truth", out="model") == 0
    assert run(spark, folder, "evaluate", pairs="found", model="model", truth="truth") == 0
    said = dict(x.split("=", 1) for line in capsys.readouterr().out.splitlines() for x in line.split("\t"))
    assert float(said["f05"]) > 0.95
    assert run(spark, folder, "predict", pairs="found", model="model", s1="s1", out="out") == 0
    assert run(spark, folder, "validate", matching="out/matching_results", candidates="out/candidate_pairs", s1="s1") == 0
    assert run(spark, folder, "predict", "--per-entity", pairs="found", model="model", s1="s1", out="expected") == 0
    taken = tsv.read_tsv(spark, f"{folder}/expected/matching_results", ("s1", "ids"))
    assert taken.count() == 16 and taken.where("ids <> ''").count() >= 10
    assert run(spark, folder, "validate", matching="truth", candidates="out/candidate_pairs", s1="records") == 1


def test_mine_writes_its_tables(spark, folder):
    assert run(spark, folder, "mine", "--min-report", "1", "--min-unseen", "1", "--test", f"{folder}/s1", truth="truth", s1="s1", queries="records", out="mined") == 0
    assert tsv.read_tsv(spark, f"{folder}/mined/unseen", ("token", "n", "country", "share")).count() == 0
