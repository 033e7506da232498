import json

from conftest import entities

from kinfold.operators.blocking import CandidateGenerator
from kinfold.plans.pipeline import report, report_frame
from kinfold.sources import tables

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def test_reader_keeps_quotes_zeros_and_words(spark, tmp_path):
    p = tmp_path / "s2.tsv"
    p.write_text(HEAD + 'S2-1\t"Quote" \\ Co\t007\tNA\nS2-2\t\tNone\t\nS2-3\tshort\n', encoding="utf-8")
    rows = [tuple(r)[2:] for r in tables.read_source(spark, str(p), "S2").orderBy("row_idx").collect()]
    assert rows == [("S2-1", '"Quote" \\ Co', "007", "NA"), ("S2-2", "", "None", ""), ("S2-3", "short", "", "")]
    loose = [tuple(r)[2:] for r in tables.read_source(spark, str(p), "S2", na_words=True).orderBy("row_idx").collect()]
    assert loose[0][3] is None and loose[1] == ("S2-2", None, None, None)


def test_candidate_file_round_trip(spark, tmp_path):
    df = entities(spark, [("S1-1", "Blue Fox", "", "US"), ("S1-2", "Lone", "", "US"), ("S2-1", "Blue Fox", "", "US"), ("S3-1", "Fox Blue", "", "US")])
    c = CandidateGenerator().generate(df)
    out = str(tmp_path / "cand")
    tables.write_candidates(df.where("src = 'S1'"), c, out)
    text = "".join(sorted(f.read_text() for f in (tmp_path / "cand").glob("part-*")))
    assert text == "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n"
    assert {tuple(r) for r in tables.read_candidates(spark, out).collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-1")}


def test_truth_words(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tnan\nS1-2\tS2-1,,S3-1\nS1-3\t<NA>\n")
    assert [r[1] for r in tables.read_truth(spark, str(p)).orderBy("source1_entity_id").collect()] == ["", "S2-1,,S3-1", ""]


def test_reports_and_data_sets(spark, tmp_path):
    df = spark.createDataFrame([(0.125, "train", 1), (2.675, "val", 0)], "x double, split string, n int")
    assert [r["x"] for r in report(df.orderBy("n"), 2)] == [2.67, 0.12]
    tables.write_report(df, str(tmp_path / "r"))
    assert sorted(json.loads(x)["n"] for f in (tmp_path / "r").glob("part-*") for x in f.read_text().splitlines()) == [0, 1]
    assert json.loads(report_frame(df).where("n = 1").first().document) == {"x": 0.125, "split": "train", "n": 1}
    tables.write_dataset(df, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).where("split = 'val'").count() == 1
