"""Golden cases of the rules, layout, merge keys and claims."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from psephos.functions.text import basename, claim_key, content_type, folder_ballot, stem
from psephos.operators import decisions, evaluation, events, layout, merge
from psephos.sources import files


@pytest.mark.parametrize(("digits", "ok"), [([1, 2, 3, 4], True), ([1, 2, 2], False), ([1, 2, 4], False), ([3, 4], False), ([], False), ([8, 1, None, 3, 2, None, 5, 4, 7, 6], True)])
def test_sequence(spark, digits, ok):
    row = spark.createDataFrame([(digits,)], "d array<int>").select(decisions.valid_sequence(F.col("d")).alias("ok")).first()
    assert bool(row.ok) is ok


@pytest.mark.parametrize(("score", "geometry", "expected"), [(0.38, True, "VALID STAMP"), (0.37, True, "REVIEW REQUIRED"), (0.18, True, "REVIEW REQUIRED"), (0.17, True, "NO STAMP"), (0.99, False, "NO STAMP")])
def test_decision(spark, score, geometry, expected):
    assert spark.range(1).select(decisions.stamp_decision(F.lit(score), F.lit(geometry)).alias("d")).first().d == expected


def test_state(spark):
    rows = spark.createDataFrame([("VALID STAMP", True), ("VALID STAMP", None), ("REVIEW REQUIRED", True), ("NO STAMP", True)], "l string, ok boolean")
    assert [r.s for r in rows.select(decisions.ballot_state(F.col("l"), F.col("ok")).alias("s")).collect()] == ["Valid", "Doubtful", "Doubtful", "Doubtful"]


def test_cause_order(spark):
    rows = spark.createDataFrame([(False, False, "REVIEW REQUIRED", 0.1), (True, False, "REVIEW REQUIRED", 0.1), (True, True, "REVIEW REQUIRED", 0.1), (True, True, "NO STAMP", 0.1), (True, True, "NO STAMP", 0.9)], "b boolean, g boolean, d string, s double")
    got = [r.c for r in rows.select(decisions.false_negative_cause(F.col("b"), F.col("g"), F.col("d"), F.col("s")).alias("c")).collect()]
    assert got == list(decisions.CAUSES)


def test_names(spark):
    names = ["a\\b/x.png", "a.b.jpg", ".hid", "d/"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(basename(F.col("n")).alias("b"), stem(F.col("n")).alias("s"), content_type(F.col("n")).alias("t")).collect()
    assert [(r.b, r.s) for r in rows] == [("x.png", "x"), ("a.b.jpg", "a.b"), (".hid", ".hid"), ("", "")]
    assert [r.t for r in rows][:2] == ["image/png", "image/jpeg"]
    assert spark.range(1).select(folder_ballot(F.lit("ballot_ballot_001")).alias("f")).first().f == "ballot_001"


def test_claim_key(spark):
    row = spark.range(1).select(claim_key(F.lit("b"), F.lit("k"), F.lit(None).cast("string"), F.lit('"e"')).alias("k")).first()
    assert row.k == "b::k::no-version::e"


def test_merge_keys(spark):
    stamps = spark.createDataFrame([("in/a.png", 1), ("in/b.v2.png", 2), ("in/c.png", 3), ("x/c.png", 4)], "image string, position long")
    digits = spark.createDataFrame([("a.png", 1, 10), ("a.png", 2, 11), ("b.v2", 3, 12), ("b", 4, 13)], "image string, position long, found int")
    got = {r.name: (r.position, r.digit_found) for r in merge.merge_two_level(stamps, digits).collect()}
    assert got == {"a.png": (1, 11), "b.v2.png": (2, 12), "c.png": (4, None)}


def test_allocation_is_a_bijection(spark):
    ids = merge.allocate_ids(spark.range(20_000).withColumnRenamed("id", "rank"), "rank")
    row = ids.agg(F.count_distinct("random_ballot_id").alias("n"), F.min("random_ballot_id").alias("a"), F.max("random_ballot_id").alias("b")).first()
    assert row.n == 20_000 and row.a >= merge.FIRST_ID and row.b <= merge.LAST_ID
    assert merge.next_id(ids.limit(0)).first().next_id == 1_000_001


def test_keys_beyond_the_id_range(spark, tmp_path):
    from psephos.plans.merging import ballot_id_allocation

    size = merge.LAST_ID - merge.FIRST_ID + 1
    keys = [k + at for at in (0, size, 5 * size, 10**15) for k in range(1, 60)]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.ballot: r.random_ballot_id for r in ballot_id_allocation(spark, str(tmp_path)).collect()}
    used = {merge.FIRST_ID + (k * 7_368_787 + 12_345) % size for k in keys if k % 10 == 0 and k < size}
    assert set(got) == {k for k in keys if k % 10} and len(set(got.values())) == len(got)
    assert all(merge.FIRST_ID <= i <= merge.LAST_ID for i in got.values()) and not used & set(got.values())


def test_more_ballots_than_ids(spark, monkeypatch):
    monkeypatch.setattr(merge, "LAST_ID", merge.FIRST_ID + 96)
    used = spark.createDataFrame([(merge.FIRST_ID + i,) for i in (0, 5, 96)], "random_ballot_id long")
    ids = [r.random_ballot_id for r in merge.allocate_ids(spark.range(1000, 1094), "id", used).collect()]
    assert sorted(ids) == [merge.FIRST_ID + i for i in range(97) if i not in (0, 5, 96)]
    with pytest.raises(ValueError, match="free"):
        merge.allocate_ids(spark.range(1000, 1095), "id", used)
    assert merge.allocate_ids(spark.range(97), "id").count() == 97
    with pytest.raises(Exception, match="no rank 97"):
        merge.allocate_ids(spark.range(98), "id").collect()


def test_best_threshold_tie(spark):
    rows = spark.createDataFrame([(0.5, 0.2, 1.0, 1.0, 0.0), (0.4, 0.3, 1.0, 1.0, 0.0), (0.4, 0.2, 1.0, 1.0, 0.0), (0.3, 0.1, 1.0, 1.0, 0.5)], "score_valid double, score_review double, recall double, precision double, fpr double")
    best = evaluation.best(rows).first()
    assert (best.score_valid, best.score_review) == (0.4, 0.2)


BOXES = "ballot long, ord long, x long, y long, w long, h long"
BANDS = "ballot long, r long, y1 long, y2 long"


def test_assignment(spark):
    bands = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 100, 200)], BANDS)
    half = spark.createDataFrame([(1, 1, 5, 80, 40, 40)], BOXES)
    assert layout.assign_boxes(half, bands).count() == 0
    assert layout.assign_boxes(half, bands, 0.1).first().r == 1
    two = spark.createDataFrame([(1, 1, 5, 10, 40, 40), (1, 2, 9, 20, 40, 40)], BOXES)
    assert layout.assign_boxes(two, bands).first().ord == 2


def test_recovery_splits_the_tallest(spark):
    bands = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 100, 300), (1, 3, 300, 400)], BANDS)
    got = [(r.y1, r.y2) for r in layout.recover_missing(bands, 4, 1000).orderBy("r").collect()]
    assert got == [(0, 100), (100, 200), (200, 300), (300, 400)]


def test_rows_from_one_box(spark):
    one = spark.createDataFrame([(1, 1, 5, 200, 40, 40)], BOXES)
    row = layout.rows_from_boxes(one, 1000, 5).first()
    assert (row.y1, row.y2) == (172, 268)


def test_claims(spark):
    rows = [(1, "k", "2024-01-01 00:00:00", "IN_PROGRESS"), (2, "k", "2024-01-01 00:01:00", "SUCCEEDED"), (3, "k", "2024-01-01 00:03:00", "FAILED"), (4, "k", "2024-01-01 00:03:01", "SUCCEEDED"), (5, "k", "2024-01-01 09:00:00", "SUCCEEDED")]
    e = spark.createDataFrame(rows, "event_id long, key string, t string, status string").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.event_id: r.outcome for r in events.claims(e, "key", "t", "status").collect()}
    assert got == {1: "claimed", 2: "duplicate", 3: "claimed", 4: "claimed", 5: "duplicate"}


def test_sources(spark, tmp_path):
    (tmp_path / "ballot_7").mkdir()
    (tmp_path / "ballot_7" / "results.json").write_text(json.dumps([{"row": 1, "digit": 1}, {"row": 2, "digit": 2}, {"row": 3, "digit": 2}, {"row": 4, "digit": "NULL"}]))
    d = files.digit_folders(spark, str(tmp_path))
    numbers = d.filter("is_number").withColumn("n", F.col("digit").cast("int"))
    row = decisions.sequence_summary(numbers, "ballot", "n").first()
    assert (row.ballot, row.numbers_found, row.sequence_ok) == ("7", 3, False)
    (tmp_path / "m.json").write_text(json.dumps([{"image": "a.png", "decision": "REVIEW REQUIRED", "score": 0.3, "bbox": None, "geo_ok": True, "features": {}, "skew_deg": 0.0}]))
    assert files.manifest(spark, str(tmp_path / "m.json")).first().features.area_frac is None
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.txt").write_text("0 0.5 0.25 0.1 0.05\n")
    (tmp_path / "l" / "b.txt").write_text(" \n")
    assert {r.stem: r.positive for r in files.label_presence(spark, str(tmp_path / "l")).collect()} == {"a": True, "b": False}
    assert files.labels(spark, str(tmp_path / "l")).first().cy == 0.25
    (tmp_path / "rules.yaml").write_text("# x\nscore_valid: 0.38 # y\n\nscore_review: 0.18\n")
    assert files.rules(spark, str(tmp_path / "rules.yaml")) == {"score_valid": 0.38, "score_review": 0.18}
