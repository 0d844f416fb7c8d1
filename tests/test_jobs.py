"""The merge job from files to tables, and calibration from a manifest."""

from __future__ import annotations

import json

from psephos.plans import jobs
from psephos.sources import files


def test_merge_job(spark, tmp_path):
    manifest = [{"image": f"in/{n}.png", "decision": d, "score": s, "bbox": None, "geo_ok": True, "features": {}, "skew_deg": 0.0} for n, d, s in (("b1", "VALID STAMP", 0.9), ("b2", "REVIEW REQUIRED", 0.3), ("b3", "VALID STAMP", 0.8))]
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    for name, digits in (("b1", [2, 1, "NULL"]), ("b2", [1, 2, 3])):
        (tmp_path / f"ballot_{name}").mkdir()
        (tmp_path / f"ballot_{name}" / "results.json").write_text(json.dumps([{"row": i + 1, "digit": d} for i, d in enumerate(digits)]))
    candidates = spark.createDataFrame([(30, 1, "C"), (10, 1, "A"), (20, 1, "")], "id int, election_id int, name string")
    out = f"{tmp_path}/out"
    facts = jobs.run_merge(spark, str(tmp_path / "m.json"), str(tmp_path), candidates, 1, "2024-01-01 00:00:00", "hall", out)
    got = {(r.image_url, r.row_num): (r.preference, r.candidate_name, r.ballot_state) for r in facts.collect()}
    assert got[("b1.png", 1)] == (2, "A", "Valid") and got[("b1.png", 2)] == (1, "Candidate_20", "Valid") and ("b1.png", 3) not in got
    assert got[("b2.png", 3)] == (3, "C", "Doubtful") and len(got) == 5
    assert spark.read.option("header", True).csv(f"{out}/preferences").count() == 5
    assert spark.read.json(f"{out}/merged").count() == 3 and spark.read.parquet(f"{out}/tables/ballot_papers").count() == 2


def test_calibration(spark, tmp_path):
    rows = [{"image": f"{i}.png", "decision": "VALID STAMP" if i % 2 else "NO STAMP", "score": 0.2 + 0.05 * i, "bbox": [0, 0, 1, 1], "geo_ok": None} for i in range(12)]
    (tmp_path / "m.json").write_text(json.dumps(rows))
    (tmp_path / "l").mkdir()
    for i in range(12):
        (tmp_path / "l" / f"{i}.txt").write_text("0 0.5 0.5 0.1 0.1" if i > 5 else "")
    e = jobs.evaluate(files.manifest(spark, str(tmp_path / "m.json")), files.label_presence(spark, str(tmp_path / "l")))
    best = jobs.calibrate(spark, e).first()
    assert best.fp == 0 and best.tp == 3 and best.recall < 1
