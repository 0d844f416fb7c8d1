"""Sources, sinks and streams on small files."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from psephos.operators import events, merge
from psephos.plans import jobs
from psephos.sources import files, paged, sinks
from psephos.streaming import claims, watcher


def test_absent_files(spark, tmp_path):
    path = str(tmp_path / "box.json")
    assert files.optional_json(spark, path, "box_location string") is None and files.current_box(spark, path) == ""
    (tmp_path / "box.json").write_text('{"box_location": "hall"}')
    assert files.current_box(spark, path) == "hall" and files.current_box(spark, path, " gym ") == "gym"
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.manifest(spark, str(tmp_path / "none.json")).count()


def test_point_lookup(spark):
    ids = spark.range(10)
    assert files.exists(ids, "id", 3) and not files.exists(ids, "id", 30)


def test_scans_by_use(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("b.png", "a.JPG", "c.bmp", "d.webp", "e.txt", "in/f.tif", "in/g.jpeg"):
        (tmp_path / name).write_bytes(b"x")
    names = lambda use: [r.path.split(f"{tmp_path}/")[1] for r in files.scanned(spark, str(tmp_path), use).collect()]
    assert names("stamp") == ["a.JPG", "b.png", "in/f.tif", "in/g.jpeg"]
    assert names("extraction") == ["a.JPG", "b.png", "c.bmp", "in/f.tif", "in/g.jpeg"]
    assert sorted(names("digits")) == ["a.JPG", "b.png"] and names("labeler") == ["a.JPG", "b.png", "c.bmp", "d.webp"]


def test_data_sets(spark, tmp_path):
    for name, n in (("a", 2), ("b", 3)):
        (tmp_path / name).mkdir()
        for i in range(n):
            (tmp_path / name / f"{i}.txt").write_text("0 0.5 0.25 0.1 0.2\n" * i)
    got = files.data_sets(spark, {"one": str(tmp_path / "a"), "two": str(tmp_path / "b")}).collect()
    assert sorted((r["set"], r.stem) for r in got) == [("one", "1"), ("two", "1"), ("two", "2"), ("two", "2")]


def test_fetched(spark, tmp_path):
    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(200 if self.path == "/a" else 404)
            self.end_headers()
            self.wfile.write(b"content")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    (tmp_path / "x").write_bytes(b"file")
    urls = [f"{base}/a", f"{base}/b", f"file://{tmp_path}/x", "no url", None]
    got = {r.url: r.content and bytes(r.content) for r in files.fetched(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    server.shutdown()
    assert got == {urls[0]: b"content", urls[1]: None, urls[2]: b"file", "no url": None}


def test_too_many_rules(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("".join(f"k{i}: {i}\n" for i in range(files.MOST_RULES)))
    assert len(files.rules(spark, str(tmp_path / "r.yaml"))) == files.MOST_RULES
    (tmp_path / "r.yaml").write_text("".join(f"k{i}: {i}\n" for i in range(files.MOST_RULES + 1)))
    with pytest.raises(ValueError, match="more than"):
        files.rules(spark, str(tmp_path / "r.yaml"))


@pytest.mark.parametrize("pretty", [False, True])
def test_json_arrays(spark, tmp_path, pretty):
    rows = spark.range(7).select(F.col("id").alias("n"), F.when(F.col("id") % 2 == 0, "ü").alias("s")).repartition(20)
    for df, n in ((rows, 7), (rows.limit(0), 0)):
        path = str(tmp_path / f"m{n}{pretty}")
        sinks.json_array(df, path, pretty)
        texts = [f.read_text() for f in (tmp_path / f"m{n}{pretty}").glob("*.txt")]
        loaded = [x for t in texts if t for x in json.loads(t)]  # a partition without rows leaves an empty file
        assert len(loaded) == n and all(set(x) == {"n", "s"} for x in loaded)


def test_false_negative_header(spark, tmp_path):
    missed = spark.createDataFrame([("p", "why", [1, 2])], "image string, cause string, bbox array<int>").coalesce(1)
    sinks.false_negative_csv(missed, str(tmp_path / "some"))
    sinks.false_negative_csv(missed.limit(0), str(tmp_path / "none"))
    read = lambda name: [f.read_text().strip() for f in (tmp_path / name).glob("*.csv")]
    assert read("some") == ['cause,image,bbox\nwhy,p,"[1,2]"'] and read("none") == ["cause"]


def test_history_keeps_elections_and_runs(spark, tmp_path):
    manifest = [{"image": f"in/b{n}.png", "decision": "VALID STAMP", "score": 0.9, "bbox": None, "geo_ok": True, "features": {}, "skew_deg": 0.0} for n in (1, 2)]
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    for n in (1, 2):
        (tmp_path / f"ballot_b{n}").mkdir()
        (tmp_path / f"ballot_b{n}" / "results.json").write_text(json.dumps([{"row": 1, "digit": n}]))
    candidates = spark.createDataFrame([(10, 1, "A"), (10, 2, "B")], "id int, election_id int, name string")
    run = lambda election, day: {r.image_url: r.random_ballot_id for r in jobs.run_merge(spark, str(tmp_path / "m.json"), str(tmp_path), candidates, election, f"2024-01-0{day} 00:00:00", "hall", f"{tmp_path}/out").collect()}
    first, other, second, again = run(1, 1), run(2, 1), run(1, 2), run(1, 2)
    papers = spark.read.parquet(f"{tmp_path}/out/tables/ballot_papers")
    assert papers.count() == 6 and spark.read.parquet(f"{tmp_path}/out/tables/ballot_preferences").count() == 6
    assert second == again and not set(first.values()) & set(second.values()) and len(other) == 2
    assert papers.filter("election_id = 1").select("random_ballot_id").distinct().count() == 4


def test_ids_run_out(spark):
    keys = spark.range(5)
    used = spark.range(merge.FIRST_ID, merge.LAST_ID - 2).select(F.col("id").alias("random_ballot_id"))
    with pytest.raises(ValueError, match="more ids are needed"):
        merge.allocate_ids(keys, "id", used).count()


DAY = 86_400


def event_rows():
    """Claims of three keys: repeated, failed, stale, expired."""
    times = [("a", 0, "SUCCEEDED"), ("a", 10, "SUCCEEDED"), ("a", 7 * DAY - 1, "FAILED"), ("a", 7 * DAY, "FAILED"), ("a", 7 * DAY + 1, "SUCCEEDED"), ("b", 5, "IN_PROGRESS"), ("b", 100, "IN_PROGRESS"), ("b", 135, "SUCCEEDED"), ("b", 136, "X"), ("c", 9 * DAY, "FAILED"), ("c", 9 * DAY + 1, "FAILED")]
    return [(k, (10**9 + s) * 1_000_000, i, status) for i, (k, s, status) in enumerate(times)]


EXPECTED = {0: "claimed", 1: "duplicate", 2: "duplicate", 3: "claimed", 4: "claimed", 5: "claimed", 6: "duplicate", 7: "claimed", 8: "duplicate", 9: "claimed", 10: "claimed"}


def test_claims_expire(spark):
    e = spark.createDataFrame(event_rows(), "claim_key string, micros long, event_id long, status string").repartition(5)
    got = events.claims(e.withColumn("ts", F.timestamp_micros("micros")), "claim_key", "ts", "status")
    assert {r.event_id: r.outcome for r in got.collect()} == EXPECTED


@pytest.mark.parametrize("together", [True, False])
def test_stream_of_several_files(spark, tmp_path, together):
    """All files in one batch in any order, and one batch after the other; state goes once it has expired."""
    schema = "claim_key string, micros long, event_id long, status string"
    rows, sink = event_rows(), str(tmp_path / "sink")
    source = tmp_path / "source"
    source.mkdir()
    for i in range(0, len(rows), 2):
        spark.createDataFrame(sorted(rows, key=lambda r: r[1])[i : i + 2], schema).coalesce(1).write.mode("append").parquet(str(source))
        if not together:
            watcher.run_once(claims.claim_stream(spark.readStream.schema(schema).parquet(str(source))), sink, str(tmp_path / "c"))
    if together:
        watcher.run_once(claims.claim_stream(spark.readStream.schema(schema).parquet(str(source))), sink, str(tmp_path / "c"))
    assert {r.event_id: r.outcome for r in spark.read.schema(claims.OUT).parquet(sink).collect()} == EXPECTED


def test_box_as_of_over_days(spark):
    history = spark.createDataFrame([(1, 100, "a"), (1, 3 * DAY, "b"), (2, 5, "z")], "site int, s long, box string").select("site", F.timestamp_seconds("s").alias("updated_at"), "box")
    ballots = spark.createDataFrame([(1, 99, 0), (1, 100, 1), (1, 2 * DAY, 2), (1, 3 * DAY + 1, 3), (1, 9 * DAY, 4), (3, 7, 5)], "site int, s long, ballot long").select("site", F.timestamp_seconds("s").alias("t"), "ballot")
    assert {r.ballot: r.box for r in events.box_as_of(ballots, history, "t").collect()} == {0: None, 1: "a", 2: "a", 3: "b", 4: "b", 5: None}


def server():
    """What a server would answer; it must not be asked for more than is needed."""
    table = [{"id": i, "election": i % 3, "name": f"n{i}", "secret": "x"} for i in range(1037)]

    def served(request):
        assert "secret" not in request.columns
        rows = [r for r in table if all(r[c] == v for c, v in request.filters)]
        rows = sorted(rows, key=lambda r: r[request.order])[request.offset : request.offset + request.limit]
        return [{c: r[c] for c in request.columns} for r in rows]

    return served


@pytest.mark.parametrize(("page", "tasks"), [(1000, 4), (10, 3), (7, 1), (346, 2), (2000, 2)])
def test_paged_tables(spark, page, tasks):
    served = server()
    got = paged.paged(spark, served, "id long, name string", "id", {"election": 1}, page, tasks)
    assert sorted(r.id for r in got.collect()) == [i for i in range(1037) if i % 3 == 1]
    assert paged.paged(spark, served, "id long", "id", {"election": 9}, page, tasks).count() == 0


def test_paged_lookups(spark):
    served = server()
    assert paged.known(served, "id", 5) and not paged.known(served, "id", -5)
    with pytest.raises(LookupError, match="no rows"):
        paged.paged(spark, served, "id long", "id", {"election": 9}, required=True)
    keys = [{"key": k, "size": i} for i, k in enumerate(["in/", "in/a.png", "in/b/", "in/b/c.png", "out/d.png"])]
    listing = lambda q: [k for k in keys if k["key"].startswith(dict(q.filters)["prefix"])][q.offset : q.offset + q.limit]
    assert [r.key for r in paged.listed(spark, listing, "in/", page=2).collect()] == ["in/a.png", "in/b/c.png"]
