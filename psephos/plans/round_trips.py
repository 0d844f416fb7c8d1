"""Queries that write tables, files and streams and read them back, with the SQL of what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.functions import geometry, text
from psephos.operators import decisions, evaluation, events, merge
from psephos.plans import merging, scores
from psephos.plans import tables as t
from psephos.session import shared_path
from psephos.sources import files, sinks
from psephos.streaming import watcher

_AS_OF = "2024-02-01 00:00:00"


def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as a manifest of JSON arrays."""
    d = t.detections(spark, sf_dir)
    features = F.struct(F.lit(0.25).alias("area_frac"), F.lit(None).cast("double").alias("circularity"), F.lit(0.0).alias("ellipse_edge_pct"), F.lit(0.0).alias("template_ncc"), (F.col("doc_id") % 4).cast("int").alias("blob_count"), F.lit(0.0).alias("blob_spread"))
    box = F.when(F.col("has_box"), F.array(*[(F.col("doc_id") % n).cast("int") for n in (3, 5, 7, 11)]))
    rows = d.select(F.concat(F.lit("in/ü "), F.col("doc_id").cast("string"), F.lit(".png")).alias("image"), "decision", "score", box.alias("bbox"), F.when(F.col("doc_id") % 3 != 0, F.col("geometry_ok")).alias("geo_ok"), features.alias("features"), F.lit(0.5).alias("skew_deg"))
    path = shared_path(spark, "manifest")
    sinks.json_array(rows, path)
    back = files.manifest(spark, path)
    return back.select("image", "decision", F.round("score", 9).alias("score"), F.get("bbox", F.lit(3)).alias("last"), "geo_ok", F.col("features.blob_count").alias("blobs"), "skew_deg")


def merged_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "merged")
    rows = merging.ballot_state(spark, sf_dir)
    sinks.json_lines(rows, path)
    return spark.read.schema(rows.schema).json(path)


def preference_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts as CSV with a header."""
    rows = merging.preference_facts(spark, sf_dir)
    named = {"created_at": F.lit("2024-02-01T00:00:00Z"), "election_id": F.col("election"), "random_ballot_id": F.col("ballot"), "ballot_state": F.lit("Valid"), "box_location": F.lit('hall, "east"'), "image_url": F.concat(F.col("ballot").cast("string"), F.lit(".png"))}
    path = shared_path(spark, "facts")
    sinks.preference_csv(rows.withColumns(named), path)
    schema = ", ".join(f"{c} {'long' if c in ('election_id', 'random_ballot_id', 'row_num', 'candidate_id', 'preference') else 'string'}" for c in sinks.FACTS)
    return spark.read.schema(schema).option("header", True).csv(path)


def false_negative_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    missed = evaluation.false_negatives(t.detections(spark, sf_dir)).select("doc_id", "cause", F.round("score", 6).alias("score"), "has_box")
    path = shared_path(spark, "missed")
    sinks.false_negative_csv(missed, path)
    return spark.read.schema("cause string, doc_id long, score double, has_box boolean").option("header", True).csv(path)


def object_event_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as batches of records, keys escaped."""
    e = t.read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"), "user_id", "event_type")
    key = F.concat(F.lit("in+"), F.col("user_id").cast("string"), F.lit("%2F"), F.col("event_type"), F.lit(".png"))
    stored = F.struct(key.alias("key"), F.when(F.col("event_id") % 3 == 0, "v1").alias("versionId"), F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('"')).alias("eTag"), F.format_string("%010d", "event_id").alias("sequencer"))
    record = F.struct(F.col("at").alias("eventTime"), F.struct(F.struct(F.lit("b").alias("name")).alias("bucket"), stored.alias("object")).alias("s3"))
    path = shared_path(spark, "object-events")
    sinks.json_lines(e.groupBy(F.floor(F.col("event_id") / 10).alias("batch")).agg(F.collect_list(record).alias("Records")).select("Records"), path)
    back = files.object_events(spark, path)
    return back.select("event_time", "bucket", "key", "sequencer", text.claim_key(F.col("bucket"), F.col("key"), F.col("version"), F.col("etag")).alias("claim_key"))


def ballot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two elections in two runs each, the second one repeated: what the history holds."""
    path = shared_path(spark, "history")
    orders = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ballot"), (F.col("o_orderkey") % 2).alias("election_id"))
    for election in (0, 1):
        own = orders.filter(F.col("election_id") == election)
        for run, part in (("r1", own.filter("ballot % 3 <> 0")), ("r2", own.filter("ballot % 3 = 0")), ("r2", own.filter("ballot % 3 = 0"))):
            used = sinks.ids_in_use(spark, path, election, run)
            ids = merge.allocate_ids(merge.hash_ranked(part, "ballot"), "_rank", used).drop("_rank")
            sinks.ballots_and_preferences(ids, ids.select("election_id", "random_ballot_id", F.lit(1).alias("preference")), path, run)
    papers = spark.read.parquet(f"{path}/ballot_papers").withColumn("run", F.col("run").cast("string"))
    alike = papers.groupBy("election_id", "random_ballot_id").agg(F.count("*").alias("holders"))
    preferences = spark.read.parquet(f"{path}/ballot_preferences").groupBy("election_id", "random_ballot_id").agg(F.count("*").alias("preferences"))
    key = ["election_id", "random_ballot_id"]
    return papers.join(alike, key).join(preferences, key).select("ballot", F.col("election_id").cast("long").alias("election_id"), "run", "holders", "preferences", F.col("random_ballot_id").between(merge.FIRST_ID, merge.LAST_ID).alias("in_range"))


def box_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as sites whose box moves twice."""
    path, r = shared_path(spark, "box"), t.read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("site"), F.col("r_name").alias("box_location"))
    sinks.box_location(r, path, "2024-01-01 00:00:00")
    sinks.box_location(r.filter("site > 1").withColumn("box_location", F.lower("box_location")), path, "2024-01-02 00:00:00")
    return spark.read.parquet(path).select("site", "box_location", F.date_format("updated_at", "yyyy-MM-dd").alias("day"))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with the hash of the model that a record keeps."""
    path, d = shared_path(spark, "audit"), t.detections(spark, sf_dir).select("doc_id", "decision")
    spark.range(1).select(F.lit("weights")).coalesce(1).write.text(f"{path}/model")
    sinks.audit_record(spark, d, f"{path}/model/*.txt", f"{path}/log", _AS_OF)
    record = spark.read.json(f"{path}/log/record").select("ts", "model_sha256", F.col("python").isNotNull().alias("has_environment"))
    rows = spark.read.schema("doc_id long, decision string").option("multiLine", True).json(f"{path}/log/inference")
    return rows.crossJoin(F.broadcast(record.limit(1)))


def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each key claims it; later ones change its status, failures with an error."""
    e = t.object_events(spark, sf_dir).select("claim_key", "ts", "event_id", "status")
    first = e.groupBy("claim_key").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    held = first.select("claim_key", F.lit("IN_PROGRESS").alias("status"), F.col("f.ts").alias("created_at"), F.col("f.ts").alias("updated_at"), events.expiry(F.col("f.ts")).alias("ttl"), F.lit(None).cast("string").alias("details"))
    later = e.join(first, "claim_key").filter("event_id <> f.event_id AND status <> 'IN_PROGRESS'")
    changes = later.select("claim_key", "status", F.col("ts").alias("at"), F.when(F.col("status") == "FAILED", F.concat(F.lit("error "), F.col("event_id").cast("string"))).alias("details"))
    out = events.transitions(held, changes)
    return out.select("claim_key", "status", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated"), F.col("ttl").cast("long").alias("ttl"), "details")


def watcher_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three polls of a listing; a fifth of the pages fails at first, a tenth always."""
    path, listing = shared_path(spark, "outcomes"), t.read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("key"))
    for number in (1, 2, 3):
        fails = F.expr(f"CAST(key AS BIGINT) % 10 = 0 OR ({number} = 1 AND CAST(key AS BIGINT) % 5 = 0)")
        watcher.poll(listing, path, lambda todo, fails=fails: todo.select("key", (~fails).alias("ok"), F.when(fails, "no luck").alias("error")))
    return spark.read.parquet(path).select("key", "ok", "error", F.col("poll").cast("long").alias("poll"))


def stream_newest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user in a micro-batch."""
    base = shared_path(spark, "newest")
    order = F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.format_string("%010d", "event_id"))
    e = t.read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", order.alias("o"))
    e.repartition(4, "event_id").write.parquet(f"{base}/source")
    watcher.run_newest(spark.readStream.schema(e.schema).parquet(f"{base}/source"), F.col("o"), ["user_id"], f"{base}/sink", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/sink").select("user_id", "event_id", "event_type")


def event_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event's batch answers; every ninth one has no record."""
    e = t.object_events(spark, sf_dir)
    outcome = events.claims(e, "claim_key", "ts", "status", 14_400).select("event_id", "outcome")
    return e.select("event_id").join(outcome, "event_id").select("event_id", events.response((F.col("event_id") % 9 != 0).cast("int"), F.col("outcome")).alias("response"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped addresses, numbered names and counted byte patterns of pages."""
    p = t.read(spark, sf_dir, "pages").select("page_id", "url", "html")
    name = text.numbered_filename(text.basename(F.col("url")), F.col("page_id") % 3)
    return p.select("page_id", text.html_escaped(F.concat(F.lit("<a href=\"x\">'&'"), F.col("url"))).alias("escaped"), name.alias("file"), text.byte_matches(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), "<p[> ]").alias("paragraphs"))


def top_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of a vector's 64 numbers, the earlier one if equal."""
    v = t.read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: F.struct(x.cast("double").alias("score"), (-i).alias("first"))).alias("c"))
    best = F.slice(F.sort_array("c", asc=False), 1, 3)
    return v.select("vec_id", F.posexplode(best).alias("k", "b")).select("vec_id", (F.col("k") + 1).cast("long").alias("rank"), (-F.col("b.first")).cast("long").alias("class"), F.round("b.score", 6).alias("score"))


def box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of the page that a box takes, and how round it would be with its sides as perimeter."""
    b = t.boxes(spark, sf_dir)
    frac = geometry.area_fraction(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"), F.lit(t.WIDTH), F.lit(t.HEIGHT))
    return b.select("ballot", "ord", F.round(frac, 9).alias("area_frac"), F.round(geometry.circularity(F.col("w") * F.col("h"), 2 * (F.col("w") + F.col("h"))), 9).alias("circularity"))


def default_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions under thresholds from a rule file with comments, blanks and junk."""
    path = shared_path(spark, "rules")
    lines = ["# thresholds", "score_valid: 0.5  # higher", "", "score_review:0.25", "name: x", "no pair"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    rules = files.rules(spark, path)
    d = t.detections(spark, sf_dir)
    limits = decisions.Thresholds(rules["score_valid"], rules["score_review"])
    return d.select("doc_id", decisions.stamp_decision(F.col("score"), F.col("geometry_ok"), limits).alias("decision"))


QUERIES = {f.__name__: f for f in (manifest_round_trip, merged_round_trip, preference_csv_round_trip, false_negative_csv, object_event_scan, ballot_history, box_history, audit_log, status_transitions, watcher_retries, stream_newest_event, event_responses, page_text, top_classes, box_measures, default_rules)}

_D = merging._DECIDED
ORACLES = {
    "manifest_round_trip": f"SELECT 'in/ü ' || doc_id || '.png' AS image, decision, round(score, 9) AS score, CASE WHEN has_box THEN doc_id % 11 END AS last, CASE WHEN doc_id % 3 <> 0 THEN geometry_ok END AS geo_ok, doc_id % 4 AS blobs, 0.5::DOUBLE AS skew_deg FROM ({_D})",
    "merged_round_trip": merging.ORACLES["ballot_state"],
    "preference_csv_round_trip": f"SELECT '2024-02-01T00:00:00Z' AS created_at, election AS election_id, ballot AS random_ballot_id, 'Valid' AS ballot_state, 'hall, \"east\"' AS box_location, ballot || '.png' AS image_url, row_num, candidate_id, candidate_name, preference FROM ({merging.ORACLES['preference_facts']})",
    "false_negative_csv": f"SELECT doc_id, cause, round(score, 6) AS score, has_box FROM ({merging._MISSED})",
    "event_responses": f"SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'ignored' WHEN outcome = 'duplicate' THEN 'duplicate' ELSE 'ok' END AS response FROM ({scores._REPLAY})",
    "status_transitions": f"""WITH e AS ({scores._EVENTS}), f AS (SELECT claim_key, arg_min(event_id, struct_pack(t := ts, e := event_id)) AS id, min(ts) AS ts FROM e GROUP BY 1),
l AS (SELECT e.claim_key, arg_max(status, e.ts) AS status, max(e.ts) AS seen, arg_max('error ' || event_id, e.ts) FILTER (status = 'FAILED') AS details FROM e JOIN f ON f.claim_key = e.claim_key WHERE event_id <> f.id AND status <> 'IN_PROGRESS' GROUP BY 1)
SELECT f.claim_key, coalesce(l.status, 'IN_PROGRESS') AS status, epoch_us(f.ts) AS created, epoch_us(coalesce(seen, f.ts)) AS updated, CAST(floor(epoch_us(f.ts) / 1000000) AS BIGINT) + 604800 AS ttl, details FROM f LEFT JOIN l USING (claim_key)""",
    "object_event_scan": "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS event_time, 'b' AS bucket, 'in ' || user_id || '/' || event_type || '.png' AS key, printf('%010d', event_id) AS sequencer, 'b::in ' || user_id || '/' || event_type || '.png::' || CASE WHEN event_id % 3 = 0 THEN 'v1' ELSE 'no-version' END || '::' || event_id AS claim_key FROM events",
    "ballot_history": "SELECT o_orderkey AS ballot, o_orderkey % 2 AS election_id, CASE WHEN o_orderkey % 3 = 0 THEN 'r2' ELSE 'r1' END AS run, 1 AS holders, 1 AS preferences, true AS in_range FROM orders",
    "box_history": "SELECT r_regionkey AS site, r_name AS box_location, '2024-01-01' AS day FROM region UNION ALL SELECT r_regionkey, lower(r_name), '2024-01-02' FROM region WHERE r_regionkey > 1",
    "audit_log": f"SELECT doc_id, decision, '2024-02-01T00:00:00Z' AS ts, sha256('weights' || chr(10)) AS model_sha256, true AS has_environment FROM ({_D})",
    "watcher_retries": "SELECT page_id::VARCHAR AS key, n.poll, NOT (page_id % 10 = 0 OR (poll = 1 AND page_id % 5 = 0)) AS ok, CASE WHEN page_id % 10 = 0 OR (poll = 1 AND page_id % 5 = 0) THEN 'no luck' END AS error FROM pages, range(1, 4) n(poll) WHERE poll = 1 OR page_id % 10 = 0 OR (poll = 2 AND page_id % 5 = 0)",
    "page_text": f"SELECT page_id, '&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;' || replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped, CASE WHEN page_id % 3 = 0 THEN base ELSE stem || '_' || page_id % 3 || substr(base, length(stem) + 1) END AS file, len(regexp_extract_all(coalesce(html, ''), '<p[> ]')) AS paragraphs FROM (SELECT *, {merging._STEM.format('base')} AS stem FROM (SELECT *, {merging._BASE} AS base FROM pages))",
    "top_classes": "SELECT vec_id, rank, i AS class, round(x, 6) AS score FROM (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x, row_number() OVER (PARTITION BY vec_id ORDER BY embedding[i + 1] DESC, i) AS rank FROM embeddings, range(64) t(i)) WHERE rank <= 3",
    "box_measures": f"SELECT ballot, row_num AS ord, round((36 + s % 15) * (30 + p % 13) / (1000000 + 1e-9::DOUBLE), 9) AS area_frac, round(4 * pi() * (36 + s % 15) * (30 + p % 13) / pow(2 * (66 + s % 15 + p % 13), 2), 9) AS circularity FROM ({merging.DIGITS}) WHERE p % 4 <> 0",
    "default_rules": f"SELECT doc_id, CASE WHEN score >= 0.5 AND geometry_ok THEN 'VALID STAMP' WHEN score < 0.25 OR NOT geometry_ok THEN 'NO STAMP' ELSE 'REVIEW REQUIRED' END AS decision FROM ({merging._DETECTIONS})",
    "stream_newest_event": scores.ORACLES["newest_event"],
}
