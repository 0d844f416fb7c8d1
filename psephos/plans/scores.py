"""Queries of scoring, tiles, data sets and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.functions import geometry, scoring
from psephos.operators import dataset, decisions, events, kernels, tiles
from psephos.plans import tables as t
from psephos.streaming import claims, watcher

SIDE, INK = 8, 0.05
_AS_OF = "2024-02-01 00:00:00"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten class probabilities: the first ten of each vector's 64 numbers stand for a classifier's logits; all vectors are read."""
    logits = F.transform(F.slice("v", 1, 10), lambda x: F.round(x * 8, 6))
    return _vectors(spark, sf_dir).select("vec_id", scoring.softmax(logits).alias("p"))


def class_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    return _classes(spark, sf_dir).select("vec_id", scoring.argmax(p).cast("long").alias("class"), F.round(F.array_max(p), 6).alias("confidence"), F.round(scoring.margin(p), 6).alias("margin"), F.round(scoring.entropy(p), 6).alias("entropy"), F.round(scoring.variant_score(p), 6).alias("score"))


def calibrated_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities at temperature 1.7, in long form."""
    p = _classes(spark, sf_dir).select("vec_id", F.posexplode(scoring.normalised(scoring.tempered(F.col("p"), 1.7))).alias("class", "p"))
    return p.select("vec_id", F.col("class").cast("long").alias("class"), F.round("p", 6).alias("p"))


def variant_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five variants of each vector (ten numbers each, the last 14 of 64 stand for nothing): the best of three safe ones; the others may only confirm it."""
    variants = _vectors(spark, sf_dir).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), "v")
    logits = F.transform(F.slice("v", F.col("k") * 10 + 1, F.lit(10)), lambda x: F.round(x * 8, 6))
    scored = variants.select("vec_id", "k", scoring.softmax(logits).alias("p")).select("vec_id", F.col("k").cast("long").alias("k"), scoring.argmax(F.col("p")).cast("long").alias("class"), F.round(scoring.variant_score(F.col("p")), 6).alias("score"))
    key = F.struct(F.col("score").alias("s"), (-F.col("k")).alias("first"))
    safe = scored.filter("k < 3").groupBy("vec_id").agg(F.max_by(F.struct("k", "class", "score"), key).alias("safe"))
    bold = scored.filter("k >= 3").join(safe, "vec_id").filter("class = safe.class AND score > safe.score").groupBy("vec_id").agg(F.max_by(F.struct("k", "class", "score"), key).alias("bold"))
    best = F.coalesce("bold", "safe")
    return safe.join(bold, "vec_id", "left").select("vec_id", best["k"].alias("variant"), best["class"].alias("class"), best["score"].alias("score"))


def mask_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digit-likeness from made-up mask statistics."""
    d = t.read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    n = F.col("n_chars")
    return d.select("doc_id", F.round(scoring.mask_score(n % 300 / 1000, n % 97, n % 7, n % 23), 9).alias("score"))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.pixels(t.read(spark, sf_dir, "embeddings"), "vec_id", "embedding", SIDE)


def tile_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.ink_box(_pixels(spark, sf_dir), F.col("v") > INK).select("tile", "ink", "x0", "x1", "y0", "y1")


def tile_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tiles.ink_box(_pixels(spark, sf_dir), F.col("v") > INK)
    shift = tiles.centring_shift(F.col("cx"), F.col("cy"), SIDE)
    return c.select("tile", F.round("cx", 9).alias("cx"), F.round("cy", 9).alias("cy"), shift["dx"].alias("dx"), shift["dy"].alias("dy"))


def tile_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tiles.profile(_pixels(spark, sf_dir), F.col("v") > INK, SIDE)
    return p.select("tile", "y", F.round("mean_ink", 9).alias("mean_ink"))


def tile_blank_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits scaled to tiles of 64 pixels."""
    box = tiles.ink_box(_pixels(spark, sf_dir), F.col("v") > 0.15)
    blank = decisions.blank_tile(F.col("ink"), SIDE, F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), least_ink=8, least_fraction=0.1)
    return box.select("tile", F.coalesce(blank, F.lit(True)).alias("blank"))


def tile_dark_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tiles.dark_fraction(_pixels(spark, sf_dir))
    return d.select("tile", F.round("dark", 9).alias("dark"))


def tile_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _vectors(spark, sf_dir).select("vec_id", F.posexplode(kernels.tile_components(F.col("v"), SIDE, INK)).alias("k", "c"))
    return found.select("vec_id", F.col("k").cast("long").alias("k"), "c.*")


def tile_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", kernels.tile_otsu(F.col("v")).alias("level"))


def tile_ncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile against the mean tile of its label; there are ten labels."""
    cells = _vectors(spark, sf_dir).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    mean = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c.x).alias("template"))
    return _vectors(spark, sf_dir).join(mean, "label").select("vec_id", F.round(kernels.tile_ncc(F.col("v"), F.col("template")), 6).alias("ncc"))


def dataset_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.shuffle_split(t.read(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def stratified_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.stratified_plan(spark)


def replicated_training_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real rows 25 times, synthetic ones once."""
    d = t.read(spark, sf_dir, "documents").select("doc_id")
    return dataset.replicated(d.filter("doc_id % 10 = 0"), d.filter("doc_id % 10 <> 0"), 25)


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a synthetic stamp goes, by weight, from a hash of the row."""
    d = t.read(spark, sf_dir, "documents").select("doc_id")
    return d.select("doc_id", dataset.weighted_choice(dataset.drawn(F.col("doc_id"), "42"), list(dataset.POSITIONS)).alias("place"))


def parity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and size of each text here and of a copy of which some are changed."""
    d = t.read(spark, sf_dir, "documents").select("doc_id", "text")
    side = lambda text: d.select("doc_id", F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"))
    remote = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("x"))).when(F.col("doc_id") % 17 == 0, F.reverse("text")).otherwise(F.col("text"))
    return dataset.parity(side(F.col("text")), side(remote), "doc_id", ["sha256", "bytes"])


def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each batch of a hundred detections, its rows as JSON."""
    d = t.detections(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 100))
    return dataset.audit(d, "batch", ["doc_id", "decision"], _AS_OF).select("batch", "n", "ts", F.to_json("inference").alias("inference"))


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its label as text, empty where there is none."""
    d, known = t.read(spark, sf_dir, "documents").select("doc_id"), t.read(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(known, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("label"))


def newest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user by time and sequence, as strings."""
    order = F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.format_string("%010d", "event_id"))
    e = t.read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return events.newest(e.select("user_id", "event_id", "event_type", order.alias("o")), F.col("o"), ["user_id"]).select("user_id", "event_id", "event_type")


def idempotency_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims in time order; a claim in progress is stale after four hours here, events being sparse."""
    return events.claims(t.object_events(spark, sf_dir), "claim_key", "ts", "status", 14_400)


def pending_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.object_events(spark, sf_dir)
    return events.pending(e.select("event_id", "claim_key"), e.filter("status = 'SUCCEEDED' AND event_id % 50 = 0"), "claim_key")


def claim_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.object_events(spark, sf_dir)
    return e.select("event_id", events.expiry(F.col("ts")).cast("long").alias("ttl"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), events.created_at(F.when(F.col("event_id") % 5 != 0, F.col("ts").cast("string")).otherwise("no time")).isNotNull().alias("parsed"))


def box_location_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as ballots, sign-ups as changes of the box's place, for each of ten sites."""
    e = t.read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("site"), "ts", "event_id", "event_type")
    history = e.filter("event_type = 'signup'").select("site", F.col("ts").alias("updated_at"), F.concat(F.lit("box-"), F.col("event_id").cast("string")).alias("box"))
    return events.box_as_of(e.filter("event_type = 'click'").select("site", F.col("ts").alias("taken_at"), F.col("event_id").alias("ballot")), history, "taken_at").select("site", "ballot", "box")


def _streamed(spark: SparkSession, rows: DataFrame, what: str) -> tuple[str, str, str]:
    """Rows written as a source folder; paths of the source, of a sink and of a checkpoint."""
    from psephos.session import shared_path

    base = shared_path(spark, what)
    rows.write.parquet(f"{base}/source")
    return f"{base}/source", f"{base}/sink", f"{base}/checkpoint"


def stream_idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay as a stream: one state for each key, worked off and stopped."""
    e = t.object_events(spark, sf_dir).select("claim_key", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_id", "status")
    source, sink, checkpoint = _streamed(spark, e.repartition(6, "event_id"), "claims")
    stream = spark.readStream.schema(e.schema).parquet(source)
    watcher.run_once(claims.claim_stream(stream, 14_400), sink, checkpoint)
    return spark.read.schema(claims.OUT).parquet(sink)


def stream_watcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New image keys of a listing, without those that were there at the start."""
    p = t.read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("in/"), F.col("page_id").cast("string"), F.get(F.array(*[F.lit(x) for x in (".png", ".JPG", "/", ".txt")]), (F.col("page_id") % 4).cast("int"))).alias("key"))
    source, sink, checkpoint = _streamed(spark, p, "listing")
    stream = watcher.seeded(watcher.watch(spark, source, "page_id long, key string"), p.filter("page_id % 6 = 0").select("key"))
    watcher.run_once(stream, sink, checkpoint)
    return spark.read.schema("page_id long, key string").parquet(sink).select("page_id", "key")


def quad_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners in order and the cosine at the first one."""
    d = t.read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n"))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    n = F.col("n")
    q = geometry.quad_order(F.array(point(600 + n % 17, 500 + n % 13), point(n % 19, n % 23), point(n % 29, 500 + n % 31), point(600 + n % 7, n % 11)))
    q = d.select("doc_id", q.alias("q"))
    at = lambda i, c: F.col("q")[i][c]
    cosine = geometry.corner_cosine(at(3, "x"), at(3, "y"), at(0, "x"), at(0, "y"), at(1, "x"), at(1, "y"))
    return q.select("doc_id", *[at(i, c).alias(f"{c}{i}") for i in range(4) for c in "xy"], F.round(cosine, 9).alias("cosine"))


QUERIES = {f.__name__: f for f in (class_prediction, calibrated_probs, variant_choice, mask_scores, tile_bbox, tile_centroid, tile_profile, tile_blank_gate, tile_dark_fraction, tile_components, tile_otsu, tile_ncc, dataset_split, stratified_plan, replicated_training_list, placements, parity_check, audit_rollup, label_table, newest_event, idempotency_replay, pending_events, claim_expiry, box_location_as_of, stream_idempotency, stream_watcher, quad_geometry)}

_P = """WITH l AS (SELECT vec_id, k, i, round(embedding[k * 10 + i + 1]::DOUBLE * 8, 6) AS x FROM embeddings, range(5) a(k), range(10) b(i)),
m AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id, k)) AS e FROM l), p AS MATERIALIZED (SELECT vec_id, k, i, e / sum(e) OVER (PARTITION BY vec_id, k) AS p FROM m),
s AS MATERIALIZED (SELECT vec_id, k, arg_max(i, struct_pack(p := p, f := -i)) AS class, max(p) AS top, max(p) - list_sort(list(p), 'DESC')[2] AS margin, -sum(p * ln(greatest(p, 1e-12))) AS entropy FROM p GROUP BY 1, 2),
v AS MATERIALIZED (SELECT *, round(2.2 * margin + top - 0.35 * greatest(0, entropy - 1.6), 6) AS score FROM s)
"""
_PIX = "SELECT vec_id AS tile, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i)"
_EVENTS = "SELECT event_id, ts, user_id, event_type, 'bucket::user/' || user_id || '::no-version::' || event_type AS claim_key, CASE WHEN event_type = 'error' THEN 'FAILED' WHEN value > 50 THEN 'IN_PROGRESS' ELSE 'SUCCEEDED' END AS status FROM events"
_REPLAY = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY claim_key ORDER BY ts, event_id) AS k FROM ({_EVENTS})),
f AS (SELECT claim_key, k, event_id, 'claimed' AS outcome, status AS state, ts AS since, 1 AS claims FROM e WHERE k = 1
UNION ALL SELECT claim_key, k, event_id, CASE WHEN free THEN 'claimed' ELSE 'duplicate' END, CASE WHEN free THEN status ELSE state END, CASE WHEN free THEN ts ELSE since END, claims + free::INT
FROM (SELECT e.*, f.state, f.since, f.claims, f.state = 'FAILED' OR (f.state = 'IN_PROGRESS' AND epoch_us(e.ts) - epoch_us(f.since) >= 14400000000) OR epoch_us(e.ts) - epoch_us(f.since) >= 604800000000 AS free FROM f JOIN e ON e.claim_key = f.claim_key AND e.k = f.k + 1))
SELECT claim_key, event_id, outcome, CAST(claims AS BIGINT) AS claims FROM f"""
_COMPONENTS = f"""WITH RECURSIVE ink AS MATERIALIZED (SELECT tile, y * 8 + x AS p, x, y FROM ({_PIX}) WHERE v > 0.05),
e AS MATERIALIZED (SELECT a.tile, a.p AS a, b.p AS b FROM ink a JOIN ink b ON a.tile = b.tile AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
r(tile, a, b) AS (SELECT tile, a, b FROM e UNION SELECT r.tile, r.a, e.b FROM r JOIN e ON r.tile = e.tile AND r.b = e.a),
l AS (SELECT tile, a AS p, min(b) AS root FROM r GROUP BY 1, 2),
c AS (SELECT tile, root, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM ink JOIN l USING (tile, p) GROUP BY 1, 2)
SELECT tile AS vec_id, row_number() OVER (PARTITION BY tile ORDER BY root) - 1 AS k, x, y, w, h, area FROM c"""
_OTSU = f"""WITH s AS (SELECT tile, v, min(v) OVER t AS low, max(v) OVER t AS high FROM ({_PIX}) WINDOW t AS (PARTITION BY tile)),
g AS (SELECT tile, CASE WHEN high > low THEN CAST(round_even((v - low) / (high - low) * 255, 0) AS BIGINT) ELSE 0 END AS g FROM s),
n AS (SELECT tile, g, count(*)::DOUBLE AS n FROM g GROUP BY 1, 2),
c AS (SELECT tile, g, sum(n) OVER o AS w, sum(n * g) OVER o AS m, sum(n) OVER t AS total, sum(n * g) OVER t AS whole FROM n WINDOW o AS (PARTITION BY tile ORDER BY g), t AS (PARTITION BY tile)),
b AS (SELECT tile, g, CASE WHEN w < total THEN w * (total - w) * ((m / w - (whole - m) / (total - w)) * (m / w - (whole - m) / (total - w))) ELSE 0 END AS between_classes FROM c)
SELECT tile AS vec_id, arg_min(g, struct_pack(b := -between_classes, g := g)) AS level FROM b GROUP BY 1"""
_NCC = """WITH v AS (SELECT vec_id, label, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) t(i)), t AS (SELECT label, i, avg(x) AS t FROM v GROUP BY 1, 2),
p AS (SELECT vec_id, x - avg(x) OVER w AS a, t - avg(t) OVER w AS b FROM v JOIN t USING (label, i) WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id, round(CASE WHEN sum(a * a) * sum(b * b) > 0 THEN sum(a * b) / sqrt(sum(a * a) * sum(b * b)) ELSE 0 END, 6) AS ncc FROM p GROUP BY 1"""
ORACLES = {
    "tile_components": _COMPONENTS,
    "tile_otsu": _OTSU,
    "tile_ncc": _NCC,
    "class_prediction": f"{_P} SELECT vec_id, class, round(top, 6) AS confidence, round(margin, 6) AS margin, round(entropy, 6) AS entropy, score FROM v WHERE k = 0",
    "calibrated_probs": f"{_P}, w AS (SELECT vec_id, i, pow(greatest(p, 1e-12), 1 / 1.7::DOUBLE) AS w FROM p WHERE k = 0) SELECT vec_id, i AS class, round(w / sum(w) OVER (PARTITION BY vec_id), 6) AS p FROM w",
    "variant_choice": f"{_P}, sf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, k) AS n FROM v WHERE k < 3) WHERE n = 1), bd AS (SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY v.vec_id ORDER BY v.score DESC, v.k) AS n FROM v JOIN sf ON sf.vec_id = v.vec_id WHERE v.k >= 3 AND v.class = sf.class AND v.score > sf.score) WHERE n = 1) SELECT sf.vec_id, coalesce(bd.k, sf.k) AS variant, coalesce(bd.class, sf.class) AS class, coalesce(bd.score, sf.score) AS score FROM sf LEFT JOIN bd ON bd.vec_id = sf.vec_id",
    "mask_scores": "SELECT doc_id, round(CASE WHEN i <= 0 THEN -999 ELSE 2 * least(1, i / 0.06::DOUBLE) + 2 * least(1, (n_chars % 97) / 80) - 0.4::DOUBLE * greatest(0, n_chars % 7 - 2) - 0.2::DOUBLE * least(10, n_chars % 23) + CASE WHEN i < 0.002 THEN -5 WHEN i > 0.25 THEN -2 ELSE 0 END END, 9) AS score FROM (SELECT doc_id, n_chars, (n_chars % 300) / 1000 AS i FROM documents)",
    "tile_bbox": f"SELECT tile, count(*) FILTER (v > 0.05) AS ink, min(x) FILTER (v > 0.05) AS x0, max(x) FILTER (v > 0.05) AS x1, min(y) FILTER (v > 0.05) AS y0, max(y) FILTER (v > 0.05) AS y1 FROM ({_PIX}) GROUP BY 1",
    "tile_centroid": f"SELECT tile, round(cx, 9) AS cx, round(cy, 9) AS cy, CAST(greatest(-2, least(2, round_even(3.5 - cx, 0))) AS BIGINT) AS dx, CAST(greatest(-2, least(2, round_even(3.5 - cy, 0))) AS BIGINT) AS dy FROM (SELECT tile, avg(x) FILTER (v > 0.05) AS cx, avg(y) FILTER (v > 0.05) AS cy FROM ({_PIX}) GROUP BY 1)",
    "tile_profile": f"SELECT tile, y, round(avg((v > 0.05)::INT), 9) AS mean_ink FROM ({_PIX}) WHERE x < 6 GROUP BY 1, 2",
    "tile_blank_gate": f"SELECT tile, coalesce(ink < 8 OR ink / 64 < 0.1 OR ((w < 0.10 OR h < 0.18) AND NOT (h > 0.55 AND w / h < 0.3)), true) AS blank FROM (SELECT tile, count(*) FILTER (v > 0.15) AS ink, (max(x) FILTER (v > 0.15) - min(x) FILTER (v > 0.15) + 1) / 8 AS w, (max(y) FILTER (v > 0.15) - min(y) FILTER (v > 0.15) + 1) / 8 AS h FROM ({_PIX}) GROUP BY 1)",
    "tile_dark_fraction": f"WITH i AS (SELECT * FROM ({_PIX}) WHERE x BETWEEN 2 AND 6 AND y BETWEEN 2 AND 6), l AS (SELECT tile, quantile_cont(v, 0.6) AS q FROM i GROUP BY 1) SELECT tile, round(avg((v < q)::INT), 9) AS dark FROM i JOIN l USING (tile) GROUP BY 1",
    "dataset_split": "WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY md5('123:' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= trunc(0.15 * n) THEN 'test' WHEN k <= 2 * trunc(0.15 * n) THEN 'val' ELSE 'train' END AS split FROM k",
    "stratified_plan": "WITH p AS (SELECT * FROM (VALUES (0, 'top_instruction_text', 12), (1, 'candidate_name_party_text', 8), (2, 'party_logo_or_candidate_photo', 6), (3, 'blank_white_area', 8), (4, 'near_page_edge_or_margin', 4), (5, 'partly_off_ballot_area', 2), (6, 'none', 10)) v(place, category, n)), e AS (SELECT row_number() OVER (ORDER BY place, i) AS ordinal, category FROM p, range(12) t(i) WHERE i < n) SELECT ordinal, category, category <> 'none' AS stamped, CASE WHEN category <> 'none' THEN ['clear_dark', 'normal_grey', 'faint_light', 'slightly_rotated', 'overlapping_dark_text'][(ordinal - 1) % 5 + 1] END AS appearance FROM e",
    "replicated_training_list": "SELECT doc_id, i + 1 AS copy FROM documents, range(25) t(i) WHERE doc_id % 10 = 0 OR i = 0",
    "placements": "SELECT doc_id, CASE WHEN f < 0.35 THEN 'border' WHEN f < 0.6 THEN 'anywhere' WHEN f < 0.85 THEN 'top' ELSE 'right_column' END AS place FROM (SELECT doc_id, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT / 4294967296 AS f FROM documents)",
    "parity_check": "WITH b AS (SELECT doc_id, text AS a, CASE WHEN doc_id % 13 = 0 THEN text || 'x' WHEN doc_id % 17 = 0 THEN reverse(text) ELSE text END AS b FROM documents) SELECT doc_id, a = b AS same_sha256, octet_length(encode(a)) = octet_length(encode(b)) AS same_bytes, a = b AS same FROM b",
    "audit_rollup": "SELECT doc_id // 100 AS batch, count(*) AS n, '2024-02-01T00:00:00Z' AS ts, '[' || string_agg('{\"doc_id\":' || doc_id || ',\"decision\":\"' || CASE WHEN (n_chars % 1000) / 1000.0 >= 0.38 AND toxic = 0 THEN 'VALID STAMP' WHEN (n_chars % 1000) / 1000.0 < 0.18 OR toxic <> 0 THEN 'NO STAMP' ELSE 'REVIEW REQUIRED' END || '\"}', ',' ORDER BY doc_id) || ']' AS inference FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "label_table": "SELECT doc_id, coalesce(quality::VARCHAR, '') AS label FROM documents LEFT JOIN labels USING (doc_id)",
    "newest_event": "SELECT user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS event_type FROM events GROUP BY 1",
    "idempotency_replay": _REPLAY,
    "pending_events": f"WITH e AS ({_EVENTS}) SELECT event_id, claim_key FROM e WHERE NOT EXISTS (SELECT 1 FROM e q WHERE q.claim_key = e.claim_key AND q.status = 'SUCCEEDED' AND q.event_id % 50 = 0)",
    "claim_expiry": "SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) + 604800 AS ttl, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, event_id % 5 <> 0 AS parsed FROM events",
    "box_location_as_of": "WITH b AS (SELECT user_id % 10 AS site, event_id AS ballot, ts FROM events WHERE event_type = 'click'), h AS (SELECT user_id % 10 AS site, 'box-' || event_id AS box, ts FROM events WHERE event_type = 'signup') SELECT b.site, ballot, box FROM b ASOF LEFT JOIN h ON h.site = b.site AND b.ts >= h.ts",
    "stream_idempotency": _REPLAY,
    "stream_watcher": "SELECT page_id, 'in/' || page_id || CASE page_id % 4 WHEN 0 THEN '.png' ELSE '.JPG' END AS key FROM pages WHERE page_id % 4 < 2 AND page_id % 6 <> 0",
    "quad_geometry": """WITH p AS (SELECT doc_id, unnest([struct_pack(x := 600.0::DOUBLE + n_chars % 17, y := 500.0::DOUBLE + n_chars % 13), struct_pack(x := (n_chars % 19)::DOUBLE, y := (n_chars % 23)::DOUBLE), struct_pack(x := (n_chars % 29)::DOUBLE, y := 500.0::DOUBLE + n_chars % 31), struct_pack(x := 600.0::DOUBLE + n_chars % 7, y := (n_chars % 11)::DOUBLE)]) AS p FROM documents),
q AS (SELECT doc_id, arg_min(p, p.x + p.y) AS a, arg_min(p, p.y - p.x) AS b, arg_max(p, p.x + p.y) AS c, arg_max(p, p.y - p.x) AS d FROM p GROUP BY 1)
SELECT doc_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2, d.x AS x3, d.y AS y3, round(((d.x - a.x) * (b.x - a.x) + (d.y - a.y) * (b.y - a.y)) / (sqrt(((d.x - a.x) ** 2 + (d.y - a.y) ** 2) * ((b.x - a.x) ** 2 + (b.y - a.y) ** 2)) + 1e-9), 9) AS cosine FROM q""",
}
