"""Queries of the layout algebra, with their SQL.

Boxes and bands are stand-ins (see ``tables``): every line has a band, and three quarters of them a box.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.functions.geometry import to_label, visible
from psephos.operators import decisions, layout
from psephos.plans import tables as t
from psephos.plans.merging import DIGITS

_W, _H, _E = t.WIDTH, t.HEIGHT, t.EXPECTED


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return t.boxes(spark, sf_dir), t.bands(spark, sf_dir)


def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = t.boxes(spark, sf_dir).select("ballot", "y")
    return layout.gap_clusters(b, "y", F.lit(50)).groupBy("ballot", "cluster").agg(layout.truncated_median("y").alias("centre"), F.count("*").alias("n"))


def box_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.dedupe_boxes(t.boxes(spark, sf_dir))


def rows_from_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.rows_from_boxes(t.boxes(spark, sf_dir), _H, _E)


def assign_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.assign_boxes(*_both(spark, sf_dir)).select("ballot", "r", "ord", "x")


def repair_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.repair_boxes(*_both(spark, sf_dir), _W, _H)


def rows_with_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.bands_with_box(*_both(spark, sf_dir))


def rows_with_box_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of every third ballot only, so the others keep all their bands."""
    boxes, bands = _both(spark, sf_dir)
    return layout.bands_with_box(boxes.filter("ballot % 3 = 0"), bands, keep_all=True)


def rows_split_by_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two bands as one, so that many hold two centres."""
    boxes, bands = _both(spark, sf_dir)
    wide = bands.groupBy("ballot", F.floor((F.col("r") - 1) / 2).alias("r")).agg(F.min("y1").alias("y1"), F.max("y2").alias("y2"))
    return layout.split_by_centres(boxes, wide, _H)


def uniform_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.uniform_rows(*_both(spark, sf_dir), _E, _H)


def expand_row_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands a few pixels apart grow into the gaps."""
    apart = t.bands(spark, sf_dir).withColumn("y1", F.col("y1") + F.col("r") % 9)
    return layout.expand_tops(apart)


def best_row_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.best_block(*_both(spark, sf_dir), _E)


def trim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.trim_rows(*_both(spark, sf_dir))


def drop_slivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.drop_slivers(*_both(spark, sf_dir), _E)


def longest_missing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.digits(spark, sf_dir).select("ballot", F.col("row_num").alias("r"), "p")
    return layout.longest_missing(d, F.col("p") % 4 == 0)


def column_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some boxes stand far left, as portraits do."""
    b = t.boxes(spark, sf_dir).withColumn("x", F.when(F.col("w") % 5 == 0, F.col("x") - 300).when(F.col("w") % 5 == 1, F.col("x") - 40).otherwise(F.col("x")))
    return layout.vote_column(b, _W)


def topk_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.top_boxes(t.boxes(spark, sf_dir), 3, _W)


def layout_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = layout.layout_score(*_both(spark, sf_dir), _E, _W, _H)
    return s.select("ballot", F.round("score", 6).alias("score"))


def layout_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On pages of 400 units, which some ballots fill."""
    boxes, bands = _both(spark, sf_dir)
    return layout.needs_fallback(boxes.withColumn("ink", F.col("w") % 10 / 40), bands, _E, _W, 400)


def nearest_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = t.bands(spark, sf_dir).select("ballot", "r", F.col("y2").alias("y"))
    return layout.nearest(bands, t.separators(spark, sf_dir))


def snapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.snap_bands(t.bands(spark, sf_dir), t.separators(spark, sf_dir))


def row_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands between the separators of two detectors."""
    lines = t.separators(spark, sf_dir)
    both = layout.bands_of(iter((lines, lines.filter("s % 3 = 0").select("ballot", (F.col("s") + 1).alias("s")))))
    return layout.bands_from_separators(both, _H)


def recover_missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.recover_missing(t.bands(spark, sf_dir), _E, _H)


def aligned_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes, bands = _both(spark, sf_dir)
    return layout.aligned(bands, boxes)


def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.digits(spark, sf_dir).select("ballot", F.col("row_num").alias("pos"), (F.col("p") % 100).alias("v"))
    return layout.local_maxima(p, "v", 12, 2, 12)


def smoothed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.digits(spark, sf_dir).select("ballot", F.col("row_num").alias("pos"), (F.col("p") % 100).alias("v"))
    return layout.smoothed(p, "v", 3).select("ballot", "pos", F.round("smooth", 9).alias("smooth"))


def peak_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.digits(spark, sf_dir).select("ballot", (F.col("p") % 100 / 100).alias("v"))
    return p.groupBy("ballot").agg(F.round(layout.peak_threshold("v"), 9).alias("least"))


def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes moved partly off the page: their visible part and their label."""
    b = t.boxes(spark, sf_dir).withColumn("x", F.col("x") + F.col("w") * 3)
    b = b.withColumn("v", visible(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(_W), F.lit(_H)))
    b = b.withColumn("l", to_label(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(_W), F.lit(_H)))
    return b.select("ballot", "ord", F.col("v.x").alias("vx"), F.col("v.w").alias("vw"), *[F.round(F.col(f"l.{c}"), 9).alias(f"l_{c}") for c in ("cx", "cy", "w", "h")])


def contour_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which box shapes may be vote boxes, which components are ink."""
    b = t.boxes(spark, sf_dir)
    shape = decisions.vote_box_shape(F.lit(4), F.col("ord") % 5 != 0, F.col("w") * F.col("h"), F.col("w") / F.col("h"), F.col("x") % 10 / 10, F.lit(_W * 600))
    kept = decisions.component_kept(F.col("x") % 60, F.col("y") % 60, F.col("w"), F.col("h") % 9, F.col("w") * (F.col("h") % 9), F.lit(100), F.lit(100))
    return b.select("ballot", "ord", shape.alias("vote_box"), kept.alias("ink"))


QUERIES = {f.__name__: f for f in (gap_clusters, box_dedupe, rows_from_boxes, assign_boxes, repair_boxes, rows_with_box, rows_with_box_or_all, rows_split_by_centres, uniform_rows, expand_row_tops, best_row_block, trim_rows, drop_slivers, longest_missing_run, column_filter, topk_boxes, layout_score, layout_fallback, nearest_separator, snapped_rows, row_bands, recover_missing_rows, aligned_boxes, local_maxima, smoothed_profile, peak_thresholds, box_geometry, contour_filter)}

_BASE = f"""WITH RECURSIVE d AS MATERIALIZED ({DIGITS}),
boxes AS MATERIALIZED (SELECT ballot, row_num AS ord, 850 + p % 37 AS x, 60 * (row_num - 1) + s % 29 AS y, 36 + s % 15 AS w, 30 + p % 13 AS h FROM d WHERE p % 4 <> 0),
bands AS MATERIALIZED (SELECT ballot, row_num AS r, 60 * (row_num - 1) AS y1, CASE WHEN (p + s) % 7 = 0 THEN 60 * row_num - 45 ELSE 60 * row_num END AS y2 FROM d),
lines AS (SELECT ballot, 60 * row_num - 4 + p % 9 AS s FROM d),
parts AS (SELECT b.*, r, y1, y2, greatest(0, least(y2, y + h) - greatest(y1, y)) / (h + 1e-6) AS part FROM boxes b JOIN bands USING (ballot)),
hits AS (SELECT DISTINCT ballot, r FROM parts WHERE part >= 0.3),
taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ballot, ord ORDER BY part DESC, r) AS k FROM parts WHERE part > 0) WHERE k = 1),
assigned AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ballot, r ORDER BY x DESC, ord) AS j FROM taken WHERE part >= 0.5) WHERE j = 1)
"""
_CLUSTER = "SELECT *, sum(jump) OVER (PARTITION BY ballot ORDER BY {0} ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, CASE WHEN {1} - lag({1}) OVER (PARTITION BY ballot ORDER BY {0}) > {2} THEN 1 ELSE 0 END AS jump FROM {3})"
_MED = "CAST(trunc(median({0})) AS BIGINT)"
_DEDUPE = f"SELECT ballot, CAST(cluster AS BIGINT) AS cluster, {', '.join(f'{_MED.format(c)} AS {c}' for c in 'xywh')}, count(*) AS n FROM ({_CLUSTER.format('cy, ord', 'cy', 'lim', '(SELECT *, y + h / 2 AS cy, 0.35 * greatest(1, median(h) OVER (PARTITION BY ballot)) AS lim FROM boxes)')}) GROUP BY ballot, cluster"
_ROWS = f"""{_BASE}, med AS (SELECT ballot, median(h) AS med_h FROM boxes GROUP BY 1),
c0 AS (SELECT ballot, y + h / 2 AS cy, med_h FROM ({_DEDUPE}) JOIN med USING (ballot)),
c1 AS (SELECT *, count(*) OVER (PARTITION BY ballot) AS n_all, lead(cy) OVER (PARTITION BY ballot ORDER BY cy) - cy AS gap FROM c0),
g AS (SELECT ballot, median(gap) AS usual FROM c1 WHERE gap > 1 GROUP BY 1),
g2 AS (SELECT c1.ballot, median(gap) AS trimmed FROM c1 JOIN g ON g.ballot = c1.ballot WHERE gap > 1 AND gap < 3 * usual GROUP BY 1),
c2 AS (SELECT c1.*, coalesce(trimmed, usual, 2.2 * med_h) AS med_gap FROM c1 LEFT JOIN g USING (ballot) LEFT JOIN g2 USING (ballot)),
single AS (SELECT ballot, 1 AS r, greatest(50, trunc(cy - 1.2 * med_h)) AS y1, least(999, trunc(cy + 1.2 * med_h)) AS y2, trunc(0.6 * med_h) AS m FROM c2 WHERE n_all = 1),
c3 AS (SELECT *, lead(cy) OVER (PARTITION BY ballot ORDER BY cy) AS nxt FROM c2 WHERE n_all > 1 AND cy >= 50),
c4 AS (SELECT *, row_number() OVER (PARTITION BY ballot ORDER BY cy DESC) AS e FROM c3 WHERE NOT coalesce(nxt - cy > 1.8 * med_gap AND cy < 50 + 1.2 * med_gap, false)),
c5 AS (SELECT *, row_number() OVER w AS r, lag(cy) OVER w AS pc, lead(cy) OVER w AS nc, trunc(greatest(10, 0.6 * med_h)) AS m FROM c4 WHERE e <= 5 WINDOW w AS (PARTITION BY ballot ORDER BY cy)),
c6 AS (SELECT *, greatest(0, floor(coalesce(0.5 * (pc + cy), greatest(50, cy - 0.55 * med_gap)))) AS a0, least(999, ceil(coalesce(0.5 * (nc + cy), least(999, cy + 0.55 * med_gap)))) AS b0 FROM c5),
c7 AS (SELECT ballot, r, m, CASE WHEN b0 - a0 < m THEN trunc(greatest(0, cy - 0.5 * m)) ELSE a0 END AS a, b0, b0 - a0 < m AS small FROM c6),
c8 AS MATERIALIZED (SELECT ballot, r, m, a, CASE WHEN small THEN least(999, a + m) ELSE b0 END AS b FROM c7),
f AS (SELECT ballot, r, greatest(a, 0) AS y1, least(999, greatest(b, greatest(a, 0) + m)) AS y2 FROM c8 WHERE r = 1
 UNION ALL SELECT c8.ballot, c8.r, greatest(a, f.y2), least(999, greatest(b, greatest(a, f.y2) + m)) FROM f JOIN c8 ON c8.ballot = f.ballot AND c8.r = f.r + 1)
SELECT ballot, CAST(r AS BIGINT) AS r, CAST(y1 AS BIGINT) AS y1, CAST(y2 AS BIGINT) AS y2 FROM f
UNION ALL SELECT ballot, 1, CAST(y1 AS BIGINT), CAST(CASE WHEN y2 - y1 < m THEN least(999, y1 + m) ELSE y2 END AS BIGINT) FROM single"""
_REPAIR = f"""{_BASE}, m AS (SELECT ballot, {_MED.format('x')} AS mx, {_MED.format('w')} AS mw, {_MED.format('h')} AS mh FROM boxes GROUP BY 1)
SELECT b.ballot, b.r, CASE WHEN a.ord IS NULL THEN greatest(0, least(1000 - mw - 1, mx)) ELSE a.x END AS x,
CASE WHEN a.ord IS NULL THEN greatest(0, least(1000 - mh - 1, (b.y1 + b.y2) // 2 - mh // 2)) ELSE a.y END AS y,
coalesce(a.w, mw) AS w, coalesce(a.h, mh) AS h, a.ord IS NULL AS repaired
FROM bands b JOIN m USING (ballot) LEFT JOIN assigned a ON a.ballot = b.ballot AND a.r = b.r"""
_SPLIT = f"""{_BASE}, wide AS (SELECT ballot, (r - 1) // 2 AS r, min(y1) AS y1, max(y2) AS y2 FROM bands GROUP BY 1, 2), body AS (SELECT * FROM wide WHERE y2 > 50),
m AS (SELECT ballot, trunc(greatest(10, 0.6 * median(h))) AS m FROM boxes GROUP BY 1),
i AS (SELECT body.*, y + h / 2 AS cy, count(*) OVER (PARTITION BY ballot, r) AS many FROM body JOIN boxes USING (ballot) WHERE y + h / 2 >= y1 AND y + h / 2 < y2),
s AS (SELECT ballot, m, coalesce(trunc(0.5 * (lag(cy) OVER w + cy)), y1) AS y1, coalesce(trunc(0.5 * (lead(cy) OVER w + cy)), y2) AS e FROM i JOIN m USING (ballot) WHERE many > 1 WINDOW w AS (PARTITION BY ballot, r ORDER BY cy))
SELECT ballot, CAST(y1 AS BIGINT) AS y1, CAST(CASE WHEN e - y1 >= m THEN e ELSE y1 + m END AS BIGINT) AS y2 FROM s
UNION ALL SELECT ballot, y1, y2 FROM body WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.ballot = body.ballot AND i.r = body.r AND many > 1)"""
_UNIFORM = f"""{_BASE}, s AS (SELECT ballot, min(y1) AS y0, arg_max(y2, r) AS last FROM bands GROUP BY 1 HAVING count(*) = 5), l AS (SELECT ballot, max(y + h) AS bottom, {_MED.format('h')} AS mh FROM boxes GROUP BY 1),
e AS (SELECT s.ballot, y0, greatest(1, least(999, greatest(last, coalesce(bottom + greatest(mh // 2, 20), last), 920)) - y0) / 5 AS step FROM s LEFT JOIN l USING (ballot))
SELECT ballot, i + 1 AS r, CAST(trunc(y0 + i * step) AS BIGINT) AS y1, CAST(trunc(y0 + (i + 1) * step) AS BIGINT) AS y2 FROM e, range(5) t(i)"""
_EXPAND = f"""{_BASE}, b AS (SELECT ballot, r, y1 + r % 9 AS y1, y2 FROM bands), m AS (SELECT ballot, median(y2 - y1) AS m, count(*) AS n FROM b GROUP BY 1),
x AS (SELECT b.*, n, coalesce(lag(y2) OVER (PARTITION BY ballot ORDER BY r), 0) AS above, greatest(2, least(trunc(0.08 * m), trunc(0.15 * m))) AS most FROM b JOIN m USING (ballot)),
z AS (SELECT *, least(most, y1 - above, trunc(0.12 * (y2 - y1))) AS room FROM x)
SELECT ballot, r, CAST(CASE WHEN n > 1 AND room > 0 THEN greatest(0, above, y1 - room) ELSE y1 END AS BIGINT) AS y1, y2 FROM z"""
_BLOCK = f"""{_BASE}, n AS (SELECT *, count(*) OVER (PARTITION BY ballot) AS n FROM bands), st AS (SELECT ballot, r AS start FROM n WHERE n > 5 AND r <= n - 4),
mem AS (SELECT n.ballot, n.r, y1, y2, start FROM n JOIN st ON st.ballot = n.ballot AND n.r BETWEEN start AND start + 4),
shape AS (SELECT ballot, start, round(stddev_pop(y2 - y1), 6) AS spread, min(y1) AS top FROM mem GROUP BY 1, 2),
sc AS (SELECT mem.ballot, start, count(DISTINCT ord) AS score FROM mem JOIN parts ON parts.ballot = mem.ballot AND parts.r = mem.r AND part >= 0.3 GROUP BY 1, 2),
k AS (SELECT ballot, start, row_number() OVER (PARTITION BY ballot ORDER BY coalesce(score, 0) DESC, spread, top, start) AS k FROM shape LEFT JOIN sc USING (ballot, start))
SELECT mem.ballot, r, y1, y2 FROM mem JOIN k USING (ballot, start) WHERE k = 1 UNION ALL SELECT ballot, r, y1, y2 FROM n WHERE n <= 5"""
_TRIM = f"""{_BASE}, t AS (SELECT b.*, h.r IS NOT NULL AS hit, greatest(1, y2 - y1) AS ht FROM bands b LEFT JOIN hits h USING (ballot, r)),
u AS (SELECT *, min(r) FILTER (hit) OVER p AS first, max(r) FILTER (hit) OVER p AS last, NOT hit AND NOT (ht BETWEEN 0.7 * median(ht) OVER p AND 1.35 * median(ht) OVER p) AS odd FROM t WINDOW p AS (PARTITION BY ballot)),
v AS (SELECT *, coalesce(max(r) FILTER (odd AND r < first) OVER p, -1) AS lo, coalesce(min(r) FILTER (odd AND r > last) OVER p, 1000000) AS hi FROM u WINDOW p AS (PARTITION BY ballot))
SELECT ballot, r, y1, y2 FROM v WHERE first IS NULL OR (r > lo AND r < hi)"""
_SLIVERS = f"""{_BASE}, t AS (SELECT b.*, h.r IS NOT NULL OR greatest(1, y2 - y1) >= 0.6 * median(greatest(1, y2 - y1)) OVER (PARTITION BY ballot) AS stays FROM bands b LEFT JOIN hits h USING (ballot, r))
SELECT ballot, r, y1, y2 FROM (SELECT *, count(*) FILTER (stays) OVER (PARTITION BY ballot) AS kept FROM t) WHERE stays OR kept = 4"""
_COLUMN = f"""{_BASE}, b AS (SELECT ballot, ord, CASE WHEN w % 5 = 0 THEN x - 300 WHEN w % 5 = 1 THEN x - 40 ELSE x END AS x, y, w, h FROM boxes),
i AS (SELECT *, x + w AS e, bool_or(x + w >= 840) OVER (PARTITION BY ballot) AS any_in FROM b), j AS (SELECT * FROM i WHERE e >= 840 OR NOT any_in),
k AS (SELECT *, count(*) OVER (PARTITION BY ballot) AS n, row_number() OVER (PARTITION BY ballot ORDER BY e, ord) AS k FROM j),
m AS (SELECT ballot, median(e) FILTER (k > n // 2) AS anchor, greatest(35, 0.65 * median(w)) AS tol FROM k GROUP BY 1),
q AS (SELECT k.*, e >= anchor - tol AS near, count(*) FILTER (e >= anchor - tol) OVER (PARTITION BY ballot) AS stay FROM k JOIN m USING (ballot))
SELECT ballot, ord, x, y, w, h FROM q WHERE near OR NOT (n >= 4 AND stay >= greatest(3, trunc(0.55 * n)))"""
_TOPK = f"""{_BASE}, m AS (SELECT *, median(w * h) OVER (PARTITION BY ballot) AS m FROM boxes),
s AS (SELECT *, round(1.5 * (x / 1000) + (1.0 - abs(1.0 - w / (h + 1e-6))) + 0.5 * (1.0 - abs(w * h - m) / (m + 1e-6)), 9) AS score FROM m)
SELECT ballot, ord, x, y, w, h, score FROM (SELECT *, row_number() OVER (PARTITION BY ballot ORDER BY score DESC, y, ord) AS k FROM s) WHERE k <= 3"""
_SCORE = f"""{_BASE}, b AS (SELECT ballot, count(*) AS n, stddev_pop(x) AS sd FROM boxes WHERE y + h / 2 >= 50 GROUP BY 1),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ballot ORDER BY r) AS k FROM bands WHERE y2 > 50) WHERE k <= 5),
s AS (SELECT ballot, greatest(50, arg_min(y1, r)) AS top, arg_max(y2, r) AS bottom FROM r GROUP BY 1)
SELECT ballot, round(coalesce(n, 0) - 2.0::DOUBLE * abs(coalesce(n, 0) - 5) + coalesce(5.0::DOUBLE * greatest(0, bottom - top) / 950, 0) - CASE WHEN coalesce(n, 0) >= 4 THEN 2.0::DOUBLE * sd / 1000 ELSE 0 END, 6) AS score FROM b FULL JOIN s USING (ballot)"""
_SNAP = f"""{_BASE}, b AS (SELECT *, (lead(y1 + y2) OVER w - y1 - y2) / 2 AS cg, y2 - y1 AS ht, lead(y2) OVER w AS nxt FROM bands WINDOW w AS (PARTITION BY ballot ORDER BY r)),
st AS (SELECT ballot, coalesce(median(cg), 60) AS gap, trunc(greatest(10, 0.6 * median(ht))) AS m, arg_min(y1, r) AS y0 FROM b GROUP BY 1),
nr AS (SELECT b.ballot, b.r, min(struct_pack(d := abs(s - y2), s := s)) AS q FROM b JOIN lines USING (ballot) WHERE nxt IS NOT NULL GROUP BY 1, 2),
z AS MATERIALIZED (SELECT b.ballot, b.r, y2, m, y0, CASE WHEN q.d <= 0.12 * gap AND nxt - q.s >= m THEN q.s END AS wish FROM b JOIN st USING (ballot) LEFT JOIN nr ON nr.ballot = b.ballot AND nr.r = b.r),
f AS (SELECT ballot, r, y0 AS top, CASE WHEN wish - y0 >= m THEN wish ELSE y2 END AS e, m FROM z WHERE r = 1
 UNION ALL SELECT z.ballot, z.r, f.e, CASE WHEN wish - f.e >= z.m THEN wish ELSE z.y2 END, z.m FROM f JOIN z ON z.ballot = f.ballot AND z.r = f.r + 1)
SELECT ballot, CAST(r AS BIGINT) AS r, CAST(top AS BIGINT) AS y1, CAST(top + greatest(e - top, m) AS BIGINT) AS y2 FROM f"""
_BANDS = f"""{_BASE}, u AS (SELECT ballot, s FROM lines UNION ALL SELECT ballot, s + 1 FROM lines WHERE s % 3 = 0),
c AS (SELECT ballot, {_MED.format('s')} AS s FROM ({_CLUSTER.format('s', 's', '8', 'u')}) GROUP BY ballot, cluster),
g AS (SELECT ballot, {_MED.format('d')} AS gap FROM (SELECT ballot, lead(s) OVER (PARTITION BY ballot ORDER BY s) - s AS d FROM c) WHERE d > 0 GROUP BY 1),
b AS (SELECT c.ballot, s, coalesce(gap, 60) AS gap FROM c LEFT JOIN g USING (ballot) WHERE s >= 50),
o AS (SELECT ballot, gap, min(s) AS lo, max(s) AS hi FROM b GROUP BY 1, 2),
v AS (SELECT ballot, gap, s FROM b UNION ALL SELECT ballot, gap, greatest(50, lo - gap) FROM o WHERE greatest(50, lo - gap) < lo - CAST(trunc(0.35 * gap) AS BIGINT)
 UNION ALL SELECT ballot, gap, least(999, hi + gap) FROM o WHERE least(999, hi + gap) > hi + CAST(trunc(0.35 * gap) AS BIGINT)),
m AS (SELECT ballot, any_value(gap) AS gap, {_MED.format('s')} AS s FROM ({_CLUSTER.format('s', 's', '8', 'v')}) GROUP BY ballot, cluster),
p AS (SELECT *, lead(s) OVER (PARTITION BY ballot ORDER BY s) AS nxt FROM m)
SELECT ballot, row_number() OVER (PARTITION BY ballot ORDER BY s) AS r, s AS y1, nxt AS y2 FROM p WHERE nxt - s >= greatest(10, trunc(0.45 * gap))"""
_FALLBACK = f"""{_BASE}, bb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ballot ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY ballot) AS n_body FROM boxes WHERE y + h / 2 >= 20), s AS (SELECT ballot, count(*) AS n, median((x + w) / 1000) AS rt, median(w / 1000) AS mw, median(h / 400) AS mh, median((w % 10) / 40) FILTER (i % greatest(1, n_body // 8) = 0) AS ink FROM bb GROUP BY 1),
rw AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ballot ORDER BY r) AS k FROM bands WHERE y2 > 20) WHERE k <= 5),
cv AS (SELECT ballot, count(*) >= 3 AND greatest(0, arg_max(y2, r) - greatest(20, arg_min(y1, r))) / 380 < 0.70 AS cramped FROM rw GROUP BY 1),
pp AS (SELECT b.ballot, ord, x, y, h, r, y1, y2, greatest(0, least(y2, y + h) - greatest(y1, y)) / (h + 1e-6) AS part FROM bb b JOIN rw USING (ballot)),
tk AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ballot, ord ORDER BY part DESC, r) AS k FROM pp WHERE part > 0) WHERE k = 1),
a5 AS (SELECT ballot, r, true AS got FROM tk WHERE part >= 0.5 GROUP BY 1, 2), a1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ballot, r ORDER BY x DESC, ord) AS j FROM tk WHERE part >= 0.1) WHERE j = 1),
sn AS (SELECT rw.ballot, rw.r, got IS NULL AS miss FROM rw LEFT JOIN a5 USING (ballot, r)), gp AS (SELECT ballot, count(*) AS n_rows, count(*) FILTER (miss) AS missing FROM sn GROUP BY 1),
rn AS (SELECT ballot, max(c) AS longest FROM (SELECT ballot, g, count(*) FILTER (miss) AS c FROM (SELECT *, count(*) FILTER (NOT miss) OVER (PARTITION BY ballot ORDER BY r) AS g FROM sn) GROUP BY 1, 2) GROUP BY 1),
lp AS (SELECT rw.ballot, median(coalesce(a1.part, 0)) AS part FROM rw LEFT JOIN a1 ON a1.ballot = rw.ballot AND a1.r = rw.r GROUP BY 1)
SELECT e.ballot, coalesce(n, 0) < 3 OR coalesce(rt < 0.92 OR 1 - rt > 0.08 OR mw > 0.20 OR mh > 0.10 OR ink > 0.18, false) OR coalesce(cramped, false) OR (coalesce(n, 0) > 0 AND coalesce(missing / n_rows >= 0.30 OR longest >= 3 OR part < 0.35, false)) AS fallback
FROM (SELECT DISTINCT ballot FROM bands) e LEFT JOIN s USING (ballot) LEFT JOIN gp USING (ballot) LEFT JOIN rn USING (ballot) LEFT JOIN lp USING (ballot) LEFT JOIN cv USING (ballot)"""
_CUT = "CAST(CASE WHEN {0} = p THEN t.y2 ELSE trunc(t.y1 + {0} * (t.y2 - t.y1) / p) END AS BIGINT)"
_RECOVER = f"""{_BASE}, z AS (SELECT ballot, list_sort(list(struct_pack(y1 := y1, y2 := y2))) AS b, count(*) AS n, CASE WHEN median(y2 - y1) > 0 THEN median(y2 - y1) ELSE 200 END AS u, false AS done FROM bands GROUP BY 1
 UNION ALL SELECT ballot, CASE WHEN ok THEN list_sort(list_concat([x FOR x IN b IF NOT (x.y1 = t.y1 AND x.y2 = t.y2)], good)) ELSE b END, n, u, NOT ok
 FROM (SELECT *, t.y2 - t.y1 >= 20 AND len(good) >= 2 AS ok FROM (SELECT *, [x FOR x IN strips IF x.y2 - x.y1 >= 10] AS good
 FROM (SELECT *, [struct_pack(y1 := {_CUT.format('j')}, y2 := {_CUT.format('(j + 1)')}) FOR j IN range(p)] AS strips
 FROM (SELECT *, greatest(2, least(6 - len(b), CAST(round_even((t.y2 - t.y1) / u, 0) AS BIGINT))) AS p
 FROM (SELECT *, list_sort([struct_pack(k := x.y1 - x.y2, y1 := x.y1, y2 := x.y2) FOR x IN b])[1] AS t FROM z WHERE NOT done AND len(b) < 5)))))),
l AS (SELECT ballot, CASE WHEN n < 5 THEN b[1:5] ELSE b END AS b FROM z WHERE done OR len(b) >= 5)
SELECT ballot, r, x.y1 AS y1, x.y2 AS y2 FROM (SELECT ballot, unnest(b) AS x, generate_subscripts(b, 1) AS r FROM l)"""
ORACLES = {
    "recover_missing_rows": _RECOVER,
    "gap_clusters": f"{_BASE} SELECT ballot, CAST(cluster AS BIGINT) AS cluster, {_MED.format('y')} AS centre, count(*) AS n FROM ({_CLUSTER.format('y', 'y', '50', 'boxes')}) GROUP BY ballot, cluster",
    "box_dedupe": f"{_BASE} {_DEDUPE}",
    "rows_from_boxes": _ROWS,
    "assign_boxes": f"{_BASE} SELECT ballot, r, ord, x FROM assigned",
    "repair_boxes": _REPAIR,
    "rows_with_box": f"{_BASE} SELECT b.* FROM bands b JOIN hits USING (ballot, r)",
    "rows_with_box_or_all": f"{_BASE}, h AS (SELECT * FROM hits WHERE ballot % 3 = 0) SELECT b.* FROM bands b WHERE EXISTS (SELECT 1 FROM h WHERE h.ballot = b.ballot AND h.r = b.r) OR NOT EXISTS (SELECT 1 FROM h WHERE h.ballot = b.ballot)",
    "rows_split_by_centres": _SPLIT,
    "uniform_rows": _UNIFORM,
    "expand_row_tops": _EXPAND,
    "best_row_block": _BLOCK,
    "trim_rows": _TRIM,
    "drop_slivers": _SLIVERS,
    "longest_missing_run": f"{_BASE} SELECT ballot, max(n) AS longest FROM (SELECT ballot, g, count(*) FILTER (p % 4 = 0) AS n FROM (SELECT *, count(*) FILTER (p % 4 <> 0) OVER (PARTITION BY ballot ORDER BY row_num) AS g FROM d) GROUP BY 1, 2) GROUP BY 1",
    "column_filter": _COLUMN,
    "topk_boxes": _TOPK,
    "layout_score": _SCORE,
    "layout_fallback": _FALLBACK,
    "nearest_separator": f"{_BASE} SELECT ballot, r, y, q.s AS nearest, q.d AS distance FROM (SELECT ballot, r, y2 AS y, min(struct_pack(d := abs(s - y2), s := s)) AS q FROM bands JOIN lines USING (ballot) GROUP BY 1, 2, 3)",
    "snapped_rows": _SNAP,
    "row_bands": _BANDS,
    "aligned_boxes": f"{_BASE} SELECT coalesce(b.ballot, x.ballot) AS ballot, b.r, b.y1, b.y2, x, y, w, h FROM (SELECT *, row_number() OVER (PARTITION BY ballot ORDER BY r) AS k FROM bands) b FULL JOIN (SELECT *, row_number() OVER (PARTITION BY ballot ORDER BY y, ord) AS k FROM boxes) x ON x.ballot = b.ballot AND x.k = b.k",
    "local_maxima": f"{_BASE} SELECT ballot, row_num AS pos, v FROM (SELECT ballot, row_num, p % 100 AS v, lag(p % 100) OVER w AS a, lead(p % 100) OVER w AS b FROM d WINDOW w AS (PARTITION BY ballot ORDER BY row_num)) WHERE v > 12 AND v >= a AND v >= b AND row_num >= 2 AND row_num < 12",
    "smoothed_profile": f"{_BASE} SELECT ballot, row_num AS pos, round(avg(p % 100) OVER (PARTITION BY ballot ORDER BY row_num ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 9) AS smooth FROM d",
    "peak_thresholds": f"{_BASE} SELECT ballot, round(greatest(quantile_cont((p % 100) / 100, 0.92), 0.12::DOUBLE), 9) AS least FROM d GROUP BY 1",
    "box_geometry": f"{_BASE}, b AS (SELECT ballot, ord, x + w * 3 AS x, y, w, h FROM boxes) SELECT ballot, ord, CASE WHEN x < 1000 AND y < 1000 THEN x END AS vx, CASE WHEN x < 1000 AND y < 1000 THEN least(x + w, 1000) - x END AS vw, round(least(1, (x + w / 2) / 1000), 9) AS l_cx, round(least(1, (y + h / 2) / 1000), 9) AS l_cy, round(w / 1000, 9) AS l_w, round(h / 1000, 9) AS l_h FROM b",
    "contour_filter": f"""{_BASE}, b AS (SELECT *, h % 9 AS g, x % 60 AS u, y % 60 AS v FROM boxes) SELECT ballot, ord, ord % 5 <> 0 AND w * h / 600000 BETWEEN 0.0020 AND 0.045 AND w / h BETWEEN 0.65 AND 1.55 AND x % 10 >= 2.5 AS vote_box,
NOT (w >= 90 AND g <= 15 OR g >= 90 AND w <= 15) AND NOT ((u <= 0)::INT + (v <= 0)::INT + (u + w >= 100)::INT + (v + g >= 100)::INT >= 2 AND w * g < 0.25 * w * g) AND NOT (w * g < 9 OR greatest(w, g) <= 3 AND w * g < 18) AS ink FROM b""",
}
