"""Page layout of ballots: boxes (ballot, ord, x, y, w, h) and row bands (ballot, r, y1, y2).

A page has few boxes, bands and separator lines.  What looks at several of them together gathers each
kind into one ordered array a ballot (``gathered``: one shuffle, or none where the rows lie by ballot
already) and works inside the row with higher-order functions, so nothing is joined or sorted again
between steps.  What looks at one kind in order uses a window on the ballot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from psephos.functions.geometry import clamp, overlap

KEY = "ballot"
BOX, BAND = ("ord", "x", "y", "w", "h"), ("r", "y1", "y2")
_BANDS = "array<struct<r:bigint,y1:bigint,y2:bigint>>"


def _all() -> WindowSpec:
    return Window.partitionBy(KEY)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def median(values: Column) -> Column:
    """Of an array: the middle value, or the mean of the two; null if it is empty."""
    at = lambda s, k: F.get(s, ((F.size(s) - k) / 2).cast("int"))
    return let(F.array_sort(values), lambda s: (at(s, 1) + at(s, 0)) / 2)


def field(rows: Column, name: str) -> Column:
    return F.transform(rows, lambda x: x[name])


def long(x: Column) -> Column:
    return x.cast("long")


def ordered(columns: list[str], order: str) -> Column:
    """Rows of a group as an array in order."""
    return F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order])))


def gathered(how: str = "full", **kinds: tuple[DataFrame, tuple[str, ...]]) -> DataFrame:
    """One row a ballot with an ordered array of each kind (name=(rows, columns), the first one orders)."""
    out = None
    for name, (rows, columns) in kinds.items():
        one = rows.groupBy(KEY).agg(ordered(list(columns), columns[0]).alias(name))
        out = one if out is None else out.join(one, KEY, how)
    return out


def _page(boxes: DataFrame, bands: DataFrame, how: str = "full") -> DataFrame:
    return gathered(how, boxes=(boxes, BOX), bands=(bands, BAND)).select(KEY, *[F.coalesce(c, F.array()).alias(c) for c in ("boxes", "bands")])


def _spread(page: DataFrame, bands: Column) -> DataFrame:
    """Bands of an array as rows (ballot, r, y1, y2)."""
    return page.select(KEY, F.explode(bands).alias("b")).select(KEY, *[long(F.col(f"b.{c}")).alias(c) for c in BAND])


def _part(box: Column, band: Column) -> Column:
    return overlap(band.y1, band.y2, box.y, box.h)


def gap_clusters(df: DataFrame, value: str, tolerance: Column | float, keep: list[str] | None = None) -> DataFrame:
    """df with cluster: it counts up wherever the gap to the value before exceeds the tolerance."""
    w = Window.partitionBy(KEY).orderBy(value, *(keep or []))
    jump = (F.col(value) - F.lag(value).over(w) > tolerance).cast("int")
    return df.withColumn("cluster", F.sum(F.coalesce(jump, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def truncated_median(column: str) -> Column:
    return F.median(column).cast("long")


def clustered(values: Column, key: Callable[[Column], Column], tolerance: Column, kind: str) -> Column:
    """Runs of an ordered array: a new one wherever the gap to the value before exceeds the tolerance."""

    def step(runs: Column, value: Column) -> Column:
        last = F.element_at(runs, -1)
        grown = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.concat(last, F.array(value))))
        near = F.when(F.size(runs) > 0, key(value) - key(F.element_at(F.element_at(F.when(F.size(runs) > 0, runs), -1), -1)) <= tolerance)
        return F.when(F.coalesce(near, F.lit(False)), grown).otherwise(F.concat(runs, F.array(F.array(value))))

    return F.reduce(values, F.array().cast(f"array<array<{kind}>>"), step)


_CENTRED = "struct<cy:double,ord:bigint,x:bigint,y:bigint,w:bigint,h:bigint>"


def _deduped(boxes: Column) -> Column:
    """Clusters of an array of boxes: truncated medians of their sides, and how many there are."""
    rows = F.array_sort(F.transform(boxes, lambda b: F.struct((b.y + b.h / 2).alias("cy"), b.ord.alias("ord"), *[b[c].alias(c) for c in "xywh"])))
    limit = 0.35 * F.greatest(F.lit(1.0), median(field(boxes, "h")))
    runs = let(F.struct(rows.alias("rows"), limit.alias("limit")), lambda s: clustered(s.rows, lambda b: b.cy, s.limit, _CENTRED))
    return F.transform(runs, lambda run: F.struct(*[long(median(field(run, c))).alias(c) for c in "xywh"], long(F.size(run)).alias("n")))


def dedupe_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes of one row (centres within a part of the median height) become their median box."""
    page = gathered(boxes=(boxes, BOX))
    return page.select(KEY, F.posexplode(_deduped(F.col("boxes"))).alias("cluster", "b")).select(KEY, long(F.col("cluster")).alias("cluster"), "b.*")


def header_cut(height: int, fraction: float = 0.05) -> int:
    return int(fraction * height)


def body_boxes(boxes: DataFrame, height: int) -> DataFrame:
    return boxes.filter(F.col("y") + F.col("h") / 2 >= header_cut(height))


def body_bands(bands: DataFrame, height: int) -> DataFrame:
    return bands.filter(F.col("y2") > header_cut(height))


def _gaps(values: Column) -> Column:
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(values, 2, n), lambda a, b: b - a)


def rows_from_boxes(boxes: DataFrame, height: int, expected: int | None = None) -> DataFrame:
    """Row bands around deduplicated box centres: (ballot, r, y1, y2).

    Bands end midway between centres and half a usual gap beyond the outer ones; a first box far
    above the rest is taken for a header.  The last step carries each band's bottom to the next one.
    """
    cut = header_cut(height)
    page = gathered(boxes=(boxes, BOX))
    page = page.select(KEY, median(field(F.col("boxes"), "h")).alias("med_h"), F.array_sort(F.transform(_deduped(F.col("boxes")), lambda b: b.y + b.h / 2)).alias("c"))

    def usual_gap(gaps: Column) -> Column:
        usual = median(F.filter(gaps, lambda g: g > 1))
        return let(usual, lambda u: F.coalesce(median(F.filter(gaps, lambda g: (g > 1) & (g < 3 * u))), u))

    page = page.withColumn("gap", F.coalesce(let(_gaps(F.col("c")), usual_gap), 2.2 * F.col("med_h")))
    gap, med_h = F.col("gap"), F.col("med_h")

    def inner(centres: Column) -> Column:
        """Without a header, and the last ones if their number is known."""
        header = lambda v, i: F.coalesce((F.get(centres, i + 1) - v > 1.8 * gap) & (v < cut + 1.2 * gap), F.lit(False))
        return F.filter(centres, lambda v, i: ~header(v, i))

    def bands(centres: Column) -> Column:
        least = long(F.greatest(F.lit(10.0), 0.6 * med_h))

        def band(v: Column, i: Column) -> Column:
            top = F.coalesce(0.5 * (F.get(centres, i - 1) + v), F.greatest(F.lit(float(cut)), v - 0.55 * gap))
            bottom = F.coalesce(0.5 * (F.get(centres, i + 1) + v), F.least(F.lit(height - 1.0), v + 0.55 * gap))
            ends = F.struct(F.greatest(F.lit(0), F.floor(top)).alias("y1"), F.least(F.lit(height - 1), F.ceil(bottom)).alias("y2"))

            def wide(e: Column) -> Column:
                small = e.y2 - e.y1 < least
                a = F.when(small, long(F.greatest(F.lit(0.0), v - 0.5 * least))).otherwise(e.y1)
                return F.struct(long(i + 1).alias("r"), long(a).alias("a"), long(F.when(small, F.least(F.lit(height - 1), a + least)).otherwise(e.y2)).alias("b"), least.alias("least"))

            return let(ends, wide)

        return _monotone(F.transform(centres, band), height)

    last = (lambda k: F.slice(k, F.greatest(F.lit(1), F.size(k) - expected + 1), expected)) if expected else (lambda k: k)
    many = let(F.filter("c", lambda v: v >= cut), lambda k: let(inner(k), lambda m: let(last(m), bands)))
    single = F.array(F.struct(F.lit(1).cast("long").alias("r"), *_single_band(F.get("c", F.lit(0)), med_h, cut, height)))
    return _spread(page, F.when(F.size("c") == 1, single).otherwise(many))


def _single_band(cy: Column, med_h: Column, cut: int, height: int) -> list[Column]:
    y1 = F.greatest(F.lit(cut), (cy - 1.2 * med_h).cast("long"))
    y2 = F.least(F.lit(height - 1), (cy + 1.2 * med_h).cast("long"))
    least = (0.6 * med_h).cast("long")
    return [y1.cast("long").alias("y1"), F.when(y2 - y1 < least, F.least(F.lit(height - 1), y1 + least)).otherwise(y2).cast("long").alias("y2")]


def _monotone(bands: Column, height: int) -> Column:
    """Each band starts no higher than the one before ends and keeps its least height."""
    start = F.struct(F.lit(0).cast("long").alias("bottom"), F.array().cast(_BANDS).alias("out"))

    def step(state: Column, band: Column) -> Column:
        y1 = F.greatest(band.a, state.bottom)
        y2 = F.least(F.lit(height - 1).cast("long"), F.greatest(band.b, y1 + band.least))
        return F.struct(y2.alias("bottom"), F.concat(state.out, F.array(F.struct(band.r.alias("r"), y1.alias("y1"), y2.alias("y2")))).alias("out"))

    return F.aggregate(bands, start, step, lambda s: s.out)


def _taken(boxes: Column, bands: Column, least: float) -> Column:
    """Bands of an array with the box that each gets (null if none) and the part of it inside.

    Each box goes to the band with most of it, the earlier one if equal, if that is enough; of a band's
    boxes the right-most stays, the first if equal.
    """

    def best(box: Column) -> Column:
        return F.array_max(F.transform(bands, lambda band: F.struct(_part(box, band).alias("part"), (-band.r).alias("first"))))

    mine = F.filter(F.transform(boxes, lambda box: F.struct(best(box).alias("at"), box.alias("box"))), lambda t: (t.at.part > 0) & (t.at.part >= least))

    def of_band(taken: Column) -> Column:
        def right(band: Column) -> Column:
            own = F.filter(taken, lambda t: -t["at"]["first"] == band.r)
            return F.array_max(F.transform(own, lambda t: F.struct(t.box.x.alias("x"), (-t.box.ord).alias("first"), t.at.part.alias("part"), t.box.alias("box"))))

        return F.transform(bands, lambda band: F.struct(*[band[c].alias(c) for c in BAND], right(band).alias("best")))

    return let(mine, of_band)


def assign_boxes(boxes: DataFrame, bands: DataFrame, least: float = 0.5) -> DataFrame:
    """Each box goes to the band with most of it (the earlier one if equal), if that is enough; of a
    band's boxes the right-most stays (the first if equal)."""
    page = _page(boxes, bands, "inner")
    rows = page.select(KEY, F.explode(_taken(F.col("boxes"), F.col("bands"), least)).alias("b")).filter("b.best IS NOT NULL")
    return rows.select(KEY, "b.r", *[f"b.best.box.{c}" for c in BOX])


def _touched(boxes: Column, bands: Column, least: float) -> Column:
    """Bands of an array, and whether some box lies in them far enough."""
    hit = lambda band: F.exists(boxes, lambda box: (_part(box, band) > 0) & (_part(box, band) >= least))
    return F.transform(bands, lambda band: F.struct(*[band[c].alias(c) for c in BAND], hit(band).alias("hit"), F.greatest(F.lit(1), band.y2 - band.y1).alias("height")))


def bands_with_box(boxes: DataFrame, bands: DataFrame, least: float = 0.3, keep_all: bool = False) -> DataFrame:
    """Bands that some box lies in far enough; ballots without any such band keep none, or all if asked."""
    page = gathered("left" if keep_all else "inner", bands=(bands, BAND), boxes=(boxes, BOX)).withColumn("boxes", F.coalesce("boxes", F.array()))
    touched = lambda rows: F.filter(rows, lambda b: b.hit)
    either = lambda rows: let(touched(rows), lambda hit: F.when(F.size(hit) > 0, hit).otherwise(rows))
    return _spread(page, let(_touched(F.col("boxes"), F.col("bands"), least), either if keep_all else touched))


def repair_boxes(boxes: DataFrame, bands: DataFrame, width: int, height: int) -> DataFrame:
    """Every band's box: the assigned one, else a median box centred on the band.  Ballots without boxes give none."""
    page = _page(boxes, bands, "inner")
    medians = [long(median(field(F.col("boxes"), c))).alias(f"m{c}") for c in "xwh"]
    rows = page.select(KEY, *medians, F.explode(_taken(F.col("boxes"), F.col("bands"), 0.5)).alias("b"))
    missing = F.col("b.best").isNull()
    centre = F.floor((F.col("b.y1") + F.col("b.y2")) / 2)
    x = clamp(F.col("mx"), F.lit(0), width - F.col("mw") - 1)
    y = clamp(centre - F.floor(F.col("mh") / 2), F.lit(0), height - F.col("mh") - 1)
    usual = (("x", x), ("y", y), ("w", F.col("mw")), ("h", F.col("mh")))
    return rows.select(KEY, "b.r", *[long(F.when(missing, m).otherwise(F.col(f"b.best.box.{c}"))).alias(c) for c, m in usual], missing.alias("repaired"))


def split_by_centres(boxes: DataFrame, bands: DataFrame, height: int) -> DataFrame:
    """Bands that hold several box centres are cut midway between them: (ballot, y1, y2)."""
    page = gathered("left", bands=(body_bands(bands, height), BAND), boxes=(boxes, BOX)).withColumn("boxes", F.coalesce("boxes", F.array()))
    page = page.select(KEY, "bands", long(F.greatest(F.lit(10.0), 0.6 * median(field(F.col("boxes"), "h")))).alias("least"), F.array_sort(F.transform("boxes", lambda b: b.y + b.h / 2)).alias("centres"))
    least = F.col("least")

    def pieces(band: Column) -> Column:
        def split(inside: Column) -> Column:
            def piece(v: Column, i: Column) -> Column:
                a = F.coalesce(long(0.5 * (F.get(inside, i - 1) + v)), band.y1)
                b = F.coalesce(long(0.5 * (F.get(inside, i + 1) + v)), band.y2)
                return F.struct(long(i).alias("r"), a.alias("y1"), F.when(b - a >= least, b).otherwise(a + least).alias("y2"))

            whole = F.array(F.struct(F.lit(0).cast("long").alias("r"), band.y1.alias("y1"), band.y2.alias("y2")))
            return F.when(F.size(inside) > 1, F.transform(inside, piece)).otherwise(whole)

        return let(F.filter("centres", lambda v: (v >= band.y1) & (v < band.y2)), split)

    return _spread(page, F.flatten(F.transform("bands", pieces))).drop("r")


def uniform_rows(boxes: DataFrame, bands: DataFrame, expected: int, height: int) -> DataFrame:
    """Ballots with just the expected number of bands get equal ones, over a span that holds all boxes."""
    span = bands.groupBy(KEY).agg(F.count("*").alias("n"), F.min("y1").alias("y0"), F.max_by("y2", "r").alias("last"))
    low = boxes.groupBy(KEY).agg(F.max(F.col("y") + F.col("h")).alias("bottom"), truncated_median("h").alias("mh"))
    s = span.filter(F.col("n") == expected).join(low, KEY, "left")
    reach = F.coalesce(F.col("bottom") + F.greatest(F.floor(F.col("mh") / 2), F.lit(20)), F.col("last"))
    end = F.least(F.lit(height - 1), F.greatest(F.col("last"), reach, F.lit(int(0.92 * height))))
    s = s.withColumn("step", F.greatest(F.lit(1), end - F.col("y0")) / F.lit(expected))
    at = lambda i: (F.col("y0") + i * F.col("step")).cast("long")
    return s.select(KEY, "y0", "step", F.explode(F.sequence(F.lit(0), F.lit(expected - 1))).alias("i")).select(KEY, (F.col("i") + 1).cast("long").alias("r"), at(F.col("i")).alias("y1"), at(F.col("i") + 1).alias("y2"))


def expand_tops(bands: DataFrame, fraction: float = 0.08) -> DataFrame:
    """Tops move up a little, never over the band above."""
    w = Window.partitionBy(KEY).orderBy("r")
    med = F.median(F.col("y2") - F.col("y1")).over(_all())
    most = F.greatest(F.lit(2), F.least((fraction * med).cast("long"), (0.15 * med).cast("long")))
    above = F.coalesce(F.lag("y2").over(w), F.lit(0))
    room = F.least(most, F.col("y1") - above, (0.12 * (F.col("y2") - F.col("y1"))).cast("long"))
    several = F.count("*").over(_all()) > 1
    y1 = F.when(several & (room > 0), F.greatest(F.lit(0), above, F.col("y1") - room)).otherwise(F.col("y1"))
    return bands.withColumns({"room": room, "new": y1}).select(KEY, "r", F.col("new").cast("long").alias("y1"), "y2")


def best_block(boxes: DataFrame, bands: DataFrame, expected: int, least: float = 0.3) -> DataFrame:
    """The run of expected bands that explains most boxes; then the evenest heights, then the highest run.

    Ballots with no more bands than that keep theirs.
    """
    page = gathered("left", bands=(bands, BAND), boxes=(boxes, BOX)).withColumn("boxes", F.coalesce("boxes", F.array()))
    page = page.withColumn("bands", F.transform("bands", lambda b, i: F.struct(long(i + 1).alias("r"), b.y1.alias("y1"), b.y2.alias("y2"))))

    def rank(start: Column) -> Column:
        def of(block: Column) -> Column:
            score = F.size(F.filter("boxes", lambda box: F.exists(block, lambda band: (_part(box, band) > 0) & (_part(box, band) >= least))))
            mean = F.reduce(block, F.lit(0.0), lambda a, b: a + (b.y2 - b.y1)) / expected
            spread = let(mean, lambda m: F.sqrt(F.reduce(block, F.lit(0.0), lambda a, b: a + (b.y2 - b.y1 - m) * (b.y2 - b.y1 - m)) / expected))
            return F.struct(score.alias("score"), (-F.round(spread, 6)).alias("even"), (-F.array_min(field(block, "y1"))).alias("high"), (-start).alias("first"), block.alias("block"))

        return let(F.slice("bands", start, expected), of)

    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("bands") - (expected - 1)))
    best = F.array_max(F.transform(starts, rank)).block
    return _spread(page, F.when(F.size("bands") <= expected, F.col("bands")).otherwise(best))


def trim_rows(boxes: DataFrame, bands: DataFrame, least: float = 0.3) -> DataFrame:
    """Bands from the first with a box to the last, and beyond while their height is usual."""
    page = gathered("left", bands=(bands, BAND), boxes=(boxes, BOX)).withColumn("boxes", F.coalesce("boxes", F.array()))

    def trimmed(rows: Column) -> Column:
        hits = field(F.filter(rows, lambda b: b.hit), "r")

        def within(s: Column) -> Column:
            odd = field(F.filter(rows, lambda b: ~b.hit & ~b.height.between(0.7 * s.usual, 1.35 * s.usual)), "r")
            start = F.array_max(F.filter(odd, lambda r: r < s.low))
            end = F.array_min(F.filter(odd, lambda r: r > s.high))
            return F.filter(rows, lambda b: s.low.isNull() | ((b.r > F.coalesce(start, F.lit(-1))) & (b.r < F.coalesce(end, F.lit(1 << 40)))))

        return let(F.struct(median(field(rows, "height")).alias("usual"), F.array_min(hits).alias("low"), F.array_max(hits).alias("high")), within)

    return _spread(page, let(_touched(F.col("boxes"), F.col("bands"), least), trimmed))


def drop_slivers(boxes: DataFrame, bands: DataFrame, expected: int | None = None, part: float = 0.6, least: float = 0.3) -> DataFrame:
    """Drop short bands without a box, unless that leaves one fewer than expected."""
    page = gathered("left", bands=(bands, BAND), boxes=(boxes, BOX)).withColumn("boxes", F.coalesce("boxes", F.array()))

    def without(rows: Column) -> Column:
        kept = let(part * median(field(rows, "height")), lambda m: F.filter(rows, lambda b: b.hit | (b.height >= m)))
        return kept if expected is None else let(kept, lambda k: F.when(F.size(k) == expected - 1, rows).otherwise(k))

    return _spread(page, let(_touched(F.col("boxes"), F.col("bands"), least), without))


def longest_missing(rows: DataFrame, missing: Column) -> DataFrame:
    """The longest run of bands for which the condition holds."""
    w = Window.partitionBy(KEY).orderBy("r")
    marked = rows.withColumn("_gone", missing).withColumn("run", F.sum((~F.col("_gone")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(KEY, "run").agg(F.count_if("_gone").alias("n"))
    return runs.groupBy(KEY).agg(F.max("n").alias("longest"))


def vote_column(boxes: DataFrame, width: int) -> DataFrame:
    """Boxes of the right-hand column; a step that would leave too few is not taken."""
    right = F.col("x") + F.col("w")
    b = boxes.withColumn("right", right).withColumn("inside", F.col("right") >= 0.84 * width)
    b = b.withColumn("any", F.max("inside").over(_all())).filter(F.col("inside") | ~F.col("any"))
    w = Window.partitionBy(KEY).orderBy("right", "ord")
    b = b.withColumns({"n": F.count("*").over(_all()), "k": F.row_number().over(w)})
    anchor = F.median(F.when(F.col("k") > F.floor(F.col("n") / 2), F.col("right"))).over(_all())
    tolerance = F.greatest(F.lit(0.035 * width), 0.65 * F.median("w").over(_all()))
    b = b.withColumn("near", F.col("right") >= anchor - tolerance).withColumn("stay", F.count_if("near").over(_all()))
    narrowed = (F.col("n") >= 4) & (F.col("stay") >= F.greatest(F.lit(3), (0.55 * F.col("n")).cast("long")))
    return b.filter(~narrowed | F.col("near")).select(KEY, "ord", "x", "y", "w", "h")


def top_boxes(boxes: DataFrame, expected: int, width: int) -> DataFrame:
    """The expected number of most plausible boxes: far right, square, of usual area."""
    area = F.col("w") * F.col("h")
    med = F.median(area).over(_all())
    square = 1.0 - F.abs(1.0 - F.col("w") / (F.col("h") + F.lit(1e-6)))
    score = 1.5 * (F.col("x") / width) + square + 0.5 * (1.0 - F.abs(area - med) / (med + F.lit(1e-6)))
    scored = boxes.withColumn("score", F.round(score, 9))
    return scored.withColumn("k", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("score"), "y", "ord"))).filter(F.col("k") <= expected).select(KEY, "ord", "x", "y", "w", "h", "score")


def layout_score(boxes: DataFrame, bands: DataFrame, expected: int, width: int, height: int) -> DataFrame:
    """Boxes found and near the expected number, bands that cover the body, boxes in one column."""
    cut = header_cut(height)
    page = _page(body_boxes(boxes, height), body_bands(bands, height))
    rows, xs, n = F.slice("bands", 1, expected), field(F.col("boxes"), "x"), F.size("boxes")
    top, bottom = F.greatest(F.lit(cut), F.get(rows, F.lit(0)).y1), F.get(rows, F.size(rows) - 1).y2
    cover = F.coalesce(5.0 * F.greatest(F.lit(0), bottom - top) / float(height - cut), F.lit(0.0))
    mean = F.reduce(xs, F.lit(0.0), lambda a, x: a + x) / n
    scatter = let(mean, lambda m: F.sqrt(F.reduce(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n))
    return page.select(KEY, (n - 2.0 * F.abs(n - expected) + cover - F.when(n >= 4, 2.0 * scatter / width).otherwise(0.0)).alias("score"))


def needs_fallback(boxes: DataFrame, bands: DataFrame, expected: int, width: int, height: int) -> DataFrame:
    """Whether a layout is too doubtful to use: (ballot, fallback).

    Boxes may have ``ink``, the dark part of their inside, of which every n-th box is looked at so that about eight are.
    """
    cut = header_cut(height)
    inked = "ink" in boxes.columns
    page = gathered("left", bands=(bands, BAND), boxes=(boxes, (*BOX, "ink") if inked else BOX))
    body = F.filter(F.coalesce("boxes", F.array()), lambda b: b.y + b.h / 2 >= cut)
    page = page.select(KEY, F.slice(F.filter("bands", lambda b: b.y2 > cut), 1, expected).alias("bands"), body.alias("boxes"))
    box, band = F.col("boxes"), F.col("bands")
    seen = F.transform(_taken(box, band, 0.5), lambda b: b.best.isNull())
    part = median(F.transform(_taken(box, band, 0.10), lambda b: F.coalesce(b.best.part, F.lit(0.0))))
    run = lambda gone: F.reduce(gone, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, g: F.when(g, F.struct((s.now + 1).alias("now"), F.greatest(s.most, s.now + 1).alias("most"))).otherwise(F.struct(F.lit(0).alias("now"), s.most.alias("most"))), lambda s: s.most)
    gaps = let(seen, lambda g: F.struct(F.size(F.filter(g, lambda x: x)).alias("missing"), run(g).alias("longest")))
    ratio = lambda f: median(F.transform(box, f))
    top, bottom = F.greatest(F.lit(cut), F.get(band, F.lit(0)).y1), F.get(band, F.size(band) - 1).y2
    cover = F.greatest(F.lit(0), bottom - top) / max(1.0, float(height - cut))
    every = F.greatest(F.lit(1), F.floor(F.size(box) / 8))
    ink = median(F.transform(F.filter(box, lambda b, i: i % every == 0), lambda b: b.ink)) if inked else F.lit(0.0)
    page = page.select(KEY, F.size(box).alias("n"), F.size(band).alias("rows"), gaps.alias("gaps"), part.alias("part"), cover.alias("cover"), ink.alias("ink"), ratio(lambda b: (b.x + b.w) / width).alias("right"), ratio(lambda b: b.w / width).alias("mw"), ratio(lambda b: b.h / height).alias("mh"))
    has, some = F.col("n") > 0, F.col("rows") > 0
    doubt = (
        (F.col("n") < max(3, int(0.7 * expected)))
        | (has & ((F.col("right") < 0.92) | (1 - F.col("right") > 0.08) | (F.col("mw") > 0.20) | (F.col("mh") > 0.10)))
        | ((F.col("rows") >= max(2, int(0.6 * expected))) & (F.col("cover") < 0.70))
        | (has & F.coalesce(F.col("ink") > 0.18, F.lit(False)))
        | (has & some & F.coalesce((F.col("gaps.missing") >= 0.30 * F.col("rows")) | (F.col("gaps.longest") >= 3) | (F.col("part") < 0.35), F.lit(False)))
    )
    return page.select(KEY, F.coalesce(doubt, F.lit(True)).alias("fallback"))


def local_maxima(profile: DataFrame, value: str, least: Column | float, first: int, stop: int) -> DataFrame:
    """Places of a profile (ballot, pos) over a threshold and no lower than both neighbours."""
    w = Window.partitionBy(KEY).orderBy("pos")
    p = profile.withColumns({"_before": F.lag(value).over(w), "_after": F.lead(value).over(w), "_least": least if isinstance(least, Column) else F.lit(least)})
    return p.filter((F.col(value) > F.col("_least")) & (F.col(value) >= F.col("_before")) & (F.col(value) >= F.col("_after")) & (F.col("pos") >= first) & (F.col("pos") < stop)).drop("_before", "_after", "_least")


def smoothed(profile: DataFrame, value: str, width: int) -> DataFrame:
    """Centred moving average; the window shrinks at the ends."""
    half = width // 2
    return profile.withColumn("smooth", F.avg(value).over(Window.partitionBy(KEY).orderBy("pos").rowsBetween(-half, half)))


def peak_threshold(value: str) -> Column:
    return F.greatest(F.percentile(value, F.lit(0.92)), F.lit(0.12))


def _nearest(y: Column, lines: Column) -> Column:
    return F.array_min(F.transform(lines, lambda s: F.struct(F.abs(s - y).alias("distance"), s.alias("nearest"))))


def nearest(boundaries: DataFrame, separators: DataFrame) -> DataFrame:
    """Each boundary (ballot, r, y) with its nearest separator (ballot, s), the smaller one if equal."""
    page = gathered("inner", edges=(boundaries, ("r", "y")), lines=(separators, ("s",)))
    lines = field(F.col("lines"), "s")
    rows = page.select(KEY, F.explode(let(lines, lambda s: F.transform("edges", lambda e: F.struct(e.r.alias("r"), e.y.alias("y"), _nearest(e.y, s).alias("m"))))).alias("e"))
    return rows.select(KEY, "e.r", "e.y", "e.m.nearest", "e.m.distance")


def snap_bands(bands: DataFrame, separators: DataFrame) -> DataFrame:
    """Inner boundaries move to a near separator if the bands beside stay high enough.

    Whether a boundary may move depends on where the one before went: a fold over the ordered array.
    """
    page = gathered("left", bands=(bands, BAND), lines=(separators, ("s",)))
    lines, rows = field(F.coalesce("lines", F.array()), "s"), F.col("bands")
    gap = F.coalesce(median(F.transform(_gaps(F.transform(rows, lambda b: b.y1 + b.y2)), lambda g: g / 2)), F.lit(60.0))
    least = long(F.greatest(F.lit(10.0), 0.6 * median(F.transform(rows, lambda b: b.y2 - b.y1))))
    page = page.select(KEY, "bands", lines.alias("lines"), gap.alias("gap"), least.alias("least"))
    least = F.col("least")

    def wish(band: Column, i: Column) -> Column:
        following = F.get("bands", i + 1).y2
        moved = let(_nearest(band.y2, F.col("lines")), lambda m: F.when((m.distance <= 0.12 * F.col("gap")) & (following - m.nearest >= least), m.nearest))
        return F.struct(band.r.alias("r"), band.y2.alias("y2"), F.when(following.isNotNull(), moved).alias("wish"))

    start = F.struct(long(F.get("bands", F.lit(0)).y1).alias("top"), F.array().cast(_BANDS).alias("out"))

    def step(state: Column, band: Column) -> Column:
        end = F.when(band.wish - state.top >= least, band.wish).otherwise(band.y2).cast("long")
        height = F.greatest(end - state.top, least)
        return F.struct(end.alias("top"), F.concat(state.out, F.array(F.struct(band.r.alias("r"), state.top.alias("y1"), (state.top + height).alias("y2")))).alias("out"))

    return _spread(page, F.aggregate(F.transform("bands", wish), start, step, lambda s: s.out))


def recover_missing(bands: DataFrame, expected: int, height: int, least: int = 10) -> DataFrame:
    """Ballots with too few bands: the tallest is cut into strips of the usual height, again and again.

    Each cut depends on the last: a fold over as many steps as bands may be missing.
    """
    page = gathered(bands=(bands.select(KEY, "y1", "y2"), ("y1", "y2")))
    heights = F.transform("bands", lambda b: b.y2 - b.y1)
    usual = median(heights)
    page = page.withColumn("usual", F.when(usual > 0, usual).otherwise(float(max(least, height / expected))))

    def cut(rows: Column) -> Column:
        tallest = F.reduce(rows, F.get(rows, F.lit(0)), lambda a, b: F.when(b.y2 - b.y1 > a.y2 - a.y1, b).otherwise(a))

        def strips(t: Column) -> Column:
            size = t.y2 - t.y1
            pieces = F.greatest(F.lit(2), F.least(expected - F.size(rows) + 1, F.bround(size / F.col("usual"), 0).cast("int")))

            def parts(n: Column) -> Column:
                at = lambda j: F.when(j == n, t.y2).otherwise(long(t.y1 + j * size / n))
                every = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(at(j).alias("y1"), at(j + 1).alias("y2")))
                good = F.filter(every, lambda s: s.y2 - s.y1 >= least)
                others = F.filter(rows, lambda b: ~((b.y1 == t.y1) & (b.y2 == t.y2)))
                copies = F.array_repeat(t, F.size(rows) - F.size(others) - 1)
                return let(good, lambda g: F.when((size < 2 * least) | (F.size(g) < 2), rows).otherwise(F.array_sort(F.concat(others, copies, g))))

            return let(pieces, parts)

        return let(tallest, strips)

    steps = F.sequence(F.lit(1), F.lit(max(1, expected)))
    kind = "array<struct<y1:bigint,y2:bigint>>"
    done = F.reduce(steps, F.col("bands").cast(kind), lambda rows, _: F.when(F.size(rows) < expected, cut(rows)).otherwise(rows).cast(kind))
    out = F.when(F.size("bands") < expected, F.slice(done, 1, expected)).otherwise(F.col("bands").cast(kind))
    return page.select(KEY, F.posexplode(out).alias("i", "b")).select(KEY, long(F.col("i") + 1).alias("r"), "b.y1", "b.y2")


def bands_from_separators(separators: DataFrame, height: int, tolerance: int | None = None) -> DataFrame:
    """Bands between clustered separator lines (ballot, s) below the header.

    Outer boundaries a usual gap away are added where the page leaves room for more than 0.35 of one;
    bands under 0.45 of the usual gap, or ten pixels, fall away.
    """
    cut, tolerance = header_cut(height), max(4, int(0.008 * height)) if tolerance is None else tolerance
    merged = lambda lines: F.transform(clustered(F.array_sort(lines), lambda v: v, F.lit(tolerance), "bigint"), lambda run: long(median(run)))
    page = gathered(lines=(separators, ("s",))).select(KEY, merged(F.transform("lines", lambda x: long(x.s))).alias("lines"))
    gap = long(median(F.filter(_gaps(F.col("lines")), lambda g: g > 0)))
    page = page.select(KEY, F.filter("lines", lambda s: s >= cut).alias("lines"), F.coalesce(gap, F.lit(int(0.06 * height))).alias("gap"))
    some = F.size("lines") > 0
    first, last, room = F.array_min("lines"), F.array_max("lines"), long(0.35 * F.col("gap"))
    top, bottom = F.greatest(F.lit(cut), first - F.col("gap")), F.least(F.lit(height - 1), last + F.col("gap"))
    more = F.concat(F.when(some & (top < first - room), F.array(long(top))).otherwise(F.array()), F.col("lines"), F.when(some & (bottom > last + room), F.array(long(bottom))).otherwise(F.array()))
    page = page.select(KEY, "gap", merged(more).alias("lines"))
    least = F.greatest(F.lit(10), long(0.45 * F.col("gap")))
    n = F.greatest(F.size("lines") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("lines", 1, n), F.slice("lines", 2, n), lambda a, b: F.struct(a.alias("y1"), b.alias("y2")))
    high = F.filter(pairs, lambda p: p.y2 - p.y1 >= least)
    return _spread(page, F.transform(high, lambda p, i: F.struct(long(i + 1).alias("r"), p.y1.alias("y1"), p.y2.alias("y2"))))


def aligned(bands: DataFrame, boxes: DataFrame) -> DataFrame:
    """Bands and boxes by ordinal; where one side is shorter its columns are null."""
    page = _page(boxes, bands).withColumn("boxes", F.array_sort(F.transform("boxes", lambda b: F.struct(b.y.alias("y"), b.ord.alias("ord"), b.x.alias("x"), b.w.alias("w"), b.h.alias("h")))))
    both = page.select(KEY, F.explode(F.zip_with("bands", "boxes", lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    return both.select(KEY, *[f"p.a.{c}" for c in BAND], *[f"p.b.{c}" for c in "xywh"])


def bands_of(frames: Iterator[DataFrame]) -> DataFrame:
    """Union of separator candidates of several detectors."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first
