"""Evaluating a detector: confusion counts, threshold sweeps, false negatives.

Rows have score, geometry_ok, decision and truth (booleans where they are flags).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.operators.decisions import VALID, Thresholds, false_negative_cause

TINY = 1e-9


def _rates(counts: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.col(a) / (F.col(a) + F.col(b) + TINY)
    return counts.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn"), "fpr": ratio("fp", "tn")})


def _counts(predicted) -> list:
    truth = F.col("truth")
    cells = {"tp": predicted & truth, "fp": predicted & ~truth, "tn": ~predicted & ~truth, "fn": ~predicted & truth}
    return [F.count_if(c).alias(n) for n, c in cells.items()]


def confusion(rows: DataFrame) -> DataFrame:
    """One row: images evaluated, with a stamp and without; counts with a valid stamp as the positive, and rates."""
    totals = [F.count("*").alias("evaluated"), F.count_if("truth").alias("positives"), F.count_if(~F.col("truth")).alias("negatives")]
    return _rates(rows.agg(*totals, *_counts(F.col("decision") == VALID)))


class Grid(NamedTuple):
    """Evenly spaced thresholds, both ends included."""

    steps: int
    first: float
    last: float

    def values(self) -> list[float]:
        width = (self.last - self.first) / (self.steps - 1)
        return [self.first + i * width for i in range(self.steps)]

    def reached(self, score: Column) -> Column:
        """How many thresholds a score reaches (null and NaN: none), without looking through them."""
        at = F.array(*[F.lit(v) for v in self.values()])
        guess = F.floor((score - F.lit(self.first)) / F.lit((self.last - self.first) / (self.steps - 1)))
        guess = F.greatest(F.lit(0), F.least(F.lit(self.steps - 1), guess.cast("int")))
        # rounding puts the guess one place beside the right one at most
        near = F.when(score < F.get(at, guess), guess).when(score < F.get(at, guess + 1), guess + 1).otherwise(F.least(guess + 2, F.lit(self.steps)))
        return F.when(F.isnan(score), 0).otherwise(F.coalesce(near, F.lit(0)))


#: The usual sweep.
VALID_GRID, REVIEW_GRID = Grid(181, 0.05, 0.95), Grid(10, 0.05, 0.50)


def sweep(rows: DataFrame, valid: Grid = VALID_GRID, review: Grid = REVIEW_GRID) -> DataFrame:
    """Counts for every pair of thresholds with review <= valid.

    A row counts by how many thresholds of each grid its score reaches, so the rows shrink to some
    hundred counts in their first aggregation whatever the scores are; they become one array, and the
    pairs of thresholds sum that array up.  Unknown geometry doesn't pass, unknown truth is false.
    """
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("geometry_ok", "truth")]
    cells = rows.select(valid.reached(F.col("score")).alias("v"), review.reached(F.col("score")).alias("r"), *flags).groupBy("v", "r", "geometry_ok", "truth").agg(F.count("*").alias("n"))
    counts = cells.agg(F.collect_list(F.struct("v", "r", "geometry_ok", "truth", "n")).alias("c")).filter("size(c) > 0")
    total = lambda of: F.reduce(F.filter("c", of), F.lit(0).cast("long"), lambda a, x: a + x.n)
    pairs = counts.select("c", F.posexplode(F.array(*[F.lit(x) for x in valid.values()])).alias("i", "score_valid"))
    above = lambda x: x.geometry_ok & (x.v > F.col("i"))
    cases = {"tp": lambda x: above(x) & x.truth, "fp": lambda x: above(x) & ~x.truth, "tn": lambda x: ~above(x) & ~x.truth, "fn": lambda x: ~above(x) & x.truth}
    pairs = pairs.select("c", "score_valid", *[total(case).alias(name) for name, case in cases.items()])
    pairs = pairs.select("*", F.posexplode(F.array(*[F.lit(x) for x in review.values()])).alias("j", "score_review")).filter("score_review <= score_valid")
    reached = total(lambda x: x.geometry_ok & (x.r > F.col("j")))
    return _rates(pairs.select("score_valid", "score_review", "tp", "fp", "tn", "fn", (reached - F.col("tp") - F.col("fp")).alias("review")))


def best(metrics: DataFrame, most_fpr: float = 0.002) -> DataFrame:
    """Most recall, then precision, then the lowest thresholds, where the false positive rate allows."""
    return metrics.filter(F.col("fpr") <= most_fpr).orderBy(F.desc("recall"), F.desc("precision"), "score_valid", "score_review").limit(1)


def false_negatives(rows: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """True stamps that weren't found valid, with their cause."""
    missed = rows.filter(F.col("truth") & (F.col("decision") != VALID))
    return missed.withColumn("cause", false_negative_cause(F.col("has_box"), F.col("geometry_ok"), F.col("decision"), F.col("score"), t))


def causes(missed: DataFrame) -> DataFrame:
    return missed.groupBy("cause").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cause")


def first_of_each(missed: DataFrame, limit: int, order: str) -> DataFrame:
    """The first rows of each cause; few enough pass each task before the window sees them."""
    w = Window.partitionBy("cause").orderBy(order)
    return missed.withColumn("position", F.row_number().over(w).cast("long")).filter(F.col("position") <= limit)
