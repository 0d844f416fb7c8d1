"""Data sets and lineage: splits, plans, replication, parity, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Placement categories of the print plan and how many stamps each has (ten ballots have
# none), appearances in turn, and weights of positions on synthetic pages.
PLACEMENTS = (("top_instruction_text", 12), ("candidate_name_party_text", 8), ("party_logo_or_candidate_photo", 6), ("blank_white_area", 8), ("near_page_edge_or_margin", 4), ("partly_off_ballot_area", 2), ("none", 10))
APPEARANCES = ("clear_dark", "normal_grey", "faint_light", "slightly_rotated", "overlapping_dark_text")
POSITIONS = (("border", 0.35), ("anywhere", 0.25), ("top", 0.25), ("right_column", 0.15))


def shuffle_split(rows: DataFrame, key: str, seed: str = "123", test: float = 0.15, val: float = 0.15) -> DataFrame:
    """split: exactly int(test * n) and int(val * n) rows, the rest for training.

    The order is a hash of seed and key.  Ranks come from counts of hash ranges: rows are counted by
    the first bits of their hash, the few thousand counts are summed up in order, and only rows
    within one range are sorted together, so no task sees all rows.
    """
    hashed = rows.withColumn("_h", F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))))
    hashed = hashed.withColumn("_range", F.substring("_h", 1, 3))
    counts = hashed.groupBy("_range").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select("_range", (F.sum("_n").over(w) - F.col("_n")).alias("_start"), F.sum("_n").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    ranked = hashed.join(F.broadcast(starts), "_range").withColumn("_k", F.col("_start") + F.row_number().over(Window.partitionBy("_range").orderBy("_h", key)))
    n_test, n_val = (F.lit(test) * F.col("_total")).cast("long"), (F.lit(val) * F.col("_total")).cast("long")
    split = F.when(F.col("_k") <= n_test, "test").when(F.col("_k") <= n_test + n_val, "val").otherwise("train")
    return ranked.withColumn("split", split).select(*rows.columns, "split")


def stratified_plan(spark: SparkSession) -> DataFrame:
    """Fifty ballots in order: category, appearance by ordinal, stamped or not."""
    rows = spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(PLACEMENTS)], "place int, category string, n int")
    each = rows.select("place", "category", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    numbered = each.withColumn("ordinal", F.row_number().over(Window.orderBy("place", "k")).cast("long"))
    stamped = F.col("category") != "none"
    return numbered.select("ordinal", "category", stamped.alias("stamped"), F.when(stamped, F.get(F.array(*[F.lit(a) for a in APPEARANCES]), ((F.col("ordinal") - 1) % len(APPEARANCES)).cast("int"))).alias("appearance"))


def replicated(real: DataFrame, synthetic: DataFrame, times: int) -> DataFrame:
    """Synthetic rows, and every real row so many times."""
    copies = real.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(times).cast("long"))))
    return copies.unionByName(synthetic.withColumn("copy", F.lit(1).cast("long")))


def parity(local: DataFrame, remote: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Both sides by key: whether each field is equal (null equals null), and all are."""
    both = local.select(key, *[F.col(f).alias(f"l_{f}") for f in fields]).join(remote.select(key, *[F.col(f).alias(f"r_{f}") for f in fields]), key)
    same = {f: F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")) for f in fields}
    every = F.lit(True)
    for c in same.values():
        every = every & c
    return both.select(key, *[c.alias(f"same_{f}") for f, c in same.items()], every.alias("same"))


def diagnostics(files: DataFrame) -> DataFrame:
    """Path, size and hash of whole files (as binaryFile gives them)."""
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def audit(rows: DataFrame, group: str, fields: list[str], as_of: str) -> DataFrame:
    """One record for each group with all its rows in order; groups are batches of bounded size."""
    inference = F.array_sort(F.collect_list(F.struct(*fields)))
    return rows.groupBy(group).agg(inference.alias("inference"), F.count("*").alias("n")).withColumn("ts", F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def weighted_choice(fraction: Column, choices: list[tuple[str, float]]) -> Column:
    """The choice whose cumulative weight a fraction in [0, 1) falls below."""
    reached, out = 0.0, None
    for name, weight in choices[:-1]:
        reached += weight
        out = F.when(fraction < reached, name) if out is None else out.when(fraction < reached, name)
    return F.lit(choices[-1][0]) if out is None else out.otherwise(choices[-1][0])


def drawn(key: Column, seed: str) -> Column:
    """A fraction in [0, 1) that depends on seed and key alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
