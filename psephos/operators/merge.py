"""Bringing stamps, digits and candidates together."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.functions.text import basename, stem

FIRST_ID, LAST_ID = 1_000_001, 9_999_999


def last_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as a table written over row by row would hold it."""
    names = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*names), F.col(order)).alias("_row")).select(key, "_row.*")


def merge_two_level(stamps: DataFrame, digits: DataFrame, image: str = "image", order: str = "position", prefix: str = "digit_") -> DataFrame:
    """Stamp rows with the digit row of the same basename, else of the same stem, else nulls.

    Both sides keep the last row of a key.  Digit columns get the prefix.
    """
    left = last_of(stamps.withColumn("name", basename(F.col(image))), "name", order).withColumn("_stem", stem(F.col("name")))
    right = last_of(digits.withColumn("name", basename(F.col(image))), "name", order)
    columns = [c for c in right.columns if c not in ("name", image)]
    packed = right.select(F.col("name").alias("_key"), F.struct(*columns).alias("_digits"))
    by_name = left.join(packed.select(F.col("_key").alias("name"), F.col("_digits").alias("_by_name")), "name", "left")
    both = by_name.join(packed.select(F.col("_key").alias("_stem"), F.col("_digits").alias("_by_stem")), "_stem", "left")
    found = F.coalesce("_by_name", "_by_stem")
    return both.select(*left.drop("_stem").columns, *[found[c].alias(prefix + c) for c in columns])


def ranked_candidates(candidates: DataFrame, election: str, candidate: str) -> DataFrame:
    """Candidates with their 1-based row on the paper of their election."""
    return candidates.withColumn("row_num", F.row_number().over(Window.partitionBy(election).orderBy(candidate)).cast("long"))


def preference_facts(digits: DataFrame, ranked: DataFrame, election: str) -> DataFrame:
    """Digits meet candidates by row; unmatched ones fall away.  The candidate table is a dimension of
    a few rows for each election; Spark broadcasts it by its measured size."""
    return digits.filter("preference IS NOT NULL AND row_num IS NOT NULL").join(ranked, [election, "row_num"])


def allocate_ids(rows: DataFrame, rank: str, used: DataFrame | None = None, multiplier: int = 7_368_787, shift: int = 12_345, shared: bool = False) -> DataFrame:
    """random_ballot_id by a bijection of ranks (from 0) onto the id range; a rank beyond the range is an error.

    With a table of ids in use, ``rank`` may be any whole number: each keeps the id of its place in the
    range if that is free (of several, the least one does), and the others get the ids that are left.
    More keys than free ids are an error; ``shared`` allows them: as many as there are free ids get one each,
    and only those beyond keep the id of their place, which another one has too.
    """
    size = LAST_ID - FIRST_ID + 1
    if gcd(multiplier, size) != 1:
        raise ValueError("the multiplier must be coprime to the number of ids")
    key = F.col(rank).cast("long")
    place = lambda n: F.lit(FIRST_ID) + F.pmod(F.pmod(n, F.lit(size)) * multiplier + shift, F.lit(size))
    first = place(key)
    if used is None:
        beyond = F.raise_error(F.concat(F.lit(f"{size} ids, and no rank "), key.cast("string"))).cast("long")
        return rows.withColumn("random_ballot_id", F.when((key < 0) | (key >= size), beyond).otherwise(first))

    keys = rows.select(key.alias("_key"), first.alias("_id")).filter("_key IS NOT NULL").distinct()
    taken = used.select(F.col("random_ballot_id").cast("long").alias("_id")).distinct()
    kept = keys.groupBy("_id").agg(F.min("_key").alias("_key")).join(taken, "_id", "left_anti")
    moved = keys.join(kept, ["_key", "_id"], "left_anti").select("_key")
    count = moved.count()
    if not count:
        return rows.withColumn("random_ballot_id", first)
    # Ids of ranks from the middle on: some more than are needed, and all if those don't do.
    for some in sorted({min(size, 2 * count + 1000), size}):
        spread = rows.sparkSession.range(some).select(place(F.col("id") + size // 2).alias("_id"))
        free = spread.join(taken.unionByName(kept.select("_id")), "_id", "left_anti")
        if count <= (left := free.count()):
            break
    else:
        if not shared:
            raise ValueError(f"{count} more ids are needed, and {left} of {size} are free")
    given = hash_ranked(moved, "_key").join(hash_ranked(free, "_id"), "_rank", "left" if shared else "inner")
    given = given.select("_key", F.coalesce("_id", place(F.col("_key"))).alias("_id"))
    given = kept.select("_key", "_id").unionByName(given).withColumnRenamed("_id", "random_ballot_id")
    return rows.join(given, key == F.col("_key"), "left").drop("_key")


def hash_ranked(df: DataFrame, column: str) -> DataFrame:
    """df with _rank from 0 in the order of the column's hash, from counts of hash ranges."""
    hashed = df.withColumn("_h", F.xxhash64(column)).withColumn("_bin", F.shiftright("_h", 52))
    bins = hashed.groupBy("_bin").agg(F.count("*").alias("_n"))
    start = bins.select("_bin", (F.sum("_n").over(Window.orderBy("_bin")) - F.col("_n")).alias("_start"))
    ranked = hashed.join(F.broadcast(start), "_bin").withColumn("_rank", F.col("_start") + F.row_number().over(Window.partitionBy("_bin").orderBy("_h", column)) - 1)
    return ranked.select(*df.columns, "_rank")


def next_id(ids: DataFrame, column: str = "random_ballot_id") -> DataFrame:
    return ids.agg(F.coalesce(F.max(column) + 1, F.lit(FIRST_ID)).cast("long").alias("next_id"))


def image_url(override: Column, image: Column) -> Column:
    return basename(F.coalesce(F.when(F.trim(override) != "", F.trim(override)), image))
