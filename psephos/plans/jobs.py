"""Whole jobs with explicit parameters: merging one election's readings, one ballot's summary, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.functions.text import stem
from psephos.operators import decisions, evaluation, merge
from psephos.sources import files, sinks


def digit_runs(rows: DataFrame) -> DataFrame:
    """Per ballot: results in order, numbers_found and sequence_ok, from digit rows (ballot, position, row, digit, is_number)."""
    number = F.when(F.col("is_number"), F.col("digit").cast("int"))
    results = F.array_sort(F.collect_list(F.struct("position", "row", "digit")))
    run = rows.withColumn("number", number).groupBy("ballot").agg(results.alias("results"), F.count("number").alias("numbers_found"), F.sort_array(F.collect_list("number")).alias("numbers"))
    return run.select(F.col("ballot").alias("image"), "results", "numbers_found", decisions.valid_sequence(F.col("numbers")).alias("sequence_ok"))


def merged(manifest: DataFrame, digits: DataFrame) -> DataFrame:
    """Stamp records with their digit run, the label and score defaulted, the ballot's state derived."""
    stamps = manifest.select("image", F.coalesce("decision", F.lit(decisions.NONE)).alias("stamp_label"), F.coalesce("score", F.lit(0.0)).alias("score"), F.monotonically_increasing_id().alias("position"))
    runs = digit_runs(digits).withColumn("position", F.lit(0))
    out = merge.merge_two_level(stamps, runs)
    return out.withColumn("ballot_state", decisions.ballot_state(F.col("stamp_label"), F.col("digit_sequence_ok")))


def facts(ballots: DataFrame, candidates: DataFrame, election: int, as_of: str, box: str, url_override: str | None = None, used: DataFrame | None = None) -> DataFrame:
    """Preference facts of merged ballots: one row for each digit that meets a candidate's row.

    Ids follow the rank of the ballot's name; ranks come from counts of name ranges, as in the data set
    split.  Ids in use (random_ballot_id) aren't given again.
    """
    with_ids = merge.allocate_ids(merge.hash_ranked(ballots, "name"), "_rank", used)
    rows = with_ids.select("name", "image", "random_ballot_id", "ballot_state", F.explode("digit_results").alias("r"))
    digits = rows.select("name", "random_ballot_id", "ballot_state", merge.image_url(F.lit(url_override).cast("string"), F.col("image")).alias("image_url"), F.lit(election).alias("election_id"), F.col("r.row").cast("long").alias("row_num"), F.expr("try_cast(nullif(nullif(r.digit, 'NULL'), '') AS int)").alias("preference"))
    dimension = merge.ranked_candidates(candidates.select(F.col("election_id"), F.col("id").alias("candidate_id"), *[c for c in ("name", "candidate_name", "full_name", "display_name") if c in candidates.columns]), "election_id", "candidate_id")
    names = [F.col(c) for c in ("name", "candidate_name", "full_name", "display_name") if c in candidates.columns]
    dimension = dimension.select("election_id", "row_num", "candidate_id", decisions.display_name(F.col("candidate_id"), *names).alias("shown_name"))
    out = merge.preference_facts(digits.drop("name"), dimension, "election_id")
    return out.withColumns({"created_at": F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "box_location": F.lit(box)}).withColumnRenamed("shown_name", "candidate_name").select(*sinks.FACTS)


def run_merge(spark: SparkSession, manifest_path: str, digits_path: str, candidates: DataFrame, election: int, as_of: str, box: str, out: str) -> DataFrame:
    """Read, merge and write: merged records as JSON lines, preference facts as CSV and as tables.

    The tables keep what other elections and runs wrote, and their ids; a repeated run (same election and
    time) replaces its own rows and gives the same ids.
    """
    ballots = merged(files.manifest(spark, manifest_path), files.digit_folders(spark, digits_path))
    rows = facts(ballots, candidates, election, as_of, box, used=sinks.ids_in_use(spark, f"{out}/tables", election, as_of))
    sinks.json_lines(ballots, f"{out}/merged")
    sinks.preference_csv(rows, f"{out}/preferences")
    papers = rows.select("box_location", "image_url", "random_ballot_id", "ballot_state", "election_id").distinct()
    sinks.ballots_and_preferences(papers, rows.select("election_id", "preference", "random_ballot_id", "candidate_id"), f"{out}/tables", as_of)
    return rows


def evaluate(manifest: DataFrame, truth: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Manifest rows as evaluation rows: those in the target set, with truth by stem and geometry defaulted."""
    rows = manifest.withColumn("stem", stem(F.col("image")))
    if targets is not None:
        rows = rows.join(targets.select("stem").distinct(), "stem", "left_semi")
    rows = rows.join(truth.select("stem", "positive"), "stem", "left")
    return rows.select("stem", "image", "decision", "score", decisions.geometry_or_decision(F.col("geo_ok"), F.col("decision")).alias("geometry_ok"), F.col("bbox").isNotNull().alias("has_box"), F.coalesce("positive", F.lit(False)).alias("truth"))


def calibrate(spark: SparkSession, rows: DataFrame, most_fpr: float = 0.002) -> DataFrame:
    """The best pair of thresholds over the usual grids."""
    return evaluation.best(evaluation.sweep(rows), most_fpr)


def run_summary(ballots: DataFrame) -> DataFrame:
    """What a run tells of each ballot: decision, preferences as JSON, derived state."""
    return ballots.select("name", F.struct(F.col("stamp_label").alias("decision"), "score").alias("stamp_decision"), F.to_json("digit_results").alias("preferences"), F.col("ballot_state").alias("derived_ballot_state"))
