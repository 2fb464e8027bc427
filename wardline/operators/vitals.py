"""Vital signs to patient totals, change sets and block roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.scoring import (
    DEFAULT_BLOCK,
    VITAL_CODES,
    block_of,
    news2_score,
    observed_at,
    patient_id,
)


def scored(observations: DataFrame) -> DataFrame:
    """patient_id, code, news2_value, obs_instant and seq of observations that belong to a patient.

    A ``patient_id`` that is there already is taken, so a table laid out by it stays so.
    """
    return observations.select(
        F.col("patient_id") if "patient_id" in observations.columns else patient_id(F.col("subject")).alias("patient_id"),
        "code",
        news2_score(F.col("code"), F.col("value")).alias("news2_value"),
        observed_at(F.col("issued"), F.col("effective")).alias("obs_instant"),
        "seq",
    ).where(F.col("patient_id").isNotNull())


def latest_vitals(scores: DataFrame) -> DataFrame:
    """Newest score per patient and vital sign; of equal instants the first arrival stays.

    ``max_by`` combines on the map side, so a patient with very many rows is no hot task.
    """
    newest = F.max_by(F.struct("news2_value", "obs_instant"), F.struct("obs_instant", (-F.col("seq")).alias("s")))
    return (
        scores.where(F.col("code").isin(*VITAL_CODES))
        .groupBy("patient_id", "code")
        .agg(newest.alias("n"))
        .select("patient_id", "code", "n.news2_value", "n.obs_instant")
    )


def merge_latest(current: DataFrame, incoming: DataFrame, mode: str = "event_time") -> DataFrame:
    """Upsert of newest rows. ``arrival``: incoming rows replace stored ones; ``event_time``: only newer ones do."""
    if mode not in ("arrival", "event_time"):
        raise ValueError(mode)
    columns = ["patient_id", "code", "news2_value", "obs_instant"]
    both = current.select(*columns, F.lit(0).alias("late")).unionByName(incoming.select(*columns, F.lit(1).alias("late")))
    order = F.struct("late") if mode == "arrival" else F.struct("obs_instant", (-F.col("late")).alias("stored_first"))
    picked = F.max_by(F.struct("news2_value", "obs_instant"), order)
    return both.groupBy("patient_id", "code").agg(picked.alias("n")).select("patient_id", "code", "n.*")


def patient_totals(agg: DataFrame, patients: DataFrame | None = None) -> DataFrame:
    """Sum of the newest scores per patient; with ``patients`` (id) also those without any, at 0."""
    totals = agg.groupBy("patient_id").agg(F.sum("news2_value").cast("int").alias("total"))
    if patients is None:
        return totals
    return (
        patients.select(F.col("id").alias("patient_id"))
        .join(totals, "patient_id", "left")
        .select("patient_id", F.coalesce("total", F.lit(0)).alias("total"))
    )


def affected_patients(created: DataFrame, updated: DataFrame) -> DataFrame:
    """Distinct patients of the created and updated observations."""
    subjects = created.select("subject").unionByName(updated.select("subject"))
    return subjects.select(patient_id(F.col("subject")).alias("patient_id")).where("patient_id IS NOT NULL").distinct()


def with_block(patients: DataFrame, default: str = DEFAULT_BLOCK, extensions: str = "extension") -> DataFrame:
    """Set ``block`` from the location extension (or an existing block column), ``default`` if it is missing."""
    known = F.col("block") if "block" in patients.columns else block_of(F.col(extensions))
    return patients.withColumn("block", F.coalesce(known, F.lit(default)))


def orphan_totals(totals: DataFrame, patients: DataFrame) -> DataFrame:
    """Totals whose patient does not exist."""
    return totals.join(patients.select(F.col("id").alias("patient_id")), "patient_id", "left_anti")


def patient_updates(
    totals: DataFrame, patients: DataFrame, default_block: str = DEFAULT_BLOCK, on_missing: str = "drop"
) -> DataFrame:
    """patient_id, old_total, new_total, block and result for every total whose patient exists.

    ``changed`` if the stored total differs (null differs from any) or the block had to be added.
    ``on_missing='error'`` fails the job at the first total without a patient.
    """
    side = patients.select(F.col("id").alias("patient_id"), F.col("stored_total").alias("old_total"), "block", F.lit(True).alias("known"))
    joined = totals.join(side, "patient_id", "inner" if on_missing == "drop" else "left")
    if on_missing == "error":
        guard = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("no such patient: "), "patient_id")).cast("boolean"))
        joined = joined.where(F.coalesce(guard, F.lit(True)))
    same = F.col("total").eqNullSafe(F.col("old_total")) & F.col("block").isNotNull()
    return joined.select(
        "patient_id",
        "old_total",
        F.col("total").alias("new_total"),
        F.coalesce("block", F.lit(default_block)).alias("block"),
        F.when(same, "unchanged").otherwise("changed").alias("result"),
    )


def update_outcomes(updates: DataFrame) -> DataFrame:
    """Patients per result."""
    return updates.groupBy("result").agg(F.count(F.lit(1)).alias("patients"))


def block_rollup(totals: DataFrame, patient_block: DataFrame) -> DataFrame:
    """Total score, patients and average per block. Blocks are few and combine on the map side."""
    joined = patient_block.select("patient_id", "block").join(totals.select("patient_id", "total"), "patient_id")
    rolled = joined.groupBy("block").agg(F.sum("total").alias("total_score"), F.count(F.lit(1)).alias("patient_count"))
    return rolled.withColumn("average", _average())


def _average():
    return F.when(F.col("patient_count") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("total_score"), F.col("patient_count")))


def block_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change per block from patients' last to new (patient_id, block, score): old block down, new block up."""
    signed = lambda df, sign: df.select("block", (F.col("score") * sign).alias("score"), F.lit(sign).alias("n"))
    joined = old.select("patient_id", F.struct("block", "score").alias("o")).join(
        new.select("patient_id", F.struct("block", "score").alias("n")), "patient_id", "full"
    )
    moved = joined.where(~F.col("o").eqNullSafe(F.col("n")))
    down = signed(moved.where("o IS NOT NULL").select("o.*"), -1)
    up = signed(moved.where("n IS NOT NULL").select("n.*"), 1)
    return down.unionByName(up).groupBy("block").agg(F.sum("score").alias("d_score"), F.sum("n").alias("d_count"))


def apply_block_deltas(block_agg: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add deltas to the stored roll-up; totals and counts stop at 0."""
    zero = F.lit(0).cast("long")
    joined = block_agg.select("block", "total_score", "patient_count").join(deltas, "block", "full")
    clamp = lambda a, b: F.greatest(zero, F.coalesce(a, zero) + F.coalesce(b, zero))
    return joined.select(
        "block",
        clamp(F.col("total_score"), F.col("d_score")).alias("total_score"),
        clamp(F.col("patient_count"), F.col("d_count")).alias("patient_count"),
    ).withColumn("average", _average())


def block_details(block_agg: DataFrame, blocks: DataFrame) -> DataFrame:
    """Average and count of the blocks asked for; 0 for one that is not known."""
    return blocks.select("block").join(block_agg, "block", "left").select(
        "block",
        F.coalesce("average", F.lit(0.0)).alias("average"),
        F.coalesce("patient_count", F.lit(0).cast("long")).alias("patient_count"),
    )
