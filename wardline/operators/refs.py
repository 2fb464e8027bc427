"""Checks on references: rows (src_type, src_id, path, ref_type, ref_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.sources.staging import staged

KEY = ["ref_type", "ref_id"]


def _targets(targets: DataFrame) -> DataFrame:
    return targets.select(F.col("resource_type").alias("ref_type"), F.col("id").alias("ref_id"))


def dangling_refs(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """References to nothing. ``targets``: resource_type, id. Logical references (is_logical) are left out."""
    real = refs.where(~F.col("is_logical")) if "is_logical" in refs.columns else refs
    return real.join(_targets(targets), KEY, "left_anti")


def placeholders(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with one stub (is_placeholder) for each thing referred to that is not there."""
    stubs = dangling_refs(refs, targets).select(F.col("ref_type").alias("resource_type"), F.col("ref_id").alias("id")).distinct()
    return targets.select("resource_type", "id", F.lit(False).alias("is_placeholder")).unionByName(stubs.withColumn("is_placeholder", F.lit(True)))


def delete_blockers(to_delete: DataFrame, refs: DataFrame) -> DataFrame:
    """References from rows that stay to rows that are to go (resource_type, id)."""
    going = to_delete.select("resource_type", "id").distinct()
    hits = refs.join(_targets(going), KEY)
    gone = going.select(F.col("resource_type").alias("src_type"), F.col("id").alias("src_id"))
    return hits.join(gone, ["src_type", "src_id"], "left_anti").select("src_type", "src_id", "path", *KEY)


def cascade_delete(to_delete: DataFrame, refs: DataFrame, max_depth: int = 50) -> DataFrame:
    """(resource_type, id, depth) of the given rows and of all that refer to them, directly or not.

    Each round joins only the newest rows and is written, so neither lineage nor work is repeated.
    """
    frontier = staged(to_delete.select("resource_type", "id").distinct().withColumn("depth", F.lit(0)), "cascade")
    seen = frontier
    for depth in range(1, max_depth + 1):
        hits = refs.join(_targets(frontier), KEY).select(F.col("src_type").alias("resource_type"), F.col("src_id").alias("id")).distinct()
        fresh = hits.join(seen, ["resource_type", "id"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = staged(fresh, "cascade")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"the cascade goes deeper than {max_depth}")


def pin_versions(refs: DataFrame, current: DataFrame, paths: list[str]) -> DataFrame:
    """Add ``reference``: with the target's newest version at the chosen paths, plain elsewhere or if it has none."""
    newest = current.groupBy(F.col("resource_type").alias("ref_type"), F.col("id").alias("ref_id")).agg(F.max("version_id").alias("v"))
    plain = F.concat_ws("/", "ref_type", "ref_id")
    pinned = F.when(F.col("path").isin(*paths) & F.col("v").isNotNull(), F.concat(plain, F.lit("/_history/"), F.col("v").cast("string")))
    return refs.join(newest, KEY, "left").select("src_type", "src_id", "path", F.coalesce(pinned, plain).alias("reference"))


def cross_partition_refs(refs: DataFrame, partitions: DataFrame) -> DataFrame:
    """References between partitions. ``partitions``: resource_type, id, partition_id."""
    src = partitions.select(F.col("resource_type").alias("src_type"), F.col("id").alias("src_id"), F.col("partition_id").alias("src_partition"))
    dst = partitions.select(F.col("resource_type").alias("ref_type"), F.col("id").alias("ref_id"), F.col("partition_id").alias("ref_partition"))
    joined = refs.join(src, ["src_type", "src_id"]).join(dst, KEY)
    return joined.where("src_partition <> ref_partition").select("src_type", "src_id", *KEY, "src_partition", "ref_partition")
