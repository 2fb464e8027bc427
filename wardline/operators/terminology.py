"""Code systems, value sets, profiles and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.operators.joins import hinted


def expand_valuesets(compose: DataFrame, concepts: DataFrame, max_size: int = 1000, on_large: str = "error") -> DataFrame:
    """(url, system, code) from compose (url, system, code): a null code includes the whole system.

    A value set beyond ``max_size`` fails the job, or with ``on_large='cut'`` keeps its first codes in order.
    """
    listed = compose.where("code IS NOT NULL").select("url", "system", "code")
    whole = compose.where("code IS NULL").select("url", "system").distinct()
    members = listed.join(concepts.select("system", "code").distinct(), ["system", "code"], "left_semi").select("url", "system", "code")
    members = members.unionByName(whole.join(concepts.select("system", "code"), "system").select("url", "system", "code")).distinct()
    if on_large == "cut":
        order = Window.partitionBy("url").orderBy("system", "code")
        return members.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= max_size).drop("__n")
    large = members.groupBy("url").count().where(F.col("count") > max_size)
    told = F.raise_error(F.concat(F.lit("value set too large: "), F.col("url"))).cast("boolean")
    guard = large.select("url", told.alias("__stop"))
    return members.join(guard, "url", "left").where(F.coalesce("__stop", F.lit(True))).drop("__stop")


def in_valueset(df: DataFrame, members: DataFrame, url: str, system_col: str = "system", code_col: str = "code") -> DataFrame:
    """Rows whose (system, code) is in the expansion of ``url``."""
    side = members.where(F.col("url") == url).select(F.col("system").alias("__s"), F.col("code").alias("__c"))
    return df.join(side, (F.col(system_col) == F.col("__s")) & (F.col(code_col) == F.col("__c")), "left_semi")


def validate_codes(df: DataFrame, concepts: DataFrame, routes: list[str] | None = None) -> DataFrame:
    """Add result (null if the system is not routed here) and display.

    Systems compare without case. ``routes``: systems to answer for, ``*`` or None for all.
    """
    known = concepts.select(F.lower("system").alias("__s"), F.col("code").alias("__c"), "display").dropDuplicates(["__s", "__c"])
    joined = df.join(known, (F.lower(F.col("system")) == F.col("__s")) & (F.col("code") == F.col("__c")), "left")
    routed = F.lit(True) if routes is None or "*" in routes else F.lower(F.col("system")).isin(*[r.lower() for r in routes])
    return joined.withColumn("result", F.when(routed, F.col("__s").isNotNull())).withColumn("display", F.when(routed, F.col("display"))).drop("__s", "__c")


def profiles_by_type(definitions: DataFrame) -> DataFrame:
    """(type, urls): profile URLs of resource definitions (kind, type, url), in order."""
    return definitions.where("kind = 'resource'").groupBy("type").agg(F.array_sort(F.collect_set("url")).alias("urls"))


def profile_violations(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows (resource_type, id, profile) that declare none of the profiles allowed for their type; other types pass."""
    joined = df.join(hinted(profiles.select(F.col("type").alias("resource_type"), "urls")), "resource_type")
    declared = F.coalesce(F.col("profile"), F.array().cast("array<string>"))
    return joined.where(~F.coalesce(F.arrays_overlap(declared, "urls"), F.lit(False))).drop("urls")


def tag_usage(df: DataFrame) -> DataFrame:
    """(system, code, resources): tags of (id, tags) with the resources that carry them; a repeated tag counts once."""
    tags = df.select("id", F.explode("tags").alias("t"))
    return tags.groupBy(F.col("t.system").alias("system"), F.col("t.code").alias("code")).agg(F.countDistinct("id").alias("resources"))


def assign_patient_partition(df: DataFrame, n: int, patient_col: str = "patient_id") -> DataFrame:
    """Add partition_id: 1 to n by a hash of the patient, 0 without one."""
    hashed = (F.pmod(F.xxhash64(patient_col), F.lit(n)) + 1).cast("int")
    return df.withColumn("partition_id", F.when(F.col(patient_col).isNull(), 0).otherwise(hashed))


def assign_portable_partition(df: DataFrame, n: int, patient_col: str = "patient_id") -> DataFrame:
    """As ``assign_patient_partition``, by the first 32 bits of the id's md5, which other systems compute alike: a partition
    written elsewhere is found here. The partition of an id never depends on the table it is in."""
    hashed = (F.conv(F.substring(F.md5(F.col(patient_col).cast("string")), 1, 8), 16, 10).cast("long") % n + 1).cast("int")
    return df.withColumn("partition_id", F.when(F.col(patient_col).isNull(), 0).otherwise(hashed))


def partition_balance(placed: DataFrame, n: int, patient_col: str = "patient_id") -> DataFrame:
    """(partition_id, rows, patients, times_even) of each partition from 0 to n, empty ones too.

    ``times_even`` is the partition's patients over an even share of all, null for the default partition: what a hash
    should keep near 1. Rows may be uneven all the same, as a patient has any number of them.
    """
    per_patient = placed.groupBy("partition_id", patient_col).agg(F.count(F.lit(1)).alias("n"))
    used = per_patient.groupBy("partition_id").agg(F.sum("n").alias("rows"), F.count(patient_col).alias("patients"))
    every = placed.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("partition_id")).join(used, "partition_id", "left").fillna(0, ["rows", "patients"])
    held = F.broadcast(used.agg(F.sum("patients").alias("all")))  # one row
    share = F.when(F.col("partition_id") > 0, F.try_divide(F.col("patients").cast("double") * n, F.col("all")))
    return every.join(held).select("partition_id", "rows", "patients", share.alias("times_even"))


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("tenant", "partition_id"), mode: str = "overwrite") -> None:
    """A table with a folder for each tenant and patient partition: reads of one leave the files of others alone."""
    df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)


def for_tenant(df: DataFrame, tenant) -> DataFrame:
    """One tenant's rows; on a table partitioned by tenant no other files are read."""
    return df.where(F.col("tenant") == F.lit(tenant))
