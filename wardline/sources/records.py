"""Bundles, line-delimited resources, exports and relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: A bundle; resources stay JSON text.
BUNDLE = "resourceType string, id string, type string, entry array<struct<fullUrl: string, resource: string, request: struct<method: string, url: string>>>"

TYPED_BUNDLE = BUNDLE.replace("resource: string", "resource: variant")


def text_of(body: Column, path: str) -> Column:
    """The string at a path of a variant, null where there is none or something else."""
    return F.try_variant_get(body, path, "string")


def members_of(body: Column, path: str) -> Column:
    """The array at a path of a variant, null where there is none."""
    return F.try_variant_get(body, path, "array<variant>")


def polymorphic(body: Column, name: str) -> Column:
    """A member that is named after its type, as valueQuantity or valueString: struct (kind, value), the kind as written
    after the name and the value as a variant. Kinds that nobody has heard of are kept like any other; of several the
    first by name counts; null if there is none."""
    found = F.map_entries(F.map_filter(F.try_variant_get(body, "$", "map<string,variant>"), lambda k, _: k.rlike(f"^{name}[A-Z]")))
    first = F.array_min(F.transform(found, lambda e: e["key"]))
    value = F.get(F.filter(found, lambda e: e["key"] == first), F.lit(0))["value"]
    return F.when(first.isNotNull(), F.struct(F.substring(first, len(name) + 1, 1000).alias("kind"), value.alias("value")))


def read_bundles(spark: SparkSession, path: str, allowed_types: list[str] | None = None, typed: bool = False) -> DataFrame:
    """One row per entry: source (file), bundle_id, bundle_type, seq, resource_type, id, method, url, body (JSON text, or
    a variant if ``typed``).

    Type and id come from the resource, or where it has none (as in a DELETE) from the request's URL. Only
    bundles of the allowed types are kept; None allows all. Files that are no bundle give no rows. Typed bodies are
    parsed once, by the reader, and every later path is a lookup.
    """
    read = spark.read.schema(TYPED_BUNDLE if typed else BUNDLE).option("multiLine", True).json(path)
    bundles = read.select("*", F.col("_metadata.file_path").alias("source")).where("resourceType = 'Bundle'")
    if allowed_types is not None:
        bundles = bundles.where(F.col("type").isin(*allowed_types))
    entries = bundles.select("source", F.col("id").alias("bundle_id"), F.col("type").alias("bundle_type"), F.posexplode("entry").alias("seq", "e"))
    body = F.col("e.resource")
    member = text_of if typed else F.get_json_object
    asked = F.regexp_replace(F.col("e.request.url"), r"(/_history/[^/?]*)?(\?.*)?$", "")
    part = lambda k: F.nullif(F.regexp_extract(asked, r"(?:^|/)([A-Z][A-Za-z]+)(?:/([A-Za-z0-9.\-]{1,64}))?$", k), F.lit(""))
    return entries.select(
        "source",
        "bundle_id",
        "bundle_type",
        "seq",
        F.coalesce(member(body, "$.resourceType"), part(1)).alias("resource_type"),
        F.coalesce(member(body, "$.id"), part(2)).alias("id"),
        F.col("e.request.method").alias("method"),
        F.col("e.request.url").alias("url"),
        body.alias("body"),
    )


def read_resources(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(resources, lines that are no JSON object) of line-delimited JSON of any types: resource_type, id, body (variant).

    Nothing need be known of the types beforehand and nothing of a resource is lost: each line is parsed once to a variant.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.try_parse_json("value").alias("body"))
    good = F.try_variant_get("body", "$", "map<string,variant>").isNotNull()
    rows = parsed.where(good).select(text_of(F.col("body"), "$.resourceType").alias("resource_type"), text_of(F.col("body"), "$.id").alias("id"), "body")
    return rows, parsed.where(~good).select("value")


def read_ndjson(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(good rows, lines that don't parse) of line-delimited JSON."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", kind.add("_corrupt_record", "string"), {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    good = parsed.where("r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record")
    return good, parsed.where("r._corrupt_record IS NOT NULL").select("value")


def split_types(df: DataFrame, types: list[str]) -> dict[str, DataFrame]:
    """One DataFrame per resource type of (resource_type, body)."""
    return {t: df.where(F.col("resource_type") == t) for t in types}


def export_rows(df: DataFrame, types: list[str] | None = None, since=None) -> DataFrame:
    """Rows of a bulk export: chosen types, changed at or after ``since``."""
    if types is not None:
        df = df.where(F.col("resource_type").isin(*types))
    return df if since is None else df.where(F.col("last_updated") >= F.lit(since))


def bulk_export(df: DataFrame, out: str, types: list[str] | None = None, since=None) -> None:
    """Write one set of line-delimited JSON files per resource type."""
    export_rows(df, types, since).write.partitionBy("resource_type").json(out)


def to_put_bundles(df: DataFrame, resource_type: str, size: int, id_col: str = "id", body_col: str = "body") -> DataFrame:
    """Transaction bundles (bundle_no, n, bundle) of at most ``size`` PUT entries each.

    A row with an id is put at Type/id, one without at the type. Rows are dealt by their hash to buckets of some
    hundred bundles and numbered there by id and body, so a retry makes the same bundles; the last bundle of a
    bucket may be smaller.
    """
    url = F.when(F.col(id_col).isNull(), F.lit(resource_type)).otherwise(F.concat(F.lit(f"{resource_type}/"), F.col(id_col)))
    entry = F.struct(F.col(body_col).alias("resource"), F.struct(F.lit("PUT").alias("method"), url.alias("url")).alias("request"))
    buckets = max(1, df.count() // (size * 500))
    dealt = df.select(entry.alias("e"), F.col(id_col).alias("id"), F.col(body_col).alias("body"))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("id", "body"), F.lit(buckets)))
    n = F.row_number().over(Window.partitionBy("bucket").orderBy("id", "body"))
    rows = dealt.withColumn("n", n).withColumn("bundle_no", F.shiftleft("bucket", 32) + F.floor((F.col("n") - 1) / size))
    groups = rows.groupBy("bundle_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "e"))), lambda x: x["e"]).alias("entry"))
    bundle = F.struct(F.lit("Bundle").alias("resourceType"), F.lit("transaction").alias("type"), F.col("entry"))
    return groups.select("bundle_no", F.size("entry").alias("n"), F.to_json(bundle).alias("bundle"))


def read_table(spark: SparkSession, url: str, table: str, partition_column: str, bounds: tuple[int, int, int], fetch_size: int = 10_000, **options) -> DataFrame:
    """A relational table in (lower, upper, partitions) strides of a numeric column."""
    lower, upper, parts = bounds
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=fetch_size, **options)
    return reader.options(partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=parts).load()


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", batch_size: int = 100, **options) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch_size, **options).mode(mode).save()


def explode_contained(df: DataFrame, body: str = "body") -> DataFrame:
    """(parent_type, parent_id, seq, resource_type, id, body) of contained resources and of contained bundles' entries.

    ``body`` is JSON text, which is parsed once, or a variant; what is given out is the same.
    """
    typed = df.schema[body].dataType.typeName() == "variant"
    value = F.col(body) if typed else F.parse_json(body)
    parents = df.select(value.alias("v")).select(text_of(F.col("v"), "$.resourceType").alias("parent_type"), text_of(F.col("v"), "$.id").alias("parent_id"), F.explode(members_of(F.col("v"), "$.contained")).alias("c"))
    nested = F.transform(members_of(F.col("c"), "$.entry"), lambda e: F.try_variant_get(e, "$.resource", "variant"))
    flat = parents.select("parent_type", "parent_id", F.posexplode(F.concat(F.array("c"), F.coalesce(nested, F.array().cast("array<variant>")))).alias("seq", "v"))
    return flat.select(
        "parent_type",
        "parent_id",
        "seq",
        text_of(F.col("v"), "$.resourceType").alias("resource_type"),
        text_of(F.col("v"), "$.id").alias("id"),
        (F.col("v") if typed else F.to_json("v")).alias("body"),
    )
