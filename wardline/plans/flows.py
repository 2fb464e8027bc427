"""Queries of streams, files and registries over the driver tables: rows are written to the shared folder as they would
arrive there, and read back by the sources and streams of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators import vitals as V
from wardline.operators.hooks import HookRegistry, OperationRegistry
from wardline.plans.adapters import sql, tables
from wardline.plans.clinical import FLOW, SCORED, SQL, TOTALS, UPDATES, query
from wardline.plans.records import _subscribed
from wardline.sources import records as B
from wardline.sources import staging
from wardline.streaming import vitals as ST

# ---- streams

#: Rows of an arriving file, and files of a batch; a table has at least two batches.
ROWS_PER_FILE, FILES_PER_BATCH = 50_000, 4


def _arriving(df: DataFrame, name: str) -> str:
    """Folder of the rows of ``df`` in files of about ``ROWS_PER_FILE``."""
    path = staging.new_path(df.sparkSession, name)
    staging.write(df.repartition(max(2 * FILES_PER_BATCH, -(-df.count() // ROWS_PER_FILE))), path)
    return path


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations as a stream of files."""
    obs = tables(spark, sf_dir, "observation")[0].select("id", "seq", "subject", "issued", "effective", "code", "value")
    return ST.vitals_stream(spark, _arriving(obs, "arriving"), obs.schema, FILES_PER_BATCH * ROWS_PER_FILE, ROWS_PER_FILE)


def _drained(stream: DataFrame, name: str) -> DataFrame:
    """What an append stream gives for all that has arrived."""
    spark = stream.sparkSession
    path = staging.new_path(spark, name)
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", staging.new_path(spark, f"{name}-progress"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _flow(stream: DataFrame, patients: DataFrame, **options) -> tuple[str, DataFrame]:
    """Run the score flow over all that has arrived: its checkpoint, and what was sent downstream with its batch's number.

    A batch's rows replace what was sent under its number before, so a batch that is given again counts once.
    """
    spark = stream.sparkSession
    checkpoint, out = staging.new_path(spark, "flow"), staging.new_path(spark, "flow-sent")
    sink = lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    ST.run_news2_stream(stream, checkpoint, patients, sink, pause=None, **options).awaitTermination()
    sent = "patient_id string, old_total int, new_total int, block string, result string, batch long"
    return checkpoint, spark.read.schema(sent).parquet(out)


@query("stream_totals", SQL["patient_totals"])
def stream_totals(spark, sf_dir):
    """Totals from the state that the flow keeps after all observations came in batches."""
    checkpoint, _ = _flow(_observed(spark, sf_dir), tables(spark, sf_dir, "patient")[0])
    return V.patient_totals(ST.stored_aggregate(spark, checkpoint))


@query(
    "stream_newest_by_arrival",
    sql(f"WITH {SCORED} SELECT patient_id, code, news2_value, obs_instant FROM scored WHERE code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY patient_id, code ORDER BY seq DESC) = 1", "observation"),
)
def stream_newest_by_arrival(spark, sf_dir):
    """The last to come of each patient and code, late or not."""
    checkpoint, _ = _flow(_observed(spark, sf_dir), tables(spark, sf_dir, "patient")[0], mode="arrival")
    return ST.stored_aggregate(spark, checkpoint)


@query(
    "stream_changes",
    sql(
        f"WITH {SCORED}, newest AS (SELECT patient_id, code, news2_value FROM scored WHERE code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY patient_id, code ORDER BY obs_instant DESC, seq % 2, seq) = 1), {TOTALS}, {UPDATES} SELECT patient_id, old_total, new_total, block FROM updates WHERE result = 'changed' AND patient_id IN (SELECT patient_id FROM scored WHERE seq % 2 = 1 AND code IS NOT NULL)",
        "observation",
        "patient",
    ),
)
def stream_changes(spark, sf_dir):
    """Begins with the stored aggregate of every other observation, gets the rest, and tells patients whose total changed.

    What a patient was told last counts; batches tell each patient once, as all files come in one.
    """
    obs, patients = tables(spark, sf_dir, "observation", "patient")
    stored = staging.staged(V.latest_vitals(V.scored(obs.where("seq % 2 = 0"))), "flow-stored")
    came = obs.where("seq % 2 = 1").select("id", "seq", "subject", "issued", "effective", "code", "value")
    stream = spark.readStream.schema(came.schema).parquet(_arriving(came, "arriving"))
    _, sent = _flow(stream, patients, initial=stored)
    return sent.select("patient_id", "old_total", "new_total", "block")


@query("stream_events_once", "SELECT DISTINCT user_id AS tx, event_type AS id, event_id % 3 AS version FROM events WHERE event_id % 7 <> 0")
def stream_events_once(spark, sf_dir):
    """Writes of others, each transaction's version of a record once."""
    e = tables(spark, sf_dir, "events")[0].select(
        F.col("user_id").alias("tx"), F.col("event_type").alias("id"), (F.col("event_id") % 3).alias("version"),
        F.col("ts").cast("timestamp").alias("committed_at"), (F.col("event_id") % 7 == 0).alias("internal"),
    )
    stream = spark.readStream.schema(e.schema).parquet(_arriving(e, "arriving-events"))
    return _drained(ST.dedupe_events(ST.drop_internal(stream)).select("tx", "id", "version"), "events-once")


@query("stream_subscriptions", SQL["match_subscriptions"])
def stream_subscriptions(spark, sf_dir):
    events, subscriptions = _subscribed(spark, sf_dir)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(_arriving(events, "arriving-events"))
    return _drained(ST.subscription_stream(stream, subscriptions), "matches")


# ---- files


@query(
    "read_bundles",
    sql("SELECT 'transaction' AS bundle_type, 'Patient' AS resource_type, id, 'PUT' AS method, concat('Patient/', id) AS url, family, block FROM patient", "patient"),
)
def read_bundles(spark, sf_dir):
    """Every patient written into bundles of 500, one file each, and read again; bodies are variants."""
    p = tables(spark, sf_dir, "patient")[0].select("id", F.struct(F.lit("Patient").alias("resourceType"), "id", "family", "block").alias("body"))
    path = staging.new_path(spark, "bundles")
    bundles = B.to_put_bundles(p, "Patient", 500)
    bundles.select("bundle_no", F.col("bundle").alias("value")).write.partitionBy("bundle_no").text(path)
    read = B.read_bundles(spark, path, ["transaction"], typed=True)
    member = lambda name: B.text_of(F.col("body"), f"$.{name}").alias(name)
    return read.select("bundle_type", "resource_type", "id", "method", "url", member("family"), member("block"))


_LINE = "CASE WHEN seq % 10 = 3 THEN concat('{\"resourceType\":\"Patient\",\"id\":\"', id) ELSE concat('{\"resourceType\":\"', CASE WHEN seq % 4 = 0 THEN 'Person' ELSE 'Patient' END, '\",\"id\":\"', id, '\",\"family\":\"', family, '\"}') END"


@query(
    "read_ndjson",
    sql(
        f"SELECT CASE WHEN seq % 10 = 3 THEN NULL WHEN seq % 4 = 0 THEN 'Person' ELSE 'Patient' END AS resource_type, CASE WHEN seq % 10 <> 3 THEN id END AS id, CASE WHEN seq % 10 <> 3 THEN family END AS family, CASE WHEN seq % 10 = 3 THEN {_LINE} END AS broken FROM patient",
        "patient",
    ),
)
def read_ndjson(spark, sf_dir):
    """Every patient as a line, one in ten cut off: resources of each type, and the lines that don't parse."""
    path = staging.new_path(spark, "lines")
    tables(spark, sf_dir, "patient")[0].select(F.expr(_LINE).alias("value")).write.text(path)
    good, bad = B.read_ndjson(spark, path, "resourceType string, id string, family string")
    split = B.split_types(good.withColumnRenamed("resourceType", "resource_type"), ["Patient", "Person"])
    rows = split["Patient"].unionByName(split["Person"]).select("resource_type", "id", "family", F.lit(None).cast("string").alias("broken"))
    return rows.unionByName(bad.select(*[F.lit(None).cast("string").alias(c) for c in ("resource_type", "id", "family")], F.col("value").alias("broken")))


# ---- what users register


@query("apply_hooks", sql("SELECT id, concat(family, CASE WHEN seq % 2 = 0 THEN '+seen' ELSE '' END, '+kept') AS family FROM patient", "patient"))
def apply_hooks(spark, sf_dir):
    """Two hooks on a created patient, in the order in which they were registered; another type's hook doesn't run."""
    hooks = HookRegistry()
    appended = lambda text: F.concat("family", F.lit(text))
    hooks.on_create("Patient")(lambda df: df.withColumn("family", F.when(F.col("seq") % 2 == 0, appended("+seen")).otherwise(F.col("family"))))
    hooks.on_create("Patient")(lambda df: df.withColumn("family", appended("+kept")))
    hooks.on_create("Practitioner")(lambda df: df.where("false"))
    return hooks.apply(tables(spark, sf_dir, "patient")[0], "Patient", "create").select("id", "family")


@query("call_operation", sql(f"{FLOW} SELECT p.id, COALESCE(total, 0) AS total FROM patient p LEFT JOIN totals ON p.id = patient_id WHERE COALESCE(total, 0) >= 5", "observation", "patient"))
def call_operation(spark, sf_dir):
    """An operation registered by a user and called by its name with two tables."""
    known = OperationRegistry()

    def at_risk(observations: DataFrame, patients: DataFrame) -> DataFrame:
        totals = V.patient_totals(V.latest_vitals(V.scored(observations)), patients)
        return totals.where("total >= 5").select(F.col("patient_id").alias("id"), "total")

    known.register("at-risk", at_risk)
    observations, patients = tables(spark, sf_dir, "observation", "patient")
    return known.call("at-risk", observations=observations, patients=patients)
