"""Queries of the score flow, searches, writes and history over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import scoring as S
from wardline.operators import history as H
from wardline.operators import search as Q
from wardline.operators import vitals as V
from wardline.plans.adapters import sql, tables
from wardline.sources.records import export_rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with the SQL that gives the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return add


# ---- SQL pieces of the oracle: the band table written as plain comparisons (fixed values, as in functions.scoring)

SCORE = """CASE code
 WHEN '9279-1' THEN CASE WHEN value <= 8 THEN 3 WHEN value >= 9 AND value <= 11 THEN 1 WHEN value >= 21 AND value <= 24 THEN 2 WHEN value >= 25 THEN 3 ELSE 0 END
 WHEN '59408-5' THEN CASE WHEN value <= 91 THEN 3 WHEN value >= 92 AND value <= 93 THEN 2 WHEN value >= 94 AND value <= 95 THEN 1 ELSE 0 END
 WHEN '8867-4' THEN CASE WHEN value <= 40 THEN 3 WHEN value >= 41 AND value <= 50 THEN 1 WHEN value >= 91 AND value <= 110 THEN 1 WHEN value >= 111 AND value <= 130 THEN 2 WHEN value >= 131 THEN 3 ELSE 0 END
 WHEN '8480-6' THEN CASE WHEN value <= 90 THEN 3 WHEN value >= 91 AND value <= 100 THEN 2 WHEN value >= 101 AND value <= 110 THEN 1 WHEN value >= 220 THEN 3 ELSE 0 END
 WHEN '8310-5' THEN CASE WHEN value <= 35 THEN 3 WHEN value >= 35.1 AND value <= 36 THEN 1 WHEN value > 38.1 AND value <= 39 THEN 1 WHEN value > 39.1 THEN 2 ELSE 0 END
 ELSE 0 END"""
SCORED = f"scored AS (SELECT substr(subject, 9) AS patient_id, code, CAST({SCORE} AS INT) AS news2_value, COALESCE(issued, effective, TIMESTAMP '1970-01-01 00:00:00') AS obs_instant, seq FROM observation WHERE subject LIKE 'Patient/%')"


def newest(name: str, where: str = "TRUE") -> str:
    return f"{name} AS (SELECT patient_id, code, news2_value, obs_instant FROM scored WHERE {where} QUALIFY row_number() OVER (PARTITION BY patient_id, code ORDER BY obs_instant DESC, seq) = 1)"


TOTALS = "totals AS (SELECT patient_id, CAST(SUM(news2_value) AS INT) AS total FROM newest GROUP BY patient_id)"
FLOW = f"WITH {SCORED}, {newest('newest')}, {TOTALS}"


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.latest_vitals(V.scored(tables(spark, sf_dir, "observation")[0]))


@query("patient_totals", sql(f"{FLOW} SELECT patient_id, total FROM totals", "observation"))
def patient_totals(spark, sf_dir):
    return V.patient_totals(_newest(spark, sf_dir))


@query(
    "patient_totals_all",
    sql(f"{FLOW} SELECT p.id AS patient_id, COALESCE(total, 0) AS total FROM patient p LEFT JOIN totals ON p.id = patient_id", "observation", "patient"),
)
def patient_totals_all(spark, sf_dir):
    return V.patient_totals(_newest(spark, sf_dir), tables(spark, sf_dir, "patient")[0])


@query("news2_score", sql(f"SELECT id, code, value, CAST({SCORE} AS INT) AS score FROM observation", "observation"))
def news2_score(spark, sf_dir):
    obs = tables(spark, sf_dir, "observation")[0]
    return obs.select("id", "code", "value", S.news2_score(F.col("code"), F.col("value")).alias("score"))


@query(
    "patient_id",
    sql("SELECT id, CASE WHEN ref LIKE 'Patient/%' THEN substr(ref, 9) END AS patient_id FROM (SELECT id, CASE WHEN seq % 4 = 0 THEN concat('Group/', user_id) ELSE subject END AS ref FROM observation)", "observation"),
)
def patient_id(spark, sf_dir):
    obs = tables(spark, sf_dir, "observation")[0]
    ref = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("Group/"), F.col("user_id").cast("string"))).otherwise(F.col("subject"))
    return obs.select("id", S.patient_id(ref).alias("patient_id"))


@query("observed_at", sql("SELECT id, COALESCE(issued, effective, TIMESTAMP '1970-01-01 00:00:00') AS at FROM observation", "observation"))
def observed_at(spark, sf_dir):
    obs = tables(spark, sf_dir, "observation")[0]
    return obs.select("id", S.observed_at(F.col("issued"), F.col("effective")).alias("at"))


@query(
    "extract_score",
    sql("SELECT id, CAST(CASE WHEN seq % 3 = 0 THEN seq % 5 WHEN seq % 3 = 1 AND seq % 2 = 0 THEN seq % 9 WHEN seq % 7 = 0 THEN 0 ELSE trunc(value) END AS INT) AS score FROM observation", "observation"),
)
def extract_score(spark, sf_dir):
    obs = tables(spark, sf_dir, "observation")[0]
    url = F.when(F.col("seq") % 3 == 0, S.SCORE_URL).otherwise("other")
    ext = F.array(F.struct(url.alias("url"), (F.col("seq") % 5).cast("int").alias("valueInteger")))
    integer = F.when((F.col("seq") % 3 == 1) & (F.col("seq") % 2 == 0), (F.col("seq") % 9).cast("int"))
    quantity = F.when(F.col("seq") % 7 != 0, F.col("value"))
    return obs.select("id", S.extract_score(ext, integer, quantity).alias("score"))


@query("with_block", sql("SELECT id, COALESCE(block, 'North') AS block FROM patient", "patient"))
def with_block(spark, sf_dir):
    return V.with_block(tables(spark, sf_dir, "patient")[0]).select("id", "block")


@query("latest_vitals", sql(f"{FLOW} SELECT * FROM newest", "observation"))
def latest_vitals(spark, sf_dir):
    return _newest(spark, sf_dir)


def _halves(spark, sf_dir, mode):
    obs = tables(spark, sf_dir, "observation")[0]
    old, new = (V.latest_vitals(V.scored(obs.where(F.col("seq") % 2 == k))) for k in (0, 1))
    return V.merge_latest(old, new, mode)


@query(
    "merge_latest_arrival",
    sql(f"WITH {SCORED}, {newest('a', 'seq % 2 = 0')}, {newest('b', 'seq % 2 = 1')} SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.patient_id = a.patient_id AND b.code = a.code)", "observation"),
)
def merge_latest_arrival(spark, sf_dir):
    return _halves(spark, sf_dir, "arrival")


@query(
    "merge_latest_event_time",
    sql(
        f"WITH {SCORED}, {newest('a', 'seq % 2 = 0')}, {newest('b', 'seq % 2 = 1')} SELECT patient_id, code, news2_value, obs_instant FROM (SELECT *, 0 AS late FROM a UNION ALL SELECT *, 1 FROM b) QUALIFY row_number() OVER (PARTITION BY patient_id, code ORDER BY obs_instant DESC, late) = 1",
        "observation",
    ),
)
def merge_latest_event_time(spark, sf_dir):
    return _halves(spark, sf_dir, "event_time")


UPDATES = "updates AS (SELECT patient_id, stored_total AS old_total, total AS new_total, COALESCE(block, 'North') AS block, CASE WHEN stored_total IS NOT DISTINCT FROM total AND block IS NOT NULL THEN 'unchanged' ELSE 'changed' END AS result FROM totals JOIN patient p ON p.id = patient_id)"


def _updates(spark, sf_dir):
    return V.patient_updates(V.patient_totals(_newest(spark, sf_dir)), tables(spark, sf_dir, "patient")[0])


@query("patient_updates", sql(f"{FLOW}, {UPDATES} SELECT * FROM updates", "observation", "patient"))
def patient_updates(spark, sf_dir):
    return _updates(spark, sf_dir)


@query("update_outcomes", sql(f"{FLOW}, {UPDATES} SELECT result, COUNT(*) AS patients FROM updates GROUP BY result", "observation", "patient"))
def update_outcomes(spark, sf_dir):
    return V.update_outcomes(_updates(spark, sf_dir))


@query(
    "orphan_totals",
    sql(f"{FLOW} SELECT patient_id, total FROM totals WHERE patient_id NOT IN (SELECT id FROM patient WHERE seq % 3 <> 0)", "observation", "patient"),
)
def orphan_totals(spark, sf_dir):
    some = tables(spark, sf_dir, "patient")[0].where("seq % 3 <> 0")
    return V.orphan_totals(V.patient_totals(_newest(spark, sf_dir)), some)


ROLLUP = "SELECT COALESCE(block, 'North') AS block, CAST(SUM(total) AS BIGINT) AS total_score, COUNT(*) AS patient_count, CAST(SUM(total) AS DOUBLE) / COUNT(*) AS average FROM totals JOIN patient p ON p.id = patient_id GROUP BY 1"


def _rollup(spark, sf_dir):
    blocks = V.with_block(tables(spark, sf_dir, "patient")[0]).withColumn("patient_id", F.col("id"))
    return V.block_rollup(V.patient_totals(_newest(spark, sf_dir)), blocks)


@query("block_rollup", sql(f"{FLOW} {ROLLUP}", "observation", "patient"))
def block_rollup(spark, sf_dir):
    return _rollup(spark, sf_dir)


MOVES = """old AS (SELECT id AS patient_id, COALESCE(block, 'North') AS block, seq % 12 AS score FROM patient WHERE seq % 10 <> 3),
new AS (SELECT id AS patient_id, CASE WHEN seq % 4 = 0 THEN 'South' ELSE COALESCE(block, 'North') END AS block, seq % 9 AS score FROM patient WHERE seq % 10 <> 5),
deltas AS (SELECT block, CAST(SUM(score) AS BIGINT) AS d_score, CAST(SUM(n) AS BIGINT) AS d_count FROM (
  SELECT o.block, -o.score AS score, -1 AS n FROM old o LEFT JOIN new w USING (patient_id) WHERE (o.block, o.score) IS DISTINCT FROM (w.block, w.score)
  UNION ALL SELECT w.block, w.score, 1 FROM new w LEFT JOIN old o USING (patient_id) WHERE (o.block, o.score) IS DISTINCT FROM (w.block, w.score)) GROUP BY block)"""


def _moves(spark, sf_dir):
    p = V.with_block(tables(spark, sf_dir, "patient")[0]).withColumn("patient_id", F.col("id"))
    old = p.where("seq % 10 <> 3").select("patient_id", "block", (F.col("seq") % 12).alias("score"))
    south = F.when(F.col("seq") % 4 == 0, "South").otherwise(F.col("block")).alias("block")
    return old, p.where("seq % 10 <> 5").select("patient_id", south, (F.col("seq") % 9).alias("score"))


@query("block_deltas", sql(f"WITH {MOVES} SELECT * FROM deltas", "patient"))
def block_deltas(spark, sf_dir):
    return V.block_deltas(*_moves(spark, sf_dir))


@query(
    "apply_block_deltas",
    sql(
        f"WITH {MOVES}, agg AS (SELECT block, SUM(score) AS s, COUNT(*) AS n FROM old GROUP BY block), out AS (SELECT block, CAST(GREATEST(0, COALESCE(s, 0) + COALESCE(d_score, 0)) AS BIGINT) AS total_score, CAST(GREATEST(0, COALESCE(n, 0) + COALESCE(d_count, 0)) AS BIGINT) AS patient_count FROM agg FULL JOIN deltas USING (block)) SELECT *, CASE WHEN patient_count = 0 THEN 0.0 ELSE CAST(total_score AS DOUBLE) / patient_count END AS average FROM out",
        "patient",
    ),
)
def apply_block_deltas(spark, sf_dir):
    old, new = _moves(spark, sf_dir)
    agg = V.block_rollup(old.withColumnRenamed("score", "total"), old)
    return V.apply_block_deltas(agg, V.block_deltas(old, new))


@query(
    "block_details",
    sql(f"{FLOW}, rolled AS ({ROLLUP}) SELECT b.block, COALESCE(average, 0.0) AS average, COALESCE(patient_count, 0) AS patient_count FROM (SELECT DISTINCT concat(c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '?' END) AS block FROM customer) b LEFT JOIN rolled USING (block)", "observation", "patient"),
)
def block_details(spark, sf_dir):
    c = tables(spark, sf_dir, "customer")[0]
    asked = c.select(F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "").otherwise("?")).alias("block")).distinct()
    return V.block_details(_rollup(spark, sf_dir), asked)


@query("affected_patients", sql("SELECT DISTINCT substr(subject, 9) AS patient_id FROM observation", "observation"))
def affected_patients(spark, sf_dir):
    obs = tables(spark, sf_dir, "observation")[0]
    return V.affected_patients(obs.where("seq % 2 = 0"), obs.where("seq % 2 = 1"))


# ---- search


def _coded(spark, sf_dir):
    obs = tables(spark, sf_dir, "observation")[0]
    second = F.struct(F.lit("urn:local").alias("system"), F.col("event_type").alias("code"))
    return obs.withColumn("coding", F.array(F.struct(F.lit(S.LOINC).alias("system"), F.col("code").alias("code")), second))


@query("where_token", sql("SELECT id FROM observation WHERE code IN ('8867-4', '8310-5') OR event_type = 'error'", "observation"))
def where_token(spark, sf_dir):
    return Q.where_token(_coded(spark, sf_dir), "coding", [f"{S.LOINC}|8867-4", "8310-5", "urn:local|error", "urn:local|8480-6"]).select("id")


@query("where_reference", sql("SELECT id FROM observation WHERE user_id IN (3, 17, 60)", "observation"))
def where_reference(spark, sf_dir):
    return Q.where_reference(tables(spark, sf_dir, "observation")[0], "subject", ["3", "Patient/17", "60"]).select("id")


_DATES = {"ge": "ge1996-03", "gt": "gt1997", "le": "le1995-06-15", "lt": "lt1994-02", "eq": "eq1996-02", "ne": "ne1997"}


@query(
    "where_date",
    sql(
        """SELECT 'ge' AS test, id FROM encounter WHERE period_start >= DATE '1996-03-01' UNION ALL
SELECT 'gt', id FROM encounter WHERE period_start >= DATE '1998-01-01' UNION ALL SELECT 'le', id FROM encounter WHERE period_start <= DATE '1995-06-15' UNION ALL
SELECT 'lt', id FROM encounter WHERE period_start < DATE '1994-02-01' UNION ALL SELECT 'eq', id FROM encounter WHERE period_start BETWEEN DATE '1996-02-01' AND DATE '1996-02-29' UNION ALL
SELECT 'ne', id FROM encounter WHERE year(period_start) <> 1997""",
        "encounter",
    ),
)
def where_date(spark, sf_dir):
    e = tables(spark, sf_dir, "encounter")[0]
    tests = F.array_compact(F.array(*[F.when(Q.date_predicate("period_start", x), t) for t, x in _DATES.items()]))
    return e.select(F.explode(tests).alias("test"), "id")


_MOMENTS = {"ge": "ge2024-01-10T06:30", "sa": "sa2024-01-20T12:00:05", "eb": "eb2024-01-02T08:00", "eq": "2024-01-15T10:00", "zone": "lt2024-01-02T02:30:00+02:00", "ne": "ne2024-01"}


@query(
    "where_date_time",
    sql(
        """SELECT 'ge' AS test, id FROM observation WHERE ts >= TIMESTAMP '2024-01-10 06:30:00' UNION ALL
SELECT 'sa', id FROM observation WHERE ts >= TIMESTAMP '2024-01-20 12:00:06' UNION ALL SELECT 'eb', id FROM observation WHERE ts < TIMESTAMP '2024-01-02 08:00:00' UNION ALL
SELECT 'eq', id FROM observation WHERE ts >= TIMESTAMP '2024-01-15 10:00:00' AND ts < TIMESTAMP '2024-01-15 10:01:00' UNION ALL
SELECT 'zone', id FROM observation WHERE ts < TIMESTAMP '2024-01-02 00:30:00' UNION ALL SELECT 'ne', id FROM observation WHERE NOT (ts >= DATE '2024-01-01' AND ts < DATE '2024-02-01')""",
        "observation",
    ),
)
def where_date_time(spark, sf_dir):
    o = tables(spark, sf_dir, "observation")[0]
    tests = F.array_compact(F.array(*[F.when(Q.date_predicate("ts", x), t) for t, x in _MOMENTS.items()]))
    return o.select(F.explode(tests).alias("test"), "id")


@query("where_string", sql("SELECT id, given, family FROM patient WHERE lower(family) LIKE 'sch%' OR lower(given) LIKE '%ann%'", "patient"))
def where_string(spark, sf_dir):
    p = tables(spark, sf_dir, "patient")[0]
    found = Q.where_string(p, "family", "SCH").unionByName(Q.where_string(p, "given", "Ann", contains=True)).distinct()
    return found.select("id", "given", "family")


@query("where_missing", sql("SELECT id, TRUE AS missing FROM patient WHERE block IS NULL UNION ALL SELECT id, FALSE FROM patient WHERE block IS NOT NULL AND stored_total IS NULL", "patient"))
def where_missing(spark, sf_dir):
    p = tables(spark, sf_dir, "patient")[0]
    some = Q.where_missing(Q.where_missing(p, "block", False), "stored_total", True)
    return Q.where_missing(p, "block", True).select("id", F.lit(True).alias("missing")).unionByName(some.select("id", F.lit(False).alias("missing")))


@query("where_language", "SELECT doc_id, source FROM documents WHERE lang = 'de'")
def where_language(spark, sf_dir):
    return Q.where_language(tables(spark, sf_dir, "documents")[0], "de").select("doc_id", "source")


def _measured(spark, sf_dir):
    unit = F.when(F.col("seq") % 3 == 0, "other").when(F.col("seq") % 2 == 0, "mm").otherwise("cm")
    return tables(spark, sf_dir, "observation")[0].withColumn("unit", unit)


def _units(spark):
    rows = spark.createDataFrame([("mm", "mm", "1"), ("cm", "mm", "10")], "unit string, base string, f string")
    return rows.select("unit", "base", F.col("f").cast("decimal(9,3)").alias("factor"))


@query(
    "where_quantity",
    sql("SELECT id FROM (SELECT id, code, CASE WHEN seq % 2 = 0 THEN value ELSE value * 10 END AS v FROM observation WHERE seq % 3 <> 0) WHERE v >= 400", "observation"),
)
def where_quantity(spark, sf_dir):
    return Q.where_quantity(_measured(spark, sf_dir), "ge", "40", "cm", _units(spark)).select("id")


@query("where_content", "SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'the') AND list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'from')")
def where_content(spark, sf_dir):
    return Q.where_content(tables(spark, sf_dir, "documents")[0], "text", ["The", "from"]).select("doc_id")


_PARAMS = [("reference", "subject", ["7", "8", "9", "10", "11"]), ("token", "code", ["8867-4", "9279-1"]), ("date", "ts", "ge2024-01"), ("missing", "issued", False)]
_WHERE = "user_id BETWEEN 7 AND 11 AND code IN ('8867-4', '9279-1') AND ts >= DATE '2024-01-01' AND issued IS NOT NULL"


@query("search", sql(f"SELECT id, subject, code, ts FROM observation WHERE {_WHERE}", "observation"))
def search(spark, sf_dir):
    return Q.search(tables(spark, sf_dir, "observation")[0], _PARAMS).select("id", "subject", "code", "ts")


@query(
    "search_all_kinds",
    sql(
        "SELECT id, code, value FROM observation WHERE seq % 3 <> 0 AND (CASE WHEN seq % 2 = 0 THEN value ELSE value * 10 END) >= 400 AND code IN ('8867-4', '8480-6') AND seq % 4 = 1 AND list_contains(string_split_regex(lower(concat(event_type, ' by ', subject)), '[^a-z0-9]+'), 'patient') ORDER BY code DESC, id",
        "observation",
    ),
)
def search_all_kinds(spark, sf_dir):
    obs = _measured(spark, sf_dir)
    typed = F.struct(F.struct(F.array(F.struct(F.lit("v2").alias("system"), F.when(F.col("seq") % 4 == 1, "MR").otherwise("SS").alias("code"))).alias("coding")).alias("type"), F.lit("7").alias("value"))
    obs = obs.withColumns({"identifier": F.array(typed), "note": F.concat("event_type", F.lit(" by "), "subject")})
    params = [
        ("quantity", "value", "ge", "40", "cm", _units(spark)),
        ("identifier_of_type", "identifier", "v2", "MR", "7"),
        ("content", "note", ["Patient"]),
        ("token", "code", [*(f"none-{k}" for k in range(300)), "8867-4", "8480-6"]),
    ]
    return Q.search(obs, params, "-code").select("id", "code", "value")


@query("search_total", sql(f"SELECT COUNT(*) AS total FROM observation WHERE {_WHERE}", "observation"))
def search_total(spark, sf_dir):
    return Q.search_total(tables(spark, sf_dir, "observation")[0], _PARAMS)


@query("search_sorted_page", sql(f"SELECT id, ts FROM observation WHERE {_WHERE} ORDER BY ts DESC, id LIMIT 20 OFFSET 20", "observation"))
def search_sorted_page(spark, sf_dir):
    found = Q.search(tables(spark, sf_dir, "observation")[0], _PARAMS)
    return Q.page(found, ["-ts", "id"], 1).select("id", "ts")


@query("page_after", sql("SELECT seq, id FROM observation WHERE seq > 137 ORDER BY seq LIMIT 20", "observation"))
def page_after(spark, sf_dir):
    return Q.page_after(tables(spark, sf_dir, "observation")[0], "seq", 137).select("seq", "id")


@query("page_after_sorted", sql("SELECT id, ts FROM observation WHERE ts < TIMESTAMP '2024-01-15 00:00:00' OR (ts = TIMESTAMP '2024-01-15 00:00:00' AND id > '0') ORDER BY ts DESC, id LIMIT 20", "observation"))
def page_after_sorted(spark, sf_dir):
    last = (F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), "0")
    return Q.page_after(tables(spark, sf_dir, "observation")[0], ["-ts", "id"], last).select("id", "ts")


def _resources(spark, sf_dir):
    o, e, m, p = tables(spark, sf_dir, "observation", "encounter", "medication_request", "patient")
    one = lambda df, t: df.select(F.lit(t).alias("resource_type"), "id")
    return one(o, "Observation").unionByName(one(e, "Encounter")).unionByName(one(m, "MedicationRequest")).unionByName(one(p, "Patient"))


_RESOURCES = "resources AS (SELECT 'Observation' AS resource_type, id FROM observation UNION ALL SELECT 'Encounter', id FROM encounter UNION ALL SELECT 'MedicationRequest', id FROM medication_request UNION ALL SELECT 'Patient', id FROM patient)"
_FOUR = ("observation", "encounter", "medication_request", "patient")


@query("resource_counts", sql(f"WITH {_RESOURCES} SELECT resource_type, COUNT(*) AS n FROM resources GROUP BY resource_type", *_FOUR))
def resource_counts(spark, sf_dir):
    return Q.resource_counts(_resources(spark, sf_dir))


@query("supported_types", sql(f"WITH {_RESOURCES} SELECT resource_type, id FROM resources WHERE resource_type IN ('Patient', 'Encounter')", *_FOUR))
def supported_types(spark, sf_dir):
    return Q.supported_types(_resources(spark, sf_dir), ["Patient", "Encounter"])


@query(
    "include",
    sql(
        "WITH m AS (SELECT * FROM medication_request WHERE status = 'active' AND category = 'community') SELECT id, 'match' AS mode, CAST(NULL AS STRING) AS included_type FROM m UNION ALL SELECT id, 'include', 'Medication' FROM medication WHERE id IN (SELECT medication_id FROM m)",
        "medication_request",
        "medication",
    ),
)
def include(spark, sf_dir):
    m, med = tables(spark, sf_dir, "medication_request", "medication")
    return Q.include(m.where("status = 'active' AND category = 'community'"), "medication", med, "Medication")


@query("where_chain", sql("SELECT e.id FROM encounter e JOIN patient p ON p.id = e.patient_id WHERE p.family = 'Weber'", "encounter", "patient"))
def where_chain(spark, sf_dir):
    e, p = tables(spark, sf_dir, "encounter", "patient")
    return Q.where_chain(e, "subject", p, F.col("family") == "Weber").select("id")


@query("where_in_codes", sql("SELECT id, code FROM condition WHERE code IN (SELECT DISTINCT CAST(p_size AS STRING) FROM part WHERE p_size % 3 = 0)", "condition"))
def where_in_codes(spark, sf_dir):
    c, part = tables(spark, sf_dir, "condition", "part")
    codes = part.where("p_size % 3 = 0").select(F.col("p_size").cast("string").alias("code"))
    return Q.where_in_codes(c, "code", codes).select("id", "code")


@query(
    "normalise_refs",
    sql("SELECT id, CASE WHEN seq % 3 = 0 THEN TRUE ELSE FALSE END AS is_logical, CASE seq % 3 WHEN 0 THEN concat('http://loinc.org/', code) ELSE subject END AS reference FROM observation", "observation"),
)
def normalise_refs(spark, sf_dir):
    obs = tables(spark, sf_dir, "observation")[0]
    ref = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("http://loinc.org/"), "code")).when(F.col("seq") % 3 == 1, F.concat(F.lit("http://localhost/base/"), "subject")).otherwise(F.col("subject"))
    return Q.normalise_refs(obs.select("id", ref.alias("reference")), "reference", ["http://localhost/base/"], ["http://loinc.org/*"])


@query("valid_status", sql("SELECT id FROM service_request WHERE status = 'active'", "service_request"))
def valid_status(spark, sf_dir):
    return Q.valid_status(tables(spark, sf_dir, "service_request")[0]).select("id")


@query(
    "search_index",
    sql(
        "SELECT 'Patient' AS resource_type, id, 'family' AS parameter, 'string' AS kind, family AS value FROM patient UNION ALL SELECT 'Patient', id, 'block', 'token', block FROM patient WHERE block IS NOT NULL UNION ALL SELECT 'Patient', id, 'total', 'number', CAST(stored_total AS STRING) FROM patient WHERE stored_total IS NOT NULL",
        "patient",
    ),
)
def search_index(spark, sf_dir):
    return Q.search_index(tables(spark, sf_dir, "patient")[0], "Patient", {"family": ("string", "family"), "block": ("token", "block"), "total": ("number", "stored_total")})


@query(
    "search_index_arrays",
    sql(
        """SELECT 'Patient' AS resource_type, id, 'family' AS parameter, 'string' AS kind, family AS value FROM patient UNION ALL SELECT 'Patient', id, 'family', 'string', family_name FROM patient WHERE family_name <> family UNION ALL
SELECT 'Patient', id, 'given', 'string', given FROM patient UNION ALL SELECT 'Patient', id, 'given', 'string', 'Extra' FROM patient UNION ALL
SELECT 'Patient', id, 'identifier', 'token', concat('urn:a|', identifier) FROM patient UNION ALL SELECT 'Patient', id, 'identifier', 'token', concat('|', practitioner) FROM patient UNION ALL
SELECT 'Patient', id, 'address-city', 'string', block FROM patient WHERE block IS NOT NULL""",
        "patient",
    ),
)
def search_index_arrays(spark, sf_dir):
    p = tables(spark, sf_dir, "patient")[0]
    name = lambda family, *given: F.struct(F.col(family).alias("family"), F.array(*given).alias("given"))
    held = lambda system, value: F.struct(F.lit(system).cast("string").alias("system"), F.col(value).alias("value"))
    rows = p.select(
        "id",
        F.array(name("family", F.col("given"), F.lit("Extra")), name("family_name", F.col("given"))).alias("name"),
        F.array(held("urn:a", "identifier"), held(None, "practitioner")).alias("identifier"),
        F.struct(F.col("block").alias("city")).alias("address"),
    )
    specs = {"family": ("string", "name.family"), "given": ("string", "name.given"), "identifier": ("token", "identifier"), "address-city": ("string", "address.city")}
    return Q.search_index(rows, "Patient", specs)


@query("year_ago", sql("SELECT id, strftime(period_start - INTERVAL 1 YEAR, '%Y-%m-%d') AS since FROM encounter", "encounter"))
def year_ago(spark, sf_dir):
    return tables(spark, sf_dir, "encounter")[0].select("id", S.year_ago(F.col("period_start")).alias("since"))


@query("relative_period", sql("SELECT id, CAST(period_start - INTERVAL 2 YEAR AS DATE) AS p_start, period_start AS p_end FROM encounter", "encounter"))
def relative_period(spark, sf_dir):
    e = tables(spark, sf_dir, "encounter")[0].select("id", S.relative_period(F.col("period_start"), 2).alias("p"))
    return e.select("id", F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end"))


# ---- writes and history


@query("bulk_export_since", sql("SELECT id, last_updated FROM version WHERE last_updated >= TIMESTAMP '2024-01-10 00:00:00'", "version"))
def bulk_export_since(spark, sf_dir):
    v = tables(spark, sf_dir, "version")[0].withColumn("resource_type", F.lit("Observation"))
    return export_rows(v, ["Observation"], "2024-01-10 00:00:00").select("id", "last_updated")


_ENTRIES = "entries AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'Patient' ELSE 'Observation' END AS resource_type, CASE WHEN event_id % 7 = 1 THEN concat('new-', substr(sha256(CAST(event_id AS VARCHAR)), 1, 32)) ELSE concat('p', user_id) END AS id, event_id % 7 IN (0, 2) AS gone, props AS body, event_id AS seq FROM events WHERE event_id % 19 <> 5)"


@query(
    "apply_bundle",
    f"""WITH {_ENTRIES}, cur AS (SELECT 'Patient' AS resource_type, concat('p', c_custkey) AS id, 2 AS version_id, CASE WHEN c_custkey % 6 <> 0 THEN c_name END AS body, c_custkey % 6 = 0 AS deleted FROM customer),
steps AS (SELECT resource_type, id, gone, body, seq, 0 AS base FROM entries UNION ALL SELECT resource_type, id, deleted, body, -1, version_id FROM cur),
told AS (SELECT *, COALESCE(lag(gone) OVER w, TRUE) AS gone_before FROM steps WINDOW w AS (PARTITION BY resource_type, id ORDER BY seq))
SELECT resource_type, id, CAST(SUM(CASE WHEN seq = -1 THEN base WHEN gone AND gone_before THEN 0 ELSE 1 END) AS INT) AS version_id, CASE WHEN NOT arg_max(gone, seq) THEN arg_max(struct_pack(b := body), seq).b END AS body, arg_max(gone, seq) AS deleted
FROM told GROUP BY resource_type, id HAVING version_id > 0""",
)
def apply_bundle(spark, sf_dir):
    """All events as entries of two types against all customers, some of them deleted before; some POSTs bring an id, GET
    changes nothing."""
    e, c = tables(spark, sf_dir, "events", "customer")
    k = F.col("event_id")
    method = F.when(k % 19 == 5, "GET").when((k % 7).isin(0, 2), "DELETE").when(k % 7 == 1, "POST").otherwise("PUT")
    entries = e.select(
        F.when(k % 2 == 0, "Patient").otherwise("Observation").alias("resource_type"),
        F.when(k % 14 != 1, F.concat(F.lit("p"), F.col("user_id").cast("string"))).alias("id"),
        method.alias("method"),
        F.col("props").alias("body"),
        k.alias("seq"),
    )
    gone = F.col("c_custkey") % 6 == 0
    current = c.select(F.lit("Patient").alias("resource_type"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("id"), F.lit(2).alias("version_id"), F.when(~gone, F.col("c_name")).alias("body"), gone.alias("deleted"))
    return H.apply_bundle(current, entries)


_HISTORY = "hist AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY last_updated, seq) AS INT) AS version_id FROM version)"


@query("history", sql(f"WITH {_HISTORY} SELECT id, version_id, last_updated FROM hist", "version"))
def history(spark, sf_dir):
    return H.history(tables(spark, sf_dir, "version")[0]).select("id", "version_id", "last_updated")


@query(
    "version_diff",
    sql(
        f"""WITH {_HISTORY}, v AS (SELECT id, version_id, CASE WHEN seq % 4 = 0 THEN NULL ELSE status END AS status, props FROM hist),
l AS (SELECT *, lag(version_id) OVER w AS b, lag(status) OVER w AS s0, lag(props) OVER w AS p0 FROM v WINDOW w AS (PARTITION BY id ORDER BY version_id)),
d AS (SELECT id, version_id, 'status' AS path, s0 AS old, status AS new FROM l WHERE b IS NOT NULL UNION ALL SELECT id, version_id, 'props', p0, props FROM l WHERE b IS NOT NULL)
SELECT id, version_id, path, CASE WHEN old IS NULL THEN 'insert' WHEN new IS NULL THEN 'delete' ELSE 'replace' END AS operation, old, new FROM d WHERE old IS DISTINCT FROM new""",
        "version",
    ),
)
def version_diff(spark, sf_dir):
    v = H.history(tables(spark, sf_dir, "version")[0]).withColumn("status", F.when(F.col("seq") % 4 != 0, F.col("status")))
    return H.version_diff(v, ["status", "props"])


_BODY = """concat('{"resourceType":"Observation","status":"', status, '","data":', props, ',"tag":[', CASE seq % 3 WHEN 0 THEN '' WHEN 1 THEN concat('{"code":"', status, '"}') ELSE concat('{"code":"', status, '"},{"code":"x","n":', CAST(seq % 5 AS STRING), '}') END, ']', CASE WHEN seq % 2 = 0 THEN ',"note":null' ELSE '' END, '}')"""


@query(
    "structural_diff",
    sql(
        f"""WITH {_HISTORY}, flat AS (
SELECT id, version_id, 'Observation.status' AS path, concat('"', status, '"') AS value FROM hist
UNION ALL SELECT id, version_id, 'Observation.resourceType', '"Observation"' FROM hist
UNION ALL SELECT id, version_id, 'Observation.data.k', regexp_extract(props, '[0-9]+') FROM hist
UNION ALL SELECT id, version_id, 'Observation.tag', '[]' FROM hist WHERE seq % 3 = 0
UNION ALL SELECT id, version_id, 'Observation.tag[0].code', concat('"', status, '"') FROM hist WHERE seq % 3 > 0
UNION ALL SELECT id, version_id, 'Observation.tag[1].code', '"x"' FROM hist WHERE seq % 3 = 2
UNION ALL SELECT id, version_id, 'Observation.tag[1].n', CAST(seq % 5 AS STRING) FROM hist WHERE seq % 3 = 2
UNION ALL SELECT id, version_id, 'Observation.note', 'null' FROM hist WHERE seq % 2 = 0),
d AS (SELECT COALESCE(n.id, o.id) AS id, COALESCE(n.version_id, o.version_id + 1) AS version_id, COALESCE(n.path, o.path) AS path, o.value AS old, n.value AS new
FROM flat n FULL JOIN flat o ON n.id = o.id AND n.path = o.path AND n.version_id = o.version_id + 1)
SELECT d.id, CAST(d.version_id AS INT) AS version_id, path, CASE WHEN old IS NULL THEN 'insert' WHEN new IS NULL THEN 'delete' ELSE 'replace' END AS operation, old, new
FROM d JOIN hist h ON h.id = d.id AND h.version_id = d.version_id WHERE d.version_id > 1 AND old IS DISTINCT FROM new""",
        "version",
    ),
)
def structural_diff(spark, sf_dir):
    """All versions as resources of nested members and arrays of none to two tags."""
    v = H.history(tables(spark, sf_dir, "version")[0]).select("id", "version_id", F.expr(_BODY).alias("body"))
    return H.structural_diff(v, root=F.lit("Observation"))


def _conflicts(spark, sf_dir):
    e, c = tables(spark, sf_dir, "events", "customer")
    updates = e.select(F.col("user_id").cast("string").alias("id"), (F.col("event_id") % 3).cast("int").alias("base_version"), F.col("event_id").alias("arrival"))
    current = c.where("c_custkey % 9 <> 4").select(F.col("c_custkey").cast("string").alias("id"), F.lit(2).alias("version_id"))
    return current, updates


_CONFLICTS = "u AS (SELECT CAST(user_id AS STRING) AS id, CAST(event_id % 3 AS INT) AS base_version, event_id AS arrival, CASE WHEN user_id % 9 <> 4 THEN 2 END AS cur FROM events)"


@query(
    "resolve_updates",
    f"WITH {_CONFLICTS}, r AS (SELECT *, row_number() OVER (PARTITION BY id, base_version ORDER BY arrival) = 1 AND base_version = cur AS ok FROM u) SELECT id, arrival, CASE WHEN ok THEN 'applied' ELSE 'conflict' END AS status, CASE WHEN ok THEN 3 END AS version_id FROM r",
)
def resolve_updates(spark, sf_dir):
    return H.resolve_updates(*_conflicts(spark, sf_dir), retry=False)


@query(
    "resolve_updates_retry",
    f"WITH {_CONFLICTS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrival) - 1 AS t FROM u) SELECT id, arrival, CASE WHEN cur IS NOT NULL AND t <= 10 THEN 'applied' ELSE 'conflict' END AS status, CASE WHEN cur IS NOT NULL AND t <= 10 THEN CAST(3 + t AS INT) END AS version_id FROM r",
)
def resolve_updates_retry(spark, sf_dir):
    return H.resolve_updates(*_conflicts(spark, sf_dir), retry=True)


@query(
    "apply_patches",
    sql(
        """WITH pt AS (SELECT CAST(user_id AS STRING) AS id, CASE event_id % 3 WHEN 0 THEN 'remove' WHEN 1 THEN 'add' ELSE 'replace' END AS op, CASE event_id % 2 WHEN 0 THEN 'family' ELSE 'block' END AS path, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS value, event_id AS seq FROM events),
l AS (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY id, path ORDER BY seq DESC) = 1)
SELECT p.id, CASE WHEN f.op IS NULL THEN p.family WHEN f.op = 'remove' THEN NULL ELSE f.value END AS family, CASE WHEN b.op IS NULL THEN p.block WHEN b.op = 'remove' THEN NULL ELSE b.value END AS block
FROM patient p LEFT JOIN l f ON f.id = p.id AND f.path = 'family' LEFT JOIN l b ON b.id = p.id AND b.path = 'block'""",
        "patient",
    ),
)
def apply_patches(spark, sf_dir):
    p, e = tables(spark, sf_dir, "patient", "events")
    k = F.col("event_id")
    patches = e.select(
        F.col("user_id").cast("string").alias("id"),
        F.when(k % 3 == 0, "remove").when(k % 3 == 1, "add").otherwise("replace").alias("op"),
        F.when(k % 2 == 0, "family").otherwise("block").alias("path"),
        F.when(k % 5 != 0, F.col("event_type")).alias("value"),
        k.alias("seq"),
    )
    return H.apply_patches(p.select("id", "family", "block"), patches, ["family", "block"])


@query("delete_where", sql("SELECT id FROM patient WHERE NOT (family = 'Weber' AND COALESCE(block = 'BUILDING', FALSE))", "patient"))
def delete_where(spark, sf_dir):
    p = tables(spark, sf_dir, "patient")[0]
    return H.delete_where(p, (F.col("family") == "Weber") & (F.col("block") == "BUILDING")).select("id")


@query(
    "soft_delete",
    sql(f"WITH {_HISTORY} SELECT id, version_id, FALSE AS deleted FROM hist UNION ALL SELECT id, CAST(MAX(version_id) + 1 AS INT), TRUE FROM hist WHERE id LIKE '%-error' GROUP BY id", "version"),
)
def soft_delete(spark, sf_dir):
    h = H.history(tables(spark, sf_dir, "version")[0])
    return H.soft_delete(h, h.where("id LIKE '%-error'")).select("id", "version_id", "deleted")


@query("expunge", sql(f"WITH {_HISTORY} SELECT id, version_id FROM hist WHERE id NOT LIKE '%-error'", "version"))
def expunge(spark, sf_dir):
    h = H.history(tables(spark, sf_dir, "version")[0])
    return H.expunge(h, h.where("id LIKE '%-error'")).select("id", "version_id")


@query(
    "conditional_create",
    sql("WITH k AS (SELECT *, concat(identifier, '-', practitioner) AS name FROM patient) SELECT id, name FROM k WHERE seq % 2 = 0 AND name NOT IN (SELECT name FROM k WHERE seq % 2 = 1) QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq) = 1", "patient"),
)
def conditional_create(spark, sf_dir):
    """One half of the patients comes in, the other half is there."""
    p = tables(spark, sf_dir, "patient")[0].withColumn("name", F.concat("identifier", F.lit("-"), "practitioner"))
    return H.conditional_create(p.where("seq % 2 = 0"), p.where("seq % 2 = 1"), "name").select("id", "name")


@query(
    "last_n",
    sql("SELECT id, subject, code, CAST(row_number() OVER (PARTITION BY subject, code ORDER BY ts DESC, id) AS INT) AS rank FROM observation QUALIFY rank <= 3", "observation"),
)
def last_n(spark, sf_dir):
    obs = tables(spark, sf_dir, "observation")[0].withColumn("at", F.col("ts"))
    return H.last_n(obs, 3).select("id", "subject", "code", "rank")
