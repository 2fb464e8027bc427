"""Queries of references, cohorts, linkage, terminology and subscriptions over the driver tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from wardline.functions import scoring as S
from wardline.operators import cohort as C
from wardline.operators import linkage as L
from wardline.operators import refs as R
from wardline.operators import subscriptions as U
from wardline.operators import terminology as T
from wardline.plans.adapters import sql, tables
from wardline.plans.clinical import SQL, query
from wardline.sources import records as B
from wardline.sources.staging import staged

# ---- references

_TARGETS = "targets AS (SELECT 'Patient' AS resource_type, id FROM patient WHERE seq % 10 <> 0 UNION ALL SELECT 'Nation', CAST(n_nationkey AS STRING) FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'Region', CAST(r_regionkey AS STRING) FROM region)"
_DANGLING = "dangling AS (SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE t.resource_type = r.ref_type AND t.id = r.ref_id))"


def _targets(spark, sf_dir):
    p, n, r = tables(spark, sf_dir, "patient", "nation", "region")
    one = lambda df, t, k: df.select(F.lit(t).alias("resource_type"), F.col(k).cast("string").alias("id"))
    return one(p.where("seq % 10 <> 0"), "Patient", "id").unionByName(one(n.where("n_nationkey <> 3"), "Nation", "n_nationkey")).unionByName(one(r, "Region", "r_regionkey"))


@query("dangling_refs", sql(f"WITH {_TARGETS}, {_DANGLING} SELECT * FROM dangling", "patient", "refs"))
def dangling_refs(spark, sf_dir):
    return R.dangling_refs(tables(spark, sf_dir, "refs")[0], _targets(spark, sf_dir))


@query(
    "placeholders",
    sql(f"WITH {_TARGETS}, {_DANGLING} SELECT resource_type, id, FALSE AS is_placeholder FROM targets UNION ALL SELECT DISTINCT ref_type, ref_id, TRUE FROM dangling", "patient", "refs"),
)
def placeholders(spark, sf_dir):
    return R.placeholders(tables(spark, sf_dir, "refs")[0], _targets(spark, sf_dir))


def _going(spark, sf_dir):
    r = tables(spark, sf_dir, "refs")[0]
    nations = r.where("ref_type = 'Region' AND ref_id = '1'").select(F.col("src_type").alias("resource_type"), F.col("src_id").alias("id"))
    suppliers = r.where("src_type = 'Organization' AND cast(src_id as int) % 4 = 0").select(F.col("src_type").alias("resource_type"), F.col("src_id").alias("id"))
    return nations.unionByName(suppliers), r


@query(
    "delete_blockers",
    sql("WITH g AS (SELECT src_type AS t, src_id AS i FROM refs WHERE (ref_type = 'Region' AND ref_id = '1') OR (src_type = 'Organization' AND CAST(src_id AS INT) % 4 = 0)) SELECT * FROM refs WHERE (ref_type, ref_id) IN (SELECT (t, i) FROM g) AND (src_type, src_id) NOT IN (SELECT (t, i) FROM g)", "refs"),
)
def delete_blockers(spark, sf_dir):
    return R.delete_blockers(*_going(spark, sf_dir))


@query(
    "cascade_delete",
    sql("WITH RECURSIVE c(resource_type, id, depth) AS (SELECT 'Region', '1', 0 UNION ALL SELECT src_type, src_id, depth + 1 FROM refs JOIN c ON ref_type = resource_type AND ref_id = c.id) SELECT resource_type, id, MIN(depth) AS depth FROM c GROUP BY resource_type, id", "refs"),
)
def cascade_delete(spark, sf_dir):
    r = tables(spark, sf_dir, "region")[0].where("r_regionkey = 1")
    going = r.select(F.lit("Region").alias("resource_type"), F.col("r_regionkey").cast("string").alias("id"))
    return R.cascade_delete(going, tables(spark, sf_dir, "refs")[0])


@query(
    "pin_versions",
    sql(
        "WITH v AS (SELECT 'Patient' AS t, CAST(user_id AS STRING) AS i, MAX(event_id % 9) AS v FROM events GROUP BY user_id) SELECT src_type, src_id, path, CASE WHEN path = 'subject' AND v IS NOT NULL THEN concat(ref_type, '/', ref_id, '/_history/', v) ELSE concat(ref_type, '/', ref_id) END AS reference FROM refs LEFT JOIN v ON ref_type = t AND ref_id = i",
        "refs",
    ),
)
def pin_versions(spark, sf_dir):
    refs, e = tables(spark, sf_dir, "refs", "events")
    current = e.select(F.lit("Patient").alias("resource_type"), F.col("user_id").cast("string").alias("id"), (F.col("event_id") % 9).alias("version_id"))
    return R.pin_versions(refs, current, ["subject"])


@query(
    "cross_partition_refs",
    sql("SELECT 'Encounter' AS src_type, e.id AS src_id, 'Patient' AS ref_type, p.id AS ref_id, CAST(CAST(e.id AS BIGINT) % 3 AS INT) AS src_partition, CAST(p.seq % 4 AS INT) AS ref_partition FROM encounter e JOIN patient p ON p.id = e.patient_id WHERE CAST(e.id AS BIGINT) % 3 <> p.seq % 4", "encounter", "patient"),
)
def cross_partition_refs(spark, sf_dir):
    refs, e, p = tables(spark, sf_dir, "refs", "encounter", "patient")
    parts = e.select(F.lit("Encounter").alias("resource_type"), "id", (F.col("id").cast("long") % 3).cast("int").alias("partition_id")).unionByName(
        p.select(F.lit("Patient").alias("resource_type"), "id", (F.col("seq") % 4).cast("int").alias("partition_id"))
    )
    return R.cross_partition_refs(refs, parts)


# ---- cohorts


@query("during", sql("SELECT id FROM encounter WHERE period_start <= DATE '1996-12-31' AND (period_end IS NULL OR period_end >= DATE '1996-01-01')", "encounter"))
def during(spark, sf_dir):
    e = tables(spark, sf_dir, "encounter")[0]
    day = lambda x: F.lit(x).cast("date")
    return C.during(e, "period_start", "period_end", day("1996-01-01"), day("1996-12-31")).select("id")


@query(
    "overlap_join",
    sql("SELECT a.id AS l_id, b.id AS r_id FROM encounter a JOIN encounter b ON a.patient_id = b.patient_id WHERE a.status = 'F' AND b.status = 'P' AND (b.period_end IS NULL OR a.period_start <= b.period_end) AND (a.period_end IS NULL OR b.period_start <= a.period_end)", "encounter"),
)
def overlap_join(spark, sf_dir):
    e = tables(spark, sf_dir, "encounter")[0].select("id", "patient_id", F.col("period_start").alias("start"), F.col("period_end").alias("end"), "status")
    return C.overlap_join(e.where("status = 'F'"), e.where("status = 'P'"), "patient_id").select("l_id", "r_id")


@query("overlap_join_binned", SQL["overlap_join"])
def overlap_join_binned(spark, sf_dir):
    e = tables(spark, sf_dir, "encounter")[0].withColumnsRenamed({"period_start": "start", "period_end": "end"})
    return C.overlap_join_binned(e.where("status = 'F'"), e.where("status = 'P'"), "patient_id").select("l_id", "r_id")


@query(
    "everything",
    sql(
        "WITH c AS (SELECT id FROM patient) SELECT id AS patient_id, 'Patient' AS resource_type, id FROM c UNION ALL SELECT patient_id, 'Encounter', id FROM encounter WHERE patient_id IN (SELECT id FROM c) UNION ALL SELECT patient_id, 'Condition', id FROM condition WHERE patient_id IN (SELECT id FROM c) UNION ALL SELECT substr(subject, 9), 'Observation', id FROM observation WHERE substr(subject, 9) IN (SELECT id FROM c)",
        "patient",
        "encounter",
        "condition",
        "observation",
    ),
)
def everything(spark, sf_dir):
    p, e, c, o = tables(spark, sf_dir, "patient", "encounter", "condition", "observation")
    obs = o.withColumn("patient_id", S.patient_id(F.col("subject")))
    return C.everything(p, {"Encounter": e, "Condition": c, "Observation": obs})


_PREFETCH = """WITH co AS (SELECT id AS patient_id FROM patient),
mr AS (SELECT * FROM medication_request WHERE status = 'active' AND category = 'community' AND intent = 'order'),
x AS (SELECT patient_id, 'patient' AS item, concat('Patient/', patient_id) AS r FROM co
 UNION ALL SELECT patient_id, 'medication_requests', concat('MedicationRequest/', id) FROM mr
 UNION ALL SELECT patient_id, 'medication_requests', concat('Medication/', medication_id) FROM (SELECT DISTINCT patient_id, medication_id FROM mr WHERE medication_id IN (SELECT id FROM medication))
 UNION ALL SELECT patient_id, 'conditions', concat('Condition/', id) FROM condition WHERE category IN ('encounter-diagnosis', 'health-concern', 'problem-list-item') AND clinical_status = 'active'
 UNION ALL SELECT patient_id, 'encounters', concat('Encounter/', id) FROM encounter WHERE period_start >= DATE '1999-01-01'
 UNION ALL SELECT patient_id, 'service_requests', concat('ServiceRequest/', id) FROM service_request WHERE status IN ('active', 'completed')
 UNION ALL SELECT substr(subject, 9), 'observations', concat('Observation/', id) FROM observation WHERE code IN ('8867-4', '9279-1') AND seq % 2 = 0 AND ts >= TIMESTAMP '2023-02-01 00:00:00')
SELECT co.patient_id, """ + ", ".join(f"COALESCE(string_agg(r, ',' ORDER BY r) FILTER (item = '{i}'), '') AS {i}" for i in C.ITEMS) + " FROM co LEFT JOIN x USING (patient_id) GROUP BY co.patient_id"


@query("prefetch", sql(_PREFETCH, "patient", "medication_request", "medication", "condition", "encounter", "service_request", "observation"))
def prefetch(spark, sf_dir):
    names = ("patient", "medication_request", "medication", "condition", "encounter", "service_request", "observation")
    held = dict(zip(names, tables(spark, sf_dir, *names), strict=True))
    o = held["observation"]
    category = F.when(F.col("seq") % 2 == 0, "laboratory").otherwise("vital-signs")
    held["observation"] = o.select("id", S.patient_id(F.col("subject")).alias("patient_id"), category.alias("category"), "code", F.col("ts").alias("at"))
    codes = o.where("event_type IN ('click', 'view')").select("code").distinct()
    cohort = held["patient"].select(F.col("id").alias("patient_id"))
    day = lambda x: F.lit(x).cast("date")
    wide = C.prefetch(cohort, held, codes, day("2000-01-01"), day("2024-02-01"))
    listed = lambda i: F.array_join(F.array_sort(F.transform(i, lambda x: F.concat(x["resource_type"], F.lit("/"), x["id"]))), ",")
    return wide.select("patient_id", *[listed(i).alias(i) for i in C.ITEMS])


@query(
    "missing_prefetch",
    sql(
        "SELECT id, CASE WHEN block IS NULL THEN 'labs,patient' WHEN stored_total IS NULL THEN 'labs' END AS missing FROM patient WHERE block IS NULL OR stored_total IS NULL",
        "patient",
    ),
)
def missing_prefetch(spark, sf_dir):
    """Requests of all patients: without a block they bring nothing, without a stored total only the patient."""
    p = tables(spark, sf_dir, "patient")[0]
    one, both = F.create_map(F.lit("patient"), F.col("id")), F.create_map(F.lit("patient"), F.col("id"), F.lit("labs"), F.col("id"))
    asked = F.when(F.col("block").isNotNull(), F.when(F.col("stored_total").isNull(), one).otherwise(both))
    found = C.missing_prefetch(p.select("id", asked.alias("prefetch")), ["patient", "labs"])
    return found.select("id", F.array_join(F.array_sort("missing"), ",").alias("missing"))


_FLAGS = """flags AS (SELECT p.id AS patient_id, p.active AS ip, COALESCE(e.n > 0, FALSE) AS den, p.seq % 17 = 0 AS exc, COALESCE(c.n > 0, FALSE) AS num FROM patient p
LEFT JOIN (SELECT patient_id, COUNT(*) AS n FROM encounter WHERE period_start <= DATE '1997-12-31' AND (period_end IS NULL OR period_end >= DATE '1997-01-01') GROUP BY 1) e ON e.patient_id = p.id
LEFT JOIN (SELECT patient_id, COUNT(*) AS n FROM condition WHERE code IN ('1', '2', '3', '4', '5') GROUP BY 1) c ON c.patient_id = p.id),
g AS (SELECT patient_id, ip AS i, ip AND den AS d, ip AND den AND exc AS x, ip AND den AND NOT exc AND num AS n FROM flags)"""


def _flags(spark, sf_dir):
    p, e, c = tables(spark, sf_dir, "patient", "encounter", "condition")
    day = lambda x: F.lit(x).cast("date")
    seen = C.during(e, "period_start", "period_end", day("1997-01-01"), day("1997-12-31")).select("patient_id").distinct().withColumn("denominator", F.lit(True))
    met = c.where(F.col("code").isin("1", "2", "3", "4", "5")).select("patient_id").distinct().withColumn("numerator", F.lit(True))
    base = p.select(F.col("id").alias("patient_id"), F.col("active").alias("initial_population"), (F.col("seq") % 17 == 0).alias("exclusion"))
    return base.join(seen, "patient_id", "left").join(met, "patient_id", "left")


@query(
    "evaluate_measure",
    sql(f"WITH {_FLAGS} SELECT *, CAST(numerator AS DOUBLE) / NULLIF(denominator - exclusion, 0) AS score FROM (SELECT COUNT(*) FILTER (i) AS initial_population, COUNT(*) FILTER (d) AS denominator, COUNT(*) FILTER (x) AS exclusion, COUNT(*) FILTER (n) AS numerator FROM g)", "patient", "encounter", "condition"),
)
def evaluate_measure(spark, sf_dir):
    return C.evaluate_measure(_flags(spark, sf_dir))


@query(
    "evaluate_measure_individual",
    sql(
        f"WITH {_FLAGS} SELECT patient_id, CAST(i AS BIGINT) AS initial_population, CAST(d AS BIGINT) AS denominator, CAST(x AS BIGINT) AS exclusion, CAST(n AS BIGINT) AS numerator, CAST(n AS DOUBLE) / NULLIF(CAST(d AS BIGINT) - CAST(x AS BIGINT), 0) AS score FROM g",
        "patient",
        "encounter",
        "condition",
    ),
)
def evaluate_measure_individual(spark, sf_dir):
    return C.evaluate_measure(_flags(spark, sf_dir), "individual")


@query("care_gaps", sql(f"WITH {_FLAGS} SELECT patient_id, CASE WHEN n THEN 'closed-gap' ELSE 'open-gap' END AS status FROM g WHERE d AND NOT x", "patient", "encounter", "condition"))
def care_gaps(spark, sf_dir):
    return C.care_gaps(_flags(spark, sf_dir))


def _criteria_flags(spark, sf_dir, least=1):
    """The flags of ``_flags`` from criteria: patients' own states, encounters and conditions are facts of three kinds."""
    p, e, c = tables(spark, sf_dir, "patient", "encounter", "condition")
    none = F.lit(None).cast("date")
    states = F.array_compact(F.array(F.when(F.col("active"), F.lit("active")), F.when(F.col("seq") % 17 == 0, F.lit("excused"))))
    facts = p.select(F.col("id").alias("patient_id"), F.lit("Patient").alias("kind"), F.lit("state").alias("system"), F.explode(states).alias("code"), none.alias("start"), none.alias("end"))
    facts = facts.unionByName(e.select("patient_id", F.lit("Encounter").alias("kind"), F.lit("status").alias("system"), F.col("status").alias("code"), F.col("period_start").alias("start"), F.col("period_end").alias("end")))
    facts = facts.unionByName(c.select("patient_id", F.lit("Condition").alias("kind"), F.lit("codes").alias("system"), "code", none.alias("start"), none.alias("end")))
    members = spark.createDataFrame([("vs-active", "state", "active"), ("vs-excused", "state", "excused")] + [("vs-met", "codes", str(k)) for k in range(1, 6)], "url string, system string, code string")
    criteria = spark.createDataFrame(
        [
            ("initial_population", "state", "Patient", "vs-active", None, None, None),
            ("denominator", "seen", "Encounter", None, date(1997, 1, 1), date(1997, 12, 31), None),
            ("exclusion", "state", "Patient", "vs-excused", None, None, None),
            ("numerator", "met", "Condition", "vs-met", None, None, least),
        ],
        "flag string, part string, kind string, valueset_url string, period_start date, period_end date, min_count int",
    )
    return C.measure_flags(p, facts, members, criteria)


@query("measure_from_criteria", SQL["evaluate_measure_individual"])
def measure_from_criteria(spark, sf_dir):
    return C.evaluate_measure(_criteria_flags(spark, sf_dir), "individual")


@query("measure_from_criteria_twice", SQL["evaluate_measure"].replace("COALESCE(c.n > 0, FALSE) AS num", "COALESCE(c.n > 1, FALSE) AS num"))
def measure_from_criteria_twice(spark, sf_dir):
    """The numerator asks for two conditions of the value set."""
    return C.evaluate_measure(_criteria_flags(spark, sf_dir, 2))


# ---- linkage


def _linkable(spark, sf_dir):
    return tables(spark, sf_dir, "person")[0].withColumn("birthdate", F.date_add(F.lit("1950-01-01").cast("date"), F.col("birth_no")))


_CANDIDATES = "act AS (SELECT * FROM person WHERE active), cand AS (SELECT a.resource_type, a.id AS a, b.id AS b FROM act a JOIN act b ON a.resource_type = b.resource_type AND a.birth_no = b.birth_no AND a.id < b.id WHERE a.resource_type = 'Patient' UNION SELECT a.resource_type, a.id, b.id FROM act a JOIN act b ON a.resource_type = b.resource_type AND a.identifier = b.identifier AND a.id < b.id UNION SELECT a.resource_type, a.id, b.id FROM act a JOIN act b ON a.resource_type = b.resource_type AND a.practitioner = b.practitioner AND a.id < b.id WHERE a.resource_type = 'Patient')"
_BLOCKS = "b AS (SELECT resource_type, 'birthdate' AS rule, substr(CAST(DATE '1950-01-01' + birth_no AS STRING), 1, 10) AS value, * EXCLUDE (resource_type) FROM person WHERE active AND resource_type = 'Patient' UNION ALL SELECT resource_type, 'identifier', identifier, * EXCLUDE (resource_type) FROM person WHERE active UNION ALL SELECT resource_type, 'practitioner', practitioner, * EXCLUDE (resource_type) FROM person WHERE active AND resource_type = 'Patient')"


@query(
    "block_report",
    sql(
        f"WITH {_BLOCKS} SELECT resource_type, rule, value, COUNT(*) AS records, CAST(COUNT(*) * (COUNT(*) - 1) // 2 AS BIGINT) AS pairs FROM b GROUP BY ALL HAVING COUNT(*) >= 2",
        "person",
    ),
)
def block_report(spark, sf_dir):
    return L.block_report(_linkable(spark, sf_dir))


@query(
    "mdm_left_out",
    sql(
        f"WITH {_BLOCKS}, g AS (SELECT resource_type, rule, value, birth_no, COUNT(*) AS n FROM b GROUP BY ALL) SELECT resource_type, rule, value, CAST(SUM(n) AS BIGINT) AS records, CAST(SUM(n) * (SUM(n) - 1) // 2 AS BIGINT) AS pairs, CAST(SUM(n * (n - 1) // 2) AS BIGINT) AS kept FROM g GROUP BY resource_type, rule, value HAVING SUM(n) > 20",
        "person",
    ),
)
def mdm_left_out(spark, sf_dir):
    """What blocks of more than 20 records would lose if their pairs had to agree in the birth date."""
    return L.left_out(_linkable(spark, sf_dir), 20, "birthdate")


@query("mdm_candidates", sql(f"WITH {_CANDIDATES} SELECT resource_type, a, b FROM cand", "person"))
def mdm_candidates(spark, sf_dir):
    return L.mdm_candidates(_linkable(spark, sf_dir))


_GIVEN = "CASE {0} WHEN 'Maria' THEN '67' WHEN 'Marie' THEN '67' WHEN 'Peter' THEN '127' WHEN 'Pieter' THEN '127' WHEN 'Anna' THEN '06' WHEN 'Hanna' THEN '06' ELSE '458' END"
_FAMILY = "CASE {0} WHEN 'Meyer' THEN 'M600' WHEN 'Maier' THEN 'M600' WHEN 'Schmidt' THEN 'S530' WHEN 'Schmitt' THEN 'S530' WHEN 'Fischer' THEN 'F260' WHEN 'Vischer' THEN 'V260' WHEN 'Weber' THEN 'W160' WHEN 'Wagner' THEN 'W256' WHEN 'Becker' THEN 'B260' WHEN 'Bekker' THEN 'B260' ELSE 'H155' END"


_NAMED = f"k AS (SELECT resource_type, id, {_GIVEN.format('given')} AS g, {_FAMILY.format('family')} AS f FROM person)"
_COMPARED = "cand JOIN k x ON x.resource_type = cand.resource_type AND x.id = a JOIN k y ON y.resource_type = cand.resource_type AND y.id = b"


@query(
    "mdm_match",
    sql(
        f"WITH {_CANDIDATES}, {_NAMED} SELECT cand.resource_type, a, b, x.g = y.g AS given, x.f = y.f AS family, CASE WHEN x.g = y.g AND x.f = y.f THEN 'MATCH' WHEN x.g = y.g THEN 'POSSIBLE_MATCH' ELSE 'NO_MATCH' END AS result FROM {_COMPARED}",
        "person",
    ),
)
def mdm_match(spark, sf_dir):
    return L.mdm_compare(_linkable(spark, sf_dir))


@query(
    "phonetic_keys",
    sql(
        f"SELECT id, {_FAMILY.format('family')} AS family_key, {_GIVEN.format('given')} AS given_keys FROM patient",
        "patient",
    ),
)
def phonetic_keys(spark, sf_dir):
    keys = L.phonetic_keys(tables(spark, sf_dir, "patient")[0])
    return keys.select("id", "family_key", F.array_join(F.array_sort("given_keys"), ",").alias("given_keys"))


@query(
    "mdm_links",
    sql(
        f"WITH {_CANDIDATES}, {_NAMED} SELECT cand.resource_type, a, b, CASE WHEN x.f = y.f THEN 'MATCH' ELSE 'POSSIBLE_MATCH' END AS result FROM {_COMPARED} WHERE x.g = y.g",
        "person",
    ),
)
def mdm_links(spark, sf_dir):
    return L.mdm_links(_linkable(spark, sf_dir))


def _identifiers(spark, sf_dir):
    p = tables(spark, sf_dir, "patient")[0]
    return p.select("id", F.when(F.col("seq") % 4 == 0, "urn:other").otherwise("urn:eid").alias("system"), F.col("identifier").alias("value"))


_EID = "eid AS (SELECT id, identifier AS value FROM patient WHERE seq % 4 <> 0), links AS (SELECT m.a, e.id AS b FROM eid e JOIN (SELECT value, MIN(id) AS a FROM eid GROUP BY value) m USING (value) WHERE m.a <> e.id)"


@query("mdm_eid_matches", sql(f"WITH {_EID} SELECT a, b, 'MATCH' AS result FROM links", "patient"))
def mdm_eid_matches(spark, sf_dir):
    return L.mdm_eid_matches(_identifiers(spark, sf_dir), "urn:eid")


@query(
    "golden_ids",
    sql(
        f"WITH RECURSIVE {_EID}, two AS (SELECT a, b FROM links UNION SELECT m.a, p.id FROM patient p JOIN (SELECT birth_no, MIN(id) AS a FROM patient GROUP BY birth_no) m USING (birth_no) WHERE m.a <> p.id), both_ways AS (SELECT a, b FROM two UNION SELECT b, a FROM two), r(id, g) AS (SELECT a, a FROM both_ways UNION SELECT b, g FROM r JOIN both_ways ON a = id) SELECT id, MIN(g) AS golden_id FROM r GROUP BY id",
        "patient",
    ),
)
def golden_ids(spark, sf_dir):
    """Links by enterprise identifier and by birth date, each as a star on the least id of its group."""
    p = tables(spark, sf_dir, "patient")[0]
    least = p.groupBy("birth_no").agg(F.min("id").alias("a"))
    born = p.select(F.col("id").alias("b"), "birth_no").join(least, "birth_no").where("a <> b").select("a", "b")
    return L.golden_ids(L.mdm_eid_matches(_identifiers(spark, sf_dir), "urn:eid").select("a", "b").unionByName(born))


@query("golden_ids_grown", SQL["golden_ids"])
def golden_ids_grown(spark, sf_dir):
    """The components of ``golden_ids``, its links come in three batches."""
    p = tables(spark, sf_dir, "patient")[0]
    least = p.groupBy("birth_no").agg(F.min("id").alias("a"))
    born = p.select(F.col("id").alias("b"), "birth_no").join(least, "birth_no").where("a <> b").select("a", "b")
    by_identifier = L.mdm_eid_matches(_identifiers(spark, sf_dir), "urn:eid").select("a", "b")
    labels = L.golden_ids(by_identifier)
    for odd in (0, 1):
        changed, _ = L.grow_golden_ids(labels, born.where(F.pmod(F.xxhash64("b"), F.lit(2)) == odd))
        labels = staged(L.relabelled(labels, changed), "golden-labels")
    return labels


# ---- terminology


_COMPOSE = "compose AS (SELECT DISTINCT concat('vs', p_size % 4) AS url, p_brand AS system, CASE WHEN p_size % 4 = 3 THEN NULL WHEN p_partkey % 9 = 0 THEN 'unknown' ELSE p_type END AS code FROM part WHERE p_size % 4 <> 3 OR p_brand IN ('Brand#1', 'Brand#2')), expanded AS (SELECT url, system, code FROM compose JOIN concept USING (system, code) UNION SELECT url, system, concept.code FROM compose JOIN concept USING (system) WHERE compose.code IS NULL)"


def _compose(spark, sf_dir):
    part = tables(spark, sf_dir, "part")[0]
    code = F.when(F.col("p_size") % 4 == 3, F.lit(None).cast("string")).when(F.col("p_partkey") % 9 == 0, "unknown").otherwise(F.col("p_type"))
    url = F.concat(F.lit("vs"), (F.col("p_size") % 4).cast("string"))
    return part.where("p_size % 4 <> 3 OR p_brand IN ('Brand#1', 'Brand#2')").select(url.alias("url"), F.col("p_brand").alias("system"), code.alias("code")).distinct()


@query("expand_valuesets", sql(f"WITH {_COMPOSE} SELECT url, system, code FROM expanded", "concept"))
def expand_valuesets(spark, sf_dir):
    return T.expand_valuesets(_compose(spark, sf_dir), tables(spark, sf_dir, "concept")[0])


@query("in_valueset", sql(f"WITH {_COMPOSE} SELECT id FROM medication m WHERE EXISTS (SELECT 1 FROM expanded e WHERE e.url = 'vs3' AND e.system = m.system AND e.code = m.code)", "concept", "medication"))
def in_valueset(spark, sf_dir):
    concept, m = tables(spark, sf_dir, "concept", "medication")
    return T.in_valueset(m, T.expand_valuesets(_compose(spark, sf_dir), concept), "vs3").select("id")


@query(
    "validate_codes",
    sql("SELECT m.id, CASE WHEN lower(m.system) IN ('brand#1', 'brand#3') THEN c.code IS NOT NULL END AS result, CASE WHEN lower(m.system) IN ('brand#1', 'brand#3') THEN c.display END AS display FROM (SELECT id, upper(system) AS system, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'none' ELSE code END AS code FROM medication) m LEFT JOIN concept c ON lower(c.system) = lower(m.system) AND c.code = m.code", "medication", "concept"),
)
def validate_codes(spark, sf_dir):
    m, c = tables(spark, sf_dir, "medication", "concept")
    asked = m.select("id", F.upper("system").alias("system"), F.when(F.col("id").cast("long") % 3 == 0, "none").otherwise(F.col("code")).alias("code"))
    return T.validate_codes(asked, c, ["BRAND#1", "brand#3"]).select("id", "result", "display")


@query("profiles_by_type", "SELECT p_brand AS type, list_sort(list(DISTINCT p_type)) AS urls FROM part WHERE p_size % 2 = 0 GROUP BY p_brand")
def profiles_by_type(spark, sf_dir):
    part = tables(spark, sf_dir, "part")[0]
    kind = F.when(F.col("p_size") % 2 == 0, "resource").otherwise("complex-type")
    return T.profiles_by_type(part.select(kind.alias("kind"), F.col("p_brand").alias("type"), F.col("p_type").alias("url")))


@query(
    "profile_violations",
    "WITH pr AS (SELECT p_brand AS b, list(DISTINCT p_type) AS urls FROM part WHERE p_size < 3 GROUP BY p_brand) SELECT CAST(p_partkey AS STRING) AS id FROM part JOIN pr ON b = p_brand WHERE p_partkey % 6 = 0 OR NOT list_contains(urls, p_type)",
)
def profile_violations(spark, sf_dir):
    part = tables(spark, sf_dir, "part")[0]
    allowed = T.profiles_by_type(part.where("p_size < 3").select(F.lit("resource").alias("kind"), F.col("p_brand").alias("type"), F.col("p_type").alias("url")))
    declared = F.when(F.col("p_partkey") % 6 != 0, F.array("p_type"))
    rows = part.select(F.col("p_brand").alias("resource_type"), F.col("p_partkey").cast("string").alias("id"), declared.alias("profile"))
    return T.profile_violations(rows, allowed).select("id")


@query("tag_usage", "SELECT system, code, COUNT(DISTINCT id) AS resources FROM (SELECT p_partkey AS id, p_brand AS system, p_type AS code FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS STRING) FROM part) GROUP BY system, code")
def tag_usage(spark, sf_dir):
    part = tables(spark, sf_dir, "part")[0]
    tag = lambda s, c: F.struct(s.alias("system"), c.alias("code"))
    own = tag(F.col("p_brand"), F.col("p_type"))
    return T.tag_usage(part.select(F.col("p_partkey").alias("id"), F.array(own, own, tag(F.lit("size"), F.col("p_size").cast("string"))).alias("tags")))


@query(
    "assign_patient_partition",
    sql("SELECT COUNT(*) AS n, COUNT(*) FILTER (seq % 5 = 0) AS in_default, TRUE AS one_each FROM observation", "observation"),
)
def assign_patient_partition(spark, sf_dir):
    """Invariants: rows without a patient, and only they, are in partition 0; a patient is in one partition."""
    obs = tables(spark, sf_dir, "observation")[0]
    patient = F.when(F.col("seq") % 5 != 0, S.patient_id(F.col("subject")))
    placed = T.assign_patient_partition(obs.select(patient.alias("patient_id")), 16)
    per = placed.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("partition_id").alias("parts"), F.min("partition_id").alias("p"))
    return per.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("p") == 0, F.col("n")).otherwise(0)).alias("in_default"), F.max("parts").__eq__(1).alias("one_each"))


_PLACED = "placed AS (SELECT id, CASE WHEN seq % 5 = 0 THEN 0 ELSE CAST(CAST(concat('0x', substr(md5(substr(subject, 9)), 1, 8)) AS BIGINT) % 16 + 1 AS INT) END AS partition_id, CASE WHEN seq % 5 <> 0 THEN substr(subject, 9) END AS patient_id FROM observation)"


def _placed(spark, sf_dir):
    obs = tables(spark, sf_dir, "observation")[0]
    patient = F.when(F.col("seq") % 5 != 0, S.patient_id(F.col("subject")))
    return T.assign_portable_partition(obs.select("id", patient.alias("patient_id")), 16)


@query("patient_partitions", sql(f"WITH {_PLACED} SELECT id, partition_id FROM placed", "observation"))
def patient_partitions(spark, sf_dir):
    """The partition of every observation; a fifth of them has no patient."""
    return _placed(spark, sf_dir).select("id", "partition_id")


@query(
    "partition_balance",
    sql(
        f"WITH {_PLACED}, u AS (SELECT partition_id, COUNT(*) AS rows, COUNT(DISTINCT patient_id) AS patients FROM placed GROUP BY 1), e AS (SELECT CAST(p AS INT) AS partition_id, COALESCE(rows, 0) AS rows, COALESCE(patients, 0) AS patients FROM range(17) r(p) LEFT JOIN u ON u.partition_id = p) SELECT *, CASE WHEN partition_id > 0 THEN patients * 16.0::DOUBLE / (SELECT SUM(patients) FROM e) END AS times_even FROM e",
        "observation",
    ),
)
def partition_balance(spark, sf_dir):
    return T.partition_balance(_placed(spark, sf_dir), 16)


@query("for_tenant", sql("SELECT id, family FROM patient WHERE tenant = 7", "patient"))
def for_tenant(spark, sf_dir):
    return T.for_tenant(tables(spark, sf_dir, "patient")[0], 7).select("id", "family")


# ---- subscriptions

_SUBS = """subs AS (SELECT concat('s', c_custkey) AS sid, CASE WHEN c_custkey % 4 = 0 THEN 'off' ELSE 'active' END AS status, 'subject' AS field, concat('Patient/', c_custkey) AS wanted, c_custkey % 2 = 0 AS on_create, TRUE AS on_update FROM customer
 UNION ALL SELECT concat('n', n_nationkey), 'active', 'code', CASE n_nationkey % 3 WHEN 0 THEN '8867-4' WHEN 1 THEN '9279-1' ELSE '8480-6' END, n_nationkey % 2 = 0, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey % 5 = 1 END FROM nation
 UNION ALL SELECT concat('r', r_regionkey), CASE WHEN r_regionkey = 4 THEN 'off' ELSE 'active' END, NULL, NULL, r_regionkey % 2 = 0, r_regionkey < 2 FROM region),
act AS (SELECT * FROM subs WHERE status = 'active'), ev AS (SELECT *, seq % 2 = 0 AS created FROM observation),
matches AS (SELECT sid AS subscription_id, id AS event_id FROM (SELECT sid, id, created, on_create, on_update FROM ev JOIN act ON field = 'subject' AND wanted = subject
 UNION ALL SELECT sid, id, created, on_create, on_update FROM ev JOIN act ON field = 'code' AND wanted = code
 UNION ALL SELECT sid, id, created, on_create, on_update FROM ev, act WHERE field IS NULL) WHERE COALESCE(CASE WHEN created THEN on_create ELSE on_update END, TRUE))"""


def _subscribed(spark, sf_dir):
    """All observations; a subscription of every customer to the own ones, of every nation to a code, of every region to all."""
    o, c, n, r = tables(spark, sf_dir, "observation", "customer", "nation", "region")
    kind = "string"

    def subs(df, mark, key, status, field, value, on_create, on_update):
        columns = {"status": status, "resource_type": F.lit("Observation"), "field": field, "value": value, "on_create": on_create, "on_update": on_update}
        return df.select(F.concat(F.lit(mark), key.cast("string")).alias("id"), *[x.alias(name) for name, x in columns.items()])

    k, m, g = F.col("c_custkey"), F.col("n_nationkey"), F.col("r_regionkey")
    own = subs(c, "s", k, F.when(k % 4 == 0, "off").otherwise("active"), F.lit("subject"), F.concat(F.lit("Patient/"), k.cast("string")), k % 2 == 0, F.lit(True))
    code = F.when(m % 3 == 0, "8867-4").when(m % 3 == 1, "9279-1").otherwise("8480-6")
    by_code = subs(n, "n", m, F.lit("active"), F.lit("code"), code, m % 2 == 0, F.when(m % 5 != 0, m % 5 == 1))
    whole = subs(r, "r", g, F.when(g == 4, "off").otherwise("active"), F.lit(None).cast(kind), F.lit(None).cast(kind), g % 2 == 0, g < 2)
    fields = F.create_map(F.lit("code"), F.col("code"), F.lit("subject"), F.col("subject"))
    interaction = F.when(F.col("seq") % 2 == 0, "create").otherwise("update")
    events = o.select(F.col("id").alias("event_id"), F.lit("Observation").alias("resource_type"), interaction.alias("interaction"), fields.alias("fields"))
    return events, own.unionByName(by_code).unionByName(whole)


@query("match_subscriptions", sql(f"WITH {_SUBS} SELECT * FROM matches", "observation"))
def match_subscriptions(spark, sf_dir):
    return U.match_subscriptions(*_subscribed(spark, sf_dir))


@query("notification_counts", sql(f"WITH {_SUBS} SELECT subscription_id, COUNT(*) AS notifications FROM matches GROUP BY 1", "observation"))
def notification_counts(spark, sf_dir):
    return U.notification_totals(*_subscribed(spark, sf_dir))


# ---- sources


@query("put_bundles", sql("SELECT concat('Patient/', id) AS url, concat('{\"id\":\"', id, '\",\"family\":\"', family, '\"}') AS resource, 'PUT' AS method FROM patient", "patient"))
def put_bundles(spark, sf_dir):
    """All patients into bundles of 100, and out of the bundles again."""
    p = tables(spark, sf_dir, "patient")[0]
    made = B.to_put_bundles(p.select("id", F.to_json(F.struct("id", "family")).alias("body")), "Patient", 100)
    entries = F.from_json("bundle", "entry array<struct<resource: string, request: struct<method: string, url: string>>>")["entry"]
    return made.where("n <= 100").select(F.explode(entries).alias("e")).select("e.request.url", "e.resource", "e.request.method")


@query(
    "explode_contained",
    sql(
        "SELECT 'Patient' AS parent_type, id AS parent_id, 'Organization' AS resource_type, practitioner AS id FROM patient UNION ALL SELECT 'Patient', id, 'Bundle', concat('b', id) FROM patient UNION ALL SELECT 'Patient', id, 'Location', COALESCE(block, 'none') FROM patient",
        "patient",
    ),
)
def explode_contained(spark, sf_dir):
    p = tables(spark, sf_dir, "patient")[0]
    one = lambda kind, key: F.struct(F.lit(kind).alias("resourceType"), key.alias("id"))
    place = F.struct(one("Location", F.coalesce("block", F.lit("none"))).alias("resource"))
    bundle = F.struct(F.lit("Bundle").alias("resourceType"), F.concat(F.lit("b"), "id").alias("id"), F.array(place).alias("entry"))
    held = F.array(F.to_json(one("Organization", F.col("practitioner"))), F.to_json(bundle))
    body = F.concat(F.lit('{"resourceType":"Patient","id":"'), "id", F.lit('","contained":['), F.array_join(held, ","), F.lit("]}"))
    return B.explode_contained(p.select(body.alias("body"))).select("parent_type", "parent_id", "resource_type", "id")


@query(
    "extensions",
    sql(
        "SELECT id, CASE WHEN seq % 3 = 0 THEN NULL ELSE family END AS code, CASE WHEN block IS NULL THEN NULL ELSE stored_total END AS got, CASE WHEN block IS NULL THEN 1 ELSE 2 END AS n, CAST(seq % 9 AS INT) AS set_to FROM patient",
        "patient",
    ),
)
def extensions(spark, sf_dir):
    """The first code of a concept, and one extension read, set or added, for all patients."""
    p = tables(spark, sf_dir, "patient")[0]
    kind = "struct<url: string, valueInteger: int>"
    coding = F.array(F.struct(F.lit("s").alias("system"), F.col("family").alias("code")), F.struct(F.lit("t").alias("system"), F.lit("x").alias("code")))
    concept = F.struct(F.when(F.col("seq") % 3 != 0, coding).alias("coding"))
    held = F.array(*[F.struct(F.lit(u).alias("url"), v.cast("int").alias("valueInteger")) for u, v in (("other", F.lit(1)), ("total", F.col("stored_total")))])
    rows = p.select("id", "seq", concept.alias("concept"), F.when(F.col("block").isNotNull(), held).alias("ext"))
    put = S.set_extension(F.col("ext"), "total", "valueInteger", (F.col("seq") % 9).cast("int"), kind)
    rows = rows.withColumn("put", put)
    return rows.select(
        "id",
        S.first_code(F.col("concept")).alias("code"),
        S.get_extension(F.col("ext"), "total")["valueInteger"].alias("got"),
        F.size("put").alias("n"),
        S.get_extension(F.col("put"), "total")["valueInteger"].alias("set_to"),
    )
