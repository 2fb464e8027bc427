"""Cohorts: compartments, interval overlap, prefetch, measures and care gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.joins import hinted
from wardline.operators.search import where_in_codes


def during(df: DataFrame, start: str, end: str, p_start, p_end) -> DataFrame:
    """Rows whose closed period [start, end] meets [p_start, p_end]; a null end is open."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (p_start, p_end))
    return df.where((F.col(start) <= high) & (F.col(end).isNull() | (F.col(end) >= low)))


def overlap_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of rows with an equal key whose closed periods meet; columns start and end on both sides, null ends open.

    The key makes it a hash join with a range test on top.
    """
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    meets = (F.col("r_end").isNull() | (F.col("l_start") <= F.col("r_end"))) & (F.col("l_end").isNull() | (F.col("r_start") <= F.col("l_end")))
    return l.join(r, (F.col(f"l_{key}") == F.col(f"r_{key}")) & meets)


def _units(at: Column, kind: str) -> Column:
    """Days of a date, seconds of a timestamp."""
    return F.unix_date(at).cast("long") if kind == "date" else F.unix_seconds(at.cast("timestamp"))


def _covering(low: Column, high: Column, levels: int) -> Column:
    """The fewest aligned bins of widths 1, 2, 4, ... that make up [low, high], as structs (level, bin); none if it is empty."""
    taken = []
    for k in range(levels):
        width = 1 << k
        first = F.floor((low + (width - 1)) / width).cast("long") if k else low
        last = F.floor((high + 1) / width).cast("long") - 1 if k else high
        there = first <= last
        taken.append(F.when(there & (first % 2 == 1), F.struct(F.lit(k).alias("level"), first.alias("bin"))))
        taken.append(F.when(there & (last % 2 == 0), F.struct(F.lit(k).alias("level"), last.alias("bin"))))
    return F.array_compact(F.array(*taken))


def overlap_join_binned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of ``overlap_join`` where one key may have very many periods; null starts and keys meet nothing.

    Of two periods that meet, the one that starts later (of equal starts, the right one) starts inside the other. A
    period is covered by aligned bins of doubling width, some twenty however long it is, an open one up to the latest
    start there is; a start lies in one bin of each width. So a pair meets in exactly one bin, and the rows that come
    together in it are pairs but for the end of the last unit: a busy key is as many tasks as it has bins.
    """
    kind = left.schema["start"].dataType.typeName()
    start = _units(F.col("start"), kind)
    spans = [df.agg(F.min(start), F.max(start)).first() for df in (left, right)]
    if any(x is None for span in spans for x in span):
        return overlap_join(left.limit(0), right.limit(0), key)
    base, top = min(s[0] for s in spans), max(s[1] for s in spans)
    levels = (top - base).bit_length() + 1

    def side(df: DataFrame, name: str) -> DataFrame:
        row = df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns])
        low, high = (_units(F.col(f"{name}_start"), kind) - base, F.least(F.coalesce(_units(F.col(f"{name}_end"), kind), F.lit(1 << 62)), F.lit(top)) - base)
        row = row.withColumns({f"{name}__low": low, f"{name}__high": high, "__key": F.col(f"{name}_{key}")})
        return row.where(F.col(f"{name}__low").isNotNull() & F.col("__key").isNotNull())

    def at(points: DataFrame, name: str) -> DataFrame:
        of = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col(f"{name}__low") / (1 << k)).cast("long").alias("bin")) for k in range(levels)])
        return points.select("*", F.explode(of).alias("__bin"))

    def over(periods: DataFrame, name: str, low: Column) -> DataFrame:
        return periods.select("*", F.explode(_covering(low, F.col(f"{name}__high"), levels)).alias("__bin"))

    l, r = side(left, "l"), side(right, "r")
    later_right = over(l, "l", F.col("l__low")).join(at(r, "r"), ["__key", "__bin"])
    later_left = at(l, "l").join(over(r, "r", F.col("r__low") + 1), ["__key", "__bin"])
    columns = [f"l_{c}" for c in left.columns] + [f"r_{c}" for c in right.columns]
    meets = (F.col("r_end").isNull() | (F.col("l_start") <= F.col("r_end"))) & (F.col("l_end").isNull() | (F.col("r_start") <= F.col("l_end")))
    return later_right.select(*columns).unionByName(later_left.select(*columns)).where(meets)


def everything(patients: DataFrame, resources: dict[str, DataFrame]) -> DataFrame:
    """(patient_id, resource_type, id): the patients (id) and all of their resources (patient_id, id)."""
    own = patients.select(F.col("id").alias("patient_id"), F.lit("Patient").alias("resource_type"), "id")
    ids = patients.select(F.col("id").alias("patient_id")).distinct()
    parts = [
        df.join(ids, "patient_id", "left_semi").select("patient_id", F.lit(name).alias("resource_type"), "id")
        for name, df in resources.items()
    ]
    return reduce(DataFrame.unionByName, parts, own)


def missing_prefetch(requests: DataFrame, required: list[str]) -> DataFrame:
    """Requests (prefetch: map) that lack an item: columns as given plus ``missing``."""
    items = F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce(F.map_keys("prefetch"), F.array().cast("array<string>")))
    return requests.withColumn("missing", items).where(F.size("missing") > 0)


ITEMS = ("patient", "medication_requests", "conditions", "encounters", "service_requests", "observations")


def prefetch_rows(cohort: DataFrame, tables: dict[str, DataFrame], lab_codes: DataFrame, as_of: Column, observations_as_of: Column | None = None) -> DataFrame:
    """Long form (patient_id, item, resource_type, id) of the six items.

    Tables: patient (id), medication_request (id, patient_id, status, category, intent, medication_id),
    medication (id), condition (id, patient_id, category, clinical_status), encounter (id, patient_id,
    period_start), service_request (id, patient_id, status), observation (id, patient_id, category, code, at).
    """
    ids = cohort.select("patient_id").distinct()
    since = F.add_months(as_of, -12)
    since_obs = F.add_months(as_of if observations_as_of is None else observations_as_of, -12)
    mine = lambda df: df.join(ids, "patient_id", "left_semi")
    part = lambda df, item, kind: df.select("patient_id", F.lit(item).alias("item"), F.lit(kind).alias("resource_type"), "id")
    t = tables
    requests = mine(t["medication_request"].where("status = 'active' AND category = 'community' AND intent = 'order'"))
    medications = requests.select("patient_id", F.col("medication_id").alias("id")).distinct().join(t["medication"].select("id"), "id", "left_semi")
    diagnoses = t["condition"].where(F.col("category").isin("encounter-diagnosis", "health-concern", "problem-list-item") & (F.col("clinical_status") == "active"))
    labs = where_in_codes(t["observation"].where((F.col("category") == "laboratory") & (F.col("at") >= since_obs)), "code", lab_codes)
    parts = [
        part(mine(t["patient"].withColumn("patient_id", F.col("id"))), ITEMS[0], "Patient"),
        part(requests, ITEMS[1], "MedicationRequest"),
        part(medications, ITEMS[1], "Medication"),
        part(mine(diagnoses), ITEMS[2], "Condition"),
        part(mine(t["encounter"].where(F.col("period_start") >= since)), ITEMS[3], "Encounter"),
        part(mine(t["service_request"].where(F.col("status").isin("active", "completed"))), ITEMS[4], "ServiceRequest"),
        part(mine(labs), ITEMS[5], "Observation"),
    ]
    return reduce(DataFrame.unionByName, parts)


def prefetch(cohort: DataFrame, tables: dict[str, DataFrame], lab_codes: DataFrame, as_of: Column, observations_as_of: Column | None = None) -> DataFrame:
    """One row per patient of the cohort with an array of (resource_type, id) per item; items without rows are empty."""
    rows = prefetch_rows(cohort, tables, lab_codes, as_of, observations_as_of)
    entry = F.struct("resource_type", "id")
    wide = rows.groupBy("patient_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("item") == i, entry))).alias(i) for i in ITEMS])
    empty = F.array().cast("array<struct<resource_type: string, id: string>>")
    joined = cohort.select("patient_id").distinct().join(wide, "patient_id", "left")
    return joined.select("patient_id", *[F.coalesce(i, empty).alias(i) for i in ITEMS])


FLAGS = ("initial_population", "denominator", "exclusion", "numerator")


def evaluate_measure(flags: DataFrame, report_type: str = "population") -> DataFrame:
    """Counts and score of a proportion measure from boolean flags per patient.

    Being in a group needs the one before: the denominator is inside the initial population, exclusion and
    numerator inside the denominator, and an excluded patient is in no numerator. Score = numerator over
    (denominator less exclusion), null if that is 0. ``individual`` gives a row per patient.
    """
    of = lambda name: F.coalesce(F.col(name), F.lit(False))
    ip = of("initial_population")
    denominator = ip & of("denominator")
    exclusion = denominator & of("exclusion")
    numerator = denominator & ~exclusion & of("numerator")
    groups = dict(zip(FLAGS, (ip, denominator, exclusion, numerator), strict=True))
    if report_type == "individual":
        counted = flags.select("patient_id", *[c.cast("long").alias(n) for n, c in groups.items()])
    else:
        counted = flags.agg(*[F.count_if(c).alias(n) for n, c in groups.items()])
    rest = F.col("denominator") - F.col("exclusion")
    return counted.withColumn("score", F.when(rest != 0, F.try_divide(F.col("numerator").cast("double"), rest)))


def measure_flags(patients: DataFrame, facts: DataFrame, members: DataFrame, criteria: DataFrame) -> DataFrame:
    """Flags per patient for ``evaluate_measure``, from a table of criteria.

    criteria: flag (one of ``FLAGS``), part, kind, valueset_url (null: any code), period_start and period_end (dates, null:
    open), min_count (null: 1). A criterion holds for a patient with at least ``min_count`` facts of that kind whose code is
    in the value set and whose period meets the criterion's. Criteria with one flag and part are alternatives; a flag holds
    if all its parts do, and never if it has none. ``min_count`` 0 holds for everybody.

    facts: patient_id, kind, system, code, start, end (null end: open; null start: no period, meets every one). members:
    url, system, code, as ``expand_valuesets`` gives them. The criteria, a setting of at most some hundred rows, become
    counters of one aggregation over the facts, which are joined once with the value sets of their codes.
    """
    rows = criteria.collect()
    if unknown := {r["flag"] for r in rows} - set(FLAGS):
        raise ValueError(f"no such flag: {sorted(unknown)}")
    urls = sorted({r["valueset_url"] for r in rows if r["valueset_url"] is not None})
    kinds = sorted({r["kind"] for r in rows})
    named = members.where(F.col("url").isin(urls)).groupBy("system", "code").agg(F.collect_set("url").alias("urls"))  # at most one for each criterion
    held = facts.where(F.col("kind").isin(kinds)).select("patient_id", "kind", "system", "code", "start", "end").join(hinted(named), ["system", "code"], "left")

    def met(r) -> Column:
        of = F.col("kind") == r["kind"]
        if r["valueset_url"] is not None:
            of &= F.coalesce(F.array_contains("urls", r["valueset_url"]), F.lit(False))
        if r["period_end"] is not None:
            of &= F.coalesce(F.col("start") <= F.lit(r["period_end"]), F.lit(True))
        if r["period_start"] is not None:
            of &= F.col("start").isNull() | F.coalesce(F.col("end") >= F.lit(r["period_start"]), F.lit(True))
        return of

    counts = [F.count_if(met(r)).alias(f"c{k}") for k, r in enumerate(rows)]
    counted = held.groupBy("patient_id").agg(*counts) if counts else held.select("patient_id").distinct()
    flags = {}
    for flag in FLAGS:
        parts: dict = {}
        for k, r in enumerate(rows):
            if r["flag"] == flag:
                parts.setdefault(r["part"], []).append(F.coalesce(F.col(f"c{k}"), F.lit(0)) >= (1 if r["min_count"] is None else r["min_count"]))
        alternatives = [reduce(Column.__or__, p) for p in parts.values()]
        flags[flag] = reduce(Column.__and__, alternatives) if alternatives else F.lit(False)
    base = patients.select(F.col("id").alias("patient_id")).join(counted, "patient_id", "left")
    return base.select("patient_id", *[c.alias(n) for n, c in flags.items()])


def care_gaps(flags: DataFrame, status: str | None = None) -> DataFrame:
    """(patient_id, status): open-gap in the denominator, not excluded, not in the numerator; closed-gap in the numerator."""
    one = evaluate_measure(flags, "individual").where("denominator = 1 AND exclusion = 0")
    gaps = one.select("patient_id", F.when(F.col("numerator") == 1, "closed-gap").otherwise("open-gap").alias("status"))
    return gaps if status is None else gaps.where(F.col("status") == status)
