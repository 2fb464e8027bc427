"""Operators on small literal rows: nested searches, writes, measures, linkage, hooks."""

import json
import re
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wardline.operators import cohort, history, hooks, linkage, refs, search, subscriptions, terminology, vitals
from wardline.plans.adapters import tables
from wardline.sources import layout


def test_nested_searches(spark):
    coding = "struct<coding: array<struct<system: string, code: string>>>"
    kind = f"struct<type: {coding}, system: string, value: string>"
    rows = [
        ("1", ([("s", "a"), ("t", "b")],), [(([("v2", "MR")],), "x", "7"), (([("v2", "SS")],), "x", "8")]),
        ("2", ([(None, "a")],), [(([("v2", "MR")],), "x", "8")]),
        ("3", None, []),
    ]
    df = spark.createDataFrame(rows, f"id string, code {coding}, identifier array<{kind}>")
    ids = lambda x: sorted(r["id"] for r in x.collect())
    assert ids(search.where_token(df, "code", ["t|b"])) == ["1"]
    assert ids(search.where_token(df, "code", ["|a"])) == ["2"]
    assert ids(search.where_token(df, "code", ["a"])) == ["1", "2"]
    assert ids(search.where_token(df, "code", ["s|"])) == ["1"]
    assert ids(search.where_identifier_of_type(df, "v2", "MR", "8")) == ["2"]
    assert ids(search.where_missing(df, "identifier", True)) == ["3"]
    many = [f"c{k}" for k in range(200)] + ["7"]
    flat = spark.createDataFrame([("1", "7"), ("2", "9")], "id string, code string")
    assert ids(search.where_token(flat, "code", many)) == ["1"]


def test_merge_is_insensitive_to_batches(spark):
    at = lambda d: datetime(2024, 1, d)
    rows = [("p", "c", 1, at(3), 0), ("p", "c", 2, at(5), 1), ("p", "c", 3, at(5), 2), ("q", "c", 4, at(1), 3)]
    df = spark.createDataFrame(rows, "patient_id string, code string, news2_value int, obs_instant timestamp_ntz, seq long")
    df = df.withColumn("code", F.lit("8867-4"))
    whole = sorted(map(tuple, vitals.latest_vitals(df).collect()))
    for cut in range(5):
        first, second = (vitals.latest_vitals(df.where(c)) for c in (f"seq < {cut}", f"seq >= {cut}"))
        assert sorted(map(tuple, vitals.merge_latest(first, second).collect())) == whole
    older = vitals.latest_vitals(df.where("seq = 0"))
    arrived = vitals.merge_latest(vitals.latest_vitals(df), older, "arrival").where("patient_id = 'p'").first()
    assert arrived["news2_value"] == 1


def test_block_deltas_give_the_fresh_rollup(spark):
    old = spark.createDataFrame([("1", "A", 5), ("2", "A", 2), ("3", "B", 1)], "patient_id string, block string, score long")
    new = spark.createDataFrame([("1", "B", 6), ("2", "A", 2), ("4", "C", 3)], "patient_id string, block string, score long")
    roll = lambda df: vitals.block_rollup(df.withColumnRenamed("score", "total"), df)
    changed = vitals.apply_block_deltas(roll(old), vitals.block_deltas(old, new)).where("patient_count > 0")
    columns = ["block", "total_score", "patient_count", "average"]
    assert sorted(map(tuple, changed.select(columns).collect())) == sorted(map(tuple, roll(new).select(columns).collect()))


def test_block_deltas_stop_at_zero(spark):
    agg = spark.createDataFrame([("A", 1, 0)], "block string, total_score long, patient_count long")
    deltas = spark.createDataFrame([("A", -5, -1)], "block string, d_score long, d_count long")
    assert tuple(vitals.apply_block_deltas(agg, deltas).first()) == ("A", 0, 0, 0.0)


def test_missing_patient_fails_if_asked(spark):
    totals = spark.createDataFrame([("1", 3), ("9", 1)], "patient_id string, total int")
    patients = spark.createDataFrame([("1", 3, "A")], "id string, stored_total int, block string")
    assert [r["result"] for r in vitals.patient_updates(totals, patients).collect()] == ["unchanged"]
    with pytest.raises(Exception, match="no such patient"):
        vitals.patient_updates(totals, patients, on_missing="error").collect()


@pytest.mark.parametrize(("numerator", "score"), [(True, 1.0), (False, 0.0)])
def test_measure_reports(spark, numerator, score):
    flags = spark.createDataFrame([("p", True, True, False, numerator)], "patient_id string, initial_population boolean, denominator boolean, exclusion boolean, numerator boolean")
    report = cohort.evaluate_measure(flags).first()
    assert tuple(report) == (1, 1, 0, int(numerator), score)
    assert cohort.care_gaps(flags, "open-gap").count() == int(not numerator)


def test_measure_without_denominator(spark):
    flags = spark.createDataFrame([("p", True, True, True, True)], "patient_id string, initial_population boolean, denominator boolean, exclusion boolean, numerator boolean")
    assert tuple(cohort.evaluate_measure(flags).first()) == (1, 1, 1, 0, None)


def test_missing_prefetch(spark):
    df = spark.createDataFrame([("a", {"patient": "x"}), ("b", {"patient": "x", "labs": "y"}), ("c", None)], "id string, prefetch map<string, string>")
    got = {r["id"]: sorted(r["missing"]) for r in cohort.missing_prefetch(df, ["patient", "labs"]).collect()}
    assert got == {"a": ["labs"], "c": ["labs", "patient"]}


def test_ten_writers(spark):
    current = spark.createDataFrame([("x", 1)], "id string, version_id int")
    updates = spark.createDataFrame([("x", 1, k) for k in range(10)], "id string, base_version int, arrival long")
    plain = history.resolve_updates(current, updates, retry=False).groupBy("status").count().collect()
    assert dict(map(tuple, plain)) == {"applied": 1, "conflict": 9}
    tried = history.resolve_updates(current, updates, retry=True).orderBy("arrival").collect()
    assert [r["version_id"] for r in tried] == list(range(2, 12))


def test_multiple_deletes_need_leave(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "id string, v string")
    assert history.delete_where(df, F.col("v") == "b", multiple=False).count() == 2
    with pytest.raises(Exception, match="matches rows"):
        history.delete_where(df, F.col("v") == "a", multiple=False).collect()


def test_conditional_create_keeps_null_keys(spark):
    new = spark.createDataFrame([("1", None, 1), ("2", None, 2), ("3", "k", 3), ("4", "k", 4)], "id string, key string, seq long")
    existing = spark.createDataFrame([], "id string, key string")
    assert sorted(r["id"] for r in history.conditional_create(new, existing, "key").collect()) == ["1", "2", "3"]


def test_cascade_follows_cycles_once(spark):
    rows = [("T", "2", "p", "T", "1"), ("T", "3", "p", "T", "2"), ("T", "1", "p", "T", "3"), ("T", "9", "p", "T", "8")]
    links = spark.createDataFrame(rows, "src_type string, src_id string, path string, ref_type string, ref_id string")
    start = spark.createDataFrame([("T", "1")], "resource_type string, id string")
    assert sorted(tuple(r) for r in refs.cascade_delete(start, links).collect()) == [("T", "1", 0), ("T", "2", 1), ("T", "3", 2)]


def test_golden_ids_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(60)] + [("x", "y")], "a string, b string")
    got = {r["id"]: r["golden_id"] for r in linkage.golden_ids(links).collect()}
    assert got == {f"{k:03d}": "000" for k in range(61)} | {"x": "x", "y": "x"}


def test_match_over_several_given_names(spark):
    people = spark.createDataFrame(
        [("1", ["Anna", "Marie"], "Meyer"), ("2", ["Maria"], "Maier"), ("3", ["Peter"], "Maier"), ("4", None, None)], "id string, given array<string>, family string"
    )
    pairs = spark.createDataFrame([("1", "2"), ("2", "3"), ("1", "4")], "a string, b string")
    got = {(r["a"], r["b"]): r["result"] for r in linkage.mdm_match(pairs, linkage.phonetic_keys(people)).collect()}
    assert got == {("1", "2"): "MATCH", ("2", "3"): "NO_MATCH", ("1", "4"): "NO_MATCH"}


def _entries(spark, *rows):
    kind = "resource_type string, id string, method string, body string, seq int"
    return spark.createDataFrame([("Patient", i, m, None if m == "DELETE" else f"{m} {k}", k) for k, (i, m) in enumerate(rows)], kind)


def test_bundles_in_a_row(spark):
    """Creates never update, versions outlive deletes in the bundle and after it, deletes of nothing are nothing."""
    table = spark.createDataFrame([], "resource_type string, id string, version_id int, body string, deleted boolean")
    state = lambda df: {r["id"]: (r["version_id"], r["body"], r["deleted"]) for r in df.collect() if not r["id"].startswith("new-")}
    first = _entries(spark, ("1", "PUT"), ("2", "PUT"), ("2", "PUT"), ("2", "DELETE"), ("2", "DELETE"), ("3", "PUT"), ("3", "DELETE"), ("3", "PUT"), ("4", "DELETE"), (None, "PUT"), ("1", "GET"))
    table = history.apply_bundle(table, first)
    assert state(table) == {"1": (1, "PUT 0", False), "2": (3, None, True), "3": (3, "PUT 7", False)}
    table = spark.createDataFrame(table.collect(), table.schema)
    second = _entries(spark, ("1", "POST"), ("2", "PUT"), ("3", "DELETE"), ("1", "DELETE"), ("1", "PUT"), (None, "POST"), ("4", "PUT"))
    after = history.apply_bundle(table, second)
    assert state(after) == {"1": (3, "PUT 4", False), "2": (4, "PUT 1", False), "3": (4, None, True), "4": (1, "PUT 6", False)}
    made = [tuple(r)[2:] for r in after.where("id like 'new-%'").collect()]
    assert sorted(made) == [(1, "POST 0", False), (1, "POST 5", False)]
    again = history.apply_bundle(table, second)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, after.collect()))
    assert state(history.apply_bundle(spark.createDataFrame(after.collect(), after.schema), _entries(spark, ("2", "DELETE"), ("2", "PUT"))))["2"] == (6, "PUT 1", False)


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_bundle_entries_in_spans(spark, span):
    """However the entries of an id are cut into spans, they apply as one after the other."""
    rng = random.Random(4)
    steps = [(str(rng.randrange(6)), rng.choice(["PUT", "DELETE", "DELETE", "POST"])) for _ in range(120)]
    start = {"0": (5, "old", False), "1": (2, None, True), "7": (1, "alone", False)}
    want = dict(start)
    for k, (i, method) in enumerate(steps):
        version, _, gone = want.get(i, (0, None, True))
        if method == "PUT":
            want[i] = (version + 1, f"PUT {k}", False)
        elif method == "DELETE" and not gone:
            want[i] = (version + 1, None, True)
    current = spark.createDataFrame([("Patient", i, *v) for i, v in start.items()], "resource_type string, id string, version_id int, body string, deleted boolean")
    after = history.apply_bundle(current, _entries(spark, *steps), span)
    assert {r["id"]: tuple(r)[2:] for r in after.collect() if not r["id"].startswith("new-")} == want
    assert after.where("id like 'new-%'").count() == sum(m == "POST" for _, m in steps)


def test_structural_diff_of_nested_resources(spark):
    """A birth date, a nested member, array members that come and go, a type that changes, gaps in the numbers, repeats."""
    bodies = {
        ("1", 1): {"birthDate": "2020-01-01", "name": [{"family": "A", "given": ["x", "y"]}], "active": True},
        ("1", 2): {"birthDate": "2025-01-01", "name": [{"family": "A", "given": ["x"]}], "active": True},
        ("1", 7): {"birthDate": "2025-01-01", "name": [{"family": "B", "given": ["x", "z"]}], "active": "true", "address": {}},
        ("1", 8): {"birthDate": "2025-01-01", "name": [{"family": "B", "given": ["x", "z"]}], "active": "true", "address": {"city": {"a": {"b": 1}}}},
        ("2", 3): {"birthDate": "1990-01-01"},
        ("3", 1): None,
        ("3", 2): {"a": None},
    }
    rows = [(i, v, None if b is None else json.dumps(b)) for (i, v), b in bodies.items()]
    versions = spark.createDataFrame(rows, "id string, version_id int, body string")
    want = [
        ("1", 2, "Patient.birthDate", "replace", '"2020-01-01"', '"2025-01-01"'),
        ("1", 2, "Patient.name[0].given[1]", "delete", '"y"', None),
        ("1", 7, "Patient.active", "replace", "true", '"true"'),
        ("1", 7, "Patient.address", "insert", None, "{}"),
        ("1", 7, "Patient.name[0].family", "replace", '"A"', '"B"'),
        ("1", 7, "Patient.name[0].given[1]", "insert", None, '"z"'),
        ("1", 8, "Patient.address", "delete", "{}", None),
        ("1", 8, "Patient.address.city.a.b", "insert", None, "1"),
        ("3", 2, "Patient.a", "insert", None, "null"),
    ]
    assert sorted(map(tuple, history.structural_diff(versions, root=F.lit("Patient")).collect())) == want
    shallow = history.structural_diff(versions, root=F.lit("Patient"), depth=1).where("version_id = 8").collect()
    assert [tuple(r) for r in shallow] == [("1", 8, "Patient.address", "replace", "{}", '{"city":{"a":{"b":1}}}')]
    parsed = versions.withColumn("body", F.parse_json("body"))
    assert sorted(map(tuple, history.structural_diff(parsed, root=F.lit("Patient")).collect())) == want
    assert history.structural_diff(versions.limit(0)).collect() == []


def test_structural_diff_walks_no_deeper_than_its_bodies(spark):
    """Brackets in strings count for nothing; three levels are three generators and the one that pairs; roots that change."""
    rows = [("1", 1, '{"a":"}{[\\"[[","b":[{"c":1}],"same":{"d":[1,2]}}', "P"), ("1", 2, '{"a":"x","b":[{"c":2},3],"same":{"d":[1,2]}}', "P"), ("1", 3, '{"a":"x"}', "Q")]
    versions = spark.createDataFrame(rows, "id string, version_id int, body string, kind string")
    got = history.structural_diff(versions, root=F.col("kind"))
    want = [
        (2, "P.a", "replace", json.dumps('}{["[['), '"x"'), (2, "P.b[0].c", "replace", "1", "2"), (2, "P.b[1]", "insert", None, "3"),
        (3, "P.a", "delete", '"x"', None), (3, "P.b[0].c", "delete", "2", None), (3, "P.b[1]", "delete", "3", None),
        (3, "P.same.d[0]", "delete", "1", None), (3, "P.same.d[1]", "delete", "2", None), (3, "Q.a", "insert", None, '"x"'),
    ]
    assert sorted((r[1:] for r in got.collect()), key=str) == sorted(want, key=str)
    assert len(re.findall(r"Generate ", got._jdf.queryExecution().optimizedPlan().toString())) == 4


def test_versions_of_one_busy_id_follow_each_other(spark):
    """Spans of 100 numbers, some of them empty: each version is followed by the next there is."""
    numbers = [k for k in range(1, 2000) if k % 7 and not 300 <= k < 650]
    versions = spark.createDataFrame([("a", k) for k in numbers] + [("b", 5)], "id string, version_id int").repartition(3)
    got = {(r["id"], r["version_id"]): (r["following"], r["first"]) for r in history.next_versions(versions, 100).collect()}
    assert got == {("a", k): (n, k == 1) for k, n in zip(numbers, [*numbers[1:], None], strict=True)} | {("b", 5): (None, True)}


PERSON = "resource_type string, id string, active boolean, birthdate date, identifier array<string>, practitioner string, given string, family string"


def _people(spark, rows):
    return spark.createDataFrame(rows, PERSON)


def test_candidates_by_type_and_once(spark):
    """Two blocks in common are one pair; practitioners block on identifiers alone; types never meet; nulls never block."""
    day = date(1970, 1, 1)
    rows = [
        ("Patient", "1", True, day, ["a", "b", None, "a"], "x", "Anna", "Meyer"),
        ("Patient", "2", True, day, ["b", "a"], "x", "Hanna", "Maier"),
        ("Patient", "3", True, None, None, None, "Anna", "Meyer"),
        ("Patient", "4", False, day, ["a"], "x", "Anna", "Meyer"),
        ("Patient", "5", True, day, [None], "y", "Peter", "Meyer"),
        ("Practitioner", "1", True, day, ["a"], "x", "Anna", "Meyer"),
        ("Practitioner", "2", True, day, ["z"], "x", "Anna", "Meyer"),
        ("Practitioner", "3", True, None, ["a"], "x", "Anna", "Weber"),
        ("Device", "1", True, day, ["a"], "x", "Anna", "Meyer"),
        ("Device", "2", True, day, ["a"], "x", "Anna", "Meyer"),
    ]
    people = _people(spark, rows)
    want = [("Patient", "1", "2"), ("Patient", "1", "5"), ("Patient", "2", "5"), ("Practitioner", "1", "3")]
    assert sorted(map(tuple, linkage.mdm_candidates(people).collect())) == want
    compared = {tuple(r[:3]): r["result"] for r in linkage.mdm_compare(people).collect()}
    assert compared == dict(zip(want, ["MATCH", "NO_MATCH", "NO_MATCH", "POSSIBLE_MATCH"], strict=True))
    assert {tuple(r[:3]): r["result"] for r in linkage.mdm_links(people).collect()} == {k: v for k, v in compared.items() if v != "NO_MATCH"}
    assert linkage.mdm_candidates(people.limit(0)).collect() == []
    plan = linkage.mdm_candidates(people)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [a" not in plan and "Deduplicate" not in plan


def test_a_busy_block_is_cut_into_cells(spark):
    """3,000 patients of one practitioner, some sharing identifiers, in cells of 250: every pair once, no cell above its bounds."""
    people = spark.range(3000).selectExpr("'Patient' resource_type", "cast(id as string) id", "true active", "cast(null as date) birthdate", "array(cast(id % 100 as string)) identifier", "'busy' practitioner")
    records = linkage._records(people, linkage.RULES, [], None)
    pairs = linkage.paired(records, 250).select("a.id", F.col("b.id").alias("b")).persist()
    assert pairs.count() == pairs.distinct().count() == 3000 * 2999 // 2
    assert pairs.where("id >= b").isEmpty()
    parts = people.select(F.pmod(F.xxhash64("id"), F.lit(12)).alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
    assert parts <= 330
    pairs.unpersist()


def test_pairs_of_few_rows_are_dealt_over_tasks(spark):
    """A few hundred records of many shared keys and given names: each pair once and judged as by hand; the pairs are made by
    a shuffle in more tasks than the records' bytes would get, never in a broadcast's few."""
    rng = random.Random(7)
    names = ["Maria", "Marie", "Peter", "Anna", "Klaus"]
    rows = [(t, str(k), True, None, rng.sample([str(n) for n in range(120)], 9), "x", rng.sample(names, rng.choice([1, 1, 2])), rng.choice(["Meyer", "Maier", None])) for t in ("Patient", "Practitioner") for k in range(120)]
    people = spark.createDataFrame(rows, PERSON.replace("given string", "given array<string>"))
    code = {"Maria": "67", "Marie": "67", "Peter": "127", "Anna": "06", "Klaus": "458"}
    judged = {}
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[1] < y[1] and (x[0] == "Patient" or set(x[4]) & set(y[4])):
                given = bool({code[g] for g in x[6]} & {code[g] for g in y[6]})
                family = x[7] is not None and y[7] is not None
                judged[x[:2] + (y[1],)] = ("MATCH" if family else "POSSIBLE_MATCH") if given else "NO_MATCH"
    got = [tuple(r) for r in linkage.mdm_candidates(people).collect()]
    assert len(got) == len(judged) and set(got) == set(judged)
    compared = [(tuple(r[:3]), r["result"]) for r in linkage.mdm_compare(people).collect()]
    assert len(compared) == len(judged) and dict(compared) == judged
    links = [(tuple(r[:3]), r["result"]) for r in linkage.mdm_links(people).collect()]
    assert sorted(links) == sorted((k, v) for k, v in judged.items() if v != "NO_MATCH")
    for df in (linkage.mdm_candidates(people), linkage.mdm_compare(people), linkage.mdm_links(people)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"SortMergeJoin \[key#\d+, i#\d+, j#\d+\]", plan) and plan.count("16), REPARTITION_BY_NUM") == 2


def test_a_record_walks_through_the_array_of_its_cell(spark, monkeypatch):
    """900 patients of one practitioner in nine parts, some ids null, one there twice: the pairs of SQL, none of a record with
    itself or with no id; ids are compared in the nine cells of one part alone, and tasks grow with the pairs."""
    monkeypatch.setattr(linkage, "CELL", 100)
    monkeypatch.setattr(linkage, "PAIRS_OF_A_TASK", 10_000)
    people = spark.range(900).selectExpr("'Patient' resource_type", "case when id % 50 <> 7 then cast(id as string) end id", "true active", "cast(null as date) birthdate", "array(cast(id % 90 as string)) identifier", "'busy' practitioner")
    people = people.unionByName(people.where("id = '11'"))
    pairs = linkage.mdm_candidates(people)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    n = 900 - 18 + 1
    assert plan.count(f"{(n * (n - 1) // 2 + 90 * 45) // 10_000}), REPARTITION_BY_NUM") == 2
    assert "Generate explode(ys" in plan and "least(" not in plan
    ids = [str(k) for k in range(900) if k % 50 != 7]
    want = {(a, b) for a in ids for b in ids if a < b}
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want) + len(ids) - 1  # the pairs of the one that is there twice


def test_a_second_key_for_busy_blocks(spark):
    """20,000 patients of one practitioner: above 1,000 they must agree in the birth date too; the report says what is lost."""
    people = spark.range(20_000).selectExpr("'Patient' resource_type", "cast(id as string) id", "true active", "case when id % 5 > 0 then date_add(date'1950-01-01', cast(id % 4000 as int)) end birthdate", "array(cast(null as string)) identifier", "'busy' practitioner")
    rules = linkage.RULES | {"blocks": [("Patient", "practitioner")]}
    got = linkage.mdm_candidates(people, rules, over=(1000, "birthdate"))
    assert got.count() == 3200 * 10  # 16,000 with a date, five of each date
    (row,) = linkage.left_out(people, 1000, "birthdate", rules).collect()
    assert tuple(row) == ("Patient", "practitioner", "busy", 20_000, 20_000 * 19_999 // 2, 32_000)
    assert linkage.left_out(people, 20_000, "birthdate", rules).collect() == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_grow_with_batches_of_any_split(spark, seed):
    rng = random.Random(seed)
    links = [(f"{rng.randrange(70):02d}", f"{rng.randrange(70):02d}") for _ in range(60)]
    kind = "a string, b string"
    whole = {r["id"]: r["golden_id"] for r in linkage.golden_ids(spark.createDataFrame(links, kind)).collect()}
    cuts = sorted(rng.sample(range(61), 2))
    labels = spark.createDataFrame([], "id string, golden_id string")
    for batch in (links[: cuts[0]], links[cuts[0] : cuts[1]], links[cuts[1] :]):
        old = {r["id"]: r["golden_id"] for r in labels.collect()}
        changed, merges = linkage.grow_golden_ids(labels, spark.createDataFrame(batch, kind))
        labels = spark.createDataFrame(linkage.relabelled(labels, changed).collect(), "id string, golden_id string")
        new = {r["id"]: r["golden_id"] for r in labels.collect()}
        assert len(new) == labels.count()
        assert {r["id"] for r in changed.collect()} == {k for k in new if old.get(k) != new[k]}
        assert {tuple(r) for r in merges.collect()} == {(old[k], new[k]) for k in old if old[k] != new[k]}
    assert new == whole


def _periods(spark, rows, kind):
    return spark.createDataFrame(rows, "id int, who string, start string, end string").select("id", "who", F.col("start").cast(kind).alias("start"), F.col("end").cast(kind).alias("end"))


@pytest.mark.parametrize("kind", ["date", "timestamp"])
def test_binned_overlaps_are_those_of_the_plain_join(spark, kind):
    """Random, open, empty, equal and inverted periods, null keys and starts."""
    rng = random.Random(9)

    def day(k):
        moment = datetime(2001, 1, 1) + timedelta(days=k, hours=(k * 7) % 24 if kind == "timestamp" else 0)
        return moment.isoformat(sep=" ")

    def rows():
        out = [(k, rng.choice(["x", "y"]), day(s := rng.randrange(900)), rng.choice([None, day(s), day(s + rng.randrange(1, 500)), day(s - 3)])) for k in range(80)]
        return [*out, (80, None, day(1), None), (81, "x", None, day(5)), (82, "z", day(0), None)]

    left, right = _periods(spark, rows(), kind), _periods(spark, rows(), kind)
    want = cohort.overlap_join(left, right, "who").where("l_start is not null and r_start is not null")
    got = cohort.overlap_join_binned(left, right, "who")
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert cohort.overlap_join_binned(left, right.limit(0), "who").collect() == []


def test_a_patient_with_very_many_periods_is_many_bins(spark):
    """6,000 short stays of one patient on each side: pairs as in the plain join, and no bin holds a twentieth of the rows."""
    stays = spark.range(6000).selectExpr("cast(id as int) id", "'busy' who", "date_add(date'1990-01-01', cast(id as int)) start", "date_add(date'1990-01-01', cast(id + id % 4 as int)) end")
    got = cohort.overlap_join_binned(stays, stays, "who").select("l_id", "r_id")
    want = cohort.overlap_join(stays, stays, "who").select("l_id", "r_id")
    assert got.count() == got.distinct().count() == want.count()
    assert got.exceptAll(want).isEmpty()
    bins = stays.select(F.explode(cohort._covering(F.datediff("start", F.lit("1990-01-01")).cast("long"), F.datediff("end", F.lit("1990-01-01")).cast("long"), 13)).alias("b"))
    assert bins.groupBy("b").count().agg(F.max("count")).first()[0] <= 4 and bins.count() < 3 * 6000


def test_measures_from_criteria(spark):
    """Alternatives of one part, parts together, minimum counts, periods, kinds, flags without criteria."""
    patients = spark.createDataFrame([(k,) for k in "abcdef"], "id string")
    day = date(2020, 5, 1)
    facts = spark.createDataFrame(
        [
            ("a", "Visit", "s", "v1", day, day),
            ("a", "Visit", "s", "v1", date(2021, 1, 1), None),
            ("a", "Test", "s", "t", None, None),
            ("b", "Visit", "s", "v2", date(2019, 1, 1), date(2019, 2, 1)),
            ("b", "Call", "s", "v2", day, None),
            ("c", "Visit", "s", "v1", date(2019, 1, 1), None),
            ("d", "Visit", None, None, day, day),
            ("e", "Visit", "s", "other", day, day),
            (None, "Visit", "s", "v1", day, day),
        ],
        "patient_id string, kind string, system string, code string, start date, end date",
    )
    members = spark.createDataFrame([("visits", "s", "v1"), ("visits", "s", "v2"), ("tests", "s", "t"), ("tests", "s", "t")], "url string, system string, code string")
    rule = "flag string, part string, kind string, valueset_url string, period_start date, period_end date, min_count int"
    first, last = date(2020, 1, 1), date(2020, 12, 31)
    criteria = [
        ("initial_population", "seen", "Visit", "visits", first, last, None),
        ("initial_population", "seen", "Call", "visits", first, last, None),
        ("denominator", "p", "Visit", "visits", None, None, 0),
        ("numerator", "often", "Visit", "visits", None, None, 2),
        ("numerator", "tested", "Test", "tests", None, None, 1),
    ]
    flags = cohort.measure_flags(patients, facts, members, spark.createDataFrame(criteria, rule))
    got = {r["patient_id"]: tuple(r[1:]) for r in flags.collect()}
    seen, unseen = (True, True, False), (False, True, False)
    assert got == {"a": (*seen, True), "b": (*seen, False), "c": (*seen, False), **{k: (*unseen, False) for k in "def"}}
    assert tuple(cohort.evaluate_measure(flags).first()) == (3, 3, 0, 1, pytest.approx(1 / 3))
    none = cohort.measure_flags(patients, facts, members, spark.createDataFrame([], rule))
    assert [tuple(r[1:]) for r in none.collect()] == [(False,) * 4] * 6
    with pytest.raises(ValueError):
        cohort.measure_flags(patients, facts, members, spark.createDataFrame([("other", "p", "Visit", None, None, None, None)], rule))


def test_valueset_limit(spark):
    compose = spark.createDataFrame([("u", "s", None)], "url string, system string, code string")
    concepts = spark.createDataFrame([("s", str(k)) for k in range(5)], "system string, code string")
    assert terminology.expand_valuesets(compose, concepts, 5).count() == 5
    assert terminology.expand_valuesets(compose, concepts, 3, on_large="cut").count() == 3
    with pytest.raises(Exception, match="too large"):
        terminology.expand_valuesets(compose, concepts, 4).collect()


def test_quantity_units(spark):
    df = spark.createDataFrame([("1", Decimal("1.5"), "g"), ("2", Decimal("900"), "mg"), ("3", Decimal("2"), "ml")], "id string, value decimal(18,6), unit string")
    units = spark.createDataFrame([("g", "g", Decimal("1")), ("mg", "g", Decimal("0.001"))], "unit string, base string, factor decimal(9,3)")
    assert sorted(r["id"] for r in search.where_quantity(df, "gt", "1000", "mg", units).collect()) == ["1"]


def test_null_trigger_counts_as_true(spark):
    events = spark.createDataFrame([("e", "Patient", "create", {})], "event_id string, resource_type string, interaction string, fields map<string, string>")
    subs = spark.createDataFrame([("s", "active", "Patient", None, None, None, None)], "id string, status string, resource_type string, field string, value string, on_create boolean, on_update boolean")
    assert [tuple(r) for r in subscriptions.match_subscriptions(events, subs).collect()] == [("s", "e")]


def test_subscription_counts_equal_matches(spark):
    events = spark.createDataFrame(
        [("1", "O", "create", {"a": "x", "b": "y"}), ("2", "O", "update", {"a": "x"}), ("3", "P", "create", {"a": "x"}), ("4", "O", "create", None)],
        "event_id string, resource_type string, interaction string, fields map<string, string>",
    )
    kind = "id string, status string, resource_type string, field string, value string, on_create boolean, on_update boolean"
    subs = spark.createDataFrame(
        [("s1", "active", "O", "a", "x", True, False), ("s2", "active", "O", None, None, None, True), ("s3", "off", "O", "a", "x", True, True), ("s4", "active", "O", "b", "y", True, True), ("s5", "active", "O", "b", None, True, True)], kind
    )
    matches = subscriptions.match_subscriptions(events, subs)
    assert sorted(map(tuple, matches.collect())) == [("s1", "1"), ("s2", "1"), ("s2", "2"), ("s2", "4"), ("s4", "1")]
    counted = lambda df: sorted(map(tuple, df.collect()))
    assert counted(subscriptions.notification_counts(matches)) == counted(subscriptions.notification_totals(events, subs))


def test_times_of_day(spark):
    moments = ["2024-01-01 08:00:00", "2024-01-01 10:00:00", "2024-01-01 10:00:30.5", "2024-01-01 10:01:00", "2024-01-02 00:00:00", None]
    df = spark.createDataFrame([(k, m) for k, m in enumerate(moments)], "id int, m string").select("id", F.col("m").cast("timestamp_ntz").alias("at"))
    ids = lambda x: sorted(r["id"] for r in search.where_date(df, "at", x).collect())
    assert ids("ge2024-01-01T10:00:00") == [1, 2, 3, 4]
    assert ids("2024-01-01T10:00") == [1, 2] and ids("2024-01-01T10:00:30") == [2] and ids("2024-01-01T10:00:30.5") == [2]
    assert ids("gt2024-01-01T10:00") == ids("sa2024-01-01T10:00") == [3, 4]
    assert ids("eb2024-01-01") == [] and ids("lt2024-01-01T12:00:00+02:00") == [0] and ids("le2024-01-01T10:00:00Z") == [0, 1]
    assert ids("ne2024-01-01") == [4] and ids("2024") == [0, 1, 2, 3, 4]
    for wrong in ("ap2024-01-01", "xx2024", "ge2024-1-1", "ge2024-01-01T1"):
        with pytest.raises(ValueError, match="no "):
            search.date_predicate("at", wrong)


def test_long_token_lists_with_systems(spark):
    df = spark.createDataFrame([("1", [("s", "a")]), ("2", [(None, "a"), ("t", "z")]), ("3", [("u", "b")]), ("4", None)], "id string, code array<struct<system: string, code: string>>")
    ids = lambda tokens: sorted(r["id"] for r in search.where_token(df, "code", tokens).collect())
    many = [f"s|c{k}" for k in range(300)] + [f"d{k}" for k in range(300)]
    assert ids(many) == [] and ids([*many, "s|a"]) == ["1"] and ids([*many, "|a"]) == ["2"] and ids([*many, "t|"]) == ["2"] and ids([*many, "a"]) == ["1", "2"]


def test_pages_follow_on_in_every_order(spark):
    rows = [(k, None if k % 4 == 0 else k % 3, None if k % 5 == 0 else k % 2) for k in range(23)]
    df = spark.createDataFrame(rows, "id int, a int, b int")
    for keys in (["id"], ["-id"], ["a", "-b", "id"], ["-a", "b", "-id"]):
        want = [r["id"] for r in search.page(df, keys, 0, 100).collect()]
        got, last = [], None
        while part := search.page_after(df, keys, last, 4).collect():
            got += [r["id"] for r in part]
            last = tuple(part[-1][k.lstrip("-")] for k in keys)
        assert got == want


def test_index_of_arrays(spark):
    kind = "id string, name array<struct<family: string, given: array<string>>>, code struct<coding: array<struct<system: string, code: string>>>, n int"
    df = spark.createDataFrame([("1", [("A", ["x", "y"]), ("A", None), (None, ["x"])], ([("s", "1"), (None, "2"), ("s", None)],), 4), ("2", None, None, None)], kind)
    specs = {"family": ("string", "name.family"), "given": ("string", "name.given"), "code": ("token", "code.coding"), "n": ("number", "n")}
    got = sorted((r["id"], r["parameter"], r["value"]) for r in search.search_index(df, "T", specs).collect())
    assert got == [("1", "code", "s|1"), ("1", "code", "|2"), ("1", "family", "A"), ("1", "given", "x"), ("1", "given", "y"), ("1", "n", "4")]


def test_tenant_reads_leave_other_files_alone(spark, tmp_path):
    df = terminology.assign_patient_partition(spark.createDataFrame([(str(k), k % 3) for k in range(60)], "patient_id string, tenant int"), 4)
    terminology.write_partitioned(df, str(tmp_path / "t"))
    for other in ("tenant=0", "tenant=2"):  # a read of tenant 1 would fail on these
        for part in (tmp_path / "t" / other).rglob("*.parquet"):
            part.write_bytes(b"broken")
            (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    whole = spark.read.schema("patient_id string, tenant int, partition_id int").parquet(str(tmp_path / "t"))
    assert terminology.for_tenant(whole, 1).count() == 20


def test_hooks_and_operations(spark):
    registry = hooks.HookRegistry()

    @registry.on_create("Patient")
    def first(df):
        return df.withColumn("marks", F.array(F.lit("a")))

    @registry.on_create("Patient")
    def second(df):
        return df.withColumn("marks", F.array_append("marks", F.lit("b")))

    df = spark.createDataFrame([("1",)], "id string")
    assert registry.apply(df, "Patient", "create").first()["marks"] == ["a", "b"]
    assert registry.apply(df, "Patient", "update").columns == ["id"]
    operations = hooks.OperationRegistry()
    operations.register("count", lambda df: df.groupBy().count())
    assert operations.call("count", df=df).first()[0] == 1
    with pytest.raises(ValueError, match="registered"):
        operations.register("count", lambda df: df)
    with pytest.raises(KeyError):
        operations.call("nothing", df=df)


def test_flow_over_tables_laid_out_by_patient(spark, sf_dir, tmp_path):
    """Newest, merge, totals and change set over bucketed tables without an exchange, with the rows of the plain tables."""
    obs, patients = tables(spark, sf_dir, "observation", "patient")
    columns = ["id", "seq", "subject", "issued", "effective", "code", "value"]
    old, new = (obs.where(f"seq % 2 = {k}").select(*columns) for k in (0, 1))
    plain = vitals.patient_updates(vitals.patient_totals(vitals.merge_latest(*(vitals.latest_vitals(vitals.scored(x)) for x in (old, new)))), patients)
    names = [f"laid_{k}" for k in range(3)]
    try:
        first, second = (layout.save_by_patient(x, n, 4) for x, n in zip((old, new), names[:2], strict=True))
        people = layout.save_by_patient(patients.withColumn("patient_id", F.col("id")), names[2], 4).select(F.col("patient_id").alias("id"), "stored_total", "block")
        newest = [vitals.latest_vitals(vitals.scored(x)) for x in (first, second)]
        totals = vitals.patient_totals(newest[0])
        laid = vitals.patient_updates(totals, people.hint("merge"))
        assert "Exchange" not in laid._jdf.queryExecution().executedPlan().toString()
        merged = vitals.patient_updates(vitals.patient_totals(vitals.merge_latest(*newest)), people)
        assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, plain.collect()))
        assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, vitals.patient_totals(vitals.latest_vitals(vitals.scored(old))).collect()))
    finally:
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_partitions_are_even(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 10 > 0, F.col("id") % 1000).alias("patient_id"))
    placed = terminology.assign_portable_partition(rows, 8)
    got = {r["partition_id"]: r for r in terminology.partition_balance(placed, 8).collect()}
    assert sorted(got) == list(range(9)) and got[0]["rows"] == 400 and got[0]["patients"] == 0 and got[0]["times_even"] is None
    assert sum(r["patients"] for r in got.values()) == 900 and all(0.7 < r["times_even"] < 1.3 for k, r in got.items() if k)
    assert {r["rows"] for r in terminology.partition_balance(placed.limit(0), 2).collect()} == {0}
