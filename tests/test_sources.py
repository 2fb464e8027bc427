"""Bundles, line-delimited JSON, exports, put bundles, contained resources, and a relational round trip."""

import json

import pytest
from pyspark.sql import functions as F

from wardline.operators import history
from wardline.sources import records as R
from wardline.sources import staging

BUNDLE = {
    "resourceType": "Bundle",
    "id": "b1",
    "type": "transaction",
    "entry": [
        {"resource": {"resourceType": "Patient", "id": "1", "name": [{"family": "X"}]}, "request": {"method": "PUT", "url": "Patient/1"}},
        {"resource": {"resourceType": "Patient"}, "request": {"method": "POST", "url": "Patient"}},
    ],
}


def test_bundles(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(BUNDLE, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(BUNDLE | {"id": "b2", "type": "batch"}))
    (tmp_path / "c.json").write_text(json.dumps({"resourceType": "Patient", "id": "9"}))
    rows = R.read_bundles(spark, str(tmp_path), ["transaction"]).orderBy("seq").collect()
    assert [(r["bundle_id"], r["resource_type"], r["id"], r["method"], r["url"]) for r in rows] == [
        ("b1", "Patient", "1", "PUT", "Patient/1"),
        ("b1", "Patient", None, "POST", "Patient"),
    ]
    assert json.loads(rows[0]["body"])["name"] == [{"family": "X"}]
    assert R.read_bundles(spark, str(tmp_path)).count() == 4


def test_transaction_with_posts_without_ids_and_deletes_by_url(spark, tmp_path):
    """Read and applied: three creates without ids stay three, the delete is told by its URL, ids count for their type."""
    patient = lambda **more: {"resourceType": "Patient", **more}
    entry = [
        {"resource": patient(gender="female"), "request": {"method": "POST", "url": "Patient"}},
        {"resource": patient(gender="male"), "request": {"method": "POST", "url": "Patient"}},
        {"resource": {"resourceType": "Observation", "status": "final"}, "request": {"method": "POST", "url": "Observation"}},
        {"resource": patient(id="5", active=True), "request": {"method": "PUT", "url": "Patient/5"}},
        {"request": {"method": "DELETE", "url": "Patient/7"}},
        {"request": {"method": "DELETE", "url": "http://server/base/Observation/7/_history/3"}},
        {"request": {"method": "GET", "url": "Patient?name=x"}},
    ]
    (tmp_path / "t.json").write_text(json.dumps({"resourceType": "Bundle", "type": "transaction", "entry": entry}))
    rows = R.read_bundles(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["resource_type"], r["id"]) for r in rows] == [("Patient", None), ("Patient", None), ("Observation", None), ("Patient", "5"), ("Patient", "7"), ("Observation", "7"), ("Patient", None)]
    current = spark.createDataFrame([("Patient", "7", 1, "old"), ("Patient", "8", 4, "stays"), ("Observation", "5", 2, "other type")], "resource_type string, id string, version_id int, body string")
    apply = lambda: sorted((r["resource_type"], r["id"], r["version_id"]) for r in history.apply_bundle(current, R.read_bundles(spark, str(tmp_path))).collect())
    after = apply()
    assert after == apply()  # a retry gives the same ids
    new = [r for r in after if r[1].startswith("new-")]
    assert [r[0] for r in new] == ["Observation", "Patient", "Patient"] and len({r[1] for r in new}) == 3 and {r[2] for r in new} == {1}
    assert [r for r in after if r not in new] == [("Observation", "5", 2), ("Patient", "5", 1), ("Patient", "8", 4)]


def test_ndjson(spark, tmp_path):
    (tmp_path / "x.ndjson").write_text('{"id": "1", "n": 2}\n\n{"id": \n{"id": "2"}\n')
    good, bad = R.read_ndjson(spark, str(tmp_path), "id string, n int")
    assert sorted(map(tuple, good.collect())) == [("1", 2), ("2", None)]
    assert [r["value"] for r in bad.collect()] == ['{"id": ']


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("Patient", "1"), ("Encounter", "2"), ("Patient", "3")], "resource_type string, id string")
    R.bulk_export(df, str(tmp_path / "out"), types=["Patient"])
    assert [p.name for p in (tmp_path / "out").iterdir() if p.is_dir()] == ["resource_type=Patient"]
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert {t: x.count() for t, x in R.split_types(df, ["Patient", "Encounter"]).items()} == {"Patient": 2, "Encounter": 1}


def test_put_bundles(spark):
    df = spark.createDataFrame([(str(k) if k else None, json.dumps({"k": k})) for k in range(7)], "id string, body string")
    made = lambda n: sorted(r["bundle"] for r in R.to_put_bundles(df.repartition(n), "Patient", 3).collect())
    assert made(1) == made(4)  # however the rows are spread
    bundles = [json.loads(b) for b in made(2)]
    assert sorted(len(b["entry"]) for b in bundles) == [1, 3, 3]
    urls = sorted(e["request"]["url"] for b in bundles for e in b["entry"])
    assert urls == ["Patient"] + [f"Patient/{k}" for k in range(1, 7)]
    assert all(b["type"] == "transaction" and e["request"]["method"] == "PUT" for b in bundles for e in b["entry"])


def test_contained(spark):
    inner = {"resourceType": "Bundle", "id": "in", "entry": [{"resource": {"resourceType": "Patient", "id": "p"}}]}
    body = {"resourceType": "MeasureReport", "id": "m", "contained": [inner, {"resourceType": "List", "id": "l"}]}
    df = spark.createDataFrame([(json.dumps(body),), (json.dumps({"resourceType": "Patient", "id": "q"}),)], "body string")
    rows = R.explode_contained(df).collect()
    assert sorted((r["parent_id"], r["resource_type"], r["id"]) for r in rows) == [("m", "Bundle", "in"), ("m", "List", "l"), ("m", "Patient", "p")]


def test_typed_bundles_are_the_same_rows(spark, tmp_path):
    """Variant bodies, parsed by the reader: same rows, same bodies, no parse of text after it."""
    more = [{"request": {"method": "DELETE", "url": "Patient/7"}}, {"resource": {"resourceType": "Observation", "valueQuantity": {"value": 1.5}, "note": ["é", None]}, "request": {"method": "POST", "url": "Observation"}}]
    (tmp_path / "a.json").write_text(json.dumps(BUNDLE | {"entry": BUNDLE["entry"] + more}, indent=2))
    plain, typed = (R.read_bundles(spark, str(tmp_path), typed=t) for t in (False, True))
    assert typed.schema["body"].dataType.typeName() == "variant"
    pick = lambda df, body: sorted(((*map(str, r[:8]), json.loads(r[8]) if r[8] else None) for r in df.withColumn("body", body).collect()), key=str)
    assert pick(plain, F.col("body")) == pick(typed, F.to_json("body"))
    plan = typed._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and "parseJson" not in plan


def test_resources_of_any_type(spark, tmp_path):
    lines = [{"resourceType": "Observation", "id": "1", "valueQuantity": {"value": 2}}, {"resourceType": "Odd", "id": "2", "valueOdd": [1]}, {"resourceType": "Patient", "id": "3", "values": 1}]
    (tmp_path / "x.ndjson").write_text("\n".join([*map(json.dumps, lines), "", "{no", "[1]", "3"]))
    rows, bad = R.read_resources(spark, str(tmp_path))
    value = R.polymorphic(F.col("body"), "value")
    got = rows.select("resource_type", "id", value["kind"].alias("kind"), F.to_json(value["value"]).alias("value"))
    assert sorted(map(tuple, got.collect())) == [("Observation", "1", "Quantity", '{"value":2}'), ("Odd", "2", "Odd", "[1]"), ("Patient", "3", None, None)]
    assert sorted(r["value"] for r in bad.collect()) == ["3", "[1]", "{no"]


def test_contained_of_typed_bodies(spark):
    inner = {"resourceType": "Bundle", "id": "in", "entry": [{"resource": {"resourceType": "Patient", "id": "p"}}, {}]}
    body = {"resourceType": "MeasureReport", "id": "m", "contained": [inner, {"resourceType": "List", "id": "l"}]}
    df = spark.createDataFrame([(json.dumps(body),), ('{"id": "none"}',), ('{"contained": {}}',), (None,)], "body string")
    plain, typed = R.explode_contained(df), R.explode_contained(df.withColumn("body", F.parse_json("body"))).withColumn("body", F.to_json("body"))
    assert sorted(map(str, plain.collect())) == sorted(map(str, typed.collect())) and plain.count() == 4
    assert plain._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1


def test_relational_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.range(100).selectExpr("id", "id * 2 AS twice")
    R.write_table(df, url, "NEWS2_AGG", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    back = R.read_table(spark, url, "NEWS2_AGG", "id", (0, 100, 4), driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert back.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, back.collect())) == [(k, 2 * k) for k in range(100)]


def test_staged_folders(spark, tmp_path, monkeypatch):
    df = staging.staged(spark.range(5), "test-clean")
    assert df.count() == 5
    folder = staging.scratch_dir(spark).removeprefix("file:")
    assert spark.sparkContext.applicationId in folder
    monkeypatch.setattr(staging, "scratch_dir", lambda s: f"file:{tmp_path}/scratch")
    (tmp_path / "scratch").mkdir()
    staging.clean_scratch(spark)
    assert not (tmp_path / "scratch").exists()


def test_scopes_end_with_their_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "scratch_dir", lambda s: f"file:{tmp_path}")
    kept = staging.new_path(spark, "kept")
    with staging.scope(spark, "step"):
        inner = staging.staged(spark.range(4), "inner")
        with staging.scope(spark, "deeper"):
            staging.staged(spark.range(2), "inner")
        assert inner.count() == 4 and len([p for p in tmp_path.rglob("inner-*") if p.is_dir()]) == 1
        result = staging.write(inner, kept)
    assert result.count() == 4 and [p.name for p in tmp_path.iterdir()] == [kept.rpartition("/")[2]]
    staging.delete(spark, kept)
    assert list(tmp_path.iterdir()) == []


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app-1"

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        staging.scratch_dir(Session)
