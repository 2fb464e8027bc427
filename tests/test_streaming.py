"""Streams give what one batch over all rows gives."""

import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from wardline.operators import vitals as V
from wardline.plans.adapters import tables
from wardline.streaming import vitals as ST

SCHEMA = "id string, seq long, subject string, issued timestamp_ntz, effective timestamp_ntz, code string, value decimal(18,2)"


def _files(spark, sf_dir, path, n=4):
    obs = tables(spark, sf_dir, "observation")[0].select("id", "seq", "subject", "issued", "effective", "code", "value")
    for k in range(n):
        obs.where(f"seq % {n} = {k}").coalesce(1).write.mode("append").parquet(path)
    return obs


def _flow(spark, path, checkpoint, patients, **options):
    """Run the flow over what is there; gives the batches' changed patients with their new totals."""
    sent = []
    sink = lambda df, batch: sent.append((batch, sorted((r["patient_id"], r["new_total"]) for r in df.collect())))
    query = ST.run_news2_stream(ST.vitals_stream(spark, str(path), SCHEMA), str(checkpoint), patients, sink, pause=None, **options)
    query.awaitTermination(180)
    assert query.exception() is None
    return sent, query


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    """Batches, a restart between them, and the counts seen by a listener give what one batch over all rows gives."""
    obs = tables(spark, sf_dir, "observation")[0].select("id", "seq", "subject", "issued", "effective", "code", "value")
    patients = tables(spark, sf_dir, "patient")[0]
    counts = ST.FlowCounts()
    spark.streams.addListener(counts)
    want = {"changed": 0, "unchanged": 0, "patients": 0}
    for k in range(2):  # the second run goes on from the checkpoint of the first
        obs.where(f"seq % 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sent, _ = _flow(spark, tmp_path / "in", tmp_path / "cp", patients)
        so_far = V.latest_vitals(V.scored(obs.where(f"seq % 2 <= {k}")))
        touched = V.affected_patients(obs.where(f"seq % 2 = {k}"), obs.limit(0))
        updates = V.patient_updates(V.patient_totals(so_far).join(touched, "patient_id", "left_semi"), patients)
        assert [s[0] for s in sent] == [k]
        assert sent[0][1] == _rows(updates.where("result = 'changed'").select("patient_id", "new_total"))
        for result, n in map(tuple, V.update_outcomes(updates).collect()):
            want[result] += n
            want["patients"] += n
        assert _rows(ST.stored_aggregate(spark, str(tmp_path / "cp"))) == _rows(so_far)
    for _ in range(50):  # listeners are told a little later
        if len(counts.batches) >= 2:
            break
        time.sleep(0.2)
    spark.streams.removeListener(counts)
    assert {k: counts.total(k) for k in want} == want and want["changed"] and want["unchanged"]


def test_stream_begins_with_a_stored_aggregate(spark, sf_dir, tmp_path):
    """Old half as the stored table, new half as the stream: ``merge_latest`` in both modes; patients without news stay."""
    obs = tables(spark, sf_dir, "observation")[0].select("id", "seq", "subject", "issued", "effective", "code", "value")
    patients = tables(spark, sf_dir, "patient")[0]
    old, new = obs.where("seq % 2 = 1"), obs.where("seq % 2 = 0 AND cast(substr(subject, 9) as int) % 3 = 0")
    new.coalesce(1).write.parquet(str(tmp_path / "in"))
    stored = V.latest_vitals(V.scored(old))
    for mode in ("event_time", "arrival"):
        sent, _ = _flow(spark, tmp_path / "in", tmp_path / mode, patients, mode=mode, initial=stored)
        newest = V.latest_vitals(V.scored(new)) if mode == "event_time" else _last_arrived(V.scored(new))
        want = V.merge_latest(stored, newest, mode)
        assert _rows(ST.stored_aggregate(spark, str(tmp_path / mode))) == _rows(want)
        totals = V.patient_totals(want).join(V.affected_patients(new, new), "patient_id", "left_semi")
        assert sent[0][1] == _rows(V.patient_updates(totals, patients).where("result = 'changed'").select("patient_id", "new_total"))
    # the state of one flow is the beginning of another
    again, _ = _flow(spark, tmp_path / "in", tmp_path / "again", patients, initial=ST.stored_aggregate(spark, str(tmp_path / "event_time")))
    assert _rows(ST.stored_aggregate(spark, str(tmp_path / "again"))) == _rows(ST.stored_aggregate(spark, str(tmp_path / "event_time")))


def _last_arrived(scores):
    return scores.groupBy("patient_id", "code").agg(F.max_by(F.struct("news2_value", "obs_instant"), "seq").alias("n")).select("patient_id", "code", "n.*")


def test_a_batch_that_failed_is_given_again(spark, sf_dir, tmp_path):
    """The sink fails on the second batch; the restarted flow gives that batch once more, with the same rows."""
    obs = _files(spark, sf_dir, str(tmp_path / "in"), 3)
    patients = tables(spark, sf_dir, "patient")[0]
    seen = []

    def sink(df, batch):
        seen.append((batch, _rows(df)))
        if len(seen) == 2:
            raise RuntimeError("lost")

    start = lambda: ST.run_news2_stream(ST.vitals_stream(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "cp"), patients, sink, pause=None)
    query = start()
    with pytest.raises(StreamingQueryException):
        query.awaitTermination(120)
    start().awaitTermination(120)
    assert [b for b, _ in seen] == [0, 1, 1, 2] and seen[1] == seen[2]
    assert _rows(ST.stored_aggregate(spark, str(tmp_path / "cp"))) == _rows(V.latest_vitals(V.scored(obs)))


def test_a_batch_writes_state_of_its_own_patients(spark, tmp_path):
    """500 stored patients; a batch of 500 observations of ten of them puts at most ten times five codes and a total."""
    codes = ["9279-1", "59408-5", "8867-4", "8480-6", "8310-5"]
    stored = spark.range(500).select(F.col("id").cast("string").alias("patient_id"), F.explode(F.array(*map(F.lit, codes))).alias("code"), F.lit(1).alias("news2_value"), F.lit("2024-01-01").cast("timestamp_ntz").alias("obs_instant"))
    patients = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit(5).alias("stored_total"), F.lit("East").alias("block"))

    def batch(first):
        rows = spark.range(first, first + 500).selectExpr(
            "cast(id as string) id", "id seq", "concat('Patient/', id % 10) subject", "timestamp_ntz'2024-02-01' + make_interval(0, 0, 0, 0, 0, 0, id) issued",
            "cast(null as timestamp_ntz) effective", f"array({', '.join(repr(c) for c in codes)})[id div 10 % 5] code", "cast(20 + id % 90 as decimal(18,2)) value")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    batch(0)
    _flow(spark, tmp_path / "in", tmp_path / "cp", patients, initial=stored)
    batch(500)
    _, query = _flow(spark, tmp_path / "in", tmp_path / "cp", patients, initial=stored)
    state = query.lastProgress["stateOperators"][0]
    assert 0 < state["numRowsUpdated"] <= 60 and state["customMetrics"]["rocksdbPutCount"] <= 200
    assert ST.stored_aggregate(spark, str(tmp_path / "cp")).count() == 2500


def test_a_patient_is_one_row_of_state(spark, tmp_path):
    """Ten patients with forty observations each of all five codes: one row of state is written for a patient, in both modes."""
    rows = spark.range(2000).selectExpr(
        "cast(id as string) id", "id seq", "concat('Patient/', id % 10) subject", "timestamp_ntz'2024-02-01' + make_interval(0, 0, 0, 0, 0, 0, id * 7 % 2003) issued",
        "cast(null as timestamp_ntz) effective", "array('9279-1', '59408-5', '8867-4', '8480-6', '8310-5')[id div 10 % 5] code", "cast(20 + id % 90 as decimal(18,2)) value")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    patients = spark.range(10).select(F.col("id").cast("string").alias("id"), F.lit(5).alias("stored_total"), F.lit("East").alias("block"))
    for mode, newest in (("event_time", V.latest_vitals), ("arrival", _last_arrived)):
        _, query = _flow(spark, tmp_path / "in", tmp_path / mode, patients, mode=mode)
        assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]) <= 10 * 3
        assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 10
        assert _rows(ST.stored_aggregate(spark, str(tmp_path / mode))) == _rows(newest(V.scored(rows)))


def test_the_flow_runs_on_spark_s_own_aggregation(spark, tmp_path):
    """No row or state of the flow goes through Python; it sends and keeps what the processor does, ties and late rows too, and a
    checkpoint that the processor began is gone on with by the processor."""
    def batch(first):
        rows = spark.range(first, first + 1500).selectExpr(
            "cast(id as string) id", "id seq", "concat('Patient/', id % 9) subject", "if(id % 6 = 0, null, timestamp_ntz'2024-02-01' + make_interval(0, 0, 0, 0, 0, 0, id * 7 % 40)) issued",
            "cast(null as timestamp_ntz) effective", "array('9279-1', '59408-5', '8867-4', '8480-6', '8310-5', 'other', null)[id div 9 % 7] code", "cast(20 + id * 13 % 90 as decimal(18,2)) value")
        rows.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        return rows

    patients = spark.range(8).select(F.col("id").cast("string").alias("id"), F.lit(5).alias("stored_total"), F.lit("East").alias("block"))
    rows = batch(0)
    for mode, newest in (("event_time", V.latest_vitals), ("arrival", lambda scores: _last_arrived(scores.where("code like '%-%'")))):
        sent, query = _flow(spark, tmp_path / "in", tmp_path / mode, patients, mode=mode)
        plan = query._jsq.explainInternal(False)
        assert "StateStoreSave" in plan and "Python" not in plan and "TransformWithState" not in plan
        again, _ = _flow(spark, tmp_path / "in", tmp_path / f"{mode}-2", patients, mode=mode, native=False)
        assert sent == again and len(sent) == 3
        want = _rows(newest(V.scored(rows)))
        assert want == _rows(ST.stored_aggregate(spark, str(tmp_path / mode))) == _rows(ST.stored_aggregate(spark, str(tmp_path / f"{mode}-2")))
    rows = rows.unionByName(batch(1500))
    sent, _ = _flow(spark, tmp_path / "in", tmp_path / "event_time", patients)
    again, query = _flow(spark, tmp_path / "in", tmp_path / "event_time-2", patients)
    assert "TransformWithState" in query._jsq.explainInternal(False) and sent == again and [b for b, _ in sent] == [3, 4, 5]
    want = _rows(V.latest_vitals(V.scored(rows)))
    assert want == _rows(ST.stored_aggregate(spark, str(tmp_path / "event_time"))) == _rows(ST.stored_aggregate(spark, str(tmp_path / "event_time-2")))
    with pytest.raises(ValueError):
        ST.news2_stateful(ST.vitals_stream(spark, str(tmp_path / "in"), SCHEMA), native=True)


def test_idle_patients_are_forgotten(spark, tmp_path):
    """Patient 1 is last seen in January; when the watermark is in March its state is gone and patient 2's is not."""
    patients = spark.createDataFrame([("1", None, "East"), ("2", None, "East")], "id string, stored_total int, block string")
    for seq, (who, at) in enumerate([("1", "2024-01-05"), ("2", "2024-03-05"), ("2", "2024-03-06"), ("2", "2024-03-07")]):
        df = spark.createDataFrame([(str(seq), seq, f"Patient/{who}", at, "8867-4", "131")], "id string, seq long, subject string, issued string, code string, value string")
        df = df.selectExpr("id", "seq", "subject", "cast(issued as timestamp_ntz) issued", "cast(null as timestamp_ntz) effective", "code", "cast(value as decimal(18,2)) value")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        _flow(spark, tmp_path / "in", tmp_path / "cp", patients, watermark="1 hour", idle_days=30)
    assert [r["patient_id"] for r in ST.stored_aggregate(spark, str(tmp_path / "cp")).collect()] == ["2"]
    with pytest.raises(ValueError):
        ST.news2_stateful(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), idle_days=30)


def test_stream_goes_on_until_it_is_stopped(spark, sf_dir, tmp_path):
    obs = _files(spark, sf_dir, str(tmp_path / "in"), 1)
    seen = []
    query = ST.run_news2_stream(ST.vitals_stream(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "cp"), tables(spark, sf_dir, "patient")[0], lambda df, batch: seen.append(batch))
    query.processAllAvailable()
    assert seen == [0] and query.isActive
    obs.where("seq % 50 = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    assert seen == [0, 1]


def test_late_observations(spark, tmp_path):
    """Three batches of one patient: with a watermark the late one is left out, by arrival it replaces, by event time it doesn't."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("1", 1, "2024-01-05 00:00:00", "131"), ("2", 2, "2024-01-05 00:00:01", "9"), ("3", 3, "2024-01-01 00:00:00", "60")]
    codes = {1: "8867-4", 2: "8867-4", 3: "8867-4"}
    for k, (i, seq, at, value) in enumerate(rows):
        df = spark.createDataFrame([(i, seq, "Patient/1", at, codes[seq], value)], "id string, seq long, subject string, issued string, code string, value string")
        df = df.selectExpr("id", "seq", "subject", "cast(issued as timestamp_ntz) issued", "cast(null as timestamp_ntz) effective", "code", "cast(value as decimal(18,2)) value")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 if k < 2 else 0)  # files are read in the order of their times
    last = {}
    for name, options in {"event": {}, "arrival": {"mode": "arrival"}, "late": {"mode": "arrival", "watermark": "1 hour"}}.items():
        stream = ST.news2_stateful(ST.vitals_stream(spark, str(tmp_path / "in"), SCHEMA), **options)
        query = stream.writeStream.format("memory").queryName(f"late_{name}").outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
        last[name] = [r["total"] for r in spark.table(f"late_{name}").collect()]
    assert last == {"event": [3], "arrival": [3, 0], "late": [3]}


def test_stateful_totals(spark, sf_dir, tmp_path):
    obs = _files(spark, sf_dir, str(tmp_path / "in"), 2)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = ST.news2_stateful(ST.vitals_stream(spark, str(tmp_path / "in"), SCHEMA))
    query = stream.writeStream.format("memory").queryName("totals").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    got = {}
    for r in spark.table("totals").collect():
        got[r["patient_id"]] = r["total"]
    expected = dict(map(tuple, V.patient_totals(V.latest_vitals(V.scored(obs))).collect()))
    assert got == expected



def test_events_enter_once(spark, tmp_path):
    rows = [("t1", "a", 1, "2024-01-01 00:00:00", False), ("t1", "a", 1, "2024-01-01 00:00:01", False), ("t2", "b", 1, "2024-01-01 00:00:02", True)]
    kind = "tx string, id string, version int, committed_at string, internal boolean"
    spark.createDataFrame(rows, kind).withColumn("committed_at", F.to_timestamp("committed_at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind.replace("committed_at string", "committed_at timestamp")).parquet(str(tmp_path / "in"))
    once = ST.dedupe_events(ST.drop_internal(stream))
    query = once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["tx"], r["id"]) for r in spark.table("once").collect()] == [("t1", "a")]


def test_subscription_stream(spark, tmp_path):
    kind = "event_id string, resource_type string, interaction string, fields map<string, string>"
    spark.createDataFrame([("1", "Observation", "create", {"status": "final"}), ("2", "Observation", "create", {"status": "draft"})], kind).write.parquet(str(tmp_path / "in"))
    subs = spark.createDataFrame([("s", "active", "Observation", "status", "final", True, False)], "id string, status string, resource_type string, field string, value string, on_create boolean, on_update boolean")
    matches = ST.subscription_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), subs)
    query = matches.writeStream.format("memory").queryName("matches").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in spark.table("matches").collect()] == [("s", "1")]


def test_many_subscriptions_are_not_collected_for_each_batch(spark, tmp_path):
    """20,000 subscriptions, small in bytes, meet a stream of two batches by shuffle; the few to a whole type are broadcast."""
    rows = spark.range(40_000).selectExpr("cast(id as string) event_id", "'Observation' resource_type", "'create' interaction", "map('subject', cast(id % 25000 as string)) fields")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    subs = spark.range(20_001).selectExpr("concat('s', id) id", "'active' status", "'Observation' resource_type", "if(id < 20000, 'subject', null) field", "if(id < 20000, cast(id as string), null) value", "true on_create", "true on_update")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = ST.subscription_stream(stream, subs).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(120)
    plan = query._jsq.explainInternal(False).split("== Initial Plan ==")[0]
    assert plan.count("SortMergeJoin") == 1, [line.strip()[:90] for line in plan.splitlines() if "Join" in line]
    want = rows.selectExpr("concat('s', fields['subject']) s", "event_id").where("cast(substr(s, 2) as int) < 20000").unionByName(rows.selectExpr("'s20000' s", "event_id"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
