"""The early-warning flow on streams of observations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StructField, StructType

from wardline.functions.scoring import VITAL_CODES
from wardline.operators.subscriptions import match_subscriptions
from wardline.operators.vitals import patient_updates, scored

#: Observations in a drain and pause between drains of the micro-batch intake.
ROWS_PER_BATCH, PAUSE = 500, "150 milliseconds"

#: Stored rows came before any observation of the stream.
STORED_SEQ = -(1 << 62)
#: Keeps state on local disk with changelogs in the checkpoint; state variables need it.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Name of the metrics that ``run_news2_stream`` observes for each batch.
OUTCOMES = "news2_outcomes"


def vitals_stream(spark: SparkSession, path: str, schema: str, rows_per_batch: int = ROWS_PER_BATCH, rows_per_file: int = ROWS_PER_BATCH) -> DataFrame:
    """Observations from Parquet files. Spark caps a batch by files, so the row cap counts on files of a known size."""
    files = max(1, rows_per_batch // rows_per_file)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def drop_internal(events: DataFrame, flag: str = "internal") -> DataFrame:
    """Without the writes that this flow made itself."""
    return events.where(~F.coalesce(F.col(flag), F.lit(False)))


def dedupe_events(stream: DataFrame, time: str = "committed_at", delay: str = "10 minutes") -> DataFrame:
    """Each (tx, id, version) once; state is dropped when the watermark passes."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["tx", "id", "version"])


def subscription_stream(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Stream of (subscription_id, event_id); the subscriptions are a table."""
    return match_subscriptions(events, subscriptions)


class NewestPerCode(StatefulProcessor):
    """Per patient: the newest score of each vital sign; gives the total of each patient that a batch touches.

    All that is kept of a patient is one value, and rows are reduced to one for each code before it is read: a batch
    costs one read of state for a patient and at most one write, however many observations it has. With ``arrival``
    the last to come is the newest, whatever its instant. With ``late`` observations older than the watermark are left
    out. With ``idle_ms`` a patient whose newest instant lies so far behind the watermark is forgotten. With ``changes``
    a total is given only when it differs from the one before.
    """

    def __init__(self, arrival: bool = False, late: bool = False, idle_ms: int | None = None, changes: bool = True):
        self.arrival, self.late, self.idle_ms, self.changes = arrival, late, idle_ms, changes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "codes array<struct<code string, news2_value int, at_micros long, seq long>>, total int")

    def _held(self) -> tuple[dict[str, tuple[int, int, int]], int | None]:
        """(news2_value, at_micros, seq) by code, and the total."""
        held = self.newest.get()
        return ({}, None) if held is None else ({code: (value, at, seq) for code, value, at, seq in held[0]}, held[1])

    def _keep(self, held: dict[str, tuple[int, int, int]]) -> int:
        """Write a patient's state; its total."""
        total = sum(value for value, _, _ in held.values())
        self.newest.update(([(code, *row) for code, row in held.items()], total))
        if self.idle_ms is not None:  # the timer moves to the end of the idle time
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(max(at for _, at, _ in held.values()) // 1000 + self.idle_ms)
        return total

    def _replaces(self, row: tuple[int, int, int], held: tuple[int, int, int] | None) -> bool:
        if held is None:
            return True
        return row[2] > held[2] if self.arrival else (row[1], -row[2]) > (held[1], -held[2])

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._keep({row["code"]: (row["news2_value"], row["at_micros"], STORED_SEQ) for row in initialState["rows"]})

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        since = 1000 * timerValues.getCurrentWatermarkInMs() if self.late else None
        came: dict[str, tuple[int, int, int]] = {}
        for _, code, value, at, seq, *_ in rows:
            if (since is None or at >= since) and self._replaces((value, at, seq), came.get(code)):
                came[code] = (value, at, seq)
        held, before = self._held()
        newer = {code: row for code, row in came.items() if self._replaces(row, held.get(code))}
        now = self._keep(held | newer) if newer else before
        if now is not None and (now != before or not self.changes):
            yield Row(patient_id=key[0], total=now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def _newest_natively(keyed: DataFrame, arrival: bool) -> DataFrame:
    """What ``NewestPerCode`` gives without ``changes``, as Spark's own streaming aggregation: the newest of a code is the
    greatest of an order, so rows are reduced before the shuffle, and no row and no state goes through Python. The state of a
    patient is one row with a column for each of ``VITAL_CODES``, in their order."""
    order = ["seq", "at_micros"] if arrival else ["at_micros", (-F.col("seq")).alias("older")]
    newest = [F.max(F.when(F.col("code") == code, F.struct(*order, "news2_value"))) for code in VITAL_CODES]
    held = keyed.groupBy("patient_id").agg(*[n.alias(f"n{k}") for k, n in enumerate(newest)])
    total = reduce(add, [F.coalesce(F.col(f"n{k}.news2_value"), F.lit(0)) for k in range(len(newest))])
    return held.select("patient_id", total.cast("int").alias("total"))


def news2_stateful(
    stream: DataFrame,
    mode: str = "event_time",
    watermark: str | None = None,
    initial: DataFrame | None = None,
    idle_days: float | None = None,
    changes: bool = True,
    native: bool | None = None,
) -> DataFrame:
    """(patient_id, total) from state that Spark keeps: at most five codes for each patient.

    ``event_time``: only a newer observation replaces a stored one, the first arrival stays on a tie; ``arrival``:
    the last to come replaces. ``initial`` is a stored aggregate (patient_id, code, news2_value, obs_instant) that the
    first batch starts from; its rows count as older arrivals. ``watermark``, a delay, leaves out observations that come
    later than that after the newest instant of earlier batches. ``idle_days`` (with a watermark) forgets patients
    whose newest observation is so much older than the watermark; what they were last told stays as it is downstream.
    With ``changes`` a total is given when it changes, else for each patient of a batch. Without these three and without
    ``changes`` the state is that of Spark's own aggregation (``native``), else of ``NewestPerCode``; neither reads the other's
    checkpoints.
    """
    if mode not in ("arrival", "event_time"):
        raise ValueError(mode)
    if idle_days is not None and watermark is None:
        raise ValueError("patients can be forgotten only behind a watermark")
    able = watermark is None and initial is None and idle_days is None and not changes
    if native and not able:
        raise ValueError("an aggregation begins empty, leaves nothing out, forgets nobody and doesn't know what it gave before")
    rows = scored(stream).where(F.col("code").isin(*VITAL_CODES)).withColumn("at", F.col("obs_instant").cast("timestamp"))
    if watermark is not None:
        rows = rows.withWatermark("at", watermark)
    keyed = rows.select("patient_id", "code", "news2_value", F.unix_micros("at").alias("at_micros"), "seq", *(["at"] if watermark else []))
    if able and native is not False:
        return _newest_natively(keyed, mode == "arrival")
    if initial is not None:
        at = F.unix_micros(F.col("obs_instant").cast("timestamp"))
        held = F.collect_list(F.struct("code", "news2_value", at.alias("at_micros")))  # a row for each of five codes
        initial = initial.where(F.col("code").isin(*VITAL_CODES)).groupBy("patient_id").agg(held.alias("rows")).groupBy("patient_id")
    idle_ms = None if idle_days is None else int(idle_days * 86_400_000)
    return keyed.groupBy("patient_id").transformWithState(
        statefulProcessor=NewestPerCode(mode == "arrival", watermark is not None, idle_ms, changes),
        outputStructType="patient_id string, total int",
        outputMode="Update",
        timeMode="EventTime" if watermark else "None",
        initialState=initial,
    )


@contextmanager
def state_store(spark: SparkSession):
    """Session settings under which a stateful query must be started; the query keeps them, the session doesn't."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def observed_outcomes(updates: DataFrame) -> DataFrame:
    """The updates, whose counts of patients, changed and unchanged Spark reports while it makes them."""
    result = F.col("result")
    return updates.observe(
        OUTCOMES,
        F.count(F.lit(1)).alias("patients"),
        F.count_if(result == "changed").alias("changed"),
        F.count_if(result == "unchanged").alias("unchanged"),
    )


class FlowCounts(StreamingQueryListener):
    """Counts of ``observed_outcomes`` as they come: one entry a batch, in ``batches``, and their sums.

    To be added with ``spark.streams.addListener``. A batch that is run again after a failure replaces its entry.
    """

    def __init__(self):
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(OUTCOMES)
        if row is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = {k: int(row[k]) for k in ("patients", "changed", "unchanged")}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def total(self, name: str) -> int:
        return sum(b[name] for b in self.batches.values())


def news2_updates(stream: DataFrame, patients: DataFrame, **options) -> DataFrame:
    """Stream of ``patient_updates`` for the patients that a batch touches, with observed counts.

    ``patients`` (id, stored_total, block) is a table that is read again for each batch, so totals written there by the
    sink count as stored from the next batch on. Options are those of ``news2_stateful``.
    """
    return observed_outcomes(patient_updates(news2_stateful(stream, changes=False, **options), patients))


def _held_natively(spark: SparkSession, checkpoint: str) -> bool | None:
    """Whether a checkpoint's state is that of an aggregation; None if there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/state")
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return None
    operators = spark.read.format("state-metadata").load(checkpoint).select("operatorName").distinct().collect()
    return "stateStoreSave" in {r["operatorName"] for r in operators} if operators else None


def run_news2_stream(
    stream: DataFrame,
    checkpoint: str,
    patients: DataFrame,
    sink: Callable[[DataFrame, int], None],
    pause: str | None = PAUSE,
    **options,
) -> StreamingQuery:
    """Start the flow: score, newest, totals, change set; ``sink`` gets each batch's changed patients and its number.

    It drains what has arrived, waits for ``pause`` and goes on until it is stopped; with ``pause=None`` it ends
    when all that is there has been read. State and place in the input lie in ``checkpoint``: a restarted query goes on
    from the last batch that it finished, and gives an unfinished one to the sink again under the same number. Options
    are those of ``news2_stateful``; ``initial`` counts when the checkpoint is new. What keeps the state in a checkpoint goes
    on keeping it.
    """

    def step(updates: DataFrame, batch: int) -> None:
        held = updates.persist()  # state is stepped once, all of it, however the sink reads
        try:
            held.count()
            sink(held.where("result = 'changed'"), batch)
        finally:
            held.unpersist()

    with state_store(stream.sparkSession):
        options.setdefault("native", _held_natively(stream.sparkSession, checkpoint))
        if options["native"] and options.get("initial") is not None:
            options["initial"] = None  # the checkpoint isn't new
        query = news2_updates(stream, patients, **options).writeStream.outputMode("update").foreachBatch(step)
        query = query.option("checkpointLocation", checkpoint)
        return query.trigger(**({"availableNow": True} if pause is None else {"processingTime": pause})).start()


def stored_aggregate(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The aggregate that a flow keeps (patient_id, code, news2_value, obs_instant), read from its checkpoint.

    It is what ``merge_latest`` would have made of all batches so far, and can be the ``initial`` of another flow.
    """
    with state_store(spark):
        if _held_natively(spark, checkpoint):
            rows = spark.read.format("statestore").load(checkpoint)
            held = rows.schema["value"].dataType
            named = StructType([StructField(code, f.dataType) for code, f in zip(VITAL_CODES, held, strict=True)])  # all have one name there
            each = F.col("value").cast(named)
            codes = F.array(*[F.when(each[code].isNotNull(), F.struct(F.lit(code).alias("code"), each[code]["news2_value"].alias("news2_value"), each[code]["at_micros"].alias("at_micros"))) for code in VITAL_CODES])
            rows = rows.select("key", F.struct(F.array_compact(codes).alias("codes")).alias("value"))
        else:
            rows = spark.read.format("statestore").option("stateVarName", "newest").load(checkpoint)
    return rows.select(F.col("key.patient_id").alias("patient_id"), F.explode("value.codes").alias("n")).select(
        "patient_id", "n.code", "n.news2_value", F.timestamp_micros("n.at_micros").cast("timestamp_ntz").alias("obs_instant")
    )
