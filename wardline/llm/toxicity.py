"""Toxicity by maximum-scoring segments of token log-odds, judged by extreme-value statistics.

Log-odds are posterior means under Dirichlet priors that back off from a word to its beginnings, so a rare
word leans on what words that begin alike say. Words live in hashed tables of a fixed size: every word of
every training text counts, and the model's size does not grow with the corpus.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from wardline.llm.shared import free_prefix, give_back, kept, staged, table

SLOTS = 1 << 17
#: Leading letters that a word backs off to, shortest first; the last level is the whole word.
LEVELS = (3, 4, 5, None)
PRIOR = 6.0
DRIFT = 1.0
#: Labelled rows that a model is fitted on, at most; more are thinned evenly by a hash of their id.
TRAIN_ROWS = 200_000
SIGNIFICANT = 0.05
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„…–—¡¿·"


def slots_of(piece: str) -> list[int]:
    """The hashed slots of a white-space piece, one for each level; none if it has no letters."""
    word = piece.lower().strip(MARKS)
    if not word:
        return []
    return [level * SLOTS + zlib.crc32(word[:cut].encode()) % SLOTS for level, cut in enumerate(LEVELS)]


@dataclass
class Model:
    counts: np.ndarray = field(repr=False)  # (levels * SLOTS, 2): occurrences in clean and in toxic texts
    rate: float = 1.0  # lambda of the extreme-value law
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = -math.inf  # without training data nothing is toxic

    def weigher(self) -> Weigher:
        return Weigher(self)

    def evidence(self, scores: np.ndarray, n: int) -> float:
        """Sum of -log E over significant segments; of the best one alone if none is. E = K n exp(-lambda S).

        The sum is put on a logarithmic scale on either side of zero: the step from no passage to one decides,
        not the number of further ones.
        """
        total = -20.0
        if len(scores) and n:
            logs = self.rate * scores - self.log_k - math.log(n)
            strong = logs[logs > -math.log(SIGNIFICANT)]
            total = float(np.clip(strong.sum() if len(strong) else logs.max(), -20.0, 1e4))
        return math.copysign(math.log1p(abs(total)), total)

    def probability(self, evidence: np.ndarray | float) -> np.ndarray | float:
        if self.offset == -math.inf:
            return np.zeros_like(evidence, dtype=float)
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * np.asarray(evidence), -30, 30)))


class Weigher:
    """Token weights of whole texts, with a memo of pieces: beyond ``limit`` it keeps what the texts at hand use."""

    def __init__(self, model: Model, limit: int = 150_000):
        self.model, self.limit = model, limit
        totals = model.counts[:SLOTS].sum(0)
        self.ready = bool(totals.all())
        self.base = float(totals[1] / totals.sum()) if self.ready else 0.5
        self.memo: dict[str, float] = {}

    def _learn(self, new: list[str]) -> None:
        held = [(p, s) for p in new if (s := slots_of(p))]
        self.memo.update(dict.fromkeys(new, -DRIFT))
        if not held or not self.ready:
            return
        slots = np.array([s for _, s in held])
        share = np.full(len(held), self.base)
        for level in range(slots.shape[1]):
            clean, toxic = self.model.counts[slots[:, level]].T.astype(float)
            share = (toxic + PRIOR * share) / (clean + toxic + PRIOR)
        odds = np.log(share / (1 - share)) - math.log(self.base / (1 - self.base)) - DRIFT
        self.memo.update(zip((p for p, _ in held), odds.tolist(), strict=True))

    def weights(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [(t or "").split() for t in texts]
        used = set().union(*split) if split else set()
        if len(self.memo) > self.limit:
            self.memo = {p: self.memo[p] for p in used if p in self.memo}
        self._learn(list(used.difference(self.memo)))
        get = self.memo.__getitem__
        return [np.fromiter(map(get, s), np.float64, len(s)) for s in split]


def segments(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maximal scoring segments in linear time: first token, last token, score.

    Only tokens of positive weight can begin or end one, so the scan goes over those. A new candidate looks
    back for the last one that begins lower; it is joined to that one if it also ends higher.
    """
    up = np.flatnonzero(weights > 0)
    sums = np.cumsum(weights)
    stack: list[list] = []  # first, last, sum before, sum after, place of the last candidate that begins lower
    for i, after, w in zip(up.tolist(), sums[up].tolist(), weights[up].tolist(), strict=True):
        first, before = i, after - w
        while True:
            at = len(stack) - 1
            while at >= 0 and stack[at][2] >= before:
                at = stack[at][4]
            if at < 0 or stack[at][3] >= after:
                stack.append([first, i, before, after, at])
                break
            first, before = stack[at][0], stack[at][2]
            del stack[at:]
    if not stack:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    cells = np.array([[s[0], s[1], s[3] - s[2]] for s in stack])
    return cells[:, 0].astype(int), cells[:, 1].astype(int), cells[:, 2]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, train_rows: int) -> DataFrame:
    """Text, label and part (1 to 4) of the labelled rows to learn from. The label side is bounded, so it is broadcast."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(id_col)))
    total = known.count()
    side = known.groupBy(F.col(id_col).alias("__k")).agg(F.max("toxic").alias("__toxic"))
    if total > train_rows:
        thin = F.pmod(F.xxhash64("__k", F.lit("thin")), F.lit(1_000_000)) < int(1_000_000 * train_rows / total)
        side = side.where(thin)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    part = (F.crc32(F.col("__id").cast("string").cast("binary")) % 5).cast("int")
    return texts.join(F.broadcast(side), F.col("__id") == F.col("__k")).select(
        "__text", F.col("__toxic").cast("int").alias("__toxic"), part.alias("__part")
    )


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS
) -> Model:
    """Learn from labelled rows that are not held out: counts from three parts of four, calibration from the fourth.

    Reads texts and ``labels.toxic`` only; ids choose rows and are never an input. What is fetched is bounded
    by the model's size (counts) and by ``train_rows`` (two numbers for each calibration text).
    """
    training = _training(docs, labels, id_col, text_col, train_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(LEVELS) * SLOTS, 2), np.int64)
        memo: dict[str, list[int]] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found: tuple[list[int], list[int]] = ([], [])
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = (text or "").split()
                    for p in set(words).difference(memo):
                        memo[p] = slots_of(p)
                    found[1 if toxic else 0].extend(chain.from_iterable(map(memo.__getitem__, words)))
                for kind, slots in enumerate(found):
                    if slots:
                        counts[:, kind] += np.bincount(slots, minlength=len(counts))
                if len(memo) > 150_000:
                    memo = {}
        used = np.flatnonzero(counts.any(1))
        memo.clear()
        give_back()
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used, 0]), pa.array(counts[used, 1])], ["slot", "clean", "toxic"]
        )

    learned = (
        training.where("__part < 4")
        .select("__text", "__toxic")
        .mapInArrow(count, "slot long, clean long, toxic long")
        .groupBy("slot")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .toArrow()
    )
    counts = np.zeros((len(LEVELS) * SLOTS, 2), np.int32)
    counts[learned["slot"].to_numpy()] = np.stack([learned["clean"].to_numpy(), learned["toxic"].to_numpy()], 1)
    model = Model(counts)
    _calibrate(docs.sparkSession, model, training.where("__part = 4"))
    return model


def _calibrate(spark: SparkSession, model: Model, training: DataFrame) -> None:
    """Set the law's rate and constant from clean texts, then the logistic curve from the evidence of all."""
    low, step, bins = -6.0, 0.05, 320
    shared = spark.sparkContext.broadcast(model)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lengths and best scores of clean texts; last, a row of the task's own with the histogram of their weights."""
        weigher, total = shared.value.weigher(), np.zeros(bins, np.int64)
        for batch in batches:
            lengths, best = [], []
            for k in range(0, batch.num_rows, 512):
                for w in weigher.weights(batch.slice(k, 512).column(0).to_pylist()):
                    lengths.append(len(w))
                    best.append(float(segments(w)[2].max(initial=0.0)))
                    total += np.bincount(np.clip((w - low) / step, 0, bins - 1).astype(int), minlength=bins)
            columns = [pa.array(lengths, pa.int64()), pa.array(best, pa.float64()), pa.nulls(len(best), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["n", "best", "shape"])
        del weigher
        give_back()
        if total.any():
            columns = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([total.tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["n", "best", "shape"])

    clean = training.where("__toxic = 0").select("__text").mapInArrow(shapes, "n long, best double, shape array<long>")
    clean = staged(clean, "toxic-shapes")
    summed = clean.select(F.posexplode("shape").alias("k", "times")).groupBy("k").agg(F.sum("times").alias("times")).collect()
    shape = np.zeros(bins)
    for r in summed:
        shape[r["k"]] = r["times"]
    if not shape.any():
        return
    at = low + step * (np.arange(bins) + 0.5)
    p = shape / shape.sum()
    if (p * at).sum() < 0 and at[p > 0].max() > 0:
        left, right = 1e-3, 50.0  # lambda: the positive root of E[exp(lambda s)] = 1
        for _ in range(60):
            middle = (left + right) / 2
            if np.log((p[p > 0] * np.exp(np.minimum(middle * at[p > 0], 600))).sum()) > 0:
                right = middle
            else:
                left = middle
        model.rate = left
    # the median of lambda S - log n under the law is log K - log log 2
    middle = clean.where("best > 0").agg(F.median(F.lit(model.rate) * F.col("best") - F.log("n"))).first()[0]
    if middle is not None:
        model.log_k = middle + math.log(math.log(2))
    shared = spark.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weigher = model.weigher()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                x = [model.evidence(segments(w)[2], len(w)) for w in weigher.weights(part.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), part.column(1)], ["x", "toxic"])
        del weigher
        give_back()

    judged = training.select("__text", "__toxic").mapInArrow(evidence, "x double, toxic int").toArrow()
    x, y = judged["x"].to_numpy(), (judged["toxic"].to_numpy() > 0).astype(float)
    if 0 < y.sum() < len(y):
        model.slope, model.offset = _logistic(x, y)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a light ridge."""
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (y - p) - 1e-3 * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        beta += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _weigher_of(model: Model) -> Weigher:
    """One for each worker process and model: a broadcast value is one object to all of a worker's tasks."""
    return kept(("weigher", id(model)), model.weigher)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1) and passages, the significant segments (first and last word, score, evalue).

    Null, empty and wordless texts have no segments and get the score of the least evidence. Texts are read
    whole, each for itself, so repeated rows score alike; an empty table gives no rows. Without labels of both
    kinds every score is 0. Only the two named columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = "score double, passages array<struct<first_word: bigint, last_word: bigint, score: double, evalue: double>>"
    fields = StructType([docs.schema[id_col], *StructType.fromDDL(made).fields])
    kind = pa.list_(
        pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("evalue", pa.float64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weigher = _weigher_of(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                evidence, passages = [], []
                for w in weigher.weights(part.column(1).to_pylist()):
                    first, last, scores = segments(w)
                    evidence.append(model.evidence(scores, len(w)))
                    e = np.exp(np.clip(model.log_k + math.log(max(1, len(w))) - model.rate * scores, -700, 700))
                    passages.append(
                        [
                            {"first_word": int(first[i]), "last_word": int(last[i]), "score": float(scores[i]), "evalue": float(e[i])}
                            for i in np.flatnonzero(e < SIGNIFICANT)
                        ]
                    )
                scores = model.probability(np.array(evidence))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scores, pa.float64()), pa.array(passages, kind)], fields.fieldNames()
                )

    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, fields)


def without_flagged(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` less the rows that ``flagged`` flags, with the columns as given, whatever their names."""
    flag = f"{free_prefix(docs.columns)}toxic"
    return flagged(docs, model, flag, text_col, threshold).where(~F.col(flag)).drop(flag)


def flagged(docs: DataFrame, model: Model, flag: str, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with all its columns and ``flag``, a name of no column: whether the score of ``score`` reaches ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = StructType([*docs.schema.fields, StructField(flag, BooleanType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weigher = _weigher_of(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = [model.evidence(segments(w)[2], len(w)) for w in weigher.weights(part.column(at).to_pylist())]
                flags = model.probability(np.array(found)) >= threshold
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(flags)], fields.fieldNames())
        give_back()

    return docs.mapInArrow(run, fields)


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
