"""Token files by a static range asymmetric numeral system (rANS).

One frequency table, counted over all documents, serves every block. A block holds whole documents and is
independent of all others; inside it ``LANES`` coders take turns, one id each a step, so a step is one numpy
operation over all lanes. Checkpoints keep the coders' states, from which decoding can start at an inner step.

A container is a folder with two Parquet tables, written by Spark (so lost tasks are written again):

  model   one row: scale_bits, frequencies (binary, 32-bit little-endian), crc
  blocks  part, first_id (ids before it in its part), n_ids, doc_ids, lengths, payload

Payload: 4 bytes magic, then 32-bit little-endian: n_ids, lanes, n_words, n_checkpoints, crc32 of the ids; the
first checkpoint's lane states (64 bit); for each further checkpoint its step, words before it and states; the
32-bit words; last, the crc32 of all bytes before.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType
from pyspark.sql.window import Window

from wardline.llm import pieces
from wardline.llm.shared import scratch_dir, staged, table

SCALE_BITS = 20
LANES = 2048
BLOCK_IDS = 1 << 18
CHECKPOINT_STEPS = 64
LOWEST = np.uint64(1 << 31)
MAGIC = b"RNS1"


@dataclass(frozen=True)
class Model:
    """Frequencies that sum to 2 ** scale_bits, at least 1 for every id that occurs."""

    frequencies: np.ndarray
    scale_bits: int = SCALE_BITS

    @classmethod
    def of_counts(cls, counts: np.ndarray, scale_bits: int = SCALE_BITS) -> Model:
        total, size = int(counts.sum()), 1 << scale_bits
        if not total:
            return cls(np.zeros(max(1, len(counts)), np.uint32), scale_bits)
        if np.count_nonzero(counts) > size:
            raise ValueError("more different ids than the scale has steps")
        share = np.where(counts > 0, np.maximum(1, np.floor(counts * (size / total))), 0).astype(np.int64)
        excess = int(share.sum()) - size
        order = np.argsort(-share, kind="stable")
        while excess:  # the commonest ids take up the rounding
            room = share[order] - 1 if excess > 0 else np.full(len(order), size)
            some = order[room > 0][: abs(excess)]
            share[some] -= np.sign(excess)
            excess = int(share.sum()) - size
        return cls(share.astype(np.uint32), scale_bits)

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.frequencies.astype(np.uint64))[:-1]]).astype(np.uint64)

    def symbols(self) -> np.ndarray:
        """The id that each of the 2 ** scale_bits steps belongs to."""
        return np.repeat(np.arange(len(self.frequencies), dtype=np.uint32), self.frequencies)


def encode_block(ids: np.ndarray, model: Model, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
    bits = np.uint64(model.scale_bits)
    frequencies, starts = model.frequencies.astype(np.uint64), model.starts()
    lanes = max(1, min(lanes, len(ids)))
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, LOWEST)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, bytes]] = []
    n_words = 0
    all_f, all_s = frequencies[ids], starts[ids]
    limit = all_f << np.uint64(63 - model.scale_bits)
    for step in range(steps - 1, -1, -1):
        at = slice(step * lanes, min(len(ids), (step + 1) * lanes))
        f, x = all_f[at], state[: at.stop - at.start]
        over = x >= limit[at]
        words.append(x[over].astype(np.uint32))
        n_words += len(words[-1])
        x = np.where(over, x >> np.uint64(32), x)
        turn = x // f
        state[: len(x)] = (turn << bits) + (x - turn * f) + all_s[at]
        if step % every == 0:
            marks.append((step, n_words, state.tobytes()))
    body = [MAGIC, struct.pack("<5I", len(ids), lanes, n_words, len(marks), zlib.crc32(ids.astype("<u4").tobytes()))]
    for step, words_after, states in reversed(marks):
        body.append((struct.pack("<2I", step, n_words - words_after) if step else b"") + states)
    body += [w.astype("<u4").tobytes() for w in reversed(words)]
    whole = b"".join(body)
    return whole + struct.pack("<I", zlib.crc32(whole))


def decode_block(
    payload: bytes, model: Model, checkpoint: int = 0, last: int | None = None, symbols: np.ndarray | None = None
) -> np.ndarray:
    """The ids from one checkpoint to another (or to the end); checksums are verified on the way."""
    if payload[:4] != MAGIC or struct.unpack("<I", payload[-4:])[0] != zlib.crc32(payload[:-4]):
        raise ValueError("damaged block")
    n_ids, lanes, n_words, n_marks, ids_crc = struct.unpack_from("<5I", payload, 4)
    at, marks = 24, []
    for k in range(n_marks):
        step, before = struct.unpack_from("<2I", payload, at) if k else (0, 0)
        at += 8 * (k > 0)
        marks.append((step, before, at))
        at += 8 * lanes
    if not marks:
        return np.empty(0, np.uint32)
    words = np.frombuffer(payload, "<u4", n_words, at)
    first, read, where = marks[checkpoint]
    end = -(-n_ids // lanes) if last is None or last >= n_marks else marks[last][0]
    state = np.frombuffer(payload, "<u8", lanes, where).astype(np.uint64)
    symbols = model.symbols() if symbols is None else symbols
    frequencies, starts = model.frequencies.astype(np.uint64), model.starts()
    bits, mask = np.uint64(model.scale_bits), np.uint64((1 << model.scale_bits) - 1)
    out = np.empty(min(n_ids, end * lanes) - first * lanes, np.uint32)
    for step in range(first, end):
        live = min(lanes, n_ids - step * lanes)
        x = state[:live]
        low = x & mask
        symbol = symbols[low]
        out[(step - first) * lanes : (step - first) * lanes + live] = symbol
        x = frequencies[symbol] * (x >> bits) + low - starts[symbol]
        short = np.flatnonzero(x < LOWEST)
        x[short] = x[short] << np.uint64(32) | words[read : read + len(short)]
        read += len(short)
        state[:live] = x
    if not checkpoint and end * lanes >= n_ids and zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("damaged ids")
    return out


def _packer():
    """Ids on their way between stages: two bytes each where they fit, lightly compressed."""
    compress = zstandard.ZstdCompressor(level=1).compress
    return lambda ids: b"2" + compress(ids.astype("<u2").tobytes()) if ids.max(initial=0) < 1 << 16 else b"4" + compress(ids.astype("<u4").tobytes())


def _unpack_ids(packed: bytes) -> np.ndarray:
    raw = zstandard.decompress(packed[1:])
    return np.frombuffer(raw, "<u2" if packed[:1] == b"2" else "<u4")


def token_rows(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """__row, id and packed ids (with ``end_id`` at the end) of every document; counts is null.

    Each task adds a row of its own behind them that has only counts: how often each id occurred in it.
    """
    fields = StructType(
        [
            StructField("__row", LongType()),
            StructField(id_col, docs.schema[id_col].dataType),
            StructField("ids", BinaryType()),
            StructField("counts", BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pack, counts, kind = pieces.encoder(tokenizer), _packer(), np.zeros(1 << 10, np.int64), None
        for batch in batches:
            kind = batch.column(1).type
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                ids, bounds = coder.encode_array(part.column(2), end_id)
                more = np.bincount(ids)
                if len(more) > len(counts):
                    counts = np.pad(counts, (0, len(more) - len(counts)))
                counts[: len(more)] += more
                packed = [pack(ids[a:b]) for a, b in pairwise(bounds.tolist())]
                columns = [part.column(0), part.column(1), pa.array(packed, pa.binary()), pa.nulls(len(packed), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, fields.fieldNames())
        if counts.any():
            own = pa.array([zstandard.compress(counts.astype("<i8").tobytes())], pa.binary())
            columns = [pa.nulls(1, pa.int64()), pa.nulls(1, kind), pa.nulls(1, pa.binary()), own]
            yield pa.RecordBatch.from_arrays(columns, fields.fieldNames())

    source = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col), F.col(text_col).alias("__text"))
    return source.mapInArrow(run, fields)


def count_ids(tokens: DataFrame) -> np.ndarray:
    """Occurrences of every id, from the counts of the tasks that made the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                counts = np.frombuffer(zstandard.decompress(packed), "<i8")
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    counted = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, n long")
    rows = counted.groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def write_token_files(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = pieces.WORD_BPE,
    end_id: int = 1,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Write all documents' ids, in ascending id order, as a container at ``path``.

    Null and empty texts are one ``end_id``. Documents that repeat an id follow one another; a null id comes
    first. An empty table makes a container without blocks. A document longer than a block has one of its own.
    Tokens are made once and written; the order comes from a range partitioning by (id, row), so even one id
    that a third of all rows hold is dealt over many tasks.
    """
    kind = docs.schema[id_col].dataType
    spark = docs.sparkSession
    tokens = staged(token_rows(docs, id_col, text_col, tokenizer, end_id), "rans-tokens")
    model = Model.of_counts(count_ids(tokens))
    raw = model.frequencies.astype("<u4").tobytes()
    spark.createDataFrame(
        [(model.scale_bits, bytearray(raw), zlib.crc32(raw))], "scale_bits int, frequencies binary, crc long"
    ).coalesce(1).write.parquet(f"{path}/model")
    fields = StructType(
        [
            StructField("part", LongType()),
            StructField("first_id", LongType()),
            StructField("n_ids", LongType()),
            StructField("doc_ids", ArrayType(kind)),
            StructField("lengths", ArrayType(LongType())),
            StructField("payload", BinaryType()),
        ]
    )
    arrow_kind = pa.list_(_arrow(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, written, held, names = TaskContext.get().partitionId(), 0, [], []

        def block() -> pa.RecordBatch:
            ids = np.concatenate(held).astype(np.uint32)
            columns = [
                pa.array([part], pa.int64()),
                pa.array([written], pa.int64()),
                pa.array([len(ids)], pa.int64()),
                pa.array([names], arrow_kind),
                pa.array([[len(x) for x in held]], pa.list_(pa.int64())),
                pa.array([encode_block(ids, model)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, fields.fieldNames())

        size = 0
        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = _unpack_ids(packed)
                if held and size + len(ids) > block_ids:
                    yield block()
                    written, size, held, names = written + size, 0, [], []
                held.append(ids)
                names.append(name)
                size += len(ids)
        if held:
            yield block()

    rows = tokens.where("counts IS NULL").drop("counts")
    ordered = rows.repartitionByRange(F.col(id_col).asc_nulls_first(), "__row").sortWithinPartitions(
        F.col(id_col).asc_nulls_first(), "__row"
    )
    ordered.select(id_col, "ids").mapInArrow(run, fields).write.parquet(f"{path}/blocks")


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start (ids of all documents before), n_tokens and ids (binary, 32-bit little-endian) of every document.

    Blocks are decoded apart from each other; starts come from the sums of the parts, one number for each task
    that wrote, and the places inside a part.
    """
    stored = spark.read.parquet(f"{path}/model").first()
    raw = bytes(stored["frequencies"])
    if zlib.crc32(raw) != stored["crc"]:
        raise ValueError("damaged model")
    model = Model(np.frombuffer(raw, "<u4"), stored["scale_bits"])
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("part_start"))
    kind = blocks.schema["doc_ids"].dataType.elementType
    fields = StructType(
        [
            StructField("part", LongType()),
            StructField(id_col, kind),
            StructField("at", LongType()),
            StructField("n_tokens", LongType()),
            StructField("ids", BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = model.symbols()
        for batch in batches:
            for k in range(batch.num_rows):
                part, first, _, names, lengths, payload = (batch.column(c)[k] for c in range(6))
                ids = decode_block(payload.as_py(), model, symbols=symbols).astype("<u4").tobytes()
                sizes = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(sizes)
                bodies = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [
                    pa.array(np.full(len(sizes), part.as_py(), np.int64)),
                    names.values,
                    pa.array(first.as_py() + ends - sizes),
                    pa.array(sizes),
                    pa.array(bodies, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, fields.fieldNames())

    decoded = blocks.select("part", "first_id", "n_ids", "doc_ids", "lengths", "payload").mapInArrow(run, fields)
    return decoded.join(F.broadcast(starts), "part").select(
        id_col, (F.col("part_start") + F.col("at")).alias("start"), "n_tokens", "ids"
    )


def op7_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
