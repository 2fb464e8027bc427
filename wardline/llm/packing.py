"""Packing into fixed-size sequences: exact complements by hashed length sums, then best fit.

Placement depends on lengths alone, so it is planned on the histogram of lengths (at most one count for each
length up to the capacity, whatever the table's size). Documents then find their place by their rank among
the pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType, BinaryType
from pyspark.sql.window import Window

from wardline.llm import pieces
from wardline.llm.shared import give_back, staged, table, trim

CAPACITY = 2048
#: Groups that pieces of one length are dealt over at least; large tables have one for so many pieces.
SALTS, PIECES_PER_SALT = 256, 2_000_000
#: Bytes of text that a worker expands to words at once, and bytes after which it gives freed pages back.
PART_BYTES, TRIM_BYTES = 1 << 20, 16 << 20


def cut_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    tokenizer: str = pieces.WORD_BPE,
    end_id: int = 0,
    with_ids: bool = True,
    memo: int = pieces.MEMO,
) -> DataFrame:
    """One row per piece: __row, id, piece, start, length, ids_crc32 and, if wanted, ids (binary, 32-bit little-endian).

    A document is its token ids and ``end_id``. Only one longer than ``capacity`` is cut.
    """
    kind = docs.schema[id_col].dataType
    fields = [
        StructField("__row", LongType()),
        StructField(id_col, kind),
        StructField("piece", IntegerType()),
        StructField("start", LongType()),
        StructField("length", LongType()),
        StructField("ids_crc32", LongType()),
    ] + [StructField("ids", BinaryType())] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, since = pieces.encoder(tokenizer, memo), 0
        for batch in batches:
            since += batch.nbytes
            if since > TRIM_BYTES:
                trim()
                since = 0
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                ids, bounds = coder.encode_array(part.column(2), end_id, PART_BYTES)
                sizes = np.diff(bounds)
                n_pieces = -(-sizes // capacity)
                take = np.repeat(np.arange(len(sizes)), n_pieces)
                number = np.arange(len(take)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                starts = number * capacity
                lengths = np.minimum(capacity, sizes[take] - starts)
                raw, first = ids.astype("<u4").tobytes(), bounds[:-1][take] + starts
                bodies = [raw[4 * a : 4 * (a + n)] for a, n in zip(first.tolist(), lengths.tolist(), strict=True)]
                columns = [
                    part.column(0).take(pa.array(take)),
                    part.column(1).take(pa.array(take)),
                    pa.array(number.astype(np.int32)),
                    pa.array(starts),
                    pa.array(lengths),
                    pa.array([zlib.crc32(b) for b in bodies], pa.int64()),
                ] + [pa.array(bodies, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])
        give_back()

    source = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col), F.col(text_col).alias("__text"))
    return source.mapInArrow(cut, StructType(fields))


class _Stock:
    """Pieces still to be placed, by length, with an index of sums.

    Single lengths are found by their presence. Pairs are hashed by their sum: an entry is made when a sum is first
    asked for, from the lengths that are there, and stays right as the stock only shrinks. Triples are a length
    and a pair of the remaining sum.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        self.pairs_of: dict[int, list[int]] = {}  # sum: the larger part of each pair, descending
        for n, c in counts.items():
            self.left[n] = c
        self.there = self.left > 0

    def take(self, combination: tuple[int, ...]) -> int:
        """Use up the combination as often as its lengths allow; returns how often."""
        need: dict[int, int] = defaultdict(int)
        for n in combination:
            need[n] += 1
        times = min(int(self.left[n]) // k for n, k in need.items())
        for n, k in need.items():
            self.left[n] -= k * times
            self.there[n] = self.left[n] > 0
        return times

    def fillers(self, gap: int, largest: int) -> Iterator[tuple[int, ...]]:
        """One, two or three lengths (none above ``largest``) that sum to ``gap``, by lookup of the complement.

        Fewer and larger parts come first. Lengths may be used up between two results.
        """
        if gap <= largest and self.there[gap]:
            yield (gap,)
        yield from self._pairs(gap, largest)
        for a in range(min(largest, gap - 2), (gap + 2) // 3 - 1, -1):
            if self.there[a]:
                for pair in self._pairs(gap - a, a):
                    yield (a, *pair)

    def _pairs(self, total: int, largest: int) -> Iterator[tuple[int, int]]:
        if total not in self.pairs_of:
            larger = np.arange(total - 1, (total + 1) // 2 - 1, -1)
            self.pairs_of[total] = larger[self.there[larger] & self.there[total - larger]].tolist()
        for a in self.pairs_of[total]:
            if a <= largest and self.there[a] and self.there[total - a]:
                yield a, total - a


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in order, how many of them), for ``counts`` pieces of each length.

    From the longest length down, one, two or three others whose sum is exactly the gap are used up as often
    as all of them are there: the stock only shrinks, so one pass over the combinations finds all. What is
    left goes longest first into the fullest sequence that has room.
    """
    stock, done = _Stock(counts, capacity), []
    for n in sorted(counts, reverse=True):
        if n == capacity:
            done.append(((n,), stock.take((n,))))
            continue
        for filler in stock.fillers(capacity - n, n):
            if not stock.there[n]:
                break
            group = (n, *filler)
            if times := stock.take(group):
                done.append((group, times))
    return done + best_fit({n: int(c) for n, c in enumerate(stock.left) if c}, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal sequences are filled together."""
    bins: dict[int, list[list]] = defaultdict(list)  # gap -> [lengths, how many]
    gaps = np.zeros(capacity + 1, bool)
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            fitting = np.flatnonzero(gaps[n:])
            if len(fitting):
                gap = n + int(fitting[0])
                held, many = bins[gap].pop()
                used = min(left, many)
                if many > used:
                    bins[gap].append([held, many - used])
                gaps[gap] = bool(bins[gap])
            else:
                # new sequences get as many pieces of this length as fit, the last one what is left
                full, rest = divmod(left, capacity // n)
                for items, many in ((capacity // n, full), (rest, 1 if rest else 0)):
                    if many:
                        bins[capacity - n * items].append([(n,) * items, many])
                        gaps[capacity - n * items] = True
                left = 0
                continue
            bins[gap - n].append([(*held, n), used])
            gaps[gap - n] = True
            left -= used
    return [(tuple(held), many) for some in bins.values() for held, many in some]


def _slots(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset): ranks of a length that lie at one place of equal sequences."""
    out, next_rank, sequence = [], defaultdict(int), 0
    for lengths, many in planned:
        offset = 0
        for n in lengths:
            out.append((n, next_rank[n], next_rank[n] + many - 1, sequence, offset))
            next_rank[n] += many
            offset += n
        sequence += many
    return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    tokenizer: str = pieces.WORD_BPE,
    end_id: int = 0,
    with_ids: bool = True,
    memo: int = pieces.MEMO,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset and, if wanted, ids.

    Null and empty texts are one ``end_id``. Repeated rows are pieces of their own; an empty table gives no
    rows; long texts are tokenized whole and cut into full pieces and a rest. Only the two named columns are
    read. ``memo`` bounds what a worker remembers of pieces of text; it sets memory and time, not the result.

    Tokens are made once and written; the plan is made from at most ``capacity`` counts. Pieces of one length
    are dealt over ``SALTS`` groups or more, ranked inside them and shifted by the counts of the groups before,
    so a length that a third of all pieces have is not one task's work.
    """
    spark = docs.sparkSession
    made = staged(cut_pieces(docs, id_col, text_col, capacity, tokenizer, end_id, with_ids, memo), "pack-pieces")
    salt = F.pmod(F.xxhash64("__row", "piece"), F.lit(max(SALTS, made.count() // PIECES_PER_SALT))).cast("int")
    narrow = made.drop("ids").withColumn("__salt", salt)
    groups = staged(narrow.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = groups.groupBy("length").agg(F.sum("n").alias("n")).collect()
    slots = _slots(plan({r["length"]: r["n"] for r in histogram}, capacity))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("length", "__salt").orderBy("__row", "piece")
    ranked = narrow.withColumn("__n", F.row_number().over(inside)).join(starts, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__first") + F.col("__n") - 1)
    return _placed(spark, ranked, slots, made if with_ids else None, id_col)


def _placed(spark: SparkSession, ranked: DataFrame, slots: list, made: DataFrame | None, id_col: str) -> DataFrame:
    """Look up each (length, rank) in the plan: an array search in tasks, the plan being bounded by the capacity."""
    table_ = np.array(sorted(slots), np.int64).reshape(-1, 5)
    keys = table_[:, 0] << 44 | table_[:, 1]  # rank below 2 ** 44
    kept = ["__row", id_col, "piece", "start", "length", "ids_crc32"]
    fields = [ranked.schema[c] for c in kept] + [StructField("sequence_id", LongType()), StructField("offset", LongType())]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False).astype(np.int64)
            slot = np.searchsorted(keys, length << 44 | rank, "right") - 1
            sequence = table_[slot, 3] + rank - table_[slot, 1]
            columns = [batch.column(c) for c in kept] + [pa.array(sequence), pa.array(table_[slot, 4])]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    placed = ranked.mapInArrow(place, StructType(fields))
    if made is not None:
        placed = placed.join(made.select("__row", "piece", "ids"), ["__row", "piece"])
    return placed.drop("__row")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
