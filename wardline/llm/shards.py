"""Sharding along a Hilbert curve: quantise metadata dimensions, sort by curve index, cut equal runs.

Neighbouring cells of the curve lie in the same or adjacent shards, so each shard covers a compact box of
every dimension and file statistics prune on all of them.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, NumericType, StringType, VariantType
from pyspark.sql.window import Window

from wardline.llm.shared import staged, table

#: Salts within a curve cell at least; large tables have one for so many rows, which bounds what is ranked in one task.
SALTS, ROWS_PER_SALT = 64, 2_000_000


def _code(docs: DataFrame, dim: str, prefix: int) -> Column:
    """A non-negative integer below 65,536 that keeps the dimension's order: the unit of its histogram."""
    kind = docs.schema[dim].dataType
    if isinstance(kind, StringType):
        # two bytes after the prefix that all values share
        tail = F.hex(F.substring(F.encode(F.col(dim), "UTF-8"), prefix + 1, 2))
        code = F.conv(F.rpad(tail, 4, "0"), 16, 10).cast("int")
    elif isinstance(kind, NumericType):
        # sixteen steps to each doubling, mirrored below zero
        x = F.col(dim).cast("double")
        steps = F.least(F.floor(F.log2(F.abs(x) + 1) * 16), F.lit(16_000)).cast("int")
        code = F.when(F.isnan(x), 32_001).when(x < 0, 16_000 - steps).otherwise(16_000 + steps)
    else:
        code = F.pmod(F.xxhash64(F.col(dim)), F.lit(65_536)).cast("int")
    return F.coalesce(code, F.lit(0))


def _cuts(docs: DataFrame, codes: dict[str, Column], bits: int) -> dict[str, list[int]]:
    """For each dimension the codes at which equally filled quantiles begin, from one pass over all rows.

    The histogram fetched has at most 65,536 counts a dimension, however large the table.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), c.alias("code")) for d, c in codes.items()]))
    histogram = docs.select(pairs.alias("p")).groupBy("p.dim", "p.code").count().collect()
    cuts = {}
    for dim in codes:
        counts = sorted((r["code"], r["count"]) for r in histogram if r["dim"] == dim)
        total, seen, ends = sum(n for _, n in counts), 0, []
        for code, n in counts:
            seen += n
            ends.append((seen, code))
        marks = [total * k / 2**bits for k in range(1, 2**bits)]
        at = [ends[min(bisect_right(ends, (m, 1 << 20)), len(ends) - 1)][1] for m in marks] if ends else []
        cuts[dim] = sorted(set(at))
    return cuts


def _reached(ends: Column, code: Column) -> Column:
    return F.size(F.filter(ends, lambda c: c <= code))


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place on the Hilbert curve of a point whose coordinates are below 2 ** bits.

    From the highest bit down, each axis that lies in an upper half reflects the first axis, any other is
    swapped with it, in the bits below; what results is Gray-coded and its bits interleaved.
    """
    x = list(point)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(len(x)):
            if x[i] >> level & 1:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = 0
    for level in range(bits - 1, 0, -1):
        if x[-1] >> level & 1:
            flip ^= (1 << level) - 1
    index = 0
    for level in range(bits - 1, -1, -1):
        for v in x:
            index = index * 2 + ((v ^ flip) >> level & 1)
    return index


def curve_index(axes: list[Column], bits: int) -> Column:
    """``hilbert_index`` of integer columns: one lookup in a constant array of at most 4,096 cells."""
    n, side = len(axes), 1 << bits
    points = ([c >> (bits * (n - 1 - i)) & (side - 1) for i in range(n)] for c in range(side**n))
    listed = ",".join(str(hilbert_index(tuple(p), bits)) for p in points)
    cell = F.lit(0)
    for axis in axes:
        cell = cell * side + axis
    return F.get(F.split(F.lit(listed), ",").cast("array<bigint>"), cell.cast("int"))


def hilbert_shards(
    docs: DataFrame, dims: list[str], n_shards: int, id_col: str = "doc_id", bits: int = 4
) -> DataFrame:
    """All columns of ``docs`` plus curve_index, shard (from 0) and slot (from 0 in each shard, gapless).

    Rows are ranked by (curve index, salt, id); shard = floor(rank * n_shards / rows), so shard row counts
    differ by at most one. Fewer rows than shards leave shards empty; an empty table gives no rows. Null
    dimension values count as the lowest. Rows that tie in everything take neighbouring slots in any order.
    Equal texts lie together only as far as their dimensions and salts do: law ``rows`` counts rows, not texts.
    Given columns named curve_index, shard or slot, in whatever case, are replaced; other names do no harm.

    Ranks come from counts of (cell, salt) groups plus a row number inside each group. A salt is a hash of the
    row, so a cell that holds a third of all rows, or rows without an id, are dealt over many groups.
    """
    if bits * len(dims) > 12:
        raise ValueError("bits * dimensions must not exceed 12, which bounds the table of run starts")
    made = ("curve_index", "shard", "slot")
    own = [c for c in docs.columns if c.lower() not in made]
    strings = [d for d in dims if isinstance(docs.schema[d].dataType, StringType)]
    prefix = dict.fromkeys(dims, 0)
    if strings:
        ends = docs.agg(*[f(d).alias(f"{n}{i}") for i, d in enumerate(strings) for n, f in (("a", F.min), ("b", F.max))]).first()
        for i, d in enumerate(strings):
            a, b = ((ends[f"{n}{i}"] or "").encode() for n in "ab")
            prefix[d] = next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
    codes = {d: _code(docs, d, prefix[d]) for d in dims}
    cuts = _cuts(docs, codes, bits)
    helper = "__"  # in front of every column that is added on the way
    while any(c.lower().startswith(helper) for c in docs.columns):
        helper += "_"
    cell, salt, n, starts_at, rows_, rank, shard = (f"{helper}{x}" for x in ("cell", "salt", "n", "start", "rows", "rank", "shard"))
    names = [f"{helper}code{i}" for i in range(len(dims))]
    axes = []
    for name, d in zip(names, dims, strict=True):
        ends = F.split(F.lit(",".join(map(str, cuts[d])) or "0"), ",").cast("array<int>")
        axes.append(_reached(ends, F.col(name)) if cuts[d] else F.lit(0))
    hashed = [c for c in docs.columns if not isinstance(docs.schema[c].dataType, (MapType, VariantType))]
    salts = max(SALTS, docs.count() // ROWS_PER_SALT)
    placed = docs.withColumns({name: codes[d] for name, d in zip(names, dims, strict=True)} | {salt: F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int")})
    placed = placed.withColumn(cell, curve_index(axes, bits)).select(*own, cell, salt)
    counts = staged(placed.groupBy(cell, salt).agg(F.count(F.lit(1)).alias(n)), "shard-counts")
    whole = counts.groupBy(cell).agg(F.sum(n).alias(n))
    before_cell = Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(
        cell,
        F.coalesce(F.sum(n).over(before_cell), F.lit(0)).alias(starts_at),
        F.sum(n).over(Window.partitionBy(F.lit(0))).alias(rows_),
    )
    before_salt = Window.partitionBy(cell).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    in_cell = counts.select(cell, salt, F.coalesce(F.sum(n).over(before_salt), F.lit(0)).alias(n))
    starts = in_cell.join(F.broadcast(whole), cell).select(cell, salt, rows_, (F.col(n) + F.col(starts_at)).alias(starts_at))  # at most 4,096 cells
    order = Window.partitionBy(cell, salt).orderBy(id_col)
    ranked = placed.withColumn(n, F.row_number().over(order)).join(staged(starts, "shard-starts"), [cell, salt])
    ranked = ranked.withColumn(rank, F.col(starts_at) + F.col(n) - 1).withColumn(shard, F.expr(f"cast((`{rank}` * {n_shards}) div `{rows_}` as int)"))
    # the first rank of shard s is ceil(s * rows / n_shards)
    first = F.expr(f"(cast(`{shard}` as bigint) * `{rows_}` + {n_shards - 1}) div {n_shards}")
    return ranked.select(*own, F.col(cell).alias("curve_index"), F.col(shard).alias("shard"), (F.col(rank) - first).alias("slot"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard with its rows in slot order. A shard is cut into files of two million rows."""
    chunk = F.floor(F.col("slot") / 2_000_000)
    n = placed.select("shard").distinct().count()
    placed.repartitionByRange(max(n, 1), "shard", chunk).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bytes_of = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    narrow = docs.select(
        "doc_id",
        "source",
        "lang",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size"),
        F.crc32(bytes_of).alias("text_crc32"),
    )
    return hilbert_shards(narrow, ["source", "lang", "size"], 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve_index",
    )
