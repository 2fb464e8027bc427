"""Merkle manifest of a dataset: three-way hash trees per group under one root, stored in van Emde Boas layout.

A tree over any number of leaves is cut into aligned blocks of ``HEIGHT`` levels of edges. Each block is one row of
a table: its digests lie in one binary, the top half of its levels first, then each subtree of the lower half, and
so on recursively. Address arithmetic alone finds a node, both while a block is built and when siblings are read.
The roots of blocks are the leaves of the next level of blocks, until one block is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructType
from pyspark.sql.window import Window

from wardline.llm.shared import hinted, staged, table

ARITY, HEIGHT, DIGEST = 3, 6, 32
#: Leaves of a full block.
WIDTH = ARITY**HEIGHT
MADE = StructType().add("levels", IntegerType()).add("tree", BinaryType()).add("root", BinaryType())
RESULT = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: list[Column]) -> Column:
    """sha256 (binary) of the values in order, each `-` if null, else its UTF-8 byte count, a colon and itself."""
    parts = []
    for v in values:
        text = v.cast("string")
        parts.append(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def node_digest(children: list[bytes]) -> bytes:
    """sha256 of the children's digests written as lowercase hex."""
    return sha256(b"".join(children).hex().encode()).digest()


def nodes_of(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Places in the layout of the nodes ``index`` (from the left) at ``depth`` of a full tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(depth, index, upper)
    tree, inner = np.divmod(index, ARITY ** (depth - upper))
    return nodes_of(upper) + tree * nodes_of(levels - upper) + address(depth - upper, inner, levels - upper)


@lru_cache(maxsize=64)
def _row(depth: int, levels: int) -> list[int]:
    return (address(depth, np.arange(ARITY**depth), levels) * DIGEST).tolist()


@dataclass
class Block:
    """One stored subtree: ``count`` leaves under ``levels`` levels; places without a node hold zeros."""

    count: int
    levels: int
    digests: bytes | bytearray

    @classmethod
    def build(cls, leaves: list[bytes], levels: int) -> Block:
        block = cls(len(leaves), levels, bytearray(nodes_of(levels) * DIGEST))
        for at, digest in zip(_row(levels - 1, levels), leaves, strict=False):
            block.digests[at : at + DIGEST] = digest
        for depth in range(levels - 2, -1, -1):
            at, below, n = _row(depth, levels), block.width(depth + 1), block.width(depth)
            for i in range(n):
                run = range(i * ARITY, min((i + 1) * ARITY, below))
                block.digests[at[i] : at[i] + DIGEST] = node_digest([block.node(depth + 1, k) for k in run])
        return block

    def width(self, depth: int) -> int:
        """How many nodes there are at a depth."""
        return -(-self.count // ARITY ** (self.levels - 1 - depth))

    def node(self, depth: int, index: int) -> bytes:
        at = _row(depth, self.levels)[index]
        return bytes(self.digests[at : at + DIGEST])

    def path(self, slot: int) -> bytes:
        """Siblings of a leaf up to the block's root: for each level a byte for how many stand before the node, a
        byte for how many after it, and their digests."""
        steps, i = [], slot
        for depth in range(self.levels - 1, 0, -1):
            first = i - i % ARITY
            last = min(first + ARITY, self.width(depth))
            steps.append(bytes((i - first, last - i - 1)))
            steps += [self.node(depth, k) for k in range(first, last) if k != i]
            i //= ARITY
        return b"".join(steps)


def fold(digest: bytes, path: bytes) -> tuple[bytes, list[bytes]]:
    """The root that a digest and its path lead to, and the path's siblings in order."""
    at, siblings = 0, []
    while at < len(path):
        before, after = path[at], path[at + 1]
        at += 2
        others = [path[k : k + DIGEST] for k in range(at, at + (before + after) * DIGEST, DIGEST)]
        at += (before + after) * DIGEST
        siblings += others
        digest = node_digest([*others[:before], digest, *others[before:]])
    return digest, siblings


def levels_for(count: int) -> int:
    """Levels of nodes until ``count`` nodes have become one."""
    levels = 1
    while count > 1:
        count, levels = -(-count // ARITY), levels + 1
    return levels


def ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` with a gapless ``rank`` from 0 by ``by`` (nulls first, strings bytewise): ranges are sorted apart, then
    shifted by what lies before them; one number a range goes through one task."""
    rows = staged(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()), name)
    part, inside = F.shiftrightunsigned("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    placed = rows.withColumn("part", part).join(F.broadcast(starts), "part")  # one row a partition
    return placed.withColumn("rank", F.col("start") + inside).drop("part", "start", "place")


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole, runs = batch.column("whole").to_pylist(), batch.column("rows")
        digests, ends = runs.flatten().field("digest").to_pylist(), np.cumsum(runs.value_lengths().to_numpy()).tolist()
        levels, trees, roots, first = [], [], [], 0
        for n, end in zip(whole, ends, strict=True):
            block = Block.build(digests[first:end], levels_for(n) if n <= WIDTH else HEIGHT + 1)
            levels.append(block.levels)
            trees.append(bytes(block.digests))
            roots.append(block.node(0, 0))
            first = end
        made = [pa.array(levels, pa.int32()), pa.array(trees, pa.binary()), pa.array(roots, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "levels", "tree", "root"])


@dataclass
class Forest:
    """``tables[k]`` has the blocks of level k: key, whole (nodes of the key's tree at that level), block, rows (what
    lies at its leaves, in order), levels, tree (the layout), root. ``roots`` has one row a key."""

    tables: list[DataFrame]
    roots: DataFrame

    @classmethod
    def build(cls, leaves: DataFrame, name: str) -> Forest:
        """Trees over rows (key, whole, rank, digest, further columns), one for each key. A block is aggregated from at most
        ``WIDTH`` rows, so a key of any size is many tasks."""
        tables, roots = [], None
        while True:
            inside = [F.expr(f"rank % {WIDTH}").cast("int").alias("slot")] + [F.col(c) for c in leaves.columns if c not in ("key", "whole", "rank")]
            blocks = leaves.groupBy("key", "whole", F.expr(f"rank div {WIDTH}").alias("block")).agg(
                F.array_sort(F.collect_list(F.struct(*inside))).alias("rows")
            )
            fields = StructType([*blocks.schema.fields, *MADE.fields])
            built = staged(blocks.mapInArrow(_built, fields), f"{name}-{len(tables)}")
            tables.append(built)
            done = built.where(F.col("whole") <= WIDTH).select("key", "root")
            roots = done if roots is None else roots.unionByName(done)
            rest = built.where(F.col("whole") > WIDTH)
            if rest.isEmpty():
                return cls(tables, roots)
            leaves = rest.select("key", F.expr(f"(whole + {WIDTH - 1}) div {WIDTH}").alias("whole"), F.col("block").alias("rank"), F.col("root").alias("digest"))

    def above(self, tops: DataFrame, name: str) -> DataFrame:
        """Paths from each root of a bottom block to the end of ``tops`` (key, top, path above that key's root): key, block,
        top, path."""
        paths = None
        for k in range(len(self.tables) - 1, -1, -1):
            last = self.tables[k].where(F.col("whole") <= WIDTH).select("key", "block")
            found = last.join(hinted(tops), "key").select("key", "block", "top", "path")
            paths = found if paths is None else found.unionByName(paths)
            if k:
                paths = staged(self.climb(k, paths), f"{name}-{k}")
        return paths

    def climb(self, k: int, paths: DataFrame) -> DataFrame:
        """Paths of all leaves of level k, whose ranks are the blocks of the level below."""

        def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [[], [], [], []]
                for r in batch.to_pylist():
                    block = Block(r["count"], r["levels"], r["tree"])
                    for slot in range(block.count):
                        for column, value in zip(out, (r["key"], r["block"] * WIDTH + slot, r["top"], block.path(slot) + r["path"]), strict=True):
                            column.append(value)
                types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["key", "block", "top", "path"])

        blocks = self.tables[k].select("key", "block", "levels", "tree", F.size("rows").alias("count"))
        return blocks.join(hinted(paths), ["key", "block"]).mapInArrow(leaves, "key long, block long, top binary, path binary")


@dataclass
class Manifest:
    """A dataset's trees: ``forest`` over the rows of each group, ``crown`` over the groups' roots, and the root."""

    forest: Forest
    crown: Forest
    root: bytes | None


def build(leaves: DataFrame, group: str, order: list[str]) -> Manifest:
    """Trees over rows that have a binary column ``leaf``. Rows of a group stand by ``order``, groups by their value,
    null first. An empty table has no root.

    Other columns travel with their rows; none may be called rank, key, whole, digest, place, part or start. Ranks come
    from sorted ranges, so no group is sorted in one task.
    """
    rows = ranked(leaves, [group, *order], "manifest-rows")
    groups = rows.groupBy(group).agg(F.count(F.lit(1)).alias("whole"), F.min("rank").alias("start"))
    groups = ranked(groups.withColumnRenamed("start", "first_rank"), [group], "manifest-groups")
    side = hinted(groups.select(F.col(group).alias("group_value"), F.col("rank").alias("key"), "whole", "first_rank"))
    placed = rows.join(side, rows[group].eqNullSafe(F.col("group_value"))).withColumn("rank", F.col("rank") - F.col("first_rank"))
    forest = Forest.build(placed.drop("group_value", "first_rank").withColumnRenamed("leaf", "digest"), "manifest-blocks")
    n = groups.count()
    tops = forest.roots.select(F.lit(0).cast("long").alias("key"), F.lit(n).cast("long").alias("whole"), F.col("key").alias("rank"), F.col("root").alias("digest"))
    crown = Forest.build(tops, "manifest-crown")
    found = crown.roots.first()
    return Manifest(forest, crown, found and bytes(found["root"]))


def audit(manifest: Manifest, kept: list[str], claimed: str | None = None) -> DataFrame:
    """One row for each leaf: its columns ``kept``, leaf, subroot, root, proof_sha256 (of the stored siblings in order),
    folded_root and verified.

    The fold begins with the column ``claimed``, the digest of the row as it is found now, where that is not null, else with
    the stored leaf. A row whose fold does not end in the root is not verified.
    """
    crown = manifest.crown
    nothing = crown.roots.select("key", F.col("root").alias("top"), F.lit(b"").alias("path"))
    over = crown.above(nothing, "manifest-crown-paths")
    subroots = manifest.forest.roots.select("key", F.col("root").alias("top"))
    tops = staged(crown.climb(0, over).select(F.col("block").alias("key"), "path").join(hinted(subroots), "key"), "manifest-tops")
    paths = manifest.forest.above(tops, "manifest-paths")
    root = manifest.root

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels, trees, tops_, above, runs = (batch.column(c) for c in ("levels", "tree", "top", "path", "rows"))
            flat, counts, at = runs.flatten(), runs.value_lengths().to_pylist(), 0
            stored = flat.field("digest").to_pylist()
            now = flat.field(claimed).to_pylist() if claimed else [None] * len(stored)
            out: tuple[list, ...] = ([], [], [], [])
            for k, count in enumerate(counts):
                block, top, rest = Block(count, levels[k].as_py(), trees[k].as_py()), tops_[k].as_py().hex(), above[k].as_py()
                for slot in range(count):
                    ended, siblings = fold(now[at] or stored[at], block.path(slot) + rest)
                    for column, value in zip(out, (top, sha256(b"".join(siblings).hex().encode()).hexdigest(), ended.hex(), ended == root), strict=True):
                        column.append(value)
                    at += 1
            leaf = pa.array([d.hex() for d in stored], pa.string())
            made = [leaf, pa.array(out[0], pa.string()), pa.array([root.hex()] * len(leaf), pa.string()), *map(pa.array, out[1:3]), pa.array(out[3], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in kept), *made], [*kept, *RESULT])

    blocks = manifest.forest.tables[0]
    inside = blocks.schema["rows"].dataType.elementType
    fields = [f"`{c}` {inside[c].dataType.simpleString()}" for c in kept]
    fields += [f"{c} {'boolean' if c == 'verified' else 'string'}" for c in RESULT]
    return blocks.drop("whole", "root").join(hinted(paths), ["key", "block"]).mapInArrow(judge, ", ".join(fields))


def documents_manifest(docs: DataFrame, now: Callable[[Column], Column] | None = None) -> DataFrame:
    """The audit of a table of documents: leaves of ``FIELDS``, a tree for each source, doc_id ascending.

    ``now`` turns the text into the text as it is found now (null: as it was). Null values, ids and sources included,
    have leaves like any other; null ids come first. Rows with one doc_id stand in the order of their leaves, and
    repeated rows take neighbouring places. An empty table gives no rows. Columns beyond ``FIELDS`` don't count.
    """
    values = {c: F.col(c) for c in FIELDS}
    leaf = leaf_digest(list(values.values()))
    claimed = F.lit(None).cast("binary") if now is None else leaf_digest(list((values | {"text": now(values["text"])}).values()))
    narrow = docs.select("doc_id", "source", leaf.alias("leaf"), claimed.alias("claimed"))
    return audit(build(narrow, "source", ["doc_id", "leaf"]), ["doc_id"], "claimed")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampers = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return documents_manifest(docs, lambda text: F.when(tampers, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text))
