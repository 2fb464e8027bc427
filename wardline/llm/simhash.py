"""SimHash near-duplicates: fingerprints, an inverted index on byte positions with count filtering, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wardline.llm.pieces import parts_of
from wardline.llm.shared import give_back, hinted, kept, staged, table, without_rows
from wardline.operators.linkage import golden_ids

BITS = 3
#: Members of one posting that are compared inside one task; larger postings are compared in blocks of so many.
BLOCK = 4_096
#: Rows of the index that a task compares at once: whole postings, or cells of two blocks.
BUCKET_ROWS = 65_536


def position_groups() -> list[tuple[int, ...]]:
    """Fourteen sets of four of the eight byte positions: whichever three bytes differ, one set avoids them all.

    They are the planes of the three-dimensional space over two elements: positions whose index bits, masked,
    have one given parity.
    """
    planes = []
    for mask in range(1, 8):
        for parity in (0, 1):
            planes.append(tuple(p for p in range(8) if bin(p & mask).count("1") % 2 == parity))
    assert all(any(not set(t) & set(p) for p in planes) for t in combinations(range(8), 3))
    return planes


def fingerprint(text: bytes, words: int, seed: int) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; 0 for a text without words."""
    held = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not held:
        return 0
    if len(held) <= words:
        return xxhash.xxh64_intdigest(b" ".join(held), seed)
    joined = b" ".join(held)
    ends = np.cumsum([len(w) + 1 for w in held]) - 1
    starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)], "<u8")
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[k : k + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    """id and fp (signed 64 bit) of every row."""
    fields = StructType([docs.schema[id_col], StructField("fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint((t or "").encode(), words, seed) for t in batch.column(1).to_pylist()]
            signed = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], fields.fieldNames())

    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, fields)


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Count filter, then verification: pairs with enough equal positional bytes that differ in few bits."""
    differ = a ^ b
    shared = np.zeros(differ.shape, np.int8)
    for byte in range(8):
        shared += (differ >> np.uint64(8 * byte)) & np.uint64(255) == 0
    near = shared >= 8 - bits
    near[near] = np.bitwise_count(differ[near]) <= bits
    return near


def _links(fps: np.ndarray, group: np.ndarray, bits: int, narrow: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of near pairs inside the runs of equal ``group``; ``fps`` is ordered by group."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, int)
    size = np.diff(np.concatenate([first, [len(group)]]))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    small = np.repeat(size <= narrow, size)
    for apart in range(1, int(size[size <= narrow].max(initial=0))):  # all small runs at once
        i = np.flatnonzero(small[:-apart] & (group[apart:] == group[:-apart]))
        i = i[_near(fps[i], fps[i + apart], bits)]
        found.append((i, i + apart))
    for start, n in zip(first[size > narrow].tolist(), size[size > narrow].tolist(), strict=True):
        run = fps[start : start + n]
        for k in range(0, n, 256):
            i, j = np.nonzero(_near(run[k : k + 256, None], run[None, :], bits))
            found.append((i + k + start, j + start))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _forest(values: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Label of each place: the least place that it is linked to, directly or not."""
    label = np.arange(len(values))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def linked_pairs(prints: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that differ in at most ``bits`` (3 or fewer) bits: enough to span every component.

    ``prints`` has one row per distinct fp. Of eight bytes at least five are equal in such a pair, so the pair
    shares one of fourteen sets of four positions. The index holds each fingerprint under its fourteen
    (set, bytes) keys, 32 bits each, so postings stay short however large the table. Inside a posting shared
    bytes are tallied, pairs with fewer than five leave, the others are verified, and a posting gives a
    spanning forest of its links, never all its pairs. A posting with more than ``block`` members is cut into
    blocks, and each two blocks are compared in a task of their own.
    """
    keys = []
    for k, group in enumerate(position_groups()):
        parts = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in group]
        value = F.lit(k).cast("long")
        for part in parts:
            value = value * 256 + part
        keys.append(value)
    postings = staged(prints.select("fp", F.explode(F.array(*keys)).alias("key")), "simhash-postings")
    sizes = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = staged(sizes, "simhash-sizes")
    members = postings.join(sizes, "key")
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), n_blocks).cast("int")
    members = members.withColumn("blocks", n_blocks).withColumn("own", F.when(F.col("n") <= block, 0).otherwise(own))
    # a member of block k meets block m in the task (min, max); alone in its posting's only block it stays once
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda m: F.struct(F.least("own", m).alias("low"), F.greatest("own", m).alias("high")),
    )
    dealt = members.select("fp", "key", "own", F.explode(meets).alias("cell")).select("fp", "key", "own", "cell.low", "cell.high")

    total = dealt.count()
    bucket = F.pmod(F.xxhash64("key", "low", "high"), F.lit(max(1, -(-total // BUCKET_ROWS))))
    fields = "a long, b long"

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "low", "high", "fp"], ignore_index=True)
        fps = rows["fp"].to_numpy(np.int64).view(np.uint64)
        changed = rows[["key", "low", "high"]].diff().ne(0).any(axis=1)
        i, j = _links(fps, changed.cumsum().to_numpy(np.int64), bits)
        label = _forest(fps, i, j)
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": fps[label[tied]].view(np.int64), "b": fps[tied].view(np.int64)})

    links = dealt.groupBy(bucket.alias("bucket")).applyInPandas(compare, fields)
    return links.distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, label) for every fingerprint, label being the least fp (as stored) it is linked to, directly or not."""
    labels = golden_ids(links).select(F.col("id").alias("fp"), F.col("golden_id").alias("label"))
    return nodes.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    bits: int = BITS,
    seed: int = 42,
    block: int = BLOCK,
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits) and component_id, the least id reachable by links.

    Fingerprints link at ``bits`` or fewer differing bits, 3 at most. Null, empty and blank texts have
    fingerprint zero, which links like any other; texts with fewer words than a shingle are one shingle. Equal
    texts and repeated rows share a fingerprint and are folded before any pairing. A null id counts in its
    group but names it only if all are null. An empty table gives no rows. Only the two named columns are read.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the index guarantees matches up to 3 bits")
    prints = staged(fingerprints(docs, id_col, text_col, words, seed), "simhash-prints")
    nodes = staged(prints.groupBy("fp").agg(F.min(id_col).alias("least_id")), "simhash-nodes")
    labels = staged(components(nodes.select("fp"), linked_pairs(nodes.select("fp"), bits, block)), "simhash-labels")
    named = nodes.join(labels, "fp")
    groups = staged(named.groupBy("label").agg(F.min("least_id").alias("component_id")), "simhash-groups")
    by_print = staged(named.join(hinted(groups), "label").select(F.col("fp").alias("__fp"), "component_id"), "simhash-components")
    return prints.join(by_print, F.col("fp") == F.col("__fp")).select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def spanning_forest(links: DataFrame) -> DataFrame:
    """Links that join the same components as the staged ``links``, at most one for each node and task.

    Tasks get so many links at a time that they fit memory, and each ties its nodes to the least they reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = _forest(nodes, places[: len(a)], places[len(a) :])
        tied = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[label[tied]]), pa.array(nodes[tied])], ["a", "b"])

    tasks = max(1, -(-links.count() // BUCKET_ROWS))
    return links.select("a", "b").repartition(tasks).mapInArrow(run, "a long, b long")


# ---- near copies by similarity, for texts that differ in more than a few bits

MIXERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 65)], np.uint64)
#: Shingles that a part of a task's texts holds so often are counted over the table; so many of them are ordered by count.
OFTEN, OFTEN_MOST = 4, 200_000
#: A posting of more members is busy: its shingle, now counted over the whole table, is ordered by that count. So many rounds of it.
BUSY, BUSY_ROUNDS = 1000, 3
#: Bits of the parity sketch that bounds an overlap from above; larger sets have a second one of twice their size or more.
PARITY_BITS = 1024


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of many texts, repeats included, and bounds: text k has those from bounds[k] to bounds[k + 1].

    Words are cut at ASCII white space, A-Z in lower case. A text with fewer words than a shingle is one
    shingle, one without words has none. Each different word is hashed once.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    held = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in held), np.uint64, len(held))
    filled = np.fromiter((w != "" for w in held), bool, len(held))
    at = coded.indices.to_numpy()
    kept_words = filled[at]
    offsets = lists.offsets.to_numpy().astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(kept_words)])[offsets - offsets[0]]
    word = hashes[at[kept_words]]
    n, size = len(word), np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    total = word * MIXERS[0]
    for k in range(1, min(words, n)):
        same = owner[k:] == owner[:-k]
        total[:-k] += np.where(same, word[k:] * MIXERS[k], np.uint64(0))
    n_shingles = np.where(size > 0, np.maximum(1, size - words + 1), 0)
    opens = np.arange(n) - np.repeat(bounds[:-1], size) < np.repeat(n_shingles, size)
    return mixed(total[opens]), np.concatenate([[0], np.cumsum(n_shingles)])


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The set of shingle hashes of each text, ascending."""
    for part in parts_of(texts):
        hashes, bounds = shingle_hashes(part, words)
        for start, end in pairwise(bounds.tolist()):
            yield np.unique(hashes[start:end])


def simhash(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set of shingle hashes; 0 for the empty set."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[k : k + 8192].astype("<u8").view(np.uint8), bitorder="little")
        total += bits.reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def prefix_length(n: int, similarity: float) -> int:
    """Leading shingles of which two similar sets share one, in whatever order of all shingles."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def parity_sketch(hashes: np.ndarray, bits: int = PARITY_BITS) -> bytes:
    """Bits that an odd number of hashes fall on: two sketches differ in at most as many bits as the sets have odd members."""
    slots = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((slots & 1).astype(np.uint8)).tobytes()


def wide_sketch(hashes: np.ndarray) -> bytes | None:
    """A sketch that strangers of the set's size can be told by; none where the common one is wide enough."""
    bits = 1 << (2 * len(hashes)).bit_length()
    return parity_sketch(hashes, bits) if bits > PARITY_BITS else None


def _odd_members(x: bytes, y: bytes) -> int:
    """Least number of members that only one of two sets has, by sketches of any two sizes: the larger is folded."""
    small, large = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(small ^ np.bitwise_xor.reduce(large.reshape(-1, len(small)), 0)).sum(dtype=np.int64))


def node_of(hashes: np.ndarray) -> int:
    """Name of a set of shingles: equal sets have one name."""
    return int(np.array(xxhash.xxh64_intdigest(hashes.tobytes(), 7), np.uint64).view(np.int64))


def frequent_shingles(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """Shingles of many texts, commonest first, counted over all of ``docs``.

    A task counts the shingles of some megabytes of text at a time and passes on those that occur ``OFTEN``
    times or more there, so what is summed is a lower bound of the true count. Any answer is right: the counts
    only order the shingles, which sets the cost and not the result. ``OFTEN_MOST`` are fetched at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None, dict)  # makes room
        for batch in batches:
            for part in parts_of(batch.column(0)):
                hashes, n = np.unique(shingle_hashes(part, words)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[n >= OFTEN].view(np.int64)), pa.array(n[n >= OFTEN])], ["h", "n"])
        give_back()

    counted = docs.select(text_col).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.desc("n"), "h").limit(OFTEN_MOST).select("h").toArrow()["h"].to_numpy().view(np.uint64)


def order_of(commonest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles ascending, and the place of each in ``commonest``, to be looked up in."""
    place = np.argsort(commonest)
    return commonest[place], place


def prefix_of(hashes: np.ndarray, order: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """First shingles of a set under one order of all: rare ones first, by hash, then those of ``order``, the commonest last."""
    often, places = order
    at = np.minimum(np.searchsorted(often, hashes), max(len(often) - 1, 0))
    late = often[at] == hashes if len(often) else np.zeros(len(hashes), bool)
    ordered = np.concatenate([hashes[~late], hashes[late][np.argsort(-places[at[late]], kind="stable")]])
    return ordered[: prefix_length(len(hashes), similarity)].view(np.int64)


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)], dtype=np.int32)), pa.array(np.concatenate(parts)))


def described(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, commonest: np.ndarray) -> DataFrame:
    """id, node (name of the text's set of shingles), fp, size, prefix (``prefix_of``, commonest shingles last), parity and
    wide (sketches) of every row."""
    order = docs.sparkSession.sparkContext.broadcast(order_of(commonest))
    made = "node long, fp long, size int, prefix array<long>, parity binary, wide binary"
    fields = StructType([docs.schema[id_col], *StructType.fromDDL(made).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None, dict)  # makes room
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                nodes, fps, sizes, prefixes, parities, wides = [], [], [], [], [], []
                for hashes in shingle_sets(part.column(1), words):
                    nodes.append(node_of(hashes))
                    fps.append(simhash(hashes))
                    sizes.append(len(hashes))
                    prefixes.append(prefix_of(hashes, order.value, similarity))
                    parities.append(parity_sketch(hashes))
                    wides.append(wide_sketch(hashes))
                columns = [
                    part.column(0),
                    pa.array(nodes, pa.int64()),
                    pa.array(np.array(fps, np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int32()),
                    lists(prefixes),
                    pa.array(parities, pa.binary()),
                    pa.array(wides, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, fields.fieldNames())
        give_back()

    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, fields)


def index_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) whose fingerprints ``linked_pairs`` ties: at most ``BITS`` differing bits."""
    first = staged(nodes.groupBy("fp").agg(F.min("node").alias("first")), "similar-prints-of-nodes")
    equal = nodes.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    end = lambda x: first.select(F.col("fp").alias(f"fp_{x}"), F.col("first").alias(x))
    links = linked_pairs(first.select("fp")).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    return equal.union(links.join(end("a"), "fp_a").join(end("b"), "fp_b").select("a", "b"))


def postings(nodes: DataFrame) -> DataFrame:
    """key, n and first, the least node, of the postings of two nodes or more."""
    keyed = nodes.select("node", F.explode("prefix").alias("key"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("n > 1")


def shared_prefixes(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Members of the staged postings: key, node, size, place, and first, the least node of the posting."""
    return nodes.select("node", "size", F.posexplode("prefix").alias("place", "key")).join(keys.select("key", "first"), "key")


def reordered(nodes: DataFrame, texts, busy: np.ndarray, commonest: np.ndarray, words: int, similarity: float) -> DataFrame:
    """``nodes`` with prefixes under a new ``commonest``, which is the one before and, at its end, the ``busy`` shingles.

    These were rare, so they only move back: where a prefix has none of them it stays as it is, and only texts of
    the other nodes are read. ``texts`` gives (node, body) of some nodes.
    """
    order = nodes.sparkSession.sparkContext.broadcast(order_of(commonest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                prefixes = [prefix_of(h, order.value, similarity) for h in shingle_sets(part.column(1), words)]
                yield pa.RecordBatch.from_arrays([part.column(0), lists(prefixes)], ["node", "ahead"])

    moved = nodes.sparkSession.createDataFrame(pa.table({"key": busy.view(np.int64)}))  # at most OFTEN_MOST
    keyed = nodes.select("node", "least_id", F.explode("prefix").alias("key"))
    touched = staged(keyed.join(F.broadcast(moved), "key").select("node", "least_id").distinct(), "similar-touched")
    ahead = staged(texts(touched).mapInArrow(run, "node long, ahead array<long>"), "similar-ahead")
    columns = [F.coalesce("ahead", "prefix").alias("prefix") if c == "prefix" else F.col(c) for c in nodes.columns]
    return nodes.join(ahead, "node", "left").select(*columns)


def calmed(nodes: DataFrame, texts, commonest: np.ndarray, words: int, similarity: float, busy: int = BUSY) -> tuple[DataFrame, DataFrame]:
    """The nodes and their staged ``postings``, after shingles of postings with more than ``busy`` members got their place
    by their count over the whole table, so that texts meet on rarer ones. The order sets the cost, not the result."""
    for _ in range(BUSY_ROUNDS):
        keys = staged(postings(nodes), "similar-keys")
        most = keys.where(F.col("n") > busy).orderBy(F.desc("n"), "key").limit(OFTEN_MOST).select("key").toArrow()
        found = most["key"].to_numpy().view(np.uint64)
        found = found[~np.isin(found, commonest)]  # one that is ordered already stands where no rarer one was left
        if not len(found):
            return nodes, keys
        commonest = np.concatenate([commonest, found])
        nodes = staged(reordered(nodes, texts, found, commonest, words, similarity), "similar-nodes")
    return nodes, staged(postings(nodes), "similar-keys")


def sized(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b), with their sizes, whose sizes allow the similarity."""
    side = lambda x: hinted(nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}")))
    near = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9
    return pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b", "size_a", "size_b")


def sketched(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b, size_a, size_b) whose sketches allow the similarity: none that is similar leaves.

    All are tried on the common sketch, then those of two large sets on their own ones.
    """
    fields = "a long, b long, size_a int, size_b int"

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy().astype(np.int64) for c in ("size_a", "size_b"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8").reshape(len(a), -1) for c in ("sketch_a", "sketch_b"))
            yield batch.filter(pa.array(_allowed(a, b, x, y, similarity))).select(["a", "b", "size_a", "size_b"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size_a").to_numpy().astype(np.int64) + batch.column("size_b").to_numpy()
            least = _least_overlap(sizes, similarity)
            sketches = zip(batch.column("sketch_a"), batch.column("sketch_b"), strict=True)
            odd = np.array([_odd_members(x.as_py(), y.as_py()) for x, y in sketches], np.int64)
            yield batch.filter(pa.array((sizes - odd) / 2 >= least)).select(["a", "b", "size_a", "size_b"])

    def tried(rows: DataFrame, column: str, test) -> DataFrame:
        side = lambda x: nodes.where(f"{column} IS NOT NULL").select(F.col("node").alias(x), F.col(column).alias(f"sketch_{x}"))
        return rows.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(test, fields)

    first = staged(tried(pairs, "parity", common), "similar-near")
    large = F.least("size_a", "size_b") * 2 >= PARITY_BITS  # both have a sketch of their own
    return first.where(~large).union(tried(first.where(large), "wide", own)).select("a", "b")


def _least_overlap(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Common members that two similar sets have at least, by the sum of their sizes."""
    return np.ceil(similarity / (1 + similarity) * sizes - 1e-9)


def _allowed(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """For pairs of sets with sizes a, b and sketches x, y whether they can be similar."""
    odd = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9) & ((a + b - odd) / 2 >= _least_overlap(a + b, similarity))


def missed_pairs(shared: DataFrame, nodes: DataFrame, labels: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of nodes that may be similar and have different labels: none that is similar is left out.

    Prefix filter: similar sets of n shingles share one of their first ``prefix_length`` ones, so they meet in
    a posting of the staged ``shared``. ``labels`` has (node, label) of the nodes whose label is another node.
    Postings whose members have one label have nothing to add. In the others every two members of different
    labels meet, and leave by size, by place in the order and by the bound of their sketches, each of which
    keeps every similar pair. A posting with more than ``block`` members is cut into blocks that meet in tasks
    of their own; members with the posting's commonest label meet only those with another one.
    """
    named = shared.drop("first").join(hinted(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = staged(named, "missed-named")
    sizes = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("least"), F.max("label").alias("most"))
    sizes = staged(sizes.where("least <> most").select("key", "n"), "missed-sizes")
    large = sizes.where(F.col("n") > block).select("key")
    by_label = named.join(hinted(large), "key").groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    top = by_label.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top")).select("key", F.col("top.label").alias("top"), F.col("top.m").alias("m"))
    sizes = sizes.join(staged(top, "missed-tops"), "key", "left")
    members = named.join(staged(sizes, "missed-shares"), "key").join(nodes.select("node", "parity"), "node")
    cut = F.col("n") > block
    tops, others = F.ceil(F.col("m") / block).cast("int"), F.ceil((F.col("n") - F.col("m")) / block).cast("int")
    is_top = F.col("label") == F.col("top")
    mixed_in = F.pmod(F.xxhash64("node"), F.when(is_top, tops).otherwise(others)).cast("int")
    members = members.withColumn("own", F.when(~cut, 0).otherwise(F.when(is_top, others + mixed_in).otherwise(mixed_in)))
    last = F.when(~cut, 0).otherwise(F.when(is_top, others - 1).otherwise(others + tops - 1))
    meets = F.transform(F.sequence(F.lit(0), last), lambda m: F.struct(F.least("own", m).alias("low"), F.greatest("own", m).alias("high")))
    fields = ["key", "node", "size", "place", "label", "parity"]
    dealt = staged(members.select(*fields, F.explode(meets).alias("cell")).select(*fields, "cell.low", "cell.high"), "missed-dealt")
    bucket = F.pmod(F.xxhash64("key", "low", "high"), F.lit(max(1, -(-dealt.count() // BUCKET_ROWS))))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "low", "high", "node"], ignore_index=True)
        node, label = rows["node"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        size, place = rows["size"].to_numpy(np.int64), rows["place"].to_numpy(np.int64)
        parity = np.frombuffer(b"".join(rows["parity"]), "<u8").reshape(len(rows), -1)
        found = [np.empty((0, 2), np.int64)]
        for i, j in _meetings(rows[["key", "low", "high"]].diff().ne(0).any(axis=1).to_numpy()):
            differ = label[i] != label[j]
            i, j = i[differ], j[differ]
            least = np.minimum(place[i], place[j]) + np.minimum(size[i] - place[i], size[j] - place[j])
            near = least >= _least_overlap(size[i] + size[j], similarity)
            i, j = i[near], j[near]
            near = _allowed(size[i], size[j], parity[i], parity[j], similarity)
            pairs = np.stack([node[i[near]], node[j[near]]], 1)
            found.append(np.stack([pairs.min(1), pairs.max(1)], 1))
        return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])

    return dealt.groupBy(bucket.alias("bucket")).applyInPandas(compare, "a long, b long").distinct()


def _meetings(opens: np.ndarray, at_once: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of all pairs inside each run; a run begins where ``opens`` is true. Many pairs at a time."""
    first = np.flatnonzero(opens)
    ends = np.repeat(np.append(first[1:], len(opens)), np.diff(np.append(first, len(opens))))
    after = ends - np.arange(len(opens)) - 1
    cuts = np.flatnonzero(np.diff(np.cumsum(after) // at_once)) + 1
    for start, end in pairwise([0, *cuts.tolist(), len(opens)]):
        many = after[start:end]
        i = np.repeat(np.arange(start, end), many)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)


def similar_groups(docs: DataFrame, id_col: str, text_col: str, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per input row: id and component_id, the least id reachable by links.

    Texts link whose sets of word shingles have a Jaccard similarity of ``similarity`` or more, all of them.
    Candidates come from the byte-position index over 64-bit fingerprints, as in ``simhash_groups``, and from
    ties of the nodes of a posting of shared rare shingles to its least one; both are linear in their postings.
    An exact pass over those postings then meets every similar pair that is not in one group yet. Each
    candidate is compared on its sets of 64-bit shingle hashes. Texts without words are one group. Ids tell
    rows apart. Texts with equal shingles fold into one node first, so copies are compared once.
    """
    commonest = frequent_shingles(docs, text_col, words)
    prints = staged(described(docs, id_col, text_col, words, similarity, commonest), "similar-prints")
    folded = prints.groupBy("node").agg(F.min(F.struct(F.col(id_col).alias("id"), "fp", "size", "prefix", "parity", "wide")).alias("x"))
    nodes = staged(folded.select("node", F.col("x.id").alias("least_id"), "x.fp", "x.size", "x.prefix", "x.parity", "x.wide"), "similar-nodes")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                held = [h.view(np.int64) for h in shingle_sets(part.column(1), words)]
                yield pa.RecordBatch.from_arrays([part.column(0), lists(held)], ["node", "held"])

    def texts(speakers: DataFrame) -> DataFrame:
        """(node, body) of a staged table of nodes and their least ids."""
        named = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("body"))
        return named.join(hinted(speakers), F.col("__id") == F.col("least_id")).select("node", "body")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the staged candidates whose texts are similar."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        speakers = staged(ends.join(nodes.select("node", "least_id"), "node"), "similar-speakers")
        held = staged(texts(speakers).mapInArrow(sets, "node long, held array<long>"), "similar-sets")
        side = lambda x: held.select(F.col("node").alias(x), F.col("held").alias(f"held_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        overlap = F.size(F.array_intersect("held_a", "held_b"))
        either = F.size("held_a") + F.size("held_b") - F.col("overlap")
        alike = F.when(either == 0, True).otherwise(F.col("overlap") / either >= similarity)
        return staged(both.withColumn("overlap", overlap).where(alike).select("a", "b"), "similar-links")

    nodes, keys = calmed(nodes, texts, commonest, words, similarity)
    shared = staged(shared_prefixes(nodes, keys), "similar-shared")
    ties = shared.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    tied = index_pairs(nodes.select("node", "fp")).union(ties).distinct()
    pairs = staged(sketched(sized(tied, nodes, similarity), nodes, similarity), "similar-pairs")
    names = nodes.select(F.col("node").alias("fp"))
    forest = staged(spanning_forest(linked(pairs)), "similar-forest")
    labels = staged(components(names, forest), "similar-labels")
    moved = staged(labels.where("fp <> label").select(F.col("fp").alias("node"), "label"), "similar-moved")
    missed = staged(missed_pairs(shared, nodes, moved, similarity), "similar-missed")
    more = linked(staged(sketched(sized(missed, nodes, similarity), nodes, similarity), "similar-pairs"))
    if not more.isEmpty():
        labels = staged(components(names, forest.union(staged(spanning_forest(more), "similar-forest"))), "similar-labels")
    named = nodes.select("node", "least_id").join(labels.select(F.col("fp").alias("node"), "label"), "node")
    groups = staged(named.groupBy("label").agg(F.min("least_id").alias("component_id")), "similar-names")
    by_node = staged(named.join(hinted(groups), "label").select(F.col("node").alias("__node"), "component_id"), "similar-components")
    return prints.join(by_node, F.col("node") == F.col("__node")).select(id_col, "component_id")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``docs`` with one row of each group of ``similar_groups``, the one with the least id; columns as given.

    Texts without words are one group. A row is told by its id and text, so rows without an id are judged each
    for itself (and stay only if their group has no id); rows that repeat both stay or go together.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), text_hash.alias("text"))
    named = docs.select(key.alias("__key"), F.col(text_col).alias("__body"))
    groups = staged(similar_groups(named, "__key", "__body", words, similarity), "similar-groups")
    gone = groups.where(F.col("__key") != F.col("component_id")).select(F.col("__key").alias("__k"))
    return without_rows(docs, staged(gone, "similar-gone"), {"__k": key})


def op6_simhash_byte_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
