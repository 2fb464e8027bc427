"""Scores of texts under an n-gram model trained on the same table: a weighted backoff automaton.

States are the n-grams seen in training, up to one word less than the model's order. A state has an arc for each word
that followed it, and a failure arc to the state of its shorter context, taken when a word never followed. Both carry
log probabilities, smoothed by a Dirichlet prior: p(w | context) = (c(context w) + prior * p(w | shorter)) / (c(context) + prior),
so the failure arc weighs prior / (c(context) + prior). At the root a word weighs (c + 1) / (N + V + 1).

The automaton of a large corpus fits no task. Texts are dealt into blocks of a bounded size; each block sends its distinct
n-grams, as hashes, once to the shards that add up their counts, and gets back the totals of its own. From these a task
builds the part of the automaton that its texts can reach, every arc of it, and walks them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.shared import staged, table

ORDER = 2
#: Weight of the shorter context's distribution, in tokens.
PRIOR = 300.0
#: Bytes of text in a block; tasks of a shuffle at most.
BLOCK_BYTES, TASKS = 16 << 20, 20_000
#: What stands for the end of a text among word hashes: the hash of a string that no word can be.
END = xxhash.xxh64_intdigest(b" ")
_ODD, _MIX1, _MIX2 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _packed(values: np.ndarray) -> bytes:
    """Integers as planes of equally significant bytes, compressed: most planes hold almost nothing but zeros."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes, codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, with an end after each text, and where each text begins.

    Words are separated by spaces and \\t \\n \\v \\f \\r; A-Z are lower-cased. One more number closes the list of beginnings.
    """
    hashes, lengths = [], [np.zeros(1, np.int64)]
    for chunk in texts.chunks:
        split = pc.ascii_split_whitespace(pc.ascii_lower(chunk.cast(pa.large_string())))
        words = split.flatten()
        real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))
        upto = np.concatenate([[0], np.cumsum(real)])[ends]  # words up to the end of each text
        coded = words.dictionary_encode()
        names = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
        held = names[coded.indices.to_numpy(zero_copy_only=False)[real]] if len(names) else np.empty(0, np.uint64)
        hashes.append(np.insert(held, upto, np.uint64(END)))
        lengths.append(np.diff(upto, prepend=0) + 1)
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.cumsum(np.concatenate(lengths))


class Grams:
    """The distinct n-grams of a block for each n: ``keys[n]`` sorted hashes, ``at[n]`` for each token the place of the
    n-gram that ends there, -1 where the text has not so many tokens yet."""

    def __init__(self, texts: pa.ChunkedArray, order: int):
        words, self.starts = tokens(texts)
        inside = np.arange(len(words)) - np.repeat(self.starts[:-1], np.diff(self.starts))
        self.keys, self.at = {}, {}
        run = words
        for n in range(1, order + 1):
            if n > 1:
                run = np.concatenate([run[:1], _mixed(run[:-1] * _ODD + words[1:])]) if len(run) else run
            there = inside >= n - 1
            coded = pa.array(run[there]).dictionary_encode()
            found = coded.dictionary.to_numpy()
            rank = np.empty(len(found), np.int64)
            by = np.argsort(found)
            rank[by] = np.arange(len(found))
            self.keys[n] = found[by]
            self.at[n] = np.full(len(words), -1)
            self.at[n][there] = rank[coded.indices.to_numpy()]

    def counts(self, n: int, weight: np.ndarray) -> np.ndarray:
        """How often each n-gram occurs in texts, each of which counts ``weight`` times."""
        each, at = np.repeat(weight, np.diff(self.starts)), self.at[n]
        return np.bincount(at[at >= 0], each[at >= 0], len(self.keys[n])).astype(np.int64)


class Automaton:
    """The part of the backoff automaton that a block's texts reach. ``arc[n]``: log10 weight of the arc by which an n-gram's
    last word leaves the state before it, NaN if there is none. ``fail[n]``: of the failure arc of the n-gram's state."""

    def __init__(self, grams: Grams, counts: dict[int, np.ndarray], n_tokens: int, n_words: int, prior: float):
        self.grams, self.order, self.counts = grams, max(counts), counts
        self.unknown = -math.log10(n_tokens + n_words + 1)
        self.arc, self.fail = {1: np.log10(counts[1] + 1) + self.unknown}, {}
        shorter = 10 ** self.arc[1]
        for n in range(2, self.order + 1):
            # a place where each n-gram ends leads to its context and to the n-gram without the first word
            place, at = np.zeros(len(grams.keys[n]), np.int64), grams.at[n]
            place[at[at >= 0]] = np.flatnonzero(at >= 0)
            context = counts[n - 1][grams.at[n - 1][place - 1]] if len(place) else np.empty(0)
            chance = (counts[n] + prior * shorter[grams.at[n - 1][place]]) / (context + prior)
            with np.errstate(divide="ignore"):
                self.arc[n] = np.where(counts[n] > 0, np.log10(chance), np.nan)
            self.fail[n - 1] = np.log10(prior / (counts[n - 1] + prior))
            shorter = chance

    def walk(self) -> np.ndarray:
        """log10 probability of every token. Left to right, the state after a token is the longest n-gram known that ends
        there; from it the next token takes its arc, or failure arcs until a state has one. The root has one for all."""
        out = np.zeros(len(self.grams.at[1]))
        waiting = np.arange(len(out))
        for n in range(self.order, 1, -1):
            here = self.grams.at[n][waiting]
            state = self.grams.at[n - 1][waiting - 1]
            able = here >= 0
            arc = np.where(able, self.arc[n][here] if len(self.arc[n]) else np.nan, np.nan)
            taken = ~np.isnan(arc)
            out[waiting[taken]] += arc[taken]
            left = ~taken
            # a context that was never seen is no state: its failure arc weighs 1
            out[waiting[left]] += np.where(able[left], self.fail[n - 1][state[left]], 0.0)
            waiting = waiting[left]
        out[waiting] += self.arc[1][self.grams.at[1][waiting]]
        return out


def _shards(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each shard's slice of sorted hashes begins and ends: shards are ranges of hashes."""
    bounds = np.array([-(-(k << 64) // n) for k in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def _sender(order: int, n_shards: int) -> Callable[[pa.Table], pa.Table]:
    def send(block: pa.Table) -> pa.Table:
        grams = Grams(block.column("text"), order)
        train = block.column("train").to_numpy().astype(np.int64)
        rows: list[tuple] = []
        for n in range(1, order + 1):
            keys, counts = grams.keys[n], grams.counts(n, train)
            ends = _shards(keys, n_shards)
            for shard, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                if a < b:
                    rows.append((n, shard, b - a, _packed(np.diff(keys[a:b], prepend=np.uint64(0))), _packed(counts[a:b])))
        block_id = block.column("block")[0].as_py()
        columns = [pa.array([block_id] * len(rows), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True))]
        return pa.table(columns, ["block", "n", "shard", "size", "keys", "counts"])

    return send


SENT = "block long, n int, shard long, size long, keys binary, counts binary"


def _added(rows: pa.Table) -> pa.Table:
    """Totals of one shard, for each block in the order of its own hashes; on the first row how many tokens and distinct
    n-grams the shard has in training."""
    sizes = rows.column("size").to_pylist()
    keys = np.concatenate([np.cumsum(_unpacked(k, s), dtype=np.uint64) for k, s in zip(rows.column("keys").to_pylist(), sizes, strict=True)])
    counts = np.concatenate([_unpacked(c, s) for c, s in zip(rows.column("counts").to_pylist(), sizes, strict=True)])
    coded = pa.array(keys).dictionary_encode()
    at = coded.indices.to_numpy()
    totals = np.bincount(at, counts, len(coded.dictionary)).astype(np.int64)
    answers = np.split(totals[at], np.cumsum(sizes)[:-1])
    n = len(sizes)
    tokens_, distinct = ([int(x)] + [0] * (n - 1) for x in (totals.sum(), (totals > 0).sum()))
    columns = [rows.column("block"), rows.column("n"), rows.column("shard"), rows.column("size")]
    made = [pa.array([_packed(a) for a in answers], pa.binary()), pa.array(tokens_, pa.int64()), pa.array(distinct, pa.int64())]
    return pa.table([*columns, *made], ["block", "n", "shard", "size", "totals", "tokens", "distinct"])


TOTALS = "block long, n int, shard long, size long, totals binary, tokens long, distinct long"


def _scorer(order: int, n_tokens: int, n_words: int, prior: float, kept: list[str]):
    def score(block: pa.Table, totals: pa.Table) -> pa.Table:
        grams = Grams(block.column("text"), order)
        counts = {}
        for n in range(1, order + 1):
            rows = sorted((r for r in totals.select(["n", "shard", "size", "totals"]).to_pylist() if r["n"] == n), key=lambda r: r["shard"])
            counts[n] = np.concatenate([np.empty(0, np.uint64), *(_unpacked(r["totals"], r["size"]) for r in rows)]).astype(np.float64)
        automaton = Automaton(grams, counts, n_tokens, n_words, prior)
        first, seen = grams.starts[:-1], counts[1][grams.at[1]]

        def over(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, first)

        base = over(np.log10(seen + 1)) + np.diff(grams.starts) * -math.log10(n_tokens + n_words + 1)
        made = [np.diff(grams.starts), over((seen > 0).astype(np.int64)), np.full(len(first), n_tokens), base, over(automaton.walk())]
        return pa.table([*(block.column(c) for c in kept), *map(pa.array, made)], [*kept, *RESULT])

    return score


RESULT = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def scored(docs: DataFrame, train: Column, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """One row for each document: doc_id, held_out (not ``train``), n_tokens (words and one end), n_known (of them seen in
    training), train_tokens, base_score (log10, each token (c + 1) / (N + V + 1)), score (log10 probability of the text under
    the backoff automaton).

    Null texts are empty ones: their end is their only token. Nulls of ``train`` count as false, null ids are kept. Without any
    training text every token weighs 1. Further columns don't matter. An empty table gives no rows.

    A text is dealt by a hash of itself and its id, so copies of one text spread. Word and n-gram hashes have 64 bits.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", text.alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = docs.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    tasks = min(2 * blocks, TASKS)
    dealt = narrow.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(tasks, "block")
    sent = dealt.groupBy("block").applyInArrow(_sender(order, blocks), SENT)
    totals = staged(sent.repartition(tasks, "n", "shard").groupBy("n", "shard").applyInArrow(_added, TOTALS), "lm-totals")
    words = totals.where("n = 1").agg(F.sum("tokens"), F.sum("distinct")).first()
    scorer = _scorer(order, words[0] or 0, words[1] or 0, prior, ["doc_id", "train"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = totals.select("block", "n", "shard", "size", "totals")
    return (
        dealt.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(scorer, ddl)
        .select("doc_id", (~F.col("train")).alias("held_out"), *RESULT)
    )


def op13_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return scored(table(spark, sf_dir, "documents"), ~F.coalesce(held_out, F.lit(False)))
