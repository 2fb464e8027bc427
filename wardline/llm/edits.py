"""Token counts that follow edits: a segment tree of pre-token runs for each document.

A leaf is a stretch of text that is pre-tokenized the same whatever stands around it: one blank and what
follows up to the next white space, or white space in front of such a stretch. Leaves carry characters and
tokens, inner nodes their sums. An edit re-encodes its own leaves and as much context as their bounds need,
puts the result in the place of the old leaves, and corrects the sums on the way to the root.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardline.llm import pieces
from wardline.llm.shared import hinted, kept, staged, table

#: Unicode white space, as the pre-tokenizer's pattern has it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LEAF = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
OPENS = re.compile(f" [^{WHITE}]")

Edit = tuple[int, int, str]


class LeafCounter:
    """Tokens of a leaf by the tokenizers library, each distinct leaf encoded once. Specials are plain text."""

    def __init__(self, tokenizer: str, limit: int = 1_000_000):
        self.library = pieces.load(tokenizer)
        self.library.encode_special_tokens = True
        self.limit = limit
        self.memo: dict[str, int] = {}

    def learn(self, texts_leaves: list[list[str]]) -> None:
        if len(self.memo) > self.limit:
            self.memo = {}
        new = list(set().union(*texts_leaves).difference(self.memo)) if texts_leaves else []
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            found = self.library.encode_batch_fast(some, add_special_tokens=False)
            self.memo.update(zip(some, (len(x.ids) for x in found), strict=True))

    def counts(self, leaves: list[str]) -> list[int]:
        try:
            return list(map(self.memo.__getitem__, leaves))
        except KeyError:
            self.learn([leaves])
            return list(map(self.memo.__getitem__, leaves))


class CountTree:
    """Leaves of one document in a perfect binary tree; ``chars`` and ``tokens`` hold the sums, the root at 1.

    It is made from a text, or from the text and the stored characters and tokens of its leaves: then nothing is
    tokenized before an edit asks for it.
    """

    def __init__(self, text: str, leaf_chars: np.ndarray, leaf_tokens: np.ndarray, counter: LeafCounter):
        self.counter, self.source = counter, text
        self.leaf_chars, self.leaf_tokens = np.asarray(leaf_chars, np.int64), np.asarray(leaf_tokens, np.int64)
        self.ends = np.cumsum(self.leaf_chars)
        if len(text) != (self.ends[-1] if len(self.ends) else 0):
            raise ValueError("the tree is of another text")
        self.changed: dict[int, tuple[list[str], list[int]]] = {}  # slots that edits have filled anew, with none or many leaves
        self.base = 1 << max(0, len(self.leaf_chars) - 1).bit_length()
        self.chars, self.tokens = self._sums(self.leaf_chars), self._sums(self.leaf_tokens)
        self.encoded = 0  # leaves encoded anew by edits

    @classmethod
    def of(cls, text: str, counter: LeafCounter) -> CountTree:
        leaves = LEAF.findall(text)
        return cls(text, np.fromiter(map(len, leaves), np.int64, len(leaves)), np.array(counter.counts(leaves), np.int64), counter)

    def _sums(self, values: np.ndarray) -> np.ndarray:
        tree = np.zeros(2 * self.base, np.int64)
        tree[self.base : self.base + len(values)] = values
        at = self.base
        while at > 1:
            tree[at // 2 : at] = tree[at : 2 * at : 2] + tree[at + 1 : 2 * at : 2]
            at //= 2
        return tree

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def held(self, slot: int) -> list[str]:
        if slot in self.changed:
            return self.changed[slot][0]
        end = int(self.ends[slot]) if slot < len(self.ends) else 0
        return [self.source[end - int(self.leaf_chars[slot]) : end]] if slot < len(self.ends) else []

    def text(self, low: int = 0, high: int | None = None) -> str:
        """The text of all slots, or of those from ``low`` to before ``high``: what no edit has filled anew is cut from the source."""
        parts, n = [], len(self.ends)
        high = max(1, n) if high is None else high
        place = lambda slot: int(self.ends[min(slot, n) - 1]) if min(slot, n) > 0 else 0  # noqa: E731  where a slot begins
        for slot in sorted(k for k in self.changed if low <= k < high):
            parts += [self.source[place(low) : place(slot)], *self.changed[slot][0]]
            low = slot + 1
        return "".join([*parts, self.source[place(low) : place(high)]])

    def stored(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of the leaves as they are now, to be kept for later edits."""
        chars, tokens, low = [], [], 0
        for slot in sorted(self.changed):
            leaves, counts = self.changed[slot]
            chars += [self.leaf_chars[low:slot], list(map(len, leaves))]
            tokens += [self.leaf_tokens[low:slot], counts]
            low = slot + 1
        joined = lambda parts: np.concatenate([np.asarray(x, np.int64) for x in parts])
        return joined([*chars, self.leaf_chars[low:]]), joined([*tokens, self.leaf_tokens[low:]])

    def _find(self, char: int) -> tuple[int, int]:
        """Slot that holds a character, and the slot's first character; the last slot for the end of the text."""
        node, before = 1, 0
        while node < self.base:
            node *= 2
            if char - before >= self.chars[node] and self.chars[node + 1]:
                before += int(self.chars[node])
                node += 1
        return node - self.base, before

    def _put(self, slot: int, leaves: list[str], counts: list[int]) -> None:
        self.changed[slot] = leaves, counts
        node = self.base + slot
        d_chars = sum(map(len, leaves)) - int(self.chars[node])
        d_tokens = sum(counts) - int(self.tokens[node])
        while node:
            self.chars[node] += d_chars
            self.tokens[node] += d_tokens
            node //= 2

    def _opens(self, slot: int) -> bool:
        """A bound before one blank and a word stays a bound whatever comes before it."""
        held = self.held(slot)
        return bool(held) and bool(OPENS.match(held[0]))

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` for the characters from ``start`` to before ``end``."""
        if not 0 <= start <= end <= self.chars[1]:
            raise ValueError("edit outside the text")
        low, at = self._find(start)
        # the bound before the window must not depend on what changes
        while low > 0 and not (self._opens(low) and at + 2 <= start):
            low -= 1
            at -= int(self.chars[self.base + low])
        high, before = self._find(end)
        after = before + int(self.chars[self.base + high])
        high += 1
        while high < len(self.leaf_chars) and not self._opens(high):
            after += int(self.chars[self.base + high])
            high += 1
        old = self.text(low, high)
        leaves = LEAF.findall(old[: start - at] + new + old[end - at :])
        # white space at the window's end met the end of a string here, but a word follows it in the text:
        # its last character would open the next leaf only if it were a blank, which _opens rules out
        self.encoded += len(leaves)
        self._put(low, leaves, self.counter.counts(leaves))
        for slot in range(low + 1, high):
            if self.held(slot):
                self._put(slot, [], [])

    def apply(self, edits: list[Edit]) -> None:
        """Edits of the text as it was when the tree was built, none overlapping: the last first, so places hold."""
        for start, end, new in sorted(edits, reverse=True):
            self.replace(start, end, new)


def counter(tokenizer: str) -> LeafCounter:
    return kept(("leaves", tokenizer), lambda: LeafCounter(tokenizer))


#: What the query's edits take out: mail addresses and long numbers, each for a placeholder.
PERSONAL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\+?[0-9][0-9 ()./-]{7,}[0-9]")


def redactions(text: str) -> list[Edit]:
    return [(m.start(), m.end(), "<mail>" if "@" in m[0] else "<number>") for m in PERSONAL.finditer(text)]


KEY = ("__id", "__text_hash")
LEAVES = "leaf_chars array<int>, leaf_tokens array<int>"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, hash of the text and text: rows that repeat both are one document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__text_hash"), text.alias("__text"))


def _ints(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays]).astype(np.int32)))


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = pieces.BYTE_BPE) -> DataFrame:
    """The tree of every row: __id, __text_hash, n_tokens (the root's sum), n_leaves, leaf_chars and leaf_tokens.

    To be written as a table: later edits read the rows of their documents and count nothing else again. The
    sums between leaves and root follow from the leaves. Null counts as empty; an empty text has no leaves.
    """
    keyed = _keyed(docs, id_col, text_col)
    fields = StructType([keyed.schema["__id"], keyed.schema["__text_hash"], *StructType.fromDDL(f"n_tokens long, n_leaves long, {LEAVES}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                split = [LEAF.findall(t) for t in part.column(2).to_pylist()]
                counts.learn(split)
                tokens = [np.array(counts.counts(leaves), np.int64) for leaves in split]
                chars = [np.fromiter(map(len, leaves), np.int64, len(leaves)) for leaves in split]
                totals = pa.array([int(t.sum()) for t in tokens], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), totals, pa.array([len(x) for x in split], pa.int64()), _ints(chars), _ints(tokens)], fields.fieldNames())

    return keyed.mapInArrow(run, fields)


EDITS = "array<struct<start: bigint, end: bigint, new: string>>"


def find_edits(docs: DataFrame, edits: Callable[[str], list[Edit]] = redactions, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, __text_hash, __text and edits of the documents that ``edits`` has any for, each once."""
    keyed = _keyed(docs, id_col, text_col)
    fields = StructType([*keyed.schema.fields, *StructType.fromDDL(f"edits {EDITS}").fields])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("new", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                found = [[{"start": a, "end": b, "new": new} for a, b, new in edits(t)] for t in part.column(2).to_pylist()]
                whole = pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], fields.fieldNames())
                yield whole.filter(pa.array([bool(x) for x in found], pa.bool_()))

    return keyed.mapInArrow(run, fields).dropDuplicates(list(KEY))


def apply_edits(wanted: DataFrame, trees: DataFrame, tokenizer: str = pieces.BYTE_BPE) -> DataFrame:
    """Staged edits (__id, __text_hash, __text, edits) applied to the stored trees of their documents.

    One row per edited document: __id, __text_hash (of the text as it was), n_edits, n_tokens, encoded_leaves,
    leaf_chars, leaf_tokens and edited (the text as it is now). Only leaves in and beside an edit are tokenized.
    Edits are in characters of the text as it was, none overlapping.
    """
    asked = hinted(wanted.select(*[F.col(c).alias(f"asked{c}") for c in KEY]))
    held = trees.join(asked, [F.col(c).eqNullSafe(F.col(f"asked{c}")) for c in KEY], "left_semi").dropDuplicates(list(KEY))
    held = held.select(*[F.col(c).alias(f"tree{c}") for c in KEY], "leaf_chars", "leaf_tokens")
    on = [F.col(c).eqNullSafe(F.col(f"tree{c}")) for c in KEY]
    joined = wanted.join(held, on).select(*KEY, "__text", "edits", "leaf_chars", "leaf_tokens")
    made = StructType.fromDDL(f"n_edits int, n_tokens long, encoded_leaves long, {LEAVES}, edited string").fields
    fields = StructType([*[joined.schema[c] for c in KEY], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows, chars, tokens = [], [], []
                for i, (text, edits) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    tree = CountTree(text, part.column(4)[i].values.to_numpy(), part.column(5)[i].values.to_numpy(), counts)
                    tree.apply([(e["start"], e["end"], e["new"]) for e in edits])
                    now = tree.stored()
                    chars.append(now[0])
                    tokens.append(now[1])
                    rows.append((len(edits), tree.total, tree.encoded, tree.text()))
                n, total, encoded, edited = zip(*rows, strict=True)
                columns = [pa.array(n, pa.int32()), pa.array(total, pa.int64()), pa.array(encoded, pa.int64()), _ints(chars), _ints(tokens), pa.array(edited, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], fields.fieldNames())

    return joined.mapInArrow(run, fields)


def renewed_trees(trees: DataFrame, edited: DataFrame) -> DataFrame:
    """``trees`` with those of edited documents replaced, under the hash of the text as it is now."""
    went = edited.select(*[F.col(c).alias(f"went{c}") for c in KEY])
    rest = trees.join(went, [F.col(c).eqNullSafe(F.col(f"went{c}")) for c in KEY], "left_anti")
    now = edited.select("__id", F.xxhash64("edited").alias("__text_hash"), "n_tokens", F.size("leaf_chars").cast("long").alias("n_leaves"), "leaf_chars", "leaf_tokens")
    return rest.select(*now.columns).unionByName(now)


def edited_counts(
    docs: DataFrame,
    edits: Callable[[str], list[Edit]] = redactions,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = pieces.BYTE_BPE,
) -> DataFrame:
    """One row per input row: id, n_tokens before, n_edits, edited_tokens, n_leaves, encoded_leaves, edited (the text).

    ``edits`` gives (start, end, replacement) in characters of the text, none overlapping. Null counts as
    empty. Empty texts have no tokens; repeated rows count alike; an empty table gives no rows; texts are read
    whole. ``edited`` is null where nothing changed. Only the two named columns are read. Trees are built and
    written once; edits read those of their documents.
    """
    trees = staged(build_trees(docs, id_col, text_col, tokenizer), "edit-trees")
    wanted = staged(find_edits(docs, edits, id_col, text_col), "edit-wanted")
    changed = staged(apply_edits(wanted, trees, tokenizer), "edit-changed")
    side = changed.select(*[F.col(c).alias(f"new{c}") for c in KEY], "n_edits", F.col("n_tokens").alias("edited_tokens"), "encoded_leaves", "edited")
    rows = trees.select(*KEY, "n_tokens", "n_leaves")
    joined = rows.join(side, [F.col(c).eqNullSafe(F.col(f"new{c}")) for c in KEY], "left")
    return joined.select(
        F.col("__id").alias(id_col),
        "n_tokens",
        F.coalesce("n_edits", F.lit(0)).alias("n_edits"),
        F.coalesce("edited_tokens", "n_tokens").alias("edited_tokens"),
        "n_leaves",
        F.coalesce("encoded_leaves", F.lit(0).cast("long")).alias("encoded_leaves"),
        "edited",
    )


def op10_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after personal data is taken out."""
    return edited_counts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", "n_edits", "edited_tokens", "n_leaves", "encoded_leaves"
    )
