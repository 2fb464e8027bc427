"""Byte-level BPE by speculation: longest match proposes tokens, pair checks verify them, exact merging mends.

A proposal is right if each token is what merging makes of its own bytes and no merge would cross the bound
between two neighbours. Both are properties of the vocabulary, so all pairs of a batch are tested at once.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from wardline.llm import pieces
from wardline.llm.shared import kept, table

NEVER = np.int64(1 << 40)


class Lookup:
    """A fixed table of non-negative integers to integers, asked for whole arrays at once; -1 for unknown keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        size = 1 << int(64 - self.shift)
        self.keys, self.values = np.full(size + len(keys), -1, np.int64), np.full(size + len(keys), -1, np.int64)
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] < 0
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.values[at[first]] = keys[left[first]], values[left[first]]
            others = np.ones(len(left), bool)
            others[first] = False
            at, left = at[others] + 1, left[others]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] += 1
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself if printable, else one from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Merge tables of a byte-level BPE file, as arrays for the pair check."""

    def __init__(self, tokenizer: str):
        with open(pieces.resolve(tokenizer), encoding="utf-8") as f:
            stored = json.load(f)
        self.ids: dict[str, int] = stored["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in stored["added_tokens"]}
        size = max([*self.ids.values(), *self.specials.values()]) + 1
        self.rank = np.full(size, -1, np.int64)
        self.left = np.zeros(size, np.int64)
        self.right = np.zeros(size, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(stored["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, made = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges[x, y] = rank, made
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, x, y
        # the check goes back in time by ranks, so parts must be older than what they make
        self.ordered = all(r > max(self.rank[a], self.rank[b]) for (a, b), (r, _) in self.merges.items())
        keys = np.array([(a << 20 | b, r) for (a, b), (r, _) in self.merges.items()], np.int64).reshape(-1, 2)
        self.ranks = Lookup(keys[:, 0], keys[:, 1])
        self.made = np.zeros(max([r for r, _ in self.merges.values()], default=0) + 1, np.int64)
        for rank, made in self.merges.values():
            self.made[rank] = made
        self.text_of = {i: t for t, i in self.ids.items()}
        self.alphabet = byte_alphabet()
        self.single = np.full(256, -1, np.int64)
        for char, byte in self.alphabet.items():
            self.single[byte] = self.ids.get(char, -1)
        self.plain = all(c in self.alphabet for t in self.ids for c in t) and bool((self.single >= 0).all())
        self._grow_trie()
        self.whole = np.ones(size, bool)
        tokens = sorted(i for t, i in self.ids.items() if len(t) > 1 and all(c in self.alphabet for c in t))
        flat, ends = self.merge_all([self.text_of[i] for i in tokens])
        self.whole[tokens] = (np.diff(ends, prepend=0) == 1) & (flat[ends - 1] == tokens)

    def _grow_trie(self) -> None:
        """Nodes are the beginnings of tokens; a step goes from (node, byte) to the next one."""
        nodes, token, keys = {"": 0}, [-1], []
        for text, i in sorted(self.ids.items()):
            if not all(c in self.alphabet for c in text):
                continue
            for k in range(1, len(text) + 1):
                if text[:k] not in nodes:
                    keys.append((nodes[text[: k - 1]] << 8 | self.alphabet[text[k - 1]], len(nodes)))
                    nodes[text[:k]] = len(nodes)
                    token.append(-1)
            token[nodes[text]] = i
        keys = np.array(keys, np.int64).reshape(-1, 2)
        self.steps, self.token_at = Lookup(keys[:, 0], keys[:, 1]), np.array(token, np.int64)

    def bytes_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of words in the printable alphabet, one after another, and where each word ends."""
        flat = np.array([self.alphabet[c] for c in "".join(words)], np.uint8)
        return flat, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))

    def merge(self, word: str) -> list[int]:
        """Exact merging of one word."""
        return self.merge_all([word])[0].tolist()

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging: the pair of lowest rank, leftmost first, until none is left. Ids, and where each word ends.

        Every word makes its next merge at the same time as the others. A pair made by a merge is younger than
        it, so all places of a word's lowest rank can be merged in one step.
        """
        raw, ends = self.bytes_of(words)
        ids, owner = self.single[raw], np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = self._pair_ranks(ids, owner, np.arange(len(ids)))
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.append(first, len(ids)))
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            if (over := least == NEVER).any():
                done.append((owner[over], ids[over]))
                ids, owner, rank, least = ids[~over], owner[~over], rank[~over], least[~over]
                continue
            if self.ordered:
                hit = np.flatnonzero(rank == least)
                # in a run of places one apart, as in "aaaa", every other one from the left
                opens = np.concatenate([[True], np.diff(hit) != 1])
                start = np.maximum.accumulate(np.where(opens, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            else:  # one merge a word and step
                hit = np.flatnonzero(rank == least)
                hit = hit[np.unique(owner[hit], return_index=True)[1]]
            ids[hit] = self.made[rank[hit]]
            stays = np.ones(len(ids), bool)
            stays[hit + 1] = False
            place = np.cumsum(stays) - 1
            ids, owner, rank = ids[stays], owner[stays], rank[stays]
            changed = np.unique(np.concatenate([place[hit], np.maximum(place[hit] - 1, 0)]))
            rank[changed] = self._pair_ranks(ids, owner, changed)
        if not done:
            return np.empty(0, np.int64), ends
        owners, found = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owners, kind="stable")
        return found[order], np.cumsum(np.bincount(owners, minlength=len(words)))

    def _pair_ranks(self, ids: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each of the places; NEVER where there is none."""
        right = np.minimum(at + 1, len(ids) - 1)
        found = self.ranks[ids[at] << 20 | ids[right]]
        return np.where((found >= 0) & (right > at) & (owner[right] == owner[at]), found, NEVER)

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Longest match from the left, a token of every word at a time. Ids, and where each word ends."""
        raw, ends = self.bytes_of(words)
        at = ends - np.diff(ends, prepend=0)
        live = np.flatnonzero(at < ends)
        done: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        while len(live):
            found, length = self._longest(raw, at[live], ends[live])
            done.append((live, found))
            at[live] += length
            live = live[at[live] < ends[live]]
        owners, found = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owners, kind="stable")
        return found[order], np.cumsum(np.bincount(owners, minlength=len(words)))

    def _longest(self, raw: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that begins at each place, and its length."""
        found, length = np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64)
        live, node, depth = np.arange(len(at)), np.zeros(len(at), np.int64), 0
        while len(live):
            node = self.steps[node << 8 | raw[at[live] + depth]]
            known = node >= 0
            live, node, depth = live[known], node[known], depth + 1
            is_token = self.token_at[node] >= 0
            found[live[is_token]], length[live[is_token]] = self.token_at[node[is_token]], depth
            inside = at[live] + depth < ends[live]
            live, node = live[inside], node[inside]
        return found, length

    def is_whole(self, token: int, text: str) -> bool:
        """Whether merging the token's own bytes makes the token."""
        return bool(self.whole[token])

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether no merge crosses their bound.

        Undo the latest merge on either side of the bound, step by step; at each step the two tokens at the
        bound must not form a pair that is merged while both are there. Of equal merges the left is older.
        """
        a, b = left.astype(np.int64), right.astype(np.int64)
        until_a, until_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        fine, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            rank = self.ranks[x << 20 | y]
            rank = np.where(rank >= 0, rank, NEVER + 1)
            crossed = (rank < until_a[live]) & (rank <= until_b[live])
            fine[live[crossed]] = False
            go = ~crossed & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            live, x, y = live[go], x[go], y[go]
            newer = self.rank[x] > self.rank[y]
            on, off = live[newer], live[~newer]
            until_a[on], a[on] = self.rank[x[newer]], self.right[x[newer]]
            until_b[off], b[off] = self.rank[y[~newer]], self.left[y[~newer]]
        return fine

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Token ids (32-bit little-endian) of pre-token strings: propose all, check all neighbours, merge those that fail."""
        if not words:
            return []
        if not self.plain:
            raise ValueError("the vocabulary has no token for some byte")
        if not self.ordered:
            return _cut(*self.merge_all(words))
        flat, ends = self.propose(words)
        owner = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
        bad = np.zeros(len(words), bool)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] << 20 | flat[inner + 1], return_inverse=True)
        fits = self.compatible(pairs >> 20, pairs & ((1 << 20) - 1))
        bad[owner[inner[~fits[back]]]] = True
        bad[owner[~self.whole[flat]]] = True
        out = _cut(flat, ends)
        failed = np.flatnonzero(bad).tolist()
        for k, ids in zip(failed, _cut(*self.merge_all([words[k] for k in failed])), strict=True):
            out[k] = ids
        return out


def _cut(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw, stops = ids.astype("<u4").tobytes(), (4 * ends).tolist()
    return [raw[a:b] for a, b in pairwise([0, *stops])]


class SpeculativeEncoder:
    """Encodes whole texts. Memo: a blank-delimited piece of text to its ids, and pre-token words to theirs.

    The memos hold two times ``limit`` entries at most, what is used again longest.
    """

    JOINED = 400

    def __init__(self, tokenizer: str, limit: int = 300_000):
        self.vocabulary = Vocabulary(tokenizer)
        self.library = pieces.load(tokenizer)
        self.memo = pieces.Generations(limit)
        self.words = pieces.Generations(limit)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, bounds = self.encode_array(pa.array(texts, pa.string()))
        return _cut(ids, bounds[1:])

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and bounds: text k has ids[bounds[k] : bounds[k + 1]]. Null counts as empty."""
        found = [self._part(part) for part in pieces.parts_of(pc.fill_null(texts, ""))]
        sizes = np.concatenate([np.empty(0, np.int64), *(n for _, n in found)])
        ids = np.concatenate([np.empty(0, np.uint32), *(x for x, _ in found)])
        return ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def _part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the number of ids of each text."""
        odd = np.zeros(len(texts), bool)  # these are encoded as a whole
        for mark in ("\0", *self.vocabulary.specials):
            odd |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        # \0 marks a piece without a blank before it: the first of a text and those after a line feed
        plain = pc.if_else(pa.array(odd), "", texts)
        marked = pc.replace_substring(pc.binary_join_element_wise("\0", plain, ""), "\n", " \n \0")
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        bodies = self.memo.values(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self._learn)
        ids, bounds = pieces.laid_out(bodies, lists, coded.indices)
        if None in bodies:
            alone = np.fromiter((b is not None for b in bodies), bool, len(bodies))[coded.indices.to_numpy()]
            offsets = lists.offsets.to_numpy().astype(np.int64)
            odd |= np.diff(np.concatenate([[0], np.cumsum(~alone)])[offsets - offsets[0]]) > 0
        if not odd.any():
            return ids, np.diff(bounds)
        parts = [ids[a:b] for a, b in pairwise(bounds.tolist())]
        for k in np.flatnonzero(odd).tolist():
            parts[k] = np.frombuffer(self._whole(texts[k].as_py()), "<u4")
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _learn(self, new: list[str]) -> None:
        """Ids of pieces; None for one that doesn't stand alone: white space in a row or at an end."""
        memo = self.memo.young
        after_blank, first = [], []
        for piece in new:
            core = piece[1:] if piece[:1] == "\0" else piece
            if piece == "\n":
                memo[piece] = self._encode(["\n"])[0]
            elif not core or core[0].isspace() or core[-1].isspace():
                memo[piece] = None
            else:
                (first if piece[:1] == "\0" else after_blank).append(piece)
        for k in range(0, len(after_blank), 20_000):
            some = after_blank[k : k + 20_000]
            memo.update(zip(some, self._of_words(self._cut_joined(some, "", " ", "\u0120")), strict=True))
        for k in range(0, len(first), 20_000):
            some = first[k : k + 20_000]
            memo.update(zip(some, self._of_words(self._cut_joined([p[1:] for p in some], "\n", "", "\u010a")), strict=True))

    def _cut_joined(self, bodies: list[str], between: str, before: str, mark: str) -> list[list[str]]:
        """The library's pre-tokens of many pieces by one call for ``JOINED`` of them.

        Inside a piece no pre-token begins with a blank, and none is a line feed: those (in the printable
        alphabet, ``mark``) tell where the next piece begins.
        """
        cut, out = self.library.pre_tokenizer.pre_tokenize_str, []
        for k in range(0, len(bodies), self.JOINED):
            some = bodies[k : k + self.JOINED]
            words = [w for w, _ in cut(between.join([before + b for b in some]))]
            if before:
                opens = [i for i, w in enumerate(words) if w[0] == mark]
                found = [words[a:b] for a, b in pairwise([*opens, len(words)])]
            else:
                stops = [i for i, w in enumerate(words) if w == mark]
                found = [words[a:b] for a, b in zip([0, *(i + 1 for i in stops)], [*stops, len(words)], strict=True)]
            out += found if len(found) == len(some) else [[w for w, _ in cut(before + b)] for b in some]
        return out

    def _of_words(self, words: list[list[str]]) -> list[bytes]:
        """Ids of texts that are given as pre-tokens; each word is encoded once."""
        new = self.words.missing(list(set().union(*words)))
        known = self.words.young
        known.update(zip(new, self.vocabulary.encode_words(new), strict=True))
        return [b"".join([known[w] for w in ws]) for ws in words]

    def _encode(self, bodies: list[str]) -> list[bytes]:
        """Texts without specials."""
        cut = self.library.pre_tokenizer.pre_tokenize_str
        return self._of_words([[w for w, _ in cut(b)] for b in bodies])

    def _whole(self, text: str) -> bytes:
        """Any text: specials are found first, leftmost and longest, as the library does; the rest is pre-tokenized."""
        specials, out, at = self.vocabulary.specials, [], 0
        while specials:
            hits = [(p, -len(s), s) for s in specials if (p := text.find(s, at)) >= 0]
            if not hits:
                break
            p, _, s = min(hits)
            out += self._encode([text[at:p]]) + [struct.pack("<I", specials[s])]
            at = p + len(s)
        return b"".join(out + self._encode([text[at:]]))


def encoder(tokenizer: str) -> SpeculativeEncoder:
    return kept(("speculative", tokenizer), lambda: SpeculativeEncoder(tokenizer))


def bytes_of_tokens(stored: dict) -> list[bytes]:
    """The bytes of every id of a byte-level BPE file; specials are their own text."""
    alphabet = byte_alphabet()
    named = [*stored["model"]["vocab"].items(), *((t["content"], t["id"]) for t in stored["added_tokens"])]
    out = [b""] * (max(i for _, i in named) + 1)
    for text, i in named:
        known = all(c in alphabet for c in text)
        out[i] = bytes(alphabet[c] for c in text) if known else text.encode()
    return out


@lru_cache(maxsize=1)
def token_bytes(tokenizer: str) -> list[bytes]:
    with open(pieces.resolve(tokenizer), encoding="utf-8") as f:
        return bytes_of_tokens(json.load(f))


def decode_ids(ids: bytes | None, tokens: list[bytes]) -> str:
    """Text of 32-bit little-endian ids; bytes that are no UTF-8 become U+FFFD."""
    raw = b"".join(map(tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))
    return raw.decode("utf-8", "replace")


def decode_array(ids: np.ndarray, bounds: np.ndarray, tokens: pa.Array) -> pa.Array:
    """Texts of many rows' ids at once; ``tokens`` has the bytes of every id."""
    made = tokens.take(pa.array(ids.astype(np.int64)))
    raw = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), made), b"")
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:  # some row is no UTF-8
        return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())


def _rows_of(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value for each row, of its ids as 32-bit little-endian."""
    buffers = [None, pa.py_buffer((4 * bounds).astype("<i8").tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())]
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, buffers).cast(pa.binary())


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = pieces.BYTE_BPE) -> DataFrame:
    """id and ids (binary, 32-bit little-endian) of every row's whole text, as the library encodes it.

    Null counts as empty, and empty texts have no ids. Rows that repeat are encoded alike; an empty table gives
    no rows. Special tokens' strings in a text are those tokens. Only the two named columns are read.
    """
    fields = StructType([docs.schema[id_col], StructField("ids", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                ids = _rows_of(*coder.encode_array(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], fields.fieldNames())

    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, fields)


def bpe_decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = pieces.BYTE_BPE) -> DataFrame:
    """id, ids and the decoded text of every row; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    fields = StructType([tokens.schema[id_col], tokens.schema[ids_col], StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [decode_ids(ids, known) for ids in part.column(1).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, fields.fieldNames())

    return tokens.select(id_col, ids_col).mapInArrow(run, fields)


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = pieces.BYTE_BPE) -> DataFrame:
    """id, ids and decoded: ``bpe_decode`` of ``bpe_encode`` in one task, so that one worker holds the vocabulary."""
    fields = StructType([docs.schema[id_col], StructField("ids", BinaryType()), StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, known = encoder(tokenizer), pa.array(token_bytes(tokenizer), pa.binary())
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                ids, bounds = coder.encode_array(part.column(1))
                columns = [part.column(0), _rows_of(ids, bounds), decode_array(ids, bounds, known)]
                yield pa.RecordBatch.from_arrays(columns, fields.fieldNames())

    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, fields)


def op3_bpe_speculate_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
