"""Token ids of whole texts by the tokenizers library, with a memo of white-space pieces inside each worker."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wardline.llm.shared import kept

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task a core

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
#: Pieces in each of the two generations of a worker's memo, about 250 bytes each: more of them cost memory and spare time.
MEMO = 450_000


def resolve(tokenizer: str) -> str:
    """A path as it is, else the installed vocabulary file of that name. Called where the task runs."""
    if os.path.exists(tokenizer):
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def load(tokenizer: str):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(resolve(tokenizer))
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@lru_cache(maxsize=10_000)
def _is_word_end(char: str) -> bool:
    """Whether the character is a letter or digit and still ends in one once it is composed and in lower case."""
    return char.isalnum() and unicodedata.normalize("NFC", char).lower()[-1].isalnum()


UNKNOWN = object()


class Generations:
    """A bounded memo: when the young half is full it becomes the old one, and what is used again is carried over."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def values(self, used: list, learn: Callable[[list], None]) -> list:
        """What is known of the keys; ``learn`` is called with those that nothing is known of and puts them in ``young``."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, used, repeat(UNKNOWN)))
        absent = [k for k, x in enumerate(found) if x is UNKNOWN]
        if absent:
            learn(self.missing([used[k] for k in absent], turn=False))
            young = self.young
            for k in absent:
                found[k] = young[used[k]]
        return found

    def missing(self, used: list, turn: bool = True) -> list:
        """Keys that nothing is known of; what is known of the others is in ``young`` afterwards.

        Only a call with ``turn`` may begin a new generation, and takes what was found before out of ``young``.
        """
        if turn and len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        absent = [k for k in used if k not in young]
        young.update({k: old[k] for k in absent if k in old})
        return [k for k in absent if k not in young]


def parts_of(texts: pa.Array, limit: int = 1 << 22) -> Iterator[pa.Array]:
    """The texts in slices of about ``limit`` bytes, so that a batch of long ones is not expanded at once."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // limit)) + 1
    for start, end in pairwise([0, *cuts.tolist(), len(texts)]):
        yield texts.slice(start, end - start)


def laid_out(bodies: list[bytes | None], lists: pa.ListArray, at: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts that are given as lists of places ``at`` in ``bodies``, one after another, and the bounds of each text."""
    taken = pa.array(bodies, pa.large_binary()).take(at)
    _, places, data = taken.buffers()
    ends = np.frombuffer(places, "<i8", len(taken) + 1, 8 * taken.offset)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    ids = np.frombuffer(data, "<u4", int(ends[-1] - ends[0]) // 4, int(ends[0])) if data is not None and ends[-1] > ends[0] else np.empty(0, np.uint32)
    return ids, (ends[offsets - offsets[0]] - ends[0]) // 4


class PieceEncoder:
    """``encode_array`` gives the ids of many texts as one array of unsigned 32-bit integers and the bounds of each text.

    Where a tokenizer drops white space, the pieces between blanks and line feeds are encoded one by one and
    each piece's ids are kept, so common words are looked up instead of merged again, in lower case if the
    tokenizer doesn't tell case apart; new pieces go to the library many at a time, with a separator of one token
    between them. Any other tokenizer gets whole texts.
    The memo holds two times ``limit`` pieces at most.
    """

    #: Marks that join with a letter before them to one character: case must not be folded before they do.
    COMBINING = "[\u0300-\u036f]"
    SEPARATOR = "|"
    TAIL = ".,;:!?#$%&"
    JOINED = 400

    def __init__(self, tokenizer: str, limit: int = MEMO):
        self.tokenizer = load(tokenizer)
        self.memo = Generations(limit)
        self.by_piece = self._drops_white_space()
        self.mark = self._separator_id() if self.by_piece else None
        self.tails = self.by_piece and all(
            self._ids(a + b + c) == self._ids(a) + self._ids(b + c) for a in ("an", "é", "5") for b in self.TAIL for c in ("", *self.TAIL)
        )

        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        self.folds_case = self.by_piece and all(self._ids(f"a{x}e") == self._ids(f"a{x}e".lower()) for x in letters)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _drops_white_space(self) -> bool:
        ids = self._ids
        return not ids(" \n ") and all(
            ids(a + gap + b) == ids(a) + ids(b) for a, b in (("an", "ox"), ("it's", ".5"), ("é", "a")) for gap in (" ", "\n", "  ")
        )

    def _separator_id(self) -> int | None:
        ids, mark = self._ids, self._ids(self.SEPARATOR)
        joins = all(ids(f"{a} {self.SEPARATOR} {b}") == ids(a) + mark + ids(b) for a, b in (("an", "ox"), ("it's", ".5"), ("-", "-")))
        return mark[0] if len(mark) == 1 and joins else None

    def _each(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _joined(self, new: list[str]) -> list[bytes]:
        """Ids of pieces without the separator, by one call for ``JOINED`` of them."""
        between = f" {self.SEPARATOR} "
        texts = [between.join(new[k : k + self.JOINED]) for k in range(0, len(new), self.JOINED)]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.array([i for x in found for i in (*x.ids, self.mark)], "<u4")
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) != len(new):
            return self._each(new)
        raw, stops = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *(e + 4 for e in stops[:-1])], stops, strict=True)]

    def _learn(self, new: list[str]) -> None:
        """A piece that ends in marks after a letter or digit is its core and the marks, which are looked up apart."""
        young, cores = self.memo.young, {}
        if self.tails:
            for p in new:
                core = p.rstrip(self.TAIL)
                if core and len(core) < len(p) and _is_word_end(core[-1]):
                    cores[p] = core
        parts = {*cores.values(), *(p[len(core) :] for p, core in cores.items())}
        wanted = [p for p in new if p not in cores]
        wanted += self.memo.missing(list(parts.difference(wanted)), turn=False)
        plain = [p for p in wanted if self.SEPARATOR not in p] if self.mark is not None else []
        others = wanted if self.mark is None else [p for p in wanted if self.SEPARATOR in p]
        for pieces, encode in ((plain, self._joined), (others, self._each)):
            for k in range(0, len(pieces), 20_000):
                some = pieces[k : k + 20_000]
                young.update(zip(some, encode(some), strict=True))
        young.update({p: young[core] + young[p[len(core) :]] for p, core in cores.items()})

    def _part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the number of ids of each text."""
        if not self.by_piece:
            bodies = self._each(texts.to_pylist())
            return np.frombuffer(b"".join(bodies), "<u4"), np.array([len(b) // 4 for b in bodies], np.int64)
        if self.folds_case:
            texts = pc.if_else(pc.match_substring_regex(texts, self.COMBINING), texts, pc.ascii_lower(texts))
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        bodies = self.memo.values(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self._learn)
        ids, bounds = laid_out(bodies, lists, coded.indices)
        return ids, np.diff(bounds)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, bounds = self.encode_array(pa.array(texts, pa.string()))
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in pairwise(bounds.tolist())]

    def encode_array(self, texts: pa.Array, end_id: int | None = None, part_bytes: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and bounds: text k has ids[bounds[k] : bounds[k + 1]].

        Null counts as empty. ``end_id`` follows every text if it is given. So many bytes of text are expanded at once.
        """
        texts = pc.fill_null(texts, "")
        ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for part in parts_of(texts, part_bytes):
            found, n = self._part(part)
            if end_id is not None:
                found, n = np.insert(found, np.cumsum(n), end_id), n + 1
            ids.append(found.astype(np.uint32, copy=False))
            sizes.append(n)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def encoder(tokenizer: str, limit: int = MEMO) -> PieceEncoder:
    """One for each worker process, so that its memo lasts from task to task of the same work."""
    return kept(("pieces", tokenizer, limit), lambda: PieceEncoder(tokenizer, limit))
