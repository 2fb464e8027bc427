"""Packing, speculative BPE, token files and edit-aware counts against the library and brute force."""

import hashlib
import math
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import bpe, edits, packing, pieces, rans
from wardline.llm.shared import staged


@pytest.fixture(scope="module")
def word_bpe():
    return pieces.load(pieces.WORD_BPE)


@pytest.fixture(scope="module")
def byte_bpe():
    return pieces.load(pieces.BYTE_BPE)


def library_ids(tokenizer, texts):
    return [x.ids for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


ALPHABET = [*" \n\t\r\x0b\x0c\x1c\x85\xa0 　abcdefthein'sTHr0123,.!?-éüßΣσς中😀́\0", "<|endoftext|>", "'re", "  ", "\n\n", "thing", "aaaa"]


def odd_texts(n, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["a" * k for k in range(40)]


def test_piece_memo_equals_library(word_bpe, byte_bpe):
    texts = odd_texts(3000)
    for name, library in ((pieces.WORD_BPE, word_bpe), (pieces.BYTE_BPE, byte_bpe)):
        coder = pieces.PieceEncoder(name, limit=500)
        assert coder.by_piece == (name == pieces.WORD_BPE)
        found = [b for k in range(0, len(texts), 100) for b in coder.encode(texts[k : k + 100])]
        assert found == [struct.pack(f"<{len(i)}I", *i) for i in library_ids(library, texts)]


def test_pieces_with_marks_and_separators(word_bpe):
    r = random.Random(8)
    parts = ["|", "||", "a|b", "word", "Word", "WORD", "J\u030c", "j\u030c", "H\u0331", "\u0130", "\u0958", "\u03a3\u03a3", "K\u0327x", "é", "é", "5", "²", "一", "—", "ß", ".", ",", "...", "!?", "$$$", "'s", "#1", "&&&", "x" * 300]
    texts = ["".join(r.choice(parts) + r.choice(["", "", " "]) for _ in range(r.randint(0, 30))) for _ in range(2000)]
    coder = pieces.PieceEncoder(pieces.WORD_BPE, limit=300)
    assert coder.mark is not None and coder.tails
    found = [b for k in range(0, len(texts), 90) for b in coder.encode(texts[k : k + 90])]
    assert found == [struct.pack(f"<{len(i)}I", *i) for i in library_ids(word_bpe, texts)]


# ---- packing


def check_plan(counts, capacity):
    planned = packing.plan(counts, capacity)
    held = defaultdict(int)
    for lengths, many in planned:
        assert sum(lengths) <= capacity and many > 0
        for n in lengths:
            held[n] += many
    assert dict(held) == counts
    return sum(many for _, many in planned)


def test_plan_places_everything_near_the_bound():
    r = random.Random(2)
    for size in (0, 1, 7, 400, 20_000):
        counts = defaultdict(int)
        for _ in range(size):
            counts[min(2048, max(1, int(r.lognormvariate(6, 1))))] += 1
        used = check_plan(dict(counts), 2048)
        bound = math.ceil(sum(n * c for n, c in counts.items()) / 2048)
        assert bound <= used <= max(bound * 1.01 + 1, bound)


def test_plan_fills_gaps_exactly():
    assert check_plan({6: 2, 4: 2}, 10) == 2
    assert check_plan({7: 1, 2: 1, 1: 1}, 10) == 1
    assert check_plan({4: 1, 3: 1, 2: 1, 1: 1}, 10) == 1
    assert check_plan({5: 5}, 10) == 3
    assert check_plan({10: 3, 1: 25}, 10) == 6


def check_packed(rows, wanted, capacity=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in by_sequence.values():
        places.sort()
        assert [p[0] for p in places] == list(np.cumsum([0] + [p[1] for p in places])[:-1])
        assert sum(p[1] for p in places) <= capacity
    expected = defaultdict(list)
    for doc_id, ids in wanted:
        raw = struct.pack(f"<{len(ids)}I", *ids)
        for p, at in enumerate(range(0, len(ids), capacity)):
            body = raw[4 * at : 4 * (at + capacity)]
            expected[doc_id].append((p, at, len(body) // 4, zlib.crc32(body)))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in expected.items()}
    return len(by_sequence), math.ceil(sum(len(i) for _, i in wanted) / capacity)


def test_packing_query(spark, sf_dir, texts, word_bpe):
    rows = packing.op2_best_fit_packing(spark, sf_dir).collect()
    wanted = [(d, ids + [0]) for d, ids in zip(texts, library_ids(word_bpe, texts.values()), strict=True)]
    used, bound = check_packed(rows, wanted)
    assert used <= bound + 1


def test_packing_edge_rows(edge_docs, edge_rows, no_docs, word_bpe):
    wanted = [(r[0], i + [0]) for r, i in zip(edge_rows, library_ids(word_bpe, [r[1] for r in edge_rows]), strict=True)]
    rows = packing.pack(edge_docs, capacity=64).collect()
    check_packed(rows, wanted, 64)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)
    assert packing.pack(no_docs).count() == 0


# ---- speculative BPE


def test_speculation_equals_library(byte_bpe):
    coder = bpe.SpeculativeEncoder(pieces.BYTE_BPE, limit=800)
    r = random.Random(1)
    texts = odd_texts(3000, 9) + ["".join(r.choice("abehtinrs") for _ in range(r.randint(1, 40))) for _ in range(3000)]
    found = [b for k in range(0, len(texts), 100) for b in coder.encode(texts[k : k + 100])]
    assert found == [struct.pack(f"<{len(i)}I", *i) for i in library_ids(byte_bpe, texts)]


def test_words_of_any_length(byte_bpe):
    """Words of thousands of letters, one letter over and over, and texts of nothing but such words."""
    r = random.Random(14)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEF") for _ in range(n)) for n in (1, 95, 97, 3000, 20_000)]
    texts += ["a" * 5000, "ab" * 4000, " ".join("e" * k for k in range(1, 200)), "é" * 3000]
    coder = bpe.SpeculativeEncoder(pieces.BYTE_BPE)
    assert coder.encode(texts) == [struct.pack(f"<{len(i)}I", *i) for i in library_ids(byte_bpe, texts)]


def test_pair_check_equals_merging():
    v = bpe.Vocabulary(pieces.BYTE_BPE)
    r = np.random.default_rng(3)
    whole = [t for t in r.integers(0, 50_000, 400) if v.is_whole(int(t), v.text_of[int(t)])]
    left, right = r.choice(whole, 3000), r.choice(whole, 3000)
    short = r.integers(0, 256, 3000)
    for a, b in ((left, right), (left, short), (short, short[::-1])):
        want = [v.merge(v.text_of[int(x)] + v.text_of[int(y)]) == [x, y] for x, y in zip(a, b, strict=True)]
        assert v.compatible(np.array(a), np.array(b)).tolist() == want


def check_bpe(rows, wanted, byte_bpe):
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows)
    expected = []
    for (doc_id, _), ids in zip(wanted, library_ids(byte_bpe, [t for _, t in wanted]), strict=True):
        decoded = byte_bpe.decode(ids, skip_special_tokens=False)
        expected.append((str(doc_id), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(expected)


def test_bpe_query(spark, sf_dir, texts, byte_bpe):
    check_bpe(bpe.op3_bpe_speculate_verify(spark, sf_dir).collect(), list(texts.items()), byte_bpe)


def test_bpe_edge_rows(edge_docs, edge_rows, no_docs, byte_bpe):
    rows = bpe.bpe_decode(bpe.bpe_encode(edge_docs)).select(
        "doc_id", (F.octet_length("ids") / 4).cast("int").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )
    check_bpe(rows.collect(), [r[:2] for r in edge_rows], byte_bpe)
    assert bpe.bpe_encode(no_docs).count() == 0


def test_decode_of_broken_utf8(spark, byte_bpe):
    df = spark.createDataFrame([(1, bytearray(struct.pack("<2I", 187, 222))), (2, None)], "doc_id long, ids binary")
    got = {r["doc_id"]: r["decoded"] for r in bpe.bpe_decode(df).collect()}
    assert got == {1: byte_bpe.decode([187, 222]), 2: ""}


# ---- token files


@pytest.mark.parametrize("n", [0, 1, 3, 1023, 1024, 1025, 5000, 40_000])
def test_block_round_trip_and_checkpoints(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n), 49_000).astype(np.uint32)
    model = rans.Model.of_counts(np.bincount(ids, minlength=1))
    assert not n or int(model.frequencies.sum()) == 1 << model.scale_bits
    payload = rans.encode_block(ids, model, lanes=64, every=16)
    assert (rans.decode_block(payload, model) == ids).all()
    marks = struct.unpack_from("<5I", payload, 4)[3]
    parts = [rans.decode_block(payload, model, k, k + 1) for k in range(marks)]
    assert not n or (np.concatenate(parts) == ids).all()


def test_damage_is_noticed():
    ids = np.arange(500, dtype=np.uint32) % 7
    model = rans.Model.of_counts(np.bincount(ids))
    payload = bytearray(rans.encode_block(ids, model))
    payload[60] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.decode_block(bytes(payload), model)


def check_token_rows(rows, wanted, start=True):
    at, expected = 0, []
    for doc_id, ids in wanted:
        expected.append((doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=lambda r: r[1]) == expected


def test_token_files_query(spark, sf_dir, texts, word_bpe):
    ordered = sorted(texts)
    wanted = [(d, i + [1]) for d, i in zip(ordered, library_ids(word_bpe, [texts[d] for d in ordered]), strict=True)]
    check_token_rows(rans.op7_rans_token_files(spark, sf_dir).collect(), wanted)


def test_token_files_edge_rows(spark, edge_docs, edge_rows, no_docs, tmp_path, word_bpe):
    rans.write_token_files(edge_docs, str(tmp_path / "a"), block_ids=50)
    rows = rans.read_token_files(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r["start"] for r in rows] == list(np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1])
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(-1 if r[0] is None else r[0] for r in edge_rows)
    got = sorted((str(r["doc_id"]), bytes(r["ids"])) for r in rows)
    assert got == sorted((str(r[0]), struct.pack(f"<{len(i) + 1}I", *i, 1)) for r, i in zip(edge_rows, library_ids(word_bpe, [r[1] for r in edge_rows]), strict=True))
    rans.write_token_files(no_docs, str(tmp_path / "b"))
    assert rans.read_token_files(spark, str(tmp_path / "b")).count() == 0


# ---- edits


def test_edits_equal_full_encoding():
    counter = edits.LeafCounter(pieces.BYTE_BPE, limit=2000)
    full = lambda t: len(counter.library.encode(t, add_special_tokens=False).ids)
    r = random.Random(3)
    letters = [*" \n\t\xa0abcdeTh.,'s01é中", "  ", "\n\n", "the ", " re", "ing", " <|endoftext|>"]
    for _ in range(1500):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 80)))
        tree = edits.CountTree.of(text, counter)
        assert tree.total == full(text) and tree.text() == text
        cuts = sorted(r.sample(range(len(text) + 1), min(len(text) + 1, 2 * r.randint(1, 3))))
        changes = [(a, b, "".join(r.choice(letters) for _ in range(r.randint(0, 4)))) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
        tree.apply(changes)
        for a, b, new in sorted(changes, reverse=True):
            text = text[:a] + new + text[b:]
        assert tree.text() == text and tree.total == full(text)


def test_edit_touches_few_leaves():
    counter = edits.LeafCounter(pieces.BYTE_BPE)
    text = " ".join(f"word{k}" for k in range(5000))
    tree = edits.CountTree.of(text, counter)
    tree.apply([(20_000, 20_003, "xy")])
    assert 0 < tree.encoded < 10
    with pytest.raises(ValueError, match="outside"):
        tree.replace(0, len(text) + 5, "")


def test_edit_query(spark, sf_dir, texts):
    counter = edits.LeafCounter(pieces.BYTE_BPE)
    full = lambda t: len(counter.library.encode(t, add_special_tokens=False).ids)
    for r in edits.op10_edit_aware_counts(spark, sf_dir).collect():
        text = after = texts[r["doc_id"]]
        found = edits.redactions(text)
        for a, b, new in reversed(found):
            after = after[:a] + new + after[b:]
        assert (r["n_tokens"], r["n_edits"], r["edited_tokens"]) == (full(text), len(found), full(after))


def test_edit_edge_rows(edge_docs, edge_rows, no_docs):
    rows = edits.edited_counts(edge_docs, edits=lambda t: [(0, len(t), "new")]).collect()
    assert len(rows) == len(edge_rows) and all(r["edited"] == "new" and r["edited_tokens"] == 1 for r in rows)
    assert edits.edited_counts(no_docs).count() == 0


def test_second_edits_read_stored_trees(spark):
    """Two rounds: the second counts only leaves at its own edits, and the table of trees stays true throughout."""
    r = random.Random(12)
    texts = {k: " ".join(r.choice(["alpha", "beta", "gamma", "x1"]) for _ in range(400)) for k in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    trees = staged(edits.build_trees(docs), "test-trees")
    counter = edits.LeafCounter(pieces.BYTE_BPE)
    full = lambda t: len(counter.library.encode(t, add_special_tokens=False).ids)
    for touched in (range(0, 10), range(5, 8)):
        table_ = edits._keyed(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text")
        rows = [(k, [(50, 55, "new words"), (300, 300, "!")]) for k in touched]
        wanted = table_.join(spark.createDataFrame(rows, f"__id long, edits {edits.EDITS}"), "__id").select("__id", "__text_hash", "__text", "edits")
        changed = staged(edits.apply_edits(staged(wanted, "test-wanted"), trees), "test-changed")
        got = {row["__id"]: row for row in changed.collect()}
        assert sorted(got) == list(touched) and all(0 < row["encoded_leaves"] < 16 for row in got.values())
        for k in touched:
            t = texts[k]
            texts[k] = t[:50] + "new words" + t[55:300] + "!" + t[300:]
            assert got[k]["edited"] == texts[k] and got[k]["n_tokens"] == full(texts[k])
        trees = staged(edits.renewed_trees(trees, changed), "test-trees")
        assert {row["__id"]: (row["n_tokens"], sum(row["leaf_tokens"]), sum(row["leaf_chars"])) for row in trees.collect()} == {k: (full(t), full(t), len(t)) for k, t in texts.items()}
