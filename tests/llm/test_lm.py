"""Scores of the backoff automaton against the recursion over plain counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardline.llm import lm


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class Plain:
    def __init__(self, rows, order, prior):
        self.order, self.prior, self.counts = order, prior, Counter()
        for doc_id, text in rows:
            if not held_out(doc_id):
                held = words(text)
                self.counts.update(tuple(held[k : k + n]) for n in range(1, order + 1) for k in range(len(held) - n + 1))
        single = {g: c for g, c in self.counts.items() if len(g) == 1}
        self.n, self.v = sum(single.values()), len(single)

    def chance(self, context, word):
        if not context:
            return (self.counts[word,] + 1) / (self.n + self.v + 1)
        return (self.counts[*context, word] + self.prior * self.chance(context[1:], word)) / (self.counts[context] + self.prior)

    def row(self, doc_id, text):
        held = words(text)
        score = sum(math.log10(self.chance(tuple(held[max(0, k - self.order + 1) : k]), w)) for k, w in enumerate(held))
        base = sum(math.log10((self.counts[w,] + 1) / (self.n + self.v + 1)) for w in held)
        return (doc_id, held_out(doc_id), len(held), sum(self.counts[w,] > 0 for w in held), self.n, base, score)


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:5], round(r[5], 6), round(r[6], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_lm_query(spark, sf_dir, texts):
    plain = Plain(texts.items(), lm.ORDER, lm.PRIOR)
    same(lm.op13_backoff_scores(spark, sf_dir).collect(), [plain.row(*r) for r in texts.items()])


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_of_many_blocks(spark, documents, texts, order, monkeypatch):
    """Counts come together from many blocks and shards; a text longer than a block is one."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 60_000)
    train = ~(F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    plain = Plain(texts.items(), order, 5.0)
    same(lm.scored(documents, train, order, 5.0).collect(), [plain.row(*r) for r in texts.items()])


def test_lm_edge_rows(spark, tmp_path, edge_docs, edge_rows, no_docs):
    docs = edge_docs.withColumns({c: F.lit(7) for c in ("train", "block", "n", "size", "totals", "base_score")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plain = Plain([r[:2] for r in edge_rows], lm.ORDER, lm.PRIOR)
    same(lm.op13_backoff_scores(spark, str(tmp_path)).collect(), [plain.row(*r[:2]) for r in edge_rows])
    assert lm.scored(no_docs, F.lit(True)).collect() == []


def test_no_training_text(spark, edge_docs):
    rows = lm.scored(edge_docs, F.lit(False)).collect()
    assert rows and all(r["score"] == r["base_score"] == 0.0 and r["n_known"] == 0 for r in rows)


def test_states_spend_all_their_weight():
    """Over all words and one that was never seen, the arcs of every state sum to 1."""
    rows = [(k, t) for k, t in enumerate(["a b a c a b", "b a b", "c c a b a", ""]) if not held_out(k)]
    plain = Plain(rows, 2, 3.0)
    vocabulary = [w for (w,) in [g for g in plain.counts if len(g) == 1]]
    for context in [(), ("a",), ("b",), ("c",)]:
        assert math.isclose(sum(plain.chance(context, w) for w in [*vocabulary, "new"]), 1)


def test_packed_integers():
    values = np.array([0, 1, 2**63, 2**64 - 1, 77], np.uint64)
    assert (lm._unpacked(lm._packed(values), 5) == values).all()


def test_tokens_of_odd_spaces():
    hashes, starts = lm.tokens(pa.chunked_array([["", " \x0b a\tÄ\x0cA \x85 x ", "A"]]))
    assert np.diff(starts).tolist() == [1, 5, 2]
    assert hashes[1] == hashes[3] == hashes[6] and len(set(hashes.tolist())) == 4


def test_held_out_texts_are_better_told_than_by_words_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = lm.scored(docs, ~held).where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.95 * sum(r["base_score"] for r in rows)
