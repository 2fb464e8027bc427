"""The Merkle manifest against trees built in one piece."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import manifest


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        first = i - i % 3
        yield level[first:i], level[i + 1 : first + 3]
        i //= 3


def brute(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))):
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r, r["text"]) for r in groups[s]]) for s in order}
    crown = tree([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            steps = [*path(trees[s], i), *path(crown, at)]
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for before, after in steps:
                folded = digest([*before, folded, *after])
            proof = digest(d for before, after in steps for d in before + after)
            out.append((r["doc_id"], trees[s][0][i], trees[s][-1][0], crown[-1][0], proof, folded, folded == crown[-1][0]))
    return ordered(out)


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("levels", range(1, 8))
def test_every_node_has_one_place_and_subtrees_lie_together(levels):
    places = [manifest.address(d, np.arange(3**d), levels) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(manifest.nodes_of(levels)))
    upper = levels // 2
    if upper:
        assert max(p.max() for p in places[:upper]) == manifest.nodes_of(upper) - 1
        size = manifest.nodes_of(levels - upper)
        for k in range(3**upper):
            inside = [places[d][k * 3 ** (d - upper) : (k + 1) * 3 ** (d - upper)] for d in range(upper, levels)]
            together = np.sort(np.concatenate(inside))
            assert (np.diff(together) == 1).all() and len(together) == size


@pytest.mark.parametrize("count", [1, 2, 3, 4, 9, 10, 28, 81, 100])
def test_block_and_its_paths(count):
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(count)]
    block = manifest.Block.build(leaves, manifest.levels_for(count))
    want = tree([d.hex() for d in leaves])
    assert block.node(0, 0).hex() == want[-1][0]
    for k, d in enumerate(leaves):
        ended, siblings = manifest.fold(d, block.path(k))
        assert ended == block.node(0, 0)
        assert [s.hex() for s in siblings] == [s for a, b in path(want, k) for s in a + b]


def test_manifest_query(spark, sf_dir, documents):
    assert ordered(manifest.op11_merkle_manifest(spark, sf_dir).collect()) == brute([r.asDict() for r in documents.collect()])


def test_blocks_of_blocks(spark, tmp_path):
    """A source of 2,000 rows, more than two full blocks, one with a single row, and 800 sources of one row each."""
    rows = spark.range(2900).selectExpr("id as doc_id", "concat('text\n', id) as text", "'en' as lang", "case when id < 2000 then 'a' when id < 2100 then null else concat('b', id) end as source", "id % 50 as n_chars")
    rows.repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    assert ordered(manifest.op11_merkle_manifest(spark, str(tmp_path)).collect()) == brute([r.asDict() for r in rows.collect()])


def test_manifest_edge_rows(spark, tmp_path, edge_docs, no_docs):
    docs = edge_docs.withColumns({c: F.lit(7) for c in ("rank", "key", "whole", "digest", "leaf", "place", "part", "start", "claimed", "tree")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert ordered(manifest.op11_merkle_manifest(spark, str(tmp_path)).collect()) == brute([r.asDict() for r in docs.collect()])
    assert manifest.documents_manifest(no_docs).collect() == []
