"""SimHash groups, toxicity and the pipeline against brute force and held-out labels."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from wardline.llm import packing, quality, simhash, toxicity
from wardline.llm.shared import staged, table
from wardline.sources import staging


def brute_fingerprint(text, words=3):
    held = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(held[i : i + words]) for i in range(max(1, len(held) - words + 1))] if held else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=3):
    values = np.array([p for _, p in prints], np.uint64)
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= bits):
            parent[find(i)] = find(int(j))
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(prints):
        groups[find(i)].append(doc_id)
    return {i: min((d for d in ids if d is not None), default=None) for g, ids in groups.items() for i in [g]}, [find(i) for i in range(len(prints))]


def test_position_groups_meet_every_three_bytes():
    groups = simhash.position_groups()
    assert len(groups) == 14 and all(len(g) == 4 for g in groups)


def test_simhash_query(spark, sf_dir, texts):
    prints = [(d, brute_fingerprint(t)) for d, t in texts.items()]
    least, root = brute_components(prints)
    want = sorted((d, f"{p:016x}", least[r]) for (d, p), r in zip(prints, root, strict=True))
    assert sorted(map(tuple, simhash.op6_simhash_byte_index(spark, sf_dir).collect())) == want


def test_simhash_edge_rows(edge_docs, edge_rows, no_docs):
    prints = [(r[0], brute_fingerprint(r[1])) for r in edge_rows]
    least, root = brute_components(prints)
    want = sorted((str(d), f"{p:016x}", least[r]) for (d, p), r in zip(prints, root, strict=True))
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(edge_docs).collect())
    assert got == want
    assert simhash.simhash_groups(no_docs).count() == 0


def test_wide_postings_in_blocks(spark):
    """Many prints around one centre, compared in one task and in blocks, give the components of brute force."""
    r = random.Random(4)
    centre, values = r.getrandbits(64), set()
    for _ in range(400):
        flips = r.sample(range(64), r.randint(0, 5))
        values.add(centre ^ sum(1 << b for b in flips))
    values |= {r.getrandbits(64) for _ in range(100)}
    prints = [(k, v) for k, v in enumerate(sorted(values))]
    least, root = brute_components(prints)
    nodes = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for _, v in prints], "fp long")
    for block in (4096, 50):
        labels = simhash.components(nodes, simhash.linked_pairs(nodes, 3, block)).collect()
        by_label = defaultdict(set)
        for row in labels:
            by_label[row["label"]].add(int(np.int64(row["fp"]).astype(np.uint64)))
        want = defaultdict(set)
        for (_, v), g in zip(prints, root, strict=True):
            want[g].add(v)
        assert sorted(map(sorted, by_label.values())) == sorted(map(sorted, want.values()))


def brute_similar(docs, words=5, least=0.8):
    """Component keepers of texts (id, text) by Jaccard similarity of every pair."""
    sets = []
    for _, t in docs:
        held = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(held[i : i + words]) for i in range(max(1, len(held) - words + 1))) if held else frozenset())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            if either == 0 or (min(len(sets[i]), len(sets[j])) >= least * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= least * either):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        groups[find(i)].append(d)
    return groups


def test_near_copies_of_prose(spark):
    """Copies with a few words changed go, one of each group stays, other texts stay."""
    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(3000)]
    docs, k = [], 0
    for _ in range(30):
        base = [r.choice(vocabulary) for _ in range(r.randint(80, 300))]
        docs.append((k, " ".join(base)))
        k += 1
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            for _ in range(r.randint(0, len(base) // 60)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            docs.append((k, " ".join(copy)))
            k += 1
    left = {row["doc_id"] for row in simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert left == {min(g) for g in brute_similar(docs).values()}


def test_drop_near_copies(edge_docs, edge_rows, no_docs):
    left = simhash.drop_near_copies(edge_docs)
    assert left.columns == edge_docs.columns
    rows = sorted({(r[0] is None, r[0] or 0, r[1]) for r in edge_rows}, key=str)
    keepers = {min(g) for g in brute_similar([((none, i, t or ""), t) for none, i, t in rows]).values()}
    want = Counter(str(r[0]) for r in edge_rows if (r[0] is None, r[0] or 0, r[1] or "") in keepers)
    assert Counter(str(r["doc_id"]) for r in left.collect()) == want
    assert simhash.drop_near_copies(no_docs).count() == 0


def test_near_copies_in_one_large_family(spark):
    """Pairs at 0.8 to 0.85 whose texts share three quarters with all others: strangers at 0.6 are in their postings."""
    r = random.Random(17)
    common = [f"c{k}" for k in range(300)]
    docs = []
    for k in range(60):
        own = [f"o{k}x{i}" for i in range(100)]
        copy = list(own)
        for at in (10, 25, 40, 55, 70, 85, 97, 3)[: r.choice((7, 8))]:
            copy[at] = f"n{k}x{at}"
        docs += [(2 * k, " ".join(common + own)), (2 * k + 1, " ".join(common + copy))]
    left = {row["doc_id"] for row in simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert left == {min(g) for g in brute_similar(docs).values()} == {2 * k for k in range(60)}


def test_near_copies_at_the_threshold(spark):
    """200 pairs of similarity 0.8 exactly, 320 of 400 shingles: none is missed. Pairs just below stay apart."""
    r = random.Random(23)
    docs = []
    for k in range(220):
        own = [f"o{k}x{i}" for i in range(364)]
        copy = list(own)
        for at in sorted(r.sample(range(1, 70), 9 if k >= 200 else 8)):
            copy[5 * at] = f"n{k}x{at}"
        docs += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(copy))]
    left = {row["doc_id"] for row in simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert left == {2 * k for k in range(220)} | {2 * k + 1 for k in range(200, 220)}


def test_shingle_sets_equal_definition():
    r = random.Random(3)
    texts = [None, "", "  ", "a", "A b c d", "a b c d e", " x\ty\x0bz \x85 q\xa0"] + [" ".join(r.choice("abCdef") for _ in range(r.randint(0, 40))) for _ in range(200)]
    held = [(t or "").encode().lower().split() for t in texts]
    want = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in held]
    got = list(simhash.shingle_sets(pa.array(texts, pa.string()), 5))
    assert list(map(len, got)) == list(map(len, want))
    for i in range(len(want)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_sketches_bound_what_one_set_has_alone():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 1 << 63, n, np.uint64)) for n in (0, 3, 400, 600, 3000, 20_000)]
    sets += [np.union1d(s[len(s) // 20 :], r.integers(0, 1 << 63, len(s) // 30, np.uint64)) for s in sets]
    sketch = lambda s: simhash.wide_sketch(s) or simhash.parity_sketch(s)
    for x in sets:
        for y in sets:
            alone = len(np.setxor1d(x, y))
            odd = simhash._odd_members(sketch(x), sketch(y))
            assert odd <= alone and (odd - alone) % 2 == 0
            if len(x) > 1000 and 0.8 * len(x) <= len(y) <= len(x) and not len(np.intersect1d(x, y)):
                assert (len(x) + len(y) - odd) / 2 < simhash._least_overlap(len(x) + len(y), 0.8)  # strangers are told apart


def test_busy_shingles_move_back_by_their_count_over_the_table(spark):
    """A shingle rare in each part and first by hash in 400 strangers' texts: their one posting becomes small ones, the
    prefixes are those of the order by count, and the groups are those of all pairs."""
    rng = random.Random(11)
    hashed = lambda text: int(simhash.shingle_hashes(pa.array([text]), 5)[0][0])
    tried = (" ".join(f"p{k}{c}" for c in "abcde") for k in range(100_000))
    phrase = next(t for t in tried if hashed(t) < (1 << 64) // 2000)
    docs = []
    for k in range(400):
        words = [f"w{rng.randrange(10**9)}" for _ in range(30)]
        docs.append((2 * k, " ".join([*words[:15], phrase, *words[15:]])))
        if k % 20 == 0:  # a near copy
            docs.append((2 * k + 1, docs[-1][1] + " end"))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartitionByRange(210, "doc_id")
    commonest = simhash.frequent_shingles(df, "text", 5)
    assert np.uint64(hashed(phrase)) not in commonest
    prints = staged(simhash.described(df, "doc_id", "text", 5, 0.8, commonest), "test-prints")
    nodes = prints.withColumnRenamed("doc_id", "least_id")
    assert simhash.postings(nodes).agg(F.max("n")).first()[0] == 420

    def texts(speakers):
        return df.withColumnRenamed("doc_id", "least_id").join(speakers, "least_id").select("node", F.col("text").alias("body"))

    calm, keys = simhash.calmed(nodes, texts, commonest, 5, 0.8, busy=50)
    assert keys.agg(F.max("n")).first()[0] == 2
    whole = staged(simhash.described(df, "doc_id", "text", 5, 0.8, np.append(commonest, np.uint64(hashed(phrase)))), "test-prints")
    by_node = lambda x: sorted((r["node"], tuple(r["prefix"])) for r in x.select("node", "prefix").collect())
    assert by_node(calm) == by_node(whole) and calm.columns == nodes.columns


def test_any_order_gives_the_same_groups(spark, sf_dir, monkeypatch):
    """Shingles of nearly every posting moved back, in several rounds: groups are as with none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id IS NOT NULL").repartition(4)
    rows = lambda: sorted((r["doc_id"], r["component_id"]) for r in simhash.similar_groups(docs, "doc_id", "text").collect())
    want = rows()
    plain = simhash.calmed
    monkeypatch.setattr(simhash, "calmed", lambda *given: plain(*given, busy=1))
    assert rows() == want


def test_near_copies_among_strangers_that_share_postings(spark):
    """2,000 unrelated texts hold parts of a pair's text, some long: the pair is found, and nothing else goes."""
    r = random.Random(31)
    pair = [f"p{k}" for k in range(300)]
    docs = [(0, " ".join(pair)), (1, " ".join([*pair[:290], *[f"q{k}" for k in range(10)]]))]
    for k in range(2000):
        own = [f"s{k}x{i}" for i in range(5000 if k % 100 == 0 else 60)]
        at = r.randrange(0, 280)
        docs.append((k + 2, " ".join(own + pair[at : at + 20])))
    long_copy = docs[2][1].split(" ")
    long_copy[2500] = "changed"
    docs.append((5000, " ".join(long_copy)))
    left = {row["doc_id"] for row in simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert left == {d for d, _ in docs} - {1, 5000}


# ---- toxicity


def brute_segments(w):
    """Maximal segments by the recursive definition: take the best, then look on either side of it."""
    best, where = 0, None
    for i in range(len(w)):
        total = 0
        for j in range(i, len(w)):
            total += w[j]
            if total > best + 1e-12:
                best, where = total, (i, j)
    if where is None:
        return []
    i, j = where
    left = brute_segments(w[:i])
    right = [(a + j + 1, b + j + 1, s) for a, b, s in brute_segments(w[j + 1 :])]
    return left + [(i, j, best)] + right


def test_segments_equal_definition():
    r = np.random.default_rng(2)
    for _ in range(300):
        w = r.normal(-0.3, 1.0, r.integers(0, 25))
        first, last, score = toxicity.segments(w)
        want = brute_segments(w.tolist())
        assert [(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)] == [(a, b) for a, b, _ in want]
        assert np.allclose(score, [s for _, _, s in want])


@pytest.fixture(scope="module")
def model(spark):
    sf = "/root/testdata/sf0.01"
    return toxicity.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))


def test_model_by_brute_force(spark):
    """Counts, log-odds, the law's rate and constant and the curve from their definitions, over the same labelled rows."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    learned = toxicity.fit(docs, labels)
    toxic = {r["doc_id"]: int(r["toxic"]) for r in labels.collect() if r["toxic"] is not None}
    rows = [(zlib.crc32(str(r["doc_id"]).encode()) % 5, toxic[r["doc_id"]], r["text"] or "") for r in docs.select("doc_id", "text").collect() if r["doc_id"] in toxic]
    counts = np.zeros_like(learned.counts)
    for part, label, text in rows:
        if part in (1, 2, 3):
            for piece in text.split():
                for slot in toxicity.slots_of(piece):
                    counts[slot, label] += 1
    assert (counts == learned.counts).all()
    base = counts[: toxicity.SLOTS, 1].sum() / counts[: toxicity.SLOTS].sum()

    def weight(piece):
        word = piece.lower().strip(toxicity.MARKS)
        if not word:
            return -toxicity.DRIFT
        share = base
        for level, cut in enumerate(toxicity.LEVELS):
            clean, bad = counts[level * toxicity.SLOTS + zlib.crc32(word[:cut].encode()) % toxicity.SLOTS].tolist()
            share = (bad + toxicity.PRIOR * share) / (clean + bad + toxicity.PRIOR)
        return math.log(share / (1 - share)) - math.log(base / (1 - base)) - toxicity.DRIFT

    calibration = [(label, text) for part, label, text in rows if part == 4]
    weights = [np.array([weight(p) for p in text.split()]) for _, text in calibration]
    assert all(np.allclose(a, b) for a, b in zip(weights, learned.weigher().weights([t for _, t in calibration]), strict=True))
    clean = [w for w, (label, _) in zip(weights, calibration, strict=True) if not label]
    steps = np.clip((np.concatenate(clean) + 6.0) / 0.05, 0, 319).astype(int) * 0.05 - 6.0 + 0.025
    assert np.mean(np.exp(learned.rate * steps)) == pytest.approx(1, abs=1e-4)  # lambda: E[exp(lambda s)] = 1
    best = [(len(w), max((s for _, _, s in zip(*toxicity.segments(w), strict=True)), default=0)) for w in clean]
    found = [learned.rate * b - math.log(n) for n, b in best if b > 0]
    assert learned.log_k == pytest.approx(np.median(found) + math.log(math.log(2)))
    x = np.array([learned.evidence(toxicity.segments(w)[2], len(w)) for w in weights])
    y = np.array([label for label, _ in calibration])
    p = 1 / (1 + np.exp(-(learned.offset + learned.slope * x)))
    assert abs(np.sum((y - p) * x) - 1e-3 * learned.slope) < 1e-3 and abs(np.sum(y - p) - 1e-3 * learned.offset) < 1e-3  # the best curve


def test_held_out_accuracy(spark, model):
    sf = "/root/testdata/sf0.01"
    scored = toxicity.score(table(spark, sf, "documents"), model).join(table(spark, sf, "labels"), "doc_id")
    rows = scored.where(toxicity.held_out(F.col("doc_id"))).select("doc_id", "score", "toxic").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    clean = [r["score"] < 0.5 for r in rows if not r["toxic"]]
    assert sum(clean) >= 0.97 * len(clean)
    toxic, safe = ([r["score"] for r in rows if bool(r["toxic"]) == t] for t in (True, False))
    auc = np.mean([(t > s) + 0.5 * (t == s) for t in toxic for s in safe])
    assert auc >= 0.8


def test_toxicity_edge_rows(edge_docs, edge_rows, no_docs, model, spark):
    rows = toxicity.score(edge_docs, model).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in rows)
    by_id = defaultdict(set)
    for r in rows:
        by_id[r["doc_id"]].add(r["score"])
    assert len(by_id[4]) == 1 and by_id[0] == by_id[1] == by_id[2]
    assert toxicity.score(no_docs, model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    untaught = toxicity.fit(edge_docs, labels)
    assert {r["score"] for r in toxicity.score(edge_docs, untaught).collect()} == {0.0}


def test_passages_mark_the_words(spark, model):
    text = " ".join(["the thing of that"] * 30 + ["idiot moron scum"] + ["the thing of that"] * 30)
    row = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [(p["first_word"], p["last_word"]) for p in row["passages"]] == [(120, 122)] and row["score"] > 0.5


# ---- the pipeline


def test_pipeline_stages(spark, sf_dir, documents, texts):
    kept = {}
    docs = documents
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = staged(stage(spark, docs, sf_dir), f"test-{k}")
        if k < 4:
            assert docs.columns == documents.columns, name
            kept[k] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if k == 0:
            model = toxicity.fit(before, table(spark, sf_dir, "labels"))
            want = {r["doc_id"] for r in toxicity.score(before, model).where("score < 0.5").collect()}
        elif k == 1:
            want = {r["doc_id"] for r in quality.quality_cascade(before).where("failed_rule IS NULL").collect()}
        elif k == 2:
            last = {}
            for d in sorted(kept[1]):
                last[texts[d]] = d
            want = set(last.values())
        elif k == 3:
            want = {min(g) for g in brute_similar([(d, texts[d]) for d in sorted(kept[2])]).values()}
        if k < 4:
            assert kept[k] == want, name
    rows = docs.collect()
    assert {r["doc_id"] for r in rows} == kept[3]
    assert all(v <= packing.CAPACITY for v in Counter({r["sequence_id"]: 0 for r in rows}).values())
    total = defaultdict(int)
    for r in rows:
        total[r["sequence_id"]] += r["length"]
    assert max(total.values()) <= packing.CAPACITY


def test_pipeline_of_edge_rows(spark, sf_dir, edge_docs, edge_rows, no_docs):
    """Edge rows go as low quality. Of a clean text's copies, one of them without an id and one repeated, the largest id
    stays, and of its near copies the least."""
    texts = [t for (t,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id = 9").select("text").collect()]
    rest = edge_rows[6][2:]
    more = [(k, texts[0], *rest) for k in (6000, 50, None, 50)] + [(70, texts[0].replace(" ", " another ", 1), *rest)]
    docs = edge_docs.unionByName(spark.createDataFrame(more, edge_docs.schema))
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"edge-{k}")
        assert k == 4 or docs.columns == columns
        kept.append(sorted(((r["doc_id"] is not None, r["doc_id"]) for r in docs.select("doc_id").collect()), key=str))
    everything = sorted(((r[0] is not None, r[0]) for r in [*edge_rows, *more]), key=str)
    assert kept[0] == everything
    assert kept[1] == sorted([(True, 6000), (True, 50), (False, None), (True, 50), (True, 70)], key=str)
    assert kept[2] == [(True, 6000), (True, 70)] and kept[3] == [(True, 70)]
    pieces = sorted((r["piece"], r["start"], r["length"], r["doc_id"]) for r in docs.collect())
    assert {p[3] for p in pieces} == {70} and all(a[1] + a[2] == b[1] for a, b in zip(pieces, pieces[1:]))
    docs = no_docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"none-{k}")
        assert k == 4 or docs.columns == columns
    assert docs.collect() == []


def test_pipeline_leaves_only_its_result(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "scratch_dir", lambda s: f"file:{tmp_path}")
    rows = corpus_pipeline.run(spark, sf_dir)
    assert [p.name.rpartition("-")[0] for p in tmp_path.iterdir()] == ["pipeline-4"] and rows.count() > 0
