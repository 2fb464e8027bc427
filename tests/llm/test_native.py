"""Sharding, license scan, exact dedup and quality rules against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from wardline.llm import dedup, licenses, quality, registry, shards
from wardline.llm.shared import staged


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


def test_scan_equals_sql_on_wrapped_notices(spark, tmp_path):
    """Every template whole, wrapped at several widths, behind comment marks, with too many words left out, and twice."""
    texts = []
    for k, (_, notice) in enumerate(licenses.TEMPLATES):
        for width in (30, 72, 400):
            lines, line = [], ""
            for word in notice.split(" "):
                line = f"{line} {word}".strip()
                if len(line) > width:
                    lines, line = [*lines, line], ""
            lines.append(line)
            texts.append("\n".join(["before it", *[f"{('', '# ', ' * ')[k % 3]}{x}" for x in lines], "", "after it " * 3]))
            texts.append("\n".join(["x y", *lines[:-1]]))
            texts.append("\n\n".join([*lines, *lines]))
    texts += [None, "", "\n", "under the\nMIT license"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = registry.QUERIES["op4_license_scan"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.sql(registry.ORACLE_SQL["op4_license_scan"])
    assert canonical(df.collect(), df.columns) == canonical(expected.fetchall(), expected.columns)
    found = {r["doc_id"]: r["labels"] for r in df.collect()}
    assert all(licenses.TEMPLATES[k // 9][0] in found[k].split(",") for k in range(0, 9 * len(licenses.TEMPLATES), 3))


@pytest.mark.parametrize("name", ["op4_license_scan", "op5_exact_dedup", "op8_quality_cascade"])
def test_query_equals_sql(name, spark, sf_dir):
    df = registry.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = con.sql(registry.ORACLE_SQL[name])
    assert canonical(df.collect(), df.columns) == canonical(expected.fetchall(), expected.columns)


# ---- sharding


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 4), (3, 4), (3, 2), (4, 3)])
def test_curve_visits_each_cell_once_in_unit_steps(dims, bits):
    cells = {shards.hilbert_index(p, bits): p for p in product(range(1 << bits), repeat=dims)}
    assert sorted(cells) == list(range(1 << bits * dims))
    walk = [cells[k] for k in range(len(cells))]
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(walk, walk[1:], strict=False))


def test_curve_column_equals_function(spark):
    df = spark.range(64).select(*[F.shiftright("id", 2 * k).bitwiseAND(F.lit(3)).cast("int").alias(f"a{k}") for k in range(3)])
    rows = df.withColumn("i", shards.curve_index([F.col(f"a{k}") for k in range(3)], 2)).collect()
    assert all(r["i"] == shards.hilbert_index((r["a0"], r["a1"], r["a2"]), 2) for r in rows)


def test_shards_query(spark, sf_dir, texts):
    rows = shards.op1_hilbert_shards(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(list(texts))
    slots = defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(40)]
    assert set(slots) <= set(range(40)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    ordered = [r["curve_index"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert ordered == sorted(ordered)


def test_shards_edge_rows(edge_docs, edge_rows, no_docs, tmp_path, spark):
    placed = shards.hilbert_shards(edge_docs, ["source", "lang", "n_chars"], 4)
    assert placed.columns == [c for c in edge_docs.columns if c != "shard"] + ["curve_index", "shard", "slot"]
    counts = Counter(r["shard"] for r in placed.collect())
    assert sum(counts.values()) == len(edge_rows) and max(counts.values()) - min(counts.values()) <= 1
    assert shards.hilbert_shards(no_docs, ["source", "n_chars"], 4).count() == 0
    shards.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(edge_rows)


def test_curve_index_of_rows_by_brute_force(spark, sf_dir, documents):
    """Quantile cuts and cells computed anew in Python from the codes of the docstrings."""
    rows = documents.select("doc_id", "source", "lang", (F.octet_length("text") + 16).alias("size")).collect()

    def string_code(values):
        raw = [(v or "").encode() for v in values]
        low, high = min(raw), max(raw)
        k = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
        return [int.from_bytes((r[k : k + 2] + b"\0\0")[:2], "big") for r in raw]

    axes = [string_code([r["source"] for r in rows]), string_code([r["lang"] for r in rows]), [16_000 + int(math.log2(r["size"] + 1) * 16) for r in rows]]
    points = []
    for codes in axes:
        ordered = sorted(codes)
        cuts = sorted({ordered[min(int(len(codes) * k / 16), len(codes) - 1)] for k in range(1, 16)})
        points.append([sum(c <= code for c in cuts) for code in codes])
    want = {r["doc_id"]: shards.hilbert_index(p, 4) for r, p in zip(rows, zip(*points, strict=True), strict=True)}
    assert {r["doc_id"]: r["curve_index"] for r in shards.op1_hilbert_shards(spark, sf_dir).collect()} == want


def test_shards_prune_on_each_dimension(spark, documents):
    """A shard spans few sources, few languages and a part of the sizes: a filter on any leaves most files out."""
    placed = shards.hilbert_shards(documents.select("doc_id", "source", "lang", "n_chars"), ["source", "lang", "n_chars"], 20)
    spans = placed.groupBy("shard").agg(F.countDistinct("source").alias("s"), F.countDistinct("lang").alias("l")).agg(F.avg("s"), F.avg("l")).first()
    all_ = documents.agg(F.countDistinct("source"), F.countDistinct("lang")).first()
    assert spans[0] < 0.6 * all_[0] and spans[1] < 0.8 * all_[1]


def test_shards_of_clashing_names(spark):
    rows = [(k % 5 or None, "a" * (k % 7), k, 1, 2, "x", 3.0) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, n long, cell_start int, salt_start int, Shard string, __rank double")
    placed = shards.hilbert_shards(docs, ["source", "n"], 6)
    assert placed.columns == ["doc_id", "source", "n", "cell_start", "salt_start", "__rank", "curve_index", "shard", "slot"]
    assert sorted(r["n"] for r in placed.collect()) == list(range(50)) and {(r["cell_start"], r["salt_start"], r["__rank"]) for r in placed.collect()} == {(1, 2, 3.0)}


# ---- exact dedup


def brute_dedup(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(-1 if doc_id is None else doc_id)
    return groups


def test_dedup_edge_rows(edge_docs, edge_rows, no_docs):
    groups = brute_dedup([r[:2] for r in edge_rows])
    for words in (dedup.FILTER_WORDS, 1):  # a filter that tells keys apart, and one that lets nearly all rows pass
        rows = dedup.exact_dedup(edge_docs.select("doc_id", "text"), digest_all=True, filter_words=words)
        got = rows.collect()
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        assert len(got) == len(edge_rows)
        kept = Counter(r["text_sha256"] for r in got if r["kept"])
        assert kept == Counter(list(by_sha))
        for r in got:
            ids = by_sha[r["text_sha256"]]
            best = max(ids)
            assert r["group_size"] == len(ids) and (r["keep_id"] if r["keep_id"] is not None else -1) == best
            assert not r["kept"] or (r["doc_id"] if r["doc_id"] is not None else -1) == best
    assert dedup.exact_dedup(no_docs).count() == 0


def test_dedup_output_does_not_depend_on_the_filter(documents):
    """Nulls included: a hash stands where there is a copy, whatever rows were hashed in vain."""
    wide, narrow = (sorted(map(tuple, dedup.exact_dedup(documents, filter_words=w).collect())) for w in (dedup.FILTER_WORDS, 1))
    assert wide == narrow and all((r[2] > 1) == (r[4] is not None) for r in wide) and any(r[4] for r in wide)


def test_only_texts_with_a_shared_beginning_are_hashed(spark, documents, monkeypatch):
    """Of rows with own lengths or own beginnings no text is hashed, in the stage that drops copies too."""
    head = "x" * 64
    texts = [head + "a", head + "b", head + "a", "y" * 65, "z" * 66, head, None, "", "q" * 64]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashed = lambda d: dedup.Passes.over(d, "text", 64, dedup.FILTER_WORDS).survivors(d, "text", "sha").where("sha is not null")
    assert sorted(r["doc_id"] for r in hashed(docs).collect()) == [0, 1, 2, 6, 7]
    n, head = F.octet_length("text"), F.substring("text", 1, 64)
    shared = documents.join(documents.groupBy(n.alias("n"), head.alias("head")).count().where("count > 1"), (n == F.col("n")) & (head == F.col("head")))
    assert shared.count() == hashed(documents).count() < documents.count()
    plan = dedup.drop_exact_copies(documents)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan and all("CASE WHEN" in part for part in plan.split("sha2")[:-1])


def test_filters_grow_with_their_keys(spark):
    """Ten million keys: of as many others no more than a tenth pass, and every key does."""
    assert [dedup.filter_size(k) for k in (0, 100, 10**6, 10**9)] == [16, 32, 1 << 18, dedup.FILTER_WORDS]
    n = 10_000_000
    keys = spark.range(n).select("id")
    held = dedup.Filter(staged(dedup.bit_filter(keys, F.struct("id"), dedup.filter_size(n)), "keys"), dedup.filter_size(n))
    asked = held.ask(spark.range(n - 200_000, n + 200_000), F.struct("id"), "found")
    known, strangers = (asked.where(w).where("found").count() for w in (f"id < {n}", f"id >= {n}"))
    assert known == 200_000 and strangers < 20_000


def test_dedup_prefix_ties(spark):
    head = "x" * 100
    docs = spark.createDataFrame([(1, head + "ab"), (2, head + "ba"), (3, head + "ab")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in dedup.exact_dedup(docs).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True)}


@pytest.mark.parametrize("few", [True, False])
def test_drop_exact_copies(edge_docs, edge_rows, no_docs, few, monkeypatch):
    """With the dropped rows broadcast, and with a join by shuffle."""
    monkeypatch.setattr(dedup, "small", lambda df: few)
    left = dedup.drop_exact_copies(edge_docs)
    assert left.columns == edge_docs.columns
    rows = left.collect()
    assert sorted((r["text"] or "") for r in rows) == sorted({r[1] or "" for r in edge_rows})
    assert {r["doc_id"] for r in rows if r["text"] and r["text"].startswith("the same")} == {5}
    assert dedup.drop_exact_copies(no_docs).count() == 0


def test_drop_exact_copies_folds_repeated_keeper(spark):
    docs = spark.createDataFrame([(7, "t"), (7, "t"), (7, "t"), (3, "t"), (7, "u")], "doc_id long, text string")
    assert sorted(map(tuple, dedup.drop_exact_copies(docs).collect())) == [(7, "t"), (7, "u")]


# ---- quality


def brute_metrics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {k for i, w in enumerate(windows) if counts[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_metrics_equal_brute_force(spark, edge_docs, edge_rows, documents, texts):
    rep = ["a b c d e f g h " * 2, "a b c d e f g h", "a b c d e f g h x a b c d e f g h", "z " * 9, "q w e r t y u i o " * 5 + "end"]
    made = spark.createDataFrame(list(enumerate(rep)), "doc_id long, text string")
    for docs, want in ((made, dict(enumerate(rep))), (documents, texts)):
        for r in quality.with_metrics(docs.select("doc_id", "text")).collect():
            assert tuple(r[m] for m in METRICS) == brute_metrics(want[r["doc_id"]]), r["doc_id"]
    got = sorted(tuple(r[m] for m in METRICS) for r in quality.with_metrics(edge_docs).collect())
    assert got == sorted(brute_metrics(r[1]) for r in edge_rows)


def test_cascade_is_one_verdict_in_every_order(edge_docs, no_docs, documents):
    lazy = {r["doc_id"]: r["failed_rule"] is None for r in quality.quality_cascade(documents).collect()}
    counted = {r["doc_id"]: r["failed_rule"] is None for r in quality.quality_cascade(documents, metrics=True).collect()}
    assert lazy == counted
    backwards = documents.withColumn("f", quality.first_failure(quality.rules()[::-1]))
    assert lazy == {r["doc_id"]: r["f"] is None for r in backwards.collect()}
    passing = quality.passing(edge_docs)
    assert passing.columns == edge_docs.columns and all(r["text"].startswith("word0") for r in passing.collect())
    assert quality.quality_cascade(no_docs).count() == 0 and quality.passing(no_docs).count() == 0


def test_rules_have_one_order(documents):
    """However the rows are spread, the sample ranks the rules alike, so a row's first failed rule is stable."""
    orders = {tuple(r.name for r in quality.rank_rules(documents.repartition(k), quality.rules())) for k in (1, 3, 7)}
    assert len(orders) == 1
    failed = [sorted((r["doc_id"], r["failed_rule"]) for r in quality.quality_cascade(documents.repartition(k)).select("doc_id", "failed_rule").collect() if r["failed_rule"]) for k in (1, 5)]
    assert failed[0] == failed[1]


def test_quality_keeps_clean_and_finds_junk(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.quality_cascade(documents).join(labels, "doc_id").where("n_chars > 400")
    rows = judged.select("quality", F.col("failed_rule").isNull().alias("kept")).collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(clean) >= 0.97 * len(clean)


# ---- licenses


def brute_words(text):
    low = (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_met(words, threshold=0.9):
    """(template, start, width) of all runs of words that meet a template."""
    sets = [set(brute_words(t)) for _, t in licenses.TEMPLATES]
    enough = [math.ceil(threshold * len(w) - 1e-9) for w in sets]

    def told(k, i):
        own = sets[k] - sets[i]
        return own if len(own) <= len(sets[k]) - enough[k] else set()

    others = lambda k: [i for i in range(len(sets)) if licenses.TEMPLATES[i][0] != licenses.TEMPLATES[k][0]]
    met = []
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        if len(sets[k] & set(words)) >= enough[k]:
            width, must = len(brute_words(text)) + licenses.SLACK, set().union(*(told(k, i) for i in others(k)))
            for s in range(len(words)):
                held = set(words[s : s + width])
                if words[s] in sets[k] and len(held & sets[k]) >= enough[k] and must <= held:
                    met.append((k, s, width))
    beats = lambda x, m: x[0] in others(m[0]) and told(x[0], m[0]) and not told(m[0], x[0]) and x[1] < m[1] + m[2] and m[1] < x[1] + x[2]
    return [m for m in met if not any(beats(x, m) for x in met)]


def brute_scan(text):
    words = brute_words(text)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    labels = {x for _, x in places} | {licenses.TEMPLATES[k][0] for k, _, _ in brute_met(words)}
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels))


def test_scan_edge_rows(spark, edge_docs, edge_rows, no_docs):
    made = [
        "under the MIT license under the mit license",
        "x Apache License, Version 2 cc-by-nc\n(Under The  MIT\tLicense)",
        "cc by nc cc by nc cc by nc",
        "permission granted free of charge to any person obtaining a copy of this hereby is software",
        "é under the mit license",
        "This is work licensed under the GNU General Public License version\n3",
    ]
    rows = [r[:2] for r in edge_rows] + list(enumerate(made, 100))
    docs = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(made, 100)), "doc_id long, text string"))
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels"]
    got = licenses.license_scan(docs).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted([(r["doc_id"], *[r[c] for c in columns]) for r in got], key=key) == sorted([(d, *brute_scan(t)) for d, t in rows], key=key)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert licenses.license_scan(no_docs).count() == 0


def test_scan_wrapped_notices(spark):
    """Notices wrapped where their files wrap them, at other widths, and at every word; their words far apart are none."""
    notices = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files",
        "bsd": "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that",
        "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public\n\n// License, v. 2.0. If a copy of the MPL",
    }
    made = [(label, f"Some prose before.\n{t}\nand after.") for label, t in notices.items()]
    made += [(label, t.replace(" ", "\n")) for label, t in notices.items()]
    made += [(label, "x " * 60 + t.replace("\n", " ").replace("granted", "granted\n").replace("forms", "\nforms").replace("subject", "subject\n") + " y" * 60) for label, t in notices.items()]
    made += [("", t.replace("\n", "\n" + "x " * 60)) for t in notices.values()]
    made += [("", None), ("", "\n\n"), ("mit", notices["mit"].replace("\n", " "))]
    rows = [(k, t) for k, (_, t) in enumerate(made)]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["labels"] for k in range(len(made))] == [label for label, _ in made]
    assert [m["word"] for m in got[0]["matches"]] == [3] and got[0]["score"] == 1


def test_rival_notices_are_told_apart(spark):
    """One label for each notice of a family, in one line, wrapped, and with the next one behind it."""
    gnu = "licensed under the GNU {0}General Public License, version {1}"
    notices = [("gpl-3", "This work is " + gnu.format("", 3)), ("gpl-2", "This work is " + gnu.format("", 2)), ("lgpl-3", gnu.format("Lesser ", 3)), ("agpl-3", gnu.format("Affero ", 3))]
    notices += [("agpl-3", "This work is " + gnu.format("Affero ", 3)), ("lgpl-3", "This work is " + gnu.format("Lesser ", 3))]
    rows = [(label, f"{before}{text}.{after}") for label, text in notices for before, after in (("", ""), ("Some words\n", "\nAnd more"))]
    rows += [(label, text.replace(" ", "\n# ")) for label, text in notices]
    far = " and so on" * 20
    rows += [("gpl-2,gpl-3", notices[0][1] + far + notices[1][1]), ("agpl-3,gpl-3", notices[4][1] + far + notices[0][1])]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.license_scan(docs).collect()}
    assert [got[k] for k in range(len(rows))] == [label for label, _ in rows]


@pytest.mark.parametrize("length", [50, 400, 3000])
def test_strewn_words_are_no_notice(spark, length):
    """The words of each short template, evenly strewn over one line; and the same line with the notice whole behind it."""
    short = [(label, t) for label, t in licenses.TEMPLATES if len(brute_words(t)) * 3 <= length]
    rows = []
    for label, notice in short:
        words = brute_words(notice)
        line = [f"filler{k}" for k in range(length)]
        for k, w in enumerate(words):
            line[k * length // len(words)] = w
        rows += [("", " ".join(line)), (label, " ".join([*line, *["tail"] * 40, notice]))]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.license_scan(docs).collect()}
    assert [got[k] for k in range(len(rows))] == [label for label, _ in rows]


def test_labels_of_the_test_documents(spark):
    """The licence lines of the test tables have one label each, the one they name."""
    names = {"GNU General Public License, version 3": "gpl-3", "MIT License": "mit", "Apache License, Version 2": "apache-2", "CC BY-NC": "cc-by-nc"}
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = licenses.license_scan(documents).join(documents, "doc_id").select("labels", "text").collect()
    for r in rows:
        named = {label for words, label in names.items() if words.lower() in (r["text"] or "").lower()}
        assert set(r["labels"].split(",")) - {""} <= named
    assert any(r["labels"] == "gpl-3" for r in rows)
