"""Conversation repair against a search over edit scripts and a chart of all splits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from wardline.llm import repair

GOOD = re.compile(r"(s?(ua)+)?\Z")


def brute(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, sha256) of (role, text) rows: Dijkstra over (place, last role put out)."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, out, made = heapq.heappop(heap)
        if (at, out[-1:]) in done:
            continue
        if at == len(rows) and (not out or out[-1] == "a"):
            assert GOOD.match(out)
            break
        done.add((at, out[-1:]))

        def put(price, letter, role, text, next_at):
            follows = {"": "su", "s": "u", "u": "a", "a": "u"}[out[-1:]]
            if role[:1] and role[0] in follows:
                heapq.heappush(heap, (cost + price, audit + letter, next_at, out + role[0], (*made, f"{role}:{text}")))

        for role in ("user", "assistant"):
            put(3, "I", role, "", at)
        if at < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, out, made))
            role, text = rows[at]
            if faults[at] not in ("blank", "duplicate"):
                extra = 3 if faults[at] else 0
                put(extra, "K", role, text, at + 1)
                for new in ("user", "assistant"):
                    put(3 + extra, "R", new, text, at + 1)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    sha = hashlib.sha256("\n".join(made).encode()).hexdigest()
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)


def gaps(turns):
    held = [t for t in turns if t is not None]
    return max(held) - min(held) + 1 - len(set(held)) if held else 0


def expected(conversations):
    """From (conv_id, turn, role, text) rows, damaged as the query does."""
    rows = defaultdict(list)
    for conv, turn, role, text in conversations:
        place = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fate, role, text = zlib.crc32(place.encode()) % 20, " " if role is None else role, " " if text is None else text
        held = rows[conv]
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            held += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv, held in rows.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        out.append((conv, gaps([r[0] for r in held]), *brute([r[1:] for r in held])))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_repair_query(spark, sf_dir):
    rows = map(tuple, spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect())
    got = map(tuple, repair.op12_conversation_repair(spark, sf_dir).collect())
    assert ordered(got) == ordered(expected(rows))


TEXTS = ["Fine.", "no end", " \n", "", "Why?", "Yes!  \n", "a" * 3000 + "."]


@pytest.fixture(scope="module")
def odd_conversations():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice([*TEXTS, None])) for c in range(60) for _ in range(rng.randrange(1, 9))]
    rows += rows[:40]  # repeated rows
    rows += [(None, k % 7, "user", "Again.") for k in range(30)]
    rows += [(1000, k, rng.choice(roles[:3]), rng.choice(TEXTS[:2]) if k % 9 else f"Turn {k}.") for k in range(400)]
    rows += [(2000, 4, "user", "The same.")] * 300
    return rows


def test_repair_edge_rows(spark, tmp_path, odd_conversations):
    """Null keys, turns, roles and texts, ties, repeats, one long conversation over many tasks, one row 300 times."""
    table = spark.createDataFrame(odd_conversations, "conv_id long, turn long, role string, text string")
    table.selectExpr("*", "1 as copies", "'x' as fault", "0 as part").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert ordered(map(tuple, got)) == ordered(expected(odd_conversations))


def test_repair_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.op12_conversation_repair(spark, str(tmp_path)).collect() == []


def test_chart_equals_one_of_all_splits():
    rng = random.Random(3)
    for _ in range(150):
        turns = [(rng.choice("suatx"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(0, 12))]
        spans = {(k, k + 1): repair.turn_cell(*t) for k, t in enumerate(turns)}
        for length in range(2, len(turns) + 1):
            for i in range(len(turns) - length + 1):
                splits = [repair.joined(spans[i, k], spans[k, i + length]) for k in range(i + 1, i + length)]
                spans[i, i + length] = tuple(min((c for c in column if c is not None), default=None) for column in zip(*splits))
        whole = spans[0, len(turns)] if turns else repair.closure()
        assert repair.chart([repair.turn_cell(*t) for t in turns]) == whole


def test_equal_turns_by_squaring():
    cell = repair.turn_cell("u", repair.DUPLICATE)
    assert repair.repeated(cell, 37) == repair.chart([cell] * 37)


def test_conversations_over_several_ranges(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"Turn {t} of {c}{'.' if t % 3 else ''}", 1) for c in range(3) for t in range(50)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int").repartition(4)
    want = [(c, 0, *brute([r[2:4] for r in rows if r[0] == c])) for c in range(3)]
    assert ordered(map(tuple, repair.repaired(turns).collect())) == want
