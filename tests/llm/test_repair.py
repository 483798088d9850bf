"""Conversation repair against a plain dynamic program over whole conversations."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import repair

SF = "/root/testdata/sf0.001"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain(rows):
    """Results of one conversation of (turn, role, text), by the least (cost, edits) of every rest."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))

    @cache
    def best(i, last, inserts):
        if i == len(rows):
            found = [(0, "")] if last in ("", "a") else []
        else:
            first, more = rows[i][1][:1], 5 if faults[i] == "truncated" else 0
            found = [(2, "D", i + 1, last)]
            if faults[i] in ("", "truncated"):
                if first == AFTER[last] or (first == "s" and last == ""):
                    found.append((more, "K", i + 1, first))
                found.append((1 + more, "R", i + 1, AFTER[last]))
            found = [(c + best(j, a, 0)[0], e + best(j, a, 0)[1]) for c, e, j, a in found]
        if inserts < 4:
            rest = best(i, AFTER[last], inserts + 1)
            found.append((5 + rest[0], "I" + rest[1]))
        return min(found, default=(10**9, ""))

    cost, edits = best(0, "", 0)
    lines, last, i = [], "", 0
    for e in edits:
        if e == "I":
            last = AFTER[last]
            lines.append({"u": "user:", "a": "assistant:"}[last])
            continue
        _, role, text = rows[i]
        i += 1
        if e == "K":
            last = role[0]
            lines.append(f"{role}:{text}")
        elif e == "R":
            last = AFTER[last]
            lines.append({"u": "user:", "a": "assistant:"}[last] + text)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, digest)


def brute(rows, damages=True):
    by = {r[0]: [] for r in rows}
    for conv, turn, role, text in damaged(rows) if damages else rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return {conv: plain(r) for conv, r in by.items()}


def collected(df):
    rows = df.collect()
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(found) == len(rows)
    return found


ROLES = ["user", "assistant", "system", "tool", "", None, "unit"]
TEXTS = ["A word.", "No end", "", " \n\x0b", None, "Is it?", "tail  ", "Ja! ", "x\x1f"]


def test_search_finds_the_cheapest_and_first_path():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(rng.choice(range(5)), rng.choice([r or " " for r in ROLES]), rng.choice(["A.", "b", "", "C!"])) for _ in range(rng.randrange(9))]
        want = plain(rows)
        order = sorted(rows, key=lambda r: (r[0], r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        assert repair._settle(order) == want


def test_chunks_chain_to_the_whole_search():
    rng = random.Random(2)
    for _ in range(60):
        rows = [(rng.choice("suatx"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 30))]
        whole = repair.search(rows)
        cut = rng.randrange(len(rows) + 1)
        ways = []
        for mid in range(4):
            a = repair.search(rows[:cut], 0, mid)
            b = repair.search(rows[cut:], mid)
            if a is not None and b is not None:
                ways.append((a[0] + b[0], a[1] + b[1]))
        assert min(ways) == whole


@pytest.mark.parametrize("parts", [1, 40])
def test_repair_matches_brute_force(spark, parts, monkeypatch):
    monkeypatch.setattr(repair, "parallelism", lambda df: parts)
    rng = random.Random(parts)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(6)]), rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(150)]
    rows += [(-5, i, rng.choice(ROLES), f"{i % 70} {rng.choice(['x', 'y.'])}") for i in range(700)] + [(99, 0, "user", "again.")] * 300
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = table.withColumn("cost", F.lit("c")).withColumn("chunk", F.lit(1)).withColumn("range", F.lit(1)).repartition(7)
    assert collected(repair.repair(repair.damage(table), table)) == brute(rows)


def test_query_matches_brute_force(spark):
    from cohortloom.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(queries.op13_repair(spark, SF)) == brute(rows)


def test_empty_tables_and_conversations_without_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    none = spark.createDataFrame([], schema)
    assert collected(repair.repair(none, none)) == {}
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "x")], schema)
    assert collected(repair.repair(repair.damage(one), one)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
