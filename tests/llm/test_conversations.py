"""Conversation repair against a search over all edits, and the damage and faults against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from tests.conftest import SF_SMALL

from casework.llm import conversations as cv
from casework.llm.queries import QUERIES

COLS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """(cost, audit, repaired rows) of the cheapest edits of (role, text, fault) rows, by trying all."""
    best = None

    def add(i, made, cost, audit):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for k in range(3):
            for ins in itertools.product(("user", "assistant"), repeat=k):
                now, c, a = made + [(x, "") for x in ins], cost + 3 * k, audit + "I" * k
                if i == len(rows):
                    if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in now)):
                        new = (c, a, now)
                        best = new if best is None or new < best else best
                    continue
                role, text, fault = rows[i]
                add(i + 1, now, c + 4, a + "D")
                if fault not in ("blank", "duplicate"):
                    extra = 3 if fault == "truncated" else 0
                    add(i + 1, now + [(role, text)], c + extra, a + "K")
                    for x in ("user", "assistant"):
                        add(i + 1, now + [(x, text)], c + extra + 3, a + "R")
    add(0, [], 0, "")
    return best


def expected(table, hurt=True):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            d = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if hurt else 9
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            if d:
                rows += [((turn is not None, turn or 0), hashlib.sha256(f"{len('user' if d == 4 else role)}:{'user' if d == 4 else role}{text}".encode()).digest(),
                          k, turn, "user" if d == 4 else role, text) for k in range(2 if d == 3 else 1)]
        rows.sort(key=lambda r: r[:3])
        seen, faults = set(), []
        for *_, role, text in rows:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [r[3] for r in rows if r[3] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[4][:1] + b[4][:1] for a, b in zip(rows, rows[1:])]
        cost, audit, made = cheapest([(r[4], r[5], f) for r, f in zip(rows, faults)])
        out[conv] = (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs),
                     cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()), made
    return out


def test_query_on_the_whole_table(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_conversations"](spark, SF_SMALL)
    assert got.columns == COLS
    assert {r["conv_id"]: tuple(r) for r in got.collect()} == {c: x for c, (x, _) in expected(table).items()}


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "umpire", "Assistant"]
TEXTS = ["Yes.", "No!", "cut off", "", None, " \n\t", "Yes.", "ends. \x0b", "odd end. ", "\xa0", "é?", "x" * 20_000 + "."]


def odd_table(seed=0):
    r, rows = random.Random(seed), []
    for conv in [*range(60), None, -5]:
        for _ in range(r.choice([0, 1, 2, 3, 4, 5])):
            rows.append((conv, r.choice([None, -1, 0, 1, 2, 3, 4, 7, 7]), r.choice(ROLES), r.choice(TEXTS)))
    rows += rows[:12]  # repeated rows
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, conv string, digest int, `a.b` int"


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_odd_rows_in_segments_of_any_size(spark, size):
    table = odd_table(size)
    want = expected(table)
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in table], SCHEMA).repartition(4)
    rows = cv.damaged(df)
    assert {r["conv_id"]: tuple(r[c] for c in COLS) for r in cv.digests(rows, size).collect()} == {c: x for c, (x, _) in want.items()}
    made = {}
    for r in cv.repaired(rows, size).orderBy("conv_id", "part", "seq", "at", "piece").collect():
        made.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert made == {c: m for c, (_, m) in want.items() if m}


def test_a_long_conversation_spans_tasks(spark):
    r = random.Random(8)
    table = [(1, i, r.choice(["user", "assistant", "assistant", "tool"]), r.choice(["Yes.", f"no {i}", f"A {i}.", ""])) for i in range(3000)]
    table += [(c, 0, "user", "Hello.") for c in range(2, 40)]
    rows = cv.plain_rows(spark.createDataFrame(table, "conv_id long, turn long, role string, text string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        segs = cv.segments(rows, 64)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert segs.filter("conv = 1").select("part").distinct().count() > 1
    got = {x["conv_id"]: x for x in cv.digests(rows, 64).collect()}
    # one programme over all rows at once
    seen, codes = set(), []
    for _, _, role, text in table[:3000]:
        fault = cv.BLANK if not text else cv.DUPLICATE if (role, text) in seen else cv.OK if text.endswith(".") else cv.TRUNCATED
        seen.add((role, text))
        codes.append({"s": 0, "u": 1, "a": 2}.get(role[0], 3) * 4 + fault)
    chain = cv.Chain()
    chain.add(cv.segment_table(bytes(codes), (cv.START,)))
    cost, audit, _, _ = chain.close()
    assert (got[1]["cost"], got[1]["audit"]) == (cost, audit) and got[1]["blank"] == sum(c % 4 == cv.BLANK for c in codes)
    made = cv.plan([(t[2], t[3]) for t in table[:3000]], audit)
    assert got[1]["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()
    assert re.fullmatch("(s?(ua)+)?", "".join(a[0] for a, _ in made))


@pytest.mark.parametrize("mod", [cv.MOD, 5, 1])
def test_ties_and_hash_collisions(mod):
    r = random.Random(mod)
    for _ in range(120):
        codes = bytes(r.choice([0, 3, 4, 4, 4, 8, 8, 8, 5, 6, 7, 11, 9, 12, 15]) for _ in range(r.randrange(5)))
        rows = [({"s": "system", "u": "user", "a": "assistant", "-": "tool"}[cv.INITIALS[c // 4]], "x", ["", "blank", "duplicate", "truncated"][c % 4]) for c in codes]
        want = cheapest(rows)
        for step in (1, 2, 9):
            chain = cv.Chain(mod)
            for i in range(0, len(codes), step):
                chain.add(cv.segment_table(codes[i:i + step], (0, 1, 2, 3), mod))
            cost, audit, _, _ = chain.close()
            assert (cost, audit) == want[:2] and cv.plan([x[:2] for x in rows], audit) == want[2]


def test_audits_compare_as_strings():
    for mod in (cv.MOD, 7, 1):
        tree, r = cv.Audits(mod), random.Random(mod)
        nodes = [0]
        for _ in range(400):
            nodes.append(tree.add(r.choice(nodes[-30:]), "".join(r.choice("DIKR") for _ in range(r.choice([1, 1, 2, 9])))))
        for _ in range(800):
            a, b = r.choice(nodes), r.choice(nodes)
            assert tree.less(a, b) == (tree.text(a) < tree.text(b))


def test_empty_table(spark):
    df = cv.damaged(spark.createDataFrame([], SCHEMA))
    assert cv.digests(df).count() == 0 and cv.repaired(df).count() == 0
