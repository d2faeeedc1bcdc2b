import hashlib
import random
import re
import zlib

import pytest
from postledger.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(faults):
    """Least (cost, audit) and the roles by trying every edit sequence; ``faults`` has (initial, fault) of each row."""
    best = None

    def go(i, roles, cost, audit, plan):
        nonlocal best
        if i == len(faults) and re.fullmatch("(s?(ua)+)?", roles):
            found = (cost, audit, plan)
            best = found if best is None or found[:2] < best[:2] else best
        if not re.match("^(s?(ua)*u?)?$", roles):
            return
        if audit[-2:] != "II":
            for r in "ua":
                go(i, roles + r, cost + 2, audit + "I", [*plan, (None, r)])
        if i < len(faults):
            initial, fault = faults[i]
            go(i + 1, roles, cost + 3, audit + "D", plan)
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                go(i + 1, roles + (initial or "-"), cost + extra, audit + "K", [*plan, (i, None)])
                for r in "ua":
                    go(i + 1, roles + r, cost + 2 + extra, audit + "R", [*plan, (i, r)])

    go(0, "", 0, "", [])
    return best


def plain(rows):
    out = []
    for conv in sorted({r[0] for r in rows}, key=lambda c: (c is not None, c or 0)):
        left = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in left:
            kept = text.strip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
            seen.add((role, text))
            faults.append((role[:1], fault))
        turns = [r[1] for r in left if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        number = lambda f: sum(x == f for _, x in faults)
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(faults, faults[1:]))
        cost, audit, plan = cheapest(faults)
        names = {"u": "user", "a": "assistant"}
        lines = [f"{names.get(r) or left[i][2]}:{'' if i is None else left[i][3]}" for i, r in plan]
        out.append((conv, gaps, number("blank"), number("duplicate"), number("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def random_rows(seed, conversations):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, 5)):
            turn = rng.choice([t, t, t, t + 1, None])
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            rows.append((c if c else None, turn, role, rng.choice(["Yes.", "No!", "so it goes", " \t", "", None, "Why? ", "end.\x1c", f"{t}."])))
    return rows


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("bits", [0, 1, 9])
def test_against_all_edit_sequences(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "STRETCH_BITS", bits)
    rows = random_rows(bits, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(repair.repair(df)) == plain(rows)


def test_long_conversation_by_pairs_of_cost_and_audit(spark, monkeypatch):
    """Stretches and big integers give what a table of (cost, audit) per state gives row by row."""
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Fine.", "cut", "", f"{t}!"])) for t in range(3000)]
    letters = []
    left = sorted(damaged(rows), key=lambda r: (r[1], r[2], r[3]))
    seen = set()
    for _, _, role, text in left:
        kept = text.strip()
        letters.append(("sua".index(role[0]), 3 if not kept else 2 if (role, text) in seen else int(kept[-1] not in ".!?")))
        seen.add((role, text))
    best = {0: (0, "")}
    follow = [2, 2, 3, 2]
    for group, fault in letters:
        new = {}

        def offer(state, cost, audit, table=new):
            table[state] = min(table.get(state, (1 << 60, "")), (cost, audit))

        for state, (cost, audit) in best.items():
            for k in range(3):
                offer(state, cost + 2 * k + 3, audit + "I" * k + "D")
                if fault < 2:
                    offer(follow[state], cost + 2 * k + 2 + fault, audit + "I" * k + "R")
                    if (state, group) in ((0, 0), (0, 1), (1, 1), (2, 2), (3, 1)):
                        offer(group + 1, cost + 2 * k + fault, audit + "I" * k + "K")
                state = follow[state]
        best = new
    ends = [(c + extra, a + tail) for s, extra, tail in ((0, 0, ""), (1, 4, "II"), (2, 2, "I"), (3, 0, "")) if s in best for c, a in [best[s]]]
    got = repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(7)).first()
    assert (got["cost"], got["audit"]) == min(ends)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair(empty).collect() == []
    dropped = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Gone."), (dropped + 1, None, None, None), (None, None, "assistant", "x" * 100_000 + "."), (None, 3, "user", "Hm?"), (None, 3, "user", "Hm?")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("other") for c in ("stretch", "state", "at", "letter", "c", "s", "cost", "audit", "kind")})
    got = rows_of(repair.repair(df))
    assert got == plain(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in got
