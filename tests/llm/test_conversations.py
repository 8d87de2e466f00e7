from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from shelfspark.llm import conversation_repair, queries

COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
GRAMMAR = re.compile("(s?(ua)+)?")


def cheapest(turns: list[str]) -> tuple[int, str]:
    """Least (cost, audit) over all edits, by walking the grammar's states turn by turn; no target strings, no bands, no pieces."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def insert(best):
        for _ in range(4):
            for (before, role), after in follow.items():
                if role != "s" and before in best:
                    now = best[before][0] + 3, best[before][1] + "I"
                    best[after] = min(best.get(after, now), now)
        return best

    best = insert({"": (0, "")})
    for t in turns:
        then = {}
        for state, (cost, audit) in best.items():
            options = [(state, 4, "D")]
            if t != "-":
                extra = 3 * t.isupper()
                options += [(follow[state, r], extra + (0 if t.lower() == r else 3), "K" if t.lower() == r else "R") for r in "sua" if (state, r) in follow and (r != "s" or t.lower() == "s")]
            for after, price, letter in options:
                now = cost + price, audit + letter
                then[after] = min(then.get(after, now), now)
        best = insert(then)
    return min(best[s] for s in ("", "a") if s in best)


def plain(rows: list[tuple]) -> tuple:
    """The contract's figures of one conversation from its rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    known = sorted({r[0] for r in rows if r[0] is not None})
    gaps = known[-1] - known[0] + 1 - len(known) if known else 0
    seen, faults = set(), []
    for _, role, text in rows:
        letters = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else None)
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    codes = []
    for (_, role, _), fault in zip(rows, faults, strict=True):
        c = role[:1] if role[:1] in ("s", "u", "a") else "x"
        codes.append("-" if fault in ("blank", "duplicate") else c.upper() if fault == "truncated" else c)
    cost, audit = cheapest(codes)
    size = len(audit) - audit.count("D")
    target = iter(("s" if size % 2 else "") + "ua" * size)
    out, left = [], iter(rows)
    for letter in audit:
        row = None if letter == "I" else next(left)
        if letter != "D":
            want = next(target)
            role = row[1] if letter == "K" else {"u": "user", "a": "assistant"}[want]
            assert role[:1] == want
            out.append(f"{role}:{row[2] if row else ''}")
    assert GRAMMAR.fullmatch("".join(x[0] for x in out)) and next(left, None) is None
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def damaged(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def made(n: int, seed: int = 9) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for conv in range(n):
        turn = 0
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            turn += rng.choice([1, 1, 1, 2, 0])
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(["user", "assistant", "system", "tool", None, "usher", "user", "assistant", ""]), rng.choice([None, "", " \n", "Yes.", "No", "Same here!", f"Row {len(rows)}.", f"Cut {len(rows)} . ", "é?\t"])))
    return rows + [(None, k, ["user", "assistant"][k % 2 if k % 5 else 0], f"long {k}{'.' if k % 7 else ''}") for k in range(400)] + [(-5, None, "user", "a."), (-5, None, "user", "a."), (-6, 3, "assistant", "x" * 100_000 + " ")]


@pytest.fixture(scope="module")
def rows(spark):
    return made(150) + [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


def wanted(rows: list[tuple]) -> Counter:
    groups = {r[0]: [] for r in rows}
    for conv, *rest in damaged(rows):
        groups[conv].append(tuple(rest))
    return Counter((conv, *plain(g)) for conv, g in groups.items())


@pytest.mark.parametrize("piece_bits", [6, 1])
def test_op13_equals_plain_repair(spark, rows, tmp_path, monkeypatch, piece_bits):
    monkeypatch.setattr(conversation_repair, "PIECE_BITS", piece_bits)
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, audit string, seq int, step int").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_conversation_repair(spark, str(tmp_path)).select(COLUMNS).collect()
    assert Counter(tuple(r) for r in got) == wanted(rows)


def test_repaired_turns_follow_the_grammar(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = conversation_repair.repair(df).where("edit <> 'D'").orderBy("seq", "step").collect()
    roles: dict = {}
    for r in out:
        roles.setdefault(r.conv_id, []).append(r.role[0])
        assert r.edit != "I" or (r.text == "" and r.fault is None)
        assert r.fault not in ("blank", "duplicate")
    assert len(roles) > 50 and all(GRAMMAR.fullmatch("".join(x)) for x in roles.values())


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id string, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op13_conversation_repair(spark, str(tmp_path)).collect() == []


def test_pieces_join_to_the_whole():
    rng = random.Random(4)
    for k in range(400):
        turns = "".join(rng.choice("suaxUA-" if k % 2 else "uaua-sS") for _ in range(rng.randrange(1, 12)))
        want = cheapest(list(turns))
        for size in (1, 2, 5, 100):
            parts = [conversation_repair.align_piece(turns[i : i + size]) for i in range(0, len(turns), size)]
            assert conversation_repair.best_audit(parts) == want, (turns, size)


def test_long_conversations_in_pieces():
    turns = "".join(random.Random(1).choice("uauauaA-s") for _ in range(5000))
    parts = [conversation_repair.align_piece(turns[i : i + 64]) for i in range(0, len(turns), 64)]
    assert conversation_repair.best_audit(parts) == cheapest(list(turns))


def test_bands_leave_cells_out_but_not_results():
    for turns, target in (("uuaa", "uaua"), ("-ua", "ua"), ("sua", "sua"), ("x", ""), ("", "ua"), ("UA", "ua")):
        cost, audit = conversation_repair.align(turns, target, 100)
        assert conversation_repair.align(turns, target, cost) == (cost, audit)
        assert conversation_repair.align(turns, target, cost - 1) is None
    assert conversation_repair.align("u", "s", 100) is None  # a system turn can't be made
