"""Stored filters by index against plain evaluation."""

from __future__ import annotations

import random
import re

import pytest

from shelfspark.operators import saved_queries
from shelfspark.operators.predicate_index import like_regex

NAN = float("nan")
VALUES = ["", "a", "A", "b/c", "B/C/d", "b%c", "x_y", "É", None]
PATTERNS = ["b/%", "B%", "%c", "_", "x\\_%", "é", "%", "b\\%c", "", "a_%"]


def holds(cells: dict, column: str, op: str, value, negated: bool, numeric: set, text: set) -> bool:
    own = cells.get(column)
    if own is None or value is None:
        return False
    if column in numeric:
        try:
            want = float(value)
        except ValueError:
            return False
        key = lambda x: (x != x, 0 if x != x else x)  # noqa: E731  not-a-number is above all numbers
        a, b = key(float(own)), key(want)
        truth = {"=": a == b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}.get(op)
    elif column in text:
        pattern = "".join(".*" if t == "%" else "." if t == "_" else re.escape(t[-1]) for t in re.findall(r"\\.|.", value.lower(), re.S)) if op == "like" else ""
        truth = {"=": own == value, "like": re.fullmatch(pattern, own.lower(), re.S) is not None}.get(op)
    else:
        return False
    return truth is not None and truth != negated


def made(n_filters: int, seed: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for q in range(n_filters):
        for clause in range(rng.randrange(1, 4)):
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                column = rng.choice(["n", "m", "t", "u", "none"] if rng.random() < 0.1 else ["n", "m", "t", "u"])
                numeric = column in ("n", "m")
                op = rng.choice(["=", ">", ">=", "<", "<="] if numeric else ["=", "like"]) if rng.random() < 0.97 else rng.choice(["like", ">", "odd"])
                value = rng.choice([str(rng.randrange(-3, 12)), "2.5", "NaN", "x", None]) if numeric else rng.choice(PATTERNS if op == "like" else VALUES)
                rows.append((q, clause, column, op, value, rng.random() < 0.2))
    return rows


def files_of(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(i, rng.choice([None, 0.0, 2.5, NAN, float(rng.randrange(-3, 12))]), rng.choice([None, rng.randrange(10)]), rng.choice(VALUES), rng.choice(VALUES)) for i in range(n)]


def by_hand(files: list[tuple], literals: list[tuple]) -> set:
    clauses: dict = {}
    for q, c, *rest in literals:
        clauses.setdefault(q, {}).setdefault(c, []).append(rest)
    out = set()
    for i, n, m, t, u in files:
        cells = {"n": n, "m": m, "t": t, "u": u}
        out |= {(q, i) for q, cs in clauses.items() if all(any(holds(cells, *x, {"n", "m"}, {"t", "u"}) for x in c) for c in cs.values())}
    return out


def found(spark, files, literals, **k) -> list:
    f = spark.createDataFrame(files, "file_id long, n double, m int, t string, u string").repartition(2)
    c = spark.createDataFrame(literals, "query_id long, clause_id int, column string, op string, value string, negated boolean")
    return sorted(tuple(r) for r in saved_queries.match_saved_searches(f, c, ["n", "m"], ["t", "u"], **k).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_index_and_expressions_equal_plain_evaluation(spark, seed):
    files, literals = files_of(60, seed), made(90, seed)
    want = sorted(by_hand(files, literals))
    assert len(want) > 100
    assert found(spark, files, literals, max_compiled=0) == want
    assert found(spark, files, literals, max_compiled=10_000) == want


def test_a_hundred_thousand_filters(spark):
    files, literals = files_of(12, 5), made(100_000, 6)
    assert found(spark, files, literals) == sorted(by_hand(files, literals))


@pytest.mark.parametrize("held", [1, 40, 150])
def test_more_filters_than_are_held_are_dealt(spark, held):
    files, literals = files_of(60, 3), made(90, 4)
    assert len(literals) > held
    assert found(spark, files, literals, held=held) == sorted(by_hand(files, literals))


@pytest.mark.parametrize("pieces", [2, 4096])
def test_filters_of_one_wording_are_matched_once(spark, monkeypatch, pieces):
    files, base, rest = files_of(60, 9), made(30, 10), [(1000 + q, *r) for q, *r in made(5, 11)]
    literals = [*((q + 30 * k, *r) for q, *r in base for k in range(8)), *rest]
    seen = []

    def counted(stated, *a, index=saved_queries.PredicateIndex):
        seen.append(len(stated))
        return index(stated, *a)

    monkeypatch.setattr(saved_queries, "PredicateIndex", counted)
    monkeypatch.setattr(saved_queries, "IDS_AT_ONCE", pieces)
    assert found(spark, files, literals, held=len(base)) == sorted(by_hand(files, literals))
    assert sum(seen) <= len(base) + len(rest) < len(literals) and len(seen) == 2


def test_no_number_of_literals_is_refused(spark):
    """The limit was two million."""
    n = 500_000
    clauses = spark.range(n).selectExpr("id as query_id", "inline(array(" + ", ".join(f"struct({i} as clause_id, '{c}' as column, '{op}' as op, {v} as value, false as negated)" for i, (c, op, v) in enumerate([("n", ">=", "string(id)"), ("n", "<", "string(id + 2)"), ("t", "=", "'a'"), ("u", "=", "'b'"), ("m", "<", "'5'")])) + "))")
    files = spark.createDataFrame([(i, float(i * 99_999), i, "a", "b") for i in range(7)], "file_id long, n double, m int, t string, u string")
    got = saved_queries.match_saved_searches(files, clauses, ["n", "m"], ["t", "u"])
    assert sorted(map(tuple, got.collect())) == sorted((q, i) for i in range(5) for q in (i * 99_999 - 1, i * 99_999) if q >= 0)


def test_windows_find_what_they_hold(spark):
    """Bounds of all sizes and signs, empty and turned windows, values at the ends."""
    rng = random.Random(8)
    ends = [0.0, -0.0, 1e-300, -1e-300, 1.0, 1 + 2**-52, 1e300, -1e300, 2.0**53, 7.25, -7.25, 1e-9]
    files = [(i, v, None, "a", "a") for i, v in enumerate([*ends, NAN, float("inf"), float("-inf"), None])]
    literals = [r for q in range(300) for r in ((q, 1, "t", "=", "a", False), (q, 2, "n", *rng.choice([(">", repr(rng.choice(ends)), False), ("<", repr(rng.choice(ends)), True)])), (q, 3, "n", *rng.choice([("<=", repr(rng.choice(ends)), False), (">=", repr(rng.choice(ends)), True)])))]
    want = sorted(by_hand(files, literals))
    assert len(want) > 100 and found(spark, files, literals, max_compiled=0) == want


def test_nothing_is_shuffled(spark):
    files = spark.createDataFrame(files_of(5, 1), "file_id long, n double, m int, t string, u string")
    clauses = spark.createDataFrame(made(300, 1), "query_id long, clause_id int, column string, op string, value string, negated boolean")
    plan = saved_queries.match_saved_searches(files, clauses, ["n", "m"], ["t", "u"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_limits(spark):
    files, literals = files_of(3, 1), made(10, 1)
    assert found(spark, files, []) == [] and found(spark, [], literals, max_compiled=0) == []
    with pytest.raises(ValueError, match="in parts"):
        found(spark, files, literals, max_literals=3)


def test_like_patterns():
    assert like_regex("A\\%_%").fullmatch("a%bc") and not like_regex("a_").fullmatch("a") and like_regex("%").fullmatch("\n")
