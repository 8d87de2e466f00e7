"""Many stored filters at once: an index over their literals, looked up by each file's values.

Filters are in conjunctive normal form. Each is filed under one of its clauses, the one
that should let fewest files through: equalities under their value, folder patterns
under the text before their first wildcard, comparisons under their threshold in sorted
order, and two clauses that make a window of numbers under the cells it lies in, if that
singles out more than the clause would. A file's values find the filters filed under them
by hash, by prefix and by binary search; clause after clause then drops those that fail.
Work is done on arrays of (file, filter) pairs, a bounded number at once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NEVER = -1
EQ, NE, GT, GE, LT, LE, LIKE, UNLIKE = range(8)
_OPS = {"=": EQ, ">": GT, ">=": GE, "<": LT, "<=": LE, "like": LIKE}
_NEGATED = {EQ: NE, GT: LE, GE: LT, LT: GE, LE: GT, LIKE: UNLIKE}
#: How many files an access path is taken to let through, by kind.
_EXPECTED = {EQ: 1, LIKE: 50}
PAIRS_AT_ONCE = 1 << 18


def like_regex(pattern: str) -> re.Pattern:
    """A LIKE pattern without regard to case; a backslash makes the next character plain."""
    out, plain = "", False
    for c in pattern.lower():
        if plain or c not in "\\%_":
            out, plain = out + re.escape(c), False
        elif c == "\\":
            plain = True
        else:
            out += ".*" if c == "%" else "."
    return re.compile(out, re.S)


def _head(pattern: str) -> str:
    """What every match begins with, in lower case."""
    return re.match(r"[^\\%_]*", pattern.lower())[0]


class _Lists:
    """Lists of filters by place: ``of(places)`` expands each place to its filters."""

    def __init__(self, places: Iterable[int], filters: Iterable[int], n: int):
        places, filters = np.fromiter(places, np.int64), np.fromiter(filters, np.int64)
        order = np.argsort(places, kind="stable")
        self.items, self.starts = filters[order], np.searchsorted(places[order], np.arange(n + 1))

    def of(self, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for each row's range of places."""
        first, size = self.starts[lo], np.maximum(self.starts[hi] - self.starts[lo], 0)
        ends = np.cumsum(size)
        flat = np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return np.repeat(rows, size), self.items[flat]


class PredicateIndex:
    def __init__(self, literals: Iterable[tuple], numeric: list[str], text: list[str]):
        """``literals``: (query_id, clause_id, column, op, value, negated)."""
        self.columns, self.numeric = [*numeric, *text], set(numeric)
        number = {c: i for i, c in enumerate(self.columns)}
        clauses: dict[tuple, list[tuple[int, int, object]]] = {}
        for query, clause, column, op, value, negated in literals:
            own = clauses.setdefault((query, clause), [])
            code = _OPS.get(op, NEVER)
            if column not in number or value is None or code == NEVER:
                continue
            if column in self.numeric:
                try:
                    value = float(value)
                except ValueError:
                    continue
                if code == LIKE:
                    continue
            elif code not in (EQ, LIKE):
                continue
            own.append((number[column], _NEGATED[code] if negated else code, value))
        filters: dict[object, list[list[tuple]]] = {}
        for (query, _), own in clauses.items():
            filters.setdefault(query, []).append(own)
        kept = {q: sorted(c, key=self._cost) for q, c in filters.items() if all(c)}  # a clause without a usable literal is never true
        self.ids = np.array(list(kept), np.int64)
        flat = [clause for c in kept.values() for clause in c]
        self.first_clause = np.concatenate([[0], np.cumsum([len(c) for c in kept.values()])]).astype(np.int64)
        self.first_literal = np.concatenate([[0], np.cumsum([len(c) for c in flat])]).astype(np.int64)
        self.column = np.array([x[0] for c in flat for x in c], np.int64)
        self.op = np.array([x[1] for c in flat for x in c], np.int64)
        values = [x[2] for c in flat for x in c]
        self.number = np.array([v if isinstance(v, float) else 0.0 for v in values])
        self.codes = {v: i for i, v in enumerate(dict.fromkeys(v for v in values if isinstance(v, str)))}
        self.code = np.array([self.codes[v] if isinstance(v, str) else -1 for v in values], np.int64)
        self.strings = list(self.codes)
        self._regex: dict[int, re.Pattern] = {}
        self._file(kept)

    @staticmethod
    def _cost(clause: list[tuple]) -> float:
        return sum(_EXPECTED.get(op, 1000) / (1 + (len(_head(v)) if op == LIKE else 0)) for _, op, v in clause)

    def _file(self, kept: dict) -> None:
        """Put each filter under its window, or under the literals of its first clause."""
        equal: dict[int, list] = {}
        heads: dict[int, list] = {}
        ranges: dict[tuple[int, int], list] = {}
        always: list[int] = []
        windows = self._narrow_windows(kept)
        for q, clauses in enumerate(kept.values()):
            if q in windows:
                continue
            if any(op in (NE, UNLIKE) for _, op, _ in clauses[0]):
                always.append(q)
                continue
            for c, op, v in clauses[0]:
                if op == EQ:
                    equal.setdefault(c, []).append((v if v == v else None, q))  # not-a-number
                elif op == LIKE:
                    heads.setdefault(c, []).append((_head(v), q))
                else:
                    ranges.setdefault((c, op), []).append((v, q))
        self.always = _Lists([0] * len(always), always, 1) if always else None
        self.equal, self.heads, self.ranges, self.cells = {}, {}, {}, {}
        for store, found in ((self.equal, equal), (self.heads, heads)):
            for c, items in found.items():
                keys = {v: i for i, v in enumerate(dict.fromkeys(v for v, _ in items))}
                store[c] = keys, _Lists([keys[v] for v, _ in items], [q for _, q in items], len(keys))
        for at, items in ranges.items():
            items.sort(key=lambda x: (np.isnan(x[0]), x[0]))
            self.ranges[at] = np.array([v for v, _ in items]), _Lists(range(len(items)), [q for _, q in items], len(items))
        celled: dict[tuple[int, int], list] = {}
        for q, (c, lo, hi) in windows.items():
            # cells at least as wide as the window, so that it lies in two at most
            e = max(math.frexp(hi - lo)[1], math.frexp(max(abs(lo), abs(hi)))[1] - 40) if hi > lo or lo else -40
            celled.setdefault((c, e), []).extend((cell, q) for cell in {math.floor(math.ldexp(x, -e)) for x in (lo, hi)})
        for at, items in celled.items():
            own, place = np.unique(np.array([float(cell) for cell, _ in items]), return_inverse=True)
            self.cells[at] = own, _Lists(place, [q for _, q in items], len(own))

    @staticmethod
    def _narrow_windows(kept: dict) -> dict[int, tuple[int, float, float]]:
        """(column, lower, upper) of the filters that two clauses of one comparison each hold to a window, where a value
        lies in a smaller share of such windows than of the first clauses of filters."""
        found: dict[int, tuple[int, float, float]] = {}
        stated: dict[tuple[int, int], set] = {}
        for q, clauses in enumerate(kept.values()):
            for c, op, v in clauses[0]:
                stated.setdefault((c, op), set()).add(_head(v) if op == LIKE else v)
            lower: dict[int, float] = {}
            upper: dict[int, float] = {}
            for clause in clauses:
                if len(clause) == 1 and clause[0][1] in (GT, GE, LT, LE) and math.isfinite(clause[0][2]):
                    c, op, v = clause[0]
                    side, tighter = (lower, max) if op in (GT, GE) else (upper, min)
                    side[c] = tighter(side.get(c, v), v)
            both = [(upper[c] - lower[c], c) for c in lower if c in upper]
            if both and math.isfinite(min(both)[0]):
                c = min(both)[1]
                found[q] = c, min(lower[c], upper[c]), max(lower[c], upper[c])
        ends: dict[int, tuple[float, float]] = {}
        for c, lo, hi in found.values():
            least, most = ends.get(c, (lo, hi))
            ends[c] = min(least, lo), max(most, hi)
        first = [c[0] for c in kept.values()]

        def narrow(q: int, c: int, lo: float, hi: float) -> bool:
            width = ends[c][1] - ends[c][0]
            return hi - lo < width * sum(1 / len(stated[c, op]) if op in (EQ, LIKE) else 1 for c, op, _ in first[q])

        return {q: w for q, w in found.items() if narrow(q, *w)}

    def _paths(self, cells: list, n: int) -> Iterator[tuple[_Lists, np.ndarray, np.ndarray, np.ndarray]]:
        """(lists, files, first place, end of places) of each access path, by file; the filters of the places are candidates."""
        rows = np.arange(n)
        if self.always:
            yield self.always, rows, np.zeros(n, np.int64), np.ones(n, np.int64)
        for c, (keys, lists) in self.equal.items():
            if self.columns[c] in self.numeric:
                values, valid = cells[c]
                at = np.array([keys.get(v if v == v else None, -1) for v in values.tolist()], np.int64)
                at[~valid] = -1
            else:
                names, code, _ = cells[c]
                at = np.append(np.array([keys.get(s, -1) for s in names], np.int64), -1)[code]
            hit = at >= 0
            yield lists, rows[hit], at[hit], at[hit] + 1
        for c, (keys, lists) in self.heads.items():
            names, code, _ = cells[c]
            sizes = sorted({len(k) for k in keys})
            place, owner = [], []
            for i, s in enumerate(names):
                low = s.lower()
                for k_size in sizes:
                    if k_size <= len(low) and (k := keys.get(low[:k_size])) is not None:
                        place.append(k)
                        owner.append(i)
            of_name = _Lists(owner, place, len(names) + 1)
            mine = np.where(code < 0, len(names), code)
            files, heads = of_name.of(rows, mine, mine + 1)
            yield lists, files, heads, heads + 1
        for (c, op), (bounds, lists) in self.ranges.items():
            values, valid = cells[c]
            own = rows[valid]
            v = values[own]
            at = np.searchsorted(bounds, v, "left" if op in (GT, LE) else "right")  # not-a-number is last in both
            none, all_of = np.zeros(len(own), np.int64), np.full(len(own), len(bounds))
            yield (lists, own, none, at) if op in (GT, GE) else (lists, own, at, all_of)
        for (c, e), (own_cells, lists) in self.cells.items():
            values, valid = cells[c]
            own = rows[valid & np.isfinite(values)]
            with np.errstate(over="ignore"):
                cell = np.floor(np.ldexp(values[own], -e))
            at = np.minimum(np.searchsorted(own_cells, cell), len(own_cells) - 1)
            hit = own_cells[at] == cell
            yield lists, own[hit], at[hit], at[hit] + 1

    def _true(self, cells: list, files: np.ndarray, literals: np.ndarray) -> np.ndarray:
        """Whether each literal holds for the file beside it; null makes it false."""
        out, column, op = np.zeros(len(files), bool), self.column[literals], self.op[literals]
        for c in np.unique(column):
            at = np.flatnonzero(column == c)
            f, o, t = files[at], op[at], literals[at]
            if self.columns[c] in self.numeric:
                values, valid = cells[c]
                v, w = values[f], self.number[t]
                same = (v == w) | (np.isnan(v) & np.isnan(w))
                more = (v > w) | (np.isnan(v) & ~np.isnan(w))  # not-a-number is above all numbers and equal to itself
                holds = np.select([o == EQ, o == NE, o == GT, o == GE, o == LT], [same, ~same, more, more | same, ~more & ~same], ~more)
                out[at] = holds & valid[f]
            else:
                names, code, known = cells[c]
                own = code[f]
                holds = (known[own] == self.code[t]) ^ (o == NE)
                like = np.flatnonzero((o == LIKE) | (o == UNLIKE))
                like = like[own[like] >= 0]
                if len(like):
                    pairs, back = np.unique(own[like] * (len(self.strings) + 1) + self.code[t[like]], return_inverse=True)
                    met = np.array([self._matches(names[p // (len(self.strings) + 1)], p % (len(self.strings) + 1)) for p in pairs.tolist()])
                    holds[like] = met[back] ^ (o[like] == UNLIKE)
                out[at] = holds & (own >= 0)
        return out

    def _matches(self, text: str, pattern: int) -> bool:
        if pattern not in self._regex:
            self._regex[pattern] = like_regex(self.strings[pattern])
        return self._regex[pattern].fullmatch(text.lower()) is not None

    def _kept(self, cells: list, files: np.ndarray, filters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose clauses all hold, looked at one clause after the other."""
        done, step = [], 0
        while len(files):
            clause = self.first_clause[filters] + step
            lo, size = self.first_literal[clause], self.first_literal[clause + 1] - self.first_literal[clause]
            ends = np.cumsum(size)
            literals = np.repeat(lo - ends + size, size) + np.arange(ends[-1])
            holds = np.logical_or.reduceat(self._true(cells, np.repeat(files, size), literals), ends - size)
            files, filters = files[holds], filters[holds]
            step += 1
            last = self.first_clause[filters] + step == self.first_clause[filters + 1]
            done.append((files[last], filters[last]))
            files, filters = files[~last], filters[~last]
        return np.concatenate([f for f, _ in done]), np.concatenate([q for _, q in done])

    def match(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of the batch, query_id) of all filters that hold."""
        if not len(self.ids):
            return
        cells: list = []
        for c in self.columns:
            column = batch.column(c)
            if c in self.numeric:
                cells.append((pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False), pc.is_valid(column).to_numpy(zero_copy_only=False)))
            else:
                coded = column.dictionary_encode()
                names = coded.dictionary.to_pylist()
                known = np.append(np.array([self.codes.get(s, -1) for s in names], np.int64), -1)
                cells.append((names, pc.fill_null(coded.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False), known))
        n = batch.num_rows
        paths = list(self._paths(cells, n))
        size = np.zeros(n, np.int64)
        for lists, files, lo, hi in paths:
            size += np.bincount(files, np.maximum(lists.starts[hi] - lists.starts[lo], 0), n).astype(np.int64)
        ends, begin = np.cumsum(size), 0
        while begin < n:
            # files until their candidates are too many, one at least
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
            found = []
            for lists, files, lo, hi in paths:
                a, b = np.searchsorted(files, [begin, end])
                f, q = lists.of(files[a:b], lo[a:b], hi[a:b])
                found.append(q * n + f)
            begin = end
            pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            if len(pairs):
                files, filters = self._kept(cells, pairs % n, pairs // n)
                yield files, self.ids[filters]
