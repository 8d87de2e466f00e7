"""Repair of a conversation's structure by alignment to its target grammar.

Role initials of a sound conversation read ``(s?(ua)+)?``. Its turns are aligned, by
Wagner and Fischer's edit table, to the grammar string of each feasible length (``uaua..``
or ``suau..``); cells beyond Ukkonen's bands, which the cost of the best alignment so
far sets, are left out. Of the cheapest alignments of all lengths, the backtraced audit
that is least in ASCII order wins. Edits: keep a turn (0), change its role to user or
assistant (3), delete it (4), insert an empty turn of either role (3). Blank and
duplicate turns must go; a truncated turn that stays adds 3.

A conversation may be of any length. Turns are put in order by a range sort over
(conversation, turn) and cut into pieces of 2^``PIECE_BITS`` turns; each piece is aligned by
itself from each state that the turns before it can leave (nothing yet, a user turn
last, an assistant or system turn last). As two audits of one piece and cost never
begin with each other, the least ones of pieces join to the least of the whole, so the
pieces' tables are put together afterwards, two neighbours at a time. Only one letter a
turn meets there; texts stay spread out and are joined to their edits by turn.

Blank and duplicate are told from the turns in this order: a turn is blank without any
``[^\\x20\\x09-\\x0D]``, else a duplicate if an earlier turn has its role and text (texts
are compared by SHA-256), else truncated if its last such character isn't ``[.!?]``.

Defined results: null roles and texts count as one blank, a null conversation id is a
conversation, null turns come first; turns of equal number are ordered by role, by the
first 64 characters of the text and by a hash of it.
A turn whose role is empty can't be kept. Other columns are ignored; repeated rows are
duplicates; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .textscan import released, small_batches

PIECE_BITS = 6
SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATION = 3, 4, 3, 3
#: What stands before the next turn: nothing, a system, a user or an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = "", "s", "u", "a"
STATES = (NOTHING, SYSTEM, USER, ASSISTANT)
#: Alignments of pieces that a worker keeps.
MEMO = 1 << 14
Tables = dict[tuple[str, str], tuple[int, str]]
_known: dict[str, Tables] = {}


_FAR = 1 << 30
#: Cost of letting a turn stand where a role is due; the letter is K if that is its own role, else R.
_PRICES = {
    turn: {due: _FAR if turn == "-" else (TRUNCATION if turn.isupper() else 0) + (0 if turn.lower() == due else REROLE if due != SYSTEM else _FAR) for due in (SYSTEM, USER, ASSISTANT)}
    for turn in "suaxSUAX-"
}


def edit_table(turns: str, target: str, limit: int) -> list[list[int]]:
    """Wagner and Fischer's table: cost of turning so many turns into so much of the target, ``_FAR`` above the limit."""
    left, right = limit // DELETE, limit // INSERT  # so far a path within the limit can stray from the diagonal
    inserts = [_FAR, *(_FAR if due == SYSTEM else INSERT for due in target)]  # a system turn can't be made
    rows: list[list[int]] = []
    above: list[int] = []
    m = len(target)
    for i in range(len(turns) + 1):
        row = [_FAR] * (m + 1)
        prices = _PRICES[turns[i - 1]] if i else {}
        for j in range(max(0, i - left), min(m, i + right) + 1):
            best = row[j - 1] + inserts[j] if j else _FAR
            if i:
                best = min(best, above[j] + DELETE, above[j - 1] + prices[target[j - 1]] if j else _FAR)
            elif not j:
                best = 0
            if best <= limit:
                row[j] = best
        rows.append(row)
        above = row
    return rows


def backtraced(rows: list[list[int]], turns: str, target: str) -> str:
    """The least audit in ASCII order among the cheapest alignments to the whole target."""
    n, m = len(turns), len(target)
    onward: dict[tuple[int, int], dict[str, tuple[int, int]]] = {(n, m): {}}  # of cells on a cheapest path: letters and where they lead
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            if (i, j) not in onward:
                continue
            cost, at = rows[i][j], (i, j)
            if j and target[j - 1] != SYSTEM and rows[i][j - 1] + INSERT == cost:
                onward.setdefault((i, j - 1), {})["I"] = at
            if i and rows[i - 1][j] + DELETE == cost:
                onward.setdefault((i - 1, j), {})["D"] = at
            if i and j and rows[i - 1][j - 1] + _PRICES[turns[i - 1]][target[j - 1]] == cost:
                onward.setdefault((i - 1, j - 1), {})["K" if turns[i - 1].lower() == target[j - 1] else "R"] = at
    audit, at = [], (0, 0)
    while at != (n, m):
        letter = min(onward[at])
        audit.append(letter)
        at = onward[at][letter]
    return "".join(audit)


def align(turns: str, target: str, limit: int) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest alignment of the turns to the target, if it costs at most ``limit``.

    A turn is ``s``, ``u``, ``a`` or ``x`` (another role), in upper case if it is truncated, or ``-`` if it must go.
    """
    rows = edit_table(turns, target, limit)
    cost = rows[-1][-1]
    return (cost, backtraced(rows, turns, target)) if cost <= limit else None


def grammar(before: str, length: int, system: bool = False) -> str:
    """The grammar's string of this length after a turn; after nothing it may begin with a system turn."""
    head = SYSTEM if system else ""
    body = "au" if before == USER else "ua"
    return (head + body * length)[:length]


def best_lengths(turns: str, string: str, wanted: dict[str, int]) -> dict[str, tuple[int, str]]:
    """Cheapest alignment to a beginning of the grammar string that ends in each wanted state, of at least so many turns.

    One table serves all lengths: its last row has the cost of each. The band is set by a
    guess at the cost and widened (Ukkonen's doubling) until every state is reached within
    it; the audits of the lengths of least cost are compared.
    """
    limit = DELETE * turns.count("-") + 2 * INSERT
    while True:
        rows, best = edit_table(turns, string, limit), {}
        for length, cost in enumerate(rows[-1]):
            for after, least in wanted.items():
                if cost <= limit and length >= least and (not length or string[length - 1] == after):
                    best.setdefault(after, []).append((cost, length))
        if len(best) == len(wanted):
            break
        limit *= 2
    out = {}
    for after, found in best.items():
        cost = min(found)[0]
        out[after] = cost, min(backtraced([r[: length + 1] for r in rows], turns, string[:length]) for c, length in found if c == cost)
    return out


def align_piece(turns: str) -> Tables:
    """Cost and least audit by the state before the piece and the state after it."""
    if turns in _known:
        return _known[turns]
    longest = 2 * len(turns) + 3  # beyond that each length costs more than the one before
    out: Tables = {(SYSTEM, SYSTEM): (DELETE * len(turns), "D" * len(turns))}
    out[NOTHING, NOTHING] = out[SYSTEM, SYSTEM]
    user_next = best_lengths(turns, grammar(ASSISTANT, longest), {USER: 1, ASSISTANT: 1})
    for after, found in user_next.items():
        out[SYSTEM, after] = out[NOTHING, after] = out[ASSISTANT, after] = found
    out[ASSISTANT, ASSISTANT] = min(user_next[ASSISTANT], out[SYSTEM, SYSTEM])
    out |= {(USER, after): found for after, found in best_lengths(turns, grammar(USER, longest), {USER: 1, ASSISTANT: 1}).items()}
    out[USER, USER] = min(out[USER, USER], out[SYSTEM, SYSTEM])
    if "s" in turns.lower():
        for after, found in best_lengths(turns, grammar(NOTHING, longest, True), {SYSTEM: 1, USER: 1, ASSISTANT: 1}).items():
            out[NOTHING, after] = min(out.get((NOTHING, after), found), found)
    if len(_known) >= MEMO:
        _known.clear()
    if len(turns) <= 1 << PIECE_BITS:
        _known[turns] = out
    return out


def join_tables(x: Tables, y: Tables) -> Tables:
    """Of two neighbouring pieces, the tables of both together."""
    out: Tables = {}
    for (before, between), (cost, audit) in x.items():
        for after in STATES:
            if (between, after) in y:
                more, rest = y[between, after]
                now = cost + more, audit + rest
                if (before, after) not in out or now < out[before, after]:
                    out[before, after] = now
    return out


def best_audit(pieces: list[Tables]) -> tuple[int, str]:
    """Cost and audit of a whole conversation from its pieces' tables, neighbours first."""
    while len(pieces) > 1:
        pieces = [join_tables(pieces[k], pieces[k + 1]) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
    return min(pieces[0][NOTHING, after] for after in (NOTHING, ASSISTANT) if (NOTHING, after) in pieces[0])


def turn_edits(audit: str) -> Iterator[tuple[str, str]]:
    """Letters of each turn, with the insertions before it (and behind the last one), and the roles due (``-`` for a deletion)."""
    length = len(audit) - audit.count("D")
    due = iter(grammar(NOTHING, length, length % 2 == 1))
    letters, roles, left = "", "", len(audit) - audit.count("I")
    for k, letter in enumerate(audit):
        letters += letter
        roles += "-" if letter == "D" else next(due)
        if letter != "I":
            left -= 1
            if left:
                yield letters, roles
                letters = roles = ""
            else:
                rest = len(audit) - k - 1
                yield letters + audit[k + 1 :], roles + "".join(next(due) for _ in range(rest))
                return


def in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, seq), written: ``seq`` rises by one from turn to turn of a conversation within a partition."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    # ranges are cut by narrow keys; equal rows may lie in several of them, next to each other
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.xxhash64("text")]
    ranges = rows.withColumn("row", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*by, "row")
    return materialize(ranges.sortWithinPartitions(*by, "text").drop("row").withColumn("seq", F.monotonically_increasing_id()), "turns")


def with_faults(turns: DataFrame) -> DataFrame:
    """(seq, conv_id, initial, fault): the first fault of each turn, or null; narrow, without texts."""
    text = F.rtrim("text", F.lit(SPACES))
    firsts = turns.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    flags = turns.select("seq", "conv_id", F.substring("role", 1, 1).alias("initial"), (text == "").alias("blank"), (~F.substring(text, -1, 1).isin(".", "!", "?")).alias("open"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
    return flags.join(firsts, "seq", "left").select("seq", "conv_id", "initial", fault.alias("fault"))


def repair(conversations: DataFrame) -> DataFrame:
    """One row for each edit: (conv_id, seq, step, edit, role, text, turn, initial, fault).

    Ordered by ``seq`` and ``step``, rows with another edit than D are the repaired turns.
    ``turn``, ``initial`` (of the role it had) and ``fault`` are those of the turn that K, R
    and D edit, null for insertions.
    """
    small_batches(conversations.sparkSession)
    turns = in_order(conversations)
    faults = materialize(with_faults(turns), "faults")
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    held = F.array_sort(F.collect_list(F.struct("seq", letter.alias("letter"))))
    pieces = faults.groupBy("conv_id", F.shiftright("seq", PIECE_BITS).alias("piece")).agg(held.alias("held")).select("conv_id", F.col("held")[0]["seq"].alias("first"), F.array_join(F.transform("held", lambda x: x["letter"]), "").alias("turns"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            found = [json.dumps([(*states, *best) for states, best in align_piece(t).items()]) for t in batch.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("first"), pa.array(found, pa.string())], ["conv_id", "first", "tables"])

    conv = conversations.schema["conv_id"].dataType.simpleString()
    tables = pieces.mapInArrow(aligned, f"conv_id {conv}, first long, tables string")
    whole = tables.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "tables"))).alias("pieces")).select("pieces")

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for row in range(batch.num_rows):
                parts = [(p["first"], {(before, after): (cost, audit) for before, after, cost, audit in json.loads(p["tables"])}) for p in batch.column("pieces")[row].as_py()]
                seqs, letters, roles = _numbered(parts, best_audit([tables for _, tables in parts])[1])
                for k in range(0, len(seqs), 10_000):
                    yield pa.record_batch({"seq": pa.array(seqs[k : k + 10_000], pa.int64()), "edits": pa.array(letters[k : k + 10_000]), "roles": pa.array(roles[k : k + 10_000])})

    edits = whole.mapInArrow(edited, "seq long, edits string, roles string")
    steps = turns.join(edits, "seq").join(faults.select("seq", "initial", "fault"), "seq").select("*", F.explode(F.sequence(F.lit(1), F.length("edits"))).alias("step"))
    steps = steps.withColumns({"edit": F.expr("substr(edits, step, 1)"), "due": F.when(F.expr("substr(roles, step, 1)") == "u", "user").otherwise("assistant")})
    own = F.col("edit") != "I"
    role = F.when(F.col("edit").isin("I", "R"), F.col("due")).otherwise(F.col("role"))
    return steps.select("conv_id", "seq", "step", "edit", role.alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"), *(F.when(own, F.col(c)).alias(c) for c in ("turn", "initial", "fault")))


def _numbered(parts: list[tuple[int, Tables]], audit: str) -> tuple[list[int], list[str], list[str]]:
    """Each turn's number, edits and roles; turns of a piece are numbered in a row, and (s, s) deletes them all."""
    edits = list(turn_edits(audit))
    seqs = [first + k for first, tables in parts for k in range(len(tables[SYSTEM, SYSTEM][1]))]
    return seqs, [e[0] for e in edits], [e[1] for e in edits]


def summarize(repaired: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each distinct id of ``ids``.

    The digest of a conversation runs over its turns in order, so a task reads the turns
    of one as a stream and keeps nothing of them but the audit.
    """
    names = ["conv_id", "seq", "step", "edit", "role", "text", "turn", "initial", "fault"]
    marks = ids.select("conv_id").distinct().select("conv_id", *(F.lit(-1 if c == "seq" else None).cast(repaired.schema[c].dataType).alias(c) for c in names[1:]))
    rows = repaired.select(names).unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "seq", "step")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    price = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def ended() -> pa.RecordBatch:
            now["gaps"] = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
            values = {"conv_id": pa.array([now["conv_id"]], kind)} | {c: pa.array([now[c]], pa.int64()) for c in counts}
            return pa.record_batch(values | {"audit": pa.array(["".join(now["audit"])]), "repaired_sha256": pa.array([now["digest"].hexdigest()])})

        for batch in released(batches):
            kind = batch.schema.field("conv_id").type
            done = []
            for conv_id, seq, _, edit, role, text, turn, initial, fault in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if seq < 0:
                    if now:
                        done.append(ended())
                    now = dict.fromkeys(counts, 0) | {"conv_id": conv_id, "audit": [], "digest": hashlib.sha256(), "turns": 0, "last": None, "some": False, "low": None, "high": None}
                    continue
                now["audit"].append(edit)
                now["cost"] += price[edit] + (TRUNCATION if fault == "truncated" and edit != "D" else 0)
                if edit != "D":
                    now["digest"].update((b"\n" if now["some"] else b"") + f"{role}:{text}".encode())
                    now["some"] = True
                if edit == "I":
                    continue
                if fault:
                    now[fault] += 1
                now["illegal"] += now["last"] is not None and now["last"] + initial not in ("su", "ua", "au")
                now["last"] = initial
                if turn is not None and turn != now["high"]:
                    now["low"], now["high"], now["turns"] = turn if now["low"] is None else now["low"], turn, now["turns"] + 1
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if now:
            yield ended()

    conv = ids.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {conv}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")
