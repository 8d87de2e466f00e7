from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import decontaminate, line_dedup
from shelfspark.llm.components import components


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def norm(line):
    return re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", line.lower()).strip()


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def line_docs(n=40):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    pool = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 90))) for _ in range(30)]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(pool).split(" ")
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(vocab)
            line = " ".join(w)
            lines.append(rng.choice([line, line.upper() + ".", "  " + line.replace(" ", ", "), "", "--"]))
        docs.append((i * 3, "\n".join(lines)))
    return docs


def expected_lines(docs, min_similarity=0.9):
    """Brute force over all pairs of distinct normalised lines, by edit similarity alone."""
    where = {}
    for d, t in docs:
        for k, line in enumerate(t.split("\n") if t is not None and d is not None else []):
            if norm(line):
                where.setdefault(norm(line), []).append((d, k))
    texts = sorted(where)
    pairs = []
    for i, a in enumerate(texts):
        for j in range(i):
            b, most = texts[j], max(len(a), len(texts[j]))
            if min(len(a), len(b)) >= min_similarity * most - 1e-9 and distance(a, b) <= int((1 - min_similarity) * most + 1e-9):
                pairs.append((i, j))
    of, out = groups(pairs, range(len(texts))), set()
    first = {}
    for i, t in enumerate(texts):
        first[of[i]] = min([first.get(of[i], (1 << 60, 0)), *where[t]])
    for i, t in enumerate(texts):
        out |= {(*p, *first[of[i]]) for p in where[t] if p != first[of[i]]}
    return out, len(pairs)


@pytest.mark.parametrize("few,crowd", [(4, 64), (1, 64), (1, 2)])
def test_duplicate_lines_match_brute_force(spark, few, crowd):
    docs, spec = line_docs(), line_dedup.LineSpec(few=few, crowd=crowd)
    docs += [(500, None), (501, ""), (502, "\n\n--\n"), (None, docs[3][1]), (503, "x " * 70000), (6, docs[2][1])]
    want, links = expected_lines([d for d in docs if d[0] != 503])
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for clash in ("norm", "key", "gone", "gone_id", "rid", "GONE_"):
        frame = frame.withColumn(clash, F.lit("clash"))
    got = {tuple(r) for r in line_dedup.duplicate_lines(frame, spec).collect()}
    assert got == want and links > 3
    cleaned = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame, spec).collect() if r.doc_id != 6}
    for d, t in docs[:40]:
        left = [x for k, x in enumerate(t.split("\n")) if not any(w[:2] == (d, k) for w in want)]
        if d == 6:
            continue
        if not any(w[0] == d for w in want):
            assert cleaned[d] == t
        elif any(map(norm, left)):
            assert cleaned[d] == "\n".join(left)
        else:
            assert d not in cleaned
    assert cleaned[500] is None and cleaned[501] == "" and cleaned[502] == "\n\n--\n" and cleaned[None] == docs[3][1]


@pytest.mark.parametrize("part", [4096, 7])
def test_pairs_that_share_one_crowded_key_alone_are_tried(spark, part):
    """Eighty lines and their near copies have a block in common, which is all that a copy shares with its line."""
    rng = random.Random(41)
    word = lambda n: "".join(rng.choice("bcdfghjklm") for _ in range(n))
    lines, copies = [], []
    for _ in range(80):
        rest = [word(12) for _ in range(5)]
        lines.append("bbbccc dddfff ggghhh " + " ".join(rest))
        copies.append("bbbccc dddfff ggghhh " + " ".join("x" + w[1:-1] + "z" if k % 3 == 0 else w[:6] + "y" + w[7:] for k, w in enumerate(rest)))
    docs = [*enumerate(lines), *enumerate(copies, 1000)]
    want, links = expected_lines(docs)
    got = {tuple(r) for r in line_dedup.duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string"), line_dedup.LineSpec(part=part)).collect()}
    assert got == want and links == 80


def test_unlike_long_lines_end_before_their_texts_are_compared(spark, monkeypatch):
    """Long lines of the same few words share keys and letters; none but near ones come to the comparison of whole texts."""
    rng = random.Random(47)
    words = ["".join(rng.choice("bcdfghlmpu") + rng.choice("aeio") for _ in range(3)) for _ in range(60)]
    pool = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(60)]
    docs = [*enumerate(pool), *((100 + k, x.replace(" ", " q ", 3)) for k, x in enumerate(pool[:20]))]
    raw = line_dedup.lines_of(spark.createDataFrame(docs, "doc_id long, text string"))
    spec = line_dedup.LineSpec()
    lines = line_dedup.materialize(line_dedup.sketched(raw, spec), "lines")
    rids = lines.select("rid")
    pairs = line_dedup.materialize(rids.toDF("a").crossJoin(rids.toDF("b")).where("a > b"), "pairs")
    written = {}

    def materialize(df, kind, f=line_dedup.materialize):
        out = f(df, kind)
        written[kind] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialize", materialize)
    assert line_dedup.alike(pairs, lines, raw, spec).count() == 20
    assert 20 <= written["likely-pairs"] < pairs.count() // 20


def test_thinned_lines_bound_edits(spark):
    rng = random.Random(53)
    rows = []
    for _ in range(150):
        a = "".join(rng.choice(" etaoinsrxyzhd") for _ in range(rng.randint(61, 120)))
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = [rng.choice("etaxyz\u00e9")] * rng.randint(0, 2)
        rows.append((a, "".join(b)))
    rows += [("\u65e5" * 70, "\u65e5" * 70), ("x" * 40, "x" * 40)]
    thin = lambda c: line_dedup.thinned(c, line_dedup.LineSpec())
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", thin("a").alias("x"), thin("b").alias("y")).collect()
    assert sum(r.x is not None and r.y is not None for r in got) > 100
    assert all(distance(r.x, r.y) <= distance(r.a, r.b) for r in got if r.x is not None and r.y is not None)
    assert got[-2].x is None and got[-1].x is None


@pytest.mark.parametrize("passes", [1, 3])
def test_passes_over_keys_leave_the_result(spark, passes):
    docs = line_docs()
    got = {tuple(r) for r in line_dedup.duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string"), line_dedup.LineSpec(passes=passes)).collect()}
    assert got == expected_lines(docs)[0]


def test_letter_counts_bound_edits(spark):
    rng = random.Random(43)
    rows = []
    for k in range(200):
        a = norm("".join(rng.choice(" etaoinxyz\u00e9\u65e5") for _ in range(rng.randint(1, 60)))) or "a"
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = [rng.choice("etaoinxyz\u00e9")] * rng.randint(0, 1)
        rows.append((a, norm("".join(b)) or "b"))
    rows += [("e" * 70000 + "q", "e" * 70001), ("q" * 70000, "e" * 70000)]
    counts = lambda c: line_dedup.letter_counts(c, f"n_{c}")
    frame = spark.createDataFrame(rows, "a string, b string").withColumns({"n_a": F.char_length("a"), "n_b": F.char_length("b")})
    got = frame.select("a", "b", line_dedup.letters_apart(counts("a"), counts("b")).alias("d")).collect()
    assert all(r.d + abs(len(r.a) - len(r.b)) <= 2 * distance(r.a, r.b) for r in got[:200])
    plain = lambda t: [t.count(x) for x in line_dedup.LETTERS] + [sum(x not in line_dedup.LETTERS for x in t)]
    assert all(r.d == sum(abs(p - q) for p, q in zip(plain(r.a), plain(r.b), strict=True)) for r in got[:200])
    assert got[200].d == 0 and got[201].d == 255  # counts end at 255


def test_marks_of_halves_bound_edits(spark):
    rng = random.Random(59)
    rows = []
    for _ in range(300):
        a = norm("".join(rng.choice(" etaoinxyz\u00e9\u65e5") for _ in range(rng.randint(1, 90)))) or "a"
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = [rng.choice("etaoinxyz\u00e9")] * rng.randint(0, 1)
        rows.append((a, norm("".join(b)) or "b"))
    rows += [(a[len(a) // 9 :] + "x" * (len(a) // 9), a) for a, _ in rows[:50]] + [("e" * 70000 + "q", "e" * 70001), ("b" * 60 + "c" * 60, "c" * 60 + "b" * 60)]
    frame = spark.createDataFrame([(2 * k + e, t) for k, r in enumerate(rows) for e, t in enumerate(r)], "id long, norm string").withColumn("size", F.char_length("norm"))
    m = line_dedup.materialize(line_dedup.with_marks(frame), "marks")
    got = {r.id // 2: r.d for r in m.alias("x").join(m.alias("y"), F.expr("x.id % 2 = 0 and y.id = x.id + 1")).select("x.id", line_dedup.marks_apart("x", "y").alias("d")).collect()}
    assert all(got[k] <= 2 * distance(*rows[k]) + 1 for k in range(350)) and sum(got[k] > 0 for k in range(350)) > 200
    assert got[350] == 2 and got[351] == 16  # the halves of the last pair are exchanged: counts of the whole are equal


def test_pairs_of_a_large_group_are_not_written(spark, monkeypatch):
    """Ninety lines that share a block and all letters, most of them too far apart: pairs are tested where they meet."""
    rng = random.Random(61)
    base = ["".join(rng.choice("bcdfghjklm") for _ in range(10)) for _ in range(5)]
    docs = []
    for k in range(90):
        words = [list(w) for w in base]
        for w in words:
            at = rng.randrange(1, 8)
            w[at], w[at + 1] = w[at + 1], w[at]
        docs.append((k, "bbbccc dddfff ggghhh " + " ".join(map("".join, words))))
    written = []

    def materialize(df, kind, f=line_dedup.materialize):
        out = f(df, kind)
        written.append(out.count() if kind in ("line-pairs", "likely-pairs") else 0)
        return out

    monkeypatch.setattr(line_dedup, "materialize", materialize)
    got = {tuple(r) for r in line_dedup.duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string"), line_dedup.LineSpec(few=1)).collect()}
    assert got == expected_lines(docs)[0]
    assert max(written) <= 5 * len(docs)


@pytest.mark.parametrize("part", [1024, 9])
def test_texts_of_crowded_keys_are_dealt_in_passes(spark, part):
    """A hundred lines share a key, a second hundred another; no pass deals more rows with texts than it may."""
    rng = random.Random(67)
    word = lambda: "".join(rng.choice("bcdfghjklm") for _ in range(14))
    texts = [" ".join(word() for _ in range(4)) for _ in range(100)]
    texts += [t[:3] + "xyz" + t[6:] for t in texts]
    keys = [[k % 2 + 1, 3 + k % 5] for k in range(200)]
    rows = [(k, k, own, t, t) for k, (own, t) in enumerate(zip(keys, texts, strict=True))]
    rows = [(k, c, [(x, 100 if x < 3 else 40) for x in own], own, t, thin) for k, c, own, t, thin in rows]
    frame = spark.createDataFrame(rows, "rid long, c long, own array<struct<key:long,n:long>>, keys array<long>, norm string, thin string").withColumns({"size": F.char_length("norm"), "simhash": F.lit(0).cast("long")})
    members = line_dedup.materialize(line_dedup.with_marks(frame), "members")
    edges = line_dedup.alike_by_size(members, 120, line_dedup.LineSpec(crowd=20, part=part))
    got = [(r.a, r.b) for e in edges for r in e.collect()]
    assert sorted(got) == [(100 + k, k) for k in range(100) if k % 2 == (100 + k) % 2]
    dealt = 400 if part == 1024 else 200 * (1 + 2 * -(-100 // part)) + 200 * (1 + 2 * -(-40 // part))
    assert len(edges) == -(-dealt // 120)


def test_simhash_is_the_majority_of_block_hashes(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijkl\u00e9") for _ in range(rng.randint(1, 9)))
    lines = [" ".join(word() for _ in range(n)) for n in (40, 60, 301, 900)] + ["bcd " * 50, "zz " * 70000, ("begin x " * 3 + "bd ef gh ") * 4000]
    block = re.compile(r"[^ ]+(?: (?![aeiou\x80-\U0010ffff])[^ ]+){0,2}")
    votes = [(lambda b: [x for x in b if len(x.encode()) >= 8] or b)(block.findall(norm(t))) for t in lines]
    blocks = sorted({w for v in votes for w in v})
    h = {r.w: r.h & (1 << 64) - 1 for r in spark.createDataFrame([(w,) for w in blocks], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    frame = spark.createDataFrame([(i, 0, t) for i, t in enumerate(lines)], "doc_id long, line_no int, line string")
    got = {r.doc_id: r.simhash & (1 << 64) - 1 for r in line_dedup.sketched(frame).collect()}
    for i, v in enumerate(votes):
        assert got[i] == sum(1 << b for b in range(64) if 2 * sum(h[x] >> b & 1 for x in v) > len(v))


def test_recall_of_one_word_edits_by_length(spark):
    """Lines of the documents table with a word replaced, at an edit similarity of 0.9 or more, come into their line's group."""
    rng = random.Random(37)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text]
    lines = sorted({norm(x) for t in texts for x in t.split("\n")})
    vocab = [w for x in lines for w in x.split(" ") if w]
    docs, bands = [], {}
    for x in (x for x in lines if 9 <= len(x.split(" ")) <= 200):
        w = x.split(" ")
        at = rng.randrange(len(w))
        w[at] = rng.choice(vocab)
        y = " ".join(w)
        most = max(len(x), len(y))
        if x != y and distance(x.split(" ")[at], w[at]) <= int(0.1 * most + 1e-9) and abs(len(x) - len(y)) <= 0.1 * most:
            band = next(b for b in (15, 30, 60, 120, 201) if len(w) < b)
            bands.setdefault(band, []).append(len(docs))
            docs += [x, y]
    got = line_dedup.duplicate_lines(spark.createDataFrame([*enumerate(docs)], "doc_id long, text string"))
    keep = {r.doc_id: r.keep_doc for r in got.collect()}
    share = {b: sum(keep.get(i, i) == keep.get(i + 1, i + 1) for i in own) / len(own) for b, own in bands.items()}
    assert len(share) == 5 and min(share.values()) >= 0.95, share


def near_lines(rng, vocab, n):
    """Line pairs: words replaced, or characters changed, taken out and put in, up to the edit limit."""
    out = []
    for k in range(n):
        a = " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 12) if k % 2 else rng.randint(10, 60)))
        b = list(a)
        if k % 4 == 0:
            w = a.split(" ")
            w[rng.randrange(len(w))] = rng.choice(vocab)
            b = list(" ".join(w))
        else:
            for _ in range(rng.randint(1, max(1, len(a) // (10 if k % 2 else 20)))):
                at = rng.randrange(len(b))
                b[at : at + rng.randint(0, 1)] = [rng.choice("hijk")] * rng.randint(0, 1)
        out += [a, "".join(b)]
    return out


def test_lines_at_the_edit_limit_are_found_whatever_their_simhash(spark):
    rng = random.Random(23)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    docs = [(i, t) for i, t in enumerate(near_lines(rng, vocab, 40)) if norm(t)]
    want, links = expected_lines(docs)
    got = {tuple(r) for r in line_dedup.duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and links > 20


def test_segment_keys_bring_every_short_pair_together(spark):
    rng = random.Random(29)
    rows = []
    for k in range(600):
        a = [rng.choice("abcdefghij ") for _ in range(rng.randint(1, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = [rng.choice("abcdefghij")] * rng.randint(0, 1)
        a, b = norm("".join(a)), norm("".join(b))
        most = max(len(a), len(b))
        if a and b and most <= 60 and distance(a, b) <= int(0.1 * most + 1e-9):
            rows.append((a, b))
    keys = lambda t: line_dedup.segment_keys(t, f"char_length({t})", line_dedup.LineSpec(short=60))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", F.arrays_overlap(keys("a"), keys("b")).alias("met")).collect()
    assert len(rows) > 100 and all(r.met for r in got), [r for r in got if not r.met][:3]


def test_edits_of_line_pairs(spark):
    rng = random.Random(13)
    rows = []
    for _ in range(400):
        a = [rng.choice(["ab", "abc", "b", "cab", "ba"]) for _ in range(rng.randint(1, 7))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = [rng.choice(["ab", "abc", "b"])] * rng.randint(0, 2)
        b = b or ["ab"]
        rows.append((" ".join(a), " ".join(b), rng.randint(0, 8)))
    got = spark.createDataFrame(rows, "t_a string, t_b string, most int").select("*", F.expr(line_dedup.edits_within("most")).alias("ok")).collect()
    assert all(r.ok == (distance(r.t_a, r.t_b) <= r.most) for r in got)


def test_lines_of_an_empty_table(no_docs):
    assert line_dedup.duplicate_lines(no_docs).count() == 0 and line_dedup.dedup_lines(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60) if i % 13] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7), (None, 3)]
    of = groups([p for p in pairs if None not in p], range(200))
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: of[n] for p in pairs if None not in p and p[0] != p[1] for n in p}


def test_smith_waterman_matches_plain_table():
    rng = np.random.default_rng(8)
    for _ in range(40):
        a, b = (rng.integers(1, 6, rng.integers(1, 15)).astype(np.uint64) for _ in range(2))
        h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
                best = max(best, h[i, j])
        got, end_a, end_b = decontaminate.smith_waterman(decontaminate.padded([a, a]), decontaminate.padded([b, np.append(b, b[:1] * 0)]))
        assert (got == best).all() and (best == 0 or h[end_a[0], end_b[0]] == best)


@pytest.mark.parametrize("local", [True, False])
def test_leaks_are_found_and_clean_documents_left_alone(spark, local):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, text(rng.randint(12, 40))) for i in range(12)]
    docs, want = [], {}
    for d in range(120):
        words = text(rng.randint(5, 200))
        if d % 3 == 0:
            item, copy = items[d % 12][0], list(items[d % 12][1])
            if d % 2:
                for _ in range(len(copy) // 6):
                    copy[rng.randrange(len(copy))] = rng.choice(vocab)
            at = rng.randrange(len(words) + 1)
            want[d, item] = (at, at + len(copy), d % 2)
            words[at:at] = copy
        docs.append((d, " ".join(words)))
    docs += [(900, None), (901, ""), (902, "one two"), (None, " ".join(items[0][1]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5)).withColumn("words", F.lit("x"))
    bench = spark.createDataFrame([*((i, " ".join(w).upper()) for i, w in items), (77, None), (78, "a b"), (None, "x y z w")], "item_id long, text string")
    spec = decontaminate.LeakSpec() if local else decontaminate.LeakSpec(max_local_seeds=0, max_local_words=0)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(frame, bench, spec).collect()}
    assert set(got) == set(want)
    for k, (a, z, edited) in want.items():
        assert edited or (got[k].score == 1.0 and (got[k].start_word, got[k].end_word) == (a, z))
    left = {r.doc_id for r in decontaminate.decontaminate(frame, bench, spec).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}


def test_edited_copies_are_found_beside_a_verbatim_one(spark):
    rng = random.Random(31)
    item = [f"w{i}" for i in range(40)]
    edited = [f"other{i}" if i % 5 == 4 else w for i, w in enumerate(item)]
    around = lambda w: " ".join([f"x{rng.randrange(9999)}" for _ in range(20)] + w + [f"y{rng.randrange(9999)}" for _ in range(20)])
    docs = [(i, around(edited)) for i in range(25)] + [(25, around(item)), (26, around([]))]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert set(got) == set(range(26)) and got[25] == 1.0


def test_leaks_of_empty_tables(spark, no_docs):
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert decontaminate.find_leaks(no_docs, bench).count() == 0
    assert decontaminate.find_leaks(spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string"), bench.limit(0)).count() == 0
