from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfspark.llm import jaccard_join, packing, quality_rules, textscan, token_file, warc

from .test_lines_and_leaks import groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
PATH = public_tokenizers.path("word_bpe_49k.json")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("n,percent,max_region", [(3, 90, 2000), (5, 80, 2000), (2, 60, 2000), (3, 70, 2), (2, 50, 3)])
@pytest.mark.parametrize("which", ["made_docs", "edge_docs"])
def test_jaccard_groups_match_brute_force(request, which, n, percent, max_region):
    docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text").collect()
    sets = [(r.doc_id, shingles(r.text, n)) for r in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)]
    of = groups(links, {a for a, _ in sets if a is not None})
    got = jaccard_join.jaccard_join(docs, jaccard_join.JoinSpec(n, percent, max_region, sample_every=2, frequent=2)).collect()
    key = lambda t: tuple(-1 if v is None else v for v in t)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(((a, len(x), of.get(a)) for a, x in sets), key=key)


def test_large_regions_are_divided_by_pivots(spark):
    """Chains of near copies: more members than max_region, some far apart."""
    base = [f"w{i}" for i in range(80)]
    rows, at = [], 0
    for i in range(90):
        if i % 30 == 0:
            base = [f"v{i}x{k}" for k in range(80)]
        base[(i * 7) % 80] = f"e{i}"
        rows.append((i, " ".join(base)))
    sets = [(i, shingles(t, 2)) for i, t in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if 100 * len(x & y) >= 90 * len(x | y)]
    of = groups(links, range(90))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for max_region in (4, 12, 1000):
        got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(docs, jaccard_join.JoinSpec(2, 90, max_region, sample_every=1, frequent=3)).collect()}
        assert got == of


def test_linked_sets_share_a_region():
    rng = np.random.default_rng(6)
    for percent in (50, 80, 90):
        for _ in range(200):
            size = int(rng.integers(1, 400))
            x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            y = np.unique(np.concatenate([rng.choice(x, max(1, int(len(x) * rng.uniform(percent / 100, 1))), replace=False), rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(x) // 10))).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both):
                for share in (0, 0.1, 0.7, 0.95, 1):
                    often = np.sort(rng.choice(x, int(share * len(x)), replace=False))
                    assert len(np.intersect1d(jaccard_join.region_keys(x, percent, often), jaccard_join.region_keys(y, percent, often)))


def test_words_match_the_pattern():
    texts = ["", " a\tb ", "x\x0by\x0cz\x1fq", "naïve  日本   ok", None, "a" * 300, "\n", "B\r\nC"]
    for lower in (True, False):
        words = textscan.scan(pa.array(texts), lower)
        want = [WORD.findall((t or "").translate(LOWER) if lower else t or "") for t in texts]
        got = [words.text(i).decode() for i in range(len(words))]
        assert [got[a:b] for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)] == want
        h = words.hashes()
        assert len({*h.tolist()}) == len({*got})


def library_ids(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = ["It's <|endoftext|> don't<|startoftext|>", "éà  x y", "İSTANBUL ΣΑΣ ﬁ", "12 34.5, $%&", "á́ ́x", "👍🏽 ok"]


@pytest.mark.parametrize("which", ["made_docs", "edge_docs", "odd"])
def test_token_files_round_trip(request, spark, which):
    docs = spark.createDataFrame([*enumerate(ODD)], "doc_id long, text string") if which == "odd" else request.getfixturevalue(which)
    folder, index = token_file.write_token_files(docs, PATH, end_id=1, length=64)
    got = sorted(token_file.read_token_files(folder, index).collect(), key=lambda r: r.start)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or ""))
    start = 0
    for r, g, ids in zip(rows, got, library_ids([r.text for r in rows]), strict=True):
        ids = [*ids, 1]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    low = index.agg(F.min("file")).first()[0]
    file = token_file.TokenFile(f"{folder}/part-{low:06d}.arrow")
    flat = [i for r, ids in zip(rows, library_ids([r.text for r in rows]), strict=True) for i in [*ids, 1]][: index.where(F.col("file") == low).agg(F.sum("n_tokens")).first()[0]]
    first = file.sequence(0)
    assert first.tolist() == [*flat, *[0] * 64][:64]
    assert not first.flags.owndata
    mask = file.batch(file.file.num_record_batches - 1, "mask")
    assert mask[0] and mask.sum() <= len(mask)


def test_token_files_of_an_empty_table(no_docs):
    folder, index = token_file.write_token_files(no_docs, PATH)
    assert token_file.read_token_files(folder, index).count() == 0


@pytest.mark.parametrize("which", ["made_docs", "edge_docs"])
@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(request, which, capacity):
    docs = request.getfixturevalue(which)
    got = packing.pack_documents(docs, PATH, capacity, end_id=0, with_ids=True).collect()
    rows = docs.select("doc_id", "text").collect()
    want = Counter()
    for r, ids in zip(rows, library_ids([r.text for r in rows]), strict=True):
        ids = [*ids, 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[r.doc_id, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        assert len(r.ids) == r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= capacity
    # best-fit decreasing, piece by piece
    rooms = []
    for n in sorted((r.length for r in got), reverse=True):
        fit = min((x for x in rooms if x >= n), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((capacity if fit is None else fit) - n)
    assert len(sequences) == len(rooms)


def test_packing_an_empty_table(no_docs):
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_quality_counts_match_plain_python(spark, made_docs, edge_docs):
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(["a b c d e f g h " * 4, "x\ny\nx\n \n \nx", "#1 $5 | <b>", " ".join(f"w{i}" for i in range(40)) + "."])], "doc_id long, text string")
    docs = made_docs.unionByName(edge_docs.select("doc_id", "text")).unionByName(more)
    got = quality_rules.quality_rules(docs.withColumn("words", F.lit(1)).withColumn("t", F.lit(2))).collect()

    def want(text):
        t = text or ""
        w = WORD.findall(t)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len({*lines}), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)

    key = lambda t: tuple(-1 if v is None else v for v in t)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(((r.doc_id, *want(r.text)) for r in docs.collect()), key=key)
    assert not any(r.kept and r.base_failed for r in got) and next(r for r in got if r.doc_id == 1003).kept


def test_quality_removes_failing_lines(spark):
    good = "This is a plain sentence that says something of its own about the weather in spring."
    docs = spark.createDataFrame([(1, "\n".join([good, "Home | News | About | Contact", "Another line, quite unlike the first, closes the text and ends well with a full stop."])), (2, "\n".join(["menu", " | ".join(f"Entry{i}" for i in range(60)), good]))], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert got[1].kept and "Home" not in got[1].clean_text and got[1].clean_text.count("\n") == 1
    assert not got[2].kept and not got[2].base_failed


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "<p>é</p>\r\n\r\nx" * 900, "<p>a</p>"]
    pages = spark.createDataFrame([(i * 2, f"http://x/{i}\r\nX: y" if i else None, h, "z") for i, h in enumerate(html)] + [(12, "u", "<p>a</p>", "z"), (None, "u", "<p>q</p>", "z")], "page_id long, url string, html string, payload string")
    for least in (0, 5):
        folder = warc.write_archives(pages, min_revisit_bytes=least)
        back = warc.read_archives(spark, folder, "record_id string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary")
        got = back.collect()
        assert len(got) == 9
        for r in got:
            mine = [(html[int(r.record_id) // 2] or "").encode()] if r.record_id != "null" else [b"<p>q</p>"]
            assert r.payload_bytes == len(mine[0]) and r.payload_digest == base64.b32encode(hashlib.sha1(mine[0]).digest()).decode()
            if r.record_type == "response":
                assert bytes(r.payload) == mine[0] and r.refers_to is None
        revisits = sorted((r.record_id, r.refers_to) for r in got if r.record_type == "revisit")
        assert revisits == [("0", "12"), ("4", "12")] + [("6", "8")] * (least == 0)
        few = warc.read_archives(spark, folder, "record_id string, record_type string").where("record_type = 'revisit' and record_id in ('0', '2')")
        assert [r.record_id for r in few.collect()] == ["0"]
        assert warc.read_archives(spark, folder, "headers map<string,string>").where("headers['WARC-Type'] = 'response'").count() == 9 - len(revisits)
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0)), "record_id string").count() == 0


FOREIGN = [
    ("warcinfo", None, "application/warc-fields", b"software: x\r\nformat: WARC File Format 1.0\r\n"),
    ("request", "urn:a", "application/http; msgtype=request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n"),
    ("response", "urn:b", "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + b"<p>\r\n\r\nbody</p>" * 30000),
    ("metadata", "urn:c", "text/plain", b""),
    ("revisit", "urn:d", "application/http; msgtype=response", b"HTTP/1.1 304 Not Modified\r\n\r\n"),
    ("resource", "urn:e", "text/html", b"plain\r\n\r\nblock"),
]


@pytest.mark.parametrize("packed", [True, False])
def test_archives_of_other_writers(spark, tmp_path, packed):
    import gzip

    out = b""
    for kind, rid, mime, block in FOREIGN:
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\n" + (f"WARC-Record-ID: <{rid}>\r\n" if rid else "") + f"Content-Type: {mime}\r\nContent-Length: {len(block)}\r\n\r\n"
        record = head.encode() + block + b"\r\n\r\n"
        out += gzip.compress(record) if packed else record
    (tmp_path / ("x.warc.gz" if packed else "x.warc")).write_bytes(out)
    (tmp_path / "notes.txt").write_text("not an archive")
    got = warc.read_archives(spark, f"file://{tmp_path}", "record_type string, record_id string, payload binary, payload_bytes long").collect()
    want = [(k, r, None if k == "revisit" else b.partition(b"\r\n\r\n")[2] if m.startswith("application/http") else b) for k, r, m, b in FOREIGN]
    assert [(r.record_type, r.record_id, None if r.payload is None else bytes(r.payload)) for r in got] == want
    assert [r.payload_bytes for r in got] == [None if p is None else len(p) for _, _, p in want]
    assert [r.record_id for r in warc.read_archives(spark, f"file://{tmp_path}", "record_id string, record_type string").where("record_type = 'resource'").collect()] == ["urn:e"]


@pytest.mark.parametrize("how", ["plain", "one member", "members of three", "members with a skip length", "one member with a skip length"])
def test_archives_of_odd_writers(spark, tmp_path, how):
    """Header names in any case, folded values, several records in a member."""
    import gzip

    records = []
    for i, (kind, rid, mime, block) in enumerate(FOREIGN * 3):
        names = ["warc-type", "WARC-RECORD-ID", "content-type", "cOnTeNt-LeNgTh"] if i % 2 else ["WARC-Type", "WARC-Record-ID", "Content-Type", "Content-Length"]
        head = f"WARC/1.0\r\n{names[0]}: {kind}\r\n" + (f"{names[1]}:\r\n <{rid}>\r\n" if rid else "") + f"{names[2]}: {mime.replace('; ', ';{}'.format(chr(13) + chr(10) + chr(9)))}\r\n{names[3]}: {len(block)}\r\n\r\n"
        records.append(head.encode() + block + b"\r\n\r\n")
    packs = [b"".join(records[i : i + 3]) for i in range(0, len(records), 3)]
    out = {
        "plain": b"".join(records), "one member": gzip.compress(b"".join(records)), "members of three": b"".join(map(gzip.compress, packs)),
        "members with a skip length": b"".join(warc.member(p, 1) for p in packs), "one member with a skip length": warc.member(b"".join(records), 1),
    }[how]
    (tmp_path / "x.warc.gz").write_bytes(out)
    want = [(k, r, None if k == "revisit" else b.partition(b"\r\n\r\n")[2] if m.startswith("application/http") else b) for k, r, m, b in FOREIGN * 3]
    got = warc.read_archives(spark, f"file://{tmp_path}", "record_type string, record_id string, payload binary").collect()
    assert [(r.record_type, r.record_id, None if r.payload is None else bytes(r.payload)) for r in got] == want
    few = warc.read_archives(spark, f"file://{tmp_path}", "record_id string, record_type string").where("record_type in ('resource', 'metadata')").collect()
    assert [r.record_id for r in few] == ["urn:c", "urn:e"] * 3


def test_headers_are_read_without_inflating_payloads():
    import io

    body = warc.member(warc.record({"WARC-Type": "response"}, b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 3_000_000), 1)
    seen = []

    class Counting(warc.Member):
        def more(self, limit):
            seen.append(len(out := super().more(limit)))
            return out

    stream = warc.Stream(io.BytesIO(body * 2))
    for _ in range(2):
        plain = warc.next_record(stream)
        member = Counting(stream, plain.size)
        data = member.more(4096)
        fields, at = warc.parse_head(data)
        member.block(data[at:], int(fields["Content-Length"]))
        member.close()
    assert warc.next_record(stream) is None and sum(seen) <= 2 * 4096


VERDICTS = [
    ("This is a sentence that ends.", True), ("This is a sentence that ends.\r", True), ("It ends before a no-break space. ", True), ("Yes indeed.\r", True), ("Yes indeed.\t ", True), ("two words", False),
    ("© 2024 Acme and its owners", False), ("foo© 2024 by the owners of it", False), ("© 2024 Acme, said the page at its end.", True), ("Home | News | About | Contact", False), ("Start · Shop · Hilfe · Kontakt", False),
    ("Latest News Top Stories Weather Sport", False), ("Latest news and top stories about the weather", True), ("No end here but some lower case words", True), ("# # # $ $ %", False), ("la la la la la la la la la la la la", False),
    ("please click here for more of it", False), ("He told me to click here, and I did.", True),
]


def test_line_verdicts(spark):
    frame = spark.createDataFrame([(t,) for t, _ in VERDICTS], "line string")
    got = [not r.fails for r in frame.select(quality_rules.line_fails(F.col("line"), quality_rules.Rules()).alias("fails")).collect()]
    assert got == [w for _, w in VERDICTS]


def test_word_memo_stays_within_its_bytes():
    from shelfspark.llm.tokenization import WordTokenizer

    tok = WordTokenizer(PATH, memo_bytes=4000)
    for k in range(6):
        texts = [" ".join(f"w{k * 40 + i}x" for i in range(60)), "w1x w2x", None]
        flat, at = tok.encode(textscan.scan(pa.array(texts), False))
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library_ids(texts)
        assert len(tok.memo.keys) * 20 <= 4000
