"""Walks against os.walk, and image sizes of all formats."""

from __future__ import annotations

import os
import random
import struct
import zlib

import pytest

from shelfspark.sources import io, walk
from shelfspark.sources.image_headers import image_size


def made_tree(root):
    rng = random.Random(3)
    for i in range(150):
        parts = [rng.choice(["a", "b", ".h", "_u", "ü x"]) for _ in range(rng.randrange(9))]
        (root / "/".join(parts)).mkdir(parents=True, exist_ok=True)
        (root / "/".join([*parts, f"{rng.choice(['', '.', '_'])}f{i}.txt"])).write_bytes(b"x" * i)
    (root / "a").mkdir(exist_ok=True)
    (root / "link").symlink_to(root / "a")
    (root / "a/file-link.txt").symlink_to(root / "nowhere")
    (root / "empty").mkdir()
    (root / "own.db").write_bytes(b"1")
    (root / "a/own.db.tmp").write_bytes(b"1")


def test_walk_equals_os_walk(spark, tmp_path):
    made_tree(tmp_path)
    want = {}
    for folder, dirs, names in os.walk(tmp_path):
        rel = os.path.relpath(folder, tmp_path).replace(".", "", 1) if folder == str(tmp_path) else os.path.relpath(folder, tmp_path)
        depth = len(rel.split("/")) if rel else 0
        if depth > 5:
            dirs.clear()
            continue
        for n in names:
            if not os.path.islink(os.path.join(folder, n)):
                s = os.stat(os.path.join(folder, n))
                want[os.path.join(rel, n)] = (s.st_size, s.st_mtime_ns // 10**6, s.st_ctime_ns // 10**6)
    got = {r.rel_path: (r.size_bytes, r.mtime, r.ctime) for r in io.scan_corpus(spark, str(tmp_path)).collect()}
    assert got == want and any("/.h/" in p for p in got) and max(p.count("/") for p in got) == 5
    assert {r.rel_path for r in io.scan_corpus(spark, f"file://{tmp_path}", skip=r"^own\.db").collect()} == {p for p in want if "own.db" not in p}
    shallow = {r.rel_path for r in walk.walk(spark, str(tmp_path), max_depth=0).collect()}
    assert shallow == {n for n in os.listdir(tmp_path) if not os.path.islink(tmp_path / n)}
    assert io.scan_corpus(spark, str(tmp_path / "nowhere")).collect() == []


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0) + zlib.compress(b"x")


def jpeg(w, h, exif=b"", fill=0):
    app = b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif if exif else b""
    return b"\xff\xd8" + app + b"\xff\xe2" + struct.pack(">H", fill + 2) + b"\0" * fill + b"\xff\xff\xc2" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\1\x11\0"


def exif(order, orientation):
    o = "<" if order == b"II" else ">"
    return b"Exif\0\0" + order + struct.pack(o + "HIHHHIHH", 42, 8, 2, 0x0100, 3, 1, 5, 0) + struct.pack(o + "HHIHH", 0x0112, 3, 1, orientation, 0)


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def heif(sizes):
    props = b"".join(box(b"ispe", b"\0\0\0\0" + struct.pack(">II", *s)) for s in sizes)
    return box(b"ftyp", b"avif\0\0\0\0") + box(b"free", b"\0" * 9000) + box(b"meta", b"\0\0\0\0" + box(b"hdlr", b"x" * 20) + box(b"iprp", box(b"ipco", props)))


def tiff(order, w, h, at=8):
    o = "<" if order == b"II" else ">"
    return order + struct.pack(o + "HI", 42, at) + b"\0" * (at - 8) + struct.pack(o + "HHHIII", 2, 256, 4, 1, w, 0)[:14] + struct.pack(o + "HHIHH", 257, 3, 1, h, 0)


IMAGES = {
    "a.png": (png(70000, 3), (70000, 3)), "b.gif": (b"GIF89a" + struct.pack("<HH", 9, 8), (9, 8)), "c.bmp": (b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 5, -6), (5, 6)), "c2.bmp": (b"BM" + b"\0" * 12 + struct.pack("<IHH", 12, 5, 7), (5, 7)),
    "d.jpg": (jpeg(640, 480), (640, 480)), "d2.jpeg": (jpeg(640, 480, exif(b"II", 6), 60_000), (480, 640)), "d3.jpg": (jpeg(640, 480, exif(b"MM", 1)), (640, 480)), "d4.jpg": (jpeg(640, 480, exif(b"MM", 8)), (480, 640)),
    "e.webp": (b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0" + b"\0" * 4 + (399).to_bytes(3, "little") + (299).to_bytes(3, "little"), (400, 300)), "e2.webp": (b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + (99 | 49 << 14).to_bytes(4, "little") + b"\0" * 5, (100, 50)),
    "e3.webp": (b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 176, 144), (176, 144)), "f.tif": (tiff(b"II", 33, 44), (33, 44)), "f2.tiff": (tiff(b"MM", 33, 44, 20_000), (33, 44)),
    "g.ico": (struct.pack("<HHH", 0, 1, 2) + bytes([16, 16]) + b"\0" * 14 + bytes([0, 0]) + b"\0" * 14, (256, 256)), "h.avif": (heif([(64, 64), (512, 300), (64, 64)]), (512, 300)),
    "bad.png": (b"no image", (None, None)), "cut.jpg": (jpeg(640, 480)[:9], (None, None)), "empty.gif": (b"", (None, None)), "zero.png": (png(0, 5), (None, None)), "half.bmp": (b"BM\0", (None, None)), "loop.tif": (b"II*\0\xff\xff\xff\xff", (None, None)),
}


def test_image_sizes(spark, tmp_path):
    for name, (body, _) in IMAGES.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "x.txt").write_text("no")
    got = {r.origin.rsplit("/", 1)[-1]: (r.width, r.height) for r in io.image_dimensions(spark, str(tmp_path)).collect()}
    assert got == {name: size for name, (_, size) in IMAGES.items()}


@pytest.mark.parametrize("name", IMAGES)
def test_headers_that_end_anywhere(name):
    body = IMAGES[name][0][:600]
    for n in range(0, len(body), 7):
        image_size(lambda at, k, n=n: body[:n][at : at + k])


def test_only_headers_are_read():
    for name in ("a.png", "d2.jpeg", "h.avif", "f2.tiff"):
        body, seen = IMAGES[name][0] + b"\0" * 1_000_000, []
        image_size(lambda at, k, body=body, seen=seen: seen.append(min(k, len(body))) or body[at : at + k])
        assert sum(seen) < 1000


def test_text_heads(spark, tmp_path):
    bodies = {"a.txt": "é" * 3000, "b.txt": "", "c.txt": "\U0001f600" * 1200 + "z", "d.txt": "line\r\nnext\0"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body.encode())
    (tmp_path / "e.txt").write_bytes(b"ok\xff\xfe")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in io.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {n: b[:1000] for n, b in bodies.items()} | {"e.txt": "ok��"}
