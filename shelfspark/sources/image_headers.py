"""Width and height of images from their headers, by ranged reads."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

#: Bytes from an offset on, fewer at the end of the file.
Read = Callable[[int, int], bytes]
Size = tuple[int, int] | None


def _png(read: Read) -> Size:
    head = read(0, 24)
    return struct.unpack(">II", head[16:24]) if head[12:16] == b"IHDR" and len(head) == 24 else None


def _gif(read: Read) -> Size:
    return struct.unpack("<HH", read(6, 4))


def _bmp(read: Read) -> Size:
    if struct.unpack("<I", read(14, 4))[0] == 12:
        return struct.unpack("<HH", read(18, 4))
    width, height = struct.unpack("<ii", read(18, 8))
    return width, abs(height)  # rows from the top have a negative height


def _orientation(exif: bytes) -> int:
    """Orientation tag of an Exif segment; 1 if there is none."""
    body = exif[6:]
    order = {b"II": "<", b"MM": ">"}.get(body[:2])
    if exif[:6] != b"Exif\0\0" or order is None:
        return 1
    (at,) = struct.unpack(order + "I", body[4:8])
    (n,) = struct.unpack(order + "H", body[at : at + 2])
    for k in range(n):
        entry = body[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
            return struct.unpack(order + "H", entry[8:10])[0]
    return 1


def _jpeg(read: Read) -> Size:
    at, turned = 2, False
    while True:
        mark, kind = read(at, 2)
        if mark != 0xFF:
            return None
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD7:  # padding, and markers without a length
            at += 1 if kind == 0xFF else 2
            continue
        (length,) = struct.unpack(">H", read(at + 2, 2))
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", read(at + 5, 4))
            return (height, width) if turned else (width, height)
        if kind in (0xD9, 0xDA):
            return None
        if kind == 0xE1:
            turned |= _orientation(read(at + 4, length - 2)) in (5, 6, 7, 8)
        at += 2 + length


def _webp(read: Read) -> Size:
    kind, body = read(12, 4), read(20, 10)
    if kind == b"VP8X":
        return 1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little")
    if kind == b"VP8L" and body[0] == 0x2F:
        bits = int.from_bytes(body[1:5], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", body[6:10])
        return width & 0x3FFF, height & 0x3FFF
    return None


def _tiff(read: Read) -> Size:
    order = "<" if read(0, 2) == b"II" else ">"
    (at,) = struct.unpack(order + "I", read(4, 4))
    (n,) = struct.unpack(order + "H", read(at, 2))
    found = {}
    entries = read(at + 2, 12 * n)
    for k in range(n):
        tag, kind = struct.unpack(order + "HH", entries[12 * k : 12 * k + 4])
        if tag in (256, 257):
            found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entries[12 * k + 8 : 12 * k + (10 if kind == 3 else 12)])[0]
    return (found[256], found[257]) if len(found) == 2 else None


def _ico(read: Read) -> Size:
    (n,) = struct.unpack("<H", read(4, 2))
    entries = read(6, 16 * n)
    sizes = [(entries[16 * k] or 256, entries[16 * k + 1] or 256) for k in range(len(entries) // 16)]
    return max(sizes, key=lambda s: s[0] * s[1], default=None)


def _boxes(read: Read, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the contents of the boxes in a range."""
    while at + 8 <= end:
        head = read(at, 16)
        size, first = int.from_bytes(head[:4], "big"), at + 8
        if size == 1:
            size, first = int.from_bytes(head[8:16], "big"), at + 16
        elif size == 0:
            size = end - at
        if size < first - at or len(head) < 8:
            return
        yield head[4:8], first, min(at + size, end)
        at += size


def _heif(read: Read) -> Size:
    """The largest image that the file's properties tell of; tiles of a grid are smaller than the whole."""
    sizes: list[tuple[int, int]] = []
    inside = {b"meta": 4, b"iprp": 0, b"ipco": 0}  # bytes before the boxes that each holds

    def look(at: int, end: int) -> None:
        for kind, lo, hi in _boxes(read, at, end):
            if kind in inside:
                look(lo + inside[kind], hi)
            elif kind == b"ispe":
                sizes.append(struct.unpack(">II", read(lo + 4, 8)))

    look(0, 1 << 40)
    return max(sizes, key=lambda s: s[0] * s[1], default=None)


# What files of each format begin with.
_FORMATS = [
    (b"\x89PNG\r\n\x1a\n", 0, _png), (b"GIF87a", 0, _gif), (b"GIF89a", 0, _gif), (b"BM", 0, _bmp), (b"\xff\xd8\xff", 0, _jpeg), (b"WEBP", 8, _webp), (b"II*\0", 0, _tiff), (b"MM\0*", 0, _tiff), (b"\0\0\1\0", 0, _ico), (b"ftyp", 4, _heif),
]


def image_size(read: Read) -> Size:
    """Width and height as shown; None if the file is of no known format, cut off, or says nonsense."""
    try:
        head = read(0, 16)
        for magic, at, sizes in _FORMATS:
            if head[at : at + len(magic)] == magic:
                size = sizes(read)
                return tuple(size) if size and min(size) > 0 else None
    except (struct.error, ValueError, IndexError):
        pass
    return None
