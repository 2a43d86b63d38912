"""A reader in plain Python: the brute-force counterpart of ``decode_tags``."""

import struct

from tests.makers import CODES, SIZES


def exif_ranges(data):
    found, at = [], 2
    if data[:2] != b"\xff\xd8":
        return found
    while True:
        head = data[at : at + 10]
        if len(head) < 4 or head[0] != 0xFF or head[1] in (0xD9, 0xDA):
            return found
        if head[1] == 0xFF:
            at += 1
        elif head[1] == 1 or 0xD0 <= head[1] <= 0xD8:
            at += 2
        else:
            size = struct.unpack(">H", head[2:4])[0]
            if size < 2:
                return found
            if head[1] == 0xE1 and head[4:] == b"Exif\0\0" and size >= 8:
                found.append((at, size + 2))
            at += size + 2


def first_block(data):
    ranges = exif_ranges(data)
    if not ranges:
        return None
    at, size = ranges[0]
    return data[at + 10 : at + size]


def read(data):
    """(ifd, tag, type, count, value) of every entry."""
    block = first_block(data)
    if block is None or block[:2] not in (b"II", b"MM"):
        return []
    order = "<" if block[:2] == b"II" else ">"

    def num(letter, at):
        size = struct.calcsize(letter)
        if at is None or at < 0 or at + size > len(block):
            return None
        return struct.unpack_from(order + letter, block, at)[0]

    def directory(at):
        n = num("H", at) if at else None
        return None if n is None or at + 2 + 12 * n > len(block) else (at, n)

    def entries(d):
        at, n = d
        for k in range(n):
            e = at + 2 + 12 * k
            yield e, num("H", e), num("H", e + 2), num("I", e + 4), num("I", e + 8)

    def target(d, tag):
        if d:
            for _, t, code, count, field in entries(d):
                if t == tag and code in (4, 13) and count == 1:
                    return field
        return None

    main = directory(num("I", 4))
    dirs = {"ifd0": main}
    dirs["exif"] = directory(target(main, 0x8769))
    dirs["gps"] = directory(target(main, 0x8825))
    dirs["interop"] = directory(target(dirs["exif"], 0xA005))
    dirs["ifd1"] = directory(num("I", main[0] + 2 + 12 * main[1])) if main else None
    rows = []
    for name, d in dirs.items():
        for e, tag, code, count, field in entries(d) if d else ():
            size = count * SIZES[code] if code in SIZES else None
            value = None
            if size is not None:
                at = e + 8 if size <= 4 else field
                if at + size <= len(block):
                    value = text(order, code, count, block[at : at + size])
            rows.append((name, tag, code, count, value))
    return rows


def text(order, code, count, raw):
    if code == 2:
        try:
            return raw.decode("utf-8").rstrip("\0")
        except UnicodeDecodeError:
            return raw.decode("latin-1").rstrip("\0")
    if code == 7:
        return raw.hex().upper()
    if code in (5, 10):
        parts = struct.unpack(f"{order}{2 * count}{'I' if code == 5 else 'i'}", raw)
        return " ".join(f"{parts[i]}/{parts[i + 1]}" for i in range(0, len(parts), 2))
    return " ".join(str(v) for v in struct.unpack(f"{order}{count}{CODES[code]}", raw))
