import hashlib
import random
import struct

import pytest

from tagloom import decode_tags, view_images, view_tags
from tests.helpers import by_item, frame, plan
from tests.makers import SAMPLE, block, exif, jpeg, segment
from tests.reader import read

FLOATS = (11, 12)


def expected(data):
    return sorted(read(data), key=repr)


def same(found, wanted):
    """Equal, with floating-point values compared as numbers of their size."""

    def norm(row):
        ifd, tag, code, count, value = row
        if code in FLOATS and value is not None:
            letter = "f" if code == 11 else "d"
            value = tuple(struct.pack(letter, float(v)) for v in value.split())
        return (ifd, tag, code, count, value)

    return sorted(map(norm, found), key=repr) == sorted(map(norm, wanted), key=repr)


def test_sample_in_both_orders(spark):
    files = [jpeg(exif(block(order, SAMPLE))) for order in "<>"]
    found = by_item(decode_tags(frame(spark, files)))
    for i, data in enumerate(files):
        assert same(found[i], read(data))
    values = {(ifd, tag): value for ifd, tag, _, _, value in found[0]}
    assert values["ifd0", 0x010F] == "Maker"
    assert values["ifd0", 0x0102] == "8 8 8"
    assert values["ifd0", 0x8298] == "one\0two"
    assert values["exif", 0x9204] == "-2/3"
    assert values["exif", 0x0A01] == "-1 2 -128"
    assert values["exif", 0x0A03] == "-2147483648 2147483647"
    assert values["exif", 0x0A04] == "1.5 -0.25 0.0"
    assert values["exif", 0x0A06] == "4000000000"
    assert values["gps", 2] == "33/1 51/1 3000/100"
    assert values["interop", 1] == "R98"
    assert values["ifd1", 0x0103] == "6"


def odd_files():
    """Names and bytes of files that are unusual or broken."""
    small = block("<", {"ifd0": [(0x010F, 2, b"Maker\0"), (0x0112, 3, [6])]})
    big = block(">", {"ifd0": [(0x010F, 2, b"Maker\0"), (0x0112, 3, [6])]})
    decoy = segment(0xFE, b"Exif\0\0" + big)
    half_off = segment(0xE2, bytes.fromhex("0" + (b"Exif\0\0" + big).hex() + "0"))
    count_at = 8
    huge = small[:count_at] + b"\xff\xff" + small[count_at + 2 :]
    none = small[:count_at] + b"\0\0" + small[count_at + 2 :]
    far = small[:18] + struct.pack("<I", 0xFFFFFFF0) + small[22:]
    loop = block(">", {"ifd0": [(0x8769, 4, [8]), (0x8825, 4, [8])]})
    return {
        "first": jpeg(exif(small)),
        "second": jpeg(segment(0xE0, b"JFIF\0"), exif(small)),
        "decoys": jpeg(decoy, half_off, exif(small)),
        "only decoys": jpeg(decoy, half_off),
        "two blocks": jpeg(exif(small), exif(big)),
        "fill bytes": jpeg(b"\xff\xff\xff", exif(big)),
        "bare marker": jpeg(b"\xff\x01", exif(big)),
        "no block": jpeg(segment(0xE0, b"JFIF\0")),
        "other app1": jpeg(segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0<x/>"), exif(big)),
        "empty": b"",
        "null": None,
        "two bytes": b"\xff\xd8",
        "not jpeg": b"\x89PNG" + jpeg(exif(small)),
        "bad length": b"\xff\xd8\xff\xe0\x00\x01" + exif(small),
        "cut in header": jpeg(exif(small))[:8],
        "cut in entries": jpeg(exif(small))[:30],
        "cut in value": jpeg(exif(small))[: 12 + 8 + 2 + 24 + 4 + 3],
        "no byte order": jpeg(exif(b"XX" + small[2:])),
        "short block": jpeg(exif(b"II")),
        "huge count": jpeg(exif(huge)),
        "no entries": jpeg(exif(none)),
        "far value": jpeg(exif(far)),
        "loop": jpeg(exif(loop)),
        "not utf8": jpeg(exif(block("<", {"ifd0": [(0x010F, 2, b"\xff\xfe\xfd\xfc\xfb\0")]}))),
        "unknown type": jpeg(exif(small[:12] + b"\x63\0" + small[14:])),
        "empty text": jpeg(exif(block("<", {"ifd0": [(0x010F, 2, b""), (0x0112, 3, [])]}))),
        "many segments": jpeg(*[segment(0xE2, b"x" * 30)] * 300, exif(small)),
        "many fill bytes": jpeg(b"\xff" * 5000, exif(big)),
        "64 segments": jpeg(*[segment(0xE2, b"")] * 63, exif(small)),
        "65 segments": jpeg(*[segment(0xE2, b"")] * 64, exif(small)),
    }


@pytest.fixture(scope="module")
def odd(spark):
    files = odd_files()
    found = by_item(decode_tags(frame(spark, list(files.values()))))
    return {name: (data, found.get(i, [])) for i, (name, data) in enumerate(files.items())}


@pytest.mark.parametrize("name", odd_files())
def test_odd_file(odd, name):
    data, found = odd[name]
    assert same(found, read(data or b""))


def test_odd_files_mean_what_they_should(odd):
    with_tags = {name for name, (_, found) in odd.items() if found}
    assert {"decoys", "two blocks", "many segments", "many fill bytes", "far value"} <= with_tags
    without = {"only decoys", "empty", "null", "huge count", "no entries", "no byte order"}
    assert not without & with_tags
    assert ("ifd0", 0x010F, 2, 6, None) in odd["far value"][1]
    assert odd["not utf8"][1] == [("ifd0", 0x010F, 2, 6, "\xff\xfe\xfd\xfc\xfb")]


def test_damaged_files(spark):
    """Random damage: the same rows as brute force, and never a failure."""
    rng = random.Random(7)
    files = []
    for i in range(600):
        data = bytearray(jpeg(exif(block("<>"[i % 2], SAMPLE)), picture=b"p"))
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(min(len(data), 330))
            data[at] = rng.choice([0, 1, 4, 12, 255, rng.randrange(256)])
        files.append(bytes(data[: rng.randint(20, len(data))] if i % 3 == 0 else data))
    found = by_item(decode_tags(frame(spark, files)))
    wrong = [i for i, data in enumerate(files) if not same(found.get(i, []), read(data))]
    assert wrong == []
    assert len(found) > 300


NAMES = ["Make", "GPSLatitude", "DateTimeOriginal", "Copyright", ("ifd1", 0x0103), ("exif", 1)]


def test_views_agree(spark):
    twice = block(">", {"ifd0": [(0x010F, 2, b"aaa\0"), (0x010F, 2, b"bbb\0")]})
    bare = block("<", {"ifd0": [(0x0112, 3, [6])]})
    files = [jpeg(exif(b)) for b in (block("<", SAMPLE), twice, bare)] + [jpeg()]
    images = frame(spark, files)
    stored = by_item(view_tags(decode_tags(images), NAMES))
    direct = by_item(view_images(images, NAMES))
    assert stored == direct
    assert stored[0] == [
        ("Maker", "33/1 51/1 3000/100", "2020:02:29 23:59:58", "one\0two", "6", None)
    ]
    assert stored[1][0][0] == "bbb"
    assert stored[2] == [(None,) * 6]
    assert 3 not in stored
    assert view_images(images, NAMES).columns == view_tags(decode_tags(images), NAMES).columns


def test_some_tags(spark):
    images = frame(spark, [jpeg(exif(block("<", SAMPLE)))])
    found = by_item(decode_tags(images, ["Make", ("gps", 2)]))
    assert [row[:2] for row in found[0]] == [("gps", 2), ("ifd0", 0x010F)]
    for names in (["NoSuchTag"], [("nowhere", 1)], []):
        with pytest.raises(ValueError):
            decode_tags(images, names)


def test_plans(spark, tmp_path):
    path = str(tmp_path / "images")
    frame(spark, [jpeg(exif(block("<", SAMPLE)))]).selectExpr("*", "1 AS other").write.parquet(path)
    images = spark.read.parquet(path)
    for df in (decode_tags(images), view_images(images, NAMES)):
        text = plan(df.where("item_id = 0"))
        assert "Exchange" not in text and "Python" not in text
        assert "struct<item_id:bigint,content:binary>" in text
        assert "EqualTo(item_id,0)" in text
    # The segment walk begins once: no filter has repeated the decoding.
    for df in (decode_tags(images).where("tag = 271"), view_images(images, NAMES).where("Make = 'M'")):
        assert plan(df).count("= FFD8)") == 1
    assert plan(view_tags(decode_tags(images), NAMES)).count("Exchange hashpartitioning") <= 1


def overlapping(n, size):
    """A file with n entries that all claim the same bytes, and every pointer at one directory."""
    head = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", n)
    for k in range(n):
        tag, code, count, field = 0x010F + k % 2, 2, size, 8
        if k < 2:
            tag, code, count = (0x8769, 0x8825)[k], 4, 1
        head += struct.pack("<HHII", tag, code, count, field)
    head += struct.pack("<I", 8)
    return jpeg(exif((head + bytes(range(65, 91)) * 3000)[: 65520]))


def test_overlapping_values_come_one_at_a_time(spark):
    """Every entry may be as large as the block: all are read, none is dropped."""
    files = [jpeg(exif(block("<", SAMPLE))), overlapping(300, 60_000)]
    images = frame(spark, files)
    want = [(i, *row) for i, f in enumerate(files) for row in read(f) if row[2] not in FLOATS]
    sized = decode_tags(images).where("type NOT IN (11, 12)").selectExpr("item_id", "ifd", "tag", "type", "count", "length(value) AS n", "md5(value) AS m")
    found = sorted((tuple(r) for r in sized.collect()), key=repr)
    digest = lambda v: None if v is None else hashlib.md5(v.encode()).hexdigest()
    assert found == sorted(((*w[:5], None if w[5] is None else len(w[5]), digest(w[5])) for w in want), key=repr)
    names = ["Make", "Model", ("ifd1", 271)]
    shown = {r.item_id: r for r in view_images(images, names).collect()}
    assert shown == {r.item_id: r for r in view_tags(decode_tags(images), names).collect()}
    assert len(shown[1].Make) > 50_000
