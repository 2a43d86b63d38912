import os
import random
import re
import time

from tagloom import apply_edits, decode_tags, last_edits, patch_tags, refused_edits, strip_metadata
from tagloom.streaming.arrivals import append_tags, stream_images
from tests.helpers import EDIT, TAG, by_item, frame, plan
from tests.makers import SAMPLE, block, exif, jpeg, segment
from tests.reader import exif_ranges, first_block, read


def edits(spark, rows):
    return spark.createDataFrame(rows, EDIT)


# --- the edit table ---------------------------------------------------------


def brute_last(rows):
    best = {}
    for item, ifd, tag, seq, value in rows:
        if item is None or tag is None:
            continue
        key = (item, ifd or "ifd0", tag)
        order = (seq, value is None, value or "")
        best[key] = max(best.get(key, order), order)
    return {key: (None if o[1] else o[2]) for key, o in best.items()}


def random_edits(rng, items, n):
    rows = []
    for _ in range(n):
        ifd = rng.choice([None, "ifd0", "ifd1"])
        value = rng.choice([None, "", "a", "b", "12", "ccc dd"])
        rows.append((rng.randrange(items), ifd, rng.choice([270, 271, 274]), rng.randrange(4), value))
    return rows


def test_last_edit_wins(spark):
    rows = random_edits(random.Random(1), 20, 800) + [(None, None, 271, 1, "x"), (1, None, None, 1, "x")]
    found = {(r[0], r[1], r[2]): r[3] for r in last_edits(edits(spark, rows)).collect()}
    assert found == brute_last(rows)


def test_directory_of_the_standard(spark):
    df = spark.createDataFrame(
        [(1, 0x9003, 1, "a"), (1, 2, 1, "b"), (1, 271, 1, "c")],
        "item_id bigint, tag int, seq bigint, value string",
    )
    assert {r.ifd for r in last_edits(df).collect()} == {"exif", "gps", "ifd0"}


def canonical(value, code):
    """Count and text of a value that is written and read again; None if it does not suit."""
    if code == 2:
        return len(value.encode()) + 1, value.rstrip("\0")
    if code == 7:
        return (len(value) // 2, value.upper()) if re.fullmatch("([0-9A-Fa-f]{2})*", value) else None
    if code not in RANGES:
        return None
    low, high = RANGES[code]
    shape = "-?[0-9]+/-?[0-9]+" if code in (5, 10) else "-?[0-9]+"
    parts = value.split(" ")
    if not all(re.fullmatch(shape, p) for p in parts):
        return None
    numbers = [[int(n) for n in p.split("/")] for p in parts]
    if not all(low <= n <= high for pair in numbers for n in pair):
        return None
    return len(parts), " ".join("/".join(map(str, pair)) for pair in numbers)


RANGES = {
    1: (0, 255), 3: (0, 65535), 4: (0, 2**32 - 1), 5: (0, 2**32 - 1), 6: (-128, 127), 8: (-32768, 32767),
    9: (-(2**31), 2**31 - 1), 10: (-(2**31), 2**31 - 1), 13: (0, 2**32 - 1),
}


def brute_reasons(tags, rows):
    """Why each refused edit is refused."""
    types, out = {}, {}
    for item, ifd, tag, code, _, _ in tags:
        types.setdefault((item, ifd, tag), set()).add(code)
    for key, value in brute_last(rows).items():
        _, ifd, tag = key
        codes = types.get(key) or {3 if (ifd, tag) == ("ifd0", 274) else 2}
        if ifd not in ("ifd0", "exif", "gps", "interop", "ifd1") or not 0 <= tag <= 65535:
            out[key] = "no such tag"
        elif (ifd, tag) in [("ifd0", 0x8769), ("ifd0", 0x8825), ("exif", 0xA005)]:
            out[key] = "points to a directory"
        elif value is not None and not all(canonical(value, code) for code in codes):
            out[key] = "value does not suit the type"
    return out


def brute_apply(tags, rows):
    refused = brute_reasons(tags, rows)
    last = {k: v for k, v in brute_last(rows).items() if k not in refused}
    out, present = [], set()
    for item, ifd, tag, code, count, value in tags:
        key = (item, ifd, tag)
        present.add(key)
        if key not in last:
            out.append((*key, code, count, value))
        elif last[key] is not None:
            out.append((*key, code, *canonical(last[key], code)))
    for key, value in last.items():
        if value is not None and key not in present:
            code = 3 if key[1:] == ("ifd0", 274) else 2
            out.append((*key, code, *canonical(value, code)))
    return sorted(out, key=repr)


def random_tags(rng, items, n):
    return [
        (rng.randrange(items), rng.choice(["ifd0", "ifd1"]), rng.choice([270, 271, 272, 274]),
         rng.choice([2, 3]), 1, rng.choice(["1", "old", None]))
        for _ in range(n)
    ]


def both_ways(check):
    """With the edits broadcast, and with none small enough for it."""
    check()
    check(broadcast_bytes=0)


def test_apply_edits(spark):
    rng = random.Random(2)
    # Duplicate rows of a tag are kept; one image has a third of all rows.
    tags = random_tags(rng, 30, 200) + [(3, "ifd0", 271, 2, 4, "hot")] * 100
    rows = random_edits(rng, 40, 300)
    rows += [(1, "nowhere", 271, 1, "a"), (1, None, 70000, 1, "a"), (2, None, 0x8769, 1, None), (99, "exif", 0xA005, 1, "8")]
    frame_of_tags = spark.createDataFrame(tags, TAG)

    def check(**limit):
        done = apply_edits(frame_of_tags, edits(spark, rows), **limit)
        text = plan(done)
        assert ("BroadcastHashJoin" in text) == (not limit)
        # Beyond the broadcast tags and edits meet in one exchange.
        assert text.count(") Exchange\n") == (1 if limit else 0)
        assert done.columns == [c.split()[0] for c in TAG.split(", ")]
        assert sorted((tuple(r) for r in done.collect()), key=repr) == brute_apply(tags, rows)
        refused = refused_edits(frame_of_tags, edits(spark, rows), **limit).collect()
        assert {tuple(r)[:3]: r.reason for r in refused} == brute_reasons(tags, rows)
        assert len(refused) == len(brute_reasons(tags, rows)) > 20

    both_ways(check)


def test_apply_edits_twice_and_never(spark):
    rng = random.Random(3)
    tags = spark.createDataFrame(random_tags(rng, 10, 100), TAG)
    change = edits(spark, random_edits(rng, 12, 60))
    once = apply_edits(tags, change)
    assert by_item(apply_edits(once, change)) == by_item(once)
    assert by_item(apply_edits(tags, edits(spark, []))) == by_item(tags)


def test_apply_edits_plan(spark, tmp_path):
    path = str(tmp_path / "tags")
    spark.createDataFrame([(1, "ifd0", 271, 2, 4, "abc")], TAG).write.parquet(path)
    done = apply_edits(spark.read.parquet(path), edits(spark, [(1, None, 271, 1, "x")] * 5))
    assert ") Exchange" not in plan(done)  # the tags do not move


# --- stripping --------------------------------------------------------------


def test_strip(spark):
    small = block("<", {"ifd0": [(0x010F, 2, b"Maker\0")]})
    decoy = segment(0xFE, b"Exif\0\0" + small)
    other = segment(0xE0, b"JFIF\0")
    pairs = [
        (jpeg(exif(small)), jpeg()),
        (jpeg(other, exif(small), decoy), jpeg(other, decoy)),
        (jpeg(exif(small), other, exif(small), exif(block(">", SAMPLE))), jpeg(other)),
        (jpeg(decoy), jpeg(decoy)),
        (jpeg(*[decoy] * 200, exif(small)), jpeg(*[decoy] * 200)),
        (b"", b""),
        (None, None),
        (b"not an image", b"not an image"),
        (jpeg(other, exif(small))[:40], jpeg(other)[: 2 + len(other)]),
    ]
    once = strip_metadata(frame(spark, [before for before, _ in pairs]))
    found = {r.item_id: r.content for r in once.collect()}
    for i, (_, after) in enumerate(pairs):
        assert (found[i] if after is None else bytes(found[i])) == after, i
    twice = {r.item_id: r.content for r in strip_metadata(once).collect()}
    assert twice == found
    assert decode_tags(once).count() == 0


# --- patching ---------------------------------------------------------------


def patch(spark, files, rows, **limit):
    done = patch_tags(frame(spark, files), edits(spark, rows), **limit).collect()
    return {
        r.item_id: (None if r.content is None else bytes(r.content), sorted(map(tuple, r.rejected), key=repr))
        for r in done
    }


def test_patch_by_hand(spark):
    def two(make, orientation):
        return {"ifd0": [(0x010F, 2, make), (0x0112, 3, [orientation])]}

    rows, files, wanted = [], [], []
    for order in "<>":
        before = jpeg(exif(block(order, two(b"Maker 1\0", 6))))
        i = len(files)
        files += [before] * 4
        # Same length: the bytes are those of a file written with the new value.
        rows += [(i, None, 0x010F, 1, "Other 2"), (i, None, 0x0112, 1, "8")]
        wanted.append((jpeg(exif(block(order, two(b"Other 2\0", 8)))), []))
        # Shorter, but still apart from the entry: zeros follow in the slot.
        rows += [(i + 1, None, 0x010F, 1, "Other")]
        longer = block(order, two(b"Other\0\0\0", 6))
        count_at = 8 + 2 + 4
        count = b"\x06\0\0\0" if order == "<" else b"\0\0\0\x06"
        wanted.append((jpeg(exif(longer[:count_at] + count + longer[count_at + 4 :])), []))
        # Short enough to lie in the entry: the old slot becomes zeros.
        rows += [(i + 2, None, 0x010F, 1, "abc")]
        inline = bytearray(longer)
        inline[count_at : count_at + 8] = (b"\x04\0\0\0" if order == "<" else b"\0\0\0\x04") + b"abc\0"
        inline[-8:] = bytes(8)
        wanted.append((jpeg(exif(bytes(inline))), []))
        # One character too long.
        rows += [(i + 3, None, 0x010F, 1, "12345678")]
        wanted.append((before, [("ifd0", 0x010F, "longer than its slot")]))
    found = patch(spark, files, rows)
    for i, want in enumerate(wanted):
        assert found[i] == want, i


def test_patch_rejects(spark):
    data = jpeg(exif(block("<", SAMPLE)))
    shared = bytearray(block("<", {"ifd0": [(282, 5, [(72, 1)]), (283, 5, [(72, 1)])]}))
    shared[10 + 12 + 8 : 10 + 12 + 12] = shared[10 + 8 : 10 + 12]
    far = bytearray(block("<", {"ifd0": [(0x010F, 2, b"Maker\0")]}))
    far[18:22] = b"\xf0\xff\xff\xff"
    files = [data, jpeg(), None, jpeg(exif(bytes(shared))), jpeg(exif(bytes(far))), data]
    rows = [
        (0, "ifd0", 0x8769, 1, "8"),
        (0, "ifd0", 0x0112, 1, "six"),
        (0, "ifd0", 0x0112, 1, "65536"),
        (0, "ifd0", 0x0111, 1, "5"),
        (0, "ifd0", 0x011A, 1, "72"),
        (0, "exif", 0x0A04, 1, "1.5"),
        (0, "exif", 0x9101, 1, "zz"),
        (0, "ifd0", 70000, 1, "a"),
        (0, "ifd0", -1, 1, "a"),
        (0, "nowhere", 271, 1, "a"),
        (1, "ifd0", 271, 1, "a"),
        (2, "ifd0", 271, 1, "a"),
        (3, "ifd0", 282, 1, "300/1"),
        (4, "ifd0", 271, 1, "a"),
        (9, "ifd0", 271, 1, "a"),
    ]
    found = patch(spark, files, rows)
    assert sorted(found) == [0, 1, 2, 3, 4, 5]
    assert {i: found[i][0] for i in found} == dict(enumerate(files))
    bad = "value does not suit the type"
    done = patch_tags(frame(spark, files), edits(spark, rows)).where("size(rejected) > 0")
    reasons = {
        (r.item_id, x.ifd, x.tag): x.reason for r in done.collect() for x in r.rejected
    }
    assert reasons == {
        (0, "ifd0", 0x8769): "points to a directory",
        (0, "ifd0", 0x0112): bad,
        (0, "ifd0", 0x0111): "no such tag",
        (0, "ifd0", 0x011A): bad,
        (0, "exif", 0x0A04): bad,
        (0, "exif", 0x9101): bad,
        (0, None, None): "no such tag",
        (1, "ifd0", 271): "no Exif block",
        (2, "ifd0", 271): "no Exif block",
        (3, "ifd0", 282): "bytes shared with another entry",
        (4, "ifd0", 271): "slot outside the block",
    }


VALUES = {
    1: ["7", "1 2 3 4", "255 0", "256"],
    2: ["", "a", "abc", "abcd", "N", "2021:01:01 00:00:00", "é", "a value too long for any"],
    3: ["1", "65535", "1 2", "1 2 3", "-1"],
    4: ["1", "4294967295"],
    5: ["1/2", "0/0", "1/2 3/4 5/6", "4294967295/1", "-1/2"],
    6: ["-128", "1 -1", "127 0 5", "-129"],
    7: ["", "00FF", "01020304", "0102030405"],
    8: ["-32768", "1 2"],
    9: ["-2147483648", "1 2", "1 2 3"],
    10: ["-1/-2", "5/3"],
    11: [],
    12: [],
    13: ["8"],
}


def test_patch_then_decode_is_decode_then_edit(spark):
    """For the edits that are done; and no byte outside the block changes."""
    rng = random.Random(5)
    files, rows = [], []
    for i in range(120):
        order = "<>"[i % 2]
        data = jpeg(segment(0xE0, b"JFIF\0"), exif(block(order, SAMPLE)))
        files.append(data)
        for ifd, tag, code, _, _ in rng.sample(read(data), rng.randint(1, 12)):
            if rng.random() < 0.35 or not VALUES[code]:
                rows.append((i, ifd, tag, 1, None))
            else:
                rows.append((i, ifd, tag, 1, rng.choice(VALUES[code])))

    def check(**limit):
        found = patch(spark, files, rows, **limit)
        refused = {(i, ifd, tag) for i in found for ifd, tag, _ in found[i][1]}
        accepted = [r for r in rows if r[:3] not in refused]
        assert len(accepted) > 200 and len(refused) > 50
        for i, before in enumerate(files):
            after = found[i][0]
            at, size = exif_ranges(before)[0]
            assert len(after) == len(before)
            assert after[: at + 10] == before[: at + 10]
            assert after[at + size :] == before[at + size :]
        tags = [(i, *row) for i, data in enumerate(files) for row in read(data)]
        wanted = edited(accepted, tags)
        got = sorted(
            ((i, ifd, t, c, n, v) for i in found for ifd, t, c, n, v in read(found[i][0])), key=repr
        )
        assert got == wanted

    both_ways(check)


ODD_VALUES = ["08", "+8", "-0", "0a0b", "abc", "six", "", "70000", "1/2", "007/08", "x\0\0", "1 02 3", " 1", "1  2", "\xe9"]


def test_both_editors_agree(spark):
    """decode(patch(images)) is apply(decode(images)), for the edits that patch accepts; and what
    apply refuses patch refuses, too."""
    rng = random.Random(6)
    files, rows = [], []
    for i in range(150):
        files.append(jpeg(exif(block("<>"[i % 2], SAMPLE))))
        for ifd, tag, code, _, _ in rng.sample(read(files[-1]), 8):
            rows.append((i, ifd, tag, 1, rng.choice([None, *ODD_VALUES, *VALUES[code]])))
    images, change = frame(spark, files), edits(spark, rows)
    patched = patch_tags(images, change)
    refused = {(r.item_id, x.ifd, x.tag) for r in patched.collect() for x in r.rejected}
    accepted = [r for r in rows if r[:3] not in refused]
    assert len(accepted) > 200 and len(refused) > 200
    tags = decode_tags(images)

    def values(df):  # NaN apart, floats are text here
        return sorted((tuple(r) for r in df.collect()), key=repr)

    want = values(decode_tags(patched))
    assert values(apply_edits(tags, edits(spark, accepted))) == want
    assert values(apply_edits(tags, edits(spark, accepted), broadcast_bytes=0)) == want
    by_apply = {tuple(r)[:3] for r in refused_edits(tags, change).collect()}
    assert by_apply <= refused and len(by_apply) > 100
    pointers = edits(spark, [(0, "ifd0", 0x8769, 1, None), (0, "ifd0", 0x8825, 1, "8")])
    assert values(apply_edits(tags, pointers)) == values(tags)


def edited(accepted, tags):
    """The tags with the accepted edits done, in plain Python."""
    last = {r[:3]: r[4] for r in accepted}
    out = []
    for item, ifd, tag, code, count, value in tags:
        key = (item, ifd, tag)
        if key not in last:
            out.append((*key, code, count, value))
        elif last[key] is not None:
            new = last[key]
            n = len(new.encode()) + 1 if code == 2 else len(new) // 2 if code == 7 else len(new.split())
            out.append((*key, code, n, new))
    return sorted(out, key=repr)


def test_patch_of_damaged_files(spark):
    """Directories and values may overlap or be cut off: an edit that is done
    changes its own tag only, and one that is not leaves no trace."""
    rng = random.Random(11)
    files, rows = [], []
    for i in range(400):
        data = bytearray(jpeg(exif(block("<>"[i % 2], SAMPLE)), picture=b"p"))
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(20, 700)
            data[at % len(data)] = rng.choice([0, 1, 4, 12, 255, rng.randrange(256)])
        files.append(bytes(data[: rng.randint(300, len(data))] if i % 4 == 0 else data))
        present = sorted({row[:3] for row in read(files[-1])})
        for ifd, tag, code in rng.sample(present, min(len(present), 6)):
            value = rng.choice([None, *VALUES.get(code, [])])
            rows.append((i, ifd, tag, 1, value))
    rows = list({r[:3]: r for r in rows}.values())
    found = patch(spark, files, rows)
    refused = {(i, ifd, tag) for i in found for ifd, tag, _ in found[i][1]}
    accepted = [r for r in rows if r[:3] not in refused]
    assert len(accepted) > 400 and len(refused) > 400
    tags = [(i, *row) for i, data in enumerate(files) for row in read(data)]
    got = sorted(((i, *row) for i in found for row in read(found[i][0])), key=repr)
    assert got == edited(accepted, tags)


def test_removed_bytes_are_gone(spark):
    data = jpeg(exif(block(">", {"ifd0": [(0x010F, 2, b"Secret maker\0"), (0x0112, 3, [6])]})))
    found = patch(spark, [data], [(0, None, 0x010F, 1, None)])
    assert found[0][1] == []
    assert b"Secret" not in first_block(found[0][0])
    assert read(found[0][0]) == [("ifd0", 0x0112, 3, 1, "6")]


def test_hot_image(spark):
    """One image with nearly all edits, most of them for tags it cannot have."""
    data = jpeg(exif(block("<", SAMPLE)))
    hot = spark.range(30000).selectExpr(
        "0L AS item_id", "'ifd0' AS ifd", "CAST(id % 3000 + 40000 AS INT) AS tag", "id AS seq",
        "'v' AS value",
    )
    rows = edits(spark, [(0, "ifd0", 0x010F, 1, "New"), (1, "ifd0", 0x010F, 1, "New")])
    done = patch_tags(frame(spark, [data, data]), hot.unionByName(rows)).collect()
    by = {r.item_id: r for r in done}
    assert len(by[0].rejected) == 3000 and by[1].rejected == []
    for i in (0, 1):
        assert ("ifd0", 0x010F, 2, 4, "New") in read(bytes(by[i].content))


def test_patch_plan(spark, tmp_path):
    path = str(tmp_path / "images")
    data = jpeg(exif(block("<", SAMPLE)))
    frame(spark, [data, data]).selectExpr("*", "1 AS other").write.parquet(path)
    done = patch_tags(spark.read.parquet(path), edits(spark, [(0, None, 271, 1, "x")]))
    text = plan(done.where("size(rejected) > 0"))
    assert "BroadcastHashJoin LeftOuter BuildRight" in text
    assert "struct<item_id:bigint,content:binary>" in text
    # The images do not move, and their segments are walked once.
    parts = text.split("\n\n")
    assert not any(") Exchange" in p.split("\n")[0] and "content" in p for p in parts)
    assert text.count("= FFD8)") == 1
    assert {r.item_id: r.rejected for r in done.collect()} == {0: [], 1: []}


# --- files and streams ------------------------------------------------------


def test_stream_of_files(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def run():
        query = append_tags(stream_images(spark, folder, "*.jpg"), out, state, ["Make"])
        assert query.awaitTermination(90)
        return sorted(r.value for r in spark.read.parquet(out).collect())

    def add(name):
        data = jpeg(exif(block("<", {"ifd0": [(0x010F, 2, name.encode() + b"\0")]})))
        (tmp_path / "in" / f"{name}.jpg").write_bytes(data)

    add("one")
    assert run() == ["one"]
    add("two")
    assert run() == ["one", "two"]
    # Copied pictures keep their old times.
    for days in (30, 3650):
        add(f"old{days}")
        then = time.time() - days * 86400
        os.utime(tmp_path / "in" / f"old{days}.jpg", (then, then))
        assert f"old{days}" in run()
    assert len(run()) == 4
