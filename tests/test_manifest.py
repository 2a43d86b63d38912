"""Files that are new, changed or gone since the last scan."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tagloom import clear, compare_manifests, decode_tags, headers, left_out, manifest, read_changed, scan_images, store
from tagloom.operators.headers import split_images
from tagloom.sources import stored
from tests.helpers import frame, plan
from tests.makers import SAMPLE, block, exif, jpeg

MANIFEST = "item_id string, length bigint, modificationTime timestamp"


def put(path, data, when):
    path.write_bytes(data)
    os.utime(path, (when, when))


def test_new_changed_and_removed_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    tagged, other = jpeg(exif(block("<", SAMPLE))), jpeg(exif(block(">", SAMPLE)))
    for name in ("same", "longer", "touched", "gone", "emptied"):
        put(folder / f"{name}.jpg", tagged, 1_000_000)
    manifest(scan_images(spark, str(folder), "*.jpg")).write.parquet(str(tmp_path / "before"))
    before = spark.read.parquet(str(tmp_path / "before"))

    put(folder / "longer.jpg", tagged + b"x", 1_000_000)
    put(folder / "touched.jpg", other, 2_000_000)
    put(folder / "new.jpg", tagged, 500)  # an old time does not hide a new file
    put(folder / "emptied.jpg", b"", 3_000_000)
    (folder / "gone.jpg").unlink()
    changes = store(compare_manifests(manifest(scan_images(spark, str(folder), "*.jpg")), before))
    found = {r.item_id.split("/")[-1]: r.change for r in changes.collect()}
    assert found == {
        "same.jpg": "same", "longer.jpg": "changed", "touched.jpg": "changed", "new.jpg": "new",
        "gone.jpg": "removed", "emptied.jpg": "removed",
    }

    parts = list(read_changed(spark, changes, files_per_read=2))
    read = [[r.item_id.split("/")[-1] for r in p.orderBy("modificationTime").collect()] for p in parts]
    assert read == [["new.jpg", "longer.jpg"], ["touched.jpg"]]
    assert decode_tags(parts[1]).count() == decode_tags(scan_images(spark, str(folder), "same.jpg")).count() > 0
    for part, names in zip(parts, read, strict=True):  # the other files are not listed, let alone opened
        assert sorted(path.split("/")[-1] for path in part.inputFiles()) == sorted(names)
    assert list(read_changed(spark, changes.where("change = 'same'"))) == []


def test_the_comparison_reads_no_content(spark, tmp_path):
    put(tmp_path / "a.jpg", jpeg(), 1)
    now = manifest(scan_images(spark, str(tmp_path)))
    text = plan(compare_manifests(now, now))
    assert "content" not in text and text.count(") Exchange") == 1


def test_repeated_and_null_ids_and_empty_manifests(spark):
    def rows(*found):
        return spark.createDataFrame([(i, n, datetime.datetime.fromtimestamp(t) if t is not None else None) for i, n, t in found], MANIFEST)

    def told(now, before):
        return sorted(((r.item_id, r.change, r.length) for r in compare_manifests(now, before).collect()), key=repr)

    now = rows(("a", 1, 5), ("a", 2, 6), ("b", 1, 5), (None, 1, 1), ("c", None, None))
    before = rows(("a", 2, 6), ("b", 3, 1), ("b", 1, 5), (None, 1, 1), (None, 1, 0), ("c", None, None), ("d", 9, 9))
    assert told(now, before) == sorted([("a", "same", 2), ("b", "same", 1), (None, "same", 1), ("c", "same", None), ("d", "removed", 9)], key=repr)
    assert told(rows(), rows()) == [] and told(now.limit(0), before.where("item_id = 'd'")) == [("d", "removed", 9)]
    assert told(before.where("item_id = 'd'"), rows()) == [("d", "new", 9)]


def test_files_that_are_not_put_together(spark):
    split = split_images(frame(spark, [jpeg(), jpeg(), jpeg()]))
    heads = headers(split)
    heads = heads.where("item_id <> 0").unionByName(heads.where("item_id = 2")).unionByName(heads.selectExpr("item_id + 8 AS item_id", "content").limit(1))
    heads = heads.unionByName(heads.limit(1).withColumn("item_id", F.lit(None).cast("bigint")))
    got = left_out(heads, split)
    assert "picture" not in plan(got.select("*")).replace("n_pictures", "")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(0, 0, 1), (2, 2, 1), (8, 1, 0), (None, 1, 0)], key=repr)


def test_clear(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "_stored", {})
    rows = store(spark.range(5), str(tmp_path / "own"))
    assert rows.count() == 5 and len(list((tmp_path / "own").iterdir())) == 1
    assert clear(spark) == 1 and list((tmp_path / "own").iterdir()) == []
    assert clear(spark) == 0


def test_a_folder_of_one_machine_is_told(spark, monkeypatch):
    whole = type(spark.conf).get
    held = {"spark.checkpoint.dir": "", "spark.master": "spark://host:7077"}
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: held[key] if key in held else whole(self, key, *a))
    with pytest.warns(UserWarning, match="checkpoint"):
        stored.shared_folder(spark)
