"""Viewing: tags out of image bytes, as a long table or as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.bytes import cut, let
from tagloom.functions.directories import layout, slots
from tagloom.functions.names import resolve
from tagloom.functions.segments import first_exif
from tagloom.functions.values import value_text

Names = Sequence[str | tuple[str, int]]


def decode_tags(images: DataFrame, names: Names | None = None) -> DataFrame:
    """One row per image and tag: item_id, ifd, tag, type, count, value.

    One pass over the images in one stage, without a shuffle and without Python
    workers. ``names`` restricts the result to some tags before their values are
    decoded. Images without a readable Exif block give no rows.
    """
    wanted = None if names is None else [(ifd, tag) for _, ifd, tag in resolve(names)]
    # Not inline(): from that Spark infers a filter on the array, pushes it below
    # the decoding, and so decodes everything twice.
    entries = _slots(images, wanted).selectExpr(
        "item_id", "block", "little", f"inline_outer({_kept('slots', wanted)})"
    )
    # Entries may overlap, each as large as the block: values are cut out behind the generator, one at a time.
    return (
        entries.where("tag IS NOT NULL")
        .selectExpr("item_id", "ifd", "tag", "type", "count", "little", f"{_raw('block', '')} AS raw")
        .selectExpr(
            "item_id",
            "ifd",
            "tag",
            "type",
            "count",
            f"{value_text('raw', 'type', 'count', 'little')} AS value",
        )
    )


def view_tags(tags: DataFrame, names: Names) -> DataFrame:
    """One row per image in ``tags``, one column per requested tag.

    For stored tags. Map-side aggregation leaves at most one row per image and
    task before the one shuffle, however many rows an image has. Where a
    directory lists a tag more than once, the largest value is shown.
    """
    return tags.groupBy("item_id").agg(
        *[
            F.max(F.when((F.col("ifd") == ifd) & (F.col("tag") == tag), F.col("value"))).alias(name)
            for name, ifd, tag in resolve(names)
        ]
    )


def view_images(images: DataFrame, names: Names) -> DataFrame:
    """The view of ``view_tags(decode_tags(images), names)``, straight from the
    bytes: one row per image with tags, and no shuffle at all.

    (An item_id that several rows of ``images`` share gives a row for each.)
    """
    wanted = resolve(names)
    keys = list(dict.fromkeys((ifd, tag) for _, ifd, tag in wanted))
    place = "CASE " + " ".join(
        f"WHEN s.ifd = '{ifd}' AND s.tag = {tag} THEN {k}" for k, (ifd, tag) in enumerate(keys)
    )
    text = let(
        _raw("b", "s."), "r", value_text("r", "s.type", "s.count", "little")
    )
    larger = f"transform(held, (h, k) -> IF(k = at.place, greatest(h, at.text), h))"
    # An image's values are looked at one after the other; the largest of each tag is held.
    fold = f"""aggregate({_kept('slots', keys)}, array_repeat(CAST(NULL AS STRING), {len(keys)}),
        (held, s) -> {let(f"struct({place} END AS place, {text} AS text)", 'at', larger)})"""
    row = ", ".join(
        f"texts[{keys.index((ifd, tag))}] AS `{name}`" for name, ifd, tag in wanted
    )
    return (
        _slots(images, keys)
        .selectExpr("item_id", "has_tags", f"{let('block', 'b', fold)} AS texts")
        .selectExpr("item_id", f"inline_outer(IF(has_tags, array(struct(has_tags, {row})), NULL))")
        .where("has_tags")
        .drop("has_tags")
    )


def _slots(images: DataFrame, wanted: list[tuple[str, int]] | None) -> DataFrame:
    """item_id, block, little, has_tags, slots: where the entries lie, of tags with a wanted number."""
    some = None if wanted is None else [tag for _, tag in wanted]
    return (
        images.selectExpr("item_id", f"{first_exif('content')}.block AS block")
        .selectExpr("item_id", "block", f"{layout('block')} AS layout")
        .selectExpr("item_id", "block", "layout.little AS little", "layout.dirs AS dirs")
        .selectExpr(
            "item_id", "block", "little", "exists(dirs, d -> d.n > 0) AS has_tags", f"{slots(some)} AS slots"
        )
    )


def _kept(slots: str, wanted: list[tuple[str, int]] | None) -> str:
    """The slots of wanted tags."""
    if wanted is None:
        return slots
    tags = ", ".join(f"('{ifd}', {tag})" for ifd, tag in wanted)
    return f"filter({slots}, s -> (s.ifd, s.tag) IN ({tags}))"


def _raw(block: str, slot: str) -> str:
    """The bytes of a slot's value; NULL for one that is not wholly inside the block."""
    return f"""CASE WHEN {slot}size >= 0 AND {slot}pos + {slot}size <= length({block})
        THEN {cut(block, f'{slot}pos', f'{slot}size')} END"""
