"""View and edit the Exif metadata of image collections with Spark."""

from tagloom.operators.edit import (
    apply_edits,
    last_edits,
    patch_tags,
    refused_edits,
    strip_metadata,
)
from tagloom.operators.headers import headers, join_images, left_out, split_images
from tagloom.operators.view import decode_tags, view_images, view_tags
from tagloom.sources.images import save_images, scan_images, write_images
from tagloom.sources.manifest import compare_manifests, manifest, read_changed
from tagloom.sources.stored import clear, store

__all__ = [
    "apply_edits",
    "clear",
    "compare_manifests",
    "decode_tags",
    "headers",
    "join_images",
    "last_edits",
    "left_out",
    "manifest",
    "patch_tags",
    "read_changed",
    "refused_edits",
    "save_images",
    "scan_images",
    "split_images",
    "store",
    "strip_metadata",
    "view_images",
    "view_tags",
    "write_images",
]
