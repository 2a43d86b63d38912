import contextlib
import io

IMAGE = "item_id bigint, content binary"
TAG = "item_id bigint, ifd string, tag int, type int, count bigint, value string"
EDIT = "item_id bigint, ifd string, tag int, seq bigint, value string"


def frame(spark, files):
    """item_id, content from a list of bytes, numbered from 0."""
    rows = [(i, None if f is None else bytearray(f)) for i, f in enumerate(files)]
    return spark.createDataFrame(rows, IMAGE)


def by_item(df):
    """{item_id: sorted list of the other columns}."""
    found = {}
    for row in df.collect():
        found.setdefault(row[0], []).append(tuple(row[1:]))
    return {k: sorted(v, key=repr) for k, v in found.items()}


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()
