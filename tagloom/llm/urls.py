"""URL filter: given rules, and beyond them a tree of path templates.

Rules judge the urls they fit. Their verdicts are the labels from which the rest is judged:
the paths of each host form a tree of segments, in which

- runs of digits are generalised at once (``#``),
- a segment that few of its parent's urls share becomes a wildcard (``*``),
- a branch whose labelled share of blocked urls does not differ significantly from that of its
  siblings is merged with them into the wildcard,
- a template is rejected if its share of blocked urls, smoothed towards that of its host and
  this one's towards that of all hosts, is at least PURITY.

By default paths are told apart by their first DEPTH segments and segments of less than SHARE of their parent's urls
have no name, which is what the registered query and its SQL counterpart fix. ``depth=None`` goes on until the data give no reason to,
``share=0`` keeps every segment with support, and ``apart`` keeps branches without any label from those that have some, and
rejects a template only on labelled urls of its own.

Built from SQL expressions alone. Urls are counted by host and generalised path
before anything else, so the tree has a row for each distinct one and a host that holds most
urls is no hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.scratch import beside, store

ALLOW, BLOCK = "allow", "block"
#: Segments of a path that are told apart; what follows is one wildcard.
DEPTH = 4
#: Least number and share of its parent's urls that a segment keeps its name with.
SUPPORT = 20
SHARE = 0.01
#: Squared normal quantile: branches that differ at the 5 % level stay apart.
DIFFERS = 3.84
#: Weight of the level above, in urls.
SMOOTHING = 8.0
PURITY = 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = "substring({url}, instr({url}, '://') + 3)"


def host(url: str) -> F.Column:
    """What stands after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z folded; else empty."""
    found = F.expr(f"IF(instr({url}, '://') > 0, regexp_extract({_AFTER.format(url=url)}, '^[^/?#]*', 0), '')")
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path(url: str) -> F.Column:
    """What follows the host up to ``?`` or ``#``; else empty."""
    found = F.expr(
        f"IF(instr({url}, '://') > 0, regexp_extract({_AFTER.format(url=url)}, '^[^/?#]*([^?#]*)', 1), '')"
    )
    return F.coalesce(found, F.lit(""))


def longest_rule(rules: Sequence[tuple[str, str]]) -> tuple[F.Column, F.Column]:
    """Rule and verdict, of (verdict, rule) pairs, that fit columns host and path; the longest rule wins.

    A rule is a host and the beginning of a path; it fits the host and all subdomains. Of rules of
    equal length the first by code point wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for judged, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, _, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, judged).otherwise(verdict)
    return rule, verdict


_SUMS = ("n", "blocked", "labelled")


def _generalised(counted: DataFrame, level: int, share: float = SHARE, apart: bool = False) -> DataFrame:
    """One level of the tree: the next segment joins the template, by name or as a wildcard."""
    key = ["host", "template"]
    seg = F.get("segments", F.lit(level))
    here = counted.withColumn("segment", seg)
    nodes = here.where("segment IS NOT NULL").groupBy(*key, "segment").agg(*(F.sum(c).alias(c) for c in _SUMS))
    parents = nodes.groupBy(*key).agg(*(F.sum(c).alias(f"all_{c}") for c in _SUMS))
    # Squared difference of two shares against its variance under one common share.
    others = "(all_labelled - labelled)"
    gap = f"pow(blocked * {others} - (all_blocked - blocked) * labelled, 2) * all_labelled"
    spread = f"CAST(all_blocked AS DOUBLE) * (all_labelled - all_blocked) * labelled * {others}"
    differs = f"{gap} >= {DIFFERS} * {spread} AND {spread} > 0"
    if apart:  # labels on one side only: nothing says that the other is like it
        differs = f"({differs}) OR (all_labelled > 0 AND n < all_n AND (labelled = 0 OR {others} = 0))"
    keeps = f"n >= {SUPPORT} AND n >= {share} * all_n AND ({differs})"
    named = nodes.join(parents, key).where(keeps).select(*key, "segment", F.lit(True).alias("keeps"))
    joined = here.join(beside(store(named)), [*key, "segment"], "left")
    step = F.when(F.col("segment").isNull(), "").when(F.col("keeps"), F.concat(F.lit("/"), "segment")).otherwise("/*")
    return joined.withColumn("template", F.concat("template", step)).drop("segment", "keeps")


def _to_the_end(counted: DataFrame, share: float, apart: bool) -> DataFrame:
    """All levels at which some template still has reason to be divided: urls enough, and labels that differ (or are missing).

    What is left of other paths is one wildcard, ``/**``. There are at most as many levels as a path has segments.
    """
    done, level = [], 0
    while True:
        differs = "blocked > 0 AND blocked < labelled" + (" OR labelled > 0 AND labelled < n" if apart else "")
        nodes = counted.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in _SUMS))
        open_ = store(nodes.where(f"n >= 2 * {SUPPORT} AND ({differs})").select("host", "template"))
        more = F.get("segments", F.lit(level)).isNotNull()
        settled = counted.join(beside(open_), ["host", "template"], "left_anti")
        done.append(settled.withColumn("template", F.when(more, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))))
        counted = counted.join(beside(open_), ["host", "template"], "left_semi")
        done.append(counted.where(~more))
        counted = store(counted.where(more))
        if counted.isEmpty():
            out = done[0]
            for part in done[1:]:
                out = out.unionByName(part)
            return store(out)
        counted = store(_generalised(counted, level, share, apart))
        level += 1


def templates(judged: DataFrame, depth: int | None = DEPTH, share: float = SHARE, apart: bool = False) -> DataFrame:
    """host, general, template, rejected of rows (host, general, label): general is a path without numbers."""
    counted = judged.groupBy("host", "general").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("label", F.lit(0))).alias("blocked"), F.count("label").alias("labelled")
    )
    parts = F.split("general", "/")
    if depth is None:
        segments = F.slice(parts, F.lit(2), F.size(parts))
    else:
        cut = F.when(F.size(parts) > depth + 1, F.concat(F.slice(parts, 2, depth), F.array(F.lit("**"))))
        segments = F.coalesce(cut, F.slice(parts, 2, depth))
    counted = store(counted.withColumn("segments", segments).withColumn("template", F.lit("")))
    if depth is None:
        counted = _to_the_end(counted, share, apart)
    else:
        for level in range(depth):
            counted = store(_generalised(counted, level, share, apart))
    sums = [F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")]
    leaves = store(counted.groupBy("host", "template").agg(*sums))
    hosts = leaves.groupBy("host").agg(*sums)
    rate = leaves.agg(((F.sum("blocked") + 1) / (F.sum("labelled") + 2)).alias("rate")).first()["rate"] or 0.5
    by_host = hosts.select("host", ((F.col("blocked") + SMOOTHING * rate) / (F.col("labelled") + SMOOTHING)).alias("above"))
    purity = (F.col("blocked") + SMOOTHING * F.col("above")) / (F.col("labelled") + SMOOTHING)
    rejected = (purity >= PURITY) & (F.col("labelled") > 0) if apart else purity >= PURITY
    verdicts = leaves.join(by_host, "host").select("host", "template", rejected.alias("rejected"))
    return store(counted.select("host", "general", "template").join(verdicts, ["host", "template"]))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    depth: int | None = DEPTH,
    share: float = SHARE,
    apart: bool = False,
) -> DataFrame:
    """<id>, host, path, rule, verdict, template of every row of ``pages``.

    ``rules`` are (verdict, rule) pairs, in a list that the caller holds. Where none fits, the verdict is
    the template's. Null urls and those without ``://`` have an empty host and path, fit no rule and are allowed.
    Rows that repeat are judged alike; ids pass through. An empty table gives an empty result. Other columns are
    not read. No sampling: every url is counted, every distinct path is in the tree. A url of any length is read whole.
    ``depth``, ``share`` and ``apart`` say how far the tree tells branches apart; without limits: ``depth=None, share=0, apart=True``.
    """
    address = f"`{url_col}`"
    rows = pages.select(F.col(id_col).alias("id"), host(address).alias("host"), path(address).alias("path"))
    rule, verdict = longest_rule(rules)
    rows = rows.select(
        "id", "host", "path", F.regexp_replace("path", "[0-9]+", "#").alias("general"), rule.alias("rule"), verdict.alias("ruled")
    )
    label = F.when(F.col("ruled") == BLOCK, 1).when(F.col("ruled") == ALLOW, 0)
    found = templates(rows.where("host <> ''").select("host", "general", label.alias("label")), depth, share, apart)
    return rows.join(beside(found), ["host", "general"], "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(F.col("rejected"), BLOCK).otherwise(ALLOW)).alias("verdict"),
        "template",
    )
