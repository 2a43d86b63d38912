"""DuckDB SQL for those queries of this package that SQL can express."""

from __future__ import annotations

from tagloom.llm import urls
from tagloom.llm.queries import RULES

_BLANKS = r"'[\x20\x09-\x0D]'"


def _url_filter() -> str:
    """The template tree, with a few tables for each level."""
    rule, verdict = "", ""
    for judged, text in sorted(RULES, key=lambda r: -len(r[1])):
        name, _, rest = text.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')"
        rule += f" WHEN {fits} THEN '{text}'"
        verdict += f" WHEN {fits} THEN '{judged}'"
    levels = ""
    for k in range(urls.DEPTH):
        levels += f"""
        nodes{k} AS (
            SELECT host, template, segments[{k + 1}] AS segment, sum(n)::DOUBLE AS n,
                   sum(blocked)::DOUBLE AS b, sum(labelled)::DOUBLE AS l
            FROM tree{k} WHERE segments[{k + 1}] IS NOT NULL GROUP BY ALL
        ), parents{k} AS (
            SELECT host, template, sum(n) AS all_n, sum(b) AS all_b, sum(l) AS all_l
            FROM nodes{k} GROUP BY ALL
        ), named{k} AS (
            SELECT host, template, segment, TRUE AS keeps
            FROM nodes{k} JOIN parents{k} USING (host, template)
            WHERE n >= {urls.SUPPORT} AND n >= {urls.SHARE} * all_n AND all_b * (all_l - all_b) * l * (all_l - l) > 0
              AND pow(b * (all_l - l) - (all_b - b) * l, 2) * all_l
                  >= {urls.DIFFERS} * (all_b * (all_l - all_b) * l * (all_l - l))
        ), tree{k + 1} AS (
            SELECT t.host, t.general, t.segments, t.n, t.blocked, t.labelled,
                   t.template || CASE WHEN t.segments[{k + 1}] IS NULL THEN ''
                                      WHEN keeps THEN '/' || t.segments[{k + 1}] ELSE '/*' END AS template
            FROM tree{k} t LEFT JOIN named{k} m
              ON m.host = t.host AND m.template = t.template AND m.segment = t.segments[{k + 1}]
        ),"""
    s = urls.SMOOTHING
    return f"""
        WITH cut AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
            FROM pages
        ), parts AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
            FROM cut
        ), ruled AS (
            SELECT *, CASE{rule} END AS rule, CASE{verdict} END AS ruled,
                   regexp_replace(path, '[0-9]+', '#', 'g') AS general
            FROM parts
        ), tree0 AS (
            SELECT host, general,
                   CASE WHEN len(string_split(general, '/')) > {urls.DEPTH + 1}
                        THEN list_append(string_split(general, '/')[2:{urls.DEPTH + 1}], '**')
                        ELSE string_split(general, '/')[2:] END AS segments,
                   count(*) AS n, count(*) FILTER (WHERE ruled = 'block') AS blocked, count(ruled) AS labelled,
                   '' AS template
            FROM ruled WHERE host <> '' GROUP BY host, general
        ),{levels}
        leaves AS (
            SELECT host, template, sum(blocked)::DOUBLE AS b, sum(labelled)::DOUBLE AS l
            FROM tree{urls.DEPTH} GROUP BY ALL
        ), everything AS (
            SELECT (sum(b) + 1) / (sum(l) + 2) AS rate FROM leaves
        ), hosts AS (
            SELECT host, (sum(b) + {s} * any_value(rate)) / (sum(l) + {s}) AS above
            FROM leaves, everything GROUP BY host
        ), judged AS (
            SELECT host, template, (b + {s} * above) / (l + {s}) >= {urls.PURITY} AS rejected
            FROM leaves JOIN hosts USING (host)
        )
        SELECT page_id, r.host, path, rule,
               coalesce(ruled, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, t.template
        FROM ruled r
        LEFT JOIN tree{urls.DEPTH} t ON t.host = r.host AND t.general = r.general
        LEFT JOIN judged j ON j.host = t.host AND j.template = t.template
    """


ORACLES: dict[str, str] = {
    "op1_url_filter": _url_filter(),
    # All pairs that share a shingle, and all documents that can be reached from each.
    "op2_near_duplicates": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, [x FOR x IN regexp_split_to_array(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x20\x09-\x0D]+') IF x <> ''] AS w
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(
                CASE WHEN len(w) >= 5
                     THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
            FROM d
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), shared AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
            FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
            WHERE 100 * c >= 75 * (na.n + nb.n - c)
        ), both_ways AS (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other
        ), least AS (
            SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
    "op6_exact_duplicates": f"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), {_BLANKS}, '', 'g') AS t
            FROM documents
        ), g AS (
            SELECT *, count(*) OVER (PARTITION BY t) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id
            FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM g
    """,
    # All pairs of a label, and all vectors that can be reached from each.
    "op13_embedding_duplicates": """
        WITH RECURSIVE good AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e
            FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0
              AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
              AND len([c FOR c IN embedding IF c <> 0]) > 0
        ), links AS (
            SELECT x.vec_id AS a, y.vec_id AS b
            FROM good x JOIN good y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
            WHERE list_cosine_similarity(x.e, y.e) >= 0.93
        ), n AS (
            SELECT a, count(*) AS n FROM links GROUP BY a
        ), reach AS (
            SELECT vec_id, vec_id AS other FROM embeddings
            UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
        ), least AS (
            SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
        )
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM least LEFT JOIN n ON n.a = vec_id
    """,
}
