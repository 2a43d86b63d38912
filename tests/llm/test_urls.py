import random
import re
from collections import defaultdict

from tagloom.llm import urls
from tagloom.llm.queries import RULES
from tests.helpers import plan

PAGE = "page_id bigint, url string, host string, rule int"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.DOTALL)
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def rule_of(host, path, rules):
    best = None
    for verdict, text in rules:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            if best is None or len(text) > len(best[1]):
                best = (verdict, text)
    return best or (None, None)


def brute(pages, rules):
    """{page_id: (host, path, rule, verdict, template)} with the tree in dictionaries."""
    rows = {}
    for i, url in pages:
        host, path = split(url)
        verdict, rule = rule_of(host, path, rules)
        rows[i] = [host, path, rule, verdict, re.sub("[0-9]+", "#", path)]
    template, segments = {}, {}
    label = {urls.BLOCK: (1, 1), urls.ALLOW: (0, 1), None: (0, 0)}
    for host, _, _, _, general in rows.values():
        if host:
            parts = general.split("/")
            segments[host, general] = parts[1 : 1 + urls.DEPTH] + (["**"] if len(parts) > urls.DEPTH + 1 else [])
            template[host, general] = ""
    for level in range(urls.DEPTH):
        nodes, parents = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0, 0])
        for host, _, _, verdict, general in rows.values():
            if host and len(segments[host, general]) > level:
                t = template[host, general]
                for counts in (nodes[host, t, segments[host, general][level]], parents[host, t]):
                    for k, x in enumerate((1, *label[verdict])):
                        counts[k] += x
        for (host, general), t in list(template.items()):
            if len(segments[host, general]) > level:
                segment = segments[host, general][level]
                (n, b, l), (all_n, all_b, all_l) = nodes[host, t, segment], parents[host, t]
                rest = all_l - l
                spread = all_b * (all_l - all_b) * l * rest
                gap = (b * rest - (all_b - b) * l) ** 2 * all_l
                keep = n >= urls.SUPPORT and n >= urls.SHARE * all_n and spread > 0 and gap >= urls.DIFFERS * spread
                template[host, general] = f"{t}/{segment if keep else '*'}"
    leaves, hosts, everything = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), [0, 0]
    for host, _, _, verdict, general in rows.values():
        if host:
            for counts in (leaves[host, template[host, general]], hosts[host], everything):
                for k, x in enumerate(label[verdict]):
                    counts[k] += x
    rate, s = (everything[0] + 1) / (everything[1] + 2), urls.SMOOTHING
    out = {}
    for i, (host, path, rule, verdict, general) in rows.items():
        t = template.get((host, general))
        if verdict is None:
            verdict = urls.ALLOW
            if host:
                above = (hosts[host][0] + s * rate) / (hosts[host][1] + s)
                leaf = leaves[host, t]
                if (leaf[0] + s * above) / (leaf[1] + s) >= urls.PURITY:
                    verdict = urls.BLOCK
        out[i] = (host, path, rule, verdict, t)
    return out


def collection(rng, n):
    hosts = ["a.example.com", "b.example.com", "EXAMPLE.org", "x.example.org", "shop.net", "com", "notcom"]
    rows = []
    for i in range(n):
        host = "a.example.com" if i % 3 == 0 else rng.choice(hosts)
        first = rng.choice(["fr", "de", "en", "es", "bad", f"u{rng.randrange(999)}"])
        path = rng.choice(["/{0}/{1}", "/{0}/{1}.html", "/{0}/item/{1}/", "/{0}", "/a/b/c/d/e/{1}", "/{0}/x{1}y{1}"])
        tail = rng.choice(["", "?a=/de/", "#top", "/"])
        rows.append((i, f"{rng.choice(['http', 'https'])}://{host}{path.format(first, rng.randrange(2000))}{tail}"))
    odd = [None, "", "x", "http://", "http:///p", "http://a?b", "http://a#b", "mailto:a@b", "://h/p", "http://Ünï.com/Fr/Ä", "http://com/fr/", "http://h//a//", "http://u@h:80/p", "http://h/a\nb"]
    return rows + [(n + k, u) for k, u in enumerate(odd)]


#: Rules that make a branch bad beyond what they name.
MORE = (*RULES, (urls.BLOCK, "a.example.com/bad/1"), (urls.BLOCK, "a.example.com/bad/item/1"), (urls.ALLOW, "a.example.com/en/1"))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGE)


def test_judgements_are_those_of_dictionaries(spark):
    pages = collection(random.Random(4), 3000)
    for rules in (RULES, MORE):
        want = brute(pages, rules)
        got = {r.page_id: tuple(r)[1:] for r in urls.judge(frame(spark, pages), rules).collect()}
        assert got == want
    beyond = [v for v in want.values() if v[2] is None]
    assert any(v[3] == urls.BLOCK for v in beyond) and any(v[3] == urls.ALLOW for v in beyond)
    assert any("bad" in (v[4] or "") for v in beyond)


def test_the_longest_rule_wins(spark):
    pages = [(1, "http://a.example.org/es/1"), (2, "http://a.example.org/en/12"), (3, "http://a.example.org/en/2"), (4, "http://badexample.org/es/"), (5, "http://org/es/")]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(frame(spark, pages), RULES).collect()}
    assert got == {
        1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("org/", "allow"),
        4: ("org/", "allow"), 5: ("org/", "allow"),
    }


def test_repeated_and_null_ids_and_an_empty_table(spark):
    rows = [(1, "http://x.com/de/1"), (1, "http://x.com/de/1"), (None, "http://x.net/"), (None, None)]
    got = sorted(((r.page_id, r.verdict) for r in urls.judge(frame(spark, rows), RULES).collect()), key=repr)
    assert got == sorted([(1, "block"), (1, "block"), (None, "allow"), (None, "allow")], key=repr)
    assert urls.judge(frame(spark, []), RULES).collect() == []
    assert {r.verdict for r in urls.judge(frame(spark, rows), ()).collect()} == {"allow"}


def test_only_built_in_expressions(spark, tmp_path):
    frame(spark, collection(random.Random(1), 50)).write.parquet(f"{tmp_path}/pages")
    text = plan(urls.judge(spark.read.parquet(f"{tmp_path}/pages"), RULES))
    assert "Python" not in text and "Pandas" not in text


FREE = {"depth": None, "share": 0.0, "apart": True}


def free_brute(pages, rules):
    """{page_id: (verdict, template)} without limits: branches are divided recursively, in lists."""
    rows, done = [], {}
    for i, url in pages:
        host, path = split(url)
        verdict, _ = rule_of(host, path, rules)
        rows.append((i, host, re.sub("[0-9]+", "#", path).split("/")[1:], verdict))
    label = {"block": (1, 1), "allow": (0, 1), None: (0, 0)}

    def sums(some):
        return len(some), sum(label[r[3]][0] for r in some), sum(label[r[3]][1] for r in some)

    def divide(some, level, template):
        n, blocked, labelled = sums(some)
        if n < 40 or not (0 < blocked < labelled or 0 < labelled < n):
            for r in some:
                done[r[0]] = template + ("/**" if len(r[2]) > level else "")
            return
        branches = defaultdict(list)
        for r in some:
            if len(r[2]) > level:
                branches[r[2][level]].append(r)
            else:
                done[r[0]] = template
        all_n, all_b, all_l = sums([r for b in branches.values() for r in b])
        merged = []
        for segment, branch in branches.items():
            n, b, l = sums(branch)
            rest = all_l - l
            spread = all_b * (all_l - all_b) * l * rest
            differs = spread > 0 and (b * rest - (all_b - b) * l) ** 2 * all_l >= 3.84 * spread
            one_sided = all_l > 0 and n < all_n and (l == 0 or rest == 0)
            if n >= 20 and (differs or one_sided):
                divide(branch, level + 1, f"{template}/{segment}")
            else:
                merged += branch
        if merged:
            divide(merged, level + 1, f"{template}/*")

    for host in {r[1] for r in rows if r[1]}:
        divide([r for r in rows if r[1] == host], 0, "")
    leaves, hosts, everything = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), [0, 0]
    for r in rows:
        if r[1]:
            for counts in (leaves[r[1], done[r[0]]], hosts[r[1]], everything):
                counts[0] += label[r[3]][0]
                counts[1] += label[r[3]][1]
    rate = (everything[0] + 1) / (everything[1] + 2)
    out = {}
    for i, host, _, verdict in rows:
        if verdict is None:
            verdict = "allow"
            if host:
                b, l = leaves[host, done[i]]
                above = (hosts[host][0] + 8 * rate) / (hosts[host][1] + 8)
                if l > 0 and (b + 8 * above) / (l + 8) >= 0.8:
                    verdict = "block"
        out[i] = (verdict, done.get(i))
    return out


def test_without_limits_judgements_are_those_of_dividing_lists(spark):
    pages = collection(random.Random(14), 2500)
    deep = [("block", "a.example.com/a/b/c/d/e/1"), ("allow", "a.example.com/a/b/c/d/e/2")]
    rules = (*MORE, *deep)
    rng = random.Random(15)
    for k in range(600):
        kind, number = rng.choice(["good", "bad"]), rng.randrange(100)
        pages.append((10_000 + k, f"http://deep.com/a/b/c/d/e/f/{kind}/{number}/{rng.randrange(9)}"))
    rules = (*rules, ("block", "deep.com/a/b/c/d/e/f/bad/1"), ("allow", "deep.com/a/b/c/d/e/f/good/1"))
    got = {r.page_id: (r.verdict, r.template) for r in urls.judge(frame(spark, pages), rules, **FREE).collect()}
    assert got == free_brute(pages, rules)
    beyond = {got[i][0] for i, url in pages if i >= 10_000 and "/bad/" in url}
    assert beyond == {"block"} and {got[i][0] for i, url in pages if i >= 10_000 and "/good/" in url} == {"allow"}


def test_a_branch_without_labels_is_not_rejected(spark):
    pages = [(k, f"http://x.com/de/a{k}") for k in range(30)] + [(100 + k, f"http://x.com/en/{k}") for k in range(3000)]
    pages += [(9000 + k, f"http://x.com/q{chr(97 + k % 26)}{chr(97 + k // 26)}/q") for k in range(200)]  # names without support
    got = {r.page_id: r.verdict for r in urls.judge(frame(spark, pages), RULES, **FREE).collect()}
    assert {got[k] for k in range(30)} == {"block"} and {v for k, v in got.items() if k >= 100} == {"allow"}


def test_many_equal_sections_are_told_apart(spark):
    names = [a + b for a in "abcdefghijklmnopqrst" for b in "abcdefghij"]  # 200, of half a per cent each
    pages = [(60 * k + i, f"http://h.net/{name}/{i}") for k, name in enumerate(names) for i in range(60)]
    rules = [("block", f"h.net/ah/{d}") for d in "1234"] + [("allow", f"h.net/{a}") for a in "bcdefghijklmnopqrst"]
    got = {r.page_id: r.verdict for r in urls.judge(frame(spark, pages), rules, **FREE).collect()}
    assert {k for k, v in got.items() if v == "block"} == set(range(60 * 7, 60 * 8))
    limited = {r.page_id: r.verdict for r in urls.judge(frame(spark, pages), rules).collect()}
    assert limited[60 * 7 + 55] == "allow"  # the section has no name of its own
    assert urls.judge(frame(spark, []), rules, **FREE).collect() == []


def test_a_very_long_url(spark):
    long = "http://h.com/" + "/".join(["s"] * 5000)
    got = [r.verdict for r in urls.judge(frame(spark, [(1, long), (2, long + "?q")]), RULES, **FREE).collect()]
    assert got == ["allow", "allow"]
