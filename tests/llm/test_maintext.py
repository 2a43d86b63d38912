import itertools
import os
import random
import re
from html import unescape
from pathlib import Path

import pytest

from tagloom.llm import maintext
from tests.llm import helpers

FOLDER = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><a href="/">Home</a> <a href=/x>More</a></nav>
<div id="main"><h1>A title &amp; more</h1><p>This is a long paragraph of some length, with many
words &lt;b&gt; that go&nbsp;on   and on. It <b>ends</b> he<i>re</i>.<br>
<p>Short.<p>Another paragraph of words that goes on for a good while, and then it ends as well.</p>
<div class="ad-box">Buy this now, today, for it is a very good thing to buy, says the maker of it.</div>
<ul><li>First point of the list, which matters.<li>Second</ul>
<script>var x = "<p>no</p>"; if (a < b) {}</script><!-- <p>no</p> -->
<form><p>Subscribe to our newsletter today and receive all the news there is.</p></form></div>
<section class="userComments"><p>I disagree with this long article because it is wrong and long, says a reader.</p></section>
<aside><p>Related things which are long enough to be content, but are not so at all.</p></aside>
<div class="cookie_notice">We use cookies on this long page, and you have to accept all of them.</div>
<div style="display:none"><p>Nobody sees this long paragraph of words, which is not meant for readers.</p></div>
<footer><p>Copyright 2020 by a company whose name is long.</p></footer></body></html>"""


def test_a_page_by_hand():
    assert maintext.main_text(PAGE).split("\n") == [
        "A title & more",
        "This is a long paragraph of some length, with many words <b> that go on and on. It ends here.",
        "Short.",
        "Another paragraph of words that goes on for a good while, and then it ends as well.",
        "First point of the list, which matters.",
        "Second",
    ]


def test_damaged_pages():
    for page in (None, "", "   ", "<", "<p", "<p class='x", "</p></p>", "<!-- x", "<script>x", "<![CDATA[x", "<a><a><a>", "\x00<p>\x00"):
        maintext.main_text(page)
    long = "A sentence of enough words to be content, for it goes on and on until it ends."
    assert maintext.main_text(f"<article><p>{long}<div><p>{long}") == f"{long}\n{long}"
    assert maintext.main_text(f"<article><p title='a > b'>{long}</p>") == long
    assert maintext.main_text(f"<ARTICLE><P>{long}</P></ARTICLE>") == long


def energy(found, chosen):
    """What a labelling costs: the capacities that it cuts."""
    total = 0.0
    for block, keep in zip(found, chosen, strict=True):
        c = maintext.cost(block)
        total += max(0.0, -c) if keep else max(0.0, c)
    free = [maintext.cost(b) > -maintext.CERTAIN for b in found]
    last = {}
    for j, block in enumerate(found):
        pairs = []
        if j:
            pairs.append((j - 1, maintext.NEXT / (1 + maintext.distance(found[j - 1].element, block.element) / 2)))
        parent = block.element.parent or block.element
        if last.get(id(parent), j) < j - 1:
            pairs.append((last[id(parent)], maintext.SAME_PARENT))
        last[id(parent)] = j
        total += sum(w for i, w in pairs if free[i] and free[j] and chosen[i] != chosen[j])
    return total


def test_the_labelling_is_the_cheapest():
    rng = random.Random(7)
    kinds = ["<p>{}</p>", "<div>{}</div>", "<li><a href=x>{}</a></li>", "<div><p>{}</p></div>", "<nav>{}</nav>", "<h2>{}</h2>", "<td>{}"]
    seen = set()
    for _ in range(150):
        page = "<div>" + "".join(
            rng.choice(kinds).format(helpers.sentence(rng, rng.choice([1, 2, 4, 9, 20]), ["word", "of", "it."]))
            for _ in range(rng.randint(1, 9))
        )
        found = maintext.blocks(page)
        got = maintext.labels(found)
        free = [maintext.cost(b) > -maintext.CERTAIN for b in found]
        best = min(
            energy(found, c) for c in itertools.product([False, True], repeat=len(found))
            if all(f or not x for f, x in zip(free, c, strict=True))
        )
        assert energy(found, got) == pytest.approx(best)
        seen.add(tuple(got))
    assert len(seen) > 20


def test_a_page_of_many_blocks():
    long = "A sentence of enough words to be content, for it goes on and on until it ends."
    page = "<div>" + f"<p>{long}</p><div class=ad>x</div>" * 5000
    assert maintext.main_text(page).count("\n") == 4999


@pytest.mark.parametrize(
    "before, after",
    [
        ("<article class='post category-social'>", "</article>"),
        ("<article class='post tag-privacy'>", "</article>"),
        ("<div class='hentry category-social'>", "</div>"),
        ("<div class='content-with-sidebar'>", "</div>"),
        ("<div class='wrapper sidebar-right'>", "</div>"),
        ("<div class='wrapper sidebar-right'><main>", "</main></div>"),
        ("<p>A short line.</p><div class='sidebar-right'><article>", "</article></div>"),
        ("<article class='post promo'>", "</article>"),
        ("<article class='related'>", "</article>"),
        ("<div id='privacy-page'>", "</div>"),
    ],
)
def test_one_word_of_a_name_does_not_lose_the_article(before, after):
    text = ["A title", *(f"Paragraph {k} of the article has words enough to be content, and it goes on until it ends." for k in "abc")]
    body = f"<h1>{text[0]}</h1>" + "".join(f"<p>{x}</p>" for x in text[1:])
    rest = "<nav><p>A way to other pages of this site, which is long enough to be content.</p></nav><div class='footer'><a href=x>Imprint</a></div>"
    got = maintext.main_text(f"<body>{before}{body}{after}{rest}</body>").split("\n")
    assert [x for x in got if x != "A short line."] == text


@pytest.mark.parametrize(
    "name",
    ["ad-box", "userComments", "post-comments", "page-footer", "article-related", "sidebar-right", "promo", "widget", "category-menu"],
)
def test_names_of_boilerplate_still_speak(name):
    long = "A sentence of enough words to be content, for it goes on and on until it ends."
    other = "Another sentence of enough words to be content, but it stands where none is to be expected."
    for page in ("<article><p>{0}</p><div class={2}><p>{1}</p></div></article>", "<div><p>{0}</p></div><div class={2}><p>{1}</p></div>"):
        assert maintext.main_text(page.format(long, other, name)) == long
    comments = f"<div id=comments><ol class=comment-list><li class=comment><article class=comment-body><p>{other}</p></article></ol></div>"
    assert maintext.main_text(f"<article><p>{long}</p></article>{comments}") == long


def test_names_are_summed_with_the_other_evidence():
    block = maintext.blocks("<p>It is a sentence that is long enough.</p><div class=promo><p>It is a sentence that is long enough.</p></div>")
    assert maintext.cost(block[1]) == pytest.approx(maintext.cost(block[0]) + maintext.BAD_NAME)


def test_rows_of_a_table(spark):
    df = spark.createDataFrame([(1, PAGE, "u"), (1, PAGE, "u"), (None, None, None), (2, "", "u")], "page_id bigint, html string, text string")
    got = sorted(map(tuple, maintext.extract(df).collect()), key=repr)
    assert got == sorted([(1, maintext.main_text(PAGE))] * 2 + [(None, ""), (2, "")], key=repr)
    assert maintext.extract(df.limit(0)).collect() == []


@pytest.mark.skipif(not FOLDER.is_dir(), reason="no tables")
def test_articles_of_the_given_pages(spark):
    from tagloom.llm.queries import QUERIES

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in QUERIES["op4_main_text"](spark, str(FOLDER)).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.DOTALL)[1]
        parts = (" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


LONG = "A sentence of enough words to be content, for it goes on and on until it ends."


@pytest.mark.parametrize("n", [2, 4, 6, 8, 20])
def test_an_articles_list_of_links_is_part_of_it(n):
    names = [f"Source {k}" if k % 2 else f"The source number {k} of this text" for k in range(n)]
    items = "".join(f"<li><a href=x>{name}</a></li>" for name in names)
    for before in ("<h2>Sources</h2>", "<p>Sources:</p>", ""):
        page = f"<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>A title</h1><p>{LONG}</p>{before}<ul>{items}</ul></article><footer>Imprint</footer>"
        head = ["A title", LONG] + (["Sources" if "h2" in before else "Sources:"] if before else [])
        assert maintext.main_text(page).split("\n") == head + names
    shared = f"<article><p>{LONG}</p><ul class=share-links>{items}</ul></article>"
    assert maintext.main_text(shared) == LONG


def test_elements_within_a_line_do_not_part_it():
    rest = "and this line goes on with words enough to be content."
    cases = {
        "For <math><mi>x</mi><mo>=</mo><mn>2</mn></math> see below, {}": "For x=2 see below, {}",
        "For <math><semantics><mi>x</mi><annotation encoding='application/x-tex'>x_{{1}}</annotation></semantics></math>, {}": "For x, {}",
        "Press <button type=button>OK</button> now, {}": "Press now, {}",
        "The <label for=a>name</label> of it, {}": "The name of it, {}",
    }
    for page, text in cases.items():
        assert maintext.main_text(f"<article><p>{page.format(rest)}</p><p>{LONG}</p></article>") == f"{text.format(rest)}\n{LONG}"
    assert maintext.main_text(f"<article><p>{LONG}<button>Never closed</p><p>{LONG}</p></article>") == f"{LONG}\n{LONG}"
    assert maintext.main_text(f"<article><p>{LONG}</p></article><form><label>Name</label><button>Send</button></form>") == LONG


def test_short_lines_without_an_article():
    lines = ["Roses", "are red", "violets are blue", "and", "so on"]
    page = "<body><nav><a href=/>Home</a> <a href=/x>More</a></nav><div>{}</div><div class=footer><p>Copyright</p><p>Imprint</p><p>Terms</p></div></body>"
    assert maintext.main_text(page.format("".join(f"<p>{x}</p>" for x in lines))).split("\n") == lines
    links = "".join(f"<p><a href=x>{x}</a></p>" for x in lines)
    assert maintext.main_text(page.format(links)) == ""


def by_another_parser(page):
    """(text, element) of the blocks of a well-formed page, by the standard library's parser."""
    from html.parser import HTMLParser

    inline = {"b", "i", "a", "span", "label", "math", "mi", "mo", "em"}
    silent = {"script", "style", "title", "textarea", "svg", "button"}

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.found, self.text = [""], [], []

        def flush(self):
            if whole := " ".join("".join(self.text).split()):
                self.found.append((whole, next(t for t in reversed(self.stack) if t not in inline | silent)))
            self.text = []

        def handle_starttag(self, tag, attrs):
            if tag in ("br", "button"):
                self.text.append(" ")
            elif tag not in inline | silent:
                self.flush()
            if tag not in ("br", "hr", "img"):
                self.stack.append(tag)

        def handle_endtag(self, tag):
            if tag not in inline | silent:
                self.flush()
            while self.stack.pop() != tag:
                pass

        def handle_data(self, data):
            if not silent & set(self.stack):
                self.text.append(data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    reader.flush()
    return reader.found


@pytest.mark.parametrize("seed", range(5))
def test_blocks_are_those_of_another_parser(seed):
    rng = random.Random(seed)

    def inline(depth=0):
        kind = rng.choice(["word", "word", "a &amp; b", "&lt;p&gt;", "&#233;t&eacute;", "<br>", "b", "a", "span", "label", "math", "button", "<!-- no <p> -->", " \n "])
        if kind in ("b", "a", "span", "label", "math", "button"):
            return f"<{kind} title='x > y'>{inline(depth + 1) if depth < 3 else 'deep'}</{kind}>".replace("<math title='x > y'>", "<math>")
        return kind

    def block(depth=0):
        name = rng.choice(["p", "p", "h2", "div", "section", "ul", "table", "blockquote", "pre", "figure", "script"])
        lines = " ".join(inline() for _ in range(rng.randint(0, 5)))
        if name == "script":
            return "<script>if (a < b) { '<p>no</p>' }</script>"
        if name == "ul":
            return "<ul>" + "".join(f"<li>{' '.join(inline() for _ in range(2))}</li>" for _ in range(3)) + "</ul>"
        if name == "table":
            return f"<table><tr><td>{lines}</td><th>{inline()}</th></tr></table>"
        if name in ("div", "section", "blockquote", "figure") and depth < 3:
            return f"<{name} class=x{depth}>{lines}{''.join(block(depth + 1) for _ in range(rng.randint(0, 3)))}{inline()}</{name}>"
        return f"<{name}>{lines}</{name}>"

    for _ in range(60):
        page = f"<html><body>{''.join(block() for _ in range(rng.randint(0, 5)))}</body></html>"
        assert [(b.text, b.tag) for b in maintext.blocks(page)] == by_another_parser(page)
