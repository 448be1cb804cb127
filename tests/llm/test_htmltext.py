"""Main text of pages."""

from __future__ import annotations

import html
import itertools
import random
import re
from collections import Counter

import pytest

from placeloom.llm import htmltext
from placeloom.llm.queries import QUERIES

LONG = "word " * 60
PAGE = """<html><head><title>Site</title><style>p{}</style></head><body><header><h1>Site name</h1><nav><a href=x>Home</a> <a href=y>About</a></nav></header>
<div class="cookie-notice">We use cookies on this site for many a purpose you may not like at all</div><div id=wrap><div class="content"><h1>Title of it</h1>
<p>First paragraph with   quite a few words in it to read.<p>Second one &amp; more words<br>after a break &#233;t&eacute; here.<ul><li>one item of the list</li><li>two item of the list</ul>
<form><input><label>Your email please, it is for us</label></form><div class="ad">Buy this thing now, it is very cheap</div><blockquote>Quoted <b>bold</b> words that stand here</blockquote></div>
<div class="sidebar"><p>Some words at the side, and there are quite a few of them in here for you to see</p></div><section id="comments"><h2>Comments</h2><p>Nice article, I liked it very much indeed yes yes</p></section></div>
<footer>Foot words, all rights reserved</footer><script>if (a<b) { "</p>" }</script></body></html>"""


def test_article_of_a_page():
    want = "Title of it\nFirst paragraph with quite a few words in it to read.\nSecond one & more words after a break été here.\none item of the list\ntwo item of the list\nQuoted bold words that stand here"
    assert htmltext.main_text(PAGE, htmltext.DEFAULT) == want


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("just some plain words", "just some plain words"), ("<p>a b c<p>d e f", "a b c\nd e f"), ("<nav>only a menu here</nav>", ""), ("<p>x < y & z > w here</p>", "x < y & z > w here"),
        ("<!-- unclosed <p>words", ""), ("<p>a&nbsp;&nbsp;b c d e</p>", "a b c d e"), ("<script>never closed words", ""), ("</p></div>words after closing tags", "words after closing tags"), ("<p title='a>b'>quoted attribute words</p>", "quoted attribute words"),
        ("<article><p>short</p></article>", "short"), ("<div hidden>gone gone gone</div><p>shown words that stay here</p>", "shown words that stay here"),
    ],
)
def test_odd_pages(page, text):
    assert htmltext.main_text(page, htmltext.DEFAULT) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><h2 id="related-work">Related work</h2><p id="notice-period">The notice period is long</p><p class="social">plain words</p></article>', "Related work\nThe notice period is long\nplain words"),
        ('<main><div class="content with-sidebar"><p>one two three four five</p></div><div class="related-posts sidebar">more</div></main>', "one two three four five"),
        ('<article><div class="overlay"><p>one two three four five six</p></div><p>seven</p><div class="share-buttons">share it</div></article>', "one two three four five six\nseven"),
        ('<body class="no-comments"><p>one two three four</p></body>', "one two three four"), ('<article class="post comments-open"><p>one two three four</p></article>', "one two three four"),
        ('<main><p>one two three four</p><section class="comments"><p>very many words of readers stand in here indeed</p></section></main>', "one two three four"),
        ('<article class="comment"><p>one two three four</p></article>', "one two three four"),  # an opinion
        ('<main><p>one two three four</p><div class="comment"><p>very many words of a reader are in here</p></div><div class="comment"><p>and many words of another one</p></div></main>', "one two three four"),
        (f'<article><p>{LONG}</p><div class="reply"><p>so many words</p><time>now</time></div><p>{LONG}</p></article>', f"{LONG.strip()}\n{LONG.strip()}"),
        (f'<article><p>{LONG}</p><section id="discussion"><h2>Discussion</h2><p>What it all means.</p></section></article>', f"{LONG.strip()}\nDiscussion\nWhat it all means."),
    ],
)
def test_names_drop_only_what_they_name(page, text):
    assert htmltext.main_text(page, htmltext.DEFAULT) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><svg class="icon"/><p>one two three</p><svg><title/><text>drawn</text></svg><p>four five</p></article>', "one two three\nfour five"),
        ("<article><p>so <math/>that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds here</p></article>", "so that x=2 holds here"), ("<article><svg><path d='m'><p>one two three</p></article>", "one two three"),
        ("<article><select-x>one two</select-x> <object-y>three four</object-y></article>", "one two three four"), ("<article><iframe src=x><p>one two three</p></article>", "one two three"),
        ("<article><p>one two</p><noscript>gone</noscript><select><option>gone</select><p>three</p></article>", "one two\nthree"), ("<p>one two three</p><textarea>to the end <p>gone gone gone", "one two three"),
    ],
)
def test_raw_and_foreign_elements(page, text):
    assert htmltext.main_text(page, htmltext.DEFAULT) == text




@pytest.mark.parametrize("holder", ['<div class="content no-sidebar">', '<div class="site has-sidebar">', '<div class="social-policy-essay">', '<div class="share-price">', '<form id="aspnetForm">', "<div class=overlay>", "<section>", "<td>"])
def test_holders_of_a_whole_article(holder):
    end = f"</{re.match('<([a-z]+)', holder)[1]}>"
    page = f"<body><nav><a>Home</a></nav>{holder}<h1>Its title</h1><p>{LONG}</p><p>Short.</p><div class=ad>Buy this</div><p>{LONG}</p>{end}<div class=sidebar>at the side</div><footer>Foot</footer></body>"
    assert htmltext.main_text(page, htmltext.DEFAULT) == f"Its title\n{LONG.strip()}\nShort.\n{LONG.strip()}"


def test_the_region_decides():
    """Two candidates without any name: the better one wins, whatever is marked as an article."""
    links = "<div>" + "".join(f"<a href={k}>link to page {k}</a> " for k in range(30)) + "</div>"
    page = f"<body>{links}<div><div><p>{LONG}</p></div><div><p>{LONG} more</p></div></div>{links}</body>"
    assert htmltext.main_text(page, htmltext.DEFAULT) == f"{LONG.strip()}\n{LONG}more"
    small = f"<body><article><p>a few words</p></article>{links}<div><h1>Title</h1><p>{LONG}</p></div></body>"
    assert htmltext.main_text(small, htmltext.DEFAULT) == f"Title\n{LONG.strip()}"


def _weights(page: str, n: int = 50) -> htmltext.Weights:
    names, tags = Counter(), Counter()
    for _ in range(n):
        names.update(htmltext.name_counts(page))
        tags.update(htmltext.label_counts(page))
    return htmltext.weights(tags, names, {k: n for k, _ in names})


def test_names_are_weighed_by_labels():
    """A name that labelled pages only have outside articles is left out; one of the list stays once they have it inside, but an advert."""
    page = "<nav>x</nav><article><p>" + LONG + "</p><div class=notice>noted well here</div><div class=figures>one and two</div><div class=advert>buy one now</div></article><div class=tracks>some other words out here</div>"
    by = _weights(page)
    assert by[".tracks"] < -1 and by[".notice"] > 0 and by[".figures"] > 0 and by[".advert"] <= htmltext.NAMED and "." not in by
    text = htmltext.main_text(f"<body><div><p>{LONG}</p><div class=notice>note this</div><div class=figures>keep this</div><div class=advert>not this</div><div class=tracks>nor this</div><p>{LONG}</p></div></body>", by)
    assert text == f"{LONG.strip()}\nnote this\nkeep this\n{LONG.strip()}"


@pytest.mark.parametrize("named", ['class="related"', 'class="alert"', 'class="login"', 'class="search"', 'id="banner"', 'class="reply"'])
def test_labels_outweigh_the_list(named):
    """Holders of ordinary paragraphs inside an article go by their names until labelled pages have these inside articles."""
    page = f"<nav>x</nav><article><p>{LONG}</p><div {named}><p>some more words of the text</p></div></article><footer>out here</footer>"
    assert htmltext.main_text(page, htmltext.DEFAULT) == LONG.strip()
    assert htmltext.main_text(page, _weights(page)) == f"{LONG.strip()}\nsome more words of the text"


def test_tags_end_alike_before_and_after_a_broken_one():
    """Where a tag ends doesn't depend on whether another was broken before."""
    rng = random.Random(4)
    for _ in range(3000):
        page = "<a" + "".join(rng.choice(["='", '="', "'", '"', ">", "=", " ", "x", "<b"]) for _ in range(rng.randint(1, 25)))
        found = htmltext._TAG_END.match(page, 2)
        assert htmltext._TagEnds(page).after(2) == (found.end() if found else -1), page


def test_many_comments_on_a_short_article():
    comments = "".join(f"<li><h4>Reader {k}</h4><p>{LONG}</p></li>" for k in range(20))
    page = f"<body><div><h1>Title</h1><p>The short article is here.</p></div><ol class=comment-list>{comments}</ol></body>"
    assert htmltext.main_text(page, htmltext.DEFAULT) == "Title\nThe short article is here."


@pytest.mark.parametrize(
    "part",
    ["<a x='", '<a x="', "<![CDATA[x ", "<b>x</i>", "<b>", "<p><b>", "<!-- x", "<", "</", "<a ", "<a x='>'", "<iframe>", "<b><div></div>", "<svg><p>", "<li><b>", "<p class='ad x'>y", "<td><div>", "</script ", "<a ='><b =\">", "<ul><li>x", "<a ='\" =\"'", "<p class=reply>x"],
)
@pytest.mark.parametrize("end", ["", ">", "'>", "\">'", "]]>", "-->"])
def test_hostile_pages_cost_in_proportion(part, end):
    import time

    took = []
    for n in (40_000, 160_000):
        page = part * (n // len(part)) + end
        began = time.perf_counter()
        htmltext.main_text(page, htmltext.DEFAULT)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.2 and took[1] < 6


def _random_page(rng):
    """A tree of ``(name, children)`` and strings."""

    def some(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            if depth > 3 or rng.random() < 0.4:
                out.append(" " + " ".join(rng.choice(["w", "xy", "z"]) for _ in range(rng.randint(1, 9))) + " ")
            else:
                name = rng.choice(["div", "div", "section", "span", "nav", "footer", "h1"])
                out.append((name, some(depth + 1) if name != "h1" else [" head line "]))
        return out

    return ("body", some(0))


def _plain_text(tree, by):
    """All regions are tried; elements, text and bounds by recursion over the tree."""
    told, spans = [], []

    def walk(node, out, path):
        name, children = node
        out = out or name in htmltext.LEFT_OUT
        told.append((name, "", path, out))
        begin, me = len(told), (*path, len(spans))
        spans.append([name, begin, None, me])
        for c in children:
            if isinstance(c, str):
                told.append(("", c, me, out))
            else:
                walk(c, out, me)
        spans[me[-1]][2] = len(told)
        told.append((name, "", path, out))

    walk(tree, False, ())
    words = [0 if n or out else len(t.split()) for n, t, _, out in told]
    scores = [by.get(n, htmltext.UNKNOWN) if n else by[""] * w for (n, _, _, _), w in zip(told, words)]
    best, first, last = 0.0, 0, 0
    for b in range(1, len(scores) + 1):
        for a in range(b):
            total = 0.0
            for x in scores[a:b]:
                total += x
            if total > best + 1e-9 or abs(total - best) <= 1e-9 and b == last and a > first:
                best, first, last = total, a, b
    if first == last:
        return ""
    inside = sum(words[first:last])
    held = [p for (n, _, p, _), w in zip(told[first:last], words[first:last]) if w]
    common = held[0]
    for p in held:
        common = common[: next((k for k, (x, y) in enumerate(zip(common, p)) if x != y), min(len(common), len(p)))]
    for k in reversed(common):
        name, s, e, _ = spans[k]
        if name in htmltext.BLOCK:
            if name == "body" or inside < 0.8 * sum(words[s:e]):
                break
            first, last = min(first, s), max(last, e)
    while first and told[first - 1][0] not in htmltext.BLOCK:
        first -= 1
    while last < len(told) and told[last][0] not in htmltext.BLOCK:
        last += 1
    joined = "".join("\n" if n in htmltext.BLOCK else "" if n or out else t for n, t, _, out in told[first:last])
    return "\n".join(" ".join(x.split()) for x in joined.split("\n") if x.strip())


def test_against_all_regions():
    rng = random.Random(11)
    by = htmltext.DEFAULT | {"nav": -1.5, "footer": -2.0, "div": -0.75, "span": -0.25, "h1": -0.25, "section": -1.25, "": 0.5}
    show = lambda n: n if isinstance(n, str) else f"<{n[0]}>{''.join(map(show, n[1]))}</{n[0]}>"
    texts = []
    for _ in range(400):
        tree = _random_page(rng)
        texts.append(htmltext.main_text(show(tree), by))
        assert texts[-1] == _plain_text(tree, by), show(tree)
    assert len(set(texts)) > 300


def test_many_unclosed_frames():
    assert htmltext.main_text("<iframe></iframe><article>" + "<p>a b c<iframe>" * 20_000, htmltext.DEFAULT).count("\n") == 19_999


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><nav><a>Home</a></nav><h1>News</h1><p>{'word ' * 40}</p><p>Thanks.</p></body>", f"News\n{('word ' * 40).strip()}\nThanks."),
        (f"<h1>News</h1><ul><li>{'word ' * 40}</ul><p>Thanks.</p><footer>Foot</footer><p>after</p>", f"News\n{('word ' * 40).strip()}\nThanks."),
        (f"<body><h1>A <button>x</button>title</h1><p>{'word ' * 40}</p></body>", f"A title\n{('word ' * 40).strip()}"),
    ],
)
def test_short_blocks_in_the_body_stay(page, text):
    assert htmltext.main_text(page, htmltext.DEFAULT) == text


def test_region_is_the_best_run():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        best = max([0, *(sum(scores[a:b]) for a, b in itertools.combinations(range(len(scores) + 1), 2))])
        a, b = htmltext.best_region(scores)
        assert sum(scores[a:b]) == best


def test_weights_come_from_labels():
    page = "<nav><a>x y</a></nav><article><p>one two three four five six seven</p></article><footer>z</footer>"
    w = htmltext.weights(htmltext.label_counts(page))
    assert w[""] > 0 and w["a"] < 0 and w["p"] < 0 and w["nav"] <= w["p"]
    assert htmltext.weights({}) == htmltext.DEFAULT and not htmltext.label_counts("<article>a</article><article>b</article>")


def test_very_long_page():
    body = "".join(f"<p>paragraph {k} with some words in it</p>" for k in range(20_000))
    text = htmltext.main_text(f"<html><body><nav><a>m</a></nav><article>{body}</article></body></html>", htmltext.DEFAULT)
    assert text.count("\n") == 19_999


def test_whole_table(spark, sf_dir):
    """The tables' articles, read plainly from their own mark-up."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op3_html_extraction"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_whole_table_without_article_tags(spark, sf_dir, monkeypatch):
    """The texts stay when no tag names the article, and change when another region is chosen."""
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    by = htmltext.learn(table)
    pages = [r["html"] for r in table.collect()]
    texts = [htmltext.main_text(p, by) for p in pages]
    assert [htmltext.main_text(re.sub("</?article>", "", p), by) for p in pages] == texts
    assert [htmltext.main_text(p.replace("<article>", '<div class="content has-sidebar">').replace("</article>", "</div>"), by) for p in pages] == texts
    scored = lambda scores: [k for k, s in enumerate(scores) if s > 0]
    monkeypatch.setattr(htmltext, "best_region", lambda scores: (k := scored(scores)[len(scored(scores)) // 2], k + 1) if scored(scores) else (0, 0))
    assert sum(htmltext.main_text(p, by) != t for p, t in zip(pages, texts)) > 0.8 * len(pages)


def test_tables_with_gaps(spark):
    rows = spark.createDataFrame([(1, None, None, "x"), (None, "u", PAGE, "x"), (1, None, None, "x")], "page_id long, url string, html string, text string")
    by = htmltext.learn(rows)
    assert sorted(len(r["text"]) > 0 for r in htmltext.extract(rows, by).collect()) == [False, False, True]
    assert htmltext.extract(rows.where("false"), htmltext.learn(rows.where("false"))).count() == 0
