import math
import random
import time
from html.parser import HTMLParser

import pytest

from corpusmill.llm.html_text import extract_text, main_text

PAGE = """<html><body class="has-sidebar"><header><a href=/>Home</a><h1>Site</h1></header><div id="cookie-notice">We use cookies. <button>OK</button></div>
<div class="wrap"><div class="content"><h1>Title &amp; more</h1><p>Para one with <a href=x>link</a> text that is quite long and goes on.<div class="share">Share!</div>
<p>Para two&nbsp;has  more<br>text, it is long as well.<ul><li>item one<li>item two</ul></div>
<div class="sidebar"><ul><li><a href=1>Related one</a></ul></div><section id="comments"><p>Great post! I really liked this article and will read it again and again.</p></section></div>
<form><label>Name</label><input></form><footer>Copyright</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        (PAGE, "Title & more\nPara one with link text that is quite long and goes on.\nPara two has more text, it is long as well.\nitem one\nitem two"),
        ("<nav>menu menu menu menu</nav><article><h1>T</h1><p><b>one<br><p>two &#x41;</p></article><footer>f</footer>", "T\none\ntwo A"),
        ('<p>a<p>b</p>c<!-- x --><script>var a="</p>"</script>d', "a\nb\ncd"),
        ("plain", "plain"),
        ("<article></article>", ""),
        ("<" * 40, "<" * 40),
        ("<div>" * 2000 + "x", "x"),
        ('<p title="a>b">x</p><p title=\'c">\'>y', "x\ny"),
        ("", ""),
    ],
)
def test_pages(page, wanted):
    assert main_text(page) == wanted


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a"), (2, None, None), (1, "u", "<p>a")], "page_id long, url string, html string").selectExpr("*", "'x' AS text")
    assert sorted(tuple(r) for r in extract_text(df).where("url is not null").collect()) == [(1, "u", "a"), (1, "u", "a")]
    assert [tuple(r) for r in extract_text(df).where("url is null").collect()] == [(2, None, "")]
    assert extract_text(df.limit(0)).count() == 0


def test_names_are_matched_whole():
    words = "Shares rose again today and " * 8
    page = f'<div id=c><p>{words}</p><div class="share-price-table"><p>{words}</p></div><div class="site-footer">gone</div><div class="commentary headermost"><p>{words}</p></div><div class="postComments">gone</div></div>'
    assert main_text(page) == "\n".join([words.strip()] * 3)


class Plain(HTMLParser):
    """Well-formed pages as nested lists [tag, child or text, ...]."""

    def __init__(self):
        super().__init__()
        self.open = [["html"]]

    def handle_starttag(self, tag, attrs):
        self.open[-1].append([tag])
        self.open.append(self.open[-1][-1])

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.open[-1].append(data)


def held_parts(root, kept, below, chars, link_chars):
    """Ids of the elements whose own text belongs to the article around the marked ones."""
    marked = {id(x) for x in kept}
    holds = lambda n: marked <= {id(y) for y in (n, *below(n))}
    way = [root]
    while id(way[-1]) not in marked:
        inner = [x for x in way[-1][1:] if isinstance(x, list) and holds(x)]
        if not inner:
            break
        way.append(inner[0])
    block = lambda n: n[0] not in ("a", "b")
    links = lambda n: sum(x[0] == "a" for x in (n, *below(n)))
    heavy = lambda n, least: links(n) >= least and 2 * link_chars(n) > chars(n)
    held = set()

    def walk(node, where):
        on_way = any(node is x for x in way[:-1])
        if node is way[-1]:
            where = "core"
        elif where == "core" and block(node) and node[0] != "p" and id(node) not in marked and heavy(node, 3):
            return
        elif where == "beside" and not on_way and block(node) and heavy(node, 1):
            return
        inline = [x for x in node[1:] if isinstance(x, list) and not block(x)]
        own = sum(len(x.replace(" ", "")) for x in node[1:] if not isinstance(x, list)) + sum(map(chars, inline))
        bare = on_way and 2 * sum(map(link_chars, inline)) > own
        if not bare:
            held.add(id(node))
        for x in node[1:]:
            if isinstance(x, list) and not (bare and not block(x)):
                walk(x, "core" if where == "core" else "beside")

    walk(root, "beside")
    return held


def plain_text(page):
    """Composite text density by its definition, with no regard to speed."""
    parser = Plain()
    parser.feed(page)
    root = parser.open[0]

    def below(node):
        return [x for child in node[1:] if isinstance(child, list) for x in (child, *below(child))]

    def chars(node, linked=False):
        return sum(chars(x, linked or x[0] == "a") if isinstance(x, list) else len(x.replace(" ", "")) * (linked is not None) for x in node[1:])

    def link_chars(node):
        return chars(node) if node[0] == "a" else sum(link_chars(x) for x in node[1:] if isinstance(x, list))

    def density(node):
        c, lc, t = chars(node), link_chars(node), max(1, len(below(node)))
        lt = max(1, sum(x[0] == "a" for x in (node, *below(node))))
        if not c:
            return 0.0
        if not link_chars(root):
            return c / t
        base = math.log(c / max(1, c - lc) * lc + link_chars(root) / chars(root) * c + math.e)
        return c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(base)

    def total(node):
        return sum(density(x) for x in node[1:] if isinstance(x, list))

    def path(node, to):
        if node is to:
            return [node]
        found = next((p for x in node[1:] if isinstance(x, list) for p in [path(x, to)] if p), None)
        return found and [node, *found]

    every = [root, *below(root)]
    centre = max(every, key=lambda n: (total(n), chars(n)))
    least = min(density(n) for n in path(root, centre))
    kept = []

    def mark(node):
        if density(node) >= least:
            best = max([node, *below(node)], key=total)
            kept.append(best)
            for x in node[1:]:
                if isinstance(x, list):
                    mark(x)

    mark(root)
    inside = held_parts(root, kept, below, chars, link_chars)
    blocks = [""]

    def show(node):
        block = node[0] not in ("a", "b")
        blocks.append("") if block else None
        for x in node[1:]:
            if isinstance(x, list):
                show(x)
            elif id(node) in inside:
                blocks[-1] += x
        blocks.append("") if block else None

    show(root)
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def random_page(rng):
    def words(n):
        return " ".join(rng.choice(["one", "three", "a", "seventeen", "of"]) for _ in range(rng.randint(1, n)))

    def link():
        return f"<a href='{rng.randint(1, 9)}'>{words(3)}</a>"

    def box(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.5:
            return f"<p>{words(60)} {link() if kind < 0.1 else ''} <b>{words(4)}</b> {words(20)}</p>"
        if kind < 0.65:
            return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 7))) + "</ul>"
        return "<div>" + "".join(box(depth - 1) for _ in range(rng.randint(1, 4))) + "</div>"

    return "<body>" + "".join(box(3) for _ in range(rng.randint(1, 4))) + "</body>"


def test_density_decides_like_a_plain_version():
    rng = random.Random(4)
    pages = [random_page(rng) for _ in range(400)]
    found = [main_text(p) for p in pages]
    assert found == [plain_text(p) for p in pages]
    assert sum(len(f) < len("\n".join(p)) and "<li>" in p for f, p in zip(found, pages, strict=True)) > 50


def test_density_leaves_out_unnamed_menus():
    menu = "<ul>" + "".join(f"<li><a href={i}>Item {i}</a></li>" for i in range(30)) + "</ul>"
    text = "It is a long paragraph of plain words that goes on for a while, and then some more."
    page = f"<body><div>{menu}</div><div><h2>{text}</h2><p>{text}</p><p>{text} <a href=x>more</a></p></div><div>{menu}</div></body>"
    assert main_text(page) == f"{text}\n{text}\n{text} more"


W = "It is a long paragraph of plain words that goes on for a while, and then for some more."
LINKS = "<ul>" + "".join(f"<li><a href={i}>Item {i}</a></li>" for i in range(8)) + "</ul>"


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        # title, introduction, ends and sections of an article, with its core elsewhere
        (f"<article><h1>T</h1><p>Intro para.</p><div><p>{W}</p><p>{W}</p></div></article>", ["T", "Intro para.", W, W]),
        (f"<article><h1>T</h1><div><p>{W}</p><p>{W}</p></div><div><p>Short end.</p></div></article>", ["T", W, W, "Short end."]),
        (f'<article><h1>T</h1><p>{W}</p><section id="discussion"><h2>Discussion</h2><p>{W}</p></section></article>', ["T", W, "Discussion", W]),
        (f'<article><h1>T</h1><p class="byline">By A. Writer</p><section id="privacy"><p>{W}</p></section><p id="respond">{W}</p></article>', ["T", "By A. Writer", W, W]),
        (f"<article><p>{W}</p><p>Let <math><mi>x</mi></math> be.</p></article>", [W, "Let x be."]),
        (f"<h1>T</h1><div><div><p>{W}</p></div><div><p>{W}</p><p>See <a href=1>this</a>.</p></div></div><p>End.</p>", ["T", W, W, "See this .".replace(" .", "."), "End."]),
        (f"<div><h1>T</h1><div>By A.</div><p>{W}</p><p>{W}</p><p><a href=1>The whole paper</a></p></div>", ["T", "By A.", W, W, "The whole paper"]),
        # no name, tag or role tells what to leave out
        (f"<div>{LINKS}</div><div><h1>T</h1><p>{W}</p><p>{W}</p></div><div><div>{LINKS}</div></div>", ["T", W, W]),
        (f"<div><div><div>Site</div>{LINKS}</div><div><h1>T</h1><p>Intro.</p><div><p>{W}</p><p>{W}</p></div></div><div><h3>More</h3>{LINKS}</div><div>&copy; 2024 Site. All rights reserved.</div></div>", ["T", "Intro.", W, W]),
        (f"<a href=1>Home</a> | <a href=2>About us</a> | <a href=3>Contact</a><div><h1>T</h1><p>{W}</p><p>{W}</p></div>", ["T", W, W]),
        (f"<table><tr><td>{LINKS}</td><td><h1>T</h1><p>{W}</p>{LINKS}<p>{W}</p></td><td><a href=1>Buy this now</a></td></tr></table>", ["T", W, W]),
        (f"<div><p>{W}</p><ul><li>one</li><li>two <a href=2>b</a></li></ul><pre>code</pre><blockquote>q</blockquote><p>{W}</p></div>", [W, "one", "two b", "code", "q", W]),
    ],
)
def test_hand_written_truth(page, wanted):
    assert main_text(f"<html><body>{page}</body></html>").split("\n") == wanted


@pytest.mark.parametrize("page", ["<a" * 100_000, "<b>x" * 20_000 + "</i>" * 20_000, "<a href=\"" * 20_000, "<a href='\">" * 20_000, "<a " + "a" * 200_000 + " b=>x", "<h1><header>" * 10_000, "<i>" + "<div><b>" * 10_000 + "</i>" * 10_000, "<!--" * 50_000, "<li>x" * 20_000, "<p>" + "word " * 1_000_000])
def test_odd_and_very_long_pages_take_linear_time(page):
    started = time.process_time()
    main_text(page)
    assert time.process_time() - started < 5
