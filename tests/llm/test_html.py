import html
import math
import re

import pytest
from pyspark.sql import functions as F

from newsflow.llm import html as module
from newsflow.llm.html import densities, extract, main_node, main_text, parse

PAGE = """<html><head><title>T &amp; x</title></head><body><header class="site"><h1>Site</h1></header>
<nav><a href=1>Home</a><div class="cookie-notice">We use cookies to do long things, more and more</div>
<main><article class="post"><header><h1>Title &lt;one&gt;</h1></header><p>First  para<br>graph
<a href="x">link</a>.</p><div class="ad-slot">Buy now</div><section><h2>Sub</h2><p>Second.<p>Third</section>
<ul><li>a<li>b</ul><form><label>x</label><input value="</p>"></form>
<section id="comments"><h3>Comments</h3><p>First! this is a very long reader comment, denser than the rest</p>
</section></article><aside>Side stuff</aside></main><footer>foot</footer></body></html>"""


def test_article_without_what_surrounds_it():
    assert extract(PAGE) == "Title <one>\nFirst para graph link.\nSub\nSecond.\nThird\na\nb"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain text &amp; more", "plain text & more"),
        ("<p>a</p>b<div>c d</div>", "a\nb\nc d"),
        ("<", "<"),
        ("a < b <p", "a < b"),
        ("<script>x</script>", ""),
        ("<!-- never closed <p>x</p>", ""),
        ("<style>p{}</style><p>x &copy;&#233;&nbsp;y</p>", "x ©é y"),
        ("<nav>menu</nav>", ""),
        ("<p title=\"a>b\">c</p><p hidden>d</p><p style='display: none'>e</p>", "c"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_odd_pages(page, text):
    assert extract(page) == text


@pytest.mark.parametrize(
    "name, kept",
    [
        ("main-menu", False), ("commentlist", False), ("post-comments", False), ("entry-header", True),
        ("header", False), ("has-sidebar", True), ("article-content", True), ("sponsored_box", False),
        ("shade", True), ("advertisement", False), ("content footer", False), ("headline", True),
    ],
)
def test_names_of_what_surrounds_an_article(name, kept):
    page = f"<body><article><p>first text</p><div class='{name}'><p>other text</p></div></article></body>"
    assert extract(page) == ("first text\nother text" if kept else "first text")


def test_an_unclosed_menu_does_not_swallow_the_article():
    page = "<body><nav><ul><li><a href=x>Home</a><article><h1>T</h1><p>text</p></article>"
    assert extract(page) == "T\ntext"
    teaser = "<aside class=related><article><p>teaser text, long enough to count</p></article></aside>"
    assert extract(f"<body><article><h1>T</h1><p>text</p></article>{teaser}") == "T\ntext"


def test_dense_siblings_join_and_links_do_not():
    body = "".join(f"<div><p>{'word ' * 60}{k}</p><p>short</p></div>" for k in range(3))
    links = "<div>" + "".join(f"<a href=x>topic {k}</a> " for k in range(30)) + "</div>"
    got = extract(f"<html><body><div>{links}</div><div>{body}</div></body></html>")
    assert got.count("short") == 3 and "topic" not in got


def paragraphs(name, n, size):
    return "".join(f"<p>{name}{k} {'w' * (size - 4)}</p>" for k in range(n))


@pytest.mark.parametrize("wrap", ["<html><body>{}</body></html>", "{}"])
@pytest.mark.parametrize(
    "sections",
    [[(3, 200), (3, 200)], [(4, 200), (4, 200)], [(10, 200), (8, 200), (6, 200), (3, 200)], [(10, 220), (9, 160)]],
)
def test_an_article_in_sections_directly_under_body(sections, wrap):
    links = "<div>" + "".join(f"<a href=x>topic {k}</a> " for k in range(30)) + "</div>"
    body = "".join(f"<section><h2>S{i}</h2>{paragraphs(f's{i}', n, size)}</section>" for i, (n, size) in enumerate(sections))
    got = extract(wrap.format(f"{links}<h1>Title</h1>{body}{links}"))
    want = ["Title"]
    for i, (n, size) in enumerate(sections):
        want += [f"S{i}", *(f"s{i}{k} {'w' * (size - 4)}" for k in range(n))]
    assert got == "\n".join(want)


def test_headings_and_loose_text_directly_under_body():
    text = paragraphs("p", 4, 200)
    lines = [f"p{k} {'w' * 196}" for k in range(4)]
    page = f"<body><div><h1>Title</h1></div><p>By me</p><h2>Part</h2><div class=content>{text}</div><h2>Links</h2>"
    page += "<ul><li><a href=x>one</a><li><a href=x>two</a></ul></body>"
    assert extract(page) == "\n".join(["Title", "Part", *lines])
    loose = "loose words " * 20
    page = f"<body><div>{text}</div>{loose}<b>bold</b> <a href=x>link</a> end<div><a href=x>Home</a></div> | </body>"
    assert extract(page) == "\n".join([*lines, f"{loose}bold link end"])


def test_density_of_links_is_lower():
    root, pieces = parse("<body><p>" + "x" * 100 + "</p><p><a>" + "x" * 100 + "</a></p></body>")
    found = [n.density for n in densities(root, pieces) if n.tag == "p"]
    assert found[0] > found[1]


def test_pages_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for row in main_text(pages).collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>)", row.html, re.S)[1]
        blocks = re.split(r"</?(?:h1|p)>", inner)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
        assert row.text == "\n".join(b for b in blocks if b)
        assert row.n_chars == len(row.text)


def test_frame_edges(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, "<p>x</p>"), (1, "u", None)], "page_id long, url string, html string")
    df = df.withColumn("TEXT", F.lit("own")).withColumn("n_chars", F.lit("own"))
    got = main_text(df)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((r.text, r.n_chars) for r in got.collect()) == [("", 0), ("", 0), ("x", 1)]
    assert main_text(df.limit(0)).count() == 0


def plain_densities(root, pieces):
    """Composite text density of each node, counted anew from all pieces and nodes below it."""

    def below(x):
        return [x] + [y for c in x.children if not c.noise for y in below(c)]

    def characters(x, linked):
        inside, total = {id(y) for y in below(x)}, 0
        for node, text in pieces:
            if not text or node.noise or id(node) not in inside:
                continue
            up, link = node, False
            while up is not None:
                link, up = link or up.tag == "a", up.parent
            share = 1 if link else module.MARK if node.marked else 0
            total += len(re.sub(r"\s", "", text)) * (share if linked else 1)
        return total

    share = characters(root, True) / max(characters(root, False), 1)
    out = {}
    for x in below(root):
        c, lc = characters(x, False), max(characters(x, True), 1)
        under = below(x)[1:]
        t, lt = max(len(under), 1), max(sum(y.tag == "a" or y.marked for y in under), 1)
        density = 0.0
        if c and c * t > lc * lt:
            base = math.log(c / max(c - characters(x, True), 1) * lc + share * c + math.e)
            density = c / t * math.log(c * t / (lc * lt), base)
        out[id(x)] = density
    return out


def some_pages(spark, sf_dir, step=7):
    return [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").collect()][::step]


def test_density_and_core_equal_a_plain_version(spark, sf_dir):
    for page in [PAGE, *some_pages(spark, sf_dir)]:
        root, pieces = parse(page)
        nodes = densities(root, pieces)
        want = plain_densities(root, pieces)
        assert {id(x) for x in nodes} == set(want)
        assert all(x.density == pytest.approx(want[id(x)], rel=1e-6, abs=1e-9) for x in nodes)
        _, path = main_node(root, nodes)
        total = {id(x): sum(want[id(c)] for c in x.children if not c.noise) for x in nodes}
        assert total[id(path[0])] == pytest.approx(max(total.values()))


def shown(page):
    """All text that is shown."""
    root, pieces = parse(page)
    blocks = [[]]
    for node, text in pieces:
        if text is None:
            blocks.append([])
        elif not node.noise:
            blocks[-1].append(text)
    return "\n".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))


def test_density_decides_what_is_read(spark, sf_dir):
    pages = some_pages(spark, sf_dir, 1)
    assert all(extract(p) != shown(p) for p in pages)


def test_pages_without_telling_tags_and_names(spark, sf_dir, monkeypatch):
    """Every element around the article is a div of a neutral name."""
    pages = some_pages(spark, sf_dir, 1)
    want = [extract(p) for p in pages]
    monkeypatch.setattr(module, "_marked", lambda *a: False)
    neutral = [re.sub(r"<(/?)(?:nav|article|footer)>", r"<\1div>", p).replace('class="ad"', "") for p in pages]
    got = [extract(p) for p in neutral]
    # menus go; a line of advert or footer stays where the article is no denser, and a page with
    # next to no article has nothing to tell it by
    lines = [(set(a.split("\n")), set(b.split("\n"))) for a, b in zip(want, got)]
    assert sum(a <= b and len(b - a) <= 2 for a, b in lines) > 0.95 * len(pages)
    assert sum(a == b for a, b in zip(want, got)) > 0.35 * len(pages)


@pytest.mark.parametrize("name", ["x1", "blk", "zone"])
def test_neutral_names_around_a_dense_article(name):
    links = "".join(f"<li><a href=x>Topic {k}</a></li>" for k in range(12))
    body = "".join(f"<p>{'sentence after sentence ' * 12}{k}</p>" for k in range(5))
    page = f"<body><div class={name}><ul>{links}</ul></div><div class={name}>Buy one, get one free today.</div>"
    page += f"<div class={name}><h1>Heading</h1>{body}<ul>{links}</ul></div><div class={name}>Imprint and terms</div></body>"
    want = ["Heading", *(f"{'sentence after sentence ' * 12}{k}" for k in range(5))]
    assert extract(page) == "\n".join(want)
