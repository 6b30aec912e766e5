import random

import pytest

from rankloom.llm.html_text import extract_pages, main_text

P = "A paragraph with words, commas, and enough of both to look like the body of an article."
PAGE = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body class="home"><header id="top"><h1>Site</h1><ul><li><a href=1>a</a><li><a>b</a></ul></header>
<nav><p>{P}</p></nav><div id="wrap"><div class="sidebar"><p>{P}</p></div><div class="post-content"><h1>Title &amp; co</h1><p>{P} <a href="x">a link</a> and <b>bold</b>text.</p><div class="ad">buy now</div>
<blockquote>Quoted,<br>text</blockquote><ul><li>one</li><li>two, three</li></ul><form><input><label>name</label></form><p hidden>nope</p><p style="display: none">nope</p><table><tr><td>c1<td>c2</table><p>Last&nbsp;one.</div>
<section id="comments"><article class="comment"><p>{P}</p></article></section></div><div class="cookie-notice">{P}</div><script>var t="</p><p>{P}</p>";</script><footer>foot</footer></body>"""


def test_a_page_with_everything():
    assert main_text(PAGE).split("\n\n") == ["Title & co", f"{P} a link and boldtext.", "Quoted, text", "one", "two, three", "c1", "c2", "Last one."]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain &lt;b&gt; text", "plain <b> text"), ("<p>a<p>b<", "a\n\nb<"), ("<p>x<!-- open", "x"), ("<p>x<script>never ends", "x"),
        ("<div>" * 3000 + "x" + "</div>" * 3000, "x"), ("<b>" * 3000 + "x", "x"), ("</div></p></b>x", "x"), ("<article><p>one</p>", "one"), ("<p>1 &#233;&#x41; &copy &nosuch;</p>", "1 éA © &nosuch;"),
        ("<ARTICLE><P CLASS='x'>Up</P></ARTICLE>", "Up"), ("<p>a\n\t b<br/>c</p>", "a b c"), ("<nav>only</nav>", ""), ("<article><h1>T</h1><p><b>T.<br><p>next</p></article><footer>f</footer>", "T.\n\nnext"[:0] + "T\n\nT.\n\nnext"),
        ("<article><header><h1>T</h1></header><p>x</p><footer>by</footer></article>", "T\n\nx"), ("<p>" + "long " * 100_000 + "</p>", ("long " * 100_000).strip()), ('<p>a</p><p title="a > b">c</p>', "a\n\nc"),
    ],
)
def test_cases(html, text):
    assert main_text(html) == text


def test_link_lists_go_and_sibling_containers_stay():
    links = "<ul>" + "".join(f"<li><a href={i}>link {i}</a></li>" for i in range(5)) + "</ul>"
    assert main_text(f"<div><p>{P}</p>{links}<p>{P}</p></div>") == f"{P}\n\n{P}"
    assert main_text(f"<body><div><div><p>{P}</p><p>{P}</p></div><div><p>{P}</p><p>{P}</p></div></div></body>").count(P) == 4


def test_parts_of_an_article_stay():
    links = "".join(f"<li><a href={i}>source {i}</a></li>" for i in range(4))
    html = f"""<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p><p class="alert">{P}</p><p class="toc">{P}</p><p id="search">{P}</p>
      <table id="tags"><tr><td>cell</td></tr></table><div class="toc"><p>{P}</p></div><p class="advert">{P}</p><h2>References</h2><ol>{links}</ol></article>"""
    assert main_text(html).split("\n\n") == ["So x=2 holds.", P, P, P, "cell", "References", "source 0", "source 1", "source 2", "source 3"]


def grown(rng, depth=0):
    """A random tree of boxes and paragraphs: (tag, children or (text, text in a link))."""
    if depth and (depth > 4 or rng.random() < 0.45):
        words = " ".join(rng.choice(["alpha", "beta,", "gamma", "delta,", "epsilon"]) for _ in range(rng.randint(1, 40)))
        return rng.choice("p p p h2 pre".split()), (words, "linked words here" if rng.random() < 0.2 else "")
    tags = "div section div article" if depth else "div"
    return rng.choice(tags.split()), [grown(rng, depth + 1) for _ in range(rng.randint(1, 4))]


def rendered(node):
    tag, inner = node
    body = "".join(map(rendered, inner)) if isinstance(inner, list) else inner[0] + (f" <a href=x>{inner[1]}</a>" if inner[1] else "")
    return f"<{tag}>{body}</{tag}>"


def by_definition(root):
    """The scoring as the module's description has it, on the tree itself: each container sums over all blocks below it."""
    nodes = []  # (tag, parent, block)

    def walk(node, parent):
        tag, inner = node
        at = len(nodes)
        nodes.append((tag, parent, inner if isinstance(inner, tuple) else None))
        for child in inner if isinstance(inner, list) else ():
            walk(child, at)

    walk(root, None)

    def chain(i):
        out = []
        while i is not None:
            out.append(i)
            i = nodes[i][1]
        return out

    text = lambda b: f"{b[0]} {b[1]}".strip()
    worth = lambda b: (1 + text(b).count(",") + min(len(text(b)) / 100, 3)) * (1 - len(b[1]) / len(text(b)))
    shares = [1, 1 / 2, 1 / 6, 1 / 9, 1 / 12, 1 / 15]
    points = {}
    for i, (_, _, b) in enumerate(nodes):
        if b:
            for up, share in zip(chain(i)[1:], shares):
                points[up] = points.get(up, 0) + worth(b) * share
    best = min((k for k in points if points[k] > max(points.values()) - 1e-12), default=None)
    if best is None:
        return text(nodes[0][2])
    articles = [i for i in chain(best) if nodes[i][0] == "article"]
    top = articles[-1] if articles else best
    chosen = {top}
    if not articles and nodes[top][1] is not None:
        for i, (tag, parent, b) in enumerate(nodes):
            if parent == nodes[top][1] and i != top:
                plain = b and tag == "p" and len(b[1]) < 0.25 * len(text(b)) and (len(text(b)) > 80 or not b[1])
                held = [(t, b) for k, (t, _, b) in enumerate(nodes) if b and i in chain(k)]
                title = i < top and held and all(t in ("h1", "h2") and not b[1] for t, b in held)
                if points.get(i, 0) >= max(10, 0.2 * points[best]) or tag == "h2" or plain or title:
                    chosen.add(i)
    return "\n\n".join(text(b) for i, (_, _, b) in enumerate(nodes) if b and chosen & set(chain(i)))


def test_tree_scoring_by_definition():
    rng = random.Random(11)
    for _ in range(1500):
        tree = grown(rng)
        assert main_text(rendered(tree)) == by_definition(tree), rendered(tree)


def test_operator(spark):
    from pyspark.sql import functions as F

    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, None, None), (3, "v", PAGE), (None, "w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(2)
    found = sorted((r.page_id or 0, r.text) for r in extract_pages(pages, ["page_id", "url"]).collect())
    assert [t for _, t in found][:4] == ["", "a", "a", ""] and found[4][1] == main_text(PAGE)
    assert extract_pages(pages.where("page_id > 9"), ["page_id"]).count() == 0


def test_a_box_with_a_doubtful_name_may_hold_the_article():
    body = "".join(f"<p>{'A long sentence, with commas, goes on. ' * 5}</p>" for _ in range(4))
    for box in ('<div id="search-results">', '<section class="social-story tags">', '<div class="page-overlay">', '<div class="hidden">'):
        assert main_text(f"<body><p>Home</p>{box}{body}</div></body>").count("A long sentence") == 20, box
    small = main_text(f'<body><div>{body}</div><div class="search"><p>Find, here, things</p></div></body>')
    assert small.count("A long sentence") == 20 and "Find" not in small


def test_a_title_in_a_box_of_its_own():
    body = "".join(f"<p>{'A long sentence, with commas, goes on. ' * 5}</p>" for _ in range(3))
    page = f'<body><div><div class="article-header"><h1>Title</h1></div><div class="c">{body}</div><div><h3>Elsewhere</h3></div></div></body>'
    found = main_text(page)
    assert found.startswith("Title\n\nA long") and "Elsewhere" not in found


@pytest.mark.parametrize("make", [lambda n: "<b>" * n + "<p>x" * n, lambda n: "<i><div>" + "<b>" * n + "</i>" * n, lambda n: "<p>" * n + "<span>" * n + "<li>" * n, lambda n: "<table>" + "<td>" * n])
def test_hostile_pages_take_linear_time(make):
    import time

    took = []
    for n in (4000, 16_000):
        began = time.perf_counter()
        main_text(make(n))
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.2
