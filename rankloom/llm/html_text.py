"""Main text of web pages by tree scoring.

One pass over the markup builds the element tree and its text blocks (runs of inline text between block elements). A
block is worth a point, one more for each comma and up to three for its length, discounted by the share of its characters
inside links; it passes its points to its ancestors, all to the nearest container, half to the next and less and less
further up. The container with most points wins, or the whole article it stands in, and siblings that score well, long
plain paragraphs and headings beside it are kept. What is never main text gives no blocks at all: menus, page headers and
footers, asides, forms, scripts, styles, hidden parts, and elements whose class, id or role says advert, sidebar, comment,
notice and so on. Words that may as well be about an article's own parts (WEAK) don't drop its paragraphs and tables. Lists
that are nearly all links go where there is no article or main element around them; inside one they are its references.

Cases: of containers with equal points the first one counts; null or empty html gives an empty text; broken markup (unclosed or stray tags, missing ends, open comments) is
read on as far as it goes, in time that grows with its length; a box with a doubtful name (DOUBTFUL) is kept where it holds most
of the page's text; pages without paragraphs give the text of what is left of the body; parsing is never recursive; rows may repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.shared import column, free_name, table
from rankloom.llm.textbatch import groups_of, map_arrow

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
    math semantics mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle merror mpadded mphantom mfenced mspace
    annotation annotation-xml""".split()
)
DROPPED = frozenset(
    "head nav footer aside form script style noscript iframe button select option textarea input template svg canvas object embed audio video map dialog menu fieldset title annotation annotation-xml noembed noframes".split()
)
PARAGRAPH = frozenset("p pre blockquote li dt dd td th h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT_WHOLE = frozenset("html body article main".split())
AGAINST = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist
    consent contentinfo cookie cookies copyright disqus discussion footer gdpr header hidden masthead menu modal nav navbar navigation
    navigationbar newsletter notice notices overlay pager pagination paywall popup promo promoted promotion related replies reply
    responses share sharing shoutbox sidebar sidebars signup skyscraper social sponsor sponsored sponsor subscribe subscription tags
    toc toolbar topbar widget complementary search alert""".split()
)
#: These count against boxes, but not against paragraphs, tables and the like inside an article.
WEAK = frozenset("alert complementary copyright discussion header hidden overlay related reply replies responses search social tags toc".split())
#: A box named by these alone is kept if it holds most of the page's text.
DOUBTFUL = frozenset("alert banner header hidden overlay search share social tags toc widget".split())
FOR = frozenset("article articlebody body content entry main post story text".split())
ENDED_BY = {  # an open element of the key ends where one of these begins
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]),
    "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"]),
}
WALL = frozenset("ul ol dl table tr div section article main body html td th".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
REST = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[a-z]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def unwanted(tag: str, attributes: str, in_article: bool) -> str:
    """Why an element is no main text by its tag or attributes: surely, doubtful (for names in DOUBTFUL alone), or nothing."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return "surely"
    if not attributes or tag in ("html", "body"):
        return ""
    words: set[str] = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and UNSEEN.search(value)):
            return "surely"
        if name in ("class", "id", "role"):
            words.update(WORDS.findall(CAMEL.sub(" ", value).lower()))
    if tag in KEPT_WHOLE:
        return "surely" if words & {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "promo", "related", "sponsored"} and not words & FOR.difference(["body", "text"]) else ""
    if tag == "header":
        words -= {"header"}
    if in_article and (tag in PARAGRAPH or tag in INLINE or tag == "table"):
        words -= WEAK
    if words & {"comment", "comments", "commentlist"}:
        return "surely"
    against = words & AGAINST if not words & FOR.difference(["text", "body"]) else set()
    return ("doubtful" if against <= DOUBTFUL else "surely") if against else ""


class Page:
    """The element tree and text blocks of one page."""

    def __init__(self, source: str, trusting: bool = False):
        """trusting: drop nothing for a doubtful name."""
        self.trusting, self.doubtful = trusting, 0  # characters (without spaces) dropped for doubtful names
        self.tags, self.parents, self.ends = ["#"], [-1], [0]
        self.holders = [0]  # the block element of each element
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters inside links
        self._read(source)
        self.ends[0] = len(self.tags)

    def _read(self, source: str) -> None:
        tags, parents, ends, holders, stack = self.tags, self.parents, self.ends, self.holders, [0]
        # Depths in the stack, the deepest last: of each tag, of blocks, of blocks other than paragraphs, and of walls
        where: dict[str, list[int]] = {}
        blocks, stops, walls = [0], [0], [0]
        buffer: list[str] = []
        links = in_link = articles = 0
        soft = False  # whether what is dropped now is dropped for a doubtful name
        drop_from = -1  # depth of the stack at which an unwanted element began

        def flush() -> None:
            nonlocal links
            if buffer:
                text = " ".join("".join(buffer).split())
                if text:
                    self.blocks.append((holders[stack[-1]], text, links))
                buffer.clear()
            links = 0

        def pop() -> None:
            nonlocal in_link, drop_from, articles
            node = stack.pop()
            tag = tags[node]
            ends[node] = len(tags)
            where[tag].pop()
            for depths in (blocks, stops, walls):
                if depths[-1] == len(stack):
                    depths.pop()
            if tag == "a":
                in_link -= 1
            elif tag in ("article", "main"):
                articles -= 1
            if len(stack) == drop_from:
                drop_from = -1

        def close(tag: str, block: bool) -> None:
            if where.get(tag):
                if not block and where[tag][-1] < blocks[-1]:  # an inline end doesn't cross a block
                    return
                if block:
                    flush_if_kept()
                while tags[stack[-1]] != tag:
                    pop()
                pop()

        def flush_if_kept() -> None:
            if drop_from < 0:
                flush()

        def text(part: str) -> None:
            nonlocal links
            if drop_from < 0:
                if "&" in part:
                    part = html.unescape(part)
                buffer.append(part)
                if in_link:
                    links += len(part)
            elif soft:
                self.doubtful += len(part) - part.count(" ")

        at, n = 0, len(source)
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                text(source[at:])
                break
            if lt > at:
                text(source[at:lt])
            nxt = source[lt + 1 : lt + 2]
            if nxt == "!" or nxt == "?":
                if source.startswith("<!--", lt):
                    end = source.find("-->", lt + 4)
                    at = n if end < 0 else end + 3
                else:
                    end = source.find(">", lt)
                    at = n if end < 0 else end + 1
                continue
            closing = nxt == "/"
            name = NAME.match(source, lt + 1 + closing)
            if not name:
                if closing:
                    end = source.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    text("<")
                    at = lt + 1
                continue
            tag = name.group().lower()
            rest = REST.match(source, name.end())
            end = rest.end() if rest else source.find(">", name.end()) + 1
            if not end:
                break  # a tag that never ends
            at = end
            block = tag not in INLINE
            if closing:
                close(tag, block)
                continue
            if tag in VOID:
                if tag == "br":
                    text("\n")
                elif block:
                    flush_if_kept()
                continue
            if tag in RAW:
                after = re.compile(rf"</{tag}\b", re.I).search(source, at)
                if after is None:
                    break
                close_at = source.find(">", after.end())
                at = n if close_at < 0 else close_at + 1
                continue
            if block:
                flush_if_kept()
                if where.get("p") and where["p"][-1] > walls[-1]:  # a block ends an open paragraph
                    depth = where["p"][-1]
                    while len(stack) > depth:
                        pop()
                while tag in ENDED_BY.get(tags[stack[stops[-1]]], ()):
                    depth, t = stops[-1], tags[stack[stops[-1]]]
                    while len(stack) > depth:
                        pop()
                    if tag in ("li", "dt", "dd", "option", "optgroup") or t in ("tr", "tbody", "thead"):
                        break
            elif tag == "a" and in_link:
                close("a", False)
            node = len(tags)
            tags.append(tag)
            parents.append(stack[-1])
            ends.append(node + 1)
            holders.append(node if block else holders[stack[-1]])
            if drop_from < 0 and (why := unwanted(tag, source[name.end() : end - 1], articles > 0)) and not (self.trusting and why == "doubtful"):
                if block:
                    flush()
                drop_from, soft = len(stack), why == "doubtful"
            where.setdefault(tag, []).append(len(stack))
            for depths, belongs in ((blocks, block), (stops, block and tag != "p"), (walls, tag in WALL)):
                if belongs:
                    depths.append(len(stack))
            stack.append(node)
            if tag == "a":
                in_link += 1
            elif tag in ("article", "main"):
                articles += 1
            if source[end - 2] == "/" and tag in ("svg", "path"):
                pop()
        flush_if_kept()
        while len(stack) > 1:
            pop()

    def scores(self) -> dict[int, float]:
        points: dict[int, float] = {}
        for node, text, links in self.blocks:
            worth = (1 + text.count(",") + min(len(text) / 100, 3)) * max(0.0, 1 - links / len(text))
            if self.tags[node] in PARAGRAPH:
                node = self.parents[node]
            share = 1.0
            for level in range(6):
                if node <= 0:
                    break
                points[node] = points.get(node, 0.0) + worth * share
                node, share = self.parents[node], 1 / 2 if level == 0 else 1 / (3 * (level + 1))
        return points

    def main_text(self) -> str:
        if not self.blocks:
            return ""
        points = self.scores()
        starts, articleless = {0}, True
        if points:
            best = max(points, key=lambda k: (points[k], -k))
            top, node = best, best
            while node > 0:
                if self.tags[node] == "article" or (self.tags[node] == "main" and self.tags[top] != "article"):
                    top = node
                node = self.parents[node]
            starts, articleless = {top}, self.tags[top] not in ("article", "main")
            if self.tags[top] != "article":
                starts.update(self._siblings(top, points, best))
        lists, inside = self._link_lists() if articleless else set(), [False] * len(self.tags)
        for node, parent in enumerate(self.parents):  # parents come before their children
            inside[node] = node not in lists and (node in starts or (parent >= 0 and inside[parent]))
        return "\n\n".join(text for node, text, _ in self.blocks if inside[node])

    def _siblings(self, top: int, points: dict[int, float], best: int) -> list[int]:
        parent, enough = self.parents[top], max(10.0, 0.2 * points[best])
        if parent < 0:
            return []
        size: dict[int, list[int]] = {}
        for node, text, links in self.blocks:
            if self.parents[node] == parent:
                own = size.setdefault(node, [0, 0])
                own[0] += len(text)
                own[1] += links
        titles = self._titles(parent, top)
        found, node = [], parent + 1
        while node < self.ends[parent]:
            if self.parents[node] == parent and node != top:
                length, links = size.get(node, (0, 0))
                tag = self.tags[node]
                if points.get(node, 0) >= enough or tag in HEADING or node in titles or (tag == "p" and length and links < 0.25 * length and (length > 80 or links == 0)):
                    found.append(node)
            node = self.ends[node]
        return found

    def _titles(self, parent: int, top: int) -> set[int]:
        """The children of `parent` in front of `top` that hold a main heading (h1, h2) and nothing else."""
        child = {}
        for node in range(parent + 1, top):
            child[node] = node if self.parents[node] == parent else child.get(self.parents[node], -1)
        only: dict[int, bool] = {}
        for node, _, links in self.blocks:
            if parent < node < top:
                only[child[node]] = only.get(child[node], True) and self.tags[node] in ("h1", "h2") and not links
        return {node for node, good in only.items() if good}

    def _link_lists(self) -> set[int]:
        """Outermost lists of three items or more that are nearly all links."""
        outer = [-1] * len(self.tags)
        for node, parent in enumerate(self.parents):
            outer[node] = outer[parent] if parent >= 0 and outer[parent] >= 0 else node if self.tags[node] in ("ul", "ol") else -1
        sums: dict[int, list[int]] = {}
        for node, text, links in self.blocks:
            if outer[node] >= 0:
                own = sums.setdefault(outer[node], [0, 0, 0])
                own[0] += 1
                own[1] += len(text)
                own[2] += links
        return {node for node, (items, length, links) in sums.items() if items >= 3 and links >= 0.8 * length}


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    if page.doubtful > 2 * sum(len(text) for _, text, _ in page.blocks):  # no ornament holds most of a page
        page = Page(source, trusting=True)
    return page.main_text()


def extract_pages(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """keep and text (the main text) for every page; keep must not hold a column named text."""
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups_of(batch, len(keep)):
                texts = [main_text(h) for h in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    return map_arrow(pages.select(*map(column, keep), column(html_col).alias(free_name(pages, "source"))), run, schema)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
