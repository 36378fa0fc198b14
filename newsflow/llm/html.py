"""Main text of web pages by composite text density.

Every DOM node gets its characters per tag, adjusted for links. The node whose children's
densities sum highest is the core; the lowest density on its path from the body is the
threshold by which other dense subtrees join it. Their lowest common ancestor is read out;
where that is the body or what holds it, the core's part of it and all that joins there are.
Inside, parts are left out that links leave next to no density.

Tags, roles and names are weights: the characters of an element that is marked as a menu, an
advert or the like count as characters in links, nearly all of them. So its density is low,
and the same thresholds decide. Only what is never shown as text, such as scripts, is left out
without asking. Reader comments are as dense as an article; nothing but their mark tells them.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsflow.llm.common import by_batches, free_name, quoted, ship

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)"
    r"(?:(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|(?P<broken>[^>]*)(?:>|\Z))"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.I
)
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p "
    "pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never shown as text.
_UNSEEN_TAGS = set(
    "head script style noscript template svg math canvas iframe object embed button select input "
    "textarea option title noembed noframes xmp".split()
)
#: Elements that mark what surrounds an article.
_NOISE_TAGS = set("nav aside footer form label dialog menu".split())
_NOISE_ROLES = set("navigation banner contentinfo complementary search alert dialog menu".split())
#: Parts of class or id names that mark what surrounds an article.
_NOISE_WORDS = set(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright disqus footer header login masthead menu modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promotion related replies reply share "
    "sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Names that begin so, such as "commentlist", mark the same.
_NOISE_STARTS = ("advert", "breadcrumb", "comment", "cookie", "newsletter", "sidebar", "sponsor")
#: With these parts, a name that also speaks of a header or the like is a part of the article;
#: with those, it tells what the element has, as in "has-sidebar".
_CONTENT_WORDS = set("article content entry main post story text body".split())
_SOFT_WORDS = {"header", "masthead", "copyright"}
_STATE_WORDS = set("has no with without is not".split())
_KEEPERS = {"html", "body", "article", "main"}
_TOPS = ("#root", "html", "body")
#: What lies directly in the body joins if it is so many times as dense as a part of the
#: sparsest node on the core's path below the body would be, of its size and with its links:
#: sections of one article differ in density, while lists of links have next to none.
LIKE = 0.5
#: The share of a marked element's characters that count as in links.
MARK = 0.99
#: A part of the core that links or marks leave less than this share of its density is left
#: out, if it is marked or a list of at least so many links.
LEFT, MANY_LINKS = 0.1, 3
#: What a start tag closes if it is still open, up to the given borders.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


class _Node:
    __slots__ = (
        "tag",
        "parent",
        "children",
        "noise",
        "marked",
        "chars",
        "tags",
        "link_chars",
        "links",
        "density",
    )

    def __init__(self, tag, parent, noise, marked):
        self.tag, self.parent, self.noise, self.marked = tag, parent, noise, marked
        self.children = []
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = 0.0


def _unseen(tag: str, rest: str) -> bool:
    """Whether an element is never shown as text."""
    if tag in _KEEPERS:
        return False
    if tag in _UNSEEN_TAGS:
        return True
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _marked(tag: str, rest: str, inside: set) -> bool:
    """Whether an element's tag, role or names speak against its being main text."""
    if tag in _KEEPERS:
        return False
    if tag in _NOISE_TAGS or (tag == "header" and not inside & {"article", "main"}):
        return True
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in _NOISE_ROLES:
            return True
        if name in ("class", "id"):
            for word in value.split():
                parts = set(re.split(r"[-_]+", word))
                if parts & _STATE_WORDS:
                    continue
                found = parts & _NOISE_WORDS
                if parts & _CONTENT_WORDS:
                    found -= _SOFT_WORDS
                if found or any(p.startswith(_NOISE_STARTS) for p in parts):
                    return True
    return False


def parse(page: str):
    """The root node and, in page order, (node, text) pieces; a text of None is a border
    between blocks. Broken nesting is repaired as far as the article needs it."""
    root = _Node("#root", None, False, False)
    node, at, pieces, size = root, 0, [], len(page)
    seen_article = False
    open_tags = {"#root": 1}

    def leave(until):
        nonlocal node
        while node is not until:
            open_tags[node.tag] -= 1
            if node.tag in _BLOCK:
                pieces.append((node, None))
            node = node.parent

    def closing(tags, borders):
        """The innermost open element of ``tags`` inside the borders."""
        x = node
        while x.parent is not None and x.tag not in borders:
            if x.tag in tags:
                return x
            x = x.parent
        return None

    while at < size:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            pieces.append((node, html.unescape(page[at:stop])))
        if not m:
            break
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["close"]:
            if open_tags.get(tag):
                x = node
                while x.tag != tag:
                    x = x.parent
                leave(x.parent)
            if tag in _BLOCK:
                pieces.append((node, None))
            continue
        if tag in ("html", "body", "head") and open_tags.get(tag):
            continue
        if tag == "body" and open_tags.get("head"):
            x = closing({"head"}, ())
            leave(x.parent)
        if tag in ("article", "main"):
            # a menu or the like that was never closed must not swallow the first article
            x, outermost = (root if seen_article else node), None
            seen_article = True
            while x.parent is not None:
                if x.noise or x.marked:
                    outermost = x
                x = x.parent
            if outermost:
                leave(outermost.parent)
        elif tag in _BLOCK and open_tags.get("p"):
            x = closing({"p"}, {"button", "td", "th", "table", "article", "body"})
            if x:
                leave(x.parent)
        if tag in _CLOSES:
            x = closing(*_CLOSES[tag])
            if x:
                leave(x.parent)
        rest = m["rest"] or m["broken"] or ""
        inside = {t for t in ("article", "main") if open_tags.get(t)}
        noise = node.noise or _unseen(tag, rest)
        child = _Node(tag, node, noise, node.marked or _marked(tag, rest, inside))
        node.children.append(child)
        if tag in _BLOCK:
            pieces.append((node, None))
        if tag == "br":
            pieces.append((node, " "))
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in _VOID and not rest.rstrip().endswith("/"):
            node = child
            open_tags[tag] = open_tags.get(tag, 0) + 1
        elif tag not in _VOID and tag in _BLOCK:
            node = child
            open_tags[tag] = open_tags.get(tag, 0) + 1
    return root, pieces


def _walk(root: _Node) -> list[_Node]:
    """All nodes, parents first."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(reversed(x.children))
    return out


def densities(root: _Node, pieces) -> list[_Node]:
    """Set the composite text density of every node that is not noise."""
    for node, text in pieces:
        if text and not node.noise:
            n = len("".join(text.split()))
            node.chars += n
            x = node
            while x is not None and x.tag != "a":
                x = x.parent
            if x is not None:
                node.link_chars += n
            elif node.marked:
                node.link_chars += MARK * n
    nodes = [x for x in _walk(root) if not x.noise]
    for x in reversed(nodes):
        if x.parent is not None:
            p = x.parent
            p.chars += x.chars
            p.link_chars += x.link_chars
            p.tags += x.tags + 1
            p.links += x.links + (x.tag == "a" or x.marked)
    share = root.link_chars / max(root.chars, 1)
    for x in nodes:
        x.density = _density(x.chars, x.tags, x.link_chars, x.links, share)
    return nodes


def _density(chars: float, tags: float, link_chars: float, links: float, share: float) -> float:
    """``share`` is that of the characters in links in the whole page."""
    if not chars:
        return 0.0
    plain = max(chars - link_chars, 1)
    tags, link_chars, links = max(tags, 1), max(link_chars, 1), max(links, 1)
    base = math.log(chars / plain * link_chars + share * chars + math.e)
    ratio = chars * tags / (link_chars * links)
    return chars / tags * math.log(ratio) / math.log(base) if ratio > 1 else 0.0


def main_node(root: _Node, nodes: list[_Node]) -> tuple[_Node, list[_Node]]:
    """The lowest node below the body that holds the core and all subtrees dense enough to
    join it, and the path from the core up."""

    def total(x):
        return sum(c.density for c in x.children if not c.noise)

    live = [x for x in nodes if x.chars]
    if not live:
        return root, [root]
    core = max(live, key=lambda x: (total(x), x.density))
    path = []
    x = core
    while x is not None:
        path.append(x)
        x = x.parent
    threshold = min(x.density for x in path)
    # siblings of the path that are as dense as its sparsest node belong to the text, and an
    # article element is never cut
    lowest = core
    for up in path[1:]:
        if up.tag in _TOPS:
            break
        beside = [c for c in up.children if c not in path and not c.noise and c.chars]
        joins = any(c.density >= threshold for c in beside)
        if joins or up.tag in ("article", "main"):
            lowest = up
    return lowest, path


def sparse(x: _Node, share: float) -> bool:
    """Whether links and marks take nearly all of a part's density."""
    if not (x.marked or (x.tag in _BLOCK and x.links >= MANY_LINKS)) or not x.chars:
        return False
    return x.density <= LEFT * _density(x.chars, x.tags, 0, 0, share)


def _dense_part(top: _Node, share: float) -> float:
    """Characters per tag of a node without its sparse parts."""
    chars, tags, stack = top.chars, top.tags, list(top.children)
    while stack:
        x = stack.pop()
        if not x.noise and sparse(x, share):
            chars, tags = chars - x.chars, tags - x.tags - 1
        elif not x.noise:
            stack.extend(x.children)
    return chars / max(tags, 1)


def beside(root: _Node, pieces, lowest: _Node, path: list[_Node]) -> set[int]:
    """The pieces outside ``lowest`` that join it directly in the body, or in what holds it.

    Candidates are blocks, and runs of text and inline elements between blocks. Dense ones
    join, and headings of what is read: those with some of it ahead of the next heading of
    the same or a higher rank.
    """
    tops = {id(x) for x in path[path.index(lowest) + 1 :] if x.tag in _TOPS}
    under: dict[int, _Node] = {}
    for x in _walk(root):
        free = id(x) in tops or x.parent is None or id(x.parent) in tops
        under[id(x)] = x if free else under[id(x.parent)]
    blocks = {id(under[id(n)]) for n, text in pieces if text is None}
    blocks = (blocks | {id(u) for u in under.values() if u.tag in _BLOCK}) - tops
    # members of each candidate, and where its pieces are
    units: list[tuple[list[_Node], list[int]]] = []
    of_block: dict[int, int] = {}
    run = None
    for k, (node, text) in enumerate(pieces):
        u = under[id(node)]
        if id(u) in blocks:
            run = None
            at = of_block.setdefault(id(u), len(units))
            if at == len(units):
                units.append(([u], []))
            units[at][1].append(k)
        elif text is None:
            run = None
        elif not node.noise:
            if run is None:
                run = len(units)
                units.append(([], []))
            members, places = units[run]
            places.append(k)
            if id(u) not in tops and not any(u is m for m in members[-1:]):
                members.append(u)
    share = root.link_chars / max(root.chars, 1)
    # what lies in the body beside menus is measured by the path below it
    inner = [x for x in path if x.tag not in _TOPS] or path[:1]
    per_tag = min(_dense_part(x, share) for x in inner)
    on_path = {id(x) for x in path}

    def joins(members, places):
        if any(id(m) in on_path for m in members):
            return True
        chars = sum(len("".join((pieces[k][1] or "").split())) for k in places if not pieces[k][0].noise)
        single = len(members) == 1 and id(members[0]) in blocks
        tags = sum(m.tags + (not single) for m in members)
        links = sum(m.links + (not single and m.tag == "a") for m in members)
        linked = sum(m.link_chars for m in members)
        found = _density(chars, tags, linked, links, share)
        size = max(tags, 1)
        # of what is on the path, as many tags, with the links of this unit and without any
        like, plain = (
            _density(per_tag * size, size, *has, share) for has in ((linked, links), (0, 0))
        )
        return found > 0 and found >= max(LIKE * like, LEFT * plain)

    def rank(members):
        """That of a heading which is all the text of a unit, else 0."""
        x = members[0] if len(members) == 1 and not members[0].marked else None
        while x is not None and not re.fullmatch("h[1-6]", x.tag):
            x = next((c for c in x.children if not c.noise and c.chars and c.chars == x.chars), None)
        return int(x.tag[1]) if x is not None and x.chars else 0

    kept = [joins(*u) for u in units]
    # the least rank of the headings between here and the next that is read; 0 if nothing is
    reach = 0
    for k in range(len(units) - 1, -1, -1):
        if found := rank(units[k][0]):
            kept[k] = kept[k] or reach > found
            reach = min(reach, found)
        elif kept[k]:
            reach = 7
    out = set()
    for (members, places), joined in zip(units, kept):
        # of the path's own block, only what ``lowest`` holds is read
        if joined and not (len(members) == 1 and id(members[0]) in on_path and id(members[0]) in blocks):
            out.update(places)
    return out


def extract(page: str | None) -> str:
    """The main text: white space inside a block is one space, blocks are lines."""
    if not page:
        return ""
    root, pieces = parse(page)
    top, path = main_node(root, densities(root, pieces))
    joined = beside(root, pieces, top, path) if top is not root else set()
    share = root.link_chars / max(root.chars, 1)
    out = {id(x) for x in _walk(top) if x is not top and not x.noise and sparse(x, share)}
    within: dict[int, bool] = {id(top): True} | dict.fromkeys(out, False)

    def inside(x):
        trail = []
        while x is not None and id(x) not in within:
            trail.append(x)
            x = x.parent
        found = x is not None and within[id(x)]
        for t in trail:
            within[id(t)] = found
        return found

    blocks, current = [], []
    for k, (node, text) in enumerate(pieces):
        if text is None:
            if current:
                blocks.append(" ".join("".join(current).split()))
                current = []
        elif not node.noise and (k in joined or inside(node)):
            current.append(text)
    if current:
        blocks.append(" ".join("".join(current).split()))
    return "\n".join(b for b in blocks if b)


def main_text(pages: DataFrame, html_column: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page in ``to`` and its code points in
    ``n_chars``; columns of these names are replaced.

    A null or empty page, and one without text outside menus and the like, gives an empty
    text. Rows are independent: repeated rows and null ids need nothing special.
    """
    ship(pages.sparkSession)
    rest = [c for c in pages.columns if c.lower() not in (to.lower(), "n_chars")]
    hidden = free_name(pages, "html_read")
    source = pages.select(*[quoted(c) for c in rest], quoted(html_column).alias(hidden))
    schema = source.drop(hidden).schema.add(to, "string")

    def run(batches):
        for batch in batches:
            found = batch.column(batch.schema.get_field_index(hidden)).to_pylist()
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            texts = pa.array([extract(h) for h in found], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, texts], schema.names)

    found = source.mapInArrow(by_batches("main text", run), schema)
    return found.withColumn("n_chars", F.length(to).cast("bigint"))
