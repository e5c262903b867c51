"""Main text of web pages, by container paths that the pages of a host agree on.

1. Each page is parsed, and its containers are scored by the text they hold directly and in paragraphs, less text in
   links. The path of tags and classes of the best containers, with numbers in names made general, is the page's vote.
2. Votes are added up per host and path in Spark; the path with the highest sum wins the host. Hosts that hold many
   rows are summed up in each task first.
3. Pages are parsed again. The elements at the winning path of their host, or at the page's own best path where the
   host's is absent, give the text, without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
   and reader comments. Where the container around them adds further text of the article, as headings, leads or sections
   beside them are, and neither mostly links nor much beside what is there, it is taken instead, and so on upwards. The winners are broadcast if they are
   measured to be small, else joined by host.

Names of classes mark what is no part of an article. An element that holds an article or nearly all of the page's text is
kept whatever its name says, in an article's headings and paragraphs only whole names count, and where marks would leave a
page without text, those names are passed over.

Inside a block, white space runs become one space; blocks are joined by one space. A NULL page or one without text
has the empty text; text outside of tags is the text of the body. Pages without a URL share one host. Repeated rows
are handled on their own. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import common

#: Hosts whose winners may be broadcast, with about 200 bytes each; more are joined by host.
BROADCAST_HOSTS = 50_000

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NUMBERS = re.compile(r"\d+")
PARTS = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")

# Fixed values of HTML: elements without content, with raw content, that stand in a line of text, and what they close.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SIBLINGS = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}),
    "thead": frozenset({"tr", "td", "th"}), "tbody": frozenset({"thead", "tbody", "tr", "td", "th"}),
    "tfoot": frozenset({"tbody", "tr", "td", "th"}),
}
#: Where the search for an open element to close ends.
SCOPE = frozenset("html body table td th div section article main aside ul ol dl blockquote".split())

#: Elements that a head may hold; any other ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template noframes object".split())
#: Elements that are no part of an article.
DROPPED = frozenset(
    "nav footer aside form script style noscript template svg math canvas iframe object embed applet audio video button "
    "select textarea input dialog menu head title".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar alert form".split())
#: Words in class names and ids that tell the same.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs sidebar footer masthead comment comments disqus cookie cookies consent gdpr notice "
    "notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations pagination pager toolbar widget widgets skip hidden paywall alert toplinks sitenav topbar colophon".split()
)
#: A word that also stands in the class names of an article's own heading, with one of the others.
HEAD_MARK, OWN = "header", frozenset("article entry post story content".split())
STATE = re.compile(r"(has|with|no|without|is)[-_]", re.IGNORECASE)
#: Class names and ids of reader comments.
COMMENT = re.compile(r"\scomments?([-_](?!open|closed|off|on\b)\S*)?\s|\sdisqus\S*\s", re.IGNORECASE)
#: Of these words those that count in an article's own headings and paragraphs, as whole class names.
INNER_MARKS = MARKS - frozenset("alert notice notices related comment comments header widget widgets banner hidden modal overlay".split())
#: Share of a page's text that a container with a marked name has to hold to be kept.
NEARLY_ALL = 0.8
#: Share of links up to which the text around an article's container may be part of the article.
LINKED = 1 / 3
#: Text that a container outside of an article may add, as a share of what is in it already.
BESIDE = 0.5
CONTAINERS = frozenset("article main section div td body blockquote".split())
PARAGRAPHS = frozenset("p li pre blockquote h1 h2 h3 h4 h5 h6 dd dt td th figcaption".split())


class Node:
    """An element: children are nodes and strings."""

    __slots__ = ("tag", "attributes", "children", "parent", "dropped")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list = []
        self.dropped = False

    def values(self) -> dict[str, str]:
        found = {}
        for name, a, b, c in ATTRIBUTE.findall(self.attributes):
            found.setdefault(name.lower(), unescape(a or b or c))
        return found

    def step(self) -> str:
        """The tag with its class names, numbers made general."""
        names = self.values().get("class", "").split() if self.attributes else []
        return ".".join([self.tag, *sorted(NUMBERS.sub("#", n.lower()) for n in names)])

    def path(self) -> str:
        steps, node = [], self
        while node.parent is not None:
            steps.append(node.step())
            node = node.parent
        return "/".join(reversed(steps))


def _marks(value: str) -> set[str]:
    return set(PARTS.split(CAMEL.sub(r"\1-\2", value).lower()))


def _boilerplate(node: Node, named: bool) -> bool:
    """Whether the element and all in it is no part of an article; ``named``: also by its class names and id."""
    if node.tag in DROPPED and not (node.tag == "form" and _wraps(node)):
        return True
    if node.tag in ("html", "body"):
        return False
    if not node.attributes:
        return False
    values = node.values()
    if values.get("role", "").lower() in ROLES or "hidden" in values or values.get("aria-hidden") == "true":
        return True
    style = values.get("style", "").replace(" ", "").lower()
    if "display:none" in style or "visibility:hidden" in style:
        return True
    if COMMENT.search(f" {values.get('class', '')} {values.get('id', '')} "):
        return True
    if not named or node.tag in ("article", "main") or not _marks(_names(values)) & MARKS:
        return False
    if node.tag in PARAGRAPHS and any(n.tag in ("article", "main") for n in _above(node.parent)):
        return not INNER_MARKS.isdisjoint(_names(values).lower().split())
    if any(n.tag in ("article", "main") and not COMMENT.search(f" {_names(n.values())} ") for n in below(node)):
        return False
    *_, root = _above(node)
    own = _plain_text(node)
    return not own or own < NEARLY_ALL * _plain_text(root)


def _plain_text(node: Node) -> int:
    """Letters outside of links and of elements that are dropped by their tag or as reader comments."""
    size, stack = 0, [node]
    while stack:
        for child in stack.pop().children:
            if not isinstance(child, Node):
                size += len(child.strip())
            elif child.tag != "a" and child.tag != "header" and (child.tag == "form" or child.tag not in DROPPED):
                if not (child.attributes and COMMENT.search(f" {_names(child.values())} ")):
                    stack.append(child)
    return size


def _wraps(form: Node) -> bool:
    """Whether a form holds an article or main, or most of the text in paragraphs of the page."""
    if any(n.tag in ("article", "main") and not COMMENT.search(f" {_names(n.values())} ") for n in below(form)):
        return True
    own = _paragraph_text(form)
    *_, root = _above(form)
    return own > 0 and 2 * own > _paragraph_text(root)


def _paragraph_text(node: Node) -> int:
    """Letters in the paragraphs of a node, without those of dropped elements other than forms."""
    size, stack = 0, [(node, False)]
    while stack:
        one, inside = stack.pop()
        inside = inside or one.tag == "p"
        for child in one.children:
            if not isinstance(child, Node):
                size += len(child.strip()) if inside else 0
            elif child.tag == "form" or child.tag not in DROPPED:
                stack.append((child, inside))
    return size


def _names(values: dict[str, str]) -> str:
    """Class names and the id, without those that tell what a page has or lacks."""
    names = (values.get("class", "") + " " + values.get("id", "")).split()
    return " ".join(n for n in names if not STATE.match(n))


def _heads(node: Node, named: bool) -> bool:
    """Headers go, but for one of an article that holds its heading."""
    marks = _marks(_names(node.values())) if node.attributes and named else set()
    if node.tag != "header" and (HEAD_MARK not in marks or node.tag in ("html", "body", "article", "main")):
        return False
    owned = bool(marks & OWN) or any(n.tag in ("article", "main") for n in _above(node))
    headed = any(n.tag in ("h1", "h2") for n in below(node))
    return not (owned and headed) and not any(n.tag in ("article", "main") for n in below(node))


def below(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        one = stack.pop()
        yield one
        stack.extend(c for c in reversed(one.children) if isinstance(c, Node))


def parse(page: str) -> Node:
    """The tree of a page; end tags that are missing are put where they are implied."""
    root = here = Node("", "", None)
    at, end = 0, len(page)
    while at < end:
        found = TAG.search(page, at)
        if found is None:
            here.children.append(page[at:])
            break
        if found.start() > at:
            here.children.append(page[at : found.start()])
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            if found[0].startswith("<![CDATA["):
                here.children.append(found[0][9:-3].replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if closing:
            node = here
            while node.parent is not None and node.tag != tag:
                node = node.parent
            # an end tag without its start, or of a line element around open blocks, is left out
            if node.parent is not None and not (tag in INLINE and _crosses(here, node)):
                here = node.parent
            continue
        if tag in CLOSES_P:
            here = _close(here, {"p"})
        if tag in SIBLINGS:
            here = _close(here, SIBLINGS[tag])
        if tag == "body" and any(n.tag == "body" for n in _above(here)):
            continue
        if tag not in IN_HEAD:
            here = _out_of_head(here)
        node = Node(tag, attributes.rstrip("/") if attributes else "", here)
        here.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            node.children.append(page[at : stop.start() if stop else end])
            at = stop.end() if stop else end
            continue
        here = node
    return root


def _out_of_head(here: Node) -> Node:
    """An element that cannot stand in the head ends an open one, but not within a template."""
    for node in _above(here):
        if node.tag == "template":
            break
        if node.tag == "head":
            return node.parent
    return here


def _above(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _crosses(here: Node, node: Node) -> bool:
    while here is not node:
        if here.tag not in INLINE:
            return True
        here = here.parent
    return False


def _close(here: Node, tags) -> Node:
    """Where an element that closes ``tags`` is put."""
    node, closed = here, None
    while node.parent is not None:
        if node.tag in tags:
            closed = node
        elif node.tag in SCOPE:
            break
        node = node.parent
    return closed.parent if closed is not None else here


def mark(root: Node, named: bool = True) -> None:
    """Marks elements that are no part of an article; ``named``: also by their class names and ids."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.dropped = _boilerplate(node, named) or _heads(node, named)
        if not node.dropped:
            stack.extend(c for c in node.children if isinstance(c, Node))


def candidates(root: Node) -> dict[str, float]:
    """Scores of container paths; ``mark`` comes first."""
    scores: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    stack = [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        size = 0
        for child in node.children:
            if isinstance(child, Node):
                if not child.dropped:
                    stack.append((child, linked))
            else:
                size += len(child) - child.count(" ") // 8 if not child.isspace() else 0
        if size:
            holder, share = node, -0.5 if linked else 1.0
            while holder.parent is not None and (holder.tag in PARAGRAPHS or holder.tag in INLINE or holder.tag not in CONTAINERS):
                holder = holder.parent
            weight = share
            for _ in range(3):  # the container, and with less weight those around it
                if holder.parent is None:
                    break
                key = id(holder)
                nodes[key] = holder
                scores[key] = scores.get(key, 0.0) + weight * size
                weight *= 0.4
                holder = holder.parent
                while holder.parent is not None and holder.tag not in CONTAINERS:
                    holder = holder.parent
    out: dict[str, float] = {}
    for key, s in scores.items():
        node = nodes[key]
        bonus = {"article": 3.0, "main": 1.5, "body": 0.7}.get(node.tag, 1.0)
        path = node.path()
        out[path] = out.get(path, 0.0) + s * bonus
    return out


def vote(page: str) -> list[tuple[str, float]]:
    """The page's best paths, with scores from 0 to 1."""
    root = parse(page)
    mark(root)
    scores = candidates(root)
    top = max(scores.values(), default=0.0)
    if top <= 0:
        return []
    return [(path, s / top) for path, s in scores.items() if s > 0]


def text_of(nodes: list[Node]) -> str:
    """Blocks in page order, joined by one space."""
    blocks: list[str] = []
    line: list[str] = []

    def end_block() -> None:
        if line:
            text = " ".join(unescape("".join(line)).split())
            if text:
                blocks.append(text)
            line.clear()

    for node in nodes:
        stack: list = [(node, False)]
        while stack:
            item, leaving = stack.pop()
            if isinstance(item, str):
                line.append(item)
            elif leaving:
                end_block()
            elif item.dropped:
                if item.tag not in INLINE:
                    end_block()
            else:
                if item.tag not in INLINE:
                    end_block()
                    stack.append((item, True))
                stack.extend((c, False) for c in reversed(item.children))
        end_block()
    return " ".join(blocks)


def extract(page: str, path: str | None) -> str:
    """The text at ``path``, or at the page's best path, with what belongs to it around."""
    root = parse(page)
    for named in (True, False):
        mark(root, named)
        text = text_of(_widened(_at(root, path))) if path else ""
        if not text:
            scores = candidates(root)
            best = max(scores, key=lambda p: (scores[p], p), default=None)
            text = text_of(_widened(_at(root, best))) if best is not None and scores[best] > 0 else text_of([root])
        if text:
            return text
    return ""


def _widened(nodes: list[Node]) -> list[Node]:
    """The container around ``nodes`` that holds all of the article, or the nodes themselves if there is none."""
    here = nodes
    while here:
        over = [set(map(id, _above(n.parent))) for n in here[1:]]
        around = next(n for n in _above(here[0].parent) if all(id(n) in some for some in over))
        if around.parent is None or around.tag == "html":
            break
        if any(n.dropped for n in _above(around)) or not _belongs(around, here):
            break
        here = [around]
    return here


def _belongs(around: Node, inner: list[Node]) -> bool:
    """Whether the text that a container adds is of an article: in headings, paragraphs or sections, and not mostly links."""
    plain = linked = loose = 0
    headed = False
    known = set(map(id, inner))
    stack = [(c, False, False) for c in around.children]
    while stack:
        item, in_link, in_block = stack.pop()
        if isinstance(item, str):
            size = len(item.strip())
            if in_link:
                linked += size
            else:
                plain += size
                loose += 0 if in_block else size
        elif not item.dropped and id(item) not in known:
            headed = headed or item.tag in ("h1", "h2")
            block = in_block or item.tag in PARAGRAPHS or item.tag in ("section", "article", "table", "figure", "header")
            stack.extend((c, in_link or item.tag == "a", block) for c in item.children)
    own = around.tag in ("article", "main") or any(n.tag in ("article", "main") for n in _above(around))
    if linked > LINKED * (plain + linked):
        return False
    if around.tag == "body" and not headed:
        return False
    # in an article any text is its own; elsewhere it has to stand in blocks, and be less than what is there
    return own or (loose <= LINKED * plain and plain <= BESIDE * len(text_of(inner)))


def _at(root: Node, path: str) -> list[Node]:
    """The elements at a path, in page order."""
    level = [root]
    for step in path.split("/"):
        level = [c for n in level for c in n.children if isinstance(c, Node) and not c.dropped and c.step() == step]
    return level


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def votes(pages: DataFrame) -> DataFrame:
    """``host, path, score`` of each page's containers, for columns ``url`` and ``html``."""

    def run(batches):
        for batch in batches:
            rows = [
                (host(url), path, s)
                for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)
                for path, s in vote(page or "")
            ]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            kinds = (pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "path", "score"])

    return pages.select("url", "html").mapInArrow(run, "host string, path string, score double")


def winners(pages: DataFrame) -> DataFrame:
    """``host, path``: the winning path of each host, staged."""
    # whole numbers, so that the order of adding doesn't matter
    sums = votes(pages).groupBy("host", "path").agg(F.sum((F.col("score") * 1000).cast("long")).alias("votes"))
    best = sums.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("best"))
    return common.stage(best.select("host", F.col("best.path").alias("path")), "host-paths")


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = BROADCAST_HOSTS
) -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars, path`` (the host's winning path)."""
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.col(f"`{html_col}`").cast("string").alias("html"),
    )
    hosts = winners(rows)
    few = hosts.count() <= broadcast_hosts
    hosts = F.broadcast(hosts) if few else hosts

    def host_of(batches):
        for batch in batches:
            yield pa.array([host(u) for u in batch.to_pylist()], pa.string())

    def run(batches):
        for pages_batch, paths in batches:
            found = zip(pages_batch.to_pylist(), paths.to_pylist(), strict=True)
            yield pa.array([extract(page or "", path) for page, path in found], pa.string())

    host_of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    named = rows.withColumn("host", F.arrow_udf(host_of, "string")("url")).join(hosts, "host", "left")
    texts = named.withColumn("text", F.arrow_udf(run, "string")("html", "path"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "path")
