"""Main text of web pages by consensus of their host.

Each page scores its containers and votes for the generalised tag-class path of the best ones; Spark adds the
votes per host, combined before the shuffle. Every page is then read again with its host's winning paths, in order. A
path counts if it holds a substantial part of what the page's own best container holds, or if that container is one
that the host's pages mostly have and pass over; a page in which no path counts falls back on its own best container.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tillwise.session import staged

#: Winning paths kept per host.
PATHS = 8
#: A winning path must hold this share of the letters of the page's own best container.
SUBSTANTIAL = 1 / 3
#: Open elements beyond which markup is read for its text only; letters of a path beyond which its digest stands for it.
DEPTH, PATH_LENGTH = 512, 400
#: A child container that holds this share of its parent's text is the better container.
DOMINANT = 0.8

# Elements of the markup language by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp".split())
DROPPED = set(
    "nav header footer aside form script style noscript template button select option textarea input iframe object embed "
    "svg canvas audio video head title dialog menu noembed noframes xmp datalist label".split()
)
BLOCKS = set(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote "
    "pre figure figcaption address hr br center details summary fieldset legend nav header footer aside form".split()
)
CONTAINERS = set("html body article section main div td center blockquote figure table tbody tr".split())
CLOSES_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Names of classes, ids and roles, or their leading words, that mark what is not the article.
BOILERPLATE = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner banners breadcrumb breadcrumbs comment comments commentlist "
    "complementary consent contentinfo cookie cookies copyright dialog disqus footer gdpr header masthead menu menubar menus modal nav navbar "
    "navigation newsletter notice notices overlay pager pagination popup promo promos promotion recommended related replies reply respond search "
    "share sharing sidebar sidebars signup skip skyscraper social sponsor sponsored sponsors subscribe subscription toc toolbar topbar widget widgets".split()
)

COMMENTS = set("comment comments commentlist disqus replies reply respond".split())
#: A marked container stays if its main or article holds this share of the page's letters, or if it holds more than half of them itself.
ENCLOSED, MOST = 0.25, 0.5

# Quotes count after an equals sign only, and nothing is tried twice: a token is read in time linear in its length.
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|<[!?][^>]*+>?|</[^a-zA-Z][^>]*+>?", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


class Element:
    __slots__ = ("tag", "path", "dropped", "mark", "parts", "children", "parent", "depth")

    def __init__(self, tag: str, path: str, dropped: bool, mark: str, parent: Element | None):
        self.tag, self.path, self.dropped, self.mark, self.parent = tag, path, dropped, mark, parent
        self.depth = parent.depth + 1 if parent else 0
        self.parts: list = []  # text and child elements in page order
        self.children: list[Element] = []


def boilerplate(name: str) -> str:
    """The name, or its leading word, if it marks boilerplate; else nothing."""
    return next((w for w in (name, re.split(r"[^a-z]+", name, maxsplit=1)[0]) if w in BOILERPLATE), "")


def describe(tag: str, attributes: str) -> tuple[str, bool, str]:
    """Generalised step of a path, whether the element goes whatever it holds, and what in class, id or role marks boilerplate."""
    if not attributes or attributes.isspace():
        return tag, tag in DROPPED, ""
    classes, marks, own, hidden = [], [], "", False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(next((v for v in values if v), ""))
        if name == "class":
            classes = value.lower().split()
            marks += classes
        elif name in ("id", "role"):
            marks += value.lower().split()
            own = value.lower() if name == "id" else own
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
    bad, mark = tag in DROPPED or hidden, ""
    if tag not in ("html", "body", "article", "main"):
        found = [w for w in map(boilerplate, marks) if w]
        mark = next((w for w in found if w in COMMENTS), found[0] if found else "")
    elif tag == "article":
        bad = bad or any(word in ("comment", "comments", "reply") for name in marks for word in re.split(r"[^a-z]+", name))
    # Elements without a class are told apart by their id, lest one path stand for every plain container.
    names = sorted({re.sub(r"\d+", "#", c) for c in classes}) or [f"[{re.sub(r'[0-9]+', '#', own)}]"] * bool(own)
    step = ".".join([tag, *names])
    return step, bad, mark


def path_of(parent: str, step: str) -> str:
    """The parent's path and one step; a long path is told by its digest, so that deep pages stay small."""
    path = f"{parent}>{step}" if parent else step
    return path if len(path) <= PATH_LENGTH else "~" + hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def parse(page: str) -> Element:
    """Tree of a page. Markup that breaks off, overlaps or never closes is read as browsers mostly do."""
    root = Element("", "", False, "", None)
    at, now, end = 0, root, len(page)
    is_open: Counter = Counter()  # open elements by tag, so that an end without a beginning is passed over at once
    deep: list[str] = []  # open tags beyond DEPTH
    deep_open: Counter = Counter()

    def text(raw: str) -> None:
        if raw:
            now.parts.append(html.unescape(raw))

    def leave(outer: Element) -> None:
        nonlocal now
        while now is not outer:
            is_open[now.tag] -= 1
            now = now.parent

    while at < end:
        match = TOKEN.search(page, at)
        if match is None:
            text(page[at:])
            break
        text(page[at : match.start()])
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if deep:
            if match[1] and deep_open[tag]:
                while deep_open[tag] and (inner := deep.pop()) != tag:
                    deep_open[inner] -= 1
                deep_open[tag] -= 1
            if match[1] and (deep or not is_open[tag]) or not match[1] and tag not in RAW:
                now.parts.append(" " if tag in BLOCKS else "")
                if not match[1] and tag not in VOID:
                    deep.append(tag)
                    deep_open[tag] += 1
                continue
        if match[1]:
            if tag == "p" and not is_open[tag]:
                now.parts.append(" ")
            if not is_open[tag]:
                continue
            target = now
            while target.tag != tag:
                # Inline ends don't close blocks they were not opened in.
                if target.tag in CONTAINERS and tag not in BLOCKS:
                    break
                target = target.parent
            else:
                leave(target.parent)
            continue
        if tag in CLOSES_P and is_open["p"]:
            leave(_close(now, {"p"}, CONTAINERS | {"li", "button"}))
        if tag in SIBLINGS and any(is_open[t] for t in SIBLINGS[tag]):
            leave(_close(now, SIBLINGS[tag], SCOPES[tag]))
        step, bad, mark = describe(tag, match[3])
        child = Element(tag, path_of(now.path, step), bad or now.dropped, mark, now)
        now.parts.append(child)
        now.children.append(child)
        if tag in VOID or match[3].endswith("/") and tag not in BLOCKS | RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            if close is None:
                break  # the rest of the page belongs to it
            at = page.find(">", close.start()) + 1 or end
            continue
        if child.depth >= DEPTH:
            deep.append(tag)
            deep_open[tag] += 1
            continue
        now = child
        is_open[tag] += 1
    drop_marked(root)
    return root


def drop_marked(root: Element) -> None:
    """Drop marked elements, but not those that enclose the article or hold most of the page; if nothing else is left, none."""
    sizes = measure(root)
    marked = [e for e in sizes if e.mark]
    if not marked:
        return
    kept: set[Element] = set()
    for e in sizes:
        if e.tag in ("article", "main") and sizes[e] > 0 and sizes[e] >= ENCLOSED * sizes[root]:
            kept.update(_open(e))
    # Readers' comments can outweigh the article they are about.
    gone = [e for e in marked if e not in kept and (e.mark in COMMENTS or sizes[e] <= MOST * sizes[root])]
    stack, whole = list(gone), set(gone)
    if sizes[root] and sum(sizes[e] for e in gone if whole.isdisjoint(_open(e.parent))) >= sizes[root]:
        return
    while stack:
        element = stack.pop()
        if not element.dropped:
            element.dropped = True
            stack.extend(element.children)


def _open(now: Element) -> Iterator[Element]:
    while now is not None:
        yield now
        now = now.parent


def _close(now: Element, tags: set[str], scope: set[str]) -> Element:
    for element in _open(now):
        if element.tag in tags:
            return element.parent
        if element.tag in scope:
            break
    return now


def block_text(element: Element) -> str:
    """Text of an element without what is dropped; blocks and breaks part words, inline elements don't."""
    out: list[str] = []
    stack: list = [element]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
            continue
        if part.dropped and part is not element:
            out.append(" ") if part.tag in BLOCKS else None
            continue
        if part.tag in BLOCKS:
            out.append(" ")
            stack.append(" ")
        stack.extend(reversed(part.parts))
    return " ".join("".join(out).split())


def measure(root: Element) -> dict[Element, int]:
    """Letters per element outside of dropped elements and links."""
    sizes: dict[Element, int] = {}
    stack = [(root, False)]
    while stack:
        element, seen = stack.pop()
        if not seen:
            stack.append((element, True))
            stack.extend((c, False) for c in element.children if not c.dropped)
            continue
        own = sum(len(p.strip()) for p in element.parts if isinstance(p, str))
        sizes[element] = 0 if element.tag == "a" else own + sum(sizes[c] for c in element.children if not c.dropped)
    return sizes


def best_containers(root: Element) -> list[tuple[Element, float]]:
    """Containers of a page with their shares of its text, best first."""
    sizes = measure(root)
    if not sizes[root]:
        return []
    marked = [e for e in sizes if e.tag in ("article", "main") and sizes[e] > 0]
    # An article beats the main area around it; several articles are one list, held by what encloses them.
    articles = [e for e in marked if e.tag == "article" and not any(a.tag == "article" for a in _open(e.parent))]
    found: list[tuple[Element, float]] = []
    if articles and (top := max(articles, key=sizes.__getitem__)) and sizes[top] * 2 >= sum(sizes[a] for a in articles):
        found.append((top, 1.0 + sizes[top] / sizes[root]))
    elif marked and (mains := [e for e in marked if e.tag == "main"]):
        found.append((max(mains, key=sizes.__getitem__), 1.0))
    now = root
    while True:
        inside = [c for c in now.children if not c.dropped and c.tag in CONTAINERS and sizes[c] >= DOMINANT * sizes[now]]
        if not inside or now.tag in ("article", "main"):
            break
        now = max(inside, key=sizes.__getitem__)
    if now is not root:
        found.append((now, sizes[now] / sizes[root]))
    return found or [(root, 1.0)]


def page_votes(page: str | None) -> list[tuple[str, float]]:
    return _path_votes(parse(page or ""))


def _path_votes(root: Element) -> list[tuple[str, float]]:
    votes: dict[str, float] = {}
    for element, score in best_containers(root):
        votes[element.path] = max(votes.get(element.path, 0.0), score)
    return list(votes.items())


def main_text(page: str | None, paths: list[str], asides: Collection[str] = ()) -> str:
    """Text of the first path that holds a substantial part of the page; all elements of that path, in page order.

    The page's best containers say how much that is, but for those that are the host's ``asides``.
    """
    root = parse(page or "")
    by_path: dict[str, list[Element]] = {}
    stack = [root]
    while stack:
        element = stack.pop()
        if not element.dropped:
            by_path.setdefault(element.path, []).append(element)
        stack.extend(reversed(element.children))
    own = best_containers(root)
    sizes = measure(root)
    # A small article beside a large container is measured by that; what encloses the article is not.
    around = set(_open(own[0][0].parent)) if own else set()
    least = SUBSTANTIAL * max((sizes[e] for e, _ in own if e not in around and e.path not in asides), default=0)
    for path in paths:
        # Letters outside of links, as the page's own best container is measured by them.
        if sum(sizes.get(e, 0) for e in by_path.get(path, ())) >= least:
            if text := " ".join(filter(None, map(block_text, by_path.get(path, ())))):
                return text
    return block_text(own[0][0]) if own else ""


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, host and path: votes in thousandths, pages that vote for it and pages in which it holds text."""
    for batch in batches:
        counts: dict[tuple[str, str], list[int]] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            root = parse(page.as_py() or "")
            votes = dict(_path_votes(root))
            for path in votes.keys() | {e.path for e, n in measure(root).items() if n and e.tag in CONTAINERS}:
                row = counts.setdefault((host, path), [0, 0, 0])
                # Votes are rounded so that their sum does not depend on the order of addition.
                row[0] += round(votes.get(path, 0.0) * 1000)
                row[1] += path in votes
                row[2] += 1
        hosts, paths = ([key[i] for key in counts] for i in (0, 1))
        numbers = [pa.array([row[i] for row in counts.values()], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), *numbers], names=["host", "path", "votes", "voters", "holders"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(i) for i in (2, 3, 4)))
        texts = [main_text(page.as_py(), paths.as_py() or [], asides.as_py() or []) for page, paths, asides in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_paths(pages: DataFrame, most: int = PATHS) -> DataFrame:
    """(host, paths, asides): the paths with most votes per host, best first, ties to the shorter, then smaller path; and
    the paths that some pages vote for but most pages that hold them do not."""
    votes = pages.select(host_of(F.col("url")).alias("host"), F.col("html").alias("html"))
    votes = votes.mapInArrow(_votes, "host string, path string, votes long, voters long, holders long").where("path <> ''")
    summed = votes.groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in ("votes", "voters", "holders"))).where("voters > 0")
    rank = F.row_number().over(W.partitionBy("host").orderBy(F.desc("votes"), F.length("path"), "path"))
    aside = F.col("holders") > 2 * F.col("voters")
    top = summed.withColumn("rank", rank).where((F.col("rank") <= most) | aside)
    ordered = F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "path"))))
    asides = F.sort_array(F.collect_list(F.when(aside, F.col("path"))))
    return top.groupBy("host").agg(F.transform(ordered, lambda x: x["path"]).alias("paths"), asides.alias("asides"))


def extract_pages(pages: DataFrame, most: int = PATHS) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars.

    The whole html is read; null counts as empty. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
    comments are left out by element and by class, id and role; a name in class, id or role counts as a whole or by its leading word, and
    not where it marks a container of the article or of most of the page's text. Character references are decoded, white space within a block
    becomes one space, blocks are joined by one. Pages without url or host vote among themselves. Repeated rows and null ids
    each give a row and a vote; extra columns are ignored; an empty table gives no rows. Broken tags, odd quotes and deep nesting
    are read in time linear in the page; below DEPTH open elements only text, blocks and raw elements are told apart.
    """
    winners = staged(host_paths(pages, most), "hosts")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = rows.join(winners, "host", "left").select("page_id", "url", "html", "paths", "asides")
    texts = joined.mapInArrow(_texts, "page_id long, url string, text string")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
