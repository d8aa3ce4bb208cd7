"""Main text of HTML pages by removing what a site repeats.

Subtrees of container elements are hashed, by tags and texts, and counted on the cluster: on how many pages of a host each stands.  Pages of the same prose
count once, so that copies of a page don't make its article a template.  A subtree that many pages of its host hold is template and goes, wherever
it stands, before anything else is decided: what is left then says which element holds the main text (a page's only article, or the articles or
main if they hold most of what is left, else the body).  What a site hasn't pages enough to give away is told by its markup: navigation, headers and
footers of pages, sidebars, notices, adverts, forms and comments.  Names (class, id, role) count only as whole tokens, on elements that aren't part of a
sentence, and not on an element that holds most of the text; within an article, a section with the name of a menu, a notice or related matter stays if it is of
paragraphs rather than links, unless the site repeats it.

Paragraphs, headings and the like are never template by themselves, nor are lists and tables of an article, nor is anything that holds
the article or most of its text, so a passage that many articles share stays.  The set of a host's template hashes is bounded by the share of pages
that each must be found on.  Pages are joined to it by broadcast only up to BROADCAST_HASHES of it, else by a shuffle on the
host, where Spark may split a hot host.

Defined cases: null or empty html gives an empty text; a page without a host is of host ""; unclosed and stray tags are tolerated, to any
depth; whole pages are read, of any length; if removal of repeated subtrees would leave a page empty, they stay, and so do elements removed by name; equal
pages of a host, in repeated rows too, have equal texts; an empty table gives an empty table; where pages have a column of the text's name, the text's
gets a number.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichefold.llm.common import free_name, free_names, materialise, ship

#: A subtree is template if it is on at least this many pages, of different prose, and this share of its host's pages.
MIN_PAGES, MIN_SHARE = 5, 0.01
#: An element that holds more than this share of the text is not removed by its name; nor is a repeated subtree from an article.
MOST, MOST_COMMENTS = 0.5, 0.9
BROADCAST_HASHES = 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template textarea select svg object canvas audio video title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("address aside details div dl fieldset figure footer form header menu nav ol section table ul".split())
#: Of these, what may be template within the article too: lists and tables there are its own.
INNER = frozenset("aside details div fieldset footer form header menu nav section".split())
ENDS_P = BLOCKS - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "figcaption"}
#: Opening one of these closes an open one of the others in its set.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PROSE = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
PARAGRAPHS = frozenset("blockquote h1 h2 h3 h4 h5 h6 p pre".split())
#: Elements that aren't article wherever they stand, and those of which that holds unless they are all there is.
DROPPED = frozenset("aside footer head nav".split())
DROPPED_IF_SMALL = frozenset("button dialog form menu".split())
#: Words of class, id or role that mark what isn't the article: names made of these and of PLACES alone.
MARKS = frozenset(
    "ad ads adbox adsense adslot advert adverts advertisement advertising alert alertdialog breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright "
    "disclaimer footer gdpr menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promoted promotion "
    "recommended recommendations related search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond responses".split())
#: Of the marks, those that aren't a word for a part of an article: others leave paragraphs of an article alone.
CERTAIN = COMMENTS | frozenset(
    "ad ads adbox adsense adslot advert adverts advertisement advertising consent cookie cookies gdpr modal newsletter overlay paywall popup promo promoted promotion signup sponsor "
    "sponsored subscribe subscription".split()
)
PAGE_MARKS = frozenset("banner header masthead topbar".split())
PLACES = frozenset(
    "area bar block blocks bottom box boxes buttons container form global group icons inner item items left links list lists lower main media menu outer page panel post posts "
    "primary region right secondary section sections site slot sticky thread top unit upper wrap wrapper".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("attrs", "children", "gone", "hash", "holds", "inside", "left", "parent", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []
        self.parent: Node | None = None
        self.hash = 0
        self.holds = 0  # articles (of a page without any: mains) below
        self.inside: Node | None = None  # the article that it stands in
        self.left = 0  # characters of text below that aren't removed
        self.gone = False


def parse(source: str) -> Node:
    """The tree of a page: elements and raw text between them."""
    root = Node("#root")
    stack = [root]
    at, end = 0, len(source)
    find = TOKEN.search
    while at < end:
        m = find(source, at)
        if m is None:
            stack[-1].children.append(source[at:])
            break
        if m.start() > at:
            stack[-1].children.append(source[at : m.start()])
        at = m.end()
        closing, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(entities.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = name.lower()
        if closing:
            _close(stack, tag)
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                over = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                at = over.end() if over else end
            continue
        _make_room(stack, tag)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
    return root


def _close(stack: list[Node], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if tag not in BLOCKS and stack[i].tag in BLOCKS:
            return


def _make_room(stack: list[Node], tag: str) -> None:
    """Closes what the element ends implicitly: an open paragraph, or the sibling before it."""
    if tag in ENDS_P:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                del stack[i:]
                break
            if stack[i].tag in BLOCKS:
                break
    ends = SIBLINGS.get(tag)
    if ends:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ends:
                del stack[i:]
                return
            if stack[i].tag in ("ul", "ol", "dl", "table", "select"):
                return


def in_order(root: Node) -> list[Node]:
    """All elements, each before those in it, with parents, articles and holdings filled in."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        for c in node.children:
            if not isinstance(c, str):
                c.parent = node
                c.inside = node if node.tag == "article" else node.inside
                stack.append(c)
    kind = "article" if any(n.tag == "article" for n in order) else "main"
    for node in reversed(order):
        if node.parent is not None:
            node.parent.holds += node.holds + (node.tag == kind)
    return order


def hash_subtrees(order: list[Node]) -> set[int]:
    """Gives every node the hash of its subtree (tags and texts, not attributes); those of containers that may be template."""
    import xxhash

    found: set[int] = set()
    for node in reversed(order):
        h = xxhash.xxh3_64(node.tag)
        text = False
        for c in node.children:
            if isinstance(c, str):
                c = " ".join(c.split())
                if c:
                    h.update(b"\1" + c.encode("utf-8", "surrogatepass"))
                    text = True
            else:
                h.update(c.hash.to_bytes(8, "little", signed=True))
                text = text or c.hash != 0
        node.hash = h.intdigest() - (1 << 63) if text else 0
        if text and node.tag in CONTAINERS and not node.holds:
            found.add(node.hash)
    return found


def prose_hash(order: list[Node]) -> int:
    """A hash of the paragraphs and headings of a page, whatever else stands around them."""
    import xxhash

    h = xxhash.xxh3_64()
    for node in order:
        if node.tag in PROSE and node.tag != "li" and not any(x.tag in DROPPED for x in _above(node)):
            h.update(node.hash.to_bytes(8, "little", signed=True))
    return h.intdigest() - (1 << 63)


def _above(node: Node):
    """The nearest elements around a node, as far as markup usually matters."""
    for _ in range(8):
        node = node.parent
        if node is None:
            return
        yield node


def _names(attrs: str) -> tuple[set[str], bool]:
    """The marks that whole tokens of class, id and role are made of, and whether the element is hidden."""
    found: set[str] = set()
    known = MARKS | COMMENTS | PAGE_MARKS
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return found, True
        if name in ("class", "id", "role"):
            for token in value.split():
                words = {w.lower() for w in WORDS.findall(token)}
                if words and words <= known | PLACES:
                    found |= words & known
    return found, False


def _weigh(order: list[Node]) -> None:
    for node in reversed(order):
        node.left = 0 if node.gone else sum(len(c.strip()) if isinstance(c, str) else c.left for c in node.children)


def _in_sentence(node: Node) -> bool:
    """Whether an inline element stands among text."""
    up = node.parent
    return node.tag not in BLOCKS and up is not None and (up.tag in PROSE or up.tag not in BLOCKS or any(isinstance(c, str) and c.strip() for c in up.children))


def _paragraphs(node: Node) -> int:
    """Characters of an element's paragraphs and headings that aren't links."""
    total, stack = 0, [(node, False)]
    while stack:
        x, inside = stack.pop()
        inside = inside or x.tag in PARAGRAPHS
        for c in x.children:
            if isinstance(c, str):
                total += len(c.strip()) * inside
            elif c.tag != "a" and not c.gone:
                stack.append((c, inside))
    return total


def _strike(order: list[Node], template: frozenset, names: bool) -> None:
    """Marks what isn't main text as gone: repeated subtrees and elements by their tag, then elements by their names."""
    root, marked = order[0], []
    whole = root.holds
    _weigh(order)
    for node in order[1:]:
        tag, article = node.tag, node.inside
        all_of_it = whole and node.holds == whole or node.left > MOST * (article or root).left
        if template and node.hash in template and not (whole and node.holds == whole) and (tag in INNER and not all_of_it if article else tag in CONTAINERS):
            node.gone = True
        elif tag in DROPPED or tag == "header" and not article and not node.holds or tag in DROPPED_IF_SMALL and not all_of_it:
            node.gone = True
        elif node.attrs:
            found, hidden = _names(node.attrs)
            if hidden and tag not in ("html", "body"):
                node.gone = True
            elif found and names and tag not in ("html", "body", "main", "article"):
                marked.append((node, found))
    _weigh(order)
    lone = any(n.tag == "article" and n.left for n in order)  # text outside the articles is in no danger then
    for node, found in marked:
        article = node.inside
        if whole and node.holds == whole or found <= PAGE_MARKS and article or _in_sentence(node):
            continue
        if article and not found & CERTAIN and _paragraphs(node) > MOST * node.left:
            continue
        share = MOST_COMMENTS if found & COMMENTS else MOST
        if lone and not article and not node.holds or node.left <= share * (article or root).left:
            node.gone = True
    _weigh(order)


def _roots(order: list[Node]) -> list[Node]:
    """The elements that hold the main text."""
    body = next((n for n in order if n.tag == "body"), order[0])
    removed = {id(n) for n in order if n.gone}
    for n in order:
        if n.parent is not None and id(n.parent) in removed:
            removed.add(id(n))
    for tag in ("article", "main"):
        found = [n for n in order if n.tag == tag and n.left and id(n) not in removed and (tag != "article" or n.inside is None)]
        if len(found) == 1 and sum(n.tag == tag for n in order) == 1 or found and sum(n.left for n in found) > MOST * order[0].left:
            return _as_they_stand(order[0], found)
    return [body] if body.left or not order[0].left else [order[0]]


def _as_they_stand(root: Node, found: list[Node]) -> list[Node]:
    """Elements in the order of the page."""
    if len(found) == 1:
        return found
    chosen, out, stack = {id(n) for n in found}, [], [root]
    while stack:
        n = stack.pop()
        if id(n) in chosen:
            out.append(n)
        stack += [c for c in reversed(n.children) if not isinstance(c, str)]
    return out


def _blocks(root: Node) -> list[str]:
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if now:
            text = "".join(now)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append(text)
            now.clear()

    stack: list[Node | str | None] = [root]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        elif x.gone:
            if x.tag in BLOCKS:
                flush()
        else:
            if x.tag in BLOCKS:
                flush()
                stack.append(None)
            stack += x.children[::-1]
    flush()
    return out


def main_text(source: str | None, template: frozenset = frozenset(), names: bool = True) -> str:
    """The main text of a page without the subtrees whose hashes are template; names: also by class, id and role."""
    if not source:
        return ""
    order = in_order(parse(source))
    if template:
        hash_subtrees(order)
    _strike(order, template, names)
    text = "\n".join(b for f in _roots(order) for b in _blocks(f))
    if text or not (template or names):
        return text
    return main_text(source, frozenset(), names) if template else main_text(source, template, False)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def _hash_pages(batches):
    import pyarrow as pa

    for b in batches:
        hosts, hashes, prose = [], [], []
        for host, source in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            order = in_order(parse(source.as_py() or ""))
            found = hash_subtrees(order) | {0}  # 0 counts the page
            hosts += [host] * len(found)
            hashes += found
            prose += [prose_hash(order)] * len(found)
        yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(prose, pa.int64())], names=["host", "hash", "prose"])


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (host, hashes): the subtrees of each host that many of its pages hold."""
    ship(pages.sparkSession)
    seen = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col)).mapInArrow(_hash_pages, "host string, hash long, prose long").distinct()
    counts = seen.groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_PAGES)
    counts = materialise(counts, "subtrees")
    totals = counts.filter("hash = 0").select("host", F.col("n").alias("pages"))
    many = counts.filter("hash <> 0").join(totals, "host").filter(F.col("n") >= MIN_SHARE * F.col("pages"))
    return many.groupBy("host").agg(F.sort_array(F.collect_set("hash")).alias("hashes"))


def _extract(batches, html_at: int, hashes_at: int, name: str):
    import pyarrow as pa

    sets: dict[tuple, frozenset] = {}
    for b in batches:
        texts = []
        for source, hashes in zip(b.column(html_at), b.column(hashes_at), strict=True):
            key = tuple(hashes.as_py() or ())
            if key not in sets:
                if len(sets) > 1000:
                    sets.clear()
                sets[key] = frozenset(key)
            texts.append(main_text(source.as_py(), sets[key]))
        rest = [c for i, c in enumerate(b.columns) if i not in (html_at, hashes_at)]
        names = [n for i, n in enumerate(b.schema.names) if i not in (html_at, hashes_at)]
        yield pa.record_batch([*rest, pa.array(texts, pa.string())], names=[*names, name])


def extract(pages: DataFrame, text_col: str = "text", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with the main text of each as text_col in place of its html."""
    text_col = free_names([c for c in pages.columns if c != html_col], [text_col])[0]
    from pyspark.sql.types import StringType, StructField, StructType

    host, hashes = free_name(pages, "host_"), free_name(pages, "hashes_")
    found = materialise(templates(pages, url_col, html_col).toDF(host, hashes), "templates")
    total = found.agg(F.sum(F.size(hashes))).first()[0] or 0
    side = F.broadcast(found) if total <= BROADCAST_HASHES else found
    others = [c for c in pages.columns if c != html_col]
    rows = pages.withColumn(host, host_of(F.col(url_col))).join(side, host, "left").select(*others, html_col, hashes)
    n = len(others)
    schema = StructType([*(pages.schema[c] for c in others), StructField(text_col, StringType())])
    return rows.mapInArrow(lambda x: _extract(x, n, n + 1, text_col), schema)
