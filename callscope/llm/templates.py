"""Main text of web pages, with the templates of their sites removed.

Method: every container element of a page is hashed from the bottom up (its tag, class,
id, text and the hashes of what it contains). Spark counts, per host, on how many
pages of different text each subtree occurs. Subtrees on ``PAGES`` pages, or on ``LEAST`` pages and a
share of ``SHARE`` of the host's pages, are the site's template and are deleted wherever they
occur on that host. Pages of one text count once, so copies of a page do not delete it. Where a page
marks no article, headings, list items and other blocks that recur in that share go too.
Paragraphs are never a template by themselves, so a passage that many articles share stays.

What a template cannot show (parts that differ from page to page) goes by its markup: elements
for menus, forms, scripts and the like, and class, id or role words for adverts,
notices, sidebars and comments. Then the article's blocks are read in page order.

Defined results: null or empty html gives an empty text; a null url is a host of its
own; markup that is cut off or not closed is read as far as it goes; pages
without an article or main element or role main give the text of their body; repeated rows each
get their text. Other columns are kept.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import fresh, keep, with_columns

#: Pages that make a template on a host of any size, and on one where they are a share.
PAGES, LEAST = 10, 3
SHARE = 0.3

# The markup's vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset(
    "aside details div dl fieldset figure footer form header menu nav ol section table ul".split()
)
#: Further blocks that can be a template on pages that mark no article.
BLOCKS = frozenset("address blockquote center h1 h2 h3 h4 h5 h6 li".split())
JUNK = frozenset(
    "nav footer aside form script style noscript template iframe object svg canvas button select "
    "textarea dialog menu head title input audio video noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
JUNK_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices menu nav navbar navigation sidebar breadcrumb breadcrumbs footer "
    "masthead comment comments commentlist disqus respond newsletter subscribe signup login share "
    "sharing social related recommended popup modal overlay toolbar pagination pager widget".split()
)
JUNK_ARTICLES = frozenset("ad advert comment comments promo related sponsored".split())
KEPT = frozenset(("html", "body", "article", "main"))
#: An open paragraph ends where one of these begins.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
SAME = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</?\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(\bhidden\b)")
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "label", "junk", "main", "parts", "pieces", "holds", "hash")

    def __init__(self, tag: str, label: str = "", junk: bool = False, main: bool = False):
        self.tag, self.label, self.junk = tag, label, junk
        self.main = main or tag in ("article", "main")  # marked as the article
        self.parts: list = []  # texts and nodes in order
        self.pieces: list[str] = []  # what the hash is made of
        self.holds = self.main  # itself or anything in it
        self.hash = 0


def _marked(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Class and id of an element, whether they mark junk, and whether its role is main."""
    found = {}
    for name, a, b, c, bare in ATTRIBUTE.findall(attributes):
        found.setdefault((name or bare).lower(), (a or b or c).lower())
    label = f"{found.get('class', '')}#{found.get('id', '')}"
    names = [n for n in re.split(r"[\s#]+", label) if n and not re.match(r"(?:has|with|no|is)[-_]", n)]
    role = found.get("role", "")
    hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "")
    main = role == "main"
    kept = tag in KEPT or main
    words = JUNK_WORDS if not kept else JUNK_ARTICLES if tag == "article" else frozenset()
    junk = any(w in words for n in names for w in WORDS.findall(n))
    return label, junk or (not kept and (hidden or role in ROLES)), main


def parse(page: str) -> Node:
    """A tree of the page's elements, hashed from the bottom up."""
    root = Node("html")
    stack = [root]

    def close() -> None:
        node = stack.pop()
        text = "\x00".join(node.pieces)
        node.hash = xxhash.xxh3_64_intdigest(f"{node.tag}\x01{node.label}\x01{text}".encode("utf-8", "surrogatepass")) - (1 << 63)
        node.pieces = node.pieces[:1]  # only whether there was any is asked later
        stack[-1].pieces.append(str(node.hash))
        stack[-1].holds |= node.holds

    def close_to(tag: str, limits: tuple[str, ...] = ()) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == tag:
                while len(stack) > depth:
                    close()
                return
            if stack[depth].tag in limits or (stack[depth].main and "main" in limits):
                return

    def text(value: str) -> None:
        if value:
            stack[-1].parts.append(value)
            short = SPACE.sub(" ", value).strip()
            if short:
                stack[-1].pieces.append(short)

    at, size = 0, len(page)
    while at < size:
        token = TOKEN.search(page, at)
        if token is None:
            text(page[at:])
            break
        text(page[at : token.start()])
        at = token.end()
        ending, name, attributes = token.group(1, 2, 3)
        if name is None:
            ending, name, attributes = token.group(4, 5, 6)
        if name is None or (at == size and page[-1] != ">"):
            continue
        tag = name.lower()
        if ending:
            if tag == "br":
                stack[-1].parts.append(" ")
            elif tag not in VOID:
                close_to(tag, ("article", "main") if tag in INLINE or tag == "p" else ())
            continue
        if tag in ENDS_P:
            close_to("p", ("table", "td", "button", "div", "li", "article", "section"))
        if tag in SAME:
            close_to(tag, tuple(SAME[tag].split()))
        if tag in VOID:
            if tag not in INLINE:
                stack[-1].parts.append(Node(tag))
            elif tag == "br":
                stack[-1].parts.append(" ")
            continue
        if tag in ("html", "body"):
            continue
        label, junk, main = _marked(tag, attributes) if attributes else ("", False, False)
        inside = any(n.holds for n in stack)
        junk = junk or (not main and (tag in JUNK or (tag == "header" and not inside)))
        node = Node(tag, label, junk, main)
        node.holds = node.main and not node.junk
        stack[-1].parts.append(node)
        stack.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            stop = end.start() if end else size
            if tag not in JUNK:
                text(page[at:stop])
            at = stop
    while len(stack) > 1:
        close()
    return root


def subtrees(page: str | None) -> tuple[int, set[int], set[int]]:
    """A hash of the page's text, and those of its subtrees that hold text and do not hold its
    article: containers, and further blocks if it marks none."""
    root = parse(page or "")
    found, blocks, todo = set(), set(), [root]
    while todo:
        node = todo.pop()
        if node.pieces and not node.holds:
            if node.tag in CONTAINERS:
                found.add(node.hash)
            elif node.tag in BLOCKS and not root.holds:
                blocks.add(node.hash)
        todo += [p for p in node.parts if isinstance(p, Node)]
    text = _text(root) or "\x00".join(root.pieces)
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63), found, blocks


def main_text(page: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The article's blocks, one a line."""
    return _text(parse(page or ""), template)


def _text(root: Node, template: frozenset[int] | set[int] = frozenset()) -> str:
    removable = CONTAINERS if root.holds else CONTAINERS | BLOCKS
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        block = SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if block:
            blocks.append(block)

    # Pairs of a part and whether it lies in the article; None closes a block.
    todo: list = [(root, not root.holds)]
    while todo:
        part, chosen = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            if chosen:
                held.append(part)
        else:
            if not part.holds and (part.junk or (part.hash in template and part.tag in removable)):
                flush() if part.tag not in INLINE else None
                continue
            chosen = chosen or part.main
            if part.tag not in INLINE:
                flush()
                todo.append((None, chosen))
            todo += [(p, chosen) for p in reversed(part.parts)]
    flush()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    pattern = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), pattern, 1))


def site_templates(pages: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """``host, template``: the hashes of each host's recurring subtrees."""
    rows = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{page}`").alias("html"))

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            each = [subtrees(t) for t in texts.to_pylist()]
            lists = [pa.array([sorted(x[k]) for x in each], pa.list_(pa.int64())) for k in (1, 2)]
            return [pa.array([x[0] for x in each], pa.int64()), *lists]

        return work

    fields = [("page", "bigint"), ("found", "array<bigint>"), ("blocks", "array<bigint>")]
    found = with_columns(rows, "html", fields, make, drop="html")
    marked = lambda block: lambda h: F.struct(h.alias("hash"), F.lit(block).alias("block"))
    # A null among a page's hashes counts the page itself.
    every = F.concat(
        F.transform("found", marked(False)),
        F.transform("blocks", marked(True)),
        F.array(marked(False)(F.lit(None).cast("bigint"))),
    )
    each = found.select("host", "page", F.explode(every).alias("s")).select("host", "page", "s.*").distinct()
    counts = keep(each.groupBy("host", "hash", "block").agg(F.count("*").alias("pages")).where(f"pages >= {LEAST}"), "subtrees")
    hosts = counts.where("hash IS NULL").select("host", F.col("pages").alias("all"))
    recurring = counts.where("hash IS NOT NULL").join(hosts, "host").where(
        (F.col("pages") >= SHARE * F.col("all")) | (~F.col("block") & (F.col("pages") >= PAGES))
    )
    return recurring.groupBy("host").agg(F.collect_list("hash").alias("template"))


def extract(pages: DataFrame, page: str = "html", url: str = "url", text: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html."""
    templates = keep(site_templates(pages, page, url), "templates")
    host, both = fresh(pages.columns, "_host"), fresh(pages.columns, "_both")
    hosted = pages.withColumn(host, host_of(F.col(f"`{url}`")))
    named = templates.select(F.col("host").alias(host), F.col("template").alias(both))
    paired = hosted.join(named, host, "left").withColumn(both, F.struct(F.col(f"`{page}`").alias("html"), F.col(both).alias("template")))
    kept = [c for c in pages.columns if c != page]

    def make():
        def work(pairs: pa.Array) -> list[pa.Array]:
            htmls, lists = (pairs.field(k).to_pylist() for k in (0, 1))
            return [pa.array([main_text(h, set(t or ())) for h, t in zip(htmls, lists)], pa.string())]

        return work

    return with_columns(paired.select(*[F.col(f"`{c}`") for c in kept], both), both, [(text, "string")], make, drop=both)
