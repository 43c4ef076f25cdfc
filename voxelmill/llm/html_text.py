"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged into a style tree: a node is a path of elements with their classes, ids and roles.
Over the host's distinct pages a node has an entropy of content (its texts) and one of presentation (the sequence of the
elements that it holds), both against the entropy of the pages: a node that reads the same and is laid out the same on most
pages is of low importance, inside an article as outside. What names itself a menu, header, footer, sidebar, notice, advert,
form or comments, by its element or its class, id or role, is of none; such parts may differ from page to page. Inside an article
an id alone tells that of a plain box only: sections, paragraphs and headings are named for a table of contents. Every page
loses these branches, and the rest, inside its article where there is one, is its text; a headline or a lead that stands in front
of the article element isn't part of it.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, stored

#: Presentation that is never main text.
DROPPED = frozenset("script style head title noscript template iframe svg canvas object nav menu footer aside form button select textarea dialog audio video".split())
#: A class, id or role (whole, but for a number at its end) that is never main text: a listed word, after a listed prefix or
#: not, or a listed compound.
ROLES = re.compile(
    r"(?:(?:(?:site|global|top|main|primary|secondary)[-_]+)?"
    r"(?:nav|navbar|navigation|menu|breadcrumbs?|(?P<head>header|masthead)|footer|sidebar|aside|ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|sharing|social|(?P<reply>related|comments?|respond|replies|disqus)|search|login|complementary|contentinfo|form)"
    r"|(?:nav|navbar|header|footer)[-_](?:nav|menu|links|widgets?)|(?:ads?|adverts?)[-_](?:banner|slot|unit|box|block|container|wrapper)|(?:cookies?|consent)[-_](?:banner|bar|notice|consent|popup|modal)"
    r"|(?:share|sharing|social)[-_](?:bar|buttons?|icons|links|share)|(?:newsletter|login|search|subscribe)[-_](?:form|box|popup|modal|signup)"
    r"|(?P<replies>related[-_](?:posts|articles|links|stories)|comments?[-_](?:area|list|section|form)))(?:[-_]?\d+)?",
    re.I,
)
RAW = frozenset(("script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that the start of one of these ends.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset(("ul", "ol", "dl", "table", "div", "article", "section", "main", "body"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Nothing is taken back once it has matched, so a tag is read in one pass; quotes hold a value only behind an equals sign.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>""")
_ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_NAMES = frozenset(("class", "id", "role"))
_ARTICLE = frozenset(("article", "main"))
_WHOLE = frozenset(("html", "body", "main", "article"))
#: What a page's furniture is made of; the id of such an element inside an article may name a part that isn't the article's.
_BOXES = frozenset(("div", "ul", "ol", "table"))
#: A style node is of low importance if its entropies of content and of presentation are at most this share of that of the pages,
#: on so many distinct pages or more, and on this share of the host's.
LOW, PAGES, SHARE = 0.2, 4, 0.5


class _Node:
    """An element. at: where its tag starts; named: it is dropped for its class, id or role (reply: as one of replies or teasers),
    unless at is spared; holds: it is an article or the main part."""

    __slots__ = ("at", "dropped", "holds", "inside", "key", "mark", "named", "owner", "path", "reply", "tag")

    def __init__(self, tag: str, attrs: str, up: _Node | None, at: int = 0, spared: frozenset[int] = frozenset()):
        names, hidden, main = [], False, False
        for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
            name, value = name.lower(), a or b or c
            hidden = hidden or name == "hidden"
            if name in _NAMES and value:
                names.append((name, value))
                main = main or (name == "role" and "main" in value.lower().split())
        named = " ".join(value for _, value in names)
        body = "articlebody" in attrs.lower()
        within = up.inside if up else False
        self.tag, self.at, self.mark = tag, at, 0
        self.inside = tag in _ARTICLE or "main" in named.lower().split() or body or within
        self.holds = tag in _ARTICLE or main or body
        self.owner = self if tag not in INLINE or up is None else up.owner
        self.named = self.reply = False
        # Inside an article the name of a heading, and the id of anything but a box, is a place to jump to.
        if named and not (tag in _WHOLE or main or body or at in spared or (within and tag in HEADINGS)):
            # A header inside an article holds its headline.
            told = [x for k, x in names if not (within and k == "id" and (tag not in _BOXES or "section" in named.lower().split()))]
            found = [m for m in map(ROLES.fullmatch, " ".join(told).split()) if m and not (within and m["head"])]
            self.named, self.reply = bool(found), any(m["reply"] or m["replies"] for m in found)
        self.dropped = (up.dropped if up else False) or tag in DROPPED or (tag == "header" and not within) or hidden or self.named
        self.key = tag + re.sub(r"\d+", "#", f".{named}" if named else "")
        self.path = xxhash.xxh64_intdigest(f"{up.path if up else 0}/{self.key}") >> 1


def blocks(html: str | None, spared: frozenset[int] = frozenset(), shapes: dict[int, list[str]] | None = None) -> list[tuple[int, str, bool, bool]]:
    """(style path, text, inside an article, may be weighed) of the page's blocks in order, less what names drop. Headings of an
    article aren't weighed. shapes gets the elements that each style path holds, equal neighbours once.

    Forgiving of unclosed and stray tags; time is linear in the page, and what ends within a tag, a comment or a script ends there. What holds an
    article or the main part is not dropped for its name; replies and teasers, which may be articles too, only hold those
    of a page that has no other. `spared` are the starts of tags that a first pass found so.
    """
    html = html or ""
    stack = [_Node("#", "", None)]
    out: list[tuple[int, str, bool, bool]] = []
    held: list[str] = []
    owner = stack[0]
    # Named elements around articles: around any, and around those that no reply or teaser holds.
    around: tuple[set[int], set[int]] = set(), set()
    opened: dict[str, int] = {}
    holders = named = replies = 0  # how many there were, and how many of the stack are

    def end_block() -> None:
        nonlocal held
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((owner.path, text, owner.inside, not (owner.inside and owner.tag in HEADINGS)))
            held = []

    def pop(to: int) -> None:
        nonlocal owner, named, replies
        if any(n.tag not in INLINE for n in stack[to:]):
            end_block()
        for node in stack[to:]:
            opened[node.tag] -= 1
            named -= node.named
            replies -= node.reply
        del stack[to:]
        owner = stack[-1].owner

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not stack[-1].dropped:
            held.append(html[at:lt])
        if lt == n:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(html, lt)
        if not m:
            after = html[lt + 1 : lt + 2]
            if after in ("!", "?", "/"):
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            elif after.isascii() and after.isalpha():
                break  # the page ends within this tag
            else:
                if not stack[-1].dropped:
                    held.append("<")
                at = lt + 1
            continue
        at, close, tag, attrs = m.end(), m[1], m[2].lower(), m[3]
        if tag not in INLINE:
            end_block()
        if close:
            for k in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[k].tag == tag:
                    pop(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            stop = html.find(">", end.end()) if end else -1
            at = stop + 1 if stop >= 0 else n
            continue
        ends = ("p", *CLOSED_BY.get(tag, ()))
        if tag not in INLINE and any(opened.get(x) for x in ends):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    pop(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        if attrs.endswith("/") and tag in ("svg", "path", "canvas"):
            continue
        up = stack[-1]
        node = _Node(tag, attrs, up, lt, spared)
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
        named += node.named
        replies += node.reply
        if shapes is not None and not node.dropped and (held_ := shapes.setdefault(up.path, []))[-1:] != [node.key]:
            held_.append(node.key)
        if node.holds and not spared and (named or not node.dropped):
            clear = 0 if replies else 1
            holders |= 1 << clear
            for x in reversed(stack):  # each element is taken once at most for either set
                if x.mark >> clear & 1:
                    break
                x.mark |= 1 << clear
                if x.named:
                    around[clear].add(x.at)
        if tag not in INLINE:
            owner = node
    end_block()
    spare = frozenset(around[1] if holders & 2 else around[0])
    if not spare:
        return out
    if shapes is not None:
        shapes.clear()
    return blocks(html, spare, shapes)


def main_text(html: str | None, low: set[int] | frozenset[int] = frozenset()) -> str:
    found = blocks(html)
    if any(inside for _, _, inside, _ in found):
        found = [b for b in found if b[2]]
    return " ".join(text for path, text, _, weigh in found if not (weigh and path in low))


def _nodes(batches):
    """(host, path, page, content, shape): each style node of each page once, with digests of the page's texts, of its own and of the
    elements that it holds; path 0 is the page itself."""
    names = ["host", "path", "page", "content", "shape"]
    for batch in batches:
        rows = []
        for h, html in zip(batch.column("host"), batch.column("html"), strict=True):
            own: dict[int, list[str]] = {}
            shapes: dict[int, list[str]] = {}
            for p, text, _, weigh in blocks(html.as_py(), shapes=shapes):
                own.setdefault(0, []).append(text)
                if weigh:
                    own.setdefault(p, []).append(text)
            digest = lambda x: xxhash.xxh64_intdigest("\n".join(x)) >> 1
            page = digest(own.get(0, ()))
            rows += [(h.as_py(), p, page, digest(texts), digest(shapes.get(p, ()))) for p, texts in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n != "host" else pa.string()) for c, n in zip(zip(*rows, strict=True) if rows else [[]] * 5, names, strict=True)], names=names)


def low_nodes(pages: DataFrame, low: float = LOW, least: int = PAGES, share: float = SHARE) -> DataFrame:
    """(host, path): style nodes on `least` pages and a share of their host's or more, whose entropies of content and of presentation
    are at most low times that of the pages. Pages of one host with the same texts count once, so that copies are no evidence."""
    rows = pages.select("host", "html").mapInArrow(_nodes, "host string, path long, page long, content long, shape long")
    # Copies that place the same texts differently still weigh as one page at a path.
    rows = rows.groupBy("host", "path", "page").agg(F.min(F.struct("content", "shape")).alias("m")).select("host", "path", F.explode(F.array(F.struct(F.lit(0).alias("of"), F.col("m.content").alias("d")), F.struct(F.lit(1).alias("of"), F.col("m.shape").alias("d")))).alias("x"))
    n = rows.groupBy("host", "path", "x.of", "x.d").count()
    e = n.groupBy("host", "path", "of").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.log2("count")).alias("s"))
    h = F.log2("n") - F.col("s") / F.col("n")
    e = e.groupBy("host", "path").agg(F.max("n").alias("n"), F.max(F.when(F.col("of") == 0, h)).alias("h"), F.max(F.when(F.col("of") == 1, h)).alias("shape"))
    e = stored(e, "op10-tree")
    page = e.filter("path = 0").select(F.col("host").alias("__h"), F.col("h").alias("all"), F.col("n").alias("pages"))
    found = e.filter(F.col("path") != 0).filter(F.col("n") >= least).join(page, F.col("host") == F.col("__h"))
    both = (F.col("h") <= low * F.col("all")) & (F.col("shape") <= low * F.col("all"))
    return found.filter((F.col("n") >= share * F.col("pages")) & (F.col("all") >= 1) & both).select("host", "path")


def _extract(batches):
    for batch in batches:
        text = [main_text(h.as_py(), frozenset(x or ())) for h, x in zip(batch.column("html"), batch.column("low").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    Null html is empty and gives an empty text; pages with a null or odd url share one host without a name; repeated rows each
    give a row, and weigh as one page of their host; other columns are ignored. The size of the table of low nodes is checked
    before it is broadcast; a larger one joins by host.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    own = pages.select("page_id", "url", "html", host.alias("host"))
    low = stored(low_nodes(own).groupBy("host").agg(F.collect_set("path").alias("low")), "op10-low")
    size = low.agg(F.sum(F.size("low") + 8)).first()[0] or 0
    low = low.withColumnRenamed("host", "__host")
    own = own.join(F.broadcast(low) if size <= 1_000_000 else low, F.col("host") == F.col("__host"), "left")
    url = pages.schema["url"].dataType.simpleString()
    return own.select("page_id", F.col("url").cast("string").alias("url"), "html", "low").mapInArrow(_extract, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url {url}, text string, n_chars long")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


SQL: dict[str, str] = {}
