"""Main text of web pages by site style trees."""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, ship, slices, staged

#: A branch whose composite importance over its site is below this goes.
LEAST_IMPORTANCE = 0.2
#: Weight that falls with each further way a branch's children are arranged.
ATTENUATION = 0.9
#: Pages of a host that must hold a branch before its entropy says anything.
LEAST_PAGES = 5
#: Hosts with such branches, and these, up to which they are broadcast.
BROADCAST_HOSTS, BROADCAST_NODES = 50_000, 1_000_000

# Fixed values of HTML: elements without end tag, elements that end a paragraph, elements that hold no page text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

# What stands beside an article, by element, role, and word in class or id.
ASIDE_TAGS = frozenset("nav footer aside form script style noscript template iframe object svg canvas button select textarea head title dialog menu".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split())
ASIDE_WORDS = re.compile(
    r"^(ad|ads|advert|adverts|advertisement|advertising|adbox|adslot|sponsor|sponsored|promo|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|header|masthead|footer|sidebar|side|aside|widget|cookie|cookies|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|comment|comments|disqus|reply|replies|respond|form|search|login|signup|subscribe|newsletter|share|sharing|social|related|recommended|pagination|pager|skip|copyright|legal|toolbar|hidden)$"
)
MAIN_ROLES = frozenset(["main", "article"])
#: Words that inside an article name a topic or a part of its own as often as something beside it.
TOPICS = frozenset("form header legal login search side signup skip social".split())
#: Elements that may enclose a whole page, as roles and hidden elements may; they go by what they hold.
WRAPS = frozenset(["form"])

#: Elements nested deeper are not nested further, as in browsers.
DEEPEST = 512
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
# A name with its value; a quoted value is taken whole, so nothing inside it is a name.
_ATTR = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_READ = frozenset(["class", "id", "role", "hidden", "aria-hidden", "style"])
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """An element: its style path, whether it or a parent is beside the article or the article, and its text."""

    __slots__ = ("aside", "beside", "chars", "hard", "low", "main", "name", "parent", "path", "same", "styles", "tag", "top", "words", "wraps")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        found: dict[str, str] = {}
        if attrs and not attrs.isspace():
            for k, a, b, c in _ATTR.findall(attrs):
                if (k := k.lower()) in _READ:
                    found.setdefault(k, a or b or c)
        self.tag = tag
        self.name = ".".join([tag, *sorted(found.get("class", "").split())])
        self.parent = parent
        # Named by a hash of the parent's path and the own name, so that deep pages stay small.
        self.path = xxhash.xxh3_64_intdigest(f"{parent.path if parent else 0}/{self.name}".encode("utf-8", "surrogatepass"))
        role = found.get("role", "").lower()
        self.main = (parent is not None and parent.main) or tag in ("article", "main") or role in MAIN_ROLES
        # Marked by element, role or attribute, or by a word only; ``_judge`` decides when the page is read.
        self.wraps = tag in WRAPS or role in ASIDE_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        self.hard = self.wraps or tag in ASIDE_TAGS or (tag == "header" and not self.main)
        self.top = self.main and not (parent is not None and parent.main)
        self.aside = self.beside = False
        if not self.hard and ("class" in found or "id" in found) and tag not in ("html", "body", "article", "main"):
            named = f"{found.get('class', '')} {found.get('id', '')}"
            if self.main:  # a whole name inside the article, where a header is the article's own
                self.beside = any(ASIDE_WORDS.match(w) and w not in TOPICS for w in named.lower().split())
            else:
                self.beside = any(ASIDE_WORDS.match(w.lower()) for w in _PARTS.split(named) if w)
        self.chars = 0  # of the branch's text
        self.low = self.same = False  # whether it or a parent is of low importance, in its texts too
        self.styles: list[str] = []  # children, in order
        self.words: xxhash.xxh3_64 | None = None  # over the branch's texts, in order; None without any

    def read(self, said: bytes) -> None:
        if self.words is None:
            self.words = xxhash.xxh3_64()
        self.words.update(said)

    def close(self) -> None:
        """Hands what it holds to its parent, once its end is read."""
        if self.parent is not None:
            self.parent.chars += self.chars
            if self.words is not None:
                self.parent.read(self.words.digest())


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """``from, to, name, is end, attributes`` of every tag, raw elements with all they hold, and of comments and declarations with an empty name.

    A "<" that opens nothing is text, also where its tag never ends. A quote that opens a value holds a ">"; pages on which
    searching for quotes that never close costs more than some readings of the page are read on without them, so the time is linear in the page.
    """
    at, left, n = 0, 4 * len(page) + 1000, len(page)
    while (start := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), start):
            comment = page.startswith("<!--", start)
            end = page.find("-->" if comment else ">", start + 2)
            end = n if end < 0 else end + (3 if comment else 1)
            yield start, end, "", False, ""
            at = end
            continue
        m = _NAME.match(page, start + 1)
        if m is None:
            at = start + 1
            continue
        end = page.find(">", m.end())
        if end < 0:
            return
        attrs = page[m.end() : end]
        if left > 0 and (attrs.count('"') % 2 or attrs.count("'") % 2):
            k = m.end()
            while k < n and page[k] != ">":
                if page[k] in " \t\n\r\f/=\"'":
                    k += 1
                elif (x := _ATTR.match(page, k)) is not None and x.end() > k:
                    k = x.end()
                else:
                    k += 1
            if k < n:
                end, attrs = k, page[m.end() : k]
            left -= k - start
        name, closing, at = m[1].lower(), page[start + 1] == "/", end + 1
        if name in RAW and not closing and not attrs.endswith("/"):
            last = _END[name].search(page, at)
            at = last.end() if last else n
        yield start, at, name, closing, attrs


def blocks(page: str | None) -> tuple[list[tuple[str, Node]], list[Node]]:
    """The page's text blocks in order, each with its element, and all elements.

    Text between the starts and ends of block elements is one block; references are
    decoded and white space becomes one space. Scripts, styles and other raw elements hold no text.
    A text without any tag is one block of the root.
    """
    page = page or ""
    root = Node("#", "", None)
    stack, nodes, out, held, owner = [root], [root], [], [], root
    opened: dict[str, int] = {}  # how many of each element are open
    own: dict[Node, int] = {}  # characters of an element's own texts

    def flush() -> None:
        nonlocal held
        if held:
            text = " ".join(htmllib.unescape("".join(held)).split())
            if text:
                out.append((text, owner))
                owner.read(text.encode("utf-8", "surrogatepass"))
                owner.chars += len(text)
                own[owner] = own.get(owner, 0) + len(text)
            held = []

    def close(k: int) -> None:
        while len(stack) > k:
            n = stack.pop()
            n.close()
            opened[n.tag] -= 1

    at = 0
    for start, end, tag, is_end, attrs in tags(page):
        if start > at:
            if not held:
                owner = stack[-1]
            held.append(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCK or tag in RAW:
            flush()
        if is_end:
            if opened.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if tag not in BLOCK and stack[k].tag in BLOCK:
                        break
            continue
        closes = SELF_CLOSING.get(tag) or ({"p"} if tag in BLOCK else None)
        if closes and any(opened.get(x) for x in closes):
            limit = SCOPE.get(tag, {"article", "section", "div", "td", "li", "body", "main"} if tag == "p" or closes == {"p"} else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    close(k)
                    break
                if stack[k].tag in limit:
                    break
        node = Node(tag, attrs, stack[-1])
        stack[-1].styles.append(node.name)
        nodes.append(node)
        if tag not in RAW and tag not in VOID and not attrs.endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    if at < len(page):
        if not held:
            owner = stack[-1]
        held.append(page[at:])
    flush()
    close(1)
    if any(n.hard or n.beside for n in nodes):
        _judge(root, nodes, own)
    return out, nodes


def _around(nodes: list[Node]) -> set[Node]:
    """All elements that these stand in."""
    out: set[Node] = set()
    for n in nodes:
        b = n.parent
        while b is not None and b not in out:
            out.add(b)
            b = b.parent
    return out


def _articles(nodes: list[Node]) -> list[Node]:
    """Main elements, and articles at least half as long as the page's longest (comments and teasers are often short ones)."""
    tops = [n for n in nodes if n.top and not n.aside and n.chars]
    longest = max((n.chars for n in tops), default=0)
    return [n for n in tops if n.tag != "article" or 2 * n.chars >= longest]


def _take(nodes: list[Node], taken: set[Node], own: dict[Node, int]) -> None:
    """Sets ``aside`` for these elements and all in them, and counts the characters that are left."""
    for n in nodes:  # parents stand before children
        n.aside = n.aside or n in taken or (n.parent is not None and n.parent.aside)
        n.chars = 0 if n.aside else own.get(n, 0)
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.chars += n.chars


def _judge(root: Node, nodes: list[Node], own: dict[Node, int]) -> None:
    """Marks what is beside the article.

    First the elements that HTML has for it, but for one around a main element or article with over half of the page's
    text. Then forms, roles and hidden elements, but for those around an article (see ``_articles``), and those with over half of
    the text in the article, or of a page without one. Then what words in classes and ids name, but for
    branches with over half of the text, articles and what is around them. If words took all text, none counts.
    """
    if any(n.hard and not n.wraps for n in nodes):
        around = _around([n for n in nodes if n.top and 2 * n.chars > root.chars])
        _take(nodes, {n for n in nodes if n.hard and not n.wraps and n not in around}, own)
    if any(n.wraps and not n.aside for n in nodes):
        around = _around(_articles(nodes))
        none = not any(n.top and n.chars for n in nodes)
        _take(nodes, {n for n in nodes if n.wraps and n not in around and not (2 * n.chars > root.chars and (none or (n.main and not n.top)))}, own)
    if any(n.beside and not n.aside for n in nodes):
        kept = _articles(nodes)
        kept = _around(kept) | set(kept)
        taken = {n for n in nodes if n.beside and not n.aside and n not in kept and 2 * n.chars <= root.chars}
        before, total = [n.aside for n in nodes], root.chars
        _take(nodes, taken, own)
        if total and not root.chars:
            for n, aside in zip(nodes, before, strict=True):
                n.aside = aside
            _take(nodes, set(), own)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def key(text: str) -> int:
    return signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))


def main_text(page: str | None, low: frozenset[int] = frozenset(), same: frozenset[int] = frozenset()) -> str:
    """Blocks of the article joined by an empty line.

    Branches that stand beside an article by element or role, or by a word in class or id (see ``_judge``), go,
    whatever their importance, and so do branches of low importance outside articles (``low``, hashed paths). Main elements, and
    articles that hold at least half of what is left, are then the text, without the block elements
    inside that are of low importance and whose own text is, too (``same``), unless these are over half
    of it. Else (no article, or teasers beside a longer text) all that is left is.
    """
    found, nodes = blocks(page)
    if same or low:
        for n in nodes:  # parents stand before children
            n.same = (n.parent is not None and n.parent.same) or (n.main and not n.top and n.tag in BLOCK and signed(n.path) in same)
            n.low = (n.parent is not None and n.parent.low) or signed(n.path) in low
    left = [(t, n) for t, n in found if not n.aside]
    outer = [(t, n) for t, n in left if n.main or not n.low] if low else left
    inner = [(t, n) for t, n in left if n.main]
    if inner and (2 * sum(len(t) for t, _ in inner) >= sum(len(t) for t, _ in outer) or any(n.top and n.tag != "article" and n.chars and not n.aside for n in nodes)):
        left = inner
        if same:
            own = [(t, n) for t, n in left if not n.same]
            if 2 * sum(len(t) for t, _ in own) >= sum(len(t) for t, _ in left):
                left = own
    else:
        left = outer
    return "\n\n".join(t for t, _ in left)


def host_of(url: str):
    """Lower-case host of a URL column; pages without one are a site each of no name (null)."""
    return F.lower(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def style_tree(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``host, node, pages, importance, content`` of every style node of every site, inside articles and out.

    A node is a path of element names with classes. Over the pages of a host that have it, its
    presentation importance is the entropy (to the base of the number of pages) of its children's
    arrangements, its content importance that of its branch's texts; the composite weighs
    them by ``1 - ATTENUATION**arrangements`` and the rest. Entropies are sums over counts, so
    a site of any size is aggregated before and after a shuffle and never collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ks, ss, cs = [], [], []
            for page in batch.column(1).to_pylist():
                _, nodes = blocks(page)
                seen: dict[int, list[str]] = {}
                for n in nodes:
                    if not n.aside:
                        part = seen.setdefault(signed(n.path), ["", ""])
                        part[0] += "|" + ",".join(n.styles)
                        part[1] += n.words.hexdigest() if n.words is not None else "-"
                ks.append(np.array(list(seen), np.int64))
                ss.append(np.array([key(p[0]) for p in seen.values()], np.int64))
                cs.append(np.array([key(p[1]) for p in seen.values()], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(list_array(x, pa.int64()) for x in (ks, ss, cs))], ["host", "node", "style", "content"])

    each = pages.select("host", html_col).mapInArrow(run, "host string, node array<long>, style array<long>, content array<long>")
    rows = each.select("host", F.explode(F.arrays_zip("node", "style", "content")).alias("x")).select("host", "x.node", F.expr("stack(2, 0, x.style, 1, x.content) as (kind, value)"))
    counted = rows.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("c"))
    by_kind = counted.groupBy("host", "node", "kind").agg(F.sum("c").alias("n"), F.count("*").alias("ways"), F.sum(F.col("c") * F.log("c")).alias("s"))
    by_kind = by_kind.withColumn("h", F.when(F.col("n") > 1, (F.log("n") - F.col("s") / F.col("n")) / F.log("n")).otherwise(1.0))
    pick = lambda c, k: F.max(F.when(F.col("kind") == k, F.col(c)))
    tree = by_kind.groupBy("host", "node").agg(F.max("n").alias("pages"), pick("ways", 0).alias("ways"), pick("h", 0).alias("presentation"), pick("h", 1).alias("content"))
    fade = F.pow(F.lit(ATTENUATION), F.col("ways"))
    return tree.select("host", "node", "pages", ((1 - fade) * F.col("presentation") + fade * F.col("content")).alias("importance"), "content")


def extract(pages: DataFrame, least: float = LEAST_IMPORTANCE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` (code points) for every row of ``pages``.

    The pages of a host form its style tree; nodes of low importance that at least ``LEAST_PAGES``
    pages have are removed from each page, inside its article too, with what HTML itself marks as beside the article. Null and empty
    pages have an empty text. Pages without host have no tree. Repeated rows stay. Other columns
    are not read.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.nullif(host_of(url_col), F.lit("")).alias("host"))
    tree = style_tree(rows.filter("host is not null"), "html")
    low = staged(tree.filter((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < least)).groupBy("host").agg(F.collect_set("node").alias("low"), F.collect_set(F.when(F.col("content") < least, F.col("node"))).alias("same")), "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(page, frozenset(low or ()), frozenset(same or ())) for page, low, same in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    size = low.agg(F.count("*"), F.coalesce(F.sum(F.size("low") + F.size("same")), F.lit(0))).first()
    joined = rows.join(F.broadcast(low) if size[0] <= BROADCAST_HOSTS and size[1] <= BROADCAST_NODES else low, "host", "left").select("page_id", "url", "html", "low", "same")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
