"""Main text of web pages by wrapper induction.

The DOM trees of a host's pages are aligned by simple tree matching, in a normal form in which repeated siblings are one node and siblings are ordered by
label, so that aligning any number of pages is a sum over them. Nodes whose words most distinct pages have are template; those whose words vary
are slots. The content is the slot that is reached from the root by following, again and again, the one box with most of the varying text that is no
link; inside it, boxes of links and constant nodes are left out. All this is decided per host, over all its pages: a short article on a page
with long adverts is found where the host's articles are. What elements, roles and classes say of themselves only breaks ties, keeps
scripts, forms and the like out, and stands in for a page that has no template: one of a host with a single distinct page, or one
that lacks the slot. If constant nodes hold over half of the content's box, it is a copied article and stays whole.

Defined results: null html is empty and gives an empty text; a null url, or one without host, stands alone; a host whose pages
all have one content has no template; copies count once; repeated rows get a row each; an empty table gives an empty result; very long and very deep pages are
read whole, in time that grows with their length; only page_id, url and html are read, so other columns may have any name; markup that is
cut off or wrongly nested is repaired as far as browsers' rules for implied ends go, and never raises.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import hot_keys, lookup, stored

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|xmp|noembed|noframes)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)>|(?P<text>[^<]+|<)",
    re.I | re.S,
)
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("br caption option legend tbody td tfoot th thead tr body html".split())
#: An element's start ends an open one of these, unless one of the others is opened in between.
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "option": ("option", "select"), "tbody": ("thead tbody tr td th", "table"), "tfoot": ("tbody thead tr td th", "table")}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}

DROP = frozenset("nav footer aside form button select menu dialog object canvas audio video map input label fieldset datalist output progress meter frameset applet".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status feed".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments commentlist disqus respond replies reply share sharing social related recommended recommendations widget widgets skip search searchbar copyright".split()
)
#: Names that leave no doubt even inside an article; others ("alert", "search", "related") may be the article's own.
CLEAR = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsored promo newsletter cookie cookies sidebar comments commentlist disqus sharing".split())
#: What a name of several parts may have besides: "site-footer" is a footer, "has-sidebar" and "comments-open" are no sidebar and no comments.
PLAIN = frozenset("main site page top bottom global primary secondary list box block area section container wrapper wrap inner outer bar buttons button links link item items posts post article entry widget text title form js".split())
CONTENT = frozenset("content maincontent article post entry articlebody postcontent entrycontent story".split())


ARTICLE = frozenset(["article", "main"])


class Node:
    __slots__ = ("attrs", "inside", "kids", "path", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []
        self.inside = up is not None and (up.inside or up.tag in ARTICLE)  # an article or main element
        self.path = 0

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]

    def named(self) -> list[set[str]]:
        """The parts of each class and of the id."""
        return [p for x in f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}".lower().split() if (p := set(re.split(r"[^a-z0-9]+", x)) - {""})]

    def names(self) -> set[str]:
        return set(re.split(r"[^a-z0-9]+", f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}".lower()))

    def words(self) -> tuple[str, ...]:
        """The node's own text, piece by piece, without what is in its elements."""
        return tuple(x for k in self.kids if isinstance(k, str) and (x := " ".join(k.split())))

    def label(self) -> str:
        """What nodes that stand for each other have in common: the tag and the first class, else the id, any numbers alike."""
        first = (self.attrs.get("class") or self.attrs.get("id") or "").split()[:1]
        return f"{self.tag}.{re.sub('[0-9]+', '#', first[0])}" if first else self.tag


def parse(page: str) -> Node:
    """The tree of a page, however deep. How many of each element are open is known, so that stray ends cost nothing."""
    root = here = Node("html", {}, None)
    open_: Counter[str] = Counter()

    def close(upto: Node) -> Node:
        """Closes all that is open from here to upto, inclusive."""
        at = here
        while True:
            open_[at.tag] -= 1
            if at is upto:
                return at.up
            at = at.up

    for m in TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            here.kids.append(text)
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag or tag == "html":
            continue
        if m["end"] or m["end2"]:
            if open_[tag] > 0:
                at = here
                while at.tag != tag:
                    at = at.up
                here = close(at)
            elif tag == "br":
                here.kids.append(Node("br", {}, here))
            continue
        ends_p = (frozenset("p"), frozenset("button td th table".split())) if tag in ENDS_P else (None, frozenset())
        closes, stop = IMPLIED.get(tag, ends_p)
        for closes, stop in ((closes, stop | {"table"} if tag == "li" else stop), ends_p):
            if closes and any(open_[x] > 0 for x in closes):
                at, hit = here, None
                while at.up is not None and at.tag not in stop:
                    if at.tag in closes:
                        hit = at
                    at = at.up
                if hit:
                    here = close(hit)
        raw = m["attrs"] or m["attrs2"] or ""
        attrs = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTR.findall(raw)} if raw.strip() else {}
        node = Node(tag, attrs, here)
        here.kids.append(node)
        if tag not in VOID and not raw.rstrip().endswith("/"):
            here = node
            open_[tag] += 1
    return root


def is_main(node: Node) -> bool:
    return node.tag == "main" or node.attrs.get("role", "").lower() == "main"


def is_article(node: Node) -> bool:
    return node.tag == "article" or node.attrs.get("role", "").lower() == "article" or node.attrs.get("itemprop", "").lower() == "articlebody"


def unwanted(node: Node) -> bool:
    """Whether the element is no article by its tag, role or state."""
    a = node.attrs
    if node.tag in DROP or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES or a.get("aria-modal"):
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    return node.tag == "header" and not node.inside  # an article's own header has its title


def misnamed(node: Node) -> list[bool]:
    """Of each class and the id whether it, as a whole, names something that is no article."""
    names = CLEAR if node.inside else NAMES | {"header"}
    return [bool(x & names) and x <= names | PLAIN for x in node.named()]


def boilerplate(node: Node) -> bool:
    """Whether the element is no article by what it says of itself. An article is none by its names if all say so, a main part never."""
    if unwanted(node):
        return True
    if node.tag in ("body", "html", "header") or is_main(node) or not ("class" in node.attrs or "id" in node.attrs):
        return False
    names = misnamed(node)
    return bool(names) and (all if is_article(node) else any)(names)


def walk(node: Node, test, skip=boilerplate) -> Iterator[Node]:
    """The outermost elements below node that pass the test, not entering those to skip, in order."""
    todo = node.elements()[::-1]
    while todo:
        k = todo.pop()
        if skip(k):
            continue
        if test(k):
            yield k
        else:
            todo += k.elements()[::-1]


def marked(root: Node) -> list[Node]:
    """The elements that the page marks as its article or main part, if it does."""

    def parts(skip) -> list[Node]:
        mains = list(walk(root, is_main, skip))
        for top in (mains or [root]):
            if found := list(walk(top, is_article, skip)):
                return found
        return mains

    if found := parts(boilerplate):
        return found
    found = list(walk(root, lambda n: n.tag in ("div", "section", "td") and bool(n.names() & CONTENT)))
    # Articles below an element with some such name among others ("layout sidebar"), if they have more text than all else.
    deep = parts(lambda n: unwanted(n) or (boilerplate(n) and (is_article(n) or all(misnamed(n)))))
    if deep and sum(map(len, blocks(deep))) > sum(map(len, blocks(found or [root]))):
        return deep
    return found


def blocks(tops: list[Node], constant=lambda node: False, skip=boilerplate) -> list[str]:
    """The text of these nodes, a piece per block: what a constant node itself says, and all below nodes to skip, is left out."""
    out: list[str] = []
    part: list[str] = []

    def close() -> None:
        if part and (text := " ".join(entities.unescape("".join(part)).split())):
            out.append(text)
        part.clear()

    for top in tops:
        todo: list = [(top, not constant(top))]
        while todo:
            at, said = todo.pop()
            if at is None:
                close()
            elif isinstance(at, str):
                if said:
                    part.append(at)
            elif at is not top and skip(at):
                close()
            else:
                block = at is not top and at.tag in BLOCK
                if block:
                    close()
                    todo.append((None, False))
                    said = not constant(at)
                elif at is not top:
                    said = not constant(at)
                todo += [(k, said) for k in reversed(at.kids)]
        close()
    return out


class Page:
    def __init__(self, page: str | None):
        self.root = parse(page or "")

    @cached_property
    def plain(self) -> str:
        """What element, role and class leave."""
        return "\n".join(blocks(marked(self.root) or [self.root]))


ROOT = 1


def hashed(at: int, *parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"), at & (1 << 64) - 1) - (1 << 63)


def aligned(root: Node, known: dict) -> dict[int, list[Node]]:
    """The page's nodes by what they stand for: the path of labels that leads to them. Sets each node's path.

    Siblings of one label are one repeated node, and siblings are in the order of their labels. Of two trees in
    this form, simple tree matching pairs, at each node that it has paired, the children of equal labels: no other matching of
    their lists pairs more. So to align a page with all pages of its host is to look up its paths.
    """
    root.path = ROOT
    out, todo = {ROOT: [root]}, [root]
    while todo:
        node = todo.pop()
        for k in node.elements():
            key = (node.path, k.label())
            if key not in known:
                known[key] = hashed(*key)
            k.path = known[key]
            out.setdefault(k.path, []).append(k)
            todo.append(k)
    return out


def statistics(page: Page, known: dict) -> Iterator[tuple]:
    """(path, parent, label, key, times, chars, links): a row for each path, with key null, and one for each different words at each path.

    key stands for the words and the path; chars are those of the words, links those of them inside a link.
    """
    for path, nodes in aligned(page.root, known).items():
        first = nodes[0]
        yield path, first.up.path if first.up else 0, first.label(), None, len(nodes), 0, 0
        said: dict[tuple[str, ...], list[int]] = {}
        for n in nodes:
            if words := n.words():
                size, up = sum(map(len, words)), n
                while up is not None and up.tag != "a" and up.tag not in BLOCK:
                    up = up.up
                x = said.setdefault(words, [0, 0])
                x[0] += size
                x[1] += size if up is not None and up.tag == "a" else 0
        for words, (chars, links) in said.items():
            yield path, 0, "", hashed(path, *words), 0, chars, links


#: Elements that hold blocks and have no text of their own as a rule; an article's text is inside one of them.
BOXES = frozenset("html body main article section div td tr tbody table center form dl dd ul ol li fieldset header footer aside nav layer frameset".split())


class Template:
    """What the pages of a host have in common: nodes that most of them have, the words there that most of them have, and of the slots the one that is the content.

    nodes: (path, parent, label, times a page, chars, links) with the chars of varying words alone; constants: keys of words.
    """

    def __init__(self, nodes: list[tuple], constants: list[int]):
        self.constants = frozenset(constants)
        self.below: dict[int, list[tuple]] = {}
        for n in nodes:
            self.below.setdefault(n[1], []).append(n)
        self.mass: dict[int, int] = {}
        self.linked: dict[int, int] = {}
        for path, _, _, _, chars, links in self.upward():
            self.mass[path] = chars - links + sum(self.mass[k[0]] for k in self.below.get(path, ()))
            self.linked[path] = links + sum(self.linked[k[0]] for k in self.below.get(path, ()))
        self.content, self.boxed = self.region()  # boxed: not the whole body
        self.menus = self.furniture()

    def upward(self) -> list[tuple]:
        """The nodes below the root, and it, children before parents."""
        out, todo = [], list(self.below.get(0, ()))
        while todo:
            n = todo.pop()
            out.append(n)
            todo += self.below.get(n[0], ())
        return out[::-1]

    def region(self) -> tuple[int, bool]:
        """The slot with the article: from the root down, the one box with most of the varying text that is no link, as long as there is one.

        A box that pages have several of is a list of blocks and ends the way; so do blocks. Where no box has most of it, a part
        that its element marks as the article breaks the tie; what its element or names mark as something else is never followed.
        """
        at, boxed = ROOT, False
        while True:
            boxes = [k for k in self.below.get(at, ()) if k[2].split(".")[0] in BOXES and k[3] <= 1.5 and not boilerplate(stub(k[2]))]
            most = [k for k in boxes if 2 * self.mass[k[0]] > self.mass[at]] or [k for k in boxes if is_main(stub(k[2])) or is_article(stub(k[2]))]
            if len(most) != 1 or not self.mass[most[0][0]]:
                return at, boxed
            at, boxed = most[0][0], most[0][2].split(".")[0] != "body"

    def furniture(self) -> frozenset[int]:
        """Paths inside the content that are none of it: boxes with more varying text in links than besides, and those that their names tell."""
        out, todo = set(), list(self.below.get(self.content, ()))
        while todo:
            path, _, label, _, _, _ = n = todo.pop()
            named = any(misnamed(stub(label)))
            if named or (n[2].split(".")[0] in BOXES and self.linked[path] > self.mass[path] and len(self.below.get(path, ())) > 0):
                out.add(path)
            else:
                todo += self.below.get(path, ())
        return frozenset(out)


def stub(label: str) -> Node:
    """A node of that label alone."""
    tag, _, name = label.partition(".")
    return Node(tag, {"class": name} if name else {}, None)


def least(n: int) -> int:
    """So many of n distinct pages have what is template: most, and three at least unless all have."""
    return max(2, min(n, max(3, n // 2 + 1)))


def main_text(page: Page, template: Template | None, known: dict | None = None) -> tuple[str, int]:
    """The page's content, and how many of its nodes are template: constant, or outside of what the template has for content.

    Without a template, where the page lacks the content's slot, or where that is empty, what the page marks itself is its content.
    """
    if template is None:
        return page.plain, 0
    paths = aligned(page.root, {} if known is None else known)
    tops = paths.get(template.content, [])
    constant = lambda n: bool(w := n.words()) and hashed(n.path, *w) in template.constants
    skip = lambda n: n.path in template.menus or unwanted(n) or any(x & CLEAR and x <= CLEAR | PLAIN for x in n.named())
    text = whole = "\n".join(blocks(tops, skip=skip))
    held, todo, fixed = 0, list(tops), 0
    while todo:
        n = todo.pop()
        held += 1
        fixed += n.path in template.menus or (bool(template.constants) and constant(n))
        todo += n.elements()
    if fixed and template.constants:
        text = "\n".join(blocks(tops, constant, skip))
        if template.boxed and 2 * len(text) < len(whole):
            text = whole  # a copied article
    return (text, sum(map(len, paths.values())) - held + fixed) if text else (page.plain, 0)


STATISTICS = "host string, digest long, path long, parent long, label string, key long, times int, chars long, links long"
SCHEMA = "page_id long, url string, text string, n_chars long, template_nodes int"
#: Paths whose hashes a worker keeps.
KNOWN = 1 << 18


def induced(pages: DataFrame) -> DataFrame:
    """host, nodes, constants: the template of each host that has two distinct pages or more (pages: host, html).

    Figures are sums over all pages of a host, copies once, wherever they are read; what a template keeps is what over half of the pages have, so it
    is no larger than two average pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = b.slice(at, 256)
                out = [[] for _ in range(9)]
                for host, html in zip(rows.column("host").to_pylist(), rows.column("html").to_pylist(), strict=True):
                    if len(known) > KNOWN:
                        known.clear()
                    rows_ = list(zip(*statistics(Page(html), known), strict=True))
                    out[0] += [host] * len(rows_[0])
                    out[1] += [hashed(0, html or "")] * len(rows_[0])
                    for column, x in zip(out[2:], rows_, strict=True):
                        column += x
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [x.split()[0] for x in STATISTICS.split(", ")])

    rows = pages.filter("host <> ''").select("host", "html").mapInArrow(run, STATISTICS)
    counted = rows.groupBy("host", "path", "key").agg(F.count_distinct("digest").alias("pages"), F.min("parent").alias("parent"), F.min("label").alias("label"), F.sum("times").alias("times"), F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    counted = stored(counted, "counted")
    total = counted.groupBy("host").agg(F.max(F.when((F.col("path") == ROOT) & F.col("key").isNull(), F.col("pages"))).alias("of"), F.count("*").alias("rows"))
    most = F.greatest(F.lit(2), F.least("of", F.greatest(F.lit(3), F.expr("of div 2 + 1"))))
    kept = lookup(counted, stored(total, "total"), "host", F.xxhash64("path", "key"), "inner", "rows").filter("of > 1").withColumn("common", F.col("pages") >= most)
    words = kept.filter("key IS NOT NULL").groupBy("host", "path").agg(F.sum(F.when(~F.col("common"), F.col("chars"))).alias("chars"), F.sum(F.when(~F.col("common"), F.col("links"))).alias("links"), F.collect_list(F.when(F.col("common"), F.col("key"))).alias("constants"))
    nodes = kept.filter("key IS NULL AND common").select("host", "path", "parent", "label", (F.col("times") / F.col("n")).alias("times"))
    each = nodes.join(words, ["host", "path"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    node = F.struct("path", "parent", "label", "times", zero("chars"), zero("links"))
    return each.groupBy("host").agg(F.sort_array(F.collect_list(node)).alias("nodes"), F.array_sort(F.flatten(F.collect_list(F.coalesce("constants", F.expr("cast(array() AS array<bigint>)"))))).alias("constants"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and template_nodes of each page.

    Templates of the at most HOT_PARTS hosts with a thousandth of all pages or more are broadcast, and their pages stay where
    they are; pages of other hosts meet their template in a shuffle join.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    p = pages.select("page_id", "url", "html", host.alias("host"))
    counts = stored(p.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    hot = stored(hot_keys(counts).select(F.col("host").alias("hot")), "hot")
    templates = stored(induced(p), "templates")
    often = templates.join(F.broadcast(hot), F.col("host") == F.col("hot"))
    seldom = templates.join(F.broadcast(hot), F.col("host") == F.col("hot"), "left_anti")
    given = F.broadcast(hot.join(often.drop("hot"), F.col("hot") == F.col("host"), "left").select(F.col("hot").alias("host"), "nodes", "constants"))
    here = p.join(given, "host").select("page_id", "url", "html", "host", "nodes", "constants")
    rest = p.join(F.broadcast(hot), F.col("host") == F.col("hot"), "left_anti").join(seldom.hint("merge"), "host", "left").select("page_id", "url", "html", "host", "nodes", "constants")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        templates: dict[str, Template | None] = {}
        for b in batches:
            for at in range(0, b.num_rows, 64):
                rows, out = b.slice(at, 64), []
                hosts = rows.column("host").to_pylist()
                for k, (page_id, url, html, host) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("page_id", "url", "html")), hosts, strict=True)):
                    if host not in templates:
                        if len(templates) > 1000:
                            templates.clear()
                        nodes = rows.column("nodes")[k].as_py()
                        templates[host] = None if nodes is None else Template([tuple(n.values()) for n in nodes], rows.column("constants")[k].as_py())
                    if len(known) > KNOWN:
                        known.clear()
                    text, n = main_text(Page(html), templates[host], known)
                    out.append((page_id, url, text, len(text), n))
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32()), strict=True)], ["page_id", "url", "text", "n_chars", "template_nodes"])

    return here.unionByName(rest).mapInArrow(run, SCHEMA)
