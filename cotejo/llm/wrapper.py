"""Main text of web pages by wrapper induction.

All pages are parsed to DOM trees.  Pages of a host that have one layout (the containers near
the root) are aligned with a few of them, the exemplars, by simple tree matching (trees.py), so
that each node of a page stands for a node of an exemplar.  How many different pages have the
same text at a node is counted over all pages; a node whose text most of them have is a
constant of the template, the others are slots.  The same is done for all pages of a host,
whatever their layout.

An article that markup names as such (``<article>``) is taken whole: constants are never
taken out of it.  Elsewhere what is constant is left out, and of the slots what markup names
as menus, adverts, forms and the like; what remains is the page's text.

Pages with the same headings are versions of one article and count as one page, as do pages
without headings whose text is the same, so what versions have in common does not become part
of the template.  How much text the constants make up does not matter.  With fewer than LEAST
different pages nothing is a constant, as a notice and a corrected copy of an article look
alike then.

Exemplars and constants are broadcast if all of them together have at most ``BROADCAST``
bytes; beyond that pages meet theirs in joins on the host and the layout.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import discarded, saved, slices

#: Bytes of all templates that are broadcast, and exemplars of a layout.
BROADCAST, EXEMPLARS = 8 << 20, 2
#: Layouts: how deep their containers stand, and the number of the one that stands for all of a host.
DEPTH, ALL = 4, 0
#: Distinct pages that a template needs at least; what hashes of texts are taken modulo.
LEAST, PRIME = 3, 2**64 - 59

#: HTML's elements by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody thead tfoot tr caption ul".split()
)
CONTAINERS = frozenset("body div section article main header footer nav aside center table form".split())
#: Elements whose names are often those of the article's own categories.
WHOLE = frozenset("html body main article".split())
DROPPED = frozenset(
    "head script style noscript template svg iframe object embed form button select textarea input nav footer aside dialog menu canvas audio video map".split()
)
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Names in class, id and role attributes of what is not part of an article.
CHROME = frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices "
    "alert newsletter subscribe subscription signup popup modal overlay sidebar rail widget widgets related recommended recommendations breadcrumb "
    "breadcrumbs nav navbar navigation menu menubar footer masthead comment comments commentlist reply replies respond disqus share sharing social "
    "toolbar pagination pager login search contentinfo complementary teaser teasers disclaimer copyright".split()
)

#: Of these the ones that name a part inside of an article, where other names are the article's own sections; they count as whole names only.
INSIDE = frozenset(
    "ad ads advert adverts advertisement adbox sponsor sponsored promo promotion newsletter subscribe signup related related-posts related-articles recommended "
    "recommendations comment comments comment-list commentlist reply replies respond disqus share share-buttons sharing social social-share breadcrumb breadcrumbs "
    "pagination pager cookie-notice popup modal sidebar widget".split()
)

TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*(>|$)""", re.S)
NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PART = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "names", "kids", "hidden")

    def __init__(self, tag: str, names: str = "", hidden: bool = False):
        self.tag, self.names, self.hidden, self.kids = tag, names, hidden, []


def opened(tag: str, attributes: str) -> Node:
    names, hidden = [], False
    for name, *values in NAMES.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id", "role"):
            names.append(value)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return Node(tag, " ".join(names), hidden)


def parsed(source: str) -> Node:
    """The page's tree; kids of a node are nodes and strings.  Unclosed and stray tags are mended as browsers do."""
    root = Node("html")
    stack, pos = [root], 0
    while pos < len(source):
        m = TAG.search(source, pos)
        text = source[pos : m.start() if m else len(source)]
        if text:
            stack[-1].kids.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        pos = m.end()
        if m[0].startswith("<![CDATA["):
            stack[-1].kids.append(m[0][9:].removesuffix("]]>"))
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in ("html", "body"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
            continue
        if tag == "html":
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in STOPS[tag]:
                    break
                if stack[i].tag in CLOSES[tag]:
                    del stack[i:]
                    break
        if tag == "body":
            del stack[1:]
        node = opened(tag, m[3])
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(source, pos)
            pos = end.end() if end else len(source)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def words(node: Node) -> str:
    """All text of a node, with one space for white space and between its parts."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in RAW:
            todo.extend(reversed(x.kids))
    return " ".join(" ".join(out).split())


@lru_cache(1 << 16)
def kind(tag: str, names: str) -> int:
    """The hash of a tag with the names it has; some tags' names are those of the article's own categories."""
    return digest(f"{tag} {'' if tag in WHOLE else ' '.join(PART.findall(names))}")


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def shape(page: Node) -> tuple[trees.Tree, list[Node]]:
    """The page's tree for matching, and its nodes in the same order.

    A node's kind is its tag with the names it has; texts are equal as ``words`` gives them,
    and their hashes are put together from those of the parts, so each text is read once
    whatever its depth.  Inline elements in running text may be no constants, as what is left
    would be no sentence.
    """
    nodes, parents, free, todo = [], [], [], [(page, -1, True)]
    while todo:
        x, parent, loose = todo.pop()
        at = len(nodes)
        nodes.append(x)
        parents.append(parent)
        free.append(loose)
        loose = loose and all(isinstance(k, Node) or k.isspace() for k in x.kids)
        todo.extend((k, at, loose or k.tag in BLOCK or k.tag in ("td", "th")) for k in reversed(x.kids) if isinstance(k, Node) and k.tag not in RAW and k.tag not in VOID)
    texts: dict[int, tuple[int, int]] = {}
    for x in reversed(nodes):
        h = n = 0
        for k in x.kids:
            if isinstance(k, str):
                raw = " ".join(k.split()).encode(errors="surrogatepass")
                part, size = int.from_bytes(raw, "big") % PRIME, len(raw)
            else:
                part, size = texts.get(id(k), (0, 0))
            if size and n:
                h, n = ((h * 256 + 32) * pow(256, size, PRIME) + part) % PRIME, n + 1 + size
            elif size:
                h, n = part, size
        texts[id(x)] = h, n
    found = [texts[id(x)] for x in nodes]
    hashes = [trees.mark(0, n, h) for h, n in found]
    return trees.Tree(parents, [kind(x.tag, x.names) for x in nodes], hashes, [f and n > 0 for f, (_, n) in zip(free, found)]), nodes


def layout(page: Node) -> int:
    """The hash of which containers, with the names they have, a page has near its root."""
    kinds, todo = set(), [(page, 0, 0)]
    while todo:
        x, path, deep = todo.pop()
        for k in x.kids:
            if isinstance(k, Node) and k.tag in CONTAINERS:
                kind = digest(f"{path} {k.tag} {' '.join(PART.findall(k.names))}")
                kinds.add(kind)
                if deep + 1 < DEPTH:
                    todo.append((k, kind, deep + 1))
    return digest(" ".join(map(str, sorted(kinds))))


def most(n, pages):
    """Whether a node that n different pages have is a constant of so many; of numbers or Columns."""
    return 3 * (n - 1) >= 2 * (pages - 1)


class Template:
    """The exemplars of a host or layout, and the marks of their constants."""

    def __init__(self, shapes: list[bytes], constants: list[int]):
        self.exemplars = [trees.Tree.unpacked(s) for s in shapes] if constants else []
        self.constants = frozenset(constants)


def template(pages: list[str]) -> Template:
    """The template of pages of one host and layout, on one machine."""
    distinct = list({identity(parsed(p)): p for p in pages}.values())
    shapes = [shape(parsed(p))[0] for p in distinct]
    counts = Counter(m for tree in shapes for of in trees.marks(tree, shapes[:EXEMPLARS]) for m in of)
    return Template([x.packed() for x in shapes[:EXEMPLARS]], [m for m, n in counts.items() if len(distinct) >= LEAST and most(n, len(distinct))])


def constants(page: Node, templates: tuple[Template, ...]) -> set[int]:
    """The ids of the page's nodes that are constants of one of the templates."""
    out: set[int] = set()
    known = [t for t in templates if t.constants]
    if known:
        tree, nodes = shape(page)
        for t in known:
            out.update(id(x) for x, of in zip(nodes, trees.marks(tree, t.exemplars)) if not t.constants.isdisjoint(of))
    return out


def identity(page: Node) -> int:
    """A hash that versions of one article share: of the page's headings, or else of its text."""
    headings, todo = [], [page]
    while todo:
        x = todo.pop()
        if x.tag in ("h1", "h2", "h3"):
            headings.append(words(x))
        else:
            todo.extend(k for k in reversed(x.kids) if isinstance(k, Node) and k.tag not in RAW and not chrome(k, False))
    told = "\n".join(h for h in headings if h)
    return digest(f"h {told}" if told else f"t {article(page, ())}")


def chrome(node: Node, inside: bool) -> bool:
    """Whether markup says that a node is not part of an article; inside: it stands in the article."""
    if node.hidden or node.tag in DROPPED or node.tag == "header" and not inside:
        return True
    if inside and node.tag not in ("html", "body", "main", "article"):
        return not INSIDE.isdisjoint(node.names.split())
    if not node.names or node.tag in ("html", "body", "main", "article") and not CHROME & {"comment", "comments", "teaser", "related"} & set(PART.findall(node.names)):
        return False
    before = ""
    for part in PART.findall(node.names):
        if part in CHROME and before not in ("no", "has", "with", "without"):
            return True
        before = part
    return False


def main_roots(page: Node) -> list[Node]:
    """The page's articles in order, but for those that markup names as teasers, comments and the like; without any the main element, or else the whole page."""
    articles, main, todo = [], None, [page]
    while todo:
        x = todo.pop()
        if x.tag == "article":
            articles.append(x)
            continue
        if x.tag == "main" or "main" in x.names.split():
            main = main or x
        todo.extend(k for k in reversed(x.kids) if isinstance(k, Node) and not chrome(k, False))
    return [x for x in articles if x.kids] or [main or page]


def main_text(source: str, *templates: Template) -> str:
    """The page's article: its blocks in order, two line feeds between them."""
    return article(parsed(source), templates)


def article(page: Node, templates: tuple[Template, ...]) -> str:
    roots = main_roots(page)
    left_out = set() if roots[0].tag == "article" else constants(page, templates)
    whole = roots[0].tag not in ("article", "main")
    tops = set(map(id, roots))
    blocks, line = [], []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            blocks.append(text)
        line.clear()

    todo: list = roots[::-1]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag in ("br", "td", "th") and id(x) not in left_out:
            line.append(" ")
            todo.extend(reversed(x.kids))
        elif id(x) in tops or not (id(x) in left_out or chrome(x, not whole) or x.tag in RAW):
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(x.kids))
    flush()
    return "\n\n".join(blocks)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def shapes(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(n, host, layout, identity, shape): the tree of every page that has one, with a number."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                trees_ = [parsed(x) for x in part.column(1).to_pylist()]
                columns = [pa.array(map(layout, trees_), pa.int64()), pa.array(map(identity, trees_), pa.int64()), pa.array([shape(x)[0].packed() for x in trees_], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["host", "layout", "identity", "shape"])

    given = pages.select(host(F.col(url)).alias("host"), F.col(html).alias("html")).where("html <> ''")
    return given.mapInArrow(run, "host string, layout long, identity long, shape binary").select(F.monotonically_increasing_id().alias("n"), "*")


def weight_of(table: DataFrame, marks: bool) -> int:
    """The bytes of a table's exemplars, and of their constants."""
    size = F.aggregate("shapes", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    return table.agg(F.sum(size + 8 * F.size("marks") if marks else size)).first()[0] or 0


def with_own(rows: DataFrame, made: DataFrame, columns: list[str]) -> DataFrame:
    """rows (host and layout) with _wide and _own: columns of the tables' rows of the host and of the host's layout."""
    told = F.struct(*columns)
    wide = made.where(F.col("layout") == ALL).select("host", told.alias("_wide"))
    own = made.where(F.col("layout") != ALL).select("host", "layout", told.alias("_own"))
    return rows.join(wide, "host", "left").join(own, ["host", "layout"], "left")


def voted(rows: DataFrame, exemplars: DataFrame) -> DataFrame:
    """(host, layout, mark) for each node of each page that has a partner in an exemplar of its layout, or of the host if it votes there.

    rows: host, layout, shape and everywhere; exemplars: host, layout and shapes.
    """
    import pyarrow as pa

    small = weight_of(exemplars, False) <= BROADCAST
    known = exemplars.sparkSession.sparkContext.broadcast({(r.host, r.layout): [bytes(x) for x in r.shapes] for r in exemplars.toLocalIterator()} if small else {})
    rows = rows.select("host", "layout", "shape", "everywhere")
    if not small:
        rows = with_own(rows, exemplars, ["shapes"]).select("host", "layout", "shape", "everywhere", "_wide", "_own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list[trees.Tree]] = {}
        for batch in batches:
            for part in slices(batch, 2):
                out = []
                for i, (at, kind_, data, everywhere) in enumerate(zip(*(part.column(c).to_pylist() for c in range(4)))):
                    page = trees.Tree.unpacked(data)
                    for column, place in ((5, kind_), (4, ALL)) if everywhere else ((5, kind_),):
                        if (at, place) not in kept:
                            if len(kept) > 200:
                                kept.clear()
                            found = known.value.get((at, place), []) if small else (part.column(column)[i].as_py() or {"shapes": []})["shapes"]
                            kept[at, place] = [trees.Tree.unpacked(x) for x in found]
                        out.append((at, place, [m for of in trees.marks(page, kept[at, place]) for m in of]))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int64()))], names=["host", "layout", "marks"])

    return rows.mapInArrow(run, "host string, layout long, marks array<long>").select("host", "layout", F.explode("marks").alias("mark"))


def templates(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, layout, shapes, marks): exemplars and constants of every layout of every host, and of all its pages under the layout ALL."""
    read = saved(shapes(pages, url, html))
    # One page stands for all of its versions; one of these votes among all pages of the host as well.
    own = read.groupBy("host", "layout", "identity").agg(F.min("n").alias("n"))
    every = own.groupBy("host", "identity").agg(F.min("n").alias("n")).select("n", F.lit(True).alias("everywhere"))
    voters = saved(own.select("host", "layout", "n").join(every, "n", "left").withColumn("everywhere", F.coalesce("everywhere", F.lit(False))))
    both = voters.select("host", "n", F.explode(F.when(F.col("everywhere"), F.array("layout", F.lit(ALL).cast("long"))).otherwise(F.array("layout"))).alias("layout"))
    spots = [F.min_by("n", F.xxhash64("n", F.lit(i))) for i in range(EXEMPLARS)]
    chosen = saved(both.groupBy("host", "layout").agg(F.count("*").alias("of"), F.array_distinct(F.array(*spots)).alias("ns")).where(F.col("of") >= LEAST))
    # A host has one exemplar more, which pages of all its layouts are aligned with.
    named = chosen.select("host", "layout", F.posexplode(F.when(F.col("layout") == ALL, F.slice("ns", 1, 1)).otherwise(F.col("ns"))).alias("at", "n"))
    exemplars = saved(named.join(read.select("n", "shape"), "n").groupBy("host", "layout").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "shape"))), lambda r: r["shape"]).alias("shapes")))
    counts = saved(voted(voters.join(read.select("n", "shape"), "n"), exemplars).groupBy("host", "layout", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST))
    kept = counts.join(chosen.select("host", "layout", "of"), ["host", "layout"]).where(most(F.col("n"), F.col("of")))
    out = saved(kept.groupBy("host", "layout").agg(F.collect_list("mark").alias("marks")).join(exemplars, ["host", "layout"]))
    discarded(read, voters, chosen, exemplars, counts)
    return out


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page.

    A null or empty page, or one without an article, has the text ''.  Pages whose address
    is null or names no host are taken as of one nameless host.  Repeated rows stay; other
    columns don't matter; an empty table gives an empty result.
    """
    import pyarrow as pa

    made = templates(pages, url, html)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    given = f"_key {kinds[key]}, _url {kinds[url]}, _html {kinds[html]}, host string"
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html"), host(F.col(url)).alias("host"))
    small = weight_of(made, True) <= BROADCAST
    model = made.sparkSession.sparkContext.broadcast({(r.host, r.layout): ([bytes(x) for x in r.shapes], list(r.marks)) for r in made.toLocalIterator()} if small else {})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                layouts = pa.array([layout(parsed(x)) if x else ALL for x in part.column(2).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, layouts], names=[*part.schema.names, "layout"])

    if not small:
        rows = with_own(rows.mapInArrow(placed, f"{given}, layout long"), made, ["shapes", "marks"]).select("_key", "_url", "_html", "host", "_wide", "_own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], tuple[Template, ...]] = {}
        for batch in batches:
            for part in slices(batch, 2):
                texts = []
                for i, (source, at) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    if not source:
                        texts.append("")
                        continue
                    page = parsed(source)
                    place = at, layout(page)
                    if place not in known:
                        if len(known) > 200:
                            known.clear()
                        if small:
                            found = [model.value[x] for x in ((at, ALL), place) if x in model.value]
                        else:
                            found = [(x["shapes"], x["marks"]) for x in (part.column(c)[i].as_py() for c in (4, 5)) if x]
                        known[place] = tuple(Template(*x) for x in found)
                    texts.append(article(page, known[place]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[key, url, "text", "n_chars"])

    return rows.mapInArrow(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")
