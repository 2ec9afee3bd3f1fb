"""Main text of web pages: site templates found by counting element subtrees per host are removed."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from html.parser import HTMLParser

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._common import saved

#: A subtree is part of the site's template if it recurs in so many different articles of a host and in this share of them,
LEAST_PAGES, LEAST_SHARE = 5, 0.5
#: or, whatever the share, in so many different articles, with so many words (a table cell recurs by chance), and with this
#: share of all articles of any host that hold it (else it is a passage that pages of many hosts share).
MANY_PAGES, LEAST_WORDS, OWN_SHARE = 20, 5, 0.5
#: Most template subtrees (of all hosts) that are sent to every task; beyond it they are handed out by a join.
BROADCAST_TREES = 1_000_000

# fixed values: element names of the HTML standard
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_DROPPED = frozenset("head title script style noscript template nav header footer aside form button input select option textarea iframe object embed svg canvas math audio video dialog menu map link meta".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("thead", "tr", "td", "th")}
_SCOPES = frozenset("html body main article section div ul ol dl table td th blockquote aside nav header footer form figure details".split())
_MARKS = frozenset(
    # fixed values: parts of class names and ids that mark what is not main text
    "ad ads advert adverts advertisement adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar "
    "comment comments commentlist disqus respond reply replies related recommended share sharing social widget widgets skip hidden".split()
)
#: Words that may stand beside a mark in a class name or id without changing what it says.
_COMMENTS = frozenset(("comment", "comments", "related"))
_NEUTRAL = frozenset("box block wrap wrapper container inner outer content area bar list item items section panel main site page global primary secondary top bottom left right header footer text unit slot zone form 1 2 3".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())


class _Node:
    __slots__ = ("tag", "parts", "named", "main")

    def __init__(self, tag: str, named: bool, main: bool):
        self.tag, self.parts, self.named, self.main = tag, [], named, main


def _marked(value: str, marks: frozenset[str]) -> bool:
    """Whether a class name or id says one of ``marks``, alone or beside neutral words (ad-box, but not share-price)."""
    for name in value.lower().split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        if any(x in marks for x in parts) and all(x in marks or x in _NEUTRAL for x in parts):
            return True
    return False


def _is_named(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element is no main text by its name, role, class or style."""
    if tag in _DROPPED:
        return True
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name == "role" and (value or "").lower() in _ROLES:
            return True
        if name in ("class", "id") and value and tag not in ("html", "body", "main") and _marked(value, _COMMENTS if tag == "article" else _MARKS):
            return True
    return False


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("#", False, False)
        self.stack = [self.root]
        self.open: dict[str, list[int]] = {}  # places of the open elements of each name

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _ENDS_P:
            self._close("p", _SCOPES)
        for other in _SIBLINGS.get(tag, ()):
            self._close(other, frozenset(("ul", "ol", "dl", "table", "select")))
        if tag in _VOID:
            if tag in ("br", "hr"):
                self.stack[-1].parts.append(None)
            return
        top = self.stack[-1]
        node = _Node(tag, top.named or _is_named(tag, attrs), tag in ("article", "main") or any(n == "role" and v == "main" for n, v in attrs))
        top.parts.append(node)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in ("p", "div", "span", "article", "section"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._close(tag, frozenset() if tag in _SCOPES else _SCOPES)

    def _close(self, tag: str, stop: frozenset) -> None:
        """Closes the last open element of a name with all in it, unless one of ``stop`` was opened after it."""
        last = lambda name: (self.open.get(name) or (0,))[-1]
        at = last(tag)
        if at and at >= max(map(last, stop), default=0):
            while len(self.stack) > at:
                self.open[self.stack.pop().tag].pop()

    def handle_data(self, data: str) -> None:
        self.stack[-1].parts.append(data)

    def parse_comment(self, i: int, report: bool = True) -> int:
        """Where a comment ends, as browsers see it: an unclosed one takes the rest."""
        raw = self.rawdata
        if m := re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S).match(raw, i):
            return m.end()
        return self.parse_html_declaration(i)

    def parse_html_declaration(self, i: int) -> int:
        """Doctypes, marked sections and whatever else begins like them end at the next angle bracket."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    parse_pi = parse_marked_section = parse_bogus_comment = parse_html_declaration


def _parse(html: str | None) -> _Node:
    html, tree = html or "", _Tree()
    last = html.rfind(">") + 1
    unfinished = re.compile(r"<[/A-Za-z]").search(html, last)  # a tag without an end is none, and takes the rest
    tree.feed(html[: unfinished.start()] if unfinished else html)
    tree.close()
    return tree.root


def _hashes(node: _Node, out: dict[int, int]) -> dict[int, int]:
    """Hashes of all subtrees from their elements, words and children; ``out``: id of each block node -> hash.

    Elements that are no main text by name are hashed too, but do not count as part of what holds them. The lowest
    bit of a block's hash tells whether it holds LEAST_WORDS words.
    """
    # children before parents, without recursion: pages may nest very deeply
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [p for p in x.parts if isinstance(p, _Node)]
    of: dict[int, int] = {}
    words: dict[int, int] = {}
    for x in reversed(order):
        body, n = [x.tag], 0
        for p in x.parts:
            if isinstance(p, str):
                found = p.split()
                body += found
                n += len(found)
            elif p is not None and (x.named or not p.named):
                body.append(f"<{of[id(p)]}>")
                n += words[id(p)]
        of[id(x)] = int.from_bytes(blake2b(" ".join(body).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) & -2 | (n >= LEAST_WORDS)
        words[id(x)] = n
        if len(body) > 1 and x.tag not in _INLINE and x.tag not in ("#", "html", "body") and not x.main:
            out[id(x)] = of[id(x)]
    return of


def _article(root: _Node) -> tuple[int, str, list[int], list[int], list[int], list[int]]:
    """The main elements (the whole page where there are none): hash of what they hold, their text, the hashes
    of their blocks with where each starts and ends in the text, and the hashes of blocks elsewhere."""
    blocks: dict[int, int] = {}
    of = _hashes(root, blocks)
    mains, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.main and not x.named:
            mains.append(x)
        else:
            todo += [p for p in reversed(x.parts) if isinstance(p, _Node)]
    mains = mains or [root]
    out: list[str] = []
    trees, starts, ends, at = [], [], [], 0
    stack: list = list(reversed(mains))
    while stack:
        x = stack.pop()
        if isinstance(x, int):
            ends[x] = at
        elif x is None or isinstance(x, str):
            out.append(x or " ")
            at += len(out[-1])
        elif not x.named:
            edge = [] if x.tag in _INLINE else [" "]
            if id(x) in blocks:
                stack.append(len(trees))
                trees.append(blocks.pop(id(x)))
                starts.append(at)
                ends.append(at)
            stack += [*edge, *reversed(x.parts), *edge]
    content = blake2b(",".join(str(of.get(id(x), 0)) for x in mains).encode(), digest_size=8).digest()
    return int.from_bytes(content, "little", signed=True), "".join(out), trees, starts, ends, list(set(blocks.values()))


def _without(raw: str, blocks: Iterable[tuple[int, int, int]], gone: set[int]) -> str:
    """The text without the blocks (hash, start, end; outer before inner) in ``gone``."""
    out, at = [], 0
    for tree, start, end in blocks:
        if tree in gone and start >= at:
            out.append(raw[at:start])
            at = end
    return " ".join("".join([*out, raw[at:]]).split())


def _host(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return m[1].lower() if m else ""


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("article", pa.int64()), ("raw", pa.string()), ("trees", _LONGS), ("starts", _INTS), ("ends", _INTS), ("others", _LONGS)])


def main_texts(pages: DataFrame) -> DataFrame:
    """For every row (page_id, url, html): page_id, url, text, n_chars, n_template.

    Every block element of a page is hashed with all it holds, whether or not its name, role or class says that it
    is navigation, header, footer, sidebar, form, script, advert, notice or comment; hashes are counted per host, once
    for each different article (body where a page has none), so copies of an article count once. Subtrees in at
    least 5 and half of a host's articles go, and those of 5 words or more in at least 20 of them, unless most of the
    articles that hold such a subtree are other hosts': then it is a passage that sites share. Elements that are
    no main text by name go as well, since many differ from page to page and hosts may have few pages. What is left
    in the article (in the body where a page has none) is the text. n_template counts the page's recurring subtrees.

    Null, empty or textless html gives an empty text; pages without a url share the empty host; a null page_id
    stays null; repeated rows get their text each; an empty table gives no rows; further columns are ignored.
    Nothing is cut short, pages may nest deeply, and broken markup is read as browsers do: comments without an end
    take the rest, odd declarations end at the next bracket, tags without an end are dropped with the rest. Work is in
    proportion to the page, however broken it is. Articles that differ in anything count as different.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    spark = pages.sparkSession

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(_article(_parse(html)) for html in batch.column(2).to_pylist()))) or [()] * 6
            hosts = [_host(u) for u in batch.column(1).to_pylist()]
            columns = [pa.array(x, t) for x, t in zip([hosts, *found], _PARSED.types[2:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], _PARSED.names)

    parsed = saved(pages.mapInArrow(parse, "page_id long, url string, host string, article long, raw string, trees array<long>, starts array<int>, ends array<int>, others array<long>"))
    articles = parsed.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("articles"))
    seen = parsed.select("host", "article", F.explode(F.array_distinct(F.concat("trees", "others"))).alias("tree"))
    counts = seen.groupBy("host", "tree").agg(F.count_distinct("article").alias("n")).filter(f"n >= {LEAST_PAGES}")
    often = saved(counts.join(articles, "host").withColumn("sure", F.expr(f"n >= {LEAST_SHARE} * articles")).filter(f"sure or n >= {MANY_PAGES} and tree & 1 = 1"))
    doubtful = often.filter("not sure")
    gone = often.filter("sure").select("host", "tree")
    if not doubtful.isEmpty():  # a passage that stands on pages of many hosts is none of this one's template
        everywhere = seen.join(doubtful.select("tree").distinct(), "tree", "left_semi").groupBy("host", "tree").agg(F.count_distinct("article").alias("n")).groupBy("tree").agg(F.sum("n").alias("total"))
        gone = saved(gone.union(doubtful.join(everywhere, "tree").filter(f"n >= {OWN_SHARE} * total").select("host", "tree")))
    result = "page_id long, url string, text string, n_chars long, n_template long"

    def rows(batch: pa.RecordBatch, raws: list[str], gone: list[set[int]]) -> pa.RecordBatch:
        trees, starts, ends, others = (batch.column(name).to_pylist() for name in ("trees", "starts", "ends", "others"))
        texts = [_without(raw, zip(*spans), g) for raw, g, *spans in zip(raws, gone, trees, starts, ends)]
        recurring = [len(g.intersection(a) | g.intersection(b)) for g, a, b in zip(gone, trees, others)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(recurring, pa.int64())], ["page_id", "url", "text", "n_chars", "n_template"])

    if gone.count() <= BROADCAST_TREES:
        by_host: dict[str, set[int]] = {}
        for host, tree in gone.collect():
            by_host.setdefault(host, set()).add(tree)
        sent = spark.sparkContext.broadcast(by_host)

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield rows(batch, batch.column("raw").to_pylist(), [sent.value.get(h, set()) for h in batch.column("host").to_pylist()])

        return parsed.mapInArrow(look_up, result)
    # all pages of an article hold the same blocks, so what goes is handed out by article: never more than a page has
    held = parsed.select("host", "article", F.explode(F.array_distinct(F.concat("trees", "others"))).alias("tree"))
    gone = held.join(gone, ["host", "tree"]).groupBy("host", "article").agg(F.collect_set("tree").alias("gone"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([press.compress(raw.encode("utf-8", "surrogatepass")) for raw in batch.column("raw").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if name == "raw" else batch.column(name) for name in _PARSED.names], _PARSED.names)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [zstandard.decompress(x).decode("utf-8", "surrogatepass") for x in batch.column("raw").to_pylist()]
            yield rows(batch, raws, [set(g or ()) for g in batch.column("gone").to_pylist()])

    packed = parsed.mapInArrow(pack, "page_id long, url string, host string, article long, raw binary, trees array<long>, starts array<int>, ends array<int>, others array<long>")
    return packed.join(gone, ["host", "article"], "left").drop("host", "article").mapInArrow(extract, result)
