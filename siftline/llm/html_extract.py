"""Main text of web pages by paths that the pages of a host agree on.

Pass 1 scores the containers of every page by the text they hold against links and boilerplate, and each page votes for the
generalised path of its best one and of the siblings that read like parts of the same article: tags and classes from the root
down, with numbers made equal. Spark adds the votes up per host. Pass 2 extracts every page from its host's winning path and the
siblings that half of its voters name, or from the page's own best containers where these lead nowhere or to far less. Votes are partial sums, so a host with a third of all pages is no special case.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .words import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp select svg object canvas".split())
SKIPPED = frozenset("nav header footer aside form button menu dialog head fieldset label".split()) | RAW
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section "
    "summary table tbody td tfoot th thead tr ul br".split()
)
CONTAINER = frozenset("page article main section div td body blockquote".split())
#: Words that tell what a container has, or which terms its post is filed under.
WITH = re.compile(r"(?<![^\s-])(?:has|with|without|no|tag|category)-\S+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "summary"} | {"nav", "header", "footer", "aside", "form", "fieldset", "menu"}
CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article main section div td th table ul ol dl body blockquote aside nav header footer form".split())
#: Words in a class, id or role that mark what is no part of an article.
CLUTTER = re.compile(
    r"(?<![a-z])(ads?|adverts?|advertisement|advertising|banner|sponsor(ed)?|promo(tion)?|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|sign-?in|login|sidebar|side|widget|menu|nav(bar|igation)?|breadcrumbs?|pager|pagination|"
    r"header|footer|foot|masthead|toolbar|share|sharing|social|related|recommended|recommendations|comments?|commentlist|reply|replies|"
    r"discussion|disqus|respond|feedback|search(-?(form|box|bar))?|form|skip|hidden|legal|copyright|tags?|metadata|byline-ads)(?![a-z])"
)
#: Those of them that an article's own parts may be named by as well: alone they mark nothing.
WEAK = re.compile(
    r"(?<![a-z])(notice|alert|side|header|footer|foot|share|sharing|social|related|recommended|recommendations|reply|discussion|respond|feedback|"
    r"search(-?(form|box|bar))?|form|skip|legal|copyright|tags?|metadata|promotion|consent|gdpr|subscription|login)(?![a-z])"
)
ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: The host's path holds on a page where it has this share of the score of the page's own best container.
FAR = 0.15
SPACES = re.compile(r"\s+")
NUMBER = re.compile(r"\d+")


class Node:
    """A container that was opened: its place on the page, and the text it holds itself or below."""

    __slots__ = ("tag", "path", "parent", "clutter", "doubt", "start", "end", "text", "links", "paragraphs", "prose", "forms")

    def __init__(self, tag: str, path: str, parent: Node | None, clutter: bool, start: int):
        self.tag, self.path, self.parent, self.clutter, self.start, self.end = tag, path, parent, clutter, start, 0
        #: Words of its class or id that mark clutter: 0 none, 1 weak ones, 2 a strong one.
        self.doubt = 0
        self.text = self.links = self.paragraphs = self.prose = self.forms = 0


class Page:
    """The blocks of a page's visible text in order, and its containers with the range of blocks each one spans."""

    def __init__(self, html: str):
        self.blocks: list[str] = []
        self.owners: list[Node] = []
        self.nodes: list[Node] = []
        self.parts: list[str] = []
        self.nodes.append(Node("page", "", None, False, 0))
        self.open: list[Node] = [self.nodes[0]]
        self.in_link = 0
        self.read(html)

    def read(self, html: str) -> None:
        at, for_end = 0, len(html)
        while at < for_end:
            found = TOKEN.search(html, at)
            if found is None:
                self.add(html[at:])
                break
            self.add(html[at : found.start()])
            at = found.end()
            tag = found.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            if found.group(1):
                self.close(tag)
                continue
            if tag in RAW and not found.group(3).endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else (at if tag in ("svg", "object", "canvas") else for_end)
                continue
            self.begin(tag, found.group(3))
        self.block()
        while self.open:
            self.pop()
        self.settle()

    def add(self, text: str) -> None:
        if text and not self.open[-1].clutter:
            self.parts.append(unescape(text))

    def block(self) -> None:
        if not self.parts:
            return
        text = SPACES.sub(" ", "".join(self.parts)).strip()
        self.parts = []
        if not text:
            return
        node = self.open[-1]
        self.blocks.append(text)
        self.owners.append(node)
        paragraph = any(n.tag == "p" for n in self.open[-3:])
        node.paragraphs += paragraph and len(text) >= 20
        node.prose += len(text) if paragraph else 0
        node.text += len(text)
        node.links += len(text) if self.in_link else 0

    def begin(self, tag: str, attributes: str) -> None:
        if tag in BLOCK or tag in SKIPPED:
            self.block()
        if tag in ("form", "input", "select", "textarea", "button"):
            self.open[-1].forms += 1
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self.close_to("p", SCOPE - {"p"})
        for closed in CLOSED_BY.get(tag, ()):
            self.close_to(closed, SCOPE - {"td", "th"})
        if tag == "a":
            self.in_link += 1
        if tag not in BLOCK and tag not in SKIPPED:
            if "hidden" not in attributes and "class" not in attributes and "role" not in attributes:
                return
        known = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip("/ ") else {}
        names = NUMBER.sub("#", f"{known.get('class', '')}".lower()).split()
        words = f"{known.get('class', '')} {known.get('id', '') if tag != 'section' and tag not in HEADINGS else ''}".lower().replace("_", "-")
        parent = self.open[-1]
        found = [] if tag in ("html", "body", "main", "article") else CLUTTER.findall(WITH.sub(" ", words))
        doubt = 0 if not found else 1 if all(WEAK.fullmatch(x[0]) for x in found) else 2
        clutter = (
            tag in SKIPPED or "hidden" in known or known.get("aria-hidden") == "true"
            or known.get("role", "").lower() in ROLE or "display:none" in known.get("style", "").replace(" ", "").lower()
            or (tag not in BLOCK and (doubt == 2 or (doubt == 1 and tag == "a")))
        )
        if tag not in BLOCK and not clutter:
            return
        path = parent.path + "/" + ".".join([tag, *sorted(names)])
        node = Node(tag, path, parent, clutter or parent.clutter, len(self.blocks))
        node.doubt = doubt
        self.nodes.append(node)
        self.open.append(node)

    def close_to(self, tag: str, scope: frozenset) -> None:
        """Close the nearest open element of this tag within the scope."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                self.block()
                while len(self.open) > i:
                    self.pop()
                return
            if self.open[i].tag in scope:
                return

    def close(self, tag: str) -> None:
        if tag == "a":
            if self.in_link:
                self.flush_link()
            self.in_link = max(0, self.in_link - 1)
        if tag in BLOCK or tag in SKIPPED:
            self.block()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                self.block()
                while len(self.open) > i:
                    self.pop()
                return
            if tag not in SCOPE and self.open[i].tag in SCOPE:
                return

    def flush_link(self) -> None:
        if self.parts:
            self.open[-1].links += len(self.parts[-1])

    def pop(self) -> None:
        node = self.open.pop()
        node.end = len(self.blocks)
        if self.open and not node.clutter:
            self.pass_up(node)

    @staticmethod
    def pass_up(node: Node, sign: int = 1) -> None:
        """Add what a container holds to the one around it, or take it away again from all around it."""
        above = node.parent
        while above is not None:
            above.text += sign * node.text
            above.links += sign * node.links
            above.paragraphs += sign * node.paragraphs
            above.prose += sign * node.prose
            above.forms += sign * node.forms
            above = above.parent if sign < 0 else None

    def settle(self) -> None:
        """Drop the doubtful containers, but none with most of the page's paragraphs, and by weak words only what links or forms speak against too."""
        prose, text = self.nodes[0].prose, self.nodes[0].text
        for node in self.nodes:
            if node.parent is not None and node.parent.clutter:
                node.clutter = True
            if node.clutter or not node.doubt:
                continue
            most = 2 * node.prose > prose if prose else 2 * node.text > text
            if not most and (node.doubt == 2 or node.forms or node.links >= 0.3 * max(node.text, 1)):
                node.clutter = True
                self.pass_up(node, -1)

    def best(self) -> Node | None:
        """The container whose text best looks like an article: much text of its own paragraphs, few links, as deep as may be."""
        return max((n for n in self.nodes if self.score(n) > 0), key=self.score, default=None)

    @staticmethod
    def score(node: Node) -> float:
        if node.clutter or node.tag not in CONTAINER or not node.text:
            return 0.0
        score = (node.text - 2.0 * node.links) * (1.0 + 0.05 * min(node.paragraphs, 10))
        score *= {"article": 2.0, "main": 1.5, "body": 0.5, "page": 0.4, "section": 0.9, "td": 0.7}.get(node.tag, 0.8)
        return score * (0.98 ** node.path.count("/") if node.tag not in ("article", "main") else 1.0)

    def best_paths(self) -> list[str]:
        """The path of the best container, then those of its siblings that are headings or hold paragraphs and few links."""
        best = self.best()
        if best is None:
            return []
        paths = {best.path: None}
        if best.tag not in ("article", "main", "td"):
            for node in self.nodes:
                if node.parent is best.parent and not node.clutter and not node.doubt and node.links < 0.3 * node.text and (node.tag in HEADINGS or node.paragraphs):
                    paths[node.path] = None
        return list(paths)

    def text_of(self, node: Node) -> str:
        return " ".join(x for x, owner in zip(self.blocks[node.start : node.end], self.owners[node.start : node.end]) if not owner.clutter)

    def text_at(self, paths: list[str]) -> str | None:
        """The text of the outermost containers with these paths, or None where there are none with text."""
        found, end = [], -1
        for node in self.nodes:
            if node.path in paths and not node.clutter and node.start >= end:
                found.append(self.text_of(node))
                end = node.end
        text = " ".join(x for x in found if x)
        return text or None


def host_of(url: Column) -> Column:
    """The host of a URL, in lower case and without port; empty for a null or relative one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def page_votes(pages: DataFrame, html_col: str) -> DataFrame:
    """(host, lead, path): each page's best container as lead and path, and the siblings that go with it."""

    def run(batches):
        for batch in batches:
            hosts, leads, paths = [], [], []
            for host, html in zip(batch["host"].to_pylist(), batch[html_col].to_pylist()):
                found = Page(html).best_paths() if html else []
                hosts += [host] * len(found)
                leads += found[:1] * len(found)
                paths += found
            yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "lead": pa.array(leads, pa.string()), "path": pa.array(paths, pa.string())})

    return pages.mapInArrow(run, "host string, lead string, path string")


def host_paths(votes: DataFrame) -> DataFrame:
    """(host, path): the lead with the most votes of each host, of equal ones the first by a hash, and the siblings half of its voters name, one a line."""
    counted = votes.groupBy("host", "lead", "path").agg(F.count(F.lit(1)).alias("n"))
    leads = counted.groupBy("host", "lead").agg(
        F.max(F.when(F.col("path") == F.col("lead"), F.col("n"))).alias("n"), F.collect_list(F.struct("path", "n")).alias("siblings")
    )
    named = F.transform(F.filter("siblings", lambda x: (x["n"] * 2 >= F.col("n")) & (x["path"] != F.col("lead"))), lambda x: x["path"])
    leads = leads.select("host", "lead", "n", F.array_join(F.concat(F.array("lead"), F.array_sort(named)), "\n").alias("path"))
    return leads.groupBy("host").agg(F.max_by("path", F.struct("n", F.struct((-F.xxhash64("lead")).alias("h"), "lead"))).alias("path"))


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", text_col: str = "text") -> DataFrame:
    """Add the main text of every page.

    Blocks are joined by one space, white space inside them is one space, character references are decoded; nothing else is dropped or cut. A null
    or empty page, or one without text outside its clutter, gives an empty text. Pages without a host form a host of their own. Repeated rows
    vote as often as they stand there. A column named like the result is replaced; other columns stay; an empty table gives an empty result.
    """
    kept = [f for f in pages.schema.fields if f.name != text_col]
    schema = StructType([*kept, StructField(text_col, StringType())])
    rows = pages.select(F.struct(*[F.col(f"`{f.name}`") for f in kept]).alias("row"), host_of(F.col(url_col)).alias("host"))
    winners = host_paths(page_votes(pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")), "html"))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, f"row.{html_col}")):
            row = batch["row"]
            texts = []
            for html, path in zip(row.field(html_col).to_pylist(), batch["path"].to_pylist()):
                texts.append(main_text(html, path))
            yield pa.RecordBatch.from_arrays([*row.flatten(), pa.array(texts, pa.string())], names=schema.names)

    return rows.join(winners, "host", "left").select("row", "path").mapInArrow(run, schema)


def main_text(html: str | None, path: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    if path:
        paths = path.split("\n")
        # Far less than the page's own best container holds: the host's path is that of another template.
        if max((page.score(n) for n in page.nodes if n.path in paths), default=0.0) >= FAR * max((page.score(n) for n in page.nodes), default=0.0):
            text = page.text_at(paths)
            if text is not None:
                return text
    return page.text_at(page.best_paths()) or ""
