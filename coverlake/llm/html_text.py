"""HTML extraction (9): content and boilerplate by a minimum cut.

A page is parsed into text blocks with their open elements.  A linear
classifier (tags, class and id words, link share, length, punctuation) gives
each block log-odds of being content, and these become its capacity to the
source (content) or to the sink (boilerplate).  Smoothness edges join each
block with the next one, and with the next one under the same element; their
capacity grows with the share of open elements that both have, and is small
across the border of a menu, an advert or an article.  The minimum
cut is the labelling of least total cost; blocks on the source's side are the
main text.  Scripts, styles, forms' controls and hidden elements give no block.

Each page is worked on where it is read.  Time per page grows with its blocks.

Defined cases: null or empty html gives an empty text; unclosed, misnested
and truncated markup is read as far as it goes (a silent or hidden element
ends with the element around it, and one that holds elements and has no end
at all is passed over); repeated rows are extracted
one by one; other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlake.llm.common import read, small_batches

# Elements and words of the classifier.
BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol
optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("""applet audio canvas datalist iframe math noembed noframes noscript object script select
style svg template textarea title video""".split())
RAW_TAGS = frozenset("iframe noembed noframes script style textarea title".split())     # hold no elements
CLOSES = {
    # an opening tag ends these open elements, up to the nearest of the second set
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button fieldset search".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_WORDS = frozenset("""ad ads adsense advert advertisement advertising adverts banner billboard breadcrumb
breadcrumbs comment commentlist comments consent cookie cookies copyright discussion disqus dock donate feedback footer
gdpr legal login masthead menu menubar modal nav navbar navigation newsletter notice notification outbrain overlay
pager pagination paywall popup privacy promo promoted recommended register related replies reply respond responses
rss share sharing shoutbox sidebar signin signup skip skyscraper social sponsor sponsored subscribe taboola tags
teaser toolbar topbar trending widget widgets""".split())
# Words that also name subjects: inside an article they count little, so that its prose stays.
SUBJECT_WORDS = frozenset("""banner billboard copyright discussion dock donate feedback legal login notice notification
popup privacy register rss skip social tags top trending""".split())
# Words that do so as a part of a longer name only (a study of replies, not the replies).
PART_WORDS = frozenset("promo promoted recommended replies reply respond responses sponsored teaser".split())
HEADER_WORDS = frozenset("header head top".split())
CONTENT_WORDS = frozenset("article articlebody body content entry main post story text".split())
WRAPPER_WORDS = frozenset("has no with without".split())
BOILERPLATE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())

SMOOTH = 1.0
"""Capacity between neighbours with all elements in common."""
BORDER = 0.1
"""Share of that capacity where only one of the two is inside a menu, advert, article or the like."""
WEAK = 3.5
"""Cost of a form outside articles."""
SUBJECT = 2.5
"""Cost, inside an article, of a name that may be a subject: a sentence outweighs it, a short line or a list of links does not."""
SCALE = 1000
_WORD = re.compile(r"[A-Za-z][a-z]*|[0-9]+")


class Element:
    __slots__ = ("tag", "boiler", "content", "number")

    def __init__(self, tag: str, attrs: dict[str, str | None], number: int, inside_content: bool):
        self.tag, self.number = tag, number
        words, strong = set(), set()
        if tag not in ("html", "body"):
            for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
                parts = {w.lower() for w in _WORD.findall(name)} | {name.lower()}
                if not parts & WRAPPER_WORDS:
                    words |= parts
                    strong |= (parts & BOILERPLATE_WORDS) - SUBJECT_WORDS - (PART_WORDS if len(parts) > 1 else frozenset())
        good = bool(words & CONTENT_WORDS)
        self.content = (2.0 if tag in CONTENT_TAGS or attrs.get("itemprop") == "articleBody" or attrs.get("role") == "main"
                        else 1.0 if good else 0.0)
        if tag in BOILERPLATE_TAGS or words & BOILERPLATE_WORDS or attrs.get("role") in BOILERPLATE_ROLES:
            sure = tag in BOILERPLATE_TAGS or strong or attrs.get("role") in BOILERPLATE_ROLES
            # a form around the article is how some servers wrap a page; one inside it is not text
            self.boiler = (WEAK if tag == "form" and not inside_content and not words & BOILERPLATE_WORDS
                           else SUBJECT if inside_content and not sure else 8.0)
        elif tag == "header" or words & HEADER_WORDS and not good:
            self.boiler = 1.0 if inside_content else 5.0
        else:
            self.boiler = 0.0


class Block:
    __slots__ = ("text", "path", "parent", "odds", "region")

    def __init__(self, text: str, path: tuple[int, ...], odds: float, region: tuple[bool, float]):
        self.text, self.path, self.odds, self.region = text, path, odds, region
        self.parent = path[-2] if len(path) > 1 else -1


class PageParser(HTMLParser):
    """Collects the text blocks of a page."""

    def __init__(self, passed: frozenset[tuple[int, int]] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.passed = passed                # places of silent tags that silence nothing
        self.silent: list[tuple[str, int, tuple[int, int]]] = []       # open ones: tag, open elements around it, place
        self.open: list[Element] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.link_chars = self.count = 0
        self.in_link = False
        self.hidden: list[str] = []         # open tags of a hidden element, from its own on

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            region = self.boiler() >= 3.0, max((e.content for e in self.open), default=0.0)
            self.blocks.append(Block(text, tuple(e.number for e in self.open), self.odds(text), region))
        self.parts, self.link_chars = [], 0

    def odds(self, text: str) -> float:
        words = text.count(" ") + 1
        tag = self.open[-1].tag if self.open else "body"
        score = -1.0 + 2.0 * min(1.0, words / 15)
        score += 1.0 if tag in ("p", "pre", "blockquote") else 0.5 if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else -0.5 if tag in ("li", "option", "dt", "dd") else 0.0
        score += 0.5 if text[-1] in ".!?…。:;\"'”»" else 0.0
        score -= 4.0 * min(1.0, self.link_chars / len(text))
        score += 1.5 * min(2.0, max((e.content for e in self.open), default=0.0))
        return score - self.boiler()

    def boiler(self) -> float:
        """The largest cost of the open elements; a weak one ends where an article begins."""
        cost, content = 0.0, False
        for e in reversed(self.open):
            if not (content and e.boiler == WEAK):
                cost = max(cost, e.boiler)
            content = content or e.content > 0
        return cost

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends, limit = CLOSES.get(tag, ((), ()))
        if self.hidden:
            if self.hidden[-1] == "p" and tag in BLOCK_TAGS:
                self.hidden.pop()
            for k in range(len(self.hidden) - 1, -1, -1) if ends else ():
                if self.hidden[k] in ends:
                    del self.hidden[k:]
                    break
                if self.hidden[k] in limit:
                    break
        if self.hidden:
            if tag not in VOID_TAGS:
                self.hidden.append(tag)
            return
        if tag in SILENT_TAGS:
            if self.getpos() not in self.passed:
                self.silent.append((tag, len(self.open), self.getpos()))
            return
        if tag == "body":
            self.silent = [s for s in self.silent if s[0] == "noframes"]
        if tag == "br":
            self.parts.append(" ")
            return
        got = dict(attrs)
        if tag not in VOID_TAGS and ("hidden" in got or got.get("aria-hidden") == "true" or "display:none" in (got.get("style") or "").replace(" ", "").lower()):
            if tag in BLOCK_TAGS:
                self.flush()
            self.hidden = [tag]
            return
        if tag == "a":
            self.in_link = True
        if tag not in BLOCK_TAGS:
            return
        self.flush()
        self.in_link = False
        if tag == "hr":
            return
        floor = self.silent[-1][1] if self.silent else 0
        if len(self.open) > floor and self.open[-1].tag == "p":
            self.open.pop()
        for k in range(len(self.open) - 1, floor - 1, -1) if ends else ():
            if self.open[k].tag in ends:
                del self.open[k:]
                break
            if self.open[k].tag in limit:
                break
        self.count += 1
        self.open.append(Element(tag, got, self.count, any(e.content for e in self.open)))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
                return
            if not any(e.tag == tag for e in self.open):
                return
            self.hidden = []
        if tag in SILENT_TAGS:
            for k in range(len(self.silent) - 1, -1, -1):
                if self.silent[k][0] == tag:
                    del self.open[self.silent[k][1]:], self.silent[k:]
                    break
            return
        if tag == "a":
            self.in_link = False
        if tag not in BLOCK_TAGS:
            return
        self.flush()
        self.in_link = False
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                while self.silent and self.silent[-1][1] > k:
                    self.silent.pop()
                break

    def handle_data(self, data: str) -> None:
        if self.silent or self.hidden or self.open and self.open[-1].tag in ("option", "optgroup"):
            return
        self.parts.append(data)
        if self.in_link:
            self.link_chars += len(" ".join(data.split()))


def parse_page(html: str) -> list[Block]:
    passed: frozenset[tuple[int, int]] = frozenset()
    while True:
        parser = PageParser(passed)
        parser.feed(html)
        parser.close()
        parser.flush()
        endless = {place for tag, _, place in parser.silent if tag not in RAW_TAGS}
        if not endless:
            return parser.blocks
        passed |= endless


def neighbours(blocks: list[Block]) -> Iterator[tuple[int, int, float]]:
    """(block, later block, capacity): next blocks, and next ones under the same element."""
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        before = {k - 1} if k else set()
        if b.parent in last:
            before.add(last[b.parent])
        for j in before:
            a, c = blocks[j].path, b.path
            same = 0
            for x, y in zip(a, c):
                if x != y:
                    break
                same += 1
            border = BORDER if blocks[j].region != b.region else 1.0
            yield j, k, SMOOTH * border * (same + 1) / (max(len(a), len(c)) + 1)
        last[b.parent] = k


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source, by maximum flow (Dinic).  A positive
    ``gain`` is a node's capacity from the source, a negative one to the sink;
    of several minimum cuts the one with the most nodes at the source counts."""
    n = len(gain)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def connect(a: int, b: int, forth: int, back: int) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(forth)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, g in enumerate(gain):
        c = round(abs(g) * SCALE)
        connect(source, k, c, 0) if g >= 0 else connect(k, sink, c, 0)
    for a, b, c in edges:
        connect(a, b, round(c * SCALE), round(c * SCALE))
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        at, path = [0] * (n + 2), []
        node = source
        while True:
            if node == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if not room[e])
                node = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[node] < len(graph[node]):
                e = graph[node][at[node]]
                if room[e] and level[to[e]] == level[node] + 1:
                    break
                at[node] += 1
            else:
                if node == source:
                    break
                e = path.pop()
                node = to[e ^ 1]
                at[node] += 1
                continue
            path.append(e)
            node = to[e]
    reach, queue = {sink}, deque([sink])        # what can still reach the sink is boilerplate
    while queue:
        b = queue.popleft()
        for e in graph[b]:
            if room[e ^ 1] and to[e] not in reach:
                reach.add(to[e])
                queue.append(to[e])
    return [k not in reach for k in range(n)]


def label_page(html: str | None) -> list[tuple[str, bool, float]]:
    """(text, is content, log-odds) of each block in page order."""
    blocks = parse_page(html or "")
    keep = minimum_cut([b.odds for b in blocks], list(neighbours(blocks)))
    return [(b.text, k, b.odds) for b, k in zip(blocks, keep)]


def main_text(html: str | None) -> str:
    return "\n\n".join(t for t, keep, _ in label_page(html) if keep)


def label_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, blocks (array of text, content, odds) of each page."""
    small_batches(pages.sparkSession)
    kind = pa.list_(pa.struct([("text", pa.string()), ("content", pa.bool_()), ("odds", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("text", "content", "odds"), b)) for b in label_page(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["page_id", "blocks"])

    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, blocks array<struct<text:string,content:boolean,odds:double>>")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def q_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))
