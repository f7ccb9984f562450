"""Main-text extraction with consensus host paths.

Every page's containers are scored by the text they hold and the page votes for the
generalised tag-class path of its best one. Spark counts the votes of each host; the
winning path is then used to extract every page of the host again, and a page without
such a container uses its own best.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesoro.llm.common import prepare, read, steps, store, values

# Elements whose content is never main text.
DROPPED_TAGS = frozenset("head script style noscript template nav header footer aside form iframe svg math button "
                         "select textarea input object embed canvas menu dialog video audio map title".split())
# Words that mark such content as the last word of a class, id or role; layout words
# may follow.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar sidenav aside footer header masthead topbar toolbar notice "
    "notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist disqus respond reply "
    "replies pagination pager widget widgets search copyright complementary contentinfo dialog form".split())
LAYOUT_WORDS = frozenset("area bar block box buttons container inner item items links list section slot unit wrap wrapper".split())
# As a last word one of these needs a dropped word before it: a long form is no form.
GENERAL_WORDS = frozenset("form notice related search share social".split())
# A name that begins so tells what a page has, or what it is about.
STATE_WORDS = frozenset("has have no not with without is category cat tag tags topic".split())
# A marked container that holds most of the page's text, or is an article or main, is
# dropped only if a main container holds this share of its text outside of it.
MAIN_TAGS = frozenset(["article", "main"])
EVIDENCE_SHARE = 0.05
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
CONTAINER_TAGS = frozenset("article main section div td body blockquote center".split())
BLOCK_TAGS = CONTAINER_TAGS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr th caption pre address figure figcaption "
    "fieldset legend details summary hr html header footer nav aside form hgroup search menu dialog option".split())
# A new one of these ends an open one, unless a tag of the second set is open in between.
IMPLIED_END = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}),
               "tr": ("tr", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}),
               "option": ("option", {"select"})}
# Weight of a container's text: a likely name for main text counts more.
TAG_WEIGHT = {"article": 3.0, "main": 2.0, "body": 0.25}
MAIN_WORDS = frozenset("article content post entry story main text".split())
MAIN_WORD_WEIGHT = 1.5
# A container's share of the text in the containers inside it.
INNER_SHARE = 0.5
# The container around wins if it has this share of the best one's text beside that.
BESIDE_SHARE = 1 / 3
ROOT = "html"

# An attribute, or the end of a tag. A quoted value is taken up to its quote.
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:([\"'])|([^\s>]++))?)?)")
_TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
# Characters of a quoted value; a longer one has a quote that isn't closed.
VALUE_CHARS = 20_000
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Tokens:
    """The tags of a page and the text between them, in one pass forward: a tag that has
    no end is text, and so is all that follows."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.loose = False  # quotes don't count any more

    def __iter__(self) -> Iterator[tuple[str, str, dict[str, str] | None]]:
        """``(text, "", None)``, ``("", name, attributes)`` of a tag, or ``("", name,
        None)`` of an end tag."""
        page, at, text = self.page, 0, 0
        while (at := page.find("<", at)) >= 0:
            name, end = None, 0
            if page.startswith("<!--", at):
                end, found = page.find("-->", at), None
                end = end + 3 if end >= 0 else len(page)
            elif at > self.last:
                pass
            elif name := _TAG_NAME.match(page, at + 1):
                end, found = self._attributes(name.end())
            elif page.startswith(("!", "?"), at + 1):
                end, found = page.find(">", at) + 1, None
            if not end:
                at += 1
                continue
            if text < at:
                yield page[text:at], "", None
            self.at = end
            if name:
                yield "", name[2].lower(), None if name[1] else found
            at = text = self.at
        if text < len(page):
            yield page[text:], "", None

    def _attributes(self, at: int) -> tuple[int, dict[str, str]]:
        """End of the tag whose name ends at ``at``, 0 if there is none, and its
        attributes; of two of one name the first counts."""
        page, found = self.page, {}
        if page.startswith(">", at):
            return at + 1, found
        first = page.find(">", at) + 1
        start = at
        while not self.loose:
            m = _ATTRIBUTE.match(page, at)
            if not m:  # the page is over: from here on a tag ends with the first >
                self.loose = True
                break
            if m[1]:
                return m.end(), found
            at = m.end()
            value = m[4] or ""
            if m[3]:
                end = page.find(m[3], at, at + VALUE_CHARS + 1)
                if end < 0:
                    break
                value, at = page[at:end], end + 1
            found.setdefault(m[2].lower(), value)
        found = {}
        for m in _ATTRIBUTE.finditer(page, start, max(start, first - 1)):
            if m[2]:
                found.setdefault(m[2].lower(), m[4] or "")
        return first, found

    def skip_raw(self, tag: str) -> None:
        """Go on after the end tag of an element without markup inside."""
        end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(self.page, self.at)
        close = self.page.find(">", end.end()) if end else -1
        self.at = close + 1 if close >= 0 else len(self.page)


class Block:
    """A block's text, the letters of it that are links, the container around it, the
    innermost marked element around it (-1: none), and whether it is in a heading."""
    __slots__ = ("text", "link", "node", "mark", "heading")

    def __init__(self, text: str, link: int, node: int, mark: int = -1, heading: bool = False):
        self.text, self.link, self.node, self.mark, self.heading = text, link, node, mark, heading

    @property
    def letters(self) -> int:
        return max(0, len(self.text) - self.link)


class Page:
    """The blocks of a page in order, and the tree of its containers: one node for each
    generalised path, after its parent."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parent, self.label, self.main = [-1], [ROOT], [False]
        self.known: dict[tuple[int, str], int] = {}

    def node(self, parent: int, label: str) -> int:
        if (parent, label) not in self.known:
            self.known[parent, label] = len(self.parent)
            self.parent.append(parent)
            self.label.append(label)
            self.main.append(self.main[parent] or _is_main(label))
        return self.known[parent, label]

    def path(self, node: int) -> str:
        labels = []
        while node >= 0:
            labels.append(self.label[node])
            node = self.parent[node]
        return ">".join(reversed(labels))

    def find(self, path: str | None) -> int | None:
        """The node of a path."""
        labels = (path or "").split(">")
        node = 0 if labels[0] == ROOT else None
        for label in labels[1:]:
            node = self.known.get((node, label)) if node is not None else None
        return node

    def inside(self, node: int | None) -> list[Block]:
        """The blocks in the containers of a node."""
        if node is None:
            return []
        under = [False] * len(self.parent)
        for i in range(node, len(self.parent)):
            under[i] = i == node or self.parent[i] >= 0 and under[self.parent[i]]
        return [b for b in self.blocks if under[b.node]]


@lru_cache(maxsize=1 << 16)
def _marked(name: str) -> bool:
    """Whether a class, id or role names content that isn't main text."""
    words = _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
    if not words or words[0] in STATE_WORDS:
        return False
    while len(words) > 1 and words[-1] in LAYOUT_WORDS:
        words.pop()
    if words[-1] in GENERAL_WORDS and len(words) > 1:
        return not DROPPED_WORDS.isdisjoint(words[:-1])
    return words[-1] in DROPPED_WORDS


def _label(tag: str, attributes: dict[str, str]) -> tuple[str, bool, bool]:
    """``(tag with its generalised classes, dropped, marked by a name)``: class names are
    lower-cased, digits become ``#``, and they are sorted."""
    if (tag in DROPPED_TAGS or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
            or _HIDDEN.search(attributes.get("style", ""))):
        return tag, True, False
    marked = tag not in ("body", "html") and any(
        map(_marked, f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}".split()))
    classes = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", attributes.get("class", "")).lower().replace(">", "")
    return ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in classes.split()})]), False, marked


def _is_main(label: str) -> bool:
    tag, _, classes = label.partition(".")
    return tag in MAIN_TAGS or not MAIN_WORDS.isdisjoint(_WORD.findall(classes))


def _drop_marked(page: Page, tags: list[str], around: list[int]) -> None:
    """Take the blocks in marked elements out; ``tags`` are those elements' tags, ``around``
    the marked elements they are in. An element that holds most of the text, or is an
    article or main, counts as marked only beside other main text; the largest are
    decided first."""
    size = [0] * len(tags)
    for block in page.blocks:
        if block.mark >= 0:
            size[block.mark] += len(block.text)
    for i in range(len(tags) - 1, -1, -1):
        if around[i] >= 0:
            size[around[i]] += size[i]
    total = sum(len(b.text) for b in page.blocks)
    marked = [True] * len(tags)

    def covered(also: int = -1) -> list[bool]:
        """Which elements are in a marked one or in ``also``; the last entry: outside of all."""
        out: list[bool] = []
        for i, mark in enumerate(marked):
            out.append(mark or i == also or around[i] >= 0 and out[around[i]])
        return [*out, False]

    for mark in sorted(range(len(tags)), key=lambda i: (-size[i], i)):
        if size[mark] and (tags[mark] in MAIN_TAGS or 2 * size[mark] > total):
            gone = covered(mark)
            others = sum(len(b.text) for b in page.blocks if not b.heading and not gone[b.mark] and page.main[b.node])
            if others < EVIDENCE_SHARE * size[mark]:
                marked[mark] = False
    gone = covered()
    page.blocks = [b for b in page.blocks if not gone[b.mark]]


def blocks(source: str) -> Page:
    """The text blocks of a page outside of dropped content, in page order. Time and
    memory are linear in the page's length, also for broken markup and deep nesting (but
    for marked elements that hold most of the page in one another: each is looked at)."""
    page = Page()
    tags: list[str] = []  # of the marked elements
    around: list[int] = []
    stack: list[tuple[str, int, bool, int]] = [("", 0, False, -1)]  # tag, container, dropped, marked element
    opened: Counter[str] = Counter()
    pieces: dict[int, list[str]] = {}  # by the marked element around: an inline one may be marked
    link_letters: dict[int, int] = {}

    def flush() -> None:
        for mark, held in pieces.items():
            text = " ".join("".join(held).split())
            if text:
                page.blocks.append(Block(text, link_letters.get(mark, 0), stack[-1][1], mark,
                                         any(entry[0] in HEADINGS for entry in stack[-3:])))
        pieces.clear()
        link_letters.clear()

    def close(depth: int) -> None:
        opened.subtract(entry[0] for entry in stack[depth:])
        del stack[depth:]

    def add(text: str) -> None:
        _, _, dropped, mark = stack[-1]
        if not dropped:
            text = html.unescape(text) if "&" in text else text
            pieces.setdefault(mark, []).append(text)
            if opened["a"] > 0:
                link_letters[mark] = link_letters.get(mark, 0) + len(text.strip())

    tokens = Tokens(source)
    for text, tag, attributes in tokens:
        if not tag:
            add(text)
            continue
        if attributes is None:  # an end tag
            if opened[tag] > 0:
                depth = next(d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == tag)
                if any(t in BLOCK_TAGS for t, *_ in stack[depth:]):
                    flush()
                close(depth)
            continue
        if tag in RAW_TAGS:
            tokens.skip_raw(tag)
            continue
        if tag in VOID_TAGS:
            if tag == "hr":
                flush()
            elif tag == "br":
                add(" ")
            continue
        if tag == "body":  # also ends an open head
            flush()
            close(next((i for i, s in enumerate(stack) if s[0] == "head"), len(stack)) if opened["head"] > 0 else len(stack))
        if tag in BLOCK_TAGS:
            flush()
            ends, barrier = IMPLIED_END.get(tag, ("p", BLOCK_TAGS - {"p"}))
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in ends.split():
                    close(depth)
                    break
                if stack[depth][0] in barrier:
                    break
        label, dropped, marked = _label(tag, attributes)
        _, node, outside, mark = stack[-1]
        if tag in CONTAINER_TAGS:
            node = page.node(node, label)
        if marked and not (dropped or outside):
            around.append(mark)
            mark = len(tags)
            tags.append(tag)
        opened[tag] += 1
        stack.append((tag, node, dropped or outside, mark))
    flush()
    if tags:
        _drop_marked(page, tags, around)
    return page


def _weight(label: str) -> float:
    tag, _, classes = label.partition(".")
    weight = TAG_WEIGHT.get(tag, 1.0)
    return weight * MAIN_WORD_WEIGHT if not MAIN_WORDS.isdisjoint(_WORD.findall(classes)) else weight


def _best(page: Page) -> tuple[int, float] | None:
    """The container of the highest score and that score; None without text. A block
    counts its letters outside of links for its container, a share of that for the
    container around it, and so on. Ties go to the inner container, then to the first
    one. Where comparable text stands beside the best containers, in the one around them,
    that one wins; not around an article or main."""
    if not page.blocks:
        return None
    score, letters = [0.0] * len(page.parent), [0] * len(page.parent)
    depth = [0] * len(page.parent)
    for block in page.blocks:
        score[block.node] += block.letters + 1e-3
        letters[block.node] += block.letters
    for i in range(len(score) - 1, 0, -1):
        score[page.parent[i]] += INNER_SHARE * score[i]
        letters[page.parent[i]] += letters[i]
    for i in range(1, len(depth)):
        depth[i] = depth[page.parent[i]] + 1
    weighted = [s * (_weight(page.label[i]) if i else 0.1) for i, s in enumerate(score)]
    node = min((i for i, s in enumerate(score) if s), key=lambda i: (-weighted[i], -depth[i], i))
    while node and page.label[node].partition(".")[0] not in MAIN_TAGS:
        beside = letters[page.parent[node]] - letters[node]
        if not beside or beside < BESIDE_SHARE * letters[node]:
            break
        node = page.parent[node]
    return node, weighted[node]


def best_path(page: Page) -> tuple[str, float] | None:
    """The page's vote: the path of its best container and the score."""
    found = _best(page)
    return found and (page.path(found[0]), found[1])


def extract(page: Page, path: str | None) -> str:
    """The blocks inside the containers of ``path``, or of the page's own best one if
    there are none, joined by newlines."""
    inside = page.inside(page.find(path))
    if not inside and (own := _best(page)):
        inside = page.inside(own[0])
    return "\n".join(b.text for b in inside)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """``(host, path, votes)``: the path that most pages of a host vote for; ties go to
    the higher total score, then to the path that sorts last."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "html"):
            found = [best_path(blocks(p or "")) for p in values(step, "html")]
            yield pa.RecordBatch.from_arrays(
                [step.column(0), pa.array([f and f[0] for f in found], pa.string()),
                 pa.array([f and f[1] for f in found], pa.float64())], ["host", "path", "score"])

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(
        vote, "host string, path string, score double").where("path IS NOT NULL")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    return counted.groupBy("host").agg(F.max(F.struct("votes", "score", "path")).alias("won")).select(
        "host", F.col("won.path").alias("path"), F.col("won.votes").alias("votes"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, path`` of every row: the main text, and the path that the
    host's pages agree on.

    Null, empty and text-less pages give an empty text. Very long pages are read whole;
    of broken markup a tag without an end is text, a quote that isn't closed doesn't
    count, and end tags without a start are passed over. Null URLs share the empty host.
    Repeated rows vote and are extracted each. Other columns are not read.
    """
    winners = store(host_paths(pages), "host-paths")  # stored: its size decides how it is joined
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html").join(winners, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "html"):
            texts = [extract(blocks(p or ""), path) for p, path in zip(values(step, "html"), values(step, "path"))]
            yield pa.RecordBatch.from_arrays(
                [step.column(0), step.column(1), pa.array(texts, pa.string()), step.column(2)],
                ["page_id", "url", "text", "path"])

    kind = dict(pages.dtypes)["page_id"]
    return rows.select("page_id", "url", "path", "html").mapInArrow(
        run, f"page_id {kind}, url string, text string, path string")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    prepare(spark)
    found = extract_pages(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "path")
