"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events; block elements cut the page into lines, each with its characters of text and its
number of tags. The ratios, smoothed by a Gaussian over neighbouring lines, are split at the threshold that separates two
clusters best. The runs of content lines vote for the container (article, main, the element that holds most of them) that is the
content region; all lines in the region are kept, short ones too, save those in menus, headers, footers, side bars, forms,
notices, adverts and comments. Names of classes and ids mark no page, main element or article, no paragraph, list item or other
block of text in an article, and nothing that holds most of the text, unless an article stands elsewhere; where they would leave
out all lines, they are passed over and the ratios decide. So are forms, asides and hidden elements: pages are wrapped in them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, fields, kept

#: Elements by what they mean for text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style noscript template svg math iframe object head title textarea select button canvas audio video map datalist".split())
BOILERPLATE = frozenset("nav footer menu dialog".split())
#: Elements that are marks like names: a page may stand in one, or one may never be closed.
SOFT = frozenset("form aside".split())
#: Blocks of text, which names don't mark inside an article.
TEXTS = frozenset("p blockquote h1 h2 h3 h4 h5 h6 li dt dd td th tr figure figcaption pre caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first kind ends when one of the second starts.
CLOSES = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": BLOCKS, "optgroup": BLOCKS - {"option"}, "select": BLOCKS - {"option", "optgroup", "hr"}}
#: Parts of class, id and role names (letters between other characters) of what isn't the article.
NOISE = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login sidebar sidebars widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead toolbar share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies reviews copyright".split())
#: First parts of names that say what a page has or hasn't, or what it is about.
NEUTRAL = frozenset("has no not with without is category tag".split())
#: What a head may hold; anything else ends it.
HEAD = frozenset("title meta link script style base noscript template".split())
#: Elements that such names don't mark.
WHOLE = frozenset("html body main article".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Containers that say themselves that they hold the content.
NAMED = frozenset("article main".split())
CONTAINERS = frozenset("article main section div td body html".split())
SPACES = re.compile(r"\s+")
PARTS = re.compile(r"[a-z]+")
#: Standard deviation of the smoothing, in lines.
SIGMA = 1.5


class Line:
    """at, mark: the numbers of the innermost container and of the innermost element marked by name around it (0: none)."""

    __slots__ = ("at", "mark", "noise", "tags", "text")

    def __init__(self, at: int, noise: bool, mark: int):
        self.at, self.noise, self.mark, self.text, self.tags = at, noise, mark, [], 0


class Lines(HTMLParser):
    """Cuts a page into lines at block elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # tag, innermost container, noise, hidden, innermost element marked by name (each with what it inherits)
        self.open: list[tuple[str, int, bool, bool, int]] = []
        self.within: Counter[str] = Counter()  # open elements by tag
        self.kinds: dict[int, str] = {0: ""}
        self.parent: dict[int, int] = {}  # of containers
        self.marks: dict[int, tuple[int, int]] = {}  # the mark and the container around each element marked by name
        self.number = 0
        self.current: Line | None = None
        self.read, self.last_end, self.last_comment = "", -1, -1

    def line(self) -> Line:
        if self.current is None:
            _, at, noise, _, mark = self.open[-1] if self.open else ("", 0, False, False, 0)
            self.current = Line(at, noise, mark)
            self.lines.append(self.current)
        return self.current

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.open and (tag in CLOSES.get(self.open[-1][0], ()) or self.open[-1][0] == "head" and tag not in HEAD):
            self.within[self.open.pop()[0]] -= 1
        if tag in BLOCKS:
            if self.within["p"]:  # formatting elements may stand between
                self.close("p")
            self.current = None
        elif tag == "br" and self.current is not None:
            self.current.text.append(" ")
        self.line().tags += 1
        if tag in VOID:
            return
        _, at, noise, hidden, mark = self.open[-1] if self.open else ("", 0, False, False, 0)
        if not noise:
            noise = tag in BOILERPLATE or tag == "header" and not self.within["article"] + self.within["main"] or self.marked(attrs)
        self.number += 1
        inside = tag in TEXTS and self.within["article"] + self.within["main"]
        if not noise and (tag in SOFT or self.unseen(attrs) or tag not in WHOLE and not inside and self.named(attrs)):
            self.marks[self.number], mark = (mark, at), self.number
        if tag in CONTAINERS:
            self.kinds[self.number], self.parent[self.number], at = tag, at, self.number
        self.open.append((tag, at, noise, hidden or tag in HIDDEN, mark))
        self.within[tag] += 1
        if tag in BLOCKS:
            self.current = None

    @staticmethod
    def named(attrs: list[tuple[str, str | None]]) -> bool:
        for name, value in attrs:
            if name in ("class", "id") and value:
                for word in value.lower().split():
                    parts = PARTS.findall(word)
                    if parts and parts[0] not in NEUTRAL and not NOISE.isdisjoint(parts):
                        return True
        return False

    @staticmethod
    def marked(attrs: list[tuple[str, str | None]]) -> bool:
        for name, value in attrs:
            if name == "role" and value and value.lower() in ROLES:
                return True
        return False

    @staticmethod
    def unseen(attrs: list[tuple[str, str | None]]) -> bool:
        return any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs)

    def close(self, tag: str) -> None:
        while self.within[tag]:  # what is open inside it ends with it
            closed = self.open.pop()[0]
            self.within[closed] -= 1
            if closed == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        if self.current is not None:
            self.current.tags += 1
        self.close(tag)
        if tag in BLOCKS:
            self.current = None

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers aren't needed."""
        return j

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections, which the base class refuses when malformed, are comments in HTML."""
        return self.parse_bogus_comment(i)

    def ends(self, i: int, comment: bool = False) -> bool:
        """Whether what starts at i has an end. The last ends are looked for once, not from every start."""
        if self.read is not self.rawdata:
            self.read, self.last_end = self.rawdata, self.rawdata.rfind(">")
            self.last_comment = max(self.rawdata.rfind(x) for x in ("-->", "--!>"))
        return i < (self.last_comment if comment else self.last_end)

    def to_the_end(self, i: int) -> int:
        """What never ends is text, all at once."""
        self.handle_data(self.rawdata[i:])
        return len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        return super().parse_starttag(i) if self.ends(i) else self.to_the_end(i)

    def parse_endtag(self, i: int) -> int:
        return super().parse_endtag(i) if self.ends(i) else self.to_the_end(i)

    def parse_pi(self, i: int) -> int:
        return super().parse_pi(i) if self.ends(i) else self.to_the_end(i)

    def parse_html_declaration(self, i: int) -> int:
        return super().parse_html_declaration(i) if self.ends(i) or self.rawdata.startswith("<!--", i) else self.to_the_end(i)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment that never ends goes on to the end."""
        return super().parse_comment(i, report) if self.ends(i, True) else len(self.rawdata)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][3]:
            return
        if self.current is None and data.isspace():
            return
        self.line().text.append(data)


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; the weights at the edges are those inside."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratio, kernel)[reach : reach + len(ratio)] / np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]


def threshold(values: np.ndarray) -> float:
    """The cut between two clusters of least squared error; 0 if all are alike."""
    v = np.sort(values)
    if len(v) < 2 or v[0] == v[-1]:
        return 0.0
    n, s, q = np.arange(1, len(v)), np.cumsum(v)[:-1], np.cumsum(v * v)[:-1]
    left = q - s * s / n
    right = (v @ v - q) - (v.sum() - s) ** 2 / (len(v) - n)
    error = np.where(v[1:] > v[:-1], left + right, np.inf)
    i = int(error.argmin())
    return float((v[i] + v[i + 1]) / 2)


def extract(html: str | None) -> str:
    """The page's main text: blocks in page order joined by two newlines; empty for null, empty or textless pages."""
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    HTMLParser.close(p)
    texts = [(line, SPACES.sub(" ", "".join(line.text)).strip()) for line in p.lines]
    texts = [(line, t) for line, t in texts if t]
    if not texts:
        return ""
    tree = Tree(p)
    noise = _noise(tree, texts)
    ratio = np.array([0.0 if out else len(t) / max(1, line.tags) for out, (line, t) in zip(noise, texts, strict=True)])
    score = smoothed(ratio)
    content = (score > threshold(score)) & (ratio > 0)
    if not content.any():
        content = ratio > 0
    regions = _regions(tree, [line for line, _ in texts], noise, content, np.array([len(t) for _, t in texts]), ratio)
    return "\n\n".join(t for out, (line, t) in zip(noise, texts, strict=True) if not out and (not regions or any(tree.inside(line.at, r) for r in regions)))


class Tree:
    """The containers of a page. Numbers rise in page order, so those inside a container follow it without a gap."""

    def __init__(self, p: Lines):
        self.kinds, self.parent, self.marks = p.kinds, p.parent, p.marks
        self.last = {c: c for c in self.parent} | {0: 0}  # the last container inside each
        for c in sorted(self.parent, reverse=True):
            self.last[self.parent[c]] = max(self.last[self.parent[c]], self.last[c])

    def inside(self, at: int, container: int) -> bool:
        return container <= at <= self.last[container]

    def held(self, lines: list[Line], sizes: Iterable[int]) -> dict[int, int]:
        """Characters inside each container."""
        total: dict[int, int] = {}
        for line, n in zip(lines, sizes, strict=True):
            total[line.at] = total.get(line.at, 0) + int(n)
        for c in sorted(self.parent, reverse=True):
            if n := total.get(c):
                total[self.parent[c]] = total.get(self.parent[c], 0) + n
        return total

    def named_below(self, held: dict[int, int]) -> dict[int, int]:
        """Characters of the articles and main elements by the next such element around them (0: none), those inside not again."""
        nearest, total = {0: 0}, {}
        for c in sorted(self.parent):
            p = self.parent[c]
            nearest[c] = p if self.kinds[p] in NAMED else nearest[p]
            if self.kinds[c] in NAMED:
                total[nearest[c]] = total.get(nearest[c], 0) + held.get(c, 0)
        return total

    def named_around(self, at: int) -> list[int]:
        """The articles and main elements that a container is or stands in, from the outermost."""
        found = []
        while at:
            if self.kinds[at] in NAMED:
                found.append(at)
            at = self.parent[at]
        return found[::-1]


def _noise(tree: Tree, texts: list[tuple[Line, str]]) -> list[bool]:
    """Which lines are left out. Marks by name are passed over if they leave nothing, and at an element that holds most of the text,
    unless an article or main element that isn't around it holds a tenth as much without marks."""
    held: dict[int, int] = {}
    seen = [(line, len(t)) for line, t in texts if not line.noise]
    for line, n in seen:
        held[line.mark] = held.get(line.mark, 0) + n
    for m in sorted(tree.marks, reverse=True):
        if n := held.get(m):
            held[tree.marks[m][0]] = held.get(tree.marks[m][0], 0) + n
    total = sum(n for _, n in seen)
    most = [m for m in sorted(tree.marks) if 2 * held.get(m, 0) > total]  # each inside the one before: any two share a line
    passed = set()
    if most:
        plain = tree.held([line for line, _ in seen if not line.mark], [n for line, n in seen if not line.mark])
        below = tree.named_below(plain)
        around = tree.named_around(tree.marks[most[-1]][1])
        elsewhere, k = below.get(0, 0), 0  # in the outermost articles and main elements that aren't around the mark
        for m in most:
            while k < len(around) and around[k] < m:
                elsewhere += below.get(around[k], 0) - plain.get(around[k], 0)
                k += 1
            if 10 * elsewhere < held[m]:
                passed.add(m)
    out = {0: False}  # whether a mark or one around it leaves out what it holds
    for m in sorted(tree.marks):
        out[m] = m not in passed or out[tree.marks[m][0]]
    noise = [line.noise or out[line.mark] for line, _ in texts]
    return [line.noise for line, _ in texts] if all(noise) else noise


def _regions(tree: Tree, lines: list[Line], noise: list[bool], content: np.ndarray, size: np.ndarray, ratio: np.ndarray) -> list[int]:
    """The innermost container that holds nearly all of the content; articles and main elements come first, if they hold half of it
    or their text has as few tags as that around them. An article is joined by those beside it whose text has at most twice as
    many tags. None: the whole page."""
    held = tree.held([line for line, yes in zip(lines, content, strict=True) if yes], size[content])
    total = int(size[content].sum())
    own = ~np.array(noise)
    seen = [line for line, yes in zip(lines, own.tolist(), strict=True) if yes]
    text, tags = tree.held(seen, size[own]), tree.held(seen, np.array([max(1, line.tags) for line in seen]))
    density = lambda c: text.get(c, 0) / max(1, tags.get(c, 0))
    for kind in ("article", "main"):
        named = [(n, -c) for c, n in text.items() if tree.kinds[c] == kind and c]
        if not named:
            continue
        best = -max(named)[1]
        around = (text[0] - text[best]) / max(1, tags[0] - tags[best]) if 0 in text else 0.0
        if held.get(best, 0) >= 0.5 * total or density(best) >= around:
            return [c for c in text if tree.kinds[c] == kind and tree.parent[c] == tree.parent[best] and 2 * density(c) >= density(best)]
    most = [c for c, n in held.items() if c and n >= 0.9 * total]
    return [max(most)] if most else []


def extract_text(df: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The kept columns plus text and n_chars (its code points). Null and empty pages have an empty text; repeated rows each give a
    row, an empty table none; pages of any length are read whole. A kept column named as a result comes out as input_<name>."""
    chosen = df.select(*kept(df, keep, "text", "n_chars"), df[html].alias("__html"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(h) for h in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])

    return arrow_map(chosen, rows, ", ".join([*fields(chosen.schema)[:-1], "text string", "n_chars long"]))
