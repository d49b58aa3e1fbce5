"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one for each block element. Menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, scripts and styles leave an empty stretch of lines behind; an element cut for its name stays where it holds more than half of the page's or article's text. The lengths of the lines are summed over a sliding window; a
surge is where the sum rises from nothing, a dive is where it falls back to nothing, and the text between a surge
and its dive is a candidate. Containers whose peak is small against the page's highest are furniture; what is cut out of a container
does not divide it. Where the page marks an article or main element, candidates inside it stand for the page, unless the article
is small against the text outside.

Defined results: null and empty html give empty text; unclosed elements end where their container ends; character references are
decoded once; white space inside a block becomes one space; blocks are joined by a blank line; repeated rows are treated alike; pages
of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines that a sliding window covers; as many empty lines stand for what was cut out.
WINDOW = 3
#: Peak of a container's text, as a share of the page's highest, that furniture stays below; likewise an article beside the page's text.
FURNITURE = 0.3

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[a-z]+")

RAW = frozenset("script style textarea title noscript template iframe svg math object video audio canvas xmp noembed noframes".split())
CUT = frozenset("nav header footer aside form dialog menu select button fieldset datalist head".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACE = frozenset("br td th img input wbr".split()) - {"wbr"}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Whole tokens of class, id or role that name furniture.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent contentinfo complementary disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice overlay pagination paywall popup promo promotion recommended related replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: What such a token may be joined with (cookie-bar, related-posts); with any other word it names something else (related-work, has-sidebar).
QUALIFIERS = frozenset(
    "area article articles bar block bottom box btn button buttons container count form global group icon icons inner item items left link links list media module outer page panel post posts primary right row secondary site sticky stories toggle top wrap wrapper".split()
)
KEEP_NAMES = frozenset("html body main article".split())

#: Elements whose text is judged together.
CONTAINERS = frozenset("article center div main section td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("td th caption".split())
ROWS = frozenset("tbody td tfoot th thead tr caption".split())
LISTS = frozenset("dl menu ol table ul".split()) | CELLS
P, P_STOP = frozenset(["p"]), CELLS | {"table", "button", "select", "datalist"}
#: What a start tag ends: the nearest open element of the first set, searched no further than the second.
IMPLIED = {
    "li": (frozenset(["li"]), LISTS),
    "dt": (frozenset(["dt", "dd"]), LISTS),
    "dd": (frozenset(["dt", "dd"]), LISTS),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th", "caption"]), frozenset(["table", "tr"])),
    "tbody": (frozenset("tbody tfoot thead caption".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody tfoot thead caption".split()), frozenset(["table"])),
    "thead": (frozenset("tbody tfoot thead caption".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["optgroup", "option"]), frozenset(["select", "datalist"])),
    "select": (frozenset(["select"]), CELLS),
    "button": (frozenset(["button"]), CELLS),
}
IN_HEAD = frozenset("title meta link base style script noscript template bgsound basefont".split())


class _Tree:
    """The elements of a page that matter, each with its parent, and what is met in order: text, a line's end, an element opened or closed."""

    def __init__(self, page: str) -> None:
        self.names, self.parents, self.cuts, self.closed = ["#page"], [-1], [""], [True]
        self.events: list[tuple[str, str | int]] = []
        self.page, self.at = page, 0
        self.marks: list[tuple[int, int, str]] | None = None
        self.stack = [0]
        self.open: dict[str, int] = {}
        self._read(page)
        self.events.append(("line", 0))
        while len(self.stack) > 1:
            self._pop(False)

    def _push(self, name: str, cut: str) -> None:
        k = len(self.names)
        self.names.append(name)
        self.parents.append(self.stack[-1])
        self.cuts.append(cut)
        self.closed.append(False)
        self.stack.append(k)
        self.open[name] = self.open.get(name, 0) + 1
        self.events.append(("open", k))

    def _pop(self, closed: bool) -> None:
        k = self.stack.pop()
        self.closed[k] = closed
        self.open[self.names[k]] -= 1
        self.events.append(("close", k))

    def _end(self, names: frozenset[str], stop: frozenset[str], own: bool = False) -> None:
        """Ends the nearest open element of ``names`` with all inside it, unless one of ``stop`` is nearer. ``own``: by its own end tag."""
        if not any(self.open.get(x) for x in names):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.names[self.stack[i]]
            if name in names:
                while len(self.stack) > i:
                    self._pop(own and len(self.stack) == i + 1)
                return
            if name in stop or own and name in ("article", "main") and not names & {"article", "main"} and self._stray(name):
                return

    def _start(self, name: str, attrs: str) -> None:
        if self.open.get("head") and name not in IN_HEAD:
            self._end(frozenset(["head"]), frozenset())
        if name in BLOCK:
            self.events.append(("line", 0))
        elif name in SPACE:
            self.events.append(("text", " "))
        if name in BLOCK and name not in IMPLIED or name in ("li", "dt", "dd"):
            self._end(P, P_STOP)
        if name in HEADINGS and self.names[self.stack[-1]] in HEADINGS:
            self._pop(False)
        if name in IMPLIED:
            self._end(*IMPLIED[name])
        if name in VOID or name in ("html", "body", "form", "head") and self.open.get(name) or name == "head" and len(self.stack) > 2 or name in ROWS and not self.open.get("table"):
            return
        inside = self.open.get("article") or self.open.get("main")
        cut = ""
        if name == "article" and self.open.get("article"):
            cut = "nested"
        elif name in CUT and not (name == "header" and inside):
            cut = "tag"
        elif attrs and name not in KEEP_NAMES - {"article"}:
            cut = _attributes(name, attrs)
        if cut or name in BLOCK or name in CELLS or name in KEEP_NAMES or self.open.get(name):  # of inline elements only those that are cut, and their like inside them
            self._push(name, cut)

    def _close(self, name: str) -> None:
        if name in BLOCK:
            self.events.append(("line", 0))
        if name in HEADINGS:
            self._end(HEADINGS, CELLS | {"table"}, True)
        elif name in ("body", "html"):
            self.events.append(("line", 0))
            while self.names[self.stack[-1]] not in ("#page", "html", "body"):
                self._pop(False)
        elif name in ("article", "main", "table"):
            self._end(frozenset([name]), frozenset(), True)
        elif name in ROWS:
            self._end(frozenset([name]), frozenset(["table"]), True)
        elif name in BLOCK or name in CUT:
            self._end(frozenset([name]), LISTS - {name} if name in ("li", "dt", "dd") else CELLS | {"table"} - {name}, True)
        else:
            self._end(frozenset([name]), BLOCK | CELLS, True)

    def _read(self, page: str) -> None:
        """One pass; every character is looked at a bounded number of times, whatever is left open."""
        at, n, last = 0, len(page), page.rfind(">")
        ends = {q: page.rfind(q) for q in "\"'"}
        quoted = True  # until quotes of some tag turn out to swallow the rest of the page
        while at < n:
            if page[at] != "<":
                end = page.find("<", at)
                end = n if end < 0 else end
                self._text(page[at:end])
                at = self.at = end
                continue
            if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
                close = "-->" if page[at + 2] == "-" else "]]>"
                end = page.find(close, at + 4 if close == "-->" else at + 9)
                at = self.at = n if end < 0 else end + 3
                continue
            m = _NAME.match(page, at)
            if at > last or m is None and page[at + 1 : at + 2] not in ("!", "?"):
                self._text("<")
                at = self.at = at + 1
                continue
            if m is None:  # a declaration
                at = self.at = page.find(">", at) + 1
                continue
            end = m.end()
            while quoted:
                stop = _STOP.search(page, end)
                if stop is None or stop[0] != ">" and ends[stop[0]] <= stop.start():
                    quoted = stop is not None and stop[0] != ">"  # this quote has no partner; others may
                    end = page.find(">", m.end())
                    break
                if stop[0] == ">":
                    end = stop.start()
                    break
                end = page.find(stop[0], stop.end()) + 1
            else:
                end = page.find(">", m.end())
            at = self.at = end + 1
            name, attrs, close = m[1].lower(), page[m.end() : end], page[m.start() + 1] == "/"
            if name in RAW and not close and not attrs.rstrip().endswith("/"):
                after = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = n if after is None else after.start()
            elif close:
                self._close(name)
            elif name not in RAW:
                self._start(name, attrs)

    def _text(self, s: str) -> None:
        if self.open.get("head") and not s.isspace():
            self._end(frozenset(["head"]), frozenset())
        self.events.append(("text", s))

    def _stray(self, name: str) -> bool:
        """Whether the open article or main ``name`` still has its own end tag ahead, so that an end tag from outside it is a stray one."""
        if self.marks is None:
            self.marks = [(m.start(), -1 if m[1] else 1, m[2].lower()) for m in re.finditer(r"<(/?)(article|main)(?=[\s/>])", self.page, re.I)]
        depth = 1
        for _, step, _ in (x for x in self.marks[bisect_left(self.marks, (self.at,)) :] if x[2] == name):
            depth += step
            if depth == 0:
                return True
        return False

    def _sizes(self) -> tuple[list[int], list[int]]:
        """Length of the text in each element, without what is surely furniture inside it; and without all articles inside it."""
        n = len(self.names)
        size, alone = [0] * n, [0] * n
        here = 0
        for what, x in self.events:
            if what == "text":
                size[here] += len(x.strip())
            elif what == "open":
                here = x
            elif what == "close":
                here = self.parents[x]
        alone = size.copy()
        for k in range(n - 1, 0, -1):
            if self.cuts[k] not in ("hidden", "nested") and not (self.cuts[k] == "tag" and self.closed[k] and self.names[k] != "form"):
                size[self.parents[k]] += size[k]
                if self.names[k] != "article":
                    alone[self.parents[k]] += alone[k]
        return size, alone

    def kept(self) -> tuple[list[bool], set[int]]:
        """Whether each element stays, apart from what is around it, and the articles that end the cut elements around them."""
        n = len(self.names)
        kept = [not c for c in self.cuts]
        size, alone = self._sizes()
        holds = [x in ("article", "main") for x in self.names]  # an article or main, or one inside
        for k in range(n - 1, 0, -1):
            holds[self.parents[k]] |= holds[k] and self.cuts[k] not in ("hidden", "nested")
        cut_by, article, scope = [0] * n, [0] * n, [0] * n  # the nearest cut element and article, itself included; the nearest article or main around it
        for k in range(1, n):
            up = self.parents[k]
            scope[k] = up if self.names[up] in ("article", "main") else scope[up]
            if self.cuts[k] == "nested":  # an article that is not closed, or only holds articles, does not make the next one a comment
                kept[k] = not article[up] or not self.closed[article[up]] or not alone[article[up]]
            elif self.cuts[k] == "named" and self.names[k] in BLOCK | CELLS or self.names[k] == "form" and self.cuts[k] == "tag" or self.cuts[k] == "tag" and not self.closed[k] and self.names[k] not in ("footer", "head"):
                kept[k] = 2 * size[k] > size[scope[k]] and (scope[k] > 0 and (self.closed[k] or not holds[k]) or self.closed[k] and holds[k] or not holds[0])  # never what holds most of the text, unless an article ends it
            cut_by[k], article[k] = cut_by[up] if kept[k] else k, k if self.names[k] == "article" else article[up]
        marked = [k for k, x in enumerate(self.names) if x in ("article", "main")]
        only = all(cut_by[k] for k in marked)
        lifted = set()
        for k in marked:
            c = cut_by[k]
            if c and c != k and self.names[c] != "aside" and (not self.closed[c] and self.cuts[c] in ("tag", "named") or only and (self.cuts[c] == "named" or self.names[c] in ("form", "header"))):
                lifted.add(k)
        return kept, lifted


class _Line(NamedTuple):
    text: str
    #: 0 outside, 1 inside an article, 2 inside main.
    inside: int = 0
    #: The nearest container, and the element that a stretch of such lines lies in: the same, or the one around a container that is a mere paragraph.
    container: int = 0
    parent: int = 0


_GAP = [_Line("")] * WINDOW


def _lines(tree: _Tree) -> tuple[list[_Line], list[int]]:
    """The lines, and the container around each container; cut-out parts and the edges of articles are runs of empty lines."""
    kept, lifted = tree.kept()
    n = len(kept)
    container, around, leaf = [0] * n, [0] * n, [True] * n
    for k in range(1, n):
        up = tree.parents[k]
        container[k], around[k] = k if tree.names[k] in CONTAINERS else container[up], container[up]
        if kept[k] and tree.names[k] in BLOCK | CELLS:
            leaf[up] = False
    lines: list[_Line] = []
    text: list[str] = []
    inside: set[int] = set()
    mains = 0
    here, skip = 0, 0  # the innermost element, and the one that is being cut out

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                c = container[here]
                lines.append(_Line(line, 2 if mains else int(bool(inside)), c, around[c] if leaf[c] else c))

    for what, x in tree.events:
        if what == "close" and x == skip:
            here, skip = tree.parents[x], 0
        elif skip and x not in lifted:
            continue
        elif what == "text":
            text.append(x)
        elif what == "line":
            flush()
        elif what == "close":
            if x in inside:
                flush()
                inside.discard(x)
                mains -= tree.names[x] == "main"
                lines.extend(_GAP)
            here = tree.parents[x]
        elif not kept[x]:
            flush()
            lines.extend(_GAP)
            skip = x
        else:
            if tree.names[x] in ("article", "main"):
                skip = 0
                flush()
                lines.extend(_GAP)
                inside.add(x)
                mains += tree.names[x] == "main"
            here = x
    flush()
    return lines, around


def _furniture(token: str) -> bool:
    words = set(_WORDS.findall(token))
    return token in NAMES or not words.isdisjoint(NAMES) and words <= NAMES | QUALIFIERS


def _attributes(name: str, attrs: str) -> str:
    """Why the attributes of an element have it cut: hidden, named or not at all. Ids of headings and inline elements are anchors."""
    anchor = name in HEADINGS or name not in BLOCK | CELLS | CUT
    named = False
    for key, value in _ATTRIBUTE.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if name != "article" and (key == "hidden" or key == "aria-hidden" and value == "true"):
            return "hidden"
        if key in ("class", "role") or key == "id" and not anchor:
            named = named or any(map(_furniture, value.split()))
    return "named" if named else ""


def _runs(lines: list[_Line]) -> list[tuple[list[_Line], int]]:
    """(lines, peak) from each surge to its dive."""
    sizes = [len(x.text) for x in lines]
    n = len(sizes)
    runs: list[tuple[list[_Line], int]] = []
    surge, peak, window = -1, 0, 0
    for i in range(n + WINDOW):  # the sum over lines i - WINDOW + 1 ... i
        window += sizes[i] if i < n else 0
        window -= sizes[i - WINDOW] if i >= WINDOW and i - WINDOW < n else 0
        if window and surge < 0:
            surge, peak = i, 0
        peak = max(peak, window)
        if not window and surge >= 0:
            runs.append(([x for x in lines[surge:i] if x.text], peak))
            surge = -1
    if surge >= 0:
        runs.append(([x for x in lines[surge:] if x.text], peak))
    return runs


def _total(lines: Iterable[_Line], by: str) -> dict[int, int]:
    total: dict[int, int] = {}
    for x in lines:
        total[getattr(x, by)] = total.get(getattr(x, by), 0) + len(x.text)
    return total


def _above(k: int, around: list[int]) -> Iterator[int]:
    while k:
        k = around[k]
        yield k


def _by_container(runs: list[tuple[list[_Line], int]], around: list[int]) -> list[list[_Line]]:
    """The runs of high peak, and with each the rest of its container: what the same element holds, what lies deeper in it, and what stands
    bare in an element around the highest run."""
    top = max(p for _, p in runs)
    high = [(max((t := _total(run, "parent")), key=t.get), p) for run, p in runs if p >= FURNITURE * top]
    homes = {h for h, _ in high}
    outer = set(_above(next(h for h, p in high if p == top), around))
    within = [False] * len(around)  # of a home, apart from the page itself
    for k in range(1, len(around)):
        within[k] = k in homes or within[around[k]]
    chosen = []
    for run, p in runs:
        same = any(x.parent in homes or within[x.container] for x in run)
        bare = all(x.container == x.parent and x.container == run[0].container for x in run) and run[0].container in outer
        if p >= FURNITURE * top or same or bare:
            chosen.append(run)
    return chosen


def main_text(page: str | None) -> str:
    lines, around = _lines(_Tree(page or ""))
    runs = _runs(lines)
    marked = [(run, p) for run, p in runs if run[0].inside]
    others = [(run, p) for run, p in runs if not run[0].inside]
    peak = max((p for _, p in others), default=0)
    size = max(_total((x for run, _ in others for x in run), "parent").values(), default=0)
    if marked and (
        any(run[0].inside == 2 for run, _ in marked) or max(p for _, p in marked) >= FURNITURE * peak and sum(len(x.text) for run, _ in marked for x in run) >= FURNITURE * size
    ):
        chosen = [run for run, _ in marked]
    else:  # no article, or a card beside the text
        chosen = _by_container(runs, around) if runs else []
    return "\n\n".join(x.text for run in chosen for x in run)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(x.as_py()) for x in b.column(2)], pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string")
