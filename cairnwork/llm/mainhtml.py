"""Main text of web pages by tag-path ratios.

Method: each text node belongs to the path of block tags from the root to it. Per path, text length and punctuation
are summed and divided by its number of nodes, and fused (length ratio times the logarithm of the punctuation ratio, times
the root of the number of nodes); the same is done for all that lies below a path. A path's ratio is smoothed with those of the
paths before and after it in order of appearance and with the best one of its ancestors (DECAY a level). Names (class, id, role) are weak evidence: a path's smoothed
ratio is multiplied by a factor for each of its elements, (1 - share)^2 and NAMED at least, where share is the greatest share of a
name's parts that are fixed words of page furniture: "comments" has 1, "notice-of-death" a third. Paragraphs, headings and quotes have no
factor, but for words of adverts.

Nodes are chosen by their path's ratio: anywhere those of THRESHOLD of the page's best or more; those of INSIDE or more
(headings, list items, short lines) inside the deepest element that holds all of the first ones, or the article or main element around
that; where only the body holds all, inside its elements that hold some, and headings. Elements that hold no article by their tag
(navigation, footers, forms, scripts and so on, a header outside of an article) or as hidden have no paths. An inline element named
entirely as furniture is a path of its own below its block's.

Paths and elements are numbers with parent links: the time is linear in the page, however deep it nests.

Character references are decoded, white space inside a block becomes one space, blocks are joined by line ends.

Defined cases: null or empty html gives an empty text; unclosed and misnested tags close at the next block that can't
stand inside them; a quote that isn't closed is an ordinary character; a page without any content path gives an empty text; repeated pages
give a row each; an empty table gives no rows; a column of the output's name is replaced, all others stay as they are; nothing is cut.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.llm.common import load, ship

THRESHOLD = 0.25
INSIDE = 0.005
#: Shares of a neighbouring path's and of the ancestors' ratio in a smoothed one.
NEIGHBOUR, PARENT, DECAY = 0.1, 0.1, 0.8
#: The factor of an element named entirely as furniture.
NAMED = 0.002
#: Tags that run to the end of the page inside of quotes, after which quotes count no more.
MOST_OPEN = 50

# HTML elements by kind.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video".split())
NO_ARTICLE = frozenset("nav footer aside form menu dialog head button select option label fieldset".split())
PAGE = ("body", "html")
CLOSES_P = BLOCKS - {"body", "html", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}
#: Their names say nothing.
NAMES_IGNORED = ("body", "html", "main", "article")
# Parts of class, id and role names of elements that hold no article.
OTHER_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense banner billboard breadcrumb breadcrumbs comment comments commentary commentlist contentinfo cookie cookies consent copyright disqus dropdown feedback footer form gdpr hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion recommended register related replies reply respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar topbar widget widgets alert overlay toc".split())

# Those of them that mark adverts.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense promo promoted sponsor sponsored sponsors".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre address dd dt figcaption caption".split())

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: The rest of a tag; a quote opens a value only behind an equals sign.
REST = re.compile(r"""(?:[^>=]|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
PUNCTUATION = re.compile(r"[.,;:!?、。，！？¡¿…]")
SPACES = re.compile(r"\s+")


def _attributes(written: str) -> dict[str, str]:
    """Values by name, the first of each name."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(written):
        out.setdefault(name.lower(), next((v for v in values if v), ""))
    return out


def _furniture(tag: str, attributes: dict[str, str]) -> float:
    """The greatest share of furniture words in one of an element's names; 2 where the element holds no article by its tag or as hidden."""
    if tag in NO_ARTICLE or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return 2
    if not attributes or tag in NAMES_IGNORED:
        return 0
    words = ADVERTS if tag in TEXTUAL else OTHER_NAMES
    share = 0.0
    for key in ("class", "id", "role"):
        for name in attributes.get(key, "").split():
            if found := NAME_PARTS.findall(name):
                share = max(share, sum(p.lower() in words for p in found) / len(found))
    return share if tag not in TEXTUAL or share == 1 else 0


class Page:
    """A page's block elements and paths (numbers with parent links, 0 the root), and its blocks: (path, element, pieces of (text, path))."""

    def __init__(self, page: str) -> None:
        self.up, self.tags = [0], [""]  # of elements
        self.path_up, self.factor = [0], [1.0]
        self.paths: dict[tuple, int] = {}
        self.blocks: list[tuple[int, int, list[tuple[str, int]]]] = []
        self._read(page)

    def _path(self, above: int, label: str, share: float) -> int:
        key = (above, label, share)
        if key not in self.paths:
            self.paths[key] = len(self.factor)
            self.path_up.append(above)
            self.factor.append(self.factor[above] * max(NAMED, (1 - share) ** 2))
        return self.paths[key]

    def _read(self, page: str) -> None:
        stack: list[tuple[str, bool, int, int]] = []  # block elements: tag, out (holds no article), number, path
        opened: Counter = Counter()  # tags in the stack, and "out"
        inline: list[list] = []  # inline elements of another path: tag, path (-1: out), open ones of that tag
        held: list[tuple[str, int]] = []
        at, failed, last, last_data = 0, 0, page.rfind(">"), page.rfind("]]>")
        never: set[str] = set()  # tags of raw text that don't close any more

        def close_block() -> None:
            if held:
                if not opened["out"] and any(t.strip() for t, _ in held):
                    self.blocks.append((stack[-1][3] if stack else 0, stack[-1][2] if stack else 0, held[:]))
                held.clear()

        def cut(k: int) -> None:
            for tag, out, _, _ in stack[k:]:
                opened[tag] -= 1
                opened["out"] -= out
            del stack[k:]

        def text(start: int, end: int) -> None:
            if end > start and not (inline and inline[-1][1] < 0):
                held.append((page[start:end], inline[-1][1] if inline else stack[-1][3] if stack else 0))

        while (lt := page.find("<", at)) >= 0:
            text(at, lt)
            at = lt
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else len(page)
                continue
            if page.startswith("<![CDATA[", lt) and lt < last_data:
                end = page.find("]]>", lt)
                text(lt + 9, end)
                at = end + 3
                continue
            if page[lt + 1 : lt + 2] in ("!", "?") and lt < last:
                at = page.find(">", lt) + 1
                continue
            m = TAG.match(page, lt)
            if not m or lt > last:
                text(lt, lt + 1)
                at = lt + 1
                continue
            rest = REST.match(page, m.end()) if failed < MOST_OPEN else None
            failed += rest is None
            at = rest.end() if rest else page.find(">", m.end()) + 1
            closing, tag, written = m[1], m[2].lower(), page[m.end() : at - 1]
            if tag in RAW:
                if not closing and not written.endswith("/"):
                    end = None if tag in never else _closing(tag).search(page, at)
                    if not end:
                        never.add(tag)
                    at = end.end() if end else len(page) if tag in ("script", "style") else at
                continue
            attributes = _attributes(written) if written and not closing else {}
            if tag not in BLOCKS:
                if tag == "br":
                    held.append(("\n", inline[-1][1] if inline else stack[-1][3] if stack else 0))
                elif inline and tag == inline[-1][0]:
                    inline[-1][2] += -1 if closing else 1
                    if not inline[-1][2]:
                        inline.pop()
                elif not closing and tag not in VOID and not written.endswith("/") and (share := _furniture(tag, attributes)) >= 1 and not (inline and inline[-1][1] < 0):
                    above = inline[-1][1] if inline else stack[-1][3] if stack else 0
                    inline.append([tag, -1 if share > 1 else self._path(above, tag, 1), 1])
                continue
            inline.clear()
            close_block()
            if tag == "hr":
                continue
            if closing:
                if opened[tag]:
                    cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
                continue
            if tag in CLOSES_P and opened["p"]:
                cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"))
            elif (ends := ENDED_BY.get(tag)) and any(opened[t] for t in ends):  # an element of its kind in the same list or table ends
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        cut(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "tr"):
                        break
            share = _furniture(tag, attributes)
            if tag == "header" and not opened["article"] and not opened["main"]:
                share = 2
            first = attributes.get("class", "").split()[:1] if tag not in ("p", "li") else []
            path = self._path(stack[-1][3] if stack else 0, ".".join([tag, *first]), min(share, 1))
            self.up.append(stack[-1][2] if stack else 0)
            self.tags.append(tag)
            stack.append((tag, share > 1, len(self.tags) - 1, path))
            opened[tag] += 1
            opened["out"] += share > 1
        text(at, len(page))
        close_block()


# Open elements that one of the same list or table ends.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
_closings: dict[str, re.Pattern] = {}


def _closing(tag: str) -> re.Pattern:
    if tag not in _closings:
        _closings[tag] = re.compile(rf"</{tag}\s*>", re.IGNORECASE)
    return _closings[tag]


def _fused(length: float, punctuation: float, nodes: int) -> float:
    return length / nodes * math.log(1.1 + punctuation / nodes) * math.sqrt(nodes) if nodes else 0.0


def ratios(own: dict[int, list[int]], up: list[int], factor: list[float]) -> dict[int, float]:
    """Smoothed and weighed ratio of each path. own: length, punctuation and nodes of paths in order of appearance; up: the paths' parents."""
    below = [[0, 0, 0] for _ in up]
    for p, values in own.items():
        below[p] = list(values)
    for p in range(len(up) - 1, 0, -1):  # a parent's number is less than its children's
        for k in range(3):
            below[up[p]][k] += below[p][k]
    above = [0.0] * len(up)
    for p in range(1, len(up)):
        above[p] = max(_fused(*below[up[p]]), DECAY * above[up[p]])
    paths, fused = list(own), [_fused(*own[p]) for p in own]
    out = {}
    for k, p in enumerate(paths):
        around = [fused[j] for j in (k - 1, k + 1) if 0 <= j < len(paths)]
        out[p] = ((1 - NEIGHBOUR * len(around) - PARENT) * fused[k] + NEIGHBOUR * sum(around) + PARENT * above[p]) * factor[p]
    return out


def main_text(page: str) -> str:
    found = Page(page)
    cleaned: list[tuple[int, int, list[tuple[str, int]]]] = []
    own: dict[int, list[int]] = {}
    for path, element, pieces in found.blocks:
        by: dict[int, str] = {}
        for t, p in pieces:
            by[p] = by.get(p, "") + t
        seen = False
        for p, t in by.items():
            if t := SPACES.sub(" ", entities.unescape(t)).strip():
                seen = True
                values = own.setdefault(p, [0, 0, 0])
                values[0] += len(t)
                values[1] += len(PUNCTUATION.findall(t))
                values[2] += 1
        if seen:
            cleaned.append((path, element, pieces))
    if not own:
        return ""
    value = ratios(own, found.path_up, found.factor)
    best = max(value.values())
    content = {p for p, v in value.items() if v >= THRESHOLD * best}
    # the deepest element that holds all of the content, widened to the article or main around it
    count = [0] * len(found.up)
    for _, element, pieces in cleaned:
        if any(p in content and t.strip() for t, p in pieces):
            count[element] += 1
    total = sum(count)
    for e in range(len(count) - 1, 0, -1):
        count[found.up[e]] += count[e]
    holder = max((e for e in range(len(count)) if count[e] == total), default=0)
    if holder and found.tags[holder] in ("p", "li", "td") or re.match(r"h[1-6]$", found.tags[holder]):
        holder = found.up[holder]
    around, e = [], holder
    while e:
        around.append(e)
        e = found.up[e]
    outermost = lambda tag: next((e for e in reversed(around) if found.tags[e] == tag), None)
    holder = outermost("article") or outermost("main") or holder
    inside = [False] * len(found.up)
    whole = holder and found.tags[holder] not in PAGE
    for e in range(1, len(found.up)):
        above = found.up[e]
        if whole:
            inside[e] = e == holder or inside[above]
        else:  # an element of the body that holds some of the content, and what is in it
            inside[e] = found.tags[e] not in PAGE and (inside[above] or (above == 0 or found.tags[above] in PAGE) and count[e] > 0)
    lines = []
    for _, element, pieces in cleaned:
        near = inside[element] or not whole and found.tags[element][:1] == "h" and found.tags[element][1:].isdigit()
        kept = [t for t, p in pieces if p not in value or p in content or near and value[p] >= INSIDE * best]
        if t := SPACES.sub(" ", entities.unescape("".join(kept))).strip():
            lines.append(t)
    return "\n".join(lines)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with the main text in out_col, which replaces a column of that name."""
    ship(pages.sparkSession)

    @F.arrow_udf("string")
    def main(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x) if x else "" for x in column.to_pylist()], pa.string())

    return pages.withColumn(out_col, main(F.col(html_col).cast("string")))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text").withColumn("n_chars", F.length("text").cast("long"))
