r"""Secret scans with a recursive decoding worklist.

Base kinds, found leftmost and without overlap in the whole text:
  assign   (password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+), group 2 of 6+ characters
  access   AKIA[A-Z0-9]+ of 20+ characters
  hex      [0-9a-f]+ of 24+ characters

Method: a worklist starts with the text. Each layer is scanned; then its URL escapes, Unicode and character
escapes, base64 runs and compressed runs (gzip, zlib) are unwrapped into new layers, which join the worklist,
until nothing new comes (a digest of each layer ends cycles). Escapes that stand in each other (%252541) are taken
off to the last at once; a layer of replaced escapes holds the lines that changed, and base64 that no replaced
character touches isn't decoded again. A layer knows how its places follow from those of the text or run that it stands in
(by escapes, by base64 digits, or one span for all of a compressed run), so that a find in any layer names its place in
the original text, whatever its depth, and memory is that of texts and escapes. Such a find is added as kind/layer,
e.g. assign/base64; finds that no unwrapped code point belongs to are not repeated. Base64 lines of one width (LINE
characters or more) that follow each other are unwrapped together, too.

Defined cases: null text counts as empty (no finds); an empty table gives no rows; repeated rows are scanned
each; ids are passed through, null ones too; other columns are not read. Layers of equal kind that follow each other
more than three times are named once with their number, e.g. assign/url*7. A base64 run that isn't compressed is a layer if
at most GARBAGE of it are control characters or no UTF-8. Compressed runs (in base64 or URL escapes) are inflated as
streams to their end, all members of them, and again while the content is compressed, wherever in them a find
stands. The content is scanned in windows of text, cut at line ends behind lines that don't end in a base64 run; a line of
MOST_WINDOW characters, or as many of such lines, is cut where no run stands, OVERLAP characters in both windows, and a base64 run
that fills a whole window is decoded as a stream, so that no run is lost or cut. A compressed stream in URL escapes inside inflated content
is opened if it fits a window. Bytes that are not UTF-8 stand as U+FFFD. A damaged stream counts up to the damage.
Raw deflate, bz2, xz and UTF-16 are not opened.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.llm.common import load, ship

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: One of these stands in every assign find, in lower case.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Bytes that a stream gives at once; bytes that tell whether it is one.
CHUNK = 1 << 20
HEAD = 1 << 16
#: Code points of inflated text that are scanned at once.
WINDOW = 1 << 20
MOST_WINDOW = 3 << 20
OVERLAP = 1 << 16
#: More letters than an assign find's first word has.
KEYWORD = 16

URL_ESCAPE = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
URL_UNIT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
#: The head of a gzip or zlib stream, and what may follow in URL escapes.
URL_STREAM = re.compile(r"(?:%1[fF]%8[bB]|(?:x|%78)(?:%01|\^|%5[eE]|%9[cC]|%[dD][aA]))(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()/+@:,;$^-])*")
CHAR_ESCAPE = re.compile(
    r"\\((?:u\{0*5[cC]\}|u005[cC]|U0000005[cC]|x5[cC])*)(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))"
    r"|&((?:#x0*26;|#0*38;)*)(?:#x([0-9A-Fa-f]{1,6});|#([0-9]{1,7});)"
)
#: A character that no base64 run goes over, wrapped lines included.
BREAK = re.compile(r"[^A-Za-z0-9+/_\r\n \t-]|(?<![\r\n \t])[ \t]")
BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Width of wrapped base64 lines at least; what may stand between two of them; a last line.
LINE = 20
LINE_END = re.compile(r"\r?\n[ \t]*")
LAST_LINE = re.compile(r"\r?\n[ \t]*[A-Za-z0-9+/_-]+={0,2}(?![A-Za-z0-9+/_=-])")
#: The end of a line that may go on in the next one.
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{%d}={0,2}\r?\n\Z" % LINE)
#: Share of a decoded base64 run that may be no text.
GARBAGE = 0.3
NO_TEXT = re.compile("[\x00-\x08\x0e-\x1f\x7f\ud800-\udfff]")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base finds."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def readable(data: bytes) -> str | None:
    """Text, bytes that aren't UTF-8 as lone surrogates; None if too much of it is no text."""
    text = data.decode("utf-8", "surrogateescape")
    return text if text and (text.isprintable() or len(NO_TEXT.findall(text)) <= GARBAGE * len(text)) else None


def compressed(head: bytes) -> bool:
    """Whether bytes are a gzip or zlib stream, or the head of one."""
    if not (head[:2] == b"\x1f\x8b" or len(head) > 6 and head[0] == 0x78 and (head[0] << 8 | head[1]) % 31 == 0):
        return False
    stream = zlib.decompressobj(wbits=47)
    try:
        out = stream.decompress(head, HEAD)
    except zlib.error:
        out = next(until_damage(zlib.decompressobj(wbits=47), head), b"")
    if stream.eof or not out:
        return stream.eof
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)  # a text may start with "x^"
    except UnicodeDecodeError:
        return True
    return False


def until_damage(stream, data: bytes) -> Iterator[bytes]:
    """What a damaged stream gives before the damage."""
    for k in range(len(data)):
        try:
            out = stream.decompress(data[k : k + 1])
        except zlib.error:
            return
        if out:
            yield out


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The content of a stream's members in chunks; bytes behind the members as they are."""
    chunks = iter(chunks)
    stream, given = zlib.decompressobj(wbits=47), False
    for data in chunks:
        while data:
            if stream.eof:
                data = data.lstrip(b"\0")
                stream, given = zlib.decompressobj(wbits=47), False
                if not data:
                    break
            before = stream.copy()
            try:
                out = stream.decompress(data, CHUNK)
            except zlib.error:
                for out in until_damage(before, data):
                    given = True
                    yield out
                if not given:
                    yield data
                    yield from chunks
                return
            if out:
                given = True
                yield out
            data = stream.unused_data if stream.eof else stream.unconsumed_tail
    try:
        if rest := stream.flush():
            yield rest
    except zlib.error:
        return


def opened(chunks: Iterable[bytes]) -> tuple[int, Iterable[bytes]]:
    """How many times what comes in chunks is compressed, and its innermost content in chunks."""
    depth, chunks, seen = 0, iter(chunks), set()
    while True:
        head, size, ended = [], 0, True
        for chunk in chunks:
            head.append(chunk)
            size += len(chunk)
            if size > CHUNK:
                ended = False
                break
        first = b"".join(head)
        if ended:
            key = hashlib.sha256(first).digest()
            if key in seen:  # a stream that holds itself
                return depth, []
            seen.add(key)
        if not compressed(first[:HEAD]):
            return depth, [first] if ended else chain([first], chunks)
        depth += 1
        chunks = inflate([first] if ended else chain([first], chunks))


def last_break(text: str) -> int:
    """Place of the last character that no run goes over; -1 if there is none."""
    end = len(text)
    while end > 0:
        begin = max(0, end - 4096)
        if found := [m.start() for m in BREAK.finditer(text, begin, end)]:
            return found[-1]
        end = begin
    return -1


class Run:
    """A base64 run that fills a window: iterating gives its content as it comes. Then kinds has those of finds in its own
    characters, and rest the text behind it."""

    def __init__(self, text: str, more: Iterator[str]) -> None:
        self.rest, self.more, self.kinds, self.stream = text, more, set(), None

    def __iter__(self) -> Iterator[bytes]:
        if self.stream is None:
            self.stream = self._decoded()
        return self.stream

    def _decoded(self) -> Iterator[bytes]:
        text, digits, tail = self.rest, "", ""
        self.rest = ""
        while text is not None:
            end = BREAK.search(text)
            part = text[: end.start()] if end else text
            tail = tail[-OVERLAP:] + part
            self.kinds.update(k for _, _, k in scan(tail))
            digits += "".join(part.split())
            whole = len(digits) - len(digits) % 4
            if whole:
                yield _unbase64(digits[:whole]) or b""
                digits = digits[whole:]
            if end:
                self.rest = tail[-KEYWORD:] + text[end.start() :]  # a find may begin with the run's last word
                break
            text = next(self.more, None)
        if digits:
            yield _unbase64(digits) or b""


def windows(chunks: Iterable[bytes]) -> Iterator[str | Run]:
    """Text of UTF-8 chunks, cut where no find, run or escape is lost; a run that fills a window comes as a Run."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    texts = chain(map(decoder.decode, chunks), (decoder.decode(b"", True) for _ in range(1)))
    held, tried = "", 0
    for text in texts:
        held += text
        if len(held) < WINDOW:
            continue
        cut = held.rfind("\n", tried) + 1
        while cut and WRAPPED.search(held, max(0, cut - LINE - 5), cut):
            cut = held.rfind("\n", tried, cut - 1) + 1
        if cut:
            yield held[:cut]
            held, tried = held[cut:], 0
            continue
        tried = max(0, held.rfind("\n"))
        if len(held) < MOST_WINDOW:
            continue
        tried, last = 0, last_break(held)
        if last > MOST_WINDOW // 2:
            yield held[:last]
            held = held[BREAK.search(held, last - OVERLAP).start() :]
            continue
        if last >= 0:  # finds that begin before the run
            yield held[: last + 1 + OVERLAP]
        run = Run(held[last + 1 :], texts)
        yield run
        for _ in run:
            pass
        held = run.rest
    if held:
        yield held


class Layer:
    """A text on the worklist; span() gives places of the original text, made() whether any of its code points was unwrapped. This one is the original."""

    parent: Layer | None = None
    names: tuple[tuple[str, int], ...] = ()

    def __init__(self, text: str) -> None:
        self.text = text

    @property
    def name(self) -> str:
        return named(self.names)

    def key(self) -> bytes:
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest() + repr(self.span(0, len(self.text))).encode()

    def span(self, a: int, b: int) -> tuple[int, int]:
        layer = self
        while layer.parent is not None:
            a, b = layer.above(a, b)
            layer = layer.parent
        return a, b

    def made(self, a: int, b: int) -> bool:
        return self.parent is not None

    def name_of(self, a: int, b: int) -> str:
        """Names of the layers that a find came through."""
        return self.name

    def touched(self, a: int, b: int) -> bool:
        """Whether this layer could show a run at a to b that the one before it couldn't."""
        return True

    def above(self, a: int, b: int) -> tuple[int, int]:
        """The span of the parent's text that a span of this one came from."""
        return a, b


def named(names: tuple[tuple[str, int], ...]) -> str:
    return "".join(f"/{n}" * k if k <= 3 else f"/{n}*{k}" for n, k in names)


def under(layer: Layer, name: str, times: int = 1) -> tuple[tuple[str, int], ...]:
    """Names of the layers of one that stands `times` deep in layer."""
    if not times:
        return layer.names
    if layer.names and layer.names[-1][0] == name:
        return *layer.names[:-1], (name, layer.names[-1][1] + times)
    return *layer.names, (name, times)


class Piece(Layer):
    """Content of a run whose code points all stand for the whole run; kinds: of finds known already."""

    def __init__(self, text: str, parent: Layer, run: tuple[int, int], names: tuple, kinds: Iterable[int] = ()) -> None:
        self.text, self.parent, self.run, self.names, self.kinds = text, parent, run, names, tuple(kinds)

    def above(self, a: int, b: int) -> tuple[int, int]:
        return self.run


class Decoded(Layer):
    """A base64 run: byte i of the content stands in its digits 4i/3 and on. breaks: for each line end in the run the digits before it and its width."""

    def __init__(self, text: str, parent: Layer, start: int, digits: int, breaks: list[tuple[int, int]]) -> None:
        self.text, self.parent, self.names = text, parent, under(parent, "base64")
        self.start, self.digits = start, digits
        self.before = np.array([n for n, _ in breaks], np.int64)
        self.widths = np.cumsum([0, *(w for _, w in breaks)])
        self.bytes_before: np.ndarray | None = None

    def place(self, digit: int) -> int:
        return int(self.start + digit + self.widths[np.searchsorted(self.before, digit, "right")])

    def byte(self, at: int) -> int:
        """Bytes before a code point."""
        if self.text.isascii():
            return at
        if self.bytes_before is None:
            code = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
            size = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
            size[(code >= 0xD800) & (code < 0xE000)] = 1  # a byte that is no UTF-8
            self.bytes_before = np.r_[0, np.cumsum(size)]
        return int(self.bytes_before[at])

    def above(self, a: int, b: int) -> tuple[int, int]:
        first, last = self.byte(a), self.byte(b) - 1
        return self.place(first * 4 // 3), self.place(min(self.digits - 1, last * 4 // 3 + 1)) + 1


class Escaped(Layer):
    """Lines of another layer with each escape replaced. The parent is what that layer, if it is one of these, stands in, so that depth
    costs nothing. at: places of what was replaced; start, end: their spans in the parent; base: the parent's place of the first
    character, if that one wasn't replaced; depth: how many escapes stood in each other there, 0 for those of layers before."""

    def __init__(self, text: str, parent: Layer, at: np.ndarray, start: np.ndarray, end: np.ndarray, depth: np.ndarray, base: int, names: tuple) -> None:
        self.text, self.parent, self.at, self.start, self.end, self.depth, self.base, self.names = text, parent, at, start, end, depth, base, names

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans in the parent of single characters."""
        k = np.searchsorted(self.at, x, "right") - 1
        if not len(self.at):
            return x + self.base, x + self.base + 1
        known = np.maximum(k, 0)
        exact = (k >= 0) & (self.at[known] == x)
        plain = np.where(k < 0, x + self.base, x - self.at[known] - 1 + self.end[known])
        return np.where(exact, self.start[known], plain), np.where(exact, self.end[known], plain + 1)

    def above(self, a: int, b: int) -> tuple[int, int]:
        start, end = self.places(np.array([a, max(a, b - 1)]))
        return int(start[0]), int(end[1])

    def replaced(self, a: int, b: int) -> bool:
        k = int(np.searchsorted(self.at, a))
        return k < len(self.at) and bool(self.at[k] < b)

    def made(self, a: int, b: int) -> bool:
        return self.parent.parent is not None or self.replaced(a, b)

    def name_of(self, a: int, b: int) -> str:
        i, j = np.searchsorted(self.at, (a, b))
        more = int(self.depth[i:j].max(initial=1)) - 1
        return named(under(self, self.names[-1][0], more)) if more > 0 else self.name

    def touched(self, a: int, b: int) -> bool:
        return self.replaced(a - 1, b + 1)


def _escaped(layer: Layer, pattern: re.Pattern, decode, name: str) -> Iterator[Layer]:
    """The lines of a layer in which escapes stand, each escape replaced by what it stands for."""
    parts, fresh, done, size = [], [], 0, 0
    for m in pattern.finditer(layer.text):
        for c, x, y, levels in decode(m) or ():
            parts.append(layer.text[done : m.start() + x])
            parts.append(c)
            size += len(parts[-2])
            fresh.append((size, m.start() + x, m.start() + y, levels))
            size += 1
            done = m.start() + y
    if not parts:
        return
    parts.append(layer.text[done:])
    text = "".join(parts)
    at, first, last, depth = np.array(fresh, np.int64).T
    new = at
    if isinstance(layer, Escaped):
        start, end = layer.places(first)[0], layer.places(last - 1)[1]
        k = np.searchsorted(first, layer.at, "right") - 1  # characters replaced before that still stand
        known = np.maximum(k, 0)
        kept = (k < 0) | (layer.at >= last[known])
        moved = np.where(k < 0, layer.at, layer.at - last[known] + at[known] + 1)
        order = np.argsort(at := np.r_[at, moved[kept]], kind="stable")
        at, start, end = at[order], np.r_[start, layer.start[kept]][order], np.r_[end, layer.end[kept]][order]
        whole = Escaped(text, layer.parent, at, start, end, np.r_[depth, np.zeros(kept.sum(), np.int64)][order], layer.base, ())
    else:
        whole = Escaped(text, layer, at, first, last, depth, 0, ())
    names, stop = under(layer, name), 0
    for x in new.tolist():
        if x < stop:
            continue
        begin = text.rfind("\n", 0, x) + 1
        while begin and WRAPPED.search(text, max(0, begin - LINE - 5), begin):  # base64 may go over line ends
            begin = text.rfind("\n", 0, begin - 1) + 1
        begin, stop = max(begin, stop), text.find("\n", x) + 1 or len(text)
        while stop < len(text) and WRAPPED.search(text, max(0, stop - LINE - 5), stop):
            stop = text.find("\n", stop) + 1 or len(text)
        a, b = np.searchsorted(whole.at, (begin, stop))
        base = int(whole.places(np.array([begin]))[0][0])
        yield Escaped(text[begin:stop], whole.parent, whole.at[a:b] - begin, whole.start[a:b], whole.end[a:b], whole.depth[a:b], base, names)


def _percent(m: re.Match) -> list[tuple[str, int, int, int]]:
    """Code points of a run of %XX, each with its place in the run and the escapes that stood in each other there."""
    units = list(URL_UNIT.finditer(m[0]))
    try:
        text = bytes(int(u[1], 16) for u in units).decode("utf-8")
    except UnicodeDecodeError:  # bytes of a stream, perhaps: they stay escaped once
        return [("%", u.start(), u.end() - 2, (len(u[0]) - 3) // 2) for u in units if len(u[0]) > 3]
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        own = units[at : at + n]
        out.append((c, own[0].start(), own[-1].end(), max(len(u[0]) for u in own) // 2))
        at += n
    return out


def _character(m: re.Match) -> list[tuple[str, int, int, int]] | None:
    code = int(m[8]) if m[8] else int(next(x for x in (*m.groups()[1:5], m[7]) if x), 16)
    if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
        return None
    levels = 1 + (m[6].count(";") if m[1] is None else m[1].lower().count("c"))
    return [(chr(code), 0, m.end() - m.start(), levels)]


def _unbase64(run: str) -> bytes | None:
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def _pieces(data: bytes, layer: Layer, run: tuple[int, int]) -> Iterator[Layer] | None:
    """Layers of a compressed run, which is one piece; None if it isn't compressed."""
    depth, chunks = opened([data])
    return _content(chunks, Piece("", layer, run, under(layer, "compressed", depth))) if depth else None


def _content(chunks: Iterable[bytes], whole: Piece) -> Iterator[Layer]:
    """The windows of a stream's content; a run that fills one is a stream of its own."""
    for part in windows(chunks):
        if isinstance(part, str):
            yield Piece(part, whole.parent, whole.run, whole.names)
            continue
        inner = Piece("", whole.parent, whole.run, under(whole, "base64"))
        depth, content = opened(part)
        content = iter(content)
        head = next(content, b"")
        if depth or readable(head[:HEAD]) is not None:
            yield from _content(chain([head], content), Piece("", whole.parent, whole.run, under(inner, "compressed", depth)))
        for _ in part:
            pass
        yield Piece("", whole.parent, whole.run, whole.names, part.kinds)


def base64_runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Spans of the lines of each run: every line by itself, and lines of one width that follow each other together."""
    lines: list[tuple[int, int]] = []

    def wrapped() -> Iterator[list[tuple[int, int]]]:
        if lines and lines[-1][1] - lines[-1][0] == lines[0][1] - lines[0][0] and text[lines[-1][1] - 1] != "=" and (last := LAST_LINE.match(text, lines[-1][1])):
            start = LINE_END.match(text, lines[-1][1]).end()
            if last.end() - start <= lines[0][1] - lines[0][0]:
                lines.append((start, last.end()))
        if len(lines) > 1:
            yield lines

    for m in BASE64_RUN.finditer(text):
        yield [m.span()]
        if lines:
            width, between = lines[0][1] - lines[0][0], LINE_END.match(text, lines[-1][1])
            if between and between.end() == m.start() and m.end() - m.start() <= width and lines[-1][1] - lines[-1][0] == width and text[lines[-1][1] - 1] != "=":
                lines.append(m.span())
                continue
        yield from wrapped()
        lines = [m.span()] if m.end() - m.start() >= LINE else []
    yield from wrapped()


def unwrap(layer: Layer) -> Iterator[Layer | Iterator[Layer]]:
    """The layers directly under a layer; those of a compressed run come as an iterator."""
    text = layer.text
    if "%" in text:
        yield from _escaped(layer, URL_ESCAPE, _percent, "url")
    if "\\" in text or "&#" in text:
        yield from _escaped(layer, CHAR_ESCAPE, _character, "unicode")
    if "%" in text:
        for m in URL_STREAM.finditer(text):
            if not layer.touched(*m.span()):
                continue
            for run in dict.fromkeys((m[0].replace("+", " "), m[0])):
                if pieces := _pieces(unquote_to_bytes(run), layer, m.span()):
                    yield pieces
    for lines in base64_runs(text):
        if not layer.touched(lines[0][0], lines[-1][1]):
            continue
        data = _unbase64("".join(text[a:b] for a, b in lines))
        if data is None:
            continue
        if pieces := _pieces(data, layer, (lines[0][0], lines[-1][1])):
            yield pieces
        elif inner := readable(data):
            breaks, digits = [], 0
            for (a, b), (c, _) in zip(lines, [*lines[1:], (lines[-1][1], 0)], strict=True):
                digits += b - a
                breaks.append((digits, c - b))
            yield Decoded(inner, layer, lines[0][0], digits, breaks)


def finds(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
    """Base finds; finds of the unwrapped layers as (start, end, kind/layer)."""
    base = scan(text)
    first = Layer(text)
    work, seen, more = [first], {first.key()}, set()

    def take(new: Layer) -> None:
        if isinstance(new, Piece) and new.kinds:
            more.update((*new.span(0, 0), KINDS[k] + new.name) for k in new.kinds)
        if (key := new.key()) not in seen:
            seen.add(key)
            more.update((*new.span(a, b), KINDS[k] + new.name_of(a, b)) for a, b, k in scan(new.text) if new.made(a, b))
            work.append(new)

    while work:
        if not isinstance(work[-1], Layer):  # one window at a time
            if new := next(work[-1], None):
                take(new)
            else:
                work.pop()
            continue
        for new in unwrap(work.pop()):
            take(new) if isinstance(new, Layer) else work.append(new)
    return base, sorted(more, key=lambda x: (x[0], KINDS.index(x[2].split("/")[0]), x[1], x[2]))


SCHEMA = "doc_id long, base array<struct<start:int,end:int,kind:string>>, more array<struct<start:int,end:int,kind:string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def _scan_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, more = [], []
        for text in batch.column(1).to_pylist():
            b, m = finds(text or "")
            base.append([{"start": x, "end": y, "kind": KINDS[k]} for x, y, k in b])
            more.append([{"start": x, "end": y, "kind": k} for x, y, k in m])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _SPANS), pa.array(more, _SPANS)], names=["doc_id", "base", "more"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and more (spans with start, end and kind; code points, end exclusive), a row per document."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scan_batches, SCHEMA)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same columns; every span found in text_col, base or unwrapped, is replaced by mask. A null text stays null."""
    ship(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                if text:
                    base, more = finds(text)
                    spans, merged = sorted((a, b) for a, b, _ in [*base, *more]), []
                    for a, b in spans:
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    for a, b in reversed(merged):
                        text = text[:a] + mask + text[b:]
                out.append(text)
            columns = [*batch.columns]
            columns[at] = pa.array(out, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, by start, then kind) of every document."""
    found = scan_secrets(docs, id_col, text_col)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rank = lambda s: F.when(s["kind"].startswith("assign"), 0).when(s["kind"].startswith("access"), 1).otherwise(2)
    ordered = F.transform(F.array_sort(F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), F.length(s["kind"]).alias("depth"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(ordered).alias("spans"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(load(spark, sf_dir, "documents"))
