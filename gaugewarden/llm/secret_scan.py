"""Secret scans with a worklist of decoded layers.

A text is scanned as it is, then as every layer that can be decoded from it:
percent escapes, Unicode escapes, base64 runs (also wrapped ones, at all four
alignments) and what any of them hold compressed. Bytes that are no UTF-8 are
scanned as Latin-1 and for ASCII in UTF-16. Each layer carries, in stretches of equal steps, the piece of the original text
its characters came from, so matches in a layer are reported as spans of the original. Layers
already seen at the same place are not taken again, which ends cycles.

Escapes within escapes are unwrapped step by step, each step a layer; from step
``STEPS`` on, what is left of all chains is unwrapped at its place in one go, so
the work is linear in the text however deep a chain is.
"""

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

# The kinds in the order in which ties are listed, their patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: The same for texts in lower case, where a search leaps to the first letters.
ASSIGN_LOWER = re.compile(ASSIGN.pattern, re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
KINDS = {"assign": 12, "access": 18, "hex": 16}
#: Runs of [0-9a-f] with the length asked for; short runs need no visit.
LONG_HEX = re.compile("[0-9a-f]{%d,}" % KINDS["hex"])

_PERCENT, _ESCAPE = "%[0-9A-Fa-f]{2}", (
    r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)")
# Written once more before the repetition, so that a search leaps to the signs that start an escape.
PERCENT, ESCAPE = (re.compile(f"{one}(?:{one})*") for one in (_PERCENT, _ESCAPE))
ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")
BASE64 = re.compile("[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
NOT_BASE64 = re.compile("[^A-Za-z0-9+/_-]+")
#: First bytes of gzip, zlib, bzip2, xz and zstandard.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
ZSTANDARD = b"\x28\xb5\x2f\xfd"
WIDE = re.compile(rb"(?:[\x09-\x7e]\x00){12,}|(?:\x00[\x09-\x7e]){12,}")
BEYOND_LATIN = re.compile("[^\x00-\xff]+")
BEYOND_ASCII = re.compile("[^\x00-\x7f]+")
ZEROS = re.compile(b"\0*")
#: What an escape starts with, its longest form, and complete escapes at the end of what was read.
STARTER = re.compile(r"[%\\&]")
LONGEST = 10
ENDING = re.compile(r"(?:%([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
                    r"|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});)\Z")
#: Steps by which escapes are unwrapped layer by layer before the rest goes at once.
STEPS = 4
#: What every such stretch holds; zeros are searched quickly.
MAYBE_WIDE = re.compile(rb"\x00[\x09-\x7e](?:\x00[\x09-\x7e]){10}")
CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f�]")

RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_unread long"


def matches(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end), leftmost and without overlap within a kind."""
    found = []
    if "=" in text or ":" in text:
        # below U+0100 a letter and its lower case are one character each, and none but A-Z becomes one of a-z
        plain = text.isascii() or not BEYOND_LATIN.search(text)
        read = ASSIGN_LOWER.finditer(text.lower()) if plain else ASSIGN.finditer(text)
        found += [(m.start(), "assign", m.end()) for m in read if m.end(2) - m.start(2) >= KINDS["assign"]]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= KINDS["access"]]
    found += [(m.start(), "hex", m.end()) for m in LONG_HEX.finditer(text)]
    return found


class Places:
    """Where the characters of a layer lie in the layer below: stretches in which every character goes on by the same step."""

    def __init__(self):
        self.at, self.low, self.step, self.width = array("q"), array("q"), array("q"), array("q")
        self.size = 0

    def add(self, n: int, low: int, step: int, width: int) -> None:
        """``n`` characters of ``width`` each, the first one at ``low``, one every ``step``."""
        if not n:
            return
        if self.at and step == width == self.width[-1]:
            many = self.size - self.at[-1]
            if low == self.low[-1] + many * width and (many == 1 or self.step[-1] == width):
                self.step[-1] = width
                self.size += n
                return
        self.at.append(self.size)
        self.low.append(low)
        self.step.append(step)
        self.width.append(width)
        self.size += n

    def __call__(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        return (self.low[i] + (start - self.at[i]) * self.step[i],
                self.low[j] + (end - 1 - self.at[j]) * self.step[j] + self.width[j])


@dataclass
class Layer:
    """A decoded text or decoded bytes; ``local`` gives the place of a part in the layer ``parent`` it came from.

    ``read``: the text of these bytes is a layer already. ``steps``: escapes unwrapped since the last other decoding.
    """

    data: str | bytes
    parent: "Layer | None" = None
    local: Callable[[int, int], tuple[int, int]] | None = None
    read: bool = False
    steps: int = 0

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The place of a part in the original text; the way there is as long as encodings of other kinds are nested, each shorter than the last."""
        layer = self
        while layer.parent is not None:
            start, end = layer.local(start, end)
            layer = layer.parent
        return start, end


@dataclass
class Found:
    base: list = field(default_factory=list)
    spans: set = field(default_factory=set)
    layers: int = 0
    unread: int = 0


def _opener(head: bytes):
    if head == ZSTANDARD:
        return zstandard.ZstdDecompressor().decompressobj()
    if head[0] in (0x1F, 0x78):
        return zlib.decompressobj(31 if head[0] == 0x1F else 15)
    return bz2.BZ2Decompressor() if head[0] == 0x42 else lzma.LZMADecompressor()


def _member(unzip, view: memoryview, at: int, room: int, bounded: bool) -> tuple[list[bytes], int]:
    """What one compressed member at ``at`` holds, about up to ``room`` bytes, and where it ends.

    It is fed in growing parts, as what follows a member would be copied; zstandard
    knows no limit of its output and gets small parts only.
    """
    out, size, width = [], 0, 1 << 9
    while at < len(view) and not unzip.eof and size < room:
        part = view[at:at + width]
        at += len(part)
        width = min(2 * width, 1 << 20) if bounded else width
        while size < room:
            out.append(unzip.decompress(part, room - size) if bounded else unzip.decompress(part))
            size += len(out[-1])
            part = getattr(unzip, "unconsumed_tail", b"")
            if unzip.eof or not (part or not getattr(unzip, "needs_input", True)):
                break
    return out, at - len(unzip.unused_data)


def inflate(data: bytes | memoryview, limit: int) -> tuple[bytes, int] | None:
    """What all compressed members at the start of ``data`` hold, and how many bytes they take; None if there are none.

    ``OverflowError`` beyond ``limit`` bytes.
    """
    out, size, at, view = [], 0, 0, memoryview(data)
    while m := PACKED.match(view, at):
        try:
            head = m.group()
            parts, end = _member(_opener(head), view, at, limit + 1 - size, head != ZSTANDARD)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
            break
        out += parts
        size += sum(map(len, parts))
        if size > limit:
            raise OverflowError
        at = end
        padded = ZEROS.match(view, at).end()
        if padded > at and PACKED.match(view, padded):
            at = padded
    return (b"".join(out), at) if size else None


def _utf8_places(text: str, start: int) -> Places:
    """The bytes of each character of a text that begins at byte ``start``."""
    places, at, byte = Places(), 0, start
    for m in BEYOND_ASCII.finditer(text):
        places.add(m.start() - at, byte, 1, 1)
        byte += m.start() - at
        for c in m.group():
            n = 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
            places.add(1, byte, n, n)
            byte += n
        at = m.end()
    places.add(len(text) - at, byte, 1, 1)
    return places


def views(data: bytes, start: int, end: int, read: bool):
    """(text, places of its characters, clean) of the ways to read a part of ``data``."""
    part = data[start:end]
    for m in WIDE.finditer(part) if MAYBE_WIDE.search(part) else ():
        places = Places()
        places.add(len(m.group()) // 2, start + m.start(), 2, 2)
        yield m.group().replace(b"\0", b"").decode(), places, True
    if read or not part:
        return
    try:
        text = part.decode()
    except UnicodeDecodeError:
        places = Places()
        places.add(len(part), start, 1, 1)
        yield part.decode("latin-1"), places, False
        return
    yield text, _utf8_places(text, start), not CONTROL.search(text)


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every escape run decoded in place; ``decode`` gives (characters, piece start, piece end) of a run."""
    parts: list[str] = []
    places, at = Places(), 0
    for m in pattern.finditer(layer.data):
        parts.append(layer.data[at:m.start()])
        places.add(m.start() - at, at, 1, 1)
        for chars, a, b in decode(m):
            parts.append(chars)
            places.add(len(chars), a, b - a if len(chars) == 1 else 0, b - a)
        at = m.end()
    if not at:
        return None
    parts.append(layer.data[at:])
    places.add(len(layer.data) - at, at, 1, 1)
    return Layer("".join(parts), layer, places, steps=layer.steps + 1)


def _unwrapped(layer: Layer) -> Layer | None:
    """The layer with every chain of escapes decoded until nothing is left to decode, in one pass.

    What was read last stands on a stack. As soon as it ends in a complete escape,
    the character that this stands for takes its place and may in turn
    complete an escape with what is there before it or comes after it. More than
    ``LONGEST`` characters after the last sign that starts an escape nothing can; from there on text is kept as it is.
    """
    text, parts, places = layer.data, [], Places()
    at, changed = 0, False
    while at < len(text):
        first = STARTER.search(text, at)
        stop = first.start() if first else len(text)
        parts.append(text[at:stop])
        places.add(stop - at, at, 1, 1)
        at = stop
        stack: list[tuple[str, int, int, bool]] = []  # character, piece start and end, whether a byte of an unfinished character
        starts: list[int] = []
        while at < len(text) and (not stack or starts and len(stack) - starts[-1] <= LONGEST):
            stack.append((text[at], at, at + 1, False))
            at += 1
            while True:
                if stack[-1][0] in "%\\&":
                    starts.append(len(stack) - 1)
                if not starts:
                    break
                m = ENDING.search("".join([c for c, *_ in stack[starts[-1]:]]))
                if not m:
                    break
                changed = True
                n = len(m.group())
                base = 10 if m.group(6) else 16
                code = int(next(filter(None, m.groups())), base)
                piece = stack[-n][1], stack[-1][2]
                del stack[-n:]
                while starts and starts[-1] >= len(stack):
                    starts.pop()
                stack.append((chr(code) if code <= 0x10FFFF else "\ufffd", *piece, bool(m.group(1)) and code > 0x7F))
                _finish_character(stack)
        for c, a, b, _ in stack:
            parts.append("\ufffd" if "\ud800" <= c <= "\udfff" else c)
            places.add(1, a, b - a, b - a)
    return Layer("".join(parts), layer, places, steps=layer.steps + 1) if changed else None


def _finish_character(stack: list) -> None:
    """Joins bytes of one character of UTF-8, or two surrogates, at the end of the stack."""
    if stack[-1][3]:
        for n in (2, 3, 4):
            tail = stack[-n:]
            if len(tail) == n and all(x[3] for x in tail) and _whole(data := bytes(ord(x[0]) for x in tail)):
                stack[-n:] = [(data.decode(), tail[0][1], tail[-1][2], False)]
                return
    elif len(stack) > 1 and "\udc00" <= stack[-1][0] <= "\udfff" and "\ud800" <= stack[-2][0] <= "\udbff":
        high, low = stack[-2:]
        code = 0x10000 + (ord(high[0]) - 0xD800 << 10) + ord(low[0]) - 0xDC00
        stack[-2:] = [(chr(code), high[1], low[2], False)]


def _percent(m: re.Match):
    data = bytes.fromhex(m.group().replace("%", ""))
    out, i = [], 0
    while i < len(data):  # characters one by one, so that each keeps its own place
        n = next((k for k in (1, 2, 3, 4) if _whole(data[i:i + k])), 0)
        n, char = (n, data[i:i + n].decode()) if n else (1, chr(data[i]))
        out.append((char, m.start() + 3 * i, m.start() + 3 * (i + n)))
        i += n
    return out


def _percent_bytes(m: re.Match):
    return [(chr(x), m.start() + 3 * i, m.start() + 3 * i + 3) for i, x in enumerate(bytes.fromhex(m.group().replace("%", "")))]


def _bytes(layer: Layer | None) -> Layer | None:
    """A decoded layer as bytes, one for each character up to U+00FF, if they hold something compressed or in UTF-16."""
    if layer is None:
        return None
    parts, places, at = [], Places(), 0
    for m in BEYOND_LATIN.finditer(layer.data):
        parts.append(layer.data[at:m.start()].encode("latin-1"))
        places.add(m.start() - at, at, 1, 1)
        for i, c in enumerate(m.group()):
            parts.append(c.encode(errors="replace"))
            places.add(len(parts[-1]), m.start() + i, 0, 1)
        at = m.end()
    parts.append(layer.data[at:].encode("latin-1"))
    places.add(len(layer.data) - at, at, 1, 1)
    data = b"".join(parts)
    if not PACKED.search(data) and not MAYBE_WIDE.search(data):
        return None
    return Layer(data, layer, places, True)


def _whole(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def _escape(m: re.Match):
    units = [(int(next(filter(None, x.groups())), 10 if x.group(5) else 16), m.start() + x.start(), m.start() + x.end())
             for x in ONE_ESCAPE.finditer(m.group())]
    out, i = [], 0
    while i < len(units):
        code, a, b = units[i]
        if 0xD800 <= code < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1][0] < 0xE000:
            code, b, i = 0x10000 + (code - 0xD800 << 10) + units[i + 1][0] - 0xDC00, units[i + 1][2], i + 1
        out.append(("\ufffd" if code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code), a, b))
        i += 1
    return out


def _base64(layer: Layer, m: re.Match):
    """The bytes of a run at each of the four alignments."""
    places = Places()
    at = 0
    for a, b in [*((g.start(), g.end()) for g in NOT_BASE64.finditer(m.group())), (len(m.group()), 0)]:
        places.add(a - at, m.start() + at, 1, 1)
        at = b
    run = NOT_BASE64.sub("", m.group()).replace("-", "+").replace("_", "/")
    for skip in range(4):
        part = run[skip:]
        part = part[:-1] if len(part) % 4 == 1 else part
        data = base64.b64decode(part + "=" * (-len(part) % 4))

        def local(s: int, e: int, skip=skip, n=len(data)) -> tuple[int, int]:
            if (s, e, skip) == (0, n, 0):
                return m.start(), m.end()
            return places(skip + s * 4 // 3, skip - (-e * 4 // 3))

        yield Layer(data, layer, local)


def _unpack(raw: Layer, limit: int, found: Found):
    """(layer, clean) of what the bytes hold: compressed streams as bytes, all between them as texts."""
    at = look = 0
    parts = []
    while m := PACKED.search(raw.data, look):
        start = m.start()
        try:
            opened = inflate(memoryview(raw.data)[start:], limit)
        except OverflowError:
            found.unread += 1
            opened = b"", len(raw.data) - start
        if opened is None:
            look = start + 1
            continue
        data, n = opened
        parts.append((at, start))
        at = look = start + n
        yield Layer(data, raw, lambda s, e, place=(start, at): place), False
    for start, end in [*parts, (at, len(raw.data))]:
        for text, place, clean in views(raw.data, start, end, raw.read):
            yield Layer(text, raw, place), clean


def scan(text: str, max_layer_bytes: int = 1 << 26) -> Found:
    """All secrets of a text and of the layers decoded from it.

    A compressed layer over ``max_layer_bytes`` is counted in ``unread``
    instead of being opened, as a few bytes can stand for any amount. Layers
    with bytes that are no text count as layers only where a secret is found.
    """
    found = Found(base=matches(text))
    found.spans.update(found.base)
    seen = set()
    work = [Layer(text)]
    while work:
        layer = work.pop()
        made: list[tuple[Layer | None, bool]] = []
        if isinstance(layer.data, bytes):
            made.extend(_unpack(layer, max_layer_bytes, found))
        else:
            if layer.steps >= STEPS:
                whole = _unwrapped(layer)
                made += [(whole, True), (_bytes(whole), False)]
            elif "%" in layer.data:
                made += [(_replaced(layer, PERCENT, _percent), True), (_bytes(_replaced(layer, PERCENT, _percent_bytes)), False)]
            if layer.steps < STEPS and ("\\" in layer.data or "&#" in layer.data):
                escaped = _replaced(layer, ESCAPE, _escape)
                made += [(escaped, True), (_bytes(escaped), False)]
            for pattern in (BASE64, WRAPPED):
                for m in pattern.finditer(layer.data):
                    made.extend((x, False) for x in _base64(layer, m))
        for new, clean in made:
            if new is None or not new.data:
                continue
            data = new.data if isinstance(new.data, bytes) else new.data.encode(errors="surrogatepass")
            mark = (hashlib.sha256(data).digest(), type(new.data), new.read, new.span(0, len(new.data)))
            if mark in seen:
                continue
            seen.add(mark)
            work.append(new)
            if isinstance(new.data, bytes):
                continue
            hits = matches(new.data)
            found.layers += bool(clean or hits)
            for start, kind, end in hits:
                a, b = new.span(start, end)
                found.spans.add((a, kind, b))
    return found


def joined(spans) -> str:
    rank = list(KINDS)
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in sorted(spans, key=lambda s: (s[0], rank.index(s[1]), s[2])))


def scan_row(text: str | None) -> tuple:
    found = scan(text or "")
    kinds = [k for _, k, _ in found.base]
    return (*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(found.base).encode()).hexdigest(), joined(found.spans),
            found.layers, found.unread)


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex (matches in the text itself), base_sha256 (of these), spans (all, with
    those of decoded layers, as places in the text), n_layers and n_unread.

    Whole texts are read; null is an empty text, which has no match. Input
    columns with these names are replaced, all others stay.
    """
    @F.pandas_udf(RESULT)
    def find(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan_row(t) for t in texts], columns=[c.split()[0] for c in RESULT.split(", ")])

    names = [c.split()[0] for c in RESULT.split(", ")]
    kept = [c for c in docs.columns if c not in names]
    return docs.select(*kept, find(F.coalesce(F.col(text), F.lit(""))).alias("__found")).select(
        *kept, *(F.col("__found")[c].alias(c) for c in names))
