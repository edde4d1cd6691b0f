"""Content streams: operations, the text machine, and what of a page they touch."""

from __future__ import annotations

import math
import re

from quire.pdf.fonts import Font
from quire.pdf.syntax import EOF, Keyword, Lexer, Name, PdfError, Stream

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def concat(m, n):
    """Apply m, then n."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l


def apply(m, x, y):
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def scale_of(m) -> float:
    return math.sqrt(abs(m[0] * m[3] - m[1] * m[2]))


def operations(data: bytes):
    """(operator, operands) in order; an inline image is ("BI", [Stream])."""
    lex, held = Lexer(data), []
    while True:
        try:
            t = lex.object()
        except PdfError:
            return
        if not isinstance(t, Keyword):
            held.append(t)
            continue
        if t is EOF or t == "":
            return
        if t == "BI":
            yield "BI", [_inline_image(lex)]
        elif t not in ("]", ">>", ">", "{", "}", ")"):
            yield str(t), held
        held = []


def _inline_image(lex: Lexer) -> Stream:
    d = {}
    while True:
        key = lex.token()
        if isinstance(key, Keyword):
            break
        value = lex.object()
        if isinstance(key, Name):
            d[str(key)] = value
    start = lex.at + 1
    m = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(lex.data, start)
    end = m.start() if m else len(lex.data)
    lex.at = m.end() if m else len(lex.data)
    return Stream(d, lex.data[start:end])


def fonts_of(doc, resources) -> dict[str, Font]:
    out = {}
    for name, ref in (doc.get(resources, "Font", dict) or {}).items():
        d = doc.resolve(ref)
        if isinstance(d, dict):
            out[name] = Font(doc, d)
    return out


class TextMachine:
    """Glyphs of a content stream: (text, x, y, size, font, width), in the order in which they are shown."""

    def __init__(self, fonts: dict[str, Font]):
        self.fonts, self.chars = fonts, []
        self.ctm = self.tm = self.line = IDENTITY
        self.state = {"font": "", "size": 0.0, "tc": 0.0, "tw": 0.0, "tz": 1.0, "tl": 0.0, "rise": 0.0}
        self.stack = []
        #: (font, code, matrix from the em to the page) of each glyph, if a list is put here
        self.marks: list | None = None
        self._shown: dict[tuple, dict[int, tuple[str, float, float]]] = {}

    def _glyph(self, font: Font | None, code: int) -> tuple[str, float, float]:
        """Text, width and step of a code in the present state."""
        s = self.state
        text, width = font.glyph(code) if font else (chr(code), 500.0)
        wide = width / 1000 * s["size"]
        step = (wide + s["tc"] + (s["tw"] if code == 32 else 0)) * s["tz"]
        return "" if text == "\x00" else text, abs(wide * s["tz"]), step

    def show(self, raw: bytes) -> None:
        """Show a string. All its glyphs lie on one line, along the first row of the text matrix."""
        s = self.state
        name, size, tz = s["font"], s["size"], s["tz"]
        font = self.fonts.get(name)
        known = self._shown.setdefault((name, size, tz, s["tc"], s["tw"]), {})
        a, b, c, d, x, y = concat(self.tm, self.ctm)
        x, y = x + s["rise"] * c, y + s["rise"] * d
        high = scale_of((size * a, size * b, size * c, size * d, 0, 0))
        chars, at = self.chars, 0.0
        for code in raw if font is None or not font.two_bytes else (code for code, _ in font.codes(raw)):
            glyph = known.get(code)
            if glyph is None:
                glyph = known[code] = self._glyph(font, code)
            text, width, step = glyph
            if self.marks is not None:
                self.marks.append((font, code, (size * tz * a, size * tz * b, size * c, size * d, x + at * a, y + at * b)))
            if text:
                chars.append((text, x + at * a, y + at * b, high, name, width))
            at += step
        self.tm = concat((1, 0, 0, 1, at, 0), self.tm)

    def next_line(self, x: float, y: float) -> None:
        self.line = self.tm = concat((1, 0, 0, 1, x, y), self.line)

    def step(self, op: str, args: list) -> None:
        s = self.state
        number = lambda k=0: float(args[k]) if k < len(args) and isinstance(args[k], (int, float)) else 0.0
        if op == "q":
            self.stack.append((self.ctm, dict(s)))
        elif op == "Q":
            if self.stack:
                self.ctm, self.state = self.stack.pop()
        elif op == "cm" and len(args) >= 6:
            self.ctm = concat(tuple(number(k) for k in range(6)), self.ctm)
        elif op == "BT":
            self.tm = self.line = IDENTITY
        elif op == "Tc":
            s["tc"] = number()
        elif op == "Tw":
            s["tw"] = number()
        elif op == "Tz":
            s["tz"] = number() / 100
        elif op == "TL":
            s["tl"] = number()
        elif op == "Ts":
            s["rise"] = number()
        elif op == "Tf" and len(args) >= 2:
            s["font"], s["size"] = str(args[0]), number(1)
        elif op in ("Td", "TD"):
            if op == "TD":
                s["tl"] = -number(1)
            self.next_line(number(0), number(1))
        elif op == "Tm" and len(args) >= 6:
            self.tm = self.line = tuple(number(k) for k in range(6))
        elif op == "T*":
            self.next_line(0, -s["tl"])
        elif op == "Tj" and args and isinstance(args[0], bytes):
            self.show(args[0])
        elif op == "TJ" and args and isinstance(args[0], list):
            for x in args[0]:
                if isinstance(x, bytes):
                    self.show(x)
                elif isinstance(x, (int, float)):
                    self.tm = concat((1, 0, 0, 1, -x / 1000 * s["size"] * s["tz"], 0), self.tm)
        elif op == "'" and args and isinstance(args[0], bytes):
            self.next_line(0, -s["tl"])
            self.show(args[0])
        elif op == '"' and len(args) >= 3 and isinstance(args[2], bytes):
            s["tw"], s["tc"] = number(0), number(1)
            self.next_line(0, -s["tl"])
            self.show(args[2])


def page_chars(doc, page: dict) -> list[tuple]:
    machine = TextMachine(fonts_of(doc, doc.resolve(page.get("Resources"))))
    for op, args in operations(doc.content(page)):
        machine.step(op, args)
    return machine.chars


def page_bbox(doc, page: dict) -> list[float] | None:
    """The box of all painted paths, images and glyphs of a page; None for an empty page."""
    return chars_and_bbox(doc, page)[1]


def chars_and_bbox(doc, page: dict) -> tuple[list[tuple], list[float] | None]:
    """A page's glyphs and the box of all it paints, from one pass over its content."""
    xs: list[float] = []
    ys: list[float] = []

    def add(m, *points):
        for x, y in points:
            px, py = apply(m, x, y)
            xs.append(px)
            ys.append(py)

    machine = TextMachine(fonts_of(doc, doc.resolve(page.get("Resources"))))
    path: list[tuple[float, float]] = []
    for op, args in operations(doc.content(page)):
        nums = [float(a) for a in args if isinstance(a, (int, float))] if op in _PATH else []
        if op in ("m", "l") and len(nums) >= 2:
            path.append((nums[-2], nums[-1]))
        elif op in ("c", "v", "y"):
            path += list(zip(nums[::2], nums[1::2]))
        elif op == "re" and len(nums) >= 4:
            x, y, w, h = nums[:4]
            path += [(x, y), (x + w, y + h), (x + w, y), (x, y + h)]
        elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*"):
            add(machine.ctm, *path)
            path = []
        elif op == "n":
            path = []
        elif op in ("Do", "BI"):
            add(machine.ctm, (0, 0), (1, 0), (0, 1), (1, 1))
        machine.step(op, args)
    for _, x, y, size, _, width in machine.chars:
        xs += (x, x + width)
        ys += (y - 0.2 * size, y + 0.8 * size)
    return machine.chars, [min(xs), min(ys), max(xs), max(ys)] if xs else None


_PATH = frozenset(["m", "l", "c", "v", "y", "re"])


def find(chars: list[tuple], compiled, max_results: int = 0) -> list[tuple]:
    """Hits of a pattern with one group, in the glyphs as they are shown: (text, first glyph, end, x0, y0, x1, y1)."""
    text = "".join(c[0] for c in chars)
    plain = len(text) == len(chars)
    index = None
    out = []
    for m in compiled.finditer(text):
        if not m[1]:
            continue
        if not plain and index is None:
            index = [k for k, c in enumerate(chars) for _ in c[0]]
        first, last = m.start(1), m.end(1) - 1
        if index is not None:
            first, last = index[first], index[last]
        own = chars[first : last + 1]
        out.append((m[1], first, last + 1, min(g[1] for g in own), min(g[2] for g in own), max(g[1] + g[5] for g in own), max(g[2] + g[3] for g in own)))
        if max_results and len(out) == max_results:
            break
    return out


def image_sizes(doc, page: dict) -> dict[str, tuple[float, float]]:
    """The largest size, in points, at which each image of a page is drawn."""
    out: dict[str, tuple[float, float]] = {}
    machine = TextMachine({})
    for op, args in operations(doc.content(page)):
        if op == "Do" and args:
            a, b, c, d, _, _ = machine.ctm
            own, old = (math.hypot(a, b), math.hypot(c, d)), out.get(str(args[0]), (0.0, 0.0))
            out[str(args[0])] = max(own[0], old[0]), max(own[1], old[1])
        if op in ("q", "Q", "cm"):
            machine.step(op, args)
    return out
