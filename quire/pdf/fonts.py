"""Fonts as far as text needs them: encodings, ToUnicode maps and widths."""

from __future__ import annotations

import re

from quire.pdf import filters
from quire.pdf.syntax import Lexer, Name, PdfError, Stream

#: Widths of the standard fonts for the codes 32 to 122, in thousandths; other codes have the width of a space.
HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 278, 278,
    278, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500,
)
TIMES = (
    250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 250, 250, 250, 250, 250, 250,
    500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 250, 250, 250, 250, 250, 250,
    250, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722,
    556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 250, 250, 250, 250, 250,
    250, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500,
    500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444,
)
COURIER, OTHER = 600, 500
STANDARD_14 = (
    "Courier Courier-Bold Courier-Oblique Courier-BoldOblique Helvetica Helvetica-Bold Helvetica-Oblique Helvetica-BoldOblique "
    "Times-Roman Times-Bold Times-Italic Times-BoldItalic Symbol ZapfDingbats"
).split()

#: Glyph names that are not single letters.
_GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(",
    "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3",
    "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">",
    "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{",
    "bar": "|", "braceright": "}", "asciitilde": "~", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”",
    "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "fi": "ﬁ", "fl": "ﬂ", "Euro": "€", "germandbls": "ß",
}
_ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "ring": "̊", "cedilla": "̧", "caron": "̌"}


def glyph_text(name: str) -> str:
    """The text of a glyph name, by list, by uniXXXX or by letter and accent; empty if unknown."""
    if name in _GLYPHS:
        return _GLYPHS[name]
    if len(name) == 1:
        return name
    m = re.fullmatch(r"uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,6})", name)
    if m:
        return chr(int(m[1] or m[2], 16))
    m = re.fullmatch(r"([A-Za-z])(acute|grave|circumflex|dieresis|tilde|ring|cedilla|caron)", name)
    if m:
        import unicodedata

        return unicodedata.normalize("NFC", m[1] + _ACCENTS[m[2]])
    return ""


#: The text of each code.
WINANSI = bytes(range(256)).decode("cp1252", "replace").replace("�", "•")
MACROMAN = bytes(range(256)).decode("mac-roman")


def winansi(code: int) -> str:
    return WINANSI[code]


def standard_width(font: str, code: int) -> float:
    """The width of a code in one of the standard fonts."""
    if font.startswith("Courier"):
        return COURIER
    table = HELVETICA if font.startswith("Helvetica") else TIMES if font.startswith("Times") else None
    if table is None:
        return OTHER
    return table[code - 32] if 32 <= code < 32 + len(table) else table[0]


class CMap:
    """Codes to text, from a ToUnicode stream."""

    def __init__(self, data: bytes):
        self.chars: dict[int, str] = {}
        self.ranges: list[tuple[int, int, object]] = []
        self.width = 0
        lex, stack = Lexer(data), []
        number = lambda raw: int.from_bytes(raw)
        while True:
            t = lex.object()
            word = str(t) if type(t).__name__ == "Keyword" else None
            if word is None:
                stack.append(t)
                continue
            if word == "":
                break
            if word == "endbfchar":
                for a, b in zip(stack[::2], stack[1::2]):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        self.chars[number(a)] = b.decode("utf-16-be", "replace")
                        self.width = max(self.width, len(a))
            elif word == "endbfrange":
                for a, b, to in zip(stack[::3], stack[1::3], stack[2::3]):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        self.ranges.append((number(a), number(b), to))
                        self.width = max(self.width, len(a))
            elif word == "endcodespacerange" and stack and isinstance(stack[-1], bytes):
                self.width = max(self.width, len(stack[-1]))
            stack = []

    def lookup(self, code: int) -> str | None:
        if code in self.chars:
            return self.chars[code]
        for low, high, to in self.ranges:
            if low <= code <= high:
                if isinstance(to, list):
                    return to[code - low].decode("utf-16-be", "replace") if code - low < len(to) and isinstance(to[code - low], bytes) else None
                if isinstance(to, bytes):
                    text = to.decode("utf-16-be", "replace")
                    return text[:-1] + chr(ord(text[-1]) + code - low) if text else None
        return None


class Font:
    """A font resource: code width in bytes, text of a code, width of a code."""

    def __init__(self, doc, d: dict):
        self.doc, self.dict = doc, d
        self.subtype = str(doc.get(d, "Subtype") or "Type1")
        self.base = str(doc.get(d, "BaseFont") or "")
        self.plain = self.base.split("+")[-1]
        self.two_bytes = self.subtype == "Type0"
        self.cmap = None
        to_unicode = doc.get(d, "ToUnicode")
        if isinstance(to_unicode, Stream):
            try:
                self.cmap = CMap(filters.decode_tolerant(to_unicode.raw, to_unicode.dict, doc.resolve)[0])
            except PdfError:
                self.cmap = None
        encoding = doc.get(d, "Encoding")
        self.encoding = str(encoding) if isinstance(encoding, Name) else str(doc.get(encoding, "BaseEncoding") or "") if isinstance(encoding, dict) else ""
        self.differences: dict[int, str] = {}
        self.names: dict[int, str] = {}
        at = 0
        for x in (doc.get(encoding, "Differences", list) or []) if isinstance(encoding, dict) else []:
            x = doc.resolve(x)
            if isinstance(x, Name):
                self.differences[at], self.names[at] = glyph_text(x), str(x)
                at += 1
            elif isinstance(x, (int, float)):
                at = int(x)
        self._glyphs: dict[int, tuple[str, float]] = {}
        self.widths: dict[int, float] = {}
        self.default = 500.0
        self._read_widths(d)
        descriptor = doc.get(d, "FontDescriptor", dict) or {}
        self.embedded = any(k in descriptor for k in ("FontFile", "FontFile2", "FontFile3"))

    def _read_widths(self, d: dict) -> None:
        doc = self.doc
        if self.two_bytes:
            kids = doc.get(d, "DescendantFonts", list) or [None]
            cid = doc.resolve(kids[0])
            self.default = float(doc.get(cid, "DW", (int, float)) or 1000)
            w, at = [doc.resolve(x) for x in doc.get(cid, "W", list) or []], 0
            while at + 1 < len(w):
                if isinstance(w[at + 1], list):
                    self.widths.update((int(w[at]) + k, float(doc.resolve(v))) for k, v in enumerate(w[at + 1]))
                    at += 2
                elif at + 2 < len(w):
                    self.widths.update((c, float(w[at + 2])) for c in range(int(w[at]), min(int(w[at + 1]), int(w[at]) + 65535) + 1))
                    at += 3
                else:
                    break
            return
        first = doc.get(d, "FirstChar", int) or 0
        for k, v in enumerate(doc.get(d, "Widths", list) or []):
            v = doc.resolve(v)
            if isinstance(v, (int, float)):
                self.widths[first + k] = float(v)
        descriptor = doc.get(d, "FontDescriptor", dict)
        self.default = float(doc.get(descriptor, "MissingWidth", (int, float)) or (0 if self.widths else 500)) if descriptor else 500.0

    def codes(self, raw: bytes):
        """(code, bytes used) for each code of a string."""
        if self.two_bytes:
            yield from ((int.from_bytes(raw[k : k + 2]), 2) for k in range(0, len(raw), 2))
        else:
            yield from ((b, 1) for b in raw)

    def text(self, code: int) -> str:
        if self.cmap:
            found = self.cmap.lookup(code)
            if found is not None:
                return found
        if self.two_bytes:
            return chr(code) if 0 < code < 0xD800 or 0xDFFF < code else ""
        if code in self.differences:
            return self.differences[code]
        return MACROMAN[code] if self.encoding == "MacRomanEncoding" else WINANSI[code]

    def width(self, code: int) -> float:
        if code in self.widths:
            return self.widths[code]
        if not self.two_bytes and self.plain in STANDARD_14 and not self.widths:
            return standard_width(self.plain, code)
        return self.default

    def glyph(self, code: int) -> tuple[str, float]:
        """Text and width of a code, worked out once."""
        found = self._glyphs.get(code)
        if found is None:
            found = self._glyphs[code] = self.text(code), self.width(code)
        return found

    def info(self) -> dict:
        return {"base_font": self.base, "subtype": self.subtype, "encoding": self.encoding, "embedded": self.embedded, "to_unicode": self.cmap is not None}


def substitute(name: str) -> str:
    """The standard font that stands in for a font that is not there, by its name."""
    low = name.split("+")[-1].lower()
    bold = any(w in low for w in ("bold", "black", "heavy", "semibold", "demi"))
    italic = any(w in low for w in ("italic", "oblique", "slant"))
    if any(w in low for w in ("courier", "mono", "consol", "typewriter", "fixed")):
        return ("Courier", "Courier-Oblique", "Courier-Bold", "Courier-BoldOblique")[2 * bold + italic]
    if "symbol" in low:
        return "Symbol"
    if "dingbat" in low:
        return "ZapfDingbats"
    if any(w in low for w in ("times", "serif", "roman", "garamond", "georgia", "palatino", "bookman", "century", "cambria", "minion")) and "sans" not in low:
        return ("Times-Roman", "Times-Italic", "Times-Bold", "Times-BoldItalic")[2 * bold + italic]
    return ("Helvetica", "Helvetica-Oblique", "Helvetica-Bold", "Helvetica-BoldOblique")[2 * bold + italic]
