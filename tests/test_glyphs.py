"""Outlines of embedded fonts, subsets, and text drawn with them."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from quire.pdf import glyphs, render, truetype, writer
from quire.pdf.document import Document
from quire.pdf.syntax import Name, PdfError, Ref, Stream

pack = lambda v: struct.pack(f">{len(v)}H", *v)


def simple(points: list[tuple[int, int, int]]) -> bytes:
    """A glyph of one contour: points (x, y, on the curve)."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    step = lambda v: struct.pack(f">{len(v)}h", *(b - a for a, b in zip([0, *v], v)))
    raw = struct.pack(">5h", 1, min(xs), min(ys), max(xs), max(ys)) + pack([len(points) - 1, 0]) + bytes(p[2] for p in points) + step(xs) + step(ys)
    return raw + bytes(len(raw) % 2)


SQUARE = simple([(0, 0, 1), (0, 1000, 1), (1000, 1000, 1), (1000, 0, 1)])
#: All points off the curve: a round shape about the middle.
ROUND = simple([(0, 0, 0), (0, 1000, 0), (1000, 1000, 0), (1000, 0, 0)])
#: The square at half its size, moved by 1000 to the right.
BOTH = struct.pack(">5h", -1, 0, 0, 2000, 1000) + struct.pack(">HHhhh", 1 | 2 | 8, 1, 1000, 0, 8192)


def true_type() -> bytes:
    chars = {65: 1, 66: 2, 67: 3}
    segments = [*sorted(chars), 0xFFFF]
    deltas = [(chars[c] - c) & 0xFFFF if c in chars else 1 for c in segments]
    sub = pack(segments) + pack([0]) + pack(segments) + pack(deltas) + pack([0] * 4)
    sub = struct.pack(">7H", 4, 14 + len(sub), 0, 8, 0, 0, 0) + sub
    bodies = [b"", SQUARE, ROUND, BOTH]
    glyf, loca = b"", [0]
    for raw in bodies:
        glyf += raw + bytes(len(raw) % 2)
        loca.append(len(glyf) // 2)
    tables = {
        "cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + sub, "glyf": glyf, "head": bytes(18) + pack([1000]) + bytes(16) + struct.pack(">4h", 0, 0, 2000, 1000) + bytes(6) + struct.pack(">2h", 0, 0),
        "hhea": bytes(4) + struct.pack(">2h", 1000, 0) + bytes(26) + pack([4]), "hmtx": pack([0, 0, 1000, 0, 1000, 0, 2000, 0]), "loca": pack(loca), "maxp": bytes(4) + pack([4]),
    }
    at, rows, body = 12 + 16 * len(tables), b"", b""
    for tag, raw in tables.items():
        raw += bytes(-len(raw) % 4)
        rows += struct.pack(">4sIII", tag.encode(), 0, at + len(body), len(raw))
        body += raw
    return b"\0\1\0\0" + struct.pack(">H", len(tables)) + bytes(6) + rows + body


def index(items: list[bytes]) -> bytes:
    if not items:
        return b"\0\0"
    ends = np.cumsum([1, *map(len, items)]).tolist()
    return pack([len(items)]) + b"\2" + pack(ends) + b"".join(items)


def number(v: int) -> bytes:
    return b"\x1d" + struct.pack(">i", v)


def t2(*items) -> bytes:
    """A charstring of numbers and operators (bytes)."""
    return b"".join(x if isinstance(x, bytes) else b"\x1c" + struct.pack(">h", x) for x in items)


def cff() -> bytes:
    """Three glyphs: none, A (a square, by a subroutine with a hint mask), x.alt (curves and a flex)."""
    local = [t2(600, b"\x06", b"\x0b")]
    square = t2(10, 20, b"\x12", 30, 40, b"\x14", b"\xc0", 100, 100, b"\x15", 500, 500, -500, b"\x07") + b""
    square = t2(10, 20, b"\x12", 30, 40, b"\x14", b"\xc0", 100, 100, b"\x15", -107, b"\x0a", 600, b"\x07", -600, b"\x06", b"\x0e")
    curved = t2(0, b"\x16", 0, 300, 200, 200, 300, 0, b"\x08", 100, 100, 100, 100, b"\x1f", 50, 10, 50, 50, 50, 50, 50, b"\x0c\x22", b"\x0e")
    strings = [b"x.alt"]
    charset = b"\0" + pack([34, 391])
    private = number(6) + b"\x13"
    head = b"\1\0\4\2" + index([b"F"])

    def top(c, g, p):
        return number(c) + b"\x0f" + number(g) + b"\x11" + number(len(private)) + number(p) + b"\x12"

    size = len(head + index([top(0, 0, 0)]) + index(strings) + index([]))
    chars = index([b"\x0e", square, curved])
    places = size, size + len(charset), size + len(charset) + len(chars)
    return head + index([top(*places)]) + index(strings) + index([]) + charset + chars + private + index(local)


def test_true_type_outlines():
    source = glyphs.Glyf(truetype.TrueType(true_type()))
    (square,) = source.outline(1)
    assert [p[1] for p in square] == [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)] and not source.outline(0) and not source.outline(99)
    (ring,) = source.outline(2)
    assert sum(p[0] == "C" for p in ring) == 4
    half = source.outline(3)[0]
    assert (min(p[1][0] for p in half), max(p[1][0] for p in half), max(p[1][1] for p in half)) == (1.0, 1.5, 0.5)


def test_subsets_keep_what_is_needed():
    font = truetype.TrueType(true_type())
    small = truetype.TrueType(glyphs.subset(font, {3}))
    source = glyphs.Glyf(small)
    assert source.outline(3) == glyphs.Glyf(font).outline(3) and source.outline(1) and not source.outline(2)
    assert small.widths == font.widths and small.chars == font.chars


def test_cff_outlines():
    font = glyphs.Cff(cff())
    assert font.place == {0: 0, 34: 1, 391: 2} and font.by_name("A") == 1 and font.by_name("x.alt") == 2 and font.by_name("b") is None and font.encoding[65] == 1
    (square,) = font.outline(1)
    assert [tuple(round(v, 6) for v in p[1]) for p in square] == [(0.1, 0.1), (0.7, 0.1), (0.7, 0.7), (0.1, 0.7)]
    (curved,) = font.outline(2)
    assert sum(p[0] == "C" for p in curved) == 4
    with pytest.raises((PdfError, IndexError, struct.error)):
        glyphs.Cff(b"\1\0\4")


def drawn(font: dict, raw: bytes, extra=None) -> np.ndarray:
    b = writer.Builder()
    page = writer.PageBuilder(100, 100)
    page.parts.append(b"BT /T 40 Tf 10 20 Td 1 0 0 rg " + raw + b" Tj ET")
    refs = {k: b.add(v) for k, v in (extra or {}).items()}
    ref = b.add(font(b, refs) if callable(font) else font)
    b.page(page)
    n = b.kids[0].num
    b.objects[n] = b.objects[n] | {"Resources": {"Font": {"T": ref}}}
    doc = Document(b.build())
    return render.to_pixels(doc, doc.pages()[0])


def red(pixels, x, y) -> bool:
    return tuple(pixels[99 - y, x]) == (255, 0, 0)


def test_text_is_drawn_with_its_glyphs():
    def simple_font(key):
        return lambda b, refs: {
            "Type": Name("Font"), "Subtype": Name("TrueType" if key == "FontFile2" else "Type1"), "BaseFont": Name("T"), "Encoding": Name("WinAnsiEncoding"), "FirstChar": 65, "Widths": [1000, 1000, 2000],
            "FontDescriptor": b.add({"Type": Name("FontDescriptor"), key: refs["file"]}),
        }

    p = drawn(simple_font("FontFile2"), b"(AB)", {"file": Stream({}, true_type())})
    assert red(p, 11, 21) and red(p, 48, 58) and red(p, 70, 40) and not red(p, 51, 21) and not red(p, 51, 58) and not red(p, 30, 62)
    p = drawn(simple_font("FontFile3"), b"(A)", {"file": Stream({"Subtype": Name("Type1C")}, cff())})
    assert red(p, 16, 26) and red(p, 36, 46) and not red(p, 12, 22) and not red(p, 42, 50)
    broken = drawn(simple_font("FontFile2"), b"(A)", {"file": Stream({}, b"\0\1\0\0 broken")})
    assert red(broken, 20, 30)  # the bar of a font that cannot be read


def test_embedded_subsets_are_drawn():
    font = truetype.TrueType(true_type())
    b = writer.Builder()
    ref, code = truetype.embed(b, font, "T", "C")
    page = writer.PageBuilder(100, 100)
    page.parts.append(b"BT /T 40 Tf 10 20 Td 1 0 0 rg <" + code("C").hex().encode() + b"> Tj ET")
    b.page(page)
    n = b.kids[0].num
    b.objects[n] = b.objects[n] | {"Resources": {"Font": {"T": ref}}}
    doc = Document(b.build())
    p = render.to_pixels(doc, doc.pages()[0])
    assert red(p, 55, 30) and not red(p, 20, 30) and not red(p, 75, 30)


def test_glyphs_that_are_content():
    proc = {"p": Stream({}, b"600 0 d0 0 0 500 500 re f")}
    font = lambda b, refs: {
        "Type": Name("Font"), "Subtype": Name("Type3"), "FontMatrix": [0.001, 0, 0, 0.001, 0, 0], "FirstChar": 97, "Widths": [600], "CharProcs": {"box": refs["p"]},
        "Encoding": {"Differences": [97, Name("box")]}, "FontBBox": [0, 0, 500, 500],
    }
    p = drawn(font, b"(aa)", proc)
    assert red(p, 12, 22) and red(p, 28, 38) and not red(p, 32, 30) and red(p, 36, 30) and isinstance(Ref(1), tuple)
