"""Colours, profiles and embedded TrueType fonts."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from quire.pdf import color, content, fonts, truetype, writer
from quire.pdf.document import Document, hint_tables
from quire.pdf.syntax import Name, PdfError, Ref, Stream, write_object


def profile(space: bytes, tags: dict[str, bytes]) -> bytes:
    head = bytes(8) + bytes([2, 0x10, 0, 0]) + b"mntr" + space + b"XYZ " + bytes(12) + b"acsp" + bytes(88)
    at, rows, body = 132 + 12 * len(tags), b"", b""
    for name, raw in tags.items():
        rows += name.encode() + struct.pack(">II", at + len(body), len(raw))
        body += raw
    return head + struct.pack(">I", len(tags)) + rows + body


def xyz(*v):
    return b"XYZ " + bytes(4) + b"".join(struct.pack(">i", round(x * 65536)) for x in v)


GAMMA = b"curv" + bytes(4) + struct.pack(">IH", 1, round(2.2 * 256))
SRGB = {"rXYZ": xyz(0.4360, 0.2225, 0.0139), "gXYZ": xyz(0.3851, 0.7169, 0.0971), "bXYZ": xyz(0.1431, 0.0606, 0.7141), "rTRC": GAMMA, "gTRC": GAMMA, "bTRC": GAMMA}


def test_profiles():
    rgb = profile(b"RGB ", SRGB)
    out = color.icc_to_srgb(rgb, [[1, 1, 1], [0, 0, 0], [1, 0, 0], [0.5, 0.5, 0.5]])
    assert np.allclose(out, [[1, 1, 1], [0, 0, 0], [1, 0, 0], [0.5, 0.5, 0.5]], atol=0.02)
    gray = profile(b"GRAY", {"kTRC": b"para" + bytes(4) + struct.pack(">HHi", 0, 0, round(2.2 * 65536))})
    assert np.allclose(color.icc_to_srgb(gray, [[0.5]]), 0.5, atol=0.02)
    assert color.icc_to_srgb(profile(b"CMYK", {}), [[0, 0.5, 1, 0]]).tolist() == [[1, 0.5, 0]] and not color.icc_to_srgb(b"junk", [[1, 1, 1]]).any()


def test_spaces():
    doc = Document(writer.lines_to_pdf([["x"]]))
    tint = {"FunctionType": 2, "Domain": [0, 1], "C0": [1, 1, 1], "C1": [1, 0, 0], "N": 1}
    rgb = lambda space, *v: color.to_rgb(doc, space, list(v))
    assert rgb(Name("DeviceGray"), 0.3) == (0.3,) * 3 and rgb(Name("DeviceCMYK"), 0, 0, 0, 1) == (0, 0, 0)
    assert rgb([Name("Indexed"), Name("DeviceRGB"), 1, b"\0\0\0\xff\0\0"], 1) == (1.0, 0, 0)
    assert rgb([Name("Separation"), Name("Spot"), Name("DeviceRGB"), tint], 1.0) == (1, 0, 0)
    assert np.allclose(rgb([Name("Lab"), {}], 100, 0, 0), 1, atol=0.01) and rgb(Name("Pattern"), 1) == (0, 0, 0)
    assert rgb([Name("ICCBased"), Stream({"N": 3}, b"no profile")], 0.1, 0.2, 0.3) == (0.1, 0.2, 0.3)


def font_file() -> bytes:
    chars = {65: 1, 66: 2, 0x6587: 3}
    segments = sorted(chars) + [0xFFFF]
    deltas = [(chars.get(c, 0) - c) & 0xFFFF if c in chars else 1 for c in segments]
    pack = lambda v: struct.pack(f">{len(v)}H", *v)
    sub = pack(segments) + pack([0]) + pack(segments) + pack(deltas) + pack([0] * len(segments))
    sub = struct.pack(">7H", 4, 14 + len(sub), 0, 2 * len(segments), 0, 0, 0) + sub
    tables = {
        "cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + sub, "head": bytes(18) + struct.pack(">H", 2000) + bytes(16) + struct.pack(">4h", 0, -400, 2000, 1600) + bytes(10),
        "hhea": bytes(4) + struct.pack(">2h", 1600, -400) + bytes(26) + struct.pack(">H", 3), "maxp": bytes(4) + struct.pack(">H", 4), "hmtx": pack([0, 0, 1000, 0, 1200, 0]) + bytes(2),
    }
    at, rows, body = 12 + 16 * len(tables), b"", b""
    for tag, raw in tables.items():
        rows += struct.pack(">4sIII", tag.encode(), 0, at + len(body), len(raw))
        body += raw
    return b"\0\1\0\0" + struct.pack(">H", len(tables)) + bytes(6) + rows + body


def test_embedded_fonts():
    font = truetype.TrueType(font_file())
    assert font.chars == {65: 1, 66: 2, 0x6587: 3} and font.widths == [0, 500, 600, 600] and (font.ascent, font.descent) == (800, -200)
    b = writer.Builder()
    ref, code = truetype.embed(b, font, "Test", "AB文")
    page = writer.PageBuilder()
    page.parts.append(b"BT /T 10 Tf 5 5 Td " + write_object(code("BA文")) + b" Tj ET")
    b.page(page)
    n = b.kids[0].num
    b.objects[n] = b.objects[n] | {"Resources": {"Font": {"T": ref}}}
    doc = Document(b.build())
    chars = content.page_chars(doc, doc.pages()[0])
    assert [(c[0], round(c[5], 3)) for c in chars] == [("B", 6), ("A", 5), ("文", 6)]
    with pytest.raises(PdfError):
        truetype.TrueType(b"no font")


def test_hints():
    bits = f"{3:032b}{500:032b}{2:016b}{100:032b}{8:016b}" + "0" * (32 + 16 + 32 + 16 + 16 + 16 + 16 + 16) + "0110" + "0000" + f"{5:08b}{9:08b}"
    body = int(bits, 2).to_bytes(-(-len(bits) // 8))
    lead = b"%PDF-1.4\n1 0 obj\n<</Linearized 1/N 2/H[60 99]>>\nendobj\n"
    stream = b" " * (60 - len(lead)) + b"2 0 obj\n" + write_object(Stream({}, body)) + b"\nendobj\n"
    rest = b"3 0 obj\n<</Type/Catalog/Pages 4 0 R>>\nendobj\n4 0 obj\n<</Kids[]/Count 0>>\nendobj\ntrailer\n<</Root 3 0 R>>"
    from quire.pdf.document import rebuild

    doc = rebuild(lead + stream + rest)
    assert doc.linearized and hint_tables(doc) == {"first_page_offset": 500, "pages": [{"objects": 4, "length": 105}, {"objects": 5, "length": 109}]}
    assert hint_tables(Document(writer.lines_to_pdf([["x"]]))) is None and Ref(1) == Ref(1, 0)


def test_standard_widths_by_code():
    width = lambda font, text: [fonts.standard_width(font, ord(c)) for c in text]
    assert width("Helvetica", ' "*+@AWiz~') == [278, 355, 389, 584, 1015, 667, 944, 222, 500, 278]
    assert width("Times-Roman", " '*ATELRsyz~") == [250, 180, 250, 722, 611, 611, 611, 667, 389, 500, 444, 250]
    assert width("Courier-Bold", "iW") == [600, 600] and width("Symbol", "a") == [500] and fonts.standard_width("Helvetica", 200) == 278
