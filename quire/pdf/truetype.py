"""TrueType files as fonts of a document: their tables, widths and characters, and the objects that embed them."""

from __future__ import annotations

import struct

from quire.pdf.filters import flate_encode
from quire.pdf.syntax import Name, PdfError, Ref, Stream


class TrueType:
    """Glyph numbers by character, and advance widths in thousandths."""

    def __init__(self, data: bytes):
        if data[:4] not in (b"\0\1\0\0", b"true", b"OTTO"):
            raise PdfError("not a TrueType file")
        n = struct.unpack(">H", data[4:6])[0]
        self.data, self.tables = data, {}
        for k in range(n):
            tag, _, at, size = struct.unpack(">4sIII", data[12 + 16 * k : 28 + 16 * k])
            self.tables[tag.decode("latin-1")] = data[at : at + size]
        for tag in ("head", "hhea", "hmtx", "maxp", "cmap"):
            if tag not in self.tables:
                raise PdfError(f"no {tag} table")
        self.units = struct.unpack(">H", self.tables["head"][18:20])[0]
        self.box = [round(v * 1000 / self.units) for v in struct.unpack(">4h", self.tables["head"][36:44])]
        self.ascent, self.descent = (round(v * 1000 / self.units) for v in struct.unpack(">2h", self.tables["hhea"][4:8]))
        count = struct.unpack(">H", self.tables["hhea"][34:36])[0]
        self.glyphs = struct.unpack(">H", self.tables["maxp"][4:6])[0]
        raw = [struct.unpack(">H", self.tables["hmtx"][4 * k : 4 * k + 2])[0] for k in range(count)]
        self.widths = [round(w * 1000 / self.units) for w in raw + raw[-1:] * (self.glyphs - count)]
        self.chars = self._cmap()

    def _cmap(self) -> dict[int, int]:
        t = self.tables["cmap"]
        found = {}
        for k in range(struct.unpack(">H", t[2:4])[0]):
            platform, encoding, at = struct.unpack(">HHI", t[4 + 8 * k : 12 + 8 * k])
            found[platform, encoding] = t[at:]
        for key in ((3, 10), (0, 4), (3, 1), (0, 3), (0, 1), (0, 0), (3, 0)):
            if key in found:
                return self._subtable(found[key])
        return {}

    @staticmethod
    def _subtable(t: bytes) -> dict[int, int]:
        kind, out = struct.unpack(">H", t[:2])[0], {}
        if kind == 4:
            n = struct.unpack(">H", t[6:8])[0] // 2
            words = lambda at: struct.unpack(f">{n}H", t[at : at + 2 * n])
            ends, starts, deltas, offsets = words(14), words(16 + 2 * n), words(16 + 4 * n), words(16 + 6 * n)
            for k in range(n):
                for c in range(starts[k], min(ends[k], 0xFFFE) + 1):
                    if offsets[k]:
                        at = 16 + 6 * n + 2 * k + offsets[k] + 2 * (c - starts[k])
                        g = struct.unpack(">H", t[at : at + 2])[0]
                        g = (g + deltas[k]) & 0xFFFF if g else 0
                    else:
                        g = (c + deltas[k]) & 0xFFFF
                    if g:
                        out[c] = g
        elif kind == 12:
            for k in range(struct.unpack(">I", t[12:16])[0]):
                first, last, glyph = struct.unpack(">III", t[16 + 12 * k : 28 + 12 * k])
                out.update((c, glyph + c - first) for c in range(first, last + 1))
        return out


def to_unicode_cmap(mapping: dict[int, str]) -> bytes:
    """A ToUnicode stream for codes of two bytes."""
    rows = [b"<%04X> <%s>" % (code, text.encode("utf-16-be").hex().upper().encode()) for code, text in sorted(mapping.items())]
    out = [b"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapType 2 def /CMapName /Adobe-Identity-UCS def", b"1 begincodespacerange <0000> <FFFF> endcodespacerange"]
    for k in range(0, len(rows), 100):
        part = rows[k : k + 100]
        out += [b"%d beginbfchar" % len(part), *part, b"endbfchar"]
    return b"\n".join([*out, b"endcmap CMapName currentdict /CMap defineresource pop end end"])


def embed(builder, font: TrueType, name: str, text: str) -> tuple[Ref, callable]:
    """A Type0 font object for what text needs, with the outlines of its glyphs only, and a function from text to its bytes. Glyph numbers are the codes."""
    from quire.pdf.glyphs import subset

    used = {c: font.chars.get(ord(c), 0) for c in sorted(set(text))}
    codes = {g: c for c, g in used.items() if g}
    data = subset(font, set(codes)) if "glyf" in font.tables and "loca" in font.tables else font.data
    program = builder.add(Stream({"Filter": Name("FlateDecode"), "Length1": len(data)}, flate_encode(data)))
    descriptor = builder.add({
        "Type": Name("FontDescriptor"), "FontName": Name(name), "Flags": 4, "FontBBox": font.box, "ItalicAngle": 0, "Ascent": font.ascent, "Descent": font.descent,
        "CapHeight": font.ascent, "StemV": 80, "FontFile2": program,
    })
    widths: list = []
    for g in sorted(codes):
        widths += [g, [font.widths[g]]]
    cid = builder.add({
        "Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name(name), "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0},
        "FontDescriptor": descriptor, "DW": 1000, "W": widths, "CIDToGIDMap": Name("Identity"),
    })
    mapped = builder.add(Stream({}, to_unicode_cmap(codes)))
    ref = builder.add({"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name(name), "Encoding": Name("Identity-H"), "DescendantFonts": [cid], "ToUnicode": mapped})
    return ref, lambda t: b"".join(struct.pack(">H", used.get(c, 0)) for c in t)
