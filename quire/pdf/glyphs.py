"""Outlines of glyphs from embedded font programs: TrueType (glyf) and CFF (Type 2 charstrings), and which glyph a code means.

An outline is a list of closed paths of ("M", p), ("L", p) and ("C", p, p, p)
in units of the em.
"""

from __future__ import annotations

import struct

from quire.pdf.syntax import PdfError, Stream
from quire.pdf.truetype import TrueType

Path = list[tuple]
_DEEP = 10


# --- TrueType ---


class Glyf:
    """Glyphs of a TrueType file."""

    def __init__(self, font: TrueType):
        if "glyf" not in font.tables or "loca" not in font.tables:
            raise PdfError("a font without outlines")
        self.font = font
        long = struct.unpack(">h", font.tables["head"][50:52])[0]
        raw = font.tables["loca"]
        self.places = list(struct.unpack(f">{len(raw) // 4}I", raw[: len(raw) // 4 * 4])) if long else [2 * v for v in struct.unpack(f">{len(raw) // 2}H", raw[: len(raw) // 2 * 2])]

    def data(self, glyph: int) -> bytes:
        if not 0 <= glyph < len(self.places) - 1:
            return b""
        return self.font.tables["glyf"][self.places[glyph] : self.places[glyph + 1]]

    def outline(self, glyph: int) -> list[Path]:
        return [_quadratic([(x / self.font.units, y / self.font.units, on) for x, y, on in c]) for c in self._contours(glyph, _DEEP) if len(c) > 1]

    def _contours(self, glyph: int, deep: int) -> list[list[tuple[float, float, bool]]]:
        data = self.data(glyph)
        if len(data) < 10 or not deep:
            return []
        n = struct.unpack(">h", data[:2])[0]
        if n < 0:
            return [c for part, m in self._parts(data) for c in ([(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5], on) for x, y, on in own] for own in self._contours(part, deep - 1))]
        ends = struct.unpack(f">{n}H", data[10 : 10 + 2 * n])
        at = 10 + 2 * n
        at += 2 + struct.unpack(">H", data[at : at + 2])[0]
        count, flags = (ends[-1] + 1 if ends else 0), []
        while len(flags) < count:
            f = data[at]
            at += 1
            flags.append(f)
            if f & 8:
                flags += [f] * data[at]
                at += 1
        axes = []
        for short, same in ((2, 16), (4, 32)):
            v, own = 0, []
            for f in flags[:count]:
                if f & short:
                    v += data[at] if f & same else -data[at]
                    at += 1
                elif not f & same:
                    v += struct.unpack(">h", data[at : at + 2])[0]
                    at += 2
                own.append(v)
            axes.append(own)
        points = [(x, y, bool(f & 1)) for x, y, f in zip(*axes, flags)]
        return [points[a:b] for a, b in zip([0, *(e + 1 for e in ends)], [e + 1 for e in ends])]

    def _parts(self, data: bytes) -> list[tuple[int, tuple]]:
        """Glyphs that a glyph is put together from, with their matrices."""
        out, at, more = [], 10, True
        while more and at + 4 <= len(data):
            flags, part = struct.unpack(">HH", data[at : at + 4])
            at += 4
            kind, size = (">hh", 4) if flags & 1 else (">bb", 2)
            dx, dy = struct.unpack(kind, data[at : at + size]) if flags & 2 else (0, 0)
            at += size
            n = 1 if flags & 8 else 2 if flags & 64 else 4 if flags & 128 else 0
            f = [v / 16384 for v in struct.unpack(f">{n}h", data[at : at + 2 * n])]
            at += 2 * n
            a, b, c, d = (1, 0, 0, 1) if not f else (f[0], 0, 0, f[0]) if n == 1 else (f[0], 0, 0, f[1]) if n == 2 else f
            out.append((part, (a, b, c, d, dx, dy)))
            more = bool(flags & 32)
        return out

    def needed(self, glyphs: set[int]) -> set[int]:
        """Glyphs and those that they are put together from."""
        out, todo = {0}, list(glyphs)
        while todo:
            g = todo.pop()
            if g not in out:
                out.add(g)
                data = self.data(g)
                if len(data) >= 10 and data[0] & 0x80:
                    todo += [p for p, _ in self._parts(data)]
        return out


def _quadratic(points: list[tuple[float, float, bool]]) -> Path:
    """A closed path of points on and off the curve; between two off it lies one on it."""
    whole = []
    for k, (x, y, on) in enumerate(points):
        px, py, before = points[k - 1]
        if not on and not before:
            whole.append(((x + px) / 2, (y + py) / 2, True))
        whole.append((x, y, on))
    first = next(k for k, p in enumerate(whole) if p[2])
    whole = whole[first:] + whole[: first + 1]
    at = whole[0][:2]
    path: Path = [("M", at)]
    k = 1
    while k < len(whole):
        x, y, on = whole[k]
        if on:
            at = (x, y)
            path.append(("L", at))
            k += 1
            continue
        end = whole[k + 1][:2]
        path.append(("C", *((p[0] + 2 / 3 * (x - p[0]), p[1] + 2 / 3 * (y - p[1])) for p in (at, end)), end))
        at = end
        k += 2
    return path


def subset(font: TrueType, glyphs: set[int]) -> bytes:
    """The file with outlines of some glyphs only; their numbers stay."""
    source = Glyf(font)
    kept, body, places = source.needed(glyphs), b"", []
    for g in range(font.glyphs):
        places.append(len(body))
        if g in kept:
            own = source.data(g)
            body += own + bytes(-len(own) % 4)
    places.append(len(body))
    tables = {t: font.tables[t] for t in ("OS/2", "cmap", "cvt ", "fpgm", "head", "hhea", "hmtx", "maxp", "name", "post", "prep") if t in font.tables}
    head = bytearray(tables["head"])
    head[8:12], head[50:52] = bytes(4), struct.pack(">h", 1)
    tables |= {"head": bytes(head), "glyf": body, "loca": struct.pack(f">{len(places)}I", *places)}
    n = len(tables)
    span = 1 << (n.bit_length() - 1)
    out = struct.pack(">IHHHH", 0x00010000, n, 16 * span, span.bit_length() - 1, 16 * (n - span))
    at, rows, data = 12 + 16 * n, b"", b""
    for tag, own in sorted(tables.items()):
        padded = own + bytes(-len(own) % 4)
        total = sum(struct.unpack(f">{len(padded) // 4}I", padded)) & 0xFFFFFFFF
        rows += tag.encode() + struct.pack(">III", total, at + len(data), len(own))
        data += padded
    return out + rows + data


# --- CFF ---


def _index(data: bytes, at: int) -> tuple[list[bytes], int]:
    n = struct.unpack(">H", data[at : at + 2])[0]
    if not n:
        return [], at + 2
    size = data[at + 2]
    offsets = [int.from_bytes(data[at + 3 + size * k : at + 3 + size * (k + 1)]) for k in range(n + 1)]
    base = at + 2 + size * (n + 1)
    return [data[base + a : base + b] for a, b in zip(offsets, offsets[1:])], base + offsets[-1]


def _dict(data: bytes) -> dict[int, list[float]]:
    """Operands by operator; two-byte operators are 1200 and on."""
    out, held, at = {}, [], 0
    while at < len(data):
        b = data[at]
        at += 1
        if b <= 21:
            if b == 12:
                b, at = 1200 + data[at], at + 1
            out[b], held = held, []
        elif b == 28:
            held.append(struct.unpack(">h", data[at : at + 2])[0])
            at += 2
        elif b == 29:
            held.append(struct.unpack(">i", data[at : at + 4])[0])
            at += 4
        elif b == 30:
            text = ""
            while True:
                pair = data[at]
                at += 1
                text += "".join("0123456789.EF -X"[n] for n in (pair >> 4, pair & 15))
                if pair & 15 == 15 or pair >> 4 == 15:
                    break
            text = text.split("X")[0].replace("F", "E-").replace(" ", "")
            held.append(float(text) if text else 0.0)
        elif 32 <= b <= 246:
            held.append(b - 139)
        elif 247 <= b <= 254:
            high = b <= 250
            held.append((b - 247) * 256 + data[at] + 108 if high else -(b - 251) * 256 - data[at] - 108)
            at += 1
    return out


class Cff:
    """Glyphs of a CFF program. The first 95 printable glyphs' numbers of names follow ASCII, which is all of the standard names that is used."""

    def __init__(self, data: bytes):
        at = data[2]
        _, at = _index(data, at)
        tops, at = _index(data, at)
        self.strings, at = _index(data, at)
        self.globals, _ = _index(data, at)
        if not tops:
            raise PdfError("a font without outlines")
        top = _dict(tops[0])
        self.glyphs, _ = _index(data, int(top[17][0]))
        matrix = top.get(1207) or [0.001, 0, 0, 0.001, 0, 0]
        self.scale = matrix[0] or 0.001
        self.is_cid = 1230 in top
        self.names = self._charset(data, int((top.get(15) or [0])[0]))
        self.place = {name: g for g, name in enumerate(self.names)}
        self.encoding = self._encoding(data, int((top.get(16) or [0])[0]))
        privates = [top]
        self.choice: list[int] = []
        if self.is_cid:
            fonts, _ = _index(data, int(top[1236][0]))
            privates = [_dict(f) for f in fonts]
            self.choice = self._select(data, int(top[1237][0]))
        self.locals = []
        for p in privates:
            size, start = (int(v) for v in p.get(18) or (0, 0))
            private = _dict(data[start : start + size])
            self.locals.append(_index(data, start + int(private[19][0]))[0] if 19 in private else [])

    def _charset(self, data: bytes, at: int) -> list[int]:
        """The number of each glyph's name, or its CID."""
        n = len(self.glyphs)
        if at <= 2:
            return list(range(n))
        kind, out = data[at], [0]
        at += 1
        while len(out) < n:
            first = struct.unpack(">H", data[at : at + 2])[0]
            at += 2
            if not kind:
                out.append(first)
                continue
            left = data[at] if kind == 1 else struct.unpack(">H", data[at : at + 2])[0]
            at += kind
            out += range(first, first + left + 1)
        return out[:n]

    def _encoding(self, data: bytes, at: int) -> dict[int, int]:
        """Codes to glyphs of the program's own encoding."""
        if at <= 1:
            return {c: self.place[c - 31] for c in range(32, 127) if c - 31 in self.place}
        kind, n, out, g = data[at] & 127, data[at + 1], {}, 1
        at += 2
        for _ in range(n):
            first, left = data[at], data[at + 1] if kind else 0
            at += 1 + bool(kind)
            for c in range(first, first + left + 1):
                out[c], g = g, g + 1
        return out

    def _select(self, data: bytes, at: int) -> list[int]:
        n = len(self.glyphs)
        if not data[at]:
            return list(data[at + 1 : at + 1 + n])
        ranges = struct.unpack(">H", data[at + 1 : at + 3])[0]
        starts = [struct.unpack(">HB", data[at + 3 + 3 * k : at + 6 + 3 * k]) for k in range(ranges)]
        last = struct.unpack(">H", data[at + 3 + 3 * ranges : at + 5 + 3 * ranges])[0]
        return [f for (a, f), b in zip(starts, [*(s for s, _ in starts[1:]), last]) for _ in range(b - a)]

    def by_name(self, name: str) -> int | None:
        """A glyph by its name, from the program's own names and printable ASCII."""
        for k, s in enumerate(self.strings):
            if s.decode("latin-1") == name and 391 + k in self.place:
                return self.place[391 + k]
        return self.place.get(ord(name) - 31) if len(name) == 1 and 32 <= ord(name) < 127 else None

    def outline(self, glyph: int) -> list[Path]:
        if not 0 <= glyph < len(self.glyphs):
            return []
        which = self.choice[glyph] if glyph < len(self.choice) else 0
        run = _Charstring(self.globals, self.locals[which] if which < len(self.locals) else [])
        run.run(self.glyphs[glyph], _DEEP)
        s = self.scale
        return [[(x[0], *((p[0] * s, p[1] * s) for p in x[1:])) for x in path] for path in run.paths if len(path) > 1]


class _Charstring:
    def __init__(self, globals_: list[bytes], locals_: list[bytes]):
        self.subs = {29: globals_, 10: locals_}
        self.paths: list[Path] = []
        self.x = self.y = 0.0
        self.stack: list[float] = []
        self.stems = 0

    def move(self, dx: float, dy: float) -> None:
        self.x, self.y = self.x + dx, self.y + dy
        self.paths.append([("M", (self.x, self.y))])

    def line(self, dx: float, dy: float) -> None:
        self.x, self.y = self.x + dx, self.y + dy
        if self.paths:
            self.paths[-1].append(("L", (self.x, self.y)))

    def curve(self, *d: float) -> None:
        points, x, y = [], self.x, self.y
        for k in (0, 2, 4):
            x, y = x + d[k], y + d[k + 1]
            points.append((x, y))
        self.x, self.y = x, y
        if self.paths:
            self.paths[-1].append(("C", *points))

    def run(self, data: bytes, deep: int) -> bool:
        """Whether the glyph has ended."""
        at = 0
        while at < len(data):
            b = data[at]
            at += 1
            if b == 28:
                self.stack.append(struct.unpack(">h", data[at : at + 2])[0])
                at += 2
            elif b == 255:
                self.stack.append(struct.unpack(">i", data[at : at + 4])[0] / 65536)
                at += 4
            elif b >= 32:
                if b <= 246:
                    self.stack.append(b - 139)
                else:
                    self.stack.append((b - 247) * 256 + data[at] + 108 if b <= 250 else -(b - 251) * 256 - data[at] - 108)
                    at += 1
            elif b in (10, 29):
                subs = self.subs[b]
                k = int(self.stack.pop()) + (107 if len(subs) < 1240 else 1131 if len(subs) < 33900 else 32768)
                if deep and 0 <= k < len(subs) and self.run(subs[k], deep - 1):
                    return True
            elif b == 11:
                return False
            elif b == 14:
                return True
            elif b in (1, 3, 18, 23, 19, 20):
                self.stems += len(self.stack) // 2
                self.stack = []
                at += (self.stems + 7) // 8 if b in (19, 20) else 0
            else:
                if b == 12:
                    b, at = 1200 + data[at], at + 1
                self.draw(b, self.stack)
                self.stack = []
        return False

    def draw(self, op: int, s: list[float]) -> None:
        if op == 21 and len(s) >= 2:
            self.move(*s[-2:])
        elif op == 22 and s:
            self.move(s[-1], 0)
        elif op == 4 and s:
            self.move(0, s[-1])
        elif op == 5:
            for k in range(0, len(s) - 1, 2):
                self.line(s[k], s[k + 1])
        elif op in (6, 7):
            for k, v in enumerate(s):
                self.line(*((v, 0) if (k % 2 == 0) == (op == 6) else (0, v)))
        elif op in (8, 24):
            n = len(s) // 6 * 6 if op == 8 else (len(s) - 2) // 6 * 6
            for k in range(0, n, 6):
                self.curve(*s[k : k + 6])
            if op == 24:
                self.line(*s[n : n + 2])
        elif op == 25:
            n = len(s) - 6
            for k in range(0, n - 1, 2):
                self.line(s[k], s[k + 1])
            self.curve(*s[n:])
        elif op in (26, 27):
            first = s.pop(0) if len(s) % 4 else 0
            for k in range(0, len(s) - 3, 4):
                a, b, c, d = s[k : k + 4]
                self.curve(*((first, a, b, c, 0, d) if op == 26 else (a, first, b, c, d, 0)))
                first = 0
        elif op in (30, 31):
            flat = op == 31
            for k in range(0, len(s) - 3, 4):
                a, b, c, d = s[k : k + 4]
                last = s[k + 4] if len(s) - k == 5 else 0
                self.curve(*((a, 0, b, c, last, d) if flat else (0, a, b, c, d, last)))
                flat = not flat
        elif op == 1235 and len(s) >= 12:
            self.curve(*s[:6])
            self.curve(*s[6:12])
        elif op == 1234 and len(s) >= 7:
            self.curve(s[0], 0, s[1], s[2], s[3], 0)
            self.curve(s[4], 0, s[5], -s[2], s[6], 0)
        elif op == 1236 and len(s) >= 9:
            self.curve(s[0], s[1], s[2], s[3], s[4], 0)
            self.curve(s[5], 0, s[6], s[7], s[8], -(s[1] + s[3] + s[7]))
        elif op == 1237 and len(s) >= 11:
            dx, dy = s[0] + s[2] + s[4] + s[6] + s[8], s[1] + s[3] + s[5] + s[7] + s[9]
            self.curve(*s[:6])
            self.curve(*s[6:10], *((s[10], -dy) if abs(dx) > abs(dy) else (-dx, s[10])))


# --- codes to outlines ---


class Program:
    """The embedded program of a font resource: the outline of a code, or None without one."""

    def __init__(self, doc, font, d: dict):
        self.font, self.known = font, {}
        descriptor = doc.get(d, "FontDescriptor", dict)
        self.to_gid = None
        if font.two_bytes:
            kids = doc.get(d, "DescendantFonts", list) or [None]
            descriptor = doc.get(kids[0], "FontDescriptor", dict)
            mapping = doc.get(kids[0], "CIDToGIDMap")
            self.to_gid = doc.decoded(mapping) if isinstance(mapping, Stream) else None
        self.source = None
        for key in ("FontFile2", "FontFile3"):
            s = doc.get(descriptor or {}, key)
            if isinstance(s, Stream):
                data = doc.decoded(s)
                if data[:1] == b"\x01" and data[:4] != b"\0\1\0\0":
                    self.source, self.true = Cff(data), None
                else:
                    self.true = TrueType(data)
                    self.source = Cff(self.true.tables["CFF "]) if "CFF " in self.true.tables else Glyf(self.true)
                return

    def glyph(self, code: int) -> int | None:
        if self.font.two_bytes:
            if self.to_gid is not None:
                return int.from_bytes(self.to_gid[2 * code : 2 * code + 2])
            return self.source.place.get(code) if isinstance(self.source, Cff) and self.source.is_cid else code
        if isinstance(self.source, Cff) and self.true is None:
            name = self.font.names.get(code)
            found = self.source.by_name(name) if name else None
            return found if found is not None else self.source.encoding.get(code)
        chars = self.true.chars
        text = self.font.text(code)
        return next((chars[c] for c in (ord(text) if len(text) == 1 else -1, 0xF000 + code, code) if c in chars), None)

    def outline(self, code: int) -> list[Path] | None:
        if self.source is None:
            return None
        if code not in self.known:
            g = self.glyph(code)
            self.known[code] = self.source.outline(g) if g is not None else []
        return self.known[code]


def program_of(doc, font, d: dict) -> Program | None:
    """The program of a font; None if there is none that can be read."""
    try:
        found = Program(doc, font, d)
    except (PdfError, struct.error, IndexError, KeyError, ValueError):
        return None
    return found if found.source is not None else None
