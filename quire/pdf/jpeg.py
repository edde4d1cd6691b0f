"""JPEG: baseline and progressive images to pixels, and pixels to baseline images (ITU-T T.81).

Coefficients of all blocks are gathered first; dequantisation, the inverse
transform and colour conversion then run over whole arrays.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

from quire.pdf.syntax import PdfError

#: Quantisation of quality 50 for brightness and colour (T.81, annex K), row by row.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
#: Places of the coefficients along the diagonals: every diagonal the other way.
ZIGZAG = np.array([8 * i + j for i, j in sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
_K = np.arange(8)
#: The transform's matrix: rows are frequencies.
COSINES = np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)
MOST_PIXELS = 1 << 28


class _Bits:
    """Bits of one stretch of coded data; zeros follow its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def need(self, k: int) -> None:
        while self.n < k:
            own = self.data[self.at : self.at + 8]
            self.at += 8
            self.held = (self.held << 64) | int.from_bytes(own + bytes(8 - len(own)))
            self.n += 64
            if self.at > len(self.data) + 4096:
                raise PdfError("the JPEG data end too early")

    def take(self, k: int) -> int:
        if not k:
            return 0
        self.need(k)
        self.n -= k
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out

    def symbol(self, table: list[int]) -> int:
        self.need(16)
        found = table[(self.held >> (self.n - 16)) & 0xFFFF]
        if not found:
            raise PdfError("bad JPEG code")
        self.take(found >> 8)
        return found & 255

    def value(self, size: int) -> int:
        """A signed number of so many bits."""
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(length, code, symbol) of a canonical table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out.append((length, code, s))
            code += 1
        at, code = at + n, code << 1
    return out


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For any 16 bits the length and symbol of the code that they begin with."""
    table = [0] * 65536
    for length, code, s in _codes(counts, symbols):
        first = code << (16 - length)
        table[first : first + (1 << (16 - length))] = [length << 8 | s] * (1 << (16 - length))
    return table[:65536]


class _Component:
    def __init__(self, key: int, h: int, v: int, quant: int):
        self.key, self.h, self.v, self.quant = key, h, v, quant


class _Decoder:
    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], list[int]] = {}
        self.parts: list[_Component] = []
        self.restart, self.transform = 0, None
        self._read(data)

    def _read(self, data: bytes) -> None:
        at = data.find(b"\xff\xd8")
        if at < 0:
            raise PdfError("not a JPEG")
        at += 2
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 2 > len(data):
                break
            kind = data[at + 1]
            at += 2
            if kind == 0xD9:
                break
            if kind in (0, 0xFF, 1) or 0xD0 <= kind <= 0xD8:
                at -= kind == 0xFF
                continue
            size = int.from_bytes(data[at : at + 2])
            body, at = data[at + 2 : at + size], at + max(size, 2)
            if kind == 0xDB:
                self._quantisation(body)
            elif kind == 0xC4:
                self._huffman(body)
            elif kind in (0xC0, 0xC1, 0xC2):
                self._frame(body, kind == 0xC2)
            elif 0xC3 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
                raise PdfError("this kind of JPEG is not read")
            elif kind == 0xDD:
                self.restart = int.from_bytes(body[:2])
            elif kind == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.transform = body[11]
            elif kind == 0xDA:
                end = at
                while True:
                    end = data.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(data):
                        end = len(data)
                        break
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                        continue
                    break
                self._scan(body, data[at:end])
                at = end
        if not self.parts:
            raise PdfError("a JPEG without an image")

    def _quantisation(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, key = body[at] >> 4, body[at] & 15
            n = 128 if wide else 64
            own = np.frombuffer(body[at + 1 : at + 1 + n], ">u2" if wide else np.uint8)
            if len(own) < 64:
                raise PdfError("bad JPEG quantisation")
            table = np.zeros(64)
            table[ZIGZAG] = own
            self.quant[key] = table
            at += 1 + n

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at + 17 <= len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            self.tables[body[at] >> 4, body[at] & 15] = _lookup(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _frame(self, body: bytes, progressive: bool) -> None:
        bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if bits != 8 or not self.height or not self.width or self.height * self.width > MOST_PIXELS or len(body) < 6 + 3 * n or n not in (1, 3, 4):
            raise PdfError("this kind of JPEG is not read")
        self.progressive = progressive
        self.parts = [_Component(body[k], max(1, body[k + 1] >> 4), max(1, body[k + 1] & 15), body[k + 2]) for k in range(6, 6 + 3 * n, 3)]
        self.h, self.v = max(p.h for p in self.parts), max(p.v for p in self.parts)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for p in self.parts:
            p.wide, p.high = -(-self.width * p.h // (8 * self.h)), -(-self.height * p.v // (8 * self.v))
            p.blocks = [[0] * 64 for _ in range(self.across * p.h * self.down * p.v)]
            p.stride = self.across * p.h

    def _scan(self, body: bytes, coded: bytes) -> None:
        n = body[0]
        own = []
        for k in range(n):
            part = next((p for p in self.parts if p.key == body[1 + 2 * k]), None)
            if part is None:
                raise PdfError("bad JPEG scan")
            own.append((part, body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15))
        first, last, bits = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
        high, low = bits >> 4, bits & 15
        if n == 1:
            p = own[0][0]
            order = [[(0, y * p.stride + x)] for y in range(p.high) for x in range(p.wide)]
        else:
            order = [
                [(k, (my * p.v + y) * p.stride + mx * p.h + x) for k, (p, _, _) in enumerate(own) for y in range(p.v) for x in range(p.h)]
                for my in range(self.down) for mx in range(self.across)
            ]
        stretches = _stretches(coded)
        step = self.restart or len(order)
        for number, at in enumerate(range(0, len(order), step)):
            if number >= len(stretches):
                break
            reader, before, run = _Bits(stretches[number]), [0] * n, [0]
            for unit in order[at : at + step]:
                for k, place in unit:
                    p, dc, ac = own[k]
                    block = p.blocks[place]
                    if not self.progressive:
                        before[k] = self._baseline(reader, block, before[k], dc, ac)
                    elif first == 0:
                        before[k] = self._direct(reader, block, before[k], dc, high, low)
                    elif high == 0:
                        self._first(reader, block, self._table(1, ac), first, last, low, run)
                    else:
                        self._refine(reader, block, self._table(1, ac), first, last, 1 << low, run)

    def _table(self, kind: int, key: int) -> list[int]:
        if (kind, key) not in self.tables:
            raise PdfError("a JPEG table is missing")
        return self.tables[kind, key]

    def _baseline(self, reader, block, before, dc, ac) -> int:
        before += reader.value(reader.symbol(self._table(0, dc)))
        block[0] = before
        table, k = self._table(1, ac), 1
        while k < 64:
            s = reader.symbol(table)
            if not s & 15:
                if s != 0xF0:
                    break
                k += 16
                continue
            k += s >> 4
            if k > 63:
                raise PdfError("bad JPEG block")
            block[k] = reader.value(s & 15)
            k += 1
        return before

    def _direct(self, reader, block, before, dc, high, low) -> int:
        if high:
            block[0] |= reader.take(1) << low
            return before
        before += reader.value(reader.symbol(self._table(0, dc)))
        block[0] = before << low
        return before

    def _first(self, reader, block, table, first, last, low, run) -> None:
        if run[0]:
            run[0] -= 1
            return
        k = first
        while k <= last:
            s = reader.symbol(table)
            zeros, size = s >> 4, s & 15
            if not size:
                if zeros < 15:
                    run[0] = (1 << zeros) + reader.take(zeros) - 1
                    return
                k += 16
                continue
            k += zeros
            if k > 63:
                raise PdfError("bad JPEG block")
            block[k] = reader.value(size) * (1 << low)
            k += 1

    def _refine(self, reader, block, table, first, last, bit, run) -> None:
        def correct(k):
            if reader.take(1) and not abs(block[k]) & bit:
                block[k] += bit if block[k] > 0 else -bit

        k = first
        if not run[0]:
            while k <= last:
                s = reader.symbol(table)
                zeros, new = s >> 4, 0
                if s & 15:
                    new = bit if reader.take(1) else -bit
                elif zeros < 15:
                    run[0] = (1 << zeros) + reader.take(zeros)
                    break
                while k <= last:
                    if block[k]:
                        correct(k)
                    elif zeros:
                        zeros -= 1
                    else:
                        break
                    k += 1
                if new and k <= last:
                    block[k] = new
                k += 1
        if run[0]:
            run[0] -= 1
            while k <= last:
                if block[k]:
                    correct(k)
                k += 1

    def planes(self) -> list[np.ndarray]:
        """Each component's samples at the image's size."""
        out = []
        for p in self.parts:
            if p.quant not in self.quant:
                raise PdfError("a JPEG table is missing")
            flat = np.zeros((len(p.blocks), 64))
            flat[:, ZIGZAG] = np.array(p.blocks, float)
            flat *= self.quant[p.quant]
            square = COSINES.T @ flat.reshape(-1, 8, 8) @ COSINES
            rows = len(p.blocks) // p.stride
            plane = square.reshape(rows, p.stride, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, p.stride * 8)
            plane = np.clip(np.round(plane + 128), 0, 255)
            y, x = np.arange(self.height) * p.v // self.v, np.arange(self.width) * p.h // self.h
            out.append(plane[y][:, x])
        return out


def _stretches(coded: bytes) -> list[bytes]:
    """Coded data between restart markers, without the stuffing."""
    parts, at, start = [], 0, 0
    while True:
        at = coded.find(b"\xff", at)
        if at < 0 or at + 1 >= len(coded):
            parts.append(coded[start:])
            break
        if 0xD0 <= coded[at + 1] <= 0xD7:
            parts.append(coded[start:at])
            start = at + 2
        at += 2
    return [p.replace(b"\xff\x00", b"\xff") for p in parts]


def decode(data: bytes, transform: int | None = None) -> np.ndarray:
    """Pixels (height, width, 1, 3 or 4): gray, RGB or CMYK. transform: whether colours are coded as brightness and differences, if neither the file nor 3 components say."""
    d = _Decoder(data)
    planes = d.planes()
    turned = d.transform if d.transform is not None else transform if transform is not None else int(len(planes) == 3 and [p.key for p in d.parts] != [82, 71, 66])
    if len(planes) >= 3 and turned:
        y, b, r = planes[0], planes[1] - 128, planes[2] - 128
        planes[:3] = y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b
    out = np.clip(np.round(np.stack(planes, 2)), 0, 255).astype(np.uint8)
    return 255 - out if len(planes) == 4 and d.transform is not None else out


# --- writing ---


def quantisation(quality: int) -> tuple[np.ndarray, np.ndarray]:
    """Both tables for a quality from 1 to 100."""
    quality = min(100, max(1, quality))
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return tuple(np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMINANCE, CHROMINANCE))


def _blocks(plane: np.ndarray, quant: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Quantised coefficients in zigzag order of so many rows and columns of blocks: (rows, columns, 64)."""
    h, w = plane.shape
    padded = np.pad(plane, ((0, 8 * high - h), (0, 8 * wide - w)), mode="edge") - 128.0
    square = padded.reshape(high, 8, wide, 8).transpose(0, 2, 1, 3)
    out = (COSINES @ square @ COSINES.T).reshape(high, wide, 64)
    return np.round(out / quant).astype(int)[:, :, ZIGZAG]


def _symbols(block: list[int], before: int) -> list[tuple[int, int, int, int]]:
    """(table, symbol, value bits, their number) of a block."""
    def bits(v):
        size = abs(v).bit_length()
        return size, v if v >= 0 else v + (1 << size) - 1

    size, value = bits(block[0] - before)
    out, zeros = [(0, size, value, size)], 0
    last = max((k for k in range(1, 64) if block[k]), default=0)
    for k in range(1, last + 1):
        if not block[k]:
            zeros += 1
            continue
        out += [(1, 0xF0, 0, 0)] * (zeros // 16)
        size, value = bits(block[k])
        out.append((1, (zeros % 16) << 4 | size, value, size))
        zeros = 0
    if last < 63:
        out.append((1, 0, 0, 0))
    return out


def _best_table(counts: dict[int, int]) -> tuple[bytes, bytes]:
    """A code of at most 16 bits by how often symbols occur; no code is all ones."""
    heap = [(n, k, [s]) for k, (s, n) in enumerate(sorted(counts.items()))] + [(0, -1, [-1])]
    heapq.heapify(heap)
    depth = dict.fromkeys([*counts, -1], 0)
    number = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], number, a[2] + b[2]))
        number += 1
    at = [0] * 64
    for d in depth.values():
        at[d] += 1
    for d in range(63, 16, -1):  # codes that are too long move up in pairs
        while at[d]:
            shorter = next(k for k in range(d - 2, 0, -1) if at[k])
            at[d] -= 2
            at[d - 1] += 1
            at[shorter + 1] += 2
            at[shorter] -= 1
    longest = max(k for k in range(17) if at[k])
    at[longest] -= 1  # the code that is kept free
    order = sorted(counts, key=lambda s: (depth[s], s))
    return bytes(at[1:17]), bytes(order)


def encode(pixels: np.ndarray, quality: int = 75) -> bytes:
    """A baseline JPEG of gray (height, width) or RGB pixels; colours at half the size."""
    h, w = pixels.shape[:2]
    quants = quantisation(quality)
    if pixels.ndim == 3 and pixels.shape[2] == 3:
        r, g, b = (pixels[:, :, k].astype(float) for k in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        high, wide = -(-h // 16), -(-w // 16)
        small = []
        for c in ((b - y) / 1.772 + 128, (r - y) / 1.402 + 128):
            c = np.pad(c, ((0, h % 2), (0, w % 2)), mode="edge")
            small.append((c[::2, ::2] + c[1::2, ::2] + c[::2, 1::2] + c[1::2, 1::2]) / 4)
        planes = [_blocks(y, quants[0], 2 * high, 2 * wide), *(_blocks(c, quants[1], high, wide) for c in small)]
        places = [[(0, 2 * i + a, 2 * j + c) for a in (0, 1) for c in (0, 1)] + [(1, i, j), (2, i, j)] for i in range(high) for j in range(wide)]
        shape = [(1, 0x22, 0), (2, 0x11, 1), (3, 0x11, 1)]
    else:
        high, wide = -(-h // 8), -(-w // 8)
        planes = [_blocks(pixels.reshape(h, w).astype(float), quants[0], high, wide)]
        places = [[(0, i, j)] for i in range(high) for j in range(wide)]
        shape = [(1, 0x11, 0)]
    lists, before, coded = [p.tolist() for p in planes], [0, 0, 0], []
    counts: dict[tuple[int, int], dict[int, int]] = {}
    for unit in places:
        for k, i, j in unit:
            block = lists[k][i][j]
            for table, symbol, value, size in _symbols(block, before[k]):
                key = table, min(k, 1)
                own = counts.setdefault(key, {})
                own[symbol] = own.get(symbol, 0) + 1
                coded.append((key, symbol, value, size))
            before[k] = block[0]
    tables = {key: _best_table(own) for key, own in counts.items()}
    codes = {key: {s: (code, length) for length, code, s in _codes(*t)} for key, t in tables.items()}
    held, n, out = 0, 0, bytearray()
    for key, symbol, value, size in coded:
        code, length = codes[key][symbol]
        held, n = (held << length | code) << size | value, n + length + size
        while n >= 8:
            byte = held >> (n - 8)
            out.append(byte)
            if byte == 0xFF:
                out.append(0)
            n -= 8
            held &= (1 << n) - 1
    if n:
        byte = (held << (8 - n) | (1 << (8 - n)) - 1) & 255
        out += bytes([byte, 0] if byte == 0xFF else [byte])
    part = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    head = b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for key in range(2 if len(shape) > 1 else 1):
        head += part(0xDB, bytes([key]) + bytes(quants[key][ZIGZAG].tolist()))
    head += part(0xC0, struct.pack(">BHHB", 8, h, w, len(shape)) + b"".join(bytes(s) for s in shape))
    for (table, key), (lengths, symbols) in sorted(tables.items()):
        head += part(0xC4, bytes([table << 4 | key]) + lengths + symbols)
    return head + part(0xDA, bytes([len(shape)]) + b"".join(bytes([s[0], 0x11 * s[2]]) for s in shape) + b"\0\x3f\0") + bytes(out) + b"\xff\xd9"
