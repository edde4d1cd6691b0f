"""JPEG both ways, and images in files that are made smaller."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.pdf import jpeg, render, structure, writer
from quire.pdf.document import Document
from quire.pdf.syntax import PdfError


def picture(h: int, w: int) -> np.ndarray:
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([128 + 100 * np.sin(x / 20), 128 + 80 * np.cos(y / 15), 60 + (x + y) / 3.0], 2).clip(0, 255).astype(np.uint8)


def test_the_order_of_coefficients():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG[-3:].tolist() == [55, 62, 63]
    assert np.allclose(jpeg.COSINES @ jpeg.COSINES.T, np.eye(8))


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(60, 100), st.booleans())
def test_round_trip(h, w, quality, gray):
    pixels = picture(h, w)
    pixels = pixels[:, :, 0] if gray else pixels
    got = jpeg.decode(jpeg.encode(pixels, quality))
    assert got.shape == (h, w, 1 if gray else 3)
    assert np.abs(got.astype(int) - pixels.reshape(got.shape)).mean() < 9


def test_quality_and_size():
    pixels = picture(120, 160)
    sizes = [len(jpeg.encode(pixels, q)) for q in (30, 60, 90)]
    errors = [np.abs(jpeg.decode(jpeg.encode(pixels, q)).astype(int) - pixels).mean() for q in (30, 60, 90)]
    assert sizes == sorted(sizes) and errors == sorted(errors, reverse=True) and errors[-1] < 1.5


def progressive(pixels: np.ndarray, quality: int) -> bytes:
    """A gray progressive image: the first coefficients in two steps, the others in two bands, with runs of empty blocks."""
    h, w = pixels.shape
    high, wide = -(-h // 8), -(-w // 8)
    quant = jpeg.quantisation(quality)[0]
    blocks = jpeg._blocks(pixels.astype(float), quant, high, wide).reshape(-1, 64).tolist()
    part = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + part(0xDB, b"\0" + bytes(quant[jpeg.ZIGZAG].tolist())) + part(0xC2, struct.pack(">BHHB", 8, h, w, 1) + bytes([1, 0x11, 0]))

    def packed(items, kind):
        counts = {}
        for symbol, *_ in items:
            if symbol is not None:
                counts[symbol] = counts.get(symbol, 0) + 1
        table = jpeg._best_table(counts) if counts else None
        codes = {s: (code, n) for n, code, s in jpeg._codes(*table)} if table else {}
        bits = "".join((format(codes[s][0], f"0{codes[s][1]}b") if s is not None else "") + (format(v, f"0{n}b") if n else "") for s, v, n in items)
        bits += "1" * (-len(bits) % 8)
        data = int(bits, 2).to_bytes(len(bits) // 8) if bits else b""
        head = part(0xC4, bytes([kind << 4]) + table[0] + table[1]) if table else b""
        return head, data.replace(b"\xff", b"\xff\0")

    def value(v):
        n = abs(v).bit_length()
        return n, v if v >= 0 else v + (1 << n) - 1

    def scan(head, first, last, bits, data):
        return head + part(0xDA, bytes([1, 1, 0, first, last, bits])) + data

    items, before = [], 0
    for b in blocks:
        n, v = value((b[0] >> 1) - before)
        items.append((n, v, n))
        before = b[0] >> 1
    head, data = packed(items, 0)
    out += scan(head, 0, 0, 0x01, data)
    _, data = packed([(None, b[0] & 1, 1) for b in blocks], 0)
    out += scan(b"", 0, 0, 0x10, data)
    for first, last in ((1, 5), (6, 63)):
        items, empty = [], 0

        def flush():
            nonlocal empty
            while empty:
                n = min(empty, 32767).bit_length() - 1
                take = min(empty, (1 << (n + 1)) - 1)
                items.append((n << 4, take - (1 << n), n))
                empty -= take

        for b in blocks:
            zeros = 0
            top = max((k for k in range(first, last + 1) if b[k]), default=-1)
            if top >= 0:
                flush()
            for k in range(first, top + 1):
                if not b[k]:
                    zeros += 1
                    continue
                items += [(0xF0, 0, 0)] * (zeros // 16)
                n, v = value(b[k])
                items.append(((zeros % 16) << 4 | n, v, n))
                zeros = 0
            if top < last:
                empty += 1
        flush()
        head, data = packed(items, 1)
        out += scan(head, first, last, 0, data)
    return out + b"\xff\xd9"


def test_progressive_images_are_the_baseline_ones():
    pixels = picture(61, 83)[:, :, 1]
    assert (jpeg.decode(progressive(pixels, 80)) == jpeg.decode(jpeg.encode(pixels, 80))).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10_000), st.integers(0, 255)), min_size=1, max_size=4), st.integers(0, 2000))
def test_damage_is_an_error(changes, cut):
    data = bytearray(jpeg.encode(picture(24, 24), 70))
    for at, byte in changes:
        data[at % len(data)] = byte
    try:
        jpeg.decode(bytes(data[: max(4, len(data) - cut % len(data))]))
    except (PdfError, IndexError, ValueError, struct.error):
        pass


def with_image(pixels: np.ndarray, coded, size: float) -> bytes:
    b = writer.Builder()
    b.page(writer.PageBuilder().image("I", coded(pixels), 72, 72, size, size))
    return b.build()


def raw(p):
    return writer.rgb_image(p.shape[1], p.shape[0], p.tobytes())


def test_images_are_coded_again():
    noise = np.random.default_rng(0).integers(-12, 13, (300, 300, 3))
    pixels = (picture(300, 300) + noise).clip(0, 255).astype(np.uint8)
    data = with_image(pixels, raw, 72)  # an inch: 300 dots per inch
    sizes = {}
    for preset, dots in (("low", 300), ("medium", 300), ("high", 150), ("extreme", 96)):
        small, stats = writer.compress(data, preset)
        (image,) = structure.images(Document(small))
        assert (image["width"], image["height"]) == (dots, dots) and stats["images_downscaled"] == (dots < 300)
        assert image["filter"] == ("FlateDecode" if preset == "low" else "DCTDecode")
        sizes[preset] = len(small)
    assert sizes["extreme"] < sizes["high"] < sizes["medium"] < sizes["low"] <= len(data) and sizes["extreme"] < 0.563 * len(data)
    again, stats = writer.compress(with_image(pixels, lambda p: writer.jpeg_image(jpeg.encode(p, 95)), 72), "medium")
    assert stats["images_recompressed"] == 1
    doc = Document(again)
    got = render.image_pixels(doc, next(v for r in doc.refs() if getattr(v := doc.resolve(r), "dict", {}).get("Subtype") == "Image"))
    assert got.shape == (300, 300, 3) and np.abs(got.astype(int) - pixels).mean() < 12


def test_images_that_stay():
    tiny = with_image(picture(20, 20), raw, 72)
    _, stats = writer.compress(tiny, "medium")
    assert stats["images_recompressed"] == 0 and stats["images_skipped"] == 1
    assert writer.target_size(1440, 720, (72, 36), 150) == (150, 75) and writer.target_size(100, 100, (72, 72), 150) == (100, 100)
    assert writer.target_size(4200, 100, None, 150) == (2100, 50) and writer.target_size(9, 9, None, None) == (9, 9)


def test_pictures_are_drawn():
    page = with_image(np.full((16, 16, 3), (200, 30, 60), np.uint8), lambda p: writer.jpeg_image(jpeg.encode(p, 95)), 100)
    doc = Document(page)
    drawn = render.to_pixels(doc, doc.pages()[0])
    assert np.abs(drawn[792 - 100, 100].astype(int) - (200, 30, 60)).max() < 6
    with pytest.raises(PdfError):
        jpeg.decode(b"no picture at all")
