"""Functions, draw commands, pictures, skew, text flow, writing direction, streams and plans."""

from __future__ import annotations

import numpy as np
import pytest

from quire.pdf import render, textflow, writer
from quire.pdf.document import Document
from quire.pdf.functions import Function, execute, parse_program
from quire.pdf.syntax import Name, PdfError, Stream
from quire.plans import text as plans
from quire.sources import render as render_source
from quire.streaming import files as streams


class Plain:
    """Resolves nothing: objects are direct."""

    resolve = staticmethod(lambda x: x)
    decoded = staticmethod(lambda s: s.raw)

    @staticmethod
    def get(d, key, kind=None):
        d = d.dict if isinstance(d, Stream) else d
        x = d.get(key) if isinstance(d, dict) else None
        return x if kind is None or isinstance(x, kind) else None


def run(program: bytes, *stack):
    s = list(stack)
    execute(parse_program(program), s)
    return s


def test_calculator():
    assert run(b"{add 2 mul}", 3, 4) == [14] and run(b"{dup mul exch pop}", 9, 3) == [9]
    assert run(b"{2 copy gt {exch} if pop}", 5, 2) == [2] and run(b"{0 lt {neg} {1 add} ifelse}", 7, -1) == [-7]
    assert run(b"{3 1 roll}", 1, 2, 3) == [3, 1, 2] and run(b"{3 -1 roll}", 1, 2, 3) == [2, 3, 1] and run(b"{1 index}", 8, 9) == [8, 9, 8]
    assert run(b"{90 sin 7 2 idiv 7 2 mod 1 3 bitshift true not}") == [pytest.approx(1), 3, 1, 8, False]
    for bad in (b"add", b"{add", b"{nonsense}", b"{ {1} }"):
        with pytest.raises(PdfError):
            run(bad, 1, 2)


def test_functions():
    power = {"FunctionType": 2, "Domain": [0, 1], "C0": [0, 1], "C1": [1, 0], "N": 2}
    assert Function(Plain, power)([0.5]) == [0.25, 0.75] and Function(Plain, power)([9]) == [1, 0]
    stitched = {"FunctionType": 3, "Domain": [0, 1], "Functions": [power, power], "Bounds": [0.5], "Encode": [0, 1, 1, 0]}
    assert Function(Plain, stitched)([0.25])[0] == 0.25 and Function(Plain, stitched)([1.0])[0] == 0
    assert Function(Plain, Stream({"FunctionType": 4, "Domain": [0, 1], "Range": [0, 0.5]}, b"{2 mul}"))([0.4]) == [0.5]
    with pytest.raises(PdfError):
        Function(Plain, {"FunctionType": 0})
    line = Function(Plain, Stream({"FunctionType": 0, "Domain": [0, 1], "Range": [0, 1, 0, 2], "Size": [3], "BitsPerSample": 8}, bytes([0, 0, 255, 0, 0, 255])))
    assert line([0.25]) == [0.5, 0] and line([0.5]) == [1, 0] and line([0.75]) == [0.5, 1] and line([7]) == [0, 2]
    plane = Function(Plain, Stream({"FunctionType": 0, "Domain": [0, 1, 0, 1], "Range": [0, 15], "Size": [2, 2], "BitsPerSample": 4}, bytes([0x0F, 0x1F])))
    assert plane([0, 0]) == [0] and plane([1, 0]) == [15] and plane([0, 1]) == [1] and plane([0.5, 0.5]) == [7.75]
    turned = Function(Plain, Stream({"FunctionType": 0, "Domain": [0, 1], "Range": [0, 1], "Size": [2], "BitsPerSample": 16, "Encode": [1, 0], "Decode": [0, 0.5]}, bytes([0, 0, 255, 255])))
    assert turned([0]) == [0.5] and turned([1]) == [0]
    with pytest.raises(PdfError):
        Function(Plain, Stream({"FunctionType": 0, "Domain": [0, 1], "Range": [0, 1], "Size": [9], "BitsPerSample": 8}, b"short"))


def drawing():
    b = writer.Builder()
    p = writer.PageBuilder(100, 50).rect(10, 10, 20, 10, (1, 0, 0)).line(0, 40, 100, 40, 2).text(60, 20, "a<b", 10)
    p.image("I", writer.rgb_image(2, 1, b"\x00\xff\x00\x00\x00\xff"), 80, 0, 20, 10)
    b.page(p)
    b.page(writer.PageBuilder(100, 50).rect(0, 0, 10, 10, (0, 0, 1)), Rotate=90)
    return Document(b.build())


def test_commands_and_svg():
    doc = drawing()
    page, turned = doc.pages()
    cmds = render.commands(doc, page)
    assert [c["kind"] for c in cmds] == ["path", "path", "text", "image"] and render.bounds(cmds)[2] == 100
    assert [c["kind"] for c in render.optimize(cmds, [0, 0, 35, 35])] == ["path"]
    assert render.tiles(cmds, [0, 0, 100, 50], 50)[(0, 0)] == [0, 1]
    svg = render.to_svg(doc, page)
    assert svg.startswith("<svg") and "a&lt;b" in svg and "#ff0000" in svg and "data:image/png" in svg
    assert 'width="50" height="100"' in render.to_svg(doc, turned)


def test_pixels():
    doc = drawing()
    page, turned = doc.pages()
    x = render.to_pixels(doc, page, text_bars=False)
    assert x.shape == (50, 100, 3)
    assert (x[35, 15] == [255, 0, 0]).all() and (x[10, 50] == 0).all() and (x[45, 82] == [0, 255, 0]).all() and (x[45, 97] == [0, 0, 255]).all() and (x[20, 50] == 255).all()
    assert (x == [255, 0, 0]).all(2).sum() == 200
    y = render.to_pixels(doc, turned)
    assert y.shape == (100, 50, 3) and (y[5, 5] == [0, 0, 255]).all()
    assert render.to_pixels(doc, page, 144).shape == (100, 200, 3)
    assert render.png(x).startswith(b"\x89PNG")
    with pytest.raises(PdfError):
        render.to_pixels(doc, page, 72 * 1000)


def test_clips_alpha_and_shadings():
    b = writer.Builder()
    p = writer.PageBuilder(100, 50)
    p.parts += [b"q 0 0 50 50 re W n 1 0 0 rg 20 0 60 50 re f Q", b"q /G gs 0 0 1 rg 60 0 20 20 re f Q", b"q 80 0 20 50 re W n /S sh Q"]
    b.page(p)
    n = b.kids[0].num
    fade = {"FunctionType": 2, "Domain": [0, 1], "C0": [0], "C1": [1], "N": 1}
    b.objects[n] = b.objects[n] | {"Resources": {
        "ExtGState": {"G": {"ca": 0.5}},
        "Shading": {"S": {"ShadingType": 2, "ColorSpace": Name("DeviceGray"), "Coords": [0, 0, 0, 50], "Function": fade}},
    }}
    doc = Document(b.build())
    (page,) = doc.pages()
    x = render.to_pixels(doc, page)
    assert (x[25, 30] == [255, 0, 0]).all() and (x[25, 55] == 255).all() and (x[40, 70] == [128, 128, 255]).all()
    assert x[48, 90, 0] < 20 and x[1, 90, 0] > 235 and abs(int(x[25, 90, 0]) - 127) < 5
    svg = render.to_svg(doc, page)
    assert svg.count("<clipPath") == 2 and 'fill-opacity="0.5"' in svg and svg.count("<g ") == svg.count("</g>")
    radial = {"ShadingType": 3, "ColorSpace": Name("DeviceGray"), "Coords": [0, 0, 0, 0, 0, 10], "Function": fade}
    rgb, inside = render.shading_colors(doc, radial, np.array([0.0, 5.0, 20.0]), np.zeros(3))
    assert inside.tolist() == [True, True, False] and abs(rgb[1, 0] - 0.5) < 0.01 and rgb[0, 0] == 0


def test_skew():
    page = np.full((200, 300), 255, np.uint8)
    page[20:180:16, 30:270] = 0
    assert render.skew_angle(page) == 0.0
    tilted = render.rotated(page, 2.0)
    assert abs(abs(render.skew_angle(tilted)) - 2.0) <= 0.3
    assert abs(render.skew_angle(render.rotated(tilted, -2.0))) <= 0.3 and render.skew_angle(np.full((9, 9), 255, np.uint8)) == 0.0


def test_text_flow():
    assert textflow.text_width("MMM", 10, "Courier") == 18
    assert textflow.wrap_paragraph("aa  bb cc", 30, 10, "Courier") == ["aa bb", "cc"] and textflow.wrap_paragraph("abcdefgh", 18, 10, "Courier") == ["abc", "def", "gh"]
    assert textflow.wrap_paragraph("aa bb cc", 30, 10, "Courier", indent=12) == ["aa", "bb cc"] and textflow.wrap_paragraph("", 30) == [""]
    right = textflow.layout_text("aa bb", 12, size=10, font="Courier", align="right", height=25)
    assert [(x["text"], x["x"]) for x in right["lines"]] == [("aa", 0), ("bb", 0)] and not right["overflow"]
    just = textflow.layout_text("a b c d", 36, size=10, font="Courier", align="justify")["lines"]
    assert just[0]["word_spacing"] == 3 and just[-1]["word_spacing"] == 0
    assert textflow.layout_text("a\nb\nc", 50, height=15, size=10)["overflow"] == ["b", "c"]


def test_directions():
    assert textflow.direction_runs("plain") == [(0, 5, 0)] and textflow.direction_runs("") == []
    mixed = "abc שלום def"
    assert [r[2] for r in textflow.direction_runs(mixed)] == [0, 1, 0] and textflow.visual(mixed) == "abc " + "שלום"[::-1] + " def"
    assert textflow.visual("שלום 12 ab") == "ab 12 " + "שלום"[::-1]


def test_spark_rendering_plans_and_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    b = writer.Builder()
    b.page(writer.PageBuilder().text(72, 700, "Streamed text"))
    (folder / "a.pdf").write_bytes(b.build())
    (folder / "b.pdf").write_bytes(b"broken")
    (folder / "c.txt").write_bytes(b"plain")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(str(folder)).selectExpr("path as doc_id", "content")
    rows = render_source.render_pages(files).collect()
    assert sorted(r.status for r in rows) == ["error", "ok"] and any("Streamed" in (r.svg or "") for r in rows)
    assert render_source.render_pages(files, "png", 36).where("png is not null").count() == 1
    texts = {r.doc_id[-5:]: (r.status, r.text) for r in plans.document_text(spark, str(folder)).collect()}
    assert texts["a.pdf"] == ("ok", "Streamed text") and texts["c.txt"] == ("ok", "plain") and texts["b.pdf"][0] == "error"
    assert {r.status for r in plans.pdf_text(files).collect()} == {"ok", "error"}
    query = streams.document_stream(spark, str(folder)).select("doc_id", "status").writeStream.format("memory").queryName("arrived").start()
    try:
        query.processAllAvailable()
        (folder / "d.txt").write_bytes(b"late")
        query.processAllAvailable()
        assert spark.table("arrived").count() == 4
    finally:
        query.stop()


def read_qr(grid) -> str:
    """Read a symbol back: format, mask, words, blocks; checks the error words too."""
    from quire.functions import qr

    size = len(grid)
    version = (size - 17) // 4
    value = sum(grid[8][size - 1 - k] << k for k in range(8)) | sum(grid[size - 15 + k][8] << k for k in range(8, 15))
    assert value == sum(grid[k + (k > 5)][8] << k for k in range(8)) | grid[8][7] << 8 | sum(grid[8][14 - k] << k for k in range(9, 15))
    head = (value ^ 0x5412) >> 10
    level, mask = {v: k for k, v in qr.LEVEL_BITS.items()}[head >> 3], qr._MASKS[head & 7]
    fixed = set()
    for r in range(size):
        for c in range(size):
            if (r < 9 and (c < 9 or c >= size - 8)) or (r >= size - 8 and c < 9) or 6 in (r, c) or (version >= 7 and ((r < 6 and c >= size - 11) or (c < 6 and r >= size - 11))):
                fixed.add((r, c))
    at = qr._alignment(version)
    fixed |= {(r + a, c + b) for r in at for c in at if (r, c) not in ((6, 6), (6, size - 7), (size - 7, 6)) for a in range(-2, 3) for b in range(-2, 3)}
    bits, up = [], True
    for right in [c for c in range(size - 1, 6, -2)] + [5, 3, 1]:
        for r in range(size - 1, -1, -1) if up else range(size):
            bits += [grid[r][c] ^ mask(r, c) for c in (right, right - 1) if (r, c) not in fixed]
        up = not up
    words = [int("".join(map(str, map(int, bits[k : k + 8]))), 2) for k in range(0, len(bits) // 8 * 8, 8)]
    n, blocks = qr.EC_WORDS[level][version - 1], qr.BLOCKS[level][version - 1]
    room = len(words) - n * blocks
    short = room // blocks
    sizes = [short + (k >= blocks - room % blocks) for k in range(blocks)]
    data, it = [[] for _ in sizes], iter(words)
    for k in range(short + 1):
        for j, s in enumerate(sizes):
            if k < s:
                data[j].append(next(it))
    errors = [[] for _ in sizes]
    for _ in range(n):
        for e in errors:
            e.append(next(it))
    assert errors == [qr.error_words(d, n) for d in data]
    flat = "".join(f"{w:08b}" for d in data for w in d)
    length = 8 if version < 10 else 16
    count = int(flat[4 : 4 + length], 2)
    return bytes(int(flat[4 + length + 8 * k :][:8], 2) for k in range(count)).decode()


@pytest.mark.parametrize("level", "LMQH")
@pytest.mark.parametrize("text", ["", "Hello", "grüße 文字", "x" * 60, "y" * 110])
def test_qr_codes_read_back(text, level):
    from quire.functions import qr

    assert read_qr(qr.qr_code(text, level)) == text


def test_qr_error_words_against_a_published_example():
    from quire.functions import qr

    assert qr.error_words([32, 91, 11, 120, 209, 114, 220, 77, 67, 64, 236, 17, 236, 17, 236, 17], 10) == [196, 35, 39, 119, 235, 215, 231, 226, 93, 23]
    with pytest.raises(ValueError):
        qr.qr_code("z" * 400)


@pytest.mark.parametrize("mode,want", [
    ("Normal", 0.25), ("Multiply", 0.125), ("Screen", 0.625), ("Overlay", 0.25), ("Darken", 0.25), ("Lighten", 0.5), ("Difference", 0.25), ("Exclusion", 0.5), ("HardLight", 0.25),
    ("SoftLight", 0.375), ("ColorDodge", 0.6667), ("ColorBurn", 0.0), ("NoSuchMode", 0.25),
])
def test_blend_modes(mode, want):
    """A quarter of gray over a half."""
    b = writer.Builder()
    page = writer.PageBuilder(20, 20)
    page.parts.append(b"0.5 g 0 0 20 20 re f /G gs 0.25 g 0 0 10 20 re f")
    b.page(page)
    n = b.kids[0].num
    b.objects[n] = b.objects[n] | {"Resources": {"ExtGState": {"G": {"BM": Name(mode)}}}}
    doc = Document(b.build())
    p = render.to_pixels(doc, doc.pages()[0])
    assert abs(int(p[10, 5, 0]) - round(255 * want)) <= 1 and abs(int(p[10, 15, 0]) - 128) <= 1


def test_soft_masks():
    b = writer.Builder()
    soft = b.add(Stream({"Subtype": Name("Image"), "Width": 2, "Height": 1, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8}, b"\x00\x80"))
    image = writer.rgb_image(1, 1, b"\x00\x00\x00")
    image.dict["SMask"] = soft
    b.page(writer.PageBuilder(20, 20).image("I", image, 0, 0, 20, 20))
    doc = Document(b.build())
    p = render.to_pixels(doc, doc.pages()[0])
    assert tuple(p[10, 5]) == (255, 255, 255) and abs(int(p[10, 15, 0]) - 127) <= 1


def test_patterns_and_spaces():
    b = writer.Builder()
    cell = b.add(Stream({"PatternType": 1, "PaintType": 1, "TilingType": 1, "BBox": [0, 0, 10, 10], "XStep": 10, "YStep": 10, "Resources": {}}, b"1 0 0 rg 0 0 5 5 re f"))
    plain = b.add(Stream({"PatternType": 1, "PaintType": 2, "TilingType": 1, "BBox": [0, 0, 10, 10], "XStep": 10, "YStep": 10, "Resources": {}}, b"0 0 5 10 re f"))
    page = writer.PageBuilder(60, 40)
    page.parts.append(b"/Pattern cs /P scn 0 0 20 20 re f /U cs 0 0 1 /Q scn 20 0 20 20 re f /Pattern cs /S scn 40 0 20 20 re f /Spot cs 0.5 scn 0 20 20 20 re f 0 g 20 20 20 20 re f")
    b.page(page)
    shade = {"ShadingType": 2, "ColorSpace": Name("DeviceRGB"), "Coords": [40, 0, 60, 0], "Function": {"FunctionType": 2, "Domain": [0, 1], "C0": [0, 0, 0], "C1": [0, 1, 0], "N": 1}}
    tint = {"FunctionType": 2, "Domain": [0, 1], "C0": [1, 1, 1], "C1": [1, 0, 0], "N": 1}
    n = b.kids[0].num
    b.objects[n] = b.objects[n] | {"Resources": {
        "Pattern": {"P": cell, "Q": plain, "S": {"PatternType": 2, "Shading": shade}},
        "ColorSpace": {"U": [Name("Pattern"), Name("DeviceRGB")], "Spot": [Name("Separation"), Name("S"), Name("DeviceRGB"), tint]},
    }}
    doc = Document(b.build())
    p = render.to_pixels(doc, doc.pages()[0])
    at = lambda x, y: tuple(p[39 - y, x])
    assert at(2, 2) == at(12, 12) == (255, 0, 0) and at(7, 2) == at(2, 7) == (255, 255, 255)
    assert at(22, 2) == at(22, 8) == (0, 0, 255) and at(27, 2) == (255, 255, 255)
    assert at(41, 5)[1] < 30 and at(58, 5)[1] > 220 and at(41, 25) == (255, 255, 255)
    assert abs(int(at(5, 30)[1]) - 128) <= 1 and at(5, 30)[0] == 255 and at(30, 30) == (0, 0, 0)
