"""Pages as draw commands, and these as SVG or pixels.

Commands are rows: kind (path, text, image), what to paint, and a box. Pixels
have paths and uncoded images; glyph outlines need font programs, which are not
read, so text in pixels is a bar of its height (or left out).
"""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np

from quire.pdf import color, content, filters
from quire.pdf.content import IDENTITY, apply, concat
from quire.pdf.functions import Function
from quire.pdf.glyphs import program_of
from quire.pdf.structure import components
from quire.pdf.syntax import Name, PdfError, Stream

MAX_SIDE = 16384


def page_transform(box, rotate: int, scale: float):
    """(matrix, width, height): from page space to pixels with the origin at the top left."""
    x0, y0, x1, y1 = box
    w, h = (x1 - x0) * scale, (y1 - y0) * scale
    m = {
        0: (scale, 0, 0, -scale, -x0 * scale, y1 * scale), 90: (0, scale, scale, 0, -y0 * scale, -x0 * scale),
        180: (-scale, 0, 0, scale, x1 * scale, -y0 * scale), 270: (0, -scale, -scale, 0, y1 * scale, x1 * scale),
    }[rotate % 360 if rotate % 90 == 0 else 0]
    return (m, h, w) if rotate % 180 == 90 else (m, w, h)


def gray(v):
    return (v, v, v)


def cmyk(c, m, y, k):
    return tuple(1 - min(1.0, v + k) for v in (c, m, y))


_COLOR_OPS = {"g": ("fill", gray, 1), "G": ("stroke", gray, 1), "rg": ("fill", lambda *v: v, 3), "RG": ("stroke", lambda *v: v, 3), "k": ("fill", cmyk, 4), "K": ("stroke", cmyk, 4)}
_PAINT = {"S": (0, 1, 0), "s": (0, 1, 0), "f": (1, 0, 0), "F": (1, 0, 0), "f*": (1, 0, 1), "B": (1, 1, 0), "B*": (1, 1, 1), "b": (1, 1, 0), "b*": (1, 1, 1)}


def commands(doc, page: dict, limit: int = 12) -> list[dict]:
    """The draw commands of a page, with those of its form objects."""
    out: list[dict] = []
    _run(doc, doc.content(page), doc.resolve(page.get("Resources")) or {}, IDENTITY, {"fill": (0, 0, 0), "stroke": (0, 0, 0), "width": 1.0, "clip": (), "ca": 1.0, "CA": 1.0, "blend": "Normal"}, out, limit)
    return out


def _box(points):
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return [min(xs), min(ys), max(xs), max(ys)]


def _run(doc, data: bytes, resources: dict, ctm, state: dict, out: list, limit: int) -> None:
    machine = content.TextMachine(content.fonts_of(doc, resources))
    machine.ctm, machine.marks, programs = ctm, [], {}
    objects = doc.get(resources, "XObject", dict) or {}
    stack, paths, at, clipping = [], [], (0.0, 0.0), None
    state = dict(state)
    put = lambda **c: out.append(c | {"clip": state["clip"], "alpha": state["ca"], "stroke_alpha": state["CA"], "blend": state["blend"]})
    for op, args in content.operations(data):
        nums = [float(a) for a in args if isinstance(a, (int, float)) and not isinstance(a, bool)]
        if op == "q":
            stack.append(dict(state))
        elif op == "Q" and stack:
            state = stack.pop()
        elif op == "w" and nums:
            state["width"] = nums[0]
        elif op == "gs" and args:
            own = doc.get(doc.get(resources, "ExtGState"), str(args[0]), dict) or {}
            modes = doc.resolve(own.get("BM"))
            for mode in modes if isinstance(modes, list) else [modes]:
                if str(doc.resolve(mode)) in BLEND:
                    state["blend"] = str(doc.resolve(mode))
                    break
            for key in ("ca", "CA"):
                value = doc.get(own, key, (int, float))
                state[key] = state[key] if value is None else float(value)
        elif op in ("W", "W*"):
            clipping = op == "W*"
        elif op == "sh" and args:
            shading = doc.get(doc.get(resources, "Shading"), str(args[0]))
            if shading is not None:
                put(kind="shading", shading=shading, matrix=machine.ctm, box=[-1e9, -1e9, 1e9, 1e9])
        elif op in _COLOR_OPS and len(nums) >= _COLOR_OPS[op][2]:
            which, to_rgb, n = _COLOR_OPS[op]
            state[which] = to_rgb(*nums[:n])
            state[which + "_space"] = state[which + "_pattern"] = None
        elif op in ("cs", "CS") and args:
            which, named = "stroke" if op == "CS" else "fill", doc.get(resources, "ColorSpace", dict) or {}
            space = doc.resolve(named.get(str(args[0]), args[0]))
            state |= {which: (0, 0, 0), which + "_space": space, which + "_pattern": None}
        elif op in ("sc", "scn", "SC", "SCN") and (nums or args and isinstance(args[-1], Name)):
            which = "stroke" if op.isupper() else "fill"
            space = state.get(which + "_space")
            if args and isinstance(args[-1], Name):
                state[which + "_pattern"] = doc.resolve((doc.get(resources, "Pattern", dict) or {}).get(str(args[-1])))
                space = doc.resolve(space[1]) if isinstance(space, list) and len(space) > 1 else None
            else:
                state[which + "_pattern"] = None
            if space is not None and nums and str(space) not in ("DeviceGray", "DeviceRGB", "DeviceCMYK", "Pattern"):
                state[which] = color.to_rgb(doc, space, nums)
            elif len(nums) in (1, 3, 4):
                state[which] = {1: gray, 3: lambda *v: v, 4: cmyk}[len(nums)](*nums)
        elif op == "m" and len(nums) >= 2:
            at = nums[0], nums[1]
            paths.append([("M", at)])
        elif op == "l" and len(nums) >= 2 and paths:
            at = nums[0], nums[1]
            paths[-1].append(("L", at))
        elif op in ("c", "v", "y") and len(nums) >= (6 if op == "c" else 4) and paths:
            p = list(zip(nums[::2], nums[1::2]))
            p = p[:3] if op == "c" else [at, *p[:2]] if op == "v" else [p[0], p[1], p[1]]
            at = p[2]
            paths[-1].append(("C", *p))
        elif op == "re" and len(nums) >= 4:
            x, y, w, h = nums[:4]
            at = x, y
            paths.append([("M", (x, y)), ("L", (x + w, y)), ("L", (x + w, y + h)), ("L", (x, y + h)), ("Z",)])
        elif op == "h" and paths:
            paths[-1].append(("Z",))
        elif op in _PAINT or op == "n":
            if clipping is not None and paths:
                state["clip"] = (*state["clip"], ([[(s[0], *(apply(machine.ctm, *p) for p in s[1:])) for s in path] for path in paths], clipping))
            clipping = None
            if op in _PAINT and paths:
                fill, stroke, even = _PAINT[op]
                placed = [[(s[0], *(apply(machine.ctm, *p) for p in s[1:])) for s in path] + ([("Z",)] if op in ("s", "b", "b*") else []) for path in paths]
                points = [p for path in placed for s in path for p in s[1:]]
                pattern = state.get("fill_pattern") if fill else None
                if pattern is not None and points:
                    _pattern(doc, pattern, ctm, state | {"clip": (*state["clip"], (placed, bool(even)))}, _box(points), out, limit)
                put(kind="path", paths=placed, fill=state["fill"] if fill and pattern is None else None, stroke=state["stroke"] if stroke else None, width=state["width"] * content.scale_of(machine.ctm), even_odd=bool(even), box=_box(points))
            paths = []
        elif op in ("Do", "BI") and args:
            s = args[0] if op == "BI" else doc.resolve(objects.get(str(args[0])))
            if isinstance(s, Stream) and (op == "BI" or s.dict.get("Subtype") == "Image"):
                corners = [apply(machine.ctm, *p) for p in ((0, 0), (1, 0), (1, 1), (0, 1))]
                put(kind="image", stream=s, matrix=machine.ctm, box=_box(corners))
            elif isinstance(s, Stream) and s.dict.get("Subtype") == "Form" and limit:
                own = [float(doc.resolve(v)) for v in doc.get(s, "Matrix", list) or IDENTITY]
                _run(doc, doc.decoded(s), doc.get(s, "Resources", dict) or resources, concat(tuple(own), machine.ctm), state, out, limit - 1)
        before = len(machine.chars)
        machine.marks.clear()
        machine.step(op, args)
        for font, code, matrix in machine.marks:
            if font is not None and font.subtype == "Type3" and limit:
                _type3(doc, font, code, matrix, resources, state, out, limit)
        if len(machine.chars) > before:
            paths_of = _outlines(doc, machine.marks, programs)
            own = machine.chars[before:]
            x0, y0, size = own[0][1], own[0][2], own[0][3]
            put(kind="text", text="".join(c[0] for c in own), x=x0, y=y0, size=size, font=own[0][4], fill=state["fill"], paths=paths_of, box=[x0, y0 - 0.2 * size, own[-1][1] + own[-1][5], y0 + 0.8 * size])


#: A pattern's cells in a path, at most.
MOST_CELLS = 10_000


def _pattern(doc, pattern, base, state: dict, box, out: list, limit: int) -> None:
    """Fill what the state's clip leaves of a box with a tiling or shading pattern."""
    d = pattern.dict if isinstance(pattern, Stream) else pattern
    if not isinstance(d, dict) or not limit:
        return
    matrix = concat(tuple(float(doc.resolve(v)) for v in doc.get(d, "Matrix", list) or IDENTITY), base)
    if doc.get(d, "PatternType", int) == 2:
        shading = doc.get(d, "Shading")
        if shading is not None:
            out.append({"kind": "shading", "shading": shading, "matrix": matrix, "box": box, "clip": state["clip"], "alpha": state["ca"], "stroke_alpha": state["CA"], "blend": state["blend"]})
        return
    cell = [float(doc.resolve(v)) for v in doc.get(d, "BBox", list) or ()]
    across, down = (abs(float(doc.get(d, key, (int, float)) or 0)) for key in ("XStep", "YStep"))
    a, b, c, e, f, g = matrix
    det = a * e - b * c
    if not isinstance(pattern, Stream) or len(cell) != 4 or not across or not down or not det:
        return
    corners = [((e * (x - f) - c * (y - g)) / det, (a * (y - g) - b * (x - f)) / det) for x in box[::2] for y in box[1::2]]
    low = [int(np.floor((min(p[k] for p in corners) - cell[k + 2]) / step)) for k, step in ((0, across), (1, down))]
    high = [int(np.ceil((max(p[k] for p in corners) - cell[k]) / step)) for k, step in ((0, across), (1, down))]
    if (high[0] - low[0] + 1) * (high[1] - low[1] + 1) > MOST_CELLS:
        return
    own = {k: v for k, v in state.items() if not k.endswith(("_pattern", "_space"))}
    if doc.get(d, "PaintType", int) != 2:
        own |= {"fill": (0, 0, 0), "stroke": (0, 0, 0)}
    data, resources = doc.decoded(pattern), doc.get(d, "Resources", dict) or {}
    for j in range(low[1], high[1] + 1):
        for i in range(low[0], high[0] + 1):
            _run(doc, data, resources, concat((1, 0, 0, 1, i * across, j * down), matrix), own, out, limit - 1)


def _outlines(doc, marks, programs: dict) -> list | None:
    """The placed outlines of shown glyphs; None if one of them has no program."""
    out = []
    for font, code, matrix in marks:
        if font is None or font.subtype == "Type3":
            return [] if font is not None else None
        if id(font) not in programs:
            programs[id(font)] = program_of(doc, font, font.dict)
        program = programs[id(font)]
        if program is None:
            return None
        out += [[(s[0], *(apply(matrix, *p) for p in s[1:])) for s in path] for path in program.outline(code) or ()]
    return out


def _type3(doc, font, code: int, matrix, resources: dict, state: dict, out: list, limit: int) -> None:
    """A glyph that is a content stream of its own."""
    proc = doc.get(doc.get(font.dict, "CharProcs", dict) or {}, font.names.get(code, ""))
    if isinstance(proc, Stream):
        own = [float(doc.resolve(v)) for v in doc.get(font.dict, "FontMatrix", list) or (0.001, 0, 0, 0.001, 0, 0)]
        _run(doc, doc.decoded(proc), doc.get(font.dict, "Resources", dict) or resources, concat(tuple(own), matrix), state, out, limit - 1)


def bounds(cmds: list[dict]):
    boxes = [c["box"] for c in cmds if c["kind"] != "shading"]
    return [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)] if boxes else None


def optimize(cmds: list[dict], box) -> list[dict]:
    """Without what lies outside a box or paints nothing."""
    x0, y0, x1, y1 = box
    return [c for c in cmds if c["box"][0] <= x1 and c["box"][2] >= x0 and c["box"][1] <= y1 and c["box"][3] >= y0 and not (c["kind"] == "path" and c["fill"] is None and c["stroke"] is None)]


def tiles(cmds: list[dict], box, size: float) -> dict[tuple[int, int], list[int]]:
    """Which commands touch each tile of a page."""
    out: dict[tuple[int, int], list[int]] = {}
    for k, c in enumerate(cmds):
        b = c["box"]
        low = [max(0, int((b[j] - box[j]) // size)) for j in (0, 1)]
        high = [int((min(b[j + 2], box[j + 2]) - box[j]) // size) for j in (0, 1)]
        for tx in range(low[0], high[0] + 1):
            for ty in range(low[1], high[1] + 1):
                out.setdefault((tx, ty), []).append(k)
    return out


def _jpeg_pixels(data: bytes, transform) -> np.ndarray | None:
    from quire.pdf import jpeg

    try:
        p = jpeg.decode(data, transform if isinstance(transform, int) else None)
    except (PdfError, IndexError, ValueError, struct.error):
        return None
    if p.shape[2] == 4:
        p = 255 - np.minimum(255, p[:, :, :3].astype(int) + p[:, :, 3:])
    return np.repeat(p, 3, axis=2) if p.shape[2] == 1 else p.astype(np.uint8)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels at another size, each the mean of the area that it covers."""

    def weights(n, m):
        edges = np.linspace(0, n, m + 1)
        k = np.arange(n)
        own = np.clip(np.minimum(edges[1:, None], k + 1) - np.maximum(edges[:-1, None], k), 0, None)
        return own / own.sum(1, keepdims=True)

    rows, columns = weights(pixels.shape[0], height), weights(pixels.shape[1], width)
    out = np.einsum("ij,jkc->ikc", rows, pixels.astype(float), optimize=True)
    return np.clip(np.round(np.einsum("lk,ikc->ilc", columns, out, optimize=True)), 0, 255).astype(np.uint8)


def image_pixels(doc, s: Stream) -> np.ndarray | None:
    """Rows of RGB; None for what is coded in a way that is not read."""
    d = s.dict
    get = lambda *keys: next((v for k in keys if (v := doc.resolve(d.get(k))) is not None), None)
    w, h, bits = get("Width", "W"), get("Height", "H"), get("BitsPerComponent", "BPC") or 8
    space = get("ColorSpace", "CS")
    n = components(doc, space) if space is not None else 1
    names = [name for name, _ in filters.chain(d, doc.resolve)]
    try:
        if names and names[-1] in ("DCTDecode", "DCT"):
            return _jpeg_pixels(filters.decode(s.raw, d, doc.resolve), (doc.get(d, "DecodeParms", dict) or {}).get("ColorTransform"))
        raw = np.frombuffer(doc.decoded(s), np.uint8)
    except PdfError:
        return None
    if get("ImageMask", "IM"):
        bits, n = 1, 1
    if bits == 1 and n == 1:
        row = (w + 7) // 8
        if len(raw) < row * h:
            return None
        return np.repeat(np.unpackbits(raw[: row * h].reshape(h, row), axis=1)[:, :w, None] * np.uint8(255), 3, axis=2)
    if bits != 8 or n not in (1, 3, 4) or len(raw) < w * h * n:
        return None
    p = raw[: w * h * n].reshape(h, w, n)
    if n == 4:
        p = 255 - np.minimum(255, p[:, :, :3].astype(int) + p[:, :, 3:])
    return np.repeat(p, 3, axis=2).astype(np.uint8) if n == 1 else p.astype(np.uint8)


def soft_mask(doc, s: Stream) -> np.ndarray | None:
    """How much of an image shows, from 0 to 1, by its soft mask or its stencil mask; None without one."""
    for key in ("SMask", "Mask"):
        mask = doc.resolve(s.dict.get(key))
        if isinstance(mask, Stream):
            pixels = image_pixels(doc, mask)
            if pixels is None:
                return None
            shown = pixels[:, :, 0] / 255
            decode = [float(doc.resolve(v)) for v in doc.get(mask, "Decode", list) or (0, 1)]
            shown = shown if decode[:1] != [1.0] else 1 - shown
            return shown if key == "SMask" else 1 - shown
    return None


def _soft_light(b, s):
    d = np.where(b <= 0.25, ((16 * b - 12) * b + 4) * b, np.sqrt(b))
    return np.where(s <= 0.5, b - (1 - 2 * s) * b * (1 - b), b + (2 * s - 1) * (d - b))


def _hard_light(b, s):
    return np.where(s <= 0.5, 2 * b * s, 1 - 2 * (1 - b) * (1 - s))


#: Separable blend modes: what is below and what is laid over it, from 0 to 1.
BLEND = {
    "Normal": lambda b, s: s, "Compatible": lambda b, s: s, "Multiply": lambda b, s: b * s, "Screen": lambda b, s: b + s - b * s, "Overlay": lambda b, s: _hard_light(s, b),
    "Darken": np.minimum, "Lighten": np.maximum, "HardLight": _hard_light, "SoftLight": _soft_light, "Difference": lambda b, s: abs(b - s), "Exclusion": lambda b, s: b + s - 2 * b * s,
    "ColorDodge": lambda b, s: np.where(b == 0, 0, np.where(s >= 1, 1, np.minimum(1, b / np.maximum(1 - s, 1e-9)))),
    "ColorBurn": lambda b, s: np.where(b >= 1, 1, np.where(s <= 0, 0, 1 - np.minimum(1, (1 - b) / np.maximum(s, 1e-9)))),
}


def png(pixels: np.ndarray) -> bytes:
    """RGB rows as a PNG file."""
    h, w = pixels.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], 1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def _rgb(c) -> str:
    return "#" + "".join(f"{round(255 * min(max(v, 0), 1)):02x}" for v in c)


def _escape(t: str) -> str:
    return t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def page_box(doc, page: dict):
    boxes = doc.page_boxes(page)
    return boxes["crop_box"] or boxes["media_box"]


def shading_colors(doc, shading, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(RGB, painted) of an axial or radial shading at points of its space; None for other kinds."""
    from quire.pdf.color import to_rgb

    d = shading.dict if isinstance(shading, Stream) else shading
    kind = doc.get(d, "ShadingType", int)
    numbers = lambda key, default: [float(doc.resolve(v)) for v in doc.get(d, key, list) or default]
    if kind not in (2, 3):
        return None
    c, (t0, t1) = numbers("Coords", []), numbers("Domain", [0, 1])
    before, after = (bool(doc.resolve(v)) for v in doc.get(d, "Extend", list) or [False, False])
    if kind == 2:
        x0, y0, x1, y1 = c
        n = (x1 - x0) ** 2 + (y1 - y0) ** 2
        u = ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (n or 1)
        inside = ((u >= 0) | before) & ((u <= 1) | after)
    else:
        x0, y0, r0, x1, y1, r1 = c
        dx, dy, dr = x1 - x0, y1 - y0, r1 - r0
        a = dx * dx + dy * dy - dr * dr
        b = (x - x0) * dx + (y - y0) * dy + r0 * dr
        g = (x - x0) ** 2 + (y - y0) ** 2 - r0 * r0
        u, inside = np.zeros_like(x), np.zeros(x.shape, bool)
        root = np.sqrt(np.maximum(b * b - a * g, 0))
        roots = [(b + root) / a, (b - root) / a] if abs(a) > 1e-12 else [g / np.where(np.abs(b) > 1e-12, 2 * b, 1)]
        if a < 0:
            roots = roots[::-1]
        for v in roots:
            ok = ~inside & (b * b - a * g >= -1e-9) & (r0 + v * dr >= 0) & ((v >= 0) | before) & ((v <= 1) | after)
            u[ok], inside = v[ok], inside | ok
    functions = doc.resolve(d.get("Function"))
    functions = [Function(doc, f) for f in (functions if isinstance(functions, list) else [functions])]
    steps = np.linspace(0, 1, 257)
    table = np.array([to_rgb(doc, d.get("ColorSpace"), [v for f in functions for v in f([t0 + t * (t1 - t0)])]) for t in steps])
    return table[np.round(np.clip(u, 0, 1) * 256).astype(int)], inside


def to_svg(doc, page: dict, dpi: float = 72.0) -> str:
    m, w, h = page_transform(page_box(doc, page), doc.rotation(page), dpi / 72)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{w:g}" height="{h:g}" viewBox="0 0 {w:g} {h:g}">']
    outline = lambda paths: " ".join(s[0] + " ".join(f"{x:.2f},{y:.2f}" for x, y in (apply(m, *p) for p in s[1:])) for path in paths for s in path)
    clips = 0
    for c in commands(doc, page):
        for paths, even in c["clip"]:
            clips += 1
            out.append(f'<clipPath id="c{clips}"><path d="{outline(paths)}"' + (' clip-rule="evenodd"' if even else "") + f'/></clipPath><g clip-path="url(#c{clips})">')
        if c["alpha"] < 1 or c["stroke_alpha"] < 1:
            out.append(f'<g fill-opacity="{c["alpha"]:g}" stroke-opacity="{c["stroke_alpha"]:g}">')
        if c["kind"] == "path":
            d = outline(c["paths"])
            paint = f'fill="{_rgb(c["fill"]) if c["fill"] else "none"}"' + (f' stroke="{_rgb(c["stroke"])}" stroke-width="{c["width"] * content.scale_of(m):.2f}"' if c["stroke"] else "")
            out.append(f'<path d="{d}" {paint}' + (' fill-rule="evenodd"' if c["even_odd"] else "") + "/>")
        elif c["kind"] == "text":
            x, y = apply(m, c["x"], c["y"])
            out.append(f'<text x="{x:.2f}" y="{y:.2f}" font-size="{c["size"] * content.scale_of(m):.2f}" fill="{_rgb(c["fill"])}">{_escape(c["text"])}</text>')
        elif c["kind"] == "image":
            pixels = image_pixels(doc, c["stream"])
            if pixels is not None:
                t = concat((1, 0, 0, -1, 0, 1), concat(c["matrix"], m))
                out.append(f'<image width="1" height="1" preserveAspectRatio="none" transform="matrix({" ".join(f"{v:.4f}" for v in t)})" href="data:image/png;base64,{base64.b64encode(png(pixels)).decode()}"/>')
        out += ["</g>"] * (len(c["clip"]) + (c["alpha"] < 1 or c["stroke_alpha"] < 1))
    return "\n".join([*out, "</svg>"])


def _flat(path, m, steps: int = 12):
    points = []
    for s in path:
        if s[0] in "ML":
            points.append(apply(m, *s[1]))
        elif s[0] == "C" and points:
            p0, (p1, p2, p3) = points[-1], (apply(m, *p) for p in s[1:])
            for k in range(1, steps + 1):
                t = k / steps
                u = 1 - t
                points.append(tuple(u**3 * a + 3 * u * u * t * b + 3 * u * t * t * c + t**3 * d for a, b, c, d in zip(p0, p1, p2, p3)))
    return points


def _cover(polygons, w: int, h: int, even_odd: bool) -> np.ndarray:
    """Which pixels' centres lie inside."""
    xs = np.arange(w) + 0.5
    wind = np.zeros((h, w), np.int32)
    for points in polygons:
        for (xa, ya), (xb, yb) in zip(points, points[1:] + points[:1]):
            if ya == yb:
                continue
            sign, (x0, y0, x1, y1) = (1, (xa, ya, xb, yb)) if ya < yb else (-1, (xb, yb, xa, ya))
            low, high = max(0, int(np.ceil(y0 - 0.5))), min(h, int(np.ceil(y1 - 0.5)))
            if low < high:
                cross = x0 + (np.arange(low, high) + 0.5 - y0) * (x1 - x0) / (y1 - y0)
                wind[low:high] += sign * (xs[None, :] >= cross[:, None])
    return (wind & 1).astype(bool) if even_odd else wind != 0


def to_pixels(doc, page: dict, dpi: float = 72.0, text_bars: bool = True) -> np.ndarray:
    """Rows of RGB on white."""
    m, w, h = page_transform(page_box(doc, page), doc.rotation(page), dpi / 72)
    w, h = round(w), round(h)
    if not (0 < w <= MAX_SIDE and 0 < h <= MAX_SIDE):
        raise PdfError(f"a picture of {w} x {h}")
    out = np.full((h, w, 3), 255, np.uint8)
    tint = lambda c: np.array([255 * min(max(v, 0), 1) for v in c])

    def paint(mask, value, alpha, blend="Normal"):
        """Lay a colour (or one for each pixel of the mask) over the picture; alpha may be one for each pixel, too."""
        plain = not isinstance(alpha, np.ndarray) and alpha >= 1
        if plain and blend in ("Normal", "Compatible"):
            out[mask] = np.round(value)
            return
        below = out[mask].astype(float)
        mixed = np.broadcast_to(value, below.shape) if blend in ("Normal", "Compatible") else 255 * np.clip(BLEND[blend](below / 255, np.broadcast_to(value, below.shape) / 255), 0, 1)
        alpha = alpha[:, None] if isinstance(alpha, np.ndarray) else alpha
        out[mask] = np.round(alpha * mixed + (1 - alpha) * below)

    ys, xs = np.mgrid[0:h, 0:w] + 0.5
    for c in commands(doc, page):
        clip = np.ones((h, w), bool)
        for paths, even in c["clip"]:
            clip &= _cover([f for p in paths if len(f := _flat(p, m)) > 1], w, h, even)
        if c["kind"] == "path":
            flat = [f for p in c["paths"] if len(f := _flat(p, m)) > 1]
            if c["fill"]:
                paint(_cover(flat, w, h, c["even_odd"]) & clip, tint(c["fill"]), c["alpha"], c["blend"])
            if c["stroke"]:
                half, mask = max(c["width"] * content.scale_of(m), 1) / 2, np.zeros((h, w), bool)
                for path, points in zip(c["paths"], flat):
                    ring = points + points[:1] if path[-1][0] == "Z" else points
                    for (xa, ya), (xb, yb) in zip(ring, ring[1:]):
                        n = max(np.hypot(xb - xa, yb - ya), 1e-9)
                        dx, dy = (yb - ya) / n * half, (xa - xb) / n * half
                        mask |= _cover([[(xa + dx, ya + dy), (xb + dx, yb + dy), (xb - dx, yb - dy), (xa - dx, ya - dy)]], w, h, False)
                paint(mask & clip, tint(c["stroke"]), c["stroke_alpha"], c["blend"])
        elif c["kind"] in ("image", "shading"):
            a, b, cc, d, e, f = concat(c["matrix"], m)
            det = a * d - b * cc
            if not det:
                continue
            u, v = (d * (xs - e) - cc * (ys - f)) / det, (a * (ys - f) - b * (xs - e)) / det
            if c["kind"] == "shading":
                found = shading_colors(doc, c["shading"], u, v)
                if found is not None:
                    inside = found[1] & clip
                    paint(inside, 255 * np.clip(found[0][inside], 0, 1), c["alpha"], c["blend"])
                continue
            pixels = image_pixels(doc, c["stream"])
            if pixels is not None:
                inside = (u >= 0) & (u < 1) & (v >= 0) & (v < 1) & clip
                rows = ((1 - v[inside]) * pixels.shape[0]).astype(int).clip(0, pixels.shape[0] - 1)
                alpha, soft = c["alpha"], soft_mask(doc, c["stream"])
                if soft is not None:
                    alpha = alpha * soft[((1 - v[inside]) * soft.shape[0]).astype(int).clip(0, soft.shape[0] - 1), (u[inside] * soft.shape[1]).astype(int)]
                paint(inside, pixels[rows, (u[inside] * pixels.shape[1]).astype(int)].astype(float), alpha, c["blend"])
        elif c["paths"] is not None:
            flat = [f for p in c["paths"] if len(f := _flat(p, m)) > 1]
            if flat:
                paint(_cover(flat, w, h, False) & clip, tint(c["fill"]), c["alpha"], c["blend"])
        elif text_bars:
            x0, y0, x1, y1 = _box([apply(m, c["box"][0], c["y"]), apply(m, c["box"][2], c["y"] + 0.5 * c["size"])])
            paint(clip & (xs > x0) & (xs < x1) & (ys > y0) & (ys < y1), tint(c["fill"]), c["alpha"], c["blend"])
    return out


# --- skew ---


def skew_angle(pixels: np.ndarray, most: float = 5.0, step: float = 0.1) -> float:
    """The turn, in degrees, under which a page's rows differ most in darkness."""
    dark = pixels if pixels.ndim == 2 else pixels.mean(2)
    ys, xs = np.nonzero(dark < 128)
    if not len(xs):
        return 0.0
    best, angle = -1.0, 0.0
    for k in range(-round(most / step), round(most / step) + 1):
        turn = k * step
        rows = np.round(ys * np.cos(np.radians(turn)) - xs * np.sin(np.radians(turn))).astype(int)
        score = float(np.bincount(rows - rows.min()).var())
        if score > best + 1e-9 or (abs(score - best) <= 1e-9 and abs(turn) < abs(angle)):
            best, angle = score, turn
    return round(angle, 6)


def rotated(pixels: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the middle, white outside, nearest pixels."""
    h, w = pixels.shape[:2]
    a = np.radians(degrees)
    ys, xs = np.mgrid[0:h, 0:w].astype(float)
    x, y = xs - (w - 1) / 2, ys - (h - 1) / 2
    sx, sy = np.round(x * np.cos(a) - y * np.sin(a) + (w - 1) / 2).astype(int), np.round(x * np.sin(a) + y * np.cos(a) + (h - 1) / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(pixels, 255)
    out[inside] = pixels[sy[inside], sx[inside]]
    return out
