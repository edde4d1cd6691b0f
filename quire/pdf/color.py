"""Colours: ICC profiles to sRGB, and the other colour spaces to RGB."""

from __future__ import annotations

import numpy as np

from quire.pdf import filters
from quire.pdf.functions import Function
from quire.pdf.structure import icc_profile
from quire.pdf.syntax import Name, Stream

#: From the profile connection space (D50) to linear sRGB, the adaptation to D65 included.
D50_TO_SRGB = np.array([[3.1338561, -1.6168667, -0.4906146], [-0.9787684, 1.9161415, 0.0334540], [0.0719453, -0.2289914, 1.4052427]])


def _s15(raw: bytes) -> float:
    return int.from_bytes(raw, signed=True) / 65536


def _tags(data: bytes) -> dict[str, bytes]:
    out = {}
    for k in range(min(int.from_bytes(data[128:132]), 100)):
        e = data[132 + 12 * k : 144 + 12 * k]
        at, size = int.from_bytes(e[4:8]), int.from_bytes(e[8:12])
        out[e[:4].decode("latin-1")] = data[at : at + size]
    return out


def _curve(raw: bytes, x: np.ndarray) -> np.ndarray:
    """A tone curve: identity, one power, a table, or a parametric curve."""
    if raw[:4] == b"curv":
        n = int.from_bytes(raw[8:12])
        if n == 0:
            return x
        values = np.frombuffer(raw[12 : 12 + 2 * n], ">u2").astype(float)
        return x ** (values[0] / 256) if n == 1 else np.interp(x, np.linspace(0, 1, n), values / 65535)
    if raw[:4] == b"para":
        kind = int.from_bytes(raw[8:10])
        p = [_s15(raw[12 + 4 * k : 16 + 4 * k]) for k in range((1, 3, 4, 5, 7)[kind])] + [0.0] * 7
        g, a, b, c, d, e, f = p[:7]
        if kind == 0:
            return x**g
        low = {1: 0.0 * x, 2: 0.0 * x + c, 3: c * x, 4: c * x + f}[kind]
        edge = d if kind >= 3 else (-b / a if a else 0)
        return np.where(x >= edge, np.maximum(a * x + b, 0) ** g + {1: 0.0, 2: c, 3: 0.0, 4: e}[kind], low)
    return x


def srgb_encode(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 0, 1)
    return np.where(x <= 0.0031308, 12.92 * x, 1.055 * x ** (1 / 2.4) - 0.055)


def icc_to_srgb(profile: bytes, values) -> np.ndarray:
    """Rows of components (0 to 1) as sRGB. RGB profiles need a matrix and tone curves; CMYK takes the plain formula."""
    x = np.atleast_2d(np.asarray(values, float))
    head = icc_profile(profile)
    if head is None:
        return np.zeros((len(x), 3))
    tags = _tags(profile)
    if head["space"] == "CMYK":
        return 1 - np.minimum(1, x[:, :3] + x[:, 3:4])
    if head["space"] == "GRAY":
        return np.repeat(srgb_encode(_curve(tags.get("kTRC", b""), x[:, 0]))[:, None], 3, 1)
    if all(t in tags for t in ("rXYZ", "gXYZ", "bXYZ", "rTRC", "gTRC", "bTRC")):
        linear = np.stack([_curve(tags[f"{c}TRC"], x[:, k]) for k, c in enumerate("rgb")], 1)
        columns = np.array([[_s15(tags[f"{c}XYZ"][8 + 4 * k : 12 + 4 * k]) for c in "rgb"] for k in range(3)])
        return srgb_encode(linear @ columns.T @ D50_TO_SRGB.T)
    return np.zeros((len(x), 3))


def to_rgb(doc, space, values: list[float]) -> tuple[float, float, float]:
    """A colour in any space as RGB; patterns are black."""
    space = doc.resolve(space)
    if isinstance(space, Name):
        n = {"DeviceGray": 1, "G": 1, "CalGray": 1, "DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "DeviceCMYK": 4, "CMYK": 4}.get(str(space), 0)
    else:
        kind = str(doc.resolve(space[0])) if isinstance(space, list) and space else ""
        if kind == "ICCBased":
            s = doc.resolve(space[1])
            profile = filters.decode_tolerant(s.raw, s.dict, doc.resolve)[0] if isinstance(s, Stream) else b""
            if icc_profile(profile):
                return tuple(icc_to_srgb(profile, [values])[0].tolist())
            n = doc.get(s, "N", int) or 0
        elif kind in ("CalGray", "CalRGB"):
            n = len(values)
        elif kind == "Lab":
            return lab_to_rgb(*values[:3])
        elif kind in ("Indexed", "I"):
            base, table = space[1], doc.resolve(space[3])
            table = doc.decoded(table) if isinstance(table, Stream) else table
            from quire.pdf.structure import components

            n = components(doc, base)
            k = int(values[0]) * n
            return to_rgb(doc, base, [b / 255 for b in table[k : k + n]]) if len(table) >= k + n else (0.0, 0.0, 0.0)
        elif kind in ("Separation", "DeviceN"):
            return to_rgb(doc, space[2], Function(doc, space[3])(list(values)))
        else:
            n = 0
    if n == 1:
        return (values[0],) * 3
    if n == 3:
        return tuple(values[:3])
    if n == 4:
        return tuple(1 - min(1.0, v + values[3]) for v in values[:3])
    return 0.0, 0.0, 0.0


def lab_to_rgb(lightness: float, a: float, b: float) -> tuple[float, float, float]:
    """CIE Lab (D50) as sRGB."""
    y = (lightness + 16) / 116
    back = lambda t: t**3 if t > 6 / 29 else 3 * (6 / 29) ** 2 * (t - 4 / 29)
    xyz = np.array([0.9642 * back(y + a / 500), back(y), 0.8249 * back(y - b / 200)])
    return tuple(srgb_encode(D50_TO_SRGB @ xyz).tolist())
