"""What all formats give: pages of text and metadata."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree


class FormatError(ValueError):
    """A file that its format cannot read."""


class Pages:
    """Pages (text, width, height) and metadata (title, author)."""

    def __init__(self, kind: str, texts: list[str], title: str | None = None, author: str | None = None, size: tuple[float, float] = (612.0, 792.0), sizes=None):
        self.kind, self.texts, self.title, self.author = kind, texts or [""], title, author
        self.sizes = sizes or [size] * len(self.texts)


def unzip(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise FormatError(f"not a ZIP file: {e}") from None


def parse_xml(data: bytes | str):
    """A tree; None for what is no XML. External entities are not read."""
    try:
        return ElementTree.fromstring(data)
    except (ElementTree.ParseError, ValueError):
        return None


def local(tag) -> str:
    """A tag without its namespace."""
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def find(root, name: str):
    return next((x for x in root.iter() if local(x.tag) == name), None) if root is not None else None


def find_all(root, name: str):
    return [x for x in root.iter() if local(x.tag) == name] if root is not None else []


def text_of(x) -> str:
    return "".join(x.itertext()) if x is not None else ""


def attribute(x, name: str) -> str | None:
    return next((v for k, v in x.attrib.items() if local(k) == name), None)


_BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li tr br hr blockquote section article header footer pre table ul ol dl dt dd figure".split())


def markup_text(source: str) -> str:
    """Text of XHTML: blocks start lines, scripts and styles are skipped; what is no XML is stripped of its tags."""
    root = parse_xml(re.sub(r"<!DOCTYPE[^>]*>", "", source).encode())
    if root is None:
        raw = re.sub(rf"(?i)</?(?:{'|'.join(sorted(_BLOCKS, key=len, reverse=True))})\b[^>]*>", "\n", source)
        import html

        return tidy(html.unescape(re.sub(r"<[^>]*>", "", raw)))
    out: list[str] = []

    def walk(x):
        name = local(x.tag).lower()
        if name in ("script", "style", "head"):
            return
        if name in _BLOCKS:
            out.append("\n")
        out.append(x.text or "")
        for kid in x:
            walk(kid)
            out.append(kid.tail or "")
        if name in _BLOCKS:
            out.append("\n")

    walk(root)
    return tidy("".join(out))


def tidy(text: str) -> str:
    """Runs of blanks as one, no blanks at line ends, no empty lines."""
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def natural_key(name: str) -> str:
    return re.sub(r"\d+", lambda m: m[0].rjust(20, "0"), name).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
