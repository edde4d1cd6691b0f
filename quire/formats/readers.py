"""EPUB, Office, XPS, CBZ, MOBI, FB2, SVG and plain text."""

from __future__ import annotations

import posixpath
import re
import struct
import urllib.parse
import zlib

from quire.formats.common import FormatError, Pages, attribute, find, find_all, local, markup_text, natural_key, parse_xml, text_of, tidy, unzip
from quire.operators.pages import PAGE_LINES, wrap


def _paged(text: str) -> list[str]:
    lines = wrap(text)
    return ["\n".join(lines[k : k + PAGE_LINES]) for k in range(0, len(lines), PAGE_LINES)] or [""]


def plain_text(data: bytes) -> Pages:
    return Pages("PlainText", _paged(data.decode("utf-8", "replace")))


def epub(data: bytes) -> Pages:
    """A page for each chapter, in the order of the spine. A protected book is an error."""
    z = unzip(data)
    names = set(z.namelist())
    if "META-INF/encryption.xml" in names or "META-INF/rights.xml" in names:
        raise FormatError("the book is protected")
    rootfile = find(parse_xml(z.read("META-INF/container.xml")) if "META-INF/container.xml" in names else None, "rootfile")
    path = attribute(rootfile, "full-path") if rootfile is not None else next((n for n in sorted(names) if n.endswith(".opf")), None)
    if path not in names:
        raise FormatError("no package file")
    opf = parse_xml(z.read(path))
    if opf is None:
        raise FormatError("the package file is no XML")
    base = posixpath.dirname(path)
    manifest = {i.get("id"): posixpath.normpath(posixpath.join(base, urllib.parse.unquote(i.get("href", "")))) for i in find_all(opf, "item")}
    chapters = [manifest[r.get("idref")] for r in find_all(opf, "itemref") if r.get("idref") in manifest]
    texts = [markup_text(z.read(c).decode("utf-8", "replace")) for c in chapters if c in names]
    return Pages("Epub", texts, text_of(find(opf, "title")).strip() or None, text_of(find(opf, "creator")).strip() or None)


def _core(z) -> tuple[str | None, str | None]:
    core = parse_xml(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else None
    return text_of(find(core, "title")).strip() or None, text_of(find(core, "creator")).strip() or None


def docx(data: bytes) -> Pages:
    z = unzip(data)
    if "word/document.xml" not in z.namelist():
        raise FormatError("no word/document.xml")
    out = []
    for p in find_all(parse_xml(z.read("word/document.xml")), "p"):
        parts = []
        for x in p.iter():
            name = local(x.tag)
            parts.append((x.text or "") if name == "t" else "\t" if name == "tab" and x is not p else "\n" if name in ("br", "cr") else "")
        out.append("".join(parts))
    return Pages("Docx", ["\n".join(out)], *_core(z))


def column_number(cell: str) -> int:
    """A1 is 0, Z1 25, AA1 26."""
    n = 0
    for c in re.match(r"[A-Za-z]*", cell or "")[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_cells(data: bytes) -> list[tuple[str, int, int, str]]:
    """(sheet file, row, column, text) of all cells with text; sheets by their files' names as text."""
    z = unzip(data)
    shared = [text_of_runs(si) for si in find_all(parse_xml(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in z.namelist() else []
    out = []
    for sheet in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
        for r, row in enumerate(find_all(parse_xml(z.read(sheet)), "row")):
            for k, c in enumerate(x for x in row if local(x.tag) == "c"):
                kind, v = c.get("t"), find(c, "v")
                if kind == "inlineStr":
                    text = text_of_runs(find(c, "is"))
                elif kind == "s" and v is not None and (v.text or "").strip().isdigit():
                    index = int(v.text)
                    text = shared[index] if index < len(shared) else ""
                else:
                    text = text_of(v)
                out.append((sheet, r, column_number(c.get("r")) if c.get("r") else k, text))
    return out


def text_of_runs(x) -> str:
    return "".join(t.text or "" for t in find_all(x, "t"))


def xlsx(data: bytes) -> Pages:
    """A page for each sheet: rows of cells divided by tabs."""
    z = unzip(data)
    sheets: dict[str, dict[int, dict[int, str]]] = {n: {} for n in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n))}
    if not sheets:
        raise FormatError("no worksheets")
    for sheet, r, c, text in xlsx_cells(data):
        sheets[sheet].setdefault(r, {})[c] = text
    texts = ["\n".join("\t".join(row.get(c, "") for c in range(max(row) + 1)) for _, row in sorted(rows.items())) for rows in sheets.values()]
    return Pages("Xlsx", texts, *_core(z))


def pptx(data: bytes) -> Pages:
    """A page for each slide, by number."""
    z = unzip(data)
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    if not slides:
        raise FormatError("no slides")
    texts = ["\n".join(t for p in find_all(parse_xml(z.read(n)), "p") if (t := text_of_runs(p))) for _, n in slides]
    return Pages("Pptx", texts, *_core(z))


def xps(data: bytes) -> Pages:
    """Fixed pages by way of the document sequence; glyph runs, one a line; sizes from 1/96 inch to points."""
    z = unzip(data)
    names = {n.lower(): n for n in z.namelist()}

    def read(path):
        real = names.get(path.lstrip("/").lower())
        return parse_xml(z.read(real)) if real else None

    def target(base, ref):
        return posixpath.normpath(posixpath.join("/", posixpath.dirname(base), ref))

    start = next((n for n in names if n.endswith(".fdseq")), None)
    if start is None:
        raise FormatError("no document sequence")
    texts, sizes = [], []
    for d in find_all(read(start), "DocumentReference"):
        doc = target(start, d.get("Source", ""))
        for p in find_all(read(doc), "PageContent"):
            page = read(target(doc, p.get("Source", "")))
            if page is not None:
                runs = [(g.get("UnicodeString") or "") for g in find_all(page, "Glyphs")]
                texts.append("\n".join(r[2:] if r.startswith("{}") else r for r in runs if r))
                sizes.append((float(page.get("Width", 816)) * 0.75, float(page.get("Height", 1056)) * 0.75))
    return Pages("Xps", texts, sizes=sizes or None)


IMAGES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tif", ".tiff")


def image_size(data: bytes) -> tuple[int, int] | None:
    if data.startswith(b"\x89PNG\r\n\x1a\n") and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    from quire.pdf.filters import jpeg_size

    size = jpeg_size(data)
    return size[:2] if size else None


def cbz(data: bytes) -> Pages:
    """A page for each image, by natural order of names."""
    z = unzip(data)
    pages = sorted((n for n in z.namelist() if n.lower().endswith(IMAGES) and not n.startswith("__MACOSX")), key=natural_key)
    if not pages:
        raise FormatError("no images")
    return Pages("Cbz", [""] * len(pages), sizes=[tuple(map(float, image_size(z.read(n)) or (612, 792))) for n in pages])


def palmdoc(data: bytes) -> bytes:
    """PalmDOC decompression: literals, pairs of distance and length, and a space with a letter."""
    out, at = bytearray(), 0
    while at < len(data):
        c = data[at]
        at += 1
        if c == 0 or 9 <= c <= 0x7F:
            out.append(c)
        elif c <= 8:
            out += data[at : at + c]
            at += c
        elif c >= 0xC0:
            out += bytes([32, c ^ 0x80])
        elif at < len(data):
            pair = (c << 8 | data[at]) & 0x3FFF
            at += 1
            distance, n = pair >> 3, (pair & 7) + 3
            if not 0 < distance <= len(out):
                raise FormatError("bad distance")
            for _ in range(n):
                out.append(out[-distance])
    return bytes(out)


_LINE_TAGS = frozenset("p /p br br/ div /div h1 /h1 h2 /h2 h3 /h3".split())


def strip_markup(source: str) -> str:
    """Text of loose markup; a stray > is a tag's end like any other."""
    out, tag, inside, naming = [], "", False, False
    for c in source:
        if c == "<":
            tag, inside, naming = "", True, True
        elif c == ">":
            inside = naming = False
            if tag.lower() in _LINE_TAGS:
                out.append("\n")
        elif not inside:
            out.append(c)
        elif naming and not c.isspace():
            tag += c
        else:
            naming = False
    text = "".join(out)
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&#39;", "'")):
        text = text.replace(a, b)
    return re.sub(r"[\r\n]+", "\n", text).strip()


def mobi(data: bytes) -> Pages:
    """Text records, plain or PalmDOC, stripped of markup and paginated."""
    if len(data) < 86 or data[60:68] not in (b"BOOKMOBI", b"TEXtREAd"):
        raise FormatError("not a MOBI file")
    n = struct.unpack(">H", data[76:78])[0]
    offsets = [struct.unpack(">I", data[78 + 8 * k : 82 + 8 * k])[0] for k in range(n)] + [len(data)]
    records = [data[a:b] for a, b in zip(offsets, offsets[1:])]
    if not records or len(records[0]) < 16:
        raise FormatError("no header record")
    kind, _, size, count = struct.unpack(">HHIH", records[0][:10])
    if kind not in (1, 2):
        raise FormatError(f"compression {kind}")
    body = b"".join(palmdoc(r) if kind == 2 else r for r in records[1 : 1 + count])[: size or None]
    utf8 = len(records[0]) >= 32 and struct.unpack(">I", records[0][28:32])[0] == 65001
    title = data[:32].split(b"\0")[0].decode("latin-1").strip() or None
    return Pages("Mobi", _paged(strip_markup(body.decode("utf-8" if utf8 else "cp1252", "replace"))), title)


def fb2(data: bytes) -> Pages:
    """A page for each section, nested ones after the one that holds them."""
    root = parse_xml(data)
    if root is None or local(root.tag) != "FictionBook":
        raise FormatError("not an FB2 file")
    texts: list[str] = []

    def walk(section):
        own = [tidy(text_of(x)) for x in section if local(x.tag) != "section"]
        if any(own):
            texts.append("\n".join(t for t in own if t))
        for x in section:
            if local(x.tag) == "section":
                walk(x)

    for body in find_all(root, "body"):
        for x in body:
            if local(x.tag) == "section":
                walk(x)
    info = find(root, "title-info")
    author = find(info, "author")
    name = " ".join(text_of(x).strip() for x in (author if author is not None else ()) if local(x.tag) in ("first-name", "middle-name", "last-name"))
    return Pages("Fb2", texts, text_of(find(info, "book-title")).strip() or None, name or None)


def _length(value: str | None, default: float) -> float:
    m = re.match(r"\s*([\d.]+)\s*(px|pt|mm|cm|in)?", value or "")
    return float(m[1]) * {"px": 0.75, "pt": 1, "mm": 72 / 25.4, "cm": 72 / 2.54, "in": 72, None: 1}[m[2]] if m else default


def svg(data: bytes) -> Pages:
    """Text of the text elements, one a line."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, 31)
    root = parse_xml(data)
    if root is None or local(root.tag) != "svg":
        raise FormatError("not an SVG file")
    box = [float(v) for v in re.findall(r"-?[\d.]+", root.get("viewBox") or "")]
    size = _length(root.get("width"), box[2] if len(box) == 4 else 612.0), _length(root.get("height"), box[3] if len(box) == 4 else 792.0)
    texts = [" ".join(text_of(t).split()) for t in find_all(root, "text")]
    return Pages("Svg", ["\n".join(t for t in texts if t)], text_of(find(root, "title")).strip() or None, size=size)


READERS = {"PlainText": plain_text, "Epub": epub, "Docx": docx, "Xlsx": xlsx, "Pptx": pptx, "Xps": xps, "Cbz": cbz, "Mobi": mobi, "Fb2": fb2, "Svg": svg}


def pdf_pages(data: bytes) -> Pages:
    from quire.pdf import content, layout
    from quire.pdf.document import open_document

    doc = open_document(data)
    if doc.locked:
        raise FormatError("the document is locked")
    pages = doc.pages()
    texts = [layout.plain_text(layout.blocks_of(layout.lines_of(layout.words_of(content.page_chars(doc, p))))) for p in pages]
    boxes = [doc.page_boxes(p)["media_box"] for p in pages]
    info = doc.metadata()
    return Pages("Pdf", texts, info.get("Title"), info.get("Author"), sizes=[(b[2] - b[0], b[3] - b[1]) for b in boxes] or None)


def read(data: bytes, kind: str) -> Pages:
    reader = pdf_pages if kind == "Pdf" else READERS.get(kind)
    if reader is None:
        raise FormatError(f"no reader for {kind}")
    return reader(data)


def to_pdf(pages: Pages) -> bytes:
    """The pages' text as a document."""
    from quire.pdf import writer

    b = writer.Builder()
    for text, (w, h) in zip(pages.texts, pages.sizes):
        b.page(writer.PageBuilder(w, h).lines(72, h - 82, text.split("\n")))
    b.set_info(Title=pages.title, Author=pages.author)
    return b.build()
