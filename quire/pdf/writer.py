"""Writing documents: serialisation, building pages, and changing what is there."""

from __future__ import annotations

import hashlib
import json
import zlib

from quire.pdf import filters
from quire.pdf.crypt import make_security
from quire.pdf.document import Document
from quire.pdf.syntax import Name, PdfError, Ref, Stream, references, text_string, write_number, write_object

#: Permission bits of the standard security handler.
PERMISSIONS = {"print": 4, "modify": 8, "copy": 16, "annotate": 32, "fill_forms": 256, "extract_accessible": 512, "assemble": 1024, "print_high": 2048}


def serialize(objects: dict[int, object], root: Ref, info: Ref | None = None, version: str = "1.7", encrypt: dict | None = None, xref_stream: bool = False, pack: bool = False) -> bytes:
    """A whole file. encrypt: method, user, owner, permissions. pack puts plain objects into object streams."""
    ids = hashlib.md5(b"".join(write_object(objects[n]) for n in sorted(objects))).digest()
    objects, security = dict(objects), None
    if encrypt:
        d, security = make_security(encrypt.get("method", "AES-128"), encrypt.get("user", ""), encrypt.get("owner", ""), encrypt.get("permissions", -1), ids)
        encrypt_ref = Ref(max(objects, default=0) + 1)
        objects[encrypt_ref.num] = d
    out, offsets, packed = [b"%PDF-" + version.encode() + b"\n%\xe2\xe3\xcf\xd3\n"], {}, {}
    at = len(out[0])
    if pack:
        xref_stream = True
        plain = [n for n in sorted(objects) if not isinstance(objects[n], Stream) and not (encrypt and n == encrypt_ref.num)]
        for k in range(0, len(plain), 100):
            group, body, heads = plain[k : k + 100], b"", []
            number = max(objects) + 1
            for j, n in enumerate(group):
                heads.append(b"%d %d" % (n, len(body)))
                body += write_object(objects[n]) + b" "
                packed[n] = number, j
            head = b" ".join(heads) + b" "
            objects[number] = Stream({"Type": Name("ObjStm"), "N": len(group), "First": len(head), "Filter": Name("FlateDecode")}, zlib.compress(head + body))
    for n in sorted(objects):
        if n in packed:
            continue
        value = objects[n]
        if security and n != encrypt_ref.num:
            value = security.convert(value, Ref(n), encrypt=True)
        piece = b"%d 0 obj\n" % n + write_object(value) + b"\nendobj\n"
        offsets[n] = at
        out.append(piece)
        at += len(piece)
    trailer: dict = {"Root": root, "ID": [ids, ids]}
    if info:
        trailer["Info"] = info
    if encrypt:
        trailer["Encrypt"] = encrypt_ref
    size = max(objects, default=0) + 1
    if xref_stream:
        offsets[size] = at
        rows = [b"\x00" + bytes(6)]
        for n in range(1, size + 1):
            if n in packed:
                rows.append(b"\x02" + packed[n][0].to_bytes(4) + packed[n][1].to_bytes(2))
            else:
                rows.append(b"\x01" + offsets[n].to_bytes(4) + bytes(2) if n in offsets else b"\x00" + bytes(6))
        s = Stream(trailer | {"Type": Name("XRef"), "Size": size + 1, "W": [1, 4, 2], "Filter": Name("FlateDecode")}, zlib.compress(b"".join(rows)))
        out.append(b"%d 0 obj\n" % size + write_object(s) + b"\nendobj\n")
    else:
        out.append(b"xref\n0 %d\n0000000000 65535 f \n" % size)
        out += [b"%010d 00000 n \n" % offsets[n] if n in offsets else b"0000000000 65535 f \n" for n in range(1, size)]
        out.append(b"trailer\n" + write_object(trailer | {"Size": size}) + b"\n")
    out.append(b"startxref\n%d\n%%%%EOF\n" % at)
    return b"".join(out)


class PageBuilder:
    """The content of a page that is being made."""

    def __init__(self, width: float = 612, height: float = 792):
        self.width, self.height, self.parts = width, height, []
        self.fonts: dict[str, str] = {}
        self.images: dict[str, Stream] = {}

    def _op(self, *args) -> PageBuilder:
        self.parts.append(b" ".join(a if isinstance(a, bytes) else write_number(a) for a in args))
        return self

    def font(self, name: str) -> str:
        return self.fonts.setdefault(name, f"F{len(self.fonts) + 1}")

    def text(self, x: float, y: float, text: str, size: float = 12, font: str = "Helvetica") -> PageBuilder:
        raw = text.encode("cp1252", "replace")
        return self._op(b"BT /" + self.font(font).encode(), size, b"Tf", x, y, b"Td", write_object(raw), b"Tj ET")

    def lines(self, x: float, y: float, lines: list[str], size: float = 10, leading: float = 12, font: str = "Courier") -> PageBuilder:
        self._op(b"BT /" + self.font(font).encode(), size, b"Tf", leading, b"TL", x, y, b"Td")
        for line in lines:
            self._op(write_object(line.encode("cp1252", "replace")), b"Tj T*")
        return self._op(b"ET")

    def line(self, x0, y0, x1, y1, width=1.0) -> PageBuilder:
        return self._op(width, b"w", x0, y0, b"m", x1, y1, b"l S")

    def rect(self, x, y, w, h, fill: tuple | None = None) -> PageBuilder:
        if fill is None:
            return self._op(x, y, w, h, b"re S")
        return self._op(b"q", *fill, b"rg", x, y, w, h, b"re f Q")

    def image(self, name: str, image: Stream, x, y, w, h) -> PageBuilder:
        self.images[name] = image
        return self._op(b"q", w, 0, 0, h, x, y, b"cm /" + name.encode() + b" Do Q")

    def inline_image(self, w: int, h: int, rgb: bytes, x, y, dw, dh) -> PageBuilder:
        body = filters.hex_encode(rgb)
        return self._op(b"q", dw, 0, 0, dh, x, y, b"cm BI /W", w, b"/H", h, b"/CS /RGB /BPC 8 /F /AHx ID " + body + b" EI Q")


class Builder:
    """A new document made of pages."""

    def __init__(self, version: str = "1.7"):
        self.version, self.objects, self.kids = version, {1: {}, 2: {}}, []
        self.info: dict = {}
        self._fonts: dict[str, Ref] = {}
        self._xmp: Ref | None = None

    def add(self, value) -> Ref:
        ref = Ref(max(self.objects) + 1)
        self.objects[ref.num] = value
        return ref

    def standard_font(self, name: str) -> Ref:
        if name not in self._fonts:
            self._fonts[name] = self.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(name), "Encoding": Name("WinAnsiEncoding")})
        return self._fonts[name]

    def page(self, p: PageBuilder, compress: bool = True, **entries) -> Ref:
        body = b"\n".join(p.parts)
        content = self.add(Stream({"Filter": Name("FlateDecode")}, filters.flate_encode(body)) if compress else Stream({}, body))
        resources: dict = {"Font": {key: self.standard_font(name) for name, key in p.fonts.items()}} if p.fonts else {}
        if p.images:
            resources["XObject"] = {name: self.add(s) for name, s in p.images.items()}
        ref = self.add({"Type": Name("Page"), "Parent": Ref(2), "MediaBox": [0, 0, p.width, p.height], "Resources": resources, "Contents": content, **entries})
        self.kids.append(ref)
        return ref

    def set_info(self, **entries: str) -> None:
        self.info |= {k: text_string(v) for k, v in entries.items() if v is not None}

    def set_xmp(self, xml: str) -> None:
        self._xmp = self.add(Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, xml.encode()))

    def build(self, **options) -> bytes:
        self.objects[1] = {"Type": Name("Catalog"), "Pages": Ref(2)} | self.objects[1] | ({"Metadata": self._xmp} if self._xmp else {})
        self.objects[2] = {"Type": Name("Pages"), "Kids": list(self.kids), "Count": len(self.kids)}
        info = self.add(self.info) if self.info else None
        return serialize(self.objects, Ref(1), info, self.version, **options)


def rgb_image(width: int, height: int, rgb: bytes) -> Stream:
    return Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "ColorSpace": Name("DeviceRGB"), "BitsPerComponent": 8, "Filter": Name("FlateDecode")}, zlib.compress(rgb))


def jpeg_image(data: bytes) -> Stream:
    size = filters.jpeg_size(data)
    if size is None:
        raise PdfError("not a JPEG")
    space = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}.get(size[2], "DeviceRGB")
    return Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": size[0], "Height": size[1], "ColorSpace": Name(space), "BitsPerComponent": 8, "Filter": Name("DCTDecode")}, data)


def lines_to_pdf(pages: list[list[str]], title: str | None = None, **options) -> bytes:
    """Pages of text lines as a document: 612 x 792, Courier 10 on 12, margin 72."""
    b = Builder()
    for lines in pages:
        b.page(PageBuilder().lines(72, 792 - 72 - 10, lines))
    if title is not None:
        b.set_info(Title=title)
    return b.build(**options)


def _replaced(x, numbers: dict[int, int]):
    if isinstance(x, Ref):
        return Ref(numbers[x.num]) if x.num in numbers else None
    if isinstance(x, Stream):
        return Stream(_replaced(x.dict, numbers), x.raw)
    if isinstance(x, dict):
        return {k: _replaced(v, numbers) for k, v in x.items()}
    if isinstance(x, list):
        return [_replaced(v, numbers) for v in x]
    return x


class Editor:
    """All objects of a document, copied so that they can be changed and written again."""

    def __init__(self, doc: Document):
        if doc.locked:
            raise PdfError("the document is locked")
        self.version, self.objects = doc.version, {}
        encrypt = doc.trailer.get("Encrypt")
        for ref in doc.refs():
            if isinstance(encrypt, Ref) and encrypt.num == ref.num:
                continue
            try:
                value = doc.resolve(ref)
            except PdfError:
                continue
            if isinstance(value, Stream) and value.dict.get("Type") in ("XRef", "ObjStm"):
                continue
            self.objects[ref.num] = value
        self.root, self.info = doc.trailer["Root"], doc.trailer.get("Info")
        self.info = self.info if isinstance(self.info, Ref) else None
        self._flatten(doc)

    def _flatten(self, doc: Document) -> None:
        """One level of pages, each with what it inherited."""
        top = doc.catalog.get("Pages")
        self.top = top if isinstance(top, Ref) else self.add({})
        kids = []
        for page in doc.pages():
            ref = page.pop("__ref")
            ref = ref if isinstance(ref, Ref) else self.add({})
            self.objects[ref.num] = page | {"Parent": self.top}
            kids.append(ref)
        self.objects[self.top.num] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}

    def add(self, value) -> Ref:
        ref = Ref(max(self.objects, default=0) + 1)
        self.objects[ref.num] = value
        return ref

    @property
    def kids(self) -> list[Ref]:
        return self.objects[self.top.num]["Kids"]

    def set_kids(self, kids: list[Ref]) -> None:
        self.objects[self.top.num] = self.objects[self.top.num] | {"Kids": kids, "Count": len(kids)}

    def delete_page(self, index: int) -> None:
        if not 0 <= index < len(self.kids):
            raise PdfError(f"no page {index}")
        self.set_kids(self.kids[:index] + self.kids[index + 1 :])

    def insert_page(self, index: int, page: dict) -> Ref:
        ref = self.add(page | {"Type": Name("Page"), "Parent": self.top})
        self.set_kids(self.kids[:index] + [ref] + self.kids[index:])
        return ref

    def reorder(self, order: list[int]) -> None:
        """Pages by index; indices out of range are dropped. One that repeats is copied, for a page stands once in the tree."""
        kids, used = [], set()
        for k in (k for k in order if 0 <= k < len(self.kids)):
            ref = self.kids[k]
            kids.append(self.add(dict(self.objects[ref.num])) if ref.num in used else ref)
            used.add(ref.num)
        self.set_kids(kids)

    def rotate(self, index: int, degrees: int) -> None:
        n = self.kids[index].num
        self.objects[n] = self.objects[n] | {"Rotate": degrees % 360}

    def set_info(self, key: str, value: str) -> None:
        if self.info is None:
            self.info = self.add({})
        self.objects[self.info.num] = dict(self.objects.get(self.info.num) or {}) | {key: text_string(value)}

    def reachable(self) -> set[int]:
        seen: set[int] = set()
        todo = [r.num for r in (self.root, self.info) if r]
        while todo:
            n = todo.pop()
            if n not in seen and n in self.objects:
                seen.add(n)
                todo += [r.num for r in references(self.objects[n])]
        return seen

    def garbage_collect(self) -> int:
        """Drop what neither the catalog nor Info reaches; the number of objects dropped."""
        keep = self.reachable()
        gone = len(self.objects) - len(keep)
        self.objects = {n: v for n, v in self.objects.items() if n in keep}
        return gone

    def _merge_equal(self, key_of) -> int:
        first: dict = {}
        numbers = {}
        for n in sorted(self.objects):
            key = key_of(n)
            numbers[n] = n if key is None else first.setdefault(key, n)
        gone = {n for n, to in numbers.items() if n != to}
        if gone:
            self.objects = {n: _replaced(v, numbers) for n, v in self.objects.items() if n not in gone}
        return len(gone)

    def dedup_streams(self, data_only: bool = False) -> int:
        """Merge streams with equal data (and, unless data_only, equal dictionaries)."""

        def key(n):
            s = self.objects[n]
            if not isinstance(s, Stream):
                return None
            return hashlib.sha256(s.raw).digest() + (b"" if data_only else write_object({k: v for k, v in s.dict.items() if k != "Length"}))

        return self._merge_equal(key)

    def dedup_objects(self) -> int:
        """Merge objects with equal text, except pages and the roots."""
        fixed = {self.root.num, self.top.num, *(k.num for k in self.kids)} | ({self.info.num} if self.info else set())
        return self._merge_equal(lambda n: None if n in fixed or isinstance(self.objects[n], Stream) else write_object(self.objects[n]))

    def remove_nulls(self) -> int:
        used = {r.num for v in self.objects.values() for r in references(v)}
        gone = [n for n, v in self.objects.items() if v is None and n not in used]
        for n in gone:
            del self.objects[n]
        return len(gone)

    def compact(self) -> None:
        """Renumber objects from 1 without gaps."""
        numbers = {n: k + 1 for k, n in enumerate(sorted(self.objects))}
        self.objects = {numbers[n]: _replaced(v, numbers) for n, v in self.objects.items()}
        self.root, self.top = Ref(numbers[self.root.num]), Ref(numbers[self.top.num])
        self.info = Ref(numbers[self.info.num]) if self.info and self.info.num in numbers else None

    def clean(self) -> dict[str, int]:
        counts = {"collected": self.garbage_collect(), "streams": self.dedup_streams(), "objects": self.dedup_objects(), "nulls": self.remove_nulls()}
        self.compact()
        return counts

    def build(self, **options) -> bytes:
        return serialize(self.objects, self.root, self.info, self.version, **options)


def merge(docs: list[Document]) -> bytes:
    """The pages of all documents, in order, with what they inherited; shared objects are copied once for each document."""
    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2)}}
    kids: list[Ref] = []
    for doc in docs:
        e = Editor(doc)
        wanted, todo = set(), [k.num for k in e.kids]
        while todo:
            n = todo.pop()
            if n in wanted or n not in e.objects or n == e.top.num:
                continue
            wanted.add(n)
            value = e.objects[n]
            todo += [r.num for r in references({k: v for k, v in value.items() if k != "Parent"} if isinstance(value, dict) else value)]
        numbers = {n: max(objects, default=2) + 1 + k + (2 not in objects) for k, n in enumerate(sorted(wanted))}
        numbers[e.top.num] = 2
        objects[2] = {}
        for n in sorted(wanted):
            objects[numbers[n]] = _replaced(e.objects[n], numbers)
        kids += [Ref(numbers[k.num]) for k in e.kids]
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    return serialize(objects, Ref(1))


def extract_pages(doc: Document, indices: list[int]) -> bytes:
    """Pages by index; those out of range are dropped, and a page that repeats gets a copy of its own."""
    e = Editor(doc)
    e.reorder(indices)
    seen, kids = set(), []
    for k in e.kids:
        kids.append(e.add(dict(e.objects[k.num])) if k.num in seen else k)
        seen.add(k.num)
    e.set_kids(kids)
    e.garbage_collect()
    e.compact()
    return e.build()


def incremental(data: bytes, doc: Document, changed: dict[int, object]) -> bytes:
    """The file with changed objects appended as a new section; the old bytes stay as they are."""
    out, offsets = data + (b"" if data.endswith(b"\n") else b"\n"), {}
    for n in sorted(changed):
        offsets[n] = len(out)
        out += b"%d 0 obj\n" % n + write_object(changed[n]) + b"\nendobj\n"
    at = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, o) for n, o in sorted(offsets.items()))
    size = max([*changed, *(r.num for r in doc.refs())], default=0) + 1
    trailer = {k: v for k, v in doc.trailer.items() if k in ("Root", "Info", "ID")} | {"Size": size, "Prev": doc._startxref()}
    return out + b"trailer\n" + write_object(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at


#: Presets of compress: Flate level, whether to strip metadata, whether to pack objects, quality of images (None: as they are), dots per inch at most, and bytes below which an image stays.
PRESETS = {
    "low": (6, False, False, None, None, 0), "medium": (7, False, False, 75, None, 10_000),
    "high": (9, True, True, 65, 150.0, 5_000), "extreme": (9, True, True, 40, 96.0, 2_000),
}


def _shown_sizes(doc: Document) -> dict[int, tuple[float, float]]:
    """The largest size in points at which each image object is drawn."""
    from quire.pdf import content

    out: dict[int, tuple[float, float]] = {}
    for page in doc.pages():
        named = doc.get(doc.resolve(page.get("Resources")), "XObject", dict) or {}
        for name, (w, h) in content.image_sizes(doc, page).items():
            ref = named.get(name)
            if isinstance(ref, Ref):
                before = out.get(ref.num, (0.0, 0.0))
                out[ref.num] = max(w, before[0]), max(h, before[1])
    return out


def target_size(width: int, height: int, shown: tuple[float, float] | None, dpi: float | None) -> tuple[int, int]:
    """An image's size at no more than dpi; 14 inches are assumed for one that is not shown."""
    if not dpi:
        return width, height
    if shown and shown[0] > 0 and shown[1] > 0:
        scale = dpi / max(width * 72 / shown[0], height * 72 / shown[1])
    else:
        scale = int(dpi * 14) / max(width, height)
    return (width, height) if scale >= 1 else (max(1, round(width * scale)), max(1, round(height * scale)))


def _recode_images(doc: Document, e: Editor, quality: int, dpi: float | None, least: int, stats: dict) -> None:
    """Images as JPEG where that is smaller. Masks, images with a soft mask, CMYK and what cannot be decoded stay."""
    from quire.pdf import jpeg, render, structure

    shown = _shown_sizes(doc) if dpi else {}
    for n, s in list(e.objects.items()):
        if not isinstance(s, Stream) or s.dict.get("Subtype") != "Image":
            continue
        space = s.dict.get("ColorSpace")
        plain = not any(doc.resolve(s.dict.get(k)) for k in ("ImageMask", "SMask", "Mask")) and structure.components(doc, space) != 4
        pixels = render.image_pixels(doc, s) if plain and len(s.raw) >= max(least, 1) else None
        if pixels is None:
            stats["images_skipped"] += 1
            continue
        h, w = pixels.shape[:2]
        size = target_size(w, h, shown.get(n), dpi)
        small = jpeg.encode(render.resized(pixels, *size) if size != (w, h) else pixels, quality)
        if len(small) >= len(s.raw):
            stats["images_skipped"] += 1
            continue
        e.objects[n] = Stream({
            "Type": Name("XObject"), "Subtype": Name("Image"), "Width": size[0], "Height": size[1], "BitsPerComponent": 8,
            "ColorSpace": Name("DeviceRGB"), "Filter": Name("DCTDecode"),
        }, small)
        stats["images_recompressed"] += 1
        stats["images_downscaled"] += size != (w, h)


def compress(data: bytes, preset: str = "medium") -> tuple[bytes, dict]:
    """A smaller file and what was done."""
    if preset not in PRESETS:
        raise PdfError(f"no preset {preset}")
    level, strip, pack, quality, dpi, least = PRESETS[preset]
    doc = Document(data)
    if doc.encrypted:
        raise PdfError("encrypted documents are not compressed")
    e, stats = Editor(doc), {"before": len(data), "raw_streams": 0, "recompressed": 0, "stripped": 0, "images_recompressed": 0, "images_downscaled": 0, "images_skipped": 0}
    if quality:
        _recode_images(doc, e, quality, dpi, least, stats)
    for n, s in list(e.objects.items()):
        if not isinstance(s, Stream):
            continue
        names = [name for name, _ in filters.chain(s.dict, doc.resolve)]
        if not names and s.dict.get("Type") != "Metadata":
            small = filters.flate_encode(s.raw, level)
            if len(small) < len(s.raw):
                e.objects[n] = Stream(s.dict | {"Filter": Name("FlateDecode")}, small)
                stats["raw_streams"] += 1
        elif names == ["FlateDecode"]:
            try:
                small = filters.flate_encode(filters.flate_decode(s.raw), level)
            except PdfError:
                continue
            if len(small) < len(s.raw):
                e.objects[n] = Stream(s.dict, small)
                stats["recompressed"] += 1
    if strip:
        catalog = e.objects[e.root.num]
        for key in ("Metadata", "PieceInfo", "SpiderInfo"):
            stats["stripped"] += catalog.pop(key, None) is not None
        for k in e.kids:
            for key in ("Metadata", "PieceInfo", "Thumb"):
                stats["stripped"] += e.objects[k.num].pop(key, None) is not None
    stats |= e.clean()
    out = e.build(pack=pack)
    out = out if len(out) < len(data) else data
    return out, stats | {"after": len(out)}


class Journal:
    """A log of operations with undo and redo; its state is the fold of what is not undone."""

    def __init__(self, log: list[dict] | None = None, at: int | None = None):
        self.log = log or []
        self.at = len(self.log) if at is None else at
        self._batch: list[dict] | None = None

    def record(self, key: str, before, after) -> None:
        op = {"key": key, "before": before, "after": after}
        if self._batch is not None:
            self._batch.append(op)
            return
        self.log[self.at :] = [{"ops": [op]}]
        self.at += 1

    def begin(self) -> None:
        self._batch = []

    def end(self) -> None:
        ops, self._batch = self._batch or [], None
        if ops:
            self.log[self.at :] = [{"ops": ops}]
            self.at += 1

    def undo(self) -> list[dict]:
        """The inverse operations of the last step, in the order to apply them."""
        if not self.at:
            return []
        self.at -= 1
        return [{"key": o["key"], "before": o["after"], "after": o["before"]} for o in reversed(self.log[self.at]["ops"])]

    def redo(self) -> list[dict]:
        if self.at == len(self.log):
            return []
        self.at += 1
        return list(self.log[self.at - 1]["ops"])

    def state(self) -> dict:
        out: dict = {}
        for step in self.log[: self.at]:
            for o in step["ops"]:
                out[o["key"]] = o["after"]
        return {k: v for k, v in out.items() if v is not None}

    def to_bytes(self) -> bytes:
        return json.dumps({"log": self.log, "at": self.at}).encode()

    @classmethod
    def from_bytes(cls, data: bytes) -> Journal:
        x = json.loads(data)
        return cls(x["log"], x["at"])
