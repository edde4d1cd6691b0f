"""Reading a document: cross references, objects, repair, pages and metadata."""

from __future__ import annotations

import re

from quire.pdf import filters
from quire.pdf.crypt import Security
from quire.pdf.syntax import EOF, Keyword, Lexer, Name, PdfError, Ref, Stream, indirect_object, read_text, references

_HEADER = re.compile(rb"%PDF-(\d+)\.(\d+)")
_OBJ = re.compile(rb"(?:^|[\r\n])[\t\x0c ]*(\d+)[\t\n\x0c\r ]+(\d+)[\t\n\x0c\r ]+obj(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
INFO_KEYS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")
DEFAULT_BOX = [0, 0, 612, 792]


class Document:
    """A parsed document. Objects are read when first asked for."""

    def __init__(self, data: bytes, password: str | bytes = b""):
        m = _HEADER.search(data[:1024]) if len(data) >= 8 else None
        if not m:
            raise PdfError("NotPdf")
        self.data, self.version = data, f"{int(m[1])}.{int(m[2])}"
        self.base = m.start()
        self.entries: dict[int, tuple] = {}  # number: ("n", offset, gen), ("c", stream, index) or ("f",)
        self.trailer: dict = {}
        self.repaired = False
        self.security: Security | None = None
        self._objects: dict[int, object] = {}
        self._packed: dict[int, list[int] | dict[int, object]] = {}
        self._resolving: set[int] = set()
        self._load(self._startxref())
        self._unlock(password)

    # --- cross references ---

    def _startxref(self) -> int:
        at = self.data.rfind(b"startxref", max(0, len(self.data) - 1024))
        if at < 0:
            raise PdfError("no startxref")
        value = Lexer(self.data, at + 9).token()
        if not isinstance(value, int) or isinstance(value, bool):
            raise PdfError("bad startxref")
        return value

    def _load(self, at: int | None) -> None:
        seen: set[int] = set()
        while isinstance(at, int) and at not in seen:
            seen.add(at)
            trailer = self._section(at)
            for k, v in trailer.items():
                if not seen - {at} or k not in ("Prev", "XRefStm"):
                    self.trailer.setdefault(k, v)
            hybrid = trailer.get("XRefStm")
            if isinstance(hybrid, int) and hybrid not in seen:
                seen.add(hybrid)
                self._section(hybrid)
            at = trailer.get("Prev")
        if "Root" not in self.trailer:
            raise PdfError("no root in the trailer")

    def _section(self, at: int) -> dict:
        """One table or stream of references; entries that are known stay."""
        if not 0 <= at < len(self.data):
            raise PdfError(f"no cross references at {at}")
        lex = Lexer(self.data, at)
        if lex.token() != Keyword("xref"):
            return self._stream_section(at)
        while True:
            first = lex.token()
            if first == Keyword("trailer"):
                found = lex.object()
                if not isinstance(found, dict):
                    raise PdfError("bad trailer")
                return found
            count = lex.token()
            if not (isinstance(first, int) and isinstance(count, int)):
                raise PdfError("bad cross-reference table")
            for k in range(count):
                offset, gen, kind = lex.token(), lex.token(), lex.token()
                if kind is EOF or not isinstance(offset, int):
                    raise PdfError("bad cross-reference entry")
                self.entries.setdefault(first + k, ("n", offset, gen) if kind == "n" else ("f",))

    def _stream_section(self, at: int) -> dict:
        _, _, s = indirect_object(self.data, at)
        if not isinstance(s, Stream) or s.dict.get("Type") != "XRef":
            raise PdfError(f"no cross references at {at}")
        body = filters.decode(s.raw, s.dict)
        w = s.dict["W"]
        size = sum(w)
        index = s.dict.get("Index", [0, s.dict.get("Size", 0)])
        place = 0
        for first, count in zip(index[::2], index[1::2]):
            for k in range(count):
                row = body[place : place + size]
                place += size
                if len(row) < size:
                    return s.dict
                parts = [int.from_bytes(row[sum(w[:j]) : sum(w[: j + 1])]) for j in range(3)]
                kind = parts[0] if w[0] else 1
                entry = ("f",) if kind == 0 else ("n", parts[1], parts[2]) if kind == 1 else ("c", parts[1], parts[2])
                self.entries.setdefault(first + k, entry)
        return s.dict

    # --- objects ---

    def resolve(self, x):
        """The value that a reference stands for; anything else is itself. Missing and free objects are None."""
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self._get(x.num)
        raise PdfError("a chain of references does not end")

    def _get(self, num: int):
        if num in self._objects:
            return self._objects[num]
        if num in self._resolving:
            raise PdfError(f"object {num} refers to itself")
        self._resolving.add(num)
        try:
            value = self._read(num)
        finally:
            self._resolving.discard(num)
        self._objects[num] = value
        return value

    def _read(self, num: int):
        entry = self.entries.get(num, ("f",))
        if entry[0] == "f":
            return None
        if entry[0] == "c":
            return self._unpack(entry[1]).get(num)
        found, gen, value = indirect_object(self.data, entry[1], lambda r: self.resolve(r))
        if found != num:
            raise PdfError(f"object {found} where {num} should be")
        encrypt = self.trailer.get("Encrypt")
        if self.security and self.security.key and not (isinstance(encrypt, Ref) and encrypt.num == num):
            value = self.security.convert(value, Ref(num, gen))
        return value

    def _unpack(self, num: int) -> dict[int, object]:
        """All objects of an object stream, by /N and /First."""
        if num not in self._packed:
            s = self.resolve(Ref(num))
            if not isinstance(s, Stream):
                raise PdfError(f"no object stream {num}")
            body, first = self.decoded(s), self.resolve(s.dict.get("First", 0))
            lex = Lexer(body)
            pairs = [(lex.token(), lex.token()) for _ in range(self.resolve(s.dict.get("N", 0)))]
            out: dict[int, object] = {}
            for n, offset in pairs:
                if isinstance(n, int) and isinstance(offset, int):
                    value = Lexer(body, first + offset).object()
                    out.setdefault(n, None if isinstance(value, Keyword) else value)
            self._packed[num] = out
        return self._packed[num]

    def decoded(self, s: Stream) -> bytes:
        return filters.decode(s.raw, s.dict, self.resolve)

    def refs(self) -> list[Ref]:
        """Of all objects in use."""
        return [Ref(n, e[2] if e[0] == "n" else 0) for n, e in sorted(self.entries.items()) if e[0] != "f" and n]

    def get(self, d, key, kind=None):
        """A dictionary's entry, resolved; None if it is missing or not of a kind."""
        d = self.resolve(d)
        d = d.dict if isinstance(d, Stream) else d
        x = self.resolve(d.get(key)) if isinstance(d, dict) else None
        return x if kind is None or (isinstance(x, kind) and not (isinstance(x, bool) and kind is not bool)) else None

    # --- security ---

    def _unlock(self, password) -> None:
        encrypt = self.resolve(self.trailer.get("Encrypt"))
        if not isinstance(encrypt, dict):
            return
        ids = self.resolve(self.trailer.get("ID"))
        first = self.resolve(ids[0]) if isinstance(ids, list) and ids else b""
        deep = lambda x: {k: deep(v) for k, v in x.items()} if isinstance(x := self.resolve(x), dict) else x
        self.security = Security(deep(encrypt), first if isinstance(first, bytes) else b"")
        self._objects.clear()
        self._packed.clear()
        self.authenticate(b"") or (password and self.authenticate(password))

    def authenticate(self, password: str | bytes) -> bool:
        ok = self.security is None or self.security.authenticate(password)
        if ok:
            self._objects.clear()
            self._packed.clear()
        return ok

    @property
    def encrypted(self) -> bool:
        return self.security is not None

    @property
    def locked(self) -> bool:
        return self.security is not None and self.security.key is None

    # --- structure ---

    @property
    def catalog(self) -> dict:
        root = self.resolve(self.trailer.get("Root"))
        if not isinstance(root, dict):
            raise PdfError("no catalog")
        return root

    def page_count(self) -> int:
        """What the root of the page tree says, which the pages themselves may not agree with."""
        return self.get(self.get(self.catalog, "Pages"), "Count", int) or 0

    def pages(self) -> list[dict]:
        """Page dictionaries in order, each with what it inherits; a node is visited once."""
        out: list[dict] = []
        seen: set[int] = set()
        stack = [(self.catalog.get("Pages"), {})]
        while stack:
            ref, inherited = stack.pop()
            if isinstance(ref, Ref):
                if ref.num in seen:
                    continue
                seen.add(ref.num)
            node = self.resolve(ref)
            if not isinstance(node, dict):
                continue
            own = inherited | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if self.resolve(node.get(k)) is not None}
            kids = self.resolve(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                stack += [(k, own) for k in reversed(kids)]
            else:
                out.append(own | node | {"__ref": ref})
        return out

    def box(self, page: dict, key: str) -> list[float] | None:
        raw = self.resolve(page.get(key))
        values = [self.resolve(v) for v in raw] if isinstance(raw, list) else []
        if len(values) != 4 or not all(isinstance(v, (int, float)) for v in values):
            return None
        x0, y0, x1, y1 = map(float, values)
        return [min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)]

    def page_boxes(self, page: dict) -> dict[str, list[float] | None]:
        media = self.box(page, "MediaBox") or [float(v) for v in DEFAULT_BOX]
        return {"media_box": media, **{name: self.box(page, key) for name, key in (("crop_box", "CropBox"), ("bleed_box", "BleedBox"), ("trim_box", "TrimBox"), ("art_box", "ArtBox"))}}

    def rotation(self, page: dict) -> int:
        r = self.resolve(page.get("Rotate"))
        return int(r) % 360 if isinstance(r, (int, float)) else 0

    def content(self, page: dict) -> bytes:
        """A page's content, its parts joined by a space; a part that can't be decoded is read as far as it goes."""
        parts = self.resolve(page.get("Contents"))
        parts = parts if isinstance(parts, list) else [parts]
        out = []
        for p in map(self.resolve, parts):
            if isinstance(p, Stream):
                out.append(filters.decode_tolerant(p.raw, p.dict, self.resolve)[0])
        return b" ".join(out)

    def metadata(self) -> dict[str, str]:
        """The Info entries that are there, in their fixed order."""
        info = self.resolve(self.trailer.get("Info"))
        found = {k: read_text(self.get(info, k)) for k in INFO_KEYS} if isinstance(info, dict) else {}
        return {k: v for k, v in found.items() if v is not None}

    @property
    def linearized(self) -> bool:
        return self.linearization() is not None

    def linearization(self) -> dict | None:
        """The linearization dictionary, if the first object is one."""
        m = _OBJ.search(self.data[:2048])
        try:
            value = indirect_object(self.data, m.start(1))[2] if m else None
        except PdfError:
            return None
        return value if isinstance(value, dict) and "Linearized" in value else None

    def edges(self):
        """(from, to) for every reference between objects, and from the trailer as 0."""
        for r in references({k: v for k, v in self.trailer.items() if k in ("Root", "Info")}):
            yield 0, r.num
        for ref in self.refs():
            try:
                yield from ((ref.num, r.num) for r in references(self.resolve(ref)))
            except PdfError:
                continue


def rebuild(data: bytes) -> Document:
    """A document whose cross references are rebuilt by scanning for objects: the last of a number wins.

    Object streams are unpacked too. The trailer is the last readable one, or
    made from the catalog.
    """
    doc = Document.__new__(Document)
    m = _HEADER.search(data[:1024])
    doc.data, doc.version, doc.base = data, f"{int(m[1])}.{int(m[2])}" if m else "1.4", 0
    doc.entries, doc.trailer, doc.security, doc.repaired = {}, {}, None, True
    doc._objects, doc._packed, doc._resolving = {}, {}, set()
    for m in _OBJ.finditer(data):
        doc.entries[int(m[1])] = ("n", m.start(1), int(m[2]))
    if not doc.entries:
        raise PdfError("no objects found")
    at = data.rfind(b"trailer")
    while at >= 0:
        found = Lexer(data, at + 7).object()
        if isinstance(found, dict) and "Root" in found:
            doc.trailer = found
            break
        at = data.rfind(b"trailer", 0, at)
    catalog = None
    for num in sorted(doc.entries):
        try:
            value = doc.resolve(Ref(num))
        except PdfError:
            continue
        if isinstance(value, Stream) and value.dict.get("Type") == "ObjStm":
            try:
                for n in doc._unpack(num):
                    doc.entries.setdefault(n, ("c", num, 0))
            except (PdfError, ValueError):
                pass
        if isinstance(value, Stream) and value.dict.get("Type") == "XRef" and "Root" not in doc.trailer:
            doc.trailer = value.dict
        if isinstance(value, dict) and value.get("Type") == "Catalog":
            catalog = Ref(num)
    for num in [n for n, e in doc.entries.items() if e[0] == "c"]:
        value = doc.resolve(Ref(num))
        if isinstance(value, dict) and value.get("Type") == "Catalog":
            catalog = catalog or Ref(num)
    if not isinstance(doc.resolve(doc.trailer.get("Root")), dict):
        if catalog is None:
            raise PdfError("no catalog found")
        doc.trailer = doc.trailer | {"Root": catalog}
    doc._unlock(b"")
    return doc


def open_document(data: bytes, password: str | bytes = b"", repair: bool = True) -> Document:
    """Parse, and if that fails rebuild the cross references."""
    try:
        doc = Document(data, password)
        doc.catalog
        return doc
    except (PdfError, ValueError, KeyError, TypeError, IndexError) as e:
        if not repair or str(e) == "NotPdf" or b"obj" not in data:
            raise e if isinstance(e, PdfError) else PdfError(str(e)) from None
        doc = rebuild(data)
        if password:
            doc.authenticate(password)
        return doc


__all__ = ["DEFAULT_BOX", "Document", "INFO_KEYS", "Name", "open_document", "rebuild"]


def hint_tables(doc: Document) -> dict | None:
    """The page offset hints of a linearized document: objects and bytes of each page."""
    head = doc.linearization()
    place = doc.resolve(head.get("H")) if head else None
    if not isinstance(place, list) or not place:
        return None
    try:
        _, _, s = indirect_object(doc.data, int(doc.resolve(place[0])), doc.resolve)
        body = filters.decode(s.raw, s.dict, doc.resolve)
    except (PdfError, AttributeError, TypeError):
        return None
    bits = int.from_bytes(body)
    total, at = 8 * len(body), 0

    def take(n: int) -> int:
        nonlocal at
        if at + n > total:
            raise PdfError("hint tables end early")
        at += n
        return bits >> (total - at) & ((1 << n) - 1) if n else 0

    try:
        least_objects, first, object_bits, least_length, length_bits = take(32), take(32), take(16), take(32), take(16)
        for n in (32, 16, 32, 16, 16, 16, 16, 16):
            take(n)
        pages = int(head.get("N", 0))
        objects = [least_objects + take(object_bits) for _ in range(pages)]
        at += -at % 8
        lengths = [least_length + take(length_bits) for _ in range(pages)]
    except PdfError:
        return None
    return {"first_page_offset": first, "pages": [{"objects": n, "length": size} for n, size in zip(objects, lengths)]}
