"""One document in hand: the same kernels without Spark.

    doc = open_file("a.pdf")
    doc.metadata, len(doc), doc[0].text(), doc.search("word"), doc[0].svg()
    doc.edit().delete_page(0).set_info("Title", "T").save("b.pdf")
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

from quire.pdf import content, layout, output, render, sign, structure, writer
from quire.pdf.document import open_document
from quire.pdf.syntax import PdfError


class Page:
    def __init__(self, document: Document, index: int, raw: dict):
        self.document, self.index, self.raw = document, index, raw

    @property
    def label(self) -> str:
        return structure.label_of(self.document.labels, self.index)

    @property
    def size(self) -> tuple[float, float]:
        box = self.document.raw.page_boxes(self.raw)["media_box"]
        return box[2] - box[0], box[3] - box[1]

    @property
    def rotation(self) -> int:
        return self.document.raw.rotation(self.raw)

    def chars(self) -> list[tuple]:
        return content.page_chars(self.document.raw, self.raw)

    def words(self) -> list[dict]:
        return layout.words_of(self.chars())

    def blocks(self, mode: str = "reference") -> list[dict]:
        return layout.blocks_of(layout.lines_of(self.words()), mode)

    def text(self, mode: str = "reference") -> str:
        return layout.plain_text(self.blocks(mode))

    def search(self, pattern: str, case_insensitive: bool = False) -> list[tuple[int, int, str]]:
        """(first glyph, end, text) of overlapping hits."""
        hits = re.compile(f"(?=({re.escape(pattern)}))", re.IGNORECASE if case_insensitive else 0)
        return [(first, end, text) for text, first, end, *_ in content.find(self.chars(), hits)]

    def annotations(self) -> list[dict]:
        return structure.annotations(self.document.raw, self.raw)

    def bbox(self) -> list[float] | None:
        return content.page_bbox(self.document.raw, self.raw)

    def svg(self, dpi: float = 72.0) -> str:
        return render.to_svg(self.document.raw, self.raw, dpi)

    def png(self, dpi: float = 72.0) -> bytes:
        return render.png(render.to_pixels(self.document.raw, self.raw, dpi))


class Document:
    def __init__(self, data: bytes, password: str = ""):
        self.raw = open_document(data, password)
        if self.raw.locked:
            raise PdfError("the document needs a password")
        self._pages = [Page(self, k, p) for k, p in enumerate(self.raw.pages())]
        self.labels = structure.page_labels(self.raw)

    def __len__(self) -> int:
        return len(self._pages)

    def __getitem__(self, index: int) -> Page:
        return self._pages[index]

    def __iter__(self) -> Iterator[Page]:
        return iter(self._pages)

    version = property(lambda self: self.raw.version)
    metadata = property(lambda self: self.raw.metadata())
    encrypted = property(lambda self: self.raw.encrypted)
    linearized = property(lambda self: self.raw.linearized)
    outlines = property(lambda self: structure.outlines(self.raw))
    fields = property(lambda self: structure.form_fields(self.raw))
    layers = property(lambda self: structure.layers(self.raw))
    files = property(lambda self: structure.embedded_files(self.raw, with_data=True))
    images = property(lambda self: structure.images(self.raw))
    invoice = property(lambda self: structure.invoice(self.raw))
    signatures = property(lambda self: sign.verify(self.raw))

    def text(self, kind: str = "text") -> str:
        """All pages as text, html, json or markdown."""
        return output.format_pages([{"page_index": p.index, "blocks": p.blocks(), "chars": p.chars()} for p in self], kind)

    def search(self, pattern: str, case_insensitive: bool = False) -> dict[int, list]:
        """Hits by page, of pages that have any."""
        return {p.index: found for p in self if (found := p.search(pattern, case_insensitive))}

    def edit(self) -> Editor:
        return Editor(self)


class Editor:
    """Changes, one after the other; save or bytes ends them."""

    def __init__(self, document: Document):
        self._e = writer.Editor(document.raw)

    def delete_page(self, index: int) -> Editor:
        self._e.delete_page(index)
        return self

    def reorder(self, order: list[int]) -> Editor:
        self._e.reorder(order)
        return self

    def rotate(self, index: int, degrees: int) -> Editor:
        self._e.rotate(index, degrees)
        return self

    def set_info(self, key: str, value: str) -> Editor:
        self._e.set_info(key, value)
        return self

    def clean(self) -> Editor:
        self._e.clean()
        return self

    def bytes(self, **options) -> bytes:
        return self._e.build(**options)

    def save(self, path: str, **options) -> None:
        Path(path).write_bytes(self.bytes(**options))


def open_file(path: str, password: str = "") -> Document:
    return Document(Path(path).read_bytes(), password)


def merge(documents: list[Document]) -> bytes:
    return writer.merge([d.raw for d in documents])
