"""Documents laid out for fast web view."""

from __future__ import annotations

import pytest

from quire.pdf import content, edit, writer
from quire.pdf.document import Document, hint_tables, rebuild
from quire.pdf.linearize import linearize
from quire.pdf.syntax import PdfError


def source(n: int) -> bytes:
    b = writer.Builder()
    picture = writer.rgb_image(2, 2, bytes(12))
    for k in range(n):
        b.page(writer.PageBuilder().text(72, 700, f"page {k} " + "x" * 30 * k).text(72, 600, "y", 9, "Times-Roman").image("I", picture, 1, 1, 9, 9))
    b.set_info(Title="Tést")
    e = writer.Editor(Document(b.build(pack=True)))
    edit.set_outlines(e, [{"title": "end", "page": n - 1}])
    edit.add_annotation(e, 0, edit.annotation("Text", [1, 2, 3, 4], "note"))
    return e.build()


@pytest.mark.parametrize("n", [1, 2, 7])
def test_the_layout(n):
    old = Document(source(n))
    data = linearize(old)
    doc = Document(data)
    head = doc.linearization()
    assert doc.linearized and not doc.repaired and head["L"] == len(data) and head["N"] == n
    texts = lambda d: ["".join(c[0] for c in content.page_chars(d, p)) for p in d.pages()]
    assert texts(doc) == texts(old) == texts(rebuild(data)) and doc.metadata() == {"Title": "Tést"}
    # the first page's objects end before /E, and the others begin there
    pages = [p["__ref"].num for p in doc.pages()]
    assert pages[0] == head["O"] and doc.entries[pages[0]][1] < head["E"] and all(doc.entries[p][1] >= head["E"] for p in pages[1:])
    assert data[head["T"] :].lstrip().startswith(b"0000000000 65535 f") and data[head["H"][0] :][: head["H"][1]].endswith(b"endobj\n")
    hints = hint_tables(doc)
    assert hints["first_page_offset"] + head["H"][1] == doc.entries[pages[0]][1] and len(hints["pages"]) == n
    at = doc.entries[pages[0]][1]
    for p, own in zip(pages, hints["pages"]):
        assert doc.entries[p][1] == at
        inside = [num for num, entry in doc.entries.items() if entry[0] == "n" and at <= entry[1] < at + own["length"]]
        assert len(inside) == own["objects"]
        at += own["length"]
    assert [o["title"] for o in __import__("quire.pdf.structure", fromlist=["x"]).outlines(doc)] == ["end"]


def test_what_cannot_be_laid_out():
    with pytest.raises(PdfError):
        linearize(Document(writer.lines_to_pdf([["x"]], encrypt={"method": "AES-128", "user": "", "owner": "o"})))
    b = writer.Builder()
    with pytest.raises(PdfError):
        linearize(Document(b.build()))
