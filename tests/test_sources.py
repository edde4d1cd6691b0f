"""Sources on files: formats, PDF tables, damage and conversions."""

from __future__ import annotations

import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.formats import readers
from quire.formats.common import FormatError
from quire.pdf import writer
from quire.sources import documents, pdf, write


def zip_of(files: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


EPUB = zip_of({
    "META-INF/container.xml": "<c><rootfiles><rootfile full-path='OEBPS/b.opf'/></rootfiles></c>",
    "OEBPS/b.opf": "<package xmlns:dc='d'><metadata><dc:title>Book</dc:title><dc:creator>Me</dc:creator></metadata><manifest><item id='b' href='two.xhtml'/><item id='a' href='one%20x.xhtml'/></manifest><spine><itemref idref='a'/><itemref idref='b'/></spine></package>",
    "OEBPS/one x.xhtml": "<html><head><title>t</title><style>s</style></head><body><h1>One</h1><p>a <b>b</b><br/>c</p><script>no</script></body></html>",
    "OEBPS/two.xhtml": "<p>broken <b>x</p>&amp; more",
})
DOCX = zip_of({"word/document.xml": "<w:d xmlns:w='w'><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>c</w:t><w:br/><w:t>d</w:t></w:r></w:p></w:d>", "docProps/core.xml": "<c xmlns:dc='d'><dc:title>T</dc:title><dc:creator>C</dc:creator></c>"})
XLSX = zip_of({
    "xl/sharedStrings.xml": "<s><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r></si></s>",
    "xl/worksheets/sheet10.xml": "<w><row><c r='A1' t='s'><v>1</v></c></row></w>",
    "xl/worksheets/sheet2.xml": "<w><row><c r='B1' t='s'><v>0</v></c><c r='AA1'><v>7</v></c></row><row><c t='inlineStr'><is><t>in</t></is></c></row></w>",
})
PPTX = zip_of({f"ppt/slides/slide{n}.xml": f"<s xmlns:a='a'><a:p><a:r><a:t>slide </a:t></a:r><a:r><a:t>{n}</a:t></a:r></a:p></s>" for n in (10, 2)})
XPS = zip_of({"f.fdseq": "<s><DocumentReference Source='/D/1.fdoc'/></s>", "D/1.fdoc": "<d><PageContent Source='p/1.fpage'/></d>", "D/p/1.fpage": "<FixedPage Width='96' Height='192'><Glyphs UnicodeString='Hi'/><Glyphs UnicodeString='{}{x}'/></FixedPage>"})
PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 30, 40)
CBZ = zip_of({"page10.png": PNG, "page2.png": PNG, "note.txt": "x"})
FB2 = "<FictionBook><description><title-info><author><first-name>A</first-name><last-name>B</last-name></author><book-title>F</book-title></title-info></description><body><section><p>one</p><section><p>two</p></section></section></body></FictionBook>".encode()
SVG = b"<svg width='100' height='50' xmlns='http://www.w3.org/2000/svg'><title>S</title><text>Hello <tspan>you</tspan></text></svg>"


def mobi(body: bytes, kind: int) -> bytes:
    header = struct.pack(">HHIHHI", kind, 0, 10_000, 1, 4096, 0) + b"MOBI" + struct.pack(">III", 232, 2, 65001)
    first = 78 + 16 + 2
    head = b"Title".ljust(32, b"\0") + bytes(28) + b"BOOKMOBI" + bytes(8) + struct.pack(">H", 2)
    return head + struct.pack(">II", first, 0) + struct.pack(">II", first + len(header), 0) + b"\0\0" + header + body


def test_formats():
    r = readers.epub(EPUB)
    assert r.texts == ["One\na b\nc", "broken x\n& more"] or r.texts == ["One\na bc", "broken x\n& more"]
    assert (r.title, r.author) == ("Book", "Me")
    assert readers.docx(DOCX).texts == ["a\tb\n\nc\nd"] and readers.docx(DOCX).title == "T"
    x = readers.xlsx(XLSX)
    assert x.texts[0] == "one" and x.texts[1].split("\n")[0].split("\t")[1] == "zero" and x.texts[1].split("\n")[1] == "in" and len(x.texts[1].split("\n")[0].split("\t")) == 27
    assert readers.pptx(PPTX).texts == ["slide 2", "slide 10"]
    p = readers.xps(XPS)
    assert p.texts == ["Hi\n{x}"] and p.sizes == [(72.0, 144.0)]
    assert readers.cbz(CBZ).sizes == [(30.0, 40.0)] * 2
    f = readers.fb2(FB2)
    assert f.texts == ["one", "two"] and (f.title, f.author) == ("F", "A B")
    s = readers.svg(SVG)
    assert s.texts == ["Hello you"] and s.title == "S"
    assert readers.mobi(mobi(b"<p>Hi &amp; bye</p><br/>x", 1)).texts == ["Hi & bye\nx"]
    assert readers.palmdoc(b"abc\x80\x18" + bytes([0xC0 | ord("T")])) == b"abcabc T" and readers.mobi(mobi(b"abc", 2)).title == "Title"
    assert readers.plain_text("a\nb".encode()).texts == ["a\nb"]


@pytest.mark.parametrize("kind", sorted(set(readers.READERS) - {"PlainText"}))
def test_bad_files_are_errors(kind):
    with pytest.raises(FormatError):
        readers.read(b"nonsense", kind)


def test_protected_books():
    with pytest.raises(FormatError, match="protected"):
        readers.epub(zip_of({"META-INF/encryption.xml": "<x/>"}))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    b = writer.Builder()
    b.page(writer.PageBuilder().text(72, 720, "Hello World", 24).image("I", writer.rgb_image(1, 1, b"abc"), 0, 0, 9, 9))
    b.set_info(Title="T")
    good = b.build()
    for name, body in {
        "a.pdf": good, "bad.pdf": b"junk that is no document", "cut.pdf": good[: good.rfind(b"xref\n0")], "b.epub": EPUB, "c.docx": DOCX, "d.xlsx": XLSX, "e.pptx": PPTX,
        "f.svg": SVG, "g.txt": b"plain", "h.bin": b"\0\1\2\3\4", "i.docx": b"no zip",
    }.items():
        (d / name).write_bytes(body)
    return str(d)


def test_documents_source(spark, folder):
    rows = {r.doc_id.rsplit("/", 1)[-1]: r for r in documents.read(spark, folder).collect()}
    assert {k: r.status for k, r in rows.items() if r.status == "error"} == {"bad.pdf": "error", "h.bin": "error", "i.docx": "error"}
    assert rows["a.pdf"].pages[0].text == "Hello World" and rows["a.pdf"].title == "T" and rows["e.pptx"].format == "Pptx" and len(rows["e.pptx"].pages) == 2
    made = documents.to_pdf(spark.read.format("binaryFile").load(folder).select(F.col("path").alias("doc_id"), "content").withColumn("format", F.lit("Svg")).where("path like '%f.svg'"))
    again = pdf.parse(made).first()
    assert again.status == "ok" and again.pages[0].text == "Hello you"


def test_damaged_files_are_rows(spark):
    """No byte of a container that is changed fails the job: the file's row says error, or it is read."""
    rng = random.Random(7)
    rows = []
    for kind, body in (("Docx", DOCX), ("Epub", EPUB), ("Xlsx", XLSX), ("Pptx", PPTX), ("Xps", XPS), ("Cbz", CBZ)):
        for _ in range(60):
            data = bytearray(body)
            for _ in range(rng.randrange(1, 5)):
                data[rng.randrange(len(data))] = rng.randrange(256)
            rows.append((f"{kind}{len(rows)}", kind, bytes(data)))
    got = documents.parse(spark.createDataFrame(rows, "doc_id string, format string, content binary")).collect()
    assert len(got) == len(rows) and {r.status for r in got} == {"ok", "error"} and all(r.error for r in got if r.status == "error")
    made = documents.to_pdf(spark.createDataFrame(rows, "doc_id string, format string, content binary")).collect()
    assert len(made) == len(rows)


def test_search_in_files_is_search_in_tables(spark, folder):
    files = pdf.read_files(spark, folder)
    rows = lambda f: sorted(tuple(r) for r in f.collect())
    for args in (("o",), ("HELLO W",), (r"[A-Z]\w",)):
        own = {"case_insensitive": args[0] == "HELLO W", "regex": "w" in args[0]}
        want = rows(pdf.search(pdf.parse(files, parts=["chars"]), *args, **own))
        assert rows(pdf.search_files(files, *args, **own)) == want and want
    assert len(rows(pdf.search_files(files, "o", max_results=1))) == 2 and not rows(pdf.search_files(files, ""))
    (good,) = [r for r in pdf.parse(files, parts=["raw"]).collect() if r.status == "ok"]
    assert good.pages[0].raw == "Hello World" and good.pages[0].chars is None and good.pages[0].words is None and good.outlines is None


def test_pdf_tables(spark, folder):
    parsed = pdf.parse(pdf.read_files(spark, folder)).cache()
    status = {r.doc_id.rsplit("/", 1)[-1]: r.status for r in parsed.collect()}
    assert status == {"a.pdf": "ok", "bad.pdf": "error", "cut.pdf": "repaired"}
    good = parsed.where("doc_id like '%a.pdf'")
    assert [r.text for r in pdf.words(good).orderBy("word_seq").collect()] == ["Hello", "World"]
    assert [r.text for r in pdf.lines(good).collect()] == ["Hello World"] and pdf.chars(good).count() == 11
    (hit,) = pdf.search(good, "Hello").collect()
    assert hit.char_start == 0 and hit.x0 >= 71.9 and pdf.search(good, "hello", case_insensitive=True).count() == 1 and pdf.search(good, r"[A-Z]\w", regex=True).count() == 2
    s = pdf.summary(good).first()
    assert (s.page_count, s.image_count) == (1, 1) and pdf.metadata(good).first().value == "T"
    assert pdf.table(good, "fonts").first().base_font == "Helvetica" and pdf.table(good, "edges").count() > 3 and pdf.pages(good).first().media_box.urx == 612
    assert pdf.annotations(good).count() == 0 and pdf.blocks(good).count() == 1
    parsed.unpersist()


def test_writing_on_executors(spark):
    d = spark.createDataFrame([(1, "one\n" * 60), (2, "two"), (3, None)], "doc_id long, text string")
    files = d.select("doc_id", write.text_to_pdf(F.col("text"), F.lit("name")).alias("content"))
    count = lambda frame: {r.doc_id: r.page_count for r in pdf.parse(frame, parts=["images"]).collect()}
    assert count(files) == {1: 2, 2: 1, 3: 1}
    assert count(files.select("doc_id", write.delete_page(F.col("content"), 0).alias("content")))[1] == 1
    assert count(files.select("doc_id", write.reorder(F.col("content"), [1, 0, 0]).alias("content"))) == {1: 3, 2: 2, 3: 2}
    assert count(files.select("doc_id", write.clean(write.compress(F.col("content"), "high")).alias("content"))) == {1: 2, 2: 1, 3: 1}
    named = pdf.parse(files.select("doc_id", write.set_info(F.col("content"), "Author", "é").alias("content")), parts=["images"]).first()
    assert named.metadata == {"Title": "name", "Author": "é"}
    locked = files.select("doc_id", write.encrypt(F.col("content"), "u", "o", "RC4-128").alias("content"))
    assert all(r.locked for r in pdf.parse(locked, parts=["images"]).collect())
    assert count(locked.select("doc_id", write.decrypt(F.col("content"), "u").alias("content"))) == {1: 2, 2: 1, 3: 1}
