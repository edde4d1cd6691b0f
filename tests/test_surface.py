"""The command line, SQL functions, output formats and print colours."""

from __future__ import annotations

import json
import struct

import pytest

from quire.__main__ import main, page_range
from quire.functions import sql
from quire.pdf import output, structure, writer
from quire.pdf.document import Document
from quire.pdf.syntax import Name, PdfError, Stream
from quire.sources import pdf
from quire.sources.pdf import parse_bytes


def sample(text="Hello World") -> bytes:
    b = writer.Builder()
    b.page(writer.PageBuilder().text(72, 720, text, 24).text(72, 600, 'a & "b"', 10))
    b.page(writer.PageBuilder().text(72, 720, "second", 12))
    b.set_info(Title="T")
    return b.build()


def test_output_formats():
    pages = parse_bytes(sample())["pages"]
    assert output.format_pages(pages, "text") == 'Hello World\n\na & "b"\n\nsecond'
    html = output.format_pages(pages, "html")
    assert "<h2>Page 2</h2>" in html and "<p>a &amp; &quot;b&quot;</p>" in html
    found = json.loads(output.format_pages(pages, "json"))
    assert found["pages"][0]["blocks"][0]["lines"][0]["words"][1]["text"] == "World" and found["pages"][1]["char_count"] == 6
    assert json.loads(output.json_page({"page_index": 3, "blocks": [], "chars": []})) == {"page_index": 3, "blocks": [], "char_count": 0}
    assert output.format_pages(pages, "markdown").startswith("## Page 1\n\nHello World") and "\n\n---\n\n## Page 2" in output.format_pages(pages, "markdown")
    with pytest.raises(ValueError):
        output.format_pages(pages, "rtf")


def test_command_line(tmp_path, capsys):
    a, b, out = (str(tmp_path / n) for n in ("a.pdf", "b.pdf", "out.pdf"))
    (tmp_path / "a.pdf").write_bytes(sample())
    (tmp_path / "b.pdf").write_bytes(sample("Other"))
    (tmp_path / "n.txt").write_text("note")
    assert main(["info", a]) == 0 and json.loads(capsys.readouterr().out)["metadata"] == {"Title": "T"}
    assert main(["text", a, "--pages", "2"]) == 0 and capsys.readouterr().out == "second\n"
    assert main(["merge", out, a, b]) == 0 and len(Document((tmp_path / "out.pdf").read_bytes()).pages()) == 4
    assert main(["split", out, b, "--pages", "3-"]) == 0 and main(["text", b]) == 0 and capsys.readouterr().out.startswith("Other")
    assert main(["encrypt", a, out, "--owner", "o", "--user", "u", "--no-print"]) == 0
    locked = Document((tmp_path / "out.pdf").read_bytes(), "u")
    assert not locked.security.permissions & 4 and locked.security.permissions & 16
    assert main(["text", out]) == 1 and main(["text", out, "--password", "u"]) == 0
    assert main(["decrypt", out, b, "--password", "u"]) == 0 and main(["clean", b, b]) == 0 and main(["compress", b, out, "--preset", "high"]) == 0
    for name in ("p.svg", "p.png", "p.txt"):
        assert main(["convert", a, str(tmp_path / name)]) == 0 and (tmp_path / name).stat().st_size
    assert main(["render", a, str(tmp_path / "q.png"), "--page", "2", "--dpi", "36"]) == 0
    assert main(["convert", str(tmp_path / "n.txt"), out]) == 0 and main(["text", out]) == 0
    assert main(["info", str(tmp_path / "n.txt")]) == 1 and main(["split", a, out, "--pages", "9"]) == 1
    assert page_range("1-2,4", 5) == [0, 1, 3] and page_range("-2", 5) == [0, 1]
    with pytest.raises(PdfError):
        page_range("0", 5)


def test_sql_functions(spark):
    sql.register(spark)
    spark.createDataFrame([(1, sample()), (2, b"junk"), (3, None)], "id int, content binary").createOrReplaceTempView("files")
    assert [(r.id, r.page_index, r.width) for r in spark.sql("SELECT f.id, p.* FROM files f, LATERAL pdf_pages(f.content) p ORDER BY 1, 2").collect()] == [(1, 0, 612.0), (1, 1, 612.0)]
    assert [r.text for r in spark.sql("SELECT w.* FROM files f, LATERAL pdf_words(f.content) w WHERE page_index = 0 ORDER BY word_seq").collect()][:2] == ["Hello", "World"]
    assert spark.sql("SELECT h.* FROM files f, LATERAL pdf_search(f.content, 'l') h").count() == 3
    row = spark.sql("SELECT decode_stream(CAST('48690A>' AS BINARY), 'ASCIIHexDecode') a, decode_stream(CAST('x' AS BINARY), 'FlateDecode') b").first()
    assert bytes(row.a) == b"Hi\n" and row.b is None
    parsed = pdf.parse(spark.table("files"), key="id", parts=["pages"])
    assert {r.id: (r.markdown or "")[:9] for r in pdf.formatted(parsed, "markdown", "id").collect()} == {1: "## Page 1", 2: "", 3: ""}


def test_print_colours():
    tags = struct.pack(">I4sII", 1, b"desc", 144, 20)
    profile = bytes(8) + bytes([4, 0x30, 0, 0]) + b"mntrRGB XYZ " + bytes(12) + b"acsp" + bytes(88) + tags + b"desc" + bytes(4) + struct.pack(">I", 5) + b"sRGB\0"
    found = structure.icc_profile(profile)
    assert (found["version"], found["space"], found["components"], found["description"]) == ("4.3", "RGB", 3, "sRGB") and structure.icc_profile(b"x") is None
    e = writer.Editor(Document(sample()))
    e.objects[e.root.num] = e.objects[e.root.num] | {"OutputIntents": [{"S": Name("GTS_PDFA1"), "OutputConditionIdentifier": b"sRGB", "DestOutputProfile": e.add(Stream({"N": 3}, profile))}]}
    doc = Document(e.build())
    assert structure.output_intents(doc)[0]["components"] == 3
    assert structure.overprint(doc, {"OP": True, "OPM": 1}) == {"stroke": True, "fill": True, "mode": 1} and structure.overprint(doc, {"op": False})["fill"] is False


def test_documents_in_hand(tmp_path):
    from quire import api

    (tmp_path / "a.pdf").write_bytes(sample())
    doc = api.open_file(str(tmp_path / "a.pdf"))
    assert len(doc) == 2 and doc.metadata == {"Title": "T"} and doc[1].text() == "second" and [p.label for p in doc] == ["1", "2"]
    assert doc.search("O", case_insensitive=True) == {0: [(4, 5, "o"), (7, 8, "o")], 1: [(3, 4, "o")]} and doc.search("zzz") == {}
    assert doc[0].size == (612, 792) and doc[0].rotation == 0 and doc[0].bbox() and not doc[0].annotations() and doc[0].svg().startswith("<svg") and doc[0].png(36).startswith(b"\x89PNG")
    assert doc.text("markdown").startswith("## Page 1") and not doc.encrypted and doc.version == "1.7" and doc.signatures == [] and doc.invoice is None
    doc.edit().reorder([1, 0]).rotate(0, 90).set_info("Author", "A").clean().save(str(tmp_path / "b.pdf"))
    again = api.open_file(str(tmp_path / "b.pdf"))
    assert again[0].text() == "second" and again[0].rotation == 90 and again.metadata["Author"] == "A"
    assert len(api.Document(api.merge([doc, again]))) == 4 and len(api.Document(doc.edit().delete_page(0).bytes())) == 1
    with pytest.raises(PdfError, match="password"):
        api.Document(doc.edit().bytes(encrypt={"method": "RC4-128", "user": "u", "owner": "o"}))
