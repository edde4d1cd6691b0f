"""The kernels: write and read round trips, damage, encryption, structure."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.pdf import content, crypt, filters, layout, structure, writer
from quire.pdf.document import Document, open_document, rebuild
from quire.pdf.syntax import Lexer, Name, PdfError, Ref, Stream, write_object
from quire.sources.pdf import parse_bytes


def hello(**options) -> bytes:
    b = writer.Builder()
    b.page(writer.PageBuilder().text(72, 720, "Hello World", 24))
    b.page(writer.PageBuilder(842, 595).text(100, 100, "Zweite Seite: äöüß", 12, "Times-Roman"), Rotate=90)
    b.set_info(Title="Test Document", Author="Ünï", Keywords="日本")
    return b.build(**options)


VALUES = st.recursive(
    st.one_of(st.none(), st.booleans(), st.integers(-(10**9), 10**9), st.binary(max_size=12), st.text("abc #/()é", max_size=6).map(Name), st.builds(Ref, st.integers(1, 99), st.integers(0, 5))),
    lambda v: st.one_of(st.lists(v, max_size=4), st.dictionaries(st.text("abcXYZ", min_size=1, max_size=5), v, max_size=4)),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_objects_round_trip(value):
    assert Lexer(write_object(value) + b" ").object() == value


def test_tokens():
    lex = Lexer(b"% note\n/Na#20me (a\\(b\\)\\101(in)\\\n) <48 65 6> 12 -.5 +7 [1 2 R 3 0 R] true")
    assert lex.object() == "Na me" and lex.object() == b"a(b)A(in)" and lex.object() == b"He`"
    assert [lex.object() for _ in range(5)] == [12, -0.5, 7, [Ref(1, 2), Ref(3, 0)], True]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600))
def test_filters_round_trip(data):
    assert filters.hex_decode(filters.hex_encode(data)) == data
    assert filters.a85_decode(filters.a85_encode(data)) == data
    assert filters.run_length_decode(filters.run_length_encode(data)) == data
    chain = {"Filter": [Name("ASCII85Decode"), Name("FlateDecode")]}
    assert filters.decode(filters.a85_encode(filters.flate_encode(data)), chain) == data
    raw = zlib.compressobj(wbits=-15)
    assert filters.flate_decode(raw.compress(data) + raw.flush()) == data


def test_lzw_and_predictors():
    assert filters.lzw_decode(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    rows = bytes([1, 10, 1, 1, 2, 1, 2, 3, 0, 5, 5, 5, 3, 2, 2, 2, 4, 1, 1, 1])
    out = filters.predict(rows, {"Predictor": 15, "Columns": 3})
    assert out == bytes([10, 11, 12, 11, 13, 15, 5, 5, 5, 4, 6, 7, 5, 7, 8])
    assert filters.predict(bytes([1, 1, 1, 5, 1, 1]), {"Predictor": 2, "Columns": 3}) == bytes([1, 2, 3, 5, 6, 7])
    with pytest.raises(PdfError):
        filters.predict(b"abc", {"Predictor": 7})


def test_damaged_streams():
    data = filters.flate_encode(b"some text " + bytes(range(256)) * 3 + b"".join(hashlib.sha256(bytes([k])).digest() for k in range(64)))
    part, status = filters.decode_tolerant(data[:-20], {"Filter": Name("FlateDecode")})
    assert status == "partial" and part.startswith(b"some text")
    assert filters.decode_tolerant(b"abc", {"Filter": Name("Nonsense")}) == (b"abc", "skipped")
    with pytest.raises(PdfError):
        filters.decode(b"abc", {"Filter": Name("Nonsense")})


@pytest.mark.parametrize("options", [{}, {"xref_stream": True}, {"pack": True}])
def test_write_and_read(options):
    doc = Document(hello(**options))
    pages = doc.pages()
    assert doc.page_count() == len(pages) == 2 and doc.version == "1.7" and not doc.encrypted
    assert [doc.page_boxes(p)["media_box"] for p in pages] == [[0, 0, 612, 792], [0, 0, 842, 595]] and doc.rotation(pages[1]) == 90
    assert doc.metadata() == {"Title": "Test Document", "Author": "Ünï", "Keywords": "日本"}
    chars = content.page_chars(doc, pages[0])
    assert chars[0][0] == "H" and abs(chars[0][1] - 72) < 0.1 and abs(chars[0][2] - 720) < 0.1 and abs(chars[0][3] - 24) < 0.1
    assert [w["text"] for w in layout.words_of(chars)] == ["Hello", "World"]
    assert "".join(c[0] for c in content.page_chars(doc, pages[1])) == "Zweite Seite: äöüß"


def test_bad_files():
    for data in (b"", b"short", b"plain text that is no document at all"):
        with pytest.raises(PdfError, match="NotPdf"):
            open_document(data)
    with pytest.raises(PdfError):
        open_document(b"%PDF-1.4\n" + b"x" * 40)
    assert parse_bytes(None)["status"] == parse_bytes(b"junk")["status"] == "error"


def test_repair():
    data = hello()
    cut = data[: data.rfind(b"xref\n0")] + b"trailer garbage"
    doc = open_document(cut)
    assert doc.repaired and len(doc.pages()) == 2
    with pytest.raises(PdfError):
        open_document(cut, repair=False)
    twice = data[: data.rfind(b"startxref")] + b"\n1 0 obj\n<</Type/Catalog/Pages 2 0 R/Mark 7>>\nendobj\n"
    assert rebuild(twice).catalog["Mark"] == 7
    packed = hello(pack=True)
    assert len(open_document(packed.replace(b"startxref", b"startxxxx")).pages()) == 2


def test_incremental_sections():
    data = hello()
    doc = Document(data)
    info = doc.trailer["Info"]
    new = writer.incremental(data, doc, {info.num: {"Title": b"Second"}})
    assert new.startswith(data) and Document(new).metadata() == {"Title": "Second"} and len(Document(new).pages()) == 2


@pytest.mark.parametrize("method", ["RC4-128", "AES-128", "AES-256"])
def test_encryption(method):
    data = hello(encrypt={"method": method, "user": "u", "owner": "o", "permissions": 4 | 16})
    doc = Document(data)
    assert doc.locked and not doc.authenticate("wrong")
    for password, owner in (("u", False), ("o", True)):
        doc = Document(data, password)
        assert not doc.locked and doc.security.owner == owner and doc.metadata()["Title"] == "Test Document"
        assert content.page_chars(doc, doc.pages()[0])[0][0] == "H"
        assert doc.security.permissions & 4 and not doc.security.permissions & 8
    open_ = Document(hello(encrypt={"method": method, "user": "", "owner": "o"}))
    assert not open_.locked and open_.metadata()["Author"] == "Ünï"
    assert Document(writer.Editor(Document(data, "u")).build()).metadata()["Title"] == "Test Document"


def test_ciphers_against_published_vectors():
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key, block = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypt.aes_ecb(key, block).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert crypt.aes_ecb(bytes(range(32)), block).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert crypt.aes_ecb(key, crypt.aes_ecb(key, block), decrypt=True) == block
    assert crypt.aes_cbc_encrypt(key, block, bytes(16), pad=False) == crypt.aes_ecb(key, block)
    assert crypt.aes_cbc_decrypt(key, crypt.aes_cbc_encrypt(key, b"text of any length")) == b"text of any length"


def test_merge_split_reorder():
    a, b = Document(hello()), Document(hello(pack=True))
    merged = Document(writer.merge([a, b, a]))
    texts = ["".join(c[0] for c in content.page_chars(merged, p)) for p in merged.pages()]
    assert texts == ["Hello World", "Zweite Seite: äöüß"] * 3
    picked = Document(writer.extract_pages(merged, [1, 0, 99, 0]))
    assert [picked.rotation(p) for p in picked.pages()] == [90, 0, 0] and len(picked.refs()) < len(merged.refs())
    e = writer.Editor(a)
    e.delete_page(0)
    e.insert_page(1, {"MediaBox": [0, 0, 10, 10]})
    out = Document(e.build())
    assert [out.page_boxes(p)["media_box"][2] for p in out.pages()] == [842, 10]
    with pytest.raises(PdfError):
        e.delete_page(9)


def test_inherited_entries_survive_merging():
    objects = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3), Ref(2)], "Count": 1, "MediaBox": [0, 0, 99, 98], "Rotate": 180},
        3: {"Type": Name("Pages"), "Kids": [Ref(4)], "Count": 1}, 4: {"Type": Name("Page"), "Parent": Ref(3)},
    }
    doc = Document(writer.merge([Document(writer.serialize(objects, Ref(1)))]))
    (page,) = doc.pages()
    assert doc.page_boxes(page)["media_box"] == [0, 0, 99, 98] and doc.rotation(page) == 180


def test_cleaning():
    b = writer.Builder()
    image = lambda: writer.rgb_image(2, 1, b"\x01\x02\x03\x04\x05\x06")
    for _ in range(3):
        b.page(writer.PageBuilder().image("I", image(), 0, 0, 10, 10))
    b.add({"Lost": True})
    data = b.build()
    e = writer.Editor(Document(data))
    counts = e.clean()
    assert counts["collected"] == 1 and counts["streams"] >= 2
    doc = Document(e.build())
    assert len(doc.pages()) == 3 and len(structure.images(doc)) == 1 and [r.num for r in doc.refs()] == list(range(1, len(doc.refs()) + 1))
    small, stats = writer.compress(data, "extreme")
    assert stats["after"] < stats["before"] and len(Document(small).pages()) == 3


def test_images_and_sizes():
    b = writer.Builder()
    jpeg = b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03" + bytes(12) + b"\xff\xd9"
    b.page(writer.PageBuilder().image("A", writer.jpeg_image(jpeg), 10, 20, 300, 200).image("A", writer.jpeg_image(jpeg), 0, 0, 30, 20).rect(50, 50, 600, 10).inline_image(1, 1, b"\x00\x01\x02", 0, 0, 5, 5))
    doc = Document(b.build())
    (page,) = doc.pages()
    first = structure.images(doc)[0]
    assert (first["width"], first["height"], first["n_components"], first["filter"]) == (32, 16, 3, "DCTDecode")
    assert content.image_sizes(doc, page)["A"] == (300.0, 200.0)
    assert content.page_bbox(doc, page) == [0, 0, 650, 220]
    assert "BI" in [op for op, _ in content.operations(doc.content(page))]


def test_structure():
    data = hello()
    e = writer.Editor(Document(data))
    p0, p1 = e.kids
    item = lambda title, **x: {"Title": title.encode()} | x
    o3 = e.add(item("Child", Dest=b"named"))
    o2 = e.add(item("Two", A={"S": Name("URI"), "URI": b"http://x"}, First=o3, Count=1))
    o1 = e.add(item("One", Dest=[p1, Name("Fit")], Next=o2))
    root = dict(e.objects[e.root.num])
    root["Outlines"] = e.add({"First": o1})
    root["Names"] = {"Dests": {"Names": [b"named", [p0, Name("XYZ"), 0, 0, 0]]}, "EmbeddedFiles": {"Names": [b"k", e.add({"F": b"a.txt", "EF": {"F": e.add(Stream({"Params": {"CheckSum": hashlib.md5(b"hi").digest()}}, b"hi"))}})]}}
    root["PageLabels"] = {"Nums": [0, {"S": Name("r")}, 1, {"S": Name("D"), "P": b"p", "St": 4}]}
    text_field = e.add({"T": b"name", "FT": Name("Tx"), "V": b"x"})
    box = e.add({"T": b"agree", "FT": Name("Btn"), "AP": {"N": {"Yes": None, "On": 1}}})
    fixed = e.add({"T": b"id", "FT": Name("Tx"), "Ff": 1, "V": b"7"})
    kid = e.add({"T": b"inner", "Opt": [b"a", [b"b", b"B"]], "Ff": 1 << 17})
    root["AcroForm"] = {"Fields": [text_field, box, fixed, e.add({"T": b"group", "FT": Name("Ch"), "Kids": [kid]})]}
    g1, g2 = e.add({"Type": Name("OCG"), "Name": b"L1"}), e.add({"Type": Name("OCG"), "Name": b"L2"})
    root["OCProperties"] = {"OCGs": [g1, g2], "D": {"OFF": [g2]}}
    e.objects[e.root.num] = root
    e.objects[p0.num] = e.objects[p0.num] | {"Annots": [{"Subtype": Name("Link"), "Rect": [1, 2, 3, 4], "A": {"S": Name("URI"), "URI": b"u"}}, {"Subtype": Name("Text")}]}
    doc = Document(e.build())
    found = structure.outlines(doc)
    assert [(o["title"], o["depth"], o["parent_id"], o["page"], o["uri"]) for o in found] == [("One", 0, -1, 1, None), ("Two", 0, -1, None, "http://x"), ("Child", 1, 1, 0, None)]
    labels = structure.page_labels(doc)
    assert [structure.label_of(labels, k) for k in range(3)] == ["i", "p4", "p5"]
    (f,) = structure.embedded_files(doc)
    assert f["filename"] == "a.txt" and f["size"] == 2 and f["checksum_ok"]
    fields = {x["name"]: x for x in structure.form_fields(doc)}
    assert set(fields) == {"name", "agree", "id", "group.inner"} and fields["group.inner"]["type"] == "combo" and fields["group.inner"]["options"] == ["a", "B"] and fields["id"]["read_only"]
    layers = structure.layers(doc)
    assert [(x["name"], x["visible"]) for x in layers] == [("L1", True), ("L2", False)]
    seen = {x["ref"]: x["visible"] for x in layers}
    groups = [Ref(x["ref"]) for x in layers]
    shows = lambda p: structure.membership_visible(doc, {"OCGs": groups, "P": Name(p)}, seen)
    assert [shows(p) for p in ("AllOn", "AnyOn", "AnyOff", "AllOff")] == [False, True, True, False]
    (a,) = structure.annotations(doc, doc.pages()[0])
    assert a["type"] == "Link" and a["uri"] == "u" and a["rect"] == [1, 2, 3, 4]
    edit = writer.Editor(doc)
    structure.fill_field(edit, doc, "name", "new")
    structure.toggle_checkbox(edit, doc, "agree")
    with pytest.raises(PdfError):
        structure.fill_field(edit, doc, "id", "8")
    after = {x["name"]: x["value"] for x in structure.form_fields(Document(edit.build()))}
    assert after["name"] == "new" and after["agree"] in ("On", "Yes")
    row = parse_bytes(e.build())
    assert row["status"] == "ok" and row["page_count"] == 2 and len(row["outlines"]) == 3


def test_numbers():
    assert [structure.roman(n) for n in (1, 4, 9, 40, 90, 1994, 0)] == ["I", "IV", "IX", "XL", "XC", "MCMXCIV", ""]
    assert [structure.alpha(n) for n in (1, 26, 27, 28, 703)] == ["A", "Z", "AA", "AB", "AAA"]


def word(text, x, y, size=10.0, width=None):
    return {"text": text, "x": x, "y": y, "width": width or 6.0 * len(text), "font_size": size}


def test_layout():
    lines = layout.lines_of([word("C", 72, 700), word("B", 150, 720), word("A", 72, 720.5)])
    assert [x["text"] for x in lines] == ["A B", "C"]
    assert layout.block_text(["This is a long para-", "graph continues here"]) == "This is a long para\ngraph continues here"
    assert layout.block_text(["This is a long para-", "graph continues here"], "joined") == "This is a long paragraph continues here"
    two = [word(t, x, y) for t, x, y in (("l1", 72, 720), ("r1", 320, 720 - 20), ("l2", 72, 708), ("r2", 320, 688))]
    blocks = layout.blocks_of(layout.lines_of(two))
    assert [b["text"] for b in blocks] == ["l1\nl2", "r1\nr2"]
    assert [w["text"] for w in layout.reading_order([word("C", 72, 700), word("A", 72, 720), word("B", 150, 720)])] == ["A", "B", "C"]


def test_text_machine():
    def words(stream):
        m = content.TextMachine({})
        for op, args in content.operations(stream):
            m.step(op, args)
        return [w["text"] for w in layout.words_of(m.chars)], m.chars

    assert words(b"BT /F 10 Tf 1 0 0 1 5 7 Tm [(ab) -20 (cd) -2000 (ef)] TJ T* ET")[0] == ["abcd", "ef"]
    _, chars = words(b"q 2 0 0 2 0 0 cm BT /F 10 Tf 14 TL 10 20 Td (a) Tj (b) ' 3 1 (c) \" ET Q")
    assert [(c[0], c[1], c[2], c[3]) for c in chars] == [("a", 20.0, 40.0, 20.0), ("b", 20.0, 12.0, 20.0), ("c", 20.0, -16.0, 20.0)]


def test_type0_fonts():
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <0041> endbfchar 2 beginbfrange <0002> <0004> <0062> <0010> <0011> [<0078> <0079>] endbfrange"
    objects = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 2: {"Kids": [Ref(3)], "Count": 1},
        3: {"Type": Name("Page"), "Contents": Ref(4), "Resources": {"Font": {"F": {"Subtype": Name("Type0"), "ToUnicode": Ref(5), "DescendantFonts": [{"DW": 700, "W": [1, [500, 600], 16, 17, 300]}]}}}},
        4: Stream({}, b"BT /F 10 Tf <000100020003000400100011> Tj ET"), 5: Stream({}, cmap),
    }
    doc = Document(writer.serialize(objects, Ref(1)))
    chars = content.page_chars(doc, doc.pages()[0])
    assert "".join(c[0] for c in chars) == "Abcdxy" and [round(c[5], 3) for c in chars] == [5, 6, 7, 7, 3, 3]


def test_journal():
    j = writer.Journal()
    j.record("a", None, 1)
    j.begin()
    j.record("a", 1, 2)
    j.record("b", None, 5)
    j.end()
    assert j.state() == {"a": 2, "b": 5}
    assert [o["key"] for o in j.undo()] == ["b", "a"] and j.state() == {"a": 1}
    again = writer.Journal.from_bytes(j.to_bytes())
    again.redo()
    assert again.state() == {"a": 2, "b": 5} and not again.redo()


def texts(data: bytes) -> list[str]:
    doc = Document(data)
    return [layout.plain_text(layout.blocks_of(layout.lines_of(layout.words_of(content.page_chars(doc, p))))) for p in doc.pages()]


def test_writing_structure():
    from quire.pdf import edit

    e = writer.Editor(Document(hello()))
    edit.set_outlines(e, [{"title": "A", "page": 0}, {"title": "Ä1", "page": 1, "depth": 1}, {"title": "B", "page": 1}])
    edit.set_page_labels(e, [{"start_page": 0, "style": "lower_roman"}, {"start_page": 1, "style": "decimal", "prefix": "p", "logical_start": 7}])
    one, two = edit.add_layer(e, "one"), edit.add_layer(e, "two", False)
    edit.set_layer_visible(e, one, False)
    edit.set_layer_visible(e, two, True)
    gone = edit.add_layer(e, "gone")
    edit.remove_layer(e, gone)
    edit.add_annotation(e, 0, edit.annotation("Link", [0, 0, 10, 10], uri="http://x"))
    edit.add_annotation(e, 0, edit.annotation("Highlight", [5, 5, 20, 10], "note", color=(1, 1, 0)))
    edit.delete_annotation(e, 0, 0)
    edit.add_embedded_file(e, "b.txt", b"bb", "text/plain", "what")
    edit.add_embedded_file(e, "a.txt", b"a")
    doc = Document(e.build())
    assert [(o["title"], o["depth"], o["page"]) for o in structure.outlines(doc)] == [("A", 0, 0), ("Ä1", 1, 1), ("B", 0, 1)]
    labels = structure.page_labels(doc)
    assert [structure.label_of(labels, k) for k in (0, 1)] == ["i", "p7"]
    assert [(x["name"], x["visible"]) for x in structure.layers(doc)] == [("one", False), ("two", True)]
    (a,) = structure.annotations(doc, doc.pages()[0])
    assert (a["type"], a["contents"]) == ("Highlight", "note")
    assert [(f["filename"], f["size"], f["checksum_ok"]) for f in structure.embedded_files(doc)] == [("a.txt", 1, True), ("b.txt", 2, True)]
    with pytest.raises(PdfError):
        edit.delete_annotation(e, 0, 5)


def test_redaction():
    from quire.pdf import edit

    b = writer.Builder()
    page = writer.PageBuilder().text(72, 700, "public secret public", 10, "Courier").text(72, 600, "stays", 10)
    b.page(page.image("I", writer.rgb_image(1, 1, b"abc"), 300, 300, 50, 50).image("J", writer.rgb_image(1, 1, b"xyz"), 0, 0, 5, 5))
    doc = Document(b.build())
    e = writer.Editor(doc)
    assert edit.redact(doc, e, 0, [[112, 690, 150, 710], [310, 310, 320, 320]]) == 2
    data = e.build()
    assert texts(data) == ["public public\n\nstays"] and b"secret" not in Document(data).content(Document(data).pages()[0])
    ops = [op for op, _ in content.operations(Document(data).content(Document(data).pages()[0]))]
    assert ops.count("Do") == 1 and ops.count("f") == 2
    words = layout.words_of(content.page_chars(Document(data), Document(data).pages()[0]))
    assert abs(words[1]["x"] - (72 + 14 * 6)) < 0.1


def test_flattening():
    from quire.pdf import edit

    e = writer.Editor(Document(hello()))
    field = e.add({"T": b"f", "FT": Name("Tx"), "V": b"filled in", "Subtype": Name("Widget"), "Rect": [100, 500, 300, 520]})
    e.objects[e.kids[0].num] = e.objects[e.kids[0].num] | {"Annots": [field]}
    e.objects[e.root.num] = e.objects[e.root.num] | {"AcroForm": {"Fields": [field]}}
    doc = Document(e.build())
    e = writer.Editor(doc)
    assert edit.flatten_form(doc, e) == 1
    flat = e.build()
    assert "filled in" in texts(flat)[0] and structure.form_fields(Document(flat)) == []


def test_fax_codes_are_prefix_free():
    from quire.pdf import fax

    for codes in (fax.WHITE + fax.LONG, fax.BLACK + fax.LONG, list(fax.MODES)):
        assert len(set(codes)) == len(codes) and not any(a != b and b.startswith(a) for a in codes for b in codes)
    assert len(fax.WHITE) == len(fax.BLACK) == 91 and sum(2.0 ** -len(c) for c in fax.WHITE + fax.LONG) < 1


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 70), st.lists(st.lists(st.tuples(st.integers(0, 40), st.booleans()), max_size=8), min_size=1, max_size=6))
def test_fax_round_trip(columns, rows):
    import numpy as np

    from quire.pdf import fax

    pixels = np.zeros((len(rows), columns), np.uint8)
    for r, runs in enumerate(rows):
        for at, on in runs:
            pixels[r, at:] = on
    out = filters.decode(fax.fax_encode(pixels), {"Filter": Name("CCITTFaxDecode"), "DecodeParms": {"K": -1, "Columns": columns, "Rows": len(rows), "BlackIs1": True}})
    assert (np.unpackbits(np.frombuffer(out, np.uint8).reshape(len(rows), -1), axis=1)[:, :columns] == pixels).all()


def test_fax_group_3():
    from quire.pdf import fax

    text = fax.EOL + fax.WHITE[4] + fax.BLACK[3] + fax.WHITE[1] + fax.EOL + fax.WHITE[0] + fax.BLACK[8] + fax.EOL * 6
    text += "0" * (-len(text) % 8)
    data = int(text, 2).to_bytes(len(text) // 8)
    assert fax.fax_decode(data, {"K": 0, "Columns": 8}) == bytes([0b11110001, 0b00000000])
    assert fax.fax_decode(b"", {"Columns": 8, "Rows": 1}) == b"\xff"
