"""Queries that write documents from the tables and read them again, and their SQL: structure, security, layout, editing and other formats."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.queries_base import query, spread, table
from quire.sources import documents, pdf

#: A line of text that the queries search for and measure, by its own words.
_TURNS = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, role, text FROM conversations"


def made(build: Callable[[dict], bytes | None], *columns: Column | str) -> Column:
    """A file made from each row's columns."""

    @F.arrow_udf("binary")
    def run(rows):
        import pyarrow as pa

        return pa.array([build(r) for r in rows.to_pylist()], pa.binary())

    return run(F.struct(*columns))


def _turns(spark, sf_dir) -> DataFrame:
    """conv_id and its turns in order: turns (role, text)."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(rows.alias("turns"))


def _paged(texts: list[str]):
    """An editor of a new document with a page for each text, its lines as they are."""
    from quire.pdf import writer
    from quire.pdf.document import Document

    return writer.Editor(Document(writer.lines_to_pdf([t.split("\n") for t in texts] or [[]])))


def _supplier_lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


# --- structure ---


@query(f"""
SELECT conv_id, k AS node_id, CASE WHEN k % 2 = 1 THEN k - 1 ELSE -1 END AS parent_id, CASE WHEN k % 2 = 1 THEN 0 ELSE k // 2 END AS ord, k % 2 AS depth,
  role || ' ' || k AS title, k AS page, k % 2 = 0 AND k + 1 < count(*) OVER (PARTITION BY conv_id) AS is_open
FROM ({_TURNS})""")
def pdf_outlines(spark, sf_dir):
    """An outline item for each turn, every second below the one before."""
    from quire.pdf import edit

    def build(r):
        e = _paged([str(k) for k in range(len(r["turns"]))])
        edit.set_outlines(e, [{"title": f"{t['role']} {k}", "page": k, "depth": k % 2} for k, t in enumerate(r["turns"])])
        return e.build()

    files = _turns(spark, sf_dir).select("conv_id", made(build, "turns").alias("content"))
    o = pdf.table(pdf.parse(files, "conv_id", parts=["outlines"]), "outlines", "conv_id")
    return o.select("conv_id", *(F.col(c).cast("long").alias(c) for c in ("node_id", "parent_id", "ord", "depth", "page")), "title", "is_open")


@query(f"""
SELECT conv_id, k AS page_index, CASE WHEN k = 0 THEN 'i' WHEN k = 1 THEN 'ii' WHEN k < 5 THEN 'A-' || (k + 3) ELSE chr(CAST(ascii('a') + (k - 5) % 26 AS INT)) END AS label
FROM ({_TURNS}) WHERE k < 31""")
def pdf_page_labels(spark, sf_dir):
    """Labels in three ranges: small roman, decimal with a prefix, small letters."""
    from quire.pdf import edit

    def build(r):
        e = _paged([""] * min(len(r["turns"]), 31))
        edit.set_page_labels(e, [
            {"start_page": 0, "style": "lower_roman"}, {"start_page": 2, "style": "decimal", "prefix": "A-", "logical_start": 5}, {"start_page": 5, "style": "lower_alpha"},
        ])
        return e.build()

    files = _turns(spark, sf_dir).select("conv_id", made(build, "turns").alias("content"))
    parsed = pdf.parse(files, "conv_id", parts=["raw"])
    return pdf.pages(parsed, "conv_id").select("conv_id", F.col("page_index").cast("long").alias("page_index"), "label")


@query("""
SELECT s_suppkey, 0 AS annot_seq, 'Link' AS type, NULL AS contents, 'http://example.net/' || s_suppkey AS uri, 10.0 AS llx, CAST(20 + s_suppkey % 50 AS DOUBLE) AS lly FROM supplier
UNION ALL SELECT s_suppkey, 1, 'Highlight', s_name || ' (é)', NULL, 5.0, 6.0 FROM supplier WHERE s_suppkey % 3 = 0""")
def pdf_annotations(spark, sf_dir):
    from quire.pdf import edit

    def build(r):
        e = _paged(["x"])
        y = 20 + r["s_suppkey"] % 50
        edit.add_annotation(e, 0, edit.annotation("Link", [10, y, 90, y + 10], uri=f"http://example.net/{r['s_suppkey']}"))
        edit.add_annotation(e, 0, edit.annotation("Highlight", [5, 6, 50, 60], r["s_name"] + " (é)"))
        if r["s_suppkey"] % 3:
            edit.delete_annotation(e, 0, 1)
        return e.build()

    files = _supplier_lines(spark, sf_dir).select("s_suppkey", made(build, "s_suppkey", "s_name").alias("content"))
    a = pdf.annotations(pdf.parse(files, "s_suppkey", parts=["annotations"]), "s_suppkey")
    return a.select("s_suppkey", "annot_seq", "type", "contents", "uri", F.col("rect.llx").alias("llx"), F.col("rect.lly").alias("lly"))


@query("""
SELECT c_custkey, 'name' AS name, 'text' AS type, c_name || ' Ω' AS value, true AS required, '' AS options FROM customer
UNION ALL SELECT c_custkey, 'segment', 'combo', c_mktsegment, false, 'AUTOMOBILE|BUILDING|FURNITURE|HOUSEHOLD|MACHINERY' FROM customer
UNION ALL SELECT c_custkey, 'solvent', 'checkbox', CASE WHEN c_acctbal > 0 THEN 'Yes' ELSE 'Off' END, false, '' FROM customer""")
def pdf_form_fields(spark, sf_dir):
    """Forms made, saved, opened again and filled in."""
    from quire.pdf import edit, structure, writer
    from quire.pdf.document import Document

    def build(r):
        e = _paged([""])
        edit.add_field(e, 0, "name", "text", [10, 10, 100, 20], flags=2)
        edit.add_field(e, 0, "segment", "combo", [10, 30, 100, 40], options=["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
        edit.add_field(e, 0, "solvent", "checkbox", [10, 50, 20, 60])
        doc = Document(e.build())
        e = writer.Editor(doc)
        structure.fill_field(e, doc, "name", r["c_name"] + " Ω")
        structure.fill_field(e, doc, "segment", r["c_mktsegment"])
        if r["c_acctbal"] > 0:
            structure.toggle_checkbox(e, doc, "solvent")
        return e.build()

    files = spread(table(spark, sf_dir, "customer")).select("c_custkey", made(build, "c_name", "c_mktsegment", "c_acctbal").alias("content"))
    f = pdf.table(pdf.parse(files, "c_custkey", parts=["fields"]), "fields", "c_custkey")
    return f.select("c_custkey", "name", "type", "value", "required", F.array_join("options", "|").alias("options"))


@query("""
SELECT s_suppkey, name, on_ AS visible FROM (SELECT s_suppkey, 'base ' || s_name AS name, true AS on_ FROM supplier
UNION ALL SELECT s_suppkey, 'draft', s_acctbal > 5000 FROM supplier UNION ALL SELECT s_suppkey, 'extra', false FROM supplier WHERE s_suppkey % 2 = 0)""")
def pdf_layers(spark, sf_dir):
    from quire.pdf import edit

    def build(r):
        e = _paged(["x"])
        edit.add_layer(e, "base " + r["s_name"])
        draft = edit.add_layer(e, "draft", False)
        edit.set_layer_visible(e, draft, r["s_acctbal"] > 5000)
        extra = edit.add_layer(e, "extra", False)
        if r["s_suppkey"] % 2:
            edit.remove_layer(e, extra)
        return e.build()

    files = _supplier_lines(spark, sf_dir).select("s_suppkey", made(build, "s_suppkey", "s_name", "s_acctbal").alias("content"))
    return pdf.table(pdf.parse(files, "s_suppkey", parts=["layers"]), "layers", "s_suppkey").select("s_suppkey", "name", "visible")


@query("""SELECT item_id, 'item ' || item_id || '.txt' AS filename, 'text/plain' AS mime, CAST(octet_length(encode(text)) AS BIGINT) AS size, true AS checksum_ok, 'as it was' AS description FROM benchmark""")
def pdf_attachments(spark, sf_dir):
    from quire.pdf import edit

    def build(r):
        e = _paged([""])
        edit.add_embedded_file(e, f"item {r['item_id']}.txt", r["text"].encode(), "text/plain", "as it was")
        return e.build()

    files = table(spark, sf_dir, "benchmark").select("item_id", made(build, "item_id", "text").alias("content"))
    return pdf.table(pdf.parse(files, "item_id", parts=["files"]), "files", "item_id").select("item_id", "filename", "mime", "size", "checksum_ok", "description")


@query("""SELECT s_suppkey, 1 + s_suppkey % 4 AS width, 2 + s_suppkey % 3 AS height, 8 AS bpc, 3 AS n_components, 'FlateDecode' AS filter FROM supplier""")
def pdf_images(spark, sf_dir):
    from quire.pdf import writer

    def build(r):
        w, h = 1 + r["s_suppkey"] % 4, 2 + r["s_suppkey"] % 3
        b = writer.Builder()
        b.page(writer.PageBuilder().image("I", writer.rgb_image(w, h, bytes(3 * w * h)), 10, 10, 50, 50))
        return b.build()

    files = _supplier_lines(spark, sf_dir).select("s_suppkey", made(build, "s_suppkey").alias("content"))
    i = pdf.table(pdf.parse(files, "s_suppkey", parts=["images"]), "images", "s_suppkey")
    return i.select("s_suppkey", *(F.col(c).cast("long").alias(c) for c in ("width", "height", "bpc", "n_components")), "filter")


@query("""
SELECT s_suppkey, 'F1' AS res_name, 'Helvetica' AS base_font, 'Type1' AS subtype, false AS embedded FROM supplier
UNION ALL SELECT s_suppkey, 'F2', CASE s_suppkey % 3 WHEN 0 THEN 'Times-Roman' WHEN 1 THEN 'Courier-Bold' ELSE 'Symbol' END, 'Type1', false FROM supplier""")
def pdf_fonts(spark, sf_dir):
    from quire.pdf import writer

    def build(r):
        b = writer.Builder()
        b.page(writer.PageBuilder().text(10, 10, "a").text(10, 30, "b", 12, ("Times-Roman", "Courier-Bold", "Symbol")[r["s_suppkey"] % 3]))
        return b.build()

    files = _supplier_lines(spark, sf_dir).select("s_suppkey", made(build, "s_suppkey").alias("content"))
    return pdf.table(pdf.parse(files, "s_suppkey", parts=["fonts"]), "fonts", "s_suppkey").select("s_suppkey", "res_name", "base_font", "subtype", "embedded")


@query("""
SELECT s_suppkey, s_suppkey % 4 * 90 AS rotate, 0.0 AS llx, CAST(300 + s_suppkey AS DOUBLE) AS urx, 15.0 AS crop_llx,
  20.0 AS box_llx, CAST(30 + s_suppkey % 7 AS DOUBLE) AS box_lly, 60.0 AS box_urx, CAST(35 + s_suppkey % 7 AS DOUBLE) AS box_ury FROM supplier""")
def pdf_boxes(spark, sf_dir):
    """Media and crop boxes, rotation, and the box of what is painted."""
    from quire.pdf import writer

    def build(r):
        k = r["s_suppkey"]
        b = writer.Builder()
        b.page(writer.PageBuilder(300 + k, 400).rect(20, 30 + k % 7, 40, 5, (1, 0, 0)), CropBox=[15, 15, 200, 200], Rotate=k % 4 * 90 - 360)
        return b.build()

    files = _supplier_lines(spark, sf_dir).select("s_suppkey", made(build, "s_suppkey").alias("content"))
    p = pdf.pages(pdf.parse(files, "s_suppkey", parts=["bbox"]), "s_suppkey")
    return p.select(
        "s_suppkey", F.col("rotate").cast("long").alias("rotate"), F.col("media_box.llx").alias("llx"), F.col("media_box.urx").alias("urx"), F.col("crop_box.llx").alias("crop_llx"),
        *(F.col(f"bbox.{c}").alias(f"box_{c}") for c in ("llx", "lly", "urx", "ury")),
    )


# --- damage, saving, security ---

_PLAIN = "md5(regexp_replace(text, '\\s+', '', 'g'))"


def _digest() -> Column:
    """Of the glyphs of all pages without white space."""
    raw = F.array_join(F.transform("pages", lambda p: p["raw"]), "")
    return F.md5(F.regexp_replace(raw, r"\s+", ""))


def _wrapped(text: str) -> list[list[str]]:
    from quire.operators.pages import PAGE_LINES, wrap

    lines = wrap(text or "")
    return [lines[k : k + PAGE_LINES] for k in range(0, len(lines), PAGE_LINES)] or [[]]


@query(f"""
SELECT item_id, how, CASE WHEN how = 'whole' THEN 'ok' ELSE 'repaired' END AS status, {_PLAIN} AS digest
FROM benchmark, (VALUES ('whole'), ('cut'), ('moved'), ('no end')) v(how)""")
def pdf_repair(spark, sf_dir):
    """Files without cross references, with wrong ones, or without an end."""
    from quire.pdf import writer

    def build(r):
        data = writer.lines_to_pdf(_wrapped(r["text"]))
        at = data.rfind(b"xref\n0")
        return {"whole": data, "cut": data[:at], "moved": b"%PDF-1.7\n% moved\n" + data, "no end": data[: data.rfind(b"startxref")]}[r["how"]]

    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(F.array(*map(F.lit, ("whole", "cut", "moved", "no end")))).alias("how"))
    files = rows.select(F.struct("item_id", "how").alias("key"), made(build, "text", "how").alias("content"))
    return pdf.parse(files, "key", parts=["raw"]).select("key.item_id", "key.how", "status", _digest().alias("digest"))


@query(f"""SELECT item_id, 'saved ' || item_id AS title, true AS old_bytes_stay, 1 AS n_pages, {_PLAIN} AS digest FROM benchmark""")
def pdf_incremental(spark, sf_dir):
    """A change appended to the file: the old bytes stay and the new title is read."""
    from quire.pdf import writer
    from quire.pdf.document import Document
    from quire.pdf.syntax import Ref, text_string

    def old(r):
        return writer.lines_to_pdf(_wrapped(r["text"]), "first")

    def new(r):
        doc = Document(r["before"])
        info = doc.trailer["Info"]
        assert isinstance(info, Ref)
        return writer.incremental(r["before"], doc, {info.num: {"Title": text_string(f"saved {r['item_id']}")}})

    rows = table(spark, sf_dir, "benchmark").select("item_id", made(old, "text").alias("before"))
    files = rows.select("item_id", "before", made(new, "item_id", "before").alias("content"))
    keyed = files.select(F.struct("item_id", F.startswith("content", "before").alias("old_bytes_stay")).alias("key"), "content")
    p = pdf.parse(keyed, "key", parts=["raw"])
    return p.select("key.item_id", F.element_at("metadata", "Title").alias("title"), "key.old_bytes_stay", F.col("page_count").cast("long").alias("n_pages"), _digest().alias("digest"))


@query(f"""
SELECT item_id, method, password, password <> 'wrong' AS opened, true AS encrypted, CASE WHEN password <> 'wrong' THEN {_PLAIN} END AS digest,
  CASE WHEN item_id % 2 = 1 THEN -8 ELSE -4 END AS permissions
FROM benchmark, (VALUES ('RC4-128'), ('AES-128'), ('AES-256')) m(method), (VALUES ('user é'), ('owner'), ('wrong')) p(password)""")
def pdf_security(spark, sf_dir):
    """Each method of encryption, opened with either password and with a wrong one."""
    from quire.pdf import content, writer
    from quire.pdf.document import open_document

    def build(r):
        return writer.lines_to_pdf(_wrapped(r["text"]), encrypt={"method": r["method"], "user": "user é", "owner": "owner", "permissions": ~4 if r["item_id"] % 2 else -1})

    opened = "opened boolean, encrypted boolean, permissions int, raw string"

    @F.pandas_udf(opened)
    def read(files, passwords):
        import pandas as pd

        rows = []
        for data, password in zip(files, passwords):
            doc = open_document(bytes(data), password)
            raw = None if doc.locked else "".join(c[0] for p in doc.pages() for c in content.page_chars(doc, p))
            rows.append((not doc.locked, doc.encrypted, doc.security.permissions, raw))
        return pd.DataFrame(rows, columns=["opened", "encrypted", "permissions", "raw"])

    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(F.array(*map(F.lit, ("RC4-128", "AES-128", "AES-256")))).alias("method"))
    rows = spread(rows)
    files = rows.select("item_id", "method", made(build, "item_id", "text", "method").alias("content"))
    tried = files.select("item_id", "method", "content", F.explode(F.array(*map(F.lit, ("user é", "owner", "wrong")))).alias("password"))
    got = tried.select("item_id", "method", "password", read("content", "password").alias("r"))
    return got.select("item_id", "method", "password", "r.opened", "r.encrypted", F.md5(F.regexp_replace("r.raw", r"\s+", "")).alias("digest"), "r.permissions")


@query(f"""
SELECT item_id, kind, 'ok' AS status, {_PLAIN} AS digest FROM benchmark, (VALUES ('table'), ('stream'), ('packed')) v(kind)""")
def pdf_cross_references(spark, sf_dir):
    """Cross references as a table, as a stream, and with objects packed into streams."""
    from quire.pdf import writer

    def build(r):
        return writer.lines_to_pdf(_wrapped(r["text"]), xref_stream=r["kind"] == "stream", pack=r["kind"] == "packed")

    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(F.array(*map(F.lit, ("table", "stream", "packed")))).alias("kind"))
    files = rows.select(F.struct("item_id", "kind").alias("key"), made(build, "text", "kind").alias("content"))
    return pdf.parse(files, "key", parts=["raw"]).select("key.item_id", "key.kind", "status", _digest().alias("digest"))


@query("""SELECT s_suppkey, s_suppkey % 5 AS unreachable, s_suppkey % 3 AS equal_streams, 1 AS pages FROM supplier""")
def pdf_garbage(spark, sf_dir):
    """Objects that nothing reaches, and equal streams, are taken out."""
    from quire.pdf import writer
    from quire.pdf.document import Document
    from quire.pdf.syntax import Name, Stream

    counts = "unreachable long, equal_streams long, pages long"

    @F.pandas_udf(counts)
    def cleaned(keys):
        import pandas as pd

        rows = []
        for k in keys:
            e = _paged(["x"])
            page = e.kids[0].num
            held = [e.add(Stream({"N": 1}, b"same")) for _ in range(k % 3 + 1)]
            e.objects[page] = e.objects[page] | {"PieceInfo": {"A": {"Private": held}, "T": Name("x")}}
            for j in range(k % 5):
                e.add({"Lost": j})
            again = writer.Editor(Document(e.build()))
            lost, equal = again.garbage_collect(), again.dedup_streams()
            rows.append((lost, equal, len(Document(again.build()).pages())))
        return pd.DataFrame(rows, columns=["unreachable", "equal_streams", "pages"])

    return _supplier_lines(spark, sf_dir).select("s_suppkey", cleaned("s_suppkey").alias("r")).select("s_suppkey", "r.*")


@query(f"""
SELECT item_id, filter, md5(text) AS digest, true AS smaller_or_plain
FROM benchmark, (VALUES ('FlateDecode'), ('ASCIIHexDecode'), ('ASCII85Decode'), ('RunLengthDecode'), ('ASCII85Decode,FlateDecode')) v(filter)""")
def stream_filters(spark, sf_dir):
    """Streams coded by each filter and decoded by name."""
    from quire.pdf import filters
    from quire.pdf.syntax import Name

    encode = {"FlateDecode": filters.flate_encode, "ASCIIHexDecode": filters.hex_encode, "ASCII85Decode": filters.a85_encode, "RunLengthDecode": filters.run_length_encode}

    def coded(r):
        data = r["text"].encode()
        for name in reversed(r["filter"].split(",")):
            data = encode[name](data)
        return data

    def decoded(r):
        return filters.decode(r["coded"], {"Filter": [Name(n) for n in r["filter"].split(",")]})

    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(F.array(*map(F.lit, (*encode, "ASCII85Decode,FlateDecode")))).alias("filter"))
    rows = rows.select("item_id", "filter", "text", made(coded, "text", "filter").alias("coded"))
    plain = rows.withColumn("plain", made(decoded, "coded", "filter"))
    small = (F.col("filter") != "FlateDecode") | (F.length("coded") < F.octet_length("text"))
    return plain.select("item_id", "filter", F.md5("plain").alias("digest"), small.alias("smaller_or_plain"))


@query(f"""
SELECT conv_id, count(*) AS pages, true AS linearized, count(*) AS hinted_pages, md5(regexp_replace(string_agg(text, '' ORDER BY k), '\\s+', '', 'g')) AS digest FROM ({_TURNS}) GROUP BY conv_id""")
def pdf_linearized(spark, sf_dir):
    """Laid out for fast web view: the hints count the pages, and the text is whole."""
    from quire.pdf import content
    from quire.pdf.document import Document, hint_tables
    from quire.pdf.linearize import linearize
    from quire.pdf.writer import lines_to_pdf

    def build(r):
        return linearize(Document(lines_to_pdf([page for t in r["turns"] for page in [sum(_wrapped(t["text"]), [])]])))

    @F.pandas_udf("pages long, linearized boolean, hinted_pages long, raw string")
    def read(files):
        import pandas as pd

        docs = [Document(bytes(d)) for d in files]
        return pd.DataFrame([
            (len(d.pages()), d.linearized, len(hint_tables(d)["pages"]), "".join(c[0] for p in d.pages() for c in content.page_chars(d, p))) for d in docs
        ], columns=["pages", "linearized", "hinted_pages", "raw"])

    r = _turns(spark, sf_dir).select("conv_id", read(made(build, "turns")).alias("r"))
    return r.select("conv_id", "r.pages", "r.linearized", "r.hinted_pages", F.md5(F.regexp_replace("r.raw", r"\s+", "")).alias("digest"))


@query("""
SELECT s_suppkey, 1 + s_suppkey % 3 * 50 + 49 AS width, true AS coded_as_jpeg, true AS close FROM supplier""")
def pdf_image_compression(spark, sf_dir):
    """Pictures drawn an inch wide, coded again at no more than 150 dots per inch, and close to what they were."""
    import numpy as np

    from quire.pdf import render, structure, writer
    from quire.pdf.document import Document

    def picture(n):
        y, x = np.mgrid[0:n, 0:n]
        noise = np.random.default_rng(n).integers(-9, 10, (n, n, 3))
        return (np.stack([128 + 90 * np.sin(x / 25), 128 + 70 * np.cos(y / 25), 90 + (x + y) / 3], 2) + noise).clip(0, 255).astype(np.uint8)

    def build(r):
        n = 1 + r["s_suppkey"] % 3 * 50 + 49
        b = writer.Builder()
        b.page(writer.PageBuilder().image("I", writer.rgb_image(n, n, picture(n).tobytes()), 10, 10, 72, 72))
        return writer.compress(b.build(), "high")[0]

    @F.pandas_udf("width long, coded_as_jpeg boolean, close boolean")
    def read(files):
        import pandas as pd

        rows = []
        for data in files:
            doc = Document(bytes(data))
            (image,) = structure.images(doc)
            s = next(v for r in doc.refs() if getattr(v := doc.resolve(r), "dict", {}).get("Subtype") == "Image")
            rows.append((image["width"], image["filter"] == "DCTDecode", bool(np.abs(render.image_pixels(doc, s).astype(int) - picture(image["width"])).mean() < 12)))
        return pd.DataFrame(rows, columns=["width", "coded_as_jpeg", "close"])

    rows = _supplier_lines(spark, sf_dir).select("s_suppkey", read(made(build, "s_suppkey")).alias("r"))
    return rows.select("s_suppkey", "r.*")


# --- text and layout ---

_LINES = """
SELECT item_id, k AS line_seq, regexp_replace(trim(line), '\\s+', ' ', 'g') AS text FROM (
  SELECT item_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS k FROM (
    SELECT item_id, list_transform(range(0, 12), lambda i: array_to_string(w[i * 6 + 1 : i * 6 + 6], ' ')) AS l FROM (
      SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1 : 72] AS w FROM benchmark)))
WHERE line <> ''"""


def _six_a_line(spark, sf_dir) -> DataFrame:
    """Test items with six words a line, as files."""
    from quire.pdf import writer

    def build(r):
        w = r["text"].split()[:72]
        return writer.lines_to_pdf([[" ".join(w[k : k + 6]) for k in range(0, len(w), 6)]])

    return table(spark, sf_dir, "benchmark").select("item_id", made(build, "text").alias("content"))


@query(_LINES)
def pdf_lines(spark, sf_dir):
    """Lines found again from glyphs."""
    p = pdf.parse(_six_a_line(spark, sf_dir), "item_id", parts=["blocks"])
    return pdf.lines(p, "item_id").select("item_id", F.col("line_seq").cast("long").alias("line_seq"), "text")


@query("""
SELECT item_id, CAST(k - 1 AS BIGINT) AS word_seq, w AS text, CAST(72 + 6 * coalesce(list_sum(list_transform(l[(k - 1) // 6 * 6 + 1 : k - 1], lambda x: length(x) + 1)), 0) AS DOUBLE) AS x,
  CAST(710 - 12 * ((k - 1) // 6) AS DOUBLE) AS y, CAST(6 * length(w) AS DOUBLE) AS width
FROM (SELECT item_id, l, unnest(l) AS w, generate_subscripts(l, 1) AS k FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1 : 72] AS l FROM benchmark))""")
def pdf_words(spark, sf_dir):
    """Words with their places, in a font whose letters are 6 wide."""
    p = pdf.parse(_six_a_line(spark, sf_dir), "item_id", parts=["words"])
    return pdf.words(p, "item_id").select("item_id", F.col("word_seq").cast("long").alias("word_seq"), "text", *(F.round(c, 3).alias(c) for c in ("x", "y", "width")))


@query("""
SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS block_seq, n_name || ' of' || chr(10) || 'region ' || n_regionkey AS text, 2 AS n_lines FROM nation""")
def pdf_blocks(spark, sf_dir):
    """Paragraphs of two lines, found again from the gaps between them."""
    files = _region_files(spark, sf_dir)
    b = pdf.blocks(pdf.parse(files, "n_regionkey", parts=["blocks"]), "n_regionkey")
    return b.select("n_regionkey", F.col("block_seq").cast("long").alias("block_seq"), "text", F.size("lines").cast("long").alias("n_lines"))


@query("""
SELECT n_regionkey, CAST(c AS BIGINT) AS column_seq, string_agg(n_name, chr(10) ORDER BY r) AS text FROM (
  SELECT *, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) AS r, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) % 2 AS c FROM nation)
GROUP BY n_regionkey, c""")
def pdf_columns(spark, sf_dir):
    """Two columns whose lines stand between each other's, read one after the other."""
    from quire.pdf import writer

    def build(r):
        p = writer.PageBuilder()
        for k, name in enumerate(r["names"]):
            p.text(72 + 300 * (k % 2), 700 - 14 * (k // 2) - 7 * (k % 2), name, 10)
        b = writer.Builder()
        b.page(p)
        return b.build()

    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    files = rows.select("n_regionkey", made(build, F.col("n.n_name").alias("names")).alias("content"))
    b = pdf.blocks(pdf.parse(files, "n_regionkey", parts=["blocks"]), "n_regionkey")
    return b.select("n_regionkey", F.col("block_seq").cast("long").alias("column_seq"), "text")


@query("""
SELECT s_suppkey, 2 AS char_start, 2 + length(s_name) AS char_end, s_name AS matched_text, 62.0 AS x0, 100.0 AS y0, CAST(62 + 6 * length(s_name) AS DOUBLE) AS x1, 110.0 AS y1 FROM supplier
""")
def pdf_hit_boxes(spark, sf_dir):
    """A hit's box, from a pattern, straight from the files."""
    from quire.pdf import writer

    def build(r):
        b = writer.Builder()
        b.page(writer.PageBuilder().text(50, 100, f"> {r['s_name']} <", 10, "Courier"))
        return b.build()

    files = _supplier_lines(spark, sf_dir).select("s_suppkey", made(build, "s_name").alias("content"))
    h = pdf.search_files(files, r"supplier#\d+", "s_suppkey", case_insensitive=True, regex=True, max_results=1)
    return h.groupBy("s_suppkey").agg(
        F.min("char_start").cast("long").alias("char_start"), F.max_by("char_end", "char_end").cast("long").alias("char_end"), F.max_by("matched_text", "char_end").alias("matched_text"),
        *(F.round(f(c), 3).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))),
    )


@query("""
SELECT n_nationkey, font, round(list_sum(list_transform(string_split(n_name, ''), lambda c: CASE font
    WHEN 'Helvetica' THEN CASE c WHEN 'N' THEN 722 WHEN 'A' THEN 667 WHEN 'T' THEN 611 WHEN 'I' THEN 278 WHEN 'O' THEN 778 WHEN '_' THEN 278 ELSE 556 END
    WHEN 'Times-Roman' THEN CASE c WHEN 'N' THEN 722 WHEN 'A' THEN 722 WHEN 'T' THEN 611 WHEN 'I' THEN 333 WHEN 'O' THEN 722 WHEN '_' THEN 250 ELSE 500 END
    ELSE 600 END)) * CAST(0.02 AS DOUBLE), 3) AS width
FROM nation, (VALUES ('Helvetica'), ('Times-Roman'), ('Courier')) f(font)""")
def pdf_word_widths(spark, sf_dir):
    """Words as wide as their letters in each of the standard fonts."""
    from quire.pdf import writer

    def build(r):
        b = writer.Builder()
        b.page(writer.PageBuilder().text(50, 100, r["n_name"], 20, r["font"]))
        return b.build()

    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.explode(F.array(*map(F.lit, ("Helvetica", "Times-Roman", "Courier")))).alias("font"))
    files = rows.select(F.struct("n_nationkey", "font").alias("key"), made(build, "n_name", "font").alias("content"))
    w = pdf.words(pdf.parse(files, "key", parts=["words"]), "key")
    return w.select("key.n_nationkey", "key.font", F.round("width", 3).alias("width"))


@query("""
SELECT n_regionkey, CAST(count(*) AS BIGINT) AS blocks, CAST(2 * count(*) AS BIGINT) AS lines, CAST(sum(length(n_name || ' ofregion ' || n_regionkey)) AS BIGINT) AS char_count,
  string_agg(n_name || ' of' || chr(10) || 'region ' || n_regionkey, '|' ORDER BY n_nationkey) AS texts FROM nation GROUP BY n_regionkey""")
def pdf_json(spark, sf_dir):
    """Pages as JSON, read as JSON."""
    files = _region_files(spark, sf_dir)
    j = pdf.formatted(pdf.parse(files, "n_regionkey", parts=["blocks", "chars"]), "json", "n_regionkey")
    shape = "array<struct<page_index:int,char_count:bigint,blocks:array<struct<text:string,lines:array<struct<text:string>>>>>>"
    p = j.select("n_regionkey", F.from_json(F.coalesce(F.get_json_object("json", "$.pages"), F.col("json")), shape).alias("p")).select("n_regionkey", F.col("p")[0].alias("p"))
    lines = F.aggregate("p.blocks", F.lit(0).cast("long"), lambda a, b: a + F.size(b["lines"]))
    return p.select("n_regionkey", F.size("p.blocks").cast("long").alias("blocks"), lines.alias("lines"), "p.char_count", F.array_join(F.col("p.blocks.text"), "|").alias("texts"))


def _region_files(spark, sf_dir) -> DataFrame:
    """Two lines for each nation of a region, with a gap behind."""
    from quire.pdf import writer

    def build(r):
        lines = []
        for name in r["names"]:
            lines += [name + " of", f"region {r['n_regionkey']}", ""]
        return writer.lines_to_pdf([lines])

    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    return rows.select("n_regionkey", made(build, "n_regionkey", F.col("n.n_name").alias("names")).alias("content"))


@query("""
SELECT n_regionkey, 'markdown' AS kind, '## Page 1' || chr(10) || chr(10) || string_agg(n_name || ' of' || chr(10) || 'region ' || n_regionkey, chr(10) || chr(10) ORDER BY n_nationkey) AS output FROM nation GROUP BY n_regionkey
UNION ALL
SELECT n_regionkey, 'html', '<h2>Page 1</h2>' || chr(10) || '<div class="page">' || chr(10) ||
  string_agg('  <p>' || n_name || ' of<br/>' || chr(10) || '    region ' || n_regionkey || '</p>' || chr(10), '' ORDER BY n_nationkey) || '</div>' || chr(10) || '</body>' || chr(10) || '</html>' FROM nation GROUP BY n_regionkey
UNION ALL
SELECT n_regionkey, 'text', string_agg(n_name || ' of' || chr(10) || 'region ' || n_regionkey, chr(10) || chr(10) ORDER BY n_nationkey) FROM nation GROUP BY n_regionkey""")
def pdf_output_formats(spark, sf_dir):
    """Files as Markdown, HTML (from its first heading on) and text."""
    parsed = pdf.parse(_region_files(spark, sf_dir), "n_regionkey", parts=["blocks", "text"])
    out = None
    for kind in ("markdown", "html", "text"):
        body = F.col(kind) if kind != "html" else F.regexp_replace(kind, "(?s)^.*?(?=<h2>)", "")
        part = pdf.formatted(parsed, kind, "n_regionkey").select("n_regionkey", F.lit(kind).alias("kind"), body.alias("output"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""
SELECT n_nationkey, how, how <> 'unsigned' AS signed, how = 'whole' AS valid, CASE WHEN how <> 'unsigned' THEN how <> 'changed' END AS digest_ok, CASE WHEN how <> 'unsigned' THEN 'CN=' || n_name END AS signer
FROM nation, (VALUES ('whole'), ('changed'), ('appended'), ('unsigned')) v(how)""")
def pdf_signatures(spark, sf_dir):
    """Signed files as they are, with a byte changed, with something appended; and one that is not signed."""
    from quire.pdf import sign, writer
    from quire.pdf.document import Document

    def prime(n):
        while any(pow(a, n - 1, n) != 1 for a in (2, 3, 5, 7, 11, 13)):
            n += 2
        return n

    p, q = prime(3**323 | 1), prime(5**220 | 1)
    n, e = p * q, 65537
    d = pow(e, -1, (p - 1) * (q - 1))

    def build(r):
        data = writer.lines_to_pdf([[r["n_name"]]], "T")
        if r["how"] == "unsigned":
            return data
        done = sign.sign(data, [sign.self_signed(r["n_name"], n, e, d)], n, d, "because")
        if r["how"] == "changed":
            return done.replace(b"because", b"becausE")
        doc = Document(done)
        return writer.incremental(done, doc, {doc.trailer["Info"].num: {"Title": b"new"}}) if r["how"] == "appended" else done

    @F.pandas_udf("signed boolean, valid boolean, digest_ok boolean, signer string")
    def check(files):
        import pandas as pd

        rows = []
        for data in files:
            found = sign.verify(Document(bytes(data)))
            rows.append((True, found[0]["valid"], found[0]["digest_ok"], found[0]["signer"]) if found else (False, False, None, None))
        return pd.DataFrame(rows, columns=["signed", "valid", "digest_ok", "signer"]).astype({"digest_ok": object})

    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.explode(F.array(*map(F.lit, ("whole", "changed", "appended", "unsigned")))).alias("how"))
    return rows.select("n_nationkey", "how", check(made(build, "n_name", "how")).alias("r")).select("n_nationkey", "how", "r.*")


@query("""
SELECT item_id, CAST(count(*) AS BIGINT) AS lines, md5(string_agg(text, '' ORDER BY line_seq)) AS digest FROM (""" + _LINES + """) WHERE line_seq <> 1 GROUP BY item_id""")
def pdf_redaction(spark, sf_dir):
    """The second line of every page is blacked out; its glyphs are gone from the file."""
    from quire.pdf import edit, writer
    from quire.pdf.document import Document

    def build(r):
        doc = Document(r["content"])
        e = writer.Editor(doc)
        edit.redact(doc, e, 0, [[0, 696, 612, 706]])
        return e.build()

    files = _six_a_line(spark, sf_dir).select("item_id", made(build, "content").alias("content"))
    lines = pdf.lines(pdf.parse(files, "item_id", parts=["blocks"]), "item_id")
    own = F.sort_array(F.collect_list(F.struct("line_seq", "text")))
    return lines.groupBy("item_id").agg(F.count("*").alias("lines"), F.md5(F.array_join(own["text"], "")).alias("digest"))


@query(f"""
SELECT conv_id, how, string_agg(k, ',' ORDER BY place) AS pages FROM (
  SELECT conv_id, k, how, place FROM ({_TURNS}), (VALUES ('reorder', 2, 0), ('reorder', 0, 1), ('reorder', 0, 2), ('extract', 1, 0), ('extract', 2, 1)) o(how, page, place) WHERE k = page
  UNION ALL SELECT conv_id, k, 'delete', k FROM ({_TURNS}) WHERE k <> 1)
GROUP BY conv_id, how""")
def pdf_page_edits(spark, sf_dir):
    """Pages of files reordered (and repeated), taken out, deleted."""
    from quire.pdf import writer
    from quire.pdf.document import Document

    def build(r):
        doc = Document(writer.lines_to_pdf([[f"p{k}"] for k in range(len(r["turns"]))]))
        if r["how"] == "extract":
            return writer.extract_pages(doc, [k for k in (1, 2) if k < len(r["turns"])])
        e = writer.Editor(doc)
        if r["how"] == "reorder":
            e.reorder([2, 0, 0, 99])
        elif len(r["turns"]) > 1:
            e.delete_page(1)
        return e.build()

    rows = _turns(spark, sf_dir).select("conv_id", "turns", F.explode(F.array(*map(F.lit, ("reorder", "extract", "delete")))).alias("how"))
    files = rows.select(F.struct("conv_id", "how").alias("key"), made(build, "turns", "how").alias("content"))
    p = pdf.parse(files, "key", parts=["raw"])
    pages = F.array_join(F.transform("pages", lambda x: F.substring(x["raw"], 2, 9)), ",")
    return p.select("key.conv_id", "key.how", pages.alias("pages")).where("pages <> ''")


@query("""SELECT s_suppkey, 612.0 AS width, true AS has_name, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS images FROM supplier""")
def pdf_svg(spark, sf_dir):
    """Pages as SVG: their text, and images by reference to their data."""
    from quire.pdf import render, writer
    from quire.pdf.document import Document

    def build(r):
        b, p = writer.Builder(), writer.PageBuilder().text(50, 100, r["s_name"], 10)
        if r["s_suppkey"] % 2 == 0:
            p.image("I", writer.rgb_image(2, 2, bytes(12)), 10, 10, 50, 50)
        b.page(p)
        return b.build()

    @F.arrow_udf("string")
    def drawn(files):
        import pyarrow as pa

        docs = [Document(d) for d in files.to_pylist()]
        return pa.array([render.to_svg(d, d.pages()[0]) for d in docs], pa.string())

    s = _supplier_lines(spark, sf_dir).select("s_suppkey", "s_name", drawn(made(build, "s_suppkey", "s_name")).alias("svg"))
    text = F.regexp_replace(F.regexp_replace("svg", "<[^>]*>", ""), r"\s+", "")
    return s.select(
        "s_suppkey", F.regexp_extract("svg", r'viewBox="[-0-9.]+ [-0-9.]+ ([0-9.]+)', 1).cast("double").alias("width"), F.contains(text, F.col("s_name")).alias("has_name"),
        F.regexp_count("svg", F.lit("<image")).cast("long").alias("images"),
    )


@query("""
SELECT s_suppkey, 'ok' AS status, 1 + s_suppkey % 3 AS page_count, s_suppkey % 3 AS image_count, s_suppkey % 3 > 0 AS has_image_bytes, s_suppkey % 2 = 1 AS encrypted FROM supplier""")
def pdf_analysis(spark, sf_dir):
    """Pages, images and encryption of files."""
    from quire.pdf import writer

    def build(r):
        k = r["s_suppkey"]
        b = writer.Builder()
        b.page(writer.PageBuilder().text(50, 50, "x"))
        for j in range(k % 3):
            b.page(writer.PageBuilder().image("I", writer.rgb_image(2 + j, 2, bytes(6 * (2 + j))), 1, 1, 9, 9))
        return b.build(encrypt={"method": "AES-128", "user": "", "owner": "o"} if k % 2 else None)

    files = _supplier_lines(spark, sf_dir).select("s_suppkey", made(build, "s_suppkey").alias("content"))
    a = pdf.summary(pdf.parse(files, "s_suppkey", parts=["images"]), "s_suppkey")
    return a.select(
        "s_suppkey", "status", F.col("page_count").cast("long").alias("page_count"), F.col("image_count").cast("long").alias("image_count"),
        (F.col("image_bytes") > 0).alias("has_image_bytes"), "encrypted",
    )


@query("""
SELECT p_partkey, round(x * x, 6) AS exponential, round(CASE WHEN x < 0.5 THEN 2 * x ELSE 2 - 2 * x END, 6) AS stitched, round(1 - x * x, 6) AS calculated,
  round(CASE WHEN x < 0.5 THEN 2 * x * 51 ELSE 51 + (x - 0.5) * 2 * 204 END / 255, 6) AS sampled
FROM (SELECT p_partkey, least(p_size, 50) / CAST(50 AS DOUBLE) AS x FROM part)""")
def pdf_functions(spark, sf_dir):
    """Functions of all four types, at many places."""

    @F.pandas_udf("exponential double, stitched double, calculated double, sampled double")
    def run(xs):
        import pandas as pd

        from quire.pdf.document import Document
        from quire.pdf.functions import Function
        from quire.pdf.syntax import Stream
        from quire.pdf.writer import lines_to_pdf

        doc = Document(lines_to_pdf([["x"]]))
        up, down = ({"FunctionType": 2, "Domain": [0, 1], "C0": [a], "C1": [b], "N": 1} for a, b in ((0, 1), (1, 0)))
        found = [Function(doc, f) for f in (
            {"FunctionType": 2, "Domain": [0, 1], "N": 2},
            {"FunctionType": 3, "Domain": [0, 1], "Functions": [up, down], "Bounds": [0.5], "Encode": [0, 1, 0, 1]},
            Stream({"FunctionType": 4, "Domain": [0, 1], "Range": [0, 1]}, b"{dup mul 1 exch sub}"),
            Stream({"FunctionType": 0, "Domain": [0, 1], "Range": [0, 1], "Size": [3], "BitsPerSample": 8}, b"\x00\x33\xff"),
        )]
        return pd.DataFrame([[f([float(x)])[0] for f in found] for x in xs], columns=["exponential", "stitched", "calculated", "sampled"])

    rows = table(spark, sf_dir, "part").select("p_partkey", run(F.least("p_size", F.lit(50)) / F.lit(50.0)).alias("r"))
    return rows.select("p_partkey", *(F.round(f"r.{c}", 6).alias(c) for c in ("exponential", "stitched", "calculated", "sampled")))


@query("""
SELECT p_partkey, round(x, 6) AS spot_r, round(1 - (1 - x) / 2, 6) AS spot_g, CAST(CASE WHEN p_size % 3 = 1 THEN 1 ELSE 0 END AS DOUBLE) AS indexed_r, round(x, 6) AS gray
FROM (SELECT p_partkey, p_size, 1 - least(p_size, 50) / CAST(50 AS DOUBLE) AS x FROM part)""")
def pdf_color_spaces(spark, sf_dir):
    """A spot colour by its tint, a colour by its index, and gray."""

    @F.pandas_udf("spot_r double, spot_g double, indexed_r double, gray double")
    def run(sizes):
        import pandas as pd

        from quire.pdf import color
        from quire.pdf.document import Document
        from quire.pdf.syntax import Name
        from quire.pdf.writer import lines_to_pdf

        doc = Document(lines_to_pdf([["x"]]))
        tint = {"FunctionType": 2, "Domain": [0, 1], "C0": [1, 1, 1], "C1": [0, 0.5, 1], "N": 1}
        spot = [Name("Separation"), Name("Spot"), Name("DeviceRGB"), tint]
        indexed = [Name("Indexed"), Name("DeviceRGB"), 2, b"\0\0\0\xff\0\0\0\xff\0"]
        rows = []
        for n in sizes:
            x = min(n, 50) / 50
            r, g, _ = color.to_rgb(doc, spot, [x])
            rows.append((r, g, color.to_rgb(doc, indexed, [n % 3])[0], color.to_rgb(doc, Name("DeviceGray"), [1 - x])[0]))
        return pd.DataFrame(rows, columns=["spot_r", "spot_g", "indexed_r", "gray"])

    rows = table(spark, sf_dir, "part").select("p_partkey", run("p_size").alias("r"))
    return rows.select("p_partkey", *(F.round(f"r.{c}", 6).alias(c) for c in ("spot_r", "spot_g", "indexed_r", "gray")))


@query("""
SELECT s_suppkey, CAST(200 AS BIGINT) AS width, CAST(100 AS BIGINT) AS height, 255 AS red_r, 0 AS red_g, s_suppkey % 100 < 50 AS left_is_red FROM supplier""")
def pdf_pictures(spark, sf_dir):
    """Pages drawn as pixels: where a red rectangle lies."""
    import numpy as np

    from quire.pdf import render, writer
    from quire.pdf.document import Document

    def build(r):
        b = writer.Builder()
        b.page(writer.PageBuilder(200, 100).rect(20 if r["s_suppkey"] % 100 < 50 else 120, 20, 60, 60, (1, 0, 0)))
        return b.build()

    @F.pandas_udf("width long, height long, red_r int, red_g int, left_is_red boolean")
    def drawn(files):
        import pandas as pd

        rows = []
        for data in files:
            doc = Document(bytes(data))
            p = render.to_pixels(doc, doc.pages()[0])
            ys, xs = np.nonzero(p[:, :, 1] == 0)
            rows.append((p.shape[1], p.shape[0], int(p[ys[0], xs[0], 0]), int(p[ys[0], xs[0], 1]), bool(xs.mean() < 100)))
        return pd.DataFrame(rows, columns=["width", "height", "red_r", "red_g", "left_is_red"])

    return _supplier_lines(spark, sf_dir).select("s_suppkey", drawn(made(build, "s_suppkey")).alias("r")).select("s_suppkey", "r.*")


@query("""
SELECT c_custkey, d, rotate, CASE rotate WHEN 0 THEN 5.0 WHEN 90 THEN 7.0 WHEN 180 THEN d - 5 ELSE 100.0 - 7 END AS x, CASE rotate WHEN 0 THEN 100.0 - 7 WHEN 90 THEN 5.0 WHEN 180 THEN 7.0 ELSE d - 5 END AS y
FROM (SELECT c_custkey, CAST(50 + c_custkey % 100 AS DOUBLE) AS d, c_custkey % 4 * 90 AS rotate FROM customer)""")
def page_rotation(spark, sf_dir):
    """Where a point of a turned page lies in its picture."""
    from quire.functions import geometry

    rows = table(spark, sf_dir, "customer").select("c_custkey", (50 + F.col("c_custkey") % 100).cast("double").alias("d"), (F.col("c_custkey") % 4 * 90).alias("rotate"))
    p = geometry.transform_point(geometry.page_transform(F.col("rotate"), F.col("d"), F.lit(100.0)), F.lit(5.0), F.lit(7.0))
    return rows.select("c_custkey", "d", "rotate", p.alias("p")).select("c_custkey", "d", "rotate", "p.x", "p.y")


@query("""
SELECT s_suppkey, length(code) * 16 + 2 * 16 - 1 AS modules, 'ok' AS check39, (11 * (length(code) + 2) + 13) AS modules128 FROM (SELECT s_suppkey, 'S' || s_suppkey || '-X' AS code FROM supplier)""")
def linear_barcodes(spark, sf_dir):
    """Code 39 and Code 128 symbols of suppliers' codes: how long they are, and that Code 39 begins and ends with its star."""
    from quire.functions import barcode

    code = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("-X"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", barcode.code39(code).alias("c39"), barcode.code128(code).alias("c128"), barcode.code39(F.lit("")).alias("none"))
    star = F.lit(barcode.code39_table()["*"])
    framed = F.startswith("c39", star) & F.endswith("c39", star)
    return rows.select(
        "s_suppkey", F.length("c39").cast("long").alias("modules"), F.when(framed, "ok").otherwise("bad").alias("check39"), F.length("c128").cast("long").alias("modules128"),
    )


# --- other formats ---


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def _read(rows: DataFrame, key: str, kind: str, content: Column) -> DataFrame:
    """key, status, title, author and pages of files of one kind."""
    files = rows.select(F.col(key).cast("string").alias("doc_id"), F.lit(kind).alias("format"), content.alias("content"))
    return documents.parse(files).withColumn(key, F.col("doc_id").cast("long"))


def _page_texts(read: DataFrame, key: str) -> DataFrame:
    return read.select(key, "title", F.explode("pages").alias("p")).select(key, "title", F.col("p.page_index").cast("long").alias("page_index"), F.col("p.text").alias("text"))


_CLEAN = "regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' +', ' ', 'g')"


@query(f"""SELECT conv_id, 'Talk ' || conv_id AS title, k AS page_index, md5({_CLEAN}) AS digest FROM ({_TURNS})""")
def epub_chapters(spark, sf_dir):
    """Conversations as books, a turn a chapter."""

    def build(r):
        n = len(r["turns"])
        opf = "<package xmlns:dc='d'><metadata><dc:title>Talk " + str(r["conv_id"]) + "</dc:title></metadata><manifest>"
        opf += "".join(f"<item id='c{k}' href='c{k}.xhtml'/>" for k in reversed(range(n))) + "</manifest><spine>" + "".join(f"<itemref idref='c{k}'/>" for k in range(n)) + "</spine></package>"
        chapters = {f"O/c{k}.xhtml": f"<html><head><title>no</title></head><body><p>{escape(' '.join(t['text'].split()))}</p></body></html>" for k, t in enumerate(r["turns"])}
        return _zip({"META-INF/container.xml": "<c><rootfiles><rootfile full-path='O/b.opf'/></rootfiles></c>", "O/b.opf": opf} | chapters)

    read = _read(_turns(spark, sf_dir), "conv_id", "Epub", made(build, "conv_id", "turns"))
    return _page_texts(read, "conv_id").select("conv_id", "title", "page_index", F.md5("text").alias("digest"))


@query("""
SELECT n_regionkey, 0 AS page_index, string_agg(n_nationkey || chr(9) || n_name || chr(9) || chr(9) || 'é & <' || n_regionkey, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey""")
def xlsx_sheets(spark, sf_dir):
    """A sheet with numbers, shared strings, a gap and inline strings."""

    def build(r):
        shared = "<s>" + "".join(f"<si><r><t>{n['n_name'][:3]}</t></r><r><t>{n['n_name'][3:]}</t></r></si>" for n in r["n"]) + "</s>"
        rows = "".join(
            f"<row><c r='A{k + 1}'><v>{n['n_nationkey']}</v></c><c r='B{k + 1}' t='s'><v>{k}</v></c><c r='D{k + 1}' t='inlineStr'><is><t>é &amp; &lt;{r['n_regionkey']}</t></is></c></row>"
            for k, n in enumerate(r["n"])
        )
        return _zip({"xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": f"<w><sheetData>{rows}</sheetData></w>"})

    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    return _page_texts(_read(rows, "n_regionkey", "Xlsx", made(build, "n_regionkey", "n")), "n_regionkey").select("n_regionkey", "page_index", "text")


@query(f"""SELECT conv_id, k AS page_index, md5({_CLEAN} || chr(10) || role) AS digest FROM ({_TURNS})""")
def pptx_slides(spark, sf_dir):
    """A slide for each turn; slides go by number, not by name."""

    def build(r):
        run = lambda t: f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>"
        return _zip({f"ppt/slides/slide{k + 1}.xml": f"<s xmlns:a='a'>{run(' '.join(t['text'].split()))}{run(t['role'])}</s>" for k, t in enumerate(r["turns"])})

    read = _read(_turns(spark, sf_dir), "conv_id", "Pptx", made(build, "turns"))
    return _page_texts(read, "conv_id").select("conv_id", "page_index", F.md5("text").alias("digest"))


@query(f"""SELECT conv_id, 'Book ' || conv_id AS title, k AS page_index, md5({_CLEAN}) AS digest FROM ({_TURNS})""")
def fb2_sections(spark, sf_dir):
    """Conversations as books, a turn a section."""

    def build(r):
        body = "".join(f"<section><p>{escape(' '.join(t['text'].split()))}</p></section>" for t in r["turns"])
        return f"<FictionBook><description><title-info><book-title>Book {r['conv_id']}</book-title></title-info></description><body>{body}</body></FictionBook>".encode()

    read = _read(_turns(spark, sf_dir), "conv_id", "Fb2", made(build, "conv_id", "turns"))
    return _page_texts(read, "conv_id").select("conv_id", "title", "page_index", F.md5("text").alias("digest"))


@query("""SELECT s_suppkey, 'Nr ' || s_suppkey AS title, 0 AS page_index, s_name || chr(10) || 'é & <' || s_nationkey AS text FROM supplier""")
def svg_texts(spark, sf_dir):
    """Texts of pictures, one of them in two pieces."""

    def build(r):
        return (
            f"<svg width='100' height='50' xmlns='http://www.w3.org/2000/svg'><title>Nr {r['s_suppkey']}</title><text>{r['s_name'][:4]}<tspan>{r['s_name'][4:]}</tspan></text>"
            f"<g><text>é &amp; &lt;{r['s_nationkey']}</text></g></svg>"
        ).encode()

    read = _read(_supplier_lines(spark, sf_dir), "s_suppkey", "Svg", made(build, "s_suppkey", "s_name", "s_nationkey"))
    return _page_texts(read, "s_suppkey").select("s_suppkey", "title", "page_index", "text")


@query("""SELECT s_suppkey, 'Docx' AS format, s_name || ' é' AS title, 'Nation ' || s_nationkey AS author, 'a' || chr(9) || 'b' || chr(10) || 'c' AS text FROM supplier""")
def office_metadata(spark, sf_dir):
    """Title and author of a word processor's file, and a text with tab and break."""

    def build(r):
        core = f"<c xmlns:dc='d'><dc:title> {r['s_name']} é</dc:title><dc:creator>Nation {r['s_nationkey']}</dc:creator></c>"
        return _zip({"word/document.xml": "<w:d xmlns:w='w'><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:p><w:r><w:t>c</w:t></w:r></w:p></w:d>", "docProps/core.xml": core})

    read = _read(_supplier_lines(spark, sf_dir), "s_suppkey", "Docx", made(build, "s_name", "s_nationkey"))
    return read.select("s_suppkey", "format", "title", "author", F.col("pages")[0]["text"].alias("text"))


@query("""SELECT s_suppkey, 'Book ' || s_suppkey AS title, s_name || ' & co' || chr(10) || 'nation ' || s_nationkey AS text FROM supplier""")
def mobi_books(spark, sf_dir):
    """Books in one record, without compression."""
    import struct

    def build(r):
        body = f"<p>{r['s_name']} &amp; co</p><br/>nation {r['s_nationkey']}".encode()
        header = struct.pack(">HHIHHI", 1, 0, len(body), 1, 4096, 0) + b"MOBI" + struct.pack(">III", 232, 2, 65001)
        head = f"Book {r['s_suppkey']}".encode().ljust(32, b"\0") + bytes(28) + b"BOOKMOBI" + bytes(8) + struct.pack(">H", 2)
        first = len(head) + 16 + 2
        return head + struct.pack(">IIII", first, 0, first + len(header), 0) + b"\0\0" + header + body

    read = _read(_supplier_lines(spark, sf_dir), "s_suppkey", "Mobi", made(build, "s_suppkey", "s_name", "s_nationkey"))
    return read.select("s_suppkey", "title", F.col("pages")[0]["text"].alias("text"))


@query("""
SELECT s_suppkey, 0 AS page_index, 72.0 AS width, CAST(75 + s_suppkey % 3 * 0.75 AS DOUBLE) AS height, s_name || chr(10) || '{' || s_nationkey || '}' AS text FROM supplier
UNION ALL SELECT s_suppkey, 1, 72.0, 75.0, 'second' FROM supplier""")
def xps_pages(spark, sf_dir):
    """Fixed pages with their sizes in points, and a text that begins with a brace."""

    def build(r):
        page = lambda h, *texts: f"<FixedPage Width='96' Height='{h}'>" + "".join(f"<Glyphs UnicodeString='{escape(t)}'/>" for t in texts) + "</FixedPage>"
        return _zip({
            "f.fdseq": "<s><DocumentReference Source='/D/1.fdoc'/></s>", "D/1.fdoc": "<d><PageContent Source='p/1.fpage'/><PageContent Source='p/2.fpage'/></d>",
            "D/p/1.fpage": page(100 + r["s_suppkey"] % 3, r["s_name"], "{}{" + str(r["s_nationkey"]) + "}"), "D/p/2.fpage": page(100, "second"),
        })

    read = _read(_supplier_lines(spark, sf_dir), "s_suppkey", "Xps", made(build, "s_suppkey", "s_name", "s_nationkey"))
    p = read.select("s_suppkey", F.explode("pages").alias("p"))
    return p.select("s_suppkey", F.col("p.page_index").cast("long").alias("page_index"), "p.width", "p.height", F.col("p.text").alias("text"))


@query("""SELECT s_suppkey, CAST(k AS BIGINT) AS page_index, CAST(10 * (k + 1) + s_suppkey AS DOUBLE) AS width, 40.0 AS height FROM supplier, (VALUES (0), (1), (2)) v(k)""")
def cbz_pages(spark, sf_dir):
    """Pictures by natural order of their names, with their sizes."""
    import struct

    def build(r):
        png = lambda w: b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, 40)
        return _zip({f"page{n}.png": png(10 * (k + 1) + r["s_suppkey"]) for n, k in ((10, 2), (9, 1), (2, 0))} | {"note.txt": "x"})

    read = _read(_supplier_lines(spark, sf_dir), "s_suppkey", "Cbz", made(build, "s_suppkey"))
    p = read.select("s_suppkey", F.explode("pages").alias("p"))
    return p.select("s_suppkey", F.col("p.page_index").cast("long").alias("page_index"), "p.width", "p.height")


@query("""SELECT page_id, 'ok' AS status, md5(html) AS digest FROM (SELECT page_id, regexp_replace(html, '[\\x00-\\x08\\x0b\\x0c\\x0d\\x0e-\\x1f]', '', 'g') AS html FROM pages)""")
def office_roundtrip(spark, sf_dir):
    """Whole pages, markup and all, as one paragraph each of a word processor's file, and read again. (What XML cannot hold is left out of both.)"""

    def build(r):
        return _zip({"word/document.xml": f"<d xmlns:w='w'><w:p><w:r><w:t>{escape(r['html'])}</w:t></w:r></w:p></d>"})

    rows = spread(table(spark, sf_dir, "pages")).select("page_id", F.regexp_replace("html", r"[\x00-\x08\x0b\x0c\x0d\x0e-\x1f]", "").alias("html"))
    read = _read(rows, "page_id", "Docx", made(build, "html"))
    return read.select("page_id", "status", F.md5(F.col("pages")[0]["text"]).alias("digest"))
