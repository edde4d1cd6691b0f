"""Documents as tables: files are read and parsed once, by one task each, into one nested row.

A bad file gives a row with status 'error' and its message; it never fails the
job. The narrow tables (pages, chars, words, lines, blocks and so on) are views
of the nested row: projections and explodes, which need no shuffle.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.pdf import content, layout, structure
from quire.pdf.document import open_document
from quire.pdf.syntax import PdfError, to_json

_BOX = "struct<llx:double,lly:double,urx:double,ury:double>"
_WORD = "struct<text:string,x:double,y:double,width:double,font_size:double>"
SCHEMA = f"""
status string, error string, version string, encrypted boolean, locked boolean, linearized boolean, repaired boolean, page_count int, permissions int,
metadata map<string,string>,
pages array<struct<page_index:int,media_box:{_BOX},crop_box:{_BOX},rotate:int,label:string,
  chars:array<struct<char_seq:int,unicode:string,x:double,y:double,font_size:double,font_name:string,width:double>>,
  words:array<{_WORD}>,
  blocks:array<struct<text:string,lines:array<struct<text:string,x:double,y:double,words:array<{_WORD}>>>>>,
  annotations:array<struct<annot_seq:int,type:string,rect:{_BOX},contents:string,flags:int,uri:string,data:string>>,
  bbox:{_BOX}, text:string, raw:string>>,
outlines array<struct<node_id:int,parent_id:int,ord:int,depth:int,title:string,is_open:boolean,page:int,uri:string>>,
fields array<struct<name:string,partial_name:string,type:string,flags:int,read_only:boolean,required:boolean,value:string,options:array<string>>>,
layers array<struct<ref:int,name:string,visible:boolean,locked:boolean>>,
files array<struct<filename:string,description:string,mime:string,size:bigint,checksum_ok:boolean>>,
signatures array<struct<filter:string,sub_filter:string,name:string,reason:string,signing_time:string,digest:string,in_bounds:boolean,modified_after:boolean>>,
images array<struct<obj_num:int,width:int,height:int,bpc:int,color_space:string,n_components:int,filter:string,is_mask:boolean,has_smask:boolean,bytes:bigint>>,
fonts array<struct<page_index:int,res_name:string,base_font:string,subtype:string,encoding:string,embedded:boolean,to_unicode:boolean>>,
invoice struct<filename:string,profile:string,invoice_number:string,issue_date:string,currency:string,grand_total:string,seller:string>,
edges array<struct<src:int,dst:int>>,
objects array<struct<obj_num:int,kind:string,value:string>>
"""


def _box(b):
    return None if b is None else dict(zip(("llx", "lly", "urx", "ury"), b))


def _kind(x) -> str:
    return {"NoneType": "null", "bool": "bool", "int": "integer", "float": "real", "bytes": "string", "list": "array"}.get(type(x).__name__, type(x).__name__.lower())


#: What a page has besides its boxes, rotation and label; raw is the glyphs' text in the order in which they are shown.
PAGE_PARTS = frozenset(["chars", "words", "blocks", "annotations", "bbox", "text", "raw"])


def parse_bytes(data: bytes | None, password: str = "", parts: frozenset[str] | None = None) -> dict:
    """One document as a nested row. parts: only these columns besides the plain ones (all if None).

    "pages" are pages with all their parts; any of PAGE_PARTS gives pages with
    these parts only, and nothing else is worked out.
    """
    want = lambda name: parts is None or name in parts
    own = PAGE_PARTS if want("pages") else PAGE_PARTS & parts
    try:
        if data is None:
            raise PdfError("NotPdf")
        doc = open_document(bytes(data), password)
        out: dict = {
            "status": "repaired" if doc.repaired else "ok", "version": doc.version, "encrypted": doc.encrypted, "locked": doc.locked, "linearized": doc.linearized,
            "repaired": doc.repaired, "permissions": doc.security.permissions if doc.security else -1,
        }
        if doc.locked:
            return out | {"status": "locked"}
        found = doc.pages()
        out |= {"page_count": len(found), "metadata": list(doc.metadata().items())}
        if own:
            page_of, labels = structure.page_numbers(doc), structure.page_labels(doc)
            out["pages"] = [_page(doc, k, p, page_of, labels, own) for k, p in enumerate(found)]
        for name, read in (
            ("outlines", structure.outlines), ("fields", structure.form_fields), ("layers", structure.layers), ("files", structure.embedded_files),
            ("signatures", structure.signatures), ("images", structure.images), ("invoice", structure.invoice),
        ):
            if want(name):
                out[name] = read(doc)
        if want("fonts"):
            out["fonts"] = [{"page_index": k, "res_name": n} | f.info() for k, p in enumerate(found) for n, f in content.fonts_of(doc, doc.resolve(p.get("Resources"))).items()]
        if want("edges"):
            out["edges"] = [{"src": a, "dst": b} for a, b in doc.edges()]
        if want("objects"):
            out["objects"] = [{"obj_num": r.num, "kind": _kind(v := doc.resolve(r)), "value": json.dumps(to_json(v), sort_keys=True, ensure_ascii=False)} for r in doc.refs()]
        return out
    except Exception as e:  # noqa: BLE001  (whatever a damaged file makes a reader raise)
        return {"status": "error", "error": str(e) or type(e).__name__}


def _page(doc, k: int, page: dict, page_of, labels, parts: frozenset[str] = PAGE_PARTS) -> dict:
    boxes = doc.page_boxes(page)
    out = {"page_index": k, "media_box": _box(boxes["media_box"]), "crop_box": _box(boxes["crop_box"]), "rotate": doc.rotation(page), "label": structure.label_of(labels, k)}
    chars = []
    if "bbox" in parts:
        chars, box = content.chars_and_bbox(doc, page)
        out["bbox"] = _box(box)
    elif parts - {"annotations"}:
        chars = content.page_chars(doc, page)
    if "chars" in parts:
        out["chars"] = chars
    if "raw" in parts:
        out["raw"] = "".join(c[0] for c in chars)
    if parts & {"words", "blocks", "text"}:
        words = layout.words_of(chars)
        if "words" in parts:
            out["words"] = words
        if parts & {"blocks", "text"}:
            blocks = layout.blocks_of(layout.lines_of(words))
            if "blocks" in parts:
                out["blocks"] = blocks
            if "text" in parts:
                out["text"] = layout.plain_text(blocks)
    if "annotations" in parts:
        out["annotations"] = [a | {"rect": _box(a["rect"]), "data": json.dumps(a["data"], sort_keys=True, ensure_ascii=False)} for a in structure.annotations(doc, page, page_of)]
    return out


def _chars_array(pages: list[dict], kind: pa.ListType) -> pa.Array:
    """The glyph tuples of pages as Arrow columns; no object is made for a glyph."""
    lists = [p.get("chars") for p in pages]
    columns = list(zip(*(c for own in lists for c in own or ()))) or [()] * 6
    n = [len(own or ()) for own in lists]
    seq = np.concatenate([np.arange(k, dtype=np.int32) for k in n]) if n else np.zeros(0, np.int32)
    fields = {f.name: f.type for f in kind.value_type}
    arrays = [pa.array(seq), *(pa.array(c, fields[name]) for c, name in zip(columns, ("unicode", "x", "y", "font_size", "font_name", "width")))]
    struct = pa.StructArray.from_arrays(arrays, names=["char_seq", "unicode", "x", "y", "font_size", "font_name", "width"])
    offsets = pa.array([None if own is None else at for own, at in zip(lists, np.cumsum([0, *n]).tolist())] + [sum(n)], pa.int32())
    return pa.ListArray.from_arrays(offsets, struct)


def _pages_array(rows: list[dict], kind: pa.ListType) -> pa.Array:
    lists = [r.get("pages") for r in rows]
    pages = [p for own in lists for p in own or ()]
    arrays = [_chars_array(pages, f.type) if f.name == "chars" else pa.array([p.get(f.name) for p in pages], f.type) for f in kind.value_type]
    struct = pa.StructArray.from_arrays(arrays, names=[f.name for f in kind.value_type])
    ends = np.cumsum([0, *(len(own or ()) for own in lists)]).tolist()
    return pa.ListArray.from_arrays(pa.array([None if own is None else at for own, at in zip(lists, ends)] + [ends[-1]], pa.int32()), struct)


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """doc_id (the path), length and content of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), "length", "content")


def parse(files: DataFrame, key: str = "doc_id", data: str = "content", password: str = "", parts: list[str] | None = None) -> DataFrame:
    """key and the nested row of every document."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMA)
    kind = files.select(key).schema[0].dataType
    full = StructType([files.select(key).schema[0], *schema.fields])
    wanted = None if parts is None else frozenset(parts)

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                own = batch.slice(at, 16)
                rows = [parse_bytes(d, password, wanted) for d in own.column(1).to_pylist()]
                columns = [_pages_array(rows, f.type) if f.name == "pages" else pa.array([r.get(f.name) for r in rows], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([own.column(0), *columns], names=[key, *arrow.names])

    del kind
    return files.select(key, F.col(data).cast("binary")).mapInArrow(run, full)


# --- narrow tables ---


def pages(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    return parsed.select(key, F.explode("pages").alias("p")).select(key, "p.page_index", "p.media_box", "p.crop_box", "p.rotate", "p.label", "p.bbox", "p.text", "p.blocks")


def _of_pages(parsed: DataFrame, key: str, name: str, seq: str | None = None) -> DataFrame:
    p = parsed.select(key, F.explode("pages").alias("p"))
    if seq:
        return p.select(key, "p.page_index", F.posexplode(f"p.{name}").alias(seq, "x")).select(key, "page_index", seq, "x.*")
    return p.select(key, "p.page_index", F.explode(f"p.{name}").alias("x")).select(key, "page_index", "x.*")


def chars(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    return _of_pages(parsed, key, "chars")


def words(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    return _of_pages(parsed, key, "words", "word_seq")


def blocks(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    return _of_pages(parsed, key, "blocks", "block_seq")


def lines(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    all_lines = F.flatten(F.transform("p.blocks", lambda b: b["lines"]))
    return parsed.select(key, F.explode("pages").alias("p")).select(key, "p.page_index", F.posexplode(all_lines).alias("line_seq", "x")).select(key, "page_index", "line_seq", "x.*")


def annotations(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    return _of_pages(parsed, key, "annotations")


def table(parsed: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """outlines, fields, layers, files, signatures, images, fonts, edges or objects."""
    return parsed.select(key, F.explode(name).alias("x")).select(key, "x.*")


def metadata(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    return parsed.select(key, F.explode("metadata").alias("key", "value"))


def summary(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages, images, image bytes and encryption of every document."""
    n = F.coalesce(F.aggregate("images", F.lit(0).cast("long"), lambda a, i: a + i["bytes"]), F.lit(0).cast("long"))
    return parsed.select(key, "status", "page_count", F.coalesce(F.array_size("images"), F.lit(0)).alias("image_count"), n.alias("image_bytes"), "encrypted")


_HIT = "matched_text:string,char_start:int,char_end:int,x0:double,y0:double,x1:double,y1:double"
_HIT_NAMES = [f.split(":")[0] for f in _HIT.split(",")]


def _compiled(pattern: str, case_insensitive: bool, regex: bool):
    import re

    from quire.operators.search import translate_pattern

    source = translate_pattern(pattern, "python") if regex else re.escape(pattern)
    return re.compile(f"(?=({source}))", re.IGNORECASE if case_insensitive else 0)


def search(parsed: DataFrame, pattern: str, key: str = "doc_id", case_insensitive: bool = False, regex: bool = False, max_results: int = 0) -> DataFrame:
    """Hits with boxes: page_index, matched_text, char_start, char_end, x0, y0, x1, y1. Hits cross lines, as the glyphs do."""
    compiled = _compiled(pattern, case_insensitive, regex)

    @F.arrow_udf(f"array<struct<{_HIT}>>")
    def hits(pages_):
        out = []
        for own in pages_:
            glyphs = own.values
            columns = [] if glyphs is None else [glyphs.field(n).to_pylist() for n in ("unicode", "x", "y", "font_size", "font_name", "width")]
            found = content.find(list(zip(*columns)), compiled, max_results) if pattern else []
            out.append([dict(zip(_HIT_NAMES, h)) for h in found])
        return pa.array(out, pa.list_(pa.struct([(n, t) for n, t in zip(_HIT_NAMES, (pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 4))])))

    p = parsed.select(key, F.explode("pages").alias("p")).select(key, "p.page_index", F.col("p.chars").alias("c"))
    return p.select(key, "page_index", F.explode(hits("c")).alias("h")).select(key, "page_index", "h.*")


def search_files(files: DataFrame, pattern: str, key: str = "doc_id", data: str = "content", password: str = "", case_insensitive: bool = False, regex: bool = False, max_results: int = 0) -> DataFrame:
    """The hits of search() straight from files: each is read and searched in one pass, and no glyph leaves its task.

    A file that cannot be read has no hits.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    compiled = _compiled(pattern, case_insensitive, regex)
    rest = StructType.fromDDL("page_index int, " + _HIT.replace(":", " "))
    schema = StructType([files.select(key).schema[0], *rest.fields])

    def run(batches):
        arrow = to_arrow_schema(rest)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                own = batch.slice(at, 16)
                place, rows = [], []
                for k, d in enumerate(own.column(1).to_pylist()):
                    parsed = parse_bytes(d, password, frozenset(["chars"])) if pattern else {}
                    for p in parsed.get("pages") or ():
                        found = content.find(p["chars"], compiled, max_results)
                        place += [k] * len(found)
                        rows += [(p["page_index"], *h) for h in found]
                columns = list(zip(*rows)) or [()] * len(arrow)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(pa.array(place, pa.int64())), *(pa.array(c, f.type) for c, f in zip(columns, arrow))], names=[key, *arrow.names]
                )

    return files.select(key, F.col(data).cast("binary")).mapInArrow(run, schema)


def formatted(parsed: DataFrame, kind: str = "text", key: str = "doc_id") -> DataFrame:
    """key and the whole document as text, html, json or markdown."""
    from quire.pdf.output import format_pages

    @F.pandas_udf("string")
    def run(pages_):
        return pages_.map(lambda p: None if p is None else format_pages(list(p), kind))

    return parsed.select(key, run("pages").alias(kind))
