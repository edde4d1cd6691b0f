"""Changing what a document holds besides its pages' order: outlines, labels, layers, annotations, files, redactions."""

from __future__ import annotations

import hashlib

from quire.pdf import content, filters, structure
from quire.pdf.document import Document
from quire.pdf.syntax import Name, PdfError, Ref, Stream, text_string, write_object
from quire.pdf.writer import Editor


def _catalog(e: Editor) -> dict:
    e.objects[e.root.num] = dict(e.objects[e.root.num])
    return e.objects[e.root.num]


def _direct(e: Editor, x):
    return e.objects.get(x.num) if isinstance(x, Ref) else x


def set_outlines(e: Editor, items: list[dict]) -> None:
    """A new outline from rows (title, page, depth), in reading order."""
    root, stack = e.add({}), []
    nodes: list[dict] = []
    for item in items:
        if not 0 <= item["page"] < len(e.kids):
            raise PdfError(f"no page {item['page']}")
        depth = min(item.get("depth", 0), len(stack))
        del stack[depth:]
        node = {"ref": e.add({}), "item": item, "parent": stack[-1] if stack else None, "kids": []}
        if stack:
            stack[-1]["kids"].append(node)
        nodes.append(node)
        stack.append(node)
    top = [n for n in nodes if n["parent"] is None]

    def fill(group, parent):
        for k, n in enumerate(group):
            d = {"Title": text_string(n["item"]["title"]), "Parent": parent, "Dest": [e.kids[n["item"]["page"]], Name("Fit")]}
            if k:
                d["Prev"] = group[k - 1]["ref"]
            if k + 1 < len(group):
                d["Next"] = group[k + 1]["ref"]
            if n["kids"]:
                d |= {"First": n["kids"][0]["ref"], "Last": n["kids"][-1]["ref"], "Count": len(n["kids"])}
                fill(n["kids"], n["ref"])
            e.objects[n["ref"].num] = d

    fill(top, root)
    e.objects[root.num] = {"Type": Name("Outlines"), "Count": len(nodes)} | ({"First": top[0]["ref"], "Last": top[-1]["ref"]} if top else {})
    _catalog(e)["Outlines"] = root


def remove_outlines(e: Editor) -> None:
    _catalog(e).pop("Outlines", None)


def set_page_labels(e: Editor, ranges: list[dict]) -> None:
    codes = {v: k for k, v in structure.LABEL_STYLES.items()}
    nums: list = []
    for r in sorted(ranges, key=lambda r: r["start_page"]):
        d: dict = {"S": Name(codes[r["style"]])} if r.get("style") in codes else {}
        if r.get("prefix"):
            d["P"] = text_string(r["prefix"])
        if r.get("logical_start", 1) != 1:
            d["St"] = r["logical_start"]
        nums += [r["start_page"], d]
    _catalog(e)["PageLabels"] = {"Nums": nums}


def _layer_config(e: Editor) -> tuple[dict, dict]:
    catalog = _catalog(e)
    props = dict(_direct(e, catalog.get("OCProperties")) or {"OCGs": [], "D": {}})
    props["OCGs"], props["D"] = list(_direct(e, props.get("OCGs")) or []), dict(_direct(e, props.get("D")) or {})
    catalog["OCProperties"] = props
    return props, props["D"]


def add_layer(e: Editor, name: str, visible: bool = True) -> Ref:
    props, config = _layer_config(e)
    ref = e.add({"Type": Name("OCG"), "Name": text_string(name)})
    props["OCGs"].append(ref)
    set_layer_visible(e, ref, visible)
    return ref


def set_layer_visible(e: Editor, ref: Ref, visible: bool) -> None:
    _, config = _layer_config(e)
    for key, wanted in (("ON", visible), ("OFF", not visible)):
        rest = [r for r in _direct(e, config.get(key)) or [] if r != ref]
        config[key] = rest + [ref] if wanted else rest


def remove_layer(e: Editor, ref: Ref) -> None:
    props, config = _layer_config(e)
    props["OCGs"] = [r for r in props["OCGs"] if r != ref]
    for key in ("ON", "OFF", "Locked"):
        if key in config:
            config[key] = [r for r in _direct(e, config[key]) or [] if r != ref]


def annotation(kind: str, rect: list[float], contents: str | None = None, **entries) -> dict:
    """An annotation's dictionary. Link takes uri; Highlight, Underline, StrikeOut and Squiggly get their quadrilateral from the rectangle."""
    x0, y0, x1, y1 = rect
    d: dict = {"Type": Name("Annot"), "Subtype": Name(kind), "Rect": list(rect), "F": entries.pop("flags", 4)}
    if contents is not None:
        d["Contents"] = text_string(contents)
    if "uri" in entries:
        d["A"] = {"S": Name("URI"), "URI": entries.pop("uri").encode()}
    if "color" in entries:
        d["C"] = list(entries.pop("color"))
    if kind in ("Highlight", "Underline", "StrikeOut", "Squiggly"):
        d["QuadPoints"] = [x0, y1, x1, y1, x0, y0, x1, y0]
    return d | entries


def _annots(e: Editor, page: int) -> list:
    n = e.kids[page].num
    own = list(_direct(e, e.objects[n].get("Annots")) or [])
    e.objects[n] = e.objects[n] | {"Annots": own}
    return own


def add_annotation(e: Editor, page: int, d: dict) -> Ref:
    ref = e.add(d)
    _annots(e, page).append(ref)
    return ref


def delete_annotation(e: Editor, page: int, index: int) -> None:
    own = _annots(e, page)
    if not 0 <= index < len(own):
        raise PdfError(f"no annotation {index}")
    del own[index]


def add_field(e: Editor, page: int, name: str, kind: str, rect: list[float], value: str | None = None, options: list[str] | None = None, flags: int = 0) -> Ref:
    """A new form field with its widget on a page. kind: text, checkbox, combo or list; a checkbox's value is the name of its on state, or None."""
    d = annotation("Widget", rect) | {"T": text_string(name), "FT": Name({"text": "Tx", "checkbox": "Btn"}.get(kind, "Ch"))}
    d["Ff"] = flags | (1 << 17 if kind == "combo" else 0)
    if kind == "checkbox":
        d |= {"V": Name(value or "Off"), "AS": Name(value or "Off"), "AP": {"N": {"Yes": None, "Off": None}}}
    elif value is not None:
        d["V"] = text_string(value)
    if options is not None:
        d["Opt"] = [text_string(o) for o in options]
    ref = add_annotation(e, page, d)
    catalog = _catalog(e)
    form = dict(_direct(e, catalog.get("AcroForm")) or {})
    catalog["AcroForm"] = form | {"Fields": [*(_direct(e, form.get("Fields")) or []), ref]}
    return ref


def add_embedded_file(e: Editor, name: str, data: bytes, mime: str = "application/octet-stream", description: str | None = None) -> Ref:
    body = e.add(Stream({"Type": Name("EmbeddedFile"), "Subtype": Name(mime), "Filter": Name("FlateDecode"), "Params": {"Size": len(data), "CheckSum": hashlib.md5(data).digest()}}, filters.flate_encode(data)))
    spec = {"Type": Name("Filespec"), "F": text_string(name), "UF": text_string(name), "EF": {"F": body}} | ({"Desc": text_string(description)} if description else {})
    ref, catalog = e.add(spec), _catalog(e)
    names = dict(_direct(e, catalog.get("Names")) or {})
    tree = dict(_direct(e, names.get("EmbeddedFiles")) or {})
    flat = list(_direct(e, tree.get("Names")) or []) + [text_string(name), ref]
    pairs = sorted(zip(flat[::2], flat[1::2]), key=lambda p: p[0])
    tree["Names"] = [x for p in pairs for x in p]
    names["EmbeddedFiles"], catalog["Names"] = tree, names
    return ref


def write_operations(ops) -> bytes:
    out = []
    for op, args in ops:
        if op == "BI":
            d = b" ".join(write_object(Name(k)) + b" " + write_object(v) for k, v in args[0].dict.items())
            out.append(b"BI " + d + b" ID " + args[0].raw + b"\nEI")
        else:
            out.append(b" ".join([*map(write_object, args), op.encode("latin-1")]))
    return b"\n".join(out)


def _overlaps(box, rects) -> bool:
    return any(box[0] < r[2] and r[0] < box[2] and box[1] < r[3] and r[1] < box[3] for r in rects)


def redact(doc: Document, e: Editor, page: int, rects: list[list[float]], color: tuple = (0, 0, 0)) -> int:
    """Take out text that starts in, and images that overlap, some rectangles of a page, and cover these; the number of operations taken out.

    Text is taken out by glyph: of a string that runs into a rectangle the glyphs
    outside stay, and room is left for those that go.
    """
    p = doc.pages()[page]
    machine = content.TextMachine(content.fonts_of(doc, doc.resolve(p.get("Resources"))))
    kept, gone = [], 0
    for op, args in content.operations(doc.content(p)):
        if op in ("Do", "BI"):
            points = [content.apply(machine.ctm, *q) for q in ((0, 0), (1, 0), (0, 1), (1, 1))]
            box = [min(q[0] for q in points), min(q[1] for q in points), max(q[0] for q in points), max(q[1] for q in points)]
            if _overlaps(box, rects):
                gone += 1
                continue
        if op in ("Tj", "TJ", "'", '"') and args:
            size, tz = machine.state["size"], machine.state["tz"]
            if op == '"' and len(args) >= 3:
                kept += [("Tw", [args[0]]), ("Tc", [args[1]])]
                machine.step("Tw", [args[0]])
                machine.step("Tc", [args[1]])
            if op in ("'", '"'):
                kept.append(("T*", []))
                machine.step("T*", [])
            pieces = args[0] if op == "TJ" else [args[-1]]
            out, hit = [], False
            for x in pieces:
                if not isinstance(x, bytes):
                    out.append(x)
                    machine.step("TJ", [[x]])
                    continue
                font = machine.fonts.get(machine.state["font"])
                width = 2 if font and font.two_bytes else 1
                for k in range(0, len(x), width):
                    before, n = machine.tm, len(machine.chars)
                    machine.show(x[k : k + width])
                    glyph = machine.chars[n:]
                    if glyph and any(r[0] <= glyph[0][1] <= r[2] and r[1] <= glyph[0][2] <= r[3] for r in rects):
                        hit = True
                        step = content.concat(machine.tm, _inverse(before))[4]
                        out.append(-step * 1000 / (size * tz) if size and tz else 0)
                    elif out and isinstance(out[-1], bytes):
                        out[-1] += x[k : k + width]
                    else:
                        out.append(x[k : k + width])
            gone += hit
            kept.append(("TJ", [out]))
            continue
        machine.step(op, args)
        kept.append((op, args))
    body = b"q\n" + write_operations(kept) + b"\nQ"
    for r in rects:
        body += b"\nq " + b" ".join(write_object(float(c)) for c in color) + b" rg " + b" ".join(write_object(float(v)) for v in (r[0], r[1], r[2] - r[0], r[3] - r[1])) + b" re f Q"
    n = e.kids[page].num
    e.objects[n] = e.objects[n] | {"Contents": e.add(Stream({"Filter": Name("FlateDecode")}, filters.flate_encode(body)))}
    own = _annots(e, page)
    own[:] = [a for a in own if not (isinstance(d := _direct(e, a), dict) and d.get("Subtype") == "Redact")]
    return gone


def _inverse(m):
    a, b, c, d, x, y = m
    det = a * d - b * c
    if not det:
        return content.IDENTITY
    return d / det, -b / det, -c / det, a / det, (c * y - d * x) / det, (b * x - a * y) / det


def flatten_form(doc: Document, e: Editor) -> int:
    """Draw every text field's value on its page and take the fields away; the number of fields."""
    values = {f["ref"]: f["value"] for f in structure.form_fields(doc) if f["value"] and f["type"] in ("text", "combo", "list")}
    count = 0
    for k, p in enumerate(doc.pages()):
        draw = b""
        for ref in doc.resolve(p.get("Annots")) or []:
            if isinstance(ref, Ref) and ref.num in values:
                box = doc.box(doc.resolve(ref), "Rect")
                if box:
                    size = max(4.0, min(12.0, 0.7 * (box[3] - box[1])))
                    draw += b"\nq BT /QuireForm " + write_object(size) + b" Tf " + write_object(box[0] + 2) + b" " + write_object(box[1] + 0.25 * size) + b" Td " + write_object(values[ref.num].encode("cp1252", "replace")) + b" Tj ET Q"
        n = e.kids[k].num
        page = dict(e.objects[n])
        if draw:
            resources = dict(_direct(e, page.get("Resources")) or {})
            fonts = dict(_direct(e, resources.get("Font")) or {})
            fonts["QuireForm"] = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}
            resources["Font"], page["Resources"] = fonts, resources
            page["Contents"] = e.add(Stream({"Filter": Name("FlateDecode")}, filters.flate_encode(b"q\n" + doc.content(p) + b"\nQ" + draw)))
        rest = [a for a in _direct(e, page.get("Annots")) or [] if not (isinstance(d := _direct(e, a), dict) and d.get("Subtype") == "Widget")]
        count += len(_direct(e, page.get("Annots")) or []) - len(rest)
        page["Annots"] = rest
        e.objects[n] = page
    _catalog(e).pop("AcroForm", None)
    return count
