"""What a document holds besides pages: outlines, labels, annotations, forms, layers, files, signatures."""

from __future__ import annotations

import hashlib
import re

from quire.pdf import filters
from quire.pdf.syntax import Name, PdfError, Ref, Stream, read_text, to_json

LABEL_STYLES = {"D": "decimal", "R": "upper_roman", "r": "lower_roman", "A": "upper_alpha", "a": "lower_alpha"}


def _tree(doc, node, leaf: str, seen=None):
    """(key, value) pairs of a name or number tree, in order."""
    seen = set() if seen is None else seen
    if isinstance(node, Ref):
        if node.num in seen:
            return
        seen.add(node.num)
    d = doc.resolve(node)
    if not isinstance(d, dict):
        return
    flat = doc.get(d, leaf, list) or []
    for k, v in zip(flat[::2], flat[1::2]):
        yield doc.resolve(k), v
    for kid in doc.get(d, "Kids", list) or []:
        yield from _tree(doc, kid, leaf, seen)


# --- numbering ---


def roman(value: int, upper: bool = True) -> str:
    if value <= 0:
        return ""
    out = "M" * (value // 1000)
    for place, (one, five, ten) in ((100, "CDM"), (10, "XLC"), (1, "IVX")):
        digit = value // place % 10
        out += (ten if digit == 9 else five if digit == 4 else "").join([one, ""]) if digit in (4, 9) else five * (digit >= 5) + one * (digit % 5)
    return out if upper else out.lower()


def alpha(value: int, upper: bool = True) -> str:
    """A to Z, then AA, AB and so on."""
    out = ""
    while value > 0:
        value, digit = divmod(value - 1, 26)
        out = chr(65 + digit) + out
    return out if upper else out.lower()


def number_text(style: str, value: int) -> str:
    if style == "decimal":
        return str(value)
    if style.endswith("roman"):
        return roman(value, style.startswith("upper"))
    return alpha(value, style.startswith("upper")) if style.endswith("alpha") else ""


def page_labels(doc) -> list[dict]:
    out = []
    for start, d in _tree(doc, doc.catalog.get("PageLabels"), "Nums"):
        d = doc.resolve(d)
        if isinstance(start, int) and isinstance(d, dict):
            out.append({"start_page": start, "style": LABEL_STYLES.get(str(doc.get(d, "S")), "none"), "prefix": read_text(doc.get(d, "P")) or "", "logical_start": doc.get(d, "St", int) or 1})
    return sorted(out, key=lambda r: r["start_page"])


def label_of(ranges: list[dict], page: int) -> str:
    """By the last range that starts at or before the page."""
    own = [r for r in ranges if r["start_page"] <= page]
    if not own:
        return str(page + 1)
    r = own[-1]
    return r["prefix"] + number_text(r["style"], r["logical_start"] + page - r["start_page"])


# --- destinations, actions, outlines ---


def destination(doc, x, page_of: dict[int, int], names: dict[str, object] | None = None) -> dict | None:
    x = doc.resolve(x)
    if isinstance(x, (bytes, Name)):
        name = read_text(x)
        found = (names or {}).get(name)
        inner = destination(doc, found, page_of) if found is not None else None
        return (inner or {"page": None, "kind": "Named"}) | {"name": name}
    if isinstance(x, dict):
        return destination(doc, x.get("D"), page_of, names)
    if not isinstance(x, list) or not x:
        return None
    target = x[0]
    page = page_of.get(target.num) if isinstance(target, Ref) else target if isinstance(target, int) else None
    kind = str(doc.resolve(x[1])) if len(x) > 1 else "Fit"
    return {"page": page, "kind": kind, "args": [to_json(doc.resolve(v)) for v in x[2:]]}


def named_destinations(doc) -> dict[str, object]:
    """From the name tree and from the older dictionary."""
    out: dict[str, object] = {}
    for k, v in _tree(doc, (doc.get(doc.catalog, "Names", dict) or {}).get("Dests"), "Names"):
        out.setdefault(read_text(k) or "", v)
    for k, v in (doc.get(doc.catalog, "Dests", dict) or {}).items():
        out.setdefault(k, v)
    return out


def action(doc, x, page_of: dict[int, int]) -> dict | None:
    d = doc.resolve(x)
    if not isinstance(d, dict):
        return None
    kind = str(doc.get(d, "S") or "Unknown")
    out: dict = {"action_type": kind}
    if kind == "GoTo":
        out["dest"] = destination(doc, d.get("D"), page_of)
    elif kind in ("GoToR", "Launch"):
        f = doc.get(d, "F")
        out["file"] = read_text(doc.get(f, "F") if isinstance(f, dict) else f)
    elif kind == "URI":
        out["uri"] = read_text(doc.get(d, "URI"))
    elif kind == "Named":
        out["name"] = str(doc.get(d, "N"))
    elif kind == "JavaScript":
        js = doc.get(d, "JS")
        out["script"] = read_text(doc.decoded(js) if isinstance(js, Stream) else js)
    elif kind in ("SubmitForm", "ResetForm"):
        out["fields"] = to_json(doc.get(d, "Fields"))
    return out


def action_chain(doc, x, page_of: dict[int, int], limit: int = 64) -> list[dict]:
    """An action and what follows it, by /Next."""
    out, todo, seen = [], [x], set()
    while todo and len(out) < limit:
        x = todo.pop(0)
        if isinstance(x, Ref):
            if x.num in seen:
                continue
            seen.add(x.num)
        own = action(doc, x, page_of)
        if own is None:
            continue
        out.append(own)
        after = doc.get(x, "Next")
        todo = (after if isinstance(after, list) else [doc.resolve(x).get("Next")] if after is not None else []) + todo
    return out


def page_numbers(doc) -> dict[int, int]:
    return {p["__ref"].num: k for k, p in enumerate(doc.pages()) if isinstance(p["__ref"], Ref)}


def outlines(doc) -> list[dict]:
    """A row for each item, in reading order: node_id, parent_id, ord, depth, title, is_open, page."""
    page_of, names, out, seen = page_numbers(doc), named_destinations(doc), [], set()
    todo = [((doc.get(doc.catalog, "Outlines", dict) or {}).get("First"), -1, 0, 0)]
    while todo:
        ref, parent, order, depth = todo.pop()
        d = doc.resolve(ref)
        if not isinstance(d, dict) or (isinstance(ref, Ref) and ref.num in seen):
            continue
        if isinstance(ref, Ref):
            seen.add(ref.num)
        dest = destination(doc, d.get("Dest"), page_of, names) if d.get("Dest") is not None else None
        act = action(doc, d.get("A"), page_of)
        dest = dest or (act or {}).get("dest")
        node = len(out)
        out.append({
            "node_id": node, "parent_id": parent, "ord": order, "depth": depth, "title": read_text(doc.get(d, "Title")) or "",
            "is_open": (doc.get(d, "Count", int) or 0) > 0, "page": (dest or {}).get("page"), "uri": (act or {}).get("uri"),
        })
        todo.append((d.get("Next"), parent, order + 1, depth))
        todo.append((d.get("First"), node, 0, depth + 1))
    return out


# --- annotations and forms ---


def annotations(doc, page: dict, page_of: dict[int, int] | None = None) -> list[dict]:
    """Those with a subtype and a rectangle."""
    out = []
    for seq, ref in enumerate(doc.resolve(page.get("Annots")) or []):
        d = doc.resolve(ref)
        rect = doc.box(d, "Rect") if isinstance(d, dict) else None
        kind = doc.get(d, "Subtype") if isinstance(d, dict) else None
        if rect is None or kind is None:
            continue
        skip = ("P", "Parent", "AP", "Rect", "Subtype", "Type", "Contents", "F")
        data = {k: to_json(doc.resolve(v)) for k, v in d.items() if k not in skip}
        out.append({
            "annot_seq": seq, "type": str(kind), "rect": rect, "contents": read_text(doc.get(d, "Contents")), "flags": doc.get(d, "F", int) or 0,
            "uri": (action(doc, d.get("A"), page_of or {}) or {}).get("uri"), "data": data, "ref": ref.num if isinstance(ref, Ref) else None,
        })
    return out


def form_fields(doc) -> list[dict]:
    """Leaves of the field tree with dotted names and what they inherit."""
    out, seen = [], set()

    def walk(ref, name, inherited):
        if isinstance(ref, Ref):
            if ref.num in seen:
                return
            seen.add(ref.num)
        d = doc.resolve(ref)
        if not isinstance(d, dict):
            return
        partial = read_text(doc.get(d, "T"))
        full = ".".join(x for x in (name, partial) if x)
        own = inherited | {k: d[k] for k in ("FT", "Ff", "V", "DV", "DA", "MaxLen", "Opt") if k in d}
        kids = [k for k in doc.get(d, "Kids", list) or []]
        if any(doc.get(k, "T") is not None for k in kids) or (kids and "FT" not in own):
            for k in kids:
                walk(k, full, own)
            return
        flags, kind, value = doc.resolve(own.get("Ff")) or 0, doc.resolve(own.get("FT")), doc.resolve(own.get("V"))
        kinds = {"Tx": "text", "Sig": "signature", "Ch": "combo" if flags & 1 << 17 else "list", "Btn": "push" if flags & 1 << 16 else "radio" if flags & 1 << 15 else "checkbox"}
        options = [doc.resolve(o) for o in doc.resolve(own.get("Opt")) or []]
        out.append({
            "name": full, "partial_name": partial, "type": kinds.get(str(kind), "unknown"), "flags": flags, "read_only": bool(flags & 1), "required": bool(flags & 2),
            "value": str(value) if isinstance(value, Name) else read_text(value) if isinstance(value, bytes) else None if value is None else str(to_json(value)),
            "options": [read_text(doc.resolve(o[-1]) if isinstance(o, list) else o) or "" for o in options], "ref": ref.num if isinstance(ref, Ref) else None,
        })

    for ref in doc.get(doc.get(doc.catalog, "AcroForm"), "Fields", list) or []:
        walk(ref, "", {})
    return out


def fill_field(editor, doc, name: str, value: str) -> None:
    """Set a field's value; a read-only field is an error. A checkbox takes the name of its on state."""
    field = next((f for f in form_fields(doc) if f["name"] == name), None)
    if field is None or field["ref"] is None:
        raise PdfError(f"no field {name}")
    if field["read_only"]:
        raise PdfError(f"{name} is read-only")
    d = dict(editor.objects[field["ref"]])
    if field["type"] in ("checkbox", "radio"):
        d |= {"V": Name(value), "AS": Name(value)}
    else:
        d |= {"V": value.encode("latin-1") if value.isascii() else b"\xfe\xff" + value.encode("utf-16-be")}
    editor.objects[field["ref"]] = d


def toggle_checkbox(editor, doc, name: str) -> str:
    field = next((f for f in form_fields(doc) if f["name"] == name and f["type"] == "checkbox"), None)
    if field is None:
        raise PdfError(f"no checkbox {name}")
    states = [k for k in (doc.get(doc.get(doc.resolve(Ref(field["ref"])), "AP"), "N", dict) or {}) if k != "Off"]
    value = "Off" if field["value"] not in (None, "Off", "") else (states or ["Yes"])[0]
    fill_field(editor, doc, name, value)
    return value


# --- layers ---


def layers(doc) -> list[dict]:
    props = doc.get(doc.catalog, "OCProperties", dict) or {}
    config = doc.get(props, "D", dict) or {}
    numbers = lambda key: {r.num for r in doc.get(config, key, list) or [] if isinstance(r, Ref)}
    on, off, locked = numbers("ON"), numbers("OFF"), numbers("Locked")
    base = str(doc.get(config, "BaseState") or "ON")
    out = []
    for ref in doc.get(props, "OCGs", list) or []:
        if isinstance(ref, Ref):
            visible = ref.num not in off if base == "ON" else ref.num in on
            out.append({"ref": ref.num, "name": read_text(doc.get(ref, "Name")) or "", "visible": visible, "locked": ref.num in locked})
    return out


def membership_visible(doc, x, visible: dict[int, bool]) -> bool:
    """Whether content of a group or membership dictionary shows: AllOn, AnyOn, AnyOff or AllOff."""
    if isinstance(x, Ref) and x.num in visible:
        return visible[x.num]
    d = doc.resolve(x)
    groups = d.get("OCGs") if isinstance(d, dict) else None
    groups = [groups] if isinstance(groups, Ref) and not isinstance(doc.resolve(groups), list) else doc.resolve(groups) or []
    states = [visible[r.num] for r in groups if isinstance(r, Ref) and r.num in visible]
    if not states:
        return True
    return {"AllOn": all(states), "AnyOff": not all(states), "AllOff": not any(states)}.get(str(doc.get(d, "P")), any(states))


# --- files and signatures ---


def embedded_files(doc, with_data: bool = False) -> list[dict]:
    out = []
    for key, ref in _tree(doc, (doc.get(doc.catalog, "Names", dict) or {}).get("EmbeddedFiles"), "Names"):
        spec = doc.resolve(ref)
        if not isinstance(spec, dict):
            continue
        ef = doc.get(spec, "EF", dict) or {}
        s = doc.resolve(ef.get("UF") or ef.get("F"))
        data = filters.decode_tolerant(s.raw, s.dict, doc.resolve)[0] if isinstance(s, Stream) else None
        params = doc.get(s, "Params", dict) if isinstance(s, Stream) else None
        check = doc.get(params, "CheckSum") if params else None
        out.append({
            "key": read_text(key), "filename": read_text(doc.get(spec, "UF")) or read_text(doc.get(spec, "F")) or "", "description": read_text(doc.get(spec, "Desc")),
            "mime": str(doc.get(s, "Subtype")) if isinstance(s, Stream) and doc.get(s, "Subtype") else None, "size": len(data) if data is not None else None,
            "checksum_ok": hashlib.md5(data).digest() == check if isinstance(check, bytes) and data is not None else None, **({"data": data} if with_data else {}),
        })
    return out


#: Guideline names in e-invoices, looked for in this order.
INVOICE_PROFILES = (("extended", "EXTENDED"), ("xrechnung", "XRECHNUNG"), ("en16931", "EN16931"), ("comfort", "COMFORT"), ("basicwl", "BASIC WL"), ("basic", "BASIC"), ("minimum", "MINIMUM"))
_INVOICE_NAMES = ("factur-x.xml", "zugferd-invoice.xml", "xrechnung.xml", "order-x.xml")


def invoice(doc) -> dict | None:
    """The attached e-invoice: its file, profile and head fields."""
    for f in embedded_files(doc, with_data=True):
        xml = (f["data"] or b"").decode("utf-8", "replace")
        if f["filename"].lower() in _INVOICE_NAMES or "CrossIndustryInvoice" in xml or "CrossIndustryDocument" in xml:
            low = xml.lower()
            field = lambda tag: (re.search(rf"<(?:\w+:)?{tag}[^>]*>\s*([^<]*?)\s*</", xml) or [None, None])[1]
            head = re.search(r"<(?:\w+:)?ExchangedDocument\b.*?</(?:\w+:)?ExchangedDocument>", xml, re.S)
            number = re.search(r"<(?:\w+:)?ID[^>]*>\s*([^<]*?)\s*</", head[0]) if head else None
            return {
                "filename": f["filename"], "profile": next((p for word, p in INVOICE_PROFILES if word in low), "UNKNOWN"), "invoice_number": number[1] if number else None,
                "issue_date": field("DateTimeString"), "currency": field("InvoiceCurrencyCode"), "grand_total": field("GrandTotalAmount"), "seller": field("Name"), "xml": xml,
            }
    return None


def signatures(doc) -> list[dict]:
    """Signature fields with the digest over their byte ranges, and whether the file goes on after them."""
    out = []
    for ref in doc.refs():
        try:
            d = doc.resolve(ref)
        except PdfError:
            continue
        if not isinstance(d, dict) or "ByteRange" not in d or "Contents" not in d:
            continue
        r = [doc.resolve(v) for v in doc.resolve(d["ByteRange"])]
        if len(r) % 2 or not all(isinstance(v, int) and v >= 0 for v in r):
            continue
        covered = b"".join(doc.data[a : a + n] for a, n in zip(r[::2], r[1::2]))
        end = r[-2] + r[-1] if r else 0
        out.append({
            "ref": ref.num, "filter": str(doc.get(d, "Filter")), "sub_filter": str(doc.get(d, "SubFilter")), "name": read_text(doc.get(d, "Name")), "reason": read_text(doc.get(d, "Reason")),
            "location": read_text(doc.get(d, "Location")), "signing_time": read_text(doc.get(d, "M")), "byte_range": r, "digest": hashlib.sha256(covered).hexdigest(),
            "in_bounds": end <= len(doc.data), "modified_after": end < len(doc.data.rstrip(b"\r\n ")),
        })
    return out


# --- images ---

_SPACE_COMPONENTS = {"DeviceGray": 1, "G": 1, "CalGray": 1, "DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "Lab": 3, "DeviceCMYK": 4, "CMYK": 4, "Indexed": 1, "I": 1, "Separation": 1, "Pattern": 0}


def components(doc, space) -> int:
    space = doc.resolve(space)
    if isinstance(space, Name):
        return _SPACE_COMPONENTS.get(str(space), 3)
    if isinstance(space, list) and space:
        kind = str(doc.resolve(space[0]))
        if kind == "ICCBased":
            return doc.get(space[1], "N", int) or 3
        if kind == "DeviceN":
            return len(doc.resolve(space[1]) or [])
        return _SPACE_COMPONENTS.get(kind, 3)
    return 3


def images(doc) -> list[dict]:
    out = []
    for ref in doc.refs():
        try:
            s = doc.resolve(ref)
        except PdfError:
            continue
        if isinstance(s, Stream) and s.dict.get("Subtype") == "Image":
            names = [n for n, _ in filters.chain(s.dict, doc.resolve)]
            space = doc.resolve(s.dict.get("ColorSpace"))
            out.append({
                "obj_num": ref.num, "width": doc.get(s, "Width", int) or 0, "height": doc.get(s, "Height", int) or 0, "bpc": doc.get(s, "BitsPerComponent", int) or (1 if doc.get(s, "ImageMask", bool) else 8),
                "color_space": str(space if isinstance(space, Name) else doc.resolve(space[0]) if isinstance(space, list) and space else "None"), "n_components": components(doc, space) if space is not None else 1,
                "filter": names[-1] if names else "None", "is_mask": bool(doc.get(s, "ImageMask", bool)), "has_smask": "SMask" in s.dict, "bytes": len(s.raw),
            })
    return out


# --- colours for printing ---


def output_intents(doc) -> list[dict]:
    out = []
    for x in doc.get(doc.catalog, "OutputIntents", list) or []:
        profile = doc.get(x, "DestOutputProfile")
        out.append({
            "subtype": str(doc.get(x, "S")), "condition": read_text(doc.get(x, "OutputConditionIdentifier")), "info": read_text(doc.get(x, "Info")),
            "registry": read_text(doc.get(x, "RegistryName")), "components": doc.get(profile, "N", int) if isinstance(profile, Stream) else None,
        })
    return out


def overprint(doc, state) -> dict:
    """What a graphics state says of overprinting."""
    fill = doc.get(state, "op", bool)
    stroke = bool(doc.get(state, "OP", bool))
    return {"stroke": stroke, "fill": stroke if fill is None else fill, "mode": doc.get(state, "OPM", int) or 0}


def icc_profile(data: bytes) -> dict | None:
    """The head of an ICC profile: version, class, colour space and description."""
    if len(data) < 132 or data[36:40] != b"acsp":
        return None
    tags = {}
    for k in range(min(int.from_bytes(data[128:132]), 100)):
        entry = data[132 + 12 * k : 144 + 12 * k]
        if len(entry) == 12:
            tags[entry[:4].decode("latin-1")] = int.from_bytes(entry[4:8]), int.from_bytes(entry[8:12])
    name = None
    if "desc" in tags:
        raw = data[tags["desc"][0] : sum(tags["desc"])]
        if raw[:4] == b"desc":
            name = raw[12 : 12 + int.from_bytes(raw[8:12])].rstrip(b"\0").decode("latin-1")
        elif raw[:4] == b"mluc" and len(raw) >= 28:
            size, at = int.from_bytes(raw[20:24]), int.from_bytes(raw[24:28])
            name = raw[at : at + size].decode("utf-16-be", "replace")
    spaces = {"GRAY": 1, "RGB ": 3, "CMYK": 4, "Lab ": 3}
    space = data[16:20].decode("latin-1")
    return {"version": f"{data[8]}.{data[9] >> 4}", "class": data[12:16].decode("latin-1"), "space": space.strip(), "components": spaces.get(space), "description": name, "tags": sorted(tags)}
