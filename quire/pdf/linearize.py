"""Documents laid out for fast web view (ISO 32000, annex F): the first page's objects come first, then those of each other page, then what pages share."""

from __future__ import annotations

import hashlib
import struct

from quire.pdf.document import Document
from quire.pdf.syntax import Name, PdfError, Ref, Stream, references, write_object
from quire.pdf.writer import Editor, _replaced


def _reached(e: Editor, start: list[int], without: frozenset[int] | set[int] = frozenset()) -> list[int]:
    """Objects reached from some, in the order in which they are met; the page tree above a page is no part of it."""
    out, seen, todo = [], set(without), list(reversed(start))
    while todo:
        n = todo.pop()
        if n in seen or n not in e.objects:
            continue
        seen.add(n)
        out.append(n)
        value = e.objects[n]
        own = {k: v for k, v in value.items() if k != "Parent"} if isinstance(value, dict) else value
        todo += [r.num for r in reversed(list(references(own)))]
    return out


def _parts(e: Editor) -> tuple[list[int], list[list[int]], list[int]]:
    """Objects of the first page, of each other page alone, and the rest."""
    pages = [k.num for k in e.kids]
    tree = {e.top.num, e.root.num}
    others = {p: tree | set(pages) - {p} for p in pages}
    reached = [_reached(e, [p], others[p]) for p in pages]
    count: dict[int, int] = {}
    for own in reached:
        for n in own:
            count[n] = count.get(n, 0) + 1
    first = reached[0]
    taken = set(first)
    own = [[n for n in r if count[n] == 1 and n not in taken] for r in reached[1:]]
    taken.update(n for r in own for n in r)
    top = [e.root.num] + ([e.info.num] if e.info else [])
    rest = [n for n in _reached(e, top) if n not in taken and n != e.root.num]
    return first, own, rest


class _Fields:
    """Numbers of given widths, one after the other."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value, self.n = self.value << bits | value, self.n + bits

    def align(self) -> None:
        self.put(0, -self.n % 8)

    def data(self) -> bytes:
        self.align()
        return self.value.to_bytes(self.n // 8)


def _hints(objects: list[int], lengths: list[int], first_offset: int) -> tuple[bytes, int]:
    """The page offset and shared object hint tables, and where the second begins."""
    out = _Fields()
    object_bits, length_bits = ((max(v) - min(v)).bit_length() for v in (objects, lengths))
    for value, bits in (
        (min(objects), 32), (first_offset, 32), (object_bits, 16), (min(lengths), 32), (length_bits, 16), (0, 32), (0, 16), (min(lengths), 32), (length_bits, 16), (0, 16), (0, 16), (0, 16), (1, 16),
    ):
        out.put(value, bits)
    for values, bits in ((objects, object_bits), (lengths, length_bits), (lengths, length_bits)):
        for v in values:
            out.put(v - min(values), bits)
        out.align()
    start = out.n // 8
    return out.data() + struct.pack(">IIIIHIH", 0, 0, 0, 0, 0, 0, 0), start


def linearize(doc: Document) -> bytes:
    """The document's bytes, laid out anew. Encrypted documents and such without a page are errors."""
    if doc.encrypted:
        raise PdfError("encrypted documents are not linearized")
    e = Editor(doc)
    if not e.kids:
        raise PdfError("a document without pages")
    first, own, rest = _parts(e)
    later = [n for part in own for n in part] + rest
    head, catalog, hint = len(later) + 1, len(later) + 2, len(later) + 3
    numbers = {n: k for k, n in enumerate(later, 1)} | {e.root.num: catalog} | {n: hint + k for k, n in enumerate(first, 1)}
    size = hint + len(first) + 1
    body = {numbers[n]: b"%d 0 obj\n" % numbers[n] + write_object(_replaced(e.objects[n], numbers)) + b"\nendobj\n" for n in numbers if n in e.objects}
    identity = hashlib.md5(b"".join(body[k] for k in sorted(body))).digest()
    trailer = {"Root": Ref(catalog), "ID": [identity, identity]} | ({"Info": Ref(numbers[e.info.num])} if e.info and e.info.num in numbers else {})
    total = lambda part: sum(len(body[numbers[n]]) for n in part)
    objects, lengths = [len(p) for p in (first, *own)], [total(p) for p in (first, *own)]

    def hint_object(offset: int) -> bytes:
        data, shared = _hints(objects, lengths, offset)
        # stored as it is: its length must not depend on the offset in it
        return b"%d 0 obj\n" % hint + write_object(Stream({"S": shared}, data)) + b"\nendobj\n"

    start = f"%PDF-{max(e.version, '1.2')}\n".encode() + b"%\xe2\xe3\xcf\xd3\n"
    lead = lambda *v: b"%d 0 obj\n<</Linearized 1/L %010d/H [%010d %010d]/O %d/E %010d/N %d/T %010d>>\nendobj\n" % (
        head, v[0], v[1], v[2], numbers[e.kids[0].num], v[3], len(e.kids), v[4])
    row = lambda at: b"%010d 00000 n \n" % at
    ending = lambda prev: b"trailer\n" + write_object(trailer | {"Size": size, "Prev": Name(f"{prev:010d}")}).replace(b"/Prev /", b"/Prev ") + b"\nstartxref\n0\n%%EOF\n"
    first_table = len(start) + len(lead(0, 0, 0, 0, 0))
    at = first_table + len(b"xref\n%d %d\n" % (head, size - head)) + 20 * (size - head) + len(ending(0))
    offsets = {head: len(start), catalog: at}
    at += len(body[catalog])
    offsets[hint], hint_size = at, len(hint_object(0))
    at += hint_size
    for n in first:
        offsets[numbers[n]] = at
        at += len(body[numbers[n]])
    end_first = at
    for n in later:
        offsets[numbers[n]] = at
        at += len(body[numbers[n]])
    main = at
    table = b"xref\n0 %d\n0000000000 65535 f \n" % head
    entries = main + len(b"xref\n0 %d" % head)
    last = b"trailer\n" + write_object({"Size": head}) + b"\nstartxref\n%d\n%%%%EOF\n" % first_table
    whole = main + len(table) + 20 * (head - 1) + len(last)
    # offsets in the hints are those of the file without the hints
    out = start + lead(whole, offsets[hint], hint_size, end_first, entries) + b"xref\n%d %d\n" % (head, size - head)
    out += b"".join(row(offsets[k]) for k in range(head, size)) + ending(main) + body[catalog] + hint_object(offsets[numbers[first[0]]] - hint_size)
    out += b"".join(body[numbers[n]] for n in (*first, *later)) + table + b"".join(row(offsets[k]) for k in range(1, head)) + last
    return out
