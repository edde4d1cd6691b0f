"""The command line: python -m quire COMMAND ... on single files."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from quire.formats import readers
from quire.functions.text import EXTENSIONS
from quire.pdf import output, render, writer
from quire.pdf.document import open_document
from quire.pdf.syntax import PdfError
from quire.sources.pdf import parse_bytes


def page_range(spec: str, total: int) -> list[int]:
    """Page indices (from 0) of a range such as "1-5,8,10-"."""
    out: list[int] = []
    for part in map(str.strip, spec.split(",")):
        first, dash, last = part.partition("-")
        if dash:
            out += range(int(first or 1) - 1, min(int(last or total), total))
        elif not 1 <= int(part) <= total:
            raise PdfError(f"page {part} is not in 1-{total}")
        else:
            out.append(int(part) - 1)
    return out


def _kind(path: str) -> str:
    return EXTENSIONS.get(Path(path).suffix.lower().lstrip("."), "Unknown")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quire", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [commands.add_parser(name)] and [commands.choices[name].add_argument(*a[0], **a[1]) for a in args]
    a = lambda *names, **options: (names, options)
    password = a("--password", default="")
    add("info", a("file"), password)
    add("text", a("file"), a("--format", default="text", choices=["text", "html", "json", "markdown"]), a("--pages"), password)
    add("render", a("file"), a("out"), a("--page", type=int, default=1), a("--dpi", type=float, default=72), password)
    add("merge", a("out"), a("files", nargs="+"))
    add("split", a("file"), a("out"), a("--pages", required=True), password)
    add("encrypt", a("file"), a("out"), a("--user", default=""), a("--owner", required=True), a("--method", default="AES-256"), a("--no-print", action="store_true"), a("--no-copy", action="store_true"))
    add("decrypt", a("file"), a("out"), password)
    add("clean", a("file"), a("out"))
    add("linearize", a("file"), a("out"))
    add("compress", a("file"), a("out"), a("--preset", default="medium", choices=sorted(writer.PRESETS)))
    add("convert", a("file"), a("out"), a("--dpi", type=float, default=72))
    o = parser.parse_args(argv)
    read = lambda path: Path(path).read_bytes()
    try:
        if o.command == "info":
            row = parse_bytes(read(o.file), o.password, frozenset(["images", "fonts"]))
            print(json.dumps({k: dict(v) if k == "metadata" else v for k, v in row.items() if v not in (None, [], {})}, indent=2, ensure_ascii=False))
            return int(row["status"] == "error")
        if o.command == "text":
            if _kind(o.file) not in ("Pdf", "Unknown"):
                print("\n\n".join(readers.read(read(o.file), _kind(o.file)).texts))
                return 0
            row = parse_bytes(read(o.file), o.password, frozenset(["pages"]))
            if row.get("pages") is None:
                raise PdfError(row.get("error") or row["status"])
            chosen = page_range(o.pages, len(row["pages"])) if o.pages else range(len(row["pages"]))
            print(output.format_pages([row["pages"][k] for k in chosen], o.format))
        elif o.command in ("render", "convert"):
            kind = _kind(o.file)
            data = read(o.file) if kind in ("Pdf", "Unknown") else readers.to_pdf(readers.read(read(o.file), kind))
            target = Path(o.out).suffix.lower()
            if target == ".pdf":
                Path(o.out).write_bytes(data)
            elif target in (".txt", ".text"):
                Path(o.out).write_text("\n\n".join(readers.read(data, "Pdf").texts))
            else:
                doc = open_document(data, getattr(o, "password", ""))
                page = doc.pages()[getattr(o, "page", 1) - 1]
                if target == ".svg":
                    Path(o.out).write_text(render.to_svg(doc, page, o.dpi))
                elif target == ".png":
                    Path(o.out).write_bytes(render.png(render.to_pixels(doc, page, o.dpi)))
                else:
                    raise PdfError(f"cannot write {target}")
        else:
            if o.command == "merge":
                done = writer.merge([open_document(read(f)) for f in o.files])
            elif o.command == "split":
                doc = open_document(read(o.file), o.password)
                done = writer.extract_pages(doc, page_range(o.pages, len(doc.pages())))
            elif o.command == "encrypt":
                allowed = -1 & ~(writer.PERMISSIONS["print"] | writer.PERMISSIONS["print_high"] if o.no_print else 0) & ~(writer.PERMISSIONS["copy"] if o.no_copy else 0)
                done = writer.Editor(open_document(read(o.file))).build(encrypt={"method": o.method, "user": o.user, "owner": o.owner, "permissions": allowed})
            elif o.command == "decrypt":
                done = writer.Editor(open_document(read(o.file), o.password)).build()
            elif o.command == "clean":
                e = writer.Editor(open_document(read(o.file)))
                print(json.dumps(e.clean()))
                done = e.build()
            elif o.command == "linearize":
                from quire.pdf.linearize import linearize

                done = linearize(open_document(read(o.file)))
            else:
                done, stats = writer.compress(read(o.file), o.preset)
                print(json.dumps(stats))
            Path(o.out).write_bytes(done)
    except (ValueError, OSError, IndexError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
