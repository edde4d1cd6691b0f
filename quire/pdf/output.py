"""Pages as plain text, HTML, JSON or Markdown. A page is a mapping with page_index, blocks and chars, as the parser gives it."""

from __future__ import annotations

import json

from quire.operators.pages import HTML_HEAD


def escape_html(text: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = text.replace(a, b)
    return text


def html_page(page) -> str:
    ps = ("  <p>" + "<br/>\n    ".join(escape_html(line["text"]) for line in b["lines"]) + "</p>\n" for b in page["blocks"])
    return '<div class="page">\n' + "".join(ps) + "</div>"


def _number(x: float) -> str:
    return f"{x:.2f}"


def _nested(items: list[str], indent: str) -> str:
    return "[\n" + ",\n".join(items) + "\n" + indent + "]" if items else "[]"


def _object(pairs: list[tuple[str, str]], indent: str) -> str:
    inner = ",\n".join(f'{indent}  "{k}": {v}' for k, v in pairs)
    return f"{indent}{{\n{inner}\n{indent}}}"


def json_page(page) -> str:
    """Fixed indentation, two decimals, and the number of glyphs."""
    text = lambda t: json.dumps(t, ensure_ascii=False)

    def word(w):
        return _object([("text", text(w["text"])), *((k, _number(w[k])) for k in ("x", "y", "width", "font_size"))], " " * 12)

    def line(x):
        words = "[\n" + "".join(w + ("," if k + 1 < len(x["words"]) else "") + "\n" for k, w in enumerate(map(word, x["words"]))) + " " * 10 + "]"
        return _object([("text", text(x["text"])), ("x", _number(x["x"])), ("y", _number(x["y"])), ("words", words)], " " * 8)

    blocks = [_object([("text", text(b["text"])), ("lines", _nested([line(x) for x in b["lines"]], " " * 6))], " " * 4) for b in page["blocks"]]
    return _object([("page_index", str(page["page_index"])), ("blocks", _nested(blocks, "  ")), ("char_count", str(len(page["chars"])))], "")


def markdown_page(page) -> str:
    return "\n\n".join(b["text"] for b in page["blocks"])


def format_pages(pages, kind: str) -> str:
    """kind: text, html, json or markdown."""
    if kind == "text":
        return "\n\n".join(markdown_page(p) for p in pages)
    if kind == "html":
        return HTML_HEAD + "".join(f"<h2>Page {k + 1}</h2>\n{html_page(p)}\n" for k, p in enumerate(pages)) + "</body>\n</html>"
    if kind == "json":
        own = ["    " + json_page(p).replace("\n", "\n    ") for p in pages]
        return '{\n  "pages": [\n' + "".join(p + ("," if k + 1 < len(own) else "") + "\n" for k, p in enumerate(own)) + "  ]\n}"
    if kind == "markdown":
        return "\n\n---\n\n".join(f"## Page {k + 1}\n\n{markdown_page(p)}" for k, p in enumerate(pages))
    raise ValueError(f"no format {kind}")
