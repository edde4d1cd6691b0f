"""Objects, tokens and their text form.

Python values stand for objects: None, bool, int, float, bytes (strings),
Name, list, dict (keys are plain str), Ref and Stream.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class PdfError(ValueError):
    """A document, object or stream that cannot be read."""


class Name(str):
    __slots__ = ()


class Keyword(str):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int = 0


class Stream:
    __slots__ = ("dict", "raw")

    def __init__(self, dict_: dict, raw: bytes):
        self.dict, self.raw = dict_, raw

    def __eq__(self, other):
        return isinstance(other, Stream) and (self.dict, self.raw) == (other.dict, other.raw)

    def __repr__(self):
        return f"Stream({self.dict!r}, {len(self.raw)} bytes)"


EOF = Keyword("")
_SPACE = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
_REFERENCE = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_STRING_STOP = re.compile(rb"[()\\\r]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c"}
_DEPTH = 200


class Lexer:
    """Tokens of data from a position on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _SPACE.match(self.data, self.at).end()

    def token(self):
        """The next token: a value, Keyword, or one of the delimiter keywords [ ] << >> { }."""
        self.skip()
        data, at = self.data, self.at
        c = data[at : at + 1]
        if not c:
            return EOF
        if c == b"/":
            m = _REGULAR.match(data, at + 1)
            self.at = m.end() if m else at + 1
            raw = m[0] if m else b""
            if b"#" in raw:
                raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), raw)
            return Name(raw.decode("latin-1"))
        if c == b"(":
            return self._literal()
        if c == b"<":
            if data[at + 1 : at + 2] == b"<":
                self.at = at + 2
                return Keyword("<<")
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b">":
            if data[at + 1 : at + 2] == b">":
                self.at = at + 2
                return Keyword(">>")
            self.at = at + 1
            return Keyword(">")
        if c in b"[]{})":
            self.at = at + 1
            return Keyword(c.decode())
        m = _REGULAR.match(data, at)
        self.at = m.end()
        word = m[0]
        if _NUMBER.match(word):
            return float(word) if b"." in word else int(word)
        if c in b"+-.0123456789":
            loose = re.match(rb"[+-]*(\d*\.?\d*)", word)
            if loose and re.search(rb"\d", loose[1]):
                value = float(loose[1]) if b"." in loose[1] else int(loose[1])
                return -value if word.startswith(b"-") else value
        return Keyword(word.decode("latin-1"))

    def _literal(self) -> bytes:
        data, at, depth, out = self.data, self.at + 1, 1, []
        while True:
            m = _STRING_STOP.search(data, at)
            if not m:
                out.append(data[at:])
                self.at = len(data)
                break
            out.append(data[at : m.start()])
            at = m.end()
            if m[0] == b"(":
                depth += 1
                out.append(b"(")
            elif m[0] == b")":
                depth -= 1
                if not depth:
                    self.at = at
                    break
                out.append(b")")
            elif m[0] == b"\r":
                at += data[at : at + 1] == b"\n"
                out.append(b"\n")
            else:
                octal = re.compile(rb"[0-7]{1,3}").match(data, at)
                c = data[at : at + 1]
                if octal:
                    out.append(bytes([int(octal[0], 8) & 255]))
                    at = octal.end()
                elif c == b"\r":
                    at += 1 + (data[at + 1 : at + 2] == b"\n")
                elif c == b"\n":
                    at += 1
                else:
                    out.append(_ESCAPES.get(c, c))
                    at += 1
        return b"".join(out)

    def object(self, depth: int = 0):
        """The next whole object; a bare keyword is returned as Keyword."""
        self.skip()
        m = _REFERENCE.match(self.data, self.at)
        if m:
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        t = self.token()
        if not isinstance(t, Keyword):
            return t
        if depth > _DEPTH:
            raise PdfError("objects are nested too deeply")
        if t == "[":
            out = []
            while True:
                x = self.object(depth + 1)
                if isinstance(x, Keyword):
                    if x in ("]", ""):
                        return out
                    continue
                out.append(x)
        if t == "<<":
            found = {}
            while True:
                key = self.token()
                if isinstance(key, Keyword):
                    if key in (">>", "", "endobj"):
                        return found
                    continue
                if not isinstance(key, Name):
                    continue
                before = self.at
                value = self.object(depth + 1)
                if isinstance(value, Keyword):
                    if value in (">>", ""):
                        return found
                    self.at = before if value in ("endobj", "stream") else self.at
                    continue
                found[str(key)] = value
        return {"true": True, "false": False, "null": None}.get(t, t)


_OBJECT = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj")


def indirect_object(data: bytes, at: int, length_of=None):
    """(number, generation, value) of the object at an offset. length_of resolves a stream's indirect length."""
    m = _OBJECT.match(data, at)
    if not m:
        raise PdfError(f"no object at {at}")
    lex = Lexer(data, m.end())
    value = lex.object()
    if isinstance(value, Keyword):
        value = None
    if isinstance(value, dict):
        lex.skip()
        if data.startswith(b"stream", lex.at):
            start = lex.at + 6
            start += 2 if data[start : start + 2] == b"\r\n" else data[start : start + 1] in (b"\n", b"\r")
            size = value.get("Length")
            if isinstance(size, Ref):
                size = length_of(size) if length_of else None
            end = start + size if isinstance(size, int) and size >= 0 else -1
            if end < 0 or not re.compile(rb"\s*endstream").match(data, end):
                end = data.find(b"endstream", start)
                end = len(data) if end < 0 else end
                if data[end - 2 : end] == b"\r\n":
                    end -= 2
                elif end > start and data[end - 1 : end] in (b"\n", b"\r"):
                    end -= 1
            value = Stream(value, data[start:end])
    return int(m[1]), int(m[2]), value


def write_number(x) -> bytes:
    if isinstance(x, int):
        return b"%d" % x
    text = f"{x:.6f}".rstrip("0").rstrip(".")
    return (text if text not in ("", "-0", "-") else "0").encode()


def write_object(x) -> bytes:
    """The text form of an object; a stream's dictionary gets its length."""
    if x is None:
        return b"null"
    if isinstance(x, bool):
        return b"true" if x else b"false"
    if isinstance(x, (int, float)):
        return write_number(x)
    if isinstance(x, Ref):
        return b"%d %d R" % x
    if isinstance(x, Name):
        return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"()<>[]{}/%#" else b"#%02X" % c for c in x.encode("latin-1"))
    if isinstance(x, bytes):
        if all(32 <= c < 127 for c in x):
            return b"(" + x.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"
        return b"<" + x.hex().encode() + b">"
    if isinstance(x, (list, tuple)):
        return b"[" + b" ".join(map(write_object, x)) + b"]"
    if isinstance(x, dict):
        return b"<<" + b" ".join(write_object(Name(k)) + b" " + write_object(v) for k, v in sorted(x.items())) + b">>"
    if isinstance(x, Stream):
        return write_object(x.dict | {"Length": len(x.raw)}) + b"\nstream\n" + x.raw + b"\nendstream"
    if isinstance(x, str):
        return write_object(text_string(x))
    raise PdfError(f"not an object: {type(x).__name__}")


def text_string(text: str) -> bytes:
    """A metadata string: Latin-1 if it fits, else UTF-16 with its mark."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return b"\xfe\xff" + text.encode("utf-16-be")


def read_text(raw) -> str | None:
    """The text of a metadata string: UTF-16BE or UTF-8 by their marks, else Latin-1."""
    if isinstance(raw, str):
        return str(raw)
    if not isinstance(raw, bytes):
        return None
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "replace")
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("latin-1")


def to_json(x):
    """A plain value for json.dumps: names as /Name, strings as text, references as {"ref": [n, g]}."""
    if isinstance(x, Name):
        return f"/{x}"
    if isinstance(x, Ref):
        return {"ref": [x.num, x.gen]}
    if isinstance(x, bytes):
        return read_text(x)
    if isinstance(x, Stream):
        return {"stream": to_json(x.dict)}
    if isinstance(x, dict):
        return {k: to_json(v) for k, v in sorted(x.items())}
    if isinstance(x, list):
        return [to_json(v) for v in x]
    return x


def references(x):
    """All references in an object."""
    if isinstance(x, Ref):
        yield x
    elif isinstance(x, Stream):
        yield from references(x.dict)
    elif isinstance(x, dict):
        for v in x.values():
            yield from references(v)
    elif isinstance(x, list):
        for v in x:
            yield from references(v)
