"""Text functions as column expressions: scripts, escapes, numbering, sort keys, formats. No Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code-point ranges of right-to-left scripts and marks.
RTL = r"[\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0700}-\x{074F}\x{0780}-\x{07BF}\x{07C0}-\x{07FF}\x{0800}-\x{083F}\x{0840}-\x{085F}\x{08A0}-\x{08FF}\x{FB1D}-\x{FB4F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}\x{10800}-\x{1083F}\x{10900}-\x{1091F}\x{10920}-\x{1093F}\x{1EE00}-\x{1EEFF}]"
#: Scripts that tell a CJK ordering, in the order in which they decide.
CJK = [
    ("Japan1", r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]"),
    ("Korea1", r"[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}]"),
    ("CNS1", r"[\x{3100}-\x{312F}\x{31A0}-\x{31BF}]"),
    ("GB1", r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"),
]
#: File name extensions of formats.
EXTENSIONS = {
    "pdf": "Pdf", "xps": "Xps", "oxps": "Xps", "epub": "Epub", "svg": "Svg", "svgz": "Svg", "docx": "Docx", "xlsx": "Xlsx", "pptx": "Pptx", "cbz": "Cbz",
    "mobi": "Mobi", "prc": "Mobi", "fb2": "Fb2", "txt": "PlainText", "text": "PlainText", "md": "PlainText", "rst": "PlainText", "log": "PlainText",
}
#: Tags that end a line in loose markup.
LINE_TAG = r"(?i)<(?:[^>]*<)?(?:/?(?:p|div|h1|h2|h3)|br/?)(?:\s[^>]*)?>"


def contains_rtl(text: Column) -> Column:
    return text.rlike(RTL)


def cjk_ordering(text: Column) -> Column:
    out = F.when(text.rlike(CJK[0][1]), CJK[0][0])
    for name, pattern in CJK[1:]:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("Identity")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def json_string(text: Column) -> Column:
    """A JSON string literal."""
    return F.substring_index(F.regexp_replace(F.to_json(F.struct(text.alias("t"))), r'^\{"t":(.*)\}$', "$1"), "\x00", 1)


def strip_markup(html: Column) -> Column:
    """Text of loose markup: tags that end a line become one, other tags go, six entities are decoded, line ends are collapsed."""
    t = F.regexp_replace(html, LINE_TAG, "\n")
    t = F.regexp_replace(t, r"<[^>]*>|<[^>]*$|>", "")
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&#39;", "'")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(t, r"[\r\n]+", "\n"), r"^\s+|\s+$", "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def roman(value: Column, upper: bool = True) -> Column:
    """Roman numerals; empty for what is not positive."""
    digits = {100: ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], 10: ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], 1: ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]}
    v = value.cast("int")
    parts = [F.repeat(F.lit("M"), F.floor(v / 1000).cast("int"))]
    parts += [F.element_at(F.array(*map(F.lit, d)), (F.floor(v / n) % 10 + 1).cast("int")) for n, d in digits.items()]
    out = F.when(v > 0, F.concat(*parts)).otherwise("")
    return out if upper else F.lower(out)


def alpha(value: Column, upper: bool = True) -> Column:
    """A to Z, AA, AB and so on (up to six letters); empty for what is not positive."""
    letters, v = [], value.cast("long")
    for _ in range(6):
        letters.insert(0, F.when(v > 0, F.char((65 + (v - 1) % 26).cast("int"))).otherwise(""))
        v = F.floor((v - 1) / 26).cast("long")
    out = F.concat(*letters)
    return out if upper else F.lower(out)


def label_number(style: Column, value: Column) -> Column:
    return (
        F.when(style == "decimal", value.cast("string")).when(style == "upper_roman", roman(value)).when(style == "lower_roman", roman(value, False))
        .when(style == "upper_alpha", alpha(value)).when(style == "lower_alpha", alpha(value, False)).otherwise("")
    )


def natural_key(text: Column) -> Column:
    """A key under which page2 sorts before page10: numbers padded to 20 digits, ASCII letters lower-cased."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    padded = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, F.greatest(F.lit(20), F.length(p)), F.lit("0"))).otherwise(F.translate(p, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return F.array_join(padded, "")


def format_of_path(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair]), ext), F.lit("Unknown"))


def format_of_bytes(content: Column) -> Column:
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return (
        F.when(F.octet_length(content) < 4, "Unknown").when(head.startswith("%PDF"), "Pdf")
        .when((head.startswith("<?xml") | head.startswith("<svg")) & head.contains("<svg"), "Svg").otherwise("Unknown")
    )


def page_range(spec: Column, total: Column) -> Column:
    """The page indices (from 0) of a range such as "1-5,8,10-", in its order; null if a single page is out of range."""
    parts = F.transform(F.split(spec, ","), lambda p: F.trim(p))
    first = lambda p: F.coalesce(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.lit(1))
    last = lambda p: F.when(p.contains("-"), F.coalesce(F.regexp_extract(p, r"-(\d+)$", 1).try_cast("int"), total)).otherwise(first(p))
    bad = F.exists(parts, lambda p: ~p.contains("-") & ((first(p) < 1) | (first(p) > total)) | ~p.rlike(r"^\d*-?\d*$") | (p == ""))
    pages = F.transform(parts, lambda p: F.when(first(p) <= F.least(last(p), total), F.sequence(F.greatest(first(p), F.lit(1)) - 1, F.least(last(p), total) - 1)).otherwise(F.array().cast("array<int>")))
    return F.when(~bad, F.flatten(pages))
