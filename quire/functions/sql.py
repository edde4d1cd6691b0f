"""Functions for SQL: table functions over a document's bytes, for LATERAL joins, and scalar ones.

    register(spark)
    SELECT f.path, w.* FROM files f, LATERAL pdf_words(f.content) w
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

_PAGES = "page_index int, width double, height double, rotate int, label string, text string"
_WORDS = "page_index int, word_seq int, text string, x double, y double, width double, font_size double"
_HITS = "page_index int, char_start int, char_end int, matched_text string"


def _parsed(content, part: str):
    from quire.sources.pdf import parse_bytes

    return parse_bytes(content, parts=frozenset([part])).get("pages") or []


@udtf(returnType=_PAGES)
class PdfPages:
    def eval(self, content: bytes):
        for p in _parsed(content, "text"):
            b = p["media_box"]
            yield p["page_index"], b["urx"] - b["llx"], b["ury"] - b["lly"], p["rotate"], p["label"], p["text"]


@udtf(returnType=_WORDS)
class PdfWords:
    def eval(self, content: bytes):
        for p in _parsed(content, "words"):
            for k, w in enumerate(p["words"]):
                yield p["page_index"], k, w["text"], w["x"], w["y"], w["width"], w["font_size"]


@udtf(returnType=_HITS)
class PdfSearch:
    def eval(self, content: bytes, pattern: str, max_results: int = 0):
        for p in _parsed(content, "raw"):
            text = p["raw"]
            at, n = text.find(pattern) if pattern else -1, 0
            while at >= 0 and (not max_results or n < max_results):
                yield p["page_index"], at, at + len(pattern), pattern
                at, n = text.find(pattern, at + 1), n + 1


def register(spark: SparkSession) -> None:
    """pdf_pages, pdf_words, pdf_search (table functions), decode_stream and detect_format."""
    from quire.pdf import filters
    from quire.pdf.syntax import Name, PdfError

    for name, f in (("pdf_pages", PdfPages), ("pdf_words", PdfWords), ("pdf_search", PdfSearch)):
        spark.udtf.register(name, f)

    @pandas_udf("binary")
    def decode_stream(data, names):
        import pandas as pd

        def one(raw, chain):
            try:
                return filters.decode(bytes(raw), {"Filter": [Name(n.strip()) for n in chain.split(",") if n.strip()]})
            except (PdfError, ValueError, AttributeError):
                return None

        return pd.Series([one(r, c) for r, c in zip(data, names)], dtype=object)

    spark.udf.register("decode_stream", decode_stream)
