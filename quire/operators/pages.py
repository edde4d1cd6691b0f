"""Pages as rows: pagination, numbering, merging, splitting, labels and output formats.

A paged table has a document key, page_index (from 0) and text. Documents are
independent, so everything is partitioned by document and nothing is gathered
across documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import html_escape, label_number

LINE_CHARS, PAGE_LINES = 78, 54


def wrap(text: str, width: int = LINE_CHARS) -> list[str]:
    """Lines of at most width code points, broken at the last space before it if there is one."""
    out = []
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    for line in lines:
        rest = line[:-1] if line.endswith("\r") else line
        if not rest:
            out.append("")
        at, n = 0, len(rest)
        while at < n:
            if n - at <= width:
                out.append(rest[at:])
                break
            cut = rest.rfind(" ", at, at + width)
            cut = at + width if cut < 0 else cut
            out.append(rest[at:cut])
            at = cut
            while at < n and rest[at].isspace():
                at += 1
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def wrapped_lines(texts):
    return texts.map(lambda t: wrap(t or ""))


def paginate(docs: DataFrame, text: str = "text", page_lines: int = PAGE_LINES) -> DataFrame:
    """A row for each page: the document's other columns, page_index and lines. A document has one page at least."""
    n = F.size("lines")
    pages = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(n / page_lines).cast("int"), F.lit(1)) - 1),
        lambda k: F.slice(F.col("lines"), k * page_lines + 1, page_lines),
    )
    others = [c for c in docs.columns if c != text]
    return docs.withColumn("lines", wrapped_lines(F.col(text))).select(*others, F.posexplode(pages).alias("page_index", "lines"))


def page_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    n = F.size(wrapped_lines(F.col(text))).cast("long")
    return docs.select(key, n.alias("n_lines")).select(key, "n_lines", F.greatest(F.ceil(F.col("n_lines") / PAGE_LINES), F.lit(1)).cast("long").alias("n_pages"))


def merge(pages: DataFrame, target: Column, order: list[str]) -> DataFrame:
    """Pages of all documents with the same target as one document: target and page_index from 0, in the given order.

    All but the last column of order name a document. Pages are numbered within
    their own document; only the documents' page counts, one narrow row each,
    are summed up along a target, so no task holds a target's pages.
    """
    named = pages.withColumn("target", target)
    document = order[:-1]
    if not document:
        return named.withColumn("page_index", (F.row_number().over(Window.partitionBy("target").orderBy(*order)) - 1).cast("long"))
    own = Window.partitionBy("target", *document)
    placed = named.withColumn("__place", F.row_number().over(own.orderBy(order[-1])))
    before = Window.partitionBy("target").orderBy(*document).rowsBetween(Window.unboundedPreceding, -1)
    starts = named.groupBy("target", *document).agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("target", *document)]
    joined = placed.alias("a").join(starts.select("target", *document, "__start").alias("b"), same)
    number = (F.col("__start") + F.col("__place") - 1).cast("long").alias("page_index")
    rest = [F.col(f"a.{c}") for c in named.columns if c != "page_index"]
    return joined.select(*rest, number)


def split(pages: DataFrame, key: str, first: int, last: int | None = None) -> DataFrame:
    """Pages first to last (from 1) of every document, numbered anew."""
    own = pages.where((F.col("page_index") >= first - 1) & (F.lit(True) if last is None else F.col("page_index") <= last - 1))
    return own.withColumn("page_index", F.col("page_index") - (first - 1))


def reorder(pages: DataFrame, order: list[int]) -> DataFrame:
    """Pages by index; indices that a document does not have are dropped, repeats are kept."""
    wanted = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("from"), F.lit(k).cast("long").alias("place")) for k, i in enumerate(order))))
    table = pages.sparkSession.range(1).select(wanted.alias("w")).select("w.from", "w.place")
    return pages.join(F.broadcast(table), pages.page_index == table["from"]).drop("from")


def delete(pages: DataFrame, key: str, index: int) -> DataFrame:
    """Without one page; later pages move up."""
    return pages.where(F.col("page_index") != index).withColumn("page_index", F.col("page_index") - (F.col("page_index") > index).cast("long"))


def labels(pages: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Adds label: by the last range of the document that starts at or before the page, else the page's number.

    ranges: key, start_page, style, prefix, logical_start. The ranges of a
    document are few; they meet its pages as one sorted array.
    """
    own = ranges.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_page", "style", "prefix", "logical_start")), asc=False).alias("ranges"))
    hit = F.get(F.filter("ranges", lambda r: r.start_page <= F.col("page_index")), F.lit(0))
    joined = pages.join(own, key, "left").withColumn("r", hit)
    number = label_number(F.col("r.style"), F.col("r.logical_start") + F.col("page_index") - F.col("r.start_page"))
    label = F.when(F.col("r").isNull(), (F.col("page_index") + 1).cast("string")).otherwise(F.concat(F.coalesce(F.col("r.prefix"), F.lit("")), number))
    return joined.withColumn("label", label).drop("r", "ranges")


# --- output formats; blocks are arrays of lines ---


def html_page(blocks: Column) -> Column:
    ps = F.transform(blocks, lambda b: F.concat(F.lit("  <p>"), F.array_join(F.transform(b, html_escape), "<br/>\n    "), F.lit("</p>\n")))
    return F.concat(F.lit('<div class="page">\n'), F.array_join(ps, ""), F.lit("</div>"))


#: Fixed value: how an HTML document begins.
HTML_HEAD = (
    '<!DOCTYPE html>\n<html>\n<head>\n  <meta charset="utf-8">\n  <title>Extracted Text</title>\n  <style>\n'
    "    .page { margin-bottom: 2em; padding-bottom: 1em; border-bottom: 1px solid #ccc; }\n    p { margin: 0.5em 0; }\n  </style>\n</head>\n<body>\n"
)


def _in_order(pages: DataFrame, key: str, piece: Column, joint: str) -> Column:
    rows = F.sort_array(F.collect_list(F.struct("page_index", piece.alias("piece"))))
    return F.array_join(F.transform(rows, lambda r: r.piece), joint)


def html_documents(pages: DataFrame, key: str, blocks: str = "blocks") -> DataFrame:
    piece = F.concat(F.lit("<h2>Page "), (F.col("page_index") + 1).cast("string"), F.lit("</h2>\n"), html_page(F.col(blocks)), F.lit("\n"))
    return pages.groupBy(key).agg(F.concat(F.lit(HTML_HEAD), _in_order(pages, key, piece, ""), F.lit("</body>\n</html>")).alias("html"))


def markdown_documents(pages: DataFrame, key: str, blocks: str = "blocks") -> DataFrame:
    body = F.array_join(F.transform(F.col(blocks), lambda b: F.array_join(b, "\n")), "\n\n")
    piece = F.concat(F.lit("## Page "), (F.col("page_index") + 1).cast("string"), F.lit("\n\n"), body)
    return pages.groupBy(key).agg(_in_order(pages, key, piece, "\n\n---\n\n").alias("markdown"))


def text_documents(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    return pages.groupBy(key).agg(_in_order(pages, key, F.col(text), "\n\n").alias("text"))
