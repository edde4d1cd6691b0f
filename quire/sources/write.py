"""Writing, changing and merging documents on the executors, one document in a task at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.pdf import writer
from quire.pdf.document import open_document


MERGED_BYTES = 1 << 30


def _each(f, kind):
    """A column function that maps values one by one; what fails becomes null."""

    def one(x):
        if x is None:
            return None
        try:
            return f(x)
        except Exception:  # noqa: BLE001  (whatever a damaged file makes a reader raise)
            return None

    @F.pandas_udf(kind)
    def run(values):
        return values.map(one)

    return run


def text_to_pdf(text: Column, title: Column | None = None, **options) -> Column:
    """A plain text as a document: wrapped at 78, 54 lines a page."""
    from quire.operators.pages import PAGE_LINES, wrap

    @F.pandas_udf("binary")
    def run(texts, titles):
        import pandas as pd

        out = []
        for t, name in zip(texts, titles):
            lines = wrap(t or "")
            pages = [lines[k : k + PAGE_LINES] for k in range(0, len(lines), PAGE_LINES)] or [[]]
            out.append(writer.lines_to_pdf(pages, name, **options))
        return pd.Series(out)

    return run(text, F.lit(None).cast("string") if title is None else title.cast("string"))


def compress(data: Column, preset: str = "medium") -> Column:
    return _each(lambda d: writer.compress(bytes(d), preset)[0], "binary")(data)


def _edited(change, **options):
    def run(d):
        e = writer.Editor(open_document(bytes(d)))
        change(e)
        return e.build(**options)

    return run


def clean(data: Column) -> Column:
    return _each(_edited(lambda e: e.clean()), "binary")(data)


def linearize(data: Column) -> Column:
    """Laid out for fast web view."""
    from quire.pdf.linearize import linearize as run

    return _each(lambda d: run(open_document(bytes(d))), "binary")(data)


def reorder(data: Column, order: list[int]) -> Column:
    return _each(lambda d: writer.extract_pages(open_document(bytes(d)), order), "binary")(data)


def delete_page(data: Column, index: int) -> Column:
    return _each(_edited(lambda e: e.delete_page(index)), "binary")(data)


def set_info(data: Column, key: str, value: str) -> Column:
    return _each(_edited(lambda e: e.set_info(key, value)), "binary")(data)


def encrypt(data: Column, user: str = "", owner: str = "", method: str = "AES-128", permissions: int = -1) -> Column:
    return _each(_edited(lambda e: None, encrypt={"method": method, "user": user, "owner": owner, "permissions": permissions}), "binary")(data)


def decrypt(data: Column, password: str) -> Column:
    return _each(lambda d: writer.Editor(open_document(bytes(d), password)).build(), "binary")(data)


def merge(files: DataFrame, target: Column, order: str, data: str = "content") -> DataFrame:
    """One document from all of the same target, in order: target, content.

    A merged document is one value of at most 2 GB, so its parts meet in one
    task; targets are as large as one wants a document to be. Parts of over
    MERGED_BYTES together, and such as cannot be read, give a null.
    """

    def run(pdf):
        import pandas as pd

        try:
            parts = [bytes(d) for d in pdf.sort_values("ord")["content"]]
            done = writer.merge([open_document(d) for d in parts]) if sum(map(len, parts)) <= MERGED_BYTES else None
        except Exception:  # noqa: BLE001  (whatever a damaged file makes a reader raise)
            done = None
        return pd.DataFrame({"target": [pdf["target"].iloc[0]], "content": pd.Series([done], dtype=object)})

    rows = files.select(target.cast("string").alias("target"), F.col(order).alias("ord"), F.col(data).alias("content"))
    return rows.groupBy("target").applyInPandas(run, "target string, content binary")
