"""Pages to pictures on the executors, a page a row."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.pdf import render
from quire.pdf.document import open_document


def render_pages(files: DataFrame, kind: str = "svg", dpi: float = 72.0, key: str = "doc_id", data: str = "content") -> DataFrame:
    """key (as text), page_index, status, svg or png. A page that fails has status 'error'."""

    def run(batches):
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                try:
                    doc = open_document(bytes(raw or b""))
                    for k, page in enumerate(doc.pages()):
                        try:
                            svg = render.to_svg(doc, page, dpi) if kind == "svg" else None
                            rows.append((doc_id, k, "ok", svg, render.png(render.to_pixels(doc, page, dpi)) if kind == "png" else None))
                        except (ValueError, KeyError, TypeError, IndexError, OverflowError):
                            rows.append((doc_id, k, "error", None, None))
                except (ValueError, KeyError, TypeError, IndexError, AttributeError):
                    rows.append((doc_id, None, "error", None, None))
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary()))], names=[key, "page_index", "status", "svg", "png"])

    return files.select(F.col(key).cast("string").alias(key), F.col(data).cast("binary")).mapInArrow(run, f"{key} string, page_index int, status string, svg string, png binary")
