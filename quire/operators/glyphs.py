"""Glyphs to words in SQL: gaps and islands within a page. The layout of whole pages is in quire.pdf.layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def words(chars: DataFrame, keys: list[str]) -> DataFrame:
    """Words of glyph rows (char_seq, unicode, x, y, font_size, width): keys, word_seq, text, x, y, width, font_size.

    A glyph starts a word if it stands more than 0.3 of the last one's size
    from its end, more than half of it above or below, or after a space.
    """
    page = Window.partitionBy(*keys).orderBy("char_seq")
    before = F.lag(F.struct("unicode", "x", "y", "width", "font_size")).over(page)
    marked = chars.withColumn("p", before).withColumn(
        "starts",
        (F.col("p").isNull() | (F.abs(F.col("x") - F.col("p.x") - F.col("p.width")) > 0.3 * F.col("p.font_size"))
         | (F.abs(F.col("y") - F.col("p.y")) > 0.5 * F.col("p.font_size")) | (F.col("p.unicode") == " ")).cast("int"),
    )
    island = marked.withColumn("word_seq", F.sum("starts").over(page.rowsBetween(Window.unboundedPreceding, 0))).where("unicode <> ' '")
    own = F.sort_array(F.collect_list(F.struct("char_seq", "unicode", "x", "y", "width", "font_size")))
    out = island.groupBy(*keys, "word_seq").agg(own.alias("g"))
    return out.select(
        *keys, "word_seq", F.array_join(F.col("g.unicode"), "").alias("text"), F.col("g")[0]["x"].alias("x"), F.col("g")[0]["y"].alias("y"),
        (F.element_at("g", -1)["x"] + F.element_at("g", -1)["width"] - F.col("g")[0]["x"]).alias("width"), F.col("g")[0]["font_size"].alias("font_size"),
    )
