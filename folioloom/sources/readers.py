"""Readers that turn documents into lines: HTML block elements, and plain text.

PDF bytes are not read here; whatever reads them has to give the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lines import text_lines

#: Block elements that become lines, and the type size of headings.
BLOCKS = r"<(h1|h2|p|li|b)[^>]*>([^<]+)<"
SIZES = {"h1": 18.0, "h2": 14.0}
BODY_SIZE, LINE_HEIGHT, MARGIN = 11.0, 20.0, 72.0


def html_lines(pages: DataFrame, doc: Column, page: Column, html: str = "html") -> DataFrame:
    """Laid-out lines of HTML pages, one per block element in reading order; empty elements and null pages give none."""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(BLOCKS), F.lit(1)).alias("tag"), F.regexp_extract_all(html, F.lit(BLOCKS), F.lit(2)).alias("text"))
    rows = pages.select(doc.cast("string").alias("doc"), page.cast("int").alias("page"), F.posexplode(found).alias("seq", "x")).where("trim(x.text) <> ''")
    size = F.when(F.col("x.tag") == "h1", SIZES["h1"]).when(F.col("x.tag") == "h2", SIZES["h2"]).otherwise(BODY_SIZE)
    rows = rows.select("doc", "page", "seq", F.trim("x.text").alias("text"), size.alias("size"), F.col("x.tag").isin("h1", "h2", "b").alias("bold"))
    top = 80 + LINE_HEIGHT * F.col("seq")
    return rows.withColumns(
        {
            "block": F.col("seq"), "block_lines": F.lit(1).cast("long"), "x0": F.lit(MARGIN), "y0": top, "x1": MARGIN + BODY_SIZE / 2 * F.length("text"), "y1": top + 12,
            "page_width": F.lit(595.0), "page_height": F.lit(10000.0), "is_table": F.lit(False),
        }
    )


__all__ = ["html_lines", "text_lines"]
