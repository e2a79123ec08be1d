"""Operators on laid-out lines and plain text lines.

``lines`` has a row per text line: doc, page, seq, text and, where the layout
is known, size, bold, block, block_lines, x0, y0, x1, y1, page_width,
page_height and is_table.  ``seq`` orders the lines of a page.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold, normalize_title, plain_key

BAND = 0.07
#: Patterns of page numbers, contents entries, captions and bullets.
PAGE_NUMBER = r"(?i)^(?:page\s+)?[-–—\s]*(?:\d{1,4}|[ivxlcdm]{1,6})(?:\s*(?:of|/)\s*\d{1,4})?[-–—\s]*$"
ENDS_WITH_PAGE = r"[A-Za-z][^|]*?(?:\.{2,}|…|\s)\s*\d{1,3}$"
CONTENTS_TITLE = r"(?i)^(?:(?:table of )?contents$|list of (?:figures|tables|boxes))"
CONTENTS_ENTRY = r"(?:^|(?<=\s)|(?<=\+))\s*(\d{1,2}(?:\.\d{1,2}){0,2})\.?\s+([A-Z][^+\n|]*?)\s*(?:\.{2,}|…)?\s*\|?\s*(\d{1,3})(?=\s|$)"
TOC_LINE = r"(?:\.{3,}|…{2,}|\s{2,}|\t)\s*\d{1,4}\s*$"
CAPTION = r"(?i)^(table|figure|fig\.|exhibit|box|chart)\s+((?:[A-Z][.\-])?\d{1,3}(?:[.\-]\d{1,3})*|[A-Z])(\s*[:.\-–—|]\s*|\s+)(\S.*)$"
CAPTION_VERBS = "illustrates shows presents provides lists describes summarizes summarises depicts contains gives highlights outlines compares displays reports is was and in".split()
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty".split()
CHAPTER_LINE = rf"(?i)^(?:chapter|part|annex|appendix)\s+(?:\d{{1,4}}|[ivxlcdm]{{1,7}}|[a-z]|(?:{'|'.join(NUMBER_WORDS)}))\b.{{0,90}}$"
NUMBERED_LINE = r"^(\d{1,3}(?:\.\d{1,3}){0,3})[.)]?\s+([A-Z][^.!?]{2,90})$"
HEADING_NUMBER = r"^(\d{1,3}(?:\.\d{1,3}){0,4}|[A-Z](?:\.\d{1,3}){1,3})[.)]?\s+\S"


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, which no built-in function does."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def clean_text(c: Column) -> Column:
    """NFKC text with single spaces."""
    return F.trim(F.regexp_replace(nfkc(c), r"\s+", " "))


def page_lines(spans: DataFrame) -> DataFrame:
    """Lines from text spans (doc, page, block, line, span, text, size, font, flags, dir_y, x0, y0, x1, y1).

    Rotated lines and lines without a letter or digit go; the size is that of
    the longest span in halves, and a line is bold if all of its visible spans are.
    """
    seen = F.trim("text") != ""
    bold = (F.col("flags").bitwiseAND(16) != 0) | F.contains(F.lower("font"), F.lit("bold"))
    key = ["doc", "page", "block", "line"]
    rows = spans.where(F.abs("dir_y") <= 0.2).groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: s["text"]), "").alias("text"),
        F.max_by(F.when(seen, F.col("size")), F.when(seen, F.struct(F.length(F.trim("text")), -F.col("span")))).alias("size"),
        F.bool_and(F.when(seen, bold)).alias("bold"),
        *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")],
    )
    rows = rows.withColumn("text", clean_text(F.col("text"))).withColumn("size", F.round(F.col("size") * 2) / 2)
    rows = rows.where(F.col("text").rlike(r"[\p{L}\p{N}]") & F.col("size").isNotNull())
    w = Window.partitionBy("doc", "page")
    return rows.withColumn("block_lines", F.count("*").over(w.partitionBy("doc", "page", "block"))).withColumn("seq", F.row_number().over(w.orderBy("block", "line")) - 1).withColumn("is_table", F.lit(False))


def text_lines(docs: DataFrame, per_page: int = 40) -> DataFrame:
    """Lines of plain texts (doc, text): pages of ``per_page`` lines, with the running offset of each line in its text."""
    rows = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    w = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("doc", (F.floor(F.col("n") / per_page) + 1).cast("int").alias("page"), "n", "text", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("long").alias("offset"))


def running_keys(lines: DataFrame, in_band: Column) -> DataFrame:
    """(doc, key): keys of band lines on at least 3 pages and four tenths of the document's pages."""
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("n_pages"))
    seen = lines.where(in_band).select("doc", "page", plain_key(F.col("text")).alias("key")).distinct().groupBy("doc", "key").agg(F.count("*").alias("on_pages"))
    return seen.join(pages, "doc").where(F.col("on_pages") >= F.greatest(F.lit(3), F.floor(F.col("n_pages") * 0.4))).select("doc", "key")


def in_band() -> Column:
    """Whether a line lies in the top or bottom band of its page."""
    return (F.col("page_height") > 0) & (F.col("y1") > 1) & ((F.col("y1") < F.col("page_height") * BAND) | (F.col("y0") > F.col("page_height") * (1 - BAND)))


def without_running_lines(lines: DataFrame) -> DataFrame:
    """``lines`` without repeated headers and footers and without bare page numbers in the bands."""
    body = lines.where(~in_band())
    banded = lines.where(in_band() & ~F.col("text").rlike(PAGE_NUMBER)).withColumn("key", plain_key(F.col("text")))
    return body.unionByName(banded.join(running_keys(lines, in_band()), ["doc", "key"], "left_anti").select(*body.columns))


def ends_with_page(text: Column) -> Column:
    """Whether a line reads like a contents entry; the plain test spares other lines the costly pattern."""
    return text.rlike(r"\d$") & text.rlike(ENDS_WITH_PAGE)


def contents_pages(lines: DataFrame) -> DataFrame:
    """(doc, page) of contents pages and lists of figures: many lines that end in a page number."""
    cells = F.split("text", r" \| ")
    row = F.col("is_table")
    row_hit = row & (F.size(cells) <= 3) & F.element_at(cells, -1).rlike(r"^\d{1,3}$") & F.array_join(F.slice(cells, 1, F.size(cells) - 1), "").rlike(r"\p{L}")
    numbers = lines.where(F.col("text").rlike(r"^\d{1,3}$")).select("doc", "page", F.col("seq").alias("n_seq"), F.col("y0").alias("n_y0"), F.col("x0").alias("n_x0"))
    beside = (F.abs(F.col("y0") - F.col("n_y0")) < 2.5) & (F.col("x1") < F.col("n_x0")) & (F.col("seq") != F.col("n_seq"))
    right = numbers.join(lines.select("doc", "page", "seq", "y0", "x1"), ["doc", "page"]).where(beside).select("doc", "page", "n_seq").distinct().groupBy("doc", "page").agg(F.count("*").alias("right"))
    score = lines.groupBy("doc", "page").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.when(row, row_hit).otherwise(ends_with_page(F.col("text"))), 1).otherwise(0)).alias("hits"),
        F.bool_or(F.when(row, F.array_join(cells, " ")).otherwise(F.col("text")).rlike(CONTENTS_TITLE)).alias("titled"),
    )
    score = score.join(right, ["doc", "page"], "left").withColumn("hits", F.col("hits") + F.coalesce("right", F.lit(0)))
    enough = (F.col("hits") * 100 >= F.col("n") * 35) | (F.col("titled") & (F.col("hits") * 100 >= F.col("n") * 20))
    return score.where((F.col("n") >= 6) & (F.col("hits") >= 6) & enough).select("doc", "page")


def contents_numbers(page_text: DataFrame, contents: DataFrame) -> DataFrame:
    """(doc, key, number): numbers that only the contents page gives, by normalised title; the first of equals."""
    flat = F.regexp_replace("text", "\n", " ")
    rows = page_text.join(contents, ["doc", "page"], "left_semi").select(
        "doc", "page", F.posexplode(F.arrays_zip(*[F.regexp_extract_all(flat, F.lit(CONTENTS_ENTRY), F.lit(g)).alias(a) for g, a in ((1, "number"), (2, "title"))])).alias("i", "m")
    )
    rows = rows.withColumn("key", normalize_title(F.regexp_replace("m.title", r"^[ .:]+|[ .:]+$", "")))
    first = F.min_by("m.number", F.struct("page", "i"))
    return rows.where(F.length("key").between(3, 120)).groupBy("doc", "key").agg(first.alias("number"))


def body_size(lines: DataFrame) -> DataFrame:
    """(doc, body_size): the font size with most characters outside tables (weighted mode; the first seen of equals)."""
    rows = lines.where((F.col("size") > 0) & ~F.col("is_table")).groupBy("doc", "size").agg(F.sum(F.length("text")).alias("chars"), F.min(F.struct("page", "seq")).alias("first"))
    w = Window.partitionBy("doc").orderBy(F.col("chars").desc(), "first")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc", F.col("size").alias("body_size"))


def captions(paragraphs: DataFrame) -> DataFrame:
    """(doc, page, offset, kind, number, text) of the paragraphs (doc, page, offset, text) that are captions.

    Not entries of a list of figures, and without a separator only short ones
    whose next word is capitalised and no verb.
    """
    kind = F.lower(F.regexp_extract("text", CAPTION, 1))
    word = F.regexp_extract(F.regexp_extract("text", CAPTION, 4), r"^\S+", 0)
    bare = F.trim(F.regexp_extract("text", CAPTION, 3)) == ""
    sentence = ~word.rlike(r"^\p{Lu}") | (F.length("text") > 300) | fold(word).isin(CAPTION_VERBS)
    first_line = F.element_at(F.split("text", "\n"), 1)
    rows = paragraphs.where(F.col("text").rlike(CAPTION) & ~first_line.rlike(TOC_LINE) & ~(bare & sentence))
    return rows.select("doc", "page", "offset", F.when(kind.isin("fig.", "chart"), "figure").otherwise(kind).alias("kind"), F.regexp_extract("text", CAPTION, 2).alias("number"), F.substring(F.regexp_replace("text", r"\s+", " "), 1, 300).alias("text"))


def dedupe_captions(rows: DataFrame) -> DataFrame:
    """One caption per kind and number: the first on a page with at most three captions, else the first."""
    crowded = F.count("*").over(Window.partitionBy("doc", "page")) > 3
    w = Window.partitionBy("doc", "kind", fold(F.col("number"))).orderBy("crowded", "page", "offset")
    return rows.withColumn("crowded", crowded).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "crowded")


def outline_candidates(lines: DataFrame) -> DataFrame:
    """(doc, page, offset, title, level) of the text lines that read like chapter or numbered headings."""
    title = F.trim("text")
    number = F.regexp_extract(title, NUMBERED_LINE, 1)
    level = F.when(title.rlike(CHAPTER_LINE), 1).when((number != "") & (F.size(F.split(title, r"\s+")) <= 12), F.size(F.split(number, r"\.")))
    return lines.where((title != "") & (F.length(title) <= 100) & ~title.rlike(TOC_LINE)).select("doc", "page", "offset", title.alias("title"), level.alias("level")).where("level IS NOT NULL")


def least_crowded(candidates: DataFrame) -> DataFrame:
    """One entry per folded title: that on the page with fewest candidates, the first of equals; none if fewer than two remain."""
    w = Window.partitionBy("doc", fold(F.col("title"))).orderBy("crowd", "page", "offset")
    rows = candidates.withColumn("crowd", F.count("*").over(Window.partitionBy("doc", "page"))).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "crowd")
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("doc"))).where("n >= 2").drop("n")


def dedupe_outline(entries: DataFrame) -> DataFrame:
    """``entries`` without those that repeat their predecessor's title on its page."""
    w = Window.partitionBy("doc").orderBy("page", "offset")
    same = (F.lag("page").over(w) == F.col("page")) & (F.lag(fold(F.col("title"))).over(w) == fold(F.col("title")))
    return entries.withColumn("_same", F.coalesce(same, F.lit(False))).where("NOT _same").drop("_same")


def font_levels(headings: DataFrame) -> DataFrame:
    """``headings`` (doc, size, ...) with level: rank of the size from the largest, four at most."""
    w = Window.partitionBy("doc").orderBy(F.col("size").desc())
    return headings.withColumn("level", F.least(F.dense_rank().over(w), F.lit(4)))


def islands(lines: DataFrame, is_row: Column, least: int = 2) -> DataFrame:
    """(doc, page, table, first, last, n_rows): maximal runs of at least ``least`` consecutive row lines."""
    w = Window.partitionBy("doc", "page").orderBy("n")
    marked = lines.where(is_row).withColumn("table", F.col("n") - F.row_number().over(w))
    return marked.groupBy("doc", "page", "table").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count("*").alias("n_rows")).where(F.col("n_rows") >= least)


def upper_median(values: Column) -> Column:
    """The middle of a sorted array, the upper of two (no interpolation)."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def nearest_rank(values: Column, share: float) -> Column:
    """The value at place floor(share * n) of a sorted array; the largest of three or fewer."""
    return F.when(F.size(values) > 3, F.element_at(F.array_sort(values), (F.floor(F.size(values) * share) + 1).cast("int"))).otherwise(F.array_max(values))
