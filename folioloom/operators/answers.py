"""Answers from the structure alone, citations, and conversation history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOT_FOUND = "I couldn't find that in the uploaded PDF."
#: Fixed value: what a citation looks like.
CITATION = r"(?i)\[(?:Page|Pages|p\.|pp\.)\s*([0-9][0-9,\s–\-and]*)\]"


def history(messages: DataFrame, pairs: int = 2) -> DataFrame:
    """(doc, turn, question, answer): the last ``pairs`` answered questions of each thread, shortened."""
    w = Window.partitionBy("doc").orderBy("turn")
    rows = messages.withColumn("next_role", F.lead("role").over(w)).withColumn("next", F.lead("content").over(w))
    rows = rows.where((F.col("role") == "user") & (F.col("next_role") == "assistant") & (F.trim("next") != NOT_FOUND))
    last = Window.partitionBy("doc").orderBy(F.col("turn").desc())
    return rows.withColumn("r", F.row_number().over(last)).where(F.col("r") <= pairs).select("doc", "turn", F.substring("content", 1, 500).alias("question"), F.substring("next", 1, 700).alias("answer"))


def cited_pages(answer: Column) -> Column:
    """Sorted array of the pages that an answer cites; a range counts at most 51 pages."""
    marks = F.flatten(F.transform(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), lambda m: F.regexp_extract_all(m, F.lit(r"\d+(?:\s*[–-]\s*\d+)?"), F.lit(0))))

    def pages(mark: Column) -> Column:
        ends = F.transform(F.regexp_extract_all(mark, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
        first, last = F.element_at(ends, 1), F.least(F.element_at(ends, -1), F.element_at(ends, 1) + 50)
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(marks, pages))))


def finalize_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` (doc, query_id, page, ...) that the answer (doc, query_id, answer) cites.

    All of them if it cites none of them; none if nothing was found.
    """
    said = answers.where(F.trim("answer") != NOT_FOUND).select("doc", "query_id", cited_pages(F.col("answer")).alias("cited"))
    rows = sources.join(said, ["doc", "query_id"]).withColumn("_hit", F.array_contains("cited", F.col("page")))
    any_hit = F.max(F.col("_hit").cast("int")).over(Window.partitionBy("doc", "query_id"))
    return rows.withColumn("_any", any_hit).where((F.col("_any") == 0) | F.col("_hit")).select(*sources.columns)
