"""Section trees as tables.

``sections`` has a row per heading: doc, idx (0.. in reading order), title,
level, page_start, offset and, once inferred, parent (null at the top),
page_end, noun, number, matter and fields.  All operators work on every
document at once; windows are partitioned by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LEVEL = 9
#: Nouns of divisions, nouns of numbered content, and their plurals.
DIVISION_NOUNS = {
    "chapter": "chapters", "section": "sections", "topic": "topics", "story": "stories", "part": "parts", "unit": "units",
    "lesson": "lessons", "module": "modules", "article": "articles", "book": "books", "episode": "episodes", "case": "cases",
    "annex": "annexes", "appendix": "appendices", "schedule": "schedules", "clause": "clauses",
}
CONTENT_NOUNS = {
    "recommendation": "recommendations", "principle": "principles", "objective": "objectives", "outcome": "outcomes",
    "output": "outputs", "pillar": "pillars", "component": "components", "goal": "goals", "priority": "priorities",
    "step": "steps", "phase": "phases", "stage": "stages", "requirement": "requirements", "standard": "standards",
    "guideline": "guidelines", "rule": "rules", "measure": "measures", "action": "actions", "activity": "activities",
    "strategy": "strategies", "theme": "themes", "finding": "findings", "indicator": "indicators", "target": "targets",
    "criterion": "criteria", "question": "questions", "regulation": "regulations", "policy": "policies",
}
PLURALS = DIVISION_NOUNS | CONTENT_NOUNS
BACK_MATTER = ["annex", "appendix", "schedule"]
#: Words in a title that give a section its role.
ROLES = {
    "summary": "abstract|executive summary|summary|key messages|key findings|highlights|at a glance|overview|synopsis",
    "introduction": "introduction|background|context|rationale|problem statement",
    "objectives": "objectives|objective|aims|aim|goals|goal|purpose|scope|mission|vision",
    "methods": "methodology|methods|method|approach|materials and methods|research design|data and methods|experimental setup",
    "results": "results|findings|outcomes|evaluation|experiments|performance|achievements",
    "discussion": "discussion|analysis|implications|interpretation",
    "conclusion": "conclusion|conclusions|concluding remarks|next steps|way forward|final remarks",
    "recommendations": "recommendations|recommendation|proposals|actions|policy recommendations|action plan",
    "limitations": "limitations|limitation|challenges|constraints|risks|risk|lessons learned",
    "definitions": "definitions|glossary|terminology|terms|abbreviations|acronyms|a note on terminology",
    "budget": "budget|financing|funding|costs|cost|financial|resources|resource requirements",
    "governance": "governance|roles and responsibilities|institutional arrangements|implementation arrangements|management arrangements|oversight|accountability",
    "monitoring": "monitoring|evaluation|monitoring and evaluation|indicators|reporting|results framework|performance measurement",
    "implementation": "implementation|delivery|timeline|work plan|workplan|roadmap|schedule|phasing",
    "references": "references|bibliography|works cited",
}


def _reading() -> Window:
    return Window.partitionBy("doc").orderBy("idx")


def parents(sections: DataFrame) -> DataFrame:
    """``sections`` with parent: the nearest earlier section of a smaller level.

    The last section of each level so far is a running value; the parent is
    the latest among the smaller levels.  One pass per document, whatever the
    number of sections.
    """
    before = _reading().rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == n, F.col("idx")), ignorenulls=True).over(before) for n in range(1, MAX_LEVEL + 1)]
    best = F.array_max(F.filter(F.array(*[F.when(F.col("level") > n, c) for n, c in enumerate(last, start=1)]), lambda x: x.isNotNull()))
    return sections.withColumn("parent", best)


def page_ends(sections: DataFrame, last_page: Column | str = "last_page") -> DataFrame:
    """``sections`` with page_end: where the next section of the same or a smaller level starts.

    That section's first page is left out if it starts at the top of it; the
    document's last page if there is none; never before the own first page.
    """
    after = Window.partitionBy("doc").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, -1)  # running values from the end; frames up to the end are computed anew for each row
    stop = F.struct("idx", (F.col("page_start") - F.when(F.col("offset") == 0, 1).otherwise(0)).alias("end"))
    nexts = [F.last(F.when(F.col("level") == n, stop), ignorenulls=True).over(after) for n in range(1, MAX_LEVEL + 1)]
    following = F.array_min(F.filter(F.array(*[F.when(F.col("level") >= n, c) for n, c in enumerate(nexts, start=1)]), lambda x: x.isNotNull()))
    end = F.coalesce(following["end"], F.col(last_page) if isinstance(last_page, str) else last_page)
    return sections.withColumn("page_end", F.greatest("page_start", end))


def closure(sections: DataFrame, depth: int = MAX_LEVEL) -> DataFrame:
    """(doc, anc, desc, depth) of every section and its ancestors, itself at depth 0."""
    up = sections.select("doc", F.col("idx").alias("child"), F.col("parent").alias("above")).where("above IS NOT NULL")
    step = sections.select("doc", F.col("idx").alias("anc"), F.col("idx").alias("desc"), F.lit(0).alias("depth"))
    out = step
    for d in range(1, depth):
        step = step.join(up, (step["doc"] == up["doc"]) & (step["anc"] == up["child"])).select(step["doc"], F.col("above").alias("anc"), "desc", F.lit(d).alias("depth"))
        out = out.unionByName(step)
    return out


def paths(sections: DataFrame, depth: int = MAX_LEVEL) -> DataFrame:
    """(doc, idx, section_path): titles from the top down, joined by " > "."""
    titles = sections.select("doc", F.col("idx").alias("anc"), "title")
    rows = closure(sections, depth).join(titles, ["doc", "anc"])
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "title")))
    return rows.groupBy("doc", F.col("desc").alias("idx")).agg(F.array_join(F.transform(ordered, lambda x: x["title"]), " > ").alias("section_path"))


def children_counts(sections: DataFrame) -> DataFrame:
    """(doc, idx, n_children, n_descendants)."""
    direct = sections.where("parent IS NOT NULL").groupBy("doc", F.col("parent").alias("idx")).agg(F.count("*").alias("n_children"))
    below = closure(sections).where("depth > 0").groupBy("doc", F.col("anc").alias("idx")).agg(F.count("*").alias("n_descendants"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sections.select("doc", "idx").join(direct, ["doc", "idx"], "left").join(below, ["doc", "idx"], "left").select("doc", "idx", zero("n_children"), zero("n_descendants"))


def unit_level(sections: DataFrame) -> DataFrame:
    """(doc, unit_level): the first level with two chapters, else with two sections that are not front or back matter, else the top."""
    by_level = sections.groupBy("doc", "level").agg(
        F.sum(F.when(F.col("noun") == "chapter", 1).otherwise(0)).alias("chapters"), F.sum(F.when(~F.col("matter"), 1).otherwise(0)).alias("plain")
    )
    rank = F.when(F.col("chapters") >= 2, 0).when(F.col("plain") >= 2, 1).otherwise(2)
    first = F.min(F.struct(rank.alias("rank"), "level"))
    return by_level.groupBy("doc").agg(first["level"].alias("unit_level"))


def units(sections: DataFrame) -> DataFrame:
    """``sections`` of the unit level that are no matter, with ordinal from 1."""
    rows = sections.join(unit_level(sections), "doc").where("level = unit_level AND NOT matter")
    return rows.withColumn("ordinal", F.row_number().over(_reading()))


def unit_noun(unit_rows: DataFrame) -> DataFrame:
    """(doc, unit_noun): the commonest noun of the units if at least half of those outside back matter have it; the earliest of equals."""
    body = unit_rows.where(F.col("noun").isNull() | ~F.col("noun").isin(BACK_MATTER))
    total = body.groupBy("doc").agg(F.count("*").alias("n_body"))
    nouns = body.where("noun IS NOT NULL").groupBy("doc", "noun").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    best = nouns.groupBy("doc").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "noun")).alias("b"))
    return best.join(total, "doc").where("b.n * 2 >= n_body").select("doc", F.col("b.noun").alias("unit_noun"))


def common_fields(unit_rows: DataFrame) -> DataFrame:
    """(doc, key, n): fields that at least three tenths of the units have."""
    total = unit_rows.groupBy("doc").agg(F.count("*").alias("n_units"))
    keys = unit_rows.select("doc", F.explode(F.map_keys("fields")).alias("key")).groupBy("doc", "key").agg(F.count("*").alias("n"))
    return keys.join(total, "doc").where("n * 10 >= n_units * 3").select("doc", "key", "n")


def field_histogram(unit_rows: DataFrame) -> DataFrame:
    """(doc, key, value, n) of the units' field values."""
    return unit_rows.select("doc", F.explode("fields").alias("key", "value")).where("value <> ''").groupBy("doc", "key", "value").agg(F.count("*").alias("n"))


def level_histogram(sections: DataFrame) -> DataFrame:
    """(doc, level, n) with the document's total in the row whose level is null."""
    rolled = sections.groupBy("doc", "level").agg(F.count("*").alias("n"))
    return rolled.unionByName(sections.groupBy("doc").agg(F.count("*").alias("n")).select("doc", F.lit(None).cast("int").alias("level"), "n"))


def longest_labelled(sections: DataFrame, latest_of_equals: bool) -> DataFrame:
    """One section per (doc, noun, number): that with the longest span.

    Listing takes the earliest of equal spans, resolving a reference the latest.
    """
    tie = F.col("idx") if latest_of_equals else -F.col("idx")
    best = F.max(F.struct((F.col("page_end") - F.col("page_start")).alias("span"), tie.alias("tie"), "idx"))
    return sections.where("noun IS NOT NULL AND number IS NOT NULL").groupBy("doc", "noun", "number").agg(best["idx"].alias("idx"))


def place(items: DataFrame, sections: DataFrame) -> DataFrame:
    """``items`` (doc, page, offset, ...) with section: the last that starts at or before them, -1 if none (as-of join).

    Both are put in one order per document and the last section is carried
    forward; of equal places the section comes first.
    """
    extra = [c for c in items.columns if c not in ("doc", "page", "offset")]
    marks = sections.select("doc", F.col("page_start").alias("page"), "offset", F.lit(0).alias("_kind"), F.col("idx").alias("_idx"), *[F.lit(None).cast(items.schema[c].dataType).alias(c) for c in extra])
    asked = items.select("doc", "page", "offset", F.lit(1).alias("_kind"), F.lit(None).cast(sections.schema["idx"].dataType).alias("_idx"), *extra)
    w = Window.partitionBy("doc").orderBy("page", "offset", "_kind", "_idx").rowsBetween(Window.unboundedPreceding, 0)
    carried = marks.unionByName(asked).withColumn("section", F.coalesce(F.last("_idx", ignorenulls=True).over(w), F.lit(-1)))
    return carried.where("_kind = 1").select(*items.columns, "section")


def units_on_pages(unit_rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc, page, idx): the units that cover each asked page (range join inside a document)."""
    return asked.join(unit_rows.select("doc", "idx", "page_start", "page_end"), "doc").where("page BETWEEN page_start AND page_end").select("doc", "page", "idx")


def missing_numbers(unit_rows: DataFrame, low: int, high: int) -> DataFrame:
    """(doc, number): numbers from low to high that no unit has."""
    docs = unit_rows.select("doc").distinct()
    wanted = docs.select("doc", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("number"))
    return wanted.join(unit_rows.select("doc", F.col("number").cast("int").alias("number")), ["doc", "number"], "left_anti")


def role_tags(normalized: Column) -> Column:
    """array<string> of the roles of a normalised title, in the order of ROLES."""
    padded = F.concat(F.lit(" "), normalized, F.lit(" "))
    found = [F.when(padded.rlike(f" ({words}) "), F.lit(role)) for role, words in ROLES.items()]
    return F.filter(F.array(*found), lambda r: r.isNotNull())


def pages_text(start: Column, end: Column) -> Column:
    """"Page 3" or "Pages 3–5"."""
    return F.when(start == end, F.concat(F.lit("Page "), start)).otherwise(F.concat(F.lit("Pages "), start, F.lit("–"), end))
