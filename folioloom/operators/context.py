"""From hits to excerpts: runs of neighbouring entries, budgets, interleaving and sources.

``entries`` has doc, pos, text, page, section, start, end, section_path and
table_header; ``chosen`` has doc, query_id, pos.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["doc", "query_id"]


def runs(chosen: DataFrame, entries: DataFrame) -> DataFrame:
    """``chosen`` entries with run: consecutive positions of one section share a number (gaps and islands)."""
    rows = chosen.select(*KEYS, "pos").distinct().join(entries, ["doc", "pos"])
    w = Window.partitionBy(*KEYS).orderBy("pos")
    new = (F.lag("pos").over(w) != F.col("pos") - 1) | (F.lag("section").over(w) != F.col("section"))
    return rows.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("_new").over(w)).drop("_new")


def trimmed(run_rows: DataFrame) -> DataFrame:
    """``run_rows`` with body: the text without what its predecessor on the page already has, or under its table's header."""
    w = Window.partitionBy(*KEYS, "run").orderBy("pos")
    same_page = F.coalesce(F.lag("page").over(w) == F.col("page"), F.lit(False))
    overlap = F.greatest(F.lag("end").over(w) - F.col("start"), F.lit(0))
    tail = F.ltrim(F.substring("text", overlap + 1, F.length("text")))
    body = (
        F.when(same_page & (overlap > 0), tail)
        .when((F.col("table_header") != "") & ~same_page, F.concat_ws("\n", "table_header", "text"))
        .otherwise(F.col("text"))
    )
    return run_rows.withColumn("body", body)


def excerpts(chosen: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc, query_id, run, first_pos, section_path, positions, pages, text, page_texts), one row per run."""
    rows = trimmed(runs(chosen, entries)).where("body <> ''")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias("x")))), lambda s: s["x"])
    pages = rows.groupBy(*KEYS, "run", "page").agg(F.min("pos").alias("first"), F.array_join(ordered("body"), " ").alias("content"))
    marked = F.concat(F.lit("[Page "), F.col("page"), F.lit("]\n"), F.col("content"))
    per_run = pages.groupBy(*KEYS, "run").agg(F.array_sort(F.collect_list(F.struct("first", "page", "content", marked.alias("marked")))).alias("p"))
    heads = rows.groupBy(*KEYS, "run").agg(F.min("pos").alias("first_pos"), F.min_by("section_path", "pos").alias("section_path"), F.array_sort(F.collect_list("pos")).alias("positions"))
    return heads.join(per_run, [*KEYS, "run"]).select(
        *KEYS, "run", "first_pos", "section_path", "positions",
        F.transform("p", lambda x: x["page"]).alias("pages"),
        F.array_join(F.transform("p", lambda x: x["marked"]), "\n").alias("text"),
        F.transform("p", lambda x: F.struct(x["page"].alias("page"), x["content"].alias("text"))).alias("page_texts"),
    )


def by_relevance(excerpt_rows: DataFrame, hits: DataFrame) -> DataFrame:
    """``excerpt_rows`` with order: by the best rank of a hit in the run, runs without one last, then by place."""
    best = excerpt_rows.select(*KEYS, "run", F.explode("positions").alias("pos")).join(hits.select(*KEYS, "pos", "rank"), [*KEYS, "pos"]).groupBy(*KEYS, "run").agg(F.min("rank").alias("best"))
    w = Window.partitionBy(*KEYS).orderBy(F.coalesce("best", F.lit(1 << 30)), "first_pos")
    return excerpt_rows.join(best, [*KEYS, "run"], "left").withColumn("order", F.row_number().over(w) - 1)


def render(excerpt_rows: DataFrame, order: str = "first_pos") -> DataFrame:
    """(doc, query_id, context): all excerpts as blocks under their section path."""
    where = F.when(F.coalesce("section_path", F.lit("")) == "", F.lit("Document text")).otherwise(F.col("section_path"))
    block = F.concat(F.lit("--- From: "), where, F.lit("\n"), F.col("text"))
    blocks = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    return excerpt_rows.groupBy(*KEYS).agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").alias("context"))


def sources(excerpt_rows: DataFrame, order: str = "first_pos", limit: int = 1200) -> DataFrame:
    """(doc, query_id, page, text): one source per page, from the first excerpt that has it."""
    rows = excerpt_rows.select(*KEYS, F.col(order).alias("o"), F.posexplode("page_texts").alias("i", "p"))
    best = F.min(F.struct("o", "i", F.substring(F.col("p.text"), 1, limit).alias("text")))
    return rows.groupBy(*KEYS, F.col("p.page").alias("page")).agg(best.alias("b")).select(*KEYS, "page", F.col("b.text").alias("text"), F.col("b.o").alias("o"), F.col("b.i").alias("i"))


def interleave(lists: DataFrame, per_list: int) -> DataFrame:
    """(doc, query_id, pos, order): round-robin over the ranked lists of a question; an entry stays where it comes first.

    ``lists`` is (doc, query_id, list, rank, pos).
    """
    best = lists.where(F.col("rank") < per_list).groupBy(*KEYS, "pos").agg(F.min(F.struct("rank", "list")).alias("b"))
    w = Window.partitionBy(*KEYS).orderBy("b.rank", "b.list", "pos")
    return best.withColumn("order", F.row_number().over(w) - 1).select(*KEYS, "pos", "order")


def owners(lists: DataFrame) -> DataFrame:
    """(doc, query_id, pos, list): the list that ranks an entry best, the earlier list of equals."""
    return lists.groupBy(*KEYS, "pos").agg(F.min_by("list", F.struct("rank", "list")).alias("list"))


def _take_round_robin(group: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Entries that fit the budget: all, or the first of each section, then the second, passing over what is too long."""
    rows = group.sort_values("pos")
    if rows["chars"].sum() > budget:
        rows = rows.assign(depth=rows.groupby("section").cumcount(), lead=rows.groupby("section")["pos"].transform("min"))
        left, depth_open, taken = budget, None, []
        for depth, lead_chars, pos in rows.sort_values(["depth", "lead"])[["depth", "chars", "pos"]].itertuples(index=False):
            if depth != depth_open and left <= 0:
                break
            depth_open = depth
            if lead_chars <= left:
                left -= lead_chars
                taken.append(pos)
        rows = rows[rows["pos"].isin(taken)]
    return rows[["doc", "query_id", "pos"]]


def budgeted(chosen: DataFrame, entries: DataFrame, budget: int) -> DataFrame:
    """``chosen`` cut to ``budget`` characters per question, every section represented."""
    rows = chosen.select(*KEYS, "pos").distinct().join(entries.select("doc", "pos", "section", F.length("text").alias("chars")), ["doc", "pos"])
    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, query_id {rows.schema['query_id'].dataType.simpleString()}, pos {rows.schema['pos'].dataType.simpleString()}"
    return rows.groupBy(*KEYS).applyInPandas(lambda g: _take_round_robin(g, budget), schema)


def expand(hits: DataFrame, entries: DataFrame, budget: int, seeds: int, section_limit: int) -> DataFrame:
    """Entries around the first ``seeds`` hits, within ``budget`` characters per question.

    One of the first two hits brings its whole section if what is new of it
    has at most ``section_limit`` characters; else a hit brings its neighbours
    in the section; else itself.  The first choice that fits is taken.
    """
    seed_rows = hits.where(F.col("rank") < seeds).select(*KEYS, "rank", F.col("pos").alias("seed"))
    at = entries.select("doc", F.col("pos").alias("seed"), F.col("section").alias("seed_section"))
    body = entries.select("doc", "pos", "section", F.length("text").alias("chars"))
    near = (F.abs(F.col("pos") - F.col("seed")) <= 1) & (F.col("section") == F.col("seed_section"))
    whole = (F.col("rank") < 2) & (F.col("seed_section") >= 0) & (F.col("section") == F.col("seed_section"))
    options = seed_rows.join(at, ["doc", "seed"]).join(body, "doc").where(near | whole).withColumn("near", near)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        chosen: dict[int, int] = {}
        for rank, rows in group.sort_values(["rank", "pos"]).groupby("rank", sort=True):
            seed = rows["seed"].iloc[0]
            tries = [rows[rows["near"]], rows[rows["pos"] == seed]]
            new = lambda t: t[~t["pos"].isin(chosen)]
            if rank < 2 and rows["seed_section"].iloc[0] >= 0 and new(rows)["chars"].sum() <= section_limit:
                tries.insert(0, rows)
            for t in tries:
                if sum(chosen.values()) + new(t)["chars"].sum() <= budget:
                    chosen.update(zip(t["pos"].tolist(), t["chars"].tolist()))
                    break
            if sum(chosen.values()) >= budget:
                break
        return pd.DataFrame({"doc": group["doc"].iloc[0], "query_id": group["query_id"].iloc[0], "pos": sorted(chosen)})

    types = {c: options.schema[c].dataType.simpleString() for c in ("doc", "query_id", "pos")}
    return options.groupBy(*KEYS).applyInPandas(choose, ", ".join(f"{c} {t}" for c, t in types.items()))
