"""The engine: documents in as laid-out lines, questions in as a table, answers out as a table.

``ingest`` derives and stores the tables of a batch of documents; ``ask``
routes a batch of questions, answers what the structure can answer, and for
the rest searches, gates on evidence, assembles the context and calls the
generator plug-in once for all prompts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import vectors as V
from ..operators import answers as A
from ..operators import context as C
from ..operators import layout as Y
from ..operators import lines as L
from ..operators import outline as O
from ..operators import routing as R
from ..operators import search as S
from ..operators import sections as D
from ..operators import structure as tree
from ..operators import structural as N
from ..sources.store import SCHEMA, STRUCTURE, Store

#: Lengths of answers: share of the token budget and the wording for the generator.
LENGTHS = {"brief": (0.4, "Answer in at most about 120 words."), "normal": (0.7, "Answer only as long as the question needs."), "detailed": (1.5, "Answer completely, under short labels.")}
WIDE = ["multi", "compare", "analysis", "enumerate"]


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1000
    chunk_overlap: int = 150
    top_k: int = 6
    min_similarity: float = 0.30
    qa_chars: int = 14_000
    analysis_chars: int = 22_000
    explain_chars: int = 28_000
    unit_chars: int = 8_000
    overview_chars: int = 20_000
    answer_tokens: int = 1000
    max_units: int = 25


def grounded_stub(prompts: pd.Series) -> pd.Series:
    """Offline generator: cites the first page of the context."""
    page = prompts.str.extract(r"\[Page (\d+)\]")[0]
    return page.map(lambda p: f"Grounded answer [Page {p}]." if isinstance(p, str) else A.NOT_FOUND)


def answer_tokens(detail: Column, mode: Column, budget: int) -> Column:
    share = F.when(detail == "brief", 0.4).when(detail == "detailed", 1.5).otherwise(0.7)
    wide = F.when(mode.isin(WIDE) & (detail != "brief"), 1.4).otherwise(1.0)
    return F.greatest(F.lit(200), F.floor(share * wide * budget)).cast("int")


class Engine:
    """``generate`` maps a Series of prompts to a Series of answers; ``embed`` a DataFrame of texts to (keys, embedding)."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings(), generate: Callable[[pd.Series], pd.Series] = grounded_stub, embed=None) -> None:
        self.spark, self.store, self.settings, self.generate, self.embed = spark, Store(spark, root), settings, generate, embed

    def _kept(self, rows: DataFrame) -> DataFrame:
        """``rows`` written under the store's work folder and read again: later steps start from a table, not from the whole plan."""
        path = f"{self.store.root}/_work/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    # -- ingest

    def ingest(self, lines: DataFrame, bookmarks: DataFrame | None = None) -> DataFrame:
        """Derives all tables of the documents in ``lines``; returns (doc, pages, chunks, sections, units)."""
        s = self.settings
        total = lines.groupBy("doc").agg(F.count_distinct("page").alias("page_count"))
        clean = self._kept(L.without_running_lines(Y.table_rows(lines)))
        contents = self._kept(L.contents_pages(clean))
        par = self._kept(Y.paragraphs(clean))
        pages = self._kept(Y.page_text(par))
        outline = O.outline(pages, Y.headings(par, contents), bookmarks)
        sections = self._kept(D.sections(outline, pages, L.contents_numbers(pages, contents), total))
        no_list = contents.withColumnRenamed("page", "_p").withColumnRenamed("doc", "_d")
        plain = par.join(no_list, (F.col("doc") == F.col("_d")) & (F.col("page") == F.col("_p")), "left_anti")
        found = L.dedupe_captions(L.captions(plain.where("NOT heading AND NOT is_table")))
        captions, tables = tree.place(found, sections), tree.place(Y.tables(plain), sections)
        chunks = D.annotate(Y.chunks(pages, sections, Y.tables(par), s.chunk_size, s.chunk_overlap), sections)
        for name, rows, version in (("pages", pages, {}), ("sections", sections, {"version": STRUCTURE}), ("captions", captions, {}), ("tables", tables, {}), ("chunks", chunks, {"schema": SCHEMA})):
            old = self.store.read(name)
            fresh = lines.select(F.col("doc").cast("string").alias("doc")).distinct()
            kept = None if old is None else old.join(fresh, "doc", "left_anti")
            rows = rows.withColumns({k: F.lit(v) for k, v in version.items()})
            self.store.write(name, rows if kept is None else kept.unionByName(rows, allowMissingColumns=True))
        n = lambda df, c: df.groupBy("doc").agg(F.count("*").alias(c))
        units = sections.where("ordinal IS NOT NULL")
        return total.join(n(chunks, "chunks"), "doc", "left").join(n(sections, "sections"), "doc", "left").join(n(units, "units"), "doc", "left").na.fill(0)

    def entries(self) -> DataFrame:
        return self.store.read("chunks").withColumn("doc", F.col("doc").cast("string"))

    def structures(self) -> DataFrame:
        no_doc = lambda name: self.store.read(name).withColumn("doc", F.col("doc").cast("string"))
        return N.structures(no_doc("sections").drop("version"), no_doc("captions"), no_doc("tables"))

    # -- ask

    def plan(self, questions: DataFrame) -> DataFrame:
        """Routes of ``questions`` (doc, turn, text), with query_id = turn."""
        routed = self._kept(R.route_questions(questions, self.store.read("sections"), self.store.read("captions")))
        asks = routed.where(F.col("intent").isin("count", "list", "lookup") | ((F.col("intent") == "explain") & (F.size("units") == 0)))
        asks = asks.join(self.structures(), "doc", "left").withColumn("direct", N.structural_answers(F.struct(*R.ROUTE.names), F.col("structure"))).select("doc", "turn", "direct")
        return routed.join(asks, ["doc", "turn"], "left").withColumn("query_id", F.col("turn"))

    def hits(self, plan: DataFrame, limit: int) -> DataFrame:
        """Search hits of every query and sub-query: (doc, query_id, list, rank, pos, score, similarity, coverage)."""
        every = plan.select("doc", "query_id", F.posexplode(F.concat(F.array("search_query"), "subqueries")).alias("list", "text"))
        asked = every.withColumn("key", F.col("query_id") * 16 + F.col("list"))
        body = F.array_join(F.filter(F.array("section_path", "table_header", "text"), lambda x: F.trim(x) != ""), "\n")
        vectors = None
        q = asked.select("doc", F.col("key").alias("query_id"), "text")
        if self.embed is not None:
            vectors = self.embed(self.entries().select("doc", "pos", body.alias("text")), ["doc", "pos"])
            q = q.join(self.embed(q, ["doc", "query_id"]), ["doc", "query_id"], "left")
        found = S.search(self.entries(), q, limit, vectors, text=body)
        return found.withColumn("list", F.col("query_id") % 16).withColumn("query_id", F.expr("query_id div 16"))

    def scope(self, plan: DataFrame, column: str = "units") -> DataFrame:
        """(doc, query_id, pos) of the entries in the routed sections and all below them."""
        below = self.store.read("sections").select(F.col("doc").cast("string").alias("doc"), F.col("idx").alias("section"), F.explode("ancestors").alias("idx"))
        wanted = plan.select("doc", "query_id", F.explode(column).alias("idx")).join(below, ["doc", "idx"]).select("doc", "query_id", "section").distinct()
        by_unit = plan.select("doc", "query_id", F.explode(column).alias("unit")).join(self.entries().select("doc", "pos", "unit"), ["doc", "unit"]).select("doc", "query_id", "pos")
        return wanted.join(self.entries().select("doc", "pos", "section"), ["doc", "section"]).select("doc", "query_id", "pos").unionByName(by_unit).distinct()

    def evidence(self, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(doc, query_id, pos) that each open question is answered from, none where the evidence is too weak; and the ranks of hits among them."""
        s, entries = self.settings, self.entries()
        intent = F.col("intent")
        found = self._kept(self.hits(plan.where(intent.isin("qa", "scoped_qa")), s.top_k))
        good = S.has_evidence(found, s.min_similarity).where("evidence").select("doc", "query_id")
        wide = plan.where(intent == "qa").join(good, ["doc", "query_id"], "left_semi")
        best = self._kept(C.interleave(found.join(wide.select("doc", "query_id"), ["doc", "query_id"], "left_semi"), 3 * s.top_k).withColumnRenamed("order", "rank"))
        qa = C.expand(best, entries, s.qa_chars, 3 * s.top_k, s.qa_chars // 2)
        roles = C.budgeted(self.scope(plan.where(intent == "qa"), "role_sections"), entries, int(s.qa_chars * 0.4))
        whole = C.budgeted(self.scope(plan.where(intent.isin("explain", "compare", "scoped_qa"))), entries, s.explain_chars)
        on_page = plan.where(intent == "page").select("doc", "query_id", F.explode("pages").alias("page")).join(entries.select("doc", "pos", "page"), ["doc", "page"])
        by_page = C.budgeted(on_page, entries, s.explain_chars)
        shown = plan.where(intent == "caption").select("doc", "query_id", F.explode("captions.page").alias("page")).distinct()
        by_caption = C.budgeted(shown.join(entries.select("doc", "pos", "page"), ["doc", "page"]).select("doc", "query_id", "pos").distinct(), entries, s.qa_chars)
        first = Window.partitionBy("doc", "unit").orderBy("pos")
        opening = entries.withColumn("r", F.row_number().over(first)).where("r = 1").select("doc", "pos")
        overview = C.budgeted(plan.where(intent == "overview").select("doc", "query_id").join(opening, "doc"), entries, s.overview_chars)
        out = qa
        for rows in (roles, whole, by_page, by_caption, overview):
            out = out.unionByName(rows.select("doc", "query_id", "pos"))
        return self._kept(out.distinct()), best

    def locate(self, plan: DataFrame) -> DataFrame:
        """(doc, query_id, answer): which sections discuss a topic, best first, each with a quoted sentence."""
        s, asked = self.settings, plan.where("intent = 'locate'")
        found = self._kept(self.hits(asked, 12).where("list = 0"))
        good = S.has_evidence(found, s.min_similarity).where("evidence").select("doc", "query_id")
        strong = (F.col("coverage") >= 0.5) | (F.coalesce("similarity", F.lit(0.0)) >= s.min_similarity + 0.05)
        sections = self.store.read("sections").select(F.col("doc").cast("string").alias("doc"), F.col("idx").alias("section"), "title", "matter")
        rows = found.join(good, ["doc", "query_id"], "left_semi").where(strong).join(self.entries().select("doc", "pos", "section", "page", "text", "section_path"), ["doc", "pos"])
        rows = rows.join(sections, ["doc", "section"], "left").where("matter IS NULL OR NOT matter").join(asked.select("doc", "query_id", X.query_terms(F.col("search_query")).alias("terms")), ["doc", "query_id"])
        bonus = 0.05 * F.size(F.array_intersect(X.stems(F.coalesce("title", F.lit(""))), "terms"))
        first = F.min_by(F.struct("page", "text", "section_path", "terms"), "rank")
        groups = rows.withColumn("bonus", bonus).groupBy("doc", "query_id", "section").agg((F.sum("score") + F.max("bonus")).alias("weight"), first.alias("b"), F.array_sort(F.collect_set("page")).alias("pages"))
        w = Window.partitionBy("doc", "query_id").orderBy(F.round("weight", 9).desc(), "section")
        groups = groups.withColumn("n", F.row_number().over(w)).where("n <= 6")
        where = F.when(F.col("b.section_path") == "", "Text before the first heading").otherwise(F.col("b.section_path"))
        label = F.when(F.size("pages") == 1, F.concat(F.lit("Page "), F.element_at("pages", 1))).otherwise(F.concat(F.lit("Pages "), F.array_join("pages", ", ")))
        line = F.concat("n", F.lit(". "), where, F.lit(" ["), label, F.lit(']\n   "'), X.best_sentence(F.col("b.text"), F.col("b.terms")), F.lit('" [Page '), F.col("b.page"), F.lit("]"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n")
        return groups.groupBy("doc", "query_id").agg(F.concat(F.lit("The topic is discussed in these parts of the document (most relevant first):\n\n"), joined).alias("answer"))

    def ask(self, questions: DataFrame) -> DataFrame:
        """(doc, turn, intent, answer, sources) of ``questions`` (doc, turn, text)."""
        plan = self._kept(self.plan(questions))
        direct = plan.where("direct.answer IS NOT NULL").select("doc", "turn", "intent", F.col("direct.answer").alias("answer"), F.col("direct.sources").alias("sources"))
        located = self.locate(plan).select("doc", F.col("query_id").alias("turn"), F.lit("locate").alias("intent"), "answer", F.array().cast(direct.schema["sources"].dataType).alias("sources"))
        chosen, best = self.evidence(plan)
        items = self._kept(C.by_relevance(C.excerpts(chosen, self.entries()), best))
        context, sources = C.render(items, "order"), C.sources(items, "order")
        length = F.when(F.col("detail") == "brief", LENGTHS["brief"][1]).when(F.col("detail") == "detailed", LENGTHS["detailed"][1]).otherwise(LENGTHS["normal"][1])
        prompt = F.concat(F.lit("PDF excerpts:\n\n"), "context", F.lit("\n\nQuestion: "), "text", F.lit("\n"), length)
        call = F.pandas_udf(self.generate, T.StringType())
        open_ = plan.where("direct.answer IS NULL AND intent <> 'locate'").join(context, ["doc", "query_id"]).withColumn("answer", call(prompt))
        open_ = self._kept(open_)
        cited = A.finalize_sources(open_, sources)
        listed = cited.groupBy("doc", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "i", F.col("page").cast("int").alias("page"), "text"))), lambda x: F.struct(x["page"].alias("page"), x["text"].alias("text"))).alias("sources"))
        written = open_.join(listed, ["doc", "query_id"], "left").select("doc", "turn", "intent", "answer", "sources")
        out = direct.unionByName(located).unionByName(written)
        nothing = plan.join(out.select("doc", "turn"), ["doc", "turn"], "left_anti").select("doc", "turn", "intent", F.lit(A.NOT_FOUND).alias("answer"), F.array().cast(direct.schema["sources"].dataType).alias("sources"))
        return out.unionByName(nothing)


def hashing_embedder(dimensions: int = V.DIMENSIONS):
    """Offline embedder plug-in."""
    return lambda rows, keys: V.dense(V.hash_embeddings(rows, keys, "text", dimensions), keys, dimensions)
