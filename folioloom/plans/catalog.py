"""The engine's queries over the driver tables, each with the SQL of the same result.

``documents`` are entries of one document (position doc_id, section from source,
unit from lang) or documents of their own; ``benchmark`` is the batch of
questions; ``embeddings`` the vectors; region, nation and customer a section
tree of three levels; ``conversations`` the messages of threads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import context as C
from ..operators import lines as L
from ..operators import search as S
from ..operators import structure as D
from ..sources.shared import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def entries(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    return d.select(F.lit(0).alias("doc"), F.col("doc_id").alias("pos"), "text", F.regexp_extract("source", r"\d+", 0).cast("int").alias("section"), F.col("lang").alias("unit"), F.expr("cast(doc_id div 3 + 1 AS int)").alias("page"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.lit(0).alias("doc"), F.col("item_id").alias("query_id"), "text")


# ---- SQL building blocks

_TERMS = f"[t FOR t IN [{T.stem_sql('x')} FOR x IN {T.tokens_sql('text')}] IF NOT list_contains({T.STOP_SQL}, t)]"
_QTERMS = f"list_distinct([{T.stem_sql('x')} FOR x IN {T.tokens_sql('text')} IF NOT list_contains({T.STOP_SQL}, x) AND length(x) > 1])"
_INDEX = f"""
e AS MATERIALIZED (SELECT doc_id AS pos, lang, {_TERMS} AS terms FROM documents),
post AS MATERIALIZED (SELECT pos, term, count(*) AS tf FROM (SELECT pos, unnest(terms) AS term FROM e) GROUP BY ALL),
len AS MATERIALIZED (SELECT pos, greatest(1, len(terms)) AS length FROM e),
q0 AS MATERIALIZED (SELECT item_id AS query_id, {_QTERMS} AS terms FROM benchmark),
q AS (SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM q0),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (
  SELECT query_id, pos, sum(ln(1 + ((SELECT count(*) FROM len) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
    / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / (SELECT avg(length) FROM len)))) AS score, count(*) AS matched
  FROM q JOIN df USING (term) JOIN post USING (term) JOIN len USING (pos) {{scope}} GROUP BY ALL
)"""


def _index(scope: str = "") -> str:
    return _INDEX.replace("{scope}", scope)


_BM_TOP = "SELECT query_id, rank, pos, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) - 1 AS rank FROM bm) WHERE rank < 10"


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest([{T.stem_sql('x')} FOR x IN {T.tokens_sql('text')}]) AS term FROM documents) GROUP BY term")
def tokenize_terms(spark, sf):
    return read(spark, sf, "documents").select(F.explode(T.stems(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"SELECT query_id, array_to_string(list_sort(terms), ' ') AS terms FROM (SELECT item_id AS query_id, {_QTERMS} AS terms FROM benchmark)")
def query_terms(spark, sf):
    return questions(spark, sf).select("query_id", F.array_join(F.array_sort(T.query_terms(F.col("text"))), " ").alias("terms"))


@query(f"SELECT doc_id, {T.normalize_sql('text')} AS title FROM documents")
def normalize_title(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.normalize_title(F.col("text")).alias("title"))


@query(f"WITH {_index()} SELECT term, df, (SELECT sum(tf) FROM post p WHERE p.term = df.term)::BIGINT AS total FROM df")
def document_frequency(spark, sf):
    return S.postings(entries(spark, sf)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


@query(f"WITH {_index()} SELECT pos, term, tf FROM post")
def postings(spark, sf):
    return S.postings(entries(spark, sf)).select("pos", "term", "tf")


@query(f"WITH {_index()} SELECT pos, length FROM len")
def doc_stats(spark, sf):
    return S.entry_lengths(entries(spark, sf)).select("pos", "length")


def _bm25(spark, sf, scoped):
    e, q = entries(spark, sf), questions(spark, sf)
    scope = e.where("unit = 'en'").select("doc", "pos").join(q.select("doc", "query_id"), "doc") if scoped else None
    hits = S.bm25(S.postings(e), S.entry_lengths(e), S.query_term_rows(q), scope)
    return S.ranked(hits, "score", 10).select("query_id", "rank", "pos", F.round("score", 6).alias("score"))


@query(f"WITH {_index()} {_BM_TOP}")
def bm25_topk(spark, sf):
    return _bm25(spark, sf, False)


@query(f"WITH {_index('JOIN (SELECT pos FROM e WHERE lang = ' + chr(39) + 'en' + chr(39) + ') USING (pos)')} {_BM_TOP}")
def bm25_scoped(spark, sf):
    return _bm25(spark, sf, True)


_COS = """
SELECT query_id, rank, pos, round(similarity, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, pos) - 1 AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS pos, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity
    FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 {scope})
) WHERE rank < 10"""


def _vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.lit(0).alias("doc"), F.col("vec_id").alias("pos"), "embedding", "label")


def _cosine(spark, sf, scoped):
    v = _vectors(spark, sf)
    q = v.where("pos % 20 = 0").select("doc", F.col("pos").alias("query_id"), "embedding", "label")
    if scoped:  # only vectors of the query's label
        v, q = v.withColumn("doc", F.col("label")), q.withColumn("doc", F.col("label"))
    return S.ranked(S.nearest(v, q, 10), "similarity", 10).select("query_id", "rank", "pos", F.round("similarity", 6).alias("similarity"))


@query(_COS.format(scope=""))
def cosine_topk(spark, sf):
    return _cosine(spark, sf, False)


@query(_COS.format(scope="AND q.label = v.label"))
def cosine_scoped(spark, sf):
    return _cosine(spark, sf, True)


_HYBRID = f"""
{_index()},
lex AS (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) - 1 AS l FROM bm),
sim AS MATERIALIZED (SELECT item_id AS query_id, v.vec_id AS pos, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity
  FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings v),
vec AS (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, pos) - 1 AS v FROM sim),
f AS (SELECT query_id, pos, v, l, coalesce(1.0::DOUBLE / (61 + v), 0) + coalesce(1.0::DOUBLE / (61 + l), 0) AS score
  FROM (FROM vec WHERE v < 30) a FULL JOIN (FROM lex WHERE l < 30) b USING (query_id, pos)),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, coalesce(v, 1000000), coalesce(l, 1000000), pos) - 1 AS rank FROM f QUALIFY rank < 18),
cov AS (SELECT query_id, pos, count(*) / max(n_terms) AS coverage FROM r JOIN q USING (query_id) JOIN post USING (pos, term) GROUP BY ALL),
hits AS (SELECT query_id, rank, pos, score, similarity, coalesce(coverage, 0) AS coverage FROM r LEFT JOIN sim USING (query_id, pos) LEFT JOIN cov USING (query_id, pos) WHERE rank < 18)"""


def _hybrid(spark, sf):
    vectors = _vectors(spark, sf).select("doc", "pos", "embedding")
    q = questions(spark, sf).join(vectors.select("doc", F.col("pos").alias("query_id"), "embedding"), ["doc", "query_id"], "left")
    return S.search(entries(spark, sf), q, 6, vectors)


@query(f"WITH {_HYBRID} SELECT query_id, rank, pos, round(score, 9) AS score FROM hits")
def rrf_fusion(spark, sf):
    return _hybrid(spark, sf).select("query_id", "rank", "pos", F.round("score", 9).alias("score"))


@query(f"WITH {_HYBRID} SELECT query_id, rank, pos, round(similarity, 6) AS similarity, round(coverage, 6) AS coverage FROM hits")
def hybrid_search(spark, sf):
    return _hybrid(spark, sf).select("query_id", "rank", "pos", F.round("similarity", 6).alias("similarity"), F.round("coverage", 6).alias("coverage"))


@query(f"WITH {_HYBRID} SELECT query_id, bool_or(coverage >= 0.5 OR coalesce(similarity, -1) >= 0.3) AS evidence FROM hits GROUP BY query_id")
def has_evidence(spark, sf):
    return S.has_evidence(_hybrid(spark, sf)).select("query_id", "evidence")


@query("SELECT min(conv_id * 1000 + turn) AS query_id, text FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY text")
def search_many_dedup(spark, sf):
    c = read(spark, sf, "conversations").where("role = 'user'").select(F.lit(0).alias("doc"), F.expr("conv_id * 1000 + turn").alias("query_id"), "text")
    return S.distinct_queries(c).select("query_id", "text")


@query(
    f"SELECT i, count(*) AS n FROM (SELECT ('0x' || right(md5(unnest({_TERMS})), 3))::INT % 2048 AS i FROM documents) GROUP BY i"
)
def hash_buckets(spark, sf):
    e = entries(spark, sf).select(F.explode(T.index_terms(F.col("text"))).alias("t"))
    return e.select(V.hash_bucket(F.col("t")).alias("i")).groupBy("i").agg(F.count("*").alias("n"))


@query(
    f"""WITH b AS (SELECT doc_id, ('0x' || right(md5(unnest({_TERMS})), 3))::INT % 2048 AS i FROM documents),
c AS (SELECT doc_id, i, count(*)::DOUBLE AS n FROM b GROUP BY ALL),
t AS (SELECT doc_id, sqrt(sum(n * n)) AS total FROM c GROUP BY doc_id)
SELECT doc_id, i, round(n / total, 6) AS w FROM c JOIN t USING (doc_id)"""
)
def hash_embedding(spark, sf):
    return V.hash_embeddings(read(spark, sf, "documents"), ["doc_id"]).select("doc_id", "i", F.round("w", 6).alias("w"))


# ---- lines

_LINES = """ln AS (SELECT doc_id AS doc, u.n, u.text, (u.n // 40 + 1)::INT AS page FROM (
  SELECT doc_id, unnest([{'n': i - 1, 'text': p[i]} FOR i IN range(1, len(p) + 1)]) AS u FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))"""


def _lines(spark, sf):
    return L.text_lines(read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"))


@query(f"WITH {_LINES} SELECT doc, n, page, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM ln")
def line_offsets(spark, sf):
    return _lines(spark, sf).select("doc", "n", "page", "offset")


_KEY = f"trim(regexp_replace({T.fold_sql('text')}, '\\d+', '#', 'g'))"


@query(
    f"""WITH ln AS (SELECT doc_id // 10 AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS text FROM documents),
p AS (SELECT doc, count(DISTINCT page) AS n_pages FROM ln GROUP BY doc),
k AS (SELECT doc, {_KEY} AS key, count(DISTINCT page) AS on_pages FROM ln GROUP BY ALL)
SELECT doc, key FROM k JOIN p USING (doc) WHERE on_pages >= greatest(3, floor(n_pages * 0.4))"""
)
def running_lines(spark, sf):
    d = read(spark, sf, "documents").select(F.expr("doc_id div 10").alias("doc"), F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("text"))
    return L.running_keys(d, F.lit(True))


@query(
    f"""WITH {_LINES}, w AS (SELECT doc, length(text) AS size, sum(length(text)) AS chars, min(n) AS first FROM ln WHERE length(text) > 0 GROUP BY ALL)
SELECT doc, size AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY chars DESC, first) AS r FROM w) WHERE r = 1"""
)
def weighted_mode_line_length(spark, sf):
    rows = _lines(spark, sf).select("doc", F.lit(0).alias("page"), F.col("n").alias("seq"), "text", F.length("text").alias("size"), F.lit(False).alias("is_table"))
    return L.body_size(rows)


@query(
    f"""WITH {_LINES}, v AS (SELECT doc, list_sort(list(length(text))) AS v FROM ln GROUP BY doc)
SELECT doc, v[len(v) // 2 + 1] AS median, CASE WHEN len(v) > 3 THEN v[floor(len(v) * 0.9)::INT + 1] ELSE v[len(v)] END AS p90 FROM v"""
)
def order_statistics(spark, sf):
    v = _lines(spark, sf).groupBy("doc").agg(F.collect_list(F.length("text")).alias("v"))
    return v.select("doc", L.upper_median(F.col("v")).alias("median"), L.nearest_rank(F.col("v"), 0.9).alias("p90"))


@query(
    f"""WITH {_LINES}, m AS (SELECT *, n - row_number() OVER (PARTITION BY doc, page ORDER BY n) AS t FROM ln WHERE contains(text, ' | '))
SELECT doc, page, min(n) AS first, max(n) AS last, count(*) AS n_rows FROM m GROUP BY doc, page, t HAVING count(*) >= 2"""
)
def table_row_islands(spark, sf):
    return L.islands(_lines(spark, sf), F.contains("text", F.lit(" | "))).select("doc", "page", "first", "last", "n_rows")


@query(
    f"""WITH {_LINES} SELECT doc, page, count(*) AS n, count(*) FILTER (regexp_matches(text, '{L.ENDS_WITH_PAGE}')) AS hits,
bool_or(regexp_matches(text, '{L.CONTENTS_TITLE}')) AS titled FROM ln GROUP BY doc, page"""
)
def contents_page_score(spark, sf):
    return _lines(spark, sf).groupBy("doc", "page").agg(
        F.count("*").alias("n"), F.sum(L.ends_with_page(F.col("text")).cast("int")).cast("long").alias("hits"), F.bool_or(F.col("text").rlike(L.CONTENTS_TITLE)).alias("titled")
    )


#: Headings stand in for titles: the first three words of a line, on the page of the line.
_HEADS = f"""{_LINES}, o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM ln),
h AS (SELECT (doc % 50)::BIGINT AS doc, (doc // 50 + page)::INT AS page, "offset" * 100000 + doc AS "offset", regexp_extract(text, '^[^ ]+ [^ ]+') AS title FROM o WHERE regexp_matches(text, '^[^ ]+ [^ ]+'))"""


def _heads(spark, sf):
    rows = _lines(spark, sf).withColumn("title", F.regexp_extract("text", "^[^ ]+ [^ ]+", 0)).where("title <> ''")
    return rows.select((F.col("doc") % 50).alias("doc"), F.expr("cast(doc div 50 + page AS int)").alias("page"), (F.col("offset") * 100000 + F.col("doc")).alias("offset"), "title")


@query(
    f"""WITH {_HEADS}, s AS (SELECT *, lag(page) OVER w = page AND lag({T.fold_sql('title')}) OVER w = {T.fold_sql('title')} AS same FROM h WINDOW w AS (PARTITION BY doc ORDER BY page, "offset"))
SELECT doc, page, "offset", title FROM s WHERE NOT coalesce(same, false)"""
)
def outline_dedupe(spark, sf):
    return L.dedupe_outline(_heads(spark, sf))


@query(
    f"""WITH {_HEADS}, c AS (SELECT *, count(*) OVER (PARTITION BY doc, page) AS crowd FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, {T.fold_sql('title')} ORDER BY crowd, page, "offset") AS r FROM c),
k AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM r WHERE r = 1)
SELECT doc, page, "offset", title FROM k WHERE n >= 2"""
)
def outline_least_crowded(spark, sf):
    return L.least_crowded(_heads(spark, sf))


@query(
    f"""WITH {_HEADS}, k AS (SELECT doc, page, "offset", left(title, 1) AS kind, right(title, 2) AS number, title AS text FROM h),
c AS (SELECT *, count(*) OVER (PARTITION BY doc, page) > 3 AS crowded FROM k)
SELECT doc, page, "offset", kind, number, text FROM (SELECT *, row_number() OVER (PARTITION BY doc, kind, {T.fold_sql('number')} ORDER BY crowded, page, "offset") AS r FROM c) WHERE r = 1"""
)
def caption_dedupe(spark, sf):
    rows = _heads(spark, sf).select("doc", "page", "offset", F.substring("title", 1, 1).alias("kind"), F.right("title", F.lit(2)).alias("number"), F.col("title").alias("text"))
    return L.dedupe_captions(rows)


@query("SELECT p_brand AS doc, p_partkey, least(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC), 4)::INT AS level FROM part")
def font_levels(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_brand").alias("doc"), "p_partkey", F.col("p_size").alias("size"))
    return L.font_levels(p).select("doc", "p_partkey", "level")


@query(
    """SELECT page_id, i AS n, tag, text FROM (SELECT page_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS tag, unnest(x) AS text FROM (
  SELECT page_id, regexp_extract_all(html, '<(h1|h2|h3)[^>]*>([^<]*)<', 1) AS t, regexp_extract_all(html, '<(h1|h2|h3)[^>]*>([^<]*)<', 2) AS x FROM pages))"""
)
def html_headings(spark, sf):
    pattern = F.lit("<(h1|h2|h3)[^>]*>([^<]*)<")
    both = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("tag"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("text"))
    return read(spark, sf, "pages").select("page_id", F.posexplode(both).alias("i", "x")).select("page_id", (F.col("i") + 1).alias("n"), "x.tag", "x.text")


# ---- section trees

_TREE = """sec AS (
  SELECT r_regionkey AS doc, k1, k2, k3, level, title, noun, (row_number() OVER (PARTITION BY r_regionkey ORDER BY k1, k2, k3) - 1)::INT AS idx, field FROM (
    SELECT r_regionkey, 0 AS k1, -1::BIGINT AS k2, -1::BIGINT AS k3, 1 AS level, r_name AS title, 'part' AS noun, NULL AS field FROM region
    UNION ALL SELECT n_regionkey, 1, n_nationkey, -1, 2, n_name, CASE WHEN n_nationkey % 5 = 4 THEN 'annex' ELSE 'chapter' END, NULL FROM nation
    UNION ALL SELECT n_regionkey, 1, n_nationkey, c_custkey, 3, c_name, NULL, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)
), pg AS (SELECT *, (idx // 4 + 1)::INT AS page_start, (idx % 4 * 100)::INT AS "offset" FROM sec)"""


def sections(spark, sf):
    """region, nation and customer as a tree: four headings a page."""
    r, n, c = (read(spark, sf, t) for t in ("region", "nation", "customer"))
    no = F.lit(None).cast("string")
    top = r.select(F.col("r_regionkey").alias("doc"), F.lit(0).alias("k1"), F.lit(-1).cast("long").alias("k2"), F.lit(-1).cast("long").alias("k3"), F.lit(1).alias("level"), F.col("r_name").alias("title"), F.lit("part").alias("noun"), no.alias("field"))
    mid = n.select(F.col("n_regionkey").alias("doc"), F.lit(1).alias("k1"), F.col("n_nationkey").cast("long").alias("k2"), F.lit(-1).cast("long").alias("k3"), F.lit(2).alias("level"), F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 5 == 4, "annex").otherwise("chapter").alias("noun"), no.alias("field"))
    low = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_regionkey").alias("doc"), F.lit(1).alias("k1"), F.col("n_nationkey").cast("long").alias("k2"), F.col("c_custkey").alias("k3"), F.lit(3).alias("level"), F.col("c_name").alias("title"), no.alias("noun"), F.col("c_mktsegment").alias("field"))
    rows = top.unionByName(mid).unionByName(low).withColumn("idx", F.row_number().over(Window.partitionBy("doc").orderBy("k1", "k2", "k3")) - 1)
    return rows.select(
        "doc", "idx", "level", "title", "noun", F.lit(False).alias("matter"), (F.floor(F.col("idx") / 4) + 1).cast("int").alias("page_start"), (F.col("idx") % 4 * 100).alias("offset"),
        F.when(F.col("field").isNotNull(), F.create_map(F.lit("segment"), F.col("field"))).otherwise(F.create_map().cast("map<string,string>")).alias("fields"), F.col("k2").alias("number"), F.lit(10000).alias("last_page"),
    )


_PARENT = f"{_TREE}, par AS (SELECT *, (SELECT max(b.idx) FROM pg b WHERE b.doc = a.doc AND b.idx < a.idx AND b.level < a.level) AS parent FROM pg a)"
_CLOSURE = f"{_PARENT}, clo AS (SELECT doc, idx AS anc, idx AS \"desc\", 0 AS depth FROM par UNION ALL SELECT clo.doc, par.parent, clo.\"desc\", depth + 1 FROM clo JOIN par ON par.doc = clo.doc AND par.idx = clo.anc WHERE par.parent IS NOT NULL)"


@query(f"WITH {_PARENT} SELECT doc, idx, level, title, parent FROM par")
def section_tree(spark, sf):
    return D.parents(sections(spark, sf)).select("doc", "idx", "level", "title", "parent")


@query(
    f"""WITH {_TREE}, nx AS (SELECT a.doc, a.idx, min(b.idx) AS nxt FROM pg a LEFT JOIN pg b ON b.doc = a.doc AND b.idx > a.idx AND b.level <= a.level GROUP BY ALL)
SELECT a.doc, a.idx, a.page_start, greatest(a.page_start, coalesce(b.page_start - CASE WHEN b."offset" = 0 THEN 1 ELSE 0 END, 10000)) AS page_end
FROM pg a JOIN nx ON nx.doc = a.doc AND nx.idx = a.idx LEFT JOIN pg b ON b.doc = a.doc AND b.idx = nx.nxt"""
)
def page_end(spark, sf):
    return D.page_ends(sections(spark, sf)).select("doc", "idx", "page_start", "page_end")


@query(f"WITH RECURSIVE {_CLOSURE} SELECT doc, anc, \"desc\", depth FROM clo")
def descendants(spark, sf):
    return D.closure(D.parents(sections(spark, sf)), 4)


@query(
    f"""WITH RECURSIVE {_CLOSURE} SELECT c.doc, c."desc" AS idx, string_agg(p.title, ' > ' ORDER BY depth DESC) AS section_path FROM clo c JOIN par p ON p.doc = c.doc AND p.idx = c.anc GROUP BY ALL"""
)
def section_path(spark, sf):
    return D.paths(D.parents(sections(spark, sf)), 4)


@query(
    f"""WITH RECURSIVE {_CLOSURE} SELECT p.doc, p.idx, (SELECT count(*) FROM par c WHERE c.doc = p.doc AND c.parent = p.idx) AS n_children,
(SELECT count(*) FROM clo c WHERE c.doc = p.doc AND c.anc = p.idx AND depth > 0) AS n_descendants FROM par p"""
)
def children_count(spark, sf):
    return D.children_counts(D.parents(sections(spark, sf)))


_UNITS = f"""{_TREE}, lv AS (SELECT doc, level, count(*) FILTER (noun = 'chapter') AS chapters, count(*) AS plain FROM pg GROUP BY ALL),
ul AS (SELECT doc, arg_min(level, (CASE WHEN chapters >= 2 THEN 0 WHEN plain >= 2 THEN 1 ELSE 2 END) * 100 + level) AS unit_level FROM lv GROUP BY doc),
un AS (SELECT pg.*, unit_level, row_number() OVER (PARTITION BY doc ORDER BY idx) AS ordinal FROM pg JOIN ul USING (doc) WHERE level = unit_level)"""


@query(f"WITH {_UNITS} SELECT doc, unit_level FROM ul")
def unit_level(spark, sf):
    return D.unit_level(sections(spark, sf))


@query(f"WITH {_UNITS} SELECT doc, idx, title, ordinal FROM un")
def unit_ordinals(spark, sf):
    return D.units(sections(spark, sf)).select("doc", "idx", "title", F.col("ordinal").cast("long").alias("ordinal"))


@query(
    f"""WITH {_UNITS}, n AS (SELECT doc, noun, count(*) AS n, min(idx) AS first FROM un WHERE noun NOT IN ('annex', 'appendix', 'schedule') GROUP BY ALL),
t AS (SELECT doc, count(*) AS total FROM un WHERE noun IS NULL OR noun NOT IN ('annex', 'appendix', 'schedule') GROUP BY doc)
SELECT doc, arg_max(noun, n * 100000 - first) AS unit_noun FROM n JOIN t USING (doc) GROUP BY doc HAVING max(n) * 2 >= any_value(total)"""
)
def unit_noun(spark, sf):
    return D.unit_noun(D.units(sections(spark, sf)))


_LEAVES = f"{_TREE}, un AS (SELECT * FROM pg WHERE level = 3)"


@query(f"WITH {_LEAVES} SELECT doc, 'segment' AS key, count(*) AS n FROM un GROUP BY doc")
def common_fields(spark, sf):
    return D.common_fields(sections(spark, sf).where("level = 3"))


@query(f"WITH {_LEAVES} SELECT doc, 'segment' AS key, field AS value, count(*) AS n FROM un GROUP BY ALL")
def field_histogram(spark, sf):
    return D.field_histogram(sections(spark, sf).where("level = 3"))


@query(f"WITH {_LEAVES} SELECT doc, count(*) AS n FROM un WHERE lower(field) = 'building' GROUP BY doc")
def field_filter_count(spark, sf):
    rows = sections(spark, sf).where("level = 3").where(F.lower(F.try_element_at("fields", F.lit("segment"))) == "building")
    return rows.groupBy("doc").agg(F.count("*").alias("n"))


@query(f"WITH {_TREE} SELECT doc, level, count(*) AS n FROM pg GROUP BY ROLLUP(doc, level) HAVING doc IS NOT NULL")
def level_histogram(spark, sf):
    return D.level_histogram(sections(spark, sf))


@query(
    f"""WITH {_TREE}, tp AS (SELECT *, min(level) OVER (PARTITION BY doc) AS top FROM pg)
SELECT doc, idx, repeat('  ', level - top) || '- ' || title || ' [Page ' || page_start || ']' AS line
FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY idx) AS r FROM tp WHERE level < top + 3) WHERE r <= 400"""
)
def list_outline(spark, sf):
    """The three levels that an outline answer shows, 400 lines of a document at most."""
    rows = sections(spark, sf).withColumn("top", F.min("level").over(Window.partitionBy("doc"))).where("level < top + 3")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy("idx"))).where("r <= 400")
    return rows.select("doc", "idx", F.concat(F.expr("repeat('  ', level - top)"), F.lit("- "), "title", F.lit(" ["), D.pages_text(F.col("page_start"), F.col("page_start")), F.lit("]")).alias("line"))


def _spans(spark, sf):
    o = read(spark, sf, "orders")
    return o.select(
        F.lit(0).alias("doc"), F.col("o_orderkey").cast("long").alias("idx"), F.col("o_orderpriority").alias("noun"), (F.col("o_custkey") % 1000).alias("number"), F.lit(0).alias("page_start"), F.floor(F.col("o_totalprice") / 50000).cast("int").alias("page_end")
    )


_SPANS = "s AS (SELECT o_orderkey AS idx, o_orderpriority AS noun, o_custkey % 1000 AS number, floor(o_totalprice / 50000)::INT AS span FROM orders)"


@query(f"WITH {_SPANS} SELECT noun, number, idx FROM (SELECT *, row_number() OVER (PARTITION BY noun, number ORDER BY span DESC, idx) AS r FROM s) WHERE r = 1")
def labelled_longest(spark, sf):
    return D.longest_labelled(_spans(spark, sf), False).select("noun", "number", "idx")


@query(f"WITH {_SPANS} SELECT noun, number, idx FROM (SELECT *, row_number() OVER (PARTITION BY noun, number ORDER BY span DESC, idx DESC) AS r FROM s) WHERE r = 1")
def resolve_longest(spark, sf):
    return D.longest_labelled(_spans(spark, sf), True).select("noun", "number", "idx")


@query(
    """WITH s AS (SELECT o_custkey % 10 AS doc, o_orderkey AS idx, epoch(o_orderdate)::BIGINT AS page FROM orders),
i AS (SELECT event_id, user_id % 10 AS doc, epoch(ts)::BIGINT AS page FROM events),
m AS (SELECT doc, page, max(idx) AS idx FROM s GROUP BY ALL)
SELECT event_id, coalesce(m.idx, -1) AS section FROM i ASOF LEFT JOIN m ON i.doc = m.doc AND i.page >= m.page"""
)
def caption_asof(spark, sf):
    s = read(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("doc"), F.col("o_orderkey").alias("idx"), F.unix_timestamp("o_orderdate").alias("page_start"), F.lit(0).alias("offset"))
    i = read(spark, sf, "events").select("event_id", (F.col("user_id") % 10).alias("doc"), F.unix_timestamp("ts").alias("page"), F.lit(0).alias("offset"))
    return D.place(i, s).select("event_id", "section")


@query(
    """WITH u AS (SELECT n_regionkey AS doc, n_nationkey AS idx, n_nationkey * 3 AS a, n_nationkey * 3 + 7 AS b FROM nation)
SELECT p.doc, p.page, u.idx FROM (SELECT DISTINCT (user_id % 5)::INT AS doc, (event_id % 80)::INT AS page FROM events) p JOIN u ON u.doc = p.doc AND p.page BETWEEN a AND b"""
)
def page_unit_range_join(spark, sf):
    u = read(spark, sf, "nation").select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").alias("idx"), (F.col("n_nationkey") * 3).alias("page_start"), (F.col("n_nationkey") * 3 + 7).alias("page_end"))
    p = read(spark, sf, "events").select((F.col("user_id") % 5).cast("int").alias("doc"), (F.col("event_id") % 80).cast("int").alias("page")).distinct()
    return D.units_on_pages(u, p)


@query("SELECT b.doc, n.number::INT AS number FROM (SELECT DISTINCT p_brand AS doc FROM part) b, (SELECT unnest(range(1, 301)) AS number) n EXCEPT SELECT p_brand, (p_partkey % 400)::INT FROM part")
def missing_numbers(spark, sf):
    return D.missing_numbers(read(spark, sf, "part").select(F.col("p_brand").alias("doc"), (F.col("p_partkey") % 400).alias("number")), 1, 300)


@query(
    f"""SELECT p_partkey, array_to_string([r FOR r IN [{", ".join(f"CASE WHEN regexp_matches(n, ' ({w}) ') THEN '{r}' END" for r, w in D.ROLES.items())}] IF r IS NOT NULL], ',') AS roles
FROM (SELECT p_partkey, ' ' || {T.normalize_sql("p_name || ' ' || (['scope', 'Key Findings', 'budget plan', 'next steps', 'risks'])[p_partkey % 5 + 1]")} || ' ' AS n FROM part)"""
)
def role_tags(spark, sf):
    title = F.concat("p_name", F.lit(" "), F.element_at(F.array(*[F.lit(x) for x in ("scope", "Key Findings", "budget plan", "next steps", "risks")]), (F.col("p_partkey") % 5 + 1).cast("int")))
    return read(spark, sf, "part").select("p_partkey", F.array_join(D.role_tags(T.normalize_title(title)), ",").alias("roles"))


# ---- context

_CHOSEN = f"{_index()}, ch AS (SELECT query_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) - 1 AS rank FROM bm) WHERE rank < 30)"


def _chosen(spark, sf, keep=30):
    e, q = entries(spark, sf), questions(spark, sf)
    return S.ranked(S.bm25(S.postings(e), S.entry_lengths(e), S.query_term_rows(q)), "score", keep)


@query(
    f"""WITH {_CHOSEN}, w AS (SELECT query_id, pos, lang, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(lang) OVER w = lang THEN 0 ELSE 1 END AS new
FROM ch JOIN e USING (pos) WINDOW w AS (PARTITION BY query_id ORDER BY pos))
SELECT query_id, pos, (sum(new) OVER (PARTITION BY query_id ORDER BY pos))::BIGINT AS run FROM w"""
)
def excerpt_runs(spark, sf):
    e = entries(spark, sf).withColumn("section", F.col("unit"))
    return C.runs(_chosen(spark, sf), e).select("query_id", "pos", "run")


@query(
    f"""WITH {_CHOSEN}, l AS (SELECT query_id % 8 AS query_id, query_id // 8 AS list, rank, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) - 1 AS rank FROM bm) WHERE rank < 5),
f AS (SELECT query_id, pos, min(rank * 1000 + list) AS o FROM l GROUP BY ALL)
SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY o, pos) - 1 AS "order" FROM f"""
)
def interleave_lists(spark, sf):
    lists = _chosen(spark, sf).select("doc", (F.col("query_id") % 8).alias("query_id"), F.expr("query_id div 8").alias("list"), "rank", "pos")
    return C.interleave(lists, 5).select("query_id", "pos", "order")


@query(
    f"""WITH {_CHOSEN}, l AS (SELECT query_id % 8 AS query_id, query_id // 8 AS list, rank, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) - 1 AS rank FROM bm) WHERE rank < 30)
SELECT query_id, pos, arg_min(list, rank * 1000 + list) AS list FROM l GROUP BY ALL"""
)
def entity_owner(spark, sf):
    lists = _chosen(spark, sf).select("doc", (F.col("query_id") % 8).alias("query_id"), F.expr("query_id div 8").alias("list"), "rank", "pos")
    return C.owners(lists).select("query_id", "pos", "list")


@query()
def budgeted_round_robin(spark, sf):
    return C.budgeted(_chosen(spark, sf), entries(spark, sf), 14_000).select("query_id", "pos")


@query()
def expand_hits(spark, sf):
    return C.expand(_chosen(spark, sf, 18), entries(spark, sf), 14_000, 18, 7_000).select("query_id", "pos")


@query()
def rendered_context(spark, sf):
    e = entries(spark, sf).withColumns({"start": F.lit(0), "end": F.lit(0), "section_path": F.concat(F.lit("section "), "section"), "table_header": F.lit("")})
    return C.render(C.excerpts(_chosen(spark, sf, 6), e)).select("query_id", "context")


@query(
    f"""WITH {_index()}, s AS (SELECT query_id, pos, score, (regexp_extract(source, '\\d+'))::INT AS section FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS r FROM bm) JOIN documents ON doc_id = pos WHERE r <= 36),
g AS (SELECT query_id, section, sum(score) AS weight FROM s GROUP BY ALL)
SELECT query_id, section, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 9) DESC, section) AS r FROM g) WHERE r <= 6"""
)
def locate_sections(spark, sf):
    hits = _chosen(spark, sf, 36).join(entries(spark, sf).select("doc", "pos", "section"), ["doc", "pos"])
    groups = hits.groupBy("query_id", "section").agg(F.sum("score").alias("weight"))
    w = Window.partitionBy("query_id").orderBy(F.round("weight", 9).desc(), "section")
    return groups.withColumn("r", F.row_number().over(w)).where("r <= 6").select("query_id", "section", F.round("weight", 6).alias("weight"))


_BEST_OF_HITS = f"""WITH {_CHOSEN},
p AS (SELECT query_id, pos, q0.terms, [trim(x) FOR x IN string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') IF length(trim(x)) > 20] AS s, text
  FROM ch JOIN documents ON doc_id = pos JOIN q0 USING (query_id)),
u AS (SELECT query_id, pos, terms, unnest(s) AS sentence, unnest(range(len(s))) AS i FROM p),
r AS (SELECT query_id, pos, sentence, row_number() OVER (PARTITION BY query_id, pos ORDER BY
  (regexp_matches(sentence, '^\\d{{1,3}}\\s') OR contains(sentence, 'http') OR regexp_matches(sentence, '\\b(19|20)\\d\\d\\.$'))::INT,
  len(list_intersect(list_distinct([{T.stem_sql('x')} FOR x IN {T.tokens_sql('sentence')}]), terms)) DESC, abs(length(sentence) - 160), i) AS r FROM u)
SELECT query_id, pos, CASE WHEN sentence IS NULL THEN left(text, 240) WHEN length(sentence) <= 240 THEN sentence ELSE regexp_replace(left(sentence, 240), '\\s\\S*$', '') || '…' END AS sentence
FROM p LEFT JOIN (FROM r WHERE r = 1) USING (query_id, pos)"""


@query(_BEST_OF_HITS)
def best_sentence(spark, sf):
    """The sentence to quote of each question's top hits."""
    terms = questions(spark, sf).select("query_id", T.query_terms(F.col("text")).alias("terms"))
    hits = _chosen(spark, sf).join(entries(spark, sf).select("doc", "pos", "text"), ["doc", "pos"]).join(terms, "query_id")
    return hits.select("query_id", "pos", T.best_sentence(F.col("text"), F.col("terms")).alias("sentence"))


# ---- conversations


@query(
    """SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, left(text, 500) AS question, left(nt, 700) AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM (
  SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant') WHERE r <= 2"""
)
def history_pairs(spark, sf):
    from ..operators.answers import history

    m = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), "turn", "role", F.col("text").alias("content"))
    return history(m).select(F.col("doc").alias("conv_id"), "turn", "question", "answer")


@query("SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WHERE role = 'user'")
def previous_question(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.lag("text").over(w).alias("previous"))


@query(
    """SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS key FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)"""
)
def metadata_json(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return e.select("event_id", "key", "value")


# ---- whole steps of the engine, on lines made from the driver tables


def laid_out(spark, sf):
    """``pages`` as laid-out lines: block elements in reading order, headings larger, ten pages to a document."""
    from ..sources.readers import html_lines

    return html_lines(read(spark, sf, "pages"), F.expr("page_id div 10"), F.expr("page_id % 10 + 1"))


def _paragraphs(spark, sf):
    from ..operators import layout as Y

    return Y.paragraphs(Y.table_rows(laid_out(spark, sf)))


@query()
def layout_paragraphs(spark, sf):
    return _paragraphs(spark, sf).select("doc", "page", "n", "offset", "text", "heading")


def _document_sections(spark, sf):
    from ..operators import layout as Y
    from ..operators import outline as O
    from ..operators import sections as N

    par = settled(_paragraphs(spark, sf), "paragraphs")  # read by the page texts, the headings and the outline
    pages = settled(Y.page_text(par), "pages")
    return pages, settled(N.sections(O.outline(pages, Y.headings(par)), pages), "sections")


@query()
def structure_sections(spark, sf):
    return _document_sections(spark, sf)[1].select("doc", "idx", "title", "name", "level", "page_start", "page_end", "parent", "number", "roles", "ordinal", "unit_noun")


@query()
def chunks(spark, sf):
    """Chunks of all laid-out documents, cut at the borders of their sections, and of whole documents of one page each."""
    from ..operators import layout as Y

    laid, sections = _document_sections(spark, sf)
    plain = read(spark, sf, "documents").select(F.concat(F.lit("text-"), F.col("doc_id").cast("string")).alias("doc"), F.lit(1).alias("page"), "text")
    pages = laid.select(F.col("doc").cast("string").alias("doc"), F.col("page").cast("int").alias("page"), "text").unionByName(plain)
    return Y.chunks(pages, sections.select("doc", "page_start", "offset", "idx")).select("doc", "pos", "id", "start", "end", "text")


@query()
def route_intents(spark, sf):
    """Routes of all user turns; each thread is about the document whose number its own gives, with its sections."""
    from ..operators import routing as R

    asked = read(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").cast("string").alias("doc"), "turn", "text")
    _, sections = _document_sections(spark, sf)
    return R.route_questions(asked, sections).select(F.col("doc").cast("long").alias("conv_id"), "turn", "intent", "mode", "detail")


@query()
def filtered_answers(spark, sf):
    """All assistant turns through the plain-text filter and the loop guard, word by word."""
    from ..streaming.filters import filtered

    t = read(spark, sf, "conversations").where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), F.posexplode(F.split("text", "(?<= )")).alias("seq", "token"))
    return filtered(t)


@query(
    """WITH s AS (SELECT conv_id, turn, 'Said on [Page ' || (turn + 1) || '] and [Pages ' || (turn + 3) || '–' || (turn + 5) || '].' AS answer, turn FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, unnest([turn + 1, turn + 3, turn + 4, turn + 5])::INT AS page FROM s"""
)
def cited_pages(spark, sf):
    from ..operators.answers import cited_pages as cited

    s = read(spark, sf, "conversations").where("role = 'assistant'")
    said = F.concat(F.lit("Said on [Page "), F.col("turn") + 1, F.lit("] and [Pages "), F.col("turn") + 3, F.lit("–"), F.col("turn") + 5, F.lit("]."))
    return s.select("conv_id", "turn", F.explode(cited(said)).alias("page"))
