import random

import duckdb
from pyspark.sql import functions as F

from folioloom.operators import search as S
from folioloom.operators import structure as D
from folioloom.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


def table(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").df()


def test_every_question_has_best_sentences(spark):
    got = QUERIES["best_sentence"](spark, SF).toPandas()
    ranked = QUERIES["bm25_topk"](spark, SF).toPandas()
    assert got["query_id"].nunique() > 1 and set(got["query_id"]) == set(ranked["query_id"])
    assert set(zip(ranked["query_id"], ranked["pos"])) <= set(zip(got["query_id"], got["pos"]))


def test_titles_are_not_cut(spark):
    got = QUERIES["normalize_title"](spark, SF).toPandas().set_index("doc_id")["title"]
    d = table("documents").set_index("doc_id")["text"]
    long = d[d.str.len() > 2000]
    assert len(long) and (got[long.index].str.len() > 1000).all()


def test_lines_that_share_a_word_only_do_not_run(spark, tmp_path):
    rows = [(i, f"Chapter {w}\nCopy of the owner") for i, w in enumerate(["one", "two", "three", "four"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(x) for x in QUERIES["running_lines"](spark, str(tmp_path)).collect()] == [(0, "copy of the owner")]


def test_outline_shows_three_levels(spark):
    got = QUERIES["list_outline"](spark, SF).toPandas()
    want = 0
    for n in catalog.sections(spark, SF).groupBy("doc").count().collect():
        want += min(400, n["count"])
    assert len(got) == want and got["line"].str.startswith("    - ").any()


def test_page_ends_are_running_values(spark):
    r = random.Random(9)
    rows = [(d, i, r.randint(1, 10), i // 3 + 1, r.choice([0, 50])) for d in range(3) for i in range(200)]
    out = D.page_ends(spark.createDataFrame(rows, "doc int, idx int, level int, page_start int, offset int"), F.lit(99))
    got = {(x.doc, x.idx): x.page_end for x in out.where("level <= 9").collect()}
    for d, i, level, page, _ in rows:
        if level <= 9:
            end = next((p - (o == 0) for e, j, n, p, o in rows if e == d and j > i and n <= level), 99)
            assert got[d, i] == max(page, end)
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString()  # such a frame is computed anew for each row


def test_nearest_is_the_best_of_all_hits(spark):
    r = random.Random(4)
    some = [[float(r.randint(-2, 2)) for _ in range(4)] for _ in range(150)]  # many equal vectors and values
    some += [[r.gauss(0, 1) for _ in range(4)] for _ in range(150)] + [[1.0, 2.0], [2.0, 1.0], [0.0] * 4, [], None, [1e200] * 4, [1.0, None, 2.0, 1.0]]
    v = spark.createDataFrame([(i % 2, i, e) for i, e in enumerate(some)], "doc int, pos long, embedding array<double>")
    q = v.where("pos % 5 = 0 OR pos > 298").withColumnRenamed("pos", "query_id")
    best = lambda hits: sorted(str(tuple(x)) for x in S.ranked(hits, "similarity", 3).select("doc", "query_id", "rank", "pos", "similarity").collect())  # noqa: E731, not a number equals itself as text
    near = S.nearest(v, q, 3).cache()
    assert best(near) == best(S.vector_hits(v, q)) and near.count() < S.vector_hits(v, q).count() / 4


def test_blocks_and_strips_lose_no_neighbour(spark, monkeypatch):
    for name, n in {"BLOCK": 64 * 700, "ROWS": 7, "PAIRS": 640}.items():
        monkeypatch.setattr(S, name, n)
    sf = "/root/testdata/sf0.1"
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.lit(0).alias("doc"), F.col("vec_id").alias("pos"), "embedding")
    q = v.where("pos % 100 = 0").withColumnRenamed("pos", "query_id")
    best = lambda hits: sorted(map(tuple, S.ranked(hits, "similarity", 10).select("query_id", "rank", "pos", "similarity").collect()))
    assert best(S.nearest(v, q, 10)) == best(S.vector_hits(v, q))
    assert "ArrowEval" not in (plan := QUERIES["cosine_topk"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()) and "CoGroups" in plan
