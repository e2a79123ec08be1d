"""Edges of the pipeline's stages: clashing names, null and repeated ids, null and empty texts, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioloom.llm import decontaminate

CLASHES = ["spans", "base", "added", "key", "row", "told", "score", "_score", "kept", "_kept", "node", "_node", "part", "item", "fp", "id", "bad", "copies", "term", "root"]
WORDS = "the quick brown fox jumps over the lazy dog and then it sleeps in the warm sun until the evening comes again".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("sf"))
    texts = [" ".join(WORDS[i % 7 :] + WORDS[: i % 7] + [f"w{i // 2}"] * (i % 3)) for i in range(30)] + [None, "", " ", "x" * 50_000, "call +49 170 1234567 or a@b.example now"]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)] + [(None, texts[0], "en", "web", 3), (None, "no id here at all my friend", "en", "web", 3), (4, texts[4], "de", "b", 9), (4, "another text of one id and more", "de", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 1)) for i in range(24)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    spark.createDataFrame([(1, " ".join(WORDS[:12])), (None, None)], "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return to


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_edges(spark, tables, name, stage):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    plain = stage(spark, docs, tables)
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in plain.select("doc_id").collect())
    wide = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    out = stage(spark, wide, tables)
    rows = out.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == kept
    if name != "bpe":
        assert plain.columns == docs.columns and out.columns == wide.columns
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    assert stage(spark, docs.limit(0), tables).count() == 0


def test_pipeline_runs_whole_and_on_an_empty_table(spark, tables, tmp_path):
    assert corpus_pipeline.run(spark, tables).count() > 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clean_is_one_by_both_ways(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    bench = spark.read.parquet(f"{tables}/benchmark.parquet")
    told = [sorted(map(str, decontaminate.clean(docs, bench, max_chars=n).collect())) for n in (10**9, 0)]
    assert told[0] == told[1] and 0 < len(told[0]) < docs.count()
