import zlib

import numpy as np

from folioloom.llm import toxicity as X


def corpus(n=1200, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "kla mor tin ves por".split() for b in "da lo mi ren su tek".split()]
    rows = []
    for i in range(n):
        bad = i % 8 == 0
        text = list(rng.choice(words, 40)) + (["vilest", "grubber"] if bad else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_held_out_accuracy_and_contract(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i // 8 % 2 == 0], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.toxic_documents(docs, labels).collect()}
    assert len(got) == len(rows) + 2
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert got[5000].score == got[5001].score and got[5000].predicted == 0


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    one = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    two = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    key = lambda df: sorted((r.doc_id, r.score) for r in df.collect())
    assert key(X.toxic_documents(docs, one)) == key(X.toxic_documents(docs, two))


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in X.toxic_documents(docs, none).collect()] == [0, 0, 0]
    assert X.toxic_documents(docs.limit(0), none).count() == 0
