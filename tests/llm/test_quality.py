import re

import numpy as np
import pytest

from folioloom.llm import quality as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@pytest.mark.parametrize("text", [None, "", "\n\n \n", "a b c d e a b c d e", "a a a a a a a", "x\nx\n\n\ny\nx ", "é#ü* $%&|<>\tz\x0bq", "one two three four five six " * 3, " \n".join(["l 1 2 3 4 5"] * 4)])
def test_base_counts(text):
    assert Q.statistics(text)[:5] == plain(text)


def test_trees_are_monotonic_and_separate():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.2 * rng.random(3000) < 0.6).astype(float)
    trees = Q.fit(x, y, [-1, 0, 1])
    grid = np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.5), np.full(200, 0.5)])
    assert (np.diff(trees.score(grid)) <= 1e-12).all()
    assert (np.diff(trees.score(grid[:, [1, 2, 0]])) >= -1e-12).all()
    assert ((trees.score(x) > 0.5) == (y == 1)).mean() > 0.9


def test_trees_without_a_choice():
    assert Q.fit(np.empty((0, 2)), np.empty(0), [0, 0]).score(np.zeros((2, 2))).min() > 0.5
    assert Q.fit(np.zeros((30, 2)), np.ones(30), [0, 0]).score(np.zeros((1, 2)))[0] > 0.5


def test_query_contract(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{n}" for n in rng.integers(0, 500, 60)) + (" ### $$$ %%%" * 12 if i % 5 == 0 else "")) for i in range(400)] + [(900, None), (901, "a b"), (None, "p q r s t u v w x y z " * 4), (3, "again " + "z" * 50000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = Q.quality_rules(docs, labels).toPandas()
    assert len(got) == len(rows)
    text = {(i if i is None else int(i), plain(t)) for i, t in rows}
    assert {(None if np.isnan(r.doc_id) else int(r.doc_id), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got.itertuples()} == text
    assert ((got.n_words < 10) | (100 * got.n_repeat_words > 20 * got.n_words)).equals(got.base_failed)
    assert not (got.base_failed & got.kept).any()
    ok = got[(got.doc_id < 400) & (got.n_words > 50)]
    assert (ok.kept == (ok.doc_id % 5 != 0)).mean() > 0.95
    assert Q.quality_rules(docs.limit(0), labels.limit(0)).count() == 0
