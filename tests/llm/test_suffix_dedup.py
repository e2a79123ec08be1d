import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from folioloom.llm import suffix_dedup as S


def brute(docs, length=400):
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                cover[p : p + length] = 1
        cover = cover[: len(b)]
        out.append((i, len(b), int(cover.sum()), int((np.diff(np.r_[0, cover, 0]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[cover == 0])).hexdigest()))
    return out


def documents():
    r = random.Random(1)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    docs = [(i, words(r.randint(0, 200))) for i in range(30)]
    passages = [words(70), words(85), words(200), words(110)]
    docs += [(i, f"{words(r.randint(0, 60))} {r.choice(passages)} {words(r.randint(0, 60))}") for i in range(30, 110)]
    base = words(400).split(" ")
    for i in range(110, 150):
        text = list(base)
        for _ in range(r.randint(0, 5)):
            text[r.randrange(len(text))] = words(1)
        docs.append((i, " ".join(text)))
    for i in range(150, 190):
        a = r.randint(0, 400)
        docs.append((i, words(r.randint(0, 8)) + passages[2][a : a + r.randint(395, 430)] + words(r.randint(0, 8))))
    docs += [(400, None), (401, ""), (402, "a" * 3000), (403, "ab" * 700), (404, "a" * 399), (405, "b" * 400), (408, "b" * 400), (406, docs[3][1] * 3), (3, docs[3][1]), (3, docs[3][1]), (407, "é" * 300 + "x" + "é" * 201)]
    return docs


@pytest.mark.parametrize("hot", [2000, 5, 1])
def test_against_brute_force(spark, hot):
    docs = documents()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, id int, th int")
    assert sorted(map(tuple, S.repeats(df, hot).collect())) == sorted(brute(docs))


def test_long_texts_are_cut_into_stretches_without_loss(monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 700)
    text = documents()[115][1].encode()
    rows = [g for g in S.text_anchors([text, b"x" * 10, text[5:]])]
    windows = Counter()
    for doc, a, lo, hi, *_ in rows:
        for d, p, q, at in zip(doc, lo, hi, a):
            assert all(p0 <= at <= p0 + 400 - 64 for p0 in (p, q))
            windows.update((int(d), w) for w in range(p, q + 1))
    assert windows == Counter({(0, w): 1 for w in range(len(text) - 399)} | {(2, w): 1 for w in range(len(text) - 404)})


def test_merge_sorts_and_gives_common_prefixes():
    r = random.Random(4)
    runs = [[bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 30))] for _ in range(7)]
    packed = [S.pack_run([S.Entry(s, b"", (0, 0, i), 0) for i, s in enumerate(run)]) for run in runs]
    out = list(S.merge_runs([S.unpack_run(p) for p in packed]))
    suffixes = [e.suffix for e in out]
    assert suffixes == sorted(s for run in runs for s in run)
    assert all(e.lcp == S.common_prefix(a.suffix, e.suffix) for a, e in zip(out, out[1:]))


def test_empty_table_and_null_ids(spark):
    assert S.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = S.repeats(spark.createDataFrame([(None, "q" * 450), (None, "z")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in rows) == [(None, 1, 0), (None, 450, 450)]
