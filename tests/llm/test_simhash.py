import numpy as np
import pytest
import xxhash

from folioloom.llm import simhash as S


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one TWO", "a b c", "a b c a b c a b c", "É é Straße ok ok ok", "x " * 20000])
def test_fingerprint_is_the_majority_of_bits(text):
    assert S.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("free", [(1 << 64) - 1, 0x0F0F00FF, 0xFFF])
def test_masks_cover_all_sets_of_three_bits(free):
    bits = [i for i in range(64) if free >> i & 1]
    masks = S.covering_masks(free)
    rng = np.random.default_rng(0)
    for _ in range(2000):
        flipped = sum(1 << int(b) for b in rng.choice(bits, size=min(3, len(bits)), replace=False))
        assert any(not flipped & m for m in masks)


def classes(fps, ids):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = ids.copy()
    while True:
        new = np.where(near, label[None, :], ids.max() + 1).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    base = [list(rng.choice(words, 60)) for _ in range(20)]
    rows = []
    for i in range(200):
        text = list(base[i % 20])
        for _ in range(i % 3):
            text[rng.integers(60)] = str(rng.choice(words))
        rows.append((i, " ".join(text)))
    rows += [(500, None), (501, ""), (502, " \n "), (3, rows[3][1]), (600, "x")]
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = S.near_duplicates(docs).toPandas()
    assert len(got) == len(rows)
    fps = np.array([int(x, 16) for x in got["fingerprint"]], np.uint64)
    assert (classes(fps, got["doc_id"].to_numpy()) == got["component_id"].to_numpy()).all()
    by_id = dict(rows)
    assert all(int(f, 16) == plain_fingerprint(by_id[i]) for i, f in zip(got["doc_id"], got["fingerprint"]))


def test_full_buckets_are_dealt_again_without_loss(spark):
    fps = np.r_[np.arange(0, 1500, dtype=np.int64), (np.arange(40, dtype=np.int64) * 7919) << 20]
    table = spark.createDataFrame([(int(f), int(i)) for i, f in enumerate(fps)], "fp long, id long")
    from folioloom.llm.components import components

    got = {r.node: r.root for r in components(S.links(table, bucket=32)).collect()}
    want = classes(fps.view(np.uint64), np.arange(len(fps)))
    assert all(got.get(i, i) == want[i] for i in range(len(fps)))


def test_empty_and_nameless_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c d"), (2, "a b c d"), (1, "other words here now"), (1, "other words here now"), (None, "alone x y z")], "doc_id long, text string")
    rows = {(r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert rows == {(None, 2), (2, 2), (1, 1), (None, None)}
    assert sorted((r.doc_id or 0, r.text) for r in S.one_of_each(docs).collect()) == [(0, "alone x y z"), (1, "other words here now"), (2, "a b c d")]
