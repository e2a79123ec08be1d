import random
import zlib
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from folioloom.llm import repair as R
from folioloom.llm import trie_bpe as B

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "<|startoftext|>hi<|endoftext|> <|startoftext|>", "aaaaaaa aaaaaaaaaaaaa hahahaha mississippi", "Straße ΣΑΣ İstanbul ﬁne éx 日本語 😀👍🏽 it's don't I'LL we've",
    " nb sp\x1c\x1d\x85 ok\t\x0b tab\r\n 12345 ½ ٣", "a" * 2000, "a  b", "a \n b", " a b ", "x" * 30000 + " y",
]


def texts(n=600):
    r = random.Random(5)
    letters = "abcdefghinorstuABC '\n.,!?éüñß0123456789-_<|>日я"
    return ODD + ["".join(r.choice(letters) for _ in range(r.randint(1, 80))) for _ in range(n)] + ["".join(r.choice("abeint ") for _ in range(r.randint(1, 40))) for _ in range(n)]


def test_trie_codec_equals_the_library(monkeypatch):
    monkeypatch.setattr(B, "MAX_CHUNKS", 200)
    monkeypatch.setattr(B, "MAX_WORDS", 100)
    tok, codec, rows = Tokenizer.from_file(WORD), B.TrieCodec(WORD), texts()
    for at in range(0, len(rows), 100):
        group = rows[at : at + 100]
        want = [tok.encode(t or "", add_special_tokens=False).ids for t in group]
        got = codec.encode_batch(group)
        assert got == want
        assert [codec.decode(ids) for ids in got] == [tok.decode(ids, skip_special_tokens=False) for ids in want]


def test_token_digests(spark):
    tok, rows = Tokenizer.from_file(WORD), [(i, t) for i, t in enumerate(texts(40))] + [(None, "null id"), (1, "again"), (1, "again")]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted(tuple(x or 0 for x in r) for r in B.token_digests(docs, WORD).collect())
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i or 0, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    one = docs.where("doc_id = 4").select(B.encode("text", WORD).alias("ids")).select("ids", B.decode("ids", WORD).alias("text")).first()
    assert one.text == tok.decode(one.ids, skip_special_tokens=False)
    assert B.token_digests(docs.limit(0), WORD).count() == 0


def blanks(n=1500):
    r = random.Random(9)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for letters in ("ab \n", "ab'sé, \n\t.", "a \n\n  b", "xy1,.;!?   日\x1c\x85") for _ in range(n)] + ["<|endoftext|>  a", "a  <|endoftext|>\n b", "x <|endoftext|>"]


def test_atoms_equal_the_library(monkeypatch):
    monkeypatch.setattr(R, "MAX_ATOMS", 800)
    tok, enc, rows = Tokenizer.from_file(BYTE), R.Encoder(BYTE), texts() + blanks()
    random.Random(2).shuffle(rows)
    for at in range(0, len(rows), 150):
        group = rows[at : at + 150]
        atoms, ends = enc.atoms(pa.array(group, pa.string()))
        got = [enc.ids(atoms[a:b]).tolist() for a, b in zip([0, *ends[:-1]], ends)]
        assert got == [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in group]


def test_encoder_tables_stay_small(monkeypatch):
    monkeypatch.setattr(R, "MAX_ATOMS", 2000)
    enc, r = R.Encoder(BYTE), random.Random(4)
    for _ in range(12):  # long and new atoms, white space side by side
        enc.atoms(pa.array(["  ".join("".join(r.choice("abcdef") for _ in range(100)) for _ in range(60)) for _ in range(20)], pa.string()))
        assert sum(map(len, enc.names)) <= 2000 + 1200
    enc.atoms(pa.array(["a"], pa.string()))
    assert len(enc.uses) <= 2001 and len(enc.flat) <= 4 * 2000 + 10


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(R, "SHARD_BYTES", 4000)
    monkeypatch.setattr(R, "LEAST", 2)
    tok, rows = Tokenizer.from_file(BYTE), [(i * 3, t) for i, t in enumerate(texts(80))] + [(None, "null id"), (6, "again"), (6, "again")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in random.Random(1).sample(rows, len(rows))], "doc_id long, text string, part string")
    got = sorted((tuple(r) for r in R.token_files(docs, BYTE).collect()), key=lambda r: r[1])
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    assert got == want
    assert R.token_files(docs.limit(0), BYTE).count() == 0


def test_shards_are_smaller_and_open_anywhere():
    enc = R.Encoder(BYTE)
    docs = [f"the cat sat on the mat and the dog saw the cat number {i % 7} " * 20 + "end" for i in range(50)]
    atoms, ends = enc.atoms(pa.array(docs))
    rules, seq, doc_ends = R.compress(enc.flat, enc.ends, atoms, ends, 50257)
    whole = [enc.ids(atoms[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
    assert rules and len(seq) < 0.5 * sum(map(len, whole))
    shard = R.Shard(R.pack(list(range(50)), rules, seq, doc_ends, 50257))
    flat = [int(x) for w in whole for x in w]
    assert shard.document(17).tolist() == whole[17].tolist()
    assert shard.ids(1234, 2345).tolist() == flat[1234:2345]
    assert [d for _, ids in shard.documents() for d in ids.tolist()] == flat


def test_shared_workers_walk_small_groups():
    import pandas as pd

    from folioloom.llm import trie_bpe as B

    texts = pd.Series(["x" * 300_000] * 10 + [None, "y" * (B.FEW_CHARS + 1), "z"])
    groups = list(B.grouped(texts, B.FEW_CHARS))
    assert [t for g in groups for t in g] == list(texts)
    assert all(len(g) == 1 or sum(len(t or "") for t in g) <= B.FEW_CHARS for g in groups) and 12 * B.FEW_CHARS <= B.GROUP_CHARS
