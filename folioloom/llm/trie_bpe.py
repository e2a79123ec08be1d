"""BPE encoding and decoding by traversal of a trie that shares word prefixes.

For every prefix of a word, the encoding ends with one token that alone is
right: it leaves a shorter prefix whose own last token may stand before it.
Distinct words are put into a trie (a sorted list walked depth first, the path
being the stack of prefix states); a prefix that several words share gets its
last token once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import give_back

#: Bounds of what a worker remembers between batches: a table over its bound becomes the old one, whose entries return when asked for.
MAX_CHUNKS, MAX_WORDS, MAX_PAIRS = 300_000, 300_000, 1_000_000
#: The same where other work shares the workers: what a column of ids is made with, and forgotten after each task.
FEW_CHUNKS, FEW_WORDS, FEW_PAIRS = 30_000, 60_000, 150_000
#: Characters of the texts that share one walk of the trie; the second where other work shares the workers.
GROUP_CHARS, FEW_CHARS = 12_000_000, 1_000_000
#: The normalizer under which a run of letters is one word, and the byte alphabet of byte-level models.
PLAIN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class TrieCodec:
    """Encoder and decoder of a ``tokenizers`` file with a BPE model that marks word ends."""

    def __init__(self, path: str, max_chunks: int | None = None, max_words: int | None = None, max_pairs: int | None = None) -> None:
        from tokenizers import Tokenizer

        self.max_chunks, self.max_words, self.max_pairs = max_chunks or MAX_CHUNKS, max_words or MAX_WORDS, max_pairs or MAX_PAIRS
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in {**self.vocab, **self.added}.items()}
        tok = Tokenizer.from_file(path)
        self.normalize = tok.normalizer.normalize_str if tok.normalizer else str
        self.words_of = tok.pre_tokenizer.pre_tokenize_str
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.join: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            left, right, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.join[left, right] = r
            if made not in self.parts:
                self.parts[made], self.rank[made] = (left, right), r
        #: The length of the longest token that starts with two characters.
        self.reach: dict[str, int] = {}
        for t in self.vocab:
            n = len(t) - len(self.end) if self.end and t.endswith(self.end) else len(t)
            self.reach[t[:2]] = max(n, self.reach.get(t[:2], 2))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.chunks: dict[str, list[int]] = {}
        self.words: dict[str, list[int]] = {}
        self.old_chunks: dict[str, list[int]] = {}
        self.old_words: dict[str, list[int]] = {}
        self.numeral = {i: str(i) for i in self.token}
        #: The short way of _split is for lower-cased letter runs in the byte alphabet.
        self.plain = spec["normalizer"] == PLAIN_NORMALIZER and r"[\p{L}]+" in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
        self.single: dict[int, bool] = {}

    def forget(self) -> None:
        """Empties all tables that grow."""
        for table in (self.chunks, self.old_chunks, self.words, self.old_words, self.pairs):
            table.clear()

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' text is these two tokens.

        The symbols that meet at the border are, over time, those on the right
        edge of ``left`` and on the left edge of ``right``, each until the
        merge that builds the next one.  The border lasts unless two of them
        have a merge that comes before both of those (leftmost first if equal).
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is not None:
            return known
        edge_l, edge_r = [left], [right]
        while edge_l[-1] in self.parts:
            edge_l.append(self.parts[edge_l[-1]][1])
        while edge_r[-1] in self.parts:
            edge_r.append(self.parts[edge_r[-1]][0])
        i, j, never = len(edge_l) - 1, len(edge_r) - 1, len(self.join) + 1
        good = True
        while True:
            until_l = self.rank[edge_l[i - 1]] if i else never
            until_r = self.rank[edge_r[j - 1]] if j else never
            r = self.join.get((edge_l[i], edge_r[j]))
            if r is not None and r < until_l and r <= until_r:
                good = False
                break
            if not i and not j:
                break
            if until_l <= until_r:
                i -= 1
            else:
                j -= 1
        if len(self.pairs) >= self.max_pairs:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def stands(self, token: int) -> bool:
        """Whether a token's text is encoded as that token, which its two parts tell."""
        known = self.single.get(token)
        if known is None:
            known = True
            if token in self.parts:
                left, right = self.parts[token]
                known = self.stands(left) and self.stands(right) and self._merges(left, right)
            self.single[token] = known
        return known

    def _merges(self, left: int, right: int) -> bool:
        """Whether no other merge crosses the border of two parts before their own does."""
        own = self.join[left, right]
        edge_l, edge_r = [left], [right]
        while edge_l[-1] in self.parts:
            edge_l.append(self.parts[edge_l[-1]][1])
        while edge_r[-1] in self.parts:
            edge_r.append(self.parts[edge_r[-1]][0])
        i, j, never = len(edge_l) - 1, len(edge_r) - 1, len(self.join) + 1
        while i or j:
            until_l = self.rank[edge_l[i - 1]] if i else never
            until_r = self.rank[edge_r[j - 1]] if j else never
            r = self.join.get((edge_l[i], edge_r[j]))
            if r is not None and r < until_l and r <= until_r:
                return False
            if until_l <= until_r:
                i -= 1
            else:
                j -= 1
        return own < never

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Encodings of distinct words (already in the model's alphabet), prefixes shared along the trie's paths."""
        out: dict[str, list[int]] = {}
        last: list[int] = []  # of the prefix of each length on the path, its last token
        start: list[int] = []  # and where that token starts
        until: list[int] = []  # and where the longest token from each place ends
        before = ""
        vocab, end, reach = self.vocab, self.end, self.reach
        may_follow, stands = self.may_follow, self.single
        for word in sorted(words):
            n = len(word)
            shared, limit = 0, min(len(last), n - 1)
            while shared < limit and before[shared] == word[shared]:
                shared += 1
            del last[shared:], start[shared:], until[max(0, shared - 1) :]
            until += [at + reach.get(word[at : at + 2], 1) for at in range(len(until), n)]
            for stop in range(shared + 1, n + 1):
                suffix = end if stop == n else ""
                for at in range(stop):
                    if until[at] < stop:
                        continue
                    token = vocab.get(word[at:stop] + suffix)
                    if token is not None and (stands[token] if token in stands else self.stands(token)) and (not at or may_follow(last[at - 1], token)):
                        break
                else:
                    raise ValueError(f"no token for {word[stop - 1]!r}")
                if stop < n:
                    last.append(token)
                    start.append(at)
            ids = [token]
            while at:
                ids.append(last[at - 1])
                at = start[at - 1]
            ids.reverse()
            out[word] = ids
            before = word
        return out

    def _split(self, chunk: str) -> list[str]:
        """Words of a chunk in the model's alphabet; Latin-1 letters need no help of the library."""
        body, mark = (chunk[:-1], [chunk[-1]]) if chunk[-1] in ",.!?;:" else (chunk, [])
        if self.plain and body.isalpha():
            if body.isascii():
                return [body.lower(), *mark]
            if max(body) < "\u0100":
                return [body.lower().encode().decode("latin-1").translate(BYTE_LETTERS), *mark]
        return [w for w, _ in self.words_of(self.normalize(chunk))]

    def _learn(self, new: set[str]) -> None:
        """Adds the encodings of chunks (pieces of text without blanks or added tokens)."""
        split = {c: self._split(c) for c in new}
        if len(self.words) > self.max_words:
            self.words, self.old_words = {}, self.words
        words, old, fresh = self.words, self.old_words, set()
        for ws in split.values():
            for w in ws:
                if w not in words:
                    if w in old:
                        words[w] = old[w]
                    else:
                        fresh.add(w)
        words.update(self.encode_words(fresh))
        for c, ws in split.items():
            self.chunks[c] = words[ws[0]] if len(ws) == 1 else [i for w in ws for i in words[w]]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text, as ``encode(text, add_special_tokens=False)`` gives them."""
        pieces = []
        for text in texts:
            text = text or ""
            spans = self.split_added.split(text) if self.split_added and any(t in text for t in self.added) else [text]
            pieces.append([s if s in self.added else s.replace("\n", " ").split(" ") for s in spans if s])
        need = {c for spans in pieces for s in spans if isinstance(s, list) for c in s}
        need.discard("")
        if len(self.chunks) > self.max_chunks:
            self.chunks, self.old_chunks = {}, self.chunks
        chunks, old = self.chunks, self.old_chunks
        need = {c for c in need if c not in chunks}
        kept = {c: old[c] for c in need if c in old}
        chunks.update(kept)
        self._learn(need.difference(kept))
        out: list[list[int]] = []
        for spans in pieces:
            ids: list[int] = []
            for s in spans:
                if isinstance(s, str):
                    ids.append(self.added[s])
                else:
                    for c in s:
                        if c:
                            ids += chunks[c]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """As ``decode(ids, skip_special_tokens=False)`` of a file without a decoder: the tokens, spaced."""
        token = self.token
        return " ".join([token[i] for i in ids])


def grouped(texts: pd.Series, chars: int | None = None) -> Iterator[list[str | None]]:
    """Texts in groups of a bounded size (a longer text alone)."""
    group, size, chars = [], 0, chars or GROUP_CHARS
    for text in texts:
        if group and size + len(text or "") > chars:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text or "")
    if group:
        yield group


@lru_cache(maxsize=2)
def codec(path: str, max_chunks: int | None = None, max_words: int | None = None, max_pairs: int | None = None) -> TrieCodec:
    """One codec per worker process and file."""
    return TrieCodec(path, max_chunks, max_words, max_pairs)


def encode(text: Column | str, path: str) -> Column:
    """array<int> of the ids of a text column; null and empty texts have none."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, FEW_CHUNKS, FEW_WORDS, FEW_PAIRS)
        try:
            for texts in batches:
                yield pd.Series([ids for group in grouped(texts, FEW_CHARS) for ids in c.encode_batch(group)])
        finally:
            c.forget()
            give_back()

    return udf(text)


def decode(ids: Column | str, path: str) -> Column:
    """The text that a column of ids decodes to."""

    @F.pandas_udf(T.StringType())
    def udf(rows: pd.Series) -> pd.Series:
        c = codec(path, FEW_CHUNKS, FEW_WORDS, FEW_PAIRS)
        return rows.map(lambda x: c.decode([] if x is None else list(x)))

    return udf(ids)


ROUND_TRIP = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())])


def round_trip(text: Column | str, path: str) -> Column:
    """struct<ids, decoded_sha256>: ids of a text column and the digest of what they decode to, in one worker per task."""
    from hashlib import sha256

    @F.pandas_udf(ROUND_TRIP)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path, FEW_CHUNKS, FEW_WORDS, FEW_PAIRS)
        try:
            for texts in batches:
                rows = [(ids, sha256(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()) for group in grouped(texts, FEW_CHARS) for ids in c.encode_batch(group)]
                yield pd.DataFrame(rows, columns=ROUND_TRIP.names)
        finally:
            c.forget()
            give_back()

    return udf(text)


DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``.

    A null text is empty: no ids, the digests of the empty string.  Repeated
    rows and null ids each get their row; other columns are not read.
    """
    from hashlib import sha256

    @F.pandas_udf(DIGESTS)
    def digests(texts: pd.Series) -> pd.DataFrame:
        c, rows = codec(path), []
        for group in grouped(texts):
            for ids in c.encode_batch(group):
                rows.append((len(ids), sha256(" ".join([c.numeral[i] for i in ids]).encode()).hexdigest(), sha256(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()))
        return pd.DataFrame(rows, columns=DIGESTS.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digests("text").alias("d")).select("doc_id", "d.*")
