"""Token-id files: Re-Pair grammar compression of shards, with random access.

A shard holds the ids of consecutive documents (in order of doc_id).  Its
frequent id pairs are replaced by new symbols, again and again; the file keeps
the rules, every symbol's expansion length, the compressed sequence and where each
document starts in it, so that any document or id range is decoded alone.

Shard file (little-endian): ``RPID``, u32 version, u32 base (first new
symbol), u32 rules, u32 documents, u64 symbols; u32 left and u32 right of each rule;
u32 expansion length of each rule; per document i64 doc_id, u8 whether it is
null, u64 end in the sequence; then the symbols, u16 if all fit, else u32
(u8 2 or 4 first).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import give_back, parts_of, shared_dir

MAGIC, VERSION, END_ID = b"RPID", 1, 0
#: Bytes of text in a shard (a longer document has its own), new symbols per round, and the least count of a pair.
SHARD_BYTES, PER_ROUND, LEAST = 12_000_000, 4096, 8
#: A round is the last of its kind if it shortens the sequence by less than this share, or leaves room for fewer symbols than that share of 16 bits.
LITTLE = 0.01
BUCKET_BITS = 22
#: Atoms that a worker remembers, and the longest of them in bytes; what is longer is forgotten with its shard.
MAX_ATOMS, MAX_ATOM_BYTES = 500_000, 60
#: Marks that end a run of letters, and the letter that stands for a blank in byte-level models.
MARKS, BLANK = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "\u0120"
#: A blank before a visible character: there a text can be cut.
_CUT = re.compile(r" (?=\S)")
#: Letters about which editions of Unicode agree; pieces with others are left to the library whole.
_LETTERS = "".join(filter(str.isalpha, map(chr, range(0x2B0))))
_NONE = np.empty(0, np.uint32)
SHARDS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("payload", T.BinaryType())])
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


class Encoder:
    """Ids of texts by the tokenizers library, each atom encoded once.

    In a byte-level model a blank before a visible character starts a new
    word, a lone line end between visible characters is a word, and marks
    behind letters are one.  So a text is cut there into atoms, with or
    without a blank in front.  A text with other white space is cut at blanks before
    visible characters only, one with added tokens not at all.  New atoms with
    a blank are encoded as one text; there, a token that starts with
    a blank starts an atom.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        #: The same model for words that need no splitting and whose bytes are their letters.
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith(BLANK)]] = True
        self.forget()

    def forget(self) -> None:
        """Forgets all atoms.  ``names[1]`` has those that follow a blank (without it), ``names[0]`` the others, ``numbers`` their numbers."""
        self.names = [pa.array([], pa.large_string()) for _ in (0, 1)]
        self.numbers = [np.empty(0, np.int64) for _ in (0, 1)]
        self.flat, self.ends = np.array([END_ID], np.uint32), np.array([0, 1], np.int64)  # atom 0 is the end of a document
        self.uses = np.ones(1, np.int32)

    def _trim(self) -> None:
        """Keeps the atoms that came in more than one shard, where there are too many atoms or ids."""
        if len(self.uses) <= MAX_ATOMS and len(self.flat) <= 4 * MAX_ATOMS:
            return
        often = self.uses > 1
        if 2 * often.sum() > MAX_ATOMS:
            self.forget()
            return
        often[0] = True
        kept, number = np.nonzero(often)[0], np.cumsum(often) - 1
        sizes = np.diff(self.ends)[kept]
        self.flat, self.ends, self.uses = self.ids(kept), np.r_[0, np.cumsum(sizes)], np.ones(len(kept), np.int32)
        for k in (0, 1):
            stay = often[self.numbers[k]]
            self.names[k], self.numbers[k] = self.names[k].filter(pa.array(stay)), number[self.numbers[k][stay]]

    def _encode(self, names: pa.Array, spaced: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The names in some order, their ids one after the other, and how many each has."""
        order, flat, sizes = [], [_NONE], [np.empty(0, np.int64)]
        letters = pc.and_(pc.string_is_ascii(names), pc.ascii_is_alpha(names))
        inner = pc.match_substring(names, " ")
        joined = [(letters, self.plain, BLANK), (pc.invert(pc.or_(letters, inner)), self.tok, "")] if spaced else []
        for which, tok, blank in joined:
            some = names.filter(which)
            for at in range(0, len(some), 50_000):
                part = some.slice(at, 50_000)
                text = f" {blank}".join(part.to_numpy(zero_copy_only=False))
                ids = np.array(tok.encode_batch_fast([(blank or " ") + text], add_special_tokens=False)[0].ids, np.uint32)
                starts = np.nonzero(self.opens[ids])[0]
                if len(starts) != len(part):
                    raise ValueError("atoms and tokens do not match")
                order.append(part)
                flat.append(ids)
                sizes.append(np.diff(np.r_[starts, len(ids)]))
        alone = names.filter(inner) if spaced else names
        for at in range(0, len(alone), 10_000):
            part = alone.slice(at, 10_000)
            got = [e.ids for e in self.tok.encode_batch_fast([" " + n if spaced else n for n in part.to_pylist()], add_special_tokens=False)]
            order.append(part)
            flat.append(np.fromiter((i for ids in got for i in ids), np.uint32))
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
        return pa.concat_arrays(order), np.concatenate(flat), np.concatenate(sizes)

    def _atoms(self, names: pa.Array, spaced: int) -> np.ndarray:
        """The atom of each name; new ones are encoded."""
        coded = names.dictionary_encode()
        found = pc.index_in(coded.dictionary, self.names[spaced])
        out = np.full(len(found), -1, np.int64)
        old = found.is_valid().to_numpy(zero_copy_only=False)
        out[old] = self.numbers[spaced][found.drop_null().to_numpy()]
        new = coded.dictionary.filter(found.is_null())
        if len(new):
            order, flat, sizes = self._encode(new, spaced)
            own = np.arange(len(self.uses), len(self.uses) + len(new))
            out[~old] = own[pc.index_in(new, order).to_numpy()]
            self.uses = np.r_[self.uses, np.zeros(len(new), np.int32)]
            self.ends, self.flat = np.r_[self.ends, self.ends[-1] + np.cumsum(sizes)], np.r_[self.flat, flat]
            short = pc.less_equal(pc.binary_length(order), MAX_ATOM_BYTES)
            self.names[spaced] = pa.concat_arrays([self.names[spaced], order.filter(short)])
            self.numbers[spaced] = np.r_[self.numbers[spaced], own[short.to_numpy(zero_copy_only=False)]]
        return out[coded.indices.to_numpy()] if len(names) else out

    def _parts(self, names: pa.Array, spaced: int) -> tuple[np.ndarray, np.ndarray]:
        """For each piece its atom, and the atom of the marks behind its letters (-1: none)."""
        bases = pc.ascii_rtrim(names, MARKS)
        marked = pc.and_(pc.less(pc.binary_length(bases), pc.binary_length(names)), pc.match_substring_regex(bases, "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+$"))
        first, second = self._atoms(pc.if_else(marked, bases, names), spaced), np.full(len(names), -1, np.int64)
        second[marked.to_numpy(zero_copy_only=False)] = self._atoms(pc.utf8_ltrim(names.filter(marked), _LETTERS), 0)
        return first, second

    def atoms(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The atoms of all texts one after the other, each text closed by atom 0, and where each text ends.

        Numbers are valid until the next call.
        """
        self._trim()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lines = pc.split_pattern(texts, "\n")
        words = pc.split_pattern(lines.values, " ")
        coded = words.values.dictionary_encode()
        piece, names = coded.indices.to_numpy(), coded.dictionary
        starts, line_starts = words.offsets.to_numpy()[:-1], lines.offsets.to_numpy()[:-1]
        text_starts = starts[line_starts]
        sizes = np.diff(np.r_[text_starts, len(piece)])
        bare = np.zeros(len(piece), bool)
        bare[starts] = True
        behind = bare.copy()  # a line end stands before it
        behind[text_starts] = False
        # texts with white space side by side or with added tokens go the long way
        odd = pc.or_(pc.equal(names, ""), pc.not_equal(pc.binary_length(names), pc.binary_length(pc.utf8_ltrim_whitespace(names)))).to_numpy(zero_copy_only=False)[piece]
        odd[text_starts] = False
        long_way = np.logical_or.reduceat(odd, text_starts)
        for a in self.added:
            long_way |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        there = np.repeat(~long_way, sizes)
        parts = np.full((2, 2, len(names)), -1, np.int64)
        for spaced in (0, 1):
            used = np.zeros(len(names), bool)
            used[piece[there & (bare != bool(spaced))]] = True
            parts[spaced, :, used] = np.stack(self._parts(names.filter(pa.array(used)), spaced), axis=1)
        line_end = self._atoms(pa.array(["\n"], pa.large_string()), 0)[0]
        # a line end before each line but a text's first, the atom, the marks
        rows = np.full((len(piece), 3), -1, np.int32)
        rows[behind, 0] = line_end
        rows[:, 1], rows[:, 2] = (np.where(bare, parts[0, k, piece], parts[1, k, piece]) for k in (0, 1))
        rows[~there] = -1
        flat = rows[rows >= 0]
        sizes = np.add.reduceat(there * (1 + behind + (rows[:, 2] >= 0)), text_starts)
        slow = dict(zip(np.nonzero(long_way)[0].tolist(), self._long_way([x.as_py() for x in texts.filter(pa.array(long_way))])))
        for i, own in slow.items():
            sizes[i] = len(own)
        ends = np.cumsum(sizes + 1)
        out, body = np.zeros(int(ends[-1]), np.int32), np.ones(int(ends[-1]), bool)
        body[ends - 1] = False
        for i, own in slow.items():
            out[ends[i] - 1 - len(own) : ends[i] - 1] = own
            body[ends[i] - 1 - len(own) : ends[i] - 1] = False
        out[body] = flat
        self.uses += np.bincount(out, minlength=len(self.uses)) > 0
        return out, ends

    def _long_way(self, texts: list[str]) -> list[np.ndarray]:
        cut = [[t] if any(a in t for a in self.added) else _CUT.split(t) for t in texts]
        firsts, rests = (self._atoms(pa.array(x, pa.large_string()), k) for k, x in enumerate(([c[0] for c in cut], [n for c in cut for n in c[1:]])))
        ends = np.cumsum([len(c) - 1 for c in cut])
        return [np.r_[f, rests[b - len(c) + 1 : b]] for f, c, b in zip(firsts, cut, ends)]

    def ids(self, atoms: np.ndarray) -> np.ndarray:
        starts = self.ends[atoms]
        return _gather(starts, self.ends[atoms + 1] - starts, self.flat)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


def _gather(offsets: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` at offsets, of the given sizes, one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(offsets - (ends - sizes), sizes) + np.arange(ends[-1])]


def _replace(seq: np.ndarray, ends: np.ndarray, weights: np.ndarray | None, fresh: int, most: int, least: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """One round: the commonest pairs inside the segments (which stop at ``ends``) become the symbols from ``fresh`` on.

    Of chosen pairs that overlap, every other is replaced, from the left; a
    pair that is left with fewer than ``least`` places then is not replaced.
    """
    if len(seq) < 2 or most < 1:
        return seq, ends, []
    half, kind = (16, np.uint32) if fresh + most <= 1 << 16 else (32, np.uint64)  # a key is two symbols side by side
    key = seq[:-1].astype(kind) << kind(half) | seq[1:].astype(kind)
    w = np.ones(len(key), np.float32) if weights is None else np.repeat(weights, np.diff(np.r_[0, ends]))[:-1].astype(np.float32)
    stops = ends[:-1]
    w[stops[(stops > 0) & (stops < len(seq))] - 1] = 0
    # a pair is no commoner than its hash bucket: only pairs in the fullest buckets are sorted
    bits = min(BUCKET_BITS, max(8, len(seq).bit_length() + 1))
    bucket = (key * kind(0x9E3779B97F4A7C15 >> (64 - 2 * half) | 1) >> kind(2 * half - bits)).astype(np.int32)
    full = np.bincount(bucket, w, 1 << bits)
    likely = full[full >= least]
    some = full >= (np.partition(likely, -most)[-most] if most < len(likely) else least)
    at = np.nonzero(some[bucket] & (w > 0))[0]
    pairs, inverse = np.unique(key[at], return_inverse=True)
    counts = np.bincount(inverse, w[at], len(pairs))
    chosen = np.lexsort((pairs, -counts))[:most]
    chosen = chosen[counts[chosen] >= least]
    while len(chosen):
        rank = np.full(len(pairs), -1, np.int64)
        rank[chosen] = np.arange(len(chosen))
        hit = rank[inverse] >= 0
        place, which = at[hit], rank[inverse[hit]]
        run = np.maximum.accumulate(np.where(np.r_[True, np.diff(place) > 1], np.arange(len(place)), 0))
        turn = (np.arange(len(place)) - run) % 2 == 0
        place, which = place[turn], which[turn]
        left = np.bincount(which, w[place], len(chosen)) >= least
        if left.all():
            break
        chosen = chosen[left]
    if not len(chosen):
        return seq, ends, []
    out, keep = seq.copy(), np.ones(len(seq), bool)
    out[place] = which + fresh
    keep[place + 1] = False
    rules = list(zip((pairs[chosen] >> kind(half)).tolist(), (pairs[chosen] & kind((1 << half) - 1)).tolist()))
    return out[keep], np.r_[0, np.cumsum(keep)][ends], rules


def compress(flat: np.ndarray, atom_ends: np.ndarray, atoms: np.ndarray, doc_ends: np.ndarray, base: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(rules, sequence, end of each document in it) of documents given as atoms one after the other.

    Atom i is flat[atom_ends[i]:atom_ends[i + 1]]; a document's atoms stop at its
    place in ``doc_ends``.  Frequent pairs inside atoms are replaced first, counted on the different atoms by how
    often each occurs, then those of the whole sequence, in rounds until
    they hardly shorten it (no pair is left LEAST times, or the symbols fill 16
    bits; 32 for larger vocabularies).  No symbol spans two documents.
    """
    room = (1 << (16 if base < 1 << 16 else 32)) - base
    counts = np.bincount(atoms, minlength=len(atom_ends) - 1)
    used = np.nonzero(counts)[0]
    number = np.cumsum(counts > 0) - 1
    sizes = atom_ends[used + 1] - atom_ends[used]
    seq, ends = _gather(atom_ends[used], sizes, flat), np.cumsum(sizes)
    rules: list[tuple[int, int]] = []
    worth = lambda before, now, left: before - now >= max(1, LITTLE * before) and left >= LITTLE * (1 << 16)
    while True:
        before = len(seq)
        seq, ends, new = _replace(seq, ends, counts[used], base + len(rules), min(PER_ROUND, room // 2 - len(rules)), LEAST)
        rules += new
        if not worth(before, len(seq), room // 2 - len(rules)):
            break
    sizes = np.diff(np.r_[0, ends])
    inverse = number[atoms]
    upto = np.r_[0, np.cumsum(sizes[inverse])]
    whole, doc_ends = _gather((ends - sizes)[inverse], sizes[inverse], seq), upto[doc_ends]
    while True:
        before = len(whole)
        whole, doc_ends, new = _replace(whole, doc_ends, None, base + len(rules), min(PER_ROUND, room - len(rules)), LEAST)
        rules += new
        if not worth(before, len(whole), room - len(rules)):
            return rules, whole, doc_ends


def expansion_lengths(rules: list[tuple[int, int]], base: int) -> list[int]:
    sizes: list[int] = []
    for a, b in rules:
        sizes.append((sizes[a - base] if a >= base else 1) + (sizes[b - base] if b >= base else 1))
    return sizes


def pack(doc_ids: list[int | None], rules: list[tuple[int, int]], seq: np.ndarray, doc_ends: np.ndarray, base: int) -> bytes:
    wide = len(seq) and int(seq.max()) > 0xFFFF
    return b"".join((
        MAGIC, struct.pack("<IIIIQ", VERSION, base, len(rules), len(doc_ids), len(seq)),
        np.array([r[0] for r in rules], "<u4").tobytes(), np.array([r[1] for r in rules], "<u4").tobytes(),
        np.array(expansion_lengths(rules, base), "<u4").tobytes(),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        doc_ends.astype("<u8").tobytes(), bytes([4 if wide else 2]), seq.astype("<u4" if wide else "<u2").tobytes(),
    ))


class Shard:
    """A shard file, read back."""

    def __init__(self, blob: bytes) -> None:
        if blob[:4] != MAGIC:
            raise ValueError("not a shard file")
        version, self.base, n_rules, n_docs, n_seq = struct.unpack_from("<IIIIQ", blob, 4)
        if version != VERSION:
            raise ValueError(f"shard version {version}")
        at = 4 + struct.calcsize("<IIIIQ")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        left, right, self.lengths = take("<u4", n_rules), take("<u4", n_rules), take("<u4", n_rules)
        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.doc_ends = take("<u8", n_docs).astype(np.int64)
        kind = {2: "<u2", 4: "<u4"}[int(take("u1", 1)[0])]
        self.seq = take(kind, n_seq)
        # expansions of all symbols, one after the other; a rule only refers to earlier ones
        sizes = np.r_[np.ones(self.base, np.int64), self.lengths]
        offsets = np.cumsum(sizes) - sizes
        flat = np.r_[np.arange(self.base, dtype=np.uint32), np.empty(int(sizes[self.base :].sum()), np.uint32)]
        at, spans = offsets.tolist(), sizes.tolist()
        for i, (a, b) in enumerate(zip(left.tolist(), right.tolist()), start=self.base):
            to, n, m = at[i], spans[a], spans[b]
            flat[to : to + n] = flat[at[a] : at[a] + n]
            flat[to + n : to + n + m] = flat[at[b] : at[b] + m]
        self.symbol_sizes, self.offsets, self.flat = sizes, offsets, flat

    def sizes(self, seq: np.ndarray) -> np.ndarray:
        """Expansion length of each symbol."""
        return self.symbol_sizes[seq]

    def expand(self, seq: np.ndarray) -> np.ndarray:
        return _gather(self.offsets[seq], self.symbol_sizes[seq], self.flat)

    def document(self, i: int) -> np.ndarray:
        """Ids of one document, without decoding the others."""
        return self.expand(self.seq[(self.doc_ends[i - 1] if i else 0) : self.doc_ends[i]])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        sizes = np.r_[0, np.cumsum(self.sizes(self.seq))]
        flat, before = self.expand(self.seq), 0
        for doc, end in zip(self.doc_ids, sizes[self.doc_ends]):
            yield doc, flat[before:end]
            before = end

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard: the stored expansion lengths tell which symbols hold them."""
        upto = np.cumsum(self.sizes(self.seq))
        a, b = np.searchsorted(upto, [start, stop - 1], side="right")
        before = int(upto[a - 1]) if a else 0
        return self.expand(self.seq[a : b + 1])[start - before : stop - before]


def write_shards(docs: DataFrame, path: str, to: str, base: int, partitions: int | None = None) -> None:
    """Writes the ids of all documents as shard files, in ascending order of doc_id, each document closed by END_ID.

    Rows are dealt by ranges of doc_id (nulls first, ties by text), and each
    task writes shards of at most SHARD_BYTES of text through Spark's writer, which
    any file system serves and which commits only whole tasks.
    """
    n = partitions or parts_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        try:
            for held in by_size(batches, SHARD_BYTES):
                atoms, ends = enc.atoms(held["text"])
                doc_ids = held["doc_id"].to_pylist()
                n_ids = int((enc.ends[1:] - enc.ends[:-1])[atoms].sum())
                blob = pack(doc_ids, *compress(enc.flat, enc.ends, atoms, ends, base), base)
                yield pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_ids": n_ids, "payload": blob}], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("payload", pa.binary())]))
                seq += 1
        finally:
            give_back()

    rows.mapInArrow(shards, SHARDS).write.parquet(to)


def by_size(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in batches of at most ``most`` bytes of text (a longer text alone)."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).tolist()
        begun = 0
        for i, n in enumerate(sizes):
            if size and size + n > most:
                yield _one([*held, batch.slice(begun, i - begun)])
                held, size, begun = [], 0, i
            size += n
        held.append(batch.slice(begun))
    if sum(b.num_rows for b in held):
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def read_documents(spark, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shard files.

    Only a total per write task (as many as partitions) comes to the driver; a
    shard's start is its task's plus a running sum inside the task.
    """
    from pyspark.sql import Window

    files = spark.read.schema(SHARDS).parquet(at)
    before, total = [], 0
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        before.append((r.part, total))
        total += r.n
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("part", "seq", "n_ids").withColumn("inside", F.coalesce(inside, F.lit(0)))
    starts = starts.join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("first"))
    rows = files.join(starts, ["part", "seq"]).select("first", "payload")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            for batch in batches:
                for first, payload in zip(batch["first"], batch["payload"]):
                    out, at = [], int(first)
                    for doc, ids in Shard(payload).documents():
                        out.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                    yield pd.DataFrame(out, columns=DOCS.names).astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})
        finally:
            give_back()

    return rows.mapInPandas(decode, DOCS)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def token_files(docs: DataFrame, path: str) -> DataFrame:
    """Writes ``docs`` as shard files in the shared folder and returns what they say when read back.

    A null text is empty: one id, the end.  Null ids come first; repeated rows
    are documents of their own.  An empty table gives no files and no rows.
    """
    import uuid

    spark = docs.sparkSession
    to = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_shards(docs, path, to, vocabulary_size(path))
    return read_documents(spark, to)
