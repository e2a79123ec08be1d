"""Repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A string of LENGTH bytes is repeated if it starts at two places of the corpus.
Not every suffix has to be sorted to find them all:

1. Every window of LENGTH bytes has an anchor: of its GRAM-byte strings, the
   leftmost of least hash.  Equal windows have their anchors at the same offset, and
   neighbouring windows mostly share one, so there is about one per 170 bytes.
   The windows of an anchor span one stretch of text, its context.
2. Distinguishing prefixes: an anchor whose gram occurs once cannot be in a
   repeated window.  Contexts that occur twice or more (by 128-bit digests)
   are repeated as a whole.  Both need digests only, counted per task first.
3. What is left are contexts, one of each kind, that share the gram with others
   and differ somewhere.  Their suffixes from the anchor are sorted: each task
   forms sorted runs, front-coded (common prefix length with the predecessor,
   then the rest), which are exchanged by gram and merged by a loser tree
   that compares two suffixes only behind their known common prefix.  The
   merge yields common prefix lengths; with those of the reversed texts before the
   anchors they tell exactly which windows two contexts share.
4. Grams with more than HOT different contexts are not merged in one task: the
   windows of their contexts are counted by 128-bit digests, per task first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import table

LENGTH, GRAM, HOT = 400, 64, 2000
#: Bytes handled at once by the anchor search, and content of a task's runs before they are written.
SEGMENT, RUN_BYTES = 1 << 20, 24_000_000
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_NO_ID = -(1 << 63)
_U = np.uint64
ANCHORS = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "th", "fp", "s1", "s2")] + [T.StructField(c, T.IntegerType()) for c in ("a", "lo", "hi")])
RUNS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("run", T.BinaryType())])
SPANS = T.StructType([T.StructField("id", T.LongType()), T.StructField("th", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
WINDOWS = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "th", "w1", "w2")] + [T.StructField(c, T.IntegerType()) for c in ("p", "weight")])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


_LETTERS = [_mix(np.arange(1, 257, dtype=_U) * _U(b)) for b in _BASE]
_POWERS: dict[int, list[np.ndarray]] = {}


def _powers(n: int) -> list[np.ndarray]:
    """For each base: powers of it and of its inverse modulo 2**64, at least n + 1 of them."""
    size = 1 << max(12, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = [np.multiply.accumulate(np.r_[_U(1), np.full(size, x, _U)]) for b in _BASE for x in (_U(b), _U(pow(b, -1, 1 << 64)))]
    return _POWERS[size]


class Digests:
    """Digests of any stretch of a byte array, from running sums; two independent ones of 64 bits."""

    def __init__(self, data: np.ndarray) -> None:
        powers, n = _powers(len(data)), len(data)
        self.up = powers[0], powers[2]
        self.sums = [np.r_[_U(0), np.cumsum(t[data] * down[:n])] for t, down in zip(_LETTERS, (powers[1], powers[3]))]

    def of(self, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
        s = self.sums[which]
        return _mix((s[stop] - s[start]) * self.up[which][start])


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, gram digest, context digests 1 and 2) over documents that stop at ``ends``.

    Places are in ``data``, which has fewer than 2**24 bytes.
    """
    n, width = len(data), length - gram + 1
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, _U, _U, _U))
    if n < length:
        return none
    starts = np.r_[0, ends[:-1]]
    sizes = np.maximum(ends - starts - length + 1, 0)  # windows of each document
    if not sizes.sum():
        return none
    d = Digests(data)
    at = np.arange(n - gram + 1)
    grams = d.of(at, at + gram)
    key = (grams & ~_U(0xFFFFFF)) | at.astype(_U)
    padded = np.full(-(-len(key) // width) * width, ~_U(0), _U)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    first = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    chosen = (np.minimum(back[first], ahead[first + width - 1]) & _U(0xFFFFFF)).astype(np.int64)
    turn = np.nonzero(np.r_[True, chosen[1:] != chosen[:-1]])[0]
    a, lo, hi = chosen[turn], first[turn], first[np.r_[turn[1:], len(first)] - 1]
    shape = _mix((a - lo).astype(_U) * _U(1009) + (hi - lo).astype(_U) + _U(7))
    return a, lo, hi, grams[a], d.of(lo, hi + length) ^ shape, d.of(lo, hi + length, 1) + shape


def text_anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(number of the text, anchor, first window, last window, digests) in groups; places are in the text.

    A text longer than SEGMENT is cut into stretches of window starts; a
    context is then cut too, which no match depends on.
    """
    held, owner, base, size = [], [], [], 0

    def flush() -> tuple[np.ndarray, ...]:
        ends = np.cumsum([len(x) for x in held])
        a, lo, hi, *digests = anchors(np.frombuffer(b"".join(held), np.uint8), ends, length, gram)
        doc = np.searchsorted(ends, a, side="right")
        move = np.array(base)[doc] - np.r_[0, ends[:-1]][doc] if len(a) else a
        return np.array(owner)[doc] if len(a) else a, a + move, lo + move, hi + move, *digests

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), SEGMENT):
            piece = text[at : at + SEGMENT + length - 1]
            if len(piece) < length:
                continue
            if held and size + len(piece) > 2 * SEGMENT:
                yield flush()
                held, owner, base, size = [], [], [], 0
            held.append(piece)
            owner.append(i)
            base.append(at)
            size += len(piece)
    if held:
        yield flush()


def common_prefix(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    top = min(len(x), len(y))
    while known < top:
        p, q = x[known : known + 64], y[known : known + 64]
        if p == q:
            known += len(p)
            continue
        size = min(len(p), len(q))
        diff = int.from_bytes(p[:size], "big") ^ int.from_bytes(q[:size], "big")
        return known + size - (diff.bit_length() + 7) // 8
    return top


class Entry:
    """A suffix in a run: text from the anchor on, reversed text before it, its place and weight."""

    __slots__ = ("before", "lcp", "place", "suffix", "weight")

    def __init__(self, suffix: bytes, before: bytes, place: tuple[int, int, int], weight: int, lcp: int = 0) -> None:
        self.suffix, self.before, self.place, self.weight, self.lcp = suffix, before, place, weight, lcp


def pack_run(entries: list[Entry]) -> bytes:
    """A sorted run, front-coded: the part of each suffix behind its common prefix with the one before."""
    entries.sort(key=lambda e: e.suffix)
    lcps, rest, last = [], [], b""
    for e in entries:
        n = common_prefix(last, e.suffix)
        lcps.append(n)
        rest.append(e.suffix[n:])
        last = e.suffix
    numbers = [np.array(x, "<i8") for x in ([e.place[0] for e in entries], [e.place[1] for e in entries], [e.place[2] for e in entries], [e.weight for e in entries], lcps, [len(r) for r in rest], [len(e.before) for e in entries])]
    return len(entries).to_bytes(8, "little") + b"".join(x.tobytes() for x in numbers) + b"".join(rest) + b"".join(e.before for e in entries)


def unpack_run(blob: bytes) -> Iterator[Entry]:
    n = int.from_bytes(blob[:8], "little")
    ids, ths, at, weight, lcps, rest, before = (x.tolist() for x in np.frombuffer(blob, "<i8", 7 * n, 8).reshape(7, n))
    to = 8 + 56 * n
    back = to + sum(rest)
    suffix = b""
    for i in range(n):
        suffix = suffix[: lcps[i]] + blob[to : to + rest[i]]
        yield Entry(suffix, blob[back : back + before[i]], (ids[i], ths[i], at[i]), weight[i], lcps[i])
        to += rest[i]
        back += before[i]


def merge_runs(runs: list[Iterator[Entry]]) -> Iterator[Entry]:
    """All entries in order of suffix; an entry's lcp is then its common prefix with the one before.

    A loser tree whose entries know their common prefix with the last winner:
    of two, the one that shares more with it comes first; only if both share
    as much are they compared, from there on.  The loser keeps the common
    prefix with the entry that beat it.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[Entry | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    for e in heads:
        if e is not None:
            e.lcp = 0

    def play(i: int, j: int) -> tuple[int, int]:
        x, y = heads[i], heads[j]
        if x is None or y is None:
            return (j, i) if x is None else (i, j)
        if x.lcp != y.lcp:
            return (i, j) if x.lcp > y.lcp else (j, i)
        n = common_prefix(x.suffix, y.suffix, x.lcp)
        if x.suffix[n : n + 1] <= y.suffix[n : n + 1]:
            y.lcp = n
            return i, j
        x.lcp = n
        return j, i

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if size > 1 else 0
    while heads[best] is not None:
        yield heads[best]
        # within a run, the front code is the common prefix with the entry just put out
        heads[best] = next(runs[best], None)
        node = (best + size) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


def shared_windows(group: list[Entry], length: int = LENGTH) -> list[tuple[int, int]]:
    """Per entry of one gram, sorted by suffix, the bytes (before, from the anchor) that windows shared with others cover.

    Entries share the window that starts o bytes before the anchor if their
    reversed texts agree in o bytes and their suffixes in length - o.  (0, 0)
    if there is none.
    """
    m = len(group)
    high, low = [-1] * m, [length + 1] * m
    if m <= 6:
        for i in range(m):
            right = length
            for j in range(i + 1, m):
                right = min(right, group[j].lcp)
                left = common_prefix(group[i].before, group[j].before)
                if left + right >= length:
                    for k in (i, j):
                        high[k], low[k] = max(high[k], left), min(low[k], length - right)
    else:
        suffix_lcp = np.array([0] + [e.lcp for e in group[1:]])
        order = sorted(range(m), key=lambda i: group[i].before)
        before_lcp = np.array([0] + [common_prefix(group[order[i - 1]].before, group[order[i]].before) for i in range(1, m)])
        tops, lows, order = np.array(high), np.array(low), np.array(order)
        offsets = np.unique(np.r_[before_lcp[1:], length - np.minimum(suffix_lcp[1:], length)])
        own = np.empty(m, np.int64)
        for o in offsets[offsets <= length].tolist():
            own[order] = np.cumsum(before_lcp < o)
            _, inverse, counts = np.unique(np.cumsum(suffix_lcp < length - o) * (m + 1) + own, return_inverse=True, return_counts=True)
            hit = counts[inverse] > 1
            tops[hit], lows[hit] = np.maximum(tops[hit], o), np.minimum(lows[hit], o)
        high, low = tops.tolist(), lows.tolist()
    return [(h, length - b) if h >= 0 else (0, 0) for h, b in zip(high, low)]


def _utf8(texts: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _find_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, ths = batch["id"].to_numpy(np.int64), batch["th"].to_numpy(np.int64)
        for doc, a, lo, hi, fp, s1, s2 in text_anchors(_utf8(batch["text"])):
            if len(a):
                yield pd.DataFrame({"id": ids[doc], "th": ths[doc], "fp": fp.view(np.int64), "s1": s1.view(np.int64), "s2": s2.view(np.int64), "a": a.astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)})


def _make_runs(parts: int):
    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[Entry]] = {}
        size = 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"part": np.array(list(held), np.int32), "run": [pack_run(x) for x in held.values()]})

        for batch in batches:
            for doc, th, data, asked in zip(batch["id"], batch["th"], _utf8(batch["text"]), batch["asked"]):
                for q in asked:
                    a, stop = q["a"], q["hi"] + LENGTH
                    held.setdefault(q["fp"] % parts, []).append(Entry(data[a:stop], data[q["lo"] : a][::-1], (doc, th, a), 1 if q["n"] > 1 else 0))
                    size += stop - q["lo"] + 200
                if size > RUN_BYTES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return runs


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    runs = [unpack_run(blob) for batch in batches for blob in batch["run"]]
    found: list[tuple[int, int, int, int]] = []

    def close(group: list[Entry]) -> None:
        if len(group) > 1:
            for e, (left, right) in zip(group, shared_windows(group)):
                if right and not e.weight:
                    found.append((e.place[0], e.place[1], e.place[2] - left, e.place[2] + right))

    group: list[Entry] = []
    for e in merge_runs(runs) if runs else ():
        if group and e.lcp < GRAM:
            close(group)
            group = []
        group.append(e)
        if len(found) > 50_000:
            yield pd.DataFrame(found, columns=SPANS.names).astype({"start": "int32", "stop": "int32"})
            found.clear()
    close(group)
    if found:
        yield pd.DataFrame(found, columns=SPANS.names).astype({"start": "int32", "stop": "int32"})


def _window_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for doc, th, data, asked in zip(batch["id"], batch["th"], _utf8(batch["text"]), batch["asked"]):
            for q in asked:
                lo, hi = q["lo"], q["hi"]
                d, p = Digests(np.frombuffer(data, np.uint8)[lo : hi + LENGTH]), np.arange(hi - lo + 1)
                yield pd.DataFrame({"id": doc, "th": th, "w1": d.of(p, p + LENGTH).view(np.int64), "w2": d.of(p, p + LENGTH, 1).view(np.int64), "p": (p + lo).astype(np.int32), "weight": np.int32(2 if q["n"] > 1 else 1)})


def repeated_spans(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """(id, th, start, stop): stretches of bytes whose union is all that repeated windows cover.

    ``rows`` is (id, th, text), th a digest of the text.
    """
    spark = rows.sparkSession
    found = table(rows.mapInPandas(_find_anchors, ANCHORS), "anchors")
    kinds = found.groupBy("fp", "s1", "s2").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("id", "th", "a", "lo", "hi")])
    grams = kinds.groupBy("fp").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    kinds = table(kinds.join(grams.select("fp", F.col("kinds").alias("k")), "fp"), "contexts")
    whole = kinds.where("n > 1").select("fp", "s1", "s2")
    out = found.join(whole, ["fp", "s1", "s2"]).select("id", "th", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("stop"))

    def with_text(asked: DataFrame) -> DataFrame:
        by_doc = asked.groupBy("id", "th").agg(F.collect_list(F.struct("fp", "a", "lo", "hi", "n")).alias("asked"))
        return rows.join(by_doc, ["id", "th"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    some = with_text(kinds.where(f"k > 1 AND k <= {hot}"))
    out = out.unionByName(some.mapInPandas(_make_runs(parts), RUNS).repartition(parts, "part").mapInPandas(_merge, SPANS))
    often = kinds.where(f"k > {hot}")
    if not often.isEmpty():
        windows = with_text(often).mapInPandas(_window_digests, WINDOWS)
        twice = windows.groupBy("w1", "w2").agg(F.sum("weight").alias("n")).where("n > 1").select("w1", "w2")
        out = out.unionByName(windows.where("weight = 1").join(twice, ["w1", "w2"]).select("id", "th", F.col("p").alias("start"), (F.col("p") + LENGTH).alias("stop")))
    return out


REPORT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes in (start, stop) stretches."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(data)]
    return b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def _tied(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def spans_by_document(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(id, th, text, spans): every row with array<struct<start, stop>> of repeated stretches, null if none."""
    rows = _tied(docs)
    spans = repeated_spans(rows, hot).groupBy("id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return rows.join(spans, ["id", "th"], "left")


def repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``.

    Removes each byte of a text (as UTF-8; null: empty) that a string of
    LENGTH bytes covers which also starts anywhere else.  Rows are tied by
    (doc_id, digest of the text): repeated rows are documents of their own and
    copies of each other.  Null ids stay null; other columns are not read.
    """

    @F.pandas_udf(REPORT)
    def report(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for data, found in zip(_utf8(texts), spans):
            runs = merged([(s["start"], s["stop"]) for s in found]) if found is not None else []
            rows.append((len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(data, runs)).hexdigest()))
        return pd.DataFrame(rows, columns=REPORT.names)

    out = spans_by_document(docs, hot).select("id", report("text", "spans").alias("r"))
    return out.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "r.*")
