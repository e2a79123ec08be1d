"""Personal data: pattern spans, and terms that give protected values away.

Everything is DataFrame or SQL functions.  The patterns find emails, IP
addresses, card and phone numbers.  Information-theoretic sanitisation adds
spans: over all documents, a term that shares documents with protected values is scored by how much
of a value's information content its presence reveals,

    disclosure(t, e) = PMI(t, e) / IC(e)
    PMI = log2(n(t,e) * N / (df(t) * n(e))),  IC = log2(N / n(e)),

with n(t,e) the documents that hold both value e and t, df(t) the documents
with t, n(e) the documents with e and N all documents.  Terms at REMOVE
or more are removed, those at GENERALISE or more are replaced by a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import table

KINDS = ["email", "ip", "card", "phone"]
#: The patterns of the contract; possessive forms and run starts only save backtracking.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that any match passes.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalised": "[TERM]", "removed": ""}
#: What a term is.
TERM = r"\p{L}{3,}"
#: A term needs so many documents with a value before it can be said to reveal it.
SUPPORT, GENERALISE, REMOVE = 3, 0.6, 0.85
_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def _luhn(digits: str) -> str:
    """SQL for whether a string of digits passes Luhn's test."""
    return (
        f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN int(substring({digits}, -i, 1)) "
        f"ELSE 2 * int(substring({digits}, -i, 1)) - CASE WHEN int(substring({digits}, -i, 1)) > 4 THEN 9 ELSE 0 END END) % 10 = 0"
    )


_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": "forall(split(s.value, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_luhn(_DIGITS)}",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}


def _placed(found: str, gaps: str, kind: str, rank: int) -> str:
    """SQL for the spans of all matches, from the matches and the text between them (lengths are code points)."""
    return (
        f"aggregate(zip_with({found}, slice({gaps}, 1, size({found})), (m, g) -> named_struct('m', m, 'g', g)), struct(0 AS pos, cast(array() AS array<{_SPAN}>) AS spans), "
        f"(a, x) -> struct(a.pos + length(x.g) + length(x.m) AS pos, array_append(a.spans, named_struct('start', a.pos + length(x.g), 'rank', {rank}, "
        f"'end', a.pos + length(x.g) + length(x.m), 'kind', '{kind}', 'value', x.m)) AS spans), a -> a.spans)"
    )


def base_spans(docs: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
    """``docs`` with the valid pattern spans of each text, by start and kind: array<struct<start, rank, end, kind, value>>.

    A null text has none.  Only texts with a match are cut at their matches.
    """
    names = {k: f"_{to}_{k}" for k in KINDS}
    body = F.coalesce(F.col(text), F.lit(""))
    found = {}
    for k in KINDS:
        every = F.regexp_extract_all(body, F.lit(PATTERNS[k]), F.lit(0))
        found[names[k]] = F.when(F.contains(body, F.lit(HINTS[k])), every) if HINTS[k] else every
    out = docs.withColumns(found)
    # one digit in a run cannot be a card or make the rows of spans long: keep candidates by their length first
    parts = []
    for rank, k in enumerate(KINDS):
        m = names[k]
        gaps = f"split(coalesce(`{text}`, ''), r'{PATTERNS[k]}', -1)"
        likely = f"exists({m}, v -> length(v) >= 14)" if k == "card" else f"size({m}) > 0"
        parts.append(f"CASE WHEN {likely} THEN filter({_placed(m, gaps, k, rank)}, s -> {_VALID[k]}) ELSE cast(array() AS array<{_SPAN}>) END")
    return out.withColumn(to, F.expr(f"sort_array(concat({', '.join(parts)}))")).drop(*names.values())


def _terms(text: str = "text") -> str:
    """SQL for the distinct terms of a text, in lower case."""
    return f"array_distinct(transform(regexp_extract_all(coalesce({text}, ''), r'{TERM}', 0), t -> lower(t)))"


def _terms_with(some: DataFrame) -> DataFrame:
    """Each term of each document that holds a protected value of SUPPORT documents or more: key, copies, kind, value, n_e, term.

    ``some`` has one row (key, text, spans, copies) per different document; n_e is the number of documents with the value, copies included.
    """
    held = some.select("key", "copies", F.explode(F.expr("array_distinct(transform(spans, s -> struct(s.kind AS kind, lower(s.value) AS value)))")).alias("e")).withColumns({"kind": F.col("e.kind"), "value": F.col("e.value")})
    often = held.groupBy("kind", "value").agg(F.sum("copies").alias("n_e")).where(f"n_e >= {SUPPORT}")
    held = held.join(often, ["kind", "value"])
    return held.join(some.select("key", F.expr(_terms()).alias("terms")), "key").select("key", "copies", "kind", "value", "n_e", F.explode("terms").alias("term"))


def disclosing_terms(near: DataFrame, docs: DataFrame) -> DataFrame:
    """(kind, value, term, disclosure, action) of the terms over the thresholds.

    All four counts are of documents, copies included, per task first; the
    candidates, which share SUPPORT documents with the value, are joined to them.
    """
    joint = near.groupBy("kind", "value", "term").agg(F.sum("copies").alias("n_te"), F.first("n_e").alias("n_e")).where(f"n_te >= {SUPPORT}")
    df = docs.select(F.explode(F.expr(_terms())).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("n_all"))
    scored = joint.join(df, "term").crossJoin(F.broadcast(total))  # total is one row
    share = F.expr("CASE WHEN n_all > n_e THEN log2(n_te * n_all / (double(df) * n_e)) / log2(n_all / double(n_e)) ELSE 0 END")
    scored = scored.withColumn("disclosure", share).where(f"disclosure >= {GENERALISE}")
    return scored.select("kind", "value", "term", "disclosure", F.when(F.col("disclosure") >= REMOVE, "removed").otherwise("generalised").alias("action"))


def find_spans(docs: DataFrame, carry: list[str]) -> DataFrame:
    """row (a struct of the columns ``carry``), text, base and spans of ``docs``: pattern spans, and those with the terms that the method adds.

    Rows are tied by (doc_id, hash of the text): equal rows have equal spans.
    A term that gives a value away is added at each place in each text that holds
    the value, with the stronger action if several values ask for it.
    Term spans that touch a base span are left to it.
    """
    key = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("h"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    held = base_spans(docs.select(F.struct(*[docs[c] for c in carry]).alias("row"), "doc_id", "text"))
    some = base_spans(docs.select("doc_id", "text")).where("size(spans) > 0").select(key.alias("key"), "text", "spans")
    some = some.groupBy("key").agg(F.first("text").alias("text"), F.first("spans").alias("spans"), F.count("*").alias("copies"))
    near = table(_terms_with(table(some, "protected")), "near-terms")
    told = near.join(disclosing_terms(near, docs), ["kind", "value", "term"]).groupBy("key", "term").agg(F.max("action").alias("action"))  # removed > generalised
    told = told.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("told"))
    out = held.withColumn("key", key).join(told, "key", "left")
    found = f"regexp_extract_all(text, r'{TERM}', 0)"
    placed = _placed(found, f"split(text, r'{TERM}', -1)", "term", len(KINDS))
    added = f"transform(filter({placed}, t -> map_contains_key(told, lower(t.value))), t -> named_struct('start', t.start, 'rank', t.rank, 'end', t.end, 'kind', told[lower(t.value)], 'value', lower(t.value)))"
    out = out.withColumn("added", F.expr(f"CASE WHEN told IS NOT NULL THEN {added} ELSE cast(array() AS array<{_SPAN}>) END"))
    merged = "sort_array(concat(spans, filter(added, t -> NOT exists(spans, s -> s.start < t.end AND t.start < s.end))))"
    return out.select("row", "text", F.col("spans").alias("base"), F.expr(merged).alias("spans"))


def redact(text: Column | str = "text", spans: Column | str = "spans") -> Column:
    """The text with every span replaced by its kind's placeholder; overlapping spans make one."""
    marks = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in PLACEHOLDERS.items()) + ")"
    return F.expr(
        f"aggregate({spans}, struct(0 AS pos, '' AS done), (a, s) -> struct(greatest(a.pos, s.end) AS pos, "
        f"CASE WHEN s.start >= a.pos THEN concat(a.done, substring({text}, a.pos + 1, s.start - a.pos), {marks}[s.kind]) ELSE a.done END AS done), "
        f"a -> concat(a.done, substring({text}, a.pos + 1)))"
    )


def _listed(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, a count per kind, base_sha256 and spans of every row of ``docs``.

    Null texts are empty; repeated rows each get their row; null ids are kept.
    An empty table gives no rows.  Other columns are not read.
    """
    out = find_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]).withColumn("doc_id", F.col("row.doc_id"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"), F.expr(_listed("spans")).alias("spans"))
