"""What a question names of a document's structure: one scan gives mentions, one join on (doc, key) finds them.

Every way to name a section is a key: its label and number, its place among
the units, its number path, its identifier, its name.  ``addresses`` lists the keys of all
sections of all documents, ``scan`` the keys of a question's mentions, the
preferred one first.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.numbers import SHORT_NOUNS, SINGULAR, parse_number, singular
from . import signals as S
from .structure import CONTENT_NOUNS

MENTION = T.StructType([T.StructField("o", T.IntegerType()), T.StructField("what", T.StringType()), T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("name", T.StringType()), T.StructField("may_miss", T.BooleanType())])
SCAN = T.StructType([T.StructField("noun", T.StringType()), T.StructField("number_range", T.ArrayType(T.IntegerType())), T.StructField("mentions", T.ArrayType(MENTION))])
#: Missing numbers of a range that are told.
MOST_MISSING = 50


def facts(sections: DataFrame) -> DataFrame:
    """(doc, nouns, labelled, numbered, title, unit_noun): what a scan has to know of each document."""
    unit = F.col("ordinal") > 0
    return sections.groupBy("doc").agg(
        F.collect_set("noun").alias("nouns"),
        F.collect_set(F.when(F.col("number").isNotNull(), F.col("noun"))).alias("labelled"),
        F.coalesce(F.bool_or(F.when(unit, F.col("number").isNotNull())), F.lit(False)).alias("numbered"),
        F.first("doc_title", ignorenulls=True).alias("title"),
    )


def names(sections: DataFrame) -> DataFrame:
    """(doc, idx, name, ancestors, terms) of the sections that a question can quote."""
    plain = F.regexp_replace(X.normalize_title(F.col("name")), "^(the|a|an) ", "")
    rows = sections.where("NOT coalesce(matter, false)").select("doc", "idx", plain.alias("plain"), "ancestors", X.query_terms(F.col("name")).alias("terms"))
    return rows.where((F.length("plain") >= 4) & ~F.col("plain").isin(sorted(S.GENERIC_TITLES))).select("doc", "idx", F.col("plain").alias("name"), "ancestors", "terms")


def addresses(sections: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """(doc, key, idx, terms): every key under which a section (or, by its place, a caption) is found, with the terms of its name."""
    key = lambda kind, *cols: F.concat_ws("|", F.lit(kind), *[F.col(c).cast("string") for c in cols]).alias("key")
    by_noun = sections.where("noun IS NOT NULL AND number IS NOT NULL")
    longest = by_noun.groupBy("doc", "noun", "number").agg(F.max_by("idx", F.struct(F.col("page_end") - F.col("page_start"), "idx")).alias("idx"), F.min("idx").alias("first"))
    units = sections.where("ordinal > 0").join(facts(sections).select("doc", "numbered"), "doc").withColumn("n", F.when(F.col("numbered"), F.col("number")).otherwise(F.col("ordinal")))
    paths = sections.where("number_path IS NOT NULL").groupBy("doc", "number_path").agg(F.min("idx").alias("idx"), F.max("idx").alias("last"))
    pages = units.select("doc", "idx", F.explode(F.sequence("page_start", F.greatest("page_start", "page_end"))).alias("page"))
    parts = [
        longest.select("doc", key("label", "noun", "number"), "idx"),
        longest.select("doc", key("first", "noun", "number"), F.col("first").alias("idx")),
        by_noun.select("doc", key("each", "noun", "number"), "idx"),
        units.where("n IS NOT NULL").groupBy("doc", "n").agg(F.min("idx").alias("idx")).select("doc", key("unit", "n"), "idx"),
        units.where("n IS NOT NULL").select("doc", key("units", "n"), "idx"),
        units.select("doc", key("place", "ordinal"), "idx"),
        units.groupBy("doc").agg(F.max_by("idx", "ordinal").alias("idx")).select("doc", F.lit("place|last").alias("key"), "idx"),
        paths.select("doc", key("path", "number_path"), "idx"),
        paths.where("number_path LIKE '%.%'").select("doc", key("dotted", "number_path"), F.col("last").alias("idx")),
        sections.where("ident IS NOT NULL").groupBy("doc", F.lower("ident").alias("ident")).agg(F.max("idx").alias("idx")).select("doc", key("ident", "ident"), "idx"),
        pages.select("doc", key("page", "page"), "idx"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.join(sections.select("doc", "idx", X.query_terms(F.col("name")).alias("terms")), ["doc", "idx"]).select("doc", "key", F.col("idx").cast("int").alias("idx"), "terms")
    if captions is not None:
        first = captions.groupBy("doc", "kind", F.lower("number").alias("low")).agg(F.min("n").alias("idx"))
        out = out.unionByName(first.select("doc", key("caption", "kind", "low"), F.col("idx").cast("int").alias("idx"), F.lit(None).cast("array<string>").alias("terms")))
    return out


# ---- the scan


def _caption(m: re.Match, _: dict) -> list[tuple]:
    word = m["kind"].casefold().rstrip(".")
    kind = S.CAPTION_KINDS.get(word) or S.CAPTION_KINDS.get(word.removesuffix("s"), word.removesuffix("s"))
    return [([f"caption|{kind}|{m['number'].casefold()}"], f"{kind} {m['number']}", True)]


def _numbered(noun: str | None, n: int) -> list[str]:
    """Keys of "<noun> <number>": so labelled; else, if it is a division, a unit of that number or place; else a number path."""
    keys = [f"label|{noun}|{n}"]
    if noun not in CONTENT_NOUNS:
        keys.append(f"unit|{n}")
        if noun in (None, "section", "chapter", "part"):
            keys.append(f"path|{n}")
    return keys


def _range(m: re.Match, doc: dict) -> list[tuple]:
    ends, noun = [parse_number(m["a"]), parse_number(m["b"])], singular(m["noun"])
    if None in ends:
        return []
    kind = f"each|{noun}" if noun in doc["labelled"] else "units"
    return [([f"{kind}|{n}"], str(n), True) for n in range(min(ends), max(ends) + 1)]


def _listed(m: re.Match, _: dict) -> list[tuple]:
    noun, numbers = bare(m["noun"]), map(parse_number, re.split(r"\s*(?:,|&|\band\b|\bor\b)\s*", m["nums"]))
    return [(_numbered(noun, n), str(n), noun not in CONTENT_NOUNS) for n in numbers if n is not None]


def _lettered(m: re.Match, _: dict) -> list[tuple]:
    noun = singular(m["noun"])
    return [([f"first|{noun}|{ord(x) - 64}", f"path|{x}"], x, True) for x in re.findall(r"\b[A-Z]\b", m["letters"].upper())]


def _number_asked(m: re.Match, _: dict) -> list[tuple]:
    n = parse_number(m["num"])
    return [] if n is None else [(_numbered(singular(m["noun"]), n), str(n), True)]


def _placed(m: re.Match, _: dict) -> list[tuple]:
    word = m["ord"].casefold()
    if word in ("last", "final"):
        return [(["place|last"], word, False)]
    n = parse_number(re.sub("(?:st|nd|rd|th)$", "", word)) if word[0].isdigit() else parse_number(word)
    return [([f"place|{n}"], str(n), True)] if n else []


def _path(m: re.Match, _: dict) -> list[tuple]:
    asked = re.search(r"\b(?:section|clause|sub-?section|paragraph|para)\s+$", m.string[: m.start()], re.I)
    return [([f"dotted|{m[1].upper()}"], m[1], bool(asked))]


def _identifier(m: re.Match, _: dict) -> list[tuple]:
    return [([f"ident|{m[0].casefold()}"], m[0], False)]


def bare(noun: str) -> str | None:
    return singular(re.sub("^sub-?", "", noun, flags=re.I))


#: Kind of mention, its pattern, its reader, and whether only the first counts.
GRAMMAR = [
    ("range", S.RANGE, _range, True), ("list", S.REF, _listed, False), ("letter", S.LETTER_REF, _lettered, False), ("asked", S.REVERSED, _number_asked, False),
    ("place", S.ORDINAL_REF, _placed, False), ("path", S.DOTTED, _path, False), ("ident", S.IDENTIFIER, _identifier, False),
]


def read_mentions(text: str, doc: dict) -> tuple[str | None, list[int] | None, list[tuple]]:
    """(noun, range, mentions) of one question; mentions as in MENTION."""
    found = [("caption", *x) for m in S.CAPTION_REF.finditer(text) for x in _caption(m, doc)]
    plain, noun, bounds, taken = S.CAPTION_REF.sub(" ", text), None, None, (0, 0)
    for kind, pattern, reader, once in GRAMMAR:
        for m in list(pattern.finditer(plain))[: 1 if once else None]:
            if kind == "list" and taken[0] <= m.start() < taken[1]:
                continue
            told = reader(m, doc)
            if kind == "range" and told:
                taken, bounds = m.span(), [int(told[0][1]), int(told[-1][1])]
            if "noun" in pattern.groupindex and (kind != "range" or told):
                noun = noun or bare(m["noun"])
            found += [("range" if kind == "range" else "unit", *x) for x in told]
    return noun, bounds, [(i, what, keys, name, may) for i, (what, keys, name, may) in enumerate(found)]


@F.pandas_udf(SCAN)
def scan(texts: pd.Series, labelled: pd.Series) -> pd.DataFrame:
    """The mentions of each question; ``labelled`` are the nouns with numbers of its document."""
    rows = []
    for text, nouns in zip(texts, labelled):
        noun, bounds, found = read_mentions(text or "", {"labelled": set(nouns) if nouns is not None else set()})
        rows.append((noun, bounds, [dict(zip(MENTION.names, x)) for x in found]))
    return pd.DataFrame(rows, columns=SCAN.names)


def resolved(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """(qid, units, named, missing, caption_at): what the mentions of ``scanned`` (qid, doc, mentions) mean.

    Of a mention's keys the first that the document has counts; a mention that
    means nothing is missing, if it may be.
    """
    rows = scanned.select("qid", "doc", F.explode("mentions").alias("m")).select("qid", "doc", "m.*")
    tried = rows.select("qid", "doc", "o", F.posexplode("keys").alias("choice", "key")).join(known, ["doc", "key"])
    best = tried.groupBy("qid", "o", "choice").agg(F.array_sort(F.collect_set("idx")).alias("idx"), F.flatten(F.collect_list("terms")).alias("terms"))
    best = best.groupBy("qid", "o").agg(F.min_by(F.struct("idx", "terms"), "choice").alias("b")).select("qid", "o", "b.idx", "b.terms")
    rows = rows.join(best, ["qid", "o"], "left").withColumn("there", F.col("idx").isNotNull())
    place = F.when(F.col("what") == "range", F.struct(F.lit(-1).alias("a"), F.col("idx").alias("idx"))).otherwise(F.struct(F.col("o").alias("a"), F.col("idx").alias("idx")))
    lost = Window.partitionBy("qid", "what", "there").orderBy("o")
    rows = rows.withColumn("nth", F.row_number().over(lost))
    told = ~F.col("there") & F.col("may_miss") & ((F.col("what") != "range") | (F.col("nth") <= MOST_MISSING))
    unit, caption = F.col("there") & (F.col("what") != "caption"), F.col("there") & (F.col("what") == "caption")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["idx"])
    return rows.groupBy("qid").agg(
        F.array_distinct(F.flatten(in_order(F.when(unit, place)))).alias("units"),
        F.array_distinct(F.flatten(F.collect_list(F.when(unit, F.col("terms"))))).alias("named"),
        F.transform(F.array_sort(F.collect_list(F.when(told, F.struct("o", "name")))), lambda x: x["name"]).alias("missing"),
        F.array_distinct(F.flatten(in_order(F.when(caption, place)))).alias("caption_at"),
    )


# ---- names


def _grams(asked: DataFrame, sizes) -> DataFrame:
    """Runs of a question's words: (qid, doc, size, gram, at)."""
    rows = asked.withColumn("words", F.filter(F.split(X.normalize_title(F.col("text")), " "), lambda w: w != "")).where(F.size("words") > 0)
    rows = rows.withColumn("size", F.explode(sizes)).withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - F.col("size")))))
    return rows.select("qid", "doc", "size", "at", F.array_join(F.expr("slice(words, at + 1, size)"), " ").alias("gram"), F.array_join("words", " ").alias("norm"))


def quoted(asked: DataFrame, quotable: DataFrame) -> DataFrame:
    """(qid, quoted, named): sections whose names a question has as whole words (or their plural).

    A section that holds another quoted one is left out; of names that overlap
    in the question the longer counts, then the earlier; in order of place.
    """
    plain = quotable.where(~F.col("name").isin(sorted({*SINGULAR, *SHORT_NOUNS})))
    forms = plain.withColumn("gram", F.explode(F.array("name", F.concat("name", F.lit("s")))))
    longest = forms.groupBy("doc").agg(F.max(F.size(F.split("gram", " "))).alias("longest"))
    rows = _grams(asked.join(longest, "doc"), F.sequence(F.lit(1), F.col("longest"))).distinct()
    start = F.expr("locate(concat(' ', gram, ' '), concat(' ', norm, ' ')) - 1")
    hits = rows.join(forms, ["doc", "gram"]).withColumn("start", start).withColumn("stop", F.col("start") + F.length("gram") + 2)
    one = hits.groupBy("qid", "idx").agg(F.min_by(F.struct("start", "stop", "ancestors", "terms"), F.struct("start", -F.col("stop"))).alias("h"))
    sets = one.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((F.col("h.start") - F.col("h.stop")).alias("less"), F.col("h.start").alias("start"), F.col("h.stop").alias("stop"), "idx", F.col("h.ancestors").alias("above"), F.col("h.terms").alias("terms")))).alias("hits"))
    inner = F.expr("filter(hits, h -> NOT exists(hits, o -> o.idx <> h.idx AND array_contains(o.above, h.idx)))")
    kept = F.expr("aggregate(inner, slice(inner, 1, 0), (k, h) -> IF(forall(k, o -> h.stop <= o.start OR o.stop <= h.start), concat(k, array(h)), k))")
    ordered = F.transform(F.array_sort(F.transform("kept", lambda h: F.struct(h["start"].alias("start"), h["idx"].alias("idx")))), lambda h: h["idx"])
    return sets.withColumn("inner", inner).withColumn("kept", kept).select("qid", ordered.alias("quoted"), F.flatten(F.transform("kept", lambda h: h["terms"])).alias("quoted_named"))


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def nearly_quoted(asked: DataFrame, quotable: DataFrame, least: float = 0.88) -> DataFrame:
    """(qid, nearly, nearly_named): the section whose name of two to six words is most like a run of as many words of the question."""
    rows = quotable.withColumn("size", F.size(F.split("name", " "))).where((F.length("name") >= 8) & F.col("size").between(2, 6)).select("doc", "idx", "name", "size", "terms")
    pairs = _grams(asked, F.sequence(F.lit(2), F.lit(6))).join(rows, ["doc", "size"]).where(F.abs(F.length("gram") - F.length("name")) <= 3)
    like = pairs.withColumn("ratio", ratio("gram", "name")).where(F.col("ratio") >= least)
    return like.groupBy("qid").agg(F.min_by(F.struct("idx", "terms"), F.struct(-F.col("ratio"), "idx", "at")).alias("b")).select("qid", F.array("b.idx").alias("nearly"), F.col("b.terms").alias("nearly_named"))


@F.pandas_udf(T.BooleanType())
def nothing_left(rest: pd.Series, named: pd.Series) -> pd.Series:
    """Whether every word is one of the named ones or much like one."""

    def one(words, known) -> bool:
        return all(w in known or any(difflib.SequenceMatcher(None, w, n).ratio() >= 0.8 for n in known) for w in words)

    return pd.Series([one(list(r) if r is not None else [], set(n) if n is not None else set()) for r, n in zip(rest, named)], dtype=bool)
