"""Text functions as Catalyst expressions, each with its DuckDB twin for the oracle (``*_sql``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in a question or an index entry.
STOP_WORDS = """
a about above after again all also an and any are as at be been being below between both but by can could
did do does doing during each explain explained few for from further give had has have having he her here
hers him his how i if in into is it its itself just me mention mentioned more most my no nor not of on once
only or other our out over own pdf document file please same she should so some such tell than that the their
them then there these they this those through to too under until up very was we were what when where which
while who whom why will with would you your describe description detail details detailed summary summarize
summarise say says said stated state states according list show shown provide discuss information text
""".split()
#: Fixed value: what a token looks like.
TOKEN = r"[a-z0-9]+(?:[-./][a-z0-9]+)*"


def fold(c: Column) -> Column:
    """Case folding: lower case with the sharp s spelt out."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))


def stem(t: Column) -> Column:
    """Light English plural stripping of one token; short or mixed tokens stay."""
    n = F.length(t)
    return (
        F.when((n <= 3) | ~t.rlike("^[a-z]+$"), t)
        .when(t.endswith("ies") & (n > 4), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y")))
        .when(t.rlike("(sses|xes|zes|ches|shes)$"), F.substring(t, F.lit(1), n - 2))
        .when(t.endswith("s") & ~t.rlike("(ss|us|is)$"), F.substring(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def stop_list() -> Column:
    return F.array(*[F.lit(w) for w in STOP_WORDS])


def stems(c: Column) -> Column:
    """Stems of all tokens, in order, repeats included."""
    return F.transform(tokens(c), stem)


def index_terms(c: Column) -> Column:
    """Terms under which an entry is indexed: stop words are dropped after stemming, single characters stay."""
    return F.filter(stems(c), lambda t: ~t.isin(STOP_WORDS))


def query_terms(c: Column) -> Column:
    """Different terms of a question: stop words and single characters are dropped before stemming."""
    return F.array_distinct(F.transform(F.filter(tokens(c), lambda t: ~t.isin(STOP_WORDS) & (F.length(t) > 1)), stem))


def normalize_title(c: Column) -> Column:
    """Folded words of a title, single-spaced."""
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}_]+", " "))


def sentences(c: Column) -> Column:
    """Sentences of more than 20 characters: text is cut behind . ! ? followed by space, and at line ends."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), F.trim), lambda s: F.length(s) > 20)


def best_sentence(c: Column, terms: Column, limit: int = 240) -> Column:
    """The sentence that mentions most of ``terms``, footnotes last, near 160 characters first, the earliest of equals."""

    def rank(s: Column, i: Column) -> Column:
        footnote = s.rlike(r"^\d{1,3}\s") | F.contains(s, F.lit("http")) | s.rlike(r"\b(19|20)\d\d\.$")
        return F.struct((~footnote).cast("int").alias("a"), F.size(F.array_intersect(stems(s), terms)).alias("b"), (-F.abs(F.length(s) - 160)).alias("c"), (-i).alias("d"), s.alias("s"))

    found = sentences(c)
    best = F.array_max(F.transform(found, rank))["s"]
    cut = F.regexp_replace(F.substring(best, 1, limit), r"\s\S*$", "")
    return F.when(F.size(found) == 0, F.substring(c, 1, limit)).when(F.length(best) <= limit, best).otherwise(F.concat(cut, F.lit("…")))


def plain_key(c: Column) -> Column:
    """Key of a running line: folded, digits as #."""
    return F.trim(F.regexp_replace(fold(c), r"\d+", "#"))


# ---- DuckDB twins


def fold_sql(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all({fold_sql(x)}, '{TOKEN}')"


def stem_sql(t: str) -> str:
    return (
        f"CASE WHEN length({t}) <= 3 OR NOT regexp_full_match({t}, '[a-z]+') THEN {t} "
        f"WHEN ends_with({t}, 'ies') AND length({t}) > 4 THEN left({t}, length({t}) - 3) || 'y' "
        f"WHEN regexp_matches({t}, '(sses|xes|zes|ches|shes)$') THEN left({t}, length({t}) - 2) "
        f"WHEN ends_with({t}, 's') AND NOT regexp_matches({t}, '(ss|us|is)$') THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def normalize_sql(x: str) -> str:
    return f"trim(regexp_replace({fold_sql(x)}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
