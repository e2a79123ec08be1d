"""Words and patterns by which a question shows what it asks for, as fixed values, and as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import NUMBER_WORD, ORDINALS, SINGULAR, SHORT_NOUNS, TENTHS, singular
from ..functions.text import stem, query_terms
from .structure import CONTENT_NOUNS

# ---- Fixed values: the words and patterns that signal an intent.
_CONTENT = "|".join(sorted({w for pair in CONTENT_NOUNS.items() for w in pair}, key=len, reverse=True))
UNIT = (
    r"(?:chapters?|sections?|sub-?sections?|topics?|stor(?:y|ies)|parts?|units?|lessons?|modules?|articles?|episodes?|"
    rf"cases?|annex(?:es|ures?)?|appendix|appendices|schedules?|clauses?|ch\.|sec\.|art\.|{_CONTENT})"
)
NUM = rf"(?:\d{{1,4}}|[ivxlcdm]{{1,7}}\b|{NUMBER_WORD})"
ORDINAL = rf"(?:{'|'.join([*ORDINALS, *TENTHS])}|last|final)"
DOC = r"(?:document|pdf|file|book|report|paper|text|doc|material|manual|guide|content|upload|policy|guideline|guidelines|framework|programme|program|strategy|plan|publication|study)"
P = {
    "heading": r"\b(?:headings?|headlines?|titles?|sub-?headings?)\b",
    "caption_noun": r"\b(?:tables?|figures?|figs?\.?|boxes|box|exhibits?|charts?|graphs?|diagrams?|illustrations?)\b",
    "caption_plural": r"\b(?:tables|figures|figs|boxes|exhibits|charts|graphs|diagrams|illustrations)\b",
    "pages_word": r"\bpages\b",
    "sub_word": r"\bsub-?(?:sections?|headings?|topics?|parts?)\b",
    "plural_noun": r"\b(?:chapters|sections|subsections|sub-sections|topics|stories|parts|units|lessons|modules|articles|episodes|cases|annexes|annexures|appendices|schedules|clauses|headings|headlines|titles|subheadings|sub-headings)\b",
    "count": r"\b(?:how many|number of|count|total)\b",
    "list": r"\b(?:list|enumerate|show|name|names|what are|which are|which|give me|tell me|table of contents|toc|outline|structure|index of|all|every|each)\b",
    "outline": r"\b(?:table of contents|contents|toc|outline|structure|structured|organi[sz]ed|organi[sz]ation|layout)\b",
    "explain": r"\b(?:explain|explanation|summari[sz]e|summary|summaries|describe|overview|elaborate|discuss|walk me through|tell me about|what happens|what is (?:it|this|that|[\w\s]{0,60}) about|what's (?:it|this|[\w\s]{0,60}) about|go through|details? (?:of|about)|break ?down|recap|key points|main points|in detail|cover(?:s|ed)?|brief)\b",
    "lookup": r"\b(?:name|title|heading|headline|called|titled|which|what is the name)\b",
    "compare": r"\b(?:compare|comparison|comparing|contrast|difference|differences|differ|differs|versus|vs\.?|similarit(?:y|ies)|distinguish)\b",
    "analysis": r"\b(?:why|analy[sz]e|analysis|evaluate|evaluation of|assess|assessment of|implications?|impacts?|effects? of|strengths?|weaknesses?|pros and cons|advantages?|disadvantages?|trade-?offs?|critically|critique|justify|justification|rationale|reasons?|how effective|how well|to what extent|relationship between|relate to|consequences?|risks? of|benefits? of|gaps?|interpret|significance|what can be concluded|infer)\b",
    "enumerate": r"\b(?:list (?:all|every|the)|all (?:the )?|every|each of the|what are all|enumerate|name (?:all|the)|what are the (?:\w+ )?(?:types|kinds|categories|steps|requirements|principles|criteria|components|elements|functions|characteristics|stages|phases|objectives|pillars|priorities|measures|actions|options|features|conditions|obligations|rights|duties|roles|areas|recommendations|findings))\b",
    "question": r"\b(?:what|how|why|when|where|which|who|whom|whose|is|are|does|do|can|could|should|will|explain|describe|list|summari[sz]e|compare)\b",
    "follow_up": r"\b(?:it|its|this|that|these|those|they|them|their|he|she|his|her|him|same|above|previous|more|further|else|former|latter)\b",
    "detailed": r"\b(?:in detail|detailed|elaborate|elaborately|comprehensive|comprehensively|thorough|thoroughly|in depth|in-depth|explain fully|step by step|all (?:the )?details|everything about)\b",
    "brief": r"\b(?:brief|briefly|short|shortly|concise|concisely|in one (?:line|sentence|word)|in (?:a )?few (?:words|lines|sentences)|tl;?dr|quick|quickly|gist|in \d+(?:\s*(?:-|–|to)\s*\d+)? (?:points|bullets|bullet points|lines|sentences|words))\b",
    "whole": r"\b(?:summari[sz]e|summary of|overview of|gist of|key points of|main points of|recap of)\s+(?:the\s+|this\s+)?(?:entire|whole|full|complete|overall)\b",
    "points": r"\b\d+\s*(?:-|–|to)?\s*\d*\s*(?:points|bullets)\b",
}
OVERVIEW = [
    rf"\bwhat\b.*\b(?:does|do|is|are)\b.*\b(?:this|the|uploaded|given|my)\s+{DOC}s?\b.*\b(?:contains?|covers?|includes?|discuss(?:es)?|talks? about|consists? of|about|deals? with|explains?)\s*[?.!]*$",
    rf"\bwhat(?:'s| is| are)\s+(?:inside|in)\s+(?:this|the|my)\s+{DOC}",
    rf"\b(?:overview|summary|summari[sz]e|gist|synopsis|outline|main (?:ideas?|topics?|themes?|points?|messages?)|key (?:topics?|themes?|points?|ideas?|messages?|takeaways?))\b.*\b(?:this|the|whole|entire|uploaded|full|complete)\s+{DOC}s?\b",
    rf"\bsummari[sz]e\s+(?:this|the|it all|everything|all of it)(?:\s+(?:whole|entire))?(?:\s+{DOC})?\s*[?.!]*$",
    r"^(?:please\s+)?(?:give me |provide |write )?(?:an?\s+)?(?:overview|summary|gist|synopsis|tl;?dr)\s*[?.!]*$",
    r"\bwhat\s+(?:is|are)\s+(?:the\s+)?(?:main|key|major|central|overall)\s+(?:topics?|themes?|ideas?|points?|subjects?|content|messages?|takeaways?)\b\s*(?:of\s+(?:this|the)\s+\w+)?\s*[?.!]*$",
    rf"\btell me about\s+(?:this|the)\s+{DOC}\s*[?.!]*$",
    rf"\bwhat\s+(?:kind|type|sort)\s+of\s+{DOC}",
    rf"\bwhat\s+(?:is|'s)\s+(?:this|the)\s+{DOC}\s+(?:all\s+)?about\b",
]
LOCATE = [
    rf"\b(?:which|what)\s+(?:{UNIT}|pages?|headings?)\b.*\b(?:discuss|cover|talk|mention|describ|explain|deal|address|defin|contain|refer|about|regarding|include|has|have|focus|list|set out|specif|relat|concern|apply|applies|involv)",
    r"\bwhere\b.*\b(?:mentioned|discussed|described|defined|covered|explained|stated|found|located|written|talked about|addressed|referenced|specified|set out|listed|introduced)\b",
    rf"\bin\s+(?:which|what)\s+(?:{UNIT}|pages?)\b",
    r"\bon\s+(?:which|what)\s+pages?\b",
    r"\bwhere\s+(?:can|do|could|would)\s+i\s+(?:find|read|look)\b",
]
LOCATE_WORDS = """which what where section sections chapter chapters part parts page pages annex appendix article clause heading discuss discusses
discussed cover covers covered talk talks mention mentions mentioned describe describes described explain explains explained deal deals address
addresses addressed define defines defined contain contains refer refers referenced about regarding include includes stated found located written
listed specified introduced find read look can could would there document pdf""".split()
STRUCTURE_WORDS = """many much total count number numbers numbered numerical numeric order ordered sequence sequential complete full entire whole
name names title titles heading headings headline headlines subheading subheadings subsection subsections there present available contain contains
include includes belong belongs altogether overall exist exists find found give get all every each one list enumerate show which have has written
labelled labeled called table tables contents toc outline structure structured organised organized organisation organization layout page pages
chapter chapters section sections topic topics story stories part parts unit units lesson lessons module modules article articles episode episodes
case cases annex annexes appendix appendices schedule schedules clause clauses figure figures fig figs box boxes exhibit exhibits chart charts graph
graphs diagram diagrams illustration illustrations wise sub inside under within document documents paper report publication book file doc text manual
guide pdf main major principal key important""".split()
ROLE_QUERIES = [
    (r"\b(?:main|key|major|principal|overall)\s+(?:findings?|results?|outcomes?)\b|\bfindings\b|\bwhat (?:did|does) (?:the )?(?:study|paper|report|research|evaluation) find\b", "results summary conclusion"),
    (r"\bconclu(?:sion|sions|de|ded|ding)\b", "conclusion summary"),
    (r"\brecommend(?:s|ed|ation|ations)?\b", "recommendations conclusion"),
    (r"\b(?:objectives?|aims?|goals?|purpose)\b", "objectives introduction summary"),
    (r"\b(?:methodology|methods?|research design|how (?:was|were) (?:the )?(?:study|data|research|experiments?) (?:conducted|done|carried out|collected))\b", "methods"),
    (r"\b(?:limitations?|weaknesses?|shortcomings?|constraints?)\b", "limitations discussion"),
    (r"\b(?:budget|funding|financing|costs?|financial|resources? required)\b", "budget"),
    (r"\b(?:definitions?|defined|meaning of|what is meant by|terminology|stands? for|acronyms?|abbreviations?)\b", "definitions"),
    (r"\b(?:governance|roles? and responsibilit\w+|who is responsible|accountab\w+|oversight|institutional arrangements?)\b", "governance"),
    (r"\b(?:monitoring|indicators?|kpis?|targets?|reporting requirements?|results framework|m\s*&\s*e)\b", "monitoring"),
    (r"\b(?:implementation|timeline|timeframe|roadmap|work ?plan|phases?|milestones?|next steps)\b", "implementation conclusion"),
    (r"\b(?:background|context|rationale|problem statement|why (?:was|is) (?:this|the) (?:policy|programme|program|framework|study))\b", "introduction"),
    (r"\b(?:key points|key messages|takeaways|highlights|in short|tl;?dr|main points)\b", "summary conclusion"),
]
GENERIC_TITLES = {"summary", "overview", "contents", "index", "notes", "outline", "table of contents", "abstract", "introduction", "conclusion", "background"}
_AFTER = r"(?:\s+(?:{0})\s+(.+?))?"
_RESPECTS = "in terms of|regarding|with respect to|based on|on|for|in relation to"
#: Groups: one side, the other side, and (in the first two) the respect in which they are compared.
COMPARISONS = [
    rf"\bcompar(?:e|ing|ison of)\s+(?:the\s+)?(.+?)\s+(?:and|with|to|against|vs\.?|versus)\s+(?:the\s+)?(.+?){_AFTER.format(_RESPECTS + '|across')}\s*[?.!]*$",
    rf"\bdifferences?\s+between\s+(?:the\s+)?(.+?)\s+and\s+(?:the\s+)?(.+?){_AFTER.format(_RESPECTS)}\s*[?.!]*$",
    r"\bhow\s+(?:does|do|is|are)\s+(?:the\s+)?(.+?)\s+(?:differ|compare|contrast|relate)\w*\s*(?:from|with|to|against)?\s+(?:the\s+)?(.+?)\s*[?.!]*$()",
    r"^(?:the\s+)?([^?]+?)\s+(?:vs\.?|versus)\s+(?:the\s+)?([^?]+?)\s*[?.!]*$()",
]
RANGE = re.compile(rf"\b(?:from\s+)?(?P<noun>{UNIT})\s+(?P<a>{NUM})\s*(?:-|–|—|to|through|thru|till|until)\s*(?:(?:{UNIT})\s+)?(?P<b>{NUM})\b", re.I)
REF = re.compile(rf"\b(?P<noun>{UNIT})\s+(?:(?:number|no\.?|#)\s*)?(?P<nums>\d{{1,4}}(?:\s*(?:,|&|\band\b|\bor\b)\s*\d{{1,4}})*|{NUM})\b(?![.\-]\d)(?!\s*(?:st|nd|rd|th)\b)", re.I)
LETTER_REF = re.compile(r"\b(?P<noun>annex(?:es|ures?)?|appendix|appendices|schedules?)\s+(?P<letters>[a-z](?:\s*(?:,|&|and|or)\s*[a-z])*)\b(?!\.\d)", re.I)
REVERSED = re.compile(rf"\b(?:which|what)\s+(?P<noun>{UNIT})\s+is\s+(?:number\s+|no\.?\s*|#)?(?P<num>{NUM})\b", re.I)
ORDINAL_REF = re.compile(rf"\b(?:the\s+)?(?P<ord>\d{{1,4}}(?:st|nd|rd|th)|{ORDINAL})\s+(?P<noun>{UNIT})\b", re.I)
DOTTED = re.compile(r"(?<![\w.])((?:\d{1,3}|[A-Z])(?:\.\d{1,3})+)(?![\w.]|\.\d)", re.I)
PAGES = r"\b(?:pages?|pg\.?|pp?\.)\s*(\d{1,4})(?:\s*(?:-|–|—|to|through|and)\s*(\d{1,4}))?\b"
CAPTION_REF = re.compile(r"\b(?P<kind>tables?|figures?|figs?\.?|box(?:es)?|exhibits?|charts?)\s+(?P<number>(?:[a-z][.\-])?\d{1,3}(?:[.\-]\d{1,3})*|[a-z])\b(?!\s*(?:of|%))", re.I)
IDENTIFIER = re.compile(r"\b[A-Za-z]{1,6}-\d{1,4}(?:\(\d{1,3}\))?|\b[A-Za-z]{1,6}\s\d{1,2}\.\d{1,2}\b")
SPLIT_QUESTIONS = r"\?\s+|;\s+|\n+|\s+(?:and|also|plus|as well as)\s+(?=(?:what|how|why|when|where|which|who|whom|whose|is|are|does|do|can|could|should|list|describe|explain|summari[sz]e|give|tell)\b)"
SPLIT_FACETS = r"\s*,\s*(?:and\s+|as well as\s+)?|\s+(?:and|as well as|along with|plus)\s+"
LEADING_ASK = r"^(?:(?:please\s+)?(?:tell me|explain|describe|list|summari[sz]e|give me|provide|outline|show me)\s+(?:about\s+)?|what\s+(?:are|is|were|was)\s+|how\s+(?:are|is|do|does)\s+|what\s+does\s+the\s+\w+\s+say\s+about\s+)(?:the\s+)?"
SHARED_TAIL = r"\s+((?:of|for|in|under|within|across|regarding|on)\s+(?:the|this|its)?\s*[\w\s-]{3,60})$"
ENTITY_LEAD = r"^(?:the\s+)?(?:roles?|functions?|purposes?|uses?|importance|significance|definitions?|meaning|features?|responsibilities|objectives?|scope)\s+of\s+(?:the\s+)?"
ENTITY_TAIL = r"\s+(?:in|within|under|according to|as described in|as defined in|from)\s+(?:the|this)\s+[\w\s-]{2,60}$"
LISTED_NOUN = r"^(.+?)\s+([A-Za-z]{3,}s)(\s+(?:of|in|for|under|within)\b.*)?$"
CAPTION_KINDS = {"fig": "figure", "chart": "figure", "graph": "figure", "diagram": "figure", "illustration": "figure", "boxes": "box"}
ARTICLE = r"^(?:the|a|an)\s+"


def rx(pattern: str) -> str:
    """A pattern for Spark's engine: any case, Unicode classes."""
    return f"(?iU){pattern}"


def found(text: Column, pattern: str) -> Column:
    return text.rlike(rx(pattern))


def signals(low: Column) -> Column:
    """struct of one boolean per pattern of ``P``."""
    return F.struct(*[found(low, p).alias(name) for name, p in P.items()])


# ---- words

_FORMS = {*SINGULAR, *SHORT_NOUNS}
#: Words (or their plurals) that name a division of a document.
DIVISION_WORDS = sorted(w for w in _FORMS | {f[:-1] for f in _FORMS if f.endswith("s")} if (n := singular(w) or singular(w + "s")) and n not in CONTENT_NOUNS)


def noun_of(word: Column) -> Column:
    """The known noun that a word is a form of, without a leading "sub"."""
    known = F.create_map(*[F.lit(x) for w in sorted(_FORMS) for x in (w, singular(w))])
    return F.element_at(known, F.regexp_replace(F.lower(word), r"^sub-?|\.$", ""))


def caption_kind(word: Column) -> Column:
    one = F.regexp_replace(F.lower(word), r"\.$", "")
    kinds = F.create_map(*[F.lit(x) for kv in CAPTION_KINDS.items() for x in kv])
    single = F.regexp_replace(one, "s$", "")
    return F.coalesce(F.element_at(kinds, one), F.element_at(kinds, single), single)


def _stems(words: list[str]) -> Column:
    return F.array_distinct(F.transform(F.array(*[F.lit(w) for w in words]), stem))


def structure_words() -> Column:
    return _stems(STRUCTURE_WORDS)


def locate_words() -> Column:
    return _stems(LOCATE_WORDS)


def content(text: Column, ignored: Column) -> Column:
    """Terms of a question that are not about the document's structure."""
    parts = F.flatten(F.transform(query_terms(text), lambda t: F.transform(F.filter(F.split(t, "[-./]"), lambda p: p != ""), stem)))
    return F.filter(parts, lambda t: ~F.array_contains(ignored, t) & ~t.rlike(r"^\d+(st|nd|rd|th)?$") & ~t.isin(DIVISION_WORDS))


# ---- parts of open questions


def _terms_in(x: Column) -> Column:
    return F.size(query_terms(x)) > 0


def compared(text: Column) -> Column:
    """struct<items, aspect>: what a comparison compares and in which respect; null if the text compares nothing."""

    def by(pattern: str) -> Column:
        side = lambda g: F.regexp_replace(F.regexp_replace(F.regexp_extract(text, rx(pattern), g), "^[ ,]+|[ ,]+$", ""), rx(ARTICLE), "")
        lead = F.regexp_extract(side(1), rx(ENTITY_LEAD), 0)
        left, right = F.substr(side(1), F.length(lead) + 1), F.regexp_replace(side(2), rx(ENTITY_TAIL), "")
        said = F.trim(F.regexp_extract(text, rx(pattern), 3))
        aspect = F.when((said == "") & (lead != ""), F.regexp_replace(F.trim(lead), rx(r"^(?:the\s+)?|\s+of(?:\s+the)?$"), "")).otherwise(said)
        last = F.coalesce(F.nullif(F.regexp_extract(right, rx(LISTED_NOUN), 1), F.lit("")), right)
        noun = F.regexp_replace(F.regexp_extract(right, rx(LISTED_NOUN), 2), "[sS]$", "")
        listed = F.concat(F.filter(F.split(left, r"\s*,\s*"), lambda x: x != ""), F.array(last))
        several = F.contains(left, F.lit(","))
        items = F.when(several, F.slice(F.transform(listed, lambda x: F.trim(F.concat_ws(" ", x, noun))), 1, 5)).otherwise(F.array(left, right))
        respect = F.when(several, F.trim(F.concat_ws(" ", aspect, F.trim(F.regexp_extract(right, rx(LISTED_NOUN), 3))))).otherwise(aspect)
        kept = F.filter(items, lambda x: _terms_in(x) & (F.length(x) <= 120))
        return F.when(found(text, pattern) & (F.size(kept) >= 2), F.struct(kept.alias("items"), respect.alias("aspect")))

    return F.coalesce(*map(by, COMPARISONS))


def facets(text: Column) -> Column:
    """The sub-questions of a text, else the facets of one question with the words they share; empty if it has one part."""
    asked = F.filter(F.transform(F.split(text, rx(SPLIT_QUESTIONS)), lambda p: F.regexp_replace(p, "^[ ,.]+|[ ,.]+$", "")), _terms_in)
    core = F.regexp_replace(F.regexp_replace(F.trim(text), "[?.! ]+$", ""), rx(LEADING_ASK), "")
    tail = F.regexp_extract(core, rx(SHARED_TAIL), 1)
    body = F.regexp_replace(core, rx(SHARED_TAIL), "")
    each = F.transform(F.filter(F.split(body, rx(SPLIT_FACETS)), _terms_in), lambda x: F.split(F.trim(x), r"\s+"))
    n = F.size(each)
    first, last = F.element_at(each, 1), F.element_at(each, -1)
    shared = lambda words, at, size: F.when(F.size(words) >= 3, F.slice(words, at, size)).otherwise(F.array().cast("array<string>"))
    before, after = shared(first, 1, F.size(first) - 1), shared(last, 2, F.size(last) - 1)

    def whole(words: Column, i: Column) -> Column:
        own = F.when((i == 0) & (F.size(words) >= 3), F.slice(words, -1, 1)).when((i == n - 1) & (F.size(words) >= 3), F.slice(words, 1, 1)).otherwise(words)
        return F.array_join(F.concat(before, own, after, F.when(tail == "", F.array().cast("array<string>")).otherwise(F.array(tail))), " ")

    split = F.when(n.between(2, 5), F.slice(F.transform(each, whole), 1, 4)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(asked) >= 2, F.slice(asked, 1, 4)).otherwise(split)
