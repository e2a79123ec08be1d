"""Answers that the structure alone gives: counts, lists, names and places, without a model."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field, fields
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import plural, singular
from .answers import NOT_FOUND
from .sections import LABEL_TITLE

SOURCE = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())])
ANSWER = T.StructType([T.StructField("answer", T.StringType()), T.StructField("sources", T.ArrayType(SOURCE))])


@dataclass
class Route:
    """What of a question's route an answer needs."""

    intent: str = "list"
    units: list[int] = field(default_factory=list)
    noun: str | None = None
    target: str = "units"
    caption_kind: str | None = None
    field_filter: list[str] | None = None
    number_range: list[int] | None = None
    missing_numbers: list[str] = field(default_factory=list)


class Structure:
    """One document's sections, captions and tables as records."""

    def __init__(self, sections: list[dict], captions: list[dict] = (), tables: list[dict] = (), title: str = "", page_count: int = 0) -> None:
        self.sections, self.captions, self.tables, self.title, self.page_count = list(sections), list(captions), list(tables), title or "", page_count
        self.units = [s["idx"] for s in self.sections if s.get("ordinal")]
        self.unit_noun = self.sections[0].get("unit_noun") if self.sections else None

    @classmethod
    @lru_cache(maxsize=64)
    def loads(cls, text: str) -> Structure:
        return cls(**json.loads(text))

    def labelled(self, noun: str | None) -> list[dict]:
        return [s for s in self.sections if noun and s["noun"] == noun and s["number"] is not None]


def structures(sections: DataFrame, captions: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """(doc, structure): one JSON text per document with its sections, captions and tables."""
    cols = ["idx", *[c for c in sections.columns if c not in ("doc", "idx")]]
    rows = F.array_sort(F.collect_list(F.struct(*cols)), lambda a, b: a["idx"] - b["idx"])
    out = sections.groupBy("doc").agg(rows.alias("sections"), F.first("doc_title").alias("title"), F.first("page_count").alias("page_count"))
    for name, items in (("captions", captions), ("tables", tables)):
        if items is None:
            out = out.withColumn(name, F.array())
        else:
            kept = items.groupBy("doc").agg(F.collect_list(F.struct(*[c for c in items.columns if c != "doc"])).alias(name))
            out = out.join(kept, "doc", "left").withColumn(name, F.coalesce(name, F.array().cast(kept.schema[name].dataType)))
    return out.select("doc", F.to_json(F.struct("sections", "captions", "tables", "title", "page_count"), {"ignoreNullFields": "false"}).alias("structure"))


def pages(s: dict) -> str:
    return f"Page {s['page_start']}" if s["page_start"] == s["page_end"] else f"Pages {s['page_start']}–{s['page_end']}"


def bullets(lines: Iterable[str]) -> str:
    return "\n".join(f"- {x}" for x in lines)


def numbered(lines: Iterable[str]) -> str:
    return "\n".join(f"{n}. {x}" for n, x in enumerate(lines, start=1))


class Answerer:
    """Answers of one document to one route."""

    def __init__(self, doc: Structure, r: Route) -> None:
        self.doc, self.r, self.at = doc, r, doc.sections
        self.noun = doc.unit_noun or r.noun or "section"

    def reply(self) -> tuple[str, list[tuple[int, str]]]:
        return getattr(self, self.r.intent)()

    # -- display

    def label(self, s: dict, asked: str | None) -> str:
        """ "Story 12"; the document's own words where it labels the section or no noun is known."""
        number, words = s["display_number"] or s["number"], s["title"].split()
        noun = s["noun"] or asked or self.doc.unit_noun
        if number is None or not noun:
            return s["title"]
        if s["noun"] and len(words) >= 2 and singular(words[0]) == s["noun"]:
            return " ".join(words[:2]).rstrip(":.")
        return f"{noun.title()} {number}"

    def heading(self, s: dict, asked: str | None) -> str:
        label, own = self.label(s, asked), s["name"] == s["title"]
        if label == s["title"]:
            return f"{s['title']}: {s['name']}" if not own and LABEL_TITLE.match(s["title"]) else s["title"]
        return s["title"] if own and s["title"].startswith(label) else f"{label}: {s['name']}"

    def line(self, i: int) -> str:
        s = self.at[i]
        extra = "".join(f" — {k}: {v}" for k, v in s["fields"].items())
        return f"{self.heading(s, self.r.noun)}{extra} [{pages(s)}]"

    def sources(self, indices: Iterable[int]) -> list[tuple[int, str]]:
        return [(self.at[i]["page_start"], "\n".join([self.at[i]["title"], *(f"{k}: {v}" for k, v in self.at[i]["fields"].items())])) for i in indices]

    def say(self, count: int, noun: str) -> str:
        return f"{count} {plural(noun, count)}"

    # -- selections

    def labelled(self) -> list[int]:
        """One section per number of the asked noun, the longest, in reading order; none where these are simply the units."""
        best: dict[int, dict] = {}
        for s in self.doc.labelled(self.r.noun):
            held = best.get(s["number"])
            if held is None or s["page_end"] - s["page_start"] > held["page_end"] - held["page_start"]:
                best[s["number"]] = s
        found = sorted(s["idx"] for s in best.values())
        return found if self.r.noun != self.doc.unit_noun or len(found) < len(self.doc.units) else []

    def selected(self) -> list[int]:
        """Units in the asked range and with the asked field value."""
        if self.r.number_range:
            if self.r.units:
                return self.r.units
            low, high = self.r.number_range
            return [i for i in self.labelled() or self.doc.units if low <= (self.at[i]["number"] or -1) <= high]
        if self.r.field_filter:
            key, value = self.r.field_filter
            return [i for i in self.doc.units if (self.at[i]["fields"].get(key) or "").casefold() == value.casefold()]
        return list(self.doc.units)

    def split(self, indices: list[int]) -> tuple[list[int], list[int]]:
        """Numbered units of the document's own kind, and the others; no split where one side is all."""
        kind = (None, self.r.noun, self.doc.unit_noun)
        main = [i for i in indices if self.at[i]["number"] is not None and self.at[i]["noun"] in kind]
        rest = [i for i in indices if i not in main]
        return (main, rest) if len(main) >= 2 and rest else ([], [])

    def captions_asked(self) -> list[dict]:
        return [c for c in self.doc.captions if self.r.caption_kind in (None, c["kind"])]

    def children(self, i: int) -> tuple[list[int], list[int]]:
        """Numbered or labelled children if there are two, else all; and the remaining ones."""
        every = self.at[i]["children"]
        major = [c for c in every if self.at[c]["number_path"] or self.at[c]["noun"]]
        major = major if len(major) >= 2 else every
        return major, [c for c in every if c not in major]

    # -- notes

    def numbering(self, indices: list[int]) -> str:
        with_number = [self.at[i] for i in indices if self.at[i]["number"] is not None]
        if 2 * len(with_number) < len(indices) or not with_number:
            return ""
        first, last = (s["display_number"] or s["number"] for s in (with_number[0], with_number[-1]))
        return "" if first == last else f" They are numbered {first} to {last}."

    def other_noun(self) -> str:
        asked, own = self.r.noun, self.doc.unit_noun
        if not asked or not own or asked == own:
            return ""
        return f" (The PDF is divided into {plural(own)}, not {plural(asked)}; these {plural(own)} are its top-level parts.)"

    def missing(self) -> str:
        lost = f"I couldn't find {self.noun} {', '.join(self.r.missing_numbers[:20])} in the uploaded PDF." if self.r.missing_numbers else NOT_FOUND
        n = len(self.doc.units)
        return lost + (f" It contains {n} top-level {plural(self.noun, n)}.{self.numbering(self.doc.units)}" if n else "")

    # -- answers by target

    def _captions(self, counting: bool):
        found, kind = self.captions_asked(), self.r.caption_kind
        if not found and kind == "table" and self.doc.tables:
            return self._layout_tables()
        if not found:
            return f"I couldn't find any captioned {plural(kind or ('figure or table' if counting else 'figure'))} in the uploaded PDF.", []
        head = f"The document has {len(found)} captioned {plural(kind or 'figure or table', len(found))}" if counting else f"{plural(kind or 'caption').title()} in the uploaded PDF ({len(found)})"
        return f"{head}:\n\n" + bullets(f"{c['text']} [Page {c['page']}]" for c in found), [(c["page"], c["text"]) for c in found]

    def _layout_tables(self):
        def about(t: dict) -> str:
            inside = 0 <= t.get("section", -1) < len(self.at)
            where = f" ({self.at[t['section']]['title']})" if inside else ""
            return f"Page {t['page']}{where}: {t['n_rows'] - 1} rows; columns: {t['header'].replace(' | ', ', ')}"

        head = f"The document has {len(self.doc.tables)} tables (detected from the page layout; they have no numbered captions):\n\n"
        return head + bullets(map(about, self.doc.tables)), [(t["page"], t["header"]) for t in self.doc.tables]

    def _children(self):
        blocks, shown = [], []
        for i in self.r.units:
            s = self.at[i]
            title = f"{self.heading(s, self.r.noun)} ({pages(s)})"
            major, minor = self.children(i)
            if not major:
                blocks.append(f"{title} has no sub-sections in the document's outline.")
                continue
            text = f"{title} has {len(major)} sub-section{'s' * (len(major) != 1)}:\n" + bullets(f"{self.at[c]['title']} [{pages(self.at[c])}]" for c in major)
            if minor:
                text += "\nOther headings within it: " + "; ".join(self.at[c]["title"] for c in minor) + "."
            blocks.append(text)
            shown += major
        return "\n\n".join(blocks), self.sources(shown)

    def count(self):
        target = self.r.target
        if target == "pages":
            return (f"The document has {self.doc.page_count} pages." if self.doc.page_count else NOT_FOUND), []
        if target == "captions":
            return self._captions(True)
        if target == "children":
            return self._children()
        if target == "headings":
            levels = Counter(s["level"] for s in self.at)
            by_level = " By level: " + ", ".join(f"{n} at level {v}" for v, n in sorted(levels.items())) + "." if len(levels) > 1 else ""
            return (f"The document has {len(self.at)} headings.{by_level}" if self.at else "I couldn't detect any headings in the uploaded PDF."), self.sources(range(len(self.at)))
        own = [] if self.r.field_filter else self.labelled()
        if own:
            return f"The document has {self.say(len(own), self.r.noun)}:\n\n" + numbered(map(self.line, own)), self.sources(own)
        if not self.doc.units:
            return f"I couldn't detect any {plural(self.r.noun or 'section')} in the uploaded PDF's layout.", []
        found = self.selected()
        if self.r.field_filter:
            key, value = self.r.field_filter
            text = f"{self.say(len(found), self.noun)} in the uploaded PDF have {key}: {value}."
            return text + ("\n\n" + numbered(map(self.line, found)) if found else ""), self.sources(found)
        main, rest = self.split(found)
        if main:
            text = f"The document has {len(main)} numbered {plural(self.noun, len(main))}.{self.numbering(main)}"
            text += f" It also has {len(rest)} other top-level section{'s' * (len(rest) != 1)}: {', '.join(self.at[i]['title'] for i in rest)}."
            return text + "\n\n" + numbered(map(self.line, main)), self.sources(found)
        text = f"The document contains {self.say(len(found), self.noun)}.{self.numbering(found)}{self.other_noun()}"
        return text + ("\n\n" + numbered(map(self.line, found)) if len(found) <= 40 else ""), self.sources(found)

    def list(self):
        if self.r.target == "captions":
            return self._captions(False)
        if self.r.target == "children":
            return self._children()
        if self.r.target in ("headings", "outline") or not self.doc.units:
            return self._outline()
        asked_plainly = not self.r.field_filter and not self.r.number_range
        own = self.labelled() if asked_plainly else []
        if own:
            return f"{plural(self.r.noun).title()} in the uploaded PDF ({len(own)}):\n\n" + numbered(map(self.line, own)), self.sources(own)
        found = self.selected()
        if not found:
            return self.missing(), []
        main, rest = self.split(found) if asked_plainly else ([], [])
        if main:
            text = f"The document has {len(main)} numbered {plural(self.noun, len(main))}:\n\n" + numbered(map(self.line, main))
            text += "\n\nOther top-level parts:\n" + bullets(f"{self.heading(self.at[i], None)} [{pages(self.at[i])}]" for i in rest)
            return text, self.sources(main + rest)
        head = f"{plural(self.noun).title()} in the uploaded PDF"
        head += f" with {self.r.field_filter[0]}: {self.r.field_filter[1]}" if self.r.field_filter else ""
        head += f" ({self.r.number_range[0]}–{self.r.number_range[1]})" if self.r.number_range else ""
        text = f"{head} — {len(found)} found:\n\n" + numbered(map(self.line, found))
        if self.r.number_range and self.r.missing_numbers:
            text += f"\n\nNot found in the document: {self.noun} {', '.join(self.r.missing_numbers)}."
        return text, self.sources(found)

    def _outline(self):
        if not self.at:
            return "I couldn't detect any headings or sections in the uploaded PDF.", []
        top = min(s["level"] for s in self.at)
        shown = [s for s in self.at if s["level"] < top + 3][:400]
        head = f"Outline of {self.doc.title}" if self.doc.title and self.r.target == "outline" else "Headings in the uploaded PDF"
        text = f"{head} ({len(self.at)} headings):\n\n" + "\n".join(f"{'  ' * (s['level'] - top)}- {s['title']} [{pages(s)}]" for s in shown)
        hidden = len(self.at) - len(shown)
        return text + (f"\n\n(Showing the top three levels; {hidden} deeper headings omitted.)" if hidden else ""), self.sources(s["idx"] for s in shown)

    def explain(self):
        """Only for references to what the document does not have."""
        return self.missing(), []

    def lookup(self):
        lines = []
        for s in (self.at[i] for i in self.r.units):
            label, extra = self.label(s, self.r.noun), "".join(f"; {k}: {v}" for k, v in s["fields"].items())
            said = f'"{s["title"]}"' if label == s["title"] else f'{label} is "{s["name"]}"'
            lines.append(f"{said}{extra} [{pages(s)}].")
        return "\n".join(lines + [self.missing()] * bool(self.r.missing_numbers)), self.sources(self.r.units)


@F.pandas_udf(ANSWER)
def _answers(route: pd.DataFrame, structure: pd.Series) -> pd.DataFrame:
    rows = []
    for r, s in zip(route.to_dict("records"), structure):
        clean = {k: list(v) if hasattr(v, "tolist") else v for k, v in r.items()}
        plan = Route(**{f.name: clean[f.name] for f in fields(Route) if clean.get(f.name) is not None})
        known = plan.intent in ("count", "list", "lookup") or (plan.intent == "explain" and not plan.units)
        answer, sources = Answerer(Structure.loads(s) if s else Structure([]), plan).reply() if known else (None, [])
        rows.append((answer, [{"page": p, "text": t} for p, t in sources]))
    return pd.DataFrame(rows, columns=ANSWER.names)


def structural_answers(route: Column, structure: Column) -> Column:
    """struct<answer, sources> for routes that count, list or look up; a null answer for all others."""
    return _answers(route, structure)
