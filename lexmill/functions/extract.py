"""Headings, references, markers and query terms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import strip

_N, _W = r"\d+", r"\s+"
_DOTTED = rf"{_N}(?:\.{_N})*"

#: Heading levels by pattern. Level 3 takes what levels 4 and 5 are meant for, as it comes first.
HEADINGS = (
    (1, rf"(?:part|chapter){_W}[ivx\d]+\b"),
    (2, rf"sub-?chapter{_W}[\d.]+\b"),
    (3, rf"section{_W}{_N}\b"),
    (4, rf"section{_W}{_N}\.{_N}\b"),
    (5, rf"section{_W}{_N}\.{_N}\.{_N}\b"),
    (6, rf"sub-?section{_W}[\d.]+\b"),
)
LEVELS = tuple(level for level, _ in HEADINGS)


def _headings(most_specific_first: bool):
    return sorted(HEADINGS, key=lambda h: (h[0] in (3, 4, 5), -h[0] if h[0] in (3, 4, 5) else 0)) if most_specific_first else HEADINGS


def heading_level(c: Column, most_specific_first: bool = False) -> Column:
    """Level of the heading that a block begins with, or null."""
    out = None
    for level, pattern in _headings(most_specific_first):
        hit = c.rlike(rf"(?iU)\A{pattern}")
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out


def heading_text(c: Column, most_specific_first: bool = False) -> Column:
    """The heading that a block begins with, or null."""
    found = [F.regexp_extract(c, rf"(?iU)\A{pattern}", 0) for _, pattern in _headings(most_specific_first)]
    return F.coalesce(*(F.when(f != "", f) for f in found))


_ENTRY = rf"(?isU)\A((?:part|chapter|section|sub-chapter){_W}[ivxlcdm\d.]+)\.?\s*(.*?)\s*[.\-_\s]{{3,}}\s*({_N})\s*\z"


def contents_entry(c: Column) -> Column:
    """struct<page, level, header, title> of a line of a table of contents, or null."""
    c = strip(c)
    header = strip(F.regexp_extract(c, _ENTRY, 1))
    level = F.when(header.startswith("Part"), 1).when(header.startswith("Chapter"), 2).when(header.startswith("Sub-chapter"), 3).when(header.startswith("Section"), 4).otherwise(1)
    entry = F.struct(F.regexp_extract(c, _ENTRY, 3).cast("int").alias("page"), level.alias("level"), header.alias("header"), F.regexp_extract(c, _ENTRY, 2).alias("title"))
    return F.when(c.rlike(_ENTRY), entry)


def contents_key(c: Column) -> Column:
    """A heading as headings and entries are compared."""
    return F.lower(strip(F.regexp_replace(strip(c), r"\.+$", "")))


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


#: References to law that answers cite, in any case of letters.
REFERENCES = (
    rf"article{_W}{_N}(?:\([^)]+\))?(?:{_W}of{_W}[^.]+)?",
    rf"section{_W}{_DOTTED}",
    rf"sub-section{_W}{_DOTTED}",
    rf"cssf{_W}regulation{_W}{_N}-{_N}",
    rf"delegated{_W}regulation{_W}\([^)]+\){_W}{_N}/{_N}",
    rf"circular{_W}cssf{_W}{_N}/{_N}",
    rf"point{_W}{_N}",
    rf"\d{{4}}{_W}law",
)


def references(c: Column) -> Column:
    """References in a text, each once, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*(_all(c, rf"(?iU){p}") for p in REFERENCES)))))


CITATIONS = (rf"\b{_N}{_W}U\.S\.C\.{_W}§{_W}{_N}", rf"\b{_N}{_W}CFR{_W}{_N}\.{_N}", rf"Section{_W}{_DOTTED}", rf"Article{_W}{_N}", rf"Regulation{_W}{_N}")


def citations(c: Column) -> Column:
    """Citations in a chunk, kind by kind, repeated ones too."""
    return F.flatten(F.array(*(_all(c, rf"(?U){p}") for p in CITATIONS)))


def cross_references(c: Column) -> Column:
    return _all(c, rf"(?iU)see{_W}(?:section|article|clause){_W}{_DOTTED}")


#: Kinds of marker lines, the first that is found anywhere in a line being its kind.
MARKERS = (
    ("article", rf"article{_W}{_N}"),
    ("section", rf"section{_W}{_DOTTED}"),
    ("subsection", rf"subsection{_W}[a-z]+"),
    ("paragraph", rf"paragraph{_W}{_N}"),
    ("clause", rf"clause{_W}{_N}"),
    ("definition", rf"definition{_W}{_N}|means:|defined as:|shall mean"),
    ("requirement", "shall|must|required to|obligated to"),
    ("penalty", "penalty|fine|sanction|violation|non-compliance"),
    ("procedure", "procedure|process|steps|methodology"),
)
NESTED = tuple(kind for kind, _ in MARKERS[:5])


def marker_kind(c: Column) -> Column:
    out = None
    for kind, pattern in MARKERS:
        hit = c.rlike(f"(?i){pattern}")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def marker_text(c: Column) -> Column:
    found = [F.regexp_extract(c, f"(?i){pattern}", 0) for _, pattern in MARKERS]
    return F.coalesce(*(F.when(f != "", f) for f in found))


def chunk_kind(c: Column) -> Column:
    """What a chunk is about. A numbered definition never counts, the text being in lower case."""
    c = F.lower(c)
    kinds = {kind: pattern for kind, pattern in MARKERS}
    order = ("requirement", "penalty", "procedure")
    out = F.when(c.rlike("means:|defined as:|shall mean"), "definition")
    for kind in order:
        out = out.when(c.rlike(kinds[kind]), kind)
    return out.otherwise("general")


IGNORED = ("with", "this", "that")


def query_numbers(q: Column) -> Column:
    return _all(q, rf"(?U)\b{_N}\b")


def query_references(q: Column) -> Column:
    return _all(F.lower(q), rf"(?U)\b(?:article|section|sub-section|point|paragraph){_W}{_N}\b")


def query_words(q: Column) -> Column:
    return F.filter(F.split(F.lower(q), r"(?U)\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*IGNORED))


def key_terms(q: Column) -> Column:
    """Numbers, then words; repeated ones count each time."""
    return F.concat(query_numbers(q), query_words(q))


def asks_about_officers(q: Column) -> Column:
    q = F.lower(q)
    return q.contains("compliance officer") | q.contains("appointment") | q.contains("requirements")
