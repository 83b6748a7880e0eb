"""Cleaning, joining and judging text: column expressions only, evaluated in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that cleaning deletes: zero-width ones, soft hyphen, no-break space, marks of order and direction.
INVISIBLE = "\u200b\u200c\u200d\u00ad\u00a0\ufeff\u200f\u200e"
ARTIFACTS = "\ufffd\u25a1\u25a2\ufb00\ufb01\ufb02"
KEYWORDS = tuple(
    sorted(
        "appendix bibliography caution chapter conclusion definition example figure important note reference reminder section summary table tip warning".split()
    )
)


#: Unicode white space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(c, F.lit(_WHITE))


def clean_text(c: Column) -> Column:
    """Delete invisible characters, join lines but keep paragraphs, and simplify spaces, bullets and semicolons."""
    c = F.translate(c, INVISIBLE, "")
    c = F.regexp_replace(c, r"(?<!\n)\n(?!\n)", " ")
    c = F.regexp_replace(c, " +", " ")
    return strip(F.translate(c, "•;", "\n."))


def remove_dotted_lines(c: Column) -> Column:
    """Empty every run of lines that holds five or more dots, dashes, bullets, underscores and spaces only."""
    return F.regexp_replace(c, r"(?mdU)^[\s.\-•_]{5,}$", "")


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n{2,}", "\n\n"), r"[ \t]+", " "))


_TOC_LINE = r"(?:Part|Chapter|Sub-chapter|Section|ANNEX|APPEBDIX)\s+[\dIVXLCDM]+\..+?\s*\.{3,}\s*\d+"
_CONTENT = (r"Part\s+[IVXLCDM]+\.", *(rf"{name}\s+{'\\.'.join([r'\d+'] * n)}\." for n, name in enumerate(("Chapter", "Sub-chapter", "Section"), 1)))


def remove_contents_table(c: Column) -> Column:
    """Cut everything before the text that follows a table of contents.

    After the heading, the last line that looks like an entry is found; the rest begins at
    the first part, else chapter, else sub-chapter, else section after that line, else
    right after it. Without heading or entries the text stays.
    """
    # What stands before and in the table is matched greedily, so that the last entry ends it.
    table = rf"(?sd)\A.*?TABLE OF CONTENTS.*(?-s:{_TOC_LINE})"
    head = F.regexp_extract(c, table, 0)
    rest = F.substr(c, F.length(head) + 1)
    found = [F.regexp_instr(rest, F.lit(rf"(?iU){m}")) for m in _CONTENT]
    start = F.coalesce(*(F.when(f > 0, f) for f in found), F.lit(1))
    return F.when(head == "", c).otherwise(F.substr(rest, start))


def clean_regulation(c: Column) -> Column:
    return normalize_whitespace(remove_dotted_lines(remove_contents_table(c)))


def preview(c: Column, size: int = 200) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def embedding_text(headers: Column, text: Column) -> Column:
    """Headings, a blank line and the text; the text alone without headings."""
    return F.when(F.coalesce(headers, F.lit("")) != "", F.concat(headers, F.lit("\n\n"), text)).otherwise(text)


def join_halves(left: Column, right: Column) -> Column:
    """Two halves of a paragraph as one; a word broken by a hyphen is whole again."""
    left, right = strip(left), strip(right)
    return F.when(left.endswith("-"), F.concat(F.substr(left, F.lit(1), F.length(left) - 1), right)).otherwise(F.concat(left, F.lit(" "), right))


def is_list_item(c: Column) -> Column:
    return c.rlike(r"(?U)^\s*(?:(?:\d+|[a-zA-Z])[.)]|[•\-●‣▪▫⁃])\s+")


def begins_with_keyword(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(strip(c)), r"(?U)^\S+", 0).isin(*KEYWORDS), F.lit(False))


def is_heading_like(c: Column) -> Column:
    return strip(c).rlike(r"(?U)^\d+\.?\s+[A-Z]|(?d)^[A-Z][A-Z\s]+$|(?d)^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$")


def begins_lower(c: Column) -> Column:
    return strip(c).rlike(r"^\p{Ll}")


def begins_upper(c: Column) -> Column:
    return strip(c).rlike(r"^\p{Lu}")


def ends_with_any(c: Column, marks: str) -> Column:
    return F.substring(c, -1, 1).isin(*marks) & (c != "")


def quality_score(c: Column) -> Column:
    """0 for nothing, 0.1 below 100 characters, 0.3 below 50 words, else 1 less 0.1 for each kind of artifact, 0.1 at least."""
    count = F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    broken = reduce(lambda a, b: a + b, (c.contains(a).cast("int") for a in ARTIFACTS))
    score = F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(0.1) * broken)
    return F.when(F.coalesce(c, F.lit("")) == "", 0.0).when(F.length(c) < 100, 0.1).when(count < 50, 0.3).otherwise(score)
