"""Three document cleaners as chains of JVM regular expressions.

They are not equivalent and are kept apart by name: ``clean_page`` keeps line
structure, ``clean_flat`` and ``clean_incremental`` collapse all white space and
differ in what they take for front matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s\x1c-\x1f]"

#: The patterns of each cleaning step.
FRONT_MATTER_PAGE = r"(?smd)\A[ \t]*(?<d>---|\+\+\+)[ \t]*\r?\n.*?^[ \t]*\k<d>[ \t]*(?:\r?\n|\z)"
FRONT_MATTER_FLAT = rf"(?sU)\A{_BLANK}*(?<d>-{{3,}}|\+{{3,}}).*?\k<d>{_BLANK}*"
FRONT_MATTER_INCREMENTAL = rf"(?smdU)^{_BLANK}*[+\-]{{3,}}.*?[+\-]{{3,}}{_BLANK}*"
TEMPLATE_TAG = r"(?s)\{\{.*?\}\}"
COMMENT = r"(?s)<!--.*?-->"
TAG = r"<[^>]+>"
NAVIGATION = r"(?iU)\b(?:Get Started|Contribute|GenAI|Home|Menu|Navigation)\b"
LINK_NESTED = r"\[([^\]]+)\]\((?:[^()]++|\([^()]*+\))*+\)"
LINK_PLAIN = r"\[([^\]]+)\]\([^)]+\)"
URL = r"(?U)https?://[^\s\x1c-\x1f]+"
STRIP = rf"(?U)\A{_BLANK}+|{_BLANK}+\z"


def _chain(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, value in steps:
        text = F.regexp_replace(text, pattern, value)
    return text


def strip_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, FRONT_MATTER_PAGE, "")


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, COMMENT, "")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, " ")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes blanks only)."""
    return F.regexp_replace(text, STRIP, "")


_MARKUP = [(TEMPLATE_TAG, ""), (COMMENT, ""), (TAG, " "), (NAVIGATION, "")]


def clean_page(text: Column) -> Column:
    """Links become their labels before addresses go; lines stay lines."""
    return _chain(text, [(FRONT_MATTER_PAGE, ""), *_MARKUP, (LINK_NESTED, "$1"), (URL, ""), (r"[ \t]+", " "), (r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n"), (STRIP, "")])


def clean_flat(text: Column) -> Column:
    """Front matter at the start only; everything on one line."""
    return _chain(text, [(FRONT_MATTER_FLAT, ""), *_MARKUP, (URL, ""), (LINK_PLAIN, "$1"), (rf"(?U){_BLANK}+", " "), (STRIP, "")])


def clean_incremental(text: Column) -> Column:
    """Text between any two rules counts as front matter; everything on one line."""
    return _chain(text, [(FRONT_MATTER_INCREMENTAL, ""), *_MARKUP, (URL, ""), (LINK_PLAIN, "$1"), (rf"(?U){_BLANK}+", " "), (STRIP, "")])
