"""Text expressions: stripping and the ordered cleaning rules, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python sees it, for Java patterns (fixed value).
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(F.regexp_replace(text, rf"^{SPACE}+", ""), rf"{SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and white space only."""
    return strip(F.coalesce(text, F.lit(""))) == ""


_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def cleaning_rules(organisation: str) -> dict[int, tuple[str, str]]:
    """The ordered cleaning rules as number -> (Java pattern, replacement).

    Fixed values: patterns and their order decide what is left of a text."""
    return {
        1: (r"(?id)(?:Spring|Fall|Winter|Summer) Standard Hours of Operation.*?\n", ""),
        2: (r"(?i)All dining locations are currently (?:open|closed)\.?", ""),
        3: (r"(?id)What'?s Open Now.*", ""),
        4: (r"\d{1,2}:\d{2}\s?(?:am|pm|AM|PM)", ""),
        5: (r"(?is)The information contained on this dining website.*?dining manager on duty\.", ""),
        6: (rf"(?is)(?:Location|Address):?\s?{organisation}.*?\d{{5}}-\d{{4}}", ""),
        7: (r"Phone:?\s?\(?\d{3}\)?\s?\d{3}-\d{4}", ""),
        8: (r"Email:?\s?\S+@\S+", ""),
        9: (r"(?id)Lorem ipsum.*?(\.|\n)", ""),
        10: (r"(?is)(?:Upcoming Events|Upcoming Opportunities).*?(?=\n\n|\z)", ""),
        11: (r"\b\d{10}\b", ""),
        12: (r"(?i)\b(?:noon|midnight)\b", ""),
        13: (r"(?i)Skip to (?:Content|Navigation)", ""),
        14: (r"(?i)Accessibility Preferences", ""),
        15: (r"(?i)High Contrast", ""),
        16: (r"(?id)Font Size.*", ""),
        17: (r"(?s)Helpful [Ll]inks?:?.*?(?=\n\n|\z)", ""),
        18: (r"Resources for\n(?:\*[^\n]*\n)+", ""),
        19: (r"\[([^\]]+)\]\((?!mailto)[^)]+\)", "$1"),
        20: (r"(?d)\[.*?\]\(mailto:[^\)]*\)", ""),
        21: (r"(\d)\s+(st|nd|rd|th)\b", "$1$2"),
        22: (r"(?md)^[A-Z][^.\n]{10,100}\?\s*$", ""),
        23: (r"(?md)^\s*[\*\-]\s+", ""),
        24: (rf"(?md)^.*?\|\s*.*?\|\s*{organisation}.*$", ""),
        25: (r"\*\*([^*]+)\*\*", "$1"),
        26: (r"\*([^*\n]+)\*", "$1"),
        27: (r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", ""),
        28: (rf"(?i)\b(?:{_MONTHS})\s+\d{{1,2}},\s+\d{{4}}\s*\|\s*\d{{1,2}}:\d{{2}}\s*(?:am|pm)", ""),
        29: (r"(?md)^#{1,6}\s+", ""),
        30: (r"https?://\S+", ""),
        31: (r"[-=]{3,}", ""),
        32: (r"(\|\s*)+\|", ""),
        33: (r"(?:[A-Z]\[?[A-Z]?\]?\s*){5,}", ""),
        34: (r"(?d)!\[.*?\]\(.*?\)", ""),
        35: (r"(?md)^[\*\-]\s*$", ""),
        36: (r"\n{3,}", "\n\n"),
        37: (r"[ \t]{2,}", " "),
        38: (r"\s+([.,:;])", "$1"),
    }


FULL = tuple(range(1, 39))
BASIC = (3, 4, 13, 14, 15, 16, 31, 32, 33, 34, 20, 36)


def clean(text: Column, organisation: str, rules: tuple[int, ...] = FULL) -> Column:
    """The rules in the order given, then stripped; one projection, no UDF."""
    table = cleaning_rules(organisation)
    for number in rules:
        pattern, to = table[number]
        text = F.regexp_replace(text, pattern, to)
    return strip(text)
