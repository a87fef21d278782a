"""HTML to text with regular expressions, JVM-side.

Blocks that carry no content are dropped with what is in them, links keep their
target, every other tag splits lines.  A block without its closing tag is kept
(a parser of documents would drop it to the end of its parent): a known deviation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrycrest.functions.text import SPACE

_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}
ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""


def html_to_text(html: Column) -> Column:
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->|(?i)<!doctype[^>]*>", "")
    for tag in ("script", "style", "nav", "footer", "header"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    t = F.regexp_replace(t, ANCHOR, "\n[$2]($1)\n")
    t = F.regexp_replace(t, r"\[\s*\]\(([^)]*)\)", "$1")
    t = F.regexp_replace(t, r"<[^>]+>", "\n")
    for name, char in _ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(char))
    lines = F.transform(F.split(t, "\n", -1), lambda x: F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+\z", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def html_links(html: Column) -> Column:
    """Targets of the anchors, in order, repeats included."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(ANCHOR), F.lit(1))
