"""Model calls behind protocols, with deterministic offline stand-ins.

A provider works on batches of texts; everything around it (batching, order, joins)
is the engine's.  The offline ones need no network and no model file."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrycrest.functions.html import html_links, html_to_text


class Embedder(Protocol):
    size: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class HashedWords:
    """Signed hashed word counts of unit length."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.size] += 1.0 if h & 0x10000 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def embed(text: Column, provider: Embedder, batch: int = 100) -> Column:
    """array<float> of each text, called in batches of at most ``batch``."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            rows: list = []
            for i in range(0, len(s), batch):
                rows.extend(provider.embed(s.iloc[i : i + batch].fillna("").tolist()).tolist())
            yield pd.Series(rows)

    return run(text)


def classify_audience(question: Column) -> Column:
    """Keyword rules in place of a model."""
    low = F.lower(F.coalesce(question, F.lit("")))
    grad, under = low.rlike(r"\b(?:graduate school|phd|doctoral|masters?|mba|postdoc)\b"), low.rlike(r"\b(?:undergrad\w*|freshm[ae]n|sophomore|first-year|transfer)\b")
    return F.when(grad & ~under, "grad").when(under & ~grad, "undergrad").otherwise("both")


def lexical_score(question: Column, document: Column) -> Column:
    """Share of the question's distinct words that the document has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    q = words(question)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(document))) / F.size(q)).otherwise(F.lit(0.0))


# What a page of student information may be about.
CATEGORIES = [
    "Housing", "Dining", "Transportation", "Campus Life", "Financial Aid", "Health & Wellness", "Career Services",
    "Athletics", "IT Services", "International Students", "Registrar", "Bursar",
]


def categorize(text: Column, default: str = "Campus Life") -> Column:
    """The first category of CATEGORIES that a text names, in place of a model's choice."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(default)
    for c in reversed(CATEGORIES):
        out = F.when(F.contains(low, F.lit(c.lower())), c).otherwise(out)
    return out


def analyze_general_page(html: Column, most_chars: int = 50_000) -> Column:
    """struct<has_content,category,text> of a page of no known kind; null where it was not fetched."""
    text = F.substring(html_to_text(html), 1, most_chars)
    return F.when(html.isNotNull(), F.struct((text != "").alias("has_content"), categorize(text).alias("category"), text.alias("text")))


def analyze_page(html: Column, most_links: int = 5, most_chars: int = 50_000) -> Column:
    """struct<has_content,department,school,text,sub_links>: the page's text and first
    links in place of a model's reading of it; null for a page that was not fetched."""
    text = F.substring(html_to_text(html), 1, most_chars)
    page = F.struct(
        (text != "").alias("has_content"),
        F.lit("").alias("department"),
        F.lit("").alias("school"),
        text.alias("text"),
        F.slice(html_links(html), 1, most_links).alias("sub_links"),
    )
    return F.when(html.isNotNull(), page)


def select_links(html: Column, most: int) -> Column:
    """The first ``most`` links, none for null."""
    return F.slice(html_links(html), 1, most)


def expand_query(question: Column, supplied: Column | None = None) -> Column:
    """The question, with sub-queries where a table supplies them."""
    return F.concat(F.array(question), F.coalesce(supplied, F.array().cast("array<string>"))) if supplied is not None else F.array(question)
