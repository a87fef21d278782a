"""Overlapping chunks that end at line ends or sentence ends where there are any.

A chunk has at most ``size`` characters.  Its end moves back, within the last
``look_back`` characters, to just past the last line end, or else to just past the
full stop of the last ``". "``.  The next chunk starts past the first white space at
or after ``overlap`` characters before that end.

A text's boundaries are found once, as sorted arrays of places; for every place of the
text an end could have, the next start follows from them, so both tables are filled
with whole-array look-ups and a chunk costs two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrycrest.functions.text import clean

SIZE, OVERLAP, LOOK_BACK, LEAST = 1500, 300, 200, 100


@lru_cache(1)
def _white_space() -> np.ndarray:
    return np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def _last_in(places: np.ndarray, above: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """For each interval (above, upto] its last place, or -1."""
    if not len(places):
        return np.full(len(upto), -1)
    at = np.searchsorted(places, upto, "right") - 1
    found = places[np.maximum(at, 0)]
    return np.where((at >= 0) & (found > above), found, -1)


def spans(text: str, size: int = SIZE, overlap: int = OVERLAP, look_back: int = LOOK_BACK) -> np.ndarray:
    """(n, 2) starts and ends of a text's chunks, white space not stripped."""
    n = len(text)
    if n <= size:
        return np.array([[0, n]] if n else [], np.int64).reshape(-1, 2)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lines = np.flatnonzero(code == 10) + 1
    stops = np.flatnonzero((code[:-1] == 46) & (code[1:] == 32)) + 1
    words = np.flatnonzero(np.isin(code, _white_space())) + 1
    # the end of a chunk depends on where it would end by size alone
    full = np.arange(size, n)
    low = full - min(look_back, size)
    line, stop = _last_in(lines, low, full), _last_in(stops, low, full - 1)
    end = np.where(line >= 0, line, np.where(stop >= 0, stop, full))
    back = np.maximum(end - overlap, 0)
    ahead = np.searchsorted(words, back, "right")
    start = np.where(ahead < len(words), words[np.minimum(ahead, len(words) - 1)], back) if len(words) else back
    start = np.minimum(start, end).tolist()
    end = end.tolist()
    out, at = [], 0
    while at + size < n:
        out.append((at, end[at]))
        at = start[at]
    if at < n:
        out.append((at, n))
    return np.array(out, np.int64)


def chunks_of(text: str, size: int = SIZE, overlap: int = OVERLAP, look_back: int = LOOK_BACK) -> list[str]:
    pieces = (text[a:b].strip() for a, b in spans(text, size, overlap, look_back).tolist())
    return [p for p in pieces if p]


def split(text: Column, size: int = SIZE, overlap: int = OVERLAP, look_back: int = LOOK_BACK) -> Column:
    """array<string> of a text's chunks; null and empty texts have none.

    An Arrow UDF: the walk depends on where the last chunk ended, and a fold in SQL
    re-evaluates substrings of the whole text at every step."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([chunks_of(t, size, overlap, look_back) if t else [] for t in texts])

    return run(text)


def chunk_or_keep(df: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, number_single: bool = False) -> DataFrame:
    """Drops texts under ``least`` characters and splits those of ``size`` or more.

    Adds chunk_index and chunk_total (replacing columns of those names): null for
    texts kept whole, or 0 of 1 with ``number_single``.  One pass: every row gives an
    array of its chunks, and only long texts are sent to Python."""
    rows = df.drop("chunk_index", "chunk_total")
    value = F.col(text)
    n = F.length(value)
    parts = F.when(n >= size, split(F.when(n >= size, value), size, overlap)).when(n >= least, F.array(value)).otherwise(F.array().cast("array<string>"))
    others = [c for c in rows.columns if c != text]
    cut = rows.select(*others, (n >= size).alias("_cut"), parts.alias("_parts"))
    cut = cut.select(*others, "_cut", F.size("_parts").alias("_total"), F.posexplode("_parts").alias("_index", text))
    single = (0, 1) if number_single else (None, None)
    number = lambda c, other: F.when(F.col("_cut"), F.col(c)).otherwise(F.lit(other)).cast("int")
    return cut.select(*rows.columns, number("_index", single[0]).alias("chunk_index"), number("_total", single[1]).alias("chunk_total"))


def clean_and_chunk(df: DataFrame, organisation: str, rules: tuple[int, ...], text: str = "text") -> DataFrame:
    """``chunk_or_keep`` of cleaned texts; null is ''."""
    others = [c for c in df.columns if c != text]
    # a generator's output is computed once, where the optimizer would repeat a projection's rules at each use
    cleaned = F.explode(F.array(clean(F.coalesce(F.col(text), F.lit("")), organisation, rules)))
    return chunk_or_keep(df.select(*others, cleaned.alias(text)), text)


def counters(df: DataFrame, text: str = "text", size: int = SIZE, least: int = LEAST) -> DataFrame:
    """One row: loaded, skipped, chunked and kept whole, in one pass."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return df.agg(
        F.count("*").alias("loaded"),
        F.count_if(n < least).alias("skipped"),
        F.count_if(n >= size).alias("chunked"),
        F.count_if((n >= least) & (n < size)).alias("kept"),
    )
