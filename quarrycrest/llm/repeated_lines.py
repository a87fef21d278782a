"""Lines repeated across one site's pages, found by content-defined chunks.

Texts are cut into chunks where a rolling hash over the last WINDOW letters and
digits meets a mask, and at line ends, so that a chunk never depends on what is
beside its line; markup, bullets, white space and case are not hashed.  Distinct
pages are counted for each (site, chunk) with partial aggregates.  A line on many
pages has every one of its chunks on as many pages, so the lines whose chunks are
all frequent are the only ones that can be; those are counted exactly.

``repeated_chunks`` takes texts whole: its chunks end only where the hash says so, not
at line ends, and those that are frequent themselves are the result, as places in the
text.  They are what is left of a notice that was joined to other lines or wrapped anew.

A page is a normalised url, a site its host.  Rows with null url and null or empty
text count for nothing; lines without letters or digits neither.  Equal rows are
one page.  An empty table gives empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrycrest.functions.urls import host, normalize_url
from quarrycrest.llm.common import checkpoint, map_texts
from quarrycrest.llm.textbatch import TextBatch, mix

WINDOW = 8
#: A chunk has 64 letters and digits on average.
MASK = np.uint64(63)
MIN_PAGES, MIN_SHARE = 5, 0.2
#: Chunks of whole texts that count have so many letters and digits.
LEAST_LETTERS = 16
#: Frequent chunks that are broadcast at most (16 bytes each); beyond, a shuffled join.
BROADCAST_ROWS = 200_000


def _pages(df: DataFrame, key: str, url: str, text: str) -> DataFrame:
    rows = df.where(F.col(url).isNotNull() & (F.col(text) != "")).select(F.col(key).cast("bigint").alias("id"), F.col(url).alias("url"), F.col(text).alias("text"))
    rows = rows.withColumn("page", normalize_url(F.col("url")))
    return rows.select("id", F.xxhash64(host(F.col("page"))).alias("site"), F.xxhash64("page").alias("page"), "text")


def cut(texts):
    """(text number, line number, key of the line, chunk) of every chunk in order."""
    b = TextBatch(texts)
    starts, ends, docs, numbers = b.lines()
    seen = np.concatenate(([0], np.cumsum(b.alnum)))
    s, e = seen[starts], seen[ends]  # lines in the array of letters and digits only
    full = e > s
    s, e, docs, numbers = s[full], e[full], docs[full], numbers[full]
    if not len(s):
        empty = np.empty(0, np.int64)
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    values = b.low[b.alnum]
    of = b.span_hash(values)
    at = np.arange(WINDOW, len(values))  # chunk ends that the rolling hash proposes
    at = at[(of(at - WINDOW, at) & MASK) == 0]
    line = np.searchsorted(s, at, "right") - 1
    inside = (at - WINDOW >= s[line]) & (at < e[line])
    at, line = at[inside], line[inside]
    starts = np.concatenate((s, at))
    owner = np.concatenate((np.arange(len(s)), line))
    order = np.argsort(starts, kind="stable")
    starts, owner = starts[order], owner[order]
    stops = np.minimum(np.append(starts[1:], len(values)), e[owner])
    return docs[owner], numbers[owner], of(s, e)[owner], of(starts, stops)


def _i64(x):
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _chunk_rows(rows: pa.RecordBatch, texts: list):
    """Distinct (site, page, chunk) of a slice: the map side of the count."""
    docs, _, _, chunk = cut(texts)
    site, page = (rows.column(i).to_numpy(zero_copy_only=False)[docs] for i in (1, 2))
    code = mix(page.view(np.uint64)) + chunk
    _, first = np.unique(code, return_index=True)
    return pa.RecordBatch.from_arrays([_i64(site[first]), _i64(page[first]), _i64(chunk[first])], ["site", "page", "chunk"])


def _line_rows(rows: pa.RecordBatch, texts: list):
    docs, numbers, line, chunk = cut(texts)
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (numbers[1:] != numbers[:-1])
    at = np.flatnonzero(new)
    ident, site, page = (rows.column(i).to_numpy(zero_copy_only=False)[docs[at]] for i in (0, 1, 2))
    offsets = pa.array(np.append(at, len(docs)).astype(np.int32))
    return pa.RecordBatch.from_arrays([_i64(ident), _i64(numbers[at]), _i64(site), _i64(page), _i64(line[at]), pa.ListArray.from_arrays(offsets, _i64(chunk))], ["id", "line_no", "site", "page", "line", "chunks"])


def cut_whole(texts):
    """(text number, start, end, chunk) of every chunk of LEAST_LETTERS letters and digits
    or more, regardless of line ends; places count from the text's start."""
    b = TextBatch(texts)
    place = np.flatnonzero(b.alnum)
    bounds = np.searchsorted(place, b.start)
    s, e = bounds[:-1], bounds[1:]
    full = np.flatnonzero(e > s)
    s, e = s[full], e[full]
    of = b.span_hash(b.low[b.alnum])
    at = np.arange(WINDOW, len(place))
    at = at[(of(at - WINDOW, at) & MASK) == 0]
    owner = np.searchsorted(s, at, "right") - 1
    inside = at - WINDOW >= s[owner] if len(at) else np.zeros(0, bool)
    starts = np.concatenate((s, at[inside]))
    owner = np.concatenate((np.arange(len(s)), owner[inside]))
    order = np.argsort(starts, kind="stable")
    starts, owner = starts[order], owner[order]
    stops = np.minimum(np.append(starts[1:], len(place)), e[owner]) if len(starts) else starts
    long = stops - starts >= LEAST_LETTERS
    starts, stops, docs = starts[long], stops[long], full[owner[long]]
    base = b.start[docs]
    return docs, place[starts] - base, place[stops - 1] + 1 - base, of(starts, stops)


def _whole_chunk_rows(rows: pa.RecordBatch, texts: list):
    docs, _, _, chunk = cut_whole(texts)
    site, page = (rows.column(i).to_numpy(zero_copy_only=False)[docs] for i in (1, 2))
    _, first = np.unique(mix(page.view(np.uint64)) + chunk, return_index=True)
    return pa.RecordBatch.from_arrays([_i64(site[first]), _i64(page[first]), _i64(chunk[first])], ["site", "page", "chunk"])


def _placed_chunk_rows(rows: pa.RecordBatch, texts: list):
    docs, start, end, chunk = cut_whole(texts)
    ident, site = (rows.column(i).to_numpy(zero_copy_only=False)[docs] for i in (0, 1))
    return pa.RecordBatch.from_arrays([_i64(ident), _i64(site), _i64(start), _i64(end), _i64(chunk)], ["id", "site", "start", "end", "chunk"])


def repeated_chunks(df: DataFrame, key="rec_id", url="url", text="text", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(rec_id, start, end, pages, site_pages): where chunks stand that are repeated
    excessively within their site; start and end count characters from 0."""
    often = checkpoint(frequent_chunks(df, key, url, text, min_pages, min_share, _whole_chunk_rows))
    often = F.broadcast(often) if often.count() <= BROADCAST_ROWS else often
    placed = map_texts(_pages(df, key, url, text), "id bigint, site bigint, start bigint, end bigint, chunk bigint", "text", _placed_chunk_rows)
    return placed.join(often, ["site", "chunk"]).select(F.col("id").alias("rec_id"), "start", "end", "pages", "site_pages")


def frequent_chunks(df: DataFrame, key="rec_id", url="url", text="text", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, rows_of=_chunk_rows) -> DataFrame:
    """(site, chunk, pages, site_pages) of chunks on at least min_pages pages and
    min_share of the site's pages.  site and chunk are hashes."""
    pages = _pages(df, key, url, text)
    sizes = pages.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("site_pages")).where(F.col("site_pages") >= min_pages)
    counts = map_texts(pages, "site bigint, page bigint, chunk bigint", "text", rows_of).distinct().groupBy("site", "chunk").agg(F.count("*").alias("pages"))
    return counts.where(F.col("pages") >= min_pages).join(sizes, "site").where(_often("pages", "site_pages", min_share))


def _often(n: str, of: str, share: float):
    return F.col(n) * 1_000_000 >= F.col(of) * round(share * 1_000_000)


def repeated_lines(df: DataFrame, key="rec_id", url="url", text="text", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(id, line_no, site, line, pages, site_pages): every occurrence of every line
    repeated excessively within its site, the first one included."""
    often = checkpoint(frequent_chunks(df, key, url, text, min_pages, min_share))
    small = often.count() <= BROADCAST_ROWS
    lines = map_texts(_pages(df, key, url, text), "id bigint, line_no bigint, site bigint, page bigint, line bigint, chunks array<bigint>", "text", _line_rows)
    keys = often.select("site", F.col("chunk").alias("c"), "site_pages")
    keys = F.broadcast(keys) if small else keys
    # the first chunk decides who is counted, the others are tested by the exact count
    possible = lines.withColumn("c", F.col("chunks")[0]).join(keys, ["site", "c"]).drop("c")
    possible = checkpoint(possible.select("id", "line_no", "site", "page", "line", "site_pages"))
    counted = possible.select("site", "line", "page", "site_pages").distinct().groupBy("site", "line").agg(F.count("*").alias("pages"), F.first("site_pages").alias("site_pages"))
    counted = counted.where((F.col("pages") >= min_pages) & _often("pages", "site_pages", min_share))
    return possible.drop("site_pages", "page").join(counted, ["site", "line"])


def without_repeated_lines(df: DataFrame, key="rec_id", url="url", text="text", **limits) -> DataFrame:
    """(rec_id, text, removed): each row's text without its repeated lines.  Rows
    that don't count (see above) keep their text as it is, null included."""
    gone = repeated_lines(df, key, url, text, **limits).groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).join(gone, "id", "left")
    kept = F.array_join(F.filter(F.split("t", "\n", -1), lambda x, i: ~F.array_contains("gone", (i + 1).cast("bigint"))), "\n")
    return rows.select(F.col("id").alias("rec_id"), F.when(F.col("gone").isNull(), F.col("t")).otherwise(kept).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
