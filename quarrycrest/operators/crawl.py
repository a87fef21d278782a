"""Frontier expansion over a table of pages.

Each depth is one join of the frontier with the pages and one anti-join of the found
links with what has been visited; the driver only loops over depths, of which there
are a few.  Every depth is checkpointed, so plans don't grow and a lost executor
costs one depth at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrycrest.functions.urls import is_blocked, let, normalize_url, resolve_url
from quarrycrest.operators.order import checkpoint, numbered

#: Links followed from a page of each depth by the catalogue crawl (fixed values).
LINKS_BY_DEPTH = {1: 5, 2: 5, 3: 4, 4: 3, 5: 0}
#: and by the crawl from seeds, which are depth 0.
SEED_LINKS_BY_DEPTH = {0: 2, 1: 0, 2: 0}


def has_content(flag: Column) -> Column:
    """False only for a false, in whatever spelling; missing counts as true."""
    return F.lower(F.coalesce(flag.cast("string"), F.lit("true"))) != "false"


def fetch(urls: DataFrame, pages: DataFrame, url: str = "url", text: str = "text") -> DataFrame:
    """The urls with the text of their page; null where there is none (failed)."""
    return urls.join(pages.select(F.col(url), F.col(text)), url, "left")


def known_urls(*tables: DataFrame, url: str = "url") -> DataFrame:
    """Distinct normalised urls of all tables."""
    parts = [t.where(F.col(url).isNotNull()).select(normalize_url(F.col(url)).alias("url")) for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def seed_plan(seeds: DataFrame, processed: DataFrame) -> DataFrame:
    """Seeds (ord, url) with ``links_only``: already processed, so only their links are
    wanted.  A seed that repeats an unprocessed one is left out."""
    n = seeds.withColumn("url", normalize_url(F.col("url")))
    flagged = n.join(processed.select("url").distinct().withColumn("done", F.lit(True)), "url", "left").withColumn("links_only", F.col("done").isNotNull())
    first = n.groupBy("url").agg(F.min("ord").alias("first"))  # an aggregate: a url repeated often is no task of its own
    return flagged.join(first, "url").where(F.col("links_only") | (F.col("ord") == F.col("first"))).select("ord", "url", "links_only")


def expand(frontier: DataFrame, pages: DataFrame, domain: str, blocked: list[str], limit: int | None, normalize: bool) -> DataFrame:
    """(url, depth, department, school, place) of the links of the frontier's pages, each
    once, from the parent that came first.  ``limit`` takes a page's first links before
    any is tested.  A page's own department and school count where it has them, else
    its parent's.  One join with the pages brings links and labels."""
    own = F.slice("links", 1, limit) if limit is not None else F.col("links")
    pick = lambda c: F.coalesce(F.nullif(F.col(f"own_{c}"), F.lit("")), F.col(c)).alias(c) if f"own_{c}" in rows.columns else F.col(c)
    labels = [F.col(c).alias(f"own_{c}") for c in ("department", "school") if c in pages.columns]
    rows = frontier.join(pages.select("url", "links", *labels), "url")
    rows = rows.select(F.col("url").alias("parent"), "depth", pick("department"), pick("school"), "ord", F.posexplode(own).alias("pos", "link"))
    target = resolve_url(F.col("parent"), F.col("link"), domain)
    rows = rows.withColumn("url", let(target, normalize_url) if normalize else target).where(F.col("url").isNotNull() & ~is_blocked(F.col("url"), domain, blocked))
    first = rows.groupBy("url").agg(F.min(F.struct("ord", "pos", (F.col("depth") + 1).alias("depth"), "department", "school")).alias("f"))
    return first.select("url", "f.depth", "f.department", "f.school", F.struct("f.ord", "f.pos").alias("place"))


def crawl(
    seeds: DataFrame, pages: DataFrame, domain: str, blocked: list[str], max_depth: int = 2, by_depth: dict[int, int] | None = None,
    normalize: bool = True, first_depth: int = 1, visited: DataFrame | None = None,
) -> DataFrame:
    """(ord, url, depth, department, school) of every page reached from the seeds
    (ord, url, depth, department, school), each at its earliest place in a
    breadth-first walk; the seeds' depth is first_depth.

    pages: (url, links array<string>, department, school), one row a url; urls that
    are not there failed and stay visited, as do those of ``visited`` (url) from the
    start, which seeds may be all the same.  ``ord`` ranks within a depth by parent and
    position, which is the order in which a queue would have them."""
    by_depth = LINKS_BY_DEPTH if by_depth is None else by_depth
    first = seeds.groupBy("url").agg(F.min(F.struct("ord", "depth", "department", "school")).alias("f")).select("url", "f.*")
    level = checkpoint(first)
    seen = level.select("url") if visited is None else level.select("url").unionByName(visited.select("url"))
    out = level
    for depth in range(first_depth, max_depth):
        if by_depth.get(depth) == 0:
            break
        found = expand(level, pages, domain, blocked, by_depth.get(depth), normalize).join(seen, "url", "left_anti")
        level = numbered(found, ["place"]).drop("place")
        if level.isEmpty():
            break
        out = out.unionByName(level.select(*out.columns))
        seen = seen.unionByName(level.select("url"))
    return out
