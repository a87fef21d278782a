"""Main content of pages, by consensus on generalised line paths.

Pages come as lines, so a container is a run of lines of one shape (bulleted items,
links, short lines, sentences ...) and its path is generalised to the shape, marker,
zone of the page, first and last word, connecting words and marks, and the line with
digits and the host's own name masked.

1. Each page's containers are scored by plain signs: phrases of menus, notices, share
   prompts and footers, separators between short items, what follows a sidebar's
   heading; sentences, headings and the lists under them for the body.
2. Scored lines vote in Spark: for each host and path (a hash of KEY_BITS, so that hardly
   any two share one) how many pages have it as furniture and how many as body; and per
   host the lines that a share of its pages repeat.  All hosts together, none as more
   than HOST_CAP pages, are the prior for paths that a host has seldom or never.  Paths
   on fewer than PATH_SHARE of the texts, of a host or of all, do not vote there: the
   page's more general paths do.  As shares add up to a page's paths, both tables are
   bounded whatever the number of pages.
3. Pages are extracted again with their host's winning paths: a container is furniture
   if its lines' votes, the host's repeated lines and its own signs add up to more than
   the body's; the votes can outweigh a phrase.  A sentence or heading is body by its own signs, until enough pages of
   its host repeat it: then its votes, which are those of its copies, don't count.

A line that repeats the page's name in its url is its title and so body, as are lines
that are the message of an error page.  Null and empty texts have no lines; blank lines
belong to neither side.  Rows with a null url vote for the host ''.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrycrest.functions.urls import host, normalize_url, part
from quarrycrest.llm.common import checkpoint, map_texts
from quarrycrest.llm.residue import DUMMY, MESSAGE_WORDS, NOTICE, STATUS, has_field

KEY_BITS = 42
#: A path votes if it is on this share of the texts, and on PATH_TEXTS or more.
PATH_SHARE, PATH_TEXTS = 1e-4, 2
#: A host's line counts as repeated from this many pages and this share of its pages.
HOST_PAGES, HOST_SHARE = 3, 0.02
#: Sentences and headings need so many pages of their host, and are as likely furniture
#: as body at this share of its pages; each doubling adds REPEAT_GAIN.
LONG_PAGES, REPEAT_GAIN = 30, 4.0
LONG_SHARE = {"sentence": 0.3, "heading": 0.5}
#: A host counts as at most so many pages in the prior of a path, and the prior as so
#: many pages of the host.
HOST_CAP, PRIOR_PAGES = 200, 30.0
#: Hosts, and their entries in all, that are broadcast; beyond, pages are sorted by host.
BROADCAST_HOSTS, BROADCAST_ENTRIES = 2_000, 500_000
#: Texts of a host that go to one task at most, where pages are sorted by host.
TASK_TEXTS = 5_000
CLIP = 3.0

# The signs of step 1.
PHRASES = re.compile(
    r"^(?:skip to\b.*|jump to\b.*|close menu\b.*|toggle navigation|☰|×|menu|main menu|navigation|breadcrumbs?"
    r"|(?:↑ ?)?(?:back to )?top(?: of page)?|subscribe to\b.*|sign up for our\b.*|follow us\b.*|print this page|print|email this\b.*|share this\b.*|share|tweet\b.*|copy link"
    r"|was this page helpful\b.*|page owner\b.*|powered by\b.*|an equal opportunity\b.*|(?:©|\(c\)|copyright)\s.*|all rights reserved\b.*|last (?:reviewed|updated|modified)\b.*"
    r"|find us (?:in|at|on)\b.*|emergency:.*|(?:tel|phone|fax)[.:].*|site map|sitemap|privacy\b.{0,60}|terms of use\b.*|accessibility|report a barrier"
    r"|got it!?|ok, i understand|accept(?: all)?(?: cookies)?|reject(?: all)?|manage preferences|only necessary cookies\b.*|allow all\b.*|\[accept\].*|settings)$",
    re.I,
)
ADDRESS = re.compile(r"^\d+ [\w .'-]+ (?:street|avenue|road|drive|lane|way),.*\d{5}\b.*$|^.{0,60}\(\d{3}\) \d{3}-\d{4}.*$", re.I)
COOKIES = re.compile(
    r"\bcookies?\b(?! (?:decorating|baking|dough|sale|jar))|\btracking\b.{0,30}(?:notice|:|on this|tools)|^tracking notice|small files on your device|record of your visit|by (?:browsing|continuing|using)\b.{0,40}\byou agree\b"
    r"|you can change your mind at any time|your choices about tracking",
    re.I,
)
SIDEBARS = re.compile(
    r"^(?:related(?: pages| links| topics| content| articles)?|quick links|useful links|helpful links|most read|most viewed|popular(?: now| pages)?|trending(?: now)?|upcoming(?: events| dates)?|on this site|in this section"
    r"|see also|you may also like|you might also like|resources|more from\b.*|more resources|latest(?: news)?|recent(?: posts| news)?|what.?s new|news and events|explore(?: more)?|also on this site|elsewhere on this site|dates to know|don.t miss|at a glance|featured|top links|more like this|for you|shortcuts)\W*$",
    re.I,
)
TRAIL = re.compile(r"^\W*(?:home|start|main)\s*(?:»|>|/|::|›|→|\|)\s*\S.*$", re.I)
SPLIT = re.compile(r"\s+[|/·•»›>–—]\s+|\s*::\s*|\s{2,}|\s*\|\s*|\s*·\s*|\s*•\s*")
MARKER = re.compile(r"(?:([-*•›»·–—▪◦‣+])|(#{1,6})|(\d{1,2}[.)]))\s+(?=\S)")
LINK_ROW = re.compile(r"^(?:\W*\[[^\]]*\]\([^)]*\)){3,}\W*$")
LINK = re.compile(r"^\[([^\]]*)\]\([^)]*\)\W*$")
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
JOINTS = frozenset("a an and at by for from how in into is of on or our per the this to what who with you your".split())
END = re.compile(r"[.!?。！？][\"'”’)\]]*$")

FURNITURE, BODY = 1, 0


#: Shapes of lines that a worker remembers; then it starts afresh.
REMEMBERED = 200_000
#: One of these is in every notice, so that only few sentences are searched for them.
HINTS = ("ookie", "rack", "browsing", "continuing", "using", "device", "change your mind")


def notice(text: str) -> bool:
    return any(h in text for h in HINTS) and COOKIES.search(text) is not None


class Shape:
    """What a line looks like on its own; equal lines of a host share one."""

    __slots__ = ("text", "marker", "link", "words", "kind", "sign", "key", "buckets", "sidebar", "message")

    def __init__(self, raw: str, label: str):
        text = raw.strip()
        m = MARKER.match(text)
        self.marker = "" if m is None else m[1] or (m[2] and "#") or "1"
        if m is not None:
            text = text[m.end() :]
        self.sidebar = self.message = self.link = False
        link = LINK.match(text)
        self.link = link is not None
        self.text = text = (link[1] if link else text).strip("_* ") or text
        low = text.lower()
        if label:
            low = low.replace(label, "\x00")
        masked = " ".join(DIGITS.sub("0", low).split())
        self.words = words = WORD.findall(masked)
        sentence = len(text) > 45 and text[-1] in ".!?" and text.count(" ") >= 5
        parts = () if sentence else [p for p in SPLIT.split(text) if p]
        if self.marker == "#":
            self.kind = "heading"
        elif LINK_ROW.match(text):
            self.kind = "items"
        elif sentence:
            self.kind = "sentence"
        elif len(parts) >= 2 and max(len(p.split()) for p in parts) <= 5 and not END.search(text):
            self.kind = "items"
        elif len(words) >= 6 and END.search(text) or len(words) >= 25:
            self.kind = "sentence"
        elif self.link:
            self.kind = "link"
        elif self.marker:
            self.kind = "item"
        else:
            self.kind = "short"
        # a sentence's numbers are content: pages that differ in them don't repeat it
        line = " ".join(low.split()) if self.kind == "sentence" else masked
        self.key = xxhash.xxh64_intdigest(MARKS.sub("", line) or line)
        joints = " ".join([w for w in words if w in JOINTS])
        ends = (words[0], words[-1]) if words else ("", "")
        marks = NOT_MARKS.sub("", masked)
        feats = [("f", ends[0]), ("l", ends[1]), ("j", joints, marks), ("w", " ".join(words[:2])), ("k", self.kind, self.marker)]
        if self.kind != "sentence":  # whose copies are counted as such, not as votes
            feats.append(("t", masked))
        # hardly any sentence comes again, so its features aren't remembered
        self.buckets = tuple((number if self.kind == "sentence" else bucket)(*f) for f in feats)
        self.sidebar = self.marker != "#" and SIDEBARS.match(text) is not None
        plain = text.lower()
        self.message = not MESSAGE_WORDS.isdisjoint(words) and any(p.search(plain) for p in MESSAGES) or has_field(text)
        if PHRASES.match(text) or ADDRESS.match(text) or TRAIL.match(text) or notice(text):
            self.sign = 6.0
        elif self.sidebar:
            self.sign = 5.0
        elif self.message:
            self.sign = -8.0  # an error page's own, or residue where content should be
        else:
            self.sign = {"items": 2.5, "heading": -4.0, "sentence": -4.0, "link": 2.0}.get(self.kind, 0.0)


class Line:
    """A shape at its place on a page."""

    __slots__ = ("number", "shape", "sign", "zone", "run")

    def __init__(self, number: int, shape: Shape):
        self.number, self.shape, self.sign = number, shape, shape.sign


#: Without regard to case they are searched for faster in lower case.
MESSAGES = [re.compile(p.pattern) for p in (STATUS, NOTICE, DUMMY)]
DIGITS, MARKS, NOT_MARKS = re.compile(r"\d+"), re.compile(r"[\W_]+"), re.compile(r"[\w\s]+")
_shapes: dict[tuple[str, str], Shape] = {}


@lru_cache(500_000)
def bucket(*feature: str) -> int:
    return number(*feature)


def number(*feature: str) -> int:
    return xxhash.xxh64_intdigest("\x01".join(feature)) >> (64 - KEY_BITS)


def shape_of(raw: str, label: str) -> Shape:
    found = _shapes.get((raw, label))
    if found is None:
        if len(_shapes) > REMEMBERED:
            _shapes.clear()
        found = Shape(raw, label)
        if found.kind != "sentence":  # sentences hardly ever come again
            _shapes[raw, label] = found
    return found


def own_name(site: str) -> str:
    """The host's first label, which its furniture likes to name."""
    label = (site or "").split(".")[0].lower()
    return label if len(label) >= 3 else ""


@lru_cache(50_000)
def title_words(path: str) -> list[str]:
    words = WORD.findall((path or "").rstrip("/").rsplit("/", 1)[-1].lower().replace("-", " "))
    while words and (words[-1].isdigit() or words[-1] in ("html", "htm", "php")):
        words.pop()
    return words


def read(text: str, site: str, path: str) -> list[Line]:
    """The lines of a page; containers are numbered in ``run``."""
    label, title = own_name(site), title_words(path)
    lines = [Line(i, shape_of(raw, label)) for i, raw in enumerate(text.split("\n"), 1) if raw and not raw.isspace()]
    body = [k for k, x in enumerate(lines) if x.sign <= -4]
    low, high = (body[0], body[-1]) if body else (len(lines), -1)
    run, before = 0, None
    for k, x in enumerate(lines):
        s = x.shape
        x.zone = "top" if k < low else "end" if k > high else "in"
        if title and s.words == title and not s.link and s.kind in ("short", "heading") and x.sign < 5:
            x.sign = -8.0  # the page's title
        shape = (s.kind, s.marker) if s.kind in ("item", "link", "short") else None
        if before is None or shape is None or shape != before[1] or x.number != before[0] + 1 or abs(x.sign) >= 4 or before[2]:
            run += 1
        x.run = run
        before = (x.number, shape, abs(x.sign) >= 4)
    return lines


def buckets_of(x: Line) -> tuple[int, ...]:
    s = x.shape
    return (*s.buckets, bucket("z", x.zone, s.kind, s.marker)) if s.buckets else ()


def first_labels(lines: list[Line]) -> list[int | None]:
    """What the signs alone say: furniture, body, or nothing."""
    out: list[int | None] = [None] * len(lines)
    mode = None  # what the lines after a heading, sentence or sidebar belong to
    before = 0
    for k, x in enumerate(lines):
        kind = x.shape.kind
        if x.number > before + 1:
            mode = None if mode == FURNITURE else mode
        before = x.number
        if x.sign >= 4:
            out[k] = FURNITURE
            mode = FURNITURE if x.shape.sidebar else "edge"
        elif x.sign <= -4:
            out[k] = BODY
            mode = BODY
        elif x.sign >= 2 and mode != BODY:
            out[k] = FURNITURE
        elif mode == FURNITURE:
            out[k] = FURNITURE
        elif mode == BODY and kind == "item" and x.zone == "in":
            out[k] = BODY
        elif x.sign >= 2:
            out[k] = FURNITURE
        elif kind == "short" and k + 1 < len(lines) and lines[k + 1].shape.kind == "sentence" and lines[k + 1].sign <= -4:
            out[k] = BODY  # heads the sentence below
        elif x.zone == "top" and mode == "edge" and kind in ("short", "item"):
            out[k] = FURNITURE
    return out


class Host:
    """What a host's pages say: log odds of furniture by path, the prior's where the host
    has a path seldom, and the lines that its pages repeat.  prior is clipped."""

    def __init__(self, prior: dict[int, float], paths=(), furniture=(), body=(), repeated=()):
        self.prior, self.repeated = prior, dict(repeated)
        self.own = {p: host_vote(f, b, prior.get(p, 0.0)) for p, f, b in zip(paths, furniture, body)}
        self.known: dict[Shape, float] = {}

    def vote(self, path: int) -> float:
        own = self.own.get(path)
        return self.prior.get(path, 0.0) if own is None else own

    def votes(self, x: Line) -> float:
        s = x.shape
        if not s.buckets:
            return 0.0
        total = self.known.get(s)
        if total is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            total = sum(map(self.vote, s.buckets))
            if s.kind != "sentence":
                self.known[s] = total
        return total + self.vote(bucket("z", x.zone, s.kind, s.marker))


def host_vote(furniture: float, body: float, prior: float) -> float:
    share = 1 / (1 + math.exp(-prior))
    odds = math.log((furniture + PRIOR_PAGES * share) / (body + PRIOR_PAGES * (1 - share)))
    return max(-CLIP, min(CLIP, odds))


def judge(lines: list[Line], site: Host) -> list[bool]:
    """Whether each line is furniture, container by container."""
    sums: dict[int, float] = {}
    for x in lines:
        s = x.shape
        share = site.repeated.get(s.key)
        if share and x.sign == -4 and s.kind in LONG_SHARE:
            own = REPEAT_GAIN * math.log2(share / LONG_SHARE[s.kind])
        else:
            own = site.votes(x) / 2 + x.sign
        if share is not None and x.sign > -4:
            own += 2.0 if s.kind != "item" or x.zone != "in" else 0.5
        sums[x.run] = sums.get(x.run, 0.0) + own
    return [x.sign > -8 and sums[x.run] > 0 for x in lines]


def _rows(tables: dict[str, DataFrame]) -> DataFrame:
    parts = None
    for name, df in tables.items():
        p = df.where(F.col("text") != "").select(F.lit(name).alias("tbl"), F.col("rec_id").cast("bigint").alias("rec_id"), F.coalesce("url", F.lit("")).alias("url"), "text")
        parts = p if parts is None else parts.unionByName(p)
    page = normalize_url(F.col("url"))
    return parts.select("tbl", "rec_id", F.coalesce(host(page), F.lit("")).alias("site"), part(page, 5).alias("path"), F.xxhash64(page).alias("page"), "text")


def _seen_rows(batch: pa.RecordBatch, texts: list):
    """Votes of a slice, summed by site and path, and its distinct (site, page, line)."""
    sites, paths, pages = (batch.column(i).to_pylist() for i in (2, 3, 4))
    names: dict[str, int] = {}
    votes: list[int] = []
    own = set()
    for text, site, path, page in zip(texts, sites, paths, pages):
        lines = read(text, site, path)
        at = names.setdefault(site, len(names)) << (KEY_BITS + 1)  # a slice has fewer texts than the bits left
        votes += {at | b << 1 | label for x, label in zip(lines, first_labels(lines)) if label is not None for b in buckets_of(x)}
        own |= {(site, page, x.shape.key) for x in lines}
    cast, count = np.unique(np.array(votes, np.int64), return_counts=True)
    at, back = np.unique(cast >> 1, return_inverse=True)
    sums = np.zeros((len(at), 2), np.int64)
    sums[back, cast & 1] = count
    site, page, key = zip(*own) if own else ((), (), ())
    n, m = len(at), len(own)
    keys = np.concatenate((at & (1 << KEY_BITS) - 1, np.array(key, np.uint64).view(np.int64)))
    zeros, by_number = np.zeros(m, np.int64), list(names)
    voted = [by_number[i] for i in (at >> KEY_BITS).tolist()]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n + m) < n), pa.array(voted + list(site), pa.string()), pa.array([0] * n + list(page), pa.int64()), pa.array(keys), pa.array(np.concatenate((sums[:, FURNITURE], zeros))), pa.array(np.concatenate((sums[:, BODY], zeros)))],
        ["is_path", "site", "page", "key", "f", "b"],
    )


ENTRIES = "paths array<bigint>, furniture array<int>, body array<int>, repeated array<bigint>, shares array<float>"


def consensus(rows: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """(prior, hosts) in one reading of the texts.

    prior: paths and their log odds of furniture over all hosts.  As each is on PATH_SHARE
    of the texts, at most 1 / PATH_SHARE times a page's paths come to the driver.
    hosts: (site, texts, paths, furniture, body, repeated, shares): the votes of the paths on
    HOST_PAGES and PATH_SHARE of its texts, and the lines that HOST_SHARE of its pages
    repeat; bounded in the same way."""
    seen = map_texts(rows, "is_path boolean, site string, page bigint, key bigint, f bigint, b bigint", "text", _seen_rows)
    once = seen.groupBy("is_path", "site", "page", "key").agg(F.sum("f").alias("f"), F.sum("b").alias("b"))
    counts = once.groupBy("is_path", "site", "key").agg(F.count("*").alias("n"), F.sum("f").alias("f"), F.sum("b").alias("b"))
    counts = checkpoint(counts.where(F.col("is_path") | (F.col("n") >= HOST_PAGES)))
    weight = F.least(F.lit(1.0), HOST_CAP / (F.col("f") + F.col("b")))
    sizes = checkpoint(rows.groupBy("site").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("texts")))
    texts = sizes.agg(F.sum("texts")).first()[0] or 0
    paths = counts.where("is_path").groupBy("key").agg(F.sum(F.col("f") * weight).alias("f"), F.sum(F.col("b") * weight).alias("b"), F.sum(F.col("f") + F.col("b")).alias("n"))
    got = paths.where(F.col("n") >= max(PATH_TEXTS, PATH_SHARE * texts)).select("key", "f", "b").toArrow()
    f, b = (got.column(c).to_numpy().astype(float) for c in "fb")
    # as if everything had also been seen a little on both sides
    odds = np.clip(np.log((f + 0.5) / (b + 0.5)) * np.minimum(1.0, (f + b) / 4), -CLIP, CLIP).astype(np.float32)
    prior = (got.column("key").to_numpy(), odds)
    often = counts.where("not is_path").join(sizes, "site").where(F.col("n") >= F.col("pages") * HOST_SHARE)
    # too few pages say nothing of a sentence: its share is 0
    share = F.when(F.col("n") >= LONG_PAGES, F.col("n") / F.col("pages")).otherwise(0.0).cast("float")
    lines = often.groupBy("site").agg(F.collect_list(F.struct("key", share.alias("share"))).alias("r")).select("site", F.col("r.key").alias("repeated"), F.col("r.share").alias("shares"))
    voted = counts.where(F.col("is_path") & (F.col("f") + F.col("b") >= HOST_PAGES)).join(sizes, "site").where(F.col("f") + F.col("b") >= F.col("texts") * PATH_SHARE)
    voted = voted.select("site", F.struct("key", *(F.col(c).cast("int").alias(c) for c in ("f", "b"))).alias("v"))
    voted = voted.groupBy("site").agg(F.collect_list("v").alias("v")).select("site", F.col("v.key").alias("paths"), F.col("v.f").alias("furniture"), F.col("v.b").alias("body"))
    return prior, sizes.select("site", "texts").join(voted, "site", "left").join(lines, "site", "left")


def furniture(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, rec_id, line_nos, text): the numbers of each row's furniture lines, and the
    text without them.  tables maps names to DataFrames with rec_id, url and text."""
    rows = _rows(tables)
    prior, hosts = consensus(rows)
    context = rows.sparkSession.sparkContext
    sent_prior = context.broadcast(prior)
    hosts = checkpoint(hosts)
    names = [c.split()[0] for c in ENTRIES.split(", ")]
    length = lambda c: F.size(F.coalesce(c, F.array()))
    n, entries = hosts.agg(F.count("*"), F.sum(length("paths") + length("repeated"))).first()
    few = n <= BROADCAST_HOSTS and (entries or 0) <= BROADCAST_ENTRIES
    sent = context.broadcast({r[0]: r[1:] for r in zip(*(c.to_pylist() for c in hosts.select("site", *names).toArrow().columns))} if few else None)
    if few:
        joined = rows.select("tbl", "rec_id", "site", "path", "text")
    else:
        # each task meets a host's entries, then at most about TASK_TEXTS of its pages
        tasks = F.ceil(F.col("texts") / TASK_TEXTS).cast("int")
        pages = rows.join(hosts.select("site", tasks.alias("tasks")), "site").withColumn("task", F.pmod(F.xxhash64("tbl", "rec_id"), F.col("tasks")).cast("int"))
        pages = pages.select("tbl", "rec_id", "site", "path", "text", "task", F.lit(1).alias("rank"), *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ENTRIES.split(", ")))
        heads = hosts.select(F.lit("").alias("tbl"), F.lit(0).cast("bigint").alias("rec_id"), "site", F.lit("").alias("path"), F.lit("").alias("text"), F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"), F.lit(0).alias("rank"), *names)
        joined = heads.unionByName(pages).repartition("site", "task").sortWithinPartitions("site", "task", "rank")

    known: dict[str, Host] = {}
    shared: list[dict[int, float]] = []

    def entries_of(values) -> Host:
        paths, f, b, repeated, shares = (x or () for x in values)
        return Host(shared[0], paths, f, b, ((k & (1 << 64) - 1, s) for k, s in zip(repeated, shares)))

    def run(batch: pa.RecordBatch, texts: list):
        if not shared:
            shared.append(dict(zip(*(x.tolist() for x in sent_prior.value))))
        sites, paths = (batch.column(i).to_pylist() for i in (2, 3))
        head = batch.column(6).to_pylist() if sent.value is None else None
        numbers, kept, take = [], [], []
        for i, (text, site, path) in enumerate(zip(texts, sites, paths)):
            if head is not None and head[i] == 0:
                known.clear()
                known[site] = entries_of(batch.column(k)[i].as_py() for k in range(7, 7 + len(names)))
                continue
            own = known.get(site)
            if own is None:
                own = known[site] = entries_of(sent.value[site])
            lines = read(text, site, path)
            gone = [x.number for x, f in zip(lines, judge(lines, own)) if f]
            numbers.append(gone)
            out = set(gone)
            take.append(i)
            kept.append("\n".join(t for i, t in enumerate(text.split("\n"), 1) if i not in out) if gone else text)
        take = pa.array(take, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(numbers, pa.list_(pa.int64())), pa.array(kept, pa.string())], ["tbl", "rec_id", "line_nos", "text"])

    return map_texts(joined, "tbl string, rec_id bigint, line_nos array<bigint>, text string", "text", run)
