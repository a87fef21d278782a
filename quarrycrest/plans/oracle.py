"""SQL for DuckDB that computes the core's queries in another way."""

from __future__ import annotations

from quarrycrest.functions import text as X

DOMAIN, ORGANISATION = "quillhaven.example", "Quillhaven University"
SPACES = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
# Fixed values, written out here a second time so that a wrong rule cannot be wrong on both sides.
WWW = f"https://www.{DOMAIN}"
SKIPPED = [
    f"{WWW}/admissions", f"{WWW}/visit", f"{WWW}/about", f"{WWW}/research", f"{WWW}/working", f"{WWW}/assets",
    f"https://everbetter.{DOMAIN}", f"{WWW}/academics/programs", f"https://studentlife.{DOMAIN}/n/1",
]
BY_SEEDS = "/news/ /events/ /people/ /faculty/ /staff/ /directory/ /gallery/ /photos/ /media/ /giving/ /donate/ /blog/ /login /secure mailto: .jpg .jpeg .png .gif".split()
BY_CATALOG = (
    "/news/ /events/ /calendar/ /people/ /faculty/ /staff/ /directory/ /gallery/ /photos/ /media/ /giving/ /donate/ /blog/ /jobs/ /careers/ /employment/ /forms/ /login /secure"
    " mailto: .pdf .jpg .jpeg .png .gif"
).split()
UNDER = "/(undergraduate|undergrad|ugrad)(/|\\.|$)|/college/|/admissions/(apply|undergraduate|first-year|transfer)"
GRADUATE = (
    "/(graduate|grad|phd|masters)(/|\\.|$)|/mba(/|\\.|$|-)|/ms-|/ma/|/master-|/doctoral|/postdoc|/gradstudies"
    f"|simon\\.{DOMAIN}/programs/|(warner|son|urmc)\\.{DOMAIN}|{DOMAIN}/medicine"
)


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SOURCES = " UNION ALL ".join(
    f"SELECT {quote(t)} AS _source, {i} AS src_ord, rec_id, url, department, school, content_type, text, chunk_index, chunk_total FROM {t}" for i, t in enumerate(("academic_info", "campus_life_data", "gap_fill_data"))
)
ID = "md5(coalesce(url, '') || '__chunk_' || coalesce(chunk_index, 0))"


def replace(column: str, pattern: str, to: str = "", options: str = "g") -> str:
    return f"regexp_replace({column}, {quote(pattern)}, {quote(to)}, '{options}')"


def strip(column: str) -> str:
    return replace(column, rf"^{SPACES}+|{SPACES}+$", "")


def authority(url: str) -> str:
    return f"regexp_extract({url}, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)"


def host(url: str) -> str:
    return f"regexp_replace(lower({authority(url)}), '^www\\.', '')"


def normalized(url: str) -> str:
    path = f"regexp_replace(regexp_extract({url}, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1), '/+$', '')"
    query = f"CASE WHEN regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1) <> '' THEN '?' || regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1) ELSE '' END"
    return f"CASE WHEN {url} IS NULL THEN NULL ELSE 'https://' || {host(url)} || coalesce(nullif({path}, ''), '/') || {query} END"


def cleaned(column: str, rules: tuple[int, ...]) -> str:
    """The cleaning rules for RE2, which has no lookahead: what a rule would only look
    at is captured and put back, or masked before and restored after."""
    table = X.cleaning_rules(ORGANISATION)
    for number in rules:
        pattern, to = table[number]
        if number == 19:
            column = f"replace({column}, '](mailto', ']' || chr(1) || 'mailto')"
            column = replace(column, r"\[([^\]]+)\]\([^)]+\)", r"\1")
            column = f"replace({column}, ']' || chr(1) || 'mailto', '](mailto')"
            continue
        pattern = pattern.replace(r"(?=\n\n|\z)", r"(\n\n|\z)")
        if pattern.endswith(r"(\n\n|\z)"):
            to = r"\1"
        head, flags = "", pattern[2 : pattern.index(")")] if pattern.startswith("(?") and pattern[2] not in ":=!" else ""
        if flags:
            pattern = pattern[pattern.index(")") + 1 :]
            flags = flags.replace("d", "").replace("u", "")
            head = f"(?{flags})" if flags else ""
        column = replace(column, head + pattern, to.replace("$", "\\"))
    return strip(column)


KNN = """
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id AS id, r.label, round(1 - list_cosine_similarity(q.v, r.v), 12) AS d
  FROM e q JOIN e r ON q.vec_id % 50 = 0 {where}),
ranked AS (
  SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM scored
  QUALIFY rank <= 8)
"""
CANDIDATES = (
    KNN.format(where="")
    + """,
asked AS (SELECT *, query_id // 200 AS question, (query_id % 200) // 50 AS query_ord FROM ranked),
once AS (
  SELECT question, id, query_ord, rank, d FROM asked
  QUALIFY row_number() OVER (PARTITION BY question, id ORDER BY query_ord, rank) = 1),
candidates AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY query_ord, rank) AS pos FROM once),
top AS (
  SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY round(d, 9), pos) AS place FROM candidates
  QUALIFY place <= 5)
"""
)
CONTEXT = """
context AS (
  SELECT question, string_agg('[Source: ' || coalesce(url, '') || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context
  FROM top JOIN documents ON doc_id = id GROUP BY question)
"""
KEYED = f"keyed AS (SELECT {ID} AS id, _source, src_ord, rec_id, text FROM ({SOURCES}))"
STATES = f"""
{KEYED},
old AS (SELECT {ID} AS id, rec_id, text AS document FROM campus_life_data
  QUALIFY row_number() OVER (PARTITION BY {ID} ORDER BY rec_id) = 1),
new AS (SELECT id, rec_id, text AS document FROM keyed
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY src_ord DESC, rec_id DESC) = 1)
"""
LINK = rf"\((https?://[^\s\)]+{DOMAIN.replace('.', chr(92) + '.')}[^\s\)]*)\)"
LINKS = f"""
links AS (
  SELECT _source, rec_id, url, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT *, regexp_extract_all(coalesce(text, ''), {quote(LINK)}, 1) AS l FROM ({SOURCES})))
"""


def blocked(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join([f"NOT contains(lower({column}), {quote(DOMAIN)})", *(f"contains(lower({column}), {quote(p)})" for p in patterns)]) + ")"


def chunked(source: str) -> str:
    """Recursive walk over texts of a relation (k, t): rows (k, i, chunk)."""
    return rf"""
walk(k, t, start, stop, done) AS (
  SELECT k, t, 0, CASE WHEN length(t) <= 1500 THEN length(t) ELSE {_end('0')} END, length(t) <= 1500 FROM {source} WHERE length(t) > 0
  UNION ALL
  SELECT k, t, s, CASE WHEN length(t) - s <= 1500 THEN length(t) ELSE {_end('s')} END, length(t) - s <= 1500
  FROM (SELECT k, t, least(stop, greatest(stop - 300, 0) + length(regexp_extract(substring(t, greatest(stop - 300, 0) + 1), '^(?s:[^\t-\r\x1c-\x20\x{{85}}\p{{Z}}]*)[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]'))) AS s
        FROM walk WHERE NOT done) WHERE s < length(t)),
pieces AS (
  SELECT k, start, {strip('substring(t, start + 1, stop - start)')} AS chunk FROM walk),
numbered AS (SELECT k, chunk, row_number() OVER (PARTITION BY k ORDER BY start) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM pieces WHERE chunk <> '')
"""


def _end(s: str) -> str:
    """End of the chunk at s, of a text that goes on beyond s + 1500."""
    low = f"({s} + 1300)"
    window = f"substring(t, {low} + 1, 200)"
    # reverse() would keep a carriage return before its line feed, so lengths of greedy matches are taken
    line = f"length(regexp_extract({window}, '(?s)^.*\\n'))"
    stop = f"length(regexp_extract({window}, '(?s)^.*\\. '))"
    return f"CASE WHEN {line} > 0 THEN {low} + {line} WHEN {stop} > 0 THEN {low} + {stop} - 1 ELSE {s} + 1500 END"


def html_of(text: str) -> str:
    body = replace(f"coalesce({text}, '')", r"\[([^\]\n]+)\]\((https?://[^)\n]+)\)", r"<a class=" + '"x"' + r" href='\2'>\1</a>")
    head = "<!DOCTYPE html><html><head><title>Page &amp; more</title><style>p {}</style></head><body><nav><a href='/home'>Home</a></nav><!-- c --><p>"
    tail = "</p><script>if (a < b) {}</script><footer>Foot <b>note</b></footer></body></html>"
    return f"{quote(head)} || replace({body}, chr(10), '</p>' || chr(10) || '<p>') || {quote(tail)}"


ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""


def html_text(html: str) -> str:
    t = replace(html, r"(?s:<!--.*?-->)|(?i:<!doctype[^>]*>)")
    for tag in ("script", "style", "nav", "footer", "header"):
        t = replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>")
    t = replace(t, ANCHOR, "\n[\\2](\\1)\n")
    t = replace(t, r"\[\s*\]\(([^)]*)\)", r"\1")
    t = replace(t, r"<[^>]+>", "\n")
    for name, char in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}.items():
        t = f"replace({t}, {quote(name)}, {quote(char)})"
    return f"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: {strip('x')}), lambda x: x <> ''), chr(10))"


def audience(url: str) -> str:
    # RE2 has no lookahead: the one path that isn't an undergraduate one is masked
    low = f"regexp_replace(lower(coalesce({url}, '')), '/college/gradstudies(/|$)', '/college-gradstudies /gradstudies\\1', 'g')"
    under, grad = (f"regexp_matches({low}, {quote(p)})" for p in (UNDER, GRADUATE))
    return f"CASE WHEN ({under}) AND NOT ({grad}) THEN 'undergrad' WHEN ({grad}) AND NOT ({under}) THEN 'grad' ELSE 'both' END"


PAGES = f"""
urls AS (SELECT {normalized('url')} AS url, src_ord, rec_id, text, department, school FROM ({SOURCES}) WHERE url IS NOT NULL),
first_pages AS (SELECT * FROM urls QUALIFY row_number() OVER (PARTITION BY url ORDER BY src_ord, rec_id) = 1),
pages AS (
  SELECT *, list_filter([lead(url, 1) OVER w, lead(url, 2) OVER w], lambda x: x IS NOT NULL) || regexp_extract_all(coalesce(text, ''), {quote(LINK)}, 1) AS links
  FROM first_pages WINDOW w AS (PARTITION BY {host('url')} ORDER BY url))
"""


def _level(n: int, limit: int | None) -> str:
    """Pages of depth n + 1: targets of the first links of depth n not seen before."""
    take = f"list_slice(links, 1, {limit})" if limit is not None else "links"
    seen = " AND ".join(f"url NOT IN (SELECT url FROM d{i})" for i in range(1, n + 1))
    return f"""
d{n + 1} AS (
  SELECT DISTINCT url FROM (
    SELECT {normalized('link')} AS url FROM (SELECT unnest({take}) AS link FROM pages JOIN d{n} USING (url))
    WHERE contains({authority('link')}, {quote(DOMAIN)}) AND NOT {blocked(normalized('link'), BY_SEEDS)})
  WHERE {seen})
"""


WALK = f"{PAGES}, d1 AS (SELECT min(url) AS url FROM pages GROUP BY {host('url')}), {_level(1, 5)}, {_level(2, 5)}, {_level(3, 4)}, walk AS (SELECT url, 1 AS depth FROM d1 UNION ALL SELECT url, 2 FROM d2 UNION ALL SELECT url, 3 FROM d3 UNION ALL SELECT url, 4 FROM d4)"


def field(name: str) -> str:
    value = strip(f"coalesce({name}, '')")
    order = "-length(v), nl, coalesce(code, ''), rec_id"
    return f"""SELECT base, '{name}' AS f, v FROM (
      SELECT base, code, rec_id, type IS NULL OR type <> 'Lecture' AS nl, {value} AS v FROM sections)
    WHERE v <> '' QUALIFY row_number() OVER (PARTITION BY base ORDER BY nl, {order}) = 1"""


BASE = strip(replace("code", r"-\d{1,3}$"))
SECTIONS = f"sections AS (SELECT *, {BASE} AS base FROM courses WHERE code IS NOT NULL)"
BEST = f"best AS ({' UNION ALL '.join(field(f) for f in ('description', 'notes', 'restrictions', 'offered'))})"
BESTS = ", ".join(f"coalesce(max(v) FILTER (WHERE f = '{f}'), '') AS {f}" for f in ("description", "notes", "restrictions", "offered"))
FIX = "regexp_replace(coalesce(instructor, ''), '^[;\\s]+', '')"
TURNS = "turns AS (SELECT user_id::VARCHAR AS session_id, ts, event_id AS turn, CASE WHEN event_type = 'click' THEN 'user' ELSE 'assistant' END AS role, event_type AS text FROM events)"
HISTORY = "history AS (SELECT session_id, string_agg(role || ':' || text, ',' ORDER BY turn) AS messages FROM turns GROUP BY session_id)"
NOISE = ["https", "Print", "Share", "Menu", "Skip to", "Back to top"]
STRIPPED_LINE = strip("line")
RENDERED = """'Course Code: ' || coalesce(code, '') || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || 'Credits: ' || coalesce(credits, '') || ' | Offered: ' || coalesce(offered, '') || chr(10)
  || 'Description: ' || coalesce(description, '') || chr(10)
  || CASE WHEN coalesce(notes, '') <> '' THEN 'Important Notes: ' || notes || chr(10) ELSE '' END
  || CASE WHEN coalesce(restrictions, '') <> '' THEN 'Restrictions: ' || restrictions || chr(10) ELSE '' END"""


MERGED = f"""WITH {SECTIONS}, {BEST}, b AS (SELECT base, {BESTS} FROM best GROUP BY base),
            o AS (SELECT *, type IS NULL OR type <> 'Lecture' AS nl, {FIX} AS fixed FROM sections),
            g AS (SELECT base, first(coalesce(title, '') ORDER BY nl, code, rec_id) AS title, first(coalesce(credits, '') ORDER BY nl, code, rec_id) AS credits,
                string_agg(code || '|' || coalesce(type, '') || '|' || fixed, ';' ORDER BY nl, code, rec_id) AS sections FROM o GROUP BY base)
            SELECT g.base AS code, title, credits, coalesce(offered, '') AS offered, coalesce(description, '') AS description, coalesce(notes, '') AS notes, coalesce(restrictions, '') AS restrictions, sections
            FROM g LEFT JOIN b USING (base)"""


CATEGORIES = {
    "housing": "Housing", "dining": "Dining", "transportation": "Transportation", "campus life": "Campus Life", "financial aid": "Financial Aid",
    "health & wellness": "Health & Wellness", "career services": "Career Services", "athletics": "Athletics", "it services": "IT Services",
    "international students": "International Students", "registrar": "Registrar", "bursar": "Bursar",
}
KINDS = "Lecture|Seminar|Lab|Recitation|Independent Study|Internship|Research|Studio|Conference|Discussion"
HEAD = (
    rf"^([A-Z]{{2,5}}\s+\d{{3,4}}(?:-\d{{1,3}})?)\s+(.+?)\s+({KINDS})\s+(Fall|Spring|Summer|Winter)\s+\d{{4}}"
    rf"\s+([\d.]+(?:\s*-\s*[\d.]+)?|{KINDS})\s+(Open|Closed|Waitlist|Cancelled)"
)
WORDS = {"Description:": "description", "Public Notes:": "notes", "Restrictions:": "restrictions", "Instructors:": "instructor", "Offered:": "offered"}
DAYS = r"^([MTWRFS]+)\s+(\d{3,4}\s+[AP]M)\s+(\d{3,4}\s+[AP]M)"
LISTING_NOISE = ["https", "Course Course Title", "Schedule: Day Begin", "Books: Click", "Delivery", "Mode:", "Co-Located:", "Course Descriptions"]


def section_parse() -> str:
    """The listing's state machine, one line a step and file."""
    plain = lambda c: f"regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')"
    code = "regexp_replace(upper(code), '[^A-Z0-9]+', ' ', 'g')"
    head = f"concat_ws(' ', {code}, {plain('title')}, {plain('type')}, {plain('term')}, '2026', {plain('credits')}, {plain('status')})"
    head = f"regexp_replace({head}, '^ ?([A-Z]+) ?(\\d{{3,4}})[A-Z]? (\\d{{1,3}}) ', '\\1 \\2-\\3 ')"
    labelled = ", ".join(f"'{w} ' || {plain(c)}" for w, c in (("Instructors:", "instructor"), ("Description:", "description"), ("Public Notes:", "notes"), ("Restrictions:", "restrictions"), ("Offered:", "offered")))
    word = "CASE " + " ".join(f"WHEN starts_with(line, {quote(w)}) THEN {quote(f)}" for w, f in WORDS.items()) + " END"
    value = "CASE " + " ".join(f"WHEN starts_with(line, {quote(w)}) THEN {strip(f'substring(line, {len(w) + 1})')}" for w in WORDS) + " END"
    new = "l.kind = 'header'"
    number = lambda which, two: f"CASE WHEN {new} THEN NULL WHEN l.kind = 'two' AND s.due = 'two' AND s.had = 0 THEN {two} WHEN l.kind = 'one' AND s.due = 'one' AND s.had = {which} THEN l.line::INT ELSE s.{'enrolled' if which == 0 else 'capacity'} END"
    taken = "(l.kind = s.due AND s.had < CASE s.due WHEN 'two' THEN 1 ELSE 2 END)"
    loose = f"(l.kind = 'text' OR (l.kind IN ('one', 'two') AND NOT coalesce({taken}, false)))"
    text = lambda f: f"CASE WHEN {new} THEN NULL WHEN l.kind = 'keyword' AND l.word = '{f}' THEN l.value WHEN {loose} AND s.field = '{f}' THEN s.{f} || ' ' || l.line ELSE s.{f} END"
    texts = ("instructor", "description", "notes", "restrictions", "offered")
    names = ("code", "title", "type", "term", "credits", "status")
    return rf"""
WITH RECURSIVE raw AS (
  SELECT feed AS file, rec_id, [{head}] || list_transform(coalesce(schedule, []), lambda d: concat_ws(' ', d.days, d.start_time, d.end_time))
    || ['Enrollment: Enrolled Capacity', concat_ws(' ', enrolled, capacity)] || [{labelled}] AS ls FROM courses WHERE code IS NOT NULL),
cut AS (SELECT file, rec_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM raw),
bare AS (SELECT file, rec_id, i, {strip('line')} AS line FROM cut),
kept AS (
  SELECT file, line, row_number() OVER (PARTITION BY file ORDER BY rec_id, i) AS n FROM bare
  WHERE line <> '' AND NOT regexp_matches(line, '^\d{{1,2}}/\d{{1,2}}/\d{{2,4}},') AND {" AND ".join(f"NOT starts_with(line, {quote(p)})" for p in LISTING_NOISE)}),
l AS (
  SELECT *, {word} AS word, {value} AS value, CASE WHEN regexp_matches(line, {quote(HEAD)}) THEN 'header' WHEN regexp_matches(line, {quote(DAYS)}) THEN 'schedule'
    WHEN starts_with(line, 'Enrollment:') THEN 'enrolment' WHEN line = 'Capacity' THEN 'capacity' WHEN regexp_matches(line, '^\d+\s+\d+$') THEN 'two'
    WHEN regexp_matches(line, '^\d+$') THEN 'one' WHEN word IS NOT NULL THEN 'keyword' ELSE 'text' END AS kind,
    regexp_extract(line, {quote(HEAD)}, [{", ".join(quote(x) for x in names)}]) AS h, regexp_extract(line, {quote(DAYS)}, ['a', 'b', 'c']) AS d FROM kept),
s AS (
  SELECT DISTINCT file, 0::BIGINT AS n, 0 AS rec, {", ".join(f"''::VARCHAR AS {x}" for x in names)}, ''::VARCHAR AS schedule, NULL::INT AS enrolled, NULL::INT AS capacity,
    NULL::VARCHAR AS due, 0 AS had, NULL::VARCHAR AS field, {", ".join(f"NULL::VARCHAR AS {x}" for x in texts)} FROM l
  UNION ALL
  SELECT l.file, l.n, s.rec + CASE WHEN {new} THEN 1 ELSE 0 END, {", ".join(f"CASE WHEN {new} THEN l.h.{x} ELSE s.{x} END" for x in names)},
    CASE WHEN {new} THEN '' WHEN l.kind = 'schedule' THEN s.schedule || l.d.a || ' ' || l.d.b || ' ' || l.d.c || ';' ELSE s.schedule END,
    {number(0, "regexp_extract(l.line, '^([0-9]+)', 1)::INT")}, {number(1, "regexp_extract(l.line, '([0-9]+)$', 1)::INT")},
    CASE WHEN {new} THEN NULL WHEN l.kind = 'enrolment' THEN CASE WHEN contains(l.line, 'Capacity') THEN 'two' ELSE 'one' END ELSE s.due END,
    CASE WHEN l.kind IN ('header', 'enrolment') THEN 0 WHEN l.kind = s.due THEN s.had + 1 ELSE s.had END,
    CASE WHEN l.kind = 'keyword' THEN CASE WHEN l.word IN ('instructor', 'offered') THEN NULL ELSE l.word END WHEN l.kind IN ('header', 'schedule', 'enrolment') THEN NULL ELSE s.field END,
    {", ".join(text(f) for f in texts)}
  FROM s JOIN l ON l.file = s.file AND l.n = s.n + 1)
SELECT file, rec, {", ".join(names)}, schedule, enrolled, capacity, {", ".join(f"coalesce({f}, '') AS {f}" for f in texts)} FROM s WHERE rec > 0
QUALIFY row_number() OVER (PARTITION BY file, rec ORDER BY n DESC) = 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "knn_topk": f"WITH {KNN.format(where='')} SELECT query_id, id, round(d, 6) + 0.0 AS distance, rank FROM ranked",
        "knn_filtered": f"WITH {KNN.format(where='WHERE r.label % 3 <> 1')} SELECT query_id, id, round(d, 6) + 0.0 AS distance, rank FROM ranked",
        "dedup_candidates": f"WITH {CANDIDATES} SELECT question, id, query_ord, rank, pos FROM candidates",
        "rerank_topn": f"WITH {CANDIDATES} SELECT question, id, place FROM top",
        "context_build": f"WITH {CANDIDATES}, {CONTEXT} SELECT * FROM context",
        "chunk_id": f"SELECT _source, rec_id, {ID} AS id FROM ({SOURCES})",
        "dedup_last_wins": f"""WITH {KEYED} SELECT id, last(_source ORDER BY src_ord, rec_id) AS _source, last(rec_id ORDER BY src_ord, rec_id) AS rec_id,
            last(text ORDER BY src_ord, rec_id) AS text, first(src_ord ORDER BY src_ord, rec_id) AS first_src, first(rec_id ORDER BY src_ord, rec_id) AS first_rec FROM keyed GROUP BY id""",
        "duplicate_count": f"WITH {KEYED} SELECT count(*) AS total, count(DISTINCT id) AS distinct_ids, count(*) - count(DISTINCT id) AS duplicates FROM keyed",
        "multi_source_union": f"SELECT _source, src_ord, rec_id, url, content_type, chunk_index FROM ({SOURCES})",
        "index_rows": f"""SELECT {ID} AS id, text AS document, coalesce(url, '') AS url, coalesce(department, '') AS department, coalesce(content_type, '') AS content_type
            FROM ({SOURCES}) WHERE {strip("coalesce(text, '')")} <> ''""",
        "index_insert_new": f"WITH {STATES} SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)",
        "index_upsert": f"WITH {STATES} SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)",
        "batch_assign": f"""SELECT _source, ord // 100 AS batch, count(*) AS n_rows, count(*) FILTER (WHERE {strip("coalesce(text, '')")} = '') AS n_blank
            FROM (SELECT *, row_number() OVER (ORDER BY src_ord, rec_id) - 1 AS ord FROM ({SOURCES})) GROUP BY ALL""",
        "clean_text_basic": f"SELECT rec_id, {cleaned("coalesce(text, '')", X.BASIC)} AS text FROM academic_info",
        "clean_text_full": f"SELECT rec_id, {cleaned("coalesce(text, '')", X.FULL)} AS text FROM campus_life_data",
        "min_length_filter": "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 100",
        "truncate_text": "SELECT doc_id, length(substring(text, 1, 50000)) AS n, md5(substring(text, 1, 50000)) AS digest FROM documents",
        "chunk_split": f"WITH RECURSIVE src AS (SELECT doc_id AS k, text AS t FROM documents), {chunked('src')} SELECT k AS doc_id, i AS chunk_index, chunk FROM numbered",
        "chunk_stats": f"WITH RECURSIVE src AS (SELECT doc_id AS k, text AS t FROM documents), {chunked('src')} SELECT count(*) AS chunks, max(length(chunk)) AS longest, min(length(chunk)) AS shortest, sum(length(chunk))::BIGINT AS chars FROM numbered",
        "clean_chunk_documents": f"""WITH RECURSIVE clean AS (SELECT rec_id AS k, url, {cleaned("coalesce(text, '')", X.BASIC)} AS t FROM academic_info),
            long AS (SELECT k, t FROM clean WHERE length(t) >= 1500), {chunked('long')}
            SELECT k AS rec_id, url, NULL::BIGINT AS chunk_index, NULL::BIGINT AS chunk_total, t AS text FROM clean WHERE length(t) >= 100 AND length(t) < 1500
            UNION ALL SELECT k, url, i, n, chunk FROM numbered JOIN clean USING (k)""",
        "pipeline_counters": f"""SELECT count(*) AS loaded, count(*) FILTER (WHERE n < 100) AS skipped, count(*) FILTER (WHERE n >= 1500) AS chunked, count(*) FILTER (WHERE n >= 100 AND n < 1500) AS kept
            FROM (SELECT length(coalesce(text, '')) AS n FROM ({SOURCES}))""",
        "url_normalize": f"SELECT _source, rec_id, {normalized('url')} AS url FROM ({SOURCES})",
        "link_extract": f"WITH {LINKS} SELECT _source, rec_id, pos, link FROM links",
        "link_extract_filtered": f"""WITH {LINKS} SELECT _source, rec_id, link, min(pos) AS pos FROM links
            WHERE {" AND ".join(f"NOT starts_with(link, {quote(p)})" for p in SKIPPED)} GROUP BY ALL""",
        "url_resolve": rf"""WITH {LINKS},
            p AS (SELECT *, regexp_replace(link, '^https?://[^/]+', '') AS path, (rec_id + pos) % 7 AS form, regexp_extract(url, '^[^?#]*') AS bare FROM links),
            f AS (SELECT *, CASE form WHEN 0 THEN link WHEN 1 THEN path WHEN 2 THEN regexp_replace(path, '^/', '') WHEN 3 THEN '..' || path
                WHEN 4 THEN '//' || regexp_replace(link, '^https?://', '') WHEN 5 THEN 'https://other.example/' ELSE '?p=' || pos END AS shown,
                regexp_extract(url, '^[^:]+://[^/?#]*') AS root, regexp_extract(url, '^[^:]+') AS scheme FROM p)
            SELECT _source, rec_id, pos, link, CASE WHEN contains({authority('target')}, {quote(DOMAIN)}) THEN target END AS target FROM (
            SELECT _source, rec_id, pos, shown AS link, CASE form WHEN 0 THEN link WHEN 1 THEN root || path
                WHEN 2 THEN regexp_extract(bare, '^(.*/)', 1) || shown
                WHEN 3 THEN root || coalesce(nullif(regexp_extract(substring(bare, length(root) + 1), '^(.*)/[^/]*/[^/]*$', 1), ''), '') || path
                WHEN 4 THEN scheme || ':' || shown WHEN 5 THEN NULL ELSE bare || shown END AS target FROM f)""",
        "url_blocked": f"WITH {LINKS} SELECT _source, rec_id, pos, {blocked('link', BY_CATALOG)} AS by_catalog, {blocked('link', BY_SEEDS)} AS by_seeds FROM links",
        "html_to_text": f"SELECT rec_id, {html_text('h')} AS text FROM (SELECT rec_id, {html_of('text')} AS h FROM gap_fill_data)",
        "html_links": f"SELECT rec_id, array_to_string(regexp_extract_all(h, {quote(ANCHOR)}, 1), ' ') AS links FROM (SELECT rec_id, {html_of('text')} AS h FROM gap_fill_data)",
        "audience_tag": f"SELECT _source, rec_id, {audience('url')} AS audience FROM ({SOURCES})",
        "audience_tally": f"""SELECT l.audience, count(s.a) AS n FROM (VALUES ('undergrad'), ('grad'), ('both')) l(audience)
            LEFT JOIN (SELECT {audience('url')} AS a FROM ({SOURCES})) s ON s.a = l.audience GROUP BY ALL""",
        "audience_clamp": f"SELECT CASE rec_id % 7 WHEN 0 THEN 'undergrad' WHEN 1 THEN 'grad' ELSE 'both' END AS audience, count(*) AS n FROM ({SOURCES}) GROUP BY ALL",
        "fetch_lookup": f"WITH {PAGES}, {LINKS}, l AS (SELECT DISTINCT {normalized('link')} AS url FROM links) SELECT l.url, pages.text IS NOT NULL AS found FROM l LEFT JOIN pages USING (url)",
        "crawl_expand": f"WITH {WALK} SELECT url, depth FROM walk",
        "crawl_depth_stats": f"WITH {WALK} SELECT depth, count(*) AS n FROM walk GROUP BY ALL",
        "crawl_documents": f"""WITH {WALK} SELECT url, depth, CASE WHEN depth = 1 THEN 'program_overview' ELSE 'program_requirements' END AS content_type,
            coalesce(length(text), 0) AS n FROM walk JOIN pages USING (url)""",
        "resume_known_urls": f"SELECT DISTINCT {normalized('url')} AS url FROM ({SOURCES}) WHERE url IS NOT NULL",
        "seed_plan": f"""WITH done AS (SELECT DISTINCT {normalized('url')} AS url FROM (SELECT url FROM campus_life_data UNION ALL SELECT url FROM academic_info) WHERE url IS NOT NULL),
            s AS (SELECT rec_id AS ord, {normalized('url')} AS url FROM gap_fill_data)
            SELECT ord, url, url IN (SELECT url FROM done) AS links_only FROM s
            QUALIFY links_only OR row_number() OVER (PARTITION BY url ORDER BY ord) = 1""",
        "seed_expand": f"""WITH {PAGES}, s AS (SELECT DISTINCT {normalized('url')} AS url FROM gap_fill_data),
            l AS (SELECT unnest(links) AS link FROM pages JOIN s USING (url))
            SELECT DISTINCT {normalized('link')} AS url, 1 AS depth FROM l WHERE contains({authority('link')}, {quote(DOMAIN)})
            AND NOT {blocked(normalized('link'), BY_SEEDS)} AND {normalized('link')} NOT IN (SELECT url FROM s)""",
        "has_content_filter": "SELECT event_id FROM events WHERE event_id % 7 NOT IN (2, 3, 4)",
        "page_concat": f"""SELECT _source, u AS url, alone, string_agg(t || chr(10), '' ORDER BY place, rec_id) AS text
            FROM (SELECT _source, {normalized('url')} AS u, CASE WHEN coalesce(chunk_total, 1) <= 1 THEN rec_id END AS alone, coalesce(chunk_index, 0) AS place, rec_id, coalesce(text, '') AS t
                FROM ({SOURCES}) WHERE url IS NOT NULL) GROUP BY _source, u, alone""",
        "line_noise_filter": f"""WITH l AS (SELECT rec_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM campus_life_data),
            s AS (SELECT rec_id, ord, {STRIPPED_LINE} AS line FROM l)
            SELECT * FROM s WHERE line <> '' AND NOT regexp_matches(line, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}},') AND {" AND ".join(f"NOT starts_with(line, {quote(p)})" for p in NOISE)}""",
        "fix_leading_punct": f"SELECT rec_id, {FIX} AS instructor FROM courses",
        "base_code": f"SELECT rec_id, {BASE} AS code FROM courses",
        "best_field": f"WITH {SECTIONS}, {BEST} SELECT s.base AS code, {BESTS} FROM (SELECT DISTINCT base FROM sections) s LEFT JOIN best USING (base) GROUP BY s.base",
        "section_counts": f"""WITH {SECTIONS}, n AS (SELECT base, coalesce(type, '') AS t, count(*) AS c FROM sections GROUP BY ALL)
            SELECT base AS code, string_agg(t || '=' || c, ',' ORDER BY t) AS counts FROM n GROUP BY base""",
        "course_merge": MERGED,
        "course_chunks": f"SELECT 'https://catalog.quillhaven.example/' AS url, 'course_description' AS content_type, {strip('(' + RENDERED + ')')} AS text FROM ({MERGED})",
        "render_text": f"SELECT rec_id, {strip('(' + RENDERED + ')')} AS text FROM courses",
        "history_project": f"WITH {TURNS}, {HISTORY} SELECT session_id, messages FROM history",
        "session_upsert": "SELECT user_id::VARCHAR AS session_id, epoch_us(first(ts ORDER BY event_id)) AS started_us, CASE WHEN count(*) = 1 THEN epoch_us(first(ts ORDER BY event_id)) ELSE epoch_us(max(ts) FILTER (WHERE n > 1)) END AS active_us FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) GROUP BY user_id",
        "subquery_list": f"""SELECT doc_id, coalesce(site, '') || CASE doc_id % 6
            WHEN 0 THEN CASE WHEN {strip("coalesce(source, '')")} <> '' THEN '|' || source ELSE '' END || CASE WHEN {strip("coalesce(lang, '')")} <> '' THEN '|' || lang ELSE '' END
            WHEN 1 THEN '|a|b' ELSE '' END AS queries FROM documents""",
        "prompt_build": f"""WITH {CANDIDATES}, {CONTEXT}, {TURNS}, {HISTORY}
            SELECT question, 'system:Answer from the context and cite the source URL.,' || coalesce(messages || ',', '') || 'user:Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: What about ' || question || '?' AS prompt
            FROM context LEFT JOIN history ON session_id = question::VARCHAR""",
        "rate_limit_window": """SELECT event_id, n, n <= 1 AS admitted, epoch_us(w) AS window_us
            FROM (SELECT event_id, date_trunc('hour', ts) AS w, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events)""",
        "json_scan": "SELECT event_id, len(json_keys(props)) AS n_keys FROM events",
        "seed_crawl": f"""WITH {PAGES}, known AS (SELECT DISTINCT {normalized('url')} AS url FROM campus_life_data WHERE url IS NOT NULL),
            s AS (SELECT min(url) AS url FROM pages GROUP BY {host('url')}),
            l AS (SELECT unnest(list_slice(links, 1, 2)) AS link FROM pages JOIN s USING (url))
            SELECT url, 0 AS depth FROM s UNION ALL SELECT DISTINCT {normalized('link')}, 1 FROM l WHERE contains({authority('link')}, {quote(DOMAIN)})
            AND NOT {blocked(normalized('link'), BY_SEEDS)} AND {normalized('link')} NOT IN (SELECT url FROM s) AND {normalized('link')} NOT IN (SELECT url FROM known)""",
        "history_append": f"""WITH {TURNS} SELECT session_id, string_agg(role || ':' || text, ',' ORDER BY turn) || ',user:again ' || session_id || ',assistant:' || count(*) AS messages
            FROM turns GROUP BY session_id""",
        "question_audience": r"""SELECT doc_id, CASE WHEN g AND NOT u THEN 'grad' WHEN u AND NOT g THEN 'undergrad' ELSE 'both' END AS audience FROM (SELECT doc_id,
            regexp_matches(lower(coalesce(text, '')), '\b(graduate school|phd|doctoral|master|masters|mba|postdoc)\b') AS g,
            regexp_matches(lower(coalesce(text, '')), '\b(undergrad[a-z0-9_]*|freshman|freshmen|sophomore|first-year|transfer)\b') AS u FROM documents)""",
        "query_expand": "SELECT doc_id, coalesce(source, '') || CASE WHEN lang IS NULL THEN '' ELSE '|' || lang || '|' || coalesce(site, '') END AS queries FROM documents",
        "lexical_rerank": rf"""WITH {CANDIDATES}, w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS words FROM documents),
            s AS (SELECT question, c.id, pos, round(CASE WHEN len(q.words) > 0 THEN len(list_intersect(q.words, d.words)) / len(q.words) ELSE 0 END, 9) AS score
                FROM candidates c JOIN w d ON d.doc_id = c.id JOIN w q ON q.doc_id = question * 200)
            SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY score DESC, pos) AS place, score FROM s QUALIFY place <= 5""",
        "page_analysis": f"""WITH h AS (SELECT rec_id, {html_of('text')} AS h FROM gap_fill_data), t AS (SELECT rec_id, {html_text('h')} AS t, regexp_extract_all(h, {quote(ANCHOR)}, 1) AS l FROM h)
            SELECT rec_id, t <> '' AS has_content, md5(substring(t, 1, 50000)) AS digest, array_to_string(l[1:5], ' ') AS links, array_to_string(l[1:2], ' ') AS few,
            CASE {" ".join(f"WHEN contains(lower(t), {quote(c)}) THEN {quote(n)}" for c, n in CATEGORIES.items())} ELSE 'Campus Life' END AS category FROM t""",
        "json_records": "SELECT rec_id, code, title, enrolled, description, coalesce(array_to_string(list_transform(schedule, lambda x: coalesce(x.days, '')), ','), '') AS days FROM courses",
        "text_lines": "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(replace(text, chr(13), ' '), chr(10))) AS line FROM gap_fill_data) WHERE line <> '' GROUP BY line",
        "metadata_update": f"""WITH k AS (SELECT {ID} AS id, src_ord, rec_id, url FROM ({SOURCES}))
            SELECT id, rec_id, {audience('url')} AS audience FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY src_ord DESC, rec_id DESC) = 1""",
        "course_order": f"SELECT row_number() OVER (ORDER BY code) - 1 AS ord, code, title FROM ({MERGED})",
        "section_parse": section_parse(),
        "collection_scan": f"SELECT _source, rec_id, department, content_type FROM ({SOURCES})",
        "collection_count": f"SELECT _source, count(*) AS n FROM ({SOURCES}) GROUP BY ALL",
    }
