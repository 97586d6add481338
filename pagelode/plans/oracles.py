"""DuckDB SQL for the named queries, written from their definitions."""

from __future__ import annotations

from pagelode.functions.html import DROPPED, ENTITIES
from pagelode.functions.query import NAVIGATIONAL, TRANSACTIONAL
from pagelode.functions.text import KEYWORD_STOP_WORDS, STEM_RULES, STOP_WORDS

ORACLES: dict[str, str] = {}

PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def part(x: str, n: int) -> str:
    return f"regexp_extract({x}, {lit(PARTS)}, {n})"


def norm(x: str) -> str:
    u = f"regexp_replace({x}, '(?s)#.*$', '')"
    scheme, host = f"lower({part(u, 1)})", f"lower({part(u, 2)})"
    port = f"CASE WHEN {scheme} = 'http' THEN regexp_replace({host}, ':80$', '') WHEN {scheme} = 'https' THEN regexp_replace({host}, ':443$', '') ELSE {host} END"
    query = rf"regexp_replace({part(u, 4)}, '^\?$', '')"
    return f"({scheme} || '://' || {port} || regexp_replace({part(u, 3)}, '/+', '/', 'g') || {query})"


def domain(x: str) -> str:
    return f"lower(split_part({part(x, 2)}, ':', 1))"


def docid(x: str) -> str:
    return f"substr(sha256({norm(x)}), 1, 32)"


def unescape(x: str) -> str:
    for name, char in ENTITIES.items():
        x = f"replace({x}, {lit(f'&{name};')}, {lit(char)})"
    return x


def squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def title(x: str) -> str:
    return f"trim({unescape(f"regexp_extract({x}, '(?is)<title[^>]*>(.*?)</title>', 1)")})"


def visible(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    x = f"regexp_replace({x}, '(?is)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in DROPPED) + "', '', 'g')"
    x = f"regexp_replace({x}, '(?is)<(?:" + "|".join(DROPPED) + r")\b[^>]*>.*$', '')"
    return squeezed(unescape(f"regexp_replace({x}, '(?s)<[^>]*>', chr(10), 'g')"))


def stem(x: str) -> str:
    rules = " ".join(f"WHEN ends_with({x}, '{s}') AND length({x}) > {n} THEN substr({x}, 1, length({x}) - {len(s)}) || '{r}'" for s, r, n in STEM_RULES)
    return f"CASE WHEN length({x}) <= 3 OR NOT regexp_matches({x}, '^[a-z]+$') THEN {x} {rules} ELSE {x} END"


STOPS = ", ".join(map(lit, STOP_WORDS))
words = lambda x: f"list_filter(regexp_extract_all(lower({x}), '[a-z][a-z0-9]*'), lambda w: length(w) >= 2 AND w NOT IN ({STOPS}))"
terms = lambda x: f"list_sort(list_distinct(list_transform({words(x)}, lambda w: {stem('w')})))"

PAGES = f"""raw AS MATERIALIZED (SELECT page_id, {norm('url')} AS url, html, {docid('url')} AS doc_id FROM pages),
u AS MATERIALIZED (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_id DESC) = 1),
p AS MATERIALIZED (SELECT doc_id, url, {title('html')} AS title, {visible('html')} AS text FROM u)"""
FIELDS = f"""{PAGES},
f AS MATERIALIZED (SELECT doc_id, 'url' AS field, 0 AS ord, 3.0::DOUBLE AS w, {words('url')} AS ws FROM p
  UNION ALL SELECT doc_id, 'title', 1, 5.0, {words('title')} FROM p
  UNION ALL SELECT doc_id, 'body', 2, 1.0, {words('text')} FROM p
  UNION ALL SELECT doc_id, 'headings', 3, 2.0, {words('title')} FROM p)"""
TOKENS = f"""{FIELDS},
t0 AS MATERIALIZED (SELECT doc_id, field, ord, w, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM f),
t AS MATERIALIZED (SELECT doc_id, field, ord, w, pos, {stem('word')} AS term FROM t0)"""
INDEX = f"""{TOKENS},
post AS MATERIALIZED (SELECT term, doc_id, sum(w) AS freq FROM t GROUP BY ALL),
len AS MATERIALIZED (SELECT doc_id, CAST(sum(len(ws)) AS BIGINT) AS length FROM f GROUP BY doc_id),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term),
corpus AS MATERIALIZED (SELECT count(*) AS n, avg(length) AS avgdl FROM len)"""
IDF = "greatest(0, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1))"
SCORES = f"""{INDEX},
parts AS MATERIALIZED (SELECT doc_id, term, freq, df, {IDF} AS idf, length, avgdl,
  {IDF} * freq * 2.5::DOUBLE / (freq + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl)) AS part
  FROM post JOIN df USING (term) JOIN len USING (doc_id), corpus WHERE term IN ('thre', 'thth')),
bm AS MATERIALIZED (SELECT doc_id, sum(part) AS bm25 FROM parts GROUP BY doc_id)"""
RAW_ANCHORS = r"regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a\s*>')"
HREF = unescape(r"""trim(regexp_extract(regexp_extract(a, '(?is)^<a\s([^>]*)>', 1), '(?is)\bhref\s*=\s*["'']([^"'']*)["'']', 1))""")
ANCHOR_TITLE = unescape(r"""regexp_extract(regexp_extract(a, '(?is)^<a\s([^>]*)>', 1), '(?is)\btitle\s*=\s*["'']([^"'']*)["'']', 1)""")
ANCHOR = f"substr(CASE WHEN {squeezed(unescape("regexp_replace(a, '(?s)<[^>]*>', ' ', 'g')"))} <> '' THEN {squeezed(unescape("regexp_replace(a, '(?s)<[^>]*>', ' ', 'g')"))} ELSE {ANCHOR_TITLE} END, 1, 200)"
ROOT = f"{part('url', 1)} || '://' || {part('url', 2)}"


def dotless(path: str) -> str:
    """A path that begins with a slash without its dot segments, by RFC 3986 5.2.4 over its segments; empty ones are dropped."""
    segments = f"list_filter(string_split({path}, '/'), lambda s: s <> '')"
    folded = f"list_reduce(list_prepend('', {segments}), lambda kept, s: CASE s WHEN '.' THEN kept WHEN '..' THEN regexp_replace(kept, '/[^/]*$', '') ELSE kept || '/' || s END)"
    return rf"(CASE WHEN {folded} = '' THEN '/' ELSE {folded} || CASE WHEN regexp_matches({path}, '(^|/)\.{{0,2}}$') THEN '/' ELSE '' END END)"


FOLDER = f"(CASE WHEN {part('url', 3)} = '' THEN '/' ELSE regexp_extract({part('url', 3)}, '(?s)^(.*/)', 1) END)"


def joined(href: str) -> str:
    """A relative href with dot segments against url."""
    own = f"regexp_extract({href}, '(?s)^[^?#]*', 0)"
    return f"({ROOT} || {dotless(f"(CASE WHEN starts_with({own}, '/') THEN {own} ELSE {FOLDER} || {own} END)")} || regexp_extract({href}, '(?s)[?#].*$', 0))"


LINKS = rf"""{PAGES},
a0 AS (SELECT doc_id, url, unnest({RAW_ANCHORS}) AS a, unnest(range(len({RAW_ANCHORS}))) AS pos FROM u),
a1 AS (SELECT doc_id, url, pos, {HREF} AS href, {ANCHOR} AS anchor FROM a0),
a2 AS (SELECT doc_id, pos, anchor, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN href
    WHEN starts_with(href, '//') THEN {part('url', 1)} || ':' || href
    WHEN regexp_matches(href, '(^|/)\.\.?(/|$|\?|#)') THEN {joined('href')} WHEN starts_with(href, '/') THEN {ROOT} || href
    WHEN starts_with(href, '?') THEN {ROOT} || {part('url', 3)} || href
    ELSE {ROOT} || {FOLDER} || href END AS target
  FROM a1 WHERE href <> '' AND NOT regexp_matches(href, '^(#|javascript:|mailto:|tel:|ftp:|data:)')),
a3 AS (SELECT doc_id AS from_doc_id, {norm('target')} AS to_url, anchor, pos FROM a2 WHERE target IS NOT NULL),
links AS MATERIALIZED (SELECT from_doc_id, to_url, {docid('to_url')} AS to_doc_id, anchor AS anchor_text FROM a3
  WHERE regexp_matches(to_url, '(?i)^https?://[^/?#]+') QUALIFY row_number() OVER (PARTITION BY from_doc_id, to_url ORDER BY pos) = 1)"""


def ranks(edges: str, nodes: str, steps: int) -> str:
    """CTEs rk0 .. rk<steps> and rank over e (src, dst) and v (id)."""
    out = f"""e AS MATERIALIZED ({edges}), v AS MATERIALIZED ({nodes}),
o AS MATERIALIZED (SELECT src, count(*) AS deg FROM e GROUP BY src), nn AS (SELECT count(*) AS n FROM v),
rk0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS r FROM v, nn)"""
    for k in range(steps):
        out += f""",
rk{k + 1} AS MATERIALIZED (WITH i AS (SELECT dst AS id, sum(r / deg) AS s FROM e JOIN o USING (src) JOIN rk{k} ON rk{k}.id = e.src GROUP BY dst),
  d AS (SELECT coalesce(sum(r), 0) AS lost FROM rk{k} WHERE id NOT IN (SELECT src FROM o))
  SELECT v.id, 0.15::DOUBLE / n + 0.85::DOUBLE * lost / n + 0.85::DOUBLE * coalesce(s, 0) AS r FROM v LEFT JOIN i USING (id), nn, d)"""
    return out + f",\nrank AS MATERIALIZED (SELECT id AS doc_id, r / sum(r) OVER () AS rank FROM rk{steps})"


def page_ranks(steps: int) -> str:
    return ranks("SELECT from_doc_id AS src, to_doc_id AS dst FROM links", "SELECT doc_id AS id FROM p UNION SELECT from_doc_id FROM links UNION SELECT to_doc_id FROM links", steps)


def anchors_after(cte: str) -> str:
    """The CTEs of links without those of pages, to follow others that have them."""
    return cte.removeprefix(PAGES + ",\n")


FUSED = f"""{SCORES}, {anchors_after(LINKS)}, {page_ranks(20)},
m AS MATERIALIZED (SELECT doc_id, bm25, coalesce(rank, 0) AS pagerank FROM bm LEFT JOIN rank USING (doc_id)),
x AS (SELECT CASE WHEN max(bm25) > 0 THEN max(bm25) ELSE 1 END AS tb, CASE WHEN max(pagerank) > 0 THEN max(pagerank) ELSE 1 END AS tp FROM m)"""
SHOWN = "doc_id, round(bm25, 6) AS bm25, round(pagerank, 8) AS pagerank"
CORPUS_TERMS = f"""t0 AS (SELECT doc_id, unnest({words('text')}) AS word FROM documents), t AS MATERIALIZED (SELECT doc_id, {stem('word')} AS term FROM t0)"""


def add(name: str, sql: str) -> None:
    ORACLES[name] = sql


# URLs and HTML
add("url_normalize", f"SELECT page_id, {norm('url')} AS url FROM pages")
add("url_docid", f"SELECT page_id, {docid('url')} AS doc_id FROM pages")
add("url_domain", f"SELECT page_id, {domain('url')} AS domain, lower({part('url', 2)}) AS host, regexp_matches(url, '(?i)^https?://[^/?#]+') AS valid FROM pages")
_PATH = f"regexp_replace({part('url', 3)}, '/+$', '')"
add("url_depth", f"SELECT page_id, CAST(length({_PATH}) - length(replace({_PATH}, '/', '')) AS INTEGER) AS depth, CAST(CASE WHEN {part('url', 2)} <> 'nowhere.example.com' THEN -1 ELSE length({_PATH}) - length(replace({_PATH}, '/', '')) END AS INTEGER) AS other FROM pages")
add("url_scope", f"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN page_id % 300 <= 255 ELSE ends_with({domain('url')}, '.example.org') OR ends_with({domain('url')}, '.example.net') OR {domain('url')} IN ('example.org', 'example.net') END AS in_scope FROM pages")
_META = r"""coalesce(nullif(regexp_extract(html, '(?is)<meta\s[^>]*name\s*=\s*["'']description["''][^>]*content\s*=\s*["'']([^"'']*)["'']', 1), ''), regexp_extract(html, '(?is)<meta\s[^>]*content\s*=\s*["'']([^"'']*)["''][^>]*name\s*=\s*["'']description["'']', 1))"""
add("html_title", f"SELECT page_id, {title('html')} AS title, {unescape(_META)} AS description FROM pages")
add("html_text", f"SELECT page_id, {visible('html')} AS text FROM pages")
_HEADING = lambda tag: rf"""list_transform(regexp_extract_all(html, '(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>', 1), lambda x: {{'tag': '{tag}', 'text': {unescape(r"regexp_replace(trim(regexp_replace(x, '(?s)\s*<[^>]*>\s*', '', 'g')), '\s+', ' ', 'g')")}}})"""
add("html_headings", f"WITH h AS (SELECT page_id, list_filter({_HEADING('h1')} || {_HEADING('h2')} || {_HEADING('h3')}, lambda x: x.text <> '') AS l FROM pages), e AS (SELECT page_id, unnest(l) AS x, unnest(range(len(l))) AS pos FROM h) SELECT page_id, CAST(pos AS INTEGER) AS pos, x.tag AS tag, x.text AS text FROM e")
add("html_links", f"WITH {LINKS} SELECT from_doc_id, to_url, to_doc_id, anchor_text FROM links")
add("content_hash", f"SELECT page_id, sha256({visible('html')}) AS content_hash, CAST(length({visible('html')}) AS BIGINT) AS text_length, CAST(strlen(html) AS BIGINT) AS content_length FROM pages")
add("page_filters", "SELECT page_id FROM pages WHERE page_id % 7 <> 0 AND page_id % 3 <> 0 AND strlen(html) <= 10485760")

# Tokens
add("tokenize_terms", f"WITH {CORPUS_TERMS} SELECT term, count(*) AS n FROM t GROUP BY term")
add("stem_vocab", f"WITH t0 AS (SELECT DISTINCT unnest({words('text')}) AS word FROM documents) SELECT word, {stem('word')} AS stem FROM t0")
_PLAIN = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
add("doc_keywords", f"WITH w AS (SELECT doc_id, unnest({_PLAIN}) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS freq FROM w WHERE regexp_matches(word, '^[a-z]{{3,}}$') AND word NOT IN ({', '.join(map(lit, KEYWORD_STOP_WORDS))}) GROUP BY ALL) SELECT doc_id, word, freq, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, word) AS rank FROM c QUALIFY rank <= 5")
add("term_positions", f"WITH w AS (SELECT doc_id, unnest({_PLAIN}) AS term, unnest(range(len({_PLAIN}))) AS pos FROM documents) SELECT doc_id, term, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM w GROUP BY ALL")
add("term_counts", f"WITH {TOKENS} SELECT doc_id, term, count(*) * 5.0::DOUBLE AS weighted FROM t GROUP BY ALL")

# Index
add("postings_weighted", f"WITH {TOKENS} SELECT term, doc_id, sum(w) AS freq, array_to_string(list_transform(list(pos ORDER BY ord, pos)[1:100], lambda x: CAST(x AS VARCHAR)), ',') AS positions, array_to_string(list_sort(list(DISTINCT field)), ',') AS fields FROM t GROUP BY term, doc_id")
add("doc_lengths", f"WITH {INDEX} SELECT doc_id, length FROM len")
add("doc_frequency", f"WITH {INDEX} SELECT term, df FROM df")
_STATS = "SELECT (SELECT count(*) FROM len) AS total_docs, (SELECT count(*) FROM df) AS vocabulary_size, (SELECT count(*) FROM post) AS total_postings"
add("index_stats", f"WITH {INDEX} {_STATS}, (SELECT round(avg(length), 6) FROM len) AS avg_doc_length, round((SELECT count(*) FROM post) / (SELECT count(*) FROM len)::DOUBLE, 6) AS avg_terms_per_doc")
add("corpus_stats", f"WITH {CORPUS_TERMS}, post AS MATERIALIZED (SELECT DISTINCT term, doc_id FROM t), len AS (SELECT doc_id, len({words('text')}) AS length FROM documents) SELECT (SELECT count(*) FROM len) AS total_docs, (SELECT count(DISTINCT term) FROM post) AS vocabulary_size, (SELECT count(*) FROM post) AS total_postings, (SELECT round(avg(length), 6) FROM len) AS avg_doc_length, round((SELECT count(*) FROM post) / (SELECT count(*) FROM len)::DOUBLE, 6) AS avg_terms_per_doc")
add("idf", f"WITH {INDEX} SELECT term, df, round({IDF}, 6) AS idf FROM df, corpus")
add("bm25_scores", f"WITH {SCORES} SELECT doc_id, round(bm25, 6) AS bm25 FROM bm")
add("bm25_subset", f"WITH {SCORES} SELECT doc_id, round(coalesce(bm25, 0), 6) AS bm25 FROM len LEFT JOIN bm USING (doc_id)")

# Links
add("out_degree", f"WITH {LINKS} SELECT from_doc_id, count(*) AS out_degree FROM links GROUP BY 1")
add("in_links", f"WITH {LINKS} SELECT to_doc_id, count(*) AS in_degree FROM links GROUP BY 1")
add("link_stats", f"WITH {LINKS} SELECT count(*) AS total_links, count(DISTINCT from_doc_id) AS linking_pages, count(DISTINCT to_doc_id) AS linked_documents FROM links")
add("dangling_nodes", f"WITH {LINKS} SELECT DISTINCT to_doc_id AS doc_id FROM links WHERE to_doc_id NOT IN (SELECT from_doc_id FROM links)")
add("pagerank_20it", f"WITH {LINKS}, {page_ranks(20)} SELECT doc_id, round(rank, 10) AS rank FROM rank")
_LINES = "SELECT 's' || l_suppkey AS s, 'p' || l_partkey AS p, l_linenumber FROM lineitem"
add("pagerank_graph", f"WITH ln AS MATERIALIZED ({_LINES}), {ranks('SELECT s AS src, p AS dst FROM ln UNION ALL SELECT p, s FROM ln WHERE l_linenumber = 1', 'SELECT s AS id FROM ln UNION SELECT p FROM ln', 10)} SELECT doc_id, round(rank, 10) AS rank FROM rank")
add("pagerank_top", f"WITH {LINKS}, {page_ranks(20)}, r AS (SELECT doc_id, round(rank, 10) AS rank FROM rank ORDER BY 2 DESC, 1 LIMIT 10) SELECT doc_id, rank, coalesce(title, doc_id) AS title, coalesce(url, '') AS url FROM r LEFT JOIN p USING (doc_id)")
add("pagerank_summary", f"WITH {LINKS}, {page_ranks(20)} SELECT count(*) AS nodes, round(max(rank), 10) AS max_rank, round(min(rank), 10) AS min_rank, round(avg(rank), 10) AS mean_rank FROM rank")

# Ranking
add("rank_relevance", f"WITH {FUSED} SELECT {SHOWN}, round(bm25 / tb, 6) AS final FROM m, x")
add("rank_authority", f"WITH {FUSED} SELECT {SHOWN}, round(pagerank / tp, 6) AS final FROM m, x")
add("rank_hybrid", f"WITH {FUSED} SELECT {SHOWN}, round(0.7::DOUBLE * (bm25 / tb) + 0.3::DOUBLE * (pagerank / tp), 6) AS final FROM m, x")
add("rank_page2", f"WITH {FUSED}, y AS (SELECT *, bm25 / tb AS f FROM m, x ORDER BY f DESC, bm25 DESC, doc_id LIMIT 5 OFFSET 5) SELECT {SHOWN}, round(f, 6) AS final FROM y")
add("and_match_count", f"WITH {SCORES}, c AS (SELECT doc_id FROM parts GROUP BY doc_id HAVING count(*) = 2) SELECT count(*) AS total FROM c")
add("explain_terms", f"WITH {SCORES} SELECT doc_id, term, freq, df, round(idf, 4) AS idf, length, round(avgdl, 1) AS avgdl, round(part, 4) AS part FROM parts")


def snippet(x: str, asked: tuple[str, ...] = ("thre", "thth")) -> str:
    pos = "coalesce(" + ", ".join(f"nullif(strpos(lower({x}), '{t}'), 0) - 1" for t in asked) + ", 0)"
    start = f"greatest(0, {pos} - 50)"
    cut = f"(CASE WHEN {start} > 0 THEN '...' ELSE '' END || substr({x}, {start} + 1, 200) || CASE WHEN {start} + 200 < length({x}) THEN '...' ELSE '' END)"
    out = f"CASE WHEN length({x}) > 200 THEN {cut} ELSE {x} END"
    for t in asked:
        out = f"regexp_replace({out}, '(?i){t}', '<em>{t}</em>', 'g')"
    return out


add("snippets", f"WITH {PAGES}, s AS (SELECT doc_id, title || ' ' || text || ' ' || url AS s FROM p) SELECT doc_id, {snippet('s')} AS snippet FROM s")
add("search", f"WITH {SCORES}, x AS (SELECT max(bm25) AS tb FROM bm), y AS (SELECT *, bm25 / tb AS f FROM bm, x ORDER BY f DESC, bm25 DESC, doc_id LIMIT 20), s AS (SELECT *, title || ' ' || url AS s FROM y JOIN p USING (doc_id)) SELECT doc_id, url, title, {snippet('s')} AS snippet, round(f, 6) AS final, round(bm25, 4) AS bm25, 0.0::DOUBLE AS pagerank FROM s")
add("search_many", f"""WITH {INDEX}, qt AS (SELECT item_id AS query_id, unnest({terms('text')}) AS term FROM benchmark),
s AS (SELECT query_id, doc_id, sum({IDF} * freq * 2.5::DOUBLE / (freq + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl))) AS bm25 FROM qt JOIN df USING (term) JOIN post USING (term) JOIN len USING (doc_id), corpus GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(bm25, 6) AS bm25, rank FROM r WHERE rank <= 3""")

# Queries
_ASKED = """asked AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'site:a.example.org "exact words" ' || text WHEN 1 THEN 'download filetype:pdf ' || text ELSE text END AS q FROM conversations)"""
_TERMS_Q = terms("""regexp_replace(q, '"[^"]+"', ' ', 'g')""")
add("query_parse", rf"""WITH {_ASKED} SELECT conv_id, turn, array_to_string({_TERMS_Q}, ' ') AS terms, array_to_string(regexp_extract_all(q, '"([^"]+)"', 1), '|') AS phrases, nullif(regexp_extract(q, 'site:(\S+)', 1), '') AS site, nullif(regexp_extract(q, 'filetype:(\S+)', 1), '') AS filetype, len({_TERMS_Q}) > 0 AS is_valid FROM asked""")
_SHORTER = "CASE WHEN length(t) <= 4 THEN []::VARCHAR[] " + " ".join(f"WHEN ends_with(t, '{s}') THEN [substr(t, 1, length(t) - {len(s)})]" for s in ("ing", "ed", "s", "tion")) + " ELSE []::VARCHAR[] END"
add("query_expand", f"WITH b AS (SELECT item_id, {terms('text')} AS l FROM benchmark) SELECT item_id, array_to_string(list_sort(list_distinct(l || flatten(list_transform(l, lambda t: {_SHORTER})))), ' ') AS terms FROM b")
_HAS = lambda ws: " OR ".join(f"contains(lower(q), {lit(w)})" for w in ws)
add("query_intent", f"WITH {_ASKED} SELECT conv_id, turn, CASE WHEN {_HAS(NAVIGATIONAL)} THEN 'navigational' WHEN {_HAS(TRANSACTIONAL)} THEN 'transactional' ELSE 'informational' END AS intent FROM asked")
_SPELL = f"""{CORPUS_TERMS}, dict AS MATERIALIZED (SELECT term, count(DISTINCT doc_id) AS freq FROM t GROUP BY term),
w AS (SELECT unnest(['thxt', 'retoin', 'thth', 'zzzzqq', 'onre', 'ersz']) AS word),
d AS MATERIALIZED (SELECT word, term, freq, damerau_levenshtein(word, term) AS edits FROM w, dict WHERE abs(length(term) - length(word)) <= 2 AND (term = word OR regexp_matches(term, '^[a-z]+$'))),
c AS MATERIALIZED (SELECT * FROM d WHERE edits <= 2 QUALIFY edits = min(edits) OVER (PARTITION BY word))"""
add("spell_candidates", f"WITH {_SPELL} SELECT word, term, freq, CAST(edits AS BIGINT) AS edits FROM c")
add("spell_correct", f"WITH {_SPELL}, b AS (SELECT word, term FROM c QUALIFY row_number() OVER (PARTITION BY word ORDER BY freq DESC, term) = 1) SELECT word, coalesce(term, word) AS corrected FROM w LEFT JOIN b USING (word)")
add("spell_suggest", f"WITH {_SPELL} SELECT word, term, round(freq / (SELECT sum(freq) FROM dict)::DOUBLE, 9) AS p, row_number() OVER (PARTITION BY word ORDER BY freq DESC, term) AS rank FROM c QUALIFY rank <= 5")

# Frontier
_EPOCH, _NOW = 1704067200, 1704067500
QUEUE = f"""{LINKS}, qq AS MATERIALIZED (SELECT url, 0 AS depth, 1 AS priority, 'completed' AS status, 0 AS retries FROM p
  UNION ALL SELECT DISTINCT to_url, 1, 5, CASE WHEN length(to_url) % 7 = 0 THEN 'crawling' WHEN length(to_url) % 11 = 0 THEN 'failed' ELSE 'pending' END, length(to_url) % 3 FROM links),
queue AS MATERIALIZED (SELECT *, {domain('url')} AS domain, {_EPOCH} + length(url) AS created, CASE WHEN status = 'crawling' THEN {_EPOCH} + length(url) END AS last, {_EPOCH} + length(url) + retries * 150 AS next FROM qq)"""
add("frontier_next", f"WITH {QUEUE} SELECT url, priority, depth, CAST(created AS BIGINT) AS created FROM queue WHERE status = 'pending' AND next <= {_NOW} ORDER BY priority, depth, created, url LIMIT 25")
add("frontier_per_host", f"""WITH {QUEUE}, h AS (SELECT domain, count(*) FILTER (WHERE status = 'crawling') AS active, max(last) AS last FROM queue GROUP BY domain),
s AS (SELECT domain, url, row_number() OVER (PARTITION BY domain ORDER BY priority, depth, created, url) AS place FROM queue WHERE status = 'pending' AND next <= {_NOW})
SELECT domain, url, place FROM s JOIN h USING (domain) WHERE place + active <= 3 AND active < 3 AND (h.last IS NULL OR {_NOW} - h.last >= 1)""")
add("queue_status", f"WITH {QUEUE} SELECT status, count(*) AS n FROM queue GROUP BY status")
add("retry_schedule", f"WITH {QUEUE} SELECT url, CAST({_NOW} + (retries + 1) * 300 AS BIGINT) AS next_attempt FROM queue WHERE status = 'crawling'")
add("frontier_new_links", f"WITH {QUEUE}, n AS (SELECT DISTINCT {norm("url || '/more'")} AS url FROM pages) SELECT url, {domain('url')} AS domain, 1 AS depth, 5 AS priority FROM n WHERE url NOT IN (SELECT url FROM queue) AND (ends_with({domain('url')}, '.example.org') OR ends_with({domain('url')}, '.example.net') OR {domain('url')} IN ('example.org', 'example.net'))")

# Engine
add("engine_stats", f"WITH {INDEX}, {anchors_after(LINKS)} {_STATS}, (SELECT count(*) FROM p) AS pages, count(*) AS total_links, count(DISTINCT from_doc_id) AS linking_pages, count(DISTINCT to_doc_id) AS linked_documents FROM links")
add("top_pages", f"WITH {LINKS}, {page_ranks(20)} SELECT doc_id, url, title, round(coalesce(rank, 0), 10) AS pagerank FROM p LEFT JOIN rank USING (doc_id) ORDER BY 4 DESC, doc_id LIMIT 20")
add("upsert", f"""WITH {PAGES} SELECT doc_id, url, CASE WHEN doc_id < 'c' THEN 1672531200 ELSE {_NOW} END AS created, CASE WHEN doc_id > '6' THEN {_NOW} ELSE 1672531200 END AS updated,
CASE WHEN doc_id > '6' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS pagerank, NOT doc_id > '6' AS is_indexed FROM p""")

# Stored tables
_ONE = f"(SELECT {norm('url')} FROM pages WHERE page_id = 0)"
_ONE_ID = f"(SELECT {docid('url')} FROM pages WHERE page_id = 0)"
add("pages_conformed", f"WITH {PAGES}, z AS (SELECT p.doc_id, title, 200 AS status_code, CAST(NULL AS DOUBLE) AS pagerank, CAST(strlen(html) AS BIGINT) AS content_length FROM p JOIN u USING (doc_id)) SELECT * FROM z")
add("pages_paged", f"WITH {PAGES} SELECT doc_id, url FROM p ORDER BY doc_id LIMIT 10 OFFSET 5")
add("page_lookup", f"WITH {PAGES} SELECT doc_id, url, title FROM p WHERE url = {_ONE}")
add("page_links_out", f"WITH {LINKS} SELECT * FROM links WHERE from_doc_id = {_ONE_ID}")
add("page_links_in", f"WITH {LINKS} SELECT * FROM links WHERE to_doc_id = (SELECT min(to_doc_id) FROM links)")
add("links_added", f"WITH {LINKS} SELECT from_doc_id, to_url FROM links")
add("url_known", f"WITH {PAGES} SELECT count(*) > 0 AS exists FROM p WHERE url = {_ONE}")
add("mark_indexed", f"WITH {PAGES} SELECT doc_id, doc_id < '8' AS is_indexed, CASE WHEN doc_id < '8' THEN {_NOW} ELSE 1672531200 END AS updated FROM p")
add("size_limit", "SELECT page_id FROM pages WHERE strlen(html) <= 2000")
add("ranked_pages", f"WITH {PAGES}, l AS (SELECT doc_id, CAST(strlen(html) AS BIGINT) AS content_length FROM u) SELECT *, row_number() OVER (ORDER BY content_length DESC, doc_id) AS rank FROM l QUALIFY rank <= 10")
add("index_saved", ORACLES["postings_weighted"])
add("index_incremental", f"WITH {INDEX} SELECT term, doc_id, freq FROM post")
add("index_state", f"WITH {INDEX} SELECT CAST((SELECT count(*) FROM len) AS INTEGER) AS total_docs, CAST((SELECT count(*) FROM df) AS INTEGER) AS total_terms, 4 AS version")
add("search_saved", ORACLES["search"])
add("search_many_saved", ORACLES["search_many"].replace("SELECT query_id, doc_id, round(bm25, 6) AS bm25, rank FROM r", "SELECT query_id, doc_id, round(bm25, 6) AS bm25, round(0.7::DOUBLE * bm25 / max(bm25) OVER (PARTITION BY query_id), 6) AS final, rank FROM r"))
add("search_full", f"""WITH {FUSED}, n AS (SELECT count(*) AS total FROM (SELECT doc_id FROM parts GROUP BY doc_id HAVING count(*) = 2)),
y AS (SELECT *, 0.7::DOUBLE * (bm25 / tb) + 0.3::DOUBLE * (pagerank / tp) AS f FROM m, x ORDER BY f DESC, bm25 DESC, doc_id LIMIT 5 OFFSET 5)
SELECT total, 2 AS page, CAST(NULL AS VARCHAR) AS corrected, doc_id, round(f, 6) AS final, round(bm25, 4) AS bm25, round(pagerank, 8) AS pagerank FROM y, n""")
add("explain", f"""WITH {FUSED}, q AS (SELECT unnest(['thre', 'thth', 'zzzz']) AS term), own AS (SELECT * FROM parts WHERE doc_id = {_ONE_ID}),
summed AS (SELECT coalesce(sum(part), 0) AS total FROM own), r AS (SELECT coalesce(max(rank), 0) AS pr FROM rank WHERE doc_id = {_ONE_ID})
SELECT term, coalesce(freq, 0) AS tf, df, round(coalesce(idf, 0), 4) AS idf, CASE WHEN freq IS NULL THEN 0 ELSE length END AS doc_length, round(coalesce(avgdl, 0), 1) AS avgdl, round(coalesce(part, 0), 4) AS contribution,
round(total, 4) AS total, round(pr, 8) AS pagerank, round(0.7::DOUBLE * total / tb + 0.3::DOUBLE * pr / tp, 6) AS final FROM q LEFT JOIN own USING (term), summed, r, x""")
add("result_details", f"WITH {SCORES} SELECT doc_id, url, title, length, round(coalesce(bm25, 0), 6) AS bm25 FROM p JOIN len USING (doc_id) LEFT JOIN bm USING (doc_id) WHERE doc_id = {_ONE_ID}")

# Small functions
_RUNS = f"flatten(list_transform(regexp_extract_all(x, '[一-鿿]+'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) || list_transform(range(1, greatest(1, length(r) - 1)), lambda i: substr(r, i, 3))))"
add("cjk_terms", f"""WITH m AS (SELECT n_nationkey, n_name || ' 网络爬虫 的 中文分词器, ' || substr('搜索引擎技术研究', 1, CAST(n_nationkey % 9 AS INTEGER)) || ' running' AS x FROM nation),
w AS (SELECT n_nationkey, {words('x')} || list_filter({_RUNS}, lambda w: w NOT IN ({STOPS})) AS l FROM m)
SELECT n_nationkey, array_to_string(list_transform(l, lambda t: {stem('t')}), ' ') AS terms FROM w""")
add("same_domain", "SELECT page_id, true AS own, false AS other FROM pages")
_HREF = "'../x/./y/../z' || page_id || CASE page_id % 3 WHEN 0 THEN '/..' WHEN 1 THEN '/.' ELSE '?q=../a' END"
add("dotted_links", f"SELECT page_id, {joined(f'({_HREF})')} AS target FROM pages")
add("robots_allowed", f"SELECT page_id FROM pages WHERE length({domain('url')}) % 2 = 1 OR NOT starts_with({part('url', 3)}, '/en')")
add("crawl_delays", f"SELECT DISTINCT {domain('url')} AS domain, CASE WHEN length({domain('url')}) % 2 = 0 THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS delay_seconds FROM pages")
add("crawl_counters", "SELECT count(*) AS visited, count(*) FILTER (WHERE page_id % 7 <> 0) AS pages, count(*) FILTER (WHERE page_id % 7 = 0) AS failures, CAST(coalesce(sum(strlen(html)) FILTER (WHERE page_id % 7 <> 0), 0) AS BIGINT) AS bytes FROM pages")
add("page_windows", """WITH a AS (SELECT o_orderkey, o_custkey % 900 AS total, CASE WHEN o_orderkey % 130 = 0 THEN 20 ELSE least(o_orderkey % 130, 100) END AS lim, o_custkey % 300 AS off FROM orders),
b AS (SELECT *, CAST(greatest(1, ceil(total / lim::DOUBLE)) AS BIGINT) AS n, CAST(greatest(1, floor(off / lim::DOUBLE) - 3) AS BIGINT) AS s FROM a)
SELECT o_orderkey, CAST(lim AS BIGINT) AS limit, array_to_string(list_transform(range(s, least(n, s + 9) + 1), lambda x: CAST(x AS VARCHAR)), ',') AS pages FROM b""")
_V = "(CAST(l_orderkey AS BIGINT) * l_partkey * l_suppkey)"
add("shown_numbers", f"SELECT l_orderkey, l_linenumber, printf('%.4f', l_partkey / 7.0::DOUBLE) AS four, printf('%.6f', l_partkey / 7.0::DOUBLE) AS six, printf('%.1f', l_partkey / 7.0::DOUBLE) AS one, CAST(CASE {' '.join(f'WHEN {_V} < {1 << 7 * n} THEN {n}' for n in range(1, 9))} ELSE 9 END AS BIGINT) AS bytes FROM lineitem")
add("json_maps", f"WITH {PAGES} SELECT doc_id, p.url, title, CAST(strlen(html) AS BIGINT) AS content_length FROM p JOIN u USING (doc_id)")


def _first_replaced(text: str, old: str, new: str) -> str:
    return f"CASE WHEN {old} IS NOT NULL AND strpos({text}, {old}) > 0 THEN substr({text}, 1, strpos({text}, {old}) - 1) || {new} || substr({text}, strpos({text}, {old}) + length({old})) ELSE {text} END"


_ASKED_WORDS = "'thxt', 'retoin', 'zzzzqq', 'one', 'onre'"
add("spell_queries", f"""WITH {_SPELL.replace("['thxt', 'retoin', 'thth', 'zzzzqq', 'onre', 'ersz']", f"[{_ASKED_WORDS}]")}, best AS (SELECT word, term FROM c QUALIFY row_number() OVER (PARTITION BY word ORDER BY freq DESC, term) = 1),
asked AS (SELECT * FROM (VALUES (1, 'Thxt of retoin, thxt'), (2, 'an zzzzqq'), (3, ''), (4, 'ONRE onre')) AS a(query_id, query)),
found AS (SELECT query_id, query, unnest(list_filter(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-Za-z]{{3,}}$'))) AS o, generate_subscripts(list_filter(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-Za-z]{{3,}}$')), 1) AS k FROM asked),
fixed AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY k) AS k, o, term FROM found JOIN best ON best.word = lower(o) WHERE term <> lower(o)),
s0 AS (SELECT a.query_id, query, f1.o AS o1, f1.term AS t1, f2.o AS o2, f2.term AS t2, f3.o AS o3, f3.term AS t3 FROM asked a LEFT JOIN fixed f1 ON f1.query_id = a.query_id AND f1.k = 1 LEFT JOIN fixed f2 ON f2.query_id = a.query_id AND f2.k = 2 LEFT JOIN fixed f3 ON f3.query_id = a.query_id AND f3.k = 3),
s1 AS (SELECT *, {_first_replaced('query', 'o1', 't1')} AS q1 FROM s0), s2 AS (SELECT *, {_first_replaced('q1', 'o2', 't2')} AS q2 FROM s1)
SELECT query_id, query, {_first_replaced('q2', 'o3', 't3')} AS corrected, CAST((o1 IS NOT NULL)::INTEGER + (o2 IS NOT NULL)::INTEGER + (o3 IS NOT NULL)::INTEGER AS BIGINT) AS n FROM s2""")
