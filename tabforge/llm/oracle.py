"""DuckDB SQL with the rows of the registered queries, written from the contract."""

from __future__ import annotations

OP2 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest, body,
             max(page_id) OVER (PARTITION BY body) AS winner FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM winner AND winner IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM winner THEN winner END AS refers_to
FROM q
"""

OP7 = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

OP10 = """
WITH a AS (SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS after FROM pages),
b AS (SELECT page_id, regexp_extract(after, '^[^/?#]*') AS raw, after FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(after, length(raw) + 1), '^[^?#]*') AS path, substr(after, length(raw) + 1) AS rest FROM b),
d AS (SELECT *, '.' || host AS dotted FROM c),
e AS (SELECT *, CASE
    WHEN suffix(dotted, '.example.net') AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN suffix(dotted, '.example.com') AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN suffix(dotted, '.org') AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN suffix(dotted, '.net') AND prefix(path, '/') THEN 'net/' END AS rule,
  list_filter([
    CASE WHEN contains(path, '/ads/') THEN 'path-ads' END,
    CASE WHEN contains(path, '/banner/') THEN 'path-banner' END,
    CASE WHEN regexp_matches(path, '/login([/.]|$)') THEN 'path-login' END,
    CASE WHEN regexp_matches(path, '/cart(/|$)') THEN 'path-cart' END,
    CASE WHEN regexp_matches(rest, '[?&]sid=') THEN 'query-sid' END,
    CASE WHEN regexp_matches(rest, '[?&]sessionid=') THEN 'query-sessionid' END,
    CASE WHEN suffix(path, '.exe') OR path = '' AND suffix(host, '.exe') THEN 'file-exe' END,
    CASE WHEN suffix(path, '.zip') OR path = '' AND suffix(host, '.zip') THEN 'file-zip' END], lambda x : x IS NOT NULL) AS hits FROM d)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block'
       ELSE CASE WHEN len(hits) > 0 THEN 'block' ELSE 'allow' END END AS verdict,
  CASE WHEN rule IS NULL AND len(hits) > 0 THEN list_sort(list_transform(hits, lambda x : lpad(length(x)::VARCHAR, 4, '0') || x))[-1][5:] END AS pattern_rule
FROM e
"""


OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(generate_series(1, len(w))) AS pos, w FROM d),
q AS (SELECT doc_id, n, pos, w[pos] AS word,
             CASE WHEN pos + 49 <= n THEN array_to_string(w[pos:pos + 49], ' ') END AS win FROM p),
r AS (SELECT *, CASE WHEN win IS NOT NULL THEN min(doc_id) OVER (PARTITION BY win) END AS first FROM q),
s AS (SELECT *, coalesce(bool_or(first < doc_id) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM r),
t AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(t.n_removed, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""

OP5 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
w AS (SELECT *, list_max(list_transform(x, lambda e : abs(e))) AS m FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
        AND len(list_filter(x, lambda e : e IS NULL OR NOT isfinite(e))) = 0),
f AS (SELECT vec_id, label, CASE WHEN m BETWEEN 1e-100 AND 1e100 THEN x ELSE list_transform(x, lambda e : e / m) END AS x FROM w WHERE m > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.93),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, v.vec_id) AS component_id,
       v.vec_id = coalesce(c.component_id, v.vec_id) AS kept
FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

_ASSIGN = (
    "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    """["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
_KINDS = (("assign", 0, _ASSIGN, 12), ("access", 1, "(AKIA[A-Z0-9]+)", 18), ("hex", 2, "([0-9a-f]+)", 16), ("owned", 3, "([A-Za-z0-9_-]{20,})", 20))
_SPANS = " UNION ALL ".join(
    f"""SELECT doc_id, source, '{kind}' AS kind, {rank} AS rank, s[k] AS start, s[k] + length(m[k]) AS stop, g[k] AS value FROM (
  SELECT doc_id, source, m, g, unnest(generate_series(1, len(m))) AS k,
    list_transform(generate_series(1, len(m)), lambda i : CAST(list_sum(list_transform(p[1:i], lambda x : length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x : length(x))), 0) AS BIGINT)) AS s
  FROM (SELECT doc_id, source, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', 1) AS g, string_split_regex(t, '{pattern}') AS p
        FROM docs WHERE regexp_matches(t, '{pattern}'))) WHERE length(g[k]) >= {least}"""
    for kind, rank, pattern, least in _KINDS
)
OP8 = f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
spans AS ({_SPANS}),
base AS (SELECT * FROM spans WHERE kind <> 'owned'),
extra AS (SELECT * FROM spans o WHERE kind = 'owned' AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
          AND len(list_distinct(string_split(value, ''))) >= 10
          AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.start < o.stop AND o.start < b.stop)),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
firsts AS (SELECT c.value, d.t, min((coalesce(d.source, ''), CAST(d.doc_id AS VARCHAR))) AS own FROM cand c JOIN docs d ON d.doc_id = c.doc_id GROUP BY c.value, d.t),
owners AS (SELECT value, count(DISTINCT own[1]) >= 2 OR count(DISTINCT own) >= 10 AS example FROM firsts GROUP BY value),
j AS (SELECT cand.*, example, kind || ':' || start || ':' || stop AS said FROM cand JOIN owners USING (value)),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(said, ',' ORDER BY start, rank) FILTER (kind <> 'owned') AS base,
        string_agg(said, ',' ORDER BY start, rank) FILTER (kind <> 'owned' OR NOT example) AS spans,
        count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_example FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM docs d LEFT JOIN g ON d.doc_id = g.doc_id
"""

OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
k AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.component_id, d.doc_id) AS component_id,
       coalesce(k.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""


def queries_sql() -> dict[str, str]:
    """Language ID, packing and BPE have no SQL form; they are tested against brute force."""
    return {
        "op1_substring_dedup": OP1,
        "op2_warc": OP2,
        "op5_vector_dedup": OP5,
        "op7_exact_dedup": OP7,
        "op8_secret_scan": OP8,
        "op9_near_dedup": OP9,
        "op10_url_filter": OP10,
    }
