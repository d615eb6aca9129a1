"""SQL of the queries that SQL can express, for DuckDB over the same tables."""

from .decontam import LEAST, MASKS, SHARE

OP2_WARC = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""

def _seeds(table: str, ident: str, key: str) -> str:
    """Windows of the masks: which, where and the words that they keep."""
    each = []
    for k, m in enumerate(MASKS):
        kept = " || ' ' || ".join(f"w[pos + {i + 1}]" for i, c in enumerate(m) if c == "1")
        each.append(f"SELECT {ident}, pos AS {key}, '{k} ' || {kept} AS seed FROM (SELECT {ident}, w, unnest(range(0, len(w) - {len(m) - 1})) AS pos FROM {table} WHERE len(w) >= {len(m)})")
    return " UNION ALL ".join(each)


_WORDS = "string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"
OP9_DECONTAM = f"""
WITH d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), b AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), ds AS ({_seeds("d", "doc_id", "d_at")}
), bs AS ({_seeds("b", "item_id", "b_at")}
), hits AS (
  SELECT DISTINCT doc_id, item_id, d_at - b_at AS shift FROM ds JOIN bs USING (seed)
), met AS (
  SELECT doc_id, item_id, len(b.w) AS n, least({LEAST}, len(b.w)) AS width,
    list_transform(range(1, len(b.w) + 1), lambda i: CASE WHEN i + shift BETWEEN 1 AND len(d.w) AND d.w[greatest(1, i + shift)] = b.w[i] THEN 1 ELSE 0 END) AS agree
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)
), seen AS (
  SELECT doc_id, item_id, width, list_sum(agree) AS n_agree, list_max(list_transform(range(1, n - width + 2), lambda s: list_sum(agree[s:s + width - 1]))) AS best FROM met
)
SELECT doc_id, item_id, CAST(max(n_agree) AS INT) AS n_agree, CAST(max(best) AS INT) AS best FROM seen WHERE best >= ceil({SHARE} * width) GROUP BY doc_id, item_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _p(n: str, of: str) -> str:
    return f"1 + 1000000000::HUGEINT * ({n} + 2) // ({of} + 2 * v)"


OP11_DIVERGENCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), t AS (
  SELECT doc, lang, source, unnest(terms) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term
), l AS (
  SELECT lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang
), g AS (
  SELECT lang, source, v, l.n AS l_n, coalesce(sum(c.n), 0) AS g_n FROM (SELECT DISTINCT lang, source FROM d) JOIN l USING (lang) LEFT JOIN c USING (lang, source) GROUP BY lang, source, v, l.n
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_p("coalesce(c.n, 0)", "g_n")} AS p, {_p("k.n", "l_n")} AS q
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), met AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN met ON met.lang = a.lang AND met.source = a.source AND met.item = b.source
), parts AS (
  SELECT * FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM dense WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""

_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
# levenshtein() counts bytes, so each letter beyond ASCII is told by one byte of its own: 1 to 64.
_BYTES = "translate(word, '" + "".join(map(chr, range(0xC0, 0x100))) + "', array_to_string(list_transform(range(1, 65), lambda i: chr(CAST(i AS INT))), ''))"
OP12_SPELLING = rf"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS step, i AS c FROM range(256) AS t(i)
  UNION ALL SELECT i, step + 1, {_STEP.format("c")} FROM bits WHERE step < 8
), crc AS (
  SELECT list(c ORDER BY i) AS crc_of FROM bits WHERE step = 8
), runs AS (
  SELECT id, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY id, run
), hexed AS (
  SELECT run, n, hex(encode(id || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_transform(range(0, length(x) // 2), lambda i: CAST(concat('0x', x[2 * i + 1:2 * i + 2]) AS BIGINT)), lambda h, b: xor(h >> 8, crc_of[1 + (xor(h, b) & 255)]), 4294967295)) AS h
  FROM hexed, crc
), found AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed
), w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n, {_BYTES} AS told, length(word) AS letters FROM found WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cuts AS (
  SELECT word, n, told, unnest(list_distinct(list_append(list_transform(range(1, letters + 1), lambda i: told[:i - 1] || told[i + 1:]), told))) AS cut FROM w
), near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS m FROM cuts a JOIN cuts b USING (cut) WHERE a.word <> b.word AND levenshtein(a.told, b.told) = 1
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, (list(near ORDER BY m DESC, near))[1] AS near FROM near GROUP BY word
), f AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN near END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM w LEFT JOIN best USING (word)
), up AS (
  SELECT word, word AS root, form FROM f
  UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.form
)
SELECT word, f.form, root, n, n_near, form_n FROM up JOIN f USING (word) WHERE up.form IS NULL
"""

ORACLES = {"op2_warc": OP2_WARC, "op9_decontam": OP9_DECONTAM, "op11_divergence": OP11_DIVERGENCE, "op12_spelling": OP12_SPELLING}
