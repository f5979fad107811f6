"""SQL that gives the rows of registered queries another way."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINES = f"""
WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
repeated AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.holder AS dropped FROM k LEFT JOIN repeated r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest FROM p),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n >= 1000) END AS newest FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN newest IS NOT NULL AND page_id IS DISTINCT FROM newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM r
"""

_SHARE = "(1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * {v}))::BIGINT"

DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total,
  (SELECT count(*) FROM kept WHERE kept.lang = g.lang) AS v FROM g),
p AS (SELECT s.lang, s.source, kept.term, coalesce(c.n, 0) AS n, {_SHARE.format(n="coalesce(c.n, 0)", total="s.total", v="s.v")} AS p
  FROM s JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
whole AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
q AS (SELECT lang, term, {_SHARE.format(n="sum(n)", total="any_value(whole.total)", v="(SELECT count(*) FROM kept k WHERE k.lang = c.lang)")} AS q FROM c JOIN whole USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
  coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def _leaf(n_chars: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


# CRC-32 of decimal digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::UBIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""

MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('1' || lang, '0') AS tree, {_leaf("n_chars")} AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS claimed
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
low(tree, l, i, n, node) AS (
  SELECT tree, 0, i, n, leaf FROM placed UNION ALL
  SELECT tree, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY tree, l, n, i // 2),
subroots AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS groups FROM low WHERE n = 1),
high(l, i, n, node) AS (
  SELECT 0, place, groups, subroot FROM subroots UNION ALL
  SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY l, n, i // 2),
steps AS (
  SELECT r.id, s.l, (r.i >> s.l) & 1 AS odd, x.node AS sib FROM placed r JOIN (SELECT DISTINCT tree, l FROM low WHERE n > 1) s USING (tree)
    LEFT JOIN low x ON x.tree = r.tree AND x.l = s.l AND x.i = xor(r.i >> s.l, 1) UNION ALL
  SELECT r.id, 64 + s.l, (g.place >> s.l) & 1, x.node FROM placed r JOIN subroots g USING (tree) CROSS JOIN (SELECT DISTINCT l FROM high WHERE n > 1) s
    LEFT JOIN high x ON x.l = s.l AND x.i = xor(g.place >> s.l, 1)),
paths AS (SELECT id, list({{'odd': odd, 'sib': sib}} ORDER BY l) AS path FROM steps GROUP BY id),
proved AS (
  SELECT r.doc_id, r.leaf, g.subroot, (SELECT node FROM high WHERE n = 1) AS root,
    sha256(coalesce(array_to_string(list_transform(list_filter(path, lambda s: s.sib IS NOT NULL), lambda s: s.sib), ''), '')) AS proof_sha256,
    list_reduce(list_prepend({{'odd': 0::BIGINT, 'sib': r.claimed}}, coalesce(path, [])), lambda a, s: {{'odd': 0::BIGINT, 'sib': CASE WHEN s.sib IS NULL THEN sha256(a.sib)
      WHEN s.odd = 1 THEN sha256(s.sib || a.sib) ELSE sha256(a.sib || s.sib) END}}).sib AS folded_root
  FROM placed r JOIN subroots g USING (tree) LEFT JOIN paths USING (id))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM proved
"""
