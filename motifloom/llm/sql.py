"""The queries of this subpackage as SQL, where SQL can express them."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _fits(host: str, rule: str) -> str:
    name, _, path = rule.partition("/")
    return f"(({host} = '{name}' OR ends_with({host}, '.{name}')) AND starts_with(path, '/{path}'))"


def op1(rules: list) -> str:
    ordered = sorted(rules, key=lambda r: -len(r.text))
    rule = "CASE " + " ".join(f"WHEN {_fits('host', r.text)} THEN '{r.text}'" for r in ordered) + " END"
    action = "CASE " + " ".join(f"WHEN {_fits('host', r.text)} THEN '{r.action}'" for r in ordered) + " END"
    parts = rf"translate(regexp_extract({{u}}, '(?s)^.*?://([^/?#]*)', 1), {ASCII}) AS host, regexp_extract({{u}}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, CASE WHEN contains({{u}}, '://') THEN translate(regexp_extract({{u}}, '(?s)^(.*?)://', 1), {ASCII}) || '://' || translate(regexp_extract({{u}}, '(?s)^.*?://([^/?#]*)', 1), {ASCII}) || regexp_extract({{u}}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END AS node"
    hidden = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<textarea\b.*?</textarea\s*>|<title\b.*?</title\s*>"
    pair = r"""'([^\s"''>/=]+)\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)'"""
    attr = lambda name: f"""replace(trim(regexp_extract_all(tag, {pair}, 2)[list_position(list_transform(regexp_extract_all(tag, {pair}, 1), lambda x: lower(x)), '{name}')], '"'' '), '&amp;', '&')"""
    refresh = f"""nullif(regexp_extract({attr('content')}, '(?is)^\\s*[0-9.]+\\s*[;,\\s]\\s*(?:url\\s*=\\s*)?["'']?([^"'']+)', 1), '')"""
    ref = rf"CASE WHEN regexp_matches(tag, '(?i)^<link\b') AND list_contains(regexp_split_to_array(lower({attr('rel')}), '\s+'), 'canonical') THEN {attr('href')} WHEN regexp_matches(tag, '(?i)^<meta\b') AND lower({attr('http-equiv')}) = 'refresh' THEN {refresh} END"
    scheme = "regexp_extract(url, '(?s)^(.*?)://', 1)"
    # absolute references and those from the root; the tests hold the operator against a parser for the others
    absolute = f"CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN {scheme} || ':' || t WHEN starts_with(t, '/') THEN {scheme} || '://' || regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) || t END"
    return rf"""WITH RECURSIVE p AS (SELECT page_id, url, {parts.format(u='url')} FROM pages),
l AS (SELECT DISTINCT url, {absolute} AS target FROM (SELECT url, {ref} AS t FROM (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '{hidden}', ' ', 'g'), '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM pages)) WHERE contains(url, '://') AND t <> ''),
u AS (SELECT url AS raw, {parts.format(u='url')} FROM (SELECT url FROM l WHERE contains(target, '://') UNION SELECT target FROM l WHERE contains(target, '://'))),
g AS (SELECT a.node AS x, b.node AS y FROM l JOIN u a ON a.raw = l.url JOIN u b ON b.raw = l.target UNION SELECT b.node, a.node FROM l JOIN u a ON a.raw = l.url JOIN u b ON b.raw = l.target),
reach AS (SELECT x AS node, x AS other FROM g UNION SELECT r.node, g.y FROM reach r JOIN g ON g.x = r.other),
c AS (SELECT node, min(other) AS class FROM reach GROUP BY node),
ruled AS (SELECT *, {rule} AS rule, {action} AS action FROM p),
votes AS (SELECT coalesce(c.class, n.node) AS class, min(action) AS vote FROM (SELECT node, action FROM ruled UNION ALL SELECT node, {action} FROM u) n LEFT JOIN c USING (node) WHERE action IS NOT NULL AND n.node IS NOT NULL GROUP BY 1)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(action, vote, 'allow') AS verdict FROM ruled LEFT JOIN c USING (node) LEFT JOIN votes ON votes.class = coalesce(c.class, ruled.node)"""


OP3 = r"""WITH dw AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, row_number() OVER () AS r, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark WHERE text IS NOT NULL),
ik AS (SELECT *, least(len(w), 5) AS k FROM iw WHERE w <> ['']),
ish AS (SELECT DISTINCT r, item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS s FROM ik),
q AS (SELECT r, count(*) AS q FROM ish GROUP BY r),
dsh AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS s FROM dw, (SELECT DISTINCT k FROM ik) WHERE len(w) >= k),
c AS (SELECT doc_id, any_value(item_id) AS item_id, count(*) / any_value(q.q) AS containment FROM dsh JOIN ish USING (k, s) JOIN q USING (r) GROUP BY doc_id, r HAVING count(*) / any_value(q.q) >= 0.8 - 1e-9)
SELECT doc_id, item_id, max(containment) AS containment FROM c GROUP BY doc_id, item_id"""


def _print(text: str, name: str) -> str:
    """CTEs that give name (doc_id, fp) for the table and column text (table.column)."""
    table, column = text.split(".")
    new = "list_concat([0], list_filter(range(1, len(w)), lambda i: (5 * ascii(w[i + 1]) + 3 * length(w[i + 1]) + ascii(w[i])) % 4 = 0))"
    block = "list_transform(range(1, len(firsts) + 1), lambda j: w[firsts[j] + 1 : coalesce(firsts[j + 1], len(w))])"
    leaves = f"flatten(list_transform({block}, lambda x: list_transform(range(0, (len(x) - 1) // 64 + 1), lambda t: sha256(array_to_string(x[t * 64 + 1 : t * 64 + 64], ' ')))))"
    return f"""{name}p AS (SELECT doc_id, unnest(string_split({column}, chr(10))) AS par, generate_subscripts(string_split({column}, chr(10)), 1) AS i FROM {table}),
{name}w AS (SELECT doc_id, i, string_split(par, ' ') AS w FROM {name}p),
{name}b AS (SELECT *, {new} AS firsts FROM {name}w),
{name}l AS (SELECT doc_id, i, {leaves} AS leaves FROM {name}b),
{name}n AS (SELECT doc_id, i, sha256(array_to_string(leaves, '')) AS node, array_to_string(list_transform(leaves, lambda x: left(x, 8)), ',') AS shown FROM {name}l),
{name}e AS (SELECT *, CASE WHEN node < '4' THEN '|' ELSE '.' END AS e FROM {name}n),
{name}t AS (SELECT doc_id, string_agg(node || e, '' ORDER BY i) AS nodes, string_agg(left(node, 16) || '-' || shown || e, '' ORDER BY i) AS shown FROM {name}e GROUP BY doc_id),
{name}s AS (SELECT doc_id, list_transform(list_filter(string_split(nodes, '|'), lambda s: s <> ''), lambda s: sha256(s)) AS nodes, list_filter(string_split(shown, '|'), lambda s: s <> '') AS shown FROM {name}t),
{name} AS (SELECT doc_id, sha256(array_to_string(nodes, '')) || ':' || array_to_string(list_transform(range(1, len(nodes) + 1), lambda i: left(nodes[i], 16) || '=' || shown[i]), '|') AS fp FROM {name}s)"""


_LEAVES = "list_distinct(list_filter(regexp_split_to_array(substr({f}, 66), '[|=.,-]'), lambda x: length(x) = 8))"


def _dice(a: str, b: str) -> str:
    x, y = _LEAVES.format(f=a), _LEAVES.format(f=b)
    return f"CASE WHEN left({a}, 64) = left({b}, 64) THEN 1.0 ELSE CAST(2.0 * len(list_intersect({x}, {y})) / (len({x}) + len({y})) AS DOUBLE) END"


OP5 = f"""WITH o AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nt, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS nid FROM o WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT doc_id, length(text) AS n_chars, nid, left(text, length(text) - length(text) // 3) || left(nt, length(text) // 3) AS edited FROM n),
{_print('o.text', 'f')}, {_print('e.edited', 'g')}
SELECT e.doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, f.fp AS fingerprint, g.fp AS edited_fingerprint, {_dice('f.fp', 'g.fp')} AS near_edited, {_dice('f.fp', 'h.fp')} AS near_next
FROM e JOIN f USING (doc_id) JOIN g USING (doc_id) JOIN f h ON h.doc_id = nid"""

OP6 = f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i : i + 12], ' '))) AS s FROM w WHERE len(w) >= 13),
m AS (SELECT s, min(doc_id) AS first_id FROM g GROUP BY s),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN m USING (s) WHERE first_id < doc_id),
x AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM w),
k AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS kept, count(*) AS n FROM x ANTI JOIN r USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

OP8 = """WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS pos FROM conversations),
c AS (SELECT conv_id, max(pos) AS n, list([role, text] ORDER BY pos) AS turns FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT turns[1 : i] AS turns FROM (SELECT turns, unnest(range(1, n)) AS i FROM c)),
k AS (SELECT min(conv_id) AS conv_id FROM c ANTI JOIN p USING (turns) GROUP BY turns)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text FROM t SEMI JOIN k USING (conv_id) GROUP BY conv_id"""

OP9 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, octet_length(b)) AS first_id FROM p),
x AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right('000' || bin(instr('0123456789abcdef', h[i]) - 1), 4)), '') AS bits FROM f)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM x"""
