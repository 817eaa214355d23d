"""The queries of this subpackage in DuckDB SQL, where SQL can express them."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE_WORDS = r"[^\x20\x09-\x0D]+"
ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(column: str, pattern: str, lower: bool = True) -> str:
    text = f"coalesce({column}, '')"
    text = f"translate({text}, '{UPPER}', '{LOWER}')" if lower else text
    return f"regexp_extract_all({text}, '{pattern}')"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = ("(" + "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?"
          + either_case("key") + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""")
KINDS = (("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))

OP1 = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(n, r)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) + 11)::BIGINT AS formatted_chars,
  0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
FROM rows GROUP BY conv_id
"""

OP2 = f"""
WITH d AS (SELECT doc_id, {words('text', ITEM_WORDS)} AS w FROM documents),
b AS (SELECT item_id, {words('text', ITEM_WORDS)} AS w FROM benchmark),
x AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, md5(array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ')) AS h
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
p AS (
  SELECT doc_id, i, k, md5(array_to_string(list_slice(w, i, i + k - 1), ' ')) AS h
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM x) WHERE len(w) >= k)
),
m AS (SELECT DISTINCT doc_id, i, p.k, item_id FROM p JOIN x ON p.h = x.h AND p.k = x.k),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {words('text', WHITE_WORDS, False)} AS w FROM documents),
p AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
),
f AS (SELECT h, min(doc_id) AS least FROM p GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM p JOIN f ON p.h = f.h WHERE doc_id > least),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS line, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) AS t ANTI JOIN gone USING (doc_id, j)
  GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def near(source: str) -> str:
    """CTEs ending in ``near_found(doc_id, n_shingles, component_id)`` for the rows of ``source``."""
    return f"""
near_w AS (SELECT doc_id, {words('text', WHITE_WORDS)} AS w FROM {source}),
near_s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s
  FROM near_w
),
near_e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM near_s),
near_l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM near_e AS a JOIN near_e AS b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
near_r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM {source} UNION SELECT near_l.b, near_r.c FROM near_r JOIN near_l ON near_l.a = near_r.doc_id
),
near_c AS (SELECT doc_id, min(c) AS component_id FROM near_r GROUP BY doc_id),
near_found AS (
  SELECT near_s.doc_id, len(s) AS n_shingles, component_id FROM near_s JOIN near_c ON near_s.doc_id = near_c.doc_id
)"""


OP5 = f"WITH RECURSIVE {near('documents')} SELECT *, doc_id = component_id AS kept FROM near_found"

OP6 = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '^(?s:.*?)://[^/?#]*(/[^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)
),
r(h, s, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (
  SELECT page_id, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id
"""


def secret_rows() -> str:
    parts = []
    for order, (kind, pattern, group, least) in enumerate(KINDS):
        parts.append(f"""
  SELECT doc_id, {order} AS k, '{kind}' AS kind, {least} AS least, i, length(gaps[i]) AS gap, length(found[i]) AS long, length(val[i]) AS size
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS gaps,
      regexp_extract_all(t, '{pattern}', {group}) AS val
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))""")
    return " UNION ALL ".join(parts)


OP7 = f"""
WITH m AS ({secret_rows()}),
s AS (SELECT *, sum(gap + long) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM m),
f AS (SELECT doc_id, k, kind, (stop - long)::BIGINT AS start, stop::BIGINT AS stop FROM s WHERE size >= least),
j AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents AS d LEFT JOIN j ON d.doc_id = j.doc_id
"""


def exact(source: str) -> str:
    """CTEs ending in ``exact_found`` for the rows of ``source``."""
    return f"""
exact_d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS h
  FROM {source}
),
exact_found AS (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY h) AS group_size, h AS text_sha256
  FROM exact_d
)"""


OP8 = f"WITH {exact('documents')} SELECT *, doc_id = keep_id AS kept FROM exact_found"

#: crc32 of a short text of ASCII characters, bit by bit.
CRC = """xor(4294967295, list_reduce([4294967295]::BIGINT[] || list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""


def way(state: str, cost: str, edit: str, line: str = "") -> str:
    """The prefix of a state, with one edit more; a null cost is no way."""
    lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {lines}}}"


def cheapest(*ways: str) -> str:
    """The least of several prefixes by cost, then audit; those without a cost don't count."""
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w.c IS NOT NULL))"


def kept(state: str, initial: str) -> str:
    return way(state, f"CASE WHEN x.fault IN ('b', 'd') OR x.ini <> '{initial}' THEN NULL WHEN x.fault = 't' THEN 3 ELSE 0 END", "K", "x.line")


def reroled(state: str, role: str) -> str:
    return way(state, "CASE WHEN x.fault IN ('b', 'd') THEN NULL WHEN x.fault = 't' THEN 6 ELSE 3 END", "R", f"'{role}:' || x.text")


def inserted(state: str, role: str) -> str:
    return way(state, "3", "I", f"'{role}:'")


# One prefix for each state (nothing yet, after system, user, assistant) is carried from row to row.
OP11 = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k
  FROM conversations
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN k = 0 THEN 0 WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM src
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth FROM numbered),
f AS (
  SELECT conv_id, turn, n, left(role, 1) AS ini, role || ':' || text AS line, text, CASE
    WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault
  FROM seen
),
walk(conv_id, n, p, q, u, d) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0, 'a': '', 't': []::VARCHAR[]}}, {{'c': NULL::INTEGER, 'a': '', 't': []::VARCHAR[]}},
    {{'c': NULL::INTEGER, 'a': '', 't': []::VARCHAR[]}}, {{'c': NULL::INTEGER, 'a': '', 't': []::VARCHAR[]}} FROM conversations
  UNION ALL
  SELECT conv_id, n, p, coalesce(q, z), coalesce(u, z), coalesce(d, z) FROM (
    SELECT x.conv_id, x.n, {{'c': NULL::INTEGER, 'a': '', 't': []::VARCHAR[]}} AS z, {cheapest(way("y.p", "4", "D"))} AS p,
      {cheapest(way("y.q", "4", "D"), kept("y.p", "s"))} AS q,
      {cheapest(way("y.u", "4", "D"), *(g(s, r) for s in ("y.p", "y.q", "y.d") for g, r in ((kept, "u"), (reroled, "user"))))} AS u,
      {cheapest(way("y.d", "4", "D"), kept("y.u", "a"), reroled("y.u", "assistant"))} AS d
    FROM (
      SELECT conv_id, n, p, q, u, {cheapest("d", inserted("u", "assistant"))} AS d FROM (
        SELECT conv_id, n, p, q, d, {cheapest("u", *(inserted(s, "user") for s in "pqd"))} AS u FROM walk)
    ) AS y JOIN f AS x ON x.conv_id IS NOT DISTINCT FROM y.conv_id AND x.n = y.n + 1
  )
),
ended AS (
  SELECT conv_id, {cheapest("p", "d", inserted("u", "assistant"))} AS best
  FROM (SELECT conv_id, arg_max(p, n) AS p, arg_max(u, n) AS u, arg_max(d, n) AS d FROM walk GROUP BY conv_id)
),
pairs AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY n) || ini AS pair FROM f),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM pairs GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c::BIGINT AS cost, best.a AS audit,
  sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM ended AS e LEFT JOIN counts AS c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {words('text', TERMS)} AS w FROM documents),
sums AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest({words('text', TERMS)}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
),
p AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, sums GROUP BY term
),
s AS (
  SELECT item_id, row, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term), sums GROUP BY item_id, row, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""

ORACLES = {
    "op1_chat": OP1, "op2_decontaminate": OP2, "op4_substring_dedup": OP4, "op5_near_dedup": OP5, "op6_url_filter": OP6,
    "op7_secret_scan": OP7, "op8_exact_dedup": OP8, "op11_repair": OP11, "op13_search": OP13,
}
