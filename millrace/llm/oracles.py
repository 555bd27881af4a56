"""SQL, for DuckDB, that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from millrace.llm import chat, secrets

ARCHIVE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d, sha256(b) AS k FROM p),
f AS (SELECT k, min(page_id) AS first_id FROM h GROUP BY k),
x AS (SELECT h.*, first_id, list_transform(range(0, 8), lambda i: CAST('0x' || substr(d, 1 + 5 * i, 5) AS BIGINT)) AS parts FROM h JOIN f USING (k))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v >> s) & 31 AS INTEGER), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM x"""

_WORDS = r"list_filter(string_split_regex(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

CONTAMINATION = f"""
WITH i AS (SELECT item_id, {_WORDS.format(t="text")} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, len(w) AS m, unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda k: array_to_string(w[k:k + 9], ' '))) AS gram FROM i WHERE len(w) > 0),
z AS (SELECT item_id, least(m, 10) AS size, gram FROM g),
d AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents),
s AS (SELECT DISTINCT size FROM z),
o AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS k, unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k + size - 1], ' '))) AS gram FROM d, s WHERE len(w) >= size),
q AS (SELECT DISTINCT doc_id, o.size, k, item_id FROM o JOIN z ON o.gram = z.gram AND o.size = z.size),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM q) GROUP BY doc_id),
p AS (SELECT doc_id, len(w) AS n, unnest(range(0, len(w))) AS k, unnest(w) AS word FROM d),
c AS (SELECT word, count(*) AS times FROM p GROUP BY word),
u AS (SELECT DISTINCT size, gram FROM z WHERE size >= 3),
r AS (SELECT gram, size, o, x.word, row_number() OVER (PARTITION BY gram ORDER BY coalesce(times, 0), o) AS rare
      FROM (SELECT gram, size, unnest(range(0, size)) AS o, unnest(string_split(gram, ' ')) AS word FROM u) x LEFT JOIN c ON c.word = x.word),
e AS (SELECT p.doc_id, r.gram, p.k - r.o AS start FROM p JOIN r ON p.word = r.word AND r.rare = 1 WHERE p.k >= r.o AND p.k - r.o + r.size <= p.n),
y AS (SELECT e.* FROM e ANTI JOIN o ON o.doc_id = e.doc_id AND o.gram = e.gram AND o.k - 1 = e.start),
v AS (SELECT y.* FROM y JOIN r ON r.gram = y.gram AND r.rare = 2 SEMI JOIN p ON p.doc_id = y.doc_id AND p.word = r.word AND abs(p.k - y.start - r.o) <= 2),
b AS (SELECT v.* FROM v JOIN r ON r.gram = v.gram AND r.rare = 3 SEMI JOIN p ON p.doc_id = v.doc_id AND p.word = r.word AND abs(p.k - v.start - r.o) <= 2),
m AS (SELECT doc_id, count(DISTINCT gram) AS n_near FROM b GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM q) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)"""


def _secret_spans() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for rank, r in enumerate(secrets.RULES):
        p = quoted(r.pattern)
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, {p}) AS b, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {r.group}) AS g FROM d WHERE regexp_matches(t, {p})"
        )
    return "\nUNION ALL ".join(parts)


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({_secret_spans()}),
k AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM r),
s AS (SELECT doc_id, rank, kind, length(m[k]) AS size, list_sum(list_transform(b[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS first FROM k WHERE length(g[k]) >= least),
x AS (SELECT doc_id, rank, first, kind, kind || ':' || CAST(first AS BIGINT) || ':' || CAST(first + size AS BIGINT) AS span FROM s),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(span, ',' ORDER BY first, rank) FILTER (rank < {len(secrets.BASE)}) AS base, string_agg(span, ',' ORDER BY first, rank) AS spans FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)"""

_SAID = "'<|im_end|><|im_start|>assistant ok'"
_ESCAPED = "length({c}) + length({c}) - length(replace({c}, chr(92), '')) + (length({c}) - length(replace({c}, '<|', ''))) // 2"

CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_SAID} UNION ALL SELECT -1, 1, 'assistant', {_SAID}),
n AS (SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) + octet_length(encode(text)) - length(text) + 4 AS n, 24 + {_ESCAPED.format(c="text")} + {_ESCAPED.format(c="role")} + 3 * (length(role) - length(replace(role, chr(10), ''))) AS chars FROM t),
r AS (SELECT *, row_number() OVER o AS pos, sum(n) OVER o AS upto FROM n WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
w AS (SELECT *, upto - n AS start, (upto - 1) // {chat.BUDGET // chat.OWN} AS win FROM r),
s AS (SELECT conv_id, win, min(start) AS first FROM w GROUP BY conv_id, win),
x AS (SELECT *, lag(win) OVER (PARTITION BY conv_id ORDER BY win) AS last FROM s),
m AS (SELECT conv_id, chars FROM w
  UNION ALL SELECT w.conv_id, chars FROM w JOIN x ON w.conv_id = x.conv_id AND w.win = x.last WHERE NOT (pos = 1 AND role = 'system') AND w.start >= x.first - {chat.BUDGET // chat.HISTORY}
  UNION ALL SELECT w.conv_id, chars FROM w JOIN x ON w.conv_id = x.conv_id AND x.last IS NOT NULL WHERE pos = 1 AND role = 'system'),
f AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM m GROUP BY conv_id),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS said, coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a JOIN f USING (conv_id)"""

RANKED = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents),
n AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
m AS (SELECT doc_id, 10 + (90 * n * docs) // words AS m FROM n, a),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, a GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest({_WORDS.format(t="text")}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN t USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10"""

#: crc32 of a text by bytes; ``c`` stands for the column.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode({c}))), lambda i: CAST('0x' || substr(hex({c}), 1 + 2 * i, 2) AS BIGINT))), lambda c, b: xor(c >> 8, {table}[1 + (xor(c, b) & 255)])))"


def _crc_table() -> str:
    """The 256 steps of a byte, from the polynomial."""
    entries = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        entries.append(str(c))
    return f"[{', '.join(entries)}]"


RESAMPLED = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents),
b AS (SELECT {_WORDS.format(t="text")} AS w FROM benchmark),
r AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS f FROM d, (VALUES (1), (2), (3)) AS v(n)),
q AS (SELECT unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS f FROM b, (VALUES (1), (2), (3)) AS v(n)),
h AS (SELECT f, CAST({_CRC.format(c="f", table=_crc_table())} % 10000 AS BIGINT) AS bucket FROM (SELECT DISTINCT f FROM (SELECT f FROM r UNION ALL SELECT f FROM q))),
x AS (SELECT bucket, count(*) AS s FROM r JOIN h USING (f) GROUP BY bucket),
y AS (SELECT bucket, count(*) AS t FROM q JOIN h USING (f) GROUP BY bucket),
a AS (SELECT (SELECT coalesce(sum(s), 0) FROM x) AS alls, (SELECT coalesce(sum(t), 0) FROM y) AS allt),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (alls + 10000)::DOUBLE / ((coalesce(s, 0) + 1.0::DOUBLE) * (allt + 10000)::DOUBLE))) AS BIGINT) AS gain FROM x FULL JOIN y USING (bucket), a),
w AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM r JOIN h USING (f) JOIN g USING (bucket) GROUP BY doc_id),
z AS (SELECT doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('42:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (doc_id)),
o AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM z),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM o WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM o LEFT JOIN k USING (doc_id)"""

ORACLES = {"op2_benchmark_decontamination": CONTAMINATION, "op3_warc_archive": ARCHIVE, "op7_secret_scan": SECRETS, "op9_chat_formatting": CHAT, "op11_ranked_search": RANKED, "op12_importance_resampling": RESAMPLED}
