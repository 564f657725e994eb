"""DuckDB SQL of what SQL can say of the training-data operators on whole tables: base counts of
personal data and quality rules, shingles of documents, hosts, paths and rules of URLs, sizes, pieces without gaps.
Minima, models, alignments, wrappers and token ids are beyond it; tests hold them against
brute force."""

from __future__ import annotations

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_TEXT = "coalesce(text, '')"

BASE_PII = f"""WITH m AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') AS email,
regexp_extract_all({_TEXT}, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)') AS ip, list_transform(regexp_extract_all({_TEXT}, '[0-9]([\\x20-]?[0-9])+'), lambda c: regexp_replace(c, '[^0-9]', '', 'g')) AS card,
list_transform(regexp_extract_all({_TEXT}, '\\+[0-9][\\x20().0-9-]+[0-9]'), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g'))) AS phone FROM documents)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email, CAST(len(list_filter(ip, lambda i: len(list_filter(string_split(i, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0)) AS BIGINT) AS n_ip,
CAST(len(list_filter(card, lambda c: length(c) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length(c)), lambda k: CASE WHEN k % 2 = 0 THEN CAST(c[length(c) - k] AS INT)
ELSE 2 * CAST(c[length(c) - k] AS INT) - CASE WHEN CAST(c[length(c) - k] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS BIGINT) AS n_card,
CAST(len(list_filter(phone, lambda n: n BETWEEN 8 AND 15)) AS BIGINT) AS n_phone FROM m"""

SHINGLES = f"""WITH w AS (SELECT doc_id, regexp_extract_all(translate({_TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)
SELECT doc_id, CAST(CASE WHEN len(ws) < 2 THEN len(ws) ELSE len(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) END AS BIGINT) AS n_shingles FROM w"""

SHARD_SIZES = f"SELECT doc_id, CAST(strlen({_TEXT}) + 16 AS BIGINT) AS size, true AS even, true AS gapless FROM documents"

URL_RULES = """WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h FROM r),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(coalesce(rest, ''), length(h) + 1), '^[^?#]*') AS path FROM h),
v AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) v(verdict, vhost, vpath))
SELECT page_id, host, path, max_by(vhost || vpath, length(vhost || vpath)) AS rule, max_by(verdict, length(vhost || vpath)) AS by_rule
FROM p LEFT JOIN v ON (host = vhost OR ends_with(host, '.' || vhost)) AND starts_with(path, vpath) GROUP BY page_id, host, path"""

BASE_QUALITY = f"""WITH w AS (SELECT doc_id, row_number() OVER () AS k, {_TEXT} AS text, {_WORDS} AS ws FROM documents),
g AS (SELECT k, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS gram, unnest(range(1, len(ws) - 3)) AS pos FROM w WHERE len(ws) >= 5),
f AS (SELECT k, pos, count(*) OVER (PARTITION BY k, gram) > 1 AS again FROM g),
c AS (SELECT k, count(DISTINCT pos + o) AS n FROM f, (SELECT unnest(range(5)) AS o) WHERE again GROUP BY k),
l AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ws) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(ws) AS base_failed
FROM w LEFT JOIN c USING (k) LEFT JOIN l USING (k)"""

TOKEN_SUMS = "SELECT DISTINCT doc_id, true AS whole, 0::BIGINT AS start FROM documents"


ARCHIVES = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT page_id, first, strlen(html) AS n, list_transform(range(8), lambda i: CAST('0x' || substr(sha1(html), 5 * i + 1, 5) AS INT)) AS v FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> k) % 32 + 1, 1)), '')), '') AS payload_digest,
CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM h"""

FILTER_AUDIT = f"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, {_TEXT} AS text, {_WORDS} AS ws FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
+ CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, x AS filter, bit, coalesce((SELECT sum(y.bit) FROM x y WHERE strpos(filter_order, y.x) < step), 0) AS gone FROM o, (SELECT unnest(range(1, 6)) AS step), x WHERE substr(filter_order, step, 1) = x),
r AS (SELECT part, filter_order, step, filter, sum(CASE WHEN mask & (gone::INT | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & gone::INT = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & gone::INT > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & gone::INT = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & gone::INT = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM s, c GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r"""


# h is the CRC-32 of the decimal id, by its reflected polynomial 0xEDB88320, modulo 4.
PREFIX_TRIE = """WITH t AS (SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words, turn FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS k FROM t),
o AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 20 AS src, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) % 4 AS h FROM k GROUP BY conv_id),
c AS (SELECT o.*, least(o.h, coalesce(s.own, 0)) AS lent FROM o LEFT JOIN o s ON s.conv_id = o.src),
r AS (SELECT c.conv_id, k + 1 AS depth, digest, words FROM c JOIN k ON k.conv_id = c.src AND k < h UNION ALL SELECT conv_id, lent + k - h + 1, digest, words FROM c JOIN k USING (conv_id) WHERE k >= h),
m AS (SELECT conv_id, depth, sha256(string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS p, words FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM m GROUP BY depth, p),
u AS (SELECT n.*, q.conv_id AS parent FROM n LEFT JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1 LEFT JOIN n q ON q.depth = m.depth AND q.p = m.p),
f AS (SELECT depth - 1 AS depth, parent AS conv_id, count(*) AS children FROM u WHERE depth > 0 GROUP BY ALL),
w AS (SELECT u.*, coalesce(children, 0) AS children FROM u LEFT JOIN f USING (depth, conv_id)),
s AS (SELECT m.depth, m.p, sum((w.n - 1) * w.words) AS saved, count(*) FILTER (w.children = 0) AS leaves FROM w JOIN m ON m.conv_id = w.conv_id AND m.depth <= w.depth GROUP BY m.depth, m.p),
e AS (SELECT depth, p, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM m JOIN (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id) USING (conv_id, depth) GROUP BY depth, p)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, w.parent AS parent_conv_id, w.n AS n_convs, w.children AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM w JOIN s USING (depth, p) LEFT JOIN e USING (depth, p)"""


def oracle_sql() -> dict[str, str]:
    return {"shingle_counts": SHINGLES, "base_pii_counts": BASE_PII, "shard_sizes": SHARD_SIZES, "url_rules": URL_RULES, "base_quality_counts": BASE_QUALITY, "token_sums": TOKEN_SUMS, "op11_warc_packages": ARCHIVES, "op12_filter_audit": FILTER_AUDIT, "op13_prefix_trie": PREFIX_TRIE}
