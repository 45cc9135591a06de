"""DuckDB SQL for the queries that SQL can state."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# base 32 from the hexadecimal SHA-1: five hex digits are four characters
_B32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::INT >> ((3 - i % 4) * 5)::INT) & 31) + 1, 1)), '')"""

# CRC-32 four bits at a time: its polynomial, and what four bits do to a remainder
_POLYNOMIAL = 0xEDB88320


def _four_bits(value: int) -> int:
    for _ in range(4):
        value = value >> 1 ^ (_POLYNOMIAL if value & 1 else 0)
    return value


_CRC_STEPS = str([_four_bits(i) for i in range(16)])
# the UTF-8 bytes of `name` (ASCII and U+00C0 to U+00FF), as halves, lower half first
_HALVES = """flatten(list_transform(string_split(name, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c) & 15, unicode(c) >> 4]
             ELSE [3, 12, (unicode(c) - 64) & 15, (unicode(c) - 64) >> 4] END))"""
_CRC = f"""xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {_HALVES}::BIGINT[]),
           lambda r, b: xor(r >> 4, ({_CRC_STEPS}::BIGINT[])[(xor(r, b) & 15) + 1])))"""

ORACLES = {
    "op11_spelling": f"""
        WITH RECURSIVE runs AS (
            SELECT d, run, count(*) AS c FROM (
                SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents)
            WHERE length(run) >= 5 GROUP BY d, run),
        drawn AS (SELECT run, c, {_CRC} AS h FROM (SELECT run, c, d || ':' || run AS name FROM runs)),
        words AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(c)::BIGINT AS n
            FROM drawn GROUP BY 1 HAVING length(word) >= 5 AND n >= 3),
        gaps AS (
            SELECT word, n, substr(word, 1, i) || '_' || substr(word, i + 2) AS marked, substr(word, 1, i) || substr(word, i + 2) AS less
            FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
        shorter AS (SELECT DISTINCT g.word, g.n, w.word AS other, w.n AS other_n FROM gaps g JOIN words w ON g.less = w.word),
        near AS (
            SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.marked = b.marked AND a.word <> b.word
            UNION ALL SELECT word, other, other_n FROM shorter
            UNION ALL SELECT other, word, n FROM shorter),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
        forms AS (
            SELECT word, CASE WHEN other_n >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
            FROM words LEFT JOIN best USING (word)),
        chain AS (
            SELECT word, word AS reached, form AS further FROM forms
            UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.further = f.word)
        SELECT f.word, f.form, c.reached AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON f.word = c.word AND c.further IS NULL""",
    "op2_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS body FROM documents),
        g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size, sha256(body) AS text_sha256 FROM t GROUP BY body)
        SELECT doc_id, keep_id, group_size,
               doc_id IS NOT DISTINCT FROM keep_id AND row_number() OVER (PARTITION BY doc_id, body) = 1 AS kept, text_sha256
        FROM t JOIN g USING (body)""",
    "op5_warc": f"""
        WITH t AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        g AS (SELECT payload, max(page_id) AS first_id, count(*) AS of, sha1(payload) AS hex FROM t GROUP BY payload),
        d AS (SELECT payload, first_id, strlen(payload) AS payload_bytes, {_B32} AS payload_digest FROM g),
        r AS (SELECT page_id, payload_bytes, payload_digest, first_id,
                     page_id IS NOT DISTINCT FROM first_id AND row_number() OVER (PARTITION BY page_id, payload) = 1 AS is_first
              FROM t JOIN d USING (payload))
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN is_first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN NOT is_first THEN first_id END AS refers_to FROM r""",
    "op6_url_filters": r"""
        WITH rules(action, host, path) AS (
            VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                   ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        cut AS (SELECT row_number() OVER () AS n, page_id,
                       CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
        parts AS (SELECT n, page_id,
                         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        fits AS (SELECT p.n, r.host || r.path AS rule, r.action FROM parts p JOIN rules r
                 ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
        best AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM fits GROUP BY n)
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN best USING (n)""",
}
