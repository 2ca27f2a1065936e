"""DuckDB SQL for operators whose results it can compute by plainer means."""

from __future__ import annotations

# Product codes by direct distances to every entry, six rounds written out.
_NEAREST = """a{k} AS MATERIALIZED (
    SELECT r, p, min({{'d': list_sum(list_transform(list_zip(c.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': b.e}}) AS best
    FROM cells c JOIN b{k} b USING (p) GROUP BY r, p)"""
_MOVED = """s{k} AS (
    SELECT p, e, i, (s - ((s % n) + n) % n) // n AS value FROM (
        SELECT a.p, a.best.e AS e, i, sum(c.part[i])::BIGINT AS s, count(*) AS n
        FROM a{k} a JOIN cells c USING (r, p), range(1, 1 + (SELECT max(len(part)) FROM cells)) t(i) GROUP BY ALL)),
b{next} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(m.part, b.part) AS part
    FROM b{k} b LEFT JOIN (SELECT p, e, list(value ORDER BY i) AS part FROM s{k} GROUP BY p, e) m USING (p, e))"""
VECTOR_CODES_SQL = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (SELECT r, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS part FROM kept, range(8) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, part FROM cells WHERE r <= 16),
{", ".join(_NEAREST.format(k=k) + ", " + _MOVED.format(k=k, next=k + 1) for k in range(6))},
{_NEAREST.format(k=6)},
codes AS (
    SELECT r, string_agg(lpad(printf('%x', best.e), 2, '0'), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a6 GROUP BY r),
digest AS (
    SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN codes USING (r), digest
"""

# Least-cost repair message by message: cheapest (cost, audit) of every state, strings carried along.
CONVERSATIONS_SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS steps),
marked AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
        list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS fault
    FROM conversations, crc),
damaged AS (
    SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM marked WHERE fault <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged),
judged AS (
    SELECT *, substr(role, 1, 1) AS initial, lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS following,
           CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM placed),
told AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) AS n,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id),
inserted(state, target, name) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
paths AS (
    SELECT state, state AS mid, '' AS letters, 0 AS cost, []::VARCHAR[] AS lines FROM inserted
    UNION ALL SELECT state, target, 'I', 2, [name || ':'] FROM inserted
    UNION ALL SELECT a.state, b.target, 'II', 4, [a.name || ':', b.name || ':'] FROM inserted a JOIN inserted b ON a.target = b.state),
kept(state, initial, target) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
moves AS (
    SELECT conv_id, pos, i.state AS mid, i.state AS target, 'D' AS letter, 3 AS cost, []::VARCHAR[] AS lines FROM judged, inserted i
    UNION ALL SELECT conv_id, pos, k.state, k.target, 'K', (fault = 'truncated')::INTEGER, [role || ':' || text]
    FROM judged j JOIN kept k USING (initial) WHERE fault NOT IN ('blank', 'duplicate')
    UNION ALL SELECT conv_id, pos, i.state, i.target, 'R', 2 + (fault = 'truncated')::INTEGER, [i.name || ':' || text]
    FROM judged, inserted i WHERE fault NOT IN ('blank', 'duplicate')),
best AS (
    SELECT conv_id, n, 0::BIGINT AS pos, 0 AS state, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS made FROM told
    UNION ALL
    SELECT b.conv_id, b.n, m.pos, m.target, min({'cost': b.made.cost + p.cost + m.cost, 'audit': b.made.audit || p.letters || m.letter,
           'lines': b.made.lines || p.lines || m.lines})
    FROM best b JOIN paths p ON p.state = b.state JOIN moves m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.pos = b.pos + 1 AND m.mid = p.mid
    GROUP BY b.conv_id, b.n, m.pos, m.target),
repaired AS (
    SELECT b.conv_id, min({'cost': b.made.cost + p.cost, 'audit': b.made.audit || p.letters, 'lines': b.made.lines || p.lines}) AS made
    FROM best b JOIN paths p ON p.state = b.state AND p.mid IN (0, 3) WHERE b.pos = b.n GROUP BY b.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(made.cost, 0)::BIGINT AS cost, coalesce(made.audit, '') AS audit,
       sha256(coalesce(array_to_string(made.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
