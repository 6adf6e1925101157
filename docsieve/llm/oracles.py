"""SQL counterparts of the operator queries, written from their contracts."""

from __future__ import annotations

from docsieve.llm import licenses

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LINE_DEDUP = f"""
WITH cut AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
    SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM cut
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM line
), frequent AS (
    SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
    SELECT keyed.*, frequent.k IS NOT NULL AND doc_id <> last_doc AS gone FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

TOP_K = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


def _license_scan() -> str:
    known = "map {" + ", ".join(f"{_quoted(s)}: '{i}'" for s, i in licenses.SENTENCES.items()) + "}"
    steps, rest = [], "ids"
    for i, (_, sequence) in enumerate(licenses.RULES):
        source = "seq" if i == 0 else f"step{i - 1}"
        steps.append(
            f"step{i} AS (SELECT *, contains({rest}, '{sequence}') AS hit{i}, replace({rest}, '{sequence}', '-') AS rest{i} FROM {source})"
        )
        rest = f"rest{i}"
    hits = ", ".join(f"CASE WHEN hit{i} THEN {_quoted(name)} END" for i, (name, _) in enumerate(licenses.RULES))
    # The first of equal names keeps its place.
    return rf"""
WITH known AS (SELECT {known} AS m),
cut AS (
    SELECT doc_id, regexp_split_to_array(replace(lower(coalesce(text, '')), chr(13) || chr(10), chr(10)),
        '[.!?]+[\x20\x09-\x0D]+|[.!?]+$|:[\x20\x09]*[\n\r]+|[\n\r][^\n\ra-z0-9]*[\n\r]+') AS sentences FROM documents
),
seq AS (
    SELECT doc_id, coalesce(array_to_string(list_transform(sentences, lambda s: coalesce(
        m[trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))],
        array_to_string(list_transform(regexp_split_to_array(s, '[\n\r]+'),
            lambda l: m[trim(regexp_replace(l, '[^a-z0-9]+', ' ', 'g'))]), '')
    )), ''), '') AS ids FROM cut, known
),
{", ".join(steps)},
named AS (SELECT *, list_filter([{hits}], lambda x: x IS NOT NULL) AS names FROM step{len(licenses.RULES) - 1})
SELECT doc_id, ids AS sentence_ids,
    coalesce(array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ','), '') AS licenses,
    replace({rest}, '-', '') AS unmatched
FROM named
"""


LICENSE_SCAN = _license_scan()

_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

DECONTAMINATE = f"""
WITH item AS (
    SELECT item_id, hash(item_id, text) AS item, {_WORDS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)
), sized AS (
    SELECT *, least(len(w), 5) AS width FROM item WHERE len(w) > 0
), wanted AS (
    SELECT item_id, item, width, unnest(list_distinct(list_transform(
        range(1, len(w) - width + 2), lambda i: array_to_string(list_slice(w, i, i + width - 1), ' ')
    ))) AS shingle FROM sized
), total AS (SELECT item, count(*) AS n FROM wanted GROUP BY item),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
width AS (SELECT DISTINCT width FROM sized),
held AS (
    SELECT DISTINCT doc_id, width, unnest(list_transform(
        range(1, len(w) - width + 2), lambda i: array_to_string(list_slice(w, i, i + width - 1), ' ')
    )) AS shingle FROM doc, width
), counted AS (
    SELECT doc_id, item, any_value(item_id) AS item_id, count(*) AS n_found FROM held JOIN wanted USING (width, shingle) GROUP BY doc_id, item
)
SELECT doc_id, item_id, n AS n_shingles, n_found, round(n_found / n, 6) AS containment
FROM counted JOIN total USING (item) WHERE n_found >= 0.8 * n
"""

# A forward search over whole edit texts. ``way``: role initials that lead from one state of the pattern to another.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE kinds AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
        list_concat([4294967295], list_transform(
            string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
            lambda c: CAST(ord(c) AS BIGINT))),
        lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)),
            lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 20 AS kind
    FROM conversations
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again
    FROM kinds
), ordered AS (
    SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS n
    FROM damaged
), seen AS (
    SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY c, role, text ORDER BY n) AS nth,
        lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY n) AS before,
        regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final
    FROM ordered
), turns AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
        WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM seen
), way(p, r, q) AS (
    VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), lead(p, made, q) AS (
    SELECT unnest([0, 1, 2, 3]), '', unnest([0, 1, 2, 3])
    UNION ALL SELECT p, 'I', q FROM way WHERE r <> 's'
    UNION ALL SELECT a.p, 'II', b.q FROM way a JOIN way b ON a.q = b.p AND a.r <> 's'
), walk(c, n, state, best) AS (
    SELECT DISTINCT c, CAST(0 AS BIGINT), 0, {'cost': CAST(0 AS BIGINT), 'edits': ''} FROM turns
    UNION ALL
    SELECT w.c, w.n + 1, e.q, min({
        'cost': w.best.cost + 2 * length(l.made) + e.cost + CAST(e.edit <> 'D' AND t.fault = 'truncated' AS BIGINT),
        'edits': w.best.edits || l.made || e.edit})
    FROM walk w JOIN lead l ON l.p = w.state JOIN turns t ON t.c = w.c AND t.n = w.n + 1 JOIN (
        SELECT unnest([0, 1, 2, 3]) AS p, 'D' AS edit, CAST(3 AS BIGINT) AS cost, '' AS r, unnest([0, 1, 2, 3]) AS q
        UNION ALL SELECT p, 'K', 0, r, q FROM way
        UNION ALL SELECT p, 'R', 2, r, q FROM way WHERE r <> 's'
    ) e ON e.p = l.q AND (e.edit = 'D' OR t.fault NOT IN ('blank', 'duplicate')) AND (e.edit <> 'K' OR e.r = t.initial)
    GROUP BY w.c, w.n, e.q
), repaired AS (
    SELECT w.c, min({'cost': w.best.cost + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END,
        'edits': w.best.edits || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}) AS best
    FROM walk w JOIN (SELECT c, max(n) AS n FROM turns GROUP BY c) m ON w.c = m.c AND w.n = m.n GROUP BY w.c
), play(c, edits, k, n, state, edit, role, text) AS (
    SELECT c, best.edits, 0, CAST(0 AS BIGINT), 0, 'D', '', '' FROM repaired
    UNION ALL
    SELECT c, edits, k + 1, after, coalesce((SELECT q FROM way WHERE p = state AND r = substr(made, 1, 1)), state), e, made, said
    FROM (
        SELECT y.c, y.edits, y.k, y.state, y.e, y.after,
            CASE y.e WHEN 'D' THEN '' WHEN 'K' THEN t.role ELSE CASE WHEN y.state = 2 THEN 'assistant' ELSE 'user' END END AS made,
            CASE y.e WHEN 'I' THEN '' ELSE t.text END AS said
        FROM (
            SELECT *, substr(edits, k + 1, 1) AS e, n + CAST(substr(edits, k + 1, 1) <> 'I' AS BIGINT) AS after
            FROM play WHERE k < length(edits)
        ) y JOIN turns t ON t.c = y.c AND t.n = greatest(y.after, 1)
    )
), written AS (
    SELECT c, sha256(coalesce(string_agg(role || ':' || text, chr(10) ORDER BY k) FILTER (edit <> 'D'), '')) AS sha FROM play GROUP BY c
), counted AS (
    SELECT c, any_value(conv_id) AS conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM turns GROUP BY c
)
SELECT asked.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
    coalesce(best.edits, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) asked
LEFT JOIN (counted JOIN repaired USING (c) JOIN written USING (c)) ON asked.conv_id IS NOT DISTINCT FROM counted.conv_id
"""
