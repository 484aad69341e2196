"""The queries of this folder in DuckDB's SQL, where SQL can state them."""

_USABLE = """
    SELECT vec_id AS id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    GROUP BY vec_id
"""

_TOP_K = f"""
WITH usable AS ({_USABLE}),
whole AS (SELECT id, list_transform(v, lambda x: floor(64 * x)) AS v FROM usable),
scored AS (
    SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.id % 20 = 0 AND c.id <> q.id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 20
"""

_NEAREST = f"""
WITH usable AS ({_USABLE}),
whole AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS norm FROM usable WHERE list_dot_product(v, v) > 0),
scored AS (
    SELECT q.id AS query_id, c.id AS vec_id, list_dot_product(q.v, c.v) / (q.norm * c.norm) AS score
    FROM whole q JOIN whole c ON q.id % 50 = 0 AND c.id <> q.id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5
"""

_WORDS = r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)"


def mixing(documents: str) -> str:
    """Rows of the mix over a relation, without its final columns: every document with its two finish times."""
    return f"""
sized AS (
    SELECT *, {_WORDS} AS size,
        CAST('0x' || substr(md5('mix0|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key,
        md5(coalesce(text, '')) AS tie
    FROM {documents}
),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM sized GROUP BY source
),
rooms AS (
    SELECT *, 2 * source_size / CAST(weight AS DOUBLE) AS room, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM sources
),
levels AS (
    SELECT *, (budget - coalesce(sum(2 * source_size) OVER earlier, 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
    FROM rooms
    WINDOW earlier AS (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
targets AS (
    SELECT source, source_size, budget, CASE WHEN budget >= sum(2 * source_size) OVER () THEN 2 * source_size
        ELSE least(CAST(2 * source_size AS DOUBLE), max(level) OVER () * weight) END AS target
    FROM levels
),
queued AS (
    SELECT s.*, t.source_size, t.target, t.budget,
        sum(s.size) OVER (PARTITION BY s.source ORDER BY key, doc_id NULLS FIRST, tie ROWS UNBOUNDED PRECEDING) AS upto
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
),
copies AS (
    SELECT *, coalesce((copy * source_size + upto) / nullif(target, 0), 0) AS finish
    FROM queued, (VALUES (0), (1)) AS c(copy)
),
chosen AS (
    SELECT *, sum(size) OVER (ORDER BY finish, copy, key, doc_id NULLS FIRST, tie ROWS UNBOUNDED PRECEDING) <= budget AS in_mix
    FROM copies
)"""


_MIXING = f"""
WITH {mixing('documents')}
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN in_mix THEN size ELSE 0 END) AS BIGINT) AS taken,
    CAST(count(*) FILTER (WHERE in_mix) AS INTEGER) AS copies
FROM chosen GROUP BY doc_id, size, source_size, target, key, tie
"""

_WARC = """
WITH payloads AS (
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
        sha256(coalesce(html, '')) AS key
    FROM pages
)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN page_id IS DISTINCT FROM min(page_id) OVER same AND min(page_id) OVER same IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to
FROM payloads WINDOW same AS (PARTITION BY key)
"""

# CRC-32 byte by byte, with the usual table made from its polynomial
_CRC_TABLE = """list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1
    THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(i AS BIGINT)))"""
_CRC = """CASE WHEN text = '' THEN 0 ELSE xor(list_reduce(
    list_transform(range(octet_length(encode(text))), lambda i: CAST('0x' || substr(hex(encode(text)), 2 * i + 1, 2) AS BIGINT)),
    lambda a, b: xor(a >> 8, bytes[CAST((xor(a, b) & 255) + 1 AS BIGINT)]), CAST(4294967295 AS BIGINT)), 4294967295) END"""

_SHARDING = f"""
WITH RECURSIVE table_of AS (SELECT {_CRC_TABLE} AS bytes),
placed AS (
    SELECT doc_id, coalesce(text, '') AS text, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 8) AS BIGINT) % 4096 AS virtual_slot,
        CAST((SELECT {_CRC} FROM (SELECT coalesce(d.text, '') AS text), table_of) AS BIGINT) AS text_crc32
    FROM documents d
),
slots AS (SELECT virtual_slot, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS rows FROM placed GROUP BY virtual_slot),
ranked AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS n FROM slots),
dealt AS (
    SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS shard, list_transform(range(40), lambda i: CAST(0 AS BIGINT)) AS loads
    UNION ALL
    SELECT r.n, list_position(d.loads, list_min(d.loads)) - 1,
        list_transform(d.loads, lambda x, i: x + CASE WHEN i = list_position(d.loads, list_min(d.loads)) THEN r.bytes ELSE 0 END)
    FROM dealt d JOIN ranked r ON r.n = d.n + 1
),
places AS (
    SELECT r.virtual_slot, CAST(d.shard AS INTEGER) AS shard,
        coalesce(sum(r.rows) OVER (PARTITION BY d.shard ORDER BY r.virtual_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_row
    FROM ranked r JOIN dealt d USING (n)
)
SELECT doc_id, size, shard, 'bytes' AS law, CAST(NULL AS INTEGER) AS grown_shard, virtual_slot, text_crc32,
    CAST(first_row + row_number() OVER (PARTITION BY virtual_slot ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot
FROM placed JOIN places USING (virtual_slot)
"""

_NEGATIVES = """
WITH usable AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
scored AS (
    SELECT a.id AS anchor_id, c.id AS id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
    FROM usable a JOIN usable c ON a.id % 100 = 0 AND c.id <> a.id AND len(a.v) = len(c.v)
),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, id AS negative_id, positive_score,
    score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER best <= 10
"""

ORACLES = {
    "op2_warc": _WARC,
    "op1_exact_top_k": _TOP_K,
    "op3_source_mixing": _MIXING,
    "op4_sharding": _SHARDING,
    "op5_nearest_neighbours": _NEAREST,
    "op11_hard_negatives": _NEGATIVES,
}
