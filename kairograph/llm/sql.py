"""DuckDB SQL for the queries of the training-data operators that SQL can express."""

from __future__ import annotations

from kairograph.llm.licenses import COMMENT, LOWER, NOISE, RULES, SENTENCE_END, SENTENCES, UPPER, WRAPPED
from kairograph.llm.sharding import JUMP_MULTIPLIER, MIX_FACTOR, MIX_MODULUS

OP2 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, item, i, windows.n FROM spots JOIN windows USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_CRC_TABLE: list[int] = []
for _n in range(256):
    for _ in range(8):
        _n = _n >> 1 ^ (0xEDB88320 if _n & 1 else 0)
    _CRC_TABLE.append(_n)


def crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a VARCHAR expression, as BIGINT."""
    pairs = f"string_split(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g'), ' ')"
    byte = f"list_transform(list_filter({pairs}, lambda h: h <> ''), lambda h: ('0x' || h)::BIGINT)"
    return (
        f"xor(list_reduce(list_concat([4294967295::BIGINT], {byte}), "
        f"lambda c, b: xor(c >> 8, ({_CRC_TABLE}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"
    )


def _jump(shards: int) -> str:
    return f"""(
  WITH RECURSIVE steps(doc_key, k, b, j) AS (
    SELECT doc_key, CASE WHEN doc_key < 0 THEN doc_key::HUGEINT + 18446744073709551616 ELSE doc_key::HUGEINT END, -1::BIGINT, 0::BIGINT
    FROM (SELECT DISTINCT coalesce(doc_id, 0) AS doc_key FROM documents)
    UNION ALL
    SELECT doc_key, n, j, floor((j + 1) * (2147483648.0::DOUBLE / ((n >> 33)::DOUBLE + 1.0)))::BIGINT
    FROM (SELECT doc_key, j, (k * {JUMP_MULTIPLIER}::HUGEINT + 1) % 18446744073709551616 AS n FROM steps WHERE j < {shards})
  ) SELECT doc_key, max(b)::INTEGER AS shard FROM steps WHERE j >= {shards} GROUP BY 1)"""


OP8 = f"""
WITH sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, coalesce({crc32_sql("nullif(text, '')")}, 0)::BIGINT AS text_crc32
  FROM documents
), dealt AS (
  SELECT sized.*, a.shard, g.shard AS grown_shard,
    ((((coalesce(doc_id, 0) % {MIX_MODULUS} + {MIX_MODULUS}) % {MIX_MODULUS}) * {MIX_FACTOR} + size) % {MIX_MODULUS}) % 1024 AS bucket
  FROM sized JOIN {_jump(16)} a ON a.doc_key = coalesce(doc_id, 0) JOIN {_jump(17)} g ON g.doc_key = coalesce(doc_id, 0)
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM dealt
"""

OP9 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place
  FROM documents
), sources AS (SELECT source, sum(size)::DOUBLE AS source_size FROM sized GROUP BY 1),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank,
    [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0 AS most
  FROM sources
), levels AS (
  SELECT *, most / weight AS reach, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY most / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), targets AS (
  SELECT source, source_rank, source_size, budget, coalesce(least(most, weight * (SELECT arg_min(level, (reach, source_rank)) FROM levels WHERE level <= reach)), most) AS target
  FROM levels
), queue AS (
  SELECT doc_id, size, place, targets.*, sum(size) OVER (PARTITION BY source_rank ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS done
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), passes AS (
  SELECT *, CASE WHEN size > 0 THEN (epoch * source_size + done) / target ELSE 0 END AS finish FROM queue, (VALUES (0), (1)) e(epoch)
), spent AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_rank, epoch, place, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM passes
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, sum(CASE WHEN total <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM spent GROUP BY doc_id, size, source_size, target
"""




def _op1() -> str:
    known = ", ".join(f"('{ident}', '{sentence}')" for ident, sentence in SENTENCES)
    steps, got = [], []
    for k, (licence, sequence) in enumerate(RULES):
        wanted = "".join(f",{x}," for x in sequence)
        got.append(f"CASE WHEN contains(s{k}, '{wanted}') THEN '{licence}' END")
        steps.append(f"replace(s{k}, '{wanted}', ',+,') AS s{k + 1}")
    chain = "SELECT * FROM seq"
    for step in steps:
        chain = f"SELECT *, {step} FROM ({chain})"
    return f"""
WITH known(ident, sentence) AS (VALUES {known}),
parts AS (
  SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(text, '{COMMENT}', chr(10), 'g'), '{WRAPPED}', '\\1 \\2', 'g'), '{SENTENCE_END}') AS p
  FROM documents
), each AS (
  SELECT doc_id, i, trim(regexp_replace(translate(p[i], '{UPPER}', '{LOWER}'), '{NOISE}', ' ', 'g')) AS sentence
  FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts)
), found AS (
  SELECT doc_id, i, coalesce(ident, '-') AS ident FROM each LEFT JOIN known USING (sentence) WHERE sentence <> ''
), grouped AS (
  SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (ident <> '-') AS n_known,
    string_agg(ident, ',' ORDER BY i) FILTER (ident <> '-') AS ids, string_agg(',' || ident || ',', '' ORDER BY i) AS s0
  FROM found GROUP BY 1
), seq AS (
  SELECT doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_known, 0)::BIGINT AS n_known, coalesce(ids, '') AS sentence_ids, coalesce(s0, '') AS s0
  FROM documents LEFT JOIN grouped USING (doc_id)
)
SELECT doc_id, n_sentences, n_known, sentence_ids,
  array_to_string(list_filter([{", ".join(got)}], lambda x, k: x IS NOT NULL AND list_position([{", ".join(got)}], x) = k), ',') AS licenses,
  n_known > 0 AND regexp_replace(s{len(RULES)}, '[-+,]', '', 'g') <> '' AS unmatched
FROM ({chain})
"""


OP1 = _op1()

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP10 = """
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
windows AS (
  SELECT doc_id, i, l[i:i + 2] AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM lines WHERE len(l) >= 3)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), covered AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM later),
runs AS (SELECT doc_id, count(*) AS n_removed, list(i) AS cut, count(DISTINCT i - r) AS n_spans FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM covered) GROUP BY 1)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  CASE WHEN cut IS NULL THEN text ELSE coalesce(array_to_string(list_filter(l, lambda x, k: NOT list_contains(cut, k)), chr(10)), '') END AS text
FROM lines LEFT JOIN runs USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": OP1, "op2_decontamination": OP2, "op4_topk": OP4, "op8_sharding": OP8, "op9_mixing": OP9, "op10_line_dedup": OP10}
