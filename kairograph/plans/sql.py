"""DuckDB SQL for the queries of the ledger's operators."""

from __future__ import annotations

from kairograph.plans.queries import ANCHOR, CORE, INSTANT, LINK_CUTOFF, LOG_CUTOFF

OPEN = "TIMESTAMP '9999-12-31 23:59:59.999999'"


def _at(text: str) -> str:
    return f"TIMESTAMP '{text[:-1].replace('T', ' ')}'"


def _text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%fZ')"


LOG = "log AS (SELECT event_id + 1 AS seq_id, 'u:' || user_id AS entity_id, event_type AS title, props AS content, event_type = 'error' AS retired, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'I' ELSE 'U' END AS operation, ts AS recorded_at FROM events)"
INTERVALS = f"intervals AS (SELECT 'u:' || user_id AS source_id, 'e:' || event_type AS target_id, upper(regexp_replace(event_type, '[^A-Za-z0-9]', '', 'g')) AS edge_type, ts AS valid_from, coalesce(lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), {OPEN}) AS valid_to FROM events)"
ASSERTIONS = f"assertions AS (SELECT 's' || l_suppkey AS source_id, 'p' || l_partkey AS target_id, l_quantity AS weight, l_shipdate::TIMESTAMP + to_microseconds(l_orderkey) AS recorded_at, CASE WHEN l_returnflag = 'R' THEN TIMESTAMP '1998-01-01' ELSE {OPEN} END AS valid_to FROM lineitem)"
LATEST = ASSERTIONS + ", latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY recorded_at DESC) AS n FROM assertions) WHERE n = 1)"
SUPPLY = "supply AS (SELECT 's' || l_suppkey AS source_id, 'p' || l_partkey AS target_id, max(l_quantity) AS weight FROM lineitem GROUP BY 1, 2), both_ways AS (SELECT *, 'SUPPLIES' AS edge_type FROM supply UNION ALL SELECT target_id, source_id, weight, 'SUPPLIEDBY' FROM supply)"
CONCEPTS = "concepts AS (SELECT 's' || s_suppkey AS id, s_name AS title, s_acctbal < 0 AS retired FROM supplier UNION ALL SELECT 'p' || p_partkey, p_name, p_size = 13 FROM part)"
ALL_CONCEPTS = CONCEPTS + ", everyone AS (SELECT * FROM concepts UNION ALL SELECT 'c' || c_custkey, c_name, c_acctbal < 0 FROM customer)"
PLACES = "places AS (SELECT 'r' || n_regionkey AS source_id, 'n' || n_nationkey AS target_id, 'HASNATION' AS edge_type, 1.0::DOUBLE AS weight FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'HASCUSTOMER', 0.5 FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'HASORDER', 0.25 FROM orders)"
DOCS = "docs AS (SELECT d.doc_id AS id, source AS title, text AS content, t.doc_id IS NOT NULL AS retired FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) t ON t.doc_id = d.doc_id)"
RING = "ring AS (SELECT 'o' || lpad(o_orderkey::VARCHAR, 9, '0') AS id, 'o' || lpad((min(o_orderkey) OVER (PARTITION BY o_custkey))::VARCHAR, 9, '0') AS first FROM orders)"


def _fold(ts: str) -> str:
    return f"fold AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq_id DESC) AS n FROM log WHERE recorded_at <= {_at(ts)}) WHERE n = 1)"


def _cosine(a: str, b: str) -> str:
    return f"(1 - list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_inner_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_inner_product({b}::DOUBLE[], {b}::DOUBLE[]))))"


def _near(vec_id: int, depth: int, name: str) -> str:
    d = _cosine("e.embedding", "q.embedding")
    return f"{name} AS (SELECT e.vec_id AS id, {d} AS score, row_number() OVER (ORDER BY {d}, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {vec_id}) q ORDER BY rank LIMIT {depth})"


def _bm25(words: list[str], depth: int) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""{DOCS}, toks AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(title, '') || ' ' || coalesce(content, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM docs),
stats AS (SELECT count(*)::DOUBLE AS n, sum(len(t))::DOUBLE / count(*) AS mean FROM toks),
tf AS (SELECT id, len(t) AS length, term, count(*)::DOUBLE AS tf FROM (SELECT id, t, unnest(t) AS term FROM toks) WHERE term IN ({listed}) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
scored AS (SELECT id, -sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))) AS score FROM tf JOIN df USING (term), stats GROUP BY id HAVING count(*) = {len(words)}),
words AS (SELECT id, score, row_number() OVER (ORDER BY score, id) AS rank FROM scored WHERE id IN (SELECT id FROM docs WHERE NOT retired) ORDER BY rank LIMIT {depth})"""


def _walk(start: str, depth: int, condition: str) -> str:
    return f"walk AS (SELECT '{start}' AS id, 0 AS depth UNION SELECT e.target_id, w.depth + 1 FROM walk w JOIN both_ways e ON e.source_id = w.id WHERE w.depth < {depth} AND {condition})"


def _core(rounds: int) -> str:
    """Nodes with few edge ends go, round by round; after so many rounds none is left to go at the sizes that are compared."""
    parts = [SUPPLY, "e0 AS (SELECT source_id, target_id FROM supply)"]
    for k in range(rounds):
        parts.append(f"n{k} AS MATERIALIZED (SELECT id FROM (SELECT source_id AS id FROM e{k} UNION ALL SELECT target_id FROM e{k}) GROUP BY id HAVING count(*) >= {CORE})")
        parts.append(f"e{k + 1} AS MATERIALIZED (SELECT * FROM e{k} WHERE source_id IN (SELECT id FROM n{k}) AND target_id IN (SELECT id FROM n{k}))")
    return f"WITH {', '.join(parts)} SELECT id FROM n{rounds - 1}"


_FILTERED = f"SELECT e.vec_id::VARCHAR AS concept_id, round({_cosine('e.embedding', 'q.embedding')}, 6) + 0.0 AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE e.label IN (1, 2) ORDER BY {_cosine('e.embedding', 'q.embedding')}, concept_id LIMIT 10"

SQL: dict[str, str] = {
    "t01_as_of_edges": f"WITH {INTERVALS} SELECT source_id, target_id, edge_type, {_text('valid_from')} AS valid_from, {_text('valid_to')} AS valid_to FROM intervals WHERE valid_from <= {_at(INSTANT)} AND {_at(INSTANT)} < valid_to",
    "p01_valid_time_stab": f"WITH {INTERVALS} SELECT edge_type, count(*) FILTER (valid_from <= {_at(INSTANT)} AND {_at(INSTANT)} < valid_to) AS valid, count(*) AS all_rows FROM intervals GROUP BY 1",
    "p02_interval_overlap": f"WITH {INTERVALS} SELECT edge_type, count(*) AS n, count(*) FILTER (valid_to = {OPEN}) AS open_rows FROM intervals WHERE greatest(valid_from, TIMESTAMP '2024-01-05') < least(valid_to, TIMESTAMP '2024-01-06') GROUP BY 1",
    "p03_p04_edge_filter": f"WITH {PLACES} SELECT edge_type, count(*) AS n, min(weight) AS least FROM places WHERE weight >= 0.5 AND edge_type IN ('HASNATION', 'HASCUSTOMER') GROUP BY 1",
    "p05_retired_filter": f"WITH {CONCEPTS} SELECT id, title FROM concepts WHERE NOT retired",
    "p06_f01_canonical_timestamps": f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN {_text('ts')} WHEN 1 THEN {_text("date_trunc('second', ts)")} END AS canonical, event_id % 4 < 2 AS valid FROM events",
    "p07_p08_p09_validation": "SELECT l_linenumber, l_linestatus, count(*) FILTER (l_linenumber > 3 AND l_quantity >= 0 OR l_linenumber < 1)::BIGINT AS weights, count(*) FILTER (l_linestatus <> 'O')::BIGINT AS types, count(*) FILTER (l_linenumber NOT IN (4, 5))::BIGINT AS ids FROM lineitem GROUP BY 1, 2",
    "p11_column_pruning": f"WITH {DOCS} SELECT id, title FROM docs WHERE NOT retired",
    "p12_hydrate_current": f"WITH {LOG}, fold AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq_id DESC) AS n FROM log) WHERE n = 1) SELECT entity_id AS id, title, content FROM fold WHERE NOT retired AND entity_id IN (SELECT 'u:' || user_id FROM events WHERE event_type = 'purchase')",
    "p13_hydrate_at_time": f"WITH {LOG}, {_fold(ANCHOR)} SELECT entity_id AS id, title, content FROM fold WHERE NOT retired",
    "p14_hydrate_omit": f"WITH {CONCEPTS} SELECT id, title FROM concepts WHERE false",
    "j05_superseded_assertions": f"WITH {ASSERTIONS} SELECT source_id, count(*) AS superseded FROM assertions a WHERE EXISTS (SELECT 1 FROM assertions b WHERE b.source_id = a.source_id AND b.target_id = a.target_id AND b.recorded_at > a.recorded_at) GROUP BY 1",
    "j06_unnamed_concepts": f"WITH {SUPPLY}, {ALL_CONCEPTS} SELECT id FROM everyone WHERE NOT EXISTS (SELECT 1 FROM supply WHERE source_id = id OR target_id = id)",
    "j10_overlapping_intervals": f"WITH {INTERVALS}, i AS (SELECT source_id, target_id, valid_from, valid_from + INTERVAL 2 DAY AS valid_to FROM intervals) SELECT a.source_id, a.target_id, {_text('a.valid_from')} AS valid_from, {_text('b.valid_from')} AS other_from FROM i a JOIN i b ON a.source_id = b.source_id AND a.target_id = b.target_id AND a.valid_from <> b.valid_from AND greatest(a.valid_from, b.valid_from) < least(a.valid_to, b.valid_to)",
    "j11_as_of_join": f"WITH {INTERVALS}, days AS (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS t FROM events UNION ALL SELECT TIMESTAMP '2300-01-01') SELECT {_text('t')} AS ts, count(*) AS edges FROM days JOIN intervals ON valid_from <= t AND t < valid_to GROUP BY 1",
    "a01_corpus_counts": f"WITH {CONCEPTS} SELECT retired, count(*) AS n FROM concepts GROUP BY 1",
    "a02_log_bounds": f"WITH {LOG} SELECT count(*) AS n, min(seq_id) AS first_seq, max(seq_id) AS last_seq, {_text('min(recorded_at)')} AS first_at, {_text('max(recorded_at)')} AS last_at FROM log",
    "a03_clock_floor": f"WITH {ASSERTIONS} SELECT {_text('max(t)')} AS floor FROM (SELECT recorded_at AS t FROM assertions UNION ALL SELECT TIMESTAMP '1995-01-01')",
    "a04_degrees": f"WITH {SUPPLY}, {CONCEPTS}, ends AS (SELECT source_id AS id, weight FROM supply UNION ALL SELECT target_id, weight FROM supply) SELECT id, count(weight) AS degree, coalesce(sum(weight), 0)::DOUBLE AS weighted_degree FROM concepts LEFT JOIN ends USING (id) GROUP BY 1",
    "a06_t02_latest_belief": f"WITH {LATEST} SELECT source_id, target_id, weight, {_text('recorded_at')} AS recorded_at, {_text('valid_to')} AS valid_to FROM latest",
    "a08_log_head": f"WITH {LOG} SELECT max(seq_id) AS seq, count(*) AS since, {_text('max(recorded_at)')} AS at FROM log WHERE seq_id > 100",
    "w01_newest_log_rows": f"WITH {LOG} SELECT entity_id, max(seq_id) AS seq_id, arg_max(operation, seq_id) AS operation FROM log GROUP BY 1",
    "t03_reconstruct_concepts": f"WITH {LOG}, {_fold(INSTANT)} SELECT entity_id AS id, title, content FROM fold WHERE NOT retired",
    "t03_reconstruct_edges": f"WITH {ASSERTIONS}, f AS (SELECT source_id, target_id, arg_max(valid_to, recorded_at) AS valid_to FROM assertions WHERE recorded_at <= {_at(LINK_CUTOFF)} GROUP BY 1, 2) SELECT source_id, target_id, 'SUPPLIES' AS edge_type, '1995-01-01T00:00:00.000000Z' AS valid_from, {_text('valid_to')} AS valid_to FROM f",
    "t04_anchored_fold": f"WITH {LOG}, {_fold(INSTANT)} SELECT entity_id AS id, title, content FROM fold WHERE NOT retired",
    "t05_cold_fold": f"WITH {LOG}, {_fold(ANCHOR)} SELECT entity_id AS id, title, content FROM fold WHERE NOT retired",
    "t06_reach": "SELECT * FROM (VALUES ('all', '2020-01-01T00:00:00.000000Z', false, 'predates_recorded_history'), ('all', '2020-01-01T00:00:00.000000Z', true, 'needs_archive'), ('all', '2030-01-01T00:00:00.000000Z', false, 'covers'), ('all', '2030-01-01T00:00:00.000000Z', true, 'covers'), ('late', '2020-01-01T00:00:00.000000Z', false, 'needs_archive'), ('late', '2020-01-01T00:00:00.000000Z', true, 'needs_archive'), ('late', '2030-01-01T00:00:00.000000Z', false, 'covers'), ('late', '2030-01-01T00:00:00.000000Z', true, 'covers'), ('none', '2020-01-01T00:00:00.000000Z', false, 'predates_recorded_history'), ('none', '2020-01-01T00:00:00.000000Z', true, 'needs_archive'), ('none', '2030-01-01T00:00:00.000000Z', false, 'predates_recorded_history'), ('none', '2030-01-01T00:00:00.000000Z', true, 'needs_archive')) t(log, ts, has_cold, reach)",
    "t07_log_intact": f"WITH {LOG} SELECT count(*) = 0 OR (min(seq_id) = 1 AND count(*) = max(seq_id)) AS intact, max(seq_id) - count(*) AS removed FROM log",
    "t10_chain_difference": f"WITH {LOG}, {_fold(ANCHOR)}, a AS (SELECT entity_id, title, content FROM fold WHERE NOT retired), {_fold(INSTANT).replace('fold AS', 'later AS')}, b AS (SELECT entity_id, title, content FROM later WHERE NOT retired) SELECT 'concept' AS kind, side, count(*) AS n FROM (SELECT 'composed' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'folded' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) GROUP BY 1, 2",
    "t14_links_archivable": f"WITH {ASSERTIONS} SELECT source_id, target_id, {_text('recorded_at')} AS recorded_at FROM assertions a WHERE recorded_at < {_at(LINK_CUTOFF)} AND (valid_to <= {_at(LINK_CUTOFF)} OR EXISTS (SELECT 1 FROM assertions b WHERE b.source_id = a.source_id AND b.target_id = a.target_id AND b.recorded_at > a.recorded_at))",
    "t15_log_archivable": f"WITH {LOG} SELECT seq_id, entity_id FROM log a WHERE recorded_at < {_at(LOG_CUTOFF)} AND EXISTS (SELECT 1 FROM log b WHERE b.entity_id = a.entity_id AND b.seq_id > a.seq_id)",
    "t16_concepts_archivable": f"WITH {ASSERTIONS}, {ALL_CONCEPTS} SELECT id FROM everyone WHERE retired AND id NOT IN (SELECT source_id FROM assertions UNION SELECT target_id FROM assertions)",
    "t18_archive_windows": f"WITH {LOG}, g AS (SELECT recorded_at FROM log a WHERE recorded_at < {_at(LOG_CUTOFF)} AND EXISTS (SELECT 1 FROM log b WHERE b.entity_id = a.entity_id AND b.seq_id > a.seq_id)) SELECT (CASE WHEN recorded_at >= TIMESTAMP '2024-01-05' THEN 1 ELSE 0 END + CASE WHEN recorded_at >= TIMESTAMP '2024-01-09' THEN 1 ELSE 0 END + CASE WHEN recorded_at >= TIMESTAMP '2024-01-13' THEN 1 ELSE 0 END + CASE WHEN recorded_at >= TIMESTAMP '2024-01-17' THEN 1 ELSE 0 END)::INTEGER AS session, count(*) AS n FROM g GROUP BY 1",
    "u03_current_drift": f"WITH {LATEST}, t AS (SELECT source_id, target_id, valid_to, weight, recorded_at FROM latest), s AS (SELECT source_id, target_id, valid_to, CASE WHEN weight > 45 THEN 0 ELSE weight END AS weight, recorded_at FROM latest WHERE weight > 3) SELECT (SELECT count(*) FROM (SELECT * FROM s EXCEPT SELECT * FROM t)) + (SELECT count(*) FROM (SELECT * FROM t EXCEPT SELECT * FROM s)) AS drift",
    "g01_walk": f"WITH RECURSIVE {SUPPLY}, {_walk('s1', 3, 'e.weight >= 30')} SELECT id, min(depth)::INTEGER AS depth FROM walk GROUP BY 1",
    "g02_traverse_ids": f"WITH RECURSIVE {SUPPLY}, {CONCEPTS}, {_walk('s1', 2, 'e.weight >= 49')} SELECT DISTINCT id FROM walk JOIN concepts USING (id) WHERE NOT retired",
    "g03_traverse": f"WITH RECURSIVE {SUPPLY}, {CONCEPTS}, {_walk('s2', 2, 'e.weight >= 49')} SELECT DISTINCT id, title FROM walk JOIN concepts USING (id) WHERE NOT retired",
    "g05_subgraph": f"WITH RECURSIVE {SUPPLY}, {CONCEPTS}, {_walk('s3', 1, 'e.weight >= 45')} SELECT source_id, target_id, edge_type, weight FROM both_ways WHERE weight >= 45 AND source_id IN (SELECT id FROM walk) AND source_id IN (SELECT id FROM concepts WHERE NOT retired) AND target_id IN (SELECT id FROM concepts WHERE NOT retired)",
    "g08_closed_edges": f"WITH {SUPPLY}, {CONCEPTS} SELECT source_id, count(*) AS edges FROM supply WHERE source_id IN (SELECT id FROM concepts WHERE NOT retired) AND target_id IN (SELECT id FROM concepts WHERE NOT retired) GROUP BY 1",
    "g09_out_edges": f"WITH {SUPPLY} SELECT target_id, weight FROM supply WHERE source_id = 's7'",
    "g10_dijkstra": f"WITH RECURSIVE {PLACES}, d AS (SELECT 'r1' AS id, 0.0::DOUBLE AS distance UNION ALL SELECT target_id, distance + weight FROM d JOIN places ON source_id = id) SELECT id, min(distance) AS distance FROM d GROUP BY 1",
    "g10_dijkstra_cyclic": f"WITH RECURSIVE {SUPPLY}, d(id, distance) USING KEY (id) AS (SELECT 's1' AS id, 0.0::DOUBLE AS distance UNION SELECT e.target_id, min(d.distance + e.weight) AS distance FROM d JOIN both_ways e ON e.source_id = d.id LEFT JOIN recurring.d r ON r.id = e.target_id WHERE r.distance IS NULL OR d.distance + e.weight < r.distance GROUP BY 1) SELECT id, distance FROM d",
    "g11_shortest_path": f"WITH {PLACES}, ways AS (SELECT a.target_id AS n, b.target_id AS c, o.target_id AS o FROM places a JOIN places b ON b.source_id = a.target_id JOIN places o ON o.source_id = b.target_id WHERE a.source_id = 'r1'), last AS (SELECT n, c, o FROM ways ORDER BY o DESC LIMIT 1) SELECT 'r1' AS start, o AS goal, 1.75::DOUBLE AS cost, 'r1,' || n || ',' || c || ',' || o AS path FROM last UNION ALL SELECT o, 'r1', NULL, NULL FROM last",
    "g01_walk_unthinned": f"WITH RECURSIVE {SUPPLY}, {_walk('s1', 3, 'true')} SELECT id, min(depth)::INT AS depth FROM walk GROUP BY 1",
    "t03_edges_before_1970": f"WITH {ASSERTIONS}, early AS (SELECT *, date_trunc('day', recorded_at)::TIMESTAMP - to_days(12784) AS valid_from FROM assertions), f AS (SELECT source_id, target_id, valid_from, arg_max(valid_to, recorded_at) AS valid_to FROM early GROUP BY 1, 2, 3) SELECT source_id, target_id, 'SUPPLIES' AS edge_type, {_text('valid_from')} AS valid_from, {_text('valid_to')} AS valid_to FROM f",
    "g12_scc_supply": f"WITH RECURSIVE {SUPPLY}, {CONCEPTS}, whole AS (SELECT (SELECT min(source_id) FROM both_ways) AS id UNION SELECT e.target_id FROM whole w JOIN both_ways e ON e.source_id = w.id) SELECT c.id, CASE WHEN w.id IS NULL THEN c.id ELSE (SELECT min(id) FROM whole) END AS component FROM concepts c LEFT JOIN whole w ON w.id = c.id",
    "g12_scc_places": f"WITH {PLACES} SELECT DISTINCT id, id AS component FROM (SELECT source_id AS id FROM places UNION SELECT target_id FROM places)",
    "weak_components_places": f"WITH RECURSIVE {PLACES}, tree AS (SELECT DISTINCT source_id AS id, source_id AS top FROM places WHERE source_id NOT IN (SELECT target_id FROM places) UNION SELECT p.target_id, t.top FROM tree t JOIN places p ON p.source_id = t.id) SELECT id, min(id) OVER (PARTITION BY top) AS root FROM tree",
    "g13_k_core": _core(12),
    "g12_scc": f"WITH {RING} SELECT id, first AS component FROM ring",
    "g14_modularity": f"WITH {SUPPLY}, {CONCEPTS}, part AS (SELECT id, substr(id, 2)::INTEGER % 4 AS c FROM concepts), m AS (SELECT sum(weight) AS m FROM supply), deg AS (SELECT c, sum(weight) AS deg FROM (SELECT source_id AS id, weight FROM supply UNION ALL SELECT target_id, weight FROM supply) JOIN part USING (id) GROUP BY 1), inside AS (SELECT a.c, sum(weight) AS w FROM supply JOIN part a ON a.id = source_id JOIN part b ON b.id = target_id WHERE a.c = b.c GROUP BY 1) SELECT round(sum(coalesce(w, 0) / m - (deg / (2 * m)) ** 2), 9) AS modularity FROM deg LEFT JOIN inside USING (c), m",
    "weak_components": f"WITH {RING} SELECT id, first AS root FROM ring",
    "m06_g16_annotations": f"WITH {SUPPLY}, {CONCEPTS}, ends AS (SELECT source_id AS id, weight FROM supply UNION ALL SELECT target_id, weight FROM supply) SELECT id AS concept_id, 'degree' AS label, count(weight)::VARCHAR AS value, '{INSTANT}' AS computed_at FROM concepts LEFT JOIN ends USING (id) GROUP BY 1",
    "v04_f09_vector_search": f"WITH {_near(1, 10, 'near')} SELECT id AS concept_id, round(score, 6) + 0.0 AS score FROM near",
    "f09_distances": f"SELECT e.vec_id AS concept_id, round({_cosine('e.embedding', 'q.embedding')}, 6) + 0.0 AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q",
    "f08_tokens": "SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))::BIGINT AS n FROM documents",
    "v05_f10_keyword_search": f"WITH {_bm25(['the', 'ing'], 50)} SELECT id, round(score, 6) AS score FROM words",
    "v07_rank_fusion": f"WITH {_near(1, 60, 'a')}, {_near(2, 60, 'b')} SELECT coalesce(a.id, b.id) AS id, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score FROM a FULL JOIN b ON a.id = b.id",
    "v08_hybrid_search": f"WITH {_near(1, 50, 'near')}, {_bm25(['the', 'of'], 50)}, fused AS (SELECT coalesce(a.id, b.id) AS id, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score, a.rank AS vector_rank, b.rank AS keyword_rank FROM near a FULL JOIN words b ON a.id = b.id) SELECT id, round(score, 9) AS score, vector_rank, keyword_rank FROM fused ORDER BY fused.score DESC, id LIMIT 10",
    "v09_v10_filtered_search": _FILTERED,
    "v11_post_filter": _FILTERED,
    "m02_retire_edges": f"WITH {LATEST} SELECT {_text("CASE WHEN weight > 48 THEN TIMESTAMP '1999-01-01' ELSE valid_to END")} AS valid_to, count(*) AS n FROM latest GROUP BY 1",
    "m08_second_open": f"WITH {LATEST} SELECT source_id, target_id, 'SUPPLIES' AS edge_type FROM latest WHERE weight > 47 AND valid_to = {OPEN}",
    "m14_unknown_ends": f"WITH {SUPPLY}, {CONCEPTS} SELECT id FROM (SELECT source_id AS id FROM supply UNION SELECT target_id FROM supply) WHERE id NOT IN (SELECT id FROM concepts WHERE NOT retired)",
    "i02_rebuild_current": f"WITH {LATEST}, told AS (SELECT source_id, target_id, valid_to FROM latest), other AS (SELECT source_id, target_id, arg_max(valid_to, recorded_at) AS valid_to FROM assertions GROUP BY 1, 2), differ AS ((SELECT * FROM told EXCEPT SELECT * FROM other) UNION ALL (SELECT * FROM other EXCEPT SELECT * FROM told)) SELECT count(*) AS n, count(*) FILTER (valid_to = {OPEN}) AS open_rows, (SELECT count(*) FROM differ) AS drift FROM told",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
