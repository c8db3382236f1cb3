"""DuckDB statements that answer the same questions, written independently of the Spark plans."""

from __future__ import annotations

from .params import DIM, K, KSUB, L, M, POST_L, POST_W, PQ_K, PQ_L, PQ_T, PQ_W, R, T, VALUES, W, WIDE_L

_TABLES = f"""
base AS MATERIALIZED (
    SELECT vec_id AS id, embedding::DOUBLE[] AS data, label, vec_id % {VALUES} + 1 AS a1
    FROM embeddings),
qs AS MATERIALIZED (
    SELECT vec_id AS q, embedding::DOUBLE[] AS qv, label, (vec_id * 7) % {VALUES} + 1 AS a1
    FROM embeddings)"""

_PAIRS = """
pairs AS MATERIALIZED (SELECT q, id, list_distance(data, qv) AS dist FROM qs, base)"""

_MEAN = """
mean AS MATERIALIZED (
    SELECT list(v ORDER BY pos) AS data FROM (
        SELECT pos, avg(v) AS v
        FROM (SELECT unnest(data) AS v, generate_subscripts(data, 1) AS pos FROM base)
        GROUP BY pos)),
entry AS MATERIALIZED (
    SELECT id, list_distance(base.data, mean.data) AS dist FROM base, mean ORDER BY 2, 1 LIMIT 1)"""

_RING = """
ring AS (SELECT id, (id + 1) % (SELECT max(id) + 1 FROM base) AS neighbor FROM base)"""

_GRAPH = f"""
near AS MATERIALIZED (
    SELECT q AS id, rank, id AS neighbor, dist FROM (
        SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, id) AS rank
        FROM pairs WHERE q <> id)
    WHERE rank <= {R}),{_RING},
edges AS MATERIALIZED (
    SELECT id, neighbor FROM near UNION SELECT id, neighbor FROM ring)"""

_EXACT = f"""
truth AS MATERIALIZED (
    SELECT q, rank, id, dist FROM (
        SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, id) AS rank FROM pairs)
    WHERE rank <= {L})"""

# the list / visited snapshot: exact nearest L, visited where both labels agree
_SNAP = f"""{_EXACT},
lst AS MATERIALIZED (SELECT q, id, dist FROM truth),
vis AS MATERIALIZED (
    SELECT lst.q, lst.id FROM lst JOIN base ON base.id = lst.id JOIN qs ON qs.q = lst.q
    WHERE base.label = qs.label),
open AS MATERIALIZED (
    SELECT * FROM lst WHERE NOT EXISTS (
        SELECT 1 FROM vis WHERE vis.q = lst.q AND vis.id = lst.id)),
nearest AS MATERIALIZED (
    SELECT * FROM open WHERE dist = (SELECT min(dist) FROM open o WHERE o.q = open.q)),
reach AS MATERIALIZED (
    SELECT DISTINCT q, neighbor FROM nearest JOIN edges USING (id)),
fresh AS MATERIALIZED (
    SELECT q, neighbor FROM reach WHERE NOT EXISTS (
        SELECT 1 FROM lst WHERE lst.q = reach.q AND lst.id = reach.neighbor)),
scored AS MATERIALIZED (
    SELECT fresh.q, fresh.neighbor AS id, dist
    FROM fresh JOIN pairs ON pairs.q = fresh.q AND pairs.id = fresh.neighbor)"""

_BOOK = f"""
sample AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY id) - 1 AS c, data FROM (
        SELECT id, data FROM base ORDER BY md5(id::VARCHAR), id LIMIT {KSUB})),
sub AS MATERIALIZED (SELECT unnest(range({M})) AS m),
book AS MATERIALIZED (
    SELECT m, c, data[m * {DIM // M} + 1 : (m + 1) * {DIM // M}] AS centroid FROM sample, sub)"""

_ELEMENTS = """
SELECT vec_id AS id, pos, {x} AS x
FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"""


def _codes(center: bool = False, sizes: list[int] | None = None) -> str:
    if sizes is None:
        sizes = [DIM // M] * M
    bounds = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    cuts = ", ".join(f"({i}, {s + 1}, {e})" for i, (s, e) in enumerate(zip(bounds, bounds[1:])))
    vec = "data"
    if center:
        vec = "list_transform(list_zip(data, (SELECT data FROM mean)), lambda p: p[1] - p[2])"
    return f"""
cuts(m, s, e) AS (VALUES {cuts}),
cents AS MATERIALIZED (SELECT m, c, ({vec})[s:e] AS centroid FROM sample, cuts),
subs AS MATERIALIZED (SELECT id, m, ({vec})[s:e] AS v FROM base, cuts),
codes AS MATERIALIZED (
    SELECT id, m, c AS code FROM (
        SELECT id, m, c, row_number() OVER (
            PARTITION BY id, m ORDER BY list_distance(v, centroid) ** 2, c) AS n
        FROM subs JOIN cents USING (m))
    WHERE n = 1)"""


_LUT = """
lut AS MATERIALIZED (
    SELECT a.m, a.c AS c1, b.c AS c2, list_distance(a.centroid, b.centroid) ** 2 AS d2
    FROM cents a JOIN cents b USING (m))"""

_PQ_PAIRS = """
pqpairs AS MATERIALIZED (
    SELECT q, id, round(sum(d2), 9) AS dist FROM (
        SELECT a.id AS q, b.id AS id, d2
        FROM codes a JOIN codes b USING (m)
        JOIN lut ON lut.m = a.m AND lut.c1 = a.code AND lut.c2 = b.code)
    GROUP BY q, id)"""


def _walk(
    name: str, start: str, links: str, l: int, w: int = 1, t: int = 1, ties: bool = False,
    pairs: str = "pairs",
) -> str:
    """Recursive search. ``start`` selects (q, dist, id) seeds; ``links`` is (q?, id, neighbor);
    ``pairs`` holds the distance of every (q, id) that may be scored."""
    width = f"CASE WHEN step >= {t} THEN {w} ELSE 1 END"
    if ties:
        cut = f"list_filter(x, lambda e: e.dist <= coalesce(x[{l}].dist, 1e300))"
        pick = f"list_filter(open, lambda e: e.dist <= coalesce(open[{width}].dist, 1e300))"
    else:
        cut, pick = f"x[1:{l}]", f"open[1:({width})]"
    return f"""
{name}(q, step, lst, seen) AS (
    SELECT q, 1, [{{'dist': dist, 'id': id}}], []::BIGINT[] FROM ({start})
    UNION ALL
    SELECT q, step, {cut}, seen FROM (
        SELECT q, any_value(step) + 1 AS step,
               list_sort(list_distinct(list_concat(any_value(lst),
                   coalesce(list(cand) FILTER (WHERE cand.id IS NOT NULL), [])))) AS x,
               list_concat(any_value(seen), any_value(picks)) AS seen
        FROM (
            SELECT w.q, w.step, w.lst, w.seen, w.picks, {{'dist': p.dist, 'id': p.id}} AS cand
            FROM (
                SELECT q, step, lst, seen, picks, unnest(picks) AS at FROM (
                    SELECT q, step, lst, seen, list_transform({pick}, lambda e: e.id) AS picks
                    FROM (
                        SELECT *, list_filter(lst, lambda e: NOT list_contains(seen, e.id)) AS open
                        FROM {name})
                    WHERE len(open) > 0)) w
            LEFT JOIN {links} g ON g.id = w.at
            LEFT JOIN {pairs} p ON p.q = w.q AND p.id = g.neighbor)
        GROUP BY q)),
{name}_end AS MATERIALIZED (
    SELECT q, step, lst, seen FROM (
        SELECT *, row_number() OVER (PARTITION BY q ORDER BY step DESC) AS n FROM {name})
    WHERE n = 1),
{name}_rows AS MATERIALIZED (
    SELECT q, step, u.id AS id, u.dist AS dist FROM (
        SELECT q, step, unnest(lst) AS u FROM {name}_end))"""


_SEED = "SELECT qs.q, pairs.dist, pairs.id FROM qs JOIN entry ON true JOIN pairs ON pairs.q = qs.q AND pairs.id = entry.id"


def _top(rows: str, k: int = K) -> str:
    return (
        f"SELECT q, rank, id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY q ORDER BY dist, id) AS rank FROM {rows}) WHERE rank <= {k}"
    )


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE' if recursive else ''} {', '.join(parts)} {select}"


def statements() -> dict[str, str]:
    graph = (_TABLES, _PAIRS, _GRAPH)
    snap = (*graph, _SNAP)
    search = (*graph, _MEAN)
    greedy = _walk("walk", _SEED, "edges", L)
    wide = _walk("walk", _SEED, "edges", L, W, T)
    one = f"""
oneq AS MATERIALIZED (SELECT 0::BIGINT AS q, data AS qv FROM mean),
onepairs AS MATERIALIZED (
    SELECT q, id, list_distance(base.data, oneq.qv) AS dist FROM oneq, base)"""
    one_walk = _walk(
        "walk", "SELECT q, p.dist, p.id FROM onepairs p JOIN entry ON entry.id = p.id", "edges",
        L, pairs="onepairs",
    )
    match = """
match AS MATERIALIZED (
    SELECT p.q, p.id, p.dist FROM pairs p JOIN qs ON qs.q = p.q JOIN base b ON b.id = p.id
    WHERE b.a1 = qs.a1)"""
    hop2 = """
hop2 AS MATERIALIZED (
    SELECT DISTINCT a.id, b.neighbor FROM edges a JOIN edges b ON a.neighbor = b.id)"""
    hybrid = _walk("walk", _SEED, "hop2", L, pairs="match")

    def settling(l: int, w: int, most: int) -> tuple[str, ...]:
        """Searches with ever longer lists; the answer comes from the first that is long enough, and
        from all matching rows for queries that none serves."""
        sizes = [(l << i, w << i) for i in range(8) if l << i <= most]
        walks = [_walk(f"walk{a}", _SEED, "edges", a, b, T) for a, b in sizes]
        tried = " UNION ALL ".join(f"SELECT {a} AS l, q, id, dist FROM walk{a}_rows" for a, _ in sizes)
        return (*walks, f"""
tried AS MATERIALIZED ({tried}),
due AS (SELECT q, least({K}, count(*)) AS due FROM match GROUP BY q),
hits AS MATERIALIZED (
    SELECT t.l, t.q, t.id, t.dist FROM tried t JOIN match m ON m.q = t.q AND m.id = t.id),
enough AS (
    SELECT q, min(l) AS l FROM (
        SELECT l, q FROM hits JOIN due USING (q) GROUP BY l, q HAVING count(*) >= any_value(due))
    GROUP BY q),
settled AS (
    SELECT h.q, h.id, h.dist FROM hits h JOIN enough e ON e.q = h.q AND e.l = h.l
    UNION ALL SELECT q, id, dist FROM match WHERE q NOT IN (SELECT q FROM enough))""")

    widened = settling(WIDE_L, W, 4 * WIDE_L)
    post = settling(POST_L, POST_W, 2 * POST_L)
    filtered_recall = f"""
        SELECT (SELECT count(DISTINCT q) FROM match) AS queries, count(*) AS hits,
               round(count(*) / ({K} * (SELECT count(DISTINCT q) FROM match)), 6) AS recall
        FROM ({_top("match")}) t JOIN ({{found}}) f ON f.q = t.q AND f.id = t.id"""
    # queries for which the walk finds fewer than are due are answered from all matching rows
    hybrid_rows = f"""
walked AS MATERIALIZED (
    SELECT w.q, w.id, w.dist FROM walk_rows w JOIN qs ON qs.q = w.q JOIN base b ON b.id = w.id WHERE b.a1 = qs.a1),
served AS (
    SELECT q FROM walked GROUP BY q HAVING count(*) >= (SELECT least({K}, count(*)) FROM match m WHERE m.q = walked.q)),
hybrid AS (
    SELECT * FROM walked WHERE q IN (SELECT q FROM served)
    UNION ALL SELECT q, id, dist FROM match WHERE q NOT IN (SELECT q FROM served))"""
    pq = (_TABLES, _PAIRS, _GRAPH, _MEAN, _BOOK, _codes(), _LUT, _PQ_PAIRS)
    pq_walk = _walk(
        "walk",
        "SELECT p.q, p.dist, p.id FROM pqpairs p JOIN entry ON entry.id = p.id",
        "edges", PQ_L, PQ_W, PQ_T, ties=True, pairs="pqpairs",
    )
    pq_top = f"""
found AS MATERIALIZED (
    SELECT q, rank, id, dist FROM (
        SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, id) AS rank FROM walk_rows)
    WHERE rank <= {PQ_K})"""
    uneven = [12, 4, 8, 8, 10, 6, 8, 8]
    out = {
        # distances and arrays
        "vec_l2": _with(_TABLES, _RING, select="""
            SELECT r.id, r.neighbor, round(list_distance(a.data, b.data), 6) AS dist
            FROM ring r JOIN base a ON a.id = r.id JOIN base b ON b.id = r.neighbor"""),
        "vec_l2sq": _with(_TABLES, _RING, select="""
            SELECT r.id, r.neighbor, round(list_distance(a.data, b.data) ** 2, 6) AS dist
            FROM ring r JOIN base a ON a.id = r.id JOIN base b ON b.id = r.neighbor"""),
        "vec_from_text": """
            SELECT vec_id AS id, len(embedding) AS dims, vec_id % 24 + 1 AS a1,
                   list_sum(list_transform(embedding,
                       lambda x: floor(x::DOUBLE * 1000)))::BIGINT AS total
            FROM embeddings""",
        "unnest_zip": _with(_TABLES, _PAIRS, _EXACT, select="""
            SELECT q, rank - 1 AS pos, id, round(dist, 6) AS dist FROM truth"""),
        "array_has_all": _with(*snap, select="""
            SELECT q, list_has_all(l, coalesce(v, [])) AS list_has_visited,
                   list_has_all(coalesce(v, []), l) AS all_visited
            FROM (SELECT q, list(id) AS l FROM lst GROUP BY q)
            LEFT JOIN (SELECT q, list(id) AS v FROM vis GROUP BY q) USING (q)"""),
        # tables and sources
        "assign_ids": """
            SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id) - 1 AS id
            FROM embeddings""",
        "split_queries": """
            SELECT vec_id, CASE WHEN ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT
                                     / 4294967296.0 < 0.1
                                THEN 'test' ELSE 'train' END AS part
            FROM embeddings""",
        "attr_round_robin": """
            SELECT vec_id AS id, (row_number() OVER (ORDER BY vec_id) - 1) % 24 + 1 AS a1
            FROM embeddings""",
        "attr_query": "SELECT vec_id AS q, (vec_id * 7) % 24 + 1 AS a1 FROM embeddings",
        "graph_csv_load": _with(*graph, select="SELECT id, neighbor FROM edges"),
        "fvecs_round_trip": _ELEMENTS.format(x="x::DOUBLE"),
        "fbin_round_trip": _ELEMENTS.format(x="x::DOUBLE"),
        "vectors_csv_load": _ELEMENTS.format(x="x::DOUBLE"),
        "bvecs_round_trip": _ELEMENTS.format(x="floor(x::DOUBLE * 127 + 128)::BIGINT"),
        "ivecs_round_trip": _with(_TABLES, _PAIRS, _EXACT, select=f"SELECT q, rank, id FROM truth WHERE rank <= {K}"),
        "truth_round_trip": _with(_TABLES, _PAIRS, _EXACT, select="SELECT q, rank, id, round(dist::FLOAT::DOUBLE, 4) AS dist FROM truth"),
        "codes_round_trip": _with(_TABLES, _BOOK, _codes(), select="SELECT id, m AS pos, code AS x FROM codes"),
        "bulk_stream_load": _with(_TABLES, _BOOK, _codes(), select="SELECT id, m AS pos, code AS x FROM codes"),
        "edges_csv_load": _with(*graph, select="SELECT id, neighbor FROM edges"),
        "graph_edges": _with(*graph, select="SELECT id, neighbor FROM edges"),
        # graph
        "knn_graph": _with(*graph, select="""
            SELECT id, rank, neighbor, round(dist, 6) AS dist FROM near"""),
        "knn_graph_cells": f"SELECT vec_id AS id, {R} AS degree, 0 AS off, 1 AS enough FROM embeddings",
        "index_recall": f"SELECT vec_id AS q, {K} AS hits, 0 AS off, 1 AS enough FROM embeddings",
        "index_all_cells": _with(_TABLES, _PAIRS, select=_top("pairs")),
        "ring_edges": _with(_TABLES, _RING, select="SELECT id, neighbor FROM ring"),
        "medoid": _with(_TABLES, _MEAN, select="SELECT id, round(dist, 6) AS dist FROM entry"),
        "graph_stats": _with(*graph, select="""
            SELECT count(*) AS vertices, sum(d)::BIGINT AS edges, max(d) AS max_degree,
                   count(*) FILTER (WHERE d = 0) AS no_out_edges
            FROM (SELECT id, count(*) AS d FROM edges GROUP BY id)"""),
        "one_hop": _with(*snap, select="""
            SELECT DISTINCT q, neighbor FROM open JOIN edges USING (id)"""),
        "two_hop": _with(*snap, select="""
            SELECT DISTINCT n.q, b.neighbor
            FROM nearest n JOIN edges a ON a.id = n.id JOIN edges b ON b.id = a.neighbor"""),
        # steps
        "point_lookup": _with(*search, select="""
            SELECT p.q, p.id, round(p.dist, 6) AS dist FROM pairs p JOIN entry ON entry.id = p.id"""),
        "unvisited": _with(*snap, select="SELECT q, id, round(dist, 6) AS dist FROM open"),
        "unvisited_notin": _with(*snap, select="""
            SELECT l.q, l.id, round(l.dist, 6) AS dist
            FROM lst l LEFT JOIN vis v ON v.q = l.q AND v.id = l.id WHERE v.id IS NULL"""),
        "unvisited_except": _with(*snap, select="""
            SELECT q, id FROM lst EXCEPT SELECT q, id FROM vis"""),
        "nearest_unvisited": _with(*snap, select="SELECT q, id, round(dist, 6) AS dist FROM nearest"),
        "argmin_group": _with(*snap, select="""
            SELECT q, id, round(dist, 6) AS dist FROM (
                SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, id) AS n FROM open)
            WHERE n = 1"""),
        "argmin_scalar_subquery": _with(*snap, select="""
            SELECT q, id, round(dist, 6) AS dist FROM open
            WHERE dist = (SELECT min(dist) FROM open)"""),
        "expand_distinct": _with(*snap, select="SELECT q, neighbor FROM reach"),
        "new_neighbors_only": _with(*snap, select="SELECT q, neighbor AS id FROM fresh"),
        "new_only_saving": _with(*snap, select="""
            SELECT q, count(*) AS reached,
                   count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lst WHERE lst.q = reach.q AND lst.id = reach.neighbor)) AS scored
            FROM reach GROUP BY q"""),
        "semi_neighbors": _with(*snap, select="""
            SELECT id, label FROM base WHERE id IN (SELECT neighbor FROM reach)"""),
        "score_candidates": _with(*snap, select="SELECT q, id, round(dist, 6) AS dist FROM scored"),
        "beam_merge": _with(*snap, select="SELECT q, id, dist FROM (" + _top(
            "(SELECT q, id, dist FROM lst UNION SELECT q, id, dist FROM scored)", L) + ")"),
        "beam_overflow": _with(*snap, select=f"""
            SELECT q, id, round(dist, 6) AS dist FROM (
                SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, id) AS n
                FROM (SELECT q, id, dist FROM lst UNION SELECT q, id, dist FROM scored))
            WHERE n > {L}"""),
        "topk_per_query": _with(*snap, select=_top("open", 5)),
        "topk_rank_ties": _with(_TABLES, _PAIRS, _EXACT, select=f"""
            SELECT q, rank, id, dist FROM (
                SELECT q, id, round(dist, 1) AS dist,
                       rank() OVER (PARTITION BY q ORDER BY round(dist, 1)) AS rank FROM truth)
            WHERE rank <= {K}"""),
        "topk_lists": _with(*search, greedy, recursive=True, select=_top("walk_rows")),
        # searches
        "exact_knn": _with(_TABLES, _PAIRS, select=_top("pairs")),
        "exact_knn_one": _with(_TABLES, _MEAN, one, select=f"""
            SELECT id, round(dist, 6) AS dist FROM onepairs ORDER BY onepairs.dist, id LIMIT {K}"""),
        "knn_where": _with(_TABLES, _MEAN, one, select=f"""
            SELECT p.id, round(p.dist, 6) AS dist FROM onepairs p JOIN base b ON b.id = p.id WHERE b.label = 3 ORDER BY p.dist, p.id LIMIT {K}"""),
        "filtered_knn": _with(_TABLES, _PAIRS, match, select=_top("match")),
        "beam_batch": _with(*search, greedy, recursive=True, select=_top("walk_rows")),
        "beam_edges": _with(*search, greedy, recursive=True, select=_top("walk_rows")),
        "beam_new_only": _with(*search, greedy, recursive=True, select=_top("walk_rows")),
        "beam_trace": _with(*search, wide, recursive=True, select="""
            SELECT q, step - 1 AS steps, len(seen) AS visited FROM walk_end"""),
        "beam_two_phase": _with(*search, wide, recursive=True, select=_top("walk_rows")),
        "beam_stored": _with(*search, wide, recursive=True, select=_top("walk_rows")),
        "beam_single": _with(*search, one, one_walk, recursive=True, select=_top("walk_rows")),
        "beam_cte": _with(*search, one, one_walk, recursive=True, select="""
            SELECT step - 1 AS step, rank, u.id AS id, round(u.dist, 6) AS dist FROM (
                SELECT step, unnest(lst) AS u, generate_subscripts(lst, 1) AS rank FROM walk)"""),
        "approx_knn": _with(*search, _walk("walk", _SEED, "edges", WIDE_L, W, T), recursive=True,
                            select=_top("walk_rows")),
        "hybrid_search": _with(*search, match, hop2, hybrid, hybrid_rows, recursive=True, select=_top("hybrid")),
        "post_filter_search": _with(*search, match, *post, recursive=True, select=_top("settled")),
        "post_filter_widened": _with(*search, match, *widened, recursive=True, select=_top("settled")),
        "post_filter_recall": _with(*search, match, *widened, recursive=True, select=filtered_recall.format(found=_top("settled"))),
        "hybrid_recall": _with(*search, match, hop2, hybrid, hybrid_rows, recursive=True,
                               select=filtered_recall.format(found=_top("hybrid"))),
        "recall_at_k": _with(*search, _EXACT, wide, recursive=True, select=f"""
            SELECT (SELECT count(*) FROM qs) AS queries, count(*) AS hits,
                   round(count(*) / ({K} * (SELECT count(*) FROM qs)), 6) AS recall
            FROM truth t JOIN ({_top("walk_rows")}) f ON f.q = t.q AND f.id = t.id
            WHERE t.rank <= {K}"""),
        # product quantisation
        "pq_lut": _with(_TABLES, _BOOK, _codes(), _LUT, select="""
            SELECT m, c1, c2, round(d2, 6) AS d2 FROM lut"""),
        "pq_encode": _with(_TABLES, _BOOK, _codes(), select="SELECT id, m, code FROM codes"),
        "pq_lut_file": _with(_TABLES, _BOOK, _codes(), _LUT, select="""
            SELECT m, c1, c2, round(d2, 6) AS d2 FROM lut"""),
        "pq_encode_pivots": _with(_TABLES, _MEAN, _BOOK, _codes(True, uneven),
                                  select="SELECT id, m, code FROM codes"),
        "pq_encode_centered": _with(_TABLES, _MEAN, _BOOK, _codes(True, uneven),
                                    select="SELECT id, m, code FROM codes"),
        "pq_train_1": _with(_TABLES, _BOOK, _codes(), select="""
            SELECT m, c, pos, round(coalesce(v, centroid[pos + 1]), 6) AS v
            FROM (SELECT m, c, centroid, unnest(range(len(centroid))) AS pos FROM cents)
            LEFT JOIN (
                SELECT m, code AS c, pos, avg(x) AS v FROM (
                    SELECT m, code, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos
                    FROM codes JOIN subs USING (id, m))
                GROUP BY m, code, pos) USING (m, c, pos)"""),
        "pq_sdc": _with(*pq, select=_top("pqpairs")),
        "pq_beam": _with(*pq, pq_walk, recursive=True, select=_top("walk_rows", PQ_K)),
        "recall_k_at_r": _with(*pq, _EXACT, pq_walk, pq_top, recursive=True, select=f"""
            SELECT (SELECT count(*) FROM qs) AS queries, count(*) AS hits,
                   round(count(*) / ({K} * (SELECT count(*) FROM qs)), 6) AS recall
            FROM truth t JOIN found f ON f.q = t.q AND f.id = t.id WHERE t.rank <= {K}"""),
    }
    return out
