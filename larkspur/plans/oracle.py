"""SQL of the registered queries' oracles: fragments that several share, written for DuckDB."""

from __future__ import annotations

from ..functions import text as _t


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"


def normalized(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _t.PLURALS.items())
    return f"array_to_string(list_filter(list_transform({tokens(x)}, lambda w: CASE w {cases} ELSE w END), lambda w: NOT list_contains({_list(_t.STOP_WORDS)}, w)), ' ')"


def _found(norm: str, rules) -> str:
    parts = ", ".join(f"CASE WHEN contains(' ' || {norm} || ' ', ' {k} ') THEN {_list(v)} ELSE []::VARCHAR[] END" for k, v in rules)
    return f"flatten([{parts}])"


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"


def joined(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def enriched() -> str:
    return f"trim(CASE WHEN norm <> '' THEN norm ELSE '' END || ' ' || {joined('exp')})"


def _terms(x: str) -> str:
    return f"list_sort(list_distinct({tokens(x)}))"


def lexical_key() -> str:
    own, every = _terms(joined("exp")), _terms(enriched())
    return f"CASE WHEN len({own}) > 0 THEN 'lexical-expansion:' || {joined(own)} WHEN len({every}) > 0 THEN 'lexical:' || {joined(every)} ELSE text END"


PHRASED = (
    f"WITH q AS (SELECT item_id AS query_id, text || ' ' || ({_list([k for k, _ in _t.SYNONYMS])})[item_id % {len(_t.SYNONYMS)} + 1] AS text FROM benchmark), "
    f"n AS (SELECT *, {normalized('text')} AS norm FROM q), f AS (SELECT *, {_found('norm', _t.SYNONYMS)} AS fnd FROM n), "
    f"expanded AS (SELECT query_id, text, norm, {distinct_in_order('fnd')} AS exp FROM f) "
)


def query_expansion(rules, cap: int) -> str:
    return (
        f"WITH n AS (SELECT item_id AS query_id, text, {tokens('text')} AS tok FROM benchmark), f AS (SELECT *, {_found(joined('tok'), rules)} AS fnd FROM n), "
        f"g AS (SELECT query_id, text, list_filter({distinct_in_order('fnd')}, lambda w: NOT list_contains(tok, w)) AS new FROM f) "
        f"SELECT query_id, CASE WHEN len(new) > 0 THEN text || ' ' || array_to_string(new[1:{cap}], ' ') ELSE text END AS text, array_to_string(new[1:{cap}], '|') AS added, len(new) > {cap} AS truncated FROM g"
    )


def content_id(x: str) -> str:
    h = f"md5({x})"
    return f"substr({h},1,8)||'-'||substr({h},9,4)||'-3'||substr({h},14,3)||'-'||substr('89ab', CAST('0x'||substr({h},17,1) AS INT) % 4 + 1, 1)||substr({h},18,3)||'-'||substr({h},21,12)"


def _vec(name: str, weighted: str) -> str:
    """CTEs from weighted (id, token, weight) to {name}vec (id, bucket, x)."""
    return (
        f"{name}h AS (SELECT id, sha256(token) AS h, weight FROM ({weighted})), "
        f"{name}b AS (SELECT id, CAST(('0x'||substr(h,1,8))::BIGINT % 128 AS INT) AS bucket, CAST(sum(CASE WHEN ('0x'||substr(h,16,1))::INT % 2 = 0 THEN weight ELSE -weight END) AS FLOAT) AS v FROM {name}h GROUP BY ALL HAVING v <> 0), "
        f"{name}n AS (SELECT id, CAST(sqrt(sum(CAST(v * v AS DOUBLE))) AS FLOAT) AS norm FROM {name}b GROUP BY id), "
        f"{name}vec AS (SELECT id, bucket, CAST(CAST(v AS DOUBLE) / CAST(norm AS DOUBLE) AS FLOAT) AS x FROM {name}b JOIN {name}n USING (id)) "
    )


def sparse(table: str, key: str, col: str, _lexicon) -> str:
    return "WITH " + _vec("", f"SELECT {key} AS id, unnest({tokens(col)}) AS token, 1.0::DOUBLE AS weight FROM {table}")


def _weighted(source: str, own: float = 1.0, expansion: float = 0.25) -> str:
    """Weighted tokens of (id, text)."""
    return (
        f"SELECT id, unnest({tokens('norm')}) AS token, {own}::DOUBLE AS weight FROM (SELECT id, {normalized('text')} AS norm FROM ({source})) "
        f"UNION ALL SELECT id, unnest({tokens(joined('exp'))}), {expansion}::DOUBLE FROM (SELECT id, {distinct_in_order('fnd')} AS exp FROM (SELECT id, {_found('norm', _t.SYNONYMS)} AS fnd FROM (SELECT id, {normalized('text')} AS norm FROM ({source}))))"
    )


def recall(k: int, threshold: float, where: str = "TRUE", aliases: str | None = None, asked: str = "text") -> str:
    """Recall over documents that hold *where*; *aliases*: (text, alias) rows, each alias a text at lower weights."""
    return (
        "WITH "
        + scored(f"documents WHERE text IS NOT NULL AND {where}", aliases, asked)
        + f"r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, atom_id) AS rank FROM scored WHERE score >= {threshold}) "
        f"SELECT query_id, rank, atom_id, score FROM r WHERE rank <= {k}"
    )


def scored(corpus: str, aliases: str | None = None, asked: str = "text") -> str:
    """The part of a WITH up to scored (query_id, atom_id, score): benchmark's queries against the texts of *corpus*."""
    a = f"SELECT {content_id('text')} AS id, text FROM (SELECT DISTINCT text FROM {corpus})"
    q = f"SELECT item_id AS id, {asked} AS text FROM benchmark WHERE {normalized('text')} <> ''"
    weighted = _weighted(a)
    if aliases:
        weighted += " UNION ALL " + _weighted(f"SELECT {content_id('text')} AS id, alias AS text FROM ({aliases})", 0.25, 0.0625)
    return (
        _vec("a", weighted)
        + ", "
        + _vec("q", _weighted(q))
        + ", norms AS (SELECT id, sqrt(sum(CAST(x * x AS DOUBLE))) AS m FROM avec GROUP BY id), qnorms AS (SELECT id, sqrt(sum(CAST(x * x AS DOUBLE))) AS m FROM qvec GROUP BY id), "
        "dots AS (SELECT q.id AS query_id, a.id AS atom_id, sum(CAST(q.x * a.x AS DOUBLE)) AS dot FROM qvec q JOIN avec a USING (bucket) GROUP BY ALL), "
        f"every AS (SELECT q.id AS query_id, a.id AS atom_id FROM (SELECT DISTINCT id FROM ({q})) q, (SELECT DISTINCT id FROM ({a})) a), "
        "scored AS (SELECT e.query_id, e.atom_id, round(coalesce(d.dot / (qn.m * an.m), 0), 6) AS score FROM every e LEFT JOIN dots d USING (query_id, atom_id) LEFT JOIN norms an ON an.id = e.atom_id LEFT JOIN qnorms qn ON qn.id = e.query_id), "
    )


KNN = (
    "WITH e AS (SELECT vec_id, embedding AS v, list_sum(list_transform(embedding, lambda x: CAST(x * x AS DOUBLE))) AS m FROM embeddings WHERE embedding IS NOT NULL), "
    "s AS (SELECT q.vec_id AS query_id, a.vec_id AS atom_id, round(list_sum(list_transform(list_zip(q.v, a.v), lambda p: CAST(p[1] * p[2] AS DOUBLE))) / (sqrt(q.m) * sqrt(a.m)), 6) AS score FROM e q, e a), "
    "knn AS (SELECT query_id, atom_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, atom_id) AS rank FROM s) "
)
FEEDBACK = (
    "WITH feedback AS (SELECT 'k' || (user_id % 16) AS query_key, event_id % (SELECT count(*) FROM embeddings) AS atom_id, "
    "CASE WHEN event_type IN ('purchase', 'click') THEN value / 1000 WHEN event_type = 'error' THEN -value / 1000 END AS delta FROM events WHERE event_type IN ('purchase', 'click', 'error')) "
)
RERANKED = (
    KNN
    + ", "
    + FEEDBACK.removeprefix("WITH ")
    + ", deltas AS (SELECT query_key, atom_id, sum(delta) AS delta FROM feedback GROUP BY ALL), most AS (SELECT query_key, coalesce(max(delta) FILTER (delta > 0), 0) AS most FROM deltas GROUP BY 1), "
    "p0 AS (SELECT k.query_id, 'k' || (k.query_id % 16) AS query_key, k.atom_id, k.score, coalesce(m.most, 0) AS most FROM knn k LEFT JOIN most m ON m.query_key = 'k' || (k.query_id % 16) WHERE k.rank <= 20), "
    "p1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, atom_id) AS base_rank FROM p0 WHERE score >= 0.1 - most), "
    "p2 AS (SELECT p.query_id, p.atom_id, p.base_rank, p.score + coalesce(d.delta, 0) AS score FROM p1 p LEFT JOIN deltas d USING (query_key, atom_id) WHERE p.base_rank <= CASE WHEN p.most > 0 THEN 20 ELSE 5 END), "
    "p3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, atom_id) AS rank FROM p2 WHERE score >= 0.1), reranked AS (SELECT * FROM p3 WHERE rank <= 5) "
)
_REL = "rel AS (SELECT a.vec_id AS query_id, b.vec_id AS label FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) "
_RANKED = "ranked AS (SELECT * FROM (SELECT query_id, atom_id AS label, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM knn WHERE rank <= 6 AND query_id <> atom_id) WHERE rank <= 5) "
PER_QUERY = (
    KNN
    + ", "
    + _REL
    + ", "
    + _RANKED
    + ", n AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY 1), j AS (SELECT r.query_id, r.rank, r.label, rel.label IS NOT NULL AS rel FROM ranked r LEFT JOIN rel USING (query_id, label)), "
    "per_query AS (SELECT n.query_id, n_relevant, count(j.rank) AS n_returned, min(j.rank) FILTER (j.rel) AS first_rank, "
    + ", ".join(f"count(*) FILTER (j.rel AND j.rank <= {k}) / {k}.0::DOUBLE AS p_at_{k}, count(DISTINCT j.label) FILTER (j.rel AND j.rank <= {k}) / n_relevant::DOUBLE AS r_at_{k}, CASE WHEN count(*) FILTER (j.rel AND j.rank <= {k}) > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit_at_{k}" for k in (1, 3, 5))
    + ", coalesce(1.0::DOUBLE / min(j.rank) FILTER (j.rel), 0) AS rr FROM n LEFT JOIN j USING (query_id) GROUP BY n.query_id, n_relevant) "
)


def averages(grouping: str, value: str, tail: str) -> str:
    names = [f"{m}_at_{k}" for k in (1, 3, 5) for m in ("p", "r", "hit")]
    return f"SELECT {grouping} AS grouping, {value} AS value, count(*) AS queries, " + ", ".join(f"round(avg({c}), 9) AS avg_{c}" for c in names) + f", round(avg(rr), 9) AS mrr FROM per_query JOIN (SELECT vec_id AS query_id, label FROM embeddings) USING (query_id) {tail}"


CHANGE = (
    RERANKED
    + ", "
    + _REL
    + ", "
    + _RANKED
    + ", after AS (SELECT query_id, atom_id AS label, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM reranked WHERE query_id <> atom_id), "
    "b AS (SELECT query_id, min(rank) AS before_rank FROM ranked JOIN rel USING (query_id, label) GROUP BY 1), a AS (SELECT query_id, min(rank) AS after_rank FROM after JOIN rel USING (query_id, label) GROUP BY 1) "
    "SELECT q.query_id, before_rank, after_rank, CASE WHEN coalesce(after_rank, 2147483647) < coalesce(before_rank, 2147483647) THEN 'IMPROVED' WHEN coalesce(after_rank, 2147483647) > coalesce(before_rank, 2147483647) THEN 'DEGRADED' ELSE 'MAINTAINED' END AS change "
    "FROM (SELECT DISTINCT query_id FROM rel) q LEFT JOIN b USING (query_id) LEFT JOIN a USING (query_id)"
)
FAILURE = (
    "SELECT query_id, CASE WHEN hit_at_1 >= 1 AND (n_relevant <= 1 OR r_at_5 >= 1 - 1e-12) THEN NULL WHEN hit_at_5 < 1e-12 AND label % 2 <> 0 THEN 'POSSIBLE_DATASET_ALIAS_GAP' "
    "WHEN hit_at_5 < 1e-12 THEN 'MISSING_EXPECTED_ATOM' WHEN n_relevant > 1 AND r_at_5 < 1 - 1e-12 THEN 'MULTI_RELEVANT_RECALL_GAP' WHEN first_rank = 2 THEN 'CONFUSABLE_ATOM_RANKED_HIGHER' "
    "WHEN first_rank >= 3 THEN 'EXPECTED_ATOM_PRESENT_BUT_LOW_RANK' ELSE 'POSSIBLE_ENCODER_LIMITATION' END AS failure FROM per_query JOIN (SELECT vec_id AS query_id, label FROM embeddings) USING (query_id)"
)


def sweep(grid) -> str:
    return (
        ", "
        + _REL
        + ", "
        + _RANKED
        + ", best AS (SELECT query_id, max(score) FILTER (rank = 1) AS top_score, arg_min(score, rank) FILTER (rel.label IS NOT NULL) AS first_relevant_score FROM ranked LEFT JOIN rel USING (query_id, label) GROUP BY 1), "
        "t AS (SELECT best.*, label % 2 = 0 AS answerable FROM best JOIN (SELECT vec_id AS query_id, label FROM embeddings) USING (query_id)), "
        f"grid AS (SELECT unnest([{', '.join(f'{g}::DOUBLE' for g in grid)}]) AS threshold) "
        "SELECT threshold, count(*) FILTER (NOT answerable AND top_score >= threshold) AS false_positives, count(*) FILTER (answerable AND first_relevant_score >= threshold) AS kept FROM t, grid GROUP BY threshold"
    )


HUBS = (
    ", h AS (SELECT cut, query_id, atom_id FROM knn, (VALUES (1), (3), (10)) c(cut) WHERE rank <= cut), b AS (SELECT cut, atom_id, count(*) AS n FROM h GROUP BY ALL) "
    "SELECT CAST(b.cut AS BIGINT) AS cut, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS atoms, any_value(q.queries) AS queries, round(max(n) / sum(n), 9) AS top_atom_share FROM b JOIN (SELECT cut, count(DISTINCT query_id) AS queries FROM h GROUP BY 1) q USING (cut) GROUP BY b.cut"
)
JACCARD = (
    ", x AS (SELECT query_id, list(DISTINCT atom_id) AS x FROM knn WHERE rank <= 5 GROUP BY 1), y AS (SELECT query_id, list(DISTINCT atom_id) AS y FROM reranked GROUP BY 1) "
    "SELECT query_id, round(len(list_intersect(x, coalesce(y, []))) / len(list_distinct(x || coalesce(y, []))), 9) AS jaccard FROM x LEFT JOIN y USING (query_id)"
)
LEDGER = (
    "WITH seqd AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events), "
    "ledger AS (SELECT user_id, seq, event_id, event_type AS kind, CASE WHEN seq % 7 IN (3, 4, 5) THEN prev END AS supersedes, ts AS recorded_at, value, event_type || '|' || event_id AS payload FROM seqd) "
)
EXECUTIONS = (
    "WITH li AS (SELECT l_orderkey AS o_orderkey, "
    + ", ".join(f"max(CASE l_returnflag WHEN 'A' THEN 'PASS' WHEN 'R' THEN 'FAIL' ELSE 'UNKNOWN' END) FILTER (l_linenumber = {k}) AS s{k}" for k in (1, 2, 3))
    + ", min(l_linestatus) AS ls FROM lineitem GROUP BY 1), "
    "o AS (SELECT orders.*, li.* EXCLUDE (o_orderkey), CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'ACCEPTED' ELSE 'REJECTED' END AS st FROM orders LEFT JOIN li USING (o_orderkey)), "
    "w AS (SELECT o_orderkey, o_custkey, st, starts_with(o_orderpriority, '1') AS imported, list_filter([CASE WHEN ls IS NULL THEN 'accepted attempt is not finished' WHEN ls = 'O' THEN 'accepted attempt is CANCELLED' END, "
    "CASE WHEN starts_with(o_orderpriority, '1') THEN 'outcome is an imported claim, not a validated outcome' END, "
    + ", ".join(f"CASE WHEN s{k} IS NULL THEN '{n}: no applicable evidence' WHEN s{k} IN ('FAIL', 'UNKNOWN') THEN '{n}: ' || s{k} END" for k, n in ((1, "BUILD"), (2, "TESTS"), (3, "REVIEW")))
    + "], lambda x: x IS NOT NULL) AS why FROM o), "
    "exec AS (SELECT o_orderkey, o_custkey, imported, CASE WHEN st = 'PENDING' THEN 'PENDING' WHEN st <> 'ACCEPTED' THEN 'NOT_ACCEPTED' WHEN len(why) = 0 THEN 'VALIDATED_ACCEPTED' ELSE 'ACCEPTED_UNVALIDATED' END AS status, "
    "CASE WHEN st = 'PENDING' THEN [] WHEN st <> 'ACCEPTED' THEN ['outcome is ' || st] ELSE why END AS reasons FROM w) "
)
LABEL = "CASE WHEN status = 'VALIDATED_ACCEPTED' THEN 'SUCCESS' WHEN status = 'NOT_ACCEPTED' AND NOT imported THEN 'FAILURE' ELSE 'UNLABELED' END"
USAGE = (
    "WITH usage AS (SELECT l_suppkey, (['INPUT_TOKENS', 'CACHED_INPUT_TOKENS', 'OUTPUT_TOKENS', 'REASONING_TOKENS', 'REQUESTS', 'TOOL_CALLS'])[l_linenumber % 6 + 1] AS kind, CAST(l_quantity AS BIGINT) AS value, "
    "CASE WHEN l_returnflag = 'A' THEN 'REPORTED' WHEN l_returnflag = 'R' THEN 'ESTIMATED' WHEN l_linestatus = 'O' THEN 'UNKNOWN' END AS provenance FROM lineitem) "
)
PRICED = (
    "WITH prices AS (SELECT p_partkey AS id, p_brand AS provider, DATE '1992-01-01' + CAST((p_partkey * 37) % 2500 AS INT) AS effective_date, CAST(round(p_retailprice, 2) AS DECIMAL(18,6)) AS price FROM part), "
    "days AS (SELECT provider, effective_date, count(DISTINCT id) AS n, min(id) AS id FROM prices GROUP BY ALL), "
    "stages AS (SELECT l_orderkey * 1000 + l_linenumber AS stage, p_brand AS provider, CAST(l_shipdate AS DATE) AS day, CAST(l_quantity AS BIGINT) AS units FROM lineitem JOIN part ON l_partkey = p_partkey), "
    "m AS (SELECT s.*, d.effective_date, d.n, CASE WHEN d.n IS NULL THEN 'NONE' WHEN d.n > 1 THEN 'AMBIGUOUS' ELSE 'FOUND' END AS match, CASE WHEN d.n = 1 THEN d.id END AS price_id FROM stages s ASOF LEFT JOIN days d ON s.provider = d.provider AND s.day >= d.effective_date), "
    "priced AS (SELECT stage, m.provider, match, price_id, m.effective_date, CAST(round_even(CAST(units AS DECIMAL(18,0)) * price * CAST(0.001 AS DECIMAL(4,3)), 6) AS DECIMAL(38,6)) AS cost FROM m LEFT JOIN prices p ON p.id = m.price_id) "
)
INTERVALS = (
    "WITH i AS (SELECT l_suppkey, epoch_us(l_shipdate) AS s, epoch_us(l_shipdate) + CAST(l_quantity * 3600e6 AS BIGINT) AS e FROM lineitem), "
    "o AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT l_suppkey, s, e FROM i) u), "
    "g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o), "
    "a AS (SELECT l_suppkey, island, max(e) - min(s) AS len FROM g GROUP BY ALL) "
    "SELECT l_suppkey, sum(e - s) / 1e6 AS effort, (max(e) - min(s)) / 1e6 AS wall, (SELECT sum(len) / 1e6 FROM a WHERE a.l_suppkey = i.l_suppkey) AS active FROM i GROUP BY l_suppkey"
)
_CAND = "WITH c AS (SELECT s_suppkey, s_nationkey, s_acctbal AS x, CASE WHEN s_suppkey % 13 <> 0 THEN CAST(s_suppkey * 7919 % 101 AS DOUBLE) END AS y, s_suppkey % 9 <> 0 AS ok FROM supplier)"
PAIRS = (
    _CAND
    + ", v AS (SELECT l.s_nationkey, l.s_suppkey AS left_ref, r.s_suppkey AS right_ref, l.ok AS lo, r.ok AS ro, "
    "CASE WHEN l.x IS NULL OR r.x IS NULL THEN 'INCONCLUSIVE' WHEN l.x = r.x THEN 'TIE' WHEN l.x < r.x THEN 'LEFT_BETTER' ELSE 'RIGHT_BETTER' END AS verdict_0, "
    "CASE WHEN l.y IS NULL OR r.y IS NULL THEN 'INCONCLUSIVE' WHEN l.y = r.y THEN 'TIE' WHEN l.y > r.y THEN 'LEFT_BETTER' ELSE 'RIGHT_BETTER' END AS verdict_1 FROM c l JOIN c r ON l.s_nationkey = r.s_nationkey AND l.s_suppkey < r.s_suppkey), "
    "pairs AS (SELECT *, CASE WHEN NOT lo AND NOT ro THEN 'NO_ELIGIBLE_EXECUTION' WHEN NOT ro THEN 'ONLY_LEFT_ELIGIBLE' WHEN NOT lo THEN 'ONLY_RIGHT_ELIGIBLE' "
    "WHEN 'LEFT_BETTER' IN (verdict_0, verdict_1) AND 'RIGHT_BETTER' IN (verdict_0, verdict_1) THEN 'TRADEOFF' WHEN 'INCONCLUSIVE' IN (verdict_0, verdict_1) THEN 'INCONCLUSIVE' "
    "WHEN 'LEFT_BETTER' IN (verdict_0, verdict_1) THEN 'LEFT_DOMINATES' WHEN 'RIGHT_BETTER' IN (verdict_0, verdict_1) THEN 'RIGHT_DOMINATES' ELSE 'EQUIVALENT' END AS conclusion FROM v) "
)
PARETO = (
    _CAND
    + " SELECT s_nationkey, CAST(s_suppkey AS VARCHAR) AS ref, CASE WHEN NOT ok THEN 'EXCLUDED' WHEN x IS NULL OR y IS NULL THEN 'UNASSESSED' "
    "WHEN EXISTS (SELECT 1 FROM c o WHERE o.ok AND o.x IS NOT NULL AND o.y IS NOT NULL AND o.s_nationkey = c.s_nationkey AND o.s_suppkey <> c.s_suppkey AND o.x <= c.x AND o.y >= c.y AND (o.x < c.x OR o.y > c.y)) THEN 'DOMINATED' ELSE 'FRONT' END AS state FROM c"
)
ARMS = (
    "WITH e AS (SELECT label AS query_id, vec_id AS sample_id, CAST(embedding[1] AS DOUBLE) AS ts, CAST(embedding[2] AS DOUBLE) AS ac FROM embeddings), "
    "tt AS (SELECT query_id, sample_id, CASE WHEN max(ts) OVER w = min(ts) OVER w THEN 0 ELSE (ts - min(ts) OVER w) / (max(ts) OVER w - min(ts) OVER w) END AS t FROM e WHERE sample_id % 7 <> 0 WINDOW w AS (PARTITION BY query_id)), "
    "aa AS (SELECT query_id, sample_id, CASE WHEN max(ac) OVER w = min(ac) OVER w THEN 0 ELSE (ac - min(ac) OVER w) / (max(ac) OVER w - min(ac) OVER w) END AS a FROM e WHERE sample_id % 11 <> 0 AND query_id % 4 <> 3 WINDOW w AS (PARTITION BY query_id)), "
    "aligned AS (SELECT e.query_id, e.sample_id, t, a, CASE WHEN t IS NOT NULL AND a IS NOT NULL THEN 'BOTH_AVAILABLE' WHEN t IS NOT NULL THEN 'ACOUSTIC_FEATURE_MISSING' WHEN a IS NOT NULL THEN 'TRANSCRIPT_MISSING' ELSE 'BOTH_MISSING' END AS availability "
    "FROM e LEFT JOIN tt USING (query_id, sample_id) LEFT JOIN aa USING (query_id, sample_id)) "
)
POLICY = (
    ", r AS (SELECT query_id, CASE WHEN bool_and(availability = 'BOTH_AVAILABLE') THEN 'FUSED' WHEN bool_and(t IS NOT NULL) THEN 'DEFERRED_TO_TRANSCRIPT' WHEN bool_and(a IS NOT NULL) THEN 'DEFERRED_TO_ACOUSTIC' ELSE 'ABSTAINED' END AS route FROM aligned WHERE availability <> 'BOTH_MISSING' GROUP BY 1), "
    "s AS (SELECT query_id, sample_id, CASE route WHEN 'FUSED' THEN 0.5 * t + 0.5 * a WHEN 'DEFERRED_TO_TRANSCRIPT' THEN t WHEN 'DEFERRED_TO_ACOUSTIC' THEN a END AS score, route FROM aligned JOIN r USING (query_id)) "
    "SELECT query_id, sample_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sample_id) AS rank, route FROM s WHERE score IS NOT NULL"
)
CONTRIBUTIONS = (
    PHRASED
    + f", t AS (SELECT query_id, 'ORIGINAL' AS source, unnest({tokens('norm')}) AS term, 1.0::DOUBLE AS weight FROM expanded "
    f"UNION ALL SELECT query_id, 'EXPANSION', unnest({tokens(joined('exp'))}), 0.25::DOUBLE FROM expanded), "
    "g AS (SELECT query_id, source, term, weight, count(*) AS occurrences, sum(weight) AS total FROM t GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, source, term) AS place FROM g) SELECT * FROM r WHERE place <= 10"
)
STRESS = (
    "CASE WHEN fr IS NULL THEN 'NOT_RETRIEVED' WHEN fs = 0 THEN 'ZERO_SIMILARITY_ONLY' WHEN fr > 3 THEN 'NOT_IN_TOP_K' WHEN fr > 1 THEN 'OUTRANKED' WHEN found < n THEN 'PARTIAL_RECALL' ELSE 'RESOLVED' END AS reason "
    "FROM (SELECT a.vec_id AS query_id, count(*) AS n FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1) LEFT JOIN "
    "(SELECT query_id, min(rank) AS fr, max(score) AS fs, count(*) FILTER (rank <= 3 AND score > 0) AS found FROM (SELECT k.query_id, k.score, row_number() OVER (PARTITION BY k.query_id ORDER BY k.rank) AS rank, "
    "a.label = b.label AS rel FROM knn k JOIN embeddings a ON a.vec_id = k.query_id JOIN embeddings b ON b.vec_id = k.atom_id WHERE k.rank <= 6 AND k.query_id <> k.atom_id) WHERE rel AND rank <= 5 GROUP BY 1) USING (query_id)"
)


def spoiled_sweep(grid, k: int) -> str:
    return (
        f", sp AS (SELECT query_id, rank, CASE WHEN query_id % 5 = 0 AND rank = 4 THEN score + 0.5 ELSE score END AS score FROM knn WHERE rank <= {k}), g AS (SELECT unnest([{', '.join(f'{g}::DOUBLE' for g in grid)}]) AS threshold), "
        "n AS (SELECT query_id, threshold, count(*) FILTER (score >= threshold) AS n, coalesce(max(rank) FILTER (score >= threshold), 0) AS last FROM sp, g GROUP BY ALL), "
        "f AS (SELECT query_id, threshold, CASE WHEN last <> n THEN 'NOT_A_PREFIX' WHEN n > lag(n) OVER (PARTITION BY query_id ORDER BY threshold) THEN 'NOT_MONOTONIC' END AS finding FROM n) SELECT * FROM f WHERE finding IS NOT NULL"
    )


KEY_STRATEGIES = (
    PHRASED.removesuffix(" ").replace("n AS (SELECT *,", "two AS (SELECT query_id, 0 AS side, text FROM q UNION ALL SELECT query_id, 1, CASE query_id % 3 WHEN 0 THEN 'of the ' || text || ' !' WHEN 1 THEN text || ' zebra' ELSE upper(text) || ' cache' END FROM q), n AS (SELECT *,", 1).replace("AS norm FROM q)", "AS norm FROM two)", 1).replace("expanded AS (SELECT query_id, text,", "expanded AS (SELECT query_id, side, text,", 1)
    + f", k AS (SELECT query_id, side, text, CASE WHEN trim(norm) = '' THEN text ELSE 'normalized:' || norm END AS nk, {lexical_key()} AS lk FROM expanded) "
    "SELECT a.query_id AS id, a.text = b.text AS exact_match, a.nk = b.nk AS normalized_match, a.lk = b.lk AS lexical_match FROM k a JOIN k b USING (query_id) WHERE a.side = 0 AND b.side = 1"
)
