"""Registered queries over recall, rankings, judgments, modalities, stores and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text, vectors
from ..operators import chunk, fusion, index, judging, metrics, recall, stats
from ..operators.prefix import Running, running
from ..sources import segments, speech, stores
from . import drivers, oracle
from .catalog import arms, feedback_of, knn, per_query, pooled, query, read, reranked

# -- recall --------------------------------------------------------------------------------------------------------------------

_ALIASES = "SELECT DISTINCT text, unnest(['alias' || (doc_id % 7), CASE WHEN doc_id % 5 = 0 THEN 'the Similarity Search' ELSE 'Lookups of ' || lang END]) AS alias FROM documents WHERE text IS NOT NULL"


@query(oracle.recall(8, 0.0, aliases=_ALIASES, asked="text || ' alias' || (item_id % 7) || ' nearest'"))
def recall_aliases(spark, d):
    """Atoms with aliases, whose tokens and expansions count less than the content's; equal texts unite their aliases."""
    k = F.col("doc_id")
    al = F.array(F.concat(F.lit("alias"), (k % 7).cast("string")), F.when(k % 5 == 0, "the Similarity Search").otherwise(F.concat(F.lit("Lookups of "), "lang")))
    a = recall.atoms(read(spark, d, "documents").withColumn("al", al), "text", "doc_id", "al")
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" alias"), (F.col("item_id") % 7).cast("string"), F.lit(" nearest")).alias("text"))
    return recall.recall(a, q, 8, 0.0, digits=6)


@query(oracle.recall(5, 0.0, where="doc_id % 3 <> 0"))
def recall_orphans(spark, d):
    """Vectors of all documents, but atoms of two thirds: a vector whose atom is gone is no result."""
    docs = read(spark, d, "documents")
    stored = recall.encoded(recall.atoms(docs, "text", "doc_id"), "atom_id", F.col("content"))
    known = recall.atoms(docs.where("doc_id % 3 <> 0"), "text", "doc_id")
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text").where(F.trim(text.normalized(F.col("text"))) != "")
    return recall.scan(recall.known_only(stored, known), recall.encoded(asked, "query_id", F.col("text")), 5, 0.0, 6)


@query(oracle.KNN + "SELECT query_id, rank, atom_id, score FROM knn WHERE rank <= 4 AND score >= 0.2")
def retained_prefix(spark, d):
    return recall.retained(knn(spark, d, 10), 0.2, 4)


@query("WITH t AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] * p[2] AS DOUBLE)) AS x FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), s AS (SELECT a, b, list_filter(x, lambda v: v <> 0) AS x FROM p) SELECT a, b, round(list_sum(x), 6) AS score, round(list_sum(list_transform(list_reverse_sort(list_transform(x, lambda v: {'m': abs(v), 'v': v}))[1:8], lambda s: s.v)), 6) AS covered, round(list_sum(x) - list_sum(list_transform(list_reverse_sort(list_transform(x, lambda v: {'m': abs(v), 'v': v}))[1:8], lambda s: s.v)), 6) AS residual, len(x) AS shared, len(list_filter(x, lambda v: v < 0)) AS opposed FROM s")
def cosine_decomposition(spark, d):
    e = read(spark, d, "embeddings")
    p = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("vb")), "a")
    t = vectors.decomposition(p, "va", "vb", 8)
    return t.select("a", "b", *(F.round(c, 6).alias(c) for c in ("score", "covered", "residual")), F.col("shared").cast("long").alias("shared"), F.col("opposed").cast("long").alias("opposed"))


@query("WITH c AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL), v AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) SELECT vec_id, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 6) AS near FROM v JOIN c USING (label, pos) GROUP BY vec_id")
def centroid_nearness(spark, d):
    return vectors.centroid_cosine(read(spark, d, "embeddings"), "embedding", "label").select("vec_id", F.round("near", 6).alias("near"))


_WANTED = ", w AS (SELECT vec_id AS query_id, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS label FROM embeddings) "


@query(oracle.KNN + _WANTED + "SELECT w.query_id, w.label, k.score, k.rank FROM w JOIN knn k ON k.query_id = w.query_id AND k.atom_id = w.label")
def full_corpus_ranks(spark, d):
    """Where a wanted item stands among all, for every query."""
    e = read(spark, d, "embeddings")
    n = e.count()
    asked = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    wanted = e.select(F.col("vec_id").alias("query_id"), ((F.col("vec_id") * 7 + 3) % n).alias("atom_id"))
    t = recall.ranks(e.select(F.col("vec_id").alias("atom_id"), F.col("embedding").alias("vec")), asked, wanted, 6)
    return t.select("query_id", F.col("atom_id").alias("label"), "score", "rank")


@query(oracle.KNN + ", w AS (SELECT vec_id AS query_id, unnest([vec_id, (vec_id + 1) % (SELECT count(*) FROM embeddings)]) AS label FROM embeddings) SELECT query_id, label FROM w WHERE NOT EXISTS (SELECT 1 FROM knn WHERE rank <= 5 AND knn.query_id = w.query_id AND knn.atom_id = w.label)")
def missed_atoms(spark, d):
    e = read(spark, d, "embeddings")
    wanted = e.select(F.col("vec_id").alias("query_id"), F.explode(F.array(F.col("vec_id"), (F.col("vec_id") + 1) % e.count())).alias("label"))
    return judging.missed(knn(spark, d, 5).withColumnRenamed("atom_id", "label"), wanted, 5)


@query(f"WITH b AS (SELECT item_id, string_split({oracle.normalized('text')}, ' ') AS t FROM benchmark), dd AS (SELECT doc_id, string_split({oracle.normalized('text')}, ' ') AS t FROM documents) SELECT item_id, doc_id, array_to_string(list_sort(list_distinct(list_filter(b.t, lambda w: w <> '' AND list_contains(dd.t, w)))), ' ') AS shared FROM b JOIN dd ON dd.doc_id = b.item_id")
def term_overlap(spark, d):
    b = read(spark, d, "benchmark").withColumnRenamed("text", "q")
    return b.join(read(spark, d, "documents"), F.col("doc_id") == F.col("item_id")).select("item_id", "doc_id", F.array_join(judging.overlap(F.col("q"), F.col("text")), " ").alias("shared"))


@query(oracle.RERANKED + ", j AS (SELECT coalesce(k.query_id, r.query_id) AS query_id, k.rank AS b, r.rank AS a FROM (SELECT * FROM knn WHERE rank <= 5) k FULL JOIN reranked r ON r.query_id = k.query_id AND r.atom_id = k.atom_id) SELECT query_id, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS kept, count(*) FILTER (b IS NULL) AS entered, count(*) FILTER (a IS NULL) AS left, count(*) FILTER (a <> b) AS moved FROM j GROUP BY 1")
def ranking_shift(spark, d):
    best = pooled(spark, d)
    return judging.ranking_shift(best, reranked(spark, d, best), 5)


# -- judged rankings -----------------------------------------------------------------------------------------------------------

_SPLIT = "CASE WHEN vec_id % 3 = 0 THEN 'HOLDOUT' ELSE 'DEV' END"


@query(oracle.PER_QUERY + f", p AS (SELECT p.*, {_SPLIT} AS split, 'c' || label AS category, label % 4 <> 0 AS answerable, n_returned % 6 AS returned, vec_id % 3 AS confounders, vec_id % 5 AS unjudged FROM per_query p JOIN embeddings ON vec_id = query_id), g AS (SELECT 'ALL' AS grouping, '' AS value, * FROM p UNION ALL SELECT 'split', split, * FROM p UNION ALL SELECT 'category', category, * FROM p) SELECT grouping, value, count(*) AS queries, count(*) FILTER (answerable) AS answerable, round(avg(CASE WHEN answerable THEN p_at_1 END), 9) AS avg_p_at_1, round(avg(CASE WHEN answerable THEN r_at_5 END), 9) AS avg_r_at_5, round(avg(CASE WHEN answerable THEN rr END), 9) AS mrr, count(*) FILTER (NOT answerable AND returned = 0) AS abstained, sum(confounders) AS confounders, sum(unjudged) AS unjudged FROM g GROUP BY ALL")
def partition_metrics(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 3 == 0, "HOLDOUT").otherwise("DEV").alias("split"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"), (F.col("label") % 4 != 0).alias("answerable"), (F.col("vec_id") % 3).alias("confounders"), (F.col("vec_id") % 5).alias("unjudged"))
    t = judging.partitions(per_query(spark, d).withColumn("returned", F.col("n_returned") % 6).join(e, "query_id"))
    return t.select("grouping", "value", "queries", "answerable", *(F.round(c, 9).alias(c) for c in ("avg_p_at_1", "avg_r_at_5", "mrr")), "abstained", "confounders", "unjudged")


@query(oracle.KNN + ", h AS (SELECT query_id, rank, CASE (query_id + atom_id) % 4 WHEN 0 THEN 'E2' WHEN 1 THEN 'C0' ELSE 'U' END AS j FROM knn WHERE rank <= 5) SELECT query_id, max(CASE WHEN j LIKE 'E%' AND rank <= 1 THEN 1 ELSE 0 END) AS hit_at_1, max(CASE WHEN j LIKE 'E%' AND rank <= 3 THEN 1 ELSE 0 END) AS hit_at_3, max(CASE WHEN j LIKE 'E%' THEN 1 ELSE 0 END) AS hit_at_5, round(coalesce(1.0 / min(CASE WHEN j LIKE 'E%' THEN rank END), 0), 6) AS rr, max(CASE WHEN j <> 'C0' AND rank <= 1 THEN 1 ELSE 0 END) AS upper_hit_at_1, max(CASE WHEN j <> 'C0' AND rank <= 3 THEN 1 ELSE 0 END) AS upper_hit_at_3, max(CASE WHEN j <> 'C0' THEN 1 ELSE 0 END) AS upper_hit_at_5, round(coalesce(1.0 / min(CASE WHEN j <> 'C0' THEN rank END), 0), 6) AS upper_rr FROM h GROUP BY 1")
def judgment_bounds(spark, d):
    j = (F.col("query_id") + F.col("atom_id")) % 4
    h = knn(spark, d, 5).withColumn("judgment", F.when(j == 0, "E2").when(j == 1, "C0").otherwise("U"))
    return judging.bounds(h).withColumn("rr", F.round("rr", 6)).withColumn("upper_rr", F.round("upper_rr", 6))


@query(oracle.KNN + ", q AS (SELECT vec_id AS query_id, 'p' || (label % 3) AS partition, label % 4 <> 0 AS answerable FROM embeddings), t AS (SELECT q.*, cut, k.rank, k.atom_id FROM q CROSS JOIN (VALUES (1), (3), (10)) c(cut) LEFT JOIN (SELECT * FROM knn WHERE rank <= 10 AND score >= 0.35 AND query_id <> atom_id) k ON k.query_id = q.query_id AND k.rank <= cut), u AS (SELECT partition, cut, query_id, count(atom_id) AS n, coalesce(bool_or(rank = 1 AND NOT answerable), FALSE) AS top FROM t GROUP BY ALL) SELECT u.partition, u.cut, count(*) AS queries, count(*) FILTER (n = 0) AS zero_hit, CAST(sum(n) AS BIGINT) AS occurrences, count(*) FILTER (top) AS top1_no_answer, (SELECT count(DISTINCT atom_id) FROM t WHERE t.partition = u.partition AND t.cut = u.cut) AS atoms FROM u GROUP BY u.partition, u.cut")
def hub_partitions(spark, d):
    q = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("p"), (F.col("label") % 3).cast("string")).alias("partition"), (F.col("label") % 4 != 0).alias("answerable"))
    return judging.hubs(knn(spark, d, 10).where("score >= 0.35 AND query_id <> atom_id"), q)


@query(oracle.PER_QUERY + ", p AS (SELECT p.*, CASE label % 3 WHEN 0 THEN 'CONTROL' WHEN 1 THEN 'DYSARTHRIC' END AS condition, 'T' || (label % 2) AS task FROM per_query p JOIN embeddings ON vec_id = query_id), g AS (SELECT 'ALL' AS grouping, '' AS value, * FROM p UNION ALL SELECT 'condition', coalesce(condition, 'UNKNOWN'), * FROM p UNION ALL SELECT 'task', task, * FROM p) SELECT grouping, value, count(*) AS queries, round(avg(hit_at_3), 9) AS avg_hit_at_3, round(avg(r_at_5), 9) AS avg_r_at_5, round(avg(rr), 9) AS mrr FROM g GROUP BY ALL")
def speech_group_metrics(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.when(F.col("label") % 3 == 0, "CONTROL").when(F.col("label") % 3 == 1, "DYSARTHRIC").alias("condition"), F.concat(F.lit("T"), (F.col("label") % 2).cast("string")).alias("task"))
    t = judging.speech_metrics(per_query(spark, d).join(e, "query_id"), "condition", "task")
    return t.select("grouping", "value", "queries", *(F.round(c, 9).alias(c) for c in ("avg_hit_at_3", "avg_r_at_5", "mrr")))


@query(oracle.KNN + ", h AS (SELECT query_id, atom_id AS key, rank FROM knn WHERE rank <= 10), b AS (SELECT *, key % 9 = 0 AS hub, row_number() OVER (PARTITION BY query_id ORDER BY rank, key) AS b FROM h), s1 AS (SELECT *, CASE WHEN b = 1 THEN 'TOP1' WHEN rank <= 3 THEN 'TOP3' END AS st FROM b), u AS (SELECT *, CASE WHEN st IS NULL AND hub AND row_number() OVER (PARTITION BY query_id, st IS NULL AND hub ORDER BY rank, key) = 1 THEN 'HUB' ELSE st END AS s2 FROM s1), v AS (SELECT *, row_number() OVER (PARTITION BY query_id, s2 IS NULL ORDER BY sha256('seed:' || query_id || ':' || key)) AS drawn FROM u), w AS (SELECT query_id, key, CASE WHEN s2 IS NULL AND drawn <= 2 THEN 'SAMPLE' ELSE s2 END AS stratum, rank FROM v) SELECT * FROM w WHERE stratum IS NOT NULL")
def judgment_strata(spark, d):
    h = knn(spark, d, 10).select("query_id", F.col("atom_id").alias("key"), "rank")
    hubs = read(spark, d, "embeddings").where("vec_id % 9 = 0").select(F.col("vec_id").alias("key"))
    return judging.strata(h, hubs, 2, "seed")


@query("WITH j AS (SELECT doc_id % 50 AS query_id, doc_id % 20 AS key, CASE WHEN doc_id % 7 = 0 THEN 'CONFOUNDER' ELSE 'EVIDENCE' END AS role, doc_id % 3 AS grade FROM documents), g AS (SELECT query_id, key, bool_or(role = 'EVIDENCE' AND grade > 0) AS e, bool_or(role = 'CONFOUNDER') AS c FROM j WHERE query_id % 3 <> 0 GROUP BY ALL) SELECT query_id, key, CASE WHEN e THEN 'POSITIVE' ELSE 'NEGATIVE' END AS signal, CASE WHEN e THEN 0.5 ELSE -0.5 END AS delta FROM g WHERE e <> c")
def feedback_plan(spark, d):
    k = F.col("doc_id")
    j = read(spark, d, "documents").select((k % 50).alias("query_id"), (k % 20).alias("key"), F.when(k % 7 == 0, "CONFOUNDER").otherwise("EVIDENCE").alias("role"), (k % 3).alias("grade"))
    q = j.select("query_id").distinct().withColumn("split", F.when(F.col("query_id") % 3 == 0, "HOLDOUT").otherwise("DEV"))
    return judging.feedback_plan(j, q)


_BOOK = "WITH ev AS (SELECT DISTINCT vec_id AS query_id, 'k' || ((vec_id * 3) % 40) AS key, (vec_id * 3) % 40 AS ordinal FROM embeddings UNION SELECT vec_id, 'k' || ((vec_id * 5 + 1) % 40), (vec_id * 5 + 1) % 40 FROM embeddings WHERE vec_id % 2 = 0), cf AS (SELECT DISTINCT vec_id AS query_id, 'k' || ((vec_id * 11 + 2) % 40) AS key FROM embeddings), q AS (SELECT vec_id AS query_id, vec_id % 8 <> 0 AS answerable FROM embeddings), r AS (SELECT vec_id AS query_id, rank, 'k' || ((vec_id * rank + rank) % 40) AS key, (vec_id * rank + rank) % 40 AS ordinal FROM embeddings, range(1, 6) t(rank) WHERE vec_id % 16 <> 0) "


@query(_BOOK + ", n AS (SELECT query_id, ordinal - 1 AS ordinal FROM ev UNION SELECT query_id, ordinal + 1 FROM ev), t AS (SELECT r.query_id, r.rank, r.key, ev.key IS NOT NULL AS e, cf.key IS NOT NULL AS c, n.ordinal IS NOT NULL AS x FROM r LEFT JOIN ev USING (query_id, key) LEFT JOIN cf USING (query_id, key) LEFT JOIN n ON n.query_id = r.query_id AND n.ordinal = r.ordinal), g AS (SELECT query_id, count(*) AS n, min(rank) FILTER (e) AS e, min(rank) FILTER (c) AS c, min(rank) FILTER (x) AS x, count(DISTINCT CASE WHEN e THEN key END) AS found FROM t GROUP BY 1), w AS (SELECT query_id, count(DISTINCT key) AS want FROM ev GROUP BY 1) SELECT q.query_id, CASE WHEN NOT answerable AND coalesce(g.n > 0, FALSE) THEN 'FALSE_POSITIVE' WHEN NOT answerable THEN 'ABSTAINED' WHEN e IS NULL THEN 'NO_RELEVANT_RESULT' WHEN c < e THEN 'DISTRACTOR' WHEN x < e THEN 'CHUNK_BOUNDARY_GAP' WHEN e > 1 THEN 'WRONG_RANK' WHEN found = want THEN 'NONE' ELSE 'MULTI_EVIDENCE_GAP' END AS failure FROM q LEFT JOIN g USING (query_id) LEFT JOIN w USING (query_id)")
def book_failures(spark, d):
    v = F.col("vec_id")
    e = read(spark, d, "embeddings").select("vec_id")
    name = lambda x: F.concat(F.lit("k"), x.cast("string"))
    side = lambda t, x, role: t.select(v.alias("query_id"), name(x).alias("key"), x.alias("ordinal"), F.lit(1).alias("grade"), F.lit(role).alias("role"))
    j = side(e, (v * 3) % 40, "EVIDENCE").unionByName(side(e.where("vec_id % 2 = 0"), (v * 5 + 1) % 40, "EVIDENCE")).unionByName(side(e, (v * 11 + 2) % 40, "CONFOUNDER"))
    x = (v * F.col("rank") + F.col("rank")) % 40
    r = e.where("vec_id % 16 <> 0").withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(5)))).select(v.alias("query_id"), "rank", name(x).alias("key"), x.alias("ordinal"))
    return metrics.book_failure(r, j, e.select(v.alias("query_id"), (v % 8 != 0).alias("answerable")))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ISOLATED_NO_TRANSFER' WHEN doc_id % 3 = 0 THEN 'INTENDED_TRANSFER' WHEN doc_id % 5 = 0 THEN 'CONTAMINATION' ELSE 'SHARED_KEY_NO_MOVEMENT' END AS transfer, CASE WHEN doc_id % 3 = 0 THEN 'SAFE_EQUIVALENT_SHARING' WHEN doc_id % 2 = 0 THEN 'SAFE_ISOLATION' WHEN doc_id % 5 = 0 THEN 'CONTAMINATION' ELSE 'COLLISION_WITHOUT_MOVEMENT' END AS stress FROM documents")
def feedback_classes(spark, d):
    k = F.col("doc_id")
    return read(spark, d, "documents").select("doc_id", metrics.key_transfer(k % 3 == 0, k % 2 != 0, k % 5 == 0).alias("transfer"), metrics.normalized_stress(k % 3 == 0, (k % 2 != 0) | (k % 3 == 0), k % 5 == 0).alias("stress"))


@query("SELECT lang, CASE WHEN bool_or(doc_id % 3 <> 0 AND doc_id % 97 = 5) THEN 'NORMALIZED_STRESS_RISK' WHEN bool_and(doc_id % 3 <> 0 OR doc_id % 91 <> 6) AND bool_or(doc_id % 3 = 0 AND doc_id % 5 = 0) THEN 'NORMALIZED_STRESS_PASS' ELSE 'INCONCLUSIVE' END AS decision FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def stress_decisions(spark, d):
    """The decision over the cases of each language."""
    k = F.col("doc_id")
    t = read(spark, d, "documents").where("lang IS NOT NULL").select("lang", F.when(k % 3 == 0, "EQUIVALENT").otherwise("DISTINCT").alias("relationship"), F.when(k % 3 == 0, k % 91 != 6).otherwise(k % 97 == 5).alias("key_matched"), (k % 5 == 0).alias("moved"))
    return metrics.stress_decision(t, "lang")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'BOTH_SUCCEED' WHEN doc_id % 2 = 0 THEN 'TRANSCRIPT_ONLY' WHEN doc_id % 3 = 0 THEN 'ACOUSTIC_ONLY' ELSE 'BOTH_FAIL' END AS outcome, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'BOTH_SUCCEED_RETAINED' ELSE 'LOST_BOTH_SUCCEED' END WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'RECOVERED_ACOUSTIC_MISS' ELSE 'LOST_TRANSCRIPT_WIN' END WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'RECOVERED_TRANSCRIPT_MISS' ELSE 'LOST_ACOUSTIC_WIN' END ELSE CASE WHEN doc_id % 5 = 0 THEN 'RECOVERED_BOTH_MISS' ELSE 'BOTH_MISS_RETAINED' END END AS disagreement FROM documents")
def modality_disagreements(spark, d):
    k = F.col("doc_id")
    o = fusion.modality_outcome(k % 2 == 0, k % 3 == 0)
    return read(spark, d, "documents").select("doc_id", o.alias("outcome"), fusion.disagreement(o, k % 5 == 0).alias("disagreement"))


@query("WITH c AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'ORPHAN_VECTOR' WHEN vec_id % 7 = 0 THEN 'INCOMPATIBLE_DIMENSIONS' WHEN label % 3 <> 0 THEN 'METADATA_FILTERED' ELSE 'SCORED' END AS candidate FROM embeddings) SELECT vec_id, candidate, CASE WHEN vec_id % 13 = 0 THEN 'MISSING_SAMPLE' WHEN vec_id % 17 = 0 THEN 'MISSING_VECTOR' WHEN candidate <> 'SCORED' THEN candidate WHEN vec_id % 10 < 4 THEN 'RETRIEVED_AT_K' ELSE 'SCORED_BELOW_K' END AS retrieval FROM c")
def candidate_statuses(spark, d):
    v = F.col("vec_id")
    failed = fusion.failed_filters(CONDITION=(F.col("label") % 3, 0), LANGUAGE=(F.lit("en"), None))
    t = read(spark, d, "embeddings").select("vec_id", fusion.candidate_status(F.when(v % 11 != 0, v), F.when(v % 7 == 0, 32).otherwise(64), F.lit(64), failed).alias("candidate"))
    return t.withColumn("retrieval", fusion.retrieval_status(F.when(v % 13 != 0, v), F.when(v % 17 != 0, F.col("candidate")), v % 10 + 1, 4))


@query(oracle.KNN + ", p AS (SELECT query_id, score, lag(score) OVER (PARTITION BY query_id ORDER BY score DESC, atom_id) AS prev, rank FROM knn WHERE rank <= 10) SELECT query_id, count(*) AS results, min(score) AS min_score, round(avg(score), 6) AS mean_score, max(score) AS max_score, count(*) FILTER (prev = score) AS ties, round(max(CASE WHEN rank = 2 THEN prev - score END), 6) AS top_gap FROM p GROUP BY 1")
def ranking_diagnostics(spark, d):
    t = fusion.diagnostics(knn(spark, d, 10), "query_id", item="atom_id")
    return t.withColumn("mean_score", F.round("mean_score", 6)).withColumn("top_gap", F.round("top_gap", 6))


@query(
    oracle.PER_QUERY
    + ", m AS (SELECT avg(rr) AS mrr, avg(hit_at_1) AS hit, avg(r_at_5) AS recall, avg(p_at_1) AS precision FROM per_query), v AS (SELECT 'mrr' AS name, mrr AS value, abs(mrr - 0.75) <= 0.2 AS ok FROM m UNION ALL SELECT 'hit', hit, hit >= 0.95 - 0.01 FROM m UNION ALL SELECT 'recall', recall, recall >= 0.05 FROM m UNION ALL SELECT 'precision', precision, abs(precision - 0.1) <= 0.05 FROM m UNION ALL SELECT 'absent', NULL, FALSE) SELECT name, round(value, 9) AS value, ok FROM v"
)
def protected_baseline(spark, d):
    """The averages of all queries against expected values, exact within a tolerance or at least; one was never measured."""
    a = metrics.averages(per_query(spark, d))
    names = (("mrr", "mrr"), ("hit", "avg_hit_at_1"), ("recall", "avg_r_at_5"), ("precision", "avg_p_at_1"))
    got = a.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in names))).alias("m")).select("m.*")
    want = [("mrr", "EXACT", 0.75, 0.2), ("hit", "MINIMUM", 0.95, 0.01), ("recall", "MINIMUM", 0.05, 0.0), ("precision", "EXACT", 0.1, 0.05), ("absent", "MINIMUM", 0.0, 0.0)]
    return metrics.baseline_check(got, spark.createDataFrame(want, "name string, mode string, expected double, tolerance double")).select("name", F.round("value", 9).alias("value"), "ok")


@query("SELECT event_type, count(*) AS n, CAST(min(floor(value)) AS BIGINT) AS min, CAST(max(floor(value)) AS BIGINT) AS max, CAST(floor(sum(floor(value)) / count(*)) AS BIGINT) AS avg, CAST(sum(event_id % 100) AS BIGINT) AS scanned FROM events GROUP BY 1")
def latency_summary(spark, d):
    t = read(spark, d, "events").select("event_type", F.floor("value").alias("v"), (F.col("event_id") % 100).alias("scanned"))
    return stats.summary(t, "v", "scanned", "event_type")


@query(oracle.ARMS + ", b AS (SELECT query_id, sample_id, 0.5 * t + 0.5 * a AS f, t AS c FROM aligned WHERE t IS NOT NULL AND a IS NOT NULL) SELECT 'p' || (query_id % 3) AS profile, count(*) AS queries, round(avg(f), 9) AS mean, round(avg(c), 9) AS control, count(*) FILTER (f - c > 1e-12) AS wins, count(*) FILTER (abs(f - c) <= 1e-12) AS maintained, count(*) FILTER (c - f > 1e-12) AS regressed, count(*) FILTER (c >= 0.5 AND NOT f >= 0.5) AS lost_hits, round(avg(f) - avg(c), 9) AS delta, avg(f) - avg(c) > 1e-12 AND count(*) FILTER (c >= 0.5 AND NOT f >= 0.5) = 0 AS promising FROM b GROUP BY 1")
def hybrid_profiles(spark, d):
    al = fusion.aligned(*arms(spark, d)).where("t IS NOT NULL AND a IS NOT NULL")
    f = F.lit(0.5) * F.col("t") + F.lit(0.5) * F.col("a")
    rows = al.select(F.concat(F.lit("p"), (F.col("query_id") % 3).cast("string")).alias("profile"), "query_id", f.alias("hybrid"), F.col("t").alias("control"), (f >= 0.5).alias("hybrid_hit"), (F.col("t") >= 0.5).alias("control_hit"))
    t = judging.hybrid_summary(rows)
    return t.select("profile", "queries", *(F.round(c, 9).alias(c) for c in ("mean", "control", "delta")), "wins", "maintained", "regressed", "lost_hits", "promising")


@query("WITH c AS (SELECT doc_id, doc_id % 9 AS b, doc_id % 5 AS a FROM documents) SELECT doc_id, CASE WHEN b = 0 AND a = 0 THEN 'NOT_SCORED' WHEN (CASE a WHEN 0 THEN 99 ELSE a END) < (CASE b WHEN 0 THEN 99 ELSE b END) THEN CASE WHEN doc_id % 4 = 0 THEN 'MIXED' ELSE 'IMPROVED' END WHEN (CASE a WHEN 0 THEN 99 ELSE a END) > (CASE b WHEN 0 THEN 99 ELSE b END) OR doc_id % 4 = 0 THEN 'REGRESSED' ELSE 'UNCHANGED' END AS effect FROM c")
def expansion_effects(spark, d):
    k = F.col("doc_id")
    none = lambda x: F.when(x != 0, x)
    return read(spark, d, "documents").select("doc_id", judging.effect(none(k % 9), none(k % 5), k % 4 == 0).alias("effect"))


# -- stores and sources --------------------------------------------------------------------------------------------------------


@query("SELECT lang || (doc_id % 50) AS id, arg_max(n_chars, doc_id) AS n_chars, min(doc_id) AS seq FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def last_wins_atoms(spark, d):
    t = read(spark, d, "documents").where("lang IS NOT NULL").select(F.concat("lang", (F.col("doc_id") % 50).cast("string")).alias("id"), "n_chars", F.col("doc_id").alias("seq"))
    return stores.last_wins(t)


@query("SELECT label AS atom_id, round(CAST(arg_min(embedding[1], vec_id) AS DOUBLE), 6) AS x FROM embeddings WHERE label IS NOT NULL GROUP BY 1")
def first_vectors(spark, d):
    t = read(spark, d, "embeddings").where("label IS NOT NULL").select(F.col("label").alias("atom_id"), F.col("vec_id").alias("version"), F.col("embedding").alias("vec"))
    return stores.first_version(t).select("atom_id", F.round(F.get("vec", F.lit(0)).cast("double"), 6).alias("x"))


@query("WITH o AS (SELECT doc_id, ['a' || (doc_id % 3), 'b'] AS old, ['b', 'a' || (doc_id % 4), lang] AS new FROM documents WHERE lang IS NOT NULL) SELECT doc_id AS id, array_to_string(CASE WHEN doc_id % 5 = 0 THEN new ELSE old || list_filter(new, lambda x: NOT list_contains(old, x)) END, ',') AS aliases, TRUE AS changed FROM o")
def merged_aliases(spark, d):
    """What is stored comes first; a fifth of the atoms is new."""
    k = F.col("doc_id")
    t = read(spark, d, "documents").where("lang IS NOT NULL")
    stored = t.where(k % 5 != 0).select(k.alias("id"), F.array(F.concat(F.lit("a"), (k % 3).cast("string")), F.lit("b")).alias("aliases"))
    new = t.select(k.alias("id"), F.array(F.lit("b"), F.concat(F.lit("a"), (k % 4).cast("string")), F.col("lang")).alias("aliases"))
    return stores.merge_aliases(stored, new).withColumn("aliases", F.array_join("aliases", ","))


@query(f"SELECT DISTINCT {oracle.content_id('text')} AS id FROM documents d WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0)")
def remembered(spark, d):
    """Texts that are new to a store with every second document."""
    t = read(spark, d, "documents").where("text IS NOT NULL")
    stored = t.where("doc_id % 2 = 0").select(ids.content_id(F.col("text")).alias("id"))
    return stores.remember(t.select(F.col("text").alias("content")), stored).select("id")


_EDGE = r"^[\s\x{85}\x{A0}]|[\s\x{85}\x{A0}]$"


@query(rf"WITH v AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url || ' ' WHEN 1 THEN '' WHEN 2 THEN url || chr(7) WHEN 3 THEN repeat('x', 130) ELSE url END AS x FROM pages WHERE url IS NOT NULL) SELECT page_id, x <> '' AND length(x) <= 128 AND NOT regexp_matches(x, '\p{{Cc}}') AND NOT regexp_matches(x, '{_EDGE}') AS identifier, x <> '' AND length(x) <= 512 AND NOT regexp_matches(x, '\p{{Cc}}') AND NOT regexp_matches(x, '{_EDGE}') AS opaque FROM v")
def valid_identifiers(spark, d):
    k = F.col("page_id") % 6
    x = F.when(k == 0, F.concat("url", F.lit(" "))).when(k == 1, "").when(k == 2, F.concat("url", F.lit("\a"))).when(k == 3, F.repeat(F.lit("x"), F.lit(130))).otherwise(F.col("url"))
    return read(spark, d, "pages").where("url IS NOT NULL").select("page_id", ids.valid_identifier(x).alias("identifier"), ids.valid_opaque(x).alias("opaque"))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN lang IS DISTINCT FROM 'en' THEN 'LANGUAGE' END, CASE WHEN doc_id % 3 <> 1 THEN 'CONDITION' END], lambda x: x IS NOT NULL), ',') AS failed FROM documents")
def metadata_filters(spark, d):
    f = fusion.failed_filters(LANGUAGE=(F.col("lang"), "en"), CONDITION=(F.col("doc_id") % 3, 1), SPEAKER_ID=(F.col("source"), None))
    return read(spark, d, "documents").select("doc_id", F.array_join(f, ",").alias("failed"))


_LINES = (
    f"list_concat(list_transform(list_sort({text.STOP_WORDS!r}), lambda w: 'stop' || chr(9) || w), list_sort({['plural|' + k + '|' + v for k, v in text.PLURALS.items()]!r}), {['synonym|' + k + '|' + ','.join(v) for k, v in text.SYNONYMS]!r})"
)


@query(
    f"WITH w AS (SELECT lang, unnest({oracle.tokens('text')}) AS w FROM documents), m AS (SELECT lang, list_sort(list(DISTINCT w)) AS met FROM w WHERE list_contains({text.STOP_WORDS!r}, w) GROUP BY lang), f AS (SELECT sha256(replace(array_to_string({_LINES}, chr(10)), '|', chr(9))) AS fingerprint) "
    "SELECT lang, fingerprint, len(met) AS n_words, sha256(array_to_string(met, '|')) AS words FROM m, f"
)
def lexicon_fingerprint(spark, d):
    """The identity of the lexical configuration, beside the stop words that each language's documents contain."""
    stop = F.array(*map(F.lit, text.STOP_WORDS))
    w = read(spark, d, "documents").select("lang", F.explode(F.array_distinct(F.array_intersect(text.tokens(F.col("text")), stop))).alias("w"))
    met = w.groupBy("lang").agg(F.array_sort(F.collect_set("w")).alias("met"))
    return met.select("lang", F.lit(text.fingerprint()).alias("fingerprint"), F.size("met").cast("long").alias("n_words"), F.sha2(F.array_join("met", "|"), 256).alias("words"))


_PATHS = "SELECT doc_id, '/data/' || CASE doc_id % 4 WHEN 0 THEN 'F0' || (doc_id % 9) WHEN 1 THEN 'MC1' || (doc_id % 9) WHEN 2 THEN 'x/M12' ELSE 'nobody' END || '/Session1/' || CASE doc_id % 5 WHEN 0 THEN 'sentences' WHEN 1 THEN 'single_words' WHEN 2 THEN 'passage' WHEN 3 THEN 'Prompts' ELSE 'wav' END || '/' || doc_id || '.wav' AS path FROM documents"


@query(f"WITH p AS ({_PATHS}) SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'F0' || (doc_id % 9) WHEN 1 THEN 'MC1' || (doc_id % 9) WHEN 2 THEN 'M12' END AS speaker, CASE doc_id % 4 WHEN 1 THEN 'CONTROL' WHEN 3 THEN 'UNKNOWN' ELSE 'DYSARTHRIA' END AS condition, CASE doc_id % 5 WHEN 0 THEN 'SENTENCE' WHEN 1 THEN 'WORD' WHEN 2 THEN 'PASSAGE' WHEN 3 THEN 'PROMPT' ELSE 'UNKNOWN' END AS task FROM p")
def speech_paths(spark, d):
    read(spark, d, "documents").createOrReplaceTempView("larkspur_documents")
    p = spark.sql(_PATHS.replace("FROM documents", "FROM larkspur_documents"))
    c = F.col("path")
    return p.select("doc_id", speech.speaker(c).alias("speaker"), speech.condition(c).alias("condition"), speech.task_type(c).alias("task"))


@query("SELECT doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'first ' || lang WHEN doc_id % 4 = 2 THEN 'second text' END AS transcript FROM documents")
def resolved_transcripts(spark, d):
    """The first candidate that exists counts, even if it is blank."""
    k = F.col("doc_id")
    t = read(spark, d, "documents")
    a = t.where("doc_id % 4 < 2").select(k.alias("path"), F.lit(1).alias("priority"), F.when(k % 4 == 0, "  ").otherwise(F.concat(F.lit(" first \n "), "lang")).alias("content"))
    b = t.where("doc_id % 4 < 3").select(k.alias("path"), F.lit(2).alias("priority"), F.lit("second\ttext").alias("content"))
    return speech.resolve_transcripts(t.select(k.alias("path")), a.unionByName(b)).select("path", "transcript")


@query("WITH f AS (SELECT vec_id % 40 AS s, vec_id AS seq, embedding[1] AS x FROM embeddings) SELECT 's' || s AS sample_id, round(CAST(arg_max(x, seq) AS DOUBLE), 6) AS x, min(seq) AS seq FROM f GROUP BY 1")
def last_speech_vectors(spark, d):
    f = read(spark, d, "embeddings").select(F.concat(F.lit("s"), (F.col("vec_id") % 40).cast("string")).alias("sample_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vec"))
    return speech.last_vectors(f).select("sample_id", F.round(F.get("vec", F.lit(0)).cast("double"), 6).alias("x"), "seq")


@query(oracle.FEEDBACK + "SELECT CASE WHEN atom_id % 4 <> 0 THEN 'KNOWN' ELSE 'UNKNOWN' END AS side, count(*) AS n, round(sum(delta), 6) AS delta FROM feedback WHERE query_key = 'k3' GROUP BY 1")
def known_feedback(spark, d):
    """Feedback of one key, by whether it names an atom that is stored."""
    f = segments.feedback_for(feedback_of(spark, d), key="k3")
    known, unknown = segments.known_feedback(f, read(spark, d, "embeddings").where("vec_id % 4 <> 0").select(F.col("vec_id").alias("id")))
    side = lambda t, n: t.groupBy(F.lit(n).alias("side")).agg(F.count("*").alias("n"), F.round(F.sum("delta"), 6).alias("delta"))
    return side(known, "KNOWN").unionByName(side(unknown, "UNKNOWN"))


@query("WITH e AS (SELECT doc_id, o FROM documents, range(6) t(o)), ev AS (SELECT doc_id, doc_id % 6 AS o FROM documents) SELECT e.doc_id, e.o AS ordinal FROM e JOIN ev ON ev.doc_id = e.doc_id AND abs(ev.o - e.o) = 1")
def chunk_neighbours(spark, d):
    t = read(spark, d, "documents").select("doc_id")
    c = t.withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    return chunk.neighbours(c, t.withColumn("ordinal", F.col("doc_id") % 6))


@query("WITH n AS (SELECT count(*) AS n FROM documents), o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) SELECT s.step, count(*) AS rows, max(r) AS last FROM o, n, (VALUES ('25%', 25), ('50%', 50), ('100%', 100)) s(step, p) WHERE r <= (n * p + 99) // 100 GROUP BY 1 UNION ALL SELECT 'x' || m, count(*) * m, max(r) FROM o, (VALUES (4), (16)) t(m) GROUP BY m")
def scale_steps(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    at = running(docs.select("doc_id"), [], ["doc_id"], [Running("r", "sum", F.lit(1))])
    return drivers.scale_steps(docs, "doc_id").join(at, "doc_id").groupBy("step").agg(F.count("*").alias("rows"), F.max("r").cast("long").alias("last"))


@query("WITH a AS (SELECT doc_id AS k, md5(text) AS t FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id AS k, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE md5(text) END AS t FROM documents WHERE doc_id % 3 <> 0), j AS (SELECT coalesce(a.k, b.k) AS atom_id, a.k AS ak, b.k AS bk, a.t AS t1, b.t AS t2 FROM a FULL JOIN b ON a.k = b.k), f AS (SELECT atom_id, CASE WHEN bk IS NULL THEN 'MISSING' WHEN ak IS NULL THEN 'FOREIGN' WHEN t1 <> t2 THEN 'CHANGED' END AS finding FROM j) SELECT * FROM f WHERE finding IS NOT NULL")
def store_readback(spark, d):
    t = read(spark, d, "documents").select(F.col("doc_id").alias("atom_id"), F.coalesce("text", F.lit("")).alias("content"))
    stored = t.where("atom_id % 3 <> 0").withColumn("content", F.when(F.col("atom_id") % 7 == 0, "changed").otherwise(F.col("content")))
    return drivers.readback(t.where("atom_id % 5 <> 0"), stored)


@query("SELECT page_id AS pair_id, row_number() OVER (ORDER BY sha256('blind:' || page_id)) AS line FROM pages")
def blind_worksheet(spark, d):
    return drivers.worksheet(read(spark, d, "pages").select(F.col("page_id").alias("pair_id"), F.lit(1).alias("rank")), "blind")


@query(oracle.KNN + ", j AS (SELECT k.query_id, k.rank, k.atom_id, k.score FROM knn k WHERE k.rank <= 3) SELECT query_id, count(*) AS results, round(sum(score), 6) AS total FROM j GROUP BY 1")
def blocked_scan(spark, d):
    """The scan in blocks of queries and vectors, as for more queries than are broadcast."""
    e = read(spark, d, "embeddings").where("embedding IS NOT NULL")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    v = e.select(F.col("vec_id").alias("atom_id"), F.col("embedding").alias("vec"))
    got = recall.blocked(v, q, 3, None, 6, query_block=64, vector_block=128)
    return got.groupBy("query_id").agg(F.count("*").alias("results"), F.round(F.sum("score"), 6).alias("total"))



# -- indexes -------------------------------------------------------------------------------------------------------------------


@query(oracle.KNN + "SELECT arm, (SELECT count(*) FROM knn) AS scanned, (SELECT count(*) FROM knn WHERE score >= 0.3) AS offered, (SELECT count(*) FROM knn WHERE score >= 0.3 AND rank <= 5) AS retained FROM (VALUES ('exact'), ('blocked')) t(arm)")
def scan_counters(spark, d):
    """What a scan compares, lets pass and returns, counted where it runs, as one block and as many."""
    e = read(spark, d, "embeddings").where("embedding IS NOT NULL")
    q, v = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("atom_id"), F.col("embedding").alias("vec"))
    arms = {"exact": index.Exact(v, 6), "blocked": index.Blocked(v, 6, 100, 150)}
    counts = {name: arm.counted(q, 5, 0.3)[1] for name, arm in arms.items()}
    return spark.createDataFrame([(name, c["scanned"], c["offered"], c["retained"]) for name, c in counts.items()], "arm string, scanned long, offered long, retained long")


@query(oracle.RERANKED + "SELECT arm, query_id, atom_id, rank FROM reranked, (VALUES ('exact'), ('blocked')) t(arm)")
def index_feedback(spark, d):
    """Feedback wrapped around both scans: the same rows from either."""
    out = None
    e = read(spark, d, "embeddings").where("embedding IS NOT NULL")
    v = e.select(F.col("vec_id").alias("atom_id"), F.col("embedding").alias("vec"))
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), F.concat(F.lit("k"), (F.col("vec_id") % 16).cast("string")).alias("query_key"))
    for name, inner in (("exact", index.Exact(v, 6)), ("blocked", index.Blocked(v, 6, 100, 150))):
        got = index.WithFeedback(inner, feedback_of(spark, d)).search(q, 5, 0.1).select(F.lit(name).alias("arm"), "query_id", "atom_id", "rank")
        out = got if out is None else out.unionByName(got)
    return out


# -- speech and stores, end to end -------------------------------------------------------------------------------------------------

_SPEECH = (
    oracle.KNN
    + ", c AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'ORPHAN_VECTOR' WHEN vec_id % 7 = 0 THEN 'INCOMPATIBLE_DIMENSIONS' WHEN label % 3 <> 0 OR vec_id % 5 = 0 THEN 'METADATA_FILTERED' ELSE 'SCORED' END AS status, CASE WHEN label % 3 <> 0 THEN 'CONDITION' END AS f1, CASE WHEN vec_id % 5 = 0 THEN 'LANGUAGE' END AS f2 FROM embeddings) "
)


def _speech(spark, d):
    v = F.col("vec_id")
    e = read(spark, d, "embeddings").withColumn("sample_id", v.cast("string"))
    samples = e.where("vec_id % 11 <> 0").select("sample_id", F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("condition"), F.when(v % 5 == 0, "fr").otherwise("en").alias("language"))
    # a vector of each sample is older and turned around: the last one counts
    old = e.select("sample_id", F.lit(0).alias("seq"), F.transform("embedding", lambda x: -x).alias("vec"))
    now = e.select("sample_id", F.lit(1).alias("seq"), F.when(v % 7 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("vec"))
    queries = e.select(v.alias("query_id"), F.col("embedding").alias("vec"))
    return speech.search(queries, samples, old.unionByName(now), 4, 64, None, 6, CONDITION=("condition", "c0"), LANGUAGE=("language", "en"), SPEAKER=("condition", None))


@query(_SPEECH + ", r AS (SELECT query_id, CAST(atom_id AS VARCHAR) AS sample_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(atom_id AS VARCHAR)) AS rank FROM knn JOIN c ON c.vec_id = atom_id WHERE status = 'SCORED') SELECT query_id, rank, sample_id, score FROM r WHERE rank <= 4")
def speech_search(spark, d):
    """The four best samples for each audio query, among those that pass all filters."""
    return _speech(spark, d)[0]


@query(_SPEECH + "SELECT CAST(vec_id AS VARCHAR) AS sample_id, status, CASE WHEN status = 'METADATA_FILTERED' THEN concat_ws(',', f1, f2) ELSE '' END AS failed FROM c")
def speech_candidates(spark, d):
    """What becomes of every stored vector on the way."""
    return _speech(spark, d)[1].withColumn("failed", F.array_join("failed", ","))


@query(
    "WITH s AS (SELECT vec_id, CASE label % 4 WHEN 0 THEN 'CONTROL' WHEN 1 THEN 'DYSARTHRIC' WHEN 2 THEN 'UNKNOWN' ELSE 'MILD' END AS condition, vec_id % 10 = 0 AS skipped, vec_id % 10 <> 0 AND vec_id % 9 = 0 AS failed FROM embeddings), "
    "g AS (SELECT 'ALL' AS grouping, '' AS value, * FROM s UNION ALL SELECT 'condition', condition, * FROM s UNION ALL SELECT 'dimensions', CASE WHEN failed THEN 'NONE' ELSE '16' END, * FROM s) "
    "SELECT grouping, value, count(*) AS samples, count(*) FILTER (skipped) AS skipped, count(*) FILTER (NOT skipped AND NOT failed) AS encoded, count(*) FILTER (failed) AS failed, CASE WHEN count(*) FILTER (failed) > 0 THEN 'TOO_SHORT_OR_SILENT=' || count(*) FILTER (failed) ELSE '' END AS failures FROM g GROUP BY ALL"
)
def feature_coverage(spark, d):
    """Samples of which a tenth is encoded already and a ninth is too short."""
    v = F.col("vec_id")
    e = read(spark, d, "embeddings")
    condition = F.when(F.col("label") % 4 == 0, "CONTROL").when(F.col("label") % 4 == 1, "DYSARTHRIC").when(F.col("label") % 4 == 3, "MILD")
    wave = F.transform("embedding", lambda x: x.cast("double"))
    samples = e.select(v.cast("string").alias("sample_id"), F.when(v % 9 == 0, F.slice(wave, 1, 5)).otherwise(wave).alias("samples"), F.lit(16).alias("sample_rate"), condition.alias("condition"))
    existing = e.where("vec_id % 10 = 0").select(v.cast("string").alias("sample_id"), F.slice("embedding", 1, 16).alias("vec"))
    return speech.encode_job(samples, existing, "condition")[1]


@query(
    f"WITH a AS (SELECT doc_id, {oracle.content_id('text')} AS id, text FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'wrong' ELSE id END AS id, CASE WHEN doc_id % 23 = 0 THEN ' ' ELSE text END AS text FROM a), "
    f"v AS (SELECT id, doc_id FROM b WHERE doc_id % 13 <> 0), f AS (SELECT 'BLANK_CONTENT' AS category FROM b WHERE trim(text) = '' UNION ALL SELECT 'ID_MISMATCH' FROM b WHERE id <> {oracle.content_id('text')} "
    "UNION ALL SELECT 'DUPLICATE_ID' FROM b GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'DIMENSION_MISMATCH' FROM v WHERE doc_id % 19 = 0 UNION ALL SELECT 'ZERO_VECTOR' FROM v WHERE doc_id % 19 <> 0 AND doc_id % 29 = 0 "
    "UNION ALL SELECT 'ATOM_WITHOUT_VECTOR' FROM (SELECT DISTINCT id FROM b) x WHERE id NOT IN (SELECT id FROM v) UNION ALL SELECT 'FEEDBACK_LOG_CORRUPT' FROM events WHERE event_id % 31 = 0) "
    "SELECT category, CASE category WHEN 'DUPLICATE_ID' THEN 'INFO' WHEN 'ZERO_VECTOR' THEN 'WARNING' ELSE 'ERROR' END AS severity, count(*) AS n FROM f GROUP BY category"
)
def store_integrity(spark, d):
    """All findings over one store whose atoms, vectors and feedback were spoiled."""
    k = F.col("doc_id")
    t = read(spark, d, "documents").where("text IS NOT NULL").select(k, F.when(k % 17 == 0, "wrong").otherwise(ids.content_id(F.col("text"))).alias("id"), F.when(k % 23 == 0, " ").otherwise(F.col("text")).alias("content"))
    one = lambda n, x: F.array_repeat(F.lit(x).cast("float"), n)
    vec = t.where("doc_id % 13 <> 0").select(F.col("id").alias("atom_id"), F.when(k % 19 == 0, one(3, 1.0)).when(k % 29 == 0, one(4, 0.0)).otherwise(one(4, 1.0)).alias("vec"))
    e = F.col("event_id")
    feedback = read(spark, d, "events").select(e.alias("seq"), F.lit("q").alias("query"), F.lit("a").alias("atom_id"), F.lit("POSITIVE").alias("signal"), F.when(e % 31 == 0, -1.0).otherwise(1.0).alias("delta"))
    return drivers.integrity(t.select("id", "content"), vec, feedback, 4)
