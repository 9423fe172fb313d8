"""Registered queries over the test tables, and for each the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text, vectors
from ..operators import compare, cost, experience, fusion, ledger, metrics, recall, stats
from ..operators.blocks import spread
from ..sources.snapshots import kept
from . import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Terms that queries get by their number, so that every rule of the lexicon is met.
PHRASES = [k for k, _ in text.SYNONYMS]
GRID = [k / 20 for k in range(1, 21)]
RULES = [("the", ["article"]), ("on the", ["position", "place"]), ("of", ["relation", "article"])]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- text --------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len(tok) AS n_tokens, len(list_distinct(tok)) AS n_distinct FROM (SELECT doc_id, {oracle.tokens('text')} AS tok FROM documents)")
def tokenize_counts(spark, d):
    t = text.tokens(F.col("text"))
    return spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def phrased(spark: SparkSession, d: str) -> DataFrame:
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("item_id") % len(PHRASES) + 1).cast("int"))
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" "), phrase).alias("text"))


@query(oracle.PHRASED + f"SELECT query_id, norm AS normalized, array_to_string(exp, '|') AS expansions, {oracle.enriched()} AS enriched, len({oracle.tokens('norm')}) + len({oracle.tokens(oracle.joined('exp'))}) AS n_weighted FROM expanded")
def normalize_expand(spark, d):
    norm = text.normalized(F.col("text"))
    exp = text.expansions(norm)
    return phrased(spark, d).select("query_id", norm.alias("normalized"), F.array_join(exp, "|").alias("expansions"), text.enriched(norm, exp).alias("enriched"), F.size(text.weighted(norm, exp)).cast("long").alias("n_weighted"))


@query(oracle.PHRASED + f"SELECT query_id, text AS exact_key, CASE WHEN trim(norm) = '' THEN text ELSE 'normalized:' || norm END AS normalized_key, {oracle.lexical_key()} AS lexical_key FROM expanded")
def query_keys(spark, d):
    q = F.col("text")
    return phrased(spark, d).select("query_id", text.exact_key(q).alias("exact_key"), text.normalized_key(q).alias("normalized_key"), text.lexical_key(q).alias("lexical_key"))


@query(oracle.query_expansion(RULES, 2))
def query_expansion(spark, d):
    e = text.expand_query(F.col("text"), RULES, 2)
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), e["text"].alias("text"), F.array_join(e["added"], "|").alias("added"), e["truncated"].alias("truncated"))


@query(f"SELECT {oracle.content_id('text')} AS atom_id, min(doc_id) AS seq, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def atom_ids_dedup(spark, d):
    docs = read(spark, d, "documents")
    n = docs.where("text IS NOT NULL").groupBy(ids.content_id(F.col("text")).alias("atom_id")).agg(F.count("*").alias("copies"))
    return recall.atoms(docs, "text", "doc_id").select("atom_id", "seq").join(n, "atom_id")


# -- vectors and recall ------------------------------------------------------------------------------------------------


@query(oracle.sparse("documents", "doc_id", "text", None) + "SELECT id AS doc_id, bucket, round(x, 6) AS x FROM vec")
def hash_encode_buckets(spark, d):
    w = F.transform(text.tokens(F.col("text")), lambda t: F.struct(t.alias("token"), F.lit(1.0).alias("weight")))
    rows = spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", w.alias("w"))
    return vectors.sparse(rows, "doc_id", "w").select("doc_id", "bucket", F.round(F.col("x").cast("double"), 6).alias("x"))


def _recalled(spark: SparkSession, d: str, k: int, t: float) -> DataFrame:
    a = recall.atoms(read(spark, d, "documents"), "text", "doc_id")
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return recall.recall(a, q, k, t, digits=6)


@query(oracle.recall(10, 0.0))
def recall_topk(spark, d):
    return _recalled(spark, d, 10, 0.0)


@query(oracle.recall(5, 0.3))
def recall_threshold(spark, d):
    return _recalled(spark, d, 5, 0.3)


def knn(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Every embedding as a query against all: the k best, itself included."""
    e = read(spark, d, "embeddings").where("embedding IS NOT NULL")
    return recall.scan(e.select(F.col("vec_id").alias("atom_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), k, None, 6)


@query(oracle.KNN + "SELECT query_id, rank, atom_id, score FROM knn WHERE rank <= 5")
def embedding_knn_topk(spark, d):
    return knn(spark, d, 5)


def feedback_of(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value") / 1000
    delta = F.when(F.col("event_type").isin("purchase", "click"), v).when(F.col("event_type") == "error", -v)
    n = read(spark, d, "embeddings").agg(F.count("*").alias("n"))
    rows = read(spark, d, "events").crossJoin(F.broadcast(n)).where(delta.isNotNull())  # n is one row
    return rows.select(F.concat(F.lit("k"), (F.col("user_id") % 16).cast("string")).alias("query_key"), (F.col("event_id") % F.col("n")).alias("atom_id"), delta.alias("delta"), F.col("event_id").alias("seq"))


def pooled(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best of every embedding as a written table, for queries that use a scan more than once."""
    return kept(knn(spark, d, 20), "knn")


def reranked(spark: SparkSession, d: str, best: DataFrame | None = None) -> DataFrame:
    """best: the 20 best of every query, where they are at hand."""
    pool = (knn(spark, d, 20) if best is None else best).withColumn("query_key", F.concat(F.lit("k"), (F.col("query_id") % 16).cast("string")))
    return recall.rerank(pool, recall.adjustments(feedback_of(spark, d)), 5, 0.1)


@query(oracle.RERANKED + "SELECT query_id, rank, atom_id, round(score, 6) AS score, base_rank FROM reranked")
def feedback_rerank(spark, d):
    return reranked(spark, d).withColumn("score", F.round("score", 6))


@query(oracle.FEEDBACK + "SELECT query_key, atom_id, round(sum(delta), 9) AS delta FROM feedback GROUP BY ALL")
def feedback_adjustments(spark, d):
    return recall.adjustments(feedback_of(spark, d)).withColumn("delta", F.round("delta", 9))


@query("WITH p AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS position FROM embeddings) SELECT label, position, round(avg(CAST(x AS DOUBLE)), 9) AS mean FROM p GROUP BY ALL")
def label_centroids(spark, d):
    return vectors.centroid(read(spark, d, "embeddings"), "embedding", "label").withColumn("mean", F.round("mean", 9)).withColumn("position", F.col("position").cast("long"))


# -- metrics -----------------------------------------------------------------------------------------------------------


def labels_of(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").where("label IS NOT NULL").select("vec_id", F.col("label").alias("g"))


def n_relevant(spark: SparkSession, d: str) -> DataFrame:
    """A query's relevant items are the vectors of its label but its own: their number is the group's size less one."""
    e = labels_of(spark, d)
    n = e.groupBy("g").agg((F.count("*") - 1).alias("n_relevant"))
    return e.join(n, "g").where("n_relevant > 0").select(F.col("vec_id").alias("query_id"), "n_relevant")


def judged(spark: SparkSession, d: str, ranked: DataFrame) -> DataFrame:
    """ranked (query_id, label, ...) with rel, 1 where both vectors have one label: no table of relevant pairs is made."""
    e = labels_of(spark, d)
    t = ranked.join(e.select(F.col("vec_id").alias("query_id"), F.col("g").alias("_q")), "query_id", "left").join(e.select(F.col("vec_id").alias("label"), F.col("g").alias("_a")), "label", "left")
    return t.withColumn("rel", F.when((F.col("_q") == F.col("_a")) & (F.col("query_id") != F.col("label")), 1).otherwise(0)).drop("_q", "_a")


def ranking(spark: SparkSession, d: str, best: DataFrame | None = None) -> DataFrame:
    return (knn(spark, d, 6) if best is None else best.where("rank <= 6")).where("query_id <> atom_id").withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY rank)")).where("rank <= 5").select("query_id", "rank", F.col("atom_id").alias("label"), "score")


def per_query(spark: SparkSession, d: str) -> DataFrame:
    return metrics.from_judged(judged(spark, d, ranking(spark, d)), n_relevant(spark, d))


ROUNDED = ["p_at_1", "p_at_3", "p_at_5", "r_at_1", "r_at_3", "r_at_5", "hit_at_1", "hit_at_3", "hit_at_5", "rr"]


@query(oracle.PER_QUERY + "SELECT query_id, n_relevant, n_returned, first_rank, " + ", ".join(f"round({c}, 9) AS {c}" for c in ROUNDED) + " FROM per_query")
def eval_p_r_hit_mrr(spark, d):
    return per_query(spark, d).select("query_id", "n_relevant", "n_returned", "first_rank", *(F.round(c, 9).alias(c) for c in ROUNDED))


@query(oracle.PER_QUERY + oracle.averages("'ALL'", "''", "") + " UNION ALL " + oracle.averages("'label'", "CAST(label AS VARCHAR)", "GROUP BY label"))
def eval_averages(spark, d):
    lab = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    out = metrics.grouped(per_query(spark, d).join(lab, "query_id"), "label")
    return out.select("grouping", "value", "queries", *(F.round(c, 9).alias(c) for c in out.columns if c.startswith("avg_") or c == "mrr"))


@query(oracle.CHANGE)
def eval_compare(spark, d):
    best = pooled(spark, d)
    after = reranked(spark, d, best).where("query_id <> atom_id").withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY rank)")).select("query_id", "rank", F.col("atom_id").alias("label"))
    return metrics.change_of_judged(judged(spark, d, ranking(spark, d, best)), judged(spark, d, after), n_relevant(spark, d).select("query_id"))


@query(oracle.PER_QUERY + oracle.FAILURE)
def failure_class(spark, d):
    lab = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    gap = text.alias_gap(F.concat(F.lit("topic "), F.when(F.col("label") % 2 == 0, F.col("label").cast("string")).otherwise("")), F.array(F.concat(F.lit("ka_"), F.col("label").cast("string"))))
    return metrics.failure_class(per_query(spark, d).join(lab, "query_id"), gap).select("query_id", "failure")


@query(oracle.KNN + oracle.sweep(GRID))
def threshold_sweep(spark, d):
    rel = judged(spark, d, ranking(spark, d))
    best = rel.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"), F.min_by("score", F.when(F.col("rel") == 1, F.col("rank"))).alias("first_relevant_score"))
    lab = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), (F.col("label") % 2 == 0).alias("answerable"))
    return metrics.threshold_curve(best.join(lab, "query_id"), GRID)


@query(oracle.KNN + oracle.HUBS)
def hub_concentration(spark, d):
    t = metrics.hub_concentration(knn(spark, d, 10))
    return t.select(F.col("cut").cast("long").alias("cut"), "occurrences", "atoms", "queries", F.round("top_atom_share", 9).alias("top_atom_share"))


@query("SELECT CASE WHEN quality IS NULL THEN 'U' ELSE 'q' || quality END AS before, CASE WHEN toxic IS NULL THEN 'U' ELSE 't' || toxic END AS after, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def label_transitions(spark, d):
    docs, lab = read(spark, d, "documents").select("doc_id"), read(spark, d, "labels")
    side = lambda c, p: docs.join(lab.select("doc_id", F.concat(F.lit(p), F.col(c).cast("string")).alias("label")), "doc_id", "left")
    return metrics.label_transitions(side("quality", "q"), side("toxic", "t"), "doc_id")


@query(oracle.RERANKED + oracle.JACCARD)
def topk_jaccard(spark, d):
    best = pooled(spark, d)
    return metrics.jaccard(best, reranked(spark, d, best), 5).withColumn("jaccard", F.round("jaccard", 9))


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('seed-1:' || doc_id), doc_id) AS pick FROM documents) SELECT doc_id, lang, pick FROM r WHERE pick <= 5")
def stratified_selection(spark, d):
    return metrics.stratified(read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 5, "seed-1")


# -- ledger ------------------------------------------------------------------------------------------------------------


def ledger_of(spark: SparkSession, d: str) -> DataFrame:
    """Events as ledgers of one scope a user; rows 3, 4, 5 of every seven correct the row before."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = read(spark, d, "events").withColumn("seq", F.row_number().over(w)).withColumn("prev", F.lag("event_id").over(w))
    return t.select("user_id", F.col("seq").cast("long").alias("seq"), "event_id", F.col("event_type").alias("kind"), F.when((F.col("seq") % 7).isin(3, 4, 5), F.col("prev")).alias("supersedes"), F.col("ts").alias("recorded_at"), "value", F.concat_ws("|", "event_type", F.col("event_id").cast("string")).alias("payload"))


@query(oracle.LEDGER + "SELECT user_id, seq, event_id, kind FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM ledger s WHERE s.user_id = l.user_id AND s.supersedes = l.event_id)")
def effective_facts(spark, d):
    return ledger.effective(ledger_of(spark, d), "user_id").select("user_id", "seq", "event_id", "kind")


@query(oracle.LEDGER + "SELECT user_id, arg_max(kind, seq) AS kind FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM ledger s WHERE s.user_id = l.user_id AND s.supersedes = l.event_id) GROUP BY user_id")
def latest_outcome(spark, d):
    return ledger.latest(ledger.effective(ledger_of(spark, d), "user_id"), "kind", "user_id")


@query(oracle.LEDGER.replace("WITH", "WITH RECURSIVE", 1) + ", walk AS (SELECT event_id, event_id AS cur, 0 AS depth FROM ledger UNION ALL SELECT w.event_id, l.supersedes, w.depth + 1 FROM walk w JOIN ledger l ON l.event_id = w.cur WHERE l.supersedes IS NOT NULL) SELECT event_id, arg_max(cur, depth) AS root_id, max(depth) AS depth FROM walk GROUP BY event_id")
def revision_chain(spark, d):
    return ledger.revision_roots(ledger_of(spark, d))


@query(oracle.LEDGER + ", h AS (SELECT *, max(recorded_at) OVER (PARTITION BY user_id ORDER BY seq) AS high, (SELECT quantile_disc(ts, 0.5) FROM events) AS cut FROM ledger) SELECT user_id, count(*) AS n, max(seq) AS seq FROM h WHERE high <= cut GROUP BY user_id")
def asof_cutoff(spark, d):
    cut = read(spark, d, "events").agg(F.timestamp_micros(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros(CAST(ts AS TIMESTAMP)))").cast("long")).alias("cut"))
    t = ledger_of(spark, d).crossJoin(F.broadcast(cut))  # one row
    return ledger.recorded_prefix(t.withColumn("recorded_at", F.col("recorded_at").cast("timestamp")), F.col("cut"), "user_id").groupBy("user_id").agg(F.count("*").alias("n"), F.max("seq").alias("seq"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 100 AND event_id <= 100000 ORDER BY event_id LIMIT 50")
def history_page(spark, d):
    t = read(spark, d, "events").withColumn("seq", F.col("event_id"))
    return ledger.history_page(t, 100, 100000, 50).select("event_id", "user_id", "event_type")


@query("WITH s AS (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events) SELECT user_id, event_id, CASE WHEN step = 0 THEN 'DUPLICATE_SEQUENCE' ELSE 'SEQUENCE_GAP' END AS finding, step FROM s WHERE step <> 1")
def sequence_gaps(spark, d):
    t = read(spark, d, "events").withColumn("seq", F.col("event_id"))
    return ledger.sequence_findings(t, "user_id").select("user_id", "event_id", "finding", "step")


@query(oracle.LEDGER + "SELECT user_id, count(*) AS n, sha256(string_agg(seq || ':' || sha256(payload) || chr(10), '' ORDER BY seq)) AS digest FROM ledger GROUP BY user_id")
def prefix_digest(spark, d):
    return experience.digest(ledger_of(spark, d), "user_id")


@query(oracle.LEDGER + ", eff AS (SELECT * FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM ledger s WHERE s.user_id = l.user_id AND s.supersedes = l.event_id)) SELECT DISTINCT user_id, kind AS atom_id, CASE WHEN kind IN (SELECT kind FROM eff e WHERE e.user_id = ledger.user_id AND e.seq % 2 = 0) THEN 'LIVE' ELSE 'RETIRED' END AS state FROM ledger")
def projection_atoms(spark, d):
    led = ledger_of(spark, d).withColumn("atom_id", F.col("kind"))
    return ledger.live_texts(ledger.effective(led, "user_id").where("seq % 2 = 0"), led, "user_id")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'APPENDED' WHEN event_id % 5 = 0 THEN 'CONFLICT' ELSE 'IDEMPOTENT' END AS status FROM events")
def append_status(spark, d):
    t = ledger_of(spark, d).withColumn("scope", F.lit("s"))
    stored = t.where("event_id % 3 <> 0").withColumn("payload", F.when(F.col("event_id") % 5 == 0, F.lit("other")).otherwise(F.col("payload")))
    return ledger.append_status(t.select("scope", "event_id", "payload"), stored).select("event_id", "status")


@query("SELECT event_id + 1 AS seq, event_type || '|' || event_id AS payload, CASE event_id % 4 WHEN 1 THEN 'DIGEST_MISMATCH' WHEN 2 THEN 'MALFORMED_RECORD' END AS finding FROM events")
def ledger_frames(spark, d):
    line = ledger.framed(F.col("event_id") + 1, F.concat_ws("|", "event_type", F.col("event_id").cast("string")))
    bad = F.when(F.col("event_id") % 4 == 1, F.regexp_replace(line, "\t[0-9a-f]{64}\t", F.lit("\t" + "0" * 64 + "\t"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("X"), line)).otherwise(line)
    return ledger.parse_framed(read(spark, d, "events").select(bad.alias("value")))


def executions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as executions: status, origin, result, and three mandatory dimensions from the first lines."""
    li = read(spark, d, "lineitem")
    state = F.when(F.col("l_returnflag") == "A", "PASS").when(F.col("l_returnflag") == "R", "FAIL").otherwise("UNKNOWN")
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*(F.max(F.when(F.col("l_linenumber") == k, state)).alias(f"s{k}") for k in (1, 2, 3)), F.min("l_linestatus").alias("ls"))
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "F", "ACCEPTED").otherwise("REJECTED")
    t = read(spark, d, "orders").join(lines, "o_orderkey", "left")
    dims = F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(n).alias("dimension"), F.col(f"s{k}").alias("state")) for k, n in ((1, "BUILD"), (2, "TESTS"), (3, "REVIEW"))))
    origin = F.when(F.col("o_orderpriority").startswith("1"), "IMPORTED_CLAIM").otherwise("VALIDATED")
    result = F.when(F.col("ls") == "F", "COMPLETED").when(F.col("ls") == "O", "CANCELLED")
    t = t.select("o_orderkey", "o_custkey", ledger.acceptance(status, origin, result, dims).alias("acc"), status.alias("outcome"), origin.alias("origin"), result.alias("result"), dims.alias("dims"))
    return t.withColumn("why", ledger.sample_reasons(F.col("acc.status"), *map(F.col, ("outcome", "origin", "result", "dims"))))


@query(oracle.EXECUTIONS + "SELECT o_orderkey, status, array_to_string(reasons, '; ') AS reasons FROM exec")
def acceptance_derive(spark, d):
    return executions(spark, d).select("o_orderkey", F.col("acc.status").alias("status"), F.array_join("acc.reasons", "; ").alias("reasons"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return executions(spark, d).withColumn("label", ledger.sample_label(F.col("acc.status"), F.col("why")))


@query(oracle.EXECUTIONS + f"SELECT o_orderkey, {oracle.LABEL} AS label FROM exec")
def sample_labels(spark, d):
    return labelled(spark, d).select("o_orderkey", "label")


@query(oracle.EXECUTIONS + f", l AS (SELECT o_orderkey, o_custkey % 10 AS g, {oracle.LABEL} AS label FROM exec) SELECT o_orderkey, CASE WHEN label = 'SUCCESS' THEN row_number() OVER (PARTITION BY g, label = 'SUCCESS' ORDER BY o_orderkey) END AS success_ordinal FROM l")
def success_ordinal(spark, d):
    t = labelled(spark, d).withColumn("g", F.col("o_custkey") % 10).withColumn("start_seq", F.col("o_orderkey"))
    return ledger.success_ordinal(t, "g").select("o_orderkey", "success_ordinal")


# -- cost and time -----------------------------------------------------------------------------------------------------


@query(oracle.USAGE + "SELECT l_suppkey, kind, sum(value) FILTER (provenance = 'REPORTED') AS reported, sum(value) FILTER (provenance = 'ESTIMATED') AS estimated, count(*) FILTER (provenance = 'UNKNOWN') AS unknown, count(*) FILTER (provenance IS NULL) AS not_measured FROM usage GROUP BY ALL")
def usage_totals(spark, d):
    prov = F.when(F.col("l_returnflag") == "A", "REPORTED").when(F.col("l_returnflag") == "R", "ESTIMATED").when(F.col("l_linestatus") == "O", "UNKNOWN")
    kind = F.element_at(F.array(*map(F.lit, cost.KINDS)), F.col("l_linenumber") % 6 + 1)
    u = read(spark, d, "lineitem").select("l_suppkey", kind.alias("kind"), F.col("l_quantity").cast("long").alias("value"), prov.alias("provenance"))
    return cost.usage_totals(u, "l_suppkey")


def priced(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    prices = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("provider"), F.date_add(F.lit("1992-01-01").cast("date"), ((F.col("p_partkey") * 37) % 2500).cast("int")).alias("effective_date"), F.round("p_retailprice", 2).cast("decimal(18,6)").alias("price"))
    stages = read(spark, d, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("provider")), "l_partkey").select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("stage"), "provider", F.col("l_shipdate").alias("ended_at"), F.col("l_quantity").cast("long").alias("units"))
    m = cost.asof_price(stages, prices, "ended_at", "provider")
    m = m.join(prices.select(F.col("id").alias("price_id"), "price"), "price_id", "left")
    return m.withColumn("cost", cost.report(cost.line_cost(F.col("units"), F.col("price"), 1000)))


@query(oracle.PRICED + "SELECT stage, match, price_id, effective_date, CAST(cost AS VARCHAR) AS cost FROM priced")
def asof_price_cost(spark, d):
    return priced(spark, d).select("stage", "match", "price_id", "effective_date", F.col("cost").cast("string").alias("cost"))


@query(oracle.PRICED + "SELECT stage // 1000 AS execution, provider AS currency, CAST(sum(cost) AS VARCHAR) AS cost, CASE WHEN bool_and(match = 'FOUND') THEN 'AVAILABLE' WHEN bool_or(match = 'FOUND') THEN 'PARTIAL' ELSE 'UNAVAILABLE' END AS availability FROM priced GROUP BY ALL")
def cost_to_outcome(spark, d):
    t = priced(spark, d).select(F.expr("stage div 1000").alias("execution"), F.col("provider").alias("currency"), "cost", (F.col("match") == "FOUND").alias("covered"))
    return cost.cost_to_outcome(t, "execution").withColumn("cost", F.col("cost").cast("string"))


@query(oracle.INTERVALS)
def interval_union_time(spark, d):
    end = F.timestamp_micros(F.unix_micros(F.col("l_shipdate").cast("timestamp")) + (F.col("l_quantity") * 3600e6).cast("long"))
    t = cost.time_totals(read(spark, d, "lineitem").select("l_suppkey", F.col("l_shipdate").alias("started_at"), end.alias("ended_at")), "l_suppkey")
    return t


# -- comparison --------------------------------------------------------------------------------------------------------

OBJECTIVES = [compare.Objective("s_acctbal", True, 0.0), compare.Objective("speed", False, 0.0)]


def candidates(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "supplier")
    return t.select("s_suppkey", "s_nationkey", "s_acctbal", F.when(F.col("s_suppkey") % 13 != 0, (F.col("s_suppkey") * 7919 % 101).cast("double")).alias("speed"), (F.col("s_suppkey") % 9 != 0).alias("ok"))


@query(oracle.PAIRS + "SELECT s_nationkey, left_ref, right_ref, verdict_0, verdict_1, conclusion FROM pairs")
def pairwise_compare(spark, d):
    return compare.pairs(candidates(spark, d), "s_suppkey", ["s_nationkey"], OBJECTIVES, "ok")


@query(oracle.PARETO)
def pareto_front(spark, d):
    return compare.pareto(candidates(spark, d), "s_suppkey", ["s_nationkey"], OBJECTIVES, "ok")


# -- fusion ------------------------------------------------------------------------------------------------------------


def arms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = read(spark, d, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("sample_id"), F.get("embedding", F.lit(0)).cast("double").alias("ts"), F.get("embedding", F.lit(1)).cast("double").alias("as_"))
    t = fusion.min_max(e.where("sample_id % 7 <> 0").select("query_id", "sample_id", F.col("ts").alias("score")), "query_id")
    a = fusion.min_max(e.where("sample_id % 11 <> 0 AND query_id % 4 <> 3").select("query_id", "sample_id", F.col("as_").alias("score")), "query_id")
    return e.select("query_id", "sample_id"), t, a


@query(oracle.ARMS + "SELECT profile, query_id, sample_id, round(score, 9) AS score, row_number() OVER (PARTITION BY profile, query_id ORDER BY score DESC, sample_id) AS rank FROM (SELECT profile, query_id, sample_id, wt * t + wa * a AS score FROM aligned, (VALUES ('balanced', 0.5, 0.5), ('text', 0.75, 0.25)) w(profile, wt, wa) WHERE t IS NOT NULL AND a IS NOT NULL)")
def score_fusion(spark, d):
    return fusion.fused(fusion.aligned(*arms(spark, d)), [("balanced", 0.5, 0.5), ("text", 0.75, 0.25)]).withColumn("score", F.round("score", 9))


@query(oracle.ARMS + oracle.POLICY)
def missing_modality_policy(spark, d):
    return fusion.missing_policy(fusion.aligned(*arms(spark, d)), "ABSTAIN_ON_PARTIAL", 0.5, 0.5).withColumn("score", F.round("score", 9))


@query(oracle.ARMS + ", q AS (SELECT query_id, coalesce(max(CASE WHEN t IS NOT NULL AND a IS NOT NULL THEN 1 END), 0) AS x FROM aligned GROUP BY 1) SELECT query_id, availability, count(*) AS n FROM aligned GROUP BY ALL")
def modality_availability(spark, d):
    return fusion.aligned(*arms(spark, d)).groupBy("query_id", "availability").agg(F.count("*").alias("n"))


# -- statistics and audit ----------------------------------------------------------------------------------------------


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, min(value) AS min, max(value) AS max, quantile_disc(value, 0.5) AS p50, CASE WHEN count(value) >= 20 THEN quantile_disc(value, 0.95) END AS p95, CASE WHEN count(value) >= 100 THEN quantile_disc(value, 0.99) END AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    t = stats.nearest_rank(read(spark, d, "events"), "value", "event_type")
    return t.withColumn("mean", F.round("mean", 6)).withColumn("stddev", F.round("stddev", 6))


@query("WITH e AS (SELECT event_type, CAST(value * 1000 AS BIGINT) AS ns FROM (SELECT event_type, floor(value) AS value FROM events)) SELECT event_type, count(ns) AS n, CAST(floor(median(ns)) AS BIGINT) AS median, quantile_disc(ns, 0.95) AS p95, CAST(floor(sum(ns) / count(ns)) AS BIGINT) AS mean, round(1e9 / floor(sum(ns) / count(ns)), 6) AS qps FROM e GROUP BY event_type")
def scale_timing(spark, d):
    t = read(spark, d, "events").select("event_type", (F.floor("value") * 1000).cast("long").alias("ns"))
    return stats.scale_timing(t, "ns", "event_type").withColumn("qps", F.round("qps", 6))


@query("SELECT doc_id, 'DOCUMENT_WITHOUT_LABEL' AS category, 'ERROR' AS severity FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'LABEL_WITHOUT_DOCUMENT', 'WARNING' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def referential_audit(spark, d):
    from ..operators import audit

    return audit.referential(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id"), "doc_id", ("DOCUMENT_WITHOUT_LABEL", "ERROR"), ("LABEL_WITHOUT_DOCUMENT", "WARNING"))


@query()
def chunk_documents(spark, d):
    from ..operators import chunk

    return chunk.chunks(spread(read(spark, d, "documents").select("doc_id", "text")))


@query()
def acoustic_features(spark, d):
    from ..sources import speech

    e = read(spark, d, "embeddings")
    return speech.features_of_samples(e.select(F.col("vec_id").cast("string").alias("sample_id"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"), F.lit(16).alias("sample_rate")))


@query("SELECT doc_id, r AS replica, CASE WHEN r = 0 THEN text ELSE '[replica ' || r || '] ' || text END AS text FROM documents, range(4) t(r)")
def scale_ladder(spark, d):
    from ..operators import generate

    return generate.replicas(read(spark, d, "documents").select("doc_id", "text"), 4)


# -- experiments -------------------------------------------------------------------------------------------------------


@query(oracle.KNN + "SELECT query_id, count(*) AS results, count(*) AS equal_scores FROM knn WHERE rank <= 3 GROUP BY 1")
def topk_parity(spark, d):
    """The scan's results against native expressions on the same pairs: all must be equal."""
    from . import experiments

    e = read(spark, d, "embeddings").where("embedding IS NOT NULL")
    top = kept(knn(spark, d, 3), "knn").select("query_id", "atom_id", "score")
    q, a = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("atom_id"), F.col("embedding").alias("v"))
    again = top.join(q, "query_id").join(a, "atom_id").select("query_id", "atom_id", F.round(vectors.cosine(F.col("q"), F.col("v")), 6).alias("score"))
    odd = experiments.parity(top, again).where("side = 'LEFT'").groupBy("query_id").agg(F.count("*").alias("odd"))
    n = top.groupBy("query_id").agg(F.count("*").alias("results"))
    return n.join(odd, "query_id", "left").select("query_id", "results", (F.col("results") - F.coalesce("odd", F.lit(0))).alias("equal_scores"))


@query(oracle.CONTRIBUTIONS)
def term_contributions(spark, d):
    from . import experiments

    rows = experiments.term_contributions(phrased(spark, d), "query_id", F.col("text"), F.array().cast("array<string>"), 10)
    return rows.select("query_id", "source", "term", "weight", "occurrences", "total", "place")


@query(oracle.KNN + oracle.spoiled_sweep(GRID, 10))
def sweep_invariants(spark, d):
    """Rankings of which every fifth has a score out of order: the sweep must find these, and no others."""
    from . import experiments

    spoiled = F.when((F.col("query_id") % 5 == 0) & (F.col("rank") == 4), F.col("score") + 0.5).otherwise(F.col("score"))
    return experiments.sweep_findings(knn(spark, d, 10).withColumn("score", spoiled), GRID, 10)


@query(oracle.KNN + "SELECT query_id, " + oracle.STRESS)
def stress_reasons(spark, d):
    j = judged(spark, d, ranking(spark, d))
    g = j.groupBy("query_id").agg(F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("fr"), F.max(F.when(F.col("rel") == 1, F.col("score"))).alias("fs"), F.count_if((F.col("rel") == 1) & (F.col("rank") <= 3) & (F.col("score") > 0)).alias("found"))
    n = n_relevant(spark, d).withColumnRenamed("n_relevant", "n")
    return n.join(g, "query_id", "left").select("query_id", metrics.stress_reason(F.col("fr"), F.col("fs"), 3, F.col("n"), F.coalesce("found", F.lit(0))).alias("reason"))


@query(oracle.KEY_STRATEGIES)
def key_strategies(spark, d):
    """A query and another writing of it: with marks and stop words, with one word more, or in capitals and with a phrase more."""
    from . import experiments

    k, t = F.col("query_id") % 3, F.col("text")
    other = F.when(k == 0, F.concat(F.lit("of the "), t, F.lit(" !"))).when(k == 1, F.concat(t, F.lit(" zebra"))).otherwise(F.concat(F.upper(t), F.lit(" cache")))
    return experiments.key_strategies(phrased(spark, d).select(F.col("query_id").alias("id"), t.alias("seed"), other.alias("query")))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'C0' WHEN 1 THEN 'E1' WHEN 2 THEN 'E2' ELSE 'U' END AS judgment FROM pages")
def judgment_labels(spark, d):
    pages = read(spark, d, "pages").select("page_id")
    j = pages.where("page_id % 4 < 3").select("page_id", (F.col("page_id") % 4).alias("grade"), F.when(F.col("page_id") % 4 == 0, "CONFOUNDER").otherwise("EVIDENCE").alias("role"))
    return metrics.judgment_label(pages, j, "page_id").select("page_id", "judgment")


# the other queries register themselves here
from . import histories, ledgers, rankings  # noqa: E402, F401
