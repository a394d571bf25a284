"""Queries that join, reconcile, evaluate, schedule and audit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlens.functions.jsonstrict import canonical_json, iso_date, normalize_answer, redact, strict_json
from pairlens.functions.stats import nearest_rank, short_id, token_cost
from pairlens.operators import metrics, outcomes, reconcile, schedule
from pairlens.sources.tables import attempts, request_facts, small_batches, table

from .metrics_queries import FACT, rank_sql
from .registry import query


@query("identity_mismatch", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS problem FROM documents d FULL JOIN (SELECT doc_id FROM labels UNION ALL SELECT -1) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def identity_mismatch(spark, sf_dir):
    extra = table(spark, sf_dir, "labels").select("doc_id").union(spark.range(1).select((F.col("id") - 1).alias("doc_id")))
    return reconcile.identity_mismatch(table(spark, sf_dir, "documents").select("doc_id"), extra, "doc_id")


@query("record_evaluation_join", "SELECT l.doc_id, l.quality, l.toxic, length(d.text) AS n FROM labels l JOIN documents d USING (doc_id)")
def record_evaluation_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.length("text").cast("long").alias("n"))
    return reconcile.one_to_one(labels, docs, "doc_id")


@query("resume_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return reconcile.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("dup_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark, sf_dir):
    return reconcile.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("id_set_diff", "SELECT count_if(l.doc_id IS NULL) AS missing, count_if(d.doc_id IS NULL) AS extra FROM documents d FULL JOIN labels l USING (doc_id)")
def id_set_diff(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    both = d.withColumn("a", F.lit(1)).join(l.withColumn("b", F.lit(1)), "doc_id", "full_outer")
    return both.agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"))


@query("saved_vs_recomputed", f"{FACT}, m AS (SELECT provider, count_if(outcome <> '2xx') AS failed, count(*) AS n FROM attempts GROUP BY 1) SELECT provider, 'failed' AS \"column\", CAST(failed + 1 AS VARCHAR) AS saved, CAST(failed AS VARCHAR) AS recomputed FROM m WHERE provider IN ('arm2', 'arm5')")
def saved_vs_recomputed(spark, sf_dir):
    now = attempts(spark, sf_dir).groupBy("provider").agg(F.count_if(F.col("outcome") != "2xx").alias("failed"), F.count(F.lit(1)).alias("n"))
    saved = now.withColumn("failed", F.when(F.col("provider").isin("arm2", "arm5"), F.col("failed") + 1).otherwise(F.col("failed")))
    return reconcile.differences(saved, now, ["provider"], ["failed", "n"])


@query("immutable_upsert", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN 'insert' ELSE 'conflict' END AS action FROM orders WHERE o_orderkey % 10 = 0 OR (o_orderkey % 10 = 1 AND o_orderstatus <> 'X')")
def immutable_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    old = orders.where("o_orderkey % 10 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 1, "X").otherwise(F.col("o_orderstatus")))
    return reconcile.immutable_upsert(old.withColumn("content", F.col("o_orderstatus")).drop("o_orderstatus").withColumnRenamed("content", "o_orderstatus"), orders, "o_orderkey", F.col("o_orderstatus"), strict=False)


@query("merge_by_priority", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'atomic' ELSE 'materialised' END AS origin FROM orders")
def merge_by_priority(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return reconcile.merge_by_priority(o.where("o_orderkey % 3 = 0").withColumn("origin", F.lit("atomic")), o.withColumn("origin", F.lit("materialised")), "o_orderkey")


@query("expected_pairs_missing", "SELECT c_custkey, s.o_orderstatus FROM customer, (SELECT DISTINCT o_orderstatus FROM orders) s WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderstatus = s.o_orderstatus)")
def expected_pairs(spark, sf_dir):
    o, c = (table(spark, sf_dir, t) for t in ("orders", "customer"))
    seen = o.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus").distinct()
    return reconcile.missing_pairs(c.select("c_custkey"), o.select("o_orderstatus").distinct(), seen)


@query("map_changes", "SELECT coalesce(a.p, b.p) AS path, CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM (SELECT p_name || p_partkey AS p, p_size AS h FROM part WHERE p_partkey % 5 <> 0) a FULL JOIN (SELECT p_name || p_partkey AS p, CASE WHEN p_partkey % 11 = 0 THEN p_size + 1 ELSE p_size END AS h FROM part WHERE p_partkey % 7 <> 0) b ON a.p = b.p WHERE a.p IS NULL OR b.p IS NULL OR a.h <> b.h")
def map_changes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"), "p_partkey", "p_size")
    return reconcile.map_changes(p.where("p_partkey % 5 <> 0").select("path", F.col("p_size").alias("hash")), p.where("p_partkey % 7 <> 0").select("path", F.when(F.col("p_partkey") % 11 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("hash")))


@query("strict_json_matrix")
def strict_json_matrix(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "props")
    forms = F.explode(F.array("props", F.concat("props", F.lit(" {}")), F.regexp_replace("props", "\\}$", ',"k": 1}'), F.regexp_replace("props", ": *[0-9]+", ": NaN"), F.concat(F.lit("```"), F.col("props")), F.lit("")))
    return e.select("event_id", forms.alias("t")).select("event_id", "t", strict_json("t").alias("j")).select("event_id", "t", "j.ok", "j.kind", "j.canonical")


@query("normalize_match")
def normalize_match(spark, sf_dir):
    small_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(normalize_answer("text").cast("binary"), 256).alias("normal_sha256"))


def _tickets(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    cats, pris = F.array(*[F.lit(c) for c in outcomes.CATEGORIES]), F.array(*[F.lit(p) for p in outcomes.PRIORITIES])
    e = table(spark, sf_dir, "events").select("event_id", F.get(cats, k % 4).alias("category"), F.get(pris, F.floor(k / 4).cast("int") % 4).alias("priority"), k.alias("k"))
    said = F.when(F.col("k") < 5, F.format_string('{"category":"%s"}', "category")).when(F.col("k") < 10, F.format_string('{"category":"%s","priority":"p9"}', "category")).when(F.col("k") < 15, F.lit("{} {}")).when(F.col("k") < 20, F.format_string('{"priority":"p0","category":"%s"}', "category")).otherwise(F.format_string('{"category":"%s","priority":"%s"}', "category", "priority"))
    return e.withColumn("answer", said)


@query("ticket_eval", "WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) SELECT event_id, k >= 15 AS schema_valid, k >= 20 OR (k >= 15 AND (k // 4) % 4 = 0) AS correct, CASE WHEN k < 5 THEN 'missing_required_field' WHEN k < 10 THEN 'schema_invalid' WHEN k < 15 THEN 'malformed_json' END AS error_type FROM e")
def ticket_eval(spark, sf_dir):
    return outcomes.evaluate_ticket(_tickets(spark, sf_dir), "answer", "category", "priority").select("event_id", "schema_valid", "correct", "error_type")


@query("lookup_eval", "SELECT item_id, item_id % 3 <> 2 AS schema_valid, item_id % 3 = 0 AS correct FROM benchmark")
def lookup_eval(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("gold"))
    said = F.when(F.col("item_id") % 3 == 0, F.to_json(F.struct(F.concat(F.lit("  "), F.upper("gold"), F.lit(" ")).alias("answer")))).when(F.col("item_id") % 3 == 1, F.lit('{"answer":"nobody"}')).otherwise(F.lit('{"answer":1}'))
    return outcomes.evaluate_lookup(b.select("item_id", said.alias("said"), F.array("gold").alias("accepted")), "said", "accepted").select("item_id", "schema_valid", "correct")


def _contracts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    gold = F.format_string('{"agreement_type":"saas_subscription","effective_date":"2024-01-05","initial_term_end_date":"2025-01-05","auto_renews":true,"renewal_term_months":%d,"non_renewal_notice_days":null,"payment_terms_days":30,"termination_for_convenience":false,"termination_notice_days":60,"security_incident_notice_hours":72}', "k")
    e = e.withColumn("gold", gold)
    said = F.when(F.col("k") < 10, F.regexp_replace("gold", "\"renewal_term_months\":\\d+", '"renewal_term_months":true')).when(F.col("k") < 20, F.regexp_replace("gold", "2024-01-05", "2024-02-30")).when(F.col("k") < 30, F.regexp_replace("gold", '"payment_terms_days":30,', "")).when(F.col("k") < 40, F.regexp_replace("gold", '"payment_terms_days":30', '"payment_terms_days":31')).otherwise(F.col("gold"))
    return e.withColumn("answer", said)


@query("contract_eval", "WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) SELECT event_id, CASE WHEN k < 40 THEN 9 ELSE 10 END AS correct_field_count, k >= 30 AS schema_valid, k >= 40 AS correct, CASE WHEN k BETWEEN 20 AND 29 THEN 'missing_required_field' WHEN k < 20 THEN 'schema_invalid' END AS error_type FROM e")
def contract_eval(spark, sf_dir):
    return outcomes.evaluate_contract(_contracts(spark, sf_dir), "answer", "gold").select("event_id", "correct_field_count", "schema_valid", "correct", "error_type")


@query("contract_field_median", "WITH e AS (SELECT event_id % 10 AS provider, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 40 THEN 9 ELSE 10 END AS c FROM events) SELECT provider, median(c) AS median_fields, count(*) AS n FROM e GROUP BY 1")
def contract_field_median(spark, sf_dir):
    e = outcomes.evaluate_contract(_contracts(spark, sf_dir), "answer", "gold").withColumn("provider", F.col("event_id") % 10)
    return metrics.median_fields(e)


@query("classification_counts", f"{FACT} SELECT provider, CASE WHEN outcome <> '2xx' THEN 'failed_request' WHEN invalid THEN 'invalid_result' WHEN correct THEN 'valid_result' ELSE 'incorrect_result' END AS classification, count(*) AS n FROM fact GROUP BY ALL")
def classification_counts(spark, sf_dir):
    f = request_facts(spark, sf_dir)
    return f.groupBy("provider", outcomes.classification(F.col("outcome"), ~F.col("invalid"), F.col("correct")).alias("classification")).agg(F.count(F.lit(1)).alias("n"))


@query("iso_dates", "SELECT o_orderkey, o_orderkey % 4 = 0 AS ok FROM orders")
def iso_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    said = F.when(F.col("o_orderkey") % 4 == 1, F.concat(F.substring("d", 1, 4), F.lit("-02-30"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.col("d"), F.lit("T"))).when(F.col("o_orderkey") % 4 == 3, F.lit("0000-01-01")).otherwise(F.col("d"))
    return o.select("o_orderkey", iso_date(said).alias("ok"))


@query("round_ids_sha", "SELECT item_id, 'round-' || substr(sha256('slug' || chr(0) || 'f' || chr(0) || item_id), 1, 24) AS round_id FROM benchmark")
def round_ids(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", short_id("round-", F.lit("slug"), F.lit("f"), F.col("item_id").cast("string")).alias("round_id"))


@query("rotation_launch_index", f"{FACT} SELECT seq, (((seq % 10) - round_index) % 10 + 10) % 10 AS launch_index FROM attempts")
def rotation(spark, sf_dir):
    return attempts(spark, sf_dir).select("seq", schedule.launch_index(F.col("seq") % 10, F.col("round_index"), 10).cast("long").alias("launch_index"))


@query("interleaved_schedule", "SELECT item_id, f.i AS family, (row_number() OVER (PARTITION BY f.i ORDER BY item_id) - 1) * 3 + f.i AS round_index FROM benchmark, (SELECT unnest([0, 1, 2]) AS i) f")
def interleaved(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id").select("item_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("family"))
    return b.select("item_id", "family", schedule.round_index((F.row_number().over(Window.partitionBy("family").orderBy("item_id")) - 1).cast("long"), 3, F.col("family")).alias("round_index"))


@query("selection_prefix")
def selection_prefix(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 3).cast("string").alias("family"), "item_id")
    return schedule.shuffled_order(items, "slug", "release").where("order_index < 10")


@query("launch_budget", f"{FACT.replace('WITH', 'WITH RECURSIVE', 1)}, l AS (SELECT provider, seq, k / 100e0 AS amount, row_number() OVER (PARTITION BY provider ORDER BY seq) AS nth FROM attempts), b AS (SELECT provider, seq, amount, nth, CASE WHEN amount <= 5 THEN amount ELSE 0e0 END AS running, amount <= 5 AS accepted FROM l WHERE nth = 1 UNION ALL SELECT l.provider, l.seq, l.amount, l.nth, CASE WHEN b.running + l.amount <= 5 THEN b.running + l.amount ELSE b.running END, b.running + l.amount <= 5 FROM b JOIN l ON l.provider = b.provider AND l.nth = b.nth + 1) SELECT provider, seq AS \"order\", amount, running, accepted FROM b")
def launch_budget(spark, sf_dir):
    a = attempts(spark, sf_dir).select("provider", F.col("seq").alias("order"), (F.col("k") / 100.0).alias("amount"))
    return schedule.running_budget(a, "order", "amount", "provider", 5.0)


@query("lineitem_cost_by_nation", f"WITH l AS (SELECT n_name, l_quantity, (l_quantity * 0.15 + l_linenumber * 0.5) / 1e6 AS cost FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) SELECT n_name, round(sum(cost), 6) AS cost, {rank_sql('l_quantity', '0.95e0')} AS quantity_p95, count(*) AS n FROM l GROUP BY 1")
def lineitem_cost(spark, sf_dir):
    l, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    j = l.select("l_suppkey", "l_quantity", "l_linenumber").join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(token_cost(F.col("l_quantity"), F.col("l_linenumber"), F.lit(0.15), F.lit(0.5))), 6).alias("cost"), nearest_rank("l_quantity", "0.95D").alias("quantity_p95"), F.count(F.lit(1)).alias("n"))


@query("header_filter", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS kept FROM events")
def header_filter(spark, sf_dir):
    h = F.create_map(F.lit("Content-Type"), F.lit("text/event-stream"), F.lit("X-RateLimit-Remaining"), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "Retry-After").otherwise("Server"), F.lit("1"))
    return table(spark, sf_dir, "events").select("event_id", F.size(outcomes.rate_limit_headers(h)).alias("kept"))


@query("redact", "SELECT event_id, '{\"authorization\":\"[REDACTED]\",\"note\":\"key [REDACTED] of ' || user_id || '\"}' AS clean FROM events")
def redact_query(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    body = F.format_string('{"note": "key sk-secret of %d", "authorization": "Bearer x"}', "user_id")
    return e.select("event_id", redact(["sk-secret"])(body).alias("clean"))


@query("canonical_hashes", "SELECT event_id, sha256('{\"k\":' || json_extract_string(props, '$.k') || '}') AS content_hash FROM events")
def canonical_hashes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.sha2(canonical_json("props").cast("binary"), 256).alias("content_hash"))


@query("stream_event_classes", "SELECT role, CASE role WHEN 'assistant' THEN 'answer' WHEN 'user' THEN 'reasoning' ELSE 'metadata' END AS class, count(*) AS n FROM conversations GROUP BY ALL")
def event_classes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    nothing = F.array().cast("array<string>")
    cls = outcomes.event_class(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "assistant", F.col("text")), F.lit(False), F.lit(None).cast("string"), nothing, F.lit(False))
    return c.groupBy("role", cls.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("audit_violations", f"{FACT}, m AS (SELECT provider, CAST(count(*) AS BIGINT) AS n, round(sum(e2e_ms), 3) AS s FROM fact GROUP BY 1) SELECT provider, 'n' AS \"column\", CAST(n - 1 AS VARCHAR) AS saved, CAST(n AS VARCHAR) AS recomputed FROM m WHERE provider = 'arm4'")
def audit(spark, sf_dir):
    now = request_facts(spark, sf_dir).groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("e2e_ms"), 3).alias("s"))
    saved = now.withColumn("n", F.when(F.col("provider") == "arm4", F.col("n") - 1).otherwise(F.col("n")))
    return reconcile.differences(saved, now, ["provider"], ["n", "s"])


@query("config_checks", f"{FACT} SELECT seq, CASE WHEN outcome <> '2xx' THEN 'completed' WHEN k > 90 THEN 'token_cap' ELSE '' END AS failed FROM attempts")
def config_checks(spark, sf_dir):
    a = attempts(spark, sf_dir)
    return a.select("seq", F.array_join(outcomes.failed_checks({"completed": F.col("outcome") == "2xx", "token_cap": (F.col("k") <= 90) | (F.col("outcome") != "2xx")}), ",").alias("failed"))


@query("compatibility_rollup", f"{FACT} SELECT provider, count(*) AS records, bool_and(k < 99 OR outcome = '2xx') AS compatible, coalesce(array_to_string(list_sort(list(DISTINCT outcome) FILTER (WHERE outcome <> '2xx')), ','), '') AS reasons FROM attempts GROUP BY 1")
def compatibility(spark, sf_dir):
    a = attempts(spark, sf_dir)
    return a.groupBy("provider").agg(F.count(F.lit(1)).alias("records"), F.bool_and((F.col("k") < 99) | (F.col("outcome") == "2xx")).alias("compatible"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("outcome") != "2xx", F.col("outcome")))), ",").alias("reasons"))


@query("run_acceptance", f"{FACT} SELECT true AS all_requests, count(DISTINCT (round_id, provider)) = count(*) AS unique_requests, true AS outcomes_known, coalesce(bool_and(ttfa_ms IS NULL OR ttfa_ms <= e2e_ms), true) AS times_in_order, true AS no_failed_correct, true AS no_violations, coalesce(bool_and(ttfa_ms IS NULL OR ttfa_ms <= e2e_ms), true) AND count(DISTINCT (round_id, provider)) = count(*) AS accepted FROM fact")
def run_acceptance(spark, sf_dir):
    from pairlens.operators.report import acceptance

    fact = request_facts(spark, sf_dir)
    return acceptance(fact, fact.count(), reconcile.duplicates(fact, ["round_id", "provider"]))


@query("event_reconciliation", "SELECT conv_id AS request_id, turn AS event_index, CASE WHEN conv_id % 11 = 0 THEN 'not embedded' WHEN conv_id % 13 = 0 THEN 'different' END AS problem FROM conversations WHERE turn = 0 AND (conv_id % 11 = 0 OR conv_id % 13 = 0)")
def event_reconciliation(spark, sf_dir):
    from pairlens.sources.artifacts import reconcile_events

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("event_index"), F.col("text").alias("answer"))
    first = F.col("event_index") == 0
    embedded = c.where(~(first & (F.col("request_id") % 11 == 0))).withColumn("answer", F.when(first & (F.col("request_id") % 13 == 0), F.lit("#")).otherwise(F.col("answer")))
    return reconcile_events(c.withColumn("durability", F.lit("arrival")), embedded)
