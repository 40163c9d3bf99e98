"""Queries over batches of nested answer records, made of whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.catalog import _POSTINGS, _WORDS, _item_index, _items, _query
from textquarry.operators import audits, batches, bm25, chunking, fusion, parsing, vectors
from textquarry.session import materialize, table

_TOOLS = ("bm25_search", "graph_search", "calculator")


def _records(spark, sf, second: bool = False) -> DataFrame:
    """(question_id, response): a document with its labels as a nested record; what a document has no label for is missing or null.

    The second batch takes the labels the other way round and lacks the last character of texts that end with a full stop.
    """
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    good, bad = (F.col("toxic"), F.col("quality")) if second else (F.col("quality"), F.col("toxic"))
    labelled = good.isNotNull()
    answer = F.regexp_replace("text", r"\.$", "") if second else F.col("text")
    agent = F.struct(
        F.when(labelled, F.col("source")).alias("stop_reason"), (F.length("text") / (4.0 if second else 8.0)).alias("total_latency_ms"),
        F.transform(F.array(*map(F.lit, _TOOLS)), lambda t: F.struct(t.alias("tool_name"), ((t == "graph_search") == (F.col("lang") == "fr")).alias("success"))).alias("tool_invocations"),
    )
    context = F.when(labelled, F.struct(F.transform(F.array("source", "lang"), lambda x: F.struct(x.alias("reason"))).alias("selection_trace"), F.size(F.split("text", "\n")).alias("selected_count")))
    salvage = F.when(bad == 1, F.struct(F.lit(True).alias("attempted"), F.when(good == 1, F.lit("succeeded")).alias("outcome"), F.struct(F.array(F.struct(F.array("lang", F.lit("unsupported")).alias("errors"))).alias("claim_verifications")).alias("initial_verification")))
    warnings = F.array_compact(F.array(F.when(bad == 1, F.lit(batches.GENERATOR_ERROR)), F.when(good == 0, F.lit(batches.CITATION_FAILURE)), F.col("lang")))
    response = F.struct(
        answer.alias("answer"), warnings.alias("warnings"), (F.length("text") < 200).alias("insufficient_evidence"), F.when(F.col("lang") == "en", F.lit("graph")).when(labelled, F.col("lang")).alias("retrieval_strategy"),
        F.array_repeat(F.col("lang"), F.coalesce(good, F.lit(0))).alias("citations"), F.struct(agent.alias("agent"), context.alias("context"), salvage.alias("claim_salvage")).alias("metadata"),
    )
    return d.select(F.col("doc_id").alias("question_id"), F.to_json(response).alias("response"))


_BASE = """d AS (SELECT documents.doc_id, text, lang, source, quality AS good, toxic AS bad FROM documents LEFT JOIN labels USING (doc_id))"""
_ROWS = """r AS (
  SELECT 'record' AS counter, 'true' AS value FROM d UNION ALL SELECT 'warning', 'generator:model_error' FROM d WHERE bad = 1 UNION ALL SELECT 'warning', 'citation_verification_failed' FROM d WHERE good = 0 UNION ALL SELECT 'warning', lang FROM d WHERE lang IS NOT NULL
  UNION ALL SELECT 'insufficient_evidence', 'true' FROM d WHERE length(text) < 200 UNION ALL SELECT 'generator_model_error', 'true' FROM d WHERE bad = 1 UNION ALL SELECT 'generation_failure_code', 'unclassified' FROM d WHERE bad = 1
  UNION ALL SELECT 'citation_failure', 'true' FROM d WHERE good = 0 UNION ALL SELECT 'stop_reason', CASE WHEN good IS NOT NULL THEN source ELSE 'missing' END FROM d
  UNION ALL SELECT 'retrieval_strategy', CASE WHEN lang = 'en' THEN 'graph' WHEN good IS NOT NULL THEN lang ELSE 'missing' END FROM d UNION ALL SELECT 'claim_salvage', CASE WHEN good = 1 THEN 'succeeded' ELSE 'missing' END FROM d WHERE bad = 1
  UNION ALL SELECT 'claim_error', unnest([lang, 'unsupported']) FROM d WHERE bad = 1 UNION ALL SELECT 'context_trace_present', 'true' FROM d WHERE good IS NOT NULL UNION ALL SELECT 'selection_reason', unnest([source, lang]) FROM d WHERE good IS NOT NULL
  UNION ALL SELECT 'tool_attempt', unnest(['bm25_search', 'graph_search']) FROM d UNION ALL SELECT 'tool_success', CASE WHEN lang = 'fr' THEN 'graph_search' ELSE 'bm25_search' END FROM d
  UNION ALL SELECT 'graph_touched', 'true' FROM d UNION ALL SELECT 'graph_final', 'true' FROM d WHERE lang = 'en'
)"""


@_query(f"WITH {_BASE}, {_ROWS} SELECT counter, value, count(*) AS n FROM r GROUP BY GROUPING SETS ((counter, value), (counter))")
def answer_batch_census(spark, sf):
    """Every counter of nested answer records, a row a value, with totals."""
    return batches.batch_census(_records(spark, sf))


@_query(f"""WITH {_BASE}, {_ROWS}, c AS (SELECT counter, value, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT counter, sum(n) AS n FROM c GROUP BY 1)
SELECT (SELECT count(*) FROM d)::BIGINT AS records, coalesce((SELECT n FROM t WHERE counter = 'insufficient_evidence'), 0)::BIGINT AS insufficient, coalesce((SELECT n FROM t WHERE counter = 'citation_failure'), 0)::BIGINT AS citation_failures, coalesce((SELECT n FROM t WHERE counter = 'context_trace_present'), 0)::BIGINT AS traces,
  coalesce((SELECT n FROM t WHERE counter = 'claim_salvage'), 0)::BIGINT AS claim_salvage_attempted, coalesce((SELECT n FROM c WHERE counter = 'claim_salvage' AND value = 'succeeded'), 0)::BIGINT AS claim_salvage_succeeded, coalesce((SELECT n FROM c WHERE counter = 'claim_salvage' AND value <> 'succeeded'), 0)::BIGINT AS claim_salvage_failed,
  'context_selection_trace_partially_present,citation_verification_metadata_partially_present' AS warnings""")
def answer_batch_report(spark, sf):
    """The census as one row; only a part of the documents has labels, and so a trace."""
    names = ["records", "insufficient", "citation_failures", "traces", "claim_salvage_attempted", "claim_salvage_succeeded", "claim_salvage_failed"]
    return batches.census_report(batches.batch_census(_records(spark, sf))).select(*names, F.array_join("warnings", ",").alias("warnings"))


@_query(f"""WITH {_BASE}, v AS (
  SELECT 'latency_ms' AS counter, length(text) / 8.0::DOUBLE AS v FROM d WHERE text IS NOT NULL UNION ALL SELECT 'selected_count', len(string_split(text, chr(10)))::DOUBLE FROM d WHERE good IS NOT NULL UNION ALL SELECT 'answer_chars', length(text)::DOUBLE FROM d WHERE text IS NOT NULL
  UNION ALL SELECT 'answer_words', len(list_filter(string_split_regex(text, '[\\s\\x0B\\x1C-\\x1F\\x85\\xA0\\p{{Z}}]+'), lambda w: w <> ''))::DOUBLE FROM d WHERE text IS NOT NULL
), s AS (SELECT counter, list_sort(list(v)) AS s, round(avg(v), 6) AS mean FROM v GROUP BY 1)
SELECT counter, len(s)::BIGINT AS n, mean, s[(round_even((len(s) - 1) * 0.5, 0))::INT + 1] AS p50, s[(round_even((len(s) - 1) * 0.95, 0))::INT + 1] AS p95, s[len(s)] AS max FROM s""")
def answer_batch_measures(spark, sf):
    """Latency, selected evidence and answer lengths of nested answer records, percentiles by nearest rank."""
    return batches.batch_measures(_records(spark, sf)).withColumn("mean", F.round("mean", 6))


_SIDES = """a AS (SELECT doc_id, text, coalesce(quality, 0) AS cites, CASE WHEN quality IS NOT NULL THEN source ELSE 'missing' END AS stop, length(text) < 200 AS short, coalesce(quality = 0, false) AS cit, coalesce(toxic = 1, false) AS gen, length(text) / 8.0::DOUBLE AS ms FROM documents LEFT JOIN labels USING (doc_id)),
b AS (SELECT doc_id, regexp_replace(text, '\\.$', '') AS text, coalesce(toxic, 0) AS cites, CASE WHEN toxic IS NOT NULL THEN source ELSE 'missing' END AS stop, length(text) < 200 AS short, coalesce(toxic = 0, false) AS cit, coalesce(quality = 1, false) AS gen, length(text) / 4.0::DOUBLE AS ms FROM documents LEFT JOIN labels USING (doc_id)),
j AS (SELECT doc_id, a.text <> b.text AS changed, a.stop AS sa, b.stop AS sb, a.short AS ia, b.short AS ib, a.cit AS ca, b.cit AS cb, a.gen AS ga, b.gen AS gb, a.cites AS na, b.cites AS nb, b.ms - a.ms AS delta FROM a JOIN b USING (doc_id))"""


@_query(f"""WITH {_SIDES} SELECT counter, transition, count(*) AS n FROM (
  SELECT 'stop_reason' AS counter, sa || '->' || sb AS transition FROM j UNION ALL SELECT 'insufficient_evidence', ia::VARCHAR || '->' || ib::VARCHAR FROM j UNION ALL SELECT 'citation_failure', ca::VARCHAR || '->' || cb::VARCHAR FROM j
  UNION ALL SELECT 'generator_model_error', ga::VARCHAR || '->' || gb::VARCHAR FROM j UNION ALL SELECT 'answer_changed', changed::VARCHAR FROM j) GROUP BY ALL""")
def batch_outcome_transitions(spark, sf):
    """Outcomes of two batches of nested answer records over the same questions, question by question."""
    return batches.compare_batches(_records(spark, sf), _records(spark, sf, second=True), "question_id")[0]


@_query(f"WITH {_SIDES} SELECT doc_id AS question_id, changed AS answer_changed, sa AS base_stop_reason, sb AS candidate_stop_reason, na::INT AS base_citations, nb::INT AS candidate_citations, round(delta, 6) AS latency_delta_ms FROM j WHERE changed OR sa <> sb OR ia <> ib OR ca <> cb OR ga <> gb OR na <> nb")
def batch_changed_cases(spark, sf):
    """Questions whose answer or outcome differs between two batches, with the change in latency."""
    found = batches.compare_batches(_records(spark, sf), _records(spark, sf, second=True), "question_id")[1]
    return found.select("question_id", "answer_changed", "base_stop_reason", "candidate_stop_reason", "base_citations", "candidate_citations", F.round("latency_delta_ms", 6).alias("latency_delta_ms"))


@_query("""WITH p AS (SELECT props FROM events), k AS (SELECT props, unnest(json_keys(props)) AS key FROM p WHERE props IS NOT NULL)
SELECT '$' AS path, CASE WHEN props IS NULL THEN 'MISSING' ELSE 'OBJECT' END AS kind, count(*) AS n FROM p GROUP BY 2
UNION ALL SELECT '$.' || key, CASE json_type(props, '$.' || key) WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' ELSE json_type(props, '$.' || key) END, count(*) FROM k GROUP BY 1, 2""")
def event_fields(spark, sf):
    """The fields of the events' nested properties with the kinds of their values."""
    return batches.field_census(table(spark, sf, "events"), "props", 4)


@_query()
def chunks_of_stored_blocks(spark, sf):
    """The documents' chunks from their written blocks and titles, merged document by document; a test holds them against one pass over the texts."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text", F.col("source").alias("title"))
    blocks = materialize(parsing.parse_documents(d, "document_id", "text"), "blocks")
    return chunking.chunk_blocks(blocks, d)


# --- audits of corpora, pools and runs --------------------------------------------------------------

_FOLDED = r"lower(trim(regexp_replace({0}, '[\s\x0B\x1C-\x1F\x85\xA0\p{{Z}}]+', ' ', 'g')))"
_KEYS = f"""k AS (SELECT kind, key, id FROM (SELECT 'exact' AS kind, text AS key, doc_id AS id FROM documents UNION ALL SELECT 'folded', {_FOLDED.format('text')}, doc_id FROM documents UNION ALL SELECT 'first_line', split_part(text, chr(10), 1), doc_id FROM documents) WHERE trim(regexp_replace(key, '[\\s\\x0B\\x1C-\\x1F\\x85\\xA0\\p{{Z}}]+', '', 'g')) <> ''),
c AS (SELECT kind, key, count(*) AS size, min(id) AS first FROM k GROUP BY 1, 2)"""


def _keys():
    return {"exact": F.col("text"), "folded": audits.folded(F.col("text")), "first_line": F.split_part("text", F.lit("\n"), F.lit(1))}


@_query(f"WITH {_KEYS} SELECT kind, count_if(size > 1) AS clusters, coalesce(sum(size) FILTER (size > 1), 0)::BIGINT AS records, round(coalesce(sum(size) FILTER (size > 1), 0) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 6) AS share FROM c GROUP BY kind")
def duplicate_clusters(spark, sf):
    """Copies of whole texts, folded texts and first lines."""
    return audits.duplicate_clusters(table(spark, sf, "documents"), "doc_id", _keys()).withColumn("share", F.round("share", 6))


@_query(f"""WITH {_KEYS}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY size DESC, first) AS place FROM c WHERE size > 1) WHERE place <= 5),
m AS (SELECT t.kind, t.place, t.size, k.id, row_number() OVER (PARTITION BY t.kind, t.place ORDER BY k.id) AS r FROM t JOIN k ON k.kind = t.kind AND k.key = t.key)
SELECT kind, place, size, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM m WHERE r <= 5 GROUP BY ALL""")
def largest_clusters(spark, sf):
    found = audits.largest_clusters(table(spark, sf, "documents"), "doc_id", _keys())
    return found.select("kind", "place", "size", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@_query(r"""WITH t AS (SELECT contains(text, chr(13) || chr(10)) AS crlf, contains(replace(text, chr(13) || chr(10), ''), chr(10)) AS lf, contains(replace(text, chr(13) || chr(10), ''), chr(13)) AS cr, nfc_normalize(text) <> text AS odd FROM (SELECT coalesce(text, '') AS text FROM documents))
SELECT count(*) AS texts, count_if(crlf AND NOT (lf OR cr)) AS crlf, count_if(lf AND NOT crlf) AS lf, count_if(cr AND NOT crlf AND NOT lf) AS cr, count_if(crlf AND (lf OR cr)) AS mixed, count_if(NOT crlf AND NOT lf AND NOT cr) AS none, count_if(odd) AS not_composed FROM t""")
def text_styles(spark, sf):
    return audits.style_profile(table(spark, sf, "documents"), "text")


@_query(r"SELECT doc_id AS id, length(text) AS chars, len(list_filter(string_split_regex(text, '[\s\x0B\x1C-\x1F\x85\xA0\p{Z}]+'), lambda w: w <> '')) AS words FROM documents ORDER BY length(text) DESC, doc_id LIMIT 20")
def largest_documents(spark, sf):
    return audits.largest_documents(table(spark, sf, "documents"), "doc_id", "text")


_POOL = f"""{_POSTINGS.replace('{k}', '40')},
p AS (SELECT h.query_id, h.chunk_id, d.source AS document_id, h.rank AS fused_rank, {_WORDS.format('b.text')} AS q, {_WORDS.format('d.text')} AS e FROM hits h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d ON d.doc_id = h.chunk_id),
s AS (SELECT query_id, chunk_id, document_id, fused_rank, round(len(list_intersect(q, e))::DOUBLE / len(q), 8) AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank, chunk_id) AS deep, row_number() OVER (PARTITION BY query_id, fused_rank <= 20 ORDER BY score DESC, fused_rank, chunk_id) AS near FROM s),
l AS (SELECT *, fused_rank <= 20 AND near <= 8 AS a, deep <= 8 AS b FROM r),
audit AS (SELECT query_id, bool_and(a AND b AND near = deep) AS identical, count_if(a AND b) AS overlap, count_if(b AND NOT a) AS entrants, count_if(a AND NOT b) AS displaced, count_if(a AND b)::DOUBLE / count(*) AS jaccard, min(score) FILTER (a) AS shallow_cutoff, min(score) FILTER (b) AS deep_cutoff,
  round(min(score) FILTER (b AND NOT a) - max(score) FILTER (a AND NOT b), 8) AS margin, len(list_distinct(list(document_id) FILTER (b))) - len(list_intersect(list_distinct(list(document_id) FILTER (b)), list_distinct(list(document_id) FILTER (a)))) AS new_documents FROM l WHERE a OR b GROUP BY query_id)"""


def _pool(spark, sf):
    index = _item_index(spark, sf)
    hits = bm25.search(bm25.plan_queries(_items(spark, sf), index, "item_id", "text"), index, 40)
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("document_id"))
    scored = vectors.late_materialise(hits.join(_items(spark, sf).select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), "query_id"), texts, "chunk_id")
    return audits.pool_audit(scored.select("query_id", "chunk_id", "document_id", F.col("rank").alias("fused_rank"), fusion.lexical_scorer(F.col("question"), F.col("text")).alias("score")))


@_query(f"WITH {_POOL} SELECT query_id, identical, overlap, entrants, displaced, round(jaccard, 9) AS jaccard, round(shallow_cutoff, 8) AS shallow_cutoff, round(deep_cutoff, 8) AS deep_cutoff, margin, new_documents FROM audit")
def pool_depth_audit(spark, sf):
    """The best 8 by shared words from the first 20 and from the first 40 BM25 hits of every benchmark item."""
    found = _pool(spark, sf)
    return found.select("query_id", "identical", "overlap", "entrants", "displaced", F.round("jaccard", 9).alias("jaccard"), "shallow_cutoff", "deep_cutoff", "margin", F.col("new_documents").cast("long").alias("new_documents"))


@_query(f"WITH {_POOL}, n AS (SELECT unnest(['21-25', '26-30', '31-35', '36-40']) AS bucket) SELECT bucket, (SELECT count(*) FROM l WHERE b AND NOT a AND bucket = (21 + 5 * ((fused_rank - 21) // 5))::VARCHAR || '-' || (25 + 5 * ((fused_rank - 21) // 5))::VARCHAR)::BIGINT AS entrants FROM n")
def pool_entrant_buckets(spark, sf):
    return audits.entrant_buckets(_pool(spark, sf))


@_query(f"WITH {_POOL} SELECT count(*) AS cases, count_if(identical) AS identical_cases, count_if(NOT identical) AS changed_cases, sum(entrants)::BIGINT AS entrants, count_if(entrants > 0) AS cases_with_entrants, sum(new_documents)::BIGINT AS new_documents, round(avg(overlap), 4) AS overlap_mean, min(overlap) AS overlap_min, max(overlap) AS overlap_max, round(avg(shallow_cutoff), 6) AS shallow_cutoff_mean, round(avg(deep_cutoff), 6) AS deep_cutoff_mean, round(avg(margin), 6) AS margin_mean FROM audit")
def pool_audit_summary(spark, sf):
    names = ["cases", "identical_cases", "changed_cases", "entrants", "cases_with_entrants", "new_documents", "overlap_mean", "overlap_min", "overlap_max"]
    return audits.pool_summary(_pool(spark, sf)).select(*names, *[F.round(c, 6).alias(c) for c in ("shallow_cutoff_mean", "deep_cutoff_mean", "margin_mean")])


_RUNS = "r AS (SELECT doc_id, text AS reference, split_part(text, chr(10), 1) AS a, left(text, 700) AS b, length(text) > 1500 AS ha, length(text) > 2500 AS hb FROM documents)"


def _runs(spark, sf):
    """First lines as the base's answers, the first 700 characters as the treatment's, whole texts as references."""
    d = table(spark, sf, "documents")
    run = lambda answer, most: d.select(F.col("doc_id").alias("question_id"), answer.alias("answer"), F.lit("success").alias("status"), (F.length("text") > most).alias("hit_max"))
    return audits.paired_runs(run(F.split_part("text", F.lit("\n"), F.lit(1)), 1500), run(F.left("text", F.lit(700)), 2500), d.select(F.col("doc_id").alias("question_id"), F.col("text").alias("reference")))


@_query(f"""WITH {_RUNS}, s AS (SELECT 'exact' AS metric, (a = reference)::INT::DOUBLE AS x, (b = reference)::INT::DOUBLE AS y FROM r UNION ALL SELECT 'length', length(a) / length(reference)::DOUBLE, length(b) / length(reference)::DOUBLE FROM r WHERE length(reference) > 0)
SELECT metric, count(*) AS cases, round(avg(x), 6) AS base_mean, round(avg(y), 6) AS treatment_mean, round(avg(y - x), 6) AS mean_delta, round(median(y - x), 6) AS median_delta, count_if(y - x > 1e-6) AS win, count_if(abs(y - x) <= 1e-6) AS tie, count_if(y - x < -1e-6) AS loss FROM s GROUP BY 1""")
def paired_run_report(spark, sf):
    runs = _runs(spark, sf)
    scored = runs.where("length(reference) > 0")
    for p in ("base", "treatment"):
        a = F.col(f"{p}_answer")
        scored = scored.withColumns({f"{p}_exact": (a == F.col("reference")).cast("int"), f"{p}_length": F.length(a) / F.length("reference")})
    found = audits.paired_report(scored, ["exact", "length"])
    return found.select("metric", "cases", *[F.round(c, 6).alias(c) for c in ("base_mean", "treatment_mean", "mean_delta", "median_delta")], "win", "tie", "loss")


@_query(f"""WITH {_RUNS}, n AS (SELECT count(*) AS cases, avg(length(a)) AS base_chars, avg(length(b)) AS treatment_chars, avg(length(reference)) AS reference_chars, count_if(ha) AS base_hits, count_if(hb) AS treatment_hits FROM r)
SELECT cases, round(base_chars, 6) AS base_chars, round(treatment_chars, 6) AS treatment_chars, round(reference_chars, 6) AS reference_chars, base_hits, treatment_hits,
  concat_ws(',', CASE WHEN base_hits > 0 THEN 'base_generations_hit_max_tokens_count_' || base_hits END, CASE WHEN treatment_hits > 0 THEN 'treatment_generations_hit_max_tokens_count_' || treatment_hits END, CASE WHEN base_hits > 0.02 * cases OR treatment_hits > 0.02 * cases THEN 'screening_potentially_censored' END) AS warnings FROM n""")
def paired_run_lengths(spark, sf):
    found = audits.length_report(_runs(spark, sf))
    return found.select("cases", *[F.round(c, 6).alias(c) for c in ("base_chars", "treatment_chars", "reference_chars")], "base_hits", "treatment_hits", F.array_join("warnings", ",").alias("warnings"))


_REVIEWS = r"""r AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' END AS label, sha256(regexp_replace(text, '^[ \t\n]+|[ \t\n]+$', '', 'g')) AS text_sha256 FROM labels JOIN documents USING (doc_id))"""


def _reviews(spark, sf):
    """The labels as reviews of the documents' texts without white space around them."""
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    label = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return lab.select("doc_id", label.alias("label"), F.sha2(F.regexp_replace("text", r"^[ \t\n]+|[ \t\n]+$", ""), 256).alias("text_sha256"))


@_query(f"""WITH {_REVIEWS} SELECT doc_id, 'unreviewed_packet' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r) UNION ALL SELECT doc_id, 'text_changed' FROM r JOIN documents d USING (doc_id) WHERE r.text_sha256 <> sha256(coalesce(d.text, ''))
UNION ALL SELECT doc_id, 'unknown_label' FROM r WHERE label IS NULL OR label NOT IN ('good', 'poor')""")
def label_freeze_problems(spark, sf):
    """Documents as packets, of which most are unreviewed; a toxic label is none of the allowed ones."""
    return audits.freeze_problems(table(spark, sf, "documents").select("doc_id", "text"), _reviews(spark, sf), ["doc_id"], "text", ["good", "poor"])


@_query(f"WITH {_REVIEWS}, n AS (SELECT unnest(['good', 'poor', 'toxic', 'unclear']) AS label) SELECT n.label, count(r.doc_id) AS n FROM n LEFT JOIN r ON r.label = n.label GROUP BY 1")
def frozen_classes(spark, sf):
    return audits.frozen_classes(_reviews(spark, sf), ["good", "poor", "toxic", "unclear"])
