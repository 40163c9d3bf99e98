"""Queries of single parts: filters, contracts, gates, comparisons, encodings and censuses over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.catalog import _HITS, _edges, _query, bm25_search
from textquarry.operators import analytics, dataset, diagnostics, evidence, fusion, graph, metrics, query, ranks, vectors
from textquarry.plans import retrieval
from textquarry.session import materialize, table

# --- retrieval parts ---------------------------------------------------------------------------------


@_query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_type IN ('ECONOMY')")
def metadata_filter(spark, sf):
    """Two columns with wanted values; a third without any is no condition."""
    return vectors.metadata_filter(table(spark, sf, "part"), {"p_brand": ["Brand#1", "Brand#2"], "p_type": ["ECONOMY"], "p_size": []}).select("p_partkey")


@_query("SELECT doc_id AS query_id, CASE doc_id % 3 WHEN 0 THEN 'b' || doc_id WHEN 1 THEN 'c' || doc_id END AS text FROM documents WHERE doc_id % 3 < 2")
def next_rewrite(spark, sf):
    """Three forms of each question, of which one, two or all are used."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"))
    name = lambda p: F.concat(F.lit(p), F.col("query_id"))
    forms = d.select("query_id", F.explode(F.array(*[F.struct(F.lit(f"qv{i}").alias("variant_id"), name(p).alias("text")) for i, p in enumerate("abc", 1)])).alias("v")).select("query_id", "v.*")
    used = d.select("query_id", F.explode(F.slice(F.array(name("A"), name("b"), name("C")), 1, (F.col("query_id") % 3 + 1).cast("int"))).alias("text"))
    return query.next_rewrite(forms, used)


@_query("""SELECT doc_id, concat_ws(chr(10), CASE WHEN source IS NOT NULL THEN 'Văn bản: ' || source END, CASE WHEN lang IS NOT NULL THEN 'Tình trạng hiệu lực: ' || lang END, text) AS said FROM documents""")
def rerank_texts(spark, sf):
    d = table(spark, sf, "documents").withColumnsRenamed({"source": "document_title", "lang": "effect_status"})
    return d.select("doc_id", fusion.rerank_text(["document_title", "effect_status"], F.col("text")).alias("said"))


@_query(f"""WITH {_HITS}, r AS (SELECT query_id, CASE WHEN query_id % 4 = 0 AND rank = 1 THEN -1 ELSE chunk_id END AS chunk_id, CASE WHEN query_id % 4 = 1 THEN rank + 1 ELSE rank END AS rank FROM hits UNION ALL SELECT query_id, chunk_id, 11 FROM hits WHERE query_id % 4 = 2 AND rank = 2),
g AS (SELECT query_id, count(*) AS n, count(DISTINCT rank) AS d, min(rank) AS a, max(rank) AS b FROM r GROUP BY 1)
SELECT query_id, 'not_a_candidate' AS problem FROM hits WHERE query_id % 4 = 0 AND rank = 1 UNION ALL SELECT query_id, 'duplicate' FROM hits WHERE query_id % 4 = 2 AND rank = 2 UNION ALL SELECT query_id, 'ranks_not_contiguous' FROM g WHERE a <> 1 OR b <> n OR d <> n""")
def rerank_problems(spark, sf):
    """Reranked lists with a foreign chunk, a shifted rank or a repeated chunk, by turns."""
    hits = bm25_search(spark, sf)
    k = F.col("query_id") % 4
    moved = hits.select("query_id", F.when((k == 0) & (F.col("rank") == 1), F.lit(-1)).otherwise(F.col("chunk_id")).alias("chunk_id"), F.when(k == 1, F.col("rank") + 1).otherwise(F.col("rank")).alias("rank"))
    twice = hits.where((F.col("query_id") % 4 == 2) & (F.col("rank") == 2)).select("query_id", "chunk_id", F.lit(11))
    return fusion.rerank_problems(moved.union(twice), hits)


@_query(f"""WITH {_HITS}, h AS (SELECT query_id, chunk_id, rank FROM hits UNION ALL SELECT query_id, chunk_id, 1 FROM hits WHERE rank = 3)
SELECT query_id, 'duplicate_chunk_id' AS problem, chunk_id::VARCHAR AS value FROM h GROUP BY query_id, chunk_id HAVING count(*) > 1 UNION ALL SELECT query_id, 'duplicate_rank', rank::VARCHAR FROM h GROUP BY query_id, rank HAVING count(*) > 1""")
def fusion_conflicts(spark, sf):
    """Hit lists whose third chunk also stands first."""
    hits = materialize(bm25_search(spark, sf).select("query_id", "chunk_id", "rank"), "hits")  # read four times
    return fusion.fusion_conflicts(hits.union(hits.where("rank = 3").select("query_id", "chunk_id", F.lit(1))))


_EDGE_SQL = "e AS (SELECT a.n_nationkey AS source, b.n_nationkey AS target, 'odd' AS raw, CASE WHEN b.n_nationkey % 2 = 0 THEN 'even' END AS kind FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey)"


@_query(f"""WITH {_EDGE_SQL}, bad AS (SELECT source, target, kind, raw FROM e UNION ALL SELECT n_nationkey, n_nationkey, NULL, 'x' FROM nation UNION ALL SELECT 0, 900 + n_nationkey, NULL, 'x' FROM nation UNION ALL SELECT source, target, kind, raw FROM e WHERE source = 0)
SELECT source, target, 'self_loop' AS problem FROM bad WHERE source = target UNION ALL SELECT source, target, 'unknown_target' FROM bad WHERE target >= 900 UNION ALL SELECT source, target, 'duplicate_edge' FROM bad GROUP BY source, target, kind, raw HAVING count(*) > 1""")
def edge_problems(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))
    e, none = _edges(spark, sf).select("source", "target", "kind", "raw"), F.lit(None).cast("string")
    loops = n.select("id", "id", none, F.lit("x"))
    foreign = n.select(F.lit(0).cast(n.schema["id"].dataType), F.col("id") + 900, none, F.lit("x"))
    return graph.edge_problems(e.union(loops).union(foreign).union(e.where("source = 0")), n)


@_query(f"""WITH {_EDGE_SQL}, h AS (SELECT n_regionkey AS query_id, n_nationkey AS chunk_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rank FROM nation), s AS (SELECT * FROM h WHERE rank <= 2),
one AS (SELECT DISTINCT s.query_id, e.target FROM s JOIN e ON e.source = s.chunk_id WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.query_id = s.query_id AND t.chunk_id = e.target)),
two AS (SELECT DISTINCT o.query_id, e.target FROM one o JOIN e ON e.source = o.target WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.query_id = o.query_id AND t.chunk_id = e.target) AND NOT EXISTS (SELECT 1 FROM one p WHERE p.query_id = o.query_id AND p.target = e.target)),
m AS (SELECT * FROM one UNION SELECT * FROM two), b AS (SELECT query_id, chunk_id, 0 AS part, rank AS r FROM s UNION ALL SELECT query_id, target, 1, row_number() OVER (PARTITION BY query_id ORDER BY target) FROM m)
SELECT query_id, chunk_id, part, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, r, chunk_id) AS rank FROM b) WHERE rank <= 4""")
def graph_expanded_search(spark, sf):
    """The first two nations of a region as hits, filled up by nations that they lead to."""
    from pyspark.sql import Window

    n = table(spark, sf, "nation")
    rank = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    hits = n.select(F.col("n_regionkey").alias("query_id"), F.col("n_nationkey").alias("chunk_id"), rank.alias("rank")).where("rank <= 2").withColumn("score", 1.0 / F.col("rank"))
    documents = n.select(F.col("n_nationkey").alias("chunk_id"), F.col("n_nationkey").alias("document_id"))

    def restricted(pairs):
        return pairs.select("query_id", F.col("document_id").alias("chunk_id"), F.lit(0.0).alias("score"), F.row_number().over(Window.partitionBy("query_id").orderBy("document_id")).alias("rank"))

    return retrieval.graph_expanded(hits, documents, _edges(spark, sf), restricted, 4).select("query_id", "chunk_id", "part", "rank")


@_query(f"""WITH {_HITS}, b AS (SELECT query_id, CASE WHEN query_id % 2 = 0 AND rank = 2 THEN -1 ELSE chunk_id END AS c, CASE WHEN query_id % 3 = 0 THEN score + 0.5 ELSE score END AS s, rank FROM hits)
SELECT h.query_id, bool_and(h.chunk_id = b.c) AS same_ids, bool_and(abs(h.score - b.s) <= 1e-9) AS same_scores, round(max(abs(h.score - b.s)), 6) AS max_delta FROM hits h JOIN b ON b.query_id = h.query_id AND b.rank = h.rank GROUP BY 1""")
def hit_list_differences(spark, sf):
    hits = bm25_search(spark, sf)
    other = hits.select("query_id", "rank", F.when((F.col("query_id") % 2 == 0) & (F.col("rank") == 2), F.lit(-1)).otherwise(F.col("chunk_id")).alias("chunk_id"), F.when(F.col("query_id") % 3 == 0, F.col("score") + 0.5).otherwise(F.col("score")).alias("score"))
    return analytics.hit_list_differences(hits, other).withColumn("max_delta", F.round("max_delta", 6))


# --- answers and citations ------------------------------------------------------------------------------

@_query("""SELECT doc_id, length(text) < 40 OR regexp_matches(lower(text), '[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]') AS ok FROM documents WHERE text IS NOT NULL""")
def language_gate(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", evidence.is_vietnamese(F.col("text")).alias("ok"))


@_query("""WITH l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL)
SELECT l_orderkey AS question_id, l_linenumber::VARCHAR AS evidence_id, o_orderkey IS NOT NULL AS known, o_orderkey IS NOT NULL AND flag IS NOT DISTINCT FROM CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE flag END AS identical FROM l LEFT JOIN orders ON o_orderkey = l_orderkey AND o_totalprice > 50000""")
def citation_verification(spark, sf):
    """Lines as citations; the evidence is that of orders beyond a price, with another flag where the order is closed."""
    line = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").cast("string").alias("evidence_id")).agg(F.min("l_returnflag").alias("flag"))
    o = table(spark, sf, "orders").where("o_totalprice > 50000").select(F.col("o_orderkey").alias("question_id"), "o_orderstatus")
    ev = line.join(o, "question_id").select("question_id", "evidence_id", F.when(F.col("o_orderstatus") == "F", F.lit("A")).otherwise(F.col("flag")).alias("flag"))
    return evidence.verify_citations(line, ev, ["flag"]).select("question_id", "evidence_id", "known", "identical")


@_query("""SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'a [E1].' ELSE 'a [E1].' || chr(10) || 'c [E1] [E2]' END AS answer, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS retained, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 1 END AS dropped,
o_orderkey % 3 < 2 AS can_repair, o_orderkey % 3 > 0 AS can_salvage FROM orders""")
def salvage_and_gates(spark, sf):
    """Answers with a claim that fails by its number, or by its number and its negation, beside none, one or two that hold."""
    claim = lambda i, t, m, e: F.struct(F.lit(f"C{i}").alias("claim_id"), F.lit(t).alias("claim_text"), F.array(*map(F.lit, m)).alias("markers"), F.array(*map(F.lit, e)).cast("array<string>").alias("errors"), F.lit(not e).alias("supported"))
    k = F.col("o_orderkey") % 3
    bad, both = claim(2, "b", ["E1"], ["numeric_mismatch"]), claim(2, "b", ["E1"], ["numeric_mismatch", "negation_mismatch"])
    some = F.when(k == 0, F.array(bad)).when(k == 1, F.array(claim(1, "a.", ["E1"], []), bad)).otherwise(F.array(claim(1, "a.", ["E1"], []), both, claim(3, "c", ["E1", "E2"], [])))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"), F.explode(some).alias("c")).select("question_id", "c.*")
    return evidence.salvage_claims(rows).join(evidence.repair_gates(rows), "question_id")


# --- comparisons and gates --------------------------------------------------------------------------------

@_query("SELECT count_if(d > 1e-6) AS win, count_if(abs(d) <= 1e-6) AS tie, count_if(d < -1e-6) AS loss, round(avg(d), 9) AS mean_delta, round(median(d), 9) AS median_delta FROM (SELECT l_tax - l_discount AS d FROM lineitem)")
def win_tie_loss(spark, sf):
    r = analytics.win_tie_loss(table(spark, sf, "lineitem"), "l_discount", "l_tax")
    return r.select("win", "tie", "loss", F.round("mean_delta", 9).alias("mean_delta"), F.round("median_delta", 9).alias("median_delta"))


@_query("SELECT p_partkey FROM part ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 1")
def lexicographic_best(spark, sf):
    return analytics.lexicographic_best(table(spark, sf, "part"), {"p_size": "max", "p_retailprice": "min"}, "p_partkey").select("p_partkey")


@_query("SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 400000 THEN 'too_dear' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END) AS violations, o_totalprice <= 400000 AND o_orderstatus <> 'P' AS ready FROM orders")
def readiness(spark, sf):
    v = analytics.violations(table(spark, sf, "orders"), {"too_dear": F.col("o_totalprice") > 400000, "pending": F.col("o_orderstatus") == "P"})
    return v.select("o_orderkey", F.array_join("violations", ",").alias("violations"), "ready")


@_query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 THEN 'reject_protocol' WHEN l_quantity < 5 THEN 'reject_reliability' WHEN l_tax - l_discount > 0.02 THEN 'accept' WHEN l_tax - l_discount < -0.02 THEN 'reject_quality' ELSE 'neutral' END AS decision FROM lineitem")
def decision_gates(spark, sf):
    d = analytics.decision_gate(table(spark, sf, "lineitem"), F.col("l_linenumber") != 7, F.col("l_quantity") >= 5, F.col("l_tax") - F.col("l_discount"), 0.02)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "decision")


@_query("SELECT p_partkey AS step, row_number() OVER (ORDER BY p_size DESC, p_partkey % 7, p_partkey % 5, p_retailprice, p_partkey) AS rank FROM part WHERE p_type = 'ECONOMY'")
def checkpoint_ranking(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("step"), (F.col("p_type") == "ECONOMY").alias("eligible"), F.col("p_size").alias("gain"), (k % 7).alias("unended"), (k % 5).alias("repetitive"), F.col("p_retailprice").alias("loss"))
    return diagnostics.rank_checkpoints(p).select("step", "rank")


@_query("""WITH o AS (SELECT o_custkey, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY 1) SELECT o_custkey, v[least(floor(len(v) * 0.9)::INT, len(v) - 1) + 1] AS p90 FROM o""")
def floor_percentiles(spark, sf):
    return ranks.exact_ranks(table(spark, sf, "orders"), ["o_custkey"], "o_totalprice", {"p90": ranks.floored(0.9)}).select("o_custkey", "p90")


@_query("""SELECT metric, count(v) AS cases, round(avg(v), 9) AS mean FROM (SELECT 'tax' AS metric, CASE WHEN l_linenumber < 6 THEN l_tax END AS v FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem) GROUP BY metric""")
def macro_summary(spark, sf):
    """Means over the cases that have a value."""
    line = table(spark, sf, "lineitem")
    long = line.select(F.explode(F.array(F.struct(F.lit("tax").alias("metric"), F.when(F.col("l_linenumber") < 6, F.col("l_tax")).alias("value")), F.struct(F.lit("discount").alias("metric"), F.col("l_discount").alias("value")))).alias("m")).select("m.*")
    return metrics.macro_summary(long).select("metric", "cases", F.round("mean", 9).alias("mean"))


@_query("""SELECT count(*) AS cases, round(avg(b.n - a.n), 9) AS mean_delta, count_if(b.n > a.n) AS improved, count_if(b.n < a.n) AS regressed, count_if(b.n = a.n) AS tied FROM (SELECT l_orderkey AS k, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey AS k, max(l_linenumber)::DOUBLE AS n FROM lineitem GROUP BY 1) b USING (k)""")
def paired_deltas(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("a"), F.max("l_linenumber").cast("double").alias("b"))
    d = metrics.paired_deltas(g.select("l_orderkey", F.col("a").alias("v")), g.select("l_orderkey", F.col("b").alias("v")), "l_orderkey", "v")
    return d.withColumn("mean_delta", F.round("mean_delta", 9))


@_query("""SELECT o_orderkey, CASE WHEN len(e) > 0 THEN CASE WHEN len(a) > 0 THEN len(list_intersect(e, a))::DOUBLE / len(a) ELSE 0 END END AS precision, CASE WHEN len(e) > 0 THEN len(list_intersect(e, a))::DOUBLE / len(e) END AS recall
FROM (SELECT o_orderkey, coalesce(list_distinct(list(l_partkey) FILTER (l_returnflag = 'R')), []) AS e, coalesce(list_distinct(list(l_partkey) FILTER (l_quantity > 25)), []) AS a FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def citation_metrics(spark, sf):
    """Parts of returned lines as expected citations, those of large lines as given ones."""
    g = table(spark, sf, "orders").select("o_orderkey").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(
        F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("e"), F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("a")
    )
    precision, recall = metrics.citation_metrics(F.col("e"), F.col("a"))
    return g.select("o_orderkey", precision.alias("precision"), recall.alias("recall"))


# --- dataset parts --------------------------------------------------------------------------------------

@_query("""SELECT doc_id, 'only_first' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'only_second' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def key_set_difference(spark, sf):
    return dataset.key_set_difference(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


_SFT = "s AS (SELECT conv_id, turn, [length(w) FOR w IN string_split(a, ' ')] AS p, [length(w) FOR w IN string_split(b, ' ')] AS r FROM (SELECT u.conv_id, u.turn, coalesce(u.text, '') AS a, coalesce(v.text, '') AS b FROM conversations u JOIN conversations v ON v.conv_id = u.conv_id AND v.turn = u.turn + 1))"


def _encoded(spark, sf):
    """Word lengths stand for token ids."""
    c = table(spark, sf, "conversations")
    ids = lambda x: F.transform(F.split(F.coalesce(F.col(x), F.lit("")), " "), lambda w: F.length(w))
    u = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("a"))
    d = u.join(c.select("conv_id", "turn", F.col("text").alias("b")), ["conv_id", "turn"]).select("conv_id", (F.col("turn") - 1).alias("turn"), ids("a").alias("p"), ids("b").alias("r"))
    inputs, labels = dataset.sft_encoding(F.col("p"), F.col("r"), 999, 64)
    return d.select("conv_id", "turn", inputs.alias("input_ids"), labels.alias("labels"))


@_query(f"WITH {_SFT}, c AS (SELECT *, r[1:greatest(64 - len(p) - 1, 0)] || [999] AS t FROM s) SELECT conv_id, turn, array_to_string(p || t, ',') AS input_ids, array_to_string([-100 FOR x IN p] || t, ',') AS labels FROM c")
def sft_encoding(spark, sf):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return _encoded(spark, sf).select("conv_id", "turn", text("input_ids"), text("labels"))


@_query(f"WITH {_SFT}, c AS (SELECT conv_id, turn, len(p) + least(len(r), greatest(64 - len(p) - 1, 0)) + 1 AS n FROM s), m AS (SELECT conv_id, max(n) AS m FROM c GROUP BY 1) SELECT conv_id, turn, m AS padded, n AS attended, m - n AS pads FROM c JOIN m USING (conv_id)")
def padded_batches(spark, sf):
    b = dataset.pad_batch(_encoded(spark, sf), "conv_id", "input_ids", "labels", -7)
    count = lambda c, v: F.size(F.filter(c, lambda x: x == v)).cast("long")
    return b.select("conv_id", "turn", F.size("labels").cast("long").alias("padded"), count("attention_mask", 1).alias("attended"), count("input_ids", -7).alias("pads"))

