"""The operators' queries under the fixed contracts, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import bytebpe, chatrotate, ctw, decontam, divergence, gramjoin, langid, neardup, quality, secrets, tokencount, toxicity, vectorcode
from textquarry.llm.common import fold
from textquarry.session import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    params = langid.LangParams()
    sample = langid.training_sample(docs.where(fold(4) != 2), "lang", "doc_id", "text", params)
    found = langid.predict(docs, langid.train(sample, params))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.language_references(docs))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bytebpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.NearDupParams(shingle=4))


def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered dialogues of every perspective, masks as a:b of characters, comma-joined."""
    found = chatrotate.rotate(table(spark, sf_dir, "conversations"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["a"].cast("string"), m["b"].cast("string"))), ",")
    return found.select("conv_id", "perspective", "part", "n_turns", "text", masks.alias("masks"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = ctw.score(docs, fold(10) != 0)
    return found.select("doc_id", (fold(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, train_where=lambda c: F.crc32(c.cast("string").cast("binary")) % 5 != 0)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectorcode.encode_vectors(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vectorcode.books_digest(books)).alias("codebooks_sha256"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gramjoin.join_components(table(spark, sf_dir, "documents"), gramjoin.GramJoinParams(shingle=3, percent=90))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_language_id, op2_quality_divergence, op3_byte_bpe, op4_minhash_near_dedup, op5_chat_rotation, op6_benchmark_decontamination, op7_token_counts, op8_lm_scoring, op9_toxicity, op10_secret_scan, op11_source_divergence, op12_vector_codes, op13_ngram_jaccard_join, pipeline]
    return {f.__name__: f for f in found}


def near_sql(k: int, percent: int, more: str = "") -> str:
    """Components of documents by word k-shingles and similarity, with all pairs that share a shingle."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i+{k - 1}], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM pairs p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.k >= {percent} * (x.n + y.n - p.k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS src, doc_id AS dst FROM documents UNION SELECT r.src, e.b FROM reach r JOIN both_ways e ON r.dst = e.a),
comp AS (SELECT src, min(dst) AS component_id FROM reach GROUP BY src)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id{more}
FROM documents d JOIN comp c ON c.src = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


OP4_SQL = near_sql(4, 80, ", d.doc_id = c.component_id AS kept")
OP13_SQL = near_sql(3, 90)

OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
docs AS (SELECT row_number() OVER () AS r, lang, source, regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM d),
tok AS (SELECT r, lang, source, unnest(ts) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::BIGINT AS n FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*)::BIGINT AS v, sum(n)::BIGINT AS nl FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM docs),
cnt AS (SELECT t.lang, t.source, t.term, count(*)::BIGINT AS c FROM tok t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY 1, 2, 3),
tot AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::BIGINT AS n FROM grp g LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 2)) // (t.n + 2 * l.v) AS p, 1 + (1000000000 * (k.n + 2)) // (l.nl + 2 * l.v) AS q
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang JOIN tot t ON t.lang = g.lang AND t.source = g.source LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(pv.value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

_OP12_ASSIGN = """a{r} AS (
  SELECT p.vec_id, p.part, p.v, arg_min(c.e, d(p.v, c.v) * 64 + c.e) AS e, min(d(p.v, c.v)) AS err FROM p JOIN c{r} c ON c.part = p.part GROUP BY p.vec_id, p.part, p.v
)""".replace("d(p.v, c.v)", "(" + " + ".join(f"(p.v[{i}] - c.v[{i}]) * (p.v[{i}] - c.v[{i}])" for i in (1, 2, 3, 4)) + ")")
_OP12_UPDATE = """c{n} AS (
  SELECT c.part, c.e, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT part, e, [floor(sum(v[1]) / count(*))::BIGINT, floor(sum(v[2]) / count(*))::BIGINT, floor(sum(v[3]) / count(*))::BIGINT, floor(sum(v[4]) / count(*))::BIGINT] AS v FROM a{r} GROUP BY part, e
  ) m ON m.part = c.part AND m.e = c.e
)"""

#: For vectors of 64 components, so that a part has four.
OP12_SQL = f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) AS rn
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), j AS (SELECT unnest(range(16)) AS part),
p AS (SELECT vec_id, rn, part, v[part * 4 + 1 : part * 4 + 4] AS v FROM k, j),
c0 AS (SELECT part, rn - 1 AS e, v FROM p WHERE rn <= 64),
{", ".join(_OP12_ASSIGN.format(r=r) + (", " + _OP12_UPDATE.format(r=r, n=r + 1) if r < 2 else "") for r in range(3))},
e AS (SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY part) AS code, sum(err)::BIGINT AS error FROM a2 GROUP BY vec_id),
b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c2)
SELECT e.vec_id, e.code, e.error, (sum(e.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, b.codebooks_sha256 FROM e JOIN k ON k.vec_id = e.vec_id, b
"""

OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, nullif(regexp_replace(role, '^[\x09-\x0D ]+|[\x09-\x0D ]+$', '', 'g'), '') AS who, replace(coalesce(text, ''), '<|', '<\|') AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(10) || coalesce(text, ''))) - 1 AS pos
  FROM conversations
), p AS (SELECT DISTINCT conv_id, who AS perspective FROM t WHERE who IS NOT NULL AND who <> 'system'),
j AS (
  SELECT t.conv_id, p.perspective, pos, pos // 64 AS part, said, coalesce(who = perspective, false) AS mine,
    CASE WHEN who = perspective THEN 'assistant' WHEN who = 'system' THEN 'system' ELSE 'user:' || replace(replace(coalesce(who, 'unknown'), '<|', '<\|'), '|>', '|\>') END AS speaker
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), r AS (SELECT *, '<|' || speaker || '|>' || chr(10) AS head, said || '<|end|>' || chr(10) AS body FROM j),
s AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY pos) AS b FROM r)
SELECT conv_id, perspective, part::BIGINT AS part, count(*)::BIGINT AS n_turns, string_agg(head || body, '' ORDER BY pos) AS text,
  coalesce(string_agg((b - length(body))::BIGINT || ':' || b::BIGINT, ',' ORDER BY pos) FILTER (mine), '') AS masks
FROM s GROUP BY conv_id, perspective, part
"""

OP6_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id::VARCHAR AS item_id, least(len(ws), 10) AS l, unnest(list_transform(range(1, greatest(len(ws) - 10, 0) + 2), lambda i: array_to_string(ws[i:i+least(len(ws), 10)-1], ' '))) AS w FROM iw WHERE len(ws) > 0),
lens AS (SELECT DISTINCT l FROM win),
dwin AS (SELECT doc_id, l, unnest(range(1, len(ws) - l + 2)) AS first_word, unnest(list_transform(range(1, len(ws) - l + 2), lambda i: array_to_string(ws[i:i+l-1], ' '))) AS w FROM dw, lens WHERE len(ws) >= l),
hit AS (SELECT d.doc_id, d.first_word, d.l, win.item_id FROM dwin d JOIN win ON d.w = win.w AND d.l = win.l),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(first_word, first_word + l)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS items_sha256 FROM hit GROUP BY doc_id)
SELECT dw.doc_id, len(dw.ws)::BIGINT AS n_words, coalesce(pos.n_hit, 0)::BIGINT AS n_hit, coalesce(it.n_items, 0)::BIGINT AS n_items, coalesce(it.items_sha256, sha256('')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash_near_dedup": OP4_SQL, "op5_chat_rotation": OP5_SQL, "op6_benchmark_decontamination": OP6_SQL, "op11_source_divergence": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_ngram_jaccard_join": OP13_SQL}
