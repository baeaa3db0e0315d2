"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, chat, infilling, jaccard, language, lines, mixing, negatives, neighbours, packing, pseudonyms, scoring, topk
from marginalia.llm.shared import table


#: In production, give the key from a secret store.
PSEUDONYM_KEY = "example-key"


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), added_tokens=True)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_format_preserving_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY).select("doc_id", "text", F.col("_n_replaced").alias("n_replaced"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.predict(docs, model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    sources = [r["source"] for r in docs.where(F.col("source").isNotNull()).select("source").distinct().collect()]  # few, see mix
    mixed = mixing.mix(docs, {s: target_weight(s) for s in sources})
    return mixed.select("doc_id", "source", *(F.col(f"_{c}").alias(c) for c in ("source_rank", "block", "slot", "position")))


def target_weight(source: str) -> float:
    """Unequal weights for the query, by rule: 1 to 1,009, from the name's CRC-32."""
    return float(zlib.crc32(source.encode()) % 1009 + 1)


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"], F.lit("-"), m["end"])), ",")
    return views.select("conv_id", "participant", "segment", "first_turn", "n_turns", "text", spans.alias("mask"))


def op4_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")
    return scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op5_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_block_max_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_norm_bucketed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "_ids")
    both = bpe.decode(encoded, ranks)
    return both.select("doc_id", (F.octet_length("_ids") / 4).cast("long").alias("n_tokens"), F.sha2("_ids", 256).alias("ids_sha256"), F.sha2("_bytes", 256).alias("decoded_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infilling.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed="1")
    back = infilling.restored(F.col("_fim_text"), F.col("_form"))
    digests = (F.sha2("_fim_text", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
    return made.select("doc_id", F.col("_n_tokens").alias("n"), F.col("_form").alias("form"), F.col("_prefix_chars").alias("prefix_chars"), F.col("_middle_chars").alias("middle_chars"), *digests)


OP8_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP10_SQL = r"""
WITH said AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS nth
  FROM conversations
), views AS (
  SELECT s.conv_id, p.participant, s.nth, s.nth // 64 AS segment, s.role = p.participant AS mine,
    '<|im_start|>' || CASE WHEN s.role = p.participant THEN 'assistant' ELSE 'user name=' || regexp_replace(replace(s.role, '<|', '<' || chr(8203) || '|'), '\s+', '_', 'g') END || chr(10) AS head,
    s.body || '<|im_end|>' || chr(10) AS body
  FROM said s JOIN (SELECT DISTINCT conv_id, role AS participant FROM said) p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant, segment ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS start
  FROM views
)
SELECT conv_id, participant, segment::BIGINT AS segment, (segment * 64)::BIGINT AS first_turn, count(*)::INTEGER AS n_turns,
  string_agg(head || body, '' ORDER BY nth) AS text,
  coalesce(string_agg(CASE WHEN mine THEN start || '-' || (start + length(body) - 1) END, ',' ORDER BY nth), '') AS mask
FROM placed GROUP BY conv_id, participant, segment
"""

OP3_SQL = r"""
WITH lined AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), line AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS k, unnest(parts) AS line FROM lined
), keyed AS (
  SELECT doc_id, k, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line
), judged AS (
  SELECT doc_id, k, line, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


OP11_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable a JOIN usable c ON a.vec_id % 100 = 0 AND (a.label <> c.label OR a.vec_id <> c.vec_id)
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 10
"""

OP13_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens FROM documents
), drawn AS (
  SELECT doc_id, text, tokens, len(tokens) AS n, ('0x' || h[1:8])::BIGINT % (len(tokens) + 1) AS one, ('0x' || h[9:16])::BIGINT % (len(tokens) + 1) AS two,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed
), pieces AS (
  SELECT doc_id, text, n, form, array_to_string(tokens[1:least(one, two)], '') AS prefix,
    array_to_string(tokens[least(one, two) + 1:greatest(one, two)], '') AS middle, array_to_string(tokens[greatest(one, two) + 1:], '') AS suffix FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_ngram_jaccard_join, op3_line_dedup, op4_cross_entropy_difference, op5_multiprobe_neighbours, op6_format_preserving_pseudonyms, op7_language_id, op8_block_max_topk, op9_pfair_mixing, op10_perspective_rotation, op11_norm_bucketed_negatives, op12_prefix_bpe, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op8_block_max_topk": OP8_SQL, "op10_perspective_rotation": OP10_SQL, "op11_norm_bucketed_negatives": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
