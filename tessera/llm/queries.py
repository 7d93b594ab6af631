"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, langid, packing, ppm, quality, simhash, substrings, tokencount, toxicity
from tessera.llm.common import load, split_column


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.repeated(load(spark, sf_dir, "documents"), texts_out=())
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(load(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = split_column(F.col("doc_id"), 5) == 0
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), said)
    return chat.digests(rows.union(probe))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.apply_policy(quality.ledger(docs), quality.BASE, "base_kept")
    rows = quality.apply_policy(rows, quality.POLICIES["web-1"], "policy_kept")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"), (F.col("base_kept") & F.col("policy_kept")).alias("kept"),
        "failed", F.lit("web-1").alias("policy"), quality.sole_rule(quality.POLICIES["web-1"]).alias("sole_rule"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = split_column(F.col("doc_id"), 5) == 0
    labels = load(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model)
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries():
    return {f.__name__: f for f in (op1_substring_dedup, op2_lm_score, op3_language_id, op4_decontaminate, op5_token_counts, op6_chat, op7_simhash, op8_quality_rules, op9_packing, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1, "op4_decontaminate": OP4, "op6_chat": OP6, "op8_quality_rules": OP8}


#: Bytes as pairs of hex digits; texts are cut into stretches of 64 windows first, as taking a part of a long string is slow.
OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, j, substring(h, 128 * j + 1, 326) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0) // 64 + 1)) AS j FROM d)),
w AS (SELECT doc_id, 64 * j + r AS i, substring(s, 2 * r + 1, 200) AS s FROM c, (SELECT unnest(range(64)) AS r) WHERE length(s) >= 2 * r + 200),
f AS (SELECT s, min({'d': doc_id, 'i': i}) AS m FROM w GROUP BY s HAVING count(*) > 1),
g AS (SELECT w.doc_id, w.i FROM w JOIN f ON w.s = f.s WHERE {'d': w.doc_id, 'i': w.i} > f.m),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM g)),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM n GROUP BY doc_id, run),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS past FROM r),
k AS (SELECT p.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS past, string_agg(substring(h, 2 * past + 1, 2 * (a - past)), '' ORDER BY a) AS head FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(past, 0) + 1, length(h)))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


OP8 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)),
q AS (SELECT doc_id, s FROM v GROUP BY doc_id, s HAVING count(*) > 1),
rep AS (SELECT v.doc_id, count(DISTINCT v.i + k.k) AS n FROM v JOIN q ON q.doc_id = v.doc_id AND q.s = v.s, (SELECT unnest(range(5)) AS k) k GROUP BY v.doc_id),
ln AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(ln.n, 0)::BIGINT AS n_lines, coalesce(ln.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) AS n_upper_words
  FROM d LEFT JOIN ln ON ln.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id
), b AS (
  SELECT *, [n_words < 10, 100 * n_repeat_words > 20 * n_words, 10 * n_symbols > 3 * n_words, 2 * n_dup_lines > n_lines, 10 * n_upper_words > 4 * n_words, word_chars < 2 * n_words, word_chars > 25 * n_words] AS f FROM m
), z AS (SELECT *, list_sum([CASE WHEN f[i + 1] THEN 1 << i ELSE 0 END for i in range(7)])::BIGINT AS failed, len(list_filter(f, lambda x: x)) AS n_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f[1] OR f[2] AS base_failed, n_failed = 0 AS kept, failed, 'web-1' AS policy,
  CASE WHEN n_failed = 1 THEN ['few_words', 'repeated_windows', 'symbol_words', 'duplicate_lines', 'shouting', 'short_words', 'long_words'][list_position(f, true)] END AS sole_rule
FROM z
"""


OP4 = """
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
  UNION ALL
  SELECT 1, item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM benchmark
), s AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(words) - 5, 0) + 2), lambda i: array_to_string(words[i:i + 4], ' '))) AS shingle FROM w WHERE len(words) > 0
), n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id),
m AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared FROM s d JOIN s b ON d.shingle = b.shingle WHERE d.kind = 0 AND b.kind = 1 GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, shared AS n_shared, shared / n::DOUBLE AS containment
FROM m JOIN n ON n.id = item_id WHERE shared >= ceil(n * 0.8 - 1e-9)
"""


#: The strings that templates of public models use as control marks.
CONTROL_LIST = """
  '<|turn|>', '<|says|>', '<|end|>', '<|endoftext|>', '<|startoftext|>', '<|im_start|>', '<|im_end|>', '<|begin_of_text|>', '<|eot_id|>',
  '<|start_header_id|>', '<|end_header_id|>', '<|system|>', '<|user|>', '<|assistant|>', '<s>', '</s>', '<unk>', '<pad>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>',
  '<start_of_turn>', '<end_of_turn>', '<bos>', '<eos>'"""

#: The digests follow from the turns alone; formatted_chars counts three marks a turn and the marks of escapes.
OP6 = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
), l AS (
  SELECT *, length(role) + length(text) + 8 + 8 + 7
    + length(role) - length(replace(role, '\\', '')) + length(text) - length(replace(text, '\\', ''))
    + list_sum(list_transform([CONTROL_LIST], lambda k: ((length(text) - length(replace(text, k, ''))) + (length(role) - length(replace(role, k, '')))) // length(k))) AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, r0, t0)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, r0, t0), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
""".replace("CONTROL_LIST", CONTROL_LIST)
