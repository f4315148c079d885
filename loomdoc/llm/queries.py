"""The query of each operator over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.blocks import crc_of_id
from loomdoc.llm.chat import format_chats, loss_text, read_chats, turns_text
from loomdoc.llm.context_tree import context_tree_scores
from loomdoc.llm.decontamination import contained_items
from loomdoc.llm.jaccard_join import jaccard_components
from loomdoc.llm.packing import pack_documents
from loomdoc.llm.quality_rules import quality_verdicts
from loomdoc.llm.substring_dedup import substring_dedup
from loomdoc.llm.token_counts import token_counts
from loomdoc.llm.token_files import write_tokens
from loomdoc.llm.toxicity import may_teach, toxicity_scores

WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), min_words=13, with_text=False)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree_scores(_table(spark, sf_dir, "documents"), lambda doc_id: crc_of_id(doc_id) % 10 != 0)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    scored = toxicity_scores(_table(spark, sf_dir, "documents"), labels.where(may_teach(labels["doc_id"])), threshold=0.7)
    return scored.select("doc_id", F.coalesce(crc_of_id(F.col("doc_id")) % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=5, threshold=0.8)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json", size=1024, end_id=0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), "piece_bpe_32k.model", limit=4096)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_tokens(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=0).documents()


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    read = read_chats(format_chats(chats))
    loss = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), turns_text(F.col("turns")).alias("all"), loss_text(F.col("turns")).alias("loss"), "formatted_chars")
    return loss.select("conv_id", "n_turns", F.sha2("all", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_packing": op6_packing,
    "op7_token_counts": op7_token_counts,
    "op8_token_files": op8_token_files,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS gram FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w)),
f AS (SELECT gram, min(doc_id) AS least FROM g GROUP BY gram),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM g JOIN f USING (gram) WHERE least < doc_id),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM w),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept, count(*) AS n_kept FROM p ANTI JOIN r ON p.doc_id = r.doc_id AND p.i = r.i GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    "op3_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2]) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM c UNION ALL SELECT b, a FROM c),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, least(doc_id, coalesce(m.least, doc_id)) AS component_id FROM s LEFT JOIN m ON m.a = s.doc_id""",
    "op5_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM benchmark),
k AS (SELECT item_id, least(5, len(ws)) AS k, unnest(list_distinct(list_transform(generate_series(1, len(ws) - least(5, len(ws)) + 1), lambda i: array_to_string(ws[i:i+least(5, len(ws))-1], ' ')))) AS x FROM b WHERE len(ws) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM k GROUP BY item_id),
h AS (SELECT DISTINCT doc_id, k, array_to_string(ws[i:i+k-1], ' ') AS x FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM k))),
f AS (SELECT doc_id, item_id, count(*) AS n_shared FROM h JOIN k ON h.k = k.k AND h.x = k.x GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared::BIGINT AS n_shared, n_shingles::BIGINT AS n_shingles, n_shared / n_shingles AS containment FROM f JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles - 1e-9""",
    "op9_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(~*)(/?(?:s>|SYS>>|INST\]))', '\1~\2\3', 'g')) + length(regexp_replace(role, '([<\[])(~*)(/?(?:s>|SYS>>|INST\]))', '\1~\2\3', 'g')) AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(8 + n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op10_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS x FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM d)),
t AS (SELECT doc_id, x FROM g GROUP BY doc_id, x HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT g.doc_id, unnest([g.i, g.i + 1, g.i + 2]) AS i FROM g JOIN t ON g.doc_id = t.doc_id AND g.x = t.x) GROUP BY doc_id),
s AS (SELECT d.doc_id, text, ws, ls, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * (length(text) - length(replace(text, '!', ''))) > n_words
  OR 10 * length(regexp_replace(text, '[^A-ZÀ-ÖØ-Ý]', '', 'g')) > 3 * length(text) OR word_chars < 2 * n_words OR word_chars > 15 * n_words
  OR 2 * n_dup_lines > len(ls) OR 100 * len(list_distinct(ws)) < 15 * n_words) AS kept FROM f""",
}
