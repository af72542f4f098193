"""The operators as named queries over the driver's tables, and comparison texts where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import (
    alignment, chat, decontaminate, html_text, langid, line_dedup, nearest, packing, pii, prefix_trie, sharding, simhash,
    substring_dedup)
from quotemill.llm.common import workers_import

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_import(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


@query("op4_chat_examples", sql=r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
               AS loss_sha256,
           CAST(sum(length('<|turn|>' || replace(role, '<|', '<||') || '<|text|>' || replace(text, '<|', '<||')
               || '<|end|>')) AS BIGINT) AS formatted_chars,
           count(*) FILTER (role = 'assistant') AS n_examples
    FROM turns GROUP BY conv_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.segments(turns))


@query("op9_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op10_nearest", sql="""
    WITH v AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors.where(F.col("vec_id") % 20 == 0), vectors)


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, distance=3)


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


@query("op1_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_line_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", F.col("_ld_removed").alias("n_removed"))


@query("op3_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.trained(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), F.col("_lang_pred").alias("lang_pred"),
                        F.col("_lang_score").alias("score"))


@query("op7_html_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op11_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                     public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_prefix_trie", sql="""
    WITH RECURSIVE turns AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, role, text
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              WHERE conv_id IS NOT NULL)
    ), whole AS (
        SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS own FROM turns GROUP BY conv_id
    ), checked AS (  -- CRC-32 of the decimal id, bit by bit
        SELECT conv_id, own, xor(4294967295, list_reduce(list_prepend(4294967295,
                   list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
               lambda c, x: list_reduce(list_prepend(xor(c, x), list_transform(range(8), lambda i: CAST(0 AS BIGINT))),
                   lambda a, b: xor(a >> 1, (a & 1) * 3988292384)))) % 6 AS h
        FROM whole
    ), rebuilt AS (
        SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS said
        FROM checked c LEFT JOIN whole b ON b.conv_id = c.conv_id - c.conv_id % 100
    ), path(conv_id, depth, node, said) AS (
        SELECT conv_id, CAST(0 AS BIGINT), sha256(''), said FROM rebuilt
        UNION ALL
        SELECT conv_id, depth + 1,
               sha256(node || length(said[depth + 1].r) || ',' || said[depth + 1].r || said[depth + 1].t), said
        FROM path WHERE depth < len(said)
    ), nodes AS (
        SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
               any_value(CASE WHEN depth = 0 THEN 0 ELSE length(said[depth].t) END) AS chars,
               string_agg(CASE WHEN depth = len(said) THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends
        FROM path GROUP BY node
    ), up AS (  -- each node with the nodes on the path of its smallest member
        SELECT n.node, n.depth, p.node AS above, p.depth AS above_depth
        FROM nodes n JOIN path p ON p.conv_id = n.conv_id AND p.depth <= n.depth
    ), child AS (SELECT above AS node, count(*) AS n FROM up WHERE above_depth = depth - 1 GROUP BY above
    ), below AS (
        SELECT u.above AS node, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves,
               sum((n.n_convs - 1) * n.chars) AS saved
        FROM up u JOIN nodes n ON n.node = u.node LEFT JOIN child c ON c.node = u.node GROUP BY u.above
    )
    SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
           CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens,
           sha256(coalesce(n.ends, '')) AS ends_sha256
    FROM nodes n JOIN below b USING (node) LEFT JOIN child c USING (node)
    LEFT JOIN up u ON u.node = n.node AND u.above_depth = n.depth - 1 LEFT JOIN nodes a ON a.node = u.above""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op13_substring_dedup", sql=r"""
    WITH said AS (
        SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
        FROM documents
    ), win AS (
        SELECT row, doc_id, unnest(range(1, len(words) - 11)) AS place, words FROM said WHERE doc_id IS NOT NULL
    ), keyed AS (SELECT row, doc_id, place, md5(array_to_string(words[place:place + 12], ' ')) AS k FROM win
    ), gone AS (
        SELECT DISTINCT row, unnest(range(place, place + 13)) AS place FROM keyed
        JOIN (SELECT k, min(doc_id) AS first FROM keyed GROUP BY k) USING (k) WHERE first < doc_id
    ), cut AS (SELECT row, list(place) AS gone FROM gone GROUP BY row)
    SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
           sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE
               list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
    FROM said s LEFT JOIN cut c ON c.row = s.row""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return removed.select("doc_id", "n_words", "n_removed", "kept_sha256")
