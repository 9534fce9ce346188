"""Queries of this subpackage's operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import is_held_out, table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.language import identify, learn

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.media import store_texts

    return store_texts(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.quality import learn, score

    docs = table(spark, sf_dir, "documents")
    rows = score(docs.select("doc_id", "text"), learn(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.toxicity import learn, score

    docs = table(spark, sf_dir, "documents")
    rows = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.encoding import encode

    return encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), ids=False)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), words=51)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_language_id, op2_chat_formatting, op3_media_columns, op4_jaccard_join, op5_source_mixing, op6_quality_classifier, op7_token_counts, op8_toxicity,
        op9_document_fingerprints, op10_bpe_encoding, op11_suffix_dedup, op12_merkle_manifest, op13_source_divergence,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": OP2_SQL, "op12_merkle_manifest": OP12_SQL, "op13_source_divergence": OP13_SQL}


OP2_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER w AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, ''))),
p AS (SELECT *, string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix,
             count(*) OVER (PARTITION BY conv_id) AS n FROM t),
whole AS (SELECT min(conv_id) AS conv_id, n AS n_turns, prefix, count(*) AS n_copies FROM p WHERE pos = n GROUP BY n, prefix),
kept AS (SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.prefix = whole.prefix AND p.pos = whole.n_turns AND p.n > p.pos))
SELECT kept.conv_id, (pos - 1) // 256 AS part, n_turns, n_copies,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS chat
FROM kept JOIN t USING (conv_id) GROUP BY kept.conv_id, part, n_turns, n_copies
"""

OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 3),
sized AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
occurring AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
full_ AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM occurring JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
shares AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM full_ JOIN sized USING (lang)),
whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + any_value(v)) AS q FROM full_ JOIN sized USING (lang) GROUP BY lang, term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM occurring a JOIN occurring b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
over_ AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM over_) WHERE rank <= 200
"""

OP12_SQL = """
WITH RECURSIVE own AS (SELECT doc_id, source, text, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
        || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
        || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head FROM documents),
leaves AS (SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
        sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) AS altered FROM own),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY source) AS width FROM leaves),
up AS (SELECT tree, 0 AS level, pos, width, leaf AS d FROM placed
       UNION ALL SELECT tree, level + 1, pos // 16, (any_value(width) + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM up WHERE width > 1 GROUP BY tree, level, pos // 16),
crcs AS (SELECT DISTINCT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b:
             list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc
         FROM documents WHERE doc_id IS NOT NULL),
subroots AS (SELECT tree, d AS subroot, count(*) OVER () AS width FROM up WHERE width = 1),
top AS (SELECT 0 AS level, tree AS pos, width, subroot AS d FROM subroots
        UNION ALL SELECT level + 1, pos // 16, (any_value(width) + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM top WHERE width > 1 GROUP BY level, pos // 16),
runs AS (SELECT tree, level, pos // 16 AS run, list(d ORDER BY pos) AS ds FROM up WHERE width > 1 GROUP BY ALL
         UNION ALL SELECT -1, level, pos // 16, list(d ORDER BY pos) FROM top WHERE width > 1 GROUP BY ALL),
walk AS (SELECT tree AS own, pos AS leaf_at, tree, 0 AS level, pos, width, '' AS said, CASE WHEN doc_id IS NOT NULL AND crc % 5 = 0 THEN altered ELSE leaf END AS folded, 0 AS steps
         FROM (SELECT placed.*, crc FROM placed LEFT JOIN crcs USING (doc_id))
         UNION ALL
         SELECT own, leaf_at, CASE WHEN w.width = 1 THEN -1 ELSE w.tree END, CASE WHEN w.width = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN w.width = 1 THEN own ELSE pos // 16 END,
                CASE WHEN w.width = 1 THEN (SELECT count(*) FROM subroots) ELSE (w.width + 15) // 16 END,
                CASE WHEN w.width = 1 THEN said ELSE said || array_to_string(list_filter(ds, lambda x, i: i <> pos % 16 + 1), '') END,
                CASE WHEN w.width = 1 THEN folded ELSE sha256(array_to_string(ds[1:pos % 16], '') || folded || array_to_string(ds[pos % 16 + 2:], '')) END, steps + 1
         FROM walk w LEFT JOIN runs r ON r.tree = w.tree AND r.level = w.level AND r.run = w.pos // 16 AND w.width > 1 WHERE w.width > 1 OR w.tree >= 0),
ends AS (SELECT own AS tree, leaf_at AS pos, arg_max(said, steps) AS said, arg_max(folded, steps) AS folded_root FROM walk GROUP BY ALL),
root AS (SELECT d AS root FROM top WHERE width = 1)
SELECT doc_id, leaf, subroot, root, sha256(said) AS proof_sha256, folded_root, folded_root = root AS verified, source
FROM placed JOIN ends USING (tree, pos) JOIN subroots USING (tree), root
"""
