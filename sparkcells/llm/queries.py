"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_tree, chat_rotation, langid, license_scan, line_dedup, packing, quality_rules, simhash, sp_sampling, toxicity
from .common import cut, id_crc, table

#: Where the tokenisers' vocabularies are: a name that the tokeniser package resolves, or a path.
VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else str(public_tokenizers.path(name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["name"].startswith("phrase "))
    joined = lambda x: F.array_join(F.sort_array(F.array_distinct(F.transform(x, lambda y: y["label"]))), ",")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["first"])).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["cover"])), F.lit(0.0)).alias("score"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(quality_rules.statistics(table(spark, sf_dir, "documents"), ["doc_id"]))
    rules = quality_rules.fit(stats, table(spark, sf_dir, "labels"))
    failed = quality_rules.base_failed()
    rule = quality_rules.verdict(rules)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return stats.select("doc_id", *counts, failed.alias("base_failed"), (~failed & (rule == 0)).alias("kept"), rule.alias("rule"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.apply(docs, line_dedup.dropped(docs))
    bitmap, text = F.col("bitmap"), F.col("text")
    return found.select(
        "doc_id", F.size(line_dedup.lines_of(text)).cast("long").alias("n_lines"), line_dedup.n_dropped(bitmap).alias("n_dropped"),
        F.sha2(line_dedup.kept_text(text, bitmap), 256).alias("kept_sha256"),
    )


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat_rotation.rotate(table(spark, sf_dir, "conversations"))
    span = F.transform("spans", lambda x: F.concat(x["first"].cast("string"), F.lit("-"), x["last"].cast("string")))
    return found.select(
        "conv_id", "perspective", "part", "n_turns", "n_masked", "rendered",
        F.concat_ws("|", "names").alias("names"), F.concat_ws("|", "roles").alias("roles"),
        F.concat_ws("", F.col("mask").cast("array<string>")).alias("mask"), F.concat_ws(",", span).alias("spans"),
    )


def op5_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learns = F.pmod(id_crc("doc_id"), F.lit(5)) != 0
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), learns)
    found = toxicity.score(docs, machine, ["doc_id"])
    return found.select("doc_id", (~learns).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann_tree.nearest(vectors, F.col("vec_id") % 50 == 0)


def op7_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_sampling.sampled(table(spark, sf_dir, "documents"), vocabulary(PIECES), [F.col("doc_id")], ["doc_id"])


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cut(packing.pieces(table(spark, sf_dir, "documents"), vocabulary(VOCABULARY)))
    packed = packing.pack(made)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2).select("doc_id", "fingerprint", "component_id")


def op10_byte_cnn_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learns = F.pmod(id_crc("doc_id"), F.lit(4)) != 2
    found = langid.predict(docs, langid.fit(docs, learns), ["doc_id"])
    return found.select("doc_id", (~learns).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_chat_rotation": op4_chat_rotation,
    "op5_toxicity_fm": op5_toxicity_fm,
    "op6_ann_tree": op6_ann_tree,
    "op7_gumbel_segmentations": op7_gumbel_segmentations,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_byte_cnn_langid": op10_byte_cnn_langid,
}

_OP3 = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, i, line, coalesce(k.doc_id <> keeper, false) AS lost FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_OP4 = r"""
WITH t AS (SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS said FROM conversations),
n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, name, said) - 1) // 1024 AS part,
      regexp_replace(said, '<(\\*)\|', '<\\\1|', 'g') AS words,
      replace(regexp_replace(name, '([\\|<>])', '\\\1', 'g'), chr(10), '\n') AS tag FROM t),
p AS (SELECT DISTINCT conv_id, name AS perspective FROM t WHERE name <> 'system'),
r AS (SELECT n.*, perspective, CASE WHEN name = perspective THEN 'assistant' WHEN name = 'system' THEN 'system' ELSE 'user' END AS kind
      FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, CASE WHEN kind = 'user' THEN '<|user name=' || tag || '|>' ELSE '<|' || kind || '|>' END || chr(10) AS head FROM r),
o AS (SELECT *, sum(length(head) + length(words) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, name, said
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS finish FROM h)
SELECT conv_id, perspective, part, count(*)::BIGINT AS n_turns, count(*) FILTER (WHERE kind = 'assistant')::BIGINT AS n_masked,
       string_agg(head || words || chr(10), '' ORDER BY turn, name, said, finish) AS rendered,
       string_agg(name, '|' ORDER BY turn, name, said, finish) AS names,
       string_agg(kind, '|' ORDER BY turn, name, said, finish) AS roles,
       string_agg(CASE WHEN kind = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY turn, name, said, finish) AS mask,
       coalesce(string_agg(((finish - length(words))::BIGINT)::VARCHAR || '-' || (finish::BIGINT)::VARCHAR, ',' ORDER BY turn, name, said, finish)
                FILTER (WHERE kind = 'assistant'), '') AS spans
FROM o GROUP BY conv_id, perspective, part
"""

ORACLES: dict[str, str] = {"op3_line_dedup": _OP3, "op4_chat_rotation": _OP4}
