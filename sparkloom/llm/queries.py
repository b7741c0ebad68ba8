"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import alignment, ann, decontaminate, fim, langid, mixing, sharding, simhash, substring, suffixes, tokencounts, tokenfile, toxicity
from sparkloom.llm.common import held_out, table
from sparkloom.llm.tokens import tokenizer_path
from sparkloom.session import materialise, new_path


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(langid.learning_sample(docs))
    return langid.identify(docs.select("doc_id", "text"), net).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lang.language").alias("lang_pred"), "__lang.score"
    )


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, delete those labelled as poor, commit the load again without effect."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counts = materialise(tokencounts.count_tokens(docs, tokenizer_path()), "token-counts")
    load = counts.withColumns({"op": F.lit("insert"), "version": F.lit("byte_bpe_50k")})
    poor = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    drop = load.join(poor, "doc_id", "left_semi").withColumn("op", F.lit("delete"))
    rollup = tokencounts.TokenRollup(spark, new_path(spark, "token-rollup"))
    for batch, changes in ((1, load), (2, drop), (1, load)):
        rollup.commit(batch, changes)
    return rollup.totals()


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "__mix.*")


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-file")
    tokenfile.write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return tokenfile.read_documents(spark, path)


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.shard(docs, 8).withColumn("grown_shard", F.lit(None).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), "score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_kmeans_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialise(fim.store(table(spark, sf_dir, "documents")), "frames")
    return fim.digests(fim.rearrange(stored))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    "op1_simhash_groups": op1_simhash_groups,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language": op3_language,
    "op4_token_rollup": op4_token_rollup,
    "op5_source_mix": op5_source_mix,
    "op6_token_file": op6_token_file,
    "op7_hilbert_shards": op7_hilbert_shards,
    "op8_toxicity": op8_toxicity,
    "op9_benchmark_leaks": op9_benchmark_leaks,
    "op10_kmeans_tree_neighbours": op10_kmeans_tree_neighbours,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_token_alignment": op13_token_alignment,
}

SQL = {
    "op5_source_mix": r"""
WITH d AS (
  SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 12))::BIGINT)::DOUBLE / 281474976710656.0 AS u,
    1 - length(translate(text, '%&*#$|!=<>{}[]~^', ''))::DOUBLE / greatest(length(text), 1) AS symbols
  FROM documents),
k AS (SELECT *, CASE WHEN symbols >= 0.1 THEN pow(u, 4) WHEN symbols >= 0.02 THEN pow(u, 2) ELSE u END AS key FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS w
  FROM k GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (
  SELECT source, source_size, least(cap, coalesce(w * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio), cap)) AS target
  FROM l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size) ELSE 0 END::BIGINT AS epochs
  FROM t),
p AS (
  SELECT doc_id, size, source_size, target, epochs, floor(target + 0.5)::BIGINT - epochs * source_size AS budget,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key DESC, doc_id NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - earlier)))::BIGINT AS taken
FROM p
""",
    "op11_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
c AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT doc_id, n, form, t, array_to_string(u[1:least(c1, c2)], '') AS a, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
    array_to_string(u[greatest(c1, c2) + 1:n], '') AS z
  FROM c),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END AS out
  FROM p),
r AS (
  SELECT *, string_split(out, '<M>') AS f, string_split(string_split(out, '<M>')[1], CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS g FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(out) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN out WHEN 'psm' THEN substr(g[1], 4) || f[2] || g[2] ELSE g[2] || f[2] || substr(g[1], 4) END) AS restored_sha256
FROM r
""",
}
