"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, covertree, jaccard, langid, merkle, mixing, passages, piecewise, quality, secrets, sharding, tokenfiles, vafile
from tessera.llm.common import shared_dir, table


def byte_bpe() -> str:
    """The vocabulary file of the contract's queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["rank"] < len(secrets.KINDS))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["rank"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(secrets.KINDS)], F.sha2(secrets.written(base).cast("binary"), 256).alias("base_sha256"), secrets.written(F.col("secrets")).alias("spans"))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe()).drop("text")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op5_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfiles.write(table(spark, sf_dir, "documents"), byte_bpe(), folder)
    return tokenfiles.summary(spark, folder)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    planned = mixing.plan_mix(docs)
    return planned.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = sharding.shard(docs.select("doc_id", sharding.size(docs["text"]).alias("size"), sharding.checksum(docs["text"]).alias("text_crc32")), "doc_id", "text_crc32", "size")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")


def op9_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("row.doc_id", *[F.col("stats")[c].alias(c) for c in quality.COUNTS], "base_failed", "kept", "rule")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return vafile.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = merkle.verified(merkle.manifest(docs, merkle.lower_cased(docs)))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op13_piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_passages": op2_passages,
    "op3_bpe": op3_bpe,
    "op4_langid": op4_langid,
    "op5_tokenfiles": op5_tokenfiles,
    "op6_jaccard": op6_jaccard,
    "op7_mixing": op7_mixing,
    "op8_sharding": op8_sharding,
    "op9_covertree": op9_covertree,
    "op10_quality": op10_quality,
    "op11_negatives": op11_negatives,
    "op12_manifest": op12_manifest,
    "op13_piecewise": op13_piecewise,
}

ORACLE_SQL: dict[str, str] = {
    "op7_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM totals
), levels AS (
  SELECT *, row_number() OVER o AS rank, sum(source_size) OVER () AS whole,
    coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighted WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), lifted AS (
  SELECT *, (1.5::DOUBLE * whole - before) / rest AS lift FROM levels
), water AS (
  SELECT min_by(lift, rank) FILTER (WHERE cap / weight > lift) AS level FROM lifted
), targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR cap / weight <= level THEN cap ELSE level * weight END AS target
  FROM lifted, water
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':17'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
""",
    "op11_negatives": r"""
WITH parts AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.q, r.q)::BIGINT AS score
  FROM parts a JOIN parts r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
""",
    "op12_manifest": r"""
WITH RECURSIVE bytes AS (
  SELECT *, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS id_bytes FROM documents
), checked AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, id_bytes),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, i: xor(c >> 1, 3988292384::BIGINT * (c & 1)))), 4294967295::BIGINT) AS id_crc
  FROM bytes
), head AS (
  SELECT doc_id, source, text, id_crc,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head
  FROM checked
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN id_crc % 5 = 0
      THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS altered
  FROM head
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves
), nodes(level, source, pos, n, h) AS (
  SELECT 0, source, pos, n, leaf FROM placed
  UNION ALL
  SELECT level + 1, source, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY level, source, pos // 16, n
), subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper(level, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 16, n
), sides AS (
  SELECT *, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY level, source, pos // 16 ORDER BY pos)
), upper_sides AS (
  SELECT *, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM upper WHERE n > 1 WINDOW w AS (PARTITION BY level, pos // 16 ORDER BY pos)
), climb(source, start, level, pos, proof, h) AS (
  SELECT source, pos, 0, pos, '', coalesce(altered, leaf) FROM placed
  UNION ALL
  SELECT c.source, c.start, c.level + 1, c.pos // 16, proof || before || after, sha256(before || c.h || after)
  FROM climb c JOIN sides s ON s.level = c.level AND s.source IS NOT DISTINCT FROM c.source AND s.pos = c.pos
), reached AS (
  SELECT source, start, arg_max(proof, level) AS proof, arg_max(h, level) AS h FROM climb GROUP BY source, start
), crown(source, level, pos, proof) AS (
  SELECT source, 0, pos, '' FROM subroots
  UNION ALL
  SELECT c.source, c.level + 1, c.pos // 16, proof || before || after FROM crown c JOIN upper_sides s ON s.level = c.level AND s.pos = c.pos
), crowned AS (
  SELECT source, arg_max(proof, level) AS proof FROM crown GROUP BY source
), folding(source, start, level, pos, h) AS (
  SELECT r.source, r.start, 0, s.pos, r.h FROM reached r JOIN subroots s ON s.source IS NOT DISTINCT FROM r.source
  UNION ALL
  SELECT f.source, f.start, f.level + 1, f.pos // 16, sha256(before || f.h || after) FROM folding f JOIN upper_sides s ON s.level = f.level AND s.pos = f.pos
), folded AS (
  SELECT source, start, arg_max(h, level) AS folded_root FROM folding GROUP BY source, start
)
SELECT p.doc_id, p.leaf, s.subroot, u.h AS root, sha256(r.proof || c.proof) AS proof_sha256, f.folded_root, f.folded_root = u.h AS verified
FROM placed p
JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source
JOIN reached r ON r.source IS NOT DISTINCT FROM p.source AND r.start = p.pos
JOIN crowned c ON c.source IS NOT DISTINCT FROM p.source
JOIN folded f ON f.source IS NOT DISTINCT FROM p.source AND f.start = p.pos
CROSS JOIN (SELECT h FROM upper WHERE n = 1) u
""",
}
