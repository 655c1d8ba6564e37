"""The queries of these operators, and SQL where it can say what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.llm import alignment, decontaminate, grid_join, hmm, jaccard_join, line_dedup, packing, quality, secret_scan, shards, suffix_dedup, url_filter, vector_codes
from rulewright.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).drop("block_score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, table(spark, sf_dir, "labels")).select("doc_id", "importance", "kept")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.place(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_WORDS = r"""
SELECT {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM {table}"""
_SHINGLES = """
SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM {words}"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op4_url_filters": op4_url_filters,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op10_sharding": op10_sharding,
}

SQL: dict[str, str] = {
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (k) GROUP BY doc_id""",
    "op7_decontamination": f"""
WITH dw AS ({_WORDS.format(key="doc_id", table="documents")}), iw AS ({_WORDS.format(key="item_id", table="benchmark")}),
d AS ({_SHINGLES.format(key="doc_id", words="dw")}), b AS ({_SHINGLES.format(key="item_id", words="iw")}),
n AS (SELECT item_id, count(*) AS n_item_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_item_shingles, count(*) AS n_shared, count(*) / n_item_shingles AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item_shingles
HAVING count(*) >= 0.8 * n_item_shingles""",
}


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_copies(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES |= {"op5_jaccard_join": op5_jaccard_join, "op9_embedding_dedup": op9_embedding_dedup}


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES |= {"op6_suffix_dedup": op6_suffix_dedup}


def op3_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


QUERIES |= {"op3_hmm": op3_hmm}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES |= {"pipeline": pipeline}


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256"
    )


_NEAREST = """
a{k} AS (
  SELECT r, p, any_value(x) AS x, min(d * 64 + e) % 64 AS e, min(d) AS d FROM (
    SELECT r, p, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::HUGEINT AS d
    FROM parts JOIN b{k} USING (p)) GROUP BY r, p),"""
_UPDATE = """
s{k} AS (
  SELECT p, e, i, sum(v) AS s, count(*) AS n
  FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY p, e, i),
u{k} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS u FROM s{k} GROUP BY p, e),
b{next} AS (SELECT p, e, coalesce(u, c) AS c FROM b{k} LEFT JOIN u{k} USING (p, e)),"""

QUERIES |= {"op12_vector_codes": op12_vector_codes}
SQL |= {
    "op12_vector_codes": f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) AS t(p)),
firsts AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
b0 AS (SELECT p, e, x AS c FROM parts JOIN firsts USING (r)),
{_NEAREST.format(k=0)}{_UPDATE.format(k=0, next=1)}{_NEAREST.format(k=1)}{_UPDATE.format(k=1, next=2)}{_NEAREST.format(k=2)}
books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM b2)),
coded AS (SELECT r, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), books""",
}


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents"), *paths)


QUERIES |= {"op13_alignment": op13_alignment}


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


QUERIES |= {"op11_secrets": op11_secrets}
