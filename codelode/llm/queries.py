"""One query per operator over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.llm import bpe, html, leaks, lines, lm, merkle, mixing, sharding, simhash, spelling, sql, topk, toxicity, vectors

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_file())


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other document (by CRC-32 of its id) claims to have lost its line ends."""
    tampered = merkle.leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, tampered)
    return merkle.manifest(_table(spark, sf_dir, "documents"), claimed).verify()


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"), every=199)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_line_dedup, op3_html_extraction, op4_lm_scoring, op5_embedding_dedup, op6_exact_top_k, op7_toxicity, op8_sharding, op9_bpe, op10_mixing,
        op11_merkle, op12_spelling, op13_decontamination,
    )
}

ORACLES: dict[str, str] = {
    "op5_embedding_dedup": """
        WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        links AS MATERIALIZED (
          SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (SELECT vec_id AS node, vec_id AS other FROM v
          UNION SELECT r.node, l.b FROM reach AS r JOIN links AS l ON l.a = r.other)
        SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, m.component_id, vec_id = m.component_id AS kept
        FROM v JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) AS m ON m.node = vec_id
    """,
    "op6_exact_top_k": """
        WITH v AS MATERIALIZED (
          SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
          FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 20
    """,
    "op10_mixing": r"""
        WITH d AS MATERIALIZED (
          SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
            CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:12] AS BIGINT) AS place FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS most FROM s),
        l AS (SELECT *, most / weight AS ratio,
            ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(most) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
          FROM w WINDOW p AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size, least(most, coalesce((SELECT max(level) FROM l WHERE level <= ratio) * weight, most)) AS target FROM l),
        k AS (SELECT *, CAST(floor(target / source_size) AS BIGINT) AS whole, target - floor(target / source_size) * source_size AS budget FROM t),
        r AS (SELECT d.doc_id, d.size, k.source_size, k.target, k.whole, k.budget,
            sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place RANGE UNBOUNDED PRECEDING) AS upto,
            sum(d.size) OVER (PARTITION BY d.source, d.place) AS here
          FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
        SELECT doc_id, size, source_size, round(target, 4) AS target,
          CAST(size * least(3, whole + CASE WHEN upto <= budget OR (upto - here <= budget AND upto - budget < budget - (upto - here)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM r
    """,
    "op11_merkle": sql.MERKLE,
    "op12_spelling": sql.SPELLING,
    "op13_decontamination": sql.LEAKS,
}
