"""The registered query of each operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.llm import decontam, hpylm, langid, minhash, packing, pivots, suffix, tokenfile, toxicity, urltree
from palisade.llm._tokenize import tokenizer_path
from palisade.llm._work import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), packing.Capacity(tokens=4096), end_id=1)


def op2_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_texts(table(spark, sf_dir, "documents"))


def op3_pivot_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path(), end_id=1)
    return tokenfile.read_token_files(spark, folder)


def op6_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80).drop("mark")


def op8_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, by its visible text, declared language, address and host; models are counted from labelled documents."""
    model = langid.train(table(spark, sf_dir, "documents"))
    host = urltree.url_host(F.col("url"))
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), langid.visible_text(F.col("html")).alias("text"), F.nullif(host, F.lit("")).alias("host"), langid.declared_language(F.col("html")).alias("declared"), F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit("")).alias("suffix")
    )
    return langid.identify(pages, model).withColumnRenamed("id", "page_id")


def op9_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score_toxicity(docs, machine)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_path_template_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge_urls(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_best_fit_packing, op2_pitman_yor_scores, op3_pivot_near_vectors, op4_suffix_array_dedup, op5_token_files, op6_wu_manber_decontamination, op7_minhash_near_duplicates,
        op8_language_evidence, op9_factorization_toxicity, op10_path_template_filter,
    )
    return {f.__name__: f for f in own}


_WORDS6 = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP6_SQL = f"""
WITH dw AS MATERIALIZED (SELECT doc_id, {_WORDS6} AS w FROM documents),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS6} AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item, CASE WHEN len(w) < 13 THEN len(w) ELSE 13 END AS m, array_to_string(w[i : i + CASE WHEN len(w) < 13 THEN len(w) ELSE 13 END - 1], ' ') AS s
  FROM bw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM windows),
spots AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s FROM dw, sizes, unnest(range(1, len(w) - m + 2)) t(i) WHERE len(w) >= m),
found AS MATERIALIZED (SELECT doc_id, i, m, item FROM spots JOIN windows USING (m, s)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_WORDS7 = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP7_SQL = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS7} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
linked AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, w.doc_id = coalesce(c.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP4_SQL = """
WITH t AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, md5_number(hex(b[i : i + 49])) AS s FROM t, unnest(range(1, n - 48)) u(i) WHERE n >= 50),
low AS (SELECT s, min(doc_id) AS d FROM g GROUP BY s HAVING count(DISTINCT doc_id) > 1),
hit AS MATERIALIZED (SELECT g.doc_id, i FROM g JOIN low USING (s) WHERE g.doc_id > low.d),
ends AS (SELECT doc_id, i, coalesce(i > 50 + lag(i) OVER (PARTITION BY doc_id ORDER BY i), true) AS fresh FROM hit),
runs AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM ends),
spans AS MATERIALIZED (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM runs GROUP BY doc_id, k),
gaps AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS f, a AS u FROM spans
  UNION ALL SELECT doc_id, max(z), max(n) + 1 FROM spans JOIN t USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(b[f : u - 1]), '' ORDER BY f) AS h FROM gaps JOIN t USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h) END) AS kept_sha256
FROM t LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_suffix_array_dedup": OP4_SQL, "op6_wu_manber_decontamination": OP6_SQL, "op7_minhash_near_duplicates": OP7_SQL}
