"""A training corpus from raw documents: language, near-duplicates, repeats, contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Rows without a doc_id are never taken for another row's duplicate and stay.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.llm import decontam, langid, minhash, packing, suffix
from palisade.llm._tokenize import tokenizer_path
from palisade.llm._work import new_folder


def _mark() -> Column:
    """What tells texts of one doc_id apart."""
    return F.when(F.col("text").isNotNull(), F.xxhash64("text"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs but those equal to a row of gone (doc_id, mark, and source if it has one); nulls are equal."""
    keys = [c for c in ("doc_id", "mark", "source") if c in gone.columns]
    left = {"doc_id": F.col("doc_id"), "mark": _mark(), "source": F.col("source")}
    gone = gone.select(*[F.col(c).alias(f"gone_{c}") for c in keys]).distinct()
    return docs.join(gone, reduce(and_, [left[c].eqNullSafe(gone[f"gone_{c}"]) for c in keys]), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts go that no language fits or that hold no letter or digit; the source is the host. Each row is judged by its own text."""
    model = langid.train(docs)
    none = F.lit(None).cast("string")
    rows = docs.select(F.struct("doc_id", _mark().alias("mark"), "source").alias("id"), "text", F.col("source").alias("host"), none.alias("declared"), none.alias("suffix"))
    return _without(docs, langid.identify(rows, model).where("rejected").select("id.*"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the text with the smallest doc_id stays, and one row of it.

    Rows that share doc_id and text are one document; the smallest in the order of columns stays. Texts of one doc_id are judged each.
    """
    gone = minhash.near_duplicates(docs, k=5, percent=80).where("not kept and doc_id is not null").select("doc_id", F.col("mark").alias("mark_"))  # a null text is kept
    known = docs.where("doc_id is not null").groupBy("doc_id", _mark().alias("mark_")).agg(F.min(F.struct(*docs.columns)).alias("row_"))
    return known.join(gone, ["doc_id", "mark_"], "left_anti").select("row_.*").unionByName(docs.where("doc_id is null"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has go from the text; n_chars follows; no document goes."""
    others = F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("others")  # whatever their names
    left = suffix.remove_repeats(docs.select("doc_id", "text", others), 50, keep_text=True).select("doc_id", "text", "others.*")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words a twentieth or more stand in 13-word windows of benchmark items."""
    found = decontam.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=True)
    return found.where("not contaminated").select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences of at most 4096."""
    return packing.pack_documents(docs, tokenizer_path(), packing.Capacity(tokens=4096), end_id=1)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: A Bayesian classifier and a packing heuristic are no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
