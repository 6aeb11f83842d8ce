"""A corpus pipeline of four stages: toxicity, near duplicates, benchmark decontamination, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import bpe, decontaminate, ngram_join, toxicity
from ferrule.llm.common import bounded, cut, free_name, read_table, spread, trim_executors


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject (score below 0.5); it learns from those of docs that labels mark."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    names = docs.columns
    scored = toxicity.score(docs, model, name="toxicity_score")
    return scored.filter(F.col(scored.columns[-1]) < 0.5).select(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles, the document of the smallest id. Where ids are null or repeated,
    each row is a document of its own: rows link by their texts alone, a null id comes after all others, and of equal rows one stays."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("doc_id is null or c > 1")
    if odd.isEmpty():
        found = ngram_join.jaccard_components(docs, k=5, num=4, den=5)
        others = found.filter("doc_id <> component_id").select("doc_id")
        return docs.join(bounded(others, ngram_join.BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)
    row = free_name(docs, "row_id")
    keyed = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = ngram_join.jaccard_components(keyed, doc_id=row, k=5, num=4, den=5).withColumnRenamed("doc_id", row)
    best = found.join(keyed.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", row)).alias("best"))
    return keyed.join(best.select(f"best.{row}"), row, "left_semi").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to half or more."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number, and whether decoding gives the text back."""
    trim_executors(spark)
    back = bpe.encode(docs.select("doc_id", "text"), decoded="decoded")
    whole = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("token_ids", token_ids)]

#: No stage can be said in SQL; tests/llm hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written as Parquet in the shared folder and read by the next."""
    docs = spread(read_table(spark, sf_dir, "documents"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
